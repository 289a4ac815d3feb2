import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftline.llm import addresses, canonical, language, leaks, mixing, near, personal, stuffing, terms
from siftline.llm.labels import stated


# canonical form


@pytest.mark.parametrize(
    "text,want,changed",
    [
        ("ｐｕｓｈ", "push", True), ("𝐬𝐢𝐠𝐧 ２", "sign 2", True), ("café", "café", True), ("a​b c", "ab c", True), ("expιred", "expired", True), ("тeкст", "текст", True), ("INSTALL PΟSΤΜΑRΚS", "INSTALL POSTMARKS", True),
        ("S2S-вызовов", "S2S-вызовов", False), ("café “q” — x\n", "café “q” — x\n", False), ("👩‍💻 ✅️ 👍🏽", "👩‍💻 ✅️ 👍🏽", False), ("", "", False), ("вода water", "вода water", False),
    ],
)
def test_canonical_forms(text, want, changed):
    got, n = canonical.mapping().rewrite(text)
    assert (got, n > 0) == (want, changed)
    assert canonical.mapping().rewrite(got) == (got, 0)


def test_canonical_frame(spark):
    df = spark.createDataFrame([(1, "ａ", 5), (2, None, 6), (3, "", 7), (4, "x" * 5000 + "​", 8), (5, "plain", 9)], "id int, t string, `_x` int")
    got = {r.id: (r.canonical, r.changes, r._x) for r in canonical.canonical(df, "t").collect()}
    assert got == {1: ("a", 1, 5), 2: (None, 0, 6), 3: ("", 0, 7), 4: ("x" * 5000, 1, 8), 5: ("plain", 0, 9)}
    assert {r.id for r in canonical.disguised(df, "t").collect()} == {1, 4}
    assert canonical.canonical(df.limit(0), "t").count() == 0


def test_suspects_cover_the_mapping(spark):
    keys = list(canonical.mapping().single)
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert df.where(~canonical.suspect(F.col("k"))).count() == 0


# language


def test_labels(spark):
    rows = {"en": "en", "ENG": "en", "pt_BR": "pt", "German": "de", "und": None, "": None, None: None, "unknown": None, "es-419": "es"}
    df = spark.createDataFrame([(k,) for k in rows], "l string")
    assert {r.l: r.s for r in df.select("l", stated(F.col("l")).alias("s")).collect()} == rows


def test_held_out_sentences():
    packed = language.Compressors(language.SEED)
    held = {
        "es": "No sabemos todavía cuándo van a llegar los pagos de la próxima semana", "pt": "Ainda não sabemos quando vão chegar os pagamentos da próxima semana", "pl": "Jeszcze nie wiemy, kiedy przyjdą wypłaty za następny tydzień, bo nikt nam nie odpowiada",
        "de": "Wir wissen noch nicht, wann die Zahlungen der nächsten Woche kommen", "fr": "Nous ne savons pas encore quand les paiements de la semaine vont arriver", "en": "We still do not know when the payments of the next week will arrive", "ru": "Мы ещё не знаем, когда придут выплаты за следующую неделю",
    }
    got = dict(zip(held, packed.classify(list(held.values()), 0.0)))
    assert {k: v[0] for k, v in got.items()} == {k: k for k in held}


def test_mixed_text_gets_a_language_for_each_part(spark):
    text = "This week we have lost a lot of money and also time. Potrzebujemy pomocy, żeby przenieść wszystkie dane przed poniedziałkiem."
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "ok up"), (5, "x" * 20000)], "id int, t string")
    parts = language.languages(df, "t", language.SEED)
    got = {r.id: [p.lang for p in r.parts] for r in parts.collect()}
    assert got[1] == ["en", "pl"] and got[2] == got[3] == got[4] == []
    best = {r.id: r.b for r in parts.select("id", language.document_language(F.col("parts")).alias("b")).collect()}
    assert best[1].lang in ("en", "pl") and best[2] is None


def test_fit_ignores_wrong_labels(spark):
    df = spark.createDataFrame([(language.SEED["en"], "de")] * 5 + [(language.SEED["fr"], "fr")], "text string, label string")
    prose = language.fit(df)
    assert "the page" not in prose["de"].replace(language.SEED["de"], "") and prose["fr"] != language.SEED["fr"]


# near duplicates


def brute_pairs(rows, percent=65):
    sets = {}
    for k, t in rows:
        t = t or ""
        sets[k] = min(sets.get(k, t), t)
    sets = {k: set(re.findall(r"[^\W_]+", t.lower())) for k, t in sets.items()}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b])}


def test_similarity_join_is_exact(spark, monkeypatch):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [random.sample(vocabulary, 14) for _ in range(12)]
    rows = []
    for i in range(130):
        words = list(random.choice(base))
        for _ in range(random.randrange(6)):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        rows.append((f"k{i:03d}", " ".join(words)))
    rows += [("e1", ""), ("e2", None), ("k000", "zz later copy"), ("c1", "a b c"), ("c2", "c, B a!"), ("one", "solo"), ("uno", "solo")]
    df = spark.createDataFrame(rows, "key string, text string")
    for size in (4096, 64, 8, 1):  # whole lists, and lists cut into blocks
        monkeypatch.setattr(near, "BLOCK", size)
        join = near.Join(df)
        assert {tuple(r) for r in join.pairs().collect()} == brute_pairs(rows)
        assert join.pairs().count() == len(brute_pairs(rows))
    groups = {r.key: r for r in join.groups().collect()}
    assert groups["c2"].class_key == "c1" and groups["c1"].copies == 2 and "e1" not in groups
    assert near.Join(df.limit(0)).pairs().count() == 0


def test_blocks_are_bounded_and_skipped(spark):
    random.seed(3)
    # one word stands in every set, at the same place in sets of the same length
    rows = [(i, 10 + i % 60, 0, 7) for i in range(600)] + [(1000 + i, 20, 0, 9) for i in range(300)] + [(2000 + i, 20, i % 5, 11 + i) for i in range(50)]
    lists = spark.createDataFrame(rows, "id bigint, n int, pos int, tok bigint")
    light, cut = near.blocks(lists, 16)
    assert light.count() == 50 and cut.count() == 900
    sizes = [r["count"] for r in cut.groupBy("tok", "block").count().collect()]
    assert max(sizes) <= 40  # 16 on average
    known = near.directory(cut)
    of_seven = known.where("tok = 7").count()
    kept = near.block_pairs(known)
    assert 0 < kept.where("tok = 7").count() < of_seven * (of_seven + 1) // 2 * 0.8
    # no pair that sizes allow is skipped
    at = {r.id: r.block for r in cut.collect()}
    cells = {(r.tok, r.bi, r.bj) for r in kept.collect()}
    for x in random.sample(rows[:600], 60):
        for y in random.sample(rows[:600], 60):
            if x[1] * 100 >= 65 * y[1] and y[1] * 100 >= 65 * x[1]:
                i, j = sorted((at[x[0]], at[y[0]]))
                assert (7, i, j) in cells


def test_smaller_sets_meet_at_fewer_words(spark):
    sets = spark.createDataFrame([(i, 20, 0, 0, list(range(20))) for i in range(10)], "id bigint, n int, b0 bigint, b1 bigint, toks array<bigint>")
    small, large = near._cells(near.postings(sets), near.PERCENT)
    # sets of 20 words share 16 with their like, 13 with the smallest that resemble them
    assert small.count() == 10 * 5 and large.count() == 10 * 8
    assert near.similar_classes(sets).count() == 45


# terms


def test_terms_with_tiny_partitions(spark):
    random.seed(2)
    rows = [(f"r{i % 40}" if i % 9 else None, random.choice(["hot", "hot", *[f"t{j}" for j in range(50)]])) for i in range(600)] + [("r1", ""), ("r1", None)]
    df = spark.createDataFrame(rows, "record string, term string")
    got = {r.term: (r.occurrences, r.records) for r in terms.frequencies(df, partition_rows=3).collect()}
    occurrences = Counter(t for _, t in rows if t)
    assert got == {t: (n, len({r for r, x in rows if x == t and r})) for t, n in occurrences.items()}
    assert terms.frequencies(df.limit(0)).count() == 0


# personal information


def seen(text, model=personal.Model()):
    return {k for _, _, k in personal.find(personal.readable(text), model)}


@pytest.mark.parametrize(
    "text,kinds",
    [
        ("write to ann.lee@host.example", {"email"}), ("ann (at) host [dot] example please", {"email"}), ("ann at host dot example", {"email"}), ("call +44 7700 900123 now", {"phone"}), ("(020.7946.0321)", {"phone"}), ("(ticket 2800-396-159)", set()), ("[10.125.237.101]", set()), ("subid=171.13087970", set()),
        ("#33244356319 2026-07-17", set()), ("SSN 902-57-2085", {"idnum"}), ("CPF 232.580.064-73", {"idnum"}), ("68 Tunent Court, Flat 10, Gormar", {"address"}), ("ул. Троент, д. 185, кв. 131", {"address"}), ("Vearkstr. 253b in 40840 Kaburg", {"address"}), ("Our office is at Fenyx House", set()), ("Einkäufer 771 Abschlüsse", set()), ("", set()),
    ],
)
def test_forms(text, kinds):
    assert seen(text) == kinds


def test_bootstrap_learns_names_and_labels(spark):
    random.seed(1)
    first, last = ["Anna", "Bela", "Carl", "Dora", "Emil"], [f"Sur{c}{d}ov" for c in "abcdefgh" for d in "aeiou"]
    rows = []
    for i in range(200):
        f, s = first[i % 5], last[(i * 7) % 40]
        own = f"{f.lower()}_{s.lower()}{i}" if i % 3 == 0 else ""
        rows.append((f"please ask for {f} {s} on monday because the desk is open", own))
        label, value = (("SSN", f"9{i % 10}1-4{i % 10}-{1000 + i}"), ("DNI", f"{10000000 + i}M"), ("Pasz", f"QX{7000000 + i}"))[i % 3]
        rows.append((f"they asked for {label} {value} twice because the desk is open", ""))
        rows.append((f"you wanted my {label} {value} because the desk is open", ""))
    model = personal.bootstrap(spark.createDataFrame(rows, "text string, hints string"))
    assert {x.lower() for x in first} <= model.first
    assert "pasz" in model.labels
    assert seen("Pasz QX9990001", model) == {"idnum"} and seen("regards, Dora Unknownova", model) == {"name"} and seen("hello Dora on the desk", model) == set()
    df = spark.createDataFrame([(1, "see Dora Unknownova, x@y.example"), (2, None), (3, ""), (4, "nothing here")], "id int, text string")
    got = {r.id: (r.redacted, sorted(r.kinds)) for r in personal.redacted(df, model).collect()}
    assert got == {1: ("see [NAME], [EMAIL]", ["email", "name"]), 2: (None, []), 3: ("", []), 4: ("nothing here", [])}


def test_surnames_of_many_people_stay_surnames(spark):
    names = [(a, b) for a in ("Petra", "Milan", "Clara", "Hugo") for b in ("Bekski", "Lemkato", "Trolosk", "Fenmann", "Daldrez", "Vorkuist", "Shagri", "Nokdal")]
    said = ("thanks, {}", "write to {} today", "regards {}!")
    df = spark.createDataFrame([(said[i % 3].format(f"{a} {b}"), f"{a}_{b}".lower()) for i, (a, b) in enumerate(names)], "text string, hints string")
    model = personal.bootstrap(df)
    assert model.first == {"petra", "milan", "clara", "hugo"}
    assert {tuple(r.kinds) for r in personal.kinds(df, model).collect()} == {("name",)}


def test_plain_addresses(spark):
    df = spark.createDataFrame([("A.B (at) host [dot] co [dot] example; a.b@host.co.example",)], "t string")
    assert df.select(addresses.emails(F.col("t"))).first()[0] == ["a.b@host.co.example"]


# leaks


def test_leaks_against_brute_force(spark):
    random.seed(8)
    word = lambda: random.choice([f"v{i}" for i in range(80)])
    items = [(i, " ".join(word() for _ in range(random.choice((5, 13, 20, 40))))) for i in range(15)] + [(90, None), (91, ""), (92, "the " * 20)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(30)]
        if d % 2:
            src = random.choice(items[:15])[1].split()
            n = random.randrange(8, len(src) + 1) if len(src) > 8 else len(src)
            at = random.randrange(0, len(src) - n + 1)
            text[10:10] = src[at : at + n]
        docs.append((d, ", ".join(text).upper()))
    docs += [(100, None), (101, ""), (102, "The the, " * 30)]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    grams = lambda t: {tuple(w[i : i + 13]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 12)}
    assert got == {(d, i) for d, t in docs for i, s in items if grams(t) & grams(s)}


# mixing


def test_flight_keeps_both_totals():
    rng = random.Random(3)
    tokens = [float(rng.randrange(1, 500)) for _ in range(700)]
    pi = mixing.fly([0.3] * 700, tokens, random.Random(1))
    assert sum(0 < p < 1 for p in pi) <= 2
    assert abs(sum(pi) - 210) < 1e-6 and abs(sum(p * t for p, t in zip(pi, tokens)) - 0.3 * sum(tokens)) < 1e-4
    assert all(p in (0.0, 1.0) for p in mixing.land(pi, tokens, sum(tokens), 700))


def test_mix_reaches_targets(spark):
    random.seed(6)
    sizes = spark.createDataFrame([(i, ("a", "b", "c", None)[i % 4], random.randrange(20, 200)) for i in range(1200)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(" A ", 0.1, 1), ("b", 0.4, 3), ("c", 0.45, 1), ("gone", 0.05, 9)], "source string, target_share double, max_repeats int")
    planned = mixing.plan(sizes, targets)
    got = {r.source: r for r in mixing.report(planned, mixing.mix(sizes, planned, block=50)).collect()}
    assert {k for k, r in got.items() if not r.reachable} == {"c", "gone"}
    assert abs(got["a"].reached_share - 0.1) < 0.002 and abs(got["b"].reached_share - 0.4) < 0.002 and got["gone"].used_docs == 0
    assert got["c"].used_docs == 300


# stuffed pages


def test_stuffed_pages(spark):
    random.seed(4)
    prose = {"en": "the team has lost a lot of money because our server did not answer and nobody knows why".split(), "de": "das team hat viel geld verloren weil unser server nicht mehr antwortet und niemand kennt den grund".split(), "fr": "notre équipe a perdu beaucoup d argent parce que le serveur ne répond plus et personne ne sait pourquoi".split()}
    rows = []
    for i in range(150):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join(random.choices(prose[lang], k=80) + [f"Name{random.randrange(99)}" for _ in range(10)]), lang))
    rows += [(900, "best shoes online, cheap shoes online, " * 15, "en"), (901, "https://a.example/x1 shoes\n" * 20, "fr"), (902, None, "en"), (903, "", "de"), (904, rows[0][1] + " #shoes #online #cheap", "en")]
    got = {r.doc_id for r in stuffing.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == {900, 901}


def test_every_key_of_the_mapping_is_brought_to_its_form():
    from siftline.llm.canonical import mapping

    m = mapping()
    assert {k: m.rewrite(k) for k in m.single} == {k: (v, 1) for k, v in m.single.items()}
    assert m.rewrite("ⒽⒺⓁⓁⓄ ⓦⓞⓡⓛⓓ ① \U0001d400 \uff21") == ("HELLO world 1 A A", 5)
    # a selector makes an emoji of a key that may be one; other emoji stay
    assert m.rewrite("Ⓜ\ufe0f ㊗\ufe0f ✅ \U0001f469\u200d\U0001f4bb ☎\ufe0f") == ("Ⓜ\ufe0f ㊗\ufe0f ✅ \U0001f469\u200d\U0001f4bb ☎\ufe0f", 0)


def test_a_text_of_circled_letters_is_a_case(spark):
    from siftline.llm.canonical import canonical

    df = spark.createDataFrame([(1, "ⓑⓤⓨ now"), (2, "buy now")], "id int, t string")
    assert {r.id: r.canonical for r in canonical(df, "t").collect()} == {1: "buy now", 2: "buy now"}


def test_no_look_before_a_pattern_is_narrower_than_it():
    import re

    from siftline.llm import personal as P

    missed = []
    for sign in ("@", " @ ", " at ", "\tat\n", " AT ", *(f"{a}{b}{w}{b}{c}" for a, c in ("()", "[]", "{}") for b in ("", " ") for w in ("at", "At", "@"))):
        for dot in (".", " dot ", "(dot)", " [ Dot ] ", "{dot}"):
            text = f"mail ann.lee{sign}host{dot}example now"
            missed += [text] if P._EMAIL.search(text) and not P.masked(text)[1] else []
    model = P.Model(frozenset(), frozenset(), frozenset())
    kinds = lambda text: {k for _, _, k in P.find(text, model)}
    for text in ("+49 171 1234567", "0171/1234567", "(0171)/1234 567", "0171.123.4567", "(555) 123-4567", "00 4917112345678"):
        missed += [text] if P._PHONE.search(f"call {text} now") and "phone" not in kinds(f"call {text} now") else []
    streets = [f"{n} {w} {b}" for n in ("12", "12b") for w in ("Elm", "Old Elm Tree") for b in P._BEHIND.replace("?", "").replace("\\", "").split("|")]
    streets += [f"{n} {f} de la Paix" for n in ("12", "12 bis,", "12bis", "12 ter", "12,") for f in P._FRENCH.replace("\\", "").split("|")]
    streets += [f"{b}{gap}{w}{n}" for b in re.sub(r"\(\?:[^)]*\)\?|[?\\]", "", P._BEFORE).split("|") for gap in ((" ", "") if b[-1] in "./" else (" ",)) for w in ("X", "Xora", "Xoralinda Verabondamente Grandiloquente Maravillosamente") for n in (" 5", ", 5", "\n5")]
    streets += [f"Linden{e}{n}" for e in ("str.", "straße", "strasse", "weg", "allee", "platz", "gasse") for n in ("5", " 5")]
    missed += [t for t in streets if P._ADDRESS.search(f"at {t} x") and "address" not in kinds(f"at {t} x")]
    assert not missed, missed[:20]


def test_every_space_is_a_plain_one():
    m = canonical.mapping()
    for ch in "        　":
        assert m.rewrite(f"two{ch}words") == ("two words", 1)


@pytest.mark.parametrize("text,want", [("ﬁne oﬀer", "fine offer"), ("🄱🄻🅄🄴", "BLUE"), ("🅒🅐🅢🅗", "CASH"), ("ᴘᴜꜱʜ", "push"), ("one⠀two", "one two"), ("≠", "≠"), ("#️⃣ 1️⃣", "#️⃣ 1️⃣"), ("exp​ιr‍ed", "expired")])
def test_further_styles_and_stretches(text, want):
    assert canonical.mapping().rewrite(text)[0] == want


def test_a_long_text_is_read_in_linear_time():
    import time

    m, took = canonical.mapping(), []
    for n in (20_000, 80_000):
        text = "".join(f"wοrd{i} é " for i in range(n))
        began = time.process_time()
        out, changes = m.rewrite(text)
        took.append(time.process_time() - began)
        assert changes == n and out.startswith("word0 é word1")
    assert took[1] < 12 * took[0]


def test_a_lexicon_too_large_to_send_gives_the_same(spark):
    first = ["Anna", "Pavel", "Maria"]
    last = ["Kowalska", "Novatrek", "Silvenar", "Brandolin", "Teravoss", "Miralund"]
    rows = []
    for i in range(120):
        f, s = first[i % 3], last[(i * 7) % 6] + "aeiou"[i % 5]
        rows.append((i, f"regards, {f} {s} of sales; passport 12{i:03d}{i:03d}9 seen", f"{f}.{s}@x.example".lower() if i % 2 else None))
    rows += [(900, "the passport 88811122 of anna", None), (901, None, None), (902, "", None), (903, "thanks, PAVEL NOVATREKA", None)] + [(1000 + i, "regards, Anna Kowalskaa of sales", None) for i in range(5)]
    df = spark.createDataFrame(rows, "id int, text string, hints string")
    small, large = personal.bootstrap(df), personal.bootstrap(df, lexicon=0)
    assert small.table is None and large.table is not None and {"anna", "pavel", "maria"} <= small.first and small.common == large.common
    view = lambda m: sorted((r.id, r.redacted, tuple(r.kinds)) for r in personal.redacted(df, m).collect())
    got = view(small)
    assert got == view(large)
    assert sum("name" in k for _, _, k in got) >= 120


def test_the_mix_does_not_depend_on_the_files(spark):
    random.seed(8)
    rows = [(i % 400, ("a", "b")[i % 2], random.randrange(5, 90), i % 7) for i in range(900)] + [(1, "a", 10, 3)] * 6
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 2), ("none", 0.1, 3), ("tiny", 0.0, None)], "source string, target_share double, max_repeats int")
    drawn = []
    for part, order in ((1, rows), (7, rows[::-1])):
        sizes = spark.createDataFrame(order, "doc_id bigint, source string, tokens bigint, content bigint").repartition(part)
        planned = mixing.plan(sizes, targets)
        mixed = mixing.mix(sizes, planned, block=40)
        drawn.append(Counter((r.doc_id, r.source, r.tokens, r.copies) for r in mixed.collect()))
        assert {r.source for r in mixing.short(mixing.report(planned, mixed)).collect()} == {"none"}
    assert drawn[0] == drawn[1]


def test_other_languages_in_cyrillic_letters_are_rejected():
    packed = language.Compressors(language.SEED)
    ours = ["Наша команда работает над новым решением, и никто не знает, почему клиенты не видят своих данных", "Мы вчера потеряли много денег, потому что сервер опять не отвечал"]
    others = ["Наша команда працює над новим рішенням і ніхто не знає чому клієнти не бачать своїх даних", "Нашият екип работи по ново решение и никой не знае защо клиентите не виждат своите данни", "Наш тим ради на новом решењу и нико не зна зашто клијенти не виде своје податке"]
    assert [k for k, _ in packed.classify(ours + others, language.MIN_MARGIN)] == ["ru", "ru", None, None, None]


def test_a_long_part_is_cut_in_about_linear_time():
    import time

    packed = language.Compressors(language.SEED)
    en, de = "the team has lost a lot of money because our server did not answer ", "das team hat viel geld verloren weil unser server nicht mehr antwortet "
    took = []
    for n in (200, 1600):
        began = time.process_time()
        got = packed.settle((en * n + de * n).strip(), language.MIN_MARGIN)
        took.append(time.process_time() - began)
        assert [g[2] for g in got] == ["en", "de"] and abs(got[0][1] - 14 * n) <= 8
    assert took[1] < 30 * took[0]


def test_prose_of_an_unknown_language_is_no_spam(spark):
    random.seed(14)
    prose = {"en": "the team has lost a lot of money because our server did not answer and nobody knows why".split(), "de": "das team hat viel geld verloren weil unser server nicht mehr antwortet und niemand kennt den grund".split()}
    rows = [(i, " ".join(random.choices(prose[k], k=60) + [f"Name{random.randrange(99)}" for _ in range(12)]), k) for i in range(200) for k in [("en", "de")[i % 2]]]
    it = "Ieri la squadra non è riuscita ad aprire la pagina e i clienti sono già molto stanchi. Quando siamo arrivati in ufficio nessuno sapeva perché il server aveva smesso di funzionare. Secondo loro la fattura resta la stessa anche se il servizio è peggiore, per cui da domani si cerca un altro fornitore che dia una mano."
    nl = "Sinds gisteren kan het team de pagina niet openen en de klanten zijn al erg moe. Toen we op kantoor kwamen wist niemand waarom de server niet meer werkte. Volgens hen blijft de rekening hetzelfde hoewel de dienst slechter is, en dus gaan we op zoek naar een ander bedrijf dat ons wil helpen met de data."
    rows += [(900 + i, " ".join(random.sample(t.split(" "), len(t.split(" ")))), k) for i in range(10) for t, k in [((it, "it"), (nl, None))[i % 2]]]
    rows += [(950, "cheap shoes online store " * 18, None), (951, " | ".join(f"Shoe{i} Basic {i * 7} USDT" for i in range(30)), "it")]
    got = {r.doc_id for r in stuffing.spam_pages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert got == {950, 951}
