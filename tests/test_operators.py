import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from siftline.functions.text import phrase_regex
from siftline.operators import entity, extract, gates, identity, reports, scoring

CONTACTS = "array<struct<type:string,value:string>>"


def test_gates_give_one_outcome(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["", "aa", "b" * 50, None, "a" * 50])], "id int, t string")
    chain = [gates.Gate("empty", F.col("t") == ""), gates.Gate("has_a", F.contains("t", F.lit("a")), "context", F.lit("a")), gates.Gate("short", F.length("t") < 10)]
    got = {r.id: (r.reject_reason, r.reject_detail, r.bucket) for r in gates.chain(df, chain).collect()}
    assert got == {0: ("empty", None, "dropped"), 1: ("has_a", "a", "context"), 2: (None, None, "accepted"), 3: (None, None, "accepted"), 4: ("has_a", "a", "context")}
    assert sum(r.n for r in gates.funnel(gates.chain(df, chain)).collect()) == 5
    assert gates.chain(df, []).where("bucket = 'accepted'").count() == 5


def brute_match(text, rules):
    import regex

    rest, hits = (text or "").lower(), []
    for r in rules:
        m = regex.search(regex.escape(r.phrase) if " " in r.phrase else phrase_regex(r.phrase).replace(r"\p{Nd}", r"\p{Nd}"), rest)
        if m:
            rest = rest[: m.start()] + "\x01" * len(r.phrase) + rest[m.end() :]
            hits.append((r.weight, r.phrase))
    return sorted(hits, key=lambda h: (-h[0], h[1]))


def test_greedy_matching(spark):
    rules = sorted([scoring.Rule(p, w) for p, w in (("a b", 5), ("a", 2), ("b", 2), ("b c d", 7), ("longword", 1), ("c-d", 4), ("вода", 3))], key=lambda r: (-len(r.phrase.encode()), -r.weight, r.phrase))
    texts = ["a b", "a b c d", "b a", "xa by", "longword a b b", "c-d c d", "вода водами a", "", None, "A B " * 500]
    random.seed(4)
    texts += [" ".join(random.choices(["a", "b", "c", "d", "c-d", "longword", "x"], k=12)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", scoring.matched(F.col("t"), rules).alias("h")).collect():
        assert [(h.weight, h.phrase) for h in r.h] == brute_match(texts[r.id], rules), texts[r.id]


@pytest.mark.parametrize("days,expected", [(2 / 24, 60), (3, 55), (20, 50), (60, 45), (200, 40)])
def test_decay(spark, days, expected):
    now = dt.datetime(2026, 5, 1)
    df = spark.createDataFrame([(50, now - dt.timedelta(days=days))], "s int, at timestamp")
    assert df.select(scoring.decay(F.col("s"), F.col("at"), F.lit(now))).first()[0] == expected


def test_decay_limits(spark):
    now = dt.datetime(2026, 5, 1)
    df = spark.createDataFrame([(3, dt.datetime(2025, 1, 1)), (50, None)], "s int, at timestamp")
    assert [r[0] for r in df.select(scoring.decay(F.col("s"), F.col("at"), F.lit(now))).collect()] == [0, 50]


def test_contact_hash_ignores_order(spark):
    a = [("email", "A@x.example"), ("site", "b.example")]
    df = spark.createDataFrame([(a,), (a[::-1],), ([],), (None,), ([("email", None)],)], f"c {CONTACTS}")
    h = [r[0] for r in df.select(identity.contact_hash(F.col("c"))).collect()]
    assert h[0] == h[1] and len(h[0]) == 32 and h[2:] == [None, None, None]


def test_seen_set(spark):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(i, k, t0 + dt.timedelta(hours=h)) for i, (k, h) in enumerate([("a", 0), ("a", 23), ("a", 25), ("a", 48), ("a", 49), ("b", 1), (None, 0), (None, 0), ("b", 1)])]
    df = spark.createDataFrame(rows, "id bigint, k string, at timestamp")
    assert {r.id for r in identity.seen_first(df, "k", "at", "id", 86400).collect()} == {0, 2, 4, 5, 6, 7}
    assert identity.seen_first(df.limit(0), "k", "at", "id", 86400).count() == 0


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(identity.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components(spark):
    random.seed(9)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)] + [(7, 7)]
    df = spark.createDataFrame(edges + [(None, 1)], "a bigint, b bigint")
    assert {r.node: r.component for r in entity.components(df).collect()} == union_find(edges)


def brute_replay(sightings):
    owner, names, out = {}, [], {}
    for seq, keys in sorted(sightings):
        known = [owner[k] for k in keys if k in owner]
        e = min(known) if known else len(names)
        if not known:
            names.append(keys[0] if keys else f"seq:{seq}")
        for k in keys:
            owner.setdefault(k, e)
        out[seq] = names[e]
    return out


def test_replay_equals_one_after_another(spark):
    import hashlib

    random.seed(3)
    rows = [(i, [f"k{random.randrange(25)}" for _ in range(random.randrange(0, 3))]) for i in range(60)]
    rows = [(i, list(dict.fromkeys(k))) for i, k in rows]
    got = {r.seq: r.entity for r in entity.replay(spark.createDataFrame(rows, "seq bigint, keys array<string>")).collect()}
    assert got == {s: hashlib.sha256(n.encode()).hexdigest()[:32] for s, n in brute_replay(rows).items()}


def test_heat_of_fresh_and_stale(spark):
    now = dt.datetime(2026, 5, 1)
    rows = [("e", "h1", "forum", 50, True, now - dt.timedelta(days=1), now), ("e", "h2", "telegram", 40, False, None, now - dt.timedelta(days=2)), ("f", "h3", "forum", 50, True, now - dt.timedelta(days=200), now)]
    df = spark.createDataFrame(rows, "entity string, hash_id string, family string, score int, matched boolean, posted_at timestamp, seen_at timestamp")
    got = {r.entity: r for r in entity.heat(df, F.lit(now)).collect()}
    assert (got["e"].heat, got["e"].tier, got["e"].canonical) == (pytest.approx((50 + 20) * 1.3), "blazing", "h1")
    assert (got["f"].heat, got["f"].tier, got["f"].canonical) == (pytest.approx(5.0), "cold", None)


def test_upsert_is_idempotent(spark):
    df = spark.createDataFrame([("a", 1, "new", 5), ("a", 2, "won", 6), ("b", 1, None, None)], "k string, ts int, status string, score int")
    one = reports.upserted(df, "k", "ts", ["status"])
    assert {(r.k, r.score, r.status, r.versions) for r in one.collect()} == {("a", 6, "new", 2), ("b", None, None, 1)}
    again = reports.upserted(one.drop("versions").select(df.columns), "k", "ts", ["status"])
    assert {tuple(r)[:4] for r in again.select("k", "score", "status").collect()} == {tuple(r) for r in one.select("k", "score", "status").collect()}


def test_pages_cover_everything_once(spark):
    rows = [(f"h{i:03d}", i % 7) for i in range(53)]
    df = spark.createDataFrame(rows, "k string, s int")
    seen, after = [], None
    for _ in range(20):
        p = reports.page(df, "s", "k", 10, after).orderBy("place").collect()
        seen += [(r.s, r.k) for r in p]
        if not p or not p[0].has_more:
            break
        after = (p[-1].s, p[-1].k)
    assert seen == sorted(((s, k) for k, s in rows), key=lambda x: (-x[0], x[1]))


def test_patch_leaves_what_is_empty(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, s string, n int")
    patch = spark.createDataFrame([("a", "", 9), ("b", "z", 0)], "k string, s string, n int")
    assert {tuple(r) for r in reports.patched(base, patch, "k", ["s", "n"]).select("k", "s", "n").collect()} == {("a", "x", 9), ("b", "z", 2)}


def test_best_linked(spark):
    e = spark.createDataFrame([("e1", ["h1", "h2"]), ("e2", [])], "entity string, hashes array<string>")
    leads = spark.createDataFrame([("h1", None, 5), ("h2", "e1", 3), ("h3", "e1", 9), ("h4", "e9", 1)], "hash_id string, entity string, score int")
    assert [tuple(r) for r in reports.best_linked(e, leads).collect()] == [("e1", "h3", 9, 3)]


def test_extraction(spark):
    t = "mail Ann.Lee@Host.example, @some_handle or https://t.me/other_one; see https://www.site.example/a?b. and x@y"
    r = spark.createDataFrame([(t,)], "t string").select(extract.emails("t").alias("e"), extract.handles(F.col("t")).alias("h"), extract.web_domains(F.col("t")).alias("d")).first()
    assert r.e == ["ann.lee@host.example"] and set(r.h) == {"some_handle", "other_one"} and set(r.d) == {"t.me", "site.example"}
    n = spark.createDataFrame([(None,)], "t string").select(extract.contacts(F.col("t")).alias("c"), extract.links(F.col("t")).alias("l")).first()
    assert n.c in ([], None) and n.l == []


def test_pages_and_lines(spark):
    html = '<title>A &amp; B</title><meta name="description" content="d e"><a href="/x">1</a><a href="/x">2</a><div class="username">ann</div><div class="postbody">hi <b>you</b></div>'
    r = spark.createDataFrame([(html,)], "h string").select(extract.page_title(F.col("h")).alias("t"), extract.page_text(F.col("h")).alias("p"), extract.links(F.col("h")).alias("l"), extract.forum_posts(F.col("h")).alias("f")).first()
    assert r.t == "A & B" and tuple(r.p) == ("d e", "meta") and r.l == ["/x"] and [tuple(x) for x in r.f] == [("ann", "hi you")]
    body = "# c\na.example, 12, direct, f00 # x\nbad line\nB.example,3,RESELLER\nCONTACT=ads@a.example\n"
    r = spark.createDataFrame([(body,)], "b string").select(extract.seller_lines(F.col("b")).alias("s"), extract.file_contact(F.col("b")).alias("c")).first()
    assert [tuple(x) for x in r.s] == [("a.example", "12", "DIRECT", "f00"), ("b.example", "3", "RESELLER", None)] and r.c == "ads@a.example"


def test_json_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": [{"c": "y"}, 3, "z"], "d": null}'), (2, "no json"), (3, None), (4, '"top"')], "id int, j string")
    assert sorted(tuple(r) for r in extract.json_leaves(df, "j", "id").collect()) == [(1, "x"), (1, "y"), (1, "z"), (4, "top")]


def test_merge_of_contacts_keeps_order(spark):
    a, b = [("email", "A@x"), ("site", "s")], [("email", "a@X"), ("site", "t")]
    r = spark.createDataFrame([(a, b), (None, b)], f"a {CONTACTS}, b {CONTACTS}").select(extract.merged(F.col("a"), F.col("b")).alias("m")).collect()
    assert [x.value for x in r[0].m] == ["A@x", "s", "t"] and [x.value for x in r[1].m] == ["a@X", "t"]


def test_identity_keys(spark):
    c = [("telegram", "https://t.me/Ann_1/"), ("email", " A@H.example"), ("site", "https://www.h.example/x"), ("site", None), ("other", "x")]
    df = spark.createDataFrame([(c, "Acme, Ltd. | x"), (None, None)], f"c {CONTACTS}, n string")
    got = [r[0] for r in df.select(entity.keys(F.col("c"), F.col("n"))).collect()]
    assert got == [["domain:h.example", "email:a@h.example", "telegram:ann_1", "company:acme"], []]


def test_link_suggestions(spark):
    held = [("a", "k1", "x"), ("b", "k1", "y"), ("c", "k1", "x"), ("d", "k2", "x"), ("e", "k3", None), ("f", "k3", None), ("a", "k4", "x"), ("b", "k4", "y")]
    got = {tuple(r) for r in entity.link_suggestions(spark.createDataFrame(held, "entity string, key string, label string")).collect()}
    brute = {}
    for (e1, k1, l1), (e2, k2, l2) in itertools.product(held, held):
        if k1 == k2 and e1 < e2 and l1 != l2:
            brute.setdefault((e1, e2), set()).add(k1)
    assert got == {(a, b, len(k)) for (a, b), k in brute.items()}


def test_link_suggestions_of_a_hot_key(spark):
    random.seed(5)
    held = [(i, "hot", random.choice(["x", "y", None])) for i in range(90)] + [(i, f"k{i % 7}", random.choice("xy")) for i in range(60)] + [(3, "hot", "z")]
    brute = {}
    for (e1, k1, l1), (e2, k2, l2) in itertools.product(held, held):
        if k1 == k2 and e1 < e2 and l1 != l2:
            brute.setdefault((e1, e2), set()).add(k1)
    df = spark.createDataFrame(held, "entity bigint, key string, label string")
    for block in (1, 8, 1_000):
        got = [tuple(r) for r in entity.link_suggestions(df, block=block).collect()]
        assert sorted(got) == sorted((a, b, len(k)) for (a, b), k in brute.items())


def test_link_suggestions_all_takes_every_chat(spark, tmp_path):
    from siftline.plans import reports as plans

    rows = [(1, "tracker_ops_hub", "yes"), (2, "tracker_ops_hub", "no"), (3, "deals", "yes"), (4, "deals", "no"), (None, "deals", "no"), (5, None, "yes")]
    spark.createDataFrame(rows, "user_id bigint, source_chat string, outreach_fit string").write.parquet(f"{tmp_path}/telegram_person_doc.parquet")
    assert {tuple(r) for r in plans.link_suggestions_all(spark, str(tmp_path)).collect()} == {(1, 2, 1), (3, 4, 1)}
    assert {tuple(r) for r in plans.link_suggestions(spark, str(tmp_path)).collect()} == {(1, "tracker_ops_hub", "yes", 1), (2, "tracker_ops_hub", "no", 1), (3, "deals", "yes", 1), (4, "deals", "no", 1)}


def test_link_classes_count_the_links(spark):
    random.seed(6)
    held = [(i, "hot", random.choice(["x", "y", None, ""])) for i in range(90)] + [(i, f"k{i % 7}", random.choice("xy")) for i in range(60)] + [(3, "hot", "z"), (7, "alone", "x"), (8, "same", None), (9, "same", None)]
    rows = set(held)
    want = {(e, k, x): sum(k == k2 and x != x2 for _, k2, x2 in rows) for e, k, x in rows}
    got = {(r.entity, r.key, r.label): r.links for r in entity.link_classes(spark.createDataFrame(held * 2, "entity bigint, key string, label string")).collect()}
    assert got == {k: n for k, n in want.items() if n}


def test_replay_goes_by_arrival_not_by_seq(spark):
    import hashlib

    random.seed(4)
    rows = [(i, [f"k{random.randrange(25)}" for _ in range(random.randrange(0, 3))]) for i in range(60)]
    rows = [(i, list(dict.fromkeys(k))) for i, k in rows]
    seq = random.sample(range(1_000), 60)
    now = dt.datetime(2026, 5, 1)
    df = spark.createDataFrame([(seq[i], now + dt.timedelta(hours=i // 2), f"h{i:02}", k) for i, k in rows], "seq bigint, ts timestamp, hash_id string, keys array<string>")
    got = {r.seq: r.entity for r in entity.replay(df, ("ts", "hash_id")).collect()}
    # a lead without keys is named by its seq
    names = {i: f"seq:{seq[i]}" if n == f"seq:{i}" else n for i, n in brute_replay(rows).items()}
    assert got == {seq[i]: hashlib.sha256(n.encode()).hexdigest()[:32] for i, n in names.items()}


def test_entity_replay_of_leads_by_time(spark, tmp_path):
    import hashlib

    from siftline.plans import reports as plans

    # the lead in the middle has keys of both others and joins the one that came first, whatever the hashes
    leads = [f"lead{i}" for i in range(12)]
    rows = []
    for g in range(0, 12, 3):
        for k, (hour, contacts) in enumerate([(5, [("email", f"a{g}@x.example")]), (1, [("telegram", f"b{g}")]), (9, [("email", f"a{g}@x.example"), ("telegram", f"b{g}")])]):
            rows.append((leads[g + k], dt.datetime(2026, 5, 1, hour), contacts, None))
    spark.createDataFrame(rows, f"hash_id string, ts timestamp_ntz, contacts {CONTACTS}, company_name string").write.parquet(f"{tmp_path}/lead_doc.parquet")
    name = {r.seq: r.hash_id for r in plans.sightings(spark, str(tmp_path)).select("seq", "hash_id").collect()}
    got = {name[r.seq]: r.entity for r in plans.entity_replay(spark, str(tmp_path)).collect()}
    idof = lambda k: hashlib.sha256(k.encode()).hexdigest()[:32]
    want = {}
    for g in range(0, 12, 3):
        want |= {leads[g]: idof(f"email:a{g}@x.example"), leads[g + 1]: idof(f"telegram:b{g}"), leads[g + 2]: idof(f"telegram:b{g}")}
    assert got == want


def test_json_leaves_of_a_deep_document(spark):
    deep = lambda n: '{"a": [' * (n // 2) + f'"at {n}"' + "]}" * (n // 2)
    rows = [(n, deep(n)) for n in (2, 10, 12, 14, 22, 24, 26, 40)] + [(1, '{"a": ["x", {"b": [[[[[[[[[[[["deep", null, 3, ""]]]]]]]]]]]]}]}')]
    df = spark.createDataFrame(rows, "id int, j string")
    want = [(n, f"at {n}") for n, _ in rows[:-1]] + [(1, "x"), (1, "deep"), (1, "")]
    assert sorted(tuple(r) for r in extract.json_leaves(df, "j", "id").collect()) == sorted(want)


def test_scoring_in_one_pass_equals_the_fold(spark):
    from siftline.operators import scoring

    random.seed(12)
    words = ["bid", "bid floor", "floor", "old bid floor", "c++", "трекер", "keitaro", "a.b", "floor price", "price_x", "ст"]
    ordered = sorted((scoring.Rule(w, 3 + i) for i, w in enumerate(words)), key=lambda r: (-len(r.phrase.encode()), -r.weight, r.phrase))
    texts = [None, "", "bid bid floor floor", "xbid floorx", "OLD BID FLOOR bid", "c++ c++x трекеры трекер", "a.b,a.b price_x floor price"]
    texts += ["".join(random.choices(["bid", "floor", " ", " ", "old ", ",", "_", "9", "c++", "трекер", "ст", "price"], k=12)) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    one = scoring.matched_in_one_pass(ordered)(F.col("t")).alias("h")
    got = {r.i: [tuple(h) for h in r.h] for r in df.select("i", one).collect()}
    assert got == {r.i: [tuple(h) for h in r.h] for r in df.select("i", scoring.matched(F.col("t"), ordered).alias("h")).collect()}
    assert scoring.matched_in_one_pass([])(F.col("t")) is not None and df.select(scoring.matched_in_one_pass([])(F.col("t")).alias("h")).first().h == []


def test_nodes_and_splits(spark):
    rows = [("a", "a", ["k1", "k2"], 5, "x", 1), ("b", "a", ["k2"], 9, "y", 2), ("c", "a", [], 9, "x", 3), ("d", "d", None, None, None, None)]
    df = spark.createDataFrame(rows, "hash_id string, component string, keys array<string>, score int, family string, seen int")
    got = {r.entity: r for r in entity.nodes(df).collect()}
    assert (got["a"].aliases, got["a"].sightings, got["a"].families, got["a"].first_seen, got["a"].last_seen, got["a"].best_score, got["a"].canonical) == (2, 3, 2, 1, 3, 9, "c")
    assert got["d"].aliases == 0 and got["d"].families == 0
    left = {r.entity: r for r in entity.split(df, spark.createDataFrame([("b",), ("d",)], "hash_id string")).collect()}
    assert set(left) == {"a"} and (left["a"].aliases, left["a"].sightings, left["a"].canonical) == (2, 2, "c")
    assert entity.nodes(df.limit(0)).count() == 0


def test_seen_first_over_gaps_and_hot_keys(spark):
    from siftline.operators import identity

    random.seed(9)
    rows = [(i, random.choice(["hot", "hot", "a", "b", None]), random.randrange(0, 4000)) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, k string, s int").withColumn("at", F.timestamp_seconds("s"))
    last, want = {}, set()
    for i, k, s in sorted(rows, key=lambda r: (r[2], r[0])):
        if k is None or k not in last or s - last[k] >= 60:
            last[k] = s
            want.add(i)
    got = [r.id for r in identity.seen_first(df, "k", "at", "id", 60).collect()]
    assert set(got) == want and len(got) == len(want)


def test_near_recent_edge_cases(spark):
    from siftline.operators import identity

    rows = [("a", [1.0, 0.0]), ("b", [2.0, 0.1]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", []), ("g", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "key string, vector array<double>")
    recent = df.withColumn("rank", F.expr("ascii(key) - 96"))
    assert {(r.key, r.near_key) for r in identity.near_recent(df, recent, 0.9, 7).collect()} == {("a", "b"), ("b", "a")}
    assert identity.near_recent(df, recent.limit(0), 0.9, 7).count() == 0
    best = {(r.key, r.anchor_set): round(r.similarity, 3) for r in identity.max_similarity(df, df.where("key in ('a', 'e')").withColumnRenamed("key", "anchor_set")).collect()}
    assert best[("g", "a")] == -1.0 and best[("e", "e")] == 1.0 and best[("e", "a")] == 0.0 and best[("d", "a")] == 0.0 and len(best) == 14
    assert identity.max_similarity(df, df.limit(0).withColumnRenamed("key", "anchor_set")).count() == 0
