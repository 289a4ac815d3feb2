import random

from siftline.llm import linkage

CONTACTS = "array<struct<type:string,value:string>>"


def edits(word, rng):
    i = rng.randrange(1, len(word) - 1)
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice("abcdefgh") + word[i:], word[:i] + word[i + 1] + word[i] + word[i + 2 :] if i + 1 < len(word) else word, word[:i] + "z" + word[i + 1 :]])


def sides(spark, left, right, field="word"):
    rows = [(field, v, True, False, False) for v in left] + [(field, v, False, True, False) for v in right]
    return spark.createDataFrame(rows, "field string, value string, left boolean, right boolean, firm boolean")


def test_close_values_are_found_exactly(spark):
    rng = random.Random(7)
    left = ["".join(rng.choices("abcdefghiklmnoprst", k=rng.randrange(6, 13))) for _ in range(150)]
    right = left[:40] + [edits(w, rng) for w in left[40:120]] + ["".join(rng.choices("abcdefghiklmnoprst", k=9)) for _ in range(60)]
    short = ["".join(rng.choices("abc", k=k)) for k in (1, 2, 3, 4, 5, 6, 7) for _ in range(12)]  # vectors with fewer bits than a key takes
    left, right = left + short[::2] + [None, ""], right + short[1::2] + short[:9] + [None, ""]
    vectors = {r.value: set(r.bits) for r in linkage.encoded(sides(spark, left, right)).collect()}
    want = set()
    for x in set(left) - {None, ""}:
        for y in set(right) - {None, ""}:
            p, q = vectors[x], vectors[y]
            near = len(p - q) <= linkage.MISSES and len(q - p) <= linkage.MISSES and len(p ^ q) <= linkage.RADIUS
            if x == y or near and 2 * len(p & q) >= linkage.DICE * (len(p) + len(q)):
                want.add((x, y))
    got = [(r.value_a, r.value_b) for r in linkage.close_values(sides(spark, left, right)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_fields_do_not_meet(spark):
    a = sides(spark, ["kowalska"], [], "username").unionByName(sides(spark, [], ["kowalska"], "word"))
    assert linkage.close_values(a).count() == 0 and linkage.close_values(a.limit(0)).count() == 0


def test_one_edit_is_within_the_radius(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghiklmnoprst", k=11)) for _ in range(60)]
    pairs = [(w, edits(w, rng)) for w in words]
    found = {(r.value_a, r.value_b) for r in linkage.close_values(sides(spark, [x for x, _ in pairs], [y for _, y in pairs])).collect()}
    assert sum(p in found for p in pairs) >= 58  # two bits may fall together by chance


def test_user_names_that_differ_in_their_number(spark):
    persons = spark.createDataFrame([(1, "foxfayost97", "Irene Lemjasmann"), (2, "foxfayost97", "Otto Brandvik, at Velquora Ads"), (3, "foxfayost97", "someone else"), (4, "fox97", "Irene Lemjasmann")], "id bigint, username string, bio string")
    leads = spark.createDataFrame([("name", [("telegram", "@foxfayost3004")], "Irene Lemjasmann", None), ("company", [("telegram", "@foxfayost11")], None, "Velquora Ads"), ("neither", [("telegram", "@foxfayost5")], None, None)], f"id string, contacts {CONTACTS}, display string, company string")
    got = {(r.person, r.lead): r.fields for r in linkage.matches(persons, leads).collect()}
    assert got == {(1, "name"): ["name", "username"], (2, "company"): ["company", "username"]}


def test_evidence(spark):
    persons = spark.createDataFrame(
        [
            (1, "Ann_Lee1", "Ann Leestrom | media buyer | at Quorimax Media"), (2, "zed99", "Bob Marlington / co-founder Tavorello Ads"), (3, None, "carl.oberholz [at] vexanto [dot] example"), (4, "", None), (5, "lonelyfox", "Dora Hallgrimson, freelance"), (1, "ann_lee1", "older row"),
        ],
        "id bigint, username string, bio string",
    )
    leads = spark.createDataFrame(
        [
            ("same_handle", [("telegram", "https://t.me/ANN_LEE1/")], None, None), ("name_and_company", [], "Marlingotn Bob", "Tavorelo Ads LLC"), ("same_mail", [("email", "CARL.OBERHOLZ@VEXANTO.EXAMPLE")], None, None), ("name_only", None, "Dora Hallgrimson", None), ("company_only", [], "Eve Someone", "Quorimax Media"),
            ("near_handle_only", [("telegram", "@lonelyfoxx")], None, None), ("near_handle_and_name", [("telegram", "@lonelyfoxx")], "D. Hallgrimson", None), ("cyrillic", [], "Анн Леестром", "Quorimax"), ("nothing", None, None, None),
        ],
        f"id string, contacts {CONTACTS}, display string, company string",
    )
    got = {(r.person, r.lead): r for r in linkage.matches(persons, leads).collect()}
    assert set(got) == {(1, "same_handle"), (2, "name_and_company"), (3, "same_mail"), (5, "near_handle_and_name"), (1, "cyrillic")}
    assert all(0 <= r.confidence <= 1 for r in got.values()) and got[(1, "same_handle")].confidence >= 0.95
    assert linkage.matches(persons.limit(0), leads).count() == 0


def test_company_edited_on_both_sides(spark):
    firms = [("Britavoorent", "Britvaorent"), ("Takinedeli", "Takintedli"), ("Kancoamyx", "Kanoccamyx"), ("Rkiadorund", "Rikadrund"), ("Lemjaspularo", "Lejaspluaro"), ("Plutronevroa", "Plutrnoevora")]
    apart = [("Brijaslei", "Brijasaro"), ("Tedshagriova", "Tedbriova"), ("Solo", "Sloo ads")]
    names = ["Petra Kadorvelski", "Mira Vordriens", "Hanna Wendalvelens", "Viktor Kinstoko", "Olga Brenkhauser", "Tomas Ulrichsen", "Irina Zapolsdorf", "Pavel Gormundsen", "Jonas Feldkirchner"]
    persons = spark.createDataFrame([(i, None, f"{n} / buyer at {f[0]}") for i, (n, f) in enumerate(zip(names, firms + apart))], "id bigint, username string, bio string")
    leads = spark.createDataFrame([(f"lead{i}", [], n, f[1]) for i, (n, f) in enumerate(zip(names, firms + apart))], f"id string, contacts {CONTACTS}, display string, company string")
    got = {(r.person, r.lead): r.fields for r in linkage.matches(persons, leads).collect()}
    assert got == {(i, f"lead{i}"): ["company", "name"] for i in range(len(firms))}
