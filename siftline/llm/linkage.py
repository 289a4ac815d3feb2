"""Matching entities across sources without keys.

Attributes of both sides are brought to one spelling and their bigrams encoded as fixed bit
vectors of 512 bits. Two vectors are close if either has at most ``MISSES`` set bits that the
other lacks. Such pairs are found exactly by multi-index hashing over set bits: of the
``MISSES`` + ``SHARED`` rarest bits of either vector ``SHARED`` at least are set in both, so every
choice of so many of them is a key. Every distinct value of an attribute is indexed once, however many records
hold it, and all attributes share one index.
Close pairs are scored by the Dice coefficient of their vectors, and the fields of a pair of
records are weighed into one score, which a logistic curve, fitted on a bounded sample of pairs
that share a user name or address exactly, turns into a confidence.

A pair is a match if user name or e-mail are the same, or if at least two of user name, name,
company and e-mail agree, each within ``RADIUS`` bits; a company also if it is one edit away on either side,
a user name also if it is the same but for the number at its end. Defined cases: null and empty attributes agree with nothing; records that occur twice
under a key count once with all their attributes; an attribute shared by many records matches
all of them, none is cut off.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache, reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm.addresses import emails
from siftline.session import small_enough, stored

#: Bits of the vector.
BITS = 512
#: Set bits that either of two close vectors may have alone. An edit changes two at most on
#: either side, since the letters of a bigram are unordered.
MISSES = 2
#: Set bits that make a key; more make it rarer, and the keys of a vector more.
SHARED = 3
#: Bits that may differ between agreeing values of any length: one change, loss, gain or swap.
RADIUS = 4
#: Least Dice coefficient of agreeing values.
DICE = 0.68
#: Dice that counts for user names that differ in their number only.
NUMBERED = 0.8
#: Weights of the fields in the score.
WEIGHTS = {"username": 1.0, "email": 1.2, "name": 0.9, "company": 0.7}
#: Pairs that the confidence curve is fitted on, at most.
FIT_PAIRS = 4_000

# Cyrillic letters and their Latin spelling.
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
LATIN = ["a", "b", "v", "g", "d", "e", "e", "j", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "ch", "sh", "sch", "", "y", "", "e", "yu", "ya"]
# Words of company names that tell nothing.
GENERIC = ("llc", "ltd", "gmbh", "inc", "sro", "srl", "ag", "sa", "co", "ads", "media", "labs", "group", "partners", "traffic", "digital", "performance", "agency")


def folded(text: Column) -> Column:
    """Lower case Latin, letters that transliteration confuses made one."""
    out = F.lower(text)
    single = {c: x for c, x in zip(CYRILLIC, LATIN) if len(x) == 1}
    for c, x in zip(CYRILLIC, LATIN):
        if len(x) != 1:
            out = F.replace(out, F.lit(c), F.lit(x))
    return F.translate(F.translate(out, "".join(single), "".join(single.values())), "qxyw", "kkiv")


def handle(value: Column) -> Column:
    """One spelling of a user name or link to it; null where nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"^telegram:\s*", ""), r"^(?:https?://)?(?:www\.)?(?:t\.me/|telegram\.me/)?@?|/+$", "")
    return F.nullif(F.trim(bare), F.lit(""))


def bare(value: Column) -> Column:
    """Letters and digits of a user name or address, without a leading article."""
    return F.regexp_replace(F.regexp_replace(value, r"^the_", ""), r"[^a-z0-9]", "")


def tokens(text: Column) -> Column:
    """Runs of letters, folded, in order."""
    return F.regexp_extract_all(folded(text), F.lit(r"(\p{L}+)"), F.lit(1))


def stem(value: Column) -> Column:
    """A user name without the number at its end; null where fewer than five letters are left."""
    out = F.regexp_replace(value, r"[0-9]+$", "")
    return F.when(F.length(out) >= 5, out)


_VECTOR = T.StructType([T.StructField("bits", T.ArrayType(T.IntegerType())), T.StructField("fold", T.LongType())])


def bigrams(value: str) -> frozenset[str]:
    """Bigrams of a value between its ends, each taken without order."""
    padded = f"^{value}$"
    return frozenset(x + y if x < y else y + x for x, y in zip(padded, padded[1:]))


@F.arrow_udf(_VECTOR)
def vector(values: pa.Array) -> pa.Array:
    """The set bits of the vectors of values, and the vectors folded to 64 bits by parity."""
    place: dict[str, int] = {}
    bits, folds = [], []
    for value in values.to_pylist():
        own, fold = set(), 0
        for b in bigrams(value):
            at = place.get(b)
            if at is None:
                at = place[b] = zlib.crc32(b.encode()) % BITS
            own.add(at)
        for at in own:
            fold ^= 1 << (at & 63)
        bits.append(list(own))
        folds.append(fold - (1 << 64) if fold >> 63 else fold)
    return pa.StructArray.from_arrays([pa.array(bits, pa.list_(pa.int32())), pa.array(folds, pa.int64())], ["bits", "fold"])


def encoded(values: DataFrame) -> DataFrame:
    """id, field, value, flags, set bits, their numbers with the rarest first, and a folded vector.

    values: field, value, left, right and firm, rows may repeat. Bits are numbered by how many values
    have them, a table of ``BITS`` rows; the numbering has no influence on the result.
    """
    rows = values.where("value is not null and value <> ''").groupBy("field", "value").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("firm").alias("firm"))
    v = stored(rows.withColumn("v", vector("value")).select(F.xxhash64("field", "value").alias("id"), "field", "value", "left", "right", "firm", "v.bits", "v.fold"), "values")
    held = {r["bit"]: r["n"] for r in v.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("n")).collect()}  # BITS rows at most
    order = sorted(range(BITS), key=lambda b: (held.get(b, 0), b))
    number = [0] * BITS
    for n, b in enumerate(order):
        number[b] = n
    table = F.array(*[F.lit(n) for n in number])
    ranked = F.array_sort(F.transform("bits", lambda b: F.get(table, b)))
    return v.withColumn("rare", ranked)


def _keys(v: DataFrame, side: str) -> DataFrame:
    """One row for every choice of the rarest bits of a vector: narrow, as these rows are many.

    A vector with fewer bits than that takes has its single bits as keys, and so has every
    vector that can be close to such a one; close vectors that agree share one at least.
    """
    least = MISSES + SHARED
    choices = F.array(*[F.xxhash64("field", *[F.get("rare", F.lit(i)) for i in c]) for c in combinations(range(least), SHARED)])
    single = F.transform("rare", lambda b: F.xxhash64("field", b))
    n = F.size("rare")
    keys = F.when(n >= least + MISSES, choices).when(n >= least, F.concat(choices, single)).otherwise(single)
    return v.select(F.explode(keys).alias("key"), F.col("id").alias(f"id_{side}"), F.col("fold").alias(f"fold_{side}"))


def close_values(values: DataFrame) -> DataFrame:
    """field, value_a, value_b, firm and dice of all agreeing pairs of a left and a right value.

    Every close pair shares a key; folded vectors differ in no more bits than the whole ones.
    """
    v = encoded(values)
    met = _keys(v.where("left"), "a").join(_keys(v.where("right"), "b"), "key").where((F.bit_count(F.col("fold_a").bitwiseXOR(F.col("fold_b"))) <= RADIUS) & (F.col("id_a") != F.col("id_b"))).select("id_a", "id_b").distinct()
    a = v.select(F.col("id").alias("id_a"), "field", F.col("value").alias("value_a"), F.col("bits").alias("x"))
    b = v.select(F.col("id").alias("id_b"), F.col("value").alias("value_b"), "firm", F.col("bits").alias("y"))
    both, n, m = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    seen = met.join(a, "id_a").join(b, "id_b").withColumn("both", both).where((n - F.col("both") <= MISSES) & (m - F.col("both") <= MISSES))
    dice = 2 * F.col("both") / (n + m)
    near = (n + m - 2 * F.col("both") <= RADIUS) & (dice >= DICE)
    same = v.where("left and right").select("field", F.col("value").alias("value_a"), F.col("value").alias("value_b"), "firm", F.lit(1.0).alias("dice"))
    return seen.where(near).select("field", "value_a", "value_b", "firm", dice.alias("dice")).unionByName(same)


def edits(a: str, b: str) -> int:
    """Changes, losses, gains and swaps of neighbours between two words."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                cost = min(cost, above[j - 2] + 1)
            row.append(cost)
    return row[-1]


@lru_cache(1 << 17)
def _bigrams(word: str) -> frozenset[str]:
    return bigrams(word)


def same_firm(firm: str, word: str) -> float:
    """Dice of the bigrams where a word is a company: within the radius, or two edits away from seven letters on; else 0.

    An edit on either side changes four bigrams at most; shorter words are too alike for two.
    """
    p, q = _bigrams(firm), _bigrams(word)
    both, total = len(p & q), len(p) + len(q)
    dice = 2 * both / total
    if total - 2 * both <= RADIUS and dice >= DICE:
        return dice
    if total - 2 * both > 4 * MISSES or min(len(firm), len(word)) < 7 or edits(firm, word) > 2:
        return 0.0
    return max(dice, 0.5)


@F.arrow_udf(T.DoubleType())
def firm_dice(firms: pa.Array, words: pa.Array) -> pa.Array:
    """The highest Dice of a company of the lead and a word of the bio that agree, null if none do."""
    out = []
    for f, t in zip(firms.to_pylist(), words.to_pylist()):
        best = 0.0
        for firm in f or ():
            for word in set(t or ()):
                if len(word) >= 3 and abs(len(word) - len(firm)) <= RADIUS:
                    best = max(best, same_firm(firm, word))
        out.append(best or None)
    return pa.array(out, pa.float64())


def people(persons: DataFrame) -> DataFrame:
    """Stored person, handle, addresses, words of the bio and stem of the handle, in one pass; persons: id, username, bio."""
    # what follows an address or link is no name
    prose = F.regexp_replace(F.regexp_replace("bio", r"\S*(?:@|://)\S+|\S+\s*[(\[]\s*at\s*[)\]]\s*\S+", " "), r"[_\d]+", " ")
    out = persons.select(F.col("id").alias("person"), handle(F.col("username")).alias("handle"), emails(F.col("bio")).alias("mails"), tokens(prose).alias("t"))
    return stored(out.withColumn("stem", stem(bare(F.col("handle")))), "people")


def authors(leads: DataFrame) -> DataFrame:
    """Stored lead, handles, addresses, words of the name, companies and stems of the handles, in one pass; leads: id, contacts, display, company."""

    def said(kind: str) -> Column:
        return F.transform(F.filter("contacts", lambda c: (F.lower(c["type"]) == kind) & c["value"].isNotNull()), lambda c: c["value"])

    parts = F.split("display", r"\|")
    own = F.filter(tokens(F.regexp_replace(parts[0], r"[_\d]+", " ")), lambda t: ~t.isin("the"))
    generic = [g.translate(str.maketrans("qxyw", "kkiv")) for g in GENERIC]

    def core(text: Column) -> Column:
        own_words = F.filter(tokens(F.replace(text, F.lit("."), F.lit(""))), lambda t: ~t.isin(*generic))
        # the first word of four letters or more, else the longest there is
        return F.coalesce(F.try_element_at(F.filter(own_words, lambda t: F.length(t) >= 4), F.lit(1)), F.try_element_at(F.filter(own_words, lambda t: F.length(t) >= 3), F.lit(1)))

    out = leads.select(
            F.col("id").alias("lead"),
            F.filter(F.transform(said("telegram"), handle), lambda v: v.isNotNull()).alias("handles"),
            F.flatten(F.transform(said("email"), emails)).alias("mails"),
            own.alias("t"),
            F.array_compact(F.array(core(F.col("company")), core(F.try_element_at(parts, F.lit(2))))).alias("firms"),
        )
    return stored(out.withColumn("stems", F.array_compact(F.transform("handles", lambda h: stem(bare(h))))), "authors")


def surnames(names: DataFrame) -> DataFrame:
    """lead, value_b and rest: of every name the word that the fewest names have, then the longest, and its other words.

    First names are shared by many; sought by them, a name would meet all their bearers.
    """
    most = F.lit(1023)
    every = names.where(F.size("t") >= 2).select("lead", "t", F.posexplode("t").alias("at", "value")).where(F.length("value") >= 2)
    common = every.groupBy("value").agg(F.count("*").alias("bearers"))
    if small_enough(common.count(), 64):
        common = F.broadcast(common)
    # bearers, shortness and place in one number, so that the least is found in hash aggregates
    rank = (F.col("bearers") * 1024 + most - F.least(F.length("value"), most)) * 1024 + F.least("at", most)
    chosen = every.join(common, "value").groupBy("lead", "t").agg(F.pmod(F.min(rank), F.lit(1024)).cast("int").alias("at"))
    return chosen.select("lead", F.get("t", F.col("at")).alias("value_b"), F.filter("t", lambda x, i: i != F.col("at")).alias("rest"))


def agreements(persons: DataFrame, leads: DataFrame) -> DataFrame:
    """person, lead, the dice of each field that agrees, same_username and same_email, for every candidate pair."""
    left, right = people(persons), authors(leads)
    surname = stored(surnames(right), "surnames")
    word = F.length("value") >= 2
    # of a word the two words on either side of it
    begin = F.greatest(F.col("pos") - 1, F.lit(1))
    beside = F.concat(F.slice("t", begin, F.col("pos") + 1 - begin), F.slice("t", F.col("pos") + 2, F.lit(2)))
    none = F.lit(None).cast("array<string>")

    def plain(df: DataFrame, who: str, name: str, column: Column) -> DataFrame:
        return df.select(who, column.alias("said")).where("said is not null").select(F.lit(name).alias("field"), who, bare(F.col("said")).alias("value"), "said", none.alias("near"))

    said = left.select("person", "stem", F.posexplode("t").alias("pos", "value"), "t").where(word)
    sides = {
        "person": [plain(left, "person", "username", F.col("handle")), plain(left, "person", "email", F.explode("mails")), said.select(F.lit("word").alias("field"), "person", "value", F.lit(None).cast("string").alias("said"), beside.alias("near"))],
        "lead": [plain(right, "lead", "username", F.explode("handles")), plain(right, "lead", "email", F.explode("mails")), surname.select(F.lit("word").alias("field"), "lead", F.col("value_b").alias("value"), F.lit(None).cast("string").alias("said"), F.col("rest").alias("near"))],
    }
    a, b = (reduce(DataFrame.unionByName, parts) for parts in sides.values())
    firms = right.select("lead", "stems", F.explode("firms").alias("value_b"))
    flags = lambda *on: [F.lit(k in on).alias(k) for k in ("left", "right", "firm")]
    values = a.select("field", "value", *flags("left")).unionByName(b.select("field", "value", *flags("right")))
    values = values.unionByName(firms.select(F.lit("word").alias("field"), F.col("value_b").alias("value"), *flags("right", "firm")))
    close = stored(close_values(values), "close")
    a = a.select("field", "person", F.col("value").alias("value_a"), F.col("said").alias("x"), F.col("near").alias("beside"))
    b = b.select("field", "lead", F.col("value").alias("value_b"), F.col("said").alias("y"), F.col("near").alias("rest"))
    # a name needs its other part beside it: in full on both sides, or an initial on either
    alike = lambda x, y: F.when((F.length(x) == 1) | (F.length(y) == 1), F.substr(x, F.lit(1), F.lit(1)) == F.substr(y, F.lit(1), F.lit(1))).otherwise(F.levenshtein(x, y) <= F.when(F.length(x) >= 5, 2).otherwise(1))
    met = close.drop("firm").join(b, ["field", "value_b"]).join(a, ["field", "value_a"])
    met = met.where((F.col("field") != "word") | F.exists("rest", lambda x: F.exists("beside", lambda y: alike(x, y))))
    met = met.select("person", "lead", F.when(F.col("field") == "word", "name").otherwise(F.col("field")).alias("field"), "dice", F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))
    # user names that differ in their number, like companies, are shared by many: both together make a candidate
    of_firm = said.where("stem is not null and length(value) >= 3").select("person", "stem", F.col("value").alias("value_a")).join(close.where("firm").select("value_a", "value_b"), "value_a")
    weak = of_firm.join(firms.select("lead", F.explode("stems").alias("stem"), "value_b"), ["stem", "value_b"]).select("person", "lead", F.lit("stem").alias("field"), F.lit(0.0).alias("dice"), F.lit(False).alias("same"))
    best = {k: F.max(F.when(F.col("field") == k, F.col("dice"))).alias(k) for k in ("username", "email", "name")}
    sure = {f"same_{k}": F.max((F.col("field") == k) & F.col("same")).alias(f"same_{k}") for k in ("username", "email")}
    other = stored(met.unionByName(weak).groupBy("person", "lead").agg(*best.values(), *sure.values()), "agree")
    # a company or a user name but for its number alone is no evidence: they are compared where something else agrees
    whole = other.join(left.select("person", "t", "stem"), "person").join(right.select("lead", "firms", "stems"), "lead")
    numbered = F.when(F.array_contains("stems", F.col("stem")), NUMBERED)
    out = whole.select("person", "lead", F.coalesce("username", numbered).alias("username"), "email", "name", "same_username", "same_email", firm_dice("firms", "t").alias("company"))
    keys = {k: F.max(k).alias(k) for k in ("username", "email", "name", "company", "same_username", "same_email")}
    return out.groupBy("person", "lead").agg(*keys.values())  # records that occur twice


def curve(pairs: DataFrame) -> tuple[float, float]:
    """Intercept and slope of the confidence curve, fitted on a bounded sample.

    Pairs that share user name or address exactly are true, and are scored by what else agrees;
    of those that agree in one attribute only, hardly any is.
    """
    known = pairs.where("(sure and score > 0) or (not sure and size(fields) = 1)").select("person", "lead", "score", F.col("sure").cast("int").alias("y"))
    rows = known.orderBy(F.xxhash64("person", "lead"), "person", "lead").limit(FIT_PAIRS).collect()
    a, b = -4.0, 6.0
    if len({r["y"] for r in rows}) < 2:
        return a, b
    for _ in range(25):  # Newton steps with a weak prior towards the start
        ga, gb, haa, hab, hbb = -(a + 4.0) * 0.1, -(b - 6.0) * 0.1, 0.1, 0.0, 0.1
        for r in rows:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * r["score"]))))
            e, w = r["y"] - p, p * (1 - p)
            ga, gb = ga + e, gb + e * r["score"]
            haa, hab, hbb = haa + w, hab + w * r["score"], hbb + w * r["score"] ** 2
        det = haa * hbb - hab * hab
        if det < 1e-9:
            break
        a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
    return a, b


def matches(persons: DataFrame, leads: DataFrame) -> DataFrame:
    """person, lead, fields, score and confidence of all matches."""
    rows = agreements(persons, leads)
    scored = [F.when(F.col(k).isNull() | F.col(f"same_{k}") if k in ("username", "email") else F.col(k).isNull(), 0.0).otherwise(F.col(k) * w) for k, w in WEIGHTS.items()]
    pairs = stored(
        rows.select(
            "person",
            "lead",
            F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in sorted(WEIGHTS)])).alias("fields"),
            sum(scored, F.lit(0.0)).alias("score"),
            (F.col("same_username") | F.col("same_email")).alias("sure"),
        ),
        "pairs",
    )
    a, b = curve(pairs)
    confidence = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * F.col("score"))))
    return pairs.where(F.col("sure") | (F.size("fields") >= 2)).withColumn("confidence", F.round(F.when(F.col("sure"), F.greatest(confidence, F.lit(0.95))).otherwise(confidence), 4)).select("person", "lead", "fields", "score", "confidence")
