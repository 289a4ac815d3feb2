"""Weighted lexicon scoring and the boosts that follow it.

A lexicon is data: rows of list, id, phrase, weight and tag. Phrases are lower-cased on load;
null or blank phrases and null weights are left out, and of repeated phrases the one with the
highest weight stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.text import phrase_regex


@dataclass(frozen=True)
class Rule:
    phrase: str
    weight: int


def rules(lexicon: DataFrame, list_name: str, most: int = 20_000) -> list[Rule]:
    """The rules of one list in matching order: longest in bytes first, then heaviest, then by phrase.

    A lexicon is a hand-written list; ``most`` guards against reading anything else.
    """
    clean = (
        lexicon.where((F.col("list_name") == list_name) & F.col("weight").isNotNull())
        .select(F.lower(F.trim(F.regexp_replace("phrase", r"\s+", " "))).alias("phrase"), "weight")
        .where("phrase <> ''")
        .groupBy("phrase")
        .agg(F.max("weight").alias("weight"))
    )
    rows = clean.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the lexicon has more than {most} phrases")
    return sorted((Rule(r["phrase"], r["weight"]) for r in rows), key=lambda r: (-len(r.phrase.encode()), -r.weight, r.phrase))


def matched(text: Column, ordered: list[Rule]) -> Column:
    """Array of struct(weight, phrase) of the rules that claim a place, heaviest first.

    Rules claim in their order the first place not claimed yet; a single word needs word
    boundaries, several words match anywhere. Claimed places are blanked, so that no later
    rule can use them. The fold runs over a literal array, so the text is never joined.
    """
    if not ordered:
        return F.array().cast("array<struct<weight:int,phrase:string>>")
    table = F.array(*[F.struct(F.lit(r.phrase).alias("phrase"), F.lit(phrase_regex(r.phrase)).alias("pattern"), F.lit(r.weight).alias("weight")) for r in ordered])
    low = F.coalesce(F.lower(text), F.lit(""))
    state = F.struct(low.alias("rest"), F.array().cast("array<struct<weight:int,phrase:string>>").alias("hits"))

    def claim(acc: Column, rule: Column) -> Column:
        # several words match as they are; only single words need the pattern
        first = F.instr(acc["rest"], rule["phrase"])
        at = F.when((first == 0) | F.contains(rule["phrase"], F.lit(" ")), first).otherwise(F.regexp_instr(acc["rest"], rule["pattern"]))
        n = F.length(rule["phrase"])
        rest = F.overlay(acc["rest"], F.repeat(F.lit("\x01"), n), at, n)
        return F.when(
            at > 0,
            F.struct(rest.alias("rest"), F.array_append(acc["hits"], F.struct(rule["weight"].alias("weight"), rule["phrase"].alias("phrase"))).alias("hits")),
        ).otherwise(acc)

    # only rules that the text holds can claim; blanking takes nothing else away
    held = F.filter(table, lambda rule: F.contains(low, rule["phrase"]))
    hits = F.aggregate(held, state, claim)["hits"]
    return F.array_sort(hits, lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).when(a["phrase"] < b["phrase"], -1).when(a["phrase"] > b["phrase"], 1).otherwise(0))


HITS = T.ArrayType(T.StructType([T.StructField("weight", T.IntegerType()), T.StructField("phrase", T.StringType())]))


def claims(text: str, ordered: list[Rule], found: Iterable[tuple[int, int]]) -> list[tuple[int, str]]:
    """Weight and phrase of the rules that claim a place; found: start and number of every phrase that occurs."""
    at: dict[int, list[int]] = {}
    for start, rule in found:
        at.setdefault(rule, []).append(start)
    taken = bytearray(len(text))
    out = []

    def joins(i: int) -> bool:
        return 0 <= i < len(text) and not taken[i] and (text[i].isalpha() or text[i].isdecimal() or text[i] == "_")

    for rule in sorted(at):
        phrase = ordered[rule].phrase
        n = len(phrase)
        for start in sorted(at[rule]):
            if any(taken[start : start + n]) or " " not in phrase and (joins(start - 1) or joins(start + n)):
                continue
            taken[start : start + n] = b"\x01" * n
            out.append((ordered[rule].weight, phrase))
            break
    return sorted(out, key=lambda h: (-h[0], h[1]))


def matched_in_one_pass(ordered: list[Rule]) -> Callable[[Column], Column]:
    """The same as ``matched`` by an automaton over all phrases: one pass over a text, whatever the number of rules.

    Folding over hundreds of rules costs the JVM about a millisecond a text, the automaton some
    microseconds. Without the automaton's library the fold is used.
    """
    try:
        import ahocorasick
    except ImportError:
        return lambda text: matched(text, ordered)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = ahocorasick.Automaton()
        for i, r in enumerate(ordered):
            machine.add_word(r.phrase, i)
        machine.make_automaton()
        for batch in texts:
            out = []
            for t in batch.to_pylist():
                low = (t or "").lower()
                found = [(end + 1 - len(ordered[i].phrase), i) for end, i in machine.iter(low)]
                out.append([{"weight": w, "phrase": p} for w, p in claims(low, ordered, found)] if found else [])
            yield pa.array(out, pa.list_(pa.struct([("weight", pa.int32()), ("phrase", pa.string())])))

    return F.arrow_udf(run, HITS) if ordered else lambda text: matched(text, ordered)


def total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda s, h: s + h["weight"])


def decay(score: Column, posted_at: Column, as_of: Column) -> Column:
    """Score by age: up to two days +10, a week +5, a month 0, half a year -5, older -10.

    A penalty never goes below zero; without a date the score stays.
    """
    age = F.unix_seconds(as_of) - F.unix_seconds(posted_at)
    day = 86_400
    step = F.when(age <= 2 * day, 10).when(age <= 7 * day, 5).when(age <= 30 * day, 0).when(age <= 180 * day, -5).otherwise(-10)
    return F.when(posted_at.isNull(), score).when(step < 0, F.greatest(score + step, F.lit(0))).otherwise(score + step)


def priority(score: Column, high: int = 35, medium: int = 15) -> Column:
    return F.when(score >= high, "High").when(score >= medium, "Medium").otherwise("Low")


def rank(name: Column, order: tuple[str, ...] = ("Low", "Medium", "High")) -> Column:
    """Position of an ordered label, from 1; 0 for others."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), name).cast("int")


def gated(score: Column, passes: Column, bonus: int, cap: int) -> Column:
    """A bonus for rows that pass, a cap just below a band for those that do not."""
    return F.when(F.coalesce(passes, F.lit(False)), score + bonus).otherwise(F.least(score, F.lit(cap - 1)))


def ratio_boost(accepted: Column, junk: Column, least: int = 20) -> Column:
    """Boost of a source by its accepted share, from ``least`` records on."""
    n = accepted + junk
    share = F.try_divide(accepted.cast("double"), n.cast("double"))
    return F.when(n < least, 0).when(share >= 0.35, 8).when(share >= 0.2, 4).when(share < 0.08, -4).otherwise(0)
