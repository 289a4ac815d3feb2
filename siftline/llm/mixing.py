"""Mixing sources to target weights by balanced sampling.

Every source is taken as often as its target asks for, at most ``max_repeats`` times: whole
passes first, and for the rest of a pass a sample of its documents, drawn with the cube
method. All documents start with the same fractional inclusion probability. In the flight
phase three of them at a time are moved through the null space of the two constraints
(number of documents, number of tokens) until one is decided, so both totals stay exactly as
they were. Blocks of at most ``BLOCK`` documents fly at once in parallel; each leaves at most
two undecided documents, which form the blocks of the next level, until one block for each
source remains. Its last undecided documents are the landing problem, solved by trying all
outcomes and taking the one closest to both totals.

Defined cases: sources are the same after trimming and lower-casing; documents without source,
or of a source without target, count in the total size and not in the mix; null and empty
texts have no tokens; an empty source, or one without target, is used zero times and, if it
has a target above zero, cannot reach it; targets listed twice for a source take the first by
share; rows that share a doc_id are separate documents.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.session import stored

#: Vocabulary of a public tokenizer (ranks) and the pattern that splits text for it.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one block of the flight phase.
BLOCK = 2_000


def token_counter(ranks: str = RANKS, pattern: str = PATTERN):
    """A pandas UDF that counts tokens; the vocabulary file must be readable on every node."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        for s in texts:
            yield pd.Series([len(encode(t)) if t else 0 for t in s], dtype="int64")

    return count


def source_key(source: Column) -> Column:
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def sized(documents: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """Stored doc_id, source, tokens and a hash of the text of every document."""
    return stored(documents.select("doc_id", source_key(F.col("source")).alias("source"), token_counter(ranks, pattern)(F.col("text")).alias("tokens"), F.xxhash64("text").alias("content")), "sizes")


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: size, wanted tokens, passes, the fraction of the last pass, and whether it can be reached.

    There are as many rows as sources with a target, a list written by hand.
    """
    own = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("size"))
    total = sizes.agg(F.sum("tokens").alias("total"))
    wish = (
        targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("source is not null")
        .groupBy("source")
        .agg(F.max_by("max_repeats", "target_share").alias("max_repeats"), F.max("target_share").alias("target_share"))
    )
    rows = wish.join(own, "source", "left").na.fill(0, ["docs", "size"]).crossJoin(F.broadcast(total))  # one row
    wanted = F.col("target_share") * F.coalesce("total", F.lit(0))
    rate = F.least(F.coalesce(F.try_divide(wanted, F.col("size")), F.lit(0.0)), F.coalesce(F.col("max_repeats"), F.lit(1)).cast("double"))
    return (
        rows.withColumn("wanted", wanted)
        .withColumn("rate", rate)
        .withColumn("passes", F.floor("rate").cast("int"))
        .withColumn("fraction", F.col("rate") - F.floor("rate"))
        .withColumn("reachable", F.col("size") * F.coalesce(F.col("max_repeats"), F.lit(1)) >= F.col("wanted"))
    )


def fly(pi: list[float], tokens: list[float], rng: random.Random) -> list[float]:
    """The flight phase over one block: probabilities moved to 0 or 1, all but two at most."""
    pi = list(pi)
    eps = 1e-9
    waiting = [i for i, p in enumerate(pi) if eps < p < 1 - eps]
    waiting.reverse()
    active: list[int] = []
    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            # two are left: they can still move if their sizes are equal
            if len(active) == 2 and tokens[active[0]] == tokens[active[1]]:
                u = [1.0, -1.0]
            else:
                return pi
        else:
            a, b, c = (tokens[i] for i in active)
            u = [b - c, c - a, a - b]
            if not any(u):
                u = [1.0, -1.0, 0.0]
        up = min(((1 - pi[i]) / v if v > 0 else pi[i] / -v) for i, v in zip(active, u) if v)
        down = min((pi[i] / v if v > 0 else (1 - pi[i]) / -v) for i, v in zip(active, u) if v)
        step = up if rng.random() * (up + down) < down else -down
        for i, v in zip(active, u):
            pi[i] = min(1.0, max(0.0, pi[i] + step * v))
            if pi[i] < eps:
                pi[i] = 0.0
            elif pi[i] > 1 - eps:
                pi[i] = 1.0
        active = [i for i in active if 0 < pi[i] < 1]


def land(pi: list[float], tokens: list[float], size: float, docs: float) -> list[float]:
    """The last undecided documents decided so that both totals are met as well as can be."""
    open_ = [i for i, p in enumerate(pi) if 0 < p < 1]
    want_t = sum(pi[i] * tokens[i] for i in open_)
    want_n = sum(pi[i] for i in open_)
    best = None
    for m in range(2 ** len(open_)):
        pick = [(m >> k) & 1 for k in range(len(open_))]
        miss = abs(sum(x * tokens[i] for x, i in zip(pick, open_)) - want_t) / max(size, 1.0) + abs(sum(pick) - want_n) / max(docs, 1.0)
        if best is None or miss < best[0]:
            best = (miss, pick)
    out = list(pi)
    for x, i in zip(best[1] if best else [], open_):
        out[i] = float(x)
    return out


_FLOWN = "row long, source string, block long, tokens double, pi double, docs long"


def sample(rows: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """row, source and pick (0 or 1); rows: row, source, tokens, pi and docs (rows of the source)."""

    def level(last: bool):
        def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["row"], kind="stable").reset_index(drop=True)
            rng = random.Random(f"{seed}/{key[0]}/{key[1]}")
            tokens = pdf["tokens"].tolist()
            pi = fly(pdf["pi"].tolist(), tokens, rng)
            if last:
                pi = land(pi, tokens, sum(tokens), len(tokens))
            return pdf.assign(pi=pi)

        return run

    todo = rows.withColumn("block", F.pmod(F.xxhash64("row", F.lit(seed)), F.greatest(F.lit(1), F.ceil(F.col("docs") / block))))
    done = []
    most = rows.agg(F.max("docs")).first()[0] or 0
    while most > 0:
        blocks = -(-most // block)
        flown = stored(todo.select("row", "source", "block", F.col("tokens").cast("double").alias("tokens"), "pi", "docs").groupBy("source", "block").applyInPandas(level(blocks <= 1), _FLOWN), "flown")
        decided = (F.col("pi") <= 0) | (F.col("pi") >= 1)
        done.append(flown.where(decided).select("row", "source", F.col("pi").cast("int").alias("pick")))
        if blocks <= 1:
            break
        # each block leaves two at most; as many blocks' remains as fill a block fly together
        join = max(2, block // 2)
        todo = flown.where(~decided).withColumn("block", F.floor(F.col("block") / join))
        most = min(most // 2, -(-blocks // join) * block if blocks > join else block)
    out = rows.sparkSession.createDataFrame([], "row long, source string, pick int")
    for d in done:
        out = out.unionByName(d)
    return out


def mix(sizes: DataFrame, planned: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """doc_id, source, tokens and copies of every document that is used at least once.

    Documents are told apart by a hash of their content, equal ones by a number, so that the
    draw does not depend on how the files lie.
    """
    marked = sizes.join(F.broadcast(planned.select("source", "docs", "passes", "fraction")), "source")  # one row for each source
    same = F.xxhash64(*[F.col(c) for c in sizes.columns])
    again = F.row_number().over(Window.partitionBy("same").orderBy("same"))
    rows = stored(marked.withColumn("same", same).withColumn("row", F.xxhash64("same", again)).drop("same"), "rows")
    part = rows.where("fraction > 0").select("row", "source", "tokens", F.col("fraction").alias("pi"), "docs")
    picked = sample(part, block, seed).where("pick = 1").select("row", "pick")
    return rows.join(picked, "row", "left").withColumn("copies", F.col("passes") + F.coalesce("pick", F.lit(0))).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def short(reported: DataFrame) -> DataFrame:
    """The sources of a drawn mix that fall short although every document is used as often as allowed."""
    return reported.where((F.col("used_docs") == F.col("docs") * F.coalesce(F.col("max_repeats"), F.lit(1))) & (F.col("used_tokens") < F.col("wanted"))).select("source")


def report(planned: DataFrame, mixed: DataFrame) -> DataFrame:
    """Wanted and actual share, passes and documents of every source."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("used_docs"))
    rows = planned.join(used, "source", "left").na.fill(0, ["used_tokens", "used_docs"])
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"))
    return rows.crossJoin(F.broadcast(whole)).select(  # one row
        "source", "target_share", "max_repeats", "docs", "size", "wanted", "rate", "reachable", "used_docs", "used_tokens",
        F.round(F.try_divide(F.col("used_tokens"), F.col("total")), 6).alias("reached_share"),
        F.round(F.try_divide(F.col("used_tokens"), F.col("mix_tokens")), 6).alias("mix_share"),
    )
