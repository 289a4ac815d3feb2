"""Ordered reject gates: every row gets exactly one outcome.

All gates of a chain are one CASE expression in one projection, so no row is shuffled and the
funnel is a single aggregation. Gates are data: a name, the counter it adds to, and a column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A row is rejected with ``reason`` where ``reject`` is true; ``detail`` says by what."""

    reason: str
    reject: Column
    bucket: str = "dropped"
    detail: Column | None = None
    applies: Column | None = None

    def hit(self) -> Column:
        here = F.coalesce(self.reject, F.lit(False))
        return here if self.applies is None else F.coalesce(self.applies, F.lit(False)) & here


def chain(rows: DataFrame, gates: list[Gate]) -> DataFrame:
    """rows with reject_reason, reject_detail and bucket of the first gate that rejects.

    Rows that no gate rejects have nulls and the bucket ``accepted``. A null gate is no reject.
    """
    if not gates:
        return rows.withColumns({"reject_reason": F.lit(None).cast("string"), "reject_detail": F.lit(None).cast("string"), "bucket": F.lit("accepted")})
    which = F.coalesce(*[F.when(g.hit(), F.lit(i)) for i, g in enumerate(gates)])
    out = rows.withColumn("_gate", which)
    pick = lambda f: F.coalesce(*[F.when(F.col("_gate") == i, f(g)) for i, g in enumerate(gates)])
    return out.withColumns(
        {
            "reject_reason": pick(lambda g: F.lit(g.reason)),
            "reject_detail": pick(lambda g: g.detail if g.detail is not None else F.lit(None).cast("string")),
            "bucket": F.coalesce(pick(lambda g: F.lit(g.bucket)), F.lit("accepted")),
        }
    ).drop("_gate")


def funnel(judged: DataFrame, *by: str) -> DataFrame:
    """Rows of each outcome."""
    return judged.groupBy(*by, F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


def top_reasons(judged: DataFrame, most: int) -> DataFrame:
    """The commonest reject reasons as reason:count, most frequent first, then by name."""
    counts = judged.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "reject_reason").limit(most).select("reject_reason", "n", F.concat_ws(":", "reject_reason", "n").alias("label"))
