"""Writers: JSON lines, tables that are merged into, and several targets at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.reports import upserted
from siftline.session import discard, scratch


def ndjson(rows: DataFrame, path: str, order: Sequence[str] = (), most: int | None = None) -> None:
    """JSON lines; with an order and a limit a report of at most that many rows in one file."""
    out = rows.orderBy(*order) if order else rows
    if most is not None:
        out = out.limit(most).coalesce(1)
    out.write.mode("overwrite").json(path)


def merge(rows: DataFrame, path: str, key: str, at: str, first_only: Sequence[str]) -> DataFrame:
    """Upsert into a Parquet table: latest values, ``first_only`` columns from the first time.

    The table is a folder of versions and a pointer to the current one. A new state is written
    as a version of its own, and the pointer is replaced last by one rename, so a failed write
    or a lost driver leaves the old state as it was. Running a batch twice changes nothing.
    Older versions than the last two are deleted, so that readers of the last one can finish.
    """
    spark = rows.sparkSession
    state = upserted(rows, key, at, first_only).drop("versions").select(*rows.columns)
    last = current(spark, path)
    if last is not None:
        new = state.select(*[F.col(c).alias(f"_n_{c}") for c in rows.columns])
        both = spark.read.parquet(f"{path}/v{last}").withColumn("_held", F.lit(True)).join(new, F.col(key) == F.col(f"_n_{key}"), "full_outer")
        newer = F.col(f"_n_{at}").isNotNull() & (F.col(at).isNull() | (F.col(f"_n_{at}") >= F.col(at)))
        held = F.coalesce("_held", F.lit(False))

        def value(c: str) -> Column:
            if c == key:
                return F.coalesce(c, f"_n_{c}")
            return F.when(held & F.lit(c in first_only), F.col(c)).when(newer | ~held, F.col(f"_n_{c}")).otherwise(F.col(c))

        state = both.select(*[value(c).alias(c) for c in rows.columns])
    version = 0 if last is None else last + 1
    state.write.mode("overwrite").parquet(f"{path}/v{version}")  # what a failed run left there is replaced
    fs, at_ = _files(spark, path)
    pointer = at_(f"p{version}")
    out = fs.create(at_(f"_p{version}"), True)
    out.close()
    if not fs.rename(at_(f"_p{version}"), pointer) and not fs.exists(pointer):
        raise OSError(f"version {version} of {path} could not be made current")
    for old in range(max(0, version - 3), max(0, version - 1)):
        fs.delete(at_(f"p{old}"), False)
        fs.delete(at_(f"v{old}"), True)
    return spark.read.parquet(f"{path}/v{version}")


def _files(spark: SparkSession, path: str):
    """File system of a path, and a function from a name below it to its path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: hadoop.Path(f"{path}/{name}")


def current(spark: SparkSession, path: str) -> int | None:
    """Number of the current version of a merged table: the highest that has a pointer."""
    fs, at = _files(spark, path)
    if not fs.exists(at("")):
        return None
    names = [str(f.getPath().getName()) for f in fs.listStatus(at(""))]  # a few versions
    return max((int(n[1:]) for n in names if n.startswith("p") and n[1:].isdigit()), default=None)


def merged(spark: SparkSession, path: str) -> DataFrame:
    """The current state of a merged table."""
    last = current(spark, path)
    if last is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{last}")


def fan_out(*targets: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """One foreachBatch function for several targets; the batch is stored once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = scratch(spark, f"batch{batch_id}")
        try:
            batch.write.parquet(path)
            kept = spark.read.schema(batch.schema).parquet(path)
            for target in targets:
                target(kept, batch_id)
        finally:
            discard(spark, path)

    return write


def masked(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with contact-like columns as reports show them."""
    from siftline.functions.text import masked_contact

    return rows.withColumns({c: masked_contact(F.col(c)) for c in columns})
