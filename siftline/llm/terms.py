"""Frequency of every distinct term by recursive radix spilling.

Entries are first counted within each record's task (records are brought together by their
identifier, so a record is in one task only): a hot term leaves each task as one row. These
partial counts are written to the shared folder, partitioned by bits of the term's hash, as many as
their number asks for; partitions above ``partition_rows`` are split by further bits, all of a
level in one job, again and again, and each partition is then aggregated out-of-core by DuckDB,
which spills to the shared folder too where that is mounted as a file system.

Defined cases: null and blank terms are dropped; a record with a null identifier has its terms
counted as occurrences but is no record that holds them; records that come twice count once as
a record and with all their entries as occurrences; empty tables give no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.session import scratch, stored

#: Hash bits of one level of partitioning, and the most of the first.
BITS, FIRST_BITS = 4, 12
#: Rows of partial counts that one DuckDB aggregation may take.
PARTITION_ROWS = 2_000_000
#: Memory of one DuckDB aggregation, beyond which it spills.
DUCKDB_MEMORY = "256MB"
#: The same where it cannot spill.
DUCKDB_MEMORY_ALONE = "1GB"
#: Bits of the hash that partitioning may use up; a partition of one term never splits further.
MAX_BITS = 32


def normal(term: Column) -> Column:
    """Trimmed, lower case, inner white space made one space."""
    return F.lower(F.trim(F.regexp_replace(term, r"[\s\p{Z}]+", " ")))


def without_score(entry: Column) -> Column:
    """An entry of ``matched`` without a suffix such as (+15)."""
    return F.regexp_replace(entry, r"\s*\([+-]?\d+\)\s*$", "")


def partial_counts(entries: DataFrame) -> DataFrame:
    """term, occurrences and records of each task; entries: record and term.

    Only the exchange by record is made; both sums then run inside the task.
    """
    # entries without a record belong together by their term only
    part = F.when(F.col("record").isNull(), F.xxhash64(F.lit("term"), "term")).otherwise(F.xxhash64("record"))
    parts = entries.withColumn("part", part).repartition("part").groupBy("part", "record", "term").agg(F.count("*").alias("n")).drop("part")
    schema = "term string, occurrences long, records long"

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.table({"term": b.column("term"), "occurrences": b.column("n"), "records": b.column("record").is_valid().cast(pa.int64())})
            t = t.group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")]).rename_columns(["term", "occurrences", "records"])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows > 200_000:  # merge, and hand on what does not shrink
                held = held.group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")]).rename_columns(["term", "occurrences", "records"])
                if held.num_rows > 100_000:
                    yield from held.combine_chunks().to_batches()
                    held = None
        if held is not None:
            held = held.group_by("term").aggregate([("occurrences", "sum"), ("records", "sum")]).rename_columns(["term", "occurrences", "records"])
            yield from held.combine_chunks().to_batches()

    return parts.mapInArrow(within, schema)


def _digit(start: int, bits: int) -> Column:
    """Hash bits of a term from a place on."""
    return F.shiftrightunsigned(F.xxhash64("term"), start).bitwiseAND(2**bits - 1).cast("int")


_COUNTS = "term string, occurrences long, records long"


def frequencies(entries: DataFrame, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """term, occurrences and records over all entries (record, term)."""
    spark = entries.sparkSession
    todo = stored(partial_counts(entries.where(F.col("term").isNotNull() & (F.col("term") != ""))), "counts")
    rows = todo.count()
    if rows == 0:
        return spark.createDataFrame([], _COUNTS)
    bits, used, level, done = min(FIRST_BITS, max(BITS, (-(-rows // partition_rows) - 1).bit_length())), 0, 0, []
    columns: list[str] = []
    while True:
        # each level is one job over all partitions that are too large
        path, columns = scratch(spark, f"radix{level}"), [*columns, f"radix{level}"]
        todo.withColumn(columns[-1], _digit(used, bits)).write.partitionBy(*columns).parquet(path)
        used += bits
        whole = spark.read.schema(f"{_COUNTS}, {', '.join(c + ' int' for c in columns)}").parquet(path)
        sizes = whole.groupBy(*columns).agg(F.count("*").alias("rows"), F.min("term").alias("least"), F.max("term").alias("most")).collect()  # one row for each partition
        again = []
        for s in sizes:
            place = "/".join([path, *[f"{c}={s[c]}" for c in columns]])
            if s["rows"] > partition_rows and s["least"] != s["most"] and used < MAX_BITS:
                again.append(place)
            else:
                done.append(place)
        if not again:
            return _aggregate(spark, done)
        todo = spark.read.schema(whole.schema).option("basePath", path).parquet(*again)
        bits, level = BITS, level + 1


def _aggregate(spark, paths: list[str]) -> DataFrame:
    """Each partition by one DuckDB query; a task takes one partition at a time."""
    spill = scratch(spark, "duckdb")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import duckdb
        import pyarrow.dataset as ds
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                where, inner = fs.FileSystem.from_uri(path)
                db = duckdb.connect()
                try:
                    # where the shared folder is not mounted nothing may be spilled: a partition is small enough to do without
                    mounted = isinstance(where, fs.LocalFileSystem)
                    db.execute(f"SET temp_directory='{fs.FileSystem.from_uri(spill)[1] + '/' + uuid.uuid4().hex if mounted else ''}'")
                    db.execute(f"SET memory_limit='{DUCKDB_MEMORY if mounted else DUCKDB_MEMORY_ALONE}'; SET threads=1; SET preserve_insertion_order=false")
                    db.register("part", ds.dataset(inner, filesystem=where, format="parquet"))
                    found = db.execute("SELECT term, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM part GROUP BY term").to_arrow_reader(65536)
                    yield from found
                finally:
                    db.close()

    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return rows.mapInArrow(one, "term string, occurrences long, records long")


def marks(found: DataFrame, known: DataFrame, records: int, rare_at_most: int = 2, common_share: float = 0.1) -> DataFrame:
    """All terms with their counts and mark; known: terms that count even if nobody holds them."""
    every = known.select("term").where("term <> ''").distinct().join(found, "term", "full_outer").na.fill(0, ["occurrences", "records"])
    mark = F.when(F.col("records") <= rare_at_most, "rare").when(F.col("records") > common_share * records, "common")
    return every.withColumn("mark", mark)
