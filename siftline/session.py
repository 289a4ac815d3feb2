"""Session helpers: building a local session, loading tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "siftline") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIFTLINE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder of this application below spark.checkpoint.dir, which every executor can read.

    Where a local session names none, as in tests, a folder of this machine is made; on a
    cluster that is an error. What lies in it is deleted when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="siftline-")
        where = f"{base.rstrip('/')}/siftline-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _OWN[app] = where
    return _OWN[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was stored under a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage and keeps what was computed: a lost executor costs its running
    tasks only, since the files are not on its disk.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Largest side, in bytes of its files or of its measured rows, that is ever broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024


def small_enough(rows: int, bytes_per_row: int) -> bool:
    """Whether a counted side may be broadcast."""
    return rows * bytes_per_row <= BROADCAST_BYTES
