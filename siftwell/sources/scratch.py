"""Shared scratch storage: cutting lineage with written Parquet tables."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


ROWS_A_FILE = 200_000
#: Paths written inside the open ``temporary`` blocks, the innermost last.
_TEMPORARY: list[list[str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local session gets a temporary folder, once, and any other the warehouse, which is shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.siftwell.scratch", None)
    if not base:
        master = spark.sparkContext.master
        alone = master == "local" or master.startswith("local[")
        base = tempfile.mkdtemp(prefix="siftwell-") if alone else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.siftwell.scratch", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/siftwell-{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs started inside hand Python batches of at most ``rows`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` once to shared scratch and return a scan of it.

    Later reads never recompute the lineage, and a lost executor costs no more than its own tasks. ``rows``: a known bound of
    the number of rows, so that a small table has few files whatever the number of partitions it was made in.
    """
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
    df.write.options(**options).parquet(path)
    for tables in _TEMPORARY[-1:]:
        tables.append(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out.scratch_path = path
    return out


@contextmanager
def temporary(spark: SparkSession):
    """Tables that are written inside are deleted at the end, but for those given to the function that this yields.

    Only for tables that nothing outside reads: a plan over a deleted table fails.
    """
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.scratch_path)
        return df

    _TEMPORARY.append([])
    try:
        yield keep
    finally:
        written = _TEMPORARY.pop()
        for path in written:
            if path in kept:
                for tables in _TEMPORARY[-1:]:
                    tables.append(path)
            else:
                delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that are no longer referred to.

    What the first collection sets free may hold what the second one does; the cleaner works beside this thread.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.25)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of any file system that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
