"""Global positions and running totals without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.sources.scratch import materialise


def range_ordered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, written once, with ``_part`` and ``_row`` (position in the part)."""
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id())
    part = part.withColumns({"_part": F.shiftright("_mid", 33).cast("int"), "_row": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))})
    return materialise(part.drop("_mid"), name)


def part_offsets(ordered: DataFrame, amount: Column) -> DataFrame:
    """``_part, _offset``: the total of ``amount`` in all earlier parts. One small row per part passes the driver."""
    rows = sorted(ordered.groupBy("_part").agg(F.sum(amount).alias("n")).collect())
    total, out = 0, []
    for part, n in rows:
        out.append((part, total))
        total += n or 0
    return ordered.sparkSession.createDataFrame(out, "_part int, _offset long")


def with_global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name``: the zero-based position of each row in ``order`` over the whole table."""
    ordered = range_ordered(df, order, "global-index")
    offsets = part_offsets(ordered, F.lit(1))
    return ordered.join(F.broadcast(offsets), "_part", "left").withColumn(name, F.col("_offset") + F.col("_row")).drop("_part", "_row", "_offset")


def with_running_total(df: DataFrame, order: list[Column], amount: str, name: str) -> DataFrame:
    """Add ``name``: the total of ``amount`` over all rows before this one in ``order``."""
    from pyspark.sql import Window

    ordered = range_ordered(df, order, "running-total")
    offsets = part_offsets(ordered, F.col(amount))
    before = F.sum(amount).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    out = ordered.withColumn("_in", F.coalesce(before, F.lit(0))).join(F.broadcast(offsets), "_part", "left")
    return out.withColumn(name, F.col("_offset") + F.col("_in")).drop("_part", "_row", "_offset", "_in")
