"""Selective answering: risk by coverage, the area under that curve, and calibration error over bins of equal mass.

Items are ``key, confidence, correct``. They are placed by confidence from high to low, ties by key, over the whole table:
one range partitioning, and one small row a part for the offsets. An item without a confidence comes last and counts as 0 in
means; one without a verdict counts as wrong. Without items the curve and the bins are empty, and the report's numbers null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.stats import rounded
from siftwell.operators.indexing import part_offsets, range_ordered

BINS = 10
LEVELS = (50, 80)


def placed(items: DataFrame, key: str) -> DataFrame:
    """``key, confidence, wrong, place`` (from 1), ``errors`` among the first ``place`` items, and ``n`` of all."""
    wrong = F.when(F.col("correct"), 0).otherwise(1).cast("long")
    rows = items.select(key, F.col("confidence").cast("double").alias("confidence"), wrong.alias("wrong"))
    ordered = range_ordered(rows, [F.col("confidence").desc_nulls_last(), F.col(key).asc()], "by-confidence")
    before = part_offsets(ordered, F.lit(1)).withColumnRenamed("_offset", "_before")
    upto = F.sum("wrong").over(Window.partitionBy("_part").orderBy("_row"))
    rows = ordered.withColumn("_upto", upto).join(F.broadcast(before), "_part").join(F.broadcast(part_offsets(ordered, F.col("wrong"))), "_part")
    return rows.select(key, "confidence", "wrong", (F.col("_before") + F.col("_row") + 1).alias("place"), (F.col("_offset") + F.col("_upto")).alias("errors"), F.lit(ordered.count()).cast("long").alias("n"))


def risk_coverage(items: DataFrame, key: str) -> DataFrame:
    """One point an item: the share of items answered down to it, and the share of errors among those."""
    return placed(items, key).select(key, "place", rounded(F.col("place") / F.col("n"), 9).alias("coverage"), rounded(F.col("errors") / F.col("place"), 9).alias("risk"))


def calibration_bins(items: DataFrame, key: str, bins: int = BINS) -> DataFrame:
    """``bin`` (0: the most confident), its items, mean confidence and accuracy; sizes differ by one at most."""
    of = F.floor((F.col("place") - 1) * bins / F.col("n")).cast("int")
    rows = placed(items, key).groupBy(of.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.coalesce("confidence", F.lit(0.0))).alias("c"), F.avg(1 - F.col("wrong")).alias("a"))
    return rows.select("bin", "n", rounded(F.col("c"), 6).alias("confidence"), rounded(F.col("a"), 6).alias("accuracy"))


def selective_report(items: DataFrame, key: str, bins: int = BINS, levels=LEVELS) -> DataFrame:
    """One row: items, accuracy, area under the risk-coverage curve, calibration error, and the risk at ``levels`` per cent coverage."""
    rows = placed(items, key).withColumn("bin", F.floor((F.col("place") - 1) * bins / F.col("n")))
    risk = F.col("errors") / F.col("place")
    at = [F.max(F.when(F.col("place") == F.ceil(F.col("n") * x / 100), risk)).alias(f"risk_{x}") for x in levels]
    by_bin = rows.groupBy("bin").agg(F.count("*").alias("m"), F.sum(risk).alias("area"), F.sum("wrong").alias("wrong"), (F.sum(F.coalesce("confidence", F.lit(0.0))) - F.sum(1 - F.col("wrong"))).alias("gap"), *at)
    n = F.sum("m")
    return by_bin.agg(
        F.coalesce(n, F.lit(0)).alias("n"), rounded(1 - F.sum("wrong") / n, 6).alias("accuracy"), rounded(F.sum("area") / n, 6).alias("aurc"),
        rounded(F.sum(F.abs("gap")) / n, 6).alias("ece"), *[rounded(F.max(f"risk_{x}"), 6).alias(f"risk_{x}") for x in levels],
    )
