"""Training pairs and their batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.indexing import with_global_index
from siftwell.operators.ranking import cap_per_group, hash_order
from siftwell.sources.scratch import materialise


def training_pairs(intents: DataFrame, golds: DataFrame, catalog: DataFrame, text: Column, cap: int | None = None, seed="pairs") -> DataFrame:
    """``intent_id, anchor, tool_id, positive``: each query with the text of its first gold in the catalog.

    ``intents``: ``intent_id, query``; ``golds``: ``intent_id, tool_id, gold_idx``; ``catalog``: ``tool_id`` and what ``text`` reads, one row a
    tool. Queries without a gold in the catalog are left out. ``cap``: at most so many pairs a tool, in hash order.
    """
    known = golds.join(catalog.select("tool_id"), "tool_id", "left_semi")
    first = known.groupBy("intent_id").agg(F.min(F.struct("gold_idx", "tool_id")).alias("g")).select("intent_id", "g.tool_id")
    if cap is not None:
        first = cap_per_group(first, "tool_id", cap, seed, "intent_id").drop("pick")
    texts = catalog.select("tool_id", text.alias("positive"))
    return intents.select("intent_id", F.col("query").alias("anchor")).join(first, "intent_id").join(texts, "tool_id").select("intent_id", "anchor", "tool_id", "positive")


def batches_without_repeats(rows: DataFrame, positive: str, key: str, size: int, seed) -> DataFrame:
    """``rows`` with ``batch``: no batch holds a positive twice, sizes differ by one at most, none is above ``size``.

    Positives in hash order, and the rows of each in the order of ``key``, are numbered over the whole table; a row's batch is its
    number modulo the count of batches. Rows of one positive follow each other, so they fall into different batches as long as there
    are as many batches as the most frequent positive has rows: that, or what ``size`` asks for, is the count. Numbers come
    from a range partitioning that also cuts a frequent positive, no window sees a whole positive or the whole table. Null
    positives are one positive; ``key`` tells rows apart.
    """
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(positive).cast("string"))), F.col(positive), F.col(key)]
    numbered = materialise(with_global_index(rows, order, "_number"), "numbered-pairs")
    n = numbered.count()
    most = numbered.groupBy(positive).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    count = max(1, -(-n // size), most)
    return numbered.withColumn("batch", F.col("_number") % count).drop("_number")


def batch_audit(batched: DataFrame, positive: str) -> DataFrame:
    """``batches, smallest, largest, repeats``: sizes, and the positives that a batch has more than once (must be 0)."""
    per = batched.groupBy("batch", positive).agg(F.count("*").alias("n")).groupBy("batch").agg(F.sum("n").alias("size"), F.count_if(F.col("n") > 1).alias("repeats"))
    return per.agg(F.count("*").alias("batches"), F.min("size").alias("smallest"), F.max("size").alias("largest"), F.sum("repeats").alias("repeats"))


def in_batch_order(batched: DataFrame, key: str, seed) -> DataFrame:
    """``place`` of each row in its batch, in hash order."""
    from pyspark.sql import Window

    return batched.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy(*hash_order(seed, key))))
