"""Retrieve, fuse, shortlist, select: the composed pipeline up to the selector, and its evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.ranking import hash_order


def oracle_shortlist(ranked: DataFrame, gold: DataFrame, queries: DataFrame, k: int, seed) -> DataFrame:
    """``qid, slot, tid, is_gold``: the k best with all golds among them, in hash order; queries without gold get the plain k best."""
    n_gold = gold.groupBy("qid").agg(F.count_distinct("tid").alias("n_gold"))
    golds = gold.select("qid", "tid").distinct().withColumn("is_gold", F.lit(True))
    others = ranked.join(golds.select("qid", "tid"), ["qid", "tid"], "left_anti").join(queries.select("qid"), "qid", "left_semi")
    others = others.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).join(n_gold, "qid", "left")
    others = others.where(F.col("r") <= F.lit(k) - F.coalesce("n_gold", F.lit(0))).select("qid", "tid", F.lit(False).alias("is_gold"))
    both = others.unionByName(golds.join(queries.select("qid"), "qid", "left_semi").select("qid", "tid", "is_gold"))
    return both.withColumn("slot", F.row_number().over(Window.partitionBy("qid").orderBy(*hash_order(seed, "qid", "tid")))).select("qid", "slot", "tid", "is_gold")


def arms(window: DataFrame, fused: DataFrame, gold: DataFrame, k: int = 25) -> DataFrame:
    """``qid, arm, has_gold``: whether the k best of the dense and of the fused order hold a gold."""
    dense = window.where(F.col("col") <= k).select("qid", "tid", F.lit("dense").alias("arm"))
    fusion = fused.where(F.col("new_rank") <= k).select("qid", "tid", F.lit("fused").alias("arm"))
    rows = dense.unionByName(fusion).join(gold.select("qid", "tid").distinct().withColumn("g", F.lit(True)), ["qid", "tid"], "left")
    return rows.groupBy("qid", "arm").agg(F.max(F.coalesce("g", F.lit(False))).alias("has_gold"))


def rescued_lost(arms_: DataFrame) -> DataFrame:
    """Queries whose gold only the fused, or only the dense arm has."""
    wide = arms_.groupBy("qid").agg(F.max(F.when(F.col("arm") == "dense", F.col("has_gold"))).alias("d"), F.max(F.when(F.col("arm") == "fused", F.col("has_gold"))).alias("f"))
    return wide.agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("d").cast("double")), 4).alias("dense_rate"),
        F.round(F.avg(F.col("f").cast("double")), 4).alias("fused_rate"),
        F.count_if(F.col("f") & ~F.col("d")).alias("rescued"),
        F.count_if(F.col("d") & ~F.col("f")).alias("lost"),
    )


def dedup_shortlists(items: DataFrame) -> DataFrame:
    """``item, owner``: items (``item, query, tid`` rows) with the same query and set of candidates share the first as owner."""
    sets = items.groupBy("item", "query").agg(F.array_sort(F.collect_set("tid")).alias("set"))
    keyed = sets.withColumn("key", F.sha2(F.concat_ws("|", "query", F.to_json("set")), 256))
    owners = keyed.groupBy("key").agg(F.min("item").alias("owner"))
    return keyed.join(owners, "key").select("item", "owner")


def with_answers(items: DataFrame, owners: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers of the owners for all items; missing ones stay null."""
    return items.join(owners, "item", "left").join(answers.withColumnRenamed("item", "owner"), "owner", "left").withColumn("missing", F.col("choice").isNull())


def paired_items(rows: DataFrame) -> DataFrame:
    """Items answered in both arms, side by side."""
    side = lambda a: rows.where((F.col("arm") == a) & F.col("choice").isNotNull()).select("split", "item", F.col("correct").alias(a))
    return side("dense").join(side("fused"), ["split", "item"])
