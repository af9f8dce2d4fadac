"""Hard negatives for contrastive training."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.dense import DIGITS, dot


def hard_negatives(ranked: DataFrame, gold: DataFrame, vectors: DataFrame, depth: int = 50, n_neg: int = 4, max_cos: float = 0.95) -> DataFrame:
    """``qid, negatives``: the first ``n_neg`` candidates of the top ``depth`` that are no gold and not too like any gold.

    Short lists are filled by repeating the last negative; queries without any negative have no row. ``found`` counts the
    negatives before filling, ``dropped`` the candidates that were too alike.
    """
    candidates = ranked.where(F.col("rank") <= depth).join(gold.select("qid", "tid"), ["qid", "tid"], "left_anti")
    v = vectors.select("tid", "v")
    golds = gold.select("qid", F.col("tid").alias("gold")).join(v.withColumnsRenamed({"tid": "gold", "v": "gv"}), "gold").select("qid", "gv")
    alike = candidates.select("qid", "tid", "rank").join(v, "tid").join(golds, "qid", "left")
    near = alike.groupBy("qid", "tid", "rank").agg(F.round(F.max(dot(F.col("v"), F.col("gv"))), DIGITS).alias("cos"))
    near = near.withColumn("ok", ~F.coalesce(F.col("cos") > max_cos, F.lit(False)))
    counted = near.groupBy("qid").agg(F.count_if(~F.col("ok")).alias("dropped"))
    kept = near.where("ok").withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("k") <= n_neg)
    rows = kept.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("k", "tid"))).alias("a"))
    filled = F.transform(F.sequence(F.lit(1), F.lit(n_neg)), lambda i: F.element_at("a", F.least(i, F.size("a")))["tid"])
    return rows.join(counted, "qid").select("qid", filled.alias("negatives"), F.size("a").cast("long").alias("found"), "dropped")


def triplets(negatives: DataFrame, n_neg: int = 4) -> DataFrame:
    """One column a negative."""
    return negatives.select("qid", *[F.col("negatives")[i].alias(f"negative_{i + 1}") for i in range(n_neg)])


def provenance(negatives: DataFrame, catalog: DataFrame, source: str = "source") -> DataFrame:
    """Sources of the mined negatives, fillers left out, with their share."""
    mined = negatives.select(F.explode(F.slice("negatives", F.lit(1), F.col("found").cast("int"))).alias("tid")).join(catalog.select("tid", source), "tid")
    rows = mined.groupBy(source).agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(rows.agg(F.sum("n").alias("all")))).select(source, "n", F.round(F.col("n") / F.col("all"), 4).alias("share"))
