"""What changed between two snapshots of a catalog, and search results brought up to date without searching all again.

Rows are compared by a digest of their content. A key may have several rows: its content is then all of them, whatever their
order. Null keys are one key. An empty snapshot makes every row of the other added or removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.dense import dense_topk
from siftwell.sources.scratch import materialise


def _contents(catalog: DataFrame, key: str, content: list[str]) -> DataFrame:
    """``key, rows, lanes``: SHA-256 digests summed in lanes of 32 bits, so partial sums add up and no list is collected."""
    digest = F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(8)]
    return catalog.select(key, digest.alias("_d")).groupBy(key).agg(F.struct(F.count("*"), *lanes).alias("_content"))


def catalog_diff(old: DataFrame, new: DataFrame, key: str, content: list[str]) -> DataFrame:
    """``key, status`` of every key of either snapshot: added, removed, changed or same."""
    a = _contents(old, key, content).toDF("_old_key", "_old")
    b = _contents(new, key, content).toDF("_new_key", "_new")
    rows = a.join(b, F.col("_old_key").eqNullSafe(F.col("_new_key")), "full")
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") == F.col("_new"), "same").otherwise("changed")
    return rows.select(F.coalesce("_old_key", "_new_key").alias(key), status.alias("status"))


def _of(*status: str) -> Column:
    return F.col("status").isin(*status)


def refresh_topk(known: DataFrame, queries: DataFrame, old: DataFrame, new: DataFrame, k: int, same: bool = False) -> DataFrame:
    """The k best rows of ``new`` for each query, from those of ``old``: ``qid, tid, score, rank, searched``.

    ``known`` is ``dense_topk(queries, old, k, same)``; both snapshots have one row a ``tid``. A query is searched again in
    all of ``new`` if one of its rows was removed or changed, or if it has none. Any other keeps its rows, and only rows that
    are new or changed are scored for it: an old row beyond its k best cannot enter them.
    """
    diff = materialise(catalog_diff(old, new, "tid", ["v"]).where(~_of("same")), "catalog-diff")
    known = materialise(known.select("qid", "tid", "score"), "known-best")
    hurt = known.join(diff.where(_of("removed", "changed")), "tid", "left_semi").select("qid").distinct()
    whole = materialise(known.select("qid").distinct().join(hurt, "qid", "left_anti"), "unhurt-queries")
    again = dense_topk(queries.join(whole, "qid", "left_anti"), new, k, same).select("qid", "tid", "score", "rank", F.lit(True).alias("searched"))
    fresh = new.join(diff.where(_of("added", "changed")), "tid", "left_semi")
    entered = dense_topk(queries.join(whole, "qid", "left_semi"), fresh, k, same).select("qid", "tid", "score")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "tid"))
    merged = known.join(whole, "qid", "left_semi").unionByName(entered).withColumn("rank", rank).where(F.col("rank") <= k)
    return merged.withColumn("searched", F.lit(False)).unionByName(again)
