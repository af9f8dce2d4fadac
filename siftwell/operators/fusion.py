"""Fusion of a dense and a second signal over rows ``qid, col, tid, dense, other``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.dense import DIGITS as SCORE_DIGITS
from siftwell.operators.dense import dense_places, dense_topk, dot
from siftwell.operators.ranking import worst_tie_rank
from siftwell.sources.scratch import materialise

RRF_K = 60
RULES = ("zscore", "rrf", "rrf_tie")
ALPHAS = [round(i / 10, 1) for i in range(11)]
DIGITS = 9


def _parts(rule: str, by: str) -> tuple[Column, Column]:
    """The two terms that a weight alpha mixes; they do not depend on alpha."""
    if rule == "zscore":
        w = Window.partitionBy(by)
        return tuple((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-9) for c in ("dense", "other"))
    if rule == "rrf":
        return tuple(1.0 / (RRF_K + F.row_number().over(Window.partitionBy(by).orderBy(F.desc(c), "col"))) for c in ("dense", "other"))
    if rule == "rrf_tie":
        return tuple(1.0 / (RRF_K + worst_tie_rank(c, by)) for c in ("dense", "other"))
    raise ValueError(f"rule must be one of {RULES}")


def fused_score(a: Column, b: Column, alpha) -> Column:
    return F.round((1 - alpha) * a + alpha * b, DIGITS)


def fuse(window: DataFrame, alpha: float, rule: str, depth: int, by: str = "qid") -> DataFrame:
    """Rows with ``fused`` and ``new_rank``: the first ``depth`` columns fused and sorted, the tail in its order."""
    head = window.where(F.col("col") <= depth)
    a, b = _parts(rule, by)
    head = head.withColumn("fused", fused_score(a, b, F.lit(float(alpha))))
    head = head.withColumn("new_rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("fused"), "col")))
    tail = window.where(F.col("col") > depth).withColumns({"fused": F.lit(None).cast("double"), "new_rank": F.col("col")})
    return head.unionByName(tail)


def fuse_full(queries: DataFrame, index: DataFrame, scores: DataFrame, alpha: float, k: int, same: bool = False, first: int = 4) -> DataFrame:
    """``qid, tid, fused, new_rank``: the ``k`` best of the whole index by reciprocal worst-tie ranks of both signals.

    ``scores`` (``qid, tid, other``) are above 0; every other row has 0. Two sorted lists are read, the ``m`` best rows by either
    signal, and the exact ranks of what they hold are counted. A row that is in neither list ranks below ``m`` in both (and with
    all rows of score 0 once the second list is at its end), which bounds its fused score; a query is done when its k-th row is above the
    bound. The others read lists four times as long; lists as long as the index end it. Ties go to the better dense place.
    """
    n = index.where("tid IS NOT NULL AND v IS NOT NULL").count()
    total = max(n - 1 if same else n, 1)
    own = scores.where(F.col("other") > 0).join(index.select("tid"), "tid", "left_semi").join(queries.select("qid"), "qid", "left_semi")
    own = own.where("qid <> tid") if same else own
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("other"), "tid"))
    lists = materialise(own.select("qid", "tid", worst_tie_rank("other").alias("other_rank"), place.alias("place"), F.count("*").over(Window.partitionBy("qid")).alias("listed")), "lexical-lists")
    todo, m, out = queries.select("qid", "qv"), first * k, None
    while True:
        near = dense_topk(todo, index, m, same).select("qid", "tid", "score")
        beside = lists.where(F.col("place") <= m).join(todo, "qid").join(index.select("tid", "v"), "tid")
        beside = beside.select("qid", "tid", F.round(dot(F.col("qv"), F.col("v")), SCORE_DIGITS).alias("score"))
        seen = materialise(near.unionByName(beside.join(near, ["qid", "tid"], "left_anti")), "seen-rows")
        rows = dense_places(seen, todo, index, same).join(lists.select("qid", "tid", "other_rank"), ["qid", "tid"], "left")
        rows = rows.withColumn("fused", fused_score(1.0 / (RRF_K + F.col("worst")), 1.0 / (RRF_K + F.coalesce("other_rank", F.lit(total))), F.lit(float(alpha))))
        rows = rows.withColumn("new_rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("fused"), "col"))).where(F.col("new_rank") <= k)
        ends = lists.select("qid", "listed").distinct()
        unread = F.when(F.coalesce("listed", F.lit(0)) <= m, F.lit(total)).otherwise(F.lit(m + 1))
        bound = fused_score(F.lit(1.0 / (RRF_K + m + 1)), 1.0 / (RRF_K + unread), F.lit(float(alpha)))
        rows = rows.join(ends, "qid", "left").withColumn("done", (F.lit(m) >= total) | (F.min("fused").over(Window.partitionBy("qid")) > bound) & (F.count("*").over(Window.partitionBy("qid")) == k))
        rows = materialise(rows.select("qid", "tid", "fused", "new_rank", "done"), "fused-rows")
        ready = rows.where("done").drop("done")
        out = ready if out is None else out.unionByName(ready)
        open_ids = rows.where("NOT done").select("qid").distinct()
        if open_ids.isEmpty():
            return out
        todo, m = materialise(todo.join(open_ids, "qid", "left_semi"), "open-queries"), 4 * m


def sweep(window: DataFrame, gold: DataFrame, rules=RULES, depths=(10, 25, 50, 100), alphas=tuple(ALPHAS), by: str = "qid") -> DataFrame:
    """``rule, depth, alpha, qid, rank``: the best gold rank for every setting (null: no gold in the window).

    Terms are computed once a rule and depth; the alphas are rows made from them, a grid of fixed size.
    """
    flagged = window.join(gold.select(by, "tid").distinct().withColumn("is_gold", F.lit(True)), [by, "tid"], "left").withColumn("is_gold", F.coalesce("is_gold", F.lit(False)))
    out = None
    for rule in rules:
        for depth in depths:
            head = flagged.where(F.col("col") <= depth)
            a, b = _parts(rule, by)
            head = head.withColumns({"_a": a, "_b": b}).withColumn("alpha", F.explode(F.array(*[F.lit(float(x)) for x in alphas])))
            head = head.withColumn("fused", fused_score(F.col("_a"), F.col("_b"), F.col("alpha")))
            head = head.withColumn("r", F.row_number().over(Window.partitionBy("alpha", by).orderBy(F.desc("fused"), "col")))
            tail = flagged.where(F.col("col") > depth).withColumn("r", F.col("col")).withColumn("alpha", F.explode(F.array(*[F.lit(float(x)) for x in alphas])))
            rows = head.select("alpha", by, "r", "is_gold").unionByName(tail.select("alpha", by, "r", "is_gold"))
            best = rows.groupBy("alpha", by).agg(F.min(F.when(F.col("is_gold"), F.col("r"))).alias("rank"))
            best = best.withColumns({"rule": F.lit(rule), "depth": F.lit(depth)}).select("rule", "depth", "alpha", by, "rank")
            out = best if out is None else out.unionByName(best)
    return out


def union_ceiling(first: DataFrame, second: DataFrame, gold: DataFrame, by: str = "qid") -> DataFrame:
    """Share of queries with a gold in the first list, and in either: what a perfect fusion could add."""
    hit = lambda d, name: d.select(by, "tid").join(gold.select(by, "tid"), [by, "tid"], "left_semi").select(by).distinct().withColumn(name, F.lit(1))
    either = first.select(by, "tid").union(second.select(by, "tid")).distinct()
    queries = gold.select(by).distinct()
    out = queries.join(hit(first, "a"), by, "left").join(hit(either, "u"), by, "left")
    rate = lambda c: F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double"))
    return out.agg(F.round(rate("a"), 4).alias("first"), F.round(rate("u"), 4).alias("either"), F.round(rate("u") - rate("a"), 4).alias("headroom"))
