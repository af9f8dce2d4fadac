"""Ranks, per-query scores, top-k, samples and batches. Rows of a query are told apart by a position, which breaks ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score(score: str = "score", by: str = "qid", pos: str = "tid"):
    return Window.partitionBy(by).orderBy(F.desc(score), pos)


def stable_rank(score: str = "score", by: str = "qid", pos: str = "tid") -> Column:
    return F.row_number().over(by_score(score, by, pos))


def worst_tie_rank(score: str = "score", by: str = "qid") -> Column:
    """Rows that score at least as high: equal scores share the worst rank of their group."""
    return F.count("*").over(Window.partitionBy(by).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")


def zscore(score: str = "score", by: str = "qid") -> Column:
    """Population z-score over the query's rows at hand."""
    w = Window.partitionBy(by)
    return (F.col(score) - F.avg(score).over(w)) / (F.stddev_pop(score).over(w) + 1e-9)


def top_k(df: DataFrame, k: int, score: str = "score", by: str = "qid", pos: str = "tid") -> DataFrame:
    return df.withColumn("rank", stable_rank(score, by, pos)).where(F.col("rank") <= k)


def nearest(df: DataFrame, score: str = "score", by: str = "qid", pos: str = "tid") -> DataFrame:
    """The best row of each query, the first position on a tie, without a sort."""
    best = df.groupBy(by).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(pos)).alias("p"))).alias("best"))
    return best.select(by, (-F.col("best.p")).alias(pos), F.col("best.s").alias(score))


def hash_order(seed, *keys: str) -> list[Column]:
    """Reproducible shuffle: by md5 of seed and keys, then by the keys."""
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])), *[F.col(k) for k in keys]]


def sample_rows(df: DataFrame, n: int, seed, *keys: str) -> DataFrame:
    return df.orderBy(*hash_order(seed, *keys)).limit(n)


def cap_per_group(df: DataFrame, group: str, cap: int, seed, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*hash_order(seed, *keys)))
    return df.withColumn("pick", rank).where(F.col("pick") <= cap)


def stratified_cap(df: DataFrame, group: str, cap: int, n: int, seed, *keys: str) -> DataFrame:
    """At most ``cap`` rows a group, then ``n`` of those, both in hash order."""
    return sample_rows(cap_per_group(df, group, cap, seed, *keys).drop("pick"), n, seed, *keys)


def first_rows(df: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(pos))).where(F.col("nth") <= n)


def first_of_key(df: DataFrame, key: str, pos: str) -> DataFrame:
    """First row of each key in order of arrival."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("_nth = 1").drop("_nth")


def reorder_head(df: DataFrame, depth: int, score: str, by: str = "qid", col: str = "col") -> Column:
    """New rank: the first ``depth`` columns by score, the tail as it stands."""
    tail = F.col(col) > depth
    return F.row_number().over(Window.partitionBy(by).orderBy(tail, F.when(~tail, -F.col(score)), col))


def rerank_depths(df: DataFrame, depths: list[int], score: str, by: str = "qid", col: str = "col") -> DataFrame:
    """Replacement rerank at several depths from one pass of scores: ``depth`` and ``new_rank`` on every row."""
    wide = df.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in depths])))
    tail = F.col(col) > F.col("depth")
    return wide.withColumn("new_rank", F.row_number().over(Window.partitionBy("depth", by).orderBy(tail, F.when(~tail, -F.col(score)), col)))


def in_batches(df: DataFrame, group: str, pos: str, size: int) -> DataFrame:
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(pos)) - 1) / size).cast("long"))
