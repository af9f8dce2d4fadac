"""BM25 over an inverted index of written tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import tokens
from siftwell.sources.scratch import materialise

K1, B = 1.5, 0.75
DIGITS = 6
#: Distinct terms that may be broadcast, at some 40 bytes each.
BROADCAST_TERMS = 500_000


@dataclass
class Bm25Index:
    """``postings(w, tid, weight)`` with the whole document side of the score, and the corpus means."""

    postings: DataFrame
    terms: DataFrame
    n_docs: int
    mean_length: float


def asked_terms(queries: DataFrame, text: Column) -> DataFrame:
    """``qid, w, times``: the terms of each query, of all its rows, and how often it has them."""
    return queries.select("qid", F.explode(tokens(text)).alias("w")).groupBy("qid", "w").agg(F.count("*").alias("times"))


def build_bm25(docs: DataFrame, text: Column, k1: float = K1, b: float = B, only: DataFrame | None = None) -> Bm25Index:
    """Index ``docs`` (``tid`` and a text). Documents without tokens count in the corpus means.

    ``only`` (``w``): the distinct terms that will be asked for; others are dropped before the exchange, and the corpus means
    stay those of all text.
    """
    lengths = docs.groupBy("tid").agg(F.sum(F.size(tokens(text))).alias("len"))
    n, total = docs.agg(F.count("*"), F.sum(F.size(tokens(text)))).first()
    mean = (total or 0) / n if n else 0.0
    mean = mean or 1.0
    words = docs.select("tid", F.explode(tokens(text)).alias("w"))
    if only is not None:
        words = words.join(F.broadcast(only) if only.count() <= BROADCAST_TERMS else only, "w", "left_semi")
    tf = materialise(words.groupBy("tid", "w").agg(F.count("*").alias("f")), "term-frequencies")
    terms = tf.groupBy("w").agg(F.count("*").alias("df"), F.sum("f").alias("cf"))
    terms = terms.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("len") / mean))
    postings = tf.join(lengths, "tid").join(terms, "w").select("w", "tid", weight.alias("weight"))
    return Bm25Index(materialise(postings, "postings"), terms, n, mean)


def term_stats(docs: DataFrame, text: Column) -> DataFrame:
    """``w, df, cf, idf`` of all terms, as ``build_bm25`` has them, without its postings.

    Both counts are sums that add up by term before the exchange. Rows of one ``tid`` count as one document, so those that are not
    alone are joined first; only their ids and texts are exchanged.
    """
    n = docs.count()
    rows = docs.select("tid", tokens(text).alias("t"))
    again = materialise(rows.groupBy("tid").agg(F.count("*").alias("k")).where("k > 1").select("tid"), "repeated-ids")
    if again.isEmpty():
        every = rows.select("t")
    else:
        same = F.col("tid").eqNullSafe(F.col("other"))
        other = again.withColumnRenamed("tid", "other")
        whole = rows.join(other, same, "left_semi").groupBy("tid").agg(F.flatten(F.collect_list("t")).alias("t"))
        every = rows.join(other, same, "left_anti").select("t").unionByName(whole.select("t"))
    words = every.select(F.explode("t").alias("w"), F.lit(0).alias("one")).unionByName(every.select(F.explode(F.array_distinct("t")).alias("w"), F.lit(1).alias("one")))
    terms = words.groupBy("w").agg(F.sum("one").alias("df"), F.sum(1 - F.col("one")).alias("cf"))
    return terms.withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))


def bm25_scores(index: Bm25Index, queries: DataFrame, text: Column, pool: DataFrame | None = None) -> DataFrame:
    """``qid, tid, score`` of documents that share a term with the query. A term counts once for each time the query has it.

    ``pool`` (``tid``) restricts the documents; the corpus statistics stay those of the whole index.
    """
    asked = asked_terms(queries, text)
    postings = index.postings if pool is None else index.postings.join(pool, "tid", "left_semi")
    hits = postings.join(asked, "w")
    return hits.groupBy("qid", "tid").agg(F.round(F.sum(F.col("weight") * F.col("times")), DIGITS).alias("score"))


def full_scores(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Scores of stated ``pairs`` (``qid, tid``), 0 where no term is shared."""
    return pairs.join(scores, ["qid", "tid"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def nonzero_share(scores: DataFrame, n_queries: int, n_docs: int) -> DataFrame:
    """Share of the query by document grid with a score above 0, without building the grid."""
    return scores.where("score > 0").agg(F.round(F.count("*") / F.lit(max(n_queries * n_docs, 1)), 6).alias("nonzero"))


def pool_ranks(scores: DataFrame, queries: DataFrame, gold: DataFrame, order: DataFrame, sizes: list[int]) -> DataFrame:
    """``pool, qid, rank``: the best rank of a gold in nested pools, for all ``queries`` (null: no gold has a score).

    ``order`` (``tid, nth``): a document is in the pool of a size when ``nth`` is below it; golds are in every pool. Documents
    before the best gold are counted by the smallest pool that holds them, and the counts are added up pool by pool.
    """
    sizes = sorted(set(sizes))
    best = scores.join(gold.select("qid", "tid"), ["qid", "tid"]).groupBy("qid").agg(F.max(F.struct(F.col("score").alias("s"), (-F.col("tid")).alias("p"))).alias("b"))
    best = best.select("qid", F.col("b.s").alias("gs"), (-F.col("b.p")).alias("gt"))
    before = scores.join(best, "qid").where("score > gs OR (score = gs AND tid < gt)").join(order, "tid")
    counts = before.groupBy("qid").agg(*[F.count_if(F.col("nth") < size).alias(f"p{k}") for k, size in enumerate(sizes)])
    ranks = [F.struct(F.lit(size).alias("pool"), F.when(F.col("gs").isNotNull(), F.coalesce(F.col(f"p{k}"), F.lit(0)) + 1).cast("int").alias("rank")) for k, size in enumerate(sizes)]
    rows = queries.select("qid").join(best, "qid", "left").join(counts, "qid", "left")
    return rows.select("qid", F.explode(F.array(*ranks)).alias("e")).select("e.pool", "qid", "e.rank")
