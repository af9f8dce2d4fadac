"""How the driver's tables stand for catalogs, queries, golds and scores.

Vectors: ids divisible by 20 are the queries, the index is all rows; a query's own row is no answer to it. The gold tools of a
query are the first three other rows with its label. Text: documents are the catalog, benchmark items the queries. Every
benchmark item is dealt to a query of the vectors, by its id modulo their number, and lends it the BM25 scores of its terms on
the document with the vector's id, a pairing that tests operators, not quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.text import slug
from siftwell.operators.dense import dense_topk
from siftwell.operators.lexical import Bm25Index, asked_terms, bm25_scores, build_bm25
from siftwell.sources.scratch import materialise, table


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"), "label")


def index(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("tid"), F.col("embedding").alias("v"), "label")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """The first three index rows of the query's label, but for its own."""
    nth = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("tid"))
    first = index(spark, sf).withColumn("nth", nth("label")).where("nth <= 4").select("tid", "label")
    others = queries(spark, sf).select("qid", "label").join(first, "label").where("qid <> tid")
    return others.withColumn("gold_idx", nth("qid")).where("gold_idx <= 3").select("qid", "tid", "gold_idx", "label")


def text_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("tid"), "text")


def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def text_index(spark: SparkSession, sf: str, only: DataFrame | None = None) -> Bm25Index:
    return build_bm25(text_docs(spark, sf), F.col("text"), only=only)


def text_scores(spark: SparkSession, sf: str, asked: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """Scores of text queries over an index of the terms that they have."""
    asked = text_queries(spark, sf) if asked is None else asked
    terms = materialise(asked_terms(asked, F.col("text")).select("w").distinct(), "asked-terms")
    return bm25_scores(text_index(spark, sf, terms), asked, F.col("text"), pool)


def lexical_signal(spark: SparkSession, sf: str) -> DataFrame:
    """``qid, tid, other``: the scores that the benchmark items dealt to a query lend it."""
    dealt = (F.col("qid") % max(queries(spark, sf).count(), 1) * 20).alias("qid")
    return text_scores(spark, sf, text_queries(spark, sf).select(dealt, "text")).withColumnRenamed("score", "other")


def window(spark: SparkSession, sf: str, k: int = 100) -> DataFrame:
    """Dense window ``qid, tid, col, dense, other`` with the lexical signal beside."""
    top = dense_topk(queries(spark, sf), index(spark, sf), k, same=True)
    pairs = top.join(lexical_signal(spark, sf), ["qid", "tid"], "left")
    return materialise(pairs.select("qid", "tid", F.col("rank").alias("col"), F.col("score").alias("dense"), F.coalesce("other", F.lit(0.0)).alias("other")), "window")


def tools(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog from pages (path and parameters of the URL) and documents (name, description, tags)."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("pos"), "url")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.substring_index("text", " ", 2).alias("name"), F.substring("text", 1, 1200).alias("text"), "lang", "source")
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    params = F.regexp_extract_all(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("([A-Za-z_]+)="), F.lit(1))
    return p.join(d, "pos").select(
        "pos", slug(F.col("source"), path).alias("tool_id"), "name", F.substring("text", 1, 300).alias("summary"), F.col("text").alias("description"),
        params.alias("params"), F.array("lang", "source").alias("tags"), F.col("source").alias("api_title"), host.alias("provider"),
        F.element_at(F.array(*map(F.lit, ("get", "post", "put", "patch", "delete"))), (F.col("pos") % 5 + 1).cast("int")).alias("method"), F.concat(path, F.lit("/{itemId}/userName")).alias("path"),
    )
