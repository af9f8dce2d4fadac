"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by size. In a partition with at most u shingles an item is represented by its k(u) smallest shingle
hashes (a bottom-k MinHash sketch), k(u) = u - ceil(t * u) + 1. A document that contains a share t of an item's shingles
misses at most n - ceil(t * n) of them, so it holds at least one shingle of the sketch: the probe loses nothing. Candidates
are then verified by exact containment of the shingles themselves, not of their hashes.

Shingles are five words of lower-cased letters and digits; a text with fewer words has its whole sequence as one shingle,
a text without words has none and matches nothing. Documents are also probed with the shorter shingles of the lengths that items of
fewer than five words have (none, where there are no such items), so that a short item is found inside a longer text as well.

Defined cases: null or empty texts never match; repeated items or rows give the same pair once per doc_id and item_id
(the highest containment); rows with a null id are kept under that null; empty tables give no pairs; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import free_name, join_bounded, let
from siftwell.sources.scratch import materialise, table

SHINGLE = 5
MIN_CONTAINMENT = 0.8
#: Sketch rows (16 bytes each) and ids of candidate documents that may be broadcast; beyond it the joins shuffle.
BROADCAST_SKETCH = 1_000_000
BROADCAST_IDS = 2_000_000
#: Characters of the items that all candidate documents together may be sent by broadcast; beyond it those documents shuffle.
BROADCAST_CHARS = 16 << 20


def item_words(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def _windows(w: Column, k: int) -> Column:
    n = F.size(w)
    whole = F.array(F.concat_ws(" ", w))
    empty = F.slice(whole, 1, 0)
    return F.when(n == 0, empty).when(n < k, whole).otherwise(
        F.transform(F.slice(w, 1, F.greatest(n - (k - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *[w[i + j] for j in range(1, k)]))
    )


def shingles(text: Column, k: int = SHINGLE, short: list[int] | None = None) -> Column:
    """Shingle strings in order, repeats included; after them those of the lengths ``short``, of texts with as many words."""
    inside = lambda w: [F.when(F.size(w) >= n, _windows(w, n)).otherwise(F.array().cast("array<string>")) for n in short or ()]
    return let(item_words(text), lambda w: F.concat(_windows(w, k), *inside(w)) if short else _windows(w, k))


def sketch_length(t: float) -> Column:
    """k(u) for the power-of-two size partition that holds ``n``."""
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")) - 1e-9))
    return F.least(F.col("n"), (upper - F.ceil(upper * t - 1e-9) + 1).cast("int"))


def contaminated(docs: DataFrame, items: DataFrame, min_containment: float = MIN_CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` for every pair with containment of at least the threshold."""
    hashed = lambda a: F.transform(a, lambda s: F.xxhash64(s))
    item = items.select("item_id", F.array_distinct(shingles(F.col("text"), k)).alias("s")).withColumn("n", F.size("s")).where("n > 0")
    in_first = F.size(F.split(F.col("s")[0], " "))
    item = materialise(item.withColumn("item_key", F.xxhash64("item_id", "s")).dropDuplicates(["item_id", "s"]), "items")
    sketch = item.select("item_key", F.explode(F.slice(F.sort_array(hashed(F.col("s"))), F.lit(1), sketch_length(min_containment))).alias("h"))
    sketch = materialise(sketch, "item-sketch")
    n_sketch = sketch.count()
    short = sorted(r[0] for r in item.select(in_first.alias("words")).where(F.col("words") < k).distinct().collect())

    probe = docs.select("doc_id", F.explode(hashed(shingles(F.col("text"), k, short))).alias("h"))
    pairs = materialise(join_bounded(probe, sketch, "h", "inner", n_sketch, BROADCAST_SKETCH).select("doc_id", "item_key").distinct(), "candidates")
    chars = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    n_chars = pairs.join(item.select("item_key", chars.alias("chars")), "item_key").agg(F.sum("chars")).first()[0] or 0

    # The shingles of each candidate item go to the document, which is then read once more, only where it is a candidate.
    wanted = pairs.join(item, "item_key").select(F.col("doc_id").alias("_id"), "item_id", "n", "s")
    some = docs.select("doc_id", "text")
    if n_chars > BROADCAST_CHARS:
        ids = materialise(pairs.select(F.col("doc_id").alias("_id")).distinct(), "candidate-ids")
        some = join_bounded(some, ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi", ids.count(), BROADCAST_IDS)
    found = join_bounded(some, wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "inner", n_chars, BROADCAST_CHARS)
    shared = F.size(F.array_intersect(F.col("s"), shingles(F.col("text"), k, short)))
    checked = found.select("doc_id", "item_id", F.col("n").alias("n_shingles"), shared.alias("n_shared"))
    checked = checked.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * min_containment - 1e-9))
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_shingles"), "n_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n_shingles").cast("long").alias("n_shingles"), F.col("b.n_shared").cast("long").alias("n_shared"), F.round("b.col1", 6).alias("containment"))


def clean_documents(docs: DataFrame, items: DataFrame, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """``docs`` without the documents that contain an item."""
    own = free_name(docs.columns, "hit_id")
    hits = materialise(contaminated(docs, items, min_containment).select(F.col("doc_id").alias(own)).distinct(), "contaminated")
    return join_bounded(docs, hits, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti", hits.count(), BROADCAST_IDS)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda a: a <> '') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda a: a <> '') FROM benchmark
), s AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4]) END) AS s
  FROM w WHERE len(w) > 0
  UNION
  SELECT 0, id, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS s
  FROM w JOIN (SELECT DISTINCT len(w) AS l FROM w WHERE kind = 1 AND len(w) BETWEEN 1 AND 4) AS short ON kind = 0 AND len(w) >= l
), n AS (SELECT id, count(*) AS n_shingles FROM s WHERE kind = 1 GROUP BY id),
p AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.s = i.s WHERE d.kind = 0 AND i.kind = 1 GROUP BY ALL
)
SELECT doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles::DOUBLE, 6) AS containment
FROM p JOIN n ON p.item_id = n.id WHERE n_shared >= ceil(n_shingles * 0.8::DOUBLE - 1e-9)
"""
