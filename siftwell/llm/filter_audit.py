"""Filter interaction audit: what each of five filters removes in every order, by part of the corpus, with its Shapley value.

A document's failures are a mask of five bits. For every part and label class 32 signed parity sums are added up, the sum of
(-1) to the number of bits that a mask shares with k, for k = 0 to 31. They are linear in the documents, so Spark adds them
in part before the one small exchange, and the sums of label classes add up to those of a label. The Walsh-Hadamard
transform of the sums over 32 gives back the number of documents of every mask exactly. All 120 orders are read off these
cells: a filter at its step removes the masks that hold its bit and none of the earlier bits. The Shapley value, the sum of
what a filter removes over all orders, is 120 over the number of failures, summed over the documents that fail it: among the
filters that a document fails each is the first in as many orders.

Identical texts are those with one SHA-256 digest; the table of digests that occur twice is joined to the documents,
broadcast up to BROADCAST_ROWS, shuffled beyond (adaptive execution splits a hot digest).

Defined cases: a null text is empty; a null source is the part ''; a null doc_id has no label and is neither an earlier nor a
later copy of anything; rows with one doc_id and one text are no copies of each other, since no id is smaller; a document has a
label value when any of its rows in ``labels`` has it; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import join_bounded, let
from siftwell.sources.scratch import materialise, table, temporary

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
#: Labels and repeated digests are broadcast up to this many rows (some 40 bytes each); beyond it the joins shuffle.
BROADCAST_ROWS = 500_000
KINDS = ("n", "good", "toxic")


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: the filters A to D that a text fails."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))

    def bits(w: Column) -> Column:
        n = F.size(w)
        fails = [n < 50, 100 * F.size(F.array_distinct(w)) < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]")]
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    return let(words, bits)


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, good, toxic`` of every document."""
    slim = docs.select(
        "doc_id",
        F.coalesce("source", F.lit("")).alias("part"),
        own_failures(F.col("text")).alias("own"),
        F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"),
    )
    slim = materialise(slim, "audit-documents")
    firsts = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 AND first IS NOT NULL").drop("copies")
    firsts = materialise(firsts, "audit-copies")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(kind) for c, kind in (("quality", "good"), ("toxic", "toxic"))])
    marks = materialise(marks.where("good + toxic > 0"), "audit-labels")
    out = join_bounded(slim, firsts, "digest", "left", firsts.count(), BROADCAST_ROWS)
    out = join_bounded(out, marks, "doc_id", "left", marks.count(), BROADCAST_ROWS)
    later = F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0)
    return out.select("part", (F.col("own") + later).alias("mask"), *[F.coalesce(k, F.lit(0)).alias(k) for k in KINDS[1:]])


def _sign(a: Column, b: Column) -> Column:
    return F.when(F.bit_count(a.bitwiseAND(b)) % 2 == 1, F.lit(-1)).otherwise(F.lit(1)).cast("long")


def parity_sums(masks: DataFrame) -> DataFrame:
    """``part``, then for all, good and toxic documents an array of 32 signed sums."""
    keys = ("part", *KINDS[1:])
    sums = [f"s{k}" for k in range(CELLS)]
    by_class = masks.groupBy(*keys).agg(*[F.sum(_sign(F.col("mask"), F.lit(k))).alias(s) for k, s in enumerate(sums)])
    by_class = by_class.select(*keys, F.lit(1).alias("n"), F.array(*sums).alias("s"))
    added = {kind: [F.sum(F.col("s")[k] * F.col(kind)) for k in range(CELLS)] for kind in KINDS}
    return by_class.groupBy("part").agg(*[F.array(*s).alias(kind) for kind, s in added.items()])


def inverted(sums: Column) -> Column:
    """The number of documents of each mask: the transform is its own inverse but for the factor 32."""
    cells = F.sequence(F.lit(0), F.lit(CELLS - 1))
    return F.transform(cells, lambda m: F.shiftright(F.aggregate(F.zip_with(sums, cells, lambda s, k: s * _sign(k, m)), F.lit(0).cast("long"), lambda a, x: a + x), 5))


def _steps() -> str:
    """Every step of every order: its filter's bit and the bits that went before."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        rows += [{"o": name, "s": k + 1, "f": 1 << f, "b": sum(1 << e for e in order[:k])} for k, f in enumerate(order)]
    return json.dumps(rows)


def evaluate_orders(cells: DataFrame) -> DataFrame:
    """600 rows a part from ``part`` and the arrays of cells of all, good and toxic documents."""
    steps = F.explode(F.from_json(F.lit(_steps()), "array<struct<o:string,s:int,f:int,b:int>>"))
    step = cells.withColumn("e", steps).select("part", *KINDS, F.col("e.o").alias("filter_order"), F.col("e.s").alias("step"), F.col("e.f").alias("f"), F.col("e.b").alias("b"))
    f, b = F.col("f"), F.col("b")

    def total(kind: str, weight) -> Column:
        at = F.sequence(F.lit(0), F.lit(CELLS - 1))
        return F.aggregate(F.zip_with(kind, at, lambda n, m: n * weight(m)), F.lit(0).cast("long"), lambda a, x: a + x)

    fails = lambda m: m.bitwiseAND(f) != 0
    first = lambda m: (fails(m) & (m.bitwiseAND(b) == 0)).cast("long")
    return step.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m: (m.bitwiseAND(f.bitwiseOR(b)) == 0).cast("long")).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: (fails(m) & (m.bitwiseAND(b) != 0)).cast("long")).alias("redundant"),
        F.col("n")[f].alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        total("n", lambda m: F.when(fails(m), (F.lit(120) / F.bit_count(m)).cast("long")).otherwise(0)).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and the counts of the audit; 600 rows for every part that occurs."""
    with temporary(docs.sparkSession) as keep:
        sums = parity_sums(failure_masks(docs, labels))
        cells = keep(materialise(sums.select("part", *[inverted(F.col(k)).alias(k) for k in KINDS]), "audit-cells"))
    return evaluate_orders(cells)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, by source."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), failing AS (
  SELECT d.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS x, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN lab ON lab.doc_id = d.doc_id
), tagged AS (
  SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN x THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS fails
  FROM failing
), cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM tagged GROUP BY part, fails
), orders AS (
  SELECT '' AS o
  UNION ALL
  SELECT o || l FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(l) WHERE NOT contains(o, l)
), steps AS (
  SELECT o AS filter_order, k::INT AS step, substr(o, k::INT, 1) AS f, substr(o, 1, k::INT - 1) AS before FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5
), met AS (
  SELECT part, filter_order, step, c.n, good, toxic, contains(fails, f) AS fail, length(translate(fails, before, '')) < length(fails) AS gone, fails = f AS alone
  FROM cells AS c, steps
), counted AS (
  SELECT part, filter_order, step, sum(CASE WHEN NOT fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fail AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN fail AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN alone THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN fail AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fail AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step
)
SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM counted
"""
