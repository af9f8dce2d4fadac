"""Mixing sources to target weights.

Sizes are summed by source, targets are filled by weight up to a cap, each source gets a repetition rate, and every
document is emitted floor(rate) times plus one copy drawn by a hash of its id with probability equal to the fraction.

Defined cases: a null text has size 0; a null source is the last source; a null doc_id draws like any other id; repeated
rows draw alike; an empty table gives an empty mix; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import free_name, join_bounded, unit_hash, words
from siftwell.operators.indexing import with_global_index
from siftwell.sources.scratch import materialise, table

WEIGHT_CYCLE = 3
MAX_REPEAT = 3
SEED = "mix-1"
MIX_COLUMNS = ("mix_size", "mix_source_size", "mix_target", "mix_rate", "mix_copies")
#: Source targets are broadcast up to this many sources; beyond it the join shuffles.
BROADCAST_SOURCES = 500_000


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``source, source_size, weight, target`` for rows ``source, size``.

    Weights are 1, 2, 3, 1, ... by ascending source. Targets are ``level * weight`` cut at ``max_repeat`` times the size;
    the level rises, one pass over the source table a time, until the targets sum to the total.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_global_index(by_source, [F.col("source").asc_nulls_last()], "rank")
    ranked = materialise(ranked.withColumn("weight", (F.col("rank") % WEIGHT_CYCLE + 1).cast("long")).drop("rank"), "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * max_repeat
    level = 0.0
    while total:
        full = cap <= F.col("weight") * level
        m = ranked.agg(F.sum(F.when(full, cap)).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        higher = (total - (m["capped"] or 0)) / m["open"] if m["open"] else level
        if higher <= level:
            break
        level = higher
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), cap.cast("double")))


def mix(docs: DataFrame, size: Column | None = None, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """All rows of ``docs``, then MIX_COLUMNS, which get leading underscores where ``docs`` has such a column."""
    own = [free_name([*docs.columns, *MIX_COLUMNS], c) if c in {x.lower() for x in docs.columns} else c for c in MIX_COLUMNS]
    source = free_name([*docs.columns, *own], "mix_of_source")
    mix_size, mix_source_size, mix_target, mix_rate, mix_copies = own
    size = word_count(F.col("text")) if size is None else size
    targets = materialise(source_targets(docs.select("source", size.alias("size")), max_repeat), "mix-targets")
    n = targets.count()
    t = targets.select(F.col("source").alias(source), F.col("source_size").alias(mix_source_size), F.col("target").alias(mix_target))
    out = join_bounded(docs.withColumn(mix_size, size), t, F.col("source").eqNullSafe(F.col(source)), "left", n, BROADCAST_SOURCES).drop(source)
    rate = F.when(F.col(mix_source_size) > 0, F.least(F.col(mix_target) / F.col(mix_source_size), F.lit(float(max_repeat)))).otherwise(0.0)
    out = out.withColumn(mix_rate, rate)
    whole = F.floor(F.col(mix_rate))
    draw = unit_hash(F.lit(seed), F.col("doc_id")) < F.col(mix_rate) - whole
    return out.withColumn(mix_copies, (whole + draw.cast("long")).cast("int"))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` as often as its copies say, without the mix columns."""
    *kept, copies = [*mixed.columns[: -len(MIX_COLUMNS)], mixed.columns[-1]]
    number = free_name(mixed.columns, "mix_copy")
    return mixed.where(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in kept])


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    docs = table(spark, sf_dir, "documents")
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("n")), "mix-sizes")
    return mix(sized, F.col("n")).select(
        "doc_id",
        F.col("mix_size").alias("size"),
        F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"),
        (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), o AS (
  SELECT *, sum(3 * s) OVER k AS capped, sum(w) OVER () - sum(w) OVER k AS open, sum(s) OVER () AS total,
         lead(3.0 * s / w) OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS nxt
  FROM s WINDOW k AS (ORDER BY 3.0 * s / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT coalesce((SELECT min(total / w_all) FROM (SELECT any_value(total)::DOUBLE AS total, sum(w)::DOUBLE AS w_all, min(3.0 * s / w) AS first FROM o) WHERE total / w_all <= first),
                  (SELECT min((total - capped) / open) FROM o WHERE open > 0 AND (total - capped) / open <= nxt AND (total - capped) / open >= 3.0 * s / w), 0) AS level
), t AS (
  SELECT source, s, least(w * level, 3.0 * s)::DOUBLE AS target FROM s, l
), r AS (
  SELECT doc_id, size, s, target, CASE WHEN s > 0 THEN least(target / s, 3.0) ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, s AS source_size, target,
       (size * (floor(rate) + (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate))::INT))::BIGINT AS taken
FROM r
"""
