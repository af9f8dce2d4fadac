"""Leakage-free splits of labeled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import dedup_key
from siftwell.operators.graph import connected_components
from siftwell.operators.indexing import with_global_index, with_running_total
from siftwell.operators.ranking import first_of_key, hash_order
from siftwell.operators.similarity import blocks, flags_above
from siftwell.sources.scratch import materialise


def dedup_queries(intents: DataFrame, query: str = "query", pos: str = "pos") -> DataFrame:
    """First query of each key, whatever its label."""
    return first_of_key(intents.withColumn("key", dedup_key(F.col(query))), "key", pos)


def hold_out(tools: DataFrame, key: str, share: float, seed) -> DataFrame:
    """Distinct tools with ``is_heldout``: exactly floor(share * count) of them, the first in hash order."""
    distinct = tools.select(key).distinct()
    ranked = materialise(with_global_index(distinct, hash_order(seed, key), "k"), "holdout")
    n = int(share * ranked.count())
    return ranked.select(key, (F.col("k") < n).alias("is_heldout"))


def route(intents: DataFrame, golds: DataFrame, held: DataFrame, seed, test: float = 0.20, dev: float = 0.12) -> DataFrame:
    """``split`` of each intent: C for any held-out gold, F for several golds, else test, dev or train by a hash of the id."""
    per = golds.join(held, "tool_id", "left").groupBy("intent_id").agg(F.max(F.coalesce("is_heldout", F.lit(False))).alias("any_held"), F.count("*").alias("n_gold"))
    r = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("intent_id").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    split = F.when(F.col("any_held"), "C_unseen_tools").when(F.col("n_gold") > 1, "F_ambiguous_multi").when(r < test, "test_A").when(r < test + dev, "dev_A").otherwise("train")
    return intents.join(per, "intent_id").withColumn("split", split).drop("any_held", "n_gold")


def confusable_components(pairs: DataFrame) -> DataFrame:
    """Components of the confusion graph ``a, b``."""
    return connected_components(pairs)


def partition_components(intents: DataFrame, components: DataFrame, dev_frac: float, seed) -> DataFrame:
    """``intent_id, side``: whole components go to dev, in hash order, while fewer than the target share are there.

    Intents without a gold (``tool`` null) are cut at int(dev_frac * n) in hash order.
    """
    anchored = intents.where("tool IS NOT NULL").join(components.select(F.col("node").alias("tool"), "component"), "tool", "left")
    anchored = anchored.withColumn("component", F.coalesce("component", "tool"))
    sizes = materialise(anchored.groupBy("component").agg(F.count("*").alias("n")), "component-sizes")
    target = dev_frac * (sizes.agg(F.sum("n")).first()[0] or 0)
    sides = with_running_total(sizes, hash_order(seed, "component"), "n", "before").select("component", F.when(F.col("before") < target, "dev").otherwise("test").alias("side"))
    free = materialise(with_global_index(intents.where("tool IS NULL").select("intent_id"), hash_order(seed, "intent_id"), "k"), "anchorless")
    cut = int(dev_frac * free.count())
    return anchored.join(sides, "component").select("intent_id", "side").unionByName(free.select("intent_id", F.when(F.col("k") < cut, "dev").otherwise("test").alias("side")))


def drop_near_dups(partition: DataFrame, vectors: DataFrame, most: float = 0.95) -> DataFrame:
    """Dev-side intents with a test-side intent of a similarity above ``most`` become ``dropped``.

    The dev side is the query set of a pruned join, which sends one flag an intent and no pairs.
    """
    sided = vectors.join(partition, "intent_id")
    dev = sided.where("side = 'dev'").select(F.col("intent_id").alias("qid"), F.col("v").alias("qv"))
    test = sided.where("side = 'test'").select(F.col("intent_id").alias("tid"), "v")
    hits = flags_above(blocks(dev, test, most)).select(F.col("qid").alias("intent_id"), F.lit(True).alias("hit"))
    return partition.join(hits, "intent_id", "left").select("intent_id", F.when(F.col("hit"), "dropped").otherwise(F.col("side")).alias("side"))


def audit(partition: DataFrame, golds: DataFrame) -> DataFrame:
    """Tools on both sides; a sound partition has none."""
    kept = partition.where("side <> 'dropped'").join(golds, "intent_id")
    return kept.groupBy("tool_id").agg(F.count_distinct("side").alias("sides")).where("sides > 1")


def partition_stats(partition: DataFrame) -> DataFrame:
    return partition.agg(*[F.count_if(F.col("side") == s).alias(s) for s in ("dev", "test", "dropped")])


def select_split(intents: DataFrame, partition: DataFrame, side: str) -> DataFrame:
    """Intents on a side of the manifest; an empty split is an error."""
    out = intents.join(partition.where(F.col("side") == side).select("intent_id"), "intent_id", "left_semi")
    if out.isEmpty():
        raise ValueError(f"the partition leaves no intent on side {side}")
    return out
