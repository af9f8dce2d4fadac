"""Retrieval metrics and their analysis, from one rank a query (null: the gold was not found)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10, 25, 50, 100)
MISS = 10**6


def hit(rank: Column, k: int) -> Column:
    return F.coalesce(rank <= k, F.lit(False)).cast("double")


def recall_mrr(ranks: DataFrame, by: list[str] | None = None, ks=KS, depth: int = 100, rank: str = "rank") -> DataFrame:
    """``n``, ``r_at_k`` and ``mrr``, rounded to 4 digits. A query without a rank counts as a miss."""
    r = F.col(rank)
    aggs = [F.count("*").alias("n"), *[F.round(F.avg(hit(r, k)), 4).alias(f"r_at_{k}") for k in ks]]
    aggs.append(F.round(F.avg(F.when(r <= depth, 1.0 / r).otherwise(0.0)), 4).alias("mrr"))
    return ranks.groupBy(*(by or [])).agg(*aggs)


def best_gold_rank(ranked: DataFrame, gold: DataFrame, queries: DataFrame | None = None, by: str = "qid", rank: str = "rank") -> DataFrame:
    """``qid, rank``: smallest rank over the golds. ``queries`` keeps those without any gold in the list, with a null rank."""
    found = ranked.join(gold.select(by, "tid").distinct(), [by, "tid"]).groupBy(by).agg(F.min(rank).alias("rank"))
    return found if queries is None else queries.select(by).distinct().join(found, by, "left")


def best_gold(ranked: DataFrame, gold: DataFrame, by: str = "qid") -> DataFrame:
    """The gold with the smallest rank, the first listed on a tie (``gold_idx``)."""
    rows = ranked.join(gold.select(by, "tid", "gold_idx"), [by, "tid"])
    best = rows.groupBy(by).agg(F.min(F.struct("rank", "gold_idx", "tid")).alias("b"))
    return best.select(by, F.col("b.tid").alias("tid"), F.col("b.rank").alias("rank"))


def drop_without_gold(queries: DataFrame, gold: DataFrame, catalog: DataFrame, by: str = "qid") -> DataFrame:
    """Queries with at least one gold in the catalog."""
    return queries.join(gold.join(catalog.select("tid"), "tid", "left_semi").select(by).distinct(), by, "left_semi")


def mean_top1(scores: DataFrame, by: str = "qid") -> DataFrame:
    return scores.groupBy(by).agg(F.max("score").alias("s")).agg(F.round(F.avg("s"), 4).alias("mean_top1"))


def bucket_stats(items: DataFrame, bucket: str, ks=(1, 10, 25), miss_at: int = 10) -> DataFrame:
    """R@k of each bucket, its share of the items and of the misses at ``miss_at`` (0 without misses)."""
    miss = 1 - hit(F.col("rank"), miss_at)
    rows = items.groupBy(bucket).agg(F.count("*").alias("n"), F.sum(miss).alias("miss"), *[F.round(F.avg(hit(F.col("rank"), k)), 4).alias(f"r_at_{k}") for k in ks])
    totals = items.agg(F.count("*").alias("all_n"), F.sum(miss).alias("all_miss"))
    out = rows.join(F.broadcast(totals))
    share = F.when(F.col("all_miss") > 0, F.col("miss") / F.col("all_miss")).otherwise(0.0)
    return out.select(bucket, "n", *[f"r_at_{k}" for k in ks], F.round(F.col("n") / F.col("all_n"), 4).alias("share_items"), F.round(share, 4).alias("share_misses"))


def headroom(items: DataFrame, bucket: str, reference, ks=(1, 10, 25)) -> DataFrame:
    """Recall gained if every bucket below the reference bucket were as good as it; null without a reference bucket."""
    rows = items.groupBy(bucket).agg(F.count("*").alias("n"), *[F.avg(hit(F.col("rank"), k)).alias(f"r{k}") for k in ks])
    ref = rows.where(F.col(bucket) == F.lit(reference)).agg(*[F.max(f"r{k}").alias(f"ref{k}") for k in ks])
    # greatest() skips nulls, so a missing reference is kept null by the outer condition.
    gain = lambda k: F.when(F.max(f"ref{k}").isNotNull(), F.sum(F.col("n") * F.greatest(F.lit(0.0), F.col(f"ref{k}") - F.col(f"r{k}"))) / F.sum("n"))
    return rows.join(F.broadcast(ref)).agg(*[F.round(gain(k), 4).alias(f"headroom_{k}") for k in ks])


def representation_ratio(gold: DataFrame, catalog: DataFrame, bucket: str) -> DataFrame:
    """Share of a bucket among golds over its share in the catalog; null where the catalog has none."""
    side = lambda d, c: d.groupBy(bucket).agg(F.count("*").alias(c))
    rows = side(gold, "gold_n").join(side(catalog, "catalog_n"), bucket, "full").fillna(0, ["gold_n", "catalog_n"])
    totals = rows.agg(F.sum("gold_n").alias("g"), F.sum("catalog_n").alias("c"))
    out = rows.join(F.broadcast(totals))
    ratio = (F.col("gold_n") / F.nullif(F.col("g"), F.lit(0))) / F.nullif(F.col("catalog_n") / F.nullif(F.col("c"), F.lit(0)), F.lit(0.0))
    return out.select(bucket, "gold_n", "catalog_n", F.round(ratio, 4).alias("ratio"))


def macro_mean(metrics: DataFrame, config: str, value: str) -> DataFrame:
    """Unweighted mean over splits."""
    return metrics.groupBy(config).agg(F.avg(value).alias("macro"))


def best_config(metrics: DataFrame, config: str, value: str) -> DataFrame:
    """The configuration with the highest mean over splits, the first name on a tie."""
    means = macro_mean(metrics, config, value).withColumn("m", F.round("macro", 6))
    best = means.agg(F.min(F.struct((-F.col("m")).alias("m"), F.col(config).alias("c"))).alias("b"))
    return best.select(F.col("b.c").alias(config), (-F.col("b.m")).alias("macro"))


def sign_split(metrics: DataFrame, baseline: str, anchors: list[str]) -> DataFrame:
    """Mean delta to the baseline over anchor and over other splits, and whether they part: anchor below 0, others above."""
    base = metrics.where(F.col("config") == baseline).select("split", F.col("value").alias("base"))
    delta = metrics.where(F.col("config") != baseline).join(base, "split").withColumn("d", F.col("value") - F.col("base"))
    anchor = F.col("split").isin(anchors)
    out = delta.groupBy("config").agg(F.round(F.avg(F.when(anchor, F.col("d"))), 4).alias("anchor_delta"), F.round(F.avg(F.when(~anchor, F.col("d"))), 4).alias("other_delta"))
    return out.withColumn("parts", (F.col("anchor_delta") < 0) & (F.col("other_delta") > 0))


def with_pooled(items: DataFrame, members: Column, name: str = "POOLED_generated") -> DataFrame:
    """Items of chosen splits once more under one pooled split (micro average)."""
    return items.unionByName(items.where(members).withColumn("split", F.lit(name)))


def selector_tally(work: DataFrame, answers: DataFrame, by: str = "split") -> DataFrame:
    """Counts of a selector's answers: correct, none (an answer of NONE), tied, missing; accuracy over what was answered."""
    rows = work.join(answers, "id", "left")
    answered = F.col("choice").isNotNull()
    right = answered & F.coalesce(F.col("choice") == F.col("gold"), F.lit(False))
    out = rows.groupBy(by).agg(
        F.count("*").alias("items"),
        F.count_if(answered).alias("n"),
        F.count_if(right).alias("correct"),
        F.count_if(answered & (F.col("choice") == "NONE")).alias("none"),
        F.count_if(answered & F.coalesce(F.col("tied"), F.lit(False))).alias("tied"),
        F.count_if(~answered).alias("missing"),
    )
    return out.withColumn("accuracy", F.round(F.col("correct") / F.greatest(F.col("n"), F.lit(1)), 4))


def conditional_accuracy(rows: DataFrame, by: str = "split") -> DataFrame:
    """Accuracy over all rows, and over those with the gold in the shortlist (null without any)."""
    correct = F.col("correct").cast("double")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(correct), 4).alias("end_to_end"), F.round(F.avg(F.when(F.col("has_gold"), correct)), 4).alias("given_gold"))


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of two runs whose values differ by more than the tolerance."""
    joined = a.select(*keys, F.col(value).alias("left")).join(b.select(*keys, F.col(value).alias("right")), keys)
    return joined.where(F.abs(F.col("left") - F.col("right")) > tolerance)


def evaluate_splits(items: DataFrame, scores: DataFrame, gold: DataFrame, catalog: DataFrame, ks=(1, 10, 25), thin: Column | None = None) -> DataFrame:
    """``split, queries, mean_top1, n, r_at_k, mrr`` of ``items`` (``split, qid``), with ``thin`` also of its items as ``split:thin``.

    Items without a gold in the catalog leave the recall but stay in the mean best similarity; a split of none but such items
    has that alone. ``scores``: ``qid, score, rank`` and ``tid``.
    """
    rows = items if thin is None else items.unionByName(items.where(thin).withColumn("split", F.concat("split", F.lit(":thin"))))
    top = rows.join(scores.groupBy("qid").agg(F.max("score").alias("s")), "qid").groupBy("split").agg(F.count("*").alias("queries"), F.round(F.avg("s"), 4).alias("mean_top1"))
    usable = drop_without_gold(rows, gold, catalog).select("split", "qid")
    return top.join(recall_mrr(usable.join(best_gold_rank(scores, gold), "qid", "left"), ["split"], ks), "split", "left")


def random_control(metrics: DataFrame, at: str = "r_at_100", ks=(1, 10, 25), depth: int = 100) -> DataFrame:
    """What a random order of the first ``depth`` would give: its recall shared out evenly over the places."""
    return metrics.withColumns({f"random_at_{k}": F.round(F.col(at) * k / depth, 4) for k in ks})


def mean_words(docs: DataFrame, words: Column, by: list[str] | None = None) -> DataFrame:
    """Mean number of words of a document, over all or by groups."""
    return docs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.round(F.avg(words), 4).alias("mean_words"))


def run_label(*parts: Column) -> Column:
    """Name of a run: what is known of its model, text and prefixes; nulls and empty strings are left out."""
    return F.concat_ws("|", *[F.nullif(p, F.lit("")) for p in parts])


def deltas(metrics: DataFrame, run: str, baseline: str, by: list[str], values: list[str]) -> DataFrame:
    """Every run's metrics and their differences to the baseline's of the same ``by``; the baseline has no row of its own."""
    base = metrics.where(F.col(run) == baseline).select(*by, *[F.col(v).alias(f"_{v}") for v in values])
    rows = metrics.where(F.col(run) != baseline).join(base, by)
    return rows.select(run, *by, *values, *[F.round(F.col(v) - F.col(f"_{v}"), 4).alias(f"d_{v}") for v in values])


def report(metrics: DataFrame, rows: str, columns: str, names: list, value: str) -> DataFrame:
    """One line for each of ``rows``, one column for each of ``names``."""
    return metrics.groupBy(rows).pivot(columns, names).agg(F.first(value))


def separable(flag: Column, asked: str) -> Column:
    """Three-valued flag: ``true``, ``false`` (marked so) or ``falsy`` (marked so or not marked)."""
    return {"true": F.coalesce(flag, F.lit(False)), "false": F.coalesce(~flag, F.lit(False)), "falsy": ~F.coalesce(flag, F.lit(False))}[asked]


def at_edge(rank: Column) -> Column:
    """Ranks as they leave the engine: a miss is MISS."""
    return F.coalesce(rank, F.lit(MISS))
