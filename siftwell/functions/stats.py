"""Paired significance: exact McNemar and bootstrap intervals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOTSTRAP = 10_000
SEED = 7
#: Fractions are summed as whole numbers of 1 / SCALE.
SCALE = 10**9


def rounded(c: Column, digits: int) -> Column:
    """``c`` (double) to ``digits`` places as SQL on doubles has it: the scaled double to the nearest whole number, halves away from zero.

    Spark's own ``round`` goes by the decimal digits that a double prints, so 0.40045 becomes 0.4005 there; scaled it is 4004.4999.
    """
    return F.round(c * 10.0**digits, 0) / 10.0**digits


def mcnemar_p(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of discordant counts: min(1, 2 * P(X <= min(b, c))), 1 without any. Sums of log terms."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("long")
    # log C(n, i) grows by log((n - i + 1) / i) from one i to the next.
    zero = F.struct(F.lit(0.0).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log - n * F.log(F.lit(2.0)))).alias("sum"))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), zero, step, lambda a: a["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def reciprocal(rank: Column, depth: int = 100) -> Column:
    return F.when(rank <= depth, 1.0 / rank).otherwise(F.lit(0.0))


def paired_outcomes(pairs: DataFrame, by: list[str], k: int = 1) -> DataFrame:
    """Per group of rows with ``base_rank`` and ``new_rank`` (null: absent): n, R@k and MRR deltas, b, c and McNemar p."""
    hit = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    base, new = hit("base_rank"), hit("new_rank")
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum((new & ~base).cast("long")).alias("b"),
        F.sum((base & ~new).cast("long")).alias("c"),
        F.avg(new.cast("double") - base.cast("double")).alias("d_r"),
        F.avg(F.coalesce(reciprocal(F.col("new_rank")), F.lit(0.0)) - F.coalesce(reciprocal(F.col("base_rank")), F.lit(0.0))).alias("d_mrr"),
    )
    return out.select(*by, "n", "b", "c", F.round("d_r", 4).alias("d_r"), F.round("d_mrr", 4).alias("d_mrr"), F.round(mcnemar_p(F.col("b"), F.col("c")), 6).alias("mcnemar_p"))


def _poisson_steps() -> list[int]:
    """Numbers of 16 bits at which a Poisson variable of mean 1 takes its next value."""
    total, out, term = 0.0, [], math.exp(-1)
    for k in range(1, 9):
        total += term
        out.append(int(65536 * total))
        term /= k
    return out


def replicate_sums(rows: DataFrame, by: list[str], unit: str, sums: list[str], reps: int = BOOTSTRAP, seed: int = SEED) -> DataFrame:
    """``by, rep`` and the weighted totals of the whole-number columns ``sums``, for every replicate of a Poisson bootstrap.

    The weight of a unit in a replicate is Poisson of mean 1, made of 16 bits of an MD5 of seed, unit and block of eight
    replicates. It depends on nothing else, so the totals are sums that Spark adds in part before the exchange, parts of the data can be
    added up later, and any engine with MD5 has the same. Rows of one unit move together: where there are more
    rows than can be weighed one by one, ``unit`` is a bucket of them.
    """
    units = rows.groupBy(*by, F.col(unit).cast("string").alias("_unit")).agg(*[F.sum(c).cast("long").alias(c) for c in sums])
    blocks = units.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-reps // 8) - 1))))
    blocks = blocks.withColumn("_hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("_unit", F.lit("")), F.col("_block").cast("string"))))
    weights = []
    for j in range(8):
        bits = F.conv(F.substring("_hash", 1 + 4 * j, 4), 16, 10).cast("int")
        weights.append(sum(((bits >= t).cast("long") for t in _poisson_steps()), F.lit(0).cast("long")))
    weighed = blocks.select(*by, "_block", *sums, *[w.alias(f"_w{j}") for j, w in enumerate(weights)])
    totals = weighed.groupBy(*by, "_block").agg(*[F.sum(F.col(f"_w{j}") * F.col(c)).alias(f"_{j}_{c}") for j in range(8) for c in sums])
    each = F.explode(F.array(*[F.struct((F.col("_block") * 8 + j).alias("rep"), *[F.col(f"_{j}_{c}").alias(c) for c in sums]) for j in range(8)]))
    return totals.select(*by, each.alias("_e")).select(*by, "_e.*").where(F.col("rep") < reps)


def _interval(c: str, names: tuple[str, str]) -> list[Column]:
    return [F.round(F.percentile(c, F.lit(q)), 6).alias(name) for q, name in zip((0.025, 0.975), names)]


def paired_bootstrap(pairs: DataFrame, by: list[str], unit: str, k: int = 1, reps: int = BOOTSTRAP, seed: int = SEED, depth: int = 100) -> DataFrame:
    """95 % percentile intervals of the R@k and MRR deltas and P(MRR delta <= 0), resampling units (``replicate_sums``).

    Reciprocal ranks are summed in units of 1 / SCALE, so that sums do not depend on their order. A replicate without any unit is
    left out.
    """
    hit = lambda c: F.coalesce(F.col(c) <= k, F.lit(False)).cast("long")
    inverse = lambda c: F.coalesce(reciprocal(F.col(c), depth), F.lit(0.0))
    rows = pairs.select(*by, unit, F.lit(1).alias("m"), (hit("new_rank") - hit("base_rank")).alias("r"), F.round((inverse("new_rank") - inverse("base_rank")) * SCALE).cast("long").alias("q"))
    reps_of = replicate_sums(rows, by, unit, ["m", "r", "q"], reps, seed).where("m > 0")
    each = reps_of.select(*by, (F.col("r") / F.col("m")).alias("d_r"), (F.col("q") / F.col("m") / SCALE).alias("d_m"), (F.col("q") <= 0).cast("double").alias("low"))
    out = each.groupBy(*by).agg(*_interval("d_r", ("r_low", "r_high")), *_interval("d_m", ("mrr_low", "mrr_high")), F.round(F.avg("low"), 6).alias("p_mrr_not_above"))
    return rows.groupBy(*by).agg(F.count("*").alias("n")).join(out, by)


def mean_difference_interval(pairs: DataFrame, by: list[str], a: str, b: str, unit: str, reps: int = BOOTSTRAP, seed: int = SEED) -> DataFrame:
    """``by, n, mean_delta, low, high``: the mean of ``b - a`` over paired rows and its 95 % interval, resampling units."""
    rows = pairs.select(*by, unit, F.lit(1).alias("m"), F.round((F.col(b).cast("double") - F.col(a).cast("double")) * SCALE).cast("long").alias("d"))
    each = replicate_sums(rows, by, unit, ["m", "d"], reps, seed).where("m > 0").select(*by, (F.col("d") / F.col("m") / SCALE).alias("mean"))
    known = rows.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("d") / F.count("*") / SCALE, 6).alias("mean_delta"))
    return known.join(each.groupBy(*by).agg(*_interval("mean", ("low", "high"))), by)


def claim_table(pairs: DataFrame, claim: str = "claim", split: str = "split", pooled: str = "POOLED_generated", members: Column | None = None, k: int = 1) -> DataFrame:
    """Outcomes of every claim on each split, and on the pooled splits of ``members``."""
    rows = pairs if members is None else pairs.unionByName(pairs.where(members).withColumn(split, F.lit(pooled)))
    return paired_outcomes(rows, [claim, split], k)


def plateau(metrics: DataFrame, by: list[str], x: str = "alpha", value: str = "value", within: float = 0.005) -> DataFrame:
    """``by, best, low, high``: the best value over ``x`` and the range of ``x`` that comes within ``within`` of it."""
    best = metrics.groupBy(*by).agg(F.max(value).alias("best"))
    near = metrics.join(best, by).where(F.col(value) >= F.col("best") - within - 1e-9)
    return near.groupBy(*by).agg(F.round(F.max("best"), 4).alias("best"), F.min(x).alias("low"), F.max(x).alias("high"))


def holm(df: DataFrame, family: str, p: str, item: str) -> DataFrame:
    """Holm-Bonferroni adjusted p in each family (an extension; nothing applies it by default)."""
    from pyspark.sql import Window

    w = Window.partitionBy(family).orderBy(p, item)
    m = F.count("*").over(Window.partitionBy(family))
    step = F.least(F.lit(1.0), F.col(p) * (m - F.row_number().over(w) + 1))
    return df.withColumn("_step", step).withColumn("p_holm", F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
