"""Host-level quality rules.

Document rules give failures, failures are counted by host, host failure rates are shrunk with an empirical beta prior
fitted over all hosts, and the host verdict is joined back to every document.

Defined cases: a null or empty text has no words and fails the length rule; a null host is a host of its own; repeated
rows are judged and counted each; an empty table gives an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import WORD_BREAKS, join_bounded, let, words
from siftwell.sources.scratch import materialise, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
#: Least weight of the prior in documents, so that one document alone condemns no host.
MIN_PRIOR_DOCS = 2.0
#: Host verdicts are broadcast up to this many hosts (some 50 MB); beyond it the join shuffles.
BROADCAST_HOSTS = 500_000


def repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the same text."""
    n = F.size(w)
    windows = F.transform(
        F.slice(w, 1, F.greatest(n - 2, F.lit(0))),
        lambda x, i: F.struct(F.concat_ws(" ", x, w[i + 1], w[i + 2]).alias("g"), i.alias("i")),
    )

    def starts(s: Column) -> Column:
        # In sorted order a window is repeated when it equals the one before or the one after it.
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
        return let(
            same,
            lambda e: F.sort_array(
                F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), (e[k] | ((k > 0) & F.try_element_at(e, F.greatest(k, F.lit(1))))).alias("r"))), lambda x: x["r"]), lambda x: x["i"])
            ),
        )

    def covered(p: Column) -> Column:
        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(p, zero, step, lambda a: a["n"])

    return F.when(n < 3, F.lit(0)).otherwise(let(F.sort_array(windows), lambda s: let(starts(s), covered)))


def document_measures(docs: DataFrame, host: Column) -> DataFrame:
    """One row per document with its base measures and rule failures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WORD_BREAKS, "") != "")
    tokens = docs.select(
        "doc_id",
        host.alias("host"),
        words(text).alias("w"),
        F.length(F.translate(text, WORD_BREAKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    measured = tokens.select(
        "doc_id", "host", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", repeated_words(F.col("w")).cast("long").alias("n_repeat_words")
    )
    return measured.withColumns(
        {"fails_short": F.col("n_words") < MIN_WORDS, "fails_repeat": F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT}
    )


def host_rates(measured: DataFrame, rules: list[str]) -> DataFrame:
    """Failures by host and rule, with rates shrunk towards a beta prior fitted by moments over the hosts.

    The prior's mean is the pooled failure rate; its weight comes from the spread of host rates beyond binomial noise
    (no spread: the pooled rate is used for every host) and is MIN_PRIOR_DOCS documents at least.
    """
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules])
    hosts = materialise(hosts, "hosts")
    moments = [F.sum("n").alias("docs"), F.count("*").alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("sq")]
    for r in rules:
        moments += [F.sum(r).alias(f"{r}_sum"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_wsq")]
    m = hosts.agg(*moments).first()
    out = hosts
    for r in rules:
        docs, k = m["docs"] or 0, m["hosts"]
        mean = (m[f"{r}_sum"] or 0) / docs if docs else 0.0
        # Method of moments for the beta-binomial: between-host variance from the weighted sum of squares.
        spread = ((m[f"{r}_wsq"] or 0.0) - docs * mean * mean) - (k - 1) * mean * (1 - mean) if docs else 0.0
        scale = docs - (m["sq"] or 0) / docs - (k - 1) if docs else 0.0
        var = spread / scale if scale > 0 else 0.0
        if mean in (0.0, 1.0) or var <= 0:
            rate = F.lit(mean)
        else:
            weight = max(mean * (1 - mean) / var - 1, MIN_PRIOR_DOCS)
            rate = (F.col(r) + mean * weight) / (F.col("n") + weight)
        out = out.withColumn(f"{r}_rate", rate)
    return out


def quality_rules(docs: DataFrame, host: Column | None = None, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Every document with its measures, rule failures, host rates and the verdicts ``base_failed``, ``host_failed``, ``kept``."""
    rules = ["fails_short", "fails_repeat"]
    measured = materialise(document_measures(docs, F.col("source") if host is None else host), "rule-measures")
    rates = materialise(host_rates(measured, rules), "host-rates")
    n = rates.count()
    hosts = rates.select(F.col("host").alias("_host"), *[f"{r}_rate" for r in rules])
    out = join_bounded(measured, hosts, measured["host"].eqNullSafe(hosts["_host"]), "left", n, BROADCAST_HOSTS).drop("_host")
    failed = F.greatest(*[F.col(f"{r}_rate") for r in rules]) > max_host_rate
    base = F.col("fails_short") | F.col("fails_repeat")
    return out.withColumns({"base_failed": base, "host_failed": failed}).withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its measures, the verdict of its own rules and that with its source's as host."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP1_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS x,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), m AS (
  SELECT rid, doc_id, source, len(w)::BIGINT AS n_words,
         length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
          - len(list_distinct(list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines
  FROM t
), g AS (
  SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM t)
), r AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1
), n AS (
  SELECT rid, count(*)::BIGINT AS n_repeat_words
  FROM (SELECT DISTINCT rid, i + k AS p FROM r, (VALUES (0), (1), (2)) v(k)) GROUP BY rid
), d AS (
  SELECT m.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 50 AS f1, 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS f2
  FROM m LEFT JOIN n USING (rid)
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(f1::INT)::DOUBLE AS a, sum(f2::INT)::DOUBLE AS b FROM d GROUP BY source
), s AS (
  SELECT sum(n) AS docs, count(*) AS k, sum(n * n) AS sq, sum(a) / sum(n) AS ma, sum(b) / sum(n) AS mb, sum(a * a / n) AS wa, sum(b * b / n) AS wb FROM h
), v AS (
  SELECT *, (wa - docs * ma * ma - (k - 1) * ma * (1 - ma)) / nullif(greatest(docs - sq / docs - (k - 1), 0), 0) AS va,
            (wb - docs * mb * mb - (k - 1) * mb * (1 - mb)) / nullif(greatest(docs - sq / docs - (k - 1), 0), 0) AS vb FROM s
), p AS (
  SELECT source,
    CASE WHEN ma IN (0, 1) OR coalesce(va, 0) <= 0 THEN ma ELSE (a + ma * greatest(ma * (1 - ma) / va - 1, 2)) / (n + greatest(ma * (1 - ma) / va - 1, 2)) END AS ra,
    CASE WHEN mb IN (0, 1) OR coalesce(vb, 0) <= 0 THEN mb ELSE (b + mb * greatest(mb * (1 - mb) / vb - 1, 2)) / (n + greatest(mb * (1 - mb) / vb - 1, 2)) END AS rb
  FROM h, v
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed,
       NOT (f1 OR f2) AND NOT greatest(ra, rb) > 0.5 AS kept
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
"""
