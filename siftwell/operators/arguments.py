"""Arguments of calls, as JSON text, held against a parameter schema and against the expected arguments.

Values are compared as parsed, nested ones too: key order and blanks do not matter, 1 and "1" differ. Text that is null, no JSON
or no object has the one error ``not an object``, and no arguments. A property without a declared type takes any value;
without properties every name is unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_OBJECT = "not an object"


def arguments(text: Column) -> Column:
    """Name to value; null where the text is no JSON object."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def kind(value: Column) -> Column:
    """JSON type of a value; a number without a fraction is an integer."""
    s = F.schema_of_variant(value)
    return (
        F.when(s.rlike(r"^(BIGINT|DECIMAL\(\d+,\s?0\))$"), "integer").when(s.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number").when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").otherwise("null")
    )


def _fits(value: Column, declared: Column) -> Column:
    found = kind(value)
    return declared.isNull() | (found == declared) | ((declared == "number") & (found == "integer"))


def schema_errors(said: Column, properties: Column, required: Column) -> Column:
    """Sorted ``missing:x``, ``type:x`` and ``unknown:x`` of arguments under ``properties`` (``name, type``) and ``required`` names."""
    none = F.array().cast("array<string>")
    names = F.coalesce(F.transform(properties, lambda p: p["name"]), none)
    wrong = F.filter(properties, lambda p: F.map_contains_key(said, p["name"]) & ~_fits(F.element_at(said, p["name"]), p["type"]))
    tell = lambda word, xs: F.transform(xs, lambda x: F.concat(F.lit(word + ":"), x))
    errors = F.concat(tell("missing", F.array_except(required, F.map_keys(said))), tell("type", F.coalesce(F.transform(wrong, lambda p: p["name"]), none)), tell("unknown", F.array_except(F.map_keys(said), names)))
    return F.when(said.isNull(), F.array(F.lit(NOT_OBJECT))).otherwise(F.array_sort(errors))


def shared_arguments(said: Column, gold: Column) -> Column:
    """How many expected arguments were said with the expected value."""
    equal = lambda e: F.map_contains_key(said, e["key"]) & (F.to_json(F.element_at(said, e["key"])) == F.to_json(e["value"]))
    return F.coalesce(F.size(F.filter(F.map_entries(gold), equal)), F.lit(0))


def checked_calls(calls: DataFrame, said: str, gold: str, properties: Column, required: Column) -> DataFrame:
    """``calls`` with ``errors``, ``hits``, ``n_said``, ``n_gold`` and ``f1`` of each; two empty sets agree (1)."""
    none = F.array().cast("array<string>")
    a, g = arguments(F.col(said)), arguments(F.col(gold))
    size = lambda m: F.when(m.isNull(), 0).otherwise(F.size(m))
    hits = F.when(a.isNull() | g.isNull(), 0).otherwise(shared_arguments(a, g))
    out = calls.withColumns({"errors": schema_errors(a, properties, F.coalesce(required, none)), "hits": hits, "n_said": size(a), "n_gold": size(g)})
    total = F.col("n_said") + F.col("n_gold")
    return out.withColumn("f1", F.when(total == 0, 1.0).otherwise(2 * F.col("hits") / total))


def argument_scores(checked: DataFrame, by: str) -> DataFrame:
    """By group: calls, share of valid ones, micro precision, recall and F1 of arguments, and the mean F1 of a call."""
    share = lambda a, b: F.round(F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0)), 6)
    hits, said, gold = (F.sum(c) for c in ("hits", "n_said", "n_gold"))
    return checked.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg((F.size("errors") == 0).cast("double")), 6).alias("valid"),
        share(hits, said).alias("precision"), share(hits, gold).alias("recall"), share(2 * hits, said + gold).alias("f1"), F.round(F.avg("f1"), 6).alias("mean_f1"),
    )
