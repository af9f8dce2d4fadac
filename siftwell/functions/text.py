"""Text expressions: documents of tools, keys, tokens, path words, quality scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VARIANTS = ("v0", "v1", "v2", "v3")
PARAM_NAMES = 15

# Instruction prefixes that public encoders were trained with.
QUERY_PREFIX = {
    "BAAI/bge-base-en-v1.5": "Represent this sentence for searching relevant passages: ",
    "BAAI/bge-large-en-v1.5": "Represent this sentence for searching relevant passages: ",
    "BAAI/bge-small-en-v1.5": "Represent this sentence for searching relevant passages: ",
    "intfloat/e5-large-v2": "query: ",
    "intfloat/e5-base-v2": "query: ",
}
DOC_PREFIX = {
    "intfloat/e5-large-v2": "passage: ",
    "intfloat/e5-base-v2": "passage: ",
}


def join_nonempty(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined by one space."""
    return F.trim(F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), " "))


def first_filled(*parts: Column) -> Column:
    """The first part that is neither null nor empty."""
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")).cast("long")


def humanize(path: Column) -> Column:
    """Words of a URL path: placeholders go with their contents, camel case is split, alphanumeric runs stay."""
    bare = F.regexp_replace(F.coalesce(path, F.lit("")), r"\{[^}]*\}", " ")
    return F.array_join(F.regexp_extract_all(F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("[A-Za-z0-9]+"), F.lit(0)), " ")


def slug(*parts: Column, limit: int = 120) -> Column:
    joined = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "_")
    return F.substring(F.regexp_replace(F.lower(F.trim(F.regexp_replace(joined, "[^A-Za-z0-9]+", "_"), F.lit("_"))), "_+", "_"), 1, limit)


def norm_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def dedup_key(text: Column) -> Column:
    """Lower case without punctuation, words sorted; repeated words stay."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]+", "")
    return F.array_join(F.array_sort(F.filter(F.split(bare, " +"), lambda x: x != "")), " ")


def tool_text(variant: str, name: Column, summary: Column, description: Column, params: Column, tags: Column, api_title: Column, provider: Column, method: Column, path: Column) -> Column:
    """Index document of a tool. Each variant adds to the one before: tags, service, then method and path words."""
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {VARIANTS}")
    parts = [name, summary, description, F.array_join(F.slice(params, 1, PARAM_NAMES), " ")]
    if variant >= "v1":
        parts.append(F.array_join(tags, " "))
    if variant >= "v2":
        parts += [api_title, provider]
    if variant >= "v3":
        parts += [F.upper(method), humanize(path)]
    return join_nonempty(*parts)


def with_prefix(text: Column, model: Column, prefixes: dict[str, str]) -> Column:
    """Prefix of the model's side (query or document); models without one get none."""
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return F.concat(F.coalesce(F.try_element_at(table, model), F.lit("")), text)


def side_effects(method: Column) -> Column:
    m = F.lower(method)
    return F.when(m == "delete", "destructive").when(m.isin("post", "put", "patch"), "write").otherwise("read")


def doc_quality(description: Column, param_descriptions: Column) -> Column:
    """0 to 4: description of 20 and of 120 characters, any parameter, half of the parameters described in 10 characters."""
    n = F.size(param_descriptions)
    described = F.size(F.filter(param_descriptions, lambda x: F.length(x) >= 10))
    length = F.length(F.coalesce(description, F.lit("")))
    terms = [length >= 20, length >= 120, n > 0, (n > 0) & (described / F.greatest(n, F.lit(1)) >= 0.5)]
    total = F.lit(0)
    for t in terms:
        total = total + t.cast("int")
    return total


def long_enough(query: Column, least: int = 8) -> Column:
    return F.length(F.trim(query)) >= least


def is_thin(description: Column, most: int = 5) -> Column:
    return word_count(description) <= most


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.round(F.lit(100.0) * part / F.greatest(whole, F.lit(1)), digits)


def fenced_json(text: Column, schema: str) -> Column:
    """Array between the first ``[`` and the last ``]``, inside a code fence if there is one; malformed text gives an empty array."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(inside != "", inside).otherwise(text)
    array = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    return F.coalesce(F.from_json(F.nullif(array, F.lit("")), schema), F.array().cast(schema))
