"""Typed sources and sinks. Every scan has a declared schema; malformed input fails or is reported, never skipped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMETERS = "struct<type:string,properties:array<struct<name:string,type:string,description:string,in:string>>,required:array<string>>"
SCHEMAS = {
    "catalog": f"tool_id string, name string, description string, summary string, parameters {PARAMETERS}, returns array<string>, auth_scope array<string>, side_effects string, domain string, categories array<string>, provider string, api_title string, http struct<method:string,path:string>, tags array<string>, deprecated boolean, source string, spec_url string, doc_quality int, is_heldout boolean",
    "intent": "intent_id string, query string, gold_tool_ids array<string>, task_variant string, difficulty string, source string, provenance string, uses_heldout_tool boolean",
    "generated_intent": "intent_id string, query string, gold_tool_ids array<string>, task_variant string, difficulty string, separable boolean, distinction string, why_unsupported string, source string, provenance string",
    "vectors": "matrix_id string, tool_id string, pos long, embedding array<float>",
    "matrix_meta": "matrix string, model string, text_variant string, query_prefix string, doc_prefix string, dim int, rows int, catalog string, catalog_sha256 string, mean_doc_words double",
    "partition": "intent_id string, side string",
    "score_window": "split string, qid long, col int, tool_id string, is_gold boolean, signal string, score float",
    "rank_vector": "split string, config string, qid long, rank int",
    "triplet": "anchor string, positive string, negative_1 string, negative_2 string, negative_3 string, negative_4 string",
    "answer": "id string, choice string, tied boolean",
}


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped, a malformed line fails the scan."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_json_object(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object with string values as ``key, value`` rows."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("e")).select("e.key", "e.value")


def read_list_or_object(spark: SparkSession, path: str) -> DataFrame:
    """A JSON list, or an object of which the values count, as ``key`` (index or name) and ``value`` (JSON text) rows; ``error`` tells of text that is neither."""
    whole = spark.read.option("wholetext", True).text(path)
    v = whole.select(F.try_parse_json("value").alias("v"), "value")
    good = v.where("v IS NOT NULL")
    good.createOrReplaceTempView("_siftwell_json")
    rows = spark.sql("SELECT coalesce(e.key, cast(e.pos AS string)) AS key, to_json(e.value) AS value, cast(null AS string) AS error FROM _siftwell_json, LATERAL variant_explode(v) e")
    bad = v.where("v IS NULL").select(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.concat(F.lit("not JSON: "), F.substring("value", 1, 100)).alias("error"))
    return rows.unionByName(bad)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet; refuses to replace a table unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def matrix_entry(meta: DataFrame, matrix: str, model: str | None = None, query_prefix: str | None = None) -> dict:
    """What is recorded of a matrix, with overrides (an empty prefix is one). A matrix without a known model is an error, not a guess."""
    row = meta.where(F.col("matrix") == matrix).first()
    model = model or (row and row["model"])
    if not model:
        raise ValueError(f"no model is recorded for matrix {matrix}; name it")
    return {"matrix": matrix, "model": model, "query_prefix": query_prefix if query_prefix is not None else (row["query_prefix"] if row else "") or "", "doc_prefix": (row["doc_prefix"] if row else "") or ""}


def digest(df: DataFrame, *keys: str) -> DataFrame:
    """First 16 hex digits of a SHA-256 over the rows: each row's hash, summed in eight 32-bit lanes so that no order matters."""
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in (keys or df.columns)]), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
    return df.agg(F.substring(F.sha2(F.concat_ws(":", *lanes), 256), 1, 16).alias("sha16"))


def matrices(names: list[str], baseline: str | None = None) -> list[str]:
    """Names once each in their order, without the baseline."""
    return [n for n in dict.fromkeys(names) if n != baseline]


def fetch_landed(specs: DataFrame, load) -> DataFrame:
    """``load(url) -> text`` for every row of ``api_id, url``: payload or error, so that a failed fetch is seen."""
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for url in b["url"]:
                try:
                    out.append((load(url), None))
                except Exception as e:  # a failed fetch is a row with its error
                    out.append((None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame({"api_id": b["api_id"], "body": [o[0] for o in out], "error": [o[1] for o in out]})

    return specs.select("api_id", "url").mapInPandas(run, "api_id string, body string, error string")
