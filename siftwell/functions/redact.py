"""Redaction of strings with the shape of credentials, with counts by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class, pattern, replacement. Patterns follow the public formats; replacements do not match them again.
RULES = [
    ("aws_key_id", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[aws-key-id]"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]+){0,2}", "[token]"),
    ("stripe_key", r"\b[sp]k_(?:live|test)_[0-9A-Za-z]{8,}\b", "[api-key]"),
    ("slack_token", r"\bxox[abprs]-[0-9A-Za-z-]{8,}", "[chat-token]"),
    ("bearer", r"\bBearer\s+[A-Za-z0-9._~+/=-]{16,}", "Bearer [token]"),
]
#: Only for generated text: a path under a home directory becomes its last part.
HOME_PATH = ("home_path", r"(?:/home|/Users)/[^\s/]+(?:/[^\s/]+)*/([^\s/]+)", "./$1")


def redact(text: Column, generated: bool = False) -> Column:
    for _, pattern, replacement in [*RULES, *([HOME_PATH] if generated else [])]:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def redaction_counts(df: DataFrame, text: str, file: str, generated: bool = False) -> DataFrame:
    """``file, class, n`` of every class found."""
    rules = [*RULES, *([HOME_PATH] if generated else [])]
    found = F.array(*[F.struct(F.lit(name).alias("class"), F.regexp_count(F.col(text), F.lit(pattern)).alias("n")) for name, pattern, _ in rules])
    return df.select(F.col(file).alias("file"), F.explode(found).alias("f")).groupBy("file", "f.class").agg(F.sum("f.n").alias("n")).where("n > 0")
