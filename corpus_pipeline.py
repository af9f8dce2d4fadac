"""From raw documents to token files: classifier, near duplicates, decontamination, mixing, token output.

Each stage takes all that the one before it kept; stages hand on the columns of ``documents``, the last gives one row per
written document. The result follows a trained model and a tokenizer, so there is no SQL for it; ``tests/llm`` holds every
stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.decontamination import clean_documents
from siftwell.llm.mixing import emit_copies, mix
from siftwell.llm.ngram_jaccard import one_of_each
from siftwell.llm.quality_classifier import keep_good
from siftwell.llm.token_output import token_output
from siftwell.sources.scratch import materialise, table, temporary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on ``labels`` keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles and a similarity of 0.8, as for any near-duplicate stage."""
    return one_of_each(docs, k=5, threshold=(80, 100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate says."""
    return emit_copies(mix(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document in the token files that are written."""
    return token_output(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID output", token_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again, and goes with its scratch tables at the end."""
    with temporary(spark) as keep:
        docs = table(spark, sf_dir, "documents")
        for k, (name, stage) in enumerate(STAGES):
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
        return keep(docs)
