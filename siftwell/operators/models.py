"""Boundaries to models outside the engine."""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """Unit vectors, one row a text."""


class PairScorer(Protocol):
    def score(self, queries: list[str], texts: list[str]) -> np.ndarray: ...


def encode_texts(df: DataFrame, make_encoder, key: str = "tid", text: str = "text", batch: int = 128) -> DataFrame:
    """``key, v``: encode a text column; the encoder is made once a task and sees batches of ``batch`` texts."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        enc = make_encoder()
        for b in batches:
            for k in range(0, b.num_rows, batch):
                s = b.slice(k, batch)
                v = np.asarray(enc.encode([t or "" for t in s.column(text).to_pylist()]), "f4")
                if not np.isfinite(v).all():
                    raise ValueError("the encoder gave values that are not finite")
                yield pa.RecordBatch.from_arrays([s.column(key), pa.array(list(v), pa.list_(pa.float32()))], [key, "v"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, v array<float>")


def score_pairs(df: DataFrame, make_scorer, batch: int = 128) -> DataFrame:
    """``qid, tid, score`` for rows ``qid, tid, query, text``."""

    def run(batches):
        scorer = make_scorer()
        for b in batches:
            for k in range(0, b.num_rows, batch):
                s = b.slice(k, batch)
                out = np.asarray(scorer.score(s.column("query").to_pylist(), s.column("text").to_pylist()), "f8")
                yield pa.RecordBatch.from_arrays([s.column("qid"), s.column("tid"), pa.array(out)], ["qid", "tid", "score"])

    return df.select("qid", "tid", "query", "text").mapInArrow(run, "qid long, tid long, score double")
