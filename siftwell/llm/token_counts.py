"""Token counts by section: each whole document is encoded once, and its token spans are joined to the section spans.

A token belongs to a section by an explicit rule where it crosses a boundary: ``first`` (the section of its first
character), ``last`` (of its last character) or ``largest`` (most characters, the earlier section on a tie).

Sections are sorted spans of characters that do not overlap; tokens outside all of them are counted under section -1.
Defined cases: a null text has no rows; an empty text has one empty section; repeated rows are counted each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.token_output import array_batches
from siftwell.llm.tokens import encoder, tokenizer_path
from siftwell.sources.scratch import table

RULES = ("first", "last", "largest")


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    cuts = np.flatnonzero(codes[:-1] == 10) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(text)]])


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """Section number of each token, -1 outside: an interval join of two sorted span lists."""

    def at(position: np.ndarray) -> np.ndarray:
        k = np.searchsorted(starts, position, "right") - 1
        return np.where((k >= 0) & (position < ends[k]), k, -1) if len(starts) else np.full(len(position), -1)

    if rule == "first":
        return at(first)
    last = np.maximum(end - 1, first)
    if rule == "last":
        return at(last)
    best, most = np.full(len(first), -1), np.zeros(len(first), "i8")
    if not len(starts):
        return best
    low = np.maximum(np.searchsorted(starts, first, "right") - 1, 0)
    high = np.searchsorted(starts, last, "right") - 1
    for step in range(int((high - low).max(initial=-1)) + 1):
        k = np.minimum(low + step, np.maximum(high, 0))
        shared = np.where(low + step <= high, np.minimum(end, ends[k]) - np.maximum(first, starts[k]), 0)
        best, most = np.where(shared > most, k, best), np.maximum(shared, most)
    return best


def token_counts(docs: DataFrame, tokenizer: str | None = None, rule: str = "largest", sections: bool = False) -> DataFrame:
    """``doc_id, section, start, end, n_tokens`` for the lines of each text, or with ``sections`` for the spans in a column
    ``sections`` of type array<struct<start, end>>."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or tokenizer_path()

    def counted(batches):
        enc = encoder(path)
        for b in batches:
            b = b.filter(b.column("text").is_valid())
            for i, j in array_batches(b.column("text")):
                some = b.slice(i, j - i)
                first, end, n = enc.spans_array(some.column("text"))
                own = some.column("sections").to_pylist() if sections else None
                out: list[list] = [[], [], [], []]
                cuts = np.cumsum(n)
                for k, (lo, hi) in enumerate(zip((cuts - n).tolist(), cuts.tolist())):
                    if sections:
                        spans = np.asarray([(s["start"], s["end"]) for s in own[k] or ()], "i8").reshape(-1, 2)
                        starts, ends = spans[:, 0], spans[:, 1]
                    else:
                        starts, ends = line_spans(some.column("text")[k].as_py())
                    found = np.bincount(attribute(first[lo:hi], end[lo:hi], starts, ends, rule) + 1, minlength=len(starts) + 1)
                    number = np.arange(-1, len(starts))
                    starts, ends = np.concatenate([[-1], starts]), np.concatenate([[-1], ends])
                    keep = slice(0 if found[0] else 1, None)
                    for column, values in zip(out, (number, starts, ends, found)):
                        column.append(values[keep])
                ids = some.column("doc_id").take(pa.array(np.repeat(np.arange(len(out[0])), [len(x) for x in out[0]])))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(c).astype("i8"), pa.int64()) for c in out)], ["doc_id", "section", "start", "end", "n_tokens"])

    columns = ["doc_id", "text", *(["sections"] if sections else [])]
    return docs.select(*columns).mapInArrow(counted, "doc_id long, section long, start long, end long, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a token over a line end belongs to the line with most of its characters."""
    return token_counts(table(spark, sf_dir, "documents"))
