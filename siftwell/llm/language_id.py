"""Language identification by rank-order profiles of character n-grams.

A profile lists the PROFILE most frequent letter n-grams (one to three characters, words led and ended by a blank) in rank
order. A document is given the language with the smallest out-of-place distance: the sum of rank differences over the
document's own profile, PROFILE for an n-gram that the language's profile lacks. The score is one minus that distance over
the largest possible one.

Training reads text and lang of the documents whose crc32 of the id, modulo FOLDS, is not HELD_OUT; lang, source and id are
no inputs of a prediction. Ties: equal counts rank by n-gram code, equal distances go to the first language by code point.

Defined cases: a null text or one without letters is ``und`` with score 0; without any learned language all are ``und``;
a null id is not held out and not learned from; repeated rows count and are predicted each; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.token_output import text_batches
from siftwell.sources.scratch import table

PROFILE = 300
FOLDS, HELD_OUT = 3, 1
UNDETERMINED = "und"
_BLANK = 32
#: Codes of a text that are counted at once.
CHUNK = 1 << 20
_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text; each run without letters is one blank, one stands at either end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    letter = _letter_table()[codes]
    if not letter.any():
        return np.zeros(0, "i8")
    codes = np.where(letter, codes, _BLANK)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    head = [] if codes[0] == _BLANK else [_BLANK]
    tail = [] if codes[-1] == _BLANK else [_BLANK]
    return np.concatenate([head, codes, tail]).astype("i8")


def gram_counts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes (21 bits a character) in ascending order, and their counts."""
    parts = []
    for at in range(0, len(codes), CHUNK):
        c = codes[at : at + CHUNK + 2]
        one = c[:CHUNK]
        grams = [one[one != _BLANK]]
        two = (c[:-1] << 21 | c[1:])[:CHUNK]
        grams.append(two)
        if len(c) > 2:
            grams.append((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[:CHUNK])
        parts.append(np.unique(np.concatenate(grams), return_counts=True))
    if len(parts) == 1:
        return parts[0]
    return merged(parts) if parts else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype("i8")


def top_grams(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams in rank order."""
    if len(keys) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.argsort(-counts, kind="stable")[:PROFILE]]


def _train(batches):
    by_lang: dict[str, list] = {}
    for b in batches:
        groups: dict[str, list] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            groups.setdefault(lang, []).append(letter_codes(text))
        for lang, codes in groups.items():
            parts = by_lang.setdefault(lang, [])
            # Texts begin and end with a blank; the n-grams over a seam hold two blanks and are left out.
            k, n = gram_counts(np.concatenate(codes))
            seam = (k & ((1 << 42) - 1)) == (_BLANK << 21 | _BLANK)
            seam |= (k >> 21) == (_BLANK << 21 | _BLANK)
            parts.append((k[~seam], n[~seam]))
            if len(parts) > 16:
                parts[:] = [merged(parts)]
    for lang, parts in by_lang.items():
        k, n = merged(parts)
        for i in range(0, len(k), 1 << 16):
            j = min(len(k), i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (j - i)), pa.array(k[i:j]), pa.array(n[i:j])], ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profile of each language of ``docs`` (``text, lang``). PROFILE rows a language reach the driver."""
    counts = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_train, "lang string, gram long, n long")
    total = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = total.withColumn("rank", rank).where(F.col("rank") <= PROFILE).select("lang", "rank", "gram").collect()
    out: dict[str, list] = {}
    for lang, _, gram in sorted(rows):
        out.setdefault(lang, []).append(gram)
    return {lang: np.asarray(g, "i8") for lang, g in sorted(out.items(), key=lambda x: x[0].encode())}


class Profiles:
    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = list(profiles)
        self.grams = np.unique(np.concatenate([*profiles.values(), np.zeros(0, "i8")]))
        self.ranks = np.full((len(self.langs), len(self.grams)), -1)
        for k, g in enumerate(profiles.values()):
            self.ranks[k, np.searchsorted(self.grams, g)] = np.arange(len(g))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = top_grams(*gram_counts(letter_codes(text))) if text else np.zeros(0, "i8")
        if not len(own) or not self.langs:
            return UNDETERMINED, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where(self.grams[at] == own, self.ranks[:, at], -1)
        distance = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), PROFILE).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (PROFILE * len(own))


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(Profiles(profiles))

    def predicted(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in text_batches([t or "" for t in texts]):
                found = [shared.value.predict(t) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(predicted, "doc_id long, lang_pred string, score double")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language predicted by profiles of the two folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    learned = learn_profiles(docs.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
    found = predict_language(docs, learned)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
