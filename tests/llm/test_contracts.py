"""Every query of the subpackage over a small folder: columns, types and rules of its contract; and the models' verdicts by hand."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from siftwell.llm import language_id, quality_classifier
from siftwell.llm.registry import QUERIES
from test_corpus_operators import frame, kneser_ney_reference, odd_rows

CONTRACTS = {
    "op1_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op2_decontamination": {"doc_id": "bigint", "item_id": "bigint", "containment": "double"},
    "op3_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5_token_output": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op6_source_mix": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op7_token_counts": {"doc_id": "bigint", "section": "bigint", "n_tokens": "bigint"},
    "op8_license_scan": {"doc_id": "bigint", "license_id": "string", "dice": "double"},
    "op9_repeat_removal": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op10_quality_classifier": {"doc_id": "bigint", "perplexity": "double", "threshold": "double", "kept": "boolean"},
    "op11_filter_audit": {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint", "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"},
    "op12_embedding_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op13_source_divergence": {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"},
}
#: Those with one row for each document.
WHOLE = [q for q in CONTRACTS if q.split("_")[0] not in ("op2", "op7", "op8", "op11", "op12", "op13")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = odd_rows() + [(100 + i, " ".join(rnd.choices(words, k=rnd.randint(5, 80))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", None])) for i in range(60)]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, 0) for i in range(40)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, rows[30][1]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(50)] + [(60, None), (None, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return str(path), rows


@pytest.mark.parametrize("name", list(QUERIES))
def test_contract(spark, folder, name):
    path, rows = folder
    out = QUERIES[name](spark, path)
    types = dict(out.dtypes)
    assert {c: types.get(c) for c in CONTRACTS[name]} == CONTRACTS[name]
    got = out.collect()
    if name in WHOLE:
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    if name == "op4_language_id":
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
        assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3)} == {"und"}
    if name == "op6_source_mix":
        assert all(r["taken"] <= 3 * r["size"] for r in got)
    if name == "op5_token_output":
        by_start = sorted(got, key=lambda r: r["start"])
        assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(by_start, by_start[1:]))


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables(spark, folder, tmp_path, name):
    for t in ("documents", "labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder[0]}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", range(5))
def test_stage_takes_odd_rows(spark, folder, stage):
    """Empty tables, repeated rows, long texts, and columns with the operators' own names in any case."""
    _, run = corpus_pipeline.STAGES[stage]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert run(spark, docs.limit(0), folder[0]).count() == 0
    more = docs
    for c in ("_id", "hit_id", "_gone", "copy_id", "_twice", "row", "KEPT", "Perplexity", "_kept", "mix_size", "mix_batch", "MIX_copies", "part", "start", "N", "text_key", "mean", "_siftwell_kept", "_own", "_own_3", "n_words", "_n_words", "__kept"):
        more = more.selectExpr("*", f"'x' AS `{c}`")
    out = run(spark, more, folder[0])
    n = out.count()
    assert n == run(spark, docs, folder[0]).count()
    if stage < 4:
        assert out.columns == more.columns


def test_out_of_place_distance():
    rnd = random.Random(5)
    text = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(40))
    profiles = {lang: language_id.top_grams(*language_id.gram_counts(language_id.letter_codes(text(letters)))) for lang, letters in (("aa", "abcd"), ("bb", "cdef"), ("cc", "abef"))}
    found = language_id.Profiles(profiles)
    for t in [text("abcd"), text("cdef"), "x", "ab", "", "123 $", text("abcdef")]:
        own = language_id.top_grams(*language_id.gram_counts(language_id.letter_codes(t))).tolist() if t else []
        if not own:
            assert found.predict(t) == ("und", 0.0)
            continue
        places = {lang: {g: k for k, g in enumerate(p.tolist())} for lang, p in profiles.items()}
        distance = {lang: sum(abs(p[g] - k) if g in p else language_id.PROFILE for k, g in enumerate(own)) for lang, p in places.items()}
        best = min(distance, key=lambda lang: (distance[lang], lang))  # the first language on a tie
        assert found.predict(t) == (best, pytest.approx(1 - distance[best] / (language_id.PROFILE * len(own))))


def test_verdict_by_hand(spark):
    """Perplexity with its prior, the quantile over held-out documents and the verdict."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choices(words, weights=range(1, 51), k=rnd.randint(3, 50))), "en", "s") for i in range(80)]
    rows += [(200 + i, " ".join(f"z{rnd.random()}" for _ in range(30)), "en", "s") for i in range(4)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality long, toxic long")
    trusted = quality_classifier.trusted_text(docs, labels).collect()
    log = kneser_ney_reference([r["text"] for r in trusted if not r["held_out"]])
    held = [r["text"] for r in trusted if r["held_out"]]
    n = lambda t: len(t.split())
    mean = sum(map(log, held)) / sum(map(n, held))
    ppl = lambda t: np.exp(-(log(t) + quality_classifier.PRIOR_WORDS * mean) / (n(t) + quality_classifier.PRIOR_WORDS))
    threshold = np.percentile([ppl(t) for t in held], 100 * quality_classifier.QUANTILE) * quality_classifier.MARGIN
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    for i, t, *_ in rows:
        assert (got[i]["perplexity"], got[i]["threshold"], got[i]["kept"]) == (pytest.approx(ppl(t), rel=1e-4), pytest.approx(threshold, rel=1e-4), bool(ppl(t) <= threshold))
    assert not any(got[200 + i]["kept"] for i in range(4))
