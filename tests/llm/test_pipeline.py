"""The pipeline's stages on a small folder of tables, each against what its operator's brute-force version gives."""

from __future__ import annotations

import random

import corpus_pipeline
from siftwell.llm.mixing import mix


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    text = lambda k: " ".join(rnd.choices(words, k=k))
    item = text(30)
    rows = [(i, text(rnd.randint(60, 90)), "en", f"s{i % 4}", None) for i in range(200)]
    rows += [(300 + i, rows[i][1], "en", "s1", None) for i in range(10)]  # copies
    rows += [(400 + i, rows[20 + i][1] + " tail", "en", "s2", None) for i in range(10)]  # near copies
    rows += [(500 + i, text(40) + " " + item + " " + text(40), "en", "s3", None) for i in range(5)]  # leaks
    rows += [(600 + i, "$$$ ### %%% " * 30 + str(i), "en", "s3", None) for i in range(5)]  # junk
    rows += [(700, None, "en", "s1", None), (None, text(70), None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, ids = docs.columns, lambda d: sorted(r[0] for r in d.select("doc_id").collect() if r[0] is not None)
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality classifier"](spark, docs, str(tmp_path))
    assert good.columns == columns and not set(ids(good)) & {600, 601, 602, 603, 604, 700} and len(set(range(200)) - set(ids(good))) <= 2
    one = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert one.columns == columns and set(range(200)) <= set(ids(one)) and not set(ids(one)) & set(range(300, 310)) | set(range(400, 410)) & set(ids(one))
    clean = stages["benchmark decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == columns and set(ids(docs)) - set(ids(clean)) == set(range(500, 505))
    mixed = stages["mixing sources to target weights"](spark, docs, str(tmp_path))
    assert mixed.columns == columns and mixed.count() == mix(docs).agg({"mix_copies": "sum"}).first()[0]
    out = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert out and not {r["doc_id"] for r in out} & {300, 400, 500, 600} and out[0]["start"] == 0
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))
