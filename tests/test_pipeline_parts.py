"""Score cache, training batches, split registry and the ledger of calls."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftwell.operators import batches as B
from siftwell.operators import generation as E
from siftwell.operators import metrics as M
from siftwell.sources.cache import ScoreCache
from siftwell.sources.splits import Registry, load_splits
from siftwell.sources.tables import write_jsonl

SCORES = "qid long, tid long, score double"


def test_cache_computes_each_query_once(spark, tmp_path):
    asked = []

    def compute(queries):
        asked.append(sorted(r["qid"] for r in queries.collect()))
        return queries.where("qid % 4 <> 0").select("qid", (F.col("qid") * 2).alias("tid"), F.lit(0.5).alias("score"), F.lit("x").alias("more"))

    queries = spark.range(12).withColumnRenamed("id", "qid")
    cache = lambda **parts: ScoreCache(spark, str(tmp_path), SCORES, **parts)
    one = cache(matrix="m", seed=1)
    assert one.rows().count() == 0 and one.fill(queries.where("qid < 5"), compute) == 5
    again = cache(seed=1, matrix="m")  # another session, the parts in another order
    assert again.fill(queries, compute) == 7 and again.fill(queries, compute) == 0
    assert asked == [list(range(5)), list(range(5, 12))]  # a query without rows is not asked again
    assert sorted(tuple(r) for r in again.rows().collect()) == [(q, 2 * q, 0.5) for q in range(12) if q % 4]
    assert cache(matrix="m", seed=2).fill(queries, compute) == 12  # another key


def test_cache_counts_committed_batches_alone(spark, tmp_path):
    queries = spark.range(6).withColumnRenamed("id", "qid")
    rows = lambda q: q.select("qid", F.lit(1).cast("long").alias("tid"), F.lit(1.0).alias("score"))
    cache = ScoreCache(spark, str(tmp_path), SCORES, k=1)

    def dies(q):
        rows(q).write.parquet(f"{cache.folder}/half/rows")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        cache.fill(queries, dies)
    assert cache.rows().count() == 0 and cache.missing(queries).count() == 6
    # Two fills at once: both compute, every query counts once.
    both = ScoreCache(spark, str(tmp_path), SCORES, k=1)
    both.missing = lambda q: q
    assert cache.fill(queries, rows) == 6 and both.fill(queries, rows) == 6 and len(cache.batches()) == 2
    assert sorted(r["qid"] for r in cache.rows().collect()) == list(range(6))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_batches_never_repeat_a_positive(spark, size):
    rnd = random.Random(size)
    rows = [(i, rnd.choice(["a", "b", "c", None, "hot", "hot", "hot", f"p{i}"])) for i in range(300)]
    out = B.batches_without_repeats(spark.createDataFrame(rows, "id long, positive string").repartition(5), "positive", "id", size, "s").collect()
    assert sorted((r["id"], r["positive"]) for r in out) == sorted(rows)
    assert max(Counter((r["batch"], r["positive"]) for r in out).values()) == 1
    sizes = Counter(r["batch"] for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and max(sizes.values()) <= size
    assert len(sizes) == max(-(-300 // size), max(Counter(p for _, p in rows).values()))
    audit = B.batch_audit(spark.createDataFrame([(0, "a"), (0, "a"), (0, None), (1, "a")], "batch long, positive string"), "positive").first()
    assert tuple(audit) == (2, 1, 3, 1)
    assert B.batches_without_repeats(spark.createDataFrame([], "id long, positive string"), "positive", "id", 4, "s").count() == 0


def test_training_pairs(spark):
    intents = spark.createDataFrame([(i, f"q{i}") for i in range(10)], "intent_id long, query string")
    golds = spark.createDataFrame([(i, t, k) for i in range(9) for k, t in enumerate(["gone", "x" if i < 6 else "y", "y"])], "intent_id long, tool_id string, gold_idx int")
    catalog = spark.createDataFrame([("x", "X"), ("y", "Y")], "tool_id string, name string")
    got = B.training_pairs(intents, golds, catalog, F.col("name")).collect()
    assert {(r["intent_id"], r["tool_id"], r["positive"]) for r in got} == {(i, "x", "X") if i < 6 else (i, "y", "Y") for i in range(9)}
    capped = B.training_pairs(intents, golds, catalog, F.col("name"), cap=2).collect()
    assert Counter(r["tool_id"] for r in capped) == {"x": 2, "y": 2}


def generated(rows):
    return [{"intent_id": i, "query": f"q {i}", "gold_tool_ids": golds, "separable": separable} for i, golds, separable in rows]


def test_split_registry(spark, tmp_path):
    files = {
        "dev_A": generated([("d1", ["t1"], None)]),
        "standard_L2": generated([("s1", ["t1"], None), ("s2", ["t9", "t2", "t1"], None), ("s3", ["t9"], None)]),
        "confusion_L2": generated([("c1", ["t1"], True), ("c2", ["t2"], False), ("c3", ["t2"], None)]),
        "abstain_L2": generated([("a1", [], None)]),
    }
    for name, rows in files.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    manifest = spark.createDataFrame([(i, "dev") for i in ("s1", "s2", "s3", "c1", "c2", "a1", "d1", "s1")], "intent_id string, side string")
    dev = load_splits(spark, str(tmp_path), "dev", manifest)
    assert list(dev.splits) == ["dev_A", "standard_L2", "splitD_separable", "splitD_inseparable", "splitE_abstain"]
    assert dev.absent == ["standard_L3", "standard_L4"]
    catalog = spark.createDataFrame([("t1",), ("t2",)], "tool_id string")
    assert {(r["split"], r["intent_id"]): r["golds"] for r in dev.with_gold(catalog).collect()} == {
        ("dev_A", "d1"): ["t1"], ("standard_L2", "s1"): ["t1"], ("standard_L2", "s2"): ["t2", "t1"],
        ("splitD_separable", "c1"): ["t1"], ("splitD_inseparable", "c2"): ["t2"], ("splitE_abstain", "a1"): [],
    }
    every = load_splits(spark, str(tmp_path))
    assert "dev_A" not in every.splits and every.splits["splitD_separable"].count() == 1 and every.absent[:2] == ["test_A", "C_unseen_tools"]
    every.register("all_")
    assert spark.sql("SELECT count(*) FROM all_standard_L2").first()[0] == 3
    with pytest.raises(ValueError, match="other files"):
        load_splits(spark, str(tmp_path), "test", manifest)
    with pytest.raises(ValueError, match="manifest"):
        load_splits(spark, str(tmp_path), "dev")
    with pytest.raises(ValueError, match="no split"):
        load_splits(spark, str(tmp_path / "nowhere")).items()
    assert Registry().absent == []
    write_jsonl(spark.createDataFrame([("z", "q", ["t1"])], "intent_id string, query string, gold_tool_ids array<string>"), str(tmp_path / "test_A.jsonl"))
    assert load_splits(spark, str(tmp_path)).splits["test_A"].count() == 1


def test_ledger_resumes_within_its_budget(spark, tmp_path):
    class Model:  # of this function, so that workers get it by value
        def generate(self, prompt):
            if "fail" in prompt:
                raise TimeoutError("no answer")
            return f"[{len(prompt)}]", 0.5

    prompts = spark.createDataFrame([(f"b{i}", "fail" if i in (2, 5) else f"prompt {i}") for i in range(10)], "batch string, prompt string")
    ledger = E.Ledger(spark, str(tmp_path))
    assert tuple(ledger.stats().first()) == (0, 0, 0, 0, 0.0)
    live = E.called(Model)
    assert ledger.run(prompts, live, 1.6, 0.5, attempts=1, wave=2) <= 5 and 1.0 <= ledger.spent() <= 1.5
    before = ledger.sent().count()
    assert E.Ledger(spark, str(tmp_path)).run(prompts, live, 100.0, 0.5, attempts=1) == 10 - before
    assert tuple(ledger.stats().first()) == (10, 8, 2, 0, 4.0)
    assert ledger.run(prompts, live, 100.0, 0.5, attempts=1) == 0  # nothing is sent twice
    assert ledger.run(prompts, live, 100.0, 0.5, attempts=2) == 2  # but what failed is tried again
    assert {r["error"] for r in ledger.done().where("answer IS NULL").collect()} == {"TimeoutError: no answer"}
    changed = prompts.withColumn("prompt", F.when(F.col("batch") == "b0", "another prompt").otherwise(F.col("prompt")))
    assert ledger.run(changed, live, 100.0, 0.5, attempts=2) == 1
    assert ledger.run(prompts.limit(0), live, 100.0, 0.5) == 0
    # A run that died after sending: the call counts as an attempt, and as unanswered.
    lost = E.Ledger(spark, str(tmp_path / "lost"))
    lost.todo(prompts.where("batch = 'b1'"), 1).selectExpr("'r' AS run", "call", "batch", "prompt").write.parquet(str(tmp_path / "lost" / "sent"))
    assert lost.run(prompts.where("batch = 'b1'"), live, 100.0, 0.5, attempts=1) == 0 and lost.stats().first()["unanswered"] == 1
    assert lost.run(prompts.where("batch = 'b1'"), live, 100.0, 0.5, attempts=2) == 1 and lost.stats().first()["answered"] == 1


def test_ledger_reads_prompts_once(spark, tmp_path):
    """Waves neither read all prompts again, nor repeat what failed more often than asked; a model may leave calls out."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    prompts = spark.createDataFrame([(f"b{i}", f"prompt {i}") for i in range(40)], "batch string, prompt string").mapInArrow(counted, "batch string, prompt string")
    recorded = spark.createDataFrame([(f"b{i}", "[]", 0.25) for i in range(40) if i % 4], "batch string, answer string, cost double")
    ledger = E.Ledger(spark, str(tmp_path))
    assert ledger.run(prompts, E.replayed(recorded), 100.0, 0.25, wave=6) == 50
    assert read.value <= 80  # once to find the ranges, once to sort
    assert tuple(ledger.stats().first()) == (40, 30, 10, 0, 7.5)
    assert {r["count"] for r in ledger.sent().groupBy("call").count().collect()} == {1, 2}
    silent = E.Ledger(spark, str(tmp_path / "silent"))
    quiet = lambda p: E.replayed(recorded)(p).where("answer IS NOT NULL")
    assert silent.run(prompts, quiet, 2.6, 0.25, attempts=3, wave=4) >= 10 and silent.spent() == 2.5


def test_answers_become_intents(spark):
    work = spark.createDataFrame([("b", "t1"), ("b", "t2"), ("c", "t3")], "batch string, tool_id string")
    told = [
        ("b", 'Sure:\n```json\n[{"tool_id":"t1","query":" do it "},{"tool_id":"t2","query":"x","skip":true},{"tool_id":"t3","query":"other batch"},{"tool_id":"t2","query":"  "}]\n```'),
        ("c", '[{"tool_id":"t3","query":"hard","separable":false,"distinction":"none"}]'),
        ("d", "no array"), ("e", "[{broken"), ("f", None),
    ]
    answers = spark.createDataFrame(told, "batch string, answer string")
    rows = {r["intent_id"]: r for r in E.generated_intents(answers, work, "confusion", "L2").collect()}
    assert set(rows) == {"confusion_L2_b_0", "confusion_L2_c_0"}
    assert (rows["confusion_L2_b_0"]["query"], rows["confusion_L2_b_0"]["task_variant"], rows["confusion_L2_c_0"]["task_variant"], rows["confusion_L2_c_0"]["difficulty"]) == ("do it", "unambiguous", "ambiguous", "L5")
    none = spark.createDataFrame([("g", '[{"query":"impossible","why_unsupported":"no tool"},{"query":""}]')], "batch string, answer string")
    r = E.generated_intents(none, work, "abstain", "L2").collect()
    assert len(r) == 1 and (r[0]["gold_tool_ids"], r[0]["task_variant"], r[0]["why_unsupported"]) == ([], "unsupported", "no tool")


def test_selector_round_trip(spark, tmp_path):
    items = spark.createDataFrame([("b", q, f"ask {q}", s, f"tool {q}{s}") for q in (1, 2, 3, 4) for s in (2, 1)], "batch string, id long, query string, slot int, block string")
    prompts = E.selector_prompts(items)
    text = prompts.first()["prompt"]
    assert text.index("request: ask 1") < text.index("tool 11") < text.index("tool 12") < text.index("id: 2")
    answer = '[{"id":"1","choice":"x"},{"id":"1","choice":"late"},{"id":"2","choice":" None ","tied":true},{"id":"3"},{"id":"9","choice":"not asked"}]'
    ledger = E.Ledger(spark, str(tmp_path))
    ledger.run(prompts, E.replayed(spark.createDataFrame([("b", answer, 0.1)], "batch string, answer string, cost double")), 1.0, 0.1)
    got = E.selected(ledger.answers(), items)
    assert sorted(tuple(r) for r in got.collect()) == [("1", "x", False), ("2", "NONE", True), ("3", "NONE", False)]
    work = spark.createDataFrame([(str(q), "s", "x") for q in (1, 2, 3, 4)], "id string, split string, gold string")
    r = M.selector_tally(work, got).first()
    assert (r["correct"], r["none"], r["tied"], r["missing"]) == (1, 2, 1, 1)


def test_prompts_of_the_modes(spark):
    units = spark.createDataFrame([("b", k, f"block {k}", f"other {k}") for k in (2, 1)], "batch string, pos long, block string, near string")
    assert E.standard_prompts(units, "terse").first()["prompt"].count("terse") == 1
    assert " 3 " in E.abstain_prompts(units, 3).first()["prompt"]
    text = E.confusion_prompts(units.selectExpr("batch", "pos", "block AS target", "near AS neighbour")).first()["prompt"]
    assert text.index("block 1") < text.index("other 1") < text.index("block 2")
