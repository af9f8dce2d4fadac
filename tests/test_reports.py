"""Calibration, catalog drift and call arguments, held against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import arguments as A
from siftwell.operators import calibration as V
from siftwell.operators import drift as T
from siftwell.operators.dense import dense_topk

ITEMS = "tid long, confidence double, correct boolean, place string"


def points(rows):
    """Key, coverage and risk of each item, and its calibration bins, one after the other."""
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    wrong, curve, bins = 0, [], {}
    for i, (tid, confidence, correct, _) in enumerate(order):
        wrong += not correct
        curve.append((tid, round((i + 1) / len(order), 9), round(wrong / (i + 1), 9)))
        bins.setdefault(i * V.BINS // len(order), []).append((confidence or 0.0, bool(correct)))
    return curve, bins


@pytest.mark.parametrize("size", [1, 3, 10, 137])
def test_risk_coverage(spark, size):
    """Many ties, nulls, and a column with the name of a result."""
    rng = random.Random(size)
    rows = [(i, rng.choice([None, 0.1, 0.5, 0.5, 0.9]), rng.choice([True, False, None]), "x") for i in rng.sample(range(10 * size), size)]
    items = spark.createDataFrame(rows, ITEMS)
    curve, bins = points(rows)
    got = V.risk_coverage(items, "tid").orderBy("place").collect()
    assert [(r["tid"], r["coverage"], r["risk"]) for r in got] == curve
    tell = {b: (len(x), sum(c for c, _ in x) / len(x), sum(y for _, y in x) / len(x)) for b, x in bins.items()}
    assert {r["bin"]: (r["n"], r["confidence"], r["accuracy"]) for r in V.calibration_bins(items, "tid").collect()} == {b: pytest.approx(x, abs=1e-6) for b, x in tell.items()}
    report = V.selective_report(items, "tid").first()
    assert report["n"] == size and report["aurc"] == pytest.approx(np.mean([x[2] for x in curve]), abs=1e-6)
    assert report["ece"] == pytest.approx(sum(n * abs(a - c) for n, c, a in tell.values()) / size, abs=1e-6)
    assert report["risk_50"] == pytest.approx(curve[-(-size // 2) - 1][2], abs=1e-6)


def test_rounding_is_of_the_scaled_double(spark):
    """41 / 5120 prints as 0.0080078125, but scaled by 10**9 it is below the half."""
    rows = [(i, 1.0, i >= 41, "x") for i in range(5120)]
    got = V.risk_coverage(spark.createDataFrame(rows, ITEMS), "tid").where("place = 5120").first()
    assert got["risk"] == 0.008007812


def test_no_items(spark):
    none = spark.createDataFrame([], ITEMS)
    assert V.risk_coverage(none, "tid").collect() == [] and V.calibration_bins(none, "tid").collect() == []
    report = V.selective_report(none, "tid").first()
    assert report["n"] == 0 and report["aurc"] is None and report["risk_50"] is None


def test_catalog_diff(spark):
    """Rows of a key in another order are the same; one more copy is a change; null keys and null contents are compared."""
    ddl = "tid string, a string, b array<int>"
    old = spark.createDataFrame([("same", "x", [1]), ("same", "y", None), ("gone", "x", []), ("other", None, [1]), ("twice", "x", [1]), (None, "x", [1])], ddl)
    new = spark.createDataFrame([("same", "y", None), ("same", "x", [1]), ("new", "x", []), ("other", "", [1]), ("twice", "x", [1]), ("twice", "x", [1]), (None, "x", [1])], ddl)
    diff = lambda a, b: {r["tid"]: r["status"] for r in T.catalog_diff(a, b, "tid", ["a", "b"]).collect()}
    assert diff(old, new) == {"same": "same", "gone": "removed", "new": "added", "other": "changed", "twice": "changed", None: "same"}
    assert set(diff(old.limit(0), new).values()) == {"added"} and set(diff(old, new.limit(0)).values()) == {"removed"}
    assert diff(old.limit(0), new.limit(0)) == {}


@pytest.mark.parametrize("k", [3, 500])
def test_refreshed_results_equal_a_new_search(spark, k):
    """Few and all rows, ties by equal vectors; only queries that lost a row, or had none, are searched again."""
    rng = np.random.default_rng(4)
    v = {i: np.round(rng.normal(size=5), 1).tolist() for i in range(120)}
    v |= {i: v[i - 60] for i in range(100, 110)}
    old = {i: x for i, x in v.items() if i % 10 != 3}
    new = {i: (x[::-1] if i % 40 == 5 else x) for i, x in v.items() if i % 50 != 7}
    frame = lambda rows, ddl: spark.createDataFrame([*rows.items()], ddl)
    before, after = frame(old, "tid long, v array<double>"), frame(new, "tid long, v array<double>")
    queries = frame({i: v[i] for i in range(0, 120, 4)}, "qid long, qv array<double>")
    known = dense_topk(queries, before, k, same=True)
    got = T.refresh_topk(known.where("qid <> 8"), queries, before, after, k, same=True).collect()
    rows = lambda x: sorted((r["qid"], r["rank"], r["tid"], r["score"]) for r in x)
    assert rows(got) == rows(dense_topk(queries, after, k, same=True).collect())
    lost = {r["qid"] for r in known.collect() if r["tid"] not in new or new[r["tid"]] != old[r["tid"]]} | {8}
    assert {r["qid"] for r in got if r["searched"]} == lost
    assert k > 100 or len(lost) < 30


CALLS = [
    ('{"n": 1, "s": "a"}', "", 2, 1.0),
    ('{"s":"a",  "n":1}', "", 2, 1.0),
    ('{"n": "1", "s": "a"}', "type:n", 1, 0.5),
    ('{"n": 1.5, "s": "a", "z": {}}', "type:n unknown:z", 1, 0.4),
    ('{"s": "a", "x": 3, "any": [1]}', "missing:n", 1, 0.4),
    ('{"n": null, "o": {"b": 1, "a": [2]}}', "type:n", 0, 0.0),
    ('{"n": 1, "o": [1], "l": [1], "f": true}', "type:o", 1, 1 / 3),
    ("{}", "missing:n", 0, 0.0),
    ("[1]", "not an object", 0, 0.0),
    ("{n", "not an object", 0, 0.0),
    ("", "not an object", 0, 0.0),
    (None, "not an object", 0, 0.0),
]


def test_call_arguments(spark):
    types = {"n": "integer", "s": "string", "x": "number", "o": "object", "l": "array", "f": "boolean", "any": None}
    properties = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).cast("string").alias("type")) for n, t in types.items()])
    calls = spark.createDataFrame([(i, "g", said, '{"n": 1, "s": "a"}') for i, (said, *_) in enumerate(CALLS)], "id int, part string, said string, gold string")
    checked = A.checked_calls(calls, "said", "gold", properties, F.array(F.lit("n")))
    got = {r["id"]: (" ".join(r["errors"]), r["hits"], pytest.approx(r["f1"])) for r in checked.collect()}
    assert got == {i: (errors, hits, f1) for i, (_, errors, hits, f1) in enumerate(CALLS)}
    s = A.argument_scores(checked, "part").first()
    assert (s["n"], s["valid"]) == (12, pytest.approx(2 / 12, abs=1e-6)) and s["recall"] == pytest.approx(8 / 24, abs=1e-6)
    assert s["mean_f1"] == pytest.approx(sum(x[3] for x in CALLS) / 12, abs=1e-6)
    assert A.argument_scores(checked.limit(0), "part").collect() == []


def test_nested_values_and_empty_sets(spark):
    rows = [(1, '{"o": {"a": 1, "b": [1, 2]}}', '{"o": {"b": [1,2], "a": 1}}'), (2, '{"o": {"a": 1}}', '{"o": {"a": 2}}'), (3, "{}", "{}"), (4, "{}", None)]
    checked = A.checked_calls(spark.createDataFrame(rows, "id int, said string, gold string"), "said", "gold", F.lit(None).cast("array<struct<name:string,type:string>>"), F.lit(None).cast("array<string>"))
    assert {r["id"]: (r["f1"], r["errors"]) for r in checked.collect()} == {1: (1.0, ["unknown:o"]), 2: (0.0, ["unknown:o"]), 3: (1.0, []), 4: (1.0, [])}


def test_disagreements_round_as_sql(spark, tmp_path):
    """The mean of the first customer prints as 182314.79875 or next to it; scaled it is below the half."""
    from siftwell.plans.queries import run_disagreements

    prices = [395084.15, 64069.33, 335501.22, 185571.2, 34711.32, 10303.14, 107695.75, 325582.28]
    rows = [(2 * i + 1, 1, p) for i, p in enumerate(prices[:-1])] + [(16, 1, prices[-1])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    total = 0.0
    for p in prices:
        total += p
    assert tuple(run_disagreements(spark, str(tmp_path)).first()) == (1, float(np.floor(total / 8 * 1e4 + 0.5) / 1e4), prices[-1])
