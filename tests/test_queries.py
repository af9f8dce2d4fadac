"""Registered queries against their SQL on the smallest tables, where those are at hand."""

from __future__ import annotations

import math
from pathlib import Path

import pytest

from siftwell.plans.registry import ORACLES, QUERIES

SF = Path("/root/testdata/sf0.001")


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    if not SF.exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", ["dense_recall_mrr", "bm25_topk", "fuse_rrf_tie", "route_splits", "component_partition", "hard_negatives", "doc_text_v3", "group_cap_sample", "mcnemar_exact"])
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, str(SF))
    cols = sorted(df.columns)
    r = db.execute(ORACLES[name])
    at = {c[0]: i for i, c in enumerate(r.description)}
    assert sorted(at) == cols
    want = sorted(repr(norm([row[at[c]] for c in cols])) for row in r.fetchall())
    assert sorted(repr(norm(list(row))) for row in df.select(*cols).collect()) == want


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
