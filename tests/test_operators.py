"""Guardrails of retrieval, fusion and evaluation on small tables."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import redact as R
from siftwell.functions import stats as S
from siftwell.functions import text as X
from siftwell.operators import catalog as C
from siftwell.operators import composed as P
from siftwell.operators import dense as D
from siftwell.operators import fusion as U
from siftwell.operators import lexical as L
from siftwell.operators import metrics as M
from siftwell.operators import negatives as N
from siftwell.operators import similarity as Y
from siftwell.operators import splits as G
from siftwell.operators.graph import connected_components
from siftwell.operators.indexing import with_global_index, with_running_total
from siftwell.operators.ranking import rerank_depths
from siftwell.sources import tables as T


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]  # a tie
    return v, spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "tid long, v array<float>")


@pytest.fixture(scope="module")
def window(spark):
    rng = np.random.default_rng(2)
    rows = []
    for q in range(12):
        dense = np.sort(rng.random(40).round(2))[::-1]
        for c in range(40):
            rows.append((q, c + 1, int(c * 7 % 40), float(dense[c]), float(rng.choice([0.0, 0.0, 1.0, 2.0]))))
    return spark.createDataFrame(rows, "qid long, col int, tid long, dense double, other double").cache()


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame([(q, (q * 5) % 40) for q in range(12)] + [(3, 1000)], "qid long, tid long")


def test_dense_topk_and_rank(spark, vectors):
    v, index = vectors
    q = index.where("tid < 10").select(F.col("tid").alias("qid"), F.col("v").alias("qv"))
    f = v.astype("f4").astype("f8")
    s = np.round(f[:10] @ f.T, 6)
    for same in (False, True):
        t = s.copy()
        if same:
            t[np.arange(10), np.arange(10)] = -9
        got = {(r["qid"], r["rank"]): r["tid"] for r in D.dense_topk(q, index, 5, same).collect()}
        for i in range(10):
            order = np.lexsort((np.arange(60), -t[i]))
            assert [got[i, k + 1] for k in range(5)] == order[:5].tolist()
    golds = spark.createDataFrame([(i, (i * 3 + 11) % 60) for i in range(10)], "qid long, tid long")
    ranks = {r["qid"]: r["rank"] for r in D.dense_rank_of(q, index, golds).collect()}
    assert ranks == {i: int(np.flatnonzero(np.lexsort((np.arange(60), -s[i])) == (i * 3 + 11) % 60)[0]) + 1 for i in range(10)}
    assert D.not_finite(index).count() == 0 and D.not_finite(index.withColumn("v", F.array(F.lit(float("nan"))))).count() == 60


@pytest.mark.parametrize("rows", [20_000, 7])
def test_dense_blocks_ties_nulls(spark, monkeypatch, rows):
    """One broadcast block and many blocks by cogroup: equal vectors, a query's own row, null vectors, an empty index."""
    monkeypatch.setattr(D, "BLOCK_ROWS", rows)
    monkeypatch.setattr(D, "HELD", 10)
    v = np.random.default_rng(5).integers(-2, 3, (40, 3)).astype("f8")
    v[10:30] = v[3]
    ids = [(i * 17) % 40 for i in range(40)]
    index = spark.createDataFrame([(ids[i], v[i].tolist()) for i in range(40)] + [(99, None), (None, [1.0, 1.0, 1.0])], "tid long, v array<double>").repartition(3)
    q = index.withColumnsRenamed({"tid": "qid", "v": "qv"})
    at = {t: v[i] for i, t in enumerate(ids)}
    order = {a: sorted((t for t in ids if t != a), key=lambda t: (-(at[a] @ at[t]), t)) for a in ids}
    got = {(r["qid"], r["rank"]): r["tid"] for r in D.dense_topk(q, index, 6, same=True).collect()}
    assert got == {(a, k + 1): order[a][k] for a in ids for k in range(6)}
    golds = spark.createDataFrame([(a, (a + d) % 40) for a in ids for d in (0, 5, 9)], "qid long, tid long")
    ranks = {r["qid"]: r["rank"] for r in D.dense_rank_of(q, index, golds, same=True).collect()}
    assert ranks == {a: 1 + min(order[a].index((a + d) % 40) for d in (5, 9)) for a in ids}
    mean, top = D.geometry_probe(q, index, same=True).first()
    assert mean == pytest.approx(np.mean([at[a] @ at[t] for a in ids for t in order[a]]), abs=1e-6)
    assert top == pytest.approx(np.mean([at[a] @ at[order[a][0]] for a in ids]), abs=1e-6)
    sized = index.join(spark.createDataFrame([(t, k if k < 30 else -1) for k, t in enumerate(ids)], "tid long, nth long"), "tid")
    marked = golds.where(F.col("tid").isin(ids[30:]))
    gold_of = {(r["qid"], r["tid"]) for r in marked.collect() if r["qid"] != r["tid"]}
    want = {}
    for pool in (5, 20, 40):
        held = {t for k, t in enumerate(ids) if k >= 30 or k < pool}
        for a in {a for a, _ in gold_of}:
            want[pool, a] = 1 + next(k for k, t in enumerate(t for t in order[a] if t in held) if (a, t) in gold_of)
    assert {(r["pool"], r["qid"]): r["rank"] for r in D.dense_pool_ranks(q, sized, marked, [5, 20, 40], same=True).collect()} == want
    asked = spark.createDataFrame([(a, t, float(at[a] @ at[t])) for a in ids for t in order[a][::7]], "qid long, tid long, score double")
    places = {(r["qid"], r["tid"]): (r["col"], r["worst"]) for r in D.dense_places(asked, q, index, same=True).collect()}
    assert places == {(a, t): (order[a].index(t) + 1, sum(at[a] @ at[x] >= at[a] @ at[t] for x in order[a])) for a in ids for t in order[a][::7]}
    assert D.dense_topk(q, index.where("tid < 0"), 6).count() == 0 and D.dense_topk(q.where("qid < 0"), index, 6).count() == 0


@pytest.mark.parametrize("rule", U.RULES)
@pytest.mark.parametrize("depth", [10, 25])
def test_alpha_zero_is_dense(window, rule, depth):
    if rule == "zscore":
        pass
    moved = U.fuse(window, 0.0, rule, depth)
    if rule == "rrf_tie":  # tied dense scores may only change places with each other: position breaks the tie
        assert moved.where("new_rank <> col").count() == 0
    assert moved.where("new_rank <> col").count() == 0


def test_alpha_one_zscore_is_replacement(window):
    fused = U.fuse(window, 1.0, "zscore", 25).select("qid", "tid", "new_rank")
    replaced = rerank_depths(window, [25], "other").select("qid", "tid", F.col("new_rank").alias("r"))
    assert fused.join(replaced, ["qid", "tid"]).where("new_rank <> r").count() == 0


def test_rerank_keeps_recall_beyond_its_depth(window, gold):
    base = M.recall_mrr(M.best_gold_rank(window.withColumn("rank", F.col("col")), gold, gold)).first()
    new = M.recall_mrr(M.best_gold_rank(U.fuse(window, 0.7, "rrf_tie", 25).withColumn("rank", F.col("new_rank")), gold, gold)).first()
    assert all(base[f"r_at_{k}"] == new[f"r_at_{k}"] for k in (25, 50, 100))


def test_sweep_agrees_with_single_fusions(window, gold):
    swept = U.sweep(window, gold, rules=("rrf_tie",), depths=(25,), alphas=(0.3,)).select("qid", "rank")
    one = M.best_gold_rank(U.fuse(window, 0.3, "rrf_tie", 25).withColumn("rank", F.col("new_rank")), gold, gold)
    assert sorted(map(tuple, swept.collect())) == sorted(map(tuple, one.collect()))


def test_worst_tie_rank_of_zeros(spark):
    from siftwell.operators.ranking import worst_tie_rank

    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([3.0, 2.0, 2.0, 0.0, 0.0])], "qid long, tid long, score double")
    assert [r[0] for r in df.select(worst_tie_rank(), "tid").orderBy("tid").collect()] == [1, 3, 3, 5, 5]


def test_bm25(spark):
    texts = ["the cat sat on the mat", "a dog", "", None, "the the the cat"]
    docs = spark.createDataFrame(list(enumerate(texts)), "tid long, text string")
    index = L.build_bm25(docs, F.col("text"))
    tok = [(t or "").split() for t in texts]
    mean = sum(map(len, tok)) / 5
    df = {w: sum(w in t for t in tok) for t in tok for w in t}

    def score(q, d):
        return sum(math.log(1 + (5 - df[w] + 0.5) / (df[w] + 0.5)) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for w in q if w in d)

    queries = spark.createDataFrame([(0, "the cat the"), (1, "unknown"), (2, None)], "qid long, text string")
    got = {(r["qid"], r["tid"]): r["score"] for r in L.bm25_scores(index, queries, F.col("text")).collect()}
    assert got == {(0, d): pytest.approx(score(["the", "cat", "the"], tok[d]), abs=1e-6) for d in (0, 4)}
    few = L.build_bm25(docs, F.col("text"), only=L.asked_terms(queries, F.col("text")).select("w").distinct())
    assert {(r["qid"], r["tid"]): r["score"] for r in L.bm25_scores(few, queries, F.col("text")).collect()} == got
    assert {r["w"] for r in few.terms.collect()} == {"the", "cat"}
    full = L.full_scores(L.bm25_scores(index, queries, F.col("text")), spark.createDataFrame([(1, 0), (0, 1)], "qid long, tid long"))
    assert [r["score"] for r in full.collect()] == [0.0, 0.0]


def test_mcnemar(spark):
    def exact(b, c):
        n = b + c
        return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0

    cases = [(10, 1), (0, 0), (5, 5), (1, 0), (300, 340), (0, 12), (14, 12)]
    df = spark.createDataFrame(cases, "b long, c long")
    assert [r[0] for r in df.select(S.mcnemar_p(F.col("b"), F.col("c"))).collect()] == [pytest.approx(exact(*x), rel=1e-6) for x in cases]


def test_bootstrap_interval_holds_the_delta(spark):
    rng = np.random.default_rng(3)
    rows = [("a", i, int(x) if x < 50 else None, int(max(1, x - 1))) for i, x in enumerate(rng.integers(1, 60, 400))]
    pairs = spark.createDataFrame(rows, "label string, qid long, base_rank int, new_rank int")
    one, two = (S.paired_bootstrap(p, ["label"], "qid", k=10, reps=500).first() for p in (pairs, pairs.repartition(7)))
    d = S.paired_outcomes(pairs, ["label"], k=10).first()
    assert one == two and one["n"] == 400 and one["r_low"] <= d["d_r"] <= one["r_high"] and one["mrr_low"] <= d["d_mrr"] <= one["mrr_high"]


def test_headroom_is_null_without_reference(spark):
    items = spark.createDataFrame([("a", 1), ("a", 40), ("b", None)], "bucket string, rank int")
    assert M.headroom(items, "bucket", "zzz").first()[0] is None
    assert M.headroom(items, "bucket", "a").first()["headroom_1"] == pytest.approx(1 / 6, abs=1e-4)
    shares = {r["bucket"]: r["share_misses"] for r in M.bucket_stats(items, "bucket").collect()}
    assert shares == {"a": 0.5, "b": 0.5}


def test_selector_and_conditional_accuracy(spark):
    work = spark.createDataFrame([(1, "s", "x"), (2, "s", "x"), (3, "s", "x")], "id long, split string, gold string")
    answers = spark.createDataFrame([(1, "x", False), (2, "NONE", True)], "id long, choice string, tied boolean")
    r = M.selector_tally(work, answers).first()
    assert (r["n"], r["correct"], r["none"], r["tied"], r["missing"], r["accuracy"]) == (2, 1, 1, 1, 1, 0.5)
    rows = spark.createDataFrame([("s", True, False)], "split string, correct boolean, has_gold boolean")
    assert M.conditional_accuracy(rows).first()["given_gold"] is None


def test_components_and_partition(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(edges.limit(0)).count() == 0
    intents = spark.createDataFrame([(k, k % 50 if k % 9 else None) for k in range(300)], "intent_id long, tool long")
    part = G.partition_components(intents, connected_components(edges), 0.33, "s")
    golds = intents.where("tool IS NOT NULL").select("intent_id", F.col("tool").alias("tool_id"))
    assert part.count() == 300 and G.audit(part, golds).count() == 0
    with pytest.raises(ValueError):
        G.select_split(intents, part, "absent")


def test_global_index_and_running_total(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert with_global_index(df, [F.col("x")], "k").where("k <> x").count() == 0
    t = with_running_total(df, [F.col("x")], "x", "before")
    assert t.where(F.col("before") != (F.col("x") * (F.col("x") - 1) / 2).cast("long")).count() == 0


def test_hold_out_is_exact(spark):
    held = G.hold_out(spark.range(57).select("id"), "id", 0.2, 3)
    assert held.where("is_heldout").count() == 11 and held.count() == 57


def test_hard_negatives(spark):
    ranked = spark.createDataFrame([(1, t, r + 1) for r, t in enumerate([5, 6, 7, 8])] + [(2, 5, 1)], "qid long, tid long, rank int")
    gold = spark.createDataFrame([(1, 5), (2, 5)], "qid long, tid long")
    vec = spark.createDataFrame([(5, [1.0, 0.0]), (6, [0.99, 0.1]), (7, [0.0, 1.0]), (8, [0.6, 0.8])], "tid long, v array<double>")
    rows = N.hard_negatives(ranked, gold, vec).collect()
    assert [(r["qid"], r["negatives"], r["found"], r["dropped"]) for r in rows] == [(1, [7, 8, 8, 8], 2, 1)]
    source = vec.withColumn("source", F.lit("s"))
    assert N.provenance(N.hard_negatives(ranked, gold, vec), source).first()["n"] == 2


def test_shortlists(spark):
    ranked = spark.createDataFrame([(q, t, t + 1) for q in (1, 2) for t in range(30)], "qid long, tid long, rank int")
    gold = spark.createDataFrame([(1, 99), (1, 3)], "qid long, tid long")
    queries = spark.createDataFrame([(1,), (2,)], "qid long")
    got = P.oracle_shortlist(ranked, gold, queries, 10, "s").collect()
    one, two = ({r["tid"] for r in got if r["qid"] == q} for q in (1, 2))
    assert len(one) == 10 and {3, 99} <= one and two == set(range(10))
    items = spark.createDataFrame([(1, "q", 5), (1, "q", 6), (2, "q", 6), (2, "q", 5), (3, "r", 5)], "item long, query string, tid long")
    owners = P.dedup_shortlists(items)
    assert {r["item"]: r["owner"] for r in owners.collect()} == {1: 1, 2: 1, 3: 3}
    answers = spark.createDataFrame([(1, "x")], "item long, choice string")
    out = {r["item"]: r["missing"] for r in P.with_answers(items.select("item").distinct(), owners, answers).collect()}
    assert out == {1: False, 2: False, 3: True}


SPEC = {
    "info": {"title": "Things"},
    "paths": {
        "/things/{thingId}": {
            "parameters": [{"$ref": "#/components/parameters/Id"}],
            "get": {"operationId": "getThing", "description": "Returns one thing.", "responses": {"404": {}, "200": {}}, "tags": list("abcdefg"), "parameters": [{"name": "page", "schema": {"type": ["integer", "null"]}, "in": "query"}]},
            "delete": {"summary": "Removes it", "security": [{"key": []}, {"auth": []}], "deprecated": True},
            "trace": {"summary": "is no operation here"},
        },
        "/nodes": {"post": {"requestBody": {"content": {"text/x": {}, "application/vnd+json": {"schema": {"$ref": "#/components/schemas/a~1b"}}}}}},
        "broken": "text",
    },
    "components": {
        "parameters": {"Id": {"name": "thingId", "required": True, "in": "path", "description": "x" * 400, "schema": {"$ref": "#/nowhere"}}},
        "schemas": {"a/b": {"properties": {"self": {"$ref": "#/components/schemas/a~1b"}, "page": {"type": "string"}}, "required": ["self", 3]}},
    },
}


def test_operations_of_a_cyclic_spec(spark):
    rows = [("api:one", "p", "T", ["web"], "u", json.dumps(SPEC), 1), ("api:bad", "p", "T", ["web"], "u", "not json", 2), ("api:one", "p", "T", [], "u", json.dumps(SPEC), 3)]
    specs = spark.createDataFrame(rows, "api_id string, provider string, title string, categories array<string>, url string, body string, pos long")
    tools, failed = C.tools_of_specs(specs, 10)
    got = {r["tool_id"]: r for r in tools.collect()}
    assert set(got) == {"api_one_getthing", "api_one_delete_things_thingid", "api_one_post_nodes"} and all(r["pos"] == 1 for r in got.values())
    get = got["api_one_getthing"]
    assert [(p["name"], p["type"], p["in"], len(p["description"])) for p in get["parameters"]["properties"]] == [("thingId", "string", "path", 300), ("page", '["integer", "null"]', "query", 0)]
    assert get["parameters"]["required"] == ["thingId"] and get["returns"] == ["200", "404"] and len(get["tags"]) == 5 and get["http"]["method"] == "GET"
    gone = got["api_one_delete_things_thingid"]
    assert gone["side_effects"] == "destructive" and gone["auth_scope"] == ["auth", "key"] and gone["deprecated"] and gone["description"] == "Removes it"
    body = got["api_one_post_nodes"]
    assert [p["name"] for p in body["parameters"]["properties"]] == ["self", "page"] and body["parameters"]["required"] == ["self"] and body["side_effects"] == "write"
    assert [r["api_id"] for r in failed.collect()] == ["api:bad"]


def test_text_functions(spark):
    df = spark.createDataFrame([("/v1/timezone/{area}/userName.txt",)], "p string")
    one = lambda c: df.select(c).first()[0]
    assert one(X.humanize(F.col("p"))) == "v1 timezone user Name txt"
    assert one(X.slug(F.lit("Api: X"), F.lit(""), F.lit("__a--b"))) == "api_x_a_b"
    assert one(X.dedup_key(F.lit("B, a  a!"))) == "a a b" and one(X.norm_key(F.lit(None).cast("string"))) == ""
    assert one(X.tokens(F.lit("Éa B2-c"))) == ["a", "b2", "c"] and one(X.word_count(F.lit("  a b\n"))) == 2
    assert one(X.first_filled(F.lit(""), F.lit("x"))) == "x"
    assert one(X.with_prefix(F.lit("t"), F.lit("intfloat/e5-base-v2"), X.DOC_PREFIX)) == "passage: t" and one(X.with_prefix(F.lit("t"), F.lit("other"), X.DOC_PREFIX)) == "t"
    assert one(X.doc_quality(F.lit("x" * 130), F.array(F.lit("long enough"), F.lit("")))) == 4
    none = F.array().cast("array<string>")
    assert one(X.doc_quality(F.lit(None).cast("string"), none)) == 0 and one(X.doc_quality(F.lit("x" * 130), none)) == 2
    schema = "array<struct<id:string,choice:string,tied:boolean>>"
    assert [tuple(x) for x in one(X.fenced_json(F.lit('Sure.\n```json\n[{"id":"1","choice":"a","tied":true}]\n```'), schema))] == [("1", "a", True)]
    assert one(X.fenced_json(F.lit("no array"), schema)) == [] and one(X.fenced_json(F.lit("[{broken"), schema)) == []


def test_redaction(spark):
    t = "AKIA" + "A" * 16 + " sk_live_12345678 xoxb-123456-abcdef eyJhbGciOiJIUzI1NiJ9.abc.def Bearer abcdefghijklmnop /home/jo/x/report.pdf"
    df = spark.createDataFrame([("f", t)], "file string, t string")
    once = df.select(R.redact(F.col("t"), generated=True).alias("t"), "file")
    assert once.first()["t"].endswith("./report.pdf") and R.redaction_counts(once, "t", "file", True).where("class <> 'home_path'").count() == 0
    assert {r["class"]: r["n"] for r in R.redaction_counts(df, "t", "file", True).collect()} == {"aws_key_id": 1, "stripe_key": 1, "slack_token": 1, "jwt": 1, "bearer": 1, "home_path": 1}
    assert "/home/jo" in df.select(R.redact(F.col("t"))).first()[0]


def test_sources(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"intent_id":"1","side":"dev"}\n\n{"intent_id":"2","side":"test"}\n')
    df = T.read_jsonl(spark, str(p), "partition")
    assert df.count() == 2
    p.write_text("{broken\n")
    with pytest.raises(Exception):
        T.read_jsonl(spark, str(p), "partition").collect()
    (tmp_path / "o.json").write_text('{"a":"x","b":"y"}')
    assert {tuple(r) for r in T.read_json_object(spark, str(tmp_path / "o.json")).collect()} == {("a", "x"), ("b", "y")}
    (tmp_path / "l.json").write_text('[{"n":1},{"n":2}]')
    assert [r["value"] for r in T.read_list_or_object(spark, str(tmp_path / "l.json")).collect()] == ['{"n":1}', '{"n":2}']
    (tmp_path / "x.json").write_text("nonsense{")
    assert T.read_list_or_object(spark, str(tmp_path / "x.json")).first()["error"].startswith("not JSON")
    (tmp_path / "c.csv").write_text('Query,Tool\n"a ""b""\nc",t\n')
    assert [tuple(r) for r in T.read_csv(spark, str(tmp_path / "c.csv"), "Query string, Tool string").collect()] == [('a "b"\nc', "t")]
    T.write_table(df.limit(0), str(tmp_path / "t"))
    with pytest.raises(Exception):
        T.write_table(df.limit(0), str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    assert T.digest(a).first() == T.digest(a.orderBy(F.desc("a"))).first() != T.digest(a.where("a = 1")).first()
    meta = spark.createDataFrame([("m", "intfloat/e5-base-v2", "query: ", None)], "matrix string, model string, query_prefix string, doc_prefix string")
    assert T.matrix_entry(meta, "m", query_prefix="")["query_prefix"] == "" and T.matrix_entry(meta, "m")["query_prefix"] == "query: "
    with pytest.raises(ValueError):
        T.matrix_entry(meta, "unknown")
    assert T.matrices(["a", "b", "a", "base"], "base") == ["a", "b"]

    def load(url):
        if url == "bad":
            raise OSError("gone")
        return "{}"

    got = {r["api_id"]: r["error"] for r in T.fetch_landed(spark.createDataFrame([("1", "ok"), ("2", "bad")], "api_id string, url string"), load).collect()}
    assert got == {"1": None, "2": "OSError: gone"}


@pytest.mark.parametrize("cell_rows", [7, 1000])
def test_pruned_join_finds_all(spark, monkeypatch, cell_rows):
    """Clustered and unclustered vectors, vectors that are not of length 1, ties, nulls and values that are not finite."""
    monkeypatch.setattr(Y, "PART_ROWS", 9)
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(c * 3, 0.4, (40, 6)) for c in range(3)] + [rng.normal(0, 1, (40, 6)), np.tile(rng.normal(0, 2, 6), (5, 1))])
    ids = [(i * 37) % len(v) for i in range(len(v))]
    rows = [(ids[i], x.tolist()) for i, x in enumerate(v)]
    index = spark.createDataFrame(rows + [(900, None), (None, [1.0] * 6), (901, [float("nan")] * 6), (902, [float("inf")] * 6)], "tid long, v array<double>")
    q = index.withColumnsRenamed({"tid": "qid", "v": "qv"})
    s = {(ids[a], ids[b]): round(float(v[a] @ v[b]), 6) for a in range(len(v)) for b in range(len(v)) if a != b}
    for least in (20.0, 60.0, 1e6):
        b = Y.blocks(q, index, least, same=True, cell_rows=cell_rows)
        assert {(r[0], r[1]) for r in Y.pairs_above(b).collect()} == {k for k, x in s.items() if x > least}
        assert sorted(r[0] for r in Y.flags_above(b).collect()) == sorted({k[0] for k, x in s.items() if x > least})
        best = {}
        for (a, t), x in s.items():
            if x >= least:
                best[a] = min(best.get(a, (-x, t)), (-x, t))
        assert {r["qid"]: r["tid"] for r in Y.nearest_above(b).collect()} == {a: t for a, (_, t) in best.items()}
    none = Y.blocks(q, index.limit(0), 1.0)
    assert Y.pairs_above(none).count() == 0 and Y.pairs_above(Y.blocks(q.limit(0), index, 1.0)).count() == 0


def test_pruned_join_multiplies_less(spark):
    """On clustered vectors of length 1 fewer than a fifth of all products are made, and no partner is lost."""
    rng = np.random.default_rng(10)
    centres = rng.normal(0, 1, (40, 32))
    v = np.repeat(centres, 50, 0) + rng.normal(0, 0.1, (2000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "tid long, v array<double>")
    b = Y.blocks(index.toDF("qid", "qv"), index, 0.9, same=True, cell_rows=40)
    assert b.products() < 2000 * 2000 / 5
    s = np.round(v @ v.T, 6)
    np.fill_diagonal(s, -1)
    assert Y.pairs_above(b, strict=False).count() == (s >= 0.9).sum()


@pytest.mark.parametrize("alpha", [0.0, 0.2, 0.9, 1.0])
def test_threshold_fusion_equals_the_grid(spark, alpha):
    """Short first lists, many equal scores, queries without lexical rows."""
    rng = np.random.default_rng(12)
    v = rng.integers(-2, 3, (90, 3)).astype("f8")
    index = spark.createDataFrame([(i, v[i].tolist()) for i in range(90)], "tid long, v array<double>")
    q = index.where("tid % 6 = 0").toDF("qid", "qv")
    lex = [(a, int(t), float(rng.integers(0, 4))) for a in range(0, 80, 6) for t in rng.choice(95, 1 + a, False)]
    scores = spark.createDataFrame(lex, "qid long, tid long, other double")
    other = {(a, t): x for a, t, x in lex}
    got = {(r["qid"], r["new_rank"]): (r["tid"], r["fused"]) for r in U.fuse_full(q, index, scores, alpha, 5, same=True, first=1).collect()}
    want = {}
    for a in range(0, 90, 6):
        tids = sorted((t for t in range(90) if t != a), key=lambda t: (-(v[a] @ v[t]), t))
        d, l = [v[a] @ v[t] for t in tids], [max(other.get((a, t), 0.0), 0.0) for t in tids]
        worst = lambda x, xs: sum(y >= x for y in xs)
        f = [round((1 - alpha) / (60 + worst(d[i], d)) + alpha / (60 + worst(l[i], l)), 9) for i in range(89)]
        for k, i in enumerate(sorted(range(89), key=lambda i: (-f[i], i))[:5]):
            want[a, k + 1] = (tids[i], f[i])
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}


def test_lexical_pools(spark):
    rng = random.Random(3)
    scores = [(q, t, float(rng.randint(1, 5))) for q in range(6) for t in rng.sample(range(60), 25)]
    gold = [(q, t) for q in range(7) for t in range(50 + q, 60, 7)]
    marked = {t for _, t in gold}
    order = [(t, -1 if t in marked else k) for k, t in enumerate(range(60))]
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = {(r["pool"], r["qid"]): r["rank"] for r in L.pool_ranks(df(scores, "qid long, tid long, score double"), df([(q,) for q in range(8)], "qid long"), df(gold, "qid long, tid long"), df(order, "tid long, nth long"), [10, 60]).collect()}
    for pool in (10, 60):
        held = {t for t, nth in order if nth < pool}
        for q in range(8):
            ranked = [t for _, t in sorted((-s, t) for a, t, s in scores if a == q and t in held)]
            assert got[pool, q] == next((k + 1 for k, t in enumerate(ranked) if (q, t) in gold), None)


def test_replicate_weights(spark):
    """Weights are Poisson of mean 1, sums of parts add up, and the interval is about as wide as by formula."""
    rng = np.random.default_rng(2)
    d = rng.integers(-3, 6, 1500)
    rows = spark.createDataFrame([("x", i, int(x)) for i, x in enumerate(d)], "g string, id long, d long").withColumn("m", F.lit(1).cast("long"))
    whole = {r["rep"]: (r["m"], r["d"]) for r in S.replicate_sums(rows, ["g"], "id", ["m", "d"], 60).collect()}
    assert sorted(whole) == list(range(60)) and abs(np.mean([m for m, _ in whole.values()]) / 1500 - 1) < 0.01
    parts = [{r["rep"]: (r["m"], r["d"]) for r in S.replicate_sums(rows.where(f"id % 2 = {k}"), ["g"], "id", ["m", "d"], 60).collect()} for k in (0, 1)]
    assert whole == {k: tuple(map(sum, zip(parts[0][k], parts[1][k]))) for k in whole}
    r = S.mean_difference_interval(rows.withColumn("zero", F.lit(0)), ["g"], "zero", "d", "id", reps=1000).first()
    se = d.std() / math.sqrt(len(d))
    assert r["mean_delta"] == pytest.approx(d.mean(), abs=1e-6) and r["low"] == pytest.approx(d.mean() - 1.96 * se, abs=0.4 * se) and r["high"] == pytest.approx(d.mean() + 1.96 * se, abs=0.4 * se)


def test_pruned_join_sends_no_row_for_each_cell(spark):
    """Without clusters all cells meet; the plan packs both sides once and deals nothing by pairs of cells."""
    rng = np.random.default_rng(12)
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (300, 8)))], "tid long, v array<double>")
    b = Y.blocks(index.toDF("qid", "qv"), index, 0.1, same=True, cell_rows=10)
    assert b.pairs.count() > 25 * 25
    sent = []
    reduce = lambda rows: sent.append(rows._jdf.queryExecution().executedPlan().toString()) or rows
    Y._met(b, lambda known, slices: [(known["qid"], [sum(len(t) for t, _ in slices)] * len(known["qid"]))], Y.pa.schema([("qid", Y.pa.int64()), ("n", Y.pa.int64())]), reduce)
    assert "CartesianProduct" in sent[0] and "FlatMapCoGroups" not in sent[0]


def test_dense_topk_sorts_few_rows_at_once(monkeypatch):
    """The fold of a worker against a full sort, and the most rows that it sorts: they follow HELD, not the queries times k."""
    got, sizes, plain = {}, [], D._k_best
    monkeypatch.setattr(D, "_product", lambda q, x, fold, *_: got.setdefault("fold", fold))
    monkeypatch.setattr(D, "top_k", lambda d, k: d)
    monkeypatch.setattr(D, "_k_best", lambda i, *a: sizes.append(len(i)) or plain(i, *a))
    monkeypatch.setattr(D, "HELD", 500)

    class Queries:
        select = lambda self, *_: self

    D.dense_topk(Queries(), None, 20, same=True)
    rng = np.random.default_rng(3)
    s, tid, qid = rng.integers(0, 50, (300, 4000)).astype("f8"), rng.permutation(4000), np.arange(300)
    rows = [np.concatenate(x) for x in zip(*got["fold"]({"qid": qid}, [(tid[a : a + 10], s[:, a : a + 10].copy()) for a in range(0, 4000, 10)]))]
    want = {(q, t) for q in qid for t in [tid[k] for k in np.lexsort((tid, -s[q])) if tid[k] != q][:20]}
    assert set(zip(rows[0], rows[1])) == want and max(sizes) < 300 * 20 / 2


def test_term_stats_without_postings(spark):
    """Rows of one document count once for a term; null ids, null texts and repeated words."""
    rows = [(1, "a b a"), (1, "a c"), (2, "b b"), (3, None), (None, "c d"), (None, "d")]
    docs = spark.createDataFrame(rows, "tid long, text string")
    got = {r["w"]: (r["df"], r["cf"], round(r["idf"], 9)) for r in L.term_stats(docs, F.col("text")).collect()}
    assert got == {w: (d, c, round(math.log(1 + (6 - d + 0.5) / (d + 0.5)), 9)) for w, d, c in (("a", 1, 3), ("b", 2, 3), ("c", 2, 2), ("d", 1, 2))}
