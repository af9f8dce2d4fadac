"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import redact as R
from siftwell.functions import stats as S
from siftwell.functions import text as X
from siftwell.operators import arguments as A
from siftwell.operators import batches as B
from siftwell.operators import calibration as V
from siftwell.operators import catalog as C
from siftwell.operators import composed as P
from siftwell.operators import dense as D
from siftwell.operators import drift as T
from siftwell.operators import fusion as U
from siftwell.operators import generation as E
from siftwell.operators import lexical as L
from siftwell.operators import metrics as M
from siftwell.operators import negatives as N
from siftwell.operators import prompts as Q
from siftwell.operators import ranking as K
from siftwell.operators import similarity as Y
from siftwell.operators import splits as G
from siftwell.operators.indexing import with_global_index
from siftwell.plans import fixtures as fx
from siftwell.sources.cache import ScoreCache
from siftwell.sources.scratch import materialise, scratch_path, table
from siftwell.sources.splits import load_splits
from siftwell.sources.tables import digest, read_jsonl, write_jsonl

MIN_SIM = 0.40
RANKED = 100
POOLS = (100, 200, 400)


def _ranked(spark: SparkSession, sf: str, k: int = RANKED) -> DataFrame:
    return D.dense_topk(fx.queries(spark, sf), fx.index(spark, sf), k, same=True)


def dense_topk(spark, sf):
    return _ranked(spark, sf, 10)


def gold_rank(spark, sf):
    return D.dense_rank_of(fx.queries(spark, sf), fx.index(spark, sf), fx.gold(spark, sf), same=True)


def dense_recall_mrr(spark, sf):
    ranks = gold_rank(spark, sf).join(fx.queries(spark, sf).select("qid", "label"), "qid")
    return M.recall_mrr(ranks, ["label"])


def mean_top1_sim(spark, sf):
    return M.mean_top1(_ranked(spark, sf, 1))


def nn_graph(spark, sf):
    q = fx.queries(spark, sf).select("qid", "qv")
    every = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tid"), F.col("embedding").alias("v"))
    return D.nearest_neighbours(q, every, same=True)


def confusion_pairs(spark, sf):
    q = fx.queries(spark, sf).select("qid", "qv")
    every = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tid"), F.col("embedding").alias("v"))
    return Y.confusion_graph(q, every, MIN_SIM)


def geometry_probe(spark, sf):
    return D.geometry_probe(fx.queries(spark, sf), fx.index(spark, sf), same=True)


def matrix_gaps(spark, sf):
    return D.matrix_gaps(fx.index(spark, sf), table(spark, sf, "documents").select(F.col("doc_id").alias("tid"))).groupBy("side").agg(F.count("*").alias("n"))


def _events(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("tid"), F.round("value", 0).alias("score"), "event_type")


def rank_stable(spark, sf):
    return _events(spark, sf).select("qid", "tid", "score", K.stable_rank().alias("rank"))


def rank_worst_tie(spark, sf):
    return _events(spark, sf).select("qid", "tid", "score", K.worst_tie_rank().alias("rank"))


def zscore_per_query(spark, sf):
    return _events(spark, sf).select("qid", "tid", F.round(K.zscore(), 6).alias("z"))


def nearest_row(spark, sf):
    return K.nearest(_events(spark, sf))


def rerank_replace(spark, sf):
    w = fx.window(spark, sf)
    return w.select("qid", "tid", K.reorder_head(w, 25, "other").cast("int").alias("new_rank"))


def rerank_depths(spark, sf):
    rows = K.rerank_depths(fx.window(spark, sf), [10, 25, 50, 100], "other")
    best = rows.join(fx.gold(spark, sf), ["qid", "tid"]).groupBy("depth", "qid").agg(F.min("new_rank").alias("rank"))
    every = fx.queries(spark, sf).select("qid").withColumn("depth", F.explode(F.array(*map(F.lit, [10, 25, 50, 100]))))
    return M.recall_mrr(every.join(best, ["depth", "qid"], "left"), ["depth"])


def tokenize(spark, sf):
    return fx.text_docs(spark, sf).select("tid", X.tokens(F.col("text")).alias("t")).select("tid", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


def term_stats(spark, sf):
    return L.term_stats(fx.text_docs(spark, sf), F.col("text")).select("w", "df", "cf", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, sf):
    return K.top_k(fx.text_scores(spark, sf), 10)


def bm25_subpool(spark, sf):
    pool = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("tid"))
    return K.top_k(fx.text_scores(spark, sf, pool=pool), 10)


def bm25_nonzero_frac(spark, sf):
    return L.nonzero_share(fx.text_scores(spark, sf), fx.text_queries(spark, sf).count(), fx.text_docs(spark, sf).count())


def fuse_zscore(spark, sf):
    return U.fuse(fx.window(spark, sf), 0.2, "zscore", 100).select("qid", "tid", F.round("fused", 6).alias("fused"))


def fuse_rrf(spark, sf):
    return U.fuse(fx.window(spark, sf), 0.2, "rrf", 100).select("qid", "tid", "fused", "new_rank")


def fuse_rrf_tie(spark, sf):
    return U.fuse(fx.window(spark, sf), 0.2, "rrf_tie", 100).select("qid", "tid", "fused", "new_rank")


def fuse_window(spark, sf):
    return U.fuse(fx.window(spark, sf), 0.5, "rrf_tie", 25).select("qid", "tid", "new_rank")


def fuse_full(spark, sf):
    return U.fuse_full(fx.queries(spark, sf), fx.index(spark, sf), fx.lexical_signal(spark, sf), 0.2, 25, same=True)


def fusion_sweep(spark, sf):
    ranks = U.sweep(fx.window(spark, sf), fx.gold(spark, sf), rules=("rrf", "rrf_tie"), depths=(10, 25, 50, 100))
    return M.recall_mrr(ranks, ["rule", "depth", "alpha"], ks=(1, 10, 25))


def union_ceiling(spark, sf):
    """The best of the whole index beside the lexically best of all documents."""
    lexical = fx.lexical_signal(spark, sf).where("other > 0 AND qid <> tid").select("qid", "tid", F.col("other").alias("score"))
    return U.union_ceiling(_ranked(spark, sf), K.top_k(lexical, RANKED), fx.gold(spark, sf))


def _pool_order(rows, golds, seed):
    """``tid, nth``: golds are in every pool (-1), the rest follows in hash order; and the sizes of the curve, up to all of it."""
    marked = golds.select("tid").distinct()
    rest = materialise(with_global_index(rows.select("tid").join(marked, "tid", "left_anti"), K.hash_order(seed, "tid"), "nth"), "pool-order")
    return rest.unionByName(marked.select("tid", F.lit(-1).cast("long").alias("nth"))), [*POOLS, max(rest.count(), 1)]


def pool_curve(spark, sf):
    """Recall as the pool grows to the whole index: golds first, then the rest in hash order."""
    order, sizes = _pool_order(fx.index(spark, sf), fx.gold(spark, sf), "pool")
    ranks = D.dense_pool_ranks(fx.queries(spark, sf), fx.index(spark, sf).join(order, "tid"), fx.gold(spark, sf), sizes, same=True)
    return M.recall_mrr(ranks, ["pool"])


def _intents(spark, sf):
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("intent_id"), F.col("text").alias("query"), "conv_id")


def dedup_queries(spark, sf):
    return G.dedup_queries(_intents(spark, sf), pos="intent_id").where(X.long_enough(F.col("query"))).select("intent_id", F.md5("key").alias("key"))


def tool_holdout(spark, sf):
    return G.hold_out(table(spark, sf, "documents"), "source", 0.2, "holdout")


def _golds(spark, sf):
    """One or two sources for each conversation's intents."""
    d = table(spark, sf, "documents").select(F.col("doc_id"), F.col("source").alias("tool_id"))
    i = _intents(spark, sf)
    picks = i.select("intent_id", F.explode(F.when(F.col("conv_id") % 7 == 0, F.array("conv_id", F.col("conv_id") + 1)).otherwise(F.array("conv_id"))).alias("doc_id"))
    return picks.join(d, "doc_id").select("intent_id", "tool_id").distinct()


def route_splits(spark, sf):
    held = tool_holdout(spark, sf).withColumnRenamed("source", "tool_id")
    return G.route(_intents(spark, sf).select("intent_id"), _golds(spark, sf), held, "route")


def group_cap_sample(spark, sf):
    return K.cap_per_group(table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", 5, "cap", "l_orderkey", "l_linenumber")


def stratified_sample(spark, sf):
    return K.stratified_cap(table(spark, sf, "documents").select("source", "doc_id"), "source", 5, 60, "strata", "doc_id")


def fixed_batches(spark, sf):
    b = K.in_batches(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 8)
    return b.groupBy("o_custkey", "batch").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("intent_id"), F.col("embedding").alias("v"))


def near_dup_cross(spark, sf):
    sides = table(spark, sf, "embeddings").select(F.col("vec_id").alias("intent_id"), F.when(F.col("vec_id") % 3 == 0, "dev").otherwise("test").alias("side"))
    return G.drop_near_dups(sides, _vectors(spark, sf), MIN_SIM)


def _neighbours(spark, sf):
    """Each row and its nearest other row, whichever rows are labeled."""
    every = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tid"), F.col("embedding").alias("v"))
    return Y.confusion_graph(every.toDF("qid", "qv"), every, MIN_SIM)


def _pairs(spark, sf):
    return _neighbours(spark, sf).select("a", "b")


def confusable_components(spark, sf):
    return G.confusable_components(_pairs(spark, sf))


def _vector_intents(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("intent_id"), F.when(F.col("vec_id") % 11 != 0, F.col("vec_id") - F.col("vec_id") % 10).alias("tool"))


def component_partition(spark, sf):
    return G.partition_components(_vector_intents(spark, sf), confusable_components(spark, sf), 0.33, "components")


def partition_audit(spark, sf):
    part = materialise(component_partition(spark, sf), "partition")
    golds = _vector_intents(spark, sf).where("tool IS NOT NULL").select("intent_id", F.col("tool").alias("tool_id"))
    return G.partition_stats(part).crossJoin(G.audit(part, golds).agg(F.count("*").alias("on_both_sides")))


def _ranks_by_quality(spark, sf):
    """Each query's gold rank with the quality label of the document of its id (null where there is none)."""
    ranks = gold_rank(spark, sf)
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("qid")).agg(F.max("quality").alias("quality"))
    return ranks.join(labels, "qid", "left").withColumn("bucket", F.coalesce(F.col("quality").cast("string"), F.lit("none")))


def bucket_stats(spark, sf):
    return M.bucket_stats(_ranks_by_quality(spark, sf), "bucket")


def headroom(spark, sf):
    return M.headroom(_ranks_by_quality(spark, sf), "bucket", "1")


def headroom_no_reference(spark, sf):
    return M.headroom(_ranks_by_quality(spark, sf), "bucket", "absent")


def representation_ratio(spark, sf):
    catalog = table(spark, sf, "documents")
    golds = catalog.join(table(spark, sf, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    return M.representation_ratio(golds, catalog, "lang")


def _config_metrics(spark, sf):
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 5).cast("string").alias("config"), "value")
    return e.groupBy(F.col("event_type").alias("split"), "config").agg(F.round(F.avg("value"), 4).alias("value"))


def sign_split(spark, sf):
    anchors = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").limit(1).collect()]
    return M.sign_split(_config_metrics(spark, sf), "0", anchors)


def best_config(spark, sf):
    return M.best_config(_config_metrics(spark, sf), "config", "value")


def pooled_metrics(spark, sf):
    items = gold_rank(spark, sf).join(fx.queries(spark, sf), "qid").select((F.col("label") % 3).cast("string").alias("split"), "qid", "rank")
    return M.recall_mrr(M.with_pooled(items, F.col("split") != "0"), ["split"])


def selector_tally(spark, sf):
    e = table(spark, sf, "events")
    work = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("split"), (F.col("user_id") % 4).cast("string").alias("gold"))
    a = e.where("event_id % 9 <> 0")
    answers = a.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 10 == 1, "NONE").otherwise((F.col("event_id") % 4).cast("string")).alias("choice"), (F.col("event_id") % 6 == 0).alias("tied"))
    return M.selector_tally(work, answers)


def conditional_accuracy(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_type").alias("split"), (F.col("user_id") % 2 == 0).alias("correct"), (F.col("event_id") % 3 != 0).alias("has_gold"))
    return M.conditional_accuracy(rows)


def run_disagreements(spark, sf):
    o = table(spark, sf, "orders")
    by = o.groupBy("o_custkey").agg(S.rounded(F.avg("o_totalprice"), 4).alias("v"))
    half = o.where("o_orderkey % 2 = 0").groupBy("o_custkey").agg(S.rounded(F.avg("o_totalprice"), 4).alias("v"))
    return M.disagreements(by, half, ["o_custkey"], "v")


def _paired(spark, sf):
    w, g = fx.window(spark, sf), fx.gold(spark, sf)
    base = M.best_gold_rank(w.withColumn("rank", F.col("col")), g, fx.queries(spark, sf)).withColumnRenamed("rank", "base_rank")
    new = M.best_gold_rank(U.fuse(w, 0.5, "rrf_tie", 100).withColumn("rank", F.col("new_rank")), g, fx.queries(spark, sf)).withColumnRenamed("rank", "new_rank")
    return base.join(new, "qid").join(fx.queries(spark, sf).select("qid", "label"), "qid")


def mcnemar_exact(spark, sf):
    return S.paired_outcomes(_paired(spark, sf), ["label"], k=10)


def paired_bootstrap(spark, sf):
    return S.paired_bootstrap(_paired(spark, sf), ["label"], "qid", k=10, reps=2000)


def hard_negatives(spark, sf):
    every = fx.index(spark, sf).select("tid", "v")
    return N.triplets(N.hard_negatives(_ranked(spark, sf, 50), fx.gold(spark, sf), every, max_cos=MIN_SIM))


def negative_provenance(spark, sf):
    every = fx.index(spark, sf).select("tid", "v")
    mined = N.hard_negatives(_ranked(spark, sf, 50), fx.gold(spark, sf), every, max_cos=MIN_SIM)
    return N.provenance(mined, fx.index(spark, sf).withColumn("source", F.col("label").cast("string")))


def oracle_shortlist(spark, sf):
    return P.oracle_shortlist(_ranked(spark, sf, 50), fx.gold(spark, sf), fx.queries(spark, sf), 20, "shortlist")


def _arms(spark, sf):
    w = fx.window(spark, sf)
    return P.arms(w, U.fuse(w, 0.2, "rrf_tie", 100), fx.gold(spark, sf))


def composed_arms(spark, sf):
    return _arms(spark, sf)


def rescued_lost(spark, sf):
    return P.rescued_lost(_arms(spark, sf))


def shortlist_dedup(spark, sf):
    l = table(spark, sf, "lineitem")
    return P.dedup_shortlists(l.select(F.col("l_orderkey").alias("item"), F.concat(F.lit("q"), (F.col("l_orderkey") % 3).cast("string")).alias("query"), (F.col("l_partkey") % 5).alias("tid")))


def _doc_text(variant):
    def query(spark, sf):
        t = fx.tools(spark, sf)
        text = X.tool_text(variant, *(F.col(c) for c in ("name", "summary", "description", "params", "tags", "api_title", "provider", "method", "path")))
        return t.select("pos", F.md5(text).alias("digest"), X.word_count(text).alias("words"))

    return query


def humanize_path(spark, sf):
    return fx.tools(spark, sf).select("pos", X.humanize(F.col("path")).alias("words"))


def slug_and_key(spark, sf):
    return fx.tools(spark, sf).select("pos", "tool_id", X.norm_key(F.col("name")).alias("norm"))


def side_effects(spark, sf):
    return C.histogram(fx.tools(spark, sf), X.side_effects(F.col("method")), "side_effects")


def doc_quality(spark, sf):
    t = fx.tools(spark, sf)
    return C.histogram(t, X.doc_quality(F.col("description"), F.transform("params", lambda p: F.concat(p, F.lit(" of the page")))), "doc_quality")


def first_wins(spark, sf):
    return K.first_of_key(fx.tools(spark, sf), "tool_id", "pos").select("tool_id", "pos")


def _planted(spark, sf):
    """Texts with a string of each class, with two of them, and with near misses."""
    e = table(spark, sf, "events")
    i, u = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    texts = [
        F.concat(F.lit("key AKIA"), F.lpad(i, 16, "7"), F.lit(" end")), F.concat(F.lit("jwt eyJhbGciOiJIUzI1"), i, F.lit(".abc.def")), F.concat(F.lit("pay sk_live_abcdefgh"), u),
        F.concat(F.lit("chat xoxb-12345678-"), u), F.concat(F.lit("Authorization: Bearer abcdefghijklmnop"), i), F.lit("AKIA123 sk_live_short xoxz-12345678 Bearer short"),
        F.concat(F.lit("pk_test_abcdefgh1 and ASIA"), F.lpad(i, 16, "7")),
    ]
    return e.select("event_id", "event_type", F.element_at(F.array(*texts), (F.col("event_id") % len(texts) + 1).cast("int")).alias("t"))


def redact(spark, sf):
    return _planted(spark, sf).select("event_id", R.redact(F.col("t")).alias("t"))


def redaction_counts(spark, sf):
    return R.redaction_counts(_planted(spark, sf), "t", "event_type").toDF("event_type", "class", "n")


def json_fenced_extract(spark, sf):
    """Answers in fences, without, broken, without an array, and empty."""
    props = F.col("props")
    answers = [
        F.concat(F.lit("Answer:\n```json\n["), props, F.lit("]\n```\nDone.")), F.concat(F.lit("Sure: ["), props, F.lit(", "), props, F.lit("] as asked")), F.lit("[{broken"),
        F.concat(F.lit("```\n["), props, F.lit("]\n``` and [more]")), F.lit(""), F.lit("```json\n[{\"k\": }]\n```"), F.lit("no array here"),
    ]
    text = F.element_at(F.array(*answers), (F.col("event_id") % len(answers) + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", X.fenced_json(text, "array<map<string,string>>").alias("a"))
    return e.select("event_id", F.size("a").cast("long").alias("n"))


def paged_prompts(spark, sf):
    t = fx.tools(spark, sf)
    block = Q.tool_block(F.col("tool_id"), F.col("name"), F.col("api_title"), F.col("description"), F.col("params"), F.col("summary"))
    rows = K.in_batches(t.withColumn("block", block), "api_title", "pos", 4)
    rows = rows.withColumn("b", F.concat_ws(":", "api_title", "batch"))
    return Q.batch_prompts(rows, F.lit(Q.STANDARD), "b", "pos", "block").select("b", "n", F.md5("prompt").alias("digest"))


def table_digest(spark, sf):
    return digest(table(spark, sf, "customer"), "c_custkey", "c_name")


def extract_operations(spark, sf):
    """Specs made of the pages' paths, one a source: parameters, bodies and schemas behind references, one of them in a cycle."""
    t = fx.tools(spark, sf)
    ref = lambda kind, name: F.struct(F.lit(f"#/components/{kind}/{name}").alias("$ref"))
    get = F.struct(F.col("name").alias("summary"), F.col("description").alias("description"), F.array(ref("parameters", "item")).alias("parameters"))
    post = F.struct(F.col("name").alias("summary"), ref("requestBodies", "made").alias("requestBody"))
    item = F.struct(F.lit("itemId").alias("name"), F.lit(True).alias("required"), F.lit("path").alias("in"), ref("schemas", "key").alias("schema"))
    fields = F.struct(F.struct(F.lit("string").alias("type")).alias("title"), ref("schemas", "key").alias("size"), ref("schemas", "thing").alias("parent"))
    thing = F.struct(F.lit("object").alias("type"), fields.alias("properties"), F.array(F.lit("title"), F.lit("size")).alias("required"))
    content = F.create_map(F.lit("application/json"), F.struct(ref("schemas", "thing").alias("schema")))
    parts = F.struct(F.struct(item.alias("item")).alias("parameters"), F.struct(F.struct(content.alias("content")).alias("made")).alias("requestBodies"), F.struct(F.struct(F.lit("integer").alias("type")).alias("key"), thing.alias("thing")).alias("schemas"))
    rows = F.array_sort(F.collect_list(F.struct(F.concat("path", F.lit("/"), F.col("pos").cast("string")), F.struct(get.alias("get"), post.alias("post")))))
    paths = t.groupBy("api_title").agg(F.map_from_entries(rows).alias("paths"), F.min("pos").alias("pos")).withColumn("components", parts)
    specs = paths.select(F.col("api_title").alias("api_id"), F.col("api_title").alias("provider"), F.col("api_title").alias("title"), F.array(F.lit("web")).alias("categories"), F.lit("landed").alias("url"), F.to_json(F.struct("paths", "components")).alias("body"), "pos")
    fields_of = F.array_join(F.transform("parameters.properties", lambda x: F.concat_ws(":", x["name"], x["type"], x["in"])), " ")
    return C.tools_of_specs(specs, 5)[0].select("tool_id", "side_effects", "domain", fields_of.alias("fields"), F.array_join("parameters.required", " ").alias("needed"), "http.path")


def evaluate_splits(spark, sf):
    """Labels modulo 3 as splits; golds of label 0 are not in the catalog, ids divisible by 40 are the thin group."""
    q = fx.queries(spark, sf)
    items = q.select((F.col("label") % 3).cast("string").alias("split"), "qid")
    catalog = fx.index(spark, sf).where("label <> 0")
    scores = materialise(_ranked(spark, sf), "ranked")
    return M.evaluate_splits(items, scores, fx.gold(spark, sf), catalog, thin=F.col("qid") % 40 == 0)


def _matrices(spark, sf):
    """Recall by label of two matrices: all 64 dimensions, and the first 32."""
    out = None
    for name, n in (("d64", 64), ("d32", 32)):
        q = fx.queries(spark, sf).withColumn("qv", F.slice("qv", 1, n))
        x = fx.index(spark, sf).withColumn("v", F.slice("v", 1, n))
        ranks = D.dense_rank_of(q, x, fx.gold(spark, sf), same=True).join(q.select("qid", "label"), "qid")
        rows = M.recall_mrr(ranks, ["label"], (10, 100)).withColumn("matrix_id", M.run_label(F.lit(name), F.lit(""), F.lit("v0")))
        out = rows if out is None else out.unionByName(rows)
    return out


def matrix_sweep(spark, sf):
    return M.deltas(_matrices(spark, sf), "matrix_id", "d64|v0", ["label"], ["r_at_10", "r_at_100", "mrr"])


def matrix_report(spark, sf):
    return M.report(_matrices(spark, sf), "label", "matrix_id", ["d64|v0", "d32|v0"], "mrr").toDF("label", "d64", "d32")


def random_control(spark, sf):
    return M.random_control(dense_recall_mrr(spark, sf).select("label", "n", "r_at_100"))


def alpha_plateau(spark, sf):
    return S.plateau(fusion_sweep(spark, sf).select("rule", "depth", "alpha", F.col("mrr").alias("value")), ["rule", "depth"])


def claim_table(spark, sf):
    rows = _paired(spark, sf).select("base_rank", "new_rank", F.lit("fused").alias("claim"), (F.col("label") % 3).cast("string").alias("split"))
    return S.claim_table(rows, members=F.col("split") != "0", k=10)


def mean_difference(spark, sf):
    """Events of one user move together."""
    e = table(spark, sf, "events").select("event_type", "user_id", (F.col("user_id") % 2).alias("a"), (F.col("event_id") % 2).alias("b"))
    return S.mean_difference_interval(e, ["event_type"], "a", "b", "user_id", reps=2000)


def _text_gold(spark, sf):
    """One document in 997 for each item, by their ids: a pairing that tests operators, not quality."""
    docs, asked = fx.text_docs(spark, sf).select("tid"), fx.text_queries(spark, sf).select("qid")
    return asked.join(docs, F.col("qid") * 13 % 997 == F.col("tid") % 997)


def lexical_pool_curve(spark, sf):
    """The same curve of the lexical signal; an item that shares no term with a gold of it is a miss in every pool."""
    gold = _text_gold(spark, sf)
    order, sizes = _pool_order(fx.text_docs(spark, sf), gold, "lexical")
    asked = gold.select("qid").distinct()
    return M.recall_mrr(L.pool_ranks(fx.text_scores(spark, sf), asked, gold, order, sizes), ["pool"])


def confusion_candidates(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("tid"), "label")
    return D.confusion_candidates(_neighbours(spark, sf), e, F.col("label") % 2 == 0, MIN_SIM, 10, "candidates")


def separable_filters(spark, sf):
    labels = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("conv_id")).agg((F.max("quality") == 1).alias("separable"))
    c = _intents(spark, sf).join(labels, "conv_id", "left")
    return c.agg(*[F.count_if(M.separable(F.col("separable"), x)).alias(x) for x in ("true", "false", "falsy")])


def mean_words(spark, sf):
    return M.mean_words(table(spark, sf, "documents"), X.word_count(F.col("text")), ["lang"])


def jsonl_round_trip(spark, sf):
    path = scratch_path(spark, "jsonl")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    write_jsonl(rows, path)
    return read_jsonl(spark, path, "c_custkey long, c_name string, c_nationkey long")


def _labeled(spark, sf):
    q = table(spark, sf, "documents").select(F.col("doc_id").alias("intent_id"), F.concat("source", F.when(F.col("doc_id") % 5 == 0, F.lit("?")).otherwise(F.lit(""))).alias("label"))
    return C.label_queries(q, fx.tools(spark, sf).select(F.col("api_title").alias("name"), "tool_id", "pos"))


def label_queries(spark, sf):
    """Conversations' roles as names of tools: the first page of a source is the tool of its name."""
    return _labeled(spark, sf)[0].select("intent_id", "tool_id")


def unmatched_labels(spark, sf):
    return _labeled(spark, sf)[1]


def plugin_join(spark, sf):
    d = table(spark, sf, "nation").select(F.upper("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    info = table(spark, sf, "nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit(" "), F.lower("n_name")).alias("name"), F.col("n_regionkey").alias("region"))
    return C.plugins(d, info).select("key", "region")


def catalog_pool(spark, sf):
    """Suppliers pooled behind nations."""
    first = table(spark, sf, "nation").select(F.col("n_name").alias("tool_id"), F.col("n_nationkey").alias("pos"))
    second = table(spark, sf, "supplier").select(F.col("s_name").alias("tool_id"), F.col("s_suppkey").alias("pos"))
    return C.pool(first, second).select("tool_id", F.col("pos").cast("long").alias("pos"))


def picked_specs(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).alias("api_id"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("provider"), F.when(F.col("doc_id") % 3 != 0, "1").alias("preferred"), F.lit("u").alias("swagger_url"))
    return C.picked_specs(rows, 3, 40, "specs").select("api_id", "provider")


def best_gold(spark, sf):
    return M.best_gold(_ranked(spark, sf), fx.gold(spark, sf)).select("qid", "tid", "rank")


def thin_descriptions(spark, sf):
    t = table(spark, sf, "documents")
    rows = t.agg(F.count_if(X.is_thin(F.col("text"), 100)).alias("thin"), F.count("*").alias("n"))
    return rows.select("thin", X.percent(F.col("thin"), F.col("n")).alias("share"))


def paired_arms(spark, sf):
    o = table(spark, sf, "orders")
    rows = o.select((F.col("o_custkey") % 4).alias("split"), (F.floor(F.col("o_orderkey") / 2)).cast("long").alias("item"), F.when(F.col("o_orderkey") % 2 == 0, "dense").otherwise("fused").alias("arm"), F.when(F.col("o_orderkey") % 5 != 0, "x").alias("choice"), (F.col("o_orderkey") % 3 == 0).alias("correct"))
    return P.paired_items(rows).groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("dense") & ~F.col("fused")).alias("b"))


def shared_answers(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("item"), F.concat(F.lit("q"), (F.col("l_orderkey") % 3).cast("string")).alias("query"), (F.col("l_partkey") % 5).alias("tid"))
    answers = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("item"), F.col("o_orderstatus").alias("choice"))
    out = P.with_answers(l.select("item").distinct(), P.dedup_shortlists(l), answers)
    return out.select("item", "owner", "choice", "missing")


def valid_generated(spark, sf):
    c = table(spark, sf, "conversations")
    answers = c.select((F.col("conv_id") % 7).alias("batch"), (F.col("turn") % 5).alias("tool_id"), F.when(F.col("turn") % 4 != 0, F.col("text")).alias("query"), F.when(F.col("turn") % 3 == 0, F.col("turn") % 2 == 0).alias("skip"))
    work = spark.range(7).select(F.col("id").alias("batch"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") % 4)).alias("tool_id"))
    return Q.valid_generated(answers, work).groupBy("batch").agg(F.count("*").alias("n"))


def fusion_sweep_zscore(spark, sf):
    ranks = U.sweep(fx.window(spark, sf), fx.gold(spark, sf), rules=("zscore",), depths=(10, 25, 50, 100))
    return M.recall_mrr(ranks, ["rule", "depth", "alpha"], ks=(1, 10, 25))


def composed_zscore(spark, sf):
    w = fx.window(spark, sf)
    return P.rescued_lost(P.arms(w, U.fuse(w, 0.2, "zscore", 100), fx.gold(spark, sf)))


def score_cache(spark, sf):
    """The first tenths of the queries are cached, then all are asked for; the second fill computes the rest alone."""
    queries, index = fx.queries(spark, sf), fx.index(spark, sf)
    matrix = digest(index.select("tid", "v")).first()[0]
    cache = ScoreCache(spark, scratch_path(spark, "scores"), "qid long, tid long, score double, rank int", matrix=matrix, catalog=matrix, seed=0, n=10)
    compute = lambda q: D.dense_topk(q, index, 10, same=True)
    for asked in (queries.where("qid % 200 = 0"), queries):
        cache.fill(asked.select("qid", "qv"), compute)
    return cache.rows()


def training_batches(spark, sf):
    """Orders as pairs, customers as positives."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return B.batches_without_repeats(o, "o_custkey", "o_orderkey", 64, "batches")


def training_batch_audit(spark, sf):
    return B.batch_audit(training_batches(spark, sf), "o_custkey")


def training_pairs(spark, sf):
    """Documents as queries and their sources as tools, five a tool at most."""
    d = table(spark, sf, "documents")
    intents = d.select(F.col("doc_id").alias("intent_id"), F.substring("text", 1, 40).alias("query"))
    golds = d.select(F.col("doc_id").alias("intent_id"), F.col("source").alias("tool_id"), F.lit(1).alias("gold_idx")).unionByName(d.select(F.col("doc_id").alias("intent_id"), F.col("lang").alias("tool_id"), F.lit(0).alias("gold_idx")))
    catalog = d.where("source <> 'src1'").groupBy(F.col("source").alias("tool_id")).agg(F.min("doc_id").alias("first"))
    return B.training_pairs(intents, golds, catalog, F.concat("tool_id", F.lit(":"), F.col("first").cast("string")), cap=5)


def split_registry(spark, sf):
    """Conversations written as split files, one of them absent, cut by a manifest; items by split with the golds in the catalog."""
    folder = scratch_path(spark, "splits")
    c = table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("n"), "conv_id", F.col("text").alias("query"))
    rows = c.select(F.concat(F.lit("i"), F.col("n").cast("string")).alias("intent_id"), "query", F.array((F.col("conv_id") % 7).cast("string"), (F.col("n") % 11).cast("string")).alias("gold_tool_ids"), (F.col("conv_id") % 3 == 0).alias("separable"), "conv_id")
    files = {"test_A": rows.where("conv_id % 5 = 0"), "standard_L2": rows.where("conv_id % 5 = 1"), "standard_L4": rows.where("conv_id % 5 = 2"), "confusion_L2": rows.where("conv_id % 5 = 3"), "abstain_L2": rows.where("conv_id % 5 = 4").withColumn("gold_tool_ids", F.array().cast("array<string>"))}
    for name, df in files.items():
        write_jsonl(df.drop("conv_id"), f"{folder}/{name}.jsonl")
    manifest = rows.select("intent_id", F.when(F.floor(F.col("conv_id") / 5) % 2 == 0, "test").otherwise("dev").alias("side"))
    found = load_splits(spark, folder, "test", manifest)
    catalog = spark.range(6).select(F.col("id").cast("string").alias("tool_id"))
    per = found.with_gold(catalog).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.size("golds")).cast("long").alias("golds"))
    return per.unionByName(spark.createDataFrame([(name, None, None) for name in found.absent], "split string, n long, golds long"))


def _generation(spark, sf):
    """Batches of four tools, and recorded answers: a fence around the array, every fifth tool skipped, some batches not recorded."""
    t = fx.tools(spark, sf)
    block = Q.tool_block(F.col("tool_id"), F.col("name"), F.col("api_title"), F.col("description"), F.col("params"), F.col("summary"))
    units = K.in_batches(t.withColumn("block", block), "api_title", "pos", 4).withColumn("batch", F.concat_ws(":", "api_title", "batch"))
    units = materialise(units.select("batch", "pos", "block", "tool_id", "name"), "units")
    one = F.struct("tool_id", F.concat(F.lit(" do "), "name", F.lit(" ")).alias("query"), (F.col("pos") % 5 == 0).alias("skip"))
    said = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.array_sort(F.collect_list(one))), F.lit("\n```"))
    recorded = units.groupBy("batch").agg(said.alias("answer"), F.min("pos").alias("first")).where("first % 3 <> 0").select("batch", "answer", F.lit(0.25).alias("cost"))
    return units, materialise(recorded, "recorded")


def generation_ledger(spark, sf):
    """Two runs against one ledger: the first ends with its budget, the second sends the rest and tries failed calls once more."""
    units, recorded = _generation(spark, sf)
    prompts = E.standard_prompts(units, "short")
    ledger = E.Ledger(spark, scratch_path(spark, "ledger"))
    for budget in (2.0, 10.0**6):
        ledger.run(prompts, E.replayed(recorded), budget, 0.25)
    return ledger.stats()


def generated_intents(spark, sf):
    units, recorded = _generation(spark, sf)
    ledger = E.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.run(E.standard_prompts(units, "short"), E.replayed(recorded), 10.0**6, 0.25)
    out = E.generated_intents(ledger.answers(), units, "standard", "L2")
    return out.select(F.col("gold_tool_ids")[0].alias("tool_id"), "query", "task_variant", "difficulty").groupBy("tool_id", "query", "task_variant", "difficulty").agg(F.count("*").alias("n"))


def selected_answers(spark, sf):
    """Shortlists asked in batches of five requests, and a selector that takes its last candidate, or none."""
    short = oracle_shortlist(spark, sf)
    items = short.select((F.col("qid") / 100).cast("int").cast("string").alias("batch"), F.col("qid").alias("id"), F.concat(F.lit("request "), F.col("qid").cast("string")).alias("query"), "slot", F.concat(F.lit("tool "), F.col("tid").cast("string")).alias("block"), "tid", "is_gold")
    items = materialise(items, "shortlists")
    picks = items.groupBy("batch", "id").agg(F.max_by("tid", "slot").cast("string").alias("choice"))
    picks = picks.withColumn("choice", F.when(F.col("id") % 3 == 0, " none ").otherwise(F.col("choice")))
    one = F.struct(F.col("id").cast("string").alias("id"), "choice", (F.col("id") % 40 == 0).alias("tied"))
    recorded = picks.where("id % 60 <> 20").groupBy("batch").agg(F.to_json(F.collect_list(one)).alias("answer"), F.lit(0.5).alias("cost"))
    ledger = E.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.run(E.selector_prompts(items), E.replayed(recorded), 10.0**6, 0.5)
    answers = E.selected(ledger.answers(), items).select(F.col("id").cast("long").alias("id"), "choice", "tied")
    work = items.groupBy("id").agg(F.max_by(F.col("tid"), F.when(F.col("is_gold"), F.col("slot"))).cast("string").alias("gold")).withColumn("split", (F.col("id") % 200 == 0).cast("string"))
    return M.selector_tally(work, answers)


def _confident(spark, sf):
    """Every row with a near enough neighbour: is the neighbour's label its own, and how near is it?"""
    label = lambda name: table(spark, sf, "embeddings").select(F.col("vec_id").alias(name), F.col("label").alias(f"l_{name}"))
    rows = _neighbours(spark, sf).join(label("a"), "a").join(label("b"), "b")
    return rows.select(F.col("a").alias("tid"), F.col("sim").alias("confidence"), (F.col("l_a") == F.col("l_b")).alias("correct"))


def risk_coverage(spark, sf):
    return V.risk_coverage(_confident(spark, sf), "tid")


def calibration_bins(spark, sf):
    return V.calibration_bins(_confident(spark, sf), "tid")


def selective_report(spark, sf):
    return V.selective_report(_confident(spark, sf), "tid")


def _snapshots(spark, sf):
    """Two snapshots of the vectors: rows that only one of them has, and rows whose vector is another in the second."""
    x = fx.index(spark, sf).select("tid", "v")
    return x.where("tid % 31 <> 4"), x.where("tid % 97 <> 5").withColumn("v", F.when(F.col("tid") % 89 == 3, F.reverse("v")).otherwise(F.col("v")))


def catalog_drift(spark, sf):
    return T.catalog_diff(*_snapshots(spark, sf), "tid", ["v"])


def drift_refresh(spark, sf):
    old, new = _snapshots(spark, sf)
    queries = fx.queries(spark, sf).select("qid", "qv")
    return T.refresh_topk(D.dense_topk(queries, old, 10, same=True), queries, old, new, 10, same=True)


def _calls(spark, sf):
    """Events as calls: the expected arguments, and what was said: the same, one missing, a wrong type, one too many, no JSON, nested."""
    k = F.regexp_extract("props", "([0-9]+)", 1)
    user = F.col("user_id").cast("string")
    whole = lambda k, user: F.concat(F.lit('"k": '), k, F.lit(', "user": '), user, F.lit(', "type": "'), F.col("event_type"), F.lit('"'))
    same = whole(k, user)
    said = [same, F.concat(F.lit('"user": '), user, F.lit(', "k":'), k), whole(F.concat(F.lit('"'), k, F.lit('"')), user), F.concat(same, F.lit(', "extra": [1, null]')), F.concat(same, F.lit(', "x"')), whole(F.concat(k, F.lit(".5")), F.concat(F.lit('{"id": '), user, F.lit("}")))]
    pick = F.element_at(F.array(*said), (F.col("event_id") % len(said) + 1).cast("int"))
    braces = lambda c: F.concat(F.lit("{"), c, F.lit("}"))
    calls = table(spark, sf, "events").select("event_id", "event_type", braces(pick).alias("said"), braces(same).alias("gold"))
    schema = {"k": "integer", "user": "integer", "type": "string", "note": "string"}
    properties = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in schema.items()])
    return A.checked_calls(calls, "said", "gold", properties, F.array(F.lit("k"), F.lit("type")))


def argument_errors(spark, sf):
    return _calls(spark, sf).select("event_id", F.array_join("errors", " ").alias("errors"), F.round("f1", 6).alias("f1"))


def argument_scores(spark, sf):
    return A.argument_scores(_calls(spark, sf), "event_type")
