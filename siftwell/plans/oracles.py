"""SQL that gives the same rows as the queries, for a single-node engine on the same tables."""

from __future__ import annotations

import math

from siftwell.functions.redact import RULES
from siftwell.operators.prompts import STANDARD

_Q = "q AS (SELECT vec_id AS qid, label, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0)"
_X = "x AS (SELECT vec_id AS tid, label, embedding::DOUBLE[] AS v FROM embeddings)"
_S = f"{_Q}, {_X}, s AS (SELECT qid, tid, round(list_dot_product(qv, v), 6) AS score, q.label FROM q JOIN x ON tid <> qid)"
_R = f"{_S}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rank FROM s)"
_G = "g AS (SELECT qid, tid, row_number() OVER (PARTITION BY qid ORDER BY tid) AS gold_idx FROM q JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tid) AS nth FROM x) y USING (label) WHERE nth <= 4 AND tid <> qid QUALIFY gold_idx <= 3)"
_BEST = "b AS (SELECT qid, min(rank) AS rank FROM r JOIN g USING (qid, tid) GROUP BY qid)"
_E = "e AS (SELECT user_id AS qid, event_id AS tid, round(value, 0) AS score, event_type FROM events)"
_NN = "n AS (SELECT a.vec_id AS qid, b.vec_id AS tid, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0), nn AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) = 1)"
_NN_ALL = _NN.replace(" WHERE a.vec_id % 20 = 0", "")
_TOK = "list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda a: a <> '')"
_BM = f"""tf AS (SELECT tid, w, count(*) AS f FROM (SELECT doc_id AS tid, unnest({_TOK}) AS w FROM documents) GROUP BY ALL),
 len AS (SELECT tid, sum(f) AS len FROM tf GROUP BY tid),
 m AS (SELECT (SELECT count(*) FROM documents)::DOUBLE AS n, (SELECT sum(f) FROM tf)::DOUBLE / (SELECT count(*) FROM documents) AS mean),
 terms AS (SELECT w, count(*) AS df, sum(f)::BIGINT AS cf, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, m GROUP BY w),
 post AS (SELECT w, tid, idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len / mean)) AS weight FROM tf JOIN len USING (tid) JOIN terms USING (w), m),
 ask AS (SELECT qid, w, count(*) AS times FROM (SELECT item_id AS qid, unnest({_TOK}) AS w FROM benchmark) GROUP BY ALL),
 bm AS (SELECT qid, tid, round(sum(weight * times), 6) AS score FROM post JOIN ask USING (w) GROUP BY ALL)"""
#: Benchmark items dealt to the queries of the vectors.
_DEALT = _BM.replace("item_id AS qid", "20 * (item_id % (SELECT greatest(count(*), 1) FROM q)) AS qid")
_W = f"""{_R}, {_G}, {_DEALT}, w AS (SELECT r.qid, r.tid, r.rank AS col, r.score AS dense, coalesce(bm.score, 0) AS other
 FROM r LEFT JOIN bm ON bm.qid = r.qid AND bm.tid = r.tid WHERE r.rank <= 100)"""
_W_ALL = _W.replace(" WHERE r.rank <= 100", "")


def _fused(rule: str, source: str = "w", by: str = "qid") -> str:
    """Terms a and b of a rule over rows of ``source``."""
    tie = lambda c: f"count(*) OVER (PARTITION BY {by} ORDER BY {c} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    if rule == "zscore":
        a, b = (f"(({c}) - avg({c}) OVER (PARTITION BY {by})) / (stddev_pop({c}) OVER (PARTITION BY {by}) + 1e-9)" for c in ("dense", "other"))
    elif rule == "rrf":
        a, b = (f"1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY {by} ORDER BY {c} DESC, col))" for c in ("dense", "other"))
    else:
        a, b = (f"1.0::DOUBLE / (60 + {tie(c)})" for c in ("dense", "other"))
    return f"SELECT *, {a} AS a, {b} AS b FROM {source}"


def _window(rule: str, alpha: float, depth: int, source: str = "w") -> str:
    """CTE f: head fused, tail as it stands."""
    return f"""h AS ({_fused(rule, f'(SELECT * FROM {source} WHERE col <= {depth})')}),
 h2 AS (SELECT qid, tid, col, round((1 - {alpha}::DOUBLE) * a + {alpha}::DOUBLE * b, 9) AS fused FROM h),
 f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, col) AS new_rank FROM h2 UNION ALL SELECT qid, tid, col, NULL, col FROM {source} WHERE col > {depth})"""


def _recall(ks=(1, 5, 10, 25, 50, 100), r: str = "rank") -> str:
    return ", ".join(["count(*) AS n", *(f"round(avg(CASE WHEN {r} <= {k} THEN 1.0 ELSE 0.0 END), 4) AS r_at_{k}" for k in ks), f"round(avg(CASE WHEN {r} <= 100 THEN 1.0::DOUBLE / {r} ELSE 0 END), 4) AS mrr"])


def _md5(seed: str, *cols: str) -> str:
    return "md5('" + seed + "' || " + " || ".join(f"':' || {c}::VARCHAR" for c in cols) + "), " + ", ".join(cols)


def _replicates(rows: str, by: str, unit: str, reps: int, sums: str) -> str:
    """Table ``rs`` of weighted sums by replicate: Poisson weights from 16 bits of an MD5 of unit and block."""
    steps = [int(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k))) for k in range(1, 9)]
    weight = " + ".join(f"(bits >= {t})::INT" for t in steps)
    return f"""hashed AS (SELECT {rows}.*, b, md5('7:' || {unit}::VARCHAR || ':' || b::VARCHAR) AS h FROM {rows}, range({reps // 8}) z(b)),
 dealt AS (SELECT hashed.*, b * 8 + j AS rep, ('0x' || substr(h, (1 + 4 * j)::INT, 4))::INT AS bits FROM hashed, range(8) y(j)),
 weighed AS (SELECT *, {weight} AS w FROM dealt), rs AS (SELECT {by}, rep, {sums} FROM weighed GROUP BY {by}, rep)"""


def _interval(value: str, name: str) -> str:
    return ", ".join(f"round(quantile_cont({value}, {q}), 6) AS {name}_{end}" for q, end in ((0.025, "low"), (0.975, "high")))


def _sweep(*rules: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rule}' AS rule, {d} AS depth, alpha, qid, min(CASE WHEN gold THEN r END) AS rank FROM ("
        f"SELECT alpha, qid, row_number() OVER (PARTITION BY alpha, qid ORDER BY round((1 - alpha) * a + alpha * b, 9) DESC, col) AS r, gold FROM ({_fused(rule, f'(SELECT * FROM wg WHERE col <= {d})')}), al"
        f" UNION ALL SELECT alpha, qid, col, gold FROM wg, al WHERE col > {d}) GROUP BY alpha, qid"
        for rule in rules
        for d in (10, 25, 50, 100)
    )


_SWEEP = _sweep("rrf", "rrf_tie")

_INTENTS = "i AS (SELECT conv_id * 1000 + turn AS intent_id, text AS query, conv_id FROM conversations WHERE role = 'user')"
_HELD = f"held AS (SELECT source AS tool_id, row_number() OVER (ORDER BY {_md5('holdout', 'source')}) <= floor(0.2::DOUBLE * (SELECT count(DISTINCT source) FROM documents)) AS is_heldout FROM (SELECT DISTINCT source FROM documents))"
_GOLDS = "golds AS (SELECT DISTINCT intent_id, source AS tool_id FROM (SELECT intent_id, conv_id AS doc_id FROM i UNION ALL SELECT intent_id, conv_id + 1 FROM i WHERE conv_id % 7 = 0) JOIN documents USING (doc_id))"
_COMP = """p AS (SELECT qid AS a, tid AS b FROM nn WHERE score >= 0.4), ed AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
 cc AS (SELECT a AS node, a AS reach FROM ed UNION SELECT cc.node, ed.b FROM cc JOIN ed ON ed.a = cc.reach),
 comp AS (SELECT node, min(reach) AS component FROM cc GROUP BY node)"""
_PART = f"""vi AS (SELECT vec_id AS intent_id, CASE WHEN vec_id % 11 <> 0 THEN vec_id - vec_id % 10 END AS tool FROM embeddings),
 an AS (SELECT intent_id, coalesce(component, tool) AS component FROM vi LEFT JOIN comp ON node = tool WHERE tool IS NOT NULL),
 sz AS (SELECT component, count(*) AS n FROM an GROUP BY component),
 sd AS (SELECT component, coalesce(sum(n) OVER (ORDER BY {_md5('components', 'component')} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 0.33::DOUBLE * (SELECT sum(n) FROM sz) AS dev FROM sz),
 fr AS (SELECT intent_id, row_number() OVER (ORDER BY {_md5('components', 'intent_id')}) - 1 < floor(0.33::DOUBLE * (SELECT count(*) FROM vi WHERE tool IS NULL)) AS dev FROM vi WHERE tool IS NULL),
 part AS (SELECT intent_id, CASE WHEN dev THEN 'dev' ELSE 'test' END AS side FROM an JOIN sd USING (component) UNION ALL SELECT intent_id, CASE WHEN dev THEN 'dev' ELSE 'test' END FROM fr)"""
_BUCKET = f"{_R}, {_G}, {_BEST}, k AS (SELECT b.*, coalesce(l.quality::VARCHAR, 'none') AS bucket FROM b LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = b.qid)"
_HIT = lambda k, r="rank": f"CASE WHEN {r} <= {k} THEN 1.0 ELSE 0.0 END"


def _headroom(ref: str) -> str:
    gains = ", ".join(f"round(CASE WHEN max(ref{k}) IS NOT NULL THEN sum(n * greatest(0, ref{k} - r{k})) / sum(n) END, 4) AS headroom_{k}" for k in (1, 10, 25))
    return f"""WITH {_BUCKET}, t AS (SELECT bucket, count(*) AS n, {', '.join(f'avg({_HIT(k)}) AS r{k}' for k in (1, 10, 25))} FROM k GROUP BY bucket),
 ref AS (SELECT {', '.join(f'max(r{k}) AS ref{k}' for k in (1, 10, 25))} FROM t WHERE bucket = '{ref}') SELECT {gains} FROM t, ref"""


_CFG = "c AS (SELECT event_type AS split, (user_id % 5)::VARCHAR AS config, round(avg(value), 4) AS value FROM events GROUP BY ALL)"
_NEG = f"""{_R}, {_G}, ca AS (SELECT r.qid, r.tid, r.rank FROM r ANTI JOIN g ON g.qid = r.qid AND g.tid = r.tid WHERE r.rank <= 50),
 al AS (SELECT ca.*, (SELECT round(max(list_dot_product(x.v, y.v)), 6) FROM g JOIN x y ON y.tid = g.tid WHERE g.qid = ca.qid) AS cos FROM ca JOIN x USING (tid)),
 kn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM al WHERE NOT coalesce(cos > 0.4, false)),
 ng AS (SELECT qid, list(tid ORDER BY k) AS a FROM kn WHERE k <= 4 GROUP BY qid)"""
_TOOLS = r"""u AS (SELECT page_id AS pos, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS p0, regexp_extract(url, '^https?://([^/?#]+)', 1) AS provider,
   regexp_extract_all(regexp_extract(url, '\?([^#]*)', 1), '([A-Za-z_]+)=', 1) AS params FROM pages),
 t AS (SELECT pos, array_to_string(string_split(text, ' ')[1:2], ' ') AS name, text[1:300] AS summary, text[1:1200] AS description, params, [lang, source] AS tags, source AS api_title, provider,
   ['get', 'post', 'put', 'patch', 'delete'][pos % 5 + 1] AS method, p0 || '/{itemId}/userName' AS path,
   regexp_replace(lower(trim(regexp_replace(array_to_string(list_filter([source, p0], lambda a: a <> ''), '_'), '[^A-Za-z0-9]+', '_', 'g'), '_')), '_+', '_', 'g')[1:120] AS tool_id
   FROM u JOIN documents d ON d.doc_id = u.pos)"""
_HUMAN = r"array_to_string(regexp_extract_all(regexp_replace(regexp_replace(path, '\{[^}]*\}', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '[A-Za-z0-9]+'), ' ')"


def _doc_text(variant: str) -> str:
    parts = ["name", "summary", "description", "array_to_string(params[1:15], ' ')"]
    if variant >= "v1":
        parts.append("array_to_string(tags, ' ')")
    if variant >= "v2":
        parts += ["api_title", "provider"]
    if variant >= "v3":
        parts += ["upper(method)", _HUMAN]
    text = f"trim(array_to_string(list_filter([{', '.join(parts)}], lambda a: a <> ''), ' '))"
    return f"WITH {_TOOLS}, x AS (SELECT pos, {text} AS x FROM t) SELECT pos, md5(x) AS digest, len(list_filter(regexp_split_to_array(x, '\\s+'), lambda a: a <> ''))::BIGINT AS words FROM x"


def _matrix(n: int) -> str:
    """Recall by label of the first ``n`` dimensions."""
    ranks = f"SELECT qid, tid, row_number() OVER (PARTITION BY qid ORDER BY round(list_dot_product(qv[1:{n}], v[1:{n}]), 6) DESC, tid) AS rank FROM q JOIN x ON tid <> qid"
    return f"SELECT label, {_recall((10, 100))} FROM (SELECT qid, min(rank) AS rank FROM ({ranks}) JOIN g USING (qid, tid) GROUP BY qid) JOIN q USING (qid) GROUP BY label"


def _slug(*parts: str) -> str:
    joined = f"array_to_string(list_filter([{', '.join(parts)}], lambda a: a <> ''), '_')"
    return f"regexp_replace(lower(trim(regexp_replace({joined}, '[^A-Za-z0-9]+', '_', 'g'), '_')), '_+', '_', 'g')[1:120]"


_PLANTED = """SELECT event_id, event_type, CASE event_id % 7 WHEN 0 THEN 'key AKIA' || lpad(event_id::VARCHAR, 16, '7') || ' end' WHEN 1 THEN 'jwt eyJhbGciOiJIUzI1' || event_id || '.abc.def' WHEN 2 THEN 'pay sk_live_abcdefgh' || user_id
 WHEN 3 THEN 'chat xoxb-12345678-' || user_id WHEN 4 THEN 'Authorization: Bearer abcdefghijklmnop' || event_id WHEN 5 THEN 'AKIA123 sk_live_short xoxz-12345678 Bearer short' ELSE 'pk_test_abcdefgh1 and ASIA' || lpad(event_id::VARCHAR, 16, '7') END AS t FROM events"""


def _redacted(text: str) -> str:
    for _, pattern, replacement in RULES:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


#: Orders dealt to batches in which no customer comes twice.
_BATCHES = f"""nb AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY {_md5('batches', 'o_custkey')}, o_orderkey) - 1 AS i, count(*) OVER () AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
 bt AS (SELECT o_orderkey, o_custkey, i % greatest(1, ceil(n / 64.0)::BIGINT, max(m) OVER ()) AS batch FROM nb)"""
#: Batches of four tools, as the prompts have them.
_UNITS = "l AS (SELECT *, api_title || ':' || ((row_number() OVER (PARTITION BY api_title ORDER BY pos) - 1) // 4) AS b FROM t)"
_ORACLE_SHORTLIST = f"""WITH {_R}, {_G}, ng AS (SELECT qid, count(*) AS n FROM g GROUP BY qid), o AS (SELECT r.qid, r.tid, row_number() OVER (PARTITION BY r.qid ORDER BY r.rank) AS k FROM r ANTI JOIN g ON g.qid = r.qid AND g.tid = r.tid WHERE r.rank <= 50),
 b AS (SELECT o.qid, tid, false AS is_gold FROM o LEFT JOIN ng USING (qid) WHERE k <= 20 - coalesce(n, 0) UNION ALL SELECT qid, tid, true FROM g)
 SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY {_md5('shortlist', 'qid', 'tid')}) AS slot, tid, is_gold FROM b"""

_PLACED = f"""{_NN_ALL}, p AS (SELECT qid AS a, tid AS b, round(score, 4) AS sim FROM nn WHERE score >= 0.4),
 it AS (SELECT a AS tid, sim AS confidence, coalesce(x.label = y.label, false) AS correct FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b),
 pl AS (SELECT *, row_number() OVER (ORDER BY confidence DESC, tid) AS place, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (ORDER BY confidence DESC, tid ROWS UNBOUNDED PRECEDING)::BIGINT AS errors, count(*) OVER () AS n FROM it),
 bins AS (SELECT floor((place - 1) * 10 / n)::INTEGER AS bin, count(*) AS n, avg(confidence) AS c, avg(correct::INTEGER) AS a FROM pl GROUP BY 1)"""
_SNAP = f"""{_Q}, {_X}, o AS (SELECT tid, v FROM x WHERE tid % 31 <> 4), nw AS (SELECT tid, CASE WHEN tid % 89 = 3 THEN list_reverse(v) ELSE v END AS v FROM x WHERE tid % 97 <> 5),
 st AS (SELECT coalesce(o.tid, nw.tid) AS tid, CASE WHEN o.tid IS NULL THEN 'added' WHEN nw.tid IS NULL THEN 'removed' WHEN o.v = nw.v THEN 'same' ELSE 'changed' END AS status FROM o FULL JOIN nw ON o.tid = nw.tid)"""
_BEST_IN = lambda t: f"SELECT qid, tid, round(list_dot_product(qv, v), 6) AS score FROM q JOIN {t} ON tid <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) <= 10"
_CALLS = """e AS (SELECT event_id, event_type, regexp_extract(props, '([0-9]+)', 1) AS k, user_id::VARCHAR AS u FROM events),
 c AS (SELECT *, '"k": ' || k || ', "user": ' || u || ', "type": "' || event_type || '"' AS g FROM e),
 t AS (SELECT event_id, event_type, ('{' || g || '}')::JSON AS gold, '{' || CASE event_id % 6 WHEN 0 THEN g WHEN 1 THEN '"user": ' || u || ', "k":' || k WHEN 2 THEN '"k": "' || k || '", "user": ' || u || ', "type": "' || event_type || '"'
  WHEN 3 THEN g || ', "extra": [1, null]' WHEN 4 THEN g || ', "x"' ELSE '"k": ' || k || '.5, "user": {"id": ' || u || '}, "type": "' || event_type || '"' END || '}' AS text FROM c),
 j AS (SELECT *, CASE WHEN json_valid(text) THEN text::JSON END AS said FROM t),
 f AS (SELECT *, coalesce(json_keys(said), []) AS names, unnest(['k', 'user', 'type']) AS name FROM j),
 m AS (SELECT event_id, any_value(event_type) AS event_type, any_value(said) IS NULL AS bad, any_value(names) AS names, len(any_value(names)) AS n_said, 3 AS n_gold,
  count(*) FILTER (WHERE json_extract(said, '$.' || name)::VARCHAR = json_extract(gold, '$.' || name)::VARCHAR) AS hits,
  list('type:' || name) FILTER (WHERE list_contains(names, name) AND json_type(said, '$.' || name) NOT IN ('UBIGINT', 'BIGINT') AND name <> 'type' OR name = 'type' AND json_type(said, '$.type') <> 'VARCHAR') AS wrong FROM f GROUP BY event_id),
 r AS (SELECT *, CASE WHEN bad THEN 'not an object' ELSE array_to_string(list_sort(list_concat(coalesce(wrong, []), ['missing:' || x FOR x IN ['k', 'type'] IF NOT list_contains(names, x)],
  ['unknown:' || x FOR x IN names IF NOT list_contains(['k', 'user', 'type', 'note'], x)])), ' ') END AS errors, 2.0::DOUBLE * hits / (n_said + n_gold) AS f1 FROM m)"""

ORACLES = {
    "dense_topk": f"WITH {_R} SELECT qid, tid, score, rank FROM r WHERE rank <= 10",
    "gold_rank": f"WITH {_R}, {_G}, {_BEST} SELECT * FROM b",
    "dense_recall_mrr": f"WITH {_R}, {_G}, {_BEST} SELECT label, {_recall()} FROM b JOIN q USING (qid) GROUP BY label",
    "mean_top1_sim": f"WITH {_S} SELECT round(avg(m), 4) AS mean_top1 FROM (SELECT max(score) AS m FROM s GROUP BY qid)",
    "nn_graph": f"WITH {_NN} SELECT * FROM nn",
    "confusion_pairs": f"WITH {_NN} SELECT qid AS a, tid AS b, round(score, 4) AS sim FROM nn WHERE score >= 0.4",
    "geometry_probe": f"WITH {_S} SELECT round(sum(s) / sum(n), 6) AS mean_cosine, round(avg(top), 6) AS mean_top1 FROM (SELECT sum(score) AS s, count(*) AS n, max(score) AS top FROM s GROUP BY qid)",
    "matrix_gaps": f"WITH {_X}, d AS (SELECT doc_id AS tid FROM documents) SELECT side, count(*) AS n FROM (SELECT tid, 'vectors' AS side FROM (SELECT tid FROM x EXCEPT ALL SELECT tid FROM d) UNION ALL SELECT tid, 'catalog' FROM (SELECT tid FROM d EXCEPT ALL SELECT tid FROM x)) GROUP BY side",
    "rank_stable": f"WITH {_E} SELECT qid, tid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rank FROM e",
    "rank_worst_tie": f"WITH {_E} SELECT qid, tid, score, count(*) OVER (PARTITION BY qid ORDER BY score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank FROM e",
    "zscore_per_query": f"WITH {_E} SELECT qid, tid, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-9), 6) AS z FROM e WINDOW w AS (PARTITION BY qid)",
    "nearest_row": f"WITH {_E} SELECT qid, tid, score FROM e QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) = 1",
    "rerank_replace": f"WITH {_W} SELECT qid, tid, row_number() OVER (PARTITION BY qid ORDER BY col > 25, CASE WHEN col <= 25 THEN -other END, col) AS new_rank FROM w",
    "rerank_depths": f"WITH {_W}, d AS (SELECT w.*, depth, row_number() OVER (PARTITION BY depth, qid ORDER BY col > depth, CASE WHEN col <= depth THEN -other END, col) AS r FROM w, (VALUES (10), (25), (50), (100)) v(depth)), best AS (SELECT depth, qid, min(r) AS rank FROM d JOIN g USING (qid, tid) GROUP BY ALL) SELECT depth, {_recall()} FROM (SELECT qid, depth FROM q, (VALUES (10), (25), (50), (100)) v(depth)) LEFT JOIN best USING (depth, qid) GROUP BY depth",
    "tokenize": f"SELECT doc_id AS tid, len(t)::BIGINT AS n, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOK} AS t FROM documents)",
    "term_stats": f"WITH {_BM} SELECT w, df, cf, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {_BM} SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rank FROM bm QUALIFY rank <= 10",
    "bm25_subpool": f"WITH {_BM} SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rank FROM bm WHERE tid IN (SELECT doc_id FROM labels WHERE quality = 1) QUALIFY rank <= 10",
    "bm25_nonzero_frac": f"WITH {_BM} SELECT round(count(*)::DOUBLE / ((SELECT count(*) FROM benchmark) * (SELECT count(*) FROM documents)), 6) AS nonzero FROM bm WHERE score > 0",
    "fuse_zscore": f"WITH {_W}, {_window('zscore', 0.2, 100)} SELECT qid, tid, round(fused, 6) AS fused FROM f",
    "fuse_rrf": f"WITH {_W}, {_window('rrf', 0.2, 100)} SELECT qid, tid, fused, new_rank FROM f",
    "fuse_rrf_tie": f"WITH {_W}, {_window('rrf_tie', 0.2, 100)} SELECT qid, tid, fused, new_rank FROM f",
    "fuse_window": f"WITH {_W}, {_window('rrf_tie', 0.5, 25)} SELECT qid, tid, new_rank FROM f",
    "fuse_full": f"WITH {_W_ALL}, {_window('rrf_tie', 0.2, 10**9)} SELECT qid, tid, fused, new_rank FROM f WHERE new_rank <= 25",
    "fusion_sweep": f"WITH {_W}, wg AS (SELECT w.*, g.tid IS NOT NULL AS gold FROM w LEFT JOIN g USING (qid, tid)), al AS (SELECT (i / 10.0)::DOUBLE AS alpha FROM range(11) r(i)), sw AS ({_SWEEP}) SELECT rule, depth, alpha, {_recall((1, 10, 25))} FROM sw GROUP BY rule, depth, alpha",
    "union_ceiling": f"""WITH {_R}, {_G}, {_DEALT}, a AS (SELECT DISTINCT r.qid FROM r JOIN g USING (qid, tid) WHERE rank <= 100),
 l AS (SELECT qid, tid FROM bm WHERE score > 0 AND qid <> tid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) <= 100),
 u AS (SELECT DISTINCT qid FROM (SELECT qid, tid FROM r WHERE rank <= 100 UNION SELECT qid, tid FROM l) JOIN g USING (qid, tid)),
 n AS (SELECT DISTINCT qid FROM g), z AS (SELECT avg((a.qid IS NOT NULL)::INT) AS f, avg((u.qid IS NOT NULL)::INT) AS e FROM n LEFT JOIN a USING (qid) LEFT JOIN u USING (qid))
 SELECT round(f, 4) AS first, round(e, 4) AS either, round(e - f, 4) AS headroom FROM z""",
    "pool_curve": f"""WITH {_R}, {_G}, o AS (SELECT tid, row_number() OVER (ORDER BY {_md5('pool', 'tid')}) AS nth FROM x WHERE tid NOT IN (SELECT tid FROM g)),
 p AS (SELECT DISTINCT pool::INTEGER AS pool FROM (VALUES (100), (200), (400) UNION ALL SELECT greatest(count(*), 1) FROM o) v(pool)),
 k AS (SELECT pool, qid, tid, row_number() OVER (PARTITION BY pool, qid ORDER BY rank) AS r FROM r LEFT JOIN o USING (tid), p WHERE coalesce(nth, 0) <= pool),
 best AS (SELECT pool, qid, min(r) AS rank FROM k JOIN g USING (qid, tid) GROUP BY ALL) SELECT pool, {_recall()} FROM best GROUP BY pool""",
    "dedup_queries": f"""WITH {_INTENTS}, k AS (SELECT *, array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(query, '')), '[^a-z0-9 ]+', '', 'g'), ' +'), lambda a: a <> '')), ' ') AS key FROM i)
 SELECT intent_id, md5(key) AS key FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY intent_id) = 1) WHERE length(trim(query)) >= 8""",
    "tool_holdout": f"WITH {_HELD} SELECT tool_id AS source, is_heldout FROM held",
    "route_splits": f"""WITH {_INTENTS}, {_HELD}, {_GOLDS}, per AS (SELECT intent_id, bool_or(coalesce(is_heldout, false)) AS h, count(*) AS n FROM golds LEFT JOIN held USING (tool_id) GROUP BY intent_id),
 z AS (SELECT *, ('0x' || substr(md5('route:' || intent_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM i JOIN per USING (intent_id))
 SELECT intent_id, CASE WHEN h THEN 'C_unseen_tools' WHEN n > 1 THEN 'F_ambiguous_multi' WHEN u < 0.2::DOUBLE THEN 'test_A' WHEN u < 0.32::DOUBLE THEN 'dev_A' ELSE 'train' END AS split FROM z""",
    "group_cap_sample": f"SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_md5('cap', 'l_orderkey', 'l_linenumber')}) AS pick FROM lineitem QUALIFY pick <= 5",
    "stratified_sample": f"SELECT source, doc_id FROM (SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_md5('strata', 'doc_id')}) <= 5) ORDER BY {_md5('strata', 'doc_id')} LIMIT 60",
    "fixed_batches": "SELECT o_custkey, batch, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 8 AS batch FROM orders) GROUP BY ALL",
    "near_dup_cross": """WITH s AS (SELECT vec_id AS i, CASE WHEN vec_id % 3 = 0 THEN 'dev' ELSE 'test' END AS side, embedding::DOUBLE[] AS v FROM embeddings),
 h AS (SELECT DISTINCT a.i FROM s a JOIN s b ON a.side = 'dev' AND b.side = 'test' WHERE round(list_dot_product(a.v, b.v), 6) > 0.4)
 SELECT s.i AS intent_id, CASE WHEN h.i IS NOT NULL THEN 'dropped' ELSE side END AS side FROM s LEFT JOIN h USING (i)""",
    "confusable_components": f"WITH RECURSIVE {_NN_ALL}, {_COMP} SELECT * FROM comp",
    "component_partition": f"WITH RECURSIVE {_NN_ALL}, {_COMP}, {_PART} SELECT * FROM part",
    "partition_audit": f"""WITH RECURSIVE {_NN_ALL}, {_COMP}, {_PART}, bad AS (SELECT tool FROM part JOIN vi USING (intent_id) WHERE tool IS NOT NULL AND side <> 'dropped' GROUP BY tool HAVING count(DISTINCT side) > 1)
 SELECT count(*) FILTER (side = 'dev') AS dev, count(*) FILTER (side = 'test') AS test, count(*) FILTER (side = 'dropped') AS dropped, (SELECT count(*) FROM bad) AS on_both_sides FROM part""",
    "bucket_stats": f"""WITH {_BUCKET}, a AS (SELECT count(*) AS n, sum(1 - {_HIT(10)}) AS m FROM k)
 SELECT bucket, count(*) AS n, {', '.join(f'round(avg({_HIT(x)}), 4) AS r_at_{x}' for x in (1, 10, 25))}, round(count(*)::DOUBLE / any_value(a.n), 4) AS share_items,
 round(CASE WHEN any_value(a.m) > 0 THEN sum(1 - {_HIT(10)})::DOUBLE / any_value(a.m) ELSE 0 END, 4) AS share_misses FROM k, a GROUP BY bucket""",
    "headroom": _headroom("1"),
    "headroom_no_reference": _headroom("absent"),
    "representation_ratio": """WITH c AS (SELECT lang, count(*) AS catalog_n FROM documents GROUP BY lang), g AS (SELECT lang, count(*) AS gold_n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang),
 r AS (SELECT lang, coalesce(gold_n, 0) AS gold_n, coalesce(catalog_n, 0) AS catalog_n FROM c FULL JOIN g USING (lang))
 SELECT *, round((gold_n::DOUBLE / nullif(sum(gold_n) OVER (), 0)) / nullif(catalog_n::DOUBLE / nullif(sum(catalog_n) OVER (), 0), 0), 4) AS ratio FROM r""",
    "sign_split": f"""WITH {_CFG}, d AS (SELECT c.config, c.split, c.value - b.value AS d, c.split = (SELECT min(event_type) FROM events) AS anchor FROM c JOIN c b ON b.split = c.split AND b.config = '0' WHERE c.config <> '0'),
 m AS (SELECT config, round(avg(d) FILTER (anchor), 4) AS anchor_delta, round(avg(d) FILTER (NOT anchor), 4) AS other_delta FROM d GROUP BY config) SELECT *, anchor_delta < 0 AND other_delta > 0 AS parts FROM m""",
    "best_config": f"WITH {_CFG} SELECT config, round(avg(value), 6) AS macro FROM c GROUP BY config ORDER BY macro DESC, config LIMIT 1",
    "pooled_metrics": f"WITH {_R}, {_G}, {_BEST}, i AS (SELECT (label % 3)::VARCHAR AS split, rank FROM b JOIN q USING (qid)) SELECT split, {_recall()} FROM (SELECT * FROM i UNION ALL SELECT 'POOLED_generated', rank FROM i WHERE split <> '0') GROUP BY split",
    "selector_tally": """WITH r AS (SELECT event_type AS split, (user_id % 4)::VARCHAR AS gold, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 10 = 1 THEN 'NONE' ELSE (event_id % 4)::VARCHAR END AS choice, event_id % 9 <> 0 AND event_id % 6 = 0 AS tied FROM events)
 SELECT split, count(*) AS items, count(choice) AS n, count(*) FILTER (choice = gold) AS correct, count(*) FILTER (choice = 'NONE') AS none, count(*) FILTER (tied) AS tied, count(*) FILTER (choice IS NULL) AS missing,
 round(count(*) FILTER (choice = gold)::DOUBLE / greatest(count(choice), 1), 4) AS accuracy FROM r GROUP BY split""",
    "conditional_accuracy": "SELECT event_type AS split, count(*) AS n, round(avg((user_id % 2 = 0)::INT), 4) AS end_to_end, round(avg((user_id % 2 = 0)::INT) FILTER (event_id % 3 <> 0), 4) AS given_gold FROM events GROUP BY event_type",
    "run_disagreements": 'WITH a AS (SELECT o_custkey, round(avg(o_totalprice), 4) AS "left" FROM orders GROUP BY 1), b AS (SELECT o_custkey, round(avg(o_totalprice), 4) AS "right" FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT o_custkey, "left", "right" FROM a JOIN b USING (o_custkey) WHERE abs("left" - "right") > 1e-9',
    "paired_bootstrap": f"""WITH {_W}, {_window('rrf_tie', 0.5, 100)}, ba AS (SELECT qid, min(col) AS base FROM w JOIN g USING (qid, tid) GROUP BY qid), ne AS (SELECT qid, min(new_rank) AS new FROM f JOIN g USING (qid, tid) GROUP BY qid),
 p AS (SELECT label, qid, coalesce(new <= 10, false)::INT - coalesce(base <= 10, false)::INT AS r, round((coalesce(1.0::DOUBLE / new, 0) - coalesce(1.0::DOUBLE / base, 0)) * 1e9)::BIGINT AS q FROM q LEFT JOIN ba USING (qid) LEFT JOIN ne USING (qid)),
 {_replicates('p', 'label', 'qid', 2000, 'sum(w) AS m, sum(w * r) AS r, sum(w * q) AS q')},
 c AS (SELECT label, count(*) AS n FROM p GROUP BY label)
 SELECT label, any_value(n) AS n, {_interval('rs.r / rs.m', 'r')}, {_interval('rs.q / rs.m / 1e9', 'mrr')}, round(avg((rs.q <= 0)::INT), 6) AS p_mrr_not_above FROM rs JOIN c USING (label) WHERE rs.m > 0 GROUP BY label""",
    "mean_difference": f"""WITH p AS (SELECT event_type, user_id, count(*) AS n, sum((event_id % 2 - user_id % 2) * 1000000000)::BIGINT AS d FROM events GROUP BY ALL),
 {_replicates('p', 'event_type', 'user_id', 2000, 'sum(w * n) AS m, sum(w * d) AS d')},
 c AS (SELECT event_type, sum(n)::BIGINT AS n, round(sum(d) / sum(n) / 1e9, 6) AS mean_delta FROM p GROUP BY event_type)
 SELECT event_type, any_value(n) AS n, any_value(mean_delta) AS mean_delta, round(quantile_cont(rs.d / rs.m / 1e9, 0.025), 6) AS low, round(quantile_cont(rs.d / rs.m / 1e9, 0.975), 6) AS high FROM rs JOIN c USING (event_type) WHERE rs.m > 0 GROUP BY event_type""",
    "mcnemar_exact": f"""WITH {_W}, {_window('rrf_tie', 0.5, 100)}, ba AS (SELECT qid, min(col) AS base FROM w JOIN g USING (qid, tid) GROUP BY qid), ne AS (SELECT qid, min(new_rank) AS new FROM f JOIN g USING (qid, tid) GROUP BY qid),
 p AS (SELECT label, coalesce(base <= 10, false) AS hb, coalesce(new <= 10, false) AS hn, coalesce(1.0::DOUBLE / base, 0) AS ib, coalesce(1.0::DOUBLE / new, 0) AS inw FROM q LEFT JOIN ba USING (qid) LEFT JOIN ne USING (qid)),
 a AS (SELECT label, count(*) AS n, count(*) FILTER (hn AND NOT hb) AS b, count(*) FILTER (hb AND NOT hn) AS c, round(avg(hn::INT - hb::INT), 4) AS d_r, round(avg(inw - ib), 4) AS d_mrr FROM p GROUP BY label)
 SELECT *, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END, 6) AS mcnemar_p FROM a""",
    "hard_negatives": f"WITH {_NEG} SELECT qid, {', '.join(f'a[least({i}, len(a))] AS negative_{i}' for i in (1, 2, 3, 4))} FROM ng",
    "negative_provenance": f"WITH {_NEG}, m AS (SELECT x.label::VARCHAR AS source, count(*) AS n FROM (SELECT unnest(a) AS tid FROM ng) JOIN x USING (tid) GROUP BY 1) SELECT source, n, round(n::DOUBLE / sum(n) OVER (), 4) AS share FROM m",
    "oracle_shortlist": _ORACLE_SHORTLIST,
    "composed_arms": f"WITH {_W}, {_window('rrf_tie', 0.2, 100)}, a AS (SELECT qid, tid, 'dense' AS arm FROM w WHERE col <= 25 UNION ALL SELECT qid, tid, 'fused' FROM f WHERE new_rank <= 25) SELECT qid, arm, bool_or(g.tid IS NOT NULL) AS has_gold FROM a LEFT JOIN g USING (qid, tid) GROUP BY qid, arm",
    "rescued_lost": f"""WITH {_W}, {_window('rrf_tie', 0.2, 100)}, a AS (SELECT w.qid, bool_or(w.col <= 25 AND g.tid IS NOT NULL) AS d, bool_or(f.new_rank <= 25 AND g.tid IS NOT NULL) AS e FROM w JOIN f USING (qid, tid) LEFT JOIN g USING (qid, tid) GROUP BY w.qid)
 SELECT count(*) AS n, round(avg(d::INT), 4) AS dense_rate, round(avg(e::INT), 4) AS fused_rate, count(*) FILTER (e AND NOT d) AS rescued, count(*) FILTER (d AND NOT e) AS lost FROM a""",
    "shortlist_dedup": "WITH s AS (SELECT l_orderkey AS item, list_sort(list(DISTINCT l_partkey % 5)) AS k FROM lineitem GROUP BY l_orderkey) SELECT item, min(item) OVER (PARTITION BY k, item % 3) AS owner FROM s",
    **{f"doc_text_{v}": _doc_text(v) for v in ("v0", "v1", "v2", "v3")},
    "humanize_path": f"WITH {_TOOLS} SELECT pos, {_HUMAN} AS words FROM t",
    "slug_and_key": f"WITH {_TOOLS} SELECT pos, tool_id, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS norm FROM t",
    "side_effects": f"WITH {_TOOLS} SELECT CASE WHEN method = 'delete' THEN 'destructive' WHEN method = 'get' THEN 'read' ELSE 'write' END AS side_effects, count(*) AS n FROM t GROUP BY 1",
    "doc_quality": f"WITH {_TOOLS} SELECT (length(description) >= 20)::INT + (length(description) >= 120)::INT + (len(params) > 0)::INT + (len(params) > 0 AND len(list_filter(params, lambda a: length(a || ' of the page') >= 10)) / greatest(len(params), 1) >= 0.5)::INT AS doc_quality, count(*) AS n FROM t GROUP BY 1",
    "first_wins": f"WITH {_TOOLS} SELECT tool_id, min(pos) AS pos FROM t GROUP BY tool_id",
    "redact": f"SELECT event_id, {_redacted('t')} AS t FROM ({_PLANTED})",
    "redaction_counts": "SELECT event_type, class, sum(n)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT event_type, '{name}' AS class, len(regexp_extract_all(t, '{pattern}')) AS n FROM ({_PLANTED})" for name, pattern, _ in RULES) + ") GROUP BY ALL HAVING sum(n) > 0",
    "json_fenced_extract": r"""WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Answer:' || chr(10) || '```json' || chr(10) || '[' || props || ']' || chr(10) || '```' || chr(10) || 'Done.' WHEN 1 THEN 'Sure: [' || props || ', ' || props || '] as asked'
 WHEN 2 THEN '[{broken' WHEN 3 THEN '```' || chr(10) || '[' || props || ']' || chr(10) || '``` and [more]' WHEN 4 THEN '' WHEN 5 THEN '```json' || chr(10) || '[{"k": }]' || chr(10) || '```' ELSE 'no array here' END AS t FROM events),
 b AS (SELECT event_id, coalesce(nullif(regexp_extract(t, '(?s)```(?:json)?\s*(.*?)```', 1), ''), t) AS b FROM e), a AS (SELECT event_id, regexp_extract(b, '(?s)(\[.*\])', 1) AS a FROM b)
 SELECT event_id, (CASE WHEN a <> '' AND json_valid(a) THEN json_array_length(a) ELSE 0 END)::BIGINT AS n FROM a""",
    "paged_prompts": f"""WITH {_TOOLS}, l AS (SELECT *, (row_number() OVER (PARTITION BY api_title ORDER BY pos) - 1) // 4 AS batch,
  '  tool_id: ' || tool_id || chr(10) || '  name: ' || name || chr(10) || '  service: ' || api_title[1:60] || chr(10) || '  desc: ' || coalesce(nullif(description, ''), nullif(summary, ''), '(no description)')[1:260]
  || CASE WHEN len(params) > 0 THEN chr(10) || '  params: ' || array_to_string(params[1:8], ', ') ELSE '' END AS block FROM t)
 SELECT api_title || ':' || batch AS b, count(*) AS n, md5('{STANDARD.replace("'", "''")}' || chr(10) || string_agg(block, chr(10) ORDER BY pos)) AS digest FROM l GROUP BY api_title, batch""",
    "evaluate_splits": f"""WITH {_R}, {_G}, it AS (SELECT (label % 3)::VARCHAR AS split, qid, label FROM q UNION ALL SELECT (label % 3)::VARCHAR || ':thin', qid, label FROM q WHERE qid % 40 = 0),
 top AS (SELECT split, count(*) AS queries, round(avg(m), 4) AS mean_top1 FROM it JOIN (SELECT qid, max(score) AS m FROM r GROUP BY qid) USING (qid) GROUP BY split),
 bk AS (SELECT qid, min(rank) AS rank FROM r JOIN g USING (qid, tid) WHERE rank <= 100 GROUP BY qid),
 m AS (SELECT split, {_recall((1, 10, 25))} FROM (SELECT it.split, bk.rank FROM it LEFT JOIN bk USING (qid) WHERE it.label <> 0) GROUP BY split) SELECT * FROM top LEFT JOIN m USING (split)""",
    "matrix_sweep": f"WITH {_Q}, {_X}, {_G}, a AS ({_matrix(32)}), b AS ({_matrix(64)}) SELECT 'd32|v0' AS matrix_id, label, a.r_at_10, a.r_at_100, a.mrr, {', '.join(f'round(a.{c} - b.{c}, 4) AS d_{c}' for c in ('r_at_10', 'r_at_100', 'mrr'))} FROM a JOIN b USING (label)",
    "matrix_report": f"WITH {_Q}, {_X}, {_G}, a AS ({_matrix(32)}), b AS ({_matrix(64)}) SELECT label, b.mrr AS d64, a.mrr AS d32 FROM a JOIN b USING (label)",
    "random_control": f"WITH {_R}, {_G}, {_BEST}, m AS (SELECT label, {_recall()} FROM b JOIN q USING (qid) GROUP BY label) SELECT label, n, r_at_100, {', '.join(f'round(r_at_100 * {k} / 100, 4) AS random_at_{k}' for k in (1, 10, 25))} FROM m",
    "alpha_plateau": f"""WITH {_W}, wg AS (SELECT w.*, g.tid IS NOT NULL AS gold FROM w LEFT JOIN g USING (qid, tid)), al AS (SELECT (i / 10.0)::DOUBLE AS alpha FROM range(11) r(i)), sw AS ({_SWEEP}),
 ms AS (SELECT rule, depth, alpha, {_recall((1,))} FROM sw GROUP BY ALL), t AS (SELECT rule, depth, max(mrr) AS best FROM ms GROUP BY ALL)
 SELECT rule, depth, round(any_value(best), 4) AS best, min(alpha) AS low, max(alpha) AS high FROM ms JOIN t USING (rule, depth) WHERE mrr >= best - 0.005::DOUBLE - 1e-9 GROUP BY rule, depth""",
    "claim_table": f"""WITH {_W}, {_window('rrf_tie', 0.5, 100)}, ba AS (SELECT qid, min(col) AS base FROM w JOIN g USING (qid, tid) GROUP BY qid), ne AS (SELECT qid, min(new_rank) AS new FROM f JOIN g USING (qid, tid) GROUP BY qid),
 p0 AS (SELECT (label % 3)::VARCHAR AS split, coalesce(base <= 10, false) AS hb, coalesce(new <= 10, false) AS hn, coalesce(1.0::DOUBLE / base, 0) AS ib, coalesce(1.0::DOUBLE / new, 0) AS inw FROM q LEFT JOIN ba USING (qid) LEFT JOIN ne USING (qid)),
 p AS (SELECT * FROM p0 UNION ALL SELECT * REPLACE ('POOLED_generated' AS split) FROM p0 WHERE split <> '0'),
 a AS (SELECT 'fused' AS claim, split, count(*) AS n, count(*) FILTER (hn AND NOT hb) AS b, count(*) FILTER (hb AND NOT hn) AS c, round(avg(hn::INT - hb::INT), 4) AS d_r, round(avg(inw - ib), 4) AS d_mrr FROM p GROUP BY split)
 SELECT *, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) END, 6) AS mcnemar_p FROM a""",
    "lexical_pool_curve": f"""WITH {_BM}, gl AS (SELECT item_id AS qid, doc_id AS tid FROM benchmark JOIN documents ON item_id * 13 % 997 = doc_id % 997),
 o AS (SELECT doc_id AS tid, row_number() OVER (ORDER BY {_md5('lexical', 'doc_id')}) AS nth FROM documents WHERE doc_id NOT IN (SELECT tid FROM gl)),
 p AS (SELECT DISTINCT pool::INTEGER AS pool FROM (VALUES (100), (200), (400) UNION ALL SELECT greatest(count(*), 1) FROM o) v(pool)),
 k AS (SELECT pool, qid, tid, row_number() OVER (PARTITION BY pool, qid ORDER BY score DESC, tid) AS r FROM bm LEFT JOIN o USING (tid), p WHERE coalesce(nth, 0) <= pool),
 z AS (SELECT pool, qid, min(r) AS rank FROM k JOIN gl USING (qid, tid) GROUP BY ALL),
 best AS (SELECT pool, qid, rank FROM p CROSS JOIN (SELECT DISTINCT qid FROM gl) LEFT JOIN z USING (pool, qid)) SELECT pool, {_recall()} FROM best GROUP BY pool""",
    "confusion_candidates": f"WITH {_NN_ALL}, p AS (SELECT qid AS a, tid AS b, round(score, 4) AS sim FROM nn WHERE score >= 0.4) SELECT a, b, sim FROM p JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE x.label % 2 = 0 AND y.label % 2 = 0 ORDER BY {_md5('candidates', 'a', 'b')} LIMIT 10",
    "separable_filters": f"WITH {_INTENTS} SELECT count(*) FILTER (quality = 1) AS true, count(*) FILTER (quality <> 1) AS false, count(*) FILTER (quality IS NULL OR quality <> 1) AS falsy FROM i LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON doc_id = conv_id",
    "mean_words": "SELECT lang, count(*) AS n, round(avg(len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda a: a <> ''))), 4) AS mean_words FROM documents GROUP BY lang",
    "jsonl_round_trip": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "label_queries": f"WITH {_TOOLS}, c AS (SELECT api_title, arg_min(tool_id, pos) AS tool_id FROM t GROUP BY api_title) SELECT doc_id AS intent_id, tool_id FROM documents JOIN c ON api_title = source || CASE WHEN doc_id % 5 = 0 THEN '?' ELSE '' END",
    "plugin_join": "SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey END AS region FROM nation",
    "catalog_pool": "SELECT tool_id, row_number() OVER (ORDER BY side, k) - 1 AS pos FROM (SELECT n_name AS tool_id, 0 AS side, n_nationkey AS k FROM nation UNION ALL SELECT s_name, 1, s_suppkey FROM supplier)",
    "picked_specs": f"WITH u AS (SELECT source || ':' || doc_id AS api_id, source AS provider FROM documents WHERE doc_id % 3 <> 0) SELECT api_id, provider FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY provider ORDER BY {_md5('specs', 'api_id')}) <= 3) ORDER BY {_md5('specs', 'api_id')} LIMIT 40",
    "best_gold": f"WITH {_R}, {_G} SELECT qid, tid, rank FROM r JOIN g USING (qid, tid) WHERE rank <= 100 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank) = 1",
    "thin_descriptions": "SELECT thin, round(100.0::DOUBLE * thin / greatest(n, 1), 1) AS share FROM (SELECT count(*) AS n, count(*) FILTER (len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda a: a <> '')) <= 100) AS thin FROM documents)",
    "table_digest": f"""WITH h AS (SELECT sha256('{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}}') AS h FROM customer),
 l AS (SELECT {', '.join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT)::VARCHAR AS l{i}" for i in range(8))} FROM h) SELECT substr(sha256(concat_ws(':', {', '.join(f'l{i}' for i in range(8))})), 1, 16) AS sha16 FROM l""",
    "unmatched_labels": f"WITH {_TOOLS} SELECT count(*) AS unmatched FROM documents WHERE source || CASE WHEN doc_id % 5 = 0 THEN '?' ELSE '' END NOT IN (SELECT api_title FROM t)",
    "paired_arms": """WITH r AS (SELECT o_custkey % 4 AS split, o_orderkey // 2 AS item, o_orderkey % 2 = 0 AS d, o_orderkey % 3 = 0 AS ok FROM orders WHERE o_orderkey % 5 <> 0)
 SELECT split, count(*) AS n, count(*) FILTER (a.ok AND NOT b.ok) AS b FROM r a JOIN r b USING (split, item) WHERE a.d AND NOT b.d GROUP BY split""",
    "shared_answers": """WITH s AS (SELECT l_orderkey AS item, list_sort(list(DISTINCT l_partkey % 5)) AS k FROM lineitem GROUP BY l_orderkey), w AS (SELECT item, min(item) OVER (PARTITION BY k, item % 3) AS owner FROM s)
 SELECT item, owner, o_orderstatus AS choice, o_orderstatus IS NULL AS missing FROM w LEFT JOIN orders ON o_orderkey = owner AND o_orderkey % 3 <> 0""",
    "valid_generated": """SELECT conv_id % 7 AS batch, count(*) AS n FROM conversations WHERE turn % 4 <> 0 AND text IS NOT NULL AND trim(text) <> '' AND NOT (turn % 3 = 0 AND turn % 2 = 0) AND turn % 5 <= (conv_id % 7) % 4 GROUP BY 1""",
    "extract_operations": f"""WITH {_TOOLS}, o AS (SELECT api_title, path || '/' || pos AS p, row_number() OVER (PARTITION BY api_title ORDER BY path || '/' || pos) AS i FROM t),
 e AS (SELECT api_title, p, verb, 2 * i + (verb = 'post')::INT AS nth FROM o, (VALUES ('get'), ('post')) v(verb) WHERE 2 * (i - 1) + (verb = 'post')::INT < 5),
 n AS (SELECT *, {_slug('verb', 'p')} AS name, (SELECT min(t.pos) FROM t WHERE t.api_title = e.api_title) AS spec FROM e), k AS (SELECT *, {_slug('api_title', 'name')} AS tool_id FROM n)
 SELECT tool_id, CASE verb WHEN 'get' THEN 'read' ELSE 'write' END AS side_effects, 'web' AS domain, CASE verb WHEN 'get' THEN 'itemId:integer:path' ELSE 'title:string:body size:integer:body parent:object:body' END AS fields,
  CASE verb WHEN 'get' THEN 'itemId' ELSE 'size title' END AS needed, p AS path FROM k QUALIFY row_number() OVER (PARTITION BY tool_id ORDER BY spec, nth) = 1""",
    "fusion_sweep_zscore": f"WITH {_W}, wg AS (SELECT w.*, g.tid IS NOT NULL AS gold FROM w LEFT JOIN g USING (qid, tid)), al AS (SELECT (i / 10.0)::DOUBLE AS alpha FROM range(11) r(i)), sw AS ({_sweep('zscore')}) SELECT rule, depth, alpha, {_recall((1, 10, 25))} FROM sw GROUP BY rule, depth, alpha",
    "composed_zscore": f"""WITH {_W}, {_window('zscore', 0.2, 100)}, a AS (SELECT w.qid, bool_or(w.col <= 25 AND g.tid IS NOT NULL) AS d, bool_or(f.new_rank <= 25 AND g.tid IS NOT NULL) AS e FROM w JOIN f USING (qid, tid) LEFT JOIN g USING (qid, tid) GROUP BY w.qid)
 SELECT count(*) AS n, round(avg(d::INT), 4) AS dense_rate, round(avg(e::INT), 4) AS fused_rate, count(*) FILTER (e AND NOT d) AS rescued, count(*) FILTER (d AND NOT e) AS lost FROM a""",
    "score_cache": f"WITH {_R} SELECT qid, tid, score, rank FROM r WHERE rank <= 10",
    "training_batches": f"WITH {_BATCHES} SELECT o_orderkey, o_custkey, batch FROM bt",
    "training_batch_audit": f"WITH {_BATCHES}, c AS (SELECT batch, o_custkey, count(*) AS n FROM bt GROUP BY ALL), s AS (SELECT batch, sum(n)::BIGINT AS size, count(*) FILTER (n > 1) AS r FROM c GROUP BY batch) SELECT count(*) AS batches, min(size) AS smallest, max(size) AS largest, sum(r)::BIGINT AS repeats FROM s",
    "training_pairs": f"""WITH cat AS (SELECT source AS tool_id, min(doc_id) AS f FROM documents WHERE source <> 'src1' GROUP BY source),
 p AS (SELECT doc_id AS intent_id, text[1:40] AS anchor, source AS tool_id, source || ':' || f AS positive FROM documents JOIN cat ON tool_id = source)
 SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY tool_id ORDER BY {_md5('pairs', 'intent_id')}) <= 5""",
    "split_registry": """WITH c AS (SELECT conv_id * 1000 + turn AS n, conv_id FROM conversations WHERE role = 'user'),
 i AS (SELECT CASE conv_id % 5 WHEN 0 THEN 'test_A' WHEN 1 THEN 'standard_L2' WHEN 2 THEN 'standard_L4' WHEN 3 THEN CASE WHEN conv_id % 3 = 0 THEN 'splitD_separable' ELSE 'splitD_inseparable' END ELSE 'splitE_abstain' END AS split,
   CASE WHEN conv_id % 5 = 4 THEN 0 ELSE (conv_id % 7 < 6)::INT + (n % 11 < 6)::INT END AS golds, conv_id FROM c WHERE conv_id % 5 = 0 OR conv_id // 5 % 2 = 0)
 SELECT split, count(*) AS n, sum(golds)::BIGINT AS golds FROM i WHERE golds > 0 OR conv_id % 5 = 4 GROUP BY split UNION ALL SELECT unnest(['C_unseen_tools', 'standard_L3']), NULL, NULL""",
    "generation_ledger": f"""WITH {_TOOLS}, {_UNITS}, b AS (SELECT b, min(pos) AS first FROM l GROUP BY b)
 SELECT count(*) AS sent, count(*) FILTER (first % 3 <> 0) AS answered, count(*) FILTER (first % 3 = 0) AS failed, 0::BIGINT AS unanswered, round(0.25::DOUBLE * count(*) FILTER (first % 3 <> 0), 6) AS cost FROM b""",
    "generated_intents": f"""WITH {_TOOLS}, {_UNITS}, b AS (SELECT b, min(pos) AS first FROM l GROUP BY b)
 SELECT tool_id, trim('do ' || name) AS query, 'unambiguous' AS task_variant, 'L2' AS difficulty, count(*) AS n FROM l JOIN b USING (b) WHERE first % 3 <> 0 AND pos % 5 <> 0 GROUP BY ALL""",
    "selected_answers": f"""WITH o AS ({_ORACLE_SHORTLIST}), p AS (SELECT qid, arg_max(tid, slot) AS choice, arg_max(tid, slot) FILTER (is_gold) AS gold FROM o GROUP BY qid),
 a AS (SELECT qid, gold, (qid % 200 = 0)::VARCHAR AS split, CASE WHEN qid % 60 = 20 THEN NULL WHEN qid % 3 = 0 THEN 'NONE' ELSE choice::VARCHAR END AS choice, qid % 40 = 0 AS tied FROM p)
 SELECT split, count(*) AS items, count(choice) AS n, count(*) FILTER (choice = gold::VARCHAR) AS correct, count(*) FILTER (choice = 'NONE') AS none, count(*) FILTER (choice IS NOT NULL AND tied) AS tied, count(*) FILTER (choice IS NULL) AS missing,
   round(count(*) FILTER (choice = gold::VARCHAR) / greatest(count(choice), 1)::DOUBLE, 4) AS accuracy FROM a GROUP BY split""",
    "risk_coverage": f"WITH {_PLACED} SELECT tid, place, round(place::DOUBLE / n, 9) AS coverage, round(errors::DOUBLE / place, 9) AS risk FROM pl",
    "calibration_bins": f"WITH {_PLACED} SELECT bin, n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM bins",
    "selective_report": f"""WITH {_PLACED} SELECT count(*) AS n, round(avg(correct::INTEGER), 6) AS accuracy, round(avg(errors::DOUBLE / place), 6) AS aurc, (SELECT round(sum(n * abs(c - a)) / sum(n), 6) FROM bins) AS ece,
 round(max(CASE WHEN place = ceil(n * 50 / 100) THEN errors::DOUBLE / place END), 6) AS risk_50, round(max(CASE WHEN place = ceil(n * 80 / 100) THEN errors::DOUBLE / place END), 6) AS risk_80 FROM pl""",
    "catalog_drift": f"WITH {_SNAP} SELECT * FROM st",
    "drift_refresh": f"""WITH {_SNAP}, was AS ({_BEST_IN("o")}), now AS ({_BEST_IN("nw")}), hurt AS (SELECT DISTINCT qid FROM was JOIN st USING (tid) WHERE status IN ('removed', 'changed'))
 SELECT qid, tid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, tid) AS rank, qid IN (SELECT qid FROM hurt) AS searched FROM now""",
    "argument_errors": f"WITH {_CALLS} SELECT event_id, errors, round(f1, 6) AS f1 FROM r",
    "argument_scores": f"""WITH {_CALLS} SELECT event_type, count(*) AS n, round(avg((errors = '')::INTEGER), 6) AS valid, round(sum(hits)::DOUBLE / sum(n_said), 6) AS precision, round(sum(hits)::DOUBLE / sum(n_gold), 6) AS recall,
 round(2.0::DOUBLE * sum(hits) / (sum(n_said) + sum(n_gold)), 6) AS f1, round(avg(f1), 6) AS mean_f1 FROM r GROUP BY event_type""",
}
