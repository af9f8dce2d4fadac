"""Filter audit, embedding near-duplicates and source divergence against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from siftwell.llm import embedding_dedup, filter_audit, source_divergence
from test_corpus_operators import WORD, frame, odd_rows

LABELS = "doc_id long, quality int, toxic int"


# --- filter interaction audit


def audit_by_hand(rows, labels):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    docs = defaultdict(list)
    for i, t, _, source in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        docs[source or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, own in docs.items():
        removed_in = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                removed_in[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in d[0] for d in own) - len(gone), sum(d[0] == {f} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(removed_in[order[k - 1]])
    return out


def test_filter_audit(spark):
    rnd = random.Random(4)
    words = [rnd.choice(["", "#", "A", "BC"]) + f"w{i}" for i in range(300)]
    rows = odd_rows() + [(None, "same text here and there", "en", None)]
    rows += [(100 + i, rnd.choice([" ", "\n"]).join(rnd.choices(words[: rnd.choice([5, 40, 300])], k=rnd.randint(0, 120))), "en", rnd.choice(["s1", "s2", "", None])) for i in range(80)]
    rows += [(500 + i, rows[20][1], "en", "s2") for i in range(30)] + [(90, rows[20][1], "en", "s3")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(90, 190)] + [(100, 1, 0), (100, 0, 1), (None, 1, 1), (5, 1, 1)]
    want = audit_by_hand(rows, labels)
    got = {(r[0], r[1], r[2]): list(r[3:]) for r in filter_audit.audit(frame(spark, rows, extra=True), spark.createDataFrame(labels, LABELS)).collect()}
    assert got == want


def test_parity_sums_invert(spark):
    """Any counts of masks come back from their sums."""
    rnd = random.Random(8)
    masks = [(rnd.choice("xy"), rnd.randrange(32), rnd.randrange(2), rnd.randrange(2)) for _ in range(500)]
    sums = filter_audit.parity_sums(spark.createDataFrame(masks, "part string, mask int, good int, toxic int"))
    for r in sums.select("part", *[filter_audit.inverted(sums[k]).alias(k) for k in filter_audit.KINDS]).collect():
        for kind, weigh in (("n", lambda m: 1), ("good", lambda m: m[2]), ("toxic", lambda m: m[3])):
            n = Counter()
            for m in masks:
                n[m[1]] += weigh(m) * (m[0] == r["part"])
            assert r[kind] == [n[k] for k in range(32)]


def test_digests_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 0)
    test_filter_audit(spark)


# --- embedding near-duplicates


def dedup_by_hand(rows, least=0.9):
    """By row: links to other rows, and the smallest id within reach."""
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    near = defaultdict(set)
    for a, (_, v) in enumerate(rows):
        for b in range(a):
            w = rows[b][1]
            if ok[a] and ok[b] and len(v) == len(w):
                x, y = np.asarray(v, "f8"), np.asarray(w, "f8")
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= least:
                    near[a].add(b)
                    near[b].add(a)
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        c = min((rows[b][0] for b in seen), default=None) if i is not None else None
        out.append((i, len(near[a]), c, i is not None and c == i))
    return sorted(out, key=repr)


def vectors_for(seed, n=300, width=16):
    rnd = np.random.default_rng(seed)
    f4 = lambda v: [float(x) for x in np.asarray(v, "f4")]
    rows = [(i, f4(rnd.standard_normal(width))) for i in range(10, 10 + n)]
    at = rnd.standard_normal(width)
    rows += [(1000 + i, f4(at + 0.05 * rnd.standard_normal(width))) for i in range(120)]  # one group of near copies
    rows += [(2000 + i, rows[0][1]) for i in range(40)]  # and one of copies
    walk = rnd.standard_normal(width)
    for i in range(60):  # a chain of which the ends are far apart
        walk = walk / np.linalg.norm(walk) + 0.08 * rnd.standard_normal(width)
        rows.append((3000 - i, f4(walk)))
    return rows


def test_embedding_dedup(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 32)
    monkeypatch.setattr(embedding_dedup, "SIDE", 16)
    monkeypatch.setattr(embedding_dedup, "MISS", 1e-6)
    rows = vectors_for(1) + [
        (1, None), (2, []), (3, [0.0] * 16), (4, [1.0, None] * 8), (5, [float("nan")] + [1.0] * 15), (6, [float("inf")] + [1.0] * 15), (None, [1.0] * 16),
        (7, [1.0, 2.0]), (8, [2.0, 4.0]), (12, [1.0] * 16), (12, [1.0] * 16), (12, [-1.0] * 16), (9, [3e38] * 16), (13, [1e-42] * 16),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for c in ("node", "row", "keys", "t", "Links", "component"):
        df = df.selectExpr("*", f"'x' AS `{c}`")
    shared = Counter(i for i, _ in rows)
    # JVM and numpy agree on what a float is; the chance to miss a pair of 0.9 is a millionth.
    f4 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()]
    assert shared[12] == 4
    assert sorted(got, key=repr) == dedup_by_hand(f4)


def test_cosine_of_exactly_the_bound(spark, monkeypatch):
    """9 of 10 in whole numbers is linked, what is a little below is not."""
    monkeypatch.setattr(embedding_dedup, "MISS", 1e-9)
    rows = [(1, [1.0, 0.0, 0.0, 0.0, 0.0]), (2, [9.0, 4.0, 1.0, 1.0, 1.0]), (3, [-1.0, 0.0, 0.0, 0.0, 0.0]), (4, [-9.0, 4.0, 1.0, 1.0, 1.01])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [(got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) for i in (1, 2, 3, 4)] == [(1, 1, True), (1, 1, False), (0, 3, True), (0, 4, True)]


def test_recall_at_the_bound():
    """The planned tables find pairs of exactly the least cosine."""
    rnd = np.random.default_rng(3)
    for n in (100, 50_000, 10_000_000):
        bits, tables = embedding_dedup.plan(n)
        x = rnd.standard_normal((1500, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y = rnd.standard_normal((1500, 64))
        y -= (x * y).sum(1)[:, None] * x
        y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1)[:, None]
        planes = embedding_dedup.hyperplanes(64, bits, tables, embedding_dedup.SEED)
        same = ((x @ planes > 0) == (y @ planes > 0)).reshape(len(x), tables, bits).all(2).any(1)
        assert same.mean() > 0.99


def test_hot_keys_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BROADCAST_ROWS", 0)
    test_embedding_dedup(spark, monkeypatch)


# --- source divergence


def divergence_by_hand(rows):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    n, docs, out = defaultdict(Counter), defaultdict(Counter), []
    for _, t, lang, source in rows:
        found = term.findall(lower(t or ""))
        n[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    share = lambda c, total, v: 1 + 1_000_000_000 * (c + 2) // (total + 2 * v)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in docs:
        kept = [t for t, k in docs[lang].items() if k >= 10]
        groups = {s: c for (x, s), c in n.items() if x == lang}
        whole = sum(groups.values(), Counter())
        total = lambda c: sum(c[t] for t in kept)
        p = {s: {t: share(c[t], total(c), len(kept)) for t in kept} for s, c in groups.items()}
        q = {t: share(whole[t], total(whole), len(kept)) for t in kept}
        for s, c in groups.items():
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if c[t] and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, 10)):
                part.sort(key=lambda x: (-x[2], x[1].encode()))
                out += [(lang, s, *x, k + 1) for k, x in enumerate(part[:most])]
    return sorted(out)


def divergence_rows(seed=6):
    rnd = random.Random(seed)
    words = [rnd.choice(["", "É", "日", "Z"]) + "".join(rnd.choice("abcDE") for _ in range(3)) for _ in range(150)]
    rows = odd_rows()
    for i in range(400):
        source = rnd.choice(["s%d" % rnd.randrange(9), "s1", "s1", None, ""])
        own = words[hash(source or "") % 7 * 10 :] if rnd.random() < 0.5 else words[:30]
        rows.append((100 + i, rnd.choice([" ", "-", "1", "\x00"]).join(rnd.choices(own, k=rnd.randint(0, 60))), rnd.choice(["en", "en", "de", None]), source))
    return rows


@pytest.mark.parametrize("heavy", [0.25, 0.0, 1.0])
def test_source_divergence(spark, monkeypatch, heavy):
    """Both ways of summing, each alone and together, over several shards and blocks of groups."""
    monkeypatch.setattr(source_divergence, "HEAVY", heavy)
    monkeypatch.setattr(source_divergence, "SHARD", 100)
    monkeypatch.setattr(source_divergence, "GROUPS", 4)
    monkeypatch.setattr(source_divergence, "CELLS", 64)
    rows = divergence_rows()
    got = sorted(tuple(r) for r in source_divergence.divergence(frame(spark, rows, extra=True)).collect())
    assert got == divergence_by_hand(rows)


def test_groups_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(source_divergence, "BROADCAST_GROUPS", 0)
    rows = divergence_rows(7)
    assert sorted(tuple(r) for r in source_divergence.divergence(frame(spark, rows)).collect()) == divergence_by_hand(rows)


def test_terms_of_pieces(monkeypatch):
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice("aB é日1 ") for _ in range(rnd.randint(0, 60))).encode()
        monkeypatch.setattr(source_divergence, "PIECE", 1 << 30)
        whole = [t for terms in source_divergence.terms_of(text) for t in terms]
        monkeypatch.setattr(source_divergence, "PIECE", rnd.randint(1, 9))
        assert [t for terms in source_divergence.terms_of(text) for t in terms] == whole
