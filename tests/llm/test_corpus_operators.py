"""Each operator against a brute-force version, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwell.llm import language_id, license_scan, mixing, ngram_jaccard, quality_classifier, quality_rules, repeat_removal, token_counts, token_output
from siftwell.llm.decontamination import OP2_SQL, clean_documents, contaminated, op2_decontamination
from siftwell.llm.tokens import UnitEncoder, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, lang, src, None) for i, t, lang, src in rows], DOCS)
    if extra:
        for c in ("n", "kept", "row", "spans", "gram", "size", "n_words", "threshold", "rank", "host", "count"):
            df = df.withColumn(c, F.lit("x"))
    return df


def odd_rows():
    """Rows that every operator must take."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    return [
        (None, "a text without an id that has some words in it", "en", "s1"),
        (1, None, "en", "s1"), (2, "", "en", None), (3, " \n\t ", None, "s2"), (4, "one", "en", "s2"),
        (5, "same text here and there", "en", "s1"), (5, "same text here and there", "en", "s1"),
        (6, long, "de", "s3"), (7, "日本語 ß É x\x1fy \U0001f600 ends", "fr", "s1"), (8, "**#$ %%% &|<>", "en", "s1"),
    ]


# --- quality rules


def rules_of(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    rnd = random.Random(3)
    rows = odd_rows() + [(100 + k, "".join(rnd.choice("ab \n*") for _ in range(rnd.randint(0, 200))), "en", "s1") for k in range(60)]
    got = quality_rules.quality_rules(frame(spark, rows, extra=True)).collect()
    key = lambda r: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
    assert sorted((repr(r["doc_id"]), key(r)) for r in got) == sorted((repr(i), rules_of(t)) for i, t, _, _ in rows)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)


def test_host_verdict_shrinks_small_hosts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "en", f"h{i % 20}") for i in range(400)] + [(1000 + i, "bad", "en", "junk") for i in range(50)] + [(2000, good, "en", "junk"), (3000, "bad", "en", "tiny")]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert not got[2000]["base_failed"] and not got[2000]["kept"], "a good document of a bad host goes"
    assert got[0]["kept"] and got[3000]["fails_short_rate"] < 1.0
    assert quality_rules.quality_rules(frame(spark, [])).count() == 0


# --- decontamination


def shingles(text, k=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({" ".join(w)} if w else set())


def test_contaminated_against_brute_force(spark):
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(300)]
    items = [(k, " ".join(rnd.choices(vocab, k=rnd.randint(5, 40)))) for k in range(30)] + [(50, None), (51, ""), (52, "w0 w1"), (None, "one"), (0, "repeat of an item id with other words")]
    rows = odd_rows()
    for k in range(80):
        w = rnd.choices(vocab, k=rnd.randint(0, 200))
        item = (rnd.choice(items[:30])[1]).split()
        for _ in range(rnd.randint(0, 3)):
            item[rnd.randrange(len(item))] = "changed"
        at = rnd.randint(0, len(w))
        rows.append((100 + k, ", ".join(w[:at] + item + w[at:]).upper() if k % 3 else " ".join(w), "en", "s"))
    docs, bench = frame(spark, rows, extra=True), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t, _, _ in rows:
        for j, x in items:
            s, n = shingles(x), len(re.findall(r"[^\W_]+", (x or "").lower()))
            if s and len(s & (shingles(t) | (shingles(t, n) if n < 5 else set()))) >= -(-4 * len(s) // 5):
                want.add((i, j))
    got = [(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    left = clean_documents(docs, bench)
    assert left.columns == docs.columns
    assert sorted(repr(r[0]) for r in left.select("doc_id").collect()) == sorted(repr(i) for i, *_ in rows if i not in {w for w, _ in want})
    assert contaminated(docs, bench.limit(0)).count() == 0 and contaminated(docs.limit(0), bench).count() == 0


def test_short_items_inside_long_texts(spark, tmp_path):
    """Items of one to four words, in the query as in its SQL."""
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(15)
    vocab = [f"v{i}" for i in range(60)]
    rows = [r for r in odd_rows() if r[0] not in (None, 6)]  # the SQL engine copies a text's words for each of them: no long text
    rows += [(100 + k, " ".join(rnd.choices(vocab, k=rnd.randint(0, 60))), "en", "s") for k in range(60)]
    rows += [(200, "what is a quantum flux capacitor used for in films", "en", "s"), (201, "quantum flux", "en", "s")]
    items = [(k, " ".join(rnd.choices(vocab, k=1 + k % 7))) for k in range(21)] + [(50, "Quantum-flux capacitor"), (51, None), (52, "flux flux flux")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in op2_decontamination(spark, str(tmp_path)).select("doc_id", "item_id", "n_shingles", "n_shared", "containment").collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == set(con.execute(OP2_SQL).fetchall()) and {i for d, i, *_ in got if d == 200} == {50}


# --- n-gram Jaccard join


def jaccard_classes(rows, k=4, t=(85, 100)):
    sets = []
    for i, text, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(text or "")]
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and t[1] * len(sets[a] & sets[b]) >= t[0] * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for a, (i, *_) in enumerate(rows):
        least[root(a)].append(i)
    return sorted((repr(i), len(s), repr(min((x for x in least[root(a)] if x is not None), default=None) if s else i)) for a, ((i, *_), s) in enumerate(zip(rows, sets)))


def near_rows(seed, n=140):
    """Families of copies with edits upon edits, so that links chain."""
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(5000)]
    shared = rnd.choices(vocab, k=40)
    rows, made = [], []
    for k in range(n):
        if made and rnd.random() < 0.8:
            w = list(rnd.choice(made))
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(vocab)
        else:
            w = rnd.choices(vocab, k=rnd.randint(1, 150)) + (shared if rnd.random() < 0.5 else [])
        made.append(w)
        rows.append((1000 - k, " ".join(w), "en", "s"))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_components(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_jaccard, "TILE", 16)
    rows = near_rows(seed) + odd_rows()
    got = ngram_jaccard.jaccard_components(frame(spark, rows, extra=True)).collect()
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == jaccard_classes(rows)


def test_jaccard_threshold_and_one_of_each(spark):
    rows = near_rows(7, 80) + [(5, "same text here and there", "en", "s1")] * 2 + [(4000, None, "en", "s"), (4001, "", "en", "s")]
    df = frame(spark, rows, extra=True)
    got = ngram_jaccard.jaccard_components(df, 5, (80, 100)).collect()
    want = jaccard_classes(rows, 5, (80, 100))
    assert sorted((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in got) == want
    left = ngram_jaccard.one_of_each(df, 5, (80, 100))
    assert left.columns == df.columns
    assert sorted(repr(r[0]) for r in left.select("doc_id").collect()) == sorted({c for _, _, c in want})
    assert ngram_jaccard.jaccard_components(df.limit(0)).count() == 0


def test_tiles_give_a_forest_of_all_links():
    rnd = random.Random(9)
    sets = [np.unique(np.asarray(rnd.choices(range(60), k=40))) for _ in range(50)]
    rows = [(k % 2, bytes([k]), bytes([k]), len(s), s) for k, s in enumerate(sets)]
    for crossed in (False, True):
        pairs = [(a, b) for a in range(50) for b in range(a) if (not crossed or a % 2 != b % 2) and 2 * len(np.intersect1d(sets[a], sets[b])) >= len(np.union1d(sets[a], sets[b]))]
        links = ngram_jaccard.forest(rows, crossed, (1, 2))

        def classes(edges):
            p = list(range(50))
            for a, b in edges:
                ra, rb = p[a], p[b]
                p = [min(ra, rb) if x in (ra, rb) else x for x in p]
            return p

        assert classes([(a[0], b[0]) for a, b in links]) == classes(pairs) and len(links) < 50


# --- language identification


def test_language_profiles(spark):
    rnd = random.Random(2)
    alpha = {"aa": "abcde", "bb": "defgh", "cc": "ßéüñx"}
    text = lambda a: " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(1, 8))) for _ in range(60))
    rows = [(100 + i, text(a), lang, "s") for i in range(60) for lang, a in [rnd.choice(list(alpha.items()))]] + odd_rows()
    df = frame(spark, rows, extra=True)
    grams = {}
    for lang in {x[2] for x in rows if x[2]}:
        c = Counter()
        for i, t, own, _ in rows:
            if own == lang and t is not None:
                s = "".join(ch if ch.isalpha() else " " for ch in t.lower())
                for w in s.split():
                    p = f" {w} "
                    c.update(w)
                    c.update(p[k : k + 2] for k in range(len(p) - 1))
                    c.update(p[k : k + 3] for k in range(len(p) - 2))
                # trigrams over a blank between two words
                ws = s.split()
                c.update(a[-1] + " " + b[0] for a, b in zip(ws, ws[1:]))
        code = lambda g: sum(ord(ch) << 21 * (len(g) - 1 - k) for k, ch in enumerate(g))
        grams[lang] = [code(g) for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:300]]
    learned = language_id.learn_profiles(df)
    assert {k: v.tolist() for k, v in learned.items()} == grams
    got = {r["doc_id"]: r for r in language_id.predict_language(df, learned).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, _ in rows[:60])
    assert (got[1]["lang_pred"], got[2]["lang_pred"], got[8]["lang_pred"]) == ("und",) * 3 and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.predict_language(df, {}).where("lang_pred <> 'und'").count() == 0 and language_id.learn_profiles(df.limit(0)) == {}


def test_language_chunks_agree(monkeypatch):
    codes = language_id.letter_codes("some words, and some more words " * 40)
    whole = language_id.gram_counts(codes)
    monkeypatch.setattr(language_id, "CHUNK", 64)
    parts = language_id.gram_counts(codes)
    assert all((a == b).all() for a, b in zip(whole, parts))


# --- tokens


def random_text(rnd):
    return "".join(rnd.choice("ab é,.'\n\t   1$|<>ß中\r日s  \x1f") for _ in range(rnd.randint(0, 40)))


def test_unit_encoder_equals_the_library():
    rnd = random.Random(1)
    ids, spans = UnitEncoder(tokenizer_path(), memo=50), UnitEncoder(tokenizer_path(), memo=50)
    for _ in range(60):
        texts = [random_text(rnd) for _ in range(20)] + ["plain words, and more.\nNext line", ""]
        want = ids.tokenizer.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, "<i4").tolist() for x in ids.encode(texts)] == [e.ids for e in want]
        assert [list(zip(a.tolist(), b.tolist())) for a, b in spans.encode_spans(texts)] == [[tuple(o) for o in e.offsets] for e in want]


def test_token_files_round_trip(spark, tmp_path):
    rows = odd_rows()
    df = frame(spark, rows, extra=True)
    token_output.write_token_files(df, str(tmp_path / "t"), tokenizer_path(), metadata=("doc_id", "lang"))
    files = token_output.read_token_files(spark, str(tmp_path / "t"))
    got = sorted(files.collect(), key=lambda r: r["start"])
    enc = UnitEncoder(tokenizer_path()).tokenizer
    assert [r["doc_id"] for r in got] == sorted((i for i, *_ in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        at += len(r["ids"])
    want = sorted(tuple([*enc.encode(t or "", add_special_tokens=False).ids, 2]) for _, t, *_ in rows)
    assert sorted(tuple(r["ids"]) for r in got) == want
    digests = token_output.id_digests(files).collect()
    assert sorted(r["ids_crc32"] for r in digests) == sorted(zlib.crc32(np.asarray(x, "<u4").tobytes()) for x in want)
    plan = files.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split(">")[0], "metadata is read without the ids"
    assert token_output.token_output(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_output.write_token_files(df, str(tmp_path / "u"), tokenizer_path(), metadata=("doc_id", "text"))


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    rows = odd_rows() + [(20, "a\n\n\nb  c\n", "en", "s"), (21, "中文字\n日本", "en", "s")]
    got = defaultdict(list)
    for r in token_counts.token_counts(frame(spark, rows, extra=True), rule=rule).collect():
        got[r["doc_id"]].append((r["section"], r["start"], r["end"], r["n_tokens"]))
    enc = UnitEncoder(tokenizer_path()).tokenizer
    for i, t, *_ in rows:
        if t is None:
            assert i not in got
            continue
        lines, at = [], 0
        for part in re.split(r"(?<=\n)(?=.)", t, flags=re.S) if t else [""]:
            lines.append((at, at + len(part)))
            at += len(part)
        n = [0] * len(lines)
        for a, b in enc.encode(t, add_special_tokens=False).offsets:
            shared = [min(b, e) - max(a, s) for s, e in lines]
            if rule == "largest":
                k = shared.index(max(shared))
            else:
                p = a if rule == "first" else max(b - 1, a)
                k = next(k for k, (s, e) in enumerate(lines) if s <= p < e)
            n[k] += 1
        copies = sum(r[0] == i for r in rows)
        assert sorted(got[i]) == sorted([(k, s, e, c) for k, ((s, e), c) in enumerate(zip(lines, n))] * copies), (i, rule)


def test_token_counts_of_given_sections(spark):
    df = spark.createDataFrame([(1, "one two three four", [(0, 5), (9, 18)])], "doc_id long, text string, sections array<struct<start:int,end:int>>")
    got = {r["section"]: r["n_tokens"] for r in token_counts.token_counts(df, rule="first", sections=True).collect()}
    assert got == {-1: 1, 0: 2, 1: 1}


# --- mixing


def test_targets_fill_by_weight(spark):
    rows = [(i, "w " * n, "en", s) for i, (s, n) in enumerate([("a", 10), ("b", 200), ("c", 50), (None, 400), ("é", 1), ("z", 0)])]
    docs = frame(spark, rows, extra=True)
    got = {r["source"]: (r["source_size"], r["weight"], r["target"]) for r in mixing.source_targets(docs.select("source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    sizes = {s: n for _, t, _, s in rows for n in [len((t or "").split())]}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3 * sizes[s]
        left -= sum(target[s] for s in full)
        open_ -= full
    target |= {s: weights[s] * level for s in open_}
    assert {s: (sizes[s], weights[s], pytest.approx(target[s])) for s in order} == got


def test_mix_emits_copies_near_the_target(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(1, 30), "en", rnd.choice(["a", "b", "c", "c", "c", "c"])) for i in range(3000)] + [(None, None, "en", None), (3, "w w", "en", "a"), (3, "w w", "en", "a")]
    docs = frame(spark, rows, extra=True)
    m = mixing.mix(docs).collect()
    assert m == mixing.mix(docs).collect() and len(m) == len(rows) and all(r["mix_copies"] <= 3 for r in m)
    taken, target = Counter(), {}
    for r in m:
        taken[r["source"]] += r["mix_size"] * r["mix_copies"]
        target[r["source"]] = r["mix_target"]
    assert all(abs(taken[s] - t) <= 0.06 * t + 60 for s, t in target.items())
    out = mixing.emit_copies(mixing.mix(docs))
    assert out.columns == docs.columns and out.count() == sum(r["mix_copies"] for r in m)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- licence scan


def test_license_scan(spark):
    rows = odd_rows() + [
        (30, "Some words.\nReleased under the MIT License.\nMore.", "en", "s"),
        (31, "LICENSED under the apache license version 2.0", "en", "s"),
        (32, "This work is licensed under nothing at all that anyone has ever heard of", "en", "s"),
        (33, license_scan.TEMPLATES["MIT-text"].replace(" ", "\n"), "en", "s"),
    ]
    got = {(r["doc_id"], r["license_id"]): r["dice"] for r in license_scan.license_scan(frame(spark, rows, extra=True)).collect()}

    def bigrams(t):
        w = re.findall(r"[^\W_]+", t.lower())
        return set(zip(w, w[1:]))

    want = {}
    for i, t, *_ in rows:
        for unit in [*(t or "").split("\n"), t or ""]:
            a = bigrams(unit)
            for name, x in license_scan.TEMPLATES.items():
                b = bigrams(x)
                d = 2 * len(a & b) / (len(a) + len(b)) if a else 0
                if d >= 0.8:
                    want[i, name] = max(d, want.get((i, name), 0))
    assert got == pytest.approx(want, abs=1e-6) and (30, "MIT-notice") in got and (33, "MIT-text") in got and not any(i == 32 for i, _ in got)
    assert license_scan.license_scan(frame(spark, [])).count() == 0


def test_license_windows(spark):
    """Licences across line ends, in a line, and in a longer text, against all windows by brute force."""
    rnd = random.Random(4)
    prose = lambda k: " ".join(rnd.choices("the of this a software work is and licensed under book chapter free any".split(), k=k))
    lines, copyright = "\n".join(textwrap.wrap(license_scan.TEMPLATES["MIT-text"], 78)), "MIT License\n\nCopyright (c) 2020 Some One\n\n"
    rows = [
        (40, prose(50) + "\n" + lines + "\n" + prose(40), "en", "s"),
        (41, copyright + lines + "\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "en", "s"),
        (42, "The second edition of this book was released under the MIT License.", "en", "s"),
        (43, prose(30) + " Licensed under CC \n -- \n BY-NC 4.0. " + prose(30), "en", "s"),
        (44, prose(30) + " free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation, either version 3 of the License, or any later " + prose(30), "en", "s"),
        *[(50 + i, prose(150), "en", "s") for i in range(5)],
    ]
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    pairs = lambda t: list(zip(words(t), words(t)[1:]))
    want = {}
    for i, text, *_ in rows:
        g = pairs(text)
        for name, x in license_scan.TEMPLATES.items():
            b, longest = set(pairs(x)), len(pairs(x)) * 3 // 2
            best = max(2 * len(set(g[p:q]) & b) / (len(set(g[p:q])) + len(b)) for p in range(len(g)) for q in range(p + 1, min(len(g), p + longest) + 1))
            if best >= 0.8:
                want[i, name] = best
    assert {(40, "MIT-text"), (41, "MIT-text"), (42, "MIT-notice"), (43, "CC-BY-NC-4.0-notice"), (44, "GPL-3.0-header")} <= set(want)
    got = {(r["doc_id"], r["license_id"]): r["dice"] for r in license_scan.license_scan(frame(spark, rows)).collect()}
    assert got == pytest.approx(want, abs=1e-6)


# --- repeated strings


def repeats(rows, length, first):
    place = defaultdict(list)
    texts = [(t or "").encode() for _, t, *_ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for rank, k in enumerate(order):
        for p in range(len(texts[k]) - length + 1):
            place[texts[k][p : p + length]].append((rank, p, k))
    mask = [bytearray(len(t)) for t in texts]
    for found in place.values():
        if len(found) > 1:
            for _, p, k in sorted(found)[1 if first else 0 :]:
                mask[k][p : p + length] = b"\x01" * length
    out = []
    for (i, *_), t, m in zip(rows, texts, mask):
        kept = bytes(c for c, x in zip(t, m) if not x)
        out.append((repr(i), len(t), sum(m), len(re.findall(b"\x01+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("length", [70, 400])
def test_repeats_against_brute_force(spark, first, length):
    rnd = random.Random(length)
    passages = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(60, 900))) for _ in range(6)]
    rows = [(None, passages[0], "en", "s"), (0, None, "en", "s"), (1, "", "en", "s"), (2, "x" * 1500, "en", "s"), (3, "ab" * 700 + "q", "en", "s"), (4, "ab" * 900, "en", "s")]
    for k in range(40):
        parts = [rnd.choice(passages)[rnd.choice([0, 0, 7]) :] if rnd.random() < 0.5 else "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(0, 300))) for _ in range(rnd.randint(0, 5))]
        rows.append((10 + k, "".join(parts), "en", "s"))
    rows.append((99, "".join(rnd.choice("abcdefgh ") for _ in range(9000)) + passages[1], "en", "s"))
    rows += [rows[12], rows[0], rows[0]]  # repeated rows are copies of each other
    got = repeat_removal.remove_repeats(frame(spark, rows, extra=True), length, keep_first=first, segment=1 << 12).collect()
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == repeats(rows, length, first)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_texts_made_to_collide(spark):
    """Thue-Morse strings share any polynomial hash modulo a power of two; no byte of these texts is repeated."""
    rnd = random.Random(1)
    morse = [bin(k).count("1") % 2 for k in range(256)]
    t, u = "".join("EJ"[x] for x in morse), "".join("JE"[x] for x in morse)
    m = "".join(rnd.choice("abcdefgh") for _ in range(256))
    for first in (True, False):
        got = repeat_removal.remove_repeats(frame(spark, [(1, t + m + u, "en", "s"), (2, u + m + t, "en", "s")]), 400, keep_first=first).collect()
        assert [r["n_removed"] for r in got] == [0, 0]


def test_repeats_of_nothing(spark):
    assert repeat_removal.remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        repeat_removal.remove_repeats(frame(spark, []), 10)


# --- quality classifier


def kneser_ney_reference(texts):
    """Interpolated modified Kneser-Ney over word trigrams with two leading marks, as plain dictionaries."""
    tri = Counter()
    for t in texts:
        w = ["", "", *WORD.findall(t)]
        tri.update(zip(w, w[1:], w[2:]))
    bi = Counter((b, c) for _, b, c in tri)
    uni = Counter(c for _, c in bi)

    def order(counts, context):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = {k: max(k - (k + 1) * y * n[k + 1] / n[k], 0.0) if n[k] and n[1] else 0.5 for k in (1, 2, 3)}
        total, back = Counter(), Counter()
        for g, c in counts.items():
            total[context(g)] += c
            back[context(g)] += d[min(c, 3)]
        return {g: (c - d[min(c, 3)]) / total[context(g)] for g, c in counts.items()}, {x: back[x] / total[x] for x in total}

    (s1, g1), (s2, g2), (s3, g3) = order(uni, lambda g: ""), order(bi, lambda g: g[0]), order(tri, lambda g: g[:2])
    even = g1[""] / (len(uni) + 1)
    p1 = lambda c: s1.get(c, 0) + even
    p2 = lambda b, c: s2.get((b, c), 0) + g2.get(b, 1) * p1(c)
    p3 = lambda a, b, c: s3.get((a, b, c), 0) + g3.get((a, b), 1) * p2(b, c)

    def log_likelihood(text):
        w = ["", "", *WORD.findall(text)]
        return sum(np.log(p3(*x)) for x in zip(w, w[1:], w[2:]))

    return log_likelihood


def test_classifier_keeps_clean_documents(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(3, 80))), "en", "s") for i in range(100, 400)]
    rows += [(1000 + i, " ".join("".join(rnd.choice("$%#&") for _ in range(6)) for _ in range(60)), "en", "s") for i in range(20)] + odd_rows()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100, 350)] + [(i, 1, 1) for i in range(350, 360)] + [(None, 1, 0)], "doc_id long, quality long, toxic long")
    df = frame(spark, rows, extra=True)
    got = quality_classifier.classify(df, labels).collect()
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r["_kept"] for r in got}
    assert sum(kept[i] for i in range(100, 400)) >= 298 and not any(kept[1000 + i] for i in range(20))
    assert not kept[1] and not kept[2]
    out = quality_classifier.keep_good(df, labels)
    assert out.columns == df.columns and out.count() == sum(r["_kept"] for r in got)
    assert quality_classifier.keep_good(df.limit(0), labels).count() == 0
    plain = frame(spark, rows)
    assert quality_classifier.keep_good(plain, labels.limit(0)).count() == sum(1 for _, t, *_ in rows if WORD.search(t or ""))


def test_trusted_text_is_used_whole(spark):
    """More trusted words than any cap of a sample, one text of 250,000 words among them."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choices(words, k=20)), "en", "s") for i in range(1700)]
    rows += [(2000, " ".join(rnd.choices(words, k=250_000)), "de", "s")] + [(2001 + i, " ".join(rnd.choices(words, k=30)), "de", "s") for i in range(30)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality long, toxic long")
    got = quality_classifier.trusted_text(frame(spark, rows), labels).groupBy("model_lang").agg(F.sum("n"), F.count("*"), F.sum(F.col("held_out").cast("int"))).collect()
    got = {r[0]: tuple(r[1:]) for r in got}
    assert got["en"][:2] == (1700 * 20, 1700) and got["de"][:2] == (250_000 + 30 * 30, 31)
    assert 250 < got["en"][2] < 430 and 1 <= got["de"][2] < 20


@pytest.mark.parametrize("shard_words", [50, 1_000_000])
def test_sharded_scores_against_plain_dictionaries(spark, monkeypatch, shard_words):
    """Words are dealt to one shard and to several; copies of a text and a language without a model."""
    monkeypatch.setattr(quality_classifier, "SHARD_WORDS", shard_words)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(words, weights=range(1, 41), k=rnd.randint(1, 60))) for _ in range(60)]
    train = spark.createDataFrame([(lang, t) for lang in ("en", "*") for t in texts], "model_lang string, text string")
    want = kneser_ney_reference(texts)
    probe = [*texts[:10], texts[0], "w1 unknown w2 w3", "unknown", "w39 w39 w39 w38", ""]
    docs = spark.createDataFrame([(lang, t) for lang in ("en", "xx") for t in probe], "lang string, text string")
    got = docs.withColumn("text_key", quality_classifier.text_key()).join(quality_classifier.likelihoods(docs, train), "text_key").collect()
    assert len(got) == 2 * (len(probe) - 1)
    assert [r["mean_log"] * len(r["text"].split()) for r in got] == pytest.approx([want(r["text"]) for r in got], rel=1e-4)


@pytest.mark.parametrize("vocabulary", [0, 12])
@pytest.mark.parametrize("shard_words", [50, 1_000_000])
def test_words_beyond_the_broadcast_vocabulary(spark, monkeypatch, vocabulary, shard_words):
    """Most words, or all, are looked up in shards, frequent ones of the documents before: the same model as with all words broadcast."""
    monkeypatch.setattr(quality_classifier, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(quality_classifier, "VOCABULARY", vocabulary)
    monkeypatch.setattr(quality_classifier, "SENT_ON", 40, raising=False)
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    texts = {lang: [" ".join(rnd.choices(words, weights=range(1, 41), k=rnd.randint(1, 60))) for _ in range(60)] for lang in ("en", "de")}
    texts["*"] = texts["en"] + texts["de"]
    train = spark.createDataFrame([(lang, t) for lang in texts for t in texts[lang]], "model_lang string, text string")
    want = {lang: kneser_ney_reference(t) for lang, t in texts.items()}
    probe = [*texts["en"][:10], *texts["de"][:10], texts["en"][0], "w1 unknown w2 w3", "unknown", "w39 w39 w39 w38", "unknown stranger " * 300, "w5 w0 " * 300, ""]
    docs = spark.createDataFrame([(lang, t) for lang in ("en", "de", "xx") for t in probe], "lang string, text string")
    got = docs.withColumn("text_key", quality_classifier.text_key()).join(quality_classifier.likelihoods(docs, train), "text_key").collect()
    assert len(got) == 3 * (len(probe) - 1)
    assert [r["mean_log"] * len(r["text"].split()) for r in got] == pytest.approx([want.get(r["lang"], want["*"])(r["text"]) for r in got], rel=1e-4)


def test_words_are_hashed_side_by_side(monkeypatch):
    """A slice takes one call for its language, not one for each of its words; equal words have equal numbers, others differ."""
    calls = []
    plain = quality_classifier._hash
    monkeypatch.setattr(quality_classifier, "_hash", lambda word: calls.append(word) or plain(word))
    rnd = random.Random(5)
    words = ["".join(rnd.choice("ab\x00\x0eé日") for _ in range(rnd.choice([1, 2, 3, 7, 8, 9, 16, 17, 33, 63, 64, 65, 200]))) for _ in range(3000)]
    texts = ["", " ", "\t\n", *(rnd.choice(["", " "]) + "".join(w + rnd.choice([" ", "\n ", "\x0b", "\r\t"]) for w in rnd.choices(words, k=rnd.randint(1, 90))) for _ in range(300)), "x", "y"]
    texts = [t.rstrip() if k % 2 else t for k, t in enumerate(texts)]
    found = [WORD.findall(t) for t in texts]
    b = pa.RecordBatch.from_pydict({"text": pa.array(["cut off", *texts]).slice(1), "lang": pa.array(["en"] * len(texts))})
    counts = pa.Table.from_batches([*quality_classifier._word_counts([b])])
    assert len(calls) == 1 and sorted(counts["n"].to_pylist()) == sorted(Counter(w for t in found for w in t).values())
    keys, n = quality_classifier._word_keys("en", b.column("text"))
    assert n.tolist() == [len(t) for t in found]
    of = dict(zip((w for t in found for w in t), keys.tolist()))
    assert [of[w] for t in found for w in t] == keys.tolist() and len(set(of.values())) == len(of)


@pytest.mark.parametrize("size", [0, 1, 2, 1000])
def test_index_of_hashes(size):
    rng = np.random.default_rng(size)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, size, "u8"), rng.integers(0, 50, size, "u8"), np.asarray([(1 << 64) - 1] * (size > 1), "u8")]))
    rng.shuffle(keys)
    some = dict(zip(keys[: len(keys) // 2].tolist(), range(len(keys))))
    found = quality_classifier.Index(np.asarray([*some], "u8"), np.asarray([*some.values()], "i8"), -1).find(keys)
    assert found.tolist() == [some.get(k, -1) for k in keys.tolist()]


@pytest.mark.parametrize("bits", [20, 22, 64])
def test_keys_of_table_and_lookup_agree(bits):
    """A lookup of small numbers in a table with large ones: a vocabulary of 2 to 4 million words had other keys for these."""
    b, a, c = (np.asarray(x) for x in ([5, (1 << 22) - 1], [7, 8], [9, 10]))
    table, asked = quality_classifier._keys(bits, b, a, c), quality_classifier._keys(bits, b[:1], a[:1], c[:1])
    assert table[0] == asked[0]


def test_pooled_model_learns_all_trusted_text(spark):
    """Few trusted texts, and documents of a language without any: clean ones stay."""
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(30)]
    rows = [(i, " ".join(rnd.choices(words, k=60)), "en", "s") for i in range(8)] + [(100 + i, " ".join(rnd.choices(words, k=60)), "xx", "s") for i in range(10)]
    rows += [(200, " ".join(f"$#{i}" for i in range(60)), "xx", "s")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(8)], "doc_id long, quality long, toxic long")
    kept = {r["doc_id"]: r["kept"] for r in quality_classifier.classify(frame(spark, rows), labels).collect()}
    assert all(kept[100 + i] for i in range(10)) and not kept[200]
