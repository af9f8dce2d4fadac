"""Source divergence audit: how far the term frequencies of sources lie apart, and which terms set a source apart.

A term's share p in a group of documents is a smoothed integer, and two shares differ by f = floor((p - q)^2 / (p + q)). The
divergence of two groups sums f over all kept terms of their language, also over those that one or both of them lack. Were all
counts zero, each of the V terms would give f of the groups' shares of an absent term, z; so the sum is V f(z, z') plus a
correction for every term that one of the two has. The corrections are split by how many groups have the term:

* **heavy** terms, in more than a quarter of the language's groups, fill dense tiles of terms by groups; whole columns are
  subtracted from whole tiles;
* **light** terms are short lists of postings. Taken one by one, a posting p gives f(p, z') - f(z, z') against any other
  group; equal postings of a group are computed once. Each pair of postings of one term then gives what the two sums miss:
  f(p, p') - f(p, z') - f(z, p') + f(z, z').

Both are integers and are added exactly. Terms are dealt to shards by hash and groups to blocks of GROUPS; a task meets one
shard of postings in one pair of blocks, so it holds a bounded number of postings, groups and sums whatever a language has.
A batch of texts counts its own terms before anything is shuffled, so a hot source or a frequent term sends few rows.

Defined cases: a null text, lang or source is ''; a group without terms has all shares of absent terms; a language without kept
terms gives pairs of value 0 and no term rows; repeated rows count twice, also as two documents of a term; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import join_bounded
from siftwell.llm.token_output import array_batches
from siftwell.llm.worker import begin
from siftwell.sources.scratch import arrow_rows, materialise, table, temporary

LEAST_DOCS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
#: Heavy terms are in more than this share of the groups of their language.
HEAVY = 0.25
#: Postings of a shard and groups of a block.
SHARD, GROUPS = 100_000, 1024
#: Cells of a dense tile or of a slice of postings by groups.
CELLS = 1 << 18
#: Distinct terms that a worker counts before it sends its counts on.
HELD = 200_000
PIECE = 1 << 20
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20
#: Tables of groups are broadcast up to this many rows; beyond it their joins shuffle.
BROADCAST_GROUPS = 200_000

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)).lower()


def terms_of(text: bytes):
    """Lists of the terms of a UTF-8 text, a piece at a time; a piece never ends inside a term."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            piece = text[at:end].translate(_LETTERS)
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):
                end += end - at
                piece = text[at:end].translate(_LETTERS)
                cut = piece.rfind(b" ")
            if end < len(text):
                piece, end = piece[:cut], at + cut + 1
        else:
            piece = text[at:end].translate(_LETTERS)
        yield piece.split()
        at = end


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(batches):
    """Occurrences and documents of each term by group; a row without a term stands for the group itself."""
    begin("divergence")
    found: dict[tuple, tuple[Counter, Counter]] = {}

    def rows():
        for (lang, source), (n, docs) in found.items():
            terms = list(n)
            for i in range(0, len(terms), 1 << 16):
                t = terms[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(t), pa.string()), pa.array([source] * len(t), pa.string()), pa.array(t, pa.binary()).cast(pa.string()), pa.array([n[x] for x in t], pa.int64()), pa.array([docs[x] for x in t], pa.int64())],
                    schema=_COUNTS,
                )
        k = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.string()), pa.array([x[1] for x in k], pa.string()), pa.nulls(len(k), pa.string()), *[pa.array([0] * len(k), pa.int64())] * 2], schema=_COUNTS)

    for b in batches:
        texts = b.column("text").cast(pa.binary())
        for i, j in array_batches(texts, BATCH_BYTES):
            for text, *group in zip(texts.slice(i, j - i).to_pylist(), *(b.column(c).slice(i, j - i).to_pylist() for c in ("lang", "source"))):
                n, docs = found.setdefault(tuple(group), (Counter(), Counter()))
                own: set[bytes] = set()
                for terms in terms_of(text):
                    n.update(terms)
                    own.update(terms)
                docs.update(own)
            if sum(len(n) for n, _ in found.values()) > HELD:
                yield from rows()
                found.clear()
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``; a null term marks that the group occurs."""
    blank = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        part = blank.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
        return materialise(part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 2) / (total + 2 terms)), exactly."""
    wide = lambda c: c.cast("decimal(28,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(count + 2), wide(total + 2 * terms)) + 1


def apart(p, q):
    return (p - q) * (p - q) // (p + q)


def apart_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Model:
    """Tables of one audit: ``groups`` (a place ``g`` in the language, the share ``z`` of an absent term), ``postings`` (shares in group and language), ``langs``."""

    def __init__(self, docs: DataFrame):
        counts = term_counts(docs)
        by_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"), F.count("*").alias("spread"))
        kept = materialise(by_term.where(F.col("docs") >= LEAST_DOCS).drop("docs"), "divergence-terms")
        postings = materialise(counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "divergence-postings")
        terms = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_n"))
        sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("lists"))
        groups = counts.where("term IS NULL").select("lang", "source").join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
        groups = groups.fillna(0, ["group_n", "lists", "terms", "lang_n"])
        z = F.when(F.col("terms") > 0, share(F.lit(0), F.col("group_n"), F.col("terms"))).otherwise(0)
        place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        self.groups = materialise(groups.withColumns({"z": z, "g": place.cast("long")}), "divergence-groups")
        self.count = self.groups.count()
        self.langs = materialise(self.groups.groupBy("lang").agg(F.count("*").alias("width"), F.sum("lists").alias("lists")), "divergence-langs")
        known = self.groups.select("lang", "source", "g", "group_n", "terms", "lang_n")
        out = join_bounded(postings, known, ["lang", "source"], "inner", self.count, BROADCAST_GROUPS)
        out = join_bounded(out, self.langs, "lang", "inner", self.count, BROADCAST_GROUPS)
        out = out.select(
            "lang",
            "source",
            "term",
            "g",
            share(F.col("n"), F.col("group_n"), F.col("terms")).alias("p"),
            share(F.col("all_n"), F.col("lang_n"), F.col("terms")).alias("q"),
            (F.col("spread") > F.col("width") * HEAVY).alias("heavy"),
            (F.floor(F.col("lists") / SHARD) + 1).alias("shards"),
            (F.floor((F.col("width") - 1) / GROUPS) + 1).alias("blocks"),
        )
        self.postings = materialise(out, "divergence-lists")


_SUMS = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("h", pa.int64()), ("part", pa.int64())])


def _dense(sums: np.ndarray, term: np.ndarray, row: np.ndarray, p: np.ndarray, z: np.ndarray, cells: int) -> None:
    """Add the corrections of heavy terms: ``row`` numbers the groups of the tile, ``term`` is sorted."""
    name, at = np.unique(term, return_inverse=True)
    step = max(1, cells // len(z))
    for i in range(0, len(name), step):
        here = (at >= i) & (at < i + step)
        tile = np.tile(z, (min(step, len(name) - i), 1))
        tile[at[here] - i, row[here]] = p[here]
        for g in range(len(z)):
            sums[g] += apart(tile[:, g : g + 1], tile).sum(0) - len(tile) * apart(z[g], z)


def _sparse(sums: np.ndarray, term: np.ndarray, row: np.ndarray, p: np.ndarray, z: np.ndarray, cells: int) -> None:
    """Add the corrections of light terms, of each posting against all groups and of the pairs of one term."""
    same, n = np.unique(np.stack([row, p]), axis=1, return_counts=True)
    step = max(1, cells // len(z))
    alone = np.zeros_like(sums)
    for i in range(0, same.shape[1], step):
        g, x, times = same[0, i : i + step], same[1, i : i + step, None], n[i : i + step, None]
        np.add.at(alone, g, times * (apart(x, z) - apart(z[g][:, None], z)))
    sums += alone + alone.T
    k = 1
    while k < len(term) and (i := np.flatnonzero(term[k:] == term[:-k])).size:
        for at in range(0, len(i), cells):
            a, b = i[at : at + cells], i[at : at + cells] + k
            g, h = row[a], row[b]
            missed = apart(p[a], p[b]) - apart(p[a], z[h]) - apart(z[g], p[b]) + apart(z[g], z[h])
            np.add.at(sums, (g, h), missed)
            np.add.at(sums, (h, g), missed)
        k += 1


def _tile_sums(width: int, cells: int):
    """Corrections of all pairs of groups, one of each block of ``width``, from one shard of terms."""

    def run(postings: pa.Table, groups: pa.Table) -> pa.Table:
        if not postings.num_rows:
            return _SUMS.empty_table()
        a, b = postings.column("a")[0].as_py(), postings.column("b")[0].as_py()
        g, z = groups.column("g").to_numpy(), groups.column("z").to_numpy()
        order = np.argsort(g)
        g, z = g[order], z[order]
        row = np.searchsorted(g, postings.column("g").to_numpy())
        p, heavy = postings.column("p").to_numpy(), postings.column("heavy").to_numpy()
        term = postings.column("term").combine_chunks().dictionary_encode()
        term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy().astype("i8")
        order = np.lexsort((row, term))
        term, row, p, heavy = term[order], row[order], p[order], heavy[order]
        sums = np.zeros((len(g), len(g)), "i8")
        _dense(sums, term[heavy], row[heavy], p[heavy], z, cells)
        _sparse(sums, term[~heavy], row[~heavy], p[~heavy], z, cells)
        block = g // width
        i, j = np.nonzero((block[:, None] == a) & (block == b) & (g[:, None] < g))
        lang = pa.array([postings.column("lang")[0].as_py()] * len(i), pa.string())
        return pa.Table.from_arrays([lang, pa.array(g[i]), pa.array(g[j]), pa.array(sums[i, j])], schema=_SUMS)

    return run


def pair_corrections(model: Model) -> DataFrame:
    """``lang, g, h, part`` (g < h): what the terms that either group has add to the sum over absent ones."""
    block, others = F.floor(F.col("g") / GROUPS), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))

    def tiled(rows: DataFrame) -> DataFrame:
        met = rows.withColumn("own", block).withColumn("other", others)
        return met.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("own", "other", "blocks")

    left = model.postings.withColumn("shard", F.pmod(F.xxhash64("term"), F.col("shards"))).drop("shards", "q", "source")
    sized = model.groups.select("lang", "g", "z").join(model.langs, "lang").withColumn("blocks", F.floor((F.col("width") - 1) / GROUPS) + 1)
    right = sized.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("lists") / SHARD)))).drop("width", "lists")
    keys = ("lang", "shard", "a", "b")
    part = tiled(left).groupBy(*keys).cogroup(tiled(right).groupBy(*keys)).applyInArrow(_tile_sums(GROUPS, CELLS), "lang string, g long, h long, part long")
    return part.groupBy("lang", "g", "h").agg(F.sum("part").alias("part"))


def pair_rows(model: Model) -> DataFrame:
    """Every other group of the language as an item, with the sum over all kept terms."""
    both = pair_corrections(model)
    both = both.select("lang", F.explode(F.array(F.struct("g", "h", "part"), F.struct(F.col("h").alias("g"), F.col("g").alias("h"), "part"))).alias("e")).select("lang", "e.*")
    one = model.groups.select("lang", "source", "g", "z", "terms")
    other = model.groups.select("lang", F.col("source").alias("item"), F.col("g").alias("h"), F.col("z").alias("y"))
    pairs = one.join(other, "lang").where("g <> h").join(both, ["lang", "g", "h"], "left")
    base = F.when(F.col("terms") > 0, F.col("terms") * apart_column(F.col("z"), F.col("y"))).otherwise(0)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (base + F.coalesce("part", F.lit(0))).cast("long").alias("value"))


def term_rows(model: Model) -> DataFrame:
    """Terms that a group uses more than its language does."""
    over = model.postings.where("p > q")
    return over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart_column(F.col("p"), F.col("q")).cast("long").alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of groups of a language, and TOP_TERMS terms of every group."""
    with temporary(docs.sparkSession) as keep:
        model = Model(docs)
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        out = pair_rows(model).withColumn("rank", rank).unionByName(term_rows(model).withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS))
        return keep(materialise(out, "divergence"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of all languages."""
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), v AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept ON kept.lang = w.lang AND kept.term = w.term GROUP BY ALL
), total AS (
  SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(total.n, 0) + 2 * v.v))::BIGINT AS p,
         (1 + 1000000000::HUGEINT * (k.n + 2) // (v.total + 2 * v.v))::BIGINT AS q
  FROM g JOIN v ON v.lang = g.lang JOIN kept AS k ON k.lang = g.lang LEFT JOIN total ON total.lang = g.lang AND total.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM s AS a JOIN s AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM s WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM r
QUALIFY part = 'pair' OR rank <= 10
"""
