"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Every vector gets, in each of T tables, the signs of its products with B random hyperplanes as a key. B grows with the logarithm of
the number of vectors, so that a key of unrelated vectors holds about BUCKET of them; T is the least number of tables that
miss a pair of exactly the least cosine with a probability of at most MISS (nearer pairs are missed far less often). Vectors that share a
key meet in a worker, which multiplies them in tiles of bounded size and keeps what has the least cosine in double precision, so
nothing below it is ever linked. A pair counts in the first table in which it shares a key, so links are counted once. A
worker sends one row a vector: its number of links there, and the root of its class in a spanning forest of the links; pairs
are never sent. Components of the roots follow.

Equal vectors are one node with a number of copies from the start. A key with more than TILE vectors is cut into blocks, of which
each pair is a task of its own. Tables are shuffled a few at a time, and each round is a written table.

Defined cases: a vector that is null, empty or zero, or holds a null, a NaN or an infinity, links with nothing and is its own
component; so do vectors of different length; a row without vec_id links with nothing and has neither component nor mark;
rows that share a vec_id are vectors of their own, and ``kept`` is true for each of them that has the smallest id of its
component; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import join_bounded
from siftwell.llm.worker import begin
from siftwell.operators.graph import connected_components
from siftwell.sources.scratch import arrow_rows, materialise, table, temporary

LEAST = 0.9
SEED = 12
#: Unrelated vectors of one key, and the chance to miss a pair of exactly the least cosine.
BUCKET, MISS = 512, 0.002
#: Vectors of a block of a large key, of a task, and of a side of one product.
TILE, SHARD, SIDE = 4096, 8192, 1024
#: Tables that are shuffled at once.
TABLES = 4
#: Repeated vectors and large keys are broadcast up to this many rows (some 40 bytes each); beyond it the joins shuffle.
BROADCAST_ROWS = 500_000
BATCH_ROWS = 4096


def plan(vectors: int, least: float = LEAST, miss: float = MISS) -> tuple[int, int]:
    """Bits of a key and number of tables for so many vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(vectors, 1) / BUCKET)))) if vectors > BUCKET else 4
    met = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-met))


def hyperplanes(width: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, width])).standard_normal((width, bits * tables))


def rows_of(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, scaled by a power of two so that no product overflows; None for those that link with nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    valid, ends = column.is_valid().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype("f8")
    out: list[np.ndarray | None] = []
    for k, known in enumerate(valid):
        v = flat[ends[k] : ends[k + 1]] if known else flat[:0]
        most = np.abs(v).max(initial=0.0)
        out.append(np.ldexp(v, -int(np.frexp(most)[1])) if 0 < most < np.inf else None)  # a NaN fails the comparison
    return out


def _stacked(column: pa.Array):
    """For each length of vectors: the places of its rows, and their matrix."""
    by_width: dict[int, list[int]] = {}
    rows = rows_of(column)
    for k, v in enumerate(rows):
        if v is not None:
            by_width.setdefault(len(v), []).append(k)
    for width, at in by_width.items():
        yield width, np.asarray(at), np.stack([rows[k] for k in at])


def _signed(bits: int, tables: int, seed: int):
    def run(batches):
        kept = begin("hyperplanes")
        for b in batches:
            n, v = b.num_rows, b.column("embedding")
            keys, digests = [None] * n, [None] * n
            for width, at, x in _stacked(v):
                if (width, bits, tables, seed) not in kept:
                    kept[width, bits, tables, seed] = hyperplanes(width, bits, tables, seed)
                side = (x @ kept[width, bits, tables, seed] > 0).reshape(len(x), tables, bits)
                key = side @ (1 << np.arange(bits))
                for k, row, own in zip(at, key.astype("i4"), x):
                    keys[k], digests[k] = row, hashlib.blake2b((own + 0.0).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), v, pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int32()))], ["vec_id", "embedding", "digest", "keys"])

    return run


def _roots(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of all pairs (i, j); a label is the smallest place of its class."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _linked(x: np.ndarray, keys: np.ndarray, copies: np.ndarray, block: np.ndarray, t: int, cross: bool, least: float, side: int):
    """Links to others (their copies counted) and the place of the root, for each row of one key of table ``t``.

    ``cross``: the rows are of two blocks, of which only pairs across count.
    """
    size = np.sqrt(np.einsum("ij,ij->i", x, x))
    links, label = np.zeros(len(x), "i8"), np.arange(len(x))
    for i in range(0, len(x), side):
        for j in range(i, len(x), side):
            hit = x[i : i + side] @ x[j : j + side].T / (size[i : i + side, None] * size[j : j + side]) >= least
            if i == j:
                hit &= np.tri(*hit.shape, -1, dtype=bool).T
            if cross:
                hit &= block[i : i + side, None] != block[j : j + side]
            if not hit.any():
                continue
            for u in range(t):
                hit &= keys[i : i + side, u, None] != keys[j : j + side, u]
            a, b = np.nonzero(hit)
            links[i : i + side] += hit @ copies[j : j + side]
            links[j : j + side] += copies[i : i + side] @ hit
            _roots(label, a + i, b + j)
    return links, label


_LINKS = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def _verified(least: float, side: int):
    def run(rows: pa.Table) -> pa.Table:
        begin("cosine")
        t, key, a, b, block, node, copies = (rows.column(c).to_numpy() for c in ("t", "key", "a", "b", "block", "node", "copies"))
        out = [_LINKS.empty_table()]
        flat = rows.column("keys").combine_chunks()
        keys = flat.flatten().to_numpy().reshape(len(node), -1) if len(node) else np.zeros((0, 0), "i4")
        for _, at, x in _stacked(rows.column("embedding")):
            order = np.lexsort((node[at], b[at], a[at], key[at], t[at]))
            at, x = at[order], x[order]
            name = np.stack([t[at], key[at], a[at], b[at]])
            cuts = np.flatnonzero((name[:, 1:] != name[:, :-1]).any(0)) + 1
            for i, j in zip([0, *cuts], [*cuts, len(at)]):
                k = at[i:j]
                links, label = _linked(x[i:j], keys[k], copies[k], block[k], int(t[k[0]]), bool(a[k[0]] != b[k[0]]), least, side)
                met = np.flatnonzero(links)
                out.append(pa.Table.from_arrays([pa.array(node[k[met]]), pa.array(links[met]), pa.array(node[k[label[met]]])], schema=_LINKS))
        return pa.concat_tables(out).combine_chunks()

    return run


def near_links(vectors: DataFrame, tables: int, least: float = LEAST) -> DataFrame:
    """``node, links, root``: parts of the links of ``vectors`` (``node, copies, embedding, keys``), a row a node and key with links."""
    spark = vectors.sparkSession
    # Vectors of different length may share a key; they meet in a worker, which parts them.
    of_key = lambda part: part.select("*", F.explode("at").alias("e")).select("*", "e.t", "e.key").drop("at", "e")
    parts = []
    for first in range(0, tables, TABLES):
        places = F.array(*[F.struct(F.lit(t).alias("t"), F.col("keys")[t].alias("key")) for t in range(first, min(first + TABLES, tables))])
        large = of_key(vectors.select(places.alias("at"))).groupBy("t", "key").count().where(F.col("count") > TILE)
        large = materialise(large.select("t", "key", F.ceil(F.col("count") / TILE).cast("int").alias("blocks")), "dedup-keys")
        rows = join_bounded(of_key(vectors.withColumn("at", places)), large, ["t", "key"], "left", large.count(), BROADCAST_ROWS)
        rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
        shards = max(1, vectors.count() * min(TABLES, tables - first) // SHARD, 2 * spark.sparkContext.defaultParallelism)
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("t", "key", "a", "b"), F.lit(shards)))
        found = rows.select("shard", "t", "key", "a", "b", "block", "node", "copies", "keys", "embedding").groupBy("shard").applyInArrow(_verified(least, SIDE), "node long, links long, root long")
        parts.append(materialise(found, "dedup-links"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def near_duplicates(embeddings: DataFrame, least: float = LEAST, seed: int = SEED) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``embeddings`` (``vec_id, embedding``)."""
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "embedding")
    bits, tables = plan(rows.count(), least)
    kind = dict(rows.dtypes)["embedding"]
    with temporary(spark) as keep:
        with arrow_rows(spark, BATCH_ROWS):
            signed = rows.mapInArrow(_signed(bits, tables, seed), f"vec_id long, embedding {kind}, digest binary, keys array<int>")
            signed = materialise(signed.withColumn("row", F.monotonically_increasing_id()), "dedup-signed")
        usable = signed.where("vec_id IS NOT NULL AND digest IS NOT NULL")
        twice = usable.groupBy("digest").agg(F.min("row").alias("node"), F.min("vec_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
        twice = materialise(twice, "dedup-copies")
        known = join_bounded(usable, twice, "digest", "left", twice.count(), BROADCAST_ROWS)
        known = known.select("vec_id", "row", "embedding", "keys", F.coalesce("node", "row").alias("node"), F.coalesce("first", "vec_id").alias("first"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"))
        vectors = materialise(known.where("row = node").drop("row", "vec_id"), "dedup-vectors")
        links = near_links(vectors, tables, least)
        sums = links.groupBy("node").agg(F.sum("links").alias("links"))
        classes = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
        firsts = vectors.select("node", "first").join(classes, "node")
        smallest = firsts.groupBy("component").agg(F.min("first").alias("smallest"))
        of_node = sums.join(classes, "node", "left").join(smallest, "component", "left").select("node", "links", "smallest")
        of_node = materialise(of_node, "dedup-nodes")
        found = known.select("vec_id", "node", "first", "copies").join(of_node, "node", "left")
        found = found.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.least(F.coalesce("smallest", "first"), "first").alias("component_id"))
        alone = signed.where("vec_id IS NULL OR digest IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        out = found.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
        return keep(materialise(out, "dedup"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP12_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok AS a JOIN ok AS b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, a AS b FROM (SELECT DISTINCT a FROM links)
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, v.vec_id)::BIGINT AS component_id, coalesce(c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) AS l ON l.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) AS r ON r.a = v.vec_id
"""
