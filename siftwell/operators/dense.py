"""Dense retrieval. A stated set of queries is multiplied, block by block, with all rows of an index.

A block of queries is a matrix of bounded bytes. One block is broadcast to Python workers and the index streams past it. More
blocks meet blocks of the index in a cogroup, so that no table of queries passes the driver. Products are made in slices of
bounded bytes; a worker keeps the k best of all it has seen, or counts, and sends those alone. Similarities are dot products in
double precision, rounded to DIGITS before ranking, so that ties are broken alike everywhere.

Rows without an id or a vector are left out; a similarity that is not a number is never ranked; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.ranking import nearest, sample_rows, top_k

DIGITS = 6
#: Rows and bytes of one block of vectors, and cells of one product.
BLOCK_ROWS, BLOCK_BYTES, CELLS = 20_000, 64 << 20, 1 << 20
#: Best rows that a worker sorts at once; it keeps four times as many that may be among them before it does.
HELD = 1 << 18


def dot(a: Column, b: Column) -> Column:
    """Dot product of two float arrays in double precision, inside the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _columns(rows) -> tuple[dict, np.ndarray]:
    """The numbers of a block of queries by column, and its matrix."""
    return {c: rows.column(c).to_numpy() for c in rows.column_names if c not in ("qv", "qb", "xb")}, _matrix(rows.column("qv"))


def _slices(q: np.ndarray, parts, extra=()):
    """Ids of a slice of the index, its rounded similarities to a block of queries, and its ``extra`` columns."""
    step = max(1, CELLS // max(len(q), 1))
    for rows in parts:
        if rows.num_rows and len(q):
            x, of_row = _matrix(rows.column("v")), [rows.column(c).to_numpy() for c in ("tid", *extra)]
            for i in range(0, len(x), step):
                tid, *more = (c[i : i + step] for c in of_row)
                yield tid, np.round(q @ x[i : i + step].T, DIGITS), *more


def _product(queries: DataFrame, index: DataFrame, fold, schema: pa.Schema, extra=()) -> DataFrame:
    """``fold(columns of a query block, slices)`` gives lists of arrays of ``schema`` for each block of queries and part of the index."""
    queries, index = queries.where("qid IS NOT NULL AND qv IS NOT NULL"), index.select("tid", "v", *extra).where("tid IS NOT NULL AND v IS NOT NULL")
    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double'}" for f in schema)
    n, width = queries.agg(F.count("*"), F.max(F.size("qv"))).first()
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width or 1, 1))))
    if n <= rows:
        shared = queries.sparkSession.sparkContext.broadcast(_columns(queries.toArrow()))

        def streamed(batches):
            known, q = shared.value
            for arrays in fold(known, _slices(q, batches, extra)):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), schema=schema)

        return index.mapInArrow(streamed, ddl)

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        known, q = _columns(left)
        return pa.Table.from_batches([pa.RecordBatch.from_arrays(list(map(pa.array, a)), schema=schema) for a in fold(known, _slices(q, [right], extra))], schema)

    many, parts = -(-n // rows), max(1, -(-index.count() // rows))
    block = lambda key, count: F.pmod(F.xxhash64(key), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = queries.withColumn("qb", block("qid", many)).withColumn("xb", every(parts))
    right = index.withColumn("xb", block("tid", parts)).withColumn("qb", every(many))
    return left.groupBy("qb", "xb").cogroup(right.groupBy("qb", "xb")).applyInArrow(both, ddl)


_SCORES = pa.schema([("qid", pa.int64()), ("tid", pa.int64()), ("score", pa.float64())])


def _k_best(i: np.ndarray, s: np.ndarray, tid: np.ndarray, k: int):
    """Of flat rows the k best of each query ``i``, the smaller id first, with their place."""
    order = np.lexsort((tid, -s, i))
    i, s, tid = i[order], s[order], tid[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    keep = place < k
    return i[keep], s[keep], tid[keep], place[keep]


def dense_topk(queries: DataFrame, index: DataFrame, k: int, same: bool = False) -> DataFrame:
    """``qid, tid, score, rank`` of the k best rows of ``index`` (``tid, v``) for each query (``qid, qv``).

    ``same``: both sides are of one table, a row is not its own neighbour.
    """

    def fold(known, slices):
        qid, place = known["qid"], k
        n, step = len(qid), max(1, HELD // max(place, 1))
        best, ids, found = np.full((n, place), -np.inf), np.zeros((n, place), "i8"), np.zeros(n, "i8")

        def merge(i, v, t):
            """Rows that may be among the best into the best, some queries at a time."""
            order = np.argsort(i, kind="stable")
            i, v, t = i[order], v[order], t[order]
            for at in range(0, n, step):
                own = slice(*np.searchsorted(i, [at, at + step]))
                rows = np.unique(i[own])
                a, b = np.nonzero(np.arange(place) < found[rows, None])
                a = rows[a]
                q, score, tid, nth = _k_best(np.concatenate([a, i[own]]), np.concatenate([best[a, b], v[own]]), np.concatenate([ids[a, b], t[own]]), place)
                best[q, nth], ids[q, nth] = score, tid
                found[rows] = np.bincount(q - at, minlength=step)[rows - at]

        held, size = [], 0
        for tid, s in slices:
            if same and np.isin(qid, tid).any():
                s[qid[:, None] == tid] = np.nan
            # Before a query has its k best, all rows may be among them; then only those that reach the last of them.
            least = np.where(found < place, -np.inf, best[:, -1])
            i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            held.append((i, s[i, j], tid[j]))
            size += len(i)
            if size > 4 * HELD:
                merge(*map(np.concatenate, zip(*held)))
                held, size = [], 0
        if size:
            merge(*map(np.concatenate, zip(*held)))
        for at in range(0, n, step):
            i, j = np.nonzero(np.arange(place) < found[at : at + step, None])
            yield qid[at + i], ids[at + i, j], best[at + i, j]

    return top_k(_product(queries.select("qid", "qv"), index, fold, _SCORES), k)


def _with_best_gold(queries: DataFrame, index: DataFrame, gold: DataFrame, same: bool) -> DataFrame:
    """``qid, qv, gs, gt``: the similarity and id of each query's best gold, the smaller id on a tie."""
    pairs = gold.select("qid", "tid").join(queries.select("qid", "qv"), "qid").join(index.select("tid", "v"), "tid")
    if same:
        pairs = pairs.where("qid <> tid")
    best = pairs.groupBy("qid").agg(F.max(F.struct(F.round(dot(F.col("qv"), F.col("v")), DIGITS).alias("s"), (-F.col("tid")).alias("p"))).alias("b"))
    return queries.join(best, "qid").select("qid", "qv", F.col("b.s").alias("gs"), (-F.col("b.p")).alias("gt"))


def _better(known: dict, tid: np.ndarray, s: np.ndarray, same: bool) -> np.ndarray:
    """Rows of a slice that stand before the best gold."""
    gs, gt = known["gs"][:, None], known["gt"][:, None]
    better = (s > gs) | ((s == gs) & (tid < gt))
    return better & (known["qid"][:, None] != tid) if same else better


def dense_rank_of(queries: DataFrame, index: DataFrame, gold: DataFrame, same: bool = False) -> DataFrame:
    """``qid, rank``: the best 1-based rank of a gold (``qid, tid``) over the whole index, ties broken by tid.

    Counts better rows instead of sorting: each part adds how many of its rows stand before the query's best gold. ``same``: as
    in ``dense_topk``; a query's own row is no gold of it.
    """

    def fold(known, slices):
        before = np.zeros(len(known["qid"]), "i8")
        for tid, s in slices:
            before += _better(known, tid, s, same).sum(1)
        yield known["qid"], before

    counts = _product(_with_best_gold(queries, index, gold, same), index, fold, pa.schema([("qid", pa.int64()), ("before", pa.int64())]))
    return counts.groupBy("qid").agg((F.sum("before") + 1).cast("int").alias("rank"))


def dense_pool_ranks(queries: DataFrame, index: DataFrame, gold: DataFrame, sizes: list[int], same: bool = False) -> DataFrame:
    """``pool, qid, rank``: the best rank of a gold in each of the nested pools, from one pass over the index.

    A row of ``index`` (``tid, v, nth``) is in the pool of a size when ``nth`` is below it; golds are in every pool (a negative
    ``nth``). Each part counts the rows that stand before the best gold by the smallest pool that holds them; the sums
    up to a pool are the ranks in it. A size as large as the index gives the ranks over all of it.
    """
    sizes = sorted(set(sizes))
    limits = np.asarray(sizes)

    def fold(known, slices):
        before = np.zeros((len(known["qid"]), len(limits) + 1), "i8")
        for tid, s, nth in slices:
            pool = np.searchsorted(limits, nth, "right")
            before += _better(known, tid, s, same) @ (pool[:, None] == np.arange(len(limits) + 1)).astype("i8")
        yield known["qid"], *before[:, :-1].T

    fields = [f"p{k}" for k in range(len(sizes))]
    counts = _product(_with_best_gold(queries, index, gold, same), index, fold, pa.schema([("qid", pa.int64()), *[(f, pa.int64()) for f in fields]]), ("nth",))
    summed = counts.groupBy("qid").agg(*[F.sum(f).alias(f) for f in fields])
    ranks = [F.struct(F.lit(size).alias("pool"), (sum((F.col(f) for f in fields[: k + 1]), F.lit(0)) + 1).cast("int").alias("rank")) for k, size in enumerate(sizes)]
    return summed.select("qid", F.explode(F.array(*ranks)).alias("e")).select("e.pool", "qid", "e.rank")


def dense_places(wanted: DataFrame, queries: DataFrame, index: DataFrame, same: bool = False) -> DataFrame:
    """``qid, tid, col, worst`` of stated rows (``qid, tid, score``) in the order of the whole index, by counting.

    ``col`` is the place with ties broken by tid, ``worst`` the number of rows that score at least as high. A query's stated rows
    travel with its vector, so they should be few.
    """
    lists = wanted.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tid", "score"))).alias("l"))
    asked = queries.select("qid", "qv").join(lists, "qid").select("qid", "qv", F.col("l.tid").alias("ids"), F.col("l.score").alias("scores"))

    def fold(known, slices):
        qid, ids, scores = known["qid"], known["ids"], known["scores"]
        at_least, before = [np.zeros(len(x), "i8") for x in ids], [np.zeros(len(x), "i8") for x in ids]
        for tid, s in slices:
            if same:
                s[qid[:, None] == tid] = -np.inf
            for k in range(len(qid)):
                order = np.lexsort((tid, -s[k]))
                falling, own = -s[k][order], tid[order]
                low, high = np.searchsorted(falling, -scores[k], "left"), np.searchsorted(falling, -scores[k], "right")
                at_least[k] += high
                before[k] += [i + int(np.searchsorted(own[i:j], t)) if j > i else i for i, j, t in zip(low, high, ids[k])]
        if len(qid):
            yield np.repeat(qid, [len(x) for x in ids]), *map(np.concatenate, (ids, before, at_least))

    schema = pa.schema([(c, pa.int64()) for c in ("qid", "tid", "before", "worst")])
    counts = _product(asked, index, fold, schema)
    return counts.groupBy("qid", "tid").agg((F.sum("before") + 1).cast("int").alias("col"), F.sum("worst").cast("int").alias("worst"))


def nearest_neighbours(queries: DataFrame, index: DataFrame, same: bool = False) -> DataFrame:
    return nearest(dense_topk(queries, index, 1, same))


def confusion_candidates(pairs: DataFrame, catalog: DataFrame, allowed: Column, least: float, n: int, seed) -> DataFrame:
    """Pairs ``a, b, sim`` of at least ``least`` whose both tools (``tid`` of ``catalog``) are ``allowed``: a sample of ``n`` in hash order."""
    tools = catalog.where(allowed).select("tid")
    both = pairs.where(F.col("sim") >= least).join(tools.withColumnRenamed("tid", "a"), "a", "left_semi").join(tools.withColumnRenamed("tid", "b"), "b", "left_semi")
    return sample_rows(both.select("a", "b", "sim"), n, seed, "a", "b")


def matrix_gaps(vectors: DataFrame, catalog: DataFrame) -> DataFrame:
    """Ids that only one side has; a matrix fits a catalog when there are none."""
    return vectors.select("tid").exceptAll(catalog.select("tid")).withColumn("side", F.lit("vectors")).unionByName(
        catalog.select("tid").exceptAll(vectors.select("tid")).withColumn("side", F.lit("catalog"))
    )


def not_finite(vectors: DataFrame) -> DataFrame:
    """Vectors that hold a NaN, an infinity or a null."""
    return vectors.where(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def geometry_probe(queries: DataFrame, population: DataFrame, same: bool = False) -> DataFrame:
    """Mean cosine and mean best cosine of the queries to a population of documents; a worker sends sums, not pairs."""

    def fold(known, slices):
        qid = known["qid"]
        total, n, top = np.zeros(len(qid)), np.zeros(len(qid), "i8"), np.full(len(qid), -np.inf)
        for tid, s in slices:
            counts = qid[:, None] != tid if same else np.ones(s.shape, bool)
            total += np.where(counts, s, 0).sum(1)
            n += counts.sum(1)
            top = np.maximum(top, np.where(counts, s, -np.inf).max(1))
        met = n > 0
        yield qid[met], total[met], n[met], top[met]

    part = _product(queries.select("qid", "qv"), population, fold, pa.schema([("qid", pa.int64()), ("s", pa.float64()), ("n", pa.int64()), ("top", pa.float64())]))
    per_query = part.groupBy("qid").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("top").alias("top"))
    return per_query.agg(F.round(F.sum("s") / F.sum("n"), 6).alias("mean_cosine"), F.round(F.avg("top"), 6).alias("mean_top1"))
