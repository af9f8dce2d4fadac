"""Exact similarity joins that multiply only what can reach the threshold.

Pivots are vectors of the index far from each other, out of SAMPLE times as many in hash order. Every vector belongs to the cell of its nearest pivot; a cell knows its radius and the
length of its longest vector. For a query q in one cell and a row x in another, the triangle inequality bounds the dot product twice:
|q - x| is at least d, the distance of the pivots less both radii, so q.x <= (|q|^2 + |x|^2 - d^2) / 2; and
q.x <= p.p' + |p| r' + r |p'| + r r'. Pairs of cells of which the smaller bound stays below the threshold are never multiplied. The
others meet as packed blocks of PART_ROWS, and workers send single pairs, best rows or flags, as the caller asks.

The vectors looked at (SAMPLE times PIVOTS, and PIVOT_BYTES, at most) and one row a cell pass the driver; which vectors are pivots changes the
work and never the result. Data without any clusters loses nothing but the assignment: all pairs of cells are then multiplied.

Similarities are dot products in double precision, rounded to DIGITS, as in ``dense``. Rows without an id or a vector, and vectors with a
value that is null or not finite, are left out; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.stats import rounded
from siftwell.operators.dense import DIGITS, _matrix
from siftwell.operators.ranking import nearest, sample_rows
from siftwell.sources.scratch import arrow_rows, materialise

#: Rows of a cell in the mean, most pivots and their bytes.
CELL_ROWS, PIVOTS, PIVOT_BYTES = 1_000, 4_096, 32 << 20
#: Rows and bytes of a packed block, blocks of an Arrow batch, and cells of a file of packed blocks in the mean.
PART_ROWS, BLOCK_BYTES, BATCH_BLOCKS, FILE_CELLS = 1_000, 1 << 20, 16, 16
#: Vectors looked at for each pivot.
SAMPLE = 4
#: Pairs of cells whose lists may be broadcast, at 4 bytes each; beyond it the packed blocks are joined with them in a shuffle.
BROADCAST_PAIRS = 500_000


@dataclass
class Blocks:
    """Both sides in cells, and the pairs of cells that may reach the threshold, with the products that each takes."""

    left: DataFrame
    right: DataFrame
    pairs: DataFrame
    least: float
    same: bool

    def products(self) -> int:
        return int(self.pairs.agg(F.sum("work")).first()[0] or 0)


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``x``, each the farthest from those before it, or all rows that differ."""
    picked, away = [0], ((x - x[0]) ** 2).sum(1)
    while len(picked) < n and away.max() > 0:
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[picked[-1]]) ** 2).sum(1))
    return x[picked]


def _assigned(vectors: DataFrame, pivots: np.ndarray, name: str) -> DataFrame:
    """``id, v, cell, away, length``: the nearest pivot, the distance to it, and the length of the vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = shared.value
        square = (p * p).sum(1)
        for b in batches:
            b = b.filter(pa.array(np.isfinite(_matrix(b.column("v"))).all(1)))
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            cell = (square - 2 * (x @ p.T)).argmin(1)
            away = np.sqrt(((x - p[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype("i4")), pa.array(away), pa.array(np.sqrt((x * x).sum(1)))], ["id", "v", "cell", "away", "length"])

    kind = dict(vectors.dtypes)["v"]
    known = vectors.where("id IS NOT NULL AND v IS NOT NULL")
    return materialise(known.mapInArrow(run, f"id long, v {kind}, cell int, away double, length double"), name)


def _cells(rows: DataFrame) -> pa.Table:
    """One row a cell: its number of rows, radius, longest vector."""
    return rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.max("length").alias("most")).toArrow()


def reachable(pivots: np.ndarray, one: pa.Table, other: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``one`` and ``other`` of the pairs of cells that may hold a similarity of ``least``."""
    found = []
    col = lambda t, c: t.column(c).to_numpy()
    p, r, long = pivots[col(one, "cell")], col(one, "radius"), col(one, "most")
    q, s, wide = pivots[col(other, "cell")], col(other, "radius"), col(other, "most")
    norm_p, norm_q = np.sqrt((p * p).sum(1)), np.sqrt((q * q).sum(1))
    for i in range(len(p)):
        apart = np.sqrt(((q - p[i]) ** 2).sum(1)) - r[i] - s
        by_distance = (long[i] ** 2 + wide**2 - np.maximum(apart, 0) ** 2) / 2
        by_parts = q @ p[i] + norm_p[i] * s + r[i] * norm_q + r[i] * s
        slack = 10.0**-DIGITS + 1e-9 * (long[i] ** 2 + wide**2)
        j = np.flatnonzero(np.minimum(by_distance, by_parts) + slack >= least)
        found.append((np.full(len(j), i), j))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"))


def blocks(queries: DataFrame, index: DataFrame, least: float, same: bool = False, cell_rows: int = CELL_ROWS, seed="pivots") -> Blocks:
    """Put ``queries`` (``qid, qv``) and ``index`` (``tid, v``) into the cells of one set of pivots."""
    spark = index.sparkSession
    right = index.select(F.col("tid").alias("id"), "v").where("id IS NOT NULL AND v IS NOT NULL")
    left = queries.select(F.col("qid").alias("id"), F.col("qv").alias("v"))
    usable = right.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    n, width = usable.agg(F.count("*"), F.max(F.size("v"))).first()
    cells = max(1, min(-(-n // cell_rows), PIVOTS, PIVOT_BYTES // (8 * max(width or 1, 1))))
    first = sample_rows(usable, cells if cells == 1 else SAMPLE * cells, seed, "id").toArrow()
    pivots = farthest(_matrix(first.column("v")), cells) if first.num_rows else np.zeros((1, 1))
    sides = [_assigned(left if n else left.limit(0), pivots, "join-left"), _assigned(right, pivots, "join-right")]
    one, other = map(_cells, sides)
    i, j = reachable(pivots, one, other, least)
    n_one, n_other = one.column("n").to_numpy(), other.column("n").to_numpy()
    table = pa.table({"a": one.column("cell").to_numpy()[i], "b": other.column("cell").to_numpy()[j], "work": n_one[i] * n_other[j]})
    return Blocks(*sides, materialise(spark.createDataFrame(table), "join-pairs"), least, same)


def _packed(rows: DataFrame, cells: int, name: str) -> DataFrame:
    """``cell, ids, m``: rows of one cell, PART_ROWS and BLOCK_BYTES at most, as one row of bytes, ids in ascending order."""
    kind = np.dtype("<f4" if dict(rows.dtypes)["v"] == "array<float>" else "<f8")

    def run(batches):
        for b in batches:
            cell, ids = b.column("cell").to_numpy(), b.column("id").to_numpy()
            x = _matrix(b.column("v")).astype(kind)
            step = max(1, min(PART_ROWS, BLOCK_BYTES // max(x[:1].nbytes, 1)))
            ends = [*(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)] if len(cell) else []
            cuts = [(k, min(k + step, end)) for start, end in zip([0, *ends], ends) for k in range(start, end, step)]
            for i, j in cuts:
                row = [pa.array([cell[i]], pa.int32()), *(pa.array([a[i:j].tobytes()], pa.binary()) for a in (ids.astype("<i8"), x))]
                yield pa.RecordBatch.from_arrays(row, ["cell", "ids", "m"])

    dealt = rows.select("id", "v", "cell").repartitionByRange(max(1, -(-cells // FILE_CELLS)), "cell", "id").sortWithinPartitions("cell", "id")
    return materialise(dealt.mapInArrow(run, "cell int, ids binary, m binary"), name)


def _met(b: Blocks, fold, schema: pa.Schema, reduce) -> DataFrame:
    """``reduce`` of what ``fold(columns of the queries, slices)`` gives for blocks of rows of each pair of cells.

    Both sides are packed once, a row a block, and met as a Cartesian product that reads the written blocks: no row is sent once
    for each cell that it meets, so what is shuffled follows the rows and not the pairs. A task has all blocks of one part
    of the index for a block of queries in a row, and folds them together.
    """
    spark, n = b.pairs.sparkSession, b.pairs.count()
    kinds = [np.dtype("<f4" if dict(d.dtypes)["v"] == "array<float>" else "<f8") for d in (b.left, b.right)]

    def vectors(ids: pa.Scalar, m: pa.Scalar, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        of = np.frombuffer(ids.as_buffer(), "<i8")
        return of, np.frombuffer(m.as_buffer(), kind).reshape(len(of), -1).astype("f8")

    def run(batches):
        pairs = ((r.column(c)[k] for c in ("ids", "m", "ids_r", "m_r")) for r in batches for k in range(r.num_rows))
        for _, same in groupby(map(tuple, pairs), key=lambda r: (r[0].as_py(), r[1].as_py())):
            first = next(same)
            qid, q = vectors(*first[:2], kinds[0])

            def slices():
                for r in chain([first], same):
                    tid, x = vectors(*r[2:], kinds[1])
                    yield tid, np.round(q @ x.T, DIGITS)

            for arrays in fold({"qid": qid}, slices()):
                yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), schema=schema)

    cells = lambda side: b.pairs.agg(F.count_distinct(side)).first()[0]
    lists = b.pairs.groupBy(F.col("a").alias("cell")).agg(F.collect_set(F.col("b").cast("int")).alias("meets"))
    left = _packed(b.left, cells("a"), "packed-left").join(F.broadcast(lists) if n <= BROADCAST_PAIRS else lists, "cell").select("ids", "m", "meets")
    right = _packed(b.right, cells("b"), "packed-right").select(F.col("cell").alias("cell_r"), F.col("ids").alias("ids_r"), F.col("m").alias("m_r"))
    both = left.hint("shuffle_replicate_nl").join(right, F.array_contains("meets", F.col("cell_r"))).select("ids", "m", "ids_r", "m_r")
    ddl = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'double'}" for f in schema)
    with arrow_rows(spark, BATCH_BLOCKS):
        return materialise(reduce(both.mapInArrow(run, ddl)), "met")


_PAIRS = pa.schema([("qid", pa.int64()), ("tid", pa.int64()), ("score", pa.float64())])


def _reached(known: dict, s: np.ndarray, tid: np.ndarray, least: float, same: bool, strict: bool) -> np.ndarray:
    hit = s > least if strict else s >= least
    return hit & (known["qid"][:, None] != tid) if same else hit


def pairs_above(b: Blocks, strict: bool = True) -> DataFrame:
    """``qid, tid, score`` of all pairs above the threshold (``strict``), or at least as high."""

    def fold(known, slices):
        for tid, s in slices:
            i, j = np.nonzero(_reached(known, s, tid, least, same, strict))
            yield known["qid"][i], tid[j], s[i, j]

    least, same = b.least, b.same
    return _met(b, fold, _PAIRS, lambda rows: rows)


def flags_above(b: Blocks, strict: bool = True) -> DataFrame:
    """``qid`` of every query with a partner above the threshold, once. A worker sends a query at most once a part."""

    def fold(known, slices):
        met = np.zeros(len(known["qid"]), bool)
        for tid, s in slices:
            met |= _reached(known, s, tid, least, same, strict).any(1)
        yield (known["qid"][met],)

    least, same = b.least, b.same
    return _met(b, fold, pa.schema([("qid", pa.int64())]), DataFrame.distinct)


def nearest_above(b: Blocks) -> DataFrame:
    """``qid, tid, score``: the best partner of every query that has one at the threshold or above, the smaller id on a tie."""

    def fold(known, slices):
        n = len(known["qid"])
        best, at = np.full(n, -np.inf), np.zeros(n, "i8")
        for tid, s in slices:
            if same and np.isin(known["qid"], tid).any():
                s[known["qid"][:, None] == tid] = -np.inf
            j = s.argmax(1)  # ids ascend in a block, so the first is the smallest
            top = np.where(s[np.arange(n), j] >= least, s[np.arange(n), j], -np.inf)
            better = (top > best) | ((top == best) & (top > -np.inf) & (tid[j] < at))
            best, at = np.where(better, top, best), np.where(better, tid[j], at)
        met = best > -np.inf
        yield known["qid"][met], at[met], best[met]

    least, same = b.least, b.same
    return _met(b, fold, _PAIRS, nearest)


def confusion_graph(labeled: DataFrame, catalog: DataFrame, min_sim: float = 0.75) -> DataFrame:
    """Directed pairs ``a, b, sim``: a labeled tool and its nearest other tool of the catalog, at least ``min_sim`` alike."""
    near = nearest_above(blocks(labeled, catalog, min_sim, same=True))
    return near.select(F.col("qid").alias("a"), F.col("tid").alias("b"), rounded(F.col("score"), 4).alias("sim"))
