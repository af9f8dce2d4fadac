"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence.

1. Every whole text becomes its set of distinct four-word shingles. Equal sets (by a 128-bit digest) are one row of the
   incidence matrix; its documents are kept as members.
2. Columns with a single entry cannot add to any product. They are found by counting shingle hashes in hash ranges: a batch
   sends each of its shingles once, packed, so a range never holds more entries of a shingle than there are batches. Rows
   that keep fewer than t * n entries cannot reach the threshold t with any other row and leave.
3. Rows are ordered by column frequency, and the first n - ceil(t * n) + 1 entries (entries dropped before count first) name
   the blocks of a row: two rows with Jaccard of at least t meet in a block.
4. In each block the row with the fewest single entries is multiplied with all others; the links found join rows into
   components. What is left are the pairs of different components whose sizes and entry counts still allow the threshold;
   their rows are gathered over shared blocks and multiplied in square tiles, accumulating overlap counts over column
   ranges. A tile returns a spanning forest of its links, never its pairs.

Hashes have 64 bits (58 are compared in step 2); all overlaps are counted over complete sets.

Defined cases: a null or empty text has no shingles and links with nothing; fewer words than four are one shingle; equal
sets are linked; repeated rows and equal ids are members like any other; a null id stands for itself and is never the
smallest id unless alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import free_name, join_bounded
from siftwell.llm.wordlists import LOWER, split_words
from siftwell.llm.worker import begin
from siftwell.operators.graph import connected_components
from siftwell.sources.scratch import arrow_rows, delete, materialise, release, table, temporary

SHINGLE = 4
#: The threshold as a fraction.
THRESHOLD = (85, 100)
#: Rows whose entries are packed together, fewer than 2^16, and rows of an Arrow batch.
PACK_ROWS, ARROW_ROWS = 1_000, 1_000
#: Rows of the matrix to a side of a tile, and cells of a dense column range.
TILE, CELLS = 512, 1 << 23
#: Ids of copies that may be broadcast; beyond it the documents are shuffled.
BROADCAST_COPIES = 1_000_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_LOW48 = np.uint64((1 << 48) - 1)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _M[0] + b * _M[1]
    return (x ^ (x >> np.uint64(32))) * _M[2]


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text: words between U+0009..U+000D and spaces, lower A-Z only."""
    words, n = split_words(texts, LOWER)
    words = words.dictionary_encode()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), "u8", len(words.dictionary))[words.indices.to_numpy()]
    begin = np.cumsum(n) - n
    size = np.maximum(n - k + 1, n > 0)
    ends = np.cumsum(size)
    at = np.repeat(begin - (ends - size), size) + np.arange(size.sum())
    out = h[at]
    long = np.repeat(n >= k, size)
    for i in range(1, k):
        # A text of fewer words has one shingle of all of them; a single word is mixed with itself.
        more = long | np.repeat(n > i, size)
        out[more] = _mix(out[more], h[at[more] + i])
    alone = np.repeat(n == 1, size)
    out[alone] = _mix(out[alone], out[alone])
    return [np.unique(x) for x in np.split(out, ends[:-1])] if len(n) else []


_PACKED = "slot int, doc_id long, sid binary, n int, row long, grams binary, rows binary"


def _pack(k: int, bits: int):
    """Rows of three kinds, told apart by what is null: documents, matrix rows, and packed entries of a hash range."""

    def run(batches):
        begin("jaccard")
        part, at = TaskContext.get().partitionId(), 0
        schema = pa.schema([("slot", pa.int32()), ("doc_id", pa.int64()), ("sid", pa.binary()), ("n", pa.int32()), ("row", pa.int64()), ("grams", pa.binary()), ("rows", pa.binary())])
        nulls = lambda m, t: pa.nulls(m, t)
        for batch in batches:
            for lo in range(0, batch.num_rows, PACK_ROWS):
                b = batch.slice(lo, PACK_ROWS)
                base, at = (part << 40) | (at << 16), at + 1
                index: dict[bytes, int] = {}
                sets, sids, sizes = [], [], []
                for s in shingle_sets(b.column("text").fill_null(""), k):
                    sid = xxhash.xxh3_128_digest(s.tobytes())
                    sids.append(sid)
                    sizes.append(len(s))
                    if len(s) and sid not in index:
                        index[sid] = len(sets)
                        sets.append(s)
                m = b.num_rows
                spread = pa.array((np.arange(m) * 7919 + at * 31) % (1 << bits), pa.int32())
                yield pa.RecordBatch.from_arrays([spread, b.column("doc_id"), pa.array(sids, pa.binary()), pa.array(sizes, pa.int32()), nulls(m, pa.int64()), nulls(m, pa.binary()), nulls(m, pa.binary())], schema=schema)
                if not sets:
                    continue
                m = len(sets)
                spread = pa.array((np.arange(m) * 7919 + at * 31) % (1 << bits), pa.int32())
                yield pa.RecordBatch.from_arrays([spread, nulls(m, pa.int64()), pa.array(list(index), pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array(base + np.arange(m)), nulls(m, pa.binary()), nulls(m, pa.binary())], schema=schema)
                h = np.concatenate(sets)
                order = np.argsort(h)
                h, own = h[order], np.repeat(np.arange(m, dtype="u2"), [len(s) for s in sets])[order]
                first = np.concatenate([[True], h[1:] != h[:-1]])
                lone = first & np.concatenate([first[1:], [True]])
                # Shingles found twice in the batch need no count: their entries go on as they are (slot below zero), and one
                # entry of row 65535 tells the other batches.
                cut = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype="u8"))
                out: list[list] = [[], [], []]
                for slot in range(1 << bits):
                    i, j = cut[slot], cut[slot + 1]
                    if i == j:
                        continue
                    f = first[i:j]
                    g = h[i:j][f]
                    r = np.where(lone[i:j], own[i:j], np.uint16(65535))[f]
                    for s, gg, rr in ((slot, g, r), (-1 - slot, h[i:j][~lone[i:j]], own[i:j][~lone[i:j]])):
                        if len(gg):
                            low = gg & _LOW48
                            out[0].append(s)
                            out[1].append((low & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (low >> np.uint64(32)).astype("<u2").tobytes())
                            out[2].append(rr.astype("<u2").tobytes())
                m = len(out[0])
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), nulls(m, pa.int64()), nulls(m, pa.binary()), nulls(m, pa.int32()), pa.array(np.full(m, base)), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], schema=schema)

    return run


_ENTRY = "doc_id long, sid binary, n int, row long, gram long"


def _unpack(bits: int):
    """Rows sorted by range, so that one range is held at a time."""
    schema = pa.schema([("doc_id", pa.int64()), ("sid", pa.binary()), ("n", pa.int32()), ("row", pa.int64()), ("gram", pa.int64())])

    def run(batches):
        def entries(gram, row):
            for i in range(0, len(gram), 1 << 18):
                g, r = gram[i : i + (1 << 18)], row[i : i + (1 << 18)]
                m = len(g)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.array(r), pa.array(g.view("i8"))], schema=schema)

        def counted(some):
            """Entries of one range that are not single."""
            gram, row = (np.concatenate(x) for x in zip(*some))
            order = np.argsort(gram)
            gram, row = gram[order], row[order]
            new = np.concatenate([[True], gram[1:] != gram[:-1], [True]])
            # An entry that stands alone is single, unless it tells of two in its batch.
            keep = ~(new[:-1] & new[1:]) & (row >= 0)
            yield from entries(gram[keep], row[keep])

        begin("jaccard")
        some, last = [], None
        for b in batches:
            packed = b.column("grams").is_valid().to_numpy(zero_copy_only=False)
            plain = b.filter(pa.array(~packed))
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([plain.column("doc_id"), plain.column("sid"), plain.column("n"), plain.column("row"), pa.nulls(plain.num_rows, pa.int64())], schema=schema)
            b = b.filter(pa.array(packed))
            for slot, base, grams, rows in zip(*(b.column(c).to_pylist() for c in ("slot", "row", "grams", "rows"))):
                if slot != last:
                    if some:
                        yield from counted(some)
                    some, last = [], slot
                m = len(rows) // 2
                low = np.frombuffer(grams, "<u4", m).astype("u8") | np.frombuffer(grams, "<u2", m, 4 * m).astype("u8") << np.uint64(32)
                gram = low | np.uint64(slot if slot >= 0 else -1 - slot) << np.uint64(48)
                own = np.frombuffer(rows, "<u2").astype("i8")
                row = np.where(own == 65535, -1, base + own)
                if slot < 0:
                    yield from entries(gram, row)
                else:
                    some.append((gram, row))
        if some:
            yield from counted(some)

    return run


def _least_overlap(n, t):
    return F.ceil(n * F.lit(t[0]) / F.lit(t[1]))


def _reaches(shared, n1, n2, t):
    """Overlap over union of at least t, in whole numbers."""
    return shared * (t[0] + t[1]) >= (n1 + n2) * t[0]


def _overlap_bound(n1, c1, n2, c2, t):
    """Whether two rows with n entries, c of them shared with any row, can reach the threshold."""
    return _reaches(F.least(c1, c2), n1, n2, t)


def _tile_links(t: tuple[int, int]):
    """Spanning forests of the links in each tile; rows arrive sorted by tile key."""
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def tiles(batches):
        rows, last = [], None
        for b in batches:
            for h, i, j, side, sid, comp, n, feats in zip(*(b.column(c).to_pylist() for c in ("grp", "i", "j", "side", "sid", "component", "n", "feats"))):
                if (h, i, j) != last:
                    if rows:
                        yield last, rows
                    rows, last = [], (h, i, j)
                rows.append((side, sid, comp, n, np.asarray(feats, "i8")))
        if rows:
            yield last, rows

    def run(batches):
        begin("jaccard")
        for (_, i, j), rows in tiles(batches):
            links = forest(rows, i != j, t)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.binary()), pa.array([x[1] for x in links], pa.binary())], schema=schema)

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two lists of sets: products of dense column ranges, added up."""
    columns, at = np.unique(np.concatenate(left + right), return_inverse=True)
    own = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    both = np.zeros(len(columns), "i1")
    both[at[own < len(left)]] |= 1
    both[at[own >= len(left)]] |= 2
    rank = np.cumsum(both == 3) - 1
    keep = both[at] == 3
    at, own, width = rank[at[keep]], own[keep], int((both == 3).sum())
    out = np.zeros((len(left), len(right)), "f4")
    step = max(1, CELLS // (len(left) + len(right)))
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    for lo in range(0, width, step):
        i, j = np.searchsorted(at, [lo, lo + step])
        dense = np.zeros((len(left) + len(right), min(step, width - lo)), "f4")
        dense[own[i:j], at[i:j] - lo] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def forest(rows: list[tuple], crossed: bool, t: tuple[int, int] = THRESHOLD) -> list[tuple[bytes, bytes]]:
    left = [r for r in rows if r[0] == 0] if crossed else rows
    right = [r for r in rows if r[0] == 1] if crossed else rows
    if not left or not right or len(rows) < 2:
        return []
    shared = overlaps([r[4] for r in left], [r[4] for r in right])
    n1, n2 = np.asarray([r[3] for r in left]), np.asarray([r[3] for r in right])
    link = shared * (t[0] + t[1]) >= (n1[:, None] + n2) * t[0]
    parent: dict[bytes, bytes] = {}

    def root(x):
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    out = []
    for i, j in zip(*np.nonzero(link)):
        a, b = root(left[i][2]), root(right[j][2])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((left[i][1], right[j][1]))
    return out


def incidence(docs: DataFrame, k: int = SHINGLE, t: tuple[int, int] = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members (``doc_id, sid, n``) and the rows ``sid, n, feats`` that may link with another, single columns left out."""
    spark = docs.sparkSession
    bits = max(10, min(16, int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length() + 2))
    packed = docs.select("doc_id", "text").mapInArrow(_pack(k, bits), _PACKED)
    with arrow_rows(spark, ARROW_ROWS):
        entries = materialise(packed.repartition(F.col("slot")).sortWithinPartitions("slot").mapInArrow(_unpack(bits), _ENTRY), "incidence")
    del packed
    release(spark)
    members = entries.where("row IS NULL").select("doc_id", "sid", "n")
    members = materialise(members, "members", members.count())
    rows = entries.where("sid IS NOT NULL AND row IS NOT NULL").select("row", "sid", "n")
    grams = entries.where("gram IS NOT NULL").groupBy("row").agg(F.collect_list("gram").alias("feats"))
    wide = grams.join(rows, "row").where(F.size("feats") >= _least_overlap(F.col("n"), t))
    out = materialise(wide.groupBy("sid").agg(F.first("n").alias("n"), F.first("feats").alias("feats")), "rows")
    delete(spark, entries.scratch_path)
    del grams, wide
    release(spark)
    return members, out


def near_links(rows: DataFrame, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``a, b``: links between ``rows`` that connect exactly what all links connect."""
    spark = rows.sparkSession
    flat = rows.select("sid", "n", F.explode("feats").alias("gram"))
    common = flat.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    kept = flat.join(common, "gram").groupBy("sid").agg(F.first("n").alias("n"), F.collect_list(F.struct("df", "gram")).alias("f"))
    kept = kept.withColumn("c", F.size("f")).where(F.col("c") >= _least_overlap(F.col("n"), t))
    # Entries that were left out are the rarest and stand first in the order.
    prefix = F.col("n") - _least_overlap(F.col("n"), t) + 1 - (F.col("n") - F.col("c"))
    kept = kept.withColumn("f", F.transform(F.sort_array("f"), lambda x: x["gram"])).withColumn("p", prefix.cast("int")).where("p > 0")
    kept = materialise(kept.select("sid", "n", "c", F.col("f").alias("feats"), "p"), "kept-rows")
    release(spark)
    blocks = materialise(kept.select("sid", "n", "c", F.explode(F.slice("feats", F.lit(1), F.col("p"))).alias("gram")), "blocks")
    entries = blocks.count()

    pivot = blocks.groupBy("gram").agg(F.min(F.struct((F.col("n") - F.col("c")).alias("single"), "sid", "n", "c")).alias("pivot"), F.count("*").alias("m")).where("m > 1")
    star = blocks.join(pivot, "gram").where(F.col("sid") != F.col("pivot.sid")).where(_overlap_bound(F.col("n"), F.col("c"), F.col("pivot.n"), F.col("pivot.c"), t))
    star = star.select("sid", F.col("pivot.sid").alias("other")).distinct()
    one = kept.select("sid", "n", "feats")
    two = kept.select(F.col("sid").alias("other"), F.col("n").alias("n2"), F.col("feats").alias("feats2"))
    tried = star.join(one, "sid").join(two, "other")
    links = materialise(tried.where(_reaches(F.size(F.array_intersect("feats", "feats2")), F.col("n"), F.col("n2"), t)).select(F.col("sid").alias("a"), F.col("other").alias("b")), "star-links")

    found = connected_components(links)
    labelled = blocks.join(found.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    labelled = materialise(labelled, "labelled", entries)
    kinds = labelled.groupBy("gram", "n", "c").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    kinds = kinds.groupBy("gram").agg(F.collect_list(F.struct("n", "c", "low", "high")).alias("kinds"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("gram", "kinds")
    may = lambda k: ((k["low"] != F.col("component")) | (k["high"] != F.col("component"))) & _overlap_bound(F.col("n"), F.col("c"), k["n"], k["c"], t)
    active = materialise(labelled.join(kinds, "gram").where(F.exists("kinds", may)).select("gram", "sid", "component", "n"), "active", entries)
    # Rows meet in many blocks; each goes once to the group of all blocks that it shares, directly or over others.
    first = active.groupBy("gram").agg(F.min("sid").alias("first"), F.count("*").alias("m")).where("m > 1")
    groups = connected_components(active.join(first, "gram").select(F.col("sid").alias("a"), F.col("first").alias("b")))
    grouped = active.select("sid", "component", "n").distinct().join(groups.select(F.col("node").alias("sid"), F.col("component").alias("grp")), "sid")
    grouped = materialise(grouped, "groups", entries)
    sizes = grouped.groupBy("grp").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    placed = grouped.join(sizes, "grp").withColumn("t", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("grp", "sid", "component", "n", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), (F.col("t") > F.col("u")).cast("int").alias("side"))
    cells = placed.join(one.select("sid", "feats"), "sid").repartition(F.col("grp"), F.col("i"), F.col("j")).sortWithinPartitions("grp", "i", "j")
    more = cells.select("grp", "i", "j", "side", "sid", "component", "n", "feats").mapInArrow(_tile_links(t), "a binary, b binary")
    return links.unionByName(materialise(more, "tile-links"))


def jaccard_components(docs: DataFrame, k: int = SHINGLE, t: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    spark = docs.sparkSession
    with temporary(spark) as keep:
        members, rows = incidence(docs, k, t)
        n = members.count()
        return keep(materialise(_components(members, rows, n, t), "components", n))


def _components(members: DataFrame, rows: DataFrame, n: int, t: tuple[int, int]) -> DataFrame:
    found = connected_components(near_links(rows, t))
    least = members.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    least = least.join(found.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = materialise(least, "classes", n)
    smallest = least.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = least.join(smallest, "component").select("sid", "component_id")
    out = members.join(by_set, "sid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``docs`` with the smallest id of every component.

    Rows that share an id are one document: it goes if any of its rows is a later copy, else the row that comes first as JSON
    stays.
    """
    own, row = free_name(docs.columns, "copy_id"), free_name(docs.columns, "row")
    found = jaccard_components(docs, k, threshold)
    gone = materialise(found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct(), "copies")
    out = join_bounded(docs, gone, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti", gone.count(), BROADCAST_COPIES)
    twice = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias(own))
    twice = materialise(twice, "twice")
    n = twice.count()
    if not n:
        return out
    once = join_bounded(out, twice, F.col("doc_id") == F.col(own), "left_anti", n, BROADCAST_COPIES)
    more = join_bounded(out, twice, F.col("doc_id") == F.col(own), "left_semi", n, BROADCAST_COPIES)
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    more = more.groupBy("doc_id").agg(F.min_by(every, F.to_json(every)).alias(row))
    return once.unionByName(more.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and the smallest id that links reach."""
    return jaccard_components(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3]) END) AS s
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM w
  UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach
)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node) USING (doc_id)
"""
