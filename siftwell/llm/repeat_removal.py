"""Removal of repeated byte strings of a fixed length anywhere in the corpus.

A window (a string of ``length`` bytes) that starts at another place too is what the longest-previous-factor and
longest-next-factor values of a suffix array tell of: one of them reaches ``length`` exactly where the suffix order, cut at
``length`` bytes, puts another position into the same class. Sorting all suffixes of a corpus does not fit the disk a
cluster has for it, so the classes are named by hashes, coarse to fine, and only as far as they stay undecided:

* Every window has an anchor, the rightmost smallest hashed GRAM-byte string inside. Equal windows have it at the same
  place, so only windows with equal anchors are compared. Neighbouring windows with one anchor make a run.
* Round 1 names runs by content: a run whose content is found again is repeated as a whole; a run whose anchor string is
  found nowhere else has no repeated window. What is left are anchors with different runs: one run of each content goes on.
* Round 2 does the same for buckets of STEP windows, compared by the string that all windows of the bucket share.
* Round 3 names single windows in the buckets that are still undecided.

With ``keep_first`` a window counts as repeated only if an equal one starts earlier in (doc_id, position) order (previous
factors alone); otherwise every copy counts (previous and next). Every count is an aggregate with partial sums, so copies of
a string never meet in one task; text is read again in each round and never sorted.

Names are 64 bits of BLAKE2b digests of the strings, so different strings share one by chance alone. Anchors and the keys that
bring candidates together are quick polynomial hashes: texts made to collide there cost work and change no result. Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes;
repeated rows are copies of each other; a null id sorts first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.llm.common import join_bounded
from siftwell.llm.worker import begin
from siftwell.sources.scratch import arrow_rows, materialise, table, temporary

LENGTH, GRAM, STEP = 400, 32, 16
#: Bytes hashed at once, and window starts of a long text taken at once.
BUFFER, SEGMENT = 1 << 20, 1 << 19
#: Rows of an Arrow batch with texts.
ARROW_ROWS = 2000
#: Texts with undecided runs that may be broadcast as request lists; beyond it text and lists are shuffled.
BROADCAST_TEXTS, BROADCAST_ITEMS = 400_000, 4_000_000

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    if not _POWERS:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(BUFFER + SEGMENT + 4096, base, "u8")
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype="u8"))
    return _POWERS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Buffer:
    """Texts of a batch, or segments of long ones, side by side, with prefix hashes."""

    def __init__(self, parts: list[tuple[int, int, bytes, int]]):
        self.row = np.asarray([p[0] for p in parts])
        self.offset = np.asarray([p[1] for p in parts], "i8")
        self.windows = np.asarray([p[3] for p in parts], "i8")
        size = np.asarray([len(p[2]) for p in parts], "i8")
        self.at = np.cumsum(size) - size
        self.bytes = memoryview(b"".join(p[2] for p in parts))
        data = np.frombuffer(self.bytes, "u1")
        self.prefix = np.zeros(len(data) + 1, "u8")
        np.cumsum(_BYTES[data] * _powers()[0][: len(data)], out=self.prefix[1:])

    def mark(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A quick number for the bytes from i up to j. Some texts share it by their make, so it finds anchors and never decides."""
        return _mix((self.prefix[j] - self.prefix[i]) * _powers()[1][i])

    def name(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """64 bits of the BLAKE2b digest of the bytes from i up to j."""
        return np.frombuffer(b"".join([hashlib.blake2b(self.bytes[a:b], digest_size=8).digest() for a, b in zip(i.tolist(), j.tolist())]), "u8")


def buffers(texts: list[bytes], length: int, segment: int = SEGMENT):
    """Buffers over all texts of at least ``length`` bytes."""
    parts, size = [], 0
    for row, text in enumerate(texts):
        for k in range(0, len(text) - length + 1, segment):
            part = text[k : k + segment + 2 * length]
            parts.append((row, k, part, min(segment, len(text) - length + 1 - k)))
            size += len(part)
            if size >= BUFFER // 2:
                yield Buffer(parts)
                parts, size = [], 0
    if parts:
        yield Buffer(parts)


def anchors(b: Buffer, length: int) -> np.ndarray:
    """Position of the anchor of the window at each position of the buffer (any value where no window begins)."""
    n, width = len(b.prefix) - 1, length - GRAM + 1
    h = b.mark(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    low = np.uint64((1 << 17) - 1)
    out = np.empty(n - length + 1, "i8")
    for k in range(0, len(out), 1 << 16):
        e = min(len(out), k + (1 << 16))
        r = (h[k : e + width - 1] & ~low) | (low - np.arange(e - k + width - 1, dtype="u8"))
        w = 1
        while 2 * w <= width:
            r, w = np.minimum(r[:-w], r[w:]), 2 * w
        if width > w:
            r = np.minimum(r[: w - width], r[width - w :])
        out[k:e] = k + (low - (r & low)).astype("i8")
    return out


_RUN = [("dk", pa.int64()), ("doc_id", pa.int64()), ("x", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16()), ("key", pa.int64()), ("name", pa.int64())]
_RUN_DDL = "dk long, doc_id long, x long, lo short, hi short, key long, name long"


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]


def _slices(batches, rows: int = 2000):
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _runs(length: int, segment: int):
    """Round 1: runs by anchor (``key``) and content (``name``); windows start at x - hi .. x - lo."""

    def run(batches):
        begin("repeats")
        for b in _slices(batches):
            dk, ids = b.column("dk").to_numpy(), b.column("doc_id")
            for buf in buffers(_texts(b), length, segment):
                a = anchors(buf, length)
                v = np.repeat(buf.at, buf.windows) + np.arange(buf.windows.sum()) - np.repeat(np.cumsum(buf.windows) - buf.windows, buf.windows)
                part = np.repeat(np.arange(len(buf.at)), buf.windows)
                av = a[v]
                new = np.flatnonzero(np.concatenate([[True], (av[1:] != av[:-1]) | (part[1:] != part[:-1])]))
                s, e, p = v[new], v[np.append(new[1:], len(v)) - 1], part[new]
                x = av[new]
                hi, lo = x - s, x - e
                name = _mix(buf.name(s, e + length) + (hi * 1024 + lo).astype("u8"))
                row = buf.row[p]
                columns = [dk[row], None, x - buf.at[p] + buf.offset[p], lo, hi, buf.mark(x, x + GRAM).view("i8"), name.view("i8")]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)) if c is None else pa.array(c.astype(t.to_pandas_dtype())) for c, (_, t) in zip(columns, _RUN)], schema=pa.schema(_RUN))

    return run


_ITEM = [("dk", pa.int64()), ("doc_id", pa.int64()), ("x", pa.int64()), ("lo", pa.int16()), ("hi", pa.int16()), ("known", pa.bool_()), ("key", pa.int64()), ("name", pa.int64())]
_ITEM_DDL = "dk long, doc_id long, x long, lo short, hi short, known boolean, key long, name long"


def _split(length: int, step: int, segment: int):
    """Cut requested runs into buckets of ``step`` windows, named by shared string (``key``) and content (``name``)."""

    def run(batches):
        for b in _slices(batches):
            dk, ids, asked = b.column("dk").to_numpy(), b.column("doc_id"), b.column("items")
            flat, counts = asked.flatten(), np.diff(asked.offsets.to_numpy())
            row = np.repeat(np.arange(b.num_rows), counts)
            x, lo, hi = (flat.field(k).to_numpy(zero_copy_only=False).astype("i8") for k in (0, 1, 2))
            known = flat.field(3).to_numpy(zero_copy_only=False)
            order = np.lexsort((x - hi, row))
            row, x, lo, hi, known = (c[order] for c in (row, x, lo, hi, known))
            for buf in buffers(_texts(b), length, segment):
                for p in range(len(buf.at)):
                    i, j = np.searchsorted(row, [buf.row[p], buf.row[p] + 1])
                    start = x[i:j] - hi[i:j]
                    i, j = i + np.searchsorted(start, [buf.offset[p], buf.offset[p] + segment])
                    if i == j:
                        continue
                    first, last = lo[i:j] // step, hi[i:j] // step
                    n = last - first + 1
                    of = np.repeat(np.arange(i, j), n)
                    bucket = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    at = x[of] - buf.offset[p] + buf.at[p]
                    low, high = np.maximum(lo[of], bucket * step), np.minimum(hi[of], bucket * step + step - 1)
                    shared = buf.mark(at - bucket * step, at - bucket * step - step + 1 + length)
                    name = _mix(buf.name(at - high, at - low + length) + (high * 1024 + low).astype("u8"))
                    key = _mix(shared + bucket.astype("u8"))
                    m = len(of)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, dk[buf.row[p]])), pa.array(ids.take(pa.array(np.full(m, buf.row[p])))), pa.array(x[of]), pa.array(low.astype("i2")), pa.array(high.astype("i2")), pa.array(known[of]), pa.array(key.view("i8")), pa.array(name.view("i8"))], schema=pa.schema(_ITEM))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("dk"))


def _ask(docs: DataFrame, items: DataFrame, length: int, step: int, segment: int, name: str, rows: int) -> DataFrame:
    """Cut ``items`` (one list a text) with the texts at hand."""
    lists = items.groupBy("dk").agg(F.collect_list(F.struct("x", "lo", "hi", "known")).alias("items"))
    lists = materialise(lists, name, rows)
    n = lists.agg(F.count("*"), F.sum(F.size("items"))).first()
    small = n[0] <= BROADCAST_TEXTS and (n[1] or 0) <= BROADCAST_ITEMS
    return join_bounded(_keyed(docs), lists, "dk", "inner", 0 if small else 1, 0).mapInArrow(_split(length, step, segment), _ITEM_DDL)


def _decide(rows: DataFrame, order, keep_first: bool, name: str, most: int) -> DataFrame:
    """``rows`` of keys found more than once, with ``repeated`` (by content), ``rep`` (goes on for its content) and ``mixed``."""
    by_name = rows.groupBy("key", "name").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max("known").alias("any_known"))
    by_key = by_name.groupBy("key").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    names = materialise(by_name.join(by_key, "key").where("n > 1 OR kinds > 1").select("name", "n", "first", "any_known", "kinds"), name + "-names", most)
    joined = rows.join(names, "name")
    is_first = order == F.col("first")
    repeated = ~is_first if keep_first else F.col("n") > 1
    return joined.select(*rows.columns, (F.col("known") | repeated).alias("repeated"), is_first.alias("rep"), (F.col("kinds") > 1).alias("mixed"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, step: int = STEP, segment: int = SEGMENT) -> DataFrame:
    """``dk, s, e``: first and last start of runs of repeated windows in the text with key ``dk``."""
    if length < 2 * GRAM or length > 1000:
        raise ValueError(f"length must be between {2 * GRAM} and 1000")
    # Positions order a text's windows; ids order texts. Without keep_first any order of the rows serves.
    order = F.struct("doc_id", "dk", (F.col("x") - F.col("hi")).alias("s")) if keep_first else F.xxhash64("dk", "x", "hi")
    start = [(F.col("x") - F.col("hi")).alias("s"), (F.col("x") - F.col("lo")).alias("e")]

    with temporary(docs.sparkSession) as keep, arrow_rows(docs.sparkSession, ARROW_ROWS):
        runs = materialise(_keyed(docs).mapInArrow(_runs(length, segment), _RUN_DDL).withColumn("known", F.lit(False)), "runs")
        n = runs.count()
        one = materialise(_decide(runs, order, keep_first, "runs", n), "runs-decided", n)
        spans = one.where("repeated").select("dk", *start)

        asked = one.where("mixed AND rep").withColumn("known", F.col("repeated"))
        buckets = materialise(_ask(docs, asked, length, step, segment, "run-lists", n), "buckets")
        n = buckets.count()
        two = materialise(_decide(buckets, order, keep_first, "buckets", n), "buckets-decided", n)
        spans = spans.unionByName(two.where("repeated AND NOT known").select("dk", *start))

        asked = two.where("mixed AND rep").withColumn("known", F.col("repeated"))
        single = materialise(_ask(docs, asked, length, 1, segment, "bucket-lists", n).drop("key"), "windows")
        names = single.groupBy("name").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1")
        three = single.where("NOT known").join(names, "name")
        three = three.where(order != F.col("first")) if keep_first else three
        spans = spans.unionByName(three.select("dk", *start))
        return keep(materialise(joined_spans(spans, length), "spans"))


def joined_spans(spans: DataFrame, length: int) -> DataFrame:
    """Spans of a text whose windows overlap or touch, made one; a text's spans are sorted among themselves only."""
    by_start = Window.partitionBy("dk").orderBy("s")
    before = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("s") > before + length, F.lit(True))
    islands = spans.withColumn("begins", begins).withColumn("island", F.sum(F.col("begins").cast("int")).over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("dk", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def _cut(length: int, text_out: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if text_out else [])]

    def run(batches):
        begin("repeats")
        for b in _slices(batches):
            out: list[list] = [[], [], [], [], []]
            for text, spans in zip(_texts(b), b.column("spans").to_pylist()):
                kept, removed, n = [], 0, 0
                end = 0
                for s, e in sorted((x["s"], x["e"] + length) for x in spans or ()):
                    if s > end or not n:
                        kept.append(text[end:s])
                        n += 1
                        removed += e - s
                        end = e
                    elif e > end:
                        removed += e - end
                        end = e
                kept.append(text[end:])
                rest = b"".join(kept)
                for column, value in zip(out, (len(text), removed, n, hashlib.sha256(rest).hexdigest(), rest)):
                    column.append(value)
            arrays = [b.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = True, text_out: bool = True, segment: int = SEGMENT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and with ``text_out`` the bytes that are ``kept``."""
    spark = docs.sparkSession
    with temporary(spark) as keep:
        rows = _keyed(docs)
        if keep_first:
            several = rows.groupBy("dk").agg(F.count("*").alias("n")).where("n > 1")
            several = keep(materialise(several, "repeated-rows"))
            n = several.count()
            if n:
                again = join_bounded(rows, several, "dk", "inner", n, BROADCAST_TEXTS).groupBy("dk", "doc_id", "text").agg(F.first("n").alias("n"))
                again = keep(materialise(again, "repeated-texts"))
                rows = join_bounded(rows, several, "dk", "left_anti", n, BROADCAST_TEXTS).unionByName(again.select(*rows.columns))
        spans = repeated_spans(rows.select("doc_id", "text"), length, keep_first, segment=segment)
        total = spans.count()
        lists = spans.groupBy("dk").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
        lists = keep(materialise(lists, "span-lists", total))
        texts = lists.count()
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if text_out else "")
    small = texts <= BROADCAST_TEXTS and total <= BROADCAST_ITEMS
    out = join_bounded(rows, lists, "dk", "left", 0 if small else 1, 0)
    if keep_first and n:
        # A repeated row is a copy from its first byte to its last.
        long = F.octet_length("text") >= length
        whole = F.array(F.struct(F.lit(0).cast("long").alias("s"), (F.octet_length("text") - length).cast("long").alias("e")))
        copies = again.withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))))
        out = out.unionByName(copies.select(*rows.columns, F.when(long, whole).alias("spans")))
    return out.mapInArrow(_cut(length, text_out), ddl)


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, what is removed of it, and the digest of what is left."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_first=False, text_out=False)
