"""Token-ID output: whole texts as Parquet lists of token ids.

Layout of a token file set: rows in ascending doc_id order (nulls first), ``ids`` a dictionary-encoded list of 32-bit
integers, row groups and pages of set size with page indexes (Spark's writer adds column and offset indexes), the metadata
columns apart from the ids so that either can be read alone. ``part`` numbers the files' ranges in order and ``part_start``
counts the ids of the range before the row; the total before a range follows from one small row per range.

Defined cases: a null or empty text has the end id alone; equal doc_ids stand next to each other; an empty table gives empty
files; other columns can be stored beside as metadata, except where they clash with the layout's own names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.tokens import encoder, tokenizer_path
from siftwell.sources.scratch import arrow_rows, scratch_path, table

END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
#: Texts encoded at once, and characters at which a batch is closed early.
BATCH_TEXTS, BATCH_CHARS = 1000, 4 << 20
#: Bytes of text that are encoded together: enough that most of their units are met more than once.
BATCH_BYTES = 3 << 20
#: Rows of an Arrow batch with texts: whole texts are large, and both sides of the pipe hold a batch or two.
ARROW_ROWS = 1000
LAYOUT = ("part", "part_start", "n_tokens", "ids")


def text_batches(texts: list[str]):
    """Slices of at most BATCH_TEXTS texts and about BATCH_CHARS characters."""
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if k + 1 - begin >= BATCH_TEXTS or size >= BATCH_CHARS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def array_batches(texts: pa.Array, most: int = BATCH_BYTES):
    """Slices of at most ``most`` bytes, or of one text that is longer."""
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8"))
    begin = 0
    while begin < len(texts):
        before = int(size[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + most, "right")))
        yield begin, end
        begin = end


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, metadata: tuple[str, ...] = ("doc_id",), row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Encode ``text`` of every row and write the file set. ``doc_id`` must be among the metadata."""
    clash = set(metadata) & {*LAYOUT, "text"}
    if clash or "doc_id" not in metadata:
        raise ValueError(f"metadata must hold doc_id and none of {sorted(clash)}")
    ordered = docs.select(*metadata, "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    fields = [ordered.schema[c] for c in metadata]
    schema = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("part_start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encoded(batches):
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for b in batches:
            texts = b.column("text").fill_null("")
            for i, j in array_batches(texts):
                ids, n = enc.encode_array(texts.slice(i, j - i), end_id)
                ends = np.cumsum(n)
                meta = [b.column(c).slice(i, j - i) for c in metadata]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*meta, pa.array(np.full(j - i, part, "i4")), pa.array(ends - n + before), pa.array(n), lists], [*metadata, *LAYOUT])
                before += int(ends[-1])

    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": PAGE_BYTES, "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": 1 << 20, "compression": "snappy"}
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        ordered.mapInArrow(encoded, schema).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The file set with ``start``: the number of ids of all rows before. Columns that are not used are not read."""
    files = spark.read.parquet(path)
    total, offsets = 0, []
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        offsets.append((part, total))
        total += n
    before = spark.createDataFrame(offsets, "part int, _before long")
    return files.join(F.broadcast(before), "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before", "part", "part_start")


def _list_crc32(batches):
    for b in batches:
        ids = b.column("ids")
        at, raw = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def id_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens`` and the unsigned CRC-32 of the stored ids as little-endian unsigned 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(_list_crc32, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Write ``docs`` as a token file set and read it back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, tokenizer or tokenizer_path())
    return id_digests(read_token_files(spark, path))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and digest in the token files, as read back from them."""
    return token_output(table(spark, sf_dir, "documents"))
