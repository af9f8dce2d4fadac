"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

Trusted text is all text of labelled documents (quality 1, not toxic) of each language; a fifth of its documents is held
out. A document is rejected when its perplexity under its language's model is above a language-specific threshold: a quantile
over all held-out trusted documents, times a margin. Short texts say little, so the mean log probability is shrunk towards
the language's mean over held-out trusted text, as if PRIOR_WORDS such words stood in every document.

Counts and scores are joins on shards of the middle word of a trigram, so that a trigram meets its count, its two contexts
and its bigram in one shard:

1. Words of trusted text are counted and numbered by frequency. The numbers of the VOCABULARY most frequent words are
   broadcast. Any other word has 63 bits of its hash as its number, and what trusted text tells of it stands in that number's
   shard; such words that fill many positions of the documents are looked up first and broadcast with the frequent ones.
2. Trigrams of trusted text go to their shard, counted by batch; a shard adds them up, keeps a table of its trigrams and
   tells how many contexts each word follows. Discounts and the lowest order follow from those sums.
3. Trigrams of all documents go to the same shards and meet the tables; a shard returns the sum of log probabilities of its
   part of each text, and the sums of a batch of texts are added up. Where the last word is none of those broadcast, the
   shard returns the two shares of its probability, and the shard of the last word adds its lowest order. Texts are dealt to
   ROUNDS parts by a hash, one after the other, so that the exchange of one part alone takes disk at a time.

Rows of all exchanges are packed batches: numbers of words, byte by byte, compressed; of copies of a text one asks. A middle word that fills more than
SHARD_WORDS positions is dealt to several shards, with a copy of its table in each.

Defined cases: a null language is a language of its own; a language without trained text is scored by the pooled model of
all trusted text that is not held out; of trusted rows with one doc_id the one with the smallest hash of language and text
counts; a text without words has no perplexity and is rejected; repeated rows are scored each; without any trusted text
nothing is rejected but texts without words; empty tables give no rows; other columns pass through ``classify``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import free_name, join_bounded, unit_hash, words
from siftwell.llm.token_output import array_batches
from siftwell.llm.wordlists import hashed_words
from siftwell.llm.worker import begin
from siftwell.sources.scratch import arrow_rows, materialise, release, table, temporary

HELD_OUT = 5
QUANTILE = 0.99
MARGIN = 1.5
PRIOR_WORDS = 25
SEED = "trusted-1"
POOLED = "*"
#: Words whose numbers are broadcast, at 20 bytes each (28 with a worker's index); all others are looked up in shards.
VOCABULARY = 1 << 22
#: Positions that one shard holds, about.
SHARD_WORDS = 4_000_000
#: Characters of a word with its space, for the number of shards alone.
WORD_CHARS = 6
#: Words of a range of word numbers that is summed together.
RANGE = 1 << 13
#: Rows of an Arrow batch with texts, and bytes of texts whose words are told apart together.
ARROW_ROWS, SLICE_BYTES = 2000, 4 << 20
#: Ids of trusted documents and sums of texts (8 and 24 bytes each) that may be broadcast; beyond it the joins shuffle.
BROADCAST_IDS = 2_000_000
#: Parts of the texts that are scored one after the other: the positions of one part are exchanged at a time.
ROUNDS = 2
#: Packed rows that a shard answers together, and positions that it sends on together to shards of last words.
TOGETHER, SENT_ON = 16, 500_000
#: Probability of a word where nothing is known at all.
NOTHING = 1e-9

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * _M[0] + b * _M[1]
    return (x ^ (x >> np.uint64(32))) * _M[2]


def lang_key(lang: str | None) -> str:
    return "\x00" if lang is None else lang


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def text_key() -> Column:
    """What a score depends on: language and text."""
    return F.xxhash64(F.coalesce("lang", F.lit(lang_key(None))), F.coalesce("text", F.lit("")))


def trusted_text(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``model_lang, text, n, text_key, held_out`` of all trusted documents with words.

    Held out is a fifth by a hash of doc_id; of a language with HELD_OUT documents or more, one at least.
    """
    good = materialise(labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id").distinct(), "trusted-ids")
    own = docs.select("doc_id", F.coalesce("lang", F.lit(lang_key(None))).alias("model_lang"), "text", text_key().alias("text_key"))
    own = join_bounded(own, good, "doc_id", "left_semi", good.count(), BROADCAST_IDS).where(F.col("text").rlike(r"[^ \t-\r]"))
    again = materialise(own.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if n := again.count():
        once = join_bounded(own, again, "doc_id", "left_semi", n, BROADCAST_IDS).groupBy("doc_id").agg(F.min(F.struct("text_key", "model_lang", "text")).alias("r"))
        own = join_bounded(own, again, "doc_id", "left_anti", n, BROADCAST_IDS).unionByName(once.select("doc_id", "r.model_lang", "r.text", "r.text_key"))
    own = own.withColumn("h", unit_hash(F.lit(SEED), F.col("doc_id")))
    least = materialise(own.groupBy("model_lang").agg(F.min("h").alias("least"), F.count("*").alias("docs")), "least")
    held = (F.col("h") * HELD_OUT < 1) | ((F.col("docs") >= HELD_OUT) & (F.col("h") == F.col("least")))
    return own.join(F.broadcast(least), "model_lang").select("model_lang", "text", F.size(words(F.col("text"))).alias("n"), "text_key", held.alias("held_out"))


# --- words and packed numbers

def _text_slices(batches):
    """Record batches of bounded bytes, texts without nulls apart, cut by language."""
    for b in batches:
        texts, langs = b.column("text").fill_null(""), b.column("lang").fill_null(lang_key(None)).dictionary_encode()
        for i, j in array_batches(texts, SLICE_BYTES):
            of = langs.indices.slice(i, j - i)
            for k in pc.unique(of).to_pylist():
                at = pa.array(i + np.flatnonzero(of.to_numpy() == k))
                yield b.take(at), texts.take(at), langs.dictionary[k].as_py()
        pa.default_memory_pool().release_unused()


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, each compressed on its own; a plane of zeros takes no room."""
    size = 8 if numbers.max(initial=0) >= 1 << 32 else 4
    planes = np.ascontiguousarray(numbers.astype(f"<u{size}").view("u1").reshape(-1, size).T)
    blobs = [pa.compress(x, codec="zstd", asbytes=True) if x.any() else b"" for x in planes]
    return bytes([size]) + np.asarray([len(x) for x in blobs], "<u4").tobytes() + b"".join(blobs)


def unpack(blob: bytes, n: int) -> np.ndarray:
    size = blob[0]
    out, at = np.zeros((n, size), "u1"), 1 + 4 * size
    for k, m in enumerate(np.frombuffer(blob, "<u4", size, 1).tolist()):
        if m:
            out[:, k] = np.frombuffer(pa.decompress(blob[at : at + m], n, codec="zstd"), "u1")
        at += m
    return out.view(f"<u{size}").ravel()


def steps(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of pairs in order: of the first numbers, and of the second ones among equal first ones."""
    same = np.concatenate([[False], major[1:] == major[:-1]])
    return np.diff(major, prepend=np.zeros(1, major.dtype)), np.where(same, minor - np.concatenate([minor[:1], minor[:-1]]), minor)


def unstep(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    major, minor = major.astype("i8"), minor.astype("i8")
    if not len(major):
        return major, minor
    first = np.flatnonzero(np.concatenate([[True], major[1:] != 0]))
    total = np.cumsum(minor)
    return np.cumsum(major), total - np.repeat(total[first] - minor[first], np.diff(np.append(first, len(major))))


# --- the vocabulary


def _word_keys(lang: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of language and word of all words, and the number of words of each text."""
    hashes, n = hashed_words(texts)
    return _mix(np.full(1, _hash(lang), "u8"), hashes), n


def _word_counts(batches):
    begin("classifier")
    for _, texts, lang in _text_slices(batches):
        key, n = np.unique(_word_keys(lang, texts)[0], return_counts=True)
        if len(key):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view("i8")), pa.array(n)], ["lang", "word", "n"])


def model_of(lang: str, langs) -> str:
    """The language whose model scores ``lang``."""
    return lang if lang in langs else POOLED if POOLED in langs else min(langs)


def _frequent(shared, langs, a_byte: float):
    """Words that are none of those broadcast and stand in a slice of texts ``a_byte`` times or more for each of its bytes."""

    def run(batches):
        begin("classifier")
        for _, texts, lang in _text_slices(batches):
            lang = model_of(lang, langs)
            key, n = np.unique(_word_keys(lang, texts)[0], return_counts=True)
            often = n >= a_byte * (pc.sum(pc.binary_length(texts)).as_py() or 0)
            key, n = key[often], n[often]
            new = ~_find((shared.value, np.ones(len(shared.value), bool)), key, False)
            if new.any():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * int(new.sum()), pa.string()), pa.array(key[new].view("i8")), pa.array(n[new])], ["lang", "word", "n"])

    return run


class Index:
    """Values of distinct keys that are hashes: the high bits of a key tell where to begin in the sorted keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, absent):
        order = np.argsort(keys)
        bits = max(len(keys).bit_length(), 1)
        self.shift = np.uint64(64 - bits)
        # The last key ends every search.
        self.keys = np.append(keys[order], np.uint64((1 << 64) - 1))
        self.values = np.append(values[order], np.asarray([absent], values.dtype))
        self.absent = self.values[-1]
        self.start = np.zeros(1 << bits, "u4" if len(keys) < 1 << 32 else "u8")
        np.cumsum(np.bincount((keys >> self.shift).astype("i8"), minlength=1 << bits)[:-1], out=self.start[1:])

    def find(self, key: np.ndarray) -> np.ndarray:
        i = self.start[(key >> self.shift).astype("i8")].astype("i8")
        at = self.keys[i]
        later = np.flatnonzero(at < key)
        while len(later):
            i[later] += 1
            at[later] = self.keys[i[later]]
            later = later[at[later] < key[later]]
        return np.where(at == key, self.values[i], self.absent)


class Numbering:
    """Numbers of words: those of the vocabulary, then for each language one for the begin of a text and one for words unseen;
    from ``base`` on numbers by hash, where trusted text has other words than the vocabulary (``rest``)."""

    def __init__(self, keys: np.ndarray, langs: dict[str, int], rest: bool = False, unseen: list[tuple[str, int]] = ()):
        """``keys``: hashes of language and word in the order of their numbers; ``unseen``: language and hash of words that
        trusted text is known not to have."""
        self.size, self.langs, self.rest = len(keys), langs, rest
        self.base = self.size + 2 * len(langs)
        self.bits = 64 if rest else self.base.bit_length()
        keys = np.concatenate([keys, np.asarray([k for _, k in unseen], "i8").view("u8")])
        ids = np.concatenate([np.arange(self.size), np.asarray([self.unseen(lang) for lang, _ in unseen], "i8")])
        self.keys, self.ids, self.index = keys, ids.astype("u4"), None

    def begin(self, lang: str) -> int:
        return self.size + self.langs[lang]

    def unseen(self, lang: str) -> int:
        return self.size + len(self.langs) + self.langs[lang]

    def of_texts(self, lang: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words, two begins before each text, and the number of words of each text."""
        if self.index is None:
            # A worker's own, so that it is not broadcast.
            self.index = Index(self.keys, self.ids, (1 << 32) - 1)
            self.keys = self.ids = None
        asked, n = _word_keys(lang, texts)
        ids = self.index.find(asked)
        absent = np.flatnonzero(ids == self.index.absent)
        if self.rest:
            ids = ids.astype("i8")
            ids[absent] = (asked[absent] % np.uint64((1 << 63) - self.base)).astype("i8") + self.base
        else:
            ids[absent] = self.unseen(lang)
        out = np.full(int(n.sum()) + 2 * len(n), self.begin(lang), ids.dtype)
        out[_positions(n)] = ids
        return out, n


def _positions(n: np.ndarray) -> np.ndarray:
    """Where the words stand in a stream with two leading begins a text."""
    return np.arange(int(n.sum())) + 2 * (np.repeat(np.arange(len(n)), n) + 1)


class Vocabulary:
    """The numbering, and of each number its language and how often it stands in trusted text."""

    def __init__(self, counts: pa.Table, starts: dict[str, int], rest: bool, frequent: list[tuple[str, int, int]]):
        """``counts``: language, hash and count of the words, numbered by count; ``starts``: texts of each language; ``rest``:
        whether ``counts`` leaves words out; ``frequent``: language, hash and count in documents of words that may be in neither."""
        names = sorted(starts)
        langs = {lang: k for k, lang in enumerate(names)}
        key, n = counts.column("word").to_numpy().view("u8"), counts.column("n").to_numpy()
        order = np.lexsort((key, -n))
        known = dict(zip(key[order].view("i8").tolist(), range(len(key)))) if frequent else {}
        self.numbering = Numbering(key[order], langs, rest, [(lang, word) for lang, word, _ in frequent if word not in known])
        self.asked = {known[word]: times for _, word, times in frequent if word in known}
        own = pa.chunked_array(counts.column("lang"), pa.string()).combine_chunks().dictionary_encode()
        of_word = np.asarray([langs[x] for x in own.dictionary.to_pylist()], "u4")[own.indices.to_numpy()[order]] if len(key) else np.zeros(0, "u4")
        sides = np.arange(len(names), dtype="u4")
        self.lang = np.concatenate([of_word, sides, sides]).astype("u2" if len(names) < 1 << 16 else "u4")
        self.n = np.concatenate([n[order], [starts[x] for x in names], np.zeros(len(names))]).astype("i8")


def vocabulary(train: DataFrame, asked: DataFrame, n_asked: int) -> Vocabulary:
    """Numbers of the words of ``train`` (``lang, text``), to be looked up for ``asked``, texts of ``n_asked`` bytes."""
    spark = train.sparkSession
    counts = train.mapInArrow(_word_counts, "lang string, word long, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    with temporary(spark):
        counts = materialise(counts, "word-counts")
        least, total = 1, 0
        for n, types in sorted(counts.groupBy("n").agg(F.count("*").alias("types")).collect(), reverse=True):
            total += types
            if total > VOCABULARY:
                least = n + 1
                break
        starts = {r[0]: r[1] for r in train.where(F.col("text").rlike(r"[^ \t-\r]")).groupBy("lang").count().collect()}
        hot, frequent = counts.where(F.col("n") >= least).toArrow(), []
        if least > 1 and n_asked >= SHARD_WORDS:
            # Slices leave out less than half of SHARD_WORDS positions of a word; few words can have the other half.
            shared = spark.sparkContext.broadcast(np.sort(hot.column("word").to_numpy().view("u8")))
            found = asked.mapInArrow(_frequent(shared, set(starts), SHARD_WORDS / (2 * n_asked)), "lang string, word long, n long")
            found = materialise(found.groupBy("lang", "word").agg(F.sum("n").alias("asked")).where(F.col("asked") >= SHARD_WORDS / 2), "frequent")
            frequent = [tuple(r) for r in found.collect()]
            hot = pa.concat_tables([hot, counts.join(F.broadcast(found.select("word")), "word").select(*counts.columns).toArrow().cast(hot.schema)])
            shared.unpersist()
        return Vocabulary(hot, starts, least > 1, frequent)


# --- counts


def _rows(shard: np.ndarray, columns: list[np.ndarray]) -> list[pa.Array]:
    """For each run of ``shard``, which is sorted: the shard, how many numbers stand in it, and the packed columns."""
    first = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    cut = [*zip(first.tolist(), [*first[1:].tolist(), len(shard)])]
    return [pa.array(shard[first], pa.int64()), pa.array([j - i for i, j in cut], pa.int64()), *(pa.array([pack(x[i:j]) for i, j in cut], pa.binary()) for x in columns)]


def _trigrams(shared, shards: int):
    """Counted trigrams of a slice of texts, one packed row a shard."""

    def run(batches):
        begin("classifier")
        numbering, shards_ = shared.value, np.uint32(shards)
        for _, texts, lang in _text_slices(batches):
            ids, n = numbering.of_texts(lang, texts)
            at = _positions(n)
            if not len(at):
                continue
            a, b, c = (ids[at - k] for k in (2, 1, 0))
            order = np.lexsort((c, a, b // shards_, b % shards_))
            a, b, c = a[order], b[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])]))
            count = np.diff(np.append(first, len(a)))
            a, b, c = a[first], b[first], c[first]
            shard, b = (b % shards_).astype("i8"), b // shards_
            new = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
            db, da = steps(b, a)
            db[new], da[new] = b[new], a[new]
            rows = _rows(shard, [da, db, c, count])
            yield pa.RecordBatch.from_arrays([*rows, pa.array([numbering.langs[lang]] * len(rows[0]), pa.int64())], ["shard", "m", "a", "b", "c", "count", "lang"])

    return run


def _keys(bits: int, *numbers: np.ndarray) -> np.ndarray:
    """One 64-bit key for a tuple of numbers: in their order where ``bits`` for each leave room, else a hash. What is asked may
    have smaller numbers than the table, so the choice must not follow the numbers at hand."""
    fits = bits * len(numbers) <= 64
    key = numbers[0].astype("u8")
    for x in numbers[1:]:
        key = key << np.uint64(bits) | x.astype("u8") if fits else _mix(key, x.astype("u8"))
    return key


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key in the order of the keys, and the number of the key at each place."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.concatenate([np.ones(min(len(key), 1), bool), ordered[1:] != ordered[:-1]])
    of = np.empty(len(key), "i8")
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _unpacked(rows: pa.Table) -> list[np.ndarray]:
    """``a, b, c, count`` of packed rows; ``b`` without its shard."""
    out: list[list] = [[np.zeros(0, "i8")] for _ in range(4)]
    for m, *blobs in zip(*(rows.column(x).to_pylist() for x in ("m", "a", "b", "c", "count"))):
        a, b, c, count = (unpack(x, m) for x in blobs)
        b, a = unstep(b, a)
        for column, values in zip(out, (a, b, c.astype("i8"), count.astype("i8"))):
            column.append(values)
    return [*map(np.concatenate, out)]


_TABLE = pa.schema([(x, pa.int64()) for x in ("shard", "copies", "m")] + [(x, pa.binary()) for x in ("a", "b", "c", "count", "langs")] + [(x, pa.int64()) for x in ("lang", "k", "n", "part", "rest")])
_TABLE_DDL = "shard long, copies long, m long, a binary, b binary, c binary, count binary, langs binary, lang long, k long, n long, part long, rest long"


def _added_up(shards: int, base: int, bits: int, copies: dict[int, int]):
    """A shard's table: its trigrams (words of several shards in a row each), counts of counts (``k``: ten times the order and
    the count), and by ranges of words (``part``), or by shards of numbers from ``base`` on (``rest``), how many contexts each
    word follows."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        begin("classifier")
        shard = key[0].as_py()
        a, b, c, count = _unpacked(rows)
        lang = np.repeat(rows.column("lang").to_numpy(), rows.column("m").to_numpy())
        first, of = _distinct(_keys(bits, b, a, c))
        count = np.bincount(of, count, len(first)).astype("i8")
        a, b, c, lang = a[first], b[first], c[first], lang[first]
        if bits * 3 > 64:  # Keys that are hashes do not keep the order.
            order = np.lexsort((c, a, b))
            a, b, c, lang, count = a[order], b[order], c[order], lang[order], count[order]
        word = b * shards + shard
        out: list[dict] = []
        heavy = [x for x in copies if x % shards == shard]
        for x in [None, *heavy]:
            at = np.flatnonzero(~np.isin(word, heavy) if x is None else word == x)
            if len(at):
                db, da = steps(b[at], a[at])
                out.append({"shard": shard, "copies": copies.get(x, 1), "m": len(at)} | {k: pack(v) for k, v in (("a", da), ("b", db), ("c", c[at]), ("count", count[at]), ("langs", lang[at]))})
        second, of = _distinct(_keys(bits, b, c))
        for order_, l, n in ((3, lang, count), (2, lang[second], np.bincount(of, minlength=len(second)))):
            for x in np.unique(l).tolist():
                times = np.bincount(np.minimum(n[l == x], 5), minlength=6)
                out += [{"lang": x, "k": 10 * order_ + i, "n": int(times[i])} for i in (1, 2, 3, 4) if times[i]]
        follower, at, times = np.unique(c[second], return_index=True, return_counts=True)
        lang, rest = lang[second][at], follower >= base
        for part in np.unique(follower[~rest] // RANGE).tolist():
            at = follower // RANGE == part
            at &= ~rest
            dense = np.zeros(RANGE, "u4")
            dense[follower[at] % RANGE] = times[at]
            out.append({"part": part, "c": pack(dense)})
        follower, lang, times = follower[rest], lang[rest], times[rest]
        order = np.argsort(follower % shards, kind="stable")
        columns = _rows((follower % shards)[order], [x[order] for x in (follower // shards, times, lang)]) if len(order) else []
        out += [dict(zip(("rest", "m", "c", "count", "langs"), x)) for x in zip(*(x.to_pylist() for x in columns))]
        return pa.Table.from_pylist(out, schema=_TABLE)

    return run


_REST = pa.schema([("shard", pa.int64()), ("m", pa.int64()), ("c", pa.binary()), ("count", pa.binary()), ("lang", pa.int64()), ("k", pa.int64()), ("n", pa.int64())])
_REST_DDL = "shard long, m long, c binary, count binary, lang long, k long, n long"


def _rest_words(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """A shard's words that are not broadcast, with how many contexts each follows; and of each language how many words they
    are (``k`` 0), how many of them follow 1 to 4 contexts, and how many contexts they follow in all (``k`` 5)."""
    m = rows.column("m").to_pylist()
    c, count, lang = (np.concatenate([unpack(x, k) for x, k in zip(rows.column(name).to_pylist(), m)]).astype("i8") for name in ("c", "count", "langs"))
    first, of = _distinct(c)
    c, lang, count = c[first], lang[first], np.bincount(of, count, len(first)).astype("i8")
    out: list[dict] = [{"shard": key[0].as_py(), "m": len(c), "c": pack(np.diff(c, prepend=0)), "count": pack(count)}]
    for x in np.unique(lang).tolist():
        own = count[lang == x]
        out += [{"lang": x, "k": k, "n": n} for k, n in [(0, len(own)), *((i, int((own == i).sum())) for i in (1, 2, 3, 4)), (5, int(own.sum()))]]
    return pa.Table.from_pylist(out, schema=_REST)


def _range_sums(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(unpack(blob, RANGE).astype("i8") for blob in rows.column("c").to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "c": pa.array([total.tobytes()], pa.binary())})


def _discounts(n: list[float]) -> list[float]:
    """Discounts of counts 0, 1, 2 and 3 or more, from the counts of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [0.0, *(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0) if n[k - 1] and n[0] else 0.5 for k in (1, 2, 3))]


def _lowest_order(v: Vocabulary, follows: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Probability of every number by the lowest order: a discounted share and an even share of what is held back; and of each
    language what gives those of the words by hash: discounts, contexts in all, even share.

    ``rest``: of each language the sums of ``_rest_words``.
    """
    p, langs = np.full(len(v.lang), NOTHING), len(v.numbering.langs)
    discounts, totals, evens = np.zeros((langs, 4)), np.ones(langs), np.full(langs, NOTHING)
    for lang, k in v.numbering.langs.items():
        own = np.flatnonzero((v.lang == k) & (follows > 0))
        n = follows[own]
        times = [float((n == i).sum() + rest[k, i]) for i in (1, 2, 3, 4)]
        discounts[k] = d = np.asarray(_discounts(times))
        if words_ := len(own) + rest[k, 0]:
            totals[k] = n.sum() + rest[k, 5]
            evens[k] = (d[1] * times[0] + d[2] * times[1] + d[3] * (words_ - times[0] - times[1])) / totals[k] / (words_ + 1)
        p[v.numbering.unseen(lang)] = evens[k]
        p[own] = (n - d[np.minimum(n, 3)]) / totals[k] + evens[k]
    return p.astype("f4"), (discounts, totals, evens)


class Model:
    """The vocabulary, the lowest order, the discounts ``[order, language, count]``, and the written tables of the shards."""

    def __init__(self, train: DataFrame, asked: DataFrame, n_asked: int, n_trained: int, shards: int):
        spark = train.sparkSession
        v = vocabulary(train, asked, n_asked)
        self.shards, self.langs, self.rest, self.bits = shards, v.numbering.langs, v.numbering.rest, v.numbering.bits
        #: Numbers of words unseen, and the first number by hash.
        self.unseen, self.base = v.numbering.size + len(self.langs), v.numbering.base
        times = v.n * (n_asked / n_trained)
        for x, n in v.asked.items():
            times[x] = max(times[x], n)
        self.copies = {int(x): 1 + int(times[x] / SHARD_WORDS) for x in np.flatnonzero(times >= SHARD_WORDS)}
        self.numbering = spark.sparkContext.broadcast(v.numbering)
        grams = train.mapInArrow(_trigrams(self.numbering, shards), "shard long, m long, a binary, b binary, c binary, count binary, lang long")
        self.tables = materialise(grams.groupBy("shard").applyInArrow(_added_up(shards, self.base, self.bits, self.copies), _TABLE_DDL), "trigrams")
        del grams
        release(spark)
        discounts, n = np.zeros((4, len(self.langs), 4)), {}
        for l, k, times in self.tables.where("k IS NOT NULL").groupBy("lang", "k").agg(F.sum("n")).collect():
            n[k // 10, l, k % 10] = float(times)
        for order in (2, 3):
            for l in range(len(self.langs)):
                discounts[order, l] = _discounts([n.get((order, l, i), 0.0) for i in (1, 2, 3, 4)])
        follows = np.zeros((len(v.lang) // RANGE + 1) * RANGE, "i8")
        for part, blob in self.tables.where("part IS NOT NULL").groupBy("part").applyInArrow(_range_sums, "part long, c binary").collect():
            follows[part * RANGE : (part + 1) * RANGE] = np.frombuffer(blob, "i8")
        rest = np.zeros((len(self.langs), 6), "i8")
        if self.rest:
            self.rest_words = materialise(self.tables.where("rest IS NOT NULL").groupBy("rest").applyInArrow(_rest_words, _REST_DDL), "rest-words")
            for l, k, times in self.rest_words.where("k IS NOT NULL").groupBy("lang", "k").agg(F.sum("n")).collect():
                rest[l, k] = times
        low, shares = _lowest_order(v, follows[: len(v.lang)], rest)
        self.values, self.shares = spark.sparkContext.broadcast((low, discounts)), shares


# --- scores

_ASKED = pa.schema([("shard", pa.int64()), ("m", pa.int64()), *((x, pa.binary()) for x in ("a", "b", "c", "text", "off")), ("chunk", pa.int64()), ("lang", pa.int64())])
_ASKED_DDL = "shard long, m long, a binary, b binary, c binary, text binary, off binary, chunk long, lang long"


def _asked(model: Model):
    """Trigrams of a chunk of texts, one packed row a shard; before them a row with the keys and word counts of the texts and
    the sums for words behind one that trusted text has not: the lowest order alone tells of these."""
    shared, values, shards, copies, langs, unseen, base = model.numbering, model.values, model.shards, model.copies, model.langs, model.unseen, model.base
    heavy = np.asarray(sorted(copies), "i8")
    many = np.asarray([copies[x] for x in sorted(copies)], "i8")

    def run(batches):
        begin("classifier")
        numbering, chunk = shared.value, TaskContext.get().partitionId() << 32
        for b, texts, lang in _text_slices(batches):
            lang = model_of(lang, langs)
            ids, n = numbering.of_texts(lang, texts)
            at, text = _positions(n), np.repeat(np.arange(len(n)), n)
            alone = (ids[at - 1] >= unseen) & (ids[at - 1] < base) & (ids[at] < base)
            sums = np.bincount(text[alone], np.log(values.value[0][ids[at[alone]]].astype("f8")), len(n))
            head = np.stack([b.column("text_key").to_numpy(), n]).astype("<i8").tobytes() + sums.astype("<f8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip([chunk % shards, None, head, None, None, None, None, chunk, None], _ASKED)], schema=_ASKED)
            at, text = at[~alone], text[~alone]
            if len(at):
                first, middle, last = (ids[at - k] for k in (2, 1, 0))
                # Words unseen have no table: any shard answers.
                turn = np.arange(len(at)) + chunk
                off = np.where((middle >= unseen) & (middle < base), turn % shards, 0)
                if len(heavy):
                    i = np.minimum(np.searchsorted(heavy, middle), len(heavy) - 1)
                    off = np.where(heavy[i] == middle, turn % many[i], off)
                shard = (middle + off) % shards
                # Numbers of 16 bits are sorted by radix.
                order = np.argsort(shard.astype("u2") if shards <= 1 << 16 else shard, kind="stable")
                shard, text = shard[order], text[order]
                # Numbers of texts ascend within a shard; their steps are small.
                step = np.where(np.concatenate([[True], shard[1:] != shard[:-1]]), text, np.diff(text, prepend=0))
                rows = _rows(shard, [first[order], middle[order] // np.uint32(shards), last[order], step, off[order]])
                yield pa.RecordBatch.from_arrays([*rows, *(pa.array([x] * len(rows[0]), pa.int64()) for x in (chunk, langs[lang]))], schema=_ASKED)
            chunk += 1

    return run


def _scattered(key: np.ndarray) -> np.ndarray:
    """A different number for each key, with even high bits."""
    return _mix(key, np.zeros(1, "u8"))


def _find(table: tuple[np.ndarray, np.ndarray], key: np.ndarray, absent: float) -> np.ndarray:
    at, value = table
    if not len(at):
        return np.full(len(key), absent)
    i = np.minimum(np.searchsorted(at, key), len(at) - 1)
    return np.where(at[i] == key, value[i], absent)


class _Shard:
    """Discounted shares of trigrams and bigrams and weights of their contexts, by keys; ``b`` is the word in its shard's count."""

    def __init__(self, rows: pa.Table, shards: int, bits: int, discounts: np.ndarray):
        self.bits = bits
        a, b, c, n = _unpacked(rows)
        own, lang = np.repeat(rows.column("shard").to_numpy(), rows.column("m").to_numpy()), np.zeros(0, "i8")
        if len(own):
            lang = np.concatenate([unpack(x, m) for x, m in zip(rows.column("langs").to_pylist(), rows.column("m").to_pylist())])
        b = b * shards + own
        self.three, self.two, _, _ = self._order(n, discounts[3, lang], (b, a, c), (b, a), -1.0)
        at, of = _distinct(_keys(self.bits, b, c))
        b, c, lang = b[at], c[at], lang[at]
        self.pairs, _, first, weight = self._order(np.bincount(of, minlength=len(at)), discounts[2, lang], (b, c), (b,), 1.0)
        self.one = Index(_scattered(b[first].astype("u8")), weight, 1.0)

    def _order(self, n, discounts, gram, context, absent):
        d = discounts[np.arange(len(n)), np.minimum(n, 3)]
        key = _keys(self.bits, *context)
        first, of = _distinct(key)
        total, back = np.bincount(of, n, len(first)), np.bincount(of, d, len(first))
        weight = back / np.maximum(total, 1)
        return Index(_scattered(_keys(self.bits, *gram)), (n - d) / total[of], 0.0), Index(_scattered(key[first]), weight, absent), first, weight

    def shares(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What trigrams and bigrams give to the probability, and the weight that is left to the lowest order."""
        share, left = self.pairs.find(_scattered(_keys(self.bits, b, c))), self.one.find(_scattered(b.astype("u8")))
        weight = self.two.find(_scattered(_keys(self.bits, b, a)))
        known = np.flatnonzero(weight >= 0)
        share[known] *= weight[known]
        left[known] *= weight[known]
        share[known] += self.three.find(_scattered(_keys(self.bits, b[known], a[known], c[known])))
        return share, left


_SENT = ("chunks", "text", "langs", "c", "share", "left")
_SUMS = pa.schema([("chunk", pa.int64()), ("head", pa.binary()), ("m", pa.int64()), ("text", pa.binary()), ("sum", pa.binary()), ("rest", pa.int64()), *((x, pa.binary()) for x in _SENT if x != "text")])
_SUMS_DDL = "chunk long, head binary, m long, text binary, sum binary, rest long, " + ", ".join(f"{x} binary" for x in _SENT if x != "text")


def _summed(chunk: int, text: np.ndarray, log: np.ndarray) -> dict:
    """Sums by text of positions in the order of their texts."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return {"chunk": chunk, "m": len(first), "text": pack(np.diff(text[first], prepend=0)), "sum": np.add.reduceat(log, first).astype("<f4").tobytes()}


def _sent_on(shards: int, waiting: list[list[np.ndarray]]) -> list[dict]:
    """Positions with a last word by hash, one packed row a shard of that word."""
    chunk, text, lang, c, share, left = (np.concatenate(x) for x in zip(*waiting))
    order = np.argsort(c % shards, kind="stable")
    columns = _rows((c % shards)[order], [x[order] for x in (chunk, text, lang, c // shards, share.view("u8"), left.view("u8"))])
    return [dict(zip(("rest", "m", *_SENT), x)) for x in zip(*(x.to_pylist() for x in columns))]


def _answered(model: Model):
    """Sums of log probabilities of one shard's positions, by text of each chunk; and for shards of last words (``rest``) the
    positions whose last word has its number by hash."""
    shared, shards, base, bits = model.values, model.shards, model.base, model.bits

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, rows: pa.Table) -> pa.Table:
        begin("classifier")
        shard, out = key[0].as_py(), []
        low, discounts = shared.value
        table_ = _Shard(rows, shards, bits, discounts)
        waiting: list[list[np.ndarray]] = []
        for t in asked.to_batches(max_chunksize=TOGETHER):
            heads = t.filter(t.column("m").is_null())
            out += [{"chunk": x, "head": y} for x, y in zip(heads.column("chunk").to_pylist(), heads.column("a").to_pylist())]
            t = t.filter(t.column("m").is_valid())
            if not t.num_rows:
                continue
            m = t.column("m").to_pylist()
            a, b, c, off = (np.concatenate([unpack(x, k) for x, k in zip(t.column(name).to_pylist(), m)]).astype("i8") for name in ("a", "b", "c", "off"))
            text = [np.cumsum(unpack(x, k).astype("i8")) for x, k in zip(t.column("text").to_pylist(), m)]
            b = b * shards + (shard - off) % shards
            share, left = table_.shares(a, b, c)
            log, here = np.zeros(len(a)), np.flatnonzero(c < base)
            log[here] = np.log(share[here] + left[here] * low[c[here]])
            out += [_summed(chunk, own, part) for chunk, own, part in zip(t.column("chunk").to_pylist(), text, np.split(log, np.cumsum(m)[:-1]))]
            if len(here) < len(c):
                on = np.flatnonzero(c >= base)
                chunk, lang = (np.repeat(t.column(x).to_numpy(), m) for x in ("chunk", "lang"))
                waiting.append([x[on] for x in (chunk, np.concatenate(text), lang, c, share, left)])
                if sum(len(x[0]) for x in waiting) >= SENT_ON:
                    out += _sent_on(shards, waiting)
                    waiting = []
        out += _sent_on(shards, waiting) if waiting else []
        return pa.Table.from_pylist(out, schema=_SUMS)

    return run


def _rest_answered(model: Model):
    """Sums of log probabilities, by text of each chunk, of the positions that wait for the lowest order of a word by hash."""
    shards, (discounts, totals, evens) = model.shards, model.shares

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, rows: pa.Table) -> pa.Table:
        begin("classifier")
        out: list[dict] = []
        if asked.num_rows:
            m = asked.column("m").to_pylist()
            chunk, text, lang, c, share, left = (np.concatenate([unpack(x, k) for x, k in zip(asked.column(name).to_pylist(), m)]).astype("u8") for name in _SENT)
            at, n = np.zeros(0, "u8"), np.zeros(0, "i8")
            for k, x, y in zip(*(rows.column(name).to_pylist() for name in ("m", "c", "count"))):
                at, n = np.cumsum(unpack(x, k).astype("u8")), unpack(y, k).astype("i8")
            n, lang = _find((at, n), c, 0).astype("i8"), lang.astype("i8")
            low = np.where(n > 0, (n - discounts[lang, np.minimum(n, 3)]) / totals[lang], 0.0) + evens[lang]
            log = np.log(share.view("f8") + left.view("f8") * low.astype("f4"))
            order = np.lexsort((text, chunk))
            chunk, text, log = chunk[order].astype("i8"), text[order].astype("i8"), log[order]
            cut = np.append(np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])), len(chunk)).tolist()
            out = [_summed(int(chunk[i]), text[i:j], log[i:j]) for i, j in zip(cut, cut[1:])]
        return pa.Table.from_pylist(out, schema=pa.schema([*_SUMS][:5]))

    return run


def _text_sums(rows: pa.Table) -> pa.Table:
    """Key, sum of log probabilities and words of each text of a chunk."""
    head = next(x for x in rows.column("head").to_pylist() if x is not None)
    key, n, base = np.frombuffer(head, "<i8").reshape(3, -1)
    total = base.copy().view("<f8")
    for part in sorted((r for r in rows.to_pylist() if r["m"] is not None), key=lambda r: (r["m"], r["text"], r["sum"])):
        total[np.cumsum(unpack(part["text"], part["m"]).astype("i8"))] += np.frombuffer(part["sum"], "<f4")
    return pa.table({"text_key": key, "sum": total, "n": n}).filter(pa.array(n > 0))


def _once(asked: DataFrame) -> DataFrame:
    """``lang, text, text_key`` without most copies of a text: sums are kept by key, and copies only cost room.

    The row with the smallest doc_id asks for all, as long as the list of repeated texts can be broadcast.
    """
    if "doc_id" in asked.columns:
        several = materialise(asked.groupBy("text_key").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).where("n > 1 AND least IS NOT NULL").select("text_key", "least"), "copies")
        if several.count() <= BROADCAST_IDS:
            asked = asked.join(F.broadcast(several), "text_key", "left").where(F.col("least").isNull() | (F.col("least") == F.col("doc_id")))
    return asked.select("lang", "text", "text_key")


def _scored_texts(asked: DataFrame, model: Model, tables: DataFrame) -> DataFrame:
    """``text_key, mean_log, n`` of the texts of ``asked`` that have words."""
    positions = asked.mapInArrow(_asked(model), _ASKED_DDL)
    answered = positions.groupBy("shard").cogroup(tables.groupBy("at")).applyInArrow(_answered(model), _SUMS_DDL)
    if model.rest:
        answered = materialise(answered, "answered")
    sums = answered.where("rest IS NULL").select("chunk", "head", "m", "text", "sum")
    if model.rest:
        words_ = model.rest_words.where("shard IS NOT NULL")
        sent = answered.where("rest IS NOT NULL").groupBy("rest").cogroup(words_.groupBy("shard"))
        sums = sums.unionByName(sent.applyInArrow(_rest_answered(model), "chunk long, head binary, m long, text binary, sum binary"))
    by_text = sums.groupBy("chunk").applyInArrow(_text_sums, "text_key long, sum double, n long")
    # Copies of a text have equal sums.
    return by_text.groupBy("text_key").agg((F.sum("sum") / F.sum("n")).alias("mean_log"), F.max("n").alias("n"))


def likelihoods(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``text_key, mean_log, n``: mean log probability a word, and words, of every text of ``docs`` (``lang, text``) that has words."""
    spark = docs.sparkSession
    train, asked = train.withColumnRenamed("model_lang", "lang"), docs.select("lang", "text", text_key().alias("text_key"), *([] if "doc_id" not in docs.columns else ["doc_id"]))
    chars = lambda d: d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_asked, n_trained = chars(docs), chars(train)
    with temporary(spark) as keep, arrow_rows(spark, ARROW_ROWS):
        if not n_trained:
            none = asked.select("text_key", F.lit(math.log(NOTHING)).alias("mean_log"), F.size(words(F.col("text"))).cast("long").alias("n"))
            return keep(materialise(none.where("n > 0").distinct(), "likelihoods"))
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_asked // (WORD_CHARS * SHARD_WORDS) + 1)
        once = _once(asked)
        model = Model(train, once, n_asked, n_trained, shards)
        # A word of several shards has its table in each of them.
        tables = model.tables.where("shard IS NOT NULL").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
        tables = tables.select(F.pmod(F.col("shard") + F.col("copy"), F.lit(shards)).cast("long").alias("at"), "shard", "m", "a", "b", "c", "count", "langs")
        out = []
        for part in range(ROUNDS):
            out.append(keep(materialise(_scored_texts(once.where(F.pmod("text_key", F.lit(ROUNDS)) == part), model, tables), "likelihoods")))
            release(spark)
        model.numbering.unpersist()
        model.values.unpersist()
        return reduce(DataFrame.unionByName, out)


VERDICT = ("n_words", "perplexity", "threshold", "kept")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN, keep_text: bool = False) -> DataFrame:
    """``docs`` (without its text unless it is kept) and ``n_words, perplexity, threshold, kept`` of every row.

    Columns of ``docs`` that have those names, in any case, stay; the verdict's names are then led by underscores.
    """
    verdict = {v: free_name(docs.columns, v) for v in VERDICT}
    clash: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in (*VERDICT, "text_key", "mean_log", "mean", "model_lang", "n"):
            clash[c] = free_name([*docs.columns, *clash.values()], "_own")
    docs = docs.withColumnsRenamed(clash)
    trusted = trusted_text(docs, labels)
    train = trusted.where("NOT held_out").select("model_lang", "text")
    lang = F.coalesce("lang", F.lit(lang_key(None))).alias("model_lang")
    if not docs.select(lang).distinct().join(train.select("model_lang").distinct(), "model_lang", "left_anti").isEmpty():
        train = train.unionByName(train.withColumn("model_lang", F.lit(POOLED)))
    sums = likelihoods(docs, train)
    held = materialise(trusted.where("held_out").select("model_lang", "text_key").join(sums, "text_key").withColumnRenamed("n", "n_words"), "held-out")
    mean = held.groupBy("model_lang").agg((F.sum(F.col("mean_log") * F.col("n_words")) / F.sum("n_words")).alias("mean"))
    means = {r[0]: r[1] for r in mean.collect()}
    prior = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in means.items()], "model_lang string, mean double")
    pooled_mean = sum(means.values()) / len(means) if means else 0.0
    ppl = F.exp(-(F.col("mean_log") * F.col("n_words") + PRIOR_WORDS * F.coalesce("mean", F.lit(float(pooled_mean)))) / (F.col("n_words") + PRIOR_WORDS))
    limits = held.join(F.broadcast(prior), "model_lang", "left").withColumn("p", ppl)
    by_lang = {r[0]: r[1] * margin for r in limits.groupBy("model_lang").agg(F.percentile("p", quantile)).collect()}
    overall = max(by_lang.values(), default=math.inf)
    limit = prior.join(docs.sparkSession.createDataFrame([(k, float(v)) for k, v in by_lang.items()], "model_lang string, threshold double"), "model_lang")
    keyed = docs.withColumn("text_key", text_key())
    scored = join_bounded(keyed if keep_text else keyed.drop("text"), sums.withColumnRenamed("n", "n_words"), "text_key", "left", sums.count(), BROADCAST_IDS).drop("text_key")
    key = F.coalesce("lang", F.lit(lang_key(None)))
    out = scored.join(F.broadcast(limit), key == F.col("model_lang"), "left").withColumn("threshold", F.coalesce("threshold", F.lit(float(overall))))
    out = out.withColumn("n_words", F.coalesce("n_words", F.lit(0).cast("long"))).withColumn("perplexity", F.when(F.col("n_words") > 0, ppl))
    out = out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
    out = out.select(*[c for c in docs.columns if c in out.columns], *VERDICT).withColumnsRenamed(verdict)
    return out.withColumnsRenamed({v: k for k, v in clash.items()})


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with the columns of ``docs``."""
    flag = free_name(docs.columns, "_siftwell_kept")
    found = classify(docs, labels, keep_text=True)
    return found.toDF(*found.columns[:-1], flag).where(F.col(flag)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, perplexity, the threshold of its language and the verdict."""
    return classify(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), table(spark, sf_dir, "labels"))
