"""Byte-level BPE over whole texts: distinct words of a batch in front of the tokenizers library.

The pre-tokenizer starts a new piece at every space that stands between two characters that are no white space, at both
sides of a line end in such a place, and between a letter and the marks after it. A text can therefore be cut there, each
distinct word encoded once and remembered, and the ids put together again; the result equals the encoding of the whole text
(a test holds the two against each other). Cutting, telling words apart and putting ids together run in Arrow and numpy;
the library sees only words that a worker has not met before, many at a time, and units of any other form.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siftwell.llm.worker import begin

SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: How byte-level vocabularies write a space and a line end.
SPACE, LINE_END = "\u0120", "\u010a"
#: Marks that make a piece of their own after a letter.
MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~"
MEMO_WORDS = 200_000
#: Words that the library gets as one text.
TOGETHER = 20_000


def gathered(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists numbered ``at`` of lists that lie in ``flat`` one after another, and their sizes."""
    n = size[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat((np.cumsum(size) - size)[at] - (ends - n), n) + np.arange(total)], n


class _Memo:
    """Words of letters only with their ids, side by side in arrays."""

    def __init__(self, learn):
        self.learn = learn
        self.words, self.size, self.flat = pa.array([], pa.string()), np.zeros(0, "i8"), np.zeros(0, "<i4")

    def look_up(self, words: pa.Array, most: int) -> np.ndarray:
        """Numbers of ``words``. Beyond ``most`` words the memo keeps those that are asked for."""
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype("i8")
        if len(self.words) > most:
            known = at[at >= 0]
            self.flat, self.size = gathered(self.flat, self.size, known)
            self.words = self.words.take(pa.array(known))
            at[at >= 0] = np.arange(len(known))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.words) + np.arange(len(new))
            words = words.take(pa.array(new))
            flat, size = self.learn(words)
            self.words = pa.concat_arrays([self.words, words])
            self.flat, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        return at


class UnitEncoder:
    """Encodes batches of whole texts; remembers about ``memo`` words of each kind with their ids."""

    def __init__(self, path: str, memo: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer, self.memo = Tokenizer.from_file(path), memo
        made_as = json.loads(self.tokenizer.to_str())
        cut = made_as["pre_tokenizer"] or {}
        if made_as["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("texts can be cut into units only for a byte-level pre-tokenizer without normalizer or prefix space")
        vocabulary = self.tokenizer.get_vocab()
        self.opens, self.width = np.zeros(max(vocabulary.values()) + 1, bool), np.zeros(max(vocabulary.values()) + 1, "i8")
        for token, i in vocabulary.items():
            self.opens[i], self.width[i] = token.startswith(SPACE), len(token)
        self.line_end = vocabulary[LINE_END]
        self.led, self.bare = _Memo(self._learn_led), _Memo(self._learn_bare)
        self.made: dict[str, bytes | None] = {}  # marks and units of any other form; None where one cannot be cut off

    def _joined(self, words: pa.Array, lead: str, between: str):
        """Ids of all words, encoded as texts of many words."""
        out = []
        for k in range(0, len(words), TOGETHER):
            some = words.slice(k, TOGETHER)
            text = lead + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), between)[0].as_py()
            out.append(np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4"))
        return out

    def _learn_led(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Space-led words; each begins at a token that opens with a space."""
        ids = np.concatenate(self._joined(words, " ", " "))
        size = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        if len(size) != len(words):
            raise RuntimeError("the tokenizer does not begin words at spaces")
        return ids, size

    def _learn_bare(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words at the begin of a text or line, learned as lines."""
        flat, size = [], []
        for ids in self._joined(words, "", "\n"):
            ends = np.append(np.flatnonzero(ids == self.line_end), len(ids))
            flat.append(ids[ids != self.line_end])
            size.append(np.diff(ends, prepend=-1) - 1)
        if sum(map(len, size)) != len(words):
            raise RuntimeError("the tokenizer does not cut lines at line ends")
        return np.concatenate(flat), np.concatenate(size)

    def _other(self, texts: list[str]) -> list[bytes | None]:
        """Ids of marks and of units of any form; None for one with white space at a side where it would be cut off."""
        made = self.made
        if len(made) > self.memo // 4:
            made.clear()
        new = [*{t for t in texts if t not in made}]
        cannot = {t for t in new if t and (t[-1].isspace() or (t[0] == " " and t[1].isspace()))}
        made.update(dict.fromkeys(cannot))
        new = [t for t in new if t not in cannot]
        for t, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            made[t] = np.asarray(e.ids, "<i4").tobytes()
        return [made[t] for t in texts]

    def _units(self, units: pa.Array, led: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and sizes of distinct units, and which of them cannot be cut off (these get no ids).

        Most are lines of letters and then marks; a line is looked up as a word and marks.
        """
        cut = pc.split_pattern(units, "\n")
        first = cut.offsets.to_numpy().astype("i8")
        first, lines = first[:-1] - first[0], cut.flatten()
        core = pc.utf8_rtrim(lines, characters=MARKS)
        of = np.repeat(np.arange(len(units)), np.diff(np.append(first, len(lines))))
        plain = np.logical_and.reduceat(pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False), first)
        here = np.flatnonzero(plain[of])
        spaced = np.zeros(len(lines), bool)
        spaced[first] = led
        # Lists to put together: nothing, a line end, words after a space, other words, marks, other units.
        lists = [(np.asarray([self.line_end], "<i4"), np.asarray([0, 1]))]
        entries = np.zeros((len(lines), 3), "i8")
        entries[:, 0] = plain[of]
        entries[first, 0] = 0
        at = 2
        for memo, where in ((self.led, here[spaced[here]]), (self.bare, here[~spaced[here]])):
            words = core.take(pa.array(where)).dictionary_encode()
            entries[where, 1] = at + memo.look_up(words.dictionary, self.memo)[words.indices.to_numpy()]
            lists.append((memo.flat, memo.size))
            at += len(memo.size)
        whole, short = pc.binary_length(lines).to_numpy().astype("i8"), pc.binary_length(core).to_numpy().astype("i8")
        where = here[whole[here] > short[here]]
        begin = lines.offset
        offsets = np.frombuffer(lines.buffers()[1], "<i4")[begin : begin + len(lines)].astype("i8")
        tails, n = _ranges(lines.buffers()[2], offsets[where] + short[where], whole[where] - short[where])
        marks = pa.StringArray.from_buffers(len(where), pa.py_buffer(np.append(0, np.cumsum(n)).astype("<i4")), pa.py_buffer(tails)).dictionary_encode()
        found = self._other(marks.dictionary.to_pylist())
        entries[where, 2] = at + marks.indices.to_numpy()
        odd = np.flatnonzero(~plain)
        found += self._other([(" " if x else "") + u for x, u in zip(led[odd].tolist(), units.take(pa.array(odd)).to_pylist())])
        entries[first[odd], 1] = at + len(marks.dictionary) + np.arange(len(odd))
        cannot = np.zeros(len(units), bool)
        cannot[odd] = [x is None for x in found[len(marks.dictionary) :]]
        found = [x or b"" for x in found]
        lists.append((np.frombuffer(b"".join(found), "<i4"), np.fromiter(map(len, found), "i8", len(found)) >> 2))
        flat, size = gathered(np.concatenate([x for x, _ in lists]), np.concatenate([x for _, x in lists]), entries.ravel())
        return flat, np.add.reduceat(size, 3 * first), cannot

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text with white space beside a space."""
        units = SAFE_SPACE.split(text)
        found = self.tokenizer.encode_batch_fast([units[0], *(" " + u for u in units[1:])], add_special_tokens=False)
        return np.concatenate([np.asarray(e.ids, "<i4") for e in found])

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts one after another, ``end_id`` behind each, and the number of ids of each text."""
        if not len(texts):
            return np.zeros(0, "<i4"), np.zeros(0, "i8")
        cut = pc.split_pattern(texts, " ")
        first = cut.offsets.to_numpy().astype("i8")
        first, kinds = first[:-1] - first[0], cut.flatten().dictionary_encode()
        place, names = kinds.indices.to_numpy().astype("i8"), kinds.dictionary
        # The first unit of a text has no space before it and is looked up apart.
        opening = names.take(pa.array(place[first])).dictionary_encode()
        led = np.bincount(place, minlength=len(names)) > np.bincount(place[first], minlength=len(names))
        number = np.cumsum(led) - 1
        place = number[place]
        place[first] = led.sum() + opening.indices.to_numpy()
        units = pa.concat_arrays([names.filter(pa.array(led)), opening.dictionary])
        flat, size, cannot = self._units(units, np.arange(len(units)) < led.sum())
        nothing, last = len(size), np.append(first[1:], len(place)) - 1
        more = [np.zeros(0, "<i4")]
        if cannot.any():
            odd = np.flatnonzero(np.logical_or.reduceat(cannot[place], first))
            place[np.repeat(np.isin(np.arange(len(first)), odd), last - first + 1)] = nothing
            place[first[odd]] = nothing + 1 + np.arange(len(odd))
            more += [self._whole(texts[k].as_py()) for k in odd.tolist()]
        if end_id is not None:
            place = np.insert(place, last + 1, nothing + len(more))
            first = first + np.arange(len(first))
            more.append(np.asarray([end_id], "<i4"))
        ids, n = gathered(np.concatenate([flat, *more]), np.concatenate([size, [len(x) for x in more]]), place)
        pa.default_memory_pool().release_unused()
        return ids, np.add.reduceat(n, first)

    def spans_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character and end of each token of whole texts, and the number of tokens of each text.

        Tokens are runs of bytes, so their characters follow from their lengths; a character cut in two belongs to both.
        """
        ids, n = self.encode_array(texts)
        data = np.frombuffer(pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")[0].as_buffer(), "u1")
        number = np.cumsum((data & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.width[ids])
        if len(ids) and ends[-1] != len(data):
            raise RuntimeError("the tokens do not cover the texts")
        size = pc.utf8_length(texts).to_numpy().astype("i8")
        begin = np.repeat(np.cumsum(size) - size, n)
        return number[ends - self.width[ids]] - begin, number[ends - 1] + 1 - begin, n

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as little-endian 32-bit integers."""
        ids, n = self.encode_array(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]

    def encode_spans(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """First character and end of each token of each whole text."""
        first, end, n = self.spans_array(pa.array(texts, pa.string()))
        cuts = np.cumsum(n)[:-1]
        return [*zip(np.split(first, cuts), np.split(end, cuts))]


def _ranges(buffer: pa.Buffer, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ranges of a buffer, one after another, and their sizes."""
    if not len(size):
        return np.zeros(0, "u1"), size
    ends = np.cumsum(size)
    return np.frombuffer(buffer, "u1")[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])], size


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> UnitEncoder:
    """One encoder a Python worker, so that its memo lives from task to task."""
    kept = begin("tokens")
    if path not in kept:
        kept[path] = UnitEncoder(path)
    return kept[path]
