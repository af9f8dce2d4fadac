"""Words of batches of texts, cut in Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes with U+0009..U+000D as spaces; and with A-Z in lower case besides.
SPACED = np.arange(256, dtype="u1")
SPACED[9:14] = 32
LOWER = SPACED.copy()
LOWER[65:91] += 32


def split_words(texts: pa.Array, as_bytes: np.ndarray = SPACED) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts without nulls one after another, and the number of words of each text."""
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, "i8")
    at = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1]
    data = as_bytes[np.frombuffer(texts.buffers()[2] or b"", "u1")[at[0] : at[-1]]]
    cut = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(data)), " ")
    some = pc.greater(pc.binary_length(cut.flatten()), 0)
    return cut.flatten().filter(some), np.add.reduceat(some.to_numpy(zero_copy_only=False).astype("i8"), cut.offsets.to_numpy()[:-1])


#: Words of up to so many bytes are hashed side by side, eight bytes at a time.
SIDE_BY_SIDE = 64
_LOW = np.asarray([(1 << 8 * k) - 1 for k in range(9)], "u8")
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts without nulls one after another, and the number of words of each text."""
    if not len(texts):
        return np.zeros(0, "u8"), np.zeros(0, "i8")
    at = np.frombuffer(texts.buffers()[1], "<i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")[at[0] : at[-1]]
    at -= at[0]
    word = (data != 32) & (data - np.uint8(9) > 4)
    # A word begins behind a break or at the begin of a text, and ends likewise.
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    some = np.flatnonzero(at[:-1] < at[1:])
    first[at[some]] = word[at[some]]
    last[at[some + 1] - 1] = word[at[some + 1] - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = end - start
    units = np.concatenate([data, np.zeros(16 - len(data) % 8, "u1")]).view("<u8")
    out = size.astype("u8") * _ODD[0]
    of, begin, left = slice(None), start, size
    for k in range(0, SIDE_BY_SIDE, 8):
        if k:
            of = np.flatnonzero((size > k) & (size <= SIDE_BY_SIDE)) if k == 8 else of[left > 8]
            if not len(of):
                break
            begin, left = start[of] + k, size[of] - k
        unit, bits = begin >> 3, ((begin & 7) << 3).astype("u8")
        x = units[unit] >> bits | units[unit + 1] << np.uint64(1) << (np.uint64(63) - bits)
        x &= _LOW[np.minimum(left, 8)]
        x = (x ^ x >> np.uint64(29)) * _ODD[0] + out[of] * _ODD[1]
        out[of] = (x ^ x >> np.uint64(32)) * _ODD[2]
    for i in np.flatnonzero(size > SIDE_BY_SIDE).tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes())
    return out, np.diff(np.searchsorted(start, at))
