"""Texts as byte arrays: words, hashes of words and of runs of words, all in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_MIX1, _MIX2, _MIX3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * _MIX1
        x = (x ^ (x >> U(27))) * _MIX2
        return x ^ (x >> U(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + U(1)) * _MIX3)
_power = {"n": 0, "up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _power["n"] < n:
        size = max(n, 1 << 18)
        with np.errstate(over="ignore"):
            for k, base in (("up", _P), ("down", _P_INV)):
                a = np.full(size, U(base), np.uint64)
                a[0] = 1
                _power[k] = np.multiply.accumulate(a)
        _power["n"] = size
    return _power["up"], _power["down"]


def byte_chunks(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer text is a run of its own. Null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Words of a run of texts: start and end byte, text number and a 64-bit hash of each; `first` has the first word of each text, and the end."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE, fold: np.ndarray | None = LOWER):
        n = len(buf)
        inside = ~breaks[buf]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.zeros(n, bool)
        if n:
            after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1 : n + 1])) + 1
        self.start, self.end = starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = span_hashes(buf if fold is None else fold[buf], starts, ends)


#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: eight bytes at a time, each mixed into what came before; of long spans xxh3."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place
    length = end - start
    with np.errstate(over="ignore"):
        out = mix((length.astype(np.uint64) + U(1)) * _MIX3)
        some = np.flatnonzero((length > 0) & (length <= LONG_WORD))
        for k in range(0, LONG_WORD, 8):
            some = some[length[some] > k]
            if not len(some):
                break
            lane = lanes[start[some] + k]
            missing = np.maximum(8 - (length[some] - k), 0).astype(np.uint64) * U(8)
            lane = (lane << missing) >> missing
            out[some] = mix((out[some] ^ mix(lane + _MIX3)) * _MIX1)
    for i in np.flatnonzero(length > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(padded[start[i] : end[i]])
    return out


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, from the words' hashes; runs may cross texts."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _MIX1 + words[k : k + m] + U(k + 1))
    return out


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each text, ordered by text and hash: (hashes, offsets by text). A text of fewer words has its whole sequence as one; one of no words has none."""
    docs = len(w.first) - 1
    count = np.diff(w.first)
    hashes = gram_hash(w.hash, n)
    ok = w.doc[: len(hashes)] == w.doc[n - 1 :] if len(hashes) else np.zeros(0, bool)
    doc, value = w.doc[: len(hashes)][ok], hashes[ok]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([_sequence(w.hash[w.first[d] : w.first[d + 1]]) for d in short], np.uint64)
        doc, value = np.concatenate([doc, short]), np.concatenate([value, extra])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[keep], value[keep]
    return value, np.searchsorted(doc, np.arange(docs + 1))


def _sequence(words: np.ndarray) -> int:
    out = gram_hash(words, len(words))[0]
    return int(mix(np.array([out + U(0)], np.uint64) ^ U(len(words)))[0])
