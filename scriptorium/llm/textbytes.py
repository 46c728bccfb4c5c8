"""Words of Arrow text columns as numpy arrays.

A batch is scanned as UTF-8 bytes in pieces of a bounded size that are cut
between words, so memory follows the piece, not the batch or the longest text.
"""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are expanded at a time.
PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker process."""
    return sys.modules.setdefault("_scriptorium_worker", types.ModuleType("_scriptorium_worker")).__dict__


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whitespace_words() -> np.ndarray:
    """Byte classes of words [^ \\t-\\r]+."""
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return word


def alnum_words() -> np.ndarray:
    """Byte classes of words of ASCII letters, digits and all that isn't ASCII."""
    word = np.zeros(256, bool)
    for lo, hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        word[lo : hi + 1] = True
    return word


def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    cache = worker_cache()
    have = cache.get("powers")
    if have is None or len(have[0]) < n:
        n = max(n, PIECE + 1)
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.empty(n, np.uint64)
            p[0] = 1
            p[1:] = np.uint64(base)
            with np.errstate(over="ignore"):
                both.append(np.multiply.accumulate(p))
        have = cache["powers"] = (both[0], both[1])
    return have


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): document i is bytes[offsets[i]:offsets[i + 1]]; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_slices(column: pa.Array, limit: int = PIECE):
    """Row ranges (from, to) whose texts hold about limit bytes; a longer text is a range of its own."""
    offs = text_buffer(column)[1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per document); a word never crosses a document's end."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offs) - 1, np.int64)
    inside = word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offs[1:-1]
    before[cuts[cuts < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends_at = cuts[cuts > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order, A-Z as a-z; equal bytes have equal hashes in every process."""
    return hash_prefixes(data, starts, ends, [None])[0]


def hash_prefixes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: list[int | None]) -> list[np.ndarray]:
    """For each size the hashes of the ranges' first bytes, as many as that; None is the whole range."""
    out = [np.empty(len(starts), np.uint64) for _ in sizes]
    values = worker_cache().setdefault("byte_values", _byte_values())
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            base = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            span = int(ends[hi - 1]) - base
            power, inverse = _powers(span + 1)
            total = np.empty(span + 1, np.uint64)
            total[0] = 0
            np.cumsum(values[data[base : base + span]] * power[:span], out=total[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            for row, size in zip(out, sizes):
                upto = e if size is None else np.minimum(e, s + size)
                row[lo:hi] = mix((total[upto] - total[s]) * inverse[s] + (upto - s).astype(np.uint64))
            lo = hi
    return out


def word_hashes(column: pa.Array, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words per document) over a text column."""
    data, offs = text_buffer(column)
    starts, ends, counts = word_spans(data, offs, word)
    return hash_spans(data, starts, ends), counts


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words of one document; fewer words make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return hashes
    size = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, np.uint64(size * 0x51ED270B), np.uint64)
        for k in range(size):
            out = (out ^ hashes[k : n - size + 1 + k]) * np.uint64((_BASE * (2 * k + 3)) & _MASK | 1)
            out ^= out >> np.uint64(29)
        return mix(out)


def shingle_sets(column: pa.Array, size: int, word: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(column, word)
    ends = np.cumsum(counts)
    return [np.unique(shingles(hashes[e - c : e], size)) for e, c in zip(ends.tolist(), counts.tolist())]
