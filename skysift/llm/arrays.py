"""Numpy helpers for Arrow batches: bytes of many texts at once, word spans, hashes.

Texts of a batch lie end to end in one byte buffer, so splitting and hashing
are vector operations over that buffer instead of Python loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# White space of the word rule: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# A block of texts is handled at once up to this many bytes; a longer text is a block of its own.
BLOCK_BYTES = 1 << 21
# Hashes of spans are computed over segments of about this many bytes.
SEGMENT_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows up to BLOCK_BYTES."""
    buf, offs = buffer_of(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + BLOCK_BYTES, "right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the number of its first word (n + 1 values).

    Where `cuts` is true, a word ends and the next begins.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[buf]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    if cuts is not None:
        before &= ~cuts
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    ends_of_texts = offs[1:][offs[1:] > offs[0]] - 1
    after[ends_of_texts] = False
    if cuts is not None:
        after[:-1] &= ~cuts[1:]
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT_BYTES + 4096)
        steps = [np.full(size, base, np.uint64) for base in (_ODD, _INVERSE)]
        for s in steps:
            s[0] = 1
        _powers[:] = [np.cumprod(s, dtype=np.uint64) for s in steps]
    return _powers


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span buf[start:end]; spans follow each other and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT_BYTES, "right")))
        base = int(starts[i])
        part = buf[base : int(ends[j - 1])]
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[part] * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words inside each text, and the offsets per text.

    A text of fewer words, but at least one, gives one hash of its whole sequence.
    """
    counts = np.diff(first)
    n_windows = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(n_windows)])
    total = int(offsets[-1])
    text = np.repeat(np.arange(len(counts)), n_windows)
    at = first[:-1][text] + (np.arange(total) - offsets[:-1][text])
    reach = np.minimum(counts[text], size)
    h = reach.astype(np.uint64)
    for k in range(size):
        inside = k < reach
        step = np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else 0, 0)
        h = mix(h * _ODD + step.astype(np.uint64))
    return h, offsets
