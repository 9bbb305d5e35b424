"""Simple-8b word-aligned coding of token ids, vectorised with numpy.

A 64-bit word holds a 4-bit selector and up to 60 data bits:

* selectors 1 to 15 pack a fixed count of ids of a fixed width, lowest first;
* selector 0 is the escape: its data is a count, and that many raw 64-bit ids
  follow (for ids of 60 bits and more, which no other selector can hold).

A block is a little-endian byte string: magic, number of ids, number of words,
number of offsets, the offsets (ids before every ``STRIDE``-th word), then the
words.  Offsets fall between coded words, so decoding may start at any of them.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"S8B1"
STRIDE = 1024
#: Fixed values: (count, width in bits) by selector; selector 0 is the escape.
SELECTORS = [(0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60), (1, 60)]
COUNTS = np.array([c for c, _ in SELECTORS], dtype=np.int64)
#: Ids that a word takes up; an escape takes one.
_STEPS = np.maximum(COUNTS, 1).astype(np.uint8)


#: Bits that each value below 2**16 needs, at least 1.
_BITS = np.maximum(1, np.ceil(np.log2(np.arange(1 << 16) + 1.0))).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at least 1."""
    if not len(ids) or ids.max() < 1 << 16:
        return _BITS[ids]
    width = np.zeros(len(ids), dtype=np.uint8)
    rest = ids.copy()
    for _ in range(4):
        low = rest & np.uint64(0xFFFF)
        width = np.where(rest >> np.uint64(16) > 0, width + 16, np.where(rest > 0, width + _BITS[low], width)).astype(np.uint8)
        rest >>= np.uint64(16)
        done = rest == 0
        if done.all():
            break
    return np.maximum(width, 1)


def _runs_of(narrow: np.ndarray, count: int) -> np.ndarray:
    """Where ``count`` true values in a row begin."""
    fits, have = narrow, 1
    while have < count:
        more = min(have, count - have)
        fits = fits[:-more] & fits[more:] if len(fits) > more else fits[:0]
        have += more
    return fits


def _choose(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and selector of each word, greedily packing as many ids as fit."""
    n = len(ids)
    width = _widths(ids)
    best = np.zeros(n, dtype=np.int8)
    for selector in range(14, 0, -1):
        count, bits = SELECTORS[selector]
        fits = _runs_of(width <= bits, count)
        best[: len(fits)][fits] = selector
    jump = _STEPS[best].tobytes()  # a byte each
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    start = np.array(starts, dtype=np.int64)
    return start, best[start].astype(np.int64)


def encode(ids: np.ndarray) -> bytes:
    """One block for an array of unsigned integers."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    start, selector = _choose(ids)
    escaped = selector == 0
    # an escape takes two words here: the marker for one id, then the id itself
    first = np.cumsum(np.where(escaped, 2, 1)) - np.where(escaped, 2, 1)
    words = np.zeros(int((1 + escaped).sum()), dtype=np.uint64)
    for s in np.unique(selector):
        rows, count, bits = np.flatnonzero(selector == s), *SELECTORS[s]
        if s == 0:
            words[first[rows]] = 1
            words[first[rows] + 1] = ids[start[rows]]
            continue
        word = np.full(len(rows), np.uint64(s) << np.uint64(60), dtype=np.uint64)
        for k in range(count):
            word |= ids[start[rows] + k] << np.uint64(k * bits)
        words[first[rows]] = word
    marks = np.arange(0, len(words), STRIDE)
    # an offset may not point at the raw id of an escape: it moves to the next coded word
    coded = np.searchsorted(first, marks)
    before = np.r_[start, len(ids)][np.minimum(coded, len(start))]
    at = np.r_[first, len(words)][np.minimum(coded, len(first))]
    offsets = np.stack([at, before], axis=1).astype("<u4").tobytes()
    return MAGIC + struct.pack("<III", len(ids), len(words), len(marks)) + offsets + words.astype("<u8").tobytes()


def decode(block: bytes, first_mark: int = 0) -> np.ndarray:
    """All ids of a block from the given offset on."""
    if block[:4] != MAGIC:
        raise ValueError("not a Simple-8b block")
    n_ids, n_words, n_marks = struct.unpack_from("<III", block, 4)
    marks = np.frombuffer(block, dtype="<u4", count=2 * n_marks, offset=16).reshape(-1, 2)
    words = np.frombuffer(block, dtype="<u8", count=n_words, offset=16 + 8 * n_marks)
    skip_words, skip_ids = marks[first_mark].tolist() if first_mark else (0, 0)
    words = words[skip_words:]
    selector = (words >> np.uint64(60)).astype(np.int64)
    markers = np.flatnonzero(selector == 0)
    raw = np.zeros(len(words), dtype=bool)
    last = -1
    for m in markers.tolist():  # escapes only
        if m > last:
            last = m + int(words[m])
            raw[m + 1 : last + 1] = True
    counts = np.where(raw, 1, COUNTS[selector])
    counts[(selector == 0) & ~raw] = 0
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.uint64)
    out[begin[raw]] = words[raw]
    for s in np.unique(selector[~raw]):
        if s == 0:
            continue
        rows, count, bits = np.flatnonzero((selector == s) & ~raw), *SELECTORS[s]
        data, mask = words[rows], np.uint64((1 << bits) - 1)
        for k in range(count):
            out[begin[rows] + k] = data >> np.uint64(k * bits) & mask
    if len(out) != n_ids - skip_ids:
        raise ValueError("a Simple-8b block is damaged")
    return out
