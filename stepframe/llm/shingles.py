"""Words and word shingles of whole texts as 64-bit hashes, by numpy over the UTF-8 bytes.

A word is a longest run of bytes other than space and 9 to 13, A to Z as a to z. Its hash comes from differences of a
running polynomial sum; a shingle's hash mixes those of its words. Long texts are worked off in stretches of about
``STRETCH`` bytes that end at white space, so memory beyond the hashes (8 bytes a word) doesn't grow with a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

STRETCH = 1 << 18
_FACTOR = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_VALUE = np.arange(1, 257, dtype=np.uint64)
_VALUE[65:91] += np.uint64(32)
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, STRETCH + 4096)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, f, np.uint64)])) for f in (_FACTOR, pow(_FACTOR, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def _stretch(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in ``raw``; a word never spans one of ``breaks``."""
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(raw))]
    first[breaks] = solid[breaks]
    last[breaks - 1] = solid[breaks - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts]), starts


def words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and where each text's begin (one more than texts); null is empty."""
    texts = texts.cast(pa.large_string()) if texts.type != pa.large_string() else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    bounds = offsets - offsets[0]
    hashes, starts, at = [], [], 0
    while at < len(raw):
        end = min(at + STRETCH, len(raw))
        if end < len(raw):
            inner = bounds[np.searchsorted(bounds, end, "right") - 1]
            if inner > at:
                end = int(inner)
            else:  # inside one long text: go on to the next white space
                limit = int(bounds[np.searchsorted(bounds, end, "right")])
                while end < limit:
                    found = np.flatnonzero(_SPACE[raw[end : min(end + 4096, limit)]])
                    if len(found):
                        end += int(found[0])
                        break
                    end = min(end + 4096, limit)
        lo, hi = np.searchsorted(bounds, [at, end])
        h, s = _stretch(raw[at:end], bounds[lo : hi + 1] - at)
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(n + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """Hashes of all ``size``-word shingles of one text in order; with fewer words the whole sequence as one."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total * _PLACES[1] + hashes[k : n + k] * _PLACES[k % 5]
        total ^= total >> np.uint64(29)
    return mixed(total)


def sets(texts: pa.StringArray, size: int = 5):
    """For each text the sorted distinct hashes of its shingles."""
    hashes, at = words(texts)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.unique(shingles(hashes[lo:hi], size)) if hi > lo else hashes[:0]
