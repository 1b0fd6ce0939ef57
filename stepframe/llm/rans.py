"""Range asymmetric numeral system with static tables and interleaved lanes, in numpy.

Symbol ``i`` of a block goes to lane ``i % lanes``; all lanes share one stream of 32-bit words. A lane's state stays in
[2^31, 2^63). Every ``every`` steps the encoder notes the word position and all states, so that a block can be decoded in
parts side by side. Symbols are coded last to first, hence decoded first to last.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANES = 2048
EVERY = 128
LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_BITS = np.uint64(BITS)
_MASK = np.uint64((1 << BITS) - 1)


class ChecksumError(ValueError):
    """Stored bytes differ from those that were written."""


@dataclass
class Table:
    """Frequencies of all symbols, summing to 2^BITS, each at least 1, so that every symbol can be coded."""

    freq: np.ndarray

    def __post_init__(self):
        self.freq = self.freq.astype(np.uint64)
        if int(self.freq.sum()) != 1 << BITS or (self.freq == 0).any():
            raise ValueError("frequencies must be positive and sum to 2^BITS")
        self.start = np.cumsum(self.freq) - self.freq
        self.symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))


def normalised(counts: np.ndarray) -> np.ndarray:
    """Whole frequencies in proportion to ``counts`` that sum to 2^BITS with each at least 1 (equal if all are 0)."""
    n = len(counts)
    if n > 1 << (BITS - 1):
        raise ValueError("too many symbols for the table")
    room = (1 << BITS) - n
    share = counts.astype(np.float64) if counts.sum() else np.ones(n)
    exact = share / share.sum() * room
    freq = np.floor(exact).astype(np.int64)
    rest = room - int(freq.sum())
    freq[np.argsort(freq - exact, kind="stable")[:rest]] += 1
    return freq + 1


def encode(symbols: np.ndarray, table: Table) -> dict[str, bytes | int]:
    """A block: words, states at the start, checkpoints, and checksums of the coded bytes and of the symbols."""
    n = len(symbols)
    freq, start = table.freq, table.start
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    emitted = 0
    steps = -(-n // LANES)
    for k in range(steps - 1, -1, -1):
        s = symbols[k * LANES : (k + 1) * LANES]
        x = state[: len(s)]
        f = freq[s]
        full = (x >> np.uint64(63 - BITS)) >= f
        if full.any():
            out = x[full]
            words.append(out.astype(np.uint32))
            emitted += len(out)
            x = np.where(full, x >> _32, x)
        q = x // f
        state[: len(s)] = (q << _BITS) + (x - q * f) + start[s]
        if k and k % EVERY == 0:
            marks.append((emitted, state.tobytes()))
    stream = np.concatenate(words[::-1]).astype("<u4").tobytes() if words else b""
    checks = np.array([emitted - at for at, _ in reversed(marks)], "<i8").tobytes() + b"".join(b for _, b in reversed(marks))
    first = state.tobytes()
    return {
        "n": n, "words": stream, "states": first, "marks": checks,
        "crc": zlib.crc32(checks, zlib.crc32(first, zlib.crc32(stream))), "symbols_crc": zlib.crc32(symbols.astype("<u4").tobytes()),
    }


def parts(block: dict) -> list[tuple[int, int, int, np.ndarray]]:
    """First step, end, word position and states of each part of a block that can be decoded by itself."""
    if zlib.crc32(block["marks"], zlib.crc32(block["states"], zlib.crc32(block["words"]))) != block["crc"]:
        raise ChecksumError("coded bytes are damaged")
    steps = -(-block["n"] // LANES)
    starts = [0, *range(EVERY, steps, EVERY)]
    at = np.frombuffer(block["marks"], "<i8", len(starts) - 1)
    states = np.frombuffer(block["marks"], np.uint64, offset=8 * len(at)).reshape(len(at), LANES)
    first = np.frombuffer(block["states"], np.uint64)
    return [(k, min(k + EVERY, steps), int(at[i - 1]) if i else 0, states[i - 1] if i else first) for i, k in enumerate(starts)]


def decode_part(block: dict, part: tuple[int, int, int, np.ndarray], table: Table) -> np.ndarray:
    lo, hi, at, states = part
    n = block["n"]
    stream = np.frombuffer(block["words"], "<u4")
    state = states.copy()
    out = np.empty(min(n, hi * LANES) - lo * LANES, np.uint32)
    for k in range(lo, hi):
        size = min(LANES, n - k * LANES)
        x = state[:size]
        slot = x & _MASK
        s = table.symbol[slot]
        out[(k - lo) * LANES : (k - lo) * LANES + size] = s
        x = table.freq[s] * (x >> _BITS) + slot - table.start[s]
        empty = x < LOW
        if empty.any():
            m = int(np.count_nonzero(empty))
            x[empty] = (x[empty] << _32) | stream[at : at + m]
            at += m
        state[:size] = x
    return out


def decode(block: dict, table: Table) -> np.ndarray:
    out = [decode_part(block, p, table) for p in parts(block)]
    symbols = np.concatenate(out) if out and block["n"] else np.empty(0, np.uint32)
    if zlib.crc32(symbols.astype("<u4").tobytes()) != block["symbols_crc"]:
        raise ChecksumError("decoded symbols differ from those that were coded")
    return symbols
