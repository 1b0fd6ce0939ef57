"""Benchmark decontamination: MinHash containment search, partitioned by size, with exact verification.

An item is found in a document that holds at least 3/4 of its distinct 5-word shingles. Items fall into partitions by size
(powers of two); in each an item's sketch is its bottom k hashes, k = floor(n/4) + 1: a document that misses at
most floor(n/4) of the n shingles must hold one of them, so no match is lost however long the document is, which a
fixed number of MinHash values could not promise. The sketches are an index hash -> items; each document's shingles probe it
(through a bitmap), partitions whose least item needs more shingles than the document has are skipped, and
candidates are verified by comparing shingles as words. The index is sent to the tasks in blocks of at most
``BLOCK_HASHES`` hashes, one pass over the documents for each block, so a large benchmark costs passes, not memory. There is no shuffle
and no group: a passage in a third of all documents is found row by row.

Words as in ``shingles``. An item of fewer than five words is one shingle of its own length, looked for among the documents'
shingles of that length.
Null or wordless texts and items match nothing. Repeated rows are searched each; empty tables give no rows; extra columns
are not read by the search and kept by the filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.shared import byte_slices, ship
from stepframe.llm.shingles import shingles, words

BLOCK_HASHES = 4_000_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_words(text: str | None, size: int = 5) -> set[tuple[str, ...]]:
    """The shingles of a text; of one with fewer words, the whole."""
    w = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


class Index:
    """Sketches of a block of items: for each partition, sorted hashes and the item of each."""

    def __init__(self, items: list[tuple[int, str, np.ndarray, int]]):
        self.items = items
        self.short: dict[int, dict[int, list[int]]] = {}  # words -> hash -> items
        parts: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, (_, _, s, n_words) in enumerate(items):
            n = len(s)
            if n_words < 5:
                self.short.setdefault(n_words, {}).setdefault(int(s[0]), []).append(i)
                continue
            parts.setdefault(n.bit_length(), []).append((s[: n // 4 + 1], i))  # sets are sorted by hash: the bottom k
        self.parts = []
        for held in parts.values():
            hashes = np.concatenate([h for h, _ in held])
            owner = np.repeat([i for _, i in held], [len(h) for h, _ in held])
            turn = np.argsort(hashes, kind="stable")
            least = min(len(items[i][2]) - len(items[i][2]) // 4 for _, i in held)
            bits = np.zeros(1 << 20, bool)
            bits[(hashes >> np.uint64(44)).astype(np.int64)] = True
            self.parts.append((least, hashes[turn], owner[turn], bits))
        self.words: dict[int, set] = {}

    def candidates(self, words: np.ndarray) -> set[int]:
        found: set[int] = set()
        for size, known in self.short.items():
            if len(words) >= size:
                for h in set(shingles(words, size).tolist()) & known.keys():
                    found.update(known[h])
        if len(words) < 5 or not self.parts:
            return found
        held = np.unique(shingles(words))
        for least, hashes, owner, bits in self.parts:
            if len(held) < least:
                continue
            some = held[bits[(held >> np.uint64(44)).astype(np.int64)]]
            lo, hi = np.searchsorted(hashes, some), np.searchsorted(hashes, some, "right")
            for a, b in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                found.update(owner[a:b].tolist())
        return found

    def matches(self, words: np.ndarray, text) -> list[tuple[int, int, int]]:
        """(item_id, its shingles, how many the text holds) for each item found in a text (of Arrow) with these words."""
        out, own = [], {}
        for i in sorted(self.candidates(words)):
            size = min(5, self.items[i][3])
            if size not in own:
                own[size] = shingle_words(text.as_py(), size)
            if i not in self.words:
                self.words[i] = shingle_words(self.items[i][1])
            n, both = len(self.words[i]), len(self.words[i] & own[size])
            if 4 * both >= 3 * n:
                out.append((self.items[i][0], n, both))
        return out


def blocks(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[Index]:
    """The items in blocks whose sketches and sets stay within BLOCK_HASHES hashes."""
    held: list[tuple[int, str, np.ndarray, int]] = []
    size = 0
    for r in benchmark.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).toLocalIterator():
        own = words(pa.array([r.t], pa.large_string()))[0]
        if not len(own):
            continue
        s = np.unique(shingles(own))
        if held and size + len(s) > BLOCK_HASHES:
            yield Index(held)
            held, size = [], 0
        held.append((r.k, r.t, s, len(own)))
        size += len(s)
    if held:
        yield Index(held)


def _searched(batches, index: Index, column: int):
    for part in byte_slices(batches, column):
        texts = part.column(column)
        hashes, at = words(texts)
        yield part, [index.matches(hashes[lo:hi], texts[i]) if hi > lo else [] for i, (lo, hi) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_shingles, n_common for every item found in every document."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "item_id", "n_shingles", "n_common"]
    out = docs.sparkSession.createDataFrame([], ", ".join(f"{n} long" for n in names))
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for part, found in _searched(batches, shared.value, 1):
                ids = part.column(0).to_pylist()
                flat = [(d, *m) for d, ms in zip(ids, found, strict=True) for m in ms]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in flat], pa.int64()) for i in range(4)], names)

        out = out.unionByName(rows.mapInArrow(run, ", ".join(f"{n} long" for n in names)))
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows in which an item is found."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for part, found in _searched(batches, shared.value, at):
                yield part.filter(pa.array([not m for m in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
