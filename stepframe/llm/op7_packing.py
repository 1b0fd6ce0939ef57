"""Packing into sequences of bounded length by minimum bin slack.

Each bin starts with the longest length left; over the other lengths that are left, a bitset of reachable sums (one
integer, shifted and or-ed) finds the fullest feasible combination, which is removed. All documents of a length are alike
to that search, so it works on the number of documents by length and removes a combination as often as the numbers
allow at once: the driver holds ``capacity`` numbers and a few thousand combinations, however many documents there are.
Documents take the places of their length by rank: rows are counted by (length, salt) first, so a length that a third of
all documents share is spread over ``SALTS`` tasks.

Null texts are empty documents (the end id alone); repeated rows are packed each; an empty table gives no rows; other
columns are not read. Only documents longer than ``capacity`` are cut. Equal lengths are ranked by document id and piece.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepframe.llm.pieces import SpacedEncoder, encoder
from stepframe.llm.shared import byte_chunks, ship, stored

BATCH_BYTES = 4_000_000
SALTS = 64


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut every ``capacity``."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        encode = encoder(SpacedEncoder, tokenizer, False).encode
        for b in batches:
            keys = b.column(0).to_pylist()
            at = 0
            for texts in byte_chunks(b.column(1), BATCH_BYTES):
                out: list[tuple] = []
                for key, ids in zip(keys[at : at + len(texts)], encode(texts), strict=True):
                    raw = np.frombuffer(ids + end, "<u2").astype("<u4").tobytes()
                    for k, lo in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[lo : lo + 4 * capacity]
                        out.append((key, k, lo // 4, len(part) // 4, zlib.crc32(part)))
                at += len(texts)
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length with those others that fill ``capacity`` best: {length: times}. Longer lengths are tried first."""
    lengths = sorted((k for k, n in counts.items() if n), reverse=True)
    first = lengths[0]
    room = capacity - first
    mask, reach, tried = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        most = min(counts[length] - (length == first), room // length)
        times = 1
        while most > 0 and not reach >> room:
            times = min(times, most)
            grown = reach | (reach << (length * times) & mask)
            if grown != reach:
                tried.append((length, times, reach))
                reach = grown
            most -= times
            times *= 2
        if reach >> room:
            break
    best, chosen = reach.bit_length() - 1, {first: 1}
    for length, times, before in reversed(tried):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + times
            best -= length * times
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how many sequences each fills, until no length is left."""
    left, out = dict(counts), []
    while left:
        chosen = fullest(left, capacity)
        copies = min(left[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            left[k] -= m * copies
            if not left[k]:
                del left[k]
        out.append((chosen, copies))
    return out


def places(bins: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, first sequence, times in a sequence, place of the first) in order of rank."""
    taken: dict[int, int] = {}
    out: dict[int, list] = {}
    sequence = 0
    for chosen, copies in bins:
        at = 0
        for length in sorted(chosen, reverse=True):
            times = chosen[length]
            out.setdefault(length, []).append((taken.get(length, 0), sequence, times, at))
            taken[length] = taken.get(length, 0) + times * copies
            at += times * length
        sequence += copies
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """``items`` (doc_id, piece, start, length of 1 to ``capacity``, ids_crc32) with sequence_id and offset."""
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)))
    tally = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    by_length: dict[int, dict[int, int]] = {}
    for r in tally.toLocalIterator():  # at most capacity x SALTS rows
        by_length.setdefault(r.length, {})[r.salt] = r.n
    table = places(plan({k: sum(v.values()) for k, v in by_length.items()}, capacity))
    before = {k: np.concatenate([[0], np.cumsum([v.get(s, 0) for s in range(SALTS - 1)])]).astype(np.int64) for k, v in by_length.items()}
    shared = items.sparkSession.sparkContext.broadcast((table, before))  # bounded by capacity, not by rows

    def run(batches):
        table, before = shared.value
        for b in batches:
            length, salt, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5, 6))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for k in np.unique(length):
                own = np.flatnonzero(length == k)
                r = rank[own] + before[k][salt[own]]
                rows = table[k][np.searchsorted(table[k][:, 0], r, "right") - 1]
                r = r - rows[:, 0]
                sequence[own] = rows[:, 1] + r // rows[:, 2]
                offset[own] = rows[:, 3] + r % rows[:, 2] * k
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")).cast("long") - 1)
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
