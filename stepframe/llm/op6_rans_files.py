"""Token-id files coded by a range asymmetric numeral system.

``tokenize`` gives the ids of each text once and keeps them in the shared folder, with a tally of each batch in a column of its
own; the tallies of all documents make the one frequency table that all blocks share. ``write`` deals the ids out by ranges of the document id, about
``PART_TOKENS`` each, and every task codes its range block by block: a block is a row of a Parquet file (its container)
with word stream, lane states, checkpoints, two checksums and the ids and lengths of its documents. Blocks hold whole
documents and are coded and decoded independently. ``read`` gives each document's ids back; ``digest`` their place and
checksum. Only the table (a number for each vocabulary entry) and a sum for each part reach the driver.

Null texts are empty documents (the end id alone); null document ids come first; equal document ids are all kept, in an order set by their ids' bytes;
an empty table gives no rows; other columns are not read. Very long texts make a block of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm import rans
from stepframe.llm.pieces import SpacedEncoder, encoder
from stepframe.llm.shared import byte_chunks, shared_path, ship, stored

BATCH_BYTES = 4_000_000
BLOCK_TOKENS = 1 << 20
PART_TOKENS = 8_000_000
_BLOCK = "part int, block int, start long, n long, doc_ids binary, known binary, lengths binary, words binary, states binary, marks binary, crc long, symbols_crc long"


def tokenize(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, ids binary (little-endian unsigned 16-bit, the end id last) for each row; tally: at one row of each batch the ids that
    occur in it and how often, else null."""
    ship(docs.sparkSession)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches):
        encode = encoder(SpacedEncoder, tokenizer, True).encode
        for b in batches:
            at = 0
            for texts in byte_chunks(b.column(1), BATCH_BYTES):
                ids = [x + end for x in encode(texts)]
                n = np.bincount(np.frombuffer(b"".join(ids), "<u2"))
                used = np.flatnonzero(n)
                tally = [used.astype("<u2").tobytes() + n[used].astype("<u4").tobytes(), *[None] * (len(ids) - 1)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), pa.array(ids, pa.binary()), pa.array(tally, pa.binary())], ["doc_id", "ids", "tally"])
                at += len(texts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, tally binary")


def symbol_counts(ids: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each id over all rows, from the tallies: one array in each task, sums of at most ``size`` numbers on the driver."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total[np.frombuffer(x, "<u2", len(x) // 6)] += np.frombuffer(x, "<u4", offset=len(x) // 3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in ids.where("tally IS NOT NULL").select("tally").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.id] = row.n
    return out


def write(ids: DataFrame, freq: np.ndarray, path: str, tokens: int) -> None:
    """Code the documents in ascending order of doc_id."""
    parts = max(1, -(-tokens // PART_TOKENS))

    def run(batches):
        from pyspark import TaskContext

        table = rans.Table(freq)
        part = TaskContext.get().partitionId()
        held, keys, size, start, block = [], [], 0, 0, 0

        def flush():
            symbols = np.frombuffer(b"".join(held), "<u2")
            e = rans.encode(symbols, table)
            lengths = np.array([len(x) // 2 for x in held], "<i8").tobytes()
            row = [part, block, start, len(symbols), np.array([k or 0 for k in keys], "<i8").tobytes(), bytes(k is not None for k in keys), lengths, e["words"], e["states"], e["marks"], e["crc"], e["symbols_crc"]]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _ARROW, strict=True)], _NAMES)

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if held and size + len(x) // 2 > BLOCK_TOKENS:
                    yield flush()
                    start, block, held, keys, size = start + size, block + 1, [], [], 0
                held.append(x)
                keys.append(k)
                size += len(x) // 2
        if held:
            yield flush()

    dealt = ids.select("doc_id", "ids").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    dealt.mapInArrow(run, _BLOCK).write.parquet(path)


_ARROW = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6, pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def _decoded(blocks: DataFrame, freq: np.ndarray, schema: str, each):
    def run(batches):
        table = rans.Table(freq)
        for b in batches:
            for row in b.to_pylist():
                symbols = rans.decode(row, table)
                keys = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["known"], np.uint8) == 0)
                lengths = np.frombuffer(row["lengths"], "<i8")
                yield each(row, keys, lengths, symbols.astype("<u4"))

    return blocks.mapInArrow(run, schema)


def read(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of each document in the files."""

    def each(row, keys, lengths, symbols):
        ends = np.cumsum(lengths)
        ids = [symbols[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
        return pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _decoded(blocks, freq, "doc_id long, ids binary", each)


def digest(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files."""

    def each(row, keys, lengths, symbols):
        ends = np.cumsum(lengths)
        starts, raw = ends - lengths, memoryview(symbols.tobytes())
        crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        cols = [keys, pa.array(np.full(len(keys), row["part"], np.int32)), pa.array(starts + row["start"]), pa.array(lengths), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "within", "n_tokens", "ids_crc32"])

    spark = blocks.sparkSession
    sums = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).toLocalIterator()}
    before, rows = 0, []
    for p in sorted(sums):
        rows.append((p, before))
        before += sums[p]
    offsets = spark.createDataFrame(rows, "part int, before long")
    docs = _decoded(blocks, freq, "doc_id long, part int, within long, n_tokens long, ids_crc32 long", each)
    return docs.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def write_and_digest(docs: DataFrame, tokenizer: str, end_id: int, vocabulary: int, path: str | None = None) -> DataFrame:
    """Write all documents' ids as coded files at ``path`` (else in the shared folder) and describe what they hold."""
    spark = docs.sparkSession
    ids = stored(tokenize(docs, tokenizer, end_id), "token-ids")
    counts = symbol_counts(ids, vocabulary)
    freq = rans.normalised(counts)
    path = path or shared_path(spark, "coded-ids")
    write(ids, freq, path, int(counts.sum()))
    return digest(spark.read.schema(_BLOCK).parquet(path), freq)
