"""Token counts of whole texts: batches in Arrow functions that return lengths only.

Batches are cut by bytes rather than rows, and texts at places that no merge can reach across (see ``pieces``), so
one long text costs no more memory or time a byte than many short ones. No shuffle: each row is counted where it is read.

Null texts count as empty (0 bytes, 0 tokens); repeated rows are counted each; an empty table gives an empty result;
other columns are not read. ``limit`` compares with ``n_tokens`` strictly.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepframe.llm.pieces import PieceCounter, encoder
from stepframe.llm.shared import byte_chunks, ship

BATCH_BYTES = 2_000_000


def count_tokens(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for each row. ``model``: path of a sentencepiece file on every node."""
    ship(docs.sparkSession)

    def counted(batches):
        count = encoder(PieceCounter, model).count
        for b in batches:
            n = [k for texts in byte_chunks(b.column(1), BATCH_BYTES) for k in count(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    )
    out = rows.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
