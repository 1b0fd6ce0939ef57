"""Minimum-cost-flow resharding under the law ``bytes``: shards of nearly equal size, moving the fewest bytes.

Every old shard is cut into blocks by a hash of the key; the bytes and rows of each block (``old shards x BLOCKS`` numbers)
go to the driver. A flow from old shards to new capacities is solved there by successive shortest paths, where a byte that
stays costs 0 and one that moves 1. Flows are laid along the blocks of their old shard: whole blocks take one target, and
the few blocks that a flow ends in are dealt out document by document, longest first, to what room is left. Affected
files are then rewritten: the rows are shuffled once by (shard, old shard, block) and written by shard, each with its
slot, from the block's first slot and its rank in the block, so no task holds a whole shard.

Size is the UTF-8 bytes of the text plus 1 (null text: 1, checksum 0); a null key is a key like others. Rows equal in key, size and checksum are placed
together; slots order rows by old shard, block, key and checksum. An empty table gives no rows. Extra columns are
not read. Equal texts have no rule of their own here: each document is an item.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepframe.llm.shared import shared_path

BLOCKS = 256
#: Rows that a block should have: a flow that ends in one is met to about the size of its smallest documents.
BLOCK_ROWS = 128


def min_cost_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow[i][j] of least total cost that sends every supply into the rooms (successive shortest paths)."""
    if sum(supply) > sum(room):
        raise ValueError("the new shards can't hold the old ones")
    n, m = len(supply), len(room)
    flow = [[0] * m for _ in range(n)]
    left, free = list(supply), list(room)
    while any(left):
        dist = {("o", i): (0 if left[i] else float("inf")) for i in range(n)} | {("n", j): float("inf") for j in range(m)}
        before: dict = {}
        queue = deque(("o", i) for i in range(n) if left[i])
        while queue:
            kind, u = queue.popleft()
            steps = [(("n", j), cost[u][j]) for j in range(m)] if kind == "o" else [(("o", i), -cost[i][u]) for i in range(n) if flow[i][u]]
            for v, c in steps:
                if dist[kind, u] + c < dist[v]:
                    dist[v] = dist[kind, u] + c
                    before[v] = (kind, u)
                    queue.append(v)
        end = min((j for j in range(m) if free[j]), key=lambda j: dist["n", j])
        path, at = [("n", end)], ("n", end)
        while at in before:
            at = before[at]
            path.append(at)
        path.reverse()
        hops = list(zip(path, path[1:], strict=False))
        amount = min([left[path[0][1]], free[end], *(flow[v[1]][u[1]] for u, v in hops if u[0] == "n")])
        for u, v in hops:
            if u[0] == "o":
                flow[u[1]][v[1]] += amount
            else:
                flow[v[1]][u[1]] -= amount
        left[path[0][1]] -= amount
        free[end] -= amount
    return flow


def even(total: int, shards: int) -> list[int]:
    return [total * (j + 1) // shards - total * j // shards for j in range(shards)]


def lay_out(blocks: dict[int, list[tuple[int, int]]], flow: list[list[int]]) -> tuple[dict, dict]:
    """By (old, block): the shard of whole blocks; for others what room each shard has in them, as [(shard, bytes)]."""
    whole, parted = {}, {}
    for old, sized in blocks.items():
        targets = deque([j, f] for j, f in sorted(enumerate(flow[old]), key=lambda x: x[0] != old) if f)
        for block, size in sized:
            rooms = []
            while size:
                take = min(size, targets[0][1])
                rooms.append((targets[0][0], take))
                targets[0][1] -= take
                size -= take
                if not targets[0][1]:
                    targets.popleft()
            if len(rooms) == 1:
                whole[old, block] = rooms[0][0]
            elif rooms:
                parted[old, block] = rooms
    return whole, parted


def assign(docs: DataFrame, old: Column, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, size, text_crc32, old, block, shard, slot of every row."""
    spark = docs.sparkSession
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.octet_length(value) + F.lit(1)).cast("long").alias("size"), F.crc32(value).alias("text_crc32"), old.cast("int").alias("old"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int"))
    sums = rows.groupBy("old", "block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("old", "block").collect()
    olds = max([shards, *(r.old + 1 for r in sums)])
    joined = min(BLOCKS, -(-len(sums) * BLOCK_ROWS // max(1, sum(r.n for r in sums))))  # few rows: fewer blocks
    held: dict[tuple[int, int], list[int]] = defaultdict(lambda: [0, 0])
    for r in sums:
        held[r.old, r.block // joined][0] += r.size
        held[r.old, r.block // joined][1] += r.n
    rows = rows.withColumn("block", F.floor(F.col("block") / joined).cast("int"))
    blocks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (o, b), (size, _) in held.items():
        blocks[o].append((b, size))
    supply = [sum(s for _, s in blocks.get(i, [])) for i in range(olds)]
    flow = min_cost_flow(supply, even(sum(supply), shards), [[int(i != j) for j in range(shards)] for i in range(olds)])
    whole, parted = lay_out(blocks, flow)

    counts = {(j, o, b): held[o, b][1] for (o, b), j in whole.items()}
    plan = spark.createDataFrame([(o, b, j) for (o, b), j in whole.items()] + [(o, b, -1) for o, b in parted], "old int, block int, shard int")
    placed = rows.join(F.broadcast(plan), ["old", "block"])  # at most old shards x BLOCKS rows

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        rooms = [list(x) for x in parted[int(pdf["old"].iloc[0]), int(pdf["block"].iloc[0])]]
        pdf = pdf.assign(weight=pdf["size"] * pdf["n"]).sort_values(["weight", "doc_id", "text_crc32"], ascending=[False, True, True])
        pdf = pdf.astype({"doc_id": "Int64"})
        out = []
        for weight in pdf["weight"]:
            best = next((x for x in rooms if x[1] >= weight), None) or max(rooms, key=lambda x: x[1])
            best[1] -= weight
            out.append(best[0])
        return pdf.assign(dealt=out)[["old", "block", "doc_id", "size", "text_crc32", "n", "dealt"]]

    split = placed.where("shard < 0")
    dealt = split.groupBy("old", "block", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).groupBy("old", "block").applyInPandas(deal, "old int, block int, doc_id long, size long, text_crc32 long, n long, dealt int")
    counts |= {(r.dealt, r.old, r.block): r.n for r in dealt.groupBy("dealt", "old", "block").agg(F.sum("n").alias("n")).collect()}
    found = dealt.drop("n").withColumnRenamed("doc_id", "dealt_id")
    parted_rows = split.join(found, ["old", "block", "size", "text_crc32"]).where(F.col("doc_id").eqNullSafe(F.col("dealt_id"))).withColumn("shard", F.col("dealt")).drop("dealt", "dealt_id")
    both = placed.where("shard >= 0").unionByName(parted_rows)

    first, taken = [], defaultdict(int)
    for (shard, o, b), n in sorted(counts.items()):
        first.append((shard, o, b, taken[shard]))
        taken[shard] += n
    offsets = spark.createDataFrame(first, "shard int, old int, block int, first long")
    rank = F.row_number().over(W.partitionBy("shard", "old", "block").orderBy("doc_id", "text_crc32", "size"))
    return both.join(F.broadcast(offsets), ["shard", "old", "block"]).withColumn("slot", F.col("first") + rank - 1).drop("first")


def rewrite(assigned: DataFrame, path: str, moved_only: bool = False) -> None:
    """Write the shards' files below ``path``/shard=N; with ``moved_only`` just the documents that changed shards."""
    rows = assigned.where("shard <> old") if moved_only else assigned
    rows.write.partitionBy("shard").parquet(path)


def reshard(docs: DataFrame, old: Column, shards: int, path: str | None = None) -> DataFrame:
    """Rewrite all documents into ``shards`` shards and describe what the files hold."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "shards")
    rewrite(assign(docs, old, shards), path)
    kept = spark.read.schema("doc_id long, text string, old int, block int, slot long, shard int").parquet(path)
    value = F.coalesce(F.col("text"), F.lit(""))
    return kept.select(
        "doc_id", (F.octet_length(value) + F.lit(1)).cast("long").alias("size"), F.crc32(value).alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"),
    )
