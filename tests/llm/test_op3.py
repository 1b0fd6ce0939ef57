import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stepframe.llm.op3_resharding import min_cost_flow, reshard


def test_flow_moves_the_fewest_bytes():
    cost = [[int(i != j) for j in range(3)] for i in range(3)]
    flow = min_cost_flow([9, 3, 0], [4, 4, 4], cost)
    assert [sum(r) for r in flow] == [9, 3, 0] and [sum(c) for c in zip(*flow, strict=True)] == [4, 4, 4]
    assert sum(flow[i][j] for i in range(3) for j in range(3) if i != j) == 5


def test_flow_reroutes():
    assert min_cost_flow([1, 1], [1, 1], [[0, 1], [0, 9]]) == [[0, 1], [1, 0]]


def test_shards(spark):
    texts = [None, "", "é" * 50, *["same text"] * 300, *[("w%d " % i) * (i % 37) for i in range(900)], "long " * 9000]
    rows = [(i, t, f"src{i % 3 if i < 400 else 0}", 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no key", "src0", 7), (None, None, "src1", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    old = F.pmod(F.crc32("source"), F.lit(8))
    out = reshard(docs, old, 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    rest = [sizes[s] for s in range(8)]
    assert max(rest) - min(rest) <= 9000 * 5 + 1
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in reshard(docs, old, 8).collect()}
    assert sum(r.shard != r.old_shard for r in out) < len(out)
    assert reshard(docs.limit(0), old, 8).count() == 0


def test_near_equal_on_many_small_documents(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('ab ', cast(id % 90 as int))").alias("text"))
    sizes = [r.s for r in reshard(docs, F.lit(0), 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) < 0.01 * max(sizes)
