import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepframe.llm.op1_mtree import NONE, Best, MTree, top_k


def brute(rows, k, every):
    held = {}
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in good:
        if q % every == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good if i != q)
            held[q] = [(i, -x) for x, i in s[:k]]
    return held


def got(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * 0.2).astype(np.float32).tolist()) for i in range(3000)]
    rows += [(i, rows[0][1]) for i in range(3000, 3900)]  # one common vector: many ties
    rows += [(4000, None), (4010, [None] * 8), (4020, [float("nan")] + [0.0] * 7), (4030, [float("inf")] * 8), (4040, [1.0]), (4050, []), (4060, [0.0] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    assert got(top_k(df, 5, 10)) == brute(rows, 5, 10)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, -1.0])], "vec_id long, embedding array<float>")
    assert got(top_k(df, 10, 100)) == {0: [(1, 512 * 1024 - 1024 * 2048)]}
    assert top_k(df.limit(0), 10, 100).count() == 0


def test_pages_compute_fewer_distances_than_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 8)) * 4
    v = np.floor(1024 * (centres[np.arange(2000) % 30] + rng.normal(size=(2000, 8)) * 0.05)).astype(np.int64)
    tree = MTree(np.arange(2000), v, int((v * v).sum(1).max()))
    found, computed = tree.search(v[0], 0, 10, None)
    s = v @ v[0]
    want = sorted(((int(-s[i]), i) for i in range(2000) if i))[:10]
    assert sorted((-a, b) for a, b in found) == want and computed < 1000


def test_large_components_are_whole_or_raise(spark):
    rows = [(0, [1.5e6, -1.25e6]), (1, [1.4e6, 1.0]), (2, [-1.3e6, 2.5]), (3, [0.5, 1.1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(top_k(df, 3, 1)) == brute(rows, 3, 1)
    with pytest.raises(Exception, match="too long for scores"):
        top_k(spark.createDataFrame([*rows, (4, [1e30, 0.0])], df.schema), 3, 1).count()


def test_queries_are_not_broadcast(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(2500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = top_k(df, 5, 10)
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert got(found) == brute(rows, 5, 10)


def test_a_block_of_queries_finds_what_each_finds_alone():
    rng = np.random.default_rng(6)
    v = np.repeat(rng.integers(-900, 900, size=(350, 6)), 2, 0)
    ids = rng.permutation(700)
    tree = MTree(ids, v, int((v * v).sum(1).max()))
    best = Best(50, 4, np.array([NONE, 200_000] * 25))
    q, s, i, _ = tree.search_all(v[:50], ids[:50], best)
    for n in range(50):
        want = sorted((-int(x), int(j)) for x, j in zip(v @ v[n], ids, strict=True) if j != ids[n] and (n % 2 == 0 or x >= 200_000))[:4]
        assert sorted((-int(x), int(j)) for x, j in zip(s[q == n], i[q == n], strict=True))[:4] == want
