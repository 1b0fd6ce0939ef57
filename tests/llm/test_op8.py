import random
import re

import pyarrow as pa
import pytest

from stepframe.llm import op8_jaccard_join as op8
from stepframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


def varied(seed, n_base=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(40)
    out = []
    for _ in range(n_base):
        base = text(rng.randint(1, 120))
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 1, 3, 8])):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(words))
                words[k : k + 1] = rng.choice([[], ["new"], [words[k].upper()]])
            out.append(rng.choice([" ", "\n ", "\t"]).join(words))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "hot", "tile", "best"), [(0, 1 << 16, 1024, 3), (1, 4, 3, 1), (2, 2, 1, 1)])
def test_matches_brute_force(spark, monkeypatch, seed, hot, tile, best):
    for name, value in (("HOT", hot), ("TILE", tile), ("BEST", best)):
        monkeypatch.setattr(op8, name, value)
    texts = [*varied(seed), None, "", "  \n", "one", "ONE", "one two", "é " * 9, *["same words in every copy of this text"] * 40]
    hub = [f"h{i}" for i in range(60)]
    texts += [" ".join(hub[: 60 - k] + [f"x{k}"] * (k > 0)) for k in range(12)]  # a chain of near copies
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long")
    assert sorted(tuple(r) for r in op8.join_classes(df.repartition(3)).collect()) == brute(rows)
    if seed == 0:
        more = df.unionByName(spark.createDataFrame([(None, rows[-1][1], 0), (None, None, 0)], df.schema))
        got = [tuple(r) for r in op8.join_classes(more).collect()]
        assert sorted(r for r in got if r[0] is not None) == brute(rows) and sum(r[0] is None and r[2] is None for r in got) == 2
        assert op8.one_of_each(more).columns == df.columns


def test_pairs_to_check_grow_with_rows_and_not_with_their_square(spark, monkeypatch):
    counted, real = [], op8.verified
    monkeypatch.setattr(op8, "verified", lambda pairs, *rest: counted.append(pairs.count()) or real(pairs, *rest))
    rng = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(500):  # near copies of one text, and as many texts that are mostly one passage
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
        rows.append((1000 + i, " ".join([f"y{i}.{k}" for k in range(30)] + [f"p{k}" for k in range(60)])))
    got = op8.join_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.component_id for r in got if r.doc_id < 1000} == {0} and all(r.component_id == r.doc_id for r in got if r.doc_id >= 1000)
    assert sum(counted) < 4 * len(rows)


def test_one_long_text(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, long), (2, long + " and more"), (3, long[: len(long) // 2])]
    got = sorted(tuple(r) for r in op8.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [(r[0], r[2]) for r in got] == [(1, 1), (2, 1), (3, 3)]


def test_empty_table(spark):
    assert op8.join_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_workers_give_freed_memory_back(spark):
    def held(batches):
        for b in batches:
            own = dict(x.split(":", 1) for x in open("/proc/self/status") if x.startswith(("RssAnon", "VmRSS")))
            yield b.append_column("mb", pa.array([int(own["RssAnon"].split()[0]) / 1024] * len(b))).select(["mb"])

    measure = lambda: max(r.mb for r in spark.range(0, 4, 1, 4).mapInArrow(held, "mb double").collect())
    before = measure()
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(300)) for _ in range(4000)]
    docs = spark.createDataFrame([(i, texts[i % 4000]) for i in range(24_000)], "doc_id long, text string").repartition(4)
    op8.column_counts(docs)
    after = measure()
    assert after < before + 40, (before, after)
