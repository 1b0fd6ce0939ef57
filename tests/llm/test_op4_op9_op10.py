import html
import random

import pytest

from stepframe.llm import op4_decontamination as op4
from stepframe.llm import op9_quality as op9
from stepframe.llm import op10_wrappers as op10


def test_containment_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op4, "BLOCK_HASHES", 60)  # several blocks of items
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(300)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(30)] + [(90, None), (91, " "), (92, "Two words"), (93, "two WORDS")]
    texts = [None, "", "two\twords", "two words here and there"]
    for i, t in items[:30]:
        w = t.split()
        for cut in (0, 1, 3, 8):
            part = w[cut:] if cut % 2 else w[: len(w) - cut]
            if rng.random() < 0.5 and len(part) > 12:
                part[6:6] = ["odd"]
            texts.append(" ".join([word() for _ in range(rng.randint(0, 400))] + [x.upper() for x in part] + [word() for _ in range(50)]))
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, t, _ in [*rows, rows[4]]:
        for i, it in items:
            s = op4.shingle_words(it)
            own = op4.shingle_words(t, min(5, len((it or "").split())) or 5)
            if s and 4 * len(s & own) >= 3 * len(s):
                want.append((d, i, len(s), len(s & own)))
    assert sorted(tuple(r) for r in op4.find(docs, bench).collect()) == sorted(want) and len(want) > 40
    left = op4.without_benchmark(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _, _ in [*rows, rows[4]] if d not in {w[0] for w in want})
    assert op4.find(docs.limit(0), bench).count() == 0 and op4.find(docs, bench.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled():
    import duckdb

    d = "/root/testdata/sf0.01"
    return duckdb.sql(f"SELECT doc_id, text, quality FROM '{d}/documents.parquet' LEFT JOIN '{d}/labels.parquet' USING (doc_id)").fetchall()


def test_classifier_agrees_with_held_out_labels(spark, labelled):
    docs = spark.createDataFrame([(i, t, "k") for i, t, _ in labelled] + [(-1, None, "k"), (-2, " \n", "k")], "doc_id long, text string, score string")
    keep = {r.doc_id: r.keep for r in op9.classify(docs).collect()}
    assert len(keep) == len(labelled) + 2 and not keep[-1] and not keep[-2]
    good = [keep[i] for i, _, q in labelled if q == 1]
    bad = [keep[i] for i, _, q in labelled if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad) and len(bad) > 20
    left = op9.good_only(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, k in keep.items() if k}
    assert op9.classify(docs.limit(0)).count() == 0


def test_classifier_treats_equal_rows_alike_and_takes_long_texts(spark, labelled):
    rows = [(i, t) for i, t, _ in labelled[:150]]
    long = " ".join(t for _, t, q in labelled if q == 1 and t)
    docs = spark.createDataFrame([*rows, *rows[:40], (-5, long * (3_000_000 // len(long) + 1)), *[(None, t) for _, t in rows[:30]]], "doc_id long, text string")
    one, two = ([tuple(r) for r in op9.classify(d).collect()] for d in (docs, docs.repartition(5)))
    assert sorted(one, key=str) == sorted(two, key=str) and len(one) == 221
    score = {}
    for i, x, keep in one:
        if i is not None:
            assert score.setdefault(i, (x, keep)) == (x, keep)
    assert score[-5][1]


def test_features_do_not_depend_on_how_texts_are_cut(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = pa.array(["", "Some WORDS, and 12 more.", None, "a|b|c " * 300, "é è 3", "x", " "])
    votes, features = op9.described(texts)
    monkeypatch.setattr(op9, "STRETCH", 7)
    again = op9.described(texts)
    assert (votes == again[0]).all() and (features == again[1]).all()
    for i in range(len(texts)):
        alone = op9.described(texts.slice(i, 1))
        assert (alone[0][0] == votes[i]).all() and np.array_equal(alone[1][0], features[i])


def brute_posteriors(patterns, steps=100):
    """The label model, vote by vote, in plain Python."""
    n, j_all = sum(patterns.values()), range(len(op9.LABELLERS))
    table = {(j, c): ([0.65, 0.34, 0.01] if c == 0 else [0.97, 0.02, 0.01]) if j < op9.BAD_ONLY else ([0.2, 0.6, 0.2] if c == 0 else [0.2, 0.1, 0.7]) for j in j_all for c in (0, 1)}
    prior, good = 0.8, {}
    for _ in range(steps):
        for p in patterns:
            like = [1 - prior, prior]
            for j, v in enumerate(p):
                like = [like[c] * table[j, c][v + 1] for c in (0, 1)]
            good[p] = like[1] / sum(like)
        mass = {c: sum(k * (good[p] if c else 1 - good[p]) for p, k in patterns.items()) for c in (0, 1)}
        table = {(j, c): [(sum(k * (good[p] if c else 1 - good[p]) for p, k in patterns.items() if p[j] + 1 == v) + 1) / (mass[c] + 3) for v in range(3)] for j in j_all for c in (0, 1)}
        prior = min(max(mass[1] / n, 0.01), 0.99)
    return good


def test_label_model_equals_brute_force():
    rng = random.Random(8)
    patterns = {}
    for _ in range(300):
        p = tuple(rng.choice([-1, -1, 0]) if j < op9.BAD_ONLY else rng.choice([-1, 0, 1, 1]) for j in range(len(op9.LABELLERS)))
        patterns[p] = patterns.get(p, 0) + 1
    got, want = op9.label_model(patterns)[0], brute_posteriors(patterns)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in patterns)


def test_label_model_finds_accuracies():
    rng = random.Random(0)
    n = len(op9.LABELLERS)
    patterns: dict = {}
    for _ in range(4000):
        good = rng.random() < 0.7
        votes = tuple((-1 if good or rng.random() < 0.4 else 0) if j < op9.BAD_ONLY else int(good if rng.random() < 0.85 else not good) for j in range(n))
        patterns[votes] = patterns.get(votes, 0) + 1
    posterior, table = op9.label_model(patterns)
    assert all(0.75 < table[j, 1, 2] < 0.95 and 0.75 < table[j, 0, 1] < 0.95 for j in range(op9.BAD_ONLY, n))
    assert all(0.5 < table[j, 0, 1] < 0.7 for j in range(op9.BAD_ONLY))


PAGE = "<!DOCTYPE html><html><head><title>T</title><script>var a='<p>no</p>';</script></head><body><nav><ul>{nav}</ul></nav>{ad}<article><h1>{h}</h1>{ps}</article><footer>&copy; x</footer></body></html>"


def page(rng, i):
    ps = [f"p{i} " + " ".join(f"w{rng.randrange(99)} &amp; <b>x</b>y" for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))]
    body = "".join(f"<p>{p}</p>" if rng.random() < 0.8 else f"<p>{p}<br>" for p in ps)
    ad = '<div class="ad">buy now</div>' if rng.random() < 0.5 else ""
    want = " ".join([f"H {i}", *[html.unescape(p.replace("<b>", "").replace("</b>", "")) for p in ps]])
    return PAGE.format(nav="".join(f"<li><a href=x>n{k}</a></li>" for k in range(rng.randint(1, 6))), ad=ad, h=f"H  {i}", ps=body), want


def test_main_text(spark):
    rng = random.Random(1)
    made = [page(rng, i) for i in range(60)]
    rows = [(i, f"http://h{i % 3 if i > 30 else 0}.org/{i}", p, "x") for i, (p, _) in enumerate(made)]
    rows += [(100, None, made[0][0], "x"), (101, "http://h0.org", None, "x"), (102, "bad", "", "x"), (103, "http://n.org", "plain &lt; text <b>bold", "x"), (104, "http://n.org", '<div id="comments"><p>hi</p></div><main><p>a<p>b &nbsp; c</main><aside>no', "x"), rows[0]]
    got = op10.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    want = {i: w for i, (_, w) in enumerate(made)} | {100: made[0][1], 101: "", 102: "", 103: "plain < text bold", 104: "a b c"}
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text), r.page_id
    assert op10.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_accepts_its_pages_and_is_union_free():
    rng = random.Random(2)
    streams = [[s for s, t in op10.tokens(page(rng, i)[0]) if s != "#" or t.strip()] for i in range(40)]
    wrapper = op10.infer([op10.fold(s) for s in streams])
    text = op10.expression(wrapper)
    assert "( li a # /a /li )+" in text and "( div.ad # /div )?" in text and "|" not in text
    assert all(op10.accepts(wrapper, s) for s in streams)
    assert [p for p, r in op10.slots(wrapper).items() if r == op10.MAIN] == ["html body article h1", "html body article p"]


def test_text_that_a_hosts_pages_share_is_template(spark):
    rng = random.Random(3)
    words = lambda: " ".join(f"w{rng.randrange(999)}" for _ in range(9))
    menu, notice = "<div><a href=/>Home</a><a href=/a>About us</a></div>", "<div>We use small files.</div>"
    rows, want = [], {}
    for i in range(12):
        ps = [words() for _ in range(rng.randint(1, 4))]
        rows.append((i, "http://plain.org/x", f"<body>{menu}<h1>{ps[0]}</h1>{notice if i % 2 else ''}{''.join(f'<p>{p}</p>' for p in ps)}<div>All rights</div></body>"))
        want[i] = " ".join([ps[0], *ps])
        rows.append((100 + i, "http://main.org/x", f"<article><h1>{ps[0]}</h1><div>Tell a friend</div><p>{ps[-1]}</p>{'<blockquote>same</blockquote>' if i < 6 else ''}</article>"))
        want[100 + i] = f"{ps[0]} {ps[-1]}" + (" same" if i < 6 else "")
        rows.append((200 + i, "http://copies.org/x", f"<body><h1>One article</h1><p>copied</p><nav>{i}</nav></body>"))
        want[200 + i] = "One article copied"
    rows += [(300 + i, "http://two.org", f"<body><div>Home</div><p>{i}</p></body>") for i in range(2)]
    want |= {300: "Home 0", 301: "Home 1"}
    got = op10.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_every_word_of_a_tag_is_judged():
    side = '<div class="col-12 col-md-4 order-2 sidebar"><p>side</p></div><div class="row wide x" role="complementary">more</div>'
    assert op10.text_of(f"<article><p>a</p>{side}</article>", {}) == "a" and op10.text_of(f"<body>{side}<p>a</p></body>", {}) == "a"
    assert op10.text_of('<body><p>other</p><div class="col-12 col-md-8 order-1 content"><p>a</p></div></body>', {}) == "a"
