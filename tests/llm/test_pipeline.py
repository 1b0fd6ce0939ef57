import corpus_pipeline
from stepframe.llm.op4_decontamination import shingle_words


def test_stages_take_effect(spark, tmp_path):
    prose = "it was the best of the days and the people of the town had been in the house for all of the night with the rest of them"
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    story = lambda i: " ".join(f"{w}{i if k % 9 == 4 else ''}" for k, w in enumerate(prose.split() * 4)) + "."
    rows = [(i, story(i), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, "SPAM!! " * 80 if i % 2 else "buy " * 200, "en", "s", 1) for i in range(10)]
    rows += [(200, story(3), "en", "s", 1), (201, story(4) + " more", "en", "s", 1)]
    rows += [(300, f"{story(300)} {item} {story(301)}", "en", "s", 1), (301, f"{story(302)} mail me at joe@example.org or so", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == columns, name
    assert {r.doc_id for r in seen[0]} == {r[0] for r in rows} - set(range(100, 110))
    assert {r.doc_id for r in seen[1]} == {r.doc_id for r in seen[0]} - {200, 201}
    assert {r.doc_id for r in seen[2]} == {r.doc_id for r in seen[1]} - {300} and not any(shingle_words(item) <= shingle_words(r.text) for r in seen[2])
    assert next(r.text for r in seen[3] if r.doc_id == 301).endswith("mail me at [EMAIL] or so")
    assert {r.doc_id for r in seen[4]} == {r.doc_id for r in seen[3]}
    assert sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(tuple(r)[:5] for r in seen[4])
