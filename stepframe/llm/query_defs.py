"""One query for each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepframe.llm.shared import read_table

LIMIT_TOKENS = 4096


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op1_mtree import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), 10, 100)


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op2_pii import find_pii

    return find_pii(read_table(spark, sf_dir, "documents"))


def op3_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op3_resharding import reshard

    old = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit(""))), F.lit(8))  # the uneven layout to leave: by source
    return reshard(read_table(spark, sf_dir, "documents"), old, 8)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op5_tokens import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), LIMIT_TOKENS)


def op6_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op6_rans_files import write_and_digest

    return write_and_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2, 50_257)


def op7_min_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op7_packing import pack_documents

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 0, 2048)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op8_jaccard_join import join_classes

    return join_classes(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op4_decontamination import find

    return find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op9_quality import classify

    return classify(read_table(spark, sf_dir, "documents"))


def op10_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from stepframe.llm.op10_wrappers import extract

    return extract(read_table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_mtree_top_k": op1_mtree_top_k,
    "op2_pii_spans": op2_pii_spans,
    "op3_flow_resharding": op3_flow_resharding,
    "op5_token_counts": op5_token_counts,
    "op6_rans_token_files": op6_rans_token_files,
    "op7_min_slack_packing": op7_min_slack_packing,
    "op8_jaccard_join": op8_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_html_wrappers": op10_html_wrappers,
}
_WORDS = r"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES = """
    SELECT DISTINCT {key}, array_to_string(w[i : i + 4], ' ') AS s
    FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)
"""
ORACLE_SQL: dict[str, str] = {
    "op10_html_wrappers": r"""
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS h FROM pages),
        t AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS h FROM a),
        e AS (SELECT page_id, url, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&') AS h FROM t),
        f AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(h, '&amp( |$)', '&\1', 'g'), '\s+', ' ', 'g')) AS text FROM e)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM f
    """,
    "op8_jaccard_join": f"""
        WITH RECURSIVE s AS MATERIALIZED ({_SHINGLES.format(key="doc_id", table="documents", words=_WORDS.format(text="text"))}),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS MATERIALIZED (
            SELECT o.a, o.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (s) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) o
            JOIN n na ON na.doc_id = o.a JOIN n nb ON nb.doc_id = o.b WHERE 100 * o.c >= 75 * (na.n + nb.n - o.c)
        ),
        r(doc_id, label) AS (SELECT doc_id, doc_id FROM documents UNION SELECT p.b, r.label FROM r JOIN p ON p.a = r.doc_id)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.label) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
    """,
    "op4_decontamination": f"""
        WITH d AS ({_SHINGLES.format(key="doc_id", table="documents", words=_WORDS.format(text="text"))}),
        b AS ({_SHINGLES.format(key="item_id", table="benchmark", words=_WORDS.format(text="text"))}),
        n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
        SELECT doc_id, item_id, n_shingles, count(*) AS n_common
        FROM d JOIN b USING (s) JOIN n USING (item_id) WHERE len(string_split(s, ' ')) >= 5
        GROUP BY doc_id, item_id, n_shingles HAVING 4 * count(*) >= 3 * n_shingles
        UNION ALL
        SELECT doc_id, item_id, 1, 1
        FROM (SELECT doc_id, ' ' || array_to_string({_WORDS.format(text="text")}, ' ') || ' ' AS t FROM documents)
        JOIN (SELECT item_id, any_value(s) AS s FROM b GROUP BY item_id HAVING max(len(string_split(s, ' '))) < 5) ON contains(t, ' ' || s || ' ')
    """,
    "op1_mtree_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
        SELECT query_id, CAST(rn AS INTEGER) AS rank, vec_id, score FROM r WHERE rn <= 10
    """,
}
