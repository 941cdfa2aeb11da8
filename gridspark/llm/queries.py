"""One query per text operator, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import bpe, collocations, fingerprints, html_text, language, mixing, ngram_join, pii, quality, sharding, simhash, toxicity, whitening
from gridspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=90)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise_documents(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_pii": op2_pii,
        "op3_language_id": op3_language_id,
        "op4_html_text": op4_html_text,
        "op5_bpe": op5_bpe,
        "op6_fingerprints": op6_fingerprints,
        "op7_sharding": op7_sharding,
        "op8_quality_rules": op8_quality_rules,
        "op9_source_mixing": op9_source_mixing,
        "op10_toxicity": op10_toxicity,
        "op11_whitening": op11_whitening,
        "op12_simhash": op12_simhash,
        "op13_collocations": op13_collocations,
    }


#: All pairs of documents that share a 3-word shingle, then the smallest doc_id that spreads along the links.
NGRAM_JOIN_SQL = r"""WITH RECURSIVE w AS (
 SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
 SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[][]) WHEN len(w) < 3 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s FROM w),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS MATERIALIZED (
 SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) WHERE 100 * c >= 90 * (n + m - c)),
spread(id, low) USING KEY (id) AS (
 SELECT doc_id, doc_id FROM documents UNION
 SELECT p.b, min(t.low) FROM spread t JOIN pairs p ON p.a = t.id JOIN recurring.spread r ON r.id = p.b WHERE t.low < r.low GROUP BY p.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CAST(t.low AS BIGINT) AS component_id FROM s JOIN spread t ON t.id = s.doc_id"""


#: Phrases of up to three words by list slices, each cut by a join, exact in 128-bit whole numbers.
COLLOCATIONS_SQL = r"""WITH p AS MATERIALIZED (
 SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
f AS MATERIALIZED (
 SELECT lang, m, phrase, count(*) AS f FROM (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3)) AS v(m) WHERE len(w) >= m) GROUP BY 1, 2, 3),
c AS MATERIALIZED (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
parts AS MATERIALIZED (
 SELECT lang, m, phrase, a, k, concat(lang, '/', array_to_string(w[1:k], ' ')) AS x, concat(lang, '/', array_to_string(w[k + 1:m], ' ')) AS y FROM c JOIN (VALUES (1), (2)) AS v(k) ON k < m),
g AS MATERIALIZED (SELECT concat(lang, '/', phrase) AS id, f FROM f WHERE f >= 10),
left_parts AS MATERIALIZED (SELECT parts.*, g.f AS l FROM parts JOIN g ON g.id = x),
cuts AS (
 SELECT lang, m, phrase, a, k, l, g.f AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * g.f) AS BIGINT) AS score FROM left_parts JOIN g ON g.id = y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
 SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE m = 3) GROUP BY 1, 2),
words AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY 1),
ranked AS (
 SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank
 FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.a IS NULL OR 100 * o.a < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN words USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": NGRAM_JOIN_SQL, "op13_collocations": COLLOCATIONS_SQL}
