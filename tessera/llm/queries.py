"""Registered queries of this subpackage: thin calls of its operators with
production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import (embedding_dedup, language, lexical_search, mixing, packing, pii, quality, simhash, spelling,
                         token_counts, token_file, toxicity, weighted_sampling)
from tessera.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_file.token_file_path(spark)
    token_file.write_token_file(table(spark, sf_dir, "documents"), path)
    return token_file.read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mixing.domain_labels(table(spark, sf_dir, "labels"))
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), domains)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality, op3_embeddings, op4_toxicity, op5_packing, op6_token_file,
                                   op7_weighted_sampling, op8_language, op9_simhash, op10_mixing, op11_spelling, op12_lexical_search,
                                   op13_pii)}

#: DuckDB SQL where it can express an operator: here all pairs of vectors and
#: what they reach.
ORACLE: dict[str, str] = {"op12_lexical_search": lexical_search.ORACLE, "op3_embeddings": """
WITH RECURSIVE own AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
v AS (
  SELECT r, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM own
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r <> b.r
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reached AS (
  SELECT r AS a, r AS b FROM own
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
component AS (SELECT a AS r, min(vec_id) AS component_id FROM reached JOIN own ON b = r GROUP BY a),
counted AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM component JOIN own USING (r) LEFT JOIN counted USING (r)
"""}
