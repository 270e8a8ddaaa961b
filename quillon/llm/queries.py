"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.centroids import oracle as centroids_sql
from quillon.llm.outliers import oracle as outliers_sql
from quillon.llm.url_filter import oracle as url_filter_sql

OP4_SQL = url_filter_sql()


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.source_mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


#: u and key as in mix_sources, with DuckDB's functions.
OP2_SQL = """
WITH sized AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS digest,
         coalesce(length(text) - length(translate(text, '#*$%&|<>{}[]=_~^\\', '')), 0) AS marks
  FROM documents),
keyed AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(digest, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656::DOUBLE)
           / (1::DOUBLE / (1::DOUBLE + marks::DOUBLE / greatest(size, 1)::DOUBLE)) AS key
  FROM sized),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY source),
weighted AS (
  SELECT *, [1, 2, 3][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) + 1] AS weight, source_size * 3 AS most
  FROM totals),
ranked AS (SELECT *, row_number() OVER (ORDER BY most::DOUBLE / weight, source ASC NULLS LAST) AS r FROM weighted),
levels AS (
  SELECT a.*, ((SELECT sum(source_size) FROM totals) - coalesce((SELECT sum(b.most) FROM ranked b WHERE b.r < a.r), 0))::DOUBLE
              / (SELECT sum(b.weight) FROM ranked b WHERE b.r >= a.r)::DOUBLE AS level
  FROM ranked a),
chosen AS (SELECT coalesce(arg_min(level, r), 'inf'::DOUBLE) AS level FROM levels WHERE level * weight < most),
targets AS (SELECT source, source_size, least(chosen.level * weight, most::DOUBLE) AS target FROM ranked, chosen),
planned AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS BIGINT) AS epochs
  FROM targets),
drawn AS (
  SELECT k.doc_id, k.size, k.source, p.source_size, p.target, p.epochs,
         CAST(round(p.target) AS BIGINT) - p.epochs * p.source_size
           - coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget
  FROM keyed k JOIN planned p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source, source_size, target, CAST(epochs * size + greatest(0, least(size, budget)) AS BIGINT) AS taken, epochs
FROM drawn
"""


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.ann import nearest_neighbours

    return nearest_neighbours(_table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillon.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages")).withColumns({c: F.round(c, 9) for c in ("trust", "distrust")})


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The (doc_id, item_id) pairs of contaminated documents; clean documents have no row."""
    from quillon.llm.decontamination import contaminated_pairs

    return contaminated_pairs(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.language_id import identify_languages

    return identify_languages(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import score_quality

    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, a tenth of them with a planted periodic end."""
    from quillon.llm.periodic_runs import periodic_runs, plant_runs, run_digests

    return run_digests(periodic_runs(plant_runs(_table(spark, sf_dir, "documents"))))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.centroids import cluster_vectors

    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.outliers import reject_outliers

    return reject_outliers(_table(spark, sf_dir, "documents")).drop("distance")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_source_mixing": op2_source_mixing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_quality": op7_quality,
    "op8_license_scan": op8_license_scan,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_toxicity": op10_toxicity,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_quality_rules": op13_quality_rules,
}

SQL: dict[str, str] = {
    "op2_source_mixing": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op12_centroid_clustering": centroids_sql(),
    "op13_quality_rules": outliers_sql(),
}
