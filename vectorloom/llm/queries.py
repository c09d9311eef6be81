"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_windows, decontam, gam, knn_join, langid, mixing, neardup, ngram_lm, pii, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_voronoi_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn_join.knn_join(table(spark, sf_dir, "embeddings"))
    return found.withColumn("distance", F.round("distance", 6))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows.chat_windows(table(spark, sf_dir, "conversations"))


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the archives are written too; where a record lies in them is left out, as SQL can't know
    return warc.resolve_pages(table(spark, sf_dir, "pages")).drop("archive", "offset", "length")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_pii_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"))


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(table(spark, sf_dir, "documents"))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_voronoi_knn_join, op2_chat_windows, op3_template_decontamination, op4_warc_revisits, op5_minhash_near_dedup, op6_language_id, op7_source_mixing, op8_pii_redaction, op9_ngram_lm, op10_quality_gam)
}

_UUID = "concat('urn:uuid:', h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32])"
SQL: dict[str, str] = {
    "op1_voronoi_knn_join": f"""
        WITH v AS (SELECT vec_id, min(embedding::DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL GROUP BY vec_id),
        d AS (SELECT a.vec_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, (row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor_id))::INT AS rank FROM d)
        SELECT vec_id, neighbor_id, rank, round(distance, 6) AS distance FROM r WHERE rank <= {knn_join.K}""",
    "op4_warc_revisits": f"""
        WITH c AS (
            SELECT page_id, url, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n, k.warc_date, md5(concat(coalesce(page_id::VARCHAR, ''), '|', k.warc_date, '|', coalesce(url, ''))) AS h
            FROM pages, (VALUES ('{warc.FIRST_CRAWL}'), ('{warc.SECOND_CRAWL}')) k(warc_date)),
        r AS (SELECT *, {_UUID} AS record, warc_date = '{warc.FIRST_CRAWL}' AS response FROM c),
        o AS (SELECT *, min(CASE WHEN response THEN record END) OVER (PARTITION BY digest) AS original FROM r)
        SELECT record, CASE WHEN record = original THEN 'response' ELSE 'revisit' END AS new_type, url AS target_uri, warc_date, digest, original,
            CASE WHEN record = original THEN n + length(n::VARCHAR) ELSE 1 END + {len(warc.HTTP) + 4} AS block_length
        FROM o""",
}
