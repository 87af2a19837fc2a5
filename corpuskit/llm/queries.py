"""Registered queries of the operators (``queries()``) and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm import (
    fim, licenses, lm, mixing, negatives, neighbours, packing, pages, quality, secret_scan, simhash, token_counts, warc)
from corpuskit.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    got = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(read(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.top_k(rows, rows.filter("vec_id % 20 = 0"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(read(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return negatives.mine(rows, rows.filter("vec_id % 50 = 0"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_token_counts, op2_simhash_near_dedup, op3_license_scan, op4_secret_scan, op5_mixing, op6_packing,
        op7_pseudo_likelihood, op8_nearest_neighbours, op9_quality_rules, op10_page_text,
        op11_hard_negatives, op12_warc, op13_fill_in_middle)}

MIXING_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS BIGINT) + 0.5::DOUBLE)
           / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER f, 0))
            / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM weighed WINDOW f AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, least(most, (SELECT arg_min(level, most / w) FROM levels WHERE most >= level * w) * w) AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM goal),
rests AS (
  SELECT *, greatest(0, CAST(floor(target + 0.5) AS BIGINT) - copies * source_size) AS sample,
         CASE WHEN source_size > 0 THEN target / source_size - copies ELSE 0 END AS pi FROM parts),
ranked AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.copies, r.sample, d.source,
         CASE WHEN r.pi > 0 THEN (d.u / (1 - d.u)) / (r.pi / (1 - r.pi)) END AS rk
  FROM docs d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source),
run AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rk RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY source, rk) AS tied
  FROM ranked)
SELECT doc_id, size, source_size, target,
       CAST(copies * size + CASE WHEN rk IS NULL OR sample <= upto - tied THEN 0 WHEN sample > upto THEN size
            WHEN tied = 0 THEN 0 ELSE (size * (sample - upto + tied)) // tied END AS BIGINT) AS taken
FROM run
"""

SQL: dict[str, str] = {"op3_license_scan": licenses.oracle_sql(), "op5_mixing": MIXING_SQL,
                       "op11_hard_negatives": negatives.ORACLE_SQL, "op12_warc": warc.ORACLE_SQL, "op13_fill_in_middle": fim.ORACLE_SQL}
