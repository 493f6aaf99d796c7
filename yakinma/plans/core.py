"""Queries of the general operators for hot keys and timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yakinma.operators import hotkeys, timestamps
from yakinma.plans import timestamp_sql
from yakinma.session import table

DATE_FIELDS = ("complaint_date", "company_response_date", "resolution_date")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.heavy_keys(table(spark, sf_dir, "complaints"), "company", 20)


def p2_company_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.key_figures(table(spark, sf_dir, "complaints"), "company", ("resolved", "company_responded"), ("response_hours", "resolution_hours"))


def p2_company_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotkeys.distinct_per_key(table(spark, sf_dir, "complaints"), "company", "title")


def _instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "company_profiles")
    return timestamps.to_instants(table(spark, sf_dir, "complaints"), DATE_FIELDS, "id", "company", "scraped_at", zones, "company", "time_zone")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _instants(spark, sf_dir).select("id", "field", "epoch_us")


def p3_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the written times of each field were resolved, and the span of the instants."""
    how = _instants(spark, sf_dir).groupBy("field", "how")
    return how.agg(F.count(F.lit(1)).alias("n"), F.min("epoch_us").alias("first_us"), F.max("epoch_us").alias("last_us"))


QUERIES = {f.__name__: f for f in (p2_found, p2_company_figures, p2_company_titles, p3_found, p3_resolution)}

_V = "CASE WHEN NOT isnan({0}) AND {0} >= 0 AND {0} < 'inf'::DOUBLE THEN {0} END"


def _measure(m: str) -> str:
    v = _V.format(m)
    return f"count({v}) AS {m}_n, sum({v}) AS {m}_sum, avg({v}) AS {m}_mean, stddev_samp({v}) AS {m}_sd, min({v}) AS {m}_min, max({v}) AS {m}_max"


SQL = {
    "p2_found": "SELECT company FROM complaints WHERE company IS NOT NULL GROUP BY company HAVING count(*) * 20 > (SELECT count(*) FROM complaints)",
    "p2_company_figures": "SELECT company, count(*) AS n_rows, CAST(sum(coalesce(resolved, 0)) AS BIGINT) AS n_resolved, "
    f"CAST(sum(coalesce(company_responded, 0)) AS BIGINT) AS n_company_responded, {_measure('response_hours')}, {_measure('resolution_hours')} FROM complaints GROUP BY company",
    "p3_found": timestamp_sql.instants(DATE_FIELDS),
    "p3_resolution": timestamp_sql.resolution(DATE_FIELDS, timestamps.FIRST_YEAR, timestamps.LAST_YEAR),
    "p2_company_titles": "SELECT company, count(DISTINCT title) AS n_distinct FROM complaints WHERE title IS NOT NULL GROUP BY company",
}
