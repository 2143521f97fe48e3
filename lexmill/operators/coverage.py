"""The coverage report of parsed entries, and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.labels import warning_type

MANY_SENSES, MANY_EXAMPLES = 30, 50


def page_coverage(entries: DataFrame) -> DataFrame:
    """By url (missing: unknown) for entries (entry_id, url, senses, examples, has_nko, warnings)."""
    extreme = (F.col("senses") > MANY_SENSES) | (F.col("examples") > MANY_EXAMPLES)
    return entries.groupBy(F.coalesce("url", F.lit("unknown")).alias("url")).agg(
        F.count("*").alias("entries"), F.sum("senses").alias("senses"), F.sum("examples").alias("examples"),
        F.count_if("has_nko").alias("with_nko"), F.count_if(F.col("examples") > 0).alias("with_examples"),
        F.count_if(F.size("warnings") > 0).alias("with_warnings"), F.count_if(extreme).alias("extreme"),
    )


def total_coverage(pages: DataFrame) -> DataFrame:
    """Totals and percentages (0 without entries) over page_coverage."""
    sums = pages.agg(F.count("*").alias("pages"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entries", "senses", "examples", "with_nko", "with_examples", "with_warnings", "extreme")])

    def percent(c: str):
        return F.coalesce(F.round(100.0 * F.col(c) / F.nullif("entries", F.lit(0)), 4), F.lit(0.0)).alias(f"pct_{c[5:]}")

    return sums.select("*", percent("with_nko"), percent("with_examples"), percent("with_warnings"))


def distribution(entries: DataFrame, column: str) -> DataFrame:
    return entries.agg(F.min(column).alias("min"), F.median(column).alias("median"), F.max(column).alias("max"), F.round(F.avg(column), 2).alias("mean"))


def warning_histogram(entries: DataFrame) -> DataFrame:
    return entries.select(F.explode("warnings").alias("w")).groupBy(warning_type(F.col("w")).alias("warning")).agg(F.count("*").alias("n"))
