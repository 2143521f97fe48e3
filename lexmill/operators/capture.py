"""Crawl history: the latest capture of each URL, and what a new fetch means against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import urls


def latest_by_url(snapshots: DataFrame) -> DataFrame:
    """Of snapshots (url, retrieved_at, snapshot_id, sha256) the last of each url by (time, id): one aggregate, no sort of a url's history."""
    last = F.max_by(F.struct("snapshot_id", "sha256", "retrieved_at"), F.struct("retrieved_at", "snapshot_id"))
    return snapshots.groupBy("url").agg(last.alias("m")).select("url", F.col("m.snapshot_id").alias("previous_id"), F.col("m.sha256").alias("previous_sha256"), F.col("m.retrieved_at").alias("previous_at"))


def crawl_results(fetches: DataFrame, snapshots: DataFrame, match_any_history: bool = False) -> DataFrame:
    """fetches (url, status, sha256, note) with crawl_status, error_details and the previous capture.

    A body is compared with the latest capture; with match_any_history an equal body anywhere in the
    url's history is unchanged too.
    """
    joined = fetches.join(latest_by_url(snapshots), "url", "left")
    before = F.col("previous_sha256")
    if match_any_history:
        seen = snapshots.select("url", F.col("sha256")).distinct().withColumn("seen", F.lit(True))
        joined = joined.join(seen, ["url", "sha256"], "left")
        before = F.when(F.col("seen"), F.col("sha256")).otherwise(before)
    state, error = urls.crawl_outcome(F.col("note"), F.col("status"), F.col("sha256"), before)
    changed = state.isin("changed", "unchanged")
    return joined.select(*fetches.columns, state.alias("crawl_status"), error.alias("error_details"), F.when(changed, F.col("previous_id")).alias("previous_id"))


def capture_history(fetches: DataFrame) -> DataFrame:
    """The states of a url's fetches (url, at, id, sha256; sha256 null: failed) in order: against the last fetch that succeeded before."""
    order = Window.partitionBy("url").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("sha256", ignorenulls=True).over(order)
    state = F.when(F.col("sha256").isNull(), "error").when(before.isNull(), "new").when(before == F.col("sha256"), "unchanged").otherwise("changed")
    return fetches.select("*", before.alias("previous_sha256"), state.alias("crawl_status"))
