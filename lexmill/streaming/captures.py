"""Streams: crawl states against each URL's last capture, and bundle rows imported in micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = "url string, id long, sha256 string, previous_sha256 string, crawl_status string"
PROGRESS = ("batch", "lines", "bytes", "rows")


def _follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values(["at", "id"])  # a url's fetches in one micro-batch
    out = []
    for r in rows.itertuples():
        sha = r.sha256 if isinstance(r.sha256, str) else None
        status = "error" if sha is None else "new" if last is None else "unchanged" if last == sha else "changed"
        out.append((key[0], r.id, sha, last, status))
        last = sha or last
    state.update((last,))
    yield pd.DataFrame(out, columns=["url", "id", "sha256", "previous_sha256", "crawl_status"])


def capture_states(fetches: DataFrame) -> DataFrame:
    """The states of a stream of fetches (url, at, id, sha256), which reach a url in order of time: its state is the last hash alone."""
    return fetches.groupBy("url").applyInPandasWithState(_follow, STATES, "last string", "append", GroupStateTimeout.NoTimeout)


def last_of_each(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of the rows of each key the one that comes last in `order` (columns of rows, dropped from the result): as when each overwrites the one before.

    A maximum with a partial step in each task, so a key of very many rows is no bottleneck; null keys are a key of their own.
    """
    names = [c for c in rows.columns if c not in (*key, *order)]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*(names or key)), F.struct(*order)).alias("__m"))
    return last.select(*key, *[F.col(f"__m.{n}") for n in names])


def import_rows(rows: DataFrame, target: str, key: list[str], checkpoint: str, order: list[str], batch_rows: int = 500_000, progress: str | None = None, size: str | None = None):
    """Appends a stream of rows to a Parquet folder, in each micro-batch the last row of each key by `order`; returns the query.

    Batches are numbered, and a batch that is run again after a failure replaces its own folder. A file holds batch_rows at
    most. With `progress`, a folder, each batch leaves a row of PROGRESS there: what came in (rows of the stream, and the
    sum of the column `size`) and what was written, observed while the batch is written.
    """

    def put(batch: DataFrame, number: int) -> None:
        came, went = Observation(), Observation()
        seen = batch.observe(came, F.count("*").alias("lines"), (F.coalesce(F.sum(size), F.lit(0)) if size else F.lit(None).cast("long")).alias("bytes"))
        kept = last_of_each(seen.drop(size) if size and size not in (*key, *order) else seen, key, order).observe(went, F.count("*").alias("rows"))
        kept.write.mode("overwrite").option("maxRecordsPerFile", batch_rows).parquet(f"{target}/batch={number}")
        if progress:
            row = [(number, came.get["lines"], came.get["bytes"], went.get["rows"])]
            batch.sparkSession.createDataFrame(row, "batch long, lines long, bytes long, rows long").coalesce(1).write.mode("overwrite").parquet(f"{progress}/of={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_rows(table: DataFrame) -> DataFrame:
    """Rows (batch, lines, bytes, rows, lines_so_far, bytes_so_far, rows_so_far) of a progress folder: a row a batch."""
    before = table.select(*(F.col(c).alias(f"{c}_") for c in PROGRESS))
    sums = table.join(before, F.col("batch_") <= F.col("batch")).groupBy(*PROGRESS)
    return sums.agg(*(F.sum(f"{c}_").alias(f"{c}_so_far") for c in PROGRESS[1:]))


def latest_rows(target: DataFrame, key: list[str]) -> DataFrame:
    """Of an imported folder the row of the last batch for each key."""
    names = [c for c in target.columns if c not in (*key, "batch")]
    last = target.groupBy(*key).agg(F.max_by(F.struct(*names), "batch").alias("m"))
    return last.select(*key, *[F.col(f"m.{n}") for n in names])
