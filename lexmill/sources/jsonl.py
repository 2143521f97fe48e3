"""JSON lines and payload files as DataFrames, with explicit schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LINE = 4 * 1024 * 1024


def tolerant(spark: SparkSession, paths: list[str] | str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): lines that do not parse are kept apart, blank ones skipped."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    # from text: a query on the corrupt column alone is not allowed on the JSON source
    lines = spark.read.text(paths).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return rows.where("r._corrupt_record IS NULL").select(*[F.col(f"r.{f.name}") for f in schema]), rows.where("r._corrupt_record IS NOT NULL").select(F.col("r._corrupt_record").alias("line"))


def strict_lines(lines: DataFrame, limit: int = MAX_LINE) -> DataFrame:
    """Lines (value) without blank ones; a line of more bytes than the limit stops the query."""
    value = F.when(F.octet_length("value") > limit, F.raise_error(F.lit("line over the limit"))).otherwise(F.col("value"))
    return lines.where(F.trim("value") != "").select(value.cast("string").alias("value"))


def strict(lines: DataFrame, schema: T.StructType, required: Column) -> DataFrame:
    """Rows of JSON lines; a line that does not parse, or whose row does not meet `required`, stops the query."""
    rows = strict_lines(lines).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.where(F.when(F.coalesce(required, F.lit(False)), True).otherwise(F.raise_error(F.lit("row without a required field")).cast("boolean")))


PLACE = ("path", "block", "row")


def placed_lines(spark: SparkSession, paths: list[str] | str, limit: int = MAX_LINE) -> DataFrame:
    """Lines (value) with their place (path, block, row), which orders them as they stand in each file; blank ones are skipped.

    Read by Spark's own text source: a block's rows are numbered where they are read, so nothing is counted beforehand; line
    numbers are those of `lines.numbered_lines`.
    """
    found = spark.read.option("lineSep", "\n").text(paths)
    place = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    value = F.when(F.octet_length("value") > limit, F.raise_error(F.lit("line over the limit"))).otherwise(F.regexp_replace("value", "\r$", ""))
    return found.select(value.cast("string").alias("value"), *place).where(F.trim("value") != "")


def url_list(lines: DataFrame) -> DataFrame:
    """URLs of a list: trimmed, without blank lines and comments."""
    return lines.select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


@F.pandas_udf(T.BinaryType())
def unzstd(content: pd.Series) -> pd.Series:
    import zstandard

    open_ = zstandard.ZstdDecompressor()
    return content.map(lambda c: None if c is None else open_.decompressobj().decompress(bytes(c)))


@F.pandas_udf(T.BinaryType())
def zstd(content: pd.Series) -> pd.Series:
    import zstandard

    pack = zstandard.ZstdCompressor(3)
    return content.map(lambda c: None if c is None else pack.compress(bytes(c)))


def write_payloads(pages: DataFrame, folder: str) -> None:
    """Pages (snapshot_id, html) compressed as Parquet; what is there already stays as it is, so a payload never changes."""
    spark = pages.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    new = pages.select("snapshot_id", zstd("html").alias("payload")).dropDuplicates(["snapshot_id"])
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        new = new.join(spark.read.parquet(folder).select("snapshot_id"), "snapshot_id", "left_anti")
    new.write.mode("append").parquet(folder)


def payloads(spark: SparkSession, folder: str, suffix: str = ".html.zst") -> DataFrame:
    """Rows (snapshot_id, html) of compressed payload files; the id is the file's name."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
    return found.select(F.replace(F.element_at(F.split("path", "/"), -1), F.lit(suffix), F.lit("")).alias("snapshot_id"), unzstd("content").alias("html"))


def snapshot_meta(rows: DataFrame) -> DataFrame:
    """The last row of each snapshot_id by line_no; rows without an id are dropped."""
    return rows.where("snapshot_id IS NOT NULL").groupBy("snapshot_id").agg(F.max_by(F.struct("*"), "line_no").alias("m")).select("m.*")
