"""Hash identities: all are prefixes of a SHA-256 over joined parts; absent parts count as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex16(separator: str, *parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def content_id(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def snapshot_id(url: Column, retrieved_at: Column, sha256: Column) -> Column:
    return _hex16("\n", url, retrieved_at, sha256)


def ir_id(source_id: Column, url: Column, record_id: Column, parser_version: Column) -> Column:
    return _hex16("|", source_id, url, record_id, parser_version)


def bundle_id(kind: Column, day: Column, sha256: Column) -> Column:
    return F.concat_ws("_", F.lit("bundle"), kind, day, F.substring(F.replace(sha256, F.lit("sha256:"), F.lit("")), 1, 8))


def storage_scope(bundle: Column, sha256: Column) -> Column:
    return F.concat(bundle, F.lit("::"), sha256)


def files_sha256(files: Column) -> Column:
    """The hash of a list of files: canonical JSON of (byte_length, path, sha256) sorted by path."""
    by_path = F.array_sort(F.transform(files, lambda f: F.struct(f.path.alias("path"), f.byte_length.alias("byte_length"), f.sha256.alias("sha256"))))
    canonical = F.transform(by_path, lambda f: F.struct(f.byte_length.alias("byte_length"), f.path.alias("path"), f.sha256.alias("sha256")))
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(canonical), 256))
