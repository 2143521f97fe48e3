"""Lines of files by byte ranges: a Spark data source, batch and stream, with bounded memory and line numbers.

A partition is a range of a file's bytes and gives the lines that begin in it: it reads on to the end of its
last line, and a range that does not begin a line skips to the first that begins behind it. So every line
comes once, whatever the ranges are, and no task holds more than a chunk and one line of at most
`maxlinebytes`; a longer line stops the query, or with onlong=null gives a row without value.

Lines end at a line feed, a carriage return before it is dropped. A byte-order mark at a line's begin is dropped, bytes
that are no UTF-8 become U+FFFD. Lines of white space alone are skipped unless keepblank is set, but are counted in
line numbers. A stream's offset is, for each file, the end of its last whole line; what follows it waits.

Files are opened by the tasks through pyarrow's file systems: mounted folders and the stores it knows. Compressed
files cannot be cut in ranges and are not read here.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAX_LINE = 4 * 1024 * 1024
RANGE = 64 << 20
CHUNK = 1 << 20
BATCH = 2 << 20
LINES = "path string, range_start long, line_in_range long, byte_start long, byte_length long, value string"
COUNTS = "path string, range_start long, lines long"
#: White space of the line format, with no-break spaces and the byte-order mark.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


@dataclass
class Range(InputPartition):
    """Bytes [start, stop) of a file that is read to `end` at most; `begins` says that a line begins at start."""

    path: str
    start: int
    stop: int
    end: int
    begins: bool


def _system(path: str):
    from pyarrow import fs

    path = re.sub("^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(paths: list[str] | str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under the paths, without hidden and empty ones."""
    from pyarrow import fs

    out = []
    for given in [paths] if isinstance(paths, str) else paths:
        system, path = _system(given)
        scheme = re.sub("^file:/(?!/)", "file:///", given).split("://")[0] + "://" if ":/" in given else ""
        one = system.get_file_info(path)
        if one.type == fs.FileType.NotFound:
            raise FileNotFoundError(given)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        out += [(scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and x.size and not x.base_name.startswith(("_", "."))]
    return sorted(out)


def ranges(path: str, low: int, high: int, size: int) -> list[Range]:
    """The ranges of a file's bytes [low, high), where a line begins at low."""
    return [Range(path, at, min(at + size, high), high, at == low) for at in range(low, high, size)]


def line_starts(part: Range) -> int:
    """How many lines begin in a range: by its line feeds alone."""
    low, high = part.start - (not part.begins), min(part.stop, part.end) - 1
    system, path = _system(part.path)
    many = int(part.begins)
    with system.open_input_file(path) as f:
        f.seek(low)
        while low < high and (chunk := f.read(min(CHUNK, high - low))):
            many += chunk.count(b"\n")
            low += len(chunk)
    return many


def lines_of(part: Range, limit: int, null_long: bool) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(line in range, byte start, byte length, bytes without the line's end, or None for a line over the limit) of a range's lines."""
    system, path = _system(part.path)
    at = part.start - (not part.begins)  # of the next chunk
    number, begin, held, skip, long = 0, part.start, b"", not part.begins, 0
    with system.open_input_file(path) as f:
        f.seek(at)
        while skip or begin < part.stop:
            chunk = f.read(min(CHUNK, part.end - at)) if at < part.end else b""
            if not chunk:
                if not skip and begin < part.end and begin < part.stop:  # the last line, without a feed
                    yield number, begin, part.end - begin, None if long else held
                return
            base, at, used = at, at + len(chunk), 0
            if skip:
                used = chunk.find(b"\n") + 1
                if not used:
                    continue
                skip, begin = False, base + used
            pieces = chunk[used:].split(b"\n")
            for i, piece in enumerate(pieces):
                if begin >= part.stop:
                    return
                whole = i + 1 < len(pieces)
                if long or len(held) + len(piece) > limit:
                    if not null_long:
                        raise ValueError(f"{part.path}: the line at byte {begin} is longer than {limit} bytes")
                    held, long = b"", (long or len(held)) + len(piece)
                else:
                    held += piece
                if whole:
                    size = long or len(held)
                    yield number, begin, size, None if long else held
                    number, begin, held, long = number + 1, begin + size + 1, b"", 0


def batches(part: Range, limit: int, null_long: bool, keep_blank: bool) -> Iterator[pa.RecordBatch]:
    names = ["path", "range_start", "line_in_range", "byte_start", "byte_length", "value"]
    rows: list[tuple[int, int, int, str | None]] = []
    held = 0

    def batch() -> pa.RecordBatch:
        number, start, length, value = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows), pa.string()), pa.array([part.start] * len(rows), pa.int64()), *(pa.array(x, pa.int64()) for x in (number, start, length)), pa.array(value, pa.string())], names)

    for number, start, length, raw in lines_of(part, limit, null_long):
        value = None
        if raw is not None:
            value = raw.decode("utf-8", "replace").removeprefix("\ufeff").removesuffix("\r")
            if not keep_blank and not value.strip(BLANK):
                continue
        rows.append((number, start, length, value))
        held += length + 64
        if held > BATCH:
            yield batch()
            rows, held = [], 0
    yield batch()


class _Reading:
    """What batch and stream readers share: options, and how a range is read."""

    def __init__(self, options: dict):
        # options come with lower-case names or as they were given
        options = {k.lower(): v for k, v in options.items()}
        self.size, self.limit = int(options.get("rangebytes", RANGE)), int(options.get("maxlinebytes", MAX_LINE))
        self.null_long, self.keep_blank = options.get("onlong", "fail") == "null", str(options.get("keepblank", "false")).lower() == "true"
        self.count = str(options.get("count", "false")).lower() == "true"
        self.path, self.files = options.get("path"), json.loads(options["files"]) if "files" in options else None

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file
            return
        if self.count:
            yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.start], pa.int64()), pa.array([line_starts(part)], pa.int64())], ["path", "range_start", "lines"])
        else:
            yield from batches(part, self.limit, self.null_long, self.keep_blank)


class LineReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Range]:
        files = self.files if self.files is not None else listed(self.path)
        return [part for path, size in files for part in ranges(path, 0, size, self.size)]


class LineStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: end for path, size in listed(self.path) if (end := whole_lines(path, size))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [part for path, high in sorted(end.items()) for part in ranges(path, int(start.get(path, 0)), int(high), self.size)]

    def commit(self, end: dict) -> None:
        pass


def whole_lines(path: str, size: int) -> int:
    """Where the last whole line of a file ends: behind the last line feed, looked for from the end."""
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        high = size
        while high:
            low = max(0, high - CHUNK)
            f.seek(low)
            if (found := f.read(high - low).rfind(b"\n")) >= 0:
                return low + found + 1
            high = low
    return 0


class LineRanges(DataSource):
    """spark.read or readStream.format("line_ranges"); options path, rangebytes, maxlinebytes, onlong, keepblank, count."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def schema(self) -> str:
        return COUNTS if _Reading(dict(self.options)).count else LINES

    def reader(self, schema) -> LineReader:
        return LineReader(dict(self.options))

    def streamReader(self, schema) -> LineStream:
        return LineStream(dict(self.options))


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need not find this package
    spark.dataSource.register(LineRanges)


def read_lines(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    """Rows (path, range_start, line_in_range, byte_start, byte_length, value)."""
    register(spark)
    return spark.read.format("line_ranges").options(files=json.dumps(listed(paths)), **options).load()


def stream_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """The lines of the files of a folder as a stream; a file may grow by whole lines."""
    register(spark)
    return spark.readStream.format("line_ranges").options(path=path, **options).load()


def numbered_lines(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    """read_lines with line_no, from 1 in each file, blank lines counted.

    Two passes: line feeds are counted in all ranges side by side, sums over a file's ranges (a row a range) give
    the number of lines before each, and its own lines are numbered where they are read.
    """
    register(spark)
    files = json.dumps(listed(paths))  # one listing for both passes
    rows = spark.read.format("line_ranges").options(files=files, **options).load()
    counts = spark.read.format("line_ranges").options(files=files, **{k: v for k, v in options.items() if k == "rangebytes"}, count="true").load()
    order = Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("lines").over(order), F.lit(0))).drop("lines")
    return rows.join(before, ["path", "range_start"]).withColumn("line_no", F.col("before") + F.col("line_in_range") + 1).drop("before")


def json_rows(lines: DataFrame, schema, *keep: str) -> DataFrame:
    """Rows of JSON lines (value) with the columns `keep` of where they stood; a line that does not parse stops the query."""
    return lines.select(*keep, F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select(*keep, "r.*")
