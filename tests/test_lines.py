"""Lines by byte ranges against a sequential read."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.sources import lines


def write(path, seed, feeds=(b"\n", b"\r\n"), n=400, last=True):
    r = random.Random(seed)
    out = []
    for i in range(n):
        body = r.choice([b"", b"  ", b"\t\xc2\xa0", b"{\"i\":%d}" % i, "é日🙂 ".encode() * r.randint(1, 30), b"\xef\xbb\xbfmark", b"bad \xff byte", b"in\rside"])
        out.append(body + r.choice(feeds))
    data = b"".join(out)
    if not last:
        data += b"no feed"
    path.write_bytes(data)
    return data


def sequential(data):
    out, start = [], 0
    for i, raw in enumerate(data.split(b"\n")):
        if start < len(data):
            value = raw.decode("utf-8", "replace").removeprefix("\ufeff").removesuffix("\r")
            if value.strip(lines.BLANK):
                out.append((i + 1, start, len(raw), value))
        start += len(raw) + 1
    return out


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1000, 10**9])
@pytest.mark.parametrize("chunk", [1, 13, 1 << 20])
@pytest.mark.parametrize("last", [True, False])
def test_ranges_of_any_size_give_the_same_lines(tmp_path, monkeypatch, size, chunk, last):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    data = write(tmp_path / "a.jsonl", size + chunk, n=40, last=last)
    path, got, before = str(tmp_path / "a.jsonl"), [], 0
    for part in lines.ranges(path, 0, len(data), size):
        for batch in lines.batches(part, 1 << 20, False, False):
            got += [(before + r["line_in_range"] + 1, r["byte_start"], r["byte_length"], r["value"]) for r in batch.to_pylist()]
        before += lines.line_starts(part)
    assert got == sequential(data)
    assert before == data.count(b"\n") + (not last)


@pytest.mark.parametrize("many", [1, 7])
def test_line_numbers_in_spark(spark, tmp_path, many):
    want = []
    for name in ("b.jsonl", "a.jsonl"):
        data = write(tmp_path / name, name, last=name < "b")
        want += [(name, *x) for x in sequential(data)]
        size = len(data) // many + 1
    (tmp_path / "_hidden").write_bytes(b"x\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    got = lines.numbered_lines(spark, str(tmp_path), rangebytes=size)
    rows = got.select(F.element_at(F.split("path", "/"), -1), "line_no", "byte_start", "byte_length", "value").collect()
    assert sorted(map(tuple, rows)) == sorted(want)


def test_long_lines_across_ranges(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    limit = 1 << 20
    path.write_bytes(b"one\n" + b"x" * limit + b"\n" + b"y" * (limit + 1) + b"\r\nlast")
    for size in (100_000, limit, 10**8):
        rows = lines.numbered_lines(spark, str(path), rangebytes=size, maxlinebytes=limit, onlong="null").orderBy("line_no").collect()
        assert [(r.line_no, r.byte_length, r.value and r.value[:4]) for r in rows] == [(1, 3, "one"), (2, limit, "xxxx"), (3, limit + 2, None), (4, 4, "last")]
        with pytest.raises(Exception, match="longer than 1048576 bytes"):
            lines.read_lines(spark, str(path), rangebytes=size, maxlinebytes=limit).count()


def test_no_file_and_blank_lines(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        lines.read_lines(spark, str(tmp_path / "none"))
    assert lines.read_lines(spark, str(tmp_path)).count() == 0
    (tmp_path / "a").write_bytes(b"\n \n\xe3\x80\x80\r\na\n")
    assert [r.value for r in lines.read_lines(spark, f"file:{tmp_path}").collect()] == ["a"]
    assert [r.line_no for r in lines.numbered_lines(spark, f"file://{tmp_path}/a", keepblank="true", rangebytes=2).orderBy("line_no").collect()] == [1, 2, 3, 4]


def test_stream_goes_on_where_it_was(spark, tmp_path):
    source, target, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    source.mkdir()

    def run():
        query = lines.stream_lines(spark, str(source), rangebytes=50).writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(target)
        query.awaitTermination()
        return sorted((r.path.split("/")[-1], r.byte_start, r.value) for r in spark.read.parquet(target).collect())

    (source / "a").write_bytes(b"one\r\n\ntwo\nthr")
    assert run() == [("a", 0, "one"), ("a", 6, "two")]
    with open(source / "a", "ab") as f:
        f.write(b"ee\nfour")
    (source / "b").write_bytes(b"x" * 200 + b"\ny\n")
    assert run() == [("a", 0, "one"), ("a", 6, "two"), ("a", 10, "three"), ("b", 0, "x" * 200), ("b", 201, "y")]
    assert len(run()) == 5
