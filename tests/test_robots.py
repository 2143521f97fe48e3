"""Robots verdicts against the standard library on generated files."""

import random
from urllib.robotparser import RobotFileParser

import pytest
from pyspark.sql import functions as F

from lexmill.operators import robots

AGENT = "LexBot/1.0"
FIELDS = ["User-agent: *", "User-Agent: lexbot", "user-agent: Lex", "User-agent: other", "Disallow: /a", "Allow: /a/b", "Disallow:", "Disallow: /", "Allow: /a?x=1", "Disallow: /é%20b", "Disallow: /%C3%A9", "Disallow: /a%2Fb  # c",
          "# comment", "", "Crawl-delay: 5", "Sitemap: https://h/s.xml", "noise", "Disallow: *", "ALLOW : /a/b;", "Disallow: /b?", "  ", "Disallow: /a b~*+"]
PATHS = ["", "/", "/a", "/a/b", "/a/b/c", "/a%2Fb", "/A", "/a?x=1", "/a?x=1&y", "/é b", "/%C3%A9%20b/c", "/b", "/b?", "/b?q", "/a/b;p", "/a b~*+/x", "/c#f", "/a%zz", "//a"]


def bodies(seed, n):
    r = random.Random(seed)
    return [r.choice(["\n", "\r\n", "\r"]).join(r.choice(FIELDS) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_verdicts_are_the_library_s(spark):
    files = [(f"https://h{i}", 200, body) for i, body in enumerate(bodies(3, 250))]
    fetches = [(f"{host}{path}", k) for host, _, _ in files for k, path in enumerate(PATHS) if path != "//a"]
    want = {}
    for host, _, body in files:
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        want |= {f"{host}{p}": parser.can_fetch(AGENT, f"{host}{p}") for p in PATHS}
    rows = spark.createDataFrame(fetches, "url string, k int").repartition(4)
    got = robots.verdicts(rows, spark.createDataFrame(files, "host string, status int, body string"), AGENT).collect()
    assert len(got) == len(fetches)
    assert [(r.url, r.allowed) for r in got if r.allowed != want[r.url]] == []
    assert {r.allowed for r in got} == {True, False} and all(r.observed and r.notes == ("allowed" if r.allowed else "disallowed") for r in got)


def test_statuses_nulls_and_repeats(spark):
    files = [("https://a", 404, None), ("https://b", 503, "Disallow: /"), ("https://c", None, None), ("https://d", 200, None), ("https://e", 200, "User-agent: *\nDisallow: /x")]
    fetches = [("https://a/x",), ("https://b/x",), ("https://c/x",), ("https://d/x",), ("https://e/x",), ("https://e/x",), ("https://none/x",), (None,), ("no url",)]
    got = sorted((str(r.url), r.observed, r.allowed, r.notes) for r in robots.verdicts(spark.createDataFrame(fetches, "url string"), spark.createDataFrame(files, "host string, status int, body string"), AGENT).collect())
    assert got == [
        ("None", False, True, "robots_fetch_failed"), ("https://a/x", True, True, "no_robots_file"), ("https://b/x", False, True, "robots_unexpected_status_503"), ("https://c/x", False, True, "robots_fetch_failed"),
        ("https://d/x", True, True, "allowed"), ("https://e/x", True, False, "disallowed"), ("https://e/x", True, False, "disallowed"), ("https://none/x", False, True, "robots_fetch_failed"), ("no url", False, True, "robots_fetch_failed"),
    ]
    empty = spark.createDataFrame([], "url string, n int")
    assert robots.verdicts(empty, spark.createDataFrame([], "host string, status int, body string"), AGENT).columns == ["url", "n", "observed", "allowed", "notes"]
    with pytest.raises(ValueError, match="path"):
        robots.verdicts(empty.withColumn("path", F.lit(1)), spark.createDataFrame([], "host string, status int, body string"), AGENT)
