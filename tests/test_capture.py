from pyspark.sql import functions as F

from lexmill.functions import labels, urls
from lexmill.operators import capture


def test_canonical_url(spark):
    cases = {
        "HTTP://Ex.COM:80/a/?b=2&a=1&utm_source=x#f": "http://ex.com/a?a=1&b=2", "https://h": "https://h/", "https://h/": "https://h/", "https://h//": "https://h/",
        "https://h/a?x=&REF=1": "https://h/a?x=", "https://h:443/p?q=a b": "https://h/p?q=a+b", "http://h:443/p": "http://h:443/p",
        "https://h/a?x=100%&b=1": "https://h/a?b=1&x=100%25", "https://h/a?x=%zz": "https://h/a?x=%25zz", "//Host/a": "//host/a", "/a/b/": "/a/b", "https://h/a?q=%C3%A9": "https://h/a?q=%C3%A9",
    }
    for r in spark.createDataFrame(list(cases.items()), "u string, want string").select("*", urls.canonical_url(F.col("u")).alias("got")).collect():
        assert r.got == r.want


def test_redaction(spark):
    h = spark.createDataFrame([({"Set-Cookie": "a", "X-Api-Key": "b", "X-Auth-Token": "c", "X-Session-Affinity": "d", "ETag": "e"},)], "h map<string,string>").select(urls.redacted_headers(F.col("h"))).first()[0]
    assert h == {"Set-Cookie": "[REDACTED]", "X-Api-Key": "[REDACTED]", "X-Auth-Token": "[REDACTED]", "X-Session-Affinity": "d", "ETag": "e"}


def test_history_goes_back_to_an_old_hash(spark):
    rows = [("u", 1, 1, "A"), ("u", 2, 2, "A"), ("u", 3, 3, "B"), ("u", 4, 4, None), ("u", 5, 5, "A")]
    got = {r.id: (r.crawl_status, r.previous_sha256) for r in capture.capture_history(spark.createDataFrame(rows, "url string, at long, id long, sha256 string")).collect()}
    assert got == {1: ("new", None), 2: ("unchanged", "A"), 3: ("changed", "A"), 4: ("error", "B"), 5: ("changed", "B")}


def test_match_any_history(spark):
    snaps = spark.createDataFrame([("u", 1, 1, "A"), ("u", 2, 2, "B")], "url string, retrieved_at long, snapshot_id long, sha256 string")
    new = spark.createDataFrame([("u", 200, "A", "allowed")], "url string, status int, sha256 string, note string")
    assert capture.crawl_results(new, snaps).first().crawl_status == "changed"
    assert capture.crawl_results(new, snaps, True).first().crawl_status == "unchanged"


def test_labels(spark):
    r = spark.createDataFrame([("N. x", "pers/pm y", "txt [src] more [b]", "7 links")], "a string, b string, c string, d string").select(labels.pos_hint(F.lit("adv.p z")).alias("k"), labels.pos_hint(F.col("a")).alias("a"), labels.pos_hint(F.col("b")).alias("b"), labels.attribution(F.col("c")).alias("c"), labels.first_int(F.col("d")).alias("d")).first()
    assert (r.k, r.a, r.b, r.c.text, r.c.source, r.d) == ("adv.p", None, "pers/pm", "txt more", "[src]", 7)
