"""Functions in SQL text give what their expressions give."""

from pyspark.sql import functions as F

from lexmill.functions import norm, sql, urls
from lexmill.sources import pages

TEXTS = ["dɔ́bɛ̀n  X", "STRASSE ß İ", " it's \"a\\b\" — ", "", None, "ŒUVRE naïve", "\t日本 、x", "ﬁ ǰ"]


def test_scalars(spark):
    sql.register(spark)
    spark.createDataFrame([(t,) for t in TEXTS], "text string").createOrReplaceTempView("texts")
    got = spark.sql(f"SELECT {', '.join(f'key_{n}(text) AS {n}' for n in norm.KEYS)}, all_keys(text) AS every FROM texts").collect()
    want = spark.table("texts").select(*[of(F.col("text")).alias(n) for n, of in norm.KEYS.items()], norm.all_keys(F.col("text")).alias("every")).collect()
    assert got == want and got[0].nospace == "dɔbɛnx"
    assert spark.sql("SELECT canonical_url('HTTP://Ex.COM:80/a/?b=2&a=1&utm_source=x#f') AS u").first().u == spark.range(1).select(urls.canonical_url(F.lit("HTTP://Ex.COM:80/a/?b=2&a=1&utm_source=x#f"))).first()[0]
    plan = spark.sql("SELECT key_nospace(text) FROM texts")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_table_functions(spark):
    from test_pages import INDEX, PAGE

    sql.register(spark)
    spark.createDataFrame([("https://h/lexicon/b.htm", PAGE.encode() + b"\xff"), ("https://h/none", None)], "url string, html binary").createOrReplaceTempView("p")
    spark.createDataFrame([("https://h/index/k.htm", INDEX), ("https://h/l", "")], "url string, html string").createOrReplaceTempView("i")
    got = spark.sql("SELECT * FROM lexicon_entries(TABLE(SELECT url, html FROM p) PARTITION BY url)").orderBy("pos").collect()
    assert got == pages.parsed(spark.table("p"), pages.lexicon_entries, pages.ENTRY).orderBy("pos").collect() and len(got) == 2
    assert spark.sql("SELECT * FROM index_rows(TABLE(i) PARTITION BY url)").collect() == pages.parsed(spark.table("i"), pages.index_rows, pages.MAPPING).collect()
