"""Resampling of documents towards a target distribution by hashed n-gram importance weights.

Method: explode-free scoring. Higher-order functions make each document's array of bucket numbers (CRC-32
of every run of 1 to `longest` words, modulo `buckets`), which is stored once, at a few bits a feature.
The only shuffle of features is that of their totals by bucket, summed in each task first. Documents are
scored by an aggregate over element_at of a literal array of gains, one a bucket, without any join; a Gumbel
value from a digest of seed and doc_id is added, so the highest scores are a draw without replacement in
proportion to the weights. Ranks are places in ranges of the order, sorted side by side (`numbered`).

A bucket's gain is floor(1000 ln(((t + 1)(S + buckets)) / ((s + 1)(T + buckets)))), for s of the S features
of all documents and t of the T of all target texts. The totals of all buckets, and nothing else, pass
through the driver. A feature array is as long as its document.

Cases: null and empty texts have no features, weight 0 and are never drawn while `least_words` is 1 or
more; a row of null doc_id has features and weight, counts in the totals, but has no score, is not drawn and
is not among the N documents; repeated rows each count and get a row (equal scores: by doc_id, then any);
very long texts are cut whole; with an empty target T is 0; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._spark import fresh, literal, numbered, stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a-z (A-Z lower-cased), digits and all non-ASCII characters; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def runs(words: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by a space."""
    if longest == 1:
        return words
    of_length = lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i + k - 1 <= F.size(words)), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.concat(words, *[of_length(k) for k in range(2, longest + 1)])


def featured(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Rows (doc_id, n_words, found): the bucket of each feature."""
    cut = docs.select("doc_id", word_array(F.col("text")).alias("words"))
    return cut.select("doc_id", F.size("words").cast("long").alias("n_words"), F.transform(runs(F.col("words"), longest), lambda w: (F.crc32(w) % buckets).cast("int")).alias("found"))


def totals(found: DataFrame, buckets: int) -> list[int]:
    """Features in each bucket; what is shuffled and collected is a number a bucket."""
    counts = [0] * buckets
    for r in found.select(F.explode("found").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(s: list[int], t: list[int]) -> list[int]:
    buckets, of, to = len(s), float(sum(s)), float(sum(t))
    return [math.floor(1000 * math.log(((b + 1.0) * (of + buckets)) / ((a + 1.0) * (to + buckets)))) for a, b in zip(s, t)]


def scored(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score)."""
    found = stored(featured(docs, longest, buckets), lasting=True)
    wanted = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = literal(gains(totals(found, buckets), totals(wanted, buckets)))
    weight = F.aggregate("found", F.lit(0).cast("long"), lambda a, b: a + F.element_at(gain, b + 1))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return found.select("doc_id", "n_words", F.size("found").cast("long").alias("n_features"), weight.alias("weight")).withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, seed: int = 2024, least_words: int = 20) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank): of the N documents of `least_words` words or more, floor(percent N / 100) are drawn."""
    rows = scored(docs, target, longest, buckets, seed).withColumn("eligible", (F.col("n_words") >= least_words) & F.col("score").isNotNull())
    placed = numbered(rows, "place", F.desc("eligible"), F.desc("score"), F.col("doc_id"))
    many = placed.agg(F.count_if("eligible").alias("n")).head().n * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") < many, F.col("place") + 1).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents, with all their columns."""
    (drawn,) = fresh(docs, "__drawn")
    ids = resample(docs, target, **how).where("rank IS NOT NULL").select(F.col("doc_id").alias(drawn)).distinct()
    return docs.join(ids, docs.doc_id == F.col(drawn), "left_semi")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark))


QUERIES: dict[str, Callable] = {"op11_resampling": op11_resampling}
SQL: dict[str, str] = {
    "op11_resampling": r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT row, unnest(w) AS w FROM d),
bw AS (SELECT unnest(w) AS w FROM b),
h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
k AS (SELECT w, (xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)), lambda a, y: xor(a >> 8, crc[xor(a & 255, y) + 1])), 4294967295) % 10000)::BIGINT AS bucket FROM h, tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN k USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN k USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN k USING (w) JOIN g USING (bucket) GROUP BY row),
scores AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN weights USING (row)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND score IS NOT NULL AND place <= n * 10 // 100 THEN place END::BIGINT AS rank FROM r
"""
}
