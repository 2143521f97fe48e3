"""Benchmark decontamination: verbatim matches of benchmark items in whole documents.

Method: training suffix arrays. Each shard of documents (a few MB of text, all of its words) orders
its word suffixes, to the depth of a window, in a suffix array; every suffix of every benchmark item
is binary-searched in each shard, word by word, narrowing its interval. A suffix whose interval is
not empty at the depth of its item's window is a verbatim match with its places; matches that follow
one another on the same diagonal make the longest match. Suffixes that begin with no benchmark words
can end no search and are left out of the order (looked up in a bitmap of the items' leading words).

A window is `window` consecutive words of an item; an item of fewer, but not none, is one window. A
document word inside any occurrence of a window is hit. Words are compared by 64-bit fingerprints.

The benchmark is read in blocks of at most `block_words` words, each broadcast by itself and searched
by a pass over the documents, so what is broadcast is bounded; with one block nothing is shuffled.
With more, the documents are stored once with a number for each row, and each pass's matches before
the next block is broadcast. The benchmark passes through the driver, a block at a time.

Cases: null and empty texts have no words and are never contaminated; items without words match
nothing; an item without item_id hits words but is not listed; the same text under several item_ids
lists them all; empty tables give no rows, or no hits; other columns are ignored. Each row of
documents gives a row, also those of null or repeated doc_id, however many blocks there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._spark import fresh, stored, table
from lexmill.llm._text import ALNUM, Words, among, chunks, distinct, mix

FOUND = "doc_id long, n_words long, places binary, items array<string>, longest long"
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
BITS = 1 << 20


class Block:
    """Suffixes of some benchmark items: fingerprints, and for each start of a window its item and depth."""

    def __init__(self, ids: list[str | None], texts: list[bytes], window: int):
        words = Words(texts, ALNUM)
        count = np.diff(words.first)
        self.ids, self.hash = ids, words.hash
        depth = np.minimum(count, window)
        starts = np.where(count > 0, count - depth + 1, 0)
        self.item = np.repeat(np.arange(len(ids)), starts)
        inner = np.arange(len(self.item)) - np.repeat(np.concatenate(([0], np.cumsum(starts)))[:-1], starts)
        self.start = words.first[:-1][self.item] + inner
        self.depth = depth[self.item]
        self.lead = int(min(self.depth.min(), 4)) if len(self.item) else 1
        self.bitmap = np.zeros(BITS, bool)
        self.leads = distinct(leading(self.hash, self.lead)[self.start]) if len(self.item) else np.zeros(0, np.uint64)
        self.bitmap[(self.leads & np.uint64(BITS - 1)).astype(np.int64)] = True


def leading(h: np.ndarray, n: int) -> np.ndarray:
    """A fingerprint of the n words from each on; the last n - 1 get one of fewer words."""
    out = h.copy()
    for k in range(1, n):
        out[: len(h) - k] = mix(out[: len(h) - k] * np.uint64(0xD6E8FEB86659FD93) + h[k:])
    return out


def search(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Matches of the block's suffixes in a shard: the shard's word and the suffix's number."""
    none = np.zeros(0, np.int64)
    if not len(block.item) or not len(words.hash):
        return none, none
    lead = leading(words.hash, block.lead)
    place = np.flatnonzero(block.bitmap[(lead & np.uint64(BITS - 1)).astype(np.int64)])
    place = place[among(lead[place], block.leads)]
    if not len(place):
        return none, none
    owner = np.searchsorted(words.first, place, "right") - 1
    room = words.first[owner + 1] - place  # words to the end of the document
    deepest = int(block.depth.max())
    rows = np.zeros((deepest, len(place)), np.uint64)  # 0 stands for the end
    for k in range(deepest):
        inside = room > k
        rows[k, inside] = words.hash[place[inside] + k] | np.uint64(1)
    order = np.lexsort(rows[::-1])  # the shard's suffix array, to that depth
    place, rows = place[order], rows[:, order]
    low, high = np.zeros(len(block.item), np.int64), np.full(len(block.item), len(place))
    for k in range(deepest):
        # within equal prefixes the k-th words ascend: their rank behind the number of their prefix is a sorted key
        if k:
            fresh = np.concatenate(([True], (rows[:k, 1:] != rows[:k, :-1]).any(0)))
            prefix = np.cumsum(fresh) - 1
        else:
            prefix = np.zeros(len(place), np.int64)
        values, rank = np.unique(rows[k], return_inverse=True)
        key = prefix * (len(values) + 1) + rank
        on = np.flatnonzero((block.depth > k) & (low < high))
        if not len(on):
            break
        want = block.hash[block.start[on] + k] | np.uint64(1)
        at = np.searchsorted(values, want)
        there = (at < len(values)) & (values[np.minimum(at, len(values) - 1)] == want)
        wanted = prefix[low[on]] * (len(values) + 1) + at
        low[on] = np.searchsorted(key, wanted, "left")
        high[on] = np.where(there, np.searchsorted(key, wanted, "right"), low[on])
    many = np.maximum(high - low, 0)
    suffix = np.repeat(np.arange(len(block.item)), many)
    inner = np.arange(len(suffix)) - np.repeat(np.concatenate(([0], np.cumsum(many)))[:-1], many)
    return place[np.repeat(low, many) + inner], suffix


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Block]:
    ids: list[str | None] = []
    texts: list[bytes] = []
    held = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL").toLocalIterator():
        text = row.text.encode()
        ids.append(row.item_id)
        texts.append(text)
        held += len(text) // 2 + 1  # words at most
        if held >= block_words:
            yield Block(ids, texts, window)
            ids, texts, held = [], [], 0
    yield Block(ids, texts, window)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 2_000_000) -> DataFrame:
    """For each document its number of words, its hit places (pairs of first word and end, int64), its items, and the words of its longest match."""
    spark = docs.sparkSession

    def searched(rows: DataFrame, sent, keys: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for others, texts in chunks(batches, size=1 << 20):
                words = Words(texts, ALNUM)
                place, suffix = search(words, block)
                doc = np.searchsorted(words.first, place, "right") - 1
                order = np.lexsort((place, place - block.start[suffix], block.item[suffix], doc))
                doc, place, suffix = doc[order], place[order], suffix[order]
                depth = block.depth[suffix]
                # runs on one diagonal of one item
                same = np.zeros(len(doc), bool)
                same[1:] = (doc[1:] == doc[:-1]) & (np.diff(place - block.start[suffix]) == 0) & (np.diff(block.item[suffix]) == 0) & (np.diff(place) == 1)
                run_start = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc)))) if len(doc) else doc
                length = place + depth - place[run_start]
                part = np.searchsorted(doc, np.arange(len(texts) + 1))
                places, items, longest = [], [], []
                for i in range(len(texts)):
                    a, b = part[i], part[i + 1]
                    begin = place[a:b] - words.first[i]
                    places.append(np.stack([begin, begin + depth[a:b]], 1).astype(np.int64).tobytes())
                    items.append(sorted({block.ids[x] for x in block.item[suffix[a:b]]} - {None}))
                    longest.append(int(length[a:b].max()) if b > a else 0)
                yield pa.RecordBatch.from_arrays([*(pa.array(others[k], pa.int64()) for k in others), pa.array(np.diff(words.first)), pa.array(places, pa.binary()), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int64())], [*others, "n_words", "places", "items", "longest"])

        return rows.mapInArrow(run, keys + FOUND)

    every = blocks(benchmark, window, block_words)
    first = next(every)
    second = next((block for block in every if len(block.item)), None)
    if second is None:
        return searched(docs.select("doc_id", "text"), spark.sparkContext.broadcast(first), "")
    # a number for each row, the same in every pass: doc_id may be null or repeated
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    found = None
    for block in chain((first, second), every):
        if found is not None and not len(block.item):
            continue
        sent = spark.sparkContext.broadcast(block)
        more = searched(rows, sent, "row long, ")
        more = stored(more if found is None else more.where("longest > 0"))
        sent.destroy()
        found = more if found is None else found.unionByName(more)
    # a row's places and items are bounded by its own words and matches
    return found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.aggregate(F.collect_list("places"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("places"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("longest").alias("longest")).drop("row")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, block_words: int = 2_000_000) -> DataFrame:
    """One row for each document; contaminated: hit, and at least one word in `share` of its words."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.to_pydict()
            hit = []
            for n, places in zip(b["n_words"], b["places"]):
                pairs = np.frombuffer(places, np.int64).reshape(-1, 2)
                steps = np.zeros(n + 1, np.int64)
                np.add.at(steps, pairs[:, 0], 1)
                np.add.at(steps, pairs[:, 1], -1)
                hit.append(int((np.cumsum(steps[:-1]) > 0).sum()) if len(pairs) else 0)
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in b["items"]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(x) for x in b["items"]], pa.int64()), pa.array(digest), pa.array([h > 0 and share * h >= n for h, n in zip(hit, b["n_words"])], pa.bool_()), batch.column("longest")], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest"])

    return matches(docs, benchmark, window, block_words).mapInArrow(finish, SCHEMA)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    (bad_,) = fresh(docs, "__bad")
    bad = stored(contamination(docs.where("doc_id IS NOT NULL"), benchmark, window, share).where("contaminated").select(F.col("doc_id").alias(bad_)).distinct(), lasting=True)
    return docs.join(bad, docs.doc_id == F.col(bad_), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(sf_dir, "documents", spark), table(sf_dir, "benchmark", spark))


QUERIES: dict[str, Callable] = {"op10_decontaminate": op10_decontaminate}
SQL: dict[str, str] = {
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, j, least(13, len(w)) AS n, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS g FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(j) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw) AS l, unnest(range(1, len(w) - n + 2)) AS t(i)),
h AS (SELECT doc_id, i, n, item_id, j FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM h GROUP BY doc_id),
r AS (SELECT doc_id, item_id, i - j AS diagonal, i, n, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS island FROM h),
m AS (SELECT doc_id, max(longest) AS longest FROM (SELECT doc_id, count(*) + max(n) - 1 AS longest FROM r GROUP BY doc_id, item_id, diagonal, island) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN m USING (doc_id)
"""
}
