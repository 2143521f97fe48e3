"""Exact Jaccard self-join of documents' word shingles, in regions around pivots.

Method: a metric-space join in regions around pivots, recursively.

 1. At the top the pivots are single shingles. Under a global order of shingles, rarest first, two sets
    of Jaccard t or more share one of the first n - ceil(t n) + 1 shingles of each; so each document goes
    to the regions of those leading shingles and to no others. (Whole documents do not serve as pivots
    there: unrelated ones are at distance 1 from each other and from all pivots, so no
    triangle-inequality window leaves any region out, and each document would go to all. The README
    gives figures.) Every region links its documents to its smallest if they can link: a star, so a group
    of thousands of near copies makes no squared number of pairs. A pair is looked at where its first
    common shingle can be: so many of both sets' shingles must not come before it that the threshold can
    still be met. Candidates are verified on whole sets and joined to components.
 2. A region whose documents are all in one component is done. Another one of more than `leaf` documents
    is divided by pivots of its own, documents of different components: each document belongs to the
    Voronoi cell of the pivot nearest by Jaccard distance, and is copied to each other cell that the
    triangle inequality leaves open, those whose pivot is no more than 2 (1 - t) farther than its own:
    two sets that link are both in the own cell of either. Cells divide again until they are small, of
    one component, or no smaller than their region by much.
 3. In what is left, documents of different components are paired, those first that belong to the cell.
    Large cells are paired in blocks, so no task holds one. The universe of shingles is dealt into 32
    parts, |x and part| is x's distance to a pivot up to a constant, and two sets that differ in the
    parts' sizes by more than t allows cannot link; the others are verified on whole sets.

What is then unlinked has been compared, or cannot link; so components are exact (up to 64-bit
fingerprints of shingles, 48-bit ones in the overlap). Shingles that `hot` documents or more have, by the
counts of the order, are dealt as rows instead of by bucket, so a region of any size is spread.

Documents of equal sets are one node, named by the smallest doc_id. The order comes from a sketch of
counts over all documents (2**22 cells, 4 MB as broadcast logarithms); any order gives right results.

Cases: no words or text (null, empty): no shingles, linked with nothing, also not with each other;
fewer words than a shingle: the whole sequence is one; repeated rows each get a row; rows without
doc_id get the component of the documents of their set, else null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._spark import carried, components, fresh, partitions, passing, stored, table
from lexmill.llm._text import SPACED, Words, among, chunks, distinct, mix, shingles

SKETCH, PARTS, CELLS = 1 << 22, 64, 32
CHUNK = 4096
PIVOTS, BLOCK, ROUNDS, SALT = 8, 1024, 8, 16


def packed(values: np.ndarray) -> bytes:
    """Ascending uint64 below 2**48, as compressed byte planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[:6]).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :6] = planes.T
    return np.cumsum(out.reshape(-1).view(np.uint64), dtype=np.uint64)


def sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The distinct shingles of each text, ascending."""
    found, begin = shingles(Words(texts, SPACED), size)
    return [distinct(found[a:b]) for a, b in zip(begin[:-1], begin[1:])]


def order_levels(docs: DataFrame, size: int) -> np.ndarray:
    """For each sketch cell twice the logarithm of how many documents' shingles fall in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SKETCH, np.uint32)
        for _, texts in chunks(batches):
            for s in sets(texts, size):
                np.add.at(held, (s & np.uint64(SKETCH - 1)).astype(np.int64), np.uint32(1))
        if held.any():
            parts = [zstandard.ZstdCompressor(1).compress(p.tobytes()) for p in held.reshape(PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SKETCH // PARTS, np.uint64)
        for blob in frame.counts:
            held = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint32)
            total += held
        small = np.minimum(total, 2**32 - 1).astype(np.uint32)
        return pd.DataFrame({"part": [int(frame.part.iloc[0])], "counts": [zstandard.ZstdCompressor(1).compress(small.tobytes())]})

    rows = docs.select("text").mapInArrow(count, "part int, counts binary")
    ways = max(1, docs.rdd.getNumPartitions() // 256)
    if ways > 1:  # so that no task adds up more than a few hundred
        rows = rows.groupBy("part", F.pmod(F.spark_partition_id(), F.lit(ways)).alias("way")).applyInPandas(add, "part int, counts binary")
    levels = np.zeros((PARTS, SKETCH // PARTS), np.uint8)
    for r in rows.groupBy("part").applyInPandas(add, "part int, counts binary").collect():
        levels[r.part] = 2 * np.log2(1.0 + np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.uint32))
    return levels.reshape(-1)


def leading_shingles(docs: DataFrame, size: int, percent: int, hot: int) -> DataFrame:
    """Rows (doc_id, n, f1, f2, lead, common, cells): set size, fingerprints of the set, leading shingles, which of them some `hot` documents have, sizes in the cells."""
    levels = docs.sparkSession.sparkContext.broadcast(order_levels(docs, size))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, most = levels.value, 2 * np.log2(1.0 + hot)
        for others, texts in chunks(batches):
            rows = []
            for s in sets(texts, size):
                n = len(s)
                first = n - (percent * n + 99) // 100 + 1 if n else 0
                own = level[(s & np.uint64(SKETCH - 1)).astype(np.int64)]
                order = np.lexsort((s, own))[:first]
                m = mix(s + np.uint64(12345))
                cells = np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS), 65535).astype(np.uint16)
                rows.append((n, int(m.sum(dtype=np.uint64).view(np.int64)) if n else 0, int(np.bitwise_xor.reduce(mix(m)).view(np.int64)) if n else 0, s[order].tobytes(), (own[order] >= most).tobytes(), cells.tobytes()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(others["doc_id"], pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", "n", "f1", "f2", "lead", "common", "cells"])

    return docs.select("doc_id", "text").mapInArrow(lead, "doc_id long, n long, f1 long, f2 long, lead binary, common binary, cells binary")


def dealt(nodes: DataFrame, buckets: int) -> DataFrame:
    """Entries (shingle, doc, n, rest) of the leading shingles that are not common, in compressed columns, by bucket; rest: how many shingles of the set do not come before it."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            lead = np.concatenate(leads)
            many = [len(x) for x in leads]
            doc, n = np.repeat(np.array(ids, np.int64), many), np.repeat(np.array(sizes, np.int64), many)
            rest = n - np.concatenate([np.arange(k) for k in many])
            rare = np.frombuffer(b"".join(marks), np.uint8) == 0
            lead, doc, n, rest = lead[rare], doc[rare], n[rare], rest[rare]
            to = (mix(lead) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            out = []
            for b in np.flatnonzero(np.diff(cut)):
                o = order[cut[b] : cut[b + 1]]
                out.append((int(b), zstandard.ZstdCompressor(1).compress(lead[o].tobytes() + np.diff(doc[o], prepend=0).tobytes() + n[o].astype(np.uint32).tobytes() + rest[o].astype(np.uint32).tobytes())))
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], ["bucket", "entries"])

        leads, ids, sizes, marks, held = [], [], [], [], 0
        for batch in batches:
            for d, n, x, common in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "lead", "common"))):
                leads.append(np.frombuffer(x, np.uint64))
                marks.append(common)
                ids.append(d)
                sizes.append(n)
                held += len(leads[-1])
                if held >= 300_000:
                    yield flush()
                    leads, ids, sizes, marks, held = [], [], [], [], 0
        if held:
            yield flush()

    return nodes.select("doc_id", "n", "lead", "common").mapInArrow(deal, "bucket int, entries binary")


def common_entries(nodes: DataFrame) -> DataFrame:
    """Rows (shingle, id, n, rest) of the leading shingles that are common."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for d, n, lead, common in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "lead", "common"))):
                at = np.flatnonzero(np.frombuffer(common, np.uint8))
                if len(at):
                    for held, x in zip(out, (np.frombuffer(lead, np.int64)[at], np.full(len(at), d), np.full(len(at), n), n - at)):
                        held.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["shingle", "id", "n", "rest"])

    return nodes.select("doc_id", "n", "lead", "common").mapInArrow(deal, "shingle long, id long, n long, rest long")


def entries(blobs) -> tuple[np.ndarray, ...]:
    parts: tuple[list, ...] = ([], [], [], [])
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        k = len(raw) // 24
        parts[0].append(np.frombuffer(raw, np.uint64, k))
        parts[1].append(np.cumsum(np.frombuffer(raw, np.int64, k, 8 * k)))
        parts[2].append(np.frombuffer(raw, np.uint32, k, 16 * k).astype(np.int64))
        parts[3].append(np.frombuffer(raw, np.uint32, k, 20 * k).astype(np.int64))
    return tuple(map(np.concatenate, parts))


def may_link(na, nb, rest, percent: int):
    """Whether sets of these sizes can link if their first common shingle leaves them `rest` to share at most."""
    return percent * (na + nb) <= (100 + percent) * rest


def joined_regions(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Of a bucket of regions: star candidates (a, b), and the regions of three or more documents in chunks (a: region, b: chunk, docs)."""
    shingle, doc, n, rest = entries(frame.entries)
    values, where, many = np.unique(shingle, return_inverse=True, return_counts=True)
    on = np.flatnonzero(many[where] > 1)
    on = on[np.lexsort((doc[on], where[on]))]
    doc, n, rest, where = doc[on], n[on], rest[on], where[on]
    start = np.flatnonzero(np.diff(where, prepend=-1))
    size = np.diff(np.append(start, len(where)))
    first = np.repeat(start, size)
    near = (np.arange(len(where)) != first) & may_link(n, n[first], np.minimum(rest, rest[first]), percent)
    pairs = np.unique(np.stack([doc[first[near]], doc[near]], 1), axis=0) if near.any() else np.zeros((0, 2), np.int64)
    out = pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1], "docs": None, "sizes": None, "rests": None})
    if not len(start):
        return out
    name = np.add.reduceat(mix(doc.astype(np.uint64)), start).view(np.int64)
    large = np.flatnonzero(size > 2)
    # of regions with the same documents the most that each of them can share
    same = {}
    for g in large:
        part = slice(start[g], start[g] + size[g])
        key = int(name[g])
        same[key] = (doc[part], n[part], np.maximum(same[key][2], rest[part]) if key in same else rest[part])
    rows = [(key, k // CHUNK, *(x[k : k + CHUNK] for x in group)) for key, group in same.items() for k in range(0, len(group[0]), CHUNK)]
    return pd.concat([out, pd.DataFrame(rows, columns=["a", "b", "docs", "sizes", "rests"])], ignore_index=True)


def member_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """Rows (id, members): the packed sets of documents, with 48 bits of each shingle's fingerprint."""
    return carried(docs, stored(ids.distinct()), lambda texts: [packed(distinct(s >> np.uint64(16))) for s in sets(texts, size)]).toDF("id", "members")


def verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sets' Jaccard is percent / 100 or more."""
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, x = [], None, None
            for a, p, q in zip(batch.column("a").to_pylist(), batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                if a != last:
                    last, x = a, unpacked(p)
                y = unpacked(q)
                both = int(among(y, x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with passing():
        pairs = stored(pairs)
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
        found = stored(member_sets(docs, ids, size))
        left, right = found.toDF("a", "x"), found.toDF("b", "y")
        # by a at last, so that the centre of a star is read once for all its pairs
        return stored(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(test, "a long, b long"), lasting=True)


def cells(large: DataFrame, members: DataFrame, percent: int, level: int) -> DataFrame:
    """Regions `large` (region, id, n, rest, c, own, docs) in the Voronoi cells of pivots of their own, by the sets of `members`; docs becomes the size of the region divided."""
    reach = 2 * (100 - percent) / 100 + 1e-9
    one = F.min(F.struct(F.xxhash64("id", F.lit(level)), "id")).getField("id")
    pivots = large.groupBy("region", F.pmod(F.xxhash64("c", F.lit(level)), F.lit(PIVOTS)).alias("way")).agg(one.alias("id")).join(members, "id").groupBy("region").agg(F.collect_list(F.struct("id", "members")).alias("pivots"))
    pivots = pivots.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, around = None, None, []
        for batch in batches:
            own, at, to = batch.column("own").to_numpy(zero_copy_only=False), [], []
            stay = []
            for row, (region, blob, pivots) in enumerate(zip(batch.column("region").to_pylist(), batch.column("members").to_pylist(), batch.column("pivots"))):
                if region != last:
                    last, found = region, sorted(pivots.as_py(), key=lambda p: p["id"])
                    names = mix(np.array([p["id"] for p in found], np.int64).view(np.uint64) ^ mix(np.array([region], np.int64).view(np.uint64))).view(np.int64)
                    around = [unpacked(p["members"]) for p in found]
                x = unpacked(blob)
                both = np.array([int(among(x, p).sum()) for p in around])
                apart = 1 - both / (np.array([len(p) for p in around]) + len(x) - both)
                home = int(apart.argmin())
                for k in np.flatnonzero(apart <= apart[home] + reach):
                    at.append(row)
                    to.append(int(names[k]))
                    stay.append(bool(own[row]) and k == home)
            rows = batch.select(["id", "n", "rest", "c", "docs"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), *rows.columns, pa.array(stay, pa.bool_())], ["region", "id", "n", "rest", "c", "docs", "own"])

    salted = large.join(members, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).join(pivots, ["region", "salt"])
    return salted.select("region", "id", "n", "rest", "c", "docs", "own", "members", "pivots").mapInArrow(divide, "region long, id long, n long, rest long, c long, docs long, own boolean")


def region_pairs(docs: DataFrame, regions: DataFrame, size: int, percent: int, leaf: int) -> DataFrame:
    """Pairs (a, b, na, nb) of different components within regions (region, id, n, rest, c) that may link, after large regions have been divided."""
    left = regions.select("region", "id", "n", "rest", "c", F.lit(True).alias("own"), F.lit(None).cast("long").alias("docs"))
    leaves, members = [], None
    for level in range(ROUNDS):
        sizes = left.groupBy("region").agg(F.count("*").alias("now"), F.min("c").alias("low"), F.max("c").alias("high"), F.max("own").alias("some"), F.first("docs").alias("before")).where("low < high AND some")
        sizes = stored(sizes.select("region", F.col("now").alias("docs"), ((F.col("now") > leaf) & (F.col("before").isNull() | (10 * F.col("now") <= 8 * F.col("before")))).alias("divide")))
        leaves.append(left.drop("docs").join(sizes.where("NOT divide").drop("divide"), "region"))
        if sizes.where("divide").isEmpty():
            break
        large = stored(left.drop("docs").join(sizes.where("divide").drop("divide"), "region"))
        if members is None:
            members = stored(member_sets(docs, large.select("id"), size))
        left = stored(cells(large, members, percent, level))
    else:
        leaves.append(left.drop("docs").join(left.groupBy("region").agg(F.count("*").alias("docs")), "region"))
    small = leaves[0]
    for more in leaves[1:]:
        small = small.unionByName(more)
    small = small.withColumn("blocks", F.expr(f"(docs + {BLOCK - 1}) div {BLOCK}")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    every = F.expr("sequence(0L, blocks - 1)")
    x = small.where("own").select("region", F.col("block").alias("i"), F.explode(every).alias("j"), *(F.col(k).alias(f"{k}_x") for k in ("id", "n", "rest", "c")))
    y = small.select("region", F.explode(every).alias("i"), F.col("block").alias("j"), "own", *(F.col(k).alias(f"{k}_y") for k in ("id", "n", "rest", "c")))
    once = (F.col("id_x") < F.col("id_y")) | (~F.col("own") & (F.col("id_x") > F.col("id_y")))
    met = x.join(y, ["region", "i", "j"]).where(once & (F.col("c_x") != F.col("c_y")) & may_link(F.col("n_x"), F.col("n_y"), F.least("rest_x", "rest_y"), percent))
    swap = F.col("id_x") > F.col("id_y")
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("na"), F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("nb")).distinct()


def linked(docs: DataFrame, size: int = 4, percent: int = 85, leaf: int = 256, hot: int = 1000) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for docs (doc_id, text)."""
    spark = docs.sparkSession

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, CELLS).astype(np.int64) for c in ("pa", "pb"))
            apart = np.abs(p - q).sum(1)  # sets that differ in d shingles have Jaccard (s - d) / (s + d) at most, s the sum of sizes
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array(100 * (total - apart) >= percent * (total + apart)))

    with passing():
        every = stored(leading_shingles(docs, size, percent, hot))
        same = stored(every.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("node")))
        nodes = every.join(same.where("node IS NOT NULL").select(F.col("node").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
        regions = stored(dealt(nodes, 4 * partitions(spark)).groupBy("bucket").applyInPandas(lambda f: joined_regions(f, percent), "a long, b long, docs array<long>, sizes array<long>, rests array<long>"))
        common = stored(common_entries(nodes))
        # regions of equal documents have equal names
        first = common.groupBy("shingle").agg(F.min(F.struct("id", "n", "rest")).alias("f"), F.bit_xor(F.xxhash64("id")).alias("region"), F.count("*").alias("docs")).where("docs > 1")
        star = common.join(first, "shingle").where((F.col("id") != F.col("f.id")) & may_link(F.col("n"), F.col("f.n"), F.least("rest", "f.rest"), percent)).select(F.col("f.id").alias("a"), F.col("id").alias("b"))
        stars = stored(regions.where("docs IS NULL").select("a", "b").union(star).distinct())
        links = verified(docs, stars, size, percent)
        label = components(links)

        # documents of one region that are in different components
        large = regions.where("docs IS NOT NULL").select(F.col("a").alias("region"), F.explode(F.arrays_zip("docs", "sizes", "rests")).alias("d")).select("region", F.col("d.docs").alias("id"), F.col("d.sizes").alias("n"), F.col("d.rests").alias("rest"))
        large = large.union(common.join(first.where("docs > 2").select("shingle", "region"), "shingle").select("region", "id", "n", "rest"))
        large = large.groupBy("region", "id").agg(F.max("n").alias("n"), F.max("rest").alias("rest"))
        placed = stored(large.join(label, "id", "left").select("region", "id", "n", "rest", F.coalesce("component_id", "id").alias("c")))
        open_regions = placed.groupBy("region").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("region")
        left = stored(placed.join(open_regions, "region", "left_semi"))
        more = stored(region_pairs(docs, left, size, percent, leaf)).join(stars, ["a", "b"], "left_anti")
        sizes = nodes.select(F.col("doc_id").alias("id"), "cells")
        more = more.join(sizes.toDF("a", "pa"), "a").join(sizes.toDF("b", "pb"), "b")
        rest = stored(more.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(windows, "a long, b long"))
        if not rest.isEmpty():
            label = components(links.union(verified(docs, rest, size, percent)))
        named = same.join(label, F.col("node") == F.col("id"), "left").select("f1", "f2", "n", F.coalesce("component_id", "node").alias("component_id"))
        return stored(every.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), lasting=True)


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents that are the smallest of their component (or have no doc_id), with all their columns."""
    (copy,) = fresh(docs, "__copy")
    copies = stored(linked(docs, size, percent).where("doc_id <> component_id").select(F.col("doc_id").alias(copy)).distinct(), lasting=True)
    return docs.join(copies, docs.doc_id == F.col(copy), "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(sf_dir, "documents", spark))


QUERIES: dict[str, Callable] = {"op7_jaccard_join": op7_jaccard_join}
SQL: dict[str, str] = {
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 85 * (x.n + y.n - both_n)),
r(id, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(reach) FROM r WHERE r.id = doc_id), doc_id)::BIGINT AS component_id FROM documents LEFT JOIN n USING (doc_id)
"""
}
