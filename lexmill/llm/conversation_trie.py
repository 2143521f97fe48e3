"""Prefix trie of conversations: which turns many of them begin with, and what sharing them would save.

Method: succinct level-order tries. Each turn becomes a 128-bit digest of role and text and its number of
code points; no text is shuffled. Turns are sorted by conversation in ranges side by side, and each gets a
fingerprint of its prefix, a polynomial of the digests whose sums run on over the ranges' borders. A prefix
whose subtree holds more than `unit` turns is heavy: those upper levels are rows of their own. Everything
below them falls into units, which are packed in shards by hash. In a shard numpy builds the trie in level
order: a LOUDS bitvector (for each node a one a child, then a zero) over arrays of labels; parents come
from rank and select, and a pass over the levels in reverse adds leaves and savings up with add.at. The
units' roots and the heavy nodes are merged by pointer doubling, in as many rounds as the logarithm of the
heavy depth, so a conversation of millions of turns needs no pass per level. `unit` follows the rows a
partition has, within fixed bounds: no task holds more than its shard, whatever many conversations share.

The conversations that end at a heavy node are sorted in ranges too, packed, and hashed piece by piece.

Cases: null role and text count as empty; rows of null conv_id are left out; turns of equal number stand
in the order of the digest of role and text; repeated rows are turns of their own; an empty table gives no rows,
not even a root; very long texts are digested where they are read; other columns are ignored. For conv_id
below 0, c - c % 100 rounds towards 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._spark import numbered, partitions, stored, table
from lexmill.llm._text import _BASE, _power, mix

_U = np.uint64
LEAST_UNIT, MOST_UNIT = 64, 100_000
SHARD = 200_000
PIECE = 64 << 10
KEY = ("depth", "k1", "k2")
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, u1 long, u2 long, top boolean"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digested(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, digest, chars): a turn without its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.length(text).cast("long").alias("chars"))


def ordered(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, digest, ..) with `at`, the place of each among its conversation's, from 0."""
    placed = numbered(turns, "at", F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"))
    first = placed.groupBy("conv_id").agg(F.min("at").alias("first"))
    return placed.join(first, "conv_id").withColumn("at", F.col("at") - F.col("first")).drop("first")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as the first of their group does: rows (conv_id, turn, digest, chars), and all ids (conv_id).

    The first h turns, h = crc32(conv_id) mod `most`, are those of conversation c - c % group; then come c's own beyond its first h.
    """
    own = stored(ordered(turns), lasting=True)
    heads = own.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("at") < most - 1, F.struct("at", "digest", "chars")))).alias("head"))
    cut = heads.select("conv_id", (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"), F.expr(f"conv_id - conv_id % {group}").alias("base"))
    plan = cut.join(heads.select(F.col("conv_id").alias("base"), "head"), "base", "left").select("conv_id", "h", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")).alias("head"))
    plan = stored(plan, lasting=True)
    begin = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.at").alias("turn"), "t.digest", "t.chars")
    rest = own.join(plan.select("conv_id", "h", F.size("head").alias("kept")), "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("kept")).alias("turn"), "digest", "chars")
    return begin.union(rest), plan.select("conv_id")


# prefixes: fingerprints whose sums run on over the borders of ranges


def _ints(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns]


def _power_of(n: int) -> int:
    return pow(_BASE, n, 1 << 64)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns with their place in the conversation and prefix sums, as far as this range knows them."""
    part, held, at, k1, k2 = TaskContext.get().partitionId(), None, 0, _U(0), _U(0)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv = batch.column("conv_id").to_numpy()
        halves = mix(np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64).reshape(-1, 2).copy())
        begin = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
        goes_on = held is not None and conv[0] == held
        before = np.zeros(len(begin), np.int64)
        before[0] = at if goes_on else 0
        place = np.arange(n) - begin[group] + before[group]
        power = _power("up", _BASE, int(place.max()) + 1)[place]
        out = []
        for half, so_far in ((halves[:, 0], k1), (halves[:, 1], k2)):
            term = half * power
            sums = np.cumsum(term, dtype=np.uint64)
            start = (sums - term)[begin]
            start[0] = 0
            sums -= start[group]
            if goes_on:
                sums[group == 0] += so_far
            out += [sums, term]
        held, at, k1, k2 = conv[-1], int(place[-1]) + 1, out[0][-1], out[2][-1]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *_ints(np.full(n, part), place + 1, *out), batch.column("chars")], ["conv_id", "part", "depth", "k1", "t1", "k2", "t2", "chars"])


def prefixes(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, k1, k2, p1, p2, chars): for each turn the fingerprints of the prefix that it ends and of the one before.

    A range knows its sums but for its first conversation, which may have begun in ranges before; what is passed on is one
    place and sum a range.
    """
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("digest"), F.col("salt")]
    fixed = stored(turns.withColumn("salt", F.monotonically_increasing_id()), lasting=True)
    ranges = fixed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("conv_id", "digest", "chars")
    local = stored(ranges.mapInArrow(_summed, "conv_id long, part long, depth long, k1 long, t1 long, k2 long, t2 long, chars long"), lasting=True)
    ends = local.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "depth", "k1", "k2")).alias("last")).orderBy("part").collect()
    carried, open_ = {}, None
    for r in ends:
        conv, depth, k1, k2 = r["last"]
        if open_ and open_[0] == r["first"]:
            carried[r.part] = open_
            if conv == open_[0]:
                by = _power_of(open_[1])
                depth, k1, k2 = open_[1] + depth, open_[2] + by * k1, open_[3] + by * k2
        open_ = (conv, depth, k1 % (1 << 64), k2 % (1 << 64))
    sent = spark.sparkContext.broadcast(carried)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, part, depth, *sums = (batch.column(c).to_numpy().copy() for c in ("conv_id", "part", "depth", "k1", "t1", "k2", "t2"))
            k1, t1, k2, t2 = (x.view(np.uint64) for x in sums)
            for p in np.unique(part).tolist():
                if p in sent.value:
                    held, at, s1, s2 = sent.value[p]
                    rows = np.flatnonzero((part == p) & (conv == held))
                    by = _U(_power_of(at))
                    depth[rows] += at
                    k1[rows], t1[rows] = _U(s1) + by * k1[rows], by * t1[rows]
                    k2[rows], t2[rows] = _U(s2) + by * k2[rows], by * t2[rows]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *_ints(depth, k1, k2, k1 - t1, k2 - t2), batch.column("chars")], ["conv_id", "depth", "k1", "k2", "p1", "p2", "chars"])

    return local.mapInArrow(whole, "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, chars long")


# shards: level-order tries


class Louds:
    """A forest in level order: for each node, a top one above all first, as many ones as children and a zero."""

    def __init__(self, degrees: np.ndarray):
        ends = np.cumsum(degrees + 1)
        self.bits = np.ones(int(ends[-1]), bool)
        self.bits[ends - 1] = False
        self.zeros = np.cumsum(~self.bits)

    def parents(self) -> np.ndarray:
        """The parent of each node but the top: the i-th one belongs to the node whose zero comes next."""
        return self.zeros[np.flatnonzero(self.bits)]


def _ends(conv: np.ndarray, node: np.ndarray, nodes: int) -> list[str]:
    order = np.lexsort((conv, node))
    ids, bounds = conv[order].tolist(), np.searchsorted(node[order], np.arange(nodes + 1)).tolist()
    return [hashlib.sha256(",".join(map(str, ids[a:b])).encode()).hexdigest() if a < b else NOTHING for a, b in zip(bounds, bounds[1:])]


def _shard(batch: pa.Table) -> pa.Table:
    """The nodes of a shard's units, for a row (conv_id, path) a conversation: path has its turns below the heavy ones, by depth."""
    table_ = batch.combine_chunks()
    conv = table_.column("conv_id").to_numpy()
    path = table_.column("path").combine_chunks()
    path = path.chunk(0) if isinstance(path, pa.ChunkedArray) else path
    offset = path.offsets.to_numpy().astype(np.int64)
    depth, k1, k2, p1, p2, chars = (path.values.field(c).to_numpy() for c in ("depth", "k1", "k2", "p1", "p2", "chars"))
    long, at = np.diff(offset), np.full(len(conv), 0)
    active = np.arange(len(conv))
    degrees, levels, labels = [], [(0, 1)], []  # node 0 is the top, above all units
    level = 0
    while len(active := active[long[active] > level]):
        here = offset[active] + level
        up = at[active]
        order = np.lexsort((conv[active], k2[here], k1[here], depth[here], up))
        active, here, up = active[order], here[order], up[order]
        new = np.concatenate(([True], (up[1:] != up[:-1]) | (k1[here[1:]] != k1[here[:-1]]) | (k2[here[1:]] != k2[here[:-1]]) | (depth[here[1:]] != depth[here[:-1]])))
        low, high = levels[-1]
        first = np.flatnonzero(new)
        degrees.append(np.bincount(up[first] - low, minlength=high - low))
        at[active] = high + np.cumsum(new) - 1
        levels.append((high, high + len(first)))
        labels.append((conv[active[first]], here[first], np.diff(np.append(first, len(active)))))
        level += 1
    low, high = levels[-1]
    degree = np.concatenate([*degrees, np.zeros(high - low, np.int64)])
    parent = np.concatenate(([0], Louds(degree).parents()))
    least, row, members = (np.concatenate([np.zeros(1, np.int64), *x]) for x in zip(*labels))
    leaves, saved = (degree == 0).astype(np.int64), (members - 1) * chars[row]
    for low, high in levels[:1:-1]:  # levels in reverse; the units' roots are left as they are
        np.add.at(leaves, parent[low:high], leaves[low:high])
        np.add.at(saved, parent[low:high], saved[low:high])
    top = np.arange(1, len(parent)) < levels[1][1]
    above = pa.array(least[parent[1:]], mask=top)
    row = row[1:]
    ends = _ends(conv, at - 1, len(parent) - 1)
    return pa.Table.from_arrays(
        [*_ints(least[1:], depth[row]), above, *_ints(members[1:], degree[1:], leaves[1:], saved[1:]), pa.array(ends), *_ints(p1[row], p2[row]), pa.array(top)],
        ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "u1", "u2", "top"],
    )


# heavy upper levels


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, k1, k2, conv_id) as pieces of comma-joined ids of one node."""
    key, ids, first, size, out = None, [], 0, 0, []

    def piece() -> None:
        if ids:
            out.append((*key, first, ",".join(ids).encode()))

    for batch in batches:
        for *here, conv in zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))):
            if here != key or size >= PIECE:
                piece()
                key, ids, first, size = here, [], conv, 0
            ids.append(str(conv))
            size += len(ids[-1]) + 1
        yield _pieces(out)
        out = []
    piece()
    yield _pieces(out)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], [*KEY, "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one digest a node."""
    key, digest, out = None, None, []
    for batch in batches:
        for *here, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
            if here != key:
                if key:
                    out.append((*key, digest.hexdigest()))
                key, digest = here, hashlib.sha256(ids)
            else:
                digest.update(b"," + ids)
    if key:
        out.append((*key, digest.hexdigest()))
    columns = list(zip(*out)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*KEY, "ends_sha256"])


def heavy_ends(ends: DataFrame) -> DataFrame:
    """Rows (depth, k1, k2, ends_sha256) for ends (depth, k1, k2, conv_id); of any number for a node, none held together."""
    n = partitions(ends.sparkSession)
    order = [*KEY, "conv_id"]
    pieces = stored(ends, lasting=True).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_packed, "depth long, k1 long, k2 long, first long, ids binary")
    return pieces.repartition(n, *KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def rolled_up(heavy: DataFrame) -> DataFrame:
    """heavy (depth, k1, k2, p1, p2, leaves, saved, ..) with leaves and saved of the whole subtree, by pointer doubling.

    After round i a node has the sums of its descendants less than 2**i below it and a pointer 2**i up.
    """
    now = stored(heavy.select(*KEY, "leaves", "saved", (F.col("depth") - 1).alias("a0"), F.col("p1").alias("a1"), F.col("p2").alias("a2")), lasting=True)
    while not now.where("a0 >= 0").isEmpty():
        up = now.where("a0 >= 0").groupBy(F.col("a0").alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("also"))
        far = now.select(*(F.col(c).alias(a) for c, a in zip(KEY, ("a0", "a1", "a2"))), F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        now = stored(
            now.join(up, [*KEY], "left").join(far, ["a0", "a1", "a2"], "left")
            .select(*KEY, (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("also", F.lit(0))).alias("saved"), F.coalesce("b0", F.lit(-1)).alias("a0"), F.col("b1").alias("a1"), F.col("b2").alias("a2")),
            lasting=True,
        )
    return heavy.drop("leaves", "saved").join(now.select(*KEY, "leaves", "saved"), [*KEY])


def trie(turns: DataFrame, ids: DataFrame, unit: int | None = None) -> DataFrame:
    """One row a node, for turns (conv_id, turn, digest, chars) and the ids (conv_id) of all conversations, also those without turns."""
    n = partitions(turns.sparkSession)
    paths = prefixes(turns)
    length = paths.groupBy("conv_id").agg(F.max("depth").alias("length"))
    paths = stored(paths.join(length, "conv_id").withColumn("left", F.col("length") - F.col("depth") + 1).drop("length"), lasting=True)
    every = stored(ids.distinct(), lasting=True)
    rows = paths.count()
    unit = unit or max(LEAST_UNIT, min(MOST_UNIT, rows // (4 * n)))
    weights = paths.groupBy(*KEY).agg(F.sum("left").alias("weight"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = every.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(*(zero.alias(c) for c in KEY), "n_convs", "conv_id", zero.alias("chars"), zero.alias("p1"), zero.alias("p2"))
    heavy = stored(weights.where(F.col("weight") > unit).drop("weight").unionByName(root), lasting=True)
    # below the heavy prefixes: one row a conversation, in shards by what it begins with there
    light = paths.join(heavy.select(*KEY), [*KEY], "left_anti")
    light = light.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*KEY, "p1", "p2", "chars"))).alias("path"))
    shards = max(n, rows // SHARD + 1)
    dealt = light.withColumn("shard", F.pmod(F.xxhash64(F.col("path")[0].k1, F.col("path")[0].k2), F.lit(shards)))
    nodes = stored(dealt.groupBy("shard").applyInArrow(lambda _, t: _shard(t), NODES), lasting=True)
    # merge: units' roots and heavy children under the heavy nodes
    tops = nodes.where("top").select((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2"), "n_leaves", "saved_tokens")
    units = tops.groupBy(*KEY).agg(F.count("*").alias("units"), F.sum("n_leaves").alias("below"), F.sum("saved_tokens").alias("saved_below"))
    children = heavy.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("heavies"))
    joined = heavy.join(units, [*KEY], "left").join(children, [*KEY], "left").fillna(0, ["units", "below", "saved_below", "heavies"])
    joined = joined.withColumn("n_children", F.col("units") + F.col("heavies")).withColumn("leaves", F.col("below") + (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars") + F.col("saved_below"))
    above = rolled_up(stored(joined.drop("units", "below", "saved_below", "heavies"), lasting=True))
    stop = paths.where("left = 1").join(heavy.select(*KEY), [*KEY], "left_semi").select(*KEY, "conv_id")
    turnless = every.join(length.select("conv_id"), "conv_id", "left_anti").select(*(zero.alias(c) for c in KEY), "conv_id")
    name = heavy.select(F.col("depth").alias("d"), F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.col("conv_id").alias("parent"))
    above = above.join(heavy_ends(stop.union(turnless)), [*KEY], "left").join(name, (F.col("depth") - 1 == F.col("d")) & (F.col("p1") == F.col("m1")) & (F.col("p2") == F.col("m2")), "left")
    above = above.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    below = nodes.where("top").join(name, (F.col("depth") - 1 == F.col("d")) & (F.col("u1") == F.col("m1")) & (F.col("u2") == F.col("m2")), "left").withColumn("parent_conv_id", F.col("parent"))
    return above.unionByName(below.select(*COLUMNS)).unionByName(nodes.where("NOT top").select(*COLUMNS))


def prefix_trie(conversations: DataFrame, unit: int | None = None) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = stored(digested(conversations))
    return trie(turns, turns.select("conv_id"), unit)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = rebuilt(digested(table(sf_dir, "conversations", spark)))
    return trie(turns, ids)


QUERIES: dict[str, Callable] = {"op13_conversation_trie": op13_conversation_trie}
SQL: dict[str, str] = {
    "op13_conversation_trie": """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS crc),
t AS (SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS label, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, n, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda j: ascii(substr(conv_id::VARCHAR, j, 1))::BIGINT)),
    lambda a, y: xor(a >> 8, crc[xor(a & 255, y) + 1])), 4294967295) % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id), tab),
r AS (SELECT c.conv_id, t.i AS d, label, chars FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL SELECT c.conv_id, t.i - c.h + least(c.h, coalesce(b.n, 0)), label, chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h LEFT JOIN c AS b ON b.conv_id = c.base),
m AS (SELECT conv_id, d, chars, string_agg(label, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
v AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM m GROUP BY d, key),
k AS (SELECT v.d, v.key, count(w.key) AS n_children FROM v LEFT JOIN v AS w ON w.d = v.d + 1 AND left(w.key, length(v.key)) = v.key GROUP BY v.d, v.key),
s AS (SELECT m.key, m.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved FROM v JOIN k USING (d, key) JOIN m ON m.conv_id = v.conv_id AND m.d <= v.d GROUP BY m.key, m.d),
l AS (SELECT conv_id, max(d) AS d FROM m GROUP BY conv_id),
e AS (SELECT m.key, m.d, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM m JOIN l USING (conv_id, d) GROUP BY m.key, m.d)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN k USING (d, key) JOIN s USING (d, key) LEFT JOIN e USING (d, key) LEFT JOIN v AS p ON p.d = v.d - 1 AND p.key = left(v.key, 64 * (v.d - 1))
"""
}
