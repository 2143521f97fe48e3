"""Interleaving sources to target weights, by DataFrame operations only.

Method: Pfair scheduling. Documents of a source, in the order of a digest of doc_id, form blocks of
`block` documents. Target weights are whole numbers w of a total p, taken as they are: block i of a
source is released at floor(i p / w) and due at ceil((i + 1) p / w), in exact arithmetic; in each slot
the released block with the earliest deadline runs (ties: by source). So at every slot each source is
less than one block from w / p of the slots so far, however many there are.

The schedule is made in windows of slots side by side, and is the same as if it were made in one go.
A window begins p / min(w) slots early (longer than any block's time between release and deadline) in
the state where every block due by then has run and, of the released others, those due first: from
there the released blocks due by any deadline are as many as in the true schedule, or have all run in
both by the window's first slot. Windows are as long as that lead or longer, so at most half of the
work is repeated. A slot's work grows with the number of sources, all of which are one row of
(key, weight, blocks): a description of the mixture, not data.

Without weights a source's is the square root of its documents, in millionths, which lifts small
sources; given ones may be whole numbers, fractions, decimals or floats as they are written. Every
document gets its slot and position; nothing is dropped or repeated. `within_target` marks slots
before the first that a source with no blocks left would get: up to there the deviation holds. The
blocks left then follow in the order of deadline and source, in slots with gaps.

Rows are numbered in a source by counting (source, digest prefix) groups, so a source with a third of
all rows is dealt over many tasks. What is joined to rows is a row for each of those groups, on the
partitioning by which they were numbered, so rows are shuffled once.

Cases: null source counts as the source ''; sources without a given weight, or with 0, get null slots
and stay; null doc_id sorts as ''; repeated rows each get a place; an empty table gives no rows; all
input columns stay, those of the same name as an added one are replaced. Negative weights are 0.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from math import lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm._spark import fresh, stored, table

ADDED = ("units", "total", "block_no", "release", "deadline", "slot", "position", "within_target")
SPAN, STEP = 4096, 256


def _floor(i: str, by: str = "p", of: str = "w") -> str:
    return f"((CAST({i} AS DECIMAL(19, 0)) * CAST({by} AS DECIMAL(19, 0))) div {of})"


def _ceil(i: str, by: str = "p", of: str = "w") -> str:
    return f"((CAST({i} AS DECIMAL(19, 0)) * CAST({by} AS DECIMAL(19, 0)) + {of} - 1) div {of})"


def _block(k: str, i: str, w: str) -> str:
    """Block k of source i as a struct that sorts by deadline."""
    return f"named_struct('due', {_ceil(f'({k}) + 1', of=w)}, 'i', {i}, 'k', {k}, 'release', {_floor(k, of=w)}, 'w', {w})"


def _run(q: str, t: str, then: str) -> str:
    """`then` for b, the block that runs in slot t of the next blocks q."""
    return f"transform(array(array_min(filter({q}, x -> x.release <= {t}))), b -> {then})[0]"


def _after(q: str) -> str:
    """The next blocks after b has run."""
    return f"transform({q}, x -> IF(x.i = b.i, {_block('x.k + 1', 'x.i', 'x.w')}, x))"


def _slots(low: str, high: str) -> str:
    return f"IF({low} < {high}, sequence({low}, {high} - 1), CAST(array() AS array<bigint>))"


#: The next block of each source at slot `early`: what is due has run, and of what is released as many of the earliest deadlines as there were slots.
_START = f"""
transform(array(transform(s, (x, i) -> {_block(_floor('early', 'x.w', 'p'), 'i', 'x.w')})), q ->
  transform(array(slice(array_sort(filter(q, x -> x.release < early)), 1, CAST(early - aggregate(q, 0L, (a, x) -> a + x.k) AS INT))), ran ->
    transform(q, x -> IF(exists(ran, y -> y.i = x.i), {_block('x.k + 1', 'x.i', 'x.w')}, x)))[0])[0]
"""
_LEAD = f"aggregate({_slots('early', 'begin')}, {_START}, (q, t) -> {_run('q', 't', _after('q'))})"
#: The blocks that run in a window's slots, a list for each STEP of them.
_WINDOW = f"""
aggregate(sequence(begin, until - 1, {STEP}L), named_struct('q', {_LEAD}, 'done', CAST(array() AS array<array<struct<i: int, k: bigint>>>)),
  (o, from) -> transform(array(aggregate({_slots('from', f'least(from + {STEP}, until)')},
      named_struct('q', o.q, 'ran', CAST(array() AS array<struct<i: int, k: bigint>>)),
      (a, t) -> {_run('a.q', 't', f"named_struct('q', {_after('a.q')}, 'ran', concat(a.ran, array(named_struct('i', b.i, 'k', b.k))))")})),
    r -> named_struct('q', r.q, 'done', concat(o.done, array(r.ran))))[0],
  o -> flatten(o.done))
"""


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """The weights as whole numbers in the same proportions, without 0 and less."""
    exact = {k: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for k, w in weights.items()}
    exact = {k: w for k, w in exact.items() if w > 0}
    whole = lcm(*(w.denominator for w in exact.values()))
    out = {k: int(w * whole) for k, w in exact.items()}
    if sum(out.values()) >= 10**18:
        raise ValueError("weights have too many digits")
    return out


def target_units(counts: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Rows (key, n, w) for counts (key, n)."""
    if weights is None:
        return counts.select("key", "n", F.round(F.sqrt("n") * 1000000).cast("long").alias("w"))
    whole = whole_weights(weights)
    given = F.create_map(*[F.lit(x) for kv in whole.items() for x in kv]) if whole else F.lit(None).cast("map<string,bigint>")
    return counts.select("key", "n", F.try_element_at(given, F.col("key")).cast("long").alias("w")).where("w > 0")


def schedule(units: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """For units (key, n, w): rows (key, block_no, slot) of the blocks that run before any source is through; and one row (m, p, s, horizon)."""
    sources = F.array_sort(F.collect_list(F.struct("key", "w", F.expr(f"(n + {block - 1}) div {block}").alias("blocks"))))
    one = units.agg(sources.alias("s")).where("size(s) > 0").withColumn("p", F.expr("aggregate(s, 0L, (a, x) -> a + x.w)"))
    one = one.withColumn("last", F.expr(f"array_min(transform(s, x -> {_ceil('x.blocks + 1', of='x.w')}))")).withColumn("lead", F.expr("p div array_min(transform(s, x -> x.w)) + 2")).withColumn("span", F.expr(f"greatest({SPAN}L, lead)"))
    windows = one.select(F.explode(F.expr("sequence(0L, (last - 1) div span)")).alias("no")).repartition("no").crossJoin(F.broadcast(one))
    windows = windows.withColumn("begin", F.expr("no * span")).withColumn("until", F.expr("least((no + 1) * span, last)")).withColumn("early", F.expr("greatest(0L, begin - lead)"))
    ran = windows.select("begin", "s", F.posexplode(F.expr(_WINDOW)).alias("at", "b")).select(F.expr("s[b.i].key").alias("key"), F.col("b.k").alias("block_no"), F.expr("begin + at").alias("slot"), F.expr("b.k = s[b.i].blocks").alias("through"))
    ran = stored(ran, lasting=True)  # a row a block: else it would be made once for the slots and once for the horizon
    return ran, one.select("s", "p").crossJoin(F.broadcast(ran.where("through").agg(F.min("slot").alias("horizon"))))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = 8) -> DataFrame:
    """docs with the columns of ADDED."""
    if clash := [c for c in docs.columns if c.lower() in ADDED]:
        docs = docs.drop(*clash)
    columns = docs.columns
    key, digest, part, rank, before, w, s, p, slots, horizon = fresh(docs, "__key", "__digest", "__part", "__rank", "__before", "__w", "__s", "__p", "__slots", "__horizon")
    keyed = docs.withColumn(key, F.coalesce(F.col("source").cast("string"), F.lit(""))).withColumn(digest, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = keyed.withColumn(part, F.substring(digest, 1, 3))
    # counts from source and doc_id alone: the texts are not read for them
    groups = keyed.select(F.col(key).alias("key"), F.col(part).alias("part")).groupBy("key", "part").agg(F.count("*").alias("n"))
    parts = groups.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    units = target_units(groups.groupBy("key").agg(F.sum("n").alias("n")), weights)
    ran, one = schedule(units, block)
    # for each group of rows the slots of its blocks
    blocks = parts.withColumn("block_no", F.explode(F.expr(f"sequence(before div {block}, (before + n - 1) div {block})")))
    placed = blocks.join(ran.select("key", "block_no", "slot"), ["key", "block_no"], "left").groupBy("key", "part").agg(F.first("before").alias("before"), F.array_sort(F.collect_list(F.struct("block_no", "slot"))).alias("slots"))
    found = placed.join(units.select("key", "w"), "key", "left").select(F.col("key").alias(key), F.col("part").alias(part), F.col("before").alias(before), F.col("w").alias(w), F.col("slots").alias(slots))
    numbered = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(key, part).orderBy(digest)) - 1).join(found, [key, part]).withColumn(rank, F.col(rank) + F.col(before))
    out = numbered.join(F.broadcast(one.select(F.col("s").alias(s), F.col("p").alias(p), F.col("horizon").alias(horizon))), F.lit(True), "left")
    out = out.withColumn("units", F.col(w)).withColumn("total", F.when(F.col(w).isNotNull(), F.col(p))).withColumn("block_no", F.when(F.col(w).isNotNull(), F.expr(f"{rank} div {block}")))
    out = out.withColumn("release", F.expr(_floor("block_no", p, w))).withColumn("deadline", F.expr(_ceil("block_no + 1", p, w)))
    ran_at = F.expr(f"get({slots}, CAST(block_no - {slots}[0].block_no AS INT)).slot")
    out = out.withColumn("slot", ran_at).withColumn("within_target", F.coalesce(F.col("slot") < F.col(horizon), F.lit(False)))
    later = F.expr(f"{horizon} + (deadline - {horizon}) * size({s}) + array_position(transform({s}, x -> x.key), {key}) - 1")
    out = out.withColumn("slot", F.when(F.col("within_target"), F.col("slot")).otherwise(F.when(F.col(w).isNotNull(), later)))
    out = out.withColumn("position", F.expr(f"slot * {block} + {rank} % {block}"))
    return out.select(*columns, *ADDED)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(sf_dir, "documents", spark).select("doc_id", "source"))


QUERIES: dict[str, Callable] = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {
    "op6_mixing": """
WITH RECURSIVE k AS (SELECT doc_id, source, coalesce(source, '') AS key, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
u AS (SELECT key, count(*) AS n, round(sqrt(count(*)) * 1000000)::HUGEINT AS w, (count(*) + 7) // 8 AS blocks FROM k GROUP BY key),
s AS (SELECT list(key ORDER BY key) AS keys, list(w ORDER BY key) AS w, list(blocks ORDER BY key) AS blocks, sum(w)::HUGEINT AS p, count(*) AS m FROM u),
run(t, done, pick, k) AS (
  SELECT -1, list_transform(w, lambda x: 0::HUGEINT), NULL::INT, NULL::HUGEINT FROM s
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, j: CASE WHEN j = b.i THEN x + 1 ELSE x END), b.i, done[b.i]
  FROM (SELECT t, done, list_sort(list_transform(list_filter(range(1, m + 1), lambda i: done[i] * p // w[i] <= t + 1),
          lambda i: {'due': ((done[i] + 1) * p + w[i] - 1) // w[i], 'i': i::INT}))[1] AS b FROM run, s WHERE t = -1 OR k < blocks[pick])),
horizon AS (SELECT max(t) AS h FROM run),
ran AS (SELECT keys[pick] AS key, k AS block_no, t AS slot FROM run, s WHERE t >= 0 AND t < (SELECT h FROM horizon)),
b AS (SELECT doc_id, source, key, rank, rank // 8 AS block_no FROM (SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY digest) - 1 AS rank FROM k)),
d AS (SELECT b.*, w AS units, p AS total, b.block_no * p // u.w AS release, ((b.block_no + 1) * p + u.w - 1) // u.w AS deadline, ran.slot AS ran_at, list_position(keys, key) - 1 AS nth, m, h
      FROM b JOIN u USING (key) CROSS JOIN (SELECT p, m, keys FROM s) CROSS JOIN horizon LEFT JOIN ran ON ran.key = b.key AND ran.block_no = b.block_no),
e AS (SELECT *, coalesce(ran_at, h + (deadline - h) * m + nth) AS slot FROM d)
SELECT doc_id, source, units::BIGINT AS units, total::BIGINT AS total, block_no::BIGINT AS block_no, release::BIGINT AS release, deadline::BIGINT AS deadline,
  slot::BIGINT AS slot, (slot * 8 + rank % 8)::BIGINT AS position, ran_at IS NOT NULL AS within_target
FROM e
"""
}
