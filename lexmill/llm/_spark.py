"""Session helpers: tables in the shared folder, and connected components as joins."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._text import chunks


BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches to BATCH_BYTES, unless the session says otherwise, so rows of long texts do not fill a worker's memory."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def table(sf_dir: str, name: str, spark: SparkSession) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scopes = threading.local()


def stored(df: DataFrame, lasting: bool = False) -> DataFrame:
    """df as a table written in the shared folder: cuts the lineage and survives lost executors.

    Within `passing` the table goes at that scope's end; a lasting one goes at the end of the scope around it, if there is one.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/lexmill/{uuid.uuid4().hex}"
    scopes = getattr(_scopes, "held", [])
    if len(scopes) > lasting:
        scopes[-1 - lasting].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[None]:
    """A scope whose stored tables are deleted at its end."""
    if not hasattr(_scopes, "held"):
        _scopes.held = []
    _scopes.held.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.held.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected `edges` (a, b): rows (id, component_id), the smallest id reachable.

    Each round hangs every node on the smallest label among its neighbours and itself, then follows
    labels once more (pointer jumping); labels only fall, and the loop ends when none falls. All work
    is joins and minima with map-side combination, so a node of very many neighbours is no bottleneck.
    """
    with passing():
        both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component_id")))
        for _ in range(rounds):
            near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("component_id").alias("near"))
            # what hangs on the same root learns the smallest label that any of them sees
            seen = labels.join(near, "id").select("id", "component_id", F.least("near", "component_id").alias("low"))
            root = seen.groupBy("component_id").agg(F.min("low").alias("low"))
            hung = seen.drop("low").join(root, "component_id").select("id", F.col("component_id").alias("old"), F.col("low").alias("component_id"))
            jump = labels.select(F.col("id").alias("component_id"), F.col("component_id").alias("next"))
            new = stored(hung.join(jump, "component_id", "left").select("id", "old", F.least("component_id", "next").alias("component_id")))
            labels = new.select("id", "component_id")
            if new.where("old <> component_id").isEmpty():
                return stored(labels, lasting=True)
    raise RuntimeError(f"components not settled after {rounds} rounds")


def equal_texts(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, of): documents whose text a smaller doc_id has too, and the smallest such.

    Groups are a table of their own before the join, so adaptive execution can split the partition of a group of very many copies.
    """
    keyed = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.md5("text").alias("k1"), F.octet_length("text").alias("k2"))
    with passing():
        groups = stored(keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("of"), F.max("doc_id").alias("most")).where("of < most").drop("most"))
        return stored(keyed.join(groups, ["k1", "k2"]).where("doc_id > of").select("doc_id", "of").distinct(), lasting=True)


FILTER = 1 << 23


def bit_map(ids: DataFrame) -> np.ndarray:
    """FILTER bits as bytes, 1 MB whatever the size: set where an id (of ids) hashes to."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER)) + 1  # buckets are numbered from 1
    rows = ids.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("at")).groupBy("k").agg(F.bitmap_construct_agg("at").alias("bits")).collect()
    maps = np.zeros((FILTER // 32768, 4096), np.uint8)
    for r in rows:
        maps[r.k - 1] = np.frombuffer(r.bits, np.uint8)
    return maps.reshape(-1)


def is_set(maps: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return ((maps[bit // 8] >> (bit % 8).astype(np.uint8)) & 1).astype(bool)


def may_be_among(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of ids: False only for what is not among ids (id)."""
    sent = ids.sparkSession.sparkContext.broadcast(bit_map(ids))

    @F.pandas_udf("boolean")
    def held(bit: pd.Series) -> pd.Series:
        return pd.Series(is_set(sent.value, bit.to_numpy()))

    return lambda c: held(F.pmod(F.xxhash64(c), F.lit(FILTER)))


def carried(docs: DataFrame, ids: DataFrame, make: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Rows (doc_id, carried) for ids (id): what `make` gives for each text.

    A bit map of 1 MB, whatever the size, keeps most other documents from being shuffled; the join drops the rest.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bit_map(ids))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER))
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text", bit.alias("bit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = is_set(sent.value, batch.column("bit").to_numpy())
            for others, texts in chunks([batch.filter(pa.array(keep))]):
                yield pa.RecordBatch.from_arrays([pa.array(others["doc_id"], pa.int64()), pa.array(make(texts), pa.binary())], ["doc_id", "carried"])

    return named.mapInArrow(run, "doc_id long, carried binary").join(ids, F.col("doc_id") == F.col("id"), "left_semi").dropDuplicates(["doc_id"])


def literal(values: list[int]) -> Column:
    """An array<bigint> as one constant, folded by the optimiser; as many lit() would make as many expressions."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with `name`: each row's place, from 0, in the total order; of rows that tie any comes first.

    Ranges of the order are sorted side by side and numbered within; a second pass adds the rows of the ranges before,
    one number a range. No task holds more than its range, and a salt written with the rows parts equal ones too.
    """
    spark = df.sparkSession
    salt, within = fresh(df, "__salt", "__within")
    fixed = stored(df.withColumn(salt, F.monotonically_increasing_id()), lasting=True)
    ranges = fixed.repartitionByRange(partitions(spark), *order, F.col(salt)).sortWithinPartitions(*order, F.col(salt))
    placed = stored(ranges.drop(salt).withColumn(within, F.monotonically_increasing_id()), lasting=True)  # the range's number in the upper bits
    sizes = {r.part: r.n for r in placed.groupBy(F.shiftright(within, 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    start = F.element_at(literal(before), (F.shiftright(within, 33) + 1).cast("int"))
    return placed.withColumn(name, start + F.col(within).bitwiseAND((1 << 33) - 1)).drop(within)
