"""Where records come from: provenance handed down along derivations, all contributing sources, and cycles.

Records (entries, senses, examples) name the records they were made from. A field that a record does not
have itself comes from its nearest ancestor that has it, every source of its ancestors contributes to it, and a record
that is derived from itself is reported. The walks go a step at a time over what the step before reached, so a
round's joins grow with what is new and not with all pairs of records and ancestors; there are as many rounds
as the longest derivation has steps. Each round is written to the shared folder, which cuts the lineage.

Cases: an edge of a null end, or of a record that is not there, counts as none; repeated edges and records count once
(of a record the least field values); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import folders


def _kept(df: DataFrame) -> DataFrame:
    """df, written and read again."""
    at = folders.scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _edges(records: DataFrame, edges: DataFrame) -> DataFrame:
    known = records.select("id").where("id IS NOT NULL").distinct()
    return _kept(edges.select("id", "input").distinct().join(known, "id", "left_semi").join(known.withColumnRenamed("id", "input"), "input", "left_semi"))


def inherited(records: DataFrame, edges: DataFrame, field: str) -> DataFrame:
    """Rows (id, value, origin, steps): the field's value of each record (id, field) or its nearest ancestor by edges (id, input) that has one.

    Of ancestors equally near the one of the smallest id counts; records that find none are left out.
    """
    edges = _edges(records, edges)
    own = records.where(F.col("id").isNotNull() & F.col(field).isNotNull()).groupBy("id").agg(F.min(field).alias("value"))
    new = _kept(own.select("id", "value", F.col("id").alias("origin"), F.lit(0).alias("steps")))
    found = [new]
    step = 0
    while not new.isEmpty():
        step += 1
        done = found[0]
        for more in found[1:]:
            done = done.unionByName(more)
        reached = edges.join(new.select(F.col("id").alias("input"), "value", "origin"), "input").groupBy("id").agg(F.min(F.struct("origin", "value")).alias("m"))
        new = _kept(reached.join(done.select("id"), "id", "left_anti").select("id", "m.value", "m.origin", F.lit(step).alias("steps")))
        found.append(new)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contributors(records: DataFrame, edges: DataFrame, source: str = "source_id") -> DataFrame:
    """Rows (id, source): every source of a record or of one that it was made from, once. Sources are a registry, so these are not all pairs."""
    edges = _edges(records, edges)
    new = _kept(records.where(F.col("id").isNotNull() & F.col(source).isNotNull()).select("id", F.col(source).alias("source")).distinct())
    every = new
    while not new.isEmpty():
        reached = edges.join(new.select(F.col("id").alias("input"), "source"), "input").select("id", "source").distinct()
        new = _kept(reached.join(every, ["id", "source"], "left_anti"))
        every = every.unionByName(new)
    return every


def _peeled(edges: DataFrame, end: str, other: str) -> DataFrame:
    """The edges that are left when edges whose `other` end is no edge's `end` are taken away again and again."""
    while True:
        left = _kept(edges.join(edges.select(F.col(end).alias(other)).distinct(), other, "left_semi").select("id", "input"))
        if left.count() == edges.count():
            return left
        edges = left


def cyclic(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id) of the records that are on a cycle of derivations, or on a way from one cycle to another."""
    edges = _peeled(_peeled(_edges(records, edges), "id", "input"), "input", "id")
    return edges.select("id").distinct()


def with_provenance(records: DataFrame, edges: DataFrame, fields: list[str], source: str = "source_id") -> DataFrame:
    """records' ids with, for each field, a struct (value, origin, steps), the sorted sources, and whether they are cyclic."""
    out = records.select("id").where("id IS NOT NULL").distinct()
    for field in fields:
        out = out.join(inherited(records, edges, field).select("id", F.struct("value", "origin", "steps").alias(field)), "id", "left")
    every = contributors(records, edges, source).groupBy("id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    round_ = cyclic(records, edges).withColumn("cyclic", F.lit(True))
    return out.join(every, "id", "left").join(round_, "id", "left").select("id", *fields, F.coalesce("sources", F.array().cast("array<string>")).alias("sources"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))


def record_pointer(kind: Column, **fields: Column) -> Column:
    """The struct that names a source record: its kind, and for each field its value where the kind has it."""
    of = {"source_record_id": ("source_record_id",), "url_canonical+entry_index": ("url_canonical", "entry_index"), "css_selector+text_quote": ("css_selector", "text_quote"), "page+bbox+block_index": ("page_number", "page_index", "bbox", "block_index")}
    return F.struct(kind.alias("kind"), *[F.when(kind.isin(*[k for k, names in of.items() if n in names]), c).alias(n) for n, c in fields.items()])
