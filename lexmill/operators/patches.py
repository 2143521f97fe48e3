"""Corrections of nested JSON documents by JSON Pointer: add, remove, replace, move, copy and test.

A document with approved patches becomes rows of its nodes, a level at a time by variant_explode, and those one
array (path, kind, text). A fold over its operations, in one expression, moves paths: array positions behind an
added or removed place shift, a moved or copied subtree gets a new beginning. Then the text is put together
from the deepest level up. All of a record's operations apply, or none does. Documents without patches are
not taken apart. The work of a record grows with its nodes and operations, both of which are its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import folders

NODES = "array<struct<p:array<string>,t:string,v:string>>"


def pointer(c: Column) -> Column:
    """The steps of a JSON Pointer; null for what is none."""
    steps = F.transform(F.slice(F.split(c, "/", -1), 2, F.length(c) + 1), lambda s: F.replace(F.replace(s, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    return F.when(c == "", F.array().cast("array<string>")).when(c.startswith("/") & ~c.rlike("~([^01]|$)"), steps)


def nodes(docs: DataFrame) -> DataFrame:
    """Rows (id, nodes) for docs (id, json): every value of a document as (p, t, v), where it stands, its kind and a scalar's text; null if it is no JSON."""
    spark = docs.sparkSession
    at, depth = folders.scratch(spark), 0
    level = docs.select("id", F.array().cast("array<string>").alias("p"), F.try_parse_json("json").alias("value"))
    while True:
        kind = F.schema_of_variant("value")
        typed = level.where("value IS NOT NULL").withColumn("t", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").otherwise("scalar"))
        typed.withColumn("value", F.to_json("value")).write.parquet(f"{at}/{depth}")
        level = spark.read.parquet(f"{at}/{depth}").where("t <> 'scalar'").withColumn("value", F.parse_json("value"))
        if level.isEmpty():
            break
        level = level.select("id", "p", F.col("value").alias("whole")).lateralJoin(spark.tvf.variant_explode(F.col("whole").outer())).select("id", F.concat("p", F.array(F.coalesce("key", F.col("pos").cast("string")))).alias("p"), "value")
        depth += 1
    every = spark.read.parquet(*[f"{at}/{d}" for d in range(depth + 1)])
    return every.groupBy("id").agg(F.collect_list(F.struct("p", "t", F.when(F.col("t") == "scalar", F.col("value")).alias("v"))).alias("nodes"))


# the fold, as SQL expressions over arrays of nodes


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _under(e: str, p: str) -> str:
    return f"filter({e}, x -> slice(x.p, 1, size({p})) = {p})"


def _outside(e: str, p: str) -> str:
    return f"filter({e}, x -> slice(x.p, 1, size({p})) <> {p})"


def _there(e: str, p: str) -> str:
    return f"exists({e}, x -> x.p = {p})"


def _moved(e: str, p: str, to: str) -> str:
    """Nodes under p as nodes under `to`."""
    return f"transform({e}, x -> named_struct('p', concat({to}, slice(x.p, size({p}) + 1, size(x.p))), 't', x.t, 'v', x.v))"


def _shifted(e: str, place: str, start: str, by: str) -> str:
    """Nodes with the positions from `start` on, in the array place.q, moved by one."""
    n = f"size({place}.q)"
    inside = f"size(x.p) > {n} AND slice(x.p, 1, {n}) = {place}.q AND TRY_CAST(get(x.p, {n}) AS INT) >= {start}"
    return f"transform({e}, x -> IF({inside}, named_struct('p', concat({place}.q, array(CAST(TRY_CAST(get(x.p, {n}) AS INT) {by} AS STRING)), slice(x.p, {n} + 2, size(x.p))), 't', x.t, 'v', x.v), x))"


def _place(e: str, p: str) -> str:
    """What a path's last step stands in: the parent's path, kind and number of children."""
    q = f"slice({p}, 1, greatest(size({p}) - 1, 0))"
    return _let(q, "q", f"named_struct('q', q, 'k', get({p}, size({p}) - 1), 't', get(filter({e}, x -> x.p = q), 0).t, 'n', size(filter({e}, x -> size(x.p) = size(q) + 1 AND slice(x.p, 1, size(q)) = q)))")


def _added(e: str, p: str, s: str) -> str:
    """Nodes with the document s (paths from its root) at p; null where it cannot stand."""
    at = f"IF(z.k = '-', z.n, IF(z.k RLIKE '^(0|[1-9][0-9]{{0,8}})$', CAST(z.k AS INT), NULL))"
    none = "CAST(array() AS array<string>)"
    inserted = _let(at, "i", f"IF(i <= z.n, concat({_shifted(e, 'z', 'i', '+ 1')}, {_moved(s, none, 'concat(z.q, array(CAST(i AS STRING)))')}), NULL)")
    whole = _let(_place(e, p), "z", f"CASE WHEN z.t = 'object' THEN concat({_outside(e, p)}, {_moved(s, none, p)}) WHEN z.t = 'array' THEN {inserted} END")
    return f"IF(size({p}) = 0, {s}, {whole})"


def _removed(e: str, p: str) -> str:
    out = f"IF(z.t = 'array', {_shifted(_outside(e, p), 'z', 'TRY_CAST(z.k AS INT)', '- 1')}, {_outside(e, p)})"
    return f"IF(size({p}) > 0 AND {_there(e, p)}, {_let(_place(e, p), 'z', out)}, NULL)"


def _alike(e: str) -> str:
    """Nodes in a form in which equal documents are equal: in order of path, numbers by value."""
    return f"array_sort(transform({e}, x -> named_struct('p', x.p, 't', x.t, 'v', IF(x.v RLIKE '^-?[0-9]', CAST(CAST(x.v AS DOUBLE) AS STRING), x.v))))"


def _step(a: str, o: str) -> str:
    """The nodes after an operation, or null if it does not apply."""
    none = "CAST(array() AS array<string>)"
    e, p, f, s = f"{a}.e", f"{o}.p", f"{o}.f", f"{o}.s"
    taken = _moved(_under(e, f), f, none)
    moved = _let(taken, "m", _let(_removed(e, f), "r", f"IF(r IS NULL, NULL, {_added('r', p, 'm')})"))
    return f"""CASE WHEN {p} IS NULL THEN NULL
      WHEN {o}.op = 'add' AND {s} IS NOT NULL THEN {_added(e, p, s)}
      WHEN {o}.op = 'remove' THEN {_removed(e, p)}
      WHEN {o}.op = 'replace' AND {s} IS NOT NULL AND {_there(e, p)} THEN concat({_outside(e, p)}, {_moved(s, none, p)})
      WHEN {o}.op = 'copy' AND {_there(e, f)} THEN {_let(taken, 'm', _added(e, p, 'm'))}
      WHEN {o}.op = 'move' AND {_there(e, f)} AND {f} = {p} THEN {e}
      WHEN {o}.op = 'move' AND {_there(e, f)} AND slice({p}, 1, size({f})) <> {f} THEN {moved}
      WHEN {o}.op = 'test' AND {_there(e, p)} AND {_alike(_moved(_under(e, p), p, none))} = {_alike(s)} THEN {e} END"""


_FOLD = f"""aggregate(ops, named_struct('e', nodes, 'error', CAST(NULL AS STRING)), (a, o) ->
  IF(a.error IS NOT NULL, a, {_let(_step('a', 'o'), 'n', "named_struct('e', coalesce(n, a.e), 'error', IF(n IS NULL, o.patch_id, NULL))")}))"""
#: The document's text: containers of each level get the texts of their children, the deepest first; then the root's is left.
_LEVEL = """transform(filter(b, x -> size(x.p) = d), c -> IF(c.t = 'scalar', c, named_struct('p', c.p, 't', c.t, 'v', transform(array(filter(b, x -> size(x.p) = d + 1 AND slice(x.p, 1, d) = c.p)), kids ->
    IF(c.t = 'array', concat('[', array_join(transform(array_sort(transform(kids, x -> named_struct('i', CAST(x.p[d] AS INT), 'v', x.v))), x -> x.v), ','), ']'),
      concat('{', array_join(transform(array_sort(transform(kids, x -> named_struct('i', x.p[d], 'v', x.v))), x -> concat(substr(to_json(array(x.i)), 2, length(to_json(array(x.i))) - 2), ':', x.v)), ','), '}')))[0])))"""
_TEXT = f"aggregate(reverse(sequence(0, array_max(transform(e, x -> size(x.p))))), e, (b, d) -> concat(filter(b, x -> size(x.p) < d), {_LEVEL}), b -> filter(b, x -> size(x.p) = 0)[0].v)"


def patched(records: DataFrame, patches: DataFrame, document: str = "document") -> DataFrame:
    """records (ir_id, document as JSON text, ..) after their approved patches (ir_id, patch_id, seq, op, path, from, value as JSON text, approved), with patch_error.

    A record's operations apply in the order of patch_id and seq; if one does not, the document stays as it was and
    patch_error names its patch. So it does if the document is no JSON ("document"). Objects come out with their keys in order.
    """
    approved = patches.where("approved AND ir_id IS NOT NULL").withColumn("id", F.concat_ws("\x1f", "ir_id", "patch_id", F.col("seq").cast("string"))).withColumnRenamed("from", "from_")
    values = nodes(approved.where("value IS NOT NULL").select("id", F.col("value").alias("json"))).withColumnRenamed("nodes", "s")
    one = approved.join(values, "id", "left").select("ir_id", F.struct("patch_id", "seq", "op", pointer(F.col("path")).alias("p"), pointer(F.coalesce("from_", F.lit("#"))).alias("f"), "s").alias("o"))
    ops = one.groupBy("ir_id").agg(F.expr("array_sort(collect_list(o), (l, r) -> CASE WHEN struct(l.patch_id, l.seq) < struct(r.patch_id, r.seq) THEN -1 WHEN struct(l.patch_id, l.seq) > struct(r.patch_id, r.seq) THEN 1 ELSE 0 END)").alias("ops"))
    mine = nodes(records.join(ops, "ir_id", "left_semi").select(F.col("ir_id").alias("id"), F.col(document).alias("json"))).withColumnRenamed("id", "ir_id")
    done = ops.join(mine, "ir_id", "left").withColumn("f", F.expr(_FOLD)).select("ir_id", F.col("f.e").alias("e"), F.when(F.col("nodes").isNull(), "document").otherwise(F.col("f.error")).alias("__error"))
    done = done.select("ir_id", F.when(F.col("__error").isNull(), F.expr(_TEXT)).alias("__text"), "__error")
    return records.join(done, "ir_id", "left").select(*[F.coalesce("__text", document).alias(c) if c == document else F.col(c) for c in records.columns], F.col("__error").alias("patch_error"))
