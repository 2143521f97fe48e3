"""Rules on records before a bundle: approved corrections, part-of-speech tags, excluded sources, seed choice, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source labels of the first tag map and their internal tags; anything else is OTHER and uncertain.
POS_TAGS = {"n": "NOUN", "n.prop": "NOUN", "v": "VERB", "vq": "VERB", "cop": "VERB", "prep": "ADP", "pp": "ADP", "prt": "PART", "pm": "PART", "conj": "PART"}
PATCH = "array<struct<patch_id:string,op:string,path:string,value:string>>"


def corrected(records: DataFrame, patches: DataFrame) -> DataFrame:
    """records (ir_id, fields map) after the approved patches (ir_id, patch_id, op, path, value, approved) of each, in order of patch_id.

    add and replace set a field (replace only one that is there), remove drops one, test must find its
    value; a record with a patch that does not apply keeps all its old fields, and `patch_error` names the
    first such patch. A record's patches are folded in one expression; they are as many as were written for it.
    """
    lists = patches.where("approved").groupBy("ir_id").agg(F.array_sort(F.collect_list(F.struct("patch_id", "op", "path", "value"))).alias("__p"))

    def step(a: Column, p: Column) -> Column:
        there = F.map_contains_key(a.fields, p.path)
        good = F.when(p.op == "add", True).when(p.op.isin("replace", "remove"), there).when(p.op == "test", F.element_at(a.fields, p.path).eqNullSafe(p.value)).otherwise(False)
        without = F.map_filter(a.fields, lambda k, v: k != p.path)
        new = F.when(p.op.isin("add", "replace"), F.map_concat(without, F.create_map(p.path, p.value))).when(p.op == "remove", without).otherwise(a.fields)
        ok = a.error.isNull() & good
        return F.struct(F.when(ok, new).otherwise(a.fields).alias("fields"), F.when(a.error.isNull() & ~good, p.patch_id).otherwise(a.error).alias("error"))

    start = F.struct(F.col("fields").alias("fields"), F.lit(None).cast("string").alias("error"))
    folded = F.aggregate(F.coalesce("__p", F.array().cast(PATCH)), start, step)
    out = records.join(lists, "ir_id", "left").withColumn("__f", folded)
    return out.select(*[c for c in records.columns if c != "fields"], F.when(F.col("__f.error").isNull(), F.col("__f.fields")).otherwise(F.col("fields")).alias("fields"), F.col("__f.error").alias("patch_error"))


def pos_tag(raw: Column) -> tuple[Column, Column]:
    """(internal tag, whether it is uncertain) of a source label; null without a label."""
    table = F.create_map(*[F.lit(x) for kv in POS_TAGS.items() for x in kv])
    found = F.try_element_at(table, F.lower(F.trim(raw)))
    return F.when(raw.isNotNull(), F.coalesce(found, F.lit("OTHER"))), F.when(raw.isNotNull(), found.isNull())


def without_sources(records: DataFrame, disabled: DataFrame) -> DataFrame:
    """records whose source_id is not among disabled (source_id): the list is a registry of sources, joined as Spark sizes it."""
    return records.join(disabled.select("source_id").distinct(), "source_id", "left_anti")


def seed(records: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n records by a full order: a small bundle to begin with."""
    return records.orderBy(*order, "ir_id").limit(n)


def _present(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) != ""


MANIFEST = "manifest_schema_version string, bundle_id string, bundle_type string, record_schema_id string, record_schema_version string, files array<struct<path:string,byte_length:bigint,sha256:string>>, content_sha256 string"


def manifest_errors(json: Column) -> Column:
    """What is wrong with a manifest, as codes; none if it is whole."""
    m = F.from_json(json, MANIFEST)
    missing = [F.when(~_present(m[f]), f"missing_{f}") for f in ("manifest_schema_version", "bundle_id", "bundle_type", "record_schema_id", "content_sha256")]
    gates = [F.when(_present(m[f]) & (m[f] != want), f"unsupported_{f}") for f, want in (("manifest_schema_version", "1"), ("record_schema_id", "records_v1"))]
    files = [F.when(F.coalesce(F.size(m.files), F.lit(0)) <= 0, "no_files"), F.when(F.exists(m.files, lambda x: ~_present(x.path) | x.byte_length.isNull() | (x.byte_length < 0)), "bad_file")]
    delta = [F.when(m.bundle_type == "delta", "delta_not_supported")]
    return F.when(F.try_parse_json(json).isNull(), F.array(F.lit("not_json"))).otherwise(F.array_compact(F.array(*missing, *gates, *files, *delta)))


def catalog_errors(entries: DataFrame) -> DataFrame:
    """Rows (bundle_id, error) of catalogue entries (bundle_id, name, size_bytes, url_base, content_sha256): one for each fault."""
    faults = F.array_compact(F.array(
        F.when(~_present(F.col("name")), "name_missing"), F.when(F.col("size_bytes").isNull() | (F.col("size_bytes") < 0), "size_invalid"),
        F.when(~F.coalesce(F.col("url_base").endswith("/"), F.lit(False)), "url_base_not_a_directory"), F.when(~_present(F.col("content_sha256")), "content_sha256_missing"),
    ))
    own = entries.select("bundle_id", F.explode(faults).alias("error"))
    return own.unionByName(entries.groupBy("bundle_id").agg(F.count("*").alias("n")).where("n > 1").select("bundle_id", F.lit("duplicate_id").alias("error")))


def entry_details(entries: DataFrame) -> DataFrame:
    """One row for each sense of entries (entry_id, senses): its number (or its place) and its glosses, joined."""
    rows = entries.select("entry_id", F.posexplode("senses").alias("i", "s"))
    return rows.select("entry_id", F.col("i").alias("place"), F.coalesce("s.sense_num", F.col("i") + 1).alias("number"), F.concat_ws(" / ", "s.gloss_fr", "s.gloss_en", "s.gloss_ru").alias("glosses"), F.coalesce(F.size("s.examples"), F.lit(0)).alias("examples"))
