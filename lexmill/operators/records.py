"""From parsed units to normalized and enriched records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import norm

NORM_VERSION = "norm_v1"


def lexicon_forms(headword: Column, headword_nfc: Column, anchors: Column, anchors_nfc: Column) -> Column:
    """Variant forms of an entry: its anchors, before them the headword unless one of them is the same after
    composition; without anchors the headword alone."""
    alone = F.when(F.coalesce(headword, F.lit("")) != "", F.array(headword)).otherwise(F.array().cast("array<string>"))
    known = F.exists(anchors_nfc, lambda a: a == headword_nfc)
    return F.when(F.coalesce(F.size(anchors), F.lit(0)) <= 0, alone).when(known | (F.coalesce(headword, F.lit("")) == ""), anchors).otherwise(F.concat(F.array(headword), anchors))


def normalized(units: DataFrame) -> DataFrame:
    """units (ir_id, ir_kind, source_id, headword, anchors, term) as records with forms and search keys; other kinds are dropped.

    Forms are compared after composition, which is a pandas UDF; everything else stays in the JVM.
    """
    kinds = units.where(F.col("ir_kind").isin("lexicon_entry", "index_mapping"))
    composed = kinds.withColumn("__h", norm.nfc("headword")).withColumn("__a", F.split(norm.nfc(F.array_join("anchors", "\x1f")), "\x1f"))
    lexicon = F.col("ir_kind") == "lexicon_entry"
    preferred = F.when(lexicon, F.col("headword")).otherwise(F.col("term"))
    term = F.when(F.coalesce(F.col("term"), F.lit("")) != "", F.array("term")).otherwise(F.array().cast("array<string>"))
    forms = F.when(lexicon, lexicon_forms(F.col("headword"), F.col("__h"), F.col("anchors"), F.col("__a"))).otherwise(term)
    out = composed.select("ir_id", "ir_kind", "source_id", F.lit(NORM_VERSION).alias("norm_version"), preferred.alias("preferred_form"), forms.alias("variant_forms"))
    return out.withColumn("search_keys", norm.search_keys(F.col("variant_forms")))


def first_of_each(units: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order (file, line): a minimum with a partial step in each task, no sort."""
    return units.groupBy(key).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("__first")).select("__first.*")


def enriched(records: DataFrame, units: DataFrame, *order: str) -> DataFrame:
    """records with `display` from units (ir_id, fields_raw): of several units of one id the first; those without id or fields do not count."""
    usable = units.where("ir_id IS NOT NULL AND fields_raw IS NOT NULL")
    display = first_of_each(usable, "ir_id", *order).select("ir_id", F.col("fields_raw").alias("display"))
    return records.join(display, "ir_id", "left")


def kind_name(kind: Column) -> Column:
    return F.when(kind == "lexicon_entry", "lexicon_entries").when(kind == "index_mapping", "index_mappings").otherwise(F.coalesce(kind, F.lit("unknown")))


def sparse(c: Column) -> Column:
    """Empty strings become null, so that JSON leaves the field out."""
    return F.nullif(c, F.lit(""))


def entry_warnings(headword: Column, senses: Column, examples: Column, blocks: Column, glosses: Column) -> Column:
    """Data-quality codes of an entry, in their fixed order."""
    return F.array_compact(F.array(
        F.when(F.coalesce(headword, F.lit("")) == "", "missing_headword"),
        F.when(senses == 0, "no_senses_found"),
        F.when((senses > 0) & (glosses == 0), "no_glosses_in_any_sense"),
        F.when(senses > 30, F.concat(F.lit("unusually_many_senses: "), senses.cast("string"))),
        F.when(examples > 50, F.concat(F.lit("unusually_many_examples: "), examples.cast("string"))),
        F.when(blocks > 50, F.concat(F.lit("entry_unusually_large: "), blocks.cast("string"))),
    ))
