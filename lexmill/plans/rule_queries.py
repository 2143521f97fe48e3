"""Corrections, tags, exclusion, validators, sources and sinks over stand-ins."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import canonical
from lexmill.operators import folders, patches, provenance, rules
from lexmill.plans.text_queries import read
from lexmill.sources import jsonl

QUERIES: dict = {}
SQL: dict = {}


def corrected(spark, sf) -> DataFrame:
    """Customers as records; suppliers as patches of the customer of their number."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("ir_id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("fields"))
    k = F.col("s_suppkey")
    p = read(spark, sf, "supplier").select(k.cast("string").alias("ir_id"), F.lit("p1").alias("patch_id"), F.when(k % 4 == 0, "replace").when(k % 4 == 1, "remove").when(k % 4 == 2, "test").otherwise("add").alias("op"), F.when(k % 8 == 4, "none").when(k % 4 == 3, "note").otherwise("name").alias("path"), F.col("s_name").alias("value"), (k % 5 > 0).alias("approved"))
    out = rules.corrected(c, p)
    return out.select("ir_id", *[F.element_at("fields", n).alias(n) for n in ("name", "note", "segment")], "patch_error")


QUERIES["opt_corrections"] = corrected
SQL["opt_corrections"] = """SELECT c_custkey::VARCHAR AS ir_id, CASE WHEN ok AND s_suppkey % 8 = 0 THEN s_name WHEN ok AND s_suppkey % 4 = 1 THEN NULL ELSE c_name END AS name, CASE WHEN ok AND s_suppkey % 4 = 3 THEN s_name END AS note, c_mktsegment AS segment,
  CASE WHEN ok AND (s_suppkey % 8 = 4 OR (s_suppkey % 4 = 2 AND s_name <> c_name)) THEN 'p1' END AS patch_error
FROM (SELECT *, s_suppkey IS NOT NULL AND s_suppkey % 5 > 0 AS ok FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)"""


def patched_documents(spark, sf) -> DataFrame:
    """Documents as nested records; labels as corrections of them, of several operations each."""
    c = read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("ir_id"), F.to_json(F.struct(F.col("source").alias("name"), F.array(F.struct(F.col("lang").alias("gloss")), F.struct(F.lit("b").alias("gloss"))).alias("senses"), F.struct(F.col("n_chars").alias("size")).alias("meta")), {"ignoreNullFields": "false"}).alias("document"))
    k, op = F.col("doc_id"), lambda *x: F.struct(*[F.lit(v).cast(t).alias(n) if not hasattr(v, "alias") else v.alias(n) for v, (n, t) in zip(x, (("op", "string"), ("path", "string"), ("from", "string"), ("value", "string")))])
    ops = F.when(k % 4 == 0, F.array(op("move", "/senses/0/name", "/name", None), op("add", "/senses/1", None, F.to_json(F.struct(F.col("quality").alias("gloss")))))).when(k % 4 == 1, F.array(op("remove", "/senses/0", None, None), op("test", "/senses/0/gloss", None, '"b"'), op("copy", "/senses/-", "/meta", None)))
    ops = ops.when(k % 4 == 2, F.array(op("replace", "/meta/size", None, k.cast("string")), op("remove", "/none", None, None))).otherwise(F.array(op("test", "/senses/0/gloss", None, '"en"'), op("replace", "/senses", None, "[]")))
    p = read(spark, sf, "labels").select(k.cast("string").alias("ir_id"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("patch_id"), F.posexplode(ops).alias("seq", "o"), (k % 5 > 0).alias("approved")).select("ir_id", "patch_id", "seq", "o.*", "approved")
    return patches.patched(c, p)


QUERIES["opt_json_patch"] = patched_documents
SQL["opt_json_patch"] = """WITH j AS (SELECT d.*, quality, l.doc_id IS NOT NULL AND l.doc_id % 5 > 0 AS ok, l.doc_id % 4 AS m, coalesce('"' || lang || '"', 'null') AS g FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
t AS (SELECT *, '"meta":{"size":' || n_chars || '}' AS meta, '"name":' || coalesce('"' || source || '"', 'null') AS name, ok AND (m = 2 OR m = 3 AND g <> '"en"') AS failed FROM j)
SELECT doc_id::VARCHAR AS ir_id, CASE WHEN NOT ok OR failed THEN '{' || name || ',"senses":[{"gloss":' || g || '},{"gloss":"b"}],' || meta || '}' WHEN m = 0 THEN '{' || meta || ',"senses":[{"gloss":' || g || ',' || name || '},{"gloss":' || quality || '},{"gloss":"b"}]}'
  WHEN m = 1 THEN '{' || meta || ',' || name || ',"senses":[{"gloss":"b"},{"size":' || n_chars || '}]}' ELSE '{' || meta || ',' || name || ',"senses":[]}' END AS document, CASE WHEN failed THEN 'p' || doc_id % 3 END AS patch_error FROM t"""


def fragments(spark, sf) -> DataFrame:
    """Documents as places on scanned pages: the hash of each one's locator, and of the first bytes of its text."""
    k, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    pointer = F.struct(F.col("source").alias("source_id"), F.md5(text).alias("snapshot_id"), F.col("n_chars").alias("page_number"), F.when(k % 4 > 0, k % 4 * 90).alias("rotation_degrees"), F.array(F.col("n_chars") / 8.0, (k % 1000) / 64.0, F.lit(1.0), F.lit(1e21) * (k + 1)).cast("array<double>").alias("bbox"), F.when(k % 3 > 0, F.concat("lang", F.lit('\t"\u0001\\'))).alias("pdf_text_quote"))
    docs = read(spark, sf, "documents").select("doc_id", pointer.alias("pointer"), F.encode(text, "UTF-8").alias("content"))
    return docs.select("doc_id", canonical.locator_hash(F.col("pointer"), docs.schema["pointer"].dataType).alias("locator_hash"), canonical.span_hash(F.col("content"), F.lit(0), F.octet_length("content")).alias("span_hash"))


QUERIES["fn_fragment_hash"] = fragments
SQL["fn_fragment_hash"] = r"""SELECT doc_id, 'sha256:' || sha256('{"bbox":[' || regexp_replace((n_chars / 8.0::DOUBLE)::VARCHAR, '\.0$', '') || ',' || regexp_replace((doc_id % 1000 / 64.0::DOUBLE)::VARCHAR, '\.0$', '') || ',1,' || rtrim(rtrim(((doc_id + 1) / 10 ** (length((doc_id + 1)::VARCHAR) - 1))::DECIMAL(18, 12)::VARCHAR, '0'), '.') || 'e+' || (20 + length((doc_id + 1)::VARCHAR)) || '],"fragment_representation_kind":"locator_jcs_v1","page_number":' || n_chars
  || CASE WHEN doc_id % 3 > 0 AND lang IS NOT NULL THEN ',"pdf_text_quote":"' || lang || '\t\"\u0001\\"' ELSE '' END || CASE WHEN doc_id % 4 > 0 THEN ',"rotation_degrees":' || doc_id % 4 * 90 ELSE '' END || ',"snapshot_id":"' || md5(coalesce(text, '')) || '"' || coalesce(',"source_id":"' || source || '"', '') || '}') AS locator_hash,
  'sha256:' || sha256(coalesce(text, '')) AS span_hash FROM documents"""


def derivations(spark, sf) -> DataFrame:
    """Documents derived from the first of their ten, those from the first of their hundred, those from their source, some from each other: the nearest licence and all sources."""
    docs, k = read(spark, sf, "documents").select("doc_id", "source", "lang"), F.col("doc_id")
    named = lambda c: F.concat(F.lit("d"), c.cast("string"))
    source = F.concat(F.lit("s"), "source")
    records = docs.select(named(k).alias("id"), F.when(k % 3 == 0, F.col("lang")).alias("license"), F.when(k % 4 == 0, F.col("source")).alias("source_id"))
    records = records.unionByName(docs.select("source").distinct().select(source.alias("id"), F.concat(F.lit("lic-"), "source").alias("license"), F.col("source").alias("source_id")))
    edges = docs.select(named(k).alias("id"), F.when(k % 10 > 0, named(k - k % 10)).when(k % 100 > 0, named(k - k % 100)).otherwise(source).alias("input"))
    edges = edges.unionByName(docs.where("doc_id % 100 IN (1, 2)").select(named(k).alias("id"), named(k - k % 100 * 2 + 3).alias("input")))
    return provenance.with_provenance(records, edges, ["license"]).select("id", "license.value", "license.origin", "license.steps", F.array_join("sources", ",").alias("sources"), "cyclic")


QUERIES["jn_derivation"] = derivations
SQL["jn_derivation"] = """WITH RECURSIVE r AS (SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN lang END AS license, CASE WHEN doc_id % 4 = 0 THEN source END AS source_id FROM documents
  UNION ALL SELECT DISTINCT 's' || source, 'lic-' || source, source FROM documents WHERE source IS NOT NULL),
e AS (SELECT x.id, input FROM (SELECT 'd' || doc_id AS id, CASE WHEN doc_id % 10 > 0 THEN 'd' || (doc_id - doc_id % 10) WHEN doc_id % 100 > 0 THEN 'd' || (doc_id - doc_id % 100) ELSE 's' || source END AS input FROM documents
  UNION SELECT 'd' || doc_id, 'd' || (doc_id - doc_id % 100 * 2 + 3) FROM documents WHERE doc_id % 100 IN (1, 2)) x JOIN r ON r.id = input),
w(id, up, steps) AS (SELECT id, id, 0 FROM r UNION SELECT w.id, e.input, steps + 1 FROM w JOIN e ON e.id = w.up WHERE steps < 6),
n AS (SELECT w.id, arg_min(license, (steps, up)) AS value, arg_min(up, (steps, up)) AS origin, min(steps) AS steps FROM w JOIN r ON r.id = w.up WHERE license IS NOT NULL GROUP BY w.id),
s AS (SELECT w.id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS sources FROM w JOIN r ON r.id = w.up WHERE source_id IS NOT NULL GROUP BY w.id),
y AS (SELECT DISTINCT id FROM w WHERE id = up AND steps > 0)
SELECT r.id, n.value, n.origin, n.steps, coalesce(sources, '') AS sources, y.id IS NOT NULL AS cyclic FROM r LEFT JOIN n USING (id) LEFT JOIN s USING (id) LEFT JOIN y USING (id)"""


def _raw():
    return F.when(F.col("p_size") % 7 > 0, F.element_at(F.array(*[F.lit(x) for x in ("n", "V", "adj", " pp ", "conj", "n.prop")]), F.col("p_size") % 6 + 1))


QUERIES["opt_posmap"] = lambda s, d: read(s, d, "part").select("p_partkey", *[c.alias(n) for c, n in zip(rules.pos_tag(_raw()), ("pos", "pos_uncertain"))])
SQL["opt_posmap"] = "SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN ['NOUN', 'VERB', 'OTHER', 'ADP', 'PART', 'NOUN'][p_size % 6 + 1] END AS pos, CASE WHEN p_size % 7 > 0 THEN p_size % 6 = 2 END AS pos_uncertain FROM part"
QUERIES["opt_excluded_sources"] = lambda s, d: rules.without_sources(read(s, d, "documents").select("doc_id", F.col("source").alias("source_id")), read(s, d, "documents").where("source IN ('src1', 'src2')").select(F.col("source").alias("source_id")))
SQL["opt_excluded_sources"] = "SELECT doc_id, source AS source_id FROM documents WHERE source NOT IN ('src1', 'src2')"
QUERIES["opt_seed_bundle"] = lambda s, d: rules.seed(read(s, d, "part").select(F.col("p_partkey").alias("ir_id"), "p_retailprice"), 100, F.desc("p_retailprice"))
SQL["opt_seed_bundle"] = "SELECT p_partkey AS ir_id, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 100"


def manifests(spark, sf) -> DataFrame:
    k = F.col("p_partkey")
    file = F.array(F.struct(F.when(k % 7 > 0, F.col("p_name")).alias("path"), (F.col("p_size") - F.when(k % 11 == 0, 1000).otherwise(0)).alias("byte_length")))
    doc = F.to_json(F.struct(F.when(k % 5 > 0, "1").otherwise("2").alias("manifest_schema_version"), F.when(k % 3 > 0, F.col("p_name")).alias("bundle_id"), F.when(k % 4 == 0, "delta").otherwise("full").alias("bundle_type"), F.lit("records_v1").alias("record_schema_id"), file.alias("files"), F.lit("x").alias("content_sha256")))
    return read(spark, sf, "part").select("p_partkey", F.when(k % 13 == 0, F.concat(F.lit("{"), doc)).otherwise(doc).alias("json"))


QUERIES["val_manifest"] = lambda s, d: manifests(s, d).select("p_partkey", F.array_join(rules.manifest_errors(F.col("json")), ",").alias("errors"))
SQL["val_manifest"] = """SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'not_json' ELSE concat_ws(',', CASE WHEN p_partkey % 3 = 0 THEN 'missing_bundle_id' END, CASE WHEN p_partkey % 5 = 0 THEN 'unsupported_manifest_schema_version' END,
  CASE WHEN p_partkey % 7 = 0 OR p_partkey % 11 = 0 THEN 'bad_file' END, CASE WHEN p_partkey % 4 = 0 THEN 'delta_not_supported' END) END AS errors FROM part"""
QUERIES["val_catalog"] = lambda s, d: rules.catalog_errors(read(s, d, "part").select((F.col("p_partkey") % 1500).alias("bundle_id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).otherwise(" ").alias("name"), (F.col("p_size") - F.when(F.col("p_partkey") % 5 == 0, 1000).otherwise(0)).alias("size_bytes"), F.when(F.col("p_partkey") % 7 > 0, "https://h/b/").otherwise("https://h/b").alias("url_base"), F.when(F.col("p_partkey") % 11 > 0, "x").alias("content_sha256")))
SQL["val_catalog"] = """SELECT p_partkey % 1500 AS bundle_id, unnest(list_filter([CASE WHEN p_partkey % 3 = 0 THEN 'name_missing' END, CASE WHEN p_partkey % 5 = 0 THEN 'size_invalid' END, CASE WHEN p_partkey % 7 = 0 THEN 'url_base_not_a_directory' END, CASE WHEN p_partkey % 11 = 0 THEN 'content_sha256_missing' END], lambda x: x IS NOT NULL)) AS error FROM part
UNION ALL SELECT p_partkey % 1500, 'duplicate_id' FROM part GROUP BY 1 HAVING count(*) > 1"""


def details(spark, sf) -> DataFrame:
    sense = F.struct(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")).alias("sense_num"), F.col("l_returnflag").alias("gloss_fr"), F.when(F.col("l_linestatus") == "O", "open").alias("gloss_en"), F.lit(None).cast("string").alias("gloss_ru"), F.lit(None).cast("array<string>").alias("examples"))
    order = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", sense.alias("s"))))
    return rules.entry_details(read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.transform(order, lambda x: x.s).alias("senses")))


QUERIES["prj_entry_detail"] = details
SQL["prj_entry_detail"] = """WITH r AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) - 1)::INT AS place FROM lineitem)
SELECT l_orderkey AS entry_id, place, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END, place + 1)::INT AS number, concat_ws(' / ', l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'open' END) AS glosses, 0 AS examples FROM r"""
QUERIES["prj_type_guard"] = lambda s, d: read(s, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("is_lexicon"), F.coalesce(F.col("o_orderstatus") == "O", F.lit(False)).alias("is_index"))
SQL["prj_type_guard"] = "SELECT o_orderkey, o_orderstatus = 'F' AS is_lexicon, coalesce(o_orderstatus = 'O', false) AS is_index FROM orders"


@F.pandas_udf(T.StringType())
def resolved_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link against the URL of its page."""
    return pd.Series([None if b is None or x is None else urljoin(b, x) for b, x in zip(base, link)])


QUERIES["fn_resolve_url"] = lambda s, d: read(s, d, "nation").select("n_nationkey", resolved_url(F.concat(F.lit("https://h/emk/index/"), F.col("n_nationkey").cast("string"), F.lit(".htm")), F.concat(F.lit("../lexicon/"), F.col("n_regionkey").cast("string"), F.lit(".htm"))).alias("url"))
SQL["fn_resolve_url"] = "SELECT n_nationkey, 'https://h/emk/lexicon/' || n_regionkey || '.htm' AS url FROM nation"


# sources and sinks: written to a new folder and read back
def tolerant(spark, sf) -> DataFrame:
    """Properties of events as JSON lines, some broken or blank: rows and bad lines of the file."""
    at = folders.scratch(spark)
    line = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("{"), "props")).when(F.col("event_id") % 10 == 1, "  ").otherwise(F.to_json(F.struct("event_id", "event_type")))
    read(spark, sf, "events").select(line.alias("value")).write.text(at)
    rows, bad = jsonl.tolerant(spark, at, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType())]))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).unionByName(bad.agg(F.lit("bad").alias("event_type"), F.count("*").alias("n"), F.lit(None).cast("long").alias("ids")))


QUERIES["src_jsonl_tolerant"] = tolerant
SQL["src_jsonl_tolerant"] = "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_id % 10 > 1 GROUP BY 1 UNION ALL SELECT 'bad', count(*), NULL FROM events WHERE event_id % 10 = 0"


def strict(spark, sf) -> DataFrame:
    at = folders.scratch(spark)
    read(spark, sf, "part").select(F.to_json(F.struct(F.col("p_partkey").alias("ir_id"), "p_name")).alias("value")).write.text(at)
    return jsonl.strict(spark.read.text(at), T.StructType([T.StructField("ir_id", T.LongType()), T.StructField("p_name", T.StringType())]), F.col("ir_id").isNotNull())


QUERIES["src_jsonl_strict"] = strict
SQL["src_jsonl_strict"] = "SELECT p_partkey AS ir_id, p_name FROM part"


def url_list(spark, sf) -> DataFrame:
    at = folders.scratch(spark)
    read(spark, sf, "pages").select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("# "), "url")).when(F.col("page_id") % 5 == 1, "").otherwise(F.concat(F.lit("  "), "url")).alias("value")).write.text(at)
    return jsonl.url_list(spark.read.text(at))


QUERIES["src_url_list"] = url_list
SQL["src_url_list"] = "SELECT url FROM pages WHERE page_id % 5 > 1"
QUERIES["src_zstd_payload"] = lambda s, d: read(s, d, "pages").select("page_id", F.sha2(jsonl.unzstd(jsonl.zstd(F.col("html").cast("binary"))), 256).alias("sha256"))
SQL["src_zstd_payload"] = "SELECT page_id, sha256(html) AS sha256 FROM pages"
QUERIES["src_snapshot_meta"] = lambda s, d: jsonl.snapshot_meta(read(s, d, "events").select(F.when(F.col("user_id") % 10 > 0, F.col("user_id")).alias("snapshot_id"), F.col("event_id").alias("line_no"), "event_type"))
SQL["src_snapshot_meta"] = "SELECT user_id AS snapshot_id, max(event_id) AS line_no, arg_max(event_type, event_id) AS event_type FROM events WHERE user_id % 10 > 0 GROUP BY 1"


def checksums(spark, sf) -> DataFrame:
    at = folders.scratch(spark)
    read(spark, sf, "documents").select(F.concat_ws("  ", F.sha2("text", 256), F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))).alias("value")).write.text(at)
    return spark.read.text(at).select(F.substring_index("value", "  ", -1).alias("path"), F.substring_index("value", "  ", 1).alias("sha256"))


QUERIES["snk_checksums"] = checksums
SQL["snk_checksums"] = "SELECT 'docs/' || doc_id AS path, sha256(text) AS sha256 FROM documents"


def rewritten(spark, sf) -> DataFrame:
    """Documents written as JSON lines over older ones, non-ASCII kept, then more appended."""
    at, docs = folders.scratch(spark), read(spark, sf, "documents").select("doc_id", "text")
    docs.where("doc_id < 0").write.json(at)
    docs.where("doc_id % 2 = 0").write.mode("overwrite").json(at)
    docs.where("doc_id % 2 = 1").write.mode("append").json(at)
    return spark.read.schema(docs.schema).json(at).select("doc_id", F.md5("text").alias("digest"))


QUERIES["snk_jsonl_overwrite"] = rewritten
SQL["snk_jsonl_overwrite"] = "SELECT doc_id, md5(text) AS digest FROM documents"
