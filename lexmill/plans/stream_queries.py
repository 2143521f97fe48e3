"""Queries that run a stream to its end, and bundles built, verified and installed in folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators import bundles, folders, search, stopping
from lexmill.plans import record_queries, report_queries
from lexmill.plans.text_queries import read
from lexmill.sources import lines
from lexmill.streaming import captures

QUERIES: dict = {}
SQL: dict = {}


def stream_capture_states(spark, sf) -> DataFrame:
    """The crawl history of events as a stream: each url's state is its last hash."""
    schema = read(spark, sf, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")
    bad = F.col("event_id") % 9 == 0
    fetches = source.select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.when(~bad, F.sha2("event_type", 256)).alias("sha256"))
    target = folders.scratch(spark)
    query = captures.capture_states(fetches).writeStream.format("parquet").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start(f"{target}/rows")
    query.awaitTermination()
    return spark.read.parquet(f"{target}/rows").select("id", "url", "previous_sha256", "crawl_status")


TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType())])


def _imported(spark, sf) -> str:
    """Turns as JSON lines imported as a stream, the even ones first, then the odd ones as more files: of a conversation the last line stays."""
    target = folders.scratch(spark)
    turns = read(spark, sf, "conversations").withColumn("bucket", F.expr("conv_id div 500"))
    for half in (0, 1):
        some = turns.where(F.col("turn") % 2 == half).repartition("bucket").sortWithinPartitions("bucket", "conv_id", "turn")
        some.select("bucket", F.to_json(F.struct(*TURN.names)).alias("value")).write.partitionBy("bucket").text(f"{target}/in/half={half}")
        source = lines.json_rows(lines.stream_lines(spark, f"{target}/in"), TURN, "path", "byte_start", "byte_length")
        captures.import_rows(source, f"{target}/rows", ["conv_id"], f"{target}/checkpoint", ["path", "byte_start"], progress=f"{target}/progress", size="byte_length").awaitTermination()
    return target


def stream_import(spark, sf) -> DataFrame:
    return captures.latest_rows(spark.read.parquet(f"{_imported(spark, sf)}/rows"), ["conv_id"])


def stream_progress(spark, sf) -> DataFrame:
    return captures.progress_rows(spark.read.parquet(f"{_imported(spark, sf)}/progress"))


def _files_of_lines(spark, sf) -> str:
    """Documents as lines of files of a thousand each, in the order of doc_id, with carriage returns and, before every tenth, a blank line."""
    at = folders.scratch(spark)
    line = F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"sha256":"'), F.sha2(F.coalesce("text", F.lit("")), 256), F.lit('"}'))
    docs = read(spark, sf, "documents").select("doc_id", F.expr("doc_id div 1000").alias("bucket"), F.concat(F.when(F.col("doc_id") % 10 == 3, "  \r\n").otherwise(""), line, F.lit("\r")).alias("value"))
    docs.repartition("bucket").sortWithinPartitions("bucket", "doc_id").select("bucket", "value").write.partitionBy("bucket").text(at)
    return at


DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("sha256", T.StringType())])


def streamed_lines(spark, sf) -> DataFrame:
    at, target = _files_of_lines(spark, sf), folders.scratch(spark)
    rows = lines.json_rows(lines.stream_lines(spark, at, rangebytes=1 << 20), DOC, "byte_start", "byte_length")
    rows.writeStream.format("parquet").option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start(f"{target}/rows").awaitTermination()
    return spark.read.parquet(f"{target}/rows")


def line_numbers(spark, sf) -> DataFrame:
    return lines.json_rows(lines.numbered_lines(spark, _files_of_lines(spark, sf), rangebytes=1 << 20), DOC, "line_no")


def probe_of_some(spark, sf) -> DataFrame:
    """The first hundred lines of each file: how many parse, and how many are blank."""
    found = lines.numbered_lines(spark, _files_of_lines(spark, sf), rangebytes=1 << 20, keepblank="true")
    return bundles.probe(found.withColumn("bucket", F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long")), 100, ["bucket"])


def installed_search(spark, sf) -> DataFrame:
    """A bundle of the records, built, verified and installed; the searches are answered from the active bundle."""
    target = folders.scratch(spark)
    records = record_queries.normalized(spark, sf)
    bundles.build(records, search.posting_blocks(records), f"{target}/bundle", "full", "20260208", sources=["part", "customer"])
    store = bundles.Store(spark, f"{target}/store")
    store.install(f"{target}/bundle")
    blocks = store.table("search_index")
    index = search.whole_postings(blocks).withColumn("ir_ids", F.array_join("ir_ids", ","))
    found = search.ladder_lookup(record_queries.searches(spark, sf), index, keys=blocks.select("key_type", "key").distinct())
    return found.select("query_id", "query", "matched_key_type", "matched_key", "ir_ids")


def bundle_check(spark, sf) -> DataFrame:
    """Faults of bundles against their manifests: a whole one, and one with a file missing, resized, altered and not listed."""
    target = folders.scratch(spark)
    records = record_queries.normalized(spark, sf)
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bundles.build(records.repartition(parts, "ir_id"), search.posting_blocks(records), f"{target}/good", "full", "20260208")
    whole = bundles.verify(spark, f"{target}/good")
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted(x.getPath().toString() for x in system.listStatus(path(f"{target}/good/records")) if x.getPath().getName().endswith(".json"))

    system.delete(path(files[0]), False)
    folders.rewrite(spark, files[1], after=b"\n")
    folders.rewrite(spark, files[2], skip=1, before=b" ")
    stream = system.create(path(f"{target}/good/records/zz.json"), True)
    stream.write(b"{}")
    stream.close()
    damaged = bundles.verify(spark, f"{target}/good")
    return spark.createDataFrame([("whole", x) for x in whole] + [("damaged", x.split(":")[0]) for x in damaged], "bundle string, fault string")


def _store(spark, sf) -> tuple[bundles.Store, str, dict, dict]:
    """An empty store and two bundles of suppliers: those of even numbers, and all."""
    target = folders.scratch(spark)
    k = F.col("s_suppkey")
    rows = read(spark, sf, "supplier").select(k.cast("string").alias("ir_id"), F.lit("lexicon_entry").alias("ir_kind"), F.col("s_name").alias("preferred_form"), k.alias("k"))
    index = rows.select(F.lit("casefold").alias("key_type"), F.lower("preferred_form").alias("key"), F.array("ir_id").alias("ir_ids"), "k")
    seed = bundles.build(rows.where("k % 2 = 0").drop("k"), index.where("k % 2 = 0").drop("k"), f"{target}/seed", "seed", "20260208")
    full = bundles.build(rows.drop("k"), index.drop("k"), f"{target}/full", "full", "20260209", excluded=["b", "a"])
    return bundles.Store(spark, f"{target}/store"), target, seed, full


class _Crash(BaseException):
    """The end of a process, which nothing catches."""


def _crash(store: bundles.Store, folder: str, before: str) -> None:
    """An install that ends before a value is written."""
    put = store._put

    def stop(name, value):
        if name == before and value:
            raise _Crash
        put(name, value)

    store._put = stop
    try:
        store.install(folder)
    except _Crash:
        pass
    finally:
        store._put = put


def store_crashes(spark, sf) -> DataFrame:
    """Installs of a second bundle that end at each step: the state, what recovery does, and the active rows before and after."""
    out = []
    for step in ("session", "registry", "active", "none"):
        store, target, _, _ = _store(spark, sf)
        store.install(f"{target}/seed")
        _crash(store, f"{target}/full", step)
        state, rows = store.status(), store.table("records").count()
        done = store.recover() or ""
        out.append((step, state, rows, done, store.status(), store.table("records").count(), store.table("search_index").count()))
    return spark.createDataFrame(out, "step string, state string, rows_before long, done string, state_after string, rows_after long, index_after long")


def store_steps(spark, sf) -> DataFrame:
    """The store through its operations: after each its status, how many bundles are installed, and the type of the active one."""
    store, target, seed, full = _store(spark, sf)
    out = []

    def say(step: str, result: str = "") -> None:
        rows = store.installed().collect()
        out.append((len(out), step, result, store.status(), len(rows), next((r.bundle_type for r in rows if r.active), None)))

    say("new")
    say("install seed", store.install(f"{target}/seed"))
    say("install seed again", store.install(f"{target}/seed"))
    listed = spark.createDataFrame([(m["bundle_id"], m["content_sha256"], f"{target}/{kind}") for kind, m in (("seed", seed), ("full", full))], "bundle_id string, content_sha256 string, folder string")
    say("install listed full", store.install_listed(listed, full["bundle_id"]))
    say("install listed full again", store.install_listed(listed, full["bundle_id"]))
    try:
        store.install_listed(listed.withColumn("content_sha256", F.lit("sha256:0")), full["bundle_id"])
    except ValueError as e:
        say("install another content", str(e))
    store.activate(seed["bundle_id"])
    say("activate seed")
    store.clear_active()
    say("clear")
    store.activate(full["bundle_id"])
    store.delete(full["bundle_id"])
    say("delete full")
    store.set_note("listed", {"n": 2})
    say("note", str(store.note("listed")["n"]))
    say("upgrade", str(store.upgrade()).lower())
    store.set_note("schema", 1)
    say("upgrade of an old one", str(store.upgrade()).lower())
    return spark.createDataFrame(out, "step_no int, step string, result string, state string, bundles int, active string")


def store_list(spark, sf) -> DataFrame:
    store, target, _, _ = _store(spark, sf)
    for kind in ("seed", "full"):
        store.install(f"{target}/{kind}")
    return store.installed().select("bundle_type", "records", "search_index", "active")


def store_cancel(spark, sf) -> DataFrame:
    """Installs that are cancelled once records or index are staged: the old bundle stays, nothing is left over."""
    store, target, _, _ = _store(spark, sf)
    store.install(f"{target}/seed")
    out = []
    for step in ("records", "index"):
        stop = stopping.Stop(spark)
        try:
            store.install(f"{target}/full", stop, lambda name, rows: stop.cancel() if name.endswith(step) else None)
        except stopping.Stopped:
            out.append((step, store.status(), store.installed().count(), store.table("records").count()))
    return spark.createDataFrame(out, "step string, state string, bundles long, rows long")


QUERIES["stream_capture_states"] = stream_capture_states
SQL["stream_capture_states"] = report_queries.SQL["win_prev_snapshot"]
QUERIES["snk_idb_batch"] = stream_import
SQL["snk_idb_batch"] = "SELECT conv_id, arg_max(turn, (turn % 2, turn)) AS turn, arg_max(role, (turn % 2, turn)) AS role FROM conversations GROUP BY conv_id"
QUERIES["stream_progress"] = stream_progress
SQL["stream_progress"] = """WITH b AS (SELECT turn % 2 AS batch, count(*) AS lines, sum(length('{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}'))::BIGINT AS bytes, count(DISTINCT conv_id) AS rows FROM conversations GROUP BY 1)
SELECT batch, lines, bytes, rows, (sum(lines) OVER w)::BIGINT AS lines_so_far, (sum(bytes) OVER w)::BIGINT AS bytes_so_far, (sum(rows) OVER w)::BIGINT AS rows_so_far FROM b WINDOW w AS (ORDER BY batch)"""
_LINES = """WITH l AS (SELECT doc_id, doc_id // 1000 AS bucket, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 10 = 3 THEN 2 ELSE 1 END AS n, length(doc_id::VARCHAR) + 88 AS byte_length FROM documents),
p AS (SELECT *, sum(n) OVER w AS line_no, sum(byte_length + 1 + 4 * (n - 1)) OVER w - byte_length - 1 AS byte_start FROM l WINDOW w AS (PARTITION BY bucket ORDER BY doc_id))"""
QUERIES["src_jsonl_stream"] = streamed_lines
SQL["src_jsonl_stream"] = f"{_LINES} SELECT doc_id, sha256, byte_start::BIGINT AS byte_start, byte_length FROM p"
QUERIES["win_line_no"] = line_numbers
SQL["win_line_no"] = f"{_LINES} SELECT doc_id, sha256, line_no::BIGINT AS line_no FROM p"
QUERIES["lim_probe"] = probe_of_some
SQL["lim_probe"] = f"""{_LINES}, f AS (SELECT bucket, line_no, 0 AS blank FROM p UNION ALL SELECT bucket, line_no - 1, 1 FROM p WHERE n = 2)
SELECT bucket, count(*) AS lines, count(*) FILTER (blank = 0) AS parsed, 0::BIGINT AS errors, count(*) FILTER (blank = 1) AS blank FROM f WHERE line_no <= 100 GROUP BY bucket"""
QUERIES["txn_install"] = installed_search
SQL["txn_install"] = record_queries.SQL["jn_ladder_lookup"]
QUERIES["val_bundle"] = bundle_check
SQL["val_bundle"] = "SELECT 'damaged' AS bundle, unnest(['missing', 'size_mismatch', 'hash_mismatch', 'unlisted']) AS fault"
_N = "count(*) AS n, count(*) FILTER (s_suppkey % 2 = 0) AS even FROM supplier"
QUERIES["txn_recover"] = store_crashes
SQL["txn_recover"] = f"""WITH c AS (SELECT {_N}) SELECT step, state, CASE WHEN active = 'full' THEN n ELSE even END AS rows_before, done, 'active' AS state_after, CASE WHEN after = 'full' THEN n ELSE even END AS rows_after, CASE WHEN after = 'full' THEN n ELSE even END AS index_after
FROM c, (VALUES ('session', 'active', 'seed', '', 'seed'), ('registry', 'interrupted', 'seed', 'removed', 'seed'), ('active', 'interrupted', 'seed', 'committed', 'full'), ('none', 'active', 'full', '', 'full')) t(step, state, active, done, after)"""
QUERIES["txn_store_steps"] = store_steps
SQL["txn_store_steps"] = """SELECT * FROM (VALUES (0, 'new', '', 'empty', 0, NULL), (1, 'install seed', 'installed', 'active', 1, 'seed'), (2, 'install seed again', 'already_current', 'active', 1, 'seed'), (3, 'install listed full', 'installed', 'active', 2, 'full'),
(4, 'install listed full again', 'already_current', 'active', 2, 'full'), (5, 'install another content', 'the bundle is not the one that the catalogue lists', 'active', 2, 'full'), (6, 'activate seed', '', 'active', 2, 'seed'), (7, 'clear', '', 'installed', 2, NULL),
(8, 'delete full', '', 'installed', 1, NULL), (9, 'note', '2', 'installed', 1, NULL), (10, 'upgrade', 'false', 'installed', 1, NULL), (11, 'upgrade of an old one', 'true', 'empty', 0, NULL)) t(step_no, step, result, state, bundles, active)"""
QUERIES["txn_list"] = store_list
SQL["txn_list"] = f"WITH c AS (SELECT {_N}) SELECT 'full' AS bundle_type, n AS records, (SELECT count(DISTINCT lower(s_name)) FROM supplier) AS search_index, true AS active FROM c UNION ALL SELECT 'seed', even, (SELECT count(DISTINCT lower(s_name)) FROM supplier WHERE s_suppkey % 2 = 0), false FROM c"
QUERIES["txn_cancel"] = store_cancel
SQL["txn_cancel"] = f"WITH c AS (SELECT {_N}) SELECT step, 'active' AS state, 1::BIGINT AS bundles, even AS rows FROM c, (VALUES ('records'), ('index')) t(step)"
