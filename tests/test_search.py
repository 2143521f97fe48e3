import hashlib
import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.operators import bundles, records, search, stopping
from lexmill.sources import lines
from lexmill.streaming import captures

UNITS = "ir_id string, ir_kind string, source_id string, headword string, anchors array<string>, term string"


@pytest.fixture(scope="module")
def normalized(spark):
    rows = [("aaaa", "lexicon_entry", "s", "dɔ́bɛ̀n", ["dɔ́bɛ̀n", "doben"], None), ("cccc", "lexicon_entry", "s", "dòbèn", None, None), ("eeee", "index_mapping", "s", None, None, "abandonner"), ("ffff", "metadata_page", "s", None, None, "x")]
    return records.normalized(spark.createDataFrame(rows, UNITS))


def test_ladder(spark, normalized):
    index = search.inverted_index(normalized)
    queries = spark.createDataFrame(list(enumerate(["DÒBÈN", "dobèn", "aban donner", "xyz", " ", "-DÒBÈN"])), "query_id long, query string")
    got = {r.query_id: (r.matched_key_type, r.ir_ids) for r in search.ladder_lookup(queries, index).collect()}
    assert got == {0: ("casefold", ["cccc"]), 1: ("diacritics_insensitive", ["aaaa", "cccc"]), 2: ("nospace", ["eeee"]), 3: (None, None), 4: (None, None), 5: ("punct_stripped", ["aaaa", "cccc"])}


def test_posting_blocks_hold_the_index(spark):
    """A key of all records is many blocks; together they are the plain index, in order where ids are hashes."""
    units = spark.range(5000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("ir_id"), F.lit("index_mapping").alias("ir_kind"), F.lit("s").alias("source_id"), F.lit(None).cast("string").alias("headword"), F.lit(None).cast("array<string>").alias("anchors"), F.when(F.col("id") % 50 == 0, "rare").otherwise("hot").alias("term"))
    odd = units.limit(300).withColumn("ir_id", F.concat(F.lit("z"), "ir_id"))
    records_ = records.normalized(units.unionByName(odd))
    blocks = search.posting_blocks(records_, 100)
    want = {(r.key_type, r.key): r.ir_ids for r in search.inverted_index(records_).collect()}
    got: dict = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.key_type, r.key, r.block)):
        assert r.ir_ids == sorted(r.ir_ids) and len(r.ir_ids) < 200
        got.setdefault((r.key_type, r.key), []).extend(r.ir_ids)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert [x for x in got["casefold", "hot"] if x[0] != "z"] == [x for x in want["casefold", "hot"] if x[0] != "z"]
    found = search.blocked_lookup(spark.createDataFrame([(1, "H\u00d3T"), (2, "none"), (3, " ")], "query_id int, query string"), blocks).collect()
    assert sorted(x for r in found if r.query_id == 1 for x in r.ir_ids) == want["casefold", "hot"] and {r.matched_key_type for r in found if r.query_id == 1} == {"diacritics_insensitive"}
    assert [(r.block, r.ir_ids) for r in found if r.query_id > 1] == [(None, None)] * 2


def test_resolve_keeps_order_and_drops_missing(spark, normalized):
    m = spark.createDataFrame([(1, ["eeee", "zzzz", "aaaa"])], "query_id long, ir_ids array<string>")
    assert [r.ir_id for r in search.resolved(m, normalized).orderBy("pos").collect()] == ["eeee", "aaaa"]


def test_enrichment_first_wins(spark):
    n = spark.createDataFrame([("a",), ("b",), ("c",)], "ir_id string")
    u = spark.createDataFrame([("a", "two", 1, 0), ("a", "one", 0, 5), ("a", None, 0, 1), (None, "x", 0, 2), ("b", None, 0, 3)], "ir_id string, fields_raw string, file int, line int")
    assert {r.ir_id: r.display for r in records.enriched(n, u, "file", "line").collect()} == {"a": "one", "b": None, "c": None}


def test_bundle_and_store(spark, normalized, tmp_path):
    index = search.inverted_index(normalized)
    m = bundles.build(normalized, index, str(tmp_path / "b1"), "full", "20260208", sources=["s"])
    assert bundles.verify(spark, str(tmp_path / "b1")) == []
    assert m["build"]["record_counts"] == {"lexicon_entry": 2, "index_mapping": 1}
    store = bundles.Store(spark, str(tmp_path / "store"))
    assert store.status() == "empty"
    with pytest.raises(stopping.Stopped, match="deadline"):
        store.install(str(tmp_path / "b1"), stopping.Stop(spark, seconds=0))
    assert store.status() == "empty"
    assert store.installed().count() == 0 and store.install(str(tmp_path / "b1")) == "installed" and store.install(str(tmp_path / "b1")) == "already_current"
    assert store.status() == "active" and store.table("records").count() == 3
    store.delete(m["bundle_id"])
    assert store.status() == "empty"
    victim = next(f for f in (tmp_path / "b1" / "records").glob("*.json") if "cccc" in f.read_text())
    victim.write_text(victim.read_text().replace("cccc", "cccd"))
    next((tmp_path / "b1" / "records").glob(f".{victim.name}.crc")).unlink()
    assert any("hash_mismatch" in x for x in bundles.verify(spark, str(tmp_path / "b1")))
    assert bundles.verify(spark, str(tmp_path / "none")) == ["manifest missing or unreadable"]


def test_later_rows_win_and_bundles_are_replaced(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", i, None) for i in range(50)] + [("b", "x", 0, None)], "ir_id string, ir_kind string, v int, gone string")
    index = spark.createDataFrame([("casefold", "k", ["a"]), ("casefold", "k", ["b"])], "key_type string, key string, ir_ids array<string>")
    for n in (0, 1):
        bundles.build(rows.where(f"v >= {n}").coalesce(1), index.coalesce(1), str(tmp_path / "b"), "full", "20260208", file_rows=7)
    assert not (tmp_path / "b.old").exists() and len(list((tmp_path / "b" / "records").glob("*.json"))) == 7
    store = bundles.Store(spark, str(tmp_path / "store"))
    (tmp_path / "b").rename(tmp_path / "b.old")  # as after a crash between the two renames
    assert store.install(str(tmp_path / "b")) == "installed"
    assert store.table("records").collect() == [("a", "x", 49, None)] and store.table("search_index").first().ir_ids == ["b"]


def test_install_is_interrupted_from_another_thread(spark, tmp_path):
    index = spark.createDataFrame([("casefold", "k", ["a"])], "key_type string, key string, ir_ids array<string>")
    old, new = (spark.range(n).select(F.col("id").cast("string").alias("ir_id"), F.lit("x").alias("ir_kind"), F.lit(n).alias("n")) for n in (10, 400_000))
    bundles.build(old, index, str(tmp_path / "old"), "seed", "20260208")
    bundles.build(new, index, str(tmp_path / "new"), "full", "20260208", file_rows=20_000)
    store = bundles.Store(spark, str(tmp_path / "store"))
    store.install(str(tmp_path / "old"))
    stop = stopping.Stop(spark)

    def later():
        while store.status() != "interrupted":
            time.sleep(0.01)
        while not any(spark.sparkContext.statusTracker().getActiveJobsIds()):
            time.sleep(0.001)
        stop.cancel()

    thread = threading.Thread(target=later)
    thread.start()
    with pytest.raises(stopping.Stopped, match="cancelled"):
        store.install(str(tmp_path / "new"), stop)
    thread.join()
    assert store.status() == "active" and store.installed().count() == 1 and store.table("records").count() == 10
    assert [p.name for p in (tmp_path / "store" / "scopes").iterdir()] == [store.meta(store.installed().first().bundle_id)["scope"]]
    assert store.install(str(tmp_path / "new")) == "installed" and store.table("records").count() == 400_000


def test_deadline_of_a_running_job(spark):
    stop = stopping.Stop(spark, seconds=1.0)
    slow = F.udf(lambda x: time.sleep(0.2) or x, "long")
    with pytest.raises(stopping.Stopped, match="deadline"), stop:
        spark.range(0, 120, 1, 4).select(slow("id")).write.format("noop").mode("overwrite").save()
    assert spark.range(3).count() == 3
    with pytest.raises(stopping.Stopped), stop:
        pass


def test_file_digests(spark, tmp_path):
    """A file of more than 2 GB is hashed in pieces; one that is not as long as listed is not hashed."""
    big = tmp_path / "big"
    with open(big, "wb") as f:
        f.truncate((2 << 30) + 5)  # sparse
    (tmp_path / "small").write_bytes(b"abc")
    files = [("big", str(big), None), ("small", f"file:{tmp_path}/small", 3), ("longer", str(tmp_path / "small"), 2), ("none", str(tmp_path / "x"), 1)]
    got = {r.path: (r.byte_length, r.sha256) for r in bundles.file_digests(spark.createDataFrame(files, "path string, at string, listed long")).collect()}
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        digest.update(zeros)
    digest.update(bytes(5))
    assert got == {"big": ((2 << 30) + 5, digest.hexdigest()), "small": (3, hashlib.sha256(b"abc").hexdigest()), "longer": (3, None)}


def test_import_keeps_the_last_line_of_each_key(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])

    def run(name, rows):
        (source / name).write_text("".join(json.dumps({"k": k, "v": v}) + "\n" for k, v in rows))
        stream = lines.json_rows(lines.stream_lines(spark, str(source), rangebytes=40), schema, "path", "byte_start", "byte_length")
        captures.import_rows(stream, str(tmp_path / "rows"), ["k"], str(tmp_path / "check"), ["path", "byte_start"], 3, str(tmp_path / "progress"), "byte_length").awaitTermination()
        return {r.k: r.v for r in captures.latest_rows(spark.read.parquet(str(tmp_path / "rows")), ["k"]).collect()}

    assert run("a", [("a", i) for i in range(50)] + [("b", 7), (None, 1)]) == {"a": 49, "b": 7, None: 1}
    assert run("b", [("b", None), ("c", 3), ("c", 2)]) == {"a": 49, "b": None, "c": 2, None: 1}
    progress = [tuple(r) for r in captures.progress_rows(spark.read.parquet(str(tmp_path / "progress"))).orderBy("batch").select("lines", "rows", "lines_so_far", "rows_so_far", "bytes_so_far").collect()]
    assert [p[:4] for p in progress] == [(52, 3, 52, 3), (3, 2, 55, 5)]
    assert progress[1][4] == sum(len(line) for f in source.iterdir() for line in f.read_bytes().splitlines())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_levels_need_no_ids(spark, normalized):
    """Which level matches is told by keys alone; ids and records are joined to it once, last."""
    queries = spark.createDataFrame(list(enumerate(["DÒBÈN", "dobèn", "aban donner", "xyz", " ", "-DÒBÈN", "dobèn"])), "query_id long, query string")
    index, records_ = search.inverted_index(normalized), normalized.select("ir_id", "preferred_form").where("ir_id <> 'cccc'")
    level = search.ladder_level(queries, search.known_keys(normalized))
    assert "collect_list" not in _plan(level)
    looked = search.ladder_lookup(queries, index)
    assert sorted(level.collect()) == sorted(looked.drop("ir_ids").collect())
    # the minimum of the probes carries no ids
    assert not [x for x in _plan(looked).splitlines() if "Aggregate" in x and "min(" in x and "ir_ids" in x]
    want = search.resolved(looked, records_).select("query_id", "pos", "ir_id", "preferred_form").collect()
    assert sorted(search.resolved_lookup(level, index, records_).select("query_id", "pos", "ir_id", "preferred_form").collect()) == sorted(want) and len(want) == 4
    scoped = search.ladder_level(queries.withColumn("scope", F.when(F.col("query_id") < 2, "a").otherwise("b")), search.known_keys(normalized).withColumn("scope", F.lit("a")), ["scope"])
    assert {r.query_id for r in scoped.collect() if r.matched_key} == {0, 1}


def test_searches_of_scope_and_first_level_gather_no_ids(spark):
    from lexmill.plans import record_queries

    for name in ("win_ladder_first", "flt_bundle_scope"):
        assert "collect_list" not in _plan(record_queries.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_extents_are_those_of_the_index_without_lists(spark, normalized):
    found = search.key_extents(normalized)
    assert "collect_list" not in _plan(found)
    want = [(r.key_type, r.key, len(r.ir_ids), r.ir_ids[0], r.ir_ids[-1]) for r in search.inverted_index(normalized).collect()]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted(search.whole_postings(search.posting_blocks(normalized, 1)).collect()) == sorted(search.inverted_index(normalized).collect())


def test_keys_are_dealt_over_tasks(spark):
    """A small file is read in one task; the many keys of its rows are made in as many as there are shuffle partitions."""
    from lexmill.plans import record_queries

    assert record_queries.units(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_index_lines_over_the_limit_are_blocks(spark, tmp_path):
    """A key of so many ids that its line would be over the limit of a line is installed in blocks."""
    ids = spark.range(260_000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("ir_id"), F.lit("index_mapping").alias("ir_kind"), F.struct(*[F.array(F.lit("hot")).alias(k) for k in search.LADDER]).alias("search_keys"))
    small = ids.limit(1).drop("search_keys")
    bundles.build(small, search.posting_blocks(ids).where("key_type = 'casefold'"), str(tmp_path / "b"), "full", "20260208")
    store = bundles.Store(spark, str(tmp_path / "s"))
    assert store.install(str(tmp_path / "b")) == "installed"
    assert [(r.key, r.n) for r in search.whole_postings(store.table("search_index")).select("key", F.size("ir_ids").alias("n")).collect()] == [("hot", 260_000)]


def test_files_are_rewritten_in_pieces(spark, tmp_path):
    from lexmill.operators import folders

    at = tmp_path / "x.json"
    at.write_bytes(b"a" * 200_001)
    folders.rewrite(spark, str(at), skip=1, before=b" ", after=b"\n")
    assert at.read_bytes() == b" " + b"a" * 200_000 + b"\n"


def test_ids_are_listed_whole_and_ascending(spark):
    """srt_ids sorts the ids of each key and gives all of them, not its ends alone."""
    from lexmill.plans import record_queries

    at = "/root/testdata/sf0.001"
    found = record_queries.QUERIES["srt_ids"](spark, at)
    assert "array_sort" in _plan(found) or "sort_array" in _plan(found)
    rows = found.collect()
    own = {(r.key_type, r.key): sorted({x.ir_id for x in r.ids}) for r in search.key_rows(record_queries.normalized(spark, at)).groupBy("key_type", "key").agg(F.collect_list(F.struct("ir_id")).alias("ids")).collect()}
    assert {(r.key_type, r.key): r.ir_ids.split(",") for r in rows} == own and max(map(len, own.values())) > 10
    assert all((r.first, r.last) == (own[r.key_type, r.key][0], own[r.key_type, r.key][-1]) for r in rows)


def _written(df, at) -> int:
    df.write.parquet(str(at))
    return sum(x.stat().st_size for x in at.rglob("*.parquet"))


def test_lists_that_many_queries_find_are_written_once(spark, tmp_path):
    """Forty keys of 100 kB of ids and thirty queries each: a file of the matches holds each key's list once or a few times, not with every query."""
    ids = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1600)), lambda j: F.sha2(F.concat(F.col("id").cast("string"), j.cast("string")), 256)), ",")
    index = spark.range(40).select(F.when(F.col("id") % 2 == 0, "casefold").otherwise("nospace").alias("key_type"), F.concat(F.lit("k"), "id").alias("key"), ids.alias("ir_ids"))
    queries = spark.range(1200).select(F.col("id").alias("query_id"), F.concat(F.lit("k"), F.col("id") % 40).alias("query"))
    found = search.ladder_lookup(queries, index)
    assert found.where("ir_ids IS NOT NULL").count() == 1200
    size = _written(found, tmp_path / "x")
    assert size < 20_000_000, size


def test_records_of_many_queries_are_side_by_side(spark, tmp_path):
    """1500 queries of each of two keys of 1500 records: the rows of a block of queries follow one another, a record's side by side, so files of them are short."""
    name = F.concat(F.lit("r"), F.sha2(F.col("id").cast("string"), 256)).alias("ir_id")
    records_ = spark.range(1500).select(name, F.lit("f").alias("preferred_form"))
    kind = F.when(F.col("id") % 2 == 0, "casefold").otherwise("nospace")
    index = records_.agg(F.array_sort(F.collect_list("ir_id")).alias("ir_ids")).crossJoin(spark.range(2)).select(kind.alias("key_type"), F.concat(F.lit("k"), F.col("id") % 2).alias("key"), "ir_ids")
    level = spark.range(3000).select(F.col("id").alias("query_id"), kind.alias("matched_key_type"), F.concat(F.lit("k"), F.col("id") % 2).alias("matched_key"))
    found = search.resolved_lookup(level, index, records_)
    rows = found.groupBy("query_id").agg(F.count_distinct("pos").alias("n"), F.max("pos").alias("last")).select("n", "last").distinct().collect()
    assert [tuple(r) for r in rows] == [(1500, 1499)] and found.count() == 3000 * 1500
    size = _written(found, tmp_path / "x")
    assert size < 3_500_000, size
