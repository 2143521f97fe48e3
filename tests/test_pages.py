from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.sources import jsonl, pages

PAGE = """<html><body><a name="old"></a> text
<a name="dɔ́bɛ̀n"></a> <!-- c --> <a name="doben"></a>
<p class="lxP"><span class="Lxe" id="e1">dɔ́bɛ̀n</span><span class="GlNko">ߞ</span> <span class="PS">n</span><b class="clnknt"><a>12 x</a></b><span class="Mnhvam"><a class="MXRef">v1</a><a class="MXRef">v1</a></span></p>
<p class="lxP2"><span class="PS">n</span></p>
<p class="lxP2"><span class="SnsN">1)</span><div class="GlFr">un</div><div class="GlEn">one</div><span class="Exe">ex</span><div class="GlFr">exfr</div></p>
<p class="lxP2"><span class="SnsN">→</span><span class="MXRef">sub</span><div class="GlFr">sfr</div></p>
<p class="lxP2"><span class="SnsN">2)</span><div class="GlRu">ru</div></p>
<p class="lxP">no entry</p>
<p class="lxP"><span class="Lxe" id="e2">last</span></p></body></html>"""
INDEX = """<div id="basfr"><table><tr><td>one cell</td></tr><tr><td><span class="IxFr">kaki</span></td><td><a class="IxBm" href="../lexicon/b.htm#e1">A</a><a class="IvBm" href="../lexicon/b.htm#e1">B</a><a class="IeBm" href="x.htm">C</a></td></tr>
<tr><td></td><td></td></tr></table></div>"""


def test_lexicon_page(spark):
    df = spark.createDataFrame([("https://h/lexicon/b.htm", PAGE.encode() + b"\xff"), ("https://h/none", None)], "url string, html binary")
    one, two = pages.lexicon(df).orderBy("pos").collect()
    assert one.anchors == ["dɔ́bɛ̀n", "doben"] and one.pos_hint == "n" and one.corpus_count == 12 and one.variants == ["v1"] and one.end_selector == "e2" and two.end_selector is None
    assert [s.sense_num for s in one.senses] == [1, 2] and one.senses[0].gloss_fr == "un" and one.senses[0].sub_entries[0].text == "sub" and one.senses[0].examples[0].trans_fr == "exfr"
    assert two.senses == [] and len(one.ir_id) == 16


def test_index_page_and_targets(spark):
    mapped = pages.mappings(spark.createDataFrame([("https://h/index/k.htm", INDEX)], "url string, html string"))
    row = mapped.first()
    assert row.entry_index == 1 and row.term == "kaki" and len(row.targets) == 1 and row.targets[0].display_text == "A" and row.warnings == ["unparseable_href: x.htm"]
    entries = pages.lexicon(spark.createDataFrame([("https://h/lexicon/b.htm", PAGE)], "url string, html string"))
    assert pages.resolved_targets(mapped, entries).first().target is not None


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n  \nnot json\n{"a": 2}\n')
    rows, bad = jsonl.tolerant(spark, str(tmp_path / "a.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r.a for r in rows.collect()) == [1, 2] and [r.line for r in bad.collect()] == ["not json"]
    lines = spark.createDataFrame([("https://a ",), ("# c",), ("",)], "value string")
    assert [r.url for r in jsonl.url_list(lines).collect()] == ["https://a"]


def test_payload_round_trip(spark, tmp_path):
    packed = spark.createDataFrame([(b"<p>x",)], "c binary").select(jsonl.zstd("c")).first()[0]
    (tmp_path / "s1.html.zst").write_bytes(bytes(packed))
    row = jsonl.payloads(spark, str(tmp_path)).first()
    assert (row.snapshot_id, bytes(row.html)) == ("s1", b"<p>x")


def test_strict_lines_stop(spark):
    import pytest

    with pytest.raises(Exception, match="line over the limit"):
        jsonl.strict_lines(spark.createDataFrame([("x" * 20,)], "value string"), 10).collect()
    schema = T.StructType([T.StructField("ir_id", T.StringType())])
    with pytest.raises(Exception, match="required"):
        jsonl.strict(spark.createDataFrame([('{"x": 1}',)], "value string"), schema, F.col("ir_id") != "").collect()


def test_deep_pages(spark):
    deep = "<div>" * 5000 + PAGE
    rows = pages.lexicon(spark.createDataFrame([("https://h/lexicon/b.htm", deep)], "url string, html string")).collect()
    assert {r.entry_id for r in rows} == {"e1", "e2"}
    root = pages.Tree("<a><b x='1'>t&amp;</b><br><!-- c -->u</a>").root
    assert root.first("a").html() == '<a><b x="1">t&amp;</b><br/>u</a>' and root.text() == "t&u"


def test_payloads_stay(spark, tmp_path):
    for html in (b"<p>one", b"<p>two"):
        jsonl.write_payloads(spark.createDataFrame([("s1", html), ("s2", None)], "snapshot_id string, html binary"), str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p")).select("snapshot_id", jsonl.unzstd("payload").alias("html")).collect()
    assert {r.snapshot_id: bytes(r.html) if r.html else None for r in rows} == {"s1": b"<p>one", "s2": None}


def test_units_name_their_evidence(spark):
    entries = pages.lexicon(spark.createDataFrame([("https://h/lexicon/b.htm", PAGE)], "url string, html string"))
    mapped = pages.mappings(spark.createDataFrame([("https://h/index/k.htm", INDEX)], "url string, html string"))
    snapshots = spark.createDataFrame([("https://h/lexicon/b.htm", "s1")], "url string, snapshot_id string")
    got = {r.ir_id: r for r in pages.units(entries, mapped, snapshots, "src").collect()}
    one = next(r for r in got.values() if r.record_locator.source_record_id == "e1")
    assert one.evidence[0].asDict() == {"source_id": "src", "snapshot_id": "s1", "start_selector": "span#e1", "end_selector": "span#e2", "css_selector": None, "text_quote": "dɔ́bɛ̀n", "raw_block_hash": entries.orderBy("pos").first().block_hash}
    assert one.record_locator.kind == "source_record_id" and one.record_locator.anchor_names == ["dɔ́bɛ̀n", "doben"]
    row = next(r for r in got.values() if r.ir_kind == "index_mapping")
    assert row.evidence[0].css_selector == "tr:nth-child(2)" and row.evidence[0].text_quote == "kaki" and row.evidence[0].snapshot_id is None and row.record_locator.entry_index == 1
    assert pages.units(entries, None, snapshots).count() == 2 and pages.units(None, mapped, snapshots).count() == 1


def test_example_attribution(spark):
    cell = lambda text: f'<span class="Exe">{text}</span><div class="GlFr">t</div>'
    html = f'<p class="lxP"><span class="Lxe" id="e1">x</span></p><p class="lxP2"><span class="SnsN">1)</span>{cell("a [Author] b")}{cell("plain")}{cell("")}{cell("[]")}</p>'
    senses = pages.lexicon(spark.createDataFrame([("u", html)], "url string, html string")).first().senses
    assert [(e.text_latin, e.source_attribution, e.trans_fr) for e in senses[0].examples] == [("a b", "[Author]", "t"), ("plain", None, "t"), ("[]", None, "t")]


def test_page_fields_as_written():
    """A reference without its semicolon is read as a browser reads it, and can be had as it was written."""
    html = '<title> a &amp;b &quot;c&amp</title><h1>x&nbsp;<b>&amp; y&amp;amp;</b></h1><a href="?a=1&amp;b=2">l</a><script>"<p>&amp;"</script><p>'
    assert next(pages.page_fields("u", html)) == {"url": "u", "title": 'a &b "c&', "h1": "x& y&amp;", "title_source": "a &amp;b &quot;c&amp", "h1_source": "x&nbsp;&amp; y&amp;amp;", "links": 1, "paragraphs": 1}
    assert next(pages.page_fields("u", "plain"))["title"] is None


def test_pages_are_dealt_over_tasks(spark):
    """Pages shrink in a shuffle: tasks are not sized by its bytes, and a batch's pages become Python's one at a time."""
    from lexmill.plans import report_queries

    assert report_queries._entry_pages(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = '<p class="lxP"><span class="Lxe" id="e{}">a</span></p>'
    page = spark.createDataFrame([("u", "".join(entry.format(i) for i in range(3 * pages.GATHERED + 1))), ("v", None)], "url string, html string")
    assert pages.parsed(page, pages.lexicon_entries, pages.ENTRY).select("entry_id").distinct().count() == 3 * pages.GATHERED + 1
