"""Dictionary pages to rows: lexicon entries, index mappings, and generic page fields.

HTML has no Catalyst form, so pages are parsed by the standard library in Arrow batches, a row an
entry; everything after that (ids, keys, warnings, next entries) is DataFrame work on those rows.
Filter pages before parsing: a predicate behind the parser is not pushed below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from html import escape, unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import identity, labels, urls

#: Rows of pages that make a batch.
GATHERED = 500
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
GLOSSES = {"gloss_fr": "GlFr", "gloss_en": "GlEn", "gloss_ru": "GlRu"}
EXAMPLE = "struct<text_latin:string,text_nko_provided:string,trans_fr:string,trans_en:string,trans_ru:string,source_attribution:string>"
SUB = "struct<text:string,nko:string,gloss_fr:string,gloss_en:string,gloss_ru:string>"
SENSE = f"struct<sense_num:int,gloss_fr:string,gloss_en:string,gloss_ru:string,examples:array<{EXAMPLE}>,synonyms_raw:array<string>,sub_entries:array<{SUB}>>"
ENTRY = f"url string, pos int, entry_id string, anchors array<string>, headword string, headword_nko string, ps_raw string, etymology string, literal string, corpus string, variants array<string>, synonyms array<string>, blocks int, block_hash string, senses array<{SENSE}>"
MAPPING = "url string, entry_index int, term string, targets array<struct<lexicon_url:string,anchor:string,display_text:string>>, warnings array<string>"


class Node:
    """An element: tag, attributes, and children (elements, strings; comments are None)."""

    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict, up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def inside(self) -> Iterator[Node | str | None]:
        """What is inside, in order; without recursion, so a page may nest as deep as it likes."""
        stack = [iter(self.kids)]
        while stack:
            for kid in stack[-1]:
                yield kid
                if isinstance(kid, Node):
                    stack.append(iter(kid.kids))
                    break
            else:
                stack.pop()

    def walk(self) -> Iterator[Node]:
        return (kid for kid in self.inside() if isinstance(kid, Node))

    def all(self, tag: str, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.tag == tag and (not names or set(names) & set(n.classes()))]

    def first(self, tag: str, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag and (not names or set(names) & set(n.classes()))), None)

    def text(self) -> str:
        """All strings, each stripped, without anything between."""
        return "".join(kid.strip() for kid in self.inside() if isinstance(kid, str))

    def html(self) -> str:
        out, stack = [], [(self, None)]
        while stack:
            node, end = stack.pop()
            if end is not None:
                out.append(end)
            elif isinstance(node, Node):
                attrs = "".join(f' {k}="{escape(v or "")}"' for k, v in node.attrs.items())
                out.append(f"<{node.tag}{attrs}/>" if node.tag in VOID else f"<{node.tag}{attrs}>")
                if node.tag not in VOID:
                    stack.append((node, f"</{node.tag}>"))
                    stack += [(kid, None) for kid in reversed(node.kids)]
            else:
                out.append(escape(node or "", quote=False))
        return "".join(out)


class Tree(HTMLParser):
    """Elements nest as they are opened; an end tag closes up to the last open one of its name."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.up is not None and node.tag != tag:
            node = node.up
        if node.up is not None:
            self.at = node.up

    def handle_data(self, data):
        self.at.kids.append(data)

    def handle_comment(self, data):
        self.at.kids.append(None)


def distinct(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def text_of(node: Node | None) -> str | None:
    return (node.text() or None) if node else None


def glosses(block: Node) -> dict[str, str | None]:
    return {k: text_of(block.first("div", c)) for k, c in GLOSSES.items()}


def examples(block: Node) -> list[dict]:
    """Each span.Exe with the first glosses among its siblings before the next example or sense."""
    out = []
    for exe in block.all("span", "Exe"):
        row = {"text_latin": exe.text(), "text_nko_provided": None, "trans_fr": None, "trans_en": None, "trans_ru": None}
        kin = [k for k in exe.up.kids if isinstance(k, Node)]
        for other in kin[kin.index(exe) + 1 :]:
            names = other.classes()
            if {"Exe", "SnsN"} & set(names):
                break
            for field, name in (("text_nko_provided", "GlNko"), ("trans_fr", "GlFr"), ("trans_en", "GlEn"), ("trans_ru", "GlRu")):
                if other.tag == "div" and name in names and row[field] is None:
                    row[field] = text_of(other)
        out.append(row)
    return out


def synonyms(block: Node) -> list[str]:
    return distinct(n.text() for s in block.all("span", "Mnhsynm") for n in (s.all("a") or s.all("span", "LexF")))


def senses(blocks: list[Node]) -> list[dict]:
    """A fold over p.lxP2 blocks: a number begins a sense, an arrow or a reference is a sub-entry, all else adds to the sense."""
    out: list[dict] = []
    for block in blocks:
        number, found = block.first("span", "SnsN"), glosses(block)
        mark = number.text() if number else ""
        if block.first("span", "PS") and not number and not any(found.values()):
            continue
        sub = mark.startswith("→") or (not number and block.first("span", "MXRef") is not None)
        if (number and not sub) or not out:
            digits = "".join(c for c in mark if c.isdigit())
            out.append({"sense_num": int(digits) if digits and not sub else None, "gloss_fr": None, "gloss_en": None, "gloss_ru": None, "examples": [], "synonyms_raw": [], "sub_entries": []})
        now = out[-1]
        if sub:
            ref = block.first("span", "MXRef") or block.first("span", "LexF")
            now["sub_entries"].append({"text": text_of(ref), "nko": text_of(block.first("div", "GlNko")), **found})
            continue
        now.update({k: v for k, v in found.items() if v})
        now["examples"] += examples(block)
        now["synonyms_raw"] = distinct(now["synonyms_raw"] + synonyms(block))
    return out


def lexicon_entries(url: str, html: str) -> Iterator[dict]:
    for pos, head in enumerate(n for n in Tree(html).root.all("p", "lxP") if (s := n.first("span", "Lxe")) and s.attrs.get("id")):
        around = head.up.kids
        at, names = around.index(head), []
        for kid in reversed(around[:at]):
            if isinstance(kid, Node) and kid.tag == "a" and kid.attrs.get("name"):
                names.insert(0, kid.attrs["name"])
            elif isinstance(kid, Node) or (kid and kid.strip()):
                break
        block = [head]
        for kid in around[at + 1 :]:
            if isinstance(kid, Node):
                if kid.tag == "p" and "lxP" in kid.classes():
                    break
                block.append(kid)
        lexeme, count = head.first("span", "Lxe"), head.first("b", "clnknt")
        literal = head.first("span", "lpLiteralMeaningEnglish") or head.first("span", "Mnhlitt")
        yield {
            "url": url, "pos": pos, "entry_id": lexeme.attrs["id"], "anchors": names, "headword": text_of(lexeme), "headword_nko": text_of(head.first("span", "GlNko")), "ps_raw": text_of(head.first("span", "PS")),
            "etymology": text_of(head.first("span", "Mnhbw")), "literal": text_of(literal), "corpus": text_of(count.first("a")) if count else None,
            "variants": distinct(a.text() for s in head.all("span", "Mnhvam", "Mnhrv") for a in s.all("a", "MXRef")), "synonyms": synonyms(head), "blocks": len(block),
            "block_hash": hashlib.sha256("".join(b.html() for b in block).encode()).hexdigest()[:16], "senses": senses([b for b in block if b.tag == "p" and "lxP2" in b.classes()]),
        }


def index_rows(url: str, html: str) -> Iterator[dict]:
    """Rows of the first table in div#basfr; numbers count all rows, also those that are dropped."""
    base = next((n for n in Tree(html).root.all("div") if n.attrs.get("id") == "basfr"), None)
    shelf = base.first("table") if base else None
    for i, row in enumerate(shelf.all("tr") if shelf else ()):
        cells, term = row.all("td"), row.first("span", "IxFr")
        if len(cells) < 2 or not term or not term.text():
            continue
        targets, warnings = {}, []
        for a in cells[1].all("a", "IxBm", "IvBm", "IeBm"):
            url_part, _, anchor = (a.attrs.get("href") or "").partition("#")
            if not url_part or not anchor:
                warnings.append(f"unparseable_href: {a.attrs.get('href') or ''}")
            else:
                targets.setdefault((url_part, anchor), {"lexicon_url": url_part, "anchor": anchor, "display_text": a.text()})
        yield {"url": url, "entry_index": i, "term": term.text(), "targets": list(targets.values()), "warnings": warnings + ([] if targets else ["no_target_entries"])}


def page_fields(url: str, html: str) -> Iterator[dict]:
    """Title and first heading, also as they are written (_source: character references are left), and numbers of links and paragraphs."""
    root = Tree(html.replace("&", "&amp;")).root  # so that references come out as they were written
    written = {name: [kid for kid in node.inside() if isinstance(kid, str)] if (node := root.first(name)) else [] for name in ("title", "h1")}
    texts = {name: "".join(unescape(x).strip() for x in strings) or None for name, strings in written.items()}
    sources = {f"{name}_source": "".join(x.strip() for x in strings) or None for name, strings in written.items()}
    yield {"url": url, **texts, **sources, "links": len(root.all("a")), "paragraphs": len(root.all("p"))}


def parsed(pages: DataFrame, rows: Callable[[str, str], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of pages (url, html: string or bytes, read as UTF-8 with replacement); a page without html has none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = _parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, held = to_arrow_schema(kind), []
        for batch in batches:
            for url, html in zip(batch.column("url"), batch.column("html")):  # a page at a time becomes Python's
                if (html := html.as_py()) is None:
                    continue
                for row in rows(url.as_py(), html.decode("utf-8", "replace") if isinstance(html, bytes) else html):
                    held.append(row)
                    if len(held) >= GATHERED:
                        yield pa.RecordBatch.from_pylist(held, arrow)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, arrow)

    return pages.select("url", "html").mapInArrow(run, kind)


def attributed(senses: Column) -> Column:
    """senses with each example's [..] part as its source_attribution, taken out of the text; examples without text go."""

    def example(e: Column) -> Column:
        found = labels.attribution(e.text_latin)
        marked = e.text_latin.rlike(r"\[[^\]]+\]")
        return e.withField("text_latin", F.when(marked, found.text).otherwise(e.text_latin)).withField("source_attribution", F.when(marked, found.source))

    return F.transform(senses, lambda s: s.withField("examples", F.transform(F.filter(s.examples, lambda e: e.text_latin != ""), example)))


def lexicon(pages: DataFrame, source: str = "source", version: str = "lexicon_v3") -> DataFrame:
    """Lexicon entries with ids, hints and the selector of the entry that follows on the page."""
    rows = parsed(pages, lexicon_entries, ENTRY).withColumn("senses", attributed(F.col("senses")))
    return rows.select("*", identity.ir_id(F.lit(source), F.col("url"), F.col("entry_id"), F.lit(version)).alias("ir_id"), labels.pos_hint(F.col("ps_raw")).alias("pos_hint"), labels.first_int(F.col("corpus")).alias("corpus_count"), F.lead("entry_id").over(Window.partitionBy("url").orderBy("pos")).alias("end_selector"))


def mappings(pages: DataFrame, source: str = "source", version: str = "index_v1") -> DataFrame:
    rows = parsed(pages, index_rows, MAPPING)
    return rows.withColumn("ir_id", identity.ir_id(F.lit(source), F.col("url"), F.col("entry_index"), F.lit(version)))


def resolved_targets(mapped: DataFrame, entries: DataFrame) -> DataFrame:
    """Targets of mappings against entries by (url of the page, id): rows (ir_id, target_url, anchor, target), target null where it dangles."""
    name = F.substring_index("t.lexicon_url", "/", -1)
    rows = mapped.select("ir_id", F.explode("targets").alias("t")).select("ir_id", name.alias("page"), F.col("t.anchor").alias("anchor"))
    known = entries.select(labels.url_tail(urls.canonical_url(F.col("url"))).alias("page"), F.col("entry_id").alias("anchor"), F.col("ir_id").alias("target"))
    return rows.join(known, ["page", "anchor"], "left")


EVIDENCE = "source_id string, snapshot_id string, start_selector string, end_selector string, css_selector string, text_quote string, raw_block_hash string"


def _evidence(**fields: Column) -> Column:
    """One place in a capture: where its block begins and ends or its selector, the text that stands there, and the block's hash."""
    names = [f.split(" ")[0] for f in EVIDENCE.split(", ")]
    return F.array(F.struct(*[fields.get(n, F.lit(None)).cast("string").alias(n) for n in names]))


def _locator(kind: str, url: Column, record: Column, index: Column, anchors: Column) -> Column:
    """What names a record on its page; url_canonical stands in all, as ids are those of a page."""
    return F.struct(F.lit(kind).alias("kind"), url.alias("url_canonical"), record.cast("string").alias("source_record_id"), index.cast("int").alias("entry_index"), anchors.cast("array<string>").alias("anchor_names"))


def units(entries: DataFrame | None, mapped: DataFrame | None, snapshots: DataFrame, source: str = "source") -> DataFrame:
    """Rows (ir_id, ir_kind, source_id, evidence, record_locator) of lexicon entries and index mappings, with the capture (url, snapshot_id) that each comes from.

    A page without a capture keeps its records, with a null snapshot_id.
    """
    none, parts = F.lit(None), []
    if entries is not None:
        e = entries.join(snapshots.select("url", "snapshot_id"), "url", "left")
        selector = lambda c: F.concat(F.lit("span#"), c)
        evidence = _evidence(source_id=F.lit(source), snapshot_id=F.col("snapshot_id"), start_selector=selector(F.col("entry_id")), end_selector=selector(F.col("end_selector")), text_quote=F.col("headword"), raw_block_hash=F.col("block_hash"))
        parts.append(e.select("ir_id", F.lit("lexicon_entry").alias("ir_kind"), F.lit(source).alias("source_id"), evidence.alias("evidence"), _locator("source_record_id", F.col("url"), F.col("entry_id"), none, F.col("anchors")).alias("record_locator")))
    if mapped is not None:
        m = mapped.join(snapshots.select("url", "snapshot_id"), "url", "left")
        css = F.concat(F.lit("tr:nth-child("), (F.col("entry_index") + 1).cast("string"), F.lit(")"))
        evidence = _evidence(source_id=F.lit(source), snapshot_id=F.col("snapshot_id"), css_selector=css, text_quote=F.col("term"))
        parts.append(m.select("ir_id", F.lit("index_mapping").alias("ir_kind"), F.lit(source).alias("source_id"), evidence.alias("evidence"), _locator("url_canonical+entry_index", F.col("url"), none, F.col("entry_index"), none).alias("record_locator")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
