"""Licence notices, identifier tags and licence expressions in whole texts.

Method: every text is lower-cased (A-Z) and reduced to its words; one Aho-Corasick automaton finds
all base phrases, further notice phrases and the identifier tag in one pass over those words. What
follows an identifier tag, to the next tag or the end of its line, is parsed by a shunting-yard and its and/or/with expression is
evaluated for the freedom it leaves (and: least, or: most, with: a little more than without).

Labels: base phrases give gpl, apache, cc-by and mit; names of licences give name:<identifier>, and with a version behind
them name:<identifier>-<version> too; further notices give notice:<name>; tags (with a colon or equals sign) give spdx:<identifier> and spdx:<exception>, and spdx:malformed for an expression that cannot be parsed
(its identifiers count all the same). score is the strength of the evidence, 1 - 2**-(base places +
notices + 2 * tags). freedom (0 to 1) is the mean of the tags' values, null without tags.

Cases: null and empty texts have no words, no labels and score 0; overlapping places all count; very long
texts, also of one line, are scanned whole in time linear in their length;
repeated rows each get a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm._spark import table

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = {
    "permission is hereby granted free of charge": "notice:permissive-grant",
    "redistribution and use in source and binary forms": "notice:bsd-terms",
    "this program is free software": "notice:copyleft-program",
    "licensed under": "notice:licensed-under",
    "all rights reserved": "notice:all-rights-reserved",
}
#: Names of licences and how their identifiers begin; a version that follows is added.
NAMES = {
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl", "gnu affero general public license": "agpl", "gnu free documentation license": "gfdl",
    "apache license": "apache", "apache software license": "apache", "mit license": "mit", "expat license": "mit", "isc license": "isc", "zlib license": "zlib", "boost software license": "bsl", "unlicense": "unlicense",
    "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause", "bsd 4 clause": "bsd-4-clause", "2 clause bsd": "bsd-2-clause", "3 clause bsd": "bsd-3-clause", "simplified bsd license": "bsd-2-clause", "new bsd license": "bsd-3-clause", "modified bsd license": "bsd-3-clause",
    "mozilla public license": "mpl", "eclipse public license": "epl", "eclipse distribution license": "edl", "common development and distribution license": "cddl", "common public license": "cpl", "ibm public license": "ipl",
    "european union public licence": "eupl", "european union public license": "eupl", "open software license": "osl", "academic free license": "afl", "artistic license": "artistic", "microsoft public license": "ms-pl", "microsoft reciprocal license": "ms-rl",
    "python software foundation license": "psf", "php license": "php", "ruby license": "ruby", "postgresql license": "postgresql", "openssl license": "openssl", "sil open font license": "ofl", "open data commons open database license": "odbl",
    "cc0": "cc0", "creative commons zero": "cc0", "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa", "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc",
    "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "public domain dedication": "pddl",
}
#: Short names, which count where a version follows them in prose ("MPL 2.0", "GPL v3", "GPLv2").
SHORT = ("gpl", "lgpl", "agpl", "mpl", "epl", "cddl", "eupl", "osl", "afl")
_SHORT = re.compile(rf"(?<![0-9a-z\x80-\U0010ffff-])({'|'.join(SHORT)})(?:[ \t]+(?:version[ \t]+|v\.?[ \t]*)?|v)([0-9]{{1,2}})(?:\.([0-9]))?(?![0-9a-z\x80-\U0010ffff])", re.I)
_VERSIONED = tuple(f"{name}v{n}" for name in SHORT for n in (1, 2, 3, 4))
#: A version in the words behind a name: "version 2.1", "v3", "2.0 international".
_VERSION = re.compile(rb"(?:license |licence |international )?(?:version |v(?=[0-9 ]) ?)?([0-9]{1,2})(?: ([0-9]))?(?= )")
TAG = "spdx license identifier"
#: Fixed: all bytes but 0-9, a-z (A-Z become those) and non-ASCII ones separate words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TAGGED = re.compile(r"(?<![0-9a-z\x80-\U0010ffff])spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier(?![0-9a-z\x80-\U0010ffff])[ \t]*[:=][ \t]*", re.I)
_LINE_END = re.compile(r"[\r\n]|$")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:\-]*")
RANK = {"or": 1, "and": 2, "with": 3}
_FREE, _WEAK, _STRONG = ("mit", "apache", "bsd", "isc", "cc0", "unlicense", "zlib", "0bsd", "cc-by-4", "cc-by-3"), ("lgpl", "mpl", "epl", "cddl"), ("gpl", "agpl", "cc-by-sa")
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double"


def freedom_of(identifier: str) -> float:
    """How much an identifier allows: 1 permissive, 0.6 weak copyleft, 0.3 strong copyleft, 0.1 unknown."""
    for names, value in ((_WEAK, 0.6), (_STRONG, 0.3), (_FREE, 1.0)):
        if identifier.startswith(names):
            return value
    return 0.1


def parse_expression(text: str) -> list[str] | None:
    """The expression in postfix order by a shunting-yard, None if it is malformed. Reads up to the first word that cannot continue it."""
    out: list[str] = []
    waiting: list[str] = []
    want_name = True
    for token in _TOKEN.findall(text):
        low = token.lower()
        if token == "(":
            if not want_name:
                break
            waiting.append(low)
        elif token == ")":
            if want_name:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                break
            waiting.pop()
        elif low in RANK:
            if want_name:
                return None
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[low]:
                out.append(waiting.pop())
            waiting.append(low)
            want_name = True
        else:
            if not want_name:
                break
            out.append(low)
            want_name = False
    if want_name or "(" in waiting:
        return None
    return out + waiting[::-1]


def expression_end(text: str) -> int:
    """Where the expression that `text` begins with ends: behind the last word or bracket that can continue it."""
    end, depth, want_name = 0, 0, True
    for found in _TOKEN.finditer(text):
        token = found[0].lower()
        if want_name != (token == "(" or (token != ")" and token not in RANK)):
            break
        depth += (token == "(") - (token == ")")
        if depth < 0:
            break
        want_name = token == "(" or token in RANK
        end = found.end()
    return end


def evaluate(postfix: list[str]) -> float:
    """The freedom that a licence expression leaves."""
    stack: list[float] = []
    for token in postfix:
        if token in RANK:
            right, left = stack.pop(), stack.pop()
            stack.append(min(left, right) if token == "and" else max(left, right) if token == "or" else min(1.0, left + 0.1))
        else:
            stack.append(freedom_of(token))
    return stack[0]


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *NAMES, *SHORT, *_VERSIONED, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: str | None, find) -> tuple:
    """One text's row without doc_id. find: the automaton's iter."""
    words = (text or "").encode().translate(_WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, None
    line = b" " + b" ".join(words) + b" "
    at, counted, starts, base, labels, notices, tagged, short, named = 0, 0, [], set(), set(), 0, False, False, []
    for end, phrase in find(line.decode("latin-1")):
        start = end - len(phrase) - 1  # the space before it; the words before are as many as the spaces before that
        counted, at = counted + (line.count(b" ", at, start) if start >= at else -line.count(b" ", start, at)), start
        if phrase in BASE:
            starts.append(counted)
            base.add(BASE[phrase])
        if phrase in NAMES:
            version = _VERSION.match(line, end + 1, end + 40)
            named.append((counted, phrase, ".".join(x.decode() for x in version.groups() if x) if version else ""))
        elif phrase in SHORT or phrase in _VERSIONED:
            short = True
        elif phrase == TAG:
            tagged = True
        elif phrase in NOTICES:
            notices += 1
            labels.add(NOTICES[phrase])
    values, within, spans = [], [], []
    tags = list(_TAGGED.finditer(text)) if tagged else []
    before, read = 0, 0  # words before the tag, and the text in which they were counted
    for tag, following in zip(tags, [*(t.start() for t in tags[1:]), len(text)] if tags else ()):
        # to the next tag or the end of the line
        stop = _LINE_END.search(text, tag.end(), following).start()
        stop = tag.end() + expression_end(text[tag.end() : stop])
        rest = text[tag.end() : stop]
        postfix = parse_expression(rest)
        if postfix is None:
            labels.add("spdx:malformed")
        names = [t.lower() for t in _TOKEN.findall(rest) if t not in "()" and t.lower() not in RANK] if postfix is None else [t for t in postfix if t not in RANK]
        labels.update(f"spdx:{n}" for n in names)
        values.append(0.0 if postfix is None else evaluate(postfix))
        before += len(text[read : tag.start()].encode().translate(_WORDS).split()) + 3
        within.append((before, before + len(rest.encode().translate(_WORDS).split())))
        spans.append((tag.start(), stop))
        before, read = within[-1][1], stop
    for word, phrase, version in named:
        i = bisect_right(within, (word, len(words))) - 1
        if i >= 0 and word < within[i][1]:
            continue  # a tag's own identifiers
        notices += phrase not in BASE
        labels.add(f"name:{NAMES[phrase]}")
        if version:
            labels.add(f"name:{NAMES[phrase]}-{version}")
    for found in _SHORT.finditer(text) if short else ():
        i = bisect_right(spans, (found.start(), len(text))) - 1
        if i < 0 or found.start() >= spans[i][1]:
            notices += 1
            name = found[1].lower()
            labels.update((f"name:{name}", f"name:{name}-{'.'.join(x for x in found.groups()[1:] if x)}"))
    evidence = len(starts) + notices + 2 * len(values)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - 0.5**evidence, sum(values) / len(values) if values else None


def license_scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton().iter
        for batch in batches:
            rows = [scan(t, find) for t in batch.column("text").to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.float64())
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "freedom"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(sf_dir, "documents", spark))


QUERIES: dict[str, Callable] = {"op5_license_scan": op5_license_scan}
SQL: dict[str, str] = {}
