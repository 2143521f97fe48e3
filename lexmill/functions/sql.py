"""The library in SQL text: key functions and other scalars as SQL functions, page parsers as table functions.

A scalar's body is the SQL text of its Catalyst expression, so a query in SQL is planned as the same
expression in whole-stage code; there is no Python in it. The parsers are Python table functions over a table
of pages (url, html), dealt by PARTITION BY:

    SELECT entry_id, key_casefold(headword) FROM lexicon_entries(TABLE(SELECT url, html FROM pages) PARTITION BY url)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import identity, labels, norm, urls

#: Name, parameters with their types, result type, and the expression.
SCALARS: dict[str, tuple[dict[str, str], str, Callable[..., Column]]] = {
    **{f"key_{name}": ({"text": "STRING"}, "STRING", of) for name, of in norm.KEYS.items()},
    "all_keys": ({"text": "STRING"}, "STRUCT<" + ", ".join(f"{name}: STRING" for name in norm.KEYS) + ">", norm.all_keys),
    "canonical_url": ({"url": "STRING"}, "STRING", urls.canonical_url),
    "url_tail": ({"url": "STRING"}, "STRING", labels.url_tail),
    "pos_hint": ({"raw": "STRING"}, "STRING", labels.pos_hint),
    "first_int": ({"raw": "STRING"}, "INT", labels.first_int),
    "ir_id": ({"source": "STRING", "url": "STRING", "record": "STRING", "version": "STRING"}, "STRING", identity.ir_id),
}


_LITERAL = re.compile(r"('(?:[^'\\]|\\.)*')", re.S)
_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|<>|==|=|<|>|\+|-|\*|/|%|!|and|or|not)\(")


class LexiconEntries:
    """Entries of lexicon pages."""

    def eval(self, page: Row) -> Iterator[tuple]:
        from lexmill.sources import pages

        yield from _rows(page, pages.lexicon_entries, pages.ENTRY)


class IndexRows:
    """Rows of index pages."""

    def eval(self, page: Row) -> Iterator[tuple]:
        from lexmill.sources import pages

        yield from _rows(page, pages.index_rows, pages.MAPPING)


def _rows(page: Row, parse: Callable[[str, str], Iterator[dict]], schema: str) -> Iterator[tuple]:
    html = page["html"]
    if html is not None:
        text = bytes(html).decode("utf-8", "replace") if isinstance(html, (bytes, bytearray)) else html
        for row in parse(page["url"], text):
            yield tuple(row.values())


def body(of: Callable[..., Column], parameters: dict[str, str]) -> str:
    """The SQL text of an expression over these parameters; operators, which it writes as functions, by their quoted names."""
    text = of(*[F.col(name) for name in parameters])._jc.node().sql()
    pieces = _LITERAL.split(text)
    return "".join(piece if i % 2 else _OPERATOR.sub(r"`\1`(", piece) for i, piece in enumerate(pieces))


def register(spark: SparkSession) -> None:
    """Makes the functions known to this session, as temporary ones."""
    from lexmill.sources import pages

    for name, (parameters, result, of) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{n} {t}' for n, t in parameters.items())}) RETURNS {result} RETURN ({body(of, parameters)})")
    for name, kind, schema in (("lexicon_entries", LexiconEntries, pages.ENTRY), ("index_rows", IndexRows, pages.MAPPING)):
        spark.udtf.register(name, F.udtf(kind, returnType=schema))
