import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import norm

KEYS = [
    ("dɔ́bɛ̀n", "dɔ́bɛ̀n", "dɔbɛn", "dɔbɛn", "dɔbɛn"),
    ("dá", "dá", "da", "da", "da"),
    ("  a\tb\nc  ", "a b c", "a b c", "a b c", "abc"),
    ("dín`", "dín`", "din`", "din`", "din`"),
    ("-da", "-da", "-da", "da", "-da"),
    ("n'ko", "n'ko", "n'ko", "nko", "n'ko"),
    ("n’ko", "n’ko", "n’ko", "nko", "n’ko"),
    ("Straße", "strasse", "strasse", "strasse", "strasse"),
    ("ΣΑΣ", "σασ", "σασ", "σασ", "σασ"),
    ("ﬁx", "fix", "fix", "fix", "fix"),
    ("bâcler le travail", "bâcler le travail", "bacler le travail", "bacler le travail", "baclerletravail"),
]


def test_keys(spark):
    rows = spark.createDataFrame([(unicodedata.normalize("NFC", k[0]),) for k in KEYS], "x string").select(*[f(F.col("x")).alias(n) for n, f in norm.KEYS.items()]).collect()
    for row, want in zip(rows, KEYS):
        assert tuple(row) == tuple(unicodedata.normalize("NFC", w) for w in want[1:])


def test_every_character_folds_as_python(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    rows = spark.createDataFrame([(c,) for c in chars], "x string").select("x", norm.casefold(F.col("x")).alias("f"), norm.strip_diacritics(F.col("x")).alias("s")).collect()
    for r in rows:
        assert r.f == r.x.casefold()
        assert r.s == unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", r.x) if unicodedata.category(c)[0] != "M"))


@pytest.mark.parametrize("x,want", [(" a b\u001cc​", "a b c​"), ("", ""), ("   ", ""), (None, None)])
def test_whitespace(spark, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(norm.whitespace(F.col("x"))).first()[0] == want


def test_search_keys_drop_empty_and_keep_order(spark):
    k = spark.createDataFrame([(["B b", "  ", "b B", "B b", "!"],)], "f array<string>").select(norm.search_keys(F.col("f")).alias("k")).first().k
    assert k.casefold == ["b b", "!"] and k.punct_stripped == ["b b"] and k.nospace == ["bb", "!"]


def test_long_runs_of_punctuation(spark):
    """A run is matched by one class in a loop, whatever its length."""
    text = "a" + "!" * 300_000 + "—" * 300_000 + "ß ΣΑΣ b"
    got = spark.createDataFrame([(text,)], "x string").select(norm.strip_punctuation(F.col("x")).alias("p"), norm.key_punct_stripped(F.col("x")).alias("k")).first()
    assert tuple(got) == ("aß ΣΑΣ b", "ass σασ b")
