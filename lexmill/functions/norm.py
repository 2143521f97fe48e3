"""Search-key normalization as Catalyst expressions.

Case folding and removal of diacritics are `translate` tables and character classes, generated from
the Unicode data of this Python at import; texts of ASCII alone take a shorter way. Nothing here is a
Python UDF. Canonical composition alone (`nfc`, in compose.py, so that workers need not make these
tables) has no Catalyst form and is a pandas UDF.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.compose import nfc

__all__ = ("KEYS", "all_keys", "bound", "casefold", "nfc", "punctuation_to_space", "remove_spaces", "search_keys", "strip_diacritics", "strip_punctuation", "whitespace")

_ALL = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
ASCII = "^[\\x00-\\x7f]*$"


def char_class(chars) -> str:
    """A regular-expression class of these characters, as ranges."""
    codes, parts = sorted(map(ord, chars)), []
    start = last = None
    for c in [*codes, None]:
        if last is not None and c == last + 1:
            last = c
            continue
        if start is not None:
            parts.append(f"\\x{{{start:x}}}-\\x{{{last:x}}}")
        start = last = c
    return "[" + "".join(parts) + "]"


def _stripped(c: str) -> str:
    return unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"))


_fold = {c: c.casefold() for c in _ALL if c.casefold() != c}
_strip = {c: s for c in _ALL if len(s := _stripped(c)) == 1 and s != c}
FOLD_FROM, FOLD_TO = ("".join(x) for x in zip(*((c, f) for c, f in _fold.items() if len(f) == 1)))
FOLD_LONG = {c: f for c, f in _fold.items() if len(f) > 1}
STRIP_FROM, STRIP_TO = "".join(_strip), "".join(_strip.values())


def wide_class(chars, first: int) -> str:
    """A class of these characters that tries their ranges only from `first` on, as they are tried one after another; those before stand singly, of which Java makes a bit set."""
    small, large = sorted(c for c in chars if ord(c) < first), [c for c in chars if ord(c) >= first]
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in small) + f"[\\x{{{first:x}}}-\\x{{10ffff}}&&{char_class(large)}]]"


MARKS = wide_class([c for c in _ALL if unicodedata.category(c)[0] == "M"], 0x300)
PUNCTUATION = wide_class([c for c in _ALL if unicodedata.category(c)[0] == "P"], 0x37E)
SPACE = wide_class([c for c in _ALL if c.isspace()], 0x1680)
#: A run of white space other than one blank.
_RUN = f"{SPACE}(?:(?<! )|(?={SPACE})){SPACE}*+"
_LONG = wide_class(FOLD_LONG, 0x130)
#: Characters whose folding, and in this Unicode version, may be other than their lower case; without one, `lower` does.
_OTHER = wide_class([c for c in _ALL if len(c.lower()) > 1 or c.lower() != c.casefold() or (ord(c) >= 0x250 and (unicodedata.category(c) == "Cn" or not c == c.lower() == c.upper() == c.casefold()))], 0x130)


def whitespace(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, _RUN, " "))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c worked out once, however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def casefold(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FOLD_LONG.items() for x in kv])

    def fold(x: Column) -> Column:
        # the characters that fold to several, each by itself, and the runs between them
        each = F.array_join(F.transform(F.split(x, f"(?<={_LONG})|(?={_LONG})"), lambda y: F.coalesce(F.try_element_at(table, y), F.translate(y, FOLD_FROM, FOLD_TO))), "")
        return F.when(~x.rlike(_OTHER), F.lower(x)).when(x.rlike(_LONG), each).otherwise(F.translate(x, FOLD_FROM, FOLD_TO))

    return bound(c, fold)


def strip_diacritics(c: Column) -> Column:
    return bound(c, lambda x: F.when(x.rlike(ASCII), x).otherwise(F.regexp_replace(F.translate(x, STRIP_FROM, STRIP_TO), MARKS, "")))


def strip_punctuation(c: Column) -> Column:
    return whitespace(F.regexp_replace(c, f"{PUNCTUATION}+", ""))


def punctuation_to_space(c: Column) -> Column:
    return whitespace(F.regexp_replace(c, PUNCTUATION, " "))


def remove_spaces(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def key_casefold(c: Column) -> Column:
    return casefold(whitespace(c))


def key_diacritics_insensitive(c: Column) -> Column:
    return strip_diacritics(casefold(whitespace(c)))


def key_punct_stripped(c: Column) -> Column:
    return strip_diacritics(casefold(strip_punctuation(whitespace(c))))


def key_nospace(c: Column) -> Column:
    return remove_spaces(key_diacritics_insensitive(c))


#: Key functions in the order of the exactness ladder.
KEYS = {"casefold": key_casefold, "diacritics_insensitive": key_diacritics_insensitive, "punct_stripped": key_punct_stripped, "nospace": key_nospace}


def all_keys(c: Column) -> Column:
    """A struct of the four keys of a form, which share their steps."""

    def of(spaced: Column) -> Column:
        plain = strip_diacritics(casefold(strip_punctuation(spaced)))
        return bound(casefold(spaced), lambda folded: bound(strip_diacritics(folded), lambda bare: F.struct(folded.alias("casefold"), bare.alias("diacritics_insensitive"), plain.alias("punct_stripped"), remove_spaces(bare).alias("nospace"))))

    return bound(whitespace(c), of)


def search_keys(forms: Column) -> Column:
    """A struct of four arrays: for each key type the distinct non-empty keys of the forms, in their order; null for null forms."""

    def of(keys: Column) -> Column:
        return F.struct(*[F.array_distinct(F.filter(keys[name], lambda k: k != "")).alias(name) for name in KEYS])  # a field of an array of structs is an array

    return bound(F.transform(forms, all_keys), of)
