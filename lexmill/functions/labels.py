"""Small scalars of entries, warnings and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Part-of-speech labels that are kept as hints.
POS_HINTS = ("n", "v", "adj", "adv", "intj", "conj", "prep", "pp", "prt", "pers", "prn", "dtm", "num", "cop", "pm", "ptcp", "vq", "onomat", "n.prop", "pers/pm", "adv.p")


def pos_hint(raw: Column) -> Column:
    """The lower-cased first word if it has a / or is a known label, else null."""
    first = F.lower(F.regexp_extract(raw, r"^\s*(\S+)", 1))
    return F.when(first.contains("/") | first.isin(*POS_HINTS), first)


def first_int(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)", 1), F.lit("")).try_cast("int")


def attribution(c: Column) -> Column:
    """A struct of the text without [..] parts and the first of these, with its brackets."""
    return F.struct(F.trim(F.regexp_replace(c, r"\s*\[[^\]]*\]\s*", " ")).alias("text"), F.nullif(F.regexp_extract(c, r"\[[^\]]*\]", 0), F.lit("")).alias("source"))


def warning_type(c: Column) -> Column:
    """What stands before a colon, else the first word, else unknown."""
    return F.when(c.contains(":"), F.substring_index(c, ":", 1)).otherwise(F.coalesce(F.nullif(F.regexp_extract(c, r"^\s*(\S+)", 1), F.lit("")), F.lit("unknown")))


def url_tail(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def iso_second(ts: Column) -> Column:
    """UTC, to the second, as a string (the session's time zone must be UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def human_bytes(n: Column) -> Column:
    """Bytes in B, KB, MB or GB, two decimals above B."""
    n = n.cast("double")

    def scaled(k: int, unit: str) -> Column:
        return F.concat(F.format_string("%.2f", n / 1024**k), F.lit(f" {unit}"))

    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def human_ms(ms: Column) -> Column:
    """Milliseconds, rounded, with their unit."""
    return F.concat(F.round(ms.cast("double")).cast("long").cast("string"), F.lit(" ms"))


def crawl_id(source: Column, at: Column, suffix: Column) -> Column:
    """A crawl's id: time to the millisecond (the session's time zone must be UTC), four hex digits against collisions, source."""
    return F.concat_ws("_", F.lit("crawl"), F.date_format(at, "yyyyMMdd_HHmmss_SSS"), F.lower(F.lpad(F.right(suffix, F.lit(4)), 4, "0")), source)


def language_label(label: Column, code: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), F.upper(F.nullif(F.trim(code), F.lit(""))), F.lit(default))
