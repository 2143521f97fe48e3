"""Canonical JSON (RFC 8785) of a column, as an expression made from its type; hashes of fragment pointers.

Members come in the order of their names' UTF-16 units, strings with the fewest escapes, numbers as the shortest
decimal that is the same double. Struct fields that are null are left out, as absent; nulls in arrays and maps stay.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.norm import bound

_SHORT = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}


def _text(c: Column) -> Column:
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    full = plain
    for i in range(32):
        full = F.replace(full, F.lit(chr(i)), F.lit(_SHORT.get(i, f"\\u{i:04x}")))
    return F.concat(F.lit('"'), F.when(c.rlike(r"[\x00-\x1f]"), full).otherwise(plain), F.lit('"'))


def _shortest(p: Column, x: Column) -> Column:
    """(digits, power), or fewer digits if they too are x: Java's may be one too many."""
    n = F.length(p.digits)

    def rounded(sum_: Column) -> Column:
        full = F.lpad(sum_, F.greatest(n - 1, F.length(sum_)), "0")
        return F.struct(F.rtrim(full, F.lit("0")).alias("digits"), (p.power + F.length(full) - (n - 1)).alias("power"))  # a carry makes one more

    up = F.when(F.right(p.digits, F.lit(1)) >= "5", 1).otherwise(0)
    fewer = rounded((F.left(p.digits, n - 1).cast("decimal(20,0)") + up).cast("decimal(20,0)").cast("string"))
    fits = lambda q: F.concat(F.lit("0."), q.digits, F.lit("e"), q.power.cast("string")).try_cast("double") == x
    return F.when(n > 1, bound(fewer, lambda q: F.when(F.coalesce(fits(q), F.lit(False)), q).otherwise(p))).otherwise(p)


def number(c: Column) -> Column:
    """A number as a double's shortest decimal in the notation of ECMAScript; not a number or infinite: the query stops."""
    x = F.abs(c.cast("double"))

    def written(parts: Column) -> Column:
        digits, power = parts.digits, parts.power  # the value is 0.digits * 10**power
        n = F.length(digits)
        plain = F.when(power <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power), digits)).when(power >= n, F.concat(digits, F.repeat(F.lit("0"), power - n))).otherwise(F.concat(F.left(digits, power), F.lit("."), F.substring(digits, power + 1, n)))
        e = power - 1
        small = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""), F.when(e < 0, "e").otherwise("e+"), e.cast("string"))
        return F.when((power > -6) & (power <= 21), plain).otherwise(small)

    def split(s: Column) -> Column:
        """Java writes 12.5, 1.25E10 and 1.25E-7."""
        mantissa, exponent = F.substring_index(s, "E", 1), F.coalesce(F.nullif(F.regexp_extract(s, "E(.*)$", 1), F.lit("")), F.lit("0")).cast("int")
        whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
        every = F.concat(whole, part)
        led = F.ltrim(every, F.lit("0"))
        power = exponent + F.length(whole) - (F.length(every) - F.length(led))
        return F.struct(F.rtrim(led, F.lit("0")).alias("digits"), power.cast("int").alias("power"))

    text = bound(bound(split(x.cast("string")), lambda p: _shortest(p, x)), written)
    sign = F.when(c.cast("double") < 0, "-").otherwise("")
    bad = F.isnan(x) | (x == float("inf"))
    return F.when(bad, F.raise_error(F.lit("canonical JSON has no such number"))).when(x == 0, "0").otherwise(F.concat(sign, text))


def _utf16(name: str) -> bytes:
    return name.encode("utf-16-be")


def canonical(c: Column, of: T.DataType) -> Column:
    """The canonical JSON of a column of type `of`; null for null."""
    if isinstance(of, T.StructType):
        members = []
        for name in sorted(of.names, key=_utf16):
            value = canonical(c.getField(name), of[name].dataType)
            members.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), value))
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")))
    if isinstance(of, T.ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(canonical(x, of.elementType), F.lit("null"))), ","), F.lit("]"))
    if isinstance(of, T.MapType):
        if not isinstance(of.keyType, T.StringType):
            raise TypeError("canonical JSON has names of text alone")
        entry = lambda e: F.struct(F.hex(F.encode(e.key, "UTF-16BE")).alias("at"), F.concat(_text(e.key), F.lit(":"), F.coalesce(canonical(e.value, of.valueType), F.lit("null"))).alias("text"))
        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(c), entry)), lambda e: e.text), ","), F.lit("}"))
    if isinstance(of, T.BooleanType):
        return c.cast("string")
    if isinstance(of, (T.ByteType, T.ShortType, T.IntegerType)):
        return c.cast("string")
    if isinstance(of, T.LongType):  # beyond 2**53 not every whole number is a double
        return F.when(c.between(-(2**53), 2**53), c.cast("string")).otherwise(number(c))
    if isinstance(of, T.NumericType):
        return F.when(c.isNotNull(), number(c))
    if isinstance(of, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return _text(c.cast("string"))
    raise TypeError(f"canonical JSON has no form of {of.simpleString()}")


def locator_hash(pointer: Column, of: T.StructType) -> Column:
    """The hash of a fragment's locator (source_id, snapshot_id and the locator fields used): of its canonical JSON, with the kind named."""
    kind = "fragment_representation_kind"
    fields = [pointer.getField(n).alias(n) for n in of.names if n != kind]
    whole = T.StructType([f for f in of.fields if f.name != kind]).add(kind, "string")
    return F.concat(F.lit("sha256:"), F.sha2(canonical(F.struct(*fields, F.lit("locator_jcs_v1").alias(kind)), whole), 256))


def span_hash(content: Column, start: Column, end: Column) -> Column:
    """The hash of bytes [start, end) of a snapshot; null where the span is not within it."""
    inside = (start >= 0) & (start <= end) & (end <= F.octet_length(content))
    return F.when(inside, F.concat(F.lit("sha256:"), F.sha2(F.substring(content, (start + 1).cast("int"), (end - start).cast("int")), 256)))
