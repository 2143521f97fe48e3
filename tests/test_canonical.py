"""Canonical JSON against a plain implementation."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import canonical


def number(x):
    """ECMAScript's notation from Python's shortest digits."""
    if x == 0:
        return "0"
    sign, x = ("-" if x < 0 else ""), abs(x)
    mantissa, _, exponent = repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    part = "" if part == "0" else part
    digits, power = (whole + part).lstrip("0"), int(exponent or 0) + len(whole)
    power -= len(whole + part) - len(digits)
    digits = digits.rstrip("0")
    n = len(digits)
    if -6 < power <= 21:
        text = "0." + "0" * -power + digits if power <= 0 else digits + "0" * (power - n) if power >= n else digits[:power] + "." + digits[power:]
    else:
        e = power - 1
        text = digits[0] + ("." + digits[1:] if n > 1 else "") + ("e" if e < 0 else "e+") + str(e)
    return sign + text


def plain(v, drop=True):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v) if abs(v) <= 2**53 else number(float(v))
    if isinstance(v, float):
        return number(v)
    if isinstance(v, str):
        short = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
        return '"' + "".join(short.get(c, f"\\u{ord(c):04x}" if c < " " else c) for c in v) + '"'
    if isinstance(v, list):
        return "[" + ",".join(plain(x) for x in v) + "]"
    items = sorted(v.items(), key=lambda kv: kv[0].encode("utf-16-be"))
    return "{" + ",".join(f"{plain(k)}:{plain(x)}" for k, x in items) + "}"


def test_numbers(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 1e21, 1e20, 123456789012345680000.0, 1e-6, 1e-7, 1.5e-7, 5e-324, 1.7976931348623157e308, 2e23, 1e23, 2.0e-3, 9007199254740993.0, 0.1, 1 / 3, 333333333.33333329, 4.5, 2**-44, 2.2250738585072014e-308, 9.5367431640625e-7, 1.0e16, 2**63 * 1.0, 9.999999999999999e22]
    values += [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(4000)) if x == x and abs(x) != float("inf")] + [r.randint(1, 10**6) / 10 ** r.randint(0, 9) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", canonical.number(F.col("v")).alias("s")).collect()
    assert [(x.v, x.s, number(x.v)) for x in rows if x.s != number(x.v)] == []
    with pytest.raises(Exception, match="no such number"):
        spark.createDataFrame([(float("nan"),)], "v double").select(canonical.number(F.col("v"))).collect()


def test_nested(spark):
    schema = "struct<b:string,a:array<struct<y:double,x:bigint>>,`\U0001f600`:int,`～`:boolean,m:map<string,array<string>>,`Z`:date,n:decimal(10,2)>"
    import datetime
    import decimal

    m = {"\U0001f600": ["x", None], "～": [], "a": None, "": ["\x00\x1f\x7f \"\\/"]}
    rows = [
        {"b": "é\n\t\b\f\r\x01日", "a": [{"y": 1.0, "x": 2**53 + 1}, None, {"y": None, "x": -3}], "\U0001f600": 1, "～": True, "m": m, "Z": datetime.date(2026, 1, 2), "n": decimal.Decimal("1.50")},
        {"b": None, "a": None, "\U0001f600": None, "～": None, "m": None, "Z": None, "n": None}, None,
    ]

    def sparse(v):
        if isinstance(v, dict):
            return {k: sparse(x) for k, x in v.items() if x is not None}
        return [sparse(x) for x in v] if isinstance(v, list) else float(v) if isinstance(v, decimal.Decimal) else str(v) if isinstance(v, datetime.date) else v

    want = [None if r is None else plain({k: (v if k == "m" else sparse(v)) for k, v in r.items() if v is not None}) for r in rows]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, s {schema}")
    got = df.select("i", canonical.canonical(F.col("s"), df.schema["s"].dataType).alias("j")).orderBy("i").collect()
    assert [g.j for g in got] == want
    with pytest.raises(TypeError):
        canonical.canonical(F.col("x"), T.BinaryType())


def test_hashes(spark):
    df = spark.createDataFrame([(("s", "n", 3, [0.5, 1.0], None), b"abcdef", 1, 3), (("s", "n", None, None, "q"), b"abc", 2, 9)], "p struct<source_id:string,snapshot_id:string,page_number:int,bbox:array<double>,quote:string>, c binary, a int, b int")
    one, two = df.select(canonical.locator_hash(F.col("p"), df.schema["p"].dataType).alias("h"), canonical.span_hash(F.col("c"), F.col("a"), F.col("b")).alias("s")).collect()
    text = '{"bbox":[0.5,1],"fragment_representation_kind":"locator_jcs_v1","page_number":3,"snapshot_id":"n","source_id":"s"}'
    assert one.h == "sha256:" + hashlib.sha256(text.encode()).hexdigest() and one.s == "sha256:" + hashlib.sha256(b"bc").hexdigest()
    assert two.h != one.h and two.s is None
