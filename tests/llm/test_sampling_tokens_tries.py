"""Resampling, byte-level BPE and conversation tries against brute force, a library and SQL, with every odd case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexmill.llm import byte_bpe, conversation_trie, resampling
from lexmill.llm._spark import numbered

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, found string, score string, rank string, place long, ids string, eligible int"


def rows():
    r = random.Random(4)
    texts = [(i, " ".join(r.choice("an the of 12 naïve ÀÉ 日本 Ta-lo mi_su".split()) for _ in range(r.randint(0, 60)))) for i in range(200)]
    texts += [(200, None), (201, ""), (202, "İ ß ... x"), (None, "a b " * 30), (None, None), (7, texts[7][1]), (7, texts[7][1]), (203, "long text " * 40_000), (204, "🙂 " * 25)]
    return [(d, t, "x", "y", "z", 1, "i", 2) for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize(("longest", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 50, 35, 5)])
def test_resample(spark, docs, none, longest, buckets, percent, least):
    target = ["the an naïve of the", None, "12 12 日本"]
    s, t = Counter(), Counter()
    for _, text, *_ in rows():
        s.update(zlib.crc32(f.encode()) % buckets for f in features(text, longest)[1])
    for text in target:
        t.update(zlib.crc32(f.encode()) % buckets for f in features(text, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    want, drawable = [], []
    for d, text, *_ in rows():
        words, found = features(text, longest)
        weight = sum(math.floor(1000 * math.log(((t[b] + 1) * (S + buckets)) / ((s[b] + 1) * (T + buckets)))) for b in (zlib.crc32(f.encode()) % buckets for f in found))
        h = int(hashlib.sha256(f"2024:{d}".encode()).hexdigest()[:8], 16)
        score = None if d is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        want.append((d, len(found), weight, score))
        if d is not None and len(words) >= least:
            drawable.append((-score, d, len(want) - 1))
    rank = {i: n + 1 for n, (_, _, i) in enumerate(sorted(drawable)[: percent * len(drawable) // 100])}
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(docs, wanted, longest=longest, buckets=buckets, percent=percent, least_words=least)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((*w, rank.get(i))) for i, w in enumerate(want))
    assert resampling.resample(none, wanted).count() == 0
    assert {r.rank for r in resampling.resample(docs, wanted.limit(0)).collect()} > {1}
    drawn = {w[0] for i, w in enumerate(want) if i in rank}
    assert {r.doc_id for r in resampling.resampled(docs, wanted, longest=longest, buckets=buckets, percent=percent, least_words=least).select("doc_id", *SCHEMA.split()[2:3]).collect()} == drawn


def test_resampling_sql(spark, tmp_path):
    data = [r for r in rows() if r[0] is not None]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("the of the",), (None,)], "text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({resampling.SQL['op11_resampling']})").fetchall()
    assert sorted(map(repr, want)) == sorted(map(repr, map(tuple, resampling.op11_resampling(spark, str(tmp_path)).collect())))


def test_places_of_equal_rows(spark):
    """A third of all rows are alike: each still has a place of its own, in no task more than its range."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("v"), F.lit("x").alias("__salt")).repartition(5)
    got = numbered(df, "n", F.desc("v"))
    assert got.columns == ["v", "__salt", "n"]
    assert [r.v for r in sorted(got.collect(), key=lambda r: r.n)] == sorted([-1 if i % 3 == 0 else i for i in range(3000)], reverse=True)
    assert sorted(r.n for r in got.collect()) == list(range(3000))
    assert numbered(df.limit(0), "n", "v").count() == 0


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(byte_bpe.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.Vocabulary(ranks, public_tokenizers.PATTERN)


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def test_byte_bpe(docs, none, library):
    got = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    want = [(d, packed(library[0].encode_ordinary(t or "")), (t or "").encode()) for d, t, *_ in rows()]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, bytes(r.ids), bytes(r.decoded))) for r in got)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert byte_bpe.decode(byte_bpe.encode(none)).count() == 0


def test_decode_keeps_columns_and_nulls(spark):
    tokens = spark.createDataFrame([(1, packed([0, 5]), "q"), (2, None, "r"), (3, b"", "s")], "n long, ids binary, decoded string")
    got = {r.n: r.decoded for r in byte_bpe.decode(tokens).collect()}
    names = {v: k for k, v in byte_bpe.read_ranks(byte_bpe.vocabulary_path()).items()}
    assert got == {1: bytearray(names[0] + names[5]), 2: None, 3: bytearray()}


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_byte_bpe_is_the_library(library, text):
    assert byte_bpe.Encoder(library[1]).encode([text, "", text]) == [packed(library[0].encode_ordinary(text)), b"", packed(library[0].encode_ordinary(text))]


def test_byte_bpe_of_long_texts(library):
    texts = ["ab" * 30_000, " " * 5000 + "x", "a b\n" * 120_000, "é" * 4001, "it's they'LL 've \x1c\x85　 ½٣"]
    assert byte_bpe.Encoder(library[1]).encode(texts) == [packed(library[0].encode_ordinary(t)) for t in texts]


def test_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE", 6)
    monkeypatch.setattr(byte_bpe, "PIECES", 5)
    texts = [t or "" for _, t, *_ in rows()][:60]
    encoder = byte_bpe.Encoder(library[1])
    assert [encoder.encode([t])[0] for t in texts] == [packed(library[0].encode_ordinary(t)) for t in texts]


def test_perfect_hash_is_minimal(library):
    keys = sorted(library[1].ranks)
    known = byte_bpe.PerfectHash(keys)
    assert sorted(known.key.tolist()) == list(range(len(keys)))
    others = [k + b"~!" for k in keys[:500]]
    flat, long = np.frombuffer(b"".join(keys + others), np.uint8), np.array(list(map(len, keys + others)))
    assert known.find(flat, np.cumsum(long) - long, np.cumsum(long)).tolist() == [*range(len(keys)), *([-1] * 500)] if not set(others) & set(keys) else True
    assert byte_bpe.PerfectHash([b"one"]).find(np.frombuffer(b"onetwo", np.uint8), np.array([0, 3]), np.array([3, 6])).tolist() == [0, -1]


TURNS = "conv_id long, turn long, role string, text string, depth long, digest string, unit string"


def talks(seed, convs=160, long=40):
    """Shared beginnings, copies, one long conversation, ties, nulls and repeated rows."""
    r = random.Random(seed)
    out = []
    for c in range(convs):
        kind = c % 4
        n = long if c == 5 else r.randint(1, 6)
        for i in range(n):
            shared = kind == 0 or (kind == 1 and i < 2) or (kind == 2 and i < 1)
            out.append((c if c % 9 else c + 1000, i, "user" if i % 2 == 0 else "assistant", f"shared {i}" if shared else f"é{r.randint(0, 3)}"))
    out += [(500, None, None, None), (500, None, "user", "x"), (500, 3, "user", "a"), (500, 3, "user", "b"), (777, 0, "", ""), (777, 0, "", ""), (None, 0, "user", "lost"), (601, 0, "user", "one")]
    out += [(c, 1, "user", "only") for c in range(2001, 2040)]
    return out


def brute(paths):
    members, ends = defaultdict(set), defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()]


@pytest.mark.parametrize("unit", [None, 1, 7, 10**6])
def test_trie_against_brute_force(spark, unit):
    data = [x for x in talks(1) if x[0] != 500]
    paths = defaultdict(list)
    for c, _, role, text in sorted((x for x in data if x[0] is not None), key=lambda x: (x[0], x[1])):
        paths[c].append((role, text))
    df = spark.createDataFrame([(*x, 1, "d", "u") for x in data], TURNS).repartition(3)
    got = conversation_trie.prefix_trie(df, unit)
    assert got.columns == list(conversation_trie.COLUMNS)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, brute({c: tuple(p) for c, p in paths.items()})))


def test_trie_of_one_conversation_over_all_ranges(spark):
    """A conversation of most rows is sorted and summed over all ranges, its prefixes are heavy."""
    path = tuple(("r", f"t{i % 5}") for i in range(400))
    data = [(1, i, *t) for i, t in enumerate(path)] + [(2, i, *t) for i, t in enumerate(path[:300])] + [(c, 0, "r", f"z{c}") for c in range(3, 60)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    want = brute({1: path, 2: path[:300], **{c: (("r", f"z{c}"),) for c in range(3, 60)}})
    assert sorted(map(repr, map(tuple, conversation_trie.prefix_trie(df, 64).collect()))) == sorted(map(repr, want))


def test_louds_parents():
    assert conversation_trie.Louds(np.array([2, 0, 3, 1, 0, 0, 0])).parents().tolist() == [0, 0, 2, 2, 2, 3]


def test_ends_of_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 40)
    ends = spark.range(5000).select(F.lit(1).cast("long").alias("depth"), (F.col("id") % 3).alias("k1"), F.lit(5).cast("long").alias("k2"), F.col("id").alias("conv_id")).repartition(6)
    got = {r.k1: r.ends_sha256 for r in conversation_trie.heavy_ends(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(5000) if i % 3 == k).encode()).hexdigest() for k in range(3)}


def test_trie_sql(spark, tmp_path):
    data = [x for x in talks(2) if x[0] != 500] + [(250 + i, 0, None, None) for i in range(30)] + [(300 + i, None if i % 2 else 1, "user", "x" if i % 3 else None) for i in range(40)]
    spark.createDataFrame([(*x, 1, "d", "u") for x in data], TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(conversation_trie.COLUMNS)} FROM ({conversation_trie.SQL['op13_conversation_trie']})").fetchall()
    got = [tuple(r) for r in conversation_trie.op13_conversation_trie(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, got))
    assert any(r[1] == 0 and r[7] != conversation_trie.NOTHING for r in got)  # some rebuilt conversations have no turn


def test_trie_of_odd_tables(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversation_trie.prefix_trie(empty).count() == 0
    assert conversation_trie.trie(*conversation_trie.rebuilt(conversation_trie.digested(empty))).count() == 0
    null = spark.createDataFrame([(None, None, None, None, 1, "", ""), (4, None, None, None, 1, "", "")], TURNS)
    assert sorted((r.conv_id, r.depth, r.n_convs, r.saved_tokens) for r in conversation_trie.prefix_trie(null).collect()) == [(4, 0, 1, 0), (4, 1, 1, 0)]
    text = "é" * 300_000
    long = spark.createDataFrame([(1, 0, "u", text, 1, "", ""), (2, 0, "u", text, 1, "", ""), (3, 0, "u", text + "!", 1, "", "")], TURNS)
    assert {(r.conv_id, r.depth, r.saved_tokens) for r in conversation_trie.prefix_trie(long).collect()} == {(1, 0, 300_000), (1, 1, 300_000), (3, 1, 0)}


def test_license_names_versions_and_boundaries():
    from lexmill.llm import license_scan

    find = license_scan.automaton().iter
    labels = lambda text: set(license_scan.scan(text, find)[5].split(","))
    assert {"name:lgpl", "name:lgpl-2.1"} <= labels("under the GNU Lesser General Public License version 2.1 or later")
    assert {"name:bsd-3-clause"} <= labels("BSD-3-Clause license") and {"name:mpl", "name:mpl-2.0"} <= labels("MPL 2.0.") and "name:mpl" not in labels("an MPL of ours, 200 of them")
    assert {"apache", "name:apache", "name:apache-2.0"} <= labels("Apache License, Version 2.0") and {"cc-by", "name:cc-by-4.0", "name:cc-by-sa"} <= labels("CC BY 4.0, CC BY-SA")
    assert {"gpl", "name:gpl-3"} <= labels("GNU General Public License v3") and {"name:gpl-2"} <= labels("GPLv2 only")
    assert labels("xspdx-license-identifier: FOO spdx-license-identifier: MIT") == {"spdx:mit"}
    assert labels("the SPDX License Identifier is a tag") == {""} and labels("SPDX-License-Identifier:") == {"spdx:malformed"}


def test_license_scan_is_linear_in_one_line():
    import time

    from lexmill.llm import license_scan

    find = license_scan.automaton().iter
    unit = "SPDX-License-Identifier: MIT OR (Apache-2.0 AND BSD-3-Clause) gnu general public license x "
    took = []
    for size in (600_000, 1_200_000, 2_400_000, 4_800_000):
        text = unit * (size // len(unit))
        began = time.process_time()
        row = license_scan.scan(text, find)
        took.append(time.process_time() - began)
        assert row[1] == size // len(unit) and row[5].startswith("gpl,name:gpl,spdx:apache-2.0,spdx:bsd")
    assert took[3] < 14 * max(took[0], 0.05)


def test_language_by_ranges_of_grams(spark):
    """Filters beyond the bytes that may be broadcast are met range by range; the rows stay."""
    from lexmill.llm import language_id

    r = random.Random(6)
    letters = {"aa": [chr(c) for c in range(0x4E00, 0x4E00 + 24)], "bb": [chr(c) for c in range(0x4E00 + 8, 0x4E00 + 32)], "cc": list("abcdefghijk ")}
    prose = lambda k, n: "".join(r.choice(letters[k]) for _ in range(n))
    train = spark.createDataFrame([(prose(k, 3000), k) for k in letters for _ in range(12)], "text string, lang string")
    docs = spark.createDataFrame([(i, prose(k, 120)) for i, k in enumerate(list(letters) * 15)] + [(90, None), (91, "12"), (0, "abc"), (None, prose("cc", 50)), (92, "x")], "doc_id long, text string")
    one = sorted((repr(x.doc_id), x.lang_pred, round(x.score, 2)) for x in language_id.language_id(docs, train).collect())
    learned = language_id.Learned(train, language_id.SHARES, 1 << 15)
    assert learned.ranges > 1 and learned.words * learned.size <= 1 << 15
    many = sorted((repr(x.doc_id), x.lang_pred, round(x.score, 2)) for x in language_id.language_id(docs, train, most=1 << 15).collect())
    assert [x[:2] for x in many] == [x[:2] for x in one] and len(many) == 50
    assert all(abs(a[2] - b[2]) <= 0.05 for a, b in zip(one, many))
