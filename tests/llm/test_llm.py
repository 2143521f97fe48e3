"""The operators of lexmill.llm against brute force, on small tables with every odd case."""

import hashlib
import heapq
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from lexmill.llm import decontaminate, jaccard_join, language_id, license_scan, media, mixing, passage_dedup, quality, suffix_dedup, token_counts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, id string, component_id long, slot string, a string, b string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def words(s):
    return WORD.findall(lower(s))


def prose(seed, n, syllables="an the of er in ta lo mi su ka ri po de".split()):
    r = random.Random(seed)
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows():
    base, shared = prose(1, 120), prose(2, 70)
    edited = base.split()
    edited[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, "one"), (7, "one two three"), (8, "One two three"), (9, prose(3, 90) + " " + shared), (10, shared + " " + prose(4, 60)),
        (11, prose(5, 40) + "\n" + shared + "\n" + prose(6, 30)), (12, prose(7, 9000)), (13, "!!! ... ???"), (14, "naïve ß İstanbul ÀÉ <|endoftext|> 12 ½ \x1c\x85 日本"), (None, base), (None, None), (15, base + " tail"), (7, "one two three"), (16, "line\n" * 60), (17, "line\n" * 70),
    ]
    return [(d, t, "en" if d and d % 2 else None, None if d == 9 else "s0" if d and d % 3 else "s1", 1, "x", 2, "y", "p", "q") for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix_dedup(docs, none):
    data = [(d, (t or "").encode()) for d, t, *_ in rows() if d is not None]
    least = {}
    for d, b in data:
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(least.get(b[i : i + 50], d), d)
    want = {}
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\x01" * 50
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        want[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    got = [r for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert len(got) == len(rows())
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.vocabulary_path())
    got = token_counts.token_counts(docs, limit=100).collect()
    texts = {d: t or "" for d, t, *_ in rows()}
    for r in got:
        if r.doc_id is not None:
            n = len(library.encode(texts[r.doc_id], add_special_tokens=False))
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 100)
    assert len(got) == len(rows()) and token_counts.token_counts(none).count() == 0


@pytest.mark.parametrize("text", ["it's we'll 'S don't 3.14 2²", "ÀÉÎ ﬁne Σας", "<|startoftext|>a <|endoftext|>", "a" * 3000, "\x1c x\x85y", "日本 語", "é́ decomposed"])
def test_token_counter_is_the_library(text):
    counter = token_counts.TokenCounter(token_counts.vocabulary_path(), {})
    assert counter.count(text) == counter.encoded(text)


@pytest.mark.parametrize("context", ["{}", "a{}b", "A{}A", "it'{} 1{}2"])
def test_every_code_point_counts_as_in_the_library(context):
    counter = token_counts.TokenCounter(token_counts.vocabulary_path(), {})
    for c in [c for c in range(0x300) if chr(c).isprintable() or c < 32] + [0x1E9E, 0x2019, 0x2014, 0x3A3, 0x65E5, 0x1F600]:
        text = context.format(chr(c), chr(c))
        assert counter.count(text) == counter.encoded(text), hex(c)
    points = [c for c in (*range(0x32000), *range(0xE0000, 0xE0200)) if not 0xD800 <= c < 0xE000]  # all that are assigned
    for k in range(0, len(points), 4096):
        text = " ".join(context.format(chr(c), chr(c)) for c in points[k : k + 4096])
        assert counter.count(text) == counter.encoded(text), hex(points[k])


def test_passages(docs, none, spark):
    got = {r.doc_id: r for r in passage_dedup.passage_report(docs).collect() if r.doc_id is not None}
    assert got[2].n_repeated == got[2].n_words == 120 and got[2].repeats == 1  # an equal text
    assert got[3].repeats == 1 and got[3].n_repeated >= 110  # one word changed
    assert got[15].n_repeated >= 120
    for d in (10, 11):  # seventy shared words among others
        assert got[d].repeats == 9 and 70 <= got[d].n_repeated <= 76 and got[d].class_id == 9
    assert got[17].n_repeated >= 60
    for d in (1, 4, 5, 6, 7, 8, 9, 12, 13, 14, 16):
        assert got[d].n_repeated == 0
    assert passage_dedup.passage_report(none).count() == 0
    kept = {r.doc_id: r for r in passage_dedup.without_repeats(docs).collect()}
    assert 2 not in kept and kept[1].text == prose(1, 120) and words(kept[10].text) == words(prose(4, 60))[len(words(prose(4, 60))) - len(words(kept[10].text)) :]
    assert kept[9].slot == "y" and kept[4].text is None


def shingled(numbers):
    return np.array([hash(tuple(numbers[k : k + 5])) & (2**63 - 1) for k in range(len(numbers) - 4)], np.uint64)


def reaches(x, y, least):
    """Places of y in any stretch from shared to shared shingle, or of `least`, that has a Jaccard of 0.8 with one of x."""
    marked, px, py = np.zeros(len(y), bool), set(x.tolist()), set(y.tolist())
    for s in range(len(y) - least + 1):
        for t in range(s + least, len(y) + 1):
            if t - s > least and not (int(y[s]) in px and int(y[t - 1]) in px):
                continue
            right = set(y[s:t].tolist())
            if marked[s:t].all() or 100 * len(right & px) < 80 * len(right):
                continue
            for p in range(len(x) - least + 1):
                if any(100 * len(right & left) >= 80 * len(right | left) for q in range(p + least, min(len(x), p + (t - s) * 5 // 4 + 1) + 1) for left in [set(x[p:q].tolist())]):
                    marked[s:t] = True
                    break
    return marked


def test_every_edit_is_verified():
    for n in (50, 51, 55, 60, 72, 80, 97, 120):
        plain = list(range(n))
        for at in range(n):
            for edited in (plain[:at] + [-1] + plain[at + 1 :], plain[:at] + [-1] + plain[at:], plain[:at] + plain[at + 1 :]):
                x, y = shingled(plain), shingled(edited)
                same, every = len(set(x.tolist()) & set(y.tolist())), len(set(x.tolist()) | set(y.tolist()))
                if len(y) >= 46 and 100 * same >= 80 * every:  # the whole texts are near, so all of y is to be found but unshared ends
                    found = passage_dedup.near_passages(x, y, 46, 80)
                    assert found and max(t for _, t in found) - min(s for s, _ in found) >= len(y) - 5, (n, at)
    for gap in (45, 60):  # a word changed every so many words
        for shift in range(0, gap, 5):
            plain = list(range(gap * 4))
            edited = [-w - 1 if w % gap == shift else w for w in plain]
            x, y = shingled([*range(-900, -860), *plain]), shingled([*edited, *range(-500, -470)])
            found = passage_dedup.near_passages(x, y, 46, 80)
            assert found and sum(t - s for s, t in found) >= gap * 3 - 5, (gap, shift)


def test_verification_against_brute_force():
    r = random.Random(8)
    for case in range(12):
        plain = list(range(58))
        edited = list(plain)
        for _ in range(case % 3 + 1):
            at = r.randrange(len(edited))
            edited[at : at + r.randint(0, 1)] = [1000 + r.randrange(99)] * r.randint(0, 1)
        x, y = shingled([*range(200, 205), *plain]), shingled([*edited, *range(300, 304)])
        got, want = np.zeros(len(y), bool), reaches(x, y, 46)
        for s, t in passage_dedup.near_passages(x, y, 46, 80):
            assert t - s >= 46
            got[s:t] = True
        shared = np.isin(y, x)
        assert not (want & shared & ~got).any() and not (got & ~want).any(), case


def test_windows_against_brute_force():
    r = np.random.default_rng(3)
    for n, least in ((60, 5), (200, 46), (46, 46), (30, 46)):
        values = r.integers(0, 2**40 if n > 60 else 6, n).astype(np.uint64) << np.uint64(24)
        text, first, centre, last = passage_dedup.compact_windows(values, np.array([0, n]), least)
        found = set(zip(first.tolist(), centre.tolist(), last.tolist()))
        for i in range(n - least + 1):
            for j in range(i + least - 1, n):
                c = i + int(np.argmin(values[i : j + 1]))
                assert any(f <= i and k == c and j <= e for f, k, e in found)


def test_quality_held_out(spark, none):
    r = random.Random(1)
    texts = [(i, prose(100 + i, r.randint(30, 80)) + "." if i % 3 else "!! ".join(prose(100 + i, r.randint(30, 80)).upper().split()), int(i % 3 > 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(999, None), (998, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in texts if i < 160] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.score for x in quality.quality_scores(docs, labels).collect()}
    assert sum((got[i] >= 0.7) == bool(q) for i, _, q in texts if i >= 160) >= 78
    assert 0 < got[999] == got[998] < 1
    assert quality.quality_scores(docs, labels.where("false")).where("score = 0.5").count() == 242
    assert quality.quality_scores(none, labels).count() == 0


def test_quality_against_plain_votes(spark):
    """Blocked products against one document at a time; repeated rows, ties of equal labelled texts, clashing names, texts over a chunk."""
    r = random.Random(6)
    texts = [(i, prose(500 + i % 50, r.randint(20, 60)) + "!?."[i % 3]) for i in range(90)] + [(200, prose(3, 60_000)), (201, None), (7, "again " + prose(9, 30))]
    labels = [(i, i % 2) for i in range(60)] + [(3, 0)]
    docs = spark.createDataFrame([(*t, 1, 0.5, "x") for t in texts], "doc_id long, text string, quality int, score double, counts string").repartition(3)
    got = sorted((x.doc_id, round(x.score, 4)) for x in quality.quality_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect())
    by_id = [(d, q, t or "") for d, q in labels for e, t in texts if d == e]
    counts = quality.features([t.encode() for _, _, t in by_id])
    rows_ = sorted(zip(by_id, counts), key=lambda x: (x[0][0], x[0][1], x[1].astype(np.int32).tobytes()))
    label, counts = np.array([x[0][1] for x in rows_], float), np.stack([x[1] for x in rows_])
    idf, basis, vectors = quality.fit(counts, 48)
    want = []
    for d, t in texts:
        v = (quality.unit(quality.weighted(quality.features([(t or "").encode()]), idf) @ basis) @ vectors.T)[0]
        best = np.sort(v)[::-1]
        weight = np.where(v >= best[14], np.maximum(v, 0).astype(float) ** 8, 0)
        want.append((d, round(float((weight * label).sum() / weight.sum()) if weight.sum() > 1e-9 else label.mean(), 4)))
    assert len(got) == len(texts) and sum(abs(a[1] - b[1]) > 0.02 for a, b in zip(got, sorted(want))) <= 2
    assert [a[0] for a in got] == sorted(d for d, _ in texts)


def test_license_scan(docs, none, spark):
    texts = {1: "The GNU General Public License; gnu, general PUBLIC license", 2: "Apache License, apache license apache\nlicense", 3: "cc by cc-by CC/BY ccby", 4: None, 5: "mit license", 6: "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception */", 7: "SPDX-License-Identifier: MIT AND (", 8: "x mit licenses"}
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for d, t in texts.items():
        w, starts, names = words(t), [], set()
        for phrase, label in license_scan.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    names.add(label)
        assert (got[d].n_words, got[d].n_base, got[d].first_word, got[d].last_word, got[d].base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)))
        assert names <= set(got[d].labels.split(",")) | {""}
    assert got[6].labels == "spdx:apache-2.0,spdx:gpl-2.0-only,spdx:llvm-exception,spdx:mit" and got[6].freedom == 1.0
    assert got[7].labels == "spdx:malformed,spdx:mit" and got[4].score == 0
    assert license_scan.license_scan(docs).count() == len(rows()) and license_scan.license_scan(none).count() == 0


def test_every_tag_of_a_line():
    find = license_scan.automaton().iter
    tag = "SPDX-License-Identifier: "
    for gap in (" ", " some words; ", " */ "):
        row = license_scan.scan(f"a {tag}MIT{gap}{tag}GPL-2.0{gap}{tag}(Apache-2.0 OR X)", find)
        assert row[5] == "spdx:apache-2.0,spdx:gpl-2.0,spdx:mit,spdx:x" and row[6] == 1 - 0.5**6 and row[7] == pytest.approx(2.3 / 3)
    assert license_scan.scan(f"{tag}MIT\nAND GPL-2.0 {tag}ISC\r\nrest", find)[5] == "spdx:isc,spdx:mit"
    assert license_scan.scan(f"{tag}{tag}MIT", find)[5] == "spdx:malformed,spdx:mit"


@pytest.mark.parametrize("text,want", [("MIT", 1.0), ("MIT AND GPL-3.0", 0.3), ("MIT OR GPL-3.0", 1.0), ("GPL-2.0 OR MIT AND LGPL-2.1", 0.6), ("(GPL-2.0 OR MIT) AND LGPL-2.1", 0.6), ("GPL-2.0 WITH x", 0.4), ("AND MIT", None), ("MIT OR", None), ("(MIT", None), ("()", None), ("", None)])
def test_expressions(text, want):
    postfix = license_scan.parse_expression(text)
    assert postfix is None if want is None else license_scan.evaluate(postfix) == pytest.approx(want)


def test_mixing(spark, docs, none):
    many = spark.createDataFrame([(i, "s%d" % (0 if i % 3 == 0 else i % 7), 1, 2) for i in range(4000)], "doc_id long, source string, __key long, SLOT int")
    weights = {"s0": 0.4871, "s1": Fraction(1, 3), "s2": "0.07", "s3": 1e-3, "s4": 0, "s5": -1}
    got = mixing.mix(many, weights, block=4).toPandas()
    assert len(got) == 4000 and got[got.source.isin(["s4", "s5", "s6"])].slot.isna().all() and set(got.columns) == {"doc_id", "source", "__key", *mixing.ADDED}
    placed = got[got.slot.notna()]
    assert placed.position.is_unique and placed.groupby("slot").source.nunique().max() == 1
    within = placed[placed.within_target]
    assert ((within.slot >= within.release) & (within.slot < within.deadline)).all() and (within.slot.max() < placed[~placed.within_target].slot).all()
    assert within.slot.nunique() == within.slot.max() + 1
    total = sum(Fraction(str(w)) for w in weights.values() if Fraction(str(w)) > 0)
    by_slot = within.groupby("slot").source.first().sort_index()
    for s, w in weights.items():
        done = (by_slot == s).cumsum().tolist()
        assert all(abs(n - max(Fraction(str(w)), 0) / total * (t + 1)) < 1 for t, n in enumerate(done))
    assert mixing.mix(docs).count() == len(rows()) and mixing.mix(none).count() == 0 and mixing.mix(docs, {}).where("slot IS NULL").count() == len(rows())


@pytest.mark.parametrize("weights", [[5003, 3001, 1999, 7, 1], [10**9 + 7, 10**9 + 7, 10**6], [3] * 40 + [1] * 70])
def test_mixing_windows_are_one_schedule(spark, weights):
    """Against earliest deadline first in one go, over many windows."""
    p, blocks = sum(weights), [w * 20_000 // sum(weights) + 50 for w in weights]
    ran, one = mixing.schedule(spark.createDataFrame([(f"s{i:03}", 4 * n, w) for i, (n, w) in enumerate(zip(blocks, weights))], "key string, n long, w long"), 4)
    got = [(r.key, r.block_no) for r in ran.orderBy("slot").collect()]
    ready, wait, want = [], [(0, j, 0) for j in range(len(weights))], []
    for t in range(len(got)):
        while wait and wait[0][0] <= t:
            _, j, k = heapq.heappop(wait)
            heapq.heappush(ready, (-(-(k + 1) * p // weights[j]), j, k))
        due, j, k = heapq.heappop(ready)
        assert t < due
        want.append((f"s{j:03}", k))
        heapq.heappush(wait, ((k + 1) * p // weights[j], j, k + 1))
    assert got == want and want[one.collect()[0].horizon][1] == blocks[int(want[one.collect()[0].horizon][0][1:])]
    done = np.zeros(len(weights))
    for t, (s, _) in enumerate(got):
        done[int(s[1:])] += 1
        assert (np.abs(done - np.array(weights) / p * (t + 1)) < 1 + 1e-9).all()


def test_mixing_sql(spark, tmp_path):
    many = spark.createDataFrame([(i, None if i % 50 == 0 else "s%d" % min(i % 9, 5)) for i in range(1500)], "doc_id long, source string")
    many.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(mixing.SQL["op6_mixing"]).df()
    got = mixing.op6_mixing(spark, str(tmp_path)).toPandas()
    order = sorted(got.columns)
    assert got.sort_values("doc_id")[order].astype(str).values.tolist() == want.sort_values("doc_id")[order].astype(str).values.tolist()


def test_jaccard_join(spark, docs, none, tmp_path):
    r = random.Random(9)
    texts = [(d, t) for d, t, *_ in {x[0]: x for x in rows() if x[0] is not None}.values()]
    for k in range(12):  # families of near copies, some just at the threshold
        w = prose(300 + k, r.randint(20, 150)).split()
        for j in range(8):
            v = list(w)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                v[r.randrange(len(v))] = r.choice(["x", "y", "zz"])
            texts.append((100 + 10 * k + j, " ".join(v)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    frame.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = {tuple(x) for x in con.execute(jaccard_join.SQL["op7_jaccard_join"]).df()[["doc_id", "n_shingles", "component_id"]].values.tolist()}
    assert {tuple(x) for x in jaccard_join.linked(frame).collect()} == want
    assert jaccard_join.linked(docs).count() == len(rows()) and jaccard_join.linked(none).count() == 0
    kept = [r.doc_id for r in jaccard_join.one_of_each(docs).collect()]
    assert 2 not in kept and 15 not in kept and {1, 4, 5, 13} <= set(kept) and kept.count(None) == 2


@pytest.mark.parametrize("leaf,hot,block", [(256, 1000, 1024), (4, 1000, 3), (4, 10, 1024), (2, 3, 2)])
def test_jaccard_regions_divide_exactly(spark, tmp_path, monkeypatch, leaf, hot, block):
    """Documents that share most of their shingles without being linked, and links across cells: the same components however regions are divided."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = random.Random(leaf)
    common, texts = prose(70, 60).split(), []
    for k in range(25):
        own = common + prose(400 + k, r.randint(2, 30)).split()
        for _ in range(r.randint(1, 5)):
            v = list(own)
            for _ in range(r.randint(0, 4)):
                v[r.randrange(len(v))] = r.choice(["x", "y", "zz"])
            texts.append((len(texts), " ".join(v)))
    r.shuffle(texts)
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    frame.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = {tuple(x) for x in con.execute(jaccard_join.SQL["op7_jaccard_join"]).df()[["doc_id", "n_shingles", "component_id"]].values.tolist()}
    assert {tuple(x) for x in jaccard_join.linked(frame, leaf=leaf, hot=hot).collect()} == want and len({c for _, _, c in want}) > 3


def picture(seed, n=150):
    r = np.random.default_rng(seed)
    out = np.full((n, n), 128.0)
    for _ in range(60):
        y, x = r.integers(0, n - 12, 2)
        h, w = r.integers(6, 30, 2)
        out[y : y + h, x : x + w] = r.integers(0, 255)
    return out


def test_media(spark):
    def image(a):
        a = np.clip(a, 0, 255).astype(np.uint8)
        return (a.shape[0], a.shape[1], 1, a.tobytes())

    noise = np.random.default_rng(1)
    data = []
    for k in range(1, 9):
        a = picture(k)
        data.append((10 * k, image(a)))
        if k < 4:
            data += [(10 * k + 1, image(a[20:140, 10:130])), (10 * k + 2, image(a * 0.8 + 20 + noise.normal(0, 3, a.shape))), (10 * k + 3, image(np.rot90(a))), (10 * k + 4, image(media.resized(a.astype(np.float32), 120, 120))), (10 * k + 5, image(a))]
    data += [(1, None), (2, (4, 4, 1, b"\x00" * 16)), (3, (9, 9, 1, b"short")), (4, (60, 60, 1, bytes(3600))), (5, (60, 60, 1, bytes(3600))), (None, image(picture(1)))]
    got = {r.media_id: r for r in media.image_classes(spark.createDataFrame(data, T.StructType([T.StructField("media_id", T.LongType()), T.StructField("image", media.IMAGE)]))).collect()}
    for i, r in got.items():
        assert r.class_id == (i // 10 * 10 if i >= 10 else 4 if i == 5 else i), i
    assert len(got) == len(data) - 1 and got[10].n_links >= 4 and got[80].n_links == 0


def test_media_recall(spark):
    """The tables against judging all pairs: crops, brightness, noise, turns and scales of forty pictures; and a picture that many have a part of."""
    r, data = np.random.default_rng(2), []
    logo = picture(999, 50)
    for k in range(40):
        a = picture(50 + k, 130 + k)
        if k % 4 == 0:
            a[40:90, 40:90] = logo
        copies = [a, a[10:-15, 12:-8], a * 0.7 + 30 + r.normal(0, 6, a.shape), np.rot90(a, k % 4), media.resized(a.astype(np.float32), 110, 110)]
        data += [(10 * k + i, np.clip(c, 0, 255).astype(np.uint8)) for i, c in enumerate(copies)]
    keys = {i: media.keypoints(media.gray(*c.shape, 1, c.tobytes())).tobytes() for i, c in data}
    ids = sorted(keys)
    want = {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if (a // 10 == b // 10 or (a + b) % 7 == 0) and media.alike(keys[a], keys[b], 40, 8)}
    rows_ = [(i, (*c.shape, 1, c.tobytes()), "x", 1) for i, c in data]
    frame = spark.createDataFrame(rows_ + rows_[:3], T.StructType([T.StructField("media_id", T.LongType()), T.StructField("image", media.IMAGE), T.StructField("class_id", T.StringType()), T.StructField("n", T.IntegerType())]))
    got = {x.media_id: x for x in media.image_classes(frame).collect()}
    together = sum(got[a].class_id == got[b].class_id for a, b in want)
    assert len(want) > 250 and together >= 0.9 * len(want), (together, len(want))
    links = sum(x.n_links for x in got.values()) / 2
    assert links >= 0.9 * len([1 for a, b in want if a // 10 == b // 10]), (links, len(want))
    assert media.image_classes(frame).count() == len(rows_) + 3 and media.image_classes(frame.where("false")).count() == 0


@pytest.mark.parametrize("block", [4096, 10])
def test_media_links_in_large_groups(spark, monkeypatch, block):
    """Groups of far more than ALL images, in one block and in several: every link of brute force over all pairs that meet often enough is there."""
    monkeypatch.setattr(media, "BLOCK", block)
    r = np.random.default_rng(8)
    data = []
    for k in range(3):
        a = media.resized(r.integers(0, 255, (20, 20)).astype(np.float32), 130, 130)
        for n in range(14):  # of equal descriptors, but not of equal pixels
            copy = a.astype(np.uint8)
            copy[0, n] ^= 1
            data.append((100 * n + k, copy))
    keys = {i: media.keypoints(media.gray(*a.shape, 1, a.tobytes())) for i, a in data}
    groups = {i: set(media.entries([k], np.zeros(1, np.int64))[0].tolist()) for i, k in keys.items()}
    want = dict.fromkeys(keys, 0)
    for a in keys:
        for b in keys:
            if a < b and len(groups[a] & groups[b]) >= 8 and media.alike(keys[a].tobytes(), keys[b].tobytes(), 40, 8):
                want[a], want[b] = want[a] + 1, want[b] + 1
    assert max(want.values()) == 13  # all pairs of a picture's fourteen copies
    rows = [(i, (*a.shape, 1, a.tobytes())) for i, a in data]
    got = media.image_classes(spark.createDataFrame(rows, T.StructType([T.StructField("media_id", T.LongType()), T.StructField("image", media.IMAGE)]))).collect()
    assert {x.media_id: x.n_links for x in got} == want
    assert all(x.class_id == x.media_id % 100 for x in got)


def test_language(spark, docs, none):
    kinds = {"xx": "an the of er in".split(), "yy": "zu kö ßa mi or".split(), "zz": "qui ñe ló ta ur".split()}
    train = spark.createDataFrame([(i, prose(i, 60, kinds[k]), k) for i, k in enumerate(list(kinds) * 30)] + [(500, None, "xx"), (501, "the", None)], "doc_id long, text string, lang string")
    test = spark.createDataFrame([(i, prose(1000 + i, 25, kinds[k]), k) for i, k in enumerate(list(kinds) * 10)] + [(90, "123 !!", "xx"), (91, None, "yy"), (92, "", "zz"), (93, "the", "xx")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.language_id(test, train).collect()}
    assert all(got[i].lang_pred == k for i, k in enumerate(list(kinds) * 10)) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (90, 91, 92)) and got[93].lang_pred == "xx"
    assert {r.lang_pred for r in language_id.language_id(docs, train.where("false")).collect()} == {"und"} and language_id.language_id(none, train).count() == 0


def test_language_filters_hold_the_exact_sets(spark):
    """More than 64 languages; bits against sets of grams; ties go to the language of more grams, then by name."""
    r = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 300)]
    texts = {f"l{k:02}": "".join(r.choice(letters[3 * k : 3 * k + 9]) for _ in range(400)) for k in range(90)}
    texts |= {"same_b": "zyzyzy zyzy", "same_a": "zyzyzy zyzy", "rich": "qrs qrs qrs", "poor": "qrs qrs"}
    train = spark.createDataFrame([(t, k) for k, t in texts.items()], "text string, lang string")
    names, masks, rates = language_id.learn(train, (0.01,))
    assert set(names) == set(texts) and rates.shape == (len(names), 2)
    every = np.unique(language_id.grams([t.encode() for t in texts.values()])[0])
    at = list(language_id.slots(every, masks.shape[1]))
    wrong = 0
    for i, name in enumerate(names):
        found, n = np.unique(language_id.grams([texts[name].encode()])[0], return_counts=True)
        for level, want in enumerate((found, found[n >= 0.01 * n.sum()])):
            word, bit = divmod(2 * i + level, 64)
            inside = np.logical_and.reduce([(masks[word][x] >> np.uint64(bit)) & np.uint64(1) for x in at])
            assert inside[np.isin(every, want)].all()
            wrong += int(inside.sum()) - len(want)
    assert wrong <= 5
    test = spark.createDataFrame([(1, "zyzy"), (2, "qrs"), *((10 + k, texts[f"l{k:02}"][50:90]) for k in range(90)), (1, "zyzy")], "doc_id long, text string")
    got = [(x.doc_id, x.lang_pred) for x in language_id.language_id(test, train).collect()]
    assert got.count((1, "same_a")) == 2 and (2, "rich") in got and all((10 + k, f"l{k:02}") in got for k in range(90))


def test_recognised_keeps_columns(spark):
    kinds = {"xx": "an the of er in".split(), "yy": "zu kö ßa mi or".split()}
    data = [(i, prose(i, 60, kinds[k]), k if i % 5 else None, 1, 2) for i, k in enumerate(list(kinds) * 20)] + [(None, prose(1, 9), None, 3, 4), (0, prose(0, 60, kinds["xx"]), None, 5, 6), (90, "123", "xx", 7, 8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, __id int, LANG_PRED int")
    got = language_id.recognised(docs, docs)
    assert got.columns == docs.columns
    rows_ = got.collect()
    assert len(rows_) == len(data) - 1 and sorted(r.LANG_PRED for r in rows_) == [2] * 40 + [4, 6]
    assert all(r.lang == list(kinds)[r.doc_id % 2] for r in rows_ if r.doc_id is not None)


def test_decontaminate(spark, docs, none):
    items = [(1, prose(50, 30)), (2, prose(51, 13)), (3, "short item here"), (4, None), (5, ""), (None, prose(52, 20)), (6, prose(51, 13)), (10, prose(53, 40))]
    texts = [(1, prose(60, 100) + " " + items[0][1] + " " + prose(61, 50)), (2, "A SHORT, item -- here!"), (3, items[1][1].upper()), (4, None), (5, ""), (6, prose(62, 2000) + " " + " ".join(items[7][1].split()[5:25])), (7, items[5][1]), (8, prose(63, 200)), (9, items[0][1] + " " + items[0][1])]
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    split = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=40).collect()}
    for d, t in texts:
        w, hit, ids = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == v[k : k + n]:
                        hit.update(range(p, p + n))
                        ids |= {str(i)} if i is not None else set()
        want = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
        for r in (got[d], split[d]):
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want
    assert got[9].longest == 30
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert decontaminate.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0 and decontaminate.contamination(none, bench).count() == 0
    assert sorted(r.doc_id for r in decontaminate.decontaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()) == [4, 5, 6, 8]


def test_decontaminate_rows_in_many_blocks(spark):
    item, other = prose(50, 30), prose(51, 13)
    bench = spark.createDataFrame([(1, item), (2, other), (3, prose(53, 40))], "item_id long, text string")
    texts = [(None, prose(60, 100)), (None, item), (None, None), (None, prose(61, 500) + " " + other), (7, other), (7, other), (7, prose(62, 50)), (8, item + " " + other), (9, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    one, many = ([tuple(r) for r in decontaminate.contamination(frame, bench, block_words=n).collect()] for n in (2_000_000, 40))
    assert len(one) == len(texts) and sorted(one, key=str) == sorted(many, key=str)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(40)]
    item = prose(900, 30)
    odd = [(100, base[0][1], "en", "s0"), (101, base[1][1] + " more", "en", "s1"), (102, prose(70, 80) + " " + " ".join(base[2][1].split()[20:90]), None, "s2"), (103, item + " " + prose(71, 30), "en", "s0"), (104, None, None, None), (105, "!!!", "en", "s1")]
    full = spark.createDataFrame([(*r, len(r[1] or "")) for r in base + odd], "doc_id long, text string, lang string, source string, n_chars long")
    full.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*range(40), 102}
    assert words(out[102].text) == words(prose(70, 80)) and out[102].lang == "en" and all(out[i].text == base[i][1] for i in range(40))
    assert sorted(r.position for r in out.values()) == sorted({r.position for r in out.values()})
    first = corpus_pipeline.STAGES[0][1](spark, full, str(tmp_path))
    assert first.columns == full.columns


def odd_corpus(spark, path, empty=False):
    item = prose(900, 30)
    clash = {"__id": 1, "__bad": 2, "__copy": 3, "__spans": 4, "__key": 5, "__part": 6, "component_id": 7, "SLOT": 8}
    texts = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(30)]
    texts += [(None, prose(0, 120), None, None), (None, None, None, "s1"), (5, prose(5, 120), "en", "s2"), (6, prose(600, 90), "en", "s0"), (40, prose(41, 30_000), "en", "s0"), (41, prose(42, 60) + " " + prose(41, 30_000)[200:900], "en", None), (42, item, "en", "s1"), (43, "", "en", "s1")]
    texts += [(50 + i, texts[i][1].replace(" ", "  ", 1), "en", "s0") for i in range(3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in clash)
    rows_ = [] if empty else [(*t, len(t[1] or ""), *clash.values()) for t in texts]
    docs = spark.createDataFrame(rows_, schema)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, texts


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null and repeated doc_ids, clashing columns and long texts, stage by stage."""
    import corpus_pipeline

    docs, texts = odd_corpus(spark, str(tmp_path))
    now = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        now[name] = docs.collect()
    ids = {name: sorted((r.doc_id for r in rows_ if r.doc_id is not None)) for name, rows_ in now.items()}
    assert ids["language_id"] == sorted(d for d, t, *_ in texts if d is not None and t)
    assert ids["jaccard_join"] == [*range(5), 5, 5, 6, 6, *range(7, 30), 40, 41, 42]  # copies with other white space go, rows of one doc_id stay together
    assert all(sum(r.doc_id is None for r in rows_) == 2 for rows_ in now.values())
    cut = next(r for r in now["passage_dedup"] if r.doc_id == 41)
    assert words(cut.text)[:60] == words(prose(42, 60)) and len(words(cut.text)) <= 65
    assert ids["decontaminate"] == [i for i in ids["passage_dedup"] if i != 42]
    assert ids["mixing"] == ids["decontaminate"] and len({r.position for r in now["mixing"]}) == len(now["mixing"])
    assert all((r["__id"], r["__bad"], r["__copy"], r["__spans"], r["__key"], r["__part"], r["component_id"]) == (1, 2, 3, 4, 5, 6, 7) for r in now["mixing"])


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs, _ = odd_corpus(spark, str(tmp_path), empty=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "mixing" or out.columns == docs.columns)


def test_passages_do_not_depend_on_the_split(spark):
    """The same rows however the table is split, and the recall of the windows: edited passages among families that share lead-ins."""
    r, data = random.Random(12), []
    for k in range(12):
        lead, body = prose(800, 12).split(), prose(801 + k, 70).split()
        for j in range(6):
            v = list(body)
            for _ in range(j % 3):
                v[r.randrange(len(v))] = "changed%d" % r.randrange(9)
            data.append((len(data), " ".join(prose(3000 + len(data), r.randint(5, 60)).split() + lead + v + prose(5000 + len(data), r.randint(5, 60)).split())))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    one = sorted(map(tuple, passage_dedup.passage_report(frame.coalesce(1)).collect()))
    assert one == sorted(map(tuple, passage_dedup.passage_report(frame.repartition(7)).collect()))
    tokens = {d: passage_dedup.shingles(passage_dedup.Words([t.encode()], passage_dedup.ALNUM), 5)[0] for d, t in data}
    links = [(a, b) for a in tokens for b in tokens if a < b and len(np.intersect1d(tokens[a], tokens[b])) >= 41 and passage_dedup.near_passages(tokens[a], tokens[b], 46, 80)]
    got = {d: (n, c) for d, _, n, _, _, c in one}
    assert len(links) > 100 and sum(got[a][1] == got[b][1] for a, b in links) >= 0.98 * len(links)
    repeated = {b for _, b in links}
    assert sum(got[b][0] >= 50 for b in repeated) >= 0.95 * len(repeated) and all(got[d][0] == 0 for d in tokens if d not in repeated)


def shared_lead_ins(n=24, tail=40):
    """Texts of one lead-in of thirty words, with words of their own before it; behind it two texts each, n / 2 apart, go on alike."""
    lead = " ".join(prose(9000, 30).split()[:30])
    return [(d, " ".join(prose(9100 + d, 30).split()[:30] + [lead] + prose(9300 + d % (n // 2), 120).split()[:tail] + prose(9500 + d, 30).split()[:30])) for d in range(n)]


def test_passages_of_large_keys(spark, monkeypatch):
    """One stretch that 24 texts have before different ones, which two each share: every pair that verification accepts among all pairs is there, however keys are dealt."""
    data = shared_lead_ins()
    frame = spark.createDataFrame(data, "doc_id long, text string")
    tokens = {d: passage_dedup.shingles(passage_dedup.Words([t.encode()], passage_dedup.ALNUM), 5)[0] for d, t in data}
    want = {(a, b) for a in tokens for b in tokens if a < b and passage_dedup.near_passages(tokens[a], tokens[b], 46, 80)}
    assert {(a, a + 12) for a in range(12)} <= want
    for part in (512, 5):
        monkeypatch.setattr(passage_dedup, "PART", part)
        assert {(r.a, r.b) for r in passage_dedup.passages(frame)[0].collect()} == want


def test_pairs_of_large_keys_are_all(spark, monkeypatch):
    """Twenty windows of different classes that agree only in what stands before their centres: all pairs, through the join."""
    monkeypatch.setattr(passage_dedup, "PART", 3)
    e = np.zeros(20, passage_dedup._ENTRY)
    e["v"], e["doc"], e["c"], e["r"], e["before"] = 7, np.arange(20), 30, 90, 5
    e["far_before"] = e["far_behind"] = np.arange(20) + 1
    columns = [e[n] if n != "doc" else np.diff(e[n], prepend=0) for n in passage_dedup._ENTRY.names]
    blob = passage_dedup.zstandard.ZstdCompressor(1).compress(b"".join(c.tobytes() for c in columns))
    rows = passage_dedup.paired(passage_dedup.pd.DataFrame({"bucket": [0], "entries": [blob]}), 46, 4)
    large = rows[rows["key"].notna()]
    assert len(large) == 20 and rows["b"].isna().all()
    windows = spark.createDataFrame([tuple(int(x) for x in r) for r in large[["a", "key", "c", "l", "r", "size"]].to_numpy()], "a long, key long, c long, l long, r long, size long")
    assert sorted(map(tuple, passage_dedup.all_pairs(windows, 46).collect())) == [(a, b) for a in range(20) for b in range(a + 1, 20)]


def test_windows_of_one_document_make_no_large_key():
    """Twenty windows of one document and one of another in one key: a pair, and no large key."""
    e = np.zeros(21, passage_dedup._ENTRY)
    e["v"], e["doc"], e["c"], e["r"], e["before"] = 7, [0] * 20 + [1], 30 + np.arange(21), 200, 5
    e["far_before"] = e["far_behind"] = np.arange(21) + 1
    columns = [e[n] if n != "doc" else np.diff(e[n], prepend=0) for n in passage_dedup._ENTRY.names]
    blob = passage_dedup.zstandard.ZstdCompressor(1).compress(b"".join(c.tobytes() for c in columns))
    rows = passage_dedup.paired(passage_dedup.pd.DataFrame({"bucket": [0], "entries": [blob]}), 46, 4)
    assert rows["key"].isna().all() and rows[["a", "b"]].to_numpy().tolist() == [[0, 1]]


def test_anchors(spark):
    """Near passages have an anchor in common, a line of 13 words is none; of anchors of the same documents one is left."""
    run = passage_dedup.run_length(46, 80)
    assert run == 21
    r = random.Random(4)
    for n in range(300):
        body = prose(n, 60).split()[: r.choice([50, 51, 58])]
        edited = list(body)
        at = r.randrange(len(edited))
        edited[at : at + r.randint(0, 1)] = r.choice([[], ["changed"]])
        data = [" ".join(prose(1000 + n, 30).split()[:20] + body + prose(2000 + n, 30).split()[:20]), " ".join(prose(3000 + n, 40).split()[:33] + edited + prose(4000 + n, 30).split()[:20])]
        values, begin = passage_dedup.shingles(passage_dedup.Words([t.encode() for t in data], passage_dedup.ALNUM), 5)
        text, key = passage_dedup.anchors(values, begin, run)
        x, y = (values[begin[k] : begin[k + 1]] for k in (0, 1))
        if passage_dedup.near_passages(x, y, 46, 80):
            assert np.intersect1d(key[text == 0], key[text == 1]).size
        assert passage_dedup.partners(x, [y, x, y], [False, True, True], 46, 80) == [sorted(set(passage_dedup.near_passages(x, z, 46, 80))) for z in (y, x, y)]
    line = prose(1, 20).split()[:13]
    data = [" ".join(prose(10 + k, 70).split()[:60] + line + prose(500 + k, 70).split()[:60]).encode() for k in range(30)]
    text, key = passage_dedup.anchors(*passage_dedup.shingles(passage_dedup.Words(data, passage_dedup.ALNUM), 5), run)
    assert len(np.unique(key)) == len(key)
    rows = spark.createDataFrame([(d, k) for k in (1, 2, 3) for d in (5, 6, 7)] + [(5, 4), (6, 4), (9, 5)], "a long, key long")
    assert sorted((x.a, x.key, x.size) for x in passage_dedup.shared_anchors(rows).collect()) == [(5, 1, 3), (5, 4, 2), (6, 1, 3), (6, 4, 2), (7, 1, 3)]


def test_tiles_lay_all_blocks_on_each_other(spark):
    """Each two of 13 blocks are in one tile, and a block is sent seven times, not thirteen."""
    rows = media.tiled(spark.range(13).selectExpr("cast(id AS int) AS block", "cast(cast(id AS string) AS binary) AS images"), 13, 2).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.low, r.high), []).append((r.tile, r.block))
    pairs = sorted((x, y) for (low, high), own in groups.items() for t, x in own if t == low for u, y in own if u == high and y >= x)
    assert pairs == [(x, y) for x in range(13) for y in range(x, 13)] and len(rows) == 13 * 7


def test_passages_of_families_are_condensed(spark, monkeypatch):
    """A family's rows do not grow with its square, whatever the size of tiles, and the report is that of all its pairs; `settled` and `bounds` leave out no passage."""
    monkeypatch.setattr(passage_dedup, "SIDE", 7)
    r = np.random.default_rng(11)
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    base, data = r.choice(vocabulary, 160), []
    for d in range(45):
        words = base.copy()
        for k in r.integers(0, len(words), d % 4):
            words[k] = f"x{d}"
        own = r.choice(vocabulary, 70)
        data.append((3 * d, " ".join([*own, *words[20 * (d % 3) :], *(["of"] * 60 if d % 5 == 0 else own[:9]), *(own[:50] if d % 7 == 0 else ())])))
    frame = spark.createDataFrame(data, "doc_id long, text string")
    tokens = {d: passage_dedup.shingles(passage_dedup.Words([t.encode()], passage_dedup.ALNUM), 5)[0] for d, t in data}
    want = {(a, b, s, t + 4) for a in tokens for b in tokens if a < b for s, t in passage_dedup.near_passages(tokens[a], tokens[b], 46, 80)}
    ids = np.array(list(tokens))
    every, few = (passage_dedup.tile_rows((ids, list(tokens.values())), None, 46, 80, x) for x in (True, False))
    assert set(every) == want and len(few) < 4 * len(data) < len(want)
    left, right = np.arange(45) % 2 == 0, np.arange(45) % 2 == 1
    across = passage_dedup.tile_rows(*((ids[s], [tokens[i] for i in ids[s]]) for s in (left, right)), 46, 80, True)
    assert set(across) == {x for x in want if (x[0] + x[1]) % 2}
    lows, spans = {}, {}
    for a, b, s, t in want:
        lows[b] = min(a, lows.get(b, a))
        spans.setdefault(b, set()).update(range(s, t))
    got = {x.doc_id: x for x in passage_dedup.passage_report(frame).collect()}
    assert {i: (x.repeats, x.n_repeated) for i, x in got.items() if x.repeats is not None} == {b: (lows[b], len(spans[b])) for b in lows}
    assert {x.class_id for i, x in got.items() if i in lows} == {0}


def test_pairs_within_known_stretches_are_not_verified_one_by_one(monkeypatch):
    """Where all that a pair can repeat lies within stretches that are known, also within several of them, it is not looked at again; cells leave out what tiles do."""
    r, calls = np.random.default_rng(3), []
    vocabulary = np.array([f"w{i}" for i in range(3000)])
    shared, texts = [r.choice(vocabulary, 90) for _ in range(2)], {}
    for d in range(40):
        words = [x.copy() for x in shared]
        for w in words:
            w[30 + d % 9] = f"y{d % 3}"
        texts[d] = " ".join([*r.choice(vocabulary, 120), *words[0], *r.choice(vocabulary, 120), *words[1], *r.choice(vocabulary, 120)])
    tokens = {d: passage_dedup.shingles(passage_dedup.Words([t.encode()], passage_dedup.ALNUM), 5)[0] for d, t in texts.items()}
    near = passage_dedup.near_passages
    pairs = np.array([(a, b) for a in tokens for b in tokens if a < b])
    spans, lows = {}, {}
    for a, b in pairs.tolist():
        for s, t in near(tokens[a], tokens[b], 46, 80):
            spans.setdefault(b, set()).update(range(s, t + 4))
            lows.setdefault(b, a)
    monkeypatch.setattr(passage_dedup, "near_passages", lambda *x: calls.append(1) or near(*x))
    for rows in (passage_dedup.tile_rows((np.array(list(tokens)), list(tokens.values())), None, 46, 80, False), passage_dedup.cell_rows(pairs, tokens, 46, 80)):
        found = {}
        for a, b, s, t in rows:
            if s is not None:
                assert a == lows[b]
                found.setdefault(b, set()).update(range(s, t))
        assert found == spans and len(rows) < 3 * len(tokens)
        assert len(calls) < len(pairs) / 4
        calls.clear()
