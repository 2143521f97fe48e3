"""Language identification by bit-sliced Bloom filters of character n-grams.

Method: letters of the lower-cased text, runs of anything else being one space, give 3-grams. All
3-grams of a language's training documents enter its filter, and those that make up at least a given
share of its own enter a filter more for each of `shares`: what stray text of other languages brings
into the first is rare, and so stays out of the others. One array of bit masks, a bit for each filter
of a language, holds all of them at once: AND over a gram's few slots gives all languages that contain
it, and how usual it is there. A filter's popcount over a text's grams, corrected for its false
positives, is (hits / n - f) / (1 - f); the mean over a language's filters is its estimate; the largest
decides, ties go to the language that has more training grams, then by name. score is that estimate,
held to 0..1.

Tasks make the filters' bits and Spark joins them, so no gram comes to the driver. The slots are a
power of two, `ROOM` to twice that for each different gram of the richest language; slots x filters / 8
bytes, rounded up to 1, 2 or a multiple of 8 bytes a slot, are broadcast, if they are `most` bytes or less. Beyond that
(for 8 filters at the default, from 16 million different grams in one language on) the grams are dealt by
a hash into so many ranges that the filters of one are within `most`; the documents are stored once with a number for
each row and passed once a range, a row's hits are added up, and each range's false positives are taken off
by its own rate. So any number of different grams gives rows, and what a worker holds is bounded.

Cases: null text or text without a letter gives `und` and score 0; with nothing to learn from, all
rows are `und`; very long texts are used whole; repeated rows each get a row; an empty table gives no
rows; other columns are ignored. Any number of languages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._spark import fresh, passing, stored, table
from lexmill.llm._text import chunks, mix

HASHES, ROOM, PIECE = 4, 8, 32768
SHARES = (1e-4,)
#: Bytes of filters that are broadcast at a time.
MOST = 256 << 20
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """3-grams of the texts, exactly as 63-bit numbers, and where each text's begin (length texts + 1)."""
    low = [t.decode("utf-8", "replace").lower() for t in texts]
    codes = np.frombuffer(("\n" + "\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum([len(t) + 1 for t in low]))).astype(np.int64)  # of the line end before each text
    letter = letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each gap its first character, as a space
    keep[at] = True
    kept = np.where(letter, codes, 32)[keep].astype(np.uint64)
    new = np.cumsum(keep)[at] - 1
    if len(kept) < 3:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    out = (kept[:-2] << np.uint64(42)) | (kept[1:-1] << np.uint64(21)) | kept[2:]
    inner = np.flatnonzero(kept[1:-1] != 32)  # a letter in the middle; so no gram spans two texts
    return out[inner], np.searchsorted(inner, new)


def slots(values: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The places of each gram in a filter of `size` slots, a power of two."""
    h = mix(values)
    step = mix(h) | np.uint64(1)
    for k in range(HASHES):
        yield (h + np.uint64(k) * step) & np.uint64(size - 1)


def range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each gram: bits that its slots do not use."""
    return (mix(mix(mix(values)) + np.uint64(1)) % np.uint64(ranges)).astype(np.int64)


class Learned:
    """Counts of the grams of each language, stored for as long as the scope around lasts, and the filters of any range of them."""

    def __init__(self, train: DataFrame, shares: tuple[float, ...], most: int = MOST):
        self.shares, self.levels = (0.0, *shares), 1 + len(shares)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for others, texts in chunks(batches, size=1 << 20):
                by_lang: dict[str, list[bytes]] = {}
                for lang, text in zip(others["lang"], texts):
                    by_lang.setdefault(lang, []).append(text)
                for lang, own in by_lang.items():
                    found, n = np.unique(grams(own)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(found.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        self.sums = stored(train.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
        sizes = {r.lang: (r.total, r.grams) for r in self.sums.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("grams")).collect()}
        self.names = sorted(sizes, key=lambda x: (-sizes[x][0], x))
        self.totals = np.array([sizes[name][0] for name in self.names], float)
        size = max(PIECE, 1 << (ROOM * max((n for _, n in sizes.values()), default=0)).bit_length())
        many = len(self.names) * self.levels
        self.kind = np.uint8 if many <= 8 else np.uint16 if many <= 16 else np.uint64
        self.width = self.kind(0).nbytes * 8
        self.words = max(1, -(-many // self.width))
        self.ranges = 1
        while self.words * size * (self.width // 8) > most and size > PIECE:
            size, self.ranges = size // 2, self.ranges * 2
        self.size = size

    def filters(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        """Bit masks (a row for each 64 filters) of a range, and false-positive rates by language and filter."""
        number, totals, levels, shares, size, ranges = {name: i for i, name in enumerate(self.names)}, self.totals, self.levels, self.shares, self.size, self.ranges

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column("gram").to_numpy().astype(np.uint64)
                ours = np.flatnonzero(range_of(values, ranges) == part)
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)[ours]
                share = batch.column("n").to_numpy()[ours] / totals[lang]
                at = np.stack(list(slots(values[ours], size)), 1).astype(np.int64)
                rows = [(np.repeat(lang[on] * levels + k, HASHES), at[on].reshape(-1)) for k, least in enumerate(shares) for on in [share >= least]]
                filters, at = (np.concatenate(x) for x in zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(filters), pa.array(at // PIECE), pa.array(at % PIECE)], ["filter", "piece", "at"])

        masks = np.zeros((self.words, size), self.kind)
        held = np.zeros(len(self.names) * levels)
        for r in self.sums.mapInArrow(place, "filter long, piece long, at long").groupBy("filter", "piece").agg(F.bitmap_construct_agg("at").alias("bits")).toLocalIterator():
            word, bit = divmod(r["filter"], self.width)
            bits = np.unpackbits(np.frombuffer(r.bits, np.uint8), bitorder="little")
            held[r["filter"]] += bits.sum()
            masks[word, r.piece * PIECE : (r.piece + 1) * PIECE] |= bits.astype(self.kind) << self.kind(bit)
        return masks, ((held / size) ** HASHES).reshape(-1, levels)


def learn(train: DataFrame, shares: tuple[float, ...] = SHARES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages (most grams first), bit masks and false-positive rates of all grams in one range. train: (text, lang)."""
    with passing():
        learned = Learned(train, shares, 1 << 62)
        return learned.names, *learned.filters(0)


def hits_of(found: np.ndarray, begin: np.ndarray, masks: np.ndarray, filters: int) -> np.ndarray:
    """How many grams of each text are in each filter; begin: where the texts' grams begin, each at least one."""
    at, width = list(slots(found, masks.shape[1])), masks.dtype.itemsize * 8
    hits = np.zeros((filters, len(begin)), np.int64)
    for word, held in enumerate(masks):
        mask = held[at[0]]
        for more in at[1:]:
            mask &= held[more]
        for bit in range(min(width, len(hits) - word * width)):
            hits[word * width + bit] = np.add.reduceat((mask >> mask.dtype.type(bit)) & mask.dtype.type(1), begin, dtype=np.int64)
    return hits


def decided(hits: np.ndarray, wrong: np.ndarray, n: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, score) of each text from its hits and expected false rate by filter, and its grams."""
    wrong = np.minimum(wrong, 0.999999)
    estimate = ((hits / n - wrong) / (1 - wrong)).reshape(-1, levels, len(n)).mean(1)
    return estimate.argmax(0), np.clip(estimate.max(0), 0, 1)


def held_out(modulus: int, remainder: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder


def _rows(ids: list, names: list[str], some: np.ndarray, best: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    langs, score = ["und"] * len(ids), np.zeros(len(ids))
    score[some] = scores
    for i, b in zip(some, best):
        langs[i] = names[b]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


def language_id(docs: DataFrame, train: DataFrame, shares: tuple[float, ...] = SHARES, most: int = MOST) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for docs (doc_id, text); learns from train (text, lang)."""
    with passing():
        learned = Learned(train.where("lang IS NOT NULL AND text IS NOT NULL"), shares, most)
        names, levels = learned.names, learned.levels
        if learned.ranges > 1:
            return _in_passes(docs, learned)
        model = docs.sparkSession.sparkContext.broadcast(learned.filters(0))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, rates = model.value
        for others, texts in chunks(batches):
            found, begin = grams(texts)
            n = np.diff(begin)
            some = np.flatnonzero(n) if names else np.zeros(0, np.int64)
            best, scores = decided(hits_of(found, begin[:-1][some], masks, rates.size), rates.reshape(-1, 1), n[some], levels) if len(some) else (some, some)
            yield _rows(others["doc_id"], names, some, best, scores)

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def _in_passes(docs: DataFrame, learned: Learned) -> DataFrame:
    """The same by a pass for each range of grams."""
    names, levels, ranges = learned.names, learned.levels, learned.ranges
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    every, rates = None, []
    for part in range(ranges):
        masks, rate = learned.filters(part)
        rates.append(rate.reshape(-1))
        sent = docs.sparkSession.sparkContext.broadcast(masks)

        def count(batches: Iterator[pa.RecordBatch], part=part, sent=sent, filters=rate.size) -> Iterator[pa.RecordBatch]:
            for others, texts in chunks(batches):
                found, begin = grams(texts)
                ours = range_of(found, ranges) == part
                begin = np.concatenate(([0], np.cumsum(ours)))[begin]
                n = np.diff(begin)
                some = np.flatnonzero(n)
                hits = np.zeros((filters, len(texts)), np.int64)
                if len(some):
                    hits[:, some] = hits_of(found[ours], begin[:-1][some], sent.value, filters)
                yield pa.RecordBatch.from_arrays([pa.array(others["row"], pa.int64()), pa.array(others["doc_id"], pa.int64()), pa.array([part] * len(texts), pa.int32()), pa.array(n), pa.array([x.tobytes() for x in hits.T.copy()], pa.binary())], ["row", "doc_id", "part", "n", "hits"])

        found = stored(rows.mapInArrow(count, "row long, doc_id long, part int, n long, hits binary"), lasting=True)
        sent.destroy()
        every = found if every is None else every.unionByName(found)
    wrong = np.stack(rates)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts").to_pylist()
            by_range = np.array([[p["n"] for p in x] for x in parts], float).reshape(-1, ranges)
            hits = np.array([np.sum([np.frombuffer(p["hits"], np.int64) for p in x], 0) for x in parts], np.int64).reshape(len(parts), -1).T
            n = by_range.sum(1)
            some = np.flatnonzero(n)
            best, scores = decided(hits[:, some], (by_range[some] @ wrong / n[some, None]).T, n[some], levels) if len(some) else (some, some)
            yield _rows(batch.column("doc_id").to_pylist(), names, some, best, scores)

    parts = every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("part", "n", "hits"))).alias("parts"))
    return parts.select("doc_id", "parts").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, train: DataFrame, least: float = 0.6) -> DataFrame:
    """docs, with all their columns, without those that are `und` or whose score is under `least`; a null lang gets the prediction."""
    id_, lang_ = fresh(docs, "__id", "__lang")
    found = stored(language_id(docs.where("doc_id IS NOT NULL"), train).dropDuplicates(["doc_id"]), lasting=True)
    bad = found.where((F.col("lang_pred") == "und") | (F.col("score") < least)).select(F.col("doc_id").alias(id_))
    kept = docs.join(stored(bad, lasting=True), docs.doc_id == F.col(id_), "left_anti")
    if "lang" not in docs.columns:
        return kept
    missing = kept.where("lang IS NULL").join(found.select(F.col("doc_id").alias(id_), F.col("lang_pred").alias(lang_)), F.col("doc_id") == F.col(id_), "left").withColumn("lang", F.col(lang_).cast(docs.schema["lang"].dataType))
    return kept.where("lang IS NOT NULL").unionByName(missing.select(*docs.columns))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    return language_id(docs, docs.where(~held_out(5, 0))).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable] = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
