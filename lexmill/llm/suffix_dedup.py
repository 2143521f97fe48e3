"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes if it is covered by a string of `depth` bytes that also starts in a document with a
smaller doc_id; strings are judged on the input.

Method: suffixes are ordered only through `depth` bytes, by most-significant-digit passes; a group
that a pass leaves with one document is finished, and groups equal to the full depth are exactly the
repeated windows. Equal windows choose the same `digit`-byte string inside them, the one of least
hash (a winnowing), so of each run of windows only that one place is dealt out:
 1. first digit: fingerprints of the chosen places, radix-dealt to buckets; those in one document
    only are finished, and those that several documents of one task have are settled there, so a
    string that very many documents have sends its bucket two witnesses a task;
 2. the survivors fetch their context (depth - digit bytes on both sides); equal contexts within a
    task are settled there, one of each goes on to its bucket, where the same is done for those of all tasks;
 3. further digits: each bucket expands its places to windows and orders these by 8-byte words, most
    significant first, dropping what one document alone has after each pass. Windows are equal byte
    for byte to their full depth there: no fingerprint decides.
Documents of equal texts are found first: all but the smallest are wholly repeated (from `depth`
bytes on) and take no part.

Cases: null text is empty: nothing removed, kept is the digest of no bytes; texts shorter than
`depth` keep all; repeats within one document alone stay; doc_id is a key, and rows that repeat it
repeat its text; rows without doc_id remove nothing and lose nothing; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._spark import equal_texts, may_be_among, partitions, passing, stored, table
from lexmill.llm._text import among, chunks, distinct, mix

_U = np.uint64
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _squeeze(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(b)


def _open(b: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


def gram_hashes(data: np.ndarray, digit: int) -> np.ndarray:
    """A fingerprint of the `digit` bytes from each place (a multiple of 8)."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    words = np.zeros(len(data), np.uint64)
    for k in range(8):
        words |= padded[k : k + len(data)].astype(np.uint64) << _U(8 * k)
    n = len(data) - digit + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(0, digit, 8):
        out = mix(out * _U(0x9DDFEA08EB382D69) + words[k : k + n])
    return out


def chosen(data: np.ndarray, at: np.ndarray, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """Of joined texts (text i is data[at[i]:at[i + 1]]) the chosen places: fingerprint, text, place, first and last window in data."""
    span = depth - digit + 1
    hashes = gram_hashes(data, digit)
    if len(hashes) < span:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 4
    low = _U((1 << 24) - 1)  # places in the low bits make the first of equal hashes win; longer data are ranked a piece at a time
    places = []
    for begin in range(0, len(hashes) - span + 1, (1 << 24) - span):
        piece = hashes[begin : begin + (1 << 24) - 1]
        least, have = (piece & ~low) | np.arange(len(piece), dtype=np.uint64), 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        places.append((least & low).astype(np.int64)[: (1 << 24) - span] + begin)
    least = np.concatenate(places)
    size = np.diff(at)
    windows = np.maximum(size - depth + 1, 0)
    text = np.repeat(np.arange(len(size)), windows)
    window = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(windows)))[:-1], windows) + at[:-1][text]
    place = least[window]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(place)) - 1
    return hashes[place[first]], text[first], place[first], window[first], window[last]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _buckets(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), order[cut[b] : cut[b + 1]]


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h) % _U(buckets)).astype(np.int64)


def _blobs(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "entries"])


def packed_places(doc: np.ndarray, place: np.ndarray, h: np.ndarray | None = None) -> bytes:
    return _squeeze((b"" if h is None else h.tobytes()) + np.diff(doc, prepend=0).tobytes() + place.tobytes())


def unpacked_places(blob: bytes, with_h: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    raw, at = _open(blob), 8 if with_h else 0
    k = len(raw) // (at + 12)
    return np.cumsum(np.frombuffer(raw, np.int64, k, at * k)), np.frombuffer(raw, np.int32, k, (at + 8) * k), np.frombuffer(raw, np.uint64, k) if with_h else None


def first_digit(docs: DataFrame, depth: int, digit: int, buckets: int) -> DataFrame:
    """Rows (doc_id, places) of the places whose first digit occurs in several documents."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            h, doc, place = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, doc, place = h[order], doc[order], place[order].astype(np.int32)
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[: len(h)]
            low, high, size = np.minimum.reduceat(doc, start), np.maximum.reduceat(doc, start), np.diff(np.append(start, len(h)))
            several = low != high
            known = np.repeat(several, size)
            # what several documents of this task have is settled; two witnesses without a place tell the other tasks
            rows = [(b, b"s" + packed_places(doc[known][o], place[known][o])) for b, o in _buckets(doc[known] % buckets, buckets)]
            witness = np.repeat(h[start][several], 2)
            h = np.concatenate((h[~known], witness))
            doc = np.concatenate((doc[~known], np.stack([low[several], high[several]], 1).reshape(-1)))
            place = np.concatenate((place[~known], np.full(len(witness), -1, np.int32)))
            rows += [(b, b"a" + packed_places(doc[o], place[o], h[o])) for b, o in _buckets(_bucket_of(h, buckets), buckets)]
            return _blobs(rows)

        for others, texts in chunks(batches):
            data, at = _joined(texts)
            h, text, place, _, _ = chosen(data, at, depth, digit)
            held.append((h, np.array(others["doc_id"], np.int64)[text], place - at[text]))
            count += len(h)
            if count >= 1_000_000:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
        done = [[np.zeros(0, np.int64)], [np.zeros(0, np.int32)]]
        for blob in frame.entries:
            doc, place, h = unpacked_places(blob[1:], blob[:1] == b"a")
            if blob[:1] == b"s":
                done[0].append(doc)
                done[1].append(place)
            else:
                for held, x in zip(parts, (h, doc, place)):
                    held.append(x)
        h, doc, place = map(np.concatenate, parts)
        order = np.argsort(h)
        h, doc, place = h[order], doc[order], place[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))[: len(h)]
        if len(h):
            several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
            keep = np.repeat(several, np.diff(np.append(start, len(h)))) & (place >= 0)
            done[0].append(doc[keep])
            done[1].append(place[keep])
        return pd.DataFrame({"doc_id": np.concatenate(done[0]), "place": np.concatenate(done[1])})

    dealt = docs.select("doc_id", "text").mapInArrow(deal, "bucket int, entries binary")
    rows = dealt.groupBy("bucket").applyInPandas(shared, "doc_id long, place int")
    return rows.groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def settled(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places with equal contexts that of the smallest document, which goes on, and the others, which it settles: smaller documents have all their windows."""
    body = np.ascontiguousarray(np.concatenate((e["text"], e["low"][:, None], e["high"][:, None]), 1))
    key = _row_hash(body)
    order = np.lexsort((e["doc"], key))
    key = key[order]
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(e)]
    lead = np.repeat(order[start], np.diff(np.append(start, len(e))))
    later = (e["doc"][order] > e["doc"][lead]) & (body[order] == body[lead]).all(1)
    return e[order[~later]], e[order[later]]


def extent(e: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of places start and end in their texts."""
    return (e["place"] - e["high"].astype(np.int32)).astype(np.int32), (e["place"] - e["low"].astype(np.int32) + depth).astype(np.int32)


def with_context(docs: DataFrame, depth: int, digit: int, buckets: int) -> DataFrame:
    """docs (doc_id, text, places): the places' windows and context, settled or by bucket of the first digit."""
    side = depth - digit
    width = 2 * side + digit

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([("h", "<u8"), ("doc", "<i8"), ("place", "<i4"), ("low", "u1"), ("high", "u1"), ("text", "u1", (width,))])
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            on, done = settled(np.concatenate(held))
            rows = []
            for b, o in _buckets(_bucket_of(on["h"], buckets), buckets):
                rows.append((b, b"c" + _squeeze(on[o].tobytes())))
            start_of, end_of = extent(done, depth)
            for b, o in _buckets(done["doc"] % buckets, buckets):
                rows.append((b, b"s" + _squeeze(done["doc"][o].tobytes() + start_of[o].astype(np.int32).tobytes() + end_of[o].astype(np.int32).tobytes())))
            return _blobs(rows)

        for others, texts in chunks(batches):
            data, at = _joined(texts)
            h, text, place, first, last = chosen(data, at, depth, digit)
            wanted = np.concatenate([np.array(p, np.int64) + a for p, a in zip(others["places"], at)]) if texts else np.zeros(0, np.int64)
            keep = among(place, distinct(wanted))
            h, text, place, first, last = h[keep], text[keep], place[keep], first[keep], last[keep]
            e = np.zeros(len(h), kind)
            e["h"], e["doc"], e["place"] = h, np.array(others["doc_id"], np.int64)[text], place - at[text]
            e["low"], e["high"] = place - last, place - first
            spread = place[:, None] + np.arange(-side, width - side)
            inside = (spread >= first[:, None]) & (spread < last[:, None] + depth)
            body = np.where(inside, data[np.clip(spread, 0, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(h) else np.zeros((0, width), np.uint8)
            e["text"] = body
            held.append(e)
            count += len(e)
            if count >= 150_000:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    return docs.select("doc_id", "text", "places").mapInArrow(fetch, "bucket int, entries binary")


def _row_hash(rows: np.ndarray) -> np.ndarray:
    pad = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    pad[:, : rows.shape[1]] = rows
    words = pad.view("<u8")
    out = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        out = mix(out * _U(0x9DDFEA08EB382D69) + words[:, k])
    return out


def repeated_windows(group: np.ndarray, doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Numbers of the windows (rows of bytes) that a smaller document of their group has too: most-significant-digit passes over 8-byte words."""
    depth = text.shape[1]
    pad = np.zeros((len(text), -(-depth // 8) * 8), np.uint8)
    pad[:, :depth] = text
    words = pad.view(">u8").astype(np.uint64)
    on = np.arange(len(text))
    for k in range(-1, words.shape[1]):
        if k >= 0:
            order = np.lexsort((words[on, k], group))
            on, group = on[order], group[order]
            fresh = np.concatenate(([True], (group[1:] != group[:-1]) | (words[on[1:], k] != words[on[:-1], k])))[: len(on)]
        else:
            order = np.argsort(group, kind="stable")
            on, group = on[order], group[order]
            fresh = np.concatenate(([True], group[1:] != group[:-1]))[: len(on)]
        if not len(on):
            return on
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(on)))
        low = np.minimum.reduceat(doc[on], start)
        keep = np.repeat(low != np.maximum.reduceat(doc[on], start), size)
        group = np.repeat(np.arange(len(start)), size)[keep]
        low = np.repeat(low, size)[keep]
        on = on[keep]
    return on[doc[on] > low]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pd.DataFrame:
    """Spans of documents, those that touch made one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return pd.DataFrame({"doc_id": doc, "start": start, "end": end})
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    number = np.cumsum(fresh)
    reach = np.maximum.accumulate(end + (number << 40)) - (number << 40)
    fresh[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return pd.DataFrame({"doc_id": doc[first], "start": start[first], "end": reach[np.append(first[1:], len(doc)) - 1]})


def further_digits(dealt: DataFrame, depth: int, digit: int) -> DataFrame:
    """Rows (doc_id, spans) of what smaller documents have too."""
    side = depth - digit
    width = 2 * side + digit

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        kind = np.dtype([("h", "<u8"), ("doc", "<i8"), ("place", "<i4"), ("low", "u1"), ("high", "u1"), ("text", "u1", (width,))])
        parts, docs, starts, ends = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for blob in frame.entries:
            raw = _open(blob[1:])
            if blob[:1] == b"c":
                parts.append(np.frombuffer(raw, kind))
            else:
                k = len(raw) // 16
                docs.append(np.frombuffer(raw, np.int64, k))
                starts.append(np.frombuffer(raw, np.int32, k, 8 * k))
                ends.append(np.frombuffer(raw, np.int32, k, 12 * k))
        if parts:
            e, done = settled(np.concatenate(parts))
            docs.append(done["doc"])
            for held, x in zip((starts, ends), extent(done, depth)):
                held.append(x)
            e = e[np.argsort(e["h"], kind="stable")]
            start = np.flatnonzero(np.concatenate(([True], e["h"][1:] != e["h"][:-1])))
            cuts = [0]
            for s in start[1:].tolist() + [len(e)]:  # whole groups, some 20,000 places at a time
                if s - cuts[-1] >= 20_000 or s == len(e):
                    cuts.append(s)
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = e[a:b]
                group = np.cumsum(np.concatenate(([0], (part["h"][1:] != part["h"][:-1]).astype(np.int64))))
                many = part["high"].astype(np.int64) - part["low"] + 1
                row = np.repeat(np.arange(len(part)), many)
                offset = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(many)))[:-1], many) + part["low"][row]
                body = part["text"]
                text = body[row[:, None], (side - offset)[:, None] + np.arange(depth)]
                found = repeated_windows(group[row] * (side + 1) + offset, part["doc"][row], text)
                begin = part["place"][row[found]] - offset[found]
                docs.append(part["doc"][row[found]])
                starts.append(begin.astype(np.int32))
                ends.append((begin + depth).astype(np.int32))
        return merged(np.concatenate(docs), np.concatenate(starts), np.concatenate(ends))

    rows = dealt.groupBy("bucket").applyInPandas(finish, "doc_id long, start long, end long")
    return rows.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def suffix_dedup(docs: DataFrame, depth: int = 50, digit: int = 24, kept: bool = True) -> DataFrame:
    """One row for each row of docs (doc_id, text): sizes, spans, digest and, if asked for, the bytes that are kept."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    named = docs.where("doc_id IS NOT NULL")
    buckets = 4 * partitions(spark)
    body = F.coalesce("text", F.lit(""))
    with passing():
        copies = equal_texts(named.where(F.octet_length("text") >= depth)).select("doc_id")
        places = stored(first_digit(named.join(copies, "doc_id", "left_anti"), depth, digit, buckets))
        # texts without such a place are not shuffled
        placed = named.where(may_be_among(places.select(F.col("doc_id").alias("id")))("doc_id"))
        spans = further_digits(with_context(placed.join(places, "doc_id"), depth, digit, buckets), depth, digit)
        marks = stored(spans.join(copies.select("doc_id", F.lit(True).alias("copy")), "doc_id", "full_outer"), lasting=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, left = [], []
            for text, spans, copy in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("copy").to_pylist()):
                if copy or spans:
                    data = np.frombuffer(text, np.uint8)
                    steps = np.zeros(len(data) + 1, np.int64)
                    for s in [{"start": 0, "end": len(data)}] if copy else spans:
                        steps[s["start"]] += 1
                        steps[s["end"]] -= 1
                    gone = np.cumsum(steps[:-1]) > 0
                    rest = data[~gone].tobytes()
                    out.append((len(data), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
                else:
                    rest = text
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest()))
                left.append(rest if kept else None)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    touched = F.col("doc_id").isNotNull() & may_be_among(marks.select(F.col("doc_id").alias("id")))("doc_id")
    whole = docs.where(touched).join(marks, "doc_id", "left").unionByName(docs.where(~touched), allowMissingColumns=True)
    return whole.select("doc_id", body.alias("text"), "spans", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(cut, SCHEMA)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(sf_dir, "documents", spark), kept=False).drop("kept")


QUERIES: dict[str, Callable] = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}
