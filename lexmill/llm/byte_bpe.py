"""Byte-level BPE: whole texts to token ids and back, by the ranks of a public vocabulary.

Method: two-tier look-up. A text is cut into pre-tokens by the vocabulary's pattern. A minimal perfect hash
over the vocabulary's byte strings (one slot a token, a displacement for each bucket of them) leads every
pre-token of a chunk to the one token that it may be, in numpy; equal length and bytes decide, so a hit is
exact and is one id. Misses are merged by rank, least rank first and leftmost of equals, with a heap over
linked bytes: n log n steps for n bytes, whatever is in them. Worker caches keep merged pre-tokens of up to
CACHED bytes; they hold at most CACHE of them and change no result. Decoding looks the ids up.

What is broadcast is the vocabulary, a file of fixed size that the driver alone reads. Nothing is shuffled.

Ids are packed as little-endian unsigned 32-bit integers, which is how they are stored and hashed.

Cases: null and empty texts have no tokens; special tokens' strings in a text are ordinary text; very long
texts are cut PIECES pre-tokens at a time, and one pre-token of a whole text is merged by the heap in one
go; bytes that are no UTF-8 count as U+FFFD; repeated rows each get a row; an empty table gives no rows;
other columns are ignored by `encode` and kept by `decode`, which gives null for null ids, and fails on ids that the vocabulary
does not have.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm._spark import table
from lexmill.llm._text import _BASE, _INVERSE, _VALUE, _power, chunks, mix

_U = np.uint64
CACHE, CACHED = 400_000, 64
#: A pair on the heap is its rank above the place where it begins.
PLACE = 40
PLACES = (1 << PLACE) - 1
PIECES = 200_000
TRIES = 64


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(x[0]): int(x[1]) for x in map(bytes.split, lines) if x}


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for data[start:end] each, from prefix sums of a polynomial; equal bytes have equal ones."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power("up", _BASE, len(data)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _power("down", _INVERSE, len(data) + 1)[start] + (end - start).astype(np.uint64))


def inner(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. below each length, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class PerfectHash:
    """A slot of its own for each of n byte strings, and none more: h leads to a bucket, whose displacement leads to the slot.

    Large buckets are placed first, each by the first displacement under which all its keys find free slots;
    buckets of one key take what is left, their slot written as a negative displacement.
    """

    def __init__(self, keys: list[bytes]):
        self.size = n = len(keys)
        self.flat = np.frombuffer(b"".join(keys), np.uint8)
        lengths = np.fromiter(map(len, keys), np.int64, n)
        begin = np.cumsum(lengths) - lengths
        h = fingerprints(self.flat, begin, begin + lengths)
        self.moved = np.zeros(n // 3 + 1, np.int64)
        self.key = np.full(n, -1, np.int64)
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(len(self.moved) + 1))
        many = np.diff(first)
        for b in np.argsort(-many, kind="stable"):
            if many[b] < 2:
                break
            ours, tried = order[first[b] : first[b + 1]], 0
            while True:
                moves = np.arange(tried, tried + TRIES)
                slots = np.sort(self._slot(h[ours], moves[:, None]), 1)
                good = np.flatnonzero((self.key[slots] < 0).all(1) & (np.diff(slots, axis=1) > 0).all(1))
                if len(good):
                    self.moved[b] = moves[good[0]]
                    self.key[self._slot(h[ours], self.moved[b])] = ours
                    break
                tried += TRIES
        single, free = np.flatnonzero(many == 1), np.flatnonzero(self.key < 0)
        self.moved[single] = -free - 1
        self.key[free] = order[first[single]]
        self.begin, self.lengths = begin[self.key], lengths[self.key]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return (h % _U(len(self.moved))).astype(np.int64)

    def _slot(self, h: np.ndarray, moved: np.ndarray) -> np.ndarray:
        return (mix(h + np.asarray(moved).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) % _U(self.size)).astype(np.int64)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the key that data[start:end] is, or -1."""
        if not self.size or not len(start):
            return np.full(len(start), -1, np.int64)
        h = fingerprints(data, start, end)
        moved = self.moved[self._bucket(h)]
        slot = np.where(moved < 0, -moved - 1, self._slot(h, moved))
        lengths = end - start
        same = np.flatnonzero(self.lengths[slot] == lengths)
        long = lengths[same]
        at = inner(long)
        differs = data[np.repeat(start[same], long) + at] != self.flat[np.repeat(self.begin[slot[same]], long) + at]
        wrong = np.zeros(len(same), bool)
        wrong[np.repeat(np.arange(len(same)), long)[differs]] = True
        found = np.full(len(start), -1, np.int64)
        found[same[~wrong]] = self.key[slot[same[~wrong]]]
        return found


def merged(piece: bytes, pair: list[int], heap: list[int], ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the parts of `piece` after all merges.

    pair: the rank of the bytes at i and i + 1, or -1; heap: rank << PLACE | i of those that have one. Parts are linked: the
    one that begins at i stops at end[i], and before[i] is where the part in front of it begins.
    """
    n, rank_of = len(piece), ranks.get
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    while heap:
        least = heapq.heappop(heap)
        i = least & PLACES
        if pair[i] != least >> PLACE:
            continue  # one of the two has been merged otherwise
        middle = end[i]
        stop = end[i] = end[middle]
        pair[middle] = pair[i] = -1
        if stop < n:
            before[stop] = i
            if (rank := rank_of(piece[i : end[stop]], -1)) >= 0:
                pair[i] = rank
                heapq.heappush(heap, rank << PLACE | i)
        if i:
            left = before[i]
            pair[left] = rank = rank_of(piece[left:stop], -1)
            if rank >= 0:
                heapq.heappush(heap, rank << PLACE | left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Vocabulary:
    """Byte strings and their ranks; `known` is the first tier."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known = PerfectHash(list(ranks))
        self.rank = np.fromiter(ranks.values(), np.uint32, len(ranks))
        self.young: dict[bytes, bytes] = {}  # as long as the worker holds the vocabulary
        self.old: dict[bytes, bytes] = {}
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Second tier: the packed ids of each. First pairs are looked up for all pieces at once."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(lengths)
        pair = np.append(self.pairs[data[:-1] << 8 | data[1:]], -1)
        pair[ends - 1] = -1
        there = np.flatnonzero(pair >= 0)
        heaps = (pair[there] << PLACE | inner(lengths)[there]).tolist()
        bounds = np.searchsorted(there, np.concatenate(([0], ends))).tolist()
        ids, many, begin = [], [], 0
        for i, piece in enumerate(pieces):
            made = merged(piece, pair[begin : begin + len(piece)].tolist(), heaps[bounds[i] : bounds[i + 1]], self.ranks)
            begin += len(piece)
            ids += made
            many.append(4 * len(made))
        flat, stops = np.array(ids, "<u4").tobytes(), np.cumsum(many)
        return [flat[stop - n : stop] for stop, n in zip(stops.tolist(), many)]


class Encoder:
    """Encodes chunks of texts in a worker."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary = vocabulary
        self.cut = regex.compile(vocabulary.pattern)

    def parts(self, texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
        """Pre-tokens, at most PIECES more than a chunk's at a time, and how many of them each text has."""
        held, counts = [], []
        for text in texts:
            if len(text) <= PIECES:
                found = self.cut.findall(text)
                held += found
                counts.append(len(found))
                continue
            every = (m[0] for m in self.cut.finditer(text))
            counts.append(0)
            while found := list(islice(every, PIECES)):
                held += found
                counts[-1] += len(found)
                if len(held) >= PIECES:
                    yield held, counts
                    held, counts = [], [0] * len(counts)
        yield held, counts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed."""
        out: list[list[bytes]] = [[] for _ in texts]
        for pieces, counts in self.parts(texts):
            ids, lengths = self.ids(pieces)
            ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum(counts)]
            low = 0
            for i, high in enumerate(ends.tolist()):
                out[i].append(ids[low:high].tobytes())
                low = high
        return [b"".join(x) for x in out]

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after another, and how many each has."""
        whole = "".join(pieces).encode()
        data = np.frombuffer(whole, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        if len(pieces) and ends[-1] < len(data):  # characters to bytes
            ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[ends]
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        found = self.vocabulary.known.find(data, starts, ends)
        missed = np.flatnonzero(found < 0)
        missing = [whole[low:high] for low, high in zip(starts[missed].tolist(), ends[missed].tolist())]
        packed = self.packed(missing)
        lengths = np.ones(len(pieces), np.int64)
        lengths[missed] = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        hit = np.repeat(found >= 0, lengths)
        out = np.empty(len(hit), "<u4")
        out[hit] = self.vocabulary.rank[found[found >= 0]]
        out[~hit] = np.frombuffer(b"".join(packed), "<u4")
        return out, lengths

    def packed(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens that are no token, by way of the worker's cache: a young and an old half, so what is met often stays."""
        vocabulary, every = self.vocabulary, set(pieces)
        if len(vocabulary.young) > CACHE // 2:
            vocabulary.young, vocabulary.old = {}, vocabulary.young
        young, old = vocabulary.young, vocabulary.old
        new = every.difference(young)
        for piece in new.intersection(old):
            young[piece] = old[piece]
        made = list(new.difference(old))
        young.update(zip(made, vocabulary.merge(made)))
        out = list(map(young.__getitem__, pieces))
        for piece in made:
            if len(piece) > CACHED:
                del young[piece]
        return out


def encode(docs: DataFrame, ranks: dict[bytes, int] | None = None, cut: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids) for docs (doc_id, text); ids packed."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks or read_ranks(vocabulary_path()), cut or pattern()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for others, texts in chunks(batches):
            ids = encoder.encode([t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(others["doc_id"], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(tokens: DataFrame, ranks: dict[bytes, int] | None = None, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """tokens with `name`: the bytes that the packed ids stand for."""
    sent = tokens.sparkSession.sparkContext.broadcast({rank: token for token, rank in (ranks or read_ranks(vocabulary_path())).items()})
    kept = tokens.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = sent.value.__getitem__

        def joined(packed: bytes) -> bytes:
            numbers = np.frombuffer(packed, "<u4")
            return b"".join(b"".join(map(token, numbers[i : i + PIECES].tolist())) for i in range(0, len(numbers), PIECES))

        for batch in batches:
            made = [None if x is None else joined(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = decode(encode(table(sf_dir, "documents", spark)))
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable] = {"op12_byte_bpe": op12_byte_bpe}
SQL: dict[str, str] = {}
