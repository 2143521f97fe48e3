"""Token counts of whole texts under a public BPE vocabulary with word ends.

Method: map-side two-tier lookup. A first pass counts pre-tokens over all documents in bounded
Misra-Gries summaries (one per task) and sums those; the most frequent pre-tokens get their length
from the tokenizer once and are broadcast as a compact hash table of at most `table_size` entries.
The second pass cuts every text into pre-tokens and adds up lengths from that table; misses are
encoded by the tokenizer and kept in a bounded cache of the worker. Pre-tokens never span white space, so
of a text with characters beyond the plain ones only the runs that hold them are cut by the tokenizer;
such a run's length is kept in the cache like a pre-token's. No pre-token is ever shuffled, only the
bounded summaries are. The table's content affects speed alone, never a count.

Cases: null and empty texts have 0 bytes and 0 tokens; very long texts are cut whole; repeated rows
each get a row; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._spark import table

#: Runs of these characters only are cut here: lower-casing stays among them, and that and composition are the same everywhere. Other runs go to the tokenizer.
_PLAIN = [c for c in map(chr, range(0x300)) if c not in "\x1c\x1d\x1e\x1f\x85" and ord(max(c.lower())) < 0x300]
PLAIN = re.compile(f"[{re.escape(''.join(_PLAIN))}]*")
SPACE = re.compile(r"[ \t\n\r]+")
_L, _N = ("".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind) for kind in "LN")
#: The pre-token pattern of the vocabulary file (fixed), its classes spelled out over the plain characters.
CUT = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
CACHE = 400_000
COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenCounter:
    """Counts tokens by the broadcast table, then the worker's cache, then the tokenizer."""

    def __init__(self, vocabulary: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.merges, self.bytes = self.tokenizer.model.tokenize, {ord(c): level.pre_tokenize_str(c)[0][0] for c in _PLAIN}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.frequent, self.known, self.cut = frequent, dict(frequent), CUT.findall

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def learn(self, words: list[str], runs: list[str]) -> None:
        """Second tier: the lengths of new pre-tokens, from the merges of the tokenizer's model, and of new runs with other characters, from the tokenizer."""
        new, foreign = set(words).difference(self.known), set(runs).difference(self.known)
        if new or foreign:
            if len(self.known) + len(new) + len(foreign) > len(self.frequent) + CACHE:
                self.known = dict(self.frequent)
                new, foreign = set(words).difference(self.known), set(runs)
            self.known.update({w: len(self.merges(w.translate(self.bytes))) for w in new})
            self.known.update({w: self.encoded(w) for w in foreign})

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return self.encoded(text)
        runs: list[str] = []
        if not PLAIN.fullmatch(text):
            plain = []
            for run in SPACE.split(text):
                (plain if PLAIN.fullmatch(run) else runs).append(run)
            text = " ".join(plain)
        words = self.cut(text.lower())
        self.learn(words, runs)
        return sum(map(self.known.__getitem__, words)) + sum(map(self.known.__getitem__, runs))


def frequent_words(docs: DataFrame, table_size: int, summary: int) -> dict[str, int]:
    """Counts (lower bounds) of the most frequent pre-tokens over all documents: at most table_size of them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = CUT.findall, Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    held.update(find(text.lower()))
                    if len(held) > 8 * summary:  # Misra-Gries: lower all by the count of the last that is kept
                        top = held.most_common(summary + 1)
                        low = top[-1][1]
                        held = Counter({w: n - low for w, n in top[:-1] if n > low})
        top = held.most_common(summary)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    sums = docs.select("text").mapInArrow(summarise, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in sums.where(F.length("word") <= 64).orderBy(F.desc("n"), "word").limit(table_size).collect()}


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, table_size: int = 30_000, summary: int = 4096) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for docs (doc_id, text)."""
    spark, vocabulary = docs.sparkSession, vocabulary or vocabulary_path()
    counter = TokenCounter(vocabulary, {})
    frequent = spark.sparkContext.broadcast({w: counter.encoded(w) for w in frequent_words(docs, table_size, summary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary, frequent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens = [counter.count(t) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(count, COUNT_SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(sf_dir, "documents", spark))


QUERIES: dict[str, Callable] = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
