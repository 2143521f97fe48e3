"""Document quality by nearest-neighbour voting over latent-semantic vectors.

Method: a text is the counts of its character-shape 3-grams (upper and lower case letters, digits,
white space and line ends are classes; other ASCII signs stand for themselves, non-ASCII characters
count as lower case) folded to `FEATURES` features. From a bounded sample of labelled documents
(`sample` rows, those of the smallest digest of doc_id; a documented parameter, proven size) the
driver fits weights by document frequency and a truncated singular value decomposition. The sample's
unit vectors and labels are broadcast (sample x dimensions floats); every document is projected, its
exact cosines with all of them are blocked matrix products, and its `neighbours` nearest vote, each
weighted by its similarity to the power `sharpness`.

Cases: a text without any 3-gram (null, empty, one sign) or without similar neighbours scores the
sample's share of label 1; with no labels to learn from every score is 0.5; long texts are used
whole; repeated rows each get a row; a label repeated for a doc_id counts each time; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm._spark import table
from lexmill.llm._text import chunks
from lexmill.llm.language_id import held_out

FEATURES = 2048
_CLASS = np.full(256, 1, np.int64)  # lower case
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 32]] = 4
_CLASS[[10, 13]] = 5
_SIGNS = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASS[_SIGNS] = 6 + np.arange(len(_SIGNS))
_FOLD = np.random.default_rng(11).permutation(64**3) % FEATURES


def features(texts: list[bytes]) -> np.ndarray:
    """Counts of folded shape 3-grams: a row a text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    if len(data) < 3:
        return np.zeros((len(texts), FEATURES), np.float32)
    c = _CLASS[data]
    codes = _FOLD[(c[:-2] << 12) | (c[1:-1] << 6) | c[2:]]
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    inside = owner[:-2] == owner[2:]
    return np.bincount(owner[:-2][inside] * FEATURES + codes[inside], minlength=len(texts) * FEATURES).reshape(len(texts), FEATURES).astype(np.float32)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    return np.sqrt(counts / total) * idf


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(counts: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, projection, and the sample's unit vectors."""
    idf = np.log1p(len(counts) / (1 + (counts > 0).sum(0))).astype(np.float32)
    x = weighted(counts, idf)
    value, vector = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = vector[:, ::-1][:, : min(dimensions, int((value > 1e-9).sum()) or 1)].astype(np.float32)
    return idf, basis, unit(x @ basis)


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = 4000, dimensions: int = 48, neighbours: int = 15, sharpness: int = 8) -> DataFrame:
    """Rows (doc_id, score) for docs (doc_id, text); labels (doc_id, quality) are those to learn from."""
    chosen = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "quality").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality").limit(sample)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for others, texts in chunks(batches):
            rows = features(texts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(others["doc_id"], pa.int64()), pa.array(others["quality"], pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "counts"])

    # at most `sample` rows of 8 KB, the same ones also where a doc_id repeats
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(counted, "doc_id long, quality int, counts binary").orderBy("doc_id", "quality", "counts").limit(sample).toPandas()
    label = known.quality.to_numpy(np.float32)
    prior = float(label.mean()) if len(label) else 0.5
    counts = np.stack([np.frombuffer(c, np.int32) for c in known.counts]).astype(np.float32) if len(label) else np.zeros((0, FEATURES), np.float32)
    model = fit(counts, dimensions) if len(label) else None
    sent = docs.sparkSession.sparkContext.broadcast((model, label, prior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, label, prior = sent.value
        for others, texts in chunks(batches):
            out = np.full(len(texts), prior)
            if model is not None:
                idf, basis, vectors = model
                near = unit(weighted(features(texts), idf) @ basis) @ vectors.T
                k = min(neighbours, near.shape[1])
                top = np.argpartition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k :]
                weight = np.maximum(np.take_along_axis(near, top, 1), 0).astype(np.float64) ** sharpness
                total = weight.sum(1)
                some = total > 1e-9
                out[some] = ((weight * label[top]).sum(1) / np.maximum(total, 1e-12))[some]
            yield pa.RecordBatch.from_arrays([pa.array(others["doc_id"], pa.int64()), pa.array(np.clip(out, 0, 1))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(sf_dir, "documents", spark)
    scored = quality_scores(docs, table(sf_dir, "labels", spark).where(~held_out(4, 2)))
    return scored.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable] = {"op4_quality": op4_quality}
SQL: dict[str, str] = {}
