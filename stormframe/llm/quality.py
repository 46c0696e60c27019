"""Quality scores from the labels of the nearest labelled documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from stormframe.llm.common import free_name, learnable, whole_text

#: Labelled rows that the classifier is fitted on, at most.
LABELLED_ROWS = 4000
BUCKETS = 2048
DIMENSIONS = 96
NEIGHBOURS = 25
THRESHOLD = 0.7
#: Bytes of text whose features are counted at once, and documents compared at once.
BLOCK_BYTES = 2_000_000
BLOCK_ROWS = 512


def _blocks(texts: list[bytes]):
    """Consecutive texts of about ``BLOCK_BYTES`` together; a longer text is a block of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < BLOCK_ROWS and (end == at or size + len(texts[end]) <= BLOCK_BYTES):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end


def trigram_counts(texts: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed byte trigrams, one row per text."""
    lengths = np.array([len(t) for t in texts])
    joined = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    if len(joined) < 3:
        return np.zeros((len(texts), buckets), np.float32)
    code = joined[:-2] * np.uint32(0x9E3779B1)
    code += joined[1:-1] * np.uint32(0x85EBCA77)
    code += joined[2:] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x27D4EB2F)
    code >>= np.uint32(32 - buckets.bit_length() + 1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[:-2] == owner[2:]  # a trigram belongs to one text
    cell = owner[:-2][inside] * buckets + code[inside]
    return np.bincount(cell, minlength=len(texts) * buckets).reshape(-1, buckets).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """Latent axes scaled by inverse document frequency, and the labelled vectors on them."""

    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, counts: np.ndarray) -> np.ndarray:
        z = np.log1p(counts) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Labels of the nearest neighbours, weighted by their cosines to the text."""
        out = np.full(len(texts), self.prior)
        if not len(self.vectors):
            return out
        near = min(NEIGHBOURS, len(self.vectors))
        for at, block in _blocks(texts):
            cosines = self.latent(trigram_counts(block)) @ self.vectors.T
            best = np.argpartition(-cosines, near - 1, axis=1)[:, :near]
            weights = np.maximum(np.take_along_axis(cosines, best, 1).astype(float), 0.0)
            total = weights.sum(1)
            votes = (weights * self.labels[best]).sum(1)
            out[at : at + len(block)] = np.where(total > 0, votes / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Rows of ``docs``, and in how many of them each bucket occurs; one vector per task is sent on."""

    def count(batches):
        rows, seen = 0, np.zeros(buckets, np.int64)
        for batch in batches:
            texts = [t.encode() for t in batch.column(0).to_pylist()]
            rows += len(texts)
            for _, block in _blocks(texts):
                seen += (trigram_counts(block, buckets) > 0).sum(0)
        table = pa.table({"bucket": np.arange(-1, buckets), "n": np.concatenate([[rows], seen])})
        yield from table.cast(pa.schema([("bucket", pa.int64()), ("n", pa.int64())])).to_batches()

    counted = docs.select(whole_text().alias("text")).mapInArrow(count, "bucket long, n long")
    totals = {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    return totals.get(-1, 0), np.array([totals.get(b, 0) for b in range(buckets)], float)


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> QualityModel:
    """Fit on at most ``bound`` labelled rows, chosen by a hash of their ids.

    Only ids whose crc32 mod 4 is not 2 are learned from. Document frequencies cover all of
    ``docs``. The latent axes are the leading right singular vectors of the labelled rows.
    """
    known = labels.where(learnable() & F.col("quality").isNotNull())
    chosen = (
        known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    found = docs.select("doc_id", whole_text().alias("text")).join(
        F.broadcast(chosen), "doc_id"  # at most `bound` ids
    )

    def features(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            rows = [c.astype(np.float16 if c.max() < 2048 else np.float32).astype(np.float32).tobytes()
                    for _, block in _blocks(texts) for c in trigram_counts(block)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["doc_id", "quality", "counts"]
            )

    rows = (
        found.select("doc_id", "text", "quality")
        .mapInArrow(features, "doc_id long, quality double, counts binary")
        .dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    )
    total, seen = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + seen)) + 1
    if not rows:
        return QualityModel(np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    matrix = np.log1p(np.stack([np.frombuffer(r["counts"], np.float32) for r in rows])) * idf.astype(np.float32)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    _, vectors = np.linalg.eigh((matrix.T @ matrix).astype(float))
    axes = (idf[:, None] * vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    labels_of = np.array([r["quality"] for r in rows])
    model = QualityModel(axes, np.zeros((0, 1), np.float32), labels_of, float(labels_of.mean()))
    latent = model.latent(np.stack([np.frombuffer(r["counts"], np.float32) for r in rows]))
    return QualityModel(axes, latent.astype(np.float32), labels_of, model.prior)


def with_quality(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1.

    A text without any trigram, null or empty ones included, gets the mean label. Equal texts get
    equal scores; other columns have no influence. A column called ``name`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = docs.drop(name)
    text = free_name(rest, "_text")
    schema = StructType([*rest.schema, StructField(text, StringType()), StructField(name, DoubleType())])

    def score(batches):
        for batch in batches:
            texts = [t.encode() for t in batch.column(batch.num_columns - 1).to_pylist()]
            column = pa.array(shared.value.scores(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    scored = rest.withColumn(text, whole_text() if "text" in rest.columns else F.lit(""))
    return scored.mapInArrow(score, schema).drop(text)
