"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document is a vector of counts over triples of character classes (lower, upper, digit, punctuation marks and so
on: the form of its writing), its share of repeated words and lines, damped by log and weighted by inverse
document frequency. A truncated SVD of the labelled sample (at most ``sample_rows`` labelled rows: a documented
bound) gives ``rank`` latent dimensions. The labelled vectors (sample_rows x rank floats: a bounded broadcast) are
compared with each document's vector by exact cosine products in blocks (components are whole multiples of 2^-20, so
the sums have no rounding and don't depend on the block); the ``k`` nearest vote, of equally near ones the first by
doc_id, weighted by similarity to the power ``sharpness``.

Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. Null and empty texts get the vector
zero and the share of label 1 in the sample; without labels the score is 0.5. Rows of labels with null doc_id
or quality are passed over; if a doc_id has several labels the smallest counts, if it has several texts the least.
Equal texts get equal scores. Empty tables give an empty result; extra columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, named, table, texts_of, with_made

_MARKS = b".,!?|*$%&#<>@\"'()-=:;/"
_N = 8 + len(_MARKS)
_CLASS = np.full(256, 7, np.int64)  # other
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 11, 12, 13, 32]] = 3
_CLASS[10] = 4
_CLASS[128:] = 5
_CLASS[list(_MARKS)] = 8 + np.arange(len(_MARKS))
DIM = _N**3 + 32


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and damped values of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    c = _CLASS[np.frombuffer(data, np.uint8)]
    if len(c) < 3:
        c = np.concatenate((c, np.full(3 - len(c), 3)))
    n = np.bincount((c[:-2] * _N + c[1:-1]) * _N + c[2:])
    ids = np.flatnonzero(n)
    values = np.log1p(n[ids] * (1000.0 / (len(c) - 2)))
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = set(zip(words, words[1:], strict=False))
    shares = [len(set(words)) / max(len(words), 1), len(pairs) / max(len(words) - 1, 1), len(set(lines)) / max(len(lines), 1)]
    extra = [_N**3 + 10 * i + min(9, int(10 * x)) for i, x in enumerate(shares)] if words else []
    return np.concatenate((ids, np.array(extra, np.int64))), np.concatenate((values, np.full(len(extra), 4.0)))


class Model:
    """idf: weight of each feature; basis: DIM x rank; vectors: unit rows; labels: 0 or 1."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, rank: int = 48, k: int = 15, sharpness: float = 8.0):
        n = len(ids)
        df = np.zeros(DIM)
        for i in ids:
            df[i] += 1
        self.used = np.flatnonzero(df > 0)
        self.idf = np.log((1 + n) / (1 + df)) + 0.2
        place = np.zeros(DIM, np.int64)
        place[self.used] = np.arange(len(self.used))
        x = np.zeros((n, max(len(self.used), 1)), np.float32)
        for r, (i, v) in enumerate(zip(ids, values, strict=True)):
            x[r, place[i]] = v * self.idf[i]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        rng = np.random.default_rng(7)
        q = rng.standard_normal((x.shape[1], min(rank + 8, *x.shape))).astype(np.float32)
        for _ in range(6):  # subspace iteration
            q = np.linalg.qr(x.T @ (x @ q))[0]
        turn = np.linalg.svd(x @ q, full_matrices=False)[2]
        self.basis = np.zeros((DIM, min(rank, len(turn))), np.float32)
        self.basis[self.used] = (q @ turn.T)[:, :rank]
        self.labels, self.k, self.sharpness = labels.astype(np.float32), k, sharpness
        self.prior = float(labels.mean()) if n else 0.5
        self.vectors = np.stack([self.project(i, v) for i, v in zip(ids, values, strict=True)]) if n else np.zeros((0, 0))

    def project(self, ids: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The unit vector, rounded to multiples of 2^-20."""
        y = (values * self.idf[ids]).astype(np.float32) @ self.basis[ids]
        return np.round(y.astype(np.float64) / max(float(np.linalg.norm(y)), 1e-9) * 2.0**20) / 2.0**20

    def scores(self, texts: list[str], block: int = 100) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(self.k, len(self.labels))
        for at in range(0, len(texts), block):
            part = texts[at : at + block]
            cosine = np.stack([self.project(*counts(t)) if t else np.zeros(self.basis.shape[1]) for t in part]) @ self.vectors.T
            least = np.partition(cosine, len(self.labels) - k, axis=1)[:, [len(self.labels) - k]]
            over, same = cosine > least, cosine == least
            best = np.nonzero(over | same & (same.cumsum(axis=1) <= k - over.sum(axis=1, keepdims=True)))[1].reshape(-1, k)
            weight = np.maximum(np.take_along_axis(cosine, best, 1), 0) ** self.sharpness
            total = weight.sum(axis=1)
            vote = (weight * self.labels[best]).sum(axis=1) / np.maximum(total, 1e-9)
            out[at : at + len(part)] = np.where(total > 1e-9, vote, self.prior)
        return np.clip(out, 0, 1)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 2500) -> Model:
    """Fit on at most sample_rows labelled documents, chosen by a hash of their id."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float64())), batch.column("quality").cast(pa.int64())], ["doc_id", "ids", "vals", "quality"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"doc_id {kind}, ids array<long>, vals array<double>, quality long").toArrow().sort_by("doc_id")
    ids = [np.asarray(x, np.int64) for x in got.column("ids").to_pylist()]
    values = [np.asarray(x) for x in got.column("vals").to_pylist()]
    return Model(ids, values, got.column("quality").to_numpy())


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs' columns and _score, the voted share of label 1; see fresh() for clashing names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def made(batch: pa.RecordBatch, at: int) -> list[pa.Array]:
        return [pa.array(sent.value.scores(texts_of(batch, at)))]

    return with_made(docs, "text", made, [T.StructField(fresh(docs, "_score"), T.DoubleType())])


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, fit(docs, labels)).filter(F.col(fresh(docs, "_score")) >= 0.5).select(*map(named, docs.columns))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = classify(docs, fit(docs, table(spark, sf_dir, "labels"))).select("doc_id", F.col("_score").alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
