"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network and a calibrated temperature.

A token is a run of letters, of digits or of other signs.  Its index vector is a sparse random one given by its hash; its
word vector adds up the index vectors of its neighbours in the sample, and its own.  The shape of a token (kind,
capitals, length) is a token, too, so words never seen still say something."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm._common import ship, slices, stored, table
from corpuslens.llm._vectors import WHITE, Texts, mix
from corpuslens.llm.language_id import bounded_sample, id_hash

_WORDS, _SHAPES, _WIDTH = 4096, 128, 48
_ROWS = _WORDS + _SHAPES

_KIND = np.full(256, 3, np.uint8)
_KIND[WHITE] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def index_vectors(nonzero: int = 6) -> np.ndarray:
    """A sparse ternary row for each word bucket and shape, from its number."""
    out = np.zeros((_ROWS, _WIDTH), np.float32)
    for k in range(nonzero):
        h = mix(np.arange(_ROWS, dtype=np.uint64) * np.uint64(nonzero) + np.uint64(k + 1))
        np.add.at(out, (np.arange(_ROWS), (h % np.uint64(_WIDTH)).astype(int)), np.where(h >> np.uint64(63), 1.0, -1.0))
    return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, word bucket, shape row) of each token of the texts."""
    texts = Texts(column)
    kind = _KIND[texts.data]
    start = np.ones(len(kind), bool)
    start[1:] = kind[1:] != kind[:-1]
    inner = texts.bounds[1:-1]
    start[inner[inner < len(kind)]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(kind))
    ink = kind[starts] > 0
    starts, ends = starts[ink], ends[ink]
    word = (texts.hashes(starts, ends) % np.uint64(_WORDS)).astype(np.int64)
    upper = np.zeros(len(kind) + 1, np.int64)
    np.cumsum(_UPPER[texts.data], out=upper[1:])
    size = ends - starts
    capitals = upper[ends] - upper[starts]
    case = np.where(capitals == 0, 0, np.where(capitals == size, 3, np.where(capitals == 1, 1, 2)))
    shape = _WORDS + (kind[starts].astype(np.int64) - 1) * 32 + case * 8 + np.minimum(size, 8) - 1
    return np.searchsorted(texts.bounds, starts, side="right") - 1, word, shape


def context_sums(column: pa.Array, index: np.ndarray) -> np.ndarray:
    """Sums, for each row, of the index vectors of the neighbours of its tokens."""
    doc, word, shape = tokens(column)
    out = np.zeros((_ROWS, _WIDTH), np.float32)
    for step in (1, 2):
        a, b = slice(None, -step), slice(step, None)
        same = doc[a] == doc[b]
        for x, y in ((word, word), (word, shape), (shape, shape)):
            for this, other in ((x[a][same], y[b][same]), (y[b][same], x[a][same])):
                pair, n = np.unique(this * _ROWS + other, return_counts=True)
                np.add.at(out, pair // _ROWS, index[pair % _ROWS] * n[:, None].astype(np.float32) / step)
    return out


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Features of each text: damped and plain means of its word vectors, means of its shapes, and a few scalars."""
    doc, word, shape = tokens(column)
    n = len(column)
    words = np.bincount(doc * _WORDS + word, minlength=n * _WORDS).reshape(n, _WORDS).astype(np.float32)
    shapes = np.bincount(doc * _SHAPES + shape - _WORDS, minlength=n * _SHAPES).reshape(n, _SHAPES).astype(np.float32)
    total = np.maximum(words.sum(axis=1, keepdims=True), 1)
    damped = np.sqrt(words)
    parts = [
        (damped @ vectors[:_WORDS]) / np.maximum(damped.sum(axis=1, keepdims=True), 1),
        (words @ vectors[:_WORDS]) / total,
        (shapes @ vectors[_WORDS:]) / total,
    ]
    distinct = (words > 0).sum(axis=1, keepdims=True)
    scalars = [np.log1p(total), distinct / total, np.log1p(words.max(axis=1, keepdims=True) / total * 10)]
    scalars += [np.linalg.norm(p, axis=1, keepdims=True) for p in parts]
    return np.hstack([*parts, *scalars]).astype(np.float32)


@dataclass
class QualityNetwork:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, features: np.ndarray) -> np.ndarray:
        return np.tanh((features - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -60, 60)))


_DECAY = 3e-4


def gradients(w1, b1, w2, b2, x, y) -> dict[str, np.ndarray]:
    """Of the mean log loss and half the decay of squared weights, by backpropagation."""
    h = np.tanh(x @ w1 + b1)
    d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -60, 60))) - y) / len(x)
    back = np.outer(d, w2) * (1 - h * h)
    return {"w1": x.T @ back + _DECAY * w1, "b1": back.sum(axis=0), "w2": h.T @ d + _DECAY * w2, "b2": d.sum()}


def fit_network(vectors, features, labels, hidden: int = 32, epochs: int = 150, seed: int = 6) -> QualityNetwork:
    """Adam on the log loss with weight decay; every fifth row sets the temperature alone."""
    width = features.shape[1]
    rng = np.random.default_rng(seed)
    model = QualityNetwork(
        vectors, features.mean(axis=0), features.std(axis=0) + 1e-3, rng.normal(0, width**-0.5, (width, hidden)),
        np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0, 1.0,
    )
    if len(set(labels.tolist())) < 2:  # one class, or none: its smoothed share
        model.w2[:] = 0
        share = (labels.sum() + 1) / (len(labels) + 2)
        model.b2 = float(np.log(share / (1 - share)))
        return model
    hold = np.arange(len(labels)) % 5 == 4
    x, y = ((features - model.mean) / model.scale)[~hold], labels[~hold].astype(float)
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("w1", model.w1), ("b1", model.b1), ("w2", model.w2))}
    state["b2"] = [0.0, 0.0]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            grads = gradients(model.w1, model.b1, model.w2, model.b2, x[rows], y[rows])
            step += 1
            for name, g in grads.items():
                m, v = state[name]
                state[name] = [m := 0.9 * m + 0.1 * g, v := 0.999 * v + 0.001 * g * g]
                change = 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(model, name, getattr(model, name) - change)
    z, t = model.logits(features[hold]), labels[hold]
    if len(t):
        loss = lambda heat: np.logaddexp(0, np.where(t == 1, -z, z) / heat).mean()
        model.temperature = float(min(np.geomspace(0.5, 5.0, 41), key=loss))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, most_per_label: int = 1000) -> QualityNetwork:
    """Fits on a bounded sample of the texts of ``docs`` with ``labels`` (doc_id once, quality 0 or 1): about ``most_per_label``
    of each label.  Ids are sampled before texts are read; about twice as many ids as that bound are broadcast.  Rows without
    a doc_id or label are left out, null texts are empty; doc_id may be of any type."""
    spark = docs.sparkSession
    ship(spark)
    index = index_vectors()
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    ids = F.broadcast(stored(bounded_sample(known, "quality", most_per_label), "labelled"))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id").select("text", "quality", "doc_id")
    sample = stored(sample.repartition(4, "doc_id").sortWithinPartitions("doc_id", "text"), "labelled-texts")

    def contexts(batches):
        total = np.zeros((_ROWS, _WIDTH), np.float32)
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20, 512):
                total += context_sums(batch.column(0).slice(a, b - a), index)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])

    sums = np.zeros((_ROWS, _WIDTH))
    for row in sample.mapInArrow(contexts, "sums binary").collect():
        sums += np.frombuffer(row["sums"], np.float32).reshape(_ROWS, _WIDTH)
    vectors = (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6) + index / 6**0.5).astype(np.float32)

    def features(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20, 512):
                x = pooled(batch.column(0).slice(a, b - a), vectors)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(a, b - a), pa.array([r.tobytes() for r in x]), batch.column(1).slice(a, b - a)],
                    ["doc_id", "x", "quality"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.mapInArrow(features, f"doc_id {kind}, x binary, quality int").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["x"]))
    width = pooled(pa.array([""]), vectors).shape[1]
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]) if rows else np.zeros((0, width), np.float32)
    if not rows:
        return fit_network(vectors, np.zeros((1, width), np.float32), np.array([1]))
    return fit_network(vectors, x, np.array([r["quality"] for r in rows]))


def score_quality(docs: DataFrame, model: QualityNetwork, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every row; null texts count as empty, null and repeated doc_ids are scored row by
    row, other columns are ignored, and an empty table gives no rows."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20, 512):
                score = model.score(pooled(batch.column(1).slice(a, b - a), model.vectors))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(score.astype(float)), pa.array((score >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by ``score_quality``: null texts count as empty, rows without a doc_id are not held out and
    not learnt from, an empty table gives no rows.  Of several labels of a doc_id the largest counts."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(id_hash() % 4 != 2).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    found = score_quality(docs, fit_quality(docs, labels))
    return found.withColumn("held_out", F.coalesce(id_hash() % 4 == 2, F.lit(False)))
