"""Language identification: TF-IDF vectors of byte trigrams against several clustered centroids per language."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.llm._common import ship, slices, table
from corpuslens.llm._vectors import Texts

UNDETERMINED = "und"
_BUCKETS = 4096
#: Texts that a model is fitted on, at most about; the matrix of their counts is on the driver.
_MOST_ROWS = 8192
_ASCII_LETTER = re.compile("[A-Za-z]")

#: Letters in lower case and all bytes of other characters stay; whatever else is a space.
_FOLD = np.full(256, 32, np.uint8)
for _byte in (*range(ord("a"), ord("z") + 1), *range(128, 256)):
    _FOLD[_byte] = _byte


def has_letter(text: str | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(x.isalpha() for x in text))


def trigram_counts(column: pa.Array) -> np.ndarray:
    """Counts of hashed byte trigrams, a row for each text; each text stands between spaces."""
    texts = Texts(column, lower=True)
    n = len(column)
    data = np.full(len(texts.data) + 2 * n, 32, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(texts.bounds))
    data[np.arange(len(texts.data)) + 2 * owner + 1] = _FOLD[texts.data]
    if len(data) < 3:
        return np.zeros((n, _BUCKETS), np.float32)
    of = np.repeat(np.arange(n), np.diff(texts.bounds) + 2)
    wide = data.astype(np.uint32)
    gram = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    keep = (of[:-2] == of[2:]) & (gram != 0x202020)
    bucket = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    return np.bincount(of[:-2][keep] * _BUCKETS + bucket[keep], minlength=n * _BUCKETS).reshape(n, _BUCKETS).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class CentroidModel:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reject_below: np.ndarray  # a cosine, for each centroid
    fallback: str

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _unit(np.log1p(counts) * self.idf)

    def predict(self, counts: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of the nearest centroid, its cosine, and whether the text lies farther than the centroid's own."""
        if not self.languages:
            return [self.fallback] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(len(counts)), best].astype(float), 0.0, 1.0)
        return [self.languages[i] for i in best], score, score < self.reject_below[best]


def fit_centroids(languages: list[str], counts: np.ndarray, per_language: int, seed: int = 7) -> CentroidModel:
    """Spherical k-means in each language, started from seeded rows."""
    if not languages:
        return CentroidModel([], np.zeros((0, _BUCKETS)), np.ones(_BUCKETS), np.zeros(0), UNDETERMINED)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 0.1).astype(np.float32)
    rows = _unit(np.log1p(counts) * idf)
    names = np.array(languages)
    found, of, floors = [], [], []
    for name in sorted(set(languages)):
        own = rows[names == name]
        rng = np.random.default_rng(seed)
        centres = own[rng.choice(len(own), min(per_language, len(own)), replace=False)]
        for _ in range(15):
            nearest = np.argmax(own @ centres.T, axis=1)
            sums = np.stack([own[nearest == i].sum(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)])
            centres = _unit(sums)
        cosine = own @ centres.T
        nearest = np.argmax(cosine, axis=1)
        for i, centre in enumerate(centres):
            members = cosine[nearest == i, i]
            found.append(centre)
            of.append(name)
            floors.append(0.5 * float(np.quantile(members, 0.05)) if len(members) else 0.0)
    most = max(sorted(set(languages)), key=languages.count)
    return CentroidModel(of, np.stack(found).astype(np.float32), idf, np.array(floors), most)


def id_hash() -> Column:
    """CRC-32 of doc_id as text; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def bounded_sample(rows: DataFrame, by: str, most: int, most_values: int = 1000, most_rows: int = 1 << 30) -> DataFrame:
    """About ``most`` rows of ``rows`` (doc_id, ``by``, others) for each value of ``by``, all of them where there are no more:
    those whose seeded hash (of all their columns) lies below the share of the value's rows that is wanted.  Rows that
    repeat in full count once.  Values are counted first, which sends one row a task and value; nothing is ranked or sorted.  More than
    ``most_values`` different values are an error, as a model can't be bounded then; where there are so many that they have more
    than about ``most_rows`` together, each has fewer."""
    counts = rows.groupBy(F.col(by).alias("value")).count().limit(most_values + 1).collect()
    if len(counts) > most_values:
        raise ValueError(f"{by} has more than {most_values} values")
    most = min(most, max(1, most_rows // max(1, len(counts))))
    shares = [(row["value"], min(1.0, most / row["count"])) for row in counts if row["value"] is not None]
    kind = T.StructType([T.StructField("value", rows.schema[by].dataType), T.StructField("share", T.DoubleType())])
    shares = F.broadcast(rows.sparkSession.createDataFrame(shares, kind))  # a row for each of at most ``most_values``
    place = F.pmod(F.xxhash64(*rows.columns, F.lit(5)), F.lit(1 << 30)) / F.lit(1 << 30)
    whole = rows.select(F.struct(*rows.columns).alias("row"), place.alias("place"))
    return whole.join(shares, F.col("row")[by] == F.col("value")).filter("place < share").select("row.*").distinct()


def fit_language_model(labelled: DataFrame, most_per_language: int = 400, per_language: int = 4) -> CentroidModel:
    """Fits on a bounded sample of ``labelled`` (doc_id, text, lang): about ``most_per_language`` whole texts of each of up to
    1000 languages, and of 8192 in all; rows without a language are left out, null texts are empty.  What reaches the driver is
    the hashed counts of these texts, of fixed width."""
    ship(labelled.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), 1 << 20, 512):
                counts = trigram_counts(batch.column(0).slice(a, b - a))
                sparse = [np.flatnonzero(x) for x in counts]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(a, b - a),
                        pa.array([i.astype("<u2").tobytes() for i in sparse]),
                        pa.array([x[i].astype("<f4").tobytes() for x, i in zip(counts, sparse)]),
                    ],
                    ["lang", "at", "n"],
                )

    sample = bounded_sample(labelled.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang"), "lang", most_per_language, most_rows=_MOST_ROWS)
    rows = sample.select("text", "lang").mapInArrow(run, "lang string, at binary, n binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["at"], r["n"]))
    counts = np.zeros((len(rows), _BUCKETS), np.float32)
    for out, row in zip(counts, rows):
        out[np.frombuffer(row["at"], "<u2")] = np.frombuffer(row["n"], "<f4")
    return fit_centroids([r["lang"] for r in rows], counts, per_language)


def predict_language(docs: DataFrame, model: CentroidModel) -> DataFrame:
    """doc_id, lang_pred, score (the cosine) and ``rejected`` (farther than the centroid's own members reach) of every row.

    Null texts and texts without a letter are ``und`` with score 0.  Null and repeated doc_ids are answered row by row,
    other columns ignored.  Without any training rows the answer is ``und``."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20, 512):
                texts = batch.column(1).slice(a, b - a)
                names, score, rejected = model.predict(trigram_counts(texts))
                known = [has_letter(x) for x in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([n if k else UNDETERMINED for n, k in zip(names, known)]),
                        pa.array([float(s) if k else 0.0 for s, k in zip(score, known)]),
                        pa.array([bool(r) or not k for r, k in zip(rejected, known)]),
                    ],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document, by ``predict_language``: texts null or without a letter are ``und``, rows without a doc_id
    are not held out and not learnt from, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    learn = docs.filter(F.col("lang").isNotNull() & (id_hash() % 5 != 0)).select("doc_id", "text", "lang")
    found = predict_language(docs, fit_language_model(learn))
    return found.withColumn("held_out", F.coalesce(id_hash() % 5 == 0, F.lit(False)))
