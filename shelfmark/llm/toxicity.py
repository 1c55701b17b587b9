"""Toxicity by a factorization machine over hashed terms.

A document is the set of buckets of its lower-cased words and stems.  Besides a weight, each term has a short vector; the
product of two terms' vectors adds what they mean together, such as an insult beside the name of a group, which
additive weights miss.  The model is fitted on at most ``Fit.rows`` labelled documents (those with the smallest hash
of their id) and on up to
``Fit.terms`` buckets that differ most between the classes there, by ``Fit.least`` standard deviations or more.
Scoring reads whole texts where they lie and shuffles nothing.

Null or empty text has no term and scores by the constant alone; without any labelled row of both classes the
score is 0.  Repeated labels of a document count once, the larger one; labels other than 0 and 1 are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import each_batch, land, raw_texts
from shelfmark.session import ship_package

FOLDS = 5
# Bytes of a word's beginning that are a term of their own.
STEMS = (4, 6)


@dataclass(frozen=True)
class Fit:
    rows: int = 16_000
    terms: int = 4_096
    bits: int = 20
    factors: int = 4
    least: float = 3.5
    epochs: int = 40
    step: float = 0.2
    decay: float = 1e-5
    seed: int = 11


@dataclass
class Machine:
    """Constant, weight and vector of each chosen bucket; ``place`` gives a bucket's row or the last one, all zeros."""

    place: np.ndarray
    constant: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, buckets: list[int]) -> float:
        rows = self.place[buckets] if buckets else np.zeros(0, np.int64)
        rows = rows[rows < len(self.weights) - 1]
        vectors = self.vectors[rows]
        total = vectors.sum(axis=0)
        z = self.constant + self.weights[rows].sum() + 0.5 * float((total * total).sum() - (vectors * vectors).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


# Bytes that are ASCII letters (in lower case), digits or beyond ASCII stay; all others part terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def buckets(text: bytes, bits: int) -> list[int]:
    """Distinct buckets of the text's words and of the beginnings of longer ones, which stand for all their endings."""
    mask = (1 << bits) - 1
    terms = set(text.translate(TERMS).split())
    terms |= {b"%s-" % term[:n] for n in STEMS for term in terms if len(term) > n}
    return list({zlib.crc32(term) & mask for term in terms})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), label: str = "toxic") -> Machine:
    """Fit on the labelled rows outside the held-out fold."""
    known = (labels.filter(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
             .filter(~held_out(F.col("doc_id"))))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.rows).select(F.col("doc_id").alias("labelled"), "y")

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.column(1), [sorted(buckets(t, fit.bits)) for t in raw_texts(batch.column(0))]

    # At most fit.rows rows of two numbers: small enough for every executor.  Of rows with the same id one is learnt from.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("doc_id").agg(
        F.min(F.struct(F.sha2("text", 256).alias("digest"), "text", "y")).alias("one")).select("one.text", "one.y")
    features = land(each_batch(rows, work, "y int, buckets array<int>"), "features")
    n, ones = features.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    place = np.full(1 << fit.bits, fit.terms, np.int64)
    empty = Machine(place, -30.0, np.zeros(fit.terms + 1), np.zeros((fit.terms + 1, fit.factors)))
    if not 0 < ones < n:
        return empty
    share = ones / n
    counted = features.select("y", F.explode("buckets").alias("b")).groupBy("b").agg(F.sum("y").alias("hits"), F.count("*").alias("df"))
    surprise = (F.col("hits") - F.col("df") * share) / F.sqrt(F.col("df") * (share * (1 - share)) + 1.0)
    best = (counted.filter("df > 2").select("b", F.abs(surprise).alias("surprise")).filter(F.col("surprise") >= fit.least)
            .orderBy(F.desc("surprise"), "b").limit(fit.terms))
    for row, bucket in enumerate(r["b"] for r in best.collect()):  # fit.terms numbers
        place[bucket] = row

    def narrow(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield batch.column(0), [[int(p) for p in place[b.values.to_numpy()] if p < fit.terms] for b in batch.column(1)]

    table = each_batch(features, narrow, "y int, rows array<int>").toPandas()  # fit.rows lists of fit.terms numbers at most
    order = np.lexsort((table["rows"].map(len), table["rows"].map(lambda r: zlib.crc32(np.asarray(r, np.int32).tobytes()))))
    return _descend([np.asarray(table["rows"].iloc[i], np.int64) for i in order], table["y"].to_numpy(float)[order], place, fit)


def _descend(rows: list[np.ndarray], y: np.ndarray, place: np.ndarray, fit: Fit, size: int = 512) -> Machine:
    """Adagrad on the logistic loss in mini-batches."""
    rng = np.random.default_rng(fit.seed)
    constant = float(np.log(y.mean() / (1 - y.mean())))
    w, v = np.zeros(fit.terms + 1), rng.normal(0, 0.01, (fit.terms + 1, fit.factors))
    v[-1] = 0
    gw, gv, gc = np.full(w.shape, 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(fit.epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), size):
            batch = order[at:at + size]
            lengths = np.array([len(rows[i]) for i in batch])
            flat = np.concatenate([rows[i] for i in batch])
            owner = np.repeat(np.arange(len(batch)), lengths)
            vectors = v[flat]
            total = np.zeros((len(batch), fit.factors))
            np.add.at(total, owner, vectors)
            squares = np.bincount(owner, (vectors * vectors).sum(axis=1), len(batch))
            z = constant + np.bincount(owner, w[flat], len(batch)) + 0.5 * ((total * total).sum(axis=1) - squares)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) / len(batch)
            dw = np.bincount(flat, error[owner], len(w)) + fit.decay * w
            slope = error[owner, None] * (total[owner] - vectors)
            dv = np.stack([np.bincount(flat, slope[:, f], len(w)) for f in range(fit.factors)], axis=1) + fit.decay * v
            gw, gv, gc = gw + dw * dw, gv + dv * dv, gc + error.sum() ** 2
            w -= fit.step * dw / np.sqrt(gw)
            v -= fit.step * dv / np.sqrt(gv)
            constant -= fit.step * error.sum() / np.sqrt(gc)
            w[-1], v[-1] = 0, 0
    return Machine(place, constant, w, v)


def _scorer(docs: DataFrame, machine: Machine, fit: Fit):
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(machine)  # 8 MB of places and fit.terms rows
    return lambda column: [sent.value.score(buckets(t, fit.bits)) for t in raw_texts(column)]


def scores(docs: DataFrame, machine: Machine, fit: Fit = Fit()) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    score = _scorer(docs, machine, fit)

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = score(batch.column(1))
            yield batch.column(0), found, [int(s >= 0.5) for s in found]

    return each_batch(docs.select("doc_id", "text"), work, "doc_id long, score double, predicted int")


def civil(docs: DataFrame, machine: Machine, fit: Fit = Fit()) -> DataFrame:
    """The rows of ``docs`` that score below a half, with all their columns."""
    score = _scorer(docs, machine, fit)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in score(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
