"""Quality classifier: hashed word n-grams, logistic regression, follow the regularised leader (operator 1).

Features of a text are hashed n-grams of its words: single words and pairs as
written, and pairs and triples of word forms (capitals, digits, signs, length,
last sign, whether the word repeats the one before), so that junk made of unseen
words is still known by its form.  A feature's value is the square root of its
share of the text's n-grams: every text is a sparse vector of length one, and a
score is the logistic function of its dot product with the weights and a bias.

Weights are learnt by FTRL-proximal (per-coordinate rates, L1 and L2), one text
after another in the order of a hash of its id, on ``PARTS`` disjoint parts of a
bounded sample; the weights of the parts are averaged.  The sample is the
``max_rows`` labelled rows of the least hash.  What reaches the driver is the
weight vector, at most ``2 ** BITS`` values.

Null and empty texts have no feature and get the score of the bias; rows
without a label teach nothing; an id with several labels counts as bad if one
of them is 0; without any labelled row every score is 0.5.  Rows that repeat an
id are scored each for itself; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.shared import frugal
from tallyspark.llm.words import U, Words, grams, mix, pieces

BITS = 18
PARTS = 4
MAX_ROWS = 12_000
_ALPHA, _BETA, _L1, _L2, _EPOCHS = 0.6, 1.0, 0.02, 0.02, 3

_SORT = np.zeros(256, np.uint8)  # 0 lower or non-ASCII, 1 upper, 2 digit, 3 sign
_SORT[65:91], _SORT[48:58] = 1, 2
_SORT[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3


def _forms(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A small number for the form of each word, mixed."""
    kinds = _SORT[words.data]
    length = words.end - words.start

    def count(kind: int) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kinds == kind)))
        return sums[words.end] - sums[words.start]

    upper, digit, sign = count(1), count(2), count(3)
    last = words.data[np.maximum(words.end - 1, 0)] if len(length) else np.zeros(0, np.uint8)
    form = np.minimum(upper, 2) * 2 + (upper + sign == length)
    form = form * 3 + np.minimum(digit, 2)
    form = form * 4 + np.minimum(sign, 3)
    form = form * 6 + np.minimum(length // 4, 5)
    form = form * 256 + np.where(kinds[np.maximum(words.end - 1, 0)] == 3, last, 0) if len(length) else form
    same = np.zeros(len(hashes), np.int64)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    return mix((form * 2 + same).astype(np.uint64))


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value), sorted by text and feature."""
    h = words.hashes()
    forms = _forms(words, h)
    keys = []
    for kind, (source, n) in enumerate(((h, 1), (h, 2), (forms, 2), (forms, 3))):
        g = grams(source, n) if n > 1 else source
        own = words.doc[: len(g)] == words.doc[n - 1 : n - 1 + len(g)]
        at = mix(g[own] + U(kind)) >> U(64 - BITS)
        keys.append((words.doc[: len(g)][own].astype(np.uint64) << U(BITS)) | at)
    key, times = np.unique(np.concatenate(keys), return_counts=True)
    doc = (key >> U(BITS)).astype(np.int64)
    total = np.bincount(doc, weights=times, minlength=1)
    return doc, (key & U(2**BITS - 1)).astype(np.int64), np.sqrt(times / np.maximum(total[doc], 1))


@frugal
def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, words in pieces(batch.column(2)):
            doc, at, value = features(words)
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                pa.array([at[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                pa.array([value[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            ], names=["rank", "label", "at", "value"])


def _learn(part: pd.DataFrame) -> pd.DataFrame:
    """FTRL-proximal over one part of the sample."""
    part = part.sort_values("rank")
    rows = [(np.append(np.frombuffer(a, np.int32), 2**BITS), np.append(np.frombuffer(v, np.float64), 1.0), y)
            for a, v, y in zip(part["at"], part["value"], part["label"], strict=True)]
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= _L1, 0.0, (np.sign(zi) * _L1 - zi) / ((_BETA + np.sqrt(ni)) / _ALPHA + _L2))

    for _ in range(_EPOCHS):
        for at, value, y in rows:
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / _ALPHA * w
            n[at] = more
    w = weights(z, n)
    at = np.flatnonzero(w)
    return pd.DataFrame({"at": at, "w": w[at]})


@dataclass(frozen=True)
class QualityModel:
    """Weights by feature; the last is the bias."""

    weights: np.ndarray

    def score(self, docs: DataFrame, text: str = "text", into: str = "score") -> DataFrame:
        """``docs`` with the score (0 to 1) as its last column ``into``, in place of one of that name."""
        docs = docs.drop(into)
        shared = docs.sparkSession.sparkContext.broadcast(self.weights.astype(np.float32))
        names = [f"c{i}" for i in range(len(docs.columns))]
        place = docs.columns.index(text)

        @frugal
        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w = shared.value.astype(np.float64)
            for batch in batches:
                for lo, hi, words in pieces(batch.column(place)):
                    doc, at, value = features(words)
                    dots = np.bincount(doc, weights=w[at] * value, minlength=hi - lo)
                    score = 1 / (1 + np.exp(-np.clip(dots + w[-1], -35, 35)))
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(score)], names=[*names, "score"])

        plain = docs.toDF(*names)
        schema = ", ".join(f"{n} {t}" for n, t in plain.dtypes) + ", score double"
        return plain.mapInArrow(scored, schema).toDF(*docs.columns, into)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, key: str = "doc_id", text: str = "text",
        label: str = "quality") -> QualityModel:
    """A model of ``label`` (1 good, 0 bad) from rows whose crc32 of the id modulo 5 is not 0."""
    taught = labels.select(F.col(key).alias("id"), F.col(label).cast("double").alias("label")).where(
        "id IS NOT NULL AND label IN (0, 1)").where(F.crc32(F.col("id").cast("string")) % 5 != 0)
    taught = taught.groupBy("id").agg(F.min("label").alias("label")).withColumn("rank", F.xxhash64("id"))
    taught = F.broadcast(taught.orderBy("rank", "id").limit(max_rows))  # at most max_rows ids
    sample = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(taught, "id").select(
        "rank", "label", "text")
    learnt = sample.mapInArrow(_vectors, "rank long, label double, at binary, value binary").groupBy(
        F.pmod("rank", F.lit(PARTS))).applyInPandas(_learn, "at long, w double")
    found = learnt.groupBy("at").agg((F.sum("w") / PARTS).alias("w")).toPandas()
    weights = np.zeros(2**BITS + 1)
    weights[found["at"].to_numpy(np.int64)] = found["w"]
    return QualityModel(weights)
