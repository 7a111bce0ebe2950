"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, word pairs and pairs with one word between (letters and digits, A-Z
lower-cased), modulo 2^bits. FTRL-proximal (McMahan et al., 2013) keeps a learning rate for each coordinate and L1 drives most weights to
exactly zero; those that stay are a short list, which is broadcast. Training is sequential, so it takes a bounded sample of labelled
rows in one task; scoring is one narrow pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, gram_hash, mix, prefix_hash, row_slices, small_batches, span_hash, word_bounds

_U = np.uint64
#: Bytes that are no part of a word: ASCII but letters and digits.
APART = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def text_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and feature numbers, repeats included, of the texts."""
    data = LOWER[data]
    a, b, first = word_bounds(data, offsets, APART)
    h = span_hash(prefix_hash(data), a, b)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    mask = _U((1 << bits) - 1)
    rows, marks = [row], [h & mask]
    for reach, code in ((1, gram_hash(h, 2)), (2, None)):
        if len(h) > reach:
            same = row[:-reach] == row[reach:]
            if code is None:
                with np.errstate(over="ignore"):
                    code = mix(h[:-2] * _U(0x9E3779B97F4A7C15) + h[2:] + _U(1))
            rows.append(row[:-reach][same])
            marks.append(code[same] & mask)
    return np.concatenate(rows), np.concatenate(marks).astype(np.int64)


class Ftrl:
    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)  # the last is the bias, which has no L1

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        root = np.sqrt(self.n[at])
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - root) / self.alpha * w
        self.n[at] += g * g


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, bits: int = 20, epochs: int = 6, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and weights that aren't zero (2^bits is the bias).

    Features that only one sampled row has are left out, as L1 would never let them through. Learns from at most max_labelled rows with
    toxic 0 or 1 that aren't held out: those of the least hashes of doc_id. A doc_id that is labelled twice counts with its higher
    label, one that several rows of docs share with its least text. No labelled rows: no weights, every score is 1/2.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select(F.col("doc_id").alias("_id"), "toxic")
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))  # sample: at most max_labelled rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))  # and so are these

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = column_bytes(b["text"])
            for s, e in row_slices(off):
                row, mark = text_features(data[off[s] : off[e]], off[s : e + 1] - off[s], bits)
                pairs = np.unique((row << bits) | mark)
                cuts = np.searchsorted(pairs >> bits, np.arange(e - s + 1))
                low = (pairs & ((1 << bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(s, e - s), b["toxic"].slice(s, e - s), pa.array([low[x:y].tobytes() for x, y in zip(cuts, cuts[1:], strict=False)], pa.binary())], names=["doc_id", "toxic", "marks"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(d, y, m) for b in batches for d, y, m in zip(b["doc_id"].to_pylist(), b["toxic"].to_pylist(), b["marks"].to_pylist(), strict=True)]
        got.sort()
        rows_with = np.zeros(1 << bits, np.int32)
        for _, _, m in got:
            rows_with[np.frombuffer(m, np.int32)] += 1
        marks = [x[rows_with[x] > 1] for x in (np.frombuffer(m, np.int32).astype(np.int64) for _, _, m in got)]
        model, rng = Ftrl(bits, alpha, beta, l1, l2), np.random.default_rng(11)
        for _ in range(epochs):
            for k in rng.permutation(len(got)):
                model.learn(marks[k], got[k][1])
        w = model.weights(np.arange(len(model.z)))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(extract, f"doc_id {kind}, toxic int, marks binary").repartition(1).mapInArrow(train, "at long, w double").collect()  # at most 2^bits rows, in practice a few thousand
    return np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.float64)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = 20) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text; null and empty texts score by the bias alone. Repeated rows and doc_ids are scored
    row by row; an empty table gives no rows."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = shared.value
        table = np.zeros((1 << bits) + 1)
        table[at] = w
        for b in batches:
            data, off = column_bytes(b["text"])
            total = np.full(len(off) - 1, table[-1])
            for s, e in row_slices(off):
                row, mark = text_features(data[off[s] : off[e]], off[s : e + 1] - off[s], bits)
                live = table[mark] != 0
                pairs = np.unique((row[live] << bits) | mark[live])
                total[s:e] += np.bincount(pairs >> bits, table[pairs & ((1 << bits) - 1)], e - s)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
