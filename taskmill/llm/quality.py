"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import LOWER, VISIBLE_BYTES, free_name, mix, string_parts, text_of, word_hashes, written

BITS = 18
#: Most labelled rows that training uses; those whose ids hash lowest are taken.
TRAINING_ROWS = 12_000
#: Features of a labelled text that one row brings to training.
CHUNK = 1024
THRESHOLD = 0.3


def _shape_bytes() -> np.ndarray:
    """Each byte's kind: lower-case letter, capital, digit, beyond ASCII; else the byte."""
    t = np.arange(256, dtype=np.uint8)
    t[0x61:0x7B], t[0x41:0x5B], t[0x30:0x3A], t[0x80:] = ord("a"), ord("A"), ord("0"), ord("a")
    return t


SHAPE = _shape_bytes()


def features(data: np.ndarray, offs: np.ndarray, bits: int = BITS):
    """(row, bucket, value) of the n-grams of each text, values of a row of length 1.

    N-grams: words between white space in lower case, pairs of them, their shapes (kinds of
    characters, runs once), pairs and triples of shapes, and words that stand again one to three
    places on, whatever the word; each hashed into 2^bits buckets. The value is the square root
    of the count.
    """
    n = len(offs) - 1
    w, row = word_hashes(data, offs, VISIBLE_BYTES, LOWER)
    s, _ = word_hashes(data, offs, VISIBLE_BYTES, SHAPE, collapse=True)
    if not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    u = np.uint64
    keys, rows = [w, mix(s + u(1))], [row, row]
    for lag in (1, 2, 3):
        again = np.flatnonzero((w[lag:] == w[:-lag]) & (row[lag:] == row[:-lag]))
        keys.append(np.full(len(again), mix(np.array([lag], u))[0]))
        rows.append(row[again])
    for x, k, salt in ((w, 2, 11), (s, 2, 12), (s, 3, 13)):
        if len(x) >= k:
            y = np.full(len(x) - k + 1, salt, u)
            for j in range(k):
                y = y * u(0x9E3779B97F4A7C15) + x[j : len(x) - k + 1 + j]
            inside = row[: len(y)] == row[k - 1 :]
            keys.append(mix(y)[inside])
            rows.append(row[: len(y)][inside])
    key = np.sort((np.concatenate(rows).astype(u) << u(bits)) | (np.concatenate(keys) >> u(64 - bits)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    value = np.sqrt(np.diff(np.append(first, len(key))))
    key = key[first]
    at = (key >> u(bits)).astype(np.int64)
    return at, (key & u((1 << bits) - 1)).astype(np.int64), value / np.sqrt(np.bincount(at, value * value, n))[at]


class FTRL:
    """Follow-the-regularised-leader, per coordinate; the last weight is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _featurizer(bits: int):
    def run(batches):
        for batch in batches:
            for lo, data, offs in string_parts(batch.column(2)):
                n = len(offs) - 1
                row, at, value = features(data, offs, bits)
                ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.ListArray.from_arrays(ends, at.astype(np.int32)), pa.ListArray.from_arrays(ends, value.astype(np.float32))], ["key", "label", "at", "value"])

    return run


def _trainer(bits: int):
    def run(batches):
        model, seen, label, held = FTRL(bits), 0, 0, []

        def update():
            if held:
                model.update(np.concatenate([at for at, _ in held]), np.concatenate([value for _, value in held]).astype(np.float64), label)

        for batch in batches:
            chunk, labels = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, at, value in zip(range(len(chunk)), batch.column(2), batch.column(3), strict=True):
                if chunk[i] == 0:
                    update()
                    seen, label, held = seen + 1, labels[i], []
                held.append((at.values.to_numpy().copy(), value.values.to_numpy().copy()))
        update()
        yield pa.RecordBatch.from_pydict({"weights": [model.weights().astype("<f4").tobytes()], "n": [seen]})

    return run


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", held_out: bool = True, bits: int = BITS, most: int = TRAINING_ROWS, epochs: int = 2) -> np.ndarray:
    """Weights of the classifier, from at most `most` labelled rows with whole texts.

    held_out leaves out the rows whose crc32(doc_id as text) mod 5 is 0. Rows are taken and
    seen in order of a hash of their id, so that reruns agree. Null labels and ids are left
    out; of equal ids, one label (the smallest) and one text (of the smallest digest) count.
    Without any row all scores are 0.5.

    Training is one task, which sees the rows once for each epoch, in pieces of CHUNK features that
    Spark has sorted (and spilt where they don't fit): it holds the model, one batch of pieces and one
    text's features, however long the labelled texts are together.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("key"), F.col(label_col).cast("int").alias("label")).dropna()
    if held_out:
        known = known.filter(F.crc32(F.col("key").cast("string")) % 5 != 0)
    known = known.groupBy("key").agg(F.min("label").alias("label"))
    # Bounded by `most`, a parameter.
    sample = F.broadcast(written(known.orderBy(F.xxhash64("key"), "key").limit(most), "quality-sample"))
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), text_of(docs).alias("text")).join(sample, "key").select("key", "label", "text")
    seen = rows.select("key", "label", "text").mapInArrow(_featurizer(bits), "key bigint, label int, at array<int>, value array<float>")
    one = seen.groupBy("key").agg(F.min(F.struct(F.xxhash64("at", "value").alias("h"), "label", "at", "value")).alias("r"))
    one = one.select(F.xxhash64("key").alias("h"), "key", "r.label", "r.at", "r.value")
    last = F.floor(F.greatest(F.size("at") - 1, F.lit(0)) / CHUNK).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(c.alias("chunk"), F.slice("at", c * CHUNK + 1, CHUNK).alias("at"), F.slice("value", c * CHUNK + 1, CHUNK).alias("value")))
    pieces = one.select("h", "key", "label", F.explode(cut).alias("p")).select(F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"), "h", "key", "label", "p.*")
    rows = pieces.repartition(1).sortWithinPartitions("epoch", "h", "key", "chunk").select("chunk", "label", "at", "value")
    got = rows.mapInArrow(_trainer(bits), "weights binary, n bigint").collect()
    return np.frombuffer(got[0]["weights"], "<f4") if got and got[0]["n"] else np.zeros((1 << bits) + 1, np.float32)


def _scorer(shared, bits: int, column: str):
    def run(batches):
        weights = shared.value
        for batch in batches:
            for lo, data, offs in string_parts(batch.column(batch.num_columns - 1)):
                n = len(offs) - 1
                row, at, value = features(data, offs, bits)
                dot = np.bincount(row, weights[at] * value, n) + float(weights[-1])
                score = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, n) for i in range(batch.num_columns - 1)), pa.array(score)], names=[*batch.schema.names[:-1], column])

    return run


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS, column: str = "score") -> DataFrame:
    """docs with a column score, from 0 to 1; a null or empty text has the bias alone.

    Only the text is looked at. A column of docs with that name is replaced; all others stay.
    """
    docs = docs.drop(column)
    schema = docs.withColumn(column, F.lit(0.0)).schema
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2^bits + 1 floats
    return docs.withColumn(free_name(docs, "_quality_text"), text_of(docs)).mapInArrow(_scorer(shared, bits, column), schema)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score below the threshold; columns as they were, also one
    named score."""
    name = free_name(docs, "_quality_score")
    return score(docs, train(docs, labels), column=name).filter(F.col(name) >= threshold).drop(name)
