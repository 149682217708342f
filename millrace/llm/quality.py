"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

Words are runs of letters (any byte of a character beyond ASCII counts as one), of digits, or of other visible characters. Features are the single words and
pairs of words, and the runs of one to three word shapes (such as "capitals" or the very mark), hashed to ``1 << BITS`` weights; a feature's value is
its count over the root of the text's number of words. A score is the logistic function of a sparse dot product.

Training takes a bounded sample of labelled rows (``SAMPLE``, chosen by a hash of the id, so alike at any size), whose features are made on
the executors. Scoring is one pass over whole texts without a shuffle; it broadcasts the weights, whose size is fixed.

Null and empty texts have no features and get the bias's score. Null labels and rows without a document are no examples; with no examples at all each score is 0.5.
Rows are kept one for one, other columns are dropped by :func:`score`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import mix, run_hashes, source, text_slices, tuned, word_hashes

BITS = 18
#: Labelled rows that the classifier learns from, about; no more than a tenth above.
SAMPLE = 6000
EPOCHS = 4
SLICE = 1 << 19

# 0 white space, 1 letters, 2 digits, 3 other
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[*range(0x21), 0x7F]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_CLASS[0x30:0x3A] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[0x61:0x7B] = 1


def features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all documents of a slice (one entry for each occurrence), the document of each, and the number of words of each document."""
    kind = _CLASS[body]
    new = np.ones(len(body) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    cuts = np.flatnonzero(new)
    starts, ends = cuts[:-1], cuts[1:]
    seen = kind[starts] != 0
    starts, ends = starts[seen], ends[seen]
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    h = word_hashes(body, starts, ends)
    up, low = np.concatenate(([0], np.cumsum(_UPPER[body]))), np.concatenate(([0], np.cumsum(_LOWER[body])))
    ups, lows, size = up[ends] - up[starts], low[ends] - low[starts], ends - starts
    shape = kind[starts].astype(np.uint64) * np.uint64(64) + (np.minimum(ups, 2) * 2 + np.minimum(lows, 1)).astype(np.uint64)
    shape = np.where(kind[starts] == 1, mix(shape), np.where(kind[starts] == 2, mix(np.uint64(7) + np.minimum(size, 4).astype(np.uint64)), mix(h + np.uint64(11))))
    out, owner = [], []
    for salt, (values, most) in enumerate(((h, 2), (shape, 3))):
        for n in range(1, most + 1):
            g = run_hashes(values, n)
            ok = doc[: len(g)] == doc[n - 1 :]
            out.append(((g[ok] ^ np.uint64(salt * 8 + n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
            owner.append(doc[: len(g)][ok])
    return np.concatenate(out).astype(np.int64), np.concatenate(owner), np.diff(first)


class Ftrl:
    """Logistic regression by FTRL-proximal updates, an example at a time; the last weight is the bias."""

    def __init__(self, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def _examples(batches):
    for batch in batches:
        for row, end, body, offsets in text_slices(batch.column(1), SLICE):
            idx, owner, sizes = features(body, offsets)
            keys, counts = np.unique(owner * (1 << BITS) + idx, return_counts=True)
            upto = np.searchsorted(keys, np.arange(end - row + 1) << BITS)
            at, n = (keys & ((1 << BITS) - 1)).astype("<u4"), counts.astype("<u4")
            cells = [[a[i:j].tobytes() for i, j in zip(upto[:-1], upto[1:], strict=True)] for a in (at, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), batch.column(2).slice(row, end - row), *(pa.array(c, pa.binary()) for c in cells), pa.array(sizes, pa.int64())],
                ["order", "label", "at", "n", "words"],
            )


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from the documents (doc_id, text) and their labels (doc_id, and a 0 or 1)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label in (0, 1) and doc_id is not null")
    total = known.count()
    place = F.xxhash64(F.col("doc_id"), F.lit(label))
    share = min(1.0, sample / max(total, 1))
    chosen = known.filter(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30))).withColumn("order", place).limit(int(sample * 1.1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("order", "text", "label").mapInArrow(_examples, "order long, label int, at binary, n binary, words long").toPandas()
    rows = rows.sort_values(["order", "label", "words"], kind="stable")
    model, rng = Ftrl(), np.random.default_rng(8)
    made = [
        (np.append(np.frombuffer(a, "<u4").astype(np.int64), 1 << BITS), np.append(np.frombuffer(n, "<u4") / np.sqrt(max(w, 1)), 1.0), y)
        for a, n, w, y in zip(rows["at"], rows["n"], rows["words"], rows["label"], strict=True)
    ]
    for _ in range(epochs):
        for i in rng.permutation(len(made)):
            model.learn(*made[i])
    return model.weights().astype(np.float32)


def scores(weights: np.ndarray, column: pa.Array) -> np.ndarray:
    out = np.empty(len(column))
    for row, end, body, offsets in text_slices(column, SLICE):
        idx, owner, sizes = features(body, offsets)
        dot = np.bincount(owner, weights[idx], minlength=end - row) / np.sqrt(np.maximum(sizes, 1)) + weights[-1]
        out[row:end] = 1 / (1 + np.exp(-np.clip(dot, -35, 35)))
    return out


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    shared = tuned(docs).sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(shared.value, batch.column(1)))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, weights: np.ndarray, least: float = 0.7, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that score ``least`` or more."""
    shared = tuned(docs).sparkSession.sparkContext.broadcast(weights)

    text = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(scores(shared.value, batch.column(text).cast(pa.string())) >= least))

    return docs.mapInArrow(run, docs.schema)


def fold(column: str, parts: int):
    """crc32 of an id as text, modulo the number of parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents", "doc_id", "text")
    labels = source(spark, sf_dir, "labels", "doc_id", "quality").filter(fold("doc_id", 4) != 2)
    found = score(docs, train(docs, labels))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
