"""Language ID by error-correcting output codes.

Each language has a codeword; a binary classifier for each of its bits is a logistic regression over hashed byte bigrams and trigrams
of the text, ASCII letters lower-cased. Decoding adds up, for each language, the logistic losses of its codeword's bits against the bits' margins, each bit
weighted by how well it did in training, and chooses the least; where the second comes close, or too many bits disagree with the chosen word, the text is ambiguous.

Training takes a bounded sample of documents (``PER_LANGUAGE`` of each language, chosen by a hash of the id, so alike at any size), with features from the executors. Prediction
is one pass over whole texts without a shuffle; it broadcasts the weights, whose size is fixed.

Null texts and texts without a letter are "und" with score 0, and not examples. Null languages are no examples. With no examples at all each text is "und". Rows are kept one for one; other columns are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.quality import fold
from millrace.llm.shared import LOWER, source, text_slices

BITS = 16
#: Documents of each language that the classifiers learn from, about; no more than a fifth above.
PER_LANGUAGE = 800
EPOCHS = 5
#: A text is ambiguous if the second language's probability comes this close to the first's.
MARGIN = 0.2
SLICE = 1 << 19
_SIZE = 1 << BITS
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1


def codewords(languages: int) -> np.ndarray:
    """languages x bits of -1 and 1. Up to seven languages: the exhaustive code of all splits in two; beyond: the best of random codes by least distance."""
    if languages < 3:
        return np.array([[1.0], [-1.0]])[:languages]
    if languages <= 7:
        return np.array([(1, *bits) for bits in product((1, -1), repeat=languages - 1) if -1 in bits], float).T
    rng, bits = np.random.default_rng(5), int(np.ceil(10 * np.log2(languages)))
    tried = (rng.choice((-1.0, 1.0), (languages, bits)) for _ in range(50))
    return max(tried, key=lambda m: (np.max(m @ m.T - 2 * bits * np.eye(languages)) * -1, np.abs(m.T @ m - bits * np.eye(bits)).max() * -1))


def grams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams by position (2 x bytes; those that cross documents have the number ``1 << BITS``), and the number of grams of each document."""
    b = LOWER[body].astype(np.uint32)
    n = len(b)
    out = np.full((2, n), _SIZE, np.int32)
    if n > 1:
        two = (b[:-1] << np.uint32(8)) | b[1:]
        out[0, :-1] = (two * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        if n > 2:
            out[1, :-2] = (((two[:-1] << np.uint32(8)) | b[2:]) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        last = offsets[1:][np.diff(offsets) > 0] - 1
        out[:, last] = _SIZE
        out[1, last[last > 0] - 1] = _SIZE
    size = np.diff(offsets)
    return out, np.maximum(size - 1, 0) + np.maximum(size - 2, 0)


def has_letter(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate(([0], np.cumsum(_LETTER[body])))
    found = upto[offsets[1:]] > upto[offsets[:-1]]
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in body[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (1 << BITS) + 1 rows, the last of zeros; a column for each bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit
    scale: float = 30.0

    def margins(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at, total = grams(body, offsets)
        out = np.zeros((len(total), self.code.shape[1]))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            out[full] = np.add.reduceat(self.weights[at[0]] + self.weights[at[1]], offsets[:-1][full], axis=0)
        return self.scale * out / np.maximum(total, 1)[:, None] + self.bias

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, its probability, and whether the text is ambiguous."""
        loss = (np.logaddexp(0, -margins[:, None, :] * self.code[None]) * self.trust).sum(-1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p[np.arange(len(p)), best]
        second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        wrong = (np.sign(margins) != self.code[best]).sum(1)
        distance = min((int((a != b).sum()) for i, a in enumerate(self.code) for b in self.code[:i]), default=1)
        return best, top, (top - second < MARGIN) | (wrong > max(0, (distance - 1) // 2))


def _examples(batches):
    for batch in batches:
        for row, end, body, offsets in text_slices(batch.column(2), SLICE):
            at, total = grams(body, offsets)
            doc = np.repeat(np.arange(end - row), np.diff(offsets))
            keys, counts = np.unique((doc * (_SIZE * 2) + at).ravel(), return_counts=True)
            real = keys & (2 * _SIZE - 1) != _SIZE
            keys, counts = keys[real], counts[real]
            upto = np.searchsorted(keys, np.arange(end - row + 1) * (_SIZE * 2))
            cols = [(keys & (_SIZE - 1)).astype("<u2"), counts.astype("<u4")]
            cells = [[a[i:j].tobytes() for i, j in zip(upto[:-1], upto[1:], strict=True)] for a in cols]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(row, end - row), batch.column(1).slice(row, end - row), *(pa.array(c, pa.binary()) for c in cells), pa.array(total, pa.int64())],
                ["order", "lang", "at", "n", "total"],
            )


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """Learns from the columns doc_id, text and lang of the documents."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text is not null and doc_id is not null")
    found = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(found)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((_SIZE + 1, 1), np.float32), np.zeros(1), np.ones(1))
    place = F.xxhash64(F.col("doc_id"), F.lit("lang"))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, int(min(1.0, per_language / found[k]) * (1 << 30)))])
    chosen = known.filter(F.pmod(place, F.lit(1 << 30)) < share[F.col("lang")]).select(place.alias("order"), "lang", "text")
    rows = chosen.mapInArrow(_examples, "order long, lang string, at binary, n binary, total long").limit(int(1.2 * per_language * len(languages)) + 10).toPandas()
    rows = rows[rows["total"] > 0].sort_values(["order", "total"], kind="stable")
    code = codewords(len(languages))
    model = Model(languages, code, np.zeros((_SIZE + 1, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    number = {k: i for i, k in enumerate(languages)}
    made = [(np.frombuffer(a, "<u2").astype(np.int64), (model.scale * np.frombuffer(n, "<u4") / t).astype(np.float32)[:, None], code[number[k]]) for a, n, t, k in zip(rows["at"], rows["n"], rows["total"], rows["lang"], strict=True)]
    seen = np.full(model.weights.shape, 1e-4, np.float32)
    right = np.zeros(code.shape[1])
    rng = np.random.default_rng(5)
    for epoch in range(epochs):
        for i in rng.permutation(len(made)):
            at, x, y = made[i]
            margin = (model.weights[at] * x).sum(0) + model.bias
            if epoch == epochs - 1:
                right += margin * y > 0
            pull = (-y / (1 + np.exp(np.clip(margin * y, -35, 35)))).astype(np.float32)
            g = x * pull
            seen[at] += g * g
            model.weights[at] -= 0.3 * g / np.sqrt(seen[at])
            model.bias -= 0.02 * pull
    accuracy = np.clip(right / max(len(made), 1), 0.51, 0.999)
    model.trust = np.log(accuracy / (1 - accuracy))
    model.trust /= model.trust.mean()
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: Model = shared.value
        names = np.array([*known.languages, "und"], object)
        for batch in batches:
            for row, end, body, offsets in text_slices(batch.column(1), SLICE):
                letters = has_letter(body, offsets) & (len(known.languages) > 0)
                best, top, doubt = known.decode(known.margins(body, offsets)) if len(known.languages) else (np.zeros(end - row, int), np.zeros(end - row), np.ones(end - row, bool))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), pa.array(names[np.where(letters, best, -1)], pa.string()), pa.array(np.where(letters, top, 0.0)), pa.array(doubt | ~letters)],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    model = train(docs.filter(fold("doc_id", 5) != 0))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")
