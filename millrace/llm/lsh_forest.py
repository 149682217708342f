"""Approximate nearest neighbours by inner product, from a hash-prefix forest.

Rows are dealt over shards of bounded size by their ids. A shard holds ``TREES`` sorted arrays of 64-bit labels, each bit the side of a random hyperplane. A query
descends each tree to the longest prefix that any row shares with its label; then all trees ascend together, a bit at a time, and the rows that come to share the prefix
become candidates. It stops where, by the collision chance of the k-th best inner product so far, a better row would have been missed by all trees with a chance of at most ``MISS``. So the number of
candidates follows the data and has no cap, and all trees have met all rows at the root.

For inner products of vectors of different lengths, a component is added that brings all rows to one length. Candidates are ranked by exact inner products in double precision.
Equal vectors of a shard are one entry with the least k + 1 ids, which are all that a result can hold.

Queries go to each shard in batches, as a stream behind the shard's rows, so a task holds one shard and one batch. Vectors that are null or zero, or hold a null or
a component that is not finite, take no part, neither do null ids; vectors of different dimensions are not compared. Rows of one id are one entry each, and none is a neighbour of a query of that id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import longs, ragged, source, stored

TREES = 64
#: The deepest prefix that is looked up; a shard has far fewer rows than prefixes of this length.
DEPTH = 32
#: The chance of missing a row that is as near as the k-th found.
MISS = 0.1
SHARD_ROWS = 1 << 14


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec (of floats as stored, in double): of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad)
    return kept.filter(F.exists("vec", lambda x: x != 0))


class Forest:
    """The trees of one shard, of vectors of one dimension. ``most`` is the largest length of any vector in the whole table."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, group = np.unique(vectors.view(f"V{8 * vectors.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.x, self.k, self.most = vectors[first], k, most
        by = np.argsort(group.ravel(), kind="stable")
        sizes = np.bincount(group.ravel(), minlength=len(first))
        starts = np.cumsum(sizes) - sizes
        self.members = ids[by]  # of each entry in ascending order
        self.first, self.size = starts, np.minimum(sizes, k + 1)
        dim = vectors.shape[1]
        self.planes = np.random.default_rng(3).standard_normal((dim + 1, TREES, 64))
        rest = np.sqrt(np.maximum(most * most - (self.x * self.x).sum(1), 0))
        labels = self._labels(np.concatenate((self.x, rest[:, None]), 1))
        self.order = np.argsort(labels, axis=0)
        self.sorted = np.take_along_axis(labels, self.order, 0)
        self.order = np.ascontiguousarray(self.order.T)
        self.low = self.x.astype(np.float32)

    def _labels(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), TREES), np.uint64)
        for tree in range(TREES):
            bits = x @ self.planes[:, tree] > 0
            out[:, tree] = np.packbits(bits, axis=1).view(">u8").ravel()
        return out

    def search(self, ids: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, vec_id, score) of the nearest found, at most k of each."""
        labels = self._labels(np.concatenate((q, np.zeros((len(q), 1))), 1))
        low, high = np.empty((DEPTH + 1, len(q), TREES), np.int64), np.empty((DEPTH + 1, len(q), TREES), np.int64)
        for depth in range(DEPTH + 1):
            mask = np.uint64(((1 << 64) - 1) ^ ((1 << (64 - depth)) - 1))
            for tree in range(TREES):
                low[depth, :, tree] = np.searchsorted(self.sorted[:, tree], labels[:, tree] & mask)
                high[depth, :, tree] = np.searchsorted(self.sorted[:, tree], labels[:, tree] | ~mask, side="right")
        found = [self._ascend(i, ids[i], q[i], low[:, i], high[:, i]) for i in range(len(q))]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _ascend(self, number: int, own: int, q: np.ndarray, low: np.ndarray, high: np.ndarray):
        length, n = float(np.linalg.norm(q)), len(self.x)
        near = q.astype(np.float32)
        seen = np.zeros(n, bool)
        rows: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        kth, before = -np.inf, None
        for depth in range(int(np.flatnonzero((high > low).any(1)).max(initial=0)), -1, -1):
            a, b = low[depth], high[depth]
            if before is None:
                spans = [(a, b - a)]
            else:
                spans = [(a, before[0] - a), (before[1], b - before[1])]
            before = np.where(b > a, a, b), b
            new = []
            for start, count in spans:
                count = np.maximum(count, 0)
                if count.any():
                    tree = np.repeat(np.arange(TREES), count)
                    new.append(self.order[tree, ragged(start, count)])
            if new:
                fresh = np.zeros(n, bool)
                fresh[np.concatenate(new)] = True
                fresh &= ~seen
                seen |= fresh
                got = np.flatnonzero(fresh)
                rows.append(got)
                marks.append(self.low[got] @ near)
                every = np.concatenate(marks) if len(marks) > 1 else marks[0]
                if len(every) > self.k:
                    kth = np.partition(every, len(every) - self.k - 1)[len(every) - self.k - 1]  # one more, as the query itself may be among them
                    marks, rows = [every], [np.concatenate(rows)]
            if np.isfinite(kth):
                angle = np.arccos(np.clip(kth / (length * self.most), -1, 1))
                if (1 - (1 - angle / np.pi) ** depth) ** TREES <= MISS:
                    break
        got, every = np.concatenate(rows), np.concatenate(marks)
        close = got[every >= kth - 1e-4 * length * self.most] if np.isfinite(kth) else got
        score = self.x[close] @ q
        at = ragged(self.first[close], self.size[close])
        ids, scores = self.members[at], np.repeat(score, self.size[close])
        other = ids != own
        ids, scores = ids[other], scores[other]
        best = np.lexsort((ids, -scores))[: self.k]
        return np.full(len(best), number), ids[best], scores[best]


def search(rows: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest rows found for each query, without the query's own id."""
    data, asked = stored(usable(rows, id_col, vec_col), "rows"), usable(queries, id_col, vec_col)
    n, most = data.agg(F.count("*"), F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()
    shards = max(1, -(-n // SHARD_ROWS))
    most = float(np.sqrt(most or 1.0))
    kept = data.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "vec_id", "vec")
    spread = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "vec")

    def run(batches):
        shard, parts, forests = None, [], None
        for batch in batches:
            where, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(where) != 0) | (np.diff(kinds) != 0)) + 1), len(where)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                ids, cells = longs(batch.column(2).slice(a, b - a)), batch.column(3).slice(a, b - a)
                at = cells.offsets.to_numpy().astype(np.int64)
                values = cells.values.to_numpy(zero_copy_only=False)
                if where[a] != shard:
                    shard, parts, forests = where[a], [], None
                by_size = {int(d): np.flatnonzero(np.diff(at) == d) for d in np.unique(np.diff(at))}
                if kinds[a] == 0:
                    parts += [(d, ids[i], values[ragged(at[i], np.full(len(i), d))].reshape(-1, d)) for d, i in by_size.items()]
                    continue
                if forests is None:
                    forests = {d: Forest(np.concatenate([p[1] for p in parts if p[0] == d]), np.concatenate([p[2] for p in parts if p[0] == d]), most, k) for d in {p[0] for p in parts}}
                for d, i in by_size.items():
                    for j in range(0, len(i) if d in forests else 0, 256):
                        part = i[j : j + 256]
                        number, vec, score = forests[d].search(ids[part], values[ragged(at[part], np.full(len(part), d))].reshape(-1, d))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][number]), pa.array(vec), pa.array(score)], ["query_id", "vec_id", "score"])

    found = kept.unionByName(spread).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "query_id long, vec_id long, score double")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = source(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(rows, rows.filter(F.col("vec_id") % 20 == 0))
