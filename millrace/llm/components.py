"""Connected components of links between documents, as repeated large-star and small-star steps over tables in the shared folder.

Up to ``FEW`` links, by their count, are joined by one task in memory of a few tens of megabytes; more take the distributed steps, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import longs, stored

#: Links (of 16 bytes) that one task may join.
FEW = 1 << 20


def least_labels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component, of nodes below n with links u - v."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def _joined(batches):
    """u, v: as components() gives them, of all links u, v at once."""
    parts = [(longs(b.column(0)), longs(b.column(1))) for b in batches]
    u, v = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
    names, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    label = least_labels(len(names), at[: len(u)], at[len(u) :])
    moved = np.flatnonzero(label != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[label[moved]])], ["u", "v"])


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """u, v: each node that has a link to another (but the least of its component), and the least one. Takes links u, v in any direction, repeated ones and loops too.

    ``rows`` bounds the number of links, where that is known. The least neighbours are written before they are joined back, so both sides of that join are plain exchanges, whose hot keys Spark can split.
    """
    links = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    links = stored(links, "links", rows)
    known = _print(links)
    if known[0] <= FEW:
        return stored(links.coalesce(1).mapInArrow(_joined, "u long, v long"), "joined")
    while known[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _print(links)
        if now == known:
            break
        known = now
    return links
