"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed into a bit sketch: each shingle flips the bit of its hash. So sketches differ in at most as many bits as the sets in
shingles, whatever the length of the sketch. Sets are banded by size; in a band, two sets that reach the similarity differ in at most d shingles. Two sketches serve a band:

* A sketch of 2 ** 64 bits, cut into m > d blocks, finds the pairs. At most d blocks of two similar sets differ, so at least m - d are the same (the pigeonhole). Blocks are put in one
  order that their contents fix, those with most rare shingles first, and each set is filed under its first d + 1: two similar sets meet under at least one. Few bits of a block are
  set, so a block is known by the exclusive or of a random word for each set bit, which is 64 parities of random halves of its bits: equal blocks have equal words. Which
  shingles are common is learnt from a bounded sample of documents; it changes only how many sets meet in vain.
* A sketch of some 16 d bits (a power of two up to ``SKETCH_BITS``; a longer one is folded by XOR where bands meet) is carried to the keys. Pairs whose sketches or sizes differ by too much are dropped
  without their texts.

Equal sets are one: the least document stands for them. A key that documents share counts a row a batch before it is dealt out. Then, in three turns, only keys whose documents are
not in one component yet are looked at, and of keys with the same documents only one:

1. keys of more than ``TILE`` documents: each document with the least one there, so a key that a third of all documents share makes no more pairs than documents;
2. of all pairs that sizes and sketches allow, a spanning forest under each key, nearest pairs first;
3. all pairs of different components that are left, which is exact, as the others have been tested or join what is joined.

Pairs are verified on the texts between turns. A key of more than ``TILE`` documents is cut into chunks, those of its largest component apart, and each two chunks that hold
different components are a task's share.

Texts without words have no shingles and no links; an empty table has no rows. A null doc_id has no links, and its own component is null. Rows of one doc_id are one document that has the links
of each. Texts are read whole, however long. Similarity that just reaches the limit is a link. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.components import components, least_labels
from millrace.llm.shared import LOWER, NON_SPACE, longs, mix, ragged, raw, run_hashes, source, stored, text_slices, tuned, word_hashes, words

#: Bits of a sketch that is carried to the keys, at most: a longer set has more keys, so its sketches must not grow too. Sketches that are too short let pairs through, which their texts then decide.
SKETCH_BITS = 1 << 13
#: Keys in a bucket, about, and bits of a key beside its bucket: so few keys of a bucket agree by chance, however many buckets there are.
BUCKET_KEYS, KEY_BITS = 1 << 19, 40
#: Documents from which common shingles are learnt, about, and how many of the commonest count as such at most.
SAMPLE, COMMON = 5000, 1 << 17
#: Ids (of 8 bytes), ids and their components, or digests (of 16) and their documents that may be broadcast.
BROADCAST_IDS = 1 << 18
#: Documents of a key that are compared at once; a key of more is cut into chunks.
TILE = 512
#: Rows of chunks in a bucket, about.
BUCKET_ROWS = 1 << 15
#: Bytes of sketches that are compared at once.
COMPARE_BYTES = 1 << 24


def shingle_sets(column: pa.Array, k: int):
    """For each text: the sorted distinct hashes of its runs of k words, or of all its words if they are fewer."""
    empty = np.zeros(0, np.uint64)
    for row, end, body, offsets in text_slices(column):
        body = LOWER[body]
        starts, ends, first = words(body, offsets, NON_SPACE)
        h = word_hashes(body, starts, ends)
        g = run_hashes(h, k)
        for i in range(end - row):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                s = np.sort(g[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            else:
                yield run_hashes(h[a:b], int(b - a)) if b > a else empty


@dataclass(frozen=True)
class Rule:
    """Sets are similar if den * shared >= num * united."""

    k: int
    num: int
    den: int

    def bands(self) -> np.ndarray:
        """The least size of each band; a similar set of a larger size is in the same band or the next."""
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2, -(-edges[-1] * self.den // self.num)))
        return np.array(edges)

    def instances(self, n: int, edges: np.ndarray) -> list[tuple[int, int, int]]:
        """(band of the smaller set, d, blocks) of the bands in which a set of n may have to meet others."""
        own = int(np.searchsorted(edges, n, side="right")) - 1
        out = []
        for band in (own, own - 1):
            if band >= 0 and (band == own or self.num * n <= self.den * (int(edges[own]) - 1)):
                d = (self.den - self.num) * (int(edges[band + 1]) - 1) // self.num
                out.append((band, d, d + 1 if d < 4 else -(-5 * (d + 1) // 4)))
        return out

    def sketch_bits(self, n: int, edges: np.ndarray) -> int:
        """Bits of the sketch of a set of n in its band: a power of two, 16 or more for each shingle that may differ, up to ``SKETCH_BITS``."""
        d = (self.den - self.num) * (int(edges[int(np.searchsorted(edges, n, side="right"))]) - 1) // self.num
        return min(max(512, 1 << (16 * d - 1).bit_length()), SKETCH_BITS) if d else 512

    def most(self, sizes):
        """How much two similar sets of such sizes together may differ at most."""
        return sizes * (self.den - self.num) // (self.den + self.num)


def block_keys(s: np.ndarray, rare: np.ndarray, band: int, d: int, blocks: int) -> np.ndarray:
    """The keys of the first d + 1 blocks of a set's sketch. ``rare`` tells which of the sorted hashes are rare.

    A block has a bit for each of 2 ** 64 hashes, of which few are set; it is kept as the exclusive or of its shingles' random words.
    """
    u = np.uint64
    at = ((s >> u(32)) * u(blocks)) >> u(32)
    cut = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    value, weight = np.bitwise_xor.reduceat(mix(s), cut), np.add.reduceat(rare, cut)
    at, count = at[cut], np.diff(np.append(cut, len(s)))
    salt = u((band * 0x9E3779B97F4A7C15 + 0x1234567) & ((1 << 64) - 1))
    keys = mix(value ^ mix(at + salt))
    order = np.lexsort((keys, -(weight * 4096 + count)))[: d + 1]
    if len(order) == d + 1:
        return keys[order]
    rest = np.setdiff1d(np.arange(blocks, dtype=np.uint64), at)
    return np.concatenate((keys, np.sort(mix(mix(rest + salt)))[: d + 1 - len(keys)]))


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of the shingles that several documents of a sample hold, the ``COMMON`` most frequent at most."""
    share = int(min(1.0, SAMPLE / max(docs.count(), 1)) * (1 << 30))

    def run(batches):
        for batch in batches:
            for s in shingle_sets(batch.column(0), k):
                yield pa.RecordBatch.from_arrays([pa.array(s.view("<i8"))], ["s"])

    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    held = sampled.select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count("*").alias("n")).filter("n > 1")
    return np.sort(held.orderBy(F.desc("n"), "s").limit(COMMON).select("s").toPandas()["s"].to_numpy().astype(np.int64).view(np.uint64))


def profiles(docs: DataFrame, rule: Rule, common: np.ndarray) -> DataFrame:
    """doc_id, n (shingles), digest (of the set), sketch, keys (64-bit): a row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        edges, usual = rule.bands(), shared.value
        for batch in batches:
            rows = []
            for s in shingle_sets(batch.column(1), rule.k):
                if not len(s):
                    rows.append((0, b"", b"", b""))
                    continue
                at = np.minimum(np.searchsorted(usual, s), max(len(usual) - 1, 0))
                rare = (usual[at] != s).astype(np.int64) if len(usual) else np.ones(len(s), np.int64)
                keys = np.concatenate([block_keys(s, rare, *x) for x in rule.instances(len(s), edges)])
                bits = rule.sketch_bits(len(s), edges)
                sketch = np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool))
                rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch.tobytes(), keys.astype("<u8").tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "n", "digest", "sketch", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, digest binary, sketch binary, keys binary")


def _groups(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of (key, doc) and, in it, the first place of each place's key."""
    order = np.lexsort((docs, keys))
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    return order, np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)


def members(filed: DataFrame, buckets: int) -> DataFrame:
    """key, doc_id: of the keys under which several documents are filed. Takes doc_id, keys. A key's documents of one batch beside the first need no bucket, as they know that it has several."""

    def cut_by(bucket):
        return np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))

    def packed(keys, ids, many):
        """A row for each bucket: 40 bits of each key, places in a list of documents, the list, and whether the batch has several."""
        bucket = keys >> KEY_BITS
        cut, cells = cut_by(bucket), []
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            own, at = np.unique(ids[i:j], return_inverse=True)
            k = keys[i:j]
            cells.append((k.astype("<u4").tobytes() + (k >> 32).astype(np.uint8).tobytes(), at.astype("<u4").tobytes(), own.astype("<i8").tobytes(), many[i:j].astype(np.uint8).tobytes()))
        return bucket[cut[:-1]], cells

    def local(batches):
        for batch in batches:
            body, at = raw(batch.column(1))
            keys, ids = body.view("<u8"), np.repeat(longs(batch.column(0)), np.diff(at) // 8)
            if not len(keys):
                continue
            keys = ((keys % np.uint64(buckets)) << np.uint64(KEY_BITS) | (keys // np.uint64(buckets)) & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)
            order, first = _groups(keys, ids)
            keys, ids = keys[order], ids[order]
            lead = first == np.arange(len(first))
            bucket, cells = packed(keys[lead], ids[lead], np.diff(np.append(np.flatnonzero(lead), len(first))) > 1)
            if not lead.all():
                where = ids[~lead] % buckets
                order = np.argsort(where, kind="stable")
                where, k, d = where[order], keys[~lead][order], ids[~lead][order]
                cut = cut_by(where)
                bucket = np.concatenate((bucket, where[cut[:-1]]))
                cells += [(k[i:j].tobytes(), b"", d[i:j].tobytes(), None) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), *(pa.array(c, pa.binary()) for c in zip(*cells, strict=True))], ["bucket", "x", "y", "z", "w"])

    def meet(group: pa.Table) -> pa.Table:
        bucket, out, held = group["bucket"][0].as_py(), [], [(np.zeros(0, np.int64),) * 2]
        for x, y, z, w in zip(*(group[c].to_pylist() for c in "xyzw"), strict=True):
            if w is None:
                held.append((np.frombuffer(x, "<i8"), np.frombuffer(z, "<i8")))
                continue
            n = len(w)
            low, high = np.frombuffer(x, "<u4", n), np.frombuffer(x, np.uint8, n, 4 * n)
            out.append((low.astype(np.int64) | high.astype(np.int64) << 32 | bucket << KEY_BITS, np.frombuffer(z, "<i8")[np.frombuffer(y, "<u4")], np.frombuffer(w, np.uint8)))
        if out:
            keys, ids, many = (np.concatenate(c) for c in zip(*out, strict=True))
            order, first = _groups(keys, ids)
            keys, ids, many = keys[order], ids[order], many[order]
            several = np.bincount(first, 1 + many.astype(np.int64), minlength=len(first))[first] > 1
            held.append((keys[several], ids[several]))
        return pa.table([np.concatenate(c) for c in zip(*held, strict=True)], names=["key", "doc_id"])

    return filed.mapInArrow(local, "bucket long, x binary, y binary, z binary, w binary").groupBy("bucket").applyInArrow(meet, "key long, doc_id long")


def fold(column: pa.Array, rows: np.ndarray, size: int) -> np.ndarray:
    """Sketches of rows, folded to ``size`` bytes, as 64-bit words."""
    body, at = raw(column)
    lengths = np.diff(at)[rows]
    out = np.empty((len(rows), size), np.uint8)
    for length in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == length)
        cells = body[ragged(at[rows[own]], np.full(len(own), length))].reshape(len(own), length // size, size)
        out[own] = np.bitwise_xor.reduce(cells, axis=1)
    return out.view("<u8")


def forest(label: np.ndarray, one: np.ndarray, two: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links one - two that join the labels of all nodes, lightest first, without a cycle."""
    chosen = []
    names, label = np.unique(label, return_inverse=True)
    order = np.lexsort((two, one, weight))
    u, v = label[one[order]], label[two[order]]
    parent = np.arange(len(names))
    live = np.arange(len(order))
    while True:
        a, b = parent[u[live]], parent[v[live]]
        live = live[a != b]
        if not len(live):
            return order[np.concatenate(chosen)] if chosen else np.zeros(0, np.int64)
        a, b = a[a != b], b[a != b]
        best = np.full(len(names), len(order))
        np.minimum.at(best, a, live)
        np.minimum.at(best, b, live)
        take = np.unique(best[best < len(order)])
        chosen.append(take)
        parent = least_labels(len(names), parent[u[take]], parent[v[take]])[parent]


def compared(rows: DataFrame, rule: Rule, buckets: int, spanning: bool) -> DataFrame:
    """a, b: pairs of documents of different roots under a key that sizes and sketches allow; if ``spanning``, only a forest of them.

    Takes key, x, y, c, doc_id, root, n, sketch: a row is of chunk c, in the tile of chunks x and y of a key. A row of one chunk meets those of the other.
    """

    def run(group: pa.Table) -> pa.Table:
        key, x, y, c, ids, roots, sizes = (longs(group[name].combine_chunks()) for name in ("key", "x", "y", "c", "doc_id", "root", "n"))
        order = np.lexsort((ids, c, y, x, key))
        key, x, y, c, ids, roots, sizes = (v[order] for v in (key, x, y, c, ids, roots, sizes))
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
        ends = np.append(new[1:], len(key))
        tile = np.repeat(np.arange(len(new)), ends - new)
        # where the other documents that each row meets begin and end: those after it in its own chunk, or all of the second chunk
        later = np.searchsorted(tile * 2 + ((c == y) & (x != y)), tile * 2 + 1)
        start = np.where(x == y, np.arange(len(key)) + 1, later)
        count = np.where((x == y) | (c == x), ends[tile] - start, 0)
        width = np.minimum.reduceat(np.diff(raw(group["sketch"])[1])[order], new)[tile]
        found = [(np.zeros(0, np.int64),) * 3]
        for size in np.unique(width).tolist():
            own = np.flatnonzero(width == size)
            sketches, place = fold(group["sketch"], order[own], size), np.zeros(len(key), np.int64)
            place[own] = np.arange(len(own))
            own = own[count[own] > 0]
            upto = np.cumsum(count[own])
            i = 0
            while i < len(own):
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + COMPARE_BYTES // size)))
                one, two = np.repeat(own[i:j], count[own[i:j]]), ragged(start[own[i:j]], count[own[i:j]])
                i = j
                ok = (roots[one] != roots[two]) & (rule.den * np.minimum(sizes[one], sizes[two]) >= rule.num * np.maximum(sizes[one], sizes[two]))
                one, two = one[ok], two[ok]
                apart = np.bitwise_count(sketches[place[one]] ^ sketches[place[two]]).sum(1, dtype=np.int64)
                ok = apart <= rule.most(sizes[one] + sizes[two])
                found.append((one[ok], two[ok], apart[ok]))
        one, two, apart = (np.concatenate(v) for v in zip(*found, strict=True))
        if spanning and len(one):
            tops, of = np.unique(roots, return_inverse=True)
            keep = forest(tile * len(tops) + of, one, two, apart)
            one, two = one[keep], two[keep]
        a, b = np.minimum(ids[one], ids[two]), np.maximum(ids[one], ids[two])
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)]
        return pa.table([a[new], b[new]], names=["a", "b"])

    bucket = F.pmod(F.xxhash64("key", "x", "y"), F.lit(buckets)).alias("bucket")
    return rows.select(bucket, "key", "x", "y", "c", "doc_id", "root", "n", "sketch").groupBy("bucket").applyInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """u, v: the pairs a, b whose sets are similar, by the texts themselves."""

    def run(batches):
        for batch in batches:
            keep, last, known = [], None, None
            for a, s, t in zip(batch.column(0).to_pylist(), batch.column(2), shingle_sets(batch.column(3), rule.k), strict=True):
                text = s.as_py()
                if last != (a, text):
                    last, known = (a, text), next(shingle_sets(pa.array([text]), rule.k))
                both = np.concatenate((known, t))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared > 0 and rule.den * shared >= rule.num * (len(known) + len(t) - shared))
            ok = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["u", "v"])

    side = lambda p: texts.select(F.col("doc_id").alias(p), F.col("text").alias(f"text_{p}"))
    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "u long, v long")


def _rooted(frame: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root: the component of doc_id so far."""
    side = roots.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
    side = F.broadcast(side) if roots.count() <= BROADCAST_IDS else side
    return frame.join(side, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))


def mixed(held: DataFrame, roots: DataFrame) -> DataFrame:
    """key, doc_id, root, and of the key: g (documents), low (the least of them), major (a root that most have), n_major. Only of keys with several roots, and one of those with the same documents."""
    rows, many = _rooted(held, roots), held.count()
    part = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), *[F.sum(F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(1 << 31))).alias(f"x{i}") for i in range(4)])
    keys = part.groupBy("key").agg(
        F.count("*").alias("roots"), F.sum("n").alias("g"), F.min("low").alias("low"), F.max_by("root", F.struct("n", "root")).alias("major"), F.max("n").alias("n_major"), *[F.sum(f"x{i}").alias(f"x{i}") for i in range(4)]
    )
    columns = ["key", "low", "major", "n_major"]
    once = keys.filter("roots > 1").groupBy("g", "x0", "x1", "x2", "x3").agg(F.min(F.struct(*columns)).alias("k")).select("g", "k.*")
    return stored(rows.join(stored(once, "keys", many), "key"), "mixed")


def _pairs(rows: DataFrame, real: DataFrame, rule: Rule, spanning: bool) -> DataFrame:
    """The pairs of the tiles of rows with key, doc_id, root, c and tiles (x, y)."""
    many = rows.agg(F.sum(F.size("tiles"))).first()[0] or 0
    spread = rows.join(real.select("doc_id", "n", "sketch"), "doc_id").select("*", F.explode("tiles").alias("t")).select("*", "t.*")
    buckets = max(4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // BUCKET_ROWS))
    return stored(compared(spread, rule, buckets, spanning), "pairs", many)


def _around(rows: DataFrame) -> DataFrame:
    """Tiles in which the least document of a hot key meets all others."""
    rows = rows.filter(F.col("g") > TILE)
    chunks = F.ceil(F.col("g") / TILE)
    c = F.when(F.col("doc_id") == F.col("low"), 0).otherwise(1 + F.pmod(F.xxhash64("doc_id", "key"), chunks)).cast("long")
    tiles = F.when(F.col("doc_id") == F.col("low"), F.sequence(F.lit(1), chunks)).otherwise(F.array(c.cast("long")))
    return rows.withColumns({"c": c, "tiles": F.transform(tiles, lambda j: F.struct(F.lit(0).cast("long").alias("x"), j.cast("long").alias("y")))})


def _tiled(rows: DataFrame) -> DataFrame:
    """Tiles in which all documents of different roots of a key meet. Chunks of the largest root, if it fills any, come last and do not meet each other."""
    apart = F.col("n_major") > TILE
    own = apart & (F.col("root") == F.col("major"))
    others = F.ceil(F.when(apart, F.col("g") - F.col("n_major")).otherwise(F.col("g")) / TILE)
    every = F.when(apart, others + F.ceil(F.col("n_major") / TILE)).otherwise(others)
    mark = F.xxhash64("doc_id", "key")
    c = F.when(own, others + F.pmod(mark, every - others)).otherwise(F.pmod(mark, others)).cast("long")
    meets = F.sequence(F.lit(0).cast("long"), (F.when(own, others).otherwise(every) - 1).cast("long"))
    return rows.withColumn("c", c).withColumn("tiles", F.transform(meets, lambda j: F.struct(F.least(F.col("c"), j).alias("x"), F.greatest(F.col("c"), j).alias("y"))))


def _texts_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of all documents of the pairs. Up to ``BROADCAST_IDS`` ids are broadcast, so that no other text moves; more are joined by a shuffle."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    ids = stored(ids, "ids", 2 * pairs.count())
    few = ids.count() <= BROADCAST_IDS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")


def _unsettled(rows: DataFrame, forests: DataFrame, failed: DataFrame) -> DataFrame:
    """Of the keys that hold both documents of a pair that failed, the rows of roots at which a forest's pair ends: a root without one has no pair under its key that sizes and sketches allow."""
    by = rows.select("key", "doc_id")
    ends = by.join(failed.withColumnRenamed("a", "doc_id"), "doc_id").select("key", F.col("b").alias("doc_id")).distinct()
    open_keys = ends.join(by, ["key", "doc_id"]).select("key").distinct()
    touched = rows.select("key", "root", "doc_id").join(forests.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "doc_id", "left_semi")
    return rows.join(touched.join(open_keys, "key", "left_semi").select("key", "root").distinct(), ["key", "root"], "left_semi")


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach): a row for each document."""
    rule = Rule(k, num, den)
    spark = tuned(docs).sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = stored(profiles(texts, rule, common_shingles(texts, k)), "profiles")
    n, total = known.agg(F.count("*"), F.sum(F.length("keys"))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // 8 // BUCKET_KEYS))
    real = known.filter("doc_id is not null and n > 0")
    copies = real.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep <> last").select("digest", "rep")
    copies = stored(copies, "copies", n)
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    links = real.select("digest", "doc_id").join(copies, "digest").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    roots = components(links, n)
    real = real.join(copies, "digest", "left").filter("rep is null or rep = doc_id")
    rows = mixed(stored(members(real.select("doc_id", "keys"), buckets), "members", (total or 0) // 32), roots)
    able, tested = texts.filter("doc_id is not null"), None
    for tiles, spanning in ((_around, False), (_tiled, True), (_tiled, False)):
        part = tiles(rows)
        if part.isEmpty():
            continue
        allowed = _pairs(part, real, rule, spanning)
        if spanning and allowed.isEmpty():
            break
        pairs = allowed if tested is None else stored(allowed.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not spanning and pairs.isEmpty():
            continue
        many = pairs.count()
        found = stored(verified(pairs, _texts_of(able, pairs), rule).distinct(), "links", many)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = components(roots.unionByName(found), n + many)
        if spanning:
            # a pair of the forest that failed in an earlier turn counts too: it joins nothing
            rows = stored(_unsettled(rows, allowed, allowed.join(found.toDF("a", "b"), ["a", "b"], "left_anti")).select("key", "doc_id"), "unsettled")
        if tiles is _around or spanning:
            rows = mixed(rows.select("key", "doc_id"), roots)
    return _rooted(known, roots).select("doc_id", F.col("n").alias("n_shingles"), F.col("root").alias("component_id"))


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(source(spark, sf_dir, "documents", "doc_id", "text"), 4, 85, 100)


ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g from w, lateral (select unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i) u where len(w) > 0),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r(doc_id, other) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on e.a = r.other),
c as (select doc_id, min(other) as component_id from r group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id left join c on c.doc_id = d.doc_id
"""
