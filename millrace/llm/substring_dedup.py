"""Substring dedup by relative Lempel-Ziv parsing against blocks of all earlier documents.

Documents are cut by content: in each run of ``window`` words the least hash of the runs of ``window // 2`` words in it is an anchor, so documents that share a window
share its anchor. The reference blocks are what stands around the anchors that several documents hold: as far to both sides as a window with that anchor can reach. They are indexed by
their contents, each with the least document and the place where it begins.

A document is parsed against all of them at once. Where a whole block stands in an earlier document, it is a piece of a factor. At other blocks a match begins, ends, or changes its source; there is the
boundary of a factor, and it is checked window by window against the windows of all blocks that are first of their kind. That misses none: the least document with a window has no earlier
one with the same block around it. Pieces with one source whose places in both documents run along are joined into factors, as long as they get: (first word, length, source, its first word).

Documents that are equal word for word (most copies) are represented by the least of them, and the others are one whole factor. Blocks and windows are counted from one row a task
and joined by sort-merge joins, whose hot keys Spark splits, so a passage that a third of all documents share costs a row for each of its blocks. Blocks and windows are known by 128 bits of hashes of their words' hashes.

Words are runs of bytes other than ASCII white space, unchanged. Null and empty texts have none, an empty table has no rows; texts are read whole, however long. A null doc_id is no reference and keeps all its words. Rows of one doc_id are one document as a reference and
as "smaller", and each is parsed on its own. Other columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import NON_SPACE, binaries, inverse, longs, mix, powers, ragged, raw, run_hashes, source, stored, text_slices, word_hashes, words

WINDOW = 50
#: Rows (an id and a tag, 12 bytes) that may be broadcast.
BROADCAST_ROWS = 1 << 18
_BASE, _OTHER = 0x9E6C63D0876A9A47, 0x2545F4914F6CDD1D


def _runs(body: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words' starts, ends and first numbers by document, hashes of words, hashes of runs of n words (also across documents)."""
    starts, ends, first = words(body, offsets, NON_SPACE)
    h = word_hashes(body, starts, ends)
    return starts, ends, first, h, run_hashes(h, n)


def _anchors(g: np.ndarray, grams: int) -> np.ndarray:
    """Sorted places of the least hash (the last of equal ones) of each ``grams`` consecutive hashes."""
    if len(g) < grams:
        return np.zeros(0, np.int64)
    least = g.copy()
    at = np.arange(len(g))
    width = 1
    while width < grams:  # the least of runs of twice the width, from two that overlap
        step = min(width, grams - width)
        n = len(least) - step
        take = least[step:] <= least[:n]
        least, at = np.where(take, least[step:], least[:n]), np.where(take, at[step:], at[:n])
        width += step
    return np.unique(at)


def outlines(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tag (of the text), n_words, digest (of all words), anchors (64-bit hashes): a row for each document."""
    half = window // 2

    def run(batches):
        for batch in batches:
            for row, end, body, offsets in text_slices(batch.column(1)):
                _, _, first, h, g = _runs(body, offsets, half)
                digests, anchors = [], []
                for i in range(end - row):
                    a, b = first[i], first[i + 1]
                    digests.append(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest())
                    own = g[a : max(a, b - half + 1)]
                    anchors.append(np.unique(own[_anchors(own, window - half + 1)]).astype("<u8").tobytes() if b - a >= window else b"")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, end - row), batch.column(2).slice(row, end - row), pa.array(np.diff(first)), pa.array(digests, pa.binary()), pa.array(anchors, pa.binary())],
                    ["doc_id", "tag", "n_words", "digest", "anchors"],
                )

    return docs.select("doc_id", "text", "tag").mapInArrow(run, "doc_id long, tag int, n_words long, digest binary, anchors binary")


def _exploded(batches):
    """doc_id, tag, anchor: from doc_id, tag, anchors."""
    for batch in batches:
        body, at = raw(batch.column(2))
        size = np.diff(at) // 8
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(longs(batch.column(0)), size)), pa.array(np.repeat(batch.column(1).to_numpy(), size)), pa.array(body.view("<i8"))], ["doc_id", "tag", "anchor"])


class Spans:
    """128-bit hashes, as two halves, of runs of words anywhere in a slice."""

    def __init__(self, h: np.ndarray):
        self.total = []
        for half in (h, mix(h ^ np.uint64(_OTHER))):
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(half * powers(_BASE, len(h))[:-1], out=total[1:])
            self.total.append(total)
        self.back = powers(inverse(_BASE), len(h))

    def of(self, a: np.ndarray, b: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
        """Of the words from a to b; ``more`` are numbers that must be the same too."""
        out = []
        for total in self.total:
            g = mix((total[b] - total[a]) * self.back[a] + (b - a).astype(np.uint64))
            for x in more:
                g = mix(g ^ (x.astype(np.uint64) + np.uint64(1)) * np.uint64(_OTHER))
            out.append(g)
        return out


def _blocks(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tag, at (first word), size, x, y (hash of the block and of the place of its anchor), first (word of the first of its windows that have the anchor), windows (their hashes, 16 bytes each): a row for each block around a shared anchor.

    Takes doc_id, text, anchors (shared ones, 64-bit), tag.
    """
    half = window // 2
    reach = window - half

    def run(batches):
        for batch in batches:
            shared, shared_at = raw(batch.column(2))
            shared = shared.view("<u8")
            ids, tags = longs(batch.column(0)), batch.column(3).to_numpy()
            for row, end, body, offsets in text_slices(batch.column(1)):
                _, _, first, h, g = _runs(body, offsets, half)
                spans, parts = Spans(h), []
                for i in range(end - row):
                    a, b = int(first[i]), int(first[i + 1])
                    if b - a < window:
                        continue
                    own = g[a : b - half + 1]
                    places = np.flatnonzero(np.isin(own, shared[shared_at[row + i] // 8 : shared_at[row + i + 1] // 8]))
                    low, high = np.maximum(places - reach, 0), np.minimum(places + half + reach, b - a)
                    # each window with a shared anchor belongs to the block of the last such anchor it holds
                    upto = np.minimum(np.append(places[1:], b - a) - reach - 1, high - window)
                    count = np.maximum(upto - low + 1, 0)
                    x, y = spans.of(a + low, a + high, places - low)
                    at = a + ragged(low, count)
                    windows = np.stack(spans.of(at, at + window), 1).reshape(-1).astype("<u8")
                    parts.append((np.full(len(places), ids[row + i]), np.full(len(places), tags[row + i]), low, high - low, x.view("<i8"), y.view("<i8"), windows, count))
                if parts:
                    *columns, windows, count = (np.concatenate(c) for c in zip(*parts, strict=True))
                    doc, tag, low, size, x, y = columns
                    cells = binaries(windows, 2 * np.concatenate(([0], np.cumsum(count)))).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(tag), pa.array(low.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(x), pa.array(y), cells], ["doc_id", "tag", "at", "size", "x", "y", "windows"])

    return docs.mapInArrow(run, "doc_id long, tag int, at int, size int, x long, y long, windows binary")


def _windows(batches):
    """doc_id, tag, at, x, y: a row for each window. Takes doc_id, tag, at, windows."""
    for batch in batches:
        body, ends = raw(batch.column(3))
        count = np.diff(ends) // 16
        halves = body.view("<i8").reshape(-1, 2)
        at = ragged(batch.column(2).to_numpy().astype(np.int64), count).astype(np.int32)
        doc, tag = np.repeat(longs(batch.column(0)), count), np.repeat(batch.column(1).to_numpy(), count)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc, tag, at, np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1]))], ["doc_id", "tag", "at", "x", "y"])


def factors(n: int, pieces: np.ndarray) -> np.ndarray:
    """Factors of a document of n words: rows of first word, length, source, its first word. Takes pieces in the same form; those of one source that run along in both documents, and meet or overlap, are one factor."""
    if not len(pieces):
        return pieces.reshape(0, 4)
    start, size, source_, origin = pieces.T
    shift = start - origin
    order = np.lexsort((start, shift, source_))
    start, size, source_, shift = start[order], size[order], source_[order], shift[order]
    group = np.concatenate(([True], (source_[1:] != source_[:-1]) | (shift[1:] != shift[:-1])))
    reach = np.maximum.accumulate(start + size + np.cumsum(group) * (2 * n + 2)) - np.cumsum(group) * (2 * n + 2)
    new = group.copy()
    new[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(start + size, at)
    out = np.stack((start[at], end - start[at], source_[at], start[at] - shift[at]), 1)
    return out[np.lexsort((-out[:, 1], out[:, 0]))]


def _having(texts: DataFrame, marks: DataFrame, row: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The texts of the rows of ``marks``, and the others. Up to ``BROADCAST_ROWS`` rows are broadcast, so that no other text moves; of more, all texts are taken for theirs and there are no others."""
    if marks.count() > BROADCAST_ROWS:
        return texts, None
    keys = F.broadcast(marks.select(*row))
    return texts.join(keys, row, "left_semi"), texts.join(keys, row, "left_anti")


def find(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, copy_of (the least document that is equal word for word, if that is an earlier one), pieces (at, size, source, origin: of factors): a row for each document."""
    text = F.col(text_col).cast("string")
    # the tag tells rows of one doc_id apart
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.pmod(F.xxhash64(text), F.lit(1 << 31)).cast("int").alias("tag"))
    outline = stored(outlines(texts, window), "outlines")
    able = outline.filter(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    row = ["doc_id", "tag"]
    least = stored(able.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least <> most"), "copies")
    copies = able.select(*row, "digest").join(least, "digest").filter("doc_id <> least").groupBy(*row).agg(F.min("least").alias("copy_of"))
    copies = stored(copies, "copies")
    held = able.join(copies.select(*row), row, "left_anti").select(*row, "anchors").mapInArrow(_exploded, "doc_id long, tag int, anchor long")
    held = stored(held, "anchors")
    common = held.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b").select("anchor")
    joined = held.join(stored(common, "common"), "anchor").groupBy(*row).agg(F.collect_list("anchor").alias("anchors"))
    packed = joined.mapInArrow(_packed, "doc_id long, tag int, anchors binary")
    packed = stored(packed, "shared")
    blocks = stored(_blocks(_having(texts, packed, row)[0].join(packed, row).select("doc_id", "text", "anchors", "tag"), window), "blocks")
    origin = F.min(F.struct(F.col("doc_id").alias("source"), F.col("at").alias("origin"))).alias("o")
    firsts = blocks.groupBy("x", "y").agg(origin, F.max("doc_id").alias("last")).filter("o.source <> last").select("x", "y", "o.*")
    judged = stored(blocks.join(stored(firsts, "firsts"), ["x", "y"], "left"), "judged")
    whole = judged.filter("doc_id > source").select(*row, "at", "size", "source", "origin")
    spots = judged.filter("source is null or doc_id = source").select(*row, "at", "windows").mapInArrow(_windows, "doc_id long, tag int, at int, x long, y long")
    spots = stored(spots, "windows")
    known = spots.groupBy("x", "y").agg(origin, F.max("doc_id").alias("last")).filter("o.source <> last").select("x", "y", "o.*")
    edges = spots.join(stored(known, "known"), ["x", "y"]).filter("doc_id > source").select(*row, "at", F.lit(window).alias("size"), "source", "origin")
    pieces = whole.unionByName(edges).groupBy(*row).agg(F.collect_list(F.struct("at", "size", "source", "origin")).alias("pieces"))
    kind = pieces.schema["pieces"].dataType.simpleString()
    marks = pieces.select(*row, "pieces", F.lit(None).cast("long").alias("copy_of")).unionByName(copies.select(*row, F.lit(None).cast(kind).alias("pieces"), "copy_of"))
    marks = stored(marks, "marks")
    own, others = _having(texts, marks, row)
    own = own.join(marks, row, "left").select("doc_id", "text", "copy_of", "pieces")
    if others is None:
        return own
    return own.unionByName(others.select("doc_id", "text", F.lit(None).cast("long").alias("copy_of"), F.lit(None).cast(kind).alias("pieces")))


def _packed(batches):
    for batch in batches:
        lists = batch.column(2)
        at = lists.offsets.to_numpy().astype(np.int64)
        values = longs(lists.values)[at[0] : at[-1]] if len(lists) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binaries(values.astype("<i8"), at - at[0]).cast(pa.binary())], ["doc_id", "tag", "anchors"])


def remove(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, factors (first word, length, source, its first word, 64-bit each), kept (the words outside of factors, joined by a space). Takes what :func:`find` gives."""

    def run(batches):
        for batch in batches:
            copy_of, lists = batch.column(2).to_pylist(), batch.column(3)
            ends_of = lists.offsets.to_numpy().astype(np.int64)
            cells = lists.values
            every = np.stack([cells.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)], 1) if len(cells) else np.zeros((0, 4), np.int64)
            for row, end, body, offsets in text_slices(batch.column(1)):
                starts, ends, first = words(body, offsets, NON_SPACE)
                data = body.tobytes()
                rows = []
                for i in range(end - row):
                    a, n = int(first[i]), int(first[i + 1] - first[i])
                    if copy_of[row + i] is not None:
                        made = np.array([[0, n, copy_of[row + i], 0]], np.int64)
                    else:
                        made = factors(n, every[ends_of[row + i] : ends_of[row + i + 1]])
                    step = np.zeros(n + 1, np.int64)
                    np.add.at(step, made[:, 0], 1)
                    np.add.at(step, made[:, 0] + made[:, 1], -1)
                    at = a + np.flatnonzero(np.cumsum(step)[:n] == 0)
                    kept = b" ".join([data[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
                    rows.append((n, n - len(at), made.astype("<i8").tobytes(), kept))
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *arrays[:3], arrays[3].cast(pa.string())], ["doc_id", "n_words", "n_removed", "factors", "kept"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_removed long, factors binary, kept string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove(find(source(spark, sf_dir, "documents", "doc_id", "text")))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as g from w, lateral (select unnest(range(1, len(w) - 48)) as i) u where len(w) >= 50),
f as (select g, min(doc_id) as a from g group by 1),
hit as (select distinct g.doc_id, unnest(range(g.i, g.i + 50)) as p from g join f on f.g = g.g where g.doc_id > f.a),
p as (select doc_id, p, w[p] as x from w, lateral (select unnest(range(1, len(w) + 1)) as p) u),
k as (select p.doc_id, count(hit.p) as n_removed, string_agg(p.x, ' ' order by p.p) filter (hit.p is null) as kept from p left join hit on hit.doc_id = p.doc_id and hit.p = p.p group by 1)
select w.doc_id, cast(len(w.w) as bigint) as n_words, coalesce(k.n_removed, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from w left join k on k.doc_id = w.doc_id
"""
