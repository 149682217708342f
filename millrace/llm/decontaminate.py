"""Benchmark decontamination by a distributed positional inverted index.

The index is dealt by document: a shard of a few megabytes of text is one row of a stored table, with its documents and, for each term, the
sorted positions of the term's words. A search broadcasts phrases to the shards. There each phrase starts from the shortest of its
terms' lists (the rarest in that shard) and intersects the other lists, in the order of their
lengths, after adjusting them by the terms' offsets. Only phrases whose pivot, the term that fewest phrases hold, is in the shard are looked at. What is left are exact occurrences; proximity search
intersects windows around the rarest term in the same way. The index holds all terms of all documents. Building shuffles nothing, and searching neither.

Phrases are broadcast in blocks of at most ``BLOCK_BYTES`` of benchmark text, whose size is read first; each block is a pass over
the stored index, and the spans of several blocks are united.

Words are runs of ASCII letters (A-Z lower-cased), ASCII digits and characters beyond ASCII, compared by 64-bit hashes. Null and empty texts have no words; an item
without words is not searched for. Items without an item_id count as one item whose name is null, repeated items as one. An empty table of documents gives no rows, an empty benchmark no hits. Texts are indexed whole, however long. Rows of documents are kept one for one, null and repeated doc_ids included; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import ALNUM, LOWER, binaries, hash_of, ragged, raw, source, stored, text_slices, word_hashes, words

#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 16 << 20
#: Bytes of text in a shard of the index.
SHARD_BYTES = 1 << 20


def item_words(text: str | None) -> list[bytes]:
    body = LOWER[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]
    starts, ends, _ = words(body, np.array([0, len(body)]), ALNUM)
    data = body.tobytes()
    return [data[a:b] for a, b in zip(starts, ends, strict=True)]


@dataclass
class Phrases:
    """Distinct phrases as rows of term numbers, padded with -1, and the items of each."""

    terms: np.ndarray  # sorted hashes
    rows: np.ndarray  # phrases x longest
    length: np.ndarray
    item_ends: np.ndarray
    items: np.ndarray  # numbers of items
    names: list[str | None]  # sorted, null last
    pivot_ends: np.ndarray  # by term: where its list of phrases ends
    pivots: np.ndarray  # the phrases of each term that fewest phrases hold

    @classmethod
    def of(cls, items: list[tuple[str | None, str | None]], window: int) -> Phrases:
        """All windows of the items' words; an item of fewer words is one phrase."""
        found: dict[tuple[bytes, ...], set] = {}
        for name, text in items:
            own = item_words(text)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), set()).add(name)
        vocabulary = sorted({w for phrase in found for w in phrase})
        hashes = hash_of(vocabulary)
        order = np.argsort(hashes)
        number = dict(zip([vocabulary[i] for i in order], range(len(order)), strict=True))
        longest = max(map(len, found), default=1)
        rows = np.array([[number[w] for w in p] + [-1] * (longest - len(p)) for p in found], np.int32).reshape(len(found), longest)
        names = sorted({n for own in found.values() for n in own}, key=lambda n: (n is None, n))
        at = {n: i for i, n in enumerate(names)}
        held = np.bincount(rows[rows >= 0], minlength=len(hashes))
        pivot = rows[np.arange(len(rows)), np.where(rows >= 0, held[rows] if len(held) else 0, np.iinfo(np.int64).max).argmin(axis=1)] if len(rows) else np.zeros(0, np.int32)
        return cls(
            hashes[order], rows, np.array([len(p) for p in found], np.int64), np.cumsum([len(v) for v in found.values()], dtype=np.int64),
            np.array([i for v in found.values() for i in sorted(at[n] for n in v)], np.int64), names,
            np.cumsum(np.bincount(pivot, minlength=len(hashes))), np.argsort(pivot, kind="stable"),
        )

    def possible(self, present: np.ndarray) -> np.ndarray:
        """The phrases whose pivots are among the terms of which ``present`` says so."""
        terms = np.flatnonzero(present)
        sizes = np.diff(self.pivot_ends, prepend=0)[terms]
        return np.sort(self.pivots[ragged(self.pivot_ends[terms] - sizes, sizes)])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard: its number, docs, n_words, terms (sorted hashes), ends (of the terms' lists), positions (of words in the shard)."""

    def run(batches):
        shard = TaskContext.get().partitionId() << 33  # the same when a task is run again
        for batch in batches:
            for row, end, body, offsets in text_slices(batch.column(1), SHARD_BYTES):
                starts, ends, first = words(body := LOWER[body], offsets, ALNUM)
                known, number = np.unique(word_hashes(body, starts, ends), return_inverse=True)
                order = np.argsort(number.astype(np.int32), kind="stable")
                lists = np.cumsum(np.bincount(number, minlength=len(known)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0).slice(row, end - row).to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(first)], pa.list_(pa.int64())),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (known, lists.astype("<u4"), order.astype("<u4"))), pa.array([shard]),
                    ],
                    ["docs", "n_words", "terms", "ends", "positions", "shard"],
                )
                shard += 1

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "docs array<long>, n_words array<long>, terms binary, ends binary, positions binary, shard long")


class Shard:
    """The postings of a shard. Lists are kept as one sorted array of term * size + position, so an intersection of many adjusted lists is one search."""

    def __init__(self, n_words: np.ndarray, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray):
        self.first = np.concatenate(([0], np.cumsum(n_words)))
        self.size = int(self.first[-1]) + 1
        self.terms, self.ends = terms, ends.astype(np.int64)
        self.sizes = np.diff(self.ends, prepend=0)
        self.positions = positions.astype(np.int64)
        self.keys = np.repeat(np.arange(len(terms)), self.sizes) * self.size + self.positions

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        """The shard's numbers of terms, given by hash; -1 if it has none of them."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(len(terms), -1)

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        want = term * self.size + position
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return (self.keys[at] == want) & (position >= 0) & (position < self.size - 1) if len(self.keys) else np.zeros(len(want), bool)

    def phrases(self, rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position of its first word) of all exact occurrences within a document; rows hold the shard's term numbers, then -1 up to the longest."""
        within = np.arange(rows.shape[1])[None, :] < length[:, None]
        sizes = np.where(within, np.where(rows >= 0, self.sizes[rows] if len(self.sizes) else 0, 0), np.iinfo(np.int64).max)
        live = np.flatnonzero(sizes.min(axis=1, initial=np.iinfo(np.int64).max) > 0)
        live = live[length[live] > 0]
        if not len(live):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rank = np.argsort(sizes[live], axis=1, kind="stable")
        seed = rank[:, 0]
        term = rows[live, seed]
        phrase = np.repeat(np.arange(len(live)), self.sizes[term])
        start = self.positions[ragged(self.ends[term] - self.sizes[term], self.sizes[term])] - seed[phrase]
        for step in range(1, rows.shape[1]):
            at = rank[phrase, step]
            inside = at < length[live[phrase]]
            ok = np.ones(len(phrase), bool)
            ok[inside] = self.has(rows[live[phrase[inside]], at[inside]].astype(np.int64), start[inside] + at[inside])
            phrase, start = phrase[ok], start[ok]
            if not len(phrase):
                break
        doc = np.searchsorted(self.first, start, side="right") - 1
        ok = (start >= 0) & (start + length[live[phrase]] <= self.first[np.minimum(doc + 1, len(self.first) - 1)])
        return live[phrase[ok]], start[ok]

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest of the terms with each other one at most ``slop`` words away in the same document."""
        if not len(terms) or (terms < 0).any() or not (self.sizes[terms] > 0).all():
            return np.zeros(0, np.int64)
        order = terms[np.argsort(self.sizes[terms], kind="stable")]
        own = lambda t: self.positions[self.ends[t] - self.sizes[t] : self.ends[t]]
        at = own(order[0])
        doc = np.searchsorted(self.first, at, side="right") - 1
        low, high = np.maximum(at - slop, self.first[doc]), np.minimum(at + slop, self.first[doc + 1] - 1)
        ok = np.ones(len(at), bool)
        for t in order[1:]:
            ok &= np.searchsorted(own(t), low) < np.searchsorted(own(t), high, side="right")
        return at[ok]


def _shards(batch):
    for i in range(batch.num_rows):
        cells = [batch.column(k)[i] for k in range(5)]
        n_words = np.array(cells[1].as_py(), np.int64)
        arrays = [np.frombuffer(c.as_buffer(), t) for c, t in zip(cells[2:], ("<u8", "<u4", "<u4"), strict=True)]
        yield cells[0].as_py(), n_words, Shard(n_words, *arrays), batch.column(5)[i].as_py()


def proximity(index: DataFrame, terms: list[str], slop: int) -> DataFrame:
    """doc_id, position: words of the rarest term with all other terms at most ``slop`` words away in the document."""
    hashes = hash_of([w for t in terms for w in item_words(t)])

    def run(batches):
        for batch in batches:
            for docs, _, shard, _ in _shards(batch):
                at = shard.near(shard.numbers(hashes), slop)
                doc = np.searchsorted(shard.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([docs[d] for d in doc], pa.int64()), pa.array(at - shard.first[doc], pa.int64())], ["doc_id", "position"])

    return index.mapInArrow(run, "doc_id long, position long")


def search(index: DataFrame, phrases: Phrases) -> DataFrame:
    """doc_id, shard, shard_row, n_words, n_hit, spans (starts and ends of the runs of hit words, 64-bit), items (names): a row for each document of the index."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches):
        known: Phrases = shared.value
        items_at = np.concatenate(([0], known.item_ends))
        for batch in batches:
            for docs, n_words, shard, shard_no in _shards(batch):
                number = shard.numbers(known.terms)
                some = known.possible(number >= 0)
                rows = np.where(known.rows[some] >= 0, number[known.rows[some]] if len(number) else -1, -1)
                phrase, start = shard.phrases(rows, known.length[some])
                phrase = some[phrase]
                delta = np.zeros(shard.size + 1, np.int64)
                np.add.at(delta, start, 1)
                np.add.at(delta, start + known.length[phrase], -1)
                hit = np.cumsum(delta)[: shard.size - 1] > 0
                before = np.concatenate(([False], hit[:-1]))
                before[shard.first[:-1][n_words > 0]] = False
                after = np.concatenate((hit[1:], [False]))
                after[shard.first[1:][n_words > 0] - 1] = False
                begin, end = np.flatnonzero(hit & ~before[: len(hit)]), np.flatnonzero(hit & ~after[: len(hit)]) + 1
                doc = np.searchsorted(shard.first, start, side="right") - 1
                pairs = {(d, i) for d, p in {*zip(doc.tolist(), phrase.tolist(), strict=True)} for i in known.items[items_at[p] : items_at[p + 1]].tolist()}
                names: list[list] = [[] for _ in docs]
                n_hit = np.diff(np.concatenate(([0], np.cumsum(hit)))[shard.first])
                for d, i in sorted(pairs):
                    names[d].append(known.names[i])
                owner = np.searchsorted(shard.first, begin, side="right") - 1
                upto = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(docs)))))
                spans = np.stack([begin - shard.first[owner], end - shard.first[owner]], 1).reshape(-1).astype("<i8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array([shard_no] * len(docs), pa.int64()), pa.array(np.arange(len(docs))), pa.array(n_words), pa.array(n_hit), binaries(spans, 2 * upto).cast(pa.binary()), pa.array(names, pa.list_(pa.string()))],
                    ["doc_id", "shard", "shard_row", "n_words", "n_hit", "spans", "items"],
                )

    return index.mapInArrow(run, "doc_id long, shard long, shard_row long, n_words long, n_hit long, spans binary, items array<string>")


def union_spans(cells: list[bytes]) -> bytes:
    """The union of sets of spans."""
    every = np.concatenate([np.frombuffer(c, "<i8").reshape(-1, 2) for c in cells])
    out: list[list[int]] = []
    for a, b in every[np.argsort(every[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return np.array(out, "<i8").tobytes()


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans (starts and ends of hit runs of words, little-endian 64-bit), items: a row for each document."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    index = stored(build_index(docs, id_col, text_col), "postings")
    hits = []
    for block in range(blocks):  # a block's phrases are in the driver at a time
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        hits.append(search(index, Phrases.of([(r.item_id, r.text) for r in part.collect()], window)))
    if blocks == 1:
        return hits[0].drop("shard", "shard_row")
    both = stored(hits[0], "hits")
    for more in hits[1:]:
        both = both.unionByName(stored(more, "hits"))

    @F.pandas_udf("n_hit long, spans binary")
    def united(cells):
        spans = [union_spans([*c]) for c in cells]
        return pd.DataFrame({"n_hit": [int(np.diff(np.frombuffer(s, "<i8").reshape(-1, 2), axis=1).sum()) for s in spans], "spans": spans})

    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    rows = both.groupBy("shard", "shard_row").agg(F.first("doc_id", False).alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("spans").alias("cells"), names)
    return rows.withColumn("u", united("cells")).select("doc_id", "n_words", "u.*", "items")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(source(spark, sf_dir, "documents", "doc_id", "text"), source(spark, sf_dir, "benchmark", "item_id", "text"), 10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
with items as (select distinct item_id, {_WORDS} as w from benchmark),
windows as (select item_id, array_to_string(w[i:i + 9], ' ') as g, least(10, len(w)) as n
            from items, lateral (select unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i) u where len(w) > 0),
docs as (select doc_id, {_WORDS} as w from documents),
sizes as (select distinct n from windows),
runs as (select doc_id, i, sizes.n as n, array_to_string(w[i:i + sizes.n - 1], ' ') as g
         from docs, sizes, lateral (select unnest(range(1, len(w) - sizes.n + 2)) as i) u where len(w) >= sizes.n),
hits as (select r.doc_id, r.i, r.n, w.item_id from runs r join windows w on r.g = w.g and r.n = w.n),
hit_words as (select distinct doc_id, unnest(range(i, i + n)) as p from hits),
a as (select doc_id, count(*) as n_hit from hit_words group by 1),
b as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(a.n_hit, 0) as n_hit, coalesce(b.n_items, 0) as n_items, sha256(coalesce(b.names, '')) as items_sha256, coalesce(a.n_hit, 0) > 0 as contaminated
from docs d left join a on a.doc_id = d.doc_id left join b on b.doc_id = d.doc_id
"""
