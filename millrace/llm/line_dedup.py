"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of too few code points do not count.
``holders`` has a row for each key and document that holds it, ``counts`` the number of documents and the largest one for each key.
The filters hold exactly the keys that enough documents share, dealt over shards by the key. Inserting documents adds holders, deleting them
removes holders; a key that crosses the limit on the way enters or leaves its shard's filter, so a deletion undoes an insertion.
To apply, lines meet their shard's filter first, and only lines that it knows are joined with the exact counts, which have the last word.

Keys that a large part of all rows share would make one shard hot. Such keys are few by their very count (fewer than ``HEAVY``), and are
joined by broadcast instead.

Null or empty text is one empty line. A null doc_id takes no part in counts, and all its lines stay. Rows of one doc_id are one document in the counts, and each is
cleaned on its own. Only the named columns are read; others come through :func:`clean` untouched.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.shared import raw, source, stored

#: A key is heavy if it has more than a part in HEAVY of all rows of holders; there are fewer than HEAVY such keys.
HEAVY = 1000
#: Keys of a shard's filter, about.
SHARD_KEYS = 50_000
_SPACE = b" \t\n\x0b\x0c\r"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each key in one of two buckets; what finds no place waits in a stash, so nothing is lost."""

    SLOTS, KICKS = 4, 200

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: list[tuple[int, int]] | None = None):
        self.buckets = buckets
        self.table = np.zeros((buckets, self.SLOTS), np.uint16) if table is None else table
        self.stash = stash or []

    @classmethod
    def of(cls, keys: list[bytes]) -> CuckooFilter:
        made = cls(1 << max(4, (int(len(keys) / 0.8) // cls.SLOTS).bit_length()))
        for key in keys:
            made.insert(key)
        return made

    @staticmethod
    def _spread(prints: np.ndarray) -> np.ndarray:
        return (prints.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995)) >> np.uint64(20)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys, given as rows of two unsigned 64-bit words."""
        mask = np.uint64(self.buckets - 1)
        prints = (keys[:, 1] >> np.uint64(48)).astype(np.uint16)
        prints[prints == 0] = 1
        one = keys[:, 0] & mask
        return prints, one.astype(np.int64), ((one ^ self._spread(prints)) & mask).astype(np.int64)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        p, a, b = self.places(np.frombuffer(key, "<u8").reshape(1, 2))
        return int(p[0]), int(a[0]), int(b[0])

    def insert(self, key: bytes) -> None:
        mark, one, two = self._place(key)
        for at in (one, two):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        at = one
        for kick in range(self.KICKS):
            slot = (mark + kick) % self.SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at = int((np.uint64(at) ^ self._spread(np.array([mark]))[0]) & np.uint64(self.buckets - 1))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return
        self.stash.append((mark, at))

    def delete(self, key: bytes) -> None:
        """Removes one copy of the key's fingerprint; the key must have been inserted."""
        mark, one, two = self._place(key)
        for at in (one, two):
            if len(found := np.flatnonzero(self.table[at] == mark)):
                self.table[at, found[0]] = 0
                return
            if (mark, at) in self.stash:
                self.stash.remove((mark, at))
                return
        raise KeyError("not in the filter")

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, one, two = self.places(keys)
        found = (self.table[one] == prints[:, None]).any(1) | (self.table[two] == prints[:, None]).any(1)
        for mark, at in self.stash:
            found |= (prints == mark) & ((one == at) | (two == at))
        return found

    def dump(self) -> bytes:
        return struct.pack("<II", self.buckets, len(self.stash)) + b"".join(struct.pack("<II", *x) for x in self.stash) + self.table.astype("<u2").tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        buckets, n = struct.unpack_from("<II", data)
        stash = [struct.unpack_from("<II", data, 8 + 8 * i) for i in range(n)]
        return cls(buckets, np.frombuffer(data, "<u2", -1, 8 + 8 * n).reshape(buckets, cls.SLOTS).copy(), stash)


def line_keys(text: bytes, least: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines, and for each the digest of its key, or None for a key of fewer code points."""
    lines = text.split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = line.strip(_SPACE).lower()
        if len(key) < least or (len(key) < 4 * least and sum((b & 0xC0) != 0x80 for b in key) < least):
            keys.append(None)
        else:
            keys.append(hashlib.blake2b(key, digest_size=16).digest())
    return lines, keys


def holders(docs: DataFrame, least: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (16 bytes), doc_id: a row for each key that a row of documents holds."""

    def run(batches):
        for batch in batches:
            body, at = raw(batch.column(1))
            data = body.tobytes()
            keys: list[bytes] = []
            ids: list[int] = []
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                own = {k for k in line_keys(data[a:b], least)[1] if k}
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["key", "doc_id"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.filter("doc_id is not null and text is not null").mapInArrow(run, "key binary, doc_id long")


def counts(held: DataFrame) -> DataFrame:
    """key, n_docs, last_doc: first by key and document, which deals a hot key over all tasks, then by key from one row a task."""
    return held.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def filters(keys: DataFrame, shards: int) -> DataFrame:
    """shard, filter: of a table of distinct keys."""

    def build(group: pa.Table) -> pa.Table:
        return pa.table({"shard": group["shard"][:1], "filter": pa.array([CuckooFilter.of(sorted(group["key"].to_pylist())).dump()], pa.binary())})

    return keys.select(_shard(shards).alias("shard"), "key").groupBy("shard").applyInArrow(build, "shard int, filter binary")


def probe(held: DataFrame, made: DataFrame, shards: int) -> DataFrame:
    """Rows of ``held`` whose key its shard's filter knows. A task reads a filter and then the shard's rows, batch by batch."""
    rows = held.select(_shard(shards).alias("shard"), F.lit(1).alias("kind"), "key", "doc_id")
    first = made.select("shard", F.lit(0).alias("kind"), F.col("filter").alias("key"), F.lit(None).cast("long").alias("doc_id"))

    def run(batches):
        shard, known = None, None
        for batch in batches:
            where = batch.column(0).to_numpy()
            kinds = batch.column(1).to_numpy()
            keep = np.zeros(len(where), bool)
            cuts = [0, *(np.flatnonzero(np.diff(where) | np.diff(kinds)) + 1), len(where)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if kinds[a] == 0:
                    shard, known = where[a], CuckooFilter.load(batch.column(2)[int(a)].as_py())
                elif shard == where[a]:
                    body, _ = raw(batch.column(2).slice(a, b - a))
                    keep[a:b] = known.contains(body.view("<u8").reshape(-1, 2))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[2:]], ["key", "doc_id"])

    return rows.unionByName(first).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(run, "key binary, doc_id long")


class LineIndex:
    """Holders, counts and filters, as tables in the shared folder. :meth:`insert` and :meth:`delete` give a new index."""

    def __init__(self, held: DataFrame, tallies: DataFrame, made: DataFrame, shards: int, min_docs: int, least: int):
        self.held, self.tallies, self.made, self.shards, self.min_docs, self.least = held, tallies, made, shards, min_docs, least

    @classmethod
    def build(cls, docs: DataFrame, min_docs: int = 3, least: int = 20, shards: int | None = None) -> LineIndex:
        return cls.from_holders(stored(holders(docs, least), "holders"), min_docs, least, shards)

    @classmethod
    def from_holders(cls, held: DataFrame, min_docs: int, least: int, shards: int | None = None) -> LineIndex:
        tallies = stored(counts(held), "counts")
        shared_keys = tallies.filter(F.col("n_docs") >= min_docs)
        shards = shards or max(8, -(-shared_keys.count() // SHARD_KEYS))
        return cls(held, tallies, stored(filters(shared_keys, shards), "filters"), shards, min_docs, least)

    def _moved(self, held: DataFrame) -> LineIndex:
        """An index of new holders, whose filters take in and let go the keys that crossed the limit."""
        tallies = stored(counts(held), "counts")
        old = self.tallies.filter(F.col("n_docs") >= self.min_docs).select("key")
        now = tallies.filter(F.col("n_docs") >= self.min_docs).select("key")
        steps = now.join(old, "key", "left_anti").withColumn("step", F.lit(1)).unionByName(old.join(now, "key", "left_anti").withColumn("step", F.lit(-1)))
        steps = steps.withColumn("shard", _shard(self.shards))

        def move(_, left: pa.Table, right: pa.Table) -> pa.Table:
            known = CuckooFilter.load(left["filter"][0].as_py()) if len(left) else CuckooFilter(1 << max(4, (len(right) // 3).bit_length()))
            for key, step in zip(right["key"].to_pylist(), right["step"].to_pylist(), strict=True):
                known.insert(key) if step > 0 else known.delete(key)
            return pa.table({"shard": (left if len(left) else right)["shard"][:1].cast(pa.int32()), "filter": pa.array([known.dump()], pa.binary())})

        made = self.made.groupBy("shard").cogroup(steps.groupBy("shard")).applyInArrow(move, "shard int, filter binary")
        return LineIndex(held, tallies, stored(made, "filters"), self.shards, self.min_docs, self.least)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._moved(stored(self.held.unionByName(holders(docs, self.least)).distinct(), "holders"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """doc_ids: a table with the column doc_id."""
        return self._moved(stored(self.held.join(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_anti").select("key", "doc_id"), "holders"))

    def dropped(self, held: DataFrame | None = None) -> DataFrame:
        """key, doc_id: keys whose lines go from that document; of documents in the index, or of the given holders."""
        held = self.held if held is None else held
        shared_keys = self.tallies.filter(F.col("n_docs") >= self.min_docs)
        limit = held.count() // HEAVY
        heavy = F.broadcast(shared_keys.filter(F.col("n_docs") > limit)) if limit >= self.min_docs else None
        rest = held if heavy is None else held.join(heavy.select("key"), "key", "left_anti")
        light = probe(rest, self.made, self.shards).join(shared_keys, "key")
        every = light if heavy is None else light.unionByName(held.join(heavy, "key").select(*light.columns))
        return every.filter(F.col("doc_id") != F.col("last_doc")).select("key", "doc_id")


def clean(docs: DataFrame, dropped: DataFrame, least: int = 20, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str, str] = ("kept", "n_lines", "n_dropped")) -> DataFrame:
    """The documents, with kept (the text without dropped lines), n_lines (before) and n_dropped, under ``names``. A column of docs with one of these names gives way; all others stay as they are."""
    goes = dropped.groupBy("doc_id").agg(F.array_join(F.collect_set(F.hex("key")), "").alias("goes")).select("doc_id", F.unhex("goes").alias("goes"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names]).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            body, at = raw(batch.column(1))
            gone, gone_at = raw(batch.column(2))
            data, out = body.tobytes(), []
            for a, b, c, d in zip(at[:-1], at[1:], gone_at[:-1], gone_at[1:], strict=True):
                if c == d:
                    out.append((data[a:b], data.count(b"\n", a, b) + 1, 0))
                    continue
                out_keys = {gone[i : i + 16].tobytes() for i in range(c, d, 16)}
                lines, keys = line_keys(data[a:b], least)
                kept = [line for line, key in zip(lines, keys, strict=True) if key not in out_keys]
                out.append((b"\n".join(kept), len(lines), len(lines) - len(kept)))
            texts = pa.array([x[0] for x in out], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["row", "kept", "n_lines", "n_dropped"])

    joined = rows.join(goes, "doc_id", "left").select("row", "text", "goes")
    schema = StructType([joined.schema["row"]]).add("kept", "string").add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(run, schema).select("row.*", *[F.col(c).alias(n) for c, n in zip(("kept", "n_lines", "n_dropped"), names, strict=True)])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents", "doc_id", "text")
    index = LineIndex.build(docs, min_docs=3, least=20)
    return clean(docs, index.dropped()).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (select doc_id, u.i as i, coalesce(text, '').split(chr(10))[u.i] as line
               from documents, lateral (select unnest(range(1, len(coalesce(text, '').split(chr(10))) + 1)) as i) u),
keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
shared_keys as (select key, max(doc_id) as last_doc from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (select k.*, s.key is not null and k.doc_id <> s.last_doc as gone from keyed k left join shared_keys s on k.key = s.key)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by doc_id
"""
