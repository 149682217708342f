"""Token ids in a static range asymmetric numeral system (rANS).

One table of frequencies, counted over the whole corpus, serves all blocks. A block holds whole documents and is
independent of others: its ids are dealt over interleaved lanes whose states advance together, 32 bits at a time.
A block's bytes: a header, the number of ids of each document, the states of all lanes and the place in the stream at each checkpoint
(the first is its start), and the stream; a checksum of the ids stands in the header. Decoding can begin at each checkpoint.

The container is a Parquet table with a row for each block, written in ascending doc_id order, file by file. So any executor writes and reads it through
Spark's own file systems, and a reader picks blocks by the ids' range.

Files are as many as shuffle partitions, fewer where adaptive execution joins small ones, or more where they would exceed ``FILE_BYTES`` of ids.

Null text is an empty text and has the end id only. A null doc_id is kept and sorts first. Equal doc_ids follow each other in the order of a hash of their ids. Special tokens that stand in a text get their ids.
Texts are encoded whole, however long; a very long one is a block of its own. An empty table gives an empty container. Other columns of the input are dropped.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import binaries, raw, scratch, source, stored, text_slices
from millrace.llm.vocab import word_encoder

VOCABULARY = "word_bpe_49k.json"
#: The sum of all frequencies is 2 ** SCALE; it must exceed the vocabulary.
SCALE = 20
LANES = 256
#: A block ends with the document that brings it to this many ids.
BLOCK_IDS = 1 << 18
#: Bytes of ids in a file, at most but for its last document.
FILE_BYTES = 256 << 20
#: Steps (each of LANES ids) between checkpoints.
CHECKPOINT_STEPS = 256
_LOW = 1 << 31
_HEAD = struct.Struct("<4sIQIII")  # mark, documents, ids, lanes, checkpoints, crc32 of the ids
_MARK = b"RNS1"


@dataclass(frozen=True)
class Frequencies:
    """Scaled frequencies: each symbol that occurs has at least 1, and they sum to 2 ** SCALE."""

    symbols: np.ndarray
    freq: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, counts: np.ndarray) -> Frequencies:
        symbols, counts = np.asarray(symbols, np.int64), np.asarray(counts, np.float64)
        order = np.argsort(symbols)
        symbols, counts = symbols[order], counts[order]
        total = 1 << SCALE
        if not len(symbols):
            return cls(symbols, np.zeros(0, np.int64))
        if len(symbols) > total:
            raise ValueError("more symbols than the scale can hold")
        freq = np.maximum(1, np.floor(counts / counts.sum() * total)).astype(np.int64)
        left = total - int(freq.sum())
        if left > 0:
            freq[np.argmax(counts)] += left
        while left < 0:  # symbols that were raised to 1: the largest pay for them
            spare = np.argsort(-freq)[: max(1, min(-left, len(freq) // 2))]
            spare = spare[freq[spare] > 1][:-left]
            freq[spare] -= 1
            left += len(spare)
        return cls(symbols, freq)

    def by_symbol(self) -> tuple[np.ndarray, np.ndarray]:
        size = int(self.symbols.max(initial=-1)) + 1
        freq, start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        freq[self.symbols] = self.freq
        start[self.symbols] = np.cumsum(self.freq) - self.freq
        return freq, start

    def slots(self) -> np.ndarray:
        return np.repeat(self.symbols, self.freq).astype(np.uint32)


def pack(ids: np.ndarray, counts: np.ndarray, freq: np.ndarray, start: np.ndarray) -> bytes:
    """A block of the ids of documents with so many ids each."""
    n, u = len(ids), np.uint64
    steps = -(-n // LANES)
    state = np.full(LANES, _LOW, u)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []  # words so far and states, at the end of a part
    so_far = 0
    for step in range(steps - 1, -1, -1):
        if (step + 1) % CHECKPOINT_STEPS == 0 and step + 1 < steps:
            marks.append((so_far, state.copy()))
        now = ids[step * LANES : (step + 1) * LANES]
        f, x = freq[now], state[: len(now)]
        full = x >= f << u(63 - SCALE)
        if full.any():
            words.append((x[full] & u(0xFFFFFFFF)).astype("<u4"))
            so_far += len(words[-1])
            x = np.where(full, x >> u(32), x)
        q = x // f
        state[: len(now)] = (q << u(SCALE)) + (x - q * f) + start[now]
    marks.append((so_far, state))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
    head = _HEAD.pack(_MARK, len(counts), n, LANES, len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
    parts = [head, np.asarray(counts, "<u4").tobytes()]
    for before, states in marks[::-1]:
        parts += [struct.pack("<Q", so_far - before), states.astype("<u8").tobytes()]
    return b"".join([*parts, stream.tobytes()])


class Block:
    """A packed block; ``part(i)`` decodes from checkpoint i to the next on its own."""

    def __init__(self, data: bytes, freq: np.ndarray, start: np.ndarray, slots: np.ndarray):
        mark, docs, self.n, self.lanes, self.marks, self.crc = _HEAD.unpack_from(data)
        if mark != _MARK:
            raise ValueError("not a block")
        at = _HEAD.size
        self.counts = np.frombuffer(data, "<u4", docs, at).astype(np.int64)
        at += 4 * docs
        self.points = []
        for _ in range(self.marks):
            self.points.append((struct.unpack_from("<Q", data, at)[0], np.frombuffer(data, "<u8", self.lanes, at + 8)))
            at += 8 + 8 * self.lanes
        self.stream = np.frombuffer(data, "<u4", -1, at) if at < len(data) else np.zeros(0, "<u4")
        self.freq, self.start, self.slots = freq, start, slots

    def part(self, i: int) -> np.ndarray:
        u = np.uint64
        place, states = self.points[i]
        state = states.astype(u)
        n = min(CHECKPOINT_STEPS * self.lanes, self.n - i * CHECKPOINT_STEPS * self.lanes)
        out = np.empty(n, np.uint32)
        low = u((1 << SCALE) - 1)
        for at in range(0, n, self.lanes):
            x = state[: min(self.lanes, n - at)]
            slot = x & low
            symbol = self.slots[slot]
            out[at : at + len(x)] = symbol
            x = self.freq[symbol] * (x >> u(SCALE)) + slot - self.start[symbol]
            empty = np.flatnonzero(x < u(_LOW))
            if len(empty):
                x[empty] = (x[empty] << u(32)) | self.stream[place : place + len(empty)].astype(u)
                place += len(empty)
            state[: len(x)] = x
        return out

    def ids(self) -> np.ndarray:
        got = np.concatenate([self.part(i) for i in range(self.marks)]) if self.n else np.zeros(0, np.uint32)
        if zlib.crc32(got.astype("<u4").tobytes()) != self.crc:
            raise ValueError("a block's ids do not fit its checksum")
        return got


def tokenize(docs: DataFrame, vocabulary: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: little-endian unsigned 16-bit ids of the whole text, then the end id. For vocabularies of up to 65,536 ids."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    def run(batches):
        encoder = word_encoder(vocabulary, "<u2")
        for batch in batches:
            for row, end, body, offsets in text_slices(batch.column(1)):
                ids, at = encoder.encode(body, offsets)
                at = at + np.arange(len(at))
                ended = np.full(at[-1], end_id, "<u2")
                body_of = np.ones(at[-1], bool)
                body_of[at[1:] - 1] = False
                ended[body_of] = ids
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), binaries(ended, at).cast(pa.binary())], ["doc_id", "ids"])

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, ids binary")


def count_ids(tokens: DataFrame) -> Frequencies:
    """Frequencies over all rows; each task sends one row an id, and no more rows than the vocabulary reach the driver."""

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            body, _ = raw(batch.column(0))
            total += np.bincount(body.view("<u2"), minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return Frequencies.of(counts["id"].to_numpy(), counts["n"].to_numpy())


def write(tokens: DataFrame, path: str, table: Frequencies) -> None:
    """Writes the container: blocks and, beside them, the table of frequencies."""
    spark = tokens.sparkSession

    def run(batches):
        freq, start = table.by_symbol()
        file_no = TaskContext.get().partitionId()
        docs: list = []
        parts: list[np.ndarray] = []
        state = [0, 0, 0]  # block, ids written before in this file, ids waiting

        def block():
            ids = np.concatenate(parts)
            row = [file_no, state[0], state[1], len(ids), docs.copy(), pack(ids, [len(p) for p in parts], freq, start)]
            state[:] = state[0] + 1, state[1] + len(ids), 0
            docs.clear()
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            body, offsets = raw(batch.column(1))
            every = body.view("<u2").astype(np.int64)
            for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1] // 2, offsets[1:] // 2, strict=True):
                docs.append(doc)
                parts.append(every[a:b])
                state[2] += b - a
                if state[2] >= BLOCK_IDS:
                    yield block()
        if parts:
            yield block()

    names = ["file_no", "block_no", "first", "n_ids", "docs", "block"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    size = tokens.agg(F.sum(F.length("ids"))).first()[0] or 0
    files = -(-size // FILE_BYTES)
    # without a number, adaptive execution joins small ranges that are neighbours, which leaves their order
    many = [files] if files > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    # rows of one doc_id, or of none, are dealt by a hash of their ids, so that they can be many
    mark = tokens.select("doc_id", "ids", F.xxhash64("ids").alias("mark"))
    in_order = mark.repartitionByRange(*many, "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "ids")
    in_order.mapInArrow(run, "file_no long, block_no long, first long, n_ids long, docs array<long>, block binary").write.parquet(f"{path}/blocks")
    rows = list(zip(table.symbols.tolist(), table.freq.tolist(), strict=True))
    spark.createDataFrame(rows, "id long, freq long").coalesce(1).write.parquet(f"{path}/table")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of each document in the container; damage is an error."""
    known = spark.read.parquet(f"{path}/table").toPandas()
    table = Frequencies(known["id"].to_numpy(), known["freq"].to_numpy())
    order = np.argsort(table.symbols)
    table = Frequencies(table.symbols[order], table.freq[order])
    blocks = spark.read.parquet(f"{path}/blocks")

    def run(batches):
        freq, start = table.by_symbol()
        slots = table.slots()
        for batch in batches:
            for file_no, first, docs, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                block = Block(data, freq, start, slots)
                ids = block.ids().astype("<u4")
                ends = np.cumsum(block.counts)
                cells = [ids[e - n : e].tobytes() for e, n in zip(ends, block.counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_no] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(first + ends - block.counts), pa.array(block.counts), pa.array(cells, pa.binary())],
                    ["file_no", "doc_id", "at", "n_tokens", "ids"],
                )

    found = blocks.select("file_no", "first", "docs", "block").mapInArrow(run, "file_no long, doc_id long, at long, n_tokens long, ids binary")
    # a row for each file: the sum of the files before it. The writer makes no more files than shuffle partitions, or than FILE_BYTES asks for, so broadcasting them is bounded
    sums = blocks.groupBy("file_no").agg(F.sum("n_ids").alias("n"))
    base = sums.select("file_no", (F.sum("n").over(Window.orderBy("file_no")) - F.col("n")).alias("base"))
    return found.join(F.broadcast(base), "file_no").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def op2_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = stored(tokenize(source(spark, sf_dir, "documents", "doc_id", "text")), "ids")
    path = scratch(spark, "rans")
    write(tokens, path, count_ids(tokens))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
