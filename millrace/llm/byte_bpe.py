"""Byte-level BPE encoding and decoding over Arrow batches.

Encoding maps bytes to the characters of the vocabulary and runs the tokenizers library; decoding looks each id up in the
reversed byte table, so bytes come back exactly, also where a token ends inside a character.
Both are one pass over the rows without a shuffle; a task holds a slice of a few megabytes.

Null text is an empty text: no ids, empty bytes. Rows are kept one for one, repeated rows and null ids of documents included;
other columns of the input are dropped, so their names cannot clash.
"""

from __future__ import annotations

import codecs

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import binaries, raw, ragged, source, text_slices, tuned
from millrace.llm.vocab import rank_encoder, token_bytes

RANKS = "byte_bpe_multi_50k.tiktoken"


def default_ranks() -> tuple[str, str]:
    """The path of the ranks and the pattern that splits text before merging."""
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _encoder(path: str, split: str):
    def run(batches):
        encoder = rank_encoder(path, split)
        for batch in batches:
            for row, end, body, offsets in text_slices(batch.column(1)):
                ids, at = encoder.encode(body, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(np.diff(at)), binaries(ids, at).cast(pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def _decoder(path: str):
    def run(batches):
        table, at = token_bytes(path)
        size = np.diff(at)
        for batch in batches:
            for row, end, body, offsets in text_slices(batch.column(2)):
                ids = body.view("<u4").astype(np.int64)
                got = table[ragged(at[ids], size[ids])]
                total = np.concatenate(([0], np.cumsum(size[ids])))
                kept = [batch.column(i).slice(row, end - row) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*kept, binaries(got, total[offsets // 4]).cast(pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return run


_TOKENS = "doc_id long, n_tokens long, ids binary"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return tuned(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids: little-endian unsigned 32-bit ids of the whole text."""
    path, split = default_ranks() if ranks is None else (ranks, pattern)
    return _texts(docs, id_col, text_col).mapInArrow(_encoder(path, split), _TOKENS)


def decode(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """The columns of :func:`encode` and decoded: the bytes of all ids. A null list of ids is an empty one; an id beyond the vocabulary is an error."""
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(_decoder(ranks or default_ranks()[0]), f"{_TOKENS}, decoded binary")


def round_trip(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`decode` of :func:`encode` in one Python worker a task."""
    path, split = default_ranks() if ranks is None else (ranks, pattern)
    there, back = _encoder(path, split), _decoder(path)
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: back(there(batches)), f"{_TOKENS}, decoded binary")


def offsets(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, position, id, byte_start, byte_end, char_start, char_end of each token; a split character belongs to each token that has a byte of it."""
    path = ranks or default_ranks()[0]

    def run(batches):
        table, at = token_bytes(path)
        size = np.diff(at)
        for batch in batches:
            body, where = raw(batch.column(1))
            for i, doc in enumerate(batch.column(0).to_pylist()):
                ids = body[where[i] : where[i + 1]].view("<u4").astype(np.int64)
                ends = np.cumsum(size[ids])
                begins = (table[ragged(at[ids], size[ids])] & 0xC0) != 0x80
                upto = np.concatenate(([0], np.cumsum(begins)))
                starts = ends - size[ids]
                first = upto[np.minimum(starts + 1, len(begins))] - 1
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc] * n, pa.int64()), *(pa.array(x, pa.int64()) for x in (np.arange(n), ids, starts, ends, np.maximum(first, 0), upto[ends]))],
                    ["doc_id", "position", "id", "byte_start", "byte_end", "char_start", "char_end"],
                )

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, position long, id long, byte_start long, byte_end long, char_start long, char_end long")


class TextDecoder:
    """Text of ids that arrive in parts: bytes of a character that is not complete wait for the next part; at the end they become U+FFFD."""

    def __init__(self, ranks: str | None = None):
        self.table, self.at = token_bytes(ranks or default_ranks()[0])
        self.part = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids, final: bool = False) -> str:
        data = b"".join(self.table[self.at[i] : self.at[i + 1]].tobytes() for i in ids)
        return self.part.decode(data, final)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(source(spark, sf_dir, "documents", "doc_id", "text"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
