"""Where intermediate tables go, and how Arrow text columns become numpy arrays.

Every operator of this package reads text through :func:`text_slices`: whole texts, in slices of a few
megabytes, without making a Python object for each word. A null text is an empty text.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are handled at once; a longer single document is a slice of its own.
SLICE_BYTES = 1 << 19

#: Bytes of an Arrow batch, about.
BATCH_BYTES = 2 << 20

#: Short rows that a task writes, at least, where a bound of their number is known.
TASK_ROWS = 1 << 15

_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_M64 = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are not in [\x20\x09-\x0D].
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, 9, 10, 11, 12, 13]] = False

#: Bytes in [^\x00-\x2F\x3A-\x60\x7B-\x7F]: digits, a-z and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


# ---------------------------------------------------------------- shared storage
def tuned(df: DataFrame) -> DataFrame:
    """The same DataFrame, after a bound on its session's Arrow batches by bytes: rows can hold very long texts, and tasks of an executor share its memory."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, one of our own if Spark runs in this machine alone, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        found = context.getCheckpointDir()
        if not found:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = tempfile.mkdtemp(prefix="millrace-")
            context.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/millrace/{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder; after the session has ended there is nothing to do."""
    try:
        if (jsc := spark.sparkContext._jsc) is None:
            return
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        return


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """The same rows read back from a Parquet table in the shared folder: lineage is cut, lost executors cost nothing.

    Where a bound of the number of (short) rows is known and they come out of an exchange, they are written by tasks of ``TASK_ROWS``, so small tables are few files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- Arrow to numpy
def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0, one more than rows) of a string or binary array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if not len(column) or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows with about ``most`` bytes together."""
    body, offsets = raw(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, body[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def longs(column: pa.Array) -> np.ndarray:
    """An integer column without nulls as int64."""
    return column.cast(pa.int64()).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def binaries(body: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array of the slices of ``body`` (any dtype) between ``offsets``, counted in items."""
    body = np.ascontiguousarray(body)
    at = np.asarray(offsets, np.int64) * body.dtype.itemsize
    if at[-1] < 1 << 31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(body)])


# ---------------------------------------------------------------- words and hashes
def words(body: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of bytes in ``member``, and for each document the index of its first word (one more at the end)."""
    inside = member[body]
    n = len(body)
    edges = offsets[(offsets > 0) & (offsets < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets).astype(np.int64)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i from 0 to n."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        known = np.full(size, base, np.uint64)
        known[0] = 1
        _powers[base] = known = np.multiply.accumulate(known)
    return known[: n + 1]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of body[start:end]; equal bytes have equal hashes wherever they stand."""
    total = np.empty(len(body) + 1, np.uint64)
    total[0] = 0
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(_P, len(body))[:-1], out=total[1:])
    h = (total[ends] - total[starts]) * powers(inverse(_P), len(body))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(_Q))


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """For each i with i + k <= len(h): a hash of h[i : i + k]."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    total = np.empty(len(h) + 1, np.uint64)
    total[0] = 0
    np.cumsum(h * powers(_Q, len(h))[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(inverse(_Q), len(h))[: len(h) - k + 1] + np.uint64(k))


def hash_of(items: list[bytes]) -> np.ndarray:
    """word_hashes of separate byte strings."""
    ends = np.cumsum([0, *map(len, items)])
    return word_hashes(np.frombuffer(b"".join(items), np.uint8), ends[:-1], ends[1:]) if items else np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + count)."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - before, counts)


def source(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Columns of a table of the input folder; the scan reads no others."""
    return tuned(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns))
