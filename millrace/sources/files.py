"""Files as chunks, through Spark's own file systems, and chunks as files."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.plans.frame import ChunkFrame, Names


def emit(spark: SparkSession, *data: bytes | str) -> ChunkFrame:
    """emit: literals, one chunk each."""
    return ChunkFrame.of(spark, [d.encode() if isinstance(d, str) else d for d in data])


def listing(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True, least: int | None = None, most: int | None = None) -> DataFrame:
    """ef -l: path, size and time of files, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("date"))
    if least is not None:
        files = files.filter(F.col("size") >= least)
    return files.filter(F.col("size") <= most) if most is not None else files


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True, least: int | None = None, most: int | None = None) -> ChunkFrame:
    """ef: whole files, ordered by path, which is a variable. Sizes are a filter of the scan, so other files are not opened. Spark lists no files of size 0."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    if least is not None:
        files = files.filter(F.col("length") >= least)
    if most is not None:
        files = files.filter(F.col("length") <= most)
    order = F.transform(F.split("path", ""), lambda c: F.when(c == "", F.lit(0)).otherwise(F.ascii(c)).cast("bigint"))
    rows = files.select(F.array().cast("array<string>").alias("path"), order.alias("ord"), F.lit(True).alias("visible"), F.col("content").alias("data"), F.create_map(F.lit("0:path"), F.col("path").cast("binary")).alias("meta"))
    return ChunkFrame(rows)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """ef -w: path and line, for texts of any size: a file is split over tasks."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_blocks(spark: SparkSession, path: str, size: int, pattern: str | None = None) -> DataFrame:
    """ef -r: path, block (from 0), data: files in blocks of a size."""
    files = spark.read.format("binaryFile")
    found = (files.option("pathGlobFilter", pattern) if pattern else files).load(path)
    blocks = found.filter("length > 0").select("path", "content", F.explode(F.sequence(F.lit(0), F.ceil(F.col("length") / size).cast("int") - 1)).alias("block"))
    return blocks.select("path", "block", F.substring("content", F.col("block") * size + 1, F.lit(size)).alias("data"))


def write_table(frame: ChunkFrame, path: str, *variables: str, mode: str = "errorifexists") -> None:
    """dump to a table: data and variables, in Parquet, ordered within files."""
    frame.table(*variables).sortWithinPartitions("ord").write.mode(mode).parquet(path)


def filled(template: str, data: bytes, found: dict[str, bytes], index: int) -> str:
    names = Names(data, found)

    def one(m: re.Match) -> str:
        if m[1] == "index":
            return str(index)
        value = names[m[1]] if m[1] in names else m[0]
        return value.decode("utf-8", "surrogateescape") if isinstance(value, bytes) else str(value)

    return re.sub(r"\{(\w+)\}", one, template)


def dump(frame: ChunkFrame, folder: str, template: str = "{index}.bin", force: bool = False) -> DataFrame:
    """dump and d2p: each chunk as a file named by a template of its variables, in a folder that all executors share. Gives path and size of the files.

    A name cannot leave the folder, and existing files stay unless ``force``. Files are written under another name first, so a task that runs twice does no harm.
    """
    depth = frame.depth
    rows = frame.df.select("ord", "data", "meta").withColumn("index", F.row_number().over(Window.orderBy("ord")) - 1) if "{index}" in template else frame.df.select("ord", "data", "meta", F.lit(0).alias("index"))
    root = folder.removeprefix("file://")

    def run(batches):
        for batch in batches:
            paths, sizes = [], []
            for data, meta, index in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                found = {k.split(":", 1)[1]: v for k, v in sorted(meta or ()) if int(k.split(":")[0]) <= depth}
                name = os.path.normpath("/" + filled(template, data or b"", found, index).replace("\0", "")).lstrip("/")
                to = os.path.join(root, name)
                if os.path.exists(to) and not force:
                    raise FileExistsError(to)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{os.getpid()}.part"
                with open(part, "wb") as file:
                    file.write(data or b"")
                os.replace(part, to)
                paths.append(to)
                sizes.append(len(data or b""))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    return rows.mapInArrow(run, "path string, size long")
