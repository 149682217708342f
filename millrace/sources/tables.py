"""Tables in text files and databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import generate


def read_csv(spark: SparkSession, path: str, schema: str | None = None, quote: str = '"', delimiter: str = ",") -> DataFrame:
    """csv with a header. Without a schema all columns are strings: nothing is read twice."""
    reader = spark.read.option("header", "true").option("quote", quote).option("escape", '"').option("sep", delimiter).option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """xjl: a row for each line; with a schema the file is read once."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_database(spark: SparkSession, path: str, query: str) -> DataFrame:
    """sqlite: path, pos and row (as JSON) of a query on each database file, a file a task at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return generate(files, "sqlite", "content", ["path"], query=query).select("path", "pos", F.decode("data", "UTF-8").alias("row"))
