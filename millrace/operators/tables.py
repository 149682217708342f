"""Frame operators on tables, for any size: aggregations where windows over all rows would put them in one task, and column expressions wherever a unit has one."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import UNITS


def keep(df: DataFrame, condition: Column | str, negate: bool = False) -> DataFrame:
    """iff: rows for which a condition holds (null is no)."""
    c = F.expr(condition) if isinstance(condition, str) else condition
    return df.filter(~F.coalesce(c, F.lit(False)) if negate else c)


def each(df: DataFrame, unit: str, column: str, out: str | None = None, reverse: bool = False, **args: Any) -> DataFrame:
    """A unit of one output on a column, as an expression if it has one, else by Arrow batches; a failing row is null."""
    u = UNITS[unit]
    data = F.col(column).cast("binary")
    build = u.native_back if reverse else u.native
    native = build(data, **args) if build else None
    if native is not None:
        return df.withColumn(out or column, native)

    @F.pandas_udf("binary")
    def run(values):
        def one(v):
            if v is None:
                return None
            try:
                return u.undo(bytes(v), **args) if reverse else u.one(bytes(v), **args)
            except Exception:  # noqa: BLE001  what a unit cannot read is null
                return None

        return values.map(one)

    return df.withColumn(out or column, run(data))


def generate(df: DataFrame, unit: str, column: str, keys: list[str], variables: dict[str, str] | None = None, reverse: bool = False, **args: Any) -> DataFrame:
    """A unit of many outputs: keys, pos (from 0), data, and variables (name -> type) as columns. Only keys and the column are read."""
    u, names = UNITS[unit], dict(variables or {})
    kept = df.select(*keys, F.col(column).cast("binary").alias("_data"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_data"), "pos int", "data binary", *(f"{k} {t}" for k, t in names.items())])

    def run(batches):
        for batch in batches:
            take, pos, data = [], [], []
            extra: dict[str, list] = {k: [] for k in names}
            for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                if value is None:
                    continue
                try:
                    found = u(value, **args) if not reverse else [(u.undo(value, **args), {})]
                except Exception:  # noqa: BLE001  a row that fails has no outputs
                    continue
                for p, (out, meta) in enumerate(found):
                    take.append(i)
                    pos.append(p)
                    data.append(out)
                    for k, t in names.items():
                        v = meta.get(k)
                        extra[k].append(v.decode("utf-8", "replace") if isinstance(v, bytes) and t == "string" else str(v) if v is not None and t == "string" else v)
            kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
            picked = [c.take(pa.array(take, pa.int64())) for c in batch.columns[: len(keys)]]
            arrays = [*picked, pa.array(pos, pa.int32()), pa.array(data, pa.binary()), *(pa.array(v, kinds[names[k]]) for k, v in extra.items())]
            yield pa.RecordBatch.from_arrays(arrays, [*keys, "pos", "data", *names])

    return kept.mapInArrow(run, schema)


def dedup(df: DataFrame, key: Column | str, order: str, *first: str, count: str | None = None) -> DataFrame:
    """The first row of each key, by one aggregation with partial sums: key, order and the columns named; with the number of rows if asked for."""
    k = F.col(key) if isinstance(key, str) else key
    aggs = [F.min(order).alias(order), *(F.min_by(c, order).alias(c) for c in first)]
    return df.groupBy(k.alias(key if isinstance(key, str) else "key")).agg(*aggs, *([F.count("*").alias(count)] if count else []))


def group_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """groupby: key, number of rows, and the order of the first row, which orders the frames."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """sorted and pick :n in one: the first n of the whole table, by a top-n in each task."""
    return df.orderBy(*order).limit(n)


def pick(df: DataFrame, frame: list[str], order: list[Column], start: int = 0, stop: int | None = None) -> DataFrame:
    """pick: rows by their place in their frame. With a stop, tasks send no more than so many rows of a frame."""
    w = Window.partitionBy(*frame).orderBy(*order)
    rows = df.withColumn("place", F.row_number().over(w) - 1)
    return rows.filter((F.col("place") >= start) & (F.col("place") < stop if stop is not None else F.lit(True)))


def extreme(df: DataFrame, frame: list[str], key: Column, *columns: str, largest: bool = True) -> DataFrame:
    """max and min: the row with the extreme key of each frame; the key must decide ties."""
    pick_ = F.max_by if largest else F.min_by
    return df.groupBy(*frame).agg(*[pick_(c, key).alias(c) for c in columns])


def running(df: DataFrame, frame: list[str], order: list[Column], value: Column, out: str, step: Callable[[Column], Column] = F.sum) -> DataFrame:
    """scan: a running fold of a frame."""
    w = Window.partitionBy(*frame).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, step(value).over(w))


def count_across(df: DataFrame, item: str, frame: str) -> DataFrame:
    """xfcc: in how many frames an item is, by two aggregations."""
    return df.groupBy(item, frame).agg(F.lit(1).alias("one")).groupBy(item).agg(F.count("*").alias("n_frames"))


def joined(df: DataFrame, frame: list[str], order: str, value: str, separator: str, out: str) -> DataFrame:
    """sep: the values of a frame in their order, with a separator between."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return df.groupBy(*frame).agg(F.array_join(parts, separator).alias(out))


def attach(df: DataFrame, frame: list[str], order: Column, value: str, out: str) -> DataFrame:
    """push and pop: a value of the first row of a frame as a column of its other rows."""
    w = Window.partitionBy(*frame).orderBy(order)
    rows = df.withColumns({out: F.first(value).over(w), "place": F.row_number().over(w)})
    return rows.filter("place > 1").drop("place")


def combine(df: DataFrame, frame: list[str], item: str, keep_: bool = True) -> DataFrame:
    """urn 2: pairs of items of a frame, as combinations (or products), by a join on the frame."""
    a, b = df.select(*frame, F.col(item).alias("a")), df.select(*frame, F.col(item).alias("b"))
    pairs = a.join(b, frame)
    return pairs.filter("a < b") if keep_ else pairs


def transpose(df: DataFrame, frame: list[str], order: str, value: str) -> DataFrame:
    """transpose: frame, column (from 0), text: the characters of each place, in the order of the rows."""
    cells = df.filter(F.length(value) > 0).select(*frame, order, F.posexplode(F.split(value, "")).alias("column", "cell")).filter("cell <> ''")
    parts = F.transform(F.sort_array(F.collect_list(F.struct(order, "cell"))), lambda x: x["cell"])
    return cells.groupBy(*frame, "column").agg(F.array_join(parts, "").alias("text"))


def chop(df: DataFrame, value: str, size: int, keys: list[str]) -> DataFrame:
    """chop: keys, pos, part: pieces of so many characters, within the plan."""
    n = F.ceil(F.length(value) / size).cast("int")
    rows = df.filter(F.length(value) > 0).select(*keys, value, F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))
    return rows.select(*keys, "pos", F.substring(F.col(value), F.col("pos") * size + 1, F.lit(size)).alias("part"))


def split(df: DataFrame, value: str, pattern: str, keys: list[str]) -> DataFrame:
    """resplit without groups: keys, pos, part."""
    return df.select(*keys, F.posexplode(F.split(value, pattern)).alias("pos", "part"))


def ngrams(df: DataFrame, value: str, n: int, keys: list[str]) -> DataFrame:
    """ngrams of one size: keys, gram, and the offset of its first occurrence."""
    rows = df.filter(F.length(value) >= n).select(*keys, value, F.explode(F.sequence(F.lit(0), F.length(value) - n)).alias("at"))
    return rows.groupBy(*keys, F.substring(F.col(value), F.col("at") + 1, F.lit(n)).alias("gram")).agg(F.min("at").alias("offset"))
