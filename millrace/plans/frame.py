"""Chunk frames: DataFrames whose rows are byte strings in nested, ordered frames, with scoped variables.

Columns: ``path`` (an id for each layer; rows of a frame share it all), ``ord`` (their order, also across frames), ``visible``, ``data``, and ``meta``
(variables by ``depth:name``, so that closing a frame drops its variables and uncovers those of outer frames).

Operators on single chunks run together, however many there are, in one pass over Arrow batches or as column expressions. Operators on frames are windows
and aggregations by path; only folds whose steps are arbitrary gather a frame in a task.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "path array<string>, ord array<bigint>, visible boolean, data binary, meta map<string,binary>"
COLUMNS = ["path", "ord", "visible", "data", "meta"]
_ARROW = pa.schema([("path", pa.list_(pa.string())), ("ord", pa.list_(pa.int64())), ("visible", pa.bool_()), ("data", pa.binary()), ("meta", pa.map_(pa.string(), pa.binary()))])


def stored_value(value: Any) -> bytes:
    return bytes(value) if isinstance(value, (bytes, bytearray)) else value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, list) else repr(value).encode() if isinstance(value, float) else str(int(value)).encode()


@dataclass
class Chunk:
    """One row, as steps on single chunks see it."""

    data: bytes
    meta: dict[str, bytes]
    visible: bool
    path: list[str]
    ord: list[int]
    depth: int

    def names(self) -> dict[str, Any]:
        """Variables in sight, and those that every chunk has."""
        out: dict[str, Any] = {}
        for key in sorted(self.meta, key=lambda k: int(k.split(":")[0])):
            depth, name = key.split(":", 1)
            if int(depth) <= self.depth:
                out[name] = self.meta[key]
        return Names(self.data, out)

    def put(self, name: str, value: Any) -> None:
        self.meta[f"{self.depth}:{name}"] = stored_value(value)

    def drop(self, name: str) -> None:
        for d in range(self.depth, -1, -1):
            if self.meta.pop(f"{d}:{name}", None) is not None:
                return


class Names(dict):
    """Variables with the derived ones, which are only computed when they are asked for. Numbers are numbers again."""

    def __init__(self, data: bytes, found: dict[str, Any]):
        super().__init__({k: number_or(v) for k, v in found.items()})
        self.data = data

    def __contains__(self, key) -> bool:
        return super().__contains__(key) or key in DERIVED

    def __missing__(self, key):
        if key in DERIVED:
            return DERIVED[key](self.data)
        raise KeyError(key)

    def __or__(self, other):
        out = Names(self.data, {})
        out.update(self)
        out.update(other)
        return out


def number_or(value: Any) -> Any:
    if isinstance(value, bytes) and value[:1].isdigit() | (value[:1] == b"-") and len(value) < 20 and value.lstrip(b"-").isdigit() and (value == b"0" or not value.lstrip(b"-").startswith(b"0")):
        return int(value)
    return value


def _digest(name: str) -> Callable[[bytes], bytes]:
    return lambda data: __import__("hashlib").new(name, data).hexdigest().encode()


def _derived() -> dict[str, Callable[[bytes], Any]]:
    from millrace.functions.misc import coincidence, entropy, sniff

    return {
        "size": len, "entropy": entropy, "ic": coincidence, "ext": lambda d: sniff(d)[0].encode(), "mime": lambda d: sniff(d)[1].encode(), "magic": lambda d: sniff(d)[1].encode(), "crc32": lambda d: f"{__import__('zlib').crc32(d):08x}".encode(),
        "md5": _digest("md5"), "sha1": _digest("sha1"), "sha256": _digest("sha256"), "sha512": _digest("sha512"),
    }


DERIVED = _derived()
Step = Callable[[Chunk], list[Chunk]]


def python_step(df: DataFrame, steps: list[tuple[Step, bool]], depth: int) -> DataFrame:
    """All steps in one pass. A step with the mark is applied to visible chunks only; others pass."""

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for path, order, visible, data, meta in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                now = [Chunk(data or b"", dict(meta or ()), visible, path, order, depth)]
                for step, only in steps:
                    now = [y for x in now for y in (step(x) if x.visible or not only else [x])]
                rows += [(c.path, c.ord, c.visible, c.data, list(c.meta.items())) for c in now]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return df.mapInArrow(run, SCHEMA)


def several(outputs: list[tuple[bytes, dict[str, Any]]], chunk: Chunk, counted: bool) -> list[Chunk]:
    out = []
    for i, (data, meta) in enumerate(outputs):
        made = replace(chunk, data=data, meta=dict(chunk.meta), ord=[*chunk.ord, i] if counted else chunk.ord)
        for k, v in meta.items():
            made.put(k, v)
        out.append(made)
    return out


def _placed(key: str, value: Column) -> Column:
    """The variables with another one; a null is none."""
    kept = F.map_filter("meta", lambda k, _: k != key)
    return F.when(value.isNull(), F.col("meta")).otherwise(F.map_concat(kept, F.create_map(F.lit(key), value.cast("binary"))))


def _common(parts: str) -> Column:
    """The variables that all parts have with equal values."""
    entries = F.col(parts)["meta"]
    return F.aggregate(entries, F.map_from_entries(entries[0]), lambda a, m: F.map_filter(a, lambda k, v: F.coalesce(F.map_from_entries(m)[k] == v, F.lit(False))))


class ChunkFrame:
    """A frame of a given depth; depth 0 is a plain sequence of chunks."""

    def __init__(self, df: DataFrame, depth: int = 0):
        self.df, self.depth = df, depth

    # ------------------------------------------------------------ sources and results
    @classmethod
    def of(cls, spark: SparkSession, chunks: list[bytes]) -> ChunkFrame:
        rows = [([], [i], True, bytearray(c), {}) for i, c in enumerate(chunks)]
        return cls(spark.createDataFrame(rows, SCHEMA))

    @classmethod
    def from_table(cls, df: DataFrame, data: str, order: str, frame: str | None = None, **variables: str) -> ChunkFrame:
        """Rows of a table as chunks: a column of data, an integer order, a column whose values are the frames, and columns as variables."""
        depth = 1 if frame else 0
        path = F.array(F.col(frame).cast("string")) if frame else F.array().cast("array<string>")
        pairs = [x for k, c in variables.items() for x in (F.lit(f"{depth}:{k}"), F.col(c).cast("string").cast("binary"))]
        meta = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,binary>")
        return cls(df.select(path.alias("path"), F.array(F.col(order).cast("bigint")).alias("ord"), F.lit(True).alias("visible"), F.col(data).cast("binary").alias("data"), meta.alias("meta")), depth)

    def ordered(self) -> DataFrame:
        return self.df.orderBy("path", "ord") if self.depth else self.df.orderBy("ord")

    def collect(self) -> list[bytes]:
        return [bytes(r["data"]) for r in self.df.select("ord", "data").orderBy("ord").collect()]

    def table(self, *names: str) -> DataFrame:
        """data and the variables of these names as columns."""
        return self.df.select("path", "ord", "data", *[self.variable(n).alias(n) for n in names])

    # ------------------------------------------------------------ scopes
    def variable(self, name: str) -> Column:
        """The innermost value of a variable, or of a derived one."""
        native = {"size": F.length("data").cast("string").cast("binary"), "md5": F.md5("data").cast("binary"), "sha1": F.sha1("data").cast("binary"), "sha256": F.sha2("data", 256).cast("binary"), "crc32": F.lower(F.lpad(F.hex(F.crc32("data")), 8, "0")).cast("binary")}
        found = [F.col("meta")[f"{d}:{name}"] for d in range(self.depth, -1, -1)]
        return F.coalesce(*found, *([native[name]] if name in native else []))

    def with_variable(self, name: str, value: Column) -> ChunkFrame:
        return self._with(meta=_placed(f"{self.depth}:{name}", value))

    def _with(self, depth: int | None = None, **columns: Column) -> ChunkFrame:
        return ChunkFrame(self.df.withColumns(columns).select(*COLUMNS), self.depth if depth is None else depth)

    def _of(self, df: DataFrame, depth: int | None = None) -> ChunkFrame:
        return ChunkFrame(df.select(*COLUMNS), self.depth if depth is None else depth)

    def each(self, *steps: Step, hidden_too: bool = False) -> ChunkFrame:
        return ChunkFrame(python_step(self.df, [(s, not hidden_too) for s in steps], self.depth), self.depth)

    def opened(self, parent: Column, layers: int = 1) -> ChunkFrame:
        """Each parent's rows become a frame; ``parent`` tells parents apart."""
        more = F.array(parent.cast("string"), *[F.lit("0")] * (layers - 1))
        return self._with(depth=self.depth + layers, path=F.concat("path", more))

    def closed(self, layers: int = 1) -> ChunkFrame:
        """Frames end: below the outermost layer their chunks are joined, and variables stay that live further out and are equal on all of them."""
        depth = max(0, self.depth - layers)
        kept = F.map_filter("meta", lambda k, _: F.split(k, ":")[0].cast("int") <= depth)
        if not depth:
            return self._with(depth=0, path=F.array().cast("array<string>"), meta=kept, visible=F.lit(True))
        rows = self.df.withColumn("meta", kept).withColumn("own", F.slice("path", 1, depth + 1))
        parts = F.sort_array(F.collect_list(F.struct("ord", "data", F.map_entries("meta").alias("meta"), "visible")))
        joined = rows.groupBy("own").agg(parts.alias("parts"))
        same = _common("parts")
        text = F.aggregate(F.col("parts.data"), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
        done = joined.select(F.slice("own", 1, depth).alias("path"), F.col("parts")[0]["ord"].alias("ord"), F.exists(F.col("parts.visible"), lambda v: v).alias("visible"), text.alias("data"), same.alias("meta"))
        return ChunkFrame(done, depth)

    def squeezed(self, parent: Column) -> ChunkFrame:
        """The outputs of each parent as one chunk."""
        parts = F.sort_array(F.collect_list(F.struct("ord", "data", F.map_entries("meta").alias("meta"), "visible")))
        joined = self.df.groupBy("path", parent.alias("parent")).agg(parts.alias("parts"))
        same = _common("parts")
        text = F.aggregate(F.col("parts.data"), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
        return ChunkFrame(joined.select("path", F.col("parts")[0]["ord"].alias("ord"), F.col("parts")[0]["visible"].alias("visible"), text.alias("data"), same.alias("meta")), self.depth)

    # ------------------------------------------------------------ windows over frames
    @property
    def window(self):
        return Window.partitionBy("path").orderBy("ord")

    @property
    def whole(self):
        return Window.partitionBy("path")

    def indexed(self) -> ChunkFrame:
        return self.with_variable("index", (F.row_number().over(self.window) - 1).cast("string"))

    def pick(self, *slices: slice) -> ChunkFrame:
        """Chunks by their place among the visible ones, in the order of the slices; hidden ones pass."""
        shown = F.col("visible")
        place, count = F.sum(shown.cast("int")).over(self.window) - 1, F.sum(shown.cast("int")).over(self.whole)
        rows = self.df.withColumns({"place": place, "count": count})
        hits = []
        for i, s in enumerate(slices or (slice(None),)):
            step = s.step or 1
            bound = lambda v, d: d if v is None else F.greatest(F.lit(0), F.least(F.col("count"), F.lit(v) if v >= 0 else F.col("count") + v))
            if step > 0:
                low, high = bound(s.start, F.lit(0)), bound(s.stop, F.col("count"))
                ok = (F.col("place") >= low) & (F.col("place") < high) & ((F.col("place") - low) % step == 0)
                turn = F.col("place")
            else:
                top = F.col("count") - 1 if s.start is None else F.least(F.col("count") - 1, F.lit(s.start) if s.start >= 0 else F.col("count") + s.start)
                low = F.lit(-1) if s.stop is None else F.lit(s.stop) if s.stop >= 0 else F.col("count") + s.stop
                ok = (F.col("place") <= top) & (F.col("place") > low) & ((top - F.col("place")) % -step == 0)
                turn = -F.col("place")
            hits.append(F.when(ok, F.struct(F.lit(i).cast("bigint").alias("i"), turn.cast("bigint").alias("turn"))))
        found = rows.filter("visible").select("*", F.explode(F.array_compact(F.array(*hits))).alias("hit"))
        least = F.min(F.col("ord")).over(self.whole)
        if len(slices) > 1 or any((s.step or 1) < 0 for s in slices):
            found = found.withColumn("first", least).withColumn("ord", F.concat("first", F.array("hit.i", "hit.turn"), "ord"))
        return self._of(found.unionByName(rows.filter("not visible"), True))

    def backwards(self) -> ChunkFrame:
        return self.pick(slice(None, None, -1))

    def scoped(self, *slices: slice, visible: bool = True) -> ChunkFrame:
        """Shows the chunks at these places and hides all others."""
        rows = self.df.withColumns({"place": F.row_number().over(self.window) - 1, "count": F.count("*").over(self.whole)})
        bound = lambda v, d: d if v is None else F.lit(v) if v >= 0 else F.col("count") + v
        hit = F.lit(False)
        for s in slices:
            low, high = bound(s.start, F.lit(0)), bound(s.stop, F.col("count"))
            hit = hit | ((F.col("place") >= low) & (F.col("place") < high) & ((F.col("place") - low) % (s.step or 1) == 0))
        return self._of(rows.withColumn("visible", hit if visible else ~hit))

    def sorted(self, key: Column | None = None, ascending: bool = False) -> ChunkFrame:
        """By key and then bytes, from the largest; hidden chunks are borders between runs that are sorted on their own."""
        run = F.sum((~F.col("visible")).cast("int")).over(self.window)
        way = (lambda c: c.asc()) if ascending else (lambda c: c.desc())
        rows = self.df.withColumn("run", run)
        keys = [way(c) for c in ([key] if key is not None else []) + [F.col("data")]]
        inner = Window.partitionBy("path", "run", "visible").orderBy(*keys, "ord")
        slots = Window.partitionBy("path", "run", "visible").orderBy("ord")
        rows = rows.withColumns({"rank": F.row_number().over(inner), "slot": F.row_number().over(slots)})
        places = rows.select("path", "run", "visible", F.col("slot").alias("rank"), F.col("ord").alias("place"))
        return self._of(rows.join(places, ["path", "run", "visible", "rank"]).withColumn("ord", F.col("place")))

    def extreme(self, key: Column | None = None, largest: bool = True) -> ChunkFrame:
        """The first visible chunk with the largest (or smallest) key; hidden ones pass."""
        key = F.col("data") if key is None else key
        best = Window.partitionBy("path", "visible").orderBy(key.desc_nulls_last() if largest else key.asc_nulls_last(), "ord")
        return self._of(self.df.withColumn("rank", F.row_number().over(best)).filter("not visible or rank = 1"))

    def dedup(self, key: Column | None = None, count: bool = False) -> ChunkFrame:
        """The first of equal visible chunks; with their number if asked for."""
        key = F.col("data") if key is None else key
        rows = self.df.withColumn("key", key)
        same = Window.partitionBy("path", "visible", "key")
        rows = rows.withColumns({"rank": F.row_number().over(same.orderBy("ord")), "n": F.count("*").over(same)}).filter("not visible or rank = 1")
        kept = ChunkFrame(rows, self.depth)
        return kept.with_variable("count", F.when(F.col("visible"), F.col("n").cast("string"))) if count else self._of(rows)

    def group(self, size: int) -> ChunkFrame:
        """Frames of so many chunks each."""
        return self._batched(self.df, F.floor((F.row_number().over(self.window) - 1) / size))

    def _batched(self, rows: DataFrame, batch: Column) -> ChunkFrame:
        """Frames of rows with the same batch, in the order of the first row of each; as the next layer of the path."""
        named = rows.withColumn("batch", batch)
        first = F.min("ord").over(Window.partitionBy("path", "batch"))
        named = named.withColumn("first", first)
        return ChunkFrame(named.withColumn("path", F.concat("path", F.array(F.concat_ws(".", F.transform("first", lambda x: F.lpad(x.cast("string"), 12, "0")))))).withColumn("ord", F.concat("first", "ord")).select(*COLUMNS), self.depth + 1)

    def groupby(self, name: str) -> ChunkFrame:
        """Frames of equal values of a variable, in the order of their first chunks; chunks without it are one frame too."""
        return self._batched(self.df, self.variable(name))

    def separated(self, separator: bytes = b"\n", scoped: bool = False) -> ChunkFrame:
        """A chunk between any two of a frame."""
        rows = self.df if scoped else self.df.withColumn("visible", F.lit(True))
        shown = rows.filter("visible").withColumn("last", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ord"))) == 1)
        extra = shown.filter("not last").withColumns({"data": F.lit(bytearray(separator)), "ord": F.concat("ord", F.array(F.lit((1 << 62)).cast("bigint"))), "meta": F.create_map().cast("map<string,binary>")})
        return self._of(rows.unionByName(extra.drop("last")))

    def queued(self, chunks: list[bytes], front: bool) -> ChunkFrame:
        """New chunks before or after those of each frame."""
        ends = self.df.groupBy("path").agg((F.min("ord") if front else F.max("ord")).alias("ord"))
        at = (lambda i: F.concat(F.array(F.element_at("ord", 1) - 1), F.array(F.lit(i).cast("bigint")))) if front else (lambda i: F.concat("ord", F.array(F.lit(1 << 62).cast("bigint"), F.lit(i).cast("bigint"))))
        new = None
        for i, c in enumerate(chunks):
            row = ends.select("path", at(i).alias("ord"), F.lit(True).alias("visible"), F.lit(bytearray(c)).alias("data"), F.create_map().cast("map<string,binary>").alias("meta"))
            new = row if new is None else new.unionByName(row)
        return self._of(self.df.unionByName(new)) if new is not None else self

    def pushed(self, data: bytes | None = None) -> ChunkFrame:
        """Each chunk twice: as it is but hidden, and visible (or with other data)."""
        rows = self.df.filter("visible")
        both = F.array(F.struct(F.lit(0).cast("bigint").alias("i"), F.lit(False).alias("v"), F.col("data").alias("d")), F.struct(F.lit(1).cast("bigint").alias("i"), F.lit(True).alias("v"), (F.col("data") if data is None else F.lit(bytearray(data))).alias("d")))
        made = rows.select("path", "ord", "meta", F.explode(both).alias("x")).select("path", F.concat("ord", F.array("x.i")).alias("ord"), F.col("x.v").alias("visible"), F.col("x.d").alias("data"), "meta")
        return self._of(made.unionByName(self.df.filter("not visible").select(*COLUMNS)))

    def popped(self, names: list[tuple[str | None, int]], outwards: int = 0) -> ChunkFrame:
        """The first visible chunks of a frame become variables of all others, which are shown again, in the scope so many layers further out. (None, n) drops n of them."""
        rows = self.df.withColumn("place", F.when(F.col("visible"), F.sum(F.col("visible").cast("int")).over(self.window) - 1))
        total = sum(n for _, n in names)
        rows = rows.withColumn("gone", F.coalesce(F.col("place") < total, F.lit(False)))
        at, out = 0, rows
        for name, n in names:
            if name is not None:
                value = F.max(F.when(F.col("place") == at, F.col("data"))).over(self.whole)
                out = out.withColumn(f"pop_{name}", value)
            at += n
        out = out.filter("not gone").withColumn("visible", F.lit(True))
        frame = ChunkFrame(out, self.depth)
        for name, _ in names:
            if name is not None:
                depth = max(1, self.depth - outwards) if outwards else self.depth
                frame = ChunkFrame(frame.df.withColumn("meta", _placed(f"{depth}:{name}", F.col(f"pop_{name}"))), self.depth)
        return self._of(frame.df)

    def joined_as_variables(self, name: str, data: bytes = b"") -> ChunkFrame:
        """One chunk with a variable for each chunk, named by one of its variables."""
        key = self.variable(name).cast("string")
        rows = self.df.withColumn("key", F.concat(F.lit(f"{self.depth}:"), key)).filter("key is not null")
        last = rows.groupBy("path", "key").agg(F.max_by("data", "ord").alias("data"), F.min("ord").alias("ord"))
        made = last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("key", "data"))).alias("meta"), F.min("ord").alias("ord"))
        return ChunkFrame(made.select("path", "ord", F.lit(True).alias("visible"), F.lit(bytearray(data)).alias("data"), "meta"), self.depth)

    def counted_across(self, name: str = "count", relative: bool = False) -> ChunkFrame:
        """Equal chunks of all frames under one parent once, with their number (which existing counts weigh)."""
        outer = F.slice("path", 1, max(0, self.depth - 1))
        weight = F.coalesce(self.variable(name).cast("string").cast("double"), F.lit(1.0))
        rows = self.df.withColumns({"outer": outer, "weight": weight})
        sums = rows.groupBy("outer", "data").agg(F.sum("weight").alias("n"), F.min("ord").alias("ord"), F.min_by("path", "ord").alias("path"), F.min_by("meta", "ord").alias("meta"))
        n = F.col("n") / F.max("n").over(Window.partitionBy("outer")) if relative else F.col("n").cast("bigint")
        first = F.first("path").over(Window.partitionBy("outer").orderBy("ord"))
        made = sums.withColumns({"n": n, "path": first, "visible": F.lit(True)})
        return self._of(ChunkFrame(made, self.depth).with_variable(name, F.col("n").cast("string")).df)

    def running(self, name: str, step: str = "sum", of: Column | None = None) -> ChunkFrame:
        """A running sum, minimum or maximum of numbers as a variable, without gathering the frame."""
        value = (F.col("data") if of is None else of).cast("string").cast("bigint")
        window = self.window.rowsBetween(Window.unboundedPreceding, 0)
        return self._of(self.with_variable(name, getattr(F, step)(value).over(window).cast("string")).df)

    def framewise(self, work: Callable[[list[Chunk]], list[Chunk]]) -> ChunkFrame:
        """For steps that need a frame in their hands: a frame is gathered in one task, and must fit there."""
        depth = self.depth

        def run(group: pa.Table) -> pa.Table:
            rows = [Chunk(r["data"] or b"", dict(r["meta"] or ()), r["visible"], r["path"], r["ord"], depth) for r in group.to_pylist()]
            out = work(sorted(rows, key=lambda c: c.ord))
            columns = list(zip(*[(c.path, c.ord, c.visible, c.data, list(c.meta.items())) for c in out], strict=True)) or [[]] * 5
            return pa.table([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

        return ChunkFrame(self.df.groupBy("path").applyInArrow(run, SCHEMA), depth)

    def transposed(self, padding: bytes = b"") -> ChunkFrame:
        """The columns of the matrix whose rows are the chunks."""
        wide = F.max(F.length("data")).over(self.whole)
        rows = self.df.filter("visible").withColumn("wide", wide)
        if padding:
            rows = rows.withColumn("data", F.rpad("data", F.col("wide"), F.lit(bytearray(padding))))
        cells = rows.filter(F.length("data") > 0).select("path", "ord", "meta", F.explode(F.sequence(F.lit(0), F.length("data") - 1)).alias("column"), "data").withColumn("cell", F.substring("data", F.col("column") + 1, F.lit(1)))
        parts = F.sort_array(F.collect_list(F.struct("ord", "cell", F.map_entries("meta").alias("meta"))))
        made = cells.groupBy("path", "column").agg(parts.alias("parts"))
        text = F.aggregate(F.col("parts.cell"), F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b))
        same = _common("parts")
        return ChunkFrame(made.select("path", F.array(F.col("column").cast("bigint")).alias("ord"), F.lit(True).alias("visible"), text.alias("data"), same.alias("meta")), self.depth)

    def urn(self, sizes: tuple[int, int] | None, keep: bool = False, ordered: bool = False) -> ChunkFrame:
        """All draws of the sizes: products, combinations (keep), combinations with repeats (ordered) or permutations (both). Each draw is a chunk of its items' bytes in a frame of their own."""
        draw = {(False, False): lambda i, r: itertools.product(i, repeat=r), (True, False): itertools.combinations, (False, True): itertools.combinations_with_replacement, (True, True): itertools.permutations}[keep, ordered]

        def work(chunks: list[Chunk]) -> list[Chunk]:
            shown = [c for c in chunks if c.visible]
            low, high = sizes or (len(shown), len(shown))
            out = []
            for r in range(low, high + 1):
                for n, items in enumerate(draw(shown, r)):
                    for k, c in enumerate(items):
                        out.append(replace(c, path=c.path, ord=[r, n, k], meta=dict(c.meta)))
                        out[-1].meta[f"{c.depth}:_draw"] = f"{r}.{n}".encode()
            return out

        return self.framewise(work)
