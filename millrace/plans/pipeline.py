"""Pipelines: ``emit A B [| chop 1 | rev ]| sep ,`` as text, or the same steps in code.

Text is split at bars into units with their words. A unit may end in ``[`` (its outputs are a frame), ``]`` (frames end) or ``[]`` (the outputs of each chunk
become one). Steps on single chunks that follow each other are compiled together: into column expressions where all of them have one, else into one pass over
Arrow batches. Steps on frames are DataFrame operations.
"""

from __future__ import annotations

import fnmatch
import re
import shlex
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import UNITS
from millrace.functions.blockwise import Formula
from millrace.functions.registry import made
from millrace.plans.arguments import bind, reversed_
from millrace.plans.frame import Chunk, ChunkFrame, several
from millrace.plans.multibin import Scope, as_bytes, as_slice, number, split_handler


@dataclass(frozen=True)
class Call:
    """A unit with its words and the frames that it opens (positive) or closes."""

    name: str
    words: tuple[str, ...] = ()
    opens: int = 0
    closes: int = 0
    squeeze: bool = False
    flags: frozenset[str] = field(default_factory=frozenset)


def parse(text: str) -> list[Call]:
    calls = []
    for part in split_bars(text):
        lexer = shlex.shlex(part, posix=True)
        lexer.whitespace_split, lexer.commenters, lexer.escape = True, "", ""
        words = list(lexer)
        opens = closes = 0
        squeeze = False
        while len(words) > 1 and re.fullmatch(r"[\[\]]+", words[-1]):
            marks = words.pop()
            if "[]" in marks:
                squeeze, marks = True, marks.replace("[]", "", 1)
            opens, closes = opens + marks.count("["), closes + marks.count("]")
        if not words:
            raise ValueError(f"no unit in {part!r}")
        flags = frozenset(w for w in words[1:] if w in ("-L", "-T", "-Q", "-F", "-FF"))
        calls.append(Call(words[0], tuple(words[1:]), opens, closes, squeeze, flags))
    return calls


def split_bars(text: str) -> list[str]:
    """At bars outside of quotation marks and of brackets that belong to a word."""
    out, start, quote, depth = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "[" and i and not text[i - 1].isspace() and text[i - 1] not in "[]|" or depth and c == "[":
            depth += 1
        elif c == "]" and depth:
            depth -= 1
        elif c == "|" and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*out, text[start:]] if p.strip()]


# ---------------------------------------------------------------- steps on single chunks
def scope_of(chunk: Chunk) -> Scope:
    return Scope(chunk.data, chunk.names())


def unit_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    unit = UNITS[call.name]
    back = reversed_(list(call.words))
    lenient = bool(call.flags & {"-L", "-T"})

    def step(chunk: Chunk) -> list[Chunk]:
        if call.flags & {"-F", "-FF"} and unit.accepts and not unit.accepts(chunk.data):
            return [] if "-FF" in call.flags else [chunk]
        scope = scope_of(chunk)
        kw = bind(unit, list(call.words), scope, back)
        kept = replace(chunk, meta=dict(chunk.meta))
        for name in scope.eaten:
            kept.drop(name)
        try:
            outputs = made(unit.backward(scope.data, **kw) if back else unit.forward(scope.data, **kw))
        except Exception:
            if lenient:
                return [chunk]
            return []  # a chunk that fails goes, and the others go on
        return several(outputs, kept, unit.many or call.opens > 0 or call.squeeze)

    return step


def template(text: str, chunk: Chunk, pieces: list[bytes]) -> bytes:
    """Fields {} for the data, {0} for pieces, {name} for variables, with :handlers; what is unknown stays as it is written."""
    names, out, at, turn = chunk.names(), b"", 0, 0
    for m in re.finditer(r"\{\{|\}\}|\{([^{}!:]*)(?:!([a-z]))?(?::([^{}]*))?\}", text):
        out += text[at : m.start()].encode()
        at = m.end()
        if m[0] in ("{{", "}}"):
            out += m[0][:1].encode()
            continue
        name, how, spec = m[1], m[2], m[3]
        if how in ("s", "a", "u", "h", "q", "n"):
            value: Any = Scope(chunk.data, names).value(f"{how}:{name}")
        elif not name or name.lstrip("-").isdigit():
            k = int(name) if name else turn
            turn += not name
            value = pieces[k] if -len(pieces) <= k < len(pieces) else None
        elif name in names:
            value = names[name]
        else:
            try:
                value = Formula(name)(names)
            except (NameError, SyntaxError, KeyError, TypeError):
                value = None
        if value is None:
            out += m[0].encode()
            continue
        if spec:
            try:
                if isinstance(value, (bytes, bytearray)):
                    raise ValueError
                value = format(value, spec)
            except ValueError:
                for handler in reversed(spec.rstrip(":").split(":")):
                    value = apply_handler(handler, value, chunk, names)
        out += as_bytes(value)
    return out + text[at:].encode()


def apply_handler(handler: str, value: Any, chunk: Chunk, names: dict) -> Any:
    names = names | {"_value": value}
    found = split_handler(handler + ":")
    name, options = (found[0], found[1]) if found else (handler, [])
    option = f"[{','.join(options)}]" if options else ""
    return Scope(chunk.data, names).value(f"{name}{option}:var:_value")


def pf_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    words = [w for w in call.words if w not in ("-L", "-T", "-n")]

    def step(chunk: Chunk) -> list[Chunk]:
        return [replace(chunk, data=template(t, chunk, [chunk.data]), ord=[*chunk.ord, i] if len(words) > 1 else chunk.ord, meta=dict(chunk.meta)) for i, t in enumerate(words)]

    return step


def put_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    words = [w for w in call.words if not w.startswith("-")]
    name, rest = words[0], words[1] if len(words) > 1 else None
    if not name.isidentifier() or (len(name) == 1 and name.isupper()):
        raise ValueError(f"{name!r} is no name for a variable")

    def step(chunk: Chunk) -> list[Chunk]:
        out = replace(chunk, meta=dict(chunk.meta))
        scope = scope_of(chunk)
        if rest is None:
            value: Any = chunk.data
        else:
            try:
                value = number(rest, scope) if re.fullmatch(r"[-\d(].*", rest) and not split_handler(rest) else scope.formula(rest) if rest in scope.names else scope.value(rest)
            except (ValueError, SyntaxError, NameError):
                value = scope.value(rest)
        out.data = scope.data
        for gone in scope.eaten:
            out.drop(gone)
        out.put(name, value)
        return [out]

    return step


def eat_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    def step(chunk: Chunk) -> list[Chunk]:
        out = replace(chunk, data=as_bytes(chunk.names()[call.words[0]]), meta=dict(chunk.meta))
        out.drop(call.words[0])
        return [out]

    return step


def rmv_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    def step(chunk: Chunk) -> list[Chunk]:
        out = replace(chunk, meta=dict(chunk.meta))
        for name in call.words or [k.split(":", 1)[1] for k in chunk.meta]:
            out.drop(name)
        return [out]

    return step


def swap_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    def step(chunk: Chunk) -> list[Chunk]:
        names, out = chunk.names(), replace(chunk, meta=dict(chunk.meta))
        a = call.words[0]
        if len(call.words) == 1:
            out.data = as_bytes(names[a])
            out.put(a, chunk.data)
        else:
            b = call.words[1]
            out.put(b, names[a])
            out.put(a, names[b]) if b in names else out.drop(a)
        return [out]

    return step


def mvg_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    top = "-t" in call.words
    names = [w for w in call.words if not w.startswith("-")]

    def step(chunk: Chunk) -> list[Chunk]:
        out = replace(chunk, meta=dict(chunk.meta))
        to = 1 if top else max(1, chunk.depth - max(1, call.closes))
        for key in list(out.meta):
            depth, name = key.split(":", 1)
            if int(depth) > to and (not names or name in names):
                value = out.meta.pop(key)
                out.meta[f"{to}:{name}"] = value
        return [out]

    return step


def cm_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    letters = {"S": "size", "x": "ext", "E": "entropy", "C": "ic", "M": "magic", "1": "sha1", "2": "sha256", "3": "crc32", "5": "md5"}
    words = [w for w in call.words if not w.startswith("-")]
    flags = {c for w in call.words if w.startswith("-") for c in w[1:]}
    names = [*words, *(letters[c] for c in flags if c in letters)] or (["size", "ext", "entropy", "ic", "magic", "mime", "md5", "sha1", "sha256", "crc32"] if "a" in flags else ["size"])

    def step(chunk: Chunk) -> list[Chunk]:
        out, found = replace(chunk, meta=dict(chunk.meta)), chunk.names()
        for n in names:
            out.put(n, found[n])
        return [out]

    return step


_OPERATORS = {"-eq": "==", "-ne": "!=", "-lt": "<", "-le": "<=", "-gt": ">", "-ge": ">=", "-ct": "ct", "-in": "in"}


def _operand(text: str, scope: Scope) -> Any:
    found = split_handler(text)
    try:
        return scope.value(text) if found and found[0] in ("h", "H", "s", "u", "a", "v", "var") else scope.formula(text)
    except (NameError, SyntaxError, ValueError):
        return scope.value(text)


def _within(needle: Any, hay: Any) -> bool:
    if isinstance(hay, bytes) and isinstance(needle, bytes):
        text = needle.decode("utf-8", "replace")
        return any(x in hay for x in (needle, text.encode("latin-1", "replace"), text.encode("utf-16le")))
    return needle in hay


def holds(name: str, words: list[str], chunk: Chunk) -> bool:
    """What the conditional units ask."""
    scope = scope_of(chunk)
    if name == "iff":
        for i, w in enumerate(words):
            if w in _OPERATORS:
                left = _operand(" ".join(words[:i]), scope) if i else chunk.data
                right = _operand(" ".join(words[i + 1 :]), scope)
                if w in ("-ct", "-in"):
                    return _within(right, left) if w == "-ct" else _within(left, right)
                return bool(Formula(f"a {_OPERATORS[w]} b")({"a": left, "b": right}))
        return bool(scope.formula(" ".join(words))) if words else bool(chunk.data)
    if name == "iffc":
        n = len(chunk.data)
        for w in words:
            s = as_slice(w, scope.names)
            low, high = s.start or 0, s.stop - (":" not in w) if s.stop is not None else None
            if n >= low and (high is None or n <= high) and (n - low) % (s.step or 1) == 0:
                return True
        return False
    if name == "iffs":
        needle = as_bytes(scope.value(next(w for w in words if w != "-i")))
        return needle.lower() in chunk.data.lower() if "-i" in words else needle in chunk.data
    if name == "iffid":
        from millrace.functions.misc import sniff

        ext, mime = sniff(chunk.data)
        return any(fnmatch.fnmatch(x, w) for w in words for x in (ext, mime, mime.split("/")[-1]))
    from millrace.functions.patterns import NAMED, compiled

    if name == "iffp":
        partial = "-p" in words
        patterns = [compiled(NAMED.get(w, w)) for w in words if w != "-p"]
        return any((p.match if partial else p.fullmatch)(chunk.data) for p in patterns)
    flags = [w for w in words if w.startswith("-")]
    rest = [w for w in words if not w.startswith("-")]
    pattern = compiled(as_bytes(scope.value(rest[0])), "-M" in flags, "-I" in flags)
    if "-U" in flags or "-m" in flags:
        return bool(pattern.fullmatch(chunk.data))
    return len(pattern.findall(chunk.data)) >= max(1, int(rest[1]) if len(rest) > 1 else 1)


def iff_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    negate, hide = "-R" in call.words, "-r" in call.words
    words = [w for w in call.words if w not in ("-R", "-r")]

    def step(chunk: Chunk) -> list[Chunk]:
        if holds(call.name, words, chunk) != negate:
            return [chunk]
        return [replace(chunk, visible=False)] if hide else []

    return step


def loop_step(call: Call) -> Callable[[Chunk], list[Chunk]]:
    """A suffix of handlers, applied again and again to the data."""
    words = list(call.words)
    conditions = {}
    for flag in ("-w", "-u"):
        if flag in words:
            i = words.index(flag)
            conditions[flag] = words[i + 1]
            del words[i : i + 2]
    count, suffix = words[0], words[1]

    def step(chunk: Chunk) -> list[Chunk]:
        from millrace.functions.patterns import compiled

        data, times = chunk.data, number(count, scope_of(chunk))
        for _ in range(times):
            if "-w" in conditions and not compiled(conditions["-w"]).search(data) or "-u" in conditions and compiled(conditions["-u"]).search(data):
                break
            try:
                now = as_bytes(apply_handlers(suffix, data, chunk))
            except Exception:  # noqa: BLE001  the last good data is the result
                break
            if not now:
                break
            data = now
        return [replace(chunk, data=data)]

    return step


def apply_handlers(suffix: str, value: Any, chunk: Chunk, **names: Any) -> Any:
    for handler in reversed(split_suffix(suffix)):
        value = apply_handler(handler, value, chunk, chunk.names() | names)
    return value


def split_suffix(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += {"[": 1, "]": -1}.get(c, 0)
        if c == ":" and not depth:
            out.append(text[start:i])
            start = i + 1
    return [p for p in [*out, text[start:]] if p]


STEPS = {"pf": pf_step, "put": put_step, "eat": eat_step, "rmv": rmv_step, "swap": swap_step, "mvg": mvg_step, "cm": cm_step, "loop": loop_step} | {n: iff_step for n in ("iff", "iffc", "iffid", "iffp", "iffs", "iffx")}


# ---------------------------------------------------------------- steps on frames
def _flags(words: Iterable[str]) -> tuple[set[str], list[str]]:
    flags = {c for w in words if re.fullmatch(r"-[A-Za-z]+", w) for c in w[1:]}
    return flags, [w for w in words if not re.fullmatch(r"-[A-Za-z]+", w)]


def _key(frame: ChunkFrame, words: list[str]):
    """A variable as a key: numbers by value, other values by bytes."""
    if not words:
        return None
    if words[0] == "size":
        return F.length("data")
    value = frame.variable(words[0])
    return value


def _slices(words: list[str]) -> list[slice]:
    return [as_slice(w, {}) for w in words]


def _pop(frame: ChunkFrame, call: Call) -> ChunkFrame:
    names: list[tuple[str | None, int]] = []
    after: list[tuple[str, str]] = []
    for w in call.words:
        if w.isdigit():
            names.append((None, int(w)))
        else:
            name, _, handlers = w.partition(":")
            names.append((name, 1))
            if handlers:
                after.append((name, handlers))
    out = frame.popped(names, call.closes)
    for name, handlers in after:

        def step(chunk: Chunk, name=name, handlers=handlers) -> list[Chunk]:
            kept = replace(chunk, meta=dict(chunk.meta))
            if name in chunk.names():
                kept.put(name, apply_handlers(handlers, chunk.names()[name], chunk))
            return [kept]

        out = out.each(step)
    return out


def _reduce(frame: ChunkFrame, call: Call) -> ChunkFrame:
    words = list(call.words)
    just, temp = 0, "t"
    for flag, kind in (("-j", int), ("-t", str)):
        if flag in words:
            i = words.index(flag)
            value = kind(words[i + 1])
            del words[i : i + 2]
            just, temp = (value, temp) if flag == "-j" else (just, value)
    suffix = words[0]

    def work(chunks: list[Chunk]) -> list[Chunk]:
        shown, hidden = [c for c in chunks if c.visible], [c for c in chunks if not c.visible]
        if not shown:
            return chunks
        state, count = shown[0], 1
        for i, c in enumerate(shown[1:], 1):
            if just and count >= just:
                break
            names = {temp: state.data, "index": i}
            data = as_bytes(apply_handlers(suffix, c.data, c, **names))
            state, count = replace(state, data=data), count + 1
        rest = shown[count:] if just else []
        return [*hidden, state, *rest]

    return frame.framewise(work)


def _scan(frame: ChunkFrame, call: Call) -> ChunkFrame:
    registers = [w.partition("=")[::2] for w in call.words]

    def work(chunks: list[Chunk]) -> list[Chunk]:
        state: dict[str, Any] = {}
        out = []
        for i, c in enumerate(chunks):
            if not c.visible:
                out.append(c)
                continue
            made_, names = replace(c, meta=dict(c.meta)), c.names() | {"index": i}
            for name, text in registers:
                names = names | {name: state.get(name, names[name] if name in names and name not in state else 0)}
                if text:
                    state[name] = Formula(text)(names)
                elif name not in state:
                    state[name] = names[name]
                names = names | {name: state[name]}
                made_.put(name, state[name])
            out.append(made_)
        return out

    return frame.framewise(work)


def _urn(frame: ChunkFrame, call: Call) -> ChunkFrame:
    flags, rest = _flags(call.words)
    sizes = None
    if rest and "N" not in rest[0]:
        s = as_slice(rest[0], {})
        sizes = (s.start or 0, (s.stop - 1) if s.stop is not None else s.start or 0)
    drawn = frame.urn(sizes, "k" in flags, "s" in flags)
    key = F.col("meta")[f"{frame.depth}:_draw"].cast("string")
    if call.squeeze:
        out = drawn.squeezed(key)
        return out._with(meta=F.map_filter("meta", lambda k, _: ~k.endswith(":_draw")))
    if call.opens:
        out = drawn.opened(F.concat_ws(".", F.lpad(F.split(key, r"\.")[0], 6, "0"), F.lpad(F.split(key, r"\.")[1], 12, "0")), call.opens)
        return out._with(meta=F.map_filter("meta", lambda k, _: ~k.endswith(":_draw")))
    return drawn._with(meta=F.map_filter("meta", lambda k, _: ~k.endswith(":_draw")))


def _sep(default: bytes):
    def run(frame: ChunkFrame, call: Call) -> ChunkFrame:
        flags, rest = _flags([w for w in call.words if len(w) > 1 or w != "-"]) if "-s" in call.words else (set(), list(call.words))
        return frame.separated(as_bytes(Scope(b"", {}).value(rest[0])) if rest else default, "s" in flags)

    return run


def _sorted(frame: ChunkFrame, call: Call) -> ChunkFrame:
    flags, rest = _flags(call.words)
    key = _key(frame, rest)
    if key is not None and rest[0] != "size":
        key = F.struct(key.cast("string").try_cast("double").alias("n"), key.alias("b"))
    return frame.sorted(key, "a" in flags)


def _extreme(largest: bool):
    def run(frame: ChunkFrame, call: Call) -> ChunkFrame:
        key = _key(frame, list(call.words))
        if key is not None and call.words[0] != "size":
            key = F.when(key.isNotNull(), F.struct(key.cast("string").try_cast("double").alias("n"), key.alias("b")))
        return frame.extreme(key, largest)

    return run


def _groupby(frame: ChunkFrame, call: Call) -> ChunkFrame:
    return frame.groupby(call.words[0]) if call.opens else frame


def _group(frame: ChunkFrame, call: Call) -> ChunkFrame:
    return frame.group(int(call.words[0])) if call.opens else frame


def _literals(words: Iterable[str]) -> list[bytes]:
    return [as_bytes(Scope(b"", {}).value(w)) for w in words]


FRAMES: dict[str, Callable[[ChunkFrame, Call], ChunkFrame]] = {
    "pick": lambda f, c: f.pick(*_slices(list(c.words))), "p1": lambda f, c: f.pick(slice(0, 1)), "p2": lambda f, c: f.pick(slice(0, 2)), "p3": lambda f, c: f.pick(slice(0, 3)), "b2f": lambda f, c: f.backwards(),
    "scope": lambda f, c: f.scoped(*_slices([w for w in c.words if w != "-n"]), visible="-n" not in c.words), "sorted": _sorted, "max": _extreme(True), "min": _extreme(False), "dedup": lambda f, c: f.dedup(_key(f, _flags(c.words)[1]), "c" in _flags(c.words)[0]),
    "group": _group, "groupby": _groupby, "jamv": lambda f, c: f.joined_as_variables(c.words[0], _literals(c.words[1:2])[0] if len(c.words) > 1 else b""), "pop": _pop, "push": lambda f, c: f.pushed(_literals(c.words)[0] if c.words else None), "qf": lambda f, c: f.queued(_literals(c.words), True), "qb": lambda f, c: f.queued(_literals(c.words), False),
    "reduce": _reduce, "scan": _scan, "sep": _sep(b"\n"), "sbs": _sep(b" "), "sbc": _sep(b","), "transpose": lambda f, c: f.transposed(_literals(c.words)[0] if c.words else b""), "urn": _urn, "xfcc": lambda f, c: f.counted_across(next((w for w in c.words if w != "-r"), "count"), "-r" in c.words),
}


def _tcp(frame: ChunkFrame, call: Call) -> ChunkFrame:
    """Streams of each direction from the packets of a frame, or of all chunks where there is none."""
    from millrace.functions.formats import reassembled

    flags, _ = _flags(call.words)

    def work(chunks: list[Chunk]) -> list[Chunk]:
        shown = [c for c in chunks if c.visible]
        if not shown:
            return chunks
        out = [c for c in chunks if not c.visible]
        for i, (src, dst, body, first) in enumerate(reassembled([c.data for c in shown])):
            if ("c" in flags and not first) or ("s" in flags and first):
                continue
            made_ = replace(shown[0], data=body, ord=[*shown[0].ord, i], meta=dict(shown[0].meta))
            for k, v in (("src", src), ("dst", dst), ("client", int(first))):
                made_.put(k, v)
            out.append(made_)
        return out

    return frame.framewise(work)


FRAMES["tcp"] = _tcp
#: Frame steps that open frames on their own.
_OWN_LAYER = {"group", "groupby"}


class Pipeline:
    """A compiled pipeline; ``run`` gives a :class:`ChunkFrame`, ``pipeline(data)`` the output's bytes."""

    def __init__(self, spark: SparkSession, calls: list[Call]):
        self.spark, self.calls = spark, calls

    def __or__(self, other: Pipeline | str) -> Pipeline:
        return Pipeline(self.spark, self.calls + (parse(other) if isinstance(other, str) else other.calls))

    def then(self, name: str, *words: Any, opens: int = 0, closes: int = 0, squeeze: bool = False) -> Pipeline:
        """One more unit, in code."""
        return Pipeline(self.spark, [*self.calls, Call(name, tuple(map(str, words)), opens, closes, squeeze)])

    def run(self, source: ChunkFrame | DataFrame | bytes | list[bytes] | None = None) -> ChunkFrame:
        frame = source if isinstance(source, ChunkFrame) else ChunkFrame.of(self.spark, [source] if isinstance(source, bytes) else list(source or [b""]))
        waiting: list[Call] = []
        for call in self.calls:
            if call.name in ("ef", "dump", "d2p"):
                frame = self._files(self._flush(frame, waiting), call)
                waiting = []
                continue
            plain = call.name not in FRAMES and call.name != "emit"
            if plain and call.name not in UNITS and call.name not in STEPS:
                raise ValueError(f"no unit is called {call.name}")
            if plain:
                if any("index" in w for w in call.words) and frame.depth:
                    frame, waiting = self._flush(frame, waiting).indexed(), []
                waiting.append(call)
                if call.opens or call.closes or call.squeeze:
                    frame, waiting = self._flush(frame, waiting[:-1]), []
                    frame = self._framed(frame, call, lambda f, c=call: self._flush(f, [c]))
                continue
            frame, waiting = self._flush(frame, waiting), []
            work = (lambda f, c=call: self._emitted(f, c)) if call.name == "emit" else (lambda f, c=call: FRAMES[c.name](f, c))
            frame = self._framed(frame, call, work)
        return self._flush(frame, waiting)

    def _files(self, frame: ChunkFrame, call: Call) -> ChunkFrame:
        """ef reads the files of a pattern, dump and d2p write the chunks to a folder by their names and pass them on."""
        from millrace import sources

        words = [w for w in call.words if not w.startswith("-")]
        if call.name == "ef":
            folder, _, pattern = words[0].rpartition("/")
            out = sources.read_files(self.spark, folder or ".", pattern or None, "**" in words[0])
            return out.opened(F.lit(""), call.opens) if call.opens else out
        template = "{path}" if call.name == "d2p" else words[1] if len(words) > 1 else "{index}.bin"
        sources.dump(frame, words[0] if words else ".", template, "-f" in call.words).collect()
        return frame.closed(call.closes) if call.closes else frame

    def _emitted(self, frame: ChunkFrame, call: Call) -> ChunkFrame:
        texts = call.words or ("",)

        def step(chunk: Chunk) -> list[Chunk]:
            return [replace(chunk, data=as_bytes(scope_of(chunk).value(w)), ord=[*chunk.ord, i], meta=dict(chunk.meta)) for i, w in enumerate(texts)]

        return frame.each(step)

    def _framed(self, frame: ChunkFrame, call: Call, work: Callable[[ChunkFrame], ChunkFrame]) -> ChunkFrame:
        if call.name == "urn":
            out = work(frame)
            return out.closed(call.closes) if call.closes else out
        if call.name in _OWN_LAYER:
            out = work(frame)
            extra = call.opens - 1
            return (out.opened(F.lit("0"), extra) if extra > 0 else out).closed(call.closes) if call.closes else out
        if not (call.opens or call.squeeze) or call.name in FRAMES and call.name not in ("push",):
            out = work(frame)
            out = out.opened(F.concat_ws(".", F.transform("ord", lambda x: F.lpad(x.cast("string"), 12, "0"))), call.opens) if call.opens else out
            return out.closed(call.closes) if call.closes else out
        # the parent's order, which each output extends by one place, names the frame
        out = work(frame)
        parent = F.slice("ord", 1, F.size("ord") - 1)
        name = F.concat_ws(".", F.transform(parent, lambda x: F.lpad(x.cast("string"), 12, "0")))
        out = out.squeezed(parent) if call.squeeze else out.opened(name, call.opens)
        return out.closed(call.closes) if call.closes else out

    def _flush(self, frame: ChunkFrame, calls: list[Call]) -> ChunkFrame:
        """The waiting steps on single chunks, as column expressions if each has one, else in one pass."""
        if not calls:
            return frame
        column = self._native(calls)
        if column is not None:
            return frame._with(data=F.when(F.col("visible"), column).otherwise(F.col("data")))
        return frame.each(*[STEPS[c.name](c) if c.name in STEPS else unit_step(c) for c in calls])

    @staticmethod
    def _native(calls: list[Call]):
        column = F.col("data")
        for call in calls:
            unit = UNITS.get(call.name)
            if call.name in STEPS or unit is None or unit.many or call.flags or call.opens or call.squeeze:
                return None
            back = reversed_(list(call.words))
            build = unit.native_back if back else unit.native
            if build is None:
                return None
            try:
                kw = bind(unit, list(call.words), Scope(b"", {}), back)
            except Exception:  # noqa: BLE001  arguments that need a chunk
                return None
            column = build(column, **kw)
            if column is None:
                return None
        return column

    def __call__(self, data: bytes | None = None) -> bytes:
        """All output: chunks of a pipeline that ends outside of frames are lines."""
        return (b"\n" if self._breaks() else b"").join(self.run(data).collect())

    def _breaks(self) -> bool:
        """Whether chunks are set apart by line breaks: where more frames end than there are, or there were none."""
        depth, breaks = 0, False
        for c in self.calls:
            before = depth
            depth += c.opens - c.closes
            breaks = depth < 0 if before or c.opens else True
            depth = max(depth, 0)
        return breaks

    def chunks(self, data: bytes | list[bytes] | None = None) -> list[bytes]:
        return self.run(data).collect()

    def distinct(self, data: bytes | list[bytes] | None = None) -> set[bytes]:
        """The set of chunks; equal ones are put together before they reach the driver."""
        return {bytes(r["data"]) for r in self.run(data).df.select("data").distinct().collect()}

    def by(self, name: str, data: bytes | list[bytes] | None = None) -> dict[bytes, list[bytes]]:
        """Lists of chunks by a variable, in their order."""
        parts = F.sort_array(F.collect_list(F.struct("ord", "data")))
        rows = self.run(data).table(name).groupBy(name).agg(parts.alias("parts")).collect()
        return {bytes(r[name]): [bytes(p["data"]) for p in r["parts"]] for r in rows if r[name] is not None}


def load_pipeline(spark: SparkSession, text: str) -> Pipeline:
    return Pipeline(spark, parse(text))
