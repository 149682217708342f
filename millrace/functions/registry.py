"""The registry of chunk functions.

A unit turns the bytes of one chunk into bytes, or into any number of chunks with variables. Where it has a Column form, pipelines of
such units stay expressions of the plan; all others run together in one pass over Arrow batches, however many follow each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

#: What a function may give for a chunk: bytes, or bytes with variables.
Made = bytes | tuple[bytes, dict[str, Any]]


@dataclass(frozen=True)
class Arg:
    """A parameter: positional, or a switch or option named by a letter. Kinds: bytes, int, str, slice, bool, regex, expr."""

    name: str
    kind: str = "bytes"
    letter: str = ""
    default: Any = None
    required: bool = False
    many: bool = False


@dataclass
class Unit:
    name: str
    forward: Callable[..., bytes | Iterable[Made]]
    args: tuple[Arg, ...] = ()
    backward: Callable[..., bytes | Iterable[Made]] | None = None
    many: bool = False
    native: Callable[..., Any] | None = None
    native_back: Callable[..., Any] | None = None
    accepts: Callable[[bytes], bool | None] | None = None
    text: str = ""
    tags: set[str] = field(default_factory=set)

    def reverse(self, f):
        self.backward = f
        return self

    def column(self, f):
        self.native = f
        return self

    def column_back(self, f):
        self.native_back = f
        return self

    def check(self, f):
        self.accepts = f
        return self

    def __call__(self, data: bytes, **kw) -> list[tuple[bytes, dict[str, Any]]]:
        return made(self.forward(data, **kw))

    def one(self, data: bytes, **kw) -> bytes:
        """The outputs joined; for units that give one."""
        return b"".join(x for x, _ in self(data, **kw))

    def undo(self, data: bytes, **kw) -> bytes:
        if self.backward is None:
            raise NotImplementedError(f"{self.name} has no reverse")
        return b"".join(x for x, _ in made(self.backward(data, **kw)))


def made(result) -> list[tuple[bytes, dict[str, Any]]]:
    if result is None:
        return []
    if isinstance(result, (bytes, bytearray, memoryview)):
        return [(bytes(result), {})]
    return [(bytes(x[0]), x[1]) if isinstance(x, tuple) else (bytes(x), {}) for x in result]


UNITS: dict[str, Unit] = {}


def parsed_args(spec: str) -> tuple[Arg, ...]:
    """From "size:int step:int? -t:truncate -n:count:int=3 *rest:bytes": a question mark makes a positional one optional, -x a switch or option, * takes all that are left."""
    out = []
    for item in spec.split():
        item, _, default = item.partition("=")
        many, optional = item.startswith("*"), item.endswith("?")
        item = item.strip("*?")
        letter = ""
        if item.startswith("-"):
            letter, item = item[1:].split(":", 1)
            name, _, kind = item.partition(":")
            kind = kind or "bool"
        else:
            name, _, kind = item.partition(":")
            kind = kind or "bytes"
        value: Any = None
        if kind == "bool":
            value = False
        elif default:
            value = int(default, 0) if kind == "int" else default.encode() if kind == "bytes" else default
        out.append(Arg(name, kind, letter, value, not (letter or optional or many or default), many))
    return tuple(out)


def unit(name: str, spec: str = "", many: bool = False, **kw):
    """Registers a function under a name."""

    def add(f) -> Unit:
        UNITS[name] = made_unit = Unit(name, f, parsed_args(spec), many=many, text=(f.__doc__ or "").strip(), **kw)
        return made_unit

    return add
