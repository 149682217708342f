"""Command-line words to the keyword arguments of units."""

from __future__ import annotations

from typing import Any

from millrace.functions.registry import Arg, Unit
from millrace.plans.multibin import Scope, as_bytes, as_numbers, as_slice, number

#: Options that every unit has.
COMMON = {"-R", "-L", "-Q", "-T", "-F", "-FF", "-v"}


def convert(arg: Arg, word: str, scope: Scope) -> Any:
    if arg.kind == "int":
        return number(word, scope)
    if arg.kind == "slice":
        return as_slice(word, scope.names)
    if arg.kind in ("str", "regex"):
        value = scope.value(word) if arg.kind == "regex" else word
        return value.decode("latin-1") if isinstance(value, bytes) and arg.kind == "str" else value
    if arg.kind == "alphabet":
        return int(word) if word.isdigit() else as_bytes(scope.value(word))
    if arg.kind == "key":
        try:
            return number(word, scope) if word[:1].isdigit() or word[:1] == "-" else _key(scope.value(word))
        except (ValueError, SyntaxError, NameError):
            return _key(scope.value(word))
    return as_bytes(scope.value(word))


def _key(value: Any) -> Any:
    return value if isinstance(value, (bytes, int)) else as_numbers(value)


def named(arg: Arg) -> str:
    """The keyword of a parameter; ``data`` is taken by the input."""
    return "data_" if arg.name == "data" else arg.name


def bind(unit: Unit, words: list[str], scope: Scope, reverse: bool = False) -> dict[str, Any]:
    """Switches may be joined (-kt), an option takes the rest of its word or the next one; other words are positional."""
    letters = {a.letter: a for a in unit.args if a.letter}
    kw: dict[str, Any] = {}
    rest: list[str] = []
    words = [w for w in words if w not in COMMON]
    at = 0
    while at < len(words):
        word = words[at]
        at += 1
        if len(word) > 1 and word[0] == "-" and word[1] in {*letters, "R"} and not word[1].isdigit():
            i = 1
            while i < len(word):
                if word[i] == "R" and "R" not in letters:
                    i += 1
                    continue
                arg = letters.get(word[i])
                if arg is None:
                    raise ValueError(f"{unit.name}: unknown option -{word[i]}")
                if arg.kind == "bool":
                    kw[named(arg)] = True
                    i += 1
                    continue
                value = word[i + 1 :].removeprefix("=")
                if not value:
                    value, at = words[at], at + 1
                kw[named(arg)] = convert(arg, value, scope)
                break
        else:
            rest.append(word)
    for arg in (a for a in unit.args if not a.letter):
        if arg.many:
            kw[named(arg)] = tuple(convert(arg, w, scope) for w in rest)
            rest = []
        elif rest:
            kw[named(arg)] = convert(arg, rest.pop(0), scope)
        elif arg.required:
            raise ValueError(f"{unit.name}: {arg.name} is missing")
        elif arg.default is not None:
            kw[named(arg)] = arg.default
    if rest:
        raise ValueError(f"{unit.name}: too many arguments")
    return kw


def reversed_(words: list[str]) -> bool:
    return any(w == "-R" or (len(w) > 1 and w[0] == "-" and w[1:].isalpha() and w[1] == "R") for w in words)
