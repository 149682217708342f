"""Arithmetic on the blocks of a chunk, by numpy where a block is a machine word."""

from __future__ import annotations

import ast
import operator
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.functions.registry import unit
from millrace.functions.strings import latin, unlatin

_BLOCK = "-E:bigendian -B:blocksize:int=1"


def blocks(data: bytes, size: int, big: bool) -> tuple[np.ndarray, int]:
    """The blocks as unsigned integers (Python ones beyond 8 bytes), the last one filled with zeros, and the length of the input."""
    n = len(data)
    data = data + bytes(-n % size)
    if size in (1, 2, 4, 8):
        return np.frombuffer(data, f"{'>' if big else '<'}u{size}").astype(f"u{size}"), n
    order = "big" if big else "little"
    return np.array([int.from_bytes(data[i : i + size], order) for i in range(0, len(data), size)], object), n


def unblocks(values: np.ndarray, size: int, big: bool, n: int) -> bytes:
    if size in (1, 2, 4, 8):
        return values.astype(f"{'>' if big else '<'}u{size}").tobytes()[:n]
    order = "big" if big else "little"
    return b"".join(int(v).to_bytes(size, order) for v in values)[:n]


def keys_for(argument, count: int, size: int) -> np.ndarray:
    """The argument repeated over the blocks: a number, a byte string (as numbers of its bytes) or a list."""
    mask = (1 << (8 * size)) - 1
    if isinstance(argument, (bytes, bytearray)):
        argument = list(argument)
    if isinstance(argument, int):
        argument = [argument]
    if not argument:
        argument = [0]
    kind = f"u{size}" if size in (1, 2, 4, 8) else object
    key = np.array([int(a) & mask for a in argument], kind)
    return np.resize(key, count)


def _binary(name, text, work, wide=True):
    @unit(name, f"argument:key {_BLOCK}")
    def run(data, argument=0, bigendian=False, blocksize=1):
        size = blocksize or 1
        if isinstance(argument, (bytes, bytearray)) and size > 1:
            argument, _ = blocks(argument, size, bigendian)
            argument = argument.tolist()
        values, n = blocks(data, size, bigendian)
        if not len(values):
            return b""
        key = keys_for(argument, len(values), size)
        with np.errstate(over="ignore"):
            out = work(values, key, size * 8)
        if values.dtype == object:
            out = np.array([int(v) & ((1 << size * 8) - 1) for v in out], object)
        return unblocks(out, size, bigendian, n)

    run.text = text
    return run


add = _binary("add", "Adds to each block.", lambda v, k, bits: v + k)
sub = _binary("sub", "Subtracts from each block.", lambda v, k, bits: v - k)
xor = _binary("xor", "Exclusive or of each block.", lambda v, k, bits: v ^ k)


def _shift(values, by, bits, left):
    by = by.astype(object) if values.dtype == object else by
    big = by >= bits
    amount = np.where(big, 0, by) if values.dtype != object else np.array([0 if b >= bits else b for b in by], object)
    out = values << amount if left else values >> amount
    return np.where(big, np.zeros_like(values), out) if values.dtype != object else np.array([0 if b else o for b, o in zip(big, out, strict=True)], object)


def _rotate(values, by, bits, left):
    by = by % bits
    back = (bits - by) % bits
    mask = (1 << bits) - 1
    if values.dtype == object:
        return np.array([(int(v) << int(b) | int(v) >> int(c)) & mask if left else (int(v) >> int(b) | int(v) << int(c)) & mask for v, b, c in zip(values, by, back, strict=True)], object)
    by, back = by.astype(values.dtype), back.astype(values.dtype)
    return (values << by) | (values >> back) if left else (values >> by) | (values << back)


_binary("shl", "Shifts bits to the left.", lambda v, k, bits: _shift(v, k, bits, True))
_binary("shr", "Shifts bits to the right.", lambda v, k, bits: _shift(v, k, bits, False))
_binary("rotl", "Rotates bits to the left.", lambda v, k, bits: _rotate(v, k, bits, True))
_binary("rotr", "Rotates bits to the right.", lambda v, k, bits: _rotate(v, k, bits, False))


@unit("neg", _BLOCK)
def neg(data, bigendian=False, blocksize=1):
    """All bits inverted."""
    return (~np.frombuffer(data, np.uint8)).tobytes()


@unit("bitrev", _BLOCK)
def bitrev(data, bigendian=False, blocksize=1):
    """The bits of each block in reverse."""
    size = blocksize or 1
    padded = np.frombuffer(data + bytes(-len(data) % size), np.uint8).reshape(-1, size)
    bits = np.unpackbits(padded, axis=1, bitorder="big" if bigendian or size == 1 else "little")
    return np.packbits(bits[:, ::-1], axis=1, bitorder="big" if bigendian or size == 1 else "little").tobytes()[: len(data)]


@unit("bitsnip", f"*slices:slice {_BLOCK}")
def bitsnip(data, slices=(), bigendian=False, blocksize=1):
    """Bits of each block, counted from the lowest, packed one after the other."""
    size = blocksize or 1
    values = [int.from_bytes(data[i : i + size], "big" if bigendian else "little") for i in range(0, len(data), size)]
    picked = [i for s in (slices or [slice(0, 1)]) for i in range(*s.indices(size * 8))]
    out = np.array([[v >> i & 1 for i in picked] for v in values], np.uint8).reshape(-1)
    return np.packbits(out, bitorder="little").tobytes()


@unit("byteswap", "size:int=4")
def byteswap(data, size=4):
    """Reverses the bytes of each block; a shorter rest goes."""
    size = size or 4
    return np.frombuffer(data[: len(data) // size * size], np.uint8).reshape(-1, size)[:, ::-1].tobytes()


@unit("rev", "-B:blocksize:int=1")
def rev(data, blocksize=1):
    """The blocks in reverse order."""
    size = blocksize or 1
    if size == 1:
        return data[::-1]
    data = data + bytes(-len(data) % size)
    return b"".join(data[i : i + size] for i in range(len(data) - size, -1, -size))


rev.column(lambda c, blocksize=1: unlatin(F.reverse(latin(c))) if (blocksize or 1) == 1 else None)


@unit("map", "index image default? -B:blocksize:int=1")
def map_(data, index, image, default=None, blocksize=1):
    """Replaces blocks by others; a default takes the place of blocks that are not listed."""
    size = blocksize or 1
    cut = lambda x: [x[i : i + size] for i in range(0, len(x), size)]
    table = dict(zip(cut(index), cut(image), strict=True))
    if not default:
        return b"".join(table.get(b, b) for b in cut(data))
    spare, out, n = cut(default), [], 0
    for b in cut(data):
        if b in table:
            out.append(table[b])
        else:
            out.append(spare[n % len(spare)])
            n += 1
    return b"".join(out)


@map_.reverse
def _(data, index, image, default=None, blocksize=1):
    return map_.forward(data, image, index, default, blocksize)


map_.column(lambda c, index, image, default=None, blocksize=1: unlatin(F.translate(latin(c), index.decode("latin-1"), image.decode("latin-1"))) if (blocksize or 1) == 1 and not default and len(index) == len(image) else None)
_NUMBER = re.compile(rb"[-+]?(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|[0-9][0-9a-zA-Z]*)")


@unit("pack", f"base:int=0 -w:width:int=0 -s:strict -r:prefix -F:single_floats -D:double_floats {_BLOCK}")
def pack(data, base=0, width=0, strict=False, prefix=False, single_floats=False, double_floats=False, bigendian=False, blocksize=1):
    """Numbers in a text as blocks."""
    order = "big" if bigendian else "little"
    if single_floats or double_floats:
        found = re.findall(rb"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?", data)
        return np.array([float(x) for x in found], f"{'>' if bigendian else '<'}f{4 if single_floats else 8}").tobytes()
    bits, out = 8 * (blocksize or 1), bytearray()
    for found in _NUMBER.findall(data):
        try:
            value = int(found, base or 0) if base or not found.lstrip(b"+-").startswith(b"0") or found.lstrip(b"+-")[1:2].lower() in b"xbo" else int(found, 10)
        except ValueError:
            continue
        if strict and not -(1 << bits - 1) <= value < 1 << bits:
            continue
        out += (value & (1 << bits) - 1).to_bytes(bits // 8, order)
    return bytes(out)


@pack.reverse
def _(data, base=0, width=0, strict=False, prefix=False, single_floats=False, double_floats=False, bigendian=False, blocksize=1):
    if single_floats or double_floats:
        return [repr(float(x)).encode() for x in np.frombuffer(data, f"{'>' if bigendian else '<'}f{4 if single_floats else 8}")]
    values, _ = blocks(data, blocksize or 1, bigendian)
    return [(_prefix(base) if prefix else b"") + digits(int(v), base or 10).rjust(width, b"0") for v in values]


def _prefix(base):
    return {2: b"0b", 8: b"0o", 16: b"0x"}.get(base, b"")


def digits(value: int, base: int) -> bytes:
    letters = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    out = bytearray()
    while value:
        value, r = divmod(value, base)
        out.append(letters[r])
    return bytes(out[::-1]) or b"0"


@unit("terminate", f"sentinel? {_BLOCK}")
def terminate(data, sentinel=b"\0", bigendian=False, blocksize=1):
    """What stands before a sentinel at a block's boundary."""
    sentinel, at = sentinel or b"\0", -1
    while (at := data.find(sentinel, at + 1)) >= 0:
        if at % (blocksize or 1) == 0:
            return data[:at]
    return data


@terminate.reverse
def _(data, sentinel=b"\0", bigendian=False, blocksize=1):
    return data + (sentinel or b"\0")


_OPS = {
    ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Div: operator.floordiv, ast.Mod: operator.mod, ast.BitXor: operator.xor, ast.MatMult: operator.xor, ast.BitAnd: operator.and_, ast.BitOr: operator.or_, ast.LShift: operator.lshift, ast.RShift: operator.rshift,
    ast.Pow: operator.pow,
}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b}
_CALLS = {"len": len, "min": min, "max": max, "abs": abs}


class Formula:
    """An arithmetic expression over variables, from a white list of syntax; nothing else of Python is evaluated."""

    def __init__(self, text: str):
        self.text = text
        self.tree = ast.parse(text.strip(), mode="eval").body

    def __call__(self, names: dict, mask: int | None = None):
        def go(node):
            if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bytes)):
                return node.value.encode() if isinstance(node.value, str) else node.value
            if isinstance(node, ast.Name):
                if node.id not in names:
                    raise NameError(node.id)
                return names[node.id]
            if isinstance(node, ast.BinOp):
                out = _OPS[type(node.op)](go(node.left), go(node.right))
            elif isinstance(node, ast.UnaryOp):
                v = go(node.operand)
                out = -v if isinstance(node.op, ast.USub) else ~v if isinstance(node.op, ast.Invert) else (not v) if isinstance(node.op, ast.Not) else v
            elif isinstance(node, ast.BoolOp):
                out = None
                for part in node.values:
                    out = go(part)
                    if bool(out) == isinstance(node.op, ast.Or):
                        break
                return out
            elif isinstance(node, ast.Compare):
                left = go(node.left)
                for op, right in zip(node.ops, node.comparators, strict=True):
                    value = go(right)
                    if isinstance(left, (bytes, int)) and isinstance(value, (bytes, int)) and type(left) is not type(value) and not isinstance(op, (ast.In, ast.NotIn)):
                        left, value = _alike(left, value)
                    if not _COMPARE[type(op)](left, value):
                        return False
                    left = value
                return True
            elif isinstance(node, ast.IfExp):
                return go(node.body) if go(node.test) else go(node.orelse)
            elif isinstance(node, ast.Subscript):
                at = node.slice
                key = slice(*(None if x is None else go(x) for x in (at.lower, at.upper, at.step))) if isinstance(at, ast.Slice) else go(at)
                return go(node.value)[key]
            elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
                f = names.get(node.func.id) if callable(names.get(node.func.id)) else _CALLS.get(node.func.id)
                if f is None:
                    raise NameError(node.func.id)
                out = f(*map(go, node.args))
            else:
                raise SyntaxError(f"not allowed here: {ast.dump(node)[:60]}")
            return out & mask if mask is not None and isinstance(out, int) and not isinstance(out, bool) else out

        return go(self.tree)


def _alike(a, b):
    """A number and a byte string: both as numbers if the string is one."""
    try:
        return (int(a), b) if isinstance(a, bytes) else (a, int(b))
    except ValueError:
        return (a, str(b).encode()) if isinstance(a, bytes) else (str(a).encode(), b)


@unit("alu", f"operator:str *argument:key -S:seed:int=0 -N:skip:int=0 -p:prologue:str -e:epilogue:str -I:inc -D:dec -X:cbc -C:ctr -P:precision:int {_BLOCK}")
def alu(data, operator, argument=(), seed=0, skip=0, prologue=None, epilogue=None, inc=False, dec=False, cbc=False, ctr=False, precision=None, bigendian=False, blocksize=1):
    """A formula over each block B with its index K, the arguments A and V, the state S and N, the number of blocks."""
    size = blocksize or 1
    bits = precision or size * 8
    mask = (1 << bits) - 1
    start = Formula(prologue) if prologue else None
    end = Formula(epilogue or ("(S+1)" if inc else "(S-1)" if dec else "B" if cbc else "E" if ctr else "S"))
    work = Formula(operator)
    values, n = blocks(data, size, bigendian)
    given = [list(a) if isinstance(a, (bytes, list, tuple)) else [a] for a in argument]
    state, out = seed, []
    names = {"N": len(values), "S": state, "R": lambda x, k: (x >> k | x << bits - k) & mask, "L": lambda x, k: (x << k | x >> bits - k) & mask, "X": lambda x: ~x & mask, "M": lambda x, k: x & (1 << k) - 1, "I": lambda x: x - (1 << bits) if x >> bits - 1 else x, "U": lambda x: x & mask}
    for _ in range(skip):
        names |= {"K": 0, "B": 0, "E": 0, "A": 0, "V": []}
        names["S"] = start(names, mask) if start else names["S"]
        names["S"] = end(names, mask)
    for k, block in enumerate(values.tolist()):
        v = [g[k % len(g)] for g in given if g]
        names |= {"K": k, "B": int(block), "E": int(block), "V": v, "A": v[0] if v else 0}
        if start:
            names["S"] = start(names, mask)
        names["B"] = work(names, mask)
        out.append(names["B"] & (1 << size * 8) - 1)
        names["S"] = end(names, mask)
    kind = values.dtype
    return unblocks(np.array(out, kind), size, bigendian, n)
