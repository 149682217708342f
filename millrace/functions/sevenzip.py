"""7z archives: copied, LZMA, LZMA2, deflate and BZip2 members, with delta and branch filters."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

from millrace.functions.formats import LIMIT, paths_unit
from millrace.functions.registry import unit


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("the header ends too early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        """The leading ones of the first byte tell how many more follow."""
        first, value, mask = self.byte(), 0, 0x80
        for i in range(8):
            if not first & mask:
                return value | (first & mask - 1) << 8 * i
            value |= self.byte() << 8 * i
            mask >>= 1
        return value

    def bits(self, n: int) -> list[bool]:
        raw = self.take((n + 7) // 8)
        return [bool(raw[i // 8] >> 7 - i % 8 & 1) for i in range(n)]

    def digests(self, n: int) -> None:
        known = [True] * n if self.byte() else self.bits(n)
        self.take(4 * sum(known))


def decoded(coder: tuple[bytes, bytes], data: bytes, size: int) -> bytes:
    kind, props = coder
    if size > LIMIT:
        raise ValueError("a member is too large")
    if kind == b"\0":
        return data[:size]
    if kind == b"\4\1\x08":
        return zlib.decompressobj(-15).decompress(data, size)
    if kind == b"\4\2\2":
        return bz2.decompress(data)
    if kind == b"\3\1\1":
        p, window = props[0], struct.unpack_from("<I", props, 1)[0]
        filters = [{"id": lzma.FILTER_LZMA1, "lc": p % 9, "lp": p // 9 % 5, "pb": p // 45, "dict_size": max(window, 4096)}]
    elif kind == b"\x21":
        filters = [{"id": lzma.FILTER_LZMA2, "dict_size": min((2 | props[0] & 1) << props[0] // 2 + 11, (1 << 32) - 1)}]
    elif kind == b"\3":
        out, step = bytearray(data), props[0] + 1
        for i in range(step, len(out)):
            out[i] = out[i] + out[i - step] & 255
        return bytes(out)
    elif kind == b"\3\3\1\3":
        return unfiltered(data)
    else:
        raise ValueError(f"the method {kind.hex()} is not supported")
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=filters).decompress(data, size)


def unfiltered(data: bytes) -> bytes:
    """The branch filter for x86, through the codec that has it."""
    packed = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 0}])
    return lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, {"id": lzma.FILTER_LZMA2, "preset": 0}]).decompress(packed)


def streams(r: Reader) -> dict:
    """Places and sizes of packed streams, folders with their coders, and sizes of the files in them."""
    out: dict = {"pos": 0, "packs": [], "folders": [], "counts": None, "sizes": None}
    while kind := r.byte():
        if kind == 6:
            out["pos"], n = r.number(), r.number()
            while part := r.byte():
                if part == 9:
                    out["packs"] = [r.number() for _ in range(n)]
                else:
                    r.digests(n)
        elif kind == 7:
            if r.byte() != 11:
                raise ValueError("folders are expected")
            n, _ = r.number(), r.byte()
            for _ in range(n):
                coders, outs, ins = [], 0, 0
                for _ in range(r.number()):
                    flags = r.byte()
                    name, a, b = r.take(flags & 15), 1, 1
                    if flags & 16:
                        a, b = r.number(), r.number()
                    coders.append((name, r.take(r.number()) if flags & 32 else b""))
                    ins, outs = ins + a, outs + b
                binds = [(r.number(), r.number()) for _ in range(outs - 1)]
                packed = [r.number() for _ in range(ins - len(binds))] if ins - len(binds) > 1 else []
                if packed or ins != outs:
                    raise ValueError("branching folders are not supported")
                out["folders"].append({"coders": coders, "outs": outs})
            while part := r.byte():
                if part == 12:
                    for f in out["folders"]:
                        f["sizes"] = [r.number() for _ in range(f["outs"])]
                else:
                    r.digests(n)
        elif kind == 8:
            folders = out["folders"]
            counts = [1] * len(folders)
            sizes: list[list[int]] = []
            part = r.byte()
            if part == 13:
                counts = [r.number() for _ in folders]
                part = r.byte()
            for f, c in zip(folders, counts, strict=True):
                own = [r.number() for _ in range(c - 1)] if part == 9 and c else [0] * max(0, c - 1)
                sizes.append([*own, f["sizes"][0] - sum(own)] if c else [])
            if part == 9:
                part = r.byte()
            while part:
                r.digests(sum(c for f, c in zip(folders, counts, strict=True)))
                part = r.byte()
            out["counts"], out["sizes"] = counts, sizes
    if out["sizes"] is None:
        out["sizes"] = [[f["sizes"][0]] for f in out["folders"]]
    return out


def unpacked(data: bytes, s: dict) -> list[bytes]:
    """The contents of each folder."""
    at, out = 32 + s["pos"], []
    for f, n in zip(s["folders"], s["packs"], strict=False):
        body = data[at : at + n]
        at += n
        for coder, size in zip(f["coders"][::-1], f["sizes"][::-1], strict=True):
            body = decoded(coder, body, size)
        out.append(body)
    return out


@paths_unit("xt7z", "Files of a 7z archive without a password.", lambda d: d[:6] == b"7z\xbc\xaf\x27\x1c")
def xt7z(data):
    offset, size = struct.unpack_from("<QQ", data, 12)
    r = Reader(data[32 + offset : 32 + offset + size])
    if not r.data:
        return []
    kind = r.byte()
    while kind == 0x17:
        r = Reader(unpacked(data, streams(r))[0])
        kind = r.byte()
    found, names, empty = {"folders": [], "packs": [], "sizes": [], "pos": 0}, [], []
    while kind := r.byte():
        if kind == 4:
            found = streams(r)
        elif kind == 5:
            n = r.number()
            while prop := r.byte():
                part = Reader(r.take(r.number()))
                if prop == 14:
                    empty = part.bits(n)
                elif prop == 17:
                    part.byte()
                    names = part.data[part.at :].decode("utf-16le").split("\0")[:n]
        else:
            raise ValueError("an unknown part of the header")
    pieces = []
    for body, sizes in zip(unpacked(data, found), found["sizes"], strict=True):
        at = 0
        for n in sizes:
            pieces.append(body[at : at + n])
            at += n
    parts = iter(pieces)
    return [(name, b"" if i < len(empty) and empty[i] else next(parts), {}) for i, name in enumerate(names)]


@unit("xtrtf", "", many=True)
def xtrtf(data):
    """Objects embedded in RTF documents: their data in hexadecimal, after the class name."""
    import re

    for m in re.finditer(rb"\\objdata\b([^\\{}]*(?:\\[^\\{}]*|\{[^{}]*\}[^\\{}]*)*)", data):
        digits = re.sub(rb"\\\w+-?\d*\s?|[^0-9a-fA-F]", b"", m[1])
        raw = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        if len(raw) < 12:
            continue
        n = struct.unpack_from("<I", raw, 8)[0]
        name = raw[12 : 12 + n].rstrip(b"\0")
        at = 12 + n
        for _ in range(2):
            if at + 4 <= len(raw):
                at += 4 + struct.unpack_from("<I", raw, at)[0]
        size = struct.unpack_from("<I", raw, at)[0] if at + 4 <= len(raw) else 0
        yield raw[at + 4 : at + 4 + size] if size else raw, {"name": name, "offset": m.start()}


@paths_unit("dnsfx", "Files of a .NET single-file program.")
def dnsfx(data):
    mark = bytes.fromhex("8b1202b96a612038727b930214d7a03213f5b9e6efae3318ee3b2dce24b36aae")
    at = data.find(mark)
    if at < 8:
        raise ValueError("no bundle")
    r = Reader(data)
    r.at = struct.unpack_from("<Q", data, at - 8)[0]
    major, _, count = struct.unpack("<III", r.take(12))

    def text() -> str:
        n = shift = 0
        while True:
            b = r.byte()
            n |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                return r.take(n).decode("utf-8", "replace")

    text()
    if major >= 2:
        r.take(40)
    out = []
    for _ in range(count):
        offset, size = struct.unpack("<QQ", r.take(16))
        packed = struct.unpack("<Q", r.take(8))[0] if major >= 6 else 0
        r.byte()
        name = text()
        body = data[offset : offset + (packed or size)]
        out.append((name, zlib.decompressobj(-15).decompress(body, LIMIT) if packed else body, {}))
    return out
