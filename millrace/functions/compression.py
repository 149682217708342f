"""Compression codecs; the forward direction decompresses, the reverse one compresses where there is one."""

from __future__ import annotations

import bz2 as bz2lib
import lzma as lzmalib
import struct
import zlib

from millrace.functions.registry import UNITS, unit

#: No output grows beyond this many bytes.
LIMIT = 1 << 30


class Out(bytearray):
    """Output that can copy from itself."""

    def again(self, distance: int, length: int) -> None:
        if not 0 < distance <= len(self):
            raise ValueError("a match from before the start")
        if len(self) + length > LIMIT:
            raise ValueError("too much output")
        if distance >= length:
            start = len(self) - distance
            self += self[start : start + length]
        else:
            piece = bytes(self[-distance:])
            self += (piece * (length // distance + 1))[:length]


def matches(data: bytes, least: int, window: int, most: int):
    """Greedy matches by hashes of ``least`` bytes: (position, distance, length), and (position, 0, 1) for a literal."""
    seen: dict[bytes, int] = {}
    at = 0
    while at < len(data):
        key = data[at : at + least]
        found = seen.get(key, -1) if len(key) == least else -1
        n = 0
        if found >= 0 and at - found <= window:
            n = least
            while n < most and at + n < len(data) and data[found + n] == data[at + n]:
                n += 1
        yield (at, at - found, n) if n else (at, 0, 1)
        for i in range(at, min(at + max(n, 1), len(data) - least + 1)):
            seen[data[i : i + least]] = i
        at += max(n, 1)


@unit("zl", "-l:level:int=9 -w:window:int=15 -z:zlib_header -g:gzip_header")
def zl(data, level=9, window=15, zlib_header=False, gzip_header=False):
    """Deflate, raw or with a zlib or gzip header; what a truncated stream holds is kept."""
    tries = [31] if gzip_header else [15] if zlib_header else [31] if data[:2] == b"\x1f\x8b" else [15, -15] if data[:1] and data[0] & 15 == 8 else [-15]
    for i, bits in enumerate(tries):
        z = zlib.decompressobj(bits)
        try:
            return z.decompress(data, LIMIT) + z.flush()
        except zlib.error:
            if i == len(tries) - 1:
                raise


@zl.reverse
def _(data, level=9, window=15, zlib_header=False, gzip_header=False):
    z = zlib.compressobj(level, zlib.DEFLATED, window | 16 if gzip_header else window if zlib_header else -window)
    return z.compress(data) + z.flush()


@unit("bz2", "-l:level:int=9")
def bz2(data, level=9):
    """BZip2."""
    return bz2lib.decompress(data)


bz2.reverse(lambda data, level=9: bz2lib.compress(data, level))
bz2.check(lambda data: data[:3] == b"BZh")


@unit("lzma", "-r:raw -a:alone -x:xz -l:level:int=9 -d:delta:int=0")
def lzma(data, raw=False, alone=False, xz=False, level=9, delta=0):
    """LZMA: XZ, the older format or raw LZMA2."""
    if raw:
        return lzmalib.decompress(data, lzmalib.FORMAT_RAW, filters=_filters(level, delta))
    return lzmalib.decompress(data, lzmalib.FORMAT_ALONE if alone else lzmalib.FORMAT_XZ if xz else lzmalib.FORMAT_AUTO)


def _filters(level, delta):
    return ([{"id": lzmalib.FILTER_DELTA, "dist": delta}] if delta else []) + [{"id": lzmalib.FILTER_LZMA2, "preset": level}]


@lzma.reverse
def _(data, raw=False, alone=False, xz=False, level=9, delta=0):
    if raw:
        return lzmalib.compress(data, lzmalib.FORMAT_RAW, filters=_filters(level, delta))
    if alone:
        return lzmalib.compress(data, lzmalib.FORMAT_ALONE, filters=[{"id": lzmalib.FILTER_LZMA1, "preset": level}])
    return lzmalib.compress(data, lzmalib.FORMAT_XZ, filters=_filters(level, delta))


lzma.check(lambda data: data[:6] == b"\xfd7zXZ\0" or data[:3] == b"]\0\0")


@unit("lzip")
def lzip(data):
    """Members of lzip files."""
    out = b""
    while data[:4] == b"LZIP":
        size = 1 << (data[5] & 31)
        size -= (size >> 4) * (data[5] >> 5)
        d = lzmalib.LZMADecompressor(lzmalib.FORMAT_RAW, filters=[{"id": lzmalib.FILTER_LZMA1, "dict_size": size, "lc": 3, "lp": 0, "pb": 2}])
        out += d.decompress(data[6:])
        rest = d.unused_data
        if not rest:  # the end marker is not always reported: the trailer has the size of the member
            break
        data = rest[20:]
    return out


lzip.check(lambda data: data[:4] == b"LZIP")


@unit("zstd")
def zstd(data):
    """Zstandard."""
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


@zstd.reverse
def _(data):
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


zstd.check(lambda data: data[:4] == b"\x28\xb5\x2f\xfd")


def lz4_block(data: bytes, out: Out | None = None) -> Out:
    out, at, n = Out() if out is None else out, 0, len(data)

    def more(value):
        nonlocal at
        if value == 15:
            while True:
                b = data[at]
                at += 1
                value += b
                if b != 255:
                    break
        return value

    while at < n:
        token = data[at]
        at += 1
        size = more(token >> 4)
        out += data[at : at + size]
        at += size
        if at >= n:
            break
        distance = data[at] | data[at + 1] << 8
        at += 2
        out.again(distance, more(token & 15) + 4)
    return out


@unit("lz4")
def lz4(data):
    """LZ4 blocks and frames."""
    if data[:4] != b"\x04\x22\x4d\x18":
        return bytes(lz4_block(data))
    flags, at, out = data[4], 6, Out()
    at += 8 * (flags >> 3 & 1) + 4 * (flags & 1) + 1
    while size := struct.unpack_from("<I", data, at)[0]:
        body = data[at + 4 : at + 4 + (size & 0x7FFFFFFF)]
        at += 4 + len(body) + 4 * (flags >> 4 & 1)
        if size >> 31:
            out += body
        elif flags >> 5 & 1:
            out += lz4_block(body)
        else:
            lz4_block(body, out)
    return bytes(out)


@unit("lzf", "-f:fast")
def lzf(data, fast=False):
    """LZF."""
    out, at = Out(), 0
    while at < len(data):
        c = data[at]
        at += 1
        if c < 32:
            out += data[at : at + c + 1]
            at += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[at]
            at += 1
        distance = (c & 31) << 8 | data[at]
        at += 1
        out.again(distance + 1, n + 2)
    return bytes(out)


@lzf.reverse
def _(data, fast=False):
    out, held = bytearray(), bytearray()

    def flush():
        for i in range(0, len(held), 32):
            part = held[i : i + 32]
            out.append(len(part) - 1)
            out.extend(part)
        held.clear()

    for at, distance, n in matches(data, 3, 8192, 264):
        if not distance:
            held.append(data[at])
            continue
        flush()
        distance -= 1
        if n - 2 < 7:
            out += bytes(((n - 2) << 5 | distance >> 8, distance & 255))
        else:
            out += bytes((7 << 5 | distance >> 8, n - 9, distance & 255))
    flush()
    return bytes(out)


@unit("lzjb")
def lzjb(data):
    """LZJB."""
    out, at, mask, flags = Out(), 0, 128, 0
    while at < len(data):
        mask <<= 1
        if mask == 256:
            mask, flags = 1, data[at]
            at += 1
            if at >= len(data):
                break
        if flags & mask:
            n = (data[at] >> 2) + 3
            distance = (data[at] << 8 | data[at + 1]) & 1023
            at += 2
            out.again(distance, n)
        else:
            out.append(data[at])
            at += 1
    return bytes(out)


@lzjb.reverse
def _(data):
    out, i, flag_at = bytearray(), 0, 0
    for at, distance, n in matches(data, 3, 1023, 66):
        if i % 8 == 0:
            flag_at = len(out)
            out.append(0)
        if distance:
            out[flag_at] |= 1 << i % 8
            out += bytes(((n - 3) << 2 | distance >> 8, distance & 255))
        else:
            out.append(data[at])
        i += 1
    return bytes(out)


@unit("lznt1", "-c:chunk_size:int=4096")
def lznt1(data, chunk_size=4096):
    """LZNT1."""
    out, at = Out(), 0
    while at + 2 <= len(data) and (head := data[at] | data[at + 1] << 8):
        size = (head & 0xFFF) + 1
        body, at = data[at + 2 : at + 2 + size], at + 2 + size
        if not head >> 15:
            out += body
            continue
        start, i = len(out), 0
        while i < len(body):
            flags = body[i]
            i += 1
            for bit in range(8):
                if i >= len(body):
                    break
                if flags >> bit & 1:
                    pair = body[i] | body[i + 1] << 8
                    i += 2
                    bits = 12
                    while len(out) - start - 1 >> 16 - bits:
                        bits -= 1
                    out.again((pair >> bits) + 1, (pair & (1 << bits) - 1) + 3)
                else:
                    out.append(body[i])
                    i += 1
    return bytes(out)


@lznt1.reverse
def _(data, chunk_size=4096):
    out = bytearray()
    for at in range(0, len(data), chunk_size):
        part = data[at : at + chunk_size]
        body, i, flag_at = bytearray(), 0, 0
        pos = 0
        seen: dict[bytes, int] = {}
        while pos < len(part):
            if i % 8 == 0:
                flag_at = len(body)
                body.append(0)
            bits = 12
            while pos - 1 >> 16 - bits and pos:
                bits -= 1
            key, n = part[pos : pos + 3], 0
            found = seen.get(key, -1)
            if len(key) == 3 and found >= 0 and pos - found <= 1 << 16 - bits:
                n = 3
                while n < (1 << bits) + 2 and pos + n < len(part) and part[found + n] == part[pos + n]:
                    n += 1
            if n:
                body[flag_at] |= 1 << i % 8
                body += struct.pack("<H", (pos - found - 1) << bits | n - 3)
            else:
                body.append(part[pos])
            for j in range(pos, pos + max(n, 1)):
                seen[part[j : j + 3]] = j
            pos += max(n, 1)
            i += 1
        out += struct.pack("<H", 0xB000 | len(body) - 1) + body if len(body) < len(part) else struct.pack("<H", 0x3000 | len(part) - 1) + part
    return bytes(out)


@unit("flz", "level:int=0")
def flz(data, level=0):
    """FastLZ, both levels."""
    out, at, two = Out(), 0, data[:1] and data[0] >> 5 == 1
    first = True
    while at < len(data):
        c = data[at] & 31 if first else data[at]
        first = False
        at += 1
        if c < 32:
            out += data[at : at + c + 1]
            at += c + 1
            continue
        n, distance = (c >> 5) - 1, (c & 31) << 8
        if n == 6:
            while True:
                b = data[at]
                at += 1
                n += b
                if not two or b != 255:
                    break
        low = data[at]
        at += 1
        distance += low
        if two and low == 255 and c & 31 == 31:
            distance = (data[at] << 8 | data[at + 1]) + 8191
            at += 2
        out.again(distance + 1, n + 3)
    return bytes(out)


@flz.reverse
def _(data, level=0):
    out, held = bytearray(), bytearray()

    def flush():
        for i in range(0, len(held), 32):
            part = held[i : i + 32]
            out.append(len(part) - 1)
            out.extend(part)
        held.clear()

    for at, distance, n in matches(data, 3, 8191, 264):
        if not distance or at < 4:
            held += data[at : at + n] if distance else data[at : at + 1]
            continue
        flush()
        distance -= 1
        n -= 2
        out += bytes((n << 5 | distance >> 8, distance & 255)) if n < 7 else bytes((7 << 5 | distance >> 8, n - 7, distance & 255))
    flush()
    return bytes(out)


class Bits:
    """Bits of a stream whose tag bytes stand between its other bytes, highest bit first."""

    def __init__(self, data: bytes, at: int = 0, size: int = 1):
        self.data, self.at, self.size, self.left, self.tag = data, at, size, 0, 0

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def bit(self) -> int:
        if not self.left:
            self.tag = int.from_bytes(self.data[self.at : self.at + self.size], "little")
            self.at += self.size
            self.left = 8 * self.size
        self.left -= 1
        return self.tag >> self.left & 1

    def gamma(self) -> int:
        n = 1
        while True:
            n = n * 2 + self.bit()
            if not self.bit():
                return n


@unit("aplib")
def aplib(data):
    """aPLib, with or without the header."""
    if data[:4] == b"AP32":
        data = data[struct.unpack_from("<I", data, 4)[0] :]
    bits, out = Bits(data), Out()
    out.append(bits.byte())
    last, repeat = 0, False
    while True:
        if not bits.bit():
            out.append(bits.byte())
            repeat = False
        elif not bits.bit():
            high = bits.gamma()
            if not repeat and high == 2:
                out.again(last, bits.gamma())
            else:
                high -= 2 if repeat else 3
                distance = (high << 8) + bits.byte()
                n = bits.gamma() + (distance >= 32000) + (distance >= 1280) + 2 * (distance < 128)
                out.again(distance, n)
                last = distance
            repeat = True
        elif not bits.bit():
            b = bits.byte()
            if not b >> 1:
                return bytes(out)
            last, repeat = b >> 1, True
            out.again(last, 2 + (b & 1))
        else:
            distance = sum(bits.bit() << i for i in (3, 2, 1, 0))
            if distance:
                out.again(distance, 1)
            else:
                out.append(0)
            repeat = False


@aplib.reverse
def _(data):
    out, tag_at, left = bytearray(data[:1]), 0, 0

    def bit(b):
        nonlocal tag_at, left
        if not left:
            tag_at, left = len(out), 8
            out.append(0)
        left -= 1
        out[tag_at] |= b << left

    def gamma(n):
        for i in range(n.bit_length() - 2, -1, -1):
            bit(n >> i & 1)
            bit(int(i > 0))

    repeat = False
    for at, distance, n in matches(data, 4, 31999, 1 << 16):
        if at == 0:
            for c in data[1 : n if distance else 1]:
                bit(0)
                out.append(c)
            continue
        if not distance:
            bit(0)
            out.append(data[at])
            repeat = False
            continue
        size = n - (distance >= 1280) - 2 * (distance < 128)
        bit(1)
        bit(0)
        gamma((distance >> 8) + (2 if repeat else 3))
        out.append(distance & 255)
        gamma(size)
        repeat = True
    for b in (1, 1, 0):
        bit(b)
    out.append(0)
    return bytes(out)


@unit("blz")
def blz(data):
    """BriefLZ; blocks with the magic header, or a bare stream."""
    out = b""
    if data[:4] == b"blz\x1a":
        while data[:4] == b"blz\x1a":
            _, _, packed, _, size, _ = struct.unpack_from(">4sIIIII", data)
            out += _blz(data[24 : 24 + packed], size)
            data = data[24 + packed :]
        return out
    return _blz(data, None)


def _blz(data: bytes, size: int | None) -> bytes:
    bits, out = Bits(data, 1, 2), Out(data[:1])
    while len(out) < size if size is not None else bits.at < len(data):
        if bits.bit():
            n = bits.gamma() + 2
            out.again((bits.gamma() - 2 << 8) + bits.byte() + 1, n)
        else:
            out.append(bits.byte())
    return bytes(out)


@blz.reverse
def _(data):
    out, tag_at, left = bytearray(data[:1]), 0, 0

    def bit(b):
        nonlocal tag_at, left
        if not left:
            tag_at, left = len(out), 16
            out.extend(b"\0\0")
        left -= 1
        out[tag_at + (left >> 3)] |= b << (left & 7)

    def gamma(n):
        for i in range(n.bit_length() - 2, -1, -1):
            bit(n >> i & 1)
            bit(int(i > 0))

    for at, distance, n in matches(data[:], 4, 1 << 16, 1 << 16):
        if at == 0:
            for c in data[1 : n if distance else 1]:
                bit(0)
                out.append(c)
        elif distance:
            bit(1)
            gamma(n - 2)
            gamma((distance - 1 >> 8) + 2)
            out.append(distance - 1 & 255)
        else:
            bit(0)
            out.append(data[at])
    return struct.pack(">4sIIIII", b"blz\x1a", 1, len(out), zlib.crc32(bytes(out)), len(data), zlib.crc32(data)) + bytes(out)


@unit("szdd")
def szdd(data):
    """SZDD files of COMPRESS.EXE."""
    if data[:8] == b"SZDD\x88\xf0\x27\x33":
        size, at, pos = struct.unpack_from("<I", data, 10)[0], 14, 4096 - 16
    elif data[:8] == b"SZ \x88\xf0\x27\x33\xd1":
        size, at, pos = struct.unpack_from("<I", data, 8)[0], 12, 4096 - 18
    else:
        raise ValueError("no SZDD header")
    window, out = bytearray(b" " * 4096), bytearray()
    while at < len(data) and len(out) < size:
        flags = data[at]
        at += 1
        for bit in range(8):
            if at >= len(data) or len(out) >= size:
                break
            if flags >> bit & 1:
                run = [data[at]]
                at += 1
                for c in run:
                    window[pos] = c
                    out.append(c)
                    pos = pos + 1 & 4095
            else:
                start, n = data[at] | (data[at + 1] & 0xF0) << 4, (data[at + 1] & 15) + 3
                at += 2
                for i in range(n):
                    c = window[start + i & 4095]
                    window[pos] = c
                    out.append(c)
                    pos = pos + 1 & 4095
    return bytes(out[:size])


szdd.check(lambda data: data[:4] == b"SZDD" or data[:3] == b"SZ ")


def _nrv(data: bytes, kind: str, bits: int) -> bytes:
    stream, out, last = Bits(data, 0, bits // 8), Out(), 1
    while True:
        while stream.bit():
            out.append(stream.byte())
        high = 2 + stream.bit() if kind == "b" else 2 + stream.bit()
        if kind == "b":
            while not stream.bit():
                high = high * 2 + stream.bit()
        else:
            while not stream.bit():
                high = (high - 1) * 2 + stream.bit()
                high = high * 2 + stream.bit()
        if high == 2:
            distance = last
            first = stream.bit()
        else:
            distance = (high - 3) * 256 + stream.byte()
            if distance == 0xFFFFFFFF:
                return bytes(out)
            if kind == "b":
                first = stream.bit()
            else:
                first, distance = ~distance & 1, distance >> 1
            distance += 1
            last = distance
        if kind == "e":
            if first:
                n = 1 + stream.bit()
            elif stream.bit():
                n = 3 + stream.bit()
            else:
                n = 2 + stream.bit()
                while not stream.bit():
                    n = n * 2 + stream.bit()
                n += 3
            out.again(distance, n + 1 + (distance > 0x500))
        else:
            n = first * 2 + stream.bit()
            if not n:
                n = 2 + stream.bit()
                while not stream.bit():
                    n = n * 2 + stream.bit()
                n += 2
            out.again(distance, n + 1 + (distance > (0xD00 if kind == "b" else 0x500)))


for _kind in "bde":

    @unit(f"nrv2{_kind}", "-b:bits:int=32")
    def _run(data, bits=32, kind=_kind):
        """NRV decompression, by tags of 8, 16 or 32 bits."""
        return _nrv(data, kind, bits)


@unit("lzw")
def lzw(data):
    """LZW of Unix compress."""
    if data[:2] == b"\x1f\x9d":
        flags, data = data[2], data[3:]
    else:
        flags = 0x90
    most, block = flags & 31, flags >> 7
    table: list[bytes] = [bytes((i,)) for i in range(256)] + [b""] * block
    size, out, before = 9, bytearray(), b""
    at, value, held, group = 0, 0, 0, 0
    while True:
        while held < size and at < len(data):
            value |= data[at] << held
            held, at = held + 8, at + 1
        if held < size:
            return bytes(out)
        code = value & (1 << size) - 1
        value, held, group = value >> size, held - size, group + 1
        if block and code == 256:
            skip = -group % 8 * size  # codes come in groups of eight; the rest of a group is padding
            while skip > held and at < len(data):
                value |= data[at] << held
                held, at = held + 8, at + 1
            value, held = value >> min(skip, held), max(0, held - skip)
            table, size, before, group = table[:257], 9, b"", 0
            continue
        word = table[code] if code < len(table) else before + before[:1]
        if code > len(table) or not word:
            raise ValueError("a code from nowhere")
        out += word
        if before and len(table) < 1 << most:
            table.append(before + word[:1])
            if len(table) == 1 << size and size < most:
                skip = -group % 8 * size
                while skip > held and at < len(data):
                    value |= data[at] << held
                    held, at = held + 8, at + 1
                value, held, group = value >> min(skip, held), max(0, held - skip), 0
                size += 1
        before = word


@unit("decompress", "-m:max_ratio:str=1.0 -n:min_ratio:str=0.0001")
def decompress(data, max_ratio="1.0", min_ratio="0.0001"):
    """The output of the first codec whose format fits, else of the one that expands most."""
    best = data
    for name in ("zl", "bz2", "lzma", "zstd", "lz4", "lzip", "szdd", "aplib", "lznt1", "lzf", "blz", "flz", "lzjb"):
        if name == "zl" and data[:2] not in (b"\x1f\x8b", b"\x78\x9c", b"\x78\x01", b"\x78\xda", b"\x78\x5e"):
            continue
        u = UNITS[name]
        if u.accepts and not u.accepts(data):
            continue
        try:
            got = u.one(data)
        except Exception:  # noqa: BLE001  a codec may fail in any way on foreign data
            continue
        if len(data) <= float(max_ratio) * len(got) and len(data) >= float(min_ratio) * len(got) and len(got) > len(best):
            best = got
            if u.accepts or name == "zl":
                break
    return best
