"""Dates, urls, statistics, views of data, and analysis of repeating keys."""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import textwrap
import xml.dom.minidom
from collections import Counter
from email.utils import parsedate_to_datetime
from itertools import cycle, islice

import numpy as np
from pyspark.sql import functions as F

from millrace.functions.registry import unit
from millrace.functions.strings import latin, unlatin


def entropy(data: bytes) -> float:
    """Bits a byte, over eight."""
    n = len(data)
    return -sum(c / n * math.log2(c / n) for c in Counter(data).values()) / 8 if n else 0.0


def coincidence(data: bytes) -> float:
    """Index of coincidence."""
    n = len(data)
    return sum(c * (c - 1) for c in Counter(data).values()) / (n * (n - 1)) if n > 1 else 0.0


# fixed values: (start of a file, extension, mime type)
MAGIC = [
    (b"MZ", "exe", "application/x-dosexec"), (b"\x7fELF", "elf", "application/x-executable"), (b"PK\3\4", "zip", "application/zip"), (b"Rar!\x1a\7", "rar", "application/x-rar"), (b"7z\xbc\xaf\x27\x1c", "7z", "application/x-7z-compressed"), (b"\x1f\x8b", "gz", "application/gzip"), (b"BZh", "bz2", "application/x-bzip2"),
    (b"\xfd7zXZ\0", "xz", "application/x-xz"), (b"\x28\xb5\x2f\xfd", "zst", "application/zstd"), (b"%PDF-", "pdf", "application/pdf"), (b"\x89PNG\r\n\x1a\n", "png", "image/png"), (b"\xff\xd8\xff", "jpg", "image/jpeg"), (b"GIF8", "gif", "image/gif"), (b"BM", "bmp", "image/bmp"), (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "ole", "application/x-ole-storage"),
    (b"{\\rtf", "rtf", "text/rtf"), (b"SQLite format 3\0", "sqlite", "application/vnd.sqlite3"), (b"MSCF", "cab", "application/vnd.ms-cab-compressed"), (b"\xca\xfe\xba\xbe", "class", "application/java-vm"), (b"dex\n", "dex", "application/x-dex"), (b"bplist00", "plist", "application/x-plist"), (b"\xd4\xc3\xb2\xa1", "pcap", "application/vnd.tcpdump.pcap"),
    (b"\x0a\x0d\x0d\x0a", "pcapng", "application/x-pcapng"), (b"L\0\0\0\1\x14\2\0", "lnk", "application/x-ms-shortcut"), (b"LZIP", "lz", "application/lzip"), (b"<?xml", "xml", "text/xml"), (b"<!DOCTYPE html", "html", "text/html"), (b"<html", "html", "text/html"), (b"#!", "sh", "text/x-script"),
]


def sniff(data: bytes) -> tuple[str, str]:
    """(extension, mime type) by the first bytes; else by whether it is text."""
    for start, ext, mime in MAGIC:
        if data[: len(start)].lower() == start.lower() if start[:1] == b"<" else data.startswith(start):
            return ext, mime
    if data[257:262] == b"ustar":
        return "tar", "application/x-tar"
    if data.lstrip()[:1] in (b"{", b"["):
        try:
            json.loads(data)
            return "json", "application/json"
        except ValueError:
            pass
    return ("txt", "text/plain") if data and not re.search(rb"[\x00-\x08\x0e-\x1a\x1c-\x1f]", data[:4096]) else ("bin", "application/octet-stream")


_ZONES = {"UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2}
_FORMATS = [
    "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d", "%Y/%m/%d %H:%M:%S", "%Y/%m/%d", "%d.%m.%Y %H:%M:%S", "%d.%m.%Y %H:%M", "%d.%m.%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y %I:%M %p", "%m/%d/%Y %H:%M", "%m/%d/%Y", "%d/%m/%Y %H:%M:%S", "%d/%m/%Y",
    "%a %b %d %H:%M:%S %Y", "%a, %d %b %Y %H:%M:%S", "%d %b %Y %H:%M:%S", "%d %b %Y", "%b %d %Y %H:%M:%S", "%b %d, %Y %H:%M:%S", "%b %d, %Y", "%B %d, %Y", "%d %B %Y", "%d-%b-%Y %H:%M:%S", "%d-%b-%Y", "%Y%m%d%H%M%S", "%Y%m%dT%H%M%S", "%Y%m%d",
]


@unit("datefix", "format:str=%Y-%m-%d_%H:%M:%S -d:dos")
def datefix(data, format="%Y-%m-%d %H:%M:%S", dos=False):
    """Dates of many formats in one, in UTC; what is no date comes back without zone and double blanks."""
    text = " ".join(data.decode("utf-8", "replace").split())
    format = "%Y-%m-%d %H:%M:%S" if format == "%Y-%m-%d_%H:%M:%S" else format
    show = lambda d: d.strftime(format).encode()
    epoch = dt.datetime(1970, 1, 1)
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|\d+", text):
        n = int(text, 0) if text[:2].lower() == "0x" else int(text)
        if dos:
            d, t = n >> 16, n & 0xFFFF
            return show(dt.datetime(1980 + (d >> 9), max(1, d >> 5 & 15), max(1, d & 31), t >> 11, t >> 5 & 63, min(59, 2 * (t & 31))))
        if text[:2].lower() != "0x" and len(text) > 14:
            raise ValueError("too many digits for a date")
        if text[:2].lower() != "0x" and len(text) == 14:
            return show(dt.datetime.strptime(text, "%Y%m%d%H%M%S"))
        if text[:2].lower() != "0x" and len(text) == 8 and 1900 <= int(text[:4]) <= 2100:
            return show(dt.datetime.strptime(text, "%Y%m%d"))
        return show(epoch + dt.timedelta(seconds=n // 1000 if len(text) == 13 else n))
    plain = re.sub(r"^(\d{4}):(\d{2}):(\d{2})(?=\D)", r"\1-\2-\3", text)
    plain = re.sub(r"(?<=\d)T(?=\d)", " ", plain)
    shift = 0.0
    if m := re.search(r"\s*(?:\(?(Z|[A-Z]{3,4})\)?|(?:UTC|GMT)?([+-])(\d{2}):?(\d{2}))$", plain):
        if m[2] and re.search(r"\d:\d{2}(?:\.\d+)?\s*(?:UTC|GMT)?$", plain[: m.start()] + plain[m.start() : m.start(2)]):
            shift, plain = (1 if m[2] == "+" else -1) * (int(m[3]) + int(m[4]) / 60), plain[: m.start()]
        elif m[1] in _ZONES:
            shift, plain = _ZONES[m[1]], plain[: m.start()]
    if re.search(r"\.\d{7,}$", plain):
        plain = re.sub(r"(\.\d{6})\d+$", r"\1", plain)
    for f in _FORMATS:
        try:
            return show(dt.datetime.strptime(plain, f) - dt.timedelta(hours=shift))
        except ValueError:
            continue
    try:
        d = parsedate_to_datetime(text)
        return show((d.astimezone(dt.timezone.utc) if d.tzinfo else d).replace(tzinfo=None))
    except (TypeError, ValueError):
        return plain.encode()


@unit("urlfix", "-m:meta -k:keep:int=0", many=True)
def urlfix(data, meta=False, keep=0):
    """Urls without fragment (keep 1: with parameters, 2: with the query)."""
    text = data.strip()
    text, _, fragment = text.partition(b"#")
    rest, _, query = text.partition(b"?")
    path, _, params = rest.partition(b";")
    out = path + (b";" + params if params and keep >= 1 else b"") + (b"?" + query if query and keep >= 2 else b"")
    yield out, ({"query": query, "fragment": fragment, "params": params} if meta else {})


urlfix.column(lambda c, meta=False, keep=0: None if meta or keep else unlatin(F.regexp_replace(F.trim(latin(c)), r"(?s)[;?#].*$", "")))


@unit("iemap", "*label:str -l:legend -b:bgfill -c:fgchar:str=# -w:width:int=64")
def iemap(data, label=(), legend=False, bgfill=False, fgchar="#", width=64):
    """The entropy along the data, as digits of tenths."""
    width = width or 64
    step = max(1, -(-len(data) // width))
    return "".join(str(min(9, int(10 * entropy(data[i : i + step])))) for i in range(0, len(data), step)).encode()


def hexdump(data: bytes, width: int = 16, lines: int = 0, expand: bool = False) -> list[str]:
    out, last, skipped = [], None, 0
    for at in range(0, len(data), width):
        row = data[at : at + width]
        if row == last and not expand and at + width < len(data):
            skipped += 1
            continue
        if skipped:
            out.append(f"{'':>{len(out[-1].split(':')[0])}}: === repeats {skipped} times".rstrip())
            skipped = 0
        text = "".join(chr(b) if 32 <= b < 127 else "." for b in row)
        out.append(f"{at:05X}: {row.hex(' ').upper():<{3 * width - 1}}  {text}")
        last = row
        if lines and len(out) >= lines:
            break
    return out


@unit("peek", "-l:lines:int=10 -a:all -b:brief -d:decode -e:escape -r:bare -w:width:int=16")
def peek(data, lines=10, all=False, brief=False, decode=False, escape=False, bare=False, width=16):
    """A preview: size, entropy and kind, and a hex dump or text."""
    ext, mime = sniff(data)
    head = [] if bare else [f"{len(data)} bytes; {100 * entropy(data):.2f}% entropy; {mime}"]
    if escape:
        body = [repr(data[: 80 * (lines or 10)])[2:-1]]
    elif decode:
        body = textwrap.wrap(data.decode("utf-8", "replace"), 80)[: None if all else lines or 10]
    else:
        body = hexdump(data, width or 16, 0 if all else lines or 10)
    return "\n".join(head + (body[:1] if brief else body)).encode()


@unit("hexload", "-w:width:int=0 -e:expand -n:narrow -b:blocks:int=1 -d:dense")
def hexload(data, width=0, expand=False, narrow=False, blocks=1, dense=False):
    """Hex dumps, with or without addresses and text, to bytes."""
    out = bytearray()
    for line in data.decode("latin-1").splitlines():
        m = re.match(r"^\s*(?:(?:0x)?[0-9a-fA-F]{4,16}h?[:\s]\s*)?((?:[0-9a-fA-F]{2}(?:\s{1,2}|-(?=[0-9a-fA-F])|$))+|(?:[0-9a-fA-F]{2})+)", line)
        if m:
            out += bytes.fromhex(re.sub(r"[\s-]", "", m[1]))
    return bytes(out)


hexload.reverse(lambda data, width=0, expand=False, narrow=False, blocks=1, dense=False: "\n".join(hexdump(data, width or 16, expand=True)).encode())


@unit("ppjson", "-t:tabular -m:minimal -i:indent:int=4")
def ppjson(data, tabular=False, minimal=False, indent=4):
    """JSON, indented, minimal or as a table of paths."""
    doc = json.loads(data)
    if tabular:
        rows = list(flat(doc))
        wide = max((len(k) for k, _ in rows), default=0)
        return "\n".join(f"{k:<{wide}} : {v if isinstance(v, str) else json.dumps(v)}" for k, v in rows).encode()
    return (json.dumps(doc, separators=(",", ":"), ensure_ascii=False) if minimal else json.dumps(doc, indent=indent or 4, ensure_ascii=False)).encode()


def flat(doc, path=""):
    if isinstance(doc, dict) and doc:
        for k, v in doc.items():
            yield from flat(v, f"{path}.{k}" if path else str(k))
    elif isinstance(doc, list) and doc:
        for i, v in enumerate(doc):
            yield from flat(v, f"{path}[{i}]")
    else:
        yield path, doc


@unit("ppxml", "-i:indent:int=4 -x:header")
def ppxml(data, indent=4, header=False):
    """XML, indented."""
    doc = xml.dom.minidom.parseString(data)
    stack = [doc]
    while stack:
        node = stack.pop()
        for child in list(node.childNodes):
            if child.nodeType == child.TEXT_NODE and not child.data.strip():
                node.removeChild(child)
            stack.append(child)
    text = doc.toprettyxml(indent=" " * (indent or 4))
    return (text if header else text.split("\n", 1)[1]).strip().encode()


# ---------------------------------------------------------------- repeating patterns and keys
@unit("drp", "-c:consecutive -a:align -n:min:int=1 -m:max:int=0 -N:len:int=0 -A:all -t:threshold:int=20 -w:weight:int=0 -b:buffer:int=1024", many=True)
def drp(data, consecutive=False, align=False, min=1, max=0, len=0, all=False, threshold=20, weight=0, buffer=1024):
    """The byte pattern that covers most of the data by repetition."""
    best = {}
    view = data[: buffer or 1024] if not all else data
    top = len or max or view.__len__() // 2
    for n in range(len or min or 1, top + 1):
        counts = Counter(view[i : i + n] for i in range(0, view.__len__() - n + 1, n if align else 1))
        for pattern, c in counts.most_common(3):
            if c < 2 or (n > 1 and (pattern + pattern).find(pattern, 1) < n):
                continue
            found = view.count(pattern)
            if consecutive and pattern * 2 not in view:
                continue
            best[pattern] = found * n ** (1 + (weight or 0) / 10) * (n if n > 1 else 1) ** 0.2
    if best:
        score = builtins_max(best.values())
        yield from [p for p, s in best.items() if s == score][:1]


builtins_max = max


def key_of(data: bytes, sizes=range(1, 33), plain: bytes = b"", letters: bytes = b"\0 e", alph: bool = False, where: slice | None = None) -> tuple[bytes, str, int]:
    """(key, xor or add, offset) that explains the data best: by a known plaintext (at any offset, or one from ``where.start`` to ``where.stop``), else by the commonest byte of each column being a zero, a blank or an e."""
    tries = []
    for n in sizes:
        if n < 1 or n > max(1, len(data) // 2):
            continue
        if plain:
            if n <= len(plain) <= len(data):
                for kind in ("xor", "sub"):
                    # a key of n bytes cancels out between bytes that are n apart
                    one, two = (bytes(x[n:] ^ x[:-n] if kind == "xor" else x[n:] - x[:-n]) for x in (np.frombuffer(data, np.uint8), np.frombuffer(plain, np.uint8)))
                    first, last = where.start if where and where.start else 0, len(data) - len(plain)
                    if where and where.stop is not None:
                        last = min(last, where.stop)
                    at = one.find(two, first, last + len(two)) if first <= last else -1
                    if at >= 0:
                        k = bytes((c ^ p) if kind == "xor" else (c - p) & 255 for c, p in zip(data[at : at + n], plain, strict=False))
                        turn = -at % n
                        return k[turn:] + k[:turn], kind, at
            continue
        columns = [data[i::n] for i in range(n)]
        for common in letters:
            key = bytes(Counter(c).most_common(1)[0][0] ^ common for c in columns)
            if alph and not key.isalnum():
                continue
            out = bytes(a ^ b for a, b in zip(data, islice(cycle(key), len(data)), strict=True))
            readable = sum(32 <= b < 127 or b in b"\r\n\t\0" for b in out) / len(out)
            fit = sum(Counter(c).most_common(1)[0][1] for c in columns) / len(data)
            tries.append((readable + fit - n / 200, -n, key))
    if not tries:
        return b"\0", "xor", 0
    best = max(tries)[2]
    for n in range(1, len(best)):
        if len(best) % n == 0 and best == best[:n] * (len(best) // n):
            return best[:n], "xor", 0
    return best, "xor", 0


_XKEY = "range:slice? -p:plaintext:bytes -s:searchpos:slice -a:alph -c:crib -f:freq"


@unit("xkey", _XKEY, many=True)
def xkey(data, range=None, plaintext=None, searchpos=None, alph=False, crib=False, freq=False):
    """The key of a repeating XOR or ADD."""
    if data:
        sizes = builtins_range(range.start or 1, range.stop or 33) if range else builtins_range(1, 33)
        key, kind, _ = key_of(data, sizes, plaintext or b"", alph=alph, where=searchpos)
        yield key, {"method": kind}


builtins_range = range


@unit("autoxor", _XKEY, many=True)
def autoxor(data, range=None, plaintext=None, searchpos=None, alph=False, crib=False, freq=False):
    """The data without its repeating XOR or ADD."""
    if data:
        sizes = builtins_range(range.start or 1, range.stop or 33) if range else builtins_range(1, 33)
        key, kind, _ = key_of(data, sizes, plaintext or b"", alph=alph, where=searchpos)
        stream = islice(cycle(key), len(data))
        yield bytes((a ^ b) if kind == "xor" else (a - b) & 255 for a, b in zip(data, stream, strict=True)), {"key": key, "method": kind}


@unit("cmdarg")
def cmdarg(data):
    """The argument that a shell passes on: of cmd /c, powershell -Command or -EncodedCommand, start or wmic process call create."""
    text = data.decode("latin-1").strip()
    if m := re.search(r"(?is)\bpowershell(?:\.exe)?\b.*?\s-e(?:nc(?:odedcommand)?)?\s+[\"']?([A-Za-z0-9+/=]+)", text):
        import base64

        return base64.b64decode(m[1] + "=" * (-len(m[1]) % 4)).decode("utf-16le").encode()
    for pattern in (r"(?is)\bpowershell(?:\.exe)?\b.*?\s-c(?:ommand)?\s+(.*)$", r"(?is)\bcmd(?:\.exe)?\b.*?\s/[ckr]\s*(.*)$", r"(?is)\bwmic\b.*?\bprocess\s+call\s+create\s+(.*)$", r"(?is)^start\s+(?:\"[^\"]*\"\s+)?(?:/\w+\s+)*(.*)$"):
        if m := re.search(pattern, text):
            arg = m[1].strip()
            if len(arg) > 1 and arg[0] == arg[-1] and arg[0] in "\"'":
                arg = arg[1:-1]
            return (re.sub(r"\^(.)", r"\1", arg) if "cmd" in pattern else arg).replace('\\"', '"').encode("latin-1")
    return data


@unit("n40", "key")
def n40(data, key):
    """Hex strings whose bytes are chained by differences under a key."""
    raw, out, last = bytes.fromhex(re.sub(r"[^0-9a-fA-F]", "", data.decode("latin-1"))), bytearray(), None
    for i, b in enumerate(raw):
        if last is not None:
            x = b ^ key[(i - 1) % len(key)]
            out.append((x - last) % 255 if x > last else (x + 255 - last) % 255)
        last = b
    return bytes(out)
