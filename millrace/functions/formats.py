"""Structured documents, archives, captures and executables."""

from __future__ import annotations

import bz2
import csv as csvlib
import datetime as dt
import email
import email.policy
import gzip
import io
import json
import plistlib
import re
import sqlite3
import struct
import tarfile
import zipfile
import zlib
from fnmatch import fnmatchcase
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import functions as F

from millrace.functions.registry import unit
from millrace.functions.strings import latin

#: No member of an archive grows beyond this.
LIMIT = 1 << 30
_PATHS = "*paths:str -l:list -j:join_path -d:drop_path -p:path:str=path -r:regex -e:exact -x:exclude:str"


def dumped(doc) -> bytes:
    return json.dumps(doc, ensure_ascii=False, default=lambda x: x.decode("latin-1") if isinstance(x, bytes) else x.isoformat() if isinstance(x, dt.datetime) else str(x), indent=4).encode()


def selected(items, paths=(), list=False, join_path=False, drop_path=False, path="path", regex=False, exact=False, exclude=None, **_):
    """Items (path, a function or bytes, variables) that the patterns choose. Without a hit, patterns are tried with a star before them and then around them; equal names get numbers."""
    items = [*items]
    ways = [lambda p: p] if exact or regex else [lambda p: p, lambda p: f"*{p}", lambda p: f"*{p}*"]
    hits = items
    if paths:
        for way in ways:
            match = (lambda name, p: re.search(p, name)) if regex else (lambda name, p, way=way: fnmatchcase(name, way(p)))
            hits = [x for x in items if any(match(x[0], p) for p in paths)]
            if hits:
                break
    if exclude:
        hits = [x for x in hits if not fnmatchcase(x[0], exclude)]
    seen: dict[str, set[int]] = {}
    for name, body, meta in hits:
        if list:
            yield name.encode("utf-8", "surrogateescape"), {}
            continue
        data = body() if callable(body) else body
        known = seen.setdefault(name, set())
        if (check := zlib.adler32(data)) in known:
            continue
        known.add(check)
        shown = name if len(known) == 1 else re.sub(r"(\.\w+)?$", lambda m, n=len(known) - 1: f".v{n}{m[1] or ''}", name, count=1)
        yield data, ({} if drop_path else {path: shown.encode("utf-8", "surrogateescape")}) | meta


def paths_unit(name, text, check=None):
    """Registers a function that lists (path, content, variables)."""

    def add(f):
        @unit(name, _PATHS + (" -P:pwd:bytes" if name.startswith("xt") else ""), True)
        def run(data, pwd=None, **kw):
            return selected(f(data, pwd) if "pwd" in f.__code__.co_varnames else f(data), **kw)

        run.text, run.accepts = text, check
        return run

    return add


# ---------------------------------------------------------------- json, csv, sql
@unit("xj0", "*fmt:str -a:all -1:one -r:raw", many=True)
def xj0(data, fmt=(), all=False, one=False, raw=False):
    """A field of a document, with the other scalar fields as variables."""
    doc = json.loads(data)
    flat = {k: v for k, v in (doc.items() if isinstance(doc, dict) else enumerate(doc)) if all or not isinstance(v, (dict, list))}
    meta = {str(k): v if isinstance(v, (int, float)) and not isinstance(v, bool) else text_of(v) for k, v in flat.items() if str(k).isidentifier() and v is not None}
    body = b""
    for f in fmt:
        if f in (flat if isinstance(doc, dict) else {}):
            body += text_of(doc[f])
            if one:
                meta = {}
            meta.pop(f, None)
        else:
            body += re.sub(r"\{(\w+)\}", lambda m: text_of(doc.get(m[1], m[0])).decode("utf-8", "replace"), f).encode()
    yield body, meta


def text_of(v) -> bytes:
    return v.encode() if isinstance(v, str) else b"" if v is None else json.dumps(v, ensure_ascii=False).encode()


@unit("xjl", "", many=True)
def xjl(data):
    """The elements of an array or object, or the lines of JSON lines."""
    try:
        doc = json.loads(data)
    except ValueError:
        doc = [json.loads(x) for x in data.splitlines() if x.strip()]
    for v in doc.values() if isinstance(doc, dict) else doc:
        yield text_of(v)


@paths_unit("xtjson", "Values of a JSON document by their paths.")
def xtjson(data):
    def walk(doc, at):
        kind = {dict: "object", list: "array", str: "string", bool: "bool", int: "int", float: "float"}.get(type(doc), "null")
        yield ".".join(at), text_of(doc), {"type": kind}
        for k, v in doc.items() if isinstance(doc, dict) else enumerate(doc) if isinstance(doc, list) else ():
            yield from walk(v, [*at, str(k)])

    return [x for x in walk(json.loads(data), []) if x[0]]


def csv_value(text: str):
    """Numbers without leading zeros as integers, ISO dates to the second, others as they are."""
    if text.isdigit() and not text.startswith("0"):
        return int(text)
    if re.match(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:", text):
        try:
            return dt.datetime.fromisoformat(text.replace("Z", "+00:00") if text.endswith("Z") else re.sub(r"(\.\d{6})\d+", r"\1", text)).replace(tzinfo=None).isoformat(" ", "seconds")
        except ValueError:
            return text
    return text


@unit("csv", "-q:quote:bytes=\" -d:delim:bytes=,", many=True)
def csv(data, quote=b'"', delim=b","):
    """Rows of a table with a header, as JSON."""
    rows = csvlib.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), quotechar=quote.decode(), delimiter=delim.decode())
    head = next(rows, [])
    for row in rows:
        if row:
            yield dumped({k: csv_value(v) for k, v in zip(head, row, strict=False)})


@csv.reverse
def _(data, quote=b'"', delim=b","):
    try:
        doc = json.loads(data)
        rows = doc if isinstance(doc, list) else [doc]
    except ValueError:
        rows = [json.loads(x) for x in data.splitlines() if x.strip()]
    head = list(dict.fromkeys(k for r in rows for k in r))
    out = io.StringIO()
    w = csvlib.writer(out, quotechar=quote.decode(), delimiter=delim.decode(), lineterminator="\r\n")
    w.writerow(head)
    w.writerows([r.get(k, "") for k in head] for r in rows)
    return out.getvalue().encode()


def _database(data: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    return con


@unit("sqlite", "query:str=SELECT_*_FROM_sqlite_master", many=True)
def sqlite(data, query="SELECT * FROM sqlite_master"):
    """Rows of a query on a database file, as JSON."""
    cur = _database(data).execute("SELECT * FROM sqlite_master" if query == "SELECT_*_FROM_sqlite_master" else query)
    names = [d[0] for d in cur.description or ()]
    for row in cur:
        yield dumped(dict(zip(names, row, strict=True)))


@paths_unit("xtsql", "Tables, rows and cells of a database file.")
def xtsql(data):
    con = _database(data)
    con.text_factory = bytes
    out = []
    for (name,) in con.execute("select name from sqlite_master where type = 'table' order by rowid"):
        table = name.decode()
        columns = [r[1].decode() for r in con.execute(f'pragma table_info("{table}")')]
        for i, row in enumerate(con.execute(f'select * from "{table}"')):
            for c, v in zip(columns, row, strict=True):
                out.append((f"{table}/{i}/{c}", v if isinstance(v, bytes) else b"" if v is None else str(v).encode(), {}))
    return out


# ---------------------------------------------------------------- binary documents
@unit("cbor", "")
def cbor(data):
    """CBOR to JSON."""
    at = 0

    def take(n):
        nonlocal at
        at += n
        if at > len(data):
            raise ValueError("the input ends inside an item")
        return data[at - n : at]

    def item():
        head = take(1)[0]
        kind, low = head >> 5, head & 31
        n = low if low < 24 else None if low == 31 else int.from_bytes(take(1 << low - 24), "big")
        if kind < 2:
            return n if not kind else -1 - n
        if kind in (2, 3):
            raw = b"".join(iter(lambda: (lambda x: x.encode() if isinstance(x, str) else x)(item()), STOP)) if n is None else take(n)
            return raw.decode() if kind == 3 else raw
        if kind == 4:
            return [*iter(item, STOP)] if n is None else [item() for _ in range(n)]
        if kind == 5:
            out = {}
            while n is None or len(out) < n:
                k = item()
                if k is STOP:
                    break
                out[k if isinstance(k, str) else str(k)] = item()
            return out
        if kind == 6:
            v = item()
            return int.from_bytes(v, "big") if n == 2 else -1 - int.from_bytes(v, "big") if n == 3 else v
        if low == 31:
            return STOP
        return {20: False, 21: True, 22: None, 23: None}.get(low, n) if low < 25 else struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], n.to_bytes(1 << low - 24, "big"))[0]

    class Stop:
        pass

    STOP = Stop()
    return dumped(item())


@unit("msgpack", "")
def msgpack(data):
    """MessagePack to JSON."""
    at = 0

    def take(n):
        nonlocal at
        at += n
        return data[at - n : at]

    num = lambda n: int.from_bytes(take(n), "big")

    def many(n, pairs):
        return {str(item()): item() for _ in range(n)} if pairs else [item() for _ in range(n)]

    def item():
        b = take(1)[0]
        if b < 0x80 or b >= 0xE0:
            return b if b < 0x80 else b - 256
        if b < 0xA0:
            return many(b & 15, b < 0x90)
        if b < 0xC0:
            return take(b & 31).decode()
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b]
        if b < 0xC7:
            return take(num(1 << b - 0xC4))
        if b < 0xCA or 0xD4 <= b < 0xD9:
            n = num(1 << b - 0xC7) if b < 0xCA else 1 << b - 0xD4
            return {"type": num(1), "data": take(n)}
        if b < 0xCC:
            return struct.unpack(">f" if b == 0xCA else ">d", take(4 if b == 0xCA else 8))[0]
        if b < 0xD0:
            return num(1 << b - 0xCC)
        if b < 0xD4:
            return int.from_bytes(take(1 << b - 0xD0), "big", signed=True)
        if b < 0xDC:
            return take(num(1 << b - 0xD9)).decode()
        return many(num(2 if b % 2 == 0 else 4), b >= 0xDE)

    out = []
    while at < len(data):
        out.append(dumped(item()))
    return out


@msgpack.reverse
def _(data):
    def put(v) -> bytes:
        size = lambda n, small, base, codes: bytes((base | n,)) if n < small else next(bytes((c,)) + n.to_bytes(w, "big") for c, w in codes if n < 1 << 8 * w)
        if v is None or isinstance(v, bool):
            return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[v]
        if isinstance(v, int):
            if -32 <= v < 128:
                return bytes((v & 255,))
            w = next(w for w in (1, 2, 4, 8) if (0 <= v < 1 << 8 * w) or (-(1 << 8 * w - 1) <= v < 0))
            return bytes(((0xCC if v >= 0 else 0xD0) + w.bit_length() - 1,)) + v.to_bytes(w, "big", signed=v < 0)
        if isinstance(v, float):
            return b"\xcb" + struct.pack(">d", v)
        if isinstance(v, str):
            raw = v.encode()
            return size(len(raw), 32, 0xA0, ((0xD9, 1), (0xDA, 2), (0xDB, 4))) + raw
        if isinstance(v, list):
            return size(len(v), 16, 0x90, ((0xDC, 2), (0xDD, 4))) + b"".join(map(put, v))
        return size(len(v), 16, 0x80, ((0xDE, 2), (0xDF, 4))) + b"".join(put(k) + put(x) for k, x in v.items())

    return put(json.loads(data))


@unit("plist", "")
def plist(data):
    """Property lists to JSON."""
    return dumped(plistlib.loads(data))


plist.reverse(lambda data: plistlib.dumps(json.loads(data), fmt=plistlib.FMT_BINARY))


@unit("asn1", "")
def asn1(data):
    """DER to JSON."""
    names = {1: "bool", 2: "int", 3: "bits", 4: "bytes", 5: "null", 6: "oid", 10: "enum", 12: "utf8", 16: "sequence", 17: "set", 19: "printable", 20: "t61", 22: "ia5", 23: "utctime", 24: "time", 30: "bmp"}

    def parse(at, end):
        out = []
        while at < end:
            tag, n = data[at], data[at + 1]
            at += 2
            if n & 0x80:
                k = n & 0x7F
                n, at = int.from_bytes(data[at : at + k], "big"), at + k
            body, number = data[at : at + n], tag & 31
            if at + n > end:
                raise ValueError("an element ends outside its parent")
            if tag & 0x20:
                value = parse(at, at + n)
            elif tag >> 6:
                value = body.hex()
            elif number in (2, 10):
                value = int.from_bytes(body, "big", signed=True)
            elif number == 1:
                value = body != b"\0"
            elif number == 5:
                value = None
            elif number == 6:
                arcs, v = [], 0
                for b in body:
                    v = v << 7 | b & 0x7F
                    if not b & 0x80:
                        arcs.append(v)
                        v = 0
                first = min(arcs[0] // 40, 2)
                value = ".".join(map(str, (first, arcs[0] - 40 * first, *arcs[1:])))
            elif number in (12, 19, 20, 22, 23, 24):
                value = body.decode("utf-8", "replace")
            elif number == 30:
                value = body.decode("utf-16be", "replace")
            else:
                value = body.hex()
            out.append({"type": names.get(number, str(number)) if not tag >> 6 else f"[{number}]", "value": value})
            at += n
        return out

    tree = parse(0, len(data))
    return dumped(tree[0] if len(tree) == 1 else tree)


@unit("pkcs7", "")
def pkcs7(data):
    """PKCS7 data as the JSON of its structure."""
    if data.lstrip().startswith(b"-----BEGIN"):
        import base64

        data = base64.b64decode(b"".join(x for x in data.splitlines() if not x.startswith(b"-----")))
    return asn1.forward(data)


@unit("pbuf", "-t:try_repeated")
def pbuf(data, try_repeated=False):
    """Protocol buffers without a schema, as JSON of field numbers."""

    def varint(at):
        v = shift = 0
        while True:
            b = data_[at]
            v |= (b & 0x7F) << shift
            shift, at = shift + 7, at + 1
            if not b & 0x80:
                return v, at

    def message(raw):
        nonlocal data_
        kept, data_ = data_, raw
        try:
            at, out = 0, {}
            while at < len(raw):
                tag, at = varint(at)
                number, kind = tag >> 3, tag & 7
                if not number:
                    raise ValueError("field 0")
                if kind == 0:
                    v, at = varint(at)
                elif kind in (1, 5):
                    n = 8 if kind == 1 else 4
                    if at + n > len(raw):
                        raise ValueError("short")
                    v, at = int.from_bytes(raw[at : at + n], "little"), at + n
                elif kind == 2:
                    n, at = varint(at)
                    if at + n > len(raw):
                        raise ValueError("short")
                    v, at = value(raw[at : at + n]), at + n
                else:
                    raise ValueError("kind")
                out.setdefault(str(number), []).append(v)
            return {k: v[0] if len(v) == 1 else v for k, v in out.items()}
        finally:
            data_ = kept

    def value(raw):
        try:
            text = raw.decode()
            if text.isprintable() or not raw:
                return text
        except ValueError:
            pass
        try:
            return message(raw)
        except (ValueError, IndexError):
            return raw.hex()

    data_ = data
    return dumped(message(data))


@unit("dsphp", "")
def dsphp(data):
    """PHP's serialize() to JSON."""
    at = 0

    def until(c):
        nonlocal at
        end = data.index(c, at)
        out, at = data[at:end], end + 1
        return out

    def item():
        nonlocal at
        kind = data[at : at + 1]
        at += 2
        if kind == b"N":
            return None
        if kind in b"bidrR":
            raw = until(b";")
            return raw == b"1" if kind == b"b" else float(raw) if kind == b"d" else int(raw)
        if kind == b"s":
            n = int(until(b":"))
            raw = data[at + 1 : at + 1 + n]
            at += n + 3
            return raw.decode("utf-8", "replace")
        if kind in b"aO":
            if kind == b"O":
                until(b":")
                until(b":")
            n, out = int(until(b":")), {}
            at += 1
            for _ in range(n):
                k = item()
                out[str(k)] = item()
            at += 1
            return [*out.values()] if kind == b"a" and [*out] == [str(i) for i in range(len(out))] else out
        raise ValueError(f"unknown kind {kind!r}")

    return dumped(item())


@dsphp.reverse
def _(data):
    def put(v):
        if v is None:
            return b"N;"
        if isinstance(v, bool):
            return b"b:%d;" % v
        if isinstance(v, int):
            return b"i:%d;" % v
        if isinstance(v, float):
            return b"d:" + repr(v).encode() + b";"
        if isinstance(v, str):
            return b's:%d:"%s";' % (len(v.encode()), v.encode())
        pairs = enumerate(v) if isinstance(v, list) else v.items()
        body = b"".join(put(k) + put(x) for k, x in pairs)
        return b"a:%d:{%s}" % (len(v), body)

    return put(json.loads(data))


# ---------------------------------------------------------------- markup and mail
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Elements with their paths and where their inner and outer texts stand."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.text, self.open, self.done = text, [], []
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.counts: list[dict[str, int]] = [{}]
        self.feed(text)
        self.close()
        for item in self.open[::-1]:
            item["end"] = item["outer_end"] = len(text)
        self.done.sort(key=lambda x: x["start"])

    def here(self):
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        n = self.counts[-1].get(tag, 0)
        self.counts[-1][tag] = n + 1
        at = self.here()
        inner = at + len(self.get_starttag_text())
        item = {"tag": tag, "n": n, "parent": self.open[-1] if self.open else None, "start": at, "inner": inner, "end": inner, "outer_end": inner, "attrs": {k: v or "" for k, v in attrs}}
        self.done.append(item)
        if tag not in _VOID:
            self.open.append(item)
            self.counts.append({})

    def handle_endtag(self, tag):
        if any(x["tag"] == tag for x in self.open):
            at = self.here()
            close = self.text.find(">", at) + 1
            while self.open:
                item = self.open.pop()
                self.counts.pop()
                item["end"] = item["outer_end"] = at
                if item["tag"] == tag:
                    item["outer_end"] = close
                    break

    def path(self, item):
        names = []
        while item:
            total = sum(x["parent"] is item["parent"] and x["tag"] == item["tag"] for x in self.done)
            names.append(item["tag"] if total == 1 else f"{item['tag']}({item['n']})")
            item = item["parent"]
        return "/".join(names[::-1])


@unit("xthtml", f"{_PATHS} -o:outer -a:attributes", many=True)
def xthtml(data, outer=False, attributes=False, **kw):
    """Contents of HTML elements by the path of their tags."""
    tree = _Tree(data.decode("utf-8", "replace"))
    items = [(tree.path(x), (tree.text[x["start"] : x["outer_end"]] if outer else tree.text[x["inner"] : x["end"]]).strip().encode(), {"tag": x["tag"]} | ({k: v.encode() for k, v in x["attrs"].items() if k.isidentifier()} if attributes else {})) for x in tree.done]
    return selected(items, **kw)


@unit("xtxml", f"{_PATHS} -f:format:str", many=True)
def xtxml(data, format=None, **kw):
    """Contents of XML elements by the path of their tags."""

    def walk(e, at):
        name = re.sub(r"\{.*\}", "", e.tag)
        path = f"{at}/{name}" if at else name
        inner = (e.text or "") + "".join(ElementTree.tostring(c, "unicode") for c in e)
        yield path, inner.strip().encode(), {re.sub(r"\{.*\}", "", k): v.encode() for k, v in e.attrib.items() if re.sub(r"\{.*\}", "", k).isidentifier()}
        for c in e:
            yield from walk(c, path)

    return selected(walk(ElementTree.fromstring(data), ""), **kw)


@paths_unit("xtmail", "Headers, bodies and attachments of a mail.")
def xtmail(data):
    mail = email.message_from_bytes(data, policy=email.policy.default)
    out = [("headers.txt", "\n".join(f"{k}: {v}" for k, v in mail.items()).encode(), {}), ("headers.json", dumped({k: str(v) for k, v in mail.items()}), {})]
    for i, part in enumerate(p for p in mail.walk() if not p.is_multipart()):
        body = part.get_payload(decode=True) or b""
        name = part.get_filename()
        kind = part.get_content_type()
        if name:
            out.append((f"attachments/{name}", body, {"mime": kind.encode()}))
        else:
            out.append((f"body.{'html' if kind == 'text/html' else 'txt'}" if kind.startswith("text/") else f"part{i}.bin", body, {"mime": kind.encode()}))
    return out


def _http(data: bytes) -> tuple[bytes, dict[str, str], bytes]:
    head, _, body = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    headers = {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in (x.partition(b":") for x in lines)}
    if headers.get("transfer-encoding", "").lower() == "chunked":
        out, at = b"", 0
        while at < len(body):
            end = body.find(b"\r\n", at)
            n = int(body[at:end].split(b";")[0] or b"0", 16) if end >= 0 else 0
            if not n:
                break
            out, at = out + body[end + 2 : end + 2 + n], end + 4 + n
        body = out
    elif headers.get("content-length", "").isdigit():
        body = body[: int(headers["content-length"])]
    coding = headers.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip"):
        body = gzip.decompress(body)
    elif coding == "deflate":
        body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
    return first, headers, body


@unit("httpresponse", "")
def httpresponse(data):
    """The body of an HTTP response."""
    return _http(data)[2]


@unit("httprequest", "", many=True)
def httprequest(data):
    """What a POST request sends: its parts, form fields or body."""
    import urllib.parse

    _, headers, body = _http(data)
    kind = headers.get("content-type", "")
    if kind.startswith("multipart/"):
        mail = email.message_from_bytes(f"Content-Type: {kind}\r\n\r\n".encode() + body)
        for part in mail.walk():
            if not part.is_multipart():
                yield part.get_payload(decode=True) or b"", {"name": (part.get_param("name", header="content-disposition") or "").encode()}
    elif kind.startswith("application/x-www-form-urlencoded"):
        for k, v in urllib.parse.parse_qsl(body.decode("latin-1"), True):
            yield v.encode("latin-1"), {"name": k.encode()}
    else:
        yield body


# ---------------------------------------------------------------- archives
@paths_unit("xtzip", "Files of a zip archive.", lambda d: d[:4] == b"PK\3\4")
def xtzip(data, pwd=None):
    z = zipfile.ZipFile(io.BytesIO(data))

    def body(i):
        def read():
            if i.file_size > LIMIT:
                raise ValueError("a member is too large")
            return z.read(i, pwd or None)

        return read

    return [(i.filename, body(i), {"date": dt.datetime(*i.date_time).isoformat(" ").encode()} if i.date_time[1] else {}) for i in z.infolist() if not i.is_dir()]


@xtzip.reverse
def _(data, **_):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("data"), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


@paths_unit("xttar", "Files of a tar archive, also compressed.", lambda d: d[257:262] == b"ustar")
def xttar(data):
    t = tarfile.open(fileobj=io.BytesIO(data))
    return [(m.name, (lambda m=m: t.extractfile(m).read(LIMIT)), {"date": dt.datetime.fromtimestamp(m.mtime, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S").encode()}) for m in t.getmembers() if m.isfile()]


@paths_unit("xtgz", "The file of a gzip archive.", lambda d: d[:2] == b"\x1f\x8b")
def xtgz(data):
    name, at = "data", 10
    if data[3] & 4:
        at += 2 + struct.unpack_from("<H", data, at)[0]
    if data[3] & 8:
        name = data[at : data.index(b"\0", at)].decode("latin-1")
    return [(name, lambda: gzip.decompress(data), {})]


@paths_unit("xtcpio", "Files of a CPIO archive.")
def xtcpio(data):
    at, out = 0, []
    while at < len(data):
        if data[at : at + 6] in (b"070701", b"070702"):
            f = [int(data[at + 6 + 8 * i : at + 14 + 8 * i], 16) for i in range(13)]
            size, n, start = f[6], f[11], at + 110
            name = data[start : start + n - 1].decode("utf-8", "replace")
            body = (start + n + 3) // 4 * 4
            at = (body + size + 3) // 4 * 4
        elif data[at : at + 6] == b"070707":
            n, size = int(data[at + 59 : at + 65], 8), int(data[at + 65 : at + 76], 8)
            name, body = data[at + 76 : at + 75 + n].decode("utf-8", "replace"), at + 76 + n
            at = body + size
        else:
            break
        if name == "TRAILER!!!":
            break
        if size:
            out.append((name, data[body : body + size], {}))
    return out


@paths_unit("xtasar", "Files of an ASAR archive.")
def xtasar(data):
    n = struct.unpack_from("<I", data, 12)[0]
    head, base = json.loads(data[16 : 16 + n]), 8 + struct.unpack_from("<I", data, 4)[0]

    def walk(node, at):
        for name, x in node.get("files", {}).items():
            path = f"{at}/{name}" if at else name
            if "files" in x:
                yield from walk(x, path)
            elif "offset" in x:
                start = base + int(x["offset"])
                yield path, data[start : start + x["size"]], {}

    return walk(head, "")


@unit("xtmagtape", "", many=True)
def xtmagtape(data):
    """Files of a SIMH tape: runs of records between marks."""
    at, parts = 0, []
    while at + 4 <= len(data):
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
        if n == 0xFFFFFFFF:
            break
        if n & 0xFFFFFF:
            n &= 0xFFFFFF
            parts.append(data[at : at + n])
            at += n + n % 2 + 4
        elif parts:
            yield b"".join(parts)
            parts = []
    if parts:
        yield b"".join(parts)


@paths_unit("xtiso", "Files of an ISO 9660 image, with Joliet names if there are any.")
def xtiso(data):
    roots = {}
    for sector in range(16, 64):
        d = data[2048 * sector : 2048 * sector + 2048]
        if d[1:6] != b"CD001" or d[0] == 255:
            break
        if d[0] in (1, 2):
            roots[d[0]] = d[156:190]
    wide = 2 in roots

    def walk(record, at, depth=0):
        start, size = struct.unpack_from("<I", record, 2)[0], struct.unpack_from("<I", record, 10)[0]
        block, pos = data[2048 * start : 2048 * start + size], 0
        while pos < len(block) and depth < 32:
            n = block[pos]
            if not n:
                pos = (pos // 2048 + 1) * 2048
                continue
            r = block[pos : pos + n]
            raw = r[33 : 33 + r[32]]
            pos += n
            if raw in (b"\0", b"\1"):
                continue
            name = (raw.decode("utf-16be", "replace") if wide else raw.decode("latin-1")).split(";")[0]
            path = f"{at}/{name}" if at else name
            if r[25] & 2:
                yield from walk(r, path, depth + 1)
            else:
                a, s = struct.unpack_from("<I", r, 2)[0], struct.unpack_from("<I", r, 10)[0]
                yield path, data[2048 * a : 2048 * a + s], {}

    return walk(roots[2 if wide else 1], "")


@paths_unit("xt", "Files of any archive that is recognised.")
def xt(data, pwd=None):
    if data[:4] == b"PK\3\4":
        from millrace.functions.registry import UNITS

        return [(m.get("path", b"data").decode(), b, {}) for b, m in UNITS["xtzip"](data, pwd=pwd)]
    try:
        return [(m.name, tar.extractfile(m).read(LIMIT), {}) for tar in [tarfile.open(fileobj=io.BytesIO(data))] for m in tar.getmembers() if m.isfile()]
    except tarfile.TarError:
        pass
    if data[:2] == b"\x1f\x8b":
        return [("data", gzip.decompress(data), {})]
    if data[:3] == b"BZh":
        return [("data", bz2.decompress(data), {})]
    from millrace.functions.registry import UNITS

    for name in ("xtcpio", "xtasar", "xtiso", "xtsql"):
        try:
            if found := [(m["path"].decode(), b, {}) for b, m in UNITS[name](data)]:
                return found
        except Exception:  # noqa: BLE001  any failure means another format
            continue
    raise ValueError("no archive that is known")


# ---------------------------------------------------------------- images, office, registry
@paths_unit("png", "Chunks of a PNG image.")
def png(data):
    at, out = 8, []
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        out.append((kind.decode("latin-1"), data[at + 8 : at + 8 + n], {}))
        at += 12 + n
    return out


@paths_unit("jpeg", "Segments of a JPEG image.")
def jpeg(data):
    at, out = 2, []
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        n = struct.unpack_from(">H", data, at + 2)[0]
        name = f"APP{kind - 0xE0}" if 0xE0 <= kind <= 0xEF else {0xDA: "SOS", 0xDB: "DQT", 0xC4: "DHT", 0xFE: "COM", 0xC0: "SOF0", 0xC2: "SOF2", 0xDD: "DRI"}.get(kind, f"{kind:02X}")
        if kind == 0xDA:
            end = data.rfind(b"\xff\xd9")
            out.append((name, data[at + 2 + n : end if end > 0 else len(data)], {}))
            break
        out.append((name, data[at + 4 : at + 2 + n], {}))
        at += 2 + n
    return out


_XL = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


@unit("xlxtr", "*references:str", many=True)
def xlxtr(data, references=()):
    """Cells of a workbook by references such as A1, A1:B4, R1.C2 or Sheet#A1."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in si.iter(f"{{{_XL['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    rels = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    sheets = [(s.get("name"), rels[s.get(f"{{{_XL['r']}}}id")]) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_XL['m']}}}sheet")]
    wanted = [_reference(r) for r in references] or [(None, 1, 1, 1 << 20, 1 << 14)]
    for index, (name, path) in enumerate(sheets, 1):
        cells = {}
        for c in ElementTree.fromstring(z.read(f"xl/{path}")).iter(f"{{{_XL['m']}}}c"):
            v, inline = c.find("m:v", _XL), c.find("m:is", _XL)
            text = shared[int(v.text)] if c.get("t") == "s" and v is not None else v.text if v is not None else "".join(t.text or "" for t in inline.iter(f"{{{_XL['m']}}}t")) if inline is not None else None
            if text is not None:
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r"))
                cells[int(m[2]), _column(m[1])] = text
        for sheet, r1, c1, r2, c2 in wanted:
            if sheet is None or sheet in (name, str(index)):
                for (r, c), text in sorted(cells.items()):
                    if r1 <= r <= r2 and c1 <= c <= c2:
                        yield text.encode(), {"row": r, "col": c, "sheet": name.encode(), "ref": f"R{r}.C{c}".encode()}


def _column(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _reference(text: str):
    sheet, _, ref = text.rpartition("#")
    cell = lambda t: (int(m[1]), int(m[2])) if (m := re.fullmatch(r"R(\d+)\.C(\d+)", t)) else (int(m[2]), _column(m[1])) if (m := re.fullmatch(r"([A-Z]+)(\d+)", t)) else None
    a, _, b = ref.partition(":")
    start = cell(a)
    if start is None:
        return (text, 1, 1, 1 << 20, 1 << 14)
    return (sheet or None, *start, *(cell(b) if b else start))


@unit("doctxt", "")
def doctxt(data):
    """The text of a Word document (DOCX)."""
    doc = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    lines = []
    for p in doc.iter(f"{w}p"):
        lines.append("".join(x.text or "" if x.tag == f"{w}t" else "\t" if x.tag == f"{w}tab" else "\n" if x.tag == f"{w}br" else "" for x in p.iter()))
    return "\n".join(lines).encode()


@paths_unit("winreg", "Values of a registry export.")
def winreg(data):
    text = data.decode("utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig", "replace")
    text, key, out = re.sub(r"\\\r?\n\s*", "", text), "", []
    for line in text.splitlines():
        if m := re.fullmatch(r"\[(-?)(.+)\]", line.strip()):
            key = m[2]
        elif m := re.match(r"(?:@|\"((?:[^\"\\]|\\.)*)\")=(.*)$", line.strip()):
            name, raw = m[1] or "@", m[2]
            name = re.sub(r"\\(.)", r"\1", name)
            if raw.startswith('"'):
                value = re.sub(r"\\(.)", r"\1", raw[1:-1]).encode()
            elif raw.startswith("dword:"):
                value = str(int(raw[6:], 16)).encode()
            elif h := re.match(r"hex(?:\(([0-9a-fA-F]+)\))?:(.*)", raw):
                value = bytes.fromhex(h[2].replace(",", ""))
                if h[1] in ("1", "2"):
                    value = value.decode("utf-16le", "replace").rstrip("\0").encode()
                elif h[1] == "7":
                    value = "\n".join(x for x in value.decode("utf-16le", "replace").split("\0") if x).encode()
                elif h[1] == "b":
                    value = str(int.from_bytes(value, "little")).encode()
            else:
                continue
            out.append(("/".join([*key.split("\\"), name]), value, {}))
    return out


# ---------------------------------------------------------------- captures
def packets(data: bytes):
    """(time in seconds, link type, frame) of PCAP and PCAP-NG files."""
    if data[:4] == b"\x0a\x0d\x0d\x0a":
        at, order, links = 0, "<", []
        while at + 12 <= len(data):
            kind = struct.unpack_from("<I", data, at)[0]
            if kind == 0x0A0D0D0A:
                order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
            kind, size = struct.unpack_from(f"{order}II", data, at)
            if kind == 1:
                links.append(struct.unpack_from(f"{order}H", data, at + 8)[0])
            elif kind == 6:
                link, high, low, n = struct.unpack_from(f"{order}4I", data, at + 8)
                yield (high << 32 | low) / 1e6, links[link], data[at + 28 : at + 28 + n]
            elif kind == 3:
                yield 0.0, links[0], data[at + 12 : at + size - 4]
            at += max(size, 12)
        return
    order = "<" if data[:4] in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    fine = 1e9 if data[:4] in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e6
    link, at = struct.unpack_from(f"{order}I", data, 20)[0], 24
    while at + 16 <= len(data):
        s, u, n, _ = struct.unpack_from(f"{order}4I", data, at)
        yield s + u / fine, link, data[at + 16 : at + 16 + n]
        at += 16 + n


def network(frame: bytes, link: int) -> bytes:
    """The network layer of a frame of Ethernet, loopback or raw links."""
    if link == 1:
        at = 12
        while frame[at : at + 2] in (b"\x81\x00", b"\x88\xa8"):
            at += 4
        return frame[at + 2 :]
    return frame[4:] if link in (0, 108) else frame[16:] if link == 113 else frame


def transport(packet: bytes) -> tuple[int, str, str, bytes] | None:
    """(protocol, source, destination, payload) of IPv4 and IPv6."""
    import ipaddress

    if packet[:1] and packet[0] >> 4 == 4:
        n, total = 4 * (packet[0] & 15), struct.unpack_from(">H", packet, 2)[0]
        return packet[9], str(ipaddress.ip_address(packet[12:16])), str(ipaddress.ip_address(packet[16:20])), packet[n : total or None]
    if packet[:1] and packet[0] >> 4 == 6:
        return packet[6], str(ipaddress.ip_address(packet[8:24])), str(ipaddress.ip_address(packet[24:40])), packet[40 : 40 + struct.unpack_from(">H", packet, 4)[0]]
    return None


@unit("pcap", "-l:link", many=True)
def pcap(data, link=False):
    """The packets of a capture, from the network layer on."""
    for when, kind, frame in packets(data):
        stamp = dt.datetime.fromtimestamp(when, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S").encode()
        yield (frame if link else network(frame, kind)), {"time": stamp, "link": kind}


@unit("udp", "", many=True)
def udp(data):
    """The datagram of a packet."""
    found = transport(data)
    if found and found[0] == 17:
        sport, dport, n = struct.unpack_from(">3H", found[3])
        yield found[3][8:n], {"src": f"{found[1]}:{sport}".encode(), "dst": f"{found[2]}:{dport}".encode()}


def segments(data: bytes):
    found = transport(data)
    if found and found[0] == 6:
        sport, dport, seq, ack, offset, flags = struct.unpack_from(">HHIIBB", found[3])
        return f"{found[1]}:{sport}", f"{found[2]}:{dport}", seq, flags, found[3][offset >> 4 << 2 :]
    return None


def reassembled(packets_: list[bytes]):
    """(source, destination, bytes, whether the source is the client) of each direction of each connection, in the order of their first packet."""
    flows: dict[tuple[str, str], list[tuple[int, bytes]]] = {}
    clients: dict[frozenset, str] = {}
    for p in packets_:
        if (s := segments(p)) is None:
            continue
        src, dst, seq, flags, body = s
        if flags & 2 and not flags & 16:
            clients[frozenset((src, dst))] = src
        flow = flows.setdefault((src, dst), [])
        flow.append((seq + (1 if flags & 2 else 0), body))
    for (src, dst), parts in flows.items():
        out, base = bytearray(), min(seq for seq, _ in parts)
        for seq, body in sorted(parts, key=lambda x: (x[0], -len(x[1]))):
            at = seq - base
            if at + len(body) > len(out) and at <= len(out):
                out += body[len(out) - at :]
        if out:
            client = clients.get(frozenset((src, dst)), max(src, dst, key=lambda x: int(x.rsplit(":", 1)[1])))
            yield src, dst, bytes(out), client == src


@unit("tcp", "-m:merge -c:client -s:server", many=True)
def tcp(data, merge=False, client=False, server=False):
    """The streams of the packets of a frame; over frames this is a grouped operator, here of the packets of one chunk."""
    found = [*reassembled([data])]
    for src, dst, body, first in found:
        if (client and not first) or (server and first):
            continue
        yield body, {"src": src.encode(), "dst": dst.encode(), "client": int(first)}


@unit("http", "", many=True)
def http(data):
    """Bodies of the HTTP messages of a stream."""
    for m in re.split(rb"(?=(?:GET|POST|PUT|HEAD|DELETE|OPTIONS|PATCH) \S+ HTTP/1\.\d\r\n|HTTP/1\.\d \d{3})", data):
        if b"\r\n\r\n" in m and (m[:5] == b"HTTP/" or re.match(rb"[A-Z]+ \S+ HTTP/", m)):
            first, _, body = _http(m)
            if body:
                yield body, {"type": b"response" if first.startswith(b"HTTP/") else b"request"}


# ---------------------------------------------------------------- executables
def pe_parts(data: bytes) -> dict:
    """Headers and sections of a PE file."""
    pe = struct.unpack_from("<I", data, 60)[0]
    if data[:2] != b"MZ" or data[pe : pe + 4] != b"PE\0\0":
        raise ValueError("no PE file")
    machine, count, stamp, _, _, optional, flags = struct.unpack_from("<HHIIIHH", data, pe + 4)
    magic = struct.unpack_from("<H", data, pe + 24)[0]
    wide = magic == 0x20B
    entry = struct.unpack_from("<I", data, pe + 40)[0]
    base = struct.unpack_from("<Q" if wide else "<I", data, pe + (48 if wide else 52))[0]
    table = pe + 24 + optional
    names = ("vsize", "vaddr", "size", "offset")
    sections = [{"name": data[table + 40 * i : table + 40 * i + 8].rstrip(b"\0").decode("latin-1")} | dict(zip(names, struct.unpack_from("<4I", data, table + 40 * i + 8), strict=True)) for i in range(count)]
    at = pe + 24 + (112 if wide else 96)
    n = struct.unpack_from("<I", data, at - 4)[0]
    directories = [struct.unpack_from("<II", data, at + 8 * i) for i in range(min(n, 16))]
    return {"machine": machine, "stamp": stamp, "flags": flags, "wide": wide, "entry": entry, "base": base, "sections": sections, "directories": directories, "pe": pe, "optional": pe + 24}


def pe_end(data: bytes, certificate: bool = True) -> int:
    p = pe_parts(data)
    end = max((s["offset"] + s["size"] for s in p["sections"]), default=0)
    if certificate and len(p["directories"]) > 4 and p["directories"][4][0]:
        end = max(end, sum(p["directories"][4]))
    return min(end, len(data))


_OVERLAY = "-c:certificate -d:directories -m:memdump"


@unit("peoverlay", _OVERLAY)
def peoverlay(data, certificate=False, directories=False, memdump=False):
    """What follows a PE file."""
    return data[pe_end(data, not certificate) :]


@unit("pestrip", _OVERLAY)
def pestrip(data, certificate=False, directories=False, memdump=False):
    """A PE file without what follows it."""
    return data[: pe_end(data, not certificate)]


@unit("pesig", "")
def pesig(data):
    """The signature of a PE file."""
    at, n = pe_parts(data)["directories"][4]
    if not at:
        raise ValueError("no signature")
    return data[at + 8 : at + struct.unpack_from("<I", data, at)[0]] if n else b""


@unit("pemeta", "-t:tabular")
def pemeta(data, tabular=False):
    """Headers of a PE file as JSON."""
    p = pe_parts(data)
    stamp = dt.datetime.fromtimestamp(p["stamp"], dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
    return dumped({"Header": {"Machine": f"0x{p['machine']:04X}", "Type": "DLL" if p["flags"] & 0x2000 else "EXE", "Bits": 64 if p["wide"] else 32, "ImageBase": f"0x{p['base']:X}", "EntryPoint": f"0x{p['entry']:X}"}, "TimeStamp": {"Linker": stamp}, "Sections": p["sections"]})


@unit("pecdb", "")
def pecdb(data):
    """A PE file without address randomisation and forced integrity."""
    at = pe_parts(data)["optional"] + 70
    flags = struct.unpack_from("<H", data, at)[0] & ~0x00E0
    return data[:at] + struct.pack("<H", flags) + data[at + 2 :]


def exe_sections(data: bytes):
    """(name, virtual address, bytes) of PE and ELF files."""
    if data[:2] == b"MZ":
        p = pe_parts(data)
        return [(s["name"], p["base"] + s["vaddr"], data[s["offset"] : s["offset"] + s["size"]]) for s in p["sections"]]
    if data[:4] != b"\x7fELF":
        raise ValueError("no PE or ELF file")
    wide, o = data[4] == 2, "<" if data[5] == 1 else ">"
    if wide:
        at, (size, count, names) = struct.unpack_from(f"{o}Q", data, 40)[0], struct.unpack_from(f"{o}3H", data, 58)
        rows = [struct.unpack_from(f"{o}IIQQQQ", data, at + i * size) for i in range(count)]
    else:
        at, (size, count, names) = struct.unpack_from(f"{o}I", data, 32)[0], struct.unpack_from(f"{o}3H", data, 46)
        rows = [struct.unpack_from(f"{o}6I", data, at + i * size) for i in range(count)]
    table = data[rows[names][4] :]
    return [(table[r[0] : table.index(b"\0", r[0])].decode("latin-1"), r[3], b"" if r[1] == 8 else data[r[4] : r[4] + r[5]]) for r in rows if r[1]]


@paths_unit("vsect", "Sections of PE and ELF files.")
def vsect(data):
    return [(name, body, {"vaddr": at, "vsize": len(body)}) for name, at, body in exe_sections(data)]


@unit("vsnip", "*addresses:str -b:base:int", many=True)
def vsnip(data, addresses=(), base=None):
    """Bytes at virtual addresses, as start:length."""
    for a in addresses:
        start, _, n = a.partition(":")
        at = int(start, 0)
        for _, low, body in exe_sections(data):
            if low <= at < low + len(body):
                part = body[at - low :]
                yield (part[: int(n, 0)] if n else part), {"offset": at}


@unit("jvstr", "", many=True)
def jvstr(data):
    """String constants of a Java class file."""
    if data[:4] != b"\xca\xfe\xba\xbe":
        raise ValueError("no class file")
    n, at, texts, refs, i = struct.unpack_from(">H", data, 8)[0], 10, {}, [], 1
    while i < n:
        kind = data[at]
        if kind == 1:
            size = struct.unpack_from(">H", data, at + 1)[0]
            texts[i], at = data[at + 3 : at + 3 + size], at + 3 + size
        else:
            if kind == 8:
                refs.append(struct.unpack_from(">H", data, at + 1)[0])
            at += {3: 5, 4: 5, 5: 9, 6: 9, 7: 3, 8: 3, 9: 5, 10: 5, 11: 5, 12: 5, 15: 4, 16: 3, 17: 5, 18: 5, 19: 3, 20: 3}[kind]
            i += kind in (5, 6)
        i += 1
    for r in refs:
        yield texts[r]


@unit("dexstr", "", many=True)
def dexstr(data):
    """Strings of a DEX file."""
    n, at = struct.unpack_from("<II", data, 56)
    for (where,) in struct.iter_unpack("<I", data[at : at + 4 * n]):
        while data[where] & 0x80:
            where += 1
        yield data[where + 1 : data.index(b"\0", where + 1)]


@xj0.column
def _(c, fmt=(), all=False, one=False, raw=False):
    """One field that is named, without variables."""
    if len(fmt) != 1 or not one or not fmt[0].isidentifier():
        return None
    return F.encode(F.get_json_object(latin(c), f"$.{fmt[0]}"), "UTF-8")
