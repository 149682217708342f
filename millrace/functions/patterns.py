"""Named patterns, extraction by regular expressions, carving of files, and binary structures."""

from __future__ import annotations

import ipaddress
import re
import struct as structlib
import urllib.parse
from collections.abc import Iterator
from email.header import decode_header

from pyspark.sql import functions as F

from millrace.functions.registry import UNITS, unit
from millrace.functions.strings import latin, unlatin
from millrace.functions.wallets import SHAPES, addresses

_TLD = r"(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|mobi|pro|aero|coop|museum|xyz|top|site|online|shop|club|app|dev|cloud|live|tech|store|space|icu|vip|work|link|click|onion|arpa|bit|example|test|local|localhost|internal|fun|today|world|news|blog|agency|email|digital|media|network|systems|group|life|one|page|wiki|zone)"
_LABEL = r"[a-zA-Z0-9_](?:[-a-zA-Z0-9_]{0,61}[a-zA-Z0-9])?"
_DOMAIN = rf"(?:{_LABEL}\.)+(?i:{_TLD})(?![-\w])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)"
_IPV6 = r"(?<![0-9a-fA-F:])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?::(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,6})?)(?![0-9a-fA-F:])"
_HOST = rf"(?:{_IPV4}|{_DOMAIN})"
_INT = r"[-+]?(?:0[bB][01]+|0[xX][0-9a-fA-F]+|0[oO][0-7]+|[1-9][0-9]*|0)"
_FLOAT = r"[-+]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_NUM = rf"(?:{_FLOAT}|{_INT})"
_STR = r"(?:\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*')"
_NIX = r"(?:/[\w.@+~-]+(?: [\w.@+~-]+)*)+/?"
_NIXT = r"(?:/[\w.@+~-]+)+/?"
_WIN = r"(?:[a-zA-Z]:|\\\\[\w.-]+|%\w+%)(?:\\[^\\/:*?\"<>|\r\n\t]+)+"
_WINT = r"(?:[a-zA-Z]:|\\\\[\w.-]+|%\w+%)(?:\\[^\\/:*?\"<>|\s]+)+"
_B58 = "[1-9A-HJ-NP-Za-km-z]"


def _array(item: str) -> str:
    return rf"(?:{item})(?:\s*[;,]\s*(?:{item}))+"


FORMATS = {
    "json": r"[\[{][\s\S]*[\]}]", "integer": _INT, "float": _FLOAT, "number": _NUM, "string": _STR, "cmdstr": r"\"(?:[^\"^]|\^.|\"\")*\"", "ps1str": r"\"(?:[^\"`]|`[\s\S]|\"\")*\"|'(?:[^']|'')*'", "vbastr": r"\"(?:[^\"\r\n]|\"\")*\"", "vbaint": r"(?:&[hH][0-9a-fA-F]+|[-+]?[0-9]+)",
    "printable": r"[\s!-~]+", "urlquote": r"(?:%[0-9a-fA-F]{2}|[-\w.~+])+", "urlhex": r"(?:%[0-9a-fA-F]{2})+", "htmlesc": r"(?:&(?:#[0-9]+|#[xX][0-9a-fA-F]+|\w+);)+", "intarray": _array(_INT), "strarray": _array(_STR), "numarray": _array(_NUM), "hexarray": _array("[0-9A-Fa-f]{2}"),
    "letters": "[a-zA-Z]+", "wshenc": r"#@~\^[ -~]{6}==[\s\S]*?[ -~]{6}==\^#~@", "alnum": "[a-zA-Z0-9]+", "base32": "(?:[A-Z2-7]+|[a-z2-7]+)={0,6}", "base58": f"{_B58}+", "base62": "[0-9A-Za-z]+", "base64": r"(?:[0-9a-zA-Z+/]{4})+(?:[0-9a-zA-Z+/]{2,3}={0,2})?", "base85": r"[-!+*()#-&^-~0-9;-Z]+", "ascii85": "[!-u]+",
    "z85": r"[-0-9a-zA-Z.:+=^!/*?&<>()\[\]{}@%$#]+", "base92": r"[!#-_a-}]+", "base64u": r"(?:[-\w]{4})+(?:[-\w]{2,3}={0,3})?", "hex": "(?:[0-9a-fA-F]{2})+", "base16": "(?:[0-9A-F]{2})+", "base16s": r"[0-9a-fA-F]+(?:\s*[0-9a-fA-F]+)*", "base64s": r"[-\s\w+/]+={0,3}", "base85s": r"[-!+*()#-&^-~0-9;-Z\s]+", "a85s": r"[!-u\s]+",
    "z85s": r"[-\s0-9a-zA-Z.:+=^!/*?&<>()\[\]{}@%$#]+", "utf8": r"(?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3})+", "hexdump": r"(?:(?:[0-9a-fA-F]{4,}[:\s]\s*)?(?:[0-9a-fA-F]{2}\s+){1,}.*(?:\r?\n|$))+", "uuenc": r"begin \d{3} [^\r\n]*\r?\n(?:[!-`][^\r\n]*\r?\n)+end",
}
ALIASES = {
    "flt": "float", "int": "integer", "num": "number", "str": "string", "b32": "base32", "b58": "base58", "b62": "base62", "b64": "base64", "b85": "base85", "b92": "base92", "a85": "ascii85", "b16": "base16", "b64u": "base64u", "b16s": "base16s", "b64s": "base64s", "b85s": "base85s", "ps": "printable", "hd": "hexdump",
    "uq": "urlquote", "uh": "urlhex", "hostname": "host",
}
INDICATORS = {
    "date": r"\d{4}[-/.]\d{2}[-/.]\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?)?|\d{1,2}[-/. ](?:\d{1,2}|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[-/. ]\d{4}", "domain": _DOMAIN, "email": rf"[a-zA-Z0-9][\w.%+-]{{0,63}}@{_DOMAIN}", "guid": r"\{?[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\}?", "ipv4": _IPV4, "ipv6": _IPV6,
    "host": rf"{_HOST}(?::\d{{1,5}})?", "socket": rf"{_HOST}:\d{{1,5}}", "url": rf"[a-zA-Z][a-zA-Z0-9+.-]{{1,18}}://(?:[\w.%+-]+(?::[^\s@/]*)?@)?(?:{_HOST}|{_LABEL})(?::\d{{1,5}})?(?:/[\w/.,~%+@:!$&'()*;=\-]*)?(?:\?[\w/.,~%+@:!$&'()*;=?\-]*)?(?:#[\w/.,~%+@:!$&'()*;=?\-]*)?", "md5": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{32}(?![0-9A-Fa-f])", "sha1": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{40}(?![0-9A-Fa-f])",
    "sha256": r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64}(?![0-9A-Fa-f])", "subdomain": rf"(?:{_LABEL}\.){{2,}}(?i:{_TLD})(?![-\w])", "pem": r"-----BEGIN [A-Z0-9 ]+-----[\s\S]+?-----END [A-Z0-9 ]+-----", "path": rf"(?:{_WIN}|{_NIX})", "nixpath": _NIX, "winpath": _WIN, "tpath": rf"(?:{_WINT}|{_NIXT})", "nixtpath": _NIXT, "wintpath": _WINT, "evar": r"%[a-zA-Z_][\w()]*%",
}
NAMED = FORMATS | INDICATORS | {k: FORMATS[v] for k, v in ALIASES.items() if v in FORMATS} | {"hostname": INDICATORS["host"]}


def expanded(regex: str) -> str:
    """``(??name)`` stands for a named pattern, ``(??name:more)`` too, without more."""
    return re.sub(r"\(\?\?(\w+)(?::[^)]*)?\)", lambda m: f"(?:{(NAMED | SHAPES)[m[1]]})", regex)


def compiled(regex: str | bytes, multiline: bool = False, ignorecase: bool = False) -> re.Pattern[bytes]:
    text = regex.decode("latin-1") if isinstance(regex, bytes) else regex
    return re.compile(expanded(text).encode("latin-1"), re.S | (re.M if multiline else 0) | (re.I if ignorecase else 0))


_LIMITS = "-n:min:int=1 -m:max:int=0 -N:len:int=0 -s:stripspace -q:unique -l:longest -t:take:int=0"


_size = len


def chosen(found: Iterator[tuple[bytes, dict]], min=1, max=0, len=0, stripspace=False, unique=False, longest=False, take=0) -> list[tuple[bytes, dict]]:
    """By size, without repeats, the longest first, or the longest ``take`` in their order."""
    out, seen, size = [], set(), _size
    for value, meta in found:
        if stripspace:
            value = re.sub(rb"\s+", b"", value)
        n = size(value)
        if n < (min or 0) or (max and n > max) or (len and n != len) or (unique and value in seen):
            continue
        seen.add(value)
        out.append((value, meta))
        if take and not longest and size(out) == take:
            break
    if longest and take:
        keep = sorted(sorted(range(size(out)), key=lambda i: -size(out[i][0]))[:take])
        return [out[i] for i in keep]
    return sorted(out, key=lambda x: -size(x[0])) if longest else out


def wide_runs(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Runs of printable characters in UTF-16LE, without their zeros, and where they start."""
    for m in re.finditer(rb"(?:[\x09\x0A\x0D\x20-\x7E]\x00){4,}", data):
        yield m.start(), m[0][::2]


@unit("rex", f"regex:regex *transformation:str -M:multiline -I:ignorecase -u:unicode {_LIMITS}", many=True)
def rex(data, regex, transformation=(), multiline=False, ignorecase=False, unicode=False, **limits):
    """Matches; named groups are variables. Templates may use {0} for the match, {1} and {name} for groups."""
    pattern = compiled(regex, multiline, ignorecase)

    def found():
        for m in pattern.finditer(data):
            meta = {k: v for k, v in m.groupdict().items() if v is not None} | {"offset": m.start()}
            if not transformation:
                yield m[0], meta
            for t in transformation:
                used: set[str] = set()

                def field(f, m=m, used=used):
                    name = f[1]
                    used.add(name)
                    return (m[int(name)] if name.isdigit() else m[name]) or b""

                body = re.sub(rb"\{(\w+)\}", lambda f: field((f[0], f[1].decode())), t.encode("latin-1"))
                yield body, {k: v for k, v in meta.items() if k not in used}

    yield from chosen(found(), **limits)


@unit("resplit", "regex:regex=\\r?\\n -M:multiline -I:ignorecase -c:count:int=0", many=True)
def resplit(data, regex=r"\r?\n", multiline=False, ignorecase=False, count=0):
    """The pieces between matches; groups stand between them."""
    return [(p or b"", {}) for p in compiled(regex or r"\r?\n", multiline, ignorecase).split(data, count or 0)]


@unit("resub", "regex:regex=\\s+ subst? -M:multiline -I:ignorecase -c:count:int=0")
def resub(data, regex=r"\s+", subst=b"", multiline=False, ignorecase=False, count=0):
    """Substitutes matches; {0}, {1} and {name} are the match and its groups."""

    def filled(m):
        return re.sub(rb"\{(\w+)\}", lambda f: (m[int(f[1])] if f[1].isdigit() else m[f[1].decode()]) or b"", subst or b"")

    return compiled(regex or r"\s+", multiline, ignorecase).sub(filled, data, count or 0)


@resub.column
def _(c, regex=r"\s+", subst=b"", multiline=False, ignorecase=False, count=0):
    """The engine of the JVM, for patterns that mean the same to both."""
    text = regex.decode("latin-1") if isinstance(regex, bytes) else regex
    if count or b"{" in (subst or b"") or not re.fullmatch(r"(?:[^\\(|$^]|\\[.stnrx\[\]()*+?-])*", text or r"\s+"):
        return None
    flags = "(?s)" + ("(?m)" if multiline else "") + ("(?i)" if ignorecase else "")
    body = (subst or b"").decode("latin-1").replace("\\", "\\\\").replace("$", "\\$")
    return unlatin(F.regexp_replace(latin(c), flags + (text or r"\s+").replace(r"\s", r"[ \t\n\x0B\f\r]"), body))


def indicators(data: bytes, names) -> Iterator[tuple[bytes, dict]]:
    views = [(0, 1, data), *((at, 2, run) for at, run in wide_runs(data))]
    for name in names:
        pattern = compiled(NAMED[name])
        for at, width, view in views:
            for m in pattern.finditer(view):
                yield m[0], {"offset": at + m.start() * width, "pattern": name}


def plausible(value: bytes, name: str, level: int) -> bool:
    """Levels above 0 drop more and more of what only looks like an indicator."""
    text = value.decode("latin-1")
    if name == "ipv4" and level:
        ip = ipaddress.ip_address(text)
        return ip.is_global and sum(int(x) < 10 for x in text.split(".")) < 3
    if name in ("domain", "host", "subdomain") and level:
        labels = text.split(":")[0].split(".")
        return level < 2 or all(len(x) > 2 for x in labels[:-1]) and (level < 3 or len(labels[-2]) > 3)
    if name == "email":
        return len(text.split("@")[0]) >= 3 or not level
    return True


@unit("xtp", f"*pattern:str -f:filter:int=0 -d:duplicates {_LIMITS.replace(' -q:unique', '')}", many=True)
def xtp(data, pattern=(), filter=0, duplicates=False, **limits):
    """Indicators: hosts, urls and e-mail addresses, or those that are named."""
    names = [n for n in INDICATORS if any(re.fullmatch(p.replace("*", ".*"), n) for p in pattern)] if pattern else ["host", "url", "email"]

    def found():
        for value, meta in indicators(data, names):
            if meta["pattern"] in ("url", "path", "nixpath", "winpath"):
                value = value.rstrip(b".,;:!'\"")
                if value.endswith(b")") and value.count(b"(") < value.count(b")"):
                    value = value[:-1]
            if plausible(value, meta["pattern"], filter or 0):
                yield value, meta

    yield from chosen(found(), unique=not duplicates, **limits)


@unit("xtw", f"-d:duplicates {_LIMITS.replace(' -q:unique', '')}", many=True)
def xtw(data, duplicates=False, **limits):
    """Wallet addresses; those of formats with a checksum must fit it."""
    yield from chosen(((x, {"offset": at, "kind": name}) for x, name, at in addresses(data)), unique=not duplicates, **limits)


_DECODERS = {"base64": "b64", "base64s": "b64", "base64u": "b64", "base32": "b32", "base58": "b58", "base62": "b62", "base85": "b85", "ascii85": "a85", "a85s": "a85", "z85": "z85", "z85s": "z85", "base92": "b92", "hex": "hex", "base16": "hex", "base16s": "hex", "hexarray": "hex", "urlquote": "url", "urlhex": "url", "htmlesc": "htmlesc", "string": "esc", "ps1str": "escps", "vbastr": "escvb", "uuenc": "uuenc", "intarray": "pack"}


@unit("carve", f"format:str -d:decode -1:single {_LIMITS}", many=True)
def carve(data, format, decode=False, single=False, **limits):
    """Data in a named format, decoded if asked for; a single one is the longest."""
    name = ALIASES.get(format, format)
    pattern = compiled((NAMED | SHAPES)[name])
    if single:
        limits |= {"longest": True, "take": 1}

    def found():
        for at, width, view in [(0, 1, data), *((at, 2, run) for at, run in wide_runs(data))]:
            for m in pattern.finditer(view):
                yield m[0], {"offset": at + m.start() * width}

    for value, meta in chosen(found(), **limits):
        yield (UNITS[_DECODERS[name]].one(value) if decode and name in _DECODERS else value), meta


@unit("csd", "format:str -s:stripspace", many=True)
def csd(data, format, stripspace=False):
    """The longest piece in a format, decoded."""
    return carve.forward(data, format=format, decode=True, single=True, stripspace=stripspace)


@unit("csb", "format:str -s:stripspace", many=True)
def csb(data, format, stripspace=False):
    """The longest piece in a format."""
    return carve.forward(data, format=format, single=True, stripspace=stripspace)


# ---------------------------------------------------------------- carving of files
def _sized(mark: bytes, size, back: int = 0):
    """For each mark, what a function of the data and the place says is the file's end."""

    def run(data):
        at = data.find(mark)
        while at >= 0:
            try:
                end = size(data, at - back)
            except (structlib.error, IndexError, ValueError):
                end = None
            if end and at - back >= 0 and end <= len(data):
                yield data[at - back : end], {"offset": at - back}
                at = data.find(mark, max(end, at + 1))
            else:
                at = data.find(mark, at + 1)

    return run


def _png(data, at):
    at += 8
    while True:
        n, kind = structlib.unpack_from(">I4s", data, at)
        at += 12 + n
        if kind == b"IEND":
            return at


def _pe(data, at):
    pe = at + structlib.unpack_from("<I", data, at + 60)[0]
    if data[pe : pe + 4] != b"PE\0\0":
        return None
    sections, optional = structlib.unpack_from("<H12xH", data, pe + 6)
    table = pe + 24 + optional
    ends = [sum(structlib.unpack_from("<II", data, table + 40 * i + 16)) for i in range(sections)]
    return at + max(ends, default=0)


def _elf(data, at):
    wide, order = data[at + 4] == 2, "<" if data[at + 5] == 1 else ">"
    offset, size, count = (*structlib.unpack_from(f"{order}Q", data, at + 40), *structlib.unpack_from(f"{order}HH", data, at + 58)) if wide else (*structlib.unpack_from(f"{order}I", data, at + 32), *structlib.unpack_from(f"{order}HH", data, at + 46))
    return at + offset + size * count


def _zip_end(data, at):
    end = data.find(b"PK\5\6", at)
    return end + 22 + structlib.unpack_from("<H", data, end + 20)[0] if end >= 0 else None


def _7z(data, at):
    offset, size = structlib.unpack_from("<QQ", data, at + 12)
    return at + 32 + offset + size


def _tar(data, at):
    while data[at + 257 : at + 262] == b"ustar":
        n = int(data[at + 124 : at + 136].strip(b"\0 ") or b"0", 8)
        at += 512 + -(-n // 512) * 512
    while data[at : at + 512] == bytes(512):
        at += 512
    return at


def _rtf(data, at):
    depth = 0
    for m in re.compile(rb"\\.|[{}]", re.S).finditer(data, at):
        depth += {b"{": 1, b"}": -1}.get(m[0], 0)
        if not depth:
            return m.end()
    return None


def _pdf(data, at):
    following = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, following if following > 0 else len(data))
    return end + 5 if end > 0 else None


def _lnk(data, at):
    flags, at = structlib.unpack_from("<I", data, at + 20)[0], at + 76
    if flags & 1:
        at += 2 + structlib.unpack_from("<H", data, at)[0]
    if flags & 2:
        at += structlib.unpack_from("<I", data, at)[0]
    for bit in range(2, 7):
        if flags >> bit & 1:
            at += 2 + structlib.unpack_from("<H", data, at)[0] * (2 if flags & 0x80 else 1)
    while (n := structlib.unpack_from("<I", data, at)[0]) >= 4:
        at += n
    return at + 4


def _der_end(data, at):
    n, head = data[at + 1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4:
            return None
        n, head = int.from_bytes(data[at + 2 : at + 2 + k], "big"), 2 + k
    end = at + head + n
    if n < 4 or end > len(data):
        return None
    inner = at + head
    while inner < end:  # its parts must fill it
        if data[inner] & 0x1F == 0x1F or inner + 2 > end:
            return None
        m, h = data[inner + 1], 2
        if m & 0x80:
            k = m & 0x7F
            if not 0 < k <= 4:
                return None
            m, h = int.from_bytes(data[inner + 2 : inner + 2 + k], "big"), 2 + k
        inner += h + m
    return end if inner == end else None


def _json(data, all=False):
    at, decoder = 0, __import__("json").JSONDecoder()
    text = data.decode("latin-1")
    while m := re.compile(r"[\[{]").search(text, at):
        try:
            _, end = decoder.raw_decode(text, m.start())
            if all or end - m.start() > 2:
                yield data[m.start() : end], {"offset": m.start()}
            at = end
        except ValueError:
            at = m.start() + 1


def _xml(data):
    from xml.parsers import expat

    for m in re.finditer(rb"<\?xml[\s>]|<[A-Za-z_][\w:.-]*[\s/>]", data):
        parser, depth, stop = expat.ParserCreate(), [0], []

        def ended(_, parser=parser, depth=depth, stop=stop):
            depth[0] -= 1
            if not depth[0]:
                stop.append(parser.CurrentByteIndex)

        parser.StartElementHandler = lambda *_, depth=depth: depth.__setitem__(0, depth[0] + 1)
        parser.EndElementHandler = ended
        try:
            parser.Parse(data[m.start() :], True)
        except expat.ExpatError:
            pass
        if stop:
            close = data.find(b">", m.start() + stop[0]) + 1
            if close > m.start() + 20 or m[0].startswith(b"<?xml"):
                yield data[m.start() : close], {"offset": m.start()}
                return


CARVERS = {
    "carve-png": _sized(b"\x89PNG\r\n\x1a\n", _png), "carve-pe": _sized(b"MZ", _pe), "carve-elf": _sized(b"\x7fELF", _elf), "carve-zip": _sized(b"PK\3\4", _zip_end), "carve-7z": _sized(b"7z\xbc\xaf\x27\x1c", _7z), "carve-tar": _sized(b"ustar", _tar, 257), "carve-rtf": _sized(b"{\\rtf", _rtf), "carve-pdf": _sized(b"%PDF-", _pdf),
    "carve-lnk": _sized(b"L\0\0\0\1\x14\2\0\0\0\0\0\xc0\0\0\0\0\0\0F", _lnk), "carve-der": _sized(b"\x30", _der_end), "carve-xml": _xml,
}
for _name, _work in CARVERS.items():
    UNITS[_name] = unit(_name, "", True)(lambda data, f=_work, **_: f(data))
    UNITS[_name].text = f"Files: {_name[6:]}."


@unit("carve-json", "-a:all", many=True)
def carve_json(data, all=False):
    """JSON documents."""
    return _json(data, all)


@unit("subfiles", "-m:memdump -r:recursive", many=True)
def subfiles(data, memdump=False, recursive=False):
    """Embedded files of all formats that can be carved, by their place."""
    found = [(value, meta | {"kind": name[6:]}) for name, f in CARVERS.items() if name not in ("carve-der", "carve-xml") for value, meta in f(data)]
    yield from sorted(found, key=lambda x: (x[1]["offset"], -len(x[0])))


# ---------------------------------------------------------------- texts with indicators
@unit("defang", "-u:url_only -p:url_protocol -d:dot_only -q:quote_md")
def defang(data, url_only=False, url_protocol=False, dot_only=False, quote_md=False):
    """Takes the sting out of urls, domains and addresses: the last dot in brackets."""
    names = ["url"] if url_only else ["url", "email", "host"]
    pattern = re.compile("|".join(f"(?:{INDICATORS[n]})" for n in names).encode())

    def one(m):
        text = m[0]
        start, _, rest = text.rpartition(b"://")
        host = re.match(rb"[^/?#]*", rest)[0]
        out = (start + b"://" if start else b"") + b"[.]".join(host.rsplit(b".", 1)) + rest[len(host) :]
        if start and url_protocol and not dot_only:
            out = re.sub(rb"^http", b"hxxp", out)
        return b"`" + out + b"`" if quote_md else out

    return pattern.sub(one, data)


@defang.reverse
def _(data, **_):
    data = re.sub(rb"\[(?:\.|dot)\]|\((?:\.|dot)\)", b".", data)
    data = re.sub(rb"\[:?//?\]|\[:\]//", b"://", data)
    return re.sub(rb"\b(?:hxxp|h..p)(s?)(?=://)", rb"http\1", data, flags=re.I).replace(b"fxp://", b"ftp://")


@unit("dnsdomain", _LIMITS, many=True)
def dnsdomain(data, **limits):
    """Domain names as labels with their lengths."""

    def found():
        for m in re.finditer(rb"(?=((?:[\x01-\x3f][-\w]{1,63}){2,}\x00))", data, re.S):
            at, raw, labels = 0, m[1], []
            while raw[at]:
                label = raw[at + 1 : at + 1 + raw[at]]
                if len(label) != raw[at] or not re.fullmatch(rb"[-\w]+", label):
                    labels = []
                    break
                labels.append(label)
                at += 1 + raw[at]
            if len(labels) > 1 and at == len(raw) - 1:
                yield b".".join(labels), {"offset": m.start()}

    yield from chosen(found(), **limits)


@unit("mimewords")
def mimewords(data):
    """Encoded words of mail headers."""
    return "".join(x.decode(c or "utf-8", "replace") if isinstance(x, bytes) else x for x, c in decode_header(data.decode("utf-8", "replace"))).encode()


@unit("urlguards")
def urlguards(data):
    """The urls inside those that mail filters wrap around them."""

    def one(m):
        parts = urllib.parse.urlsplit(m[0].decode("latin-1"))
        query = urllib.parse.parse_qs(parts.query)
        if parts.hostname and parts.hostname.endswith("safelinks.protection.outlook.com") and "url" in query:
            return query["url"][0].encode()
        if parts.hostname and parts.hostname.startswith("urldefense"):
            if "u" in query:
                return urllib.parse.unquote(query["u"][0].replace("-", "%").replace("_", "/")).encode()
            if v := re.search(r"/v3/__(.+?)__;", m[0].decode("latin-1")):
                return v[1].encode()
        return m[0]

    pattern, before = re.compile(rb"https?://[^\s\"'<>]+"), None
    while data != before:
        before, data = data, pattern.sub(one, data)
    return data


# ---------------------------------------------------------------- structures
def parse_spec(spec: str) -> list[tuple[str, str]]:
    """(name, code) of each field of a spec: codes of the struct module between fields like {name:I} or {name:12}; {name:a} reads up to a zero, {name} the rest."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w*)(?::([^}]*))?\}", spec):
        out += [("", c) for c in re.findall(r"\d*[a-zA-Z?]", spec[at : m.start()])]
        out.append((m[1], m[2] or ""))
        at = m.end()
    return out + [("", c) for c in re.findall(r"\d*[a-zA-Z?]", spec[at:])]


@unit("struct", "spec:str *outputs:str -m:multi -n:count:int=0", many=True)
def struct(data, spec, outputs=(), multi=False, count=0):
    """Reads a structure; named fields are variables, and what is left or the outputs named are chunks."""
    order = spec[0] if spec[:1] in "<>=!@" and spec[:1] else "<"
    fields, at, rounds = parse_spec(spec.lstrip("<>=!@")), 0, 0
    while at < len(data) or not rounds:
        values: dict[str, object] = {}
        for i, (name, code) in enumerate(fields):
            if code in ("a", "u", "w", "g"):
                if code == "a":
                    end = data.index(b"\0", at)
                    value: object = data[at:end]
                    at = end + 1
                elif code == "g":
                    import uuid

                    value = str(uuid.UUID(bytes_le=data[at : at + 16])).encode()
                    at += 16
                else:
                    end = at
                    while data[end : end + 2] not in (b"\0\0", b""):
                        end += 2
                    value = data[at:end] if code == "u" else data[at:end].decode("utf-16le").encode()
                    at = end + 2
            elif code.isidentifier() and code in values or code.isdigit():
                n = int(values[code] if code in values else code)
                value, at = data[at : at + n], at + n
                if len(value) < n:
                    raise ValueError("the input ends inside a field")
            elif not code:
                value, at = data[at:], len(data)
            else:
                n = structlib.calcsize(order + code)
                got = structlib.unpack_from(order + code, data, at)
                value, at = got[0] if len(got) == 1 else b"".join(g if isinstance(g, bytes) else str(g).encode() for g in got), at + n
            values[name or f"_{i}"] = value
        rounds += 1
        named = {k: v for k, v in values.items() if not k.startswith("_")}
        for out in outputs or [None]:
            if out is None:
                yield (b"" if multi else data[at:]), named
            else:
                yield re.sub(r"\{(\w+)\}", lambda m: (lambda v: v.decode("latin-1") if isinstance(v, bytes) else str(v))(values[m[1]] if m[1] in values else list(values.values())[int(m[1]) - 1]), out).encode("latin-1"), named
        if not multi or (count and rounds >= count):
            break
