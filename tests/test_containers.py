"""Containers and keys, built here byte by byte."""

import io
import json
import marshal
import struct
import tarfile
import zipfile
import zlib

import pytest

from millrace.functions import UNITS

P, Q = (1 << 521) - 1, (1 << 607) - 1
KEY = json.dumps({"n": P * Q, "e": 65537, "d": pow(65537, -1, (P - 1) * (Q - 1)), "p": P, "q": Q}).encode()


@pytest.mark.parametrize("kw", [{}, {"padding": "OAEP"}, {"padding": "PKCS15"}, {"textbook": True}])
def test_rsa(kw):
    assert UNITS["rsa"].one(UNITS["rsa"].undo(b"secret", key=KEY, **kw), key=KEY, **kw) == b"secret"


@pytest.mark.parametrize("kind", ["PEM", "DER", "XML", "JSON"])
def test_keys(kind):
    assert UNITS["rsa"].one(UNITS["rsa"].undo(b"x", key=KEY), key=UNITS["rsakey"].one(KEY, output=kind)) == b"x"


def test_archives():
    files = {"a.txt": b"first", "dir/b.txt": b"second" * 100}
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w", zipfile.ZIP_DEFLATED) as f:
        for name, body in files.items():
            f.writestr(name, body)
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        for name, body in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            f.addfile(info, io.BytesIO(body))
    for unit, data in (("xtzip", z), ("xttar", t), ("xt", z), ("xt", t)):
        assert {m["path"].decode(): b for b, m in UNITS[unit](data.getvalue())} == files
    assert [b for b, _ in UNITS["xtzip"](z.getvalue(), paths=("b.txt",))] == [files["dir/b.txt"]]
    assert [b for b, _ in UNITS["xtzip"](z.getvalue(), list=True)] == [b"a.txt", b"dir/b.txt"]


def test_cabinet():
    body = b"The quick brown fox. " * 3000
    blocks = [body[i : i + 32768] for i in range(0, len(body), 32768)]
    packed, history = b"", b""
    for b in blocks:
        c = zlib.compressobj(9, zlib.DEFLATED, -15, zdict=history) if history else zlib.compressobj(9, zlib.DEFLATED, -15)
        raw = b"CK" + c.compress(b) + c.flush()
        packed += struct.pack("<IHH", 0, len(raw), len(b)) + raw
        history = b[-32768:]
    entry = struct.pack("<IIHHHH", len(body), 0, 0, 0, 0, 0x20) + b"sub\\fox.txt\0"
    start = 36 + 8 + len(entry)
    head = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, start + len(packed), 0, 44, 0, 3, 1, 1, 1, 0, 0, 0)
    cab = head + struct.pack("<IHH", start, len(blocks), 1) + entry + packed
    assert [(m["path"], b) for b, m in UNITS["xtcab"](cab)] == [(b"sub/fox.txt", body)]


def test_documents():
    assert UNITS["rtfc"].one(UNITS["rtfc"].undo(b"{\\rtf1 some text}")) == b"{\\rtf1 some text}"
    assert {x for x, _ in UNITS["pymstr"](marshal.dumps({"key": ["text", b"raw", 1.5, None]}))} == {b"key", b"text", b"raw"}
    pdf = b"%PDF-1.4\n1 0 obj\n<< /Length 3 /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"BT ET") + b"\nendstream\nendobj\n"
    assert UNITS["xtpdf"](pdf)[0] == (b"BT ET", {"path": b"streams/1"})
    reg = b'Windows Registry Editor Version 5.00\r\n\r\n[HKEY_LOCAL_MACHINE\\A]\r\n"x"="text"\r\n"n"=dword:0000000a\r\n'
    assert {m["path"]: b for b, m in UNITS["winreg"](reg)} == {b"HKEY_LOCAL_MACHINE/A/x": b"text", b"HKEY_LOCAL_MACHINE/A/n": b"10"}


def test_captures():
    tcp = lambda sport, dport, seq, flags, body: struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 0, 0, 0) + body
    ip = lambda src, dst, body: struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(body), 0, 0, 64, 6, 0, bytes(src), bytes(dst)) + body
    a, b = (10, 0, 0, 1), (10, 0, 0, 2)
    packets = [ip(a, b, tcp(5000, 80, 9, 2, b"")), ip(a, b, tcp(5000, 80, 15, 16, b"WORLD")), ip(a, b, tcp(5000, 80, 10, 16, b"HELLO"))]
    pcap = struct.pack("<IHHIIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<IIII", 1, 0, len(p) + 14, len(p) + 14) + bytes(12) + b"\x08\0" + p for p in packets)
    found = [d for d, _ in UNITS["pcap"](pcap)]
    assert found == packets
    from millrace.functions.formats import reassembled

    assert [*reassembled(found)] == [("10.0.0.1:5000", "10.0.0.2:80", b"HELLOWORLD", True)]


def seven(files: dict[str, bytes], encode: bool) -> bytes:
    """A 7z archive of one LZMA2 folder, with a plain or a packed header."""
    import lzma

    def number(v):
        return bytes((v,)) if v < 0x80 else b"\xc0" + struct.pack("<H", v) if v < 0x10000 else b"\xf0" + struct.pack("<I", v)

    pack = lambda b: lzma.compress(b, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
    folder = lambda n: b"\x07\x0b\x01\x00\x01\x21\x21\x01\x10\x0c" + number(n) + b"\x00"
    body = b"".join(files.values())
    packed = pack(body)
    sizes = b"".join(number(len(b)) for b in [*files.values()][:-1])
    names = b"\x00" + b"".join(n.encode("utf-16le") + b"\0\0" for n in files)
    main = b"\x01\x04\x06" + number(0) + b"\x01\x09" + number(len(packed)) + b"\x00" + folder(len(body)) + b"\x08\x0d" + number(len(files)) + b"\x09" + sizes + b"\x00\x00"
    main += b"\x05" + number(len(files)) + b"\x11" + number(len(names)) + names + b"\x00\x00"
    if encode:
        head = pack(main)
        last = b"\x17\x06" + number(len(packed)) + b"\x01\x09" + number(len(head)) + b"\x00" + folder(len(main)) + b"\x00"
        packed, main = packed + head, last
    return b"7z\xbc\xaf\x27\x1c\0\4" + bytes(4) + struct.pack("<QQI", len(packed), len(main), zlib.crc32(main)) + packed + main


@pytest.mark.parametrize("encode", [False, True])
def test_seven(encode):
    files = {"a.txt": b"first" * 50, "sub/b.bin": bytes(range(256)) * 9, "c": b"x"}
    assert {m["path"].decode(): b for b, m in UNITS["xt7z"](seven(files, encode))} == files


def test_branch_filter():
    import lzma

    from millrace.functions.sevenzip import unfiltered

    code = b"\x90\xe8\x10\x00\x00\x00" * 200
    packed = lzma.compress(code, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_X86}, {"id": lzma.FILTER_LZMA2, "preset": 0}])
    assert unfiltered(lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "preset": 0}]).decompress(packed)) == code


def test_games_and_properties():
    import pickle

    body = b"image data"
    index = zlib.compress(pickle.dumps({"a.png": [(34 ^ 0x42, len(body) ^ 0x42, b"")]}))
    rpa = b"RPA-3.0 %016x %08x\n" % (34 + len(body), 0x42) + body + index
    assert [(b, m["path"]) for b, m in UNITS["xtrpa"](rpa)] == [(body, b"a.png")]
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("docProps/core.xml", '<c xmlns:d="u"><d:title>T</d:title></c>')
    assert json.loads(UNITS["docmeta"].one(z.getvalue())) == {"title": "T"}
