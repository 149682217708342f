"""RSA keys in their usual formats, and single blocks under them."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import secrets
import struct
from xml.etree import ElementTree

from millrace.functions.registry import unit


def der_items(data: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(data):
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        out.append((tag, data[at : at + n]))
        at += n
    return out


def der(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes((n,)) if n < 128 else (lambda b: bytes((0x80 | len(b),)) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes((tag,)) + size + body


def der_number(v: int) -> bytes:
    return der(2, v.to_bytes(v.bit_length() // 8 + 1, "big"))


_NAMES = ("n", "e", "d", "p", "q", "dp", "dq", "qi")


def parse_key(data: bytes) -> dict[str, int]:
    """n, e and, of private keys, d, p, q and more: from PEM, DER, XML, Crypto API blobs, JSON, or "modulus:exponent" in hexadecimal."""
    text = data.strip()
    if text.startswith(b"-----BEGIN"):
        text = base64.b64decode(b"".join(x for x in text.splitlines() if x and not x.startswith(b"-----") and b":" not in x))
    if text[:1] == b"{":
        return {k: int(str(v), 0) for k, v in json.loads(text).items() if k in _NAMES}
    if text[:1] == b"<":
        names = {"Modulus": "n", "Exponent": "e", "D": "d", "P": "p", "Q": "q", "DP": "dp", "DQ": "dq", "InverseQ": "qi"}
        return {names[x.tag]: int.from_bytes(base64.b64decode(x.text), "big") for x in ElementTree.fromstring(text) if x.tag in names}
    if text[:2] in (b"\6\2", b"\7\2") and text[8:12] in (b"RSA1", b"RSA2"):
        bits, e = struct.unpack_from("<II", text, 12)
        size, at, out = bits // 8, 20, {"e": e}
        for name, n in zip(("n", "p", "q", "dp", "dq", "qi", "d"), (size, *[size // 2] * 5, size), strict=True):
            if name != "n" and text[8:12] == b"RSA1":
                break
            out[name] = int.from_bytes(text[at : at + n], "little")
            at += n
        return out
    if re.fullmatch(rb"[0-9a-fA-Fx]+:[0-9a-fA-Fx]+", text):
        return dict(zip(("n", "e"), (int(x, 16) for x in text.split(b":")), strict=True))
    items = der_items(der_items(text)[0][1])
    if items[0][0] == 0x30:  # a public key in its envelope
        items = der_items(der_items(items[1][1][1:])[0][1])
    elif len(items) > 2 and items[1][0] == 0x30:  # a private key in its envelope
        items = der_items(der_items(items[2][1])[0][1])
    numbers = [int.from_bytes(b, "big") for t, b in items if t == 2]
    return dict(zip(_NAMES, numbers if len(numbers) == 2 else numbers[1:], strict=False))


def key_der(key: dict[str, int], public: bool) -> bytes:
    if public or "d" not in key:
        return der(0x30, der_number(key["n"]) + der_number(key["e"]))
    full = dict(key)
    if "p" in full:
        full |= {"dp": full["d"] % (full["p"] - 1), "dq": full["d"] % (full["q"] - 1), "qi": pow(full["q"], -1, full["p"])}
    return der(0x30, der_number(0) + b"".join(der_number(full.get(k, 0)) for k in _NAMES))


@unit("rsakey", "output:str=PEM -p:public")
def rsakey(data, output="PEM", public=False):
    """An RSA key in another format: PEM, DER, JSON, TEXT or XML."""
    key, kind = parse_key(data), output.upper()
    if public:
        key = {k: key[k] for k in ("n", "e")}
    if kind == "DER":
        return key_der(key, public)
    if kind == "PEM":
        name = b"RSA PUBLIC KEY" if public or "d" not in key else b"RSA PRIVATE KEY"
        body = base64.b64encode(key_der(key, public))
        return b"-----BEGIN " + name + b"-----\n" + b"\n".join(body[i : i + 64] for i in range(0, len(body), 64)) + b"\n-----END " + name + b"-----"
    if kind == "XML":
        number = lambda v: base64.b64encode(v.to_bytes((v.bit_length() + 7) // 8, "big")).decode()
        names = {"n": "Modulus", "e": "Exponent", "p": "P", "q": "Q", "dp": "DP", "dq": "DQ", "qi": "InverseQ", "d": "D"}
        return ("<RSAKeyValue>" + "".join(f"<{names[k]}>{number(v)}</{names[k]}>" for k, v in key.items()) + "</RSAKeyValue>").encode()
    if kind == "TEXT":
        return "\n".join(f"{k} = 0x{v:X}" for k, v in key.items()).encode()
    return json.dumps({k: f"0x{v:X}" for k, v in key.items()}, indent=4).encode()


def _mask(seed: bytes, n: int) -> bytes:
    return b"".join(hashlib.sha1(seed + i.to_bytes(4, "big")).digest() for i in range(-(-n // 20)))[:n]


def oaep(data: bytes, size: int) -> bytes:
    h = hashlib.sha1(b"").digest()
    block, seed = h + bytes(size - len(data) - 42) + b"\1" + data, secrets.token_bytes(20)
    masked = bytes(a ^ b for a, b in zip(block, _mask(seed, len(block)), strict=True))
    return b"\0" + bytes(a ^ b for a, b in zip(seed, _mask(masked, 20), strict=True)) + masked


def unoaep(block: bytes) -> bytes | None:
    seed = bytes(a ^ b for a, b in zip(block[1:21], _mask(block[21:], 20), strict=True))
    body = bytes(a ^ b for a, b in zip(block[21:], _mask(seed, len(block) - 21), strict=True))
    head, _, rest = body[20:].partition(b"\1")
    return rest if block[:1] == b"\0" and body[:20] == hashlib.sha1(b"").digest() and not head.strip(b"\0") else None


_OPTIONS = "key -s:swapkeys -t:textbook -p:padding:str=AUTO -r:rsautl"


@unit("rsa", _OPTIONS)
def rsa(data, key, swapkeys=False, textbook=False, padding="AUTO", rsautl=False):
    """Blocks decrypted under a private key (or the public one, if keys are swapped)."""
    k = parse_key(key)
    size, exponent, out = (k["n"].bit_length() + 7) // 8, k["e"] if swapkeys or rsautl or "d" not in k else k["d"], b""
    for at in range(0, len(data), size):
        block = pow(int.from_bytes(data[at : at + size], "big"), exponent, k["n"]).to_bytes(size, "big")
        kind = "NONE" if textbook else padding.upper()
        got = None
        if kind in ("AUTO", "PKCS15", "PKCS1.5"):
            m = re.match(rb"\x00(?:\x02[^\x00]{8,}|\x01\xff{8,})\x00", block)
            got = block[m.end() :] if m else None
        if got is None and kind in ("AUTO", "OAEP"):
            got = unoaep(block)
        out += block.lstrip(b"\0") if got is None else got
    return out


@rsa.reverse
def _(data, key, swapkeys=False, textbook=False, padding="AUTO", rsautl=False):
    k = parse_key(key)
    size, exponent, out = (k["n"].bit_length() + 7) // 8, k["d"] if swapkeys else k["e"], b""
    kind = "NONE" if textbook else padding.upper()
    room = size - 42 if kind in ("AUTO", "OAEP") else size - 11 if kind != "NONE" else size - 1
    for at in range(0, len(data), room):
        part = data[at : at + room]
        if kind in ("AUTO", "OAEP"):
            block = oaep(part, size)
        elif kind == "NONE":
            block = part
        else:
            block = b"\0\2" + bytes(secrets.randbelow(255) + 1 for _ in range(size - 3 - len(part))) + b"\0" + part
        out += pow(int.from_bytes(block, "big"), exponent, k["n"]).to_bytes(size, "big")
    return out
