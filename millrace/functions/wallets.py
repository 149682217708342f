"""Wallet addresses, told by the coins' own address formats: lengths and version bytes, and checksums wherever the format has one."""

from __future__ import annotations

import base64
import binascii
import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

from millrace.functions.codecs import B58, big_decode
from millrace.functions.registry import UNITS

# fixed values: version bytes and sizes of payloads (Base58Check), human-readable parts and numbers of symbols after them (Bech32)
BASE58CHECK = {
    "BTC": [("00", 20), ("05", 20)], "WIF": [("80", 32), ("80", 33)], "LTC": [("30", 20), ("32", 20)], "DOGE": [("1e", 20), ("16", 20)], "DASH": [("4c", 20), ("10", 20)],
    "ZCASH": [("1cb8", 20), ("1cbd", 20)], "NEO": [("17", 20), ("35", 20)], "ONT": [("17", 20)], "RVN": [("3c", 20), ("7a", 20)], "TRON": [("41", 20)], "XTZ": [("06a19f", 20), ("06a1a1", 20), ("06a1a4", 20), ("025a79", 20)],
}
BECH32 = {"BTC": [("bc", 39), ("bc", 59)], "LTC": [("ltc", 39), ("ltc", 59)], "ADA": [("addr", 98), ("addr", 53)], "ATOM": [("cosmos", 38)], "AVAX": [("avax", 38)], "ONE": [("one", 38), ("bnb", 38)], "TERRA": [("terra", 38)], "IOTA": [("iota", 59)], "ZCASH": [("zs", 75)]}
RIPPLE = b"rpshnaf39wBUDNEGHJKLM4PQRST7VWXYZ2bcdeCg65jkm8oFqi1tuvAxyz"
SYMBOLS = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
CASH_STEPS = (0x98F2BC8E61, 0x79B76D99E2, 0xF33E5FB3C4, 0xAE2EABE2A8, 0x1E4F43E470)


def _b58_shape(size: int) -> str:
    """Base-58 texts of so many bytes."""
    return f"[{B58.decode()}]{{{size},{math.ceil(size * 8 / math.log2(58))}}}"


def _double(raw: bytes) -> bytes:
    return hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]


def _checked(raw: bytes) -> bytes | None:
    """The body of a Base58Check value, without its checksum."""
    return raw[:-4] if len(raw) > 4 and _double(raw[:-4]) == raw[-4:] else None


def _polymod(values: list[int], steps: tuple[int, ...], bits: int) -> int:
    state = 1
    for v in values:
        top, state = state >> bits, (state & ((1 << bits) - 1)) << 5 ^ v
        for i, step in enumerate(steps):
            state ^= step if top >> i & 1 else 0
    return state


def _bech32(text: str) -> bool:
    text = text.lower()
    head, _, tail = text.rpartition("1")
    values = [ord(c) >> 5 for c in head] + [0] + [ord(c) & 31 for c in head] + [SYMBOLS.index(c) for c in tail]
    return _polymod(values, BECH32_STEPS, 25) in (1, 0x2BC830A3)


def _cash(text: str) -> bool:
    tail = text.lower().rpartition(":")[2]
    return _polymod([ord(c) & 31 for c in "bitcoincash"] + [0] + [SYMBOLS.index(c) for c in tail], CASH_STEPS, 35) == 1


def _monero(text: bytes) -> bool:
    """Blocks of eleven symbols for eight bytes; the last four bytes are a checksum."""
    parts = [text[i : i + 11] for i in range(0, len(text), 11)]
    sizes = {11: 8, 7: 5}
    values = [sum(B58.index(c) * 58**k for k, c in enumerate(reversed(p))) for p in parts]
    if any(len(p) not in sizes or v >> 8 * sizes[len(p)] for p, v in zip(parts, values, strict=True)):
        return False
    raw = b"".join(v.to_bytes(sizes[len(p)], "big") for p, v in zip(parts, values, strict=True))
    return raw[0] in (18, 19, 42) and UNITS["keccak"].one(raw[:-4])[:4] == raw[-4:]


def _byron(raw: bytes) -> bool:
    """CBOR: a pair of wrapped bytes and their CRC."""
    head = 5 if raw[3:4] == b"\x58" else 4
    size = raw[4] if head == 5 and len(raw) > 4 else (raw[3] & 31 if len(raw) > 3 else 0)
    body, rest = raw[head : head + size], raw[head + size :]
    return raw[:3] == b"\x82\xd8\x18" and rest[:1] == b"\x1a" and rest[1:] == zlib.crc32(body).to_bytes(4, "big")


def _substrate(raw: bytes) -> bool:
    return len(raw) == 35 and raw[0] == 0 and hashlib.blake2b(b"SS58PRE" + raw[:-2]).digest()[:2] == raw[-2:]


def _b32(text: bytes) -> bytes:
    return base64.b32decode(text + b"=" * (-len(text) % 8))


def _ton(text: bytes) -> bool:
    raw = base64.urlsafe_b64decode(text)
    return raw[0] & 0x7F in (0x11, 0x51) and binascii.crc_hqx(raw[:-2], 0).to_bytes(2, "big") == raw[-2:]


def _stellar(raw: bytes) -> bool:
    return raw[0] == 6 << 3 and binascii.crc_hqx(raw[:-2], 0).to_bytes(2, "little") == raw[-2:]


def _raw58(text: bytes, alphabet: bytes = B58) -> bytes:
    return big_decode(text, alphabet, keep_zeros=True)


def _kinds() -> dict[str, list[tuple[str, Callable[[bytes], bool]]]]:
    out: dict[str, list] = {}
    for name, forms in BASE58CHECK.items():
        for size in sorted({len(v) // 2 + n + 4 for v, n in forms}):
            bodies = [(bytes.fromhex(v), n) for v, n in forms]
            out.setdefault(name, []).append((_b58_shape(size), lambda t, bodies=bodies: (body := _checked(_raw58(t))) is not None and any(body.startswith(v) and len(body) == len(v) + n for v, n in bodies)))
    for name, forms in BECH32.items():
        for head, n in forms:
            lead = "[XPC]-" if name == "AVAX" else ""
            out.setdefault(name, []).append((f"{lead}(?:{head}1[{SYMBOLS}]{{{n}}}|{head.upper()}1[{SYMBOLS.upper()}]{{{n}}})", lambda t: _bech32(t.decode().rpartition("-")[2])))
    out.setdefault("ADA", []).append((f"[{B58.decode()}]{{58,120}}", lambda t: _byron(_raw58(t))))
    out["BCH"] = [(f"(?:bitcoincash:)?[qp][{SYMBOLS}]{{41}}|(?:BITCOINCASH:)?[QP][{SYMBOLS.upper()}]{{41}}", lambda t: _cash(t.decode()))]
    out["ETH"] = [("0x[0-9a-fA-F]{40}", lambda t: True)]
    out["RONIN"] = [("ronin:[0-9a-fA-F]{40}", lambda t: True)]
    out["LSK"] = [("[1-9][0-9]{0,19}L", lambda t: int(t[:-1]) < 1 << 64 and len(t) > 17)]
    out["ALGO"] = [("[A-Z2-7]{58}", lambda t: hashlib.new("sha512_256", _b32(t)[:32]).digest()[-4:] == _b32(t)[32:])]
    out["XLM"] = [("G[A-Z2-7]{55}", lambda t: _stellar(_b32(t)))]
    out["XEM"] = [("N[A-Z2-7]{39}|N[A-Z2-7]{5}(?:-[A-Z2-7]{6}){5}-[A-Z2-7]{4}", lambda t: (raw := _b32(t.replace(b"-", b"")))[0] == 0x68 and UNITS["keccak"].one(raw[:21])[:4] == raw[21:])]
    out["TON"] = [("[A-Za-z0-9_-]{48}", _ton)]
    out["DOT"] = [(_b58_shape(35), lambda t: _substrate(_raw58(t)))]
    out["XMR"] = [(f"[48][{B58.decode()}]{{94}}|4[{B58.decode()}]{{105}}", _monero)]
    out["XRP"] = [(f"r[{RIPPLE.decode()}]{{24,34}}", lambda t: (body := _checked(_raw58(t, RIPPLE))) is not None and len(body) == 21 and body[0] == 0)]
    out["SOLANA"] = [(f"[{B58.decode()}]{{43,44}}", lambda t: len(_raw58(t)) == 32)]
    return out


KINDS = _kinds()
#: Shapes by name, for regular expressions; without checksums.
SHAPES = {name: "|".join(shape for shape, _ in forms) for name, forms in KINDS.items()}


def addresses(data: bytes) -> Iterator[tuple[bytes, str, int]]:
    """(address, name of the coin, offset), coin by coin. A text that fits a coin with a checksum is no address of those without one."""
    taken = set()
    for name in sorted(KINDS, key=lambda n: (n == "SOLANA", n)):
        for shape, fits in KINDS[name]:
            for m in re.finditer(rb"(?<![\w-])(?:" + shape.encode() + rb")(?![\w-])", data):
                try:
                    good = fits(m[0])
                except (ValueError, IndexError):
                    continue
                if good and not (name == "SOLANA" and m.span() in taken):
                    taken.add(m.span())
                    yield m[0], name, m.start()
