"""Ciphers; the forward direction decrypts, the reverse one encrypts. Tables are generated by their rules where they have any."""

from __future__ import annotations

import base64
import functools
import hashlib
import hmac
import string
import struct
from collections.abc import Callable

from pyspark.sql import functions as F

from millrace.functions.hashes import pi_bytes
from millrace.functions.registry import unit
from millrace.functions.strings import latin, literal, unlatin

M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def rol(x: int, n: int, bits: int = 32) -> int:
    n %= bits
    return (x << n | x >> bits - n) & (1 << bits) - 1


def ror(x: int, n: int, bits: int = 32) -> int:
    return rol(x, bits - n % bits, bits)


def xored(a: bytes, b: bytes) -> bytes:
    n = min(len(a), len(b))
    return (int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).to_bytes(n, "big")


# ---------------------------------------------------------------- modes and padding
def unpad(data: bytes, size: int, kind: str | None) -> bytes:
    """Takes padding off: the kind asked for, else the first of PKCS7, ISO 7816 and X9.23 that fits."""
    if kind == "raw" or not data:
        return data
    n = data[-1]
    for k in (kind,) if kind else ("pkcs7", "iso7816", "x923"):
        if k == "pkcs7" and 0 < n <= size and data.endswith(bytes((n,)) * n):
            return data[:-n]
        if k == "iso7816" and (cut := data.rstrip(b"\0")).endswith(b"\x80"):
            return cut[:-1]
        if k == "x923" and 0 < n <= size and data[-n:-1] == bytes(n - 1):
            return data[:-n]
    return data


def padded(data: bytes, size: int, kind: str | None) -> bytes:
    n = size - len(data) % size
    if kind == "raw":
        return data
    if kind == "iso7816":
        return data + b"\x80" + bytes(n - 1)
    if kind == "x923":
        return data + bytes(n - 1) + bytes((n,))
    return data + bytes((n,)) * n


def _parts(data: bytes, size: int):
    return (data[i : i + size] for i in range(0, len(data), size))


def run_mode(data: bytes, size: int, enc: Callable, dec: Callable, iv: bytes, mode: str | None, encrypting: bool, padding: str | None, segment: int = 0) -> bytes:
    """A block cipher in a mode: CBC with an initialisation vector and ECB without, unless another one is named."""
    mode = (mode or ("CBC" if iv else "ECB")).upper()
    if mode == "ECB" and iv:
        raise ValueError("ECB takes no initialisation vector")
    if mode in ("ECB", "CBC", "PCBC"):
        if encrypting:
            data = padded(data, size, padding)
        if len(data) % size:
            raise ValueError("the input is no multiple of the block size")
        out, last = bytearray(), iv.ljust(size, b"\0")
        for block in _parts(data, size):
            if mode == "ECB":
                out += (enc if encrypting else dec)(block)
            elif encrypting:
                done = enc(xored(block, last))
                last = done if mode == "CBC" else xored(done, block)
                out += done
            else:
                done = xored(dec(block), last)
                last = block if mode == "CBC" else xored(done, block)
                out += done
        return bytes(out) if encrypting else unpad(bytes(out), size, padding)
    out, last = bytearray(), iv.ljust(size, b"\0")
    if mode == "CTR":
        count = int.from_bytes(last, "big")
        for block in _parts(data, size):
            out += xored(block, enc((count & (1 << 8 * size) - 1).to_bytes(size, "big")))
            count += 1
    elif mode == "OFB":
        for block in _parts(data, size):
            last = enc(last)
            out += xored(block, last)
    elif mode == "CFB":
        step = (segment or 8) // 8
        for block in _parts(data, step):
            done = xored(block, enc(last))
            last = (last + (done if encrypting else block))[-size:]
            out += done
    else:
        raise ValueError(f"unknown mode {mode}")
    return bytes(out)


_OPTIONS = "key -i:iv:bytes -p:padding:str -m:mode:str -r:raw -S:segment_size:int=0"


def block_cipher(name: str, size: int, make: Callable[..., tuple[Callable, Callable]], extra: str = "", text: str = ""):
    """Registers a cipher whose maker takes a key (and options) and gives encryption and decryption of a block."""

    def run(data, encrypting, key, iv=None, padding=None, mode=None, raw=False, segment_size=0, **kw):
        enc, dec = make(key, **{k: v for k, v in kw.items() if v is not None})
        width = kw.get("block_size") or size
        return run_mode(data, width, enc, dec, iv or b"", mode, encrypting, "raw" if raw else padding, segment_size or 0)

    made = unit(name, f"{_OPTIONS} {extra}".strip())(lambda data, **kw: run(data, False, **kw))
    made.reverse(lambda data, **kw: run(data, True, **kw))
    made.text = text or f"The {name} block cipher."
    return made


# ---------------------------------------------------------------- Rijndael
def gmul(a: int, b: int, poly: int = 0x11B) -> int:
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a <<= 1
        a ^= poly if a & 0x100 else 0
        b >>= 1
    return out


@functools.cache
def aes_boxes() -> tuple[bytes, bytes]:
    box = bytearray(256)
    p = q = 1
    while True:  # p runs over all elements, q over their inverses
        p = p ^ (p << 1) & 255 ^ (0x1B if p & 0x80 else 0)
        q ^= q << 1
        q ^= q << 2
        q = (q ^ q << 4) & 255
        q ^= 9 if q & 0x80 else 0
        box[p] = q ^ rol(q, 1, 8) ^ rol(q, 2, 8) ^ rol(q, 3, 8) ^ rol(q, 4, 8) ^ 0x63
        if p == 1:
            break
    box[0] = 0x63
    back = bytearray(256)
    for i, v in enumerate(box):
        back[v] = i
    return bytes(box), bytes(back)


@functools.cache
def _times(n: int) -> bytes:
    return bytes(gmul(i, n) for i in range(256))


def rijndael(key: bytes, block_size: int = 16) -> tuple[Callable, Callable]:
    box, back = aes_boxes()
    nk, nb = len(key) // 4, block_size // 4
    if len(key) not in (16, 20, 24, 28, 32):
        raise ValueError("a key of 16, 24 or 32 bytes is needed")
    rounds = max(nk, nb) + 6
    w = [list(key[4 * i : 4 * i + 4]) for i in range(nk)]
    rcon = 1
    for i in range(nk, nb * (rounds + 1)):
        t = w[-1]
        if i % nk == 0:
            t = [box[b] for b in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = gmul(rcon, 2)
        elif nk > 6 and i % nk == 4:
            t = [box[b] for b in t]
        w.append([a ^ b for a, b in zip(w[i - nk], t, strict=True)])
    keys = [bytes(b for word in w[r * nb : r * nb + nb] for b in word) for r in range(rounds + 1)]
    shifts = (0, 1, 3, 4) if nb == 8 else (0, 1, 2, 3)
    order = [4 * ((c + shifts[r]) % nb) + r for c in range(nb) for r in range(4)]
    undo = [order.index(i) for i in range(4 * nb)]
    t2, t3, t9, t11, t13, t14 = (_times(n) for n in (2, 3, 9, 11, 13, 14))

    def enc(s: bytes) -> bytes:
        s = xored(s, keys[0])
        for r in range(1, rounds + 1):
            s = s.translate(box)
            s = bytes(s[i] for i in order)
            if r < rounds:
                o = bytearray()
                for i in range(0, len(s), 4):
                    a, b, c, d = s[i : i + 4]
                    o += bytes((t2[a] ^ t3[b] ^ c ^ d, a ^ t2[b] ^ t3[c] ^ d, a ^ b ^ t2[c] ^ t3[d], t3[a] ^ b ^ c ^ t2[d]))
                s = bytes(o)
            s = xored(s, keys[r])
        return s

    def dec(s: bytes) -> bytes:
        s = xored(s, keys[rounds])
        for r in range(rounds - 1, -1, -1):
            s = bytes(s[i] for i in undo).translate(back)
            s = xored(s, keys[r])
            if r:
                o = bytearray()
                for i in range(0, len(s), 4):
                    a, b, c, d = s[i : i + 4]
                    o += bytes((t14[a] ^ t11[b] ^ t13[c] ^ t9[d], t9[a] ^ t14[b] ^ t11[c] ^ t13[d], t13[a] ^ t9[b] ^ t14[c] ^ t11[d], t11[a] ^ t13[b] ^ t9[c] ^ t14[d]))
                s = bytes(o)
        return s

    return enc, dec


aes = block_cipher("aes", 16, rijndael, text="AES.")
block_cipher("rijndael", 16, rijndael, "-b:block_size:int=16", "Rijndael with blocks of 16, 24 or 32 bytes.")


@aes.column
def _(c, key, iv=None, padding=None, mode=None, raw=False, segment_size=0):
    """ECB with PKCS7 padding has a function of its own; CBC takes the vector from the front of the input."""
    kind = (mode or ("CBC" if iv else "ECB")).upper()
    if raw or padding not in (None, "pkcs7") or kind not in ("ECB", "CBC"):
        return None
    if kind == "ECB":
        return F.aes_decrypt(c, literal(key), F.lit("ECB"), F.lit("PKCS"))
    return F.aes_decrypt(F.concat(literal(iv), c), literal(key), F.lit("CBC"), F.lit("PKCS"))


# ---------------------------------------------------------------- Feistel and other block ciphers
def tea_like(f_enc: Callable, f_dec: Callable):
    def make(key: bytes, swap: bool = False, rounds: int = 32):
        order = "<" if swap else ">"
        k = struct.unpack(f"{order}4I", key[:16].ljust(16, b"\0"))
        return (lambda b: struct.pack(f"{order}2I", *f_enc(*struct.unpack(f"{order}2I", b), k, rounds)), lambda b: struct.pack(f"{order}2I", *f_dec(*struct.unpack(f"{order}2I", b), k, rounds)))

    return make


_DELTA = 0x9E3779B9


def _tea_enc(x, y, k, n):
    s = 0
    for _ in range(n):
        s = s + _DELTA & M32
        x = x + ((y << 4) + k[0] ^ y + s ^ (y >> 5) + k[1]) & M32
        y = y + ((x << 4) + k[2] ^ x + s ^ (x >> 5) + k[3]) & M32
    return x, y


def _tea_dec(x, y, k, n):
    s = _DELTA * n & M32
    for _ in range(n):
        y = y - ((x << 4) + k[2] ^ x + s ^ (x >> 5) + k[3]) & M32
        x = x - ((y << 4) + k[0] ^ y + s ^ (y >> 5) + k[1]) & M32
        s = s - _DELTA & M32
    return x, y


def _xtea_enc(x, y, k, n):
    s = 0
    for _ in range(n):
        x = x + ((y << 4 ^ y >> 5) + y ^ s + k[s & 3]) & M32
        s = s + _DELTA & M32
        y = y + ((x << 4 ^ x >> 5) + x ^ s + k[s >> 11 & 3]) & M32
    return x, y


def _xtea_dec(x, y, k, n):
    s = _DELTA * n & M32
    for _ in range(n):
        y = y - ((x << 4 ^ x >> 5) + x ^ s + k[s >> 11 & 3]) & M32
        s = s - _DELTA & M32
        x = x - ((y << 4 ^ y >> 5) + y ^ s + k[s & 3]) & M32
    return x, y


block_cipher("tea", 8, tea_like(_tea_enc, _tea_dec), "-s:swap -k:rounds:int=32")
block_cipher("xtea", 8, tea_like(_xtea_enc, _xtea_dec), "-s:swap -k:rounds:int=32")


def xxtea(data: bytes, key: bytes, encrypting: bool, big: bool) -> bytes:
    order = ">" if big else "<"
    k = struct.unpack(f"{order}4I", key[:16].ljust(16, b"\0"))
    v = list(struct.unpack(f"{order}{len(data) // 4}I", data))
    n = len(v)
    rounds = 6 + 52 // n
    term = lambda s, p, e, y, z: (z >> 5 ^ y << 2 & M32) + (y >> 3 ^ z << 4 & M32) ^ (s ^ y) + (k[p & 3 ^ e] ^ z)
    if encrypting:
        s, z = 0, v[-1]
        for _ in range(rounds):
            s = s + _DELTA & M32
            e = s >> 2 & 3
            for p in range(n):
                z = v[p] = v[p] + term(s, p, e, v[(p + 1) % n], z) & M32
    else:
        s, y = rounds * _DELTA & M32, v[0]
        for _ in range(rounds):
            e = s >> 2 & 3
            for p in range(n - 1, -1, -1):
                y = v[p] = v[p] - term(s, p, e, y, v[p - 1]) & M32
            s = s - _DELTA & M32
    return struct.pack(f"{order}{n}I", *v)


@unit("xxtea", "key -s:swap -r:raw")
def xxtea_(data, key, swap=False, raw=False):
    """XXTEA over the whole chunk."""
    return unpad(xxtea(data, key, False, not swap), 4, "raw" if raw else None)


xxtea_.reverse(lambda data, key, swap=False, raw=False: xxtea(padded(data, 4, "raw" if raw else None).ljust(8, b"\0"), key, True, not swap))


def rc5(key: bytes, rounds: int = 12, word_size: int = 32, six: bool = False):
    w, mask = word_size, (1 << word_size) - 1
    size, lg = w // 8, w.bit_length() - 1
    # the odd integers nearest to the fractions of e and the golden ratio
    p = {16: 0xB7E1, 32: 0xB7E15163, 64: 0xB7E151628AED2A6B}[w]
    q = {16: 0x9E37, 32: 0x9E3779B9, 64: 0x9E3779B97F4A7C15}[w]
    n = 2 * rounds + (4 if six else 2)
    s = [(p + i * q) & mask for i in range(n)]
    c = max(1, -(-len(key) // size))
    k = [int.from_bytes(key[i * size : i * size + size], "little") for i in range(c)]
    a = b = i = j = 0
    for _ in range(3 * max(n, c)):
        a = s[i] = rol(s[i] + a + b & mask, 3, w)
        b = k[j] = rol(k[j] + a + b & mask, (a + b) % w, w)
        i, j = (i + 1) % n, (j + 1) % c
    get = lambda block: [int.from_bytes(block[x * size : x * size + size], "little") for x in range(len(block) // size)]
    put = lambda *v: b"".join(x.to_bytes(size, "little") for x in v)

    def enc5(block):
        a, b = get(block)
        a, b = a + s[0] & mask, b + s[1] & mask
        for r in range(1, rounds + 1):
            a = rol(a ^ b, b % w, w) + s[2 * r] & mask
            b = rol(b ^ a, a % w, w) + s[2 * r + 1] & mask
        return put(a, b)

    def dec5(block):
        a, b = get(block)
        for r in range(rounds, 0, -1):
            b = ror(b - s[2 * r + 1] & mask, a % w, w) ^ a
            a = ror(a - s[2 * r] & mask, b % w, w) ^ b
        return put(a - s[0] & mask, b - s[1] & mask)

    def enc6(block):
        a, b, c, d = get(block)
        b, d = b + s[0] & mask, d + s[1] & mask
        for r in range(1, rounds + 1):
            t, u = rol(b * (2 * b + 1) & mask, lg, w), rol(d * (2 * d + 1) & mask, lg, w)
            a, c = rol(a ^ t, u % w, w) + s[2 * r] & mask, rol(c ^ u, t % w, w) + s[2 * r + 1] & mask
            a, b, c, d = b, c, d, a
        return put(a + s[-2] & mask, b, c + s[-1] & mask, d)

    def dec6(block):
        a, b, c, d = get(block)
        a, c = a - s[-2] & mask, c - s[-1] & mask
        for r in range(rounds, 0, -1):
            a, b, c, d = d, a, b, c
            t, u = rol(b * (2 * b + 1) & mask, lg, w), rol(d * (2 * d + 1) & mask, lg, w)
            c, a = ror(c - s[2 * r + 1] & mask, t % w, w) ^ u, ror(a - s[2 * r] & mask, u % w, w) ^ t
        return put(a, b - s[0] & mask, c, d - s[1] & mask)

    return (enc6, dec6) if six else (enc5, dec5)


block_cipher("rc5", 8, rc5, "-k:rounds:int=12 -w:word_size:int=32")
block_cipher("rc6", 16, lambda key, rounds=20, word_size=32: rc5(key, rounds, word_size, True), "-k:rounds:int=20 -w:word_size:int=32")


def blowfish(key: bytes):
    raw = pi_bytes(4 * (18 + 1024))
    words = list(struct.unpack(f">{18 + 1024}I", raw))
    p, s = words[:18], [words[18 + 256 * i : 274 + 256 * i] for i in range(4)]
    for i in range(18):
        p[i] ^= int.from_bytes(bytes(key[(4 * i + j) % len(key)] for j in range(4)), "big")

    def f(x):
        return ((s[0][x >> 24] + s[1][x >> 16 & 255] & M32 ^ s[2][x >> 8 & 255]) + s[3][x & 255]) & M32

    def go(x, y, keys):
        for k in keys[:16]:
            x ^= k
            y ^= f(x)
            x, y = y, x
        return y ^ keys[17], x ^ keys[16]

    x = y = 0
    for i in range(0, 18, 2):
        p[i], p[i + 1] = x, y = go(x, y, p)
    for box in s:
        for i in range(0, 256, 2):
            box[i], box[i + 1] = x, y = go(x, y, p)
    back = p[::-1]
    return (lambda b: struct.pack(">2I", *go(*struct.unpack(">2I", b), p)), lambda b: struct.pack(">2I", *go(*struct.unpack(">2I", b), back)))


block_cipher("blowfish", 8, blowfish)


def sm4(key: bytes):
    box = _sm4_box()
    tau = lambda x: int.from_bytes(x.to_bytes(4, "big").translate(box), "big")
    l1 = lambda x: x ^ rol(x, 2) ^ rol(x, 10) ^ rol(x, 18) ^ rol(x, 24)
    l2 = lambda x: x ^ rol(x, 13) ^ rol(x, 23)
    k = [a ^ b for a, b in zip(struct.unpack(">4I", key), (0xA3B1BAC6, 0x56AA3350, 0x677D9197, 0xB27022DC), strict=True)]
    rk = []
    for i in range(32):
        ck = int.from_bytes(bytes((4 * i + j) * 7 & 255 for j in range(4)), "big")
        k.append(k[i] ^ l2(tau(k[i + 1] ^ k[i + 2] ^ k[i + 3] ^ ck)))
        rk.append(k[-1])

    def go(block, keys):
        x = list(struct.unpack(">4I", block))
        for r in keys:
            x = [x[1], x[2], x[3], x[0] ^ l1(tau(x[1] ^ x[2] ^ x[3] ^ r))]
        return struct.pack(">4I", *x[::-1])

    return (lambda b: go(b, rk), lambda b: go(b, rk[::-1]))


@functools.cache
def _sm4_box() -> bytes:
    """The box of SM4: an affine map, the inverse in a field of 256 elements, and the map again."""
    poly = 0x1F5
    inv = bytearray(256)
    for a in range(1, 256):
        if not inv[a]:
            b = next(b for b in range(1, 256) if gmul(a, b, poly) == 1)
            inv[a], inv[b] = b, a

    def affine(x):
        out = 0
        for i in range(8):
            out |= (bin(x & rol(0xA7, i, 8)).count("1") & 1) << i
        return out ^ 0xD3

    return bytes(affine(inv[affine(x)]) for x in range(256))


block_cipher("sm4", 16, sm4)
# fixed values: the boxes of Serpent
SERPENT = [
    [3, 8, 15, 1, 10, 6, 5, 11, 14, 13, 4, 2, 7, 0, 9, 12],
    [15, 12, 2, 7, 9, 0, 5, 10, 1, 11, 14, 8, 6, 13, 3, 4],
    [8, 6, 7, 9, 3, 12, 10, 15, 13, 1, 14, 4, 0, 11, 5, 2],
    [0, 15, 11, 8, 12, 9, 6, 3, 13, 1, 2, 4, 10, 7, 5, 14],
    [1, 15, 8, 3, 12, 0, 11, 6, 2, 5, 4, 10, 9, 14, 7, 13],
    [15, 5, 2, 11, 4, 10, 9, 12, 0, 3, 14, 8, 13, 6, 7, 1],
    [7, 2, 12, 5, 8, 4, 6, 11, 14, 9, 1, 15, 13, 3, 10, 0],
    [1, 13, 15, 0, 14, 8, 2, 11, 7, 4, 12, 10, 9, 3, 5, 6],
]


def serpent(key: bytes, swap: bool = False):
    key = key if len(key) == 32 else key + b"\1" + bytes(31 - len(key))
    w = list(struct.unpack("<8I", key))
    for i in range(132):
        w.append(rol(w[i] ^ w[i + 3] ^ w[i + 5] ^ w[i + 7] ^ _DELTA ^ i, 11))
    w = w[8:]

    def sliced(box, x):
        out = [0] * 4
        for bit in range(32):
            v = box[sum((x[j] >> bit & 1) << j for j in range(4))]
            for j in range(4):
                out[j] |= (v >> j & 1) << bit
        return out

    keys = [sliced(SERPENT[(3 - i) % 8], w[4 * i : 4 * i + 4]) for i in range(33)]
    undo = [[box.index(i) for i in range(16)] for box in SERPENT]

    def enc(block):
        x = list(struct.unpack("<4I", block))
        for r in range(32):
            x = sliced(SERPENT[r % 8], [a ^ b for a, b in zip(x, keys[r], strict=True)])
            if r < 31:
                a, b, c, d = rol(x[0], 13), x[1], rol(x[2], 3), x[3]
                b, d = rol(b ^ a ^ c, 1), rol(d ^ c ^ (a << 3 & M32), 7)
                x = [rol(a ^ b ^ d, 5), b, rol(c ^ d ^ (b << 7 & M32), 22), d]
        return struct.pack("<4I", *(a ^ b for a, b in zip(x, keys[32], strict=True)))

    def dec(block):
        x = [a ^ b for a, b in zip(struct.unpack("<4I", block), keys[32], strict=True)]
        for r in range(31, -1, -1):
            if r < 31:
                a, b, c, d = x
                c, a = ror(c, 22) ^ d ^ (b << 7 & M32), ror(a, 5) ^ b ^ d
                d, b = ror(d, 7) ^ c ^ (a << 3 & M32), ror(b, 1) ^ a ^ c
                x = [ror(a, 13), b, ror(c, 3), d]
            x = [a ^ b for a, b in zip(sliced(undo[r % 8], x), keys[r], strict=True)]
        return struct.pack("<4I", *x)

    return enc, dec


block_cipher("serpent", 16, serpent, "-s:swap")
# fixed values: the boxes of GOST 28147-89 as in RFC 7836 (parameter set Z)
GOST = ["c462a5b9e8d703f1", "68239a5c1e47bd0f", "b3582fade174c960", "c821d4f670a53e9b", "7f5a816d093eb42c", "5df692cab78143e0", "8e25691cf4b0da37", "17ed05834fa69cb2"]


def gost(key: bytes, swap: bool = False):
    boxes = [[int(c, 16) for c in row] for row in GOST]
    order = ">" if swap else "<"
    k = struct.unpack(f"{order}8I", key)
    up = [*k, *k, *k, *k[::-1]]

    def go(block, keys):
        a, b = struct.unpack(f"{order}2I", block)[:: -1 if swap else 1]
        for r in keys:
            t = a + r & M32
            t = sum(boxes[i][t >> 4 * i & 15] << 4 * i for i in range(8))
            a, b = b ^ rol(t, 11), a
        return struct.pack(f"{order}2I", *((a, b) if swap else (b, a)))

    return (lambda b: go(b, up), lambda b: go(b, up[::-1]))


block_cipher("gost", 8, gost, "-s:swap")


def speck(key: bytes, block_size: int = 16):
    w = block_size * 4
    size, mask = w // 8, (1 << w) - 1
    m = len(key) // size
    rounds = {(16, 4): 22, (24, 3): 22, (24, 4): 23, (32, 3): 26, (32, 4): 27, (48, 2): 28, (48, 3): 29, (64, 2): 32, (64, 3): 33, (64, 4): 34}[w, m]
    alpha, beta = (7, 2) if w == 16 else (8, 3)
    k = [int.from_bytes(key[i * size : i * size + size], "little") for i in range(m)]
    a, rest, keys = k[0], k[1:], []
    for i in range(rounds):
        keys.append(a)
        rest.append((a + ror(rest[0], alpha, w) & mask) ^ i)
        a = rol(a, beta, w) ^ rest[-1]
        rest.pop(0)

    def enc(block):
        y, x = (int.from_bytes(block[i : i + size], "little") for i in (0, size))
        for r in keys:
            x = (ror(x, alpha, w) + y & mask) ^ r
            y = rol(y, beta, w) ^ x
        return y.to_bytes(size, "little") + x.to_bytes(size, "little")

    def dec(block):
        y, x = (int.from_bytes(block[i : i + size], "little") for i in (0, size))
        for r in keys[::-1]:
            y = ror(y ^ x, beta, w)
            x = rol((x ^ r) - y & mask, alpha, w)
        return y.to_bytes(size, "little") + x.to_bytes(size, "little")

    return enc, dec


block_cipher("speck", 16, speck, "-b:block_size:int=16")
# fixed values: the five constant sequences of Simon
SIMON = ["11111010001001010110000111001101111101000100101011000011100110", "10001110111110010011000010110101000111011111001001100001011010", "10101111011100000011010010011000101000010001111110010110110011", "11011011101011000110010111100000010010001010011100110100001111", "11010001111001101011011000100000010111000011001010010011101111"]


def simon(key: bytes, block_size: int = 16):
    w = block_size * 4
    size, mask = w // 8, (1 << w) - 1
    m = len(key) // size
    rounds, z = {(16, 4): (32, 0), (24, 3): (36, 0), (24, 4): (36, 1), (32, 3): (42, 2), (32, 4): (44, 3), (48, 2): (52, 2), (48, 3): (54, 3), (64, 2): (68, 2), (64, 3): (69, 3), (64, 4): (72, 4)}[w, m]
    k = [int.from_bytes(key[i * size : i * size + size], "little") for i in range(m)]
    for i in range(m, rounds):
        t = ror(k[i - 1], 3, w) ^ (k[i - 3] if m == 4 else 0)
        k.append(~k[i - m] & mask ^ t ^ ror(t, 1, w) ^ int(SIMON[z][(i - m) % 62]) ^ 3)
    f = lambda x: rol(x, 1, w) & rol(x, 8, w) ^ rol(x, 2, w)

    def enc(block):
        y, x = (int.from_bytes(block[i : i + size], "little") for i in (0, size))
        for r in k:
            x, y = y ^ f(x) ^ r, x
        return y.to_bytes(size, "little") + x.to_bytes(size, "little")

    def dec(block):
        y, x = (int.from_bytes(block[i : i + size], "little") for i in (0, size))
        for r in k[::-1]:
            x, y = y, x ^ f(y) ^ r
        return y.to_bytes(size, "little") + x.to_bytes(size, "little")

    return enc, dec


block_cipher("simon", 16, simon, "-b:block_size:int=16")


def chaskey(key: bytes, rounds: int = 12, swap: bool = False):
    order = ">" if swap else "<"
    k = struct.unpack(f"{order}4I", key)

    def enc(block):
        v = [a ^ b for a, b in zip(struct.unpack(f"{order}4I", block), k, strict=True)]
        for _ in range(rounds):
            v[0] = v[0] + v[1] & M32
            v[1] = rol(v[1], 5) ^ v[0]
            v[0] = rol(v[0], 16)
            v[2] = v[2] + v[3] & M32
            v[3] = rol(v[3], 8) ^ v[2]
            v[0] = v[0] + v[3] & M32
            v[3] = rol(v[3], 13) ^ v[0]
            v[2] = v[2] + v[1] & M32
            v[1] = rol(v[1], 7) ^ v[2]
            v[2] = rol(v[2], 16)
        return struct.pack(f"{order}4I", *(a ^ b for a, b in zip(v, k, strict=True)))

    def dec(block):
        v = [a ^ b for a, b in zip(struct.unpack(f"{order}4I", block), k, strict=True)]
        for _ in range(rounds):
            v[2] = ror(v[2], 16)
            v[1] = ror(v[1] ^ v[2], 7)
            v[2] = v[2] - v[1] & M32
            v[3] = ror(v[3] ^ v[0], 13)
            v[0] = v[0] - v[3] & M32
            v[3] = ror(v[3] ^ v[2], 8)
            v[2] = v[2] - v[3] & M32
            v[0] = ror(v[0], 16)
            v[1] = ror(v[1] ^ v[0], 5)
            v[0] = v[0] - v[1] & M32
        return struct.pack(f"{order}4I", *(a ^ b for a, b in zip(v, k, strict=True)))

    return enc, dec


block_cipher("chaskey", 16, chaskey, "-k:rounds:int=12 -s:swap")
# fixed values: the nibble permutations of Twofish
TWOFISH = (["817d6f320b59eca4", "ecb81235f4a6709d", "ba5e6d90c8f32471", "d7f4126e9b3085ca"], ["28bdf76e31940ac5", "1e2b4c376da5f908", "4c75169a0ed82b3f", "b951c3de647f208a"])


@functools.cache
def _twofish_q() -> tuple[bytes, bytes]:
    out = []
    for rows in TWOFISH:
        t = [[int(c, 16) for c in row] for row in rows]
        q = bytearray()
        for x in range(256):
            a, b = x >> 4, x & 15
            for i in (0, 2):
                a, b = a ^ b, a ^ ror(b, 1, 4) ^ 8 * a & 15
                a, b = t[i][a], t[i + 1][b]
            q.append(16 * b + a)
        out.append(bytes(q))
    return out[0], out[1]


def twofish(key: bytes):
    q0, q1 = _twofish_q()
    key = key.ljust(16 if len(key) <= 16 else 24 if len(key) <= 24 else 32, b"\0")
    n = len(key) // 8
    mds = ((0x01, 0xEF, 0x5B, 0x5B), (0x5B, 0xEF, 0xEF, 0x01), (0xEF, 0x5B, 0x01, 0xEF), (0xEF, 0x01, 0xEF, 0x5B))
    rs = ((0x01, 0xA4, 0x55, 0x87, 0x5A, 0x58, 0xDB, 0x9E), (0xA4, 0x56, 0x82, 0xF3, 0x1E, 0xC6, 0x68, 0xE5), (0x02, 0xA1, 0xFC, 0xC1, 0x47, 0xAE, 0x3D, 0x19), (0xA4, 0x55, 0x87, 0x5A, 0x58, 0xDB, 0x9E, 0x03))
    words = [key[4 * i : 4 * i + 4] for i in range(2 * n)]
    s = []
    for i in range(n):
        m = key[8 * i : 8 * i + 8]
        s.append(bytes(functools.reduce(lambda a, b: a ^ b, (gmul(m[j], row[j], 0x14D) for j in range(8))) for row in rs))
    s = s[::-1]

    def h(x: bytes, ls) -> int:
        y = list(x)
        if len(ls) == 4:
            y = [(q1, q0, q0, q1)[i][y[i]] ^ ls[3][i] for i in range(4)]
        if len(ls) >= 3:
            y = [(q1, q1, q0, q0)[i][y[i]] ^ ls[2][i] for i in range(4)]
        y = [(q0, q1, q0, q1)[i][y[i]] ^ ls[1][i] for i in range(4)]
        y = [(q0, q0, q1, q1)[i][y[i]] ^ ls[0][i] for i in range(4)]
        y = [(q1, q0, q1, q0)[i][y[i]] for i in range(4)]
        return int.from_bytes(bytes(functools.reduce(lambda a, b: a ^ b, (gmul(y[j], row[j], 0x169) for j in range(4))) for row in mds), "little")

    k = []
    for i in range(20):
        a = h(bytes((2 * i,)) * 4, words[0::2])
        b = rol(h(bytes((2 * i + 1,)) * 4, words[1::2]), 8)
        k += [a + b & M32, rol(a + 2 * b & M32, 9)]
    g = functools.lru_cache(4096)(lambda x: h(x.to_bytes(4, "little"), s))

    def enc(block):
        a, b, c, d = (x ^ y for x, y in zip(struct.unpack("<4I", block), k[:4], strict=True))
        for r in range(16):
            t0, t1 = g(a), g(rol(b, 8))
            c = ror(c ^ t0 + t1 + k[2 * r + 8] & M32, 1)
            d = rol(d, 1) ^ t0 + 2 * t1 + k[2 * r + 9] & M32
            a, b, c, d = c, d, a, b
        return struct.pack("<4I", c ^ k[4], d ^ k[5], a ^ k[6], b ^ k[7])

    def dec(block):
        c, d, a, b = (x ^ y for x, y in zip(struct.unpack("<4I", block), k[4:8], strict=True))
        for r in range(15, -1, -1):
            a, b, c, d = c, d, a, b
            t0, t1 = g(a), g(rol(b, 8))
            c = rol(c, 1) ^ t0 + t1 + k[2 * r + 8] & M32
            d = ror(d ^ t0 + 2 * t1 + k[2 * r + 9] & M32, 1)
        return struct.pack("<4I", a ^ k[0], b ^ k[1], c ^ k[2], d ^ k[3])

    return enc, dec


block_cipher("twofish", 16, twofish)


# ---------------------------------------------------------------- stream ciphers
def stream_cipher(name: str, make: Callable, spec: str, text: str = ""):
    """Registers a stream cipher whose maker takes a key and options and gives an iterator of pieces of keystream."""

    def run(data, discard=0, stateful=False, **kw):
        pieces, stream = make(**{k: v for k, v in kw.items() if v is not None}), bytearray()
        while len(stream) < len(data) + (discard or 0):
            stream += next(pieces)
        return xored(data, bytes(stream[discard or 0 :]))

    made = unit(name, f"{spec} -d:discard:int=0 -s:stateful")(run)
    made.reverse(run)
    made.text = text or f"The {name} stream cipher."
    return made


def quarter_salsa(x, a, b, c, d):
    x[b] ^= rol(x[a] + x[d] & M32, 7)
    x[c] ^= rol(x[b] + x[a] & M32, 9)
    x[d] ^= rol(x[c] + x[b] & M32, 13)
    x[a] ^= rol(x[d] + x[c] & M32, 18)


def quarter_chacha(x, a, b, c, d):
    for p, q, r, n in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
        x[p] = x[p] + x[q] & M32
        x[r] = rol(x[r] ^ x[p], n)


_SALSA = ((0, 4, 8, 12), (5, 9, 13, 1), (10, 14, 2, 6), (15, 3, 7, 11), (0, 1, 2, 3), (5, 6, 7, 4), (10, 11, 8, 9), (15, 12, 13, 14))
_CHACHA = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def permuted(x: list[int], rounds: int, salsa: bool) -> list[int]:
    x = list(x)
    for _ in range(rounds // 2):
        for q in _SALSA if salsa else _CHACHA:
            (quarter_salsa if salsa else quarter_chacha)(x, *q)
    return x


def state_of(key: bytes, tail: bytes, salsa: bool, magic: bytes = b"") -> list[int]:
    """Sixteen words of constants, key, and nonce with counter."""
    m = magic or (b"expand 32-byte k" if len(key) == 32 else b"expand 16-byte k")
    c, k = struct.unpack("<4I", m), struct.unpack("<8I", key if len(key) == 32 else key * 2)
    t = struct.unpack("<4I", tail)
    return [c[0], *k[:4], c[1], *t, c[2], *k[4:], c[3]] if salsa else [*c, *k, *t]


def arx(salsa: bool, wide: bool):
    def make(key, nonce=bytes(8), magic=b"", offset=0, rounds=20):
        if wide:
            inner = permuted(state_of(key, nonce[:16], salsa, magic), rounds, salsa)
            key = struct.pack("<8I", *(inner[i] for i in ((0, 5, 10, 15, 6, 7, 8, 9) if salsa else (0, 1, 2, 3, 12, 13, 14, 15))))
            nonce = nonce[16:24]
        count = offset or 0
        while True:
            if salsa:
                tail = nonce.ljust(8, b"\0")[:8] + struct.pack("<Q", count)
            else:
                tail = struct.pack("<I", count & M32) + nonce if len(nonce) == 12 else struct.pack("<Q", count) + nonce.ljust(8, b"\0")[:8]
            x = state_of(key, tail, salsa, magic)
            yield struct.pack("<16I", *(a + b & M32 for a, b in zip(x, permuted(x, rounds, salsa), strict=True)))
            count += 1

    return make


#: Without a nonce, eight zero bytes are taken.
_ARX = "key -n:nonce:bytes -m:magic:bytes -x:offset:int=0 -r:rounds:int=20"
stream_cipher("salsa", arx(True, False), _ARX)
stream_cipher("xsalsa", arx(True, True), _ARX)
stream_cipher("chacha", arx(False, False), _ARX)
stream_cipher("xchacha", arx(False, True), _ARX)
for _name, _salsa in (("salsa20", True), ("chacha20", False)):
    stream_cipher(_name, lambda key, nonce=bytes(8), s=_salsa: arx(s, len(nonce) == 24)(key, nonce), "key -n:nonce:bytes")


def poly1305(key: bytes, data: bytes) -> bytes:
    r, s, a = int.from_bytes(key[:16], "little") & 0x0FFFFFFC0FFFFFFC0FFFFFFC0FFFFFFF, int.from_bytes(key[16:], "little"), 0
    for part in _parts(data, 16):
        a = (a + int.from_bytes(part + b"\1", "little")) * r % ((1 << 130) - 5)
    return (a + s & (1 << 128) - 1).to_bytes(16, "little")


def _aead(data, key, nonce, tag, aad, encrypting):
    stream = arx(False, len(nonce) == 24)(key, nonce)
    mac_key, out = next(stream)[:32], bytearray()
    if not encrypting and not tag:
        data, tag = data[:-16], data[-16:]
    for part in _parts(data, 64):
        out += xored(part, next(stream))
    coded = bytes(out) if encrypting else data
    fill = lambda x: x + bytes(-len(x) % 16)
    mac = poly1305(mac_key, fill(aad) + fill(coded) + struct.pack("<QQ", len(aad), len(coded)))
    if encrypting:
        return coded + mac
    if not hmac.compare_digest(mac, tag):
        raise ValueError("the tag does not fit")
    return bytes(out)


@unit("chacha20poly1305", "key -n:nonce:bytes -t:tag:bytes -a:aad:bytes")
def chacha20poly1305(data, key, nonce=bytes(8), tag=None, aad=None):
    """ChaCha20-Poly1305; the tag is given, or ends the input."""
    return _aead(data, key, nonce, tag, aad or b"", False)


chacha20poly1305.reverse(lambda data, key, nonce=bytes(8), tag=None, aad=None: _aead(data, key, nonce, None, aad or b"", True))


def rc4(key, size=256, body=None):
    from millrace.functions.blockwise import Formula

    t, j = [*range(size)], 0
    for i in range(size):
        j = (j + t[i] + key[i % len(key)]) % size
        t[i], t[j] = t[j], t[i]
    formula = Formula(body) if body else None
    a = b = 0
    while True:
        piece = bytearray()
        for _ in range(256):
            a = (a + 1) % size
            b = (b + t[a]) % size
            t[a], t[b] = t[b], t[a]
            at = t[(t[a] + t[b]) % size] if formula is None else formula({"T": t, "A": a, "B": b, "K": key})
            piece.append(at & 255)
        yield bytes(piece)


stream_cipher("rc4", rc4, "key")
stream_cipher("rc4mod", lambda key, size=256, body=None: rc4(key, size, None if body in (None, "T[T[A]+T[B]]") else body), "key -t:size:int=256 -b:body:str", "RC4 with a table of another size, or another formula of its output.")


def rabbit(key, iv=b""):
    k = struct.unpack("<8H", key)
    x, c = [], []
    for i in range(8):
        x.append(k[(i + 1) % 8] << 16 | k[i] if i % 2 == 0 else k[(i + 5) % 8] << 16 | k[(i + 4) % 8])
        c.append(k[(i + 4) % 8] << 16 | k[(i + 5) % 8] if i % 2 == 0 else k[i] << 16 | k[(i + 1) % 8])
    carry = 0
    add = (0x4D34D34D, 0xD34D34D3, 0x34D34D34, 0x4D34D34D, 0xD34D34D3, 0x34D34D34, 0x4D34D34D, 0xD34D34D3)

    def step():
        nonlocal carry
        for i in range(8):
            v = c[i] + add[i] + carry
            c[i], carry = v & M32, v >> 32
        g = []
        for i in range(8):
            v = (x[i] + c[i] & M32) ** 2
            g.append((v ^ v >> 32) & M32)
        for i in range(8):
            p, q = g[i - 1], g[i - 2]
            x[i] = g[i] + (rol(p, 16) + rol(q, 16) if i % 2 == 0 else rol(p, 8) + q) & M32

    for _ in range(4):
        step()
    for i in range(8):
        c[i] ^= x[(i + 4) % 8]
    if iv:
        a, b = struct.unpack("<2I", iv[:8])
        e = (a, b & 0xFFFF0000 | a >> 16, b, b << 16 & M32 | a & 0xFFFF)
        for i in range(8):
            c[i] ^= e[i % 4]
        for _ in range(4):
            step()
    while True:
        step()
        s = []
        for i in range(0, 8, 2):
            s.append(x[i] ^ x[(i + 5) % 8] >> 16 ^ x[(i + 3) % 8] << 16 & M32)
        yield struct.pack("<4I", *s)


stream_cipher("rabbit", rabbit, "key -i:iv:bytes")
_f1 = lambda x: ror(x, 7) ^ ror(x, 18) ^ x >> 3
_f2 = lambda x: ror(x, 17) ^ ror(x, 19) ^ x >> 10


def hc128(key):
    k, v = struct.unpack("<4I", key[:16]), struct.unpack("<4I", key[16:32].ljust(16, b"\0"))
    w = [*k, *k, *v, *v]
    for i in range(16, 1280):
        w.append(_f2(w[i - 2]) + w[i - 7] + _f1(w[i - 15]) + w[i - 16] + i & M32)
    p, q = w[256:768], w[768:1280]

    def step(i):
        j = i % 512
        a, b = (p, q) if i % 1024 < 512 else (q, p)
        x, y, z = a[j - 3], a[j - 10], a[j - 511]
        a[j] = a[j] + ((ror(x, 10) ^ ror(z, 23)) + ror(y, 8) if a is p else (rol(x, 10) ^ rol(z, 23)) + rol(y, 8)) & M32
        t = a[j - 12]
        return (b[t & 255] + b[256 + (t >> 16 & 255)] & M32) ^ a[j]

    for i in range(1024):
        out = step(i)
        (p if i < 512 else q)[i % 512] = out
    i = 0
    while True:
        yield struct.pack("<16I", *(step(i + n) for n in range(16)))
        i += 16


def hc256(key, iv=bytes(32)):
    w = [*struct.unpack("<8I", key[:32].ljust(32, b"\0")), *struct.unpack("<8I", iv[:32].ljust(32, b"\0"))]
    for i in range(16, 2560):
        w.append(_f2(w[i - 2]) + w[i - 7] + _f1(w[i - 15]) + w[i - 16] + i & M32)
    p, q = w[512:1536], w[1536:2560]

    def step(i):
        j = i % 1024
        a, b = (p, q) if i % 2048 < 1024 else (q, p)
        x, y = a[j - 3], a[j - 1023]
        a[j] = a[j] + a[j - 10] + (ror(x, 10) ^ ror(y, 23)) + b[(x ^ y) & 1023] & M32
        t = a[j - 12]
        return (sum(b[256 * n + (t >> 8 * n & 255)] for n in range(4)) & M32) ^ a[j]

    for i in range(4096):
        step(i)
    i = 0
    while True:
        yield struct.pack("<16I", *(step(i + n) for n in range(16)))
        i += 16


stream_cipher("hc128", hc128, "key")
stream_cipher("hc256", hc256, "key -i:iv:bytes")


def isaac(key):
    m, n = [0] * 256, len(key) // 4
    seed = list(struct.unpack(f"<{n}I", key[: 4 * n])) + [int.from_bytes(key[4 * n :], "little")] * bool(len(key) % 4)
    r = (seed + [0] * 256)[:256]
    s = [_DELTA] * 8

    def shuffle():
        for i, (n, left) in enumerate(((11, True), (2, False), (8, True), (16, False), (10, True), (4, False), (8, True), (9, False))):
            s[i] ^= s[(i + 1) % 8] << n & M32 if left else s[(i + 1) % 8] >> n
            s[(i + 3) % 8] = s[(i + 3) % 8] + s[i] & M32
            s[(i + 1) % 8] = s[(i + 1) % 8] + s[(i + 2) % 8] & M32

    for _ in range(4):
        shuffle()
    for source in (r, m):
        for i in range(0, 256, 8):
            for j in range(8):
                s[j] = s[j] + source[i + j] & M32
            shuffle()
            m[i : i + 8] = s
    a = b = c = 0
    while True:
        c = c + 1 & M32
        b = b + c & M32
        out = []
        for i in range(256):
            x = m[i]
            a ^= (a << 13 & M32, a >> 6, a << 2 & M32, a >> 16)[i % 4]
            a = m[(i + 128) % 256] + a & M32
            m[i] = y = m[x >> 2 & 255] + a + b & M32
            b = m[y >> 10 & 255] + x & M32
            out.append(b)
        yield struct.pack("<256I", *out)


stream_cipher("isaac", isaac, "key")


def blabla(key, nonce=bytes(16), rounds=10):
    consts = (0x6170786593810FAB, 0x3320646EC7398AEE, 0x79622D3217318274, 0x6B206574BABADADA, 0x2AE36E593E46AD5F, 0xB68F143029225FC9, 0x8DA1E08468303AA6, 0xA48A209ACD50A4A7, 0x7FDC12F23F90778C)
    k, n = struct.unpack("<4Q", key[:32]), struct.unpack("<2Q", nonce[:16])
    count = 1
    while True:
        v = [*consts[:4], *k, *consts[4:9], count, *n]
        x = list(v)
        for _ in range(rounds):
            for a, b, c, d in _CHACHA:
                for p, q, r, s in ((a, b, d, 32), (c, d, b, 24), (a, b, d, 16), (c, d, b, 63)):
                    x[p] = x[p] + x[q] & M64
                    x[r] = ror(x[r] ^ x[p], s, 64)
        yield struct.pack("<16Q", *(p + q & M64 for p, q in zip(x, v, strict=True)))
        count += 1


stream_cipher("blabla", blabla, "key -n:nonce:bytes -r:rounds:int=10")


# ---------------------------------------------------------------- letters
@unit("rot", "amount:int=13")
def rot(data, amount=13):
    """Rotates the alphabet."""
    k = amount % 26
    low, up = string.ascii_lowercase, string.ascii_uppercase
    return data.translate(bytes.maketrans((low + up).encode(), (low[k:] + low[:k] + up[k:] + up[:k]).encode()))


rot.reverse(lambda data, amount=13: rot.forward(data, -amount))


@rot.column
def _(c, amount=13):
    k, low, up = amount % 26, string.ascii_lowercase, string.ascii_uppercase
    return unlatin(F.translate(latin(c), low + up, low[k:] + low[:k] + up[k:] + up[:k]))


@unit("vigenere", "key alphabet?=abcdefghijklmnopqrstuvwxyz operator:str=add -c:case_sensitive -i:ignore_unknown")
def vigenere(data, key, alphabet=None, operator="add", case_sensitive=False, ignore_unknown=False, sign=-1):
    """Vigenère and its relatives over any alphabet; ``add``, ``sub``, ``bf1`` (Beaufort) and ``bf2``."""
    alphabet = alphabet or string.ascii_lowercase.encode()
    at = {c: i for i, c in enumerate(alphabet)}
    shift = [at[c if case_sensitive else bytes((c,)).lower()[0]] for c in key]
    out, i, n = bytearray(), 0, len(alphabet)
    for c in data:
        low = c if case_sensitive else bytes((c,)).lower()[0]
        if low not in at:
            out.append(c)
            continue
        k, x = shift[i % len(shift)], at[low]
        i += 1
        y = alphabet[{"add": x + sign * k, "sub": x - sign * k, "bf1": k - x, "bf2": x - k if sign > 0 else x + k}[operator] % n]
        out.append(y if case_sensitive or low == c else bytes((y,)).upper()[0])
    return bytes(out)


vigenere.reverse(lambda data, **kw: vigenere.forward(data, **kw, sign=1))


@unit("codebook", "*words")
def codebook(data, words=()):
    """Words of a book to their indices, which are bytes."""
    book = [w for x in words for w in x.split()]
    at, out = {w: i for i, w in enumerate(book)}, bytearray()
    for w in data.split():
        out.append(at[w])
    return bytes(out)


codebook.reverse(lambda data, words=(): b" ".join([w for x in words for w in x.split()][b] for b in data))


# ---------------------------------------------------------------- formats of encrypted data
@unit("fernet", "key")
def fernet(data, key):
    """Fernet messages; the key in base64 or as 32 bytes. The signature is not required to fit."""
    key = key if len(key) == 32 else base64.urlsafe_b64decode(key + b"=" * (-len(key) % 4))
    raw = base64.urlsafe_b64decode(data.strip() + b"=" * (-len(data.strip()) % 4))
    if raw[0] != 0x80:
        raise ValueError("no Fernet message")
    enc, dec = rijndael(key[16:])
    return run_mode(raw[25:-32], 16, enc, dec, raw[9:25], "CBC", False, "pkcs7")


@unit("secstr", "-k:key:bytes -i:iv:bytes")
def secstr(data, key=None, iv=None):
    """Secure strings of PowerShell under a key."""
    from millrace.functions.codecs import hex_

    key = key or bytes(range(1, 17))
    text = base64.b64decode(data[32:] if data[:4] == b"7649" else data).decode("utf-16le").split("|")
    enc, dec = rijndael(key)
    return run_mode(hex_.one(text[2].encode()), 16, enc, dec, base64.b64decode(text[1]), "CBC", False, "pkcs7").decode("utf-16le").encode()


@secstr.reverse
def _(data, key=None, iv=None):
    key, iv = key or bytes(range(1, 17)), iv or bytes(16)
    enc, dec = rijndael(key)
    body = run_mode(data.decode().encode("utf-16le"), 16, enc, dec, iv, "CBC", True, "pkcs7")
    return b"76492d1116743f0423413b16050a5345" + base64.b64encode(f"2|{base64.b64encode(iv).decode()}|{body.hex()}".encode("utf-16le"))


@unit("rncrypt", "password")
def rncrypt(data, password):
    """RNCryptor messages, version 3, under a password."""
    if data[0] not in (2, 3) or not data[1] & 1:
        raise ValueError("no RNCryptor message under a password")
    a, b, iv, body, mac = data[2:10], data[10:18], data[18:34], data[34:-32], data[-32:]
    key, check = (hashlib.pbkdf2_hmac("sha1", password, s, 10_000, 32) for s in (a, b))
    if not hmac.compare_digest(hmac.digest(check, data[:-32], "sha256"), mac):
        raise ValueError("the signature does not fit")
    enc, dec = rijndael(key)
    return run_mode(body, 16, enc, dec, iv, "CBC", False, "pkcs7")


@rncrypt.reverse
def _(data, password):
    seed = hashlib.sha256(password + data).digest()
    a, b, iv = seed[:8], seed[8:16], seed[16:]
    key, check = (hashlib.pbkdf2_hmac("sha1", password, s, 10_000, 32) for s in (a, b))
    enc, dec = rijndael(key)
    out = bytes((3, 1)) + a + b + iv + run_mode(data, 16, enc, dec, iv, "CBC", True, "pkcs7")
    return out + hmac.digest(check, out, "sha256")
