"""Units against published vectors, inverses and standard libraries."""

import hashlib
import random

import pytest

from millrace.functions import UNITS
from millrace.functions import ciphers as c

# fixed values: published test vectors
DIGESTS = [
    ("md2", b"abc", "da853b0d3f88d99b30283a69e6ded6bb"), ("md4", b"abc", "a448017aaf21d8525fc10ae87aa6729d"), ("ripemd160", b"abc", "8eb208f7e05d987a9b044a8e98c6b087f15a0bfc"), ("ripemd128", b"abc", "c14a12199c66e4ba84636b0f69144c77"),
    ("keccak", b"", "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"), ("sm3", b"abc", "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"), ("m3h", b"hello", "248bfa47"), ("m3h64", b"hello", "cbd8a7b341bd9b025b1e906a48ae1d19"), ("fnv1a", b"a", "e40c292c"), ("ntlm", b"password", "8846f7eaee8fb117ad06bdd830b7586c"), ("djb2", b"a", "0002b606"),
]
BLOCKS = [
    (c.rijndael, bytes(range(16)), "00112233445566778899aabbccddeeff", "69c4e0d86a7b0430d8cdb78070b4c55a"), (c.sm4, bytes.fromhex("0123456789abcdeffedcba9876543210"), "0123456789abcdeffedcba9876543210", "681edf34d206965e86b3e94f536e4246"), (c.blowfish, bytes(8), "00" * 8, "4ef997456198dd78"), (c.serpent, bytes(16), "00" * 16, "3620b17ae6a993d09618b8768266bae9"),
    (c.twofish, bytes(16), "00" * 16, "9f589f5cf6122c32b6bfec2f2ae8c35a"), (c.rc5, bytes(16), "00" * 8, "21a5dbee154b8f6d"), (lambda k: c.rc5(k, 20, 32, True), bytes(16), "00" * 16, "8fc3a53656b1f778c129df4e9848a41e"), (c.speck, bytes(range(16)), "206d616465206974206571756976616c", "180d575cdffe60786532787951985da6"),
    (lambda k: c.gost(k, True), bytes.fromhex("ffeeddccbbaa99887766554433221100f0f1f2f3f4f5f6f7f8f9fafbfcfdfeff"), "fedcba9876543210", "4ee901e5c2d8ca3d"), (c.tea_like(c._tea_enc, c._tea_dec), bytes(16), "00" * 8, "41ea3a0a94baa940"), (c.tea_like(c._xtea_enc, c._xtea_dec), bytes(16), "00" * 8, "dee9d4d8f7131ed9"),
]
STREAMS = [
    (c.arx(False, False)(bytes(32), bytes(8)), "76b8e0ada0f13d90405d6ae55386bd28"), (c.arx(True, False)(b"\x80" + bytes(31), bytes(8)), "e3be8fdd8beca2e3"), (c.rabbit(bytes(16)), "02f74a1c26456bf5ecd6a536f05457b1"), (c.hc128(bytes(32)), "82001573a003fd3b7fd72ffb0eaf63aa"), (c.hc256(bytes(32)), "5b078985d8f6f30d42c5c02fa6b67951"),
]


@pytest.mark.parametrize(("name", "data", "want"), DIGESTS)
def test_digests(name, data, want):
    assert UNITS[name].one(data).hex() == want == UNITS[name].one(data, text=True).decode()


@pytest.mark.parametrize("name", ["md5", "sha1", "sha224", "sha256", "sha384", "sha512", "blake2b", "blake2s"])
def test_digests_of_the_library(name):
    assert UNITS[name].one(b"x") == hashlib.new(name, b"x").digest()


@pytest.mark.parametrize(("make", "key", "plain", "want"), BLOCKS)
def test_blocks(make, key, plain, want):
    enc, dec = make(key)
    assert enc(bytes.fromhex(plain)).hex() == want and dec(bytes.fromhex(want)).hex() == plain


@pytest.mark.parametrize(("stream", "want"), STREAMS)
def test_streams(stream, want):
    assert next(stream).hex().startswith(want)


CIPHERS = {
    "aes": {"key": bytes(16), "iv": bytes(range(16))}, "blowfish": {"key": b"abcdefg"}, "serpent": {"key": bytes(24)}, "twofish": {"key": bytes(24)}, "sm4": {"key": bytes(16)}, "tea": {"key": bytes(16)}, "xtea": {"key": bytes(16)}, "xxtea": {"key": bytes(16)}, "rc4": {"key": b"k"}, "rc5": {"key": bytes(16)}, "rc6": {"key": bytes(16)}, "speck": {"key": bytes(16)}, "simon": {"key": bytes(16)},
    "chaskey": {"key": bytes(range(16))}, "gost": {"key": bytes(32)}, "rijndael": {"key": bytes(16), "block_size": 32}, "vigenere": {"key": b"lemon"}, "chacha20poly1305": {"key": bytes(32), "nonce": bytes(12)}, "secstr": {}, "rncrypt": {"password": b"x"}, "isaac": {"key": b"key!"}, "blabla": {"key": bytes(32)}, "salsa": {"key": bytes(32)}, "xchacha": {"key": bytes(32), "nonce": bytes(24)}, "rot": {},
}


@pytest.mark.parametrize("name", CIPHERS)
def test_ciphers_are_inverse(name):
    data = b"The quick brown fox jumps over the lazy dog!"
    assert UNITS[name].one(UNITS[name].undo(data, **CIPHERS[name]), **CIPHERS[name]) == data


@pytest.mark.parametrize("mode", ["ECB", "CBC", "PCBC", "CTR", "OFB", "CFB"])
def test_modes(mode):
    kw = {"key": bytes(16), "mode": mode} | ({} if mode == "ECB" else {"iv": bytes(range(16))})
    assert UNITS["aes"].one(UNITS["aes"].undo(b"some text of no special length", **kw), **kw) == b"some text of no special length"


def test_argon2():
    got = UNITS["argon2"].one(b"\1" * 32, size=32, salt=b"\2" * 16, iter=3, jobs=4, cost=32, skey=b"\3" * 8, more=b"\4" * 12)
    assert got.hex() == "512b391b6f1162975371d30919734294f868e3be3984f3c1a13a4db9fabe4acb"


BUFFERS = [b"A" * 1024, b"B" + b"A" * 1024, b"FOO" * 200, bytes(range(1, 200)), b"The quick brown fox jumps over the lazy dog. " * 9, random.Random(3).randbytes(300), b"x"]


@pytest.mark.parametrize("name", ["zl", "bz2", "lzma", "zstd", "lzf", "lzjb", "lznt1", "flz", "aplib", "blz", "hex", "b64", "b32", "b85", "a85", "z85", "b58", "b62", "b92", "base", "netbios", "qp", "uuenc", "url", "esc", "b65536", "hexload"])
def test_codecs_are_inverse(name):
    for data in BUFFERS:
        assert UNITS[name].one(UNITS[name].undo(data)) == data


def test_documents():
    assert UNITS["msgpack"].one(UNITS["msgpack"].undo(b'{"a": [1, -5, "x", null, 1.5, 300]}')).split() == b'{ "a": [ 1, -5, "x", null, 1.5, 300 ] }'.split()
    assert UNITS["csv"](b'a,b\r\n1,"y ""q"""\r\n')[0][0].split() == b'{ "a": 1, "b": "y \\"q\\"" }'.split()
    assert [m["path"] for _, m in UNITS["xtxml"](b"<a><b>t</b></a>")] == [b"a", b"a/b"]
    assert UNITS["dsphp"].one(UNITS["dsphp"].undo(b'[1, "x", {"k": true}]')).split() == b'[ 1, "x", { "k": true } ]'.split()


def test_patterns():
    assert {x for x, _ in UNITS["xtp"](b"see http://www.example.com/a?b=1, mail joe.doe@example.org", pattern=("url", "email"))} == {b"http://www.example.com/a?b=1", b"joe.doe@example.org"}
    assert UNITS["defang"].undo(UNITS["defang"].one(b"http://evil.example.com/x")) == b"http://evil.example.com/x"
    assert [m["offset"] for _, m in UNITS["rex"](b"a1b22", regex=rb"\d+")] == [1, 3]
    assert UNITS["resplit"](b"a,b;c", regex=rb"([,;])")[1][0] == b","


@pytest.mark.parametrize(("text", "want"), [(b"2020:01:02 03:04:05", b"2020-01-02 03:04:05"), (b"2020-01-02T03:04:05+02:00", b"2020-01-02 01:04:05"), (b"0x5F000000", b"2020-07-04 04:05:20"), (b"1594155600000", b"2020-07-07 21:00:00"), (b"20200102030405", b"2020-01-02 03:04:05"), (b"no  date", b"no date")])
def test_dates(text, want):
    assert UNITS["datefix"].one(text) == want


def test_keys():
    text = b"This is a fairly long english text with many spaces in it, really. " * 5
    assert UNITS["autoxor"].one(UNITS["xor"].one(text, argument=b"key")) == text


def test_keys_by_plaintext_at_any_offset():
    import random

    crib = b"a known plaintext of more than 32 bytes stands far behind"
    body = random.Random(3).randbytes(100_001)
    data = body + crib + body
    mixed = UNITS["xor"].one(data, argument=b"key")
    assert UNITS["xkey"].one(mixed, plaintext=crib) == b"key" and UNITS["autoxor"].one(mixed, plaintext=crib) == data
    added = bytes((c + k) & 255 for c, k in zip(data, b"key" * len(data), strict=False))
    assert UNITS["autoxor"].one(added, plaintext=crib) == data
    assert UNITS["xkey"].one(mixed, plaintext=crib, searchpos=slice(100_001, 100_001)) == b"key"
    assert UNITS["xkey"].one(mixed, plaintext=crib, searchpos=slice(0, 100_000)) == b"\0" == UNITS["xkey"].one(mixed, plaintext=crib, searchpos=slice(100_002, None))


def test_every_unit_is_described():
    assert all(u.text for u in UNITS.values()) and len(UNITS) > 230
