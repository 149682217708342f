"""Tokenizer files on the executors, with a bounded memo of the pieces that every text repeats.

The tokenizers library does all the encoding. Text is cut into units where no token can reach across, and each distinct unit is
encoded once per Python worker, since calling the library on the same words again and again is most of its cost.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np

from millrace.llm.shared import LOWER, NON_SPACE, ragged, word_hashes, words

#: Slots of a worker's table of units; when it is half full, it starts anew.
SLOTS = 1 << 21
#: Longer units are encoded each time.
UNIT_BYTES = 64

# 0 white space, 1 letters, 2 digits, 3 others, 4 beyond ASCII
_KIND = np.full(256, 3, np.uint8)
_KIND[~NON_SPACE] = 0
_KIND[0x61:0x7B] = 1
_KIND[0x30:0x3A] = 2
_KIND[0x80:] = 4
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def rank_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A byte-level BPE of the tokenizers library that merges as the ranks say: always the pair whose join has the least rank.

    A token can arise from several pairs, so each split of it into two tokens is a merge, in the order of ranks.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    to = byte_characters()
    shown = {token: "".join(to[b] for b in token) for token in ranks}
    merges = [
        (shown[token[:i]], shown[token[i:]])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    made = Tokenizer(model)
    made.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return made


def word_units(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of units whose tokens do not depend on what stands around them, for a pre-tokenizer that drops white space and keeps
    runs of letters, single digits and runs of other characters apart.

    A word with an apostrophe, or with characters beyond the letters of Latin-1, is one unit: there the library decides.
    """
    body = LOWER[body]
    n = len(body)
    after = body[1:]
    lead = np.zeros(n, bool)
    lead[:-1] = (body[:-1] == 0xC3) & (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
    trail = np.zeros(n, bool)
    trail[1:] = lead[:-1]
    body[trail & (body <= 0x9E)] += 0x20
    kind = _KIND[body]
    kind[lead | trail] = 1
    odd = np.concatenate(([0], np.cumsum((kind == 4) | (body == 0x27))))
    starts, ends, _ = words(body, offsets, NON_SPACE)
    whole = odd[ends] > odd[starts]
    new = np.ones(n + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    new[offsets] = True
    new[ragged(starts[whole] + 1, ends[whole] - starts[whole] - 1)] = False
    cuts = np.flatnonzero(new)
    seen = kind[cuts[:-1]] != 0
    return body, cuts[:-1][seen], cuts[1:][seen]


def piece_units(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for patterns that keep white space and put it before words: cuts stand where ASCII white space follows another character.
    A document with white space beyond ASCII is one unit."""
    space = ~NON_SPACE[body]
    new = np.zeros(len(body) + 1, bool)
    new[1:-1] = space[1:] & ~space[:-1]
    at = np.flatnonzero(_WIDE_LEAD[body])
    if len(at):
        b = np.concatenate((body, np.zeros(2, np.uint8)))
        one, two, three = b[at], b[at + 1], b[at + 2]
        wide = ((one == 0xC2) & ((two == 0x85) | (two == 0xA0))) | ((one == 0xE1) & (two == 0x9A)) | ((one == 0xE3) & (two == 0x80) & (three == 0x80))
        wide |= (one == 0xE2) & (((two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))) | ((two == 0x81) & (three == 0x9F)))
        docs = np.unique(np.searchsorted(offsets, at[wide], side="right") - 1)
        new[ragged(offsets[docs], offsets[docs + 1] - offsets[docs])] = False
    new[offsets] = True
    cuts = np.flatnonzero(new)
    return body, cuts[:-1], cuts[1:]


class Encoder:
    """Encodes whole texts, unit by unit, and remembers units in an open-addressed table of their 64-bit hashes.

    A hit must also have the unit's length and its first and last bytes. ``added`` has tokens that the library takes out of the raw text before all else, with their ids;
    what stands on their two sides is encoded apart. With them, ``units`` must drop white space.
    """

    def __init__(self, tokenizer, kind: str, units, added: dict[bytes, int] | None = None):
        self.tokenizer, self.kind, self.units, self.added = tokenizer, np.dtype(kind), units, added or {}
        self.pattern = re.compile(b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self.clear()

    def clear(self) -> None:
        self.keys, self.marks = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.at, self.size = np.zeros(SLOTS, np.uint32), np.zeros(SLOTS, np.uint16)
        self.pool, self.used, self.known = np.zeros(1 << 16, self.kind), 0, 0

    def _direct(self, pieces: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]

    def _find(self, h: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Slots of units, -1 for unknown ones."""
        mask = np.uint64(SLOTS - 1)
        slot = (h & mask).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        while len(todo):
            here = self.keys[slot]
            same = (here == h[todo]) & (self.marks[slot] == marks[todo])
            out[todo[same]] = slot[same]
            more = ~same & (here != 0)
            todo, slot = todo[more], (slot[more] + 1) & (SLOTS - 1)
        return out

    def _insert(self, h: np.ndarray, marks: np.ndarray, ids: list[list[int]]) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        at = self.used + np.cumsum(size) - size
        need = self.used + int(size.sum())
        if need > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(max(need, len(self.pool)), self.kind)))
        self.pool[self.used : need] = np.fromiter((i for x in ids for i in x), self.kind, int(size.sum()))
        self.used, self.known = need, self.known + len(ids)
        slot, todo = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[todo[free]]
            own = free & (self.keys[slot] == h[todo])
            _, first = np.unique(slot[own], return_index=True)  # equal hashes of different units take turns
            won = np.flatnonzero(own)[first]
            self.marks[slot[won]], self.at[slot[won]], self.size[slot[won]] = marks[todo[won]], at[todo[won]], size[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, slot = todo[rest], (slot[rest] + 1) & (SLOTS - 1)

    def encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a slice, and where each document's begin (one more at the end)."""
        data = body.tobytes() if self.added else b""
        if not any(t in data for t in self.added):
            return self._encode(body, offsets)
        found = [m for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for m in self.pattern.finditer(data, a, b)]
        hits = np.array([m.start() for m in found], np.int64)
        body = body.copy()
        body[ragged(hits, np.array([len(m[0]) for m in found], np.int64))] = 0x20
        every = np.sort(np.concatenate((offsets, hits)))
        ids, at = self._encode(body, every)
        ids = np.insert(ids, at[np.searchsorted(every, hits)], np.array([self.added[m[0]] for m in found], self.kind))
        return ids, at[np.searchsorted(every, offsets)] + np.searchsorted(hits, offsets)

    def _encode(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        body, starts, ends = self.units(body, offsets)
        data, length = body.tobytes(), ends - starts
        h = word_hashes(body, starts, ends) | np.uint64(1)
        padded = np.concatenate((body, np.zeros(4, np.uint8)))
        marks = np.minimum(length, 255).astype(np.uint64)
        for i in range(3):
            marks = (marks << np.uint64(16)) | (padded[starts + np.minimum(i, length - 1)].astype(np.uint64) << np.uint64(8)) | padded[ends - 1 - np.minimum(i, length - 1)]
        slot = self._find(h, marks)
        new = np.flatnonzero(slot < 0)
        long = length[new] > UNIT_BYTES
        if self.known + len(new) > SLOTS // 2:
            self.clear()
            slot = np.full(len(h), -1, np.int64)
            new = np.arange(len(h))
            long = length > UNIT_BYTES
        extra, new = new[long], new[~long]
        if len(new):
            _, first = np.unique(np.stack((h[new], marks[new]), 1).view("V16").ravel(), return_index=True)
            fresh = new[first]
            self._insert(h[fresh], marks[fresh], self._direct([data[starts[i] : ends[i]] for i in fresh.tolist()]))
            slot[new] = self._find(h[new], marks[new])
        size, at = self.size[slot].astype(np.int64), self.at[slot].astype(np.int64)
        pool = self.pool
        if len(extra):
            ids = self._direct([data[starts[i] : ends[i]] for i in extra.tolist()])
            size[extra] = [len(x) for x in ids]
            at[extra] = self.used + np.cumsum(size[extra]) - size[extra]
            pool = np.concatenate((pool[: self.used], np.array([i for x in ids for i in x], self.kind)))
        upto = np.concatenate(([0], np.cumsum(size)))
        return pool[ragged(at, size)], upto[np.searchsorted(starts, offsets)]


@functools.lru_cache(4)
def word_encoder(path: str, kind: str) -> Encoder:
    """For a file of the tokenizers library whose pre-tokenizer drops white space. Special tokens in a text are found before it is cut into units, as units could break or,
    in lower case, make them; so the library is told that units hold none."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens") or []
    if any(not t["special"] or t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens must be special ones that are matched in the raw text as they are")
    tokenizer.encode_special_tokens = True
    return Encoder(tokenizer, kind, word_units, {t["content"].encode(): t["id"] for t in added})


@functools.lru_cache(4)
def rank_encoder(path: str, pattern: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(rank_tokenizer(read_ranks(path), pattern), "<u4", piece_units)


@functools.lru_cache(4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes in the order of ids, and where each starts (one more at the end), by reversing the byte table of the vocabulary."""
    ranks = read_ranks(path)
    back = {c: b for b, c in enumerate(byte_characters())}
    to = byte_characters()
    by_id = {r: "".join(to[b] for b in t) for t, r in ranks.items()}
    size = max(by_id, default=-1) + 1
    pieces = [bytes(back[c] for c in by_id.get(i, "")) for i in range(size)]
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])
