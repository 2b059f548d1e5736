"""Whole batches of text to token ids through a table of chunks that a worker has met before.

Text is cut where the tokenizer's own split always cuts. Chunks are found, hashed and looked up as arrays; only chunks
that are new to the worker are encoded, so cost is mostly that of reading bytes. A table serves all tasks of its worker;
once it holds ``remembered`` chunks, the first it met and so the most usual ones, others are encoded where they stand,
and if too many are unknown it starts anew. Tables are keyed by 64-bit hashes of chunk and length: with a million chunks
known, a new one is taken for another with a chance below 1e-13.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Chunks that a worker's table keeps from task to task, and bytes of text that it looks up at once.
REMEMBERED, SLICE = 500_000, 1 << 19
#: Share of unknown chunks at which a full table is given up for a new one.
STALE = 0.3

_U = np.uint64
_EMPTY = _U(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = _U(0x2545F4914F6CDD1D)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_ODD = np.zeros(256, bool)  # white space, or what Python or Unicode takes for it, beside space and line feed; and NUL
_ODD[[0, 0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array; null is empty."""
    text = text.cast(pa.large_string()).fill_null("")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if n and text.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Where white space of two or three bytes begins."""
    found = [np.empty(0, np.int64)]
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data[:-1] == lead)
        second = data[at + 1]
        third = data[np.minimum(at + 2, len(data) - 1)]
        if lead == 0xC2:
            hit = (second == 0x85) | (second == 0xA0)
        elif lead == 0xE1:
            hit = (second == 0x9A) & (third == 0x80)
        elif lead == 0xE2:
            hit = (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF)) | (second == 0x81) & (third == 0x9F)
        else:
            hit = (second == 0x80) & (third == 0x80)
        found.append(at[hit])
    return np.concatenate(found)


def cut_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of runs without ASCII white space, and which texts must be left whole: those in which a special token may stand."""
    inside = ~_SPACE[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = inside[heads]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    stops[tails] = inside[tails]
    whole = np.zeros(len(offsets) - 1, bool)
    special = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C))
    whole[np.searchsorted(offsets, special, "right") - 1] = True
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1, whole


def cut_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of words with the space before them and of line feeds, and which texts must be left whole.

    The byte-level split pattern always cuts before a space, and around a line feed, that has no white space beside it:
    only white space runs look at what follows, and a run of one is matched as such. Texts with longer runs or other
    white space are left whole.
    """
    n = len(offsets) - 1
    space, feed = data == 0x20, data == 0x0A
    white = space | feed
    begins = white.copy()
    begins[1:] |= feed[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    odd = _ODD[data]
    odd[:-1] |= white[:-1] & white[1:]
    if len(data) > 1:
        odd[_wide_space(data)] = True
    at = np.flatnonzero(odd)
    whole = np.zeros(n, bool)
    whole[np.searchsorted(offsets, at, "right") - 1] = True
    return starts, np.append(starts[1:], len(data)), whole


class ChunkTable:
    """Token ids of chunks by hash: an open-addressing table of places in one flat array of ids."""

    def __init__(self, cut: Callable, encode_all: Callable[[list[str]], list[np.ndarray]], lower: bool = False, remembered: int = REMEMBERED):
        """``lower``: the tokenizer lower-cases, so A-Z may be before."""
        self.cut, self.encode_all, self.lower, self.remembered = cut, encode_all, lower, remembered
        self._clear()

    def _clear(self) -> None:
        self.bits, self.known = 16, 0
        self.slots, self.place = np.full(1 << self.bits, _EMPTY, _U), np.zeros(1 << self.bits, np.int32)
        self.first, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)  # first[i]: where chunk i's ids begin

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> _U(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's chunk, -1 where it isn't known."""
        slot = self._slot(keys)
        there = self.slots[slot]
        out = self.place[slot].copy()
        todo = np.flatnonzero(there != keys)
        out[todo] = -1
        slot, there = slot[todo], there[todo]
        while True:
            on = there != _EMPTY
            todo, slot = todo[on], slot[on] + 1 & (1 << self.bits) - 1
            if not len(todo):
                return out
            there = self.slots[slot]
            hit = there == keys[todo]
            out[todo[hit]] = self.place[slot[hit]]
            todo, slot, there = todo[~hit], slot[~hit], there[~hit]

    def _insert(self, keys: np.ndarray, number: np.ndarray) -> None:
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.slots[slot] == _EMPTY
            self.slots[slot[free]] = keys[todo[free]]  # of several for one slot the last stays
            won = self.slots[slot] == keys[todo]
            self.place[slot[won]] = number[todo[won]]
            todo, slot = todo[~won], slot[~won] + 1 & (1 << self.bits) - 1

    def _learn(self, keys: np.ndarray, chunks: list[str], insert: bool = True) -> None:
        lists = self.encode_all(chunks)
        sizes = np.array([len(x) for x in lists], np.int64)
        start = int(self.first[self.known])
        total, n = start + int(sizes.sum()), self.known + len(keys)
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(total, 2 * len(self.ids)) - len(self.ids), np.uint32)])
        if n + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(n + 1, 2 * len(self.first)) - len(self.first), np.int64)])
        if lists:
            self.ids[start:total] = np.concatenate(lists)
        self.first[self.known + 1 : n + 1] = start + np.cumsum(sizes)
        number = np.arange(self.known, n, dtype=np.int32)
        self.known = n
        if not insert:
            return
        if 2 * n > len(self.slots):
            used = self.slots != _EMPTY
            keys, number = np.concatenate([self.slots[used], keys]), np.concatenate([self.place[used], number])
            self.bits = (3 * n).bit_length()
            self.slots, self.place = np.full(1 << self.bits, _EMPTY, _U), np.zeros(1 << self.bits, np.int32)
        self._insert(keys, number)

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, n + 1 offsets); null is empty."""
        data, offsets = buffers(text)
        n = len(offsets) - 1
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
        starts, ends, whole = self.cut(data, offsets)
        given = data
        if self.lower:
            data = _LOWER[data]
        doc = np.searchsorted(offsets, starts, "right") - 1
        sizes = ends - starts
        keys = self._keys(data, starts, sizes)
        use = ~whole[doc]
        starts, ends, doc, keys = starts[use], ends[use], doc[use], keys[use]
        number = self._find(keys)
        fresh = np.flatnonzero(number < 0)
        full = self.known >= self.remembered
        if full and len(fresh) > STALE * len(keys):
            self._clear()
            fresh, full = np.arange(len(keys)), False
        known = self.known
        if len(fresh):
            new, at = np.unique(keys[fresh], return_index=True)
            at = fresh[at]
            raw = data.tobytes()
            # a full table forgets them after this call
            self._learn(new, [raw[a:b].decode("utf-8") for a, b in zip(starts[at].tolist(), ends[at].tolist())], not full)
            number[fresh] = known + np.searchsorted(new, keys[fresh])
        out = self._gather(given, offsets, whole, doc, number, n)
        if full:
            self.known = known
        return out

    @staticmethod
    def _keys(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A hash of each chunk: its bytes' values times powers of their places, summed; bytes between chunks count nothing.

        Chunks are taken in runs of some bytes, so the arrays of a long text stay small beside it.
        """
        keys = np.empty(len(starts), _U)
        at = 0
        while at < len(starts):
            after = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE, "right")) - 1) if starts[-1] > starts[at] + SLICE else len(starts)
            lo, hi = int(starts[at]), int(starts[after]) if after < len(starts) else len(data)
            own, size = starts[at:after] - lo, sizes[at:after]
            lone = np.diff(np.append(own, hi - lo))
            place = np.arange(hi - lo, dtype=np.int64) - np.repeat(own, lone)
            power = np.full(int(lone.max()), _BASE, _U)
            power[0] = 1
            value = _BYTE[data[lo:hi]] * np.multiply.accumulate(power)[place]
            if not (size == lone).all():
                value[place >= np.repeat(size, lone)] = 0
            keys[at:after] = mix(np.add.reduceat(value, own) + size.astype(_U) * _U(0xA24BAED4963EE407))
            at = after
        return keys

    def _gather(self, given, offsets, whole, doc, number, n):
        first = self.first[number]
        many = self.first[number + 1] - first
        if whole.any():
            return self._with_whole(given, offsets, whole, doc, first, many, n)
        before = np.cumsum(many) - many
        ids = self.ids[np.repeat(first - before, many) + np.arange(int(many.sum()))]
        return ids, np.append(0, np.cumsum(np.bincount(doc, many, minlength=n).astype(np.int64)))

    def _with_whole(self, data, offsets, whole, doc, first, many, n):
        raw = data.tobytes()
        left = np.flatnonzero(whole)
        apart = dict(zip(left.tolist(), self.encode_all([raw[offsets[i] : offsets[i + 1]].decode("utf-8") for i in left])))
        ends = np.searchsorted(doc, np.arange(n + 1))
        lists = []
        for i in range(n):
            if i in apart:
                lists.append(apart[i])
            else:
                own, size = first[ends[i] : ends[i + 1]], many[ends[i] : ends[i + 1]]
                before = np.cumsum(size) - size
                lists.append(self.ids[np.repeat(own - before, size) + np.arange(int(size.sum()))])
        return np.concatenate(lists).astype(np.uint32), np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)


@lru_cache(maxsize=2)
def library_table(path: str, words: bool) -> ChunkTable:
    """A worker's table for a tokenizer file, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives ids.

    ``words``: the tokenizer drops white space, so a text may be cut at every ASCII white space; else it is byte-level.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def library(chunks: list[str]) -> list[np.ndarray]:
        out = []
        for at in range(0, len(chunks), 10_000):
            out += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(chunks[at : at + 10_000], add_special_tokens=False)]
        return out

    model = tokenizer.model
    byte_letters = _byte_letters()
    marks: dict[str, list[int]] = {"": []}

    def encode_all(chunks: list[str]) -> list[np.ndarray]:
        # letters up to U+00FF (after a space, if byte-level; lower-case, if not), then marks: two pieces for the model
        out: list = [None] * len(chunks)
        left = []
        for i, chunk in enumerate(chunks):
            body = chunk.rstrip(_MARKS)
            word = body if words else body.removeprefix(" ")
            if word.isalpha() and (word.isascii() or max(word) < "\u0100") and (not words or word.islower()):
                tail = chunk[len(body) :]
                if tail not in marks:
                    marks[tail] = [t.id for t in model.tokenize(tail)]
                spelt = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(byte_letters)
                if len(body) > len(word):
                    spelt = byte_letters[32] + spelt
                out[i] = np.array([t.id for t in model.tokenize(spelt)] + marks[tail], np.uint32)
            else:
                left.append(i)
        for i, ids in zip(left, library([chunks[i] for i in left])):
            out[i] = ids
        return out

    return ChunkTable(cut_words if words else cut_spaces, encode_all, lower=words)


_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _byte_letters() -> dict[int, str]:
    """The characters by which byte-level vocabularies spell bytes: printable ones themselves, the others from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in keep]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(moved)}
