"""Token counts by a finite-state transducer compiled from a piece model, run over chunks of all texts side by side.

The greedy merges of a piece model have two properties: the tokens before a token's end are those of the prefix that ends
there, and a row of tokens is the result for its text exactly if each two neighbours are that of theirs. So the last token
of every prefix follows from last tokens further left, no further than the longest piece, and a deterministic machine can
read a text once: its state holds the longest suffix that a piece can still extend and the last tokens at the places where
such pieces would begin. A transition's annotation is by how much the number of tokens of the prefix changes; their sum
over a text is its token count. Two neighbouring characters that stand together in no piece reset the machine, so states
are few. They are compiled on first use and kept by the worker.

A batch of texts is one row of symbols, cut into chunks of equal length that advance together, a symbol a step. A chunk
starts from the state that reading the few symbols before it suggests. Its state map (start state to end state) then
grows by every end state of the chunk before it, until all maps fit each other, and maps compose by a parallel prefix
scan (pointer doubling), which gives each chunk its true start. Nothing is assumed of a text: a wrong guess costs a run.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices
from .hashed import buffers

#: Symbols of a chunk, symbols read before it to guess its start state, and bytes of text that go through at once.
CHUNK, WARM, AT_ONCE = 512, 32, 4 << 20
#: Transitions of a worker's machine at most; beyond that it is compiled anew.
TRANSITIONS = 4_000_000

_U = np.uint64
_NONE = _U(2**64 - 1)
SPACE = "▁"


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a serialised message: the model file's format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + size]
            at += size


def read_model(path: str) -> dict[str, float]:
    """Scores of the ordinary pieces of a greedy-merge (BPE) piece model with byte fallback, identity normalisation and a space put before each text."""
    pieces, kinds, trainer, rules = {}, [], {}, {}
    with open(path, "rb") as f:
        for number, value in _fields(f.read()):
            if number == 1:
                piece = dict(_fields(value))
                kind = piece.get(3, 1)
                kinds.append(kind)
                if kind == 1:
                    pieces[piece[1].decode("utf-8")] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
    # field numbers of the format: model type 3, byte fallback 35; character map 2, space before 3, spaces removed 4, spaces escaped 5; piece kinds 4 (user-defined) and 5 (unused) and 6 (byte)
    fits = trainer.get(3) == 2 and trainer.get(35) == 1 and not rules.get(2) and rules.get(3, 1) == 1 and rules.get(4, 1) == 0 and rules.get(5, 1) == 1
    if not fits or kinds.count(6) != 256 or 4 in kinds or 5 in kinds:
        raise ValueError(f"{path}: not a merge model with byte fallback, identity normalisation, a space before and no user-defined pieces")
    return pieces


def merged(text: str, pieces: dict[str, float]) -> list[str]:
    """A short text's tokens: the neighbours of the best joint piece merge, leftmost first, until no two make a piece."""
    parts = list(text)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            score = pieces.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """The machine over symbols: 0 between texts, 1-4 unknown characters by their bytes, then the characters of pieces."""

    def __init__(self, pieces: dict[str, float], transitions: int = TRANSITIONS):
        self.pieces, self.limit = pieces, transitions
        self.chars = sorted({c for p in pieces for c in p})
        if len(self.chars) > 60_000:
            raise ValueError("too many characters for 16-bit symbols")
        self.symbol = np.full(0x110000, 4, np.uint16)
        self.symbol[:0x10000], self.symbol[:0x800], self.symbol[:0x80] = 3, 2, 1
        self.symbol[[ord(c) for c in self.chars]] = np.arange(5, 5 + len(self.chars))
        self.symbol[0x20] = self.symbol[ord(SPACE)]
        self.space = int(self.symbol[0x20])
        self.open = {p[:n] for p in pieces for n in range(1, len(p))} | {""}  # what a piece can still extend
        self.together = {a + b for p in pieces for a, b in zip(p, p[1:])}
        self.whole = {p for p in pieces if len(p) == 1 or merged(p, pieces) == [p]}
        self.fits: dict[tuple[str, str], bool] = {}
        self.depths: dict[str, tuple[int, ...]] = {}
        self._clear()

    def _clear(self) -> None:
        # state 0: nothing can reach back; a state is (suffix, last token and its count against now, at each depth of the suffix)
        start = ("", (("", 0),))
        self.number, self.states = {start: 0}, [start]
        self.bits, self.known = 16, 0
        self.slots, self.value = np.full(1 << 16, _NONE, _U), np.zeros(1 << 16, np.int64)

    def _depths(self, suffix: str) -> tuple[int, ...]:
        out = self.depths.get(suffix)
        if out is None:
            out = self.depths[suffix] = tuple(d for d in range(len(suffix), -1, -1) if suffix[len(suffix) - d :] in self.open)
        return out

    def _fit(self, left: str, right: str) -> bool:
        """May ``right`` follow ``left``: do their characters, merged, give these two again?"""
        out = self.fits.get((left, right))
        if out is None:
            out = self.fits[left, right] = merged(left + right, self.pieces) == [left, right]
        return out

    def _compile(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the number of tokens) of one transition."""
        if symbol < 5:
            return 0, symbol
        c = self.chars[symbol - 5]
        suffix, marks = self.states[state]
        last = marks[-1][0]
        if last and last[-1] + c not in self.together:
            suffix, marks = self.states[0]
        before = dict(zip(self._depths(suffix), marks))
        for depth in sorted(before, reverse=True):
            token = suffix[len(suffix) - depth :] + c
            left, count = before[depth]
            if (token in self.whole or depth == 0) and (not left or self._fit(left, token)):
                break
        more = count + (1 if token in self.pieces else len(c.encode("utf-8")))
        text = suffix + c
        text = next(text[at:] for at in range(len(text) + 1) if text[at:] in self.open)
        state = (text, tuple((before[d - 1][0], before[d - 1][1] - more) if d else (token, 0) for d in self._depths(text)))
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
        return self.number[state], more

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.known += len(keys)
        if 4 * self.known > len(self.slots):
            used = self.slots != _NONE
            keys, values = np.concatenate([self.slots[used], keys]), np.concatenate([self.value[used], values])
            self.bits = (8 * self.known).bit_length()
            self.slots, self.value = np.full(1 << self.bits, _NONE, _U), np.zeros(1 << self.bits, np.int64)
        at = self._place(keys)
        while len(keys):
            free = self.slots[at] == _NONE
            self.slots[at[free]] = keys[free]
            won = self.slots[at] == keys
            self.value[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], at[~won] + 1 & len(self.slots) - 1

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Each transition's value (next state * 256 + change + 128), -1 where it isn't compiled."""
        at = self._place(keys)
        there = self.slots[at]
        out = self.value[at]
        todo = np.flatnonzero(there != keys)
        out[todo] = -1
        at, there = at[todo], there[todo]
        while len(todo):
            on = there != _NONE
            todo, at = todo[on], at[on] + 1 & len(self.slots) - 1
            there = self.slots[at]
            hit = there == keys[todo]
            out[todo[hit]] = self.value[at[hit]]
            todo, at, there = todo[~hit], at[~hit], there[~hit]
        return out

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, changes) of all lanes; transitions never met are compiled."""
        keys = states.astype(_U) << _U(16) | symbols
        value = self._find(keys)
        if (value < 0).any():
            fresh = np.unique(keys[value < 0])
            made = [self._compile(int(k) >> 16, int(k) & 0xFFFF) for k in fresh]
            self._insert(fresh, np.array([s << 8 | d + 128 for s, d in made], np.int64))
            value = self._find(keys)
        return value >> 8, (value & 255) - 128

    def run(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end states, changes) of lanes over symbols[step, lane]."""
        change = np.empty(symbols.shape, np.int8)
        for i in range(len(symbols)):
            states, change[i] = self.step(states, symbols[i])
        return states, change

    def changes(self, symbols: np.ndarray, chunk: int = CHUNK, warm: int = WARM) -> np.ndarray:
        """The annotation of each symbol's transition, read from state 0 on."""
        if self.known > self.limit:
            self._clear()
        n = -(-len(symbols) // chunk)
        lanes = np.zeros(n * chunk, np.uint16)
        lanes[: len(symbols)] = symbols
        lanes = lanes.reshape(n, chunk)
        ahead = np.zeros((n, warm), np.uint16)
        ahead[1:] = lanes[:-1, -warm:]
        lanes = np.ascontiguousarray(lanes.T)
        start, _ = self.run(np.zeros(n, np.int64), np.ascontiguousarray(ahead.T))
        start[0] = 0
        end, change = self.run(start, lanes)
        of = np.arange(n)
        if not (end[:-1] == start[1:]).all():
            # state maps as rows (chunk, start, end); a map grows by the ends of the map before it that it doesn't know
            fresh = np.flatnonzero(of < n - 1)
            known = set(zip(of.tolist(), start.tolist()))
            while True:
                asked = sorted({x for x in zip((of[fresh] + 1).tolist(), end[fresh].tolist()) if x[0] < n} - known)
                if not asked:
                    break
                known |= set(asked)
                more_of, more_start = (np.array(x, np.int64) for x in zip(*asked))
                more_end, more_change = self.run(more_start, np.ascontiguousarray(lanes[:, more_of]))
                fresh = np.arange(len(of), len(of) + len(asked))
                of, start, end = np.append(of, more_of), np.append(start, more_start), np.append(end, more_end)
                change = np.concatenate([change, more_change], axis=1)
            change = change[:, scanned(of, start, end, n)]
        return change.T.reshape(-1)[: len(symbols)]

    def counts(self, text: pa.Array) -> np.ndarray:
        """Tokens of each text; null and empty have none."""
        data, offsets = buffers(text)
        codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        leads = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=leads[1:])
        begin = leads[offsets]  # in characters
        some = np.flatnonzero(np.diff(begin))
        out = np.zeros(len(offsets) - 1, np.int64)
        if len(some):
            # each text that isn't empty: the symbol between texts, a space, its characters
            symbols = np.insert(self.symbol[codes], np.repeat(begin[some], 2), np.tile(np.array([0, self.space], np.uint16), len(some)))
            at = begin[some] + 2 * np.arange(len(some))
            out[some] = np.add.reduceat(self.changes(symbols).astype(np.int64), at)
        return out


def scanned(of: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Which row of the state maps (chunk, start, end) each of n chunks takes, from the first row on, by doubling steps."""
    by = np.lexsort((start, of))
    key = of[by] << 40 | start[by]
    following = by[np.minimum(np.searchsorted(key, (of + 1) << 40 | end), len(by) - 1)]
    path = np.zeros(1, np.int64)
    while len(path) < n:
        path = np.append(path, following[path])
        following = following[following]
    return path[:n]


@lru_cache(maxsize=2)
def machine(path: str) -> Transducer:
    """A worker's machine of a model file."""
    return Transducer(read_model(path))


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): UTF-8 bytes and tokens of every whole text, and whether it has more than ``limit``.

    ``model`` is a piece model's file, found at the same path by every worker, whose text is taken as the library takes it
    by default: a space goes before, nothing is normalised, no begin or end token, strings of special tokens are ordinary
    text and characters outside the pieces count by their bytes. Null and empty texts have 0 of both. Each row gives one
    row, repeated ones and null ids too; long texts are cut into chunks like all others; an empty table gives none.
    Other columns are ignored, whatever their names. Nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine(model)
        for batch in slices(batches, "text", AT_ONCE):
            text = batch.column("text")
            n_bytes = np.diff(buffers(text)[1])
            n = own.counts(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return in_batches(rows, run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
