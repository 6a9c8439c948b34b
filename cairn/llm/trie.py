"""A trigram trie in Elias-Fano levels, held in one flat, memory-mapped buffer.

Levels: the contexts (ascending ids) with the pointers to where their successors begin;
the successors (bigrams) with the pointers to where theirs begin; and those (trigrams).
A node is kept as its parent's place times words plus its own word's place, which ascends
over the whole level, so one Elias-Fano sequence serves all parents, and a search stays
within the parent's stretch of it: words are found relative to their context.  Nodes have
16-bit codes of the logarithms of their smoothed shares, and bigrams also of the mass
that is held back for shorter contexts.

The buffer can be bytes or, as in ``mapped``, a file that is unlinked at once and paged
in as it is searched.
"""

from __future__ import annotations

import tempfile

import numpy as np

U64 = np.uint64


def _in_word(word: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the ``nth`` set bit of each word."""
    word, nth, at = word.copy(), nth.astype(np.int64), np.zeros(len(word), dtype=np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(word & U64((1 << width) - 1)).astype(np.int64)
        over = nth >= below
        nth -= below * over
        at += width * over
        word >>= (width * over).astype(np.uint64)
    return at


class EliasFano:
    """Ascending whole numbers: low bits packed, high bits as steps in a bit row."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        head, self.low, self.high, self.ones = parts
        self.n, self.bits = int(head[0]), int(head[1])
        self.window = np.ndarray((max(len(self.low) - 7, 0),), dtype="<u8", buffer=self.low, strides=(1,))

    @staticmethod
    def parts(values: np.ndarray, universe: int) -> list[np.ndarray]:
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        low = np.zeros(-(-n * bits // 8) + 8, dtype=np.uint8)
        if bits and n:
            flat = np.unpackbits((values & U64((1 << bits) - 1)).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little", count=bits)
            packed = np.packbits(flat.ravel(), bitorder="little")
            low[: len(packed)] = packed
        steps = (values >> U64(bits)).astype(np.int64) + np.arange(n)
        words = int((universe >> bits) + n) // 64 + 1
        high = np.zeros(words * 64, dtype=bool)
        high[steps] = True
        row = np.packbits(high, bitorder="little").view("<u8")
        ones = np.concatenate(([0], np.cumsum(np.bitwise_count(row), dtype=np.uint32)[:-1])).astype(np.uint32)
        return [np.array([n, bits], dtype=np.int64), low, row, ones]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), dtype=np.uint64)
        at = i * self.bits
        return (self.window[at >> 3] >> (at & 7).astype(np.uint64)) & U64((1 << self.bits) - 1)

    def _first(self, high: np.ndarray) -> np.ndarray:
        """Elements whose high part is smaller than ``high``."""
        zeros = np.arange(len(self.high)) * 64 - self.ones.astype(np.int64)
        want = np.maximum(high - 1, 0)
        word = np.searchsorted(zeros, want, side="right") - 1
        place = word * 64 + _in_word(~self.high[word], want - zeros[word])
        return np.where(high > 0, place - want, 0)

    def get(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i, side="right") - 1
        step = word * 64 + _in_word(self.high[word], i - self.ones[word].astype(np.int64))
        return ((step - i).astype(np.uint64) << U64(self.bits)) | self._low(i)

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value, between ``begin`` and ``end`` if given; -1 if it is not there."""
        out = np.full(len(values), -1, dtype=np.int64)
        if not self.n or not len(values):
            return out
        high, want = (values >> U64(self.bits)).astype(np.int64), values & U64((1 << self.bits) - 1)
        at, stop = self._first(high), self._first(high + 1)
        if begin is not None:
            at, stop = np.maximum(at, begin), np.minimum(stop, end)
        # one high part can hold many elements (the successors of a frequent context): halve the stretch
        last = stop
        stop = stop.copy()
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            middle = (at[open_] + stop[open_]) >> 1
            less = self._low(middle) < want[open_]
            at[open_[less]] = middle[less] + 1
            stop[open_[~less]] = middle[~less]
            open_ = open_[at[open_] < stop[open_]]
        inside = np.flatnonzero(at < last)
        inside = inside[self._low(at[inside]) == want[inside]]
        out[inside] = at[inside]
        return out


def _flat(parts: list[np.ndarray]) -> bytes:
    head = ";".join(f"{p.dtype.str},{len(p)}" for p in parts).encode()
    body = b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)
    return len(head).to_bytes(8, "little") + head + b"\0" * (-len(head) % 8) + body


#: Codes for a power of ten.
STEPS = 2048


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of numbers over 0 and up to 1; 0 stands for 0."""
    out = np.zeros(len(values), dtype=np.uint16)
    some = values > 0
    out[some] = np.minimum(np.round(-np.log10(values[some]) * STEPS), 65534).astype(np.uint16) + 1
    return out


def decode(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((1.0 - codes.astype(np.float64)) / STEPS), 0.0)


def _begins(parent: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(parent, minlength=n)))).astype(np.int64)


class Trie:
    """Reads a buffer that ``build`` made."""

    def __init__(self, buffer) -> None:
        data = np.frombuffer(buffer, dtype=np.uint8)
        n = int.from_bytes(data[:8].tobytes(), "little")
        at, parts = 8 + n + -n % 8, []
        for field in data[8 : 8 + n].tobytes().decode().split(";"):
            kind, count = field.split(",")
            size = np.dtype(kind).itemsize * int(count)
            parts.append(data[at : at + size].view(kind))
            at += size + -size % 8
        self.contexts, self.words, self.first, self.pairs, self.second, self.triples = (EliasFano(parts[k : k + 4]) for k in range(0, 24, 4))
        #: codes of bigrams' shares, of the mass they hold back, and of trigrams' shares
        self.share, self.held, self.share3 = parts[24:27]

    @classmethod
    def mapped(cls, buffer: bytes) -> Trie:
        """The trie in a file of the task's own that is mapped and, being unlinked, goes with it."""
        with tempfile.TemporaryFile() as file:
            file.write(buffer)
            file.flush()
            return cls(np.memmap(file, dtype=np.uint8, mode="r"))

    @staticmethod
    def build(words: np.ndarray, context: np.ndarray, word: np.ndarray, share: np.ndarray, held: np.ndarray, parent: np.ndarray, third: np.ndarray, share3: np.ndarray) -> bytes:
        """From ascending word ids; distinct bigrams as places of words, in their order; distinct trigrams as places of bigrams and words, in their order; shares and held masses as codes."""
        contexts, c = np.unique(context, return_inverse=True)
        size, n, m = max(len(words), 1), len(context), len(parent)
        universe = int(words[-1]) + 1 if len(words) else 1
        return _flat(
            [
                *EliasFano.parts(words[contexts], universe),
                *EliasFano.parts(words, universe),
                *EliasFano.parts(_begins(c, len(contexts)), n + 1),
                *EliasFano.parts(c.astype(np.int64) * size + word, max(len(contexts) * size, 1)),
                *EliasFano.parts(_begins(parent, n), m + 1),
                *EliasFano.parts(parent.astype(np.int64) * size + third, max(n * size, 1)),
                share.astype(np.uint16),
                held.astype(np.uint16),
                share3.astype(np.uint16),
            ]
        )

    def _under(self, level: EliasFano, pointers: EliasFano, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        out = np.full(len(parent), -1, dtype=np.int64)
        own = np.flatnonzero((parent >= 0) & (word >= 0))
        if len(own):
            begin, end = pointers.get(parent[own]).astype(np.int64), pointers.get(parent[own] + 1).astype(np.int64)
            out[own] = level.find((parent[own] * self.words.n + word[own]).astype(np.uint64), begin, end)
        return out

    def bigrams(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of bigrams of word ids; -1 for those that were not seen."""
        return self._under(self.pairs, self.first, self.contexts.find(context), self.words.find(word))

    def trigrams(self, bigram: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places of the bigrams' successors; -1 for those that were not seen."""
        return self._under(self.triples, self.second, bigram, self.words.find(word))
