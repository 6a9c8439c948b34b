"""Segments of texts for a sentencepiece BPE model, with a cache of what each segment gives.

The model joins neighbouring characters only if some piece of its vocabulary holds both side
by side, so a text can be cut between any two characters that no piece holds so: no merge
crosses such a cut, and what the segments give is what the whole text gives.  A block of
texts is cut at once, by a table of character classes; its distinct segments are looked up
among those kept by the worker, byte for byte; only new ones are worked on.

The model adds a space in front of a text that is not empty, and reads U+2581 as a space.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .tokens import BLOCK, JOINED, Encoder

SPACE = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=1)
def piece_ids(path: str) -> PieceIds:
    """The process's encoder for ``path``; its cache serves all tasks of a worker."""
    return PieceIds(path)


@functools.lru_cache(maxsize=1)
def prefix_counts(path: str) -> PrefixCounts:
    return PrefixCounts(path)


def spaced(column: pa.Array) -> pa.Array:
    """The texts with a space in front; null and empty ones are empty."""
    texts = pc.fill_null(column.cast(pa.binary()), b"")
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar(b"", pa.binary()), pc.binary_join_element_wise(pa.scalar(b" ", pa.binary()), texts, pa.scalar(b"", pa.binary())))


def flat(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """All bytes of a binary column, and the bounds of its values in them."""
    if not len(column):
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    return data[offsets[0] : offsets[-1]].to_pybytes() if data else b"", offsets.astype(np.int64) - offsets[0]


class Segments(Encoder):
    """What segments give, in a row: ``_new`` says what new ones give, and how much each."""

    def __init__(self, path: str, dtype: type) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.vocabulary = self.model.get_piece_size()
        own = [k for k in range(self.vocabulary) if not (self.model.is_byte(k) or self.model.is_control(k) or self.model.is_unknown(k))]
        #: score of every piece that merges can make
        self.scores = {self.model.id_to_piece(k): self.model.get_score(k) for k in own}
        held = sorted({c for p in self.scores if len(p) > 1 for c in p})
        self.width = len(held) + 1
        classes = {c: k for k, c in enumerate(held, 1)}
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in held]] = np.arange(1, self.width)
        self.classes[0x20] = self.classes[ord(SPACE)]
        self.cut = np.ones(self.width * self.width, bool)
        for p in self.scores:
            for a, b in zip(p, p[1:], strict=False):
                self.cut[classes[a] * self.width + classes[b]] = False
        self.pieces = pa.array([], pa.binary())
        self.ends, self.ids, self.uses = np.zeros(0, np.int64), np.zeros(0, dtype), np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """What all texts of a column give (see ``spaced``), and the texts' bounds in it."""
        raw, docs = flat(column)
        if not raw:
            return self.ids[:0], np.zeros(len(docs), np.int64)
        data = np.frombuffer(raw, np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        of = self.classes[np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)]
        mark = np.zeros(len(raw) + 1, bool)
        mark[first[1:]] = self.cut[of[:-1] * self.width + of[1:]]
        mark[docs] = True
        offsets = np.flatnonzero(mark).astype(np.int32)
        parts, counts = [], np.empty(len(offsets) - 1, np.int64)
        for at in range(0, len(counts), BLOCK):  # more than one block only for very long texts
            part = offsets[at : at + BLOCK + 1]
            segments = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer(part), pa.py_buffer(raw)])
            out, counts[at : at + BLOCK] = self._block(segments, False)
            parts.append(out)
        ends = np.concatenate(([0], np.cumsum(counts)))
        return np.concatenate(parts), ends[np.searchsorted(offsets, docs)]


class PieceIds(Segments):
    """The ids of the library for the texts, and ``spelling``, the bytes of each id."""

    def __init__(self, path: str) -> None:
        super().__init__(path, np.uint32)
        self.spelling = [self._bytes(k) for k in range(self.vocabulary)]
        # a character that is cut off on both sides and has one id parts new segments from each other
        single = (c for c in map(chr, (10, *range(128))) if not self.classes[ord(c)] and len(self.model.encode("a" + c)) == 2)
        self.apart = next(single)
        self.apart_id = self.model.encode("a" + self.apart)[1]

    def _bytes(self, k: int) -> bytes:
        piece = self.model.id_to_piece(k)
        if self.model.is_byte(k):
            return bytes([int(piece[1:-1], 16)])
        return b"" if self.model.is_control(k) or self.model.is_unknown(k) else piece.replace(SPACE, " ").encode()

    def _new(self, pieces: list[bytes], odd: bool) -> tuple[np.ndarray, np.ndarray]:
        parts, counts, at = [], [], 0
        while at < len(pieces):
            size, upto = 0, at
            while upto < len(pieces) and (upto == at or size < JOINED):
                size += len(pieces[upto])
                upto += 1
            own = [p.decode() for p in pieces[at:upto]]
            alone = [k for k, p in enumerate(own) if p == self.apart]
            ids = np.array(self.model.encode(self.apart + self.apart.join("" if p == self.apart else p for p in own) + self.apart), np.uint32)
            marks = np.flatnonzero(ids == self.apart_id)
            n = np.diff(marks) - 1
            inner = np.ones(len(ids), bool)
            inner[: marks[0]] = inner[marks] = False
            n[alone] = 1
            inner[marks[alone]] = True
            parts.append(ids[inner])
            counts.append(n)
            at = upto
        return np.concatenate(parts), np.concatenate(counts)


class PrefixCounts(Segments):
    """By how much the token count changes with each character, by dynamic programming over every prefix.

    The tokens of a prefix are those of a shorter prefix and one more, its last token: the one
    whose neighbour before it, the last token of the shorter prefix, is left apart from it when
    both are encoded together.  So a prefix has the count of that shorter one and one more,
    or the bytes of a character that has no piece.  Segments do not touch each other, so their
    steps in a row are those of the text.
    """

    #: Pairs whose neighbourhood is kept.
    PAIRS = 1 << 20

    def __init__(self, path: str) -> None:
        super().__init__(path, np.int16)
        self.longest = max(map(len, self.scores))
        self.apart: dict[tuple[str, str], bool] = {}

    def _merged(self, text: str) -> list[str]:
        """The best pair is joined, the first of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _apart(self, before: str, token: str) -> bool:
        known = self.apart.get((before, token))
        if known is None:
            if len(self.apart) >= self.PAIRS:
                self.apart.clear()
            known = self.apart[before, token] = self._merged(before + token) == ([before, token] if before else [token])
        return known

    def counts(self, text: str) -> list[int]:
        text = text.replace(" ", SPACE)
        last, count = [""] * (len(text) + 1), [0] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            for begin in range(max(0, end - self.longest), end):
                token = text[begin:end]
                if (begin == end - 1 or token in self.scores) and self._apart(last[begin], token):
                    last[end] = token
                    count[end] = count[begin] + (1 if token in self.scores else len(token.encode()))
                    break
        return count[1:]

    def _new(self, pieces: list[bytes], odd: bool) -> tuple[np.ndarray, np.ndarray]:
        steps = [np.diff(self.counts(p.decode()), prepend=0).astype(np.int16) for p in pieces]
        return np.concatenate(steps), np.array([len(x) for x in steps], np.int64)
