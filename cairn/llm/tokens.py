"""Token ids of whole texts, by the tokenizers library with a cache of word pieces.

A byte-level tokenizer that splits text before it merges never joins what stands on both
sides of some steps: from another character to a space, from a letter or digit to any
other ASCII character, and from ASCII marks to letters or digits (a letter after an
apostrophe excepted).  A block of texts is cut at all these steps at once, by tables of
byte classes; its distinct pieces are looked up among those kept by the worker, byte for
byte; only new ones are encoded; and the ids of all pieces are gathered by offsets.  A
text with white space that is not ASCII, or with the content of an added token (such as
``<|endoftext|>``), is one piece of its own.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = b" \t\n\x0b\x0c\r"
#: White space that is not plain ASCII, by code points (fixed values).
_OTHER_SPACES = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)
OTHER_SPACE = re.compile("[" + "".join(map(chr, _OTHER_SPACES)) + "]")
#: Pieces kept, and the bytes of the longest one kept: bounds of the cache of a worker process.
KEPT, LONGEST = 250_000, 40
#: Bytes of new pieces that are encoded as one text, and pieces that are looked up at once.
JOINED, BLOCK = 1 << 16, 1 << 20

_SPACE, _LETTER, _DIGIT, _QUOTE, _MARK, _OTHER = range(6)


def _classes() -> bytes:
    of = np.full(256, _MARK, dtype=np.uint8)
    of[list(_SPACES)] = _SPACE
    of[65:91] = of[97:123] = _LETTER
    of[48:58] = _DIGIT
    of[39] = _QUOTE
    of[128:] = _OTHER
    return of.tobytes()


def _steps() -> bytes:
    """By class and following class (three bits each): 1 where a text is cut."""
    cut = np.zeros((32, 8), dtype=np.uint8)
    cut[[_LETTER, _DIGIT, _QUOTE, _MARK, _OTHER], _SPACE] = 1
    cut[_LETTER, [_DIGIT, _QUOTE, _MARK]] = 1
    cut[_DIGIT, [_LETTER, _QUOTE, _MARK]] = 1
    cut[_MARK, [_LETTER, _DIGIT]] = 1
    cut[_QUOTE, _DIGIT] = 1
    return cut.tobytes()


_CLASSES, _STEPS = _classes(), _steps()
#: First bytes of two-byte characters that are letters, but for the multiplication and division signs: U+00C0 to U+024F and U+0400 to U+047F.
_TWO = bytes(b in (*range(0xC3, 0xCA), 0xD0, 0xD1) for b in range(256))
#: First bytes of white space that is not ASCII, and the four separators that are.
_ODD = bytes(b in (0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF) for b in range(256))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def encoder(path: str, special: bool = False) -> Encoder:
    """The process's encoder for ``path``; its cache serves all tasks of a worker."""
    return Encoder(path, special)


def _marked(raw: bytes, table: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(raw.translate(table), dtype=np.uint8))


def other_spaces(raw: bytes) -> np.ndarray:
    """Places of white space that is not plain ASCII."""
    at = _marked(raw, _ODD)
    if not len(at):
        return at
    data = np.frombuffer(raw + b"\0\0", dtype=np.uint8)
    a, b, c = data[at], data[at + 1], data[at + 2]
    found = a < 0x20
    found |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    found |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
    found |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8B) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    found |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    found |= (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    return at[found]


def cuts(raw: bytes) -> np.ndarray:
    """1 at each byte before which a text can be cut; one element more than bytes."""
    data = np.frombuffer(raw, dtype=np.uint8)
    of = np.frombuffer(bytearray(raw.translate(_CLASSES)), dtype=np.uint8)
    two = _marked(raw, _TWO)
    two = two[~((data[two] == 0xC3) & ((data[two + 1] == 0x97) | (data[two + 1] == 0xB7)))]
    of[two] = of[two + 1] = _LETTER
    out = np.zeros(len(raw) + 1, dtype=np.uint8)
    out[1:-1] = np.frombuffer(((of[:-1] << 3) | of[1:]).tobytes().translate(_STEPS), dtype=np.uint8)
    return out


class Encoder:
    """Encodes texts to ``uint32`` ids; ``path`` names a file of the tokenizers library.

    With ``special`` the content of a special token gets its id, as by the library's plain
    call; without, it is ordinary text.
    """

    def __init__(self, path: str, special: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if special or not t.special]
        self.added = re.compile(b"|".join(re.escape(t.encode()) for t in added)) if added else None
        #: pieces side by side could make up an added token that holds white space
        self.joins = not any(re.search(r"\s", t) for t in added)
        self.vocabulary = self.tokenizer.get_vocab_size()
        # a byte-level token has one character for each byte it stands for
        self.sizes = np.zeros(self.vocabulary, dtype=np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.sizes[k] = len(token)
        #: pieces, the ends of their ids in ``ids``, and the number of blocks that used each
        self.pieces = pa.array([], pa.binary())
        self.ends, self.ids, self.uses = np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _new(self, pieces: list[bytes], odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has.  Those that begin with a space and end without stay apart in one joined text."""
        apart = np.array([self.joins and p[0] in _SPACES and p[-1] not in _SPACES and not (odd and self._odd(p)) for p in pieces], dtype=bool)
        counts, parts = np.zeros(len(pieces), np.int64), []
        own = np.flatnonzero(apart)
        sizes = np.cumsum([len(pieces[i]) for i in own])
        at = 0
        while at < len(own):
            upto = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + JOINED)) + 1
            ids = self._whole([b"".join([pieces[i] for i in own[at:upto]])])[0]
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), sizes[at:upto] - (sizes[at - 1] if at else 0)) + 1
            counts[own[at:upto]] = np.diff(ends, prepend=0)
            parts.append(ids)
            at = upto
        joined, rest = np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.flatnonzero(~apart)
        single = self._whole([pieces[i] for i in rest])
        counts[rest] = [len(x) for x in single]
        out, to = np.empty(int(counts.sum()), np.uint32), np.repeat(apart, counts)
        out[to] = joined
        out[~to] = np.concatenate(single) if single else joined[:0]
        return out, counts

    def _odd(self, text: bytes) -> bool:
        return bool(OTHER_SPACE.search(text.decode()) or (self.added and self.added.search(text)))

    def _keep(self, used: np.ndarray) -> None:
        """Lets go of long pieces and, beyond the bound, of those that one block used, then of all that this one did not."""
        self.uses[used] += 1
        good = pc.binary_length(self.pieces).to_numpy(zero_copy_only=False) <= LONGEST
        if good.sum() > KEPT:
            now = np.zeros(len(good), dtype=bool)
            now[used] = True
            good &= now | (self.uses > 1)
            if good.sum() > KEPT:
                good &= now
        if not good.all():
            n = np.diff(self.ends, prepend=0)
            self.ids, self.ends, self.uses = self.ids[np.repeat(good, n)], np.cumsum(n[good]), self.uses[good]
            self.pieces = self.pieces.filter(pa.array(good))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none) of a column, and the texts' bounds in them."""
        texts = pc.fill_null(column.cast(pa.binary()), b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset)
        raw, docs = texts.buffers()[2][offsets[0] : offsets[-1]].to_pybytes() if len(texts) else b"", offsets - offsets[0]
        if not raw:
            return np.zeros(0, np.uint32), np.zeros(len(docs), np.int64)
        cut = cuts(raw)
        odd = other_spaces(raw)
        if self.added and self.added.search(raw):
            odd = np.concatenate((odd, [m.start() for m in self.added.finditer(raw)]))
        for d in np.unique(np.searchsorted(docs, odd, side="right") - 1):
            cut[docs[d] : docs[d + 1]] = 0
        cut[docs] = 1
        offsets = np.flatnonzero(cut).astype(np.int32)
        parts, counts = [], np.empty(len(offsets) - 1, np.int64)
        for at in range(0, len(counts), BLOCK):  # more than one block only for very long texts
            part = offsets[at : at + BLOCK + 1]
            column = pa.Array.from_buffers(pa.binary(), len(part) - 1, [None, pa.py_buffer(part), pa.py_buffer(raw)])
            ids, counts[at : at + BLOCK] = self._block(column, bool(len(odd)))
            parts.append(ids)
        ends = np.concatenate(([0], np.cumsum(counts)))
        return np.concatenate(parts), ends[np.searchsorted(offsets, docs)]

    def _block(self, column: pa.Array, odd: bool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces in a row, and how many each has."""
        pieces = column.dictionary_encode()
        known = pc.index_in(pieces.dictionary, value_set=self.pieces)
        fresh = known.is_null()
        place = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        new = pieces.dictionary.filter(fresh)
        if len(new):
            ids, counts = self._new(new.to_pylist(), odd)
            place[fresh.to_numpy(zero_copy_only=False)] = len(self.pieces) + np.arange(len(new))
            self.ends = np.concatenate((self.ends, len(self.ids) + np.cumsum(counts)))
            self.ids = np.concatenate((self.ids, ids))
            self.uses = np.concatenate((self.uses, np.zeros(len(new), np.int32)))
            self.pieces = pa.concat_arrays([self.pieces, new])
        of = place[pieces.indices.to_numpy(zero_copy_only=False)]
        counts = np.diff(self.ends, prepend=0)[of]
        take = np.repeat(self.ends[of] - np.cumsum(counts), counts)
        take += np.arange(len(take))
        out = self.ids[take]
        self._keep(place)
        return out, counts

    def encode_ended(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` with ``end_id`` after each text."""
        ids, bounds = self.encode(column)
        bounds = bounds + np.arange(len(bounds))
        out, own = np.full(bounds[-1], end_id, dtype=np.uint32), np.ones(bounds[-1], dtype=bool)
        own[bounds[1:] - 1] = False
        out[own] = ids
        return out, bounds

    def encode_all(self, texts: list[bytes | None]) -> list[np.ndarray]:
        ids, bounds = self.encode(pa.array(texts, pa.binary()))
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
