"""Alignment of two tokenizers over a corpus, with an identity map for what both have alike.

Byte offsets at which tokens of both end cut their tokens into groups; an A token and a B
token are linked where their bytes overlap.  ``same_ids`` maps an A id to the B id of the
same bytes.  Links of such ids, above all groups of one token each, are counted in vectors
as long as the vocabulary; only the pairs of irregular groups are shuffled, and once a
chunk of texts, not once a document.

``align`` writes a row a chunk: its documents' figures and their distinct links with times.
``pair_counts`` has the corpus-wide count of each linked pair of ids, ``document_links``
what the documents' own links hold of these counts.

Defined cases: texts that are null, empty or not spelt back by both tokenizers (such as
those with U+2581) have no tokens, zeros, and an empty digest.  Equal rows, repeated and
null ids are rows of their own; ties for the best A id all count as best; an empty table
gives no rows; a text longer than a chunk is a chunk of its own; columns but id and text
take no part, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from . import tokens as tokens_a
from .pieces import default_path, flat, piece_ids, spaced

#: Bytes of text whose links are one chunk, and bytes that are aligned at once.
CHUNK, SLICE = 16 << 20, 1 << 20
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
ALIGNED = "_chunk long, figures binary, same binary, pairs binary"


class Spelling:
    """Byte strings by number, written out for arrays of numbers."""

    def __init__(self, strings: list[bytes]) -> None:
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.raw = np.frombuffer(b"".join(strings), np.uint8)

    def write(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes in a row, and where each string ends in them."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        take = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        take += np.arange(len(take))
        return self.raw[take], ends


def byte_level(token: str) -> bytes:
    """The bytes of a byte-level token: printable bytes stand for themselves, the others for the code points from 256 on."""
    return bytes(_byte_values()[c] for c in token)


@functools.cache
def _byte_values() -> dict[str, int]:
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = tokens_a.encoder(path_a), piece_ids(path_b)
        # an added token is no byte-level string; it is never made of plain text
        added = set(self.a.tokenizer.get_added_tokens_decoder())
        spelt = [b""] * self.a.vocabulary
        for token, k in self.a.tokenizer.get_vocab().items():
            spelt[k] = b"" if k in added else byte_level(token)
        self.spell_a, self.spell_b = Spelling(spelt), Spelling(self.b.spelling)
        self.same = same_ids(spelt, self.b.spelling)
        marks = [str(k).encode() + end for k in range(len(spelt)) for end in (b",", b"|")]
        self.marked_b = len(marks)
        self.marks = Spelling(marks + [str(k).encode() + end for k in range(self.b.vocabulary) for end in (b",", b";")])

    def _spelt(self, ids: np.ndarray, bounds: np.ndarray, spell: Spelling, raw: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Which documents' ids spell them."""
        out, ends = spell.write(ids)
        if len(out) == len(raw) and (out == raw).all():
            at = np.concatenate(([0], ends))[bounds]
            if (at == docs).all():
                return np.ones(len(docs) - 1, bool)
        at = np.concatenate(([0], ends))[bounds].tolist()
        places = zip(at[:-1], at[1:], docs[:-1].tolist(), docs[1:].tolist(), strict=True)
        return np.array([b - a == d - c and bool((out[a:b] == raw[c:d]).all()) for a, b, c, d in places], bool)

    def align(self, column: pa.Array) -> tuple[np.ndarray, list[bytes], tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Figures and digests by document; (document, A id, times) of links of same ids; (document, pair, times) of others."""
        texts = spaced(column)
        ids, bounds = zip(*(made.encode(texts) for made in (self.a, self.b)), strict=True)
        raw, docs = flat(texts)
        raw, n = np.frombuffer(raw, np.uint8), len(texts)
        good = np.diff(docs) > 0
        for i, b, spell in zip(ids, bounds, (self.spell_a, self.spell_b), strict=True):
            good &= self._spelt(i, b, spell, raw, docs)
        counts = [np.where(good, np.diff(b), 0) for b in bounds]
        ids = [i[np.repeat(good, np.diff(b))].astype(np.int64) for i, b in zip(ids, bounds, strict=True)]
        size = int(np.diff(docs)[good].sum())
        ends = [np.cumsum(spell.sizes[i]) for i, spell in zip(ids, (self.spell_a, self.spell_b), strict=True)]
        mark = np.zeros((2, size + 1), bool)
        mark[0, ends[0]] = mark[1, ends[1]] = True
        both = mark[0] & mark[1]
        groups = np.flatnonzero(both)
        group_of = np.cumsum(both, dtype=np.int32)
        last = [both[e] for e in ends]
        # tokens to the end of each group, and so the place of every token when a group's A tokens stand before its B tokens
        upto = [np.flatnonzero(x) + 1 for x in last]
        in_group = [group_of[e] - x for e, x in zip(ends, last, strict=True)]
        written = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        written[np.arange(len(ids[0])) + np.concatenate(([0], upto[1]))[in_group[0]]] = 2 * ids[0] + last[0]
        written[np.arange(len(ids[1])) + np.concatenate((upto[0], [0]))[in_group[1]]] = self.marked_b + 2 * ids[1] + last[1]
        spelt, at = self.marks.write(written)
        at = np.concatenate(([0], at))[np.concatenate(([0], np.cumsum(counts[0] + counts[1])))].tolist()
        spelt = memoryview(spelt.tobytes())
        digests = [hashlib.sha256(spelt[a : b - 1]).digest() if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
        # every stretch between neighbouring ends of either has one token of each: a link
        links = np.flatnonzero(mark[0] | mark[1])
        of = [np.cumsum(m, dtype=np.int32)[links] - m[links] for m in mark]
        doc = np.repeat(np.arange(n), counts[0])[of[0]]
        figures = np.stack([*counts, np.bincount(np.repeat(np.arange(n), counts[0])[upto[0] - 1], minlength=n) if len(groups) else np.zeros(n, np.int64), np.bincount(doc, minlength=n)], axis=1)
        a, b = ids[0][of[0]], ids[1][of[1]]
        alike = self.same[a] == b
        return figures, digests, _times(doc[alike], a[alike], 17), _times(doc[~alike], a[~alike] * self.b.vocabulary + b[~alike], 34)


def _times(doc: np.ndarray, code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, times = np.unique((doc << bits) | code, return_counts=True)
    return keys >> bits, keys & ((1 << bits) - 1), times


def same_ids(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """By A id: the B id of the same bytes (a piece rather than a byte), or -1."""
    place = {}
    for k, s in enumerate(b):
        if s:
            place[s] = k  # bytes have the first ids, so pieces replace them
    return np.array([place.get(s, -1) if s else -1 for s in a], np.int64)


def _align(path_a: str, path_b: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 32
        parts, size = [], 0
        for batch in tk.slices(batches, 1, SLICE):
            parts.append((batch.column(0), *made.align(batch.column(1))))
            size += pc.sum(pc.binary_length(batch.column(1).cast(pa.binary()))).as_py() or 0
            if size >= CHUNK:
                yield _chunk(chunk, parts)
                chunk, parts, size = chunk + 1, [], 0
        if parts:
            yield _chunk(chunk, parts)

    return align


def _chunk(chunk: int, parts: list[tuple]) -> pa.RecordBatch:
    ids = pa.concat_arrays([p[0] for p in parts])
    before = np.cumsum([0] + [len(p[0]) for p in parts])
    digests = [d for p in parts for d in p[2]]
    figures = tk.pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), np.concatenate([p[1] for p in parts]).ravel().astype(np.int64), np.frombuffer(b"".join(d or bytes(32) for d in digests), np.uint8), np.array([len(d) for d in digests], np.uint8))
    links = []
    for k in (3, 4):
        doc, code, times = (np.concatenate([p[k][j] + (before[i] if j == 0 else 0) for i, p in enumerate(parts)]) for j in range(3))
        links.append(tk.pack(doc.astype(np.uint32), code.astype(np.uint64), times.astype(np.uint32)))
    return pa.RecordBatch.from_arrays([pa.array([chunk]), *(pa.array([x], pa.binary()) for x in (figures, *links))], names=[f.split()[0] for f in ALIGNED.split(", ")])


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of aligned documents, written to the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return tk.written(rows.mapInArrow(tk.tidy(_align(path_a or tokens_a.default_path(), path_b or default_path()), encodes=True), ALIGNED), "aligned")


def _summed(code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, of = np.unique(code, return_inverse=True)
    return distinct, np.bincount(of, times, minlength=len(distinct)).astype(np.int64)


def _vector(size: int):
    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for value in batch.column(0):
                _, code, times = tk.unpack(value.as_buffer())
                np.add.at(total, code.astype(np.int64), times)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["a_id", "n"])

    return vector


def _pairs(size_b: int):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _, code, times = tk.unpack(value.as_buffer())
                code, times = _summed(code.astype(np.int64), times)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), chunk)), pa.array((code // size_b).astype(np.int32)), pa.array((code % size_b).astype(np.int32)), pa.array(times)], names=["_chunk", "a_id", "b_id", "n"])

    return pairs


class Counts:
    """Corpus-wide counts of aligned chunks.

    ``same``: by A id, the count of its link to the B id of the same bytes.  ``pairs``: a
    table of ``a_id``, ``b_id``, ``n`` of all other linked pairs.  ``best``: by B id, the
    highest count of a pair it is in.  The vectors are as long as the vocabularies.
    """

    def __init__(self, aligned: DataFrame, path_a: str | None = None, path_b: str | None = None) -> None:
        made = aligner(path_a or tokens_a.default_path(), path_b or default_path())
        self.size_b, self.same_ids = made.b.vocabulary, made.same
        spark = aligned.sparkSession
        vectors = aligned.select("same").mapInArrow(tk.tidy(_vector(len(self.same_ids))), "a_id long, n long")
        self.same = np.zeros(len(self.same_ids), np.int64)
        for a, n in vectors.groupBy("a_id").agg(F.sum("n")).collect():  # a row for each id of the vocabulary at most
            self.same[a] = n
        self.asked = aligned.select("_chunk", "pairs").mapInArrow(tk.tidy(_pairs(self.size_b)), "_chunk long, a_id int, b_id int, n long")
        self.pairs = tk.written(self.asked.groupBy("a_id", "b_id").agg(F.sum("n").alias("n")), "pairs")
        self.best = np.zeros(self.size_b, np.int64)
        for b, n in self.pairs.groupBy("b_id").agg(F.max("n")).collect():  # a row for each id of the vocabulary at most
            self.best[b] = n
        held = self.same_ids >= 0
        np.maximum.at(self.best, self.same_ids[held], self.same[held])
        self.spark = spark

    def table(self) -> DataFrame:
        """``a_id``, ``b_id``, ``n`` of all linked pairs, those of the same bytes among them."""
        held = np.flatnonzero(self.same)
        rows = pa.table({"a_id": pa.array(held.astype(np.int32)), "b_id": pa.array(self.same_ids[held].astype(np.int32)), "n": pa.array(self.same[held])})
        return self.pairs.unionByName(self.spark.createDataFrame(rows))


def _linked(same_ids: np.ndarray, same: np.ndarray, best: np.ndarray, size_b: int):
    own_best = np.where(same_ids >= 0, same == best[same_ids], False)

    def linked(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        code = answers.column("a_id").to_numpy().astype(np.int64) * size_b + answers.column("b_id").to_numpy()
        count = answers.column("n").to_numpy()
        order = np.argsort(code)
        code, count = code[order], count[order]
        for k in range(chunks.num_rows):
            ids, null, figures, digests, sizes = tk.unpack(chunks.column("figures")[k].as_buffer())
            n, text = len(ids), digests.tobytes().hex()
            doc, a, times = (x.astype(np.int64) for x in tk.unpack(chunks.column("same")[k].as_buffer()))
            totals = np.zeros((2, n), np.int64)
            np.add.at(totals[0], doc, times * own_best[a])
            np.add.at(totals[1], doc, times * same[a])
            doc, pair, times = (x.astype(np.int64) for x in tk.unpack(chunks.column("pairs")[k].as_buffer()))
            if len(doc):
                held = count[np.searchsorted(code, pair)]
                np.add.at(totals[0], doc, times * (held == best[pair % size_b]))
                np.add.at(totals[1], doc, times * held)
            columns = [pa.array(ids, mask=null.astype(bool)), *(pa.array(f) for f in figures.reshape(n, 4).T.copy()), *(pa.array(t) for t in totals)]
            columns.append(pa.array([text[64 * i : 64 * i + 64] if s else "" for i, s in enumerate(sizes.tolist())], pa.string()))
            out.append(pa.table(columns, names=["_id", *FIGURES, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    return linked


def document_links(aligned: DataFrame, counts: Counts, id_col: str = "doc_id") -> DataFrame:
    """By document: tokens, groups, links, links whose pair is its B id's best, the sum of all links' counts, and a digest of the groups."""
    answers = counts.asked.select("_chunk", "a_id", "b_id").join(counts.pairs.hint("merge"), ["a_id", "b_id"]).select("_chunk", "a_id", "b_id", "n")
    schema = "_id long, " + ", ".join(f"{f} long" for f in (*FIGURES, "n_best", "count_sum")) + ", groups_sha256 string"
    linked = tk.tidy(_linked(counts.same_ids, counts.same, counts.best, counts.size_b))
    out = aligned.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(linked, schema)
    return out.withColumnRenamed("_id", id_col)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return document_links(aligned, Counts(aligned))
