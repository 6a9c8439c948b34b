"""Language-model scores from a trigram trie, sharded over the cluster.

p(w | u v) = (c(u, v, w) + M3 * p(w | v)) / (c(u, v) + M3), where c(u, v) counts what
follows; p(w | v) = (c(v, w) + M2 * p(w)) / (c(v) + M2); p(w) = (c(w) + 1) / (N + V + 1):
counts of all training texts, smoothed towards shorter contexts.  Documents are dealt to
chunks.

1. Each chunk sends its distinct words, with their training counts, to buckets of word
   hashes; a bucket adds them up, gives each word a number, and answers each chunk with
   totals and numbers.
2. Each chunk sends its distinct bigrams and trigrams of known words, as a tree of
   numbers, to buckets of first words; a first word of more than ``SPLIT`` tokens is
   spread over several buckets by the second.  A bucket adds up the counts, builds the
   Elias-Fano trie of its shard, maps it into memory, and finds every n-gram that it was
   asked for in it, context by context.
3. Each chunk scores its documents with the answers.

A frequent word or n-gram arrives once a chunk, not once a document; a bucket holds the
distinct successors that each chunk has of a pair of words.  All shuffled rows are
compressed blobs; the driver gets nothing.

Defined cases: a null text is empty and holds the end token alone; a null doc_id counts
as the empty text in the held-out rule; repeated doc_ids and equal rows are documents of
their own (equal rows share a chunk); without training texts every token has the same
base probability; an empty table gives no rows; long texts are read whole, and a text
longer than a chunk makes a longer chunk; columns but id and text take no part, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .trie import STEPS, Trie, decode, encode

#: Mass of shorter contexts beside counts of bigrams and of trigrams.
MASSES, SPLIT = (200.0, 4.0), 1 << 18
#: The end token, also the context of a text's first token.
END = np.uint64(0x5851F42D4C957F2D)
BLOB = "_bucket long, _chunk long, _blob binary"
REPLY = "_chunk long, _kind int, _bucket long, _blob binary, _n long, _v long"


class Chunk:
    """Tokens of a chunk's documents as ranks among its distinct tokens."""

    def __init__(self, table: pa.Table) -> None:
        self.id = table.column("_chunk")[0].as_py()
        self.table, _, texts = tk.group_ids(table)
        words = tk.hash_words(texts, tk.SPACED, True)
        self.bounds = words.bounds + np.arange(len(words.bounds))
        tokens = np.full(self.bounds[-1], END, dtype=np.uint64)
        tokens[np.arange(len(words.hashes)) + words.doc_of()] = words.hashes
        self.words, self.token = np.unique(tokens, return_inverse=True)
        learnt = self.table.column("_train").to_numpy(zero_copy_only=False).astype(bool)
        self.learnt = np.repeat(learnt, np.diff(self.bounds))
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.bounds[:-1]] = np.searchsorted(self.words, END)
        self.before = before

    def number(self, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Totals and numbers of the chunk's words, which are then kept in the order of numbers."""
        total, number, bucket = np.zeros(len(self.words), dtype=np.int64), np.zeros(len(self.words), dtype=np.int64), (self.words % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for kind, b, value in zip(*(replies.column(c).to_pylist() for c in ("_kind", "_bucket", "_blob")), strict=True):
            if kind == 1:
                own = order[ends[b] : ends[b + 1]]
                total[own], rank = tk.unpack(value)
                number[own] = rank * buckets + b
        order = np.argsort(number)
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        self.token, self.before = place[self.token], place[self.before]
        end = self.before[0] if len(self.before) else 0  # a text's first token follows the end token
        earlier = np.empty_like(self.before)
        earlier[1:] = self.before[:-1]
        earlier[self.bounds[:-1]] = end
        self.earlier = earlier
        return total[order], number[order]

    def grams(self, totals: np.ndarray, numbers: np.ndarray, buckets: int) -> Grams:
        n, known = len(totals), totals > 0
        u, v, w = self.earlier, self.before, self.token
        pair, context = known[v] & known[w], known[u] & known[v]
        triple = context & known[w]
        keys, at = np.unique(np.concatenate((v[pair] * n + w[pair], u[context] * n + v[context])), return_inverse=True)
        first, second = keys // n, keys % n
        parts = np.maximum(-(-totals[first] // SPLIT), 1).astype(np.uint64)
        spread = tk.mix(numbers[second].astype(np.uint64)) % parts
        bucket = (tk.mix(numbers[first].astype(np.uint64) + spread * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        at, out = place[at], Grams()
        out.first, out.second, out.ends2 = first[order], second[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
        out.pair, out.context, out.triple = (np.full(len(w), -1, dtype=np.int64) for _ in range(3))
        out.pair[pair], out.context[context] = at[: pair.sum()], at[pair.sum() :]
        keys, at = np.unique(out.context[triple] * n + w[triple], return_inverse=True)
        out.parent, out.third, out.triple[triple] = keys // n, keys % n, at
        out.ends3 = np.searchsorted(out.parent, out.ends2)
        return out


def _steps(x) -> np.ndarray:
    return np.round(np.log10(x) * STEPS).astype(np.int64)


def _known(total: np.ndarray, mass: float) -> np.ndarray:
    """The part of a bigram's code that its first word's total gives away."""
    return _steps(total + mass)


def _less(share: np.ndarray, held: np.ndarray, parent: np.ndarray, share3: np.ndarray, total: np.ndarray, masses: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """Codes as they are sent: less what the asker knows, so that equal counts are equal numbers; 0 stays for none."""
    less = np.where(share > 0, _known(total, masses[0]) + 3 - share, 0)
    return less.astype(np.uint32), held, np.where(share3 > 0, held[parent].astype(np.int64) + _shift(masses) - share3, 0).astype(np.uint32)


def _more(less: np.ndarray, held: np.ndarray, parent: np.ndarray, less3: np.ndarray, total: np.ndarray, masses: tuple[float, float]) -> tuple[np.ndarray, ...]:
    """The codes that ``_less`` was made of."""
    share = np.where(less > 0, _known(total, masses[0]) + 3 - less, 0)
    return share, held, np.where(less3 > 0, held[parent].astype(np.int64) + _shift(masses) - less3, 0)


def _indexed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The few distinct values, and each value's place among them, mostly one byte."""
    values, place = np.unique(x, return_inverse=True)
    return values, place.astype(np.uint8 if len(values) <= 256 else np.uint16 if len(values) <= 65536 else np.uint32)


def _shift(masses: tuple[float, float]) -> int:
    return max(int(_steps(masses[1])), 0) + 3


class Grams:
    """Distinct bigrams (first, second) and trigrams (parent bigram, third) of a chunk in the order they are sent, with the buckets' ends.

    ``pair``, ``context`` and ``triple`` lead from tokens to their bigram, the bigram before
    them, and their trigram (-1: none).
    """


def _send_words(buckets: int):
    def send(table: pa.Table) -> pa.Table:
        own = Chunk(table)
        learnt = np.bincount(own.token[own.learnt], minlength=len(own.words)).astype(np.uint32)
        bucket = (own.words % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(ends))
        blobs = [tk.pack(own.words[order[ends[b] : ends[b + 1]]], learnt[order[ends[b] : ends[b + 1]]]) for b in full]
        return pa.table({"_bucket": pa.array(full, pa.int64()), "_chunk": pa.array([own.id] * len(full), pa.int64()), "_blob": pa.array(blobs, pa.binary())})

    return send


def _replies(rows: list[tuple]) -> pa.Table:
    names = [f.split()[0] for f in REPLY.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table({k: pa.array(v, t) for k, v, t in zip(names, columns, types, strict=True)})


def _add_words(table: pa.Table) -> pa.Table:
    """Each chunk's words' counts over all chunks and places in the bucket; the first answer carries the bucket's tokens and kinds."""
    bucket = table.column("_bucket")[0].as_py()
    parts = [tk.unpack(x) for x in table.column("_blob").to_pylist()]
    words, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.int64)
    rows, at = [], 0
    for k, (chunk, part) in enumerate(zip(table.column("_chunk").to_pylist(), parts, strict=True)):
        own = inverse[at : at + len(part[0])]
        at += len(own)
        rows.append((chunk, 1, bucket, tk.pack(counts[own], own.astype(np.int64)), 0 if k else int(counts.sum()), 0 if k else int((counts > 0).sum())))
    return _replies(rows)


def _send_grams(buckets: int):
    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        rows: tuple[list, list, list] = ([], [], [])
        if docs.num_rows:
            own = Chunk(docs)
            totals, numbers = own.number(replies, buckets)
            grams = own.grams(totals, numbers, buckets)
            learnt2 = np.bincount(grams.pair[(grams.pair >= 0) & own.learnt], minlength=len(grams.first)).astype(np.uint32)
            learnt3 = np.bincount(grams.triple[(grams.triple >= 0) & own.learnt], minlength=len(grams.parent)).astype(np.uint32)
            numbers = numbers.astype(np.uint64)
            for b in np.flatnonzero(np.diff(grams.ends2)):
                a2, z2, a3, z3 = grams.ends2[b], grams.ends2[b + 1], grams.ends3[b], grams.ends3[b + 1]
                first, n = np.unique(grams.first[a2:z2], return_counts=True)
                each = np.bincount(grams.parent[a3:z3] - a2, minlength=z2 - a2).astype(np.uint32)
                rows[0].append(int(b))
                rows[1].append(own.id)
                rows[2].append(tk.pack(numbers[first], totals[first], n.astype(np.uint32), numbers[grams.second[a2:z2]], learnt2[a2:z2], each, numbers[grams.third[a3:z3]], learnt3[a3:z3]))
        return pa.table({k: pa.array(v, t) for k, v, t in zip(("_bucket", "_chunk", "_blob"), rows, (pa.int64(), pa.int64(), pa.binary()), strict=True)})

    return send


def _look_up(masses: tuple[float, float]):
    def look_up(table: pa.Table) -> pa.Table:
        bucket = table.column("_bucket")[0].as_py()
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        sizes, base = [], 0
        for value in table.column("_blob").to_pylist():
            first, total, n, second, learnt2, each, third, learnt3 = tk.unpack(value)
            parent = base + np.repeat(np.arange(len(second)), each)
            for column, x in zip(columns, (np.repeat(first, n), np.repeat(total, n), second, learnt2, parent, third, learnt3), strict=True):
                column.append(x)
            sizes.append((len(second), len(third)))
            base += len(second)
        first, total, second, learnt2, parent, third, learnt3 = (np.concatenate(columns.pop(0)) for _ in range(7))
        words = np.unique(np.concatenate((first, second, third)))
        size, place = len(words), lambda x: np.searchsorted(words, x)
        # what all chunks ask for, once each, with the sums of their counts
        keys2, at2 = np.unique(place(first) * size + place(second), return_inverse=True)
        del first, second
        count2 = np.bincount(at2, weights=learnt2, minlength=len(keys2))
        whole = np.zeros(len(keys2))
        whole[at2] = total
        del total, learnt2
        keys3, at3 = np.unique(at2[parent] * size + place(third), return_inverse=True)
        del parent, third
        at2, at3 = at2.astype(np.int32), at3.astype(np.int32)
        count3 = np.bincount(at3, weights=learnt3, minlength=len(keys3))
        follow = np.bincount(keys3 // size, weights=count3, minlength=len(keys2))
        have2, have3 = (count2 > 0) | (follow > 0), count3 > 0
        node = np.cumsum(have2) - 1
        under = keys3[have3] // size
        # logarithms of counts and of what they are shares of are rounded one by one: the codes differ by the former alone
        held = encode(masses[1] / (follow + masses[1])).astype(np.int64)
        share = np.where(count2 > 0, np.maximum(_known(whole, masses[0]) + 1 - _steps(np.maximum(count2, 1)), 1), 0)
        share3 = np.maximum(held[under] + _steps(masses[1]) - _steps(count3[have3]), 1)
        trie = Trie.mapped(
            Trie.build(
                words,
                keys2[have2] // size,
                keys2[have2] % size,
                share[have2],
                held[have2],
                node[under],
                keys3[have3] % size,
                share3,
            )
        )
        pair = trie.bigrams(words[keys2 // size], words[keys2 % size])
        triple = trie.trigrams(pair[keys3 // size], words[keys3 % size])
        share, held = (np.where(pair >= 0, codes[np.maximum(pair, 0)], np.uint16(none)) if len(codes) else np.full(len(pair), none, np.uint16) for codes, none in ((trie.share, 0), (trie.held, 1)))
        share3 = np.where(triple >= 0, trie.share3[np.maximum(triple, 0)], 0) if len(trie.share3) else np.zeros(len(triple), np.uint16)
        share, held, share3 = _less(share, held, keys3 // size, share3, whole, masses)
        rows, a, b = [], 0, 0
        for chunk, (n, m) in zip(table.column("_chunk").to_pylist(), sizes, strict=True):
            rows.append((chunk, 2, bucket, tk.pack(*_indexed(share[at2[a : a + n]]), *_indexed(held[at2[a : a + n]]), *_indexed(share3[at3[b : b + m]])), 0, 0))
            a, b = a + n, b + m
        return _replies(rows)

    return look_up


def _score(buckets: int, masses: tuple[float, float]):
    def score(docs: pa.Table, replies: pa.Table) -> pa.Table:
        own = Chunk(docs)
        c, numbers = own.number(replies, buckets)
        grams = own.grams(c, numbers, buckets)
        # one place more than n-grams, which -1 (none) leads to
        share, held, share3 = np.zeros(len(grams.first) + 1), np.ones(len(grams.first) + 1), np.zeros(len(grams.parent) + 1)
        n = v = 0
        for kind, b, value, tokens, kinds in zip(*(replies.column(k).to_pylist() for k in ("_kind", "_bucket", "_blob", "_n", "_v")), strict=True):
            if kind == 0:
                n, v = tokens, kinds
            elif kind == 2:
                part2, part3 = slice(grams.ends2[b], grams.ends2[b + 1]), slice(grams.ends3[b], grams.ends3[b + 1])
                parts = tk.unpack(value)
                less, codes, less3 = (parts[k][parts[k + 1]] for k in (0, 2, 4))
                share[part2], held[part2], share3[part3] = map(decode, _more(less, codes, grams.parent[part3] - grams.ends2[b], less3, c[grams.first[part2]], masses))
        log = np.log10((c + 1) / (n + v + 1))
        one = (masses[0] / (c[own.before] + masses[0])) * ((c + 1) / (n + v + 1))[own.token]
        value = np.log10(share3[grams.triple] + held[grams.context] * (share[grams.pair] + one))
        return pa.table(
            {
                "_id": own.table.column("_id"),
                "_train": own.table.column("_train"),
                "_n_tokens": pa.array(np.diff(own.bounds)),
                "_n_known": pa.array(tk.sub_sums((c > 0)[own.token].astype(np.int64), own.bounds)),
                "_train_tokens": pa.array(np.full(len(own.bounds) - 1, n, dtype=np.int64)),
                "_base": pa.array(np.add.reduceat(log[own.token], own.bounds[:-1])),
                "_score": pa.array(np.add.reduceat(value, own.bounds[:-1])),
            }
        )

    return score


def score_texts(docs: DataFrame, learn: Column, masses: tuple[float, float] = MASSES, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None) -> DataFrame:
    """Scores of all documents by a model of those that ``learn`` selects.

    Returns ``id_col``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (add-one unigram) and ``score``, both log10 probabilities.
    """
    n = chunks or tk.chunk_count(docs, text_col)
    dealt = tk.chunked(docs, n, id_col, text_col, F.coalesce(learn, F.lit(False)).alias("_train"))
    buckets = tk.bucket_count(n, each=2)
    words = dealt.groupBy("_chunk").applyInArrow(tk.tidy(_send_words(buckets)), BLOB).groupBy("_bucket").applyInArrow(tk.tidy(_add_words), REPLY)
    totals = words.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"), F.coalesce(F.sum("_v"), F.lit(0)).alias("_v"))
    every = totals.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_chunk"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_bucket"), F.lit(None).cast("binary").alias("_blob"), "_n", "_v")
    grams = dealt.groupBy("_chunk").cogroup(words.groupBy("_chunk")).applyInArrow(tk.tidy(_send_grams(buckets)), BLOB)
    found = grams.groupBy("_bucket").applyInArrow(tk.tidy(_look_up(masses)), REPLY)
    answers = words.unionByName(found).unionByName(every)
    scored = dealt.groupBy("_chunk").cogroup(answers.groupBy("_chunk"))
    schema = "_id long, _train boolean, _n_tokens long, _n_known long, _train_tokens long, _base double, _score double"
    out = scored.applyInArrow(tk.tidy(_score_or_none(buckets, masses)), schema)
    return out.select(F.col("_id").alias(id_col), (~F.col("_train")).alias("held_out"), F.col("_n_tokens").alias("n_tokens"), F.col("_n_known").alias("n_known"), F.col("_train_tokens").alias("train_tokens"), F.col("_base").alias("base_score"), F.col("_score").alias("score"))


def _score_or_none(buckets: int, masses: tuple[float, float]):
    run = _score(buckets, masses)
    empty = pa.table({k: pa.array([], t) for k, t in (("_id", pa.int64()), ("_train", pa.bool_()), ("_n_tokens", pa.int64()), ("_n_known", pa.int64()), ("_train_tokens", pa.int64()), ("_base", pa.float64()), ("_score", pa.float64()))})
    return lambda docs, replies: run(docs, replies) if docs.num_rows else empty


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, tk.crc_remainder(F.col("doc_id"), 7) != 2)
