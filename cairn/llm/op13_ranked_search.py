"""Ranked lexical search, term at a time with a limit on accumulators.

``build_index`` stores shards of about 8 MB of documents: the distinct terms of a shard in
order, and for each the documents that hold it and how often.  ``search`` takes the asked
items in blocks of bounded size.  Counts over all shards give a term its weight.  In a
shard an item's terms are taken rarest first, each document met gets an accumulator of its
score so far, and no term that is left can add more than its highest part in the shard.
Once these bounds together are less than the k-th highest score so far, of this shard or of
those that the task had before, no new accumulators are made; those that are there go on to
their exact scores.  A task gives its best documents of an item, and the best of all tasks
are ranked.

Scores are whole numbers: a term's weight is floor(1000 ln((2N+2)/(2df+1))), its part in a
document weight * (10^9 tf div (1000 tf + 8 m)) with m = 10 + (90 n N div L); N documents
with a term hold L terms, the document n, df documents the term, the document tf of it.

Defined cases: a null text or item has no terms and is not counted or ranked; a term counts
once an item, whatever its times there; items that share an item_id (null too) are one item
with the terms of all.  Equal rows, repeated and null doc_ids are rows of their own; equal
scores are ranked by doc_id, null first.  Empty tables, and items without a document that
scores, give no rows.  A text longer than a shard is a shard of its own.  Columns but id
and text take no part, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkit as tk

MOST = 10
#: Bytes of text in a shard, and characters of items that one search block sends to the tasks.
SHARD, BLOCK_CHARS = 8 << 20, 2 << 20
INDEX = "n_docs long, n_terms long, postings binary"
FOUND = "_item string, _score long, _id long"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0
    for batch in tk.slices(batches, 1, SHARD):
        texts = tk.as_bytes(batch.column(1))
        own = sum(len(t or b"") for t in texts)
        if parts and size + own > SHARD:
            yield _shard(parts)
            parts, size = [], 0
        parts.append((batch.column(0), tk.hash_words(texts, tk.ALNUM, True)))
        size += own
    if parts:
        yield _shard(parts)


def _shard(parts: list[tuple[pa.Array, tk.Words]]) -> pa.RecordBatch:
    ids = pa.concat_arrays([p[0] for p in parts])
    lengths = np.concatenate([np.diff(words.bounds) for _, words in parts])
    terms, rank = np.unique(np.concatenate([words.hashes for _, words in parts]), return_inverse=True)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    keys, times = np.unique(rank * max(len(lengths), 1) + doc, return_counts=True)
    term, doc = np.divmod(keys, max(len(lengths), 1))
    ends = np.cumsum(np.bincount(term, minlength=len(terms)))
    value = tk.pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), lengths, terms, ends, doc.astype(np.uint32), times.astype(np.uint32))
    return pa.RecordBatch.from_arrays([pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.array([value], pa.binary())], names=[f.split()[0] for f in INDEX.split(", ")])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written to the shared folder; it depends on no items and can be kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return tk.written(rows.mapInArrow(tk.tidy(_index), INDEX), "lexical")


def _places(terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``asked`` terms a shard has, and where."""
    place = np.minimum(np.searchsorted(terms, asked), max(len(terms) - 1, 0))
    have = np.flatnonzero(terms[place] == asked) if len(terms) else np.zeros(0, np.int64)
    return have, place[have]


def _holding(asked: np.ndarray):
    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(asked), np.int64)
        for batch in batches:
            for value in batch.column(0):
                _, _, _, terms, ends, _, _ = tk.unpack(value.as_buffer())
                have, place = _places(terms, asked)
                held[have] += np.diff(ends, prepend=0)[place]
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(held[found])], names=["term", "df"])

    return holding


class Asked:
    """A block of items: their distinct terms, and each item's, rarest first, with weights."""

    def __init__(self, items: dict[str | None, bytes]) -> None:
        words = tk.hash_words(list(items.values()), tk.ALNUM, True)
        self.items = list(items)
        self.terms = np.unique(words.hashes)
        self.own = [np.unique(np.searchsorted(self.terms, words.hashes[a:b])) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        self.weights = np.zeros(len(self.terms), np.int64)
        self.n = self.total = 0

    def weigh(self, df: np.ndarray, n: int, total: int) -> None:
        self.n, self.total = n, total
        self.weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)
        self.own = [t[np.argsort(df[t], kind="stable")] for t in self.own]


class Best:
    """The ``most`` best documents of an item so far: by score, then by doc_id, null first."""

    def __init__(self, most: int) -> None:
        self.most, self.score, self.id, self.known = most, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        score, ids, known = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.known, known)))
        order = np.lexsort((ids, known, -score))[: self.most]
        self.score, self.id, self.known = score[order], ids[order], known[order]

    def bar(self, partial: np.ndarray) -> int:
        """The k-th highest of the scores so far and those under way; 1 while there are fewer."""
        if len(self.score) + len(partial) < self.most:
            return 1
        return max(1, int(np.partition(np.concatenate((self.score, partial)), -self.most)[-self.most]))


def _accumulate(lists: list[tuple[np.ndarray, np.ndarray]], bounds: list[int], best: Best, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents with an accumulator, and their scores; ``lists`` has documents and parts of each term, rarest first."""
    score, made = np.zeros(n_docs, np.int64), np.zeros(n_docs, bool)
    left, making = sum(bounds), True
    for (docs, parts), bound in zip(lists, bounds, strict=True):
        if making and left < best.bar(score[made]):
            making = False
        if not making:
            kept = made[docs]
            docs, parts = docs[kept], parts[kept]
        else:
            made[docs] = True
        score[docs] += parts
        left -= bound
    found = np.flatnonzero(made & (score > 0))
    return found, score[found]


def _search(asked: Asked, most: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in asked.items]
        for batch in batches:
            for value in batch.column(0):
                ids, null, lengths, terms, ends, docs, times = tk.unpack(value.as_buffer())
                have, place = _places(terms, asked.terms)
                if not len(have):
                    continue
                counts = np.diff(ends, prepend=0)[place]
                upto = np.cumsum(counts)
                take = np.repeat(ends[place] - upto, counts) + np.arange(upto[-1])
                doc, tf = docs[take].astype(np.int64), times[take].astype(np.int64)
                m = 10 + 90 * lengths * asked.n // asked.total
                parts = np.repeat(asked.weights[have], counts) * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                highest = np.maximum.reduceat(parts, upto - counts)
                of = np.full(len(asked.terms), -1, np.int64)
                of[have] = np.arange(len(have))
                known = ~null.astype(bool)
                for own, top in zip(asked.own, best, strict=True):
                    held = of[own]
                    held = held[held >= 0]
                    bounds = highest[held].tolist()
                    if sum(bounds) < top.bar(parts[:0]):
                        continue
                    lists = [(doc[upto[k] - counts[k] : upto[k]], parts[upto[k] - counts[k] : upto[k]]) for k in held.tolist()]
                    found, score = _accumulate(lists, bounds, top, len(ids))
                    top.add(score, ids[found], known[found])
        for item, top in zip(asked.items, best, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(top.score), pa.string()), pa.array(top.score), pa.array(top.id, mask=~top.known)], names=["_item", "_score", "_id"])

    return search


def search(index: DataFrame, items: DataFrame, most: int = MOST, item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``item_col``, ``rank``, ``id_col``, ``score`` of the ``most`` documents that score highest for each item."""
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    texts = items.select(F.col(item_col).cast("string").alias("_item"), F.col(item_text_col).alias("_text")).where("_text IS NOT NULL")
    size = texts.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks, out = size // BLOCK_CHARS + 1, None
    for b in range(blocks):
        # rows of an item stay in one block
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == b)
        held: dict[str | None, bytes] = {}
        for item, text in part.toLocalIterator():
            held[item] = held.get(item, b"") + b" " + text.encode()
        asked = Asked(held)
        df = np.zeros(len(asked.terms), np.int64)
        for term, d in index.select("postings").mapInArrow(tk.tidy(_holding(asked.terms)), "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # a row for each term of the block at most
            df[term] = d
        asked.weigh(df, n, total)
        found = index.select("postings").mapInArrow(tk.tidy(_search(asked, most)), FOUND)
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("rank", F.row_number().over(Window.partitionBy("_item").orderBy(F.desc("_score"), F.asc_nulls_first("_id")))).where(F.col("rank") <= most)
    return ranked.select(F.col("_item").cast(items.schema[item_col].dataType).alias(item_col), "rank", F.col("_id").alias(id_col), F.col("_score").alias("score"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM b) GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
x AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score
  FROM p JOIN w USING (term) JOIN b USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""
