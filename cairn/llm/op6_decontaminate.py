"""Benchmark decontamination with a positional inverted index sharded by documents.

``build_index`` stores the postings of every token of the training texts: a row is a
shard of about 4 MB of documents and holds its distinct terms in order, the bounds of
their lists, and the ascending positions.  ``search`` takes the windows of the test
items in blocks of bounded size.  In each shard the candidates of a window are the
postings of its rarest term, moved back by the term's offset; they are intersected with
the moved lists of the other terms, rarest first.  What is left are exact phrases.
Proximity matches keep the candidates that have the window's second and third rarest
terms within ``slop`` words, in any order.

Defined cases: a null text or item has no words; an item without words has no windows;
an item of fewer than ``window`` words is one window.  Equal rows, repeated and null
doc_ids are rows of their own; items that share an item_id are one item, a null item_id
counting as the empty text.  Empty tables give no rows or no hits.  A text longer than a
shard is a shard of its own.  Columns but id and text take no part, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

WINDOW = 13
INDEX = "shard string, doc_ids binary, null_ids binary, bounds binary, terms binary, list_ends binary, positions binary"
FOUND = "_shard string, _row long, _id long, _n_words long, _spans array<struct<begin: long, end: long>>, _items array<string>, _near array<string>"
#: Characters of test items that one search block sends to the tasks.
BLOCK_CHARS = 2 << 20


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.slices(batches, 1):
        words = tk.hash_words(tk.as_bytes(batch.column(1)), tk.ALNUM, True)
        terms, rank = np.unique(words.hashes, return_inverse=True)
        order = np.argsort(rank, kind="stable")
        ids = batch.column(0)
        # one free position between documents keeps phrases inside one of them
        position = np.arange(len(order)) + words.doc_of()
        lists = np.cumsum(np.bincount(rank, minlength=len(terms)))
        arrays = [
            ids.fill_null(0).to_numpy(zero_copy_only=False),
            ids.is_null().to_numpy(zero_copy_only=False),
            words.bounds,
            terms,
            lists.astype(np.uint32),
            position[order].astype(np.uint32),
        ]
        names = [f.split()[0] for f in INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([a.tobytes()], pa.binary()) for a in arrays)], names=names)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index, written to the shared folder; it depends on no test set and can be kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return tk.written(rows.mapInArrow(tk.tidy(_index), INDEX), "index")


class Windows:
    """All windows of some items: hashes, lengths, and the item of each."""

    def __init__(self, items: list[tuple[str, bytes | None]], size: int = WINDOW) -> None:
        words = tk.hash_words([t for _, t in items], tk.ALNUM, True)
        n = np.diff(words.bounds)
        self.items = [k for k, _ in items]
        # every item of ``size`` words or more has a window at each place but its last size - 1
        each = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
        self.of = np.repeat(np.arange(len(items)), each)
        self.lengths = np.minimum(n, size)[self.of]
        first = words.bounds[:-1][self.of] + np.arange(len(self.of)) - np.repeat(np.cumsum(each) - each, each)
        place = np.minimum(first[:, None] + np.arange(size), max(len(words.hashes) - 1, 0))
        hashes = np.where(np.arange(size) < self.lengths[:, None], words.hashes[place], 0).astype(np.uint64) if len(place) else np.zeros((0, size), np.uint64)
        self.terms, rank = np.unique(hashes, return_inverse=True)
        self.ranks = rank.reshape(hashes.shape)


def _find(own: Windows, terms: np.ndarray, ends: np.ndarray, positions: np.ndarray, slop: int) -> tuple[np.ndarray, ...]:
    """Phrases (window, position) and proximity matches (window, position of the rarest term)."""
    none = np.zeros(0, dtype=np.int64)
    if not len(terms) or not len(own.of):
        return none, none, none, none
    starts = np.concatenate(([0], ends[:-1]))
    place = np.minimum(np.searchsorted(terms, own.terms), len(terms) - 1)
    have = np.where(terms[place] == own.terms, ends[place] - starts[place], 0)
    size = own.ranks.shape[1]
    count = have[own.ranks]
    count[np.arange(size) >= own.lengths[:, None]] = np.iinfo(np.int64).max
    alive = np.flatnonzero(count.min(axis=1) > 0)
    order = np.argsort(count[alive], axis=1, kind="stable")
    ranks = np.take_along_axis(own.ranks[alive], order, axis=1)
    n = have[ranks[:, 0]] if len(alive) else none
    row = np.repeat(np.arange(len(alive)), n)
    lists = place[ranks[row, 0]]
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    found = positions[starts[lists] + nth]
    begin = found - order[row, 0]
    keys = (np.repeat(np.arange(len(terms)), ends - starts) << 32) | positions
    holds = lambda term, at: keys[np.minimum(np.searchsorted(keys, (term << 32) | at), len(keys) - 1)] == ((term << 32) | at)
    near = np.ones(len(row) if slop else 0, dtype=bool)
    for k in (1, 2) if slop else ():
        term = place[ranks[row, k]] << 32
        at = np.minimum(np.searchsorted(keys, term | np.maximum(found - slop, 0)), len(keys) - 1)
        near &= (k >= own.lengths[alive][row]) | ((keys[at] >= (term | np.maximum(found - slop, 0))) & (keys[at] <= (term | (found + slop))))
    close, close_at = (alive[row[near]], found[near]) if slop else (none, none)
    keep = begin >= 0
    row, begin = row[keep], begin[keep]
    for k in range(1, size):
        if not len(row):
            break
        keep = k >= own.lengths[alive][row]
        test = ~keep
        keep[test] = holds(place[ranks[row[test], k]], begin[test] + order[row[test], k])
        row, begin = row[keep], begin[keep]
    return alive[row], begin, close, close_at


def _search(own: Windows, slop: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                raw = [batch.column(i)[r].as_buffer() for i in range(1, batch.num_columns)]
                ids, null, bounds, terms, ends, positions = (np.frombuffer(b, t) for b, t in zip(raw, (np.int64, bool, np.int64, np.uint64, np.uint32, np.uint32), strict=True))
                window, begin, close, close_at = _find(own, terms, ends.astype(np.int64), positions.astype(np.int64), slop)
                n = len(ids)
                first = bounds[:-1] + np.arange(n)
                doc = np.searchsorted(first, begin, side="right") - 1
                spans, items = [[] for _ in range(n)], [set() for _ in range(n)]
                for d, w, b in zip(doc.tolist(), window.tolist(), begin.tolist(), strict=True):
                    at = b - int(first[d])
                    spans[d].append((at, at + int(own.lengths[w])))
                    items[d].add(own.items[own.of[w]])
                nearby: list[set] = [set() for _ in range(n)]
                for d, w in zip((np.searchsorted(first, close_at, side="right") - 1).tolist(), close.tolist(), strict=True):
                    nearby[d].add(own.items[own.of[w]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[r].as_py()] * n, pa.string()),
                        pa.array(np.arange(n)),
                        pa.array(ids, mask=null),
                        pa.array(np.diff(bounds)),
                        pa.array([[{"begin": a, "end": b} for a, b in _union(s)] for s in spans], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                        pa.array([sorted(x) for x in nearby], pa.list_(pa.string())),
                    ],
                    names=["_shard", "_row", "_id", "_n_words", "_spans", "_items", "_near"],
                )

    return search


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, item_col: str = "item_id", item_text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``n_words``, ``spans`` (hit words, begin to end), ``item_ids``, ``near_item_ids`` of every document.

    ``slop`` 0 leaves proximity matches out.  The items are a stated query set, sent in
    blocks of about ``BLOCK_CHARS`` characters; with more than one block, the spans of a
    document are ordered but can overlap.
    """
    asked = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("_item"), F.col(item_text_col).alias("_text")).where("_text IS NOT NULL")
    size = asked.agg(F.sum(F.length("_text"))).first()[0] or 0
    blocks = size // BLOCK_CHARS + 1
    parts = []
    for b in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b)
        own = Windows([(r[0], r[1].encode()) for r in part.toLocalIterator()], window)
        parts.append(index.mapInArrow(tk.tidy(_search(own, slop)), FOUND))
    out = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            out = out.unionByName(part)
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("_spans", "_items", "_near")]
        out = out.groupBy("_shard", "_row").agg(F.first("_id").alias("_id"), F.first("_n_words").alias("_n_words"), *lists)
        out = out.select("_id", "_n_words", F.array_sort("_spans").alias("_spans"), *[F.array_sort(F.array_distinct(c)).alias(c) for c in ("_items", "_near")])
    return out.select(F.col("_id").alias(id_col), F.col("_n_words").alias("n_words"), F.col("_spans").alias("spans"), F.col("_items").alias("item_ids"), F.col("_near").alias("near_item_ids"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, slop: int = 2 * WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``search`` with ``n_hit`` and ``contaminated``: at least one of ``share`` words is hit."""
    found = search(build_index(docs, id_col, text_col), items, window, slop, id_col=id_col)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    hit = F.aggregate(
        "spans",
        start,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["begin"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")),
        lambda a: a["n"],
    )
    return found.withColumn("n_hit", hit).withColumn("contaminated", F.expr(f"n_hit > 0 AND {share} * n_hit >= n_words"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM b WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p+n-1], ' ') AS k FROM bw),
sizes AS (SELECT DISTINCT n FROM q),
s AS (SELECT doc_id, sizes.n AS n, w, unnest(range(1, greatest(len(w) - sizes.n + 2, 1))) AS p FROM d, sizes),
m AS (SELECT s.doc_id AS doc_id, s.p AS p, s.n AS n, item_id FROM (SELECT doc_id, n, p, array_to_string(w[p:p+n-1], ' ') AS k FROM s) s JOIN q ON s.n = q.n AND s.k = q.k),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
