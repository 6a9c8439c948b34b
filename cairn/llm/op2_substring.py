"""Removal of long repeated passages, found with difference-cover anchors.

Two equal stretches of ``window`` words start at i and j.  For a difference cover D
modulo v there is a shift d < v with both (i + d) mod v and (j + d) mod v in D, so both
stretches hold an anchor, the hash of ``window - v + 1`` words beginning at a cover
position, at the same shift.  Hashing only cover positions therefore misses no match.
With window 20 the cover {0, 1, 3, 9} modulo 13 leaves 4 of 13 positions, each hashed
over 8 words.

1. Documents are dealt to chunks.  Each chunk sends every distinct anchor hash once, so
   a hash of a third of all documents arrives as one entry a chunk, not one a document.
2. Buckets of hashes tell each chunk which of its anchors others have as well.
3. Only windows holding such an anchor are extended to all their words (96-bit hashes)
   and sent, again once a chunk, with their document; the first one stays.

Defined cases: null text has no words; null doc_id sorts before all others; rows that
share a doc_id are ordered by the hash of id and text, then by text, however they are
dealt; equal rows count as separate documents, the later of which loses its windows; they
share a chunk.  Fewer than ``window`` words: nothing is removed.  An empty table gives no
rows.  A text is never cut, however long: it is a block of its own.  Columns of any name
can be carried; without ``carry`` only id and text take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

#: Perfect difference covers, by modulus (fixed values).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
BLOB = "_bucket long, _chunk long, _blob binary"
REPLY = "_chunk long, _blob binary"
_LEAST = -(2**63)


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The largest modulus that leaves anchors of at least 8 words, else of as many as can be."""
    v = max((v for v in COVERS if window - v + 1 >= 8), default=None)
    if v is None:
        return 1, (0,)
    return v, COVERS[v]


def _starts(bounds: np.ndarray, size: int) -> np.ndarray:
    """Positions at which ``size`` words of one document begin."""
    n = int(bounds[-1])
    ok = np.ones(n, dtype=bool)
    for k in range(1, size):
        last = bounds[1:] - k
        ok[last[last >= bounds[:-1]]] = False
    return ok


def _anchors(words: tk.Words, window: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    v, cover = cover_for(window)
    size = window - v + 1
    ok = _starts(words.bounds, size)
    place = np.arange(len(ok)) - np.repeat(words.bounds[:-1], np.diff(words.bounds))
    keep = np.zeros(v, dtype=bool)
    keep[list(cover)] = True
    at = np.flatnonzero(ok & keep[place % v])
    return at, tk.window_hash(words.hashes, size, at), size, v


def _out(rows: dict, types: list) -> pa.Table:
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), types, strict=True)})


def _send(chunk: int, buckets: np.ndarray, n: int, *columns: np.ndarray) -> tuple[list, list, list]:
    order = np.argsort(buckets, kind="stable")
    ends = np.searchsorted(buckets[order], np.arange(n + 1))
    out: tuple[list, list, list] = ([], [], [])
    for b in np.flatnonzero(np.diff(ends)):
        take = order[ends[b] : ends[b + 1]]
        out[0].append(int(b))
        out[1].append(chunk)
        out[2].append(tk.pack(*(c[take] for c in columns)))
    return out


_BLOB_T, _REPLY_T = [pa.int64(), pa.int64(), pa.binary()], [pa.int64(), pa.binary()]


def _send_anchors(window: int, buckets: int) -> Callable[[pa.Table], pa.Table]:
    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("_chunk")[0].as_py()
        _, _, texts = tk.group_ids(table)
        _, h, _, _ = _anchors(tk.hash_words(texts, tk.SPACED, False), window)
        h = np.unique(h)
        rows = _send(chunk, (h % np.uint64(buckets)).astype(np.int64), buckets, h, )
        return _out(dict(zip(("_bucket", "_chunk", "_blob"), rows, strict=True)), _BLOB_T)

    return send


def _shared_anchors(table: pa.Table) -> pa.Table:
    """The hashes that more than one chunk sent, for each chunk that did."""
    chunks = table.column("_chunk").to_pylist()
    parts = [tk.unpack(x)[0] for x in table.column("_blob").to_pylist()]
    every = np.sort(np.concatenate(parts))
    shared = np.unique(every[1:][every[1:] == every[:-1]])
    rows: tuple[list, list] = ([], [])
    for chunk, h in zip(chunks, parts, strict=True):
        own = h[np.isin(h, shared, assume_unique=True)] if len(shared) else h[:0]
        if len(own):
            rows[0].append(chunk)
            rows[1].append(tk.pack(own))
    return _out(dict(zip(("_chunk", "_blob"), rows, strict=True)), _REPLY_T)


def _send_windows(window: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(docs: pa.Table, replies: pa.Table) -> pa.Table:
        none = _out({"_bucket": [], "_chunk": [], "_blob": []}, _BLOB_T)
        if not docs.num_rows:
            return none
        chunk = docs.column("_chunk")[0].as_py()
        _, ids, texts = tk.group_ids(docs)
        words = tk.hash_words(texts, tk.SPACED, False)
        at, h, size, v = _anchors(words, window)
        if not len(at):
            return none
        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
        hit = counts[inverse] > 1
        got = [tk.unpack(x)[0] for x in replies.column("_blob").to_pylist()]
        if got:
            hit |= np.isin(h, np.concatenate(got))
        # windows beginning up to v - 1 words before a shared anchor hold it
        near = np.zeros(len(words.hashes) + 1, dtype=np.int64)
        np.add.at(near, np.maximum(at[hit] - (v - 1), 0), 1)
        np.add.at(near, at[hit] + 1, -1)
        start = np.flatnonzero((np.cumsum(near[:-1]) > 0) & _starts(words.bounds, window))
        if not len(start):
            return none
        first = tk.window_hash(words.hashes, window, start)
        second = (tk.window_hash(words.hashes, window, start, 0xC2B2AE3D27D4EB4F) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((start, second, first))
        a, b = first[order], second[order]
        again = np.zeros(len(order), dtype=bool)
        again[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        later = np.sort(start[order[again]])
        lead = np.sort(order[~again])
        first, second, start = first[lead], second[lead], start[lead]
        own = np.array([_LEAST if i is None else i for i in ids], dtype=np.int64)
        doc = own[np.searchsorted(words.bounds, start, side="right") - 1]
        rows = _send(chunk, (first % np.uint64(buckets)).astype(np.int64), buckets, first, second, start.astype(np.uint32), doc)
        if len(later):
            rows[0].append(chunk % buckets)
            rows[1].append(chunk)
            rows[2].append(tk.pack(later.astype(np.uint32)))
        return _out(dict(zip(("_bucket", "_chunk", "_blob"), rows, strict=True)), _BLOB_T)

    return send


def _later_windows(table: pa.Table) -> pa.Table:
    """The window starts of each chunk that are not the first of their words."""
    chunks, parts, out = [], [], {}
    for chunk, value in zip(table.column("_chunk").to_pylist(), table.column("_blob").to_pylist(), strict=True):
        got = tk.unpack(value)
        if len(got) == 1:
            out.setdefault(chunk, []).append(got[0])
        else:
            chunks.append(chunk)
            parts.append(got)
    if parts:
        first, second, start, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        chunk = np.repeat(np.array(chunks, dtype=np.int64), [len(x[0]) for x in parts])
        order = np.lexsort((start, chunk, doc, second, first))
        a, b = first[order], second[order]
        again = np.flatnonzero((a[1:] == a[:-1]) & (b[1:] == b[:-1])) + 1
        take = order[again]
        take = take[np.lexsort((start[take], chunk[take]))]
        for c, group in zip(*_runs(chunk[take], start[take]), strict=True):
            out.setdefault(int(c), []).append(group)
    return _out({"_chunk": list(out), "_blob": [tk.pack(np.sort(np.concatenate(x))) for x in out.values()]}, _REPLY_T)


def _runs(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    cut = np.flatnonzero(key[1:] != key[:-1]) + 1
    return key[np.concatenate(([0], cut))] if len(key) else key, np.split(values, cut) if len(key) else []


def _cut(window: int, keep_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def cut(docs: pa.Table, replies: pa.Table) -> pa.Table:
        table, ids, texts = tk.group_ids(docs)
        counts = [len((t or b"").split()) for t in texts]
        bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
        cover = np.zeros(int(bounds[-1]) + 1, dtype=np.int64)
        for value in replies.column("_blob").to_pylist():
            start = tk.unpack(value)[0].astype(np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        removed = tk.sub_sums(gone.astype(np.int64), bounds)
        kept, digest = [], []
        for i, text in enumerate(texts):
            words = (text or b"").split()
            if removed[i]:
                words = [w for w, x in zip(words, gone[bounds[i] : bounds[i + 1]], strict=True) if not x]
            joined = b" ".join(words)
            digest.append(hashlib.sha256(joined).hexdigest())
            if keep_text:
                kept.append(text if not removed[i] else joined)
        out = {k: table.column(k) for k in table.column_names if k not in ("_chunk", "_hash", "_id", "_text")}
        out |= {"_id": table.column("_id"), "_n_words": pa.array(counts, pa.int64()), "_n_removed": pa.array(removed, pa.int64()), "_kept_sha256": pa.array(digest, pa.string())}
        if keep_text:
            out["_kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(out)

    return cut


def remove_repeats(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunks: int | None = None, carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Each document with what is left of it.

    Returns ``id_col``, ``n_words``, ``n_removed``, ``kept_sha256``; with ``carry``, a
    list of further columns, those come first (their values pass through) and
    ``kept_text`` last: the text as it was if nothing is removed, else the kept words
    joined by one space.  ``prefix`` comes before the new columns' names, so that carried
    columns of any names stay apart from them.
    """
    n = chunks or tk.chunk_count(docs, text_col)
    buckets = tk.bucket_count(n)
    own = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")] if carry else []
    plain = tk.chunked(docs, n, id_col, text_col, *own)
    dealt = plain.select("_chunk", "_hash", "_id", "_text") if carry else plain
    anchors = dealt.groupBy("_chunk").applyInArrow(tk.tidy(_send_anchors(window, buckets)), BLOB)
    shared = anchors.groupBy("_bucket").applyInArrow(tk.tidy(_shared_anchors), REPLY)
    windows = dealt.groupBy("_chunk").cogroup(shared.groupBy("_chunk")).applyInArrow(tk.tidy(_send_windows(window, buckets)), BLOB)
    later = windows.groupBy("_bucket").applyInArrow(tk.tidy(_later_windows), REPLY)
    further = {"_kept_text": "string"} if carry else {}
    schema = tk.with_fields(plain.select("_row") if carry else plain.select(), _id="long", _n_words="long", _n_removed="long", _kept_sha256="string", **further)
    out = plain.groupBy("_chunk").cogroup(later.groupBy("_chunk")).applyInArrow(_cut(window, bool(carry)), schema)
    head = [F.col(f"_row.`{c}`").alias(c) for c in carry] if carry else [F.col("_id").alias(id_col)]
    tail = [F.col("_kept_text").alias(f"{prefix}kept_text")] if carry else []
    return out.select(*head, *[F.col(f"_{c}").alias(f"{prefix}{c}") for c in ("n_words", "n_removed", "kept_sha256")], *tail)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS p FROM d),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p+19], ' ') ORDER BY doc_id, p) AS rn FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r WHERE rn > 1),
k AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
a AS (SELECT k.doc_id AS doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY k.p) AS kept FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.p = g.p WHERE g.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
