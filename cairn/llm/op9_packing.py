"""Packing of documents into sequences by minimum bin slack.

Only the histogram of piece lengths decides which lengths share a sequence: at most
``size`` numbers, whatever the documents.  Per sequence, the largest length left is
placed and a bitset of reachable sums over the other lengths left finds the fullest
combination; it is taken out as often as the counts allow.  Pieces then take the places
made for their length: a piece's number among those of its length is its number within
its part of the input plus the count of the earlier parts.

Defined cases: a null text is empty and its document holds the end id alone; null and
repeated doc_ids and equal rows are documents of their own; an empty table has no pieces;
only texts of more than ``size`` ids are cut, however long; columns but the id and the
text take no part, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .tokens import default_path, encoder

SIZE, END = 1024, 2
PIECES = "_id long, _piece int, _start long, _length int, _crc long, _part int, _nth long"


def plan_sequences(counts: np.ndarray, size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """(repetitions, [(length, times), ...]) of every kind of sequence; ``counts`` by length."""
    left = [int(c) for c in counts]
    out = []
    lengths = [n for n in range(size, 0, -1) if left[n]]
    while lengths:
        first = lengths[0]
        left[first] -= 1
        room = size - first
        used = {first: 1}
        # layers[k]: the sums reachable with the lengths seen so far, once bit 0 stands for none
        reach, came = 1, []
        full = (1 << (room + 1)) - 1
        for n in lengths:
            if n > room or not left[n]:
                continue
            most, step = min(left[n], room // n), 1
            while most > 0:  # times 1, 2, 4, ... make up any number to most
                take = min(step, most)
                new = (reach << (n * take)) & full & ~reach
                if new:
                    came.append((n, take, new))
                    reach |= new
                most -= take
                step *= 2
            if reach >> room & 1:
                break
        best = reach.bit_length() - 1
        for n, take, new in reversed(came):
            if new >> best & 1:
                used[n] = used.get(n, 0) + take
                best -= n * take
        left[first] += 1
        times = min(left[n] // m for n, m in used.items())
        for n, m in used.items():
            left[n] -= m * times
        out.append((times, sorted(used.items(), reverse=True)))
        lengths = [n for n in lengths if left[n]]
    return out


def _cut(path: str, size: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, seen = encoder(path, special=True), np.zeros(size + 1, dtype=np.int64)
        part = TaskContext.get().partitionId()
        for batch in tk.slices(batches, 1, 2 << 20):
            ids, bounds = made.encode_ended(batch.column(1), end_id)
            total = np.diff(bounds)
            pieces = -(-total // size)
            of = np.repeat(np.arange(len(total)), pieces)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            first = (total - 1) % size + 1
            start = np.where(piece == 0, 0, first[of] + (piece - 1) * size)
            length = np.where(piece == 0, first[of], size)
            # the number among equal lengths: those of earlier batches, then those before it in this one
            order = np.argsort(length, kind="stable")
            count = np.bincount(length, minlength=size + 1)
            nth = np.empty(len(of), dtype=np.int64)
            nth[order] = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            begin = bounds[:-1][of] + start
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(of)), piece, start, length, crc, np.full(len(of), part), nth]
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v).cast(t) for v, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])

    return cut


def _places(plan: list[tuple[int, list[tuple[int, int]]]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the first number of each kind of sequence, times, first sequence, offset."""
    by: dict[int, list[tuple[int, int, int, int]]] = {}
    given = [0] * (size + 1)
    first = 0
    for times, used in plan:
        offset = 0
        for n, m in used:
            by.setdefault(n, []).append((given[n], m, first, offset))
            given[n] += m * times
            offset += n * m
        first += times
    return {n: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for n, rows in by.items()}


def _assign(places: dict[int, tuple[np.ndarray, ...]]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("_length").to_numpy().astype(np.int64)
            number = batch.column("_number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                begin, times, first, at = places[int(n)]
                k = np.searchsorted(begin, number[own], side="right") - 1
                nth = number[own] - begin[k]
                sequence[own] = first[k] + nth // times[k]
                offset[own] = at[k] + nth % times[k] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_piece", "_start", "_length", "_crc")), pa.array(sequence), pa.array(offset)], names=["_id", "_piece", "_start", "_length", "_crc", "_sequence", "_offset"])

    return assign


def pack_documents(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, end_id: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset``.

    Returns ``id_col``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    pieces = tk.written(rows.mapInArrow(tk.tidy(_cut(tokenizer or default_path(), size, end_id), encodes=True), PIECES), "pieces")
    counts = tk.written(pieces.groupBy("_part", "_length").agg(F.count("*").alias("_n")), "lengths")
    histogram = np.zeros(size + 1, dtype=np.int64)
    for n, c in counts.groupBy("_length").agg(F.sum("_n")).collect():  # at most ``size`` rows
        histogram[n] = c
    places = _places(plan_sequences(histogram, size), size)
    before = counts.selectExpr("_part", "_length", "sum(_n) OVER (PARTITION BY _length ORDER BY _part) - _n AS _before")
    # ``before`` grows with the parts: it is joined by its keys, not broadcast
    numbered = pieces.join(before.hint("merge"), ["_part", "_length"]).select("_id", "_piece", "_start", "_length", "_crc", (F.col("_before") + F.col("_nth")).alias("_number"))
    schema = "_id long, _piece int, _start long, _length int, _crc long, _sequence long, _offset long"
    out = numbered.mapInArrow(tk.tidy(_assign(places)), schema)
    return out.select(F.col("_id").alias(id_col), F.col("_piece").alias("piece"), F.col("_start").alias("start"), F.col("_length").cast("long").alias("length"), F.col("_crc").alias("ids_crc32"), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
