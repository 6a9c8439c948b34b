"""SimHash near-duplicates, linked through anchors of a covering code.

Two 64-bit fingerprints that differ in at most t bits differ in at most t // 2 bits of
one half.  On each 32-bit half the anchors are the words of the perfect [31, 26]
Hamming code with one free bit: every value lies within covering radius 1 of one.  Two
halves at distance d have a midpoint at most ceil(d / 2) from both, and its anchor is
then at most 1 + ceil(d / 2) from both; each fingerprint is therefore replicated to all
anchors within the covering radius plus that share of the threshold (2 or 17 anchors a
half at t = 4), and compared per anchor.  Distinct fingerprints take part once, however
many documents carry them.

An anchor with more than ``GROUP`` fingerprints is split into blocks, and every pair of
blocks is compared by itself.  A comparison passes on a spanning set of links, not all
pairs, which keeps components the same.

Defined cases: null and empty texts and those without words have fingerprint zero and
are linked like any other; equal rows and rows that share a doc_id are rows of their
own; a component of null doc_ids alone has a null component_id.  An empty table gives no
rows; long texts are read whole; columns but id and text take no part, whatever their
names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .components import connected
from .textkit import written

SHINGLE, SEED, THRESHOLD, GROUP = 4, 42, 4, 2048


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        count += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _shifts(reach: int) -> np.ndarray:
    """By syndrome, the changes of at most ``reach`` bits of a half that lead to an anchor; -1 fills up."""
    by: list[list[int]] = [[] for _ in range(32)]
    for n in range(reach + 1):
        for bits in itertools.combinations(range(32), n):
            syndrome = 0
            for b in bits:  # bit 0 is free, bit b > 0 is column b of the check matrix
                syndrome ^= b
            by[syndrome].append(sum(1 << b for b in bits))
    width = max(map(len, by))
    return np.array([x + [-1] * (width - len(x)) for x in by], dtype=np.int64)


_CHECKS = [sum(1 << b for b in range(32) if b >> k & 1) for k in range(5)]


def _replicas(reach: int):
    shifts = _shifts(reach)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for side in (0, 1):
                half = (fp.view(np.uint64) >> np.uint64(32 * side)).astype(np.int64) & 0xFFFFFFFF
                syndrome = sum((np.bitwise_count(half & m).astype(np.int64) & 1) << k for k, m in enumerate(_CHECKS))
                change = shifts[syndrome]
                row, col = np.nonzero(change >= 0)
                anchor = (half[row] ^ change[row, col]) | (side << 32)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[row])], names=["_anchor", "_fp"])

    return replicate


def _compare(threshold: int):
    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A spanning set of links between fingerprints of equal key (rows in the order of keys)."""
        root = np.arange(len(key))
        at, k = np.arange(len(key)), 1
        bits = fp.view(np.uint64)
        left, right = [], []
        while len(at := at[at + k < len(key)]) and len(at := at[key[at] == key[at + k]]):
            near = at[np.bitwise_count(bits[at] ^ bits[at + k]) <= threshold]
            for i in near[root[near] != root[near + k]].tolist():
                a, b = i, i + k
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                if a != b:
                    root[max(a, b)] = min(a, b)
                    left.append(i)
                    right.append(i + k)
            while len(near) and not np.array_equal(flat := root[root], root):
                root = flat
            k += 1
        return fp[left], fp[right]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, np.ndarray] | None = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
                fp = batch.column(3).to_numpy(zero_copy_only=False)
                if rest is not None:
                    keys, fp = np.concatenate((rest[0], keys)), np.concatenate((rest[1], fp))
            elif rest is None:
                return
            else:
                keys, fp = rest
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            end = len(fp) if batch is None else (change[-1] if len(change) else 0)
            rest = (keys[end:], fp[end:])
            if end:
                number = np.zeros(end, dtype=np.int64)
                number[change[change < end]] = 1
                a, b = links(np.cumsum(number), np.ascontiguousarray(fp[:end]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["_u", "_v"])

    return compare


def near_links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Links ``_u``, ``_v`` that connect all distinct fingerprints ``_fp`` at most ``threshold`` bits apart."""
    reach = 1 + -(-(threshold // 2) // 2)
    replicas = fps.select("_fp").mapInArrow(tk.tidy(_replicas(reach)), "_anchor long, _fp long")
    # counted by partial aggregates and joined back, so that a crowded anchor is split like any skewed join
    shared = replicas.groupBy("_anchor").agg(F.count("*").alias("_n")).where("_n > 1")
    # merged: Spark sizes what a function makes of the fingerprints as if it were few, and would take all shared anchors through the driver
    counted = replicas.join(shared.hint("merge"), "_anchor").select("_anchor", "_fp", "_n")
    blocks = F.ceil(F.col("_n") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("_fp"), blocks).cast("int")
    pairs = counted.select("_anchor", "_fp", own.alias("_own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other"))
    pairs = pairs.select("_anchor", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_fp")
    dealt = pairs.repartition("_anchor", "_i", "_j").sortWithinPartitions("_anchor", "_i", "_j")
    return dealt.mapInArrow(tk.tidy(_compare(threshold)), "_u long, _v long")


def add_fingerprints(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the fingerprint as a signed whole number in ``name``."""

    prints = lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))]
    return tk.extended(docs, prints, text_col, **{name: "long"})


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", fingerprint_col: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` and ``root_fingerprint`` of every row of ``docs``.

    The root is the smallest fingerprint of the component, as a signed whole number.
    ``fingerprint_col`` names a column that ``add_fingerprints`` made, if there is one;
    the columns ``carry`` come last and pass through.
    """
    if threshold > 5:
        raise ValueError("the anchors are made for thresholds up to 5")
    own = F.col(id_col).cast("long").alias("_id")
    if fingerprint_col:
        made = docs.select(own, F.col(f"`{fingerprint_col}`").alias("_fp"), *carry)
    else:
        made = written(add_fingerprints(docs.select(own, F.col(text_col).alias("_text"), *carry), "_fp", "_text").drop("_text"), "fingerprints")
    distinct = written(made.groupBy("_fp").agg(F.min("_id").alias("_first")), "distinct")
    nodes = connected(near_links(distinct, threshold))
    linked = written(distinct.join(nodes.hint("merge"), distinct["_fp"] == nodes["_node"]).select("_fp", "_root", "_first"), "linked")
    least = written(linked.groupBy("_root").agg(F.min("_first").alias("_component")), "classes")
    alone = distinct.join(linked.select("_fp").hint("merge"), "_fp", "left_anti").select("_fp", F.col("_fp").alias("_root"), F.col("_first").alias("_component"))
    of = written(linked.join(least.hint("merge"), "_root").select("_fp", "_root", "_component").unionByName(alone), "of")
    digits = F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint")
    return made.join(of.hint("merge"), "_fp").select(F.col("_id").alias(id_col), digits, F.col("_component").alias("component_id"), F.col("_root").alias("root_fingerprint"), *carry)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
