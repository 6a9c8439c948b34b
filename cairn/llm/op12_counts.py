"""Token counts of every prefix of every text, kept so that questions need no encoding.

``write_prefixes`` stores, for each document, by how much the exact token count of a
prefix changes with each further character (``pieces.PrefixCounts``: dynamic programming
over prefixes).  A count can fall, as a character can join several tokens to one.  The
changes are small numbers that compress well; every 4096th character has its count beside
them, so that a question about one place reads one stretch.  ``totals``, ``count_at`` and
``longest_prefix`` answer from the stored table alone.

Defined cases: null and empty texts have no tokens, nor has the empty prefix of any text;
a text longer than a batch is one value of its own.  Equal rows, repeated and null ids are
rows of their own; an empty table gives no rows; columns but id and text take no part,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .pieces import default_path, flat, prefix_counts, spaced

LIMIT = 4096
#: Characters between stored counts.
EVERY = 4096
PREFIXES = "_id long, n_bytes long, n_chars long, marks array<long>, steps array<binary>"


def _prefixes(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, press = prefix_counts(path), zstandard.ZstdCompressor(level=1)
        for batch in tk.slices(batches, 1, 2 << 20):
            texts = spaced(batch.column(1))
            steps, bounds = made.encode(texts)
            _, ends = flat(texts)
            marks, packed, chars = [], [], np.maximum(np.diff(bounds) - 1, 0)
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = steps[a:b].astype(np.int64)
                if len(own):  # the space in front counts with the first character
                    own[1] += own[0]
                    own = own[1:]
                counts = np.cumsum(own)
                marks.append(counts[EVERY - 1 :: EVERY].tolist())
                packed.append([press.compress(own[k : k + EVERY].astype(np.int8 if abs(own[k : k + EVERY]).max() < 128 else np.int16).tobytes()) for k in range(0, len(own), EVERY)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.maximum(np.diff(ends) - 1, 0)), pa.array(chars), pa.array(marks, pa.list_(pa.int64())), pa.array(packed, pa.list_(pa.binary()))],
                names=[f.split()[0] for f in PREFIXES.split(", ")],
            )

    return count


def write_prefixes(docs: DataFrame, path: str, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """``_id``, ``n_bytes``, ``n_chars`` and the changes of the count of every text, written to ``path``."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows.mapInArrow(tk.tidy(_prefixes(model or default_path()), encodes=True), PREFIXES).write.option("compression", "none").parquet(path)


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREFIXES).parquet(path)


def _stretch(packed: bytes, chars: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    return np.frombuffer(raw, np.int8 if len(raw) == chars else np.int16)


def _counts(marks: list[int], packed: list[bytes], chars: int, k: int) -> np.ndarray:
    """Counts of the prefixes that end in the stretch ``k``."""
    return np.cumsum(_stretch(packed[k], min(EVERY, chars - k * EVERY)), dtype=np.int64) + (marks[k - 1] if k else 0)


def _answer(chars: int, marks: list[int], packed: list[bytes], at: int | None, budget: int | None) -> tuple[int, int]:
    """The count at ``at`` characters (None: all), and the longest prefix within ``budget`` tokens."""
    at = chars if at is None else max(0, min(at, chars))
    count = int(_counts(marks, packed, chars, (at - 1) // EVERY)[(at - 1) % EVERY]) if at else 0
    if budget is None:
        return count, 0
    # from the end: the first stretch that has a prefix within the budget has the longest one
    for k in range(len(packed) - 1, -1, -1):
        fits = np.flatnonzero(_counts(marks, packed, chars, k) <= budget)
        if len(fits):
            return count, k * EVERY + int(fits[-1]) + 1
    return count, 0


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chars, at, budget = (batch.column(c).to_pylist() for c in ("n_chars", "_at", "_budget"))
        marks, packed = batch.column("marks").to_pylist(), batch.column("steps").to_pylist()
        out = [_answer(*row) for row in zip(chars, marks, packed, at, budget, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("n_bytes"), batch.column("n_chars"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["_id", "n_bytes", "n_chars", "n_tokens", "fit_chars"])


def _asked(prefixes: DataFrame, at: Column, budget: Column, id_col: str) -> DataFrame:
    rows = prefixes.select("*", at.cast("long").alias("_at"), budget.cast("long").alias("_budget"))
    return rows.mapInArrow(tk.tidy(_answers), "_id long, n_bytes long, n_chars long, n_tokens long, fit_chars long").withColumnRenamed("_id", id_col)


def totals(prefixes: DataFrame, limit: int = LIMIT, id_col: str = "doc_id") -> DataFrame:
    """``n_tokens`` of whole texts, ``over_limit``, and ``fit_chars``: the characters of the longest prefix of at most ``limit`` tokens."""
    return _asked(prefixes, F.lit(None), F.lit(limit), id_col).withColumn("over_limit", F.col("n_tokens") > limit)


def count_at(prefixes: DataFrame, chars: Column, id_col: str = "doc_id") -> DataFrame:
    """``n_tokens`` of the first ``chars`` characters of each text; ``chars`` is of the columns of ``prefixes``."""
    return _asked(prefixes, chars, F.lit(None), id_col).drop("fit_chars")


def longest_prefix(prefixes: DataFrame, budget: Column, id_col: str = "doc_id") -> DataFrame:
    """``fit_chars``, the characters of the longest prefix of at most ``budget`` tokens."""
    return _asked(prefixes, F.lit(None), budget, id_col)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tk.table_path(spark, "prefixes")
    write_prefixes(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return totals(read_prefixes(spark, path)).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
