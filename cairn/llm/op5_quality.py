"""Quality by a regularised quadratic discriminant over document statistics.

Statistics of a text (lengths, shares of symbols, separators, digits, capitals, stop
words, repeated words and lines) are put on a log or root scale.  Each class keeps its
mean and a covariance shrunk towards that of all labelled rows together (within and
between classes: ``POOL``, more for small classes), then towards its diagonal
(``SHRINK``), with a share of the common variances added (``FLOOR``).  The score is the
sigmoid of ``SOFTEN`` times the difference of the two log densities, each a Mahalanobis
distance through the class's Cholesky factor, which is computed once; ``SOFTEN`` makes
scores less extreme and moves none over 0.5.

Class moments come from all labelled training rows, as sums that partial aggregation
adds up; the driver sees one row a class.  The statistics are computed once a text and
kept in a written table.

Defined cases: null and empty texts have all statistics zero; null labels are not learnt
from; a doc_id with several labels counts as good if one is; without labels of both
kinds every score is the share of good rows (0.5 of none).  Equal rows and repeated or
null doc_ids are rows of their own; an empty table gives no rows; long texts are read
whole; columns but id and text take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk
from .op1_quality_rules import STOP_WORDS

SHRINK, POOL, FLOOR, SOFTEN = 0.05, 0.15, 0.02, 0.25
FEATURES = ("words", "word_length", "symbols", "pipes", "digits", "capitals", "stops", "distinct", "lines", "line_repeats", "stops_per_line", "commas", "other_marks", "non_ascii")
_LINES = tk._class([0x0A])


def _flags(characters: str | bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(characters.encode() if isinstance(characters, str) else characters)] = 1
    return out


_KINDS = {
    "symbols": _flags("#*$%&<>@^~_=+{}[]\\"),
    "pipes": _flags("|"),
    "digits": _flags("0123456789"),
    "capitals": _flags(bytes(range(65, 91))),
    "commas": _flags(".,"),
    "other_marks": _flags("!?;:()\"'/-"),
    "non_ascii": _flags(bytes(range(128, 192))),
    "word_bytes": tk.SPACED.astype(np.int64),
}
_STOPS = np.unique(tk.hash_words([" ".join(w for words in STOP_WORDS.values() for w in words).encode()], tk.ALNUM, True).hashes)


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of ``FEATURES`` for each text, on their transformed scales."""
    n = len(texts)
    counts = {k: np.zeros(n) for k in _KINDS}
    for i, text in enumerate(texts):
        each = np.bincount(np.frombuffer(text or b"", dtype=np.uint8), minlength=256)
        for k, flags in _KINDS.items():
            counts[k][i] = each @ flags
    words, plain, lines = tk.hash_words(texts, tk.SPACED, False), tk.hash_words(texts, tk.ALNUM, True), tk.hash_words(texts, _LINES, False)
    n_words, n_lines = np.diff(words.bounds).astype(float), np.diff(lines.bounds).astype(float)
    per = lambda x, of: x / np.maximum(of, 1)
    place = np.minimum(np.searchsorted(_STOPS, plain.hashes), len(_STOPS) - 1)
    stops = tk.sub_sums((_STOPS[place] == plain.hashes).astype(np.int64), plain.bounds)
    distinct = lambda w: np.array([len(np.unique(w.hashes[a:b])) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)], dtype=float)
    root, share = np.sqrt, lambda k: np.sqrt(per(counts[k], n_words))
    columns = [
        np.log1p(n_words),
        np.log1p(per(counts["word_bytes"], n_words)),
        share("symbols"),
        share("pipes"),
        share("digits"),
        share("capitals"),
        root(per(stops, n_words)),
        np.log1p(n_words) - np.log1p(distinct(words)),
        np.log1p(n_lines),
        root(per(n_lines - distinct(lines), n_lines)),
        np.log1p(per(stops, n_lines)),
        share("commas"),
        share("other_marks"),
        share("non_ascii"),
    ]
    return np.stack(columns, axis=1)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.slices(batches, 1):
        made = statistics(tk.as_bytes(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["_id", "_x"])


class Discriminant:
    """Two Gaussians with cached Cholesky factors, from (count, sums, sums of products)."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]) -> None:
        total = sum(m[0] for m in moments.values())
        self.share = moments[1][0] / total if total and 1 in moments else 0.5 if not total else 0.0
        self.classes = []
        if len(moments) < 2:
            return
        means = {k: s / n for k, (n, s, _) in moments.items()}
        covariances = {k: p / n - np.outer(means[k], means[k]) for k, (n, _, p) in moments.items()}
        pooled = sum(moments[k][0] * c for k, c in covariances.items()) / total
        centre = sum(moments[k][0] * m for k, m in means.items()) / total
        every = pooled + sum(moments[k][0] * np.outer(m - centre, m - centre) for k, m in means.items()) / total
        scale = np.maximum(np.diag(every), 1e-8)
        for k in (0, 1):
            n, weight = moments[k][0], POOL + (1 - POOL) * len(scale) / (len(scale) + moments[k][0])
            c = (1 - weight) * covariances[k] + weight * every
            c = (1 - SHRINK) * c + SHRINK * np.diag(np.diag(c)) + FLOOR * np.diag(scale)
            factor = np.linalg.cholesky(c)
            self.classes.append((means[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n / total)))

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        bad, good = (prior - log_det - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) for mean, inverse, log_det, prior in self.classes)
        return 1 / (1 + np.exp(-np.clip(SOFTEN * (good - bad), -40, 40)))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id`` and ``_x``, the statistics of every row, in a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return tk.written(rows.mapInArrow(tk.tidy(_stats), "_id long, _x array<double>"), "statistics")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(FEATURES)
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        x = np.hstack([np.ones((batch.num_rows, 1)), batch.column(1).flatten().to_numpy().reshape(-1, d)])
        label = batch.column(0).to_numpy()
        for k in np.unique(label):
            own = x[label == k]
            held[int(k)] = held.get(int(k), 0) + own.T @ own
    names = [(k, i, v) for k, m in held.items() for i, v in enumerate(m.ravel().tolist())]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in names], pa.int32()), pa.array([r[1] for r in names], pa.int32()), pa.array([r[2] for r in names], pa.float64())], names=["_label", "_place", "_value"])


def train(stats: DataFrame, labels: DataFrame, where: Column, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant:
    """Fit on all labelled rows that ``where`` (over ``labels``) selects."""
    known = labels.where(where & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")).where("_label IN (0, 1)")
    sums = stats.join(known, "_id").select("_label", "_x").mapInArrow(tk.tidy(_moments), "_label int, _place int, _value double").groupBy("_label", "_place").agg(F.sum("_value").alias("_value"))
    d, tables = len(FEATURES) + 1, {}
    for label, place, value in sums.collect():  # (d + 1) squared rows a class
        tables.setdefault(label, np.zeros(d * d))[place] = value
    parts = {k: t.reshape(d, d) for k, t in tables.items()}
    return Discriminant({k: (t[0, 0], t[0, 1:], t[1:, 1:]) for k, t in parts.items()})


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``_id`` and ``score`` of every row of ``describe``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x), pa.float64())], names=["_id", "score"])

    return stats.select("_id", "_x").mapInArrow(tk.tidy(run), "_id long, score double")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    stats = describe(docs)
    held_out = lambda c: tk.crc_remainder(F.col(c), 3) == 1
    model = train(stats, labels, ~held_out("doc_id"))
    rows = score(stats, model)
    return rows.select(F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
