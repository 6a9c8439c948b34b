"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words of letters and digits, hashed to 2**20
places.  The score is sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>): the pair terms
learn that two terms together mean more than both alone, which additive weights miss.

Training takes a sample of about ``SAMPLE`` labelled rows, drawn by a hash of the id, with
all terms of each.  Of the terms that occur in at least ``LEAST`` of the rows, either all take
part, also those that say nothing by themselves but can in pairs, or those alone whose
presence depends on the label (chi-square of ``CHI`` or more): whichever gives the lower
loss on a fifth of the sample when fitted on the rest.  Weights are fitted by steps of
``BATCH`` rows with rates that fall term by term.  Every whole text is scored, in one
pass without a shuffle.

Defined cases: null and empty texts have no terms and get the score of the bias; labels
that are null are not learnt from; a doc_id with several labels counts as toxic if one
is; without labels of both kinds every score is the share of toxic rows (0.5 of none).
Equal rows and repeated or null doc_ids are rows of their own; an empty table gives no
rows; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

BITS, SAMPLE, LEAST, CHI, FACTORS, EPOCHS, BATCH, RATE, DECAY = 20, 12_000, 5, 10.0, 8, 12, 128, 0.1, 1e-4


def _places(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    words = tk.hash_words(texts, tk.ALNUM, True)
    return (words.hashes >> np.uint64(64 - BITS)).astype(np.int64), words.bounds


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.slices(batches, 1):
        places, bounds = _places(tk.as_bytes(batch.column(1)))
        sets = [np.unique(places[a:b]).astype(np.uint32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.binary())], names=["_id", "_label", "_terms"])


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64), np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))


class Machine:
    """Bias, linear weights and factors of the terms in use; row 0 stands for all others."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray) -> None:
        self.slot = np.zeros(1 << BITS, dtype=np.int32)
        rate = float(labels.mean()) if len(labels) else 0.5
        self.bias = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
        self.linear, self.factors = np.zeros(1), np.zeros((1, FACTORS))
        if len(labels) == 0 or rate in (0.0, 1.0):
            return
        flat = np.concatenate(sets)
        every = np.bincount(flat, minlength=1 << BITS).astype(float)
        toxic = np.bincount(flat, weights=labels[np.repeat(np.arange(len(sets)), [len(x) for x in sets])], minlength=1 << BITS)
        n, t = len(labels), labels.sum()
        expected = every * t / n
        spread = np.maximum(expected * (1 - t / n) * (1 - every / n), 1e-9)
        enough = every >= LEAST
        choices = [np.flatnonzero(enough & ((toxic - expected) ** 2 / spread >= CHI)), np.flatnonzero(enough)]
        fifth, losses = np.arange(n) % 5 == 4, []
        for used in choices:
            rows = self._use(used, sets)
            self._fit([r for r, x in zip(rows, fifth, strict=True) if not x], labels[~fifth], len(used) + 1)
            z, _ = self._forward(*_flat([r for r, x in zip(rows, fifth, strict=True) if x]))
            losses.append(np.logaddexp(0, np.where(labels[fifth] > 0, -z, z)).mean() if fifth.any() else 0.0)
        used = choices[int(losses[1] < losses[0])]
        self._fit(self._use(used, sets), labels, len(used) + 1)

    def _use(self, used: np.ndarray, sets: list[np.ndarray]) -> list[np.ndarray]:
        self.slot[:] = 0
        self.slot[used] = np.arange(1, len(used) + 1)
        return [x[x > 0] for x in (self.slot[s] for s in sets)]

    def _fit(self, rows: list[np.ndarray], labels: np.ndarray, size: int) -> None:
        rng = np.random.default_rng(7)
        self.bias = float(np.log(max(labels.mean(), 1e-6) / max(1 - labels.mean(), 1e-6)))
        self.linear, self.factors = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
        self.factors[0] = 0
        held = [1e-6, np.full(size, 1e-6), np.full((size, FACTORS), 1e-6)]
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                terms, bounds = _flat([rows[i] for i in own])
                of = np.repeat(np.arange(len(own)), np.diff(bounds))
                z, sums = self._forward(terms, bounds)
                error = (1 / (1 + np.exp(-z)) - labels[own]) / len(own)
                touched, slot = np.unique(terms, return_inverse=True)
                # sums by term of each text's error, and of it times the text's sum of factors
                push = np.stack([np.bincount(slot, weights=w) for w in (error[of], *(error[of] * sums[of, k] for k in range(FACTORS)))], axis=1)
                held[0] += error.sum() ** 2
                self.bias -= float(RATE * error.sum() / np.sqrt(held[0]))
                for grad, seen, value in ((push[:, 0], held[1], self.linear), (push[:, 1:] - push[:, :1] * self.factors[touched], held[2], self.factors)):
                    g = grad + DECAY * value[touched]
                    seen[touched] += g**2
                    value[touched] -= RATE * g / np.sqrt(seen[touched])

    def _forward(self, terms: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.factors[terms]
        total = np.zeros((len(terms) + 1, FACTORS))
        np.cumsum(v, axis=0, out=total[1:])
        sums = total[bounds[1:]] - total[bounds[:-1]]
        z = self.bias + tk.sub_sums(self.linear[terms], bounds)
        return z + 0.5 * ((sums**2).sum(axis=1) - tk.sub_sums((v**2).sum(axis=1), bounds)), sums

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        places, bounds = _places(texts)
        slots = self.slot[places].astype(np.int64)
        use = slots > 0
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))[use]
        pairs = np.unique(doc * len(self.linear) + slots[use])  # presence: each term once a text
        doc, terms = pairs // len(self.linear), pairs % len(self.linear)
        z, _ = self._forward(terms, np.searchsorted(doc, np.arange(len(texts) + 1)))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, where: Column, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on a bounded sample of the labelled rows that ``where`` (over ``labels``) selects."""
    known = labels.where(where & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label")).where("_label IS NOT NULL")
    share = min(1.0, sample / max(1, known.count()))
    # distinct ids, so that the draw holds about ``sample`` rows of 12 bytes at most
    drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), "_id").select("_id", "_text", "_label")
    made = rows.mapInArrow(tk.tidy(_distinct), "_id long, _label int, _terms binary")
    got = made.groupBy("_id").agg(F.max("_label"), F.max("_terms")).drop("_id").collect()
    got.sort()
    return Machine([np.frombuffer(r[1], np.uint32).astype(np.int64) for r in got], np.array([r[0] for r in got], dtype=float))


def score(docs: DataFrame, model: Machine, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``name``.

    Other columns pass through; one that is called ``name`` already is replaced: give
    another name to keep it.
    """

    return tk.extended(docs.drop(name), lambda texts: [pa.array(model.scores(texts), pa.float64())], text_col, **{name: "double"})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = tk.crc_remainder(F.col("doc_id"), 4) == 2
    model = train(docs, labels, ~held_out)
    rows = score(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
