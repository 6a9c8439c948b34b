"""Language identification with a string kernel.

The kernel of two texts is the share of byte n-grams of one to three bytes that both
hold (presence, not counts; letters lower-cased, other ASCII taken as one blank), as
k(x, z) = |G(x) & G(z)| / sqrt(|G(x)| |G(z)|), with G hashed to ``DIMENSIONS`` places.
Landmarks of every language give the Nyström features, and kernel ridge regression of
one language against the rest is solved in them.  A batch is scored by two matrix
products: presence by landmarks, and kernel values by weights.

Training takes a sample of about ``PER_LANGUAGE`` documents of each language, drawn by a
hash of the row; as bits these are 1 kB a document.  Every whole text is scored.

Defined cases: texts that are null or hold no letter are ``und`` with score 0; so is
every text if there is nothing to learn from.  Rows with a null language are not learnt
from.  Equal rows and repeated or null doc_ids are rows of their own.  An empty table
gives no rows.  Long texts are read in blocks, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit as tk

DIMENSIONS, PER_LANGUAGE, LANDMARKS, RIDGE, SHARPNESS = 8192, 400, 48, 1e-2, 6.0
_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or (not text.isascii() and any(c.isalpha() for c in text.decode())))


def presence(texts: list[bytes | None]) -> np.ndarray:
    """One row of 0 and 1 for each text."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    for i, text in enumerate(texts):
        for at in range(0, len(text or b""), tk.BLOCK):  # blocks share their last two bytes
            b = _FOLD[np.frombuffer(text[at : at + tk.BLOCK + 2], dtype=np.uint8)].astype(np.uint32)
            out[i, b] = 1
            for codes in (b[:-1] << 8 | b[1:], b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else (b[:-1] << 8 | b[1:],):
                out[i, (codes * np.uint32(2654435761)) >> np.uint32(19)] = 1
    return out


class Kernel:
    """Trained weights; small enough for a closure, whatever the corpus."""

    def __init__(self, rows: np.ndarray, labels: list[str]) -> None:
        self.names = sorted(set(labels))
        y = np.array([self.names.index(x) for x in labels])
        pick = np.concatenate([np.flatnonzero(y == k)[:LANDMARKS] for k in range(len(self.names))])
        self.landmarks = rows[pick]
        self.sizes = np.sqrt(self.landmarks.sum(axis=1))
        among = self.kernel(self.landmarks)
        values, vectors = np.linalg.eigh(among)
        good = values > 1e-5 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        features = np.hstack([self.kernel(rows) @ root, np.ones((len(rows), 1))])
        weight = 1.0 / np.bincount(y)[y]  # each language counts the same
        target = np.where(y[:, None] == np.arange(len(self.names)), 1.0, -1.0)
        gram = (features * weight[:, None]).T @ features + RIDGE / 10 * np.diag([1.0] * root.shape[1] + [1e-6])
        solved = np.linalg.solve(gram, (features * weight[:, None]).T @ target)
        self.weights, self.bias = root @ solved[:-1], solved[-1]

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        size = np.maximum(np.sqrt(rows.sum(axis=1)), 1e-9)
        return (rows @ self.landmarks.T) / size[:, None] / self.sizes

    def decide(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        value = SHARPNESS * (self.kernel(rows) @ self.weights + self.bias)
        e = np.exp(value - value.max(axis=1, keepdims=True))
        best = value.argmax(axis=1)
        return best, (e / e.sum(axis=1, keepdims=True))[np.arange(len(best)), best]


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tk.slices(batches, 1, 1 << 20):
        bits = np.packbits(presence(tk.as_bytes(batch.column(1))).astype(bool), axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in bits], pa.binary())], names=["_lang", "_bits"])


def train(docs: DataFrame, where: Column, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> Kernel | None:
    """Fit on a bounded sample of the rows that ``where`` selects."""
    rows = docs.where(where & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_draw"))
    counts = dict(rows.groupBy("_lang").count().collect())  # a row for each language
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])[F.col("_lang")]
    drawn = rows.where(F.pmod("_draw", F.lit(1 << 30)) < share * (1 << 30)).select("_lang", "_text")
    got = drawn.mapInArrow(tk.tidy(_bits), "_lang string, _bits binary").distinct().collect()  # equal rows count once
    if not got:
        return None
    # the same order however rows arrive, and by a hash, so that landmarks are of all lengths
    got.sort(key=lambda r: (r[0], xxhash.xxh64_intdigest(r[1], 0)))
    bits = np.unpackbits(np.frombuffer(b"".join(r[1] for r in got), np.uint8).reshape(len(got), -1), axis=1).astype(np.float32)
    return Kernel(bits, [r[0] for r in got])


def identify(docs: DataFrame, model: Kernel | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score.

    Other columns pass through; a column that has one of the new names already is
    replaced: give other names to keep it.
    """

    def score(every: list[bytes | None]) -> list[pa.Array]:
        names, scores = [], []
        for a in range(0, len(every), 512):
            texts = every[a : a + 512]
            letters = [has_letter(t) for t in texts]
            if model is None:
                letters = [False] * len(texts)
                best, sure = np.zeros(len(texts), int), np.zeros(len(texts))
            else:
                best, sure = model.decide(presence(texts))
            names += [model.names[k] if ok else "und" for k, ok in zip(best.tolist(), letters, strict=True)]
            scores += [x if ok else 0.0 for x, ok in zip(sure.tolist(), letters, strict=True)]
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

    return tk.extended(docs.drop(lang_name, score_name), score, text_col, 1 << 20, **{lang_name: "string", score_name: "double"})


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text holds a letter: those that a trained model does not call ``und``."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tk.slices(batches, at, 1 << 20):
            yield batch.filter(pa.array([has_letter(t) for t in tk.as_bytes(batch.column(at))], pa.bool_()))

    at, plain = docs.columns.index(text_col), tk.numbered(docs)
    return plain.mapInArrow(tk.tidy(keep), plain.schema).toDF(*docs.columns)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = tk.crc_remainder(F.col("doc_id"), 4) == 2
    model = train(docs, ~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")
