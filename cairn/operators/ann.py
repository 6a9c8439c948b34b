"""Approximate nearest vectors: an inverted file over cells of like vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.lanes import _unit, nearest, ranked
from cairn.sources.shared import written

#: Most vectors that the cells are fitted on, and most cells.
SAMPLE, CELLS = 16_384, 256
#: Vectors that are placed at once.
PLACED = 2048


def _matrix(vectors: pa.Array) -> np.ndarray:
    return _unit(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64))


def fit_cells(vectors: DataFrame, cells: int, rounds: int = 8) -> np.ndarray:
    """Centres of ``cells`` cells (spherical k-means) on the ``SAMPLE`` rows with the smallest id hash."""
    taken = vectors.orderBy(F.xxhash64("canonical_id"), "canonical_id").limit(SAMPLE).select("vector").toArrow()
    if not taken.num_rows:
        return np.zeros((0, 1))
    x = _matrix(taken["vector"].combine_chunks())
    centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        filled = np.bincount(near, minlength=len(centres)) > 0
        centres = np.where(filled[:, None], _unit(sums), centres)
    return centres


def _placed(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """Each (id, vector) once for each of its ``probes`` nearest cells."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PLACED):
                part = batch.slice(at, PLACED)
                likeness = _matrix(part.column(1)) @ centres.T
                cell = np.argpartition(-likeness, probes - 1, axis=1)[:, :probes].astype(np.int32)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, cell.size + 1, probes, dtype=np.int32)), pa.array(cell.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=["id", "vector", "cells"])

    # vectors are repeated by Spark, row by row, never in a batch
    return rows.mapInArrow(place, "id long, vector array<double>, cells array<int>").select("id", "vector", F.explode("cells").alias("cell"))


def approximate(vectors: DataFrame, queries: DataFrame, budget: int = 10, share: float = 0.65, floor: float = 0.0) -> DataFrame:
    """Cosine top-k over the cells nearest to each query (``share`` of all cells, rounded up).

    ``vectors``: canonical_id, vector; ``queries``: query_id, vector.  The share is set for
    vectors with hardly any clusters, where nine in ten neighbours need two cells in three;
    clustered ones do with far fewer.  Every vector is indexed; the cells alone come from a bounded sample.  A query is not its own neighbour;
    null vectors and ids are left out.  Cells with many vectors or queries are split into
    blocks (``lanes.nearest``), so no task holds more however skewed the cells are.
    """
    own = vectors.where("canonical_id IS NOT NULL AND vector IS NOT NULL").select(F.col("canonical_id").cast("long").alias("canonical_id"), F.col("vector").cast("array<double>").alias("vector"))
    asked = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    centres = fit_cells(own, int(min(CELLS, max(1, own.count() ** 0.5))))
    if not len(centres):
        return own.sparkSession.createDataFrame([], "query_id long, canonical_id long, raw_score double, rank int")
    probes = int(np.ceil(len(centres) * share))
    v, q = (written(_placed(d, centres, n), name) for d, n, name in ((own, 1, "cells"), (asked, probes, "probes")))
    found = nearest(v.withColumnRenamed("id", "canonical_id"), q.withColumnRenamed("id", "query_id"), budget, ("cell",), floor)
    return ranked(found.drop("cell"), budget).withColumn("raw_score", F.round("raw_score", 4))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of each query's exact neighbours that were found."""
    hit = exact.join(found.select("query_id", "canonical_id", F.lit(1).alias("_hit")), ["query_id", "canonical_id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("n_exact"), F.count("_hit").alias("n_found"), F.round(F.count("_hit") / F.count("*"), 6).alias("recall"))
