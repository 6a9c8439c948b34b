"""Evidence chains: from each of a query's first candidates, grow a chain whose next member fits query and chain."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Candidates of a query that take part, chains, and the share of the last score that the next must reach (fixed values).
POOL, CHAINS, SHARE = 20, 3, 0.5


def grow(cosine: np.ndarray, vectors: np.ndarray | None, ids: list, chains: int, share: float | None) -> list[tuple[int, list[tuple[int, float]]]]:
    """(anchor, [(member, score), ...]) of each chain; candidates are in the order of retrieval.

    The next member has the highest score: its cosine to the query, times its cosine to
    the chain so far (the mean direction of its members) if there are ``vectors``.  Equals
    go by retrieval rank.  A chain ends when the best score is less than ``share`` of the
    score before it; null lets it take all.
    """
    out = []
    for anchor in range(min(chains, len(ids))):
        chain, last = [(anchor, float(cosine[anchor]))], float(cosine[anchor])
        left = [k for k in range(len(ids)) if k != anchor]
        context = None if vectors is None else vectors[anchor].copy()
        while left:
            score = cosine[left]
            if context is not None:
                size = np.linalg.norm(context)
                score = score * (vectors[left] @ context / size if size else 0.0)
            best = int(np.argmax(score))  # the first of equals, so the one of the best rank
            if share is not None and score[best] < share * last:
                break
            last, k = float(score[best]), left.pop(best)
            chain.append((k, last))
            if context is not None:
                context += vectors[k]
        out.append((anchor, chain))
    return sorted(out, key=lambda c: (-cosine[c[0]], c[0]))


def organize(candidates: DataFrame, queries: DataFrame, pool: int = POOL, chains: int = CHAINS, share: float | None = SHARE, with_context: bool = True, once: bool = True) -> DataFrame:
    """Chains of each query over its first ``pool`` candidates.

    ``candidates``: query_id, canonical_id, rank, vector; ``queries``: query_id, vector.
    The first ``chains`` candidates are anchors; chains are numbered by their anchor's
    cosine to the query.  ``shown``: whether a member is rendered in its chain; with
    ``once`` a member of several chains is rendered in the first of them only.  Candidates
    without a vector, or of another length than the query's, have the cosine 0; queries
    without a vector have no chains.
    """
    first = candidates.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "canonical_id"))).where(F.col("_k") <= pool)
    asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("_q"))
    rows = first.select("query_id", "canonical_id", "_k", F.col("vector").cast("array<double>").alias("_v")).join(asked, "query_id")
    kinds = [candidates.schema[c].dataType for c in ("query_id", "canonical_id")]
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("chain", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("canonical_id", kinds[1]), T.StructField("score", T.DoubleType()), T.StructField("shown", T.BooleanType())])

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_k")
        query = np.asarray(group["_q"].iloc[0], dtype=np.float64)
        unit = lambda x: x / n if (n := np.linalg.norm(x)) else x
        vectors = np.stack([unit(np.asarray(v, dtype=np.float64)) if v is not None and len(v) == len(query) else np.zeros(len(query)) for v in group["_v"]])
        ids = group["canonical_id"].tolist()
        found, seen, out = grow(vectors @ unit(query), vectors if with_context else None, ids, chains, share), set(), []
        for number, (_, chain) in enumerate(found, 1):
            for place, (k, score) in enumerate(chain, 1):
                out.append((group["query_id"].iloc[0], number, place, ids[k], round(score, 6), not (once and k in seen)))
                seen.add(k)
        return pd.DataFrame(out, columns=schema.names)

    return rows.groupBy("query_id").applyInPandas(walk, schema)
