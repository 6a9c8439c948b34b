"""The vector plane: a dense lane over a projection that can lag behind its canonical rows.

Nearest vectors are sought in the projection alone, by scope; each is then held against
its canonical row.  What is stale, of another model, of another length or out of scope
does not count, and queries left with too few take part in another round with twice the
fetch.  A query that has no usable vector gets a degraded lane, not a failure.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import lanes
from cairn.sources.shared import written

#: Most vectors fetched of a scope for a query, and times the budget that are fetched first.
MOST, OVERFETCH = 2000, 4


class Plane(NamedTuple):
    """What a dense lane needs: see ``plane``; ``queries`` has query_id, model and vector."""

    projection: DataFrame
    memories: DataFrame
    queries: DataFrame
    dimensions: int


def fenced(found: DataFrame, projection: DataFrame, memories: DataFrame) -> DataFrame:
    """Of ``found`` (query_id, scope_key, model, canonical_id, raw_score) what agrees with its canonical row.

    ``projection``: canonical_id, resource_id, scope_key, model, version, digest;
    ``memories`` (those that may be recalled): canonical_id, scope_key, version, digest,
    recorded_from.
    """
    keys = ["canonical_id", "scope_key"]
    current = memories.select(*keys, F.col("version").alias("_v"), F.col("digest").alias("_d"), "recorded_from")
    rows = found.join(projection.select(*keys, "model", "resource_id", "version", "digest"), [*keys, "model"]).join(current, keys)
    same = (F.col("resource_id") == F.col("canonical_id")) & (F.col("version") == F.col("_v")) & (F.col("digest") == F.col("_d"))
    return rows.where(same).select("query_id", "scope_key", "canonical_id", "raw_score", "recorded_from")


def statuses(queries: DataFrame, dimensions: int) -> DataFrame:
    """``reason`` for which a query's lane is degraded, or null."""
    no_vector = F.col("vector").isNull()
    reason = F.when(no_vector, "query_embedding_unavailable").when(F.size("vector") != dimensions, "vector_dimension_mismatch")
    return queries.select("query_id", reason.alias("reason"))


def plane(projection: DataFrame, memories: DataFrame, queries: DataFrame, dimensions: int, budget: int = 32, floor: float = 0.0, overfetch: int = OVERFETCH, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Candidates of each query, and a row of what its lane did.

    ``projection``: canonical_id, resource_id, scope_key, model, dimensions, version,
    digest, vector; ``memories``: see ``fenced``; ``queries``: query_id, scope_keys
    (array), model, vector.

    Candidates: query_id, canonical_id, raw_score, rank, by score, then the latest
    recorded, then id; a memory found in several scopes counts with its best score.
    Lanes: query_id, degraded, reason, examined (vectors fetched), truncated (a scope may
    have more).  A query's scope is done when it has ``budget`` valid vectors, when the
    projection has no more, or at ``most`` fetched; only the others take part in the next
    round, with twice the fetch.
    """
    usable = statuses(queries, dimensions).where("reason IS NULL").select("query_id")
    index = projection.where((F.col("dimensions") == dimensions) & (F.size("vector") == dimensions))
    pending = queries.join(usable, "query_id", "left_semi").select("query_id", F.explode(F.array_distinct("scope_keys")).alias("scope_key"), "model", "vector")
    fetch, valid, counted = min(most, budget * overfetch), [], []
    while True:
        found = written(lanes.nearest(index, pending, fetch, ("scope_key", "model"), self_too=True), "fetched")
        good = written(fenced(found, index, memories), "fenced")
        key = ["query_id", "scope_key"]
        counts = found.groupBy(key).agg(F.count("*").alias("examined")).join(good.groupBy(key).agg(F.count("*").alias("_good")), key, "left")
        judged = counts.withColumn("truncated", F.col("examined") >= fetch)
        short = F.col("truncated") & (F.coalesce("_good", F.lit(0)) < budget) & F.lit(fetch < most)
        judged = written(judged.select(*key, "examined", "truncated", short.alias("_short")), "judged")
        over = judged.where("NOT _short")
        valid.append(good.join(over, key, "left_semi"))
        counted.append(judged.select("query_id", "examined", F.col("truncated") & ~F.col("_short")))
        pending = written(pending.join(judged.where("_short"), key, "left_semi"), "pending")
        if pending.isEmpty():
            break
        fetch = min(most, fetch * 2)
    rows, done = valid[0], counted[0].toDF("query_id", "examined", "truncated")
    for more, count in zip(valid[1:], counted[1:], strict=True):
        rows, done = rows.unionByName(more), done.union(count)
    best = rows.where(F.col("raw_score") >= floor).groupBy("query_id", "canonical_id").agg(F.max("raw_score").alias("raw_score"), F.max("recorded_from").alias("_at"))
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), F.desc("_at"), "canonical_id")
    ranked = best.withColumn("rank", F.row_number().over(order))
    over_budget = ranked.groupBy("query_id").agg((F.max("rank") > budget).alias("_over"))
    lane = done.groupBy("query_id").agg(F.sum("examined").alias("examined"), F.bool_or("truncated").alias("truncated")).join(over_budget, "query_id", "left")
    status = statuses(queries, dimensions).join(lane, "query_id", "left").select(
        "query_id", F.col("reason").isNotNull().alias("degraded"), "reason", F.coalesce("examined", F.lit(0)).alias("examined"), (F.coalesce("truncated", F.lit(False)) | F.coalesce("_over", F.lit(False))).alias("truncated")
    )
    return ranked.where(F.col("rank") <= budget).select("query_id", "canonical_id", F.round("raw_score", 6).alias("raw_score"), "rank"), status
