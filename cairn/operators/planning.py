"""Retrieval plans as columns: a query's intent, its lanes' budgets and weights, hops and token budgets."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most characters of a query text that are looked at (fixed value).
QUERY_CHARS = 8192
UUID = r"^(?:urn:)?(?:uuid:)?[{}]*(?:-*[0-9a-fA-F]){32}-*[{}]*$"
DIGEST = r"^[0-9a-fA-F]{64}$"
CODE = r"[/\\]|::|\btest_[A-Za-z0-9_]+\b|\bSQLSTATE\b|\b[0-9a-fA-F]{7,40}\b"
LANES = ("exact", "lexical", "fuzzy", "dense", "temporal", "graph")


class Purpose(NamedTuple):
    """Lane weights in the order of ``LANES``, hops over the graph, and the tokens of a bundle (None: no bound)."""

    weights: tuple[float, ...]
    hops: int
    tokens: int | None
    diversify: bool


#: Plans by purpose (fixed values).
PURPOSES = {
    "interactive_recall": Purpose((5.0, 3.0, 1.0, 4.0, 2.0, 0.5), 1, None, False),
    "task_bootstrap": Purpose((6.0, 3.0, 1.0, 3.0, 2.0, 1.5), 2, 2048, True),
    "handoff_recovery": Purpose((5.0, 3.0, 1.0, 4.0, 2.0, 1.5), 2, 2048, False),
    "planning": Purpose((5.0, 3.0, 1.0, 4.0, 2.0, 1.5), 2, 4096, True),
    "conflict_review": Purpose((5.0, 3.0, 1.0, 4.0, 2.0, 2.5), 2, 4096, False),
    "historical_audit": Purpose((5.0, 4.0, 0.75, 2.0, 4.0, 1.25), 1, None, False),
    "repository_orientation": Purpose((5.0, 3.0, 1.0, 4.0, 2.0, 0.5), 1, None, False),
}
#: Budget of a lane: ``least``, times the limit, ``most`` (fixed values).
BUDGETS = {"exact": (32, 4, 2000), "lexical": (32, 8, 2000), "fuzzy": (24, 5, 2000), "dense": (32, 8, 100), "temporal": (16, 4, 200), "graph": (16, 4, 200)}


def budget(lane: str, limit: Column) -> Column:
    least, times, most = BUDGETS[lane]
    return F.least(F.lit(most), F.greatest(F.lit(least), limit * times))


def intent(text: Column, timed: Column) -> Column:
    """identifier, code_lookup, historical (``timed``) or general."""
    t = F.trim(F.substring(text, 1, QUERY_CHARS))
    return F.when(t.rlike(UUID), "identifier").when(t.rlike(DIGEST) | t.rlike(CODE), "code_lookup").when(timed, "historical").otherwise("general")


def _by_purpose(value) -> Column:
    rest = F.lit(None)
    for name, purpose in reversed(PURPOSES.items()):
        rest = F.when(F.col("purpose") == name, F.lit(value(purpose))).otherwise(rest)
    return rest


def plans(queries: DataFrame) -> DataFrame:
    """``queries``: query_id, text, purpose, limit, timed (boolean), targeted (a time to rank by); adds the plan.

    Literal identifiers are served by the exact and the fuzzy lane: dense weighs 1 and
    graph 1.25 at most.  The temporal lane runs only for a query with a time.
    """
    rows = queries.withColumn("intent", intent(F.col("text"), F.col("timed")))
    literal = F.col("intent").isin("identifier", "code_lookup")
    weights = {lane: _by_purpose(lambda p, k=k: p.weights[k]) for k, lane in enumerate(LANES)}
    weights["dense"] = F.when(literal, F.lit(1.0)).otherwise(weights["dense"])
    weights["graph"] = F.when(literal, F.least(weights["graph"], F.lit(1.25))).otherwise(weights["graph"])
    weights["temporal"] = F.when(F.col("targeted"), weights["temporal"])
    budgets = {lane: budget(lane, F.col("limit")) for lane in LANES}
    budgets["temporal"] = F.when(F.col("targeted"), budgets["temporal"])
    return rows.select(
        "query_id",
        "purpose",
        "intent",
        *[w.alias(f"{lane}_weight") for lane, w in weights.items()],
        *[b.alias(f"{lane}_budget") for lane, b in budgets.items()],
        _by_purpose(lambda p: p.hops).alias("hops"),
        F.least(F.lit(16), F.greatest(F.lit(4), F.col("limit"))).alias("seed_limit"),
        F.least(F.lit(2000), F.greatest(F.lit(64), budgets["graph"] * 4)).alias("edge_budget"),
        _by_purpose(lambda p: p.tokens).cast("int").alias("token_budget"),
        _by_purpose(lambda p: p.diversify).alias("diversify"),
    )


def time_target(occurred_from: Column, occurred_to: Column, world_at: Column, valid_from: Column, valid_to: Column) -> tuple[Column, Column]:
    """The time to rank by and where it comes from: the middle of the occurrence, the world time, or the middle of the interval."""
    middle = lambda a, b: F.timestamp_micros(F.unix_micros(a) + ((F.unix_micros(b) - F.unix_micros(a)) / 2).cast("long"))
    target = F.coalesce(middle(occurred_from, occurred_to), world_at, middle(valid_from, valid_to))
    label = F.when(occurred_from.isNotNull(), "occurrence_interval_center").when(world_at.isNotNull(), "world_at").when(valid_from.isNotNull(), "interval_center")
    return target, label


class Lane(NamedTuple):
    """Calibrated evidence is ``slope`` * raw + ``shift`` within 0 and 1; ``weight`` is its share of a vote."""

    slope: float
    shift: float
    weight: float


def adaptive(evidence: DataFrame, lanes: dict[str, Lane], abstain: float = 0.35, exact_enough: float = 0.90, seed: float = 0.50, graph: float = 0.45, relational: float = 0.50, deep: float = 0.75, exact_boost: float = 1.0, graph_boost: float = 1.0, depth: int = 2) -> DataFrame:
    """Lane weights, abstention, and whether the graph is walked and how deep.

    ``evidence``: query_id, a raw column for each lane (null: not available), exact_lookup,
    several (needs more than one piece of evidence), need (relational, 0 to 1).  The best
    direct lane alone decides on abstention: weak lanes can't add up.
    """
    calibrated = {k: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v.slope * F.col(k) + v.shift)) for k, v in lanes.items()}
    best = F.greatest(*[F.when(F.col(k).isNotNull(), c) for k, c in calibrated.items() if k != "graph"])
    gives_up = best.isNull() | (best < abstain)
    simple = F.col("exact_lookup") & ~F.col("several") & F.coalesce(calibrated["exact"] >= exact_enough, F.lit(False))
    wanted = F.col("several") | (F.col("need") >= relational)
    why = (
        F.when(gives_up, "graph_skipped:abstained")
        .when(simple, "graph_skipped:sufficient_exact")
        .when(~wanted, "graph_skipped:not_requested")
        .when(F.col("graph").isNull(), "graph_skipped:unavailable")
        .when(calibrated["graph"] < graph, "graph_skipped:weak_graph_evidence")
        .when(best < seed, "graph_skipped:weak_seed_evidence")
        .when(F.col("several"), "graph_allowed:multi_evidence")
        .otherwise("graph_allowed:relational_query")
    )
    allowed = why.startswith("graph_allowed")
    boost = {"exact": F.when(F.col("exact_lookup"), exact_boost).otherwise(1.0), "graph": F.when(F.col("several"), graph_boost).otherwise(1.0)}
    weights = {k: F.coalesce(F.least(F.lit(100.0), lanes[k].weight * c * boost.get(k, F.lit(1.0))), F.lit(0.0)) for k, c in calibrated.items()}
    weights["graph"] = F.when(allowed, weights["graph"]).otherwise(0.0)
    reason = F.when(best.isNull(), "no_calibrated_direct_evidence").when(gives_up, "below_calibrated_evidence_threshold")
    reach = F.when(~allowed, 0).when(F.col("several") | (F.col("need") >= deep), depth).otherwise(1)
    return evidence.select("query_id", *[F.round(w, 6).alias(f"{k}_weight") for k, w in weights.items()], F.round(best, 6).alias("best_direct"), gives_up.alias("abstain"), reason.alias("abstention"), why.alias("graph"), reach.alias("depth"))


def continues(evidence: Column, depth: Column, lane: Lane, allowed: Column, thresholds: tuple[float, ...] = (0.60, 0.72)) -> Column:
    """Whether a hop of a depth (from 1) is strong enough to go on; without evidence, or too deep, it is not."""
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), lane.slope * evidence + lane.shift))
    return F.coalesce((depth <= allowed) & (sure >= F.get(F.array(*map(F.lit, thresholds)), depth - 1)), F.lit(False))
