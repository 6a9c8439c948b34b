"""A whole recall: plan, lanes, fusion, graph, second fusion, canonical check, relevance, floor, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import fusion, graph, lanes, planning, vectors
from cairn.sources.shared import written

#: English function words, which say nothing about what a query asks for (fixed values).
FUNCTION_WORDS = (
    "a about after all also an and any are as at be been before being but by can could did do does for from had has have how i if in into is it its may me might must my no not of on one or our out over "
    "should so some such than that the their them then there these they this those to up us was we were what when where which while who why will with would you your"
).split()


def query_terms(c: Column, most: int = 64) -> Column:
    """The query's tokens without function words; all of them if there is nothing else."""
    every = text.tokens(c, most)
    content = F.filter(every, lambda w: ~w.isin(*FUNCTION_WORDS))
    return F.when(F.size(content) > 0, content).otherwise(every)


def relevance(candidates: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """Adds ``relevance``, 0 to 1, which no rank enters: the best of exact, coverage, trigrams and cosine.

    ``candidates``: query_id, canonical_id, lanes (names, comma-joined) and, if the dense
    lane ran, cosine; a candidate of the graph alone must stand by its own text.
    """
    # the sets of a query and of a memory are made once, not once a pair
    own = memories.join(candidates.select("canonical_id").distinct(), "canonical_id", "left_semi")
    own = own.select("canonical_id", "text", text.tokens(F.col("text")).alias("_dt"), text.trigrams(F.coalesce("lookup", "text")).alias("_dg"))
    asked = queries.select("query_id", query_terms(F.col("text")).alias("_qt"), F.when(F.length("text") >= 3, text.trigrams(F.col("text"))).alias("_qg"))
    rows = candidates.join(own, "canonical_id").join(asked, "query_id").withColumn("_both", F.size(F.array_intersect("_qg", "_dg")))
    exact = F.array_contains(F.split("lanes", ","), "exact").cast("double")
    union = F.size("_qg") + F.size("_dg") - F.col("_both")
    grams = F.when(F.col("_qg").isNotNull() & (union > 0), F.col("_both") / union).otherwise(0.0)
    cosine = [F.coalesce("cosine", F.lit(0.0))] if "cosine" in candidates.columns else []
    best = F.greatest(exact, text.coverage(F.col("_qt"), F.col("_dt")), grams, *cosine)
    return rows.withColumn("relevance", F.round(best, 6)).drop("_qt", "_qg", "_dt", "_dg", "_both")


#: Candidates that a packer is offered, in limits of the query, and at most (fixed values).
OFFERED, MOST_OFFERED = 4, 512


def recall(memories: DataFrame, queries: DataFrame, edges: DataFrame, plane: vectors.Plane | None = None) -> DataFrame:
    """What every query recalls, by its own plan, of what it may see.

    ``memories``: canonical_id, text, lookup, terms (array), scope_key, at, recallable;
    ``queries``: query_id, text, scope_keys (array), target (a time, or null), purpose,
    limit, min_score, and tokens (a budget, or null for the purpose's); ``edges``: src,
    dst, relation; ``plane``: what the dense lane needs, if there is one.

    Every lane runs within the query's scopes, with the budgets and weights of its plan
    (``planning.plans``).  The first fusion's best hits seed the graph lane, which stays
    within the scopes too, and all lanes are fused again.  Memories that are not recallable
    when they are read drop out, and so do candidates under the query's floor.  A query
    with a token budget offers its first 4 * limit candidates (512 at most) to the packer
    and keeps what fits, up to its limit; one without keeps its first ``limit``.

    Returns query_id, canonical_id, rank, tokens, kept, lanes, score and relevance of all
    candidates that were offered.
    """
    plans = planning.plans(queries.select("query_id", "text", "purpose", "limit", F.lit(False).alias("timed"), F.col("target").isNotNull().alias("targeted")))
    budgets = F.coalesce(queries["tokens"], planning._by_purpose(lambda p: p.tokens)).cast("long")
    own = queries.select("query_id", "limit", "min_score", budgets.alias("_tokens"))
    plans = written(plans.join(own, "query_id"), "plans")
    # a lane runs with the largest of the budgets; each query then takes its own
    row = plans.agg(*[F.max(f"{lane}_budget").alias(lane) for lane in planning.LANES], F.max("hops").alias("hops")).first()
    most, hops = {lane: row[lane] or 1 for lane in planning.LANES}, row["hops"] or 0
    scopes = queries.select("query_id", F.explode(F.array_distinct("scope_keys")).alias("scope_key"))
    asked, key = queries.select("query_id", "text", "target").join(scopes, "query_id"), ("scope_key",)
    texts = memories.select("canonical_id", "text", "scope_key")
    found = {
        "exact": lanes.exact(memories.select("canonical_id", "scope_key", F.explode("terms").alias("term")), asked, most["exact"], key),
        "lexical": lanes.lexical(texts, asked, most["lexical"], keys=key),
        "fuzzy": lanes.fuzzy(memories.select("canonical_id", "scope_key", F.col("lookup").alias("text")), asked, budget=most["fuzzy"], keys=key),
        "temporal": lanes.temporal(memories.select("canonical_id", F.col("scope_key").alias("scope"), "at"), asked.where("target IS NOT NULL").select("query_id", F.col("scope_key").alias("scope"), "target"), most["temporal"]).drop("truncated"),
    }
    if plane is not None:
        found["dense"] = vectors.plane(plane.projection, plane.memories, plane.queries.join(queries.select("query_id", "scope_keys"), "query_id"), plane.dimensions, most["dense"])[0]
    # all lanes in one job, so that none waits for another
    ran = None
    for lane, rows in found.items():
        own = rows.join(plans.select("query_id", F.col(f"{lane}_budget").alias("_b")), "query_id").where(F.col("rank") <= F.col("_b"))
        own = own.select(F.lit(lane).alias("lane"), "query_id", "canonical_id", "raw_score", "rank")
        ran = own if ran is None else ran.unionByName(own)
    ran = written(ran, "lanes")
    first = fusion.planned_rrf(ran, plans)
    seeds = first.join(plans.select("query_id", "seed_limit", "hops"), "query_id").where(F.col("rank") <= F.col("seed_limit")).select("query_id", F.col("canonical_id").alias("node"), F.col("score").alias("activation"), "hops")
    seeds = written(seeds, "seeds")

    def gates(pairs: DataFrame) -> DataFrame:
        nodes = texts.withColumnRenamed("canonical_id", "node")
        seen = pairs.select("query_id", "node").distinct().join(nodes.select("node", "scope_key"), "node").join(scopes, ["query_id", "scope_key"], "left_semi")
        return graph.overlaps(seen, queries, nodes)

    spread = graph.spread(seeds, edges, hops, 8, gates).where("depth > 0")
    reached = lanes.ranked(spread.select("query_id", F.col("node").alias("canonical_id"), F.col("activation").alias("raw_score")), most["graph"])
    fused = fusion.planned_rrf(ran.unionByName(reached.withColumn("lane", F.lit("graph"))), plans).withColumnRenamed("rank", "fused_rank")
    if plane is not None:
        fused = fused.join(ran.where("lane = 'dense'").select("query_id", "canonical_id", F.col("raw_score").alias("cosine")), ["query_id", "canonical_id"], "left")
    scored = relevance(fused, queries, memories.where("recallable")).join(plans.select("query_id", "limit", "min_score", "_tokens"), "query_id").where(F.col("relevance") >= F.col("min_score"))
    offered = F.when(F.col("_tokens").isNull(), F.col("limit")).otherwise(F.least(F.lit(MOST_OFFERED), OFFERED * F.col("limit")))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("fused_rank"))
    hits = scored.withColumn("rank", nth).where(F.col("rank") <= offered).withColumn("tokens", text.token_estimate(F.col("text")).cast("long"))
    hits = written(hits.select("query_id", "canonical_id", "rank", "tokens", "lanes", "score", "relevance", "limit", "_tokens"), "hits")
    packed = fusion.pack(hits, "_tokens", "limit")
    return packed.join(hits.select("query_id", "canonical_id", "lanes", "score", "relevance"), ["query_id", "canonical_id"])
