"""Filters of a recall: scope, visibility, state, two clocks, and trust in the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns in which a memory of a visibility and a query must agree.
SCOPES = {"repository": ("repository",), "run": ("repository", "run_id"), "task": ("repository", "run_id", "task_id")}


def _scope(visibility: str) -> Column:
    keys = [F.col(k).cast("string") for k in SCOPES[visibility]]
    # a key that is null makes the scope null, which equals none
    return F.concat(F.lit(f"{visibility}:"), *[x for k in keys for x in (k, F.lit(":"))])


def scope_key() -> Column:
    """The scope that a memory is in, by its visibility."""
    out = F.lit(None).cast("string")
    for visibility in SCOPES:
        out = F.when(F.col("visibility") == visibility, _scope(visibility)).otherwise(out)
    return out


def scope_keys() -> Column:
    """The scopes that a query may see: its repository's, and its run's and task's if it has them."""
    return F.array_compact(F.array(*[_scope(v) for v in SCOPES]))


def nodes_of_interval(low: Column, high: Column, levels: int) -> Column:
    """The fewest aligned stretches of 1, 2, 4, ... units that make up ``low`` to before ``high``: (level, place) each, two a level at most."""

    out = []
    for k in range(levels + 1):
        first, last = F.ceil(low / (1 << k)).cast("long"), F.floor(high / (1 << k)).cast("long")
        for keep, place in ((first % 2 == 1, first), (last % 2 == 1, last - 1)):
            out.append(F.when((first < last) & keep, F.struct(F.lit(k).alias("level"), place.alias("place"))))
    return F.array_compact(F.array(*out))


def nodes_of_point(at: Column, levels: int) -> Column:
    """The stretch of each size that holds the unit ``at``; it shares exactly one with every interval that holds it."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("place")) for k in range(levels + 1)])


def holds_at(begin: str, end: str, at: str) -> Column:
    """``at`` lies in the half-open interval; a null end never comes."""
    return (F.col(begin) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))


def overlaps(begin: str, end: str, low: str, high: str) -> Column:
    return (F.col(begin) < F.col(high)) & (F.col(end).isNull() | (F.col(low) < F.col(end)))


def acceptable(evidence: DataFrame) -> DataFrame:
    return evidence.where(~F.col("rejected") & (F.col("trust") != "untrusted"))


def trusted(memories: DataFrame, evidence: DataFrame) -> DataFrame:
    """Memories without evidence, or with at least one acceptable reference."""
    judged = evidence.groupBy("memory_id").agg(F.bool_or(~F.col("rejected") & (F.col("trust") != "untrusted")).alias("_ok"))
    return memories.join(judged, "memory_id", "left").where(F.coalesce("_ok", F.lit(True))).drop("_ok")


def recallable(memories: DataFrame, evidence: DataFrame, queries: DataFrame, unit: int = 32 * 86_400) -> DataFrame:
    """Every (query_id, memory_id) that the query may see, known at its system time and true at its world time.

    Memories and queries meet by scope and time: a memory's recorded interval is cut into
    aligned stretches of whole units (``unit`` seconds), two a size at most, and a query
    looks at the stretches of all sizes that hold its moment.  So a pair meets once, and a
    scope with very many memories is spread over as many keys as it has stretches.
    """
    states = F.col("state").isin("tentative", "confirmed") | (F.col("include_refuted") & (F.col("state") == "refuted"))
    times = holds_at("recorded_from", "recorded_to", "known_at") & holds_at("valid_from", "valid_to", "world_at")
    day = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (unit * 1_000_000)).cast("long")
    begin, end = queries.agg(F.min(day("known_at")), F.max(day("known_at"))).first()
    if begin is None:
        begin = end = 0
    levels = max(1, int(end - begin + 1).bit_length())
    # places count from the first moment that is asked for; what is known before or after all of them is cut off
    low = F.greatest(day("recorded_from") - begin, F.lit(0).cast("long"))
    high = F.least(F.coalesce(day("recorded_to") + 1, F.lit(end + 1)) - begin, F.lit(end + 1 - begin).cast("long"))
    own = ("memory_id", "state", "kind", "recorded_from", "recorded_to", "valid_from", "valid_to")
    held = memories.select(*own, scope_key().alias("_scope"), low.alias("_low"), high.alias("_high")).select(*own, "_scope", F.explode(nodes_of_interval(F.col("_low"), F.col("_high"), levels)).alias("_node"))
    asked = queries.select("query_id", "known_at", "world_at", "include_refuted", F.explode(scope_keys()).alias("_scope"), (day("known_at") - begin).alias("_at"))
    asked = asked.withColumn("_node", F.explode(nodes_of_point(F.col("_at"), levels)))
    pairs = held.join(asked, ["_scope", "_node"]).where(states & times).select("query_id", "memory_id", "state", "kind")
    return trusted(pairs, evidence)


def prune_evidence(evidence: DataFrame) -> DataFrame:
    """Acceptable references of each memory, oldest first, without repetition."""
    rows = acceptable(evidence).select("memory_id", F.struct("recorded_at", "evidence_id").alias("_e"))
    lists = rows.groupBy("memory_id").agg(F.array_sort(F.collect_set("_e")).alias("_l"))
    return lists.select("memory_id", F.array_join(F.transform("_l", lambda e: e["evidence_id"].cast("string")), ",").alias("evidence_ids"), F.size("_l").cast("long").alias("n_evidence"))
