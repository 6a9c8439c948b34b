"""Work coordination: claimable tasks, checkpoints, sessions, event pages, version chains."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.text import TOKEN


def claimable(tasks: DataFrame, dependencies: DataFrame, limit: int) -> DataFrame:
    """Open tasks whose prerequisites are all done, the first ``limit`` of each scope.

    A prerequisite that does not exist blocks too.  ``tasks``: task_id, scope, status,
    priority, available_at; ``dependencies``: task_id, needs.
    """
    done = tasks.where("status = 'done'").select(F.col("task_id").alias("needs"))
    blocked = dependencies.join(done, "needs", "left_anti").select("task_id").distinct()
    free = tasks.where("status = 'open'").join(blocked, "task_id", "left_anti")
    order = Window.partitionBy("scope").orderBy("priority", "available_at", "task_id")
    return free.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def latest(rows: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The last row of each key, with one aggregation and no sort."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max(F.struct(*by, *[c for c in rest if c not in by])).alias("_r"))
    return best.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def sessions(events: DataFrame, user: str, at: str, gap: str) -> DataFrame:
    """Runs of a user's events with no pause longer than ``gap``: number, first, last, size."""
    order = Window.partitionBy(user).orderBy(at, "event_id")
    begins = F.when(F.col(at) <= F.lag(at).over(order) + F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    marked = events.withColumn("_b", begins).withColumn("session", F.sum("_b").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(user, "session").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"), F.max_by("event_id", F.struct(F.col(at), F.col("event_id"))).alias("last_event"))


def page(events: DataFrame, at: str, key: str, after: tuple[Column, Column] | None, limit: int) -> DataFrame:
    """The next ``limit`` rows in the order of (``at``, ``key``) after a cursor."""
    rows = events if after is None else events.where(F.struct(F.col(at), F.col(key)) > F.struct(after[0].alias(at), after[1].alias(key)))
    return rows.orderBy(at, key).limit(limit)


def windows(rows: DataFrame, group: str, position: str, text: str, size: int, stride: int) -> DataFrame:
    """Overlapping windows of ``size`` consecutive rows of a group, every ``stride`` rows."""
    n = F.count("*").over(Window.partitionBy(group))
    placed = rows.withColumn("_p", F.row_number().over(Window.partitionBy(group).orderBy(position)) - 1).withColumn("_n", n)
    first = F.greatest(F.lit(0), F.ceil((F.col("_p") - (size - 1)) / stride).cast("int"))
    last = F.least(F.floor(F.col("_p") / stride).cast("int"), F.floor((F.col("_n") - 1) / stride).cast("int"))
    spread = placed.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("window"))
    return spread.groupBy(group, "window").agg(F.count("*").alias("n_rows"), F.min(position).alias("first_position"), F.sum(F.length(text)).cast("long").alias("n_chars"))


def expand(rows: DataFrame, group: str, position: str, core: Column, radius: int) -> DataFrame:
    """Rows within ``radius`` places of a core row, labelled core or context."""
    around = Window.partitionBy(group).orderBy(position).rowsBetween(-radius, radius)
    marked = rows.withColumn("_core", core.cast("int")).withColumn("_near", F.max("_core").over(around))
    return marked.where("_near = 1").withColumn("label", F.when(F.col("_core") == 1, "core").otherwise("context")).drop("_core", "_near")


def versions(rows: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Version chains: each row is current until the next of its key is recorded."""
    order = Window.partitionBy(key).orderBy(at, tie)
    return rows.withColumn("recorded_to", F.lead(at).over(order)).withColumn("supersedes", F.lag(tie).over(order)).withColumn("version", F.row_number().over(order))


def resumptions(events: DataFrame, key: str, order_by: list[str], checkpoint: Column, claim: Column) -> DataFrame:
    """Claims by whether a checkpoint of the same key came before."""
    before = Window.partitionBy(key).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("_claim", claim).withColumn("_seen", F.coalesce(F.max(checkpoint.cast("int")).over(before), F.lit(0)))
    return marked.groupBy(key).agg(F.count_if(F.col("_claim") & (F.col("_seen") == 0)).alias("fresh_claims"), F.count_if(F.col("_claim") & (F.col("_seen") == 1)).alias("resumptions"))


def chunks(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Fixed-width pieces of every text with their offsets; joined they give the text again."""
    n = F.greatest(F.ceil(F.length(text) / size).cast("int"), F.lit(1))
    cut = docs.select(key, F.col(text).alias("_t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    part = F.substring(F.col("_t"), F.col("chunk") * size + 1, F.lit(size))
    return cut.select(key, "chunk", (F.col("chunk") * size).cast("long").alias("begin"), part.alias("part"))


def cut_at_lines(text: str, limit: int) -> list[str]:
    """Segments of at most ``limit`` characters without blanks at their ends.

    A cut is made at the last line break within the limit, or at the limit where that is
    in the first half; where the next segment begins depends on it.
    """
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > limit:
            end = text.rfind("\n", at, at + limit + 1)
            if end - at < limit // 2:
                end = at + limit
        part = text[at:end].strip()
        # the very last segment stays, even if it is blank
        if part or end == len(text):
            out.append(part)
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    return out or ["(empty)"]


def segments(docs: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """``key``, ``segment`` (from 1), ``n_segments``, ``part``: whole texts cut at line breaks; a null text is empty."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(values: pd.Series) -> pd.Series:
        return values.map(lambda v: cut_at_lines(v, limit))

    parts = docs.select(key, cut(F.coalesce(text, F.lit(""))).alias("_p"))
    rows = parts.select(key, F.size("_p").alias("n_segments"), F.posexplode("_p").alias("_k", "part"))
    return rows.select(key, (F.col("_k") + 1).alias("segment"), "n_segments", "part")


def owned(leases: DataFrame, writes: DataFrame) -> DataFrame:
    """The ``writes`` whose writer holds the task's lease at that moment.

    ``leases``: task_id, owner, active, expires_at; ``writes``: task_id, writer, at and
    more.  A lease ends at ``expires_at``: a write at that very moment is too late.
    """
    held = leases.where("active").select("task_id", "owner", "expires_at")
    return writes.join(held, "task_id").where("writer = owner AND at < expires_at").select(writes.columns)


def crash_handoffs(leases: DataFrame, checkpoints: DataFrame, now: Column) -> DataFrame:
    """Active leases that have expired by ``now`` though their task has a checkpoint within the lease.

    ``checkpoints``: task_id, at.
    """
    gone = leases.where(F.col("active") & (F.col("expires_at") <= now))
    made = checkpoints.select(F.col("task_id").alias("_task"), "at")
    return gone.join(made, (F.col("task_id") == F.col("_task")) & (F.col("at") < F.col("expires_at")), "left_semi")


def hash_vectors(docs: DataFrame, dimensions: int) -> DataFrame:
    """Entries of unit vectors of texts: every token adds one, up or down, at eight places that its sha256 names.

    ``docs``: canonical_id, text; a text without tokens counts as the token ``empty``.
    """
    found = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    words = docs.select("canonical_id", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("empty")))).alias("_w"))
    h = words.select("canonical_id", F.sha2("_w", 256).alias("_h"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_o"))
    number = lambda begin, n: F.conv(F.substring(F.col("_h"), begin, F.lit(n)), 16, 10).cast("int")
    step = F.when(number(F.col("_o") * 2 + 33, 2) % 2 == 0, 1).otherwise(-1)
    entries = h.groupBy("canonical_id", (number(F.col("_o") * 4 + 1, 4) % dimensions).alias("place")).agg(F.sum(step).alias("_v"))
    norm = entries.groupBy("canonical_id").agg(F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_n"))
    return entries.where("_v <> 0").join(norm, "canonical_id").select("canonical_id", "place", F.round(F.col("_v") / F.col("_n"), 6).alias("value"))
