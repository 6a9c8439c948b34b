"""Upkeep of memories and leases: rejected sources and lease renewals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def reject_sources(memories: DataFrame, evidence: DataFrame, rejected: DataFrame) -> DataFrame:
    """The memories that change when sources are rejected, in one step.

    ``memories``: memory_id (unique), state, previous_state, supersedes, superseded_by,
    recorded_to, version; ``evidence``: memory_id, source_id, trust, rejected (before this
    step); ``rejected``: source_id.  A current memory with evidence from such a source is

    * ``bumped`` when evidence from a trusted source that stands is left,
    * ``refuted`` otherwise; the memory that it replaced, if it names it, is ``revived``
      to its state before (tentative if unknown).

    Revived memories are judged by the next call.  Null sources reject nothing; unlabelled
    evidence counts as trusted.  Every join is on ids, and evidence is aggregated first.
    """
    gone = rejected.where("source_id IS NOT NULL").select("source_id").distinct().withColumn("_gone", F.lit(True))
    marked = evidence.join(gone, "source_id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    stands = ~F.col("_gone") & ~F.coalesce("rejected", F.lit(False)) & (F.coalesce("trust", F.lit("")) != "untrusted")
    found = marked.groupBy("memory_id").agg(F.bool_or("_gone").alias("_hit"), F.bool_or(stands).alias("_stands")).where("_hit")
    judged = memories.where("recorded_to IS NULL").join(found, "memory_id")
    bumped = judged.where("_stands").select("memory_id", F.lit("bumped").alias("outcome"), "state", "supersedes", F.col("version") + 1)
    fallen = judged.where("NOT _stands")
    refuted = fallen.select("memory_id", F.lit("refuted").alias("outcome"), F.lit("refuted").alias("state"), F.lit(None).cast(memories.schema["supersedes"].dataType), F.col("version") + 1)
    replaced = fallen.select(F.col("supersedes").alias("memory_id"), F.col("memory_id").alias("superseded_by"))
    revived = memories.join(replaced, ["memory_id", "superseded_by"], "left_semi").select("memory_id", F.lit("revived").alias("outcome"), F.coalesce("previous_state", F.lit("tentative")).alias("state"), "supersedes", F.col("version") + 1)
    return bumped.unionByName(refuted.toDF(*bumped.columns)).unionByName(revived.toDF(*bumped.columns)).toDF("memory_id", "outcome", "state", "supersedes", "version")


def renewed(claims: DataFrame, renewals: DataFrame, seconds: int) -> DataFrame:
    """The end of every claimed lease and the renewals that counted.

    ``claims``: task_id (unique), at; ``renewals``: task_id, at.  Each moment extends the
    lease to ``at`` plus ``seconds``; one at or after the end is too late, and so are all
    that follow.  Renewals before the claim and without a moment are left out.

    Moments within one span of ``seconds`` can't be a lease apart, so each span is first
    aggregated to its earliest and latest: a task with very many renewals shrinks to its
    spans before the shuffle.
    """
    began = claims.where("at IS NOT NULL").select("task_id", F.col("at").alias("_began"))
    later = renewals.join(began, "task_id").where("at >= _began").select("task_id", "at", F.lit(1).alias("_n"))
    moments = later.unionByName(began.select("task_id", F.col("_began").alias("at"), F.lit(0).alias("_n")))
    span = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / F.lit(seconds * 1_000_000)).alias("_span")
    spans = moments.groupBy("task_id", span).agg(F.min("at").alias("_first"), F.max("at").alias("_last"), F.sum("_n").alias("_n"))
    order = Window.partitionBy("task_id").orderBy("_span")
    length = F.make_dt_interval(secs=F.lit(seconds))
    late = F.coalesce(F.col("_first") >= F.lag("_last").over(order) + length, F.lit(False)).cast("int")
    lapsed = F.max("_late").over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = spans.withColumn("_late", late).withColumn("_lapsed", lapsed).where("_lapsed = 0")
    return held.groupBy("task_id").agg((F.max("_last") + length).alias("expires_at"), F.sum("_n").alias("n_renewals"))
