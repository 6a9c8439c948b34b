"""Life cycles as batches: claims, releases, retries, memory writes and reviews, evidence rules, projections.

A batch of commands is applied to a table at once.  Commands on one row are taken in the
order of their number, and what each of them does is decided by windows and joins on the
row's key; a command that does not apply is returned with the reason.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cairn.functions import text
from cairn.operators.replay import replay

OPEN = ("pending", "ready")


def _verdict(*cases: tuple[Column, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for test, name in reversed(cases):
        out = F.when(test, name).otherwise(out)
    return out


def expire(leases: DataFrame, tasks: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Leases that have run out become expired; their tasks become ready and get a new version.

    ``leases``: lease_id, task_id, status, expires_at, version; ``tasks``: task_id, state,
    version, lease_id and more.
    """
    over = (F.col("status") == "active") & (F.col("expires_at") <= now)
    new = leases.withColumn("_over", over)
    moved = new.select("lease_id", "task_id", F.when(F.col("_over"), "expired").otherwise(F.col("status")).alias("status"), "expires_at", (F.col("version") + F.col("_over").cast("int")).alias("version"))
    gone = new.where("_over").select("lease_id", F.lit(True).alias("_gone"))
    rows = tasks.join(gone, "lease_id", "left")
    free = F.coalesce("_gone", F.lit(False))
    kept = [c for c in tasks.columns if c not in ("lease_id", "state", "version")]
    released = rows.select(*kept, F.when(free, "ready").otherwise(F.col("state")).alias("state"), (F.col("version") + free.cast("int")).alias("version"), F.when(~free, F.col("lease_id")).alias("lease_id"))
    return moved, released


def claim(tasks: DataFrame, needs: DataFrame, agents: DataFrame, now: Column) -> DataFrame:
    """One task for each agent of a run, as if they asked one after the other, in the order of their ids.

    ``tasks``: task_id, run_id, state, priority, available_at, created_at, tags (array);
    ``needs``: task_id, needs; ``agents``: agent_id, run_id, tags (a task must have them
    all).  Tasks are taken by priority (high first), availability (creation, if none is
    set), creation and id.

    Agents of a run that ask for the same tags share a list of the tasks that fit.  Others
    take fewer tasks than the run has agents, so no more of a list than that is needed: a
    run's agents are served by one task, which gets its agents and lists of that length,
    whatever the number of its tasks.
    """
    done = tasks.where("state = 'completed'").select(F.col("task_id").alias("needs"), F.col("run_id").alias("_run"))
    inside = needs.join(tasks.select("task_id", "run_id"), "task_id")
    blocked = inside.join(done, (inside["needs"] == done["needs"]) & (inside["run_id"] == done["_run"]), "left_anti").select("task_id").distinct()
    free = tasks.where(F.col("state").isin(*OPEN) & (F.col("available_at").isNull() | (F.col("available_at") <= now))).join(blocked, "task_id", "left_anti")
    asked = agents.select("agent_id", "run_id", F.array_sort("tags").alias("_want"))
    wants = asked.groupBy("run_id", "_want").agg(F.count("*").alias("_own")).withColumn("_agents", F.sum("_own").over(Window.partitionBy("run_id"))).drop("_own")
    fits = free.join(wants, "run_id").where(F.size(F.array_except("_want", "tags")) == 0)
    order = Window.partitionBy("run_id", "_want").orderBy(F.desc("priority"), F.coalesce("available_at", "created_at"), "created_at", "task_id")
    lists = fits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("_agents")).select("run_id", "_want", "_n", "task_id")
    schema = T.StructType([agents.schema["agent_id"], agents.schema["run_id"], tasks.schema["task_id"], T.StructField("outcome", T.StringType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return asked.groupBy("run_id").cogroup(lists.toDF(*lists.columns).groupBy("run_id")).applyInArrow(_serve(to_arrow_schema(schema)), schema)


def _serve(form: pa.Schema):
    def serve(agents: pa.Table, lists: pa.Table) -> pa.Table:
        queues: dict[tuple, list] = {}
        for row in sorted(lists.to_pylist(), key=lambda r: r["_n"]):
            queues.setdefault(tuple(row["_want"]), []).append(row["task_id"])
        at, taken, out = dict.fromkeys(queues, 0), set(), []
        for row in sorted(agents.to_pylist(), key=lambda r: r["agent_id"]):
            want = tuple(row["_want"])
            queue = queues.get(want, [])
            while at.get(want, 0) < len(queue) and queue[at[want]] in taken:
                at[want] += 1
            task = queue[at[want]] if at.get(want, 0) < len(queue) else None
            taken.add(task)
            out.append({"agent_id": row["agent_id"], "run_id": row["run_id"], "task_id": task, "outcome": "no_task_available" if task is None else "claimed"})
        return pa.Table.from_pylist(out, schema=form)

    return serve


def claim_misses(commands: DataFrame, tasks: DataFrame) -> DataFrame:
    """Why a claim of a named task fails: not found in the run, another version, not free, or free after all (contention).

    ``commands``: command_id, run_id, task_id, expected_version.
    """
    rows = commands.join(tasks.select("task_id", "run_id", F.col("version").alias("_v"), F.col("state").alias("_s")), ["task_id", "run_id"], "left")
    why = _verdict((F.col("_v").isNull(), "not_found"), (F.col("expected_version") != F.col("_v"), "version_changed"), (~F.col("_s").isin(*OPEN), "no_task_available"), otherwise="contention")
    return rows.select("command_id", "task_id", why.alias("reason"))


def finish(commands: DataFrame, tasks: DataFrame) -> DataFrame:
    """The state of tasks after checkpoints, completions and releases by their lease holders.

    ``commands``: command_id, task_id, lease_id, action (checkpoint, complete, release),
    at; ``tasks``: task_id, state, lease_id, expires_at, version.  The first completion or
    release ends the lease: later commands find it gone.  A lease that has run out, or is
    another's, is refused.  Returns each command with ``outcome``, ``sequence`` (of
    checkpoints) and the task's ``version`` after it.
    """
    rows = commands.join(tasks.select("task_id", "state", F.col("lease_id").alias("_held"), "expires_at", F.col("version").alias("_v")), "task_id", "left")
    valid = (F.col("state") == "claimed") & (F.col("_held") == F.col("lease_id")) & (F.col("at") < F.col("expires_at"))
    order = Window.partitionBy("task_id").orderBy("at", "command_id")
    judged = rows.withColumn("_ok", F.coalesce(valid, F.lit(False))).withColumn("_end", (F.col("_ok") & F.col("action").isin("complete", "release")).cast("int"))
    judged = judged.withColumn("_ended", F.coalesce(F.sum("_end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0)
    good = F.col("_ok") & ~F.col("_ended")
    count = lambda c: F.sum(c.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(F.col("_v").isNull(), "not_found").when(~F.col("_ok"), "lease_lost").when(F.col("_ended"), "already_ended").otherwise(F.col("action"))
    return judged.select("command_id", "task_id", outcome.alias("outcome"), F.when(good & (F.col("action") == "checkpoint"), count(good & (F.col("action") == "checkpoint"))).alias("sequence"), (F.col("_v") + count(good & (F.col("_end") == 1))).alias("version"))


def retry_or_fail(failures: DataFrame, work: DataFrame) -> DataFrame:
    """Work items after failures: tried again while attempts are left, else failed for good.

    ``work``: work_id, attempts, max_attempts, status, version; ``failures``: work_id, retry_at, error.
    """
    last = failures.groupBy("work_id").agg(F.max(F.struct("retry_at", "error")).alias("_f"))
    rows = work.join(last, "work_id", "left")
    hit = F.col("_f").isNotNull() & (F.col("status") == "leased")
    again = F.col("attempts") < F.col("max_attempts")
    return rows.select("work_id", "attempts", F.when(hit & again, "retry").when(hit, "failed").otherwise(F.col("status")).alias("status"), F.when(hit & again, F.col("_f.retry_at")).alias("available_at"), F.when(hit, F.col("_f.error")).alias("last_error"), (F.col("version") + hit.cast("int")).alias("version"))


def additions(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Inserts that may be repeated: added, replayed (the same contents are there) or conflict.

    Of several rows with one key the first by ``command_id`` is added, the others are
    compared with it, column by column; null equals null alone.
    """
    own, known = (F.struct(*[F.col(c) for c in sorted(c for c in d.columns if c not in (key, "command_id"))]) for d in (rows, there))
    old = there.select(F.col(key), known.alias("_old"), F.lit(True).alias("_there"))
    order = Window.partitionBy(key).orderBy("command_id")
    marked = rows.withColumn("_own", own).join(old, key, "left").withColumn("_ref", F.when(F.col("_there"), F.col("_old")).otherwise(F.first("_own").over(order))).withColumn("_n", F.row_number().over(order))
    return marked.select("command_id", key, _verdict((F.col("_there").isNull() & (F.col("_n") == 1), "added"), (F.col("_own").eqNullSafe(F.col("_ref")), "replayed"), otherwise="conflict").alias("outcome"))


def decide(commands: DataFrame, memories: DataFrame) -> DataFrame:
    """What becomes of each memory that is to be written: add, update, merge or noop, with the reason.

    ``commands``: command_id, content, state, n_evidence, target (a memory it replaces, or
    null); ``memories``: memory_id, content, state (current ones).  Independent memories
    are added.  A confirmed memory is only replaced by a confirmed one with evidence.
    """
    old = memories.select(F.col("memory_id").alias("target"), text.canonical(F.col("content")).alias("_c"), F.col("state").alias("_s"))
    rows = commands.join(old, "target", "left")
    poison = (F.col("_s") == "confirmed") & ((F.col("state") != "confirmed") | (F.col("n_evidence") == 0))
    what = F.when(F.col("target").isNull(), F.struct(F.lit("add").alias("o"), F.lit("independent").alias("r")))
    what = what.when(F.col("_s").isNull(), F.struct(F.lit("noop").alias("o"), F.lit("target_not_current").alias("r")))
    what = what.when(F.col("_c") == text.canonical(F.col("content")), F.struct(F.lit("merge").alias("o"), F.lit("exact_memory_exists").alias("r")))
    what = what.when(poison, F.struct(F.lit("noop").alias("o"), F.lit("confirmed_needs_confirmed_evidence").alias("r")))
    what = what.otherwise(F.struct(F.lit("update").alias("o"), F.lit("supersedes").alias("r")))
    return rows.select("command_id", "target", what["o"].alias("operation"), what["r"].alias("reason"))


def review(commands: DataFrame, rows: DataFrame, key: str, terminal: str | None = None) -> DataFrame:
    """Reviews in the order of ``command_id``, each with the version that it expects.

    ``commands``: command_id, key, expected_version, decision; ``rows``: key, state,
    version (current ones).  A review that finds its version moves the row to its state
    and to the next version, which a later one can expect.  A row in the state
    ``terminal`` can't be moved any more.
    """
    nothing = F.lit(None)
    base = rows.select(key, F.lit(0).alias("_k"), nothing.cast(commands.schema["command_id"].dataType).alias("command_id"), F.col("version").cast("long").alias("_version"), F.col("state").alias("_state"))
    asked = commands.select(key, F.lit(1).alias("_k"), "command_id", F.col("expected_version").cast("long").alias("_version"), F.col("decision").alias("_state"))
    fields = [commands.schema["command_id"], commands.schema[key], T.StructField("outcome", T.StringType()), T.StructField("state", T.StringType()), T.StructField("version", T.LongType())]

    def step(now: tuple | None, row: dict) -> tuple[tuple | None, list[dict]]:
        if row["_k"] == 0:
            return (row["_state"], row["_version"]), []
        outcome = "not_found" if now is None else "terminal" if terminal is not None and now[0] == terminal else "reviewed" if now[1] == row["_version"] else "version_changed"
        if outcome == "reviewed":
            now = (row["_state"], now[1] + 1)
        state, version = now or (None, None)
        return now, [{"command_id": row["command_id"], key: row[key], "outcome": outcome, "state": state, "version": version}]

    return replay(base.unionByName(asked), [key], ["_k", "command_id"], step, T.StructType([T.StructField(f.name, f.dataType) for f in fields]))


def conflicts(reports: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Conflicts between pairs of memories: a pair is reported once, whichever way round; the first resolution since then closes it.

    ``reports``: left, right, at; ``resolutions``: left, right, winner, at.  The winner must be one of the pair.
    """
    pair = [F.least("left", "right").alias("a"), F.greatest("left", "right").alias("b")]
    opened = reports.where("left <> right").select(*pair, "at").groupBy("a", "b").agg(F.min("at").alias("reported_at"), F.count("*").alias("n_reports"))
    since = resolutions.where("winner IN (left, right)").select(*pair, "winner", "at").join(opened.select("a", "b", "reported_at"), ["a", "b"]).where(F.col("at") >= F.col("reported_at"))
    closed = since.groupBy("a", "b").agg(F.min(F.struct("at", "winner")).alias("_r"))
    rows = opened.join(closed, ["a", "b"], "left")
    return rows.select("a", "b", "n_reports", F.when(F.col("_r").isNotNull(), "resolved").otherwise("open").alias("state"), F.col("_r.winner").alias("winner"))


def derivable(proposals: DataFrame, proposed: DataFrame, memories: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether a derived memory is carried by its sources' evidence.

    ``proposals``: proposal_id, source (a memory it is derived from, one row each);
    ``proposed``: proposal_id, evidence_id, digest; ``memories``: memory_id, state;
    ``evidence``: memory_id, evidence_id, digest.  Every source is confirmed and shares a
    piece of evidence, shared pieces agree, and nothing else is proposed.
    """
    own = evidence.select(F.col("memory_id").alias("source"), "evidence_id", F.col("digest").alias("_d"))
    sources = proposals.join(memories.select(F.col("memory_id").alias("source"), "state"), "source", "left")
    shared = proposals.join(own, "source").join(proposed, ["proposal_id", "evidence_id"]).groupBy("proposal_id", "source").agg(F.count("*").alias("_n"), F.bool_and(F.col("_d") == F.col("digest")).alias("_same"))
    per = sources.join(shared, ["proposal_id", "source"], "left").groupBy("proposal_id").agg(F.bool_and(F.coalesce(F.col("state") == "confirmed", F.lit(False))).alias("_confirmed"), F.bool_and(F.col("_n").isNotNull()).alias("_touch"), F.bool_and(F.coalesce("_same", F.lit(True))).alias("_same"))
    allowed = proposals.join(own, "source").select("proposal_id", "evidence_id", F.col("_d").alias("digest")).distinct()
    stray = proposed.join(allowed, ["proposal_id", "evidence_id", "digest"], "left_anti").select("proposal_id", F.lit(True).alias("_stray")).distinct()
    rows = per.join(stray, "proposal_id", "left")
    return rows.select("proposal_id", _verdict((~F.col("_confirmed"), "source_not_confirmed"), (~F.col("_touch"), "source_without_shared_evidence"), (~F.col("_same"), "evidence_changed"), (F.coalesce("_stray", F.lit(False)), "unsupported_evidence"), otherwise="derivable").alias("verdict"))


def project(projection: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """A projection brought up to its canonical rows: rows with a newer version or another digest are replaced, stale ones swept.

    Both: key, version, digest, payload.  A projected row of a newer version than the
    canonical one stays (a late writer does not win).
    """
    old, new = (d.select(key, F.struct("version", "digest", "payload").alias(n)) for d, n in ((projection, "_old"), (canonical, "_new")))
    rows = old.join(new, key, "full_outer")
    action = _verdict((F.col("_new").isNull(), "swept"), (F.col("_old").isNull(), "inserted"), (F.col("_old.version") > F.col("_new.version"), "kept_newer"), (F.col("_old.digest") == F.col("_new.digest"), "unchanged"), otherwise="replaced")
    marked = rows.withColumn("action", action)
    out = F.when(F.col("action").isin("inserted", "replaced"), F.col("_new")).otherwise(F.col("_old"))
    return marked.select(key, "action", F.when(F.col("action") != "swept", out).alias("_r")).select(key, "action", "_r.version", "_r.payload")


def activations(requests: DataFrame) -> DataFrame:
    """What a trigger leads to: the purpose, the limit (twice for the deep ones, 100 at most), and skip for an empty text.

    ``requests``: request_id, trigger, purpose (or null), text, limit, available (whether recall answers).
    """
    trigger = F.col("trigger")
    purpose = F.coalesce("purpose", F.when(trigger == "checkpoint_resume", "handoff_recovery").when(trigger.isin("tool_error", "repeated_failure"), "planning").when(trigger == "explicit", "interactive_recall").otherwise("task_bootstrap"))
    deep = trigger.isin("tool_error", "repeated_failure", "checkpoint_resume")
    empty = F.trim(F.substring(F.coalesce("text", F.lit("")), 1, 8192)) == ""
    decision = _verdict((empty, "skip"), (~F.col("available"), "defer"), otherwise="recall")
    return requests.select("request_id", purpose.alias("purpose"), decision.alias("decision"), F.when(decision == "recall", F.least(F.lit(100), F.col("limit") * F.when(deep, 2).otherwise(1))).alias("limit"))


def joined(rows: DataFrame, joins: DataFrame, keys: list[str]) -> DataFrame:
    """Registrations after joins: a new key starts at version 1, each further join adds one."""
    n = joins.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("at").alias("_at"))
    both = rows.select(*keys, F.col("version").alias("_v"), F.col("seen_at").alias("_seen")).join(n, keys, "full_outer")
    return both.select(*keys, (F.coalesce("_v", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("version"), F.greatest("_seen", "_at").alias("seen_at"), F.col("_v").isNull().alias("is_new"))
