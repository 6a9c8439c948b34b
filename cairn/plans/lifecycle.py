"""Registered life-cycle queries and their SQL: orders stand for tasks, items for leases, commands and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import lifecycle
from cairn.sources.tables import load, with_views

NOW = "1997-01-01"
#: An item's own number as a command: orders of any number, parts up to a hundred million.
COMMAND_ID = "l_orderkey * 1000000000 + l_partkey * 10 + l_linenumber"


def _command_id():
    return F.expr(COMMAND_ID)


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _tasks(spark, sf_dir):
    return load(spark, sf_dir, "tasks").withColumn("tags", F.array(F.concat(F.lit("p"), F.col("task_id") % 2), F.concat(F.lit("q"), F.col("task_id") % 3)))


def task_claims(spark, sf_dir):
    """Three agents of every run ask: the first for any task, the others for one tag."""
    tasks = _tasks(spark, sf_dir)
    agents = tasks.select("run_id").distinct().select("run_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("_k"))
    agents = agents.select((F.col("run_id") * 10 + F.col("_k")).alias("agent_id"), "run_id", F.when(F.col("_k") > 1, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    needs = tasks.where("needs IS NOT NULL AND task_id % 4 = 0").select("task_id", "needs")
    return lifecycle.claim(tasks, needs, agents, _now())


CLAIM_SQL = f"""WITH f AS (SELECT t.* FROM tasks t WHERE state IN ('pending', 'ready') AND (available_at IS NULL OR available_at <= TIMESTAMP '{NOW}') AND NOT (needs IS NOT NULL AND task_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM tasks p WHERE p.task_id = t.needs AND p.run_id = t.run_id AND p.state = 'completed'))),
g AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY priority DESC, coalesce(available_at, created_at), created_at, task_id) AS g FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY g) AS n FROM g WHERE g > 1 AND task_id % 2 = 1),
a AS (SELECT run_id, k, run_id * 10 + k AS agent_id FROM (SELECT DISTINCT run_id FROM tasks), (VALUES (1), (2), (3)) v(k)),
t AS (SELECT a.agent_id, a.run_id, CASE WHEN k = 1 THEN g.task_id ELSE r.task_id END AS task_id FROM a LEFT JOIN g ON g.run_id = a.run_id AND k = 1 AND g.g = 1 LEFT JOIN r ON r.run_id = a.run_id AND n = k - 1)
SELECT *, CASE WHEN task_id IS NULL THEN 'no_task_available' ELSE 'claimed' END AS outcome FROM t"""


def claim_misses(spark, sf_dir):
    item = load(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    commands = item.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("command_id"), F.col("l_orderkey").alias("task_id"), (F.col("l_suppkey") % 4).alias("expected_version"), (F.col("l_partkey") % 3 == 0).alias("_lost"))
    rows = commands.join(load(spark, sf_dir, "tasks").select("task_id", "run_id"), "task_id").withColumn("run_id", F.when(F.col("_lost"), -1).otherwise(F.col("run_id"))).drop("_lost")
    return lifecycle.claim_misses(rows, load(spark, sf_dir, "tasks"))


MISS_SQL = """SELECT l_orderkey * 8 + l_linenumber AS command_id, task_id, CASE WHEN l_partkey % 3 = 0 THEN 'not_found' WHEN l_suppkey % 4 <> version THEN 'version_changed' WHEN state NOT IN ('pending', 'ready') THEN 'no_task_available' ELSE 'contention' END AS reason FROM lineitem JOIN tasks ON l_orderkey = task_id WHERE l_linenumber <= 2"""


def _held(spark, sf_dir):
    return load(spark, sf_dir, "tasks").select("task_id", "state", (F.col("task_id") * 2).alias("lease_id"), (F.col("created_at") + F.expr("INTERVAL 60 DAY")).alias("expires_at"), "version")


def lease_expiry(spark, sf_dir):
    """Tasks after all leases that have run out are released."""
    held = _held(spark, sf_dir)
    leases = held.where("state = 'claimed'").select("lease_id", "task_id", F.when(F.col("task_id") % 3 == 0, "released").otherwise("active").alias("status"), "expires_at", "version")
    return lifecycle.expire(leases, held.select("task_id", "state", "version", F.when(F.col("state") == "claimed", F.col("lease_id")).alias("lease_id")), _now())[1]


EXPIRY_SQL = f"""SELECT task_id, CASE WHEN state = 'claimed' AND task_id % 3 <> 0 AND created_at + INTERVAL 60 DAY <= TIMESTAMP '{NOW}' THEN 'ready' ELSE state END AS state, version + CASE WHEN state = 'claimed' AND task_id % 3 <> 0 AND created_at + INTERVAL 60 DAY <= TIMESTAMP '{NOW}' THEN 1 ELSE 0 END AS version,
CASE WHEN state = 'claimed' AND NOT (task_id % 3 <> 0 AND created_at + INTERVAL 60 DAY <= TIMESTAMP '{NOW}') THEN task_id * 2 END AS lease_id FROM tasks"""


def task_endings(spark, sf_dir):
    """Items as commands of their order's agent: checkpoints, completions and releases; of an order's items with one part and number the least counts."""
    item = load(spark, sf_dir, "lineitem")
    commands = item.select(_command_id().alias("command_id"), F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") * 2 + (F.col("l_suppkey") % 5 == 0).cast("int")).alias("lease_id"), F.when(F.col("l_returnflag") == "R", "complete").when(F.col("l_suppkey") % 4 == 1, "release").otherwise("checkpoint").alias("action"), F.col("l_shipdate").alias("at"))
    least = commands.groupBy("command_id", "task_id").agg(F.min(F.struct("lease_id", "action", "at")).alias("_c"))
    return lifecycle.finish(least.select("command_id", "task_id", "_c.*"), _held(spark, sf_dir))


ENDING_SQL = f"""WITH c AS (SELECT DISTINCT ON (command_id, task_id) * FROM (SELECT {COMMAND_ID} AS command_id, l_orderkey AS task_id, l_orderkey * 2 + CAST(l_suppkey % 5 = 0 AS INTEGER) AS lease_id, CASE WHEN l_returnflag = 'R' THEN 'complete' WHEN l_suppkey % 4 = 1 THEN 'release' ELSE 'checkpoint' END AS act, l_shipdate AS moment FROM lineitem) ORDER BY command_id, lease_id, act, moment),
j AS (SELECT c.*, t.version AS v, coalesce(t.state = 'claimed' AND t.task_id * 2 = c.lease_id AND moment < t.created_at + INTERVAL 60 DAY, false) AS ok FROM c LEFT JOIN tasks t ON c.task_id = t.task_id),
e AS (SELECT *, coalesce(sum(CAST(ok AND act <> 'checkpoint' AS INTEGER)) OVER (PARTITION BY task_id ORDER BY moment, command_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS ended FROM j)
SELECT command_id, task_id, CASE WHEN v IS NULL THEN 'not_found' WHEN NOT ok THEN 'lease_lost' WHEN ended THEN 'already_ended' ELSE act END AS outcome, CAST(CASE WHEN ok AND NOT ended AND act = 'checkpoint' THEN sum(CAST(ok AND NOT ended AND act = 'checkpoint' AS INTEGER)) OVER w END AS BIGINT) AS sequence,
CAST(v + sum(CAST(ok AND NOT ended AND act <> 'checkpoint' AS INTEGER)) OVER w AS BIGINT) AS version FROM e WINDOW w AS (PARTITION BY task_id ORDER BY moment, command_id ROWS UNBOUNDED PRECEDING)"""


def work_retries(spark, sf_dir):
    item = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    work = load(spark, sf_dir, "tasks").select(F.col("task_id").alias("work_id"), (F.col("task_id") % 5).alias("attempts"), F.lit(3).alias("max_attempts"), F.when(F.col("state") == "claimed", "leased").otherwise("queued").alias("status"), "version")
    return lifecycle.retry_or_fail(item.select(F.col("l_orderkey").alias("work_id"), F.col("l_shipdate").alias("retry_at"), F.concat(F.lit("e"), F.col("l_linenumber")).alias("error")), work)


RETRY_SQL = """WITH f AS (SELECT l_orderkey AS work_id, max({'retry_at': l_shipdate, 'error': 'e' || l_linenumber}) AS f FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT task_id AS work_id, task_id % 5 AS attempts, CASE WHEN f IS NOT NULL AND state = 'claimed' THEN CASE WHEN task_id % 5 < 3 THEN 'retry' ELSE 'failed' END WHEN state = 'claimed' THEN 'leased' ELSE 'queued' END AS status, CASE WHEN f IS NOT NULL AND state = 'claimed' AND task_id % 5 < 3 THEN f.retry_at END AS available_at,
CASE WHEN f IS NOT NULL AND state = 'claimed' THEN f.error END AS last_error, version + CASE WHEN f IS NOT NULL AND state = 'claimed' THEN 1 ELSE 0 END AS version FROM tasks LEFT JOIN f ON work_id = task_id"""


def queue_counts(spark, sf_dir):
    """Tasks of each run by state, and whether any is left."""
    rows = load(spark, sf_dir, "tasks")
    return rows.groupBy("run_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("pending", "ready", "claimed", "completed", "failed")], F.count_if(F.col("state").isin("pending", "ready", "claimed")).alias("left"), F.max_by("state", F.struct("created_at", "task_id")).alias("newest"))


COUNT_SQL = """SELECT run_id, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state = 'ready') AS ready, count(*) FILTER (WHERE state = 'claimed') AS claimed, count(*) FILTER (WHERE state = 'completed') AS completed, count(*) FILTER (WHERE state = 'failed') AS failed,
count(*) FILTER (WHERE state IN ('pending', 'ready', 'claimed')) AS "left", arg_max(state, {'c': created_at, 't': task_id}) AS newest FROM tasks GROUP BY 1"""


def task_additions(spark, sf_dir):
    """Items as tasks to be added: those of a part with an order's key are there already, some with the title as a note."""
    item = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("task_id"), F.max("l_returnflag").alias("t"))
    odd = F.col("l_orderkey") % 5 == 0
    rows = item.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("command_id"), "task_id", F.when(~odd, F.col("t")).alias("title"), F.when(odd, F.col("t")).alias("note"))
    there = load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "R").otherwise("A").alias("title"), F.lit(None).cast("string").alias("note"))
    return lifecycle.additions(rows, there, "task_id")


ADDITION_SQL = """WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS command_id, max(l_partkey) AS task_id, CASE WHEN l_orderkey % 5 <> 0 THEN max(l_returnflag) END AS title, CASE WHEN l_orderkey % 5 = 0 THEN max(l_returnflag) END AS note FROM lineitem GROUP BY l_orderkey, l_linenumber),
m AS (SELECT r.*, o_orderkey IS NOT NULL AS there, CASE o_orderstatus WHEN 'F' THEN 'R' ELSE 'A' END AS old, first_value(title) OVER w AS f, first_value(note) OVER w AS g, row_number() OVER w AS n FROM r LEFT JOIN orders ON o_orderkey = task_id AND o_orderkey % 3 = 0 WINDOW w AS (PARTITION BY task_id ORDER BY command_id))
SELECT command_id, task_id, CASE WHEN NOT there AND n = 1 THEN 'added' WHEN title IS NOT DISTINCT FROM (CASE WHEN there THEN old ELSE f END) AND note IS NOT DISTINCT FROM (CASE WHEN NOT there THEN g END) THEN 'replayed' ELSE 'conflict' END AS outcome FROM m"""


def memory_decisions(spark, sf_dir):
    """Parts as new memories: each replaces the part of half its key, or stands alone."""
    part = load(spark, sf_dir, "part")
    commands = part.select(F.col("p_partkey").alias("command_id"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "))).otherwise(F.col("p_name")).alias("content"), F.when(F.col("p_size") % 2 == 0, "confirmed").otherwise("tentative").alias("state"), (F.col("p_size") % 3).alias("n_evidence"), F.when(F.col("p_partkey") % 3 > 0, F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey")).otherwise(F.floor(F.col("p_partkey") / 2))).alias("target"))
    return lifecycle.decide(commands, part.where("p_size > 5").select(F.col("p_partkey").alias("memory_id"), F.col("p_name").alias("content"), F.when(F.col("p_size") % 4 == 0, "confirmed").otherwise("tentative").alias("state")))


DECISION_SQL = """WITH c AS (SELECT *, CASE WHEN p_partkey % 3 > 0 THEN CASE WHEN p_partkey % 5 = 0 THEN p_partkey ELSE p_partkey // 2 END END AS target FROM part),
j AS (SELECT c.*, o.p_name AS old, CASE WHEN o.p_size % 4 = 0 THEN 'confirmed' WHEN o.p_size IS NOT NULL THEN 'tentative' END AS s FROM c LEFT JOIN part o ON o.p_partkey = target AND o.p_size > 5),
k AS (SELECT *, CASE WHEN target IS NULL THEN 1 WHEN s IS NULL THEN 2 WHEN lower(p_name) = lower(old) THEN 3 WHEN s = 'confirmed' AND (p_size % 2 <> 0 OR p_size % 3 = 0) THEN 4 ELSE 5 END AS w FROM j)
SELECT p_partkey AS command_id, target, list_extract(['add', 'noop', 'merge', 'noop', 'update'], w) AS operation, list_extract(['independent', 'target_not_current', 'exact_memory_exists', 'confirmed_needs_confirmed_evidence', 'supersedes'], w) AS reason FROM k"""


def _reviews(spark, sf_dir):
    """Items as reviews; of an order's items with one part and number the least counts."""
    item = load(spark, sf_dir, "lineitem").select(_command_id().alias("command_id"), F.col("l_orderkey").alias("memory_id"), (F.col("l_suppkey") % 4).alias("expected_version"), F.when(F.col("l_returnflag") == "R", "refuted").otherwise("confirmed").alias("decision"))
    return item.groupBy("command_id", "memory_id").agg(F.min(F.struct("expected_version", "decision")).alias("_c")).select("command_id", "memory_id", "_c.*")


_REVIEWS = f"c AS (SELECT DISTINCT ON (command_id, memory_id) * FROM (SELECT {COMMAND_ID} AS command_id, l_orderkey AS memory_id, l_suppkey % 4 AS e, CASE WHEN l_returnflag = 'R' THEN 'refuted' ELSE 'confirmed' END AS decision FROM lineitem) ORDER BY command_id, e, decision)"


def memory_reviews(spark, sf_dir):
    rows = load(spark, sf_dir, "memories").where("recorded_to IS NULL").select("memory_id", "state", (F.col("memory_id") % 4).alias("version"))
    return lifecycle.review(_reviews(spark, sf_dir), rows, "memory_id")


#: The reviews that are applied to a memory, one after the other, then what each review finds.
_CHAIN = """ch AS (SELECT id, CAST(v AS BIGINT) AS v, s, CAST(-1 AS BIGINT) AS last FROM m UNION ALL
 SELECT id, v + 1, decision, command_id FROM (SELECT ch.id, ch.v, c.decision, c.command_id, row_number() OVER (PARTITION BY ch.id ORDER BY c.command_id) AS n FROM ch JOIN c ON c.memory_id = ch.id AND c.e = ch.v AND c.command_id > ch.last AND ch.s <> '{final}') WHERE n = 1)
SELECT c.command_id, c.memory_id, CASE WHEN ch.id IS NULL THEN 'not_found' WHEN ch.last = c.command_id THEN 'reviewed' WHEN ch.s = '{final}' THEN 'terminal' ELSE 'version_changed' END AS outcome, ch.s AS state, ch.v AS version FROM c ASOF LEFT JOIN ch ON ch.id = c.memory_id AND c.command_id >= ch.last"""
REVIEW_SQL = f"""WITH RECURSIVE {_REVIEWS}, m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'tentative' ELSE 'refuted' END AS s, o_orderkey % 4 AS v FROM orders WHERE o_orderkey % 5 <> 0), {_CHAIN.format(final="none")}"""


def source_reviews(spark, sf_dir):
    """Reviews of sources, where refuted is final."""
    rows = load(spark, sf_dir, "memories").select("memory_id", "state", (F.col("memory_id") % 4).alias("version"))
    return lifecycle.review(_reviews(spark, sf_dir), rows, "memory_id", terminal="refuted")


SOURCE_SQL = f"""WITH RECURSIVE {_REVIEWS}, m AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'tentative' ELSE 'refuted' END AS s, o_orderkey % 4 AS v FROM orders), {_CHAIN.format(final="refuted")}"""


def memory_conflicts(spark, sf_dir):
    """Items as reports of a part and a supplier, or as resolutions for one of them, or for neither."""
    item = load(spark, sf_dir, "lineitem")
    reports = item.where("l_linenumber <= 4").select(F.col("l_partkey").alias("left"), F.col("l_suppkey").alias("right"), F.col("l_shipdate").alias("at"))
    closed = item.where("l_linenumber > 4").select(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right"), F.when(F.col("l_returnflag") == "R", F.col("l_partkey")).when(F.col("l_returnflag") == "A", F.col("l_suppkey")).otherwise(0).alias("winner"), F.col("l_shipdate").alias("at"))
    return lifecycle.conflicts(reports, closed)


CONFLICT_SQL = """WITH o AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, min(l_shipdate) AS d, count(*) AS n FROM lineitem WHERE l_linenumber <= 4 AND l_partkey <> l_suppkey GROUP BY 1, 2),
w AS (SELECT l_suppkey AS x, l_partkey AS y, CASE l_returnflag WHEN 'R' THEN l_partkey WHEN 'A' THEN l_suppkey ELSE 0 END AS winner, l_shipdate AS d FROM lineitem WHERE l_linenumber > 4),
c AS (SELECT o.a, o.b, min({'d': w.d, 'w': winner}) AS r FROM w JOIN o ON o.a = least(x, y) AND o.b = greatest(x, y) AND w.d >= o.d WHERE winner IN (x, y) GROUP BY 1, 2)
SELECT o.a, o.b, n AS n_reports, CASE WHEN r IS NOT NULL THEN 'resolved' ELSE 'open' END AS state, r.w AS winner FROM o LEFT JOIN c ON o.a = c.a AND o.b = c.b"""


def derived_evidence(spark, sf_dir):
    """Every order derives from itself and the order of the next key; it proposes its own first items as evidence, some of them changed."""
    item = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("digest"))
    o = load(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("proposal_id"))
    proposals = o.select("proposal_id", F.explode(F.when(F.col("proposal_id") % 2 == 0, F.array(F.col("proposal_id"))).otherwise(F.array(F.col("proposal_id"), F.col("proposal_id") + 1))).alias("source"))
    memories = load(spark, sf_dir, "memories").select("memory_id", "state")
    evidence = item.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("memory_id"), F.col("l_linenumber").alias("evidence_id"), "digest")
    proposed = item.where("l_linenumber <= 2 OR digest % 2 = 0").join(o, F.col("l_orderkey") == F.col("proposal_id")).select("proposal_id", F.col("l_linenumber").alias("evidence_id"), F.when(F.col("digest") % 7 == 0, -1).otherwise(F.col("digest")).alias("digest"))
    return lifecycle.derivable(proposals, proposed, memories, evidence)


DERIVED_SQL = """WITH i AS (SELECT l_orderkey AS k, l_linenumber AS e, max(l_partkey) AS d FROM lineitem GROUP BY 1, 2), p AS (SELECT o_orderkey AS id, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [o_orderkey] ELSE [o_orderkey, o_orderkey + 1] END) AS source FROM orders WHERE o_orderkey % 3 = 0),
q AS (SELECT k AS id, e, CASE WHEN d % 7 = 0 THEN -1 ELSE d END AS d FROM i WHERE (e <= 2 OR d % 2 = 0) AND k IN (SELECT id FROM p)), v AS (SELECT * FROM i WHERE e <= 3),
s AS (SELECT p.id, p.source, count(*) AS n, bool_and(v.d = q.d) AS same FROM p JOIN v ON v.k = p.source JOIN q ON q.id = p.id AND q.e = v.e GROUP BY 1, 2),
g AS (SELECT p.id, bool_and(coalesce(o_orderstatus = 'F', false)) AS conf, bool_and(n IS NOT NULL) AS touch, bool_and(coalesce(same, true)) AS same FROM p LEFT JOIN orders ON o_orderkey = p.source LEFT JOIN s ON s.id = p.id AND s.source = p.source GROUP BY 1),
x AS (SELECT DISTINCT q.id FROM q WHERE NOT EXISTS (SELECT 1 FROM p JOIN v ON v.k = p.source WHERE p.id = q.id AND v.e = q.e AND v.d = q.d))
SELECT g.id AS proposal_id, CASE WHEN NOT conf THEN 'source_not_confirmed' WHEN NOT touch THEN 'source_without_shared_evidence' WHEN NOT same THEN 'evidence_changed' WHEN x.id IS NOT NULL THEN 'unsupported_evidence' ELSE 'derivable' END AS verdict FROM g LEFT JOIN x ON g.id = x.id"""


def projection_rebuild(spark, sf_dir):
    """Customers as canonical rows; a projection of them that is partly old, newer, or of customers that are gone."""
    c = load(spark, sf_dir, "customer")
    new = c.where("c_custkey % 7 <> 0").select("c_custkey", (F.col("c_custkey") % 4).alias("version"), F.md5("c_name").alias("digest"), F.col("c_name").alias("payload"))
    old = c.where("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_custkey") % 3).alias("version"), F.when(F.col("c_custkey") % 2 == 0, F.md5("c_name")).otherwise(F.lit("")).alias("digest"), F.lower("c_name").alias("payload"))
    return lifecycle.project(old, new, "c_custkey")


PROJECT_SQL = """WITH j AS (SELECT *, c_custkey % 7 <> 0 AS n, c_custkey % 5 <> 0 AS o, c_custkey % 4 AS nv, c_custkey % 3 AS ov FROM customer),
a AS (SELECT *, CASE WHEN NOT n THEN 'swept' WHEN NOT o THEN 'inserted' WHEN ov > nv THEN 'kept_newer' WHEN c_custkey % 2 = 0 THEN 'unchanged' ELSE 'replaced' END AS action FROM j WHERE n OR o)
SELECT c_custkey, action, CASE WHEN action IN ('inserted', 'replaced') THEN nv WHEN action <> 'swept' THEN ov END AS version, CASE WHEN action IN ('inserted', 'replaced') THEN c_name WHEN action <> 'swept' THEN lower(c_name) END AS payload FROM a"""


def activation_decisions(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    triggers = {"signup": "task_claim", "purchase": "checkpoint_resume", "error": "tool_error", "view": "explicit", "click": "dependency_unblocked"}
    trigger = F.create_map(*[F.lit(x) for kv in triggers.items() for x in kv])[F.col("event_type")]
    rows = e.select(F.col("event_id").alias("request_id"), trigger.alias("trigger"), F.when(F.col("event_id") % 11 == 0, "conflict_review").alias("purpose"), F.when(F.col("event_id") % 13 == 0, "   ").when(F.col("event_id") % 17 != 0, F.col("props")).alias("text"), (F.col("user_id") % 90 + 1).cast("int").alias("limit"), (F.col("event_id") % 19 != 0).alias("available"))
    return lifecycle.activations(rows)


ACTIVATION_SQL = """WITH r AS (SELECT *, CASE WHEN event_id % 13 = 0 OR event_id % 17 = 0 THEN 'skip' WHEN event_id % 19 = 0 THEN 'defer' ELSE 'recall' END AS d FROM events)
SELECT event_id AS request_id, CASE WHEN event_id % 11 = 0 THEN 'conflict_review' ELSE CASE event_type WHEN 'purchase' THEN 'handoff_recovery' WHEN 'error' THEN 'planning' WHEN 'view' THEN 'interactive_recall' ELSE 'task_bootstrap' END END AS purpose, d AS decision,
CAST(CASE WHEN d = 'recall' THEN least(100, (user_id % 90 + 1) * CASE WHEN event_type IN ('purchase', 'error') THEN 2 ELSE 1 END) END AS INTEGER) AS "limit" FROM r"""


def agent_joins(spark, sf_dir):
    """Users join once an event; those with a key under 50 are registered already."""
    e = load(spark, sf_dir, "events")
    there = e.where("user_id < 50").groupBy("user_id").agg(F.lit(3).cast("long").alias("version"), F.min("ts").alias("seen_at"))
    return lifecycle.joined(there, e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("at")), ["user_id"])


JOIN_SQL = """WITH o AS (SELECT user_id, min(ts) AS s FROM events WHERE user_id < 50 GROUP BY 1), n AS (SELECT user_id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT coalesce(o.user_id, n.user_id) AS user_id, CASE WHEN o.user_id IS NULL THEN 0 ELSE 3 END + coalesce(n, 0) AS version, CASE WHEN s IS NULL OR t > s THEN coalesce(t, s) ELSE s END AS seen_at, o.user_id IS NULL AS is_new FROM o FULL JOIN n ON o.user_id = n.user_id"""

QUERIES = {f.__name__: f for f in (task_claims, claim_misses, lease_expiry, task_endings, work_retries, queue_counts, task_additions, memory_decisions, memory_reviews, source_reviews, memory_conflicts, derived_evidence, projection_rebuild, activation_decisions, agent_joins)}
ORACLES = {"task_additions": ADDITION_SQL, "memory_decisions": DECISION_SQL, "memory_reviews": REVIEW_SQL, "source_reviews": SOURCE_SQL, "memory_conflicts": CONFLICT_SQL, "derived_evidence": DERIVED_SQL, "projection_rebuild": PROJECT_SQL, "activation_decisions": ACTIVATION_SQL, "agent_joins": JOIN_SQL}
ORACLES |= {name: with_views(sql, "tasks") for name, sql in {"task_claims": CLAIM_SQL, "claim_misses": MISS_SQL, "lease_expiry": EXPIRY_SQL, "task_endings": ENDING_SQL, "work_retries": RETRY_SQL, "queue_counts": COUNT_SQL}.items()}
