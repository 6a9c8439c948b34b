"""Registered report queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import evaluation, reports
from cairn.sources.tables import load, typed, with_views

NOW = "1997-01-01"
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_percentiles(spark, sf_dir):
    """Prices of items by flag: percentiles at the nearest place and by index."""
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    near = reports.percentiles(rows, "l_returnflag", "l_extendedprice", SHARES, "nearest")
    index = reports.percentiles(rows, "l_returnflag", "l_extendedprice", SHARES, "index").select("l_returnflag", *[F.col(k).alias(f"{k}_index") for k in SHARES])
    return near.join(index, "l_returnflag")


PERCENTILE_SQL = """WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, max(n) AS n, max(v) FILTER (WHERE k = round_even(0.5 * (n - 1), 0)) AS p50, max(v) FILTER (WHERE k = round_even(0.95 * (n - 1), 0)) AS p95, max(v) FILTER (WHERE k = round_even(0.99 * (n - 1), 0)) AS p99,
max(v) FILTER (WHERE k = least(n - 1, floor(0.5 * n))) AS p50_index, max(v) FILTER (WHERE k = least(n - 1, floor(0.95 * n))) AS p95_index, max(v) FILTER (WHERE k = least(n - 1, floor(0.99 * n))) AS p99_index FROM r GROUP BY 1"""


def _points(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("name"), (F.col("p_retailprice") / 8).alias("latency"), F.col("p_size").cast("double").alias("accuracy"))


POINTS = "p AS (SELECT p_brand, p_partkey AS name, p_retailprice / 8 AS latency, CAST(p_size AS DOUBLE) AS accuracy FROM part), f AS (SELECT * FROM (SELECT *, max(accuracy) OVER (PARTITION BY p_brand ORDER BY latency, accuracy DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM p) WHERE b IS NULL OR accuracy > b)"


def pareto_frontier(spark, sf_dir):
    return reports.pareto(_points(spark, sf_dir), "p_brand")


def log_latency_area(spark, sf_dir):
    return reports.log_area(_points(spark, sf_dir), "p_brand")


AREA_SQL = f"""WITH {POINTS}, s AS (SELECT *, greatest(1.0, latency) AS l, least(200.0, coalesce(lead(latency) OVER (PARTITION BY p_brand ORDER BY latency), 200.0)) AS r FROM f)
SELECT p_brand, round(sum(CASE WHEN r > l THEN accuracy * ln(r / l) ELSE 0 END) / ln(200.0), 6) AS log_area, count(*) AS n_points FROM s GROUP BY 1"""


def sign_tests(spark, sf_dir):
    """Paired prices of two flags by brand."""
    item = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    arm = lambda flag: item.where(F.col("l_returnflag") == flag).groupBy("l_partkey", "p_brand").agg(F.max("l_quantity").alias("v"))
    rows = evaluation.paired(arm("R"), arm("A"), "l_partkey", "v", "p_brand")
    return rows.select("p_brand", "wins", "losses", F.round(reports.sign_test(F.col("wins"), F.col("losses")), 6).alias("p_value"))


SIGN_SQL = """WITH m AS (SELECT p_brand, l_partkey, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS b, max(l_quantity) FILTER (WHERE l_returnflag = 'A') AS t FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2),
c AS (SELECT p_brand, count(*) FILTER (WHERE t > b) AS wins, count(*) FILTER (WHERE t < b) AS losses FROM m GROUP BY 1),
k AS (SELECT c.*, unnest(range(wins, wins + losses + 1)) AS k FROM c WHERE wins > losses), s AS (SELECT p_brand, sum(exp(lgamma(wins + losses + 1) - lgamma(k + 1) - lgamma(wins + losses - k + 1) - (wins + losses) * ln(2))) AS p FROM k GROUP BY 1)
SELECT c.p_brand, wins, losses, round(CASE WHEN wins <= losses THEN 1 ELSE p END, 6) AS p_value FROM c LEFT JOIN s ON c.p_brand = s.p_brand"""


def arm_dominance(spark, sf_dir):
    """Items of flag R against those of flag A by part size: accuracy, dearest item and greatest quantity."""
    item = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    side = lambda flag, p: item.where(F.col("l_returnflag") == flag).groupBy("p_size").agg(F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 6).alias(f"{p}_accuracy"), F.max("l_extendedprice").alias(f"{p}_cost"), F.max("l_quantity").alias(f"{p}_tokens"))
    return reports.dominated(side("R", "b").join(side("A", "c"), "p_size"), "p_size", ["accuracy"], ["cost", "tokens"])


DOMINANCE_SQL = """WITH s AS (SELECT p_size, l_returnflag AS f, round(avg(CAST(l_discount > 0.05 AS INTEGER)), 6) AS a, max(l_extendedprice) AS c, max(l_quantity) AS t FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT b.p_size, b.a >= c.a AND b.c <= c.c AND b.t <= c.t AND (b.a > c.a OR b.c < c.c OR b.t < c.t) AS dominated FROM s b JOIN s c ON b.p_size = c.p_size AND b.f = 'R' AND c.f = 'A'"""


def _calls(spark, sf_dir):
    """Orders as tasks: the right tool is the priority, items name its arguments; a third of the calls go wrong somewhere."""
    item = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id"), "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    key = F.concat(F.lit("a"), F.col("l_linenumber"))
    maps = lambda rows, v: rows.groupBy("task_id").agg(F.map_from_entries(F.collect_list(F.struct(key, v))).alias("arguments"))
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderpriority").alias("tool"))
    wrong = F.when(F.col("s") % 4 == 0, F.concat(F.lit('"'), F.col("p"), F.lit('"'))).otherwise(F.col("p").cast("string"))
    gold = maps(item.where("l_linenumber <= 4"), F.col("p").cast("string")).join(o, "task_id")
    given = maps(item.where("l_linenumber <> 2"), wrong).join(o, "task_id").withColumn("tool", F.when(F.col("task_id") % 6 == 0, "none").otherwise(F.col("tool"))).where("task_id % 11 <> 0")
    return gold, given


def slot_scores(spark, sf_dir):
    rows = reports.slot_scores(*_calls(spark, sf_dir))
    return rows.select("task_id", "tool_correct", "exact", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_SLOTS = """i AS (SELECT l_orderkey AS id, l_linenumber AS k, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
c AS (SELECT id, count(*) FILTER (WHERE k <= 4) AS g, CASE WHEN id % 11 <> 0 THEN count(*) FILTER (WHERE k <> 2) ELSE 0 END AS n, CASE WHEN id % 11 <> 0 AND id % 6 <> 0 THEN count(*) FILTER (WHERE k <= 4 AND k <> 2 AND s % 4 <> 0) ELSE 0 END AS tp, CAST(id % 11 <> 0 AND id % 6 <> 0 AND count(*) FILTER (WHERE k <> 2) > 0 AS INTEGER) AS ok FROM i GROUP BY 1 HAVING g > 0),
z AS (SELECT id AS task_id, ok AS tool_correct, tp, n - tp AS fp, g - tp AS fn, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS precision, tp / g AS recall FROM c), y AS (SELECT *, CAST(tool_correct = 1 AND fp = 0 AND fn = 0 AS INTEGER) AS exact, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM z)"""
SLOT_SQL = f"WITH {_SLOTS} SELECT task_id, tool_correct, exact, CAST(tp AS INTEGER) AS tp, CAST(fp AS INTEGER) AS fp, CAST(fn AS INTEGER) AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM y"


def arm_scores(spark, sf_dir):
    """Micro and macro scores of five arms (the customer's key); calls that are missing are failures."""
    rows = reports.slot_scores(*_calls(spark, sf_dir)).withColumn("arm", (F.col("task_id") % 5).cast("int")).withColumn("failure", F.when(F.col("task_id") % 11 == 0, "no_call"))
    return reports.arm_scores(rows, "arm")


ARM_SQL = f"""WITH {_SLOTS} SELECT CAST(task_id % 5 AS INTEGER) AS arm, count(*) AS tasks, count(*) FILTER (WHERE task_id % 11 = 0) AS failures, round(avg(tool_correct), 6) AS tool_accuracy, round(avg(exact), 6) AS exact_accuracy, round(sum(tp) / sum(tp + fp), 6) AS micro_precision, round(sum(tp) / sum(tp + fn), 6) AS micro_recall,
round(2 * (sum(tp) / sum(tp + fp)) * (sum(tp) / sum(tp + fn)) / (sum(tp) / sum(tp + fp) + sum(tp) / sum(tp + fn)), 6) AS micro_f1, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM y GROUP BY 1"""


def gate_checks(spark, sf_dir):
    """Payloads of events against a manifest of four checks, one of a path that is not there."""
    checks = spark.createDataFrame([("error", "$.k", "ge", 50.0), ("error", "$.k", "ne", 7.0), ("click", "$.k", "lt", 30.0), ("click", "$.missing", "eq", 1.0)], "gate string, path string, operator string, expected double")
    return reports.gates(load(spark, sf_dir, "events").select(F.col("event_type").alias("gate"), F.col("event_id").alias("id"), F.col("props").alias("payload")), checks)


GATE_SQL = """WITH c AS (SELECT * FROM (VALUES ('error', '$.k', 'ge', 50.0), ('error', '$.k', 'ne', 7.0), ('click', '$.k', 'lt', 30.0), ('click', '$.missing', 'eq', 1.0)) c(gate, path, operator, expected)),
a AS (SELECT gate, event_id AS id, path, operator, CAST(expected AS DOUBLE) AS expected, CASE WHEN path = '$.k' THEN CAST(props->>'$.k' AS DOUBLE) END AS actual FROM events JOIN c ON event_type = gate)
SELECT *, coalesce(CASE operator WHEN 'ge' THEN actual >= expected WHEN 'ne' THEN actual <> expected WHEN 'lt' THEN actual < expected ELSE actual = expected END, false) AS passed FROM a"""


def budget_splits(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("o_orderkey") % 3).cast("int")).alias("agents"), F.floor("o_totalprice").alias("tokens"), (F.col("o_custkey") % 10).alias("calls"))
    return reports.split_budget(o, ["tokens", "calls"])


SPLIT_SQL = """WITH o AS (SELECT o_orderkey, list_extract([1, 2, 4], o_orderkey % 3 + 1) AS agents, CAST(floor(o_totalprice) AS BIGINT) AS tokens, o_custkey % 10 AS calls FROM orders), s AS (SELECT *, unnest(range(1, agents + 1)) AS slot FROM o)
SELECT o_orderkey, agents, CAST(slot AS INTEGER) AS slot, tokens // agents + CASE WHEN slot <= tokens % agents THEN 1 ELSE 0 END AS tokens, calls // agents + CASE WHEN slot <= calls % agents THEN 1 ELSE 0 END AS calls FROM s"""


def seeded_samples(spark, sf_dir):
    return reports.seeded_sample(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderpriority", "o_orderkey", 20, 42)


SAMPLE_SQL = "SELECT o_orderkey, o_orderpriority, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 20"


def run_counters(spark, sf_dir):
    """Customers as runs, orders as tasks and memories, items as checkpoints, completions and activations."""
    tasks = load(spark, sf_dir, "tasks")
    lease = F.col("task_id") * 2
    leases = tasks.where("state IN ('claimed', 'failed')").select("run_id", "task_id", F.when(F.col("state") == "failed", "expired").otherwise("active").alias("status"), (F.col("created_at") + F.expr("INTERVAL 400 DAY")).alias("expires_at"))
    item = load(spark, sf_dir, "lineitem").join(tasks.select("run_id", "task_id"), F.col("l_orderkey") == F.col("task_id")).select("run_id", "task_id", "l_linenumber", lease.alias("lease_id"), (F.col("l_suppkey") % 3).alias("agent_id"), F.array(F.col("task_id") - F.col("l_partkey") % 3, F.col("task_id")).alias("memory_ids"), "l_partkey")
    plain = ["run_id", "task_id", "lease_id", "agent_id", "memory_ids"]
    ids = F.concat_ws(",", F.transform("memory_ids", lambda m: F.concat(F.lit('"'), m, F.lit('"'))))
    payload = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit('{"lease_id":"'), "lease_id", F.lit('"}'))).otherwise(F.concat(F.lit('{"lease_id":"'), "lease_id", F.lit('","memory_ids":['), ids, F.lit("]}")))
    activations = item.where("l_linenumber % 3 = 2").select("run_id", "task_id", "agent_id", payload.alias("payload"))
    memories = tasks.select(F.col("task_id").alias("memory_id"), "run_id", "task_id", (F.col("agent_id") % 3).alias("agent_id"), F.when(F.col("task_id") % 3 == 0, "repository").when(F.col("task_id") % 3 == 1, "run").otherwise("task").alias("visibility"), (F.col("task_id") % 5 > 0).alias("current"))
    attempts = item.select("run_id", F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey") % 10).alias("key"))
    return reports.run_metrics(tasks, leases, item.where("l_linenumber % 3 = 0").select(plain), item.where("l_linenumber % 3 = 1").select(plain), memories, activations, attempts, F.lit(NOW).cast("timestamp_ntz"))


RUN_SQL = f"""WITH i AS (SELECT run_id, task_id, l_linenumber % 3 AS kind, task_id * 2 AS lease, l_suppkey % 3 AS agent, [task_id - l_partkey % 3, task_id] AS ids, l_partkey AS p FROM lineitem JOIN tasks ON l_orderkey = task_id),
t AS (SELECT run_id, count(*) AS tasks_total, count(*) FILTER (WHERE state = 'claimed') AS tasks_claimed, count(*) FILTER (WHERE state = 'completed') AS tasks_completed, count(*) FILTER (WHERE state = 'failed') AS tasks_failed, count(*) FILTER (WHERE state = 'claimed' AND created_at + INTERVAL 400 DAY > TIMESTAMP '{NOW}') AS active_leases,
 count(*) FILTER (WHERE state = 'failed' AND task_id IN (SELECT task_id FROM i WHERE kind = 0)) AS crash_handoffs, count(*) FILTER (WHERE task_id % 5 > 0) AS memories_published FROM tasks GROUP BY 1),
k AS (SELECT run_id, count(*) FILTER (WHERE kind = 0) AS checkpoints, count(*) FILTER (WHERE kind = 2) AS activation_attempts, coalesce(sum(CASE WHEN p % 5 = 0 THEN 0 ELSE 2 END) FILTER (WHERE kind = 2), 0) AS memories_activated FROM i GROUP BY 1),
c AS (SELECT DISTINCT run_id, task_id, lease, agent, unnest(ids) AS m FROM i WHERE kind < 2), a AS (SELECT DISTINCT run_id, task_id, lease, agent, unnest(ids) AS m FROM i WHERE kind = 2 AND p % 5 <> 0),
u AS (SELECT c.run_id, count(*) AS cross_agent_uses FROM c JOIN tasks o ON o.task_id = c.m WHERE (o.task_id % 3 = 0 OR (o.run_id = c.run_id AND (o.task_id % 3 = 1 OR o.task_id = c.task_id))) AND o.agent_id % 3 <> c.agent AND EXISTS (SELECT 1 FROM a WHERE a.run_id = c.run_id AND a.task_id = c.task_id AND a.lease = c.lease AND a.agent = c.agent AND a.m = c.m) GROUP BY 1),
n AS (SELECT run_id, count(*) AS memories_cited FROM c GROUP BY 1), r AS (SELECT run_id, CAST(sum(x) AS BIGINT) AS replays FROM (SELECT run_id, p % 10 AS k, count(*) - 1 AS x FROM i WHERE p % 2 = 0 GROUP BY 1, 2) GROUP BY 1)
SELECT t.*, coalesce(checkpoints, 0) AS checkpoints, coalesce(memories_activated, 0) AS memories_activated, coalesce(activation_attempts, 0) AS activation_attempts, coalesce(memories_cited, 0) AS memories_cited, coalesce(cross_agent_uses, 0) AS cross_agent_uses, coalesce(replays, 0) AS replays FROM t LEFT JOIN k USING (run_id) LEFT JOIN n USING (run_id) LEFT JOIN u USING (run_id) LEFT JOIN r USING (run_id)"""


def outcome_associations(spark, sf_dir):
    """Items of an order: the first are completions, the others activations; a memory is a part."""
    item = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), (F.col("l_orderkey") % 5).alias("lease_id"), (F.col("l_suppkey") % 2).alias("agent_id"), "l_linenumber", (F.col("l_partkey") % 4).alias("m"), "l_returnflag", (F.col("l_suppkey") % 3).alias("v"))
    completions = item.where("l_linenumber <= 3").select("task_id", "lease_id", "agent_id", F.array(F.col("m"), F.col("m"), F.lit(3).cast("long")).alias("memory_ids"), F.when(F.col("l_returnflag") == "R", "failure").otherwise("success").alias("outcome"))
    activations = item.where("l_linenumber > 3").select("task_id", "lease_id", "agent_id", F.create_map("m", "v").alias("versions"))
    memories = load(spark, sf_dir, "part").select((F.col("p_partkey") % 4).alias("memory_id"), (F.col("p_size") % 3).cast("long").alias("version")).distinct().withColumn("recallable", (F.col("memory_id") + F.col("version")) % 2 == 0)
    rows = reports.outcome_associations(completions, activations, memories)
    return rows.groupBy("memory_id", "version", "outcome").agg(F.count("*").alias("n"), F.count_distinct("task_id").alias("n_tasks"))


OUTCOME_SQL = """WITH i AS (SELECT l_orderkey AS t, l_suppkey % 2 AS a, l_linenumber AS k, l_partkey % 4 AS m, l_suppkey % 3 AS v, CASE WHEN l_returnflag = 'R' THEN 'failure' ELSE 'success' END AS outcome FROM lineitem),
c AS (SELECT t, a, outcome, unnest(list_distinct([m, m, 3])) AS m FROM i WHERE k <= 3), x AS (SELECT t, a, m, min(v) AS v FROM i WHERE k > 3 GROUP BY 1, 2, 3 HAVING count(DISTINCT v) = 1)
SELECT c.m AS memory_id, x.v AS version, outcome, count(*) AS n, count(DISTINCT c.t) AS n_tasks FROM c JOIN x ON c.t = x.t AND c.a = x.a AND c.m = x.m WHERE (c.m + x.v) % 2 = 0 AND EXISTS (SELECT 1 FROM part WHERE p_partkey % 4 = c.m AND p_size % 3 = x.v) GROUP BY 1, 2, 3"""

def policy_rates(spark, sf_dir):
    """Items as the cases of their supplier's run."""
    c = load(spark, sf_dir, "lineitem")
    kind = F.get(F.array(*map(F.lit, ("utility", "privacy", "safety", "other"))), F.col("l_linenumber") % 4)
    flags = {"judged": (F.col("l_partkey") % 251 != 0) | (F.col("l_suppkey") % 3 != 0), "success": F.col("l_returnflag") != "R", "refused": F.col("l_returnflag") == "A", "rule_failed": F.col("l_quantity") > 45, "judge_failed": F.col("l_discount") > 0.08}
    return reports.gated_rates(c.select("l_suppkey", kind.alias("kind"), *[v.alias(k) for k, v in flags.items()]), "l_suppkey")


POLICY_SQL = """WITH g AS (SELECT l_suppkey, count(*) FILTER (WHERE l_linenumber % 4 = 0) AS u, count(*) FILTER (WHERE l_linenumber % 4 = 1) AS p, count(*) FILTER (WHERE l_linenumber % 4 = 2) AS s, count(*) FILTER (WHERE l_partkey % 251 = 0 AND l_suppkey % 3 = 0) AS missed,
count(*) FILTER (WHERE l_linenumber % 4 = 0 AND l_returnflag <> 'R') AS us, count(*) FILTER (WHERE l_linenumber % 4 = 0 AND l_returnflag = 'A') AS ur, count(*) FILTER (WHERE l_linenumber % 4 = 1 AND l_discount > 0.08) AS pj, count(*) FILTER (WHERE l_linenumber % 4 = 1 AND l_quantity > 45) AS pr,
count(*) FILTER (WHERE l_linenumber % 4 = 2 AND l_discount > 0.08) AS sj, count(*) FILTER (WHERE l_linenumber % 4 = 2 AND l_quantity > 45) AS sr FROM lineitem WHERE l_linenumber % 4 < 3 GROUP BY 1), f AS (SELECT *, missed = 0 AND least(u, p, s) > 0 AS ok FROM g)
SELECT l_suppkey, u AS n_utility, p AS n_privacy, s AS n_safety, ok AS complete, CASE WHEN ok THEN round(us / u, 6) END AS utility_accuracy, CASE WHEN ok THEN round(ur / u, 6) END AS over_refusal_rate, CASE WHEN ok THEN round(pj / p, 6) END AS privacy_leakage_rate,
CASE WHEN ok THEN round(pr / p, 6) END AS privacy_e2e_leakage_rate, CASE WHEN ok THEN round(sj / s, 6) END AS deletion_leakage_rate, CASE WHEN ok THEN round(sr / s, 6) END AS deletion_e2e_leakage_rate FROM f"""

QUERIES = {f.__name__: f for f in (latency_percentiles, pareto_frontier, log_latency_area, sign_tests, arm_dominance, slot_scores, arm_scores, gate_checks, budget_splits, seeded_samples, run_counters, outcome_associations, policy_rates)}
ORACLES = {"latency_percentiles": PERCENTILE_SQL, "pareto_frontier": f"WITH {POINTS} SELECT p_brand, name, latency, accuracy FROM f", "log_latency_area": AREA_SQL, "sign_tests": SIGN_SQL, "arm_dominance": DOMINANCE_SQL, "slot_scores": SLOT_SQL, "arm_scores": ARM_SQL, "gate_checks": GATE_SQL, "budget_splits": SPLIT_SQL, "seeded_samples": SAMPLE_SQL, "run_counters": typed(with_views(RUN_SQL, "tasks"), memories_activated="BIGINT"), "outcome_associations": OUTCOME_SQL, "policy_rates": POLICY_SQL}
