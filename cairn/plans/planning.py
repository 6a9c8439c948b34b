"""Registered queries of retrieval plans and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import planning
from cairn.sources.tables import load, with_views

NAMES = list(planning.PURPOSES)


def query_plans(spark, sf_dir):
    """Addresses of pages, turns of conversations and digests of them are asked, one purpose after the other."""
    pages = load(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("text"))
    turns = load(spark, sf_dir, "conversations").select((1_000_000 + F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.when(F.col("turn") == 1, F.sha2("text", 256)).when(F.col("turn") == 2, F.md5("text")).otherwise(F.col("text")).alias("text"))
    rows = pages.unionByName(turns).withColumn("purpose", F.get(F.array(*map(F.lit, NAMES)), (F.col("query_id") % len(NAMES)).cast("int")))
    return planning.plans(rows.withColumn("limit", (F.col("query_id") % 40 + 1).cast("int")).withColumn("timed", F.col("query_id") % 3 == 0).withColumn("targeted", F.col("query_id") % 6 == 0))


def _case(value) -> str:
    return f"CASE purpose {' '.join(f'WHEN {chr(39)}{n}{chr(39)} THEN {value(p)}' for n, p in planning.PURPOSES.items())} END"


_WEIGHT = {lane: _case(lambda p, k=k: p.weights[k]) for k, lane in enumerate(planning.LANES)}
PLAN_SQL = f"""WITH u AS (SELECT page_id AS query_id, url AS text FROM pages UNION ALL SELECT 1000000 + conv_id * 100 + turn, CASE turn WHEN 1 THEN sha256(text) WHEN 2 THEN md5(text) ELSE text END FROM conversations),
q AS (SELECT *, list_extract({NAMES}, query_id % {len(NAMES)} + 1) AS purpose, query_id % 40 + 1 AS k, trim(substr(text, 1, 8192)) AS t FROM u),
i AS (SELECT *, CASE WHEN regexp_matches(t, '{planning.UUID}') THEN 'identifier' WHEN regexp_matches(t, '{planning.DIGEST}') OR regexp_matches(t, '{planning.CODE}') THEN 'code_lookup' WHEN query_id % 3 = 0 THEN 'historical' ELSE 'general' END AS intent FROM q)
SELECT query_id, purpose, intent, CAST({_WEIGHT["exact"]} AS DOUBLE) AS exact_weight, CAST({_WEIGHT["lexical"]} AS DOUBLE) AS lexical_weight, CAST({_WEIGHT["fuzzy"]} AS DOUBLE) AS fuzzy_weight,
CAST(CASE WHEN intent IN ('identifier', 'code_lookup') THEN 1.0 ELSE {_WEIGHT["dense"]} END AS DOUBLE) AS dense_weight, CAST(CASE WHEN query_id % 6 = 0 THEN {_WEIGHT["temporal"]} END AS DOUBLE) AS temporal_weight,
CAST(CASE WHEN intent IN ('identifier', 'code_lookup') THEN least(1.25, {_WEIGHT["graph"]}) ELSE {_WEIGHT["graph"]} END AS DOUBLE) AS graph_weight,
CAST(least(2000, greatest(32, k * 4)) AS INTEGER) AS exact_budget, CAST(least(2000, greatest(32, k * 8)) AS INTEGER) AS lexical_budget, CAST(least(2000, greatest(24, k * 5)) AS INTEGER) AS fuzzy_budget, CAST(least(100, greatest(32, k * 8)) AS INTEGER) AS dense_budget,
CAST(CASE WHEN query_id % 6 = 0 THEN least(200, greatest(16, k * 4)) END AS INTEGER) AS temporal_budget, CAST(least(200, greatest(16, k * 4)) AS INTEGER) AS graph_budget,
CASE WHEN purpose IN ('task_bootstrap', 'handoff_recovery', 'planning', 'conflict_review') THEN 2 ELSE 1 END AS hops, CAST(least(16, greatest(4, k)) AS INTEGER) AS seed_limit, CAST(least(2000, greatest(64, 4 * least(200, greatest(16, k * 4)))) AS INTEGER) AS edge_budget,
CASE WHEN purpose IN ('task_bootstrap', 'handoff_recovery') THEN 2048 WHEN purpose IN ('planning', 'conflict_review') THEN 4096 END AS token_budget, purpose IN ('planning', 'task_bootstrap') AS diversify FROM i"""


def time_targets(spark, sf_dir):
    """Orders as queries: an occurrence for every third, a world time for every second, an interval for every fifth."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("d"))
    if_ = lambda m, days=0: F.when(F.col("o_orderkey") % m == 0, F.col("d") + F.expr(f"INTERVAL {days} DAY"))
    target, label = planning.time_target(if_(3), if_(3, 7), if_(2, 1), if_(5, 10), if_(5, 21))
    return o.select(F.col("o_orderkey").alias("query_id"), F.unix_micros(target).alias("target_us"), label.alias("target_from"))


TARGET_SQL = """SELECT o_orderkey AS query_id, CASE WHEN o_orderkey % 3 = 0 THEN epoch_us(o_orderdate) + 302400000000 WHEN o_orderkey % 2 = 0 THEN epoch_us(o_orderdate) + 86400000000 WHEN o_orderkey % 5 = 0 THEN epoch_us(o_orderdate) + 1339200000000 END AS target_us,
CASE WHEN o_orderkey % 3 = 0 THEN 'occurrence_interval_center' WHEN o_orderkey % 2 = 0 THEN 'world_at' WHEN o_orderkey % 5 = 0 THEN 'interval_center' END AS target_from FROM orders"""
LANES = {"exact": planning.Lane(1.0, 0.0, 5.0), "lexical": planning.Lane(0.8, 0.1, 3.0), "dense": planning.Lane(1.5, -0.4, 4.0), "graph": planning.Lane(0.9, 0.0, 0.5)}


def _evidence(spark, sf_dir):
    pool = load(spark, sf_dir, "pool").groupBy("query_id").agg(F.max(F.when(F.col("family") == "R", F.col("relevance"))).alias("exact"), F.max(F.when(F.col("family") == "A", F.col("lexical_score"))).alias("lexical"), F.max(F.when(F.col("family") == "N", F.col("dense_score"))).alias("dense"), F.max(F.when(F.col("logit") > -5, F.col("late_score"))).alias("graph"))
    return pool.withColumn("exact_lookup", F.col("query_id") % 2 == 0).withColumn("several", F.col("query_id") % 3 == 0).withColumn("need", (F.col("query_id") % 10) / 10)


_EVIDENCE = "e AS (SELECT query_id, max(relevance) FILTER (WHERE family = 'R') AS exact, max(lexical_score) FILTER (WHERE family = 'A') AS lexical, max(dense_score) FILTER (WHERE family = 'N') AS dense, max(late_score) FILTER (WHERE logit > -5) AS graph, query_id % 2 = 0 AS exact_lookup, query_id % 3 = 0 AS several, (query_id % 10) / 10.0 AS need FROM pool GROUP BY query_id)"


def adaptive_plans(spark, sf_dir):
    return planning.adaptive(_evidence(spark, sf_dir), LANES, exact_boost=1.5, graph_boost=2.0)


ADAPTIVE_SQL = f"""WITH {_EVIDENCE}, c AS (SELECT query_id, exact_lookup, several, need, least(1.0, greatest(0.0, CASE WHEN exact IS NOT NULL THEN exact END)) AS ex, exact, lexical, dense, graph,
 CASE WHEN lexical IS NOT NULL THEN least(1.0, greatest(0.0, 0.8 * lexical + 0.1)) END AS le, CASE WHEN dense IS NOT NULL THEN least(1.0, greatest(0.0, 1.5 * dense - 0.4)) END AS de, CASE WHEN graph IS NOT NULL THEN least(1.0, greatest(0.0, 0.9 * graph)) END AS gr FROM e),
x AS (SELECT *, CASE WHEN exact IS NOT NULL THEN ex END AS exc FROM c), b AS (SELECT *, greatest(exc, le, de) AS best FROM x),
w AS (SELECT *, best IS NULL OR best < 0.35 AS quits, CASE WHEN best IS NULL OR best < 0.35 THEN 'graph_skipped:abstained' WHEN exact_lookup AND NOT several AND coalesce(exc >= 0.9, false) THEN 'graph_skipped:sufficient_exact' WHEN NOT (several OR need >= 0.5) THEN 'graph_skipped:not_requested'
 WHEN gr IS NULL THEN 'graph_skipped:unavailable' WHEN gr < 0.45 THEN 'graph_skipped:weak_graph_evidence' WHEN best < 0.5 THEN 'graph_skipped:weak_seed_evidence' WHEN several THEN 'graph_allowed:multi_evidence' ELSE 'graph_allowed:relational_query' END AS why FROM b)
SELECT query_id, round(coalesce(5.0 * exc * CASE WHEN exact_lookup THEN 1.5 ELSE 1 END, 0), 6) AS exact_weight, round(coalesce(3.0 * le, 0), 6) AS lexical_weight, round(coalesce(4.0 * de, 0), 6) AS dense_weight,
round(CASE WHEN why LIKE 'graph_allowed%' THEN 0.5 * gr * CASE WHEN several THEN 2.0 ELSE 1 END ELSE 0 END, 6) AS graph_weight, round(best, 6) AS best_direct, quits AS abstain, CASE WHEN best IS NULL THEN 'no_calibrated_direct_evidence' WHEN quits THEN 'below_calibrated_evidence_threshold' END AS abstention,
why AS graph, CASE WHEN why NOT LIKE 'graph_allowed%' THEN 0 WHEN several OR need >= 0.75 THEN 2 ELSE 1 END AS depth FROM w"""


def graph_hops(spark, sf_dir):
    """Every candidate as one observed hop, of depth one or two."""
    pool = load(spark, sf_dir, "pool").withColumn("depth", (F.col("canonical_id") % 2 + 1).cast("int"))
    goes = planning.continues(F.when(F.col("logit") > -5, F.col("relevance")), F.col("depth"), LANES["graph"], (F.col("query_id") % 3).cast("int"))
    return pool.select("query_id", "canonical_id", "depth", goes.alias("continues"))


HOP_SQL = """SELECT query_id, canonical_id, CAST(canonical_id % 2 + 1 AS INTEGER) AS depth, coalesce(canonical_id % 2 + 1 <= query_id % 3 AND logit > -5 AND least(1.0, greatest(0.0, 0.9 * relevance)) >= CASE canonical_id % 2 WHEN 0 THEN 0.6 ELSE 0.72 END, false) AS continues FROM pool"""


def text_identifiers(spark, sf_dir):
    """Paths, symbols, tests, commits and errors named in turns, addresses and markup."""
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("text"))
    kinds = F.map_from_arrays(F.array(*map(F.lit, text.LOOKUPS)), F.array(*[text.lookups(F.col("text"), kind) for kind in text.LOOKUPS]))
    return rows.select("id", F.explode(kinds).alias("kind", "values")).select("id", "kind", F.explode("values").alias("value"))


LOOKUP_SQL = r"""WITH t AS (SELECT page_id AS id, concat_ws(' ', url, html) AS text FROM pages),
u AS (SELECT id, 'path' AS kind, unnest(regexp_extract_all(text, '(?:^|[^\w./-])((?:[\w.@+-]+/)+[\w.@+-]+)', 1)) AS value FROM t
UNION ALL SELECT id, 'symbol', unnest(regexp_extract_all(text, '\b[A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)+\b')) FROM t UNION ALL SELECT id, 'test', unnest(regexp_extract_all(text, '\btest_[A-Za-z0-9_]+\b')) FROM t
UNION ALL SELECT id, 'commit', unnest(regexp_extract_all(text, '\b[0-9a-fA-F]{7,64}\b')) FROM t UNION ALL SELECT id, 'error', unnest(regexp_extract_all(text, '\b(?:[A-Z][A-Z0-9_]+-\d+|SQLSTATE\s+[0-9A-Z]{5})\b')) FROM t)
SELECT DISTINCT id, kind, value FROM u"""


def query_identifiers(spark, sf_dir):
    """Identifiers of query texts, normalised, in the order they stand, without repetition."""
    rows = load(spark, sf_dir, "pages").select(F.col("page_id").alias("query_id"), F.concat(F.lit("see "), F.regexp_replace("url", "^https?://", ""), F.lit(" at "), F.upper(F.md5("url")), F.lit(" or sqlstate  4000"), F.col("page_id") % 10, F.lit(" in a.b::c and test_it")).alias("text"))
    return rows.select("query_id", F.array_join(text.query_identifiers(F.col("text")), "|").alias("identifiers"))


IDENTIFIER_SQL = r"""WITH t AS (SELECT page_id AS query_id, 'see ' || regexp_replace(url, '^https?://', '') || ' at ' || upper(md5(url)) || ' or sqlstate  4000' || page_id % 10 || ' in a.b::c and test_it' AS text FROM pages),
u AS (SELECT query_id, regexp_extract_all(text, '(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\bSQLSTATE\s+[0-9A-Z]{5}\b|(?:[\w.@+-]+/)+[\w.@+-]+|\b[A-Z_]\w*(?:(?:::|\.)[A-Z_]\w*)+\b|\btest_[A-Z0-9_]+\b|\b[0-9A-F]{7,64}\b') AS found FROM t),
n AS (SELECT query_id, list_transform(found, lambda x: CASE WHEN regexp_matches(x, '(?i)^SQLSTATE\s') THEN regexp_replace(upper(x), '\s+', ' ', 'g') WHEN regexp_full_match(x, '[0-9A-Fa-f]{7,64}') THEN lower(x) ELSE x END) AS l FROM u)
SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS identifiers FROM n"""

QUERIES = {f.__name__: f for f in (query_plans, time_targets, adaptive_plans, graph_hops, text_identifiers, query_identifiers)}
ORACLES = {
    "query_plans": PLAN_SQL,
    "time_targets": TARGET_SQL,
    "adaptive_plans": with_views(ADAPTIVE_SQL, "pool"),
    "graph_hops": with_views(HOP_SQL, "pool"),
    "text_identifiers": LOOKUP_SQL,
    "query_identifiers": IDENTIFIER_SQL,
}
