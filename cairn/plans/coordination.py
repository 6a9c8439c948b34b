"""Registered coordination, evaluation and corpus queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import evaluation, work
from cairn.operators.reports import percentiles
from cairn.sources.tables import load


def user_activity(spark, sf_dir):
    """Counters of the event log by user, in one pass: counts by type, distincts, sums from JSON payloads, repeats.  The counters of a run are ``run_counters``."""
    kinds = ["signup", "purchase", "error", "view", "click"]
    events = load(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return events.groupBy("user_id").agg(F.count("*").alias("n_events"), *[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds], F.count_distinct("k").alias("distinct_k"), F.sum("k").alias("sum_k"), (F.count("k") - F.count_distinct("k")).alias("replays"), F.round(F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)), 2).alias("spent"))


def user_sessions(spark, sf_dir):
    return work.sessions(load(spark, sf_dir, "events"), "user_id", "ts", "6 HOURS")


def fresh_and_resumed(spark, sf_dir):
    return work.resumptions(load(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "view")


def event_page(spark, sf_dir):
    """The page of 100 events after the event in the middle of the log."""
    events = load(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    middle = percentiles(events.withColumn("log", F.lit(0)), "log", "event_id", {"c": 0.5}).select(F.col("c").cast("long"))
    cursor = events.join(F.broadcast(middle), F.col("event_id") == F.col("c")).select("ts", "event_id").first()
    after = (F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])) if cursor else None
    return work.page(events, "ts", "event_id", after, 100).drop("ts")


def _tasks(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("scope"), F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "open").otherwise("claimed").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("available_at"))


def claimable_work(spark, sf_dir):
    """Open orders whose prerequisite, the customer's order before, is done."""
    chain = work.versions(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").where("supersedes IS NOT NULL").select(F.col("o_orderkey").alias("task_id"), F.col("supersedes").alias("needs"))
    return work.claimable(_tasks(spark, sf_dir), chain, 3).select("task_id", "scope", "priority", F.col("position").cast("long").alias("position"))


def latest_checkpoint(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("sequence"), F.col("l_partkey").alias("state"), F.col("l_suppkey").alias("agent"))
    return work.latest(rows, "task_id", ["at", "sequence", "state", "agent"]).select("task_id", "sequence", "state", "agent", (F.col("sequence") + 1).alias("next_sequence"))


def version_chain(spark, sf_dir):
    rows = work.versions(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("memory_id"), F.col("version").cast("long").alias("version"), "supersedes", F.date_format("recorded_to", "yyyy-MM-dd").alias("recorded_to"))


def conversation_windows(spark, sf_dir):
    return work.windows(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text", 4, 3).select("conv_id", F.col("window").cast("long").alias("window"), "n_rows", "first_position", "n_chars")


def context_expansion(spark, sf_dir):
    rows = work.expand(load(spark, sf_dir, "conversations"), "conv_id", "turn", F.length("text") > 400, 2)
    return rows.select("conv_id", "turn", "role", "label")


def conversation_render(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.concat(t["role"], F.lit(": "), t["text"]))
    return turns.groupBy("conv_id").agg(F.sha2(F.array_join(lines, "\n"), 256).alias("rendered_sha256"), F.count("*").alias("n_turns"))


def document_chunks(spark, sf_dir):
    parts = work.chunks(load(spark, sf_dir, "documents"), "doc_id", "text", 800)
    return parts.select("doc_id", "chunk", "begin", F.sha2("part", 256).alias("part_sha256"), F.length("part").alias("n_chars"), text.token_estimate(F.col("part")).alias("tokens"))


def document_segments(spark, sf_dir):
    """Documents cut at line breaks, 1000 characters a segment at most."""
    parts = work.segments(load(spark, sf_dir, "documents"), "doc_id", "text", 1000)
    return parts.select("doc_id", "segment", "n_segments", F.length("part").cast("long").alias("n_chars"), F.sha2("part", 256).alias("part_sha256"))


def source_sketches(spark, sf_dir):
    """The sketch of all documents of each source, merged from those of its words."""
    words = text.words(load(spark, sf_dir, "documents"), "source", "text")
    own = words.select("source", text.sketch(F.col("text")).alias("sketch"))
    rows = text.sketches(own, "source", "sketch")
    return rows.select("source", F.array_join(F.transform("sketch", lambda x: x["term"]), " ").alias("terms"))


def page_identifiers(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    return pages.select("page_id", *[F.size(text.identifiers(F.col("html"), k)).cast("long").alias(f"n_{k}") for k in ("path", "number", "mail")], F.array_join(F.array_sort(text.identifiers(F.col("url"), "path")), " ").alias("url_paths"))


def row_fingerprints(spark, sf_dir):
    keep = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return keep.select("s_suppkey", text.fingerprint("s_suppkey", "s_name", "s_nationkey").alias("fingerprint"))


def price_summary(spark, sf_dir):
    return evaluation.summary(load(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")


def paired_delta(spark, sf_dir):
    """Two arms of each part: mean price of returned and of accepted lines, by brand."""
    lines = load(spark, sf_dir, "lineitem").join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    arm = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy("l_partkey", "p_brand").agg(F.round(F.avg("l_quantity"), 6).alias("v"))
    return evaluation.paired(arm("R"), arm("A"), "l_partkey", "v", "p_brand")


def arm_differences(spark, sf_dir):
    """Difference in differences of mean quantity: flag by line status."""
    means = load(spark, sf_dir, "lineitem").groupBy("l_suppkey").pivot("l_returnflag", ["A", "R"]).agg(F.avg(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))).alias("o"), F.avg(F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))).alias("f"))
    return means.select("l_suppkey", F.round((F.col("R_o") - F.col("R_f")) - (F.col("A_o") - F.col("A_f")), 4).alias("did"))


def part_citations(spark, sf_dir):
    """Parts shipped by one supplier alone to an order and returned there: used and proven useful together."""
    lines = load(spark, sf_dir, "lineitem")
    used = lines.groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count("*").alias("uses"))
    cited = lines.where("l_returnflag = 'A'").select("l_partkey", "l_orderkey").unionByName(lines.where("l_linestatus = 'F'").select("l_partkey", "l_orderkey")).distinct()
    return used.join(cited.groupBy("l_partkey").agg(F.count("*").alias("citations")), "l_partkey")


def cohort_difference(spark, sf_dir):
    """Customers without an urgent order: used positions are left out."""
    urgent = load(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


def activity_counters(spark, sf_dir):
    """The batch twin of the streaming counters: events by day and type."""
    return load(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


_NOW = "1996-01-01"


def _leases(spark, sf_dir):
    """Orders as leases of 30 days held by a supplier number; finished orders have given theirs back."""
    orders = load(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 10 + 1).alias("owner"), (F.col("o_orderstatus") != "F").alias("active"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("expires_at"), F.col("o_orderpriority").alias("priority"))


def owned_writes(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    writes = items.select(F.col("l_orderkey").alias("task_id"), (F.col("l_suppkey") % 10 + 1).alias("writer"), F.col("l_shipdate").alias("at"), "l_linenumber")
    return work.owned(_leases(spark, sf_dir), writes).groupBy("writer").agg(F.count("*").alias("n_writes"), F.countDistinct("task_id").alias("n_tasks"))


def expired_handoffs(spark, sf_dir):
    marks = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("at"))
    gone = work.crash_handoffs(_leases(spark, sf_dir), marks, F.lit(_NOW).cast("timestamp_ntz"))
    return gone.groupBy("priority").agg(F.count("*").alias("n_handoffs"), F.min("task_id").alias("first_task"))


_L = "l AS (SELECT o_orderkey AS task_id, o_custkey % 10 + 1 AS owner, o_orderstatus <> 'F' AS active, o_orderdate + INTERVAL 30 DAY AS expires_at, o_orderpriority AS priority FROM orders)"
_V = "v AS (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderkey) OVER w AS supersedes, lead(o_orderdate) OVER w AS recorded_to, row_number() OVER w AS version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
QUERIES = {
    f.__name__: f
    for f in (user_activity, user_sessions, fresh_and_resumed, event_page, claimable_work, latest_checkpoint, version_chain, conversation_windows, context_expansion, conversation_render, document_chunks, document_segments, source_sketches, page_identifiers, row_fingerprints, price_summary, paired_delta, arm_differences, part_citations, cohort_difference, activity_counters, owned_writes, expired_handoffs)
}
_SKETCH_STOP = ", ".join(f"'{w}'" for w in text.SKETCH_STOP_WORDS)
SKETCH_SQL = rf"""WITH w AS (SELECT DISTINCT source, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents), h AS (SELECT source, term, CAST('0x' || substr(sha256(term), 1, 15) AS BIGINT) AS hash FROM w WHERE length(term) >= 3 AND term NOT IN ({_SKETCH_STOP})),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hash, term) AS n FROM h) SELECT source, string_agg(term, ' ' ORDER BY hash, term) AS terms FROM r WHERE n <= 96 GROUP BY source"""
ORACLES = {
    "source_sketches": SKETCH_SQL,
    "owned_writes": f"WITH {_L} SELECT l_suppkey % 10 + 1 AS writer, count(*) AS n_writes, count(DISTINCT task_id) AS n_tasks FROM lineitem JOIN l ON l_orderkey = task_id WHERE active AND l_suppkey % 10 + 1 = owner AND l_shipdate < expires_at GROUP BY 1",
    "expired_handoffs": f"WITH {_L} SELECT priority, count(*) AS n_handoffs, min(task_id) AS first_task FROM l WHERE active AND expires_at <= TIMESTAMP '{_NOW}' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = task_id AND l_shipdate < expires_at) GROUP BY 1",
    "user_activity": "WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT user_id, count(*) AS n_events, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{k}" for k in ("signup", "purchase", "error", "view", "click")) + ", count(DISTINCT k) AS distinct_k, CAST(sum(k) AS BIGINT) AS sum_k, count(k) - count(DISTINCT k) AS replays, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 2) AS spent FROM e GROUP BY 1",
    "user_sessions": "WITH b AS (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM b) SELECT user_id, session, count(*) AS n_events, min(event_id) AS first_event, arg_max(event_id, (ts, event_id)) AS last_event FROM s GROUP BY 1, 2",
    "fresh_and_resumed": "WITH s AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events) SELECT user_id, count(*) FILTER (WHERE event_type = 'view' AND seen = 0) AS fresh_claims, count(*) FILTER (WHERE event_type = 'view' AND seen = 1) AS resumptions FROM s GROUP BY 1",
    "event_page": "WITH c AS (SELECT ts, event_id FROM events WHERE event_id = (SELECT CAST(floor(quantile_cont(event_id, 0.5)) AS BIGINT) FROM events)) SELECT e.event_id, e.user_id, e.event_type FROM events e, c WHERE e.ts > c.ts OR (e.ts = c.ts AND e.event_id > c.event_id) ORDER BY e.ts, e.event_id LIMIT 100",
    "claimable_work": f"WITH {_V}, f AS (SELECT o.o_orderkey AS task_id, o.o_custkey AS scope, o.o_orderpriority AS priority, o.o_orderdate AS moment FROM orders o JOIN v ON o.o_orderkey = v.o_orderkey LEFT JOIN orders d ON v.supersedes = d.o_orderkey WHERE o.o_orderstatus = 'O' AND (v.supersedes IS NULL OR d.o_orderstatus = 'F')), r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY priority, moment, task_id) AS position FROM f) SELECT task_id, scope, priority, position FROM r WHERE position <= 3",
    "latest_checkpoint": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem) SELECT l_orderkey AS task_id, l_linenumber AS sequence, l_partkey AS state, l_suppkey AS agent, l_linenumber + 1 AS next_sequence FROM r WHERE n = 1",
    "version_chain": f"WITH {_V} SELECT o_orderkey AS memory_id, version, supersedes, strftime(recorded_to, '%Y-%m-%d') AS recorded_to FROM v",
    "conversation_windows": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), w AS (SELECT conv_id, unnest(range(0, n, 3)) // 3 AS win FROM (SELECT DISTINCT conv_id, n FROM p)) SELECT w.conv_id, w.win AS window, count(*) AS n_rows, min(turn) AS first_position, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM w JOIN p ON w.conv_id = p.conv_id AND p.p BETWEEN w.win * 3 AND w.win * 3 + 3 GROUP BY 1, 2",
    "context_expansion": "WITH m AS (SELECT *, max(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM conversations) SELECT conv_id, turn, role, CASE WHEN length(text) > 400 THEN 'core' ELSE 'context' END AS label FROM m WHERE near = 1",
    "conversation_render": "SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS rendered_sha256, count(*) AS n_turns FROM conversations GROUP BY 1",
    "document_chunks": "WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 800.0) AS BIGINT), 1))) AS chunk FROM documents), s AS (SELECT doc_id, chunk, substr(text, chunk * 800 + 1, 800) AS part FROM c) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, chunk * 800 AS begin, sha256(part) AS part_sha256, CAST(length(part) AS INTEGER) AS n_chars, CAST(greatest(1, ceil(length(part) / 4.0)) AS INTEGER) AS tokens FROM s",
    "page_identifiers": r"SELECT page_id, len(list_distinct(regexp_extract_all(html, '/[a-z]+/[0-9a-z/]+'))) AS n_path, len(list_distinct(regexp_extract_all(html, '\b[0-9]{3,}\b'))) AS n_number, len(list_distinct(regexp_extract_all(html, '[\w.]+@[\w.]+\.[a-z]+'))) AS n_mail, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(url, '/[a-z]+/[0-9a-z/]+')))[1:5], ' '), '') AS url_paths FROM pages",
    "row_fingerprints": """SELECT s_suppkey, sha256('{"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || ',"s_suppkey":' || s_suppkey || '}') AS fingerprint FROM supplier""",
    "price_summary": "SELECT l_returnflag, count(l_extendedprice) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS least, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95, max(l_extendedprice) AS most FROM lineitem GROUP BY 1",
    "paired_delta": "WITH l AS (SELECT l_partkey, p_brand, l_returnflag AS f, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey), b AS (SELECT l_partkey, p_brand, round(avg(q), 6) AS v FROM l WHERE f = 'R' GROUP BY 1, 2), t AS (SELECT l_partkey, p_brand, round(avg(q), 6) AS v FROM l WHERE f = 'A' GROUP BY 1, 2), x AS (SELECT coalesce(b.p_brand, t.p_brand) AS p_brand, b.v AS b, t.v AS t FROM b FULL OUTER JOIN t ON b.l_partkey = t.l_partkey) SELECT p_brand, count(*) FILTER (WHERE t > b) AS wins, count(*) FILTER (WHERE t < b) AS losses, count(*) FILTER (WHERE t = b) AS ties, count(*) FILTER (WHERE t IS NULL OR b IS NULL) AS unpaired, round(avg(t - b), 4) AS mean_delta FROM x GROUP BY 1",
    "arm_differences": "WITH m AS (SELECT l_suppkey, avg(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'O') AS ro, avg(l_quantity) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS rf, avg(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'O') AS ao, avg(l_quantity) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS af FROM lineitem GROUP BY 1) SELECT l_suppkey, round((ro - rf) - (ao - af), 4) AS did FROM m",
    "part_citations": "WITH u AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS suppliers, count(*) AS uses FROM lineitem GROUP BY 1), c AS (SELECT l_partkey, count(*) AS citations FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem WHERE l_returnflag = 'A' OR l_linestatus = 'F') GROUP BY 1) SELECT u.l_partkey, suppliers, uses, citations FROM u JOIN c ON u.l_partkey = c.l_partkey",
    "cohort_difference": "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')",
    "activity_counters": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
}
