"""Registered graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import graph, work
from cairn.sources.shared import written
from cairn.sources.tables import load, with_views

TOK = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


def graph_spread(spark, sf_dir):
    """Activation from every supplier with a key divisible by 20 over its parts and their suppliers.

    A supplier asks for the type of the part with its own key, every second one for nothing
    that has a token; parts are gated by how much of it they hold.
    """
    edges = load(spark, sf_dir, "lineitem").select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "contradicts").when(F.col("l_returnflag") == "A", "supports").when(F.col("l_linenumber") == 7, "unheard_of").otherwise("related_to").alias("relation"), F.col("l_shipdate").alias("created_at"))
    asked = load(spark, sf_dir, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("query_id"))
    seeds = asked.select("query_id", (-F.col("query_id") - 1).alias("node"), F.lit(1.0).alias("activation"))
    part = load(spark, sf_dir, "part")
    queries = asked.join(part, F.col("query_id") == F.col("p_partkey")).select("query_id", F.when(F.col("query_id") % 40 == 0, "?!").otherwise(F.col("p_type")).alias("text"))
    nodes = part.select(F.col("p_partkey").alias("node"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return graph.spread(seeds, edges, 2, 8, lambda pairs: graph.overlaps(pairs, queries, nodes), F.lit("1997-06-30").cast("timestamp_ntz"))


SPREAD_SQL = f"""WITH e AS (SELECT -l_suppkey - 1 AS src, l_partkey AS dst, CASE l_returnflag WHEN 'R' THEN 0.88 WHEN 'A' THEN 1.0 ELSE 0.75 END AS w, l_returnflag = 'A' AS directed FROM lineitem WHERE (l_returnflag IN ('R', 'A') OR l_linenumber <> 7) AND l_shipdate <= TIMESTAMP '1997-06-30'),
b AS (SELECT src, dst, CAST(max(w) AS DOUBLE) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, CASE WHEN directed THEN w * 0.95 ELSE w END FROM e) GROUP BY 1, 2),
s AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS n FROM b) WHERE n <= 8),
qt AS (SELECT s_suppkey AS query_id, CASE WHEN s_suppkey % 40 = 0 THEN [] ELSE {TOK.format("p_type")} END AS ts FROM supplier JOIN part ON s_suppkey = p_partkey WHERE s_suppkey % 20 = 0),
pt AS (SELECT p_partkey AS node, {TOK.format("p_name || ' ' || p_type")} AS ts FROM part),
r0 AS (SELECT s_suppkey AS query_id, -s_suppkey - 1 AS node, CAST(1.0 AS DOUBLE) AS act, 0 AS depth, [-s_suppkey - 1] AS path FROM supplier WHERE s_suppkey % 20 = 0),
x1 AS (SELECT r0.query_id, dst AS node, act * w * 0.85 * (CASE WHEN coalesce(len(qt.ts), 0) = 0 THEN 1.0 ELSE 0.6 + 0.4 * coalesce(len(list_intersect(qt.ts, pt.ts)), 0) / len(qt.ts) END) AS act, 1 AS depth, list_append(path, dst) AS path FROM r0 JOIN s ON r0.node = src LEFT JOIN qt ON qt.query_id = r0.query_id LEFT JOIN pt ON pt.node = dst WHERE NOT list_contains(path, dst)),
r1 AS (SELECT query_id, node, act, depth, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY round(act, 12) DESC, path) AS n FROM x1) WHERE n = 1),
x2 AS (SELECT r1.query_id, dst AS node, act * w * 0.85 * (CASE WHEN coalesce(len(qt.ts), 0) = 0 THEN 1.0 ELSE 0.6 + 0.4 * coalesce(len(list_intersect(qt.ts, pt.ts)), 0) / len(qt.ts) END) AS act, 2 AS depth, list_append(path, dst) AS path FROM r1 JOIN s ON r1.node = src LEFT JOIN qt ON qt.query_id = r1.query_id LEFT JOIN pt ON pt.node = dst WHERE NOT list_contains(path, dst)),
u AS (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM x2),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY round(act, 12) DESC, depth, path) AS n FROM u)
SELECT query_id, node, round(act, 6) AS activation, depth, array_to_string(path, '>') AS path FROM k WHERE n = 1"""


def graph_seeds(spark, sf_dir):
    """Of each order: its items of flag R are named, all others are fused hits; six seeds at most."""
    pool = load(spark, sf_dir, "pool")
    named = pool.where("relevant AND canonical_id % 2 = 0").select("query_id", F.col("canonical_id").alias("node"), F.col("dense_rank").alias("position"))
    return graph.seeds(named, pool.select("query_id", F.col("canonical_id").alias("node"), F.col("lexical_rank").alias("rank"), F.round(1 / F.col("lexical_rank"), 6).alias("score")), 3)


SEED_SQL = """WITH u AS (SELECT query_id, canonical_id AS node, CASE WHEN relevant AND canonical_id % 2 = 0 THEN 0 ELSE 1 END AS k, CASE WHEN relevant AND canonical_id % 2 = 0 THEN dense_rank ELSE lexical_rank END AS pos, CASE WHEN relevant AND canonical_id % 2 = 0 THEN 1.0 ELSE round(1.0 / lexical_rank, 6) END AS activation FROM pool),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k, pos, node) AS n FROM u)
SELECT query_id, node, CAST(activation AS DOUBLE) AS activation FROM r WHERE n <= 3"""


def _chain(spark, sf_dir):
    return work.versions(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


def lineage_closure(spark, sf_dir):
    """All that each customer's newest order replaces, step by step."""
    rows = _chain(spark, sf_dir)
    edges = rows.where("supersedes IS NOT NULL").select(F.col("o_orderkey").alias("src"), F.col("supersedes").alias("dst"))
    seeds = rows.where("recorded_to IS NULL").select(F.col("o_orderkey").alias("node"))
    return graph.closure(edges, seeds).groupBy("seed").agg(F.count("*").alias("n_reached"), F.max("steps").cast("long").alias("depth"), F.min("node").alias("least_node"))


CLOSURE_SQL = """WITH RECURSIVE v AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER w AS prev, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
r AS (SELECT id AS seed, id AS node, 0 AS steps FROM v WHERE next IS NULL UNION ALL SELECT r.seed, v.prev, r.steps + 1 FROM r JOIN v ON r.node = v.id WHERE v.prev IS NOT NULL)
SELECT seed, count(*) AS n_reached, CAST(max(steps) AS BIGINT) AS depth, min(node) AS least_node FROM r GROUP BY 1"""


def lineage_links(spark, sf_dir):
    """Lineage both ways from every order: orders of one customer whose dates follow within 90 days are linked."""
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    near = F.col("o_orderdate") <= F.col("_d") + F.expr("INTERVAL 90 DAY")
    chain = _chain(spark, sf_dir).withColumn("_d", before).where("o_orderstatus <> 'P'")
    rows = written(chain.select(F.col("o_orderkey").alias("node"), F.col("recorded_to").isNull().alias("current"), F.when(near, F.col("supersedes")).alias("dst")), "chain")
    nodes = rows.select("node", "current")
    return graph.lineage(rows.where("dst IS NOT NULL").select(F.col("node").alias("src"), "dst"), nodes, nodes.select("node"))


LINKS_SQL = """WITH RECURSIVE v AS (SELECT o_orderkey AS id, o_orderdate AS d, o_orderstatus <> 'P' AS ok, lag(o_orderkey) OVER w AS prev, lag(o_orderdate) OVER w AS pd, lead(o_orderkey) OVER w IS NULL AS cur FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
e AS (SELECT DISTINCT v.id AS src, v.prev AS dst FROM v JOIN v AS p ON v.prev = p.id WHERE v.ok AND p.ok AND v.d <= v.pd + INTERVAL 90 DAY),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r AS (SELECT id AS seed, id AS node FROM v WHERE ok UNION SELECT seed, dst FROM r JOIN b ON r.node = b.src),
c AS (SELECT seed, count(*) AS n_members, count(*) FILTER (WHERE cur) AS n_current FROM r JOIN v ON r.node = v.id GROUP BY 1),
l AS (SELECT seed, count(*) AS n_links FROM r JOIN e ON r.node = e.src GROUP BY 1)
SELECT c.seed, n_members, n_current, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN l ON c.seed = l.seed"""


def _needs(spark, sf_dir, line):
    """Needs between sizes of parts within a supplier: an item's part needs the size that its quantity names."""
    item = load(spark, sf_dir, "lineitem").where(f"l_linenumber = {line}")
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("src"))
    rows = item.join(part.hint("merge"), "l_partkey").select(F.col("l_suppkey").alias("scope"), "src", F.col("l_quantity").cast("long").alias("dst"), "l_orderkey", "l_returnflag", "l_shipdate")
    return rows.where("l_returnflag = 'R'") if line == 1 else rows


def dependency_cycles(spark, sf_dir):
    """Sizes on cycles of needs, by supplier."""
    node = lambda c: F.col("scope") * 100 + F.col(c)
    return graph.on_cycles(_needs(spark, sf_dir, 1).select(node("src").alias("src"), node("dst").alias("dst")).distinct())


CYCLE_SQL = """WITH RECURSIVE n AS (SELECT DISTINCT l_suppkey * 100 + p_size AS src, l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS dst FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1 AND l_returnflag = 'R'),
r AS (SELECT src, dst FROM n UNION SELECT r.src, n.dst FROM r JOIN n ON r.dst = n.src) SELECT src AS node FROM r WHERE src = dst"""


def dependency_adds(spark, sf_dir):
    """New needs, in the order of their orders, refused where they close a cycle, repeat one, or lead to themselves."""
    proposed = _needs(spark, sf_dir, 2).groupBy("l_orderkey").agg(F.min(F.struct("scope", "src", "dst")).alias("p"))
    there = _needs(spark, sf_dir, 1).where("src < dst").select("scope", "src", "dst")
    return graph.addable(there, proposed.select(F.col("l_orderkey").alias("proposal_id"), "p.*"))


QUERIES = {f.__name__: f for f in (graph_spread, graph_seeds, lineage_closure, lineage_links, dependency_cycles, dependency_adds)}
ORACLES = {"graph_spread": SPREAD_SQL, "graph_seeds": with_views(SEED_SQL, "pool"), "lineage_closure": CLOSURE_SQL, "lineage_links": LINKS_SQL, "dependency_cycles": CYCLE_SQL}
