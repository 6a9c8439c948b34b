"""Registered upkeep, resampling and approximate-search queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.when import referenced_time
from cairn.operators import ann, resampling, upkeep, work
from cairn.plans.retrieval import lane_dense
from cairn.sources.tables import load


def source_rejection(spark, sf_dir):
    """Suppliers in debt or nearly so are rejected as sources; each customer's newest order is current."""
    chain = work.versions(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "tentative")
    after = F.lead("o_orderkey").over(work.Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    memories = chain.withColumn("superseded_by", after).select(F.col("o_orderkey").alias("memory_id"), F.when(F.col("recorded_to").isNull(), F.coalesce(state, F.lit("refuted"))).otherwise("superseded").alias("state"), state.alias("previous_state"), "supersedes", "superseded_by", "recorded_to", F.col("version").cast("long").alias("version"))
    evidence = load(spark, sf_dir, "evidence").select("memory_id", "source_id", "trust", "rejected")
    rejected = load(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(F.col("s_suppkey").alias("source_id"))
    return upkeep.reject_sources(memories, evidence, rejected)


def lease_renewals(spark, sf_dir):
    """Orders as leases of 30 days that each shipment renews."""
    claims = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("at"))
    renewals = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_shipdate").alias("at"))
    return upkeep.renewed(claims, renewals, 30 * 86_400).withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"))


def bootstrap_interval(spark, sf_dir):
    """Interval of the difference between returned and accepted quantity of a part, by brand."""
    arm = lambda flag: F.avg(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    delta = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(arm("R") - arm("A"), 6).alias("delta"))
    rows = delta.join(load(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return resampling.bootstrap(rows, "p_brand", "p_partkey", "delta")


def lane_dense_approximate(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return ann.approximate(v.select(F.col("vec_id").alias("canonical_id"), F.col("embedding").alias("vector")), queries, 10)


def dense_recall(spark, sf_dir):
    """What the approximate lane finds of the exact one."""
    return ann.recall(lane_dense_approximate(spark, sf_dir), lane_dense(spark, sf_dir))


#: The question each order asks on its day, in SQL that Spark and DuckDB both run.
_ASKED = "CASE o_orderstatus WHEN 'F' THEN concat('shipped ', CAST(o_custkey AS STRING), ' weeks ago') WHEN 'O' THEN 'open in last month' ELSE concat('paid before ', CAST(CAST(o_orderdate AS DATE) AS STRING)) END"


def referenced_times(spark, sf_dir):
    """What period a question about each order means; counts over 520 weeks are rejected."""
    asked = load(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ASKED).alias("asked"), referenced_time(F.expr(_ASKED), F.col("o_orderdate").cast("timestamp_ntz"), F.lit("UTC")).alias("w"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return asked.select("o_orderkey", "asked", "w.status", "w.reason", day("w.valid_from").alias("valid_from"), day("w.valid_to").alias("valid_to"))


_STATE = "CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'tentative' END"
_WEIGHT = " + ".join(f"CAST(u >= {step!r} AS INTEGER)" for step in resampling.poisson_steps())
QUERIES = {f.__name__: f for f in (source_rejection, lease_renewals, bootstrap_interval, lane_dense_approximate, dense_recall, referenced_times)}
ORACLES = {
    "source_rejection": f"""WITH m AS (SELECT o_orderkey AS id, {_STATE} AS was, coalesce({_STATE}, 'refuted') AS now, lag(o_orderkey) OVER w AS old, lead(o_orderkey) OVER w AS new, row_number() OVER w AS version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
      hit AS (SELECT *, EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = id AND s_acctbal >= 3000 AND l_returnflag <> 'R' AND l_linestatus <> 'O') AS stands
        FROM m WHERE new IS NULL AND EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = id AND s_acctbal < 3000))
      SELECT id AS memory_id, CASE WHEN stands THEN 'bumped' ELSE 'refuted' END AS outcome, CASE WHEN stands THEN now ELSE 'refuted' END AS state, CASE WHEN stands THEN old END AS supersedes, version + 1 AS version FROM hit
      UNION ALL SELECT m.id, 'revived', coalesce(m.was, 'tentative'), m.old, m.version + 1 FROM m JOIN hit ON m.id = hit.old WHERE NOT hit.stands""",
    "lease_renewals": """WITH e AS (SELECT l_orderkey AS task_id, l_shipdate AS t, 1 AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate UNION ALL SELECT o_orderkey, o_orderdate, 0 FROM orders),
      g AS (SELECT *, CASE WHEN t >= lag(t) OVER w + INTERVAL 30 DAY THEN 1 ELSE 0 END AS late FROM e WINDOW w AS (PARTITION BY task_id ORDER BY t, n)),
      h AS (SELECT *, max(late) OVER (PARTITION BY task_id ORDER BY t, n RANGE UNBOUNDED PRECEDING) AS lapsed FROM g)
      SELECT task_id, strftime(max(t) + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS expires_at, CAST(sum(n) AS BIGINT) AS n_renewals FROM h WHERE lapsed = 0 GROUP BY 1""",
    "bootstrap_interval": f"""WITH d AS (SELECT p_brand, p_partkey, round(avg(l_quantity) FILTER (WHERE l_returnflag = 'R') - avg(l_quantity) FILTER (WHERE l_returnflag = 'A'), 6) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
      x AS (SELECT p_brand, v, b, CAST('0x' || substr(md5(p_partkey || ':' || b // 4), CAST(8 * (b % 4) + 1 AS INTEGER), 8) AS BIGINT) / 4294967296.0 AS u FROM (SELECT *, unnest(range(0, 200)) AS b FROM d WHERE v IS NOT NULL)),
      w AS (SELECT p_brand, v, b, {_WEIGHT} AS w FROM x),
      m AS (SELECT p_brand, b, sum(w * v) / nullif(sum(w), 0) AS m FROM w GROUP BY 1, 2), s AS (SELECT p_brand, count(*) AS n_clusters, round(avg(v), 4) AS mean FROM d WHERE v IS NOT NULL GROUP BY 1)
      SELECT p_brand, n_clusters, mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, round(quantile_cont(m, 0.05), 4) AS bound FROM m JOIN s USING (p_brand) GROUP BY ALL""",
    "referenced_times": f"""WITH a AS (SELECT *, {_ASKED} AS asked, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderstatus <> 'F' THEN 'matched' WHEN o_custkey BETWEEN 2 AND 520 THEN 'matched' ELSE 'rejected' END AS status FROM orders),
      p AS (SELECT *, CASE WHEN status = 'rejected' OR o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'O' THEN date_trunc('month', d) - INTERVAL 1 MONTH ELSE d - CAST(o_custkey * 7 AS INTEGER) END AS f,
        CASE WHEN status = 'rejected' THEN NULL WHEN o_orderstatus = 'P' THEN d WHEN o_orderstatus = 'O' THEN date_trunc('month', d) ELSE d - CAST(o_custkey * 7 AS INTEGER) + 1 END AS t FROM a)
      SELECT o_orderkey, asked, status, CASE WHEN status = 'matched' THEN CASE o_orderstatus WHEN 'P' THEN 'explicit_before' ELSE 'anchored_relative_period' END WHEN o_custkey BETWEEN 1 AND 520 THEN 'invalid_relative_count' ELSE 'relative_count_out_of_range' END AS reason, strftime(CAST(f AS TIMESTAMP), '%Y-%m-%d') AS valid_from, strftime(CAST(t AS TIMESTAMP), '%Y-%m-%d') AS valid_to FROM p""",
}
