"""Registered queries of consolidation plans and evidence chains: confirmed orders stand for memories, neighbours of a customer's orders for plans."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.operators import chains, consolidation
from cairn.plans import retrieval
from cairn.sources.shared import written
from cairn.sources.tables import load


def _plain(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("memory_id"),
        (1 + F.col("o_orderkey") % 3).alias("version"),
        F.when(F.col("o_orderstatus") == "P", "refuted").otherwise("confirmed").alias("state"),
        F.concat_ws(" ", "o_orderpriority", (F.col("o_custkey") % 10).cast("string")).alias("content"),
        F.when(F.col("o_orderkey") % 5 == 0, "task").when(F.col("o_orderkey") % 3 == 0, "run").otherwise("repository").alias("visibility"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") % 4).alias("task_id"),
        (1 - (F.col("o_orderkey") % 7) / 10).alias("confidence"),
    )


def _memories(spark, sf_dir):
    evidence = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("evidence_ids")).withColumn("memory_id", F.col("l_orderkey").cast("string")).drop("l_orderkey")
    return _plain(spark, sf_dir).join(evidence, "memory_id", "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<bigint>")))


def plan_tables(spark, sf_dir):
    """Memories, plans, observations and actions: each order and the one before it of its customer are a plan.

    A plan in seven observed an old version; the plans of a customer meet on their orders,
    and those that corroborate an order make the next plan stale.
    """
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    pairs = load(spark, sf_dir, "orders").withColumn("before", F.lag("o_orderkey").over(order)).where("before IS NOT NULL").select(F.col("o_orderkey").alias("plan_id"), F.array("before", "o_orderkey").alias("ids"), (F.col("o_orderdate").cast("timestamp").cast("long") * 1_000_000 + F.col("o_orderkey")).alias("seq"))
    pairs = written(pairs, "pairs")
    memories = _memories(spark, sf_dir)
    seen = _plain(spark, sf_dir).select("memory_id", "version", consolidation.digest().alias("digest"), "content")
    observed = pairs.select("plan_id", F.explode(F.transform("ids", lambda x: x.cast("string"))).alias("memory_id")).join(seen, "memory_id")
    observations = observed.select("plan_id", "memory_id", (F.col("version") - (F.col("plan_id") % 7 == 0).cast("int")).alias("version"), "digest")
    supports = pairs.select("plan_id", F.transform("ids", lambda x: x.cast("string")).alias("supports")).withColumn("target", F.col("supports")[0])
    first = supports.select("plan_id", F.lit(1).alias("place"), F.when(F.col("plan_id") % 4 == 0, "link").otherwise("append").alias("action"), F.lit(None).cast("string").alias("target"), "supports", F.concat(F.lit("both of "), F.array_join("supports", " and ")).alias("content"), F.lit(0.8).alias("confidence"))
    content = seen.select(F.col("memory_id").alias("target"), F.upper("content").alias("_c"))
    again = supports.where("plan_id % 3 = 0").join(content, "target").select("plan_id", F.lit(2).alias("place"), F.lit("supersede").alias("action"), "target", "supports", F.when(F.col("plan_id") % 2 == 0, F.col("_c")).otherwise("something else").alias("content"), F.lit(0.9).alias("confidence"))
    return memories, pairs.select("plan_id", "seq"), observations, first.unionByName(again)


def consolidation_results(spark, sf_dir):
    """What became of every action of every plan."""
    return consolidation.apply_plans(*plan_tables(spark, sf_dir))[0]


def consolidated_memories(spark, sf_dir):
    """The memories after all plans, with how many of them each is derived from."""
    _, links, memories = consolidation.apply_plans(*plan_tables(spark, sf_dir))
    n = links.groupBy(F.col("source_id").alias("memory_id")).agg(F.count("*").alias("n_sources"))
    return memories.join(n, "memory_id", "left").select("memory_id", "version", "state", "visibility", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("evidence_ids"), F.round("confidence", 6).alias("confidence"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def plan_deliveries(spark, sf_dir):
    """Items as deliveries of their order's plan; some of them changed."""
    item = load(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"])
    return consolidation.deliveries(item.select(F.col("l_orderkey").alias("work_id"), F.col("l_linenumber").alias("seq"), F.when(F.col("l_linenumber") % 4 == 0, "other").otherwise("first").alias("plan_sha256")))


DELIVERY_SQL = """SELECT work_id, seq, plan_sha256, CASE WHEN n = 1 THEN 'staged' WHEN plan_sha256 = own THEN 'replayed' ELSE 'plan_changed' END AS delivery FROM (SELECT *, row_number() OVER w AS n, first_value(plan_sha256) OVER w AS own FROM
 (SELECT DISTINCT l_orderkey AS work_id, l_linenumber AS seq, CASE WHEN l_linenumber % 4 = 0 THEN 'other' ELSE 'first' END AS plan_sha256 FROM lineitem) WINDOW w AS (PARTITION BY work_id ORDER BY seq))"""


def evidence_chains(spark, sf_dir):
    """Chains over the twenty nearest vectors of each query."""
    rows = load(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = retrieval.lanes.dense(rows.select(F.col("vec_id").alias("canonical_id"), F.col("embedding").alias("vector")), queries, chains.POOL)
    return chains.organize(found.join(rows.select(F.col("vec_id").alias("canonical_id"), F.col("embedding").alias("vector")), "canonical_id"), queries)


QUERIES = {"consolidation_results": consolidation_results, "consolidated_memories": consolidated_memories, "plan_deliveries": plan_deliveries, "evidence_chains": evidence_chains}
ORACLES = {"plan_deliveries": DELIVERY_SQL}
