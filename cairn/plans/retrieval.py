"""Registered retrieval queries and their SQL.

Parts stand for memories with titles and tags, brands and types for query texts, orders
for versioned memories, line items for evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import evaluation, fusion, lanes, recall
from cairn.sources.tables import load, spread, with_views


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("canonical_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), "p_name", "p_type", "p_brand")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct pair of name and type is a query; its id is the smallest part with it."""
    return load(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("query_id")).select("query_id", F.concat_ws(" ", "p_name", "p_type").alias("text"))


P = "p AS (SELECT p_partkey AS canonical_id, concat_ws(' ', p_name, p_type, p_brand) AS text, p_name, p_type, p_brand FROM part)"
A = "a AS (SELECT min(p_partkey) AS query_id, concat_ws(' ', p_name, p_type) AS text FROM part GROUP BY p_name, p_type)"
TOK = r"list_distinct(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+'))"


def canonical_recall(spark, sf_dir):
    return recall.recallable(load(spark, sf_dir, "memories"), load(spark, sf_dir, "evidence"), load(spark, sf_dir, "asked"))


RECALL_SQL = """WITH x AS (SELECT q.query_id, m.memory_id, m.state, m.kind FROM memories m JOIN asked q ON m.repository = q.repository
 WHERE (m.visibility = 'repository' OR (m.visibility = 'run' AND m.run_id = q.run_id) OR (m.visibility = 'task' AND m.run_id = q.run_id AND m.task_id = q.task_id))
 AND (m.state IN ('tentative', 'confirmed') OR (q.include_refuted AND m.state = 'refuted'))
 AND m.recorded_from <= q.known_at AND (m.recorded_to IS NULL OR q.known_at < m.recorded_to) AND m.valid_from <= q.world_at AND (m.valid_to IS NULL OR q.world_at < m.valid_to))
SELECT query_id, memory_id, state, kind FROM x WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.memory_id = x.memory_id)
 OR EXISTS (SELECT 1 FROM evidence e WHERE e.memory_id = x.memory_id AND NOT e.rejected AND e.trust <> 'untrusted')"""


def interval_overlap(spark, sf_dir):
    m, q = load(spark, sf_dir, "memories").alias("m"), load(spark, sf_dir, "asked").alias("q")
    pairs = m.join(q, F.col("m.repository") == F.col("q.repository"))
    q_to = F.col("q.world_at") + F.expr("INTERVAL 200 DAY")
    rows = pairs.withColumn("q_to", q_to).where(recall.overlaps("m.valid_from", "m.valid_to", "q.world_at", "q_to"))
    return rows.groupBy("q.query_id").agg(F.count("*").alias("n_overlapping"), F.min("m.memory_id").alias("first_memory"))


def evidence_pruning(spark, sf_dir):
    return recall.prune_evidence(load(spark, sf_dir, "evidence"))


def scope_projection(spark, sf_dir):
    key = F.when(F.col("visibility") == "repository", F.concat(F.lit("repository:"), "repository")).when(F.col("visibility") == "run", F.concat(F.lit("run:"), "run_id")).otherwise(F.concat(F.lit("task:"), "task_id"))
    lane = F.when(F.col("kind").startswith("1"), "decision").when(F.col("kind").startswith("2"), "procedure").otherwise("fact")
    return load(spark, sf_dir, "memories").groupBy(key.alias("scope_key"), lane.alias("domain_lane")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


def lane_exact(spark, sf_dir):
    terms = _parts(spark, sf_dir).select("canonical_id", F.explode(F.array("p_name", "p_type", "p_brand", F.concat_ws(" ", "p_name", "p_type"))).alias("term"))
    return lanes.exact(terms, _asked(spark, sf_dir)).drop("raw_score")


EXACT_SQL = f"""WITH {A}, t AS (SELECT p_partkey AS canonical_id, unnest([p_name, p_type, p_brand, concat_ws(' ', p_name, p_type)]) AS term FROM part),
x AS (SELECT DISTINCT query_id, canonical_id FROM a JOIN t ON lower(trim(regexp_replace(a.text, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(t.term, '\\s+', ' ', 'g')))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY canonical_id) AS rank FROM x)
SELECT query_id, canonical_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 32"""


def lane_lexical(spark, sf_dir):
    return lanes.lexical(_parts(spark, sf_dir), _asked(spark, sf_dir))


_LEX = f"""qt AS (SELECT query_id, text, {TOK.format("text")} AS ts FROM a), qe AS (SELECT query_id, text, len(ts) AS n, unnest(ts) AS t FROM qt),
de AS (SELECT canonical_id, text, unnest({TOK.format("text")}) AS t FROM p),
lx AS (SELECT qe.query_id, de.canonical_id, round(count(*) * 1.0 / any_value(qe.n) + CASE WHEN any_value(contains(lower(de.text), lower(qe.text))) THEN 0.2 ELSE 0.0 END, 6) AS raw_score FROM qe JOIN de ON qe.t = de.t GROUP BY 1, 2),
lex AS (SELECT query_id, canonical_id, raw_score, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, canonical_id) AS rank FROM lx)"""
LEXICAL_SQL = f"WITH {P}, {A}, {_LEX} SELECT query_id, canonical_id, CAST(raw_score AS DOUBLE) AS raw_score, CAST(rank AS INTEGER) AS rank FROM lex WHERE rank <= 32"


def lane_fuzzy(spark, sf_dir):
    docs = _parts(spark, sf_dir).select("canonical_id", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return lanes.fuzzy(docs, _asked(spark, sf_dir), 0.25, 24)


_GRAMS = """SELECT {0}, substr('  ' || w || ' ', i, 3) AS g FROM (SELECT {0}, w, unnest(range(1, length(w) + 2)) AS i FROM (SELECT {0}, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {1}))"""
FUZZY_SQL = f"""WITH {A}, d AS (SELECT p_partkey AS canonical_id, concat_ws(' ', p_name, p_type) AS text FROM part),
qg AS (SELECT DISTINCT * FROM ({_GRAMS.format("query_id", "a")})), dg AS (SELECT DISTINCT * FROM ({_GRAMS.format("canonical_id", "d")})),
qn AS (SELECT query_id, count(*) AS n FROM qg GROUP BY 1), dn AS (SELECT canonical_id, count(*) AS n FROM dg GROUP BY 1),
s AS (SELECT query_id, canonical_id, count(*) AS c FROM qg JOIN dg ON qg.g = dg.g GROUP BY 1, 2),
x AS (SELECT s.query_id, s.canonical_id, round(c * 1.0 / (qn.n + dn.n - c), 6) AS raw_score FROM s JOIN qn ON s.query_id = qn.query_id JOIN dn ON s.canonical_id = dn.canonical_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw_score DESC, canonical_id) AS rank FROM x WHERE raw_score >= 0.25)
SELECT query_id, canonical_id, CAST(raw_score AS DOUBLE) AS raw_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 24"""


def lane_dense(spark, sf_dir):
    v = load(spark, sf_dir, "embeddings")
    queries = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return lanes.dense(v.select(F.col("vec_id").alias("canonical_id"), F.col("embedding").alias("vector")), queries, 10)


_DENSE = """dn AS (SELECT q.vec_id AS query_id, d.vec_id AS canonical_id, greatest(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(d.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))), 0) AS s
 FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
dense AS (SELECT query_id, canonical_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, canonical_id) AS rank FROM dn)"""
DENSE_SQL = f"WITH {_DENSE} SELECT query_id, canonical_id, round(s, 4) AS raw_score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10"


def lane_temporal(spark, sf_dir):
    docs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("canonical_id"), F.col("o_custkey").alias("scope"), F.col("o_orderdate").alias("at"))
    targets = load(spark, sf_dir, "asked").select("query_id", F.col("repository").alias("scope"), F.col("world_at").alias("target"))
    return lanes.temporal(docs, targets, 16)


TEMPORAL_SQL = """WITH x AS (SELECT q.query_id, o_orderkey AS canonical_id, o_orderdate AS moment, abs(epoch_us(o_orderdate) - epoch_us(q.world_at)) / 86400000000.0 AS apart FROM orders JOIN asked q ON o_custkey = q.repository),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY apart, moment, canonical_id) AS rank, count(*) OVER (PARTITION BY query_id) > 16 AS truncated FROM x)
SELECT query_id, canonical_id, CAST(round(1 / (1 + apart), 6) AS DOUBLE) AS raw_score, CAST(rank AS INTEGER) AS rank, truncated FROM r WHERE rank <= 16"""


def hybrid_recall(spark, sf_dir):
    """Exact and lexical lanes, fused."""
    return fusion.weighted_rrf({"exact": lane_exact(spark, sf_dir).withColumn("raw_score", F.lit(1.0)), "lexical": lane_lexical(spark, sf_dir)}, {"exact": 5, "lexical": 3}, 20)


HYBRID_SQL = f"""WITH {P}, {A}, {_LEX}, t AS (SELECT p_partkey AS canonical_id, unnest([p_name, p_type, p_brand, concat_ws(' ', p_name, p_type)]) AS term FROM part),
ex AS (SELECT query_id, canonical_id, row_number() OVER (PARTITION BY query_id ORDER BY canonical_id) AS rank FROM (SELECT DISTINCT query_id, canonical_id FROM a JOIN t ON lower(a.text) = lower(t.term))),
u AS (SELECT query_id, canonical_id, 5.0 / (60 + rank) AS w, 'exact' AS lane FROM ex WHERE rank <= 32 UNION ALL SELECT query_id, canonical_id, 3.0 / (60 + rank), 'lexical' FROM lex WHERE rank <= 32 AND raw_score > 0),
f AS (SELECT query_id, canonical_id, sum(w) AS raw, string_agg(lane, ',' ORDER BY lane) AS lanes FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, canonical_id) AS rank FROM f)
SELECT query_id, canonical_id, CAST(rank AS INTEGER) AS rank, lanes, round(least(1.0, raw / (5.0 / 61)), 6) AS score FROM r WHERE rank <= 20"""


def _relevance(spark, sf_dir):
    pairs = lane_lexical(spark, sf_dir).join(_parts(spark, sf_dir).select("canonical_id", F.col("text").alias("d")), "canonical_id").join(_asked(spark, sf_dir).withColumnRenamed("text", "q"), "query_id")
    relevance = F.greatest(text.coverage(text.tokens(F.col("q")), text.tokens(F.col("d"))), text.jaccard(text.trigrams(F.col("q")), text.trigrams(F.col("d"))))
    return pairs.withColumn("relevance", F.round(relevance, 6)).withColumn("tokens", text.token_estimate(F.col("d")).cast("long"))


def relevance_gate(spark, sf_dir):
    return fusion.gate(_relevance(spark, sf_dir), _asked(spark, sf_dir), 0.9, 10)


GATE_SQL = f"""WITH {P}, {A}, {_LEX}, k AS (SELECT l.query_id, l.canonical_id, a.text AS q, p.text AS d, len({TOK.format("a.text")}) AS nq FROM lex l JOIN a ON l.query_id = a.query_id JOIN p ON l.canonical_id = p.canonical_id WHERE l.rank <= 32),
c AS (SELECT query_id, canonical_id, len(list_intersect({TOK.format("q")}, {TOK.format("d")})) * 1.0 / nq AS cov FROM k),
g AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE round(cov, 6) >= 0.9) AS o FROM c GROUP BY 1)
SELECT a.query_id, least(coalesce(o, 0), 10) AS n_returned, coalesce(o, 0) > 10 AS overflow, CASE WHEN coalesce(o, 0) > 0 THEN 'none' WHEN coalesce(n, 0) > 0 THEN 'below_relevance_floor' ELSE 'no_relevant_recallable_candidates' END AS abstention FROM a LEFT JOIN g ON a.query_id = g.query_id"""


def pack_prefix(spark, sf_dir):
    return fusion.pack_prefix(_relevance(spark, sf_dir), 100)


PREFIX_SQL = f"""WITH {P}, {A}, {_LEX}, k AS (SELECT l.query_id, l.rank, sum(greatest(1, CAST(ceil(length(p.text) / 4.0) AS BIGINT))) OVER (PARTITION BY l.query_id ORDER BY l.rank) AS used FROM lex l JOIN p ON l.canonical_id = p.canonical_id WHERE l.rank <= 32)
SELECT query_id, count(*) AS n_kept, CAST(max(used) AS BIGINT) AS used_tokens FROM k WHERE used <= 100 GROUP BY 1"""


def dense_metrics(spark, sf_dir):
    """Quality of the dense lane where the same label is relevant."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label")
    sizes = v.groupBy("label").agg(F.count("*").alias("_n"))
    ranked = lane_dense(spark, sf_dir)
    label = v.select(F.col("vec_id").alias("canonical_id"), F.col("label").alias("_cl"))
    own = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(sizes, "label")
    hit = F.col("_cl") == F.col("label")
    got = ranked.join(label, "canonical_id").join(own.select("query_id", "label"), "query_id").groupBy("query_id").agg(F.count_if(hit).alias("hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(F.when(hit, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    return own.join(got, "query_id").groupBy("label").agg(F.count("*").alias("n_queries"), F.round(F.avg(F.col("hits") / 10), 4).alias("precision"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 4).alias("mrr"), F.round(F.avg("dcg"), 4).alias("dcg"))


METRICS_SQL = f"""WITH {_DENSE}, h AS (SELECT d.query_id, q.label, d.rank, c.label = q.label AS hit FROM dense d JOIN embeddings q ON d.query_id = q.vec_id JOIN embeddings c ON d.canonical_id = c.vec_id WHERE d.rank <= 10),
x AS (SELECT query_id, label, count(*) FILTER (WHERE hit) AS hits, min(rank) FILTER (WHERE hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1, 2)
SELECT label, count(*) AS n_queries, round(avg(hits / 10.0), 4) AS precision, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, round(avg(dcg), 4) AS dcg FROM x GROUP BY 1"""


def ranking_metrics(spark, sf_dir):
    judged = _asked(spark, sf_dir).join(load(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("text"), F.col("p_partkey").alias("canonical_id")), "text").select("query_id", "canonical_id")
    return evaluation.ranking_metrics(lane_lexical(spark, sf_dir), judged, 10)


RANKING_SQL = f"""WITH {P}, {A}, {_LEX}, j AS (SELECT a.query_id, p_partkey AS canonical_id FROM a JOIN part ON a.text = concat_ws(' ', p_name, p_type)), s AS (SELECT query_id, count(*) AS n FROM j GROUP BY 1),
h AS (SELECT l.query_id, l.rank, j.query_id IS NOT NULL AS hit FROM lex l LEFT JOIN j ON l.query_id = j.query_id AND l.canonical_id = j.canonical_id WHERE l.rank <= 10),
g AS (SELECT query_id, count(*) AS got, count(*) FILTER (WHERE hit) AS hits, min(rank) FILTER (WHERE hit) AS first, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1),
i AS (SELECT query_id, sum(1 / log2(k + 1)) AS ideal FROM (SELECT query_id, unnest(range(1, least(n, 10) + 1)) AS k FROM s) GROUP BY 1)
SELECT s.query_id, round(coalesce(hits, 0) * 1.0 / n, 6) AS recall, round(hits * 1.0 / got, 6) AS precision, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM s LEFT JOIN g ON s.query_id = g.query_id JOIN i ON s.query_id = i.query_id"""


QUERIES = {
    f.__name__: f
    for f in (canonical_recall, interval_overlap, evidence_pruning, scope_projection, lane_exact, lane_lexical, lane_fuzzy, lane_dense, lane_temporal, hybrid_recall, relevance_gate, pack_prefix, dense_metrics, ranking_metrics)
}
ORACLES = {
    "canonical_recall": with_views(RECALL_SQL, "memories", "evidence", "asked"),
    "interval_overlap": with_views("SELECT q.query_id, count(*) AS n_overlapping, min(m.memory_id) AS first_memory FROM memories m JOIN asked q ON m.repository = q.repository WHERE m.valid_from < q.world_at + INTERVAL 200 DAY AND (m.valid_to IS NULL OR q.world_at < m.valid_to) GROUP BY 1", "memories", "asked"),
    "evidence_pruning": with_views("SELECT memory_id, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY recorded_at, evidence_id) AS evidence_ids, count(*) AS n_evidence FROM (SELECT DISTINCT memory_id, evidence_id, recorded_at FROM evidence WHERE NOT rejected AND trust <> 'untrusted') GROUP BY 1", "evidence"),
    "scope_projection": with_views("SELECT CASE visibility WHEN 'repository' THEN 'repository:' || repository WHEN 'run' THEN 'run:' || run_id ELSE 'task:' || task_id END AS scope_key, CASE WHEN kind LIKE '1%' THEN 'decision' WHEN kind LIKE '2%' THEN 'procedure' ELSE 'fact' END AS domain_lane, count(*) AS n, round(sum(weight), 2) AS weight FROM memories GROUP BY 1, 2", "memories"),
    "lane_exact": EXACT_SQL,
    "lane_lexical": LEXICAL_SQL,
    "lane_fuzzy": FUZZY_SQL,
    "lane_dense": DENSE_SQL,
    "lane_temporal": with_views(TEMPORAL_SQL, "asked"),
    "hybrid_recall": HYBRID_SQL,
    "relevance_gate": GATE_SQL,
    "pack_prefix": PREFIX_SQL,
    "dense_metrics": METRICS_SQL,
    "ranking_metrics": RANKING_SQL,
}
