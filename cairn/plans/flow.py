"""The registered whole recall and its SQL: parts are memories, distinct names and types the queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import flow, vectors
from cairn.plans.retrieval import _GRAMS, TOK
from cairn.sources.shared import written
from cairn.sources.tables import load, spread

EPOCH = "TIMESTAMP '1995-01-01'"


def whole_recall(spark, sf_dir):
    """Lanes, fusion, graph, second fusion, check, relevance, floor and packing: two scopes a query, two purposes, some queries without a token, some with a budget."""
    part = load(spark, sf_dir, "part")
    at = F.expr(f"CAST({EPOCH} AS TIMESTAMP_NTZ) + make_dt_interval(CAST(p_retailprice AS INT))")
    memories = spread(part, "p_partkey").select(F.col("p_partkey").alias("canonical_id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.concat_ws(" ", "p_name", "p_type").alias("lookup"), F.array("p_name", "p_type", "p_brand", F.concat_ws(" ", "p_name", "p_type")).alias("terms"), F.col("p_size").alias("scope_key"), at.alias("at"), (F.col("p_partkey") % 13 != 0).alias("recallable"))
    memories = written(memories, "memories")  # each lane reads them
    first = part.groupBy("p_name", "p_type").agg(F.min_by(F.struct(F.col("p_partkey").alias("id"), "p_size", at.alias("at")), "p_partkey").alias("f"))
    k = F.col("f.id")
    words = F.when(k % 3 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(F.concat(F.lit("which "), "p_name", F.lit(" is "), "p_type"))
    queries = first.select(
        k.alias("query_id"),
        F.when(k % 7 == 0, "??!!").otherwise(words).alias("text"),
        F.array(F.col("f.p_size"), F.col("f.p_size") % 50 + 1).alias("scope_keys"),
        F.when((k % 2 == 0) | (k % 7 == 0), F.col("f.at")).alias("target"),
        F.when(k % 2 == 0, "interactive_recall").otherwise("historical_audit").alias("purpose"),
        F.when(k % 2 == 0, 5).otherwise(3).alias("limit"),
        F.when(k % 7 == 0, 0.0).otherwise(0.5).alias("min_score"),
        F.when(k % 4 == 0, 25).alias("tokens"),
    )
    item = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linenumber") == 1, F.struct("l_partkey", "l_returnflag"))).alias("a"), F.max(F.when(F.col("l_linenumber") == 2, F.col("l_partkey"))).alias("dst"))
    edges = item.where("a IS NOT NULL AND dst IS NOT NULL").select(F.col("a.l_partkey").alias("src"), "dst", F.when(F.col("a.l_returnflag") == "R", "contradicts").when(F.col("a.l_returnflag") == "A", "supports").otherwise("related_to").alias("relation"))
    vector = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("canonical_id"), F.col("embedding").alias("vector"))
    projection = vector.join(memories.select("canonical_id", "scope_key"), "canonical_id").select("canonical_id", F.col("canonical_id").alias("resource_id"), "scope_key", F.lit("m").alias("model"), F.lit(64).alias("dimensions"), F.lit(1).alias("version"), F.when(F.col("canonical_id") % 5 == 0, "old").otherwise("d").alias("digest"), "vector")
    canonical = memories.where("recallable").select("canonical_id", "scope_key", F.lit(1).alias("version"), F.lit("d").alias("digest"), F.lit(0).alias("recorded_from"))
    asked = queries.select("query_id").join(vector.withColumnRenamed("canonical_id", "query_id"), "query_id").withColumn("model", F.lit("m"))
    return flow.recall(memories, queries, edges, vectors.Plane(projection, canonical, asked, 64))


STOPS = ", ".join(f"'{w}'" for w in flow.FUNCTION_WORDS)
RECALL_SQL = rf"""WITH RECURSIVE p AS (SELECT p_partkey AS canonical_id, concat_ws(' ', p_name, p_type, p_brand) AS text, concat_ws(' ', p_name, p_type) AS lookup, p_name, p_type, p_brand, p_size, {EPOCH} + to_days(CAST(floor(p_retailprice) AS INTEGER)) AS moment FROM part),
a0 AS (SELECT min(canonical_id) AS query_id, p_name, p_type FROM p GROUP BY 2, 3),
a AS (SELECT query_id, CASE WHEN query_id % 7 = 0 THEN '??!!' WHEN query_id % 3 = 0 THEN a0.p_name || ' ' || a0.p_type ELSE 'which ' || a0.p_name || ' is ' || a0.p_type END AS text, p_size, CASE WHEN query_id % 2 = 0 OR query_id % 7 = 0 THEN moment END AS target, query_id % 2 = 0 AS even,
 CASE WHEN query_id % 2 = 0 THEN 5 ELSE 3 END AS most, CASE WHEN query_id % 7 = 0 THEN 0.0 ELSE 0.5 END AS floor, CASE WHEN query_id % 4 = 0 THEN 25 END AS budget FROM a0 JOIN p ON query_id = canonical_id),
sc AS (SELECT query_id, p_size AS scope FROM a UNION SELECT query_id, p_size % 50 + 1 FROM a),
t AS (SELECT canonical_id, p_size, unnest([p_name, p_type, p_brand, lookup]) AS term FROM p),
ex AS (SELECT query_id, canonical_id, 1.0 AS s, row_number() OVER (PARTITION BY query_id ORDER BY canonical_id) AS k FROM (SELECT DISTINCT a.query_id, canonical_id FROM a JOIN t ON lower(a.text) = lower(t.term) JOIN sc ON sc.query_id = a.query_id AND scope = t.p_size)),
qt AS (SELECT query_id, text, {TOK.format("text")} AS ts FROM a), qe AS (SELECT query_id, text, len(ts) AS n, unnest(ts) AS t FROM qt), de AS (SELECT canonical_id, p_size, text, unnest({TOK.format("text")}) AS t FROM p),
lx AS (SELECT qe.query_id, de.canonical_id, round(count(*) * 1.0 / any_value(qe.n) + CASE WHEN any_value(contains(lower(de.text), lower(qe.text))) THEN 0.2 ELSE 0.0 END, 6) AS s FROM qe JOIN sc ON sc.query_id = qe.query_id JOIN de ON qe.t = de.t AND scope = de.p_size GROUP BY 1, 2),
lex AS (SELECT query_id, canonical_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, canonical_id) AS k FROM lx),
d AS (SELECT canonical_id, lookup AS text FROM p), qg AS (SELECT DISTINCT * FROM ({_GRAMS.format("query_id", "a")})), dg AS (SELECT DISTINCT * FROM ({_GRAMS.format("canonical_id", "d")})), qn AS (SELECT query_id, count(*) AS n FROM qg GROUP BY 1), dn AS (SELECT canonical_id, count(*) AS n FROM dg GROUP BY 1),
sv AS (SELECT query_id, canonical_id FROM sc JOIN p ON scope = p_size),
sh AS (SELECT qg.query_id, dg.canonical_id, count(*) AS c FROM sv JOIN qg ON qg.query_id = sv.query_id JOIN dg ON dg.canonical_id = sv.canonical_id AND qg.g = dg.g GROUP BY 1, 2), fz AS (SELECT sh.query_id, sh.canonical_id, round(c * 1.0 / (qn.n + dn.n - c), 6) AS s FROM sh JOIN qn ON sh.query_id = qn.query_id JOIN dn ON sh.canonical_id = dn.canonical_id),
fuz AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, canonical_id) AS k FROM fz WHERE s >= 0.25),
tm AS (SELECT a.query_id, canonical_id, moment, abs(epoch_us(moment) - epoch_us(target)) / 86400000000.0 AS apart FROM a JOIN sc ON sc.query_id = a.query_id JOIN p ON scope = p.p_size WHERE target IS NOT NULL), tem AS (SELECT query_id, canonical_id, round(1 / (1 + apart), 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY apart, moment, canonical_id) AS k FROM tm),
vx AS (SELECT sv.query_id, sv.canonical_id, greatest(0.0, least(1.0, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))))) AS s FROM sv JOIN embeddings q ON q.vec_id = sv.query_id JOIN embeddings v ON v.vec_id = sv.canonical_id WHERE v.vec_id % 5 <> 0 AND v.vec_id % 13 <> 0),
den AS (SELECT query_id, canonical_id, round(s, 6) AS s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, canonical_id) AS k FROM vx),
u AS (SELECT query_id, canonical_id, 5.0 / (60 + k) AS w, 'exact' AS lane FROM ex WHERE k <= 32 UNION ALL SELECT query_id, canonical_id, CASE WHEN even THEN 3.0 ELSE 4.0 END / (60 + k), 'lexical' FROM lex JOIN a USING (query_id) WHERE k <= CASE WHEN even THEN 40 ELSE 32 END
 UNION ALL SELECT query_id, canonical_id, CASE WHEN even THEN 1.0 ELSE 0.75 END / (60 + k), 'fuzzy' FROM fuz JOIN a USING (query_id) WHERE k <= CASE WHEN even THEN 25 ELSE 24 END UNION ALL SELECT query_id, canonical_id, CASE WHEN even THEN 2.0 ELSE 4.0 END / (60 + k), 'temporal' FROM tem JOIN a USING (query_id) WHERE k <= CASE WHEN even THEN 20 ELSE 16 END AND s > 0
 UNION ALL SELECT query_id, canonical_id, CASE WHEN even THEN 4.0 ELSE 2.0 END / (60 + k), 'dense' FROM den JOIN a USING (query_id) WHERE k <= CASE WHEN even THEN 40 ELSE 32 END AND s > 0),
f1 AS (SELECT query_id, canonical_id, sum(w) AS raw FROM u GROUP BY 1, 2), r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, canonical_id) AS k FROM f1),
r0 AS (SELECT query_id, canonical_id AS node, round(least(1.0, raw / (5.0 / 61)), 6) AS act FROM r1 JOIN a USING (query_id) WHERE k <= CASE WHEN even THEN 5 ELSE 4 END),
li AS (SELECT l_orderkey, max({{'p': l_partkey, 'f': l_returnflag}}) FILTER (WHERE l_linenumber = 1) AS x, max(l_partkey) FILTER (WHERE l_linenumber = 2) AS dst FROM lineitem GROUP BY 1), e AS (SELECT x.p AS src, dst, CASE x.f WHEN 'R' THEN 0.88 WHEN 'A' THEN 1.0 ELSE 0.75 END AS w, x.f = 'A' AS directed FROM li WHERE x IS NOT NULL AND dst IS NOT NULL AND x.p <> dst),
b AS (SELECT src, dst, CAST(max(w) AS DOUBLE) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT dst, src, CASE WHEN directed THEN w * 0.95 ELSE w END FROM e) GROUP BY 1, 2), st AS (SELECT src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS n FROM b) WHERE n <= 8),
pt AS (SELECT canonical_id AS node, {TOK.format("text")} AS ts FROM p),
x1 AS (SELECT r0.query_id, st.dst AS node, max(act * w * 0.85 * (CASE WHEN len(qt.ts) = 0 THEN 1.0 ELSE 0.6 + 0.4 * len(list_intersect(qt.ts, pt.ts)) / len(qt.ts) END)) AS act FROM r0 JOIN st ON r0.node = st.src JOIN qt ON qt.query_id = r0.query_id JOIN pt ON pt.node = st.dst JOIN sv ON sv.query_id = r0.query_id AND sv.canonical_id = st.dst GROUP BY 1, 2),
g1 AS (SELECT x1.query_id, x1.node AS canonical_id, round(x1.act, 6) AS s FROM x1 LEFT JOIN r0 ON r0.query_id = x1.query_id AND r0.node = x1.node WHERE r0.node IS NULL OR round(x1.act, 12) > round(r0.act, 12)),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, canonical_id) AS k FROM g1),
u2 AS (SELECT * FROM u UNION ALL SELECT query_id, canonical_id, CASE WHEN even THEN 0.5 ELSE 1.25 END / (60 + k), 'graph' FROM gr JOIN a USING (query_id) WHERE k <= CASE WHEN even THEN 20 ELSE 16 END), f2 AS (SELECT query_id, canonical_id, sum(w) AS raw, string_agg(lane, ',' ORDER BY lane) AS lanes FROM u2 GROUP BY 1, 2),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, canonical_id) AS k FROM f2),
tq AS (SELECT query_id, CASE WHEN len(list_filter(ts, lambda w: w NOT IN ({STOPS}))) > 0 THEN list_filter(ts, lambda w: w NOT IN ({STOPS})) ELSE ts END AS ts FROM qt),
rel AS (SELECT r2.query_id, r2.canonical_id, r2.k, lanes, round(least(1.0, raw / (5.0 / 61)), 6) AS score, greatest(1, CAST(ceil(length(p.text) / 4.0) AS BIGINT)) AS tokens, round(greatest(CASE WHEN contains(lanes, 'exact') THEN 1.0 ELSE 0.0 END, CASE WHEN len(tq.ts) = 0 THEN 0.0 ELSE len(list_intersect(tq.ts, pt.ts)) * 1.0 / len(tq.ts) END, coalesce(c * 1.0 / (qn.n + dn.n - c), 0), coalesce(CASE WHEN contains(lanes, 'dense') THEN den.s END, 0)), 6) AS relevance
 FROM r2 JOIN p ON p.canonical_id = r2.canonical_id AND p.canonical_id % 13 <> 0 JOIN tq ON tq.query_id = r2.query_id JOIN pt ON pt.node = r2.canonical_id LEFT JOIN qn ON qn.query_id = r2.query_id JOIN dn ON dn.canonical_id = r2.canonical_id LEFT JOIN sh ON sh.query_id = r2.query_id AND sh.canonical_id = r2.canonical_id LEFT JOIN den ON den.query_id = r2.query_id AND den.canonical_id = r2.canonical_id WHERE r2.k <= 128),
h AS (SELECT * FROM (SELECT rel.*, most, budget, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank FROM rel JOIN a USING (query_id) WHERE relevance >= floor) WHERE rank <= CASE WHEN budget IS NULL THEN most ELSE 4 * most END),
pk AS (SELECT query_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, false AS kept FROM (SELECT DISTINCT query_id FROM h)
 UNION ALL SELECT h.query_id, h.rank, used + CASE WHEN (budget IS NULL OR used + tokens <= budget) AND n < most THEN tokens ELSE 0 END, n + CASE WHEN (budget IS NULL OR used + tokens <= budget) AND n < most THEN 1 ELSE 0 END, (budget IS NULL OR used + tokens <= budget) AND n < most FROM pk JOIN h ON h.query_id = pk.query_id AND h.rank = pk.rank + 1)
SELECT h.query_id, canonical_id, CAST(h.rank AS INTEGER) AS rank, tokens, kept, lanes, score, CAST(relevance AS DOUBLE) AS relevance FROM h JOIN pk ON pk.query_id = h.query_id AND pk.rank = h.rank"""

QUERIES = {"whole_recall": whole_recall}
ORACLES = {"whole_recall": RECALL_SQL}
