"""The registered queries of the vector plane and their SQL: embeddings are the projection, of which parts are stale."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import vectors
from cairn.sources.tables import load

DIMENSIONS, BUDGET = 64, 8
#: Columns in SQL that Spark and DuckDB both run.
_PROJECTION = """vec_id AS canonical_id, CASE WHEN vec_id % 23 = 0 THEN vec_id + 1 ELSE vec_id END AS resource_id, concat('repository:', CAST(label % 3 AS STRING)) AS scope_key, CASE WHEN vec_id % 29 = 0 THEN 'old' ELSE 'm' END AS model,
 64 AS dimensions, 1 + vec_id % 4 AS version, CASE WHEN vec_id % 5 = 0 THEN 'old' ELSE concat('d', CAST(vec_id AS STRING)) END AS digest, CASE WHEN vec_id % 17 = 0 THEN slice(embedding, 1, 32) ELSE embedding END AS vector"""
_MEMORIES = """vec_id AS canonical_id, concat('repository:', CAST(CASE WHEN vec_id % 19 = 0 THEN label % 3 + 1 ELSE label % 3 END AS STRING)) AS scope_key, 1 + vec_id % 4 + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END AS version,
 concat('d', CAST(vec_id AS STRING)) AS digest, vec_id % 10 AS recorded_from"""
#: A third of the scopes has hardly any valid rows, so that its queries need further rounds.
_RECALLABLE = "vec_id % 11 <> 0 AND (label % 3 <> 1 OR vec_id % 9 = 1)"
_QUERIES = """vec_id AS query_id, label % 3 AS one, (label + 1) % 3 AS two, 'm' AS model, CASE WHEN vec_id % 100 = 40 THEN NULL WHEN vec_id % 100 = 60 THEN slice(embedding, 1, 32) ELSE embedding END AS vector"""


def _plane(spark, sf_dir):
    rows = load(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").selectExpr(*_split(_QUERIES)).withColumn("scope_keys", F.array(*[F.concat(F.lit("repository:"), F.col(c).cast("string")) for c in ("one", "two")]))
    return vectors.plane(rows.selectExpr(*_split(_PROJECTION)), rows.where(_RECALLABLE).selectExpr(*_split(_MEMORIES)), queries, DIMENSIONS, BUDGET, floor=0.05)


def _split(columns: str) -> list[str]:
    """The columns of a list in SQL, cut at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def dense_plane(spark, sf_dir):
    """Candidates of the dense lane over a projection with stale, ragged and foreign rows."""
    return _plane(spark, sf_dir)[0]


def dense_status(spark, sf_dir):
    """Which lanes are degraded, and why."""
    return _plane(spark, sf_dir)[1].select("query_id", "degraded", "reason")


def _duck(columns: str) -> str:
    return columns.replace("AS STRING", "AS VARCHAR").replace("slice(embedding, 1, 32)", "embedding[1:32]")


_SQL = f"""p AS (SELECT {_duck(_PROJECTION)} FROM embeddings), m AS (SELECT {_duck(_MEMORIES)} FROM embeddings WHERE {_RECALLABLE}), q AS (SELECT {_duck(_QUERIES)} FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vector, model, concat('repository:', CAST(one AS VARCHAR)) AS scope_key FROM q WHERE len(vector) = 64 UNION SELECT query_id, vector, model, concat('repository:', CAST(two AS VARCHAR)) FROM q WHERE len(vector) = 64),
x AS (SELECT s.query_id, m.canonical_id, m.recorded_from, greatest(0.0, least(1.0, list_dot_product(CAST(s.vector AS DOUBLE[]), CAST(p.vector AS DOUBLE[])) / sqrt(list_dot_product(CAST(s.vector AS DOUBLE[]), CAST(s.vector AS DOUBLE[])) * list_dot_product(CAST(p.vector AS DOUBLE[]), CAST(p.vector AS DOUBLE[]))))) AS score
  FROM s JOIN p ON p.scope_key = s.scope_key AND p.model = s.model AND len(p.vector) = 64 JOIN m ON m.canonical_id = p.canonical_id AND m.scope_key = p.scope_key AND m.version = p.version AND m.digest = p.digest WHERE p.resource_id = p.canonical_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, recorded_from DESC, canonical_id) AS rank FROM x WHERE score >= 0.05)"""
PLANE_SQL = f"WITH {_SQL} SELECT query_id, canonical_id, CAST(round(score, 6) AS DOUBLE) AS raw_score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {BUDGET}"

STATUS_SQL = f"""SELECT query_id, vector IS NULL OR len(vector) <> 64 AS degraded, CASE WHEN vector IS NULL THEN 'query_embedding_unavailable' WHEN len(vector) <> 64 THEN 'vector_dimension_mismatch' END AS reason FROM (SELECT {_duck(_QUERIES)} FROM embeddings WHERE vec_id % 20 = 0)"""
ORACLES = {"dense_plane": PLANE_SQL, "dense_status": STATUS_SQL}
QUERIES = {"dense_plane": dense_plane, "dense_status": dense_status}
