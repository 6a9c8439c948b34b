"""Table sources: Parquet tables by name, and the memory, evidence and query views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Views in SQL that Spark and DuckDB both run: orders stand for versioned memories.
VIEWS = {
    "memories": """SELECT o_orderkey AS memory_id, o_custkey AS repository, o_custkey % 7 AS run_id,
      CASE o_orderkey % 3 WHEN 0 THEN 'repository' WHEN 1 THEN 'run' ELSE 'task' END AS visibility, o_orderkey % 11 AS task_id,
      CASE o_orderstatus WHEN 'F' THEN 'confirmed' WHEN 'O' THEN 'tentative' ELSE 'refuted' END AS state, o_orderpriority AS kind, o_totalprice AS weight,
      o_orderdate AS valid_from, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 180 DAY END AS valid_to,
      o_orderdate + INTERVAL 1 DAY AS recorded_from, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL 365 DAY END AS recorded_to FROM orders""",
    "evidence": """SELECT l_orderkey AS memory_id, l_orderkey * 8 + l_linenumber AS evidence_id, l_suppkey AS source_id, l_returnflag = 'R' AS rejected,
      CASE WHEN l_linestatus = 'O' THEN 'untrusted' ELSE 'trusted' END AS trust, l_shipdate AS recorded_at FROM lineitem""",
    "asked": """SELECT o_custkey AS query_id, o_custkey AS repository, o_custkey % 7 AS run_id, o_custkey % 11 AS task_id,
      max(o_orderdate) AS known_at, min(o_orderdate) + INTERVAL 400 DAY AS world_at, o_custkey % 2 = 0 AS include_refuted FROM orders GROUP BY o_custkey""",
    # items of an order as the candidates of a query, in the order of two lanes and of two scorers
    "pool": """SELECT l_orderkey AS query_id, l_orderkey * 8 + l_linenumber AS canonical_id, l_partkey AS value_id, l_returnflag AS family, CAST(l_quantity AS BIGINT) AS tokens,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS lexical_rank, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber) AS dense_rank,
      l_extendedprice / 100000 AS lexical_score, l_quantity / 50 AS dense_score, 100 * l_discount - 8 AS logit, 10 * l_tax AS late_score, 10 * l_discount AS relevance, l_returnflag = 'R' AS relevant
      FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_returnflag) AS l_returnflag, max(l_quantity) AS l_quantity, max(l_extendedprice) AS l_extendedprice, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY l_orderkey, l_linenumber) x""",
    # orders as tasks of a run (the customer); a task needs the one before it of the same customer
    "tasks": """SELECT o_orderkey AS task_id, o_custkey AS run_id, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 5 = 0 THEN 'claimed' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'ready' END AS state,
      CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS available_at, o_orderdate AS created_at, o_orderkey % 4 AS version,
      lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS needs, o_orderkey % 9 AS agent_id FROM orders""",
}
#: The table under each view, where it is not orders.
UNDER = {"evidence": "lineitem", "pool": "lineitem"}
#: Views whose rows are dealt by this column of the table under them, and the rows that a task gets at most on average.
DEALT, ROWS = {"pool": "l_orderkey"}, 400_000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a view over tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    table = UNDER.get(name, "orders")
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if name in DEALT:
        source = dealt(source, DEALT[name])
    return spark.sql(VIEWS[name].replace(f"FROM {table}", "FROM {source}"), source=source)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` over as many tasks as their number asks for, so that what a task holds does not grow with the table.

    What is grouped, ranked or joined by ``key`` and more stays in these tasks.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, -(-df.count() // ROWS)), key)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many tasks as shuffles have: a small file of short rows is one task's, however much is made of each row."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_views(sql: str, *names: str) -> str:
    """``sql`` for DuckDB with the named views in front."""
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {views}{', ' + sql.lstrip()[5:] if sql.lstrip().startswith('WITH ') else ' ' + sql}"


def typed(sql: str, **types: str) -> str:
    """``sql`` with some of its columns cast, for DuckDB's types to be Spark's."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS {t}) AS {c}' for c, t in types.items())}) FROM ({sql})"
