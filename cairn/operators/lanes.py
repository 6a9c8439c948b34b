"""Candidate lanes: exact terms, lexical overlap, trigrams, vectors, time.

A lane returns ``query_id, canonical_id, raw_score, rank``.  Ranks are total: ties go by
id.  Joins run on terms, never on all pairs.  ``keys`` are columns in which a document and
a query must agree, such as a scope: they take part in the joins, so nothing of another
scope is ever a candidate; a query that may see several scopes has a row for each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import text
from cairn.sources.tables import spread


def top(candidates: DataFrame, budget: int, *order: Column) -> DataFrame:
    """The first ``budget`` candidates of each query with their rank; Spark prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return candidates.withColumn("rank", rank).where(F.col("rank") <= budget)


def ranked(scored: DataFrame, budget: int) -> DataFrame:
    """The first ``budget`` of each query by score, then id."""
    return top(scored, budget, F.desc("raw_score"), F.asc("canonical_id"))


def exact(terms: DataFrame, queries: DataFrame, budget: int = 32, keys: tuple[str, ...] = ()) -> DataFrame:
    """``terms``: canonical_id, term; ``queries``: query_id, text.  Whole normalised queries equal to a term."""
    asked = queries.select("query_id", *keys, text.normalize_term(F.col("text")).alias("_t"))
    # a term that repeats is normalised once, and no query takes more of it than its first ids
    names = terms.select("term").distinct().withColumn("_t", text.normalize_term(F.col("term")))
    matched = names.join(asked, "_t").select("term", "query_id", *keys).distinct()
    nth = F.dense_rank().over(Window.partitionBy("term", *keys).orderBy("canonical_id"))
    first = terms.select("canonical_id", "term", *keys).join(matched, ["term", *keys], "left_semi").withColumn("_n", nth).where(F.col("_n") <= budget)
    found = first.join(matched, ["term", *keys]).select("query_id", "canonical_id").distinct()
    return ranked(found.withColumn("raw_score", F.lit(1.0)), budget)


def _texts(docs: DataFrame, budget: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``text``, its least id ``_tid``, and its first ``budget`` ids: a text that repeats under its keys is scored once, and no query takes more of it."""
    nth = F.row_number().over(Window.partitionBy("text", *keys).orderBy("canonical_id"))
    first = docs.select("canonical_id", "text", *keys).where("text IS NOT NULL").withColumn("_n", nth).where(F.col("_n") <= budget)
    return first.groupBy("text", *keys).agg(F.min("canonical_id").alias("_tid"), F.collect_list("canonical_id").alias("_ids"))


def lexical(docs: DataFrame, queries: DataFrame, budget: int = 32, most_tokens: int = 64, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of the query's tokens in the document, plus 0.2 if the whole query is part of it.

    Ids alone are joined and counted; texts are fetched only for candidates that the 0.2
    could still bring among the first ``budget``.
    """
    asked = queries.select("query_id", *keys, F.lower("text").alias("_q"), text.tokens(F.col("text"), most_tokens).alias("_qt"))
    texts = _texts(docs, budget, keys)
    # few texts can have many pairs: tasks are dealt anew, by text
    own = spread(texts.select("_tid", *keys, "text", F.size("_ids").alias("_m")), "_tid").select("_tid", "_m", *keys, _each(text.tokens(F.col("text"))).alias("_t")).where("_t IS NOT NULL")
    hits = own.join(asked.select("query_id", *keys, F.size("_qt").alias("_size"), F.explode("_qt").alias("_t")), ["_t", *keys]).groupBy("query_id", "_tid", "_size").agg(F.count("*").alias("_n"), F.max("_m").alias("_m"))
    base = hits.select("query_id", "_tid", (F.col("_n") / F.col("_size")).alias("_base"), "_m")
    # the budget counts ids, of which a text that repeats has many
    ids = F.sum("_m").over(Window.partitionBy("query_id").orderBy(F.desc("_base"), "_tid").rowsBetween(Window.unboundedPreceding, 0))
    last = F.max(F.when(F.col("_k") >= budget, F.col("_base"))).over(Window.partitionBy("query_id"))
    near = base.withColumn("_k", ids).withColumn("_last", last).where(F.col("_last").isNull() | (F.col("_base") + 0.2 + 1e-9 >= F.col("_last")))
    full = near.select("query_id", "_tid", "_base").join(texts, "_tid").join(asked.select("query_id", "_q").distinct() if keys else asked.select("query_id", "_q"), "query_id")
    scored = full.withColumn("raw_score", F.round(F.col("_base") + F.when(F.contains(F.lower("text"), "_q"), 0.2).otherwise(0.0), 6))
    return ranked(scored.select("query_id", F.explode("_ids").alias("canonical_id"), "raw_score"), budget)


def _each(c: Column) -> Column:
    """A row of each member of an array, or one null row: an inner explode filters on the array's size, which Spark moves down to every document and so makes the array there once more."""
    return F.explode_outer(c)


def _prefixes(sets: DataFrame, key: str, rarity: DataFrame, floor: float) -> DataFrame:
    """The rarest grams of each set: two sets with a likeness of ``floor`` share one of these."""
    grams = sets.select(key, F.size("_g").alias("_size"), _each(F.col("_g")).alias("_t")).where("_t IS NOT NULL").join(rarity, "_t", "left")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("_df", F.lit(0)), "_t"))
    return grams.withColumn("_k", nth).where(F.col("_k") <= F.col("_size") - F.ceil(floor * F.col("_size")) + 1).select(key, "_size", "_t")


def fuzzy(docs: DataFrame, queries: DataFrame, floor: float = 0.25, budget: int = 24, keys: tuple[str, ...] = ()) -> DataFrame:
    """Trigram Jaccard of at least ``floor``.

    Candidates are texts that share one of their rarest trigrams with a query (the common
    ones are left out of the join) and are neither too short nor too long for it; they are
    compared by all trigrams.
    """
    asked = queries.select("query_id", "text").distinct().where(F.length("text").between(3, 256)).select("query_id", text.trigrams(F.col("text")).alias("_g")).where(F.size("_g") > 0)
    texts = _texts(docs, budget, keys)
    own = texts.select("_tid", text.trigrams(F.col("text")).alias("_g"))
    rarity = own.select(_each(F.col("_g")).alias("_t")).where("_t IS NOT NULL").groupBy("_t").agg(F.count("*").alias("_df"))
    left, right = _prefixes(asked, "query_id", rarity, floor), _prefixes(own, "_tid", rarity, floor).withColumnRenamed("_size", "_own")
    fits = (F.col("_own") >= floor * F.col("_size")) & (floor * F.col("_own") <= F.col("_size"))
    if keys:
        left, right = left.join(queries.select("query_id", *keys).distinct(), "query_id"), right.join(texts.select("_tid", *keys), "_tid")
    pairs = left.join(right, ["_t", *keys]).where(fits).select("query_id", "_tid").distinct()
    full = pairs.join(asked, "query_id").join(own.withColumnRenamed("_g", "_h"), "_tid")
    both = F.size(F.array_intersect("_g", "_h"))
    scored = full.withColumn("raw_score", F.round(both / (F.size("_g") + F.size("_h") - both), 6)).where(F.col("raw_score") >= floor)
    ids = scored.select("query_id", "_tid", "raw_score").join(texts.select("_tid", "_ids"), "_tid")
    return ranked(ids.select("query_id", F.explode("_ids").alias("canonical_id"), "raw_score"), budget)


def temporal(docs: DataFrame, queries: DataFrame, budget: int = 16) -> DataFrame:
    """Nearest in time within a scope: 1 / (1 + days apart); ties: earlier first, then id.

    ``truncated``: whether the query had more candidates than ``budget``.
    """
    apart = F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("target").cast("timestamp"))) / 86_400_000_000
    # a few queries can have many pairs: they are dealt over all tasks
    scored = docs.join(spread(queries, "query_id"), "scope").withColumn("raw_score", F.round(1 / (1 + apart), 6)).withColumn("_apart", apart)
    # one more than the budget is fetched, to know
    more = top(scored, budget + 1, F.asc("_apart"), F.asc("at"), F.asc("canonical_id"))
    more = more.withColumn("truncated", F.max(F.col("rank") > budget).over(Window.partitionBy("query_id")))
    return more.where(F.col("rank") <= budget).select("query_id", "canonical_id", "raw_score", "rank", "truncated")


#: Vectors, or query vectors, of one key that meet in a task at once.
BLOCK = 4096
#: Rows that a meeting gives at most (without ties), and scores that it makes at once.
FOUND, SCORES = 1 << 20, 1 << 20


def nearest(vectors: DataFrame, queries: DataFrame, limit: int, keys: tuple[str, ...] = (), floor: float = 0.0, self_too: bool = False) -> DataFrame:
    """The ``limit`` vectors of highest cosine (0 to 1) for each query among those with its ``keys`` and its length.

    ``vectors``: canonical_id, vector, keys; ``queries``: query_id, vector, keys.  Rows
    without a vector take no part, and vectors of different lengths never meet.  The rows
    of a key are split by id hash into blocks, and each block of vectors meets each block
    of queries, so no task holds more however common the key is.  Returns query_id, keys,
    canonical_id and raw_score.
    """
    key = [*keys, "_length"]
    own = vectors.where("canonical_id IS NOT NULL AND vector IS NOT NULL").select(F.col("canonical_id").cast("long").alias("_id"), F.col("vector").cast("array<double>").alias("_v"), F.size("vector").alias("_length"), *keys)
    asked = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select(F.col("query_id").cast("long").alias("_id"), F.col("vector").cast("array<double>").alias("_v"), F.size("vector").alias("_length"), *keys)
    count = lambda d, name, size: d.groupBy(key).agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    # the more a query fetches, the fewer queries meet a block of vectors at once
    blocks = count(own, "_nv", BLOCK).join(count(asked, "_nq", max(1, min(BLOCK, FOUND // min(limit, BLOCK)))), key)
    part = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = own.join(blocks, key).select(*key, "_id", "_v", part("_nv").alias("_pv"), every("_nq").alias("_pq"))
    right = asked.join(blocks, key).select(*key, "_id", "_v", every("_nv").alias("_pv"), part("_nq").alias("_pq"))
    right = right.toDF(*right.columns)  # both sides can come from one table
    parts = [*key, "_pv", "_pq"]
    schema = T.StructType([T.StructField("query_id", T.LongType()), *(queries.schema[k] for k in keys), T.StructField("canonical_id", T.LongType()), T.StructField("raw_score", T.DoubleType())])
    met = left.groupBy(parts).cogroup(right.groupBy(parts)).applyInArrow(_meeting(keys, limit, floor, self_too), schema)
    best = F.row_number().over(Window.partitionBy("query_id", *keys).orderBy(F.desc("raw_score"), "canonical_id"))
    return met.withColumn("_n", best).where(F.col("_n") <= limit).drop("_n")


def _meeting(keys: tuple[str, ...], limit: int, floor: float, self_too: bool):
    def meet(x: pa.Table, y: pa.Table) -> pa.Table:
        own, ids = (t["_id"].combine_chunks().to_numpy() for t in (x, y))
        if not (len(own) and len(ids)):
            return pa.table({c: pa.array([], t) for c, t in (("query_id", pa.int64()), *((k, y[k].type) for k in keys), ("canonical_id", pa.int64()), ("raw_score", pa.float64()))})
        v, q = (_unit(np.stack(t["_v"].combine_chunks().to_numpy(zero_copy_only=False))) for t in (x, y))
        found = []
        step = max(1, SCORES // len(own))
        for a in range(0, len(ids), step):
            score = q[a : a + step] @ v.T
            np.clip(score, 0, 1, out=score)
            if not self_too:
                score[ids[a : a + step, None] == own] = -1
            k = min(limit, len(own))
            pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
            # ties at the edge of a block: all rows as good as the last one stay
            edge = np.take_along_axis(score, pick, axis=1).min(axis=1)
            row, col = np.nonzero((score >= np.maximum(edge, floor)[:, None]) & (score > -1))
            found.append((a + row, col, score[row, col]))
        row, col, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": pa.array(ids[row]), **{k: y[k].combine_chunks().take(pa.array(row)) for k in keys}, "canonical_id": pa.array(own[col]), "raw_score": pa.array(score)})

    return meet


def dense(vectors: DataFrame, queries: DataFrame, budget: int = 10, floor: float = 0.0) -> DataFrame:
    """Exact cosine top-k over all vectors of the query's length; a query is not its own neighbour."""
    return ranked(nearest(vectors, queries, budget, floor=floor), budget).withColumn("raw_score", F.round("raw_score", 4))


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size == 0, 1, size)
