"""Evaluation: ranking metrics, paired comparisons, summaries, packing choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.reports import percentiles


def _hits(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """``ranked`` without repetition, cut at ``k`` (places are counted anew), with ``hit``."""
    lists = [c for c in ("lane", "query_id") if c in ranked.columns]
    first = ranked.groupBy(*lists, "canonical_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy(*lists).orderBy("rank", "canonical_id"))
    cut = first.withColumn("rank", place).where(F.col("rank") <= k)
    return cut.join(judged.select("query_id", "canonical_id").distinct().withColumn("_r", F.lit(True)), ["query_id", "canonical_id"], "left").withColumn("hit", F.coalesce("_r", F.lit(False))).drop("_r")


def _scores(cases: DataFrame, hits: DataFrame, judged: DataFrame, k: int, by: list[str]) -> DataFrame:
    size = judged.groupBy("query_id").agg(F.count_distinct("canonical_id").alias("n_relevant"))
    got = hits.groupBy(*by, "query_id").agg(F.count("*").alias("returned"), F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least("n_relevant", F.lit(k))).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    rows = cases.join(size, "query_id", "left").join(got, [*by, "query_id"], "left").na.fill(0, ["n_relevant", "returned", "hits"]).na.fill(0.0, ["dcg"])
    answerable = F.col("n_relevant") > 0
    return rows.select(
        *by,
        *[c for c in cases.columns if c not in by],
        "n_relevant",
        "returned",
        F.when(answerable, F.col("hits") / F.col("n_relevant")).alias("recall"),
        F.when(answerable & (F.col("returned") > 0), F.col("hits") / F.col("returned")).alias("precision"),
        F.when(answerable, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(answerable, F.col("dcg") / ideal).alias("ndcg"),
    )


def ranking_metrics(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG at ``k`` of every judged query.

    ``ranked``: query_id, canonical_id, rank; ``judged``: query_id, canonical_id (relevant).
    Precision is over what was returned: null for a query without results.
    """
    cases = judged.select("query_id").distinct()
    rows = _scores(cases, _hits(ranked, judged, k), judged, k, [])
    return rows.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "mrr", "ndcg")])


def lane_metrics(ranked: DataFrame, judged: DataFrame, cases: DataFrame, k: int, lanes: list[str], slices: list[str] | None = None) -> DataFrame:
    """Means over all cases by lane, with how well empty results tell cases without an answer.

    ``ranked``: lane, query_id, canonical_id, rank; ``cases``: query_id and the columns of
    ``slices``.  With slices, a row for each of their values and one (null) for all.
    """
    every = cases.withColumn("lane", F.explode(F.array(*map(F.lit, lanes))))
    rows = _scores(every, _hits(ranked, judged, k), judged, k, ["lane"])
    groups = rows.groupingSets([["lane"], ["lane", *slices]], "lane", *slices) if slices else rows.groupBy("lane")
    unanswered, silent = F.count_if(F.expr("n_relevant = 0")), F.count_if(F.expr("returned = 0"))
    right = F.count_if(F.expr("n_relevant = 0 AND returned = 0"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c)
    return groups.agg(
        F.count("*").alias("cases"),
        F.count_if(F.expr("n_relevant > 0")).alias("answerable"),
        *[mean(c) for c in ("recall", "precision", "mrr", "ndcg")],
        F.round(F.when(silent == 0, 1.0).otherwise(right / silent), 6).alias("no_answer_precision"),
        F.round(F.when(unanswered == 0, 1.0).otherwise(right / unanswered), 6).alias("no_answer_recall"),
    )


def bundle_metrics(ranked: DataFrame, judged: DataFrame, cases: DataFrame, k: int, floors: list[float]) -> DataFrame:
    """What is handed over at each floor of ``relevance``: size, precision, recall, abstention.

    ``ranked``: query_id, canonical_id, rank, relevance (null: not recorded, kept).  An
    answerable case that gets nothing has precision 0.
    """
    rows = ranked.where(F.col("rank") <= k).join(judged.select("query_id", "canonical_id").distinct().withColumn("_r", F.lit(1)), ["query_id", "canonical_id"], "left")
    at = F.explode(F.array(*[F.lit(float(x)) for x in floors])).alias("floor")
    kept = rows.select("*", at).where(F.col("relevance").isNull() | (F.col("relevance") >= F.col("floor"))).groupBy("query_id", "floor").agg(F.count("*").alias("n"), F.count("_r").alias("hits"))
    size = judged.groupBy("query_id").agg(F.count_distinct("canonical_id").alias("n_relevant"))
    every = cases.select("query_id", at).join(size, "query_id", "left").join(kept, ["query_id", "floor"], "left").na.fill(0, ["n", "hits", "n_relevant"])
    answerable = F.col("n_relevant") > 0
    right, silent, unanswered = F.count_if(F.expr("n = 0 AND n_relevant = 0")), F.count_if(F.expr("n = 0")), F.count_if(F.expr("n_relevant = 0"))
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(answerable, c)), F.lit(0.0)), 6)
    return every.groupBy("floor").agg(
        F.count("*").alias("cases"),
        F.count_if(answerable).alias("answerable"),
        mean(F.col("n")).alias("mean_size"),
        mean(F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)).alias("precision"),
        mean(F.col("hits") / F.col("n_relevant")).alias("recall"),
        silent.alias("abstained"),
        F.round(F.when(silent == 0, 1.0).otherwise(right / silent), 6).alias("no_answer_precision"),
        F.round(F.when(unanswered == 0, 1.0).otherwise(right / unanswered), 6).alias("no_answer_recall"),
    )


def capped_recall(ranked: DataFrame, judged: DataFrame, cap: int) -> DataFrame:
    """Share of each query's relevant items that were found at all, and within the first ``cap`` places."""
    rows = judged.select("query_id", "canonical_id").distinct().join(ranked.groupBy("query_id", "canonical_id").agg(F.min("rank").alias("rank")), ["query_id", "canonical_id"], "left")
    found, kept = F.count("rank"), F.count_if(F.col("rank") <= cap)
    return rows.groupBy("query_id").agg(F.round(found / F.count("*"), 6).alias("before_cap"), F.round(kept / F.count("*"), 6).alias("after_cap"), (found - kept).alias("lost"))


def answer_in_context(packed: DataFrame, judged: DataFrame, cases: DataFrame) -> DataFrame:
    """How often relevant items are in the packed bundle: any, all, and the bundles' sizes.

    ``packed``: query_id, canonical_id, tokens, kept (boolean).
    """
    rows = packed.join(judged.select("query_id", "canonical_id").distinct().withColumn("_r", F.lit(1)), ["query_id", "canonical_id"], "left")
    got = rows.groupBy("query_id").agg(F.count_if("kept").alias("n"), F.sum(F.when(F.col("kept"), F.col("tokens")).otherwise(0)).alias("t"), F.count_if(F.col("kept") & F.col("_r").isNotNull()).alias("hits"), F.count_if(~F.col("kept")).alias("dropped"))
    size = judged.groupBy("query_id").agg(F.count_distinct("canonical_id").alias("n_relevant"))
    every = cases.select("query_id").join(size, "query_id", "left").join(got, "query_id", "left").na.fill(0)
    return _in_context(every, [])


def _in_context(every: DataFrame, by: list[str]) -> DataFrame:
    """``every``: a row of each case, with n_relevant, and n, t, hits and dropped of its bundle."""
    answerable = F.col("n_relevant") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    share = lambda c: mean(F.when(answerable, c.cast("int")))
    return every.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.count_if(answerable).alias("answerable"),
        share(F.col("hits") > 0).alias("any_gold"),
        share(F.col("hits") >= F.col("n_relevant")).alias("all_gold"),
        mean(F.when(answerable, F.col("hits") / F.col("n_relevant"))).alias("recall_in_bundle"),
        mean(F.col("n")).alias("mean_kept"),
        mean(F.col("t")).alias("mean_tokens"),
        F.count_if(F.expr("dropped > 0")).alias("truncated"),
    )


def answers_by_budget(items: DataFrame, bounds: list[tuple[int | None, int | None]]) -> DataFrame:
    """``answer_in_context`` of the greedy bundles (``fusion.pack``) of several bounds, in one pass over the items.

    ``items``: query_id, canonical_id, rank, tokens, relevant (boolean), each item of a
    query once; every case has items, and they are all that is judged.  ``bounds``: budget
    and most items, null for none.  A query's list is folded within its row for each pair
    of bounds, and its four counts alone leave the row.
    """
    lists = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "canonical_id", F.col("tokens").cast("long").alias("tokens"), F.coalesce("relevant", F.lit(False)).alias("relevant")))).alias("_l"), F.count_if("relevant").alias("n_relevant"))
    names = ("n", "t", "hits", "dropped")
    state = lambda *values: F.struct(*[v.cast("long").alias(c) for c, v in zip(names, values, strict=True)])

    def fold(budget: int | None, most: int | None) -> Column:
        def step(a: Column, x: Column) -> Column:
            fits = F.lit(True) if budget is None else F.coalesce(a["t"] + x["tokens"] <= budget, F.lit(False))
            fits = fits if most is None else fits & (a["n"] < most)
            return F.when(fits, state(a["n"] + 1, a["t"] + F.coalesce(x["tokens"], F.lit(0)), a["hits"] + x["relevant"].cast("long"), a["dropped"])).otherwise(state(a["n"], a["t"], a["hits"], a["dropped"] + 1))

        return F.aggregate("_l", state(*[F.lit(0)] * 4), step)

    bundles = F.array(*[F.struct(F.lit(b).cast("int").alias("budget"), F.lit(m).cast("int").alias("max_items"), fold(b, m).alias("got")) for b, m in bounds])
    every = lists.select("n_relevant", F.explode_outer(bundles).alias("_b")).select("n_relevant", "_b.budget", "_b.max_items", "_b.got.*")
    return _in_context(every, ["budget", "max_items"])


def paired(baseline: DataFrame, treatment: DataFrame, case: str, value: str, by: str) -> DataFrame:
    """Wins, losses, ties and the mean difference of the treatment, by stratum; cases of one arm alone are counted."""
    b, t = (d.select(case, by, F.col(value).alias(n)) for d, n in ((baseline, "_b"), (treatment, "_t")))
    both = b.join(t, [case, by], "full_outer")
    return both.groupBy(by).agg(
        F.count_if(F.col("_t") > F.col("_b")).alias("wins"),
        F.count_if(F.col("_t") < F.col("_b")).alias("losses"),
        F.count_if(F.col("_t") == F.col("_b")).alias("ties"),
        F.count_if(F.col("_t").isNull() | F.col("_b").isNull()).alias("unpaired"),
        F.round(F.avg(F.col("_t") - F.col("_b")), 4).alias("mean_delta"),
    )


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, sum, mean, smallest, median, 95th percentile (interpolated) and largest; no group is sorted in one task."""
    v = F.col(value)
    plain = rows.groupBy(by).agg(F.count(v).alias("n"), F.round(F.sum(v), 2).alias("total"), F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))
    middle = percentiles(rows, by, value, {"p50": 0.5, "p95": 0.95}).select(by, F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))
    return plain.join(middle, by, "left")


#: Shares of the four terms (fixed values).
RELEVANCE, COVERAGE, REPRESENTATION, DIVERSITY = 0.35, 0.30, 0.25, 0.10


MOST_CANDIDATES = 128
#: Pairs of items that are worked on at once (fixed value).
TOGETHER = 1 << 16


def facility_location(items: DataFrame, budget: int, max_items: int | None = None) -> DataFrame:
    """Choose items of each query under a token budget for relevance, coverage, likeness and variety.

    ``items``: query_id, canonical_id, rank, tokens, relevance, terms, asked (the query's
    terms that the item has), labels (arrays).  Of a query only the first 128 by rank are
    looked at, as lanes bound its candidates; so a group is small.  Of two greedy passes,
    by gain and by gain per token, the one of the better value is taken.  Queries with
    equally many items are worked on together, as arrays.
    """

    def members(words: tuple[np.ndarray, np.ndarray, int], rows: np.ndarray) -> np.ndarray:
        """0 and 1 by query, item and word of the query (in any order); ``rows``: each query's rows."""
        word, offsets, n_words = words
        size = offsets[rows + 1] - offsets[rows]
        at = np.repeat(np.arange(rows.size), size.ravel())
        own = word[np.repeat(offsets[rows].ravel() - np.cumsum(size) + size.ravel(), size.ravel()) + np.arange(len(at))]
        query, item = at // rows.shape[1], at % rows.shape[1]
        pairs, nth = np.unique(query * n_words + own, return_inverse=True)
        slot = np.arange(len(pairs)) - np.searchsorted(pairs // n_words, pairs // n_words)
        out = np.zeros((*rows.shape, int(slot.max(initial=-1)) + 1))
        out[query, item, slot[nth]] = 1.0
        return out

    def coded(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the words of all rows, where each row's begin, and how many numbers there are."""
        found = column.flatten().dictionary_encode(null_encoding="encode")
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        return found.indices.to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64), len(found.dictionary) + 1

    def choose(words: list, tokens: np.ndarray, relevance: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether each item is chosen, for queries of equally many items; ``rows``: each query's rows."""
        n = rows.shape[1]
        most = n if max_items is None else min(n, max_items)
        terms, *marks = (members(w, rows) for w in words)
        tokens, relevance = tokens[rows], relevance[rows]
        both, size = terms @ terms.transpose(0, 2, 1), terms.sum(axis=2)
        empty = (size[:, :, None] == 0) | (size[:, None, :] == 0)
        like = np.where(empty, np.eye(n), both / np.maximum(size[:, :, None] + size[:, None, :] - both, 1))
        width = [np.maximum(m.max(axis=1).sum(axis=1), 1) if m.shape[2] else np.ones(len(rows)) for m in marks]
        cost = np.maximum(1, tokens)

        def value(chosen: np.ndarray) -> np.ndarray:
            """Of each query's chosen items, as 0 and 1 by query and item."""
            covered = [(m * chosen[:, :, None]).max(axis=1, initial=0).sum(axis=1) / w for m, w in zip(marks, width, strict=True)]
            near = (like * chosen[:, :, None]).max(axis=1).sum(axis=1) / n
            return RELEVANCE * np.where(chosen > 0, relevance, 0).sum(axis=1) / max(most, 1) + COVERAGE * covered[0] + REPRESENTATION * near + DIVERSITY * covered[1]

        def greedy(dense: bool) -> np.ndarray:
            chosen = np.zeros((len(rows), n))
            for _ in range(most):
                now = value(chosen)
                gain = np.full((len(rows), n), -np.inf)
                for i in range(n):
                    more = chosen.copy()
                    more[:, i] = 1.0
                    gain[:, i] = value(more) - now
                fits = (chosen == 0) & (np.where(chosen > 0, tokens, 0).sum(axis=1)[:, None] + tokens <= budget) & (gain > 1e-12)
                if not fits.any():
                    break
                by = np.where(fits, np.round(gain / cost if dense else gain, 12), -np.inf)
                # the best by gain, then relevance, then fewer tokens, then its place
                order = np.lexsort((np.broadcast_to(np.arange(n), gain.shape), cost, -relevance, -np.round(gain, 12), -by), axis=1)[:, 0]
                found = fits.any(axis=1)
                chosen[found, order[found]] = 1.0
            return chosen

        first, second = greedy(True), greedy(False)
        key = []
        for chosen in (first, second):
            places = np.sort(np.where(chosen > 0, np.arange(n), n), axis=1)  # smaller places win, and more of them
            key.append([np.round(value(chosen), 12), -np.where(chosen > 0, tokens, 0).sum(axis=1), *(-places.T)])
        better, open_ = np.zeros(len(rows), dtype=bool), np.ones(len(rows), dtype=bool)
        for a, b in zip(*key, strict=True):
            better |= open_ & (b > a)
            open_ &= a == b
        return np.where(better[:, None], second, first) > 0

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("items")
            held, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
            starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
            column = dict(zip((f.name for f in held.type), held.flatten(), strict=True))
            words = [coded(column[c]) for c in ("terms", "asked", "labels")]
            tokens, relevance = (column[c].cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("tokens", "relevance"))
            taken = np.zeros(len(held), dtype=bool)
            for n in np.unique(counts[counts > 0]):
                every = starts[counts == n]
                step = max(1, TOGETHER // int(n) ** 2)
                for at in range(0, len(every), step):
                    rows = every[at : at + step, None] + np.arange(n)
                    taken[rows] = choose(words, tokens, relevance, rows)
            query = np.repeat(np.arange(len(counts)), counts)[taken]
            position = np.arange(len(query)) - np.searchsorted(query, query) + 1
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(query)).cast(pa.int64()), column["canonical_id"].filter(pa.array(taken)).cast(pa.int64()), pa.array(position, pa.int32())], names=["query_id", "canonical_id", "position"])

    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "canonical_id"))
    first = items.withColumn("_n", nth).where(F.col("_n") <= MOST_CANDIDATES)
    rows = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_n", "canonical_id", "tokens", "relevance", "terms", "asked", "labels"))).alias("items"))
    return rows.mapInArrow(walk, "query_id long, canonical_id long, position int")
