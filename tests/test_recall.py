"""A whole recall on small tables: scopes, plans by purpose, hops, and packing beyond the limit."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import flow
from cairn.operators import recall as recall_filters

MEMORIES = "canonical_id long, text string, lookup string, terms array<string>, scope_key string, at timestamp_ntz, recallable boolean"
QUERIES = "query_id long, text string, scope_keys array<string>, target timestamp_ntz, purpose string, limit int, min_score double, tokens int"


def memory(i, words, scope="s", recallable=True):
    return (i, words, words, [words], scope, None, recallable)


def query(i, words, scopes=("s",), purpose="interactive_recall", limit=5, floor=0.0, tokens=None):
    return (i, words, list(scopes), None, purpose, limit, floor, tokens)


def recall(spark, memories, queries, edges=()):
    rows = flow.recall(spark.createDataFrame(memories, MEMORIES), spark.createDataFrame(queries, QUERIES), spark.createDataFrame(list(edges), "src long, dst long, relation string"))
    out = {}
    for r in rows.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r)
    return out


def test_scopes_hops_and_budgets(spark):
    long = "red fox " + "jumps over very many words " * 20
    memories = [memory(1, "red fox"), memory(2, "red fox", "other"), memory(3, long), memory(4, "red fox den"), memory(5, "far away"), memory(6, "further still"), memory(7, "far away", "other"), memory(8, "red fox gone", recallable=False)]
    edges = [(1, 5, "supports"), (5, 6, "supports"), (1, 7, "supports")]
    queries = [
        query(1, "red fox"),
        query(2, "red fox", ("other",)),
        query(3, "red fox", ("s", "other"), purpose="conflict_review"),
        query(4, "fox jumps over very many words", limit=1, tokens=10),  # the best hit is too long, a later one fits
        query(5, "fox", limit=1),
        query(6, "red fox", ("none",)),
        query(7, "nothing like it", floor=0.5),
    ]
    got = recall(spark, memories, queries, edges)
    ids = lambda q: {r.canonical_id for r in got.get(q, [])}
    assert ids(1) == {1, 3, 4, 5}  # one hop; not the memory of another scope, nor the one that can't be recalled
    assert ids(2) == {2}
    assert ids(3) >= {1, 2, 5, 6, 7}  # two hops, both scopes
    assert [(r.canonical_id, r["rank"] > 1, r.kept) for r in got[4] if r.kept] == [(1, True, True)] or [r.canonical_id for r in got[4] if r.kept] == [4]
    assert not got[4][0].kept and got[4][0].canonical_id == 3
    assert len(got[5]) == 1 and got[5][0].kept
    assert ids(6) == ids(7) == set()


@pytest.mark.parametrize(("raw", "term", "own"), [("  ﬁle\tStraße ", "file strasse", "file strasse"), ("ΣΊΣΥΦΟΣ", "σίσυφοσ", "σίσυφοσ"), ("Ａ①", "a1", "ａ①"), ("İx", "i̇x", "i̇x"), (None, None, None), ("", "", "")])
def test_full_case_folding(spark, raw, term, own):
    row = spark.createDataFrame([(raw,)], "t string").select(text.normalize_term(F.col("t")), text.canonical(F.col("t")), text.fold(F.col("t"))).first()
    assert list(row)[:2] == [term, own]
    assert raw is None or row[2] == raw.casefold()


def test_structured_contents_stay_apart(spark):
    row = spark.createDataFrame([('{"b": 1, "a": [true, 1.0]}',)], "t string").select(text.canonical_json(F.col("t"))).first()
    assert row[0].startswith("json:{\"a\":")


def test_intervals_and_points_share_one_stretch(spark):
    levels = 5
    spans = [(a, b) for a in range(0, 33) for b in range(a, 33)]
    rows = spark.createDataFrame(spans, "low long, high long").select("low", "high", recall_filters.nodes_of_interval(F.col("low"), F.col("high"), levels).alias("n")).collect()
    points = {r.at: {tuple(x) for x in r.n} for r in spark.range(33).select(F.col("id").alias("at"), recall_filters.nodes_of_point(F.col("id"), levels).alias("n")).collect()}
    for r in rows:
        own = [tuple(x) for x in r.n]
        assert len(own) <= 2 * levels
        for at, nodes in points.items():
            assert sum(n in nodes for n in own) == (r.low <= at < r.high), (r.low, r.high, at)
