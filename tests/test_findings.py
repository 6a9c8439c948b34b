"""Registered queries against their SQL on small tables made for the odd cases of larger ones."""

import datetime as dt
import itertools

import duckdb
import pytest
from conftest import SF

from cairn import catalog
from cairn.operators import consolidation, graph
from cairn.sources import tables

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
ITEMS = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def order(key, customer=1, status="O", day=dt.datetime(1995, 1, 1)):
    return (key, customer, status, 10.0, day, "1-URGENT")


def item(key, part=1, supplier=1, line=1, flag="N", day=dt.datetime(1995, 1, 5), quantity=1.0):
    return (key, part, supplier, line, quantity, 10.0, 0.05, 0.02, flag, "O", day)


@pytest.fixture
def agrees(spark, tmp_path):
    """Runs a query over given rows, compares it with its SQL, and returns its rows as dictionaries."""
    number = itertools.count()

    def run(name, **tables):
        where = tmp_path / str(next(number))
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(where / f"{table}.parquet"))
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{where}/{table}.parquet/*.parquet')")
        got = catalog.QUERIES[name](spark, str(where))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLES[name]})").fetchall()
        rows = got.collect()
        assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
        return [r.asDict() for r in rows]

    return run


def _command_rows():
    """Parts past a hundred thousand, and two items of an order with one part and number."""
    apart = [item(1, 100_001, 1), item(2, 1, 2)]
    twice = [item(3, 5, 7, 2, "R"), item(3, 5, 4, 2, "A"), item(3, 5, 6, 2, "N")]
    orders = [order(1), order(2), order(3, status="F")]
    return orders, apart, twice


def test_memory_reviews_keep_all_commands(agrees):
    orders, apart, twice = _command_rows()
    results = [agrees("memory_reviews", orders=(orders, ORDERS), lineitem=(apart + list(rows), ITEMS)) for rows in itertools.permutations(twice)]
    assert all(sorted(map(str, r)) == sorted(map(str, results[0])) for r in results)
    assert sorted(r["memory_id"] for r in results[0]) == [1, 2, 3] and len({r["command_id"] for r in results[0]}) == 3


def test_source_reviews_keep_all_commands(agrees):
    orders, apart, twice = _command_rows()
    results = [agrees("source_reviews", orders=(orders, ORDERS), lineitem=(apart + list(rows), ITEMS)) for rows in (twice, twice[::-1])]
    assert sorted(map(str, results[0])) == sorted(map(str, results[1])) and len(results[0]) == 3


@pytest.mark.parametrize("name", ["source_reviews", "memory_reviews", "task_endings"])
def test_commands_of_two_orders_with_one_number(agrees, name):
    """Past a hundred million parts a command can have the number of another order's; each order has its own."""
    rows = agrees(name, orders=([order(1), order(2)], ORDERS), lineitem=([item(1, 100_000_001, 1, 1), item(2, 1, 2, 1)], ITEMS))
    assert [r["command_id"] for r in rows] == [2_000_000_011] * 2


def test_task_endings_keep_all_commands(agrees):
    _, apart, _ = _command_rows()
    # a task that is claimed: of two items with one part and number the one under its own lease counts
    twice = [item(5, 5, 5, 2), item(5, 5, 4, 2, "R"), item(5, 5, 4, 2)]
    orders = [order(1), order(2), order(5)]
    results = [agrees("task_endings", orders=(orders, ORDERS), lineitem=(apart + list(rows), ITEMS)) for rows in itertools.permutations(twice)]
    assert all(sorted(map(str, r)) == sorted(map(str, results[0])) for r in results)
    assert {r["task_id"]: r["outcome"] for r in results[0]} == {1: "lease_lost", 2: "lease_lost", 5: "checkpoint"}


def test_lease_renewals_of_one_moment(agrees):
    late = [item(k, line=n, day=dt.datetime(1995, 3, 1)) for k in range(200) for n in (1, 2)]
    rows = agrees("lease_renewals", orders=([order(k) for k in range(200)], ORDERS), lineitem=(late, ITEMS))
    assert {(r["expires_at"], r["n_renewals"]) for r in rows} == {("1995-01-31 00:00:00", 0)}
    assert "ROWS UNBOUNDED" not in catalog.ORACLES["lease_renewals"]  # rows of one moment are in no order


def test_referenced_times_of_long_counts(agrees):
    rows = agrees("referenced_times", orders=([order(k, c, "F") for k, c in enumerate((1, 2, 520, 521, 99_999, 100_000, 12_345_678_901))], ORDERS))
    assert [r["reason"] for r in sorted(rows, key=lambda r: r["o_orderkey"])][3:] == ["relative_count_out_of_range"] * 4


@pytest.mark.parametrize("name", ["memory_terms", "memory_lookups", "hash_embeddings"])
def test_rows_of_a_small_file_are_dealt_first(spark, name):
    """Each row of the parts makes many: they are dealt over all tasks before that."""
    from conftest import SF

    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[max(plan.rfind("Generate"), plan.rfind("ArrowEvalPython")) :]
    assert "RepartitionByExpression [p_partkey" in below


def test_folding_looks_for_its_characters_in_other_texts_only(spark):
    """A class of more than a thousand characters costs a test of each for every character of a text."""
    import time

    from pyspark.sql import functions as F

    from cairn.functions import text

    rows = spark.range(40_000, numPartitions=1).select(F.repeat(F.concat(F.lit("plain Words "), F.col("id")), 20).alias("t")).cache()
    rows.count()

    def seconds(c):
        began = time.perf_counter()
        assert rows.agg(F.count_if(F.length(c) < 0)).first()[0] == 0
        return time.perf_counter() - began

    plain = min(seconds(F.lower("t")) for _ in range(2))
    assert min(seconds(text.fold(F.col("t"))) for _ in range(2)) < 10 * plain + 1.5


def test_lineage_of_every_order(agrees):
    day = lambda n: dt.datetime(1995, 1, 1) + dt.timedelta(days=n)
    orders = [order(k, k % 3, "OFP"[k % 7 % 3], day(k * (20 if k % 3 else 60))) for k in range(90)]
    rows = agrees("lineage_links", orders=(orders, ORDERS))
    assert {r["seed"] for r in rows} == {o[0] for o in orders if o[2] != "P"}


def test_lineage_equals_walks(spark):
    import random

    from cairn.operators import graph

    draw = random.Random(3)
    edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)] + [(200, 200), (300, 301), (301, 300)]
    nodes = [(k, k % 3 == 0) for k in (*range(0, 60), *range(100, 131), 200, 300, 301) if k != 7]
    current = dict(nodes)
    inner = {(a, b) for a, b in edges if a in current and b in current}
    want = set()
    for seed in current:
        seen, rest = {seed}, [seed]
        while rest:
            at = rest.pop()
            new = {b for a, b in inner if a == at} | {a for a, b in inner if b == at}
            rest.extend(new - seen)
            seen |= new
        want.add((seed, len(seen), sum(current[n] for n in seen), sum(a in seen for a, _ in inner)))
    made = spark.createDataFrame(nodes, "node long, current boolean")
    got = graph.lineage(spark.createDataFrame(edges, "src long, dst long"), made, made.select("node"))
    assert {tuple(r) for r in got.collect()} == want


def test_pieces_are_never_broadcast(spark):
    """A text has hundreds of pieces, so tables of them outgrow what their texts' size lets expect."""
    from conftest import SF

    found = catalog.QUERIES["forgotten"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in found


def test_wide_fences_block_the_same(spark, monkeypatch):
    """Texts meet the hashes of their scope in one row; those of a scope with very many are dealt by hash."""
    from cairn.operators import forgetting

    schema = "text_id long, scope long, text string"
    asked = spark.createDataFrame([(1, 1, "erase red kite and blue falcon 030-1234567"), (2, 2, "erase red kite")], schema)
    texts = spark.createDataFrame([(k, k % 3, t) for k, t in enumerate(["a red kite", "red kite", "Blue Falcon", "falcon blue", None, "kite red", "call 030-1234567", "", "erase it"] * 3)], schema)

    def run():
        made = forgetting.decisions(texts, forgetting.fence(asked.withColumnRenamed("text_id", "directive_id")))
        return made, sorted(map(tuple, made.collect()))

    made, narrow = run()
    atoms = [line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "arrays_overlap" in line]
    assert atoms and {r[1] for r in narrow} == {"forget", "blocked", "remember"}
    for most in (0, 3):  # all scopes, and one of them, have too many
        monkeypatch.setattr(forgetting, "FENCE", most)
        assert run()[1] == narrow


def test_groups_reach_what_their_edges_reach(spark):
    """Values of all others of a group, without a row for each pair of its members."""
    import random

    from cairn.operators import reranking

    draw = random.Random(5)
    held = spark.createDataFrame([(draw.randint(0, 40), draw.randint(0, 9)) for _ in range(70)], "entity_id long, value_id long")
    hits = spark.createDataFrame([(q, draw.randint(0, 45), r, draw.random()) for q in range(30) for r in (1, 2, 3)], "query_id long, entity_id long, rank int, raw double")
    member = [(e, e % 5, "x" if e % 3 else None) for e in range(45)]
    groups = spark.createDataFrame(member, "entity_id long, g long, h string")
    edges = [(a, b) for a, g, h in member for b, i, j in member if a < b and g == i and h and j]
    by_edges = reranking.entity_scores(held, hits, spark.createDataFrame(edges, "left long, right long"))
    by_groups = reranking.entity_scores(held, hits, groups=groups)
    assert sorted(map(str, by_edges.collect())) == sorted(map(str, by_groups.collect()))


def test_entity_expansion_makes_no_pairs_of_parts(spark):
    from conftest import SF

    plan = catalog.QUERIES["entity_expansion"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not [line for line in joins if "p_partkey" in line and " < " in line]


def test_facility_location_works_on_queries_together(spark):
    """One call of Python for each query takes longer than its choice: many queries share a batch."""
    import collections
    import random

    from cairn.operators import evaluation

    draw = random.Random(6)
    words = lambda k: draw.sample([f"t{i}" for i in range(9)], draw.randint(0, k))
    schema = "query_id long, canonical_id long, rank long, tokens long, relevance double, terms array<string>, asked array<string>, labels array<string>"
    sizes = {q: q % 9 + 1 for q in range(60)} | {60: 140}
    items = [(q, q * 1000 + i, i, draw.randint(0, 30), draw.choice([0.0, 0.5, 1.0]), words(6), words(3), words(2)) for q, n in sizes.items() for i in range(n)]

    def chosen(rows):
        out = collections.defaultdict(list)
        for r in evaluation.facility_location(spark.createDataFrame(rows, schema), 60, 4).orderBy("query_id", "position").collect():
            out[r.query_id].append(r.canonical_id)
        return out

    every = chosen(items)
    plan = evaluation.facility_location(spark.createDataFrame(items, schema), 60, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    # a query's choice is its own, whatever else is in the batch, and items beyond the first 128 change nothing
    for q in (8, 33, 60):
        assert every[q] == chosen([r for r in items if r[0] == q and r[2] < 128])[q]


def test_nearness_reaches_what_its_edges_reach(spark, monkeypatch):
    """Neighbours within a group, by lists in the queries' tasks: as by edges, which are never made."""
    import random

    from cairn.operators import reranking

    monkeypatch.setattr(reranking, "ROWS", 7)
    draw = random.Random(7)
    points = [(v, draw.choice([None, *range(0, 600, 50)]), v % 4, None if v % 7 == 0 else "x") for v in range(60)]
    points = [(v, None if p is None else float(p), g, h) for v, p, g, h in points]
    made = spark.createDataFrame(points, "value_id long, position double, g long, h string")
    direct = spark.createDataFrame([(q, draw.randint(0, 65), r) for q in range(40) for r in (1, 2, 3)], "query_id long, value_id long, rank int").groupBy("query_id", "value_id").agg({"rank": "min"}).withColumnRenamed("min(rank)", "rank")
    edges = [(a, b, round(1 - abs(p - q) / 1000, 6)) for a, p, g, h in points for b, q, i, j in points if a < b and g == i and h and j and p is not None and q is not None]
    by_edges = reranking.similarity_expansion(direct, spark.createDataFrame(edges, "left long, right long, likeness double"))
    by_lists = reranking.nearness_expansion(direct, made, 1000.0)
    columns = ["query_id", "value_id", "score", "direct_rank", "rank"]
    assert sorted(map(str, by_edges.select(columns).collect())) == sorted(map(str, by_lists.select(columns).collect()))


def test_similarity_expansion_makes_no_pairs_of_parts(spark):
    from conftest import SF

    plan = catalog.QUERIES["similarity_expansion"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not [line for line in joins if "p_partkey" in line and " < " in line]


def test_plans_do_not_wait_for_readers(spark, monkeypatch):
    n, rounds = 12, []
    keep = consolidation.written
    monkeypatch.setattr(consolidation, "written", lambda df, name: (rounds.append(name), keep(df, name))[1])
    memories = spark.createDataFrame([(f"m{k}", 1, "confirmed", "a", "repository", None, [k], 0.5) for k in range(n + 1)], "memory_id string, version long, state string, content string, visibility string, task_id long, evidence_ids array<long>, confidence double")
    plans = spark.createDataFrame([(p, p) for p in range(n)], "plan_id long, seq long")
    observed = memories.select("memory_id", "version", consolidation.digest().alias("digest"))
    pairs = spark.createDataFrame([(p, f"m{p + k}") for p in range(n) for k in (0, 1)], "plan_id long, memory_id string").join(observed, "memory_id")
    actions = spark.createDataFrame([(p, 1, "supersede", f"m{p}", [f"m{p}", f"m{p + 1}"], "A", 0.5) for p in range(n)], "plan_id long, place int, action string, target string, supports array<string>, content string, confidence double")
    results, _, after = consolidation.apply_plans(memories, plans, pairs, actions)
    # each plan reads what the next one writes: a chain of writes after reads, decided in one round
    assert rounds.count("decided") == 1
    assert {r.status for r in results.collect()} == {"applied"}
    assert {r.memory_id: r.evidence_ids for r in after.collect()} == {f"m{k}": [k, k + 1] if k < n else [k] for k in range(n + 1)}


def test_tasks_of_the_pool_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(tables, "ROWS", 100)
    pool = tables.load(spark, SF, "pool")
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert pool.rdd.getNumPartitions() == -(-n // 100)
    # what is made of it by query stays in these tasks
    assert catalog.QUERIES["turn_fusion"](spark, SF).rdd.getNumPartitions() == -(-n // 100)


def test_closure_writes_each_row_once(spark, monkeypatch):
    sizes, keep = [], graph.written

    def counted(df, name):
        out = keep(df, name)
        sizes.append(out.count() if name != "links" else 0)
        return out

    monkeypatch.setattr(graph, "written", counted)
    edges = spark.createDataFrame([(k, k + 1) for k in range(5)], "src long, dst long")
    got = graph.closure(edges, spark.createDataFrame([(0,)], "node long"))
    assert {(r.seed, r.node, r.steps) for r in got.collect()} == {(0, k, k) for k in range(6)}
    assert sum(sizes) == 6


def test_sketches_fold_and_hash_a_word_once_a_group(spark):
    from pyspark.sql import functions as F

    from cairn.functions import text

    odd = ["Straße STRASSE straße", "ʼn ŉ ẖ ΐ", "aͅb cͅ ͅd", "İstanbul ΟΔΥΣΣΕΥΣ ὈΔΥΣΣΕΎΣ οδυσσευσ", "ﬁne ﬂow Ⓐbc ⅳx x_y étude étude", "", "...", "the and 12 ab abc", None]
    rows = spark.createDataFrame([(k % 2, t) for k, t in enumerate(odd)], "source int, text string")
    whole = text.sketches(rows.select("source", text.sketch(F.col("text")).alias("sketch")), "source", "sketch")
    parts = text.sketches(text.words(rows, "source", "text").select("source", text.sketch(F.col("text")).alias("sketch")), "source", "sketch")
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    # words are folded and hashed in what the step that makes them distinct gives, or above it, and no array is made twice
    plan = catalog.QUERIES["source_sketches"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    hashed = [k for k, line in enumerate(plan) if "sha2(" in line]
    distinct = [k for k, line in enumerate(plan) if "Aggregate [source" in line and "text" in line]
    assert len(hashed) == 1 and hashed[0] <= min(distinct)


def test_terms_and_texts_that_repeat_are_worked_on_once(spark, monkeypatch):
    """A normalised term takes its first ids alone, and the lexical budget counts ids, not texts."""
    from cairn.operators import lanes

    scored, keep = [], lanes.ranked
    monkeypatch.setattr(lanes, "ranked", lambda rows, budget: (scored.append(rows), keep(rows, budget))[1])
    terms = [(k, t) for k in range(40) for t in (f"Ab  c{k % 2}", "AB C1", "other")] + [(50, None), (3, "ab c1")]
    asked = spark.createDataFrame([(1, "ab c1"), (2, "ａＢ  c0"), (3, "none"), (4, None)], "query_id int, text string")
    got = lanes.exact(spark.createDataFrame(terms, "canonical_id long, term string"), asked, 5).collect()
    assert sorted((r.query_id, r.canonical_id, r.rank) for r in got) == [(1, k, k + 1) for k in range(5)] + [(2, 2 * k, k + 1) for k in range(5)]
    assert scored[0].count() < 40  # of 60 rows that match

    texts = ["red bolt", "red rod", "old rod", "red bolt old"]
    docs = [(k, texts[k % 4]) for k in range(80)]
    queries = spark.createDataFrame([(1, "red bolt"), (2, "rod")], "query_id int, text string")
    got = lanes.lexical(spark.createDataFrame(docs, "canonical_id long, text string"), queries, 10)
    share = lambda q, t: round(len(set(q.split()) & set(t.split())) / len(q.split()) + (0.2 if q in t else 0), 6)
    for q, words in ((1, "red bolt"), (2, "rod")):
        want = sorted((-share(words, t), k) for k, t in docs if share(words, t))[:10]
        assert [(-r.raw_score, r.canonical_id) for r in got.where(f"query_id = {q}").orderBy("rank").collect()] == want
    # 10 ids of each of the texts that can still be among the first 10: two for the first query, two for the other
    assert scored[1].count() == 40


def test_lanes_make_arrays_of_distinct_texts_only(spark):
    """No filter on what a lane makes of a text goes down to every document, and few queries are dealt over all tasks."""
    from cairn.operators import lanes

    docs = spark.createDataFrame([(k, "red bolt", k % 2) for k in range(9)], "canonical_id long, text string, scope_key int")
    asked = spark.createDataFrame([(1, "red bolt", 0)], "query_id int, text string, scope_key int")
    own = docs._jdf.queryExecution().analyzed().output().apply(1).toString()
    for lane in (lanes.lexical, lanes.fuzzy):
        plan = lane(docs, asked, keys=("scope_key",))._jdf.queryExecution().optimizedPlan().toString().split("\n")
        assert not [line for line in plan if "Filter" in line and "regexp_extract_all" in line and own in line]
    times = docs.selectExpr("canonical_id", "scope_key AS scope", "timestamp'2020-01-01' AS at")
    plan = lanes.temporal(times, asked.selectExpr("query_id", "scope_key AS scope", "timestamp'2020-01-02' AS target"))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [query_id" in plan


def test_answers_of_all_budgets_read_the_pool_once(spark):
    from cairn.operators import evaluation, fusion

    rows = [(q, 10 * q + k, k + 1, None if k == 3 else (7 * k + q) % 23, None if k == 5 else (k + q) % 4 == 0) for q in range(12) for k in range(q % 7 + 1)]
    items = spark.createDataFrame(rows, "query_id long, canonical_id long, rank int, tokens long, relevant boolean")
    bounds = [(20, None), (None, None), (30, 2), (None, 3)]
    got = {(r.budget, r.max_items): r[2:] for r in evaluation.answers_by_budget(items, bounds).collect()}
    for bound in bounds:
        one = evaluation.answer_in_context(fusion.pack(items, *bound), items.where("relevant"), items.select("query_id").distinct()).first()
        assert got[bound] == tuple(one)
    plan = catalog.QUERIES["answers_in_context"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_edges_of_proposals_are_never_broadcast(spark, monkeypatch):
    plans, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (plans.append(df), keep(df, name))[1])
    plans.append(catalog.QUERIES["dependency_adds"](spark, SF))
    assert len(plans) == 9
    assert not [p for p in plans if "Broadcast" in p._jdf.queryExecution().executedPlan().toString()]


def test_what_a_vector_task_holds_does_not_grow(spark, monkeypatch):
    """Scores are made in steps, queries that fetch many meet in smaller blocks, and a vector is not repeated in Python for each of its cells."""
    import numpy as np
    from pyspark.sql import functions as F

    from cairn.operators import ann, lanes

    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(k, k % 2, draw.normal(size=4).tolist()) for k in range(60)], "canonical_id long, g int, vector array<double>")
    asked = rows.withColumnRenamed("canonical_id", "query_id")
    neat = lambda found: sorted((r.query_id, r.canonical_id, round(r.raw_score, 9)) for r in found.collect())
    whole = neat(lanes.nearest(rows, asked, 3, ("g",)))
    monkeypatch.setattr(lanes, "FOUND", 12)
    monkeypatch.setattr(lanes, "SCORES", 64)
    small = lanes.nearest(rows, asked, 3, ("g",))
    assert neat(small) == whole
    plan = small._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 4.0" in plan or "/ 4)" in plan or "cast(4 as" in plan
    placed = ann._placed(rows.select("canonical_id", "vector"), np.eye(4), 3)
    assert "Generate explode(cells" in placed._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.n, r.vectors) for r in placed.groupBy("id").agg(F.count_distinct("cell").alias("n"), F.collect_set("vector").alias("vectors")).collect()}
    assert got == {r.canonical_id: (3, [r.vector]) for r in rows.collect()}


@pytest.fixture
def llm_plans(monkeypatch):
    """The name and frame of each table that the near-duplicates write."""
    from cairn.llm import components, op3_simhash, textkit

    plans, keep = [], textkit.written
    for module in (components, op3_simhash, textkit):
        monkeypatch.setattr(module, "written", lambda df, name: (plans.append((name, df)), keep(df, name))[1])
    return plans


def test_near_links_are_never_broadcast(spark, llm_plans):
    """Anchors are many a fingerprint, which their table's size does not tell."""
    from cairn.llm import op3_simhash

    docs = spark.createDataFrame([(k, f"one two three four five {k // 2}") for k in range(20)], "doc_id long, text string")
    llm_plans.append(("out", op3_simhash.near_duplicates(docs)))
    assert {"links", "least", "linked", "of", "out"} <= {name for name, _ in llm_plans}
    assert not [name for name, df in llm_plans if "Broadcast" in df._jdf.queryExecution().executedPlan().toString()]
    assert llm_plans[-1][1].select("component_id").distinct().count() == 10


def test_components_kept_by_the_pipeline_are_never_broadcast(spark, llm_plans):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"one two three four five {k // 2}") for k in range(20)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert "kept" in [name for name, _ in llm_plans]
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 10


def test_memories_meet_their_directives_in_one_row(spark, monkeypatch):
    """Texts are cut to pieces in scopes with very many atoms only; what is found is the same."""
    from cairn.operators import forgetting

    schema = "directive_id long, scope long, text string"
    asked = spark.createDataFrame([(1, 1, 'erase "red kite", blue falcon 030-1234567'), (2, 2, "erase red kite"), (3, 2, "forget the blue falcon"), (4, 2, None)], schema)
    texts = [(k, k % 3, t) for k, t in enumerate(["a red kite", "red kite", "Blue Falcon", "falcon blue", None, "kite red", "call 030-1234567 blue red kite", "", "tired kites"] * 3)]
    memories = spark.createDataFrame(texts, "memory_id long, scope long, text string")

    def run():
        return sorted(map(tuple, forgetting.targets(asked, memories).collect()))

    listed = run()
    assert {r[0] for r in listed} == {1, 2, 3}
    for most in (0, 15):  # all scopes, and one of them, have too many
        monkeypatch.setattr(forgetting, "LISTED", most)
        assert run() == listed
    monkeypatch.undo()
    plan = catalog.QUERIES["forgotten"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert [line for line in plan if "Contains(" in line and "array_intersect" in line] and not [line for line in plan if "substring(" in line]
    # words of one memory that stands twice count once, its atoms twice, as in the SQL
    twice = spark.createDataFrame([(1, 1, "blue falcon red kite"), (1, 1, "blue falcon red kite")], "memory_id long, scope long, text string")
    assert [r.score % 120 for r in forgetting.targets(asked.where("directive_id = 1"), twice).collect()] == [4]


def test_groups_of_points_are_never_broadcast(spark):
    """Of 300 groups there are 300 rows, but each holds all its parts."""
    found = catalog.QUERIES["similarity_expansion"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in found and "Broadcast" not in found
