"""Operators on small hand-written tables, against plain Python."""

import collections
import random
import uuid
from datetime import datetime, timedelta

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from cairn.functions import identity, rendering, text
from cairn.operators import ann, evaluation, extraction, fusion, graph, lanes, planning, recall, reports, resampling, upkeep, work
from cairn.sources.tables import load
from cairn.streaming import counters


def test_greedy_packing_skips_what_does_not_fit(spark):
    rng = random.Random(3)
    rows = [(q, q * 100 + i, i, rng.randint(1, 60)) for q in range(20) for i in range(15)]
    got = {r[0]: (r[1], r[3]) for r in fusion.pack_greedy(spark.createDataFrame(rows, "query_id long, canonical_id long, rank int, tokens long"), 100).collect()}
    for q in range(20):
        used, kept = 0, []
        for _, c, _, t in sorted((r for r in rows if r[0] == q), key=lambda r: r[2]):
            if used + t <= 100:
                used += t
                kept.append(str(c))
        assert got[q] == (used, ",".join(kept))


def test_half_open_intervals_and_missing_evidence(spark):
    m = spark.sql("""SELECT * FROM VALUES (1, 1, 0, 'repository', 0, 'confirmed', 'k', TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-02-01', TIMESTAMP_NTZ '2024-01-01', CAST(NULL AS TIMESTAMP_NTZ)),
      (2, 1, 0, 'run', 0, 'tentative', 'k', TIMESTAMP_NTZ '2024-01-01', NULL, TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-02-01'),
      (3, 1, 0, 'repository', 0, 'refuted', 'k', TIMESTAMP_NTZ '2024-01-01', NULL, TIMESTAMP_NTZ '2024-01-01', NULL),
      (4, 1, 0, 'repository', 0, 'confirmed', 'k', TIMESTAMP_NTZ '2024-01-01', NULL, TIMESTAMP_NTZ '2024-01-01', NULL)
      AS t(memory_id, repository, run_id, visibility, task_id, state, kind, valid_from, valid_to, recorded_from, recorded_to)""")
    e = spark.createDataFrame([(4, 1, True, "trusted")], "memory_id long, evidence_id long, rejected boolean, trust string")
    q = lambda at: spark.sql(f"SELECT 9 AS query_id, 1 AS repository, 0 AS run_id, 0 AS task_id, TIMESTAMP_NTZ '{at}' AS known_at, TIMESTAMP_NTZ '{at}' AS world_at, false AS include_refuted")
    see = lambda at: sorted(r.memory_id for r in recall.recallable(m, e, q(at)).collect())
    assert see("2024-01-01") == [1, 2]
    assert see("2024-02-01") == []
    assert see("2023-12-31") == []


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (5,)], "node long")
    assert sorted(map(tuple, graph.closure(edges, seeds).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (5, 5, 0), (5, 6, 1)]
    assert sorted(r[0] for r in graph.on_cycles(edges).collect()) == [1, 2, 3]


def test_dense_lane_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(300, [0.0] * 8)]
    v = spark.createDataFrame(rows, "canonical_id long, vector array<double>").repartition(5)
    q = v.where("canonical_id % 20 = 0").withColumnRenamed("canonical_id", "query_id")
    got = {(r.query_id, r["rank"]): r.canonical_id for r in lanes.dense(v, q, 5).collect()}
    x = np.array([r[1] for r in rows])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    for i in range(0, 300, 20):
        s = np.clip(x @ x[i], 0, 1)
        order = [j for j in np.lexsort((np.arange(301), -s)) if j != i]
        assert [got[i, k + 1] for k in range(5)] == order[:5]


def test_missing_prerequisite_blocks(spark):
    tasks = spark.createDataFrame([(1, 1, "done", "a", 1), (2, 1, "open", "a", 1), (3, 1, "open", "a", 1), (4, 1, "open", "a", 1)], "task_id long, scope long, status string, priority string, available_at long")
    needs = spark.createDataFrame([(2, 1), (3, 99)], "task_id long, needs long")
    assert sorted(r.task_id for r in work.claimable(tasks, needs, 5).collect()) == [2, 4]


def test_text_functions(spark):
    row = spark.createDataFrame([("  Ab  cD ",)], "t string").select(text.normalize_term(F.col("t")), text.trigrams(F.lit("ab")), text.token_estimate(F.lit("")), text.tokens(F.lit("A b a"))).first()
    assert list(row) == ["ab cd", ["  a", " ab", "ab "], 1, ["a", "b"]]


def test_facility_location_equals_brute_force(spark):
    """The greedy choices written out with sets, over random items; a set chosen by value or by value per token."""
    rng = random.Random(4)
    words = [f"t{i}" for i in range(12)]
    draw = lambda k: rng.sample(words, rng.randint(0, k))
    items = [(q, i, i, rng.randint(0, 30), rng.choice([0.0, 0.3, 0.5, 1.0]), draw(6), draw(3), draw(2)) for q in range(12) for i in range(7)]
    frame = spark.createDataFrame(items, "query_id long, canonical_id long, rank long, tokens long, relevance double, terms array<string>, asked array<string>, labels array<string>")
    got = collections.defaultdict(list)
    for r in evaluation.facility_location(frame, 60, 4).orderBy("query_id", "position").collect():
        got[r.query_id].append(r.canonical_id)
    for q in range(12):
        own = [x for x in items if x[0] == q]
        every = [set().union(*(set(x[c]) for x in own)) for c in (6, 7)]

        def like(a, b):
            return float(a is b) if not a[5] or not b[5] else len(set(a[5]) & set(b[5])) / len(set(a[5]) | set(b[5]))

        def value(chosen):
            if not chosen:
                return 0.0
            parts = [len(set().union(*(set(x[c]) for x in chosen))) / max(len(e), 1) for c, e in zip((6, 7), every, strict=True)]
            return 0.35 * sum(x[4] for x in chosen) / 4 + 0.30 * parts[0] + 0.25 * sum(max(like(x, y) for x in chosen) for y in own) / len(own) + 0.10 * parts[1]

        def greedy(dense):
            chosen = []
            while len(chosen) < 4:
                fits = [x for x in own if x not in chosen and sum(y[3] for y in chosen) + x[3] <= 60 and value([*chosen, x]) - value(chosen) > 1e-12]
                if not fits:
                    break
                gain = lambda x: value([*chosen, x]) - value(chosen)  # noqa: B023, E731
                chosen.append(max(fits, key=lambda x: (round(gain(x) / max(1, x[3]) if dense else gain(x), 12), round(gain(x), 12), x[4], -max(1, x[3]), -x[2])))  # noqa: B023
            return chosen

        best = max((greedy(True), greedy(False)), key=lambda c: (round(value(c), 12), -sum(x[3] for x in c), tuple(-i for i in sorted(x[2] for x in c))))
        assert got[q] == sorted(x[1] for x in best)


def test_nodes_between_two_cycles_are_on_none(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1)], "src long, dst long")
    assert sorted(r[0] for r in graph.on_cycles(edges).collect()) == [1, 2, 4, 5, 6]


def test_spread_along_symmetric_and_directed_relations(spark):
    edges = spark.createDataFrame([(2, 1, "related_to"), (3, 1, "supports"), (1, 4, "supports"), (4, 5, "supersedes"), (1, 6, "made_up")], "src long, dst long, relation string")
    seeds = spark.createDataFrame([(9, 1, 1.0)], "query_id long, node long, activation double")
    got = {r.node: (r.activation, r.depth, r.path) for r in graph.spread(seeds, edges, 2, 8).collect()}
    assert got == {1: (1.0, 0, "1"), 2: (0.6375, 1, "1>2"), 3: (0.8075, 1, "1>3"), 4: (0.85, 1, "1>4"), 5: (round(0.85 * 0.85 * 0.98, 6), 2, "1>4>5")}
    nodes = spark.createDataFrame([(2, "b"), (3, "x")], "node long, text string")
    for asked, gate in (("a b", {3: 0.6, 4: 0.6}), ("x b", {3: 0.8, 4: 0.6}), ("?!", {3: 1.0, 4: 1.0}), (None, {3: 1.0, 4: 1.0})):
        queries = spark.createDataFrame([(9, asked)], "query_id long, text string")
        got = {r.node: r.activation for r in graph.spread(seeds, edges, 1, 2, lambda pairs, q=queries: graph.overlaps(pairs, q, nodes)).collect()}
        assert got == {1: 1.0, 3: round(0.8075 * gate[3], 6), 4: round(0.85 * gate[4], 6)}  # two neighbours at most, by weight


def test_ranking_metrics_without_results(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 10, 3), (3, 30, 1)], "query_id long, canonical_id long, rank int")
    judged = spark.createDataFrame([(1, 11), (1, 12), (2, 20)], "query_id long, canonical_id long")
    rows = {r.query_id: r for r in evaluation.ranking_metrics(ranked, judged, 10).collect()}
    assert (rows[1].recall, rows[1].precision, rows[1].mrr) == (0.5, 0.5, 0.5)
    assert (rows[2].recall, rows[2].precision, rows[2].mrr, rows[2].ndcg) == (0.0, None, 0.0, 0.0)
    cases = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    row = evaluation.lane_metrics(ranked.withColumn("lane", F.lit("x")), judged, cases, 10, ["x", "y"]).where("lane = 'x'").first()
    assert (row.cases, row.answerable, row.precision, row.recall, row.no_answer_precision, row.no_answer_recall) == (4, 2, 0.5, 0.25, 0.5, 0.5)


def test_order_statistics_equal_sorting(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, *range(50)])) for g in "aab" for _ in range(500)] + [("c", 7)]
    frame = spark.createDataFrame(rows, "g string, v long").repartition(7)
    for way, place in (("index", lambda q, n: min(n - 1, int(q * n))), ("nearest", lambda q, n: round(q * (n - 1)))):
        for r in reports.percentiles(frame, "g", "v", {"p": 0.37, "q": 0.5}, way).collect():
            own = sorted(v for g, v in rows if g == r.g and v is not None)
            assert (r.n, r.p, r.q) == (len(own), own[place(0.37, len(own))], own[place(0.5, len(own))])
    for r in reports.percentiles(frame, "g", "v", {"p": 0.37}).collect():
        assert abs(r.p - np.percentile([v for g, v in rows if g == r.g and v is not None], 37)) < 1e-9


def test_identities_equal_the_standard_library(spark):
    names = ["", "a", "Größe", "x" * 200]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(identity.uuid5(str(uuid.NAMESPACE_DNS), F.col("n")), identity.byte_prefix(F.col("n"), 3)).collect()
    assert [tuple(r) for r in got] == [(str(uuid.uuid5(uuid.NAMESPACE_DNS, n)), n.encode()[:3].decode(errors="ignore")) for n in names]


def test_plans_of_every_purpose(spark):
    rows = spark.createDataFrame([(0, "12345678-1234-5678-1234-567812345678", "planning", 10, True, False), (1, "src/Foo.py", "conflict_review", 200, False, True), (2, "plain words", "task_bootstrap", 1, True, True)], "query_id long, text string, purpose string, limit int, timed boolean, targeted boolean")
    got = {r.query_id: r for r in planning.plans(rows).collect()}
    assert [got[i].intent for i in range(3)] == ["identifier", "code_lookup", "historical"]
    assert (got[0].dense_weight, got[0].graph_weight, got[0].temporal_weight, got[0].exact_budget, got[0].token_budget) == (1.0, 1.25, None, 40, 4096)
    assert (got[1].graph_weight, got[1].lexical_budget, got[1].dense_budget, got[1].seed_limit, got[1].edge_budget) == (1.25, 1600, 100, 16, 800)
    assert (got[2].graph_weight, got[2].exact_weight, got[2].temporal_budget, got[2].seed_limit, got[2].diversify) == (1.5, 6.0, 16, 4, True)


def test_stream_counts_equal_batch(spark, tmp_path):
    events = load(spark, SF, "events")
    events.union(events.limit(50)).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = counters.windowed_counts(counters.read_log(spark, str(tmp_path / "in"), events.schema), lateness="40 days")
    counters.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    for _ in range(2):  # nothing new: the sink stays as it is
        counters.drain(counters.windowed_counts(counters.read_log(spark, str(tmp_path / "in"), events.schema), lateness="40 days"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.schema("day timestamp, event_type string, n long, total double").parquet(str(tmp_path / "out"))
    batch = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"), "event_type").count()
    closed = got.join(batch, ["day", "event_type"])
    assert closed.count() == got.count()
    assert closed.where("n != count").isEmpty()


def test_leases_end_at_their_expiry(spark):
    leases = spark.createDataFrame([(1, 7, True, 10), (2, 7, False, 10), (3, 8, True, 30), (4, 8, True, 10)], "task_id long, owner long, active boolean, expires_at long")
    writes = spark.createDataFrame([(1, 7, 9), (1, 7, 10), (1, 8, 5), (2, 7, 5), (1, None, 5), (9, 7, 5)], "task_id long, writer long, at long")
    assert [tuple(r) for r in work.owned(leases, writes).collect()] == [(1, 7, 9)]
    marks = spark.createDataFrame([(1, 3), (1, 4), (2, 3), (3, 3), (4, 10)], "task_id long, at long")
    assert [r.task_id for r in work.crash_handoffs(leases, marks, F.lit(10)).collect()] == [1]


def test_rejected_sources_refute_revive_and_bump(spark):
    columns = "memory_id long, state string, previous_state string, supersedes long, superseded_by long, recorded_to long, version long"
    memories = spark.createDataFrame([(1, "superseded", "confirmed", None, 2, 5, 1), (2, "confirmed", None, 1, None, None, 2), (3, "tentative", None, None, None, None, 1), (4, "superseded", None, None, 9, 5, 1), (5, "confirmed", None, 4, None, None, 2), (6, "confirmed", None, None, None, None, 1)], columns)
    evidence = spark.createDataFrame([(1, 7, "trusted", False), (2, 7, "trusted", False), (2, 8, "untrusted", False), (3, 7, "trusted", False), (3, 8, None, None), (5, 7, "trusted", False), (5, 9, "trusted", True), (6, 8, "trusted", False), (6, None, "trusted", False)], "memory_id long, source_id long, trust string, rejected boolean")
    gone = spark.createDataFrame([(7,), (7,), (None,)], "source_id long")
    got = sorted(tuple(r) for r in upkeep.reject_sources(memories, evidence, gone).collect())
    assert got == [(1, "revived", "confirmed", None, 2), (2, "refuted", "refuted", None, 3), (3, "bumped", "tentative", None, 2), (5, "refuted", "refuted", None, 3)]
    assert upkeep.reject_sources(memories, evidence, gone.where("false")).isEmpty()


def test_renewals_equal_a_replay(spark):
    rng = random.Random(5)
    start, claims = datetime(2024, 1, 1), {t: rng.randint(0, 50) for t in range(30)}
    moments = [(t, rng.randint(0, 300)) for t in range(35) for _ in range(rng.randint(0, 25))] + [(3, claims[3] + 60), (4, None)]
    at = lambda s: None if s is None else start + timedelta(seconds=s)
    frame = lambda rows: spark.createDataFrame([(t, at(s)) for t, s in rows], "task_id long, at timestamp_ntz")
    got = {r.task_id: (r.expires_at, r.n_renewals) for r in upkeep.renewed(frame(claims.items()), frame(moments), 60).collect()}
    want = {}
    for t, s in claims.items():
        end, n = s + 60, 0
        for m in sorted(m for u, m in moments if u == t and m is not None and m >= s):
            if m >= end:
                break
            end, n = m + 60, n + 1
        want[t] = (at(end), n)
    assert got == want


def test_bootstrap_covers_the_mean_and_repeats(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([("a", c, rng.gauss(3, 1)) for c in range(400)] + [("b", 1, 2.0), ("b", 1, 4.0), ("b", 2, None)], "s string, c long, v double")
    first, second = (sorted(map(tuple, resampling.bootstrap(rows.repartition(n), "s", "c", "v").collect())) for n in (1, 5))
    assert first == second
    (_, n, mean, low, high, bound), b = first
    assert n == 400 and low < bound < mean < high and abs(mean - 3) < 0.2
    assert 0.15 < high - low < 0.25  # about 2 * 1.96 / sqrt(400)
    assert b == ("b", 1, 3.0, 3.0, 3.0, 3.0)


def test_approximate_lane_finds_nine_in_ten(spark, monkeypatch):
    monkeypatch.setattr(lanes, "BLOCK", 16)  # many blocks a cell
    for sf in (SF, SF.replace("0.001", "0.1")):
        v = load(spark, sf, "embeddings").select(F.col("vec_id").alias("canonical_id"), F.col("embedding").alias("vector"))
        v = v.unionByName(spark.createDataFrame([(None, [1.0] * 64), (10**9, None), (10**9 + 1, [0.0] * 64)], "canonical_id long, vector array<float>"))
        q = v.where("canonical_id % 20 = 0").withColumnRenamed("canonical_id", "query_id")
        found = ann.recall(ann.approximate(v, q, 10), lanes.dense(v.dropna(), q.dropna(), 10))
        assert found.agg(F.sum("n_found") / F.sum("n_exact")).first()[0] >= 0.9
    assert ann.approximate(v.where("false"), q, 10).isEmpty()
    assert ann.approximate(v, q.where("false"), 10).isEmpty()


def test_memory_blocks_leave_out_what_is_empty(spark):
    row = spark.sql("SELECT 7 AS memory_id, 'fact' AS kind, 'confirmed' AS state, 'run' AS visibility, 0.5D AS confidence, TIMESTAMP '2024-01-02 03:04:05' AS valid_from, TIMESTAMP '2024-01-02 03:04:05.000120' AS recorded_from, CAST(NULL AS TIMESTAMP) AS valid_to, 'a\"b' AS title, CAST(array() AS array<string>) AS tags, '{}' AS metadata, '{\"b\": 1, \"a\": [2]}' AS content, array('{}', '[]') AS evidence")
    got = row.select(rendering.memory_block({c: F.col(c) for c in row.columns})).first()[0]
    assert got.split("\n") == ["[memory:7]", "kind=fact state=confirmed visibility=run confidence=0.5000", "valid_from=2024-01-02T03:04:05+00:00", "recorded_from=2024-01-02T03:04:05.000120+00:00", 'title="a\\"b"', 'content={"a":[2],"b":1}', "evidence={}", "evidence=[]"]


def test_windows_need_all_recallable_and_two_that_fit(spark):
    cases = {1: [(True, True, 3), (True, True, 3)], 2: [(True, True, 3), (False, True, 3)], 3: [(True, True, 3), (True, False, 3)], 4: [(True, True, 3), (True, True, 90), (True, True, 4)], 5: [(True, True, 3)] * 3 + [(False, True, 3)]}
    rows = [(b, p, 10 * b + p, r, e, "x" * n) for b, items in cases.items() for p, (r, e, n) in enumerate(items, 1)]
    frame = spark.createDataFrame(rows, "batch_id int, place int, memory_id int, recallable boolean, eligible boolean, body string")
    observe = lambda key, x: F.concat(key, F.lit(":"), x["body"])
    got = {r.batch_id: (r.memory_ids, r.input_bytes) for r in extraction.consolidation_windows(frame, observe, 3, 60).collect()}
    assert got == {1: ("11,12", 15), 4: ("41,43", 16), 5: ("51,52,53", 22)}
    assert extraction.consolidation_windows(frame.where("false"), observe, 3, 60).count() == 0


def test_rates_need_every_kind_and_every_verdict(spark):
    flags = "true AS judged, true AS success, false AS refused, true AS rule_failed, false AS judge_failed"
    cases = spark.sql(f"SELECT a AS run, kind, {flags} FROM VALUES (1), (2) AS t(a), VALUES ('utility'), ('privacy'), ('safety') AS k(kind) WHERE a = 1 OR kind <> 'safety'")
    unjudged = spark.sql(f"SELECT 3 AS run, kind, {flags} FROM VALUES ('utility'), ('privacy'), ('safety') AS k(kind)").withColumn("judged", F.when(F.col("kind") != "safety", True))
    got = {r.run: r for r in reports.gated_rates(cases.union(unjudged), "run").collect()}
    assert got[1].complete and (got[1].utility_accuracy, got[1].privacy_e2e_leakage_rate, got[1].deletion_leakage_rate, got[1].over_refusal_rate) == (1, 1, 0, 0)
    assert not got[2].complete and not got[3].complete and got[3].utility_accuracy is None
