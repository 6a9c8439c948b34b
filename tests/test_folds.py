"""Ordered work against plain Python replays: consolidation plans, evidence chains, the vector plane."""

import hashlib
import random
import re

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.operators import chains, consolidation, lanes, vectors, work
from cairn.plans import consolidations, plane


def canonical(text):
    return re.sub(r"\s+", " ", text.strip()).casefold()


def sha(text):
    return hashlib.sha256(canonical(text).encode()).hexdigest()


def replay_plans(memories, plans, observations, actions):
    """One plan after the other; returns results and memories."""
    state = {m["memory_id"]: dict(m) for m in memories}
    seen, acts = {}, {}
    for o in observations:
        seen.setdefault(o["plan_id"], []).append(o)
    for a in actions:
        acts.setdefault(a["plan_id"], []).append(a)
    results = []
    for plan in sorted(plans, key=lambda p: p["seq"]):
        own = seen.get(plan["plan_id"], [])
        fresh = bool(own) and all((m := state.get(o["memory_id"])) and m["version"] == o["version"] and sha(m["content"]) == o["digest"] and m["state"] == "confirmed" for o in own)
        done, before = [], {k: dict(v) for k, v in state.items()}
        for a in sorted(acts.get(plan["plan_id"], []), key=lambda a: a["place"]):
            operation = memory_id = None
            if fresh:
                supports = [before[s] for s in a["supports"] if s in before]
                tasks = [s["task_id"] for s in supports if s["visibility"] == "task"]
                scope = None if not supports or tasks and (len(set(tasks)) != 1 or None in tasks) else "task" if tasks else "run" if any(s["visibility"] == "run" for s in supports) else "repository"
                operation = "noop"
                if a["action"] != "noop" and scope:
                    evidence = {e for s in supports for e in s["evidence_ids"]}
                    if a["target"] is None:
                        operation, memory_id = "add", f"{plan['plan_id']}:{a['place']}"
                        state[memory_id] = {"memory_id": memory_id, "version": 1, "state": "tentative", "content": a["content"], "visibility": scope, "task_id": tasks[0] if tasks else None, "evidence_ids": sorted(evidence), "confidence": min([a["confidence"]] + [s["confidence"] for s in supports])}
                    elif a["target"] in before and canonical(before[a["target"]]["content"]) == canonical(a["content"]):
                        operation, memory_id = "merge", a["target"]
                        m = state[memory_id]
                        m |= {"version": m["version"] + 1, "evidence_ids": sorted({*m["evidence_ids"], *evidence})}
            done.append((plan["plan_id"], a["place"], a["action"], operation, memory_id))
        status = "stale_noop" if not fresh else "applied" if any(d[4] for d in done) else "noop"
        results += [(*d, status) for d in done]
    return results, state


def check_plans(tables):
    results, links, after = consolidation.apply_plans(*tables)
    rows = [[r.asDict() for r in t.collect()] for t in tables]
    want, state = replay_plans(*rows)
    got = [(r.plan_id, r.place, r.action, r.operation, r.memory_id, r.status) for r in results.collect()]
    # new ids are uuids of plan and place
    named = {(r[0], r[1]): r[4] for r in got if r[3] == "add"}
    form = lambda r: (*r[:4], f"{r[0]}:{r[1]}" if r[3] == "add" else r[4], r[5])
    assert sorted(map(form, got)) == sorted(want)
    assert len(set(named.values())) == len(named)
    back = {v: f"{k[0]}:{k[1]}" for k, v in named.items()}
    columns = ("version", "state", "content", "visibility", "task_id", "evidence_ids")
    assert {back.get(m.memory_id, m.memory_id): [m[c] for c in columns] for m in after.collect()} == {k: [m[c] for c in columns] for k, m in state.items()}
    supports = {(a["plan_id"], a["place"]): set(a["supports"]) for a in rows[3]}
    assert {(r.source_id, r.target_id) for r in links.collect()} == {(v, s) for k, v in named.items() for s in supports[k]}
    return got


def test_plans_of_the_table(spark):
    got = check_plans(consolidations.plan_tables(spark, SF))
    assert {r[5] for r in got} == {"applied", "stale_noop"} and {r[3] for r in got} >= {"add", "merge", "noop", None}


def test_random_plans_that_meet(spark):
    draw = random.Random(5)
    memories = [(f"m{k}", draw.randint(1, 2), draw.choice(["confirmed"] * 4 + ["refuted"]), draw.choice(["Straße  A", "b", "c c"]), draw.choice(["repository", "run", "task"]), draw.choice([1, 2, None]), [draw.randint(1, 5)], draw.random()) for k in range(8)]
    plans, observations, actions = [], [], []
    for p in range(16):
        own = draw.sample(memories, draw.randint(1, 3))
        plans.append((p, 1000 - p if p % 2 else p))
        observations += [(p, m[0], m[1] + draw.choice([0, 0, 0, 1, 2]), sha(m[3])) for m in own]
        actions += [(p, n, kind, draw.choice(own)[0] if kind == "supersede" else None, [m[0] for m in own], draw.choice(["STRASSE a", "B", "new"]), 0.5) for n, kind in enumerate(draw.choices(["append", "link", "noop", "supersede", "supersede"], k=draw.randint(1, 3)))]
    plans.append((99, 5))  # no observations: stale
    actions.append((99, 0, "append", None, ["m1"], "x", 0.5))
    observations.append((98, "m1", 1, "x"))  # of no plan
    tables = (
        spark.createDataFrame(memories, "memory_id string, version long, state string, content string, visibility string, task_id long, evidence_ids array<long>, confidence double"),
        spark.createDataFrame(plans, "plan_id long, seq long"),
        spark.createDataFrame(observations, "plan_id long, memory_id string, version long, digest string"),
        spark.createDataFrame(actions, "plan_id long, place int, action string, target string, supports array<string>, content string, confidence double"),
    )
    check_plans(tables)
    none = tuple(t.limit(0) for t in tables)
    assert [t.count() for t in consolidation.apply_plans(*none)] == [0, 0, 0]


def walk_chains(query, pool, with_context, share, once):
    """``pool``: (id, vector) in the order of retrieval."""
    cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if np.linalg.norm(a) and np.linalg.norm(b) else 0.0
    own = {i: cos(query, v) for i, v in pool}
    found = []
    for anchor, _ in pool[:3]:
        chain, last = [(anchor, own[anchor])], own[anchor]
        while len(chain) < len(pool):
            context = sum(np.asarray(v) / np.linalg.norm(v) for i, v in pool if i in [c for c, _ in chain])
            scored = [(own[i] * (cos(context, v) if with_context else 1), i) for i, v in pool if i not in [c for c, _ in chain]]
            best = max(scored, key=lambda s: s[0])
            if share is not None and best[0] < share * last:
                break
            last = best[0]
            chain.append((best[1], last))
        found.append(chain)
    found.sort(key=lambda c: -c[0][1])
    seen, out = set(), []
    for n, chain in enumerate(found, 1):
        for place, (i, score) in enumerate(chain, 1):
            out.append((n, place, i, score, not (once and i in seen)))
            seen.add(i)
    return out


@pytest.mark.parametrize(("with_context", "share", "once"), [(True, 0.5, True), (True, None, False), (False, 0.5, True)])
def test_chains_equal_a_plain_walk(spark, with_context, share, once):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(0.4, 1, 6).tolist()) for k in range(60)]
    queries = [(k, rng.normal(0.5, 1, 6).tolist()) for k in range(4)] + [(9, None)]
    candidates = [(q, i, r, v) for q, _ in queries for r, (i, v) in enumerate(sorted(rows, key=lambda x: (x[0] * 7 + q) % 61)[:30], 1)]
    got = chains.organize(spark.createDataFrame(candidates, "query_id long, canonical_id long, rank int, vector array<double>"), spark.createDataFrame(queries, "query_id long, vector array<double>"), share=share, with_context=with_context, once=once)
    want = []
    for q, vector in queries[:-1]:
        pool = [(i, v) for a, i, _, v in candidates if a == q][:20]
        want += [(q, *row) for row in walk_chains(vector, pool, with_context, share, once)]
    rows = sorted(tuple(r) for r in got.collect())
    assert [(*r[:4], r[5]) for r in rows] == [(*w[:4], w[5]) for w in sorted(want)]
    assert [r[4] for r in rows] == pytest.approx([w[4] for w in sorted(want)], abs=1e-6)


def test_nearest_splits_hot_keys_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(lanes, "BLOCK", 7)
    rng = np.random.default_rng(2)
    rows = [(k, "hot" if k % 3 else "b", rng.normal(0, 1, 5 if k % 11 else 4).tolist()) for k in range(80)] + [(100, "hot", None), (None, "hot", [1.0] * 5)]
    v = spark.createDataFrame(rows, "canonical_id long, scope string, vector array<double>")
    q = v.where("canonical_id % 4 = 0").withColumnRenamed("canonical_id", "query_id")
    got = {}
    for r in lanes.nearest(v, q, 6, ("scope",), self_too=True).collect():
        got.setdefault((r.query_id, r.scope), []).append((round(-r.raw_score, 9), r.canonical_id))
    for k, scope, x in rows:
        if k is not None and k % 4 == 0 and x is not None:
            unit = lambda a: np.asarray(a) / np.linalg.norm(a)
            want = sorted((round(-float(np.clip(unit(x) @ unit(y), 0, 1)), 9), i) for i, s, y in rows if i is not None and y is not None and s == scope and len(y) == len(x))[:6]
            assert sorted(got[k, scope]) == want
    dense = lanes.dense(v.select("canonical_id", "vector"), q.select("query_id", "vector"), 3)
    assert {r.rank for r in dense.collect()} == {1, 2, 3}


def test_plane_widens_for_short_queries_only(spark, monkeypatch):
    """The first vectors near the query are stale; further rounds find the valid ones."""
    fetched, plain = [], lanes.nearest
    monkeypatch.setattr(lanes, "nearest", lambda v, q, limit, *a, **kw: (fetched.append((limit, q.count())), plain(v, q, limit, *a, **kw))[1])
    n = 60
    rows = [(k, k, "s", "m", 2, 1, f"d{k}", [1.0, k / 100.0]) for k in range(n)] + [(k + n, k + n, "t", "m", 2, 1, "d", [1.0, 0.1]) for k in range(5)]
    projection = spark.createDataFrame(rows, "canonical_id long, resource_id long, scope_key string, model string, dimensions int, version long, digest string, vector array<double>")
    memories = spark.createDataFrame([(k, "s", 1, f"d{k}", k) for k in range(40, n)] + [(k + n, "t", 1, "d", k) for k in range(5)] + [(3, "other", 1, "d3", 1), (4, "s", 2, "d4", 1)], "canonical_id long, scope_key string, version long, digest string, recorded_from long")
    queries = spark.createDataFrame([(1, ["s", "s"], "m", [1.0, 0.0]), (2, ["t"], "m", [1.0, 0.0]), (3, ["s"], "m", None), (4, ["s"], "m", [1.0]), (5, ["none"], "m", [1.0, 0.0]), (6, ["s"], "other", [1.0, 0.0])], "query_id long, scope_keys array<string>, model string, vector array<double>")
    found, lane = vectors.plane(projection, memories, queries, 2, budget=3)
    assert fetched == [(12, 4), (24, 1), (48, 1)]
    assert sorted((r.query_id, r["rank"], r.canonical_id) for r in found.collect()) == [(1, 1, 40), (1, 2, 41), (1, 3, 42), (2, 1, 64), (2, 2, 63), (2, 3, 62)]
    want = {1: (False, None, 12 + 24 + 48, True), 2: (False, None, 5, True), 3: (True, "query_embedding_unavailable", 0, False), 4: (True, "vector_dimension_mismatch", 0, False), 5: (False, None, 0, False), 6: (False, None, 0, False)}
    assert {r.query_id: (r.degraded, r.reason, r.examined, r.truncated) for r in lane.collect()} == want
    # at the most that is fetched, the lane gives what it has
    found, lane = vectors.plane(projection, memories, queries, 2, budget=3, most=24)
    assert {r.query_id for r in found.collect()} == {2} and {r.query_id: r.truncated for r in lane.collect()}[1]


def test_plane_of_the_table(spark):
    status = plane.dense_status(spark, SF).where(F.col("degraded")).collect()
    assert {r.reason for r in status} <= {"query_embedding_unavailable", "vector_dimension_mismatch"}


def test_segments_join_to_the_text(spark):
    draw = random.Random(6)
    texts = [(k, "".join(draw.choices(["word ", "\n", "\n\n", "longer-word", " ", "x" * 30], k=draw.randint(0, 60)))) for k in range(80)] + [(100, None), (101, ""), (102, " " * 50), (103, "y" * 95), (104, "ab\n" * 40)]
    rows = {}
    for r in work.segments(spark.createDataFrame(texts, "k long, t string"), "k", "t", 40).orderBy("k", "segment").collect():
        rows.setdefault(r.k, []).append(r)
    for k, t in texts:
        own, t = rows[k], "(empty)" if k == 102 else t or ""
        assert [r.segment for r in own] == list(range(1, len(own) + 1)) and {r.n_segments for r in own} == {len(own)}
        assert all(len(r.part) <= 40 for r in own) and all(r.part == r.part.strip() for r in own if len(t) > 40)
        assert re.sub(r"\s", "", "".join(r.part for r in own)) == re.sub(r"\s", "", t)
        if len(t) <= 40:
            assert [r.part for r in own] == [t]
    assert [len(r.part) for r in rows[103]] == [40, 40, 15] and [len(r.part) for r in rows[104]][0] == 38


def test_sketches_merge(spark):
    draw = random.Random(1)
    words = [f"w{k:03d}" for k in range(400)] + ["the", "ab", "Straße"]
    texts = [(k % 3, k, " ".join(draw.choices(words, k=120))) for k in range(12)] + [(3, 20, None), (4, 21, "")]
    own = spark.createDataFrame(texts, "g long, k long, t string").withColumn("s", text.sketch(F.col("t"), 10))
    rows = own.collect()
    rank = lambda ws: sorted((int(hashlib.sha256(w.encode()).hexdigest()[:15], 16), w) for w in {x.casefold() for x in ws} if len(w) >= 3 and w not in text.SKETCH_STOP_WORDS)[:10]
    for r in rows:
        assert (r.s or []) == [tuple(x) for x in rank((r.t or "").split())]
    grouped = {r.g: [tuple(x) for x in r.s] for r in text.sketches(own, "g", "s", 10).collect()}
    assert grouped == {g: rank(" ".join(t for h, _, t in texts if h == g).split()) for g in (0, 1, 2)}
    pair = own.where("k = 0").select(F.col("s").alias("a")).crossJoin(own.where("k = 3").select(F.col("s").alias("b"))).select(text.merged(F.col("a"), F.col("b"), 10).alias("m")).first()
    assert [tuple(x) for x in pair.m] == rank((texts[0][2] + " " + texts[3][2]).split())
