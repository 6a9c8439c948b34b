"""Life cycles against plain replays of random command lists, as batches and as a live stream."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import graph, lifecycle
from cairn.streaming import coordination, counters

START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def test_claims_equal_agents_served_in_turn(spark):
    draw = random.Random(1)
    tasks, agents, needs = [], [], []
    for run in range(12):
        tasks += [(run * 100 + k, run, draw.choice(["pending", "ready", "ready", "completed", "claimed"]), draw.randint(1, 3), draw.choice([None, at(5), at(500)]), at(draw.randint(0, 9)), draw.sample(["x", "y", "z"], draw.randint(0, 3))) for k in range(draw.randint(0, 14))]
        agents += [(run * 100 + k, run, draw.choice([[], ["x"], ["y"], ["y", "x"], ["none"]])) for k in range(draw.randint(1, 8))]
        own = [t[0] for t in tasks if t[1] == run]
        needs += [(draw.choice(own), draw.choice([*own, 9999])) for _ in range(len(own) // 3)]
    now = at(100)
    got = lifecycle.claim(
        spark.createDataFrame(tasks, "task_id long, run_id long, state string, priority int, available_at timestamp_ntz, created_at timestamp_ntz, tags array<string>"),
        spark.createDataFrame(needs, "task_id long, needs long"),
        spark.createDataFrame(agents, "agent_id long, run_id long, tags array<string>"),
        F.lit(now).cast("timestamp_ntz"),
    )
    done, taken, want = {(t[0], t[1]) for t in tasks if t[2] == "completed"}, set(), {}
    for agent, run, tags in sorted(agents):
        fits = [t for t in tasks if t[1] == run and t[2] in ("pending", "ready") and (t[4] is None or t[4] <= now) and set(tags) <= set(t[6]) and t[0] not in taken and all((n, run) in done for k, n in needs if k == t[0])]
        best = min(fits, key=lambda t: (-t[3], t[4] or t[5], t[5], t[0]), default=None)
        want[agent] = (best and best[0], "claimed" if best else "no_task_available")
        taken.add(best and best[0])
    assert {r.agent_id: (r.task_id, r.outcome) for r in got.collect()} == want


@pytest.mark.parametrize("terminal", [None, "refuted"])
def test_reviews_chain_their_versions(spark, terminal):
    draw = random.Random(2)
    rows = [(k, draw.choice(["tentative", "confirmed", "refuted"]), draw.randint(1, 2)) for k in range(20)]
    commands = [(c, draw.randint(0, 21), draw.randint(1, 5), draw.choice(["confirmed", "refuted"])) for c in draw.sample(range(1000), 300)]
    got = lifecycle.review(spark.createDataFrame(commands, "command_id long, k long, expected_version int, decision string"), spark.createDataFrame(rows, "k long, state string, version int"), "k", terminal)
    now, want = {k: (s, v) for k, s, v in rows}, set()
    for c, k, expected, decision in sorted(commands):
        state, version = now.get(k, (None, None))
        outcome = "not_found" if k not in now else "terminal" if terminal and state == terminal else "version_changed" if version != expected else "reviewed"
        if outcome == "reviewed":
            state, version = now[k] = (decision, version + 1)
        want.add((c, k, outcome, state, version))
    assert {tuple(r) for r in got.collect()} == want
    assert {"reviewed", "version_changed", "not_found"} <= {w[2] for w in want}


@pytest.mark.parametrize("rounds", [0, 3])
def test_needs_are_added_in_their_order(spark, rounds):
    draw = random.Random(3)
    edges = [(s, *sorted(draw.sample(range(12), 2))) for s in (1, 2) for _ in range(5)] + [(None, 1, 2)]
    proposed = [(p, draw.choice([1, 2, 3, None]), draw.randint(0, 11), draw.randint(0, 11)) for p in range(160)] + [(200, 5, 1, 2), (201, 5, 2, 1)]
    got = graph.addable(spark.createDataFrame(edges, "scope long, src long, dst long").where("scope IS NOT NULL"), spark.createDataFrame(proposed, "proposal_id long, scope long, src long, dst long").where("scope IS NOT NULL"), rounds)
    there = {(s, a, b) for s, a, b in edges if s is not None}
    want = {}
    for p, s, a, b in proposed:
        if s is None:
            continue
        seen, rest = set(), [b]
        while rest:
            n = rest.pop()
            if n not in seen:
                seen.add(n)
                rest += [y for z, x, y in there if z == s and x == n]
        want[p] = "self" if a == b else "exists" if (s, a, b) in there else "cycle" if a in seen else "added"
        if want[p] == "added":
            there.add((s, a, b))
    rows = got.collect()
    assert {r.proposal_id: r.verdict for r in rows} == want and len(rows) == len(want)
    assert (want[200], want[201]) == ("added", "cycle")


def test_conflicts_and_additions_on_probes(spark):
    reports = spark.createDataFrame([(1, 2, 10), (2, 1, 12), (3, 4, 10)], "left long, right long, at long")
    closed = spark.createDataFrame([(2, 1, 1, 5), (1, 2, 2, 20), (1, 2, 1, 30), (3, 4, 9, 20), (3, 4, 3, 9)], "left long, right long, winner long, at long")
    assert sorted(tuple(r) for r in lifecycle.conflicts(reports, closed).collect()) == [(1, 2, 2, "resolved", 2), (3, 4, 1, "open", None)]
    rows = spark.createDataFrame([(1, 7, None, 5), (2, 7, 5, None), (3, 7, None, 5), (4, 8, None, None), (5, 8, None, None), (6, 9, 1, None)], "command_id long, k long, a long, b long")
    there = spark.createDataFrame([(9, None, None)], "k long, a long, b long")
    assert {r.command_id: r.outcome for r in lifecycle.additions(rows, there, "k").collect()} == {1: "added", 2: "conflict", 3: "replayed", 4: "added", 5: "replayed", 6: "conflict"}


def command(run, when, number, action, **more):
    row = dict.fromkeys(f.split()[0] for f in coordination.COMMANDS.split(", "))
    return row | {"run_id": run, "at": at(when), "command_id": number, "action": action, "tags": [], "capabilities": []} | more


def replay_run(run, commands, upto):
    """The events of a run up to a moment, by one look at everything after the other."""
    tasks, leases, answers, events = {}, {}, {}, []

    def tell(moment, event, c, task=None, agent=None, lease=None, **more):
        events.append((run, moment, c, event, task, agent, lease, more.get("version", tasks.get(task, {}).get("version")), more.get("lease_version", leases.get(lease, {}).get("version")), more.get("expires", leases.get(lease, {}).get("expires")), more.get("sequence")))

    def ready(task):
        return all(n in tasks and tasks[n]["state"] == "completed" for n in tasks[task]["needs"])

    def expire(moment):
        for lease, x in sorted(leases.items(), key=lambda i: (i[1]["expires"], i[0])):
            if x["expires"] <= moment:
                t = tasks[x["task"]]
                t.update(state="ready", lease=None, version=t["version"] + 1)
                del leases[lease]
                tell(x["expires"], "lease_expired", None, x["task"], x["agent"], lease, lease_version=x["version"] + 1, expires=x["expires"])

    for c in sorted(commands, key=lambda c: (c["at"], c["command_id"])):
        if c["at"] > upto:
            continue
        expire(c["at"])
        n, task, agent, lease, action = (c[k] for k in ("command_id", "task_id", "agent_id", "lease_id", "action"))
        same = {k: v for k, v in c.items() if k not in ("at", "command_id", "key", "run_id")}
        if c["key"] in answers and c["key"] is not None:
            old, answer = answers[c["key"]]
            if old == same:
                events.append((run, c["at"], n, "replayed_" + answer[3], *answer[4:]))
            else:
                tell(c["at"], "key_conflict", n, task, agent)
            continue
        x, t = leases.get(lease), tasks.get(task)
        owned = t and x and x["agent"] == agent and x["task"] == task and t["lease"] == lease and t["version"] == c["version"] and x["version"] == c["lease_version"]
        lost = {"lease_version": None, "expires": None}
        if action == "add":
            mine = {"priority": c["priority"] or 0, "available": c["available_at"], "tags": set(c["tags"]), "required": set(c["capabilities"])}
            if t:
                tell(c["at"], "exists" if all(t[k] == v for k, v in mine.items()) else "conflict", n, task, agent, lease)
            else:
                tasks[task] = mine | {"state": "pending", "created": c["at"], "version": 1, "lease": None, "needs": set(), "sequence": 0}
                tell(c["at"], "added", n, task, agent, lease)
        elif action == "need":
            reach, rest = set(), [c["needs"]]
            while rest:
                k = rest.pop()
                if k in tasks and k not in reach:
                    reach.add(k)
                    rest += tasks[k]["needs"]
            event = "not_found" if not t or c["needs"] not in tasks else "cycle" if task in reach else "needed"
            if event == "needed":
                t["needs"].add(c["needs"])
            tell(c["at"], event, n, task, agent, lease)
        elif action == "claim":
            fits = [k for k, y in tasks.items() if task in (None, k) and y["state"] in ("pending", "ready") and (y["available"] is None or y["available"] <= c["at"]) and set(c["tags"]) <= y["tags"] and y["required"] <= set(c["capabilities"]) and ready(k)]
            best = min(fits, key=lambda k: (-tasks[k]["priority"], tasks[k]["available"] or tasks[k]["created"], tasks[k]["created"], k), default=None)
            if task is not None and not t:
                tell(c["at"], "not_found", n, task, agent, lease)
            elif c["version"] is not None and (t or tasks.get(best, {})).get("version", c["version"]) != c["version"]:
                tell(c["at"], "version_changed", n, task, agent, lease)
            elif best is None:
                tell(c["at"], "no_task_available", n, task, agent, lease)
            else:
                made = f"{run}-{n}"
                leases[made] = {"task": best, "agent": agent, "version": 1, "expires": c["at"] + dt.timedelta(seconds=c["seconds"])}
                tasks[best].update(state="claimed", lease=made, version=tasks[best]["version"] + 1)
                tell(c["at"], "claimed", n, best, agent, made)
        elif action == "renew":
            if x and x["agent"] == agent and x["version"] == c["version"]:
                x.update(expires=max(x["expires"], c["at"] + dt.timedelta(seconds=c["seconds"])), version=x["version"] + 1)
                tell(c["at"], "renewed", n, x["task"], agent, lease)
            else:
                tell(c["at"], "lease_lost", n, task, agent, lease, **lost)
        elif not owned and action in ("checkpoint", "complete", "fail", "release"):
            tell(c["at"], "lease_lost" if t else "not_found", n, task, agent, lease, **lost)
        elif action == "checkpoint":
            t.update(version=t["version"] + 1, sequence=t["sequence"] + 1)
            x["version"] += 1
            tell(c["at"], "checkpointed", n, task, agent, lease, sequence=t["sequence"])
        elif action in ("complete", "fail", "release"):
            del leases[lease]
            t.update(state={"complete": "completed", "fail": "failed"}.get(action) or ("ready" if ready(task) else "blocked"), lease=None, version=t["version"] + 1)
            tell(c["at"], {"complete": "completed", "fail": "failed", "release": "released"}[action], n, task, agent, lease, lease_version=x["version"] + 1)
        else:
            tell(c["at"], "unknown_action", n, task, agent)
        if c["key"] is not None and events[-1][3] in ("added", "needed", "claimed", "renewed", "checkpointed", "completed", "failed", "released"):
            answers[c["key"]] = (same, events[-1])
    expire(upto)
    return events


def random_commands(draw, run):
    """Commands that often fit: versions and leases are guessed near what they are."""
    out, leases = [command(run, 0, k, "add", task_id=k, priority=draw.randint(0, 2), available_at=draw.choice([None, at(40)]), tags=draw.sample(["x", "y"], draw.randint(0, 2)), capabilities=draw.choice([[], [], ["c"]])) for k in range(6)], []
    for n in range(10, 70):
        when, agent = n * 3 + draw.randint(0, 2), draw.randint(1, 3)
        action = draw.choice(["claim", "claim", "claim", "renew", "checkpoint", "complete", "fail", "release", "need", "add", "odd"])
        more = {"agent_id": agent, "key": draw.choice([None, None, None, "a", "b", f"k{n}"])}
        if action == "claim":
            more |= {"seconds": draw.choice([5, 20, 60]), "tags": draw.choice([[], [], ["x"]]), "capabilities": draw.choice([["c"], []]), "task_id": draw.choice([None, None, draw.randint(0, 7)]), "version": draw.choice([None, None, 1])}
            leases.append((f"{run}-{n}", agent))
        elif action in ("renew", "checkpoint", "complete", "fail", "release") and leases:
            lease, owner = draw.choice(leases[-3:])
            more |= {"lease_id": lease, "agent_id": draw.choice([owner, owner, owner, agent]), "task_id": draw.randint(0, 6), "version": draw.randint(1, 3), "lease_version": draw.randint(1, 2), "seconds": 30}
        elif action in ("need", "add"):
            more |= {"task_id": draw.randint(0, 8), "needs": draw.randint(0, 8), "priority": 1}
        out.append(command(run, when, n, action, **more))
    return out


def test_live_coordination_equals_ordered_replays(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    draw = random.Random(11)
    commands = [c for run in range(5) for c in random_commands(draw, run)]
    # known tasks, leases and versions: a life of one task that all goes well
    commands += [
        command(50, 0, 1, "add", task_id=1),
        command(50, 0, 2, "add", task_id=2, priority=5),
        command(50, 1, 3, "need", task_id=2, needs=1),
        command(50, 1, 4, "need", task_id=1, needs=2),
        command(50, 2, 5, "claim", agent_id=7, seconds=10),
        command(50, 3, 6, "claim", agent_id=8, seconds=10),
        command(50, 8, 7, "renew", agent_id=7, lease_id="50-5", version=1, seconds=30),
        command(50, 20, 8, "checkpoint", agent_id=7, task_id=1, lease_id="50-5", version=2, lease_version=2),
        command(50, 25, 9, "complete", agent_id=7, task_id=1, lease_id="50-5", version=3, lease_version=3, key="end"),
        command(50, 26, 10, "complete", agent_id=7, task_id=1, lease_id="50-5", version=3, lease_version=3, key="end"),
        command(50, 27, 11, "claim", agent_id=8, seconds=5),
        command(50, 32, 12, "claim", agent_id=9, seconds=5),
    ]
    last = 4000
    for name, part in (("a", commands[1::2]), ("b", commands[::2])):  # files whose rows are out of order
        draw.shuffle(part)
        spark.createDataFrame(part, coordination.COMMANDS).coalesce(1).write.parquet(str(tmp_path / "log"), mode="append")
    spark.createDataFrame([command(99, last, 1, "tick"), command(None, 1, 1, "add", task_id=1)], coordination.COMMANDS).coalesce(1).write.parquet(str(tmp_path / "log"), mode="append")
    log = counters.read_log(spark, str(tmp_path / "log"), spark.read.parquet(str(tmp_path / "log")).schema)
    counters.drain(coordination.coordinate(log, "1 hour"), str(tmp_path / "events"), str(tmp_path / "checkpoint"))
    fields = ("run_id", "at", "command_id", "event", "task_id", "agent_id", "lease_id", "version", "lease_version", "expires_at", "sequence")
    naive = lambda v: v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v
    rows = spark.read.parquet(str(tmp_path / "events")).withColumn("at", F.col("at").cast("timestamp_ntz")).withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    got = sorted((tuple(naive(r[f]) for f in fields) for r in rows.collect()), key=str)
    upto = at(last) - dt.timedelta(hours=1)  # the watermark
    want = sorted((e for run in (*range(5), 50) for e in replay_run(run, [c for c in commands if c["run_id"] == run], upto)), key=str)
    assert got == want
    assert {e[3] for e in want} >= {"added", "claimed", "lease_expired", "renewed", "checkpointed", "completed", "replayed_completed", "cycle", "no_task_available", "lease_lost", "key_conflict", "unknown_action", "version_changed"}
