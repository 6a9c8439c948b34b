"""Live coordination of runs: a stream of commands, one state a run, timers for leases.

Commands wait in the run's state until the watermark has passed them; then they are taken
in the order of their time and id, whatever the order they came in.  A lease that nobody
renews runs out by a timer, before the commands of the same moment.  A run has one writer,
so agents are served one after the other; runs are spread over the cluster by their id,
and their state lives in the state store, not in the worker.

Commands: ``run_id``, ``at``, ``command_id``, ``action``, ``agent_id``, ``task_id``,
``lease_id``, ``version`` (of the task, or of the lease for a renewal), ``lease_version``,
``seconds`` (of a claim or renewal), ``tags`` and ``capabilities`` (a task's own; of a
claim: those that a task must have, and those that the agent has), ``priority``,
``available_at``, ``needs`` (a task), ``key`` (a command with a key is done once; its
repetition gives the stored answer, another command under the key a conflict).

Actions: add (a task), need (task needs another, refused if that closes a cycle), claim,
renew, checkpoint, complete, fail, release.  Rows without a run, a time or a command id
take no part; unknown actions are answered ``unknown_action``.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMANDS = (
    "run_id long, at timestamp, command_id long, action string, agent_id long, task_id long, lease_id string, version long, lease_version long, "
    "seconds int, tags array<string>, capabilities array<string>, priority int, available_at timestamp, needs long, key string"
)
EVENTS = "run_id long, at_micros long, command_id long, event string, task_id long, agent_id long, lease_id string, version long, lease_version long, expires_micros long, sequence long"
_FIELDS = [f.split()[0] for f in EVENTS.split(", ")]


class Run:
    """The tasks and leases of a run, and what a command does to them.

    ``changed`` has the entries that are to be stored again: (table, key).
    """

    def __init__(self, run_id: int, tasks: dict[int, dict], leases: dict[str, dict], answers: dict[str, list]) -> None:
        self.run_id, self.tasks, self.leases, self.answers = run_id, tasks, leases, answers
        self.changed: set[tuple[str, object]] = set()
        self.open = sorted(self._order(k) for k, t in tasks.items() if t["state"] in ("pending", "ready"))
        self.ends = sorted((lease["expires"], k) for k, lease in leases.items())

    def _order(self, task_id: int) -> tuple:
        t = self.tasks[task_id]
        return -t["priority"], t["created"] if t["available"] is None else t["available"], t["created"], task_id

    def _event(self, at: int, event: str, command_id: int | None = None, task_id: int | None = None, agent_id: int | None = None, lease_id: str | None = None, **more: int | None) -> dict:
        task, lease = self.tasks.get(task_id) or {}, self.leases.get(lease_id) or {}
        own = {"run_id": self.run_id, "at_micros": at, "command_id": command_id, "event": event, "task_id": task_id, "agent_id": agent_id, "lease_id": lease_id}
        own |= {"version": task.get("version"), "lease_version": lease.get("version"), "expires_micros": lease.get("expires")}
        return dict.fromkeys(_FIELDS) | own | more

    def _store(self, table: str, key: object) -> None:
        self.changed.add((table, key))

    def _free(self, task_id: int, state: str) -> None:
        t = self.tasks[task_id]
        t |= {"state": state, "agent": None, "lease": None, "version": t["version"] + 1}
        self._store("tasks", task_id)
        if state in ("pending", "ready"):
            bisect.insort(self.open, self._order(task_id))

    def _ready(self, task_id: int) -> bool:
        return all(self.tasks.get(n, {}).get("state") == "completed" for n in self.tasks[task_id]["needs"])

    def _drop(self, lease_id: str) -> None:
        lease = self.leases.pop(lease_id)
        del self.ends[bisect.bisect_left(self.ends, (lease["expires"], lease_id))]
        self._store("leases", lease_id)

    def expire(self, upto: int) -> Iterator[dict]:
        """Leases that end at or before ``upto``, first to last; their tasks are ready again."""
        while self.ends and self.ends[0][0] <= upto:
            end, lease_id = self.ends[0]
            lease = self.leases[lease_id]
            self._drop(lease_id)
            self._free(lease["task"], "ready")
            yield self._event(end, "lease_expired", None, lease["task"], lease["agent"], lease_id, lease_version=lease["version"] + 1, expires_micros=end)

    def apply(self, c: dict) -> dict:
        """What becomes of a command, which is after all that came before and all leases that have ended."""
        mark = json.dumps({k: v for k, v in c.items() if k not in ("command_id", "at", "key")}, sort_keys=True)
        if c["key"] is not None and c["key"] in self.answers:
            known, answer = self.answers[c["key"]]
            same = known == mark
            return answer | {"at_micros": c["at"], "command_id": c["command_id"], "event": f"replayed_{answer['event']}"} if same else self._event(c["at"], "key_conflict", c["command_id"], c["task_id"], c["agent_id"])
        step = getattr(self, f"_{c['action']}", None) if c["action"] in ("add", "need", "claim", "renew", "checkpoint", "complete", "fail", "release") else None
        out = step(c) if step else self._event(c["at"], "unknown_action", c["command_id"], c["task_id"], c["agent_id"])
        # only what was done is stored: a command that failed can be sent again
        if c["key"] is not None and out["event"] in ("added", "needed", "claimed", "renewed", "checkpointed", "completed", "failed", "released"):
            self.answers[c["key"]] = [mark, out]
            self._store("answers", c["key"])
        return out

    def _says(self, c: dict, event: str, lease_id: str | None = None, **more: int | None) -> dict:
        return self._event(c["at"], event, c["command_id"], c["task_id"], c["agent_id"], lease_id if lease_id is not None else c["lease_id"], **more)

    def _add(self, c: dict) -> dict:
        own = {"priority": c["priority"] or 0, "available": c["available_at"], "tags": sorted(set(c["tags"] or [])), "required": sorted(set(c["capabilities"] or []))}
        old = self.tasks.get(c["task_id"])
        if c["task_id"] is None:
            return self._says(c, "not_found")
        if old:
            return self._says(c, "exists" if all(old[k] == v for k, v in own.items()) else "conflict")
        self.tasks[c["task_id"]] = own | {"state": "pending", "created": c["at"], "version": 1, "agent": None, "lease": None, "needs": [], "sequence": 0}
        self._store("tasks", c["task_id"])
        bisect.insort(self.open, self._order(c["task_id"]))
        return self._says(c, "added")

    def _need(self, c: dict) -> dict:
        task, needed = c["task_id"], c["needs"]
        if task not in self.tasks or needed not in self.tasks:
            return self._says(c, "not_found")
        seen, rest = set(), [needed]
        while rest:
            n = rest.pop()
            if n == task:
                return self._says(c, "cycle")
            if n not in seen and n in self.tasks:
                seen.add(n)
                rest.extend(self.tasks[n]["needs"])
        if needed not in self.tasks[task]["needs"]:
            self.tasks[task]["needs"].append(needed)
            self._store("tasks", task)
        return self._says(c, "needed")

    def _fits(self, task_id: int, c: dict) -> bool:
        t = self.tasks[task_id]
        due = t["available"] is None or t["available"] <= c["at"]
        return due and set(c["tags"] or ()) <= set(t["tags"]) and set(t["required"]) <= set(c["capabilities"] or ()) and self._ready(task_id)

    def _claim(self, c: dict) -> dict:
        named = c["task_id"]
        if named is not None:
            if named not in self.tasks:
                return self._says(c, "not_found")
            if c["version"] is not None and self.tasks[named]["version"] != c["version"]:
                return self._says(c, "version_changed")
            open_ = [self._order(named)] if self.tasks[named]["state"] in ("pending", "ready") else []
        else:
            open_ = self.open
        found = next((o for o in open_ if self._fits(o[-1], c)), None)
        if found is None:
            return self._says(c, "no_task_available")
        if c["version"] is not None and self.tasks[found[-1]]["version"] != c["version"]:
            return self._says(c, "version_changed")
        del self.open[bisect.bisect_left(self.open, found)]
        task_id, lease_id = found[-1], f"{self.run_id}-{c['command_id']}"
        t = self.tasks[task_id]
        t |= {"state": "claimed", "agent": c["agent_id"], "lease": lease_id, "version": t["version"] + 1}
        self._store("tasks", task_id)
        self.leases[lease_id] = {"task": task_id, "agent": c["agent_id"], "expires": c["at"] + 1_000_000 * (c["seconds"] or 0), "version": 1}
        self._store("leases", lease_id)
        bisect.insort(self.ends, (self.leases[lease_id]["expires"], lease_id))
        return self._event(c["at"], "claimed", c["command_id"], task_id, c["agent_id"], lease_id)

    def _renew(self, c: dict) -> dict:
        lease = self.leases.get(c["lease_id"])
        if not lease or lease["agent"] != c["agent_id"] or lease["version"] != c["version"]:
            return self._says(c, "lease_lost", lease_version=None, expires_micros=None)
        del self.ends[bisect.bisect_left(self.ends, (lease["expires"], c["lease_id"]))]
        lease |= {"expires": max(lease["expires"], c["at"] + 1_000_000 * (c["seconds"] or 0)), "version": lease["version"] + 1}
        bisect.insort(self.ends, (lease["expires"], c["lease_id"]))
        self._store("leases", c["lease_id"])
        return self._says(c | {"task_id": lease["task"]}, "renewed")

    def _owned(self, c: dict) -> str | None:
        """Why the agent can't write to the task; None if it can."""
        if c["task_id"] not in self.tasks:
            return "not_found"
        t, lease = self.tasks[c["task_id"]], self.leases.get(c["lease_id"])
        held = lease and lease["agent"] == c["agent_id"] and lease["task"] == c["task_id"] and t["lease"] == c["lease_id"]
        return None if held and t["version"] == c["version"] and lease["version"] == c["lease_version"] else "lease_lost"

    def _checkpoint(self, c: dict) -> dict:
        if why := self._owned(c):
            return self._says(c, why, lease_version=None, expires_micros=None)
        t, lease = self.tasks[c["task_id"]], self.leases[c["lease_id"]]
        t |= {"version": t["version"] + 1, "sequence": t["sequence"] + 1}
        lease["version"] += 1
        self._store("tasks", c["task_id"])
        self._store("leases", c["lease_id"])
        return self._says(c, "checkpointed", sequence=t["sequence"])

    def _end(self, c: dict, event: str, state: str) -> dict:
        if why := self._owned(c):
            return self._says(c, why, lease_version=None, expires_micros=None)
        version = self.leases[c["lease_id"]]["version"] + 1
        self._drop(c["lease_id"])
        self._free(c["task_id"], state)
        return self._says(c, event, lease_version=version)

    def _complete(self, c: dict) -> dict:
        return self._end(c, "completed", "completed")

    def _fail(self, c: dict) -> dict:
        return self._end(c, "failed", "failed")

    def _release(self, c: dict) -> dict:
        ready = c["task_id"] in self.tasks and self._ready(c["task_id"])
        return self._end(c, "released", "ready" if ready else "blocked")


class Coordinator(StatefulProcessor):
    """A run's commands and leases in the state store; one timer, at the next command or end of a lease."""

    TABLES = ("tasks", "leases", "answers")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, command_id long", "command string")
        self.tables = {t: handle.getMapState(t, "key string", "value string") for t in self.TABLES}
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first = None
        for row in rows:
            at = int(row["at_micros"])
            command = {f: row[f] for f in ("command_id", "action", "agent_id", "task_id", "lease_id", "version", "lease_version", "seconds", "priority", "needs", "key")}
            command |= {"at": at, "available_at": row["available_micros"], "tags": list(row["tags"] or []), "capabilities": list(row["capabilities"] or [])}
            self.waiting.updateValue((at, int(row["command_id"])), (json.dumps(command),))
            first = at if first is None else min(first, at)
        self._wake(first)
        return iter([])

    def _wake(self, micros: int | None) -> None:
        """The timer is set to the earlier of what it was and ``micros``."""
        if micros is None:
            return
        at = -(-micros // 1000)
        if self.timer.exists():
            old = self.timer.get()[0]
            if old <= at:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.timer.clear()
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        stored = {t: {k[0]: json.loads(v[0]) for k, v in state.iterator()} for t, state in self.tables.items()}
        run = Run(int(key[0]), {int(k): v for k, v in stored["tasks"].items()}, stored["leases"], stored["answers"])
        waiting = sorted((int(k[0]), int(k[1])) for k in self.waiting.keys())
        due = [k for k in waiting if k[0] <= upto]
        out = []
        for k in due:
            command = json.loads(self.waiting.getValue(k)[0])
            self.waiting.removeKey(k)
            out.extend(run.expire(command["at"]))
            out.append(run.apply(command))
        out.extend(run.expire(upto))
        for table, entry in run.changed:
            held = getattr(run, table)
            if entry in held:
                self.tables[table].updateValue((str(entry),), (json.dumps(held[entry]),))
            elif self.tables[table].containsKey((str(entry),)):
                self.tables[table].removeKey((str(entry),))
        after = [waiting[len(due)][0]] if len(due) < len(waiting) else []
        self._wake(min(after + [run.ends[0][0]] if run.ends else after, default=None))
        return (Row(**e) for e in out)

    def close(self) -> None:
        pass


def coordinate(commands: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Events of a stream of commands, each by its own time; later rows than ``lateness`` are left out.

    What lies after the watermark has not happened yet: commands wait, leases run on.  The
    session needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = commands.where("run_id IS NOT NULL AND at IS NOT NULL AND command_id IS NOT NULL")
    timed = rows.withColumn("at_micros", F.unix_micros("at")).withColumn("available_micros", F.unix_micros("available_at")).withWatermark("at", lateness)
    events = timed.groupBy("run_id").transformWithState(Coordinator(), EVENTS, "Append", "EventTime")
    return events.withColumn("at", F.timestamp_micros("at_micros")).withColumn("expires_at", F.timestamp_micros("expires_micros")).drop("at_micros", "expires_micros")
