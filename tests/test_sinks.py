"""Sinks: batches that are delivered twice or stop half-way count once."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.streaming import counters, sinks

EVENTS = "event_id long, key string, version long, at timestamp, payload string"
MESSAGES = "event_id long, topic string"


def messages(events):
    return events.where("key IS NOT NULL").select("event_id", F.concat(F.lit("changed:"), "key").alias("topic"))


def rows(spark, *events):
    return spark.createDataFrame([(i, k, v, dt.datetime(2024, 1, 1, 0, i), p) for i, k, v, p in events], EVENTS)


def state(store):
    return {r.key: (r.version, r.payload) for r in store.current().collect()}


def test_batches_count_once_and_late_versions_lose(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "store"), EVENTS, "key", "version")
    assert state(store) == {} and store.events().isEmpty() and store.compact() == -1
    first = rows(spark, (1, "a", 2, "a2"), (2, "b", 1, "b1"), (3, None, 1, "none"))
    store.write(first, 0, messages)
    assert state(store) == {"a": (2, "a2"), "b": (1, "b1")}
    store.write(first, 0, messages)  # delivered again
    store.write(rows(spark, (4, "a", 1, "late"), (5, "b", 1, "same version"), (6, "c", 5, "c5")), 1, messages)
    assert state(store) == {"a": (2, "a2"), "b": (1, "b1"), "c": (5, "c5")}
    assert sorted(r.event_id for r in store.events().collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted((r.event_id, r.topic) for r in store.outbox(MESSAGES).collect()) == [(1, "changed:a"), (2, "changed:b"), (4, "changed:a"), (5, "changed:b"), (6, "changed:c")]
    assert sorted((r.batch, r.n_events, r.n_outbox) for r in store.commits().collect()) == [(0, 3, 2), (1, 3, 3)]
    assert store.compact() == 1 and state(store) == {"a": (2, "a2"), "b": (1, "b1"), "c": (5, "c5")}
    store.write(rows(spark, (7, "b", 2, "b2"), (8, "a", 2, "same again")), 2, messages)
    assert state(store) == {"a": (2, "a2"), "b": (2, "b2"), "c": (5, "c5")}
    assert store.compact() == 2 and state(store)["b"] == (2, "b2")


def test_a_batch_that_stops_half_way_is_invisible(spark, tmp_path):
    store = sinks.Store(spark, str(tmp_path / "store"), EVENTS, "key", "version")

    def fails(events):
        raise RuntimeError("lost")

    batch = rows(spark, (1, "a", 1, "a1"))
    with pytest.raises(RuntimeError):
        store.write(batch, 0, fails)
    assert state(store) == {} and store.events().isEmpty()
    store.write(batch, 0, messages)
    assert state(store) == {"a": (1, "a1")} and store.events().count() == 1


def test_stream_into_the_store(spark, tmp_path):
    log, store = str(tmp_path / "log"), sinks.Store(spark, str(tmp_path / "store"), EVENTS, "key", "version")
    rows(spark, (1, "a", 1, "a1"), (2, "b", 1, "b1")).coalesce(1).write.parquet(log)
    stream = counters.read_log(spark, log, EVENTS)
    store.attach(stream, messages).awaitTermination()
    rows(spark, (3, "a", 2, "a2")).coalesce(1).write.parquet(log, mode="append")
    store.attach(stream, messages).awaitTermination()
    assert state(store) == {"a": (2, "a2"), "b": (1, "b1")} and store.commits().count() == 2
    store.attach(stream, messages).awaitTermination()  # nothing new
    assert store.events().count() == 3
