"""Memories as blocks of text for a prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .identity import stable_json

#: What follows the state of a block, in its order, and how each value is written (fixed values).
LINES = {"occurred_at": "time", "valid_to": "time", "recorded_to": "time", "author_agent_id": "plain", "task_id": "plain", "title": "quoted", "tags": "list", "metadata": "json"}


def iso_time(at: Column) -> Column:
    """A time in UTC, its microseconds only where there are any."""
    micros = F.date_format(at, ".SSSSSS")
    part = F.when(micros != ".000000", micros).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), part, F.lit("+00:00"))


def quoted(c: Column) -> Column:
    """A text as JSON writes it."""
    one = F.to_json(F.array(c))
    return F.substr(one, F.lit(2), F.length(one) - 2)


def memory_block(columns: dict[str, Column]) -> Column:
    """One memory as lines that name their values, so that a reader can cite it.

    ``columns``: memory_id, kind, state, visibility, confidence, valid_from, recorded_from,
    content (JSON text); any of ``LINES``; evidence (a list of JSON texts, a line each, as
    long as the recall made it).  Lines without a value, or with an empty one, are left out.
    """
    at = columns.__getitem__
    write = {"time": iso_time, "plain": lambda c: c.cast("string"), "quoted": quoted, "list": F.to_json, "json": stable_json}
    none = {"time": lambda c: F.lit(False), "plain": lambda c: c.cast("string") == "", "quoted": lambda c: c == "", "list": lambda c: F.size(c) == 0, "json": lambda c: stable_json(c) == "{}"}
    optional = [F.when(~none[how](at(k)), F.concat(F.lit(f"{k}="), write[how](at(k)))) for k, how in LINES.items() if k in columns]
    state = F.format_string("kind=%s state=%s visibility=%s confidence=%.4f", at("kind"), at("state"), at("visibility"), at("confidence"))
    head = [F.concat(F.lit("[memory:"), at("memory_id").cast("string"), F.lit("]")), state, F.concat(F.lit("valid_from="), iso_time(at("valid_from"))), F.concat(F.lit("recorded_from="), iso_time(at("recorded_from")))]
    tail = [F.transform(at("evidence"), lambda x: F.concat(F.lit("evidence="), x))] if "evidence" in columns else []
    return F.concat_ws("\n", *head, *optional, F.concat(F.lit("content="), stable_json(at("content"))), *tail)
