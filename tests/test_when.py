"""Referenced times against dates worked out by hand; asked on Wednesday 2024-05-15, 02:00 UTC."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cairn.functions import when

NOW = datetime(2024, 5, 15, 2)
PERIODS = {
    "what changed today?": ("05-15", "05-16"),
    "Yesterday's deploys": ("05-14", "05-15"),
    "due tomorrow": ("05-16", "05-17"),
    "the outage last week": ("05-06", "05-13"),
    "plans for next month": ("06-01", "07-01"),
    "this year": ("01-01", "2025-01-01"),
    "last wednesday": ("05-08", "05-09"),
    "last monday": ("05-13", "05-14"),
    "this weekend": ("05-18", "05-20"),
    "last  weekend": ("05-11", "05-13"),
    "3 days ago": ("05-12", "05-13"),
    "two weeks ago": ("05-01", "05-02"),
    "twenty-one days ago": ("04-24", "04-25"),
    "one year ago": ("2023-05-15", "2023-05-16"),
    "past 7 days": ("05-09", "05-16"),
    "past 1 week": ("05-09", "05-16"),
    "past two months": ("03-15", "05-16"),
    "since 2 days ago": ("05-13", "05-16"),
    "on 2024-02-29": ("02-29", "03-01"),
    "during 2024-02": ("02-01", "03-01"),
    "before 2024-03-01": (None, "03-01"),
    "after 2024-03": ("04-01", None),
    "between 2024-01-05 and 2024-02": ("01-05", "03-01"),
    "from last week to yesterday": ("05-06", "05-15"),
}
REJECTED = {
    "today or tomorrow": "multiple_temporal_expressions",
    "yesterday, some weeks ago": "multiple_temporal_expressions",
    "a few days ago": "unsupported_temporal_expression",
    "at 2024-1-5": "unsupported_temporal_expression",
    "since 2024-01-05": "unsupported_temporal_expression",
    "on 2024-02-30": "invalid_date",
    "0 days ago": "relative_count_out_of_range",
    "99999 days ago": "relative_count_out_of_range",
    "1 days ago": "invalid_relative_count",
    "from today to 2024-01-01": "reversed_range",
}


def ask(spark, texts, zone="UTC", now=NOW):
    rows = spark.createDataFrame([(t, now) for t in texts], "t string, n timestamp_ntz").repartition(3)
    return {r.t: r.w for r in rows.select("t", when.referenced_time(F.col("t"), F.col("n"), F.lit(zone)).alias("w")).collect()}


def test_periods(spark):
    day = lambda d: d and datetime.fromisoformat(d if len(d) > 5 else f"2024-{d}")
    for t, w in ask(spark, PERIODS).items():
        assert (t, w.status, w.valid_from, w.valid_to) == (t, "matched", *map(day, PERIODS[t]))


def test_rejections_and_no_match(spark):
    assert {t: w.reason for t, w in ask(spark, REJECTED).items()} == REJECTED
    assert {w.status for w in ask(spark, [None, "", "the last customer", "x" * 100_000]).values()} == {"no_match"}
    assert ask(spark, ["today"], now=None)["today"].reason == "relative_now_required"
    assert ask(spark, ["2024-01-01"], now=None)["2024-01-01"].status == "matched"


@pytest.mark.parametrize(("zone", "begin", "end"), [("America/New_York", datetime(2024, 5, 14, 4), datetime(2024, 5, 15, 4)), ("Asia/Tokyo", datetime(2024, 5, 14, 15), datetime(2024, 5, 15, 15))])
def test_days_are_local(spark, zone, begin, end):
    w = ask(spark, ["today"], zone)["today"]
    assert (w.valid_from, w.valid_to) == (begin, end)
