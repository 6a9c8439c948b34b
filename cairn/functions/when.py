"""Referenced time: one expression of a text as a half-open interval, in built-in functions.

Read are ISO days and months, ``today``, ``yesterday``, ``tomorrow``, ``last/this/next
week/month/year``, ``last`` weekday, ``this/last/past weekend``, ``N units ago`` and ``past N
units``, with ``before``, ``after``, ``since`` (N units ago only), ``in``, ``on`` and
``during`` before them, and ``between A and B`` or ``from A to B``.  Counts are digits or words up to ninety-nine.  What
is vague, doubled or malformed is rejected, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of numbers, names of weekdays, largest counts by unit.
ONES = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
MOST = {"day": 1000, "week": 520, "month": 120, "year": 100}

NUMBERS = {w: i + 1 for i, w in enumerate(ONES)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
_COUNT = rf"(?:\d+|(?:{'|'.join(TENS)})(?:[ -](?:{'|'.join(ONES[:9])}))?|{'|'.join(reversed(ONES))})"
_UNIT = rf"(?:{'|'.join(MOST)})s?"
_AGO, _PAST = rf"{_COUNT} {_UNIT} ago", rf"past {_COUNT} (?:day|week|month)s?"
_PERIOD = rf"(?:\d{{4}}-\d{{2}}(?:-\d{{2}})?|{_AGO}|{_PAST}|today|yesterday|tomorrow|(?:last|this|next) (?:week|month|year)|last (?:{'|'.join(WEEKDAYS)})|(?:this|last|past) weekend)(?![\w-])"
_WHOLE = rf"(?<![\w-])(?:between {_PERIOD} and {_PERIOD}|from {_PERIOD} to {_PERIOD}|(?:(?:before|after|since|in|on|during) )?{_PERIOD})"
#: What looks like a time without being one of the forms.
_HINT = rf"\bago\b|\b(?:yesterday|today|tomorrow)\b|\b(?:last|this|next|past) (?:few |several )?(?:weekend|{_UNIT}|{_COUNT} {_UNIT}|{'|'.join(WEEKDAYS)})\b|\d{{4}}-\d{{1,2}}"


def _let(body, **values: Column) -> Column:
    """``body`` of named values, each worked out once a row instead of wherever it is named."""
    bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
    return F.get(F.transform(bound, lambda row: body(*[row[k] for k in values])), F.lit(0))


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _number(c: Column) -> Column:
    value = F.create_map(*[F.lit(x) for kv in NUMBERS.items() for x in kv])
    words = F.aggregate(F.split(c, "[ -]"), F.lit(0), lambda a, w: a + F.coalesce(value[w], F.lit(0)))
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).otherwise(words)


def _shift(day: Column, n: Column, unit: Column) -> Column:
    """``day`` moved back; a month's missing last days become its last day."""
    return F.when(unit == "day", F.date_sub(day, n)).when(unit == "week", F.date_sub(day, n * 7)).when(unit == "month", F.add_months(day, -n)).otherwise(F.add_months(day, -n * 12))


def period(p: Column, today: Column) -> Column:
    """One period as struct(first, past_end, problem): dates, and why they are null."""
    return _let(_bounds, p=p, today=today, n=_number(F.regexp_extract(p, rf"({_COUNT}) {_UNIT}", 1)), written=F.regexp_extract(p, rf"{_COUNT} ({_UNIT})", 1), unit=F.regexp_replace(F.regexp_extract(p, rf"{_COUNT} ({_UNIT})", 1), "s$", ""))


def _bounds(p: Column, today: Column, n: Column, written: Column, unit: Column) -> Column:
    most = F.create_map(*[F.lit(x) for kv in MOST.items() for x in kv])[unit]
    counted = written != ""
    # a count that no integer holds has no n
    outside = counted & ~F.coalesce(n.between(1, most), F.lit(False))
    disagrees = counted & ((n == 1) != (written == unit))
    safe = F.when(counted & ~outside, n).otherwise(1)
    past, week = p.startswith("past ") & counted, F.trunc(today, "week")
    step = F.when(p.startswith("last"), -1).when(p.startswith("next"), 1).otherwise(0)
    named = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.regexp_extract(p, r"(\w+)$", 1)).cast("int")
    back = F.pmod(F.weekday(today) + 1 - named, F.lit(7))
    iso = F.when(p.rlike(r"^\d{4}-\d{2}$"), F.concat(p, F.lit("-01"))).when(p.rlike(r"^\d{4}-"), p).try_cast("date")
    month, year = F.add_months(F.trunc(today, "month"), step), F.add_months(F.trunc(today, "year"), step * 12)
    weekend = F.date_add(week, F.when(p.startswith("this"), 5).otherwise(-2))
    first = (
        F.when(p.rlike(r"^\d{4}-"), iso)
        .when(past, F.when(unit == "month", F.add_months(today, -safe)).otherwise(F.date_add(_shift(today, safe, unit), 1)))
        .when(counted, _shift(today, safe, unit))
        .when(p.endswith("weekend"), weekend)
        .when(p.endswith(" week"), F.date_add(week, step * 7))
        .when(p.endswith(" month"), month)
        .when(p.endswith(" year"), year)
        .when(named > 0, F.date_sub(today, F.when(back == 0, 7).otherwise(back)))
        .otherwise(F.date_add(today, F.when(p == "yesterday", -1).when(p == "tomorrow", 1).otherwise(0)))
    )
    problem = F.when(outside, "relative_count_out_of_range").when(disagrees, "invalid_relative_count")
    return _let(lambda first, problem: _ended(p, today, past, first, problem), first=first, problem=problem)


def _ended(p: Column, today: Column, past: Column, first: Column, problem: Column) -> Column:
    end = (
        F.when(past, F.date_add(today, 1))
        .when(p.endswith("weekend"), F.date_add(first, 2))
        .when(p.endswith(" week"), F.date_add(first, 7))
        .when(p.endswith(" month") | p.rlike(r"^\d{4}-\d{2}$"), F.add_months(first, 1))
        .when(p.endswith(" year"), F.add_months(first, 12))
        .otherwise(F.date_add(first, 1))
    )
    return F.struct(first.alias("first"), end.alias("past_end"), F.when(problem.isNull() & first.isNull(), "invalid_date").otherwise(problem).alias("problem"))


def referenced_time(text: Column, now: Column, zone: Column) -> Column:
    """struct(status, reason, valid_from, valid_to) of a text asked at ``now`` in ``zone``.

    ``now`` and the bounds are timestamps without zone, in UTC; days begin at local
    midnight.  Status: ``matched``, ``rejected`` or ``no_match`` (null and empty texts).
    ``before`` and ``after`` leave one bound null.  A null ``now`` rejects relative forms.
    """
    said = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")
    today = F.to_date(F.convert_timezone(F.lit("UTC"), zone, now))

    def expression(found: Column, rest: Column, today: Column) -> Column:
        one = F.coalesce(F.get(found, F.lit(0)), F.lit(""))
        return _let(lambda parts, head: periods(found, rest, today, parts, head), parts=_all(one, _PERIOD), head=F.regexp_extract(one, r"^(between|from|before|after|since) ", 1))

    def periods(found: Column, rest: Column, today: Column, parts: Column, head: Column) -> Column:
        a, b = (period(F.coalesce(F.get(parts, at), F.lit("")), today) for at in (F.lit(0), F.size(parts) - 1))
        return _let(lambda a, b: _meaning(found, rest, today, parts, head, a, b, zone), a=a, b=b)

    return _let(expression, found=_all(said, _WHOLE), rest=F.regexp_replace(said, _WHOLE, " ; ").rlike(_HINT), today=today)


def _meaning(found: Column, rest: Column, today: Column, parts: Column, head: Column, a: Column, b: Column, zone: Column) -> Column:
    relative = F.exists(parts, lambda p: ~p.rlike(r"^\d{4}-"))
    pair = head.isin("between", "from")
    kind = F.when(pair, "range").when(head == "since", "range").when(head == "before", "before").when(head == "after", "after").when(F.get(parts, F.lit(0)).startswith("past ") & ~F.get(parts, F.lit(0)).endswith("weekend"), "window").otherwise("period")
    start = F.when(head == "before", None).when(head == "after", a["past_end"]).otherwise(a["first"])
    end = F.when(head == "before", a["first"]).when(head == "after", None).when(head == "since", F.date_add(today, 1)).when(pair, b["past_end"]).otherwise(a["past_end"])
    problem = (
        F.when((F.size(found) > 1) | ((F.size(found) == 1) & rest), "multiple_temporal_expressions")
        .when((F.size(found) == 0) & rest, "unsupported_temporal_expression")
        .when(F.size(found) == 0, None)
        .when(relative & today.isNull(), "relative_now_required")
        .when((head == "since") & ~F.get(parts, F.lit(0)).endswith(" ago"), "unsupported_temporal_expression")
        .when(a["problem"].isNotNull(), a["problem"])
        .when(pair & b["problem"].isNotNull(), b["problem"])
        .when(start >= end, "reversed_range")
    )
    return _let(lambda problem, start, end: _answer(found, relative, kind, problem, start, end, zone), problem=problem, start=start, end=end)


def _answer(found: Column, relative: Column, kind: Column, problem: Column, start: Column, end: Column, zone: Column) -> Column:
    matched = (F.size(found) == 1) & problem.isNull()
    status = F.when(matched, "matched").when(problem.isNotNull(), "rejected").otherwise("no_match")
    reason = F.when(matched, F.concat(F.when(relative, "anchored_relative_").otherwise("explicit_"), kind)).otherwise(F.coalesce(problem, F.lit("no_temporal_expression")))
    moment = lambda day: F.when(matched, F.convert_timezone(zone, F.lit("UTC"), day.cast("timestamp_ntz")))
    return F.struct(status.alias("status"), reason.alias("reason"), moment(start).alias("valid_from"), moment(end).alias("valid_to"))
