"""Identities and checked encodings as column functions: uuid5, cursors, byte prefixes, strict times and JSON."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid5(namespace: str | Column, name: Column) -> Column:
    """The name-based UUID (version 5) of ``name`` in a namespace, given as a UUID text or a column of them."""
    space = F.lit(uuid.UUID(namespace).hex) if isinstance(namespace, str) else F.translate(namespace, "-", "")
    h = F.substring(F.sha1(F.concat(F.unhex(space), F.encode(name, "utf-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def cursor(at: Column, key: Column) -> Column:
    """An opaque place in a log: base64url, without padding, of the JSON list of time and key."""
    raw = F.to_json(F.array(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), key.cast("string")))
    return F.rtrim(F.translate(F.base64(F.encode(raw, "utf-8")), "+/\r\n", "-_"), F.lit("="))


def cursor_fields(c: Column) -> Column:
    """The list in a cursor; null if it is none."""
    full = F.rpad(F.translate(c, "-_", "+/"), (F.ceil(F.length(c) / 4) * 4).cast("int"), F.lit("="))
    return F.from_json(F.decode(F.try_to_binary(full, F.lit("base64")), "utf-8"), "array<string>")


def byte_prefix(c: Column, most: int) -> Column:
    """The longest beginning of whole characters within ``most`` bytes."""
    raw = F.encode(c, "utf-8")
    tries = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most))]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*tries, F.lit("")))


def strict_time(c: Column) -> Column:
    """``YYYY/MM/DD (Ddd) HH:MM`` whose weekday is that of the date; null otherwise."""
    at = F.try_to_timestamp(F.concat(F.substring(c, 1, 10), F.substring(c, 17, 6)), F.lit("yyyy/MM/dd HH:mm"))
    form = c.rlike(r"^\d{4}/\d{2}/\d{2} \([A-Z][a-z]{2}\) \d{2}:\d{2}$")
    return F.when(form & (F.date_format(at, "EEE") == F.substring(c, 13, 3)), at)


def stable_json(c: Column) -> Column:
    """JSON with sorted keys and no blanks; 1, 1.0 and true stay apart, so equal texts are equal in type too."""
    return F.to_json(F.try_parse_json(c))


def enriched(own: Column, more: Column) -> Column:
    """Two maps as one; where both have a key, ``own`` wins."""
    return F.map_concat(own, F.map_filter(more, lambda k, _: ~F.map_contains_key(own, k)))
