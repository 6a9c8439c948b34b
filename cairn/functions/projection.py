"""What a memory is looked up by: terms in its metadata, its search text, exact terms and look-up text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import text

#: Bounds (fixed values): characters of a search text, a look-up text and a term; terms of a memory; nodes, terms, depth and key characters of metadata.
SEARCH_CHARS, LOOKUP_CHARS, TERM_CHARS, TERMS, NODES, METADATA_TERMS, DEPTH, KEY_CHARS = 262_144, 8_192, 4_096, 512, 2_048, 128, 4, 128
#: Metadata keys that hold terms; each can be in the plural (fixed values).
KEYS = ("alias", "command", "commit", "error", "module", "package", "path", "symbol", "test")
#: Kinds of terms that the look-up text holds besides (fixed values).
LOOKUP_KINDS = (*KEYS, "tag", "title")
TERM = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("raw", T.StringType())]))


def walk_metadata(metadata: str | None, kinds: dict[str, str]) -> list[dict]:
    """Texts and whole numbers under the wanted keys, in the order in which they stand, within the bounds."""
    try:
        top = json.loads(metadata) if metadata else None
    except ValueError:
        return []
    found: list[dict] = []
    # a stack of (key, value, depth), the next one last; a list's members have its key and one depth more
    stack, nodes = [(k, v, 0) for k, v in reversed(top.items())] if isinstance(top, dict) else [], 0
    while stack and nodes < NODES and len(found) < METADATA_TERMS:
        key, value, depth = stack.pop()
        if depth > DEPTH:
            continue
        nodes += 1
        if isinstance(value, (dict, list)):
            inner = value.items() if isinstance(value, dict) else [(key, v) for v in value]
            stack.extend((k[:KEY_CHARS], v, depth + 1) for k, v in reversed(list(inner)))
        elif isinstance(value, (str, int)):
            kind = kinds.get(" ".join(key[:KEY_CHARS].split()).casefold())
            if kind and len(str(value)) <= TERM_CHARS:
                found.append({"kind": kind, "raw": str(value)})
    return found


@F.pandas_udf(TERM)
def _metadata(values: pd.Series) -> pd.Series:
    kinds = {name: k for k in KEYS for name in (k, f"{k}es" if k.endswith("s") else f"{k}s")}
    return values.map(lambda v: walk_metadata(v, kinds))


def metadata_terms(c: Column) -> Column:
    """Array of (kind, raw) from a JSON object; no object, or broken JSON, has none.  Rows that name no key stay in the JVM."""
    hint = F.lower(c).rlike("|".join(KEYS))
    return F.when(hint, _metadata(F.when(hint, c))).otherwise(F.array().cast(TERM))


def search_text(title: Column, content: Column, tags: Column, terms: Column) -> Column:
    """Title, content, tags and metadata terms, trimmed, one a line, as far as the bound goes."""
    parts = F.concat(F.array(F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))), F.coalesce(tags, F.array().cast("array<string>")), F.transform(terms, lambda t: t["raw"]))
    blanks = F.lit(" \t\n\x0b\f\r")
    kept = F.filter(F.transform(parts, lambda p: F.btrim(p, blanks)), lambda p: p != "")
    return F.rtrim(F.substring(F.array_join(kept, "\n"), 1, SEARCH_CHARS), F.lit("\n"))


def exact_terms(memories: DataFrame) -> DataFrame:
    """``canonical_id``, ``place``, ``kind``, ``term``: distinct normalised terms of each memory, the first ``TERMS`` of them.

    ``memories``: canonical_id, digest, title, content, tags (array), metadata (JSON).  In
    this order: id, digest, title, tags, the content if it is short, identifiers of the
    search text by kind, metadata terms.
    """
    rows = memories.withColumn("_m", metadata_terms(F.col("metadata")))
    whole = search_text(F.col("title"), F.col("content"), F.col("tags"), F.col("_m"))
    one = lambda kind, c: F.array(F.struct(F.lit(kind).alias("kind"), c.alias("raw")))
    many = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("raw")))
    short = F.when(F.length("content") <= TERM_CHARS, F.col("content"))
    parts = [one("memory_id", F.col("canonical_id").cast("string")), one("content_sha256", F.col("digest")), one("title", F.col("title")), many("tag", F.coalesce("tags", F.array().cast("array<string>"))), one("content", short)]
    parts += [many(kind, text.lookups(F.col("_s"), kind)) for kind in text.LOOKUPS] + [F.col("_m")]
    listed = rows.withColumn("_s", whole).select("canonical_id", F.posexplode(F.concat(*parts)).alias("_at", "_t"))
    terms = listed.select("canonical_id", "_at", F.col("_t.kind").alias("kind"), text.normalize_term(F.col("_t.raw")).alias("term")).where((F.length("term") > 0) & (F.length("term") <= TERM_CHARS))
    first = terms.groupBy("canonical_id", "kind", "term").agg(F.min("_at").alias("_at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("canonical_id").orderBy("_at"))).where(F.col("place") <= TERMS).select("canonical_id", "place", "kind", "term")


def lookup_texts(terms: DataFrame) -> DataFrame:
    """``canonical_id``, ``lookup``: the terms of ``exact_terms`` that can be misspelt, one a line."""
    own = terms.where(F.col("kind").isin(*LOOKUP_KINDS)).groupBy("canonical_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("_l"))
    return own.select("canonical_id", F.substring(F.array_join(F.transform("_l", lambda x: x["term"]), "\n"), 1, LOOKUP_CHARS).alias("lookup"))
