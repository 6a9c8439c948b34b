"""Registered queries of look-up terms and of active forgetting, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import projection
from cairn.operators import forgetting
from cairn.sources.tables import load, spread


def _described(spark, sf_dir):
    """Parts with metadata: a path and modules, packages in a list, an alias too deep to count, and keys that hold no terms."""
    meta = F.to_json(F.struct(
        F.struct(F.concat(F.lit("src/"), F.translate("p_brand", "#", "-"), F.lit("/mod.py")).alias("path"), F.array(F.col("p_partkey"), F.col("p_partkey") % 5).alias("Packages"), F.struct(F.struct(F.struct(F.struct(F.lit("too deep").alias("alias")).alias("e")).alias("d")).alias("c")).alias("b")).alias("a"),
        F.col("p_name").alias("note"),
        F.upper("p_type").alias("module"),
    ))
    return spread(load(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("canonical_id"), F.sha2("p_name", 256).alias("digest"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("title"), F.concat(F.lit("see TICKET-"), "p_partkey", F.lit(" in  Core.run")).alias("content"), F.array("p_brand", "p_brand").alias("tags"), meta.alias("metadata"))


def memory_terms(spark, sf_dir):
    return projection.exact_terms(_described(spark, sf_dir))


def memory_lookups(spark, sf_dir):
    return projection.lookup_texts(projection.exact_terms(_described(spark, sf_dir)))


#: ``in  Core.run`` is in the content as it stands; its term has one blank.
_TERMS = """t AS (SELECT p_partkey AS canonical_id, unnest([{'pos': 1, 'kind': 'memory_id', 'term': CAST(p_partkey AS VARCHAR)}, {'pos': 2, 'kind': 'content_sha256', 'term': sha256(p_name)}, {'pos': 3, 'kind': 'title', 'term': CASE WHEN p_partkey % 3 > 0 THEN lower(p_name) END}, {'pos': 4, 'kind': 'tag', 'term': lower(p_brand)},
 {'pos': 5, 'kind': 'content', 'term': 'see ticket-' || p_partkey || ' in core.run'}, {'pos': 6, 'kind': 'path', 'term': 'src/' || translate(lower(p_brand), '#', '-') || '/mod.py'}, {'pos': 7, 'kind': 'symbol', 'term': 'core.run'}, {'pos': 8, 'kind': 'symbol', 'term': 'mod.py'}, {'pos': 9, 'kind': 'error', 'term': 'ticket-' || p_partkey},
 {'pos': 11, 'kind': 'package', 'term': CAST(p_partkey AS VARCHAR)}, {'pos': 12, 'kind': 'package', 'term': CASE WHEN p_partkey <> p_partkey % 5 THEN CAST(p_partkey % 5 AS VARCHAR) END}, {'pos': 13, 'kind': 'module', 'term': lower(p_type)}], recursive := true) FROM part),
w AS (SELECT canonical_id, CAST(row_number() OVER (PARTITION BY canonical_id ORDER BY pos) AS INTEGER) AS place, kind, term FROM t WHERE term IS NOT NULL)"""
TERMS_SQL = f"WITH {_TERMS} SELECT * FROM w"
LOOKUP_SQL = f"WITH {_TERMS} SELECT canonical_id, string_agg(term, chr(10) ORDER BY place) AS lookup FROM w WHERE kind IN ('title', 'tag', 'path', 'symbol', 'error', 'package', 'module') GROUP BY 1"


def _turns(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("memory_id"), F.col("conv_id").alias("scope"), "turn", "text")


def _directives(spark, sf_dir):
    """Of every conversation: forget what the first turn begins with, in quotation marks."""
    first = _turns(spark, sf_dir).groupBy("scope").agg(F.min_by("text", "turn").alias("t"))
    return first.select(F.col("scope").alias("directive_id"), "scope", F.concat(F.lit('Please delete "'), F.translate(F.substring("t", 1, 24), "\"'", ""), F.lit('" and all of it')).alias("text"))


def forgotten(spark, sf_dir):
    """The turns that each conversation's directive means."""
    return forgetting.targets(_directives(spark, sf_dir), _turns(spark, sf_dir))


def fenced_turns(spark, sf_dir):
    """What the fences of all directives do to every turn."""
    turns = _turns(spark, sf_dir)
    return forgetting.decisions(turns.select(F.col("memory_id").alias("text_id"), "scope", "text"), forgetting.fence(_directives(spark, sf_dir)))


_STOP = ", ".join(f"'{w}'" for w in forgetting.STOP_WORDS)
_WORDS = r"list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9_@./:+-]*'), lambda t: trim(lower(t), '.,:;!?()[]{{}}\"''')), lambda t: length(t) >= 3 AND t NOT IN ({1}))"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _atoms(source: str, key: str) -> str:
    """Distinct atoms of the texts of a table, as rows of ``key``, scope and a."""
    words = _WORDS.format("text", _STOP)
    return rf"""(SELECT DISTINCT {key}, scope, a FROM (SELECT {key}, scope, unnest(list_transform(regexp_extract_all(text, '["'']([^"'']{{3,}})["'']', 1), lambda q: lower(trim(q, {_SPACE})))) AS a FROM {source}
 UNION ALL SELECT {key}, scope, unnest(list_transform(regexp_extract_all(text, '\+?\d[\d ()-]{{6,}}\d'), lambda q: trim(q, {_SPACE}))) FROM {source}
 UNION ALL SELECT {key}, scope, unnest(list_filter({words}, lambda t: length(t) >= 6 AND regexp_matches(t, '\d'))) FROM {source}
 UNION ALL SELECT {key}, scope, array_to_string(w[i:i + n - 1], ' ') FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT {key}, scope, {words} AS w, n FROM {source}, (VALUES (2), (3), (4), (5)) v(n)) WHERE len(w) >= n)) WHERE a <> '')"""


_FORGET = rf"""t AS (SELECT conv_id || ':' || turn AS memory_id, conv_id AS scope, turn, text FROM conversations), g AS (SELECT scope, 'Please delete "' || translate(substr(arg_min(text, turn), 1, 24), '"''', '') || '" and all of it' AS text FROM t GROUP BY scope), d AS (SELECT scope AS directive_id, scope, text FROM g),
da AS {_atoms("d", "directive_id")}, dw AS (SELECT DISTINCT directive_id, scope, unnest({_WORDS.format("text", _STOP)}) AS w FROM d), tw AS (SELECT DISTINCT memory_id, scope, unnest({_WORDS.format("text", _STOP)}) AS w FROM t)"""
FORGOTTEN_SQL = rf"""WITH {_FORGET}, h AS (SELECT directive_id, memory_id, count(*) AS n FROM da JOIN t ON t.scope = da.scope AND contains(lower(t.text), a) GROUP BY 1, 2), s AS (SELECT directive_id, memory_id, count(*) AS n FROM dw JOIN tw ON tw.scope = dw.scope AND tw.w = dw.w GROUP BY 1, 2),
p AS (SELECT coalesce(h.directive_id, s.directive_id) AS directive_id, coalesce(h.memory_id, s.memory_id) AS memory_id, coalesce(h.n, 0) AS a, coalesce(s.n, 0) AS w FROM h FULL JOIN s ON h.directive_id = s.directive_id AND h.memory_id = s.memory_id),
x AS (SELECT directive_id, memory_id, 120 * a + w AS score, max(120 * a + w) OVER (PARTITION BY directive_id) AS best FROM p WHERE a > 0 OR w >= 3) SELECT directive_id, memory_id, score FROM x WHERE score >= greatest(3, CAST(floor(0.6 * best) AS BIGINT))"""
FENCED_SQL = rf"""WITH {_FORGET}, ta AS {_atoms("t", "memory_id")}, b AS (SELECT DISTINCT memory_id FROM ta JOIN da ON da.scope = ta.scope AND da.a = ta.a)
SELECT t.memory_id AS text_id, CASE WHEN regexp_matches(t.text, '(?i)(\b(please\s+)?(delete|forget|erase)\b|\bdo\s+not\s+retain\b|\bshould\s+be\s+(treated\s+as\s+)?deleted\b|\bshould\s+(be\s+)?(unavailable|not\s+be\s+retained)\b)') THEN 'forget' WHEN b.memory_id IS NOT NULL THEN 'blocked' ELSE 'remember' END AS decision FROM t LEFT JOIN b ON b.memory_id = t.memory_id"""

QUERIES = {f.__name__: f for f in (memory_terms, memory_lookups, forgotten, fenced_turns)}
ORACLES = {"memory_terms": TERMS_SQL, "memory_lookups": LOOKUP_SQL, "forgotten": FORGOTTEN_SQL, "fenced_turns": FENCED_SQL}
