"""Quality rules: a table of thresholds compiled into one Spark projection.

Only DataFrame functions are used.  Words are ``[^\\x20\\x09-\\x0D]+``.  The windows of
five words of a document are hashed, and only where two hashes agree are they sorted
with their places to find the words they cover.

Defined cases: null and empty texts and those without words have all counts zero and
fail the base rule; null and repeated doc_ids and equal rows are rows of their own.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 5
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Frequent function words of the languages served (fixed values).
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha".split(),
}


class Rule(NamedTuple):
    """A document is kept while ``metric`` lies within the bounds; None is no bound."""

    name: str
    metric: str
    least: float | None
    most: float | None


#: ``metric`` is SQL over the counts that ``measure`` makes.
RULES = (
    Rule("words", "n_words", 10, 1_000_000),
    Rule("mean_word_length", "word_chars / n_words", 2.0, 16.0),
    Rule("symbols_to_words", "n_symbols / n_words", None, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.40),
    Rule("digits", "n_digits / word_chars", None, 0.35),
    Rule("bullet_lines", "n_bullet_lines / n_lines", None, 0.90),
    Rule("ellipsis_lines", "n_ellipsis_lines / n_lines", None, 0.30),
)


def _count_of(text: str, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(F.col(text), characters, ""))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``id_col`` and the counts of every row, all from one projection chain without a shuffle."""
    stops = sorted({v for words in STOP_WORDS.values() for w in words for v in (w, w.capitalize())})
    text = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    trimmed = F.btrim("_t", F.lit(SPACES))
    cut = text.select(
        id_col,
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")).alias("_lines"),
        (F.length("_t") - F.length(F.translate("_t", SPACES, ""))).alias("_blanks"),
        F.length("_t").alias("_chars"),
        _count_of("_t", SYMBOLS).alias("_symbols"),
        _count_of("_t", "0123456789").alias("_digits"),
    )
    hashed = cut.select("*", F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    n = F.size("_h")
    windows = F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(window)])))
    windows = hashed.select("*", F.coalesce(windows, F.array().cast("array<bigint>")).alias("_x"))
    none = F.array().cast("array<struct<h: bigint, p: int>>")
    placed = F.sort_array(F.transform("_x", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    ordered = windows.select("*", F.when(F.size(F.array_distinct("_x")) < F.size("_x"), placed).otherwise(none).alias("_s"))
    same = lambda i, j: F.coalesce(F.get("_s", i)["h"] == F.get("_s", j)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: same(i, i - 1) | same(i, i + 1))
    found = ordered.select("*", F.when(F.size("_s") > 0, twice).otherwise(F.array().cast("array<int>")).alias("_twice"))
    places = found.select("*", F.sort_array(F.transform("_twice", lambda i: F.get("_s", i)["p"])).alias("_p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("_p", start, lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["upto"])).alias("n"), (p + window).alias("upto")), lambda a: a["n"])
    return places.select(
        F.col(id_col),
        F.size("_w").cast("long").alias("n_words"),
        (F.col("_chars") - F.col("_blanks")).cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda x: x.isin(stops))).cast("long").alias("n_stop_words"),
        F.col("_digits").cast("long").alias("n_digits"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^\s*[-•*]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of ``measure`` breaks, as one array column."""
    broken = []
    for rule in rules:
        value = f"coalesce(try_divide({rule.metric.replace(' / ', ', ')}), 0)" if " / " in rule.metric else rule.metric
        tests = ([f"{value} < {rule.least}"] if rule.least is not None else []) + ([f"{value} > {rule.most}"] if rule.most is not None else [])
        broken.append(F.expr(f"CASE WHEN {' OR '.join(tests)} THEN '{rule.name}' END"))
    return F.array_compact(F.array(*broken))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``measure`` with ``base_failed``, ``kept`` and ``broken_rules``."""
    counts = measure(docs, id_col, text_col)
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    judged = counts.select("*", failed.alias("base_failed"), compiled(rules).alias("broken_rules"))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("broken_rules") == 0)).alias("kept"), "n_lines", "n_stop_words", "n_digits", "broken_rules")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{v}'" for v in sorted({v for words in STOP_WORDS.values() for w in words for v in (w, w.capitalize())}))
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (WHERE regexp_matches(x, '^\s*[-•*]')) AS bul, count(*) FILTER (WHERE regexp_matches(x, '(\.\.\.|…)\s*$')) AS ell FROM l GROUP BY doc_id),
k AS (SELECT doc_id, unnest(w) AS x FROM d),
kn AS (SELECT doc_id, sum(length(x)) AS wc, count(*) FILTER (WHERE x IN ({_STOPS})) AS st FROM k GROUP BY doc_id),
s AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS p FROM d),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p+4], ' ')) AS n FROM s),
r AS (SELECT doc_id, count(DISTINCT q) AS rep FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM c WHERE n > 1) GROUP BY doc_id),
a AS (SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(wc, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep, 0) AS BIGINT) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(st, 0) AS st, length(regexp_replace(t, '[^0-9]', '', 'g')) AS dg, coalesce(bul, 0) AS bul, coalesce(ell, 0) AS ell
  FROM d LEFT JOIN ln ON d.doc_id = ln.doc_id LEFT JOIN kn ON d.doc_id = kn.doc_id LEFT JOIN r ON d.doc_id = r.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words <= 1000000 AND CAST(word_chars AS DOUBLE) / greatest(n_words, 1) BETWEEN 2.0 AND 16.0 AND CAST(n_symbols AS DOUBLE) / greatest(n_words, 1) <= 0.25
  AND CAST(st AS DOUBLE) / greatest(n_words, 1) >= 0.02 AND CAST(n_dup_lines AS DOUBLE) / greatest(n_lines, 1) <= 0.40 AND CAST(dg AS DOUBLE) / greatest(word_chars, 1) <= 0.35
  AND CAST(bul AS DOUBLE) / greatest(n_lines, 1) <= 0.90 AND CAST(ell AS DOUBLE) / greatest(n_lines, 1) <= 0.30 AS kept
FROM b
"""
