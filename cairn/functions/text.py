"""Column functions on texts: normalised terms, tokens, trigrams, identifiers, estimates."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}_]+"
#: Plain patterns of pages: local paths, long numbers, mail addresses.
IDENTIFIERS = {
    "path": r"/[a-z]+/[0-9a-z/]+",
    "number": r"\b[0-9]{3,}\b",
    "mail": r"[\w.]+@[\w.]+\.[a-z]+",
}
#: Identifiers that memories are looked up by (fixed values).
LOOKUPS = {
    "path": r"(?<![\w./-])(?:[\w.@+-]+/)+[\w.@+-]+",
    "symbol": r"\b[A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)+\b",
    "test": r"\btest_[A-Za-z0-9_]+\b",
    "commit": r"\b[0-9a-fA-F]{7,64}\b",
    "error": r"\b(?:[A-Z][A-Z0-9_]+-\d+|SQLSTATE\s+[0-9A-Z]{5})\b",
}
#: Identifiers that a query can name, in the order they are tried (fixed values).
ASKED = (
    r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
    r"\bSQLSTATE\s+[0-9A-Z]{5}\b",
    r"(?<![\w./-])(?:[\w.@+-]+/)+[\w.@+-]+",
    r"\b[A-Za-z_]\w*(?:(?:::|\.)[A-Za-z_]\w*)+\b",
    r"\btest_[A-Za-z0-9_]+\b",
    r"\b[0-9a-fA-F]{7,64}\b",
)


def lookups(c: Column, kind: str) -> Column:
    """Distinct identifiers of a kind, as they stand in the text."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(LOOKUPS[kind]), F.lit(0)))


def query_identifiers(c: Column, most: int = 8192) -> Column:
    """Distinct identifiers of a query in their order: uuids and hashes in lower case, SQLSTATE codes in upper case with one blank."""
    found = F.regexp_extract_all(F.substring(c, 1, most), F.lit("(?i)" + "|".join(ASKED)), F.lit(0))
    state = lambda x: F.regexp_replace(F.upper(x), r"\s+", " ")
    form = lambda x: F.when(x.rlike(r"(?i)^SQLSTATE\s"), state(x)).when(x.rlike(r"^[0-9A-Fa-f]{7,64}$") | x.rlike("(?i)^" + ASKED[0] + "$"), F.lower(x)).otherwise(x)
    return F.array_distinct(F.transform(found, form))


#: Lower-case characters that fold further, by Unicode's full case folding.
_FURTHER = {c: c.casefold() for c in map(chr, range(128, 0x110000)) if c.lower() == c and c.casefold() != c}
_ONE = {c: f for c, f in _FURTHER.items() if len(f) == 1}
_MORE = {c: f for c, f in _FURTHER.items() if len(f) > 1}


def fold(c: Column) -> Column:
    """Full case folding: lower case, then the characters that fold further, such as the sharp s."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _MORE.items()])
    low = F.lower(c)
    # a class of so many characters is a long chain of tests for each character: ASCII is told apart first
    other = low.rlike(r"[^\x00-\x7F]")
    further = F.translate(F.aggregate(pairs, low, lambda s, p: F.replace(s, p["a"], p["b"])), "".join(_ONE), "".join(_ONE.values()))
    return F.when(other & low.rlike("[" + "".join(_FURTHER) + "]"), further).otherwise(low)


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Compatibility composition; only texts that are not ASCII leave the JVM."""
    other = c.rlike(r"[^\x00-\x7F]")
    return F.when(other, _compose(F.when(other, c))).otherwise(c)


def normalize_term(c: Column) -> Column:
    """A term for look-ups: NFKC, trimmed, blanks joined, case folded."""
    return fold(F.trim(F.regexp_replace(nfkc(c), r"\s+", " ")))


def canonical(c: Column) -> Column:
    """A memory's text for its fingerprint: trimmed, blanks joined, case folded."""
    return fold(F.regexp_replace(F.btrim(c, F.lit(" \t\n\x0b\f\r")), r"\s+", " "))


def canonical_json(c: Column) -> Column:
    """The same for structured contents, given as JSON: they stay apart from texts of the same look."""
    return F.concat(F.lit("json:"), F.to_json(F.try_parse_json(c)))


def tokens(c: Column, most: int | None = None) -> Column:
    """Distinct lower-case tokens in the order of first use; at most ``most`` if given."""
    out = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)))
    return F.slice(out, 1, most) if most else out


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded with two blanks before and one behind."""
    words = F.transform(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


#: English words that say nothing about what a text holds, in which sketches differ from queries (fixed values).
SKETCH_STOP_WORDS = (
    "a about after all also an and any are as at be been before being but by can could did do does for from had has have how if in into is it its may might must no not of on one or our out over should so some such "
    "than that the their them then there these they this those to up was we were what when where which while who why will with would you your"
).split()
#: Terms of a sketch (fixed value).
SKETCH_TERMS = 96


def sketch(c: Column, most: int = SKETCH_TERMS) -> Column:
    """The terms of least hash, (hash, term) each in that order: a sample of a text's words that does not favour its beginning.

    Terms have three characters at least and are no stop words.  The hash is of the term
    alone, so sketches of parts merge to that of the whole.
    """
    words = F.array_distinct(F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0)))
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*SKETCH_STOP_WORDS))
    return F.slice(F.array_sort(F.transform(kept, lambda w: F.struct(F.conv(F.substring(F.sha2(w, 256), 1, 15), 16, 10).cast("long").alias("hash"), w.alias("term")))), 1, most)


#: Runs of characters that no token goes beyond, whether it is cut before folding or after: folding makes tokens' characters of letters, digits and marks only.
WORD = r"[A-Za-z_\p{L}\p{N}\p{M}]+"


def words(rows: DataFrame, key: str, c: str) -> DataFrame:
    """``key`` and the distinct words ``c`` of each group of texts, as they are written: a text is read once, and its words are folded and hashed once a group."""
    own = F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(WORD), F.lit(0)))
    # an inner explode would make the array once more, to filter on its size
    return rows.select(key, F.explode_outer(own).alias(c)).where(F.col(c).isNotNull()).distinct()


def merged(a: Column, b: Column, most: int = SKETCH_TERMS) -> Column:
    """The sketch of two texts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, most)


def sketches(rows: DataFrame, key: str, c: str, most: int = SKETCH_TERMS) -> DataFrame:
    """``key`` and the sketch ``c`` of each group of texts, from the texts' own: what is ranked is pruned before it is shuffled."""
    terms = rows.select(key, F.explode_outer(c).alias("_x")).where("_x IS NOT NULL").distinct()
    nth = F.row_number().over(Window.partitionBy(key).orderBy("_x"))
    return terms.withColumn("_n", nth).where(F.col("_n") <= most).groupBy(key).agg(F.array_sort(F.collect_list("_x")).alias(c))


def coverage(query: Column, doc: Column) -> Column:
    """Share of the query's tokens that the document has."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, doc)) / F.size(query))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4).cast("int"))


def identifiers(c: Column, kind: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(IDENTIFIERS[kind]), F.lit(0)))


def fingerprint(*columns: str) -> Column:
    """sha256 of the columns as compact JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def sigmoid(c: Column) -> Column:
    return F.when(c >= 0, 1 / (1 + F.exp(-c))).otherwise(F.exp(c) / (1 + F.exp(c)))
