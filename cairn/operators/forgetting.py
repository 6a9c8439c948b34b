"""Active forgetting: what a deletion means, and a fence that keeps it from coming back.

A directive's distinctive atoms are its quotations, phone numbers, long tokens with digits
and runs of two to five meaningful tokens.  Only salted hashes of atoms are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text
from cairn.sources.shared import written

#: Patterns (fixed values): tokens, quotations, phone numbers, and texts that ask for a deletion.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9_@./:+-]*"
QUOTED = r"""["']([^"']{3,})["']"""
PHONE = r"(?<!\d)(?:\+?\d[\d ()-]{6,}\d)(?!\d)"
DELETION = r"(?i)(?:\b(?:please\s+)?(?:delete|forget|erase)\b|\bdo\s+not\s+retain\b|\bshould\s+be\s+(?:treated\s+as\s+)?deleted\b|\bshould\s+(?:be\s+)?(?:unavailable|not\s+be\s+retained)\b)"
#: Tokens that say nothing about what is meant (fixed values).
STOP_WORDS = (
    "a after again all an and as at be before but by delete deleted do earlier exact for from going i in is it later memory not now of on only or "
    "please prior retain should the this to too treated unavailable value was with"
).split()
#: Points of an atom that is found in a memory and of a token that both have; the least score; the least share of a directive's best score (fixed values).
ATOM, WORD, LEAST, SHARE = 120, 1, 3, 0.6
SALT = "active-forgetting-v1"
#: Most hashes of a scope that are kept in one row (bound of memory, not of results).
FENCE = 4096
#: Most atoms and tokens of a scope's directives that are looked for in its texts one by one (bound of work, not of results).
LISTED = 1024


def is_deletion(c: Column) -> Column:
    return F.coalesce(c.rlike(DELETION), F.lit(False))


def meaningful(c: Column) -> Column:
    """Tokens in their order, case folded, without marks at their ends: three characters at least and no stop word."""
    tokens = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TOKEN), F.lit(0)), lambda t: F.btrim(F.lower(t), F.lit(""".,:;!?()[]{}"'""")))
    return F.filter(tokens, lambda t: (F.length(t) >= 3) & ~t.isin(*STOP_WORDS))


def _starts(length: Column, size: int) -> Column:
    """Places at which a run of ``size`` begins."""
    return F.when(length >= size, F.sequence(F.lit(1), length - (size - 1))).otherwise(F.array().cast("array<int>"))


def atoms(c: Column, tokens: Column) -> Column:
    """Distinct distinctive atoms of a text and its meaningful ``tokens``."""
    whole = F.coalesce(c, F.lit(""))
    blanks = F.lit(" \t\n\x0b\f\r")
    found = [F.transform(F.regexp_extract_all(whole, F.lit(p), F.lit(g)), lambda x: text.fold(F.btrim(x, blanks))) for p, g in ((QUOTED, 1), (PHONE, 0))]
    found.append(F.filter(tokens, lambda t: (F.length(t) >= 6) & t.rlike(r"\d")))
    run = lambda n: lambda i: F.array_join(F.slice(tokens, i, n), " ")
    for size in range(2, 6):
        found.append(F.transform(_starts(F.size(tokens), size), run(size)))
    return F.filter(F.array_distinct(F.concat(*found)), lambda a: a != "")


def with_atoms(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``_a``: a row for each atom of the column ``text``."""
    # the tokens are made once a row; the runs are cut from them
    made = rows.select(*keys, "text", meaningful(F.col("text")).alias("_tokens"))
    return made.select(*keys, F.explode(atoms(F.col("text"), F.col("_tokens"))).alias("_a"))


def fence_hash(atom: Column, salt: str = SALT) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), atom), 256)


def _grams(c: Column) -> Column:
    """Distinct pieces of one to three characters: every text that holds an atom has all of the atom's."""
    one, two, three = (_starts(F.length(c), n) for n in (1, 2, 3))
    piece = lambda n: lambda i: F.substring(c, i, F.lit(n))
    return F.array_distinct(F.concat(F.transform(one, piece(1)), F.transform(two, piece(2)), F.transform(three, piece(3))))


def _beside(memories: DataFrame, few: DataFrame) -> DataFrame:
    """``directive_id``, ``memory_id``, ``_atoms``, ``_x``: what a memory holds of each directive of its scope, which it meets in one row."""
    # text and tokens are bound, so that they are made once a row and not once an atom
    own = F.array(F.struct(text.fold(F.coalesce("text", F.lit(""))).alias("t"), F.array_distinct(meaningful(F.col("text"))).alias("w")))
    held = lambda m: lambda d: F.struct(d["directive_id"].alias("directive_id"), F.size(F.filter(d["_a"], lambda a: F.contains(m["t"], a))).alias("n"), F.array_intersect(d["_w"], m["w"]).alias("x"))
    found = F.flatten(F.transform(own, lambda m: F.filter(F.transform("_d", held(m)), lambda p: (p["n"] > 0) | (F.size(p["x"]) > 0))))
    # an inner explode would make the array once more, to filter on its size
    rows = memories.join(few.hint("merge"), "scope").select("memory_id", F.explode_outer(found).alias("_p")).where("_p IS NOT NULL")
    return rows.select("_p.directive_id", "memory_id", F.col("_p.n").cast("long").alias("_atoms"), F.col("_p.x").alias("_x"))


def _by_pieces(memories: DataFrame, asked: DataFrame) -> DataFrame:
    """The same from joins alone: an atom meets the memories of its scope that have the rarest of its three-character pieces, and is then looked for in them.

    Pieces and tokens are many a text, which no estimate from the texts' own size tells:
    they are merged, as a broadcast would take all of them through the driver.
    """
    own = memories.select("memory_id", "scope", text.fold(F.coalesce("text", F.lit(""))).alias("_t"), F.array_distinct(meaningful(F.col("text"))).alias("_w"))
    pieces = own.select("memory_id", "scope", F.explode_outer(_grams(F.col("_t"))).alias("_g")).where("_g IS NOT NULL")
    rarity = pieces.groupBy("scope", "_g").agg(F.count("*").alias("_n"))
    atom = asked.select("directive_id", "scope", F.explode("_a").alias("_a"))
    width = F.least(F.length("_a"), F.lit(3))
    held = atom.select("directive_id", "scope", "_a", F.explode(F.filter(_grams(F.col("_a")), lambda g: F.length(g) == width)).alias("_g"))
    # an atom with a piece that no memory of the scope has is in none of them
    rare = held.join(rarity.hint("merge"), ["scope", "_g"], "left").groupBy("directive_id", "scope", "_a").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_g")).alias("_r")).where("_r.n > 0")
    near = rare.select("directive_id", "scope", "_a", F.col("_r._g").alias("_g")).join(pieces.hint("merge"), ["scope", "_g"]).join(own.select("memory_id", "_t").hint("merge"), "memory_id")
    hits = near.where(F.contains("_t", "_a")).groupBy("directive_id", "memory_id").agg(F.count("*").alias("_atoms"), F.array().cast("array<string>").alias("_x"))
    words = asked.select("directive_id", "scope", F.explode("_w").alias("_x"))
    shared = words.hint("merge").join(own.select("memory_id", "scope", F.explode("_w").alias("_x")), ["scope", "_x"])
    return hits.unionByName(shared.select("directive_id", "memory_id", F.lit(0).cast("long").alias("_atoms"), F.array("_x").alias("_x")))


def targets(directives: DataFrame, memories: DataFrame) -> DataFrame:
    """``directive_id``, ``memory_id``, ``score``: the memories that a directive means.

    ``directives``: directive_id, scope, text; ``memories``: memory_id, scope, text.  An
    atom counts where the memory's text holds it, across tokens too; pairs without one need
    three tokens in common.  Of a directive's memories those stay that reach 0.6 of its
    best score.

    A memory meets all that its scope's directives ask for in one row, so its text stays
    where it is read for them.  Of a scope whose directives have more than ``LISTED`` atoms
    and tokens, these meet the memories by their pieces.
    """
    made = directives.select("directive_id", "scope", "text", meaningful(F.col("text")).alias("_tokens"))
    each = made.select("directive_id", "scope", atoms(F.col("text"), F.col("_tokens")).alias("_a"), F.array_distinct("_tokens").alias("_w"))
    asked = written(each.groupBy("directive_id", "scope").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("_a", "_w"))), "asked")
    sizes = asked.groupBy("scope").agg(F.sum(F.size("_a") + F.size("_w")).alias("_n"))
    sized = asked.join(sizes.hint("merge"), "scope")
    few = sized.where(F.col("_n") <= LISTED).groupBy("scope").agg(F.collect_list(F.struct("directive_id", "_a", "_w")).alias("_d"))
    many = sized.where(F.col("_n") > LISTED).select("directive_id", "scope", "_a", "_w")
    own = memories.select("memory_id", "scope", "text")
    found = _beside(own, few)
    if not many.isEmpty():
        found = found.unionByName(_by_pieces(own.join(many.select("scope").distinct().hint("merge"), "scope", "left_semi"), many))
    pairs = found.groupBy("directive_id", "memory_id").agg(F.sum("_atoms").alias("_atoms"), F.size(F.array_distinct(F.flatten(F.collect_list("_x")))).alias("_words"))
    scored = pairs.where("_atoms > 0 OR _words >= 3").withColumn("score", ATOM * F.col("_atoms") + WORD * F.col("_words"))
    best = F.max("score").over(Window.partitionBy("directive_id"))
    reached = F.greatest(F.lit(LEAST).cast("long"), F.floor(F.lit(SHARE) * F.col("_best")))
    return scored.withColumn("_best", best).where(F.col("score") >= reached).select("directive_id", "memory_id", "score")


def fence(directives: DataFrame, salt: str = SALT) -> DataFrame:
    """``scope``, ``hash`` of all atoms that directives name: distinct, and nothing but hashes."""
    return with_atoms(directives, "scope").select("scope", fence_hash(F.col("_a"), salt).alias("hash")).distinct()


def decisions(texts: DataFrame, fences: DataFrame, salt: str = SALT) -> DataFrame:
    """``text_id``, ``decision``: forget (a deletion is never remembered), blocked (the fence has one of its atoms), or remember.

    ``texts``: text_id, scope, text.  A text meets all hashes of its scope's fence in one
    row, so its atoms stay where they are made.  Of a scope with more than ``FENCE`` hashes
    the atoms are dealt by hash.
    """
    sizes = fences.groupBy("scope").agg(F.count("*").alias("_n"))
    sized = fences.join(sizes.hint("merge"), "scope")
    few = sized.where(F.col("_n") <= FENCE).groupBy("scope").agg(F.collect_list("hash").alias("_f"))
    many = sized.where(F.col("_n") > FENCE).select("scope", "hash")
    # the tokens are bound, so that they are made once a row and not once a run
    hashed = F.flatten(F.transform(F.array(meaningful(F.col("text"))), lambda tokens: F.transform(atoms(F.col("text"), tokens), lambda a: fence_hash(a, salt))))
    found = texts.join(few.hint("merge"), "scope").where(F.arrays_overlap("_f", hashed)).select("text_id")
    rest = texts.join(many.select("scope").distinct(), "scope", "left_semi")
    own = with_atoms(rest, "text_id", "scope").select("text_id", "scope", fence_hash(F.col("_a"), salt).alias("hash"))
    blocked = found.unionByName(own.join(many.hint("merge"), ["scope", "hash"], "left_semi").select("text_id")).distinct().withColumn("_b", F.lit(True))
    rows = texts.join(blocked.hint("merge"), "text_id", "left")
    return rows.select("text_id", F.when(is_deletion(F.col("text")), "forget").when(F.col("_b"), "blocked").otherwise("remember").alias("decision"))
