"""A training corpus from raw documents, in five stages.

Each stage reads what its predecessor wrote.  The first four return the columns of
``documents``; the last returns the packed pieces.

1. ``language``: documents whose predicted language is not one of ``LANGUAGES`` (None: all
   that were learnt) are rejected, and so are those without a letter (or null); where no
   model can be trained, only the latter.  ``LEAST_SCORE`` rejects guesses of a lower score
   too; it is 0, as texts that are named rightly can have any score above a guess's.
2. ``near_duplicates``: of each SimHash component the document with the smallest doc_id
   stays; a component whose doc_ids are all null keeps one of its rows.
3. ``substrings``: words of repeated windows go; a text that loses words becomes its
   kept words joined by one space, with ``n_chars`` counted anew; a document that loses
   all its words goes.
4. ``decontamination``: contaminated documents go; rows that share a doc_id, or have none,
   are judged one by one.
5. ``packing``: the pieces of what is left, with their sequences.

Columns of ``documents`` keep their values, whatever their names; those that the stages
need for themselves begin with ``_cairn_``.  An empty table stays empty through all
stages; long texts are read whole; equal rows are near-duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import textkit
from cairn.llm.op2_substring import remove_repeats
from cairn.llm.op3_simhash import near_duplicates
from cairn.llm.op6_decontaminate import contamination
from cairn.llm.op8_language import identify, train, with_letters
from cairn.llm.op9_packing import pack_documents


#: Languages that are kept (None: all), and the least score.
LANGUAGES: tuple[str, ...] | None = None
LEAST_SCORE = 0.0


def _named(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    textkit.bounded_batches(spark)
    model = train(docs, textkit.crc_remainder(F.col("doc_id"), 4) != 2)
    if model is None:  # nothing to learn from: every text would be und
        return with_letters(docs)
    named = identify(docs, model, lang_name="_cairn_lang", score_name="_cairn_score")
    kept = (F.col("_cairn_lang") != "und") & (F.col("_cairn_score") >= LEAST_SCORE)
    if LANGUAGES is not None:
        kept &= F.col("_cairn_lang").isin(*LANGUAGES)
    return named.where(kept).drop("_cairn_lang", "_cairn_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row for each component: the smallest doc_id (null last), then fingerprint, then text hash."""
    keyed = docs.withColumn("_cairn_hash", F.xxhash64("text"))
    # ids, hashes and fingerprints only: the texts are joined back by id and hash
    of = textkit.written(near_duplicates(keyed, carry=("_cairn_hash",)), "near")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "fingerprint", F.col("_cairn_hash").alias("h"))
    lead = of.groupBy("root_fingerprint").agg(F.min(order).alias("lead"))
    kept = textkit.written(lead.select(F.col("lead.doc_id").alias("_cairn_lead_id"), F.col("lead.h").alias("_cairn_lead_hash")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_cairn_lead_id")) & (F.col("_cairn_hash") == F.col("_cairn_lead_hash"))
    # as many as there are components: merged, not taken through the driver
    rows = keyed.join(kept.hint("merge"), same, "left_semi")
    if of.join(kept.hint("merge"), same, "left_semi").count() > kept.count():  # rows that share doc_id and text
        # columns of any type have an order as JSON; rows of equal JSON are equal
        other = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
        rest = Window.partitionBy("doc_id", "_cairn_hash").orderBy(F.xxhash64(F.to_json(F.struct(*other))) if other else F.lit(0))
        rows = rows.withColumn("_cairn_nth", F.row_number().over(rest)).where("_cairn_nth = 1")
    return rows.select(*_named(docs))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = remove_repeats(docs, carry=docs.columns, prefix="_cairn_").where("_cairn_n_removed = 0 OR _cairn_n_removed < _cairn_n_words")
    changed = F.col("_cairn_n_removed") > 0
    new = {"text": F.when(changed, F.col("_cairn_kept_text")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("_cairn_kept_text").cast("long")).otherwise(F.col("n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return left.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows with the same key have the same text, and so the same verdict
    keyed = docs.withColumn("_cairn_row", F.xxhash64("doc_id", "text"))
    found = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_cairn_row")
    bad = textkit.written(found.where("contaminated").select("_cairn_row").distinct(), "contaminated")
    return keyed.join(bad, "_cairn_row", "left_anti").select(*_named(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Language identification, components and packing are beyond SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = textkit.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
