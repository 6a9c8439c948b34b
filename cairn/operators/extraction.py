"""Extraction from sources: chunks, routes, code rules, span checks, proposals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import identity

#: Lines that declare something, notes of engineers, and names (fixed values).
DECLARATION = r"^\s*(?:(?:export|public|private|protected|static|async)\s+)*(?:(?:def|class|function|interface|type|enum|struct|trait|fn)\s+[A-Za-z_]\w*|(?:const|let|var)\s+[A-Za-z_]\w*\s*(?::[^=]+)?=)"
NOTE = r"(?i)(?:#|//|/\*|\*)\s*(TODO|FIXME|WARNING|WARN|NOTE)\b[:\s-]*(.*)"
NAME = r"(?:(?:def|class|function|interface|type|enum|struct|trait|fn|const|let|var)\s+)([A-Za-z_]\w*)"
LONGEST_LINE = 8192
BLANKS = " \t\n\x0b\f\r"


def chunks(sources: DataFrame, size: int) -> DataFrame:
    """``sources``: source_id (a UUID text), text.  Pieces of ``size`` characters with their identity, digest, place and words."""
    n = F.ceil(F.length("text") / size).cast("int")
    cut = sources.where(F.length("text") > 0).select("source_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    part = cut.select("source_id", "chunk", F.substring(F.col("text"), F.col("chunk") * size + 1, F.lit(size)).alias("part"))
    digest = F.sha2("part", 256)
    words = F.size(F.filter(F.split("part", r"[\s\x1c-\x1f\x85\xa0]+"), lambda w: w != ""))
    return part.select("source_id", "chunk", identity.uuid5(F.col("source_id"), F.concat(F.lit("chunk:"), F.col("chunk"), F.lit(":"), digest)).alias("chunk_id"), digest.alias("sha256"), (F.col("chunk") * size).alias("begin"), (F.col("chunk") * size + F.length("part")).alias("end"), words.alias("n_words"))


def route(kind: Column, trust: Column, review: Column) -> tuple[Column, Column]:
    """coding, general or skip, and why it is skipped."""
    why = F.when(review == "rejected", "source_rejected").when(trust == "untrusted", "source_untrusted")
    return F.when(why.isNotNull(), "skip").when(kind == "source_code", "coding").otherwise("general"), why


def code_notes(sources: DataFrame) -> DataFrame:
    """Declarations and notes in source code, with the exact place of their line.

    ``sources``: source_id, text.  A note on a line wins over a declaration.
    """
    lines = sources.select("source_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "x"))
    before = Window.partitionBy("source_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("begin", F.coalesce(F.sum(F.length("x") + 1).over(before), F.lit(0))).where((F.btrim("x", F.lit(BLANKS)) != "") & (F.length("x") <= LONGEST_LINE))
    label = F.upper(F.regexp_extract("x", NOTE, 1))
    detail = F.btrim(F.regexp_extract("x", NOTE, 2), F.lit(BLANKS))
    plain = F.btrim("x", F.lit(BLANKS))
    rows = placed.select("source_id", "begin", (F.col("begin") + F.length("x")).alias("end"), "x", label.alias("label"), F.col("x").rlike(DECLARATION).alias("_declares"), detail.alias("_d"), plain.alias("_p")).where("label <> '' OR _declares")
    note = F.col("label") != ""
    content = F.when(note, F.concat("label", F.lit(": "), F.when(F.col("_d") != "", F.col("_d")).otherwise(F.col("_p")))).otherwise(F.concat(F.lit("Source declares "), "_p"))
    kind = F.when(note & F.col("label").isin("TODO", "FIXME", "WARNING", "WARN"), "warning").otherwise("observation")
    title = F.when(note, F.concat(F.lit("Code "), F.lower("label"))).otherwise(F.concat(F.lit("Code declaration: "), F.regexp_extract("x", NAME, 1)))
    return rows.select("source_id", "begin", "end", kind.alias("kind"), title.alias("title"), content.alias("content"), F.when(note, 0.98).otherwise(0.9).alias("confidence"))


def span_checks(spans: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Whether each span lies in its chunk and quotes its source.

    ``spans``: span_id, source_id, chunk, begin, end, excerpt; ``sources``: source_id,
    text; ``chunks``: source_id, chunk, begin, end.
    """
    held = chunks.select("source_id", "chunk", F.col("begin").alias("_b"), F.col("end").alias("_e"))
    rows = spans.join(held, ["source_id", "chunk"], "left").join(sources.select("source_id", "text"), "source_id", "left")
    quoted = F.substring(F.col("text"), F.col("begin") + 1, F.col("end") - F.col("begin")) == F.col("excerpt")
    verdict = F.when(F.col("_b").isNull(), "unknown_chunk").when((F.col("begin") < F.col("_b")) | (F.col("end") > F.col("_e")), "outside_chunk").when(~quoted, "not_quoted").otherwise("valid")
    return rows.select("span_id", verdict.alias("verdict"))


#: Revision named in a consolidation's digest (fixed value).
POLICY = "evidence-gated-v1"
#: Order in which proposals are applied (fixed values).
ACTIONS = ("append", "link", "noop", "supersede")


def proposals(rows: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """The first ``most`` distinct proposals of each batch by action, then digest; a proposal with an unknown key voids its batch.

    ``rows``: batch_id, action, target, supports (array); ``known``: batch_id, key.
    """
    named = rows.select("batch_id", F.explode(F.array_compact(F.array_append("supports", F.col("target")))).alias("key"))
    void = named.join(known, ["batch_id", "key"], "left_anti").select("batch_id").distinct()
    digest = F.sha2(F.to_json(F.struct("action", "supports", "target")), 256)
    distinct = rows.join(void, "batch_id", "left_anti").withColumn("digest", digest).dropDuplicates(["batch_id", "digest"])
    order = Window.partitionBy("batch_id").orderBy(F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")), "digest")
    return distinct.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("batch_id", "action", "target", "place", "digest")


def evidence_union(rows: DataFrame) -> DataFrame:
    """Evidence of a group's members by id, once each; whether one id stands for different references.

    ``rows``: group_id, evidence_id, reference.
    """
    by = rows.groupBy("group_id", "evidence_id").agg(F.count_distinct("reference").alias("_n"), F.min("reference").alias("_r"))
    lists = by.groupBy("group_id").agg(F.bool_or(F.col("_n") > 1).alias("conflict"), F.array_sort(F.collect_list("evidence_id")).alias("_e"))
    return lists.select("group_id", "conflict", F.when(~F.col("conflict"), F.array_join(F.transform("_e", lambda x: x.cast("string")), ",")).alias("evidence_ids"))


def consolidation_windows(items: DataFrame, observe: Callable[[Column, Column], Column], most: int, max_bytes: int, max_actions: int = 4, use_provider: bool = False) -> DataFrame:
    """What each batch shows to a consolidation: its eligible memories, in order, that still fit.

    ``items``: batch_id, place (from 1), memory_id, recallable, eligible, and what
    ``observe(key, item)`` needs to write an observation as JSON under its key.  Of a batch
    the first ``most`` are asked for; all must be recallable, and two at least must fit
    into ``max_bytes`` of JSON, else the batch has no window.
    """
    asked = items.where(F.col("place") <= most)
    item = F.struct("place", *[c for c in items.columns if c not in ("batch_id", "place")])
    lists = asked.groupBy("batch_id").agg(F.array_sort(F.collect_list(item)).alias("_l"), F.every("recallable").alias("_all"))
    texts = F.array().cast("array<string>")

    def step(a, x):
        text = observe(F.concat(F.lit("m"), F.size(a["kept"]).cast("string")), x)
        used = a["used"] + F.octet_length(text) + 1
        more = F.struct(used.cast("long").alias("used"), F.concat(a["kept"], F.array(text)).alias("kept"), F.concat(a["ids"], F.array(x["memory_id"].cast("string"))).alias("ids"))
        return F.when(x["eligible"] & (used <= max_bytes), more).otherwise(a)

    fold = F.aggregate("_l", F.struct(F.lit(1).cast("long").alias("used"), texts.alias("kept"), texts.alias("ids")), step)
    rows = lists.where("_all").select("batch_id", fold.alias("_w")).where(F.size("_w.kept") >= 2)
    head, tail = f'{{"max_actions":{max_actions},"observations":[', f'],"policy_revision":"{POLICY}","use_provider":{str(use_provider).lower()}}}'
    whole = F.concat(F.lit(head), F.array_join("_w.kept", ","), F.lit(tail))
    return rows.select("batch_id", F.size("_w.kept").alias("n_observations"), F.col("_w.used").alias("input_bytes"), F.array_join("_w.ids", ",").alias("memory_ids"), F.sha2(whole, 256).alias("input_sha256"))
