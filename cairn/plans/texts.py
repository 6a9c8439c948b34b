"""Registered queries of texts, identities and extraction, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import identity, rendering, text
from cairn.operators import extraction, work
from cairn.sources.tables import load, spread, typed, with_views

SPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
UUID5 = "(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT sha1(unhex({0}) || encode({1})) AS h))"
HEX = "'6ba7b8119dad11d180b400c04fd430c8'"


def memory_fingerprints(spark, sf_dir):
    """Canonical texts' digests and name-based identities of the parts."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit(" \t "), F.upper("p_type"), F.lit("\n")).alias("t"))
    return part.select("p_partkey", F.sha2(text.canonical(F.col("t")), 256).alias("sha256"), identity.uuid5(SPACE, F.concat_ws(":", F.lit("part"), F.col("p_partkey").cast("string"))).alias("uuid"))


FINGERPRINT_SQL = f"SELECT p_partkey, sha256(lower(p_name || ' ' || p_type)) AS sha256, {UUID5.format(HEX, chr(39) + 'part:' + chr(39) + ' || p_partkey')} AS uuid FROM part"


def event_cursors(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", identity.cursor(F.col("ts"), F.col("event_id")).alias("cursor"))
    return e.select("event_id", "cursor", F.get(identity.cursor_fields(F.col("cursor")), 1).cast("long").alias("read_back"), identity.cursor_fields(F.concat(F.lit("!"), "cursor")).isNull().alias("rejects"))


CURSOR_SQL = """SELECT event_id, rtrim(translate(to_base64(encode('["' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","' || event_id || '"]')), '+/', '-_'), '=') AS cursor, event_id AS read_back, true AS rejects FROM events"""


def byte_prefixes(spark, sf_dir):
    d = load(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select("doc_id", identity.byte_prefix(F.col("text"), 40).alias("prefix"))


PREFIX_SQL = "SELECT doc_id, substr(text, 1, list_max(list_filter(range(0, 41), lambda k: strlen(substr(text, 1, k)) <= 40))) AS prefix FROM documents WHERE text IS NOT NULL"


def strict_times(spark, sf_dir):
    """Order dates written out, with another weekday for every third and a bad hour for every seventh."""
    o = load(spark, sf_dir, "orders").withColumn("_w", F.when(F.col("o_orderkey") % 3 == 0, F.date_format(F.date_add("o_orderdate", 1), "EEE")).otherwise(F.date_format("o_orderdate", "EEE")))
    hour = F.when(F.col("o_orderkey") % 7 == 0, "25").otherwise("09")
    written = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit(" ("), "_w", F.lit(") "), hour, F.lit(":30"))
    return o.select("o_orderkey", F.date_format(identity.strict_time(written), "yyyy-MM-dd HH:mm").alias("at"))


TIME_SQL = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 09:30' END AS at FROM orders"


def payload_enrichment(spark, sf_dir):
    """Event payloads with the event's own fields; a field of the payload wins."""
    e = load(spark, sf_dir, "events")
    own = F.from_json("props", "map<string,string>")
    more = F.create_map(F.lit("k"), F.lit("never"), F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"))
    full = F.map_from_entries(F.array_sort(F.map_entries(identity.enriched(own, more))))
    return e.select("event_id", F.to_json(full).alias("payload"), identity.stable_json(F.col("props")).alias("stable"))


ENRICH_SQL = """SELECT event_id, '{"k":"' || (props->>'$.k') || '","type":"' || event_type || '","user":"' || user_id || '"}' AS payload, '{"k":' || (props->>'$.k') || '}' AS stable FROM events"""


def hash_embeddings(spark, sf_dir):
    """Entries of the hashed vectors of the parts' texts."""
    part = spread(load(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("canonical_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return work.hash_vectors(part, 64)


VECTOR_SQL = r"""WITH t AS (SELECT p_partkey AS id, unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[\p{L}\p{N}_]+')) AS w FROM part), h AS (SELECT id, sha256(w) AS h, unnest(range(0, 8)) AS o FROM t),
b AS (SELECT id, CAST('0x' || substr(h, CAST(4 * o + 1 AS INTEGER), 4) AS INTEGER) % 64 AS place, CASE WHEN CAST('0x' || substr(h, CAST(33 + 2 * o AS INTEGER), 2) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END AS s FROM h),
v AS (SELECT id, place, sum(s) AS v FROM b GROUP BY 1, 2), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM v GROUP BY 1)
SELECT v.id AS canonical_id, place, round(v / n, 6) AS value FROM v JOIN n ON v.id = n.id WHERE v <> 0"""


def _sources(spark, sf_dir):
    b = load(spark, sf_dir, "benchmark").where("text IS NOT NULL")
    return b.select(identity.uuid5(SPACE, F.col("item_id").cast("string")).alias("source_id"), "text")


def source_chunks(spark, sf_dir):
    return extraction.chunks(_sources(spark, sf_dir), 200)


CHUNK_SQL = f"""WITH s AS (SELECT {UUID5.format(HEX, "CAST(item_id AS VARCHAR)")} AS source_id, text FROM benchmark WHERE length(text) > 0), c AS (SELECT source_id, k AS chunk, substr(text, CAST(k * 200 + 1 AS INTEGER), 200) AS part FROM (SELECT source_id, text, unnest(range(0, CAST(ceil(length(text) / 200.0) AS BIGINT))) AS k FROM s)),
d AS (SELECT *, sha256(part) AS sha256 FROM c)
SELECT source_id, CAST(chunk AS INTEGER) AS chunk, {UUID5.format("replace(source_id, '-', '')", "'chunk:' || chunk || ':' || sha256")} AS chunk_id, sha256, CAST(chunk * 200 AS INTEGER) AS begin, CAST(chunk * 200 + length(part) AS INTEGER) AS "end", CAST(len(regexp_extract_all(part, '[^\\s]+')) AS INTEGER) AS n_words FROM d"""


def span_checks(spark, sf_dir):
    """Words of the chunks as spans; some are moved, and some name a chunk that is not there."""
    sources = _sources(spark, sf_dir).withColumn("n", F.length("text"))
    spans = sources.select("source_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - 20), F.lit(37))).alias("begin"))
    spans = spans.select(F.concat_ws(":", "source_id", "begin").alias("span_id"), "source_id", F.when(F.col("begin") % 5 == 0, 99).otherwise(F.floor(F.col("begin") / 200)).cast("int").alias("chunk"), "begin", (F.col("begin") + 20).alias("end"), F.substring(F.col("text"), F.col("begin") + F.when(F.col("begin") % 3 == 0, 2).otherwise(1), F.lit(20)).alias("excerpt"))
    return extraction.span_checks(spans, sources, extraction.chunks(sources, 200).where("chunk < 99"))


SPAN_SQL = f"""WITH s AS (SELECT {UUID5.format(HEX, "CAST(item_id AS VARCHAR)")} AS source_id, text FROM benchmark WHERE text IS NOT NULL), p AS (SELECT source_id, text, unnest(range(0, greatest(0, length(text) - 20) + 1, 37)) AS b FROM s)
SELECT source_id || ':' || b AS span_id, CASE WHEN b % 5 = 0 OR length(text) <= b // 200 * 200 THEN 'unknown_chunk' WHEN b + 20 > least(length(text), b // 200 * 200 + 200) THEN 'outside_chunk' WHEN b % 3 = 0 AND substr(text, CAST(b + 2 AS INTEGER), 20) <> substr(text, CAST(b + 1 AS INTEGER), 20) THEN 'not_quoted' ELSE 'valid' END AS verdict FROM p"""


def code_notes(spark, sf_dir):
    """Source code made from the parts: a declaration, a note, a blank line, and one more."""
    part = load(spark, sf_dir, "part")
    name = F.regexp_replace("p_name", "[^A-Za-z]", "_")
    second = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("    # todo: fix "), "p_type")).when(F.col("p_partkey") % 4 == 1, F.lit("  // NOTE")).otherwise(F.concat(F.lit("plain "), "p_type"))
    code = F.concat(F.when(F.col("p_partkey") % 2 == 0, "async def ").otherwise("class "), name, F.lit("(x):\n"), second, F.lit("\n\n  const "), name, F.lit(" = 1  "))
    return extraction.code_notes(part.select(F.col("p_partkey").alias("source_id"), code.alias("text")))


NOTE_SQL = """WITH c AS (SELECT p_partkey AS id, regexp_replace(p_name, '[^A-Za-z]', '_', 'g') AS n, CASE WHEN p_partkey % 2 = 0 THEN 'async def ' ELSE 'class ' END AS h, CASE p_partkey % 4 WHEN 0 THEN '    # todo: fix ' || p_type WHEN 1 THEN '  // NOTE' ELSE 'plain ' || p_type END AS s, p_type FROM part)
SELECT id AS source_id, CAST(0 AS BIGINT) AS begin, length(h || n || '(x):') AS "end", 'observation' AS kind, 'Code declaration: ' || n AS title, 'Source declares ' || h || n || '(x):' AS content, 0.9 AS confidence FROM c
UNION ALL SELECT id, length(h || n) + 5, length(h || n) + 5 + length(s), CASE WHEN id % 4 = 0 THEN 'warning' ELSE 'observation' END, CASE WHEN id % 4 = 0 THEN 'Code todo' ELSE 'Code note' END, CASE WHEN id % 4 = 0 THEN 'TODO: fix ' || p_type ELSE 'NOTE: // NOTE' END, 0.98 FROM c WHERE id % 4 < 2
UNION ALL SELECT id, length(h || n) + 5 + length(s) + 2, length(h || n) + 5 + length(s) + 2 + length('  const ' || n || ' = 1  '), 'observation', 'Code declaration: ' || n, 'Source declares const ' || n || ' = 1', 0.9 FROM c"""


def extraction_routes(spark, sf_dir):
    e = load(spark, sf_dir, "evidence").withColumn("kind", F.when(F.col("source_id") % 3 == 0, "source_code").otherwise("document")).withColumn("review", F.when(F.col("rejected"), "rejected").otherwise("accepted"))
    where, why = extraction.route(F.col("kind"), F.col("trust"), F.col("review"))
    return e.groupBy(where.alias("route"), why.alias("reason")).agg(F.count("*").alias("n"))


ROUTE_SQL = """SELECT CASE WHEN l_returnflag = 'R' OR l_linestatus = 'O' THEN 'skip' WHEN l_suppkey % 3 = 0 THEN 'coding' ELSE 'general' END AS route, CASE WHEN l_returnflag = 'R' THEN 'source_rejected' WHEN l_linestatus = 'O' THEN 'source_untrusted' END AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2"""


def proposal_order(spark, sf_dir):
    """Items as proposals of their order; a support beyond seven is unknown."""
    item = load(spark, sf_dir, "lineitem")
    action = F.get(F.array(F.lit("supersede"), F.lit("append"), F.lit("link"), F.lit("noop")), (F.col("l_suppkey") % 4).cast("int"))
    rows = item.select(F.col("l_orderkey").alias("batch_id"), action.alias("action"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_linenumber").cast("long")).alias("target"), F.array((F.col("l_partkey") % 7 + F.when(F.col("l_partkey") % 90 == 0, 5).otherwise(1))).alias("supports"))
    known = item.select(F.col("l_orderkey").alias("batch_id")).distinct().select("batch_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(7).cast("long"))).alias("key"))
    return extraction.proposals(rows, known, 3)


PROPOSAL_SQL = """WITH r AS (SELECT DISTINCT l_orderkey AS batch_id, l_suppkey % 4 AS a, list_extract(['supersede', 'append', 'link', 'noop'], l_suppkey % 4 + 1) AS action, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_linenumber AS BIGINT) END AS target, l_partkey % 7 + CASE WHEN l_partkey % 90 = 0 THEN 5 ELSE 1 END AS s FROM lineitem),
g AS (SELECT *, sha256('{"action":"' || action || '","supports":[' || s || ']' || CASE WHEN target IS NOT NULL THEN ',"target":' || target ELSE '' END || '}') AS digest FROM r WHERE batch_id NOT IN (SELECT batch_id FROM r WHERE s > 7)),
k AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY (a + 3) % 4, digest) AS place FROM g)
SELECT batch_id, action, target, CAST(place AS INTEGER) AS place, digest FROM k WHERE place <= 3"""


def evidence_unions(spark, sf_dir):
    item = load(spark, sf_dir, "lineitem")
    return extraction.evidence_union(item.select(F.col("l_orderkey").alias("group_id"), (F.col("l_suppkey") % 20).alias("evidence_id"), (F.col("l_partkey") % 2).alias("reference")))


UNION_SQL = """WITH b AS (SELECT l_orderkey AS g, l_suppkey % 20 AS e, count(DISTINCT l_partkey % 2) AS n FROM lineitem GROUP BY 1, 2)
SELECT g AS group_id, bool_or(n > 1) AS conflict, CASE WHEN NOT bool_or(n > 1) THEN string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) END AS evidence_ids FROM b GROUP BY 1"""

def memory_blocks(spark, sf_dir):
    """Memories with their evidence as blocks for a prompt."""
    e = load(spark, sf_dir, "evidence").groupBy("memory_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "source_id", "rejected"))).alias("e"))
    m = load(spark, sf_dir, "memories").join(e, "memory_id", "left")
    key = F.col("memory_id")
    columns = {c: F.col(c) for c in ("memory_id", "kind", "state", "visibility", "valid_from", "recorded_from", "valid_to", "recorded_to")} | {
        "confidence": key % 101 / 100,
        "task_id": F.when(F.col("visibility") == "task", F.col("task_id")),
        "title": F.when(key % 2 == 0, F.concat(F.lit('order "'), key.cast("string"), F.lit('"\n\\ é'))).otherwise(""),
        "tags": F.when(key % 3 == 0, F.array("kind", "state")).otherwise(F.array().cast("array<string>")),
        "metadata": F.when(key % 4 == 0, F.concat(F.lit('{"run": '), F.col("run_id").cast("string"), F.lit(', "by": "é"}'))).otherwise("{}"),
        "content": F.concat(F.lit('{"repository": '), F.col("repository").cast("string"), F.lit(', "kind": "'), "kind", F.lit('"}')),
        "evidence": F.transform("e", lambda x: F.to_json(F.struct(x["evidence_id"], x["rejected"], x["source_id"]))),
    }
    return m.select("memory_id", rendering.memory_block(columns).alias("block"))


BLOCK_SQL = r"""WITH e AS (SELECT memory_id, string_agg('evidence={"evidence_id":' || evidence_id || ',"rejected":' || rejected || ',"source_id":' || source_id || '}', chr(10) ORDER BY evidence_id, source_id, rejected) AS e FROM evidence GROUP BY 1)
SELECT m.memory_id, concat_ws(chr(10), '[memory:' || m.memory_id || ']', 'kind=' || kind || ' state=' || state || ' visibility=' || visibility || ' confidence=' || printf('%.4f', m.memory_id % 101 / 100),
'valid_from=' || strftime(valid_from, '%Y-%m-%dT%H:%M:%S+00:00'), 'recorded_from=' || strftime(recorded_from, '%Y-%m-%dT%H:%M:%S+00:00'), 'valid_to=' || strftime(valid_to, '%Y-%m-%dT%H:%M:%S+00:00'), 'recorded_to=' || strftime(recorded_to, '%Y-%m-%dT%H:%M:%S+00:00'),
CASE WHEN visibility = 'task' THEN 'task_id=' || task_id END, CASE WHEN m.memory_id % 2 = 0 THEN 'title="order \"' || m.memory_id || '\"\n\\ é"' END, CASE WHEN m.memory_id % 3 = 0 THEN 'tags=["' || kind || '","' || state || '"]' END,
CASE WHEN m.memory_id % 4 = 0 THEN 'metadata={"by":"é","run":' || run_id || '}' END, 'content={"kind":"' || kind || '","repository":' || repository || '}', e.e) AS block FROM memories m LEFT JOIN e ON m.memory_id = e.memory_id"""

def consolidation_windows(spark, sf_dir):
    """Candidates of a query as memories to consolidate, up to six, in 160 bytes."""
    items = load(spark, sf_dir, "pool").select(F.col("query_id").alias("batch_id"), F.col("lexical_rank").alias("place"), F.col("canonical_id").alias("memory_id"), (F.col("value_id") % 40 != 0).alias("recallable"), (F.col("family") != "N").alias("eligible"), F.repeat(F.lit("é"), (F.col("tokens") % 30).cast("int")).alias("title"))
    observe = lambda key, x: F.concat(F.lit('{"key":"'), key, F.lit('","memory_id":'), x["memory_id"].cast("string"), F.lit(',"title":"'), x["title"], F.lit('"}'))
    return extraction.consolidation_windows(items, observe, 6, 160)


WINDOW_SQL = """WITH i AS (SELECT query_id AS b, lexical_rank AS p, canonical_id AS m, value_id % 40 <> 0 AS good, family <> 'N' AS ok, ',"title":"' || repeat('é', CAST(tokens % 30 AS BIGINT)) || '"}' AS t FROM pool WHERE lexical_rank <= 6),
r AS (SELECT b, CAST(0 AS BIGINT) AS p, CAST(1 AS BIGINT) AS used, 0 AS n, '' AS ids, '' AS body FROM i GROUP BY b HAVING bool_and(good)
UNION ALL SELECT b, p, CASE WHEN fits THEN used + size ELSE used END, CASE WHEN fits THEN n + 1 ELSE n END, CASE WHEN fits THEN ids || CASE WHEN n > 0 THEN ',' ELSE '' END || m ELSE ids END, CASE WHEN fits THEN body || CASE WHEN n > 0 THEN ',' ELSE '' END || o ELSE body END
FROM (SELECT *, strlen(o) + 1 AS size, ok AND used + strlen(o) + 1 <= 160 AS fits FROM (SELECT r.b, i.p, used, n, ids, body, m, ok, '{"key":"m' || n || '","memory_id":' || m || t AS o FROM r JOIN i ON i.b = r.b AND i.p = r.p + 1)))
SELECT b AS batch_id, CAST(n AS INTEGER) AS n_observations, used AS input_bytes, ids AS memory_ids, sha256('{"max_actions":4,"observations":[' || body || '],"policy_revision":"evidence-gated-v1","use_provider":false}') AS input_sha256 FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY p DESC) AS k FROM r) WHERE k = 1 AND n >= 2"""

QUERIES = {f.__name__: f for f in (memory_fingerprints, event_cursors, byte_prefixes, strict_times, payload_enrichment, hash_embeddings, source_chunks, span_checks, code_notes, extraction_routes, proposal_order, evidence_unions, memory_blocks, consolidation_windows)}
ORACLES = {"memory_fingerprints": FINGERPRINT_SQL, "event_cursors": CURSOR_SQL, "byte_prefixes": PREFIX_SQL, "strict_times": TIME_SQL, "payload_enrichment": ENRICH_SQL, "hash_embeddings": VECTOR_SQL, "source_chunks": CHUNK_SQL, "span_checks": SPAN_SQL, "code_notes": typed(NOTE_SQL, confidence="DOUBLE"), "extraction_routes": ROUTE_SQL, "proposal_order": PROPOSAL_SQL, "evidence_unions": UNION_SQL, "memory_blocks": with_views(BLOCK_SQL, "memories", "evidence"), "consolidation_windows": with_views(WINDOW_SQL, "pool").replace("WITH ", "WITH RECURSIVE ", 1)}
