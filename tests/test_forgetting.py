"""Forgetting fences and metadata terms against plain Python."""

import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from cairn.functions import projection
from cairn.operators import forgetting


def meaningful(text):
    out = [raw.casefold().strip(".,:;!?()[]{}\"'") for raw in re.findall(r"[A-Za-z0-9][A-Za-z0-9_@./:+-]*", text or "")]
    return [t for t in out if len(t) >= 3 and t not in forgetting.STOP_WORDS]


def atoms(text):
    text = text or ""
    tokens = meaningful(text)
    out = {m.strip().casefold() for m in re.findall(r"""["']([^"']{3,})["']""", text)} | {m.strip().casefold() for m in re.findall(r"(?<!\d)(?:\+?\d[\d ()-]{6,}\d)(?!\d)", text)}
    out |= {t for t in tokens if len(t) >= 6 and re.search(r"\d", t)}
    out |= {" ".join(tokens[i : i + n]) for n in range(2, 6) for i in range(len(tokens) - n + 1)}
    return out - {""}


WORDS = ["budget", "code", "X9-2244", "blue", "Falcon", "smart", "attackers", "art", "attack", "the", "call", "+49 (0)30 1234-567", '"Blue  Falcon"', "'ab '", "naïve", "token7", "project."]


def test_targets_equal_plain_scores(spark):
    draw = random.Random(8)
    text = lambda n: " ".join(draw.choices(WORDS, k=draw.randint(0, n)))
    memories = [(k, draw.choice([1, 2]), text(12)) for k in range(60)] + [(90, 1, "the smart attackers"), (91, 1, None)]
    directives = [(k, draw.choice([1, 2, 3]), "Please forget " + text(6)) for k in range(25)] + [(50, 1, "erase art attack"), (51, 1, None), (52, 2, "")]
    got = forgetting.targets(spark.createDataFrame(directives, "directive_id long, scope long, text string"), spark.createDataFrame(memories, "memory_id long, scope long, text string"))
    want = set()
    for d, scope, asked in directives:
        scored = []
        for m, s, held in memories:
            if s == scope:
                a, w = sum(x in (held or "").casefold() for x in atoms(asked)), len(set(meaningful(asked)) & set(meaningful(held)))
                if a or w >= 3:
                    scored.append((120 * a + w, m))
        want |= {(d, m, s) for s, m in scored if s >= max(3, int(max(scored)[0] * 0.6))}
    assert {tuple(r) for r in got.collect()} == want
    assert (50, 90, 120) in want  # an atom across the ends of tokens
    assert forgetting.targets(spark.createDataFrame(directives, "directive_id long, scope long, text string"), spark.createDataFrame([], "memory_id long, scope long, text string")).isEmpty()


def test_fences_block_what_comes_back(spark):
    directives = spark.createDataFrame([(1, 1, 'Delete "blue falcon" and call 030-1234567')], "directive_id long, scope long, text string")
    fence = forgetting.fence(directives)
    assert {r.hash for r in fence.collect()} == {hashlib.sha256(f"active-forgetting-v1:{a}".encode()).hexdigest() for a in atoms('Delete "blue falcon" and call 030-1234567')}
    texts = [(1, 1, "the Blue Falcon is back"), (2, 2, "the Blue Falcon is back"), (3, 1, "falcon blue"), (4, 1, "my number is 030-1234567."), (5, 1, "please forget it"), (6, 1, None), (7, 1, "it should be treated as deleted")]
    got = {r.text_id: r.decision for r in forgetting.decisions(spark.createDataFrame(texts, "text_id long, scope long, text string"), fence).collect()}
    assert got == {1: "blocked", 2: "remember", 3: "remember", 4: "blocked", 5: "forget", 6: "remember", 7: "forget"}


def walk(metadata):
    """The nested walk, one call a node."""
    out, nodes = [], 0

    def visit(key, value, depth):
        nonlocal nodes
        if depth > 4 or len(out) >= 128 or nodes >= 2048:
            return
        nodes += 1
        if isinstance(value, dict):
            for k, v in value.items():
                visit(k[:128], v, depth + 1)
        elif isinstance(value, list):
            for v in value:
                visit(key, v, depth + 1)
        elif isinstance(value, (str, int)) and len(str(value)) <= 4096:
            name = " ".join(key[:128].split()).casefold()
            kind = next((k for k in projection.KEYS if name in (k, k + "s", "aliases" if k == "alias" else k + "s")), None)
            if kind and name != "aliass":
                out.append((kind, str(value)))

    for k, v in (metadata or {}).items():
        visit(k[:128], v, 0)
    return out


def test_metadata_walk_keeps_its_bounds(spark):
    draw = random.Random(9)

    def value(depth):
        kind = draw.randint(0, 5)
        if depth < 7 and kind < 2:
            return {draw.choice(["path", "Paths", "aliases", "x", " test "]): value(depth + 1) for _ in range(draw.randint(0, 3))}
        if depth < 7 and kind == 2:
            return [value(depth + 1) for _ in range(draw.randint(0, 4))]
        return draw.choice(["a/b.py", 7, True, None, 1.5, "y" * 5000, ""])

    cases = [{draw.choice(["path", "symbols", "m", "modules"]) + str(k) * (k % 2): value(0) for k in range(draw.randint(1, 5))} for _ in range(120)]
    cases += [{"paths": [f"p{k}" for k in range(500)]}, {"x": [[1]] * 3000, "path": "late"}, {"path": {"path": {"path": {"path": {"path": "deep", "test": {"a": 1}}}}}}]
    rows = [(k, json.dumps(c)) for k, c in enumerate(cases)] + [(1000, None), (1001, "{broken"), (1002, "[1, 2]"), (1003, '"path"'), (1004, "")]
    got = {r.k: [(t.kind, t.raw) for t in r.t] for r in spark.createDataFrame(rows, "k long, m string").select("k", projection.metadata_terms(F.col("m")).alias("t")).collect()}
    assert got == {k: walk(c) for k, c in enumerate(cases)} | {k: [] for k in range(1000, 1005)}
    assert len(got[120]) == 128 and got[121] == []


def test_terms_of_bare_memories(spark):
    rows = [(1, "d", None, "x" * 5000, None, None), (2, "d", "  ", "", [], "{}"), (3, "d", "ﬁle", "see a/b and A/B", ["T", "t"], None)]
    memories = spark.createDataFrame(rows, "canonical_id long, digest string, title string, content string, tags array<string>, metadata string")
    got = {}
    for r in projection.exact_terms(memories).orderBy("canonical_id", "place").collect():
        got.setdefault(r.canonical_id, []).append((r.kind, r.term))
    assert got[1] == [("memory_id", "1"), ("content_sha256", "d")] and got[2] == [("memory_id", "2"), ("content_sha256", "d")]
    assert got[3] == [("memory_id", "3"), ("content_sha256", "d"), ("title", "file"), ("tag", "t"), ("content", "see a/b and a/b"), ("path", "a/b")]
