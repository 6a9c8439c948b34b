"""The pipeline's stages, one after the other, against plain Python."""

import collections
import hashlib
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from conftest import SF
from test_llm import SCHEMA, TEXTS, brute_components, brute_repeats, reference_fingerprint
from tokenizers import Tokenizer

from cairn.llm import textkit


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    left = [(r.doc_id, r.text) for r in docs.collect()]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items for i in range(len(w) - min(13, len(w)) + 1) if w}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = textkit.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            want = {i: t for i, t in left if t and any(c.isalpha() for c in t)}
            assert got == want
        elif name == "near_duplicates":
            classes = brute_components([reference_fingerprint(t) for _, t in left], [i for i, _ in left])
            assert set(got) == {c for c in classes}
        elif name == "decontamination":
            assert got == {i: t for i, t in left if not contaminated(words(t), windows)}
            assert len(got) < len(left)
        else:
            want = {i: (n, gone, digest) for i, n, gone, digest in brute_repeats(left) if not gone or gone < n}
            assert set(got) == set(want)
            before = dict(left)
            for i, t in got.items():  # the text as it was, or the kept words joined by one space
                own = re.findall(rb"[^\x20\x09-\x0D]+", t.encode())
                assert hashlib.sha256(b" ".join(own)).hexdigest() == want[i][2]
                assert t == before[i] if not want[i][1] else t.encode() == b" ".join(own)
        left = list(got.items())
    check_packing(left, corpus_pipeline.packing(spark, docs, SF).collect())


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def contaminated(own, windows):
    hit = set()
    for size in {len(w) for w in windows}:
        for i in range(len(own) - size + 1):
            if tuple(own[i : i + size]) in windows:
                hit.update(range(i, i + size))
    return bool(hit) and 20 * len(hit) >= len(own)


def check_packing(docs, rows):
    """Every document's ids in order, piece by piece; sequences without gaps and about as few as can be."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by, filled = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    assert set(by) == {i for i, _ in docs}
    for i, text in docs:
        ids, at = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4"), 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r.piece)):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
        assert len(by[i]) == -(-at // 1024)
    for places in filled.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 1024
    assert len(filled) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_edge_rows_run_through(spark):
    rows = [(i, t, "en" if t else None, None, len(t or ""), "clash", 1, "s") for i, t in TEXTS] + [(None, "no id here " * 30, "en", None, 5, "clash", 1, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = textkit.written(stage(spark, docs, SF), name)
        assert docs.columns == spark.createDataFrame([], SCHEMA).columns
    rows = docs.collect()
    assert {(r._id, r._fp, r.score) for r in rows} == {("clash", 1, "s")}  # the caller's values, not those of a stage
    ids = [r.doc_id for r in rows]
    assert ids.count(7) <= 1
    assert ids.count(None) == 1
    assert {1, 8, 10} <= set(ids)
    assert 3 not in ids
    assert corpus_pipeline.packing(spark, docs, SF).count() >= docs.count()


def test_empty_table_runs_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = textkit.written(stage(spark, docs, SF), f"empty-{name}")
        assert docs.isEmpty()


def test_decontamination_judges_rows_that_share_an_id_one_by_one(spark):
    bad = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first().text
    texts = [(None, bad), (None, "a clean text without an id"), (5, bad), (5, "a clean namesake"), (6, None), (None, None), (7, bad), (5, "a clean namesake")]
    docs = spark.createDataFrame([(i, t, None, None, len(t or ""), "clash", 1, "s") for i, t in texts], SCHEMA)
    kept = corpus_pipeline.decontamination(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((i, t) for i, t in texts if t != bad), key=str)


def test_language_keeps_texts_with_letters_when_nothing_can_be_learnt(spark):
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for lang, ids in ((None, [i for i, _ in TEXTS]), ("en", [held_out] * len(TEXTS))):
        docs = spark.createDataFrame([(i, t, lang, None, len(t or ""), "clash", 1, "s") for i, (_, t) in zip(ids, TEXTS, strict=True)], SCHEMA)
        kept = corpus_pipeline.language(spark, docs, SF)
        assert kept.columns == docs.columns
        assert sorted(r.text for r in kept.collect()) == sorted(t for _, t in TEXTS if t and any(c.isalpha() for c in t))


def test_language_parameters(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("en", "de"))
    kept = corpus_pipeline.language(spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == {r.doc_id for r in docs.collect() if r.lang in ("en", "de") and r.text and any(c.isalpha() for c in r.text)}
    monkeypatch.setattr(corpus_pipeline, "LEAST_SCORE", 1.1)
    assert corpus_pipeline.language(spark, docs, SF).isEmpty()


def test_equal_rows_of_ids_and_texts_alone(spark):
    docs = spark.createDataFrame([(1, "one two three four five six"), (1, "one two three four five six"), (None, None), (None, None), (2, "quite another text of seven words here")], "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == ["doc_id", "text"]
    assert sorted(got.collect(), key=str) == sorted([(1, "one two three four five six"), (None, None), (2, "quite another text of seven words here")], key=str)


def test_columns_of_any_name_and_type_run_through(spark):
    schema = "doc_id long, text string, lang string, n_words string, n_removed int, kept_text string, kept_sha256 string, fingerprint int, `a b` struct<`x y`: int, z: array<map<string, int>>>, `d.ot` map<string, int>, _row string, n_chars long"
    text = " ".join(f"w{k}" for k in range(40))
    texts = [(1, text), (1, text), (2, text + " and a tail of its own"), (3, None), (None, "one two three four")]
    more = ("own", -1, "kept", "sha", 5, {"x y": 1, "z": [{"k": 2}]}, {"m": 3}, "row")
    docs = spark.createDataFrame([(i, t, "en", *more, len(t or "")) for i, t in texts], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = textkit.written(stage(spark, docs, SF), name)
        assert docs.columns == [f.name for f in spark.createDataFrame([], schema).schema]
    rows = docs.collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_text, r["a b"]["x y"], tuple(r["d.ot"].items()), r._row) for r in rows} == {(i, "own", -1, "kept", 1, (("m", 3),), "row") for i in (1, 2, None)}
    assert {r.doc_id: r.text for r in rows}[2] == "and a tail of its own"
    assert corpus_pipeline.packing(spark, docs, SF).count() == 3
