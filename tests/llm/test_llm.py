"""The text operators against plain Python, on edge cases and on the smallest tables."""

import collections
import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import op1_quality_rules, op2_substring, op3_simhash, op4_toxicity, op5_quality, op6_decontaminate, op7_tokens, op8_language, op9_packing, op10_lm, queries, textkit, tokens, trie

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _fp int, score string"
PASSAGE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, PASSAGE + " tail one two three"),
    (2, "head\n" + PASSAGE),
    (3, None),
    (4, ""),
    (5, "   \n\t "),
    (6, "short"),
    (7, PASSAGE + " tail one two three"),
    (7, PASSAGE + " tail one two three"),
    (None, "no id here " * 30),
    (8, "a b c d e " * 40),
    (9, "x" * 70_000),
    (10, " ".join(f"v{i % 997}z{i}" for i in range(30_000))),
    (11, "Größe, naïve… don't  stop.\n\nNow, U.S.A. 3.5 é\xa0x"),
    (12, "1234 5678 !!! ???"),
    (13, "idiot scum " + PASSAGE[:80]),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(i, t, "en" if t else None, None, len(t or ""), "clash", 1, "s") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name]).df()
    keys = [c for c in ("doc_id", "item_id") if c in want.columns]
    want = want.sort_values(keys).reset_index(drop=True)
    got = queries.QUERIES[name](spark, SF).toPandas().sort_values(keys).reset_index(drop=True)
    for c in want.columns:
        assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_rules_on_edge_cases(edge, empty):
    got = {r.doc_id: r for r in op1_quality_rules.apply_rules(edge).collect()}
    assert got[3].n_words == got[4].n_words == got[5].n_words == 0
    assert got[3].base_failed and not got[3].kept
    assert got[8].n_repeat_words == 200
    assert got[10].n_words == 30_000
    assert got[10].n_repeat_words == 0
    assert op1_quality_rules.apply_rules(empty).isEmpty()


def brute_repeats(rows, size=20, tie=None):
    """``tie`` orders rows that share a doc_id; by default their texts do."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r] if tie else 0, (r[1] or "").encode()))
    seen, out = {}, []
    for i, text in rows:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if key in seen:
                gone[p : p + size] = [True] * size
            seen[key] = 1
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_repeats_equal_brute_force(edge, empty):
    got = sorted(map(tuple, op2_substring.remove_repeats(edge, chunks=5).collect()), key=str)
    assert got == brute_repeats(TEXTS)
    assert op2_substring.remove_repeats(empty).isEmpty()
    kept = op2_substring.remove_repeats(edge, carry=edge.columns)
    assert set(edge.columns) < set(kept.columns)
    assert kept.count() == len(TEXTS)


@pytest.mark.parametrize("chunks", [1, 3, 40])
def test_repeats_of_rows_that_share_an_id(spark, chunks):
    """The order of rows with one doc_id, and so what goes, does not depend on the chunks."""
    rows = [(i, f"{PASSAGE} {k}") for k in range(8) for i in (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tie = {(r.doc_id, r.text): r.h for r in docs.select("*", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)).alias("h")).collect()}
    assert sorted(map(tuple, op2_substring.remove_repeats(docs, chunks=chunks).collect()), key=str) == brute_repeats(rows, tie=tie)


def test_chunks_follow_the_bytes_of_the_texts(spark):
    assert textkit.chunk_count(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "text") == 32
    assert textkit.chunk_count(spark.createDataFrame([], "doc_id long, text string"), "text") == 32
    long = spark.range(1000).select(F.repeat(F.lit("x"), 1000).alias("text"))
    assert textkit.chunk_count(long, "text", each=1000) == 1032
    assert (textkit.bucket_count(3), textkit.bucket_count(100), textkit.bucket_count(8000)) == (3, 32, 1000)


@pytest.mark.parametrize("window", [5, 9, 20, 40])
def test_difference_covers_meet(window):
    v, cover = op2_substring.cover_for(window)
    size = window - v + 1
    for i in range(v):
        for j in range(v):
            assert any((i + d) % v in cover and (j + d) % v in cover and d + size <= window for d in range(v))


def brute_components(fps, ids):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, doc in enumerate(ids):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(fps))]


def reference_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_near_duplicates_equal_brute_force(spark, edge, empty):
    fps = [reference_fingerprint(t) for _, t in TEXTS]
    want = sorted(zip([i for i, _ in TEXTS], [f"{x:016x}" for x in fps], brute_components(fps, [i for i, _ in TEXTS]), strict=True), key=str)
    got = op3_simhash.near_duplicates(edge).select("doc_id", "fingerprint", "component_id")
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert op3_simhash.near_duplicates(empty).isEmpty()


def test_links_of_crowded_fingerprints(spark, monkeypatch):
    """Many fingerprints round one centre, in blocks of 16: the same components as all pairs give."""
    monkeypatch.setattr(op3_simhash, "GROUP", 16)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 2**63, 100)}
    centre = 0x0123456789ABCDEF
    for _ in range(300):
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)))
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    links = op3_simhash.near_links(spark.createDataFrame([(x,) for x in signed], "_fp long"))
    roots = {r._node: r._root for r in op3_simhash.connected(links).collect()}
    want = brute_components(fps, list(range(len(fps))))
    groups = collections.defaultdict(set)
    for x, w in zip(signed, want, strict=True):
        groups[w].add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def held_out(name, remainder, modulus, label, spark, sf="/root/testdata/sf0.01"):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % modulus == remainder for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    table = duckdb.sql(f"SELECT doc_id, {label} AS y FROM read_parquet('{sf}/{'documents' if label == 'lang' else 'labels'}.parquet') WHERE {label} IS NOT NULL").df()
    return got[got.held_out].merge(table, on="doc_id")


def test_language_held_out_accuracy(spark):
    rows = held_out("op8_language_id", 2, 4, "lang", spark)
    assert (rows.lang_pred == rows.y).mean() > 0.98


def test_toxicity_held_out(spark):
    rows = held_out("op4_toxicity", 2, 4, "toxic", spark, "/root/testdata/sf0.1")
    assert rows[rows.y == 1].predicted.mean() > 0.7
    assert rows[rows.y == 0].predicted.mean() < 0.02


def test_quality_held_out(spark):
    rows = held_out("op5_quality_classifier", 1, 3, "quality", spark)
    assert (rows.predicted == rows.y).mean() > 0.95


def test_pairs_are_learnt_that_linear_weights_miss():
    """Each of two terms is harmless alone; together they are toxic."""
    rng = np.random.default_rng(2)
    sets, labels = [], []
    for _ in range(4000):
        a, b = (rng.random(2) < 0.5).tolist()
        sets.append(np.unique([10] * a + [20] * b + [100 + int(x) for x in rng.integers(0, 50, 5)]).astype(np.int64))
        labels.append(float(a and b))
    check_machine(sets, labels)


def test_pairs_of_terms_that_say_nothing_alone():
    """One term or the other is toxic, both or neither is not: neither depends on the label."""
    rng = np.random.default_rng(3)
    sets, labels = [], []
    for _ in range(6000):
        a, b = (rng.random(2) < 0.5).tolist()
        sets.append(np.unique([10] * a + [20] * b + [100 + int(x) for x in rng.integers(0, 200, 8)]).astype(np.int64))
        labels.append(float(a != b))
    check_machine(sets, labels)


def check_machine(sets, labels):
    machine = op4_toxicity.Machine(sets, np.array(labels))
    slots = [machine.slot[s][machine.slot[s] > 0] for s in sets[:500]]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in slots])))
    z, _ = machine._forward(np.concatenate(slots).astype(int), bounds)
    assert ((z > 0) == (np.array(labels[:500]) == 1)).mean() > 0.97


def test_models_without_anything_to_learn_from(spark, edge, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = op4_toxicity.train(edge, labels, F.lit(True))
    assert {r.score for r in op4_toxicity.score(edge, model).collect()} == {0.5}
    stats = op5_quality.describe(edge)
    assert {r.score for r in op5_quality.score(stats, op5_quality.train(stats, labels, F.lit(True))).collect()} == {0.5}
    assert op5_quality.describe(empty).isEmpty()
    got = {r.doc_id: r for r in op8_language.identify(edge, op8_language.train(edge, F.lit(True))).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[12].lang_pred == "und"
    assert got[11].lang_pred == "en"
    assert {r.lang_pred for r in op8_language.identify(edge, op8_language.train(empty, F.lit(True))).collect()} == {"und"}


def test_factorization_machine_equals_brute_force(spark, edge):
    """Scores of a trained model on edge texts, by sums over all pairs of terms."""
    texts = ["you idiot group", "a kind group", "idiot", "plain words here"] * 40
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t.startswith("you"))) for i, t in enumerate(texts)], "doc_id long, toxic int")
    model = op4_toxicity.train(docs, labels, F.lit(True))
    assert len(model.linear) > 3
    rows = op4_toxicity.score(edge, model, "made").collect()
    assert len(rows) == len(TEXTS)
    assert {r.score for r in rows} == {"s"}  # the caller's column stays
    for r in rows:
        terms = sorted({int(textkit.hash_words([w], textkit.ALNUM, True).hashes[0] >> np.uint64(44)) for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (r.text or "").encode())})
        use = [k for k in (int(model.slot[t]) for t in terms) if k]
        z = model.bias + sum(model.linear[k] for k in use) + sum(float(model.factors[a] @ model.factors[b]) for a, b in itertools.combinations(use, 2))
        assert abs(r.made - 1 / (1 + math.exp(-z))) < 1e-9


def test_discriminant_equals_brute_force(spark, edge):
    """Moments, shrinkage and densities written out; edge texts scored by the trained model."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = op5_quality.train(op5_quality.describe(docs), labels, F.lit(True))
    rows = docs.join(labels.where("quality IS NOT NULL"), "doc_id").select("text", "quality").collect()
    x = op5_quality.statistics([None if r.text is None else r.text.encode() for r in rows])
    y = np.array([r.quality for r in rows])
    every, d = np.cov(x.T, bias=True), x.shape[1]
    edge_x = op5_quality.statistics([None if t is None else t.encode() for _, t in TEXTS])
    logs = []
    for k in (0, 1):
        n = (y == k).sum()
        w = op5_quality.POOL + (1 - op5_quality.POOL) * d / (d + n)
        c = (1 - w) * np.cov(x[y == k].T, bias=True) + w * every
        c = (1 - op5_quality.SHRINK) * c + op5_quality.SHRINK * np.diag(np.diag(c)) + op5_quality.FLOOR * np.diag(np.maximum(np.diag(every), 1e-8))
        away = edge_x - x[y == k].mean(axis=0)
        logs.append(np.log(n / len(y)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(c), away))
    want = 1 / (1 + np.exp(-np.clip(op5_quality.SOFTEN * (logs[1] - logs[0]), -40, 40)))
    got = [r.score for r in op5_quality.score(op5_quality.describe(edge), model).collect()]
    assert np.allclose(sorted(got), sorted(want), atol=1e-6)


def test_kernel_equals_brute_force(spark, edge):
    """Kernel values as sets of n-grams, and predictions of edge texts as plain sums over landmarks."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op8_language.train(docs, F.lit(True))

    def grams(text):
        b = [c | 32 if 65 <= c <= 90 or 97 <= c <= 122 else 32 if c < 128 else c for c in (text or "").encode()]
        code = lambda x: x[0] if len(x) == 1 else (int.from_bytes(bytes(x), "big") * 2654435761 % 2**32) >> 19
        return {code(b[i : i + n]) for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    marks = [set(np.flatnonzero(row).tolist()) for row in model.landmarks]
    for r in op8_language.identify(edge, model, score_name="sure").collect():
        assert r.score == "s"
        own = grams(r.text)
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.sure) == ("und", 0.0)
            continue
        k = np.array([len(own & m) / math.sqrt(len(own) * len(m)) for m in marks])
        value = op8_language.SHARPNESS * (k @ model.weights + model.bias)
        assert r.lang_pred == model.names[int(value.argmax())]
        assert abs(r.sure - np.exp(value - value.max()).max() / np.exp(value - value.max()).sum()) < 1e-3


def test_components_of_a_hot_node(spark):
    """One node linked to all of a group, a chain, and a pair."""
    links = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(200)] + [(-5, -7)]
    roots = {r._node: r._root for r in op3_simhash.connected(spark.createDataFrame(links, "_u long, _v long")).collect()}
    want = {i: 0 for i in range(3000)} | {10_000 + i: 10_000 for i in range(201)} | {-5: -7, -7: -7}
    assert roots == want


def test_decontamination_on_edge_cases(spark, edge, empty):
    items = spark.createDataFrame([("a", PASSAGE[20:120]), ("b", "SHORT"), ("c", None), ("d", "..."), ("a", "idiot scum w0 w1"), (None, PASSAGE[:60])], "item_id string, text string")
    got = op6_decontaminate.contamination(edge, items)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(TEXTS)
    assert rows[1].item_ids == ["", "a"]  # a null item_id counts as the empty text
    assert rows[6].item_ids == ["b"]
    assert rows[6].n_hit == 1
    assert rows[13].item_ids == ["", "a"]
    assert not rows[10].contaminated
    assert rows[4].n_words == rows[3].n_words == 0
    many = op6_decontaminate.BLOCK_CHARS
    op6_decontaminate.BLOCK_CHARS = 40  # several blocks of items give the same
    try:
        again = {r.doc_id: r for r in op6_decontaminate.contamination(edge, items).collect()}
    finally:
        op6_decontaminate.BLOCK_CHARS = many
    assert {k: (r.n_hit, r.item_ids) for k, r in again.items()} == {k: (r.n_hit, r.item_ids) for k, r in rows.items()}
    assert op6_decontaminate.contamination(empty, items).isEmpty()
    assert op6_decontaminate.contamination(edge, items.limit(0)).where("n_hit > 0").isEmpty()


@pytest.fixture(scope="module")
def reference_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(reference_ids):
    made = tokens.encoder(tokens.default_path())
    texts = [t for _, t in TEXTS] + ["<|endoftext|> a", "a\x1cb c", "é.à, ß…. x", "a.b,c .,x 3.5, x.'s", "\n\n x  \n", "It's. we'll, you're"]
    for text, ids in zip(texts, made.encode_all([None if t is None else t.encode() for t in texts]), strict=True):
        assert ids.tolist() == reference_ids(text)


@pytest.mark.parametrize("bounds", [(250_000, 1 << 20), (50, 7)])
def test_encoder_on_random_texts(monkeypatch, bounds):
    """Marks, apostrophes, white space of all kinds, letters with and without ASCII, added tokens; with a cache that overflows as well."""
    monkeypatch.setattr(tokens, "KEPT", bounds[0])
    monkeypatch.setattr(tokens, "BLOCK", bounds[1])
    plain, made, rng = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), tokens.Encoder(tokens.default_path(), True), random.Random(8)
    common = [*" \t\n\r\v\f'.,-_!0123456789abcstremdlvyzSTMD", *map(chr, [0xE9, 0xF1, 0xDF, 0x130, 0x153, 0x416, 0xD7, 0xF7, 0xB2, 0xBF, 0x20AC, 0x2014, 0x4E16, 0xFB01, 0x1F642, 0x301, 0x483]), "'s", "'ll", "''", "  "]
    rare = [*map(chr, [0xA0, 0x2003, 0x200B, 0x3000, 0xFEFF, 0x1C, 0x85, 0x180E, 0, 0x7F]), "<|endoftext|>"]
    for signs in (common, common + rare, [chr(c) for c in range(1, 0x3000)]):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(1500)]
        for text, ids in zip(texts, made.encode_all([t.encode() for t in texts]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_two_byte_letters_are_letters():
    for c in (*range(0xC0, 0x250), *range(0x400, 0x480)):
        assert tokens._TWO[chr(c).encode()[0]] and (unicodedata.category(chr(c))[0] == "L") == (c not in (0xD7, 0xF7))


def test_special_tokens_get_their_ids_as_by_the_plain_call(spark, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two <|endoftext|> three", "<|endoftext|>", "a<|endoftext|><|endoftext|>b, c.", "<|endoftext| > x", "after"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0].count(50256) == 1 and want[2].count(50256) == 2
    docs = spark.createDataFrame([(i, t, None, None, len(t), "clash", 1, "s") for i, t in enumerate(texts)], SCHEMA)
    op7_tokens.write_tokens(docs, str(tmp_path / "t"))
    rows = {r.doc_id: r for r in op7_tokens.read_digests(spark, str(tmp_path / "t")).collect()}
    pieces = {r.doc_id: r for r in op9_packing.pack_documents(docs).collect()}
    at = 0
    for i, ids in enumerate(want):
        crcs = [zlib.crc32(np.array([*ids, end], dtype="<u4").tobytes()) for end in (0, 2)]
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (at, len(ids) + 1, crcs[0])
        assert (pieces[i].length, pieces[i].ids_crc32) == (len(ids) + 1, crcs[1])
        at += len(ids) + 1


@pytest.mark.parametrize("bits", [1, 7, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 70_001, dtype=np.uint64).astype(np.uint32)
    packed = op7_tokens.pack_bits(ids, bits)
    assert len(packed) <= len(ids) * bits // 8 + 8
    for a, b in ((0, 70_001), (5, 6), (65_530, 65_545), (1, 70_000), (9, 9)):
        assert (op7_tokens.unpack_bits(packed, bits, a, b) == ids[a:b]).all()


def test_token_files_round_trip(spark, edge, empty, reference_ids, tmp_path):
    op7_tokens.write_tokens(edge, str(tmp_path / "t"))
    got = sorted(map(tuple, op7_tokens.read_digests(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    start, order = 0, sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (doc, text), row in zip(order, got, strict=True):
        ids = np.array([*reference_ids(text), 0], dtype="<u4")
        assert row == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    place = {r.place: r.id for r in op7_tokens.read_stretch(spark, str(tmp_path / "t"), 150, 480).collect()}
    flat = [i for doc, text in order for i in (*reference_ids(text), 0)]
    assert place == dict(zip(range(150, 480), flat[150:480], strict=True))
    op7_tokens.write_tokens(empty, str(tmp_path / "e"))
    assert op7_tokens.read_digests(spark, str(tmp_path / "e")).isEmpty()


def test_packing_places(edge, empty, reference_ids):
    rows = op9_packing.pack_documents(edge).collect()
    texts = collections.defaultdict(list)
    for i, t in TEXTS:
        texts[i].append(np.array([*reference_ids(t), 2], dtype="<u4"))
    assert sum(r.length for r in rows) == sum(len(x) for v in texts.values() for x in v)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in texts[r.doc_id]}
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert op9_packing.pack_documents(empty).isEmpty()


def test_plans_are_nearly_full():
    rng = np.random.default_rng(4)
    counts = np.bincount(np.minimum(1 + rng.exponential(200, 20_000).astype(int), 1024), minlength=1025)
    plan = op9_packing.plan_sequences(counts)
    used = np.zeros(1025, dtype=int)
    for times, kinds in plan:
        assert sum(n * m for n, m in kinds) <= 1024
        for n, m in kinds:
            used[n] += n and m * times
    assert (used == counts).all()
    assert sum(t for t, _ in plan) <= math.ceil((counts * np.arange(1025)).sum() / 1024) + 1


@pytest.mark.parametrize("chunks", [1, 4, 70])
def test_language_model_equals_brute_force(edge, empty, chunks, monkeypatch):
    monkeypatch.setattr(op10_lm, "SPLIT", 3)  # frequent first words are spread over buckets
    learn = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    rows = op10_lm.score_texts(edge, learn, chunks=chunks).collect()
    single, pair, triple, follow, token = *(collections.Counter() for _ in range(4)), {}
    grams = lambda w: zip([None, None, *w[:-2]] if len(w) > 1 else [None], [None, *w[:-1]], w, strict=True)
    for i, t in TEXTS:
        w = [*(t or "").encode().lower().split(), None]
        token.setdefault(i, w)
        if (i or 0) % 2 == 0:
            single.update(w)
            for u, v, x in grams(w):
                pair[v, x] += 1
                triple[u, v, x] += 1
                follow[u, v] += 1
    n, v, (m2, m3) = sum(single.values()), len(single), op10_lm.MASSES
    assert len(rows) == len(TEXTS)

    def probability(u, y, x):
        p1 = (single[x] + 1) / (n + v + 1)
        p2 = (pair[y, x] + m2 * p1) / (single[y] + m2)
        return (triple[u, y, x] + m3 * p2) / (follow[u, y] + m3)

    for r in rows:
        w = token[r.doc_id]
        p1 = [(single[x] + 1) / (n + v + 1) for x in w]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(single[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(map(math.log10, p1))) < 1e-6
        assert abs(r.score - sum(math.log10(probability(*g)) for g in grams(w))) <= 1e-3 * len(w)
    assert op10_lm.score_texts(empty, learn).isEmpty()


def test_scores_are_higher_for_what_was_learnt(spark):
    """Held-out texts that repeat training text score above those that do not, and all above the base."""
    rows = queries.QUERIES["op10_lm_scoring"](spark, "/root/testdata/sf0.01").toPandas()
    each = (rows.score - rows.base_score) / rows.n_tokens
    assert each[~rows.held_out].mean() > each[rows.held_out].mean() > 0


def test_trie_finds_what_was_built():
    rng = np.random.default_rng(6)
    words = np.unique(rng.integers(0, 2**40, 3000, dtype=np.uint64))
    keys2 = np.unique(np.minimum(rng.zipf(1.3, 20_000), len(words)) - 1) * len(words)
    keys2 = np.unique(rng.choice(keys2, 20_000) + rng.integers(0, len(words), 20_000))
    keys3 = np.unique(rng.integers(0, len(keys2), 30_000) * len(words) + rng.integers(0, len(words), 30_000))
    share, held, share3 = (rng.uniform(1e-7, 1, len(k)) for k in (keys2, keys2, keys3))
    made = trie.Trie.mapped(trie.Trie.build(words, keys2 // len(words), keys2 % len(words), *map(trie.encode, (share, held)), keys3 // len(words), keys3 % len(words), trie.encode(share3)))
    assert isinstance(made.share.base, np.ndarray)
    found = made.bigrams(words[keys2 // len(words)], words[keys2 % len(words)])
    assert found.tolist() == list(range(len(keys2)))
    third = made.trigrams(keys3 // len(words), words[keys3 % len(words)])
    assert third.tolist() == list(range(len(keys3)))
    for codes, want in ((made.share, share), (made.held, held), (made.share3, share3)):
        assert (np.abs(np.log10(trie.decode(codes)) - np.log10(want)) < 3e-4).all()
    have = set(keys2.tolist())
    a, b = rng.integers(0, len(words), (2, 5000))
    assert (made.bigrams(words[a], words[b]) >= 0).tolist() == [(x * len(words) + y) in have for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert (made.bigrams(words[a] + np.uint64(1), np.full(5000, 2**41, np.uint64)) == -1).all()


def test_scores_beside_columns_of_any_type(spark):
    schema = "doc_id long, text string, lang string, `a b` struct<`x y`: int>, `d.ot` map<string, int>"
    docs = spark.createDataFrame([(k, f"a text {k} of words", "en", {"x y": k}, {"m": k}) for k in range(8)], schema)
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    scored = op4_toxicity.score(docs, op4_toxicity.train(docs, labels, F.lit(True)))
    named = op8_language.identify(docs, op8_language.train(docs, F.lit(True)))
    printed = op3_simhash.add_fingerprints(docs, "fp of it")
    kept = op2_substring.remove_repeats(docs, carry=docs.columns, prefix="its ")
    for rows, name in ((scored, "score"), (named, "lang_pred"), (printed, "fp of it"), (kept, "its kept_text")):
        got = rows.collect()
        assert {(r["a b"]["x y"], r["d.ot"]["m"]) for r in got} == {(k, k) for k in range(8)}
        assert all(r[name] is not None for r in got)
