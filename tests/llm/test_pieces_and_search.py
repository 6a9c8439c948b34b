"""Token alignment, prefix counts and ranked search against plain Python, on edge cases and on the smallest tables."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm import op11_alignment, op12_counts, op13_ranked_search, pieces, textkit

SCHEMA = "doc_id long, text string, lang string, _id string, n_tokens int, score string, figures map<string,int>"
SNIPPETS = ["the", "ing", " ", "  ", "    ", "\n", "▁", "é", "漢", "🙂", "'s", ".", "12", "<s>", "<unk>", "<|endoftext|>", "\x00", "q", "Z"]
TEXTS = [
    (1, "The quick brown fox"),
    (1, "The quick brown fox"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "▁under the mark"),
    (6, "naïve café — “quoted”… 日本語のテキスト 🙂🙂"),
    (None, "no id here"),
    (7, " ".join(f"v{i % 97}z{i}" for i in range(6000))),
    (8, "x" * 5000),
    (9, " " * 300 + "<s> and <|endoftext|>"),
    (10, "fox fox FOX the"),
    (11, "!!! ???"),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", "clash", 1, "s", {"a": 1}) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def byte_level():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


@pytest.fixture(scope="module")
def snippets():
    draw = random.Random(7)
    return ["".join(draw.choices(SNIPPETS, k=draw.randint(1, 40))) for _ in range(400)]


def test_piece_ids_equal_the_library(library, snippets):
    ids, bounds = pieces.PieceIds(pieces.default_path()).encode(pieces.spaced(pa.array([*snippets, None, ""])))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [*library.encode(snippets), [], []]


def test_every_prefix_has_the_count_of_the_library(library, snippets):
    steps, bounds = pieces.PrefixCounts(pieces.default_path()).encode(pieces.spaced(pa.array(snippets)))
    for text, a, b in zip(snippets[:150], bounds[:-1], bounds[1:], strict=False):
        assert np.cumsum(steps[a:b])[1:].tolist() == [len(library.encode(text[:n])) for n in range(1, len(text) + 1)]


def test_small_caches_change_nothing(library, snippets, monkeypatch):
    from cairn.llm import tokens

    monkeypatch.setattr(tokens, "KEPT", 20)
    monkeypatch.setattr(pieces, "BLOCK", 7)
    monkeypatch.setattr(pieces.PrefixCounts, "PAIRS", 50)
    made, counted = pieces.PieceIds(pieces.default_path()), pieces.PrefixCounts(pieces.default_path())
    for k in range(0, 200, 50):
        column = pieces.spaced(pa.array(snippets[k : k + 50]))
        want = library.encode(snippets[k : k + 50])
        ids, bounds = made.encode(column)
        steps, ends = counted.encode(column)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == want
        assert [int(steps[a:b].sum()) for a, b in zip(ends[:-1], ends[1:], strict=True)] == list(map(len, want))


@pytest.mark.parametrize("back", [3, 4096])
def test_counts_answer_without_encoding(spark, edge, empty, library, tmp_path, back):
    path = str(tmp_path / f"prefixes{back}")
    op12_counts.write_prefixes(edge, path)
    stored = op12_counts.read_prefixes(spark, path)
    got = op12_counts.totals(stored, 30).collect()
    texts = [(i, t or "") for i, t in TEXTS]
    fits = lambda t, most: max((n for n in range(len(t) + 1) if len(library.encode(t[:n])) <= most), default=0)
    key = lambda r: (str(r[0]), *r[1:])
    want = [(i, len(t.encode()), len(t), len(library.encode(t))) for i, t in texts]
    assert sorted([(r.doc_id, r.n_bytes, r.n_chars, r.n_tokens) for r in got], key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 30) for r in got)
    short = {i: t for i, t in texts if len(t) < 400}
    assert {r.doc_id: r.fit_chars for r in got if r.doc_id in short} == {i: fits(t, 30) for i, t in short.items()}
    at = op12_counts.count_at(stored, F.col("n_chars") - back).collect()
    assert sorted([(r.doc_id, r.n_tokens) for r in at], key=key) == sorted([(i, len(library.encode(t[: max(0, len(t) - back)]))) for i, t in texts], key=key)
    long = next(r for r in op12_counts.longest_prefix(stored, F.lit(9000)).collect() if r.doc_id == 7)
    text = dict(TEXTS)[7]
    assert len(library.encode(text[: long.fit_chars])) <= 9000 < len(library.encode(text[: long.fit_chars + 1])) or long.fit_chars == len(text)
    op12_counts.write_prefixes(empty, str(tmp_path / f"none{back}"))
    assert op12_counts.totals(op12_counts.read_prefixes(spark, str(tmp_path / f"none{back}"))).count() == 0


def test_counts_of_the_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op12_counts.op12_token_counts(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}


def brute_links(texts, byte_level, library):
    out, counts = [], Counter()
    for doc_id, text in texts:
        spelt = []
        if text:
            a, b = byte_level.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
            spelt = [
                [(k, op11_alignment.byte_level(byte_level.id_to_token(k))) for k in a],
                [(k, bytes([int(library.id_to_piece(k)[1:-1], 16)]) if library.is_byte(k) else library.id_to_piece(k).replace("▁", " ").encode()) for k in b],
            ]
        if not text or any(b"".join(s for _, s in side) != (" " + text).encode() for side in spelt):
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        places = []
        for side in spelt:
            ends = np.cumsum([len(s) for _, s in side]).tolist()
            places.append([(k, e - len(s), e) for (k, s), e in zip(side, ends, strict=True)])
        common = sorted({e for *_, e in places[0]} & {e for *_, e in places[1]})
        links, groups, begin = [], [], 0
        for end in common:
            own = [[p for p in side if begin < p[2] <= end] for side in places] if len(text) < 400 else None
            if own is None:
                break
            groups.append("|".join(",".join(str(p[0]) for p in side) for side in own))
            begin = end
        j = 0
        for k, a, b in places[0]:
            while places[1][j][2] <= a:
                j += 1
            i = j
            while i < len(places[1]) and places[1][i][1] < b:
                links.append((k, places[1][i][0]))
                i += 1
        counts.update(links)
        out.append((doc_id, len(places[0]), len(places[1]), len(common), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if len(text) < 400 else None))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(i, a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest) for i, a, b, g, links, digest in out], counts


FIGURES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def agree(got, want):
    key = lambda r: (str(r[0]), *r[1:7])
    rows = sorted([tuple(r[c] for c in FIGURES) for r in got], key=key)
    want = sorted(want, key=key)
    assert len(rows) == len(want)
    for r, w in zip(rows, want, strict=True):
        assert r[:7] == w[:7]
        assert w[7] is None or r[7] == w[7]


def test_alignment_equals_brute_force(spark, edge, empty, byte_level, library, snippets):
    texts = [*TEXTS, *((100 + k, t) for k, t in enumerate(snippets))]
    docs = edge.unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(snippets)], "doc_id long, text string"), allowMissingColumns=True)
    aligned = op11_alignment.align(docs)
    counts = op11_alignment.Counts(aligned)
    want, pairs = brute_links(texts, byte_level, library)
    agree(op11_alignment.document_links(aligned, counts).collect(), want)
    assert {(r.a_id, r.b_id): r.n for r in counts.table().collect()} == dict(pairs)
    aligned = op11_alignment.align(empty)
    assert op11_alignment.document_links(aligned, op11_alignment.Counts(aligned)).count() == 0


def test_alignment_of_the_table_over_several_chunks(spark, byte_level, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    aligned = op11_alignment.align(docs.repartition(5))
    assert aligned.count() == 5
    want, _ = brute_links([tuple(r) for r in docs.collect()], byte_level, library)
    agree(op11_alignment.document_links(aligned, op11_alignment.Counts(aligned)).collect(), want)


def brute_ranks(docs, items, most=10):
    terms = lambda t: [w.translate({k: k + 32 for k in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    held = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in own if c[w])
            if score > 0:
                scored.append((-score, i is not None, i or 0))
        out += [(item, rank, i if known else None, -score) for rank, (score, known, i) in enumerate(sorted(scored)[:most], 1)]
    return out


def ranks(index, items, **kw):
    return sorted([tuple(r) for r in op13_ranked_search.search(index, items, **kw).select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.mark.parametrize("shard", [1, 40, 8 << 20])
def test_ranks_equal_brute_force(spark, edge, empty, shard):
    items = [(1, "fox the"), (2, None), (3, ""), (4, "quick quick brown nowhere"), (None, "id"), (5, "v1z1 v2z2 v3z3 the"), (6, "fox"), (6, "under"), (7, "!!!")]
    asked = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, rank string")
    batches = edge.select(F.col("doc_id"), "text").toArrow().to_batches()
    old, op13_ranked_search.SHARD = op13_ranked_search.SHARD, shard
    try:  # shards of any size, made here, as workers have the module's own value
        made = [b for b in op13_ranked_search._index(iter(batches))]
    finally:
        op13_ranked_search.SHARD = old
    index = spark.createDataFrame(pa.Table.from_batches(made))
    assert ranks(index, asked) == sorted(brute_ranks(TEXTS, items), key=str)
    assert ranks(op13_ranked_search.build_index(edge), asked, most=2) == sorted(brute_ranks(TEXTS, items, 2), key=str)
    assert ranks(op13_ranked_search.build_index(empty), asked) == []
    assert ranks(index, asked.limit(0)) == []


def test_accumulators_stop_and_scores_stay_exact(spark):
    draw = random.Random(3)
    docs = [(k, " ".join(draw.choices(["a", "b", "c", "d", "e"], [60, 25, 9, 4, 2], k=draw.randint(1, 60)))) for k in range(600)]
    docs += [(k, docs[k % 600][1]) for k in range(600, 700)]  # ties
    items = [(k, " ".join(draw.sample(["a", "b", "c", "d", "e", "none"], draw.randint(1, 6)))) for k in range(40)]
    index = op13_ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    asked = spark.createDataFrame(items, "item_id long, text string")
    for most in (1, 10):
        assert ranks(index, asked, most=most) == sorted(brute_ranks(docs, items, most), key=str)
    # rare term: full lists; common term: only those that have an accumulator
    best = op13_ranked_search.Best(1)
    lists = [(np.array([3]), np.array([50])), (np.arange(10), np.full(10, 7))]
    found, score = op13_ranked_search._accumulate(lists, [50, 7], best, 10)
    assert found.tolist() == [3] and score.tolist() == [57]
    found, _ = op13_ranked_search._accumulate([lists[0], (np.arange(10), np.full(10, 50))], [50, 50], best, 10)
    assert len(found) == 10  # an equal score can still win by its id


def test_items_in_blocks(spark, edge, monkeypatch):
    items = [(k, t) for k, t in enumerate(["fox the", "quick", "naïve café", "id here", "x", "v1z1"] * 3)]
    asked = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(op13_ranked_search, "BLOCK_CHARS", 30)
    textkit.bounded_batches(spark)
    assert ranks(op13_ranked_search.build_index(edge), asked) == sorted(brute_ranks(TEXTS, items), key=str)
