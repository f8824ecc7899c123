"""Hard negatives, token counts and spelling variants against brute force on small tables with awkward rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordlens.llm import one_bit_negatives, queries, spelling_variants, token_cache

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# ------------------------------------------------------------------ hard negatives
def negatives_by_hand(rows, every=50):
    """anchor, positive, rank, negative, both scores of rows (id, label, vector)."""
    held = {}
    for key, label, v in rows:
        if None not in (key, label, v) and v and all(x is not None and math.isfinite(x) for x in v):
            held[key] = min(held.get(key, (label, v)), (label, v))
    held = {k: (label, [math.floor(256 * x) for x in v]) for k, (label, v) in held.items()}
    out = set()
    for a in (k for k in held if k % every == 0):
        label, v = held[a]
        scored = sorted((-sum(x * y for x, y in zip(v, w)), k, own == label) for k, (own, w) in held.items()
                        if k != a and len(w) == len(v))
        for p_score, p, _ in [s for s in scored if s[2]][:5]:
            fit = [(s, k) for s, k, same in scored if not same and -50 * p_score <= -100 * s <= -95 * p_score]
            out |= {(a, p, r + 1, k, -p_score, -s) for r, (s, k) in enumerate(fit[:3])}
    return out


def vectors(rng, n, size):
    centres = rng.normal(size=(6, size))
    rows = [(i, int(rng.integers(0, 3)), (centres[rng.integers(0, 6)] + 0.5 * rng.normal(size=size)).tolist()) for i in range(n)]
    return rows + [(n + i, rows[i][1], rows[i % 5][2]) for i in range(60)]  # ties


@pytest.mark.parametrize("block", [64, 4096])
def test_hard_negatives_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(one_bit_negatives, "ROWS", block)
    monkeypatch.setattr(one_bit_negatives, "ANCHORS", 3 if block == 64 else 4096)
    rng = np.random.default_rng(3)
    rows = vectors(rng, 340, 10)
    rows += [(1000, 1, None), (1050, None, rows[0][2]), (1100, 1, [None] * 10), (1150, 1, [float("nan")] * 10),
             (1200, 1, [float("inf")] + [0.0] * 9), (None, 1, rows[0][2]), (1250, 1, []), (1300, 1, [0.0] * 10),
             (1350, 7, rows[3][2]), (1400, 1, [1.0, 2.0]), (1401, 1, [1.0, 1.0]), (1402, 2, [0.7, 0.8]),
             (50, 2, rows[7][2]), (50, 2, rows[7][2]), (-50, 0, rows[9][2])]
    frame = spark.createDataFrame([r + ("x", 1, "y") for r in rows],
                                  "vec_id long, label int, embedding array<double>, block string, score int, known string")
    got = [tuple(r) for r in one_bit_negatives.hard_negatives(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == negatives_by_hand(rows)
    assert one_bit_negatives.hard_negatives(frame.limit(0)).count() == 0


def test_hard_negatives_of_large_components(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=4) * 10.0 ** rng.choice([0, 5])]) for i in range(80)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in one_bit_negatives.hard_negatives(frame).collect()} == negatives_by_hand(rows)
    huge = spark.createDataFrame([(i, i % 2, [1e300 * (i - 20), 1.0]) for i in range(60)], frame.schema)
    assert one_bit_negatives.hard_negatives(huge).count() >= 0


def test_intervals_hold_the_scores_and_prune():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 64))
    v = centres[rng.integers(0, 40, 4000)] + 0.3 * rng.normal(size=(4000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = one_bit_negatives.Block(np.arange(4000), rng.integers(0, 5, 4000), one_bit_negatives.integers(v))
    anchors = rows.slice(0, 100)
    planes = one_bit_negatives.Planes(anchors.values)
    low, high = one_bit_negatives.intervals(planes, rows.codes)
    exact = one_bit_negatives.products(anchors.values, rows.values)
    assert (low <= exact).all() and (exact <= high).all()
    search = one_bit_negatives.Search(anchors, one_bit_negatives.Places())
    search.add(rows)
    assert search.scored < 0.3 * search.seen
    for i in range(100):
        mine = np.flatnonzero((rows.labels == anchors.labels[i]) & (rows.ids != i))
        best = mine[np.lexsort((mine, -exact[i, mine]))[:5]]
        assert search.found[i][0][1].tolist() == best.tolist()


# ------------------------------------------------------------------ token counts
def odd_texts():
    rnd = random.Random(17)
    letters = ("abcXYZİßΣςÉéi̇K.,;:!?'-   \t\n\x1c09<|>中\U0001f600")
    texts = [None, "", "   ", "Word word WORD", "word   word\n word ", "a <|endoftext|>b <|ENDOFTEXT|>", "<|endoftext|>" * 3,
             "BELGESİ, ÜNİVERSİTESİ.", "x " * 30_000, "Long" * 20_000]
    return texts + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 40))) for _ in range(800)]


def test_token_counts_equal_the_tokenizer(spark, tmp_path):
    texts = odd_texts()
    rows = [(i, t, 7, "c", 1) for i, t in enumerate(texts)] + [(None, texts[3], 7, "c", 1), (3, texts[3], 7, "c", 1)]
    rows += [(10_000 + i, "the same text", 7, "c", 1) for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, content string, n int").repartition(5)
    own, cache = Tokenizer.from_file(WORD_BPE), str(tmp_path / "cache")
    want = Counter((i, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows)
    got = token_cache.token_counts(frame, WORD_BPE, cache).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) and r.content == "c" for r in got)
    assert sum(r.over_limit for r in got) == sum(n for (_, _, k), n in want.items() if k > 2048) >= 2


def test_only_distinct_misses_are_encoded(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = [(i, f"text number {i % 7}") for i in range(50)] + [(99, "TEXT   number 0 ")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    first = token_cache.token_counts(frame, WORD_BPE, cache).orderBy("doc_id").collect()
    held = spark.read.parquet(cache)
    assert held.count() == 7 and held.select("content").distinct().count() == 7
    assert token_cache.token_counts(frame, WORD_BPE, cache).orderBy("doc_id").collect() == first
    assert spark.read.parquet(cache).count() == 7
    more = frame.unionByName(spark.createDataFrame([(100, "something new")], frame.schema))
    assert token_cache.token_counts(more, WORD_BPE, cache).count() == 52
    assert spark.read.parquet(cache).count() == 8
    # Another tokenizer has counts of its own, of the texts as they are.
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces)
    got = token_cache.token_counts(frame, pieces, cache).collect()
    assert {(r.doc_id, r.n_tokens) for r in got} == {(i, len(own.encode(t))) for i, t in rows}
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2
    assert token_cache.token_counts(frame.limit(0), WORD_BPE, str(tmp_path / "none")).count() == 0


def test_stored_counts_are_used(spark, tmp_path):
    cache, version = str(tmp_path / "cache"), token_cache.version_digest(WORD_BPE)
    frame = spark.createDataFrame([(1, "some words"), (2, "other words")], "doc_id long, text string")
    stored = frame.where("doc_id = 1").select(F.lit(version).alias("tokenizer"), F.sha2("text", 256).alias("content"),
                                             F.lit(77).cast("long").alias("n_tokens"))
    stored.unionByName(stored).write.parquet(cache)
    got = {r.doc_id: r.n_tokens for r in token_cache.token_counts(frame, WORD_BPE, cache).collect()}
    assert got[1] == 77 and got[2] == 2


# ------------------------------------------------------------------ spelling variants
def near_by_hand(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def words_by_hand(rows):
    import re

    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def groups_by_hand(words):
    near = {w: [v for v in words if near_by_hand(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: b if b and words[b] >= 5 * words[w] else None for w, b in best.items()}
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def variant_rows(rng):
    stems = ["abstract", "éléphant", "straßenbahn", "counting", "aaaaaa", "aaaaaaa", "recounting", "prefix" * 4]
    rows = []
    for i in range(160):
        words = []
        for _ in range(60):
            w = str(rng.choice(stems, p=[0.3, 0.2, 0.1, 0.2, 0.05, 0.05, 0.05, 0.05]))
            for _ in range(int(rng.choice([0, 1, 2], p=[0.8, 0.15, 0.05]))):
                at, new = int(rng.integers(0, len(w) + 1)), str(rng.choice(list("aeét")))
                w = [w[:at] + new + w[at:], w[:at] + w[at + 1:], w[:at] + new + w[at + 1:]][int(rng.integers(0, 3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, "  ".join(words) + ". Éléphant İstanbul 4567"))
    return rows + [(None, rows[0][1]), (3, rows[3][1]), (900, None), (901, ""), (902, "x" * 50_000)]


@pytest.mark.parametrize("block_words", [4, 64, 2048])
def test_spelling_groups_equal_brute_force(spark, block_words):
    rows = variant_rows(np.random.default_rng(19))
    frame = spark.createDataFrame([r + ("w", 1) for r in rows], "doc_id long, text string, word string, n int")
    words = spelling_variants.vocabulary(frame)
    want = words_by_hand(rows)
    assert {r.word: r.n for r in words.collect()} == want and len(want) > 80
    got = [tuple(r) for r in spelling_variants.spelling_groups(words, block_words=block_words).collect()]
    assert len(got) == len(want) and set(got) == groups_by_hand(want)


def test_spelling_chains_ties_and_none(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "cccccc": 7, "cccccd": 35, "ccccce": 35, "zzzzzzz": 9}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert {tuple(r) for r in spelling_variants.spelling_groups(frame).collect()} == groups_by_hand(words)
    assert spelling_variants.spelling_groups(frame.limit(0)).count() == 0


def test_position_index_equals_comparison():
    rng = np.random.default_rng(23)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(5, 9))) for _ in range(300)})
    for size in range(5, 9):
        x, y = spelling_variants.block_pairs(words, size, 0, size)
        want = {frozenset((a, b)) for a in words for b in words if near_by_hand(a, b) and min(len(a), len(b)) == size}
        got = [frozenset((words[i], words[j])) for i, j in zip(x.tolist(), y.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_new_queries_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    got = {tuple(r) for r in queries.op13_spelling_variants(spark, sf).collect()}
    assert got == groups_by_hand(words_by_hand(rows))
    own = Tokenizer.from_file(WORD_BPE)
    assert {(r.doc_id, r.n_tokens) for r in queries.op12_token_cache(spark, sf).collect()} == {
        (i, len(own.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
