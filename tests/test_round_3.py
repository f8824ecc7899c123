"""Work that must not be done row by row or pair by pair: names of reports, state of quiet paths, sets of a cluster."""

import numpy as np

from recordlens.bindings import registered
from recordlens.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_reports_are_read_once_for_their_tiers(spark):
    plan = registered()[0]["match_tiers"](spark, SF)._jdf.queryExecution().toString()
    assert "lineitem" not in plan and "tiers-" in plan


def test_quiet_paths_share_state(spark, tmp_path, monkeypatch):
    import datetime

    from recordlens.session import stream_session

    start = datetime.datetime(2024, 1, 1)
    rows = [(i, start + datetime.timedelta(seconds=i % 7), "change", f"p{i % 300}" if i % 300 else None) for i in range(900)]
    schema = "event_id long, timestamp timestamp, eventType string, filePath string"
    base = str(tmp_path / "out")
    for part in (rows[:500], rows[500:], [(None, start + datetime.timedelta(hours=2), "change", "z")]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = stream_session(spark).readStream.schema(schema).parquet(str(tmp_path / "in"))
        query = jobs.stream_recent_edits(stream, base, buckets=4)
        query.awaitTermination()
        state = query.lastProgress.stateOperators[0]
        assert sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress) <= 100, state
    got = {r.event_id: r.edits for r in spark.read.parquet(f"{base}/out").collect()}
    at = {i: (p, t) for i, t, _, p in rows}
    want = {i: sum(q == p and u <= t for q, u in at.values()) for i, (p, t) in at.items()}
    assert got == want


def test_edits_before_equal_brute_force():
    rng = np.random.default_rng(0)
    path, at = rng.integers(-1, 4, 300), rng.integers(0, 50, 300)
    want = [int(((path == p) & (at > t - 7) & (at <= t)).sum()) for p, t in zip(path, at)]
    assert jobs.edits_before(path, at, 7).tolist() == want


def test_sets_that_share_popular_keys_meet_at_rare_ones(spark):
    from recordlens.llm import partition_join

    rng, skip, rows = np.random.default_rng(1), 3, []
    held = {a: set(rng.choice(40, 12, replace=False).tolist()) | {100, 101} for a in range(60)}
    for a, keys in held.items():
        rows += [(a, 20, key, len(keys), skip) for key in keys]
    members = spark.createDataFrame(rows, "a long, band long, key long, many long, skip long")
    kept = {}
    for r in partition_join.rare_popular_keys(members).collect():
        kept.setdefault(r.key, set()).add(r.a)
    assert not {100, 101} & kept.keys() and sum(map(len, kept.values())) <= sum(len(k) - skip for k in held.values())
    met = {(a, b) for sets in kept.values() for a in sets for b in sets if a < b}
    assert met >= {(a, b) for a in held for b in held if a < b and len(held[a] & held[b]) > skip}


def test_near_sets_of_shared_passages(spark, monkeypatch):
    from recordlens.llm import partition_join

    rng = np.random.default_rng(2)
    word = [f"w{i}" for i in range(5000)]
    shared = list(rng.choice(word, 220))
    texts = []
    for k in range(40):  # families of a passage in common and an own end, each with three near copies
        own = list(rng.choice(word, 60))
        for _ in range(3):
            copy = shared + own
            copy[int(rng.integers(len(copy)))] = "x"
            texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i:i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert 1 < len(set(label))
    for pairs in (32, 0):
        monkeypatch.setattr(partition_join, "PAIRS_A_SET", pairs)
        got = {r.doc_id: r.component_id for r in partition_join.near_sets(frame).collect()}
        assert got == dict(enumerate(label))


def test_closed_and_lowered_chunks_keep_their_ids():
    import random
    import string

    import public_tokenizers
    from tokenizers import Tokenizer

    from recordlens.llm import differencing_pack

    path = public_tokenizers.path("word_bpe_49k.json")
    chunked, own = differencing_pack.ChunkTokenizer(path), Tokenizer.from_file(path)
    rnd = random.Random(5)
    letters = "abcStE\u00c9\u00e9\u00df\u00ff\u00d7\u00f7\u00b5\u00aa\u0130\u03a3\u030109   \n\u3000\x85\x1f" + string.punctuation * 2
    texts = ["x###", "\u0130$$$ a", "it's. a 're, <|endoftext|>. A<|endoftext|>, <|ENDOFTEXT|>", " A.\n", "\u00c9t\u00e9&&& E\u0301."]
    texts += [chr(i) + "a" + chr(i) + "b, " + chr(i) for i in range(0x20, 0x3100)]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 30))) for _ in range(20000)]
    want = [own.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in chunked.ids(texts)] == want
    learnt = []
    chunked.learn_words = lambda words, tokenizer, learn=chunked.learn_words: (learnt.extend(words), learn(words, tokenizer))
    chunked.encode = lambda parts: [learnt.append(part) for part in parts]  # no calls for single chunks
    chunked.chunks.update({".": b"", "!!": b""})
    chunked.ids(["Novelword. novelword", "novelword!! NOVELWORD"])
    assert learnt == ["novelword"]


def test_each_task_gathers_the_keys_of_one_part(spark, monkeypatch):
    from pyspark.sql import functions as F

    from recordlens.llm import partition_join

    texts = spark.range(400).select(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.hash(i * 400 + F.col("id"))), " ").alias("text"))
    runs = partition_join.key_runs(texts, "text", 4, 85, 24).cache()
    assert runs.select("part").distinct().count() == 24
    seen, deal = [], type(runs).mapInPandas
    monkeypatch.setattr(type(runs), "mapInPandas", lambda self, f, schema: seen.append(self) or deal(self, f, schema))
    partition_join.candidates(runs, 24)
    tasks = seen[0].groupBy(F.spark_partition_id()).agg(F.countDistinct("part").alias("parts")).collect()
    assert {t.parts for t in tasks} == {1} and len(tasks) == 24


def test_sorted_pairs_equal_the_records():
    from recordlens.llm import partition_join

    rng = np.random.default_rng(3)
    for size in (0, 1, 5000):
        keys, prints = rng.integers(0, 300, size).astype(np.uint64) << np.uint64(55), rng.integers(-9, 9, size)
        got = partition_join.sorted_pairs(keys, prints)
        assert list(zip(*(g.tolist() for g in got))) == sorted(set(zip(keys.tolist(), prints.tolist())))
