"""Operators that look for repeats, against brute force on small tables with awkward rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlens.llm import components, cover_tree, line_neighbourhood, partition_join, seed_alignment, suffix_levels

WORDS = [f"w{i}o{i * 7 % 13}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


def docs(spark, rows, extra="gone string, id long, line string, part long, run long, matches string"):
    """Documents with columns whose names the operators use inside."""
    blank = tuple(None for _ in extra.split(", "))
    return spark.createDataFrame([r + blank for r in rows], f"doc_id long, text string, {extra}")


def roots(links, ids):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 200), (201, 202), (202, 201)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = roots(links, {x for link in links for x in link})
    assert got == {i: c for i, c in want.items() if i != 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cover_tree_equals_all_pairs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    points = centres[rng.integers(0, 40, 700)] + rng.normal(size=(700, 16)) * rng.choice([0.02, 0.15, 0.4], (700, 1))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(np.triu(points @ points.T >= 0.95, 1)))))
    tree, found = cover_tree.CoverTree(points), []
    for x, y in cover_tree.near_pairs(tree, tree, 0.95, True):
        found += [(min(p), max(p)) for p in zip(x.tolist(), y.tolist())]
    assert len(found) == len(set(found)) and set(found) == want
    a, b, found = cover_tree.CoverTree(points[:300]), cover_tree.CoverTree(points[300:]), set()
    for x, y in cover_tree.near_pairs(a, b, 0.95, False):
        found |= set(zip(x.tolist(), (y + 300).tolist()))
    assert found == {(x, y) for x, y in want if x < 300 <= y}
    # Radii halve (what hangs below a node adds up to less than twice its own), and nets are nested.
    for level in range(cover_tree.LEVELS):
        assert a.cover[level].max() <= 2 * cover_tree.TOP_RADIUS / 2**level
        assert set(a.centres[level].tolist()) <= set(a.centres[level + 1].tolist())


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_near_vectors(spark, block_rows):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = [(i, (base[i % 6] + rng.normal(size=8) * (0.05 if i < 60 else 0.3)).tolist()) for i in range(90)]
    rows += [(100, rows[3][1]), (101, [2 * x for x in rows[3][1]]), (102, [1e200 * x for x in rows[3][1]])]
    rows += [(110, None), (111, [0.0] * 8), (112, [float("nan")] * 8), (113, [float("inf")] + [1.0] * 7),
             (114, [None] + [1.0] * 7), (115, []), (116, [1.0, 2.0]), (117, [1.0, 2.0]), (None, rows[3][1])]
    frame = spark.createDataFrame([r + (7, "x") for r in rows], "vec_id long, embedding array<double>, n long, cell string")
    got = {r.vec_id: tuple(r)[1:] for r in cover_tree.near_duplicates(frame, block_rows=block_rows).collect()}

    def good(v):
        return bool(v) and None not in v and np.isfinite(v).all() and any(v)

    usable = {i: np.array(v) / np.abs(v).max() for i, v in rows if i is not None and good(v)}
    unit = {i: v / np.linalg.norm(v) for i, v in usable.items()}
    links = [(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    label = roots(links, [i for i, _ in rows if i is not None])
    want = {i: (sum(a == i for a, _ in links), label[i], label[i] == i) for i in label}
    assert got.pop(None) == (0, None, False)
    assert got == want
    assert cover_tree.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_are_shuffled_a_fixed_number_of_times(spark, monkeypatch):
    """However many pairs of blocks there are and however many passes they take."""
    def shuffled():
        return spark._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()

    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 64))
    rows = [(i, (base[i % 60] + rng.normal(size=64) * [0.1, 0.4, 1.0][i % 3]).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(90)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before, whole = shuffled(), {tuple(r) for r in cover_tree.near_duplicates(frame).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    middle = shuffled()
    monkeypatch.setattr(cover_tree, "PASS_BYTES", 1 << 18, raising=False)
    assert {tuple(r) for r in cover_tree.near_duplicates(frame, block_rows=16).collect()} == whole
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert shuffled() - middle < 3 * (middle - before)
    assert sum(r[1] > 0 for r in whole) > 200


def edit_at_most_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def line_rows():
    rng = np.random.default_rng(11)
    base = [sentence(rng, 6) for _ in range(12)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.integers(1, 6)):
            line = str(rng.choice(base))
            kind, at = rng.integers(0, 6), rng.integers(0, len(line))
            lines.append([line, line[:at] + "é" + line[at:], line[:at] + line[at + 1:], line[:at] + "ß" + line[at + 1:],
                          sentence(rng, 5), "short"][kind])
        rows.append((i, "\n".join(lines)))
    long_line = sentence(rng, 400)
    rows += [(50, long_line), (51, long_line[:900] + "#" + long_line[901:]), (60, None), (61, ""), (62, "\n\n"), (63, "tiny\ntiny"),
             (64, "twelve chars\ntwelve chars\nTwelve chars"), (None, base[0]), (None, base[0] + "\n" + sentence(rng, 7))]
    return rows


def test_line_dedup_equals_brute_force(spark):
    rows = line_rows()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, want = [], {}
    for i, text in order:
        kept = []
        for pos, line in enumerate((text or "").split("\n")):
            place = (i is None, i or 0, pos)
            gone = len(line) >= 8 and any(p < place and (o == line or len(o) >= 20 <= len(line) and edit_at_most_one(o, line))
                                          for p, o in seen)
            seen.append((place, line))
            if not gone:
                kept.append(line)
        want.setdefault(i, []).append(("\n".join(kept), len((text or "").split("\n")),
                                       len((text or "").split("\n")) - len(kept)))
    result = line_neighbourhood.dedup_lines(docs(spark, rows))
    assert result.columns[:2] == ["doc_id", "text"] and "gone" in result.columns
    got = {}
    for r in result.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_removed))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(v[2] for vs in want.values() for v in vs) > 30


def test_line_dedup_of_repeated_rows_and_none(spark):
    text = "the same line in two rows"
    got = line_neighbourhood.dedup_lines(docs(spark, [(1, text), (1, text), (2, text)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, text), (1, text), (2, "")]
    assert line_neighbourhood.dedup_lines(docs(spark, [])).count() == 0


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_near_sets_equal_brute_force(spark, size, percent):
    rng = np.random.default_rng(size)
    rows = []
    template = sentence(rng, 40)
    for g in range(14):
        words = rng.choice(WORDS, rng.integers(8, 120)).tolist()
        for k in range(rng.integers(1, 14)):
            own = list(words)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] = str(rng.choice(WORDS))
            rows.append((len(rows), " ".join(own).upper() if k == 2 else "\n ".join(own)))
    rows += [(len(rows) + k, template + " " + sentence(rng, 12)) for k in range(25)]
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  two"), (n + 5, "É é ù"),
             (n + 6, "é é ù"), (n + 7, sentence(rng, 3000)), (0, rows[0][1]), (None, rows[0][1])]
    found = partition_join.near_sets(docs(spark, rows), size=size, percent=percent).collect()
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    label = roots(links, sets)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in found}
    assert got == {(i, len(s), label[i]) for i, s in sets.items()} | {(None, len(sets[0]), None)}
    assert len(found) == len(rows) and len(links) > 40
    if size == 4:
        assert partition_join.near_sets(docs(spark, [])).count() == 0


def test_linked_sets_share_enough_keys():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        for _ in range(300):
            members = np.unique(rng.integers(0, 2**63, int(np.exp(rng.uniform(0.7, 6)))).astype(np.uint64))
            n = len(members)
            other = np.unique(np.concatenate([
                np.delete(members, rng.choice(n, min(rng.integers(0, n // 8 + 2), n - 1), replace=False)),
                rng.integers(0, 2**63, rng.integers(0, n // 8 + 2)).astype(np.uint64)]))
            common = len(np.intersect1d(members, other))
            if common < max(n, len(other)) and 100 * common >= percent * (n + len(other) - common):
                shared = np.intersect1d(partition_join.keys_of(members, percent), partition_join.keys_of(other, percent))
                band, count = np.unique(shared & np.uint64(255), return_counts=True)
                assert any(c > partition_join.family(int(b), percent).skip for b, c in zip(band, count))


def test_key_table_splits_small_and_popular_keys():
    table, members = partition_join.KeyTable(), []
    for p in range(40):
        members.append(table.add(np.array([5, 1000 + p // 3], np.uint64), np.array([p, p], np.int64)))
    members.append(table.settle())
    found = np.concatenate(members)
    assert set(found["k"].tolist()) == {5} and sorted(set(found["p"].tolist())) == list(range(40))
    pairs = {tuple(p) for a, b in table.partners() for p in zip(a.tolist(), b.tolist())}
    assert pairs == {(a, b) for a in range(40) for b in range(a + 1, 40) if a // 3 == b // 3}


def test_common_counts():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(1, 3000)).astype(np.uint64)) for _ in range(20)]
    got = partition_join.common_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


def test_many_near_copies_at_the_threshold(spark):
    rng = np.random.default_rng(31)
    base = rng.choice(WORDS, 90).tolist()
    rows = []
    for i in range(150):  # each two words off the base: pairs of copies fall on both sides of the threshold
        own = list(base)
        for at in rng.choice(90, 2, replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    sets = {i: shingles(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = roots(links, sets)
    got = {r.doc_id: r.component_id for r in partition_join.near_sets(docs(spark, rows)).collect()}
    assert got == label and 0 < len(links) < 150 * 149 // 2


def suffix_brute(rows):
    first, out = {}, {}
    bodies = sorted((i, (t or "").encode()) for i, t in rows if i is not None)
    for i, body in bodies:
        for s in range(len(body) - 49):
            first.setdefault(body[s:s + 50], i)
    for i, body in bodies:
        covered = np.zeros(len(body), dtype=bool)
        for s in range(len(body) - 49):
            if first[body[s:s + 50]] < i:
                covered[s:s + 50] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = np.frombuffer(body, np.uint8)[~covered].tobytes()
        out.setdefault(i, []).append((len(body), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("run_bytes", [1 << 20, 3000])
def test_suffix_levels_equal_brute_force(spark, run_bytes, monkeypatch):
    rng = np.random.default_rng(17)
    passages = [sentence(rng, 20) + " ünïcode" for _ in range(8)]
    rows = []
    for i in range(60):
        parts = [str(rng.choice(passages))[rng.integers(0, 30):] if rng.random() < 0.5 else sentence(rng, rng.integers(1, 40))
                 for _ in range(rng.integers(1, 5))]
        rows.append((i, "".join(parts)))
    rows += [(70, "a" * 300), (71, "a" * 49), (72, "a" * 50), (73, "ab" * 200 + "a" * 60), (74, None), (75, ""),
             (76, rows[0][1]), (0, rows[0][1]), (3, passages[0] * 3)]
    want = suffix_brute(rows)
    frame = docs(spark, rows + [(None, passages[0]), (None, None)])
    got = {}
    for r in suffix_levels.repeat_digest(frame, run_bytes=run_bytes).collect():
        got.setdefault(r.doc_id, []).append(tuple(r)[1:])
    none = sorted(got.pop(None))
    body = passages[0].encode()
    assert none == sorted([(len(body), 0, 0, hashlib.sha256(body).hexdigest()), (0, 0, 0, hashlib.sha256(b"").hexdigest())])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert suffix_levels.remove_repeats(docs(spark, [])).count() == 0


def test_long_documents_are_cut_into_pieces_without_loss():
    rng = np.random.default_rng(1)
    body = rng.integers(97, 101, 3 * suffix_levels.PIECE_BYTES // 2, dtype=np.uint8).tobytes()
    counts = sum(int(s.count.sum()) for s in suffix_levels.stretches([body, b"x" * 49, b"y" * 50]))
    assert counts == len(body) - 49 + 1


def test_levels_keep_geometric_sizes():
    rng, family, seen = np.random.default_rng(9), suffix_levels.LevelFamily(), {}
    for doc in range(120):
        key = np.unique(rng.integers(0, 3000, 50).astype(np.uint64))
        family.add(key, key, np.full(len(key), doc), np.full(len(key), doc))
        for k in key.tolist():
            seen.setdefault(k, []).append(doc)
    sizes = [len(level[0]) for level in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sum(sizes) == len(seen)
    keys = np.array(sorted(seen), np.uint64)
    low, high = family.find(keys, keys)
    assert low.tolist() == [min(seen[k]) for k in keys.tolist()] and high.tolist() == [max(seen[k]) for k in keys.tolist()]


def test_levels_tell_equal_keys_of_different_tags_apart():
    family = suffix_levels.LevelFamily()
    for doc, (keys, tags) in enumerate([([5, 5, 7], [1, 2, 1]), ([5, 5, 7], [3, 2, 1]), ([5] * 9, range(9))]):
        family.add(np.array(keys, np.uint64), np.array(tags, np.uint64), np.full(len(keys), doc), np.full(len(keys), doc))
    low, high = family.find(np.array([5, 5, 5, 5, 5, 7, 7, 9], np.uint64), np.array([1, 2, 3, 8, 9, 1, 2, 1], np.uint64))
    assert low.tolist() == [0, 0, 1, 2, 0, 0, 0, 0] and high.tolist() == [2, 2, 2, 2, 0, 1, 0, 0]


def test_benchmark_copies_are_found_and_others_left(spark):
    rng = np.random.default_rng(23)
    items = [(i, sentence(rng, rng.integers(12, 60))) for i in range(30)]
    rows, want = [], set()
    for i in range(60):
        text, item = sentence(rng, 150), items[i % 30]
        words = item[1].split()
        if i < 30:
            want.add((i, item[0]))
            if i % 3 == 1:  # every seventh word replaced
                words = [w if k % 7 else "altered" for k, w in enumerate(words)]
            if i % 3 == 2:  # a few words left out, others put between
                words = words[:4] + ["put", "between"] + words[5:]
            text = f"{text} {' '.join(words).upper()}, {sentence(rng, 80)}"
        rows.append((i, text))
    rows += [(100, None), (101, ""), (102, " ".join(items[4][1].split()[:4])), (103, items[5][1] * 2000), (None, items[6][1]),
             (0, rows[0][1])]
    want |= {(103, 5), (None, 6)}
    benchmark = spark.createDataFrame([*items, (90, None), (91, "two words"), (None, "x y z u v w"), items[0]],
                                      "item_id long, text string")
    found = seed_alignment.benchmark_matches(docs(spark, rows), benchmark)
    got = found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.score").collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(0.5 <= r.score <= 1 for r in got) and found.count() == len(rows)
    by_block = seed_alignment.benchmark_matches(docs(spark, rows), benchmark, block_items=7)
    again = by_block.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id").collect()
    assert {tuple(r) for r in again} == want
    assert seed_alignment.benchmark_matches(docs(spark, []), benchmark).count() == 0
    nothing = seed_alignment.benchmark_matches(docs(spark, rows), benchmark.limit(0))
    assert nothing.where(F.size("matches") > 0).count() == 0


def test_copies_of_one_item_do_not_compete(spark):
    rng = np.random.default_rng(31)
    words = [f"w{i}" for i in range(40)]
    short = [f"s{i}" for i in range(7)]
    copies = {0: words, 1: [w if k % 5 else "altered" for k, w in enumerate(words)],
              2: [w if k % 5 != 3 else "other" for k, w in enumerate(words)], 3: words[:20], 4: words[20:],
              5: short, 6: short[:3] + ["other"] + short[4:6]}  # the last one holds a single seed
    rows = [(i, f"{sentence(rng, 60)} {' '.join(c)} {sentence(rng, 60)}") for i, c in copies.items()]
    benchmark = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(short))], "item_id long, text string")
    want = {i: seed_alignment.find(seed_alignment.Items([0, 1], [" ".join(words), " ".join(short)]), [text], 0.5)[0]
            for i, text in rows}
    assert {i: [m[0] for m in found] for i, found in want.items()} == {i: [int(i > 4)] for i in copies}
    assert want[1][0][1] == pytest.approx(57 / 80) and want[6][0][1] == pytest.approx(9 / 14)
    for repeats in (1, 30):
        some = rows + [(100 + i, rows[0][1]) for i in range(repeats)]
        found = seed_alignment.benchmark_matches(docs(spark, some), benchmark).where("doc_id < 100").collect()
        assert {r.doc_id: [tuple(m) for m in r.matches] for r in found} == want


def test_stretched_copies_are_found_as_by_aligning_whole_texts():
    rng = np.random.default_rng(37)
    words = [f"w{i}" for i in range(40)]
    stretched = words[:6] + [x for w in words[6:] for x in (w, "extra")]
    texts = [" ".join(stretched), " ".join(["front"] * 50 + stretched[::-1] + ["back"] * 50)]
    for _ in range(150):
        copy = []
        for w in words[rng.integers(0, 10):]:
            copy += [w] * int(rng.random() > rng.choice([0.05, 0.2, 0.4])) + ["extra"] * int(rng.poisson(rng.choice([0.1, 0.6, 1.0])))
        texts.append(" ".join([*rng.choice(WORDS, 60), *copy, *rng.choice(WORDS, 60)]))
    items = seed_alignment.Items([7], [" ".join(words)])
    grams = {" ".join(words[i:i + 3]) for i in range(38)}
    found = seed_alignment.find(items, texts, 0.5)
    want = [seed_alignment.align(items.words, seed_alignment.word_hashes([t], seed_alignment.NO_LETTERS)[0]) for t in texts]
    # 40 matches, 33 words between them
    assert want[0] == pytest.approx(47 / 80) and found[0][0][1] == pytest.approx(47 / 80)
    for text, matches, score in zip(texts, found, want):
        held = any(f" {g} " in f" {text} " for g in grams)
        assert bool(matches) == (score >= 0.5 and held)
        assert not matches or matches[0][1] == pytest.approx(score)
    assert 20 < sum(map(bool, found)) < 140


def test_alignment_scores():
    item = np.arange(10, dtype=np.uint64)
    assert seed_alignment.align(item, np.concatenate([[99, 98], item, [97]]).astype(np.uint64)) == 1.0
    assert seed_alignment.align(item, item[:5]) == 0.5
    changed = item.copy()
    changed[4] = 77
    assert seed_alignment.align(item, changed) == pytest.approx((9 * 2 - 1) / 20)
    assert seed_alignment.align(item, np.delete(item, 4)) == pytest.approx((9 * 2 - 1) / 20)
