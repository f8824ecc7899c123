"""Secrets, archives, toxicity, URLs, packing: fixed rules by brute force, round trips and held-out accuracy."""

import gzip
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordlens.llm import (
    differencing_pack,
    hashing,
    queries,
    secret_battery,
    toxicity_subwords,
    url_ngrams,
    warc_revisits,
)

SF = "/root/testdata/sf0.01"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Secrets

HEX = "0f3a9c27b65d8e14"
SECRETS = [
    f'password = "abcdefghijkl" and PassWd:xyz {HEX}',
    "apiKey=abc.def.ghi=jkl api_key: short",
    "AKIAABCDEFGHIJKLMN AKIAshort AKIAABCDEFGHIJKLM",
    f"token: {HEX}{HEX} é {HEX} ñ secret=ABCDEFGHIJKLM",
    "ſecret=abcdefghijklm toKen=abcdefghijklm password   =\t'abcdefghijklm",
    "password=abc token=abcdefghijklmnop",
]


def plain_spans(text):
    text, found = text or "", []
    rules = [
        (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|"""
         r"""[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16)]
    for rank, (rule, group, least) in enumerate(rules):
        found += [(m.start(), rank, m.end()) for m in re.finditer(rule, text) if len(m[group]) >= least]
    return sorted(found)


def test_fixed_spans_and_edge_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(SECRETS)] + [(20, None, "x"), (21, "", "x"), (None, SECRETS[0], "x"),
                                                          (0, SECRETS[0], "x"), (22, "a" * 300_000 + " " + HEX, "x")]
    data = frame(spark, rows, "doc_id long, text string, spans string")
    got = {}
    for r in secret_battery.find_secrets(data).withColumn("all", secret_battery.spans_text(F.col("spans"))).collect():
        got.setdefault(r.doc_id, set()).add((r.n_assign, r.n_access, r.n_hex, r.base_sha256, r["all"]))
    for i, text, _ in rows:
        spans = plain_spans(text)
        joined = ",".join(f"{secret_battery.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        counts = [sum(k == n for _, k, _ in spans) for n in range(3)]
        assert got[i] == {(*counts, hashlib.sha256(joined.encode()).hexdigest(), joined)}
    assert secret_battery.find_secrets(data.limit(0)).count() == 0


def test_random_keys_are_found_among_words(spark):
    rng = np.random.default_rng(4)
    letters = np.array(list("etaoinshrdlcumwfgypb"))
    symbols = np.array(list(secret_battery.ALPHABETS[4][1]))

    def word(n):
        return "".join(rng.choice(letters, n, p=np.arange(20, 0, -1) / 210))

    keys = ["".join(rng.choice(symbols[:62], n)) for n in rng.integers(32, 60, 40)]
    rows = [(i, " ".join([word(n) for n in rng.integers(20, 45, 30)] + [word(24) + "-" + word(9)]) + " " + keys[i])
            for i in range(40)]
    found = secret_battery.find_secrets(frame(spark, rows, "doc_id long, text string")).collect()
    hits = {r.doc_id: {rows[r.doc_id][1][s.start:s.end] for s in r.spans if s.kind == "random"} for r in found}
    caught = sum(keys[i] in hits[i] for i in range(40))
    false = sum(len(h - {keys[i]}) for i, h in hits.items())
    assert caught >= 36 and false <= 0.1 * caught


def test_random_keys_are_found_without_long_words(spark):
    rng = np.random.default_rng(6)
    symbols = np.array(list(secret_battery.ALPHABETS[4][1]))
    keys = ["".join(rng.choice(symbols[:62], 48)) for _ in range(40)]
    plain = "The quick brown fox jumps over the lazy dog, and nobody saw where it went."
    rows = [(i, f"{plain} {key} {plain}") for i, key in enumerate(keys)]
    for some in (rows[:1], rows[:7], rows):
        found = secret_battery.find_secrets(frame(spark, some, "doc_id long, text string")).collect()
        caught = sum([rows[r.doc_id][1][s.start:s.end] for s in r.spans] == [keys[r.doc_id]] for r in found)
        assert caught >= 0.9 * len(some) and all(len(r.spans) <= 1 for r in found)
    words = [(0, f"{plain} {'thequickbrownfoxjumps'} {'nobodysawwhereitwent'}-again {plain}")]
    assert not secret_battery.find_secrets(frame(spark, words, "doc_id long, text string")).first().spans


def test_null_sample_does_not_switch_with_the_size(spark):
    """Each candidate brings its own null tokens, whether there are few ordinary long words in the table or many."""
    plain = "The quick brown fox jumps over the lazy dog, and nobody saw where it went."
    key = "Zk3v9QpLw81xTnB6yHs0RdJm47cUaEfG"
    long_words = " ".join(["thequickbrownfoxjumps", "nobodysawwhereitwent"] * 600)
    few, many = f"{plain} {key}", f"{plain} {key} {long_words}"
    for text in (few, many):
        *_, drawn = secret_battery.scan(text)
        assert len(drawn) == secret_battery.DRAWS and {int(d) // secret_battery.STEPS for d in drawn} == {secret_battery.band_of(len(key))}
    for rows in ([(0, few)], [(0, many)], [(0, few), (1, many)]):
        found = secret_battery.find_secrets(frame(spark, rows, "doc_id long, text string")).collect()
        assert all([dict(rows)[r.doc_id][s.start:s.end] for s in r.spans] == [key] for r in found)


def test_every_token_of_a_whole_text_is_tested(spark):
    """Words behind the head are drawn, keys that reach beyond a fixed span and keys of letters alone are tested."""
    plain = "The quick brown fox jumps over the lazy dog, and nobody saw where it went."
    key = "Zk3v9QpLw81xTnB6yHs0RdJm47cUaEfG"
    held = f"Zk3v9QpLw81xTnBX{HEX}yHs0RdJm47cUaEfGqXo5"
    letters = "".join(np.random.default_rng(9).choice(list("abcdefghijklmnopqrstuvwxyz"), 200))
    hexes = f"{plain} {HEX}{HEX[::-1]}"
    late = f"{'1 22 333 ' * 600}{key} {plain}"
    for text, want in ((late, {"random": key}), (f"{plain} {held}", {"hex": HEX, "random": held}),
                       (f"{plain} {letters}", {"random": letters}), (hexes, {"hex": HEX + HEX[::-1]}),
                       (f"{plain} {'internationalization' * 3} {'Donaudampfschifffahrt' * 5}", {})):
        row = secret_battery.find_secrets(frame(spark, [(0, text)], "doc_id long, text string")).first()
        assert {s.kind: text[s.start:s.end] for s in row.spans} == want


def test_battery_tells_random_from_words():
    rng = np.random.default_rng(8)
    symbols = list(secret_battery.ALPHABETS[4][1])
    scores = [secret_battery.randomness("".join(rng.choice(symbols, 40))) for _ in range(200)]
    assert np.mean(np.array(scores) > 0.01) > 0.95
    assert max(map(secret_battery.randomness, ["thequickbrownfoxjumpsoverthelazydog", "a" * 30, "abcabcabcabcabcabcabcabc"])) < 1e-4
    assert secret_battery.encoding_of("0a1b2c")[0] == "hex" and secret_battery.encoding_of("GBC234")[0] == "base32"
    assert secret_battery.encoding_of("a-b_c")[0] == "base64url" and secret_battery.encoding_of("é") is None
    assert secret_battery.cut_offs({}) == {}


# Archives

def pages(spark):
    body = "<p>" + "ü" * 60 + "</p>"
    rows = [(5, "http://a/1", body), (3, "http://a/2", body), (9, None, body), (7, "http://b\r\nx", "short"), (8, "u", "short"),
            (1, "u", None), (2, "u", ""), (4, "u", "WARC/1.1\r\n\r\n" * 20), (6, "u", "x" * 3_000_000), (3, "http://a/2", body),
            (None, "u", body), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "y" * 100), (13, "u", "y" * 100)]
    return rows, frame(spark, [r + ("z",) for r in rows], "page_id long, url string, html string, record_type string")


def test_archives_round_trip(spark, tmp_path):
    rows, data = pages(spark)
    got = warc_revisits.archive_pages(data, folder=str(tmp_path)).collect()
    assert len(got) == len(rows)
    seen = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in got))
    want, first = [], {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        origin = first.get(data) if len(data) >= 100 else None
        want.append((page_id is None, page_id or 0, len(data), "response" if origin is None else "revisit", origin))
        first.setdefault(data, page_id)
    assert seen == sorted(want, key=lambda r: (*r[:4], r[4] or 0))
    by_record = {r.record_id: r for r in got}
    for r in got:
        if r.record_type == "revisit":
            first = by_record[r.refers_to_record]
            assert first.record_type == "response" and first.payload_digest == r.payload_digest
    assert {r.payload_digest for r in got} == {hashlib.sha256((h or "").encode()).hexdigest() for _, _, h in rows}


def test_archive_files_are_warc(spark, tmp_path):
    rows, data = pages(spark)
    warc_revisits.write_archives(data, f"{tmp_path}/plain", chunk_bytes=1 << 20)
    files = sorted(tmp_path.glob("plain/part-*"))
    records = [r for f in files for r in warc_revisits.parse(gzip.decompress(f.read_bytes()))]
    bodies = sorted(block[block.index(b"\r\n\r\n") + 4:] for _, block in records)
    assert bodies == sorted((h or "").encode() for _, _, h in rows)
    assert all(f["WARC-Type"] == "response" for f, _ in records)
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(rows)
    empty = warc_revisits.archive_pages(data.limit(0), folder=f"{tmp_path}/none")
    assert empty.count() == 0


# Toxicity

def test_toxicity_query(spark):
    rows = queries.op6_toxicity_subwords(spark, SF).collect()
    assert len(rows) == 1000
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_held_out_toxicity():
    folder = "/root/testdata/sf0.1"
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    labels = [(r["doc_id"], r["toxic"]) for r in pq.read_table(f"{folder}/labels.parquet").to_pylist() if r["doc_id"] in texts]
    test = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    learn = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = toxicity_subwords.fit([texts[i] for i, _ in learn], np.array([float(y) for _, y in learn]))
    said = model.score([texts[i] for i, _ in test]) >= queries.TOXIC_SCORE
    toxic = np.array([y for _, y in test]) == 1
    assert (said == toxic).mean() >= 0.94 and (said & toxic).sum() >= 0.9 * said.sum()


def test_unseen_misspellings_and_edge_rows(spark):
    rng = np.random.default_rng(6)
    plain = [f"{a}{b}" for a in ("ba", "ko", "tri", "ulm") for b in ("ner", "sto", "vek", "lan", "pos")]
    texts, toxic = [], []
    for i in range(400):
        words = rng.choice(plain, rng.integers(5, 200)).tolist()
        if i % 4 == 0:
            words.insert(rng.integers(0, len(words)), str(rng.choice(["despicable", "horrendous"])))
        texts.append(" ".join(words))
        toxic.append(i % 4 == 0)
    model = toxicity_subwords.fit(texts, np.array(toxic, float))
    tail = " ".join(rng.choice(plain, 150))
    clean, bad, misspelt = model.score([tail, f"{tail} Despicable! {tail}", f"{tail} dispicable {tail}"])
    assert clean < 0.3 <= min(bad, misspelt)
    rows = [(1, None, 5.0), (2, "", 5.0), (None, f"despicable {tail}", 5.0), (3, "ba " * 50_000, 5.0), (3, "ba " * 50_000, 5.0)]
    scored = toxicity_subwords.score_texts(frame(spark, rows, "doc_id long, text string, score double"), model).collect()
    assert scored[0].score == scored[1].score < 0.3 <= scored[2].score and scored[3].score == scored[4].score
    assert all(0 <= r.score <= 1 for r in scored)
    assert toxicity_subwords.fit([], np.zeros(0)).score(["x"])[0] < 0.01
    assert toxicity_subwords.fit(["a", "b"], np.ones(2)).score(["x"])[0] > 0.99


def test_training_sample_is_bounded(spark):
    documents = frame(spark, [(i, "t" * (i + 1), "en") for i in range(50)] + [(None, "t", "en")], "doc_id long, text string, lang string")
    labels = frame(spark, [(i, i % 2) for i in range(50)] + [(3, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    sample = toxicity_subwords.labelled_sample(documents, labels, max_rows=20, max_bytes=40).collect()
    assert 0 < len(sample) <= 20 and all(len(r.text) <= 40 for r in sample)
    assert all(r.toxic == (1 if r.doc_id == 4 else r.doc_id % 2) for r in sample)


# URLs

URLS = [
    "http://a.example.net/en/x", "http://a.example.net/de/x", "http://EXAMPLE.NET/en/", "https://net/", "https://net", "x://net?q",
    "http://example.com/de/1?x=/fr/", "http://notexample.com/de/1", "http://x.org/fr/", "http://org/fr/1#a", "http://x.org/fr",
    "no scheme", "", None, "://net/a", "http://ÉX.NET/a", "a://b://net/", "http://x.com#/de/", "http://user@net:80/x", "http://x\n.net/a",
]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    fits = [r for r in url_ngrams.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return best and (best[0] + best[1], best[2])


def test_urls_by_rule_and_model(spark):
    data = frame(spark, [(i, u, "h") for i, u in enumerate(URLS + URLS[:2])] + [(None, URLS[0], "h")],
                 "page_id long, url string, host string")
    model = url_ngrams.train(url_ngrams.rule_labels(data))
    rows = url_ngrams.judge(data, model).collect()
    assert len(rows) == len(URLS) + 3
    for r in rows:
        url = (URLS + URLS[:2])[r.page_id] if r.page_id is not None else URLS[0]
        host, path = plain_parts(url)
        rule = plain_rule(host, path)
        said = rule[1] if rule else "block" if model.probability([host], [path])[0] >= 0.5 else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule and rule[0], said), url
    assert url_ngrams.judge(data.limit(0), model).count() == 0


def test_url_model_generalises(spark):
    rng = np.random.default_rng(1)
    hosts = [f"{'casino' if i % 2 else 'library'}{rng.integers(1000)}.example.org" for i in range(300)]
    paths = [f"/{'win' if i % 2 else 'book'}/{rng.integers(1000)}" for i in range(300)]
    labelled = frame(spark, [(f"http://{h}{p}", bool(i % 2)) for i, (h, p) in enumerate(zip(hosts[:200], paths[:200]))]
                     + [("http://x/", None)], "url string, blocked boolean")
    model = url_ngrams.train(labelled, max_rows=150)
    right = (model.probability(hosts[200:], paths[200:]) >= 0.5) == (np.arange(200, 300) % 2 == 1)
    assert right.mean() >= 0.98
    assert url_ngrams.train(labelled.limit(0)).probability(["a"], ["/"])[0] < 0.01


# Packing

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()][:120]
    texts += [None, "", "one", "a <|endoftext|> b", "x\x1cy it's 12.5 É İ", " ".join(texts[:40]), "z" * 30_000, texts[0]]
    rows = [(i if i != 5 else None, t, 7, "p", "b") for i, t in enumerate(texts)]
    data = frame(spark, rows + [(1, texts[1], 7, "p", "b")], "doc_id long, text string, length int, piece string, block string")
    pieces = differencing_pack.pack_documents(data, TOKENIZER).collect()
    whole, windows = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length > 0 and p.block == "b"
        whole.setdefault(p.doc_id, []).append((p.start, bytes(p.ids), p.doc_tokens))
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, t in enumerate(texts):
        want = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        copies = 2 if i == 1 else 1
        own = sorted(whole[i if i != 5 else None])
        assert b"".join(b for _, b, _ in own[::copies]) == want.tobytes() and {n for *_, n in own} == {len(want)}
        assert len(own) % copies == 0
    total = sum(p.length for p in pieces)
    for spans in windows.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(windows) * 4096 <= 1.05 * total + 2 * 4096
    assert differencing_pack.pack_documents(data.limit(0), TOKENIZER).count() == 0


def test_ids_equal_the_tokenizers_own():
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    chunked, own = differencing_pack.ChunkTokenizer(path), Tokenizer.from_file(path)
    rnd = random.Random(11)
    letters = ("abcXYZ\u0130\u0131\u00df\u1e9e\u03a3\u03c3\u03c2\u00c9e\u0301i\u0307K\u212a\u01c5\ufb01"
               ".,;:!?'-\u2019 \u00a0\u2028\t\n\x1c09<|>\u0660\u4e2d\U0001f600")
    texts = ["\u0130,", "BELGES\u0130, \u00dcN\u0130VERS\u0130TES\u0130.", "a <|endoftext|>b <|ENDOFTEXT|>", ""]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 30))) for _ in range(6000)]
    want = [own.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [np.frombuffer(i, "<u4").tolist() for i in chunked.ids(texts)] == want


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1000, 600)
    place, fullest = differencing_pack.differencing(sizes.tolist(), 50)
    loads = np.bincount(place, sizes, 50)
    assert loads.max() == fullest and loads.max() - loads.min() <= 20
    place = differencing_pack.balanced(sizes, 4096)
    assert np.bincount(place, sizes).max() <= 4096
    assert differencing_pack.balanced(np.array([4096, 4096, 5]), 4096).tolist() == [0, 1, 2]
    assert [sum(differencing_pack.piece_lengths(n)) for n in (1, 1025, 4096, 9000)] == [1, 1025, 4096, 9000]


def test_window_count_rises_with_the_capacity():
    place = differencing_pack.balanced(np.array([3000, 3000, 2000]), 4096)
    assert len(set(place.tolist())) == 3


def test_word_hashes():
    words, begins = hashing.word_hashes(["A b", "", "a\x0bB é"])
    assert begins.tolist() == [0, 2, 2, 5] and words[:2].tolist() == words[2:4].tolist() and len(set(words.tolist())) == 3
    assert hashing.word_hashes([])[1].tolist() == [0] and hashing.word_hashes([" \n"])[1].tolist() == [0, 0]
