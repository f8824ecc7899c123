"""The corpus pipeline stage by stage against plain versions, and its awkward rows."""

import pyarrow.parquet as pq
import pytest
from test_search import edit_at_most_one, roots, shingles

import corpus_pipeline
from recordlens.llm import differencing_pack, queries, toxicity_subwords

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, matches string, id long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "m", 1) for i, t in rows], SCHEMA)


def awkward(spark):
    lines = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    return frame(spark, [(1, None), (2, ""), (3, lines[0]["text"]), (3, lines[0]["text"]), (None, lines[0]["text"]),
                         (4, lines[1]["text"] * 30), (5, "\n"), (6, "a")])


def test_order_of_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "packing"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows_and_columns(spark, name):
    data = awkward(spark)
    out = STAGES[name](spark, data, SF)
    rows = out.collect()
    if name == "packing":
        assert {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, None}
    else:
        assert out.columns == corpus_pipeline.COLUMNS
        assert {r.doc_id for r in rows} >= {1, 2, 5, 6} and all(r.text is None or r.n_chars == len(r.text) for r in rows)
    if name in ("toxicity", "packing"):
        assert STAGES[name](spark, data.limit(0), SF).count() == 0


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(~queries.held_out())
    model = toxicity_subwords.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    keep = {i for i, s in zip(texts, model.score(list(texts.values()))) if s < queries.TOXIC_SCORE}
    first = STAGES["toxicity"](spark, docs, SF).cache()
    assert {r.doc_id for r in first.collect()} == keep

    seen, want = [], {}
    for i in sorted(keep):
        kept = []
        for line in texts[i].split("\n"):
            gone = len(line) >= 8 and any(o == line or len(o) >= 20 <= len(line) and edit_at_most_one(o, line) for o in seen)
            kept += [] if gone else [line]
            if len(line) >= 8:
                seen.append(line)
        text = "\n".join(kept)
        if text == texts[i] or text.strip(" \t\n\r"):
            want[i] = text
    second = STAGES["line_dedup"](spark, first, SF).cache()
    assert {r.doc_id: r.text for r in second.collect()} == want
    assert len(want) < len(keep)

    sets = {i: shingles(t, 5) for i, t in want.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = roots(links, sets)
    third = STAGES["near_copies"](spark, second, SF).cache()
    left = {r.doc_id for r in third.collect()}
    assert left == {i for i in label if label[i] == i}

    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    fourth = STAGES["decontamination"](spark, third, SF).cache()
    clean = {r.doc_id: r.text for r in fourth.collect()}
    whole = {i for i in left if any(item in want[i] for item in items)}
    assert not whole & clean.keys() and len(left) - len(clean) <= 3 * max(len(whole), 3)

    pieces = STAGES["packing"](spark, fourth, SF).collect()
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    tokenizer = differencing_pack.ChunkTokenizer(queries.public_tokenizers.path("word_bpe_49k.json"))
    assert tokens == {i: len(b) // 4 for i, b in zip(clean, tokenizer.ids(list(clean.values())))}


def test_run_applies_all_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert rows.count() > 0
