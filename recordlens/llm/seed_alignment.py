"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of the passages they hit.

Words are runs of letters and digits (A-Z as a-z). The seeds of a test item are all its ``SEED`` word n-grams,
so whether a copy is found does not depend on other documents. A passage around seeds of an item, one seed being
enough, reaches as far as any alignment of the least score can (``reach``) and is aligned with the item word by
word (match 2, mismatch -1, gap -1), unless it holds so few of the item's words that none could reach the limit. The score is
the best local alignment over that of a perfect copy; from ``SCORE`` on the document is contaminated.
Edited, shortened and paraphrased copies keep enough matching words, common phrases do not.

Test items are taken in blocks of ``BLOCK_ITEMS``, each block of bounded size with its own passes over the
documents; documents are never shuffled, each finds its passages where it lies.

Defined results: null and empty texts, and items of fewer than ``SEED`` words, match nothing. A null
item_id stays null in the matches. Repeated rows are judged alike. All columns of the documents stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.hashing import NO_LETTERS, all_shingles, slices, word_hashes

SEED = 3
SCORE = 0.5
BLOCK_ITEMS = 20_000
MATCHES = "array<struct<item_id:long,score:double,first_word:long,last_word:long>>"


class Items:
    """Words and seeds of a block of test items; ``seeds`` is sorted, with postings (item, place)."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids = ids
        self.words, self.begins = word_hashes([t if isinstance(t, str) else "" for t in texts], NO_LETTERS)
        grams, at = all_shingles(self.words, self.begins, SEED)
        item = np.searchsorted(self.begins, at, side="right") - 1
        order = np.argsort(grams, kind="stable")
        self.item, self.place = item[order], (at - self.begins[item])[order]
        self.seeds, self.first = np.unique(grams[order], return_index=True)
        self.counts = np.diff(np.append(self.first, len(grams)))
        self.may = np.zeros(1 << 16, dtype=bool)
        self.may[(self.seeds >> np.uint64(48)).astype(np.int64)] = True

    def lookup(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in grams, seed) of the grams that are seeds."""
        maybe = np.flatnonzero(self.may[(grams >> np.uint64(48)).astype(np.int64)])
        if not len(self.seeds):
            return maybe[:0], maybe[:0]
        found = np.minimum(np.searchsorted(self.seeds, grams[maybe]), len(self.seeds) - 1)
        hit = self.seeds[found] == grams[maybe]
        return maybe[hit], found[hit]


def align(item: np.ndarray, passage: np.ndarray) -> float:
    """Best local alignment over the score of a perfect copy."""
    steps = np.arange(len(passage))
    above, best = np.zeros(len(passage) + 1), 0.0
    for word in item:
        row = np.maximum(above[:-1] + np.where(passage == word, 2.0, -1.0), above[1:] - 1)
        row = np.maximum(row, 0)
        row = np.maximum.accumulate(row + steps) - steps
        above[1:] = row
        best = max(best, float(row.max()))
    return best / (2 * len(item))


def reach(size: int, least: float) -> int:
    """Most words of a text that an alignment of score ``least`` with an item of ``size`` words can span.

    It has m <= size matches and costs 1 for each word between them, 2 m - extra >= 2 least size, so it spans
    at most m + extra <= 3 size - 2 least size words.
    """
    return size + max(int(2 * (1 - least) * size), 0)


def passages(items: Items, words: np.ndarray, begins: np.ndarray, least: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, end word) of the passages around seeds, words counted in the text.

    Whatever alignment of the least score holds a seed lies whole in a passage.
    """
    grams, at = all_shingles(words, begins, SEED)
    position, seed = items.lookup(grams)
    if not len(position):
        return
    position = at[position]
    repeat = items.counts[seed]
    posting = np.repeat(items.first[seed] - np.cumsum(repeat) + repeat, repeat) + np.arange(repeat.sum())
    position = np.repeat(position, repeat)
    item, place = items.item[posting], items.place[posting]
    text = np.searchsorted(begins, position, side="right") - 1
    order = np.lexsort((position, item, text))
    text, item, position, place = text[order], item[order], position[order], place[order]
    spans = np.array([reach(int(n), least) for n in np.diff(items.begins)])[item]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (np.diff(text) != 0) | (np.diff(item) != 0) | (np.diff(position) > spans[1:])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(text))
    for a, b in zip(starts, ends):
        span, base = int(spans[a]), int(begins[text[a]])
        low, high = int(position[a]) + SEED - span, int(position[b - 1]) + span
        yield int(text[a]), int(item[a]), max(low - base, 0), min(high, int(begins[text[a] + 1])) - base


def find(items: Items, texts: list[str], least: float) -> list[list[tuple]]:
    """Matches (item id, score, first word, last word) of each text, the best per item."""
    words, begins = word_hashes(texts, NO_LETTERS)
    best: list[dict[int, tuple]] = [{} for _ in texts]
    for text, item, first, end in passages(items, words, begins, least):
        passage = words[begins[text] + first:begins[text] + end]
        wanted = items.words[items.begins[item]:items.begins[item + 1]]
        if np.isin(wanted, passage).mean() < least:  # a word that is not there adds nothing to a score
            continue
        score = align(wanted, passage)
        if score >= least and score > best[text].get(item, (None, 0.0))[1]:
            best[text][item] = (items.ids[item], score, first, end - 1)
    return [[b[i] for i in sorted(b)] for b in best]


def item_blocks(benchmark: DataFrame, key: str, text: str, block_items: int) -> Iterator[Items]:
    rows = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    blocks = -(-rows.count() // block_items)
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).orderBy("id", "text").collect()
        yield Items([r.id for r in part], [r.text for r in part])


def benchmark_matches(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", least: float = SCORE, name: str = "matches",
                      block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents with their matches in column ``name``: item id, score, first and last word of the passage."""
    spark, out = documents.sparkSession, documents.withColumn(name, F.array().cast(MATCHES))
    for items in item_blocks(benchmark, item_key, item_text, block_items):
        sent = spark.sparkContext.broadcast(items)

        @F.pandas_udf(MATCHES)
        def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([m for _, run in slices(list(texts)) for m in find(sent.value, run, least)])

        out = out.withColumn(name, F.concat(name, found(F.col(text))))
    return out
