"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its hashed character n-grams and of itself as a whole, so a
misspelling shares most of its vectors with the word it comes from. A passage is the mean of its words
(a repeated word adds nothing), and a linear softmax over two classes reads it. A text is as toxic as its most toxic passage of
``WINDOW`` words: the mean over a whole long text would drown a single insult. Training follows the same
rule: a text's loss reaches the vectors through its most toxic passage.

Labels come from at most ``TRAIN_ROWS`` labelled documents of at most ``TRAIN_BYTES`` bytes each (the
smallest hashes of doc_id); scores cover every whole text.

Defined results: a null or empty text scores as an empty bag (the bias alone). Rows with a null id are
scored too. Null labels are left out; of repeated labels the largest counts. Without labels of both kinds
the score is that share (0 without any). Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.hashing import char_ngrams, slices, word_hashes

TRAIN_ROWS = 4000
TRAIN_BYTES = 32768
WINDOW = 24
DIMENSIONS = 6
BUCKETS = 1 << 17
SHIFT = np.uint64(64 - 17)
MIN_TEXTS = 5
# A missed toxic text costs as much as this many rejected clean ones.
TOXIC_WEIGHT = 2.0
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
CACHE_WORDS = 400_000


def normal_word(chunk: str) -> str:
    """Lower case without punctuation around it; punctuation alone stays."""
    return EDGE.sub("", chunk.lower()) or chunk


def repeated(words: np.ndarray, owner: np.ndarray, window: int) -> np.ndarray:
    """Whether the same word stands among the ``window`` - 1 words before in the same text."""
    order = np.argsort(words, kind="stable")
    again = np.zeros(len(words), dtype=bool)
    near = (np.diff(words[order]) == 0) & (np.diff(order) < window)
    again[order[1:]] = near & (owner[order[1:]] == owner[order[:-1]])
    return again


def passages(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and width of every passage of texts of these sizes, laid one after the other, and passages per text."""
    width = np.minimum(sizes, window)
    counts = np.where(sizes > 0, sizes - width + 1, 0)
    return ranges(np.cumsum(sizes) - sizes, counts), np.repeat(width, counts), counts


class ToxicityModel:
    """Contributions of n-grams to the toxic logit, and the bias."""

    def __init__(self, contributions: np.ndarray, bias: float, window: int = WINDOW):
        self.contributions, self.bias, self.window = contributions.astype(np.float32), bias, window
        self.forget()

    def __getstate__(self):
        return {"contributions": self.contributions, "bias": self.bias, "window": self.window}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.value = np.zeros(0)

    def learn_words(self, chunks: list[str]) -> None:
        """Numbers and values of the words that are new; all are forgotten when they become too many."""
        new = [c for c in dict.fromkeys(chunks) if c not in self.number]
        if len(self.number) + len(new) > CACHE_WORDS:
            self.forget()
            new = list(dict.fromkeys(chunks))
        values = [self.value]
        for at in range(0, len(new), 20000):
            part = new[at:at + 20000]
            rows, cols = word_features([normal_word(c) for c in part])
            value = self.contributions[cols]
            count = np.maximum(np.bincount(rows, value != 0, len(part)), 1)
            values.append(np.bincount(rows, value, len(part)) / count)
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part))))
        self.value = np.concatenate(values)

    def score(self, texts: list[str | None]) -> np.ndarray:
        split = [text.split() if isinstance(text, str) else [] for text in texts]
        chunks = list(chain.from_iterable(split))
        self.learn_words(chunks)
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        words = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        values = self.value[words]
        values[repeated(words, np.repeat(np.arange(len(split)), sizes), self.window)] = 0
        sums = np.concatenate([[0.0], np.cumsum(values)])
        starts, spans, counts = passages(sizes, self.window)
        best = np.zeros(len(texts))
        if len(starts):
            mean = (sums[starts + spans] - sums[starts]) / spans
            best[counts > 0] = np.maximum.reduceat(mean, (np.cumsum(counts) - counts)[counts > 0])
        return 1 / (1 + np.exp(-np.clip(best + self.bias, -30, 30)))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) pairs: n-grams of 3 to 5 bytes of ``<word>``, and of the whole word."""
    rows, cols = char_ngrams(words, 3, 5, BUCKETS)
    whole, _ = word_hashes([w.replace(" ", "") or "-" for w in words])
    return np.concatenate([rows, np.arange(len(words))]), np.concatenate([cols, (whole >> SHIFT).astype(np.int64)])


def common_features(words: list[str], texts_of_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, buckets in use and, per word, places among these, of the features in MIN_TEXTS texts or more."""
    texts = np.zeros(BUCKETS)
    parts = [words[at:at + 20000] for at in range(0, len(words), 20000)]
    for k, part in enumerate(parts):
        rows, cols = word_features(part)
        texts += np.bincount(cols, texts_of_word[rows + 20000 * k], BUCKETS)
    known = np.flatnonzero(texts >= MIN_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[known] = np.arange(len(known))
    out_rows, out_cols = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for k, part in enumerate(parts):
        rows, cols = word_features(part)
        kept = np.flatnonzero(place[cols] >= 0)
        kept = kept[np.argsort(rows[kept], kind="stable")]
        out_rows.append((rows[kept] + 20000 * k).astype(np.int32))
        out_cols.append(place[cols[kept]])
    return np.concatenate(out_rows), known, np.concatenate(out_cols)


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers begin[i] to begin[i] + length[i] - 1 of every i, one after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


def fit(texts: list[str], toxic: np.ndarray, steps: int = 1000, window: int = WINDOW, step: float = 0.3,
        batch: int = 64, seed: int = 7) -> ToxicityModel:
    """Joint training of n-gram embeddings and softmax weights: AdaGrad, about ``steps`` small batches of texts.

    The first two epochs read a random passage of each text, the others its most toxic one so far.
    n-grams found in fewer than ``MIN_TEXTS`` texts are left out.
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    if share in (0.0, 1.0):
        return ToxicityModel(np.zeros(BUCKETS), 30.0 if share else -30.0, window)
    chunk_words: dict[str, int] = {}
    vocabulary: dict[str, int] = {}
    bags = []
    for text in texts:
        chunks = text.split()
        for c in dict.fromkeys(chunks):
            if c not in chunk_words:
                chunk_words[c] = vocabulary.setdefault(normal_word(c), len(vocabulary))
        bags.append(np.fromiter(map(chunk_words.__getitem__, chunks), np.int64, len(chunks)))
    keep = [i for i, b in enumerate(bags) if len(b)]
    bags, toxic = [bags[i] for i in keep], np.asarray(toxic, float)[keep]
    if not bags:
        return ToxicityModel(np.zeros(BUCKETS), float(np.log(share / (1 - share))), window)
    texts_of_word = np.bincount(np.concatenate([np.unique(b) for b in bags]), minlength=len(vocabulary))
    rows, known, cols = common_features(list(vocabulary), texts_of_word)
    grams = np.bincount(rows, minlength=len(vocabulary))
    gram_begin = np.cumsum(grams) - grams
    words, sizes = np.concatenate(bags), np.array([len(b) for b in bags])
    again = repeated(words, np.repeat(np.arange(len(bags)), sizes), window)
    begin, width = np.cumsum(sizes) - sizes, np.minimum(sizes, window)
    starts, spans, counts = passages(sizes, window)
    owner = np.repeat(np.arange(len(bags)), counts)
    rng = np.random.default_rng(seed)
    vectors, memory = rng.normal(0, 0.1, (len(known), DIMENSIONS)), np.full((len(known), DIMENSIONS), 1e-4)
    weights, memory_w = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.full((DIMENSIONS, 2), 1e-4)
    bias, memory_b = np.log([1 - share, share]), np.full(2, 1e-4)
    for epoch in range(max(3, round(steps * batch / len(bags)))):
        if epoch < 2:
            first = begin + (rng.random(len(bags)) * counts).astype(np.int64)
        else:
            each = np.bincount(rows, (vectors @ (weights[:, 1] - weights[:, 0]))[cols], len(vocabulary))
            sums = np.concatenate([[0.0], np.cumsum(np.where(again, 0, (each / np.maximum(grams, 1))[words]))])
            mean = (sums[starts + spans] - sums[starts]) / spans
            hit = np.flatnonzero(mean == np.maximum.reduceat(mean, np.cumsum(counts) - counts)[owner])
            first = starts[hit[np.unique(owner[hit], return_index=True)[1]]]
        for part in np.array_split(rng.permutation(len(bags)), -(-len(bags) // batch)):
            inside = ranges(first[part], width[part])
            doc = np.repeat(np.arange(len(part)), width[part])[~again[inside]]
            taken = words[inside][~again[inside]]
            used = cols[ranges(gram_begin[taken], grams[taken])]
            doc_of = np.repeat(doc, grams[taken])
            portion = np.repeat(1 / width[part][doc] / np.maximum(grams[taken], 1), grams[taken])
            bag = np.stack([np.bincount(doc_of, vectors[used, k] * portion, len(part))
                            for k in range(DIMENSIONS)], 1)
            logits = bag @ weights + bias
            logits -= logits.max(1, keepdims=True)
            error = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
            error -= np.stack([1 - toxic[part], toxic[part]], 1)
            error *= (1 + (TOXIC_WEIGHT - 1) * toxic[part])[:, None]
            back = error @ weights.T
            distinct, place = np.unique(used, return_inverse=True)
            slope = np.stack([np.bincount(place, back[doc_of, k] * portion, len(distinct))
                              for k in range(DIMENSIONS)], 1)
            memory[distinct] += slope**2
            vectors[distinct] -= step * slope / np.sqrt(memory[distinct])
            for param, grad, past in ((weights, bag.T @ error, memory_w), (bias, error.sum(0), memory_b)):
                past += grad**2
                param -= step * grad / np.sqrt(past)
    contributions = np.zeros(BUCKETS)
    contributions[known] = vectors @ (weights[:, 1] - weights[:, 0])
    return ToxicityModel(contributions, float(bias[1] - bias[0]), window)


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS,
                    max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(doc_id, text, toxic) of the bounded training sample."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(max_rows)
    )
    texts = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return (
        texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
        .join(chosen, F.col("doc_id") == F.col("label_id"))
        .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_rows)
    )


def train(documents: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS,
          max_bytes: int = TRAIN_BYTES) -> ToxicityModel:
    """Model from the bounded sample of labelled documents, which reaches the driver."""
    rows = labelled_sample(documents, labels, max_rows, max_bytes).collect()
    return fit([r.text for r in rows], np.array([float(r.toxic > 0) for r in rows]))


def score_texts(documents: DataFrame, model: ToxicityModel, text: str = "text", name: str = "score") -> DataFrame:
    """The documents with their score between 0 and 1 in column ``name``."""
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.score(run) for _, run in slices(list(texts), 1 << 21)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return documents.withColumn(name, score(F.col(text)))
