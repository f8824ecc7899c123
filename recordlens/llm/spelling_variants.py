"""Spelling variants: words of a corpus tied to a much commoner word one letter away.

Words are runs of Latin letters, lower-cased A-Z only, counted over whole texts by built-in functions. Words
that differ by exactly one inserted, deleted or replaced letter are near. A word's form is its near word of the
largest count, if that is at least ``ratio`` times its own; following forms leads to its root.

Near words are found by a bit-sliced position index. A block of words has one bitset for each (position,
letter), bit k telling whether word k has the letter there. All words of a block are read letter by letter,
and 64 words of the index at a time follow the recurrences: the words that agree so far (zero errors), and
those that agree but for one error, kept apart by the shift the error left: replaced (same position) or passed
over in the longer word (one position on). The shorter word of a pair is the one read, so no shift goes back.

Blocks come from the words alone. A class holds the pairs whose shorter word has a given length; if it is large, the place of
the error is halved: pairs with the error in one half agree in the rest, and blocks are dealt by a hash of
the rest, into as many as their size asks for. Blocks that are still large (a common stem) are halved again, down to one letter,
where alphabet and length bound them. A pair counts in the one block whose part holds its first difference, so
blocks give per word the number of near words and the best, and these are added up; pairs are never rows.

Defined results: null texts have no words. A null id reads as an empty one in the rule that deletes letters.
Rows of equal ids count as often as they are there. Ties of count go to the smallest word in code-point order.
An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.session import cut

LETTERS = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LETTERS, LEAST_USES = 6, 5
RATIO = 5
BLOCK_WORDS = 2048
MISSPELT_EVERY = 199
MOST_CHAIN = 64


def vocabulary(documents: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
               least_uses: int = LEAST_USES, every: int | None = MISSPELT_EVERY) -> DataFrame:
    """word, n of the words with enough letters and uses.

    ``every`` deletes one letter where it divides the CRC-32 of ``<id>:<word>``; None leaves words as they are.
    """
    runs = documents.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(
        F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_letters)
    if every is not None:
        code = F.crc32(F.concat_ws(":", "key", "run").cast("binary"))
        place = F.pmod(code, F.length("run").cast("long")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
        runs = runs.select(F.when(code % every == 0, shorter).otherwise(F.col("run")).alias("run"))
    counted = runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_letters) & (F.col("n") >= least_uses))


class PositionIndex:
    """Bitsets over a block's words: one for each (position, letter) and each length."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words])
        self.width = -(-len(words) // 64)
        longest = int(self.lengths.max())
        letters = np.frombuffer("".join(w.ljust(longest, "\0") for w in words).encode("utf-32-le"), "<u4")
        alphabet, codes = np.unique(letters.reshape(len(words), longest), return_inverse=True)
        self.codes = codes.reshape(len(words), longest)
        self.full = self.bits(np.ones(len(words), bool))
        # The last row, of zeros, stands for the place behind the longest word.
        self.at = np.zeros((longest + 1, len(alphabet), self.width), np.uint64)
        for place in range(longest):
            for code in np.unique(self.codes[:, place]).tolist():
                if alphabet[code]:
                    self.at[place, code] = self.bits(self.codes[:, place] == code)

    def bits(self, which: np.ndarray) -> np.ndarray:
        held = np.zeros(self.width * 64, bool)
        held[:len(which)] = which
        return np.packbits(held, bitorder="little").view(np.uint64)

    def near(self, read: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word read, word) of the pairs one error apart; the words read (indexes) have one length.

        Only words at least as long as those read are told.
        """
        length = int(self.lengths[read[0]])
        codes = self.codes[read]
        zero = np.tile(self.full, (len(read), 1))
        replaced = np.zeros_like(zero)
        fewer = np.zeros_like(zero)
        for i in range(length):
            letter = codes[:, i]
            here, ahead = self.at[i][letter], self.at[i + 1][letter]
            # One letter of the word was passed over, now or before; it stands one place on.
            fewer = (fewer | zero) & ahead
            replaced = (replaced & here) | (zero & ~here)
            zero = zero & here
        same = self.bits(self.lengths == length)
        longer = self.bits(self.lengths == length + 1)
        found = (replaced & same) | ((fewer | zero) & longer)
        bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")
        x, y = np.nonzero(bits[:, :len(self.lengths)])
        return read[x], y

    def first_difference(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common beginning of each pair."""
        longest = self.codes.shape[1]
        out = np.empty(len(x), np.int64)
        for a in range(0, len(x), 100_000):
            differs = self.codes[x[a:a + 100_000]] != self.codes[y[a:a + 100_000]]
            out[a:a + 100_000] = np.where(differs.any(1), differs.argmax(1), longest)
        return out


def block_pairs(words: list[str], size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of a block: the shorter word has ``size`` letters, the first difference lies from low to high - 1."""
    index = PositionIndex(words)
    short = np.flatnonzero(index.lengths == size)
    if not len(short):
        return short, short
    found = [index.near(short[a:a + 256]) for a in range(0, len(short), 256)]
    x, y = (np.concatenate(c) for c in zip(*found))
    first = index.first_difference(x, y)
    # Behind the last letter belongs to the last part.
    own = (first >= low) & ((first < high) | ((high == size) & (first == size)))
    x, y = x[own], y[own]
    # Words of one length meet from both sides.
    once = (index.lengths[y] > size) | (x < y)
    return x[once], y[once]


def block_near(block: pd.DataFrame) -> pd.DataFrame:
    """word, n_near, best: the number of near words in the block and the best of them."""
    words, n = block["word"].tolist(), block["n"].to_numpy(np.int64)
    x, y = block_pairs(words, *(int(block[c].iloc[0]) for c in ("size", "low", "high")))
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=lambda i: (-n[i], words[i]))] = np.arange(len(words))
    order = np.lexsort((rank[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]]))
    names = np.array(words, dtype=object)
    return pd.DataFrame({"word": pd.Series(names[x[first]], dtype=object), "n_near": np.diff(np.append(first, len(x))),
                         "near": pd.Series(names[y[first]], dtype=object), "near_n": n[y[first]]})


def halves(rows: DataFrame) -> DataFrame:
    """Every row once for each half of its part (low to high - 1), which lies in letters of the shorter word."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    parts = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    return rows.withColumn("_part", F.explode(parts)).withColumns({"low": F.col("_part.low"), "high": F.col("_part.high")}).drop("_part")


def dealt_blocks(words: DataFrame, block_words: int) -> DataFrame:
    """word, n, size, low, high, block: every near pair is in the block of the part that holds its first difference."""
    length = F.length("word")
    rows = words.withColumn("size", F.explode(F.array(length, length - 1))).withColumns(
        {"low": F.lit(0), "high": F.col("size"), "block": F.lit(0).cast("long")})
    place, ready = ["size", "low", "high", "block"], None
    names = ["word", "n", *place]
    rows = rows.select(*names)
    while True:
        sizes = cut(rows.groupBy(*place).agg(
            F.count("*").alias("held"), F.count(F.when(F.length("word") == F.col("size"), 1)).alias("read")), "word-blocks")
        # Parts are dealt by their size, so there are some hundreds of times fewer blocks than rows.
        large = sizes.where(f"held > {block_words} AND high - low > 1 AND read > 0")
        whole = sizes.where(f"read > 0 AND held > 1 AND (held <= {block_words} OR high - low = 1)")
        small = rows.join(F.broadcast(whole), place)
        ready = small.select(*names) if ready is None else ready.unionByName(small.select(*names))
        if large.isEmpty():
            return ready
        # What lies outside the part is equal in both words of a pair; its hash deals the block further.
        rest = F.concat_ws("\n", F.col("block").cast("string"), F.substring("word", F.lit(1), F.col("low")),
                           F.substring("word", F.length("word") - F.col("size") + F.col("high") + 1, F.length("word")))
        parts = F.ceil(F.col("held") / (block_words / 2)).cast("long")
        more = halves(rows.join(F.broadcast(large), place))
        number = F.xxhash64("block", F.pmod(F.xxhash64(rest), parts))
        rows = cut(more.withColumn("block", number).select(*names), "word-parts")


def near_words(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, n_near, near, near_n: the number of near words, and the best of them with its count."""
    blocks = dealt_blocks(words, block_words)
    found = blocks.groupBy("size", "low", "high", "block").applyInPandas(
        block_near, "word string, n_near long, near string, near_n long")
    return found.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def with_roots(forms: DataFrame) -> DataFrame:
    """word, form (null for none) with root; paths double in each round, each a stored table.

    A form has more uses than its word, so paths are short and never close.
    """
    state = cut(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    rounds = 0
    while True:
        ahead = state.where("word <> root").select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        moved = cut(state.join(ahead, F.col("root") == F.col("_w"), "left").select(
            "word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")), "roots")
        state, rounds = moved.select("word", "root"), rounds + 1
        if moved.where("moved").isEmpty():
            return state
        if rounds > MOST_CHAIN:
            raise RuntimeError("forms do not end")


def spelling_groups(words: DataFrame, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n)."""
    words = cut(words.select("word", "n"), "words")
    near = near_words(words, block_words).withColumnRenamed("word", "_word")
    common = F.col("near_n") >= ratio * F.col("n")
    rows = cut(words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(common, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(common, F.col("near_n")).alias("form_n")), "forms")
    roots = with_roots(rows).withColumnRenamed("word", "_word")
    return rows.join(roots, F.col("word") == F.col("_word")).select("word", "form", "root", "n", "n_near", "form_n")
