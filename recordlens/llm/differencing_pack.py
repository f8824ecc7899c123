"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

Every document becomes its token ids and an end id. It is cut into whole windows and a rest; rests longer
than ``piece`` tokens are halved until they fit, so that a window holds several pieces. Pieces are dealt
at random to blocks of about ``BLOCK_WINDOWS`` windows. In a block each piece starts as a partial partition
(itself and empty windows); the two partitions with the largest imbalance are merged over and over, the
fullest windows of one with the emptiest of the other. If the fullest window ends above the capacity, the
number of windows rises and the differencing runs again. Blocks are independent, so the work spreads with
the data, and only their number depends on the total.

Defined results: a null or empty text has the end id alone. A null id stays null; repeated rows are packed
once each. Other columns are carried unless asked otherwise. Text that looks like a special token of the
tokenizer becomes that token, as in the tokenizer itself.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.hashing import slices
from recordlens.session import cut

WINDOW_TOKENS = 4096
PIECE_TOKENS = 1024
BLOCK_WINDOWS = 192
END_ID = 2
CACHE_CHUNKS = 300_000
# str.split() takes these for blanks, the tokenizer does not.
NO_BLANKS = "\x1c\x1d\x1e\x1f"
# A letter and punctuation up to the next blank; without the apostrophe, which takes letters, and the signs of special tokens.
CLOSED = r"""([A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])([!"#$%&()*+,./:;=?@\[\]^_`{}~-]+)(\s|$)"""
# Small letters that normalising leaves as they are.
LOWERED = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+").fullmatch


class ChunkTokenizer:
    """Token ids of whole texts, each blank-separated chunk encoded once and kept.

    Blanks separate words in this tokenizer, so a text's ids are those of its chunks in order. Special
    tokens hold no blanks. Chunks are looked up in lower case and without the punctuation that closes them; those of
    letters that normalising leaves as they are go to the tokenizer's model past those steps.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.lowered = Tokenizer(self.tokenizer.model)
        self.lowered.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.end = np.array([end_id], "<u4").tobytes()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # Two generations: what is still in use moves from the old one to the new one.
        self.chunks: dict[str, bytes] = {}
        self.old_chunks: dict[str, bytes] = {}

    def encode(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def learn_words(self, words: list[str], tokenizer) -> None:
        """Words of letters only: one call for many, cut behind the tokens that close a word."""
        for at in range(0, len(words), 4000):
            part = words[at:at + 4000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(part):
                self.chunks.update(zip(part, self.encode(part)))
                continue
            data, ends = ids.tobytes(), (ends * 4).tolist()
            self.chunks.update((word, data[begin:end]) for word, begin, end in zip(part, [0, *ends], ends))

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of these distinct chunks, which are kept."""
        if len(self.chunks) > CACHE_CHUNKS:
            self.old_chunks, self.chunks = self.chunks, {}
        held = list(map(self.chunks.get, chunks))
        missing = [i for i, data in enumerate(held) if data is None]
        simple, other = [], []
        for i in missing:
            chunk = chunks[i]
            if chunk in self.old_chunks:
                self.chunks[chunk] = self.old_chunks[chunk]
            elif LOWERED(chunk):
                simple.append(chunk)
            else:
                other.append(chunk)
        self.learn_words(simple, self.lowered)
        # Some letters become a letter and a mark when lower-cased, and a mark joins what stands behind it.
        self.learn_words([c for c in other if c.lower().isalpha()], self.tokenizer)
        other = [c for c in other if c not in self.chunks]
        self.chunks.update(zip(other, self.encode(other)))
        for i in missing:
            held[i] = self.chunks[chunks[i]]
        return held

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, the end id last."""
        odd = [any(b in t for b in NO_BLANKS) for t in texts]
        whole = pa.array(["" if o else t for t, o in zip(texts, odd)], pa.large_string())
        # Neither the case of A-Z nor a blank between a letter and what closes its chunk changes an id; special tokens
        # are told by their case.
        whole = pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole))
        whole = pc.replace_substring_regex(whole, CLOSED, r"\1 \2\3")
        split = pc.utf8_split_whitespace(whole)
        found = split.flatten().dictionary_encode()
        names = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        held = self.learn(names)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // 4
        if "" in names:  # ends of texts that begin or end with blanks
            sizes[names.index("")] = 0
            held[names.index("")] = b""
        code = found.indices.to_numpy()
        lengths = sizes[code]
        ends = np.cumsum(lengths)
        place = np.repeat((np.cumsum(sizes) - sizes)[code] - (ends - lengths), lengths) + np.arange(lengths.sum())
        data = np.frombuffer(b"".join(held), "<u4")[place].tobytes()
        behind = np.concatenate([[0], 4 * ends])[split.offsets.to_numpy()].tolist()
        return [(self.encode([t])[0] if o else data[a:b]) + self.end
                for t, o, a, b in zip(texts, odd, behind[:-1], behind[1:])]


_TOKENIZERS: dict[tuple[str, int], ChunkTokenizer] = {}


def tokenizer_at(path: str, end_id: int) -> ChunkTokenizer:
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = ChunkTokenizer(path, end_id)
    return _TOKENIZERS[path, end_id]


def free_name(name: str, taken: list[str]) -> str:
    """The name, longer by underscores where a column has it already."""
    while name in taken:
        name += "_"
    return name


def piece_lengths(total: int, window: int = WINDOW_TOKENS, piece: int = PIECE_TOKENS) -> list[int]:
    """Whole windows, then the rest in equal parts of at most ``piece`` tokens."""
    whole, rest = divmod(total, window)
    parts = -(-rest // piece)
    return [window] * whole + [rest // parts + (k < rest % parts) for k in range(parts)]


def tokenized(documents: DataFrame, path: str, text: str = "text", end_id: int = END_ID,
              window: int = WINDOW_TOKENS, piece: int = PIECE_TOKENS) -> DataFrame:
    """The documents' other columns and, per piece, start, length, doc_tokens and ids (little-endian binary)."""
    @F.pandas_udf("array<struct<start:long,length:long,doc_tokens:long,ids:binary>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = tokenizer_at(path, end_id)
        for texts in batches:
            out = []
            for _, run in slices(list(texts)):
                for data in tokenizer.ids(run):
                    total, start, rows = len(data) // 4, 0, []
                    for n in piece_lengths(total, window, piece):
                        rows.append((start, n, total, data[4 * start:4 * (start + n)]))
                        start += n
                    out.append(rows)
            yield pd.Series(out)

    others = [c for c in documents.columns if c not in (text, "start", "length", "doc_tokens", "ids")]
    name = free_name("piece", others)
    found = documents.select(*others, F.explode(pieces(F.col(text))).alias(name))
    return found.select(*others, *[F.col(name)[c].alias(c) for c in ("start", "length", "doc_tokens", "ids")])


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, int]:
    """(window of each item, fullest window's load) by the largest differencing method."""
    heads = np.full(windows, -1)
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, size in enumerate(sizes):
        loads, own = np.zeros(windows, np.int64), heads.copy()
        loads[0], own[0] = size, i
        heap.append((-int(size), i, loads, own))
    heapq.heapify(heap)
    left, right, made = {}, {}, len(sizes)
    while len(heap) > 1:
        _, _, loads_a, heads_a = heapq.heappop(heap)
        _, turn, loads_b, heads_b = heapq.heappop(heap)
        loads, other = loads_a + loads_b[::-1], heads_b[::-1]
        merged = np.where(heads_a < 0, other, heads_a)
        both = np.flatnonzero((heads_a >= 0) & (other >= 0))
        for k in both.tolist():
            left[made], right[made] = int(heads_a[k]), int(other[k])
            merged[k] = made
            made += 1
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        loads -= loads[-1]
        heapq.heappush(heap, (-int(loads[0]), turn, loads, merged[order]))
    place = np.zeros(len(sizes), np.int64)
    totals = np.zeros(windows, np.int64)
    for window, head in enumerate(heap[0][3].tolist() if heap else []):
        stack = [head] if head >= 0 else []
        while stack:
            node = stack.pop()
            if node < len(sizes):
                place[node] = window
                totals[window] += sizes[node]
            else:
                stack += (left[node], right[node])
    return place, int(totals.max()) if len(totals) else 0


def balanced(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; more windows as long as the fullest exceeds the capacity."""
    place = np.zeros(len(sizes), np.int64)
    whole = np.flatnonzero(sizes >= capacity)
    place[whole] = np.arange(len(whole))
    rest = np.flatnonzero(sizes < capacity)
    if len(rest):
        windows = -(-int(sizes[rest].sum()) // capacity)
        while True:
            found, fullest = differencing(sizes[rest].tolist(), windows)
            if fullest <= capacity:
                break
            windows += 1
        place[rest] = len(whole) + found
    return place


def packed(pieces: DataFrame, window: int = WINDOW_TOKENS, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Stored pieces (a table with a column length) with sequence_id and offset in the sequence."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (window * block_windows)))
    name = free_name("block", [*pieces.columns, "sequence_id", "offset"])
    dealt = pieces.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    schema = pieces.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def pack(block: pd.DataFrame) -> pd.DataFrame:
        number = int(block[name].iloc[0])
        sizes = block["length"].to_numpy()
        place = balanced(sizes, window)
        order = np.argsort(place, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[True], np.diff(place[order]) > 0])
        offset = np.empty(len(sizes), np.int64)
        begins = ends - sizes[order]
        offset[order] = begins - np.maximum.accumulate(np.where(first, begins, 0))
        return block.drop(columns=name).assign(sequence_id=(number << 32) + place, offset=offset)

    return dealt.groupBy(name).applyInPandas(pack, schema)


def pack_documents(documents: DataFrame, path: str, text: str = "text", end_id: int = END_ID,
                   window: int = WINDOW_TOKENS) -> DataFrame:
    """Pieces with their ids and places: the other columns, start, length, doc_tokens, ids, sequence_id, offset."""
    return packed(cut(tokenized(documents, path, text, end_id, window), "pieces"), window)
