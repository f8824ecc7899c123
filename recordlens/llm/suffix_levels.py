"""Suffix dedup: a logarithmic family of suffix-array levels finds 50-byte strings of earlier documents.

A byte goes when a 50-byte string over it also starts in a document with a smaller id. All strings are
judged on the input, documents are UTF-8 bytes, matches stay inside documents.

Of all suffixes a sparse set is kept: every window of 50 bytes chooses its least 16-gram by hash as anchor, so
equal windows choose the same one, and one byte in 18 carries a suffix. Documents are dealt to runs, the
batches of the index. A run's anchors, and its longer content-defined units, are sorted by fingerprint (the
sparse suffix array) and cut into key ranges; each range is a partition that takes the batches one after the
other: a new batch is merge-scanned against the existing levels, its new keys become a level, and levels of
like size merge geometrically. Every run gets back which of its keys other documents hold.

Units that an earlier document holds are covered as they are. For the other windows whose anchor is shared,
the run sends the bytes around the anchor, once per distinct stretch, to the range of the anchor; there the
windows' full suffix array goes through such a family again, and the run learns the smallest document of
each window. A passage in a third of all documents so costs one stretch per run, not one per document.
Windows and units are compared by 128 bits of fingerprint.

The documents are shuffled once, by run, and read three times from that shuffle.

Defined results: a null text has no bytes. A document without an id keeps all bytes and takes none from
others; rows of equal id take nothing from each other. An empty table gives an empty one. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.hashing import BASE, BYTE_CODES, mix

MATCH = 50
GRAM = 16
RUN_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
UNIT_MASK = np.uint64(15)
PLACE = np.uint64((1 << 24) - 1)
GATHER = 200_000  # entries that are sorted or asked at once
WINDOWS_A_SIZE = 5  # windows of a stretch for each byte of its 4-byte size, about
OTHER_CODES = mix(BYTE_CODES)
RESPONSE = "run long, kind int, part long, keys binary, low binary, high binary"


def run_prints(codes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of the ``size`` codes from each place, put together from runs of 1, 2, 4, ... codes."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts = [(1, codes, np.array([BASE]))]
    while parts[-1][0] * 2 <= size:
        width, value, power = parts[-1]
        parts.append((2 * width, value[:-width] * power + value[width:], power * power))
    out, done = np.zeros(n, np.uint64), 0
    for width, value, power in reversed(parts):
        if size & width:
            out, done = out * power + value[done:done + n], done + width
    return mix(out)


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)


class Stretch:
    """Windows of some pieces of documents, grouped by the anchor they choose.

    Per group: doc (index in the run), start (in the document), at (in data), count of windows, key of the
    anchor and unit. Units are runs of groups up to an anchor whose key ends in zero bits.
    """

    def __init__(self, pieces: list[tuple[int, int, bytes]]):
        self.data = b"".join(p[2] for p in pieces)
        data = np.frombuffer(self.data, np.uint8)
        sizes = np.array([len(p[2]) for p in pieces])
        begin = np.cumsum(sizes) - sizes
        counts = np.maximum(sizes - MATCH + 1, 0)
        starts = ranges(begin, counts)
        piece = np.repeat(np.arange(len(pieces)), counts)
        if not len(starts):
            self.doc = self.start = self.at = self.count = self.unit = np.zeros(0, np.int64)
            self.key, self.unit_first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        grams = run_prints(BYTE_CODES[data], GRAM)
        least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        width, span = 1, MATCH - GRAM + 1
        while width * 2 <= span:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        least = np.minimum(least[:len(least) - span + width], least[span - width:])
        anchor = (least[starts] & PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(piece) != 0)]))
        owner = piece[first]
        self.at, self.count = starts[first], np.diff(np.append(first, len(starts)))
        self.doc = np.array([p[0] for p in pieces])[owner]
        self.start = np.array([p[1] for p in pieces])[owner] + self.at - begin[owner]
        # Anchors are least grams, so their hashes lie low; hashed again they spread over all key ranges.
        self.key = mix(grams[anchor[first]]) & ~np.uint64(1)
        opens = ((self.key >> np.uint64(1)) & UNIT_MASK) == 0
        opens[0] = True
        opens[1:] |= np.diff(owner) != 0
        self.unit_first = np.flatnonzero(opens)
        self.unit = np.cumsum(opens) - 1

    def unit_prints(self) -> tuple[np.ndarray, np.ndarray]:
        """Key and tag of each unit's bytes, 128 bits in all; its key is odd, where anchors' keys are even."""
        last = np.append(self.unit_first[1:], len(self.at)) - 1
        begin = self.at[self.unit_first].tolist()
        end = (self.at[last] + self.count[last] + MATCH - 1).tolist() if len(last) else []
        digest = b"".join(hashlib.blake2b(self.data[a:b], digest_size=16).digest() for a, b in zip(begin, end))
        both = np.frombuffer(digest, np.uint64).reshape(-1, 2)
        return both[:, 0] | np.uint64(1), both[:, 1]


def stretches(bodies: list[bytes]) -> Iterator[Stretch]:
    """All windows of the documents, in runs of pieces of about PIECE_BYTES."""
    group, size = [], 0
    for doc, body in enumerate(bodies):
        for offset in range(0, max(len(body) - MATCH + 1, 0), PIECE_BYTES):
            piece = body[offset:offset + PIECE_BYTES + MATCH - 1]
            if group and size + len(piece) > PIECE_BYTES + MATCH:
                yield Stretch(group)
                group, size = [], 0
            group.append((doc, offset, piece))
            size += len(piece)
    if group:
        yield Stretch(group)


def in_level(keys: np.ndarray, tags: np.ndarray, key: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of (key, tag) in a level sorted by key, and which of them are there."""
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    hit = (keys[at] == key) & (tags[at] == tag)
    look = np.flatnonzero((keys[at] == key) & ~hit)
    while len(look):  # equal keys of different tags lie side by side
        at[look] += 1
        look = look[at[look] < len(keys)]
        look = look[keys[at[look]] == key[look]]
        found = tags[at[look]] == tag[look]
        hit[look[found]] = True
        look = look[~found]
    return at, hit


class LevelFamily:
    """Sorted levels of (key, tag, smallest and largest document), each key and tag in one level."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, key: np.ndarray, tag: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Sorts the batch, scans it against the levels and files what is new."""
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        if ((key[order[1:]] == key[order[:-1]]) & (tag[order[1:]] != tag[order[:-1]])).any():
            order = np.lexsort((tag, key))
        key, tag = key[order], tag[order]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])]))
        low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
        key, tag = key[first], tag[first]
        for keys, tags, lows, highs in self.levels:
            at, hit = in_level(keys, tags, key, tag)
            lows[at[hit]] = np.minimum(lows[at[hit]], low[hit])
            highs[at[hit]] = np.maximum(highs[at[hit]], high[hit])
            key, tag, low, high = key[~hit], tag[~hit], low[~hit], high[~hit]
        if len(key):
            self.levels.append((key, tag, low, high))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            merged = [np.concatenate(c) for c in zip(self.levels.pop(), self.levels.pop())]
            order = np.argsort(merged[0], kind="stable")
            self.levels.append(tuple(c[order] for c in merged))

    def find(self, key: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest document of each key and tag; both 0 for unknown ones."""
        low, high = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for keys, tags, lows, highs in self.levels:
            at, hit = in_level(keys, tags, key, tag)
            low[hit], high[hit] = lows[at[hit]], highs[at[hit]]
        return low, high


def parts_of(key: np.ndarray, parts: int) -> np.ndarray:
    """The key range of each key, of as many equal ones."""
    return (((key >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def run_documents(group: pd.DataFrame) -> tuple[np.ndarray, list[bytes]]:
    """Ids and bodies of a run's documents with an id, in an order that does not depend on the shuffle."""
    group = group[group["id"].notna()]
    rows = sorted(zip(group["id"].astype("int64"), (t.encode("utf-8", "surrogatepass") for t in group["text"])))
    return np.array([r[0] for r in rows], np.int64), [r[1] for r in rows]


def key_batches(group: pd.DataFrame, parts: int) -> pd.DataFrame:
    """The run's distinct keys with their smallest and largest document, and the tags of the units, cut by part."""
    ids, bodies = run_documents(group)
    keys, tags, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for s in stretches(bodies):
        unit, tag = s.unit_prints()
        keys += [s.key, unit]
        tags += [np.zeros(len(s.key), np.uint64), tag]
        docs += [ids[s.doc], ids[s.doc[s.unit_first]]]
    key, tag, doc = np.concatenate(keys), np.concatenate(tags), np.concatenate(docs)
    # Documents come by id and no unit has the key of an anchor, so those of one key stay in order.
    order = np.argsort(key, kind="stable")
    key, tag, doc = key[order], tag[order], doc[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
    last = np.append(first[1:], len(key)) - 1
    # A second entry only where the largest document differs.
    both = np.sort(np.concatenate([first, last[doc[first] != doc[last]]]))
    key, tag, doc = key[both], tag[both], doc[both]
    part = parts_of(key, parts)
    at = np.flatnonzero(np.concatenate([np.ones(min(len(part), 1), bool), part[1:] != part[:-1]]))
    ends = np.append(at[1:], len(part))
    unit = (key & np.uint64(1)).astype(bool)
    return pd.DataFrame({"part": part[at], "run": group["run"].iloc[0] if len(group) else 0,
                         "keys": [key[a:b].tobytes() for a, b in zip(at, ends)],
                         "tags": [tag[a:b][unit[a:b]].tobytes() for a, b in zip(at, ends)],
                         "docs": [doc[a:b].tobytes() for a, b in zip(at, ends)]})


def by_part(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
    """The rows of each part, one part after the other."""
    rows: list = []
    for batch in batches:
        for row in batch.itertuples(index=False):
            if rows and row.part != rows[0].part:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def gathered(rows: list, size) -> Iterator[list]:
    """The rows in groups of about GATHER entries."""
    group, held = [], 0
    for row in rows:
        group.append(row)
        held += size(row)
        if held > GATHER:
            yield group
            group, held = [], 0
    if group:
        yield group


def answer_rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["run", "kind", "part", "keys", "low", "high"])


def batch_keys(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Keys of some batches and their tags, 0 for anchors."""
    key = np.frombuffer(b"".join(r.keys for r in rows), np.uint64)
    tag = np.zeros(len(key), np.uint64)
    tag[(key & np.uint64(1)).astype(bool)] = np.frombuffer(b"".join(r.tags for r in rows), np.uint64)
    return key, tag


def shared_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each run the keys that several documents hold, with the smallest and largest of them."""
    for rows in by_part(batches):
        index = LevelFamily()
        for some in gathered(rows, lambda r: len(r.keys) // 8):
            doc = np.frombuffer(b"".join(r.docs for r in some), np.int64)
            index.add(*batch_keys(some), doc, doc)
        for some in gathered(rows, lambda r: len(r.keys) // 8):
            key, tag = batch_keys(some)
            low, high = index.find(key, tag)
            run = np.repeat(np.arange(len(some)), [len(r.keys) // 8 for r in some])
            # A run sends a key twice where its documents differ, and wants it once.
            held = low != high
            held[1:] &= (key[1:] != key[:-1]) | (run[1:] != run[:-1])
            key, low, high = key[held], low[held], high[held]
            cuts = np.searchsorted(run[held], np.arange(len(some) + 1)).tolist()
            yield answer_rows([(r.run, 0, r.part, key[a:b].tobytes(), low[a:b].tobytes(), high[a:b].tobytes())
                               for r, a, b in zip(some, cuts, cuts[1:]) if b > a])


class Shared:
    """A run's shared keys and their smallest documents."""

    def __init__(self, answers: pd.DataFrame):
        own = answers[answers["kind"] == 0]
        key = np.frombuffer(b"".join(own["keys"]), np.uint64)
        order = np.argsort(key)
        self.key, self.low = key[order], np.frombuffer(b"".join(own["low"]), np.int64)[order]

    def lows(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is shared, smallest document) of each key."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return hit, np.where(hit, self.low[at], 0)


class OpenStretches:
    """What is left of a run after its shared units: distinct stretches of bytes around shared anchors."""

    def __init__(self, ids: np.ndarray, bodies: list[bytes], shared: Shared, parts: int):
        self.number: dict[tuple[int, bytes], int] = {}  # (part, bytes) -> number in the part
        self.count: dict[int, int] = {}
        self.low: list[int] = []
        self.high: list[int] = []
        self.uses: list[tuple[int, int, int, int]] = []  # doc, start, part, number
        self.spans: list[np.ndarray] = []  # rows of doc, start, end that shared units cover
        self.order: list[tuple[int, bytes]] = []
        for s in stretches(bodies):
            hit, low = shared.lows(s.unit_prints()[0])
            earlier = hit & (low < ids[s.doc[s.unit_first]])
            covered = earlier[s.unit]
            self.spans.append(np.stack([s.doc[covered], s.start[covered],
                                        s.start[covered] + s.count[covered] + MATCH - 1], 1))
            mine = np.flatnonzero(~covered & shared.lows(s.key)[0])
            part = parts_of(s.key[mine], parts).tolist()
            for p, doc, start, at, n in zip(part, s.doc[mine].tolist(), s.start[mine].tolist(), s.at[mine].tolist(),
                                            s.count[mine].tolist()):
                own = (p, s.data[at:at + n + MATCH - 1])
                number = self.number.get(own)
                if number is None:
                    number = self.number[own] = len(self.order)
                    self.order.append(own)
                    self.low.append(int(ids[doc]))
                    self.high.append(int(ids[doc]))
                else:
                    self.low[number] = min(self.low[number], int(ids[doc]))
                    self.high[number] = max(self.high[number], int(ids[doc]))
                self.uses.append((doc, start, p, number))

    def by_part(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {}
        for number, (part, _) in enumerate(self.order):
            out.setdefault(part, []).append(number)
        return out


def stretch_batches(run: int, found: OpenStretches) -> pd.DataFrame:
    """The distinct stretches of a run by part: their packed bytes, lengths, smallest and largest documents."""
    rows = []
    for part, numbers in found.by_part().items():
        bodies = [found.order[k][1] for k in numbers]
        rows.append((part, run, zlib.compress(b"".join(bodies), 1), np.array([len(b) for b in bodies], np.int32).tobytes(),
                     np.array([found.low[k] for k in numbers], np.int64).tobytes(),
                     np.array([found.high[k] for k in numbers], np.int64).tobytes()))
    return pd.DataFrame(rows, columns=["part", "run", "data", "sizes", "low", "high"])


def stretch_windows(rows: list) -> tuple[np.ndarray, ...]:
    """key, tag, stretch and offset of every window of some batches; stretches are numbered through."""
    data = np.frombuffer(b"".join(zlib.decompress(r.data) for r in rows), np.uint8)
    sizes = np.frombuffer(b"".join(r.sizes for r in rows), np.int32).astype(np.int64)
    counts = sizes - MATCH + 1
    at = ranges(np.cumsum(sizes) - sizes, counts)
    stretch = np.repeat(np.arange(len(sizes)), counts)
    offset = at - (np.cumsum(sizes) - sizes)[stretch]
    return run_prints(BYTE_CODES[data], MATCH)[at], run_prints(OTHER_CODES[data], MATCH)[at], stretch, offset


def window_answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each run the windows that a document before its largest one holds: stretch, from, to, smallest document."""
    for rows in by_part(batches):
        index, asked = LevelFamily(), []
        for some in gathered(rows, lambda r: len(r.sizes) * WINDOWS_A_SIZE):
            key, tag, stretch, offset = stretch_windows(some)
            low, high = (np.frombuffer(b"".join(c), np.int64) for c in zip(*((r.low, r.high) for r in some)))
            index.add(key, tag, low[stretch], high[stretch])
            asked.append((some, key, tag, stretch.astype(np.int32), offset.astype(np.int32)))
        while asked:
            some, key, tag, stretch, offset = asked.pop()
            low, _ = index.find(key, tag)
            held = low < np.frombuffer(b"".join(r.high for r in some), np.int64)[stretch]
            stretch, offset, low = stretch[held].astype(np.int64), offset[held].astype(np.int64), low[held]
            if not len(low):
                continue
            first = np.flatnonzero(np.concatenate([[True], (np.diff(stretch) != 0) | (np.diff(offset) != 1) |
                                                   (np.diff(low) != 0)]))
            last = offset[np.append(first[1:], len(low)) - 1]
            stretch, offset, low = stretch[first], offset[first], low[first]
            begin = np.cumsum([0, *[len(r.sizes) // 4 for r in some]])
            cuts = np.searchsorted(stretch, begin).tolist()
            yield answer_rows([(r.run, 1, r.part, np.stack([stretch[a:b] - own, offset[a:b]], 1).tobytes(),
                                low[a:b].tobytes(), last[a:b].tobytes())
                               for r, own, a, b in zip(some, begin.tolist(), cuts, cuts[1:]) if b > a])


def covered_spans(ids: np.ndarray, bodies: list[bytes], answers: pd.DataFrame, parts: int) -> np.ndarray:
    """Rows of doc, start, end (bytes) to remove, overlapping."""
    found = OpenStretches(ids, bodies, Shared(answers), parts)
    windows: dict[int, list[tuple[int, int, int]]] = {}  # stretch -> from, to, smallest document
    numbers = found.by_part()
    for row in answers[answers["kind"] == 1].itertuples(index=False):
        own = numbers[row.part]
        pairs = np.frombuffer(row.keys, np.int64).reshape(-1, 2)
        for (stretch, a), low, b in zip(pairs.tolist(), np.frombuffer(row.low, np.int64).tolist(),
                                        np.frombuffer(row.high, np.int64).tolist()):
            windows.setdefault(own[stretch], []).append((a, b, low))
    extra = [(doc, start + a, start + b + MATCH) for doc, start, _, number in found.uses
             for a, b, low in windows.get(number, ()) if low < ids[doc]]
    return np.concatenate([*found.spans, np.array(extra, np.int64).reshape(-1, 3)])


def remaining(body: bytes, spans: np.ndarray) -> tuple[bytes, int]:
    """What is left of a body without the spans (start, end), and the number of removed runs."""
    if not len(spans):
        return body, 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    opens = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    begin, end = spans[opens, 0], reach[np.append(np.flatnonzero(opens)[1:], len(spans)) - 1]
    edges = np.stack([np.concatenate([[0], end]), np.concatenate([begin, [len(body)]])], 1)
    return b"".join(body[a:b] for a, b in edges.tolist()), len(begin)


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every document."""
    return run_result(documents, key, text, run_bytes, "kept binary",
                      lambda kept: {"kept": kept})


def repeat_digest(documents: DataFrame, key: str = "doc_id", text: str = "text", run_bytes: int = RUN_BYTES) -> DataFrame:
    """As remove_repeats with kept_sha256, the digest of the remaining bytes, in their place."""
    return run_result(documents, key, text, run_bytes, "kept_sha256 string",
                      lambda kept: {"kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})


def run_result(documents: DataFrame, key: str, text: str, run_bytes: int, last: str, finish) -> DataFrame:
    spark = documents.sparkSession
    rows = documents.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    runs = max(1, math.ceil(total / run_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), runs)
    # A run is a batch of the index: bounded, and the same in all three readings.
    dealt = rows.withColumn("run", F.pmod(F.xxhash64("id", "text"), F.lit(runs))).repartition(runs, "run")

    def send_keys(group: pd.DataFrame) -> pd.DataFrame:
        return key_batches(group, parts)

    def send_stretches(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame([], columns=["part", "run", "data", "sizes", "low", "high"])
        ids, bodies = run_documents(group)
        return stretch_batches(int(group["run"].iloc[0]), OpenStretches(ids, bodies, Shared(answers), parts))

    def result(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        ids, bodies = run_documents(group)
        spans = covered_spans(ids, bodies, answers, parts)
        spans = spans[np.argsort(spans[:, 0], kind="stable")]
        cuts = np.searchsorted(spans[:, 0], np.arange(len(ids) + 1))
        left = [remaining(b, spans[x:y, 1:]) for b, x, y in zip(bodies, cuts[:-1], cuts[1:])]
        without = [t.encode("utf-8", "surrogatepass") for t in group.loc[group["id"].isna(), "text"]]
        bodies, left = bodies + without, left + [(b, 0) for b in without]
        names = pd.array([*ids.tolist(), *[None] * len(without)], dtype="Int64")
        return pd.DataFrame({key: names, "n_bytes": [len(b) for b in bodies],
                             "n_removed": [len(b) - len(k) for b, (k, _) in zip(bodies, left)],
                             "n_spans": [n for _, n in left], **finish([k for k, _ in left])})

    sent = dealt.groupBy("run").applyInPandas(send_keys, "part long, run long, keys binary, tags binary, docs binary")
    answers = sent.repartition(parts, "part").sortWithinPartitions("part", "run").mapInPandas(shared_keys, RESPONSE)
    answers = answers.repartition(runs, "run")
    stretched = dealt.groupBy("run").cogroup(answers.groupBy("run")).applyInPandas(
        send_stretches, "part long, run long, data binary, sizes binary, low binary, high binary")
    windows = stretched.repartition(parts, "part").sortWithinPartitions("part", "run").mapInPandas(window_answers, RESPONSE)
    # Both kinds of answers lie by run, so their union needs no exchange and the first kind is found once.
    windows = windows.repartition(runs, "run")
    return dealt.groupBy("run").cogroup(answers.unionByName(windows).groupBy("run")).applyInPandas(
        result, f"{key} long, n_bytes long, n_removed long, n_spans long, {last}")
