"""Hard negatives by rotated one-bit codes with residual intervals; what is left is scored in integers.

Every vector is rotated at random (the same for all of one length) and kept as its integers and ``CODES``
one-bit codes: the signs of the rotated vector, then those of what the codes before leave of it, each with its
stored alignment, the inner product of the unit code vector with the vector it codes. An anchor is rotated too
and quantised to ``PLANES`` bit planes, so that its product with a code vector is a sum of popcounts. Alignments
times these products estimate the score. What the estimate leaves out is bounded without chance: the residual
by Cauchy-Schwarz against the part of the anchor outside each code, the quantisation by its own length. So every score has
an interval that holds it, and only rows whose interval reaches into the wanted places are scored in integers.

Anchors, in blocks of ``ANCHORS``, meet all rows, in blocks of ``ROWS``. First each anchor keeps the best
``positives`` rows of its label; the blocks' lists are merged. Then each anchor, with its positives' scores,
keeps for each of them the best ``negatives`` rows of other labels whose score lies between ``low`` and ``high``
percent of it. A task carries the places found so far from block to block, so later blocks are cut harder.
The lists are of fixed length and merged by top-n windows.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part. Of rows
with equal ids that with the least (label, vector) counts. Vectors of different lengths have no score with each
other. Scores that a long cannot hold end at its limits. An anchor without another row of its label gives no rows, nor does a
positive without a row in its window (as with a negative score). Other columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlens.session import cut

SCALE = 256.0
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
CODES, PLANES = 6, 8
ANCHORS, ROWS, TILE = 4096, 4096, 256
BLOCKS_A_TASK = 2
EXACT = 2.0 ** 53
LONG = 2 ** 63 - 1


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def whole(x: float) -> int:
    """floor(SCALE * x), also where SCALE * x is no double any more."""
    return int(x) * int(SCALE) if abs(x) >= EXACT else math.floor(SCALE * x)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of all components, as floats where these are exact integers, else as objects."""
    if np.abs(values).max(initial=0) * SCALE >= EXACT:
        return np.array([[whole(x) for x in row] for row in values.tolist()], dtype=object)
    return np.floor(SCALE * values)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all pairs of rows, as longs."""
    if a.dtype == object or b.dtype == object:
        exact = [[max(-LONG - 1, min(LONG, sum(int(p) * int(q) for p, q in zip(x, y)))) for y in b] for x in a]
        return np.array(exact, np.int64).reshape(len(a), len(b))
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most >= EXACT:
        return products(a.astype(object), b.astype(object))
    return (a @ b.T).astype(np.int64)


def packed_signs(positive: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    bits = np.zeros((len(positive), -(-positive.shape[1] // 64) * 64), bool)
    bits[:, :positive.shape[1]] = positive
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes of a block of vectors (float rows), with alignments and what all codes leave."""

    def __init__(self, vectors: np.ndarray):
        self.size = vectors.shape[1]
        rest = vectors @ rotation(self.size)
        self.bits, self.align = [], []
        for _ in range(CODES):
            positive = rest >= 0
            align = np.abs(rest).sum(1) / math.sqrt(self.size)
            self.bits.append(packed_signs(positive))
            self.align.append(align)
            rest = rest - np.where(positive, 1.0, -1.0) * (align / math.sqrt(self.size))[:, None]
        self.left = np.linalg.norm(rest, axis=1)
        self.norm = np.linalg.norm(vectors, axis=1)


class Planes:
    """Bit planes of a block of rotated anchors: value = step * (sum of 2**b * plane b) + offset, within ``error``."""

    def __init__(self, vectors: np.ndarray):
        turned = vectors @ rotation(vectors.shape[1])
        low, high = turned.min(1), turned.max(1)
        top = 2 ** PLANES - 1
        self.step = np.where(high > low, (high - low) / top, 1.0)
        level = np.clip(np.rint((turned - low[:, None]) / self.step[:, None]), 0, top).astype(np.int64)
        self.planes = [packed_signs((level >> b) & 1 == 1) for b in range(PLANES)]
        self.offset, self.total = low, level.sum(1)
        self.error = np.linalg.norm(turned - (low[:, None] + self.step[:, None] * level), axis=1)
        self.norm = np.linalg.norm(turned, axis=1)

    def along(self, bits: np.ndarray, size: int) -> np.ndarray:
        """Products of all quantised anchors with all unit code vectors, by popcounts."""
        held = np.zeros((len(self.step), len(bits)), np.int32)
        for b, plane in enumerate(self.planes):
            for w in range(bits.shape[1]):
                held += np.bitwise_count(plane[:, w, None] & bits[None, :, w]).astype(np.int32) << b
        ups = np.bitwise_count(bits).sum(1).astype(np.int64)
        signed = self.step[:, None] * (2 * held - self.total[:, None]) + self.offset[:, None] * (2 * ups - size)[None, :]
        return signed / math.sqrt(size)


def intervals(planes: Planes, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) such that the score of each anchor with each row lies between them."""
    estimate, loose = 0.0, 0.0
    for bits, align in zip(codes.bits, codes.align):
        along = planes.along(bits, codes.size)
        estimate = estimate + along * align
        loose = loose + planes.error[:, None] * align
    # The last residual is orthogonal to the last code vector.
    across = np.maximum(np.abs(along) - planes.error[:, None], 0.0)
    outside = np.sqrt(np.maximum(planes.norm[:, None] ** 2 - across ** 2, 0.0))
    loose = loose + codes.left * outside + 1e-9 * (planes.norm[:, None] * codes.norm + 1.0)
    return estimate - loose, estimate + loose


def nth_largest(values: np.ndarray, n: int) -> np.ndarray:
    """The n-th largest of each row; minus infinity where a row is shorter."""
    if values.shape[1] < n:
        return np.full(len(values), -np.inf)
    return -np.partition(-values, n - 1, axis=1)[:, n - 1]


def best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n by higher score, then smaller id."""
    return np.lexsort((ids, ~scores))[:n]


class Block:
    """Ids, labels and integer vectors of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray):
        self.ids, self.labels, self.values = ids, labels, values
        # Beyond exact doubles there are no codes, every row is scored.
        self.codes = None if values.dtype == object else Codes(values)

    def slice(self, a: int, b: int) -> Block:
        return Block(self.ids[a:b], self.labels[a:b], self.values[a:b])


class Search:
    """Some anchors against row blocks, one after the other; ``known`` holds (id, score) of their positives."""

    def __init__(self, anchors: Block, places: Places, known: list[list[tuple[int, int]]] | None = None):
        self.anchors, self.places, self.known = anchors, places, known
        self.planes = None if anchors.codes is None else Planes(anchors.values)
        self.scored = self.seen = 0
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.found: list[dict[int, tuple[np.ndarray, np.ndarray]]] = [
            {0: none} if known is None else {key: none for key, _ in known[i]} for i in range(len(anchors.ids))]

    def add(self, rows: Block) -> None:
        if self.planes is None or rows.codes is None:
            low = np.full((len(self.anchors.ids), len(rows.ids)), -np.inf)
            high = -low
        else:
            low, high = intervals(self.planes, rows.codes)
        same = self.anchors.labels[:, None] == rows.labels
        if self.known is None:
            self.add_positives(rows, same & (self.anchors.ids[:, None] != rows.ids), low, high)
        else:
            self.add_negatives(rows, ~same, low, high)

    def keep(self, anchor: int, key: int, scores: np.ndarray, ids: np.ndarray, n: int) -> None:
        held = self.found[anchor][key]
        scores, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], ids])
        order = best(scores, ids, n)
        self.found[anchor][key] = scores[order], ids[order]

    def score(self, anchor: int, rows: Block, chosen: np.ndarray) -> np.ndarray:
        self.scored += len(chosen)
        return products(self.anchors.values[anchor:anchor + 1], rows.values[chosen])[0]

    def add_positives(self, rows: Block, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        n = self.places.positives
        self.seen += int(wanted.sum())
        floor = nth_largest(np.where(wanted, low, -np.inf), n)
        for i in range(len(floor)):
            scores = self.found[i][0][0]
            if len(scores) == n:
                floor[i] = max(floor[i], scores[-1])
        wanted = wanted & (high >= floor[:, None])
        for i in np.flatnonzero(wanted.any(1)).tolist():
            chosen = np.flatnonzero(wanted[i])
            self.keep(i, 0, self.score(i, rows, chosen), rows.ids[chosen], n)

    def add_negatives(self, rows: Block, other: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        n = self.places.negatives
        self.seen += int(other[[bool(k) for k in self.known]].sum())
        for i, known in enumerate(self.known):
            at = np.flatnonzero(other[i])
            least_low, most_high = low[i, at], high[i, at]
            wanted = np.zeros(len(at), bool)
            for key, score in known:
                # A little wider than the window, whose ends are compared in integers below.
                least = score * (self.places.low / 100) - 1e-9 * abs(score) - 1e-6
                most = score * (self.places.high / 100) + 1e-9 * abs(score) + 1e-6
                inside = least_low[(least_low >= least + 1) & (most_high <= most - 1)]
                floor = -np.partition(-inside, n - 1)[n - 1] if len(inside) >= n else -np.inf
                held = self.found[i][key][0]
                if len(held) == n:
                    floor = max(floor, float(held[-1]))
                wanted |= (most_high >= max(least, floor)) & (least_low <= most)
            chosen = at[wanted]
            if not len(chosen):
                continue
            scores = self.score(i, rows, chosen)
            exact = scores.astype(object)
            for key, score in known:
                fits = ((100 * exact >= self.places.low * score) & (100 * exact <= self.places.high * score)).astype(bool)
                if fits.any():
                    self.keep(i, key, scores[fits], rows.ids[chosen][fits], n)

    def rows(self) -> pd.DataFrame:
        out = [(int(a), key, row, score) for a, found in zip(self.anchors.ids, self.found)
               for key, (scores, ids) in found.items() for row, score in zip(ids.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "id", "score"])


@dataclass(frozen=True)
class Places:
    """How many positives and negatives are wanted, and the negatives' window in percent of the positive's score."""

    positives: int = POSITIVES
    negatives: int = NEGATIVES
    low: int = LOW
    high: int = HIGH


def usable(table: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """id, label, v (array of doubles) of the rows that take part, one per id."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v")).where(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad & (F.size("v") > 0))
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def packed(values: np.ndarray) -> tuple[str, bytes]:
    """Vectors as the narrowest integers that hold them scaled; as their doubles where none does."""
    scaled = integers(values)
    for kind in ("i2", "i4"):
        if scaled.dtype != object and np.abs(scaled).max(initial=0) < np.iinfo(kind).max:
            return kind, scaled.astype(kind).tobytes()
    return "f8", values.tobytes()


def unpacked(row) -> Block:
    values = np.frombuffer(row.v, row.kind).reshape(-1, row.dims).astype(np.float64)
    return Block(np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64),
                 integers(values) if row.kind == "f8" else values)


def blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Stored blocks of about ``size`` rows of one length: dims, block, ids, labels, kind, v, and known (positives)."""
    def gather(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("id")
        kind, v = packed(np.stack([np.asarray(x, np.float64) for x in block["v"]]))
        known = [[(int(p["id"]), int(p["score"])) for p in k] for k in block["known"]]
        return pd.DataFrame({"dims": [int(block["dims"].iloc[0])], "block": [int(block["block"].iloc[0])],
                             "ids": [block["id"].to_numpy(np.int64).tobytes()],
                             "labels": [block["label"].to_numpy(np.int64).tobytes()], "kind": [kind], "v": [v],
                             "known": [json.dumps(known)]})

    if "known" not in rows.columns:
        rows = rows.withColumn("known", F.array().cast("array<struct<id:long,score:long>>"))
    rows = rows.withColumn("dims", F.size("v"))
    counted = rows.groupBy("dims").agg(F.ceil(F.count("*") / size).cast("int").alias("_blocks"))
    dealt = rows.join(counted, "dims").withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    return cut(dealt.select("dims", "block", "id", "label", "v", "known").groupBy("dims", "block").applyInPandas(
        gather, "dims int, block int, ids binary, labels binary, kind string, v binary, known string"), name)


def searched(anchors: DataFrame, rows: DataFrame, places: Places, negatives: bool) -> DataFrame:
    """anchor_id, positive_id (0 in the search for positives), id, score: the places of each task.

    A task holds one block of anchors and a share of the row blocks of their length, which it takes one by one.
    """
    shares = rows.groupBy("dims").agg(F.ceil((F.max("block") + 1) / BLOCKS_A_TASK).cast("int").alias("shares"))
    sent = anchors.join(shares, "dims").select(
        "dims", F.col("block").alias("of"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.lit(0).alias("turn"), "ids", "labels", "kind", "v", "known")
    groups = anchors.groupBy("dims").agg(F.collect_list("block").alias("_of"))
    met = rows.join(shares, "dims").join(groups, "dims").select(
        "dims", F.explode("_of").alias("of"), F.pmod("block", F.col("shares")).alias("share"),
        (F.col("block") + 1).alias("turn"), "ids", "labels", "kind", "v", "known")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.dims, row.of, row.share) != at:
                    yield from (s.rows() for s in held)
                    at, whole_block = (row.dims, row.of, row.share), unpacked(row)
                    known = json.loads(row.known)
                    held = [Search(whole_block.slice(a, a + TILE), places, known[a:a + TILE] if negatives else None)
                            for a in range(0, len(whole_block.ids), TILE)]
                else:
                    block = unpacked(row)
                    for search in held:
                        search.add(block)
        yield from (s.rows() for s in held)

    tasks = met.select("dims", "of", "share").distinct().count()
    dealt = sent.unionByName(met).repartition(max(tasks, 1), "dims", "of", "share").sortWithinPartitions(
        "dims", "of", "share", "turn")
    return dealt.mapInPandas(run, "anchor_id long, positive_id long, id long, score long")


def first_of(found: DataFrame, n: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def hard_negatives(table: DataFrame, key: str = "vec_id", label: Column | None = None, vector: str = "embedding",
                   anchor: Column | None = None, places: Places = Places()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` is the label's column expression (default: the column label), ``anchor`` tells the anchors (default: ids
    divisible by 50).
    """
    rows = cut(usable(table, key, F.col("label") if label is None else label, vector), "vectors")
    stored = blocks(rows, ROWS, "vector-blocks")
    chosen = rows.where(F.col("id") % 50 == 0 if anchor is None else anchor)
    first = searched(blocks(chosen, ANCHORS, "anchor-blocks"), stored, places, False)
    positives = cut(first_of(first, places.positives, "anchor_id"), "positives")
    known = positives.groupBy(F.col("anchor_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("id", "score"))).alias("known"))
    second = searched(blocks(chosen.join(known, "id"), ANCHORS, "anchor-positives"), stored, places, True)
    ranked = first_of(second, places.negatives, "anchor_id", "positive_id")
    named = positives.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
