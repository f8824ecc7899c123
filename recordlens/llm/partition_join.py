"""N-gram Jaccard join by universe partitioning: links between texts whose shingle sets are much alike.

A text's set holds its distinct word shingles (A-Z as a-z) as 64-bit fingerprints; equal sets are one class.
Two classes link when 100 * intersection >= ``percent`` * union.

1. Sizes fall into bands so narrow that linked sets lie in one band or in neighbours. Each band has a key
   family for pairs whose larger set lies in it, so a set has keys of its own band and of the next.
2. In a family the shingle universe is split by hash into segments. Linked sets differ in at most H
   shingles there. Each segment gets a budget: 0 (its subset must be equal) or 1 (its subset and all
   one-deletion subsets are keys). With budgets + 1 adding up to H + 1 + K, linked sets agree on at least
   K + 1, so up to K may be passed over. ``Family`` weighs keys against chance agreement for this.
3. Keys held by few classes give pairs directly. A popular key (more than ``POPULAR`` classes: copies,
   templates, empty segments) is passed over by sets with few of them, which loses nothing by point 2. Sets
   with many are near copies of each other or hold the same passages: first all are compared with the key's hub.
   Linked sets that share no other key share more popular ones than may be passed over, so each set keeps its
   rarest ones but for that number. Where the sets of such a key then still form several groups, blocks of
   ``BLOCK_SETS`` are compared, by tallies first (point 4); sets that may link across groups are then counted against
   each other shingle by shingle; a block pair gives one link per set at most, never its pairs.
4. Each class has a tally: its shingles counted in ``TALLY`` buckets by hash. Two sets differ in at least as many
   shingles as their tallies do, so pairs whose tallies differ by more than the threshold allows are left out
   before any set is fetched; that loses no link.
5. What is left is verified exactly on the sets.

Keys travel in sorted binary runs, at most ``RUN_KEYS`` at a time; a task that gathers keys holds at most
``POPULAR`` + 1 classes per key. Only the links of different texts are formed, copies join their class.

Defined results: a null or empty text has no shingles and links with nothing; a text of fewer words than a
shingle has one made of all. A null id has a null component. Rows of equal id are one vertex. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.components import components, local_components
from recordlens.llm.hashing import BASE, mix, shingle_hashes, slices, word_hashes
from recordlens.session import cut

SHINGLE = 4
PERCENT = 85
POPULAR = 8
SPARE = 0.2
RUN_KEYS = 1_500_000
PART_BYTES = 12 << 20
CHANCE_WEIGHT = 50.0
BLOCK_SETS = 1024
PART_SETS = 20_000
PAIRS_A_SET = 32
SHINGLES_AT_ONCE = 4096
TALLY = 128
MEMBER = np.dtype([("k", np.uint64), ("p", np.int64)])


@lru_cache
def band_starts(percent: int, most: int = 1 << 40) -> np.ndarray:
    """Least size of each band: sets that link lie in one band or in neighbours."""
    starts = [1]
    while starts[-1] < most:
        starts.append(100 * starts[-1] // percent + 1)
    return np.array(starts)


class Family:
    """Segments and budgets for pairs whose larger set is in a band.

    ``segments`` segments, the first ``loose`` of them with budget 1, so that
    segments + loose = differences + 1 + spare.
    """

    def __init__(self, band: int, percent: int):
        starts = band_starts(percent)
        high = int(starts[band + 1]) - 1
        # 100 i >= p u makes the symmetric difference at most (100 - p) / (100 + p) of both sizes.
        self.band, self.differences = band, (100 - percent) * 2 * high // (100 + percent)
        self.spare = max(math.ceil(SPARE * (self.differences + 1)), 2)
        budget = self.differences + 1 + self.spare
        size = (int(starts[band]) + high) / 2

        def cost(loose: int) -> float:
            segments = budget - loose
            each = size / segments
            return segments + loose * each + CHANCE_WEIGHT * segments * math.exp(-each)

        self.loose = min(range(0, budget // 2 + 1), key=cost) if budget < 64 else 0
        self.segments = budget - self.loose
        # Linked sets agree on segments worth spare + 1, a segment of budget 1 being worth 2. Without those, half of
        # the spare may go to empty segments, half to popular keys; with them empty segments are kept, and half of
        # the spare is left for popular keys.
        self.skip = self.spare // 2
        self.skip_empty = 0 if self.loose else self.skip


@lru_cache
def family(band: int, percent: int) -> Family:
    return Family(band, percent)


def segment_keys(members: np.ndarray, f: Family) -> np.ndarray:
    """Keys of one set (sorted distinct fingerprints) in a family; the lowest byte is the band."""
    seed = mix(np.array([f.band + 1], np.uint64))[0]
    spread = mix(members ^ seed)
    segment = (spread >> np.uint64(32)) % np.uint64(f.segments)
    order = np.argsort(segment, kind="stable")
    segment, codes = segment[order].astype(np.int64), mix(spread[order] + seed)
    counts = np.bincount(segment, minlength=f.segments)
    sums = np.zeros(f.segments, np.uint64)
    full = counts > 0
    begin = np.cumsum(counts) - counts
    sums[full] = np.add.reduceat(codes, begin[full])
    place = np.arange(f.segments, dtype=np.uint64)
    empty = ~full
    empty[:f.loose] = False
    passed = empty if empty.sum() <= f.skip_empty else np.zeros(f.segments, dtype=bool)
    keys = [sums[~passed] + place[~passed] * BASE]
    if f.loose:
        inside = segment < f.loose
        keys.append(sums[segment[inside]] - codes[inside] + place[segment[inside]] * BASE)
    out = mix(np.concatenate(keys) + seed)
    return (out & ~np.uint64(255)) | np.uint64(f.band)


def set_of(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingle_hashes(words, size))


def fingerprint(members: np.ndarray) -> int:
    """Signed 64-bit fingerprint of a set; 0 for the empty one."""
    if not len(members):
        return 0
    total = mix(members + BASE).sum(dtype=np.uint64) + np.uint64(len(members))
    return int(mix(np.array([total]))[0].astype(np.int64))


def sets_of(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    for _, run in slices(texts):
        words, begins = word_hashes(run)
        for a, b in zip(begins[:-1], begins[1:]):
            yield set_of(words[a:b], size)


def keys_of(members: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set in the families of its band and the next; none where only equal sets can link."""
    band = int(np.searchsorted(band_starts(percent), len(members), side="right")) - 1
    found = [segment_keys(members, f) for f in (family(band, percent), family(band + 1, percent)) if f.differences]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def tally(members: np.ndarray) -> bytes:
    """Members counted by bucket, up to 255 each, which only brings tallies nearer."""
    counts = np.bincount((mix(members) >> np.uint64(40)).astype(np.int64) % TALLY, minlength=TALLY)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def tallies(held: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(held), np.uint8).reshape(-1, TALLY).astype(np.int16)


def room(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Most members in which sets of these sizes together may differ: 100 i >= p u."""
    return (100 - percent) * sizes // (100 + percent)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a < b of the pairs of classes that their tallies do not rule out."""
    @F.pandas_udf("boolean")
    def may_link(t_a: pd.Series, t_b: pd.Series, n: pd.Series) -> pd.Series:
        apart = np.abs(tallies(t_a) - tallies(t_b)).sum(1, dtype=np.int64)
        return pd.Series(apart <= room(n.to_numpy(np.int64), percent))

    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    ends = [classes.select(F.col("print").alias(k), F.col("n").alias(f"n_{k}"), F.col("tally").alias(f"t_{k}")) for k in "ab"]
    joined = ordered.join(ends[0], "a").join(ends[1], "b")
    return joined.where(may_link("t_a", "t_b", F.col("n_a") + F.col("n_b"))).select("a", "b")


def measured(documents: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """id, n (set size), print (fingerprint), tally of every row."""
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(len(s), fingerprint(s), tally(s)) for s in sets_of(list(batch["text"]), size)]
            yield pd.DataFrame({"id": batch["id"].to_numpy(), "n": [r[0] for r in rows], "print": [r[1] for r in rows],
                                "tally": [r[2] for r in rows]})

    rows = documents.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    out = rows.mapInPandas(measure, "id string, n long, print long, tally binary")
    return out.withColumn("id", F.col("id").cast("long"))


def sorted_pairs(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of key and class, in order; plain columns, which sort faster than records."""
    order = np.lexsort((prints, keys))
    keys, prints = keys[order], prints[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])
    return keys[fresh], prints[fresh]


def key_runs(documents: DataFrame, text: str, size: int, percent: int, parts: int) -> DataFrame:
    """part, run, keys, prints: sorted runs of (key, class) cut by part."""
    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, run, keys, prints, held = TaskContext.get().partitionId(), 0, [], [], 0

        def rows() -> pd.DataFrame:
            k, p = sorted_pairs(np.concatenate(keys), np.concatenate(prints))
            keys.clear()
            prints.clear()
            part = (k >> np.uint64(8)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            k, p, part = k[order], p[order], part[order]
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            ends = np.append(at[1:], len(part))
            return pd.DataFrame({"part": part[at].astype(np.int64), "run": (task << 20) + run,
                                 "keys": [k[a:b].tobytes() for a, b in zip(at, ends)],
                                 "prints": [p[a:b].tobytes() for a, b in zip(at, ends)]})

        for batch in batches:
            for members in sets_of(list(batch["text"]), size):
                if len(members):
                    own = keys_of(members, percent)
                    keys.append(own)
                    prints.append(np.full(len(own), fingerprint(members), np.int64))
                    held += len(own)
                if held >= RUN_KEYS:
                    yield rows()
                    run, held = run + 1, 0
        if held:
            yield rows()

    return documents.select(F.col(text).alias("text")).mapInPandas(
        emit, "part long, run long, keys binary, prints binary")


class KeyTable:
    """Classes by key: all of a key's classes up to POPULAR, a mark beyond it."""

    def __init__(self):
        self.keys, self.prints = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.popular = np.zeros(0, np.uint64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Takes a run; returns the members of popular keys that came to light."""
        out = [np.zeros(0, MEMBER)]
        if len(self.popular):
            at = np.minimum(np.searchsorted(self.popular, keys), len(self.popular) - 1)
            known = self.popular[at] == keys
            out.append(np.rec.fromarrays([keys[known], prints[known]], dtype=MEMBER))
            keys, prints = keys[~known], prints[~known]
        self.waiting.append((keys, prints))
        self.held += len(keys)
        if self.held > max(len(self.keys), 100_000):
            out.append(self.settle())
        return np.concatenate([np.asarray(o) for o in out])

    def settle(self) -> np.ndarray:
        """Merges the waiting runs; members of keys that have become popular leave the table."""
        runs, self.waiting, self.held = [(self.keys, self.prints), *self.waiting], [], 0
        keys, prints = sorted_pairs(*map(np.concatenate, zip(*runs)))
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[:len(keys)])
        counts = np.diff(np.append(begins, len(keys)))
        many = np.repeat(counts > POPULAR, counts)
        self.popular = np.union1d(self.popular, keys[begins[counts > POPULAR]])
        self.keys, self.prints = keys[~many], prints[~many]
        return np.rec.fromarrays([keys[many], prints[many]], dtype=MEMBER)

    def partners(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of classes under the keys that stayed small."""
        for gap in range(1, POPULAR):
            same = self.keys[gap:] == self.keys[:-gap]
            yield self.prints[:-gap][same], self.prints[gap:][same]


def candidates(runs: DataFrame, parts: int) -> DataFrame:
    """kind 0: a pair of classes a, b; kind 1: class a is a member of popular key ``key``."""
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, table = None, KeyTable()

        def members(found: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"kind": 1, "key": found["k"].astype(np.int64), "a": found["p"], "b": 0})

        def finish() -> Iterator[pd.DataFrame]:
            yield members(table.settle())
            for a, b in table.partners():
                pairs = np.unique(np.stack([a, b], 1), axis=0)
                yield pd.DataFrame({"kind": 0, "key": 0, "a": pairs[:, 0], "b": pairs[:, 1]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if part is not None and row.part != part:
                    yield from finish()
                    table = KeyTable()
                part = row.part
                found = table.add(np.frombuffer(row.keys, np.uint64), np.frombuffer(row.prints, np.int64))
                if len(found):
                    yield members(found)
        if part is not None:
            yield from finish()

    # A task has one part: dealt by hash several would share one, and a batch that goes to Python would hold them all.
    dealt = runs.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "run")
    return dealt.mapInPandas(gather, "kind int, key long, a long, b long")


def class_sets(documents: DataFrame, classes: DataFrame, wanted: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """print, members (sorted fingerprints) of the wanted classes, from the text of each one's first row."""
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(sets_of(list(batch["text"]), size))
            prints = [fingerprint(s) for s in found]
            out = pd.DataFrame({"print": prints, "members": [s.tobytes() for s in found]})
            yield out[out["print"].to_numpy() == batch["print"].to_numpy()]

    # Stored, so that its size is known when the join is planned: below Spark's threshold no text is shuffled.
    chosen = cut(classes.join(wanted.distinct(), "print").select(F.col("id").alias("chosen"), "print"), "chosen")
    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(
        chosen, F.col("id") == F.col("chosen")).select("print", "text")
    return rows.mapInPandas(build, "print long, members binary").dropDuplicates(["print"])


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a < b) of classes whose sets pass the threshold."""
    left = sets.select(F.col("print").alias("a"), F.col("members").alias("set_a"))
    right = sets.select(F.col("print").alias("b"), F.col("members").alias("set_b"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["set_a"], batch["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.loc[good, ["a", "b"]]

    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInPandas(
        verify, "a long, b long")


def popular_members(found: DataFrame, percent: int) -> DataFrame:
    """key, a of the sets that have more popular keys in a family than they may pass over (``skip``), and their number."""
    spark = found.sparkSession
    bands = F.col("key").bitwiseAND(255)
    members = found.where("kind = 1").select("key", "a", bands.alias("band")).distinct()
    skips = spark.createDataFrame([(b, family(b, percent).skip) for b in range(len(band_starts(percent)) - 2)],
                                  "band long, skip long")
    many = members.groupBy("a", "band").agg(F.count("*").alias("many")).join(skips, "band").where("many > skip")
    return members.join(many, ["a", "band"])


def near_sets(documents: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
              percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    spark = documents.sparkSession
    rows = cut(measured(documents, key, text, size), "sets")
    classes = cut(rows.where("n > 0 AND id IS NOT NULL").groupBy("print").agg(
        F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("tally").alias("tally")), "classes")
    total = rows.agg(F.sum("n")).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, math.ceil(total * 8 / PART_BYTES))
    source = documents.where(F.col(key).isNotNull())
    found = cut(candidates(key_runs(source, text, size, percent, parts), parts), "candidates")
    members = cut(popular_members(found, percent), "popular")
    weight = members.groupBy("a").agg(F.count("*").alias("weight"))
    hubs = members.join(weight, "a").groupBy("key").agg(F.max(F.struct("weight", "a")).alias("hub"))
    to_hub = cut(members.join(hubs, "key").select("a", F.col("hub.a").alias("b")).where("a <> b").distinct(), "hubs")
    pairs = cut(possible(found.where("kind = 0").select("a", "b").unionByName(to_hub), classes, percent), "pairs")
    ends = pairs.select(F.col("a").alias("print")).unionByName(pairs.select(F.col("b").alias("print")))
    links = cut(linked(pairs, cut(class_sets(source, classes, ends, key, text, size), "class-sets"), percent), "set-links")
    still = cut(open_between_groups(members, links, classes, percent), "open")
    few, many = still.where("b IS NOT NULL").select("a", "b").distinct(), still.where("b IS NULL")
    many = many.join(unlike(many, "key", "first", "second"), ["key", "first", "second"])
    open_ends = many.select(F.col("a").alias("print")).unionByName(few.select(F.explode(F.array("a", "b")).alias("print")))
    open_sets = cut(class_sets(source, classes, open_ends, key, text, size), "open-sets")
    links = links.unionByName(linked(few, open_sets, percent)).unionByName(links_in_blocks(many, open_sets, percent))
    by_id = classes.select("print", "id")
    named = (
        links.join(by_id.toDF("a", "id_a"), "a").join(by_id.toDF("b", "id_b"), "b").select("id_a", "id_b")
        # One id in several classes ties them together.
        .unionByName(shared_ids(rows, classes))
    )
    groups = components(named, "id_a", "id_b").select(F.col("id").alias("member"), "component_id")
    of_class = classes.join(groups, F.col("id") == F.col("member"), "left").select(
        F.col("print").alias("of_print"), F.coalesce("component_id", "id").alias("component"))
    joined = rows.join(of_class, (F.col("print") == F.col("of_print")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return joined.select(F.col("id").alias(key), F.col("n").alias("n_shingles"),
                         F.coalesce("component", "id").alias("component_id"))


def shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """id_a, id_b: the first ids of two classes that rows of one id belong to."""
    several = rows.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(
        F.min("print").alias("low"), F.max("print").alias("high"), F.collect_set("print").alias("prints")).where("low <> high")
    ties = several.select(F.col("id").alias("id_a"), F.explode("prints").alias("print"))
    return ties.join(classes, "print").select("id_a", F.col("id").alias("id_b"))


def common_counts(members: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of a block's sets."""
    owner = np.repeat(np.arange(len(members)), [len(m) for m in members])
    _, column, uses = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = uses[column] > 1  # a shingle of one set counts for no pair
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((len(members), len(members)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, SHINGLES_AT_ONCE):
        a, b = np.searchsorted(column, [low, low + SHINGLES_AT_ONCE])
        held = np.zeros((len(members), SHINGLES_AT_ONCE), np.float32)
        held[owner[a:b], column[a:b] - low] = 1
        out += held @ held.T
    return np.rint(out).astype(np.int64)


def unlike(rows: DataFrame, *keys: str) -> DataFrame:
    """Of the ``keys`` that hold the same sets ``a``, two or more, the first; told by number and two sums."""
    a, mixed = F.col("a").cast("decimal(38,0)"), F.xxhash64("a").cast("decimal(38,0)")
    alike = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(a).alias("one"), F.sum(mixed).alias("two"))
    return alike.where("n > 1").groupBy("n", "one", "two").agg(F.min(F.struct(*keys)).alias("k")).select("k.*")


def rare_popular_keys(members: DataFrame) -> DataFrame:
    """key, a: popular keys by which sets that share more than ``skip`` of a family's still meet.

    Of its keys each set leaves out the ``skip`` that most sets hold, in one order for all; two sets that share more
    keep a common one. Of several keys held by the same sets one is enough.
    """
    holders = members.groupBy("key").agg(F.count("*").alias("holders"))
    order = Window.partitionBy("a", "band").orderBy("holders", "key")
    kept = members.join(holders, "key").withColumn("place", F.row_number().over(order)).where("place <= many - skip")
    kept = cut(kept.select("key", "a"), "rare-keys")
    chosen = unlike(kept, "key")
    return kept.join(chosen, "key").select("key", "a")


def open_between_groups(members: DataFrame, links: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """key, first, second, a, group, b: sets with many popular keys that may link across the groups that the links so far
    leave, by their tallies. Where they are few these are pairs a < b, else (b null) the sets of a key's block pair."""
    groups = components(links, "a", "b").select(F.col("id").alias("a"), F.col("component_id").alias("group"))
    sized = classes.select(F.col("print").alias("a"), "n", "tally")
    met = rare_popular_keys(members).join(groups, "a", "left").withColumn("group", F.coalesce("group", "a"))
    known = cut(met, "groups")
    mixed = known.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("held"))
    mixed = mixed.where("low <> high").select("key", F.ceil(F.col("held") / BLOCK_SETS).cast("int").alias("blocks"))
    dealt = known.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    sent = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "a", "group")
    sent = sent.join(sized, "a")

    parts = max(1, math.ceil(known.count() / PART_SETS))
    sent = sent.withColumn("part", F.pmod(F.xxhash64("key", "first", "second"), F.lit(parts)))

    def may_link(group: np.ndarray, n: np.ndarray, tally: np.ndarray) -> np.ndarray:
        apart = np.zeros((len(n), len(n)), np.int32)
        for column in tally.T:
            apart += np.abs(column[:, None] - column[None, :])
        return (apart <= room(n[:, None] + n[None, :], percent)) & (group[:, None] != group[None, :])

    def compare(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values(["key", "first", "second", "a"], ignore_index=True)
        at, prints = held[["key", "first", "second"]].to_numpy(np.int64), held["a"].to_numpy()
        group, n, tally = held["group"].to_numpy(), held["n"].to_numpy(np.int64), tallies(held["tally"])
        begins = np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(1)))
        pairs, blocks = [np.zeros((0, 2), np.int64)], np.zeros(len(held), bool)
        for x, y in zip(begins, np.append(begins[1:], len(held))):
            if (group[x:y] != group[x]).any():
                may = may_link(group[x:y], n[x:y], tally[x:y])
                found = may.any(1)
                if may.sum() > 2 * PAIRS_A_SET * found.sum():
                    blocks[x:y] = found
                elif found.any():
                    pairs.append(prints[x:y][np.argwhere(np.triu(may))])
        ends = pd.DataFrame(np.unique(np.concatenate(pairs), axis=0), columns=["a", "b"])
        ends = ends.assign(key=None, first=None, second=None, group=None)
        rows = held.loc[blocks, ["key", "first", "second", "a", "group"]].assign(b=None)
        return pd.concat([f.astype("Int64") for f in (ends, rows[ends.columns])])[["key", "first", "second", "a", "group", "b"]]

    return sent.groupBy("part").applyInPandas(
        compare, "key long, first int, second int, a long, group long, b long")


def links_in_blocks(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links across groups of the sets of each block pair, one a set at most."""
    rows = blocks.join(sets.select(F.col("print").alias("a"), "members"), "a")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        group, prints = block["group"].to_numpy(), block["a"].to_numpy()
        held = [np.frombuffer(m, np.uint64) for m in block["members"]]
        common, size = common_counts(held), np.array([len(m) for m in held])
        near = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        x, y = np.nonzero(np.triu(near & (group[:, None] != group[None, :]), 1))
        label = local_components(len(held), x, y)
        moved = np.flatnonzero(label != np.arange(len(held)))
        return pd.DataFrame({"a": prints[moved], "b": prints[label[moved]]})

    return rows.groupBy("key", "first", "second").applyInPandas(compare, "a long, b long")
