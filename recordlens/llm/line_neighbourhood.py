"""Line dedup by a deletion-neighbourhood join, in DataFrame functions alone.

A line goes when an earlier line (by document id, then place) equals it or lies within one character edit
of it. Lines shorter than ``least_chars`` stay as they are, lines shorter than ``near_chars`` go only for
equal ones. Judged on the input: a line that goes still counts as an earlier line.

1. Equal lines form classes by two 64-bit hashes; a class knows its first place.
2. Two lines within one edit share the first or the last half exactly. Only lines that share such a half
   with another class go on; this loses no pair.
3. These emit their deletion variants (in the half that is not shared) as hashed keys with the place of the
   deletion, and themselves. Lines with equal key and place differ in that one character, so all of them have
   the earliest as partner; a line that equals a variant of another is one deletion away from it. Equal
   variants meet in one shuffle, and each line gets one partner of each kind, not all pairs.
4. Partners are verified by ``levenshtein`` on the texts.

Defined results: a null text is one empty line and comes back as an empty text. Documents without an id
come last in order; rows of equal id tie and take nothing from each other. An empty table gives an empty
table. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.session import cut

LEAST_CHARS = 8
NEAR_CHARS = 20
KEY = ["h1", "h2"]
BIT_WORDS = 1 << 14


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def row_mark(text: Column) -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(documents: DataFrame, key: str, text: str, least_chars: int) -> DataFrame:
    """h1, h2, place, mark, line of every line that counts; place is ordered, without an id last."""
    rows = documents.select(F.col(key).alias("id"), row_mark(F.col(text)).alias("mark"),
                            F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    return rows.where(F.length("line") >= least_chars).select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"),
        F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("pos").alias("pos")).alias("place"),
        "mark", "line")


def half_keys(line: Column) -> Column:
    """struct(half, side): hashes of the first (side 1) and last (side 2) halves; a line of odd length has
    halves of both roundings."""
    n = F.length(line)
    sizes = F.array_distinct(F.array(F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")))
    half = lambda h, side, part: F.struct(
        F.xxhash64(F.lit(side), h, part).alias("half"), F.lit(side).alias("side"))
    return F.flatten(F.transform(sizes, lambda h: F.array(
        half(h, 1, F.left(line, h)), half(h, 2, F.right(line, h)))))


def variant_keys(line: Column, head: Column, tail: Column) -> Column:
    """struct(variant hash, place of the deleted character): the line itself at place 0, and deletions in the
    first half (head), the last (tail) or both."""
    n = F.length(line)
    half = F.floor(n / 2).cast("int")
    places = F.sequence(F.when(head, 1).otherwise(half + 1), F.when(tail, n).otherwise(n - half))
    deletions = F.transform(places, lambda i: F.struct(
        F.xxhash64(F.concat(F.left(line, i - 1), F.substr(line, i + 1))).alias("variant"), i.alias("at")))
    return F.concat(F.array(F.struct(F.xxhash64(line).alias("variant"), F.lit(0).alias("at"))), deletions)


def near_candidates(lines: DataFrame, classes: DataFrame, near_chars: int) -> DataFrame:
    """The classes that share a half with another one: h1, h2, place, mark, head, tail.

    A shared first half leaves deletions in the last one to try (tail), a shared last half those in the first.
    """
    halves = lines.where(F.length("line") >= near_chars).select("h1", F.explode(half_keys(F.col("line"))).alias("h"))
    halves = halves.select("h1", "h.half", "h.side")
    shared = halves.groupBy("half").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high")
    chosen = halves.join(shared.select("half"), "half", "left_semi").groupBy("h1").agg(
        F.bool_or(F.col("side") == 2).alias("head"), F.bool_or(F.col("side") == 1).alias("tail"))
    return classes.join(chosen, "h1").select(*KEY, "place", "mark", "head", "tail")


def near_partners(lines: DataFrame) -> DataFrame:
    """h1 of a line and p1 of an earlier line one edit away, unverified.

    One shuffle by variant: lines with one variant and place differ in that character alone, a line that is
    itself a variant is one deletion away. The earliest of each kind is partner of all that come later.
    """
    own = F.struct(F.col("place.none"), F.col("place.id"), F.col("place.pos"), "h1")
    rows = lines.select(own.alias("own"), F.explode(variant_keys(F.col("line"), F.col("head"), F.col("tail"))).alias("v"))
    rows = rows.select("own", "v.variant", "v.at")
    by_variant, by_place = Window.partitionBy("variant"), Window.partitionBy("variant", "at")
    met = (
        rows.withColumn("n", F.count("*").over(by_variant))
        .withColumn("whole", F.min(F.when(F.col("at") == 0, F.col("own"))).over(by_variant))
        .withColumn("longer", F.min(F.when(F.col("at") > 0, F.col("own"))).over(by_variant))
        .where("n > 1").withColumn("same", F.min("own").over(by_place))
    )
    partners = F.when(F.col("at") == 0, F.array("longer")).otherwise(F.array("whole", "same"))
    pairs = met.select("own", F.explode(partners).alias("partner")).where(
        F.struct("partner.none", "partner.id", "partner.pos") < F.struct("own.none", "own.id", "own.pos"))
    return pairs.select("own.h1", F.col("partner.h1").alias("p1")).where("h1 <> p1").distinct()


def in_bits(values: DataFrame, name: str, column: Column) -> Column:
    """Whether a 64-bit hash may be among the values: a bit map of fixed size, without false negatives."""
    place = F.pmod(F.col(name), F.lit(64 * BIT_WORDS))
    word, bit = F.floor(place / 64).cast("long"), F.pmod(place, F.lit(64)).cast("int")
    words = values.groupBy(word.alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    dense = values.sparkSession.range(BIT_WORDS).join(words, F.col("id") == F.col("word"), "left").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))),
                    lambda x: x.bits).alias("bits")).scalar()
    place = F.pmod(column, F.lit(64 * BIT_WORDS))
    found = F.get(dense, F.floor(place / 64).cast("int"))
    return F.call_function("shiftright", found, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(1) == 1


def near_repeats(lines: DataFrame, classes: DataFrame, documents: DataFrame, key: str, text: str,
                 near_chars: int) -> DataFrame:
    """h1, h2 of the classes that have an earlier line within one edit."""
    wanted = near_candidates(lines, classes, near_chars)
    by_document = cut(wanted.groupBy(F.col("place.id").alias("wanted_id"), F.col("mark").alias("wanted_mark")).agg(
        F.collect_list(F.struct("place.pos", "place", *KEY, "head", "tail")).alias("wanted")).withColumn(
        "spot", F.xxhash64("wanted_id", "wanted_mark")), "near-documents")
    source = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), row_mark(F.col(text)).alias("mark"))
    # Few documents hold candidates: the others are left out before the shuffle.
    source = source.where(in_bits(by_document, "spot", F.xxhash64("id", "mark")))
    found = source.join(by_document, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("mark") == F.col("wanted_mark")))
    texts = cut(
        found.select(lines_of(F.col("text")).alias("all"), F.explode("wanted").alias("w"))
        .select("w.h1", "w.h2", "w.place", "w.head", "w.tail", F.get("all", F.col("w.pos")).alias("line"))
        .distinct(), "near-lines")
    pairs = near_partners(texts)
    partner = texts.select(F.col("h1").alias("p1"), F.col("line").alias("partner"))
    return (
        pairs.join(texts.select(*KEY, "line"), "h1").join(partner, "p1")
        .where(F.levenshtein("line", "partner", 1) >= 0).select(*KEY).distinct()
    )


def dedup_lines(documents: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                near_chars: int = NEAR_CHARS) -> DataFrame:
    """The documents with what is left of their text, and n_lines and n_removed."""
    lines = occurrences(documents, key, text, least_chars)
    first = F.min(F.struct("place", "mark")).alias("first")
    classes = cut(lines.groupBy(*KEY).agg(first, F.count("*").alias("n")).select(*KEY, "first.*", "n"), "lines")
    repeats = near_repeats(lines, classes, documents, key, text, near_chars).withColumn("near", F.lit(True))
    affected = classes.join(repeats, KEY, "left").where("n > 1 OR near")
    gone = (
        lines.drop("line").join(affected.select(*KEY, F.col("place").alias("first"), "near"), KEY)
        .where("near OR place > first")
        .groupBy(F.col("place.id").alias("gone_id"), F.col("mark").alias("gone_mark"))
        .agg(F.collect_set("place.pos").alias("gone"))
    )
    # The document travels as one struct, so that its columns cannot clash with those of the join.
    marked = documents.select(F.struct("*").alias("document"), F.col(key).alias("id"), F.col(text).alias("text"),
                              row_mark(F.col(text)).alias("mark"))
    joined = marked.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("mark") == F.col("gone_mark")), "left")
    places = F.coalesce("gone", F.array().cast("array<int>"))
    every = lines_of(F.col("text"))
    kept = F.array_join(F.filter(every, lambda line, i: ~F.array_contains(places, i)), "\n")
    others = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    return joined.select(F.col("document").withField(text, kept).alias("document"), F.size(every).cast("long").alias("n_lines"),
                         F.size(places).cast("long").alias("n_removed")).select(
        *[F.col(f"document.`{c}`") for c in others], "n_lines", "n_removed")


def oracle_sql(documents: str = "documents", least_chars: int = LEAST_CHARS, near_chars: int = NEAR_CHARS) -> str:
    """Common table expressions that end in line_dedup(doc_id, text, n_lines, n_removed), for tables with unique ids."""
    return f"""
        l0 AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {documents}),
        l1 AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM l0),
        cls AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS first FROM l1
                WHERE length(line) >= {least_chars} GROUP BY line),
        hs AS (SELECT line, first, length(line) AS n, unnest(list_distinct([length(line) // 2, (length(line) + 1) // 2])) AS h
               FROM cls WHERE length(line) >= {near_chars}),
        ks AS (SELECT line, first, n, 'p' || h || ':' || left(line, h) AS k FROM hs
               UNION ALL SELECT line, first, n, 's' || h || ':' || right(line, h) FROM hs),
        near AS (SELECT DISTINCT a.line FROM ks a JOIN ks b ON a.k = b.k
                 WHERE b.first < a.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
        judged AS (SELECT l1.*, coalesce(near.line IS NOT NULL OR struct_pack(d := doc_id, p := pos) > first, false) AS gone
                   FROM l1 LEFT JOIN cls ON cls.line = l1.line LEFT JOIN near ON near.line = l1.line),
        line_dedup AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text,
                              count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
                       FROM judged GROUP BY doc_id)"""
