"""Rankings, top-k boards and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from recordlens.functions import text
from recordlens.operators.ordered import top_n


def priority_board(records: DataFrame, score: str, tie: str, n: int = 20) -> DataFrame:
    """Highest scores first among the resolved; planned as a distributed top-k."""
    return records.filter(F.col("RESOLVED") == "yes").orderBy(F.desc(score), F.asc(tie)).limit(n)


def rank_order(tie: str = "capability_id") -> list[Column]:
    """Order of trust: fresh verified eligible, eligible, 30-day rate, match, latency."""
    c = F.col
    good = c("eligible") & (c("status") == "verified") & c("fresh")
    return [
        F.desc(F.coalesce(good, F.lit(False))), F.desc(c("eligible")),
        F.desc(F.coalesce(c("success_rate_30d"), F.lit(-1.0))), F.desc(c("match_score")),
        F.asc_nulls_last("latency_ms"), F.asc(tie),
    ]


def rank_sources(candidates: DataFrame, limit: int = 10) -> DataFrame:
    return candidates.orderBy(*rank_order()).limit(limit)


def token_match_score(catalog: DataFrame, fields: dict[str, tuple[Column, int]],
                      words: list[str]) -> DataFrame:
    """Sum of field weights over the task words found in each field; no hits, no row.

    The task is one short text, so its words are literals and the catalog is scanned once. Repeated
    words count again, as typed.
    """
    if not words:
        return catalog.withColumn("match_score", F.lit(0))
    hits = []
    for column, weight in fields.values():
        have = F.array_distinct(text.task_tokens(column))
        for w in words:
            hits.append(F.when(F.array_contains(have, w), weight).otherwise(0))
    score = reduce(lambda a, b: a + b, hits)
    return catalog.withColumn("match_score", score).filter(F.col("match_score") > 0)


def last_n_events(events: DataFrame, order: list[str], n: int = 50,
                  since: Column | None = None) -> DataFrame:
    """The last n events in their order, optionally only those after a moment."""
    rows = events if since is None else events.filter(F.col(order[0]) > since)
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def fallback_top3(candidates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First three distinct candidates per source along (declared before ranked) order."""
    once = candidates.filter(F.col("candidate") != F.col(key)).groupBy(key, "candidate").agg(
        F.min(F.struct(*order)).alias("_at"))
    return top_n(once, [key], [F.asc("_at"), F.asc("candidate")], 3).drop("_at")


def missing_items(required: DataFrame, present: DataFrame) -> DataFrame:
    """Required rows that are not present."""
    return required.distinct().join(present.distinct(), required.columns, "left_anti")


def token_intersection(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    return rows.withColumn("shared", F.array_sort(F.array_intersect(left, right)))


def union_all_sources(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
