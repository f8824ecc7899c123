"""Order-dependent building blocks that stay parallel when one key owns much of the data.

A plain window partitioned by the entity would sort a hot entity in one task. Here a chunk column
(a time bucket that never decreases along the order) joins the partitioning key; only one summary
row per key and chunk crosses chunk borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def time_chunk(ts: Column, seconds: int = 3600) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / seconds)


def date_chunk(d: Column, days: int = 30) -> Column:
    return F.floor(F.unix_date(d) / days)


def _same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & left[n].eqNullSafe(right[f"_r_{n}"])
    return cond


def _carried(edge: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """One row per key and chunk with something computed from the chunks before it."""
    return edge.select(
        *[F.col(k).alias(f"_r_{k}") for k in [*keys, "_chunk"]], value.alias(name)
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], chunk: Column
) -> DataFrame:
    """Adds struct column ``prev``: the given columns of the row before, NULL on the first row."""
    rows = df.withColumn("_chunk", chunk)
    packed = F.struct(*[F.col(c) for c in cols])
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    edge = rows.groupBy(*keys, "_chunk").agg(
        F.max_by(packed, F.struct(*order)).alias("_last")
    )
    across = Window.partitionBy(*keys).orderBy("_chunk")
    carry = _carried(edge, keys, F.lag("_last").over(across), "_carry")
    marked = rows.withColumn("_prev", F.lag(packed).over(inner))
    joined = marked.join(carry, _same(marked, carry, [*keys, "_chunk"]), "left")
    return joined.select(*df.columns, F.coalesce("_prev", "_carry").alias("prev"))


def with_running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
    chunk: Column,
) -> DataFrame:
    """Adds the inclusive running sum of ``value`` along the order within each key."""
    rows = df.withColumn("_chunk", chunk).withColumn("_value", value)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    edge = rows.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    carry = _carried(edge, keys, F.coalesce(F.sum("_total").over(before), F.lit(0)), "_offset")
    marked = rows.withColumn(
        "_run", F.sum("_value").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    )
    joined = marked.join(carry, _same(marked, carry, [*keys, "_chunk"]), "left")
    return joined.select(*df.columns, (F.col("_run") + F.col("_offset")).alias(name))


def pick_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool
) -> DataFrame:
    """First or last whole row of each key as a mergeable aggregate: no sort, no hot partition."""
    by = F.struct(*order)
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = F.max_by(row, by) if last else F.min_by(row, by)
    return df.groupBy(*keys).agg(pick.alias("_row")).select(
        *[F.col("_row")[c].alias(c) for c in df.columns]
    )


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          name: str = "rank") -> DataFrame:
    """Rows ranked 1..n within each key; Spark limits each map task to n rows per key first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def nth_smallest(df: DataFrame, value: str, quantiles: dict[str, float]) -> DataFrame:
    """Exact order statistics ``sorted[floor(n*q)]`` for each named q, as one row.

    Values are counted first, then placed by logarithmic bucket; running counts are taken over the
    few buckets and, in parallel, inside each bucket.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(
        F.count("*").alias("_n")
    )
    size = F.log2(F.abs(F.col("_v").cast("double")) + 1) * 64
    counts = counts.withColumn("_chunk", F.floor(F.when(F.col("_v") < 0, -size).otherwise(size)))
    ranked = with_running_total(counts, [], ["_v"], F.col("_n"), "_upto", F.col("_chunk"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("t"))
    aggs = []
    for name, q in quantiles.items():
        k = F.floor(total.scalar() * F.lit(q))
        hit = (F.col("_upto") > k) & (F.col("_upto") - F.col("_n") <= k)
        aggs.append(F.max(F.when(hit, F.col("_v"))).alias(name))
    return ranked.agg(*aggs)
