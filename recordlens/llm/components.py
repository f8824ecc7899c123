"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.session import cut


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n indexes over the links a-b (inside a task)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 50) -> DataFrame:
    """(id, component_id) of every id with a link to another one; the smallest reachable id names it.

    Each round hooks larger neighbours of an id to its smallest, then smaller ones. Minima are aggregated
    before the shuffle and each round is a stored table, so hubs and lost executors are no trouble.
    """
    edges = links.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b"))
    edges = cut(edges.where("a <> b").distinct(), "links")
    state = fingerprint(edges)
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(least, "a").where("b > a AND b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = cut(small.unionByName(least.select("a", F.col("low").alias("b"))).distinct(), "links")
        before, state = state, fingerprint(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct().withColumn("component_id", F.col("id"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(roots)
