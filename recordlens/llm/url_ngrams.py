"""URL filter: rules decide where one fits, else logistic regression on hashed character n-grams.

The model is trained from a small labelled URL table (url, blocked), at most ``TRAIN_ROWS`` rows of it.
Host and path have n-grams of their own, so ``/de/`` in a path is not ``de`` in a host.

Defined results: a null url and one without ``://`` have empty host and path, no rule, and the model's
verdict on empty strings. Without labelled rows of both kinds the model says what all labels say, and
``allow`` without any. Repeated rows are judged alike, other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.hashing import char_ngrams

# Fixed rules: host, path, verdict.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
TRAIN_ROWS = 4000
BUCKETS = 1 << 14
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = None
    for name, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def features(hosts: list[str], paths: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs; the second half of the features belongs to paths."""
    a, b = char_ngrams(hosts, 3, 5, buckets), char_ngrams(paths, 3, 5, buckets)
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + buckets])


class UrlModel:
    """Logistic regression; weights of the mean n-gram of a URL plus a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def probability(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        rows, cols = features(hosts, paths, len(self.weights) // 2)
        total = np.bincount(rows, self.weights[cols], len(hosts))
        count = np.maximum(np.bincount(rows, minlength=len(hosts)), 1)
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(count) + self.bias, -30, 30)))


def fit(hosts: list[str], paths: list[str], blocked: np.ndarray, rounds: int = 150,
        buckets: int = BUCKETS, decay: float = 1e-4) -> UrlModel:
    """Full-batch AdaGrad on the log loss."""
    weights, bias = np.zeros(2 * buckets), 0.0
    if not len(blocked) or blocked.min() == blocked.max():
        return UrlModel(weights, 30.0 if len(blocked) and blocked[0] else -30.0)
    rows, cols = features(hosts, paths, buckets)
    scale = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(hosts)), 1))
    seen, seen_bias = np.full(2 * buckets, 1e-8), 1e-8
    for _ in range(rounds):
        logit = np.bincount(rows, weights[cols], len(hosts)) * scale + bias
        error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - blocked) / len(blocked)
        slope = np.bincount(cols, (error * scale)[rows], 2 * buckets) + decay * weights
        seen += slope**2
        seen_bias += error.sum()**2
        weights -= 0.3 * slope / np.sqrt(seen)
        bias -= 0.3 * error.sum() / np.sqrt(seen_bias)
    return UrlModel(weights, float(bias))


def train(labelled: DataFrame, url: str = "url", blocked: str = "blocked",
          max_rows: int = TRAIN_ROWS) -> UrlModel:
    """Model from a labelled URL table; rows with a null label are left out.

    At most max_rows distinct (host, path, label), those with the smallest hash, reach the driver.
    """
    rows = (
        labelled.where(F.col(blocked).isNotNull())
        .select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                F.col(blocked).cast("boolean").alias("blocked"))
        .where((F.length("host") <= 255) & (F.length("path") <= 2000))
        .distinct()
        .orderBy(F.xxhash64("host", "path", "blocked"), "host", "path", "blocked").limit(max_rows)
        .collect()
    )
    return fit([r.host for r in rows], [r.path for r in rows], np.array([float(r.blocked) for r in rows]))


def rule_labels(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """(url, blocked) of the URLs that a rule decides: the labelled table when there is no other."""
    rule = matching_rule(host_of(F.col(url)), path_of(F.col(url)), rules)
    return (
        pages.select(F.col(url).alias("url"), rule.alias("r")).where(F.col("r").isNotNull())
        .select("url", (F.col("r.verdict") == "block").alias("blocked"))
    )


def judge(pages: DataFrame, model: UrlModel, key: str = "page_id", url: str = "url", rules=RULES,
          threshold: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict, blocked_probability of every row."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    parts = pages.select(F.col(key).alias(key), host.alias("host"), path.alias("path"),
                         matching_rule(host, path, rules).alias("r"))
    rows = parts.select(key, "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("said"))

    @F.pandas_udf("double")
    def probability(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            out = np.zeros(len(hosts))
            for at in range(0, len(hosts), 2000):
                out[at:at + 2000] = model.probability(list(hosts[at:at + 2000]), list(paths[at:at + 2000]))
            yield pd.Series(out)

    scored = rows.withColumn("blocked_probability", probability("host", "path"))
    by_model = F.when(F.col("blocked_probability") >= threshold, "block").otherwise("allow")
    return scored.select(key, "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"),
                         "blocked_probability")
