"""Shape of JSON documents for drift detection: the only expression that needs Python.

Spark's own schema of a VARIANT tells whole numbers from decimals and looks at every array item;
here any number is a number and the first item stands for its array, so that ordinary data does
not look like drift.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, functions as F

MAX_DEPTH, MAX_KEYS = 4, 50  # the reference's limits; hashes have none unless asked


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string"


def shape_of(value, depth: int = 0, max_depth: int | None = MAX_DEPTH, max_keys: int | None = MAX_KEYS):
    """Kinds in place of values; None is no limit. Without recursion, as documents may be nested deeply."""
    out = [None]
    todo = [(value, depth, out, 0)]
    while todo:
        value, depth, into, key = todo.pop()
        if max_depth is not None and depth > max_depth:
            into[key] = "any"
        elif isinstance(value, list):
            into[key] = ["empty"]
            todo += [(value[0], depth + 1, into[key], 0)] if value else []
        elif isinstance(value, dict):
            into[key] = {}
            todo += [(value[k], depth + 1, into[key], k) for k in sorted(value)[:max_keys]]
        else:
            into[key] = kind_of(value)
    return out[0]


def hash_text(body: str | None, max_depth: int | None = None, max_keys: int | None = None) -> str | None:
    try:
        doc = json.loads(body) if body is not None else None
    except ValueError:
        return None
    if doc is None:
        return None
    canonical = json.dumps(shape_of(doc, 0, max_depth, max_keys), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(canonical.encode()).hexdigest()


def schema_hash(body: Column, max_depth: int | None = None, max_keys: int | None = None) -> Column:
    """Hash of a document's shape; NULL when it is absent or not JSON. Arrow batches.

    All levels and keys count unless limited: keys after the first ``max_keys`` of an object (in order of
    their names) and everything below ``max_depth`` levels then are left out.
    """

    @F.pandas_udf("string")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: hash_text(text, max_depth, max_keys))

    return hashes(body)


def evidence_hash(*columns: str) -> Column:
    """Hash of the named columns as one canonical JSON object (keys sorted, values as text)."""
    doc = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]))
    return F.concat(F.lit("sha256:"), F.sha2(doc, 256))
