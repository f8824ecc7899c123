"""Queries on the driver tables, one per operator, each with its checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordlens.views import load, view, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables and views of one scale folder, read on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        reader = view if name.startswith("v_") else load
        frame = reader(self.spark, self.sf_dir, name)
        setattr(self, name, frame)
        return frame


def query(sql: str | None = None, views: tuple[str, ...] = (), key: str | None = None):
    """Registers a function of Tables under its name; ``views`` are put before the SQL."""

    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = key or fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            body = sql.strip()
            if views:
                head = view_sql(*views)
                if body.upper().startswith("WITH "):
                    body = f"{head}, {body[5:]}"
                else:
                    body = f"{head} {body}"
            ORACLES[name] = body
        return fn

    return register


def registered():
    """All queries and checking SQL, after importing the binding modules."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"recordlens.bindings.{module}")
    return QUERIES, ORACLES


MODULES = ["expressions", "joins", "aggregates", "windows", "risk", "checks", "files", "sessions"]
