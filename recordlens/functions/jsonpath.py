"""Dot paths into JSON documents, on Spark's VARIANT type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def variant_path(path: str | None) -> str:
    """``a.0.b`` to ``$['a'][0]['b']``; an empty path is the whole document."""
    if path in (None, "", "$"):
        return "$"
    parts = [f"[{s}]" if s.isdigit() else "['" + s.replace("'", "\\'") + "']"
             for s in str(path).split(".")]
    return "$" + "".join(parts)


def parse(c: Column) -> Column:
    return F.try_parse_json(c)


def node(doc: Column, path: str | None) -> Column:
    """The value at a path; SQL NULL only when it is absent (a JSON null is a value)."""
    return F.try_variant_get(doc, variant_path(path), "variant")


def present(doc: Column, path: str | None) -> Column:
    return node(doc, path).isNotNull()


def scalar(doc: Column, path: str | None) -> Column:
    """Text form of a scalar at a path; NULL when absent, JSON null or nested."""
    return F.try_variant_get(doc, variant_path(path), "string")


def first_filled(doc: Column, paths: list[str]) -> Column:
    """First candidate path with a non-blank value, else blank."""
    return F.coalesce(*[F.nullif(scalar(doc, p), F.lit("")) for p in paths], F.lit(""))


def rows_at(doc: Column, path: str | None) -> Column:
    """Rows at a path: an array's items, a single value as one row, nothing when absent or null."""
    v = node(doc, path)
    items = F.try_variant_get(doc, variant_path(path), "array<variant>")
    none = F.array().cast("array<variant>")
    return (F.when(v.isNull() | F.is_variant_null(v), none)
            .otherwise(F.coalesce(items, F.array(v))))
