"""Identifier, name, header, path and theme text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from recordlens.functions import fixed


def blank(c: Column) -> Column:
    """NULL as empty text: absent cells are blank in every feed."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Text without surrounding white space of any kind."""
    return F.btrim(blank(c), F.lit(" \t\r\n\f\x0b\u00a0"))


def is_blank(c: Column) -> Column:
    return blank(c) == ""


def normalize_mark(c: Column) -> Column:
    t = F.regexp_replace(F.upper(blank(c)), r"[\s-]", "")
    return F.when((t != "") & ~t.startswith("N"), F.concat(F.lit("N"), t)).otherwise(t)


def is_valid_mark(c: Column) -> Column:
    return normalize_mark(c).rlike(fixed.MARK_PATTERN)


def normalize_serial(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(blank(c)), r"[\s-]", ""), r"^0+", "")


def normalize_header(c: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(F.upper(blank(c)), r"[^A-Z0-9]+", "_"), r"^_+|_+$", ""
    )


def loose(c: Column) -> Column:
    """Case- and padding-insensitive comparison form."""
    return F.upper(strip(c))


def _words(c: Column) -> Column:
    return F.split(F.regexp_replace(F.upper(blank(c)), r"[^A-Z0-9 ]", " "), r"\s+")


def _not_in(words: list[str]):
    return lambda t: ~t.isin(words)


def name_tokens(c: Column) -> Column:
    """Words longer than one character without legal-form words; repeats are kept."""
    keep = _not_in(fixed.NAME_STOPWORDS)
    return F.filter(_words(c), lambda t: (F.length(t) > 1) & keep(t))


def make_tokens(c: Column) -> Column:
    keep = _not_in(fixed.MAKE_STOPWORDS)
    return F.array_distinct(F.filter(_words(c), lambda t: (F.length(t) >= 3) & keep(t)))


def task_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(blank(c)), r"[^a-z0-9]+"), lambda t: F.length(t) > 2)


def query_tokens(text: str) -> list[str]:
    """Search words of a task given on the driver (one short request text)."""
    import re

    words = re.split(r"[^a-z0-9]+", text.lower())
    return [w for w in words if len(w) > 2 and w not in fixed.TASK_STOPWORDS]


def split_themes(c: Column) -> Column:
    return F.filter(
        F.transform(F.split(blank(c), r"[;,/|]+"), strip), lambda t: t != ""
    )


def _sql(v: object) -> str:
    return "'" + v.replace("'", "\\'") + "'" if isinstance(v, str) else str(v)


def lookup(c: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """Value of a small fixed code table; unknown codes give the default."""
    m = F.expr("map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items()) + ")")
    hit = F.try_element_at(m, c)
    return hit if default is None else F.coalesce(hit, default)


def first_rule(c: Column, rules: list[tuple[str, str]], otherwise: Column) -> Column:
    """Label of the first pattern that matches."""
    return reduce(
        lambda acc, rule: F.when(blank(c).rlike(rule[0]), F.lit(rule[1])).otherwise(acc),
        reversed(rules),
        otherwise,
    )


def all_labels(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Labels of every pattern that matches, in rule order."""
    return F.array_compact(F.array(*[F.when(blank(c).rlike(p), F.lit(lab)) for p, lab in rules]))


def categorize(summary: Column, action: Column) -> Column:
    last = F.when(blank(action).rlike(r"(?i)revocation|suspension"), "certificate").otherwise("other")
    return first_rule(summary, fixed.CATEGORY_RULES, last)


def chapter_of(code: Column) -> Column:
    p = F.substring(blank(code.cast("string")), 1, 2)
    return lookup(p, fixed.CHAPTERS, F.concat(F.lit("JASC "), p))


def is_true(c: Column) -> Column:
    return strip(c.cast("string")).rlike(r"(?i)^(y|yes|true|1)$")


def is_damaging(c: Column) -> Column:
    t = F.lower(strip(c.cast("string")))
    return (t != "") & ~t.rlike(r"^(n|no|none|no damage|0)$")


def ad_number(c: Column) -> Column:
    return F.regexp_extract(blank(c), r"\b(\d{2,4}-\d{2}-\d{2})\b", 1)


# --- paths ---
def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def last_two_segments(path: Column) -> Column:
    return F.substring_index(path, "/", -2)


def segment_count(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def ancestors(path: Column) -> Column:
    """Directory prefixes of a path, shortest first (the root is not among them)."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.when(
        n > 0,
        F.transform(F.sequence(F.lit(1), n), lambda i: F.concat_ws("/", F.slice(parts, 1, i))),
    ).otherwise(F.array().cast("array<string>"))


# --- labels ---
def band(score: Column) -> Column:
    s = F.greatest(F.lit(0), F.least(F.lit(100), score))
    return reduce(
        lambda acc, b: F.when(s <= b[0], F.lit(b[1])).otherwise(acc),
        reversed(fixed.SCORE_BANDS[:-1]),
        F.lit(fixed.SCORE_BANDS[-1][1]),
    )


def priority_level(score: Column) -> Column:
    return F.when(score <= 20, "low").when(score <= 60, "moderate").otherwise("high")


def age_label(seconds: Column) -> Column:
    """just now / minutes / hours / days."""
    m = F.floor(seconds / 60)
    return (
        F.when(m < 1, F.lit("just now"))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit("d ago")))
    )
