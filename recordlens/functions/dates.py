"""Date parsing and age arithmetic with an explicit as-of date (never the wall clock)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MS_PER_DAY = 86_400_000


def as_date(c: Column | str) -> Column:
    """ISO date (or date-time) text as a date; NULL when it does not parse."""
    c = F.lit(c) if isinstance(c, str) else c
    return F.coalesce(F.try_to_date(c, "yyyy-MM-dd"), F.try_to_timestamp(c).cast("date"))


def compact_to_iso(c: Column) -> Column:
    """YYYYMMDD to YYYY-MM-DD, blank for anything else (digits are not checked as a calendar)."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(
        t.rlike(r"^\d{8}$"),
        F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)),
    ).otherwise("")


def age_days(c: Column, as_of: str) -> Column:
    """Whole days from a date text or date column to as_of; negative for the future."""
    return F.datediff(F.lit(as_of).cast("date"), c)


def text_age_days(c: Column, as_of: str) -> Column:
    return age_days(as_date(c), as_of)


def months_since(d: Column, as_of: str) -> Column:
    """Fractional months of 30.44 days between a date and as_of."""
    return F.datediff(F.lit(as_of).cast("date"), d).cast("double") / F.lit(30.44)


def rolling_cutoff(as_of: str, months: int) -> Column:
    return F.add_months(F.lit(as_of).cast("date"), -months)


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
