"""Value coercions shared by record building, correlation and ingest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,6)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """NULL or empty after trim."""
    c = col(c)
    return c.isNull() | (F.trim(c.cast("string")) == "")


def nullif_blank(c: Column | str) -> Column:
    c = col(c)
    return F.when(blank(c), F.lit(None)).otherwise(F.trim(c.cast("string")))


def money_or_zero(c: Column | str) -> Column:
    """decimal(18,6) or 0 when missing / not numeric."""
    c = col(c)
    return F.coalesce(c.try_cast(MONEY), F.lit(0).cast(MONEY))


def confidence_0_100(c: Column | str) -> Column:
    """Words low/medium/high -> 30/60/85; numbers rounded half-even, clamped 0..100; else 0."""
    c = col(c)
    s = F.lower(F.trim(c.cast("string")))
    num = s.try_cast("double")
    rounded = F.bround(num, 0)
    return (
        F.when(s.isin("low", "l"), F.lit(30))
        .when(s.isin("medium", "med", "m"), F.lit(60))
        .when(s.isin("high", "h"), F.lit(85))
        .when(num.isNotNull() & ~F.isnan(num), F.least(F.lit(100), F.greatest(F.lit(0), rounded)).cast("int"))
        .otherwise(F.lit(0))
        .cast("int")
    )


def messy_number(c: Column | str) -> Column:
    """Best-effort number from text ('$1,234.50' -> 1234.5, '12,5' -> 12.5); NULL when not numeric.

    Keep digits, ',', '.', '-'; a single comma without a dot is the decimal
    mark; with both present commas are thousands separators.
    """
    c = col(c)
    s = F.regexp_replace(F.trim(c.cast("string")), r"[^0-9,.\-]", "")
    n_comma = F.length(s) - F.length(F.regexp_replace(s, ",", ""))
    n_dot = F.length(s) - F.length(F.regexp_replace(s, r"\.", ""))
    text = (
        F.when((n_comma == 1) & (n_dot == 0), F.regexp_replace(s, ",", "."))
        .when((n_comma >= 1) & (n_dot >= 1), F.regexp_replace(s, ",", ""))
        .otherwise(s)
    )
    return F.when(s == "", F.lit(None).cast("double")).otherwise(text.try_cast("double"))
