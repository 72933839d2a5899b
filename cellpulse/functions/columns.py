"""Small column expressions shared by the operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column, otherwise=0.0) -> Column:
    """``num/den`` where the denominator is positive, a fixed value elsewhere."""
    return F.when(den > 0, num / den).otherwise(F.lit(otherwise))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def epoch_hours(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts) / 3600)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_seconds(later) - F.unix_seconds(earlier)) / 3600.0


def add_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


# The three weekday encodings in use. Each table states which one it holds.
def weekday_sunday_one(ts: Column) -> Column:
    return F.dayofweek(ts)


def weekday_sunday_zero(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def weekday_monday_zero(ts: Column) -> Column:
    return F.weekday(ts)


def not_finite(c: Column) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def amount(c: Column, digits: int = 2) -> Column:
    """A non-negative number as text, rounded half-up in units of the last place."""
    unit = 10**digits
    return F.format_string(f"%.{digits}f", F.round(c.cast("double") * unit) / unit)


def percent_text(share: Column) -> Column:
    """A non-negative share as a percentage with one decimal."""
    return F.format_string("%.1f", F.round(share * 1000) / 10)


def risk_band(score: Column) -> Column:
    # The bands and their lower ends.
    return (
        F.when(score >= 0.80, "CRITICAL")
        .when(score >= 0.60, "HIGH")
        .when(score >= 0.30, "MEDIUM")
        .otherwise("LOW")
    )


def status_of_severity(severity: Column) -> Column:
    level = F.upper(severity)
    return F.when(level == "HIGH", "HIGH").when(level == "MEDIUM", "ATTENTION").otherwise("NORMAL")


def status_rank(status: Column) -> Column:
    return F.when(status == "HIGH", 3).when(status == "ATTENTION", 2).otherwise(1)


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def median_of(values: Column) -> Column:
    """Exact median of an array of doubles without nulls; null for an empty one."""
    n = F.size(values)
    ordered = F.sort_array(values)
    # Out-of-range places of an empty array read as null.
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return (low + high) / 2
