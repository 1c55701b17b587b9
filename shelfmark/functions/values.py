"""Column functions over times and vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark import vocab


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / F.lit(3_600_000_000.0)


def time_band(hours: Column) -> Column:
    return (F.when(hours <= 2, 0.10).when(hours <= 12, 0.06).when(hours <= 48, 0.03)
            .when(hours <= 168, 0.01).otherwise(0.0))


def age_days(created: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(created)) / F.lit(86_400_000_000.0))


def recency(created: Column, as_of: Column, horizon: float = 365.0) -> Column:
    """1 for a new item, 0 from ``horizon`` days on and when the time is unknown."""
    days = F.least(age_days(created, as_of), F.lit(horizon))
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - days / horizon), F.lit(0.0))


def months_before(as_of: Column, months: int = 6) -> Column:
    """The same time of day ``months`` earlier."""
    return as_of - F.make_interval(months=F.lit(months))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def vector_similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(F.lit(0.0), distance))


def distance_band(distance: Column, strong: float = vocab.VECTOR_STRONG, weak: float = vocab.VECTOR_WEAK) -> Column:
    return F.when(distance <= strong, "strong").when(distance <= weak, "weak").otherwise("far")


def retry_delay_seconds(attempt: Column) -> Column:
    """30 s doubling to one hour; none from the eighth attempt on."""
    delay = F.least(F.lit(vocab.RETRY_BASE_SECONDS) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(vocab.RETRY_CAP_SECONDS)))
    return F.when(attempt < vocab.MAX_ATTEMPTS, delay.cast("bigint"))
