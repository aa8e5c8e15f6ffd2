"""Regime calendars: interval membership and carried-forward indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import per_month, with_months
from .panel import latest_at_or_before


def regime_months(regimes: DataFrame) -> DataFrame:
    """Month-ends inside any [start_date, end_date], months counted whole, with the episode."""
    return with_months(regimes, "start_date", "end_date", "date").select("date", "episode")


def flag_regime(dates: DataFrame, regimes: DataFrame, by_month: bool = True) -> DataFrame:
    """True where the date lies in a regime. ``by_month`` counts every month a regime touches;
    otherwise the day itself must lie between start and end."""
    months = regime_months(regimes)
    if not by_month:
        months = with_months(regimes, "start_date", "end_date", "date").where(
            F.col("date").between(F.col("start_date"), F.col("end_date"))
        )
    inside = per_month(months.select("date").distinct().withColumn("flag", F.lit(True)))
    return dates.join(inside, "date", "left").withColumn("flag", F.coalesce("flag", F.lit(False)))


def indicator_asof(dates: DataFrame, monthly: DataFrame, flag: str) -> DataFrame:
    """Last indicator value at or before each date, 0 before the first (both sides calendars)."""
    rows = monthly.where(F.col(flag).isNotNull())
    found = latest_at_or_before(rows, dates.select("date"), [], "date", [flag])
    return found.select("date", F.coalesce(flag, F.lit(0)).cast("int").alias(flag))
