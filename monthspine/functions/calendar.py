"""Month-end calendar arithmetic. Every date in the engine is a month-end DATE."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_end(c: Column | str) -> Column:
    """Last calendar day of the month that holds ``c``."""
    return F.last_day(_col(c).cast("date"))


def shift_months(c: Column | str, n: Column | int) -> Column:
    """Month-end ``n`` months after ``c`` (before it when ``n`` is negative)."""
    return F.last_day(F.add_months(_col(c).cast("date"), n))


def shift_literal(day: str, n: int) -> str:
    """Month-end ``n`` months from a literal ISO date, for parameters."""
    d = dt.date.fromisoformat(day)
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return dt.date(y, m + 1, calendar.monthrange(y, m + 1)[1]).isoformat()


def prev_month_end(c: Column | str) -> Column:
    return shift_months(c, -1)


def month_number(c: Column | str) -> Column:
    """Months since year zero; whole-month differences are plain subtractions of it."""
    c = _col(c)
    return F.year(c) * 12 + F.month(c)


def months_apart(late: Column | str, early: Column | str) -> Column:
    return month_number(late) - month_number(early)


def with_months(df: DataFrame, start: Column | str, end: Column | str, out: str = "date") -> DataFrame:
    """Repeat each row for every month-end from ``start`` to ``end``; none when start is after end.

    The outer explode keeps the optimizer from testing the month sequence on the raw rows below
    an aggregation.
    """
    s, e = month_end(start), month_end(end)
    firsts = F.when(s <= e, F.sequence(F.trunc(s, "MM"), F.trunc(e, "MM"), F.expr("interval 1 month")))
    spread = df.withColumn(out, F.explode_outer(firsts)).where(F.col(out).isNotNull())
    return spread.withColumn(out, F.last_day(out))


def calendar_months(spark: SparkSession, first: str, last: str, out: str = "date") -> DataFrame:
    """The month-ends of a literal range."""
    return with_months(spark.range(1), F.lit(first), F.lit(last), out).select(out)


# Release rules and how many months before the decision they cut off.
RELEASE_RULE_MONTHS = {
    "same_month_end": 0,
    "month_end_plus_1m": 1,
    "month_end_plus_2m": 2,
    "month_end_plus_3m": 3,
}


def release_cutoff(decision: Column | str, rule: Column | str) -> Column:
    """Last observation month a decision may use; an unknown rule fails the query."""
    rule = _col(rule)
    back = F.coalesce(
        *[F.when(rule == name, F.lit(-n)) for name, n in RELEASE_RULE_MONTHS.items()],
        F.raise_error(F.concat(F.lit("unknown release rule: "), F.coalesce(rule, F.lit("null")))).cast("int"),
    )
    return shift_months(decision, back)


def per_month(df: DataFrame) -> DataFrame:
    """Broadcast a frame with at most one row per calendar month: twelve small rows a year, however
    much data there is. Every other join leaves the choice to measured sizes."""
    return F.broadcast(df)


def spine_bounds(df: DataFrame, date: str = "date") -> tuple[Column, Column]:
    """First and last month of a frame as scalar subqueries."""
    return (
        df.select(F.min(month_end(date))).scalar(),
        df.select(F.max(month_end(date))).scalar(),
    )


def month_spine(df: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """One row per key and month between the key's first and last date."""
    spans = df.groupBy(*keys).agg(F.min(date).alias("_lo"), F.max(date).alias("_hi"))
    return with_months(spans, "_lo", "_hi").select(*keys, "date")
