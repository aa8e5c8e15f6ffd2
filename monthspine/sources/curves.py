"""Yield-curve files in three layouts, read to long (date, maturity in months, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_end
from ..functions.columns import to_number


def _months_of(column: str, layout: str) -> int | None:
    """Maturity in months a column name stands for; None for other columns."""
    digits = "".join(ch for ch in column if ch.isdigit())
    if not digits:
        return None
    if layout == "years":
        return int(digits) * 12 if column.strip().startswith("SVENY") else None
    return int(digits)


def snap_curve(
    wide: DataFrame, date: str, layout: str, percent: bool, maturities: list[int] | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Wide quotes to a month-end curve: last quote of each month and maturity.

    ``layout`` is ``months`` (columns 12 or 12m) or ``years`` (columns SVENYnn).
    """
    picked = {c: _months_of(c, layout) for c in wide.columns if c != date}
    picked = {c: m for c, m in picked.items() if m is not None and (maturities is None or m in maturities)}
    missing = sorted(set(maturities or []) - set(picked.values()))
    if missing:
        raise ValueError(f"maturities not in the file: {missing}")
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    rows = wide.select(F.col(date).alias("_ts"), *[to_number(F.col(f"`{c}`")).alias(str(m)) for c, m in picked.items()])
    long = rows.unpivot(["_ts"], [str(m) for m in picked.values()], "maturity", "y").where(F.col("y").isNotNull())
    snapped = long.withColumn("date", month_end("_ts"))
    if start is not None:
        snapped = snapped.where(F.col("date") >= lo)
    if end is not None:
        snapped = snapped.where(F.col("date") <= hi)
    return snapped.groupBy("date", F.col("maturity").cast("int").alias("maturity")).agg(
        (F.max_by("y", "_ts") / (100.0 if percent else 1.0)).alias("y")
    )


def read_curve(spark: SparkSession, path: str, kind: str, start: str, end: str, maturities: list[int]) -> DataFrame:
    """Read one of the known curve files.

    ``kr``: daily dates, decimal yields, one column per month of maturity. ``lw``: comment lines
    start with %, yyyymm dates, ``NNm`` columns in percent. ``gsw``: nine lines before the header,
    daily dates, SVENYnn columns in percent.
    """
    if kind == "kr":
        raw = spark.read.option("header", True).csv(path)
        return snap_curve(_dated(raw, "yyyy-MM-dd"), "_date", "months", False, maturities, start, end)
    if kind == "lw":
        raw = spark.read.option("header", True).option("comment", "%").option("ignoreLeadingWhiteSpace", True).csv(path)
        return snap_curve(_dated(raw, "yyyyMM"), "_date", "months", True, maturities, start, end)
    if kind == "gsw":
        return snap_curve(_dated(_after_header(spark, path, 9), "yyyy-MM-dd"), "_date", "years", True, maturities, start, end)
    raise ValueError(f"unknown curve type: {kind}")


def _dated(raw: DataFrame, fmt: str) -> DataFrame:
    first = raw.columns[0]
    return raw.withColumn("_date", F.try_to_date(F.trim(F.col(f"`{first}`")), fmt)).where(F.col("_date").isNotNull()).drop(first)


def _after_header(spark: SparkSession, path: str, skip: int) -> DataFrame:
    """CSV whose column names follow ``skip`` lines of prose: names from the head, rows by schema."""
    names = [r[0] for r in spark.read.text(path).limit(skip + 1).collect()][skip].split(",")
    names = [n.strip() or f"_c{i}" for i, n in enumerate(names)]
    schema = ", ".join(f"`{n}` string" for n in names)
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
