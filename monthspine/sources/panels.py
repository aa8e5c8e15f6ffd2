"""Panel and vintage files, read to long rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.calendar import month_end, prev_month_end
from ..functions.columns import to_number
from ..operators.panel import coalesce_aliases
from ..operators.transforms import apply_tcodes, ffill

TRANSFORM_MARKER = r"(?i)^transform:?$"


def split_wide_csv(raw: DataFrame, date: str, fmt: str = "M/d/yyyy", shift: str = "previous") -> tuple[DataFrame, DataFrame]:
    """Long values (date, series, value) and codes (series, tcode) of a wide text table.

    The code row is the one whose date column holds the transform marker or nothing. Dates move to
    the ``previous`` or the ``same`` month-end; rows with any other unreadable date are dropped.
    """
    if shift not in ("previous", "same"):
        raise ValueError(f"unknown date shift: {shift}")
    cols = [c for c in raw.columns if c != date]
    text = raw.select(F.trim(F.coalesce(F.col(f"`{date}`"), F.lit(""))).alias("_d"), *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    long = text.unpivot(["_d"], [F.col(f"`{c}`") for c in cols], "series", "text")
    marker = (F.col("_d") == "") | F.col("_d").rlike(TRANSFORM_MARKER)
    codes = long.where(marker).select("series", to_number("text").cast("int").alias("tcode"))
    snap = prev_month_end if shift == "previous" else month_end
    day = F.try_to_date("_d", fmt)
    values = long.where(day.isNotNull()).select(snap(day).alias("date"), "series", to_number("text").alias("value"))
    return values, codes


def read_wide_csv(spark: SparkSession, path: str, date: str = "date", fmt: str = "M/d/yyyy", shift: str = "previous") -> tuple[DataFrame, DataFrame]:
    return split_wide_csv(spark.read.option("header", True).csv(path), date, fmt, shift)


def transformed_panel(values: DataFrame, codes: DataFrame, start: str, end: str, fill_first: list[str] = ("UMCSENTx",)) -> DataFrame:
    """Transformed series between two months; sparse early series are carried forward first.

    Differences use the rows before ``start``, so the slice comes last. A series without a code keeps
    its level.
    """
    d = values.withColumn("value", F.when(F.col("series").isin(list(fill_first)), ffill("value", ["series"])).otherwise(F.col("value")))
    coded = d.join(codes, "series", "left").withColumn("tcode", F.coalesce("tcode", F.lit(1)))
    out = apply_tcodes(coded, ["series"])
    return out.where(F.col("date").between(start, end)).select("date", "series", F.col("transformed").alias("value"))


def read_balanced_csv(spark: SparkSession, path: str, start: str, end: str, date: str = "decision_date") -> DataFrame:
    """A balanced real-time panel, already transformed, sliced to months."""
    values, _ = read_wide_csv(spark, path, date, "yyyy-MM-dd", "same")
    return values.where(F.col("date").between(start, end))


def csv_cells(spark: SparkSession, folder: str, glob: str = "*.csv", sep: str = ",") -> DataFrame:
    """Cells of many small CSV files whose columns may differ (path, line, column, text).

    Every file keeps its own header. One file is one record, as monthly snapshots and result tables
    are well below a megabyte; the files spread over tasks. Fields in double quotes may hold the separator, line ends and
    doubled quotes.
    """
    records = F.regexp_extract_all("value", F.lit(r'((?:[^"\r\n]++|"[^"]*+")++)'))
    files = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), records.alias("_l"))
    )
    mark = re.escape(sep)
    fields = lambda line: F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(f'{mark}((?:[^"{mark}]++|"[^"]*+")*+)'))

    def bare(text: Column) -> Column:
        inner = F.regexp_extract(F.trim(text), r'(?s)^"(.*)"$', 1)
        return F.when(F.trim(text).rlike(r'(?s)^".*"$'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.trim(text))

    names = F.transform(fields(F.get("_l", F.lit(0))), bare)
    lines = files.select("path", names.alias("_h"), F.posexplode(F.slice("_l", F.lit(2), F.size("_l"))).alias("line", "_t")).where(F.trim("_t") != "")
    cells = lines.select("path", "line", F.posexplode(F.arrays_zip("_h", fields(F.col("_t")).alias("v"))).alias("_i", "_c"))
    return cells.select("path", "line", F.col("_i").alias("position"), F.col("_c._h").alias("column"), bare(F.col("_c.v")).alias("text")).where(
        F.col("column").isNotNull() & (F.col("column") != "")
    )


def read_vintage_archive(
    spark: SparkSession, folder: str, month_pattern: str = r"(\d{4}-\d{2})\.csv$", glob: str = "*.csv",
    date: str = "sasdate", fmt: str = "M/d/yyyy", aliases: dict[str, str] = fv.ARCHIVE_ALIASES,
) -> DataFrame:
    """A folder of monthly snapshots to (vintage_month, date, series, value).

    The snapshot month comes from the path; files without one are left out. The date column is
    ``date`` or else the first. Code rows and unreadable dates drop; renamed columns merge.
    """
    month = F.regexp_extract("path", month_pattern, 1)
    cells = csv_cells(spark, folder, glob).where(month != "").withColumn(
        "vintage_month", F.last_day(F.to_date(F.concat(month, F.lit("-01"))))
    )
    named = F.max(F.col("column") == date).over(Window.partitionBy("path", "line"))
    cells = cells.withColumn("_named", named)
    is_date = F.when(F.col("_named"), F.col("column") == date).otherwise(F.col("position") == 0)
    days = cells.where(is_date).select("path", "line", month_end(F.try_to_date("text", fmt)).alias("date"))
    values = cells.where(~is_date).select("vintage_month", "path", "line", "position", F.col("column").alias("series"), to_number("text").alias("value"))
    rows = values.join(days.where(F.col("date").isNotNull()), ["path", "line"])
    return coalesce_aliases(rows, aliases, "position", keys=["vintage_month", "date"])


def collect_runs(spark: SparkSession, folder: str, columns: list[str], pattern: str = r"([^/]+)/([^/]+)/[^/]+$", glob: str = "*.csv") -> DataFrame:
    """Result tables of many runs, tagged with run name and timestamp from their folders.

    Columns a file lacks are NULL; ``pattern`` captures name and timestamp.
    """
    cells = csv_cells(spark, folder, glob)
    wide = cells.groupBy("path", "line").pivot("column", columns).agg(F.first("text"))
    return wide.select(
        F.regexp_extract("path", pattern, 1).alias("run_name"), F.regexp_extract("path", pattern, 2).alias("run_timestamp"),
        *[F.col(f"`{c}`").alias(c) for c in columns],
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A registry file with its twenty columns, as the operators read it.

    The query fails on a row without a series, a whole transform code or, for a derived series, two components.
    """
    schema = ", ".join(f"`{c}` string" for c in fv.REGISTRY_COLUMNS)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"').csv(path)
    text = {c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in fv.REGISTRY_COLUMNS}
    some = lambda c: F.when(text[c] != "", text[c])
    need = lambda value, what: F.coalesce(value, F.raise_error(F.concat(F.lit(f"registry row without {what}: "), text["mnemonic_hs"])))
    parts = F.from_json(some("component_series_ids"), "array<string>")
    derived = text["construction_type"] == "derived_formula"
    part = lambda i: F.when(derived, need(F.get(parts, F.lit(i)), "two components"))
    return raw.select(
        need(some("mnemonic_hs"), "a series").alias("series"),
        text["construction_type"].alias("kind"),
        some("target_series_id").alias("target"),
        part(0).alias("num"),
        part(1).alias("den"),
        text["release_rule"].alias("rule"),
        text["pub_lag_mode"].alias("lag_mode"),
        some("pub_lag_months").cast("int").alias("lag_months"),
        text["pub_lag_schedule_json"].alias("lag_schedule"),
        need(some("tcode_hs").cast("int"), "a transform code").alias("tcode"),
        text["revision_class"].alias("revision_class"),
    )
