"""Window transforms of dense monthly panels (one row per key and month)."""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import log_positive, ratio


def by_date(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("date")


def upto_now(keys: list[str]) -> WindowSpec:
    return by_date(keys).rowsBetween(Window.unboundedPreceding, 0)


def training_rows(keys: list[str], gap: int) -> WindowSpec:
    """Rows an origin may train on: all but the last ``gap`` + 1 up to and including itself."""
    return by_date(keys).rowsBetween(Window.unboundedPreceding, -(gap + 1))


def tcode(value: Column, code: Column, w: WindowSpec) -> Column:
    """Stationarity transform 1..7; any other code fails the query.

    1 level, 2 difference, 3 second difference, 4 log, 5 log difference, 6 second log
    difference, 7 difference of the growth rate.
    """
    lv = log_positive(value)

    def diff(x: Column) -> Column:
        return x - F.lag(x, 1).over(w)

    def diff2(x: Column) -> Column:
        return diff(x) - (F.lag(x, 1).over(w) - F.lag(x, 2).over(w))

    v1, v2 = F.lag(value, 1).over(w), F.lag(value, 2).over(w)
    growth_change = (ratio(value, v1) - 1.0) - (ratio(v1, v2) - 1.0)
    return (
        F.when(code == 1, value)
        .when(code == 2, diff(value))
        .when(code == 3, diff2(value))
        .when(code == 4, lv)
        .when(code == 5, diff(lv))
        .when(code == 6, diff2(lv))
        .when(code == 7, growth_change)
        .otherwise(
            F.raise_error(
                F.concat(F.lit("unknown transform code: "), F.coalesce(code.cast("string"), F.lit("null")))
            ).cast("double")
        )
    )


def apply_tcodes(df: DataFrame, keys: list[str], value: str = "value", code: str = "tcode", out: str = "transformed") -> DataFrame:
    return df.withColumn(out, tcode(F.col(value), F.col(code), by_date(keys)))


def lag_panel(df: DataFrame, keys: list[str], months: int = 1) -> DataFrame:
    """Uniform publication lag on a dense panel."""
    return df.withColumn("value", F.lag("value", months).over(by_date(keys)))


def ffill(value: str, keys: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(upto_now(keys))


def ffill_bfill(value: str, keys: list[str]) -> Column:
    ahead = by_date(keys).rowsBetween(0, Window.unboundedFollowing)
    return F.coalesce(ffill(value, keys), F.first(value, ignorenulls=True).over(ahead))


def availability_mask(value: str, keys: list[str]) -> Column:
    """True where a missing value lies before the first or after the last valid one."""
    whole = Window.partitionBy(*keys)
    seen = F.when(F.col(value).isNotNull(), F.col("date"))
    first, last = F.min(seen).over(whole), F.max(seen).over(whole)
    outside = first.isNull() | (F.col("date") < first) | (F.col("date") > last)
    return F.col(value).isNull() & outside


def running_medians(values: list[float | None], gap: int) -> list[float | None]:
    """Median of the present values more than ``gap`` places before each place; None where there is none.

    One ordered list takes each value once, by binary search.
    """
    seen: list[float] = []
    out: list[float | None] = []
    for i in range(len(values)):
        new = values[i - gap - 1] if i > gap else None
        if new is not None and new == new:
            insort(seen, new)
        n = len(seen)
        low, high = (seen[(n - 1) // 2], seen[n // 2]) if n else (None, None)
        out.append(low + (high - low) * 0.5 if n else None)
    return out


def training_median(df: DataFrame, keys: list[str], gap: int, all_missing: float = 0.0, value: str = "value", out: str = "fill") -> DataFrame:
    """Add the median of the rows an origin trains on; a constant when there is none.

    Exact. A key's months (one row each, so bounded by the calendar) are gathered once and their medians follow from one
    ordered list that grows month by month, instead of a sorted list per row. NULL and NaN count as missing.
    """
    @F.pandas_udf("array<double>")
    def medians(lists: pd.Series) -> pd.Series:
        return pd.Series([running_medians(list(x), gap) for x in lists], dtype=object)

    columns = df.columns
    months = F.sort_array(F.collect_list(F.struct("date", *[c for c in columns if c not in (*keys, "date")])))
    rows = df.groupBy(*keys).agg(months.alias("_rows"))
    listed = F.transform("_rows", lambda r: r[value].cast("double"))
    rows = rows.withColumn("_medians", medians(listed)).select(*keys, F.explode(F.arrays_zip("_rows", "_medians")).alias("_r"))
    fill = F.coalesce(F.col("_r._medians"), F.lit(all_missing)).alias(out)
    return rows.select(*[F.col(c) if c in keys else F.col("_r._rows")[c].alias(c) for c in columns], fill)


def impute_training_median(df: DataFrame, keys: list[str], gap: int = 0, keep_timing: bool = True, all_missing: float = 0.0) -> DataFrame:
    """Per origin: fill value, availability mask and the imputed cell of the origin's own row."""
    # the mask's window first: its partitioning serves the grouping too, while Python's output has none
    masked = df.withColumn("masked", availability_mask("value", keys))
    out = training_median(masked, keys, gap, all_missing).select(*df.columns, "fill", "masked")
    filled = F.coalesce("value", "fill")
    return out.withColumn(
        "imputed", F.when(F.col("masked"), F.lit(None)).otherwise(filled) if keep_timing else filled
    )


def training_complete(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """(origin, keys) pairs whose training rows have no missing value."""
    w = training_rows(keys, gap)
    return (
        df.select(
            F.col("date").alias("origin"), *keys,
            F.count("value").over(w).alias("_valid"), F.count(F.lit(1)).over(w).alias("n_train"),
        )
        .where((F.col("n_train") > 0) & (F.col("_valid") == F.col("n_train")))
        .drop("_valid")
    )


def rolling_mean(value: str, keys: list[str], k: int) -> Column:
    """Mean of the last ``k`` rows, fewer at the start."""
    return F.avg(value).over(by_date(keys).rowsBetween(-(k - 1), 0))


def zscore(value: str, keys: list[str]) -> Column:
    """Population z-score; NULL for a constant series."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 1e-12 * F.greatest(F.lit(1.0), F.abs(F.avg(value).over(w))), (F.col(value) - F.avg(value).over(w)) / sd)


def block_composite(df: DataFrame, group: str = "grp", series: str = "series") -> DataFrame:
    """Equal-weight mean of z-scores per date and group; missing or constant counts as zero."""
    z = df.withColumn("_z", F.coalesce(zscore("value", [group, series]), F.lit(0.0)))
    return z.groupBy("date", group).agg(F.avg("_z").alias("value"))


def category_average(df: DataFrame, group: str = "grp", series: str = "series") -> DataFrame:
    """Mean of z-scores per date and group over the series present; a constant series scores zero."""
    z = F.when(F.col("value").isNotNull(), F.coalesce(zscore("value", [group, series]), F.lit(0.0)))
    return df.withColumn("_z", z).groupBy("date", group).agg(F.avg("_z").alias("value"))


def jumps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Moves between consecutive valid positive values with the tags on both sides."""
    w = by_date(keys)
    valid = df.where(F.col("value").isNotNull()).select(
        *keys, "date", "value", F.coalesce("tag", F.lit("MISSING")).alias("tag"),
        F.lag("date").over(w).alias("prev_date"),
        F.lag("value").over(w).alias("prev_value"),
        F.lag(F.coalesce("tag", F.lit("MISSING"))).over(w).alias("prev_tag"),
    )
    growth = F.col("value") / F.col("prev_value")
    return valid.where((F.col("value") > 0) & (F.col("prev_value") > 0)).select(
        "*",
        F.abs(F.log(growth)).alias("log_jump_abs"),
        (F.lit(100.0) * (growth - 1.0)).alias("pct_change"),
        (F.col("tag") != F.col("prev_tag")).alias("tag_changed"),
    )


def top_jumps(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` largest jumps of each series."""
    w = Window.partitionBy(*keys).orderBy(F.round("log_jump_abs", 9).desc(), "date")
    return jumps(df, keys).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tag_runs(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stretches of equal tag: first month, last month, length."""
    w = by_date(keys)
    tag = F.coalesce("tag", F.lit("MISSING"))
    starts = df.withColumn("tag", tag).withColumn(
        "_new", (~F.col("tag").eqNullSafe(F.lag("tag").over(w))).cast("int")
    )
    runs = starts.withColumn("_run", F.sum("_new").over(upto_now(keys)))
    return (
        runs.groupBy(*keys, "_run", "tag")
        .agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("months"))
        .drop("_run")
    )


def max_abs_diff(df: DataFrame, keys: list[str], out: str = "max_abs_diff") -> DataFrame:
    """Largest absolute month-to-month difference per series."""
    d = F.abs(F.col("value") - F.lag("value").over(by_date(keys)))
    return df.withColumn("_d", d).groupBy(*keys).agg(F.max("_d").alias(out))
