"""Long-panel shaping: slicing, densifying, resampling, renaming, aligning, reshaping.

A panel holds one row per key and month, so every per-key group here is bounded by the
number of calendar months, however many raw rows one key has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_end, spine_bounds, with_months


def slice_months(df: DataFrame, start: str, end: str, raw_date: str, out: str = "date") -> DataFrame:
    """Snap dates to month-end and keep ``start``..``end`` inclusive.

    The bound is put on the raw column, so it reaches the file scan.
    """
    lo = F.trunc(F.lit(start).cast("date"), "MM")
    hi = F.add_months(F.trunc(F.lit(end).cast("date"), "MM"), 1)
    return df.where((F.col(raw_date) >= lo) & (F.col(raw_date) < hi)).withColumn(
        out, month_end(raw_date)
    )


def densify(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    start: str | Column | None = None,
    end: str | Column | None = None,
    own_span: bool = False,
) -> DataFrame:
    """Complete each key to every month from ``start`` to ``end`` with NULL values.

    Without bounds all keys share the panel's first and last month (``own_span`` keeps each
    key's own). One shuffle on the keys serves this and any later window over the same keys.
    """
    as_date = lambda c: F.lit(c).cast("date") if isinstance(c, str) else c
    lo, hi = as_date(start), as_date(end)
    if not own_span and (lo is None or hi is None):
        first, last = spine_bounds(df)
        lo, hi = (first if lo is None else lo), (last if hi is None else hi)
    cells = F.map_from_entries(F.collect_list(F.struct("date", F.struct(*values))))
    g = df.groupBy(*keys).agg(cells.alias("_m"), F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    spread = with_months(g, F.col("_lo") if own_span else lo, F.col("_hi") if own_span else hi)
    cell = F.try_element_at("_m", F.col("date"))
    return spread.select(*keys, "date", *[cell[v].alias(v) for v in values])


def resample_last(df: DataFrame, keys: list[str], ts: str, value: str, tie: list[str] = ()) -> DataFrame:
    """Last observation of each key and month.

    Ordered by the timestamp as one long, which hash-aggregates raw rows; tie columns, where equal
    timestamps must be told apart, cost a sort.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, month_end(ts).alias("date"))
        .agg(F.max_by(value, F.struct(at, *tie) if tie else at).alias(value))
    )


def drop_series(df: DataFrame, names: list[str], extra: list[str] = (), col: str = "series") -> DataFrame:
    """Leave out default and extra series; names that are absent do not matter."""
    drop = list(dict.fromkeys([*names, *extra]))
    return df.where(~F.col(col).isin(drop)) if drop else df


def coalesce_aliases(df: DataFrame, aliases: dict[str, str], position: str, col: str = "series", keys: list[str] = ("date",)) -> DataFrame:
    """Rename aliases and merge columns that now share a name: first non-null by position."""
    old = F.col(col)
    renamed = F.coalesce(*[F.when(old == k, F.lit(v)) for k, v in aliases.items()], old)
    first = F.min_by(F.col("value"), F.when(F.col("value").isNotNull(), F.col(position)))
    return df.withColumn(col, renamed).groupBy(*keys, col).agg(first.alias("value"))


def common_dates(*frames: DataFrame) -> DataFrame:
    """Dates every frame has."""
    out = frames[0].select("date").distinct()
    for f in frames[1:]:
        out = out.intersect(f.select("date"))
    return out


def align_common_dates(blocks: dict[str, DataFrame]) -> DataFrame:
    """Stack long blocks (date, series, value) with a source column on their common dates."""
    keep = common_dates(*blocks.values())
    rows = None
    for name, block in blocks.items():
        part = block.select(F.lit(name).alias("source"), "date", "series", "value")
        rows = part if rows is None else rows.unionByName(part)
    return rows.join(keep, "date", "left_semi")


def pivot_wide(df: DataFrame, keys: list[str], on: str, values: list, value: Column) -> DataFrame:
    """Long to wide with an explicit list of output columns."""
    return df.groupBy(*keys).pivot(on, values).agg(value)


def unpivot_long(df: DataFrame, keys: list[str], cols: list[str], var: str, value: str) -> DataFrame:
    return df.unpivot(keys, cols, var, value).where(F.col(value).isNotNull())


def select_dates(dates: DataFrame, selector: str | list[str]) -> DataFrame:
    """Dates picked by ``all``, ``every_nth:n``, ``spaced:k`` or an explicit list.

    ``dates`` is a calendar (at most a few thousand rows). A listed date outside it fails
    the query.
    """
    d = dates.select("date").distinct()
    if not isinstance(selector, str):
        asked = F.explode(F.array(*[F.lit(s).cast("date") for s in selector]))
        spark = dates.sparkSession
        want = spark.range(1).select(asked.alias("date"))
        found = d.withColumn("_in", F.lit(True))
        checked = want.join(found, "date", "left").select(
            F.when(F.col("_in"), F.col("date"))
            .otherwise(F.raise_error(F.concat(F.lit("date outside the calendar: "), F.col("date").cast("string"))).cast("date"))
            .alias("date")
        )
        return checked
    if selector == "all":
        return d
    kind, _, arg = selector.partition(":")
    ordered = d.agg(F.array_sort(F.collect_list("date")).alias("ds"))
    n = F.size("ds")
    if kind == "every_nth" and arg.isdigit() and int(arg) > 0:
        picked = F.filter("ds", lambda x, i: i % int(arg) == 0)
    elif kind == "spaced" and arg.lstrip("-").isdigit():
        k = int(arg)
        if k <= 0:
            return d.limit(0)
        if k == 1:
            picked = F.slice("ds", 1, 1)
        else:
            step = (n - 1).cast("double") / F.lit(float(k - 1))
            at = F.transform(
                F.sequence(F.lit(0), F.lit(k - 1)),
                lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i * step).cast("int")),
            )
            picked = F.array_distinct(F.transform(at, lambda i: F.get("ds", i)))
    else:
        raise ValueError(f"unknown date selector: {selector!r}")
    return ordered.select(F.explode(picked).alias("date"))


def latest_at_or_before(events: DataFrame, at: DataFrame, keys: list[str], time: str, cols: list[str]) -> DataFrame:
    """As-of join: for each row of ``at`` the last event of its keys at or before ``time``.

    Both sides are interleaved and carried forward by one window, so no range join is formed.
    Events of one key and time are merged before the shuffle.
    """
    payload = F.struct(F.col(time).alias("_at"), *cols)
    e = events.groupBy(*keys, time).agg(*[F.first(c).alias(c) for c in cols]) if cols else events.select(*keys, time).distinct()
    e = e.select(*keys, time, F.lit(0).alias("_side"), payload.alias("_ev"))
    extra = [c for c in at.columns if c not in keys and c != time]
    a = at.select(*keys, time, F.lit(1).alias("_side"), F.struct(F.lit(1).alias("_one"), *extra).alias("_keep"))
    both = e.unionByName(a, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_ev", F.last("_ev", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    return out.select(
        *keys, time, *[F.col("_keep")[c].alias(c) for c in extra],
        F.col("_ev._at").alias(f"{time}_found"), *[F.col("_ev")[c].alias(c) for c in cols],
    )
