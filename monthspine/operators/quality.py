"""Coverage, revision and missingness audits of histories and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.calendar import per_month
from ..functions.columns import ratio
from .transforms import by_date, jumps


def _n(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


# ---- histories --------------------------------------------------------------------------------


def coverage_summary(history: DataFrame) -> DataFrame:
    """Rows and first/last observation and vintage per series."""
    return history.groupBy("series_id").agg(
        F.count("*").alias("n_rows"), F.min("obs_date").alias("obs_min"), F.max("obs_date").alias("obs_max"),
        F.min("realtime_start").alias("realtime_min"), F.max("realtime_start").alias("realtime_max"),
    )


def availability_audit(history: DataFrame) -> DataFrame:
    return history.groupBy("series_id").agg(
        F.count("*").alias("n_obs"), F.min("obs_date").alias("obs_min_date"), F.max("obs_date").alias("obs_max_date"),
        F.lit(True).alias("has_vintages"),
    )


def revision_audit(history: DataFrame) -> DataFrame:
    """Observations with more than one vintage and the most vintages of one observation."""
    per_obs = history.groupBy("series_id", "obs_date").agg(F.countDistinct("realtime_start").alias("_v"))
    return per_obs.groupBy("series_id").agg(
        _n(F.col("_v") > 1).alias("obs_with_revisions"), F.max("_v").alias("max_revisions_per_obs")
    )


def archive_coverage(archive: DataFrame) -> DataFrame:
    """Series held by each archived snapshot."""
    return archive.select("vintage_month", "series_id").distinct().groupBy("vintage_month").agg(
        F.count("*").alias("series_columns")
    )


# ---- dense panels (series, date, value, tag) ----------------------------------------------------


def panel_shape(dense: DataFrame) -> DataFrame:
    """Missing cells, series and months of a dense panel."""
    return dense.groupBy("series").agg(
        F.count("*").alias("_r"), _n(F.col("value").isNull()).alias("_n")
    ).agg(F.sum("_n").alias("nulls"), F.count("*").alias("cols"), F.max("_r").alias("rows"))


def source_mix(cells: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Cells per tag with their share in percent, overall or per key."""
    counts = cells.groupBy(*keys, F.coalesce("tag", F.lit(fv.TAG_MISSING)).alias("tag")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counts.withColumn("share_pct", F.lit(100.0) * F.col("n") / F.sum("n").over(whole))


def series_quality(dense: DataFrame, key: str = "series") -> DataFrame:
    """One row per series: span, missing months, dominant tag, tag switches and largest jump."""
    tag = F.coalesce("tag", F.lit(fv.TAG_MISSING))
    w = by_date([key])
    d = dense.select(key, "date", "value", tag.alias("tag")).withColumn("_sw", F.col("tag") != F.lag("tag").over(w))
    seen = F.when(F.col("value").isNotNull(), F.col("date"))
    base = d.groupBy(key).agg(
        F.min(seen).alias("first_valid"), F.max(seen).alias("last_valid"), F.count("value").alias("non_missing_months"),
        _n(F.col("value").isNull()).alias("missing_months"), F.avg(F.col("value").isNull().cast("int")).alias("missing_share"),
        F.countDistinct("tag").alias("distinct_tags"), _n(F.col("_sw")).alias("tag_switches"),
    )
    tags = d.groupBy(key, "tag").agg(F.count("*").alias("_c"))
    dominant = tags.groupBy(key).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col("tag").alias("t")))["t"].alias("dominant_tag"))
    top = jumps(dense, [key]).groupBy(key).agg(
        F.max_by(F.struct("date", "log_jump_abs", "pct_change", "tag_changed", "prev_tag", "tag"),
                 F.struct(F.round("log_jump_abs", 9), -F.unix_date("date"))).alias("_j")
    )
    return base.join(dominant, key).join(top, key, "left").select(
        *base.columns, "dominant_tag", F.col("_j.date").alias("max_jump_date"), F.col("_j.log_jump_abs").alias("max_log_jump"),
        F.col("_j.pct_change").alias("max_pct_change"), F.coalesce(F.col("_j.tag_changed"), F.lit(False)).alias("jump_tag_changed"),
        F.col("_j.prev_tag").alias("jump_prev_tag"), F.col("_j.tag").alias("jump_tag"),
    )


def fault_missing(quality: DataFrame, warn: float = 0.20, n: int = 15) -> DataFrame:
    """Series with the largest missing share at or above the threshold."""
    hits = quality.where(F.col("missing_share") >= warn)
    return hits.orderBy(F.round("missing_share", 9).desc(), F.round("max_log_jump", 9).desc(), "series").limit(n).select(
        "series", "missing_months", "missing_share", "tag_switches"
    )


def fault_jumps(quality: DataFrame, warn: float = 0.75, n: int = 15) -> DataFrame:
    """Series with a jump at or above the threshold, most incomplete first."""
    hits = quality.where(F.col("max_log_jump") >= warn)
    return hits.orderBy(F.round("missing_share", 9).desc(), F.round("max_log_jump", 9).desc(), "series").limit(n).select(
        "series", "max_jump_date", "max_pct_change", "max_log_jump", "jump_tag_changed", "jump_prev_tag", "jump_tag"
    )


def worst_dates(dense: DataFrame, n: int = 15) -> DataFrame:
    """Dates with the largest share of missing series."""
    g = dense.groupBy("date").agg(F.avg(F.col("value").isNull().cast("int")).alias("missing_share"))
    return g.orderBy(F.round("missing_share", 9).desc(), "date").limit(n)


def missingness_summary(panel: DataFrame, label: str) -> DataFrame:
    """Cells of a panel missing after the transform, in the source, and through the transform only."""
    gone, source = F.col("transformed").isNull(), F.col("tag") == fv.TAG_MISSING
    g = panel.groupBy("series").agg(
        F.count("*").alias("_r"), _n(gone).alias("_t"), _n(source).alias("_s"), _n(gone & ~source).alias("_o")
    ).agg(
        F.max("_r").alias("rows"), F.count("*").alias("cols"), F.sum("_r").alias("total_cells"),
        F.sum("_t").alias("transformed_nulls"), F.sum("_s").alias("source_missing"), F.sum("_o").alias("transform_only"),
    )
    pct = lambda c: ratio(100.0 * F.col(c), F.col("total_cells"))
    return g.select(
        F.lit(label).alias("panel"), "*", pct("transformed_nulls").alias("transformed_null_pct"),
        pct("source_missing").alias("source_missing_pct"), pct("transform_only").alias("transform_only_pct"),
    )


def missing_by(panel: DataFrame, key: str) -> DataFrame:
    """Missing cells per series or per date, and those due to the transform only."""
    gone = F.col("transformed").isNull()
    return panel.groupBy(key).agg(
        _n(gone).alias("missing"), _n(gone & (F.col("tag") != fv.TAG_MISSING)).alias("transform_only")
    )


def complete_columns(panels: DataFrame, measure: str) -> DataFrame:
    """Series without a single missing cell, over all rows given."""
    g = panels.groupBy("series").agg(_n(F.col("transformed").isNull()).alias("_n"))
    return g.agg(
        F.lit(measure).alias("measure"), _n(F.col("_n") == 0).alias("complete_columns"), F.count("*").alias("total_columns")
    )


def diag_checks(balanced: DataFrame) -> DataFrame:
    """Checks of a balanced panel as (check, passed, detail) rows from one aggregation."""
    g = balanced.agg(
        _n(F.col("value").isNull()).alias("miss"), _n(F.col("tag") == fv.TAG_RELEASE_GAP).alias("gap"),
        _n(F.col("tag") == fv.TAG_PRE_VINTAGE).alias("pre"),
    )
    row = lambda check, passed, word, c: F.struct(
        F.lit(check).alias("check"), passed.alias("passed"), F.concat(F.lit(word), F.col(c).cast("string")).alias("detail")
    )
    return g.select(F.explode(F.array(
        row("balanced_no_nans", F.col("miss") == 0, "remaining_missing=", "miss"),
        row("release_gap_fills", F.lit(True), "count=", "gap"),
        row("pre_vintage_fills", F.lit(True), "count=", "pre"),
    )).alias("_c")).select("_c.*")


# ---- training sets ----------------------------------------------------------------------------


def membership_changes(selected: DataFrame, origins: DataFrame, key: str = "series") -> DataFrame:
    """Series entering and leaving the training set between consecutive origins.

    ``selected`` is (origin, key), ``origins`` the calendar of origins. Runs are found per series, so
    the set of one origin is never gathered.
    """
    nxt = Window.orderBy("origin")
    cal = per_month(origins.select("origin").distinct().select(
        "origin", F.lag("origin").over(nxt).alias("_prev"), F.lead("origin").over(nxt).alias("_next")
    ))
    w = Window.partitionBy(key).orderBy("origin")
    s = selected.select("origin", key).join(cal, "origin").withColumn("_b", F.lag("origin").over(w)).withColumn("_a", F.lead("origin").over(w))
    events = F.array_compact(F.array(
        F.when(F.col("_prev").isNotNull() & ~F.col("_b").eqNullSafe(F.col("_prev")), F.struct(F.col("origin").alias("origin"), F.lit("enter").alias("event"))),
        F.when(F.col("_next").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_next")), F.struct(F.col("_next").alias("origin"), F.lit("exit").alias("event"))),
    ))
    return s.select(key, F.explode(events).alias("_e")).select("_e.origin", key, "_e.event")


def membership_counts(selected: DataFrame, changes: DataFrame, origins: DataFrame) -> DataFrame:
    """Size of the training set, entries and exits per origin."""
    size = selected.groupBy("origin").agg(F.count("*").alias("n_train"))
    moves = changes.groupBy("origin").agg(_n(F.col("event") == "enter").alias("n_new"), _n(F.col("event") == "exit").alias("n_exit"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return origins.select("origin").distinct().join(size, "origin", "left").join(moves, "origin", "left").select(
        "origin", zero("n_train"), zero("n_new"), zero("n_exit")
    )


def never_selected(names: DataFrame, selected: DataFrame, key: str = "series") -> DataFrame:
    return names.select(key).distinct().join(selected.select(key), key, "left_anti")


def count_mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """Origins where two scans select different numbers of series."""
    size = lambda s, out: s.groupBy("origin").agg(F.count("*").alias(out))
    both = size(a, "n_a").join(size(b, "n_b"), "origin", "full_outer")
    return both.where(F.coalesce(F.col("n_a") - F.col("n_b"), F.lit(0)) != 0)


# ---- revisions --------------------------------------------------------------------------------


def revision_stats(panels: DataFrame, revised: DataFrame) -> DataFrame:
    """Per (forecast date, series): level, spread and persistence of as-of against revised values.

    ``panels`` is (forecast_date, date, series, transformed), ``revised`` (date, series, revised). Only
    months valid on both sides count; with fewer than three all statistics are NULL. Persistence
    runs over those months in order.
    """
    keys = ["forecast_date", "series"]
    rows = panels.join(revised, ["date", "series"], "left").select(*keys, "date", F.col("transformed").alias("rt"), F.col("revised").alias("rev"))
    both = F.col("rt").isNotNull() & F.col("rev").isNotNull()
    w = Window.partitionBy(*keys, "_both").orderBy("date")
    d = rows.withColumn("_both", both).select(
        "*", F.when(both, F.col("rev") - F.col("rt")).alias("_d"),
        F.when(both, F.lag("rt").over(w)).alias("_rt1"), F.when(both, F.lag("rev").over(w)).alias("_rev1"),
    )
    on = lambda c: F.when(F.col("_both"), F.col(c))

    def acf(x: str, lag: str) -> list[Column]:
        pair = F.col(lag).isNotNull()
        a, b = F.when(pair, F.col(x)), F.col(lag)
        return [F.covar_pop(a, b).alias(f"{x}_c"), F.stddev_pop(a).alias(f"{x}_s"), F.stddev_pop(b).alias(f"{x}_s1")]

    g = d.groupBy(*keys).agg(
        _n(F.col("_both")).alias("n_obs"), F.avg(F.col("rt").isNull().cast("int")).alias("missing_rt"),
        F.avg(F.col("rev").isNull().cast("int")).alias("missing_rev"),
        F.avg(on("rt")).alias("rt_mean"), F.avg(on("rev")).alias("rev_mean"), F.avg("_d").alias("revision_mean"),
        F.stddev_samp(on("rt")).alias("rt_sd"), F.stddev_samp(on("rev")).alias("rev_sd"), F.stddev_samp("_d").alias("revision_sd"),
        F.avg(F.abs("_d")).alias("mae_revision"), *acf("rt", "_rt1"), *acf("rev", "_rev1"),
    )
    ok = F.col("n_obs") >= 3
    corr = lambda x: F.when(ok & (F.col(f"{x}_sd") > 0), ratio(F.col(f"{x}_c"), F.col(f"{x}_s") * F.col(f"{x}_s1")))
    g = g.withColumn("rt_acf1", corr("rt")).withColumn("rev_acf1", corr("rev")).withColumn("acf1_diff", F.col("rev_acf1") - F.col("rt_acf1"))
    stats = ["rt_mean", "rev_mean", "revision_mean", "rt_sd", "rev_sd", "revision_sd", "mae_revision"]
    return g.select(*keys, "n_obs", "missing_rt", "missing_rev", *[F.when(ok, F.col(c)).alias(c) for c in stats], "rt_acf1", "rev_acf1", "acf1_diff")


def revision_by_group(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """Averages over forecast dates per series, then over the series of a group."""
    per = stats.groupBy("series").agg(
        *[F.avg(c).alias(c) for c in ["rt_acf1", "acf1_diff", "rt_sd", "rev_sd", "revision_sd", "mae_revision"]]
    )
    per = per.withColumn("noise", ratio(F.col("revision_sd"), F.col("rt_sd"))).withColumn("vol", ratio(F.col("rev_sd"), F.col("rt_sd")))
    return per.join(groups, "series").groupBy("grp").agg(
        F.avg("rt_acf1").alias("avg_rt_ar1"), F.avg("acf1_diff").alias("avg_ar1_diff"),
        F.avg("vol").alias("avg_volatility_ratio"), F.avg("noise").alias("avg_revision_noise"), F.avg("mae_revision").alias("avg_mae"),
    )
