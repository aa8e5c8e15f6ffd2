"""Seed ensembles: which seeds are in, and what they forecast together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_number, per_month
from .panel import densify
from .transforms import by_date

CELL = ["date", "maturity"]


def rank_by(df: DataFrame, loss: str, keys: list[str] = CELL) -> DataFrame:
    """Rank seeds by a loss, lowest first, ties by seed; seeds without a loss are left out.

    A cell holds one row per seed. Losses are compared at twelve decimals, so the order in which a
    mean was summed cannot decide a tie.
    """
    w = Window.partitionBy(*keys).orderBy(F.round(loss, 12), "seed")
    return df.where(F.col(loss).isNotNull()).withColumn("rank", F.row_number().over(w))


def members_by_validation(df: DataFrame, k: int) -> DataFrame:
    """Top-k seeds of each date and maturity by validation loss."""
    return rank_by(df, "val_loss").where(F.col("rank") <= k)


def members_total(df: DataFrame, k: int) -> DataFrame:
    """One seed set per date, by the mean loss over maturities."""
    mean = df.groupBy("date", "seed").agg(F.avg("val_loss").alias("_l"))
    chosen = rank_by(mean, "_l", ["date"]).where(F.col("rank") <= k).select("date", "seed", "rank")
    return df.join(chosen, ["date", "seed"])


def trailing_losses(df: DataFrame, truth: DataFrame, lookback: int, lag: int) -> DataFrame:
    """Mean squared error and count of each seed over the ``lookback`` months known ``lag`` months
    before (rows t-lag-lookback .. t-lag-1), on the full calendar."""
    cells = densify(df, ["seed", "maturity"], ["y_hat", "val_loss"])
    scored = cells.join(truth.select("date", "maturity", "y"), ["date", "maturity"], "left").withColumn(
        "_e2", F.pow(F.col("y") - F.col("y_hat"), 2)
    )
    back = by_date(["seed", "maturity"]).rowsBetween(-(lag + lookback), -(lag + 1))
    return scored.withColumn("trail_mse", F.avg("_e2").over(back)).withColumn("trail_n", F.count("_e2").over(back)).drop("_e2")


def members_by_trailing(df: DataFrame, truth: DataFrame, k: int, lookback: int = 120, min_history: int = 24, lag: int = 0, fallback: bool = True) -> DataFrame:
    """Top-k seeds by trailing error; where no seed has enough history the whole cell falls back to
    validation loss (or stays empty)."""
    t = trailing_losses(df, truth, lookback, lag)
    loss = F.when(F.col("trail_n") >= min_history, F.col("trail_mse"))
    t = t.withColumn("_trail", loss)
    any_trail = F.count("_trail").over(Window.partitionBy(*CELL)) > 0
    other = F.col("val_loss") if fallback else F.lit(None).cast("double")
    t = t.withColumn("by_trailing", any_trail).withColumn("_loss", F.when(F.col("by_trailing"), F.col("_trail")).otherwise(other))
    return rank_by(t, "_loss").where(F.col("rank") <= k).drop("_trail", "_loss", "trail_mse", "trail_n", "y")


def members_total_by_trailing(df: DataFrame, truth: DataFrame, k: int, lookback: int = 120, min_history: int = 24, lag: int = 0) -> DataFrame:
    """One seed set per date by trailing error pooled over maturities, else by mean validation loss."""
    cells = densify(df, ["seed", "maturity"], ["y_hat", "val_loss"])
    scored = cells.join(truth.select("date", "maturity", "y"), CELL, "left").withColumn("_e2", F.pow(F.col("y") - F.col("y_hat"), 2))
    per = scored.groupBy("seed", "date").agg(F.sum("_e2").alias("_s"), F.count("_e2").alias("_c"), F.avg("val_loss").alias("_v"))
    back = by_date(["seed"]).rowsBetween(-(lag + lookback), -(lag + 1))
    per = per.withColumn("_n", F.sum("_c").over(back)).withColumn("_mse", F.try_divide(F.sum("_s").over(back), F.col("_n")))
    per = per.withColumn("_t", F.when(F.col("_n") >= min_history, F.col("_mse")))
    use = F.count("_t").over(Window.partitionBy("date")) > 0
    per = per.withColumn("_loss", F.when(use, F.col("_t")).otherwise(F.col("_v")))
    chosen = rank_by(per, "_loss", ["date"]).where(F.col("rank") <= k).select("date", "seed", "rank")
    return cells.join(chosen, ["date", "seed"])


def combine(members: DataFrame, value: str = "y_hat") -> DataFrame:
    """Ensemble forecast: mean over the members that forecast."""
    return members.groupBy(*CELL).agg(F.avg(value).alias("y_hat"), F.count("*").alias("members"))


def combine_many_k(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """Ensembles of several sizes from one ranking."""
    aggs = [F.avg(F.when(F.col("rank") <= k, F.col("y_hat"))).alias(f"k{k}") for k in ks]
    wide = ranked.where(F.col("rank") <= max(ks)).groupBy(*CELL).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("y_hat")) for k in ks])
    return wide.select(*CELL, F.explode(rows).alias("_r")).select(*CELL, "_r.k", "_r.y_hat")


def expanding_quantiles(df: DataFrame, value: str, qs: dict[str, float], bins: int = 512) -> DataFrame:
    """Exact quantiles, by linear interpolation, of all values up to each date (date, one column per q).

    Equal values of a date are counted first. Counts per value bin, cumulated over dates, say in
    which bin a date's order statistic lies; only that bin's values are then joined to the date.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy("date", F.col(value).alias("v")).agg(F.count("*").alias("c"))
    # edges from the data, so an outlier cannot empty the other bins; any edges give the exact result
    binned = counts.withColumn("bin", F.lit(0))
    if bins > 1:
        edges = counts.select(F.array_distinct(F.percentile_approx("v", [i / bins for i in range(1, bins)], 100 * bins))).scalar()
        binned = counts.withColumn("_e", edges).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col("v")))).drop("_e")
    hist = binned.groupBy("bin", "date").agg(F.sum("c").alias("c"))
    full = densify(hist, ["bin"], ["c"])
    grow = Window.partitionBy("bin").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    cum = full.withColumn("cum", F.coalesce(F.sum("c").over(grow), F.lit(0)))
    across = Window.partitionBy("date").orderBy("bin")
    placed = cum.withColumn("below", F.sum("cum").over(across) - F.col("cum")).withColumn(
        "n", F.sum("cum").over(Window.partitionBy("date"))
    )
    want = []
    for name, q in qs.items():
        at = (F.col("n") - 1) * F.lit(q)
        want += [
            F.struct(F.lit(name).alias("q"), F.lit("lo").alias("side"), F.floor(at).alias("k"), (at - F.floor(at)).alias("frac")),
            F.struct(F.lit(name).alias("q"), F.lit("hi").alias("side"), F.ceil(at).alias("k"), (at - F.floor(at)).alias("frac")),
        ]
    asked = placed.where(F.col("cum") > 0).select("date", "bin", "below", "cum", F.explode(F.array(*want)).alias("w")).where(
        (F.col("w.k") >= F.col("below")) & (F.col("w.k") < F.col("below") + F.col("cum"))
    ).select(F.col("date").alias("at"), "bin", "w.q", "w.side", "w.frac", (F.col("w.k") - F.col("below")).alias("k"))
    inside = asked.join(binned, "bin").where(F.col("date") <= F.col("at")).groupBy("at", "q", "side", "frac", "k", "v").agg(F.sum("c").alias("c"))
    run = Window.partitionBy("at", "q", "side").orderBy("v")
    stat = inside.withColumn("_cum", F.sum("c").over(run)).where(F.col("_cum") > F.col("k")).groupBy("at", "q", "frac").agg(
        F.min(F.when(F.col("side") == "lo", F.col("v"))).alias("a"), F.min(F.when(F.col("side") == "hi", F.col("v"))).alias("b")
    )
    out = stat.withColumn("x", F.col("a") + (F.col("b") - F.col("a")) * F.col("frac"))
    return out.groupBy(F.col("at").alias("date")).agg(*[F.max(F.when(F.col("q") == n, F.col("x"))).alias(n) for n in qs])


def combine_winsorised(members: DataFrame, cube: DataFrame, q_low: float = 0.001, q_high: float = 0.999) -> DataFrame:
    """Ensemble of members clipped to quantiles of every seed's forecasts up to the date."""
    bounds = per_month(expanding_quantiles(cube, "y_hat", {"lo": q_low, "hi": q_high}))
    clipped = members.join(bounds, "date").withColumn("y_hat", F.greatest(F.least("y_hat", "hi"), "lo"))
    return combine(clipped)


def turnover(members: DataFrame) -> DataFrame:
    """Members that were not members the month before; zero in the first month of a maturity."""
    at = month_number("date")
    before = F.lag(at).over(Window.partitionBy("maturity", "seed").orderBy("date"))
    first = F.min(at).over(Window.partitionBy("maturity"))
    new = (before.isNull() | (before < at - 1)) & (at > first)
    return members.withColumn("_new", new).groupBy(*CELL).agg(F.count(F.when(F.col("_new"), 1)).alias("replaced"))


def latest_snapshot(snapshots: DataFrame, keys: list[str], order: str, seeds: list[int] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Newest snapshot of each key after optional filters on seed and refit number."""
    s = snapshots
    if seeds is not None:
        s = s.where(F.col("seed").isin(seeds))
    if first is not None:
        s = s.where(F.col(order) >= first)
    if last is not None:
        s = s.where(F.col(order) <= last)
    rest = [c for c in s.columns if c not in keys]
    newest = s.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_s"))
    return newest.select(*keys, "_s.*")


def seed_r2(df: DataFrame, keys: list[str]) -> DataFrame:
    from .scoring import both, r2

    return df.groupBy(*keys).agg(r2(both()).alias("r2"), F.count(F.when(both(), 1)).alias("n"))
