"""Attribution tables: exact Shapley values, seed averages, block shares and stability.

Rows are (date, maturity, seed, feature, shap_value). Blocks are read off the feature path;
``forward`` is the block of forward rates, everything else is macro.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import feature_block, feature_display, ratio
from .panel import densify
from .transforms import by_date

FORWARD = "forward"
CELL = ["date", "maturity"]


def with_block(df: DataFrame, out: str = "grp") -> DataFrame:
    return df.withColumn(out, feature_block("feature"))


def macro_only(df: DataFrame, keep_forward: bool = False, block: str = "grp") -> DataFrame:
    return df if keep_forward else df.where(F.col(block) != FORWARD)


# ---- exact Shapley ----------------------------------------------------------------------------


def coalition_values(players: DataFrame, keys: list[str], n: int, interaction: Column | None = None) -> DataFrame:
    """Value of every coalition of ``n`` players under a linear score (keys, bits, v).

    ``players`` has (keys, player 0..n-1, inside, outside): a player's contribution when it is in the
    coalition and its background contribution otherwise. 2^n rows per key are the table itself.
    ``interaction`` may add a term from the column ``_x`` (contributions in player order) and ``bits``.
    """
    packed = players.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("player", "inside", "outside"))).alias("_p"))
    xs = F.transform("_p", lambda p: p["inside"])
    bits = packed.withColumn("_x", xs).withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit((1 << n) - 1))))
    held = F.aggregate(
        "_p", F.lit(0.0),
        lambda a, p: a + F.when(F.getbit(F.col("bits").cast("bigint"), p["player"]) == 1, p["inside"]).otherwise(p["outside"]),
    )
    v = held if interaction is None else held + interaction
    return bits.select(*keys, "bits", v.alias("v"))


def shapley(coalitions: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Exact Shapley value of each player from all 2^n coalition values (keys, player, phi).

    Every coalition value enters a player's sum once: with the weight of joining its remainder when
    the player is in it, with minus the weight of joining it otherwise. So one pass and one map-side
    combined sum do; coalitions are not joined to each other.
    """
    weight = F.array(*[F.lit(factorial(s) * factorial(n - s - 1) / factorial(n)) for s in range(n)] + [F.lit(0.0)])
    size = F.bit_count("bits")
    rows = coalitions.select(*keys, "bits", "v", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("player"))
    inside = F.getbit(F.col("bits").cast("bigint"), F.col("player")) == 1
    share = F.when(inside, F.get(weight, size - 1)).otherwise(-F.get(weight, size))
    return rows.groupBy(*keys, "player").agg(F.sum(share * F.col("v")).alias("phi"))


def over_seeds(phi: DataFrame, keys: list[str]) -> DataFrame:
    """Shapley values solved seed by seed, averaged: mean, size of the mean, spread over seeds and their number."""
    mean = F.avg("phi")
    return phi.groupBy(*keys, "player").agg(
        mean.alias("mean_shap"), F.abs(mean).alias("abs_mean_shap"), F.stddev_pop("phi").alias("std_shap"), F.count("*").alias("n_seeds")
    )


def additivity(coalitions: DataFrame, phi: DataFrame, keys: list[str], n: int, scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    """Base value, prediction and what the attributions leave unexplained."""
    ends = coalitions.where(F.col("bits").isin(0, (1 << n) - 1)).groupBy(*keys).agg(
        F.max(F.when(F.col("bits") == 0, F.col("v"))).alias("_b"), F.max(F.when(F.col("bits") != 0, F.col("v"))).alias("_p")
    )
    total = phi.groupBy(*keys).agg(F.sum("phi").alias("_s"))
    base, pred = F.col("_b") * scale + shift, F.col("_p") * scale + shift
    return ends.join(total, keys).select(
        *keys, base.alias("base_value"), pred.alias("prediction"), F.abs(pred - (base + F.col("_s") * scale)).alias("residual")
    )


def background(df: DataFrame, keys: list[str], value: str, n: int, seed: int | None = None) -> DataFrame:
    """Mean of a background sample of each key's rows: ``n`` rows in md5 order of (date, seed), or the
    last ``n`` rows without a seed."""
    order = F.col("date").desc() if seed is None else F.md5(F.concat(F.col("date").cast("string"), F.lit(f"|{seed}")))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.where(F.col(value).isNotNull()).withColumn("_n", rn).where(F.col("_n") <= n).groupBy(*keys).agg(
        F.avg(value).alias("background"), F.count("*").alias("n_rows")
    )


# ---- averages over seeds ----------------------------------------------------------------------


def seed_mean(df: DataFrame, item: str = "feature", value: str = "shap_value") -> DataFrame:
    """Mean over seeds, its absolute value, population deviation and number of seeds."""
    g = df.groupBy(*CELL, item).agg(
        F.avg(value).alias("mean_shap"), F.stddev_pop(value).alias("std_shap"), F.count(value).alias("n_seeds")
    )
    return g.select(*CELL, item, "mean_shap", F.abs("mean_shap").alias("abs_mean_shap"), "std_shap", "n_seeds")


def block_importance(sm: DataFrame) -> DataFrame:
    """Importance of each block per maturity under four aggregations of |mean SHAP|."""
    b = with_block(sm)
    per_date = b.groupBy(*CELL, "grp").agg(F.sum("abs_mean_shap").alias("v"))
    per_feature = b.groupBy("maturity", "grp", "feature").agg(F.avg("abs_mean_shap").alias("v"))
    named = lambda d, label: d.select("maturity", "grp", F.lit(label).alias("agg"), "value")
    return (
        named(per_date.groupBy("maturity", "grp").agg(F.avg("v").alias("value")), "total")
        .unionByName(named(b.groupBy("maturity", "grp").agg(F.avg("abs_mean_shap").alias("value")), "per_feat"))
        .unionByName(named(per_feature.groupBy("maturity", "grp").agg(F.avg("v").alias("value")), "feature_mean"))
        .unionByName(named(per_feature.groupBy("maturity", "grp").agg(F.sum("v").alias("value")), "feature_sum"))
    )


def block_features(sm: DataFrame) -> DataFrame:
    return with_block(sm).select("grp", "feature").distinct().groupBy("grp").agg(F.count("*").alias("n_features"))


def group_abs(sm: DataFrame) -> DataFrame:
    """Sum of |mean SHAP| over a block's features per date and maturity."""
    return with_block(sm).groupBy(*CELL, "grp").agg(F.sum("abs_mean_shap").alias("mass"))


def group_average(mass: DataFrame) -> DataFrame:
    return mass.groupBy("maturity", "grp").agg(F.avg("mass").alias("mass"))


def shares(df: DataFrame, within: list[str], value: str = "mass", out: str = "share") -> DataFrame:
    """A value's part of its group's total; NULL for a zero total."""
    total = F.sum(value).over(Window.partitionBy(*within)) if within else F.sum(value).over(Window.partitionBy(F.lit(0)))
    return df.withColumn(out, ratio(F.col(value), total))


def group_shares(sm: DataFrame, keep_forward: bool = True) -> DataFrame:
    """Time-averaged block mass, its share within the maturity and its rank."""
    avg = shares(macro_only(group_average(group_abs(sm)), keep_forward), ["maturity"])
    rank = F.row_number().over(Window.partitionBy("maturity").orderBy(F.round("mass", 12).desc(), "grp"))
    return avg.withColumn("rank", rank)


def block_share_path(mass: DataFrame, k: int, smooth_first: bool) -> DataFrame:
    """Block shares by month with a k-month mean, taken before or after dividing by the total.

    A block absent in a month counts as zero; a month without any mass has a NULL share.
    """
    full = densify(mass, ["maturity", "grp"], ["mass"]).withColumn("mass", F.coalesce("mass", F.lit(0.0)))
    smooth = lambda c: F.avg(c).over(by_date(["maturity", "grp"]).rowsBetween(-(k - 1), 0))
    if smooth_first:
        return shares(full.withColumn("mass", smooth("mass")), ["date", "maturity"]).select("date", "maturity", "grp", "share")
    cut = shares(full, ["date", "maturity"])
    return cut.select("date", "maturity", "grp", smooth("share").alias("share"))


def macro_share(sm: DataFrame) -> DataFrame:
    """Forward mass, macro mass, total and macro share per date and maturity."""
    forward = feature_block("feature") == FORWARD
    side = lambda c: F.coalesce(F.sum(F.when(c, F.col("abs_mean_shap"))), F.lit(0.0))
    g = sm.groupBy(*CELL).agg(side(forward).alias("forward"), side(~forward).alias("macro"))
    return g.withColumn("total", F.col("forward") + F.col("macro")).withColumn("macro_share", ratio(F.col("macro"), F.col("total")))


def regime_means(df: DataFrame, keys: list[str], value: str, flag: str = "flag") -> DataFrame:
    """Means and counts inside and outside a regime, where both occur."""
    x, inside = F.col(value), F.col(flag)
    g = df.where(x.isNotNull()).groupBy(*keys).agg(
        F.count(F.when(~inside, 1)).alias("n_out"), F.avg(F.when(~inside, x)).alias("out_mean"),
        F.count(F.when(inside, 1)).alias("n_in"), F.avg(F.when(inside, x)).alias("in_mean"), F.avg(x).alias("sample_mean"),
    )
    return g.where((F.col("n_in") > 0) & (F.col("n_out") > 0)).withColumn("diff", F.col("in_mean") - F.col("out_mean"))


def composition(sm: DataFrame, maturity: int) -> DataFrame:
    """Share of each block in the time-averaged mass of one maturity."""
    m = group_abs(sm.where(F.col("maturity") == maturity)).groupBy("grp").agg(F.avg("mass").alias("mass"))
    return shares(m, [])


def macro_ranking(sm: DataFrame) -> DataFrame:
    """Macro blocks by time-averaged mass, shares taken without the forward block, in percent."""
    m = macro_only(group_abs(sm)).groupBy("maturity", "grp").agg(F.avg("mass").alias("mass"))
    s = shares(m, ["maturity"])
    rank = F.row_number().over(Window.partitionBy("maturity").orderBy(F.round("mass", 12).desc(), "grp"))
    return s.select("maturity", "grp", "mass", (F.lit(100.0) * F.col("share")).alias("share_pct"), rank.alias("rank"))


def top_features(sm: DataFrame, n: int, keep_forward: bool = False) -> DataFrame:
    """Leading features per maturity by time-mean |SHAP|, relative to the first."""
    m = macro_only(with_block(sm), keep_forward).groupBy("maturity", "feature", "grp").agg(F.avg("abs_mean_shap").alias("value"))
    w = Window.partitionBy("maturity").orderBy(F.round("value", 12).desc(), "feature")
    best = F.max("value").over(Window.partitionBy("maturity"))
    return m.select(
        "*", F.row_number().over(w).alias("rank"), ratio(F.col("value"), best).alias("rel"), feature_display("feature").alias("display")
    ).where(F.col("rank") <= n)


def keep_top_features(df: DataFrame, k: int, value: str = "shap_value") -> DataFrame:
    """Rows of the k features with the largest mean |value|."""
    lead = df.groupBy("feature").agg(F.avg(F.abs(value)).alias("_v")).orderBy(F.round("_v", 9).desc(), "feature").limit(k)
    return df.join(lead.select("feature"), "feature", "left_semi")


# ---- stability over seeds ---------------------------------------------------------------------


def seed_groups(df: DataFrame) -> DataFrame:
    """Signed and absolute sums per date, maturity, seed and block."""
    return with_block(df).groupBy(*CELL, "seed", "grp").agg(
        F.sum("shap_value").alias("signed"), F.sum(F.abs("shap_value")).alias("absolute")
    )


def seed_band(groups: DataFrame, keys: list[str] = ("date", "maturity", "grp")) -> DataFrame:
    """Mean, least and largest signed sum over seeds."""
    return groups.groupBy(*keys).agg(
        F.avg("signed").alias("mean"), F.min("signed").alias("min"), F.max("signed").alias("max"), F.count("signed").alias("n_seeds")
    )


def seed_spread(band: DataFrame) -> DataFrame:
    """Median, mean and largest spread over dates per maturity and macro block."""
    s = macro_only(band).withColumn("spread", F.col("max") - F.col("min"))
    return s.groupBy("maturity", "grp").agg(
        F.median("spread").alias("median"), F.avg("spread").alias("mean"), F.max("spread").alias("max")
    )


def _variation(value: str, eps: float) -> list[Column]:
    return [F.stddev_samp(value).alias("_s"), F.avg(value).alias("_m"), F.lit(eps).alias("_e")]


def variation(df: DataFrame, groups: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Coefficient of variation over seeds at block level and, averaged, at feature level.

    Means within ``eps`` of zero give no coefficient.
    """
    cov = F.when(F.abs("_m") > F.col("_e"), F.col("_s") / F.abs("_m"))
    at_group = groups.groupBy(*CELL, "grp").agg(*_variation("signed", eps)).groupBy("maturity", "grp").agg(F.avg(cov).alias("group_cov"))
    per = with_block(df).groupBy(*CELL, "grp", "feature").agg(*_variation("shap_value", eps))
    at_feature = (
        per.groupBy("maturity", "grp", "feature").agg(F.avg(cov).alias("_c")).groupBy("maturity", "grp").agg(F.avg("_c").alias("feature_cov"))
    )
    return at_group.join(at_feature, ["maturity", "grp"], "full_outer")


def rank_agreement(df: DataFrame, item: str, value: str, min_items: int = 3) -> DataFrame:
    """Mean, least and number of pairwise Spearman correlations of |value| over seeds per cell.

    Items get average ranks per seed; a seed that lacks an item or ranks all alike has no
    correlation. Pairs are formed inside one array per cell (seeds by items), not as rows.
    """
    from .significance import average_rank

    a = df.withColumn("_v", F.abs(value))
    r = a.withColumn("_r", average_rank("_v", [*CELL, "seed"]))
    seeds = r.groupBy(*CELL, "seed").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col(item).alias("i"), F.col("_r").alias("r")))), lambda s: s["r"]).alias("_x"),
        F.collect_list(item).alias("_items"),
    )
    cells = seeds.groupBy(*CELL).agg(
        F.collect_list("_x").alias("_xs"), F.size(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_n"), F.count("*").alias("_k")
    ).where((F.col("_n") >= min_items) & (F.col("_k") >= 2))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    mid = (F.col("_n") + 1) / 2.0
    centred = F.transform(F.filter("_xs", lambda x: F.size(x) == F.col("_n")), lambda x: F.transform(x, lambda v: v - mid))
    cells = cells.withColumn("_c", F.filter(centred, lambda x: add(F.transform(x, lambda v: v * v)) > 0))
    unit = F.transform("_c", lambda x: F.transform(x, lambda v: v / F.sqrt(add(F.transform(x, lambda u: u * u)))))
    cells = cells.withColumn("_u", unit).where(F.size("_u") >= 2)
    pairs = F.flatten(F.transform("_u", lambda x, i: F.transform(
        F.slice("_u", i + 2, F.size("_u")), lambda y: add(F.zip_with(x, y, lambda p, q: p * q)))))
    cells = cells.withColumn("_p", pairs)
    n = F.size("_p")
    return cells.select(*CELL, (add(F.col("_p")) / n).alias("mean_rho"), F.array_min("_p").alias("min_rho"), n.alias("n_pairs"))


def seed_share_spread(df: DataFrame) -> DataFrame:
    """Population deviation over seeds of block shares pooled over time, per maturity."""
    mass = with_block(df).groupBy("maturity", "seed", "grp").agg(F.avg(F.abs("shap_value")).alias("mass"))
    return shares(mass, ["maturity", "seed"]).groupBy("maturity", "grp").agg(
        F.stddev_pop("share").alias("share_sd"), F.avg("share").alias("share_mean"), F.count("*").alias("n_seeds")
    )


def within_date_spread(groups: DataFrame) -> DataFrame:
    """Median and upper quartile over dates of the spread of block shares between seeds."""
    s = shares(groups, [*CELL, "seed"], "absolute")
    per = s.groupBy(*CELL, "grp").agg(
        F.coalesce(F.stddev_samp("share"), F.lit(0.0)).alias("sd"), (F.max("share") - F.min("share")).alias("range")
    )
    q = lambda c, p: F.percentile(c, F.lit(p))
    return per.groupBy("maturity", "grp").agg(
        q("sd", 0.5).alias("sd_median"), q("sd", 0.75).alias("sd_p75"), q("range", 0.5).alias("range_median"), q("range", 0.75).alias("range_p75")
    )


def model_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per block: mean and largest absolute share difference of two models over maturities, and their
    average shares. Inputs are (maturity, grp, share)."""
    both = a.select("maturity", "grp", F.col("share").alias("_a")).join(b.select("maturity", "grp", F.col("share").alias("_b")), ["maturity", "grp"])
    d = F.abs(F.col("_a") - F.col("_b"))
    return both.groupBy("grp").agg(
        F.avg(d).alias("mean_abs_diff"), F.max(d).alias("max_abs_diff"), F.avg("_a").alias("share_a"), F.avg("_b").alias("share_b")
    )


def coverage(df: DataFrame) -> DataFrame:
    """Seeds, features and rows per date and maturity."""
    return df.groupBy(*CELL).agg(
        F.countDistinct("seed").alias("n_seeds"), F.countDistinct("feature").alias("n_features"), F.count("*").alias("n_rows")
    )


def seed_dates(df: DataFrame) -> DataFrame:
    """Dates and maturities on which each seed appears."""
    return df.select("seed", *CELL).distinct().groupBy("seed").agg(F.countDistinct("date").alias("n_dates"), F.count("*").alias("n_cells"))


def compare_aggregations(naive: DataFrame, exact: DataFrame) -> DataFrame:
    """Block shares in percent under feature sums and under exact group values, and their gap.

    Inputs are (maturity, grp, importance); a block missing on one side counts as zero there.
    """
    side = lambda d, label: d.select("maturity", "grp", F.col("importance").alias(label))
    both = side(naive, "_n").join(side(exact, "_e"), ["maturity", "grp"], "full_outer").fillna(0.0, ["_n", "_e"])
    both = shares(shares(both, ["maturity"], "_n", "n"), ["maturity"], "_e", "e")
    n, e = F.lit(100.0) * F.col("n"), F.lit(100.0) * F.col("e")
    return both.select("maturity", "grp", n.alias("naive_pct"), e.alias("exact_pct"), (e - n).alias("diff_pp"))
