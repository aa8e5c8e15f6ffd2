"""Tests of forecast gains. A tested series holds one value per month and key, so it is ordered
into one array per key and all its autocovariances are taken there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import mann_whitney_exact, normal_upper, student_t_upper
from ..functions.serial import hln_factor, ordered_values, with_hac_tstat, with_long_run_variance


def clark_west_term(y: str = "y", y_hat: str = "y_hat", bench: str = "bench") -> Column:
    """Loss difference adjusted for the forecast's own noise."""
    y_, f, b = F.col(y), F.col(y_hat), F.col(bench)
    return F.pow(y_ - b, 2) - F.pow(y_ - f, 2) + F.pow(b - f, 2)


def clark_west(df: DataFrame, keys: list[str], lags: int = 12) -> DataFrame:
    """(keys, n, mean, t_stat, p_value): one-sided test that the model beats the benchmark."""
    xs = df.groupBy(*keys).agg(ordered_values(clark_west_term()).alias("_f"))
    out = with_hac_tstat(xs, "_f", lags).drop("_f")
    return out.withColumn("p_value", student_t_upper(F.col("t_stat"), F.col("n") - 1))


def dm_hln(df: DataFrame, keys: list[str], diff: str, h: int = 12) -> DataFrame:
    """One-sided test of a positive mean difference with the bundled finite-sample variance.

    NULL when there are fewer than max(5, h + 1) values or the variance is not positive.
    """
    xs = df.groupBy(*keys).agg(ordered_values(diff).alias("_d"))
    d = with_long_run_variance(xs, "_d", h).drop("_d")
    n = F.col("n")
    var = F.when(n > 0, hln_factor(n, h) / n) * F.col("lrv")
    usable = (n >= max(5, h + 1)) & (hln_factor(n, h) > 0) & (var > 0)
    d = d.withColumn("dm_stat", F.when(usable, F.col("mean") / F.sqrt(var))).drop("lrv")
    return d.withColumn("p_value", student_t_upper(F.col("dm_stat"), n - 1))


def dm_pairs(df: DataFrame, group: str, model: str, h: int = 12) -> DataFrame:
    """Every ordered model pair of a group, on the dates all its models cover.

    Squared-error loss; a negative statistic and a small p favour the first model. Each model is
    one array of losses, so the pair join yields the result rows and nothing wider.
    """
    loss = df.where(F.col("y").isNotNull() & F.col("y_hat").isNotNull()).withColumn(
        "_l", F.pow(F.col("y") - F.col("y_hat"), 2)
    )
    n_models = df.groupBy(group).agg(F.countDistinct(model).alias("_m"))
    here = loss.groupBy(group, "date").agg(F.count("*").alias("_c"))
    shared = here.join(n_models, group).where(F.col("_c") == F.col("_m")).select(group, "date")
    arrays = loss.join(shared, [group, "date"], "left_semi").groupBy(group, model).agg(ordered_values("_l").alias("_x"))
    a = arrays.select(group, F.col(model).alias("model_a"), F.col("_x").alias("_xa"))
    b = arrays.select(group, F.col(model).alias("model_b"), F.col("_x").alias("_xb"))
    pairs = a.join(b, group).where(F.col("model_a") != F.col("model_b")).select(
        group, "model_a", "model_b", F.zip_with("_xa", "_xb", lambda p, q: p - q).alias("_d")
    )
    d = with_long_run_variance(pairs, "_d", h).drop("_d")
    factor = hln_factor(F.col("n"), h)
    stat = F.sqrt(factor) * F.col("mean") / F.sqrt(F.col("lrv") / F.col("n"))
    d = d.withColumn("dm_stat", F.when((factor > 0) & (F.col("lrv") > 0), stat)).drop("lrv")
    return d.withColumn("p_value", 1.0 - student_t_upper(F.col("dm_stat"), F.col("n") - 1))


def permutation_test(df: DataFrame, keys: list[str], value: str, flag: str, rounds: int = 999) -> DataFrame:
    """Permutation test of the difference of means inside and outside a regime.

    Round r orders a key's months by md5(date|r) and calls the first n_in of them inside. Months per
    key are one array that is sent once for each run of rounds; no permuted row is shuffled.
    """
    rows = df.where(F.col(value).isNotNull())
    g = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("date").cast("string").alias("d"), F.col(value).alias("v")))).alias("_xs"),
        F.count(F.when(F.col(flag), 1)).cast("int").alias("n_in"),
        F.count(F.when(~F.col(flag), 1)).cast("int").alias("n_out"),
        F.avg(F.when(F.col(flag), F.col(value))).alias("mean_in"),
        F.avg(F.when(~F.col(flag), F.col(value))).alias("mean_out"),
        F.avg(value).alias("sample_mean"),
    ).where((F.col("n_in") > 0) & (F.col("n_out") > 0)).withColumn("diff", F.col("mean_in") - F.col("mean_out"))
    one = g.select(*keys, "_xs", "n_in", "n_out", "diff", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // 32))).alias("_c"))
    order = F.transform(
        "_xs", lambda x: F.struct(F.md5(F.concat(x["d"], F.lit("|"), F.col("_r").cast("string"))).alias("k"), x["v"].alias("v"))
    )
    # a series travels once for 32 rounds, which are told apart after the shuffle
    first = F.col("_c") * 32 + 1
    mine = F.explode(F.sequence(first, F.least(first + 31, F.lit(rounds)))).alias("_r")
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = one.repartition(cores, *keys, "_c").select("*", mine).withColumn("_o", F.sort_array(order))
    head = F.slice("_o", F.lit(1), F.col("n_in"))
    tail = F.slice("_o", F.col("n_in") + 1, F.col("n_out"))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x["v"])
    null = add(head) / F.col("n_in") - add(tail) / F.col("n_out")
    hits = spread.withColumn("_hit", (F.abs(null) >= F.abs(F.col("diff"))).cast("int")).groupBy(*keys).agg(F.avg("_hit").alias("perm_p"))
    return g.drop("_xs").join(hits, keys)


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties sharing the mean of their places."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def mann_whitney(df: DataFrame, keys: list[str], value: str, flag: str, method: str = "auto") -> DataFrame:
    """Means, medians and the two-sided Mann-Whitney p of a regime against the rest.

    ``method`` "normal" approximates, with tie and continuity correction; "exact" counts arrangements where nothing ties and
    gives NULL elsewhere; "auto" is exact where a sample has at most eight untied values and normal elsewhere. NULL below
    three values on a side.
    """
    if method not in ("auto", "exact", "normal"):
        raise ValueError(f"unknown method {method}")
    rows = df.where(F.col(value).isNotNull()).withColumn("_rank", average_rank(value, keys)).withColumn(
        "_ties", F.count(F.lit(1)).over(Window.partitionBy(*keys, value)).cast("double")
    )
    inside = F.col(flag)
    x = F.col(value)
    g = rows.groupBy(*keys).agg(
        F.avg(F.when(inside, x)).alias("mean_in"), F.avg(F.when(~inside, x)).alias("mean_out"),
        F.median(F.when(inside, x)).alias("median_in"), F.median(F.when(~inside, x)).alias("median_out"),
        F.count(F.when(inside, 1)).alias("n_in"), F.count(F.when(~inside, 1)).alias("n_out"),
        F.sum(F.when(inside, F.col("_rank"))).alias("_r"), F.sum(F.pow("_ties", 2) - 1.0).alias("_t"),
    )
    n1, n2 = F.col("n_in").cast("double"), F.col("n_out").cast("double")
    n = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1.0) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1.0) - F.try_divide(F.col("_t"), n * (n - 1.0))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5, sd)
    approx = F.least(2.0 * normal_upper(z), F.lit(1.0))
    enough = (F.col("n_in") >= 3) & (F.col("n_out") >= 3)
    untied = F.col("_t") == 0
    small = {"auto": (F.least("n_in", "n_out") <= 8) & untied, "exact": untied, "normal": F.lit(False)}[method]
    g = g.withColumn("u_stat", F.when(F.col("n_in") > 0, u)).withColumn("mean_diff", F.col("mean_in") - F.col("mean_out"))
    exact = mann_whitney_exact(F.when(enough & small, F.col("u_stat")), F.col("n_in"), F.col("n_out"))
    return g.withColumn("_exact", exact).withColumn(
        "p_value", F.when(enough & small, F.col("_exact")).when(enough & F.lit(method != "exact"), approx)
    ).drop("_r", "_t", "_exact")


def episode_means(df: DataFrame, keys: list[str], value: str, months: DataFrame) -> DataFrame:
    """Mean value and months per regime episode; ``months`` is (date, episode)."""
    return (
        df.where(F.col(value).isNotNull()).join(months, "date")
        .groupBy(*keys, "episode").agg(F.avg(value).alias("mean"), F.count("*").alias("n_months"))
    )
