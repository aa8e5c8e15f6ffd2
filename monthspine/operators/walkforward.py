"""Walk-forward forecasting from expanding sufficient statistics.

Spark builds one cumulative moment matrix per month; a fit is then a small dense solve on the
matrix of its training months, and a forecast is a dot product back in Spark. Months must be
contiguous. Predictors should be of order one, since moments are not centred.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import linear
from ..functions.calendar import month_number, per_month, shift_months, with_months
from .transforms import by_date, training_rows, upto_now


# ---- schedule ---------------------------------------------------------------------------------


def refit_schedule(df: DataFrame, keys: list[str], start: str, refit_every: int = 1, tune_every: int = 1) -> DataFrame:
    """Out-of-sample steps, whether a step refits or retunes, and the refit in force."""
    w = by_date(keys)
    oos = df.where(F.col("date") >= F.lit(start).cast("date")).withColumn("step", F.row_number().over(w) - 1)
    refit = F.col("step") % refit_every == 0
    tune = refit & (F.floor(F.col("step") / refit_every) % max(tune_every, 1) == 0)
    out = oos.withColumn("refit", refit).withColumn("tune", tune)
    return out.withColumn("fitted_on", F.last(F.when(F.col("refit"), F.col("date")), ignorenulls=True).over(upto_now(keys)))


def temporal_split(df: DataFrame, keys: list[str], share: float = 0.85, min_train: int = 10, min_val: int = 3) -> DataFrame:
    """First ``share`` of the rows train, the rest validate; too short a sample is not split."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = df.withColumn("_i", F.row_number().over(by_date(keys))).withColumn("_n", n)
    d = d.withColumn("_s", F.floor(F.col("_n") * F.lit(share)))
    part = (
        F.when((F.col("_s") < min_train) | (F.col("_n") - F.col("_s") < min_val), "all")
        .when(F.col("_i") <= F.col("_s"), "train").otherwise("validation")
    )
    return d.withColumn("part", part).drop("_i", "_n", "_s")


# ---- one predictor ----------------------------------------------------------------------------


def univariate_ols(df: DataFrame, keys: list[str], gap: int, start: str, refit_every: int = 1, x: str = "x", y: str = "y") -> DataFrame:
    """Expanding regression of y on x refit on a schedule (adds intercept, slope, y_hat).

    Window moments give the fit of every month; only refit months keep theirs, later months carry it.
    """
    w = training_rows(keys, gap)
    pair = F.col(x).isNotNull() & F.col(y).isNotNull()
    d = df.withColumn("_x", F.when(pair, F.col(x))).withColumn("_y", F.when(pair, F.col(y)))
    fits = d.select(
        *df.columns, F.regr_intercept("_y", "_x").over(w).alias("_a"), F.regr_slope("_y", "_x").over(w).alias("_b")
    )
    oos = refit_schedule(fits, keys, start, refit_every)
    kept = lambda c: F.last(F.when(F.col("refit"), F.col(c)), ignorenulls=True).over(upto_now(keys))
    out = oos.withColumn("intercept", kept("_a")).withColumn("slope", kept("_b")).drop("_a", "_b", "tune")
    return out.withColumn("y_hat", F.col("intercept") + F.col("slope") * F.col(x))


# ---- many predictors --------------------------------------------------------------------------


@dataclass
class Design:
    """Column layout of z = (1, predictors, targets)."""

    blocks: dict[str, list[str]]
    targets: list[str]
    names: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.names = [c for cols in self.blocks.values() for c in cols]

    @property
    def width(self) -> int:
        return 1 + len(self.names)

    @property
    def size(self) -> int:
        return self.width + len(self.targets)

    def cols(self, block: str, first: int | None = None) -> list[int]:
        picked = self.blocks[block][:first]
        return [1 + self.names.index(c) for c in picked]

    def target(self, name: str) -> int:
        return self.width + self.targets.index(name)


def design_rows(features: DataFrame, targets: DataFrame, layout: Design) -> DataFrame:
    """One row per month (date, m, z) from long (date, name, value) predictors and targets."""
    long = features.select("date", "name", "value").unionByName(targets.select("date", "name", "value"))
    names = [*layout.names, *layout.targets]
    wide = long.groupBy("date").pivot("name", names).agg(F.max("value"))
    z = F.array(F.lit(1.0), *[F.col(f"`{n}`") for n in names])
    return wide.select("date", month_number("date").alias("m"), z.alias("z"))


def outer_upper(z: Column, size: int) -> Column:
    """Upper triangle of z z', row by row; zeros when an entry is missing."""
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.transform(
        F.slice(z, i + 1, F.lit(size)), lambda v: v * F.get(z, i))))
    full = F.forall(z, lambda v: v.isNotNull())
    return F.when(full, rows).otherwise(F.array_repeat(F.lit(0.0), size * (size + 1) // 2))


def _pack(entries: DataFrame, keys: list[str], out: str) -> DataFrame:
    listed = F.sort_array(F.collect_list(F.struct("pos", "s")))
    return entries.groupBy(*keys).agg(F.transform(listed, lambda e: e["s"]).alias(out))


def cumulative_moments(rows: DataFrame, layout: Design) -> DataFrame:
    """(m, moments): packed moment matrix of all months up to and including m."""
    cells = rows.select("m", F.posexplode(outer_upper(F.col("z"), layout.size)).alias("pos", "v"))
    w = Window.partitionBy("pos").orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    return _pack(cells.select("m", "pos", F.sum("v").over(w).alias("s")), ["m"], "moments")


def origins(rows: DataFrame, start: str, gap: int, refit_every: int, tune_every: int) -> DataFrame:
    """Out-of-sample months with the fit and the tuning in force and the months those train on."""
    first = rows.select(F.min("m")).scalar()
    t0 = month_number(F.lit(start).cast("date"))
    oos = rows.where(F.col("date") >= F.lit(start).cast("date")).select("date", "m", "z")
    step = F.col("m") - t0
    every = refit_every * tune_every
    d = oos.withColumn("fit_m", t0 + F.floor(step / refit_every).cast("int") * refit_every)
    return d.withColumn("tune_m", t0 + F.floor(step / every).cast("int") * every).withColumn("_first", first)


def _train_end(c: str, gap: int) -> Column:
    return F.col(c) - gap - 1


def _split_end(c: str, gap: int, share: float = 0.85) -> Column:
    n = F.col(c) - gap - F.col("_first")
    return F.col("_first") + F.floor(n * F.lit(share)).cast("int") - 1


def solver(layout: Design, steps: list[tuple], kind: str) -> Callable:
    """Pandas function: (moments, target, alpha, mix) to intercept and slopes on the predictors."""
    size, width = layout.size, layout.width

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([
                linear.fit(linear.unpack(np.asarray(m), size), steps, width, int(t), kind, a, mix).tolist() for m, t, a, mix in zip(*batch)
            ])

    return run


def tuner(layout: Design, steps: list[tuple], kind: str) -> Callable:
    """Pandas function: (training moments, all moments, target) to [alpha, mix]."""
    size, width = layout.size, layout.width

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([
                list(linear.tune(linear.unpack(np.asarray(a), size), linear.unpack(np.asarray(b), size), steps, width, int(t), kind))
                for a, b, t in zip(*batch)
            ])

    return run


def dot(coef: Column, z: Column, width: int) -> Column:
    return F.aggregate(F.zip_with(coef, F.slice(z, 1, width), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def per_target(df: DataFrame, layout: Design, key: str) -> DataFrame:
    """One row per target (columns target, t), spread over all cores: each is a solve of its own."""
    goals = [F.struct(F.lit(g).alias("target"), F.lit(layout.target(g)).alias("t")) for g in layout.targets if not g.startswith("_")]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.withColumn("_g", F.explode(F.array(*goals))).select("*", "_g.target", "_g.t").drop("_g").repartition(cores, key, "target")


def solve(ready: DataFrame, tuning: DataFrame | None, layout: Design, steps: list[tuple], kind: str) -> DataFrame:
    """Fit every (fit_m, target) of ``ready`` (fit_m, tune_m, mom), with the penalties of ``tuning``
    (tune_m, cut moments a, all moments b) when the model has one."""
    each = per_target(ready, layout, "fit_m")
    if tuning is None:
        each = each.withColumn("alpha", F.lit(0.0)).withColumn("mix", F.lit(1.0))
    else:
        pen = per_target(tuning, layout, "tune_m").select("tune_m", "target", tuner(layout, steps, kind)("a", "b", "t").alias("_p"))
        pen = pen.select("tune_m", "target", F.get("_p", F.lit(0)).alias("alpha"), F.get("_p", F.lit(1)).alias("mix"))
        each = each.join(pen, ["tune_m", "target"])
    keep = [c for c in ready.columns if c not in ("tune_m", "mom")]
    return each.select(*keep, "target", solver(layout, steps, kind)("mom", "t", "alpha", "mix").alias("coef"))


def coefficients(
    rows: DataFrame, layout: Design, steps: list[tuple], start: str, gap: int, kind: str = "ols",
    refit_every: int = 1, tune_every: int = 1, moments: DataFrame | None = None,
) -> DataFrame:
    """(fit_m, target, coef) at every refit.

    Penalised models are tuned on the last 15% of their training months at every ``tune_every``-th
    refit; refits in between keep the penalty.
    """
    acc = cumulative_moments(rows, layout) if moments is None else moments
    o = origins(rows, start, gap, refit_every, tune_every)
    at = lambda name, out: acc.select(F.col("m").alias(name), F.col("moments").alias(out))
    fits = o.select("fit_m", "tune_m").distinct().withColumn("end", _train_end("fit_m", gap))
    ready = fits.join(at("end", "mom"), "end").drop("end")
    tuning = None
    if kind != "ols":
        t = o.select("tune_m", "_first").distinct().withColumn("end", _train_end("tune_m", gap)).withColumn("cut", _split_end("tune_m", gap))
        tuning = t.join(at("end", "b"), "end").join(at("cut", "a"), "cut").select("tune_m", "a", "b")
    return solve(ready, tuning, layout, steps, kind)


def predict(rows: DataFrame, coefs: DataFrame, layout: Design, start: str, gap: int, refit_every: int) -> DataFrame:
    """(date, target, y_hat) of every out-of-sample month under the fit in force."""
    o = origins(rows, start, gap, refit_every, 1).join(coefs, "fit_m")
    return o.select("date", "target", dot(F.col("coef"), F.col("z"), layout.width).alias("y_hat"))


def linear_forecast(
    rows: DataFrame, layout: Design, steps: list[tuple], start: str, gap: int,
    kind: str = "ols", refit_every: int = 1, tune_every: int = 1,
) -> DataFrame:
    """Walk-forward forecasts of a linear model over the features ``steps`` builds."""
    coefs = coefficients(rows, layout, steps, start, gap, kind, refit_every, tune_every)
    return predict(rows, coefs, layout, start, gap, refit_every)


def importance(coefs: DataFrame, layout: Design) -> DataFrame:
    """Mean absolute coefficient of every predictor and target over refits."""
    names = F.array(*[F.lit(n) for n in ["(intercept)", *layout.names]])
    cells = coefs.select("target", F.posexplode("coef").alias("i", "c"))
    return cells.groupBy("target", F.element_at(names, F.col("i") + 1).alias("name")).agg(
        F.avg(F.abs("c")).alias("mean_abs"), F.count("*").alias("n_refits")
    )


# ---- factor models with a cubic term ------------------------------------------------------------


def mapper(layout: Design, steps: list[tuple]) -> Callable:
    """Pandas function: moments to the feature rows of ``steps``, flattened."""
    size, width = layout.size, layout.width

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for moments in batches:
            maps = [linear.feature_rows(linear.unpack(np.asarray(m), size), steps, width).ravel().tolist() for m in moments]
            yield pd.Series(maps)

    return run


def cubic_forecast(
    rows: DataFrame, layout: Design, lead: list[tuple], macro: list[int], start: str, gap: int,
    kind: str = "ols", refit_every: int = 1, tune_every: int = 1, picked: tuple[int, ...] = (0, 2, 3, 7),
) -> DataFrame:
    """Walk-forward model on leading features and macro factors 1, 1 cubed, 3, 4 and 8.

    ``lead`` are the steps of the leading features. The cubic term is not linear in the predictors, so
    each fit's feature map is applied to its own months in Spark and the moments of the mapped
    features are summed per fit. Tuning maps the months with what the training part alone gives.
    """
    acc = cumulative_moments(rows, layout)
    o = origins(rows, start, gap, refit_every, tune_every)
    steps = [*lead, ("pca", macro, max(picked) + 1, True)]
    n_lead = sum(len(s[1]) if s[0] == "raw" else 1 for s in lead)
    goals = [t for t in layout.targets if not t.startswith("_")]
    first_f = "F1"
    names = [f"L{i}" for i in range(n_lead)] + [first_f, f"{first_f}^3"] + [f"F{p + 1}" for p in picked[1:]]
    mapped = Design({"all": names}, goals)
    w = layout.width

    def score(i: int) -> Column:
        return dot(F.slice("map", i * w + 1, w), F.col("z"), w)

    def expand(d: DataFrame) -> DataFrame:
        scored = [score(i) for i in range(n_lead)] + [score(n_lead + picked[0])]
        cube = F.pow(score(n_lead + picked[0]), 3)
        rest = [score(n_lead + p) for p in picked[1:]]
        ys = [F.get("z", F.lit(layout.target(t))) for t in goals]
        return d.withColumn("z2", F.array(F.lit(1.0), *scored, cube, *rest, *ys))

    def moments_of(fits: DataFrame, key: str, end: str, out: str) -> DataFrame:
        """Moments of mapped features over months first..end of every fit."""
        months = fits.withColumn("m", F.explode(F.sequence(F.col("_first"), F.col(end))))
        full = expand(months.join(rows.select("m", "z"), "m"))
        cells = full.select(key, F.posexplode(outer_upper(F.col("z2"), mapped.size)).alias("pos", "v"))
        return _pack(cells.groupBy(key, "pos").agg(F.sum("v").alias("s")), [key], out)

    at = lambda name: acc.select(F.col("m").alias(name), F.col("moments").alias("_mom"))
    cores = rows.sparkSession.sparkContext.defaultParallelism
    fits = o.select("fit_m", "tune_m", "_first").distinct().withColumn("end", _train_end("fit_m", gap))
    maps = fits.join(at("end"), "end").repartition(cores, "fit_m").select(
        "fit_m", "tune_m", "_first", "end", mapper(layout, steps)("_mom").alias("map")
    )
    plain = [("raw", list(range(1, mapped.width)))]
    own = moments_of(maps.select("fit_m", "_first", "end", "map"), "fit_m", "end", "mom")
    ready = maps.join(own, "fit_m").select("fit_m", "tune_m", "map", "mom")
    tuning = None
    if kind != "ols":
        t = o.select("tune_m", "_first").distinct().withColumn("end", _train_end("tune_m", gap)).withColumn("cut", _split_end("tune_m", gap))
        part = t.join(at("cut"), "cut").repartition(cores, "tune_m").select("tune_m", "_first", "end", "cut", mapper(layout, steps)("_mom").alias("map"))
        tuning = moments_of(part, "tune_m", "cut", "a").join(moments_of(part, "tune_m", "end", "b"), "tune_m")
    solved = solve(ready, tuning, mapped, plain, kind)
    now = expand(o.select("date", "fit_m", "z").join(solved, "fit_m"))
    return now.select("date", "target", dot(F.col("coef"), F.col("z2"), mapped.width).alias("y_hat"))


# ---- models of the user's own --------------------------------------------------------------------


def walk_forward(
    df: DataFrame, keys: list[str], fit_predict: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray], start: str, gap: int,
    refit_every: int = 1, last: str | None = None,
) -> DataFrame:
    """Run a user's model on every (key, refit): ``fit_predict(train, rows)`` returns forecasts of rows.

    A refit's task gets its training months and the months it forecasts, at most one row per month of
    the calendar. Each row is sent to the refits that use it by equality, never by a range join.
    """
    first_day = F.lit(start).cast("date")
    hi = df.select(F.max("date")).scalar() if last is None else F.lit(last).cast("date")
    refits = with_months(df.sparkSession.range(1).select(hi.alias("_hi")), first_day, "_hi", "refit").select("refit").where(
        (month_number("refit") - month_number(first_day)) % refit_every == 0
    )
    used = with_months(df, F.greatest(shift_months("date", -(refit_every - 1)), first_day), hi, "refit").join(
        per_month(refits), "refit", "left_semi"
    )
    ahead = month_number("refit") - month_number("date")
    tagged = used.withColumn("_part", F.when(F.col("date") >= F.col("refit"), "live").when(ahead > gap, "train")).where(F.col("_part").isNotNull())
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        train, live = pdf[pdf["_part"] == "train"], pdf[pdf["_part"] == "live"]
        if train.empty or live.empty:
            return pd.DataFrame({c: [] for c in [*keys, "date", "y_hat"]})
        out = live[[*keys, "date"]].copy()
        out["y_hat"] = np.asarray(fit_predict(train, live), dtype=float)
        return out

    return tagged.groupBy(*keys, "refit").applyInPandas(run, f"{head}date date, y_hat double")
