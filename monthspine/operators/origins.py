"""Walk-forward fits on what each origin has: imputed, masked and chosen columns, revised panels, a log of refits.

Training months are never gathered per origin. With a the availability of each predictor, the moments of the extended
row (1, x where known, 1 - a, targets) are cumulated once; an origin's imputed design is a linear map of that row (a
missing entry becomes the origin's median), so its moment matrix follows from the extended one, whatever its medians
and columns are. Revisions enter as differences: a month whose row changes from one origin to the next takes its old
outer product out and puts the new one in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import linear
from .panel import densify
from .transforms import training_median, training_rows, upto_now
from .walkforward import Design, cumulative_moments, design_rows, dot, origins, outer_upper, per_target, _pack, _split_end, _train_end

FIT = T.StructType([
    T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("alpha", T.DoubleType()), T.StructField("mix", T.DoubleType()),
    T.StructField("val_loss", T.DoubleType()), T.StructField("n_train", T.LongType()),
])


def chosen_steps(steps: list[tuple], keep: set[int]) -> list[tuple]:
    """Steps on the kept columns only; a step without columns goes, components are as many as there are columns at most."""
    out = []
    for step in steps:
        cols = [c for c in step[1] if c in keep]
        if cols and step[0] == "pca":
            out.append(("pca", cols, min(step[2], len(cols)), step[3]))
        elif cols:
            out.append((step[0], cols, *step[2:]))
    return out


def imputing_map(known: int, width: int, size: int, medians: np.ndarray) -> np.ndarray:
    """Rows that map (1, x where known, missing, targets) to (1, imputed x, targets); ``known`` predictors."""
    out = np.zeros((size, size + known))
    out[:width, :width] = np.eye(width)
    out[1:width, width : width + known] = np.diag(medians)
    out[width:, width + known :] = np.eye(size - width)
    return out


def logged_fit(cut: np.ndarray, whole: np.ndarray, steps: list[tuple], width: int, target: int, kind: str) -> dict:
    """Coefficients on all training months, the penalty, and the squared error on the last ones of a fit on those before."""
    alpha, mix = (0.0, 1.0) if kind == "ols" else linear.tune(cut, whole, steps, width, target, kind)
    held, loss = whole - cut, None
    if not steps:
        coef = np.zeros(width)
        coef[0] = whole[0, target] / whole[0, 0]
        early = np.zeros(width)
        early[0] = cut[0, target] / cut[0, 0] if cut[0, 0] else 0.0
    else:
        coef = linear.fit(whole, steps, width, target, kind, alpha, mix)
        early = linear.fit(cut, steps, width, target, kind, alpha, mix) if cut[0, 0] >= 10 else None
    if cut[0, 0] >= 10 and held[0, 0] >= 3:
        sse = held[target, target] - 2 * early @ held[:width, target] + early @ held[:width, :width] @ early
        loss = float(sse / held[0, 0])
    return {"coef": coef.tolist(), "alpha": alpha, "mix": mix, "val_loss": loss, "n_train": int(round(whole[0, 0]))}


def origin_solver(layout: Design, steps: list[tuple], kind: str):
    """Pandas function: (cut moments, all moments, medians or null, kept flags or null, target) to a logged fit."""
    width, size, known = layout.width, layout.size, len(layout.names)

    @F.pandas_udf(FIT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, medians, kept, t in zip(*batch):
                if medians is None:
                    cut, whole = linear.unpack(np.asarray(a), size), linear.unpack(np.asarray(b), size)
                else:
                    m = imputing_map(known, width, size, np.asarray(medians, float))
                    cut, whole = (m @ linear.unpack(np.asarray(s), size + known) @ m.T for s in (a, b))
                keep = set(range(1, width)) if kept is None else {j + 1 for j, k in enumerate(kept) if k}
                out.append(logged_fit(cut, whole, chosen_steps(steps, keep), width, int(t), kind))
            yield pd.DataFrame(out, columns=[f.name for f in FIT.fields])

    return run


def _state(features: DataFrame, layout: Design, months: DataFrame, gap: int, impute: bool, keep_timing: bool, all_missing: float) -> DataFrame:
    """Per month: medians of its training months, which columns it keeps and the row it forecasts from; no later month matters.

    Imputed: a column stays if its training months hold no masked cell, one before its first or after its last known value
    as of the month. Otherwise it stays if its training months are complete. A missing entry of the month's own row is the
    last known value, or the median if timing is not kept.
    """
    ends = months.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    dense = densify(
        features.select("date", "name", "value"), ["name"], ["value"], start=ends.select("lo").scalar(), end=ends.select("hi").scalar()
    )
    number = F.year("date") * 12 + F.month("date")
    now, train = upto_now(["name"]), training_rows(["name"], gap)
    seen = F.when(F.col("value").isNotNull(), number)
    first = F.min(number).over(Window.partitionBy("name"))
    d = training_median(dense, ["name"], gap, all_missing) if impute else dense.withColumn("fill", F.lit(0.0))
    d = d.withColumn("carried", F.last("value", ignorenulls=True).over(now))
    if not impute:
        kept = (F.count("value").over(train) == F.count(F.lit(1)).over(train)) & (F.count(F.lit(1)).over(train) > 0)
        own = F.col("carried")
    elif keep_timing:
        kept = (F.min(seen).over(now) == first) & (F.max(seen).over(now) >= number - gap - 1)
        own = F.col("carried")
    else:
        kept, own = F.lit(True), F.coalesce("value", "fill")
    d = d.withColumn("kept", F.coalesce(kept, F.lit(False))).withColumn("own", own).withColumn("m", number)
    place = F.array_position(F.array(*map(F.lit, layout.names)), F.col("name"))
    entry = F.sort_array(F.collect_list(F.struct(place.alias("i"), "fill", "kept", "own")))
    packed = d.groupBy("m").agg(entry.alias("_e"))
    part = lambda c: F.transform("_e", lambda e: e[c])
    return packed.select("m", part("fill").alias("medians"), part("kept").alias("kept"), part("own").alias("own"))


def expanding_fits(
    features: DataFrame, targets: DataFrame, layout: Design, steps: list[tuple], start: str, gap: int, kind: str = "ols",
    refit_every: int = 1, impute: bool = True, keep_timing: bool = True, all_missing: float = 0.0, shared=lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Fits (fit_m, target, coef, alpha, mix, val_loss, n_train, kept) and forecasts (date, target, y_hat).

    ``features`` and ``targets`` are long (date, name, value); every layout name needs at least one known value. Months
    without all targets are not trained on. Medians cover all training months. ``shared`` stores a frame that is read
    several times. Columns a refit drops have coefficient 0.
    """
    rows = shared(design_rows(features, targets, layout))
    known, width = len(layout.names), layout.width
    x = F.slice("z", 2, known)
    extended = F.concat(
        F.array(F.lit(1.0)), F.transform(x, lambda v: F.coalesce(v, F.lit(0.0))),
        F.transform(x, lambda v: v.isNull().cast("double")), F.slice("z", width + 1, len(layout.targets)),
    )
    wide = Design({"known": layout.names, "missing": [f"missing {n}" for n in layout.names]}, layout.targets)
    acc = shared(cumulative_moments(rows.select("m", extended.alias("z")), wide))
    state = shared(_state(features, layout, rows.select("date"), gap, impute, keep_timing, all_missing))
    o = origins(rows, start, gap, refit_every, 1)
    at = lambda name, out: acc.select(F.col("m").alias(name), F.col("moments").alias(out))
    fits = o.select("fit_m", "_first").distinct().withColumn("end", _train_end("fit_m", gap)).withColumn("cut", _split_end("fit_m", gap))
    ready = fits.join(at("end", "b"), "end").join(at("cut", "a"), "cut")
    ready = ready.join(state.select(F.col("m").alias("fit_m"), "medians", "kept"), "fit_m")
    each = per_target(ready, layout, "fit_m")
    solved = each.withColumn("fit", origin_solver(layout, steps, kind)("a", "b", "medians", "kept", "t"))
    solved = shared(solved.select("fit_m", "target", "kept", "fit.*"))
    now = o.select("date", "m", "fit_m").join(state.select("m", "own"), "m").join(solved, "fit_m")
    own = F.concat(F.array(F.lit(1.0)), F.zip_with("own", "kept", lambda v, k: F.when(k, v).otherwise(F.lit(0.0))))
    return solved, now.select("date", "target", dot(F.col("coef"), own, width).alias("y_hat"))


def changed_rows(rows: DataFrame, gap: int) -> DataFrame:
    """Rows (origin, m, z, _old) at which a training month enters or differs from the origin before."""
    w = Window.partitionBy("m").orderBy("origin")
    d = rows.where(F.col("m") <= F.col("origin") - gap - 1).withColumn("_old", F.lag("z").over(w))
    return d.where(F.col("_old").isNull() | ~F.col("z").eqNullSafe(F.col("_old")))


def revised_moments(rows: DataFrame, size: int, gap: int) -> DataFrame:
    """(origin, moments): packed moment matrix of each origin's own version of its training months.

    ``rows`` is (origin, m, z), months of every origin in its own version; ``origin`` is a month number. A month's row counts
    from origin m + gap + 1 on. Only rows that differ from the origin before reach the sums, as new minus old outer
    product; a running sum over origins does the rest. Incomplete rows count as nothing.
    """
    d = changed_rows(rows, gap)
    empty = F.array_repeat(F.lit(None).cast("double"), size)
    change = F.zip_with(
        outer_upper(F.col("z"), size), outer_upper(F.coalesce("_old", empty), size), lambda new, old: new - old
    )
    cells = d.select("origin", F.posexplode(change).alias("pos", "v")).groupBy("origin", "pos").agg(F.sum("v").alias("v"))
    upto = Window.partitionBy("pos").orderBy("origin").rowsBetween(Window.unboundedPreceding, 0)
    return _pack(cells.select("origin", "pos", F.sum("v").over(upto).alias("s")), ["origin"], "moments")


def revised_design(features: DataFrame, targets: DataFrame, layout: Design) -> DataFrame:
    """(origin, date, m, z) from long (origin, date, name, value) predictors and (date, name, value) targets."""
    wide = features.groupBy("origin", "date").pivot("name", layout.names).agg(F.max("value"))
    goals = targets.groupBy("date").pivot("name", layout.targets).agg(F.max("value"))
    z = F.array(F.lit(1.0), *[F.col(f"`{n}`") for n in [*layout.names, *layout.targets]])
    number = lambda c: (F.year(c) * 12 + F.month(c)).cast("int")
    return wide.join(goals, "date", "left").select(number("origin").alias("origin"), "date", number("date").alias("m"), z.alias("z"))


def revised_fits(
    rows: DataFrame, layout: Design, steps: list[tuple], start: str, gap: int, kind: str = "ols", refit_every: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Fits and forecasts when every origin trains on its own version of the months; ``rows`` come from ``revised_design``.

    Losses and penalties come from the last 15% of a refit's months. The months before that cut are summed for each refit:
    the cut moves with the origin, so differences would not save a sum there.
    """
    size = layout.size
    number = F.year(F.lit(start).cast("date")) * 12 + F.month(F.lit(start).cast("date"))
    first = rows.select(F.min("m")).scalar()
    live = rows.where((F.col("m") == F.col("origin")) & (F.col("m") >= number)).withColumn("_first", first)
    live = live.withColumn("fit_m", number + F.floor((F.col("m") - number) / refit_every).cast("int") * refit_every)
    fits = live.select("fit_m", "_first").distinct().withColumn("cut", _split_end("fit_m", gap))
    whole = revised_moments(rows, size, gap).select(F.col("origin").alias("fit_m"), F.col("moments").alias("b"))
    early = rows.join(fits, F.col("origin") == F.col("fit_m")).where(F.col("m") <= F.col("cut"))
    early = early.select("fit_m", F.posexplode(outer_upper(F.col("z"), size)).alias("pos", "v"))
    early = _pack(early.groupBy("fit_m", "pos").agg(F.sum("v").alias("s")), ["fit_m"], "a")
    each = per_target(fits.join(whole, "fit_m").join(early, "fit_m"), layout, "fit_m")
    none = F.lit(None)
    solved = each.withColumn(
        "fit", origin_solver(layout, steps, kind)("a", "b", none.cast("array<double>"), none.cast("array<boolean>"), "t")
    ).select("fit_m", "target", "fit.*")
    now = live.select("date", "fit_m", "z").join(solved, "fit_m")
    return solved, now.select("date", "target", dot(F.col("coef"), F.col("z"), layout.width).alias("y_hat"))


# ---- grids over features and penalties ----------------------------------------------------------------


def component_variants(lead: list[tuple], groups: list[list[int]], counts: list[int], scaled: bool = True) -> list[list[tuple]]:
    """Feature sets to choose from: ``lead`` and so many components of each group, as many as it has columns at most."""
    return [[*lead, *[("pca", g, min(k, len(g)), scaled) for g in groups]] for k in counts]


def grid_forecast(
    rows: DataFrame, layout: Design, variants: list[list[tuple]], start: str, gap: int, alphas: tuple[float, ...] | None = None, refit_every: int = 1,
) -> DataFrame:
    """(date, target, variant, alpha, val_loss, y_hat) of models whose features and lasso penalty are chosen at every refit.

    All pairs of a variant of features and a penalty are judged on the last 15% of the training months; scalings, components
    and slopes stem from the months before, and from all training months once the pair is chosen. Errors come from
    differences of moment matrices. One variant and one penalty need no judging; without ``alphas`` fits are plain.
    """
    size, width = layout.size, layout.width
    listed = None if alphas is None else np.asarray(alphas, float)
    out = T.StructType([T.StructField("coef", T.ArrayType(T.DoubleType())), T.StructField("variant", T.IntegerType()), T.StructField("alpha", T.DoubleType()), T.StructField("val_loss", T.DoubleType())])

    @F.pandas_udf(out)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for a, b, t in zip(*batch):
                cut, whole = (linear.unpack(np.asarray(s), size) for s in (a, b))
                variant, at, loss = linear.choose(cut, whole, variants, width, int(t), listed)
                only = None if listed is None else listed[at : at + 1]
                coef = linear.fit_grid(whole, variants[variant], width, int(t), only)[:, 0]
                found.append((coef.tolist(), variant, 0.0 if listed is None else float(listed[at]), loss))
            yield pd.DataFrame(found, columns=[f.name for f in out.fields])

    acc = cumulative_moments(rows, layout)
    o = origins(rows, start, gap, refit_every, 1)
    at = lambda name, c: acc.select(F.col("m").alias(name), F.col("moments").alias(c))
    fits = o.select("fit_m", "_first").distinct().withColumn("end", _train_end("fit_m", gap)).withColumn("cut", _split_end("fit_m", gap))
    each = per_target(fits.join(at("end", "b"), "end").join(at("cut", "a"), "cut"), layout, "fit_m")
    solved = each.select("fit_m", "target", run("a", "b", "t").alias("fit")).select("fit_m", "target", "fit.*")
    now = o.select("date", "fit_m", "z").join(solved, "fit_m")
    return now.select("date", "target", "variant", "alpha", "val_loss", dot(F.col("coef"), F.col("z"), width).alias("y_hat"))
