"""Queries: walk-forward models."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import benchmarks as B
from ..operators import curve as CV
from ..operators import forest as FO
from ..operators import origins as O
from ..operators import transforms as T
from ..operators import walkforward as W
from .fixtures import Fixtures, add_view
from .model_sql import linear_model_sql
from .panel_queries import dense
from .registry import query
from .scoring_queries import GAP, mean_sql, truth

M = ["maturity"]
WGAP, OOS = 11, "1998-01-31"


@query("fc_random_walk", f"SELECT date, maturity, lag(y, {GAP + 1}) OVER (PARTITION BY maturity ORDER BY date) AS y_hat FROM fx_curve", "fx_curve")
def q_rw(fx):
    return truth(fx).select("date", "maturity", B.random_walk("y", M, GAP).alias("y_hat"))


@query("fc_hist_mean", f"SELECT date, maturity, round({mean_sql(GAP)}, 10) + 0 AS y_hat FROM fx_curve", "fx_curve")
def q_hm(fx):
    return truth(fx).select("date", "maturity", C.rnd(B.hist_mean("y", M, GAP), 10).alias("y_hat"))


add_view("fx_xy", """
    SELECT r.date, r.maturity, r.rx AS y, -((r.maturity-12)/12e0)*p.y + (r.maturity/12e0)*c.y AS x
    FROM fx_rx r JOIN fx_curve c ON c.date = r.date AND c.maturity = r.maturity LEFT JOIN fx_curve p ON p.date = r.date AND p.maturity = r.maturity - 12""", "fx_rx fx_curve")


def xy(fx: Fixtures):
    fwd = CV.forward_rates(fx.curve).select("date", "maturity", F.col("fwd").alias("x"))
    return CV.excess_returns(fx.curve, 12).join(fwd, ["date", "maturity"]).select("date", "maturity", F.col("rx").alias("y"), "x")


def ols_sql(every: int) -> str:
    frame = f"PARTITION BY maturity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND {WGAP + 1} PRECEDING"
    return f"""
    WITH f AS (SELECT *, regr_intercept(y, x) OVER ({frame}) AS a, regr_slope(y, x) OVER ({frame}) AS b FROM fx_xy),
         o AS (SELECT *, row_number() OVER (PARTITION BY maturity ORDER BY date) - 1 AS step FROM f WHERE date >= DATE '{OOS}'),
         k AS (SELECT *, max(CASE WHEN step % {every} = 0 THEN date END) OVER (PARTITION BY maturity ORDER BY date) AS fitted_on FROM o)
    SELECT k.date, k.maturity, r.date AS fitted_on, round(r.a, 6) + 0 AS intercept, round(r.b, 6) + 0 AS slope, round(r.a + r.b*k.x, 6) + 0 AS y_hat
    FROM k JOIN o r ON r.maturity = k.maturity AND r.date = k.fitted_on"""


def ols(fx: Fixtures, every: int):
    out = W.univariate_ols(xy(fx), M, WGAP, OOS, every)
    return out.select("date", "maturity", "fitted_on", *[C.rnd(c).alias(c) for c in ["intercept", "slope", "y_hat"]])


@query("fc_ols1", ols_sql(1), "fx_xy")
def q_ols1(fx):
    return ols(fx, 1)


@query("walk_forward", ols_sql(12), "fx_xy")
def q_walk(fx):
    return ols(fx, 12)


def line(train: pd.DataFrame, rows: pd.DataFrame) -> np.ndarray:
    """A user's model: simple regression of y on x."""
    t = train.dropna(subset=["y"])
    x, y = t["x"].to_numpy(), t["y"].to_numpy()
    b = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    return y.mean() + b * (rows["x"].to_numpy() - x.mean())


@query("walk_forward_udf", f"SELECT date, maturity, y_hat FROM ({ols_sql(12)}) q", "fx_xy")
def q_walk_udf(fx):
    return W.walk_forward(fx.shared(xy(fx)), M, line, OOS, WGAP, 12).withColumn("y_hat", C.rnd("y_hat"))


# ---- several predictors -----------------------------------------------------------------------

FWD = [f"f{m}" for m in range(12, 85, 12)]
YLD = [f"y{m}" for m in range(12, 85, 12)]
MACRO = [f"{p}|{s}" for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"] for s in "FOP"]
GOALS = [f"rx{m}" for m in range(24, 85, 12)]
LAYOUT = W.Design({"forward": FWD, "yields": YLD, "macro": MACRO}, [*GOALS, "_mean"])
MACRO_GROUPS = [[LAYOUT.cols("macro")[i] for i in range(3 * g, 3 * g + 3)] for g in range(5)]


def inputs(fx: Fixtures):
    """Predictors: forwards, yields and log-difference macro series up to the last month that both tables have."""
    curve = fx.curve
    code = dense(fx).withColumn("tcode", F.lit(5))
    macro = T.apply_tcodes(code, ["series", "grp"]).withColumn("value", T.ffill("transformed", ["series", "grp"]))
    fwd = CV.forward_rates(curve).select("date", F.concat(F.lit("f"), F.col("maturity").cast("string")).alias("name"), F.col("fwd").alias("value"))
    yld = curve.select("date", F.concat(F.lit("y"), F.col("maturity").cast("string")).alias("name"), F.col("y").alias("value"))
    last = F.least(curve.select(F.max("date")).scalar(), macro.select(F.max("date")).scalar())
    features = fwd.unionByName(yld).unionByName(macro.select("date", F.col("series").alias("name"), "value")).where(F.col("date") <= last)
    rx = CV.excess_returns(curve, 12).where(F.col("date") <= last)
    each = rx.select("date", F.concat(F.lit("rx"), F.col("maturity").cast("string")).alias("name"), F.col("rx").alias("value"))
    mean = rx.groupBy("date").agg(F.avg("rx").alias("value")).withColumn("name", F.lit("_mean"))
    return features, each.unionByName(mean.select("date", "name", "value"))


def design(fx: Fixtures):
    """The design is read by several branches of one plan: store it."""
    return fx.shared(W.design_rows(*inputs(fx), LAYOUT))


def forecast(fx: Fixtures, steps: list[tuple], kind: str = "ols", every: int = 1, tune: int = 1):
    rows = design(fx)
    return W.predict(rows, W.coefficients(rows, LAYOUT, steps, OOS, WGAP, kind, every, tune), LAYOUT, OOS, WGAP, every)


FIVE = LAYOUT.cols("forward", 5)
CP = ("cp", FIVE, LAYOUT.target("_mean"))
OWN_CP = ("cp", FIVE, None)
ALL_MACRO = LAYOUT.cols("macro")
STEPS = {
    "fc_linear": [("raw", LAYOUT.cols("forward"))],
    "fc_cp": [("raw", FIVE)],
    "fc_pcr": [("pca", LAYOUT.cols("yields"), 3, False)],
    "fc_macro_pcr8": [("pca", ALL_MACRO, 8, True)],
    "fc_pcr_plus": [("pca", LAYOUT.cols("forward"), 3, True), ("pca", ALL_MACRO, 1, True)],
    "fc_group_pcr": [("pca", LAYOUT.cols("yields"), 3, True), *[("pca", g, 1, True) for g in MACRO_GROUPS]],
    "fc_yield_macro_pcs": [("pca", LAYOUT.cols("yields"), 3, False), ("pca", ALL_MACRO, 8, True)],
    "fc_cp_factors": [CP, ("pca", ALL_MACRO, 8, True)],
    "fc_cp_own": [OWN_CP],
    "fc_cp_own_factors": [OWN_CP, ("pca", ALL_MACRO, 8, True)],
}
PENALISED = {
    "fc_ridge": ("ridge", [("raw", ALL_MACRO), ("raw", LAYOUT.cols("forward"))]),
    "fc_lasso": ("lasso", [("raw", ALL_MACRO), ("raw", LAYOUT.cols("forward"))]),
    "fc_elasticnet": ("elasticnet", [("raw", ALL_MACRO), ("raw", LAYOUT.cols("forward"))]),
    "fc_ridge_cp": ("ridge", [("raw", ALL_MACRO), CP]),
    "fc_lasso_cp": ("lasso", [("raw", ALL_MACRO), CP]),
    "fc_elasticnet_cp": ("elasticnet", [("raw", ALL_MACRO), CP]),
    "fc_group_lasso": ("lasso", STEPS["fc_group_pcr"]),
}


# ---- DuckDB text of the least-squares models: expanding cross products, elimination, back substitution -----------

MACRO_SQL = ", ".join("'" + m + "'" for m in MACRO)
add_view("fx_design", f"""
    WITH t AS (SELECT series, date, value > 0 AND lag(value) OVER (PARTITION BY series ORDER BY date) > 0 AS ok FROM fx_dense WHERE series IN ({MACRO_SQL})),
         known AS (SELECT max(since) AS since, count(*) AS n FROM (SELECT series, min(date) AS since FROM t WHERE ok GROUP BY 1) q),
         ends AS (SELECT least((SELECT max(date) FROM fx_curve), (SELECT max(date) FROM fx_dense)) AS last),
         f AS (SELECT c.date, {', '.join(f"max(c.y) FILTER (WHERE c.maturity = {m}) AS y{m}" for m in range(12, 85, 12))} FROM fx_curve c GROUP BY 1),
         r AS (SELECT date, {', '.join(f"max(rx) FILTER (WHERE maturity = {m}) AS rx{m}" for m in range(24, 85, 12))} FROM fx_rx GROUP BY 1)
    SELECT f.date, year(f.date)*12 + month(f.date) AS m, f.date >= known.since AND known.n = {len(MACRO)} AS macro_known,
           {', '.join(f"{m / 12}e0*f.y{m}" + (f" - {m / 12 - 1}e0*f.y{m - 12}" if m > 12 else "") + f" AS f{m}" for m in range(12, 85, 12))},
           {', '.join(f"r.rx{m}" for m in range(24, 85, 12))}
    FROM f LEFT JOIN r ON r.date = f.date, known, ends WHERE f.date <= ends.last""", "fx_dense fx_curve fx_rx")


add_view("fx_z", f"""
    WITH t AS (SELECT series, date, CASE WHEN value > 0 THEN ln(value) END - lag(CASE WHEN value > 0 THEN ln(value) END) OVER (PARTITION BY series ORDER BY date) AS d FROM fx_dense),
         k AS (SELECT series, date, last_value(d IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS UNBOUNDED PRECEDING) AS d FROM t),
         c AS (SELECT date, {', '.join(f"max(y) FILTER (WHERE maturity = {m}) AS y{m}" for m in range(12, 85, 12))} FROM fx_curve GROUP BY 1),
         w AS (SELECT date, {', '.join(f"max(d) FILTER (WHERE series = '{s}') AS k{i}" for i, s in enumerate(MACRO))} FROM k GROUP BY 1),
         r AS (SELECT date, avg(rx) AS rmean, {', '.join(f"max(rx) FILTER (WHERE maturity = {m}) AS rx{m}" for m in range(24, 85, 12))} FROM fx_rx GROUP BY 1),
         ends AS (SELECT least((SELECT max(date) FROM fx_curve), (SELECT max(date) FROM fx_dense)) AS last)
    SELECT date, year(date)*12 + month(date) AS m, z, y, len(list_filter(list_concat(z, y), lambda v: v IS NULL)) = 0 AS ok
    FROM (SELECT date, [1e0, {', '.join(f"{m / 12}e0*y{m}" + (f" - {m / 12 - 1}e0*y{m - 12}" if m > 12 else "") for m in range(12, 85, 12))},
                 {', '.join(YLD)}, {', '.join(f"k{i}" for i in range(len(MACRO)))}] AS z, [{', '.join(GOALS)}, rmean] AS y
          FROM c FULL JOIN w USING (date) LEFT JOIN r USING (date)), ends WHERE date <= last""", "fx_dense fx_curve fx_rx")


def least_squares_sql(width: int, columns: str) -> str:
    """Fits of all targets on the first ``width`` forwards at every out-of-sample month; x<t>_<i> is coefficient i of target t."""
    xs = ["1e0", *FWD[:width]]
    ij = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    it = [(i, t) for i in range(width + 1) for t in range(len(GOALS))]
    full = " AND ".join(["macro_known", *[f"{c} IS NOT NULL" for c in FWD + GOALS]])
    sums = [f"sum({xs[i]}*{xs[j]}) AS a{i}_{j}" for i, j in ij] + [f"sum({xs[i]}*{GOALS[t]}) AS b{i}_{t}" for i, t in it]
    steps = [
        f"""o AS (SELECT date, m FROM fx_design WHERE date >= DATE '{OOS}'),
         e0 AS (SELECT o.date, {', '.join(sums)} FROM o JOIN fx_design d ON d.m <= o.m - {WGAP + 1} WHERE {full} GROUP BY o.date)"""
    ]
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    for k in range(width):
        a = [f"a{i}_{j} - a{k}_{i}*a{k}_{j}/a{k}_{k} AS a{i}_{j}" if i > k else f"a{i}_{j}" for i, j in ij]
        b = [f"b{i}_{t} - {at(k, i)}*b{k}_{t}/a{k}_{k} AS b{i}_{t}" if i > k else f"b{i}_{t}" for i, t in it]
        steps.append(f"e{k + 1} AS (SELECT date, {', '.join(a + b)} FROM e{k})")
    last = f"e{width}"
    for i in range(width, -1, -1):
        new = [f"(b{i}_{t}" + "".join(f" - a{i}_{j}*x{t}_{j}" for j in range(i + 1, width + 1)) + f")/a{i}_{i} AS x{t}_{i}" for t in range(len(GOALS))]
        steps.append(f"s{i} AS (SELECT *, {', '.join(new)} FROM {last})")
        last = f"s{i}"
    return f"WITH {', '.join(steps)} {columns}"


def forecast_sql(width: int) -> str:
    value = lambda t: f"x{t}_0 + " + " + ".join(f"x{t}_{i + 1}*d.{f}" for i, f in enumerate(FWD[:width]))
    parts = [f"SELECT s0.date, '{g}' AS target, round({value(t)}, 6) + 0 AS y_hat FROM s0 JOIN fx_design d ON d.date = s0.date" for t, g in enumerate(GOALS)]
    return least_squares_sql(width, " UNION ALL ".join(parts))


def importance_sql(width: int) -> str:
    names = ["(intercept)", *FWD[:width]]
    size = lambda t, i: f"round(avg(abs(x{t}_{i})), 5) + 0" if i <= width else "0e0"
    listed = [*enumerate(names), *((width + 1, n) for n in YLD + MACRO)]
    parts = [f"SELECT '{g}' AS target, '{n}' AS name, {size(t, i)} AS mean_abs, count(*) AS n_refits FROM s0" for t, g in enumerate(GOALS) for i, n in listed]
    return least_squares_sql(width, " UNION ALL ".join(parts))


# a regression on its own fitted value is that fit: the own factor alone forecasts as its predictors do
LEAST_SQUARES = {"fc_linear": len(FWD), "fc_cp": 5, "fc_cp_own": 5}


def _linear(name: str, steps: list[tuple]) -> None:
    if name in LEAST_SQUARES:
        @query(name, forecast_sql(LEAST_SQUARES[name]), "fx_design")
        def checked(fx):
            return forecast(fx, steps).withColumn("y_hat", C.rnd("y_hat", 6))
    else:
        @query(name, linear_model_sql(LAYOUT, steps, OOS, WGAP), "fx_z")
        def q(fx):
            return forecast(fx, steps).withColumn("y_hat", C.rnd("y_hat", 6))


def _penalised(name: str, kind: str, steps: list[tuple]) -> None:
    if kind == "ridge":
        @query(name, linear_model_sql(LAYOUT, steps, OOS, WGAP, kind), "fx_z")
        def checked(fx):
            return forecast(fx, steps, kind).withColumn("y_hat", C.rnd("y_hat", 6))
    else:
        @query(name)
        def q(fx):
            return forecast(fx, steps, kind)


CUBIC = (0, 2, 3, 7)


def _cubic(name: str, kind: str, lead: list[tuple]) -> None:
    if kind == "lasso":
        @query(name)
        def q(fx):
            return W.cubic_forecast(design(fx), LAYOUT, lead, ALL_MACRO, OOS, WGAP, kind, picked=CUBIC)
    else:
        steps = [*lead, ("pca", ALL_MACRO, max(CUBIC) + 1, True)]

        @query(name, linear_model_sql(LAYOUT, steps, OOS, WGAP, kind, cubic=CUBIC), "fx_z")
        def checked(fx):
            out = W.cubic_forecast(design(fx), LAYOUT, lead, ALL_MACRO, OOS, WGAP, kind, picked=CUBIC)
            return out.withColumn("y_hat", C.rnd("y_hat", 6))


for _n, _s in STEPS.items():
    _linear(_n, _s)
for _n, (_k, _s) in PENALISED.items():
    _penalised(_n, _k, _s)
_cubic("fc_macro_factors", "ols", [CP])
_cubic("fc_lasso_factors_fwd", "lasso", [("raw", LAYOUT.cols("forward"))])
_cubic("fc_ridge_factors_fwd", "ridge", [("raw", LAYOUT.cols("forward"))])
_cubic("fc_lasso_factors_cp", "lasso", [CP])
_cubic("fc_ridge_factors_cp", "ridge", [CP])


@query("fc_ridge_cadence", linear_model_sql(LAYOUT, PENALISED["fc_ridge"][1], OOS, WGAP, "ridge", 3, 4), "fx_z")
def q_cadence(fx):
    """Refit every third month and tune at every fourth refit."""
    kind, steps = PENALISED["fc_ridge"]
    return forecast(fx, steps, kind, every=3, tune=4).withColumn("y_hat", C.rnd("y_hat", 6))


@query("coef_importance", importance_sql(len(FWD)), "fx_design")
def q_importance(fx):
    rows = design(fx)
    return W.importance(W.coefficients(rows, LAYOUT, STEPS["fc_linear"], OOS, WGAP), LAYOUT).withColumn("mean_abs", C.rnd("mean_abs", 5))


TREES_ON = LAYOUT.cols("forward") + ALL_MACRO


@query("fc_forest")
def q_forest(fx):
    """All targets, every month a refit, tuned every sixtieth over the whole grid."""
    return FO.forest_forecast(design(fx), LAYOUT, TREES_ON, OOS, WGAP)


@query("fc_forest_group_pcs")
def q_forest_pcs(fx):
    """Trees on three yield components and one of each macro group, yearly refits."""
    grid = FO.Grid((200,), (5,), (1,))
    return FO.forest_forecast(design(fx), LAYOUT, TREES_ON, OOS, WGAP, grid, refit_every=12, tune_every=1, steps=STEPS["fc_group_pcr"])


GRID_ALPHAS = (1e-4, 1e-3, 1e-2, 0.1, 1.0, 10.0)
PC_GRID = O.component_variants([("pca", LAYOUT.cols("forward"), 3, True)], MACRO_GROUPS, [1, 2, 3])


@query("fc_group_pcr_grid")
def q_pc_grid(fx):
    """One, two or three components of every macro group, chosen at each refit."""
    return O.grid_forecast(design(fx), LAYOUT, PC_GRID, OOS, WGAP)


@query("fc_group_lasso_grid")
def q_lasso_grid(fx):
    """Components and the lasso's penalty chosen together."""
    return O.grid_forecast(design(fx), LAYOUT, PC_GRID, OOS, WGAP, GRID_ALPHAS)


@query("fc_group_lasso_fixed")
def q_lasso_fixed(fx):
    """One component of every macro group under a fixed penalty; the loss is reported, nothing is chosen by it."""
    return O.grid_forecast(design(fx), LAYOUT, PC_GRID[:1], OOS, WGAP, (1e-4,))
