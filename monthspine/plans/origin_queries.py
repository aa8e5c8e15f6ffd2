"""Queries: walk-forward fits on imputed, chosen and revised columns, and the log of refits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.calendar import month_end
from ..operators import origins as O
from ..operators import vintage as V
from ..operators import walkforward as W
from .fixtures import Fixtures, add_view
from .model_queries import FWD, GOALS, OOS, WGAP, inputs
from .registry import query
from .vintage_queries import vpanels

#: Series with gaps: quantities of six suppliers. The fifth starts 18 months late, the last ends 30 months early.
GAPPY = [f"s{i}" for i in range(1, 7)]
LATE, EARLY = 18, 30
PLAIN = ["f24", "f60"]


# ---- DuckDB text: moments of every origin from its own rows, elimination with pivots of dropped columns set to one ------


def eliminate(first: str, names: list[str], goals: list[str], key: str, kept: list[str] | None = None) -> tuple[str, str]:
    """Common table expressions that solve for all goals on (1, names); x<t>_<i> is coefficient i of goal t.

    ``first`` reads ``FROM`` rows with the columns key, names, goals and, with ``kept``, a 0/1 flag per name: the equations of
    a dropped name are replaced by 'coefficient = 0'. Returns the expressions and the name of the last one.
    """
    n = len(names)
    xs, flags = ["1e0", *names], ["1", *(kept or ["1"] * n)]
    ij = [(i, j) for i in range(n + 1) for j in range(i, n + 1)]
    it = [(i, t) for i in range(n + 1) for t in range(len(goals))]
    cell = lambda i, j: f"sum({xs[i]}*{xs[j]}*{flags[i]}*{flags[j]})" + (f" + max(1 - {flags[i]})" if i == j else "")
    sums = [f"{cell(i, j)} AS a{i}_{j}" for i, j in ij] + [f"sum({xs[i]}*{goals[t]}*{flags[i]}) AS b{i}_{t}" for i, t in it]
    steps = [f"e0 AS (SELECT {key}, {', '.join(sums)} {first} GROUP BY {key})"]
    at = lambda i, j: f"a{min(i, j)}_{max(i, j)}"
    for k in range(n):
        a = [f"a{i}_{j} - a{k}_{i}*a{k}_{j}/a{k}_{k} AS a{i}_{j}" if i > k else f"a{i}_{j}" for i, j in ij]
        b = [f"b{i}_{t} - {at(k, i)}*b{k}_{t}/a{k}_{k} AS b{i}_{t}" if i > k else f"b{i}_{t}" for i, t in it]
        steps.append(f"e{k + 1} AS (SELECT {key}, {', '.join(a + b)} FROM e{k})")
    last = f"e{n}"
    for i in range(n, -1, -1):
        new = [f"(b{i}_{t}" + "".join(f" - a{i}_{j}*x{t}_{j}" for j in range(i + 1, n + 1)) + f")/a{i}_{i} AS x{t}_{i}" for t in range(len(goals))]
        steps.append(f"c{i} AS (SELECT *, {', '.join(new)} FROM {last})")
        last = f"c{i}"
    return ", ".join(steps), last


def value_sql(t: int, names: list[str]) -> str:
    return f"x{t}_0" + "".join(f" + x{t}_{i + 1}*{c}" for i, c in enumerate(names))


# ---- imputed and chosen columns ---------------------------------------------------------------------


MONTH = "(year(last_day(l_shipdate))*12 + month(last_day(l_shipdate)))"
add_view("fx_gappy", f"""
    WITH ends AS (SELECT min({MONTH}) AS lo, max({MONTH}) AS hi FROM lineitem)
    SELECT last_day(l_shipdate) AS date, concat('s', CAST(l_suppkey AS VARCHAR)) AS name,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE)/(10e0*count(*)) AS value
    FROM lineitem, ends
    WHERE l_suppkey BETWEEN 1 AND 6 AND l_quantity <= 20 AND (l_suppkey <> 5 OR {MONTH} >= lo + {LATE}) AND (l_suppkey <> 6 OR {MONTH} <= hi - {EARLY})
    GROUP BY 1, 2""")
add_view("fx_gappy_rows", f"""
    SELECT d.date, d.m, {', '.join(f"any_value(d.{c}) AS {c}" for c in PLAIN + GOALS)},
           {', '.join(f"max(g.value) FILTER (WHERE g.name = '{s}') AS {s}" for s in GAPPY)}
    FROM fx_design d LEFT JOIN fx_gappy g ON g.date = d.date GROUP BY d.date, d.m""", "fx_design fx_gappy")
NAMES = [*PLAIN, *GAPPY]
GAPPY_LAYOUT = W.Design({"plain": PLAIN, "gappy": GAPPY}, GOALS)
COMPLETE = " AND ".join(f"{g} IS NOT NULL" for g in GOALS)


def origin_sql(impute: bool, tail: str) -> str:
    """Every origin's medians, kept columns and own row, then its fit on rows imputed for it alone."""
    train = f"g.m <= o.m - {WGAP + 1}"
    state = []
    for c in NAMES:
        state.append(f"max(g.m) FILTER (WHERE g.{c} IS NOT NULL AND g.m <= o.m) AS z_{c}")
        state.append(f"arg_max(g.{c}, g.m) FILTER (WHERE g.{c} IS NOT NULL AND g.m <= o.m) AS own_{c}")
        if impute:
            state.append(f"coalesce(median(g.{c}) FILTER (WHERE {train}), 0) AS med_{c}")
            state.append(f"""CASE WHEN min(g.m) FILTER (WHERE g.{c} IS NOT NULL AND g.m <= o.m) = min(g.m)
                AND max(g.m) FILTER (WHERE g.{c} IS NOT NULL AND g.m <= o.m) >= o.m - {WGAP + 1} THEN 1 ELSE 0 END AS k_{c}""")
        else:
            state.append(f"0e0 AS med_{c}, CASE WHEN count(g.{c}) FILTER (WHERE {train}) = count(*) FILTER (WHERE {train}) THEN 1 ELSE 0 END AS k_{c}")
    rows = ", ".join(f"coalesce(g.{c}, s.med_{c}) AS {c}, s.k_{c}" for c in NAMES)
    ctes, last = eliminate("FROM r", NAMES, GOALS, "origin", [f"k_{c}" for c in NAMES])
    return f"""
    WITH s AS (SELECT o.date, o.m, {', '.join(state)} FROM fx_gappy_rows o JOIN fx_gappy_rows g ON g.m <= o.m WHERE o.date >= DATE '{OOS}' GROUP BY o.date, o.m),
         r AS (SELECT s.m AS origin, {rows}, {', '.join(f'g.{t}' for t in GOALS)} FROM s JOIN fx_gappy_rows g ON g.m <= s.m - {WGAP + 1} WHERE {COMPLETE}),
         {ctes}
    {tail.replace('LAST', last)}"""


def forecasts_tail() -> str:
    own = [f"(CASE WHEN s.k_{c} = 1 THEN s.own_{c} ELSE 0 END)" for c in NAMES]
    kept = " + ".join(f"s.k_{c}" for c in NAMES)
    return " UNION ALL ".join(
        f"SELECT s.date, '{g}' AS target, CAST({kept} AS INTEGER) AS n_kept, round({value_sql(t, own)}, 6) + 0 AS y_hat FROM LAST f JOIN s ON s.m = f.origin"
        for t, g in enumerate(GOALS)
    )


def gappy(fx: Fixtures):
    """Long predictors with gaps and complete ones, and targets."""
    features, targets = inputs(fx)
    number = lambda c: F.year(c) * 12 + F.month(c)
    lines = fx.table("lineitem")
    line = lines.where(F.col("l_suppkey").between(1, 6) & (F.col("l_quantity") <= 20)).withColumn("date", month_end("l_shipdate"))
    lo, hi = (lines.select(f(number(month_end("l_shipdate")))).scalar() for f in (F.min, F.max))
    shown = ((F.col("l_suppkey") != 5) | (number("date") >= lo + LATE)) & ((F.col("l_suppkey") != 6) | (number("date") <= hi - EARLY))
    total = (F.sum(F.col("l_quantity").cast("bigint")).cast("double") / (F.lit(10.0) * F.count("*"))).alias("value")
    thin = line.where(shown).groupBy("date", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("name")).agg(total)
    features = fx.shared(features.where(F.col("name").isin(PLAIN)))
    last = features.select(F.max("date")).scalar()
    return features.unionByName(thin.where(F.col("date") <= last)), targets.where(F.col("name").isin(GOALS))


def gappy_fits(fx: Fixtures, impute: bool):
    return O.expanding_fits(*gappy(fx), GAPPY_LAYOUT, [("raw", list(range(1, GAPPY_LAYOUT.width)))], OOS, WGAP, impute=impute, shared=fx.shared)


def gappy_forecast(fx: Fixtures, impute: bool):
    fits, out = gappy_fits(fx, impute)
    kept = fits.select("target", F.make_date(F.floor((F.col("fit_m") - 1) / 12).cast("int"), (F.col("fit_m") - 1) % 12 + 1, F.lit(1)).alias("d"), F.size(F.filter("kept", lambda k: k)).alias("n_kept"))
    kept = kept.select("target", F.last_day("d").alias("date"), "n_kept")
    return out.join(kept, ["date", "target"]).select("date", "target", "n_kept", C.rnd("y_hat", 6).alias("y_hat"))


@query("walk_forward_imputed", origin_sql(True, forecasts_tail()), "fx_gappy_rows")
def q_imputed(fx):
    """Medians of the training months in interior gaps, columns without masked training cells, last known values ahead."""
    return gappy_forecast(fx, True)


@query("walk_forward_selected", origin_sql(False, forecasts_tail()), "fx_gappy_rows")
def q_selected(fx):
    """Columns complete in the origin's training months."""
    return gappy_forecast(fx, False)


# ---- log of refits ----------------------------------------------------------------------------------


def log_sql() -> str:
    """Fits on the first 85% of every origin's months, judged on the rest; all months are complete here by choice of columns."""
    rows = f"""r AS (SELECT o.m AS origin, g.m, {', '.join(f'g.{c}' for c in FWD + GOALS)},
                 g.m <= (SELECT min(m) FROM fx_design) + CAST(floor((o.m - {WGAP} - (SELECT min(m) FROM fx_design))*0.85) AS INTEGER) - 1 AS early
          FROM fx_design o JOIN fx_design g ON g.m <= o.m - {WGAP + 1} WHERE o.date >= DATE '{OOS}' AND {' AND '.join(f'g.{c} IS NOT NULL' for c in FWD + GOALS)})"""
    ctes, last = eliminate("FROM r WHERE early", FWD, GOALS, "origin")
    parts = [f"""SELECT r.origin AS fit_m, '{g}' AS target, 0e0 AS alpha, 1e0 AS mix, CAST(count(*) + any_value(n.n) AS BIGINT) AS n_train,
                 round(avg(power(r.{g} - ({value_sql(t, [f'r.{c}' for c in FWD])}), 2)), 8) + 0 AS val_loss
              FROM r JOIN {last} f ON f.origin = r.origin JOIN (SELECT origin, count(*) AS n FROM r WHERE early GROUP BY 1) n ON n.origin = r.origin
              WHERE NOT early GROUP BY r.origin""" for t, g in enumerate(GOALS)]
    return f"WITH {rows}, {ctes} {' UNION ALL '.join(parts)}"


LOG_LAYOUT = W.Design({"forward": FWD}, GOALS)


@query("refit_log", log_sql(), "fx_design")
def q_log(fx):
    """Every refit's penalty, training months and loss on the last 15% of them."""
    features, targets = inputs(fx)
    fits, _ = O.expanding_fits(
        features.where(F.col("name").isin(FWD)), targets.where(F.col("name").isin(GOALS)), LOG_LAYOUT, [("raw", LOG_LAYOUT.cols("forward"))], OOS, WGAP,
        impute=False, shared=fx.shared,
    )
    return fits.select("fit_m", "target", "alpha", "mix", "n_train", C.rnd("val_loss", 8).alias("val_loss"))


@query("refit_log_ridge")
def q_log_ridge(fx):
    """The same log of a ridge model with gaps imputed: the penalty in force is an output."""
    fits, _ = O.expanding_fits(
        *gappy(fx), GAPPY_LAYOUT, [("raw", list(range(1, GAPPY_LAYOUT.width)))], OOS, WGAP, kind="ridge", refit_every=12, shared=fx.shared,
    )
    return fits.select("fit_m", "target", "alpha", "mix", "n_train", "val_loss")


# ---- every origin on its own vintage panel ----------------------------------------------------------

LIVE_OOS = "1998-06-30"
LIVE = ["1-URGENT", "3-MEDIUM", "4-NOT SPECIFIED", "6-RATIO"]
LIVE_LAYOUT = W.Design({"forward": PLAIN, "macro": LIVE}, GOALS)
LIVE_COLS = [f"v{i}" for i in range(len(LIVE))]


def live_sql() -> str:
    wide = ", ".join(f"max(p.transformed) FILTER (WHERE p.series = '{s}') AS {c}" for s, c in zip(LIVE, LIVE_COLS))
    names = [*PLAIN, *LIVE_COLS]
    full = " AND ".join(f"{c} IS NOT NULL" for c in names)
    ctes, last = eliminate("FROM r WHERE m <= om - %d AND %s AND %s" % (WGAP + 1, full, COMPLETE), names, GOALS, "origin")
    parts = [f"SELECT r.origin AS date, '{g}' AS target, round({value_sql(t, names)}, 6) + 0 AS y_hat FROM {last} f JOIN r ON r.origin = f.origin AND r.m = r.om" for t, g in enumerate(GOALS)]
    return f"""
    WITH p AS (SELECT p.forecast_date AS origin, p.date, {wide} FROM fx_vpanel p WHERE p.forecast_date >= DATE '{LIVE_OOS}' GROUP BY 1, 2),
         r AS (SELECT p.*, year(p.origin)*12 + month(p.origin) AS om, d.m, {', '.join(f'd.{c}' for c in PLAIN + GOALS)} FROM p JOIN fx_design d ON d.date = p.date), {ctes}
    SELECT * FROM ({' UNION ALL '.join(parts)}) q WHERE y_hat IS NOT NULL"""


def live_rows(fx: Fixtures):
    """(origin, date, m, z): curve as it is, macro series as the origin knew them."""
    features, targets = inputs(fx)
    plain = features.where(F.col("name").isin(PLAIN)).select("date", F.lit("curve").alias("source"), F.col("name").alias("series"), "value")
    panels = fx.shared(vpanels(fx).where(F.col("series").isin(LIVE)))
    names = fx.registry.where(F.col("series").isin(LIVE))
    macro = panels.select("date", F.lit("macro").alias("source"), "series", F.col("transformed").alias("value"))
    origins = panels.select("forecast_date").distinct()
    last = panels.select(F.max("forecast_date")).scalar()
    first = panels.select(F.min("forecast_date")).scalar()
    long = V.realtime_features(plain.unionByName(macro), panels, origins, names, first, last)
    long = long.select("origin", "date", F.col("series").alias("name"), "value")
    return fx.shared(O.revised_design(long, targets.where(F.col("name").isin(GOALS)), LIVE_LAYOUT))


@query("walk_forward_realtime", live_sql(), "fx_vpanel fx_design")
def q_live(fx):
    """Every origin is fitted on the macro panel of its own vintage."""
    _, out = O.revised_fits(live_rows(fx), LIVE_LAYOUT, [("raw", list(range(1, LIVE_LAYOUT.width)))], LIVE_OOS, WGAP)
    return out.where(F.col("y_hat").isNotNull()).select("date", "target", C.rnd("y_hat", 6).alias("y_hat"))
