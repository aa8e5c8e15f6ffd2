"""Queries: benchmarks, scores, significance, ensembles and portfolio value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.calendar import month_number
from ..operators import benchmarks as B
from ..operators import ensemble as E
from ..operators import portfolio as PF
from ..operators import regimes as R
from ..operators import scoring as S
from ..operators import significance as G
from ..operators.panel import densify
from .fixtures import Fixtures, add_view
from .registry import query

GAP = 2
M = ["maturity"]
MM = ["model", "maturity"]


def truth(fx: Fixtures):
    return densify(fx.curve, M, ["y"], own_span=True)


# ---- benchmarks -------------------------------------------------------------------------------

FRAME = "PARTITION BY maturity ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND {n} PRECEDING"


def mean_sql(gap: int) -> str:
    return f"avg(y) OVER ({FRAME.format(n=gap + 1)})"


ALPHA_SQL = "(1e0 - exp(-ln(2e0)/12e0))"
add_view("fx_bench", f"""
    SELECT date, maturity, y, {mean_sql(GAP)} AS hist_mean, avg(y) OVER (PARTITION BY maturity ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS rolling,
           CASE WHEN len(ys) > 0 THEN list_reduce(ys, lambda a, x: {ALPHA_SQL}*x + (1e0 - {ALPHA_SQL})*a) END AS ewma,
           CASE WHEN np >= 2 THEN ri + rs*x WHEN np = 1 THEN my*(1 + mx*x)/(1 + mx*mx) END AS ar1, 0e0 AS zero
    FROM (SELECT *, array_agg(y) OVER ({FRAME.format(n=1)}) AS ys, regr_slope(y, x) OVER ({FRAME.format(n=1)}) AS rs,
                 regr_intercept(y, x) OVER ({FRAME.format(n=1)}) AS ri, count(x) OVER ({FRAME.format(n=1)}) AS np,
                 avg(CASE WHEN x IS NOT NULL THEN y END) OVER ({FRAME.format(n=1)}) AS my, avg(x) OVER ({FRAME.format(n=1)}) AS mx
          FROM (SELECT *, lag(y) OVER (PARTITION BY maturity ORDER BY date) AS x FROM fx_curve) p) q""", "fx_curve")


def benches(fx: Fixtures):
    return B.with_benchmarks(truth(fx), M, gap=GAP, halflife=12, window=24)


for _k in B.BENCHMARKS:
    def _register(kind: str) -> None:
        @query(f"bench_{kind}", f"SELECT date, maturity, round({kind}, 10) + 0 AS bench FROM fx_bench", "fx_bench")
        def q_bench(fx):
            return B.with_benchmarks(truth(fx), M, GAP, 12, 24, kinds=[kind]).select("date", "maturity", C.rnd(kind, 10).alias("bench"))

    _register(_k)


# ---- scores -----------------------------------------------------------------------------------

add_view("fx_scored", """
    SELECT m.model, b.*, m.y_hat, b.hist_mean AS bench FROM fx_models m JOIN fx_bench b ON b.date = m.date AND b.maturity = m.maturity""", "fx_models fx_bench")


def scored(fx: Fixtures, kinds=("hist_mean",)):
    """Model forecasts next to the truth and its benchmarks; the truth side is one row per cell."""
    b = B.with_benchmarks(truth(fx), M, gap=GAP, halflife=12, window=24, kinds=list(kinds))
    return fx.models.join(b, ["date", "maturity"]).withColumn("bench", F.col(kinds[0]))


add_view("fx_rw", f"""
    SELECT date, maturity, y, lag(y, {GAP + 1}) OVER (PARTITION BY maturity ORDER BY date) AS y_hat, hist_mean AS bench FROM fx_bench""", "fx_bench")


def r2_sql(keys: str, view: str, bench: str = "bench", where: str = "true", y_hat: str = "y_hat") -> str:
    ok = f"{y_hat} IS NOT NULL AND {bench} IS NOT NULL AND y IS NOT NULL"
    return f"""SELECT {keys}, CAST(count(*) FILTER (WHERE {ok}) AS BIGINT) AS n,
        round(1 - sum(pow(y - {y_hat}, 2)) FILTER (WHERE {ok}) / nullif(sum(pow(y - {bench}, 2)) FILTER (WHERE {ok}), 0), 6) + 0 AS r2
        FROM {view} WHERE {where} GROUP BY ALL"""


def rw(fx: Fixtures):
    return truth(fx).select(
        "date", "maturity", "y", B.random_walk("y", M, GAP).alias("y_hat"), B.hist_mean("y", M, GAP).alias("bench")
    )


@query("oos_r2", r2_sql("maturity", "fx_rw"), "fx_rw")
def q_oos(fx):
    out = rw(fx).groupBy("maturity").agg(S.r2(S.both()).alias("r2"), F.count(F.when(S.both(), 1)).alias("n"))
    return out.withColumn("r2", C.rnd("r2"))


@query("oos_r2_benchmarks", " UNION ALL ".join(r2_sql(f"model, maturity, '{b}' AS benchmark", "fx_scored", b) for b in B.BENCHMARKS), "fx_scored")
def q_oos_all(fx):
    return S.oos_r2(scored(fx, B.BENCHMARKS), MM, B.BENCHMARKS).withColumn("r2", C.rnd("r2"))


START, SECOND = "1997-01-31", "1999-06-30"
add_view("fx_cssed", f"""
    SELECT model, maturity, date, sum(pow(y - bench, 2) - pow(y - y_hat, 2)) OVER (PARTITION BY model, maturity ORDER BY date) AS cssed
    FROM fx_scored WHERE date >= DATE '{START}'""", "fx_scored")


@query("cssed", "SELECT model, maturity, date, round(cssed, 10) + 0 AS cssed FROM fx_cssed", "fx_cssed")
def q_cssed(fx):
    return S.cssed(scored(fx), MM, START).select("model", "maturity", "date", C.rnd("cssed", 10).alias("cssed"))


@query("cssed_rebased", f"""
    SELECT c.model, c.maturity, c.date, round(c.cssed - s.cssed, 10) + 0 AS cssed_rebased FROM fx_cssed c
    LEFT JOIN (SELECT * FROM fx_cssed WHERE date = DATE '{SECOND}') s ON s.model = c.model AND s.maturity = c.maturity""", "fx_cssed")
def q_cssed2(fx):
    return S.cssed(scored(fx), MM, START, SECOND).select("model", "maturity", "date", C.rnd("cssed_rebased", 10).alias("cssed_rebased"))


# ---- significance -----------------------------------------------------------------------------


def t_tail_sql(t: str, df: str) -> str:
    """Upper tail of Student's t by Simpson's rule."""
    pdf = f"pow(1 + pow(abs({t})*i/2000e0, 2)/({df}), -(({df}) + 1)/2e0)"
    return f"""(0.5e0 - sign({t})*(abs({t})/6000e0)*exp(lgamma((({df}) + 1)/2e0) - lgamma(({df})/2e0))/sqrt(({df})*pi())
        *list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)*{pdf})))"""


def moments_sql(keys: str, view: str, value: str, lags: int) -> str:
    """n, mean and autocovariance sums g0..g<lags> of the non-null values per key, in date order."""
    ks = ", ".join(f"coalesce(sum(e*lag{k}), 0) AS g{k}" for k in range(1, lags + 1))
    lg = ", ".join(f"lag(e, {k}) OVER w AS lag{k}" for k in range(1, lags + 1))
    return f"""SELECT {keys}, CAST(count(*) AS BIGINT) AS n, max(mu) AS mean, sum(e*e) AS g0, {ks}
        FROM (SELECT *, {lg} FROM (SELECT {keys}, date, v - avg(v) OVER (PARTITION BY {keys}) AS e, avg(v) OVER (PARTITION BY {keys}) AS mu
              FROM (SELECT {keys}, date, {value} AS v FROM {view}) a WHERE v IS NOT NULL) b WINDOW w AS (PARTITION BY {keys} ORDER BY date)) c
        GROUP BY {keys}"""


CW = "pow(y - bench, 2) - pow(y - y_hat, 2) + pow(bench - y_hat, 2)"
HAC = "g0 + " + " + ".join(f"2*(1 - {k}/13e0)*g{k}" for k in range(1, 13))


def cw_sql(keys: str, view: str) -> str:
    return f"""SELECT {keys}, n, round(mean, 10) + 0 AS mean, round(t, 6) + 0 AS t_stat, round({t_tail_sql('t', 'n - 1')}, 6) + 0 AS p_value
        FROM (SELECT {keys}, n, mean, CASE WHEN {HAC} > 0 THEN mean*n/sqrt({HAC}) END AS t FROM ({moments_sql(keys, view, CW, 12)}) m) q"""


def rounded(df, **digits):
    for c, d in digits.items():
        df = df.withColumn(c, C.rnd(c, d))
    return df


@query("clark_west", cw_sql("model, maturity", "fx_scored"), "fx_scored")
def q_cw(fx):
    return rounded(G.clark_west(scored(fx), MM), mean=10, t_stat=6, p_value=6)


def hln_sql(h: int) -> str:
    return f"((n + 1e0 - {2 * h} + {h * (h - 1)}e0/n)/n)"


def lrv_sql(h: int) -> str:
    return "((g0 + " + " + ".join(f"2*g{k}" for k in range(1, h)) + ")/n)"


def dm_sql(keys: str, view: str, value: str, h: int = 12) -> str:
    var = f"({hln_sql(h)}/n*{lrv_sql(h)})"
    return f"""SELECT {keys}, n, mean, CASE WHEN n >= {max(5, h + 1)} AND {hln_sql(h)} > 0 AND {var} > 0 THEN mean/sqrt({var}) END AS dm_stat
        FROM ({moments_sql(keys, view, value, h - 1)}) m"""


LOSS_DIFF = "pow(y - bench, 2) - pow(y - y_hat, 2)"


@query("dm_hln", f"""
    SELECT model, maturity, n, round(mean, 10) + 0 AS mean, round(dm_stat, 6) + 0 AS dm_stat, round({t_tail_sql('dm_stat', 'n - 1')}, 6) + 0 AS p_value
    FROM ({dm_sql('model, maturity', 'fx_scored', LOSS_DIFF, 4)}) q""", "fx_scored")
def q_dm(fx):
    d = scored(fx).withColumn("d", S.sq("y", "bench") - S.sq("y", "y_hat"))
    return rounded(G.dm_hln(d, MM, "d", 4), mean=10, dm_stat=6, p_value=6)


add_view("fx_pairs", """
    WITH l AS (SELECT m.model, m.date, m.maturity, pow(c.y - m.y_hat, 2) AS loss FROM fx_models m JOIN fx_curve c ON c.date = m.date AND c.maturity = m.maturity),
         ok AS (SELECT date, maturity FROM l GROUP BY 1,2 HAVING count(*) = 6)
    SELECT a.maturity, a.date, a.model AS model_a, b.model AS model_b, a.loss - b.loss AS d
    FROM l a JOIN l b ON a.date = b.date AND a.maturity = b.maturity AND a.model <> b.model JOIN ok ON ok.date = a.date AND ok.maturity = a.maturity""", "fx_models fx_curve")


@query("dm_matrix", f"""
    SELECT maturity, model_a, model_b, n, round(mean, 10) + 0 AS mean, round(s, 6) + 0 AS dm_stat, round(1 - {t_tail_sql('s', 'n - 1')}, 6) + 0 AS p_value
    FROM (SELECT *, CASE WHEN {hln_sql(4)} > 0 AND {lrv_sql(4)} > 0 THEN sqrt({hln_sql(4)})*mean/sqrt({lrv_sql(4)}/n) END AS s
          FROM ({moments_sql('maturity, model_a, model_b', 'fx_pairs', 'd', 3)}) m) q""", "fx_pairs")
def q_dm_matrix(fx):
    rows = fx.shared(fx.models.join(fx.curve, ["date", "maturity"]))
    return rounded(G.dm_pairs(rows, "maturity", "model", 4), mean=10, dm_stat=6, p_value=6)


# ---- regimes ----------------------------------------------------------------------------------

add_view("fx_flagged", """
    SELECT c.*, EXISTS (SELECT 1 FROM fx_regimes r WHERE c.date BETWEEN last_day(r.start_date) AND last_day(r.end_date)) AS flag FROM fx_curve c""", "fx_curve fx_regimes")


def flagged(fx: Fixtures):
    return R.flag_regime(fx.curve, fx.regimes)


@query("permutation_test", """
    WITH o AS (SELECT maturity, avg(y) FILTER (WHERE flag) AS mi, avg(y) FILTER (WHERE NOT flag) AS mo, avg(y) AS ms, count(*) FILTER (WHERE flag) AS ni, count(*) AS n FROM fx_flagged GROUP BY 1),
         p AS (SELECT f.maturity, k.r, f.y, row_number() OVER (PARTITION BY f.maturity, k.r ORDER BY md5(concat(CAST(f.date AS VARCHAR), '|', CAST(k.r AS VARCHAR)))) AS rn
               FROM fx_flagged f CROSS JOIN (SELECT unnest(range(1, 1000)) AS r) k),
         d AS (SELECT p.maturity, r, sum(y) FILTER (WHERE rn <= ni)/max(ni) - sum(y) FILTER (WHERE rn > ni)/(max(n) - max(ni)) AS nd FROM p JOIN o ON o.maturity = p.maturity GROUP BY 1,2)
    SELECT o.maturity, CAST(ni AS INTEGER) AS n_in, CAST(n - ni AS INTEGER) AS n_out, round(mi, 10) + 0 AS mean_in, round(mo, 10) + 0 AS mean_out, round(ms, 10) + 0 AS sample_mean,
           round(mi - mo, 10) + 0 AS diff, round(x.p, 6) + 0 AS perm_p
    FROM o JOIN (SELECT d.maturity, avg(CASE WHEN abs(nd) >= abs(mi - mo) THEN 1e0 ELSE 0e0 END) AS p FROM d JOIN o ON o.maturity = d.maturity GROUP BY 1) x ON x.maturity = o.maturity""", "fx_flagged")
def q_perm(fx):
    out = G.permutation_test(flagged(fx), M, "y", "flag", 999)
    return rounded(out, mean_in=10, mean_out=10, sample_mean=10, diff=10, perm_p=6)


def normal_tail_sql(z: str) -> str:
    return f"""greatest(0e0, 0.5e0 - ({z}/6000e0)/sqrt(2*pi())*list_sum(list_transform(range(0, 2001),
        lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1e0 WHEN i % 2 = 1 THEN 4e0 ELSE 2e0 END)*exp(-pow({z}*i/2000e0, 2)/2))))"""


@query("mann_whitney", f"""
    WITH r AS (SELECT *, rank() OVER (PARTITION BY maturity ORDER BY y) + (count(*) OVER (PARTITION BY maturity, y) - 1)/2e0 AS rk,
                      count(*) OVER (PARTITION BY maturity, y) AS ties FROM fx_flagged),
         g AS (SELECT maturity, avg(y) FILTER (WHERE flag) AS mi, avg(y) FILTER (WHERE NOT flag) AS mo, median(y) FILTER (WHERE flag) AS di, median(y) FILTER (WHERE NOT flag) AS dno,
                      CAST(count(*) FILTER (WHERE flag) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT flag) AS DOUBLE) AS n2,
                      sum(rk) FILTER (WHERE flag) AS rs, CAST(sum(ties*ties - 1) AS DOUBLE) AS t FROM r GROUP BY 1),
         u AS (SELECT *, rs - n1*(n1 + 1)/2 AS u FROM g),
         z AS (SELECT *, (greatest(u, n1*n2 - u) - n1*n2/2 - 0.5e0)/sqrt(n1*n2/12*((n1 + n2 + 1) - t/((n1 + n2)*(n1 + n2 - 1)))) AS z FROM u)
    SELECT maturity, round(mi, 10) + 0 AS mean_in, round(mo, 10) + 0 AS mean_out, round(di, 10) + 0 AS median_in, round(dno, 10) + 0 AS median_out, CAST(n1 AS BIGINT) AS n_in, CAST(n2 AS BIGINT) AS n_out,
           u AS u_stat, round(mi - mo, 10) + 0 AS mean_diff, round(least(1, 2*{normal_tail_sql('z')}), 6) + 0 AS p_value FROM z""", "fx_flagged")
def q_mw(fx):
    return rounded(G.mann_whitney(flagged(fx), M, "y", "flag"), mean_in=10, mean_out=10, median_in=10, median_out=10, mean_diff=10, p_value=6)


@query("episode_means", """
    SELECT c.maturity, r.episode, round(avg(c.y), 10) + 0 AS mean, CAST(count(*) AS BIGINT) AS n_months
    FROM fx_curve c JOIN fx_regimes r ON c.date BETWEEN last_day(r.start_date) AND last_day(r.end_date) GROUP BY 1,2""", "fx_curve fx_regimes")
def q_episode(fx):
    return rounded(G.episode_means(fx.curve, M, "y", R.regime_months(fx.regimes)), mean=10)


# ---- score tables -----------------------------------------------------------------------------

PERIODS = [("early", "1996-01-31", "1998-12-31"), ("late", "1999-01-31", "2001-11-30"), ("all", "1996-01-31", "2001-11-30")]
PERIOD_VIEW = " UNION ALL ".join(f"SELECT *, '{n}' AS period FROM fx_scored WHERE date BETWEEN DATE '{a}' AND DATE '{b}'" for n, a, b in PERIODS)
add_view("fx_periods", PERIOD_VIEW, "fx_scored")


@query("period_scores", f"""
    SELECT s.model, s.maturity, s.period, s.n, s.r2, c.t_stat, c.p_value FROM ({r2_sql('model, maturity, period', 'fx_periods')}) s
    JOIN ({cw_sql('model, maturity, period', 'fx_periods')}) c ON c.model = s.model AND c.maturity = s.maturity AND c.period = s.period""", "fx_periods")
def q_periods(fx):
    rows = S.in_periods(scored(fx), PERIODS)
    keys = [*MM, "period"]
    score = rows.groupBy(*keys).agg(
        S.r2(S.both()).alias("r2"), F.count(F.when(S.both(), 1)).alias("n"), G.ordered_values(G.clark_west_term()).alias("_f"))
    t = G.with_hac_tstat(score.withColumnRenamed("n", "n_r2"), "_f").drop("_f", "mean", "n_r2")
    t = t.withColumn("p_value", G.student_t_upper(F.col("t_stat"), F.col("n") - 1))
    return rounded(t, r2=6, t_stat=6, p_value=6)


RUN = ["run_id", "model", "maturity", "winsorized", "frequency", "gap"]
add_view("fx_log", """
    SELECT concat(m.model, '-', CAST(m.maturity AS VARCHAR)) AS run_id, m.model, m.maturity, m.maturity % 24 = 0 AS winsorized,
           CASE WHEN m.model IN ('m0','m1','m2') THEN 'annual' ELSE 'monthly' END AS frequency, 1 AS gap, m.date, c.y, CASE WHEN m.date >= DATE '1996-01-31' THEN m.y_hat END AS y_hat
    FROM fx_models m JOIN fx_curve c ON c.date = m.date AND c.maturity = m.maturity
    WHERE NOT (m.model = 'm5' AND m.date > DATE '1999-06-30')""", "fx_models fx_curve")
RUN_SQL = ", ".join(RUN)
add_view("fx_cut", f"""
    WITH k AS (SELECT * FROM (VALUES ('mid', DATE '1999-12-31'), ('full', DATE '2001-11-30'), ('over', DATE '2003-12-31')) v(eval_period, cut)),
         e AS (SELECT l.*, k.eval_period, last_day(k.cut - to_months(CASE WHEN frequency = 'annual' THEN 12 ELSE 1 END)) AS eval_end,
                      max(date) OVER (PARTITION BY {RUN_SQL}, k.eval_period) AS run_last FROM fx_log l CROSS JOIN k),
         b AS (SELECT *, count(*) OVER (PARTITION BY {RUN_SQL}, eval_period) AS nr, count(y_hat) OVER (PARTITION BY {RUN_SQL}, eval_period) AS n_oos,
                      avg(y) OVER (PARTITION BY {RUN_SQL}, eval_period ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS bench
               FROM e WHERE run_last >= eval_end AND date <= eval_end)
    SELECT * FROM b WHERE nr >= 2 AND n_oos >= 2""", "fx_log")


@query("rescore_periods", f"""
    SELECT s.*, c.t_stat, c.p_value FROM ({r2_sql(RUN_SQL + ', eval_period, eval_end, n_oos', 'fx_cut')}) s
    JOIN ({cw_sql('run_id, eval_period', 'fx_cut')}) c ON c.run_id = s.run_id AND c.eval_period = s.eval_period""", "fx_cut")
def q_rescore(fx):
    log = fx.models.join(fx.curve, ["date", "maturity"]).where(~((F.col("model") == "m5") & (F.col("date") > "1999-06-30"))).select(
        F.concat("model", F.lit("-"), F.col("maturity").cast("string")).alias("run_id"), "model", "maturity",
        (F.col("maturity") % 24 == 0).alias("winsorized"),
        F.when(F.col("model").isin("m0", "m1", "m2"), "annual").otherwise("monthly").alias("frequency"),
        F.lit(1).alias("gap"), "date", "y", F.when(F.col("date") >= "1996-01-31", F.col("y_hat")).alias("y_hat"),
    )
    rows = S.cut_periods(log, RUN, {"mid": "1999-12-31", "full": "2001-11-30", "over": "2003-12-31"}, {"annual": 12, "monthly": 1})
    keys = [*RUN, "eval_period", "eval_end", "n_oos"]
    rows = rows.withColumn("bench", B.hist_mean("y", [*RUN, "eval_period"], 1))
    score = rows.groupBy(*keys).agg(
        S.r2(S.both()).alias("r2"), F.count(F.when(S.both(), 1)).alias("n_scored"), G.ordered_values(G.clark_west_term()).alias("_f"))
    t = G.with_hac_tstat(score, "_f").drop("_f", "mean")
    t = t.withColumn("p_value", G.student_t_upper(F.col("t_stat"), F.col("n") - 1)).drop("n").withColumnRenamed("n_scored", "n")
    return rounded(t, r2=6, t_stat=6, p_value=6)


GAPS = [0, 1, 3, 6, 11]


@query("gap_experiment", " UNION ALL ".join(
    f"""SELECT maturity, {g} AS gap, CAST(count(*) FILTER (WHERE f IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS n,
        round(1 - sum(pow(y - f, 2)) FILTER (WHERE b IS NOT NULL)/nullif(sum(pow(y - b, 2)) FILTER (WHERE f IS NOT NULL), 0), 6) + 0 AS r2
        FROM (SELECT date, maturity, y, CASE WHEN date >= DATE '{START}' THEN lag(y, {g + 1}) OVER (PARTITION BY maturity ORDER BY date) END AS f, {mean_sql(g)} AS b FROM fx_curve) q{g} GROUP BY 1"""
    for g in GAPS), "fx_curve")
def q_gap(fx):
    return rounded(S.gap_experiment(truth(fx), M, GAPS, START), r2=6)


STARTS = ["1996-01-31", "1997-01-31", "1998-01-31", "1999-01-31", "2000-01-31"]


@query("oos_start_grid", " UNION ALL ".join(
    f"""SELECT model, maturity, DATE '{s}' AS oos_start, CAST(count(*) AS BIGINT) AS n_eval,
        round(1 - sum(pow(y - y_hat, 2)) FILTER (WHERE bench IS NOT NULL)/nullif(sum(pow(y - bench, 2)), 0), 6) + 0 AS r2
        FROM fx_scored WHERE date BETWEEN DATE '{s}' AND DATE '2001-06-30' GROUP BY 1,2""" for s in STARTS), "fx_scored")
def q_grid(fx):
    return rounded(S.start_grid(scored(fx), MM, STARTS, "2001-06-30"), r2=6)


@query("fragility_summary", f"""
    WITH s AS (SELECT r.model AS config, r.maturity, r.r2, c.p_value AS p FROM ({r2_sql('model, maturity', 'fx_scored')}) r JOIN ({cw_sql('model, maturity', 'fx_scored')}) c ON c.model = r.model AND c.maturity = r.maturity),
         g AS (SELECT maturity, min(r2) AS mn, median(r2) AS md, max(r2) AS mx, count(*) FILTER (WHERE r2 > 0) AS pos, count(*) FILTER (WHERE p < 0.10) AS sig, count(r2) AS n, max(r2) FILTER (WHERE config = 'm0') AS base FROM s GROUP BY 1)
    SELECT maturity, round(100*base, 4) + 0 AS baseline, round(100*mn, 4) + 0 AS min, round(100*md, 4) + 0 AS median, round(100*mx, 4) + 0 AS max, round(100*(mx - mn), 4) + 0 AS range,
           concat(CAST(pos AS VARCHAR), '/', CAST(n AS VARCHAR)) AS positive, concat(CAST(sig AS VARCHAR), '/', CAST(n AS VARCHAR)) AS significant FROM g""", "fx_scored")
def q_fragility(fx):
    rows = scored(fx)
    score = rows.groupBy(*MM).agg(S.r2(S.both()).alias("r2"), G.ordered_values(G.clark_west_term()).alias("_f"))
    t = G.with_hac_tstat(score.withColumn("r2", C.rnd("r2")), "_f")
    t = t.withColumn("p", C.rnd(G.student_t_upper(F.col("t_stat"), F.col("n") - 1)))
    return rounded(S.fragility_summary(t, "maturity", "model", "m0"), baseline=4, min=4, median=4, max=4, range=4)


@query("variant_comparison", f"""
    WITH s AS (SELECT CASE WHEN model IN ('m0','m2') THEN 'dense' ELSE 'sparse' END AS macro_source, CASE WHEN model IN ('m0','m1') THEN 'raw' ELSE 'pca' END AS feature_method, * FROM fx_scored WHERE maturity = 60),
         a AS ({r2_sql('macro_source, feature_method', 's')}), z AS ({r2_sql('macro_source, feature_method', 's', 'zero')}),
         x AS (SELECT 'dense' AS macro_source, count(*) FILTER (WHERE value IS NULL) AS miss, count(DISTINCT series) AS cols, count(DISTINCT date) AS rows FROM fx_dense
               UNION ALL SELECT 'sparse', count(*) FILTER (WHERE value IS NULL), count(DISTINCT series), count(DISTINCT date) FROM fx_sparse_dense)
    SELECT a.macro_source, a.feature_method, a.r2 AS r2_hist_mean, z.r2 AS r2_zero, CAST(x.miss AS BIGINT) AS macro_missing_cells, CAST(x.cols AS BIGINT) AS macro_cols,
           CAST(CASE WHEN a.feature_method = 'raw' THEN x.cols ELSE least(8, x.rows, x.cols) END AS BIGINT) AS feature_cols
    FROM a JOIN z ON z.macro_source = a.macro_source AND z.feature_method = a.feature_method JOIN x ON x.macro_source = a.macro_source""", "fx_scored fx_dense fx_sparse_dense")
def q_variants(fx):
    from ..operators.quality import panel_shape
    from .panel_queries import dense, sparse_dense

    rows = scored(fx, ["hist_mean", "zero"]).where(F.col("maturity") == 60).select(
        "*", F.when(F.col("model").isin("m0", "m2"), "dense").otherwise("sparse").alias("macro_source"),
        F.when(F.col("model").isin("m0", "m1"), "raw").otherwise("pca").alias("feature_method"))
    shapes = {"dense": panel_shape(fx.shared(dense(fx))), "sparse": panel_shape(fx.shared(sparse_dense(fx)))}
    out = S.variant_table(fx.shared(rows), shapes, ["hist_mean", "zero"], 8)
    return rounded(out, r2_hist_mean=6, r2_zero=6)


# ---- ensembles --------------------------------------------------------------------------------

ENS = "SELECT date, maturity, round(avg(y_hat), 10) + 0 AS y_hat, CAST(count(*) AS BIGINT) AS members FROM {v} GROUP BY 1,2"
add_view("fx_topk", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, maturity ORDER BY val_loss, seed) AS rank FROM fx_forecast) q WHERE rank <= 5", "fx_forecast")


def ensemble(members):
    return rounded(E.combine(members), y_hat=10)


@query("topk_val_loss", ENS.format(v="fx_topk"), "fx_topk")
def q_topk(fx):
    return ensemble(E.members_by_validation(fx.forecast, 5))


@query("topk_members", "SELECT date, maturity, seed, CAST(rank AS INTEGER) AS rank FROM fx_topk", "fx_topk")
def q_members(fx):
    return E.members_by_validation(fx.forecast, 5).select("date", "maturity", "seed", "rank")


@query("topk_total", """
    WITH m AS (SELECT date, seed, row_number() OVER (PARTITION BY date ORDER BY l, seed) AS rank FROM (SELECT date, seed, round(avg(val_loss), 12) AS l FROM fx_forecast GROUP BY 1,2) q),
         t AS (SELECT f.* FROM fx_forecast f JOIN m ON m.date = f.date AND m.seed = f.seed WHERE m.rank <= 5)
    """ + ENS.format(v="t"), "fx_forecast")
def q_total(fx):
    return ensemble(E.members_total(fx.forecast, 5))


LB, LAG, MIN_H = 24, 1, 6
add_view("fx_seed_cells", """
    SELECT s.seed, s.maturity, m.date, f.y_hat, f.val_loss, c.y, pow(c.y - f.y_hat, 2) AS e2
    FROM (SELECT DISTINCT seed, maturity FROM fx_forecast) s
    CROSS JOIN (SELECT last_day(CAST(m AS DATE)) AS date FROM (SELECT unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS m FROM (SELECT min(date) AS lo, max(date) AS hi FROM fx_forecast) b) g) m
    LEFT JOIN fx_forecast f ON f.seed = s.seed AND f.maturity = s.maturity AND f.date = m.date
    LEFT JOIN fx_curve c ON c.date = m.date AND c.maturity = s.maturity""", "fx_forecast fx_curve")
add_view("fx_trailing", f"""
    WITH t AS (SELECT *, avg(e2) OVER w AS mse, count(e2) OVER w AS nh FROM fx_seed_cells
               WINDOW w AS (PARTITION BY seed, maturity ORDER BY date ROWS BETWEEN {LAG + LB} PRECEDING AND {LAG + 1} PRECEDING)),
         u AS (SELECT *, CASE WHEN nh >= {MIN_H} THEN mse END AS tl FROM t),
         v AS (SELECT *, count(tl) OVER (PARTITION BY date, maturity) > 0 AS by_trailing FROM u),
         x AS (SELECT *, CASE WHEN by_trailing THEN tl ELSE val_loss END AS loss FROM v)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, maturity ORDER BY round(loss, 12), seed) AS rank FROM x WHERE loss IS NOT NULL) q WHERE rank <= 5""", "fx_seed_cells")


def trailing(fx: Fixtures, k: int = 5):
    return E.members_by_trailing(fx.forecast, fx.curve, k, LB, MIN_H, LAG)


@query("topk_trailing", ENS.format(v="fx_trailing"), "fx_trailing")
def q_trailing(fx):
    return ensemble(trailing(fx))


@query("topk_total_trailing", f"""
    WITH p AS (SELECT seed, date, sum(e2) AS s, count(e2) AS c, avg(val_loss) AS v FROM fx_seed_cells GROUP BY 1,2),
         w AS (SELECT *, sum(s) OVER b AS ss, sum(c) OVER b AS cc FROM p WINDOW b AS (PARTITION BY seed ORDER BY date ROWS BETWEEN {LAG + LB} PRECEDING AND {LAG + 1} PRECEDING)),
         t AS (SELECT *, CASE WHEN cc >= {MIN_H} THEN ss/cc END AS tl FROM w),
         l AS (SELECT *, CASE WHEN count(tl) OVER (PARTITION BY date) > 0 THEN tl ELSE v END AS loss FROM t),
         r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(loss, 12), seed) AS rank FROM l WHERE loss IS NOT NULL),
         m AS (SELECT c.* FROM fx_seed_cells c JOIN r ON r.date = c.date AND r.seed = c.seed WHERE r.rank <= 5)
    """ + ENS.format(v="m"), "fx_seed_cells")
def q_total_trailing(fx):
    return ensemble(E.members_total_by_trailing(fx.forecast, fx.curve, 5, LB, MIN_H, LAG))


@query("topk_multi_k", " UNION ALL ".join(f"""
    SELECT date, maturity, {k} AS k, round(avg(y_hat), 10) + 0 AS y_hat FROM (SELECT *, row_number() OVER (PARTITION BY date, maturity ORDER BY val_loss, seed) AS rank FROM fx_forecast) q{k}
    WHERE rank <= {k} GROUP BY 1,2""" for k in [1, 3, 5, 10]), "fx_forecast")
def q_multi(fx):
    return rounded(E.combine_many_k(E.rank_by(fx.forecast, "val_loss"), [1, 3, 5, 10]), y_hat=10)


@query("topk_winsorized", """
    WITH b AS (SELECT d.date, quantile_cont(f.y_hat, 0.05) AS lo, quantile_cont(f.y_hat, 0.95) AS hi
               FROM (SELECT DISTINCT date FROM fx_forecast) d JOIN fx_forecast f ON f.date <= d.date GROUP BY 1),
         w AS (SELECT t.date, t.maturity, greatest(least(t.y_hat, b.hi), b.lo) AS y_hat FROM fx_topk t JOIN b ON b.date = t.date)
    """ + ENS.format(v="w"), "fx_topk fx_forecast")
def q_winsor(fx):
    cube = fx.shared(fx.forecast)
    return rounded(E.combine_winsorised(E.members_by_validation(cube, 5), cube, 0.05, 0.95), y_hat=10)


@query("expanding_quantiles", """
    SELECT d.date, round(quantile_cont(f.y_hat, 0.001), 10) + 0 AS lo, round(quantile_cont(f.y_hat, 0.999), 10) + 0 AS hi
    FROM (SELECT DISTINCT date FROM fx_forecast) d JOIN fx_forecast f ON f.date <= d.date GROUP BY 1""", "fx_forecast")
def q_quantiles(fx):
    return rounded(E.expanding_quantiles(fx.shared(fx.forecast), "y_hat", {"lo": 0.001, "hi": 0.999}), lo=10, hi=10)


@query("ensemble_turnover", """
    WITH n AS (SELECT *, lag(date) OVER (PARTITION BY maturity, seed ORDER BY date) AS prev, min(date) OVER (PARTITION BY maturity) AS first FROM fx_topk)
    SELECT date, maturity, CAST(count(*) FILTER (WHERE date > first AND (prev IS NULL OR prev < last_day(date - to_months(1)))) AS BIGINT) AS replaced FROM n GROUP BY 1,2""", "fx_topk")
def q_turnover(fx):
    return E.turnover(E.members_by_validation(fx.forecast, 5))


@query("latest_snapshot", """
    SELECT seed, maturity, refit_i, date, val_loss FROM (
      SELECT *, row_number() OVER (PARTITION BY seed, maturity ORDER BY refit_i DESC) AS rn FROM (
        SELECT seed, maturity, date, val_loss, CAST((year(date) - 1995)*12 + month(date) - 1 AS INTEGER) AS refit_i FROM fx_forecast) q
      WHERE seed IN (1,3,5,7) AND refit_i <= 70) z WHERE rn = 1""", "fx_forecast")
def q_snapshot(fx):
    snaps = fx.forecast.select("seed", "maturity", "date", "val_loss", (month_number("date") - 1995 * 12 - 1).cast("int").alias("refit_i"))
    return E.latest_snapshot(snaps, ["seed", "maturity"], "refit_i", seeds=[1, 3, 5, 7], last=70)


@query("seed_r2", r2_sql("seed, maturity", "(SELECT f.seed, f.maturity, f.y_hat, b.y, b.hist_mean AS bench FROM fx_forecast f JOIN fx_bench b ON b.date = f.date AND b.maturity = f.maturity) q"), "fx_forecast fx_bench")
def q_seed_r2(fx):
    b = B.with_benchmarks(truth(fx), M, gap=GAP, kinds=["hist_mean"]).withColumnRenamed("hist_mean", "bench")
    return rounded(E.seed_r2(fx.forecast.join(b, ["date", "maturity"]), ["seed", "maturity"]), r2=6)


# ---- portfolio value --------------------------------------------------------------------------

add_view("fx_errvar", """
    WITH e AS (SELECT model, maturity, date, y, y_hat, bench, row_number() OVER (PARTITION BY model, maturity ORDER BY date) AS i,
                      CASE WHEN bench IS NOT NULL THEN row_number() OVER (PARTITION BY model, maturity, bench IS NOT NULL ORDER BY date) END AS ib FROM fx_scored),
         a AS (SELECT t.model, t.maturity, t.date, sum(pow(0.95e0, t.i - s.i)*pow(s.y - s.y_hat, 2))/sum(pow(0.95e0, t.i - s.i)) AS v, count(*) AS n
               FROM e t JOIN e s ON s.model = t.model AND s.maturity = t.maturity AND s.i <= t.i - 3 GROUP BY 1,2,3),
         b AS (SELECT t.model, t.maturity, t.date, sum(pow(0.95e0, t.i - s.i)*pow(s.y - s.bench, 2))/sum(pow(0.95e0, t.i - s.i)) AS v, count(*) AS n
               FROM e t JOIN e s ON s.model = t.model AND s.maturity = t.maturity AND s.i <= t.i - 3 AND s.bench IS NOT NULL GROUP BY 1,2,3)
    SELECT e.model, e.maturity, e.date, e.y, e.y_hat, e.bench, CASE WHEN a.n >= 12 THEN a.v END AS var_model, CASE WHEN b.n >= 12 THEN b.v END AS var_bench
    FROM e LEFT JOIN a ON a.model = e.model AND a.maturity = e.maturity AND a.date = e.date LEFT JOIN b ON b.model = e.model AND b.maturity = e.maturity AND b.date = e.date""", "fx_scored")


def cer_rows(fx: Fixtures):
    return scored(fx).select("model", "maturity", "date", "y", "y_hat", "bench")


def utils(fx: Fixtures):
    """Outcomes are centred so that weights do not all sit on a bound."""
    c = cer_rows(fx)
    for col in ["y", "y_hat", "bench"]:
        c = c.withColumn(col, F.col(col) - 0.05)
    return PF.utilities(c, MM, gap=GAP, start="1996-06-30")


@query("error_variance_ewma", "SELECT model, maturity, date, round(var_model, 10) + 0 AS var_model, round(var_bench, 10) + 0 AS var_bench FROM fx_errvar", "fx_errvar")
def q_errvar(fx):
    d = cer_rows(fx).withColumn("em", F.col("y") - F.col("y_hat")).withColumn("eb", F.col("y") - F.col("bench"))
    d = PF.error_variance(d, MM, "em", "var_model", gap=GAP)
    d = PF.error_variance(d, MM, "eb", "var_bench", gap=GAP)
    return rounded(d.select("model", "maturity", "date", "var_model", "var_bench"), var_model=10, var_bench=10)


add_view("fx_util", """
    WITH c AS (SELECT model, maturity, date, y - 0.05e0 AS y, y_hat - 0.05e0 AS y_hat, bench - 0.05e0 AS bench, var_model, var_bench FROM fx_errvar),
         w AS (SELECT *, greatest(least(y_hat/nullif(5e0*var_model, 0), 2e0), -1e0) AS w_model, greatest(least(bench/nullif(5e0*var_bench, 0), 2e0), -1e0) AS w_bench FROM c
               WHERE y_hat IS NOT NULL AND bench IS NOT NULL AND var_model IS NOT NULL AND var_bench IS NOT NULL AND y IS NOT NULL AND date >= DATE '1996-06-30')
    SELECT *, w_model*y - 2.5e0*pow(w_model, 2)*var_model AS u_model, w_bench*y - 2.5e0*pow(w_bench, 2)*var_bench AS u_bench FROM w""", "fx_errvar")


@query("cer_gain", f"""
    SELECT u.model, u.maturity, u.obs, u.cer_pct, u.avg_w_model, u.avg_w_bench, round(d.dm_stat, 5) + 0 AS dm_stat, round({t_tail_sql('d.dm_stat', 'd.n - 1')}, 5) + 0 AS p_value
    FROM (SELECT model, maturity, CAST(count(*) AS BIGINT) AS obs, round(100*(avg(u_model) - avg(u_bench)), 6) + 0 AS cer_pct, round(avg(w_model), 6) + 0 AS avg_w_model, round(avg(w_bench), 6) + 0 AS avg_w_bench FROM fx_util GROUP BY 1,2) u
    JOIN ({dm_sql('model, maturity', 'fx_util', 'u_model - u_bench')}) d ON d.model = u.model AND d.maturity = u.maturity""", "fx_util")
def q_cer(fx):
    return rounded(PF.cer_gain(fx.shared(utils(fx)), MM), cer_pct=6, avg_w_model=6, avg_w_bench=6, dm_stat=5, p_value=5)


@query("cer_delta", f"""
    SELECT maturity, n, round(100*mean, 6) + 0 AS delta_cer_pct, round(dm_stat, 5) + 0 AS dm_stat, round({t_tail_sql('dm_stat', 'n - 1')}, 5) + 0 AS p_value
    FROM ({dm_sql('maturity', "(SELECT a.maturity, a.date, a.u_model - b.u_model AS d FROM fx_util a JOIN fx_util b ON b.date = a.date AND b.maturity = a.maturity AND b.model = 'm1' WHERE a.model = 'm0') pr", 'd')}) q""", "fx_util")
def q_cer_delta(fx):
    return rounded(PF.cer_delta(utils(fx), M, "model", "m0", "m1"), delta_cer_pct=6, dm_stat=5, p_value=5)


@query("refit_schedule", """
    SELECT maturity, date, CAST(i AS INTEGER) AS step, i % 12 = 0 AS refit, (i // 12) % 3 = 0 AND i % 12 = 0 AS tune,
           CAST(max(CASE WHEN i % 12 = 0 THEN date END) OVER (PARTITION BY maturity ORDER BY date) AS DATE) AS fitted_on
    FROM (SELECT maturity, date, row_number() OVER (PARTITION BY maturity ORDER BY date) - 1 AS i FROM fx_curve WHERE date >= DATE '1997-01-31') q""", "fx_curve")
def q_refits(fx):
    from ..operators.walkforward import refit_schedule

    return refit_schedule(truth(fx), M, START, refit_every=12, tune_every=3).drop("y")


@query("temporal_split", """
    WITH n AS (SELECT series, date, row_number() OVER (PARTITION BY series ORDER BY date) AS i, count(*) OVER (PARTITION BY series) AS n FROM fx_panel),
         s AS (SELECT *, CAST(floor(n*0.85e0) AS BIGINT) AS sp FROM n)
    SELECT series, date, CASE WHEN sp < 10 OR n - sp < 3 THEN 'all' WHEN i <= sp THEN 'train' ELSE 'validation' END AS part FROM s""", "fx_panel")
def q_split(fx):
    from ..operators.walkforward import temporal_split

    return temporal_split(fx.panel, ["series"]).select("series", "date", "part")
