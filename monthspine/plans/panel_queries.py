"""Queries: calendar, scalar functions, panel shaping and window transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.calendar import month_spine, release_cutoff
from ..operators import curve as CV
from ..operators import lags as L
from ..operators import panel as P
from ..operators import transforms as T
from .fixtures import SCHEDULE, Fixtures, add_view, cents
from .registry import query

# ---- derived DuckDB views ---------------------------------------------------------------------

add_view("fx_months", """
    SELECT last_day(CAST(m AS DATE)) AS date
    FROM (SELECT unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS m
          FROM (SELECT min(date) AS lo, max(date) AS hi FROM fx_panel) b) g""", "fx_panel")
add_view("fx_dense", """
    SELECT s.series, s.grp, m.date, p.value, p.tag
    FROM (SELECT DISTINCT series, grp FROM fx_panel) s CROSS JOIN fx_months m
    LEFT JOIN fx_panel p ON p.series = s.series AND p.date = m.date""", "fx_panel fx_months")
add_view("fx_sparse_months", """
    SELECT last_day(CAST(m AS DATE)) AS date
    FROM (SELECT unnest(generate_series(date_trunc('month', lo), hi, INTERVAL 1 MONTH)) AS m
          FROM (SELECT min(date) AS lo, max(date) AS hi FROM fx_sparse) b) g""", "fx_sparse")
add_view("fx_sparse_dense", """
    SELECT s.series, m.date, p.value
    FROM (SELECT DISTINCT series FROM fx_sparse) s CROSS JOIN fx_sparse_months m
    LEFT JOIN fx_sparse p ON p.series = s.series AND p.date = m.date""", "fx_sparse fx_sparse_months")


def dense(fx: Fixtures):
    return P.densify(fx.panel, ["series", "grp"], ["value", "tag"])


def sparse_dense(fx: Fixtures):
    return P.densify(fx.sparse, ["series"], ["value"])


# ---- calendar ---------------------------------------------------------------------------------


@query("month_spine", """
    SELECT series, last_day(CAST(m AS DATE)) AS date
    FROM (SELECT series, unnest(generate_series(date_trunc('month', min(date)), max(date), INTERVAL 1 MONTH)) AS m
          FROM fx_panel GROUP BY series) g""", "fx_panel")
def q_month_spine(fx):
    return month_spine(fx.panel, ["series"])


@query("panel_slice", """
    SELECT date, series, value FROM fx_panel WHERE date BETWEEN DATE '1996-01-31' AND DATE '1998-12-31'""", "fx_panel")
def q_panel_slice(fx):
    sliced = P.slice_months(fx.table("orders"), "1996-01-31", "1998-12-31", "o_orderdate")
    sums = sliced.groupBy("date", "o_orderpriority", "o_orderstatus").agg((F.sum(cents("o_totalprice")) / 100.0).alias("value"))
    return sums.select("date", F.concat("o_orderpriority", F.lit("|"), "o_orderstatus").alias("series"), "value")


@query("resample_month_last", """
    SELECT user_id, event_type, date, value FROM (
      SELECT user_id, event_type, last_day(ts) AS date, value,
             row_number() OVER (PARTITION BY user_id, event_type, last_day(ts) ORDER BY ts DESC, event_id DESC) AS rn
      FROM events WHERE value IS NOT NULL) q WHERE rn = 1""")
def q_resample(fx):
    return P.resample_last(fx.table("events"), ["user_id", "event_type"], "ts", "value", ["event_id"])


@query("drop_series", """
    SELECT date, series, value FROM fx_panel WHERE series NOT IN ('1-URGENT|F','TWEXAFEGSMTHx','ACOGNO','5-LOW|P')""", "fx_panel")
def q_drop_series(fx):
    from .. import fixed_values as fv

    return P.drop_series(fx.panel, fv.DROPPED_SERIES, ["1-URGENT|F", "5-LOW|P", "ACOGNO"]).select("date", "series", "value")


@query("alias_coalesce", """
    WITH r AS (SELECT date, value, series AS position,
                      CASE series WHEN '1-URGENT|F' THEN '1-URGENT|O' WHEN '2-HIGH|P' THEN '2-HIGH|F'
                           WHEN '5-LOW|F' THEN 'low' WHEN '5-LOW|O' THEN 'low' WHEN '5-LOW|P' THEN 'low' ELSE series END AS series
               FROM fx_panel WHERE value IS NOT NULL)
    SELECT date, series, value FROM (
      SELECT *, row_number() OVER (PARTITION BY date, series ORDER BY position) AS rn FROM r) q WHERE rn = 1""", "fx_panel")
def q_alias(fx):
    names = {"1-URGENT|F": "1-URGENT|O", "2-HIGH|P": "2-HIGH|F", "5-LOW|F": "low", "5-LOW|O": "low", "5-LOW|P": "low"}
    return P.coalesce_aliases(fx.panel.withColumn("position", F.col("series")), names, "position")


@query("clean_text", r"""
    SELECT doc_id, trim(regexp_replace(coalesce(text,''),
      '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')) AS text_clean
    FROM documents""")
def q_clean_text(fx):
    return fx.table("documents").select("doc_id", C.clean_text("text").alias("text_clean"))


@query("json_schedule", """
    SELECT event_id, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS k FROM events""")
def q_json_schedule(fx):
    return fx.table("events").select("event_id", F.try_element_at(C.json_int_map("props"), F.lit("k")).alias("k"))


@query("release_cutoff", """
    SELECT date, series, CASE substr(series,1,1)
             WHEN '2' THEN last_day(date - to_months(1)) WHEN '3' THEN last_day(date - to_months(2))
             WHEN '4' THEN last_day(date - to_months(3)) ELSE date END AS cutoff
    FROM fx_panel""", "fx_panel")
def q_release_cutoff(fx):
    rule = (
        F.when(F.col("series").startswith("2"), "month_end_plus_1m")
        .when(F.col("series").startswith("3"), "month_end_plus_2m")
        .when(F.col("series").startswith("4"), "month_end_plus_3m")
        .otherwise("same_month_end")
    )
    return fx.panel.select("date", "series", release_cutoff("date", rule).alias("cutoff"))


@query("date_selector", """
    WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
               FROM (SELECT DISTINCT date FROM fx_panel) q),
         k AS (SELECT unnest(range(9)) AS j)
    SELECT 'all' AS selector, date FROM d
    UNION ALL SELECT 'every_nth:5', date FROM d WHERE i % 5 = 0
    UNION ALL SELECT DISTINCT 'spaced:9', date FROM d, k
              WHERE d.i = CASE WHEN k.j = 8 THEN n - 1 ELSE CAST(floor(k.j * (CAST(n - 1 AS DOUBLE) / 8e0)) AS BIGINT) END
    UNION ALL SELECT 'listed', date FROM d WHERE date IN (DATE '1996-02-29', DATE '1999-12-31')""", "fx_panel")
def q_date_selector(fx):
    out = None
    for sel in ["all", "every_nth:5", "spaced:9", ["1996-02-29", "1999-12-31"]]:
        part = P.select_dates(fx.panel, sel).select(
            F.lit(sel if isinstance(sel, str) else "listed").alias("selector"), "date"
        )
        out = part if out is None else out.unionByName(part)
    return out


# ---- labels -----------------------------------------------------------------------------------


@query("stars_label", """
    WITH q AS (SELECT seed, maturity, CAST(sum(CAST(round(y_hat*1e6) AS BIGINT)) AS DOUBLE)/1e6/count(*) - 0.05e0 AS r2,
                      CAST(sum(CAST(round(val_loss*1e6) AS BIGINT)) AS DOUBLE)/1e6/count(*) - 0.0395e0 AS d
               FROM fx_forecast GROUP BY 1,2),
         p AS (SELECT *, abs(d)*50e0 AS pval FROM q)
    SELECT seed, CASE WHEN maturity % 12 = 0 THEN concat(CAST(maturity//12 AS VARCHAR),'y') ELSE concat(CAST(maturity AS VARCHAR),'m') END AS label,
           concat(printf('%.1f', r2*100), CASE WHEN r2 > 0 THEN CASE WHEN pval < 0.01 THEN '***' WHEN pval < 0.05 THEN '**'
                  WHEN pval < 0.10 THEN '*' ELSE '' END ELSE '' END) AS cell,
           CASE WHEN pval < 0.01 THEN '***' WHEN pval < 0.05 THEN '**' WHEN pval < 0.10 THEN '*' ELSE '' END AS stars
    FROM p""", "fx_forecast")
def q_stars(fx):
    micro = lambda c: F.sum(F.round(F.col(c) * 1e6).cast("bigint")) / F.lit(1e6) / F.count("*")
    q = fx.forecast.groupBy("seed", "maturity").agg(
        (micro("y_hat") - 0.05).alias("r2"), (micro("val_loss") - 0.0395).alias("d")
    ).withColumn("pval", F.abs("d") * 50.0)
    return q.select(
        "seed", C.maturity_label("maturity").alias("label"), C.score_cell("r2", "pval").alias("cell"),
        C.significance_stars("pval").alias("stars"),
    )


@query("feature_path", """
    WITH f AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN concat('forward::', p_brand) WHEN 1 THEN concat('fred::', p_type, '::', p_brand)
                    WHEN 2 THEN concat(p_type, '::', p_brand) WHEN 3 THEN p_brand ELSE 'forward' END AS feature FROM part),
         s AS (SELECT feature, string_split(feature, '::') AS p FROM f)
    SELECT feature, CASE WHEN p[1]='fred' AND len(p)>=3 THEN p[2] ELSE p[1] END AS block,
           CASE WHEN p[1]='forward' AND len(p)>1 THEN concat('fwd ', p[len(p)]) WHEN p[1]='forward' THEN 'fwd'
                WHEN p[1]='fred' AND len(p)>=3 THEN p[3] WHEN len(p)>=2 THEN p[2] ELSE feature END AS display
    FROM s""")
def q_feature_path(fx):
    k = F.col("p_size") % 5
    feature = (
        F.when(k == 0, F.concat(F.lit("forward::"), "p_brand"))
        .when(k == 1, F.concat_ws("::", F.lit("fred"), "p_type", "p_brand"))
        .when(k == 2, F.concat_ws("::", "p_type", "p_brand"))
        .when(k == 3, F.col("p_brand"))
        .otherwise("forward")
    )
    return fx.table("part").select(feature.alias("feature")).distinct().select(
        "feature", C.feature_block("feature").alias("block"), C.feature_display("feature").alias("display")
    )


RUN_STEMS = ["Grp_ens", "macro_fwd_ann", "fwd_ann", "run_pca3", "pls2", "Lasso1", "ridge", "my_group", "fwd2", "x_fwd_ann"]


@query("infer_family", f"""
    WITH r AS (SELECT concat(list_extract({RUN_STEMS!r}, CAST(p_partkey % {len(RUN_STEMS)} AS INTEGER) + 1), '_', p_brand) AS run_name FROM part),
         t AS (SELECT run_name, lower(run_name) AS t FROM r)
    SELECT run_name, CASE WHEN contains(t,'group') OR contains(t,'grp') THEN 'group_ensemble_ann'
        WHEN contains(t,'macro') AND contains(t,'fwd') THEN 'macro_forward_ann'
        WHEN contains(t,'fwd_ann') OR starts_with(t,'fwd') THEN 'forward_ann' WHEN contains(t,'pca') THEN 'pca'
        WHEN contains(t,'pls') THEN 'pls' WHEN contains(t,'lasso') THEN 'lasso' ELSE 'unknown' END AS family,
        CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1,2""")
def q_infer_family(fx):
    stem = F.element_at(F.array(*map(F.lit, RUN_STEMS)), (F.col("p_partkey") % len(RUN_STEMS)).cast("int") + 1)
    runs = fx.table("part").select(F.concat(stem, F.lit("_"), "p_brand").alias("run_name"))
    return runs.groupBy("run_name").agg(F.count("*").alias("n")).withColumn("family", C.model_family("run_name"))


MATS = list(range(12, 85, 12))


@query("pivot_scores", "SELECT seed, " + ", ".join(
    f"round(avg(CASE WHEN maturity={m} THEN y_hat END), 10) + 0 AS m{m}" for m in MATS) + " FROM fx_forecast GROUP BY seed", "fx_forecast")
def q_pivot(fx):
    wide = P.pivot_wide(fx.forecast, ["seed"], "maturity", MATS, F.avg("y_hat"))
    return wide.select("seed", *[C.rnd(F.col(f"`{m}`"), 10).alias(f"m{m}") for m in MATS])


@query("unpivot_panel", """
    SELECT date, concat('m', CAST(maturity AS VARCHAR)) AS maturity, y FROM fx_curve WHERE y IS NOT NULL""", "fx_curve")
def q_unpivot(fx):
    wide = P.pivot_wide(fx.curve, ["date"], "maturity", MATS, F.max("y"))
    wide = wide.select("date", *[F.col(f"`{m}`").alias(f"m{m}") for m in MATS])
    return P.unpivot_long(wide, ["date"], [f"m{m}" for m in MATS], "maturity", "y")


# ---- transforms -------------------------------------------------------------------------------

TCODE_SQL = "(CAST(substr(series,1,1) AS INTEGER) + ascii(right(series,1))) % 7 + 1"


def tcode_of(series="series"):
    return ((F.substring(series, 1, 1).cast("int") + F.ascii(F.right(F.col(series), F.lit(1)))) % 7 + 1).cast("int")


add_view("fx_tcoded", f"""
    SELECT date, series, grp, value, tag, CAST({TCODE_SQL} AS INTEGER) AS tcode FROM fx_dense""", "fx_dense")
add_view("fx_transformed", """
    SELECT date, series, grp, tag, tcode, value, CASE tcode WHEN 1 THEN value
        WHEN 2 THEN value - v1 WHEN 3 THEN (value - v1) - (v1 - v2) WHEN 4 THEN l0 WHEN 5 THEN l0 - l1
        WHEN 6 THEN (l0 - l1) - (l1 - l2) WHEN 7 THEN (value/nullif(v1,0) - 1) - (v1/nullif(v2,0) - 1) END AS transformed
    FROM (SELECT *, lag(value,1) OVER w AS v1, lag(value,2) OVER w AS v2,
                 CASE WHEN value>0 THEN ln(value) END AS l0,
                 lag(CASE WHEN value>0 THEN ln(value) END,1) OVER w AS l1,
                 lag(CASE WHEN value>0 THEN ln(value) END,2) OVER w AS l2
          FROM fx_tcoded WINDOW w AS (PARTITION BY series ORDER BY date)) q""", "fx_tcoded")


def transformed(fx):
    return T.apply_tcodes(dense(fx).withColumn("tcode", tcode_of()), ["series", "grp"])


@query("tcode_transform", """
    SELECT date, series, tcode, round(transformed, 6) + 0 AS value FROM fx_transformed""", "fx_transformed")
def q_tcode(fx):
    return transformed(fx).select("date", "series", "tcode", C.rnd("transformed").alias("value"))


@query("lag_uniform", """
    SELECT date, series, lag(value) OVER (PARTITION BY series ORDER BY date) AS value FROM fx_dense""", "fx_dense")
def q_lag(fx):
    return T.lag_panel(dense(fx), ["series", "grp"], 1).select("date", "series", "value")


LAG_TABLE = [("1-URGENT|F", "fixed", 3, ""), ("2-HIGH|O", "decision_month_schedule", 1, SCHEDULE), ("3-MEDIUM|P", "fixed", 2, "")]
LAG_ROWS = [("2-HIGH|O", " ", 2, None), ("3-MEDIUM|P", "fixed", 4, ""), ("4-NOT SPECIFIED|F", "decision_month_schedule", None, SCHEDULE)]


@query("publication_lag", """
    WITH l AS (SELECT date, series, CASE
          WHEN series = '1-URGENT|F' THEN 3 WHEN series = '3-MEDIUM|P' THEN 4
          WHEN series IN ('2-HIGH|O','4-NOT SPECIFIED|F') THEN (month(date) - 1) % 3 + 1 ELSE 1 END AS lag FROM fx_dense)
    SELECT l.date, l.series, CAST(l.lag AS INTEGER) AS lag, d.value
    FROM l LEFT JOIN fx_dense d ON d.series = l.series AND d.date = last_day(l.date - to_months(CAST(l.lag AS INTEGER)))""", "fx_dense")
def q_publication_lag(fx):
    d = dense(fx)
    policies = L.resolve_policies(fx.panel, fx.rows(LAG_TABLE, L.POLICY_SCHEMA), fx.rows(LAG_ROWS, L.POLICY_SCHEMA))
    return L.apply_publication_lag(d, policies)


@query("ffill", """
    SELECT date, series, last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY date
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM fx_sparse_dense""", "fx_sparse_dense")
def q_ffill(fx):
    return sparse_dense(fx).select("date", "series", T.ffill("value", ["series"]).alias("value"))


@query("ffill_bfill", """
    SELECT date, series, coalesce(
      last_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(value IGNORE NULLS) OVER (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value
    FROM fx_sparse_dense""", "fx_sparse_dense")
def q_ffill_bfill(fx):
    return sparse_dense(fx).select("date", "series", T.ffill_bfill("value", ["series"]).alias("value"))


add_view("fx_masked", """
    SELECT date, series, value, value IS NULL AND (lo IS NULL OR date < lo OR date > hi) AS masked
    FROM (SELECT *, min(CASE WHEN value IS NOT NULL THEN date END) OVER (PARTITION BY series) AS lo,
                 max(CASE WHEN value IS NOT NULL THEN date END) OVER (PARTITION BY series) AS hi FROM fx_sparse_dense) q""", "fx_sparse_dense")


@query("availability_mask", "SELECT date, series, masked FROM fx_masked", "fx_masked")
def q_mask(fx):
    return sparse_dense(fx).select("date", "series", T.availability_mask("value", ["series"]).alias("masked"))


@query("median_impute", """
    SELECT date, series, fill, masked, CASE WHEN masked THEN NULL ELSE coalesce(value, fill) END AS imputed
    FROM (SELECT date, series, value, masked, coalesce(median(value) OVER (PARTITION BY series ORDER BY date
            ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING), 0e0) AS fill FROM fx_masked) q""", "fx_masked")
def q_median(fx):
    return T.impute_training_median(sparse_dense(fx), ["series"], gap=2).drop("value")


add_view("fx_train_complete", """
    SELECT date AS origin, series, n_train FROM (
      SELECT date, series, count(value) OVER w AS nv, count(*) OVER w AS n_train FROM fx_sparse_dense
      WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING)) q
    WHERE n_train > 0 AND nv = n_train""", "fx_sparse_dense")


@query("train_complete_series", "SELECT origin, series, CAST(n_train AS BIGINT) AS n_train FROM fx_train_complete", "fx_train_complete")
def q_train_complete(fx):
    return T.training_complete(sparse_dense(fx), ["series"], gap=2)


# ---- yield curve ------------------------------------------------------------------------------


@query("forward_rates", """
    SELECT c.date, c.maturity, round(CASE WHEN c.maturity = 12 THEN 0e0 ELSE -((c.maturity-12)/12e0)*p.y END
           + (c.maturity/12e0)*c.y, 10) + 0 AS fwd
    FROM fx_curve c LEFT JOIN fx_curve p ON p.date = c.date AND p.maturity = c.maturity - 12""", "fx_curve")
def q_forward(fx):
    return CV.forward_rates(fx.curve).withColumn("fwd", C.rnd("fwd", 10))


@query("forward_rates_step1", """
    SELECT c.date, c.maturity, round(-((c.maturity-1)/12e0)*p.y + (c.maturity/12e0)*c.y, 10) + 0 AS fwd
    FROM fx_curve_monthly c LEFT JOIN fx_curve_monthly p ON p.date = c.date AND p.maturity = c.maturity - 1
    WHERE c.maturity % 12 = 0""", "fx_curve_monthly")
def q_forward1(fx):
    return CV.forward_rates(fx.curve_monthly, step=1).withColumn("fwd", C.rnd("fwd", 10))


add_view("fx_rx", """
    SELECT c.date, c.maturity, (-((c.maturity-12)/12e0)*s.y) + (c.maturity/12e0)*c.y - 1e0*r.y AS rx
    FROM fx_curve c
    LEFT JOIN fx_curve s ON s.date = last_day(c.date + to_months(12)) AND s.maturity = c.maturity - 12
    LEFT JOIN fx_curve r ON r.date = c.date AND r.maturity = 12
    WHERE c.maturity > 12 AND c.maturity % 12 = 0""", "fx_curve")


@query("excess_returns", "SELECT date, maturity, round(rx, 10) + 0 AS rx FROM fx_rx", "fx_rx")
def q_excess(fx):
    return CV.excess_returns(fx.curve, 12).withColumn("rx", C.rnd("rx", 10))


@query("excess_returns_1m", """
    SELECT c.date, c.maturity, round((-((c.maturity-1)/12e0)*s.y) + (c.maturity/12e0)*c.y - (1/12e0)*r.y, 10) + 0 AS rx
    FROM (SELECT date, CAST(CASE maturity WHEN 7 THEN 1 ELSE maturity END AS INTEGER) AS maturity, y FROM fx_curve_monthly) c
    LEFT JOIN fx_curve_monthly s ON s.date = last_day(c.date + to_months(1)) AND s.maturity = c.maturity - 1
    LEFT JOIN fx_curve_monthly r ON r.date = c.date AND r.maturity = 7
    WHERE c.maturity = 12""", "fx_curve_monthly")
def q_excess1(fx):
    one = F.when(F.col("maturity") == 7, 1).otherwise(F.col("maturity")).cast("int")
    return CV.excess_returns(fx.curve_monthly.withColumn("maturity", one), 1).withColumn("rx", C.rnd("rx", 10))


@query("curve_ingest", """
    SELECT date, maturity, y FROM fx_curve WHERE maturity IN (12, 36, 60) AND date BETWEEN DATE '1995-06-30' AND DATE '2000-12-31'""", "fx_curve")
def q_curve_ingest(fx):
    from ..sources.curves import snap_curve

    pct = fx.curve.select(
        "date", F.concat(F.lit("SVENY"), F.lpad((F.col("maturity") / 12).cast("int").cast("string"), 2, "0")).alias("column"), "y"
    )
    wide = pct.groupBy("date").pivot("column", [f"SVENY{i:02d}" for i in range(1, 8)]).agg(F.max("y"))
    return snap_curve(wide, "date", "years", percent=False, maturities=[12, 36, 60], start="1995-06-30", end="2000-12-31")


# ---- smoothing and composites -----------------------------------------------------------------


@query("rolling_mean", """
    SELECT date, maturity, round(avg(y) OVER (PARTITION BY maturity ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), 10) + 0 AS y_smooth
    FROM fx_curve""", "fx_curve")
def q_rolling(fx):
    return fx.curve.select("date", "maturity", C.rnd(T.rolling_mean("y", ["maturity"], 6), 10).alias("y_smooth"))


add_view("fx_block", """
    SELECT date, grp, avg(z) AS value FROM (
      SELECT date, grp, coalesce((value - avg(value) OVER s)/nullif(stddev_pop(value) OVER s, 0), 0) AS z
      FROM fx_dense WINDOW s AS (PARTITION BY series)) q GROUP BY date, grp""", "fx_dense")


def block(fx):
    return T.block_composite(dense(fx))


@query("block_composite", "SELECT date, grp, round(value, 10) + 0 AS value FROM fx_block", "fx_block")
def q_block(fx):
    return block(fx).withColumn("value", C.rnd("value", 10))


@query("category_average", """
    SELECT date, grp, round(avg(z), 10) + 0 AS value FROM (
      SELECT date, grp, CASE WHEN value IS NOT NULL THEN coalesce((value - avg(value) OVER s)/nullif(stddev_pop(value) OVER s, 0), 0) END AS z
      FROM fx_dense WINDOW s AS (PARTITION BY series)) q GROUP BY date, grp""", "fx_dense")
def q_category(fx):
    return T.category_average(dense(fx)).withColumn("value", C.rnd("value", 10))


COARSE = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow", "5-LOW": "slow"}


@query("coarse_composite", """
    SELECT date, coarse, round(avg(z), 10) + 0 AS value FROM (
      SELECT date, CASE WHEN grp IN ('1-URGENT','2-HIGH') THEN 'fast' ELSE 'slow' END AS coarse,
             coalesce((value - avg(value) OVER s)/nullif(stddev_pop(value) OVER s, 0), 0) AS z
      FROM fx_dense WHERE grp <> '4-NOT SPECIFIED' WINDOW s AS (PARTITION BY series)) q GROUP BY date, coarse""", "fx_dense")
def q_coarse(fx):
    from ..operators.grouping import coarse_composite

    mapping = fx.rows(list(COARSE.items()), "grp string, coarse string")
    return coarse_composite(dense(fx), mapping).withColumn("value", C.rnd("value", 10))


add_view("fx_jumps", """
    SELECT *, abs(ln(value/prev_value)) AS log_jump_abs, 100e0*(value/prev_value - 1) AS pct_change, tag <> prev_tag AS tag_changed
    FROM (SELECT series, date, value, coalesce(tag,'MISSING') AS tag, lag(date) OVER w AS prev_date, lag(value) OVER w AS prev_value,
                 lag(coalesce(tag,'MISSING')) OVER w AS prev_tag
          FROM fx_dense WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY date)) q
    WHERE value > 0 AND prev_value > 0""", "fx_dense")


@query("jump_table", """
    SELECT series, date, prev_date, value, prev_value, tag, prev_tag, tag_changed, CAST(rank AS INTEGER) AS rank,
           round(log_jump_abs, 6) + 0 AS log_jump_abs, round(pct_change, 6) + 0 AS pct_change
    FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(log_jump_abs, 9) DESC, date) AS rank FROM fx_jumps) q
    WHERE rank <= 8""", "fx_jumps")
def q_jumps(fx):
    return T.top_jumps(dense(fx), ["series"], 8).select(
        "series", "date", "prev_date", "value", "prev_value", "tag", "prev_tag", "tag_changed", "rank",
        C.rnd("log_jump_abs").alias("log_jump_abs"), C.rnd("pct_change").alias("pct_change"),
    )


@query("source_runs", """
    WITH s AS (SELECT series, date, coalesce(tag,'MISSING') AS tag FROM fx_dense),
         n AS (SELECT *, CASE WHEN tag IS DISTINCT FROM lag(tag) OVER (PARTITION BY series ORDER BY date) THEN 1 ELSE 0 END AS nw FROM s),
         r AS (SELECT *, sum(nw) OVER (PARTITION BY series ORDER BY date) AS run FROM n)
    SELECT series, tag, min(date) AS start, max(date) AS "end", CAST(count(*) AS BIGINT) AS months FROM r GROUP BY series, tag, run""", "fx_dense")
def q_runs(fx):
    return T.tag_runs(dense(fx), ["series"])


@query("max_abs_diff", """
    WITH f AS (SELECT series_id, obs_date AS date, arg_min(value, realtime_start) AS a, arg_max(value, realtime_start) AS b FROM fx_history GROUP BY 1,2),
         d AS (SELECT series_id, abs(a - lag(a) OVER w) AS da, abs(b - lag(b) OVER w) AS db FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date))
    SELECT series_id AS series, round(max(da), 2) + 0 AS first_abs_diff_max, round(max(db), 2) + 0 AS latest_abs_diff_max FROM d GROUP BY 1""", "fx_history")
def q_max_abs_diff(fx):
    def side(pick, out):
        s = fx.history.groupBy(F.col("series_id").alias("series"), F.col("obs_date").alias("date")).agg(
            pick("value", "realtime_start").alias("value"))
        return T.max_abs_diff(s, ["series"], out)

    a, b = side(F.min_by, "first_abs_diff_max"), side(F.max_by, "latest_abs_diff_max")
    return a.join(b, "series").select(
        "series", C.rnd("first_abs_diff_max", 2).alias("first_abs_diff_max"), C.rnd("latest_abs_diff_max", 2).alias("latest_abs_diff_max"))
