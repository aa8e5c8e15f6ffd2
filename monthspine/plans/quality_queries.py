"""Queries: audits, quality tables, training sets, revisions and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import correlation as K
from ..operators import quality as Q
from ..operators import transforms as T
from .fixtures import Fixtures, add_view
from .panel_queries import block, dense, sparse_dense
from .registry import query
from .scoring_queries import rounded
from .vintage_queries import balanced, vpanels

# ---- histories --------------------------------------------------------------------------------


@query("coverage_summary", """
    SELECT series_id, CAST(count(*) AS BIGINT) AS n_rows, min(obs_date) AS obs_min, max(obs_date) AS obs_max, min(realtime_start) AS realtime_min, max(realtime_start) AS realtime_max
    FROM fx_history GROUP BY 1""", "fx_history")
def q_coverage(fx):
    return Q.coverage_summary(fx.history)


@query("availability_audit", """
    SELECT series_id, CAST(count(*) AS BIGINT) AS n_obs, min(obs_date) AS obs_min_date, max(obs_date) AS obs_max_date, true AS has_vintages FROM fx_history GROUP BY 1""", "fx_history")
def q_availability(fx):
    return Q.availability_audit(fx.history)


@query("archive_coverage", "SELECT vintage_month, CAST(count(DISTINCT series_id) AS BIGINT) AS series_columns FROM fx_archive GROUP BY 1", "fx_archive")
def q_archive(fx):
    return Q.archive_coverage(fx.archive)


@query("revision_audit", """
    SELECT series_id, CAST(count(*) FILTER (WHERE v > 1) AS BIGINT) AS obs_with_revisions, CAST(max(v) AS BIGINT) AS max_revisions_per_obs
    FROM (SELECT series_id, obs_date, count(DISTINCT realtime_start) AS v FROM fx_history GROUP BY 1,2) q GROUP BY 1""", "fx_history")
def q_revision_audit(fx):
    return Q.revision_audit(fx.history)


# ---- panels -----------------------------------------------------------------------------------


@query("source_mix", """
    SELECT grp, coalesce(tag, 'MISSING') AS tag, CAST(count(*) AS BIGINT) AS n, round(100e0*count(*)/sum(count(*)) OVER (PARTITION BY grp), 6) + 0 AS share_pct FROM fx_dense GROUP BY 1,2
    UNION ALL SELECT 'all', coalesce(tag, 'MISSING'), CAST(count(*) AS BIGINT), round(100e0*count(*)/sum(count(*)) OVER (), 6) + 0 FROM fx_dense GROUP BY 1,2""", "fx_dense")
def q_mix(fx):
    d = fx.shared(dense(fx))
    per = Q.source_mix(d, ["grp"])
    return rounded(per.unionByName(Q.source_mix(d).withColumn("grp", F.lit("all"))), share_pct=6)


@query("source_mix_by_date", """
    SELECT forecast_date, tag, CAST(count(*) AS BIGINT) AS n, round(100e0*count(*)/sum(count(*)) OVER (PARTITION BY forecast_date), 6) + 0 AS share_pct FROM fx_vpanel GROUP BY 1,2""", "fx_vpanel")
def q_mix_date(fx):
    return rounded(Q.source_mix(vpanels(fx), ["forecast_date"]), share_pct=6)


add_view("fx_quality", """
    WITH t AS (SELECT series, date, value, coalesce(tag,'MISSING') AS tag FROM fx_dense),
         s AS (SELECT *, tag <> lag(tag) OVER (PARTITION BY series ORDER BY date) AS sw FROM t),
         b AS (SELECT series, min(date) FILTER (WHERE value IS NOT NULL) AS first_valid, max(date) FILTER (WHERE value IS NOT NULL) AS last_valid,
                      CAST(count(value) AS BIGINT) AS non_missing_months, CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) AS missing_months,
                      avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END) AS missing_share, CAST(count(DISTINCT tag) AS BIGINT) AS distinct_tags, CAST(count(*) FILTER (WHERE sw) AS BIGINT) AS tag_switches FROM s GROUP BY 1),
         m AS (SELECT series, tag FROM (SELECT series, tag, row_number() OVER (PARTITION BY series ORDER BY count(*) DESC, tag) AS rn FROM t GROUP BY 1,2) q WHERE rn = 1),
         j AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY round(log_jump_abs, 9) DESC, date) AS rn FROM fx_jumps) q WHERE rn = 1)
    SELECT b.*, m.tag AS dominant_tag, j.date AS max_jump_date, j.log_jump_abs AS max_log_jump, j.pct_change AS max_pct_change,
           coalesce(j.tag_changed, false) AS jump_tag_changed, j.prev_tag AS jump_prev_tag, j.tag AS jump_tag
    FROM b JOIN m USING (series) LEFT JOIN j USING (series)""", "fx_dense fx_jumps")


def quality(fx: Fixtures):
    return Q.series_quality(fx.shared(dense(fx)))


@query("series_quality", """
    SELECT * REPLACE (round(missing_share, 6) + 0 AS missing_share, round(max_log_jump, 6) + 0 AS max_log_jump, round(max_pct_change, 6) + 0 AS max_pct_change) FROM fx_quality""", "fx_quality")
def q_quality(fx):
    return rounded(quality(fx), missing_share=6, max_log_jump=6, max_pct_change=6)


@query("fault_missing", """
    SELECT series, missing_months, round(missing_share, 6) + 0 AS missing_share, tag_switches FROM fx_quality WHERE missing_share >= 0.01
    ORDER BY round(missing_share, 9) DESC, round(max_log_jump, 9) DESC, series LIMIT 5""", "fx_quality")
def q_fault_missing(fx):
    return rounded(Q.fault_missing(quality(fx), 0.01, 5), missing_share=6)


@query("fault_jumps", """
    SELECT series, max_jump_date, round(max_pct_change, 6) + 0 AS max_pct_change, round(max_log_jump, 6) + 0 AS max_log_jump, jump_tag_changed, jump_prev_tag, jump_tag FROM fx_quality
    WHERE max_log_jump >= 0.2 ORDER BY round(missing_share, 9) DESC, round(max_log_jump, 9) DESC, series LIMIT 10""", "fx_quality")
def q_fault_jumps(fx):
    return rounded(Q.fault_jumps(quality(fx), 0.2, 10), max_pct_change=6, max_log_jump=6)


@query("missing_by_date_top", """
    SELECT date, round(avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END), 6) + 0 AS missing_share FROM fx_sparse_dense GROUP BY 1
    ORDER BY round(avg(CASE WHEN value IS NULL THEN 1e0 ELSE 0e0 END), 9) DESC, date LIMIT 15""", "fx_sparse_dense")
def q_worst(fx):
    return rounded(Q.worst_dates(sparse_dense(fx), 15), missing_share=6)


add_view("fx_last_panel", "SELECT * FROM fx_vpanel WHERE forecast_date = (SELECT last FROM fx_ends)", "fx_vpanel fx_ends")


def missing_sql(view: str, label: str) -> str:
    return f"""SELECT '{label}' AS panel, CAST(max(r) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS cols, CAST(sum(r) AS BIGINT) AS total_cells, CAST(sum(t) AS BIGINT) AS transformed_nulls,
        CAST(sum(s) AS BIGINT) AS source_missing, CAST(sum(o) AS BIGINT) AS transform_only, round(100e0*sum(t)/sum(r), 6) + 0 AS transformed_null_pct,
        round(100e0*sum(s)/sum(r), 6) + 0 AS source_missing_pct, round(100e0*sum(o)/sum(r), 6) + 0 AS transform_only_pct
        FROM (SELECT series, count(*) AS r, count(*) FILTER (WHERE transformed IS NULL) AS t, count(*) FILTER (WHERE tag = 'MISSING') AS s,
                     count(*) FILTER (WHERE transformed IS NULL AND tag <> 'MISSING') AS o FROM {view} GROUP BY 1) q"""


@query("missingness_summary", missing_sql("fx_diag", "stitched") + " UNION ALL " + missing_sql("fx_last_panel", "single_asof"), "fx_diag fx_last_panel")
def q_missingness(fx):
    both = Q.missingness_summary(vpanels(fx, diagonal=True), "stitched").unionByName(
        Q.missingness_summary(vpanels(fx).where(F.col("forecast_date") == fx.last_month), "single_asof"))
    return rounded(both, transformed_null_pct=6, source_missing_pct=6, transform_only_pct=6)


for _key in ["series", "date"]:
    def _register(key: str) -> None:
        @query(f"missing_by_{key}", f"""
            SELECT {key}, CAST(count(*) FILTER (WHERE transformed IS NULL) AS BIGINT) AS missing, CAST(count(*) FILTER (WHERE transformed IS NULL AND tag <> 'MISSING') AS BIGINT) AS transform_only
            FROM fx_vpanel GROUP BY 1""", "fx_vpanel")
        def q_missing_by(fx):
            return Q.missing_by(vpanels(fx), key)

    _register(_key)


COMPLETE = "SELECT '{l}' AS measure, CAST(count(*) FILTER (WHERE k = 0) AS BIGINT) AS complete_columns, CAST(count(*) AS BIGINT) AS total_columns FROM (SELECT series, count(*) FILTER (WHERE transformed IS NULL) AS k FROM {v} GROUP BY 1) q{l}"


@query("completeness_3way", " UNION ALL ".join([
    COMPLETE.format(l="single_panel_at_end", v="fx_last_panel"), COMPLETE.format(l="stitched_contemporaneous", v="fx_diag"),
    COMPLETE.format(l="strict_expanding_intersection", v="fx_vpanel")]), "fx_last_panel fx_diag fx_vpanel")
def q_complete(fx):
    p = fx.shared(vpanels(fx))
    return (
        Q.complete_columns(p.where(F.col("forecast_date") == fx.last_month), "single_panel_at_end")
        .unionByName(Q.complete_columns(p.where(F.col("forecast_date") == F.col("date")), "stitched_contemporaneous"))
        .unionByName(Q.complete_columns(p, "strict_expanding_intersection"))
    )


@query("diag_checks", """
    SELECT 'balanced_no_nans' AS "check", count(*) FILTER (WHERE value IS NULL) = 0 AS passed, concat('remaining_missing=', CAST(count(*) FILTER (WHERE value IS NULL) AS VARCHAR)) AS detail FROM fx_balanced
    UNION ALL SELECT 'release_gap_fills', true, concat('count=', CAST(count(*) FILTER (WHERE tag = 'FILL_RELEASE_GAP') AS VARCHAR)) FROM fx_balanced
    UNION ALL SELECT 'pre_vintage_fills', true, concat('count=', CAST(count(*) FILTER (WHERE tag = 'FILL_PRE_VINTAGE_EARLIEST') AS VARCHAR)) FROM fx_balanced""", "fx_balanced")
def q_diag(fx):
    return Q.diag_checks(balanced(fx))


# ---- training sets ----------------------------------------------------------------------------

# selection on a short window, so that series both enter and leave
add_view("fx_selected", """
    SELECT date AS origin, series FROM (SELECT date, series, count(value) OVER w AS nv, count(*) OVER w AS n FROM fx_sparse_dense
      WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) q WHERE n = 12 AND nv = n""", "fx_sparse_dense")
add_view("fx_origins", "SELECT date AS origin FROM (SELECT date, row_number() OVER (ORDER BY date) AS i FROM fx_sparse_months) q WHERE i > 12", "fx_sparse_months")


def selected(fx: Fixtures):
    w = T.by_date(["series"]).rowsBetween(-12, -1)
    d = sparse_dense(fx).select(F.col("date").alias("origin"), "series", F.count("value").over(w).alias("v"), F.count(F.lit(1)).over(w).alias("n"))
    return d.where((F.col("n") == 12) & (F.col("v") == 12)).select("origin", "series")


def origins(fx: Fixtures):
    from ..functions.calendar import shift_months, spine_bounds, with_months

    lo, hi = spine_bounds(fx.sparse)
    span = fx.spark.range(1).select(lo.alias("lo"), hi.alias("hi"))
    return with_months(span, shift_months("lo", 12), "hi", "origin").select("origin")


@query("feature_entry_exit", """
    WITH g AS (SELECT o.origin, s.series, x.series IS NOT NULL AS inside FROM fx_origins o CROSS JOIN (SELECT DISTINCT series FROM fx_sparse) s
               LEFT JOIN fx_selected x ON x.origin = o.origin AND x.series = s.series),
         l AS (SELECT *, lag(inside) OVER (PARTITION BY series ORDER BY origin) AS before FROM g)
    SELECT origin, series, CASE WHEN inside THEN 'enter' ELSE 'exit' END AS event FROM l WHERE before IS NOT NULL AND before <> inside""", "fx_origins fx_sparse fx_selected")
def q_entry(fx):
    return Q.membership_changes(selected(fx), origins(fx))


@query("feature_counts", """
    WITH g AS (SELECT o.origin, s.series, x.series IS NOT NULL AS inside FROM fx_origins o CROSS JOIN (SELECT DISTINCT series FROM fx_sparse) s
               LEFT JOIN fx_selected x ON x.origin = o.origin AND x.series = s.series),
         l AS (SELECT *, lag(inside) OVER (PARTITION BY series ORDER BY origin) AS before FROM g)
    SELECT origin, CAST(count(*) FILTER (WHERE inside) AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE inside AND before = false) AS BIGINT) AS n_new,
           CAST(count(*) FILTER (WHERE NOT inside AND before) AS BIGINT) AS n_exit FROM l GROUP BY 1""", "fx_origins fx_sparse fx_selected")
def q_counts(fx):
    s, o = fx.shared(selected(fx)), origins(fx)
    return Q.membership_counts(s, Q.membership_changes(s, o), o)


@query("never_selected", "SELECT DISTINCT series FROM fx_sparse WHERE series NOT IN (SELECT series FROM fx_train_complete WHERE origin >= DATE '2000-01-31')", "fx_sparse fx_train_complete")
def q_never(fx):
    chosen = T.training_complete(sparse_dense(fx), ["series"], 2).where(F.col("origin") >= "2000-01-31")
    return Q.never_selected(fx.sparse, chosen)


@query("membership_mismatch", """
    SELECT coalesce(a.origin, b.origin) AS origin, a.n_a, b.n_b FROM (SELECT origin, CAST(count(*) AS BIGINT) AS n_a FROM fx_train_complete GROUP BY 1) a
    FULL OUTER JOIN (SELECT origin, CAST(count(*) AS BIGINT) AS n_b FROM fx_selected GROUP BY 1) b ON a.origin = b.origin WHERE coalesce(a.n_a - b.n_b, 0) <> 0""", "fx_train_complete fx_selected")
def q_mismatch(fx):
    return Q.count_mismatch(T.training_complete(sparse_dense(fx), ["series"], 2), selected(fx))


# ---- revisions --------------------------------------------------------------------------------

add_view("fx_revised", """
    WITH f AS (SELECT series_id, obs_date, arg_max(value, realtime_start) AS value FROM fx_history GROUP BY 1,2),
         c AS (SELECT r.series, r.tcode, m.as_of AS date, CASE WHEN r.kind = 'derived_formula' THEN a.value/nullif(b.value, 0) ELSE a.value END AS value
               FROM fx_registry r CROSS JOIN fx_asof_months m LEFT JOIN f a ON a.series_id = coalesce(r.target, r.num) AND a.obs_date = m.as_of LEFT JOIN f b ON b.series_id = r.den AND b.obs_date = m.as_of
               WHERE m.as_of <= (SELECT last FROM fx_ends)),
         w AS (SELECT *, lag(value,1) OVER w AS v1, lag(value,2) OVER w AS v2, CASE WHEN value>0 THEN ln(value) END AS l0,
                      lag(CASE WHEN value>0 THEN ln(value) END,1) OVER w AS l1, lag(CASE WHEN value>0 THEN ln(value) END,2) OVER w AS l2 FROM c WINDOW w AS (PARTITION BY series ORDER BY date))
    SELECT date, series, CASE tcode WHEN 1 THEN value WHEN 2 THEN value - v1 WHEN 3 THEN (value - v1) - (v1 - v2) WHEN 4 THEN l0 WHEN 5 THEN l0 - l1 WHEN 6 THEN (l0 - l1) - (l1 - l2)
           WHEN 7 THEN (value/nullif(v1,0) - 1) - (v1/nullif(v2,0) - 1) END AS revised FROM w""", "fx_history fx_registry fx_asof_months fx_ends")
add_view("fx_revpairs", """
    SELECT p.forecast_date, p.series, p.date, p.transformed AS rt, r.revised AS rev, p.transformed IS NOT NULL AND r.revised IS NOT NULL AS ok
    FROM fx_vpanel p LEFT JOIN fx_revised r ON r.date = p.date AND r.series = p.series""", "fx_vpanel fx_revised")
add_view("fx_revstats", """
    WITH l AS (SELECT *, CASE WHEN ok THEN lag(rt) OVER w END AS rt1, CASE WHEN ok THEN lag(rev) OVER w END AS rev1 FROM fx_revpairs WINDOW w AS (PARTITION BY forecast_date, series, ok ORDER BY date)),
         g AS (SELECT forecast_date, series, count(*) FILTER (WHERE ok) AS n, avg(CASE WHEN rt IS NULL THEN 1e0 ELSE 0e0 END) AS missing_rt, avg(CASE WHEN rev IS NULL THEN 1e0 ELSE 0e0 END) AS missing_rev,
                  avg(rt) FILTER (WHERE ok) AS rt_mean, avg(rev) FILTER (WHERE ok) AS rev_mean, avg(rev - rt) FILTER (WHERE ok) AS revision_mean,
                  stddev_samp(rt) FILTER (WHERE ok) AS rt_sd, stddev_samp(rev) FILTER (WHERE ok) AS rev_sd, stddev_samp(rev - rt) FILTER (WHERE ok) AS revision_sd, avg(abs(rev - rt)) FILTER (WHERE ok) AS mae,
                  covar_pop(rt, rt1) FILTER (WHERE rt1 IS NOT NULL) / nullif(stddev_pop(rt) FILTER (WHERE rt1 IS NOT NULL) * stddev_pop(rt1) FILTER (WHERE rt1 IS NOT NULL), 0) AS a1,
                  covar_pop(rev, rev1) FILTER (WHERE rev1 IS NOT NULL) / nullif(stddev_pop(rev) FILTER (WHERE rev1 IS NOT NULL) * stddev_pop(rev1) FILTER (WHERE rev1 IS NOT NULL), 0) AS a2 FROM l GROUP BY 1,2)
    SELECT forecast_date, series, n AS n_obs, missing_rt, missing_rev, CASE WHEN n >= 3 THEN rt_mean END AS rt_mean, CASE WHEN n >= 3 THEN rev_mean END AS rev_mean, CASE WHEN n >= 3 THEN revision_mean END AS revision_mean,
           CASE WHEN n >= 3 THEN rt_sd END AS rt_sd, CASE WHEN n >= 3 THEN rev_sd END AS rev_sd, CASE WHEN n >= 3 THEN revision_sd END AS revision_sd, CASE WHEN n >= 3 THEN mae END AS mae_revision,
           CASE WHEN n >= 3 AND rt_sd > 0 THEN a1 END AS rt_acf1, CASE WHEN n >= 3 AND rev_sd > 0 THEN a2 END AS rev_acf1 FROM g""", "fx_revpairs")
REV_COLS = ["missing_rt", "missing_rev", "rt_mean", "rev_mean", "revision_mean", "rt_sd", "rev_sd", "revision_sd", "mae_revision", "rt_acf1", "rev_acf1", "acf1_diff"]
DIGITS = {c: 4 if c not in ("rt_acf1", "rev_acf1", "acf1_diff", "missing_rt", "missing_rev") else 5 for c in REV_COLS}


def revised(fx: Fixtures):
    """Fully revised panel: the newest vintage of every month under the same transforms."""
    from ..operators.vintage import combine_roles, newest, source_roles

    final = fx.stored_history.groupBy("series_id", F.col("obs_date").alias("date")).agg(newest().alias("value"))
    cells = combine_roles(final.join(source_roles(fx.registry), "series_id"), ["date", "series"])
    from ..operators.panel import densify

    full = densify(cells, ["series"], ["value"], start=fx.first_month, end=fx.last_month).join(
        fx.registry.select("series", "tcode"), "series")
    return T.apply_tcodes(full, ["series"], out="revised").select("date", "series", "revised")


@query("revision_stats", "SELECT forecast_date, series, CAST(n_obs AS BIGINT) AS n_obs, " + ", ".join(
    f"round({'rev_acf1 - rt_acf1' if c == 'acf1_diff' else c}, {DIGITS[c]}) + 0 AS {c}" for c in REV_COLS) + " FROM fx_revstats", "fx_revstats")
def q_revstats(fx):
    return rounded(Q.revision_stats(vpanels(fx), revised(fx)), **DIGITS)


@query("revision_by_group", """
    WITH s AS (SELECT series, avg(rt_acf1) AS a, avg(rev_acf1 - rt_acf1) AS d, avg(rt_sd) AS rs, avg(rev_sd) AS vs, avg(revision_sd) AS ns, avg(mae_revision) AS m FROM fx_revstats GROUP BY 1)
    SELECT r.grp, round(avg(a), 5) + 0 AS avg_rt_ar1, round(avg(d), 5) + 0 AS avg_ar1_diff, round(avg(vs/nullif(rs,0)), 5) + 0 AS avg_volatility_ratio, round(avg(ns/nullif(rs,0)), 5) + 0 AS avg_revision_noise,
           round(avg(m), 3) + 0 AS avg_mae FROM s JOIN fx_registry r USING (series) GROUP BY 1""", "fx_revstats fx_registry")
def q_revgroup(fx):
    out = Q.revision_by_group(Q.revision_stats(vpanels(fx), revised(fx)), fx.registry.select("series", "grp"))
    return rounded(out, avg_rt_ar1=5, avg_ar1_diff=5, avg_volatility_ratio=5, avg_revision_noise=5, avg_mae=3)


@query("revision_kendall", """
    WITH p AS (SELECT * FROM fx_revpairs WHERE ok),
         t AS (SELECT a.forecast_date, a.series, CAST(sum(sign(a.rt - b.rt)*sign(a.rev - b.rev)) AS DOUBLE) AS s, CAST(sum(abs(sign(a.rt - b.rt))) AS DOUBLE) AS x, CAST(sum(abs(sign(a.rev - b.rev))) AS DOUBLE) AS y
               FROM p a JOIN p b ON a.forecast_date = b.forecast_date AND a.series = b.series AND a.date < b.date GROUP BY 1,2),
         n AS (SELECT forecast_date, series, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1,2)
    SELECT n.forecast_date, n.series, n.n, CASE WHEN n.n >= 3 THEN round(s/nullif(sqrt(x)*sqrt(y), 0), 6) + 0 END AS corr FROM n LEFT JOIN t USING (forecast_date, series)""", "fx_revpairs")
def q_revkendall(fx):
    p = vpanels(fx).join(revised(fx), ["date", "series"])
    return rounded(K.paired(p, ["forecast_date", "series"], "transformed", "revised", "kendall"), corr=6)


# ---- persistence and correlation --------------------------------------------------------------

add_view("fx_ar1", """
    SELECT series, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_pairs, covar_pop(value, l) FILTER (WHERE ok)/nullif(stddev_pop(value) FILTER (WHERE ok)*stddev_pop(l) FILTER (WHERE ok), 0) AS ar1
    FROM (SELECT series, value, l, value IS NOT NULL AND l IS NOT NULL AS ok FROM (SELECT series, value, lag(value) OVER (PARTITION BY series ORDER BY date) AS l FROM fx_dense) q) z GROUP BY 1""", "fx_dense")


def ar1s(fx: Fixtures):
    return K.ar1(dense(fx), ["series"])


@query("ar1_coef", "SELECT series, n_pairs, round(ar1, 6) + 0 AS ar1 FROM fx_ar1", "fx_ar1")
def q_ar1(fx):
    return rounded(ar1s(fx), ar1=6)


@query("ar1_top", "SELECT series, n_pairs, round(ar1, 6) + 0 AS ar1 FROM fx_ar1 ORDER BY round(ar1, 9) DESC, series LIMIT 10", "fx_ar1")
def q_ar1_top(fx):
    return rounded(K.top(ar1s(fx), "ar1", 10), ar1=6)


@query("ar1_describe", """
    SELECT CAST(count(ar1) AS BIGINT) AS count, round(avg(ar1), 6) + 0 AS mean, round(stddev_samp(ar1), 6) + 0 AS std, round(min(ar1), 6) + 0 AS min, round(quantile_cont(ar1, 0.25), 6) + 0 AS p25,
           round(quantile_cont(ar1, 0.5), 6) + 0 AS p50, round(quantile_cont(ar1, 0.75), 6) + 0 AS p75, round(max(ar1), 6) + 0 AS max FROM fx_ar1""", "fx_ar1")
def q_ar1_describe(fx):
    return rounded(K.describe(ar1s(fx), "ar1"), mean=6, std=6, min=6, p25=6, p50=6, p75=6, max=6)


@query("return_stats", """
    WITH x AS (SELECT maturity, date, rx, lag(rx) OVER (PARTITION BY maturity ORDER BY date) AS l, avg(rx) OVER (PARTITION BY maturity) AS mu FROM fx_rx WHERE rx IS NOT NULL),
         g AS (SELECT maturity, CAST(count(*) AS DOUBLE) AS n, avg(rx) AS m, stddev_samp(rx) AS s, avg(pow(rx - mu, 2)) AS m2, avg(pow(rx - mu, 3)) AS m3, avg(pow(rx - mu, 4)) AS m4,
                      covar_pop(rx, l) FILTER (WHERE l IS NOT NULL)/nullif(stddev_pop(rx) FILTER (WHERE l IS NOT NULL)*stddev_pop(l) FILTER (WHERE l IS NOT NULL), 0) AS acf1 FROM x GROUP BY 1)
    SELECT maturity, round(1200*m, 5) + 0 AS mean, round(100*sqrt(12e0)*s, 5) + 0 AS std, round(sqrt(n*(n-1))/(n-2)*m3/pow(m2, 1.5e0), 5) + 0 AS skew,
           round((n-1)/((n-2)*(n-3))*((n+1)*(m4/(m2*m2) - 3) + 6) + 3, 5) + 0 AS kurt, round(acf1, 5) + 0 AS acf1 FROM g""", "fx_rx")
def q_returns(fx):
    from ..operators.curve import excess_returns

    out = K.return_stats(excess_returns(fx.curve, 12), ["maturity"], "rx", annualize=True)
    return rounded(out, mean=5, std=5, skew=5, kurt=5, acf1=5)


@query("pearson_matrix", """
    SELECT a.grp AS a, b.grp AS b, CAST(count(*) AS BIGINT) AS n, round(corr(a.value, b.value), 6) + 0 AS corr FROM fx_block a JOIN fx_block b ON a.date = b.date AND a.grp <> b.grp GROUP BY 1,2""", "fx_block")
def q_pearson(fx):
    return rounded(K.association(block(fx), [], "grp", "value", "pearson"), corr=6)


def kendall_sql(view: str, key: str, item: str, least: int) -> str:
    k = f"{key}, " if key else ""
    ka = f"a.{key}, " if key else ""
    on = f"AND a.{key} = b.{key}" if key else ""
    on2 = f"AND p.{key} = q.{key}" if key else ""
    return f"""
    WITH v AS (SELECT * FROM {view} WHERE value IS NOT NULL),
         p AS (SELECT {ka}a.{item} AS a, b.{item} AS b, a.date, a.value AS x, b.value AS y FROM v a JOIN v b ON a.date = b.date AND a.{item} <> b.{item} {on}),
         s AS (SELECT {('p.' + key + ', ') if key else ''}p.a, p.b, CAST(sum(sign(p.x - q.x)*sign(p.y - q.y)) AS DOUBLE) AS s, CAST(sum(abs(sign(p.x - q.x))) AS DOUBLE) AS tx, CAST(sum(abs(sign(p.y - q.y))) AS DOUBLE) AS ty
               FROM p JOIN p q ON p.a = q.a AND p.b = q.b AND p.date < q.date {on2} GROUP BY ALL),
         n AS (SELECT {k}a, b, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL)
    SELECT {('n.' + key + ', ') if key else ''}n.a, n.b, n.n, CASE WHEN n.n >= {least} THEN round(s/nullif(sqrt(tx)*sqrt(ty), 0), 6) + 0 END AS corr
    FROM n LEFT JOIN s ON s.a = n.a AND s.b = n.b {f'AND s.{key} = n.{key}' if key else ''}"""


@query("kendall_matrix", kendall_sql("fx_block", "", "grp", 30), "fx_block")
def q_kendall(fx):
    return rounded(K.association(block(fx), [], "grp", "value", "kendall", 30), corr=6)


@query("kendall_within_group", kendall_sql("fx_dense", "grp", "series", 30), "fx_dense")
def q_kendall_within(fx):
    return rounded(K.association(fx.panel, ["grp"], "series", "value", "kendall", 30, blocks=2), corr=6)


@query("abs_corr_summary", f"""
    SELECT grp, CAST(count(DISTINCT a) AS BIGINT) AS n_items, round(avg(abs(corr)), 5) + 0 AS mean_abs, round(median(abs(corr)), 5) + 0 AS median_abs, round(max(abs(corr)), 5) + 0 AS max_abs,
           round(avg(CASE WHEN corr IS NOT NULL THEN CASE WHEN abs(corr) > 0.5 THEN 1e0 ELSE 0e0 END END), 5) + 0 AS share_over_50, round(avg(CASE WHEN corr IS NOT NULL THEN CASE WHEN abs(corr) > 0.7 THEN 1e0 ELSE 0e0 END END), 5) + 0 AS share_over_70
    FROM ({kendall_sql('fx_dense', 'grp', 'series', 30)}) m GROUP BY 1""", "fx_dense")
def q_abs_corr(fx):
    m = rounded(K.association(fx.panel, ["grp"], "series", "value", "kendall", 30, blocks=2), corr=6)
    return rounded(K.abs_corr_summary(m, ["grp"]), mean_abs=5, median_abs=5, max_abs=5, share_over_50=5, share_over_70=5)


# ---- ranking tables ---------------------------------------------------------------------------


@query("top_n_per_group", """
    SELECT maturity, model, date, y_hat, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY maturity, model ORDER BY y_hat DESC, date) AS rn FROM fx_models) q WHERE rn <= 5""", "fx_models")
def q_topn(fx):
    from pyspark.sql import Window

    w = Window.partitionBy("maturity", "model").orderBy(F.col("y_hat").desc(), "date")
    return fx.models.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 5)


@query("latest_per_key", """
    SELECT maturity, model, date, y_hat FROM (SELECT *, row_number() OVER (PARTITION BY maturity, model ORDER BY date DESC) AS rn FROM fx_models) q WHERE rn = 1""", "fx_models")
def q_latest_key(fx):
    return fx.models.groupBy("maturity", "model").agg(F.max("date").alias("date"), F.max_by("y_hat", "date").alias("y_hat"))
