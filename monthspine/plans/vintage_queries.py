"""Queries: bitemporal histories, decision picks, cascades, grouping and alignment."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import columns as C
from ..functions.calendar import calendar_months, release_cutoff, shift_literal, shift_months, with_months
from ..operators import grouping as G
from ..operators import panel as P
from ..operators import regimes as R
from ..operators import registry as REG
from ..operators import vintage as V
from ..operators.transforms import by_date
from .fixtures import SNAPSHOTS_AFTER, Fixtures, add_view
from .registry import query

FIRST = "1995-06-30"  # first decision and forecast month; the last is that of the last order
START = "1996-01-31"  # first row of as-of panels
WARM = shift_literal(START, -2)  # first month they are read from

# ---- histories --------------------------------------------------------------------------------


@query("history_clean", """
    WITH raw AS (SELECT CASE WHEN n % 101 = 0 THEN NULL ELSE series_id END AS series_id, CAST(obs_date AS VARCHAR) AS obs_date,
                   CASE WHEN n % 97 = 0 THEN 'soon' ELSE CAST(realtime_start AS VARCHAR) END AS realtime_start,
                   CASE WHEN realtime_end = DATE '9999-12-31' AND n % 2 = 0 THEN NULL ELSE CAST(realtime_end AS VARCHAR) END AS realtime_end,
                   CASE WHEN n % 89 = 0 THEN 'n/a' ELSE CAST(n AS VARCHAR) END AS value
            FROM (SELECT *, CAST(round(value*100) AS BIGINT) AS n FROM fx_history) h)
    SELECT series_id, TRY_CAST(obs_date AS DATE) AS obs_date, TRY_CAST(realtime_start AS DATE) AS realtime_start,
           coalesce(TRY_CAST(realtime_end AS DATE), DATE '9999-12-31') AS realtime_end, TRY_CAST(value AS DOUBLE) AS value
    FROM raw WHERE series_id IS NOT NULL AND TRY_CAST(realtime_start AS DATE) IS NOT NULL""", "fx_history")
def q_history_clean(fx):
    n = F.round(F.col("value") * 100).cast("bigint")
    text = lambda c: F.col(c).cast("string")
    raw = fx.history.withColumn("n", n).select(
        F.when(F.col("n") % 101 != 0, F.col("series_id")).alias("series_id"),
        text("obs_date").alias("obs_date"),
        F.when(F.col("n") % 97 == 0, "soon").otherwise(text("realtime_start")).alias("realtime_start"),
        F.when(~((text("realtime_end") == V.OPEN_END) & (F.col("n") % 2 == 0)), text("realtime_end")).alias("realtime_end"),
        F.when(F.col("n") % 89 == 0, "n/a").otherwise(text("n")).alias("value"),
    )
    return V.clean_history(raw)


add_view("fx_asof_months", f"""
    SELECT last_day(CAST(m AS DATE)) AS as_of
    FROM (SELECT unnest(generate_series(CAST(date_trunc('month', least(first, DATE '{FIRST}')) AS DATE), CAST(last + to_months(7) AS DATE), INTERVAL 1 MONTH)) AS m FROM fx_ends) g""", "fx_ends")


@query("bitemporal_asof", f"""
    SELECT as_of, series_id, obs_date, value FROM (
      SELECT a.as_of, h.*, row_number() OVER (PARTITION BY a.as_of, h.series_id, h.obs_date ORDER BY realtime_start DESC, realtime_end DESC) AS rn
      FROM fx_asof_months a JOIN fx_history h ON a.as_of BETWEEN h.realtime_start AND h.realtime_end AND h.obs_date <= a.as_of
      WHERE a.as_of BETWEEN DATE '{START}' AND (SELECT last_day(last + to_months({SNAPSHOTS_AFTER})) FROM fx_ends)) q WHERE rn = 1""", "fx_asof_months fx_history fx_ends")
def q_asof(fx):
    return V.asof_panel(fx.history, START, fx.after(SNAPSHOTS_AFTER))


add_view("fx_fdates", f"""
    SELECT as_of AS forecast_date FROM fx_asof_months WHERE as_of BETWEEN DATE '{FIRST}' AND (SELECT last FROM fx_ends)""", "fx_asof_months fx_ends")
add_view("fx_selection", """
    SELECT f.forecast_date, last_day(f.forecast_date + to_months(1)) AS requested_vintage_month,
           coalesce(max(v.vintage_month) FILTER (WHERE v.vintage_month <= last_day(f.forecast_date + to_months(1))), min(v.vintage_month)) AS selected_archive_month,
           CASE WHEN max(v.vintage_month) FILTER (WHERE v.vintage_month <= last_day(f.forecast_date + to_months(1))) IS NULL
                THEN 'EARLIEST_ARCHIVE_ANCHOR' ELSE 'ARCHIVE_FALLBACK' END AS archive_source_tag,
           last_day(f.forecast_date + to_months(1)) AS as_of
    FROM fx_fdates f CROSS JOIN (SELECT DISTINCT vintage_month FROM fx_archive) v GROUP BY f.forecast_date""", "fx_fdates fx_archive")


def fdates(fx: Fixtures):
    return calendar_months(fx.spark, FIRST, fx.last_month, "forecast_date")


@query("vintage_select", "SELECT * FROM fx_selection", "fx_selection")
def q_select(fx):
    return V.vintage_selection(fdates(fx), fx.archive.select("vintage_month"))


add_view("fx_reads", """
    SELECT series, kind, rule, lag_mode, lag_months, lag_schedule, 'direct' AS role, target AS series_id FROM fx_registry WHERE kind <> 'derived_formula'
    UNION ALL SELECT series, kind, rule, lag_mode, lag_months, lag_schedule, 'num', num FROM fx_registry WHERE kind = 'derived_formula'
    UNION ALL SELECT series, kind, rule, lag_mode, lag_months, lag_schedule, 'den', den FROM fx_registry WHERE kind = 'derived_formula'""", "fx_registry")
add_view("fx_asks", f"""
    SELECT a.as_of AS decision, r.*, last_day(a.as_of - to_months(CASE r.rule WHEN 'month_end_plus_1m' THEN 1 WHEN 'month_end_plus_2m' THEN 2
             WHEN 'month_end_plus_3m' THEN 3 ELSE 0 END)) AS cutoff,
           greatest(1, CASE WHEN r.lag_mode = 'decision_month_schedule' THEN (month(a.as_of) - 1) % 3 + 1 ELSE r.lag_months END,
                    CASE WHEN r.role <> 'direct' THEN 1 ELSE 0 END) AS max_gap
    FROM fx_reads r CROSS JOIN fx_asof_months a WHERE a.as_of BETWEEN DATE '{FIRST}' AND (SELECT last FROM fx_ends)""", "fx_reads fx_asof_months fx_ends")
add_view("fx_strict", """
    SELECT decision, series, role, cutoff, max_gap, kind, value, obs_date FROM (
      SELECT k.*, h.value, h.obs_date, row_number() OVER (PARTITION BY k.decision, k.series, k.role ORDER BY h.obs_date DESC, h.realtime_start DESC, h.realtime_end DESC) AS rn
      FROM fx_asks k JOIN fx_history h ON h.series_id = k.series_id AND h.obs_date <= k.cutoff AND k.decision BETWEEN h.realtime_start AND h.realtime_end) q
    WHERE rn = 1""", "fx_asks fx_history")
add_view("fx_first_vintage", "SELECT series_id, min(realtime_start) AS first_vintage FROM fx_history GROUP BY 1", "fx_history")
add_view("fx_earliest", """
    SELECT decision, series, role, cutoff, value, obs_date FROM (
      SELECT k.*, h.value, h.obs_date, row_number() OVER (PARTITION BY k.decision, k.series, k.role ORDER BY h.obs_date DESC, h.realtime_start DESC, h.realtime_end DESC) AS rn
      FROM fx_asks k JOIN fx_first_vintage f ON f.series_id = k.series_id AND k.decision < f.first_vintage
      JOIN fx_history h ON h.series_id = k.series_id AND h.obs_date <= k.cutoff AND f.first_vintage BETWEEN h.realtime_start AND h.realtime_end) q
    WHERE rn = 1""", "fx_asks fx_first_vintage fx_history")
add_view("fx_latest", """
    SELECT decision, series, role, cutoff, value, obs_date FROM (
      SELECT k.*, h.value, h.obs_date, row_number() OVER (PARTITION BY k.decision, k.series, k.role ORDER BY h.obs_date DESC, h.realtime_start DESC, h.realtime_end DESC) AS rn
      FROM fx_asks k JOIN fx_first_vintage f ON f.series_id = k.series_id AND k.decision >= f.first_vintage
      JOIN fx_history h ON h.series_id = k.series_id AND h.obs_date <= k.cutoff) q
    WHERE rn = 1""", "fx_asks fx_first_vintage fx_history")
PICK_COLS = ["decision", "series", "role", "cutoff", "value", "obs_date"]


@query("pick_strict", "SELECT decision, series, role, cutoff, value, obs_date FROM fx_strict", "fx_strict")
def q_strict(fx):
    return V.pick_strict(fx.history, V.decision_reads(fx.registry), FIRST, fx.last_month).select(*PICK_COLS)


add_view("fx_late_history", """
    SELECT series_id, obs_date, CASE WHEN series_id < '3' THEN last_day(realtime_start + to_months(24)) ELSE realtime_start END AS realtime_start,
           CASE WHEN series_id < '3' AND realtime_end < DATE '9999-12-31' THEN CAST(last_day(realtime_end + INTERVAL 1 DAY + to_months(24)) - 1 AS DATE)
                ELSE realtime_end END AS realtime_end, value FROM fx_history""", "fx_history")


def late_history(fx):
    """The history with two series whose vintages begin two years late."""
    late = F.col("series_id") < "3"
    return fx.stored_history.select(
        "series_id", "obs_date",
        F.when(late, shift_months("realtime_start", 24)).otherwise(F.col("realtime_start")).alias("realtime_start"),
        F.when(late & (F.col("realtime_end") < V.OPEN_END), F.date_add(shift_months(F.date_add("realtime_end", 1), 24), -1))
        .otherwise(F.col("realtime_end")).alias("realtime_end"),
        "value",
    )


add_view("fx_late_first", "SELECT series_id, min(realtime_start) AS first_vintage FROM fx_late_history GROUP BY 1", "fx_late_history")


def late(sql: str) -> str:
    """A pick view's text, read from the late history."""
    return sql.replace("fx_history", "fx_late_history").replace("fx_first_vintage", "fx_late_first")


from .fixtures import SQL_VIEWS  # noqa: E402

for _v in ["fx_strict", "fx_earliest", "fx_latest"]:
    add_view(_v + "_late", late(SQL_VIEWS[_v][1]), late(" ".join(SQL_VIEWS[_v][0])))


@query("pick_earliest", "SELECT decision, series, role, cutoff, value, obs_date FROM fx_earliest_late", "fx_earliest_late")
def q_earliest(fx):
    return V.pick_earliest(late_history(fx), V.decision_reads(fx.registry), FIRST, fx.last_month).select(*PICK_COLS)


@query("pick_latest", "SELECT decision, series, role, cutoff, value, obs_date FROM fx_latest_late", "fx_latest_late")
def q_latest(fx):
    return V.pick_latest(late_history(fx), V.decision_reads(fx.registry), FIRST, fx.last_month).select(*PICK_COLS)


MONTHS_SQL = "((year(cutoff)*12 + month(cutoff)) - (year(obs_date)*12 + month(obs_date)))"


@query("pick_with_staleness", f"""
    SELECT decision, series, role, cutoff, obs_date, CASE WHEN {MONTHS_SQL} <= greatest(1, CASE WHEN lag_mode = 'decision_month_schedule'
             THEN (month(decision) - 1) % 3 + 1 ELSE lag_months END) THEN value END AS value
    FROM (SELECT s.*, r.lag_mode, r.lag_months FROM fx_strict s JOIN fx_registry r USING (series)) q""", "fx_strict fx_registry")
def q_stale(fx):
    return V.guard_stale(V.pick_strict(fx.history, V.decision_reads(fx.registry), FIRST, fx.last_month), 1).select(*PICK_COLS)


# ---- as-of panels -----------------------------------------------------------------------------

add_view("fx_asof_cells", f"""
    SELECT f.forecast_date, h.obs_date AS date, h.series_id, h.value
    FROM fx_selection f JOIN fx_history h ON f.as_of BETWEEN h.realtime_start AND h.realtime_end
     AND h.obs_date BETWEEN DATE '{WARM}' AND f.forecast_date""", "fx_selection fx_history")
add_view("fx_asof_series", """
    SELECT forecast_date, date, series, coalesce(max(value) FILTER (WHERE role = 'direct'),
           max(value) FILTER (WHERE role = 'num') / nullif(max(value) FILTER (WHERE role = 'den'), 0)) AS value
    FROM fx_asof_cells JOIN fx_reads USING (series_id) GROUP BY 1,2,3""", "fx_asof_cells fx_reads")
add_view("fx_filled", f"""
    SELECT coalesce(a.forecast_date, b.forecast_date) AS forecast_date, coalesce(a.date, b.date) AS date, coalesce(a.series, b.series) AS series,
           coalesce(a.value, b.value) AS raw,
           CASE WHEN a.value IS NOT NULL THEN 'ALFRED_ASOF' WHEN b.value IS NOT NULL THEN b.archive_source_tag ELSE 'MISSING' END AS tag
    FROM fx_asof_series a FULL OUTER JOIN (
      SELECT s.forecast_date, s.archive_source_tag, v.date, v.series_id AS series, v.value
      FROM fx_selection s JOIN fx_archive v ON v.vintage_month = s.selected_archive_month
       AND v.date BETWEEN DATE '{WARM}' AND s.forecast_date) b
    ON a.forecast_date = b.forecast_date AND a.date = b.date AND a.series = b.series""", "fx_asof_series fx_selection fx_archive")
add_view("fx_vpanel_all", f"""
    SELECT q.*, CASE tcode WHEN 1 THEN raw WHEN 2 THEN raw - v1 WHEN 3 THEN (raw - v1) - (v1 - v2) WHEN 4 THEN l0 WHEN 5 THEN l0 - l1
         WHEN 6 THEN (l0 - l1) - (l1 - l2) WHEN 7 THEN (raw/nullif(v1,0) - 1) - (v1/nullif(v2,0) - 1) END AS transformed
    FROM (SELECT *, lag(raw,1) OVER w AS v1, lag(raw,2) OVER w AS v2, CASE WHEN raw>0 THEN ln(raw) END AS l0,
                 lag(CASE WHEN raw>0 THEN ln(raw) END,1) OVER w AS l1, lag(CASE WHEN raw>0 THEN ln(raw) END,2) OVER w AS l2
          FROM (SELECT f.forecast_date, r.series, r.tcode, r.grp, m.as_of AS date, x.raw, coalesce(x.tag, 'MISSING') AS tag
                FROM fx_fdates f CROSS JOIN fx_registry r
                JOIN fx_asof_months m ON m.as_of BETWEEN DATE '{WARM}' AND f.forecast_date
                LEFT JOIN fx_filled x ON x.forecast_date = f.forecast_date AND x.date = m.as_of AND x.series = r.series) g
          WINDOW w AS (PARTITION BY forecast_date, series ORDER BY date)) q""", "fx_fdates fx_registry fx_asof_months fx_filled")
add_view("fx_vpanel", f"SELECT * FROM fx_vpanel_all WHERE date >= DATE '{START}' AND series <> '5-LOW'", "fx_vpanel_all")
add_view("fx_diag", "SELECT * FROM fx_vpanel WHERE date = forecast_date", "fx_vpanel")


def vpanels(fx: Fixtures, diagonal: bool = False):
    first = START if diagonal else FIRST
    return V.vintage_panels(
        fx.stored_history, fx.archive, fx.registry, fdates(fx), START, first, fx.last_month, drop=["5-LOW"], diagonal=diagonal
    )


@query("derived_ratio", """
    SELECT forecast_date, date, series, round(value, 10) + 0 AS value FROM fx_asof_series WHERE series = '6-RATIO' AND value IS NOT NULL""", "fx_asof_series")
def q_ratio(fx):
    sel = V.vintage_selection(fdates(fx), fx.archive.select("vintage_month"))
    ratio = fx.registry.where(F.col("kind") == "derived_formula")
    cells = V.asof_cells(fx.stored_history, ratio, sel, shift_literal(FIRST, 1), fx.after(1), WARM)
    return cells.where(F.col("value").isNotNull()).withColumn("value", C.rnd("value", 10))


@query("archive_fallback", """
    SELECT forecast_date, date, series, raw, tag FROM fx_filled WHERE series <> '6-RATIO'""", "fx_filled")
def q_fallback(fx):
    sel = V.vintage_selection(fdates(fx), fx.archive.select("vintage_month"))
    direct = fx.registry.where(F.col("kind") != "derived_formula")
    cells = V.asof_cells(fx.stored_history, direct, sel, shift_literal(FIRST, 1), fx.after(1), WARM)
    return V.fill_from_archive(cells, fx.archive.withColumnRenamed("series_id", "series"), sel, WARM)


@query("vintage_panel", """
    SELECT forecast_date, date, series, round(raw, 6) + 0 AS raw, round(transformed, 6) + 0 AS transformed, tag FROM fx_vpanel""", "fx_vpanel")
def q_vpanel(fx):
    return vpanels(fx).withColumn("raw", C.rnd("raw")).withColumn("transformed", C.rnd("transformed"))


@query("stitched_panel", """
    SELECT forecast_date, date, series, round(raw, 6) + 0 AS raw, round(transformed, 6) + 0 AS transformed, tag FROM fx_diag""", "fx_diag")
def q_stitched(fx):
    return vpanels(fx, diagonal=True).withColumn("raw", C.rnd("raw")).withColumn("transformed", C.rnd("transformed"))


# ---- decision cascade -------------------------------------------------------------------------

add_view("fx_balanced", f"""
    WITH s AS (SELECT decision, series, role, CASE WHEN {MONTHS_SQL} <= max_gap THEN value END AS value FROM fx_strict_late WHERE kind IN ('direct_alfred','derived_formula')
               UNION ALL SELECT decision, series, role, value FROM fx_latest_late JOIN (SELECT series, kind FROM fx_registry) r USING (series) WHERE kind NOT IN ('direct_alfred','derived_formula')),
         sv AS (SELECT decision, series, coalesce(max(value) FILTER (WHERE role='direct'), max(value) FILTER (WHERE role='num')/nullif(max(value) FILTER (WHERE role='den'),0)) AS v FROM s GROUP BY 1,2),
         ev AS (SELECT decision, series, coalesce(max(value) FILTER (WHERE role='direct'), max(value) FILTER (WHERE role='num')/nullif(max(value) FILTER (WHERE role='den'),0)) AS v FROM fx_earliest_late GROUP BY 1,2),
         g AS (SELECT r.series, a.as_of AS decision, NOT (r.series = '3-MEDIUM' AND a.as_of < DATE '1996-06-30') AS open_now FROM fx_registry r CROSS JOIN fx_asof_months a WHERE a.as_of BETWEEN DATE '{FIRST}' AND (SELECT last FROM fx_ends))
    SELECT decision, series, CASE WHEN open_now THEN coalesce(sv.v, ev.v) END AS value,
           CASE WHEN open_now AND sv.v IS NOT NULL THEN 'STRICT' WHEN open_now AND ev.v IS NOT NULL THEN 'FILL_PRE_VINTAGE_EARLIEST' ELSE '' END AS tag
    FROM g LEFT JOIN sv USING (decision, series) LEFT JOIN ev USING (decision, series)""",
    "fx_strict_late fx_latest_late fx_earliest_late fx_registry fx_asof_months fx_ends")
STARTS = {"3-MEDIUM": "1996-06-30"}


def balanced(fx: Fixtures):
    return V.balanced_cascade(late_history(fx), fx.registry, FIRST, fx.last_month, 1, STARTS)


@query("balanced_cascade", "SELECT decision, series, round(value, 6) + 0 AS value, tag FROM fx_balanced", "fx_balanced")
def q_balanced(fx):
    return balanced(fx).withColumn("value", C.rnd("value"))


@query("earliest_vintage", "SELECT series_id, min(vintage_month) AS anchor_month FROM fx_archive GROUP BY 1", "fx_archive")
def q_earliest_vintage(fx):
    return V.earliest_vintage(fx.archive)


@query("vintage_nearest", f"""
    SELECT k.decision, k.series, k.cutoff, arg_max(v.value, v.date) AS value
    FROM fx_asks k JOIN fx_archive v ON v.vintage_month = k.decision AND v.series_id = k.series_id AND v.date <= k.cutoff
    WHERE k.role = 'direct' AND v.value IS NOT NULL AND (year(k.cutoff)*12 + month(k.cutoff)) - (year(v.date)*12 + month(v.date)) <= k.max_gap
    GROUP BY 1,2,3""", "fx_asks fx_archive")
def q_nearest(fx):
    reads = V.decision_reads(fx.registry).where(F.col("role") == "direct")
    asked = with_months(reads, F.lit(FIRST), F.lit(fx.last_month), "decision").select(
        "decision", "series", "series_id", F.col("decision").alias("vintage_month"),
        release_cutoff("decision", "rule").alias("cutoff"), V.staleness_limit(1).alias("max_gap"),
    )
    return V.nearest_in_snapshot(asked, fx.archive).select("decision", "series", "cutoff", "value")


# gaps for the backfill: a balanced panel that lost part of its cells, and late archive columns
LOST_SQL = "((year(decision)*12 + month(decision) + ascii(substr(series,1,1))) % 4 = 0 OR (series = '2-HIGH' AND decision < DATE '1998-01-31' AND month(decision) <> 8))"
add_view("fx_lost", f"SELECT decision, series, CASE WHEN {LOST_SQL} THEN NULL ELSE value END AS value, CASE WHEN {LOST_SQL} THEN '' ELSE tag END AS tag FROM fx_balanced", "fx_balanced")
add_view("fx_cols", "SELECT * FROM fx_archive WHERE NOT (series_id IN ('2-HIGH','1-URGENT') AND vintage_month < DATE '1997-01-31')", "fx_archive")
add_view("fx_final", "SELECT series_id AS series, obs_date AS date, arg_max(value, realtime_start) AS value FROM fx_history GROUP BY 1,2", "fx_history")


def backfill_sql(tag: str, own: bool) -> str:
    own_sql = "OR same IS NOT NULL OR anchor IS NOT NULL" if own else ""
    return f"""
    WITH c AS (SELECT b.*, k.cutoff, k.max_gap, a.anchor_month, NOT (b.series = '3-MEDIUM' AND b.decision < DATE '1996-06-30') AS open_now
               FROM fx_lost b
               JOIN (SELECT decision, series, last_day(decision - to_months(CASE rule WHEN 'month_end_plus_1m' THEN 1 WHEN 'month_end_plus_2m' THEN 2 WHEN 'month_end_plus_3m' THEN 3 ELSE 0 END)) AS cutoff,
                       greatest(1, CASE WHEN lag_mode = 'decision_month_schedule' THEN (month(decision) - 1) % 3 + 1 ELSE lag_months END) AS max_gap
                     FROM (SELECT DISTINCT decision, series, rule, lag_mode, lag_months FROM fx_asks) x) k USING (decision, series)
               LEFT JOIN (SELECT series_id AS series, min(vintage_month) AS anchor_month FROM fx_cols GROUP BY 1) a USING (series)),
         v AS (SELECT series_id AS series, vintage_month, date, value FROM fx_cols WHERE value IS NOT NULL),
         s AS (SELECT c.decision, c.series, arg_max(v.value, v.date) AS same FROM c JOIN v ON v.series = c.series AND v.vintage_month = c.decision AND v.date <= c.cutoff
                AND (year(c.cutoff)*12+month(c.cutoff)) - (year(v.date)*12+month(v.date)) <= c.max_gap WHERE c.value IS NULL AND c.open_now GROUP BY 1,2),
         n AS (SELECT c.decision, c.series, arg_max(v.value, v.date) AS anchor FROM c JOIN v ON v.series = c.series AND v.vintage_month = c.anchor_month AND v.date <= c.cutoff
                AND (year(c.cutoff)*12+month(c.cutoff)) - (year(v.date)*12+month(v.date)) <= c.max_gap
               WHERE c.value IS NULL AND c.open_now AND c.decision < c.anchor_month GROUP BY 1,2),
         p AS (SELECT c.decision, c.series, arg_max(f.value, f.date) AS plain FROM c JOIN fx_final f ON f.series = c.series AND f.date <= c.cutoff GROUP BY 1,2),
         j AS (SELECT c.*, s.same, n.anchor, p.plain FROM c LEFT JOIN s USING (decision, series) LEFT JOIN n USING (decision, series) LEFT JOIN p USING (decision, series)),
         t AS (SELECT *, series = '2-HIGH' AND coalesce(max(CASE WHEN tag IN ('STRICT','FILL_RELEASE_GAP','FILL_PRE_VINTAGE_EARLIEST') {own_sql} THEN 1 ELSE 0 END)
                  OVER (PARTITION BY series ORDER BY decision ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS barred FROM j),
         f AS (SELECT *, value IS NULL AND open_now AS fillable, coalesce(same, CASE WHEN NOT barred THEN anchor END) AS snap,
                  CASE WHEN NOT (coalesce(decision < anchor_month, false) AND barred) THEN plain END AS pl FROM t)
    SELECT decision, series, round(CASE WHEN fillable THEN coalesce(snap, pl) ELSE value END, 6) + 0 AS value,
           CASE WHEN fillable AND snap IS NOT NULL THEN '{tag}' WHEN fillable AND pl IS NOT NULL THEN 'FILL_NONREVISED_FRED' ELSE tag END AS tag,
           fillable AND coalesce(snap, pl) IS NOT NULL AS filled FROM f"""


def lost(fx):
    gone = F.expr(
        "(year(decision)*12 + month(decision) + ascii(substr(series,1,1))) % 4 = 0 "
        "OR (series = '2-HIGH' AND decision < DATE '1998-01-31' AND month(decision) <> 8)"
    )
    return balanced(fx).select(
        "decision", "series", F.when(~gone, F.col("value")).alias("value"), F.when(gone, "").otherwise(F.col("tag")).alias("tag")
    )


def late_columns(fx):
    return fx.archive.where(~(F.col("series_id").isin("2-HIGH", "1-URGENT") & (F.col("vintage_month") < "1997-01-31")))


def backfill(fx, tag):
    final = fx.stored_history.groupBy(F.col("series_id").alias("series"), F.col("obs_date").alias("date")).agg(
        F.max_by("value", "realtime_start").alias("value"))
    return V.anchor_backfill(
        fx.shared(lost(fx)), fx.registry, late_columns(fx), final, tag=tag, blocked=["2-HIGH"], starts=STARTS,
        first=fx.first_month, last=fx.last_month,
    )


@query("anchor_backfill", backfill_sql("FILL_ANCHOR_VINTAGE_EARLIEST", False), "fx_lost fx_asks fx_cols fx_final")
def q_backfill(fx):
    return backfill(fx, fv.TAG_ANCHOR_VINTAGE).withColumn("value", C.rnd("value"))


@query("anchor_backfill_own_tag", backfill_sql("FILL_PRE_VINTAGE_EARLIEST", True), "fx_lost fx_asks fx_cols fx_final")
def q_backfill_own(fx):
    return backfill(fx, fv.TAG_PRE_VINTAGE).withColumn("value", C.rnd("value"))


@query("backfill_counts", "SELECT series, CAST(count(*) AS BIGINT) AS n FROM (" + backfill_sql("FILL_ANCHOR_VINTAGE_EARLIEST", False) + ") q WHERE filled GROUP BY 1",
       "fx_lost fx_asks fx_cols fx_final")
def q_backfill_counts(fx):
    return backfill(fx, fv.TAG_ANCHOR_VINTAGE).where("filled").groupBy("series").agg(F.count("*").alias("n"))


# ---- registry ---------------------------------------------------------------------------------


@query("registry_build", """
    WITH n AS (SELECT series, row_number() OVER (ORDER BY series) AS hs_no, CAST((CAST(substr(series,1,1) AS INTEGER) + ascii(right(series,1))) % 7 + 1 AS INTEGER) AS tcode
               FROM (SELECT DISTINCT series FROM fx_panel) q)
    SELECT CAST(hs_no AS INTEGER) AS hs_no, series, tcode,
           CASE WHEN series = '5-LOW|P' THEN 'public_proxy' WHEN series = '4-NOT SPECIFIED|F' THEN 'derived_formula'
                WHEN series = '3-MEDIUM|O' THEN 'direct_fred' ELSE 'direct_alfred' END AS kind,
           CASE WHEN series IN ('5-LOW|P','4-NOT SPECIFIED|F') THEN '' WHEN series = '3-MEDIUM|O' THEN 'MEDO' WHEN series = '1-URGENT|F' THEN 'URGF' ELSE series END AS target,
           CASE WHEN series = '4-NOT SPECIFIED|F' THEN '["A","B"]' ELSE '[]' END AS components,
           CASE WHEN series = '4-NOT SPECIFIED|F' THEN 'A / B' ELSE '' END AS formula,
           CASE WHEN series = '5-LOW|P' THEN 'public_proxy_only' WHEN series = '4-NOT SPECIFIED|F' THEN 'component_revisions'
                WHEN series = '2-HIGH|P' THEN 'market_effectively_nonrevised' ELSE 'observable_revisions' END AS revision_class,
           CASE WHEN series IN ('5-LOW|P','4-NOT SPECIFIED|F','3-MEDIUM|O') THEN 'N' ELSE 'Y' END AS vintage_flag,
           'same_month_end' AS rule, 0 AS lag_months_base, 'fixed' AS lag_mode, CASE WHEN series = '1-URGENT|O' THEN 2 ELSE 1 END AS lag_months, '' AS lag_schedule
    FROM n""", "fx_panel")
def q_registry(fx):
    from .panel_queries import tcode_of

    names = fx.panel.select("series").distinct().withColumn("tcode", tcode_of())
    rules = REG.rule_rows(
        never_revised=["2-HIGH|P"], aliases={"1-URGENT|F": "URGF"}, unrevised_sources={"3-MEDIUM|O": "MEDO"},
        ratios={"4-NOT SPECIFIED|F": ("A", "B")}, local_only=["5-LOW|P"],
    )
    lags = fx.rows([("1-URGENT|O", "fixed", 2, "")], "series string, lag_mode string, lag_months int, lag_schedule string")
    return REG.build_registry(names, rules, lags).select(
        "hs_no", "series", "tcode", "kind", "target", "components", "formula", "revision_class", "vintage_flag",
        "rule", "lag_months_base", "lag_mode", "lag_months", "lag_schedule",
    )


@query("series_ids_distinct", """
    SELECT target AS series_id FROM fx_registry WHERE target IS NOT NULL UNION SELECT num FROM fx_registry WHERE num IS NOT NULL
    UNION SELECT den FROM fx_registry WHERE den IS NOT NULL UNION SELECT DISTINCT concat(series_id, '*') FROM fx_history""", "fx_registry fx_history")
def q_series_ids(fx):
    reg = fx.registry.select("target", F.when(F.col("kind") == "derived_formula", F.to_json(F.array("num", "den"))).alias("components"))
    more = fx.history.select(F.lit(None).cast("string").alias("target"), F.to_json(F.array(F.concat("series_id", F.lit("*")))).alias("components"))
    return REG.series_ids(reg.unionByName(more))


# ---- groups, alignment ------------------------------------------------------------------------

GROUPS = [("1-URGENT|F", "alpha"), ("1-URGENT|O", "alpha"), ("2-HIGH|F", "beta"), ("3-MEDIUM|P", "beta"), ("9-NEVER|X", "gamma")]
GROUP_SQL = "CASE WHEN series IN ('1-URGENT|F','1-URGENT|O') THEN 'alpha' WHEN series IN ('2-HIGH|F','3-MEDIUM|P') THEN 'beta' ELSE 'Other' END"


def mapping(fx):
    return fx.rows(GROUPS, "series string, grp string")


@query("group_attach", f"SELECT date, series, {GROUP_SQL} AS grp, value FROM fx_panel", "fx_panel")
def q_group_attach(fx):
    return G.attach_group(fx.panel.select("date", "series", "value"), mapping(fx), default=fv.OTHER_GROUP).select("date", "series", "grp", "value")


@query("group_unmapped", f"""
    SELECT DISTINCT series, 'unmapped' AS problem FROM fx_panel WHERE {GROUP_SQL} = 'Other' UNION ALL SELECT '9-NEVER|X', 'unused'""", "fx_panel")
def q_group_unmapped(fx):
    return G.mapping_gaps(fx.panel, mapping(fx))


@query("group_codes", """
    WITH c AS (SELECT series, concat('g', right(series, 1)) AS grp, row_number() OVER (ORDER BY series DESC) - 1 AS position FROM (SELECT DISTINCT series FROM fx_panel) q),
         f AS (SELECT grp, min(position) AS first, string_agg(CAST(position AS VARCHAR), ',' ORDER BY position) AS positions FROM c GROUP BY 1)
    SELECT grp, CAST(row_number() OVER (ORDER BY first) - 1 AS INTEGER) AS code, positions FROM f""", "fx_panel")
def q_group_codes(fx):
    names = fx.panel.select("series").distinct()
    cols = names.select(
        F.concat(F.lit("g"), F.right("series", F.lit(1))).alias("grp"),
        (F.row_number().over(Window.orderBy(F.col("series").desc())) - 1).alias("position"),
    )
    return G.group_codes(cols).withColumn("positions", F.concat_ws(",", F.col("positions").cast("array<string>")))


@query("align_common_dates", """
    WITH d AS (SELECT DISTINCT date FROM fx_curve INTERSECT SELECT DISTINCT date FROM fx_panel)
    SELECT 'curve' AS source, date, CAST(maturity AS VARCHAR) AS series, y AS value FROM fx_curve WHERE date IN (SELECT date FROM d)
    UNION ALL SELECT 'macro', date, series, value FROM fx_panel WHERE date IN (SELECT date FROM d)""", "fx_curve fx_panel")
def q_align(fx):
    curve = fx.curve.select("date", F.col("maturity").cast("string").alias("series"), F.col("y").alias("value"))
    return P.align_common_dates({"curve": curve, "macro": fx.panel})


@query("union_labelled", """
    SELECT 'total' AS agg, grp, CAST(sum(n) AS BIGINT) AS n FROM fx_panel GROUP BY grp
    UNION ALL SELECT 'per_series', series, CAST(sum(n) AS BIGINT) FROM fx_panel GROUP BY series""", "fx_panel")
def q_union(fx):
    total = fx.panel.groupBy("grp").agg(F.sum("n").alias("n")).select(F.lit("total").alias("agg"), "grp", "n")
    per = fx.panel.groupBy(F.col("series").alias("grp")).agg(F.sum("n").alias("n")).select(F.lit("per_series").alias("agg"), "grp", "n")
    return total.unionByName(per)


@query("regime_flag", """
    SELECT c.date, max(CASE WHEN r.episode IS NOT NULL THEN 1 ELSE 0 END) = 1 AS flag
    FROM (SELECT DISTINCT date FROM fx_curve) c LEFT JOIN fx_regimes r ON c.date BETWEEN last_day(r.start_date) AND last_day(r.end_date)
    GROUP BY 1""", "fx_curve fx_regimes")
def q_regime_flag(fx):
    return R.flag_regime(fx.curve.select("date").distinct(), fx.regimes, by_month=True)


@query("regime_asof", """
    WITH i AS (SELECT last_day(CAST(m AS DATE)) - 20 AS day, CASE WHEN year(CAST(m AS DATE)) IN (1996, 2001) THEN 1 ELSE 0 END AS flag
               FROM (SELECT unnest(generate_series(DATE '1996-02-01', DATE '2001-06-01', INTERVAL 3 MONTH)) AS m) g)
    SELECT c.date, CAST(coalesce(arg_max(i.flag, i.day), 0) AS INTEGER) AS flag FROM (SELECT DISTINCT date FROM fx_curve) c LEFT JOIN i ON i.day <= c.date GROUP BY 1""", "fx_curve")
def q_regime_asof(fx):
    months = fx.spark.range(1).select(F.explode(F.expr("sequence(date'1996-02-01', date'2001-06-01', interval 3 month)")).alias("m"))
    monthly = months.select(F.date_add(F.last_day("m"), -20).alias("date"), F.year("m").isin(1996, 2001).cast("int").alias("flag"))
    return R.indicator_asof(fx.curve.select("date").distinct(), monthly, "flag")


@query("realtime_features", """
    WITH o AS (SELECT forecast_date AS origin FROM fx_fdates)
    SELECT o.origin, c.date, 'curve' AS source, CAST(c.maturity AS VARCHAR) AS series, round(c.y, 6) + 0 AS value FROM o JOIN fx_curve c ON c.date <= o.origin
    UNION ALL SELECT forecast_date, date, 'macro', series, round(transformed, 6) + 0 FROM fx_vpanel""", "fx_vpanel fx_curve fx_fdates")
def q_realtime(fx):
    curve = fx.curve.select("date", F.lit("curve").alias("source"), F.col("maturity").cast("string").alias("series"), F.col("y").alias("value"))
    names = fx.registry.where(F.col("series") != "5-LOW")
    final = fx.stored_history.groupBy(F.col("obs_date").alias("date"), "series_id").agg(V.newest().alias("value"))
    macro = V.combine_roles(final.join(V.source_roles(names), "series_id"), ["date", "series"])
    macro = macro.select("date", F.lit("macro").alias("source"), "series", "value")
    out = V.realtime_features(curve.unionByName(macro), vpanels(fx), fdates(fx), names, FIRST, fx.last_month)
    return out.withColumn("value", C.rnd("value"))


@query("latest_refit", """
    WITH r AS (SELECT seed, date FROM (SELECT seed, date, row_number() OVER (PARTITION BY seed ORDER BY date) - 1 AS i FROM (SELECT DISTINCT seed, date FROM fx_forecast) q) z WHERE (i + seed) % 7 = 0)
    SELECT f.seed, f.date, max(r.date) AS refit_date FROM (SELECT DISTINCT seed, date FROM fx_forecast) f LEFT JOIN r ON r.seed = f.seed AND r.date <= f.date GROUP BY 1,2""", "fx_forecast")
def q_refit(fx):
    cells = fx.forecast.select("seed", "date").distinct()
    i = F.row_number().over(by_date(["seed"])) - 1
    refits = cells.withColumn("i", i).where((F.col("i") + F.col("seed")) % 7 == 0).select("seed", "date")
    return P.latest_at_or_before(refits, cells, ["seed"], "date", []).withColumnRenamed("date_found", "refit_date")


@query("paired_gain", """
    SELECT a.date, a.maturity, a.y_hat AS y_a, b.y_hat AS y_b, round(a.y_hat - b.y_hat, 10) + 0 AS gain
    FROM fx_models a LEFT JOIN fx_models b ON b.date = a.date AND b.maturity = a.maturity AND b.model = 'm1' WHERE a.model = 'm0'""", "fx_models")
def q_gain(fx):
    from ..operators.scoring import paired_gain

    return paired_gain(fx.models, ["date", "maturity"], "model", "m0", "m1", "y_hat").select(
        "date", "maturity", F.col("a").alias("y_a"), F.col("b").alias("y_b"), C.rnd("gain", 10).alias("gain"))


@query("topk_semi", """
    WITH m AS (SELECT feature, avg(abs(shap_value)) AS v FROM fx_attr GROUP BY 1),
         t AS (SELECT feature FROM (SELECT feature, row_number() OVER (ORDER BY round(v, 9) DESC, feature) AS rn FROM m) q WHERE rn <= 20)
    SELECT date, maturity, seed, feature, shap_value FROM fx_attr WHERE feature IN (SELECT feature FROM t)""", "fx_attr")
def q_topk_semi(fx):
    from ..operators.attribution import keep_top_features

    return keep_top_features(fx.attr, 20)
