"""Queries: files written from the driver tables and read back by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import columns as C
from ..operators import scoring as S
from ..session import ensure_checkpoint_dir
from ..sources import curves as CU
from ..sources import panels as P
from ..sources import sinks as K
from .fixtures import Fixtures
from .panel_queries import tcode_of
from .registry import query
from .scoring_queries import r2_sql, rounded, rw

def folder(fx: Fixtures, name: str) -> str:
    """A new folder inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(fx.spark)}/{name}-{uuid.uuid4().hex}"


@query("wide_csv_to_long", """
    SELECT last_day(p.date - to_months(1)) AS date, p.series, p.value, CAST((CAST(substr(p.series,1,1) AS INTEGER) + ascii(right(p.series,1))) % 7 + 1 AS INTEGER) AS tcode FROM fx_panel p""", "fx_panel")
def q_wide_csv(fx):
    path = folder(fx, "wide")
    wide = fx.panel.groupBy(F.date_format(F.trunc("date", "MM"), "M/d/yyyy").alias("date")).pivot("series").agg(F.max("value"))
    series = wide.columns[1:]
    text = wide.select("date", *[F.col(f"`{s}`").cast("string").alias(s) for s in series])
    names = fx.rows([(s,) for s in series], "series string").select("series", tcode_of().cast("string").alias("code"))
    codes = names.groupBy(F.lit("Transform:").alias("date")).pivot("series", series).agg(F.max("code"))
    codes.unionByName(text).write.option("header", True).csv(path)
    values, found = P.read_wide_csv(fx.spark, path)
    return values.where(F.col("value").isNotNull()).join(found, "series").select("date", "series", "value", "tcode")


@query("vintage_archive_scan", """
    SELECT vintage_month, date, CASE series_id WHEN '5-LOW' THEN 'low' ELSE series_id END AS series, value FROM fx_archive""", "fx_archive")
def q_archive_scan(fx):
    path = folder(fx, "archive")
    month = F.date_format("vintage_month", "yyyy-MM").alias("vintage")
    wide = fx.archive.groupBy(month, F.date_format(F.trunc("date", "MM"), "M/d/yyyy").alias("sasdate")).pivot("series_id").agg(F.max("value"))
    wide.repartition("vintage").write.option("header", True).partitionBy("vintage").csv(path)
    read = P.read_vintage_archive(fx.spark, path, r"vintage=(\d{4}-\d{2})/", aliases={"5-LOW": "low"})
    return read.where(F.col("value").isNotNull())


@query("collect_runs", """
    SELECT model AS run_name, CASE WHEN maturity < 48 THEN '20240101_000000' ELSE '20240202_000000' END AS run_timestamp, CAST(maturity AS VARCHAR) AS maturity, CAST(count(*) AS VARCHAR) AS n
    FROM fx_models GROUP BY 1,2,3""", "fx_models")
def q_runs(fx):
    path = folder(fx, "runs")
    stamp = F.when(F.col("maturity") < 48, "20240101_000000").otherwise("20240202_000000")
    out = fx.models.groupBy(F.col("model").alias("run"), stamp.alias("stamp"), "maturity").agg(F.count("*").alias("n"))
    out.repartition("run", "stamp").write.option("header", True).partitionBy("run", "stamp").csv(path)
    return P.collect_runs(fx.spark, path, ["maturity", "n"], r"run=([^/]+)/stamp=([^/]+)/[^/]+$")


@query("append_results", f"SELECT 'first' AS batch, q.* FROM ({r2_sql('maturity', 'fx_rw')}) q UNION ALL SELECT 'second', q.* FROM ({r2_sql('maturity', 'fx_rw')}) q", "fx_rw")
def q_append(fx):
    path = folder(fx, "results")
    scores = rounded(rw(fx).groupBy("maturity").agg(S.r2(S.both()).alias("r2"), F.count(F.when(S.both(), 1)).alias("n")), r2=6)
    for batch in ["first", "second"]:
        K.append_results(scores.withColumn("batch", F.lit(batch)), path, ["batch"])
    return K.read_table(fx.spark, path)


@query("resume_anti_join", "SELECT date, maturity FROM fx_curve WHERE NOT (date < DATE '1999-01-31' AND maturity < 60)", "fx_curve")
def q_resume(fx):
    path = folder(fx, "done")
    part = fx.curve.where((F.col("date") < "1999-01-31") & (F.col("maturity") < 60))
    K.write_dates(part, path)
    return K.pending(fx.curve.select("date", "maturity"), K.read_table(fx.spark, path), ["date", "maturity"])


# ---- curve files, registry files, balanced panels, table sets -----------------------------------


def text_file(rows: DataFrame, head: list[str], cells: list, path: str) -> None:
    """One text file: the head lines, then a line per month in order. A curve has twelve rows a year."""
    body = rows.select(F.col("date").cast("string").alias("k"), F.concat_ws(",", *cells).alias("line"))
    top = rows.sparkSession.createDataFrame([(f" {i:03d}", line) for i, line in enumerate(head)], "k string, line string")
    top.unionByName(body).coalesce(1).sortWithinPartitions("k").select("line").write.text(path)


@query("curve_files", """
    SELECT kind, date, maturity, round(y, 10) + 0 AS y FROM fx_curve, (SELECT unnest(['kr', 'lw', 'gsw']) AS kind) k""", "fx_curve")
def q_curve_files(fx):
    path, months = folder(fx, "curves"), list(range(12, 85, 12))
    wide = fx.curve.groupBy("date").pivot("maturity", months).agg(F.max("y"))
    plain = [F.coalesce(F.col(f"`{m}`").cast("string"), F.lit("")) for m in months]
    percent = [F.coalesce((100.0 * F.col(f"`{m}`")).cast("string"), F.lit("")) for m in months]
    day = F.date_format("date", "yyyy-MM-dd")
    text_file(wide, [",".join(["date", *map(str, months)])], [day, *plain], f"{path}/kr")
    names = ["yyyymm", *[f"{m}m" for m in months]]
    text_file(wide, ["% yields", "% in percent", ",".join(names)], [F.date_format("date", "yyyyMM"), *percent], f"{path}/lw")
    names = ["Date", *[f"SVENY{m // 12:02d}" for m in months]]
    text_file(wide, [f"Note {i}" for i in range(9)] + [",".join(names)], [day, *percent], f"{path}/gsw")
    out = None
    for kind in ("kr", "lw", "gsw"):
        read = CU.read_curve(fx.spark, f"{path}/{kind}", kind, "1900-01-31", "2199-12-31", months)
        part = read.select(F.lit(kind).alias("kind"), "date", "maturity", C.rnd("y", 10).alias("y"))
        out = part if out is None else out.unionByName(part)
    return out


@query("registry_read", """
    SELECT r.series, r.kind, r.target, r.num, r.den, r.rule, r.lag_mode, r.lag_months, r.lag_schedule, r.tcode, concat('class "', r.grp, '", n ', CAST(p.n AS VARCHAR)) AS revision_class
    FROM fx_registry r JOIN (SELECT grp, count(*) AS n FROM fx_panel GROUP BY 1) p ON p.grp = coalesce(r.target, r.num)""", "fx_registry fx_panel")
def q_registry_read(fx):
    """The registry with the number of months each history has, written as a file and read back."""
    path = folder(fx, "registry")
    months = fx.panel.groupBy(F.col("grp").alias("_g")).agg(F.count("*").alias("n"))
    r = fx.registry.join(months, F.coalesce("target", "num") == F.col("_g"))
    known = {
        "mnemonic_hs": "series", "tcode_hs": "tcode", "construction_type": "kind", "target_series_id": "target", "pub_lag_mode": "lag_mode",
        "pub_lag_months": "lag_months", "pub_lag_schedule_json": "lag_schedule", "release_rule": "rule",
    }
    parts = F.when(F.col("num").isNotNull(), F.to_json(F.array("num", "den"))).otherwise("[]")
    made = {"component_series_ids": parts, "revision_class": F.concat(F.lit('class "'), F.col("grp"), F.lit('", n '), F.col("n").cast("string"))}
    columns = [made.get(c, F.col(known[c]) if c in known else F.lit("")).cast("string").alias(c) for c in fv.REGISTRY_COLUMNS]
    r.select(*columns).write.option("header", True).option("escape", '"').csv(path)
    return P.read_registry(fx.spark, path)


@query("balanced_csv", "SELECT date, series, value FROM fx_panel WHERE date BETWEEN DATE '1996-01-31' AND DATE '1998-12-31'", "fx_panel")
def q_balanced_csv(fx):
    path = folder(fx, "balanced")
    wide = fx.panel.groupBy(F.col("date").cast("string").alias("decision_date")).pivot("series").agg(F.max("value"))
    wide.select("decision_date", *[F.col(f"`{s}`").cast("string").alias(s) for s in wide.columns[1:]]).write.option("header", True).csv(path)
    return P.read_balanced_csv(fx.spark, path, "1996-01-31", "1998-12-31").where(F.col("value").isNotNull())


@query("table_set", """
    SELECT 'curve' AS name, CAST(maturity AS VARCHAR) AS key, date, round(y, 10) + 0 AS value FROM fx_curve
    UNION ALL SELECT 'panel', series, date, round(value, 2) + 0 FROM fx_panel""", "fx_curve fx_panel")
def q_table_set(fx):
    path = folder(fx, "tables")
    curve = fx.curve.select(F.col("maturity").cast("string").alias("key"), "date", C.rnd("y", 10).alias("value"))
    K.write_tables({"curve": curve, "panel": fx.panel.select(F.col("series").alias("key"), "date", C.rnd("value", 2).alias("value"))}, path)
    read = lambda name: K.read_table(fx.spark, f"{path}/{name}").select(F.lit(name).alias("name"), "key", "date", "value")
    return read("curve").unionByName(read("panel"))
