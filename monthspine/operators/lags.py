"""Per-series publication lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.calendar import shift_months
from ..functions.columns import clean_text, json_int_map
from ..functions.literal import literal_rows

POLICY_SCHEMA = "series string, lag_mode string, lag_months int, lag_schedule string"
SCHEDULED = "decision_month_schedule"


def default_policies(spark: SparkSession) -> DataFrame:
    """The table of known lags; series not in it have ``DEFAULT_LAG``."""
    fixed = [(s, "fixed", n, "") for s, n in fv.FIXED_LAGS.items()]
    timed = [(s, SCHEDULED, fv.DEFAULT_LAG, j) for s, j in fv.SCHEDULED_LAGS.items()]
    return literal_rows(spark, fixed + timed, POLICY_SCHEMA)


def resolve_policies(series: DataFrame, table: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """One policy per series: registry row over known table over default, field by field."""
    layers = [table] if registry is None else [registry, table]
    out = series.select("series").distinct()
    for i, layer in enumerate(layers):
        out = out.join(
            layer.select(
                "series",
                F.nullif(clean_text("lag_mode"), F.lit("")).alias(f"_mode{i}"),
                F.col("lag_months").alias(f"_months{i}"),
                F.nullif(clean_text("lag_schedule"), F.lit("")).alias(f"_schedule{i}"),
            ),
            "series", "left",
        )
    pick = lambda stem, default: F.coalesce(*[F.col(f"{stem}{i}") for i in range(len(layers))], F.lit(default))
    return out.select(
        "series",
        pick("_mode", "fixed").alias("lag_mode"),
        pick("_months", fv.DEFAULT_LAG).alias("lag_months"),
        pick("_schedule", "").alias("lag_schedule"),
    )


def lag_in_force(decision: Column | str, mode: Column | str = "lag_mode", months: Column | str = "lag_months", schedule: Column | str = "lag_schedule") -> Column:
    """Months of lag at a decision date: the schedule's entry for its month, else the fixed lag."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    timed = F.try_element_at(json_int_map(schedule), F.month(c(decision)).cast("string"))
    return F.coalesce(F.when(c(mode) == SCHEDULED, timed), c(months), F.lit(fv.DEFAULT_LAG))


def apply_publication_lag(panel: DataFrame, policies: DataFrame) -> DataFrame:
    """value(d) = source(d - lag), looked up among the series' own months; NULL where none exists."""
    months = F.map_from_entries(F.collect_list(F.struct("date", "value")))
    own = panel.groupBy("series").agg(months.alias("_m")).join(policies, "series", "left")
    asked = own.select("*", F.explode(F.map_keys("_m")).alias("date")).withColumn("lag", lag_in_force("date"))
    return asked.select("series", "date", "lag", F.try_element_at("_m", shift_months("date", -F.col("lag"))).alias("value"))
