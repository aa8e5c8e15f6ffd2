"""Series registry: which history each series is read from, built from rules."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.columns import clean_text, json_list
from ..functions.literal import literal_rows
from .lags import resolve_policies

RULE_SCHEMA = "series string, step int, kind string, target string, components string, formula string, revision_class string, notes string"


def rule_rows(
    never_revised: list[str] = tuple(fv.NEVER_REVISED), aliases: dict[str, str] = fv.DIRECT_ALIASES,
    unrevised_sources: dict[str, str] = fv.DIRECT_UNREVISED_SOURCE,
    ratios: dict[str, tuple[str, str]] = fv.RATIO_SERIES, local_only: list[str] = tuple(fv.LOCAL_ONLY),
) -> list[tuple]:
    """Overrides as rows; where several touch a field, the later step wins."""
    listed = lambda xs: json.dumps(list(xs), separators=(",", ":"))
    return (
        [(s, 1, None, None, None, None, "market_effectively_nonrevised", None) for s in never_revised]
        + [(s, 2, None, t, None, None, None, "alias of another history") for s, t in aliases.items()]
        + [(s, 3, "direct_fred", t, None, None, None, "source without vintages") for s, t in unrevised_sources.items()]
        + [(s, 4, "derived_formula", "", listed(c), " / ".join(c), "component_revisions", "ratio of two histories") for s, c in ratios.items()]
        + [(s, 5, "public_proxy", "", "[]", "", "public_proxy_only", "kept locally only") for s in local_only]
    )


def build_registry(names: DataFrame, rules: list[tuple], lags: DataFrame) -> DataFrame:
    """One row per (series, tcode) of ``names`` with its source, revision class and lag policy.

    A series without a transform code fails the query. The registry is a dimension: one row per
    series, numbered by name.
    """
    spark = names.sparkSession
    fields = ["kind", "target", "components", "formula", "revision_class", "notes"]
    won = literal_rows(spark, rules, RULE_SCHEMA).groupBy("series").agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("step"))).alias(f) for f in fields]
    )
    base = {"kind": F.lit("direct_alfred"), "target": F.col("series"), "components": F.lit("[]"),
            "formula": F.lit(""), "revision_class": F.lit("observable_revisions"), "notes": F.lit("own history")}
    code = F.when(F.col("tcode").isNotNull(), F.col("tcode")).otherwise(
        F.raise_error(F.concat(F.lit("series without transform code: "), F.col("series"))).cast("int")
    )
    out = (
        names.join(won, "series", "left")
        .join(resolve_policies(names, lags), "series")
        .select(
            F.row_number().over(Window.orderBy("series")).alias("hs_no"), F.lit(0).alias("group"), "series",
            F.col("series").alias("old_name"), F.col("series").alias("description"), code.alias("tcode"),
            F.lit(0).alias("lag_months_base"),
            *[F.coalesce(F.col(f), d).alias(f) for f, d in base.items()],
            "lag_mode", "lag_months", "lag_schedule", F.lit("same_month_end").alias("rule"),
            F.lit("selected_vintage_asof_decision").alias("strict_source_rule"),
            F.lit("strict_asof_then_release_gap_then_pre_vintage_then_proxy").alias("balanced_source_rule"),
        )
    )
    return out.withColumn("vintage_flag", F.when(F.col("kind") == "direct_alfred", "Y").otherwise("N"))


def series_ids(registry: DataFrame, target: str = "target", components: str = "components") -> DataFrame:
    """Distinct history ids a registry reads: targets and listed components."""
    direct = registry.select(clean_text(target).alias("series_id")).where(F.col("series_id") != "")
    listed = registry.select(F.explode(json_list(components)).alias("series_id"))
    return direct.union(listed).distinct()
