"""Group labels of series and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.literal import literal_rows
from .transforms import zscore


def attach_group(df: DataFrame, mapping: DataFrame, default: str | None = None, series: str = "series") -> DataFrame:
    """Add ``grp`` from (series, grp) rows. Without a default an unmapped series fails the query."""
    out = df.join(mapping.select(F.col("series").alias(series), "grp"), series, "left")
    if default is not None:
        return out.withColumn("grp", F.coalesce("grp", F.lit(default)))
    lost = F.raise_error(F.concat(F.lit("series without a group: "), F.col(series).cast("string"))).cast("string")
    return out.withColumn("grp", F.when(F.col("grp").isNotNull(), F.col("grp")).otherwise(lost))


def mapping_gaps(df: DataFrame, mapping: DataFrame, series: str = "series") -> DataFrame:
    """Series without a group and mapping rows without a series."""
    have = df.select(F.col(series).alias("series")).distinct()
    return (
        have.join(mapping, "series", "left_anti").select("series", F.lit("unmapped").alias("problem"))
        .unionByName(mapping.join(have, "series", "left_anti").select("series", F.lit("unused").alias("problem")))
    )


def full_mapping(macro: DataFrame, forwards: DataFrame, yields: DataFrame) -> DataFrame:
    """Mapping of macro series (the fixed grouping), forward rates and yields, each one group."""
    spark = macro.sparkSession
    known = literal_rows(spark, fv.series_groups(), "series string, grp string")
    block = lambda d, g: d.select(F.col("series").cast("string").alias("series")).distinct().withColumn("grp", F.lit(g))
    grouped = attach_group(macro.select("series").distinct(), known)
    return grouped.unionByName(block(forwards, fv.FORWARD_GROUP)).unionByName(block(yields, fv.YIELD_GROUP))


def group_codes(columns: DataFrame, position: str = "position", group: str = "grp") -> DataFrame:
    """Integer group codes in first-seen order plus the positions of each group's columns.

    ``columns`` is a column list (one row per series), bounded by the registry.
    """
    firsts = columns.groupBy(group).agg(
        F.min(position).alias("_first"), F.array_sort(F.collect_list(position)).alias("positions")
    )
    return firsts.select(
        group, (F.row_number().over(Window.orderBy("_first")) - 1).alias("code"), "positions"
    )


def coarse_composite(df: DataFrame, mapping: DataFrame, series: str = "series") -> DataFrame:
    """Equal-weight composite per coarse group; series whose group is not mapped are left out."""
    mapped = df.join(mapping.select("grp", "coarse"), "grp")
    z = F.coalesce(zscore("value", [series]), F.lit(0.0))
    return mapped.withColumn("_z", z).groupBy("date", "coarse").agg(F.avg("_z").alias("value"))
