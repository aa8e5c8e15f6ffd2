"""Yield-curve arithmetic on long curves (date, maturity in months, y)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def log_price(maturity: Column | str, y: Column | str) -> Column:
    m = F.col(maturity) if isinstance(maturity, str) else maturity
    v = F.col(y) if isinstance(y, str) else y
    return -(m / F.lit(12.0)) * v


def forward_rates(curve: DataFrame, step: int = 12, longest: int = 120) -> DataFrame:
    """Forward rate between maturity - step and maturity, at whole-year maturities.

    A maturity of ``step`` needs no shorter yield: a matured bond is worth one.
    """
    exact = Window.partitionBy("date").orderBy("maturity").rangeBetween(-step, -step)
    shorter = F.when(F.col("maturity") == step, F.lit(0.0)).otherwise(
        F.max(log_price("maturity", "y")).over(exact)
    )
    rates = curve.withColumn("fwd", shorter - log_price("maturity", "y"))
    return rates.where((F.col("maturity") % 12 == 0) & F.col("maturity").between(12, longest)).select(
        "date", "maturity", "fwd"
    )


def _quoted(curve: DataFrame, horizon: int) -> Column:
    """All quoted maturities as one scalar array; the query fails when no excess return can be formed from them."""
    ms = F.col("ms")
    pair = F.exists(ms, lambda m: (m > horizon) & F.array_contains(ms, m - horizon))
    checked = (
        F.when(~F.array_contains(ms, horizon), F.raise_error(F.lit(f"the {horizon}-month yield is missing")).cast("array<int>"))
        .when(~pair, F.raise_error(F.lit(f"no maturity pair (m, m-{horizon}) in the curve")).cast("array<int>"))
        .otherwise(ms)
    )
    return curve.agg(F.collect_set(F.col("maturity").cast("int")).alias("ms")).select(checked).scalar()


def excess_returns(curve: DataFrame, horizon: int = 12, longest: int = 120) -> DataFrame:
    """Return from holding maturity m for ``horizon`` months over the riskless yield.

    Dated at purchase; NULL while the sale lies beyond the sample. Whole-year maturities whose residual maturity is also
    quoted; the query fails when there is none. Month plus maturity names a bond, whose later price is in its own rows.
    """
    month = F.year("date") * 12 + F.month("date")
    bond = Window.partitionBy(month + F.col("maturity")).orderBy(month).rangeBetween(horizon, horizon)
    day = Window.partitionBy("date")
    price = log_price("maturity", "y")
    priced = curve.select(
        "date",
        "maturity",
        price.alias("lp"),
        F.max(price).over(bond).alias("lp_sale"),
        (F.lit(horizon / 12.0) * F.max(F.when(F.col("maturity") == horizon, F.col("y"))).over(day)).alias("rf"),
    )
    residual = (F.col("maturity") - horizon).cast("int")
    held = priced.where((F.col("maturity") > horizon) & (F.col("maturity") % 12 == 0) & (F.col("maturity") <= longest))
    return held.where(F.array_contains(_quoted(curve, horizon), residual)).select(
        "date", "maturity", (F.col("lp_sale") - F.col("lp") - F.col("rf")).alias("rx")
    )


def require_maturities(curve: DataFrame, horizon: int) -> None:
    """Fail now when no excess return can be formed for ``horizon``."""
    ms = set(curve.agg(F.collect_set("maturity").alias("ms")).first()["ms"])
    if horizon not in ms:
        raise ValueError(f"the {horizon}-month yield is missing")
    if not any(m > horizon and m - horizon in ms for m in ms):
        raise ValueError(f"no maturity pair (m, m-{horizon}) in the curve")
