"""Correlations over time: with the own lag, and between series."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from .transforms import by_date


def ar1(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Correlation of each series with its previous row, over rows where both are known."""
    d = df.select(*keys, F.col(value).alias("x"), F.lag(value).over(by_date(keys)).alias("l"))
    pair = F.col("x").isNotNull() & F.col("l").isNotNull()
    x, lag = F.when(pair, F.col("x")), F.when(pair, F.col("l"))
    corr = ratio(F.covar_pop(x, lag), F.stddev_pop(x) * F.stddev_pop(lag))
    return d.groupBy(*keys).agg(F.count(x).alias("n_pairs"), corr.alias("_c")).select(
        *keys, "n_pairs", F.when(F.col("n_pairs") >= 2, F.col("_c")).alias("ar1")
    )


def top(df: DataFrame, value: str, n: int, key: str = "series") -> DataFrame:
    return df.where(F.col(value).isNotNull()).orderBy(F.round(value, 9).desc(), key).limit(n)


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row."""
    q = lambda p: F.percentile(value, F.lit(p))
    return df.agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max(value).alias("max"),
    )


def return_stats(df: DataFrame, keys: list[str], value: str, annualize: bool = False, percent: bool = True, excess: bool = False, per_year: float = 12.0) -> DataFrame:
    """Mean, deviation, sample skewness and kurtosis, and lag-1 correlation of returns."""
    rows = df.where(F.col(value).isNotNull())
    x = F.col(value)
    g = rows.groupBy(*keys).agg(
        F.count("*").cast("double").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("_g1"), F.kurtosis(x).alias("_g2"),
    ).join(ar1(rows, keys, value).select(*keys, F.col("ar1").alias("acf1")), keys)
    n = F.col("n")
    skew = F.when(n > 2, F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("_g2") + 6)) + (0.0 if excess else 3.0)
    by = 100.0 if percent else 1.0
    return g.select(
        *keys, (F.col("mean") * (by * (per_year if annualize else 1.0))).alias("mean"),
        (F.col("std") * (by * (per_year**0.5 if annualize else 1.0))).alias("std"),
        skew.alias("skew"), kurt.alias("kurt"), "acf1",
    )


# ---- matrices ---------------------------------------------------------------------------------


def _inversions(ranks: np.ndarray) -> int:
    """Pairs out of order (strictly), by bottom-up merging with one search per level."""
    n = len(ranks)
    size = 1 << max(0, (n - 1).bit_length())
    top_rank = int(ranks.max()) + 1 if n else 0
    a = np.concatenate([ranks.astype(np.int64), np.full(size - n, top_rank, dtype=np.int64)])
    total, width = 0, 1
    while width < size:
        rows = a.reshape(-1, 2, width)
        offset = (np.arange(len(rows), dtype=np.int64) * (top_rank + 1))[:, None]
        left = (rows[:, 0, :] + offset).ravel()
        at = np.searchsorted(left, (rows[:, 1, :] + offset).ravel(), side="right").reshape(len(rows), width)
        total += int((width - (at - np.arange(len(rows))[:, None] * width)).sum())
        a = np.sort(a.reshape(-1, 2 * width), axis=1).ravel()
        width *= 2
    return total


def _tied_pairs(codes: np.ndarray) -> int:
    c = np.unique(codes, return_counts=True)[1].astype(np.int64)
    return int((c * (c - 1) // 2).sum())


def kendall_tau_b(x: np.ndarray, y: np.ndarray) -> float | None:
    """Kendall's tau-b in O(n log n): order by (x, y) and count the inversions of y."""
    n = len(x)
    rx, ry = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    pairs, tx, ty = n * (n - 1) // 2, _tied_pairs(rx), _tied_pairs(ry)
    if pairs == tx or pairs == ty:
        return None
    txy = _tied_pairs(rx.astype(np.int64) * (int(ry.max()) + 1) + ry)
    swaps = _inversions(ry[np.lexsort((ry, rx))])
    return (pairs - tx - ty + txy - 2 * swaps) / float(np.sqrt(float(pairs - tx)) * np.sqrt(float(pairs - ty)))


def pearson(x: np.ndarray, y: np.ndarray) -> float | None:
    dx, dy = x - x.mean(), y - y.mean()
    den = float(np.sqrt((dx * dx).sum()) * np.sqrt((dy * dy).sum()))
    return float((dx * dy).sum()) / den if den > 0 else None


METHODS: dict[str, Callable] = {"kendall": kendall_tau_b, "pearson": pearson}

#: Items of one block: a task holds two blocks of monthly series.
BLOCK_ITEMS = 64


def pearson_blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common months, correlation) of all columns of x with all of y, NaN where missing, from masked products."""
    mx, my = (~np.isnan(v) for v in (x, y))
    # correlations do not change with the origin: centred columns lose no digits in the sums
    cx, cy = (np.where(m, v - np.where(m, v, 0).sum(0) / np.maximum(m.sum(0), 1), 0.0) for v, m in ((x, mx), (y, my)))
    mx, my = mx.astype(float), my.astype(float)
    n = mx.T @ my
    sx, sy = cx.T @ my, mx.T @ cy
    some = np.maximum(n, 1)
    vx, vy = (cx**2).T @ my - sx**2 / some, mx.T @ cy**2 - sy**2 / some
    flat = (vx <= 1e-13 * ((cx**2).T @ my)) | (vy <= 1e-13 * (mx.T @ cy**2)) | (vx <= 0) | (vy <= 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, np.where(flat, np.nan, (cx.T @ cy - sx * sy / some) / np.sqrt(vx * vy))


def kendall_blocks(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common months, tau-b) of all columns of x with all of y: one product of signs for each distance between months."""
    mx, my = (~np.isnan(v) for v in (x, y))
    n = mx.astype(float).T @ my.astype(float)
    score, by_x, by_y = (np.zeros(n.shape) for _ in range(3))
    for gap in range(1, len(x)):
        both_x, both_y = mx[gap:] & mx[:-gap], my[gap:] & my[:-gap]
        sign_x = np.where(both_x, np.sign(x[gap:] - x[:-gap]), 0.0)
        sign_y = np.where(both_y, np.sign(y[gap:] - y[:-gap]), 0.0)
        score += sign_x.T @ sign_y
        by_x += np.abs(sign_x).T @ both_y.astype(float)
        by_y += both_x.astype(float).T @ np.abs(sign_y)
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, np.where((by_x > 0) & (by_y > 0), score / (np.sqrt(by_x) * np.sqrt(by_y)), np.nan)


BLOCKWISE: dict[str, Callable] = {"kendall": kendall_blocks, "pearson": pearson_blocks}


def association(df: DataFrame, keys: list[str], item: str, value: str, method: str, min_periods: int = 1, blocks: int | None = None) -> DataFrame:
    """Correlation matrix of the items of each key (keys, a, b, n, corr) over common dates.

    Items are hashed into blocks and each pair of blocks is one task holding two blocks of monthly series; a value is
    repeated once per block, not once per partner. A task takes all its pairs at once, in matrix products. The rows produced
    are the matrix itself. There are as many blocks as the items of the largest key need, unless ``blocks`` says.
    """
    rule = BLOCKWISE[method]
    names = [f"_k{i}" for i in range(len(keys))]
    fields = df.select(*keys).schema.fields
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    known = df.where(F.col(value).isNotNull())
    if blocks is None:
        per_key = known.groupBy(*keys).agg(F.countDistinct(item).alias("n"))
        number = F.greatest(F.lit(1), F.coalesce(per_key.select(F.ceil(F.max("n") / BLOCK_ITEMS).cast("int")).scalar(), F.lit(1)))
    else:
        number = F.lit(blocks)
    cells = known.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(item).cast("string").alias("item"),
        F.unix_date("date").alias("t"), F.col(value).cast("double").alias("v"),
        F.pmod(F.xxhash64(F.col(item).cast("string")), number).cast("int").alias("blk"),
    )
    other = F.explode(F.sequence(F.lit(0), number - 1))
    placed = cells.withColumn("o", other).withColumn("ba", F.least("blk", "o")).withColumn("bb", F.greatest("blk", "o")).drop("o")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ba, bb = key[-2:]
        wide = pdf.pivot_table(index="t", columns="item", values="v", aggfunc="first")
        of = pdf.drop_duplicates("item").set_index("item")["blk"].reindex(wide.columns).to_numpy()
        a, b = (np.flatnonzero(of == k) for k in (ba, bb))
        cells = wide.to_numpy()
        n, corr = rule(cells[:, a], cells[:, b])
        corr = np.where(n >= max(min_periods, 2), corr, np.nan)
        i, j = np.nonzero((a[:, None] < b[None, :]) if ba == bb else np.ones(n.shape, bool))
        items = wide.columns.to_numpy()
        half = pd.DataFrame({"a": items[a[i]], "b": items[b[j]], "n": n[i, j].astype(np.int64), "corr": corr[i, j]})
        out = pd.concat([half, half.rename(columns={"a": "b", "b": "a"})], ignore_index=True)
        for k, v in zip(keys, key):
            out[k] = v
        out["corr"] = out["corr"].astype(object).where(out["corr"].notna(), None)
        return out[[*keys, "a", "b", "n", "corr"]]

    return placed.groupBy(*names, "ba", "bb").applyInPandas(run, f"{head}a string, b string, n long, corr double")


def abs_corr_summary(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Off-diagonal strength: mean, median and maximum of |corr| and shares above 0.5 and 0.7."""
    v = F.abs("corr")
    share = lambda x: F.avg(F.when(F.col("corr").isNotNull(), (v > x).cast("int")))
    return matrix.groupBy(*keys).agg(
        F.countDistinct("a").alias("n_items"), F.avg(v).alias("mean_abs"), F.median(v).alias("median_abs"), F.max(v).alias("max_abs"),
        share(0.5).alias("share_over_50"), share(0.7).alias("share_over_70"),
    )


def paired(df: DataFrame, keys: list[str], x: str, y: str, method: str, min_periods: int = 3) -> DataFrame:
    """Correlation of two columns per key; each key's months are one small array pair."""
    rule = METHODS[method]
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    fields = df.select(*keys).schema.fields
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = rule(pdf["x"].to_numpy(), pdf["y"].to_numpy()) if len(pdf) >= min_periods else None
        return pd.DataFrame([(*key, len(pdf), c)], columns=[*keys, "n", "corr"])

    cols = [F.col(k) for k in keys] + [F.col(x).alias("x"), F.col(y).alias("y")]
    return both.select(*cols).groupBy(*keys).applyInPandas(run, f"{head}n long, corr double")
