"""Random forests refit month by month, every tree dealt out by Spark.

A row of work is (target, refit, span of trees) with the months that refit may train on: at most one per month of the
calendar. Trees of a span grow side by side, level by level, on histograms of their bootstrap counts over the sorted
months. A tree of depth 5 holds its shallower versions, and a forest of 1000 trees its smaller ones, so tuning grows the
largest forest of each leaf size once and reads off all settings. Sums over spans are put together by Spark; no fit
reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linear
from .walkforward import Design, origins

#: Trees of one row of work.
SPAN = 250
#: Trees that grow side by side: bounds the histograms in memory.
ABREAST = 50
#: Splits whose gains differ by less than this share of a node's sum of squares are equally good.
EQUAL = 1e-9


@dataclass(frozen=True)
class Grid:
    """Settings tried, in trial order: trees outermost, leaf sizes innermost. The first of each is the default."""

    trees: tuple[int, ...] = (200, 500, 1000)
    depths: tuple[int, ...] = (2, 3, 5)
    leaves: tuple[int, ...] = (1, 5)

    def settings(self) -> list[tuple[int, int, int]]:
        return list(product(self.trees, self.depths, self.leaves))

    def spans(self) -> list[tuple[int, int]]:
        """Spans of tree numbers; every forest size is the end of one."""
        out, low = [], 0
        for size in sorted(set(self.trees)):
            while low < size:
                out.append((low, min(low + SPAN, size)))
                low = out[-1][1]
        return out


# ---- trees of one span ----------------------------------------------------------------------------


def bootstrap(n: int, low: int, high: int, seed: int) -> np.ndarray:
    """How often each of n months is drawn for the trees low .. high - 1; a tree's draws depend on its number alone."""
    draws = [np.random.default_rng([seed, tree]).integers(0, n, n) for tree in range(low, high)]
    return np.array([np.bincount(d, minlength=n) for d in draws], np.float64).reshape(high - low, n)


@dataclass
class Trees:
    """Trees as heaps: the children of node k are 2 k + 1 and 2 k + 2; a node without feature (-1) is a leaf."""

    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray, depth: int) -> np.ndarray:
        """(tree, row) means of the nodes the rows reach within ``depth`` splits."""
        t = np.arange(len(self.feature))[:, None]
        at = np.zeros((len(self.feature), len(x)), np.int64)
        for _ in range(depth):
            f = self.feature[t, at]
            right = x[np.arange(len(x))[None, :], np.maximum(f, 0)] > self.edge[t, at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return self.value[t, at]


def grow(x: np.ndarray, y: np.ndarray, counts: np.ndarray, depth: int, leaf: int) -> Trees:
    """Least-squares trees on all features, one per row of ``counts`` (how often each month is drawn).

    ``leaf`` counts different months. Of equally good splits the first feature's lowest wins; edges lie midway between
    the months on either side.
    """
    trees, n = counts.shape
    width = x.shape[1]
    order = np.argsort(x, axis=0, kind="stable").T
    ordered = np.take_along_axis(x.T, order, 1)
    apart = ordered[:, :-1] < ordered[:, 1:]
    shift = y.mean()
    y = y - shift
    feature = np.full((trees, 2**depth - 1 if depth else 0), -1)
    edge = np.zeros(feature.shape)
    value = np.zeros((trees, 2 ** (depth + 1) - 1))
    node = np.zeros((trees, n), np.int64)
    place = np.arange(n)
    for k in range(value.shape[1]):
        inside = (node == k) & (counts > 0)
        live = np.flatnonzero(inside.any(1))
        if not len(live):
            continue
        inside, w = inside[live], np.where(inside, counts, 0.0)[live]
        total, mass = w.sum(1), w @ y
        value[live, k] = mass / total
        if k >= feature.shape[1]:
            continue
        seen = np.where(inside, y, np.nan)
        mixed = np.nanmax(seen, 1) > np.nanmin(seen, 1)
        live, inside, w, total, mass = live[mixed], inside[mixed], w[mixed], total[mixed], mass[mixed]
        if not len(live):
            continue
        left = np.cumsum(w[:, order], 2)[:, :, :-1]
        left_mass = np.cumsum((w * y)[:, order], 2)[:, :, :-1]
        months = np.cumsum(inside[:, order], 2)[:, :, :-1]
        right, right_mass = total[:, None, None] - left, mass[:, None, None] - left_mass
        fits = apart[None] & (months >= leaf) & (inside.sum(1)[:, None, None] - months >= leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, left_mass**2 / left + right_mass**2 / right, -np.inf)
        gain = gain.reshape(len(live), width * (n - 1))
        tie = EQUAL * (w @ y**2)
        best = (gain >= (gain.max(1) - tie)[:, None]).argmax(1)
        found = fits.reshape(len(live), -1)[np.arange(len(live)), best]
        live, inside, best = live[found], inside[found], best[found]
        f, at = best // (n - 1), best % (n - 1)
        there = np.take_along_axis(inside, order[f], 1)
        below = np.where(there & (place <= at[:, None]), place, -1).max(1)
        above = np.where(there & (place > at[:, None]), place, n).min(1)
        cut = (ordered[f, below] + ordered[f, above]) / 2
        feature[live, k], edge[live, k] = f, cut
        goes = x[:, f].T > cut[:, None]
        node[live] = np.where(node[live] == k, 2 * k + 1 + goes, node[live])
    value += shift
    return Trees(feature, edge, value)


def span_sums(x, y, ahead, low: int, high: int, depths: list[int], leaf: int, seed: int) -> np.ndarray:
    """(depth, row) sums over the trees low .. high - 1 of their values for the rows ``ahead``."""
    out = np.zeros((len(depths), len(ahead)))
    for i in range(low, high, ABREAST):
        grown = grow(x, y, bootstrap(len(y), i, min(i + ABREAST, high), seed), max(depths), leaf)
        out += np.array([grown.predict(ahead, d).sum(0) for d in depths])
    return out


# ---- all fits ---------------------------------------------------------------------------------------


def _features(z: np.ndarray, train: np.ndarray, steps: list[tuple] | None, block: list[int], width: int) -> np.ndarray:
    """Columns of the trees: the block itself, or features of ``steps`` from the training months' moments."""
    if steps is None:
        return z[:, block]
    return z[:, :width] @ linear.feature_rows(z[train].T @ z[train], steps, width).T


def _packed(rows: DataFrame, fits: DataFrame, last: Column) -> DataFrame:
    """Each fit with its months first .. last as sorted lists: one entry per month of the calendar."""
    months = fits.withColumn("m", F.explode(F.sequence(F.col("_first"), last)))
    entry = F.sort_array(F.collect_list(F.struct("m", "date", "z")))
    return months.join(rows.select("m", "date", "z"), "m").groupBy(*fits.columns).agg(entry.alias("months"))


def _spread(work: DataFrame, keys: list[str]) -> DataFrame:
    """One task slot per few rows of work: they are small in bytes and long in time, so their number counts, not their size."""
    return work.repartition(int(work.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def forest_forecast(
    rows: DataFrame, layout: Design, block: list[int], start: str, gap: int, grid: Grid = Grid(),
    refit_every: int = 1, tune_every: int = 60, seed: int = 42, share: float = 0.85, steps: list[tuple] | None = None,
) -> DataFrame:
    """(date, target, y_hat, trees, depth, leaf): forests of all targets and months, with the setting in force.

    At every ``tune_every``-th refit the setting with the least squared error on the last 15% of the training months is
    chosen, from forests grown on those before; too short a sample takes the default. Months whose block or target is
    missing are not trained on, and count neither for the split; months whose block is missing get no forecast.
    With ``steps`` the trees see those features (principal components, say) of the refit's training months.
    """
    goals = [t for t in layout.targets if not t.startswith("_")]
    needed = sorted(set(block) | {c for s in steps or [] for c in s[1]})
    known = F.forall(F.array(*[F.get("z", F.lit(c)) for c in needed]), lambda v: v.isNotNull())
    live = rows.where(known)
    o = origins(rows, start, gap, refit_every, tune_every)
    spans = [F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in grid.spans()]
    targets = [F.struct(F.lit(g).alias("target"), F.lit(layout.target(g)).alias("t")) for g in goals]
    width, depths = layout.width, list(grid.depths)

    def arrays(months, t):
        m = np.array([e["m"] for e in months], np.int64)
        z = np.array([[np.nan if v is None else v for v in e["z"]] for e in months])
        return m, z, np.isfinite(z[:, t])

    def work(d: DataFrame, *keep: str) -> DataFrame:
        return d.withColumn("_t", F.explode(F.array(*targets))).select("*", "_t.target", "_t.t").drop("_t", *keep)

    # settings: validation errors of all of them from the largest forests
    tunes = o.select("tune_m", "_first").distinct()
    tuning = work(_packed(live, tunes, F.col("tune_m") - gap - 1)).withColumn("_s", F.explode(F.array(*spans)))
    tuning = tuning.withColumn("leaf", F.explode(F.array(*map(F.lit, grid.leaves))))
    tuning = _spread(tuning.select("tune_m", "target", "t", "months", "_s.low", "_s.high", "leaf"), ["tune_m", "target", "low", "leaf"])

    def tune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m, z, ok = arrays(r["months"], r["t"])
                n = int(ok.sum())
                cut = int(n * share)
                if cut < 10 or n - cut < 3:
                    continue
                x, y = _features(z, ok, steps, block, width)[ok], z[ok, r["t"]]
                sums = span_sums(x[:cut], y[:cut], x[cut:], r["low"], r["high"], depths, r["leaf"], seed)
                for d, line in zip(depths, sums):
                    yield pa.RecordBatch.from_pydict({
                        "tune_m": pa.array([r["tune_m"]] * (n - cut), pa.int32()), "target": [r["target"]] * (n - cut),
                        "high": pa.array([r["high"]] * (n - cut), pa.int32()), "depth": pa.array([d] * (n - cut), pa.int32()),
                        "leaf": pa.array([r["leaf"]] * (n - cut), pa.int32()), "m": pa.array(m[ok][cut:], pa.int32()), "y": y[cut:], "total": line,
                    })

    held = tuning.mapInArrow(tune, "tune_m int, target string, high int, depth int, leaf int, m int, y double, total double")
    each = ["tune_m", "target", "depth", "leaf"]
    sizes = [F.struct(F.lit(n).alias("trees"), (F.sum(F.when(F.col("high") <= n, F.col("total"))) / n).alias("y_hat")) for n in grid.trees]
    fitted = held.groupBy(*each, "m").agg(F.max("y").alias("y"), F.array(*sizes).alias("_f")).withColumn("_f", F.explode("_f"))
    errors = fitted.groupBy(*each, F.col("_f.trees").alias("trees")).agg(F.avg(F.pow(F.col("y") - F.col("_f.y_hat"), 2)).alias("mse"))
    # of equal errors the setting tried first wins
    tried = [("trees", grid.trees), ("depth", grid.depths), ("leaf", grid.leaves)]
    trial = [F.array_position(F.array(*map(F.lit, values)), F.col(c)).alias(f"_{c}") for c, values in tried]
    best = F.min(F.struct("mse", *trial, "trees", "depth", "leaf")).alias("b")
    chosen = errors.groupBy("tune_m", "target").agg(best).select("tune_m", "target", "b.trees", "b.depth", "b.leaf")

    # a tuning that had too few months keeps the setting before it, the default at first
    before = Window.partitionBy("target").orderBy("tune_m").rowsBetween(Window.unboundedPreceding, 0)
    every = work(tunes).select("tune_m", "target", "t").join(chosen, ["tune_m", "target"], "left")
    default = dict(zip(("trees", "depth", "leaf"), grid.settings()[0]))
    setting = every.select("tune_m", "target", "t", *[F.coalesce(F.last(c, ignorenulls=True).over(before), F.lit(v)).alias(c) for c, v in default.items()])

    # forecasts: spans of the chosen size only
    fits = o.select("fit_m", "tune_m", "_first").distinct()
    packed = _packed(live, fits, F.col("fit_m") + refit_every - 1).join(setting, "tune_m").withColumn("_s", F.explode(F.array(*spans)))
    packed = packed.where(F.col("_s.high") <= F.col("trees"))
    packed = _spread(packed.select("fit_m", "target", "t", "months", "trees", "depth", "leaf", "_s.low", "_s.high"), ["fit_m", "target", "low"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                m, z, ok = arrays(r["months"], r["t"])
                train, ahead = ok & (m < r["fit_m"] - gap), m >= r["fit_m"]
                k = int(ahead.sum())
                if not train.any() or not k:
                    continue
                x = _features(z, train, steps, block, width)
                sums = span_sums(x[train], z[train, r["t"]], x[ahead], r["low"], r["high"], [r["depth"]], r["leaf"], seed)[0]
                yield pa.RecordBatch.from_pydict({
                    "date": pa.array([e["date"] for e, a in zip(r["months"], ahead) if a], pa.date32()), "target": [r["target"]] * k, "total": sums,
                    **{c: pa.array([r[c]] * k, pa.int32()) for c in ("trees", "depth", "leaf")},
                })

    sums = packed.mapInArrow(fit, "date date, target string, total double, trees int, depth int, leaf int")
    out = sums.groupBy("date", "target", "trees", "depth", "leaf").agg((F.sum("total") / F.col("trees")).alias("y_hat"))
    return out.where(F.col("date") >= F.lit(start).cast("date")).select("date", "target", "y_hat", "trees", "depth", "leaf")
