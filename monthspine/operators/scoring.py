"""Out-of-sample scores. Input rows carry y, y_hat and benchmark columns; everything is one
map-side combined aggregation per score table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import shift_literal
from .transforms import upto_now


def sq(a: str, b: str) -> Column:
    return F.pow(F.col(a) - F.col(b), 2)


def both(bench: str = "bench", y: str = "y", y_hat: str = "y_hat") -> Column:
    """Rows that count for a score: forecast, benchmark and outcome all present."""
    return F.col(y_hat).isNotNull() & F.col(bench).isNotNull() & F.col(y).isNotNull()


def r2(keep: Column, bench: str = "bench", y: str = "y", y_hat: str = "y_hat") -> Column:
    """Aggregate: 1 - SSE(model)/SSE(benchmark), NULL when the benchmark makes no error."""
    sse_m = F.sum(F.when(keep, sq(y, y_hat)))
    sse_b = F.sum(F.when(keep, sq(y, bench)))
    return F.when(sse_b != 0, 1.0 - F.try_divide(sse_m, sse_b))


def oos_r2(df: DataFrame, keys: list[str], benches: list[str]) -> DataFrame:
    """R2 of every key against every benchmark (keys, benchmark, n, r2)."""
    aggs = []
    for b in benches:
        aggs += [r2(both(b), b).alias(f"r2_{b}"), F.count(F.when(both(b), 1)).alias(f"n_{b}")]
    wide = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(b).alias("benchmark"), F.col(f"n_{b}").alias("n"), F.col(f"r2_{b}").alias("r2")) for b in benches])
    return wide.select(*keys, F.explode(rows).alias("_s")).select(*keys, "_s.benchmark", "_s.n", "_s.r2")


def cssed(df: DataFrame, keys: list[str], start: str, second: str | None = None) -> DataFrame:
    """Cumulative benchmark minus model squared error from ``start``; optionally rebased to zero
    at a second date (NULL when that date is missing)."""
    gain = F.when(both(), sq("y", "bench") - sq("y", "y_hat"))
    oos = df.where(F.col("date") >= F.lit(start).cast("date")).withColumn("_g", gain)
    out = oos.withColumn("cssed", F.when(F.col("_g").isNotNull(), F.sum("_g").over(upto_now(keys)))).drop("_g")
    if second is not None:
        at = F.max(F.when(F.col("date") == F.lit(second).cast("date"), F.col("cssed"))).over(Window.partitionBy(*keys))
        out = out.withColumn("cssed_rebased", F.col("cssed") - at)
    return out


def start_grid(df: DataFrame, keys: list[str], starts: list[str], end: str) -> DataFrame:
    """R2 by out-of-sample start: one aggregation with one conditional sum per start."""
    aggs, rows = [], []
    for i, s in enumerate(starts):
        inside = F.col("date").between(F.lit(s).cast("date"), F.lit(end).cast("date"))
        aggs += [r2(both() & inside).alias(f"r{i}"), F.count(F.when(inside, 1)).alias(f"n{i}")]
        rows.append(F.struct(F.lit(s).cast("date").alias("oos_start"), F.col(f"n{i}").alias("n_eval"), F.col(f"r{i}").alias("r2")))
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_s")).select(*keys, "_s.*")


def in_periods(df: DataFrame, periods: list[tuple[str, str, str]]) -> DataFrame:
    """Repeat each row once per (name, first, last) period that holds its date.

    Benchmarks must be in place already: they keep their full history.
    """
    hit = F.array_compact(
        F.array(*[F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(name)) for name, a, b in periods])
    )
    return df.select("*", F.explode(hit).alias("period"))


def cut_periods(log: DataFrame, run_keys: list[str], cuts: dict[str, str], holding: dict[str, int]) -> DataFrame:
    """Rows of a forecast log per evaluation period.

    A period ending at ``cut`` ends ``holding`` months earlier, when the last return was known.
    Runs that do not reach that month, or have fewer than two rows or forecasts, are left out.
    """
    months = F.coalesce(*[F.when(F.col("frequency") == k, F.lit(v)) for k, v in holding.items()], F.lit(1))
    spans = []
    for label, cut in cuts.items():
        ends = F.coalesce(*[F.when(months == v, F.lit(shift_literal(cut, -v))) for v in sorted({*holding.values(), 1})])
        spans.append(F.struct(F.lit(label).alias("eval_period"), ends.cast("date").alias("eval_end")))
    whole = Window.partitionBy(*run_keys)
    reached = log.withColumn("_last", F.max("date").over(whole)).select("*", F.explode(F.array(*spans)).alias("_p"))
    rows = reached.select(*log.columns, "_last", "_p.*").where(
        (F.col("_last") >= F.col("eval_end")) & (F.col("date") <= F.col("eval_end"))
    )
    per = Window.partitionBy(*run_keys, "eval_period")
    sized = rows.withColumn("_n", F.count(F.lit(1)).over(per)).withColumn("n_oos", F.count("y_hat").over(per))
    return sized.where((F.col("_n") >= 2) & (F.col("n_oos") >= 2)).drop("_last", "_n")


def gap_experiment(truth: DataFrame, keys: list[str], gaps: list[int], start: str) -> DataFrame:
    """Random-walk R2 for several gaps: all lags and benchmarks share one window pass."""
    from .benchmarks import hist_mean, random_walk

    cols, aggs, rows = {}, [], []
    for g in gaps:
        cols[f"f{g}"] = F.when(F.col("date") >= F.lit(start).cast("date"), random_walk("y", keys, g))
        cols[f"b{g}"] = hist_mean("y", keys, g)
    d = truth.select("*", *[c.alias(n) for n, c in cols.items()])
    for g in gaps:
        keep = both(f"b{g}", "y", f"f{g}")
        aggs += [r2(keep, f"b{g}", "y", f"f{g}").alias(f"r{g}"), F.count(F.when(keep, 1)).alias(f"n{g}")]
        rows.append(F.struct(F.lit(g).alias("gap"), F.col(f"n{g}").alias("n"), F.col(f"r{g}").alias("r2")))
    wide = d.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.explode(F.array(*rows)).alias("_s")).select(*keys, "_s.*")


def paired_gain(scores: DataFrame, keys: list[str], by: str, a: str, b: str, value: str) -> DataFrame:
    """Value of ``a`` minus value of ``b`` at the same keys, kept for every key ``a`` has."""
    side = lambda m: F.max(F.when(F.col(by) == m, F.col(value)))
    has = F.count(F.when(F.col(by) == a, 1))
    g = scores.where(F.col(by).isin(a, b)).groupBy(*keys).agg(side(a).alias("a"), side(b).alias("b"), has.alias("_h"))
    return g.where(F.col("_h") > 0).drop("_h").withColumn("gain", F.col("a") - F.col("b"))


def fragility_summary(scores: DataFrame, key: str, config: str, baseline: str, value: str = "r2", pval: str = "p") -> DataFrame:
    """Spread of a score over configurations with the baseline's own score, in percent."""
    v = F.col(value)
    g = scores.groupBy(key).agg(
        F.min(v).alias("min"), F.median(v).alias("median"), F.max(v).alias("max"),
        F.count(F.when(v > 0, 1)).alias("positive_configs"),
        F.count(F.when(F.col(pval) < 0.10, 1)).alias("significant_configs"), F.count(v).alias("n_configs"),
        F.max(F.when(F.col(config) == baseline, v)).alias("baseline"),
    )
    pct = lambda c: (F.lit(100.0) * c)
    share = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), F.col("n_configs").cast("string"))
    return g.select(
        key, pct(F.col("baseline")).alias("baseline"), pct(F.col("min")).alias("min"), pct(F.col("median")).alias("median"),
        pct(F.col("max")).alias("max"), pct(F.col("max") - F.col("min")).alias("range"),
        share("positive_configs").alias("positive"), share("significant_configs").alias("significant"),
    )


def variant_table(rows: DataFrame, shapes: dict[str, DataFrame], benchmarks: list[str], components: int) -> DataFrame:
    """One row per (macro_source, feature_method): out-of-sample R2 against each benchmark, missing cells and effective columns.

    ``rows`` are scored forecasts with the two keys; ``shapes`` gives each source's (nulls, cols, rows) panel shape. Raw
    features use all columns, components as many as asked for, as the panel has months, or as it has columns.
    """
    keys = ["macro_source", "feature_method"]
    score = rows.groupBy(*keys).agg(*[r2(both(b), b).alias(f"r2_{b}") for b in benchmarks])
    shape = None
    for source, frame in shapes.items():
        named = frame.withColumn("macro_source", F.lit(source))
        shape = named if shape is None else shape.unionByName(named)
    width = F.when(F.col("feature_method") == "raw", F.col("cols")).otherwise(F.least(F.lit(components), "rows", "cols"))
    return score.join(shape, "macro_source").select(
        *keys, *[f"r2_{b}" for b in benchmarks], F.col("nulls").alias("macro_missing_cells"), F.col("cols").alias("macro_cols"),
        width.cast("bigint").alias("feature_cols"),
    )
