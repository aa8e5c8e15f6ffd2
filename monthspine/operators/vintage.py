"""Bitemporal histories: what was known when.

History rows carry series_id, obs_date, realtime_start, realtime_end (9999-12-31 while open)
and value. As-of months are month-ends, so an interval of validity is turned into the months
it covers and joined by equality, or into two blocks of months; no range join is formed. Where several vintages of one cell
compete, a map-side max_by picks, so a hot series never sits whole in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.calendar import month_end, month_number, months_apart, per_month, release_cutoff, shift_literal, shift_months, with_months
from ..functions.columns import ratio, to_number
from .lags import lag_in_force
from .panel import densify, latest_at_or_before
from .transforms import apply_tcodes, ffill

OPEN_END = "9999-12-31"
#: Observation months stand above this in packed ranks, vintages below.
OBSERVED = 10_000_000_000_000


def clean_history(raw: DataFrame) -> DataFrame:
    """The five history columns, typed; rows without key or start are dropped."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    return raw.select(
        F.col("series_id").cast("string").alias("series_id"),
        F.last_day(text("obs_date").try_cast("date")).alias("obs_date"),
        text("realtime_start").try_cast("date").alias("realtime_start"),
        F.coalesce(text("realtime_end").try_cast("date"), F.lit(OPEN_END).cast("date")).alias("realtime_end"),
        to_number("value").alias("value"),
    ).dropna(subset=["series_id", "obs_date", "realtime_start"])


def _as_date(c: str | Column) -> Column:
    return F.lit(c).cast("date") if isinstance(c, str) else c


def expand_validity(history: DataFrame, first: str | Column, last: str | Column, out: str = "as_of") -> DataFrame:
    """One row per history row and month-end in ``first``..``last`` at which it was valid."""
    lo = F.greatest(F.last_day("realtime_start"), _as_date(first))
    end = F.least("realtime_end", _as_date(last))
    hi = F.when(F.last_day(end) == end, end).otherwise(shift_months(end, -1))
    live = history.where(
        (F.col("realtime_start") <= _as_date(last)) & (F.col("realtime_end") >= _as_date(first))
    )
    return with_months(live, lo, hi, out)


def vintage_order() -> Column:
    """Rank of a vintage by (realtime_start, realtime_end) in one long, so picks hash-aggregate."""
    return F.unix_date("realtime_start").cast("bigint") * 10_000_000 + F.unix_date("realtime_end")


def newest(value: str = "value") -> Column:
    """Value of the newest vintage, NULL when that vintage holds NULL."""
    return F.max_by(value, vintage_order())


def asof_panel(history: DataFrame, first: str, last: str) -> DataFrame:
    """(as_of, series_id, obs_date, value): the newest valid vintage of every observation."""
    valid = expand_validity(history, first, last).where(F.col("obs_date") <= F.col("as_of"))
    return valid.groupBy("as_of", "series_id", "obs_date").agg(newest().alias("value"))


def vintage_selection(dates: DataFrame, archive_months: DataFrame, offset: int = 1) -> DataFrame:
    """Archive month for each forecast date.

    Requested is ``offset`` months ahead; the latest archive month not after it, or the first
    one when the archive starts later.
    """
    months = archive_months.select(F.col("vintage_month").alias("requested")).distinct()
    asked = dates.select(month_end("forecast_date").alias("forecast_date")).distinct().withColumn(
        "requested", shift_months("forecast_date", offset)
    )
    sel = latest_at_or_before(months, asked, [], "requested", [])
    past = F.col("requested_found")
    first = archive_months.select(F.min("vintage_month")).scalar()
    return sel.select(
        "forecast_date",
        F.col("requested").alias("requested_vintage_month"),
        F.coalesce(past, first).alias("selected_archive_month"),
        F.when(past.isNull(), fv.TAG_ANCHOR).otherwise(fv.TAG_ARCHIVE).alias("archive_source_tag"),
        F.col("requested").alias("as_of"),
    )


def source_roles(registry: DataFrame, carry: list[str] = ()) -> DataFrame:
    """Registry rows unfolded to the histories they read: direct, numerator, denominator."""
    derived = F.col("kind") == "derived_formula"
    parts = F.when(
        derived,
        F.array(
            F.struct(F.lit("num").alias("role"), F.col("num").alias("series_id")),
            F.struct(F.lit("den").alias("role"), F.col("den").alias("series_id")),
        ),
    ).otherwise(
        F.array(F.struct(F.lit("direct").alias("role"), F.coalesce("target", "series").alias("series_id")))
    )
    return registry.select("series", *carry, F.explode(parts).alias("_p")).select("series", "_p.role", "_p.series_id", *carry)


def combine_roles(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Direct value, or numerator over denominator, per key."""
    part = lambda r: F.max(F.when(F.col("role") == r, F.col(value)))
    return values.groupBy(*keys).agg(
        part("direct").alias("_d"), part("num").alias("_n"), part("den").alias("_q")
    ).select(*keys, F.coalesce("_d", ratio(F.col("_n"), F.col("_q"))).alias("value"))


def asof_cells(
    history: DataFrame, registry: DataFrame, selection: DataFrame, first: str, last: str, start: str, months: int | None = None
) -> DataFrame:
    """As-of values of registry series for every forecast date (forecast_date, date, series, value).

    ``months`` keeps observations that are so many as-of months old at most; validity is then unfolded over these only.
    """
    roles = source_roles(registry)
    dates = per_month(selection.select("forecast_date", "as_of"))
    until = last if months is None else F.least(F.lit(last).cast("date"), shift_months("obs_date", months))
    valid = expand_validity(history, first, until).where(F.col("obs_date") >= F.lit(start).cast("date"))
    cells = (
        valid.join(dates, "as_of")
        .where(F.col("obs_date") <= F.col("forecast_date"))
        .groupBy("forecast_date", "obs_date", "series_id")
        .agg(newest().alias("value"))
        .withColumnRenamed("obs_date", "date")
    )
    return combine_roles(cells.join(roles, "series_id"), ["forecast_date", "date", "series"])


def fill_from_archive(cells: DataFrame, archive: DataFrame, selection: DataFrame, start: str) -> DataFrame:
    """Fill cells without an as-of value from the selected archive month and tag the source."""
    chosen = per_month(
        selection.select(
            "forecast_date", F.col("selected_archive_month").alias("vintage_month"), "archive_source_tag"
        )
    )
    stored = (
        archive.join(chosen, "vintage_month")
        .where((F.col("date") <= F.col("forecast_date")) & (F.col("date") >= F.lit(start).cast("date")))
        .select("forecast_date", "date", "series", F.lit(None).cast("double").alias("a"), F.col("value").alias("b"))
    )
    known = cells.select(
        "forecast_date", "date", "series", F.col("value").alias("a"), F.lit(None).cast("double").alias("b")
    )
    merged = known.unionByName(stored).groupBy("forecast_date", "date", "series").agg(
        F.max("a").alias("a"), F.max("b").alias("b")
    )
    return merged.join(chosen.drop("vintage_month"), "forecast_date").select(
        "forecast_date", "date", "series", F.coalesce("a", "b").alias("raw"),
        F.when(F.col("a").isNotNull(), fv.TAG_ASOF)
        .when(F.col("b").isNotNull(), F.col("archive_source_tag"))
        .otherwise(fv.TAG_MISSING)
        .alias("tag"),
    )


def vintage_panels(
    history: DataFrame, archive: DataFrame, registry: DataFrame, dates: DataFrame,
    start: str, first_date: str, last_date: str, drop: list[str] = (), diagonal: bool = False,
) -> DataFrame:
    """As-of panels of all forecast dates in one job (forecast_date, date, series, raw, transformed, tag).

    Two warm-up months before ``start`` feed the differences and are cut off after the window.
    ``first_date``/``last_date`` bound the forecast dates. ``diagonal`` keeps each panel's last row
    only, for which three months per panel are read (``start`` is then the first forecast date).
    """
    selection = vintage_selection(
        dates.where(F.col("forecast_date").between(first_date, last_date)),
        archive.select("vintage_month"),
    )
    warm = shift_literal(start, -2)
    cells = asof_cells(history, registry, selection, shift_literal(first_date, 1), shift_literal(last_date, 1), warm, 3 if diagonal else None)
    tagged = fill_from_archive(cells, archive.withColumnRenamed("series_id", "series"), selection, warm)
    if diagonal:
        tagged = tagged.where(months_apart("forecast_date", "date") <= 2)
    names = registry.where(~F.col("series").isin(list(drop))) if drop else registry
    # every forecast date with every series: an equality join on a few salts, so no task holds all of either side
    salts = 16
    dealt = names.select("series", F.pmod(F.xxhash64("series"), F.lit(salts)).alias("_s")).distinct()
    grid = selection.select("forecast_date", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("_s"))
    grid = grid.join(dealt, "_s").select("forecast_date", "series")
    lo = F.when(F.lit(diagonal), shift_months("forecast_date", -2)).otherwise(F.lit(warm).cast("date"))
    month_cells = F.map_from_entries(F.collect_list(F.struct("date", F.struct("raw", "tag"))))
    packed = tagged.groupBy("forecast_date", "series").agg(month_cells.alias("_m"))
    cell = F.try_element_at("_m", F.col("date"))
    spread = (
        with_months(grid.join(packed, ["forecast_date", "series"], "left"), lo, "forecast_date")
        .select("forecast_date", "series", "date", cell["raw"].alias("raw"),
                F.coalesce(cell["tag"], F.lit(fv.TAG_MISSING)).alias("tag"))
    )
    coded = spread.join(names.select("series", "tcode"), "series")
    done = apply_tcodes(coded, ["forecast_date", "series"], value="raw")
    keep = F.col("date") == F.col("forecast_date") if diagonal else F.col("date") >= F.lit(start).cast("date")
    return done.where(keep).select("forecast_date", "date", "series", "raw", "transformed", "tag")


# ---- decision picks -------------------------------------------------------------------------


def first_vintages(history: DataFrame) -> DataFrame:
    return history.groupBy("series_id").agg(F.min("realtime_start").alias("first_vintage"))


def _month_date(m: Column) -> Column:
    """Month-end of a month number."""
    return F.last_day(F.make_date(F.floor((m - 1) / 12).cast("int"), ((m - 1) % 12 + 1).cast("int"), F.lit(1)))


def best_while_valid(spans: DataFrame, of: DataFrame, first: str | Column, last: str | Column) -> DataFrame:
    """(keys, m, rank, value): for every month first..last the valid span of the highest rank; months without any are left out.

    ``of`` holds the distinct keys asked for; ``spans`` is (keys, lo, hi, rank, value), valid from month number lo to hi. A span is not unfolded over its months: two
    blocks of a power of two cover it, whatever its length. Blocks of equal place and length combine map-side to the best
    one, so a key holds as many as there are months and lengths; a running maximum per length, over as many months as it
    has, reads them off. One shuffle by the key and month, one by the key.
    """
    keys, lo, hi = of.columns, month_number(_as_date(first)), month_number(_as_date(last))
    known = isinstance(first, str) and isinstance(last, str)
    levels = (int(last[:4]) * 12 + int(last[5:7]) - int(first[:4]) * 12 - int(first[5:7]) + 1).bit_length() if known else 12
    s = spans.withColumn("_a", F.greatest("lo", lo)).withColumn("_b", F.least("hi", hi)).where(F.col("_a") <= F.col("_b"))
    s = s.withColumn("_k", F.length(F.bin(F.col("_b") - F.col("_a") + 1)) - 1)
    starts = F.array(F.col("_a"), F.col("_b") - F.expr("shiftleft(1, _k)") + 1)
    blocks = s.select(*keys, F.explode(starts).alias("m"), "_k", "rank", "value")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("_k", "int"), ("rank", "bigint"), ("value", "double"))]
    rows = blocks.unionByName(of.withColumn("m", F.explode(F.sequence(lo, hi))).select(*keys, "m", *empty))
    of_length = [F.when(F.col("_k") == k, F.col("rank")) for k in range(levels)]
    best = [F.struct(F.max(r).alias("rank"), F.max_by("value", r).alias("value")).alias(f"_t{k}") for k, r in enumerate(of_length)]
    table = rows.groupBy(*keys, "m").agg(*best)
    cells = [F.when(F.col(f"_t{k}.rank").isNotNull(), F.col(f"_t{k}")) for k in range(levels)]
    over = Window.partitionBy(*keys).orderBy("m")
    found = [F.max(c).over(over.rowsBetween(-(2**k - 1), 0)) for k, c in enumerate(cells)]
    top = F.array_max(F.array(*found)) if levels > 1 else found[0]
    out = table.select(*keys, "m", top.alias("_c")).where(F.col("_c").isNotNull())
    return out.select(*keys, "m", "_c.rank", "_c.value")


def pick_strict(history: DataFrame, reads: DataFrame, first: str, last: str) -> DataFrame:
    """Last observation at or before the cutoff among vintages valid at the decision.

    ``reads`` (series_id, rule, plus anything) is a dimension: one row per rule a history is read under. A vintage counts
    from the decision that is late enough for its observation and its start, up to its end.
    """
    any_day = F.lit("2000-12-31").cast("date")
    asked = reads.withColumn("delay", months_apart(any_day, release_cutoff(any_day, "rule")))
    delays = asked.select("series_id", "delay").distinct()
    ended = F.when(F.last_day("realtime_end") == F.col("realtime_end"), month_number("realtime_end")).otherwise(month_number("realtime_end") - 1)
    # order by observation month, then vintage, packed into one long
    last_seen = (month_number("obs_date") % 100_000).cast("bigint") * OBSERVED
    starts = F.unix_date("realtime_start").cast("bigint") - F.unix_date(F.last_day("obs_date"))
    rank = last_seen + (starts + 1_000_000) * 4_000_000 + F.unix_date("realtime_end")
    spans = history.join(delays, "series_id").select(
        "series_id", "delay", F.greatest(month_number("realtime_start"), month_number("obs_date") + F.col("delay")).alias("lo"),
        ended.alias("hi"), rank.alias("rank"), "value",
    )
    best = best_while_valid(spans, delays, first, last).withColumn("decision", _month_date(F.col("m")))
    seen = _month_date(F.floor(F.col("rank") / F.lit(OBSERVED)).cast("int"))
    out = best.withColumn("obs_date", seen).withColumn("cutoff", shift_months("decision", -F.col("delay")))
    return out.join(asked, ["series_id", "delay"]).select("decision", *reads.columns, "cutoff", "value", "obs_date")


def _monthly_asof(obs: DataFrame, last: str) -> DataFrame:
    """Per series_id and month: the last observation so far, with its date."""
    packed = obs.withColumn("cell", F.struct("value", "obs_date")).withColumnRenamed("obs_date", "date")
    ends = densify(packed, ["series_id"], ["cell"], start=packed.select(F.min("date")).scalar(), end=last)
    filled = ends.withColumn("cell", ffill("cell", ["series_id"]))
    return filled.select(
        "series_id", F.col("date").alias("cutoff"), F.col("cell.value").alias("value"), F.col("cell.obs_date").alias("obs_date")
    )


def _read_at_cutoff(monthly: DataFrame, firsts: DataFrame, reads: DataFrame, first: str, last: str, before: bool) -> DataFrame:
    """Attach the as-of value at each decision's cutoff, on one side of the first vintage."""
    asked = with_months(reads.join(firsts, "series_id"), F.lit(first), F.lit(last), "decision")
    side = F.col("decision") < F.col("first_vintage")
    asked = asked.where(side if before else ~side).withColumn("cutoff", release_cutoff("decision", "rule"))
    return asked.join(monthly, ["series_id", "cutoff"]).where(F.col("obs_date").isNotNull()).select(
        "decision", *reads.columns, "cutoff", "value", "obs_date"
    )


def pick_earliest(history: DataFrame, reads: DataFrame, first: str, last: str) -> DataFrame:
    """Before a series has any vintage: its first vintage's last observation up to the cutoff."""
    firsts = first_vintages(history)
    at_first = (
        history.join(firsts, "series_id")
        .where((F.col("realtime_start") <= F.col("first_vintage")) & (F.col("realtime_end") >= F.col("first_vintage")))
        .groupBy("series_id", "obs_date").agg(newest().alias("value"))
    )
    return _read_at_cutoff(_monthly_asof(at_first, last), firsts, reads, first, last, before=True)


def pick_latest(history: DataFrame, reads: DataFrame, first: str, last: str) -> DataFrame:
    """From the first vintage on: the last observation up to the cutoff, newest vintage."""
    final = history.groupBy("series_id", "obs_date").agg(newest().alias("value"))
    return _read_at_cutoff(_monthly_asof(final, last), first_vintages(history), reads, first, last, before=False)


def staleness_limit(max_gap: int, decision: str = "decision") -> Column:
    return F.greatest(F.lit(max_gap), lag_in_force(decision))


def guard_stale(picks: DataFrame, max_gap: int, limit: Column | None = None) -> DataFrame:
    """NULL the value when the observation is further behind the cutoff than allowed."""
    limit = staleness_limit(max_gap) if limit is None else limit
    fresh = months_apart("cutoff", "obs_date") <= limit
    return picks.withColumn("value", F.when(fresh, F.col("value")))


def decision_reads(registry: DataFrame) -> DataFrame:
    """Every history a registry row reads, with its rule, lag policy and start override."""
    return source_roles(registry, ["kind", "rule", "lag_mode", "lag_months", "lag_schedule"])


def balanced_cascade(
    history: DataFrame, registry: DataFrame, first: str, last: str, max_gap: int = 1,
    starts: dict[str, str] | None = None, component_policies: DataFrame | None = None,
) -> DataFrame:
    """Balanced decision panel: strict, then release-gap, then pre-vintage value, with its tag.

    Revised series and ratios are read as valid at the decision within the staleness limit.
    Sources without vintages are read at their latest value. What is still missing before the
    first vintage takes the earliest one.
    """
    reads = decision_reads(registry)
    if component_policies is not None:
        own = component_policies.select(
            F.col("series").alias("series_id"), F.struct("lag_mode", "lag_months", "lag_schedule").alias("own_lag")
        )
        reads = reads.join(own, "series_id", "left")
        own_lag = F.when(
            F.col("role") != "direct",
            lag_in_force("decision", F.col("own_lag.lag_mode"), F.col("own_lag.lag_months"), F.col("own_lag.lag_schedule")),
        )
    else:
        own_lag = F.when(F.col("role") != "direct", F.lit(fv.DEFAULT_LAG))
    limit = F.greatest(staleness_limit(max_gap), F.coalesce(own_lag, F.lit(0)))
    vintaged = F.col("kind").isin("direct_alfred", "derived_formula")
    keep = ["decision", "series", "role", "value"]
    strict = guard_stale(pick_strict(history, reads.where(vintaged), first, last), max_gap, limit).select(*keep)
    latest = pick_latest(history, reads.where(~vintaged), first, last).select(*keep)
    earliest = pick_earliest(history, reads, first, last).select(*keep)
    staged = (
        strict.unionByName(latest).withColumn("stage", F.lit(0))
        .unionByName(earliest.withColumn("stage", F.lit(2)))
    )
    values = combine_roles(staged, ["decision", "series", "stage"])
    by_stage = values.groupBy("decision", "series").agg(
        F.max(F.when(F.col("stage") == 0, F.col("value"))).alias("s"),
        F.max(F.when(F.col("stage") == 2, F.col("value"))).alias("e"),
    )
    grid = with_months(registry.select("series"), F.lit(first), F.lit(last), "decision")
    out = grid.join(by_stage, ["decision", "series"], "left")
    open_now = F.lit(True)
    for s, d in (starts or {}).items():
        open_now = open_now & ~((F.col("series") == s) & (F.col("decision") < F.last_day(F.lit(d).cast("date"))))
    s, e = F.when(open_now, F.col("s")), F.when(open_now, F.col("e"))
    return out.select(
        "decision", "series", F.coalesce(s, e).alias("value"),
        F.when(s.isNotNull(), fv.TAG_STRICT).when(e.isNotNull(), fv.TAG_PRE_VINTAGE).otherwise("").alias("tag"),
    )


# ---- archive snapshots ----------------------------------------------------------------------


def earliest_vintage(archive: DataFrame) -> DataFrame:
    """First archive month that holds each series."""
    return archive.groupBy("series_id").agg(F.min("vintage_month").alias("anchor_month"))


def nearest_in_snapshot(asked: DataFrame, archive: DataFrame) -> DataFrame:
    """Value at or before the cutoff inside a given snapshot, no older than ``max_gap`` months.

    ``asked`` has vintage_month, series_id, cutoff, max_gap and anything to carry along. The gap
    is a few months, so each request unfolds into the months it may use and joins by equality.
    """
    carry = asked.columns
    oldest = shift_months("cutoff", -F.col("max_gap"))
    tries = with_months(asked, oldest, "cutoff", "obs_date")
    cells = archive.where(F.col("value").isNotNull()).select(
        "vintage_month", "series_id", F.col("date").alias("obs_date"), F.col("value").alias("_v")
    )
    return (
        tries.join(cells, ["vintage_month", "series_id", "obs_date"])
        .groupBy(*carry)
        .agg(F.max_by(F.col("_v"), F.col("obs_date")).alias("value"))
    )


def anchor_backfill(
    balanced: DataFrame, registry: DataFrame, archive: DataFrame, non_revised: DataFrame,
    tag: str = fv.TAG_PRE_VINTAGE, max_gap: int = 1, blocked: list[str] = (), starts: dict[str, str] | None = None,
    first: str | None = None, last: str | None = None,
) -> DataFrame:
    """Fill the gaps of a balanced panel: same-month snapshot, anchor snapshot, non-revised panel.

    ``balanced`` is (decision, series, value, tag), ``non_revised`` (date, series, value). ``first`` is
    the earliest month of the non-revised panel and ``last`` the latest decision; without them the
    frames are read once more for it. ``balanced`` is read twice: pass a stored table. A blocked
    series that has started takes nothing from before its archive. Started means an earlier row
    tagged by the cascade; fills of this pass count when ``tag`` is one of those tags, and since
    the first anchor fill itself starts a series, every earlier anchor candidate counts as well.
    """
    reg = registry.select("series", "rule", "lag_mode", "lag_months", "lag_schedule")
    cells = balanced.join(reg, "series").withColumn("cutoff", release_cutoff("decision", "rule"))
    open_now = F.lit(True)
    for s, d in (starts or {}).items():
        open_now = open_now & ~((F.col("series") == s) & (F.col("decision") < F.last_day(F.lit(d).cast("date"))))
    anchors = earliest_vintage(archive).withColumnRenamed("series_id", "series")
    cells = cells.join(anchors, "series", "left")
    gaps = cells.where(F.col("value").isNull() & open_now).withColumn("max_gap", staleness_limit(max_gap))
    ask = gaps.select("decision", F.col("series").alias("series_id"), "cutoff", "max_gap", "anchor_month")
    wanted = ask.select(
        "decision", "series_id", "cutoff", "max_gap",
        F.explode(
            F.array(
                F.struct(F.lit("same").alias("step"), F.col("decision").alias("vintage_month")),
                F.struct(
                    F.lit("anchor").alias("step"),
                    F.when(F.col("decision") < F.col("anchor_month"), F.col("anchor_month")).alias("vintage_month"),
                ),
            )
        ).alias("w"),
    ).select("decision", "series_id", "cutoff", "max_gap", "w.step", "w.vintage_month").where(F.col("vintage_month").isNotNull())
    found = nearest_in_snapshot(wanted, archive).groupBy("decision", F.col("series_id").alias("series")).agg(
        F.max(F.when(F.col("step") == "same", F.col("value"))).alias("same"),
        F.max(F.when(F.col("step") == "anchor", F.col("value"))).alias("anchor"),
    )
    flat = non_revised.where(F.col("value").isNotNull())
    until = cells.select(F.max("decision")).scalar() if last is None else last
    carried = densify(flat, ["series"], ["value"], start=flat.select(F.min("date")).scalar() if first is None else first, end=until)
    carried = carried.select("series", F.col("date").alias("cutoff"), ffill("value", ["series"]).alias("plain"))
    all_cells = cells.join(found, ["decision", "series"], "left").join(carried, ["series", "cutoff"], "left")

    cascade_tags = [fv.TAG_STRICT, fv.TAG_RELEASE_GAP, fv.TAG_PRE_VINTAGE]
    counts = F.coalesce(F.col("tag").isin(cascade_tags), F.lit(False))
    if tag in cascade_tags:
        counts = counts | F.col("same").isNotNull() | F.col("anchor").isNotNull()
    before = Window.partitionBy("series").orderBy("decision").rowsBetween(Window.unboundedPreceding, -1)
    started = F.coalesce(F.max(counts.cast("int")).over(before), F.lit(0)) == 1
    barred = F.col("series").isin(list(blocked)) & started if blocked else F.lit(False)
    pre_archive = F.coalesce(F.col("decision") < F.col("anchor_month"), F.lit(False))
    step = all_cells.withColumn("_barred", barred)
    fillable = F.col("value").isNull() & open_now
    from_snapshot = F.coalesce("same", F.when(~F.col("_barred"), F.col("anchor")))
    plain = F.when(~(pre_archive & F.col("_barred")), F.col("plain"))
    return step.select(
        "decision", "series",
        F.when(fillable, F.coalesce(from_snapshot, plain)).otherwise(F.col("value")).alias("value"),
        F.when(fillable & from_snapshot.isNotNull(), F.lit(tag))
        .when(fillable & plain.isNotNull(), F.lit(fv.TAG_NON_REVISED))
        .otherwise(F.col("tag")).alias("tag"),
        (fillable & F.coalesce(from_snapshot, plain).isNotNull()).alias("filled"),
    )


def realtime_features(
    features: DataFrame, panels: DataFrame, dates: DataFrame, names: DataFrame, first: str, last: str, macro: str = "macro",
) -> DataFrame:
    """Predictors per origin with the macro block taken from the origin's own as-of panel.

    ``features`` is (date, source, series, value); ``panels`` comes from ``vintage_panels`` for the
    forecast dates ``dates`` within ``first``..``last`` and the registry series ``names``. A macro series
    the registry does not carry fails the query.
    """
    wanted = features.where(F.col("source") == macro).select("series").distinct()
    # the error names the first offender and how many there are
    lost = wanted.join(names.select("series"), "series", "left_anti")
    problem = lost.agg(F.when(F.count("*") > 0, F.concat(F.min("series"), F.lit(" and others, in all "), F.count("*").cast("string"))).otherwise("")).scalar()
    origins = dates.select(F.col("forecast_date").alias("origin")).distinct()
    fixed = features.where(F.col("source") != macro).select("date", "source", "series", "value")
    plain = with_months(fixed, F.greatest("date", F.lit(first).cast("date")), F.lit(last), "origin").join(
        per_month(origins), "origin", "left_semi"
    ).select("origin", "date", "source", "series", "value")
    live = panels.join(wanted, "series", "left_semi").select(
        F.col("forecast_date").alias("origin"), "date", F.lit(macro).alias("source"), "series",
        F.col("transformed").alias("value"),
    )
    checked = F.when(problem == "", F.col("source")).otherwise(
        F.raise_error(F.concat(F.lit("macro series without as-of data: "), problem)).cast("string")
    )
    return plain.unionByName(live).withColumn("source", checked)
