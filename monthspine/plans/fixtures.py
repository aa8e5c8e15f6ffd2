"""Monthly inputs derived from the driver tables, as DataFrames and as DuckDB views.

Money and rates are summed as whole cents, so both engines and every partitioning
give the same doubles bit for bit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_end, shift_literal, shift_months
from ..functions.literal import literal_rows
from ..operators.vintage import expand_validity
from ..session import written

FIRST_VINTAGE = "1996-01-31"
SNAPSHOTS_AFTER = 4  # months of snapshots after the last observation


def cents(c: str) -> Column:
    """Whole cents; the half added before the floor only absorbs the binary error of x * 100."""
    return F.floor(F.col(c) * 100 + 0.5)


class Fixtures:
    """Lazy views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        """A literal dimension table."""
        return literal_rows(self.spark, values, schema)

    def shared(self, df: DataFrame) -> DataFrame:
        """Compute once what a plan reads several times: a table in the shared folder."""
        return written(df)

    @cached_property
    def _ends(self) -> tuple[str, str]:
        day = F.last_day("o_orderdate").cast("string")
        first, last = self.table("orders").select(F.min(day), F.max(day)).first()
        return first or FIRST_VINTAGE, last or FIRST_VINTAGE

    @property
    def first_month(self) -> str:
        """Month of the first order; one aggregated row is read for it, as calendars are parameters of the operators."""
        return self._ends[0]

    @property
    def last_month(self) -> str:
        """Month of the last order: the last that has observations, decisions and forecasts."""
        return self._ends[1]

    def after(self, months: int) -> str:
        """Month so long after the last one, while revisions and snapshots still come in."""
        return shift_literal(self.last_month, months)

    @cached_property
    def stored_history(self) -> DataFrame:
        return self.shared(self.history)

    def _line(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def curve(self) -> DataFrame:
        """Yield curve (date, maturity, y)."""
        return (
            self._line()
            .groupBy(
                month_end("l_shipdate").alias("date"),
                (F.col("l_linenumber") * 12).cast("int").alias("maturity"),
            )
            .agg((F.sum(cents("l_discount")) / (F.lit(100.0) * F.count("*"))).alias("y"))
        )

    @cached_property
    def curve_monthly(self) -> DataFrame:
        """Yield curve with neighbouring monthly maturities 7..13."""
        return (
            self._line()
            .groupBy(
                month_end("l_shipdate").alias("date"),
                (F.col("l_linenumber") + 6).cast("int").alias("maturity"),
            )
            .agg((F.sum(cents("l_discount")) / (F.lit(100.0) * F.count("*"))).alias("y"))
        )

    @cached_property
    def panel(self) -> DataFrame:
        """Panel (date, series, grp, value, n, tag) with gaps at small scale."""
        return (
            self.table("orders")
            .groupBy(month_end("o_orderdate").alias("date"), "o_orderpriority", "o_orderstatus")
            .agg(F.sum(cents("o_totalprice")).alias("c"), F.count("*").alias("n"))
            .select(
                "date",
                F.concat("o_orderpriority", F.lit("|"), "o_orderstatus").alias("series"),
                F.col("o_orderpriority").alias("grp"),
                (F.col("c") / 100.0).alias("value"),
                "n",
                F.when(F.col("n") % 7 == 0, "ARCHIVE_FALLBACK")
                .when(F.col("n") % 7 == 1, "EARLIEST_ARCHIVE_ANCHOR")
                .otherwise("ALFRED_ASOF")
                .alias("tag"),
            )
        )

    @cached_property
    def history(self) -> DataFrame:
        """Bitemporal history (series_id, obs_date, realtime_start, realtime_end, value)."""
        line = self._line().select(
            "l_orderkey", "l_linenumber", cents("l_extendedprice").alias("c")
        )
        orders = self.table("orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
        flows = (
            line.join(orders, line.l_orderkey == orders.o_orderkey)
            .groupBy(
                F.col("o_orderpriority").alias("series_id"),
                month_end("o_orderdate").alias("obs_date"),
            )
            .pivot("l_linenumber", list(range(1, 8)))
            .agg(F.sum("c"))
        )
        # at most seven revisions per observation: cumulate them inside one row
        revs = F.filter(
            F.array(
                *[F.struct(F.lit(r).alias("rev"), F.col(str(r)).alias("c")) for r in range(1, 8)]
            ),
            lambda x: x["c"].isNotNull(),
        )
        one = flows.select("series_id", "obs_date", revs.alias("revs")).select(
            "series_id", "obs_date", "revs", F.posexplode("revs").alias("pos", "r")
        )
        upto = F.aggregate(
            F.slice("revs", F.lit(1), F.col("pos") + 1),
            F.lit(0).cast("bigint"),
            lambda a, x: a + x["c"],
        )
        following = F.get("revs", F.col("pos") + 1)
        return one.select(
            "series_id",
            "obs_date",
            shift_months("obs_date", F.col("r.rev")).alias("realtime_start"),
            F.coalesce(
                F.date_add(shift_months("obs_date", following["rev"]), -1),
                F.lit("9999-12-31").cast("date"),
            ).alias("realtime_end"),
            (upto / 100.0).alias("value"),
        )

    @cached_property
    def forecast(self) -> DataFrame:
        """Seed forecasts (date, seed, maturity, y_hat, val_loss)."""
        return (
            self._line()
            .groupBy(
                month_end("l_shipdate").alias("date"),
                (F.col("l_suppkey") % 20).cast("int").alias("seed"),
                (F.col("l_linenumber") * 12).cast("int").alias("maturity"),
            )
            .agg(
                (F.sum(cents("l_discount")) / (F.lit(100.0) * F.count("*"))).alias("y_hat"),
                (F.sum(cents("l_tax")) / (F.lit(100.0) * F.count("*"))).alias("val_loss"),
            )
        )

    @cached_property
    def models(self) -> DataFrame:
        """Six model forecasts per date and maturity (date, maturity, model, y_hat)."""
        return (
            self._line()
            .groupBy(
                month_end("l_shipdate").alias("date"),
                (F.col("l_linenumber") * 12).cast("int").alias("maturity"),
                F.concat(F.lit("m"), (F.col("l_suppkey") % 6).cast("string")).alias("model"),
            )
            .agg((F.sum(cents("l_discount")) / (F.lit(100.0) * F.count("*"))).alias("y_hat"))
        )

    @cached_property
    def attr(self) -> DataFrame:
        """Attributions (date, maturity, seed, feature, shap_value)."""
        line = self._line().select(
            "l_partkey",
            month_end("l_shipdate").alias("date"),
            (F.col("l_linenumber") * 12).cast("int").alias("maturity"),
            (F.col("l_suppkey") % 5).cast("int").alias("seed"),
            cents("l_discount").alias("c"),
        )
        part = self.table("part").select("p_partkey", "p_type", "p_brand")
        head = F.when(F.col("p_type") == "ECONOMY", "forward").otherwise(F.concat(F.lit("fred::"), "p_type"))
        return (
            line.join(part, line.l_partkey == part.p_partkey)
            .groupBy("date", "maturity", "seed", "p_type", "p_brand")
            .agg(
                (
                    (F.sum("c") - F.lit(5) * F.count("*")) / (F.lit(100.0) * F.count("*"))
                ).alias("shap_value")
            )
            .select("date", "maturity", "seed", F.concat_ws("::", head, "p_brand").alias("feature"), "shap_value")
        )

    @cached_property
    def sparse(self) -> DataFrame:
        """Monthly quantity per supplier (date, series, value)."""
        return (
            self._line()
            .groupBy(month_end("l_shipdate").alias("date"), F.col("l_suppkey").alias("series"))
            .agg(F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias("value"))
        )

    @cached_property
    def archive(self) -> DataFrame:
        """Vintage archive (vintage_month, date, series_id, value): the history as of each month
        from 1996 on, without the March and August snapshots."""
        return (
            expand_validity(self.stored_history, FIRST_VINTAGE, self.after(SNAPSHOTS_AFTER), "vintage_month")
            .where(~F.month("vintage_month").isin(3, 8))
            .select("vintage_month", F.col("obs_date").alias("date"), "series_id", "value")
        )

    @cached_property
    def registry(self) -> DataFrame:
        """Five direct series and one ratio with lag modes, release rules and transform codes."""
        return self.rows(
            REGISTRY,
            "series string, kind string, target string, num string, den string, rule string, "
            "lag_mode string, lag_months int, lag_schedule string, tcode int, grp string",
        )

    @cached_property
    def regimes(self) -> DataFrame:
        return self.rows(REGIMES, "episode string, start_date string, end_date string").select(
            "episode",
            F.col("start_date").cast("date").alias("start_date"),
            F.col("end_date").cast("date").alias("end_date"),
        )


SCHEDULE = '{"1":1,"2":2,"3":3,"4":1,"5":2,"6":3,"7":1,"8":2,"9":3,"10":1,"11":2,"12":3}'
REGISTRY = [
    ("1-URGENT", "direct_alfred", "1-URGENT", None, None, "same_month_end", "fixed", 1, "", 5, "alpha"),
    ("2-HIGH", "direct_alfred", "2-HIGH", None, None, "month_end_plus_1m", "fixed", 2, "", 2, "alpha"),
    ("3-MEDIUM", "direct_alfred", "3-MEDIUM", None, None, "month_end_plus_2m", "decision_month_schedule", 1, SCHEDULE, 6, "beta"),
    ("4-NOT SPECIFIED", "direct_fred", "4-NOT SPECIFIED", None, None, "same_month_end", "fixed", 3, "", 7, "beta"),
    ("5-LOW", "direct_alfred", "5-LOW", None, None, "month_end_plus_3m", "fixed", 1, "", 1, "beta"),
    ("6-RATIO", "derived_formula", None, "1-URGENT", "2-HIGH", "same_month_end", "fixed", 1, "", 4, "gamma"),
]
REGIMES = [
    ("first", "1996-03-01", "1996-10-31"),
    ("second", "1999-01-01", "1999-06-30"),
    ("third", "2001-01-01", "2001-05-31"),
]


def _lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) v({columns})"


# name -> (fixture views it reads, DuckDB text)
SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "fx_curve": ([], """
        SELECT last_day(l_shipdate) AS date, CAST(l_linenumber*12 AS INTEGER) AS maturity,
               CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/(100e0*count(*)) AS y
        FROM lineitem GROUP BY 1,2"""),
    "fx_curve_monthly": ([], """
        SELECT last_day(l_shipdate) AS date, CAST(l_linenumber+6 AS INTEGER) AS maturity,
               CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/(100e0*count(*)) AS y
        FROM lineitem GROUP BY 1,2"""),
    "fx_panel": ([], """
        SELECT date, series, grp, value, n,
               CASE WHEN n%7=0 THEN 'ARCHIVE_FALLBACK' WHEN n%7=1 THEN 'EARLIEST_ARCHIVE_ANCHOR'
                    ELSE 'ALFRED_ASOF' END AS tag
        FROM (SELECT last_day(o_orderdate) AS date, concat(o_orderpriority,'|',o_orderstatus) AS series,
                     o_orderpriority AS grp,
                     CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS DOUBLE)/100e0 AS value,
                     count(*) AS n
              FROM orders GROUP BY 1,2,3) q"""),
    "fx_history": ([], """
        SELECT series_id, obs_date, realtime_start,
               coalesce(CAST(lead(realtime_start) OVER w - 1 AS DATE), DATE '9999-12-31') AS realtime_end, value
        FROM (SELECT series_id, obs_date, last_day(obs_date + to_months(rev)) AS realtime_start,
                     CAST(sum(c) OVER (PARTITION BY series_id, obs_date ORDER BY rev) AS DOUBLE)/100e0 AS value
              FROM (SELECT o_orderpriority AS series_id, last_day(o_orderdate) AS obs_date,
                           CAST(l_linenumber AS INTEGER) AS rev,
                           CAST(sum(CAST(round(l_extendedprice*100) AS BIGINT)) AS BIGINT) AS c
                    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1,2,3) a) b
        WINDOW w AS (PARTITION BY series_id, obs_date ORDER BY realtime_start)"""),
    "fx_forecast": ([], """
        SELECT last_day(l_shipdate) AS date, CAST(l_suppkey%20 AS INTEGER) AS seed,
               CAST(l_linenumber*12 AS INTEGER) AS maturity,
               CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/(100e0*count(*)) AS y_hat,
               CAST(sum(CAST(round(l_tax*100) AS BIGINT)) AS DOUBLE)/(100e0*count(*)) AS val_loss
        FROM lineitem GROUP BY 1,2,3"""),
    "fx_models": ([], """
        SELECT last_day(l_shipdate) AS date, CAST(l_linenumber*12 AS INTEGER) AS maturity,
               concat('m', CAST(l_suppkey%6 AS VARCHAR)) AS model,
               CAST(sum(CAST(round(l_discount*100) AS BIGINT)) AS DOUBLE)/(100e0*count(*)) AS y_hat
        FROM lineitem GROUP BY 1,2,3"""),
    "fx_attr": ([], """
        SELECT last_day(l_shipdate) AS date, CAST(l_linenumber*12 AS INTEGER) AS maturity,
               CAST(l_suppkey%5 AS INTEGER) AS seed, CASE WHEN p_type = 'ECONOMY' THEN concat('forward::', p_brand) ELSE concat('fred::', p_type, '::', p_brand) END AS feature,
               CAST(sum(CAST(round(l_discount*100) AS BIGINT)) - 5*count(*) AS DOUBLE)/(100e0*count(*)) AS shap_value
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1,2,3,4"""),
    "fx_sparse": ([], """
        SELECT last_day(l_shipdate) AS date, l_suppkey AS series,
               CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS value
        FROM lineitem GROUP BY 1,2"""),
    "fx_ends": ([], "SELECT last_day(min(o_orderdate)) AS first, last_day(max(o_orderdate)) AS last FROM orders"),
    "fx_archive": (["fx_history", "fx_ends"], f"""
        SELECT v.vintage_month, h.obs_date AS date, h.series_id, h.value
        FROM (SELECT last_day(CAST(m AS DATE)) AS vintage_month
              FROM (SELECT unnest(generate_series(date_trunc('month', DATE '{FIRST_VINTAGE}'), CAST(last + to_months({SNAPSHOTS_AFTER}) AS DATE), INTERVAL 1 MONTH)) AS m FROM fx_ends) g) v
        JOIN fx_history h ON v.vintage_month BETWEEN h.realtime_start AND h.realtime_end
        WHERE month(v.vintage_month) NOT IN (3, 8)"""),
    "fx_registry": ([], values_sql(
        REGISTRY, "series,kind,target,num,den,rule,lag_mode,lag_months,lag_schedule,tcode,grp")),
    "fx_regimes": ([], f"""SELECT episode, CAST(s AS DATE) AS start_date, CAST(e AS DATE) AS end_date
        FROM ({values_sql(REGIMES, 'episode,s,e')}) r"""),
}


def add_view(name: str, sql: str, needs: str = "") -> None:
    """Add a derived DuckDB view that later oracles may name in ``needs``."""
    SQL_VIEWS[name] = (needs.split(), sql)


def with_fixtures(needs: list[str], sql: str) -> str:
    """Prefix ``sql`` with the fixture views it needs, dependencies first."""
    done: dict[str, str] = {}

    def visit(n: str) -> None:
        if n not in done:
            deps, text = SQL_VIEWS[n]
            for d in deps:
                visit(d)
            done[n] = text

    for n in needs:
        visit(n)
    body = sql.strip()
    if not done:
        return body
    head = ",\n".join(f"{n} AS ({t.strip()})" for n, t in done.items())
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:].lstrip()}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:].lstrip()}"
    return f"WITH {head}\n{body}"
