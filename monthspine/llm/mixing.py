"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source of size S (words) with target T takes each of its documents floor(T / S) times for certain. What is left of the
target, R words, is drawn as one more copy of some documents. Their inclusion probabilities are unequal: p = level * grade,
where the grade of a document is the number of binary digits of its size, so that texts with context go before fragments.
The level is set so that the expected words are R; grades that it would lift above one are certain, and the level of the
others follows from what they leave. With a random number u from a hash of id and text, the documents of a source are
ranked by the Pareto ratio of odds (u / (1 - u)) / (p / (1 - p)), smallest first, certain ones before. The sample is of
fixed size: ranks are taken up to the point where the sum of their sizes comes nearest to R, so a source misses its target
by half a document at most.

Ranking a hot source must not gather its rows in one task. Ratios q fall into buckets of 1 - 1 / (1 + q); running sums go
over the bucket totals, and only the one bucket per source in which the target lies is ranked. It lies near q = 1, where a
bucket has about ``bucket_rows`` documents at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, times: int = 3, source_col: str = "source") -> DataFrame:
    """(source, source_size, target): the weights share all words; no target exceeds ``times`` the source's size.

    Sources weigh in turn by code point order, null last. Resharing the excess until nothing exceeds its bound ends at
    one level: a target is the smaller of its bound and level times weight. Sorted by bound per weight, the level follows
    from sums over the sources before and after. One row per source here, not per document.
    """
    by_source = sized.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col(source_col).asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    s = by_source.withColumn("weight", weight).withColumn("bound", F.lit(float(times)) * F.col("source_size"))
    fill = W.orderBy(F.col("bound") / F.col("weight"), F.col(source_col).asc_nulls_last())
    before, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the first source whose bound is not reached sets the level of all after it; before it, bounds hold
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct(F.col("bound") / F.col("weight"), "level"))).over(everything)["level"]
    return s.withColumn("open", open_level).select(
        source_col,
        "source_size",
        F.when(F.col("open").isNull(), F.col("bound")).otherwise(F.least(F.col("bound"), F.col("open") * F.col("weight"))).alias("target"),
    )


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def size_grade(size: Column) -> Column:
    """Binary digits of a size; 0 for 0."""
    return F.when(size > 0, F.length(F.bin(size))).otherwise(0).cast("long")


def inclusion_levels(grades: DataFrame, targets: DataFrame, times: int = 3) -> DataFrame:
    """Targets with the certain copies, the words still wanted, the level and the greatest grade that is not certain.

    ``grades`` has one row per source and grade with the words of that grade (``size``): some sixty rows a source.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    t = targets.withColumn("certain", F.least(F.floor(ratio), F.lit(times)).cast("long"))
    t = t.withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))
    g = grades.filter("grade > 0").join(t.select(F.col("source").alias("t_source"), "wanted"), _same(F.col("source"), F.col("t_source")))
    down = W.partitionBy("source").orderBy(F.desc("grade"))
    above = F.coalesce(F.sum("size").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("grade") * F.col("size")).over(down.rowsBetween(0, W.unboundedFollowing))
    g = g.withColumn("level", (F.col("wanted") - above) / open_).filter("level * grade <= 1")
    # the fewest certain grades that leave no probability above one
    g = g.groupBy(F.col("source").alias("g_source")).agg(F.max_by("level", "grade").alias("level"), F.max("grade").alias("top"))
    return t.join(g, _same(F.col("source"), F.col("g_source")), "left").drop("g_source")


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    times: int = 3,
    bucket_rows: int = 500,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 7,
    keep: tuple[str, ...] = (),
    prefix: str = "",
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (whole copies the mix takes), taken = copies * size.

    Null text: size 0. A null source is a source of its own. A document without words takes the certain copies only.
    Rows with one id and one text share one random number; the same rows give the same mix in every run. ``keep`` are further columns to carry; ``prefix`` is put before the names of the added ones. An empty table gives
    no row.
    """
    rename = {c: f"k_{c}" for c in keep}
    # 52 random bits, so that u is exact and never 0 or 1
    by_text = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), by_text))
    random = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    size = word_count(F.col(text_col))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        size_grade(size).alias("grade"),
        ((random + 0.5) / F.lit(float(2**52))).alias("u"),
        *[F.col(c).alias(k) for c, k in rename.items()],
    )
    sized = stored(spark, sized, "mix-sizes")
    grades = sized.groupBy("source", "grade").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    grades = stored(spark, grades, "mix-grades")
    targets = stored(spark, inclusion_levels(grades, source_targets(grades, weights, times), times), "mix-targets")
    n = grades.agg(F.sum("n").alias("n")).first().n or 0
    buckets = max(1, n // bucket_rows)
    rows = sized.join(targets.withColumnRenamed("source", "t_source"), _same(F.col("source"), F.col("t_source")))
    p = F.when((F.col("grade") == 0) | (F.col("certain") >= times) | (F.col("wanted") <= 0), 0.0)
    p = p.when(F.col("grade") > F.coalesce("top", F.lit(0)), 1.0).otherwise(F.col("level") * F.col("grade"))
    rows = rows.withColumn("p", p)
    pareto = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("rank_key", F.when(F.col("p") >= 1, 0.0).when(F.col("p") > 0, pareto))
    # each step keeps the order of the ratios, so buckets are ranges of ranks; certain ones lie before all others
    bucket = F.floor((1 - 1 / (1 + F.col("rank_key"))) * buckets).cast("long")
    rows = rows.withColumn("bucket", F.when(F.col("p") >= 1, F.lit(-1).cast("long")).otherwise(bucket))
    totals = rows.filter("rank_key is not null").groupBy("source", "bucket").agg(
        F.sum("size").alias("words"),
        F.first("wanted").alias("wanted"),
    )
    upto = W.partitionBy("source").orderBy("bucket")
    totals = totals.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    cut = totals.filter((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") >= F.col("wanted")))
    cut = stored(spark, cut.select(F.col("source").alias("c_source"), F.col("bucket").alias("cut"), "before"), "mix-cuts")
    rows = rows.join(cut, _same(F.col("source"), F.col("c_source")), "left")
    here = F.col("rank_key").isNotNull() & (F.col("bucket") == F.col("cut"))
    whole = F.col("rank_key").isNotNull() & F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False))
    columns = ["id", "source", "size", "source_size", "target", *rename.values()]
    plain = rows.filter(~F.coalesce(here, F.lit(False))).select(*columns, (F.col("certain") + whole.cast("long")).alias("copies"))
    ranked = W.partitionBy("source").orderBy("rank_key", "id", "size").rowsBetween(W.unboundedPreceding, -1)
    edge = rows.filter(here).withColumn("sum", F.col("before") + F.coalesce(F.sum("size").over(ranked), F.lit(0)))
    # the row that crosses the target is taken if that comes nearer to it
    more = (F.col("sum") < F.col("wanted")) & (F.col("sum") + F.col("size") - F.col("wanted") <= F.col("wanted") - F.col("sum"))
    edge = edge.select(*columns, (F.col("certain") + more.cast("long")).alias("copies"))
    out = plain.unionByName(edge).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        *[F.col(k).alias(c) for c, k in rename.items()],
        *[F.col(c).alias(prefix + c) for c in ("size", "source_size", "target", "copies", "taken")],
    )


def op7_mixing(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix_sources(spark, docs).select("doc_id", "size", "source_size", "target", "taken")


#: One ranking over each whole source; every sum is of whole numbers, so both engines agree to the last bit.
OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS bound,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(bound) OVER (
              ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
o AS (SELECT arg_min(level, bound / weight) AS level FROM l WHERE level * weight <= bound),
t AS (SELECT source, source_size, CASE WHEN o.level IS NULL THEN bound ELSE least(bound, o.level * weight) END AS target FROM l, o),
v AS (
  SELECT *, target - certain * source_size AS wanted
  FROM (SELECT *, least(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END), 3)::BIGINT AS certain FROM t) x),
r AS (
  SELECT d.*, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS grade,
         (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0::DOUBLE AS u
  FROM d),
g AS (SELECT source, grade, sum(size) AS words FROM r WHERE grade > 0 GROUP BY 1, 2),
h AS (
  SELECT g.source, grade, (wanted - coalesce(sum(words) OVER (
           PARTITION BY g.source ORDER BY grade DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(grade * words) OVER (
           PARTITION BY g.source ORDER BY grade DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM g JOIN v ON g.source IS NOT DISTINCT FROM v.source),
b AS (SELECT source, arg_max(level, grade) AS level, max(grade) AS top FROM h WHERE level * grade <= 1 GROUP BY 1),
c AS (
  SELECT r.*, v.source_size, v.target, v.certain, v.wanted,
         CASE WHEN grade = 0 OR certain >= 3 OR wanted <= 0 THEN 0 WHEN grade > coalesce(top, 0) THEN 1 ELSE level * grade END::DOUBLE AS p
  FROM r JOIN v ON r.source IS NOT DISTINCT FROM v.source LEFT JOIN b ON r.source IS NOT DISTINCT FROM b.source),
q AS (SELECT *, CASE WHEN p >= 1 THEN 0 WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END::DOUBLE AS rank_key FROM c),
k AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank_key NULLS LAST, doc_id, size
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM q)
SELECT doc_id, size, source_size, target,
       size * (certain + (rank_key IS NOT NULL AND before < wanted AND before + size - wanted <= wanted - before)::BIGINT) AS taken
FROM k
"""
