"""Samples for fitting: never empty by the size of the table."""

import pytest
from pyspark.sql import functions as F

from monthspine.llm import common


def test_rate_below_a_millionth():
    assert common.sample_bound(400, 10**9) / 2**63 == pytest.approx(400 / 10**9)
    assert common.sample_bound(6000, 10**13) > 0


def test_sample_size(spark):
    df = spark.range(20_000)
    assert 400 < common.bounded_sample(df, 500, F.col("id")).count() < 600
    assert common.bounded_sample(df, 20_000, F.col("id")).count() == 20_000


@pytest.mark.parametrize("one", ["1L", "CAST(NULL AS BIGINT)", "IF(id % 3 = 0, 7L, id)"])
def test_few_ids_are_drawn_by_content(spark, one):
    df = spark.range(20_000).selectExpr(f"{one} AS doc_id", "concat('text ', id) AS text")
    draw = lambda: sorted(r.text for r in common.bounded_sample(df, 500, F.col("doc_id"), F.col("text")).collect())
    got = draw()
    assert 250 <= len(got) <= 1000 and got == draw()


def test_equal_rows_fill_a_sample(spark):
    df = spark.range(20_000).selectExpr("1L AS doc_id", "'the same' AS text")
    assert common.bounded_sample(df, 500, F.col("doc_id"), F.col("text")).count() == 500


@pytest.fixture(scope="module")
def one_id(spark):
    """More rows than any sample, all with one id, and columns of names that operators use."""
    text = "CASE WHEN id % 5 = 0 THEN '### $$$ ||| %%%' ELSE concat('A plain sentence about the weather number ', id, '.') END"
    return spark.range(9_000).selectExpr("3L AS doc_id", f"{text} AS text", "'en' AS lang", "'a' AS source", "1 AS toxic", "0.5 AS score", "id AS n")


def test_operators_take_one_id(spark, one_id):
    from monthspine.llm import html_text, language, quality, rules, toxicity

    assert rules.op10_rules(one_id).count() == 9_000
    assert quality.op3_quality(one_id).count() == 9_000
    assert {r.lang_pred for r in language.op9_language(one_id).select("lang_pred").distinct().collect()} == {"en", "und"}
    pages = one_id.limit(900).selectExpr("doc_id AS page_id", "'u' AS url", "concat('<main><p>', text, '</p></main>') AS html", "1 AS text")
    assert html_text.op1_main_text(pages).count() == 900
    nulls = one_id.withColumn("doc_id", F.lit(None).cast("long"))
    assert rules.op10_rules(nulls).count() == 9_000 and quality.op3_quality(nulls).count() == 9_000
    labels = spark.createDataFrame([(3, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.op6_toxicity(one_id, labels).count() == 9_000
    assert toxicity.training_rows(one_id, labels).count() == 1
