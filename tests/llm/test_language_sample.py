"""A rare language in a large table."""

from pyspark.sql import functions as F

from monthspine.llm import language


def test_rare_language_is_learned(spark):
    common_rows = spark.range(3000).select("id", F.lit("das ist ein haus am see").alias("text"), F.lit("de").alias("lang"))
    rare = spark.range(3000, 3005).select("id", F.lit("this is the house by the lake").alias("text"), F.lit("en").alias("lang"))
    docs = common_rows.unionByName(rare).withColumnRenamed("id", "doc_id")
    kept = language.sample_of_each(docs.withColumnRenamed("doc_id", "id"), 30).groupBy("lang").count().collect()
    sizes = {r["lang"]: r["count"] for r in kept}
    assert sizes["en"] == 5 and 10 < sizes["de"] < 60
    assert language.fit_language(docs, rows=30).languages == ("de", "en")


def test_many_languages_join_on_salts(spark):
    rows = spark.range(4_000).selectExpr("id", "concat('t', id) AS text", "IF(id % 3 = 0, 'big', concat('l', id % 40)) AS lang")
    draw = lambda few: sorted((r.lang, r.id) for r in language.sample_of_each(rows, 20, few).collect())
    assert draw(0) == draw(1_000) and len({lang for lang, _ in draw(0)}) == 41
