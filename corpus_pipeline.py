"""A text corpus made ready for training: five stages, each an operator of monthspine.llm over all its predecessor kept.

Every stage is written as Parquet in the shared folder and read again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthspine.llm.common import stored, table, unused_prefix
from monthspine.llm.decontaminate import without_benchmark
from monthspine.llm.mixing import mix_sources
from monthspine.llm.quality import fit_quality, good_documents
from monthspine.llm.simhash import one_of_each
from monthspine.llm.tokens import op4_tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer keeps; null, empty and blank texts go."""
    return good_documents(docs, fit_quality(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest id."""
    return one_of_each(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return without_benchmark(spark, docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it takes no copy of go."""
    columns = docs.columns
    others = tuple(c for c in columns if c not in ("doc_id", "source"))
    mark = unused_prefix(docs, "size", "source_size", "target", "copies", "taken", "copy")
    mixed = mix_sources(spark, docs, keep=others, prefix=mark)
    copies = F.array_repeat(F.lit(1), F.col(mark + "copies").cast("int"))
    return mixed.withColumn(mark + "copy", F.explode(copies)).select(*columns)


def token_binary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix in id order (copies one after another), and a row per document from them."""
    return op4_tokens(spark, docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", source_mixing),
    ("token binary", token_binary),
]

#: Fingerprints, walks, model weights and token ids are not to be had in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
