"""Session settings the operators are written for."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "monthspine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; existing cluster settings stay as they are."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        b = b.config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        b = b.config(key, value)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only on a local master without any."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set on this cluster")
        configured = tempfile.mkdtemp(prefix="run-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def written(df: DataFrame, tag: str = "table") -> DataFrame:
    """The rows as Parquet in the shared checkpoint folder: computed once, with statistics, and kept if executors are lost."""
    path = posixpath.join(ensure_checkpoint_dir(df.sparkSession), f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
