"""Small literal tables with known statistics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a local relation: unlike a parallelised list its size is known, so joins broadcast it."""
    fields = T.StructType.fromDDL(schema).fields
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=[f.name for f in fields]))
