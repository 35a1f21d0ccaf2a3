"""Tables on shared storage: appends, and a read of what may not be there yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to a table without reading or rewriting it."""
    df.write.mode("append").parquet(path)


def read_if_present(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """A parquet table, empty where its folder does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
