"""Readers of the test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch; texts can be long, and workers have little memory.
BATCH_ROWS = 2_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of the folder; only columns and rows that are used are read."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spaces_only(sql: str) -> str:
    """The SQL with every ``trim(x)`` taking spaces alone, as Spark's does."""
    return re.sub(r"\btrim\(([^(),]+)\)", r"trim(\1, ' ')", sql)
