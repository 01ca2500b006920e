"""Size checks in front of broadcasts, and durable cuts of the lineage."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import ensure_checkpoint_dir

#: Largest table, in rows and in bytes of its strings, that is broadcast explicitly.
MAX_BROADCAST_ROWS = 400_000
MAX_BROADCAST_BYTES = 48 << 20


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_written: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended, and the folder with it
            pass


atexit.register(_remove_written)


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and written, compressed and by column, to the shared checkpoint folder.

    For tables that are wide or read several times by different columns. The
    files are removed when the interpreter ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and an estimate of its bytes; ``df`` should be materialised."""
    width = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind == "string":
            width += F.coalesce(F.octet_length(col), F.lit(0)) + 16
        elif kind.startswith(("array", "map", "struct")):
            width += F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) + 16
        else:
            width += 8
    row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return int(row[0]), int(row[1])


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS, size: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it was measured to be under both bounds.

    Beyond a bound it is returned unchanged, and the join is planned as a
    shuffled one, whose skew adaptive execution splits.
    """
    n, octets = measured(df)
    return F.broadcast(df) if n <= rows and octets <= size else df
