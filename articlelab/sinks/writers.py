"""Sinks (B1-B4, B6, B7 are in their operator modules).

Writers are distributed (one file per task); nothing is gathered to the
driver. Batch outputs are partition folders with dynamic overwrite, so a
re-run of one batch replaces only that batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articlelab.operators.encode import expand_features


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", widths: dict | None = None) -> None:
    """B1: CSV with a header; array vectors are expanded to ``f0..``.
    Pass ``widths`` ({column: width}) when known, to skip the extra job that
    measures them."""
    arrays = [f.name for f in df.schema.fields if f.dataType.typeName() == "array"]
    for col in arrays:
        width = (widths or {}).get(col)
        if width is None:
            width = df.select(F.max(F.size(col))).first()[0] or 0
        df = expand_features(df, width, col)
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_batches(df: DataFrame, path: str, batch_col: str = "batch_no", fmt: str = "parquet") -> None:
    """B2: one output folder per batch; dynamic partition overwrite
    replaces only the batches present in ``df`` (resume-friendly, B3).

    Rows are dealt by batch first: a batch is written by one task as one file, so
    files grow with the batches and not with batches times tasks. The number of
    tasks is given, else so few bytes would be laid together in one of them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = df.repartition(tasks, batch_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def finished_batches(spark, path: str, batch_col: str = "batch_no") -> DataFrame:
    """Batch numbers already written under ``path``, as Spark's own
    readers see it; a missing or empty folder has none."""
    try:
        return spark.read.parquet(path).select(F.col(batch_col).cast("bigint")).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], f"{batch_col} bigint")


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON document per record (line-delimited)."""
    df.write.mode(mode).json(path)
