"""Incremental, restartable embedding of newly arrived article files.

A file-source stream picks up new parquet/CSV files under a folder; each
micro-batch is embedded with the ordinary batch operators inside
``foreachBatch`` and written to ``<sink>/batch_id=<n>`` with overwrite, so
a replayed batch rewrites its own folder (idempotent) and the checkpoint
makes a restart skip files already done. ``trigger(availableNow=True)``
processes what is there and stops.
"""

from __future__ import annotations

from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def embed_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                 embed: Callable[[DataFrame], DataFrame], fmt: str = "parquet",
                 glob: str | None = None, max_files: int = 1, max_bytes: int | None = None) -> int:
    """Run the stream to completion (available-now); returns the number of
    micro-batches run in this call. A micro-batch takes ``max_files`` files, or, with
    ``max_bytes``, as many as have that many bytes (one at least)."""
    limit = ("maxFilesPerTrigger", max_files) if max_bytes is None else ("maxBytesPerTrigger", max_bytes)
    reader = spark.readStream.schema(schema).option(*limit)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.format(fmt).load(source)
    ran = []

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = embed(batch)
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        ran.append(batch_id)

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(ran)


def read_sink(spark: SparkSession, sink: str, schema: str | None = None) -> DataFrame:
    """All micro-batches written so far; an empty or missing sink is an empty
    table of ``schema``."""
    try:
        return spark.read.parquet(sink)
    except AnalysisException as e:
        if schema is None or e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def vocabulary_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str,
                      tokens: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] | None = None,
                      fmt: str = "parquet", glob: str | None = None, max_files: int = 1) -> int:
    """F5 + T1: the vocabulary of arriving files. ``tokens`` turns rows into a column
    ``token``; tokens seen before are keyed state of the stream, kept in the
    checkpoint, so every token leaves once, however many files, micro-batches
    and restarts lie between. ``keep`` (a batch operator, such as a join with the
    words that have vectors) is applied to the new ones, which land in
    ``<sink>/batch_id=<n>``. Returns the micro-batches run in this call."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    new = tokens(reader.format(fmt).load(source)).dropDuplicates(["token"])
    ran = []

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = keep(batch) if keep else batch
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")
        ran.append(batch_id)

    q = (new.writeStream.outputMode("append").foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return len(ran)
