"""Exact deduplication by a distributed content sort (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articlelab.llm.common import materialize, text_or_empty

#: Normalisations a caller may name.
NORMALISERS = {
    "none": lambda t: t,
    "trim": F.trim,
    "lower_space": lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " ")),
}


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       normalise: str = "none", keep: str = "smallest", salts: int = 256) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Sampled splitters range-partition the rows by (first bytes, hash, salt) of
    the normalised text, the partitions are sorted externally by those and the
    whole text, and neighbours with equal whole texts form a run. The first
    bytes and the hash keep the sampled splitters short whatever the texts are.
    The salt (a hash of the id) cuts a text with very many copies into ``salts``
    runs over several partitions; what is then folded by text digest is one
    row per run, so at most ``salts`` rows per text meet in a task.

    Null text counts as empty. ``keep`` is ``smallest`` or ``largest`` id; a
    null id loses to any other. Of rows that repeat id and text one is kept.
    An empty table gives no rows; other columns are not read.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    text: Column = NORMALISERS[normalise](text_or_empty(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).select(
        "_id", "_t", F.substring("_t", 1, 16).alias("_head"), F.xxhash64("_t").alias("_hash"),
        F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"))
    dealt = rows.repartitionByRange("_head", "_hash", "_salt")
    run = Window.partitionBy("_head", "_hash", "_salt", "_t")
    first = F.col("_id").asc_nulls_last() if keep == "smallest" else F.col("_id").desc_nulls_last()
    best = F.min if keep == "smallest" else F.max
    narrow = materialize(dealt.select(
        "_id", "_salt", F.sha2("_t", 256).alias("_sha"),
        F.count(F.lit(1)).over(run).alias("_n"), best("_id").over(run).alias("_best"),
        F.row_number().over(run.orderBy(first)).alias("_rank")), "content-sort")
    whole = Window.partitionBy("_sha")
    runs = narrow.filter("_rank = 1").select("_sha", "_salt", "_n", "_best")
    order = F.col("_best").asc_nulls_last() if keep == "smallest" else F.col("_best").desc_nulls_last()
    merged = runs.select(
        F.col("_sha").alias("_r_sha"), F.col("_salt").alias("_r_salt"),
        F.sum("_n").over(whole).alias("_size"), best("_best").over(whole).alias("_keep"),
        (F.row_number().over(whole.orderBy(order, "_salt")) == 1).alias("_lead"))
    out = narrow.join(merged, (F.col("_sha") == F.col("_r_sha")) & (F.col("_salt") == F.col("_r_salt")))
    return out.select(F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"),
                      F.col("_size").cast("long").alias("group_size"),
                      (F.col("_lead") & (F.col("_rank") == 1)).alias("kept"),
                      F.col("_sha").alias("text_sha256"))
