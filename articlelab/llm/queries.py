"""Registered queries of the training-data operators, production parameters,
whole tables. ``QUERIES``: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articlelab.llm import (
    decontamination, exact_dedup, line_dedup, manifest, mixing, near_dedup, quality, repeat_index, secret_scan, sharding, token_files, url_filter, whitening)
from articlelab.llm.common import materialize, prepare, scratch_path, table


def op1_repeat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each document inside 200-byte strings that start elsewhere too."""
    prepare(spark)
    out = repeat_index.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the rows that are not held out."""
    prepare(spark)
    stats = materialize(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    return quality.score_statistics(stats, quality.fit_quality(stats, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside 13-word windows of benchmark items."""
    prepare(spark)
    hits = decontamination.contamination(decontamination.benchmark_hits(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return hits.select(F.col("_id").alias("doc_id"), F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"),
                       F.size("_items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
                       F.col("_contaminated").alias("contaminated"))


def op4_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of near-equal bytes; equal texts together."""
    prepare(spark)
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share four fifths of their 2-word shingles."""
    prepare(spark)
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to seekable files in doc_id order and read back."""
    prepare(spark)
    written = token_files.write_token_files(table(spark, sf_dir, "documents"), scratch_path(spark, "ids"))
    return token_files.read_token_files(written)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by pattern, and strings that a primed compressor cannot predict."""
    prepare(spark)
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the lines that over a tenth of their host's pages carry."""
    prepare(spark)
    return line_dedup.site_line_dedup(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts, byte for byte; the largest doc_id stays."""
    prepare(spark)
    return exact_dedup.content_sort_dedup(table(spark, sf_dir, "documents"), normalise="none", keep="largest")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the weighted mix takes of each document."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mixing.with_copies(docs)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings whitened on up to eight components of their covariance."""
    prepare(spark)
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of the documents, and which rows a change of n_chars betrays."""
    prepare(spark)
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    return manifest.manifest(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                             changed={"n_chars": F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page: the longest rule's, else by its host's trust and distrust."""
    prepare(spark)
    return url_filter.filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (
    op1_repeat_index, op2_quality, op3_decontamination, op4_kd_sharding, op5_near_dedup, op6_token_files, op7_secret_scan, op8_line_dedup, op9_exact_dedup, op10_mixing,
    op11_whitening, op12_manifest, op13_url_filter)}
