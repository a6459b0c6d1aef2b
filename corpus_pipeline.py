"""The corpus pipeline: five stages over ``documents``, each written and reread.

quality classifier -> near-duplicates -> benchmark decontamination -> mixing ->
token files. A stage takes (spark, docs, sf_dir); all but the last return the
columns of ``documents``, the last one row per document written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from articlelab.llm import decontamination, mixing, near_dedup, quality, token_files
from articlelab.llm.common import materialize, prepare, scratch_path, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the classifier rejects go. Null and empty
    texts are scored like any other; no labels, nothing rejected."""
    prepare(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 (five-word shingles, similarity 0.8): the smallest id of each
    group stays. Wordless texts and null ids stay."""
    prepare(spark)
    return near_dedup.keep_one(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: contaminated documents go (a twentieth of their words or more
    lie in benchmark windows). Null texts stay."""
    prepare(spark)
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: every document as often as the mix takes it (not at all, up to three times)."""
    prepare(spark)
    return mixing.mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: token files in ascending doc_id order, and what reading them back gives."""
    prepare(spark)
    return token_files.read_token_files(token_files.write_token_files(docs, scratch_path(spark, "ids")))


STAGES = [("quality classifier", good_quality), ("MinHash near-dedup", one_of_each), ("benchmark decontamination", no_benchmark),
          ("mixing", mixed), ("token files", token_ids)]

#: Trained scores, set similarity and the tokenizer are beyond SQL; the tests
#: hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and reread."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
