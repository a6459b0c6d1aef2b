"""Driver tables and the views derived from them (FIXTURES.md part B).

Every view is a lazy DataFrame over the parquet tables, so its work grows
with the data. The derivation rules (which rows get a null or blank text,
how scores are cut from embeddings) are fixed test-fixture rules, not
filters: no view drops rows to save work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# ---------------------------------------------------------------------------
# Fixed fixture rules (FIXTURES.md part B).
WIKIHOW_NULL_EVERY = 97      # wikihow.text is null when doc_id % 97 = 0
DIRTY_NULL_EVERY = 11        # dirty.text is null when doc_id % 11 = 0
DIRTY_BLANK_EVERY = 13       # dirty.text is blank when doc_id % 13 = 0
DIRTY_BLANK_TEXT = " \t "
SCORE_EPOCHS = 7             # 7 epochs of 10 class scores per embedding row: all
SCORE_CLASSES = 10           # 64 values, the last epoch going on from the first again
TEST_EVERY = 5               # split = test when vec_id % 5 = 0
EVAL_BATCH = 32              # batch_id = 32 rows of a split in id order
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are about to be tokenised, in enough partitions
    (see ``operators.rows.spread``)."""
    from articlelab.operators.rows import spread
    return spread(table(spark, sf_dir, name))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, type, text): labelled documents, type human/gpt."""
    docs = text_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        "doc_id",
        F.when(F.col("quality") == 1, F.lit("human")).otherwise(F.lit("gpt")).alias("type"),
        "text")


def wikihow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, title, headline, sectionLabel, text) in WikiHow shape."""
    d = table(spark, sf_dir, "documents")
    first_line = F.substring_index(F.col("text"), "\n", 1)
    return d.select(
        "doc_id",
        F.concat(F.lit("  "), first_line, F.lit("  "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("headline"),
        F.col("lang").alias("sectionLabel"),
        F.when(F.col("doc_id") % WIKIHOW_NULL_EVERY == 0, F.lit(None).cast("string"))
         .otherwise(F.col("text")).alias("text"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, type, text) with injected null and blank texts."""
    d = table(spark, sf_dir, "documents")
    text = (F.when(F.col("doc_id") % DIRTY_NULL_EVERY == 0, F.lit(None).cast("string"))
            .when(F.col("doc_id") % DIRTY_BLANK_EVERY == 0, F.lit(DIRTY_BLANK_TEXT))
            .otherwise(F.col("text")))
    return d.select("doc_id", F.col("lang").alias("type"), text.alias("text"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, split, batch_id, epoch, logits ARRAY<DOUBLE>):
    seven "epochs" of ten class scores cut from each embedding row."""
    from articlelab.operators.sampling import fixed_batches
    split = F.when(F.col("vec_id") % TEST_EVERY == 0, F.lit("test")).otherwise(F.lit("train"))
    e = fixed_batches(table(spark, sf_dir, "embeddings").withColumn("split", split), "vec_id", EVAL_BATCH, ["split"])
    epochs = F.sequence(F.lit(1), F.lit(SCORE_EPOCHS)).cast("array<bigint>")
    return (e.select(
                "vec_id", "label", F.concat("embedding", "embedding").alias("embedding"), "split", "batch_id",
                F.explode(epochs).alias("epoch"))
            .select("vec_id", "label", "split", "batch_id", "epoch",
                    F.transform(F.slice("embedding", (F.col("epoch") - 1) * SCORE_CLASSES + 1, SCORE_CLASSES),
                                lambda x: x.cast("double")).alias("logits")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, split, features ARRAY<DOUBLE>): the embedded table."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "label",
        F.when(F.col("vec_id") % TEST_EVERY == 0, F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))


# Fixed rule of the run fixture: one embedder name without "_" and one
# missing metric (FIXTURES.md "runs").
RUN_PREFIX = "W2V"
RUN_NO_UNDERSCORE = (6, 0)          # (epoch, batch_id)
RUN_NULL_ACCURACY = (3, "test", 0)  # (epoch, split, batch_id)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(embedder_name, epoch, split, batch_id, accuracy, loss): one "run"
    per scored (epoch, split, batch) of the score fixture."""
    from articlelab.operators.metrics import batch_losses, score_rows
    b = batch_losses(score_rows(scores(spark, sf_dir)), ["epoch", "split"])
    e, bid = RUN_NO_UNDERSCORE
    ne, ns, nb = RUN_NULL_ACCURACY
    name = (F.when((F.col("epoch") == e) & (F.col("batch_id") == bid),
                   F.concat(F.lit(RUN_PREFIX), F.col("epoch").cast("string")))
            .otherwise(F.concat(F.lit(RUN_PREFIX), F.col("epoch").cast("string"), F.lit("_"), F.col("split"))))
    acc = (F.when((F.col("epoch") == ne) & (F.col("split") == ns) & (F.col("batch_id") == nb),
                  F.lit(None).cast("double"))
           .otherwise(F.col("correct") / F.col("n")))
    return b.select(name.alias("embedder_name"), "epoch", "split", "batch_id",
                    acc.alias("accuracy"), F.col("mean_loss").alias("loss"))
