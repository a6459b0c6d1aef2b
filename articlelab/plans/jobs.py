"""Job entry points (P1-P15): each command of the reference as one
function over DataFrames. Every job reads with an explicit schema, runs
as lazy Spark plans and writes with distributed writers; only bounded
results (class maps, run records, weights) ever reach the driver.
"""

from __future__ import annotations

import os
from typing import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articlelab.functions import text as T
from articlelab.operators import cleaning as C
from articlelab.operators import encode as EN
from articlelab.operators import images as IM
from articlelab.operators import labels as L
from articlelab.operators import metrics as M
from articlelab.operators import runs as R
from articlelab.operators import sampling as D
from articlelab.operators.keys import DEFAULT_SEED, TRAIN_SHARE
from articlelab.operators.rows import spread
from articlelab.session import materialize
from articlelab.sinks import writers as SK
from articlelab.sources import csv_index as CI
from articlelab.sources import files as FS
from articlelab.train import exact_stumps as EX
from articlelab.train import local_steps as LS
from articlelab.train import networks as NN
from articlelab.train import samme as SA

# Fixed defaults of the reference's commands.
SUBSET_ROWS = 200_000
STRATA = ("human", "gpt")
STRATUM_ROWS = 50_000
EMBED_BATCH = 5_000
EPOCHS = 10
LEARNING_RATE = 0.001


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C11: fail early when a required column is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"Missing column(s): {missing}")
    return df


def row_at(numbered: DataFrame, idx: int, row_col: str = "file_row") -> DataFrame:
    """The row at 0-based position ``idx`` of a scan with file order."""
    return numbered.where(F.col(row_col) == idx)


def samples_and_labels(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``X`` = everything but the label, ``y`` = the label."""
    require_columns(df, ["label"])
    return df.drop("label"), df.select("label")


# -- P1, P2, P9 -------------------------------------------------------------
def get_wikihow_subset(spark: SparkSession, csv_path: str, subset_path: str | None = None,
                       n_rows: int = SUBSET_ROWS, seed: int = DEFAULT_SEED) -> DataFrame:
    """WikiHow CSV -> cleaned, numbered, exact seeded sample."""
    keyed = FS.read_csv(spark, csv_path, FS.WIKIHOW_SCHEMA, file_order="file_row")
    out = C.wikihow_subset(keyed, n_rows, seed, order_col="file_row").drop("file_row")
    if subset_path:
        SK.write_csv(out, subset_path)
    return out


def get_queries(spark: SparkSession, subset_path: str, queries_path: str | None = None) -> DataFrame:
    """Prompt per subset row."""
    schema = "original_row_number bigint, title string, headline string, sectionLabel string, length string"
    out = C.with_prompts(FS.read_csv(spark, subset_path, schema)).select("query")
    if queries_path:
        SK.write_csv(out, queries_path)
    return out


def get_and_store_subset(spark: SparkSession, csv_path: str, subset_path: str | None = None,
                         n: int = STRATUM_ROWS, seed: int = DEFAULT_SEED) -> DataFrame:
    """Exactly n rows per class (human, gpt), stacked, type + text."""
    raw = FS.read_csv(spark, csv_path, file_order="file_row")
    out = D.stratified_sample(raw, "file_row", "type", STRATA, n, seed).select("type", "text")
    if subset_path:
        SK.write_csv(out, subset_path)
    return out


# -- P3, P7, P8 -------------------------------------------------------------
def load_pretrained(name: str, **kw) -> EN.Encoder:
    """An encoder by registry name; the name is required (Q21)."""
    return EN.Encoder.registry[name].pretrained(**kw)


def train_embedder(spark: SparkSession, csv_path: str, save_path: str, vector_size: int = 100,
                   seed: int = DEFAULT_SEED, train_share: float = TRAIN_SHARE) -> EN.Word2VecEncoder:
    """Word vectors from the train split only, saved as a table."""
    raw = FS.read_csv(spark, csv_path, file_order="doc_id")
    train = D.with_split(raw, "doc_id", seed, train_share).where(F.col("split") == "train")
    enc = EN.Word2VecEncoder(dim=vector_size).fit(train)
    enc.save(save_path)
    return enc


def train_vocab_embedder(spark: SparkSession, csv_path: str, save_path: str, dim: int = 8,
                         seed: int = DEFAULT_SEED) -> EN.MeanWordVectorEncoder:
    """Vocabulary fitted on the train split (M5); the vector table is
    written as parquet (B6)."""
    raw = FS.read_csv(spark, csv_path, file_order="doc_id")
    train = D.with_split(raw, "doc_id", seed).where(F.col("split") == "train")
    enc = EN.MeanWordVectorEncoder(dim).fit(train)
    enc.save(save_path)
    return enc


# -- P4-P6, P10 -------------------------------------------------------------
def embed_csv_batches(spark: SparkSession, csv_path: str, out_path: str, encoder: EN.Encoder,
                      batch_size: int = EMBED_BATCH, literal_type: str | None = None,
                      class_map: dict | None = None, stop_before: int | None = None, range_bytes: int = CI.RANGE_BYTES) -> DataFrame:
    """Tolerant scan, clean-up, embed, one output folder per
    batch of ``batch_size`` file rows; batches already written are skipped
    (resume, B3). All batches are embedded once (Q5).

    A row's id is its position in file order, so equal articles stay apart and
    rows appended to the file leave earlier batches as they are. The batch
    number goes through the encoder with the id. Class numbers come from
    the whole file, whatever is pending. ``stop_before`` ends a run early.

    The first run makes an index of the files and the class map and stores
    them beside the batches; a later run over the same files opens only the
    stretches of bytes that hold pending rows."""
    index, fresh = CI.stored_index(spark, csv_path, f"{out_path}/_index", range_bytes)
    ready = None if fresh else _stored_classes(spark, f"{out_path}/_classes")
    mapping = L.literal_map(spark, class_map) if class_map else ready
    if mapping is None:
        everything = C.clean_articles(CI.read_ranges(index.where("n_rows > 0")).drop("repaired"), literal_type)
        L.class_map(everything, "type", "label").write.mode("overwrite").parquet(f"{out_path}/_classes")
        mapping = _stored_classes(spark, f"{out_path}/_classes")
    # read several times below: the folders are listed once
    done = materialize(SK.finished_batches(spark, out_path), "finished-batches")
    pending = materialize(CI.pending_ranges(index, done, batch_size, stop_before=stop_before), "pending-ranges")
    if not pending.isEmpty():
        rows = CI.read_ranges(pending).drop("repaired").withColumn("batch_no", F.expr(f"file_row div {int(batch_size)}"))
        arts = D.pending_batches(C.clean_articles(rows, literal_type), done)
        if stop_before is not None:
            arts = arts.where(F.col("batch_no") < stop_before)
        out = EN.embedded_table(spread(arts), encoder, split_col=None, id_col="file_row", mapping=mapping, carry=["batch_no"])
        SK.write_batches(out, out_path)
    return spark.read.parquet(out_path)


def _stored_classes(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def embed_raw_data(spark: SparkSession, csv_path: str, encoder: EN.Encoder, train_path: str,
                   test_path: str, seed: int = DEFAULT_SEED, n_rows: int | None = None,
                   train_share: float = TRAIN_SHARE) -> DataFrame:
    """P10: split, embed both sides with one class map, write
    ``label, f0..`` CSVs."""
    raw = FS.read_csv(spark, csv_path, file_order="doc_id")
    split = D.with_split(raw, "doc_id", seed, train_share, n_rows)
    emb = EN.embedded_table(split, encoder)
    for side, path in (("train", train_path), ("test", test_path)):
        SK.write_csv(emb.where(F.col("split") == side).select("label", "features"), path)
    return emb


# -- P11-P13 ----------------------------------------------------------------
def train_nn_model(spark: SparkSession, ds: str, dim: int, model_name: str, save_dir: str,
                   test_ds: str | None = None, epochs: int = EPOCHS, learning_rate: float = LEARNING_RATE,
                   seed: int = DEFAULT_SEED, output: str = "logits", batch_size: int | None = None) -> DataFrame:
    """Embedded CSV(s) -> labels re-indexed on the union -> trainer ->
    run JSON (series + confusion maps, outer = predicted) + weights."""
    ds_name, enc_name = R.path_names(spark, ds)
    data = FS.train_test_pair(spark, ds, test_ds, dim, seed)
    data = L.dense_labels(data, "label", "label")
    data = data.withColumnRenamed("row_id", "vec_id")
    k = data.select("label").distinct().count()
    model = NN.Network.registry[model_name](dim, k, learning_rate=learning_rate, seed=seed, output=output)
    res = NN.train(model, data, epochs=epochs, batch_size=batch_size)
    hist = NN.history_frame(spark, res)
    conf = spark.createDataFrame(
        [(c["split"], c["epoch"], int(c["true_label"]), int(c["pred_label"]), int(c["n"])) for c in res.confusion],
        "split string, epoch bigint, true_label bigint, pred_label bigint, n bigint")
    rec = R.network_run_records(hist, conf, [], {"learning_rate": learning_rate, "training_batch_size": batch_size or LS.BATCH_ROWS,
                                                   "optimizer_name": model.optimizer_name,
                                                   "criterion_name": model.criterion_name})
    rec = rec.select(F.lit(ds_name).alias("original_dataset_name"), F.lit(enc_name).alias("embedder_name"),
                     "experiment_result")
    ident = f"{ds_name}_{enc_name}_{model_name}".lower()
    SK.write_json_records(rec.coalesce(1), os.path.join(save_dir, ident + ".json"))
    NN.save_weights(spark, model, os.path.join(save_dir, ident, "weights"))
    return hist


def convert_into_image_dataset(spark: SparkSession, ds: str, dim: int, save_dir: str,
                               test_ds: str | None = None, seed: int = DEFAULT_SEED,
                               resize: bool = True) -> str:
    """Embedded table -> images, stored by split and label."""
    ds_name, enc_name = R.path_names(spark, ds)
    data = FS.train_test_pair(spark, ds, test_ds, dim, seed)
    data = L.dense_labels(data, "label", "label")
    out = os.path.join(save_dir, f"{enc_name}_{ds_name}")
    IM.write_image_table(IM.image_table(data, dim, resize).drop("row_id"), out)
    return out


def adaboost(spark: SparkSession, ds: str | Sequence[str], dim: int, save_dir: str, test_ds: str | None = None,
             seed: int = DEFAULT_SEED, n_rounds: int = SA.N_ROUNDS, learner: str = "exact") -> DataFrame:
    """SAMME stumps (exact; ``hist``: binned, ``mllib``: by MLlib); labels encoded over train + test together (F7);
    accuracy and confusion (outer = true) to a boosting-run JSON, the model
    beside it (B7). Several embedded files give one run and record each."""
    if not isinstance(ds, str):
        runs = [adaboost(spark, d, dim, save_dir, test_ds, seed, n_rounds, learner) for d in ds]
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out
    ds_name, enc_name = R.path_names(spark, ds)
    data = L.dense_labels(FS.train_test_pair(spark, ds, test_ds, dim, seed), "label", "label")
    k = data.select("label").distinct().count()
    train = data.where(F.col("split") == "train")
    model = (EX.fit_exact(train, k, n_rounds=n_rounds) if learner == "exact" else
             SA.fit_hist(train, k, n_rounds=n_rounds) if learner == "hist" else SA.fit(train, k, n_rounds=n_rounds, seed=seed))
    pred = model.decision(data.where(F.col("split") == "test"))
    conf = M.confusion(pred.withColumn("g", F.lit(1)), ["g"])
    rec = boost_run_record(conf, ds_name, enc_name)
    ident = os.path.join(save_dir, f"{ds_name}_{enc_name}_adaboost")
    SK.write_json_records(rec.coalesce(1), ident + ".json")
    if learner in ("exact", "hist"):
        SA.save_stumps(spark, model, os.path.join(ident, "stumps"))
    return rec


def boost_run_record(conf: DataFrame, ds_name: str, enc_name: str) -> DataFrame:
    """B4 (boosting): accuracy + ``map<true, map<pred, n>>``."""
    cm = R.confusion_maps(conf, ["g"], outer="true_label", inner="pred_label")
    acc = conf.groupBy("g").agg((F.sum(F.when(F.col("true_label") == F.col("pred_label"), F.col("n"))
                                       .otherwise(F.lit(0))) / F.sum("n")).alias("accuracy"))
    return cm.join(acc, "g").select(F.lit(ds_name).alias("original_ds_name"),
                                    F.lit(enc_name).alias("embedder_name"), "accuracy",
                                    F.col("cm").alias("classification_makeup"))


# -- P14, P15 ---------------------------------------------------------------
def visualize_all_tables(spark: SparkSession, results: str | Sequence[str], epoch: int = 5) -> dict[str, DataFrame]:
    """P14 (tables only): run files -> quarantine, per-run series, final
    test accuracy by embedding x class type, confusion at an epoch, F1."""
    good, bad = R.read_run_files(spark, results)
    nn, _ = R.route_boosting(good)
    checked = R.with_missing(nn, [f"experiment_result.{m}" for m in R.REQUIRED_NETWORK_METRICS])
    valid = checked.where(F.size("missing") == 0)
    emb, cls = R.split_embedder(F.coalesce(F.col("embedder_name"), F.lit("unknown_unknown")))
    runs = valid.select("path", emb.alias("embedding_type"), cls.alias("class_type"), "experiment_result")
    final = runs.select("embedding_type", "class_type",
                        F.element_at("experiment_result.testing_accuracies", -1).alias("accuracy"))
    series = R.series_from_record(runs.select("path", "experiment_result.*"), ["path"], {
        "training_accuracies": "training_accuracies", "training_losses": "training_losses",
        "testing_accuracies": "testing_accuracies", "testing_losses": "testing_losses"})
    confs = []
    for side, col in (("train", "training_classification_results"), ("test", "testing_classification_results")):
        confs.append(R.confusion_from_record(runs.select("path", f"experiment_result.{col}"), ["path"], col)
                     .withColumn("split", F.lit(side)))
    conf = confs[0].unionByName(confs[1])
    return {"quarantine": bad.unionByName(R.incomplete(checked)),
            "series": series,
            "confusion_dense": M.dense_confusion(conf, ["path", "split", "epoch"]),
            "accuracy_by_embedding": R.accuracy_table(final, ["embedding_type", "class_type"]),
            "confusion_at_epoch": M.at_epoch(conf, epoch, ["path", "split"]),
            "f1_by_epoch": M.weighted_f1(conf, ["path", "split", "epoch"])}


def visualize_adaboost_tables(spark: SparkSession, results: str | Sequence[str]) -> dict[str, DataFrame]:
    """P15 (tables only): boosting run files -> accuracy by embedding type,
    dense confusion per run (outer key = true label)."""
    good, bad = R.read_run_files(spark, results, R.BOOST_RUN_DDL)
    checked = R.with_missing(good, list(R.REQUIRED_BOOST_METRICS))
    valid = checked.where(F.size("missing") == 0)
    emb, _ = R.split_embedder(F.coalesce(F.col("embedder_name"), F.lit("unknown_unknown")))
    runs = valid.select("path", emb.alias("embedding_type"), "accuracy", "classification_makeup")
    conf = R.confusion_from_record(runs.select("path", F.array("classification_makeup").alias("cm")),
                                   ["path"], "cm", outer_is="true").drop("epoch")
    return {"quarantine": bad.unionByName(R.incomplete(checked)),
            "accuracy_by_embedding": R.accuracy_table(runs, ["embedding_type"]),
            "confusion": M.dense_confusion(conf, ["path"])}


# Result views by name, each a function of the tables above.
VIEWS = {
    "accuracy": lambda t: t["series"].where(F.col("series").endswith("accuracies")),
    "loss": lambda t: t["series"].where(F.col("series").endswith("losses")),
    "confusion": lambda t: t["confusion_at_epoch"],
    "f1": lambda t: t["f1_by_epoch"],
    "accuracy_by_embedding": lambda t: t["accuracy_by_embedding"],
}


def encoder_throughput(df: DataFrame, encoder: EN.Encoder, ids: Sequence[str],
                       text_col: str = "text") -> tuple[DataFrame, dict]:
    """Encode while counting sentences with an ``Observation``;
    returns (vectors, {"sentences": n, "seconds": s, "per_second": r})."""
    import time
    from pyspark.sql import Observation
    obs = Observation("encoder")
    sentences = materialize(df.select(*ids, text_col, F.size(T.sentence_tokens(text_col)).alias("_n")), "sentence-counts")
    # counted before the clock starts: the time measured is the encoder's own
    watched = sentences.observe(obs, F.sum("_n").alias("sentences")).drop("_n")
    out = encoder.transform(watched, ids, text_col)
    t0 = time.perf_counter()
    out.write.format("noop").mode("overwrite").save()
    secs = time.perf_counter() - t0
    n = obs.get.get("sentences") or 0
    return out, {"sentences": int(n), "seconds": secs, "per_second": n / secs if secs else 0.0}
