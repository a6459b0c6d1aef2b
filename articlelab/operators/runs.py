"""Run records: names, validation, cross-run tables, JSON shape
(A9-A11, B4, C14, E16, E17, E19, E20, G12-G14, J1, J2).

A run record holds per-epoch series and per-epoch confusion maps; its
size is bounded by epochs x classes^2, never by the number of scored
rows. Cross-run tables are ordinary aggregates over many records.
"""

from __future__ import annotations

import uuid
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Record field names and the required metric set.
REQUIRED_NETWORK_METRICS = (
    "training_accuracies", "training_losses", "testing_accuracies", "testing_losses",
    "training_classification_results", "testing_classification_results")
REQUIRED_BOOST_METRICS = ("accuracy", "classification_makeup")
NAME_PATTERN = r"(?U)^(\w+)_(\w+)"      # greedy: encoder takes all but the last part; letters of any script
UNKNOWN = "unknown"

CONFUSION_MAP = "map<string,map<string,bigint>>"
NETWORK_RUN_DDL = (
    "original_dataset_name string, embedder_name string, experiment_result struct<"
    "learning_rate double, epochs int, training_batch_size int, optimizer_name string, "
    "criterion_name string, training_accuracies array<double>, training_losses array<double>, "
    "testing_accuracies array<double>, testing_losses array<double>, "
    f"training_classification_results array<{CONFUSION_MAP}>, "
    f"testing_classification_results array<{CONFUSION_MAP}>, f1_score array<double>>")
BOOST_RUN_DDL = (f"original_ds_name string, embedder_name string, accuracy double, "
                 f"classification_makeup {CONFUSION_MAP}")
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def names_from_path(path) -> tuple[Column, Column, Column]:
    """(dataset name, encoder name, matched) from an embedded-table
    path: basename, its first ``.``-part, greedy ``(\\w+)_(\\w+)``. A path
    without a match gives null names and ``matched = false`` (the
    reference raises)."""
    base = F.substring_index(F.substring_index(_c(path), "/", -1), ".", 1)
    matched = base.rlike(NAME_PATTERN)
    enc = F.when(matched, F.regexp_extract(base, NAME_PATTERN, 1))
    ds = F.when(matched, F.regexp_extract(base, NAME_PATTERN, 2))
    return ds, enc, matched


def run_identifier(ds, encoder, model) -> Column:
    """``lower('<ds>_<encoder>_<model>')``."""
    return F.lower(F.concat_ws("_", _c(ds), _c(encoder), _c(model)))


def split_embedder(name) -> tuple[Column, Column]:
    """Embedding type = part before the first ``_``; class type = the
    rest, ``unknown`` when there is no ``_``; both lower case."""
    parts = F.split(_c(name), "_", 2)
    emb = F.lower(F.element_at(parts, 1))
    cls = F.lower(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(UNKNOWN)))
    return emb, cls


def with_missing(df: DataFrame, required: Sequence[str], name: str = "missing") -> DataFrame:
    """C14: array of the required metric names that are null."""
    checks = F.array(*[F.when(_c(c).isNull(), F.lit(c.split(".")[-1])) for c in required])
    return df.withColumn(name, F.filter(checks, lambda x: x.isNotNull()))


def accuracy_table(valid: DataFrame, by: Sequence[str], value: str = "accuracy") -> DataFrame:
    """Mean (bar height), count and sample std per group."""
    return valid.groupBy(*by).agg(
        F.avg(value).alias("mean_accuracy"),
        F.count(value).cast("bigint").alias("n_runs"),
        F.stddev_samp(value).alias("std_accuracy"))


def confusion_maps(conf: DataFrame, keys: Sequence[str], outer: str = "pred_label",
                   inner: str = "true_label") -> DataFrame:
    """B4 shape: long confusion -> ``map<outer, map<inner, n>>`` per keys
    (network results: outer = predicted; boosting: outer = true)."""
    lvl1 = conf.groupBy(*keys, outer).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(inner).cast("string"), F.col("n").cast("bigint")))).alias("_inner"))
    return lvl1.groupBy(*keys).agg(F.map_from_entries(F.collect_list(
        F.struct(F.col(outer).cast("string"), F.col("_inner")))).alias("cm"))


def network_run_records(metrics: DataFrame, conf: DataFrame, run_keys: Sequence[str],
                        meta: dict) -> DataFrame:
    """One network-run record per run: per-epoch series ordered by
    epoch, per-epoch confusion maps (outer = predicted). ``metrics`` has
    (run_keys, split, epoch, accuracy, loss); ``conf`` is long form with
    (run_keys, split, epoch, ...)."""
    run_keys = list(run_keys)
    cm = confusion_maps(conf, [*run_keys, "split", "epoch"])
    per_epoch = metrics.join(cm, on=[*run_keys, "split", "epoch"], how="left")
    by_epoch = (lambda a, b: F.when(a["epoch"] < b["epoch"], F.lit(-1))
                .when(a["epoch"] > b["epoch"], F.lit(1)).otherwise(F.lit(0)))
    series = per_epoch.groupBy(*run_keys, "split").agg(F.array_sort(F.collect_list(
        F.struct("epoch", "accuracy", "loss", "cm")), by_epoch).alias("s"))

    def field(side, f):
        return F.first(F.when(F.col("split") == side, F.transform("s", lambda e: e[f])), ignorenulls=True)

    rec = series.groupBy(*run_keys).agg(
        field("train", "accuracy").alias("training_accuracies"),
        field("train", "loss").alias("training_losses"),
        field("test", "accuracy").alias("testing_accuracies"),
        field("test", "loss").alias("testing_losses"),
        field("train", "cm").alias("training_classification_results"),
        field("test", "cm").alias("testing_classification_results"),
        F.max(F.size("s")).alias("epochs"))
    result = F.struct(
        F.lit(meta.get("learning_rate", 0.001)).cast("double").alias("learning_rate"),
        F.col("epochs").cast("int").alias("epochs"),
        F.lit(meta.get("training_batch_size", 32)).cast("int").alias("training_batch_size"),
        F.lit(meta.get("optimizer_name", "SGD")).alias("optimizer_name"),
        F.lit(meta.get("criterion_name", "CrossEntropyLoss")).alias("criterion_name"),
        "training_accuracies", "training_losses", "testing_accuracies", "testing_losses",
        "training_classification_results", "testing_classification_results")
    return rec.select(*run_keys, result.alias("experiment_result"))


def record_to_json(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Record columns -> one JSON string column ``json``."""
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def record_from_json(df: DataFrame, ddl: str, col: str = "json") -> DataFrame:
    """JSON string -> typed record; absent keys become null."""
    return df.select(F.from_json(col, ddl).alias("r")).select("r.*")


def confusion_from_record(df: DataFrame, keys: Sequence[str], array_col: str,
                          outer_is: str = "pred") -> DataFrame:
    """A9 importer: ``array<map<outer, map<inner, n>>>`` -> long form
    ``(keys, epoch, true_label, pred_label, n)``; ``outer_is`` says whether
    the outer key is the predicted or the true label (Q10)."""
    e = df.select(*keys, F.posexplode(array_col).alias("_pos", "_m"))
    o = e.select(*keys, (F.col("_pos") + 1).alias("epoch"), F.explode("_m").alias("_outer", "_inner"))
    i = o.select(*keys, "epoch", "_outer", F.explode("_inner").alias("_ik", "n"))
    outer = F.col("_outer").cast("bigint")
    inner = F.col("_ik").cast("bigint")
    t, p = (inner, outer) if outer_is == "pred" else (outer, inner)
    return i.select(*keys, "epoch", t.alias("true_label"), p.alias("pred_label"), F.col("n").cast("bigint"))


def series_from_record(df: DataFrame, keys: Sequence[str], series: dict[str, str]) -> DataFrame:
    """Stored arrays -> ``(keys, series, epoch, value)``, epoch = position + 1."""
    parts = []
    for name, col in series.items():
        parts.append(df.select(*keys, F.lit(name).alias("series"),
                               F.posexplode(col).alias("_pos", "value"))
                     .select(*keys, "series", (F.col("_pos") + 1).alias("epoch"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def path_names(spark, path: str) -> tuple[str, str]:
    """G12 for one path on the driver: (dataset, encoder), by the same column rule."""
    ds, enc, matched = names_from_path(F.lit(path))
    row = spark.range(1).select(ds.alias("ds"), enc.alias("enc"), matched.alias("ok")).first()
    if not row["ok"]:
        raise ValueError(f"{path!r} is not named <encoder>_<dataset>")
    return row["ds"], row["enc"]


def read_run_files(spark, paths: Sequence[str] | str, ddl: str = NETWORK_RUN_DDL) -> tuple[DataFrame, DataFrame]:
    """A9 + A10 + A11: read many run files (a folder is searched
    recursively for ``*.json``). A file holds one JSON document, or one per
    line (every line an object). Returns ``(good, quarantine)``: a record that
    does not parse goes to quarantine with its path and text; the other
    records of its file are kept."""
    reader = spark.read
    if isinstance(paths, str):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    raw = reader.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    by_line = (F.size(lines) > 1) & F.forall(lines, lambda x: F.trim(x).rlike(r"^\{.*\}$"))
    one = raw.select("path", F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("_text"))
    parsed = one.select("path", "_text", F.from_json("_text", f"{ddl}, _corrupt_record string", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("_r"))
    broken = F.col("_r").isNull() | F.col("_r._corrupt_record").isNotNull()
    bad = parsed.where(broken).select("path", F.col("_text").alias("_corrupt_record"))
    good = parsed.where(~broken).select("_r.*", "path").drop("_corrupt_record")
    return good, bad


def incomplete(checked: DataFrame) -> DataFrame:
    """Quarantine rows of records that lack a metric: path and the names."""
    return checked.where(F.size("missing") > 0).select("path", F.array_join("missing", ",").alias("_corrupt_record"))


def route_boosting(df: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """Split run files by path: ``*/ADABOOST/*`` vs the rest."""
    is_boost = F.col(path_col).like("%/ADABOOST/%")
    return df.where(~is_boost), df.where(is_boost)


# -- records of unknown shape -------------------------------------------------
#: Kinds of a JSON value as its schema begins; all numbers are one kind.
VALUE_KINDS = {"BIGINT": "number", "DOUBLE": "number", "DECIMAL": "number", "FLOAT": "number", "STRING": "text", "BOOLEAN": "boolean",
               "ARRAY": "list", "OBJECT": "object", "VOID": "null"}


def read_run_variants(spark, paths: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    """A9 + A10 without a schema: ``(records, quarantine)``, a record being
    ``path, record VARIANT``. A line that is no JSON object goes to quarantine
    (``path, _corrupt_record``). A folder is searched recursively for ``*.json``."""
    reader = spark.read
    if isinstance(paths, str):
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
    raw = reader.text(paths if isinstance(paths, str) else list(paths), wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    by_line = (F.size(lines) > 1) & F.forall(lines, lambda x: F.trim(x).rlike(r"^\{.*\}$"))
    one = raw.select("path", F.explode(F.when(by_line, lines).otherwise(F.array("value"))).alias("_text"))
    parsed = one.select("path", "_text", F.try_parse_json("_text").alias("record"))
    good = F.col("record").isNotNull() & F.schema_of_variant("record").startswith("OBJECT")
    return parsed.where(good).select("path", "record"), parsed.where(~F.coalesce(good, F.lit(False))).select("path", F.col("_text").alias("_corrupt_record"))


def variant_field(name: str, kind: str, record: str = "record") -> Column:
    """A field of a record by type (DDL); null if absent or not readable as that."""
    return F.try_variant_get(record, f"$.{name}", kind)


def field_report(records: DataFrame, known: dict[str, str]) -> DataFrame:
    """``field, kind, expected, n``: what the records hold. ``known`` maps the fields
    that are read to their kinds (of ``VALUE_KINDS``); ``expected`` is null for a
    field that is not among them, so unknown fields and changed types show
    instead of vanishing. One row per field and kind."""
    spark = records.sparkSession
    view = "variants_" + uuid.uuid4().hex[:12]
    records.select("record").createOrReplaceTempView(view)
    fields = spark.sql(f"SELECT f.key AS field, schema_of_variant(f.value) AS shape FROM {view}, LATERAL variant_explode(record) AS f")
    kinds = F.create_map(*[F.lit(x) for kv in VALUE_KINDS.items() for x in kv])
    expected = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    word = F.regexp_extract("shape", "^[A-Z]+", 0)
    return fields.groupBy("field", F.coalesce(F.try_element_at(kinds, word), F.lower(word)).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(
        "field", "kind", F.try_element_at(expected, F.col("field")).alias("expected"), "n")
