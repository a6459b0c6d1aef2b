"""Plan checks: expressions stay JVM-side, the tokenizer runs once, row
numbers never put data rows in one task, scans prune columns."""

import __spark_entry__ as E
from articlelab.plans.queries import QUERIES
from places import SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


ROW_PYTHON, PANDAS = ("BatchEvalPython", "PythonUDF"), ("ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas")
# The user's encoder, a network's scores and the pixels of decoded images are Python by contract; the
# training-data operators are tested on their own.
BY_CONTRACT = {"user_encoder", "image_folder", "score_network"}
# Whole jobs, run when the query is built: their results are checked by the oracle.
JOBS = {n for n in QUERIES if n.endswith("_job")} | {
    "cbow_step", "csv_batches_resume", "learnt_sentences", "local_sgd_round", "mlp_step", "samme_exact_round", "vocabulary_stream", "word2vec_train"}
SQL_QUERIES = sorted((set(E.oracle_sql()) & set(QUERIES)) - BY_CONTRACT - JOBS)


def test_sql_checked_queries_have_no_row_python(spark):
    """No Python per row and no pandas: what Spark's functions do not express
    (pooling of token lists) runs on whole Arrow batches."""
    qs = E.queries()
    for name in SQL_QUERIES:
        p = plan(qs[name](spark, SF01))
        assert not any(n in p for n in ROW_PYTHON + PANDAS), name


def test_pooling_neither_shuffles_nor_tokenises_twice(spark):
    p = plan(E.queries()["article_vectors"](spark, SF01))
    assert "size(CASE WHEN" not in p and "MapInArrow" in p
    assert "hashpartitioning" not in p and "Generate" not in p


def test_row_number_window_is_bucketed(spark):
    p = plan(E.queries()["train_test_split"](spark, SF01))
    assert "Window" in p
    for line in p.splitlines():
        if "row_number()" in line and "Window [" in line:
            assert "__bucket" in line, line


def test_scan_prunes_text_column(spark):
    p = plan(E.queries()["type_counts"](spark, SF01))
    scans = [ln for ln in p.splitlines() if "FileScan parquet" in ln and "documents" in ln]
    assert scans and all("text" not in ln.split("ReadSchema:")[1] for ln in scans)
