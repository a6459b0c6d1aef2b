"""Properties: exact split sizes, partition-independence, row numbers equal
a global window, confusion totals, F1 equal to Spark ML's evaluator."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from articlelab.operators import keys as K
from articlelab.operators import metrics as M
from articlelab.operators import sampling as D
from articlelab.sources import tables as S
from places import SF01


def test_split_is_exact_partition(spark):
    d = S.table(spark, SF01, "documents").select("doc_id")
    n = d.count()
    s = D.train_test_split(d, "doc_id")
    counts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert counts["train"] == int(n * 0.8) and counts["train"] + counts["test"] == n
    assert s.select("doc_id").distinct().count() == n


def test_shuffle_independent_of_partitioning(spark):
    d = S.table(spark, SF01, "documents").select("doc_id")
    a = {(r.doc_id, r.row_no) for r in D.seeded_order(d, "doc_id").collect()}
    b = {(r.doc_id, r.row_no) for r in D.seeded_order(d.repartition(7), "doc_id").collect()}
    c = {(r.doc_id, r.row_no) for r in D.seeded_order(d.repartition(1), "doc_id").collect()}
    assert a == b == c


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bucketed_row_number_equals_global_window(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(0, 10**6), rng.choice("ab")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, v bigint, g string")
    got = K.with_row_number(df, "v", by=["g"], tiebreak=["id"], name="rn")
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert {tuple(r) for r in got.select("id", "rn").collect()} == \
           {tuple(r) for r in want.select("id", "rn").collect()}
    keyed = df.withColumn("k", K.shuffle_key("id", seed))
    got = K.with_row_number(keyed, "k", tiebreak=["id"], name="rn", total_name="n")
    want = keyed.withColumn("rn", F.row_number().over(Window.orderBy("k", "id")))
    assert {tuple(r) for r in got.select("id", "rn").collect()} == \
           {tuple(r) for r in want.select("id", "rn").collect()}
    assert {r.n for r in got.select("n").distinct().collect()} == {3000}


def test_confusion_sums_to_rows(spark):
    s = M.score_rows(S.scores(spark, SF01))
    conf = M.confusion(s, ["split", "epoch"])
    tot = conf.groupBy("split", "epoch").agg(F.sum("n").alias("n"))
    rows = s.groupBy("split", "epoch").count()
    assert {tuple(r) for r in tot.collect()} == {tuple(r) for r in rows.collect()}
    dense = M.dense_confusion(conf, ["split", "epoch"])
    assert dense.agg(F.sum("n")).first()[0] == s.count()


def test_weighted_f1_equals_spark_ml(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    s = M.score_rows(S.scores(spark, SF01)).where((F.col("epoch") == 2) & (F.col("split") == "train"))
    ours = M.weighted_f1(M.confusion(s, ["split"]), ["split"]).first().f1
    ev = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction", metricName="f1")
    theirs = ev.evaluate(s.select(F.col("label").cast("double"), F.col("pred").cast("double").alias("prediction")))
    assert ours == pytest.approx(theirs, abs=1e-12)


def test_batches_cover_every_row_once(spark):
    d = S.table(spark, SF01, "documents").select("doc_id")
    b = D.numbered_batches(d, "doc_id", 64)
    n = d.count()
    assert b.count() == n
    sizes = {r.batch_no: r["count"] for r in b.groupBy("batch_no").count().collect()}
    assert len(sizes) == -(-n // 64) and all(v == 64 for k, v in sizes.items() if k < len(sizes) - 1)
    done = b.where(F.col("batch_no") < 2).select("batch_no")
    assert D.pending_batches(b, done).count() == n - 128
