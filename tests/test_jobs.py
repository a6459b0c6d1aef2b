"""Job entry points end to end on files derived from the sf0.001 tables."""

import os

import pytest
from pyspark.sql import functions as F

from articlelab.operators import encode as EN
from articlelab.plans import jobs as J
from articlelab.sinks import writers as SK
from articlelab.sources import tables as S
from places import SF001


@pytest.fixture(scope="module")
def raw_csv(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("jobs"))
    path = os.path.join(d, "articles.csv")
    SK.write_csv(S.articles(spark, SF001).select("type", "text"), path)
    wiki = os.path.join(d, "wikihow.csv")
    SK.write_csv(S.wikihow(spark, SF001).drop("doc_id"), wiki)
    return d, path, wiki


def test_subset_and_queries(spark, raw_csv):
    d, path, wiki = raw_csv
    sub = J.get_wikihow_subset(spark, wiki, os.path.join(d, "subset.csv"), n_rows=20)
    assert sub.count() == 20
    q = J.get_queries(spark, os.path.join(d, "subset.csv"), os.path.join(d, "queries.csv"))
    assert q.count() == 20 and q.first().query.startswith("I am writing an article titled '")
    strat = J.get_and_store_subset(spark, path, None, n=5)
    assert {r.type: r["count"] for r in strat.groupBy("type").count().collect()} == {"human": 5, "gpt": 5}


def test_embed_train_boost_visualize(spark, raw_csv):
    d, path, _ = raw_csv
    enc = J.train_vocab_embedder(spark, path, os.path.join(d, "vocab"))
    train, test = os.path.join(d, "hash8_articles.csv"), os.path.join(d, "hash8_articles_test.csv")
    emb = J.embed_raw_data(spark, path, enc, train, test)
    n = emb.count()
    assert spark.read.option("header", True).csv(train).count() == int(n * 0.8)
    runs = os.path.join(d, "runs")
    hist = J.train_nn_model(spark, train, 8, "SoftmaxRegression", runs, test_ds=test, epochs=2)
    assert hist.count() == 4
    J.adaboost(spark, train, 8, os.path.join(runs, "ADABOOST"), test_ds=test, n_rounds=3)
    tables = J.visualize_all_tables(spark, runs)
    acc = tables["accuracy_by_embedding"].collect()
    assert [(r.embedding_type, r.class_type, r.n_runs) for r in acc] == [("hash8", "unknown", 1)]
    assert tables["f1_by_epoch"].count() == 4
    assert set(J.VIEWS) >= {"accuracy", "loss", "confusion", "f1"}
    assert J.VIEWS["loss"](tables).count() == 4
    boost = J.visualize_adaboost_tables(spark, os.path.join(runs, "ADABOOST"))
    assert boost["accuracy_by_embedding"].first().n_runs == 1
    assert boost["confusion"].count() == 4          # two labels, dense grid
    img = J.convert_into_image_dataset(spark, train, 8, os.path.join(d, "images"), test_ds=test)
    assert spark.read.parquet(img).count() == n


def test_batched_embedding_resumes(spark, raw_csv):
    d, path, _ = raw_csv
    enc = EN.MeanWordVectorEncoder(8).fit(spark.read.option("header", True).option("multiLine", True)
                                          .option("escape", '"').csv(path))
    out = os.path.join(d, "batched")
    first = J.embed_csv_batches(spark, path, out, enc, batch_size=16, literal_type="llama",
                                class_map={"llama": 0})
    n = first.count()
    again = J.embed_csv_batches(spark, path, out, enc, batch_size=16, literal_type="llama",
                                class_map={"llama": 0})
    assert again.count() == n and first.select(F.max("label")).first()[0] == 0


def test_required_columns_and_throughput(spark):
    df = S.features(spark, SF001)
    with pytest.raises(ValueError):
        J.require_columns(df.drop("label"), ["label"])
    X, y = J.samples_and_labels(df)
    assert "label" not in X.columns and y.columns == ["label"]
    docs = S.table(spark, SF001, "documents").select("doc_id", "text")
    _, stats = J.encoder_throughput(docs, EN.SentenceEncoder(dim=4), ["doc_id"])
    assert stats["sentences"] > 0 and stats["per_second"] > 0
