"""Work, files and rows held at once grow with the input, not with its square."""
from collections import Counter

import pytest
from pyspark.sql import functions as F

from articlelab.sinks import writers as SK


def test_a_batch_is_one_file_whatever_the_tasks(spark, tmp_dir):
    rows = spark.range(640).repartition(8).withColumn("batch_no", F.expr("id div 64"))
    SK.write_batches(rows, f"{tmp_dir}/batches")
    back = spark.read.parquet(f"{tmp_dir}/batches")
    files = Counter(r[0].rpartition("/")[0] for r in back.select(F.input_file_name()).distinct().collect())
    assert len(files) == 10 and set(files.values()) == {1}
    assert back.count() == 640 and back.select("id").distinct().count() == 640


def test_a_csv_grows_in_files_and_keeps_its_order(spark, tmp_dir, monkeypatch):
    from articlelab.plans import queries as Q
    from articlelab.sources import csv_index as CI
    from articlelab.sources import files as FS
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1000).alias("text"))
    monkeypatch.setattr(Q, "CSV_FILE_BYTES", 5_000)
    Q._in_files(docs, 2).select(F.col("doc_id").cast("string").alias("type"), "text").write.option("header", True).csv(f"{tmp_dir}/csv")
    back = FS.read_csv(spark, f"{tmp_dir}/csv", file_order="file_row")
    assert CI.files_of(spark, f"{tmp_dir}/csv").count() >= 6
    assert [(int(r["type"]), r["file_row"]) for r in back.orderBy("file_row").collect()] == [(i, i) for i in range(40)]


def test_small_stretches_share_a_task(spark, tmp_dir):
    from articlelab.sources import csv_index as CI
    spark.range(2000).select(F.lit("en").alias("type"), F.concat(F.lit("a,"), F.col("id")).alias("text")).coalesce(1).write.option("header", True).csv(f"{tmp_dir}/csv")
    index = CI.build_index(spark, f"{tmp_dir}/csv", range_bytes=100)
    rows = CI.read_ranges(index.where("n_rows > 0"))
    assert index.count() > 100 and rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert rows.select("file_row").distinct().count() == 2000 and rows.count() == 2000


def test_a_written_table_leaves_no_shuffle_files(spark):
    from articlelab.session import SHUFFLE_CLEANUP_CONF, materialize
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before, conf = files(), spark.conf.get(SHUFFLE_CLEANUP_CONF, None)
    got = materialize(spark.range(1000).repartition(4).groupBy((F.col("id") % 7).alias("k")).count())
    assert sorted(r["count"] for r in got.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert not files() - before and spark.conf.get(SHUFFLE_CLEANUP_CONF, None) == conf


def test_wide_vectors_meet_cold_tokens_in_blocks_of_columns(spark, monkeypatch):
    from articlelab.operators import vectors as V
    docs = spark.range(30).select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 9), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id")) % 23)).alias("tokens"))
    wv = V.hash_word_vectors(docs.select(F.explode("tokens").alias("token")), 11).checkpointed()
    for pool in ("sum", "max"):
        whole = {r["id"]: r for r in V.pooled_tokens(docs, ["id"], wv, pool).collect()}
        written = []
        with monkeypatch.context() as m:
            import articlelab.session as S
            plain = S.materialize
            m.setattr(S, "materialize", lambda df, name="table": (written.append((name, len(df.columns))), plain(df, name))[1])
            m.setattr(V, "BLOCK_DIM", 4)
            split = {r["id"]: r for r in V.pooled_tokens(docs, ["id"], wv, pool, budget=400).collect()}
        assert [n for n, _ in written].count("cold-columns") == 3
        for i, r in whole.items():
            assert (split[i]["n_tokens"], split[i]["n_known"]) == (r["n_tokens"], r["n_known"])
            assert all(abs(x - y) < 1e-12 or x == y for x, y in zip(split[i]["vec"], r["vec"], strict=True))


def test_a_batch_is_pooled_in_bounded_stretches(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from articlelab.operators import vectors as V
    monkeypatch.setattr(V, "TOKENS_AT_ONCE", 10)
    sizes = np.array([4, 4, 4, 25, 0, 0, 10, 1])
    parts = [p.column(0).to_pylist() for p in V._slices(pa.RecordBatch.from_pydict({"row": list(range(8))}), sizes)]
    assert sum(parts, []) == list(range(8)) and all(len(p) == 1 or sizes[p].sum() <= 10 for p in parts)


def test_an_arrival_of_many_bytes_is_several_files_and_one_micro_batch(spark, monkeypatch):
    from articlelab.plans import queries as Q
    seen = []
    monkeypatch.setattr(Q, "CSV_FILE_BYTES", 50_000, raising=False)
    monkeypatch.setattr(Q.ST, "vocabulary_stream", lambda spark, source, *a, max_files=1, **k: seen.append((len(spark.read.parquet(source).inputFiles()), max_files)))
    Q.QUERIES["vocabulary_stream"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and seen[0][1] > 1 and [n for n, _ in seen] == [2 * seen[0][1], 3 * seen[0][1]]


def test_rounds_of_word_vectors_take_two_tables_and_single_numbers(spark):
    import glob

    from articlelab.session import ensure_checkpoint_dir
    from articlelab.train import word_vectors as WV
    folders = lambda: set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/cbow-vectors-*"))
    before = folders()
    sents = spark.range(40).select(F.col("id").cast("string").alias("sid"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), (i * 3 + F.col("id")) % 17)).alias("tokens"))
    got = WV.fit_cbow(sents, dim=4, epochs=5, lot_tokens=100, pool=20)
    new = folders() - before
    assert len(new) == 2 and all(dict(spark.read.parquet(p).dtypes)["inward"] == "array<float>" for p in new)
    assert dict(got.dtypes) == {"word": "string", "vec": "array<double>"} and got.count() == 17


def test_lots_of_a_share_fetch_a_word_once_in_any_number_of_passes(spark, monkeypatch):
    import glob

    import numpy as np

    from articlelab.session import ensure_checkpoint_dir
    from articlelab.train import word_vectors as WV
    folders = lambda: set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file:") + "/cbow-needs-*"))
    sents = spark.range(200).select(F.col("id").cast("string").alias("sid"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), (i * 3 + F.col("id")) % 17)).alias("tokens"))
    conf, got = {"spark.sql.shuffle.partitions": "2", "spark.sql.execution.arrow.maxRecordsPerBatch": "5"}, []
    kept = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for pass_shares in (16, 1):
            before = folders()
            monkeypatch.setattr(WV, "PASS_SHARES", pass_shares, raising=False)
            got.append({r["word"]: np.array(r["vec"]) for r in WV.fit_cbow(sents, dim=4, epochs=2, lot_tokens=100, pool=20).collect()})
            (needs,) = folders() - before
            assert spark.read.parquet(needs).count() <= 4 * 17       # 20 lots of nearly all words, in 4 shares
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert len(got[0]) == 17 and all(np.allclose(got[0][w], got[1][w], rtol=1e-5, atol=1e-7) and np.abs(v).max() > 0 for w, v in got[1].items())


def test_sentence_vectors_are_never_written(spark, monkeypatch):
    import articlelab.session as S
    from articlelab.operators import vectors as V
    sents = F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda s: F.transform(F.sequence(F.lit(0), (s + F.col("id")) % 4), lambda i: F.concat(F.lit("w"), (i * 7 + s * 5 + F.col("id")) % 61)))
    docs = spark.range(60).select("id", F.when(F.col("id") % 11 != 0, sents).alias("sentences"))
    wv = V.hash_word_vectors(docs.select(F.explode(F.flatten("sentences")).alias("token")), 11).checkpointed()
    vec = {r["token"]: r["vec"] for r in wv.df.collect()}
    for pool in ("mean", "max"):
        want = {}
        for r in docs.collect():
            known = [v for v in ([vec[t] for t in s if t in vec] for s in r["sentences"] or []) if v]
            each = [[sum(x) / len(x) if pool == "mean" else max(x) for x in zip(*v)] for v in known]
            want[r["id"]] = (len(each), [sum(x) / len(each) for x in zip(*each)] if each else [0.0] * 11)
        rows = []
        with monkeypatch.context() as m:
            plain = S.materialize
            m.setattr(S, "materialize", lambda df, name="table": [rows.append((name, t.count())) or t for t in [plain(df, name)]][0])
            m.setattr(V, "BLOCK_DIM", 4)
            m.setattr(V, "LOT_TOKENS", 100)
            m.setattr(V, "SENTENCES_AT_ONCE", 2)
            some = {r["id"]: r for r in V.article_sentence_vectors(docs, wv, ["id"], pool, budget=2000).collect()}
        assert [n for n, _ in rows].count("lot-columns") == 3 and all(c <= 60 for n, c in rows if n != "lot-tokens")
        whole = {r["id"]: r for r in V.article_sentence_vectors(docs, wv, ["id"], pool).collect()}
        for i, (n, features) in want.items():
            for got in (some[i], whole[i]):
                assert got["n_sentences"] == n and all(abs(x - y) < 1e-12 for x, y in zip(got["features"], features, strict=True))


def test_a_sentence_encoder_sends_a_row_for_an_article(spark):
    import numpy as np

    from articlelab.operators import encode as EN
    texts = ["One two. Three! Four five six? x.", None, " ", "Seven. Eight nine.", "Ten. " * 50]
    docs = spark.createDataFrame([(None if i == 3 else i % 7, texts[i % 5]) for i in range(40)], "doc_id long, text string").coalesce(1)
    enc = EN.SentenceEncoder(lambda s: np.array([[len(x), x.count(" ")] for x in s], dtype=float).reshape(-1, 2), dim=2, batch_rows=7)
    out = enc.transform(docs, ["doc_id"])
    want = {}
    for i in range(40):
        sents = {0: [("one two .")] + ["three !", "four five six ?", "x ."], 3: ["seven .", "eight nine ."], 4: ["ten ."] * 50}.get(i % 5, [])
        want.setdefault(None if i == 3 else i % 7, []).extend([len(x), x.count(" ")] for x in sents)
    got = {r["doc_id"]: r["features"] for r in out.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], np.mean(v, axis=0) if v else [0, 0], atol=1e-12) for k, v in want.items())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "sent_no" not in plan.partition("MapInPandas")[0] + plan.partition("MapInPandas")[2].split("\n")[0]


def test_frequent_tokens_come_from_the_counts_of_the_vocabulary(spark, monkeypatch):
    from articlelab.operators import vectors as V
    docs = spark.range(30).select("id", F.transform(F.sequence(F.lit(0), F.col("id") % 9), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id")) % 23)).alias("tokens"))
    wv = V.hash_vectors_of_lists(docs, 8)
    plain = V.hash_word_vectors(docs.select(F.explode("tokens").alias("token")), 8)
    assert sorted(map(str, wv.df.collect())) == sorted(map(str, plain.df.collect()))
    want = {r["id"]: r["features"] for r in V.article_mean_vectors(docs, plain, ["id"]).collect()}
    monkeypatch.setattr(V, "explode_rows", lambda df, keep, *a: spark.range(0).select(F.lit("").alias("token")))     # no token is counted again
    got = V.article_mean_vectors(docs, wv, ["id"], budget=1000, written=True).collect()
    assert len(got) == 30 and all(abs(x - y) < 1e-12 for r in got for x, y in zip(r["features"], want[r["id"]], strict=True))


def test_classes_of_an_image_folder_are_found_without_images(spark, tmp_dir, monkeypatch):
    import os

    from articlelab.operators import images as IM
    from articlelab.operators import labels as L
    from articlelab.sinks import image_tree as IT
    rows = [(f, str(i), 1, 1, 1, bytearray([i])) for i, f in enumerate(["class 1", "a%b", "é+c", "x/y"])]
    IT.write_image_tree(spark.createDataFrame(rows, IT.COLUMNS), f"{tmp_dir}/t")
    os.makedirs(f"{tmp_dir}/t/raw & #name")
    with open(f"{tmp_dir}/t/raw & #name/bad.png", "wb") as f:
        f.write(b"no")
    plans, plain = [], L.materialize
    monkeypatch.setattr(L, "materialize", lambda df, name="table": (plans.append(df._jdf.queryExecution().executedPlan().toString()), plain(df, name))[1])
    good, bad = IM.read_image_folder(spark, f"{tmp_dir}/t")
    assert "ReadSchema: struct<>" in plans[0]
    assert sorted(r["label"] for r in good.collect()) == [0, 1, 2, 4] and bad.count() == 1


def test_a_round_of_word_vectors_sends_matrices_and_no_words(spark, monkeypatch):
    import numpy as np

    from articlelab.train import word_vectors as WV
    sents = spark.range(200).select(F.col("id").cast("string").alias("sid"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("w"), (i * 3 + F.col("id")) % 37)).alias("tokens"))
    got = []
    for share_bytes, share_lots, block_bytes in ((96 << 20, 32, 64 << 20), (400, 3, 500)):
        for name, v in (("SHARE_BYTES", share_bytes), ("SHARE_LOTS", share_lots), ("BLOCK_BYTES", block_bytes)):
            monkeypatch.setattr(WV, name, v, raising=False)
        dealt = WV.prepared(sents, 1, 42, 100, 20, 2 * 4 * 8)
        start = dealt.vocab.select("word", *[F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i, c=c: F.pmod(F.xxhash64("word", i), F.lit(100 + c)) / 1000.0).alias(n) for c, n in enumerate(("inward", "outward"))])
        done = WV.train_round(dealt, WV.in_blocks(dealt, start), 4, 0.5, "42:0", batch=None)
        plan = done._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan       # nothing meets by word
        assert dealt.rows.count() <= dealt.shares * (min(dealt.blocks, 37) + 1)
        got.append((dealt.shares, dealt.blocks, {r["word"]: (r["n_in"], r["n_out"], np.array(r["inward"] + r["outward"])) for r in WV.by_word(done, ("inward", "outward", "n_in", "n_out")).collect()}))
    assert got[0][0] < got[1][0] and got[0][1] < got[1][1]
    assert len(got[0][2]) == 37 and all(a[:2] == b[:2] and np.allclose(a[2], b[2], atol=1e-12) for a, b in ((v, got[1][2][w]) for w, v in got[0][2].items()))


def test_shares_of_word_vectors_fill_the_tasks(spark):
    from articlelab.train import word_vectors as WV
    vocab = spark.range(1000).select(F.col("id").cast("string").alias("word"), (100_000 / (F.col("id") + 1)).cast("long").alias("n"))
    assert WV.shares_of(vocab, 285, 20, 128, 8)[0] == 16             # 9 hold 32 lots each, two would run alone
    assert WV.shares_of(vocab, 5, 20, 128, 8)[0] == 5


@pytest.mark.parametrize("pool", ["mean", "max"])
def test_lots_of_sentences_fetch_vectors_in_passes(spark, monkeypatch, pool):
    import articlelab.session as S
    from articlelab.operators import vectors as V
    sents = F.transform(F.sequence(F.lit(0), F.col("id") % 7), lambda s: F.transform(F.sequence(F.lit(0), (s + F.col("id")) % 4), lambda i: F.concat(F.lit("w"), (i * 7 + s * 5 + F.col("id")) % 61)))
    docs = spark.range(60).select("id", sents.alias("sentences"))
    wv = V.hash_word_vectors(docs.select(F.explode(F.flatten("sentences")).alias("token")), 11).checkpointed()
    want = {r["id"]: r for r in V.article_sentence_vectors(docs, wv, ["id"], pool).collect()}
    rows, plain = [], S.materialize
    monkeypatch.setattr(S, "materialize", lambda df, name="table": [rows.append((name, t.count())) or t for t in [plain(df, name)]][0])
    for name, v in (("BLOCK_DIM", 4), ("LOT_TOKENS", 20), ("LOT_MOST", 2), ("LOT_PASS_BYTES", 9000), ("LOT_PASSES", 4)):
        monkeypatch.setattr(V, name, v, raising=False)
    got = {r["id"]: r for r in V.article_sentence_vectors(docs, wv, ["id"], pool, budget=2000).collect()}
    columns = [c for n, c in rows if n == "lot-columns"]
    assert len(columns) == 3 * 4 and max(columns) < 30 and columns[:4] == columns[4:8]      # three blocks, four passes
    assert got.keys() == want.keys()
    assert all(got[i]["n_sentences"] == want[i]["n_sentences"] and all(abs(x - y) < 1e-12 for x, y in zip(got[i]["features"], want[i]["features"], strict=True)) for i in want)
