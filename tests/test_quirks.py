
import math

import pytest
from pyspark.sql import functions as F

from articlelab.functions import text as T
from articlelab.operators import images as IM
from articlelab.operators import labels as L
from articlelab.operators import metrics as M
from articlelab.operators import runs as R
from articlelab.operators import sampling as D
from articlelab.operators import vectors as V


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    toks = docs.select("doc_id", T.flat_tokens("text").alias("tokens"))
    wv = V.hash_word_vectors(spark.createDataFrame([], "token string"))
    assert V.article_mean_vectors(toks, wv, ["doc_id"]).count() == 0
    assert D.train_test_split(docs, "doc_id").count() == 0


def test_one_row_goes_to_test(spark):
    # int(1 * 0.8) = 0 train rows: the row must not vanish (Q1)
    df = spark.createDataFrame([(7,)], "doc_id bigint")
    rows = D.train_test_split(df, "doc_id").collect()
    assert [(r.doc_id, r.split) for r in rows] == [(7, "test")]


def test_one_class_and_missing_class(spark):
    one = spark.createDataFrame([(1, 5), (2, 5)], "id bigint, label bigint")
    assert {r.label for r in L.dense_labels(one).collect()} == {0}
    # label 4 only in test, 1 and 7 only in train: fitted once on the union (Q2)
    df = spark.createDataFrame([(1, 1, "train"), (2, 7, "train"), (3, 4, "test")],
                               "id bigint, label bigint, split string")
    got = {r.id: r.label for r in L.dense_labels(df).collect()}
    assert got == {1: 0, 3: 1, 2: 2}


def test_null_type_is_unmapped(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "type string")
    m = L.literal_map(spark, {"a": 0})
    assert {r.type for r in L.unmapped(df, m).collect()} == {None, "b"}
    with pytest.raises(ValueError):
        L.assert_mapped(df, m)


def test_no_token_and_no_known_token(spark):
    docs = spark.createDataFrame([(1, ""), (2, "zzz qqq"), (3, "a b")], "doc_id bigint, text string")
    toks = docs.select("doc_id", T.flat_tokens("text").alias("tokens"))
    # vectors only for "a"
    wv = V.WordVectors(spark.createDataFrame([("a", [1.0, 2.0])], "token string, vec array<double>"), 2)
    got = {r.doc_id: r for r in V.article_mean_vectors(toks, wv, ["doc_id"]).collect()}
    assert got[1].n_tokens == 0 and got[1].features == [0.0, 0.0]
    assert got[2].n_tokens == 2 and got[2].n_known == 0 and got[2].features == [0.0, 0.0]
    # divisor counts the unknown token too (Q7)
    assert got[3].n_tokens == 2 and got[3].features == [0.5, 1.0]


def test_sentence_pooling_zero_vector(spark):
    docs = spark.createDataFrame([(1, "x y. a a."), (2, "q.")], "id bigint, text string")
    s = docs.select("id", T.sentence_tokens("text").alias("sentences"))
    rows = V.sentence_token_rows(s, ["id"])
    wv = V.WordVectors(spark.createDataFrame([("a", [2.0]), ("x", [4.0])], "token string, vec array<double>"), 1)
    mean = V.mean_of_sentences(V.pooled_sentence_vectors(rows, wv, ["id"], "mean"), 1, ["id"])
    got = {r.id: (r.n_sentences, r.features) for r in mean.collect()}
    assert got == {1: (2, [3.0]), 2: (0, [0.0])}


def test_constant_vector_gives_null_image(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5, 0.5]), (2, [0.0, 1.0, 0.5])], "id bigint, v array<double>")
    got = {r.id: r.image for r in IM.with_image(df, "v", 3, resize=False).collect()}
    assert got[1] is None
    assert got[2].height == 3 and got[2].pixels[4] == pytest.approx(255.0)


def _brute_weighted_f1(pairs):
    labels = sorted({t for t, _ in pairs} | {p for _, p in pairs})
    total, acc = len(pairs), 0.0
    for c in labels:
        tp = sum(1 for t, p in pairs if t == c and p == c)
        sup = sum(1 for t, _ in pairs if t == c)
        prd = sum(1 for _, p in pairs if p == c)
        f1 = 2 * tp / (sup + prd) if sup + prd else 0.0
        acc += f1 * sup
    return acc / total


@pytest.mark.parametrize("k", [2, 10])
def test_weighted_f1_against_brute_force(spark, k):
    pairs = [(i % k, (i * 7 + i // 3) % k) for i in range(97)]
    df = spark.createDataFrame([(0, t, p) for t, p in pairs], "g int, label bigint, pred bigint")
    got = M.weighted_f1(M.confusion(df, ["g"]), ["g"]).first().f1
    assert got == pytest.approx(_brute_weighted_f1(pairs), abs=1e-12)


def test_dense_confusion_integer_order_and_unpredicted_label(spark):
    # labels 2 and 10: integer order; label 10 is never predicted
    df = spark.createDataFrame([(0, 2, 2), (0, 10, 2), (0, 2, 2)], "g int, label bigint, pred bigint")
    dense = M.dense_confusion(M.confusion(df, ["g"]), ["g"])
    got = [(r.true_label, r.pred_label, r.n) for r in dense.orderBy("true_label", "pred_label").collect()]
    assert got == [(2, 2, 2), (2, 10, 0), (10, 2, 1), (10, 10, 0)]
    assert sorted(r.label for r in M.label_set(M.confusion(df, ["g"])).collect()) == [2, 10]


def test_loss_is_mean_of_batch_means(spark):
    # N = 70 is not a multiple of 32: batches of 32, 32, 6 (Q9)
    rows = [(i, 0, i // 32, [0.0, math.log(i + 1.0)]) for i in range(70)]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, batch_id bigint, logits array<double>")
    s = M.score_rows(df)
    em = M.epoch_metrics(s.withColumn("g", F.lit(1)), ["g"]).first()
    losses = [math.log(1 + (i + 1.0)) for i in range(70)]   # logsumexp(0, ln(i+1)) - 0
    batches = [losses[0:32], losses[32:64], losses[64:70]]
    assert em.loss == pytest.approx(sum(sum(b) / len(b) for b in batches) / 3)
    assert em.row_loss == pytest.approx(sum(losses) / 70)
    assert em.n == 70


def test_epoch_choice(spark):
    conf = spark.createDataFrame([("train", e, 0, 0, 1) for e in (1, 2, 3)],
                                 "split string, epoch bigint, true_label bigint, pred_label bigint, n bigint")
    assert [r.epoch for r in M.at_epoch(conf, 9, ["split"]).collect()] == [3]
    assert [r.epoch for r in M.at_epoch(conf, None, ["split"]).collect()] == [3]
    assert [r.epoch for r in M.at_epoch(conf, 2, ["split"]).collect()] == [2]
    with pytest.raises(Exception):
        M.at_epoch(conf, 9, ["split"], strict=True).collect()


def test_names_and_missing_metrics(spark):
    df = spark.createDataFrame([("/x/w2v_wiki_hum.csv",), ("/x/noname.csv",), ("/x/a-b_c.csv",)], "path string")
    ds, enc, ok = R.names_from_path("path")
    got = [(r[0], r[1], r[2]) for r in df.select(ds, enc, ok).collect()]
    assert got == [("hum", "w2v_wiki", True), (None, None, False), (None, None, False)]
    names = spark.createDataFrame([("SBERT_Human",), ("USE",)], "n string")
    emb, cls = R.split_embedder("n")
    assert [(r[0], r[1]) for r in names.select(emb, cls).collect()] == [("sbert", "human"), ("use", "unknown")]
    runs = spark.createDataFrame([(0.5, None), (None, None), (0.1, 0.2)], "accuracy double, loss double")
    miss = [r.missing for r in R.with_missing(runs, ["accuracy", "loss"]).collect()]
    assert miss == [["loss"], ["accuracy", "loss"], []]


def test_exact_sample_fails_when_short(spark):
    df = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(10)], "id bigint, type string")
    with pytest.raises(Exception):
        D.stratified_sample(df, "id", "type", ["a", "b"], 5).collect()
    got = D.stratified_sample(df, "id", "type", ["a", "b"], 3).groupBy("type").count().collect()
    assert {r.type: r["count"] for r in got} == {"a": 3, "b": 3}


def test_tokeniser_rules(spark):
    df = spark.createDataFrame([("Hello, World! It's 3.5 ok.\nNew  line?  Yes",)], "text string")
    r = df.select(T.sentence_tokens("text").alias("s"), T.flat_tokens("text").alias("f"),
                  T.word_count("text").alias("n"), T.clean_title(F.lit(" \t My  Title 12 ")).alias("t")).first()
    assert r.s == [["hello", ",", "world", "!"], ["it", "'", "s", "3", ".", "5", "ok", "."],
                   ["new", "line", "?"], ["yes"]]
    assert r.f == [t for s in r.s for t in s]
    assert r.n == 8
    assert r.t == "My Title "


def test_context_case_letters_take_exact_path(spark):
    # dotted capital I and capital sigma: lower-casing per token
    df = spark.createDataFrame([("İstanbul ΟΔΟΣ",)], "text string")
    got = df.select(T.flat_tokens("text").alias("t")).first().t
    assert got == ["i̇stanbul", "οδος"]


def test_hot_cold_join_equals_broadcast_join(spark):
    # one token holds a third of all rows; the over-budget path must give
    # the same vectors as the broadcast path
    rows = [(i, "the") for i in range(300)] + [(i, f"w{i % 97}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, token string").groupBy("doc_id").agg(
        F.collect_list("token").alias("tokens"))
    wv = V.hash_word_vectors(spark.createDataFrame(rows, "doc_id bigint, token string"), 4).checkpointed()
    small = {r.doc_id: r.features for r in V.article_mean_vectors(docs, wv, ["doc_id"]).collect()}
    cold = V.article_mean_vectors(docs, wv, ["doc_id"], budget=3 * V.row_bytes(4))
    big = {r.doc_id: r.features for r in cold.collect()}
    plan = cold._jdf.queryExecution().executedPlan().toString()
    assert small.keys() == big.keys()
    for k in small:
        assert small[k] == pytest.approx(big[k])
    assert "SortMergeJoin" in plan


def test_label_pairs_expand_only_on_request(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (0, 2, 1)], "g int, label bigint, pred bigint")
    conf = M.confusion(df, ["g"])
    assert M.label_pairs(conf, ["g"]).count() == 2
    rows = M.label_pairs(conf, ["g"], expand=True).collect()
    assert sorted((r.true_label, r.pred_label) for r in rows) == [(1, 1), (1, 1), (2, 1)]


def test_caller_class_map_must_cover_types(spark):
    from articlelab.operators import encode as EN
    arts = spark.createDataFrame([(1, "human", "a b"), (2, "gpt", "c")], "doc_id bigint, type string, text string")
    enc = EN.MeanWordVectorEncoder(4).fit(arts)
    with pytest.raises(ValueError):
        EN.embedded_table(arts, enc, split_col=None, mapping=L.literal_map(spark, {"human": 0}))
    ok = EN.embedded_table(arts, enc, split_col=None, mapping=L.literal_map(spark, {"human": 0, "gpt": 1}))
    assert sorted((r.doc_id, r.label) for r in ok.collect()) == [(1, 0), (2, 1)]


@pytest.mark.parametrize("dim", [4, 300])
def test_groups_without_vectors_at_any_width(spark, dim):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (2, 0, None), (3, 0, "a")], "doc_id int, sent_no int, token string")
    wv = V.WordVectors(spark.createDataFrame([("a", [2.0] * dim)], "token string, vec array<double>"), dim)
    for pool in ("mean", "max"):
        sents = V.pooled_sentence_vectors(rows, wv, ["doc_id"], pool)
        assert {(r.doc_id, r.sent_no): r.vec and r.vec[-1] for r in sents.collect()} == {(1, 0): 2.0, (1, 1): None, (2, 0): None, (3, 0): 2.0}
        docs = {r.doc_id: (r.n_sentences, r.features[-1]) for r in V.mean_of_sentences(sents, dim, ["doc_id"]).collect()}
        assert docs == {1: (1, 2.0), 2: (0, 0.0), 3: (1, 2.0)}


def test_samples_fail_aloud(spark):
    df = spark.createDataFrame([(i, "human") for i in range(5)], "id bigint, type string")
    with pytest.raises(ValueError, match="gpt"):
        D.stratified_sample(df, "id", "type", ["human", "gpt"], 3)
    with pytest.raises(ValueError):
        D.exact_sample(df.limit(0), "id", 1)
    assert D.stratified_sample(df, "id", "type", ["human"], 3).count() == 3


def test_unmapped_values_are_counted_and_the_first_named(spark):
    df = spark.createDataFrame([(f"t{i:02}",) for i in range(30)], "type string")
    with pytest.raises(ValueError) as e:
        L.assert_mapped(df, L.literal_map(spark, {"x": 0}))
    assert "30 value(s)" in str(e.value) and "t00, t01" in str(e.value) and "t19, ..." in str(e.value) and "t20" not in str(e.value)


def test_class_maps_of_few_and_many_values(spark, monkeypatch):
    df = spark.createDataFrame([(f"c{i % 7}",) for i in range(40)] + [(None,)], "type string")
    few = sorted(map(tuple, L.class_map(df).collect()))
    monkeypatch.setattr(L, "FEW_CLASSES", 3)
    monkeypatch.setattr(L, "BROADCAST_BYTES", 10)
    assert sorted(map(tuple, L.class_map(df).collect())) == few == [(f"c{i}", i) for i in range(7)]
    assert L.apply_class_map(df, L.class_map(df)).count() == 40


def test_ranges_of_row_numbers_are_even(spark):
    """Outliers and a value that a third of all rows share do not make a large range."""
    from articlelab.operators.keys import ranged, with_row_number
    df = spark.range(40_000).select("id", F.when(F.col("id") == 0, F.lit(-(1 << 63))).when(F.col("id") == 1, F.lit((1 << 63) - 1))
                                    .when(F.col("id") % 3 == 0, F.lit(7).cast("long")).otherwise(F.col("id") * 5).alias("key")).repartition(5)
    sizes = [r["count"] for r in ranged(df, ["key", "id"]).groupBy(F.shiftright("__at", 33)).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
    rows = with_row_number(df, "key", tiebreak=["id"]).orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == list(range(1, 40_001))
    assert [(r["key"], r["id"]) for r in rows] == sorted((r["key"], r["id"]) for r in rows)


def test_row_numbers_within_groups_with_nulls(spark):
    from articlelab.operators.keys import with_row_number
    rows = [("a", 3, 1), ("a", None, 2), (None, 5, 3), (None, 4, 4), ("a", 3, 0), ("b", 9, 9)]
    df = spark.createDataFrame(rows, "g string, k long, t long").repartition(3)
    got = {(r["g"], r["t"]): (r["row_no"], r["n"]) for r in with_row_number(df, "k", by=["g"], tiebreak=["t"], total_name="n").collect()}
    assert got == {("a", 2): (1, 3), ("a", 0): (2, 3), ("a", 1): (3, 3), (None, 4): (1, 2), (None, 3): (2, 2), ("b", 9): (1, 1)}


def test_any_string_key_is_numbered_in_order(spark):
    from articlelab.operators.keys import with_row_number
    df = spark.createDataFrame([("pear",), ("apple",), ("zoo",), ("cat",), (None,)], "w string").repartition(3)
    assert [(r.w, r.row_no) for r in with_row_number(df, "w").orderBy("row_no").collect()] == [
        (None, 1), ("apple", 2), ("cat", 3), ("pear", 4), ("zoo", 5)]


def test_run_names_of_any_script(spark):
    from articlelab.operators import runs as R
    assert R.path_names(spark, "/x/été_w2v_données.csv") == ("données", "été_w2v")
    with pytest.raises(ValueError):
        R.path_names(spark, "/x/plain.csv")


def test_split_by_cut_equals_numbered_split(spark):
    df = spark.range(57).withColumnRenamed("id", "doc_id")
    for n_rows in (None, 20, 0, 100):
        a = {(r.doc_id, r.split) for r in D.with_split(df, "doc_id", n_rows=n_rows).collect()}
        b = {(r.doc_id, r.split) for r in D.train_test_split(df, "doc_id", n_rows=n_rows).collect()}
        assert a == b


def test_evaluation_batches_stay_within_a_split(spark):
    df = spark.range(100).select((F.col("id") * 7919 + (1 << 60)).alias("i"), F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"))
    got = D.fixed_batches(df, "i", 32, ["split"]).groupBy("split", "batch_id").count().collect()
    assert sorted((r["split"], r["batch_id"], r["count"]) for r in got) == [("test", 0, 20), ("train", 0, 32), ("train", 1, 32), ("train", 2, 16)]
