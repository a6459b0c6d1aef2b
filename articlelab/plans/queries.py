"""Query registry: name -> callable(spark, sf_dir) -> DataFrame.

Each query composes operators from ``articlelab`` over the driver tables
(or views Spark derives from them) and returns a lazy DataFrame whose
columns match the oracle SQL of ``articlelab.plans.oracle``.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articlelab.functions import text as T
from articlelab.operators import vectors as V
from articlelab.operators.rows import explode_rows, spread
from articlelab.plans.common import expand, r6
from articlelab.session import materialize
from articlelab.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


WV_DIM = 8


def _doc_tokens(spark, sf_dir):
    docs = S.text_table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.flat_tokens("text").alias("tokens"))


@query
def article_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 + E6 (+ G5-G8): mean word vector of every document."""
    toks = materialize(_doc_tokens(spark, sf_dir), "token-lists")       # the tokeniser runs once
    wv = V.hash_vectors_of_lists(toks, WV_DIM)
    vecs = V.article_mean_vectors(toks, wv, ["doc_id"], written=True)
    return vecs.select("doc_id", "n_tokens", "n_known", *expand("features", WV_DIM))


# --------------------------------------------------------------------------
# Cleaning, sampling, splitting (P1, P2, P9, C*, D*, A4, B3, E1-E5)
from articlelab.operators import cleaning as C  # noqa: E402
from articlelab.operators import keys as K  # noqa: E402
from articlelab.operators import labels as L  # noqa: E402
from articlelab.operators import sampling as D  # noqa: E402

WIKIHOW_N = 200
STRATA = ("human", "gpt")
STRATUM_N = 50
BATCH = 64
RESUME_FROM = 3
SHORT_CLASS_MAP = {"en": 0, "fr": 1}


@query
def wikihow_subset(spark, sf_dir):
    """C5 D6 G1-G3 C7 D3."""
    return C.wikihow_subset(S.wikihow(spark, sf_dir), WIKIHOW_N).select(
        "doc_id", "original_row_number", "title", "headline", "sectionLabel", "length")


@query
def prompt_queries(spark, sf_dir):
    """G4 prompts over every cleaned WikiHow row."""
    return C.with_prompts(C.wikihow_clean(S.wikihow(spark, sf_dir))).select("doc_id", "query")


@query
def type_counts(spark, sf_dir):
    """Rows per article type."""
    return S.articles(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query
def conditional_counts(spark, sf_dir):
    """Total, per-type conditional counts, distinct types."""
    a = S.articles(spark, sf_dir)
    return a.agg(F.count(F.lit(1)).cast("bigint").alias("n_articles"),
                 F.count_if(F.col("type") == "gpt").cast("bigint").alias("n_gpt"),
                 F.count_if(F.col("type") == "human").cast("bigint").alias("n_human"),
                 F.countDistinct("type").cast("bigint").alias("n_types"))


@query
def class_index(spark, sf_dir):
    """E4 + F1: class number = position of the type in the sorted types."""
    a = S.articles(spark, sf_dir)
    return L.apply_class_map(a, L.class_map(a)).select("doc_id", "type", "label")


@query
def relabel_dense(spark, sf_dir):
    """F2 + F7: labels 3k+1 re-indexed to 0..K-1 over train and test together."""
    f = S.features(spark, sf_dir).select("vec_id", "split", (F.col("label") * 3 + 1).cast("bigint").alias("raw_label"))
    return L.dense_labels(f, "raw_label", "label").select("vec_id", "split", "raw_label", "label")


@query
def unmapped_types(spark, sf_dir):
    """C13 + S3: document languages without a class number in a short map."""
    d = S.table(spark, sf_dir, "documents").select(F.col("lang").alias("type"))
    return L.unmapped(d, L.literal_map(spark, SHORT_CLASS_MAP)).select("type", "n")


@query
def shuffle_head(spark, sf_dir):
    """D1 + D2: first 100 documents after the seeded shuffle."""
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    return D.shuffled_head(d, "doc_id", 100).select("doc_id", "row_no")


@query
def train_test_split(spark, sf_dir):
    """D4 (+ D1, D6): exact 80/20 split by shuffled position."""
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    return D.train_test_split(d, "doc_id").select("doc_id", "row_no", "split")


@query
def stratified_sample(spark, sf_dir):
    """D5 + S1: exactly 50 human and 50 gpt articles."""
    a = S.articles(spark, sf_dir).select("doc_id", "type")
    picked = D.stratified_sample(a, "doc_id", "type", STRATA, STRATUM_N)
    return D.seeded_order(picked, "doc_id", by=["type"]).select("doc_id", "type", "row_no")


@query
def batch_slices(spark, sf_dir):
    """A4 + E5: file-order row numbers, 64-row batches, batch count."""
    d = S.table(spark, sf_dir, "documents").select("doc_id")
    return D.numbered_batches(d, "doc_id", BATCH).select("doc_id", "row_no", "batch_no", "n_batches")


@query
def resume_pending(spark, sf_dir):
    """Rows still to embed when batches 0..2 are already written."""
    b = D.numbered_batches(S.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", BATCH)
    finished = b.where(F.col("batch_no") < RESUME_FROM).select("batch_no")
    return D.pending_batches(b, finished).select("doc_id", "batch_no")


@query
def blank_null_filter(spark, sf_dir):
    """C5 + C6: drop null and blank texts."""
    d = C.drop_blank_text(C.drop_null_text(S.dirty(spark, sf_dir)))
    return d.select("doc_id", "type", F.md5("text").alias("text_md5"))


@query
def literal_type(spark, sf_dir):
    """The clean-up of the batched encoder with a literal type."""
    d = C.clean_articles(S.dirty(spark, sf_dir), literal_type="llama")
    return d.select("doc_id", "type", F.length("text").cast("bigint").alias("n_chars"))


# --------------------------------------------------------------------------
# Tokens, vocabulary, pooling, importance
from articlelab.operators import vocab as W  # noqa: E402

FIRST_K = 1000
CONV_IDS = ["conv_id", "turn"]


def _joined_sentences(col):
    return F.array_join(F.transform(col, lambda s: F.array_join(s, " ")), "\n")


@query
def sentence_tokens(spark, sf_dir):
    """G5-G8 + C15: sentence and word tokens of every document."""
    d = S.text_table(spark, sf_dir, "documents").select("doc_id", T.sentence_tokens("text").alias("st"))
    return d.select("doc_id", F.size("st").cast("bigint").alias("n_sentences"),
                    F.size(F.flatten("st")).cast("bigint").alias("n_tokens"),
                    F.md5(_joined_sentences(F.col("st"))).alias("tokens_md5"))


@query
def contraction_fix(spark, sf_dir):
    """G9 + G10: contraction fix on the joined token string of each turn."""
    c = S.text_table(spark, sf_dir, "conversations").select(*CONV_IDS, T.flat_tokens("text", lower=False).alias("t"))
    j = c.select(*CONV_IDS, "t", T.join_tokens("t").alias("j"))
    n_fix = (F.length("j") - F.length(F.replace(F.col("j"), F.lit(T.CONTRACTION_FROM), F.lit("")))) / len(T.CONTRACTION_FROM)
    return j.select(*CONV_IDS, F.size("t").cast("bigint").alias("n_tokens"),
                    n_fix.cast("bigint").alias("n_contractions"),
                    F.md5(T.fix_contractions("j")).alias("fixed_md5"))


@query
def boundary_tokens(spark, sf_dir):
    """Every sentence of every turn wrapped in <p> ... </p>."""
    c = S.text_table(spark, sf_dir, "conversations").select(
        *CONV_IDS, F.transform(T.sentence_tokens("text"), lambda s: T.with_boundaries(s)).alias("w"))
    return c.select(*CONV_IDS, F.size("w").cast("bigint").alias("n_sentences"),
                    F.size(F.flatten("w")).cast("bigint").alias("n_tokens"),
                    F.md5(_joined_sentences(F.col("w"))).alias("tokens_md5"))


def _vocab(spark, sf_dir, name, lower=True):
    t = S.text_table(spark, sf_dir, name).select(T.flat_tokens("text", lower).alias("tokens"))
    return W.corpus_vocabulary(t)


@query
def vocabulary(spark, sf_dir):
    """Distinct tokens of the documents plus <p> and </p>."""
    return _vocab(spark, sf_dir, "documents")


@query
def vocab_update(spark, sf_dir):
    """F5 + F3: benchmark vocabulary extended by the new document words
    that have a vector."""
    known = _vocab(spark, sf_dir, "benchmark")
    corpus = materialize(_vocab(spark, sf_dir, "documents"), "vocabulary")
    wv = V.hash_word_vectors(known.unionByName(corpus), WV_DIM).checkpointed()
    return W.vocab_update(known, corpus, wv).select("token", "origin")


@query
def first_k_vectors(spark, sf_dir):
    """First 1,000 rows of the word-vector file (file order = md5 of
    the token) plus the boundary tokens."""
    wv = V.hash_word_vectors(_vocab(spark, sf_dir, "documents"), WV_DIM)
    f = wv.df.withColumn("_file_key", F.md5("token"))
    return W.first_k_vectors(f, "_file_key", FIRST_K, hex_key=True).select("token", "row_no")


def _benchmark_kept(spark, sf_dir):
    b = explode_rows(S.text_table(spark, sf_dir, "benchmark"), ["item_id"],
                     T.sentence_tokens("text", lower=False), "tokens", pos="sent_no")
    vocab = W.corpus_vocabulary(b.select("tokens"))
    wv = V.hash_word_vectors(vocab, WV_DIM).checkpointed()
    return W.kept_sentences(b, ["item_id"], wv)


@query
def oov_fallback(spark, sf_dir):
    """per benchmark sentence, <p> + words with a vector + </p>;
    an emptied sentence becomes [</p>]."""
    k = _benchmark_kept(spark, sf_dir)
    return k.select("item_id", F.col("sent_no").cast("bigint").alias("sent_no"),
                    F.col("n_words").cast("bigint").alias("n_words"),
                    F.size("kept").cast("bigint").alias("n_kept"),
                    F.md5(F.array_join("kept", " ")).alias("kept_md5"))


@query
def vocab_coverage(spark, sf_dir):
    """Percentage of benchmark words (boundary tokens included) kept."""
    c = W.coverage(_benchmark_kept(spark, sf_dir))
    return c.select("n_words", "n_kept", r6(F.col("pct")).alias("pct"))


@query
def word_importance(spark, sf_dir):
    """Share of vector dimensions whose maximum each token holds."""
    b = S.text_table(spark, sf_dir, "benchmark").select("item_id", T.word_tokens("text", lower=False).alias("tokens"))
    wv = V.hash_word_vectors(W.corpus_vocabulary(b), WV_DIM).checkpointed()
    w = W.word_importance(b, ["item_id"], wv)
    return w.select("item_id", "tok_no", "token", "n", r6(F.col("pct")).alias("pct"))


@query
def word_importance_wide(spark, sf_dir):
    """E23 at 200 dimensions."""
    b = S.text_table(spark, sf_dir, "benchmark").select("item_id", T.word_tokens("text", lower=False).alias("tokens"))
    w = W.word_importance(b, ["item_id"], _wide_vectors(W.corpus_vocabulary(b)))
    return w.select("item_id", "tok_no", "token", "n", r6(F.col("pct")).alias("pct"))


def _conversation_pool(spark, sf_dir, pool):
    c = S.text_table(spark, sf_dir, "conversations").select(*CONV_IDS, T.sentence_tokens("text").alias("sentences"))
    rows = V.sentence_token_rows(c, CONV_IDS)
    wv = V.hash_word_vectors(rows.select("token"), WV_DIM).checkpointed()
    sv = V.pooled_sentence_vectors(rows, wv, CONV_IDS, pool)
    doc = V.mean_of_sentences(sv, WV_DIM, CONV_IDS)
    return doc.select(*CONV_IDS, "n_sentences", *expand("features", WV_DIM))


@query
def sentence_mean_vectors(spark, sf_dir):
    """E8 + E7: mean-pooled sentence vectors, averaged per turn."""
    return _conversation_pool(spark, sf_dir, "mean")


@query
def max_pool(spark, sf_dir):
    """E9 + E7: max-pooled sentence vectors, averaged per turn."""
    return _conversation_pool(spark, sf_dir, "max")


# --------------------------------------------------------------------------
# Metrics over stored scores, run records
from articlelab.operators import metrics as M  # noqa: E402
from articlelab.operators import runs as R  # noqa: E402

KEYS = ["split", "epoch"]
INSPECT_EPOCH = 5
MODEL_NAME = "SimpleMLP"


def _scored(spark, sf_dir):
    return M.score_rows(S.scores(spark, sf_dir))


@query
def predictions(spark, sf_dir):
    """H1 + H2: softmax winner and its probability."""
    s = _scored(spark, sf_dir)
    return s.select("vec_id", "epoch", "split", F.col("label").cast("bigint").alias("label"),
                    F.col("pred").cast("bigint").alias("pred"), r6(F.col("p_max")).alias("p_max"))


@query
def epoch_metrics(spark, sf_dir):
    """Per split and epoch, accuracy and losses."""
    m = M.epoch_metrics(_scored(spark, sf_dir), KEYS)
    return m.select(*KEYS, "n", "correct", r6(F.col("accuracy")).alias("accuracy"),
                    r6(F.col("loss")).alias("loss"), r6(F.col("row_loss")).alias("row_loss"))


@query
def batch_mean_loss(spark, sf_dir):
    """E10 + D8: mean loss of every 32-row batch."""
    b = M.batch_losses(_scored(spark, sf_dir), KEYS)
    return b.select(*KEYS, "batch_id", "n", r6(F.col("mean_loss")).alias("mean_loss"))


@query
def confusion_long(spark, sf_dir):
    """Confusion counts in long form."""
    return M.confusion(_scored(spark, sf_dir), KEYS)


@query
def confusion_dense(spark, sf_dir):
    """Zero-filled confusion grid over the full label set."""
    return M.dense_confusion(M.confusion(_scored(spark, sf_dir), KEYS), KEYS).select(
        *KEYS, "true_label", "pred_label", "n")


@query
def confusion_at_epoch(spark, sf_dir):
    """Confusion of epoch 5 (the last epoch if there are fewer)."""
    c = M.confusion(_scored(spark, sf_dir), KEYS)
    return M.at_epoch(c, INSPECT_EPOCH, group=["split"]).select(*KEYS, "true_label", "pred_label", "n")


@query
def weighted_f1_by_epoch(spark, sf_dir):
    """E14 + E15: support-weighted F1 per split and epoch."""
    f = M.weighted_f1(M.confusion(_scored(spark, sf_dir), KEYS), KEYS)
    return f.select(*KEYS, r6(F.col("f1")).alias("f1"), "n")


@query
def final_metrics(spark, sf_dir):
    """Accuracy and loss of the last epoch per split."""
    m = M.epoch_metrics(_scored(spark, sf_dir), KEYS)
    f = M.final_values(m, ["split"], ["accuracy", "loss"])
    return f.select("split", "epoch", r6(F.col("accuracy")).alias("accuracy"), r6(F.col("loss")).alias("loss"))


def _page_paths(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    lang = F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]+)", 1)
    return p.select("page_id", F.concat(F.lit("/runs/"), lang, F.lit("/"),
                                        F.replace(host, F.lit("."), F.lit("_")), F.lit(".csv")).alias("path"))


@query
def run_names(spark, sf_dir):
    """G12 + G14: dataset and encoder names from embedded-table paths
    (built from page URLs), and the run file name."""
    p = _page_paths(spark, sf_dir)
    ds, enc, ok = R.names_from_path("path")
    out = p.select("page_id", "path", ds.alias("ds_name"), enc.alias("embedder_name"), ok.alias("matched"))
    return out.withColumn("run_id", F.when(F.col("matched"), F.concat(
        R.run_identifier("ds_name", "embedder_name", F.lit(MODEL_NAME)), F.lit(".json"))))


@query
def embedder_parts(spark, sf_dir):
    """Embedding type and class type of every run name."""
    r = S.runs(spark, sf_dir).select("embedder_name").distinct()
    emb, cls = R.split_embedder("embedder_name")
    return r.select("embedder_name", emb.alias("embedding_type"), cls.alias("class_type"))


def _runs_checked(spark, sf_dir):
    return R.with_missing(S.runs(spark, sf_dir), ["accuracy", "loss"])


@query
def missing_metrics(spark, sf_dir):
    """C14 + J2: which required metrics each run lacks."""
    r = _runs_checked(spark, sf_dir)
    return r.select("embedder_name", "epoch", "split", "batch_id",
                    F.size("missing").cast("bigint").alias("n_missing"),
                    F.array_join("missing", ",").alias("missing"))


def _valid_runs(spark, sf_dir):
    r = _runs_checked(spark, sf_dir).where(F.size("missing") == 0)
    emb, cls = R.split_embedder("embedder_name")
    return r.withColumn("embedding_type", emb).withColumn("class_type", cls)


@query
def accuracy_by_embedding(spark, sf_dir):
    """Accuracy by embedding type x class type over valid runs."""
    t = R.accuracy_table(_valid_runs(spark, sf_dir), ["embedding_type", "class_type"])
    return t.select("embedding_type", "class_type", r6(F.col("mean_accuracy")).alias("mean_accuracy"),
                    "n_runs", r6(F.col("std_accuracy")).alias("std_accuracy"))


@query
def boost_accuracy_by_embedding(spark, sf_dir):
    """Accuracy by embedding type."""
    t = R.accuracy_table(_valid_runs(spark, sf_dir), ["embedding_type"])
    return t.select("embedding_type", r6(F.col("mean_accuracy")).alias("mean_accuracy"),
                    "n_runs", r6(F.col("std_accuracy")).alias("std_accuracy"))


@query
def runs_json_roundtrip(spark, sf_dir):
    """J1 + B4 + A9: scores -> network-run record (series + confusion maps,
    outer key = predicted) -> JSON text -> typed record -> long form."""
    s = _scored(spark, sf_dir)
    m = M.epoch_metrics(s, KEYS)
    rec = R.network_run_records(m, M.confusion(s, KEYS), [], {})
    rec = rec.select(F.lit("fixture").alias("original_dataset_name"),
                     F.lit("hash8_scores").alias("embedder_name"), "experiment_result")
    back = R.record_from_json(R.record_to_json(rec, rec.columns), R.NETWORK_RUN_DDL)
    er = back.select("experiment_result.*")
    parts = []
    for split, cm, acc in (("train", "training_classification_results", "training_accuracies"),
                           ("test", "testing_classification_results", "testing_accuracies")):
        conf = R.confusion_from_record(er.select(cm), [], cm, outer_is="pred")
        accs = R.series_from_record(er.select(acc), [], {"accuracy": acc}).select(
            "epoch", F.col("value").alias("accuracy"))
        parts.append(conf.join(accs, "epoch").withColumn("split", F.lit(split)))
    out = parts[0].unionByName(parts[1])
    return out.select("split", F.col("epoch").cast("bigint").alias("epoch"), "true_label", "pred_label", "n",
                      r6(F.col("accuracy")).alias("accuracy"))


# --------------------------------------------------------------------------
# Images (H3-H6, E24) and the embedded table
from articlelab.functions import vectors as FV  # noqa: E402
from articlelab.operators import encode as EN  # noqa: E402
from articlelab.operators import images as IM  # noqa: E402

FEATURE_DIM = 64


def _image_stats(img: str, side: int):
    p = F.col(f"{img}.pixels")
    n = F.size(p)
    return [n.cast("bigint").alias("n_pixels"),
            r6(FV.array_sum(p) / n / F.lit(FV.PIXEL_SCALE)).alias("pix_mean"),
            r6(FV.array_sum(IM.diagonal(p, side)) / F.lit(side) / F.lit(FV.PIXEL_SCALE)).alias("trace_mean"),
            r6(F.array_max(p) / F.lit(FV.PIXEL_SCALE)).alias("pix_max")]


@query
def minmax_outer(spark, sf_dir):
    """E24 + H3 + H4: min/max of each vector and its 64 x 64 outer-product image."""
    f = S.features(spark, sf_dir)
    img = IM.with_image(f.select("vec_id", "features", F.array_min("features").alias("vmin"),
                                 F.array_max("features").alias("vmax")), "features", FEATURE_DIM,
                        resize=False, out="img")
    return img.select("vec_id", r6(F.col("vmin")).alias("vmin"), r6(F.col("vmax")).alias("vmax"),
                      *_image_stats("img", FEATURE_DIM))


@query
def resize_image(spark, sf_dir):
    """H5: the image resized to 100 x 100 (separable resample)."""
    f = S.features(spark, sf_dir)
    img = IM.with_image(f.select("vec_id", "features"), "features", FEATURE_DIM, resize=True, out="img")
    return img.select("vec_id", *_image_stats("img", FV.IMAGE_SIDE))


@query
def normalise_image(spark, sf_dir):
    """H6: resized image normalised to -1..1."""
    f = S.features(spark, sf_dir)
    img = IM.with_image(f.select("vec_id", "features"), "features", FEATURE_DIM, out="img")
    img = img.select("vec_id", IM.normalised_image("img").alias("img"))
    p = F.col("img.pixels")
    return img.select("vec_id", r6(FV.array_sum(p) / F.size(p)).alias("mean"),
                      r6(F.array_min(p)).alias("min"), r6(F.array_max(p)).alias("max"))


def _embedded(spark, sf_dir):
    # split known per id first; the texts are then read once for the vocabulary and once for the vectors
    a = D.with_split(S.articles(spark, sf_dir), "doc_id")
    enc = EN.MeanWordVectorEncoder(WV_DIM).fit(a.where(F.col("split") == "train"))
    return EN.embedded_table(a, enc)


@query
def embedded_table(spark, sf_dir):
    """Flagship (P10 = D4 + M5 + M3 + F1 + C12): labelled articles, exact
    seeded 80/20 split, vocabulary fitted on the train split only, mean
    word vectors, class numbers fitted once."""
    e = _embedded(spark, sf_dir)
    return e.select("doc_id", "split", "label", *expand("features", WV_DIM))


@query
def feature_metadata(spark, sf_dir):
    """C12 + C17: vector width range and class count of the embedded table."""
    e = _embedded(spark, sf_dir)
    return e.groupBy("split").agg(F.min(F.size("features")).cast("bigint").alias("min_width"),
                                  F.max(F.size("features")).cast("bigint").alias("max_width"),
                                  F.countDistinct("label").cast("bigint").alias("n_classes"),
                                  F.count(F.lit(1)).cast("bigint").alias("n_rows"))


# --------------------------------------------------------------------------
# Trainers, user encoders, streaming (rows-only checks: M1, M6-M10, T1)
from articlelab.session import scratch_path  # noqa: E402
from articlelab.streaming import incremental as ST  # noqa: E402
from articlelab.train import exact_stumps as EX  # noqa: E402
from articlelab.train import networks as NN  # noqa: E402
from articlelab.train import samme as SA  # noqa: E402

EPOCHS = 10
LEARNING_RATE = 0.001
N_CLASSES = 10


def _train_network(spark, sf_dir, cls):
    f = S.features(spark, sf_dir)
    model = cls(FEATURE_DIM, N_CLASSES, learning_rate=LEARNING_RATE)
    res = NN.train(model, f, epochs=EPOCHS)
    return NN.history_frame(spark, res)


@query
def softmax_regression(spark, sf_dir):
    """M8 + M11: data-parallel softmax regression, per-epoch history."""
    return _train_network(spark, sf_dir, NN.SoftmaxRegression)


@query
def mlp(spark, sf_dir):
    """M9 + M11: one-hidden-layer network with Adam, per-epoch history."""
    return _train_network(spark, sf_dir, NN.SimpleMLP)


@query
def samme(spark, sf_dir):
    """M10 + F7 + E11 + E12: SAMME stumps on the train split, test predictions."""
    f = L.dense_labels(S.features(spark, sf_dir), "label", "label")
    k = f.select("label").distinct().count()
    model = SA.fit_hist(f.where(F.col("split") == "train"), k)
    test = f.where(F.col("split") == "test")
    return model.decision(test).select("vec_id", F.col("label").cast("bigint").alias("label"),
                                       F.col("pred").cast("bigint").alias("pred"))


@query
def word2vec_train(spark, sf_dir):
    """M1 + E6: continuous bag of words (100 dims, window 5, min count 1) on the
    document sentences, then article vectors with the learnt vectors: every
    token is in the vocabulary, and the vector is a number everywhere."""
    d = S.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    enc = EN.Word2VecEncoder(dim=100).fit(d)
    v = enc.transform(d, ["doc_id"])
    return v.select("doc_id", "n_tokens", F.size("features").cast("bigint").alias("width"),
                    F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x)).alias("finite"),
                    (FV.array_sum(F.transform("features", F.abs)) > 0).alias("learnt"))


@query
def user_encoder(spark, sf_dir):
    """M6 + D9 + E7: a user sentence encoder run per Arrow batch, mean per document."""
    d = S.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    enc = EN.SentenceEncoder(dim=16)
    return enc.transform(d, ["doc_id"]).select("doc_id", *expand("features", 16))


#: Bytes of arrived files that a micro-batch takes (one file at least).
ARRIVAL_BYTES = 2 << 30


@query
def incremental_embed(spark, sf_dir):
    """T1 + M7: stream the documents file through the encoder (available-now
    trigger, checkpointed, idempotent per micro-batch)."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    sink, ckpt = scratch_path(spark, "embed-sink"), scratch_path(spark, "embed-ckpt")

    def embed(batch):
        toks = materialize(spread(batch).select("doc_id", T.flat_tokens("text").alias("tokens")), "token-lists")     # the tokeniser runs once
        wv = V.hash_vectors_of_lists(toks, WV_DIM)
        return V.article_mean_vectors(toks, wv, ["doc_id"], written=True).select("doc_id", "n_tokens", "n_known", *expand("features", WV_DIM))

    # a table is one file of that name or a folder of part files: each file is met once, as
    # a micro-batch takes many
    ST.embed_stream(spark, f"{sf_dir.rstrip('/')}/{{documents.parquet}}", docs.schema, sink, ckpt, embed, max_bytes=ARRIVAL_BYTES)
    names = ["doc_id", "n_tokens", "n_known", *[f"f{i}" for i in range(WV_DIM)]]
    schema = "doc_id bigint, n_tokens bigint, n_known bigint, " + ", ".join(f"f{i} double" for i in range(WV_DIM))
    return ST.read_sink(spark, sink, schema).select(*names)


# --------------------------------------------------------------------------
# Sinks read back by the sources (B1 + A6, B4 + A9/A10, B2 + B3)
from articlelab.sinks import writers as SK  # noqa: E402
from articlelab.sources import files as FS  # noqa: E402


@query
def embedded_csv_roundtrip(spark, sf_dir):
    """B1 + A6: the embedded table written as ``doc_id, split, label,
    f0..f7`` CSV into the shared folder, then read back."""
    path = scratch_path(spark, "embedded-csv")
    SK.write_csv(_embedded(spark, sf_dir), path, widths={"features": WV_DIM})
    back = FS.read_embedded_csv(spark, path, WV_DIM, keys="doc_id bigint, split string")
    return back.select("doc_id", "split", F.col("label").cast("bigint").alias("label"),
                       *expand("features", WV_DIM))


@query
def runs_json_files(spark, sf_dir):
    """B4 + A9 + A10: the network-run record written as a JSON file, read
    back with the run-file reader (quarantine empty), flattened."""
    s = _scored(spark, sf_dir)
    m = M.epoch_metrics(s, KEYS)
    rec = R.network_run_records(m, M.confusion(s, KEYS), [], {}).select(
        F.lit("fixture").alias("original_dataset_name"), F.lit("hash8_scores").alias("embedder_name"),
        "experiment_result")
    path = scratch_path(spark, "runs")
    SK.write_json_records(rec.coalesce(1), path)
    good, _ = R.read_run_files(spark, path)
    er = good.select("experiment_result.*")
    parts = []
    for split, cm, acc in (("train", "training_classification_results", "training_accuracies"),
                           ("test", "testing_classification_results", "testing_accuracies")):
        conf = R.confusion_from_record(er.select(cm), [], cm, outer_is="pred")
        accs = R.series_from_record(er.select(acc), [], {"accuracy": acc}).select(
            "epoch", F.col("value").alias("accuracy"))
        parts.append(conf.join(accs, "epoch").withColumn("split", F.lit(split)))
    out = parts[0].unionByName(parts[1])
    return out.select("split", F.col("epoch").cast("bigint").alias("epoch"), "true_label", "pred_label", "n",
                      r6(F.col("accuracy")).alias("accuracy"))


@query
def batched_vectors(spark, sf_dir):
    """B2 + B3 + M7: article vectors written one folder per 64-row batch;
    the first three batches first, then only the pending ones (resume);
    everything read back."""
    toks = _doc_tokens(spark, sf_dir)
    wv = V.hash_word_vectors(explode_rows(toks, [], "tokens"), WV_DIM).checkpointed()
    # number the input rows first; only the batches still pending are embedded
    numbered = D.numbered_batches(S.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", BATCH)
    batched = toks.join(materialize(numbered.select("doc_id", "batch_no"), "batch-numbers"), "doc_id")

    def embed(rows):
        return V.article_mean_vectors(rows, wv, ["doc_id", "batch_no"])

    path = scratch_path(spark, "batches")
    SK.write_batches(embed(batched.where(F.col("batch_no") < RESUME_FROM)), path)
    SK.write_batches(embed(D.pending_batches(batched, SK.finished_batches(spark, path))), path)
    back = spark.read.parquet(path)
    return back.select("doc_id", F.col("batch_no").cast("bigint").alias("batch_no"), "n_tokens",
                       *expand("features", WV_DIM))


# --------------------------------------------------------------------------
# Wide vectors, over-budget joins, job ends, trainer steps
from articlelab.plans import jobs as J  # noqa: E402

WIDE_DIM = 200
COLD_BUDGET = 8192          # bytes: a few dozen hot tokens, the rest joined by sort-merge
STOP_BEFORE = 2


def _wide_summary():
    shown = [r6(F.col("features")[i]).alias(f"f{i}") for i in (0, 63, 128, 199)]
    return [*shown, r6(FV.array_sum("features")).alias("total")]


def _wide_vectors(rows):
    return V.hash_word_vectors(rows, WIDE_DIM).checkpointed()


@query
def wide_article_vectors(spark, sf_dir):
    """E6 at 200 dimensions, with null and blank texts."""
    docs = spread(S.dirty(spark, sf_dir)).select("doc_id", T.flat_tokens("text").alias("tokens"))
    wv = _wide_vectors(explode_rows(docs, [], "tokens"))
    return V.article_mean_vectors(docs, wv, ["doc_id"]).select("doc_id", "n_tokens", "n_known", *_wide_summary())


def _wide_sentences(spark, sf_dir, pool):
    docs = spread(S.dirty(spark, sf_dir)).select("doc_id", T.sentence_tokens("text").alias("sentences"))
    docs = materialize(docs, "sentence-lists", codec="zstd")       # the tokeniser runs once
    wv = _wide_vectors(explode_rows(docs, [], F.flatten("sentences")))
    return V.article_sentence_vectors(docs, wv, ["doc_id"], pool).select("doc_id", "n_sentences", *_wide_summary())


@query
def wide_sentence_vectors(spark, sf_dir):
    """E8 + E7 at 200 dimensions, with documents without sentences."""
    return _wide_sentences(spark, sf_dir, "mean")


@query
def wide_sentence_max(spark, sf_dir):
    """E9 + E7 at 200 dimensions."""
    return _wide_sentences(spark, sf_dir, "max")


@query
def article_vectors_cold(spark, sf_dir):
    """F6 + E6 with a vector table far over the broadcast budget."""
    toks = _doc_tokens(spark, sf_dir)
    wv = V.hash_word_vectors(explode_rows(toks, [], "tokens"), WV_DIM).checkpointed()
    vecs = V.article_mean_vectors(toks, wv, ["doc_id"], budget=COLD_BUDGET)
    return vecs.select("doc_id", "n_tokens", "n_known", *expand("features", WV_DIM))


@query
def csv_batches_resume(spark, sf_dir):
    """A1 + A3 + A4 + C5-C9 + M7 + B2 + B3 (P4): articles with null and blank
    texts and exact copies written as CSV files, embedded batch by batch; the
    first run stops early, the second does what is pending."""
    csv, out = scratch_path(spark, "articles-csv"), scratch_path(spark, "article-batches")
    dirty = S.dirty(spark, sf_dir)
    _in_files(dirty, 4).select("type", "text").write.option("header", True).option("escape", '"').csv(csv)
    enc = EN.MeanWordVectorEncoder(WV_DIM).fit(FS.read_csv(spark, csv))
    # stretches of 256 KB, so that these files have several
    J.embed_csv_batches(spark, csv, out, enc, batch_size=BATCH, stop_before=STOP_BEFORE, range_bytes=1 << 18)
    back = J.embed_csv_batches(spark, csv, out, enc, batch_size=BATCH, range_bytes=1 << 18)
    return back.select("file_row", F.col("batch_no").cast("bigint").alias("batch_no"), "label", *expand("features", WV_DIM))


@query
def split_first_rows(spark, sf_dir):
    """D4 with ``n_rows``: the first 300 rows of the shuffle, split 80/20."""
    return D.with_split(S.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", n_rows=300)


@query
def many_classes(spark, sf_dir):
    """E4 + F1 over a class per line item: no bound on the number of classes."""
    rows = S.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("c"), "l_orderkey", F.lit("-"), "l_linenumber").alias("type"))
    return L.apply_class_map(rows, L.class_map(rows)).select(
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"), F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "label")


@query
def gradient_step(spark, sf_dir):
    """M8: one synchronous gradient of softmax regression from zero weights."""
    import numpy as np
    f = S.features(spark, sf_dir).where(F.col("split") == "train")
    model = NN.SoftmaxRegression(FEATURE_DIM, N_CLASSES)
    model.params = [np.zeros_like(p) for p in model.params]
    g, _, _ = NN.gradient_step(model, f)
    rows = [(i, k, float(round(v, 6)) + 0.0) for (i, k), v in np.ndenumerate(model.unflat(g)[0])]
    return spark.createDataFrame(rows, "feature bigint, class bigint, gradient double")


@query
def boosting_round(spark, sf_dir):
    """One boosting round over given thresholds."""
    import numpy as np
    f = S.features(spark, sf_dir).where(F.col("split") == "train")
    data = f.select(F.col("features").alias("x"), F.col("label").cast("int").alias("y"))
    m = SA.boost(data, [np.array([-0.1, 0.0, 0.1])] * FEATURE_DIM, N_CLASSES, n_rounds=1)
    rows = [(s.feature, s.threshold, s.left, s.right, round(e, 6)) for s, e in zip(m.stumps, m.errors, strict=True)]
    return spark.createDataFrame(rows, "feature bigint, threshold double, left_class bigint, right_class bigint, error double")


@query
def boosting_vote(spark, sf_dir):
    """M10 + B7: three stumps saved, loaded and voted."""
    stumps = [SA.Stump(0, 0.0, 1, 2), SA.Stump(5, 0.05, 2, 0), SA.Stump(63, -0.05, 0, 1)]
    path = scratch_path(spark, "stumps")
    SA.save_stumps(spark, SA.HistSammeModel(stumps, [1.5, 1.0, 0.75], [0.1, 0.2, 0.3], 3), path)
    voted = SA.load_stumps(spark, path).decision(S.features(spark, sf_dir))
    return voted.select("vec_id", F.col("pred").cast("bigint").alias("pred"))


@query
def run_files_many(spark, sf_dir):
    """A9 + A10 + C14 + E20 (P15): many boosting records in several files, one
    of them without accuracy, and a broken file: tables and quarantine."""
    path = scratch_path(spark, "boost-runs")
    runs = S.runs(spark, sf_dir)
    one = F.create_map(F.lit("0"), F.create_map(F.lit("0"), F.lit(1).cast("bigint")))
    SK.write_json_records(runs.select(F.lit("fixture").alias("original_ds_name"), "embedder_name", "accuracy",
                                      one.alias("classification_makeup")).repartition(5, "embedder_name"), f"{path}/good")
    spark.range(1).select(F.lit('{"original_ds_name": "fixture", "accuracy"').alias("value")).coalesce(1).write.text(f"{path}/bad")
    files = [r["f"] for r in spark.read.option("recursiveFileLookup", True).text([f"{path}/good", f"{path}/bad"]).select(
        F.col("_metadata.file_path").alias("f")).distinct().collect()]
    t = J.visualize_adaboost_tables(spark, files)
    acc = t["accuracy_by_embedding"].select(F.col("embedding_type").alias("what"), r6(F.col("mean_accuracy")).alias("mean_accuracy"), F.col("n_runs").alias("n"))
    why = F.when(F.col("_corrupt_record") == "accuracy", F.lit("quarantine:accuracy")).otherwise(F.lit("quarantine:broken"))
    bad = t["quarantine"].groupBy(why.alias("what")).agg(F.lit(None).cast("double").alias("mean_accuracy"), F.count(F.lit(1)).alias("n"))
    return acc.unionByName(bad)


@query
def samme_exact_round(spark, sf_dir):
    """Two boosting rounds whose stumps try every distinct value of every
    feature, the second under the weights that the first leaves."""
    f = S.features(spark, sf_dir).where(F.col("split") == "train")
    m = EX.fit_exact(f, N_CLASSES, n_rounds=2)
    rows = [(i + 1, s.feature, round(s.threshold, 6), s.left, s.right, round(e, 6), round(a, 6))
            for i, (s, e, a) in enumerate(zip(m.stumps, m.errors, m.alphas, strict=True))]
    return spark.createDataFrame(rows, "round bigint, feature bigint, threshold double, left_class bigint, right_class bigint, "
                                       "error double, alpha double")


@query
def local_sgd_round(spark, sf_dir):
    """M8: a round of local training from zero weights: replicas of some 128 rows
    run their 32-row steps, then weights are averaged by rows."""
    import numpy as np
    f = S.features(spark, sf_dir).where(F.col("split") == "train")
    replicas = max(1, f.count() // 128)
    model = NN.SoftmaxRegression(FEATURE_DIM, N_CLASSES, learning_rate=0.5)
    model.params = [np.zeros_like(p) for p in model.params]
    NN.LS.local_round(model, NN.LS.deal(f, "vec_id", replicas, model.seed), replicas)
    rows = [(i, k, float(round(v, 6)) + 0.0) for (i, k), v in np.ndenumerate(np.vstack([model.params[0], model.params[1]]))]
    return spark.createDataFrame(rows, "feature bigint, class bigint, weight double")


@query
def mlp_step(spark, sf_dir):
    """M9: back-propagation over all training rows from given weights, and the
    first Adam step."""
    import numpy as np
    model = NN.SimpleMLP(FEATURE_DIM, N_CLASSES, learning_rate=LEARNING_RATE)
    at = lambda *shape: np.indices(shape)
    (i, j), (u,), (a, k), (c,) = at(FEATURE_DIM, model.hidden), at(model.hidden), at(model.hidden, N_CLASSES), at(N_CLASSES)
    model.params = [((i * 7 + j * 13) % 11 - 5) / 50, (u * 5 % 7 - 3) / 50, ((a * 3 + k * 17) % 13 - 6) / 60, (c * 11 % 5 - 2) / 50]
    g, _, _ = NN.gradient_step(model, S.features(spark, sf_dir).where(F.col("split") == "train"))
    model.apply(g)
    rows = []
    for name, p, d in zip(("w1", "b1", "w2", "b2"), model.params, model.unflat(g), strict=True):
        for (r, q), v in np.ndenumerate(np.atleast_2d(d)):
            rows.append((name, r, q, float(round(v, 8)) + 0.0, float(round(np.atleast_2d(p)[r, q], 6)) + 0.0))
    return spark.createDataFrame(rows, "layer string, row bigint, col bigint, gradient double, weight double")


@query
def cbow_step(spark, sf_dir):
    """M1: one round of word-vector training, an update of every lot of some
    20,000 tokens at given vectors: windows, negative samples, gradients and the
    average over lots."""
    from articlelab.train import word_vectors as WV
    docs = S.text_table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(T.sentence_tokens("text")).alias("no", "tokens"))
    path = scratch_path(spark, "sentences")
    sents = materialize(docs.where(F.col("tokens").isNotNull()).select(F.concat_ws(":", "doc_id", "no").alias("sid"), "tokens"), path=path)
    dealt = WV.prepared(sents, 1, 42, 20_000, 2_000, 2 * WV_DIM * 8)
    start = dealt.vocab.select("word", FV.hash_vector("word", WV_DIM).alias("inward"), FV.hash_vector(F.concat("word", F.lit("!")), WV_DIM).alias("outward"))
    # the dealt sentences are written: the vectors take the place of the others
    done = WV.train_round(dealt, materialize(WV.in_blocks(dealt, start), path=path), WV_DIM, 0.5, "42:0", batch=None)
    return WV.by_word(done, ("inward", "outward", "n_in", "n_out")).select("word", "n_in", "n_out", *expand("inward", WV_DIM, "in"), *expand("outward", WV_DIM, "out"))


@query
def numbered_outliers(spark, sf_dir):
    """Row numbers of keys of any spread: the ends of BIGINT, a few very
    large ones, and one that a third of all rows share (told apart by id)."""
    docs = S.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") == 0, F.lit(-(1 << 63)))
                                                      .when(F.col("doc_id") == 1, F.lit((1 << 63) - 1))
                                                      .when(F.col("doc_id") % 50 == 2, F.lit(1 << 60) + F.col("doc_id"))
                                                      .when(F.col("doc_id") % 3 == 0, F.lit(7).cast("long"))
                                                      .otherwise(F.col("doc_id") * 1000 - 40_000).alias("key"))
    return K.with_row_number(docs, "key", tiebreak=["doc_id"], total_name="n_rows")


# --------------------------------------------------------------------------
# Learnt sentences, ordered tokeniser rules
from articlelab.functions import treebank as TB  # noqa: E402
from articlelab.operators import sentences as SE  # noqa: E402


def _with_abbreviations(spark, sf_dir):
    """Documents in which two frequent words became abbreviations."""
    text = F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" Dr. ")), F.lit(" de "), F.lit(" p.m. "))
    return S.text_table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _spoken(spark, sf_dir):
    """Conversations with contractions, quotes, brackets and sums of money."""
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit(" de "), F.lit(" don't ")), F.lit(" the "), F.lit(' (it\'s "so") ')), F.lit(", "), F.lit(", I've "))
    return S.text_table(spark, sf_dir, "conversations").select(*CONV_IDS, F.concat(text, F.lit(' "He cannot," she said; they won\'t pay $3.50...')).alias("text"))


@query
def abbreviation_scores(spark, sf_dir):
    """Counts, likelihood ratios and scores by which abbreviations are learnt."""
    pairs = materialize(SE.pair_counts(_with_abbreviations(spark, sf_dir)), "token-pairs")
    return SE.abbreviation_scores(pairs).select("type", "n_with", "n_without", r6(F.col("log_likelihood"), 4).alias("log_likelihood"),
                                                r6(F.col("score")).alias("score"), "is_abbreviation")


@query
def learnt_sentences(spark, sf_dir):
    """G5 + G6: sentences by boundaries learnt from the same documents."""
    docs = _with_abbreviations(spark, sf_dir)
    out = SE.split_learnt(docs, ["doc_id"], SE.fit_sentences(docs))
    return out.select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.md5(F.array_join("sentences", "\x1f")).alias("sentences_md5"))


@query
def ordered_tokens(spark, sf_dir):
    """Tokens by ordered rewrite rules."""
    w = materialize(_spoken(spark, sf_dir).select(*CONV_IDS, TB.treebank_tokens("text").alias("w")), "tokens")
    return w.select(*CONV_IDS, F.size("w").cast("bigint").alias("n_tokens"), F.size(F.filter("w", lambda x: x == "n't")).cast("bigint").alias("n_contractions"),
                    F.md5(F.array_join("w", " ")).alias("tokens_md5"))


@query
def contractions_fixed(spark, sf_dir):
    """G9 + G10 over tokens that hold contractions."""
    j = materialize(_spoken(spark, sf_dir).select(*CONV_IDS, T.join_tokens(TB.treebank_tokens("text")).alias("j")), "joined")
    return j.select(*CONV_IDS, (F.col("j") != T.fix_contractions("j")).alias("changed"), F.md5(T.fix_contractions("j")).alias("fixed_md5"))


# --------------------------------------------------------------------------
# Trees, files and streams written and read back
from articlelab.sinks import image_tree as IT  # noqa: E402

TREE_SIDE = 8


@query
def image_folder(spark, sf_dir):
    """A12 + B5 + H6: each embedding as an 8 x 8 colour image in a folder per
    label, written by the committing sink and read back as normalised grays."""
    shade = F.transform("embedding", lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((v.cast("double") + 0.5) * 256))).cast("int"))
    hexes = F.array_join(F.transform(shade, lambda r: F.concat(F.lpad(F.hex(r), 2, "0"), F.lpad(F.hex(255 - r), 2, "0"), F.lpad(F.hex(r.bitwiseAND(15) * 16), 2, "0"))), "")
    images = S.table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("class "), "label").alias("folder"), F.col("vec_id").cast("string").alias("name"), F.lit(TREE_SIDE).alias("height"),
        F.lit(TREE_SIDE).alias("width"), F.lit(3).alias("channels"), F.unhex(hexes).alias("data"))
    root = scratch_path(spark, "images")
    IT.write_image_tree(spread(images), root)
    good, _ = IM.read_image_folder(spark, root)
    return good.select(F.regexp_extract("origin", "/([0-9]+)[.]png$", 1).cast("bigint").alias("vec_id"), "label", "height", "width",
                       *[r6(F.element_at("pixels", i)).alias(f"p{i}") for i in (1, 10, 64)], r6(FV.array_sum("pixels")).alias("total"))


@query
def vocabulary_stream(spark, sf_dir):
    """F5 + F3 + T1: the vocabulary of three arriving files kept by a stream, two
    before a restart and one after, with the benchmark's words known."""
    docs = S.text_table(spark, sf_dir, "documents").select("doc_id", "text")
    known = W.corpus_vocabulary(S.text_table(spark, sf_dir, "benchmark").select(T.flat_tokens("text").alias("tokens")))
    known = materialize(known.where(FV.has_hash_vector("token")), "known-words")
    source, sink, checkpoint = (scratch_path(spark, n) for n in ("arrivals", "new-words", "vocabulary-state"))

    def tokens(rows):
        words = rows.select(F.explode(F.concat(F.array(F.lit(T.BOS), F.lit(T.EOS)), F.coalesce(T.flat_tokens("text"), F.array().cast("array<string>")))).alias("token"))
        return words

    def keep(batch):
        return batch.where(FV.has_hash_vector("token")).join(known, "token", "left_anti")

    # an arrival is one file, or several by its bytes, which then make one micro-batch
    files = max(1, -(-_text_bytes(docs) // (3 * CSV_FILE_BYTES)))
    for parts in ((0, 1), (2,)):
        for p in parts:
            arrival = docs.where(F.col("doc_id") % 3 == p)
            (arrival.coalesce(1) if files == 1 else arrival.repartition(files)).write.mode("append").parquet(source)
        ST.vocabulary_stream(spark, source, "doc_id bigint, text string", sink, checkpoint, tokens, keep, max_files=files)
    return known.withColumn("origin", F.lit("known")).unionByName(ST.read_sink(spark, sink, "token string").select("token", F.lit("new").alias("origin")))


@query
def run_files_variant(spark, sf_dir):
    """A9 + A10 + J2: run files of unknown shape. Some hold a field nobody reads, some
    an accuracy that became a text, some the optional f1 score; one is broken."""
    path = scratch_path(spark, "variant-runs")
    runs = S.runs(spark, sf_dir)
    plain = runs.select("epoch", F.to_json(F.struct(
        "embedder_name", "accuracy", F.when(F.col("epoch") == 5, F.array(F.col("accuracy"), F.lit(0.5))).alias("f1_score"),
        F.when(F.col("split") == "test", F.struct(F.col("epoch").alias("seen"))).alias("notes"))).alias("value"))
    as_text = F.regexp_replace("value", '"accuracy":([0-9.E-]+)', '"accuracy":"$1"')
    lines = plain.select(F.when(F.col("epoch") == 2, as_text).otherwise(F.col("value")).alias("value"))
    lines.repartition(4, "value").write.text(f"{path}/good")
    spark.range(1).select(F.lit('{"embedder_name": "W2V').alias("value")).coalesce(1).write.text(f"{path}/bad")
    files = spark.read.option("recursiveFileLookup", True).format("binaryFile").load([f"{path}/good", f"{path}/bad"]).where("length > 0")
    records, bad = R.read_run_variants(spark, sorted(r["path"] for r in files.select("path").collect()))
    records = materialize(records, "variant-records")
    fields = R.field_report(records, {"embedder_name": "text", "accuracy": "number", "f1_score": "list"}).select(
        F.concat(F.lit("field:"), "field").alias("what"), F.concat_ws(":", "kind", F.coalesce("expected", F.lit("unknown"))).alias("kind"), "n",
        F.lit(None).cast("double").alias("value"))
    typed = records.select(R.variant_field("embedder_name", "string").alias("what"), R.variant_field("accuracy", "double").alias("accuracy"),
                           R.variant_field("f1_score", "array<double>").alias("f1"))
    means = typed.groupBy("what").agg(F.lit("mean").alias("kind"), F.count("f1").alias("n"), r6(F.avg("accuracy")).alias("value"))
    return fields.unionByName(means).unionByName(bad.select(F.lit("quarantine").alias("what"), F.lit("broken").alias("kind"), F.lit(1).cast("long").alias("n"),
                                                            F.lit(None).cast("double").alias("value")))


# --------------------------------------------------------------------------
# Jobs with their file ends: written, read back
#: Bytes of text in a file that is made: a multi-line CSV is not split, so one task reads it.
CSV_FILE_BYTES = 64 << 20


def _text_bytes(docs):
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _in_files(docs, least):
    """``docs`` in id order, dealt over ``least`` files, or more by the bytes of their texts."""
    return docs.repartitionByRange(max(least, -(-_text_bytes(docs) // CSV_FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id")


def _article_csv(spark, sf_dir, name="articles-csv"):
    """Documents as a CSV (type: language, text) in id order."""
    path = scratch_path(spark, name)
    docs = S.table(spark, sf_dir, "documents").select(F.col("lang").alias("type"), "text", "doc_id")
    _in_files(docs, 3).select("type", "text").write.option("header", True).option("escape", '"').csv(path)
    return path


def _embedded_csvs(spark, sf_dir):
    """Train and test files ``label, f0 .. f63`` of the embeddings, named as the jobs expect."""
    base = scratch_path(spark, "embedded-csv")
    f = S.features(spark, sf_dir)
    for side in ("train", "test"):
        rows = f.where(F.col("split") == side).repartitionByRange(2, "vec_id").sortWithinPartitions("vec_id").select("label", "features")
        SK.write_csv(rows, f"{base}/{side}/hash64_fixture.csv", widths={"features": FEATURE_DIM})
    return f"{base}/train/hash64_fixture.csv", f"{base}/test/hash64_fixture.csv"


def _vector_file(spark, sf_dir, extra=()):
    """The benchmark's word vectors as a text file in order of token."""
    path = scratch_path(spark, "vector-file")
    vocab = W.corpus_vocabulary(S.text_table(spark, sf_dir, "benchmark").select(T.flat_tokens("text").alias("tokens")))
    vecs = V.hash_word_vectors(vocab, WV_DIM).df
    lines = vecs.select(F.concat_ws(" ", "token", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"), "token")
    for line in extra:
        lines = lines.unionByName(spark.range(1).select(F.lit(line).alias("value"), F.lit("").alias("token")))
    lines.repartitionByRange(3, "token").sortWithinPartitions("token").select("value").write.text(path)
    return path


@query
def pretrained_from_file(spark, sf_dir):
    """A7 + P3 + E6: a word-vector file with a count line and a broken line, read by
    the encoder loaded by its name; benchmark items encoded."""
    path = _vector_file(spark, sf_dir, ("4000 8", "broken 0.5 0.25", "wrong 1 2 3 4 5 6 7 x"))
    enc = J.load_pretrained("MeanWordVectorEncoder", spark=spark, path=path, dim=WV_DIM)
    items = S.text_table(spark, sf_dir, "benchmark").select("item_id", "text")
    return enc.transform(items, ["item_id"]).select("item_id", "n_tokens", *expand("features", WV_DIM))


@query
def first_vectors_of_file(spark, sf_dir):
    """A7 + A8: the first 200 vectors in file order, and the boundary tokens'."""
    read = FS.read_word_vectors(spark, _vector_file(spark, sf_dir), WV_DIM)
    return W.first_k_vectors(read, "line_no", 200).select("token", "row_no", *expand("vec", WV_DIM, "v"))


@query
def vocabulary_encoder_job(spark, sf_dir):
    """P7 + B6 + M5: a CSV, its train split's vocabulary saved, the encoder loaded
    and applied to every document."""
    saved = scratch_path(spark, "vocabulary-encoder")
    J.train_vocab_embedder(spark, _article_csv(spark, sf_dir), saved, WV_DIM)
    enc = EN.MeanWordVectorEncoder.load(spark, saved)
    return enc.transform(_documents(spark, sf_dir), ["doc_id"]).select("doc_id", "n_tokens", *expand("features", WV_DIM))


def _documents(spark, sf_dir):
    return S.text_table(spark, sf_dir, "documents").select("doc_id", "text")


@query
def word_vector_job(spark, sf_dir):
    """P8 + B6: word vectors trained on a CSV's train split, saved and loaded: one
    vector for each of its words."""
    saved = scratch_path(spark, "word2vec-encoder")
    J.train_embedder(spark, _article_csv(spark, sf_dir), saved, vector_size=16)
    v = EN.Word2VecEncoder.load(spark, saved).word_vectors().df
    return v.select("token", F.size("vec").cast("bigint").alias("width"), (FV.array_sum(F.transform("vec", F.abs)) > 0).alias("learnt"))


@query
def subset_job(spark, sf_dir):
    """Exactly 20 rows of two classes from a CSV to a CSV, read back."""
    csv, out = scratch_path(spark, "typed-csv"), scratch_path(spark, "subset-csv")
    arts = S.articles(spark, sf_dir).select("doc_id", "type", F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text").alias("text"))
    _in_files(arts, 2).select("type", "text").write.option("header", True).option("escape", '"').csv(csv)
    J.get_and_store_subset(spark, csv, out, n=20)
    back = FS.read_csv(spark, out)
    return back.select("type", F.substring_index("text", ":", 1).cast("bigint").alias("doc_id"), F.md5(F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " "))).alias("text_md5"))


@query
def embed_files_job(spark, sf_dir):
    """P10: a CSV split, embedded and written as two CSV files, read back as a pair."""
    base = scratch_path(spark, "embedded-pair")
    csv = _article_csv(spark, sf_dir)
    enc = EN.MeanWordVectorEncoder(WV_DIM).fit(FS.read_csv(spark, csv))
    J.embed_raw_data(spark, csv, enc, f"{base}/train.csv", f"{base}/test.csv")
    pair = FS.train_test_pair(spark, f"{base}/train.csv", f"{base}/test.csv", WV_DIM)
    sums = [r6(F.sum(F.col("features")[i]), 4).alias(f"f{i}") for i in range(WV_DIM)]
    return pair.groupBy("split", F.col("label").cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("n"), *sums)


@query
def network_files_job(spark, sf_dir):
    """A14 + P11 + B4 + B7 + A9: train and test files, two epochs of local steps, the
    run record and the weights read back."""
    import os
    train, test = _embedded_csvs(spark, sf_dir)
    out = scratch_path(spark, "network-runs")
    J.train_nn_model(spark, train, FEATURE_DIM, "SoftmaxRegression", out, test_ds=test, epochs=2)
    good, _ = R.read_run_files(spark, out)
    weights = spark.read.parquet(os.path.join(out, "fixture_hash64_softmaxregression", "weights"))
    size = weights.where(F.col("name").startswith("param")).agg(F.sum(F.size("values"))).first()[0]
    total = lambda c: F.aggregate(F.flatten(F.transform(F.map_values(F.element_at(f"experiment_result.{c}", -1)), F.map_values)),
                                  F.lit(0).cast("bigint"), lambda a, x: a + x)
    return good.select("original_dataset_name", "embedder_name", F.col("experiment_result.epochs").cast("bigint").alias("epochs"),
                       F.col("experiment_result.training_batch_size").cast("bigint").alias("batch_size"),
                       F.size("experiment_result.testing_losses").cast("bigint").alias("n_losses"),
                       total("training_classification_results").alias("n_train"), total("testing_classification_results").alias("n_test"), F.lit(size).cast("bigint").alias("n_weights"))


@query
def boosting_files_job(spark, sf_dir):
    """A14 + P13 + B4 + P15: train and test files, one exact stump, its record read
    back from a folder of boosting runs."""
    train, test = _embedded_csvs(spark, sf_dir)
    out = scratch_path(spark, "boosting-runs")
    J.adaboost(spark, train, FEATURE_DIM, f"{out}/ADABOOST", test_ds=test, n_rounds=1)
    t = J.visualize_adaboost_tables(spark, out)
    acc = t["accuracy_by_embedding"].first()["mean_accuracy"]
    return t["confusion"].select("true_label", "pred_label", "n", r6(F.lit(acc)).alias("accuracy"))


@query
def image_files_job(spark, sf_dir):
    """A14 + P12 + H3 + H4 + B5: train and test files turned into the pixel table."""
    train, test = _embedded_csvs(spark, sf_dir)
    path = J.convert_into_image_dataset(spark, train, FEATURE_DIM, scratch_path(spark, "image-set"), test_ds=test, resize=False)
    t = spark.read.parquet(path)
    return t.groupBy("split", F.col("label").cast("bigint").alias("label")).agg(
        F.count("image").alias("n"), F.max("image.height").cast("bigint").alias("height"), r6(F.avg(FV.array_sum("image.pixels")), 3).alias("mean_total"))


@query
def routed_runs_job(spark, sf_dir):
    """A11 + P14 + P15: a folder of network and boosting runs, searched and routed by path."""
    path = scratch_path(spark, "routed-runs")
    runs = S.runs(spark, sf_dir).where(F.col("accuracy").isNotNull())
    cm = F.array(F.create_map(F.lit("0"), F.create_map(F.lit("0"), F.lit(1).cast("bigint"))))
    series = lambda c: F.array(F.lit(0.0), F.col(c))
    result = F.struct(F.lit(0.001).alias("learning_rate"), F.lit(2).alias("epochs"), series("accuracy").alias("training_accuracies"),
                      series("loss").alias("training_losses"), series("accuracy").alias("testing_accuracies"), series("loss").alias("testing_losses"),
                      F.concat(cm, cm).alias("training_classification_results"), F.concat(cm, cm).alias("testing_classification_results"))
    SK.write_json_records(runs.where(F.col("split") == "train").select(F.lit("fixture").alias("original_dataset_name"), "embedder_name", result.alias("experiment_result")).repartition(3),
                          f"{path}/networks")
    SK.write_json_records(runs.where(F.col("split") == "test").select(F.lit("fixture").alias("original_ds_name"), "embedder_name", "accuracy", cm[0].alias("classification_makeup")).repartition(2),
                          f"{path}/ADABOOST/deep")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).where("length > 0").select("path")
    networks, boosts = R.route_boosting(files)
    nets = J.visualize_all_tables(spark, sorted(r["path"] for r in networks.collect()))["accuracy_by_embedding"]
    ada = J.visualize_adaboost_tables(spark, sorted(r["path"] for r in boosts.collect()))["accuracy_by_embedding"]
    cols = ["embedding_type", "class_type", r6(F.col("mean_accuracy")).alias("mean_accuracy"), "n_runs"]
    return nets.select(F.lit("network").alias("kind"), *cols).unionByName(
        ada.withColumn("class_type", F.lit(None).cast("string")).select(F.lit("boosting").alias("kind"), *cols))


@query
def csv_projection(spark, sf_dir):
    """A2 + A5: one column of a CSV, renamed by position."""
    t = FS.rename_positional(FS.read_csv(spark, _article_csv(spark, sf_dir), columns=["type"]), ["language"])
    return t.groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query
def row_lookup(spark, sf_dir):
    """C2 + C16: rows at three places of a scan, everything but the label."""
    f = D.numbered_batches(S.features(spark, sf_dir).select("vec_id", "label", "features"), "vec_id", 1).withColumn("file_row", F.col("row_no") - 1)
    x, _ = J.samples_and_labels(f)
    some = J.row_at(x, 0).unionByName(J.row_at(x, 7)).unionByName(J.row_at(x, 499))
    return some.select("file_row", "vec_id", F.size("features").cast("bigint").alias("width"), r6(FV.array_sum("features")).alias("total"))


@query
def score_network(spark, sf_dir):
    """H7 + H1 + H2: the table scored by a network of given weights."""
    import numpy as np
    model = NN.SimpleMLP(FEATURE_DIM, N_CLASSES)
    i, j = np.indices((FEATURE_DIM, model.hidden))
    a, k = np.indices((model.hidden, N_CLASSES))
    model.params = [((i * 7 + j * 13) % 11 - 5) / 50, np.zeros(model.hidden), ((a * 3 + k * 17) % 13 - 6) / 60, np.arange(N_CLASSES) / 100]
    z = NN.score(model, S.features(spark, sf_dir), ["vec_id"])
    return z.select("vec_id", *expand("logits", N_CLASSES, "z"), FV.argmax("logits").cast("bigint").alias("pred"))


@query
def embedded_given_map(spark, sf_dir):
    """M4 + C13 + U1: an encoder by its registered name, with a caller's class map."""
    arts = S.articles(spark, sf_dir)
    enc = EN.Encoder.by_name("MeanWordVectorEncoder", dim=WV_DIM).fit(arts)
    out = EN.embedded_table(arts, enc, split_col=None, mapping=L.literal_map(spark, {"human": 5, "gpt": 9}))
    return out.select("doc_id", F.col("label").cast("bigint").alias("label"), *expand("features", WV_DIM))


@query
def encoder_sentences(spark, sf_dir):
    """Sentences that an encoder took, counted while it ran."""
    docs = S.text_table(spark, sf_dir, "conversations").select(*CONV_IDS, "text")
    _, stats = J.encoder_throughput(docs, EN.SentenceEncoder(dim=4), CONV_IDS)
    return spark.createDataFrame([(stats["sentences"], stats["per_second"] > 0)], "sentences bigint, timed boolean")


@query
def result_views(spark, sf_dir):
    """U3 + E16: registered result views over stored runs."""
    path = scratch_path(spark, "view-runs")
    runs = S.runs(spark, sf_dir).where(F.col("accuracy").isNotNull())
    cm = F.array(F.create_map(F.lit("0"), F.create_map(F.lit("0"), F.lit(1).cast("bigint"))))
    one = lambda c: F.array(F.col(c))
    result = F.struct(F.lit(1).alias("epochs"), one("accuracy").alias("training_accuracies"), one("loss").alias("training_losses"),
                      one("accuracy").alias("testing_accuracies"), one("loss").alias("testing_losses"),
                      cm.alias("training_classification_results"), cm.alias("testing_classification_results"))
    SK.write_json_records(runs.select(F.lit("fixture").alias("original_dataset_name"), "embedder_name", result.alias("experiment_result")), path)
    t = J.visualize_all_tables(spark, path)
    out = J.VIEWS["accuracy"](t).unionByName(J.VIEWS["loss"](t))
    return out.groupBy("series", "epoch").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"))
