"""Sources and sinks: tolerant CSV, embedded CSV round trip, word-vector
text, run-file JSON with quarantine and routing, image folders, batch
outputs with resume."""

import json
import os
import struct
import zlib

import pytest

from pyspark.sql import functions as F

from articlelab.operators import encode as EN
from articlelab.plans import jobs as J
from articlelab.operators import images as IM
from articlelab.operators import metrics as M
from articlelab.operators import runs as R
from articlelab.operators import sampling as D
from articlelab.operators import vocab as W
from articlelab.sinks import writers as SK
from articlelab.sources import files as FS
from articlelab.sources import tables as S
from places import SF001


def test_tolerant_csv(spark, tmp_dir):
    p = os.path.join(tmp_dir, "raw.csv")
    with open(p, "w") as f:
        f.write('type,text\n')
        f.write('human,"line one\nline two with ""quotes"""\n')
        f.write('gpt,Grow Plants from Seeds\n')
        f.write('gpt,too,many,cells\n')
        f.write('human\n')
        f.write('llama,plain\n')
    rows, flagged = FS.read_csv_tolerant(spark, p)
    got = {(r.type, r.text, r.repaired) for r in rows.collect()}
    assert ("human", 'line one\nline two with "quotes"', False) in got
    assert ("gpt", None, False) in got                 # sentinel -> null
    assert ("gpt", "too", True) in got                 # long row cut and flagged
    assert ("human", None, True) in got                # short row null-filled and flagged
    assert ("llama", "plain", False) in got and len(got) == 5
    assert flagged.count() == 2
    plain = FS.read_csv(spark, p, columns=["text"])
    assert plain.columns == ["text"]
    assert FS.rename_positional(rows, ["a", "b"]).columns == ["a", "b"]


def test_embedded_csv_roundtrip(spark, tmp_dir):
    f = S.features(spark, SF001).select("label", F.slice("features", 1, 8).alias("features"))
    out = os.path.join(tmp_dir, "w2v_sample.csv")
    SK.write_csv(f, out)
    back = FS.read_embedded_csv(spark, out, 8)
    key = lambda r: (r.label, tuple(round(x, 9) for x in r.features))
    assert sorted(map(key, back.collect())) == sorted(map(key, f.collect()))
    pair = FS.train_test_pair(spark, out, None, 8)
    counts = {r.split: r["count"] for r in pair.groupBy("split").count().collect()}
    assert counts["train"] == int(f.count() * 0.8)
    assert EN.collapse_features(EN.expand_features(f, 8)).columns == ["label", "features"]


def test_word_vector_text_file(spark, tmp_dir):
    p = os.path.join(tmp_dir, "vectors.vec")
    with open(p, "w") as f:
        f.write("4 3\n")                       # count/dim header: wrong width, dropped (Q12)
        f.write("the 0.1 0.2 0.3\n")
        f.write("cat 1 2 3\n")
        f.write("broken 1 x 3\n")
        f.write("</p> 0 0 1\n")
        f.write("dog 4 5 6\n")
    wv = FS.read_word_vectors(spark, p, 3)
    assert sorted(r.token for r in wv.collect()) == ["</p>", "cat", "dog", "the"]
    first = W.first_k_vectors(wv, "line_no", 1)
    assert sorted(r.token for r in first.collect()) == ["</p>", "the"]


def test_run_files_quarantine_and_routing(spark, tmp_dir):
    s = M.score_rows(S.scores(spark, SF001))
    rec = R.network_run_records(M.epoch_metrics(s, ["split", "epoch"]), M.confusion(s, ["split", "epoch"]), [], {})
    rec = rec.select(F.lit("wiki").alias("original_dataset_name"), F.lit("w2v_human").alias("embedder_name"),
                     "experiment_result")
    root = os.path.join(tmp_dir, "results")
    os.makedirs(os.path.join(root, "nn"))
    os.makedirs(os.path.join(root, "ADABOOST"))
    doc = json.loads(R.record_to_json(rec, rec.columns).first().json)
    with open(os.path.join(root, "nn", "wiki_w2v_simplemlp.json"), "w") as f:
        json.dump(doc, f, indent=2)
    with open(os.path.join(root, "ADABOOST", "wiki_w2v_adaboost.json"), "w") as f:
        json.dump({"original_ds_name": "wiki", "embedder_name": "w2v_human", "accuracy": 0.5,
                   "classification_makeup": {"0": {"0": 3, "1": 1}}}, f)
    with open(os.path.join(root, "nn", "broken.json"), "w") as f:
        f.write('{"embedder_name": "x", ')
    good, bad = R.read_run_files(spark, root)
    nn, boost = R.route_boosting(good)
    assert bad.count() == 1 and "broken" in bad.first().path
    assert boost.count() == 1 and nn.count() == 1
    er = nn.select("experiment_result.*")
    conf = R.confusion_from_record(er, [], "testing_classification_results")
    want = M.confusion(s, ["split", "epoch"]).where(F.col("split") == "test").drop("split")
    assert {tuple(r) for r in conf.collect()} == {tuple(r) for r in want.collect()}
    checked = R.with_missing(er, list(R.REQUIRED_NETWORK_METRICS))
    assert checked.first().missing == []
    b = spark.read.schema(R.BOOST_RUN_DDL).json(os.path.join(root, "ADABOOST"))
    bc = R.confusion_from_record(b.select(F.array("classification_makeup").alias("cm")), [], "cm",
                                 outer_is="true")
    assert sorted((r.true_label, r.pred_label, r.n) for r in bc.collect()) == [(0, 0, 3), (0, 1, 1)]


def _png(path, pixels, w, h, colour=False):
    n = w * (3 if colour else 1)
    raw = b"".join(b"\x00" + bytes(pixels[r * n:(r + 1) * n]) for r in range(h))

    def chunk(kind, data):
        c = kind + data
        return struct.pack(">I", len(data)) + c + struct.pack(">I", zlib.crc32(c) & 0xFFFFFFFF)
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if colour else 0, 0, 0, 0))
                + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_folder(spark, tmp_dir):
    root = os.path.join(tmp_dir, "imgs_train")
    for cls in ("b", "a"):
        os.makedirs(os.path.join(root, cls))
        for i in range(2):
            _png(os.path.join(root, cls, f"{i}.png"), [0, 255, 51, 102], 2, 2)
    df, bad = IM.read_image_folder(spark, root)
    assert bad.count() == 0
    got = sorted((r.class_name, r.label) for r in df.collect())
    assert got == [("a", 0), ("a", 0), ("b", 1), ("b", 1)]
    assert df.first().pixels == pytest.approx([-1.0, 1.0, -0.6, -0.2])
    with pytest.raises(ValueError):
        IM.folder_split(df, "origin")
    os.makedirs(os.path.join(tmp_dir, "my_test", "a"))
    _png(os.path.join(tmp_dir, "my_test", "a", "0.png"), [0, 255, 51, 102], 2, 2)
    both = IM.folder_split(IM.read_image_folder(spark, tmp_dir)[0], "origin")
    assert {(r["split"], r["count"]) for r in both.groupBy("split").count().collect()} == {("train", 4), ("test", 1)}


def test_colour_images_and_broken_files(spark, tmp_dir):
    for cls in ("a", "b"):
        os.makedirs(os.path.join(tmp_dir, cls))
    _png(os.path.join(tmp_dir, "a", "red.png"), [255, 0, 0, 0, 0, 255], 2, 1, colour=True)
    with open(os.path.join(tmp_dir, "b", "broken.png"), "wb") as f:
        f.write(b"not an image")
    good, bad = IM.read_image_folder(spark, tmp_dir)
    row = good.first()
    assert (good.count(), row.class_name, row.label) == (1, "a", 0)
    assert row.pixels == pytest.approx([(76 / 255 - 0.5) / 0.5, (29 / 255 - 0.5) / 0.5])
    assert [r.class_name for r in bad.collect()] == ["b"]


def test_run_files_with_many_records(spark, tmp_dir):
    rec = {"original_ds_name": "d", "embedder_name": "w2v_x", "accuracy": 0.5, "classification_makeup": {"0": {"0": 1}}}
    with open(os.path.join(tmp_dir, "a.json"), "w") as f:
        f.write(json.dumps(rec) + "\n" + json.dumps({**rec, "accuracy": None}) + "\n")
    with open(os.path.join(tmp_dir, "b.json"), "w") as f:
        f.write('{"accuracy": ')
    t = J.visualize_adaboost_tables(spark, tmp_dir)
    assert t["accuracy_by_embedding"].first().n_runs == 1
    assert sorted(r._corrupt_record for r in t["quarantine"].collect()) == ["accuracy", '{"accuracy": ']


def test_file_order_over_several_files(spark, tmp_dir):
    for name, lo, hi in (("b", 10, 15), ("a", 0, 10), ("c", 15, 16)):
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w") as f:
            f.write("type,text\n" + "".join(f'x,"row {i}\nof {name}"\n' for i in range(lo, hi)))
    rows = FS.read_csv(spark, tmp_dir, file_order="n").collect()
    assert sorted((r.n, int(r.text.split()[1])) for r in rows) == [(i, i) for i in range(16)]


def test_resumed_batches_keep_copies_apart(spark, tmp_dir):
    csv, out = os.path.join(tmp_dir, "in.csv"), os.path.join(tmp_dir, "out")
    with open(csv, "w") as f:
        f.write("type,text\na,same words here\nb,other words\na,same words here\n")
    for encoder in (EN.MeanWordVectorEncoder(4).fit(FS.read_csv(spark, csv)), EN.SentenceEncoder(dim=4)):
        path = f"{out}-{type(encoder).__name__}"
        J.embed_csv_batches(spark, csv, path, encoder, batch_size=2, stop_before=1)
        first = {r.file_row: r.features for r in spark.read.parquet(path).collect()}
        back = J.embed_csv_batches(spark, csv, path, encoder, batch_size=2).collect()
        assert sorted((r.file_row, r.batch_no, r.label) for r in back) == [(0, 0, 0), (1, 0, 1), (2, 1, 0)]
        assert set(first) == {0, 1} and all(first[r.file_row] == r.features for r in back if r.file_row < 2)


def test_image_table_and_batches(spark, tmp_dir):
    f = S.features(spark, SF001)
    IM.write_image_table(IM.image_table(f, 64).drop("vec_id"), os.path.join(tmp_dir, "images"))
    back = spark.read.parquet(os.path.join(tmp_dir, "images"))
    assert back.count() == f.count() and {"split", "label", "image"} <= set(back.columns)
    d = D.numbered_batches(S.table(spark, SF001, "documents").select("doc_id"), "doc_id", 64)
    out = os.path.join(tmp_dir, "batches")
    SK.write_batches(d.where(F.col("batch_no") < 2), out)
    pending = D.pending_batches(d, SK.finished_batches(spark, out))
    SK.write_batches(pending, out)
    assert spark.read.parquet(out).count() == d.count()
    assert SK.finished_batches(spark, os.path.join(tmp_dir, "none")).count() == 0
