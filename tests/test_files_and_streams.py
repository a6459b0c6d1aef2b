"""CSV offset index, image trees, run records of unknown shape, vocabulary stream."""

import os

import pytest
from pyspark.sql import functions as F

from articlelab.operators import images as IM
from articlelab.operators import runs as R
from articlelab.sinks import image_tree as IT
from articlelab.sources import csv_index as CI
from articlelab.sources import files as FS
from articlelab.streaming import incremental as ST

ARTICLES = [("human", 'He said "no", and\nleft.'), ("gpt", "plain"), ("human", '""'), ("gpt", "a,b\n\n,c"), ("human", "Grow Plants from Seeds"),
            ("gpt", None), ("human", "é" * 50), ("gpt", 'ends with a quote"'), ("human", "x" * 300), ("gpt", "last one")] * 7


def _csv(spark, folder, rows=ARTICLES, files=2):
    spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, type string, text string").repartitionByRange(files, "i").sortWithinPartitions("i").select(
        "type", "text").write.option("header", True).option("escape", '"').csv(folder)
    return folder


@pytest.mark.parametrize("range_bytes", [7, 40, 333, 1 << 20])
def test_index_reads_what_the_reader_reads(spark, tmp_dir, range_bytes):
    path = _csv(spark, os.path.join(tmp_dir, "csv"))
    index = CI.build_index(spark, path, range_bytes).cache()
    assert index.agg(F.sum("n_rows")).first()[0] == len(ARTICLES)
    want, _ = FS.read_csv_tolerant(spark, path, file_order="file_row")
    key = lambda d: sorted((r["file_row"], r["type"], r["text"], r["repaired"]) for r in d.collect())
    assert key(CI.read_ranges(index)) == key(want)
    some = index.where("first_row >= 20 and n_rows > 0")
    first = some.agg(F.min("first_row")).first()[0]
    if first is not None:
        assert sorted(r["file_row"] for r in CI.read_ranges(some).collect()) == list(range(first, len(ARTICLES)))


def test_index_of_awkward_files(spark, tmp_dir):
    files = {"a.csv": "type,text\nhuman,one\n\r\n\ngpt,two", "b.csv": "type,text\n", "c.csv": "type,text\r\nhuman,\"a\r\nb\"\r\ngpt,x,too many\r\nshort\r\n", "d.csv": "",
             "e.csv": "type,text\nhuman,last without end"}
    for name, text in files.items():
        with open(os.path.join(tmp_dir, name), "w", newline="") as f:
            f.write(text)
    for range_bytes in (5, 1 << 20):
        index = CI.build_index(spark, tmp_dir, range_bytes)
        got = [(r["type"], r["text"], r["repaired"]) for r in CI.read_ranges(index).orderBy("file_row").collect()]
        assert got == [("human", "one", False), ("gpt", "two", False), ("human", "a\r\nb", False), ("gpt", "x", True), ("short", None, True),
                       ("human", "last without end", False)]


def test_pending_rows_open_pending_stretches_only(spark, tmp_dir):
    path = _csv(spark, os.path.join(tmp_dir, "csv"), files=1)
    index, fresh = CI.stored_index(spark, path, os.path.join(tmp_dir, "index"), 400)
    again, fresh_again = CI.stored_index(spark, path, os.path.join(tmp_dir, "index"), 400)
    assert fresh and not fresh_again and again.count() == index.count() > 5
    done = spark.createDataFrame([(b,) for b in range(5)], "batch_no bigint")     # rows 0 to 49 of 70
    pending = CI.pending_ranges(index, done, 10)
    held = {r["start"] for r in pending.collect()}
    assert held == {r["start"] for r in index.where("n_rows > 0 and first_row + n_rows > 50").collect()} and 0 not in held
    rows = {r["file_row"] for r in CI.read_ranges(pending).collect()}
    assert set(range(50, 70)) <= rows and min(rows) > 30
    assert CI.pending_ranges(index, done, 10, stop_before=5).count() == 0
    with open(os.path.join(path, "part-new.csv"), "w") as f:
        f.write("type,text\nhuman,more\n")
    grown, fresh = CI.stored_index(spark, path, os.path.join(tmp_dir, "index"), 400)
    assert fresh and grown.agg(F.sum("n_rows")).first()[0] == 71


# --- image trees -----------------------------------------------------------

def _images(spark, rows):
    return spark.createDataFrame(rows, IT.COLUMNS)


def test_image_tree_round_trip(spark, tmp_dir):
    root = os.path.join(tmp_dir, "tree")
    red, blue = bytes([255, 0, 0, 0, 0, 255]), bytes([0, 0, 255, 255, 0, 0])
    rows = [("a", "one", 1, 2, 3, red), ("b/c", "two", 2, 1, 3, blue), ("a", "gray", 2, 2, 1, bytes([0, 255, 51, 102]))]
    IT.write_image_tree(_images(spark, rows).repartition(3), root)
    assert sorted(os.listdir(root)) == ["a", "b%2Fc"] and sorted(os.listdir(os.path.join(root, "a"))) == ["gray.png", "one.png"]
    good, bad = IM.read_image_folder(spark, root)
    got = {r["origin"].rsplit("/", 1)[1]: (r["height"], r["width"], [round((p * 0.5 + 0.5) * 255) for p in r["pixels"]]) for r in good.collect()}
    assert got == {"one.png": (1, 2, [76, 29]), "two.png": (2, 1, [29, 76]), "gray.png": (2, 2, [0, 255, 51, 102])} and bad.count() == 0
    IT.write_image_tree(_images(spark, [("a", "more", 1, 1, 1, b"\x07")]), root, "append")
    assert len(os.listdir(os.path.join(root, "a"))) == 3
    IT.write_image_tree(_images(spark, [("z", "only", 1, 1, 1, b"\x07")]), root)
    assert os.listdir(root) == ["z"]


@pytest.mark.parametrize("rows", [
    [("a", str(i), 1, 1, 1, b"\x01") for i in range(20)] + [("a", None, 1, 1, 1, b"\x01")],
    [("a", str(i), 1, 1, 1, b"\x01") for i in range(20)] + [("a", "bad", 2, 2, 3, b"\x01")],
    [("a", str(i % 19), 1, 1, 1, b"\x01") for i in range(20)]])
def test_failed_image_jobs_leave_nothing(spark, tmp_dir, rows):
    root = os.path.join(tmp_dir, "tree")
    os.makedirs(os.path.join(root, "kept"))
    with open(os.path.join(root, "kept", "old.png"), "wb") as f:
        f.write(b"old")
    with pytest.raises(Exception, match="image"):
        IT.write_image_tree(_images(spark, rows).repartition(4), root, "append")
    assert sorted(d for d in os.listdir(root)) == ["kept"] and os.listdir(os.path.join(root, "kept")) == ["old.png"]


# --- run records of unknown shape ------------------------------------------

def test_run_variants(spark, tmp_dir):
    with open(os.path.join(tmp_dir, "a.json"), "w") as f:
        f.write('{"embedder_name": "w2v_x", "accuracy": 0.5, "extra": [1, 2]}\n{"embedder_name": "w2v_y", "accuracy": "high", "f1_score": [0.25]}\n')
    with open(os.path.join(tmp_dir, "b.json"), "w") as f:
        f.write('{\n "embedder_name": 7, "accuracy": 1,\n "extra": {"deep": null}}')
    for name, text in (("c.json", "[1, 2]"), ("d.json", '{"accuracy": '), ("e.txt", "no json")):
        with open(os.path.join(tmp_dir, name), "w") as f:
            f.write(text)
    records, bad = R.read_run_variants(spark, tmp_dir)
    got = sorted(map(tuple, records.select(R.variant_field("embedder_name", "string"), R.variant_field("accuracy", "double"),
                                           R.variant_field("f1_score", "array<double>")).collect()), key=str)
    assert got == [("7", 1.0, None), ("w2v_x", 0.5, None), ("w2v_y", None, [0.25])]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in bad.collect()) == ["c.json", "d.json"]
    report = {(r["field"], r["kind"]): (r["expected"], r["n"]) for r in R.field_report(records, {"embedder_name": "text", "accuracy": "number"}).collect()}
    assert report == {("embedder_name", "text"): ("text", 2), ("embedder_name", "number"): ("text", 1), ("accuracy", "number"): ("number", 2),
                      ("accuracy", "text"): ("number", 1), ("extra", "list"): (None, 1), ("extra", "object"): (None, 1), ("f1_score", "list"): (None, 1)}


# --- vocabulary of a stream ------------------------------------------------

def test_stream_emits_every_token_once(spark, tmp_dir):
    source, sink, state = (os.path.join(tmp_dir, n) for n in ("in", "out", "state"))
    texts = [["a b a", "c"], ["b d", ""], ["a e", "d d f"]]

    def tokens(rows):
        return rows.select(F.explode(F.split("text", " ")).alias("token")).where("token <> ''")

    def arrive(k):
        spark.createDataFrame([(t,) for t in texts[k]], "text string").coalesce(1).write.mode("append").parquet(source)

    arrive(0)
    arrive(1)
    assert ST.vocabulary_stream(spark, source, "text string", sink, state, tokens) >= 2
    first = sorted(r["token"] for r in ST.read_sink(spark, sink).collect())
    assert first == ["a", "b", "c", "d"]
    arrive(2)
    ST.vocabulary_stream(spark, source, "text string", sink, state, tokens, keep=lambda b: b.where("token <> 'f'"))
    assert sorted(r["token"] for r in ST.read_sink(spark, sink).collect()) == ["a", "b", "c", "d", "e"]
