"""Incremental embedding: a restart does no work twice; new files are
picked up; each micro-batch folder is rewritten on replay."""

import os

from pyspark.sql import functions as F

from articlelab.functions import text as T
from articlelab.operators import vectors as V
from articlelab.operators.rows import explode_rows
from articlelab.streaming import incremental as ST
from articlelab.sources import tables as S
from places import SF001


def _embed(batch):
    toks = batch.select("doc_id", T.flat_tokens("text").alias("tokens"))
    wv = V.hash_word_vectors(explode_rows(toks, [], "tokens"), 8)
    return V.article_mean_vectors(toks, wv, ["doc_id"])


def test_restart_and_new_files(spark, tmp_dir):
    docs = S.table(spark, SF001, "documents").select("doc_id", "text")
    src = os.path.join(tmp_dir, "incoming")
    docs.where(F.col("doc_id") < 100).coalesce(1).write.parquet(os.path.join(src, "part1"))
    sink, ckpt = os.path.join(tmp_dir, "sink"), os.path.join(tmp_dir, "ckpt")
    schema = docs.schema
    # one file folder per arrival; the stream reads the folder tree
    ran1 = ST.embed_stream(spark, src + "/*", schema, sink, ckpt, _embed)
    n1 = ST.read_sink(spark, sink).count()
    assert ran1 >= 1 and n1 == 100
    ran2 = ST.embed_stream(spark, src + "/*", schema, sink, ckpt, _embed)
    assert ran2 == 0 and ST.read_sink(spark, sink).count() == n1
    docs.where(F.col("doc_id") >= 100).coalesce(1).write.parquet(os.path.join(src, "part2"))
    ran3 = ST.embed_stream(spark, src + "/*", schema, sink, ckpt, _embed)
    assert ran3 >= 1
    assert ST.read_sink(spark, sink).count() == docs.count()


def test_a_micro_batch_takes_many_small_files(spark, tmp_dir):
    docs = S.table(spark, SF001, "documents").select("doc_id", "text")
    src = os.path.join(tmp_dir, "many")
    docs.repartition(6).write.parquet(src)
    sink = os.path.join(tmp_dir, "sink-many")
    assert ST.embed_stream(spark, src, docs.schema, sink, os.path.join(tmp_dir, "ckpt-many"), lambda b: b, max_bytes=1 << 30) == 1
    assert ST.embed_stream(spark, src, docs.schema, sink + "1", os.path.join(tmp_dir, "ckpt-one"), lambda b: b, max_bytes=1) == 6
    assert sorted(r["doc_id"] for r in ST.read_sink(spark, sink).collect()) == sorted(r["doc_id"] for r in ST.read_sink(spark, sink + "1").collect())


def test_the_query_embeds_its_files_in_one_micro_batch(spark, monkeypatch, tmp_dir):
    from articlelab.plans import queries as Q
    S.table(spark, SF001, "documents").repartition(5).write.parquet(os.path.join(tmp_dir, "sf", "documents.parquet"))
    ran, plain = [], ST.embed_stream
    monkeypatch.setattr(Q.ST, "embed_stream", lambda *a, **k: ran.append(plain(*a, **k)))
    out = Q.QUERIES["incremental_embed"](spark, os.path.join(tmp_dir, "sf"))
    assert ran == [1] and out.count() == S.table(spark, SF001, "documents").count()
