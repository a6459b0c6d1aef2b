"""The corpus pipeline: every stage, and all of them, on awkward documents."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from articlelab.llm import decontamination as D
from articlelab.llm import token_files as T

SF = "/root/testdata/sf0.001"
STAGES = dict(P.STAGES)


def test_stages_are_the_five_in_order():
    assert [n for n, _ in P.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "mixing", "token files"]


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_empty_and_clashing_columns(spark, empty, clashing, name):
    stage, last = STAGES[name], name == "token files"
    assert stage(spark, empty, SF).count() == 0
    out = stage(spark, clashing, SF)
    rows = out.collect()
    if not last:
        assert out.columns == clashing.columns and {r["doc_id"] for r in rows} <= {1, 2, 3}
        assert all(r["size"] == "clash" for r in rows)


@pytest.mark.parametrize("name", [n for n in STAGES if n != "token files"])
def test_stage_keeps_columns_and_rows_of_its_input(spark, sf001, name):
    docs = sf001[0]
    out = STAGES[name](spark, docs, SF)
    assert out.columns == docs.columns
    have, got = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
    most = 3 if name == "mixing" else 1
    assert set(got) <= set(have) and all(n <= most * have[r] for r, n in got.items())


def test_near_duplicates_leave_one_of_each(spark, sf001):
    got = [r["doc_id"] for r in STAGES["MinHash near-dedup"](spark, sf001[0], SF).collect()]
    assert got.count(10_005) == 1 and 10_006 not in got          # the same long text
    assert got.count(10_004) == 1                                 # the same row twice
    assert 10_001 in got and 10_002 in got and None in got        # wordless texts and null ids stay


def test_decontamination_by_brute_force(spark, sf001, rows):
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = set()
    for t in bench:
        w = D.words_of((t or "").encode())
        size = min(13, len(w))
        windows |= {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if size else set()
    stays = Counter()
    for i, t, _ in rows:
        w = D.words_of((t or "").encode())
        hit = {j for size in {len(x) for x in windows} for k in range(len(w) - size + 1) if tuple(w[k:k + size]) in windows for j in range(k, k + size)}
        if not (hit and 20 * len(hit) >= len(w)):
            stays[i, t] += 1
    got = Counter((r["doc_id"], r["text"]) for r in STAGES["benchmark decontamination"](spark, sf001[0], SF).collect())
    assert got == stays and sum(stays.values()) < len(rows)


def test_token_files_by_brute_force(spark, sf001, rows):
    library = T.CachedTokenizer(T.default_tokenizer()).tokenizer
    out = STAGES["token files"](spark, sf001[0], SF).collect()
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == want


def test_run_is_all_stages_one_after_another(spark):
    out = P.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    step = docs
    for _, stage in P.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, SF).collect(), docs.schema)
    want = Counter(r["doc_id"] for r in step.collect())
    assert Counter(r["doc_id"] for r in out.collect()) == want and 0 < sum(want.values())
    plan = out.select(F.col("doc_id"))._jdf.queryExecution().toString()
    assert not re.search("CartesianProduct", plan)
