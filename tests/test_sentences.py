"""Learnt sentence boundaries and ordered tokeniser rules."""

import pytest
from pyspark.sql import functions as F

from articlelab.functions import text as T
from articlelab.functions import treebank as TB
from articlelab.operators import sentences as SE

#: Words of a small corpus: what follows a stop, and what it belongs to.
CORPUS = ["Dr. Smith met the man at noon. He said that Dr. Jones came. They had met Dr. Brown before. The man left with Dr. Smith again.",
          "We met at 3 p.m. and left at 5 p.m. today. When he came at 4 p.m. the shop was shut. She said he left at 9 p.m. with Dr. Jones.",
          "The shop opens at 8 a.m. each day. It was not open when he came. He had seen it at 7 a.m. and he went home. So he left.",
          "Is it open? He asked! The man said no. It is shut, he said. They left. We left too. She came home. The day was long and he was tired."] * 12


def _sentences(spark, texts, model):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r["id"]: r["sentences"] for r in SE.split_learnt(df, ["id"], model).collect()}
    return [got[i] for i in range(len(texts))]


@pytest.fixture(scope="module")
def model(spark):
    return SE.fit_sentences(spark.createDataFrame([(t,) for t in CORPUS], "text string"))


def test_abbreviations_are_learnt(model):
    learnt = {r["type"] for r in model.abbreviations.collect()}
    assert {"dr", "p.m", "a.m"} <= learnt and not learnt & {"left", "he", "open", "day", "was", "brown", "smith"}


def test_sentences_of_text_with_abbreviations(spark, model):
    texts = ["Dr. Smith came at 3.5 p.m. He left.", "It was 3 p.m. when he left. \"Is it open?\" he asked.  (Yes!) They came...", None, "  ", "no stop at all",
             "One line.\nThe next. J. Smith came at 5. He left."]
    assert _sentences(spark, texts, model) == [
        ["Dr. Smith came at 3.5 p.m.", "He left."],
        ["It was 3 p.m. when he left.", "\"Is it open?\"", "he asked.", "(Yes!)", "They came..."], [], [], ["no stop at all"],
        ["One line.", "The next.", "J. Smith came at 5.", "He left."]]


def test_without_a_corpus_every_stop_ends_a_sentence(spark):
    empty = SE.fit_sentences(spark.createDataFrame([], "text string"))
    assert _sentences(spark, ["Dr. Smith came. He left! So what?", ""], empty) == [["Dr.", "Smith came.", "He left!", "So what?"], []]


def test_sentences_do_not_depend_on_partitions_and_keep_rows(spark, model):
    df = spark.createDataFrame([(1, "a", "One came. Two left."), (1, "b", "One came. Two left."), (None, "a", "So he left. He did.")], "id long, part string, text string")
    for d in (df, df.repartition(5)):
        got = sorted((str(r["id"]), r["part"], r["sentences"]) for r in SE.split_learnt(d, ["id", "part"], model).collect())
        assert got == [("1", "a", ["One came.", "Two left."]), ("1", "b", ["One came.", "Two left."]), ("None", "a", ["So he left.", "He did."])]


TOKENS = [
    ("They don't know; it isn't so.", ["They", "do", "n't", "know", ";", "it", "is", "n't", "so", "."]),
    ("\"It's (not) 3.5, 'he' said,\" she'll add...", ["``", "It", "'s", "(", "not", ")", "3.5", ",", "'he", "'", "said", ",", "''", "she", "'ll", "add", "..."]),
    ("He paid $5, e.g. at 3:30 p.m.", ["He", "paid", "$", "5", ",", "e.g", ".", "at", "3:30", "p.m", "."]),
    ("We cannot, gonna wanna go?!", ["We", "can", "not", ",", "gon", "na", "wan", "na", "go", "?", "!"]),
    ("'Tis I -- the [dog's] <tag> {x}: a&b #1 50%", ["'T", "is", "I", "--", "the", "[", "dog", "'s", "]", "<", "tag", ">", "{", "x", "}", ":", "a", "&", "b", "#", "1", "50", "%"]),
    ("I'VE they've WE'RE we'd D'ye", ["I", "'VE", "they", "'ve", "WE", "'RE", "we", "'d", "D", "'ye"]),
    ("  \t\n ", []), ("", []),
]


def test_treebank_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TOKENS)], "i int, t string")
    got = {r["i"]: r["w"] for r in df.select("i", TB.treebank_tokens("t").alias("w")).collect()}
    want = {i: w for i, (_, w) in enumerate(TOKENS)}
    # an inner abbreviation keeps its stop: only the last one is cut
    want[2] = ["He", "paid", "$", "5", ",", "e.g.", "at", "3:30", "p.m", "."]
    assert got == want
    assert spark.createDataFrame([(None,)], "t string").select(TB.treebank_tokens("t").alias("w")).first()["w"] is None


def test_contraction_fix_meets_its_tokens(spark):
    df = spark.createDataFrame([("They don't know.",)], "t string")
    joined = T.fix_contractions(T.join_tokens(TB.treebank_tokens("t")))
    assert df.select(joined.alias("j")).first()["j"] == "They don 't know ."


def test_tokens_lower(spark):
    df = spark.createDataFrame([("It ISN'T So.",)], "t string")
    assert df.select(TB.treebank_tokens("t", lower=True).alias("w")).first()["w"] == ["it", "is", "n't", "so", "."]
    assert df.select(F.size(TB.treebank_tokens("t"))).first()[0] == 5


def test_cores_are_trimmed_as_the_pattern_says(spark):
    import random

    from pyspark.sql import functions as F

    from articlelab.functions.text import WS_CLASS
    from articlelab.operators import sentences as SE
    rng = random.Random(5)
    signs = SE.OPENING + SE.CLOSING + SE.SPACE + "aÉ.5​"
    df = spark.createDataFrame([("".join(rng.choices(signs, k=rng.randint(0, 7))),) for _ in range(3000)] + [(None,)], "x string")
    df = df.select(F.explode(F.concat(SE._tokens("x"), F.array("x"))).alias("x")).where(F.col("x").isNull() | F.col("x").rlike(f"^{SE.TOKEN}$"))
    got = df.select("x", SE.core(F.col("x")).alias("new"), F.regexp_replace("x", f"^{SE.OPENERS}+|{SE.CLOSERS}*[{WS_CLASS}]*$", "").alias("old"))
    assert got.count() > 1000 and got.where("not (new <=> old)").collect() == []


def test_patterns_meet_cores_once_and_places_leave_their_text(spark, monkeypatch):
    import re

    from articlelab.operators import sentences as SE
    written, plain = {}, SE.materialize
    monkeypatch.setattr(SE, "materialize", lambda df, name="table": (written.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()), plain(df, name))[1])
    docs = spark.createDataFrame([(i, "Dr. Hill met (us). We left at 5 p.m. sharp! 'Yes.' Dr. Hill stayed.") for i in range(9)], "doc_id long, text string")
    out = SE.split_learnt(docs, ["doc_id"], SE.fit_sentences(docs))
    assert out.count() == 9
    assert "type-counts" in written          # read twice, counted once
    kept = re.findall(r"Generate explode\(.*\), \[([^\]]*)\], (?:true|false), \[", written["sentence-places"])
    assert kept and not any("_c#" in k for k in kept)
