"""Sentence boundaries learnt without labels (G6), after Kiss and Strunk (2006).

A full stop ends a sentence, unless it belongs to an abbreviation, an initial or a
number. What is an abbreviation follows from the corpus: a type that is seen with a
stop far more often than chance, is short and holds stops of its own. Three more
tables settle what follows an abbreviation: how words are written at the start
and in the middle of sentences, which words often start one, and which number or
initial belongs to the next word.

All counts come from one table, the pairs of neighbouring tokens with their
frequency (one pass over the texts, summed on the map side); scores are column
expressions over it, and a boundary is decided once for each distinct pair,
not for each place. The tables are joined, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articlelab.functions.text import WS_CLASS
from articlelab.operators.rows import explode_rows
from articlelab.session import materialize

# ---------------------------------------------------------------------------
# Fixed values of the published method: least scores of an abbreviation, a
# sentence starter and a collocation; chance of a stop after an abbreviation.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
STOP_CHANCE = 0.99
# Tokens are runs of other than space, each with the space after it; what opens
# or closes around a word is not part of its type.
TOKEN = f"[^{WS_CLASS}]+[{WS_CLASS}]*"
OPENERS, CLOSERS = "[\"'(\\[{“‘«¿¡]", "[\"')\\]}”’»,;:]"
# The same as characters to trim, and the characters of ``WS_CLASS``.
OPENING, CLOSING = "\"'([{“‘«¿¡", "\"')]}”’»,;:"
SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85 \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NUMBER = "^[0-9]+([.,:-][0-9]+)*\\.?$"
INITIAL = "^\\p{L}\\.$"
ELLIPSIS = "\\.\\.+$"
NUMBER_TYPE = "##number##"
# ---------------------------------------------------------------------------


def core(token: Column) -> Column:
    """The token without the space after it, and what opens before and closes after it."""
    return F.ltrim(F.rtrim(F.rtrim(token, F.lit(SPACE)), F.lit(CLOSING)), F.lit(OPENING))


def kind(c: Column) -> Column:
    """What a core ends like: number, initial, ellipsis, stop (a word's), mark (! or ?) or none."""
    return (F.when(~F.substring(c, -1, 1).isin(".", "!", "?"), "none").when(c.rlike(ELLIPSIS), "ellipsis").when(c.rlike("[!?]$"), "mark")
            .when(c.rlike(INITIAL), "initial").when(c.rlike("^[0-9]+([.,:-][0-9]+)*\\.$"), "number")
            .when(c.rlike("\\.$"), "stop").otherwise("none"))


def type_of(c: Column) -> Column:
    """Lower case without a last stop; all numbers are one type. (Only what begins with
    a digit is held against the pattern.)"""
    return F.when(F.ascii(c).between(48, 57) & c.rlike(NUMBER), F.lit(NUMBER_TYPE)).otherwise(F.lower(F.when(c.endswith("."), c.substr(F.lit(1), F.length(c) - 1)).otherwise(c)))


def _tokens(text) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(TOKEN), F.lit(0))


def pair_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``a, b, n``: cores of neighbouring tokens; ``a`` is null before the first,
    ``b`` after the last token of a text. One pass over the texts."""
    t = F.transform(_tokens(text_col), core)
    some = docs.select(F.filter(t, lambda x: x != "").alias("t")).where(F.size("t") > 0)
    none = F.array(F.lit(None).cast("string"))
    pairs = some.select(F.explode(F.arrays_zip(F.concat(none, "t").alias("a"), F.concat("t", none).alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _xlog(n: Column, p: Column) -> Column:
    """n * ln(p), 0 when n is."""
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.ln(p))


def abbreviation_scores(pairs: DataFrame) -> DataFrame:
    """``type, n_with, n_without, log_likelihood, score, is_abbreviation`` of every
    type that is seen with a stop and holds a letter. ``n_with``: with a last
    stop; the likelihood compares their share with that of all tokens."""
    # patterns are matched once for a core, not for a pair, and the counts are read twice
    tokens = pairs.where(F.col("a").isNotNull()).groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n"))
    stop = F.col("c").endswith(".")
    typed = materialize(tokens.where(kind(F.col("c")) != "ellipsis").groupBy(type_of(F.col("c")).alias("type")).agg(
        F.sum(F.when(stop, F.col("n")).otherwise(0)).alias("n_with"), F.sum(F.when(stop, 0).otherwise(F.col("n"))).alias("n_without")), "type-counts")
    n_all, n_stops = typed.agg(F.sum(F.col("n_with") + F.col("n_without")), F.sum("n_with")).first()
    if not n_stops or n_stops == n_all:       # no stops, or nothing else: no share to compare with
        return typed.limit(0).select("type", "n_with", "n_without", F.lit(0.0).alias("log_likelihood"), F.lit(0.0).alias("score"),
                                     F.lit(False).alias("is_abbreviation"))
    a, ab, p = F.col("n_with") + F.col("n_without"), F.col("n_with"), n_stops / n_all
    chance = ab * F.ln(F.lit(p)) + (a - ab) * F.ln(F.lit(1 - p))
    abbreviated = ab * F.ln(F.lit(STOP_CHANCE)) + (a - ab) * F.ln(F.lit(1 - STOP_CHANCE))
    inner = F.length(F.col("type")) - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    letters = (F.length(F.col("type")) - inner).cast("double")
    score = F.col("log_likelihood") * F.exp(-letters) * (inner + 1) * F.pow(letters, -F.col("n_without").cast("double"))
    known = typed.where((F.col("n_with") > 0) & F.col("type").rlike("\\p{L}"))
    return known.withColumn("log_likelihood", -2 * (chance - abbreviated)).withColumn("score", score).withColumn(
        "is_abbreviation", F.col("score") >= ABBREVIATION)


def together(n_a: Column, n_b: Column, n_ab: Column, total: Column) -> Column:
    """Log-likelihood ratio of two events: ``n_ab`` of ``n_a`` against ``n_b`` of ``total``."""
    a, b, ab, n = (x.cast("double") for x in (n_a, n_b, n_ab, total))
    p, p1, p2 = b / n, ab / a, (b - ab) / (n - a)
    one = _xlog(ab, p) + _xlog(a - ab, 1 - p)
    two = _xlog(b - ab, p) + _xlog(n - a - b + ab, 1 - p)
    three = F.when((ab == 0) | (ab == a), 0.0).otherwise(_xlog(ab, p1) + _xlog(a - ab, 1 - p1))
    four = F.when((n <= a) | (b == ab) | (n - a - b + ab <= 0), 0.0).otherwise(_xlog(b - ab, p2) + _xlog(n - a - b + ab, 1 - p2))
    return -2 * (one + two - three - four)


@dataclass
class SentenceModel:
    """Tables of a corpus: ``abbreviations`` (type), ``starters`` (type),
    ``collocations`` (a, b: types), ``writing`` (type and how it is written)."""
    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame
    writing: DataFrame

    def checkpointed(self) -> "SentenceModel":
        return SentenceModel(*(materialize(getattr(self, n), f"sentence-{n}") for n in ("abbreviations", "starters", "collocations", "writing")))


def _first_pass(pairs: DataFrame, abbreviations: DataFrame) -> DataFrame:
    """``pairs`` with types, kinds and whether ``a`` ends a sentence by itself
    (``ends``): a mark, or a stop that is no ellipsis and no abbreviation's."""
    typed = pairs.withColumns({"ka": kind(F.col("a")), "ta": type_of(F.col("a")), "tb": type_of(F.col("b"))})
    last = abbreviations.select(F.col("type").alias("_t"), F.lit(True).alias("abbr"))
    out = typed.join(last, F.col("ta") == F.col("_t"), "left").drop("_t")
    out = out.withColumn("abbr", F.coalesce("abbr", F.lit(False)) & F.col("ka").isin("stop", "initial"))
    return out.withColumn("ends", F.col("a").isNotNull() & ((F.col("ka") == "mark") | (F.col("ka").isin("stop", "initial", "number") & ~F.col("abbr"))))


def fit_sentences(docs: DataFrame, text_col: str = "text") -> SentenceModel:
    """Learn the tables from ``docs`` (null and blank texts have no tokens; an
    empty table gives empty tables, with which every stop ends a sentence)."""
    pairs = materialize(pair_counts(docs, text_col), "token-pairs")
    return fit_pairs(pairs)


def fit_pairs(pairs: DataFrame) -> SentenceModel:
    abbreviations = materialize(abbreviation_scores(pairs).where("is_abbreviation").select("type"), "abbreviations")
    first = materialize(_first_pass(pairs, abbreviations), "first-pass")
    word = F.col("b").rlike("\\p{L}")
    seen = first.where(F.col("b").isNotNull())
    counts = seen.groupBy(F.col("tb").alias("type")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ends") & F.col("a").isNotNull(), F.col("n")).otherwise(0)).alias("at_break"),
                                                         F.max(word).alias("word"))
    # at least one, for a corpus without tokens or without breaks: then nothing is scored
    total, breaks = (F.lit(max(int(x or 0), 1)) for x in seen.agg(F.sum("n"), F.sum(F.when(F.col("ends"), F.col("n")).otherwise(0))).first())
    starters = counts.where("at_break > 0 and word").where((together(breaks, F.col("n"), F.col("at_break"), total) >= STARTER)
                                                           & (total / breaks > F.col("n") / F.col("at_break"))).select("type")
    tied = first.where(F.col("ka").isin("number", "initial") & F.col("ends") & word).groupBy("ta", "tb").agg(F.sum("n").alias("both"))
    left, right = (counts.select(F.col("type").alias(t), F.col("n").alias(n)) for t, n in (("ta", "n_a"), ("tb", "n_b")))
    tied = tied.join(left, "ta").join(right, "tb")
    collocations = tied.where((F.col("both") > 1) & (together(F.col("n_a"), F.col("n_b"), F.col("both"), total) >= COLLOCATION)
                              & (total / F.col("n_a") > F.col("n_b") / F.col("both"))).select(F.col("ta").alias("a"), F.col("tb").alias("b"))
    begins = F.col("a").isNull() | F.col("ends")
    middle = ~begins & (F.col("ka") == "none")
    upper, lower = F.col("b").rlike("^\\p{Lu}"), F.col("b").rlike("^\\p{Ll}")
    writing = seen.where(upper | lower).groupBy(F.col("tb").alias("type")).agg(
        F.max(upper).alias("upper"), F.max(lower).alias("lower"), F.max(upper & middle).alias("upper_inside"), F.max(lower & begins).alias("lower_first"))
    return SentenceModel(abbreviations, starters, collocations, writing).checkpointed()


def decide(pairs: DataFrame, model: SentenceModel) -> DataFrame:
    """``a, b, ends`` for distinct pairs of cores ``a`` (with a last stop or mark)
    and ``b``: whether a sentence ends between them."""
    first = _first_pass(pairs.select("a", "b").distinct(), model.abbreviations)
    marked = lambda df, name, *cols: df.select(*[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias(name))
    x = first.join(marked(model.starters, "starter", "type"), F.col("tb") == F.col("_type"), "left").drop("_type")
    x = x.join(marked(model.collocations, "tied", "a", "b"), (F.col("ta") == F.col("_a")) & (F.col("tb") == F.col("_b")), "left").drop("_a", "_b")
    x = x.join(model.writing.withColumnRenamed("type", "_type"), F.col("tb") == F.col("_type"), "left").drop("_type")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    up, down = F.col("b").rlike("^\\p{Lu}"), F.col("b").rlike("^\\p{Ll}")
    starts = up & yes("lower") & ~yes("upper_inside")
    goes_on = down & (yes("upper") | ~yes("lower_first"))
    short = F.col("ka").isin("initial", "number")
    ends = (F.when(F.col("ka") == "mark", True)
            .when(yes("tied"), False)
            .when((F.col("abbr") | (F.col("ka") == "ellipsis")) & (F.col("ka") != "initial"), starts | (up & yes("starter")))
            .when(short & goes_on, False)
            .when((F.col("ka") == "initial") & ~starts & up & ~yes("lower"), False)
            .otherwise(F.col("ends")))
    return x.select("a", "b", F.coalesce(ends, F.lit(False)).alias("ends"))


def split_learnt(docs: DataFrame, ids: Sequence[str], model: SentenceModel, text_col: str = "text") -> DataFrame:
    """``(ids, sentences ARRAY<STRING>)``: every text cut after the tokens that end a
    sentence; a sentence keeps its inner space. ``ids`` tell rows apart. Null
    and blank texts have no sentences.

    Places move as (ids, place, pair); texts once, to meet their cuts."""
    ids = list(ids)
    rows = materialize(docs.select(*ids, _tokens(text_col).alias("_t")), "sentence-tokens")
    cores = rows.select(*ids, F.transform("_t", core).alias("_c"))
    # a place takes its own two cores along, not all of its text
    inner = F.size("_c") - 1
    pairs = F.arrays_zip(F.slice("_c", 1, inner).alias("a"), F.slice("_c", 2, inner).alias("b"), F.sequence(F.lit(1), inner).alias("_at"))
    ending = F.filter(pairs, lambda x: F.substring(x["a"], -1, 1).isin(".", "!", "?"))
    places = explode_rows(cores.where(F.size("_c") > 1), ids, ending, "_p").select(*ids, "_p._at", "_p.a", "_p.b")
    places = materialize(places, "sentence-places")
    cuts = places.join(decide(places, model).where("ends").select(F.col("a").alias("_a"), F.col("b").alias("_b")),
                       (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    per = cuts.groupBy(*ids).agg(F.array_sort(F.collect_list("_at")).alias("_cuts"))
    joined = rows.join(per.select(*[F.col(c).alias(f"_p_{c}") for c in ids], "_cuts"), [rows[c].eqNullSafe(F.col(f"_p_{c}")) for c in ids], "left")
    cuts_ = F.coalesce("_cuts", F.array().cast("array<int>"))
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), cuts_).alias("x"), F.concat(cuts_, F.array(F.size("_t"))).alias("y"))
    sentence = lambda r: F.regexp_replace(F.array_join(F.slice("_t", r["x"] + 1, r["y"] - r["x"]), ""), f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")
    return joined.select(*ids, F.when(F.size("_t") > 0, F.transform(bounds, sentence)).otherwise(F.array().cast("array<string>")).alias("sentences"))
