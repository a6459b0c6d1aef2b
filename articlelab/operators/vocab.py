"""Vocabulary work of the sentence encoder.

Vocabularies are distributed tables of tokens; membership tests are
semi/anti joins (broadcast only after the vector table's size is
measured). Per-sentence regrouping sorts ``(position, token)`` structs, so
token order survives the shuffle.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from articlelab.functions.text import BOS, EOS, with_boundaries
from articlelab.operators.keys import with_row_number
from articlelab.operators.rows import explode_rows
from articlelab.operators.vectors import WordVectors, attach_vectors

# Words of a text whose vectors are compared in one go.
WORDS_AT_ONCE = 4096


def corpus_vocabulary(token_lists: DataFrame, col: str = "tokens",
                      bos: str = BOS, eos: str = EOS) -> DataFrame:
    """Distinct tokens of a corpus plus the two boundary tokens."""
    spark = token_lists.sparkSession
    words = explode_rows(token_lists, [], col)
    bounds = spark.range(1).select(F.explode(F.array(F.lit(bos), F.lit(eos))).alias("token"))
    return words.unionByName(bounds).distinct()


def vocab_update(known: DataFrame, corpus_vocab: DataFrame, wv: WordVectors) -> DataFrame:
    """words of a new corpus that are not known yet and have a vector
    (F3), added to the known ones: ``(token, origin)`` with origin
    ``known`` or ``new``."""
    vec_tokens = wv.df.select("token")
    vt = F.broadcast(vec_tokens) if wv.broadcastable() else vec_tokens.hint("merge")
    known_v = known.select("token").join(vt, "token", "left_semi")
    fresh = (corpus_vocab.select("token").join(known_v, "token", "left_anti")
             .join(vt, "token", "left_semi"))
    return (known_v.withColumn("origin", F.lit("known"))
            .unionByName(fresh.withColumn("origin", F.lit("new"))))


def first_k_vectors(vector_file: DataFrame, order_col: str, k: int,
                    bos: str = BOS, eos: str = EOS, inclusive: bool = False, hex_key: bool = False) -> DataFrame:
    """The first K rows of a word-vector file (file order given by
    ``order_col``) plus the boundary tokens wherever they are. ``inclusive``
    reproduces the reference's K+1 rows (Q11)."""
    numbered = with_row_number(vector_file, order_col, tiebreak=["token"], name="row_no", hex_key=hex_key)
    limit = k + 1 if inclusive else k
    return numbered.where((F.col("row_no") <= limit) | F.col("token").isin(bos, eos))


def kept_sentences(sent_tokens: DataFrame, ids: Sequence[str], wv: WordVectors,
                   bos: str = BOS, eos: str = EOS) -> DataFrame:
    """F4 + E22 inputs: each sentence wrapped in boundary tokens, tokens
    without a vector dropped, an emptied sentence replaced by ``[eos]``.

    In: ``(ids, sent_no, tokens)``. Out: ``(ids, sent_no, n_words, kept)``
    where ``n_words`` counts the wrapped sentence (before the drop).
    """
    ids = list(ids)
    wrapped = sent_tokens.select(*ids, "sent_no", with_boundaries("tokens", bos, eos).alias("w"))
    rows = explode_rows(wrapped.select(*ids, "sent_no", "w", F.size("w").alias("n_words")),
                        [*ids, "sent_no", "n_words"], "w", pos="pos")
    known = attach_vectors(rows, WordVectors(wv.df.select("token", F.lit(True).alias("_k")),
                                             wv.dim, wv.n_rows), "left")
    grouped = known.groupBy(*ids, "sent_no").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.collect_list(F.struct("pos", "token", F.coalesce("_k", F.lit(False)).alias("k"))))
        .alias("_all"))
    kept = F.transform(F.filter("_all", lambda s: s["k"]), lambda s: s["token"])
    return grouped.select(*ids, "sent_no", "n_words",
                          F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(eos))).alias("kept"))


def coverage(kept: DataFrame) -> DataFrame:
    """Words kept / words seen, in percent (boundary tokens count)."""
    return kept.agg(F.sum("n_words").cast("bigint").alias("n_words"),
                    F.sum(F.size("kept")).cast("bigint").alias("n_kept")).withColumn(
        "pct", F.col("n_kept") * F.lit(100.0) / F.col("n_words"))


def word_importance(items: DataFrame, ids: Sequence[str], wv: WordVectors,
                    tokens_col: str = "tokens", bos: str = BOS, eos: str = EOS) -> DataFrame:
    """For ``[bos] + known words + [eos]``, the token that holds the
    maximum of each vector dimension (first on ties), counted per token
    position; ``pct = 100 * n / dim``. The vectors of an item (one text) meet in
    one group, as whole rows; no row per dimension is made."""
    ids, dim = list(ids), wv.dim
    rows = explode_rows(items, ids, with_boundaries(tokens_col, bos, eos), pos="pos")
    known = attach_vectors(rows, wv, "inner")
    out = items.select(*ids).schema.add("tok_no", "long").add("token", "string").add("n", "long").add("pct", "double")
    arrow = to_arrow_schema(out)

    def count(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        best, holder = np.full(dim, -np.inf), np.zeros(dim, np.int64)
        for a in range(0, len(t), WORDS_AT_ONCE):
            part = t.column("vec").slice(a, WORDS_AT_ONCE).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            first = part.argmax(axis=0)
            top = part[first, np.arange(dim)]
            holder = np.where(top > best, first + a, holder)
            best = np.maximum(top, best)
        n = np.bincount(holder, minlength=len(t))
        return pa.table([*[t.column(c) for c in ids], pa.array(np.arange(len(t))), t.column("token"), pa.array(n), pa.array(n * 100.0 / dim)],
                        schema=arrow)

    return known.select(*ids, "pos", "token", "vec").groupBy(*ids).applyInArrow(count, out)
