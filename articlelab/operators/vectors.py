"""Word-vector tables, token -> vector lookup and pooling.

A word-vector table is ``(token STRING, vec ARRAY<DOUBLE>)``. Pooling works on
whole texts: a part of the table whose measured size fits a budget goes to the
tasks as one matrix, and each Arrow batch of token lists is looked up,
summed (or maximised) and divided there, without a row per token and without
a shuffle. If the table is larger, that part holds the most frequent tokens; the
tokens it lacks leave as rows, are counted per text, meet the table by a
sort-merge join, and their sums come back to the text's. So a hot token never
sits in one task, and the table is never copied whole. Where only a lookup is
asked for (``attach_vectors``), both parts are joins.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType

from articlelab.functions.vectors import has_hash_vector, hash_vector
from articlelab.operators.rows import explode_rows

# Default broadcast budget of a word-vector table, or of its hot part (bytes).
BROADCAST_BUDGET = 64 * 1024 * 1024

# Columns of wide vectors that meet the tokens outside that part in one join.
BLOCK_DIM = 40


def row_bytes(dim: int) -> int:
    """Estimated size of one word-vector row: the doubles, the token, overhead."""
    return dim * 8 + 64


@dataclass
class WordVectors:
    """A word-vector table and its dimension; rows and token bytes are measured once.
    ``counts``: tokens with the number of texts they stand in (``token, n``), if known."""
    df: DataFrame
    dim: int
    n_rows: int | None = field(default=None)
    token_bytes: int | None = field(default=None)
    counts: DataFrame | None = field(default=None)

    def _measure(self) -> None:
        if self.n_rows is None or self.token_bytes is None:
            self.n_rows, self.token_bytes = self.df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()

    def count(self) -> int:
        self._measure()
        return self.n_rows

    def est_bytes(self) -> int:
        self._measure()
        return self.n_rows * row_bytes(self.dim) + self.token_bytes

    def broadcastable(self, budget: int | None = None) -> bool:
        return self.est_bytes() <= (BROADCAST_BUDGET if budget is None else budget)

    def checkpointed(self) -> "WordVectors":
        """Cut the lineage (a table written to the shared checkpoint folder)
        and measure the size; used for vocabularies derived from a corpus."""
        from articlelab.session import materialize
        return WordVectors(materialize(self.df, "word-vectors"), self.dim)


def hash_word_vectors(tokens: DataFrame, dim: int = 8, token_col: str = "token") -> WordVectors:
    """Test word vectors (FIXTURES.md) for the distinct tokens of a table;
    tokens whose md5 ends in 0 get no row (out of vocabulary)."""
    vocab = tokens.select(F.col(token_col).alias("token")).where(F.col("token").isNotNull()).distinct()
    df = vocab.where(has_hash_vector("token")).select("token", hash_vector("token", dim).alias("vec"))
    return WordVectors(df, dim)


def hash_vectors_of_lists(docs: DataFrame, dim: int = 8, tokens_col: str = "tokens") -> WordVectors:
    """``hash_word_vectors`` of the tokens of written token lists. One pass counts the
    texts that each token stands in; vectors and, where the table exceeds a
    budget, its most frequent tokens both come from these counts."""
    from articlelab.session import materialize
    counts = explode_rows(docs, [], F.array_distinct(tokens_col)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "token-counts")
    df = counts.where(has_hash_vector("token")).select("token", hash_vector("token", dim).alias("vec"))
    return WordVectors(materialize(df, "word-vectors"), dim, counts=counts.where(has_hash_vector("token")))


def attach_vectors(rows: DataFrame, wv: WordVectors, how: str = "left",
                   budget: int | None = None) -> DataFrame:
    """add ``vec`` to every row by token (null when unknown for a left
    join).

    * The table's measured size fits ``budget``: broadcast hash join.
    * Otherwise ``rows`` is written once (it is read three times) and split:
      the most frequent tokens, as many as fit the budget, take a broadcast
      join with their vectors; every other token a sort-merge join; rows
      without a token none. A token holding a third of all rows never lands
      in one task, and the vector table is not copied.
    """
    budget = BROADCAST_BUDGET if budget is None else budget
    if wv.broadcastable(budget):
        return rows.join(F.broadcast(wv.df), on="token", how=how)
    from articlelab.session import materialize
    rows = materialize(rows, "token-rows")
    named = rows.where(F.col("token").isNotNull())
    freq = named.groupBy("token").agg(F.count(F.lit(1)).alias("_f"))
    hot_tokens = materialize(freq.orderBy(F.col("_f").desc(), F.col("token")).limit(
        max(1, budget // row_bytes(wv.dim))).select("token", F.lit(True).alias("_hot")), "hot-tokens")
    tagged = named.join(F.broadcast(hot_tokens), on="token", how="left")
    hot_vecs = wv.df.join(F.broadcast(hot_tokens.select("token")), on="token", how="left_semi")
    hot_part = tagged.where(F.col("_hot").isNotNull()).join(F.broadcast(hot_vecs), on="token", how=how)
    cold_part = tagged.where(F.col("_hot").isNull()).join(wv.df.hint("merge"), on="token", how=how)
    out = hot_part.unionByName(cold_part).drop("_hot")
    if how != "left":
        return out
    bare = rows.where(F.col("token").isNull())
    for field in wv.df.schema.fields:
        if field.name != "token":
            bare = bare.withColumn(field.name, F.lit(None).cast(field.dataType))
    return out.unionByName(bare)


def _zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def _summarized(metric: str, vec: Column) -> Column:
    """A ``Summarizer`` metric of an ARRAY<DOUBLE> expression; every row has
    weight 1, so no group is ever without weight."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    return vector_to_array(getattr(Summarizer, metric)(array_to_vector(vec)))


def sum_vectors(vec: str, dim: int, weight: Column | None = None) -> Column:
    """Aggregate: per-dimension weighted sum of an ARRAY<DOUBLE> column
    (null vectors add nothing)."""
    scaled = F.col(vec) if weight is None else F.transform(vec, lambda x: x * weight)
    return _summarized("sum", F.coalesce(scaled, _zeros(dim)))


def mean_vectors(vec: str, dim: int) -> Column:
    """Aggregate: per-dimension mean over non-null vectors (null if none)."""
    total, n = sum_vectors(vec, dim), F.count(vec)
    return F.when(n > 0, F.transform(total, lambda x: x / n))


def max_vectors(vec: str, dim: int) -> Column:
    """Aggregate: per-dimension max over non-null vectors (null if none)."""
    # rows without a vector never win a max: fill them with -inf
    filled = F.coalesce(F.col(vec), F.array_repeat(F.lit(float("-inf")), dim))
    return F.when(F.count(vec) > 0, _summarized("max", filled))


# -- pooling of whole texts -------------------------------------------------

@dataclass
class _Lookup:
    """Vectors of some tokens as a matrix; ``whole``: of all tokens that have one."""
    tokens: pa.Array
    matrix: np.ndarray
    whole: bool


def _lookup(tokens: DataFrame | None, wv: WordVectors, budget: int | None) -> _Lookup:
    """The whole table if its measured size fits ``budget``, else the vectors of the
    most frequent of ``tokens``, as many as fit (their own bytes counted)."""
    budget = BROADCAST_BUDGET if budget is None else budget
    whole = wv.est_bytes() <= budget
    df = wv.df
    if not whole:
        most = max(1, budget // (2 * row_bytes(wv.dim)))   # half the budget for vectors, half for long tokens
        short = F.octet_length("token") <= row_bytes(wv.dim)
        if wv.counts is not None:       # of tokens that have a vector
            freq = wv.counts.where(short).select("token", F.col("n").alias("_f"))
        else:
            freq = tokens.where(short).groupBy("token").agg(F.count(F.lit(1)).alias("_f")).join(wv.df.select("token"), "token", "left_semi")
        hot = freq.orderBy(F.col("_f").desc(), "token").limit(most).select("token")
        df = wv.df.join(F.broadcast(hot), "token", "left_semi")
    t = df.where(F.col("token").isNotNull()).groupBy("token").agg(F.first("vec").alias("vec")).toArrow()
    vec = t.column("vec").combine_chunks()
    matrix = vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wv.dim) if len(vec) else np.zeros((0, wv.dim))
    return _Lookup(t.column("token").combine_chunks(), np.vstack([matrix, np.zeros(wv.dim)]), whole)


def _pool(matrix: np.ndarray, ids: np.ndarray, edges: np.ndarray, pool: str) -> np.ndarray:
    """Sum or maximum of the rows ``ids`` of every stretch between ``edges``; an
    empty stretch gives zeros (-inf for the maximum)."""
    out = np.full((len(edges) - 1, matrix.shape[1]), 0.0 if pool == "sum" else -np.inf)
    some = np.flatnonzero(np.diff(edges))
    step = max(1, (32 << 20) // (8 * matrix.shape[1]))
    for a in range(0, len(some), 512):      # a bounded number of rows at a time
        part = some[a:a + 512]
        x, y = edges[part[0]], edges[part[-1] + 1]
        if y - x <= step or len(part) == 1:
            out[part] = (np.add if pool == "sum" else np.maximum).reduceat(matrix[ids[x:y]], edges[part] - x, axis=0)
        else:
            for k in part:
                for c in range(edges[k], edges[k + 1], step):
                    rows = matrix[ids[c:min(c + step, edges[k + 1])]]
                    out[k] = out[k] + rows.sum(axis=0) if pool == "sum" else np.maximum(out[k], rows.max(axis=0))
    return out


def _vector_lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


#: Tokens of an Arrow batch that are looked up and pooled at a time, and sentences
#: whose vectors are held at a time.
TOKENS_AT_ONCE, SENTENCES_AT_ONCE = 1 << 20, 1 << 13

#: Tokens of a lot of articles that fetch the vectors of their own tokens: so many if
#: that gives a lot for a task, up to ``LOT_MOST`` times as many else, for the more
#: tokens a lot has the fewer of them differ.
LOT_TOKENS, LOT_MOST = 200_000, 5

#: Bytes of the vectors that lots fetch at a time, most passes over the lots.
LOT_PASS_BYTES, LOT_PASSES = 512 << 20, 8


def _slices(batch: pa.RecordBatch, sizes: np.ndarray):
    """The batch in stretches of rows of some ``TOKENS_AT_ONCE`` tokens (one row at least)."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + TOKENS_AT_ONCE, side="right")))
        yield batch.slice(a, b - a)
        a = b


def _pooled_units(units: DataFrame, ids: Sequence[str], wv: WordVectors, lookup: _Lookup, pool: str, tokens_col: str) -> DataFrame:
    """``ids, n_tokens, n_known, vec, cold`` per row: pooled vectors of the tokens that
    the lookup holds, and the list of those it lacks (none if it is whole). A
    null token counts nowhere."""
    ids, dim = list(ids), wv.dim
    shared = units.sparkSession.sparkContext.broadcast(lookup)
    kinds = units.select(*ids).schema
    schema = kinds.add("n_tokens", "long").add("n_known", "long").add("vec", ArrayType(DoubleType())).add("cold", ArrayType(StringType()))
    arrow = to_arrow_schema(schema)

    def run(batches):
        own = shared.value
        for batch in (part for whole in batches for part in _slices(whole, pc.fill_null(pc.list_value_length(whole.column(len(ids))), 0).to_numpy(zero_copy_only=False))):
            lists = batch.column(len(ids))
            lists = lists.fill_null([]) if lists.null_count else lists
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy()
            real = flat.is_valid().to_numpy(zero_copy_only=False)
            at = pc.fill_null(pc.index_in(flat, value_set=own.tokens), -1).to_numpy(zero_copy_only=False)
            known = real & (at >= 0)
            owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            n, n_known = np.bincount(owner[real], minlength=len(sizes)), np.bincount(owner[known], minlength=len(sizes))
            vec = _pool(own.matrix, at[known], np.concatenate([[0], np.cumsum(n_known)]), pool)
            if own.whole:
                cold = pa.nulls(len(sizes), pa.list_(pa.string()))
            else:
                lacks = real & ~known
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner[lacks], minlength=len(sizes)))]).astype(np.int32)
                cold = pa.ListArray.from_arrays(edges, flat.filter(pa.array(lacks)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).cast(arrow.field(i).type) for i in range(len(ids))], pa.array(n, pa.int64()),
                                              pa.array(n_known, pa.int64()), _vector_lists(vec), cold.cast(arrow.field(len(arrow) - 1).type)], schema=arrow)

    return units.select(*ids, tokens_col).mapInArrow(run, schema)


def _cold_pooled(cold: DataFrame, wv: WordVectors, pool: str) -> DataFrame:
    """``_u, _n, _v``: known tokens and pooled vector of the pairs ``_u, token, _w``
    of every unit. A pair meets its vector by a join, ``BLOCK_DIM`` columns at a time:
    only a block's columns are on their way at once, so wide vectors take no more
    disk than narrow ones, and what leaves a block is a row per unit."""
    from articlelab.session import materialize

    def of(pairs: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
        # a plain sum or maximum per column: no object is kept for a unit
        at = [F.col("vec")[i] for i in range(width)]
        cols = [F.coalesce(F.sum(x * F.col("_w")), F.lit(0.0)) if pool == "sum" else F.coalesce(F.max(x), F.lit(float("-inf"))) for x in at]
        per = pairs.join(vectors.hint("merge"), "token").groupBy("_u").agg(F.sum("_w").cast("long").alias("_n"), *[c.alias(f"_c{i}") for i, c in enumerate(cols)])
        return per.select("_u", "_n", F.array(*[f"_c{i}" for i in range(width)]).alias("_v"))

    if wv.dim <= BLOCK_DIM:
        return of(cold, wv.df, wv.dim)
    cold = materialize(cold, "cold-pairs")
    out = None
    for a in range(0, wv.dim, BLOCK_DIM):
        width = min(BLOCK_DIM, wv.dim - a)
        part = materialize(of(cold, wv.df.select("token", F.slice("vec", a + 1, width).alias("vec")), width), "cold-columns")
        out = part if out is None else out.join(part.select("_u", F.col("_v").alias("_more")), "_u").select("_u", "_n", F.concat("_v", "_more").alias("_v"))
    return out


def pooled_tokens(units: DataFrame, ids: Sequence[str], wv: WordVectors, pool: str = "sum", tokens_col: str = "tokens",
                  budget: int | None = None, written: bool = False) -> DataFrame:
    """``ids, n_tokens, n_known, vec``: sum or maximum of the vectors of each row's
    known tokens (``vec`` is zeros, or -inf for the maximum, where ``n_known`` is 0).
    ``written``: ``units`` is a written table, to read twice costs little."""
    from articlelab.session import materialize
    ids = list(ids)
    if not written and not wv.broadcastable(budget):      # read twice: once for frequencies
        units = materialize(units.select(*ids, tokens_col), "token-lists")
    lookup = _lookup(explode_rows(units, [], tokens_col), wv, budget)
    first = _pooled_units(units, ids, wv, lookup, pool, tokens_col)
    if lookup.whole:
        return first.drop("cold")
    first = materialize(first.withColumn("_u", F.monotonically_increasing_id()), "pooled-units")
    cold = first.select("_u", F.explode("cold").alias("token")).groupBy("_u", "token").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    rest = _cold_pooled(cold, wv, pool)
    plus = (lambda x, y: x + y) if pool == "sum" else (lambda x, y: F.greatest(x, y))
    both = F.when(F.col("_v").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "_v", plus))
    return first.join(rest, "_u", "left").select(*ids, "n_tokens", (F.col("n_known") + F.coalesce("_n", F.lit(0))).alias("n_known"), both.alias("vec"))


def article_mean_vectors(docs: DataFrame, wv: WordVectors, ids: Sequence[str], tokens_col: str = "tokens",
                         budget: int | None = None, written: bool = False) -> DataFrame:
    """Article vector = sum of the vectors of its known tokens divided
    by the number of **all** its tokens (OOV included, Q7); an article
    without tokens gets the zero vector. One row per row of ``docs``:
    ids, n_tokens, n_known, features."""
    denom = F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")
    out = pooled_tokens(docs, ids, wv, "sum", tokens_col, budget, written)
    return out.select(*ids, "n_tokens", "n_known", F.transform("vec", lambda x: x / denom).alias("features"))


def _sentence_means(lists: pa.Array, tokens: pa.Array, matrix: np.ndarray, whole: bool, pool: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per article of nested token lists: how many sentences have a known token, the
    sum of their pooled vectors, and the sentences that wait as they hold a token
    which ``tokens`` lacks (none if these are ``whole``)."""
    lists = lists.fill_null([]) if lists.null_count else lists
    sents, n_docs = lists.flatten(), len(lists)
    owner = np.repeat(np.arange(n_docs), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    sizes = pc.fill_null(pc.list_value_length(sents), 0).to_numpy(zero_copy_only=False)
    flat = sents.flatten()
    at = pc.fill_null(pc.index_in(flat, value_set=tokens), -1).to_numpy(zero_copy_only=False)
    sent = np.repeat(np.arange(len(sents)), sizes)
    waits = np.zeros(len(sents), bool)
    if not whole:
        waits[sent[flat.is_valid().to_numpy(zero_copy_only=False) & (at < 0)]] = True
    used = (at >= 0) & ~waits[sent]
    n_known = np.bincount(sent[used], minlength=len(sents))
    edges, at = np.concatenate([[0], np.cumsum(n_known)]), at[used]
    count, total = np.bincount(owner[n_known > 0], minlength=n_docs), np.zeros((n_docs, matrix.shape[1]))
    some = np.flatnonzero(n_known)
    for a in range(0, len(some), SENTENCES_AT_ONCE):
        part = some[a:a + SENTENCES_AT_ONCE]
        x, y = edges[part[0]], edges[part[-1] + 1]
        vec = _pool(matrix, at[x:y], np.append(edges[part], y) - x, "sum" if pool == "mean" else "max")
        if pool == "mean":
            vec /= n_known[part, None]
        first = np.flatnonzero(np.diff(owner[part], prepend=-1))
        total[owner[part][first]] += np.add.reduceat(vec, first, axis=0)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[waits], minlength=n_docs))]).astype(np.int32)
    return count, total, pa.ListArray.from_arrays(offsets, sents.filter(pa.array(waits)))


def _nested_sizes(lists: pa.Array) -> np.ndarray:
    """Tokens of each article of nested token lists."""
    sents = pc.fill_null(pc.list_value_length(lists.flatten()), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sents)])
    edges = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
    return np.diff(ends[edges])


def _waiting_sums(first: DataFrame, wv: WordVectors, lookup: _Lookup, pool: str, block: int) -> DataFrame:
    """``_doc, _n, _v``: number and sum of the pooled vectors of the sentences that
    wait (``waits``). Articles are dealt to lots; a lot gets the vectors of its own
    tokens, ``block`` columns at a time, and gives a row per article: the vector of a
    sentence is never sent or written. Many lots go in a few passes, so only a part of
    the articles and of their tokens' vectors is on its way at once."""
    from articlelab.session import materialize
    spark, dim = first.sparkSession, wv.dim
    waiting = first.where(F.size("waits") > 0)
    n_tokens = waiting.agg(F.sum(F.aggregate("waits", F.lit(0).cast("long"), lambda n, s: n + F.size(s)))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lots = max(1, -(-n_tokens // (LOT_TOKENS * LOT_MOST)), min(tasks, -(-n_tokens // LOT_TOKENS)))
    rest = waiting.select(F.pmod(F.xxhash64("_doc"), F.lit(lots)).alias("_lot"), "_doc", "waits")
    needs = materialize(explode_rows(rest, ["_lot"], F.flatten("waits")).distinct(), "lot-tokens")
    passes = max(1, min(LOT_PASSES, lots, -(-needs.count() * row_bytes(min(block, dim)) // LOT_PASS_BYTES)))
    cuts = [lots * i // passes for i in range(passes + 1)]
    shared = spark.sparkContext.broadcast(lookup)
    hot = spark.createDataFrame(pa.table({"token": lookup.tokens}))
    cold = wv.df.join(F.broadcast(hot), "token", "left_anti")

    def columns(a: int, width: int):
        def run(docs: pa.Table, words: pa.Table) -> pa.Table:
            own = shared.value
            tokens = pa.concat_arrays([own.tokens, words.column("token").combine_chunks().cast(own.tokens.type)])
            vec = words.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            matrix = np.vstack([own.matrix[:-1, a:a + width], vec, np.zeros(width)])
            ids, n, v = [], [], []
            for batch in docs.select(["_doc", "waits"]).combine_chunks().to_batches():
                for part in _slices(batch, _nested_sizes(batch.column(1))):
                    count, total, _ = _sentence_means(part.column(1), tokens, matrix, True, pool)
                    ids.append(part.column(0))
                    n.append(count)
                    v.append(total)
            if not ids:
                return pa.table({"_doc": pa.array([], pa.int64()), "_n": pa.array([], pa.int64()), "_v": pa.array([], pa.list_(pa.float64()))})
            return pa.table({"_doc": pa.concat_arrays(ids), "_n": np.concatenate(n), "_v": _vector_lists(np.vstack(v))})
        return run

    out = None
    for a in range(0, dim, block):
        width = min(block, dim - a)
        part = cold.select("token", F.slice("vec", a + 1, width).alias("vec")).hint("merge")
        got = None
        for first_lot, next_lot in zip(cuts[:-1], cuts[1:], strict=True):
            here = F.col("_lot").between(first_lot, next_lot - 1)
            vectors = needs.where(here).join(part, "token").select("_lot", "token", "vec")
            of = rest.where(here).groupBy("_lot").cogroup(vectors.groupBy("_lot")).applyInArrow(columns(a, width), "_doc long, _n long, _v array<double>")
            of = materialize(of, "lot-columns")
            got = of if got is None else got.unionByName(of)
        out = got if out is None else out.join(got.select("_doc", F.col("_v").alias("_more")), "_doc").select("_doc", "_n", F.concat("_v", "_more").alias("_v"))
    return out


def article_sentence_vectors(docs: DataFrame, wv: WordVectors, ids: Sequence[str], pool: str = "mean", sentences_col: str = "sentences",
                             budget: int | None = None) -> DataFrame:
    """E7 over E8 / E9: mean over an article's sentences of their pooled (``mean``
    or ``max``) word vectors; a sentence without a known token counts nowhere,
    an article without any gets the zero vector (Q8, Q14). Out: ids,
    n_sentences, features; one row per row of ``docs`` (read twice if the vectors
    exceed the budget: a written table). Sentences are pooled and summed inside a
    task, at once or, with tokens outside the broadcast part, by lot."""
    from articlelab.session import materialize
    ids, dim = list(ids), wv.dim
    lookup = _lookup(explode_rows(docs, [], F.flatten(sentences_col)), wv, budget)
    rows = docs.select(*ids, F.monotonically_increasing_id().alias("_doc"), sentences_col)
    shared = docs.sparkSession.sparkContext.broadcast(lookup)
    schema = rows.drop(sentences_col).schema.add("_count", "long").add("_sum", ArrayType(DoubleType())).add("waits", ArrayType(ArrayType(StringType())))
    arrow = to_arrow_schema(schema)
    k = len(ids) + 1

    def run(batches):
        own = shared.value
        for batch in (part for whole in batches for part in _slices(whole, _nested_sizes(whole.column(k)))):
            count, total, waits = _sentence_means(batch.column(k), own.tokens, own.matrix, own.whole, pool)
            yield pa.RecordBatch.from_arrays([*[batch.column(i).cast(arrow.field(i).type) for i in range(k)], pa.array(count, pa.int64()),
                                              _vector_lists(total), waits.cast(arrow.field(k + 2).type)], schema=arrow)

    first = rows.mapInArrow(run, schema)
    n, total = F.col("_count"), F.col("_sum")
    if not lookup.whole:
        first = materialize(first, "sentence-sums")
        first = first.drop("waits").join(_waiting_sums(first, wv, lookup, pool, BLOCK_DIM), "_doc", "left")
        n = n + F.coalesce("_n", F.lit(0))
        total = F.when(F.col("_v").isNull(), total).otherwise(F.zip_with(total, "_v", lambda x, y: x + y))
    return first.select(*ids, n.cast("bigint").alias("n_sentences"), total.alias("_m")).select(
        *ids, "n_sentences", F.transform("_m", lambda x: x / F.greatest("n_sentences", F.lit(1))).alias("features"))


def sentence_token_rows(docs: DataFrame, ids: Sequence[str],
                        sentences_col: str = "sentences") -> DataFrame:
    """(ids, sent_no, tok_no, token) long form; a document without
    sentences keeps one row with null sentence and token."""
    ids = list(ids)
    s = docs.select(*ids, F.posexplode_outer(sentences_col).alias("sent_no", "sent"))
    return s.select(*ids, "sent_no", F.posexplode_outer("sent").alias("tok_no", "token"))


def pooled_sentence_vectors(rows: DataFrame, wv: WordVectors, ids: Sequence[str],
                            pool: str = "mean") -> DataFrame:
    """One vector per (ids, sent_no) pooled over the sentence's known
    tokens (mean or max); sentences without a known token give null."""
    ids = list(ids)
    joined = attach_vectors(rows, wv, "left")
    agg = mean_vectors if pool == "mean" else max_vectors
    return joined.groupBy(*ids, "sent_no").agg(agg("vec", wv.dim).alias("vec"))


def mean_of_sentences(sent_vecs: DataFrame, dim: int, ids: Sequence[str]) -> DataFrame:
    """Article vector = mean of its sentence vectors; zero vector when
    no sentence has one (Q8/Q14)."""
    ids = list(ids)
    agg = sent_vecs.groupBy(*ids).agg(F.count("vec").cast("bigint").alias("n_sentences"),
                                      mean_vectors("vec", dim).alias("_m"))
    return agg.select(*ids, "n_sentences",
                      F.coalesce(F.col("_m"), _zeros(dim)).alias("features"))
