"""Article encoders and embedded tables.

An encoder turns ``(ids, text)`` rows into ``(ids, features ARRAY<DOUBLE>)``.
Encoders register themselves by class name (the plug-in registry of the
reference); ``fit`` learns from a training table, ``transform`` is a lazy
DataFrame transformation. Nothing is pickled: fitted state is a table
(word vectors) or a Spark ML model with its own persistence (B6).
"""

from __future__ import annotations

from typing import Callable, ClassVar, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from articlelab.functions import text as T
from articlelab.operators import vectors as V
from articlelab.operators.labels import apply_class_map, assert_mapped, class_map
from articlelab.operators.rows import explode_rows


class Encoder:
    """Registry base. Subclasses are found by class name."""
    registry: ClassVar[dict[str, type["Encoder"]]] = {}
    dim: int

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        Encoder.registry.setdefault(cls.__name__, cls)

    @classmethod
    def by_name(cls, name: str, **kw) -> "Encoder":
        if name not in cls.registry:
            raise KeyError(f"unknown encoder {name!r}; known: {sorted(cls.registry)}")
        return cls.registry[name](**kw)

    def fit(self, df: DataFrame, text_col: str = "text") -> "Encoder":
        return self

    def transform(self, df: DataFrame, ids: Sequence[str], text_col: str = "text") -> DataFrame:
        raise NotImplementedError

    def save(self, path: str) -> None:
        """Write the fitted state; stateless encoders have none."""
        raise NotImplementedError(f"{type(self).__name__} has no state to save")

    @classmethod
    def load(cls, spark, path: str) -> "Encoder":
        """An encoder from its saved state."""
        raise NotImplementedError(f"{cls.__name__} has no saved form")

    @classmethod
    def pretrained(cls, **kw) -> "Encoder":
        """Encoders without a pretrained form refuse clearly (Q14, Q21)."""
        raise NotImplementedError(f"{cls.__name__} has no pretrained form")


class MeanWordVectorEncoder(Encoder):
    """E6 encoder over a word-vector table (hash vectors by default)."""

    def __init__(self, dim: int = 8, vectors: V.WordVectors | None = None):
        self.dim = dim
        self.vectors = vectors

    def fit(self, df: DataFrame, text_col: str = "text") -> "MeanWordVectorEncoder":
        """M5: vocabulary from the training text only."""
        toks = explode_rows(df, [], T.flat_tokens(text_col))
        self.vectors = V.hash_word_vectors(toks, self.dim).checkpointed()
        return self

    def save(self, path: str) -> None:
        """The vector table as parquet."""
        self.vectors.df.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "MeanWordVectorEncoder":
        df = spark.read.parquet(path)
        dim = df.select(F.max(F.size("vec"))).first()[0] or 0
        return cls(dim, V.WordVectors(df, dim))

    @classmethod
    def pretrained(cls, spark, path: str, dim: int) -> "MeanWordVectorEncoder":
        """Over a word-vector text file."""
        from articlelab.sources.files import read_word_vectors
        table = read_word_vectors(spark, path, dim).select("token", "vec")
        return cls(dim, V.WordVectors(table, dim).checkpointed())

    def transform(self, df: DataFrame, ids: Sequence[str], text_col: str = "text") -> DataFrame:
        if self.vectors is None:
            raise ValueError("fit the encoder (or give a vector table) first")
        docs = df.select(*ids, T.flat_tokens(text_col).alias("tokens"))
        return V.article_mean_vectors(docs, self.vectors, ids).drop("n_known")


class Word2VecEncoder(Encoder):
    """M1: continuous bag of words on the tokenised sentences (see
    ``train.word_vectors``; the vocabulary is a table); article vector = sum of
    known word vectors / all tokens (Q7)."""

    def __init__(self, dim: int = 100, min_count: int = 1, window: int = 5, seed: int = 42, epochs: int = 5):
        self.dim, self.min_count, self.window, self.seed, self.epochs = dim, min_count, window, seed, epochs
        self.vectors: V.WordVectors | None = None

    def fit(self, df: DataFrame, text_col: str = "text") -> "Word2VecEncoder":
        from articlelab.session import materialize
        from articlelab.train.word_vectors import fit_cbow
        # a sentence's number is written with it, so that it stays the same
        sents = explode_rows(df, [], T.sentence_tokens(text_col), "tokens").withColumn("sid", F.monotonically_increasing_id().cast("string"))
        words = fit_cbow(materialize(sents, "sentences"), self.dim, self.min_count, self.window, self.epochs, self.seed)
        self.vectors = V.WordVectors(words.select(F.col("word").alias("token"), "vec"), self.dim)
        return self

    def word_vectors(self) -> V.WordVectors:
        """The learnt vectors as a table."""
        if self.vectors is None:
            raise ValueError("fit or load the encoder first")
        return self.vectors

    def transform(self, df: DataFrame, ids: Sequence[str], text_col: str = "text") -> DataFrame:
        docs = df.select(*ids, T.flat_tokens(text_col).alias("tokens"))
        return V.article_mean_vectors(docs, self.word_vectors(), ids).drop("n_known")

    def save(self, path: str) -> None:
        """The vector table as parquet."""
        self.word_vectors().df.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> "Word2VecEncoder":
        df = spark.read.parquet(path)
        enc = cls(dim=df.select(F.max(F.size("vec"))).first()[0] or 0)
        enc.vectors = V.WordVectors(df, enc.dim)
        return enc


class SentenceEncoder(Encoder):
    """M6: a user-supplied sentence encoder ``fn(list[str]) -> ndarray``
    run per Arrow batch with ``mapInPandas`` (loaded once per task, never
    per row); sentences of a batch are sorted by length first (D9); the
    article vector is the mean of its sentence vectors (E7, Q8)."""

    def __init__(self, fn: Callable[[list[str]], np.ndarray] | None = None, dim: int = 16,
                 batch_rows: int = 5000):
        self.fn = fn or hashed_bag_encoder(dim)
        self.dim = dim
        self.batch_rows = batch_rows

    def transform(self, df: DataFrame, ids: Sequence[str], text_col: str = "text") -> DataFrame:
        ids = list(ids)
        # an article without sentences keeps one row with a null sentence
        sents = df.select(*ids, F.posexplode_outer(T.sentence_tokens(text_col)).alias("sent_no", "toks")).select(
            *ids, "sent_no", T.join_tokens("toks").alias("sentence"))
        fn, dim, chunk = self.fn, self.dim, self.batch_rows
        schema = sents.select(*ids).schema.add("_n", "long").add("_sum", ArrayType(DoubleType()))

        def encode(batches):
            for pdf in batches:
                # Fixed-size chunks of an Arrow batch; D9: longest
                # sentences first inside a chunk (the keys travel along)
                for start in range(0, len(pdf), chunk):
                    part = pdf.iloc[start:start + chunk]
                    part = part.loc[part["sentence"].str.len().sort_values(ascending=False, kind="stable").index]
                    known = part["sentence"].notna().to_numpy()
                    vecs = np.asarray(fn(part["sentence"][known].tolist()), dtype=np.float64).reshape(known.sum(), dim)
                    # back in their order, an article's sentences are one stretch: a row leaves for each
                    rows = pdf.iloc[start:start + chunk]
                    every = np.zeros((len(rows), dim))
                    every[part.index[known].to_numpy() - rows.index[0]] = vecs
                    keys = rows[ids]
                    first = np.flatnonzero((keys != keys.shift()).any(axis=1).to_numpy() | (np.arange(len(rows)) == 0))
                    out = keys.iloc[first].copy()
                    out["_n"] = np.add.reduceat(rows["sentence"].notna().to_numpy().astype(np.int64), first)
                    out["_sum"] = pd.Series(list(np.add.reduceat(every, first, axis=0)), index=out.index, dtype=object)
                    yield out

        parts = sents.drop("sent_no").mapInPandas(encode, schema)
        per = parts.groupBy(*ids).agg(F.sum("_n").alias("_n"), V.sum_vectors("_sum", dim).alias("_sum"))
        # documents without any sentence: zero vector (Q14)
        return per.select(*ids, F.transform("_sum", lambda x: x / F.greatest("_n", F.lit(1))).alias("features"))


def hashed_bag_encoder(dim: int) -> Callable[[list[str]], np.ndarray]:
    """A small stand-in sentence encoder (no model files are available): each
    distinct word adds +1 or -1 to one dimension, both from its md5 (first
    seven hex digits modulo ``dim``; the last digit's parity), L2-normalised.
    Words are hashed once per batch; sums are one scatter-add."""
    import hashlib

    def fn(sentences: list[str]) -> np.ndarray:
        split = [s.split(" ") for s in sentences]
        row = np.repeat(np.arange(len(split)), [len(w) for w in split])
        place, words = pd.factorize(np.array([w for s in split for w in s], dtype=object))
        digests = [hashlib.md5(w.encode()).hexdigest() for w in words]
        column = np.array([int(d[:7], 16) % dim for d in digests], dtype=np.int64)
        sign = np.array([0.0 if not w else 1.0 if int(d[-1], 16) % 2 else -1.0 for w, d in zip(words, digests, strict=True)])
        out = np.zeros((len(sentences), dim))
        if len(words):
            np.add.at(out, (row, column[place]), sign[place])
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)
    return fn


def embedded_table(articles: DataFrame, encoder: Encoder, split_col: str | None = "split",
                   id_col: str = "doc_id", type_col: str = "type",
                   mapping: DataFrame | None = None, text_col: str = "text",
                   carry: Sequence[str] = ()) -> DataFrame:
    """M2/M3/M4: ``(id, split, label, features)`` (and the ``carry`` columns);
    the class map is fitted once over all rows (Q2) unless the caller
    supplies one (M4). C12: the job fails if a vector has the wrong width.

    Labels, splits and carried columns travel with the rows as group keys, so
    nothing is joined back by id: rows stay as many as they were."""
    if mapping is not None:
        # A caller-supplied map must cover every type, as in the reference
        assert_mapped(articles, mapping, type_col)
    m = mapping if mapping is not None else class_map(articles, type_col, "label")
    keys = [id_col, *([split_col] if split_col else []), "label", *carry]
    out = encoder.transform(apply_class_map(articles, m, type_col).select(*keys, text_col), keys, text_col)
    checked = F.when(F.size("features") == encoder.dim, F.col("features")).otherwise(
        F.raise_error(F.lit(f"vector width differs from {encoder.dim}")))
    return out.select(*keys, checked.alias("features"))


def expand_features(df: DataFrame, dim: int, col: str = "features", prefix: str = "f") -> DataFrame:
    """B1: ``features`` -> ``f0 .. f{dim-1}`` columns (CSV cannot hold arrays)."""
    others = [c for c in df.columns if c != col]
    return df.select(*others, *[F.col(col)[i].alias(f"{prefix}{i}") for i in range(dim)])


def collapse_features(df: DataFrame, prefix: str = "f", col: str = "features") -> DataFrame:
    """``label, f0 .. fN`` -> ``features`` array (width from the header)."""
    fcols = sorted([c for c in df.columns if c.startswith(prefix) and c[len(prefix):].isdigit()],
                   key=lambda c: int(c[len(prefix):]))
    others = [c for c in df.columns if c not in fcols]
    return df.select(*others, F.array(*[F.col(c).cast("double") for c in fcols]).alias(col))
