"""Shuffle, head, exact samples, train/test split, batches (D1-D5, D8,
A4, B3, E5, S1)."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articlelab.operators.keys import DEFAULT_SEED, TRAIN_SHARE, shuffle_key, with_row_number, within_first


def seeded_order(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED,
                 by: Sequence[str] = (), name: str = "row_no",
                 total_name: str | None = None) -> DataFrame:
    """Rows numbered 1..N in seeded-shuffle order (per group of `by`)."""
    keyed = df.withColumn("_key", shuffle_key(id_col, seed))
    return with_row_number(keyed, "_key", by=by, tiebreak=[id_col], name=name,
                           total_name=total_name, hex_key=True).drop("_key")


def shuffled_head(df: DataFrame, id_col: str, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """The first n rows after a seeded shuffle (all rows if fewer); a
    top-n of the keys, then only those n rows are numbered."""
    head = df.withColumn("_key", shuffle_key(id_col, seed)).orderBy("_key", id_col).limit(n)
    return with_row_number(head, "_key", tiebreak=[id_col], hex_key=True).drop("_key")


def exact_sample(df: DataFrame, id_col: str, n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """D3: exactly n rows without replacement; fails when there are fewer
    than n, as the reference does. Only ids are ranked."""
    total = df.select(id_col).count()
    if total < n:
        raise ValueError(f"cannot sample {n} rows from {total}")
    return df.where(within_first(df, id_col, n, total, seed))


def stratified_sample(df: DataFrame, id_col: str, class_col: str, classes: Sequence[str],
                      n: int, seed: int = DEFAULT_SEED) -> DataFrame:
    """D5 + S1: exactly n rows of each listed class, stacked; fails when a
    class is absent or has fewer (Q4). One huge class is ranked by many
    tasks (bucketed row numbers of its ids)."""
    sizes = {r[0]: r["count"] for r in df.where(F.col(class_col).isin(list(classes))).groupBy(class_col).count().collect()}
    short = {c: sizes.get(c, 0) for c in classes if sizes.get(c, 0) < n}
    if short:
        raise ValueError(f"cannot sample {n} rows of each class; rows found: {short}")
    parts = [df.where((F.col(class_col) == c)) for c in classes]
    picked = [p.where(within_first(p, id_col, n, sizes[c], seed)) for p, c in zip(parts, classes, strict=True)]
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return out


def train_test_split(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED,
                     train_share: float = TRAIN_SHARE, n_rows: int | None = None) -> DataFrame:
    """Exact split by shuffled position. The first ``int(N * share)``
    rows are train, every other row is test (Q1: no row is lost, even when
    the train size is 0). ``n_rows`` keeps only the first n shuffled rows
    first, like the reference's ``n_rows`` option."""
    ordered = seeded_order(df, id_col, seed, total_name="_n")
    if n_rows is not None:
        ordered = ordered.where(F.col("row_no") <= n_rows).withColumn(
            "_n", F.least(F.col("_n"), F.lit(n_rows)))
    train_size = F.floor(F.col("_n").cast("double") * F.lit(train_share))
    return ordered.withColumn(
        "split", F.when(F.col("row_no") <= train_size, F.lit("train")).otherwise(F.lit("test"))
    ).drop("_n")


def with_split(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED, train_share: float = TRAIN_SHARE,
               n_rows: int | None = None) -> DataFrame:
    """D4 without row numbers: the same split as :func:`train_test_split`
    as a ``split`` column, from the key at the cut; wide rows (texts,
    vectors) are neither shuffled nor sorted."""
    total = df.select(id_col).count()
    kept = total if n_rows is None else min(total, n_rows)
    if kept < total:
        df = df.where(within_first(df, id_col, kept, total, seed))
    train = within_first(df, id_col, int(kept * train_share), kept, seed)
    return df.withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))


def fixed_batches(df: DataFrame, id_col: str, batch_rows: int, by: Sequence[str] = (),
                  name: str = "batch_id") -> DataFrame:
    """Evaluation batches of ``batch_rows`` rows in id order, counted
    within each group of ``by`` (so none mixes splits); integer arithmetic."""
    numbered = with_row_number(df, id_col, by=by, name="_no")
    return numbered.withColumn(name, F.expr(f"(_no - 1) div {int(batch_rows)}")).drop("_no")


def numbered_batches(df: DataFrame, order_col: str, batch_size: int,
                     name: str = "batch_no") -> DataFrame:
    """A4/E5/B2: number rows in ``order_col`` order (file order) and give
    each its 0-based batch; ``n_batches = ceil(N / batch_size)``."""
    ordered = with_row_number(df, order_col, name="row_no", total_name="_n")
    return (ordered
            .withColumn(name, F.expr(f"(row_no - 1) div {int(batch_size)}"))
            .withColumn("n_batches", F.expr(f"(_n + {int(batch_size)} - 1) div {int(batch_size)}"))
            .drop("_n"))


def pending_batches(batched: DataFrame, finished: DataFrame, batch_col: str = "batch_no") -> DataFrame:
    """Rows whose batch is not finished yet (resume)."""
    done = finished.select(batch_col).distinct()
    return batched.join(done, on=batch_col, how="left_anti")


def epoch_step(id_col: str, epoch: int, steps: int, seed: int = DEFAULT_SEED):
    """The optimisation step (0..steps-1) a row is dealt to in an epoch;
    another grouping every epoch, the same in every run."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(epoch), F.lit(seed)), F.lit(steps))
