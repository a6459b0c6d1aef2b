"""Row cleaning and the WikiHow subset / prompt jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articlelab.functions import text as T
from articlelab.operators.keys import DEFAULT_SEED, with_row_number
from articlelab.session import materialize
from articlelab.operators.sampling import exact_sample

WIKIHOW_COLUMNS = ("title", "headline", "sectionLabel", "text")
WIKIHOW_SAMPLE = 200_000


def drop_null_text(df: DataFrame, col: str = "text") -> DataFrame:
    """C5."""
    return df.na.drop(subset=[col])


def drop_blank_text(df: DataFrame, col: str = "text") -> DataFrame:
    """Keep rows whose text has a non-space character."""
    return df.where(~T.is_blank(col))


def with_literal(df: DataFrame, col: str, value) -> DataFrame:
    """Overwrite a column with a literal."""
    return df.withColumn(col, F.lit(value))


def as_strings(df: DataFrame, *cols: str) -> DataFrame:
    """C9."""
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


def clean_articles(df: DataFrame, literal_type: str | None = None) -> DataFrame:
    """C5 + C6 (+ C8, C9): the article clean-up of the batched encoders."""
    out = drop_blank_text(drop_null_text(as_strings(df, "type", "text")))
    return with_literal(out, "type", literal_type) if literal_type is not None else out


def wikihow_clean(df: DataFrame, order_col: str = "doc_id") -> DataFrame:
    """P1 without the sample: C5 drop null text, D6 row number after the
    drop (0-based, Q3), G1 title cleaning, G2 word count, C7 >= 40 words,
    G3 length label, C3 drop text. ``order_col`` is the file order."""
    # the text is counted at the scan, once; only the narrow rows are written and numbered
    kept = (drop_null_text(df.select(order_col, *WIKIHOW_COLUMNS))
            .withColumn("title", T.clean_title("title"))
            .withColumn("word_count", T.word_count("text")).drop("text"))
    numbered = with_row_number(materialize(kept, "wikihow-rows"), order_col, name="_rn")
    return (numbered
            .withColumn("original_row_number", F.col("_rn") - 1)
            .where(F.col("word_count") >= T.MIN_WORDS)
            .withColumn("length", T.length_label("word_count"))
            .drop("word_count", "_rn"))


def wikihow_subset(df: DataFrame, n_rows: int = WIKIHOW_SAMPLE, seed: int = DEFAULT_SEED,
                   order_col: str = "doc_id") -> DataFrame:
    """Cleaned WikiHow rows, exactly ``n_rows`` of them by seeded
    sample (the job fails if fewer rows qualify)."""
    # the cleaned rows carry no text; they are written once and read by the count, the ranking and the sample
    return exact_sample(materialize(wikihow_clean(df, order_col), "wikihow"), order_col, n_rows, seed)


def with_prompts(df: DataFrame) -> DataFrame:
    """Add the ``query`` prompt column."""
    return df.withColumn("query", T.prompt("title", "length", "headline", "sectionLabel"))
