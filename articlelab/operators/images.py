"""Vector -> image features.

An image is ``STRUCT<height INT, width INT, pixels ARRAY<DOUBLE>>`` (row
major, 0..255 before normalisation, Q17). All maths runs in Spark's
higher-order functions on the executors; the resize uses the separable
identity ``resize(v v^T) = (Rv)(Rv)^T`` so a 4,096-wide vector is never
expanded to 16.7 M pixels before resizing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articlelab.functions.vectors import IMAGE_SIDE, min_max_scale, normalise, outer_image, resample_linear


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def with_image(df: DataFrame, vec: str, dim: int, resize: bool = True, side: int = IMAGE_SIDE,
               out: str = "image") -> DataFrame:
    """H3 + H4 (+ H5): min-max scale, outer product x 255, optionally
    resized to ``side x side``. A constant vector gives a null image (Q15).
    Each step is its own column, so no array is recomputed inside the
    outer product's nested lambdas."""
    h = side if resize else dim
    staged = (df.withColumn("_lo", F.array_min(vec)).withColumn("_hi", F.array_max(vec))
                .withColumn("_u", min_max_scale(vec, "_lo", "_hi")))
    if resize:
        staged = staged.withColumn("_u", resample_linear("_u", dim, side))
    img = F.when(F.col("_u").isNotNull(), F.struct(
        F.lit(h).alias("height"), F.lit(h).alias("width"), outer_image("_u").alias("pixels")))
    return staged.withColumn(out, img).drop("_lo", "_hi", "_u")


def normalised_image(img) -> Column:
    """H6: pixels mapped to ``(x/255 - 0.5) / 0.5`` (range -1..1)."""
    img = _c(img)
    return F.when(img.isNotNull(), F.struct(img["height"].alias("height"), img["width"].alias("width"),
                                            normalise(img["pixels"]).alias("pixels")))


def diagonal(pixels, side: int) -> Column:
    """Pixels (i, i) of a row-major square image."""
    p = _c(pixels)
    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.element_at(p, i * side + i + 1))


def image_table(features: DataFrame, dim: int, resize: bool = True, side: int = IMAGE_SIDE,
                vec: str = "features") -> DataFrame:
    """M12/B5 input: ``features`` -> ``image`` column, everything else kept."""
    return with_image(features, vec, dim, resize, side).drop(vec)


def write_image_table(images: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Pixel table partitioned by split and label (one folder per
    class, like the class-per-directory image tree)."""
    (images.write.mode(mode).partitionBy("split", "label").parquet(path))


# Luma of red, green and blue, in parts of 65,536.
LUMA = (19595, 38470, 7471)


def read_image_folder(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """PNG/JPEG folder tree ``<root>/<class>/<file>`` -> ``(images,
    quarantine)``. Label = index of the class folder name in sorted order;
    grayscale pixels normalised like the reference (``(x/255 - 0.5)/0.5``).
    Undecodable files go to the quarantine with their path; their folder
    still counts as a class."""
    from articlelab.operators.labels import apply_class_map, class_map
    imgs = spark.read.format("image").option("recursiveFileLookup", True).load(root)
    rows = imgs.select(F.col("image.origin").alias("origin"),
                       F.regexp_extract("image.origin", r"/([^/]+)/[^/]+$", 1).alias("class_name"),
                       F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                       F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    # only names are read for the classes: no image is decoded for them
    named = spark.read.format("image").option("recursiveFileLookup", True).load(root).select("_metadata.file_path")
    labels = class_map(named.select(F.regexp_extract("file_path", r"/([^/]+)/[^/]+$", 1).alias("class_name")), "class_name", "label")

    @F.pandas_udf("array<double>")
    def gray(data: pd.Series, channels: pd.Series) -> pd.Series:
        out = []
        for raw, n in zip(data, channels, strict=True):
            x = np.frombuffer(raw, np.uint8).reshape(-1, n).astype(np.int64)
            # Spark stores blue, green, red (, alpha)
            y = x[:, 0] if n == 1 else (LUMA[0] * x[:, 2] + LUMA[1] * x[:, 1] + LUMA[2] * x[:, 0] + 32768) >> 16
            out.append(y.astype(np.float64))
        return pd.Series(out)

    good = rows.where("height > 0").select("origin", "class_name", "height", "width",
                                           gray("data", "channels").alias("_g"))
    good = good.select("origin", "class_name", "height", "width", normalise("_g").alias("pixels"))
    return apply_class_map(good, labels, "class_name"), rows.where("height <= 0").select("origin", "class_name")


def folder_split(df: DataFrame, path_col: str) -> DataFrame:
    """``split`` by the folder names in a path column: ``train`` where a
    folder's name contains train, ``test`` where one contains test, other rows
    left out; fails when either side has no file."""
    folders = F.regexp_extract(F.col(path_col), r"^(.*)/[^/]*$", 1)
    side = F.when(folders.contains("train"), F.lit("train")).when(folders.contains("test"), F.lit("test"))
    out = df.withColumn("split", side).where(F.col("split").isNotNull())
    found = {r["split"] for r in out.select("split").distinct().collect()}
    if found != {"train", "test"}:
        raise ValueError(f"files found only under {sorted(found) or 'neither'} of a train and a test folder")
    return out
