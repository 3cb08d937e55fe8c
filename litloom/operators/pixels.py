"""Pixels of pages and figures as arrays: crops, borders, colour, white columns, grids, sizes of components.

An image is three columns: ``content`` (bytes, row by row, three bytes a pixel), ``height`` and ``width``. Kernels are
numpy over Arrow batches, one image at a time in memory; decisions over their measures are plain columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

# Types as objects: a type written as text would need a session when the module is imported.
IMAGE = StructType([StructField("content", BinaryType()), StructField("height", IntegerType()), StructField("width", IntegerType())])


def _array(content: bytes | None, height, width) -> np.ndarray:
    if content is None or pd.isna(height) or pd.isna(width) or height * width * 3 != len(content):
        return np.zeros((0, 0, 3), np.uint8)
    return np.frombuffer(content, np.uint8).reshape(int(height), int(width), 3)


def _frame(images: list[np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame({"content": [i.tobytes() for i in images], "height": [i.shape[0] for i in images], "width": [i.shape[1] for i in images]}).astype({"height": "int32", "width": "int32"})


@F.pandas_udf(IMAGE)
def trimmed(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """An image without its white border (mean of the colours from 250 on), two pixels left around; as it was if hardly anything would remain."""
    out = []
    for image in map(_array, content, height, width):
        mask = image.mean(2) < 250 if image.size else np.zeros((0, 0), bool)
        rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if len(rows):
            cut = image[max(0, rows[0] - 2) : rows[-1] + 3, max(0, cols[0] - 2) : cols[-1] + 3]
            image = cut if cut.size > image.size * 0.01 else image
        out.append(image)
    return _frame(out)


@F.pandas_udf(IMAGE)
def cropped(content: pd.Series, height: pd.Series, width: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.DataFrame:
    """The part of an image within a pixel box, moved inside the image; empty if nothing is left of it."""
    out = []
    for c, h, w, *box in zip(content, height, width, x0, y0, x1, y1):
        image = _array(c, h, w)
        a, b, d, e = (0 if pd.isna(v) else int(v) for v in box)
        out.append(np.ascontiguousarray(image[max(0, b) : max(0, min(image.shape[0], e)), max(0, a) : max(0, min(image.shape[1], d))]))
    return _frame(out)


@F.pandas_udf(DoubleType())
def colour_share(content: pd.Series, height: pd.Series, width: pd.Series, least: pd.Series) -> pd.Series:
    """The share of pixels whose saturation (0 to 255) exceeds the least; 0 for an empty image."""
    out = []
    for c, h, w, s in zip(content, height, width, least):
        image = _array(c, h, w).astype(np.int32)
        top = image.max(2) if image.size else np.zeros((0, 0))
        saturation = np.rint((top - image.min(2)) * 255 / np.maximum(top, 1)) if image.size else top
        out.append(float((saturation > s).mean()) if image.size else 0.0)
    return pd.Series(out, dtype="float64")


def has_colour(content: Column, height: Column, width: Column, saturation: int = 30, share: float = 0.03, least: int = 5) -> Column:
    """Whether a region is coloured: images of less than ``least`` pixels on a side are not. A crop is asked with a saturation of 40."""
    return (height >= least) & (width >= least) & (colour_share(content, height, width, F.lit(saturation)) > share)


@F.pandas_udf(ArrayType(DoubleType()))
def white_columns(content: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """The share of white (above 245) in each pixel column of the middle seven tenths of a page's height."""
    out = []
    for image in map(_array, content, height, width):
        h = image.shape[0]
        grey = (image @ np.array([0.299, 0.587, 0.114]))[int(h * 0.15) : int(h * 0.85)] if image.size else np.zeros((0, 0))
        out.append(list((grey > 245).mean(0)) if grey.size else [])
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def grid_score(content: pd.Series, height: pd.Series, width: pd.Series, splits: pd.Series, rows: pd.Series) -> pd.Series:
    """How white an image is where ``splits`` gaps would divide it evenly, into rows or columns; a half where nothing is divided."""
    out = []
    for c, h, w, n, by_rows in zip(content, height, width, splits, rows):
        image = _array(c, h, w)
        grey = image @ np.array([0.299, 0.587, 0.114]) if image.size else np.zeros((0, 0))
        grey = grey if by_rows else grey.T
        at = [(k + 1) * grey.shape[0] // (n + 1) for k in range(n)]
        out.append(0.5 if not n else float(np.mean([(grey[max(0, p - 5) : p + 5] > 240).mean() for p in at])) if grey.size else 0.0)
    return pd.Series(out, dtype="float64")


def component_statistics(components: DataFrame, key: Sequence[str], width: str = "image_width", height: str = "image_height") -> DataFrame:
    """``key, n, text_ratio, variation, elongated`` of an image's components (``area, w, h``): the share of those small as letters, the deviation of areas over their mean plus one, whether one spans three tenths."""
    page = F.col(width) * F.col(height)
    small = (F.col("area") < page * 0.0008) & (F.col("h") < F.col(height) * 0.035)
    long = (F.col("w") > F.col(width) * 0.3) | (F.col("h") > F.col(height) * 0.3)
    return components.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(small.cast("double")).alias("text_ratio"), (F.stddev_pop("area") / (F.avg("area") + 1)).alias("variation"), F.max(long).alias("elongated"))


def is_figure(colour: Column, lines: Column, n: Column, text_ratio: Column, variation: Column, elongated: Column) -> Column:
    """Whether a crop shows a figure: by colour (more than 0.03), long lines (more than 0.002 of its area), components of many sizes, a long one, or too few small as letters."""
    return F.when((colour > 0.03) | (lines > 0.002), True).when(F.coalesce(n, F.lit(0)) < 1, False).when((n > 5) & (variation > 3.0), True).when(elongated, True).otherwise(text_ratio <= 0.9)


def content_blobs(components: DataFrame, share: float = 0.05, side: float = 0.1, width: str = "image_width", height: str = "image_height") -> DataFrame:
    """Components that may be parts of a figure: of some area and more than a tenth of each side."""
    return components.where((F.col("area") >= share * F.col(width) * F.col(height)) & (F.col("w") > side * F.col(width)) & (F.col("h") > side * F.col(height)))


def subfigure_way(read: Column, blobs: Column, labels: Column) -> Column:
    """How to part a figure with the given labels: by letters read (two at least, and half of the labels), by blobs if they are as many as the labels, else by a grid; by labels alone where there are none."""
    n = F.size(labels)
    return F.when((F.size(read) >= 2) & (F.size(read) >= F.greatest(F.lit(2), F.floor(n / 2))), F.lit("letters")).when((n > 0) & (F.size(blobs) == n), F.lit("components")).when(n > 0, F.lit("grid")).otherwise(F.lit("labels"))
