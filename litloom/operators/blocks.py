"""Paragraphs as typed, weighted blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V


def block_type(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(V.OTHER_BLOCK[0])
    for name, pattern, _ in reversed(V.BLOCK_TYPES):
        out = F.when(low.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def importance(kind: Column, c: Column) -> Column:
    """Weight in hundredths: by type, a tenth more for long blocks, at most 100."""
    base = F.lit(V.OTHER_BLOCK[1])
    for name, _, w in V.BLOCK_TYPES:
        base = F.when(kind == name, F.lit(w)).otherwise(base)
    return F.least(F.lit(100), base + F.when(F.length(c) > 600, 10).otherwise(0)).cast("int")


def block_title(c: Column) -> Column:
    return F.substring(F.regexp_replace(T.strip(F.element_at(F.split(c, "\n"), 1)), r"^\d+(\.\d+)*\s*", ""), 1, 100)


def formulas(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\$([^$]+)\$"), 1)


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, type, title, content, importance, n_formulas`` of each paragraph that isn't blank."""
    cut = df.select(key, F.posexplode(F.split(F.col(text), r"\n\s*\n")).alias("pos", "_raw")).select(key, "pos", T.strip(F.col("_raw")).alias("content")).where("content <> ''")
    typed = cut.select(key, "pos", block_type(F.col("content")).alias("type"), "content")
    return typed.select(key, "pos", "type", block_title(F.col("content")).alias("title"), "content", importance(F.col("type"), F.col("content")).alias("importance"), F.size(formulas(F.col("content"))).alias("n_formulas"))


def top_blocks(found: DataFrame, key: str, most: int = 12) -> DataFrame:
    """The weightiest blocks of each document, ties in text order."""
    w = Window.partitionBy(key).orderBy(F.desc("importance"), "pos")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def of_type(found: DataFrame, kind: str) -> DataFrame:
    """The blocks of a type."""
    return found.where(F.col("type") == kind)
