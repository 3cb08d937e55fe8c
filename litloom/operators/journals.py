"""Journal metrics: one dimension from two sources, joined to papers by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions.text import normalised_name
from litloom.plans.lineage import hinted

ABSENT = "N/A"


def normalised_metrics(df: DataFrame) -> DataFrame:
    """The rich schema from either schema: absent values ``N/A``, flags derived from the name where none is given."""
    have = set(df.columns)
    pick = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in have), F.lit(ABSENT))
    name = F.lower("name")
    forced = name.isin("nature", "science") | F.contains(name, F.lit("advanced materials"))
    flag = F.coalesce(F.col("is_top_journal"), F.lit(False)) if "is_top_journal" in have else F.lit(False)
    return df.select(
        "name",
        pick("jcr_partition", "JCR").alias("jcr_partition"),
        pick("impact_factor", "IF").alias("impact_factor"),
        pick("five_year_if").alias("five_year_if"),
        pick("chinese_partition", "Partition").alias("chinese_partition"),
        pick("category").alias("category"),
        pick("publisher", "Publisher").alias("publisher"),
        (flag | forced).alias("is_top_journal"),
        pick("notes").alias("notes"),
    )


def overlay(base: DataFrame, over: DataFrame, key: str = "name") -> DataFrame:
    """Rows of ``over``, and those of ``base`` whose key it lacks: a row is replaced as a whole."""
    return over.unionByName(base.join(over.select(key), key, "left_anti"), allowMissingColumns=True)


def with_metrics(papers: DataFrame, metrics: DataFrame, abbreviations: DataFrame, journal: Column, order: str = "journal_id") -> DataFrame:
    """Papers with their journal's metrics: by exact name, else normalised name, else abbreviation; never by substring.

    Of names that normalise alike the first in ``order`` counts. The dimension is hinted for broadcast behind a count.
    """
    first = lambda df, k: df.withColumn("_r", F.row_number().over(Window.partitionBy(k).orderBy(order))).where("_r = 1").drop("_r")
    fields = F.struct(*[F.col(c) for c in metrics.columns])
    by_name = first(metrics.select(F.col("name").alias("_name"), order, fields.alias("_exact")), "_name").drop(order)
    by_norm = first(metrics.select(normalised_name(F.col("name")).alias("_norm"), order, fields.alias("_similar")), "_norm").drop(order)
    short = abbreviations.select(normalised_name(F.col("abbrev")).alias("_norm2"), F.col("full_name").alias("name"))
    by_short = first(short.join(metrics, "name").select("_norm2", order, fields.alias("_short")), "_norm2").drop(order)
    p = papers.withColumn("_name", journal).withColumn("_norm", F.nullif(normalised_name(journal), F.lit(""))).withColumn("_norm2", F.nullif(normalised_name(journal), F.lit("")))
    found = p.join(hinted(by_name), "_name", "left").join(hinted(by_norm), "_norm", "left").join(hinted(by_short), "_norm2", "left")
    how = F.when(F.col("_exact").isNotNull(), "name").when(F.col("_similar").isNotNull(), "normalised").when(F.col("_short").isNotNull(), "abbreviation").otherwise("none")
    return found.select(*papers.columns, how.alias("matched_by"), F.coalesce("_exact", "_similar", "_short").alias("metrics"))
