"""Reference library: children, titles that resemble each other, item lines, imports."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def has_children(items: DataFrame, children: DataFrame, key: str, present: bool = True) -> DataFrame:
    """Items with (or without) a child: a semi (or anti) join, children need not be unique."""
    return items.join(children, key, "left_semi" if present else "left_anti")


def flag_children(items: DataFrame, children: DataFrame, key: str, flag: str) -> DataFrame:
    """Items with a flag telling whether they have a child: both parts in one pass."""
    some = children.select(key).distinct().withColumn("_has", F.lit(True))
    return items.join(some, key, "left").select(*items.columns, F.col("_has").isNotNull().alias(flag))


def status_counts(df: DataFrame, status: Column) -> DataFrame:
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two strings as matched blocks: not symmetric, and not an edit distance. Null for null."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of the ratio from the lengths alone, to spare the function hopeless pairs."""
    return 2 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))


def creators_line(names: Column, most: int = 3) -> Column:
    """Last names of the first creators and ``et al.``; a name that is missing shows as ``?``."""
    last = F.transform(F.slice(names, 1, most), lambda n: F.coalesce(F.nullif(F.element_at(F.split(F.trim(n), " "), -1), F.lit("")), F.lit("?")))
    return F.concat(F.array_join(last, ", "), F.when(F.size(names) > most, F.lit(" et al.")).otherwise(F.lit("")))


def leading_year(date: Column) -> Column:
    return F.nullif(F.regexp_extract(date, r"^(\d{4})", 1), F.lit(""))


def attachment_name(title: Column) -> Column:
    """A file name from a title: 60 characters, those that file systems refuse replaced."""
    return F.concat(F.regexp_replace(F.substring(title, 1, 60), r'[\\/:*?"<>|]', "_"), F.lit(".pdf"))


def cache_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, 12)


def isbn(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^0-9X]", "")


def split_name(name: Column) -> Column:
    """``struct(last, first)`` of a name written family name first, parted at its first space."""
    parts = F.split(F.coalesce(name, F.lit("")), " ", 2)
    return F.struct(F.element_at(parts, 1).alias("last"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("first"))


def item_line(key: Column, names: Column, date: Column, title: Column, kind: Column) -> Column:
    """An item in one line: its key, creators, year, title and type."""
    or_ = lambda c, d: F.coalesce(c, F.lit(d))
    return F.concat(F.lit("["), or_(key, "?"), F.lit("] "), or_(creators_line(names), ""), F.lit(" ("), or_(leading_year(date), ""), F.lit(") "), or_(title, "untitled"), F.lit(" ["), or_(kind, "?"), F.lit("]"))


SUMMARY = "title string, fulljournalname string, volume string, issue string, pages string, pubdate string, articleids array<struct<idtype string, value string>>, authors array<struct<name string, authtype string>>"


def summary_item(body: Column) -> Column:
    """A library item from a summary's JSON: names split at their first space, only those marked as authors; the last identifier of a type counts."""
    w = F.from_json(body, SUMMARY)
    text = lambda c: F.coalesce(c, F.lit(""))
    dois = F.transform(F.filter(w["articleids"], lambda i: i["idtype"] == "doi"), lambda i: i["value"])
    people = F.transform(F.filter(F.coalesce(w["authors"], F.from_json(F.lit("[]"), "array<struct<name string, authtype string>>")), lambda a: a["authtype"] == "Author"), lambda a: F.struct(F.lit("author").alias("creatorType"), split_name(a["name"])["last"].alias("lastName"), split_name(a["name"])["first"].alias("firstName")))
    return F.struct(F.lit("journalArticle").alias("itemType"), text(w["title"]).alias("title"), people.alias("creators"), text(w["pubdate"]).alias("date"), text(F.get(dois, F.size(dois) - 1)).alias("DOI"), text(w["fulljournalname"]).alias("publicationTitle"), text(w["volume"]).alias("volume"), text(w["issue"]).alias("issue"), text(w["pages"]).alias("pages"))


NOT_WORKS = ("attachment", "note")


def without_doi(items: DataFrame, doi: str, kind: str) -> DataFrame:
    """Items that are works and lack a DOI."""
    return items.where((F.coalesce(F.col(doi), F.lit("")) == "") & ~F.coalesce(F.col(kind), F.lit("")).isin(*NOT_WORKS))


def checked_citations(citations: DataFrame, citation: str, resolved: str, library: DataFrame, title: str, order: str, least: float = 0.6) -> DataFrame:
    """Citations with ``in_library`` and the library's row ``_item``: the resolved title resembles the citation and is, case aside, a title of the library, whose last row of that title counts.

    An equi join on the title; the ratio is asked only of citations that have a resolved title, once each. A citation
    without one, or with a title that the library lacks, is missing.
    """
    last = library.groupBy(F.lower(F.coalesce(F.col(title), F.lit(""))).alias("_t")).agg(F.max_by(F.struct(*library.columns), F.col(order)).alias("_item"))
    low = F.lower(F.coalesce(F.col(resolved), F.lit("")))
    asked = citations.withColumn("_t", F.when(ratio_bound(F.lower(citation), low) > least, low)).join(last, "_t", "left")
    ok = F.col("_item").isNotNull() & (ratio(F.when(F.col("_item").isNotNull(), F.lower(citation)), F.col("_t")) > least)
    flagged = asked.withColumn("in_library", F.coalesce(ok, F.lit(False)))
    return flagged.select(*citations.columns, "in_library", F.when(F.col("in_library"), F.col("_item")).alias("_item"))


def completed_dois(items: DataFrame, title: str, doi: str, kind: str, candidate_title: str, candidate_doi: str, least: float = 0.85) -> DataFrame:
    """Works without a DOI and the DOI of their candidate, if that has one and its title resembles theirs, case aside."""
    works = without_doi(items, doi, kind).where(F.length(title) > 0).where(F.length(candidate_doi) > 0)
    a, b = F.lower(title), F.lower(F.coalesce(F.col(candidate_title), F.lit("")))
    return works.where(ratio_bound(a, b) > least).withColumn("_r", ratio(a, b)).where(F.col("_r") > least).withColumn("found_doi", F.col(candidate_doi)).drop("_r")


WORK = "DOI string, title array<string>, `container-title` array<string>, volume string, issue string, page string, ISSN array<string>, author array<struct<given string, family string>>, issued struct<`date-parts` array<array<int>>>"


def work_item(body: Column) -> Column:
    """A library item from a work's JSON message."""
    w = F.from_json(body, WORK)
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(""))
    date = F.array_join(F.transform(F.get(w["issued"]["date-parts"], F.lit(0)), lambda x: x.cast("string")), "-")
    people = F.transform(w["author"], lambda a: F.struct(F.lit("author").alias("creatorType"), F.coalesce(a["given"], F.lit("")).alias("firstName"), F.coalesce(a["family"], F.lit("")).alias("lastName")))
    return F.struct(F.lit("journalArticle").alias("itemType"), first(w["title"]).alias("title"), people.alias("creators"), F.coalesce(date, F.lit("")).alias("date"), F.coalesce(w["DOI"], F.lit("")).alias("DOI"), first(w["container-title"]).alias("publicationTitle"), F.coalesce(w["volume"], F.lit("")).alias("volume"), F.coalesce(w["issue"], F.lit("")).alias("issue"), F.coalesce(w["page"], F.lit("")).alias("pages"), first(w["ISSN"]).alias("ISSN"))


def found_items(items: DataFrame, needle: str, columns: Sequence[str], order: str, most: int = 25) -> DataFrame:
    """The first items that hold the needle, attachments and notes included."""
    from litloom.operators.pages import searched

    return searched(items, columns, needle).orderBy(order).limit(most)


def item_of(items: DataFrame, key: str, wanted: str) -> DataFrame:
    """The item of a key as JSON."""
    return items.where(F.col(key) == wanted).select(F.to_json(F.struct(*items.columns)).alias("item"))


def collection_line(key: Column, name: Column, n: Column) -> Column:
    return F.concat(F.lit("["), F.coalesce(key, F.lit("?")), F.lit("] "), F.coalesce(name, F.lit("untitled")), F.lit(" ("), F.coalesce(n, F.lit(0)).cast("string"), F.lit(" items)"))


def child_line(key: Column, kind: Column, title: Column, file_name: Column) -> Column:
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.lit("["), F.coalesce(key, F.lit("?")), F.lit("] "), F.coalesce(kind, F.lit("?")), F.lit(": "), F.coalesce(some(title), some(file_name), F.lit("untitled")))


def tags_of(items: DataFrame, tags: str) -> DataFrame:
    """The different tags of all items."""
    return items.select(F.explode(tags).alias("tag")).where("tag is not null").distinct()
