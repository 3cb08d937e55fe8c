"""Readers of the file forms that literature tools leave behind, and recorded answers of web services.

Nothing here calls a network: ``recorded`` replays saved answers, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from litloom.functions import text as T

PAPERS = "source string, title string, authors array<string>, year string, journal string, url string, doi string, pmid string, abstract string, mesh_terms array<string>"


def text_documents(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """``path, text``: whole files of a folder."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def binary_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """``path, content, problem``: files, and what is wrong with them: ``corrupt`` (not of their kind, or without pages), ``encrypted``; the source itself skips empty ones."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    has = lambda mark: F.contains("content", F.lit(bytearray(mark)))
    problem = F.when(F.decode(F.substring("content", 1, 5), "ISO-8859-1") != "%PDF-", "corrupt").when(has(b"/Encrypt"), "encrypted").when(has(b"/Count 0") & ~has(b"/Type /Page "), "corrupt")
    return raw.select("path", "content", problem.alias("problem"))


def wanted_documents(wanted: DataFrame, name: str, found: DataFrame) -> DataFrame:
    """Each wanted file's name with its content and problem: ``missing`` if it isn't among those found."""
    there = found.select(F.element_at(F.split("path", "/"), -1).alias(name), "content", F.coalesce("problem", F.lit("")).alias("_p"))
    both = wanted.select(name).join(there, name, "left")
    return both.select(name, "content", F.when(F.col("_p").isNull(), "missing").otherwise(F.nullif("_p", F.lit(""))).alias("problem"))


def json_library(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``papers`` of a library file; a file that is missing or corrupt gives no rows."""
    try:
        whole = spark.read.option("wholetext", True).text(path)
        read = whole.select(F.from_json("value", f"papers array<struct<{schema}>>").alias("x"))
        return read.select(F.inline("x.papers"))
    except Exception:
        return spark.createDataFrame([], schema)


def citation_lines(spark: SparkSession, path: str) -> DataFrame:
    """One citation per line that isn't blank."""
    return spark.read.text(path).select(T.strip(F.col("value")).alias("citation")).where("citation <> ''")


def pubmed_rows(xml: Column) -> Column:
    """``papers`` row of one article's XML: full journal title before the short one, the year before the first four digits of the free date."""
    one = lambda p: F.nullif(T.squeeze(F.xpath_string(xml, F.lit(p))), F.lit(""))
    last = F.xpath(xml, F.lit("//AuthorList/Author/LastName/text()"))
    fore = F.xpath(xml, F.lit("//AuthorList/Author[LastName]/ForeName/text()"))
    people = F.zip_with(last, fore, lambda l, f: T.squeeze(F.concat_ws(" ", f, l)))
    names = F.concat(people, F.xpath(xml, F.lit("//AuthorList/Author/CollectiveName/text()")))
    labelled = F.zip_with(F.xpath(xml, F.lit("//Abstract/AbstractText/@Label")), F.xpath(xml, F.lit("//Abstract/AbstractText[@Label]/text()")), lambda a, b: F.concat_ws(": ", a, T.squeeze(b)))
    plain = F.transform(F.xpath(xml, F.lit("//Abstract/AbstractText[not(@Label)]/text()")), T.squeeze)
    year = F.coalesce(one("//JournalIssue/PubDate/Year"), F.nullif(F.regexp_extract(F.coalesce(one("//JournalIssue/PubDate/MedlineDate"), F.lit("")), r"(\d{4})", 1), F.lit("")))
    pmid = one("//MedlineCitation/PMID")
    return F.struct(
        F.lit("pubmed").alias("source"),
        one("//ArticleTitle").alias("title"),
        names.alias("authors"),
        year.alias("year"),
        F.coalesce(one("//Journal/Title"), one("//Journal/ISOAbbreviation")).alias("journal"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/")).alias("url"),
        one("//ArticleIdList/ArticleId[@IdType='doi'][1]").alias("doi"),
        pmid.alias("pmid"),
        F.array_join(F.concat(labelled, plain), " ").alias("abstract"),
        F.xpath(xml, F.lit("//MeshHeading/DescriptorName/text()")).alias("mesh_terms"),
    )


def atom_rows(xml: Column) -> Column:
    """Array of ``papers`` rows of an Atom feed (namespace prefixes dropped)."""
    bare = F.regexp_replace(F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1")
    entries = F.regexp_extract_all(bare, F.lit(r"(<entry>[\s\S]*?</entry>)"), 1)
    one = lambda e, p: T.squeeze(F.xpath_string(e, F.lit(p)))
    return F.transform(entries, lambda e: F.struct(F.lit("arxiv").alias("source"), one(e, "entry/title").alias("title"), F.xpath(e, F.lit("entry/author/name/text()")).alias("authors"), F.substring(one(e, "entry/published"), 1, 4).alias("year"), one(e, "entry/id").alias("url"), one(e, "entry/summary").alias("abstract")))


def recorded(spark: SparkSession, path: str, size: int = 100, total: int = 0) -> DataFrame:
    """``key, data`` of a service's answers saved as ``<offset>.json`` pages, read through the cluster's file system; a page that is missing or broken gives no rows."""
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path)
    page = whole.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).alias("at"), F.from_json("value", "array<struct<key string, data string>>").alias("items"))
    wanted = page.where(F.col("at") != "").where((F.col("at").cast("long") % size == 0) & (F.col("at").cast("long") < max(total, 1)))
    return wanted.select(F.inline("items")).select(F.coalesce("key", F.lit("")).alias("key"), F.coalesce("data", F.lit("{}")).alias("data"))
