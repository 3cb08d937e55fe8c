"""Reports: search results, extraction results and batch summaries as Markdown, and the sheets of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import vocabulary as V

RULE = "-" * 40


def search_report(entries: DataFrame, query: str, order: str, entry: str) -> DataFrame:
    """``report``: the heading and every entry, in order, each followed by a rule. The report is one string by nature; where it is large, write ``report_lines`` instead."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, entry))), lambda x: F.concat(x[entry], F.lit(f"\n\n{RULE}"))), "\n\n")
    return entries.agg(F.concat(F.lit(f"# Search Results: {query}\n\n\n"), body).alias("report"))


def report_lines(entries: DataFrame, query: str, order: str, entry: str) -> DataFrame:
    """``place, value``: the same report as rows to be sorted by place and written as text, however many there are."""
    head = entries.sparkSession.createDataFrame([(-1, f"# Search Results: {query}\n")], "place long, value string")
    rows = entries.select(F.col(order).cast("long").alias("place"), F.concat(F.lit("\n"), F.col(entry), F.lit(f"\n\n{RULE}")).alias("value"))
    return head.unionByName(rows).orderBy("place")


def hundredths(tenths: Column) -> Column:
    """Tenths as text with two decimals, so that no rounding rule of an engine can differ."""
    t = F.coalesce(tenths, F.lit(0))
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), F.pmod(t, F.lit(10)).cast("string"), F.lit("0"))


def _or(c: Column, otherwise: str) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(otherwise))


def _names(authors: Column, between: str) -> Column:
    return F.array_join(F.coalesce(authors, F.array().cast("array<string>")), between)


def field_text(values: Column, between: str = " | ") -> Column:
    """A field's values in one string, the sentinel where there is none."""
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(values, between)).otherwise(F.lit("Not found"))


def result_markdown(metadata: Column, review: Column, core, coverage, status: Column, seconds: Column, error: Column | None = None) -> Column:
    """One extraction result as Markdown; ``core(field)`` gives an array, ``coverage(field)`` tenths, ``error`` a struct (kind, detail, suggestion)."""
    kind = F.when(review, F.lit("review")).otherwise(F.lit("research"))
    top = F.array(
        F.concat(F.lit("# Core Insights: "), _or(metadata["title"], "Unknown Title")),
        F.lit(""),
        F.lit("## Metadata"),
        F.concat(F.lit("- **Authors:** "), _or(_names(metadata["authors"], ", "), "Unknown")),
        F.concat(F.lit("- **Journal:** "), _or(metadata["journal"], "Unknown")),
        F.concat(F.lit("- **Year:** "), _or(metadata["year"], "Unknown")),
        F.concat(F.lit("- **DOI:** "), _or(metadata["doi"], "N/A")),
        F.concat(F.lit("- **Paper Type:** "), kind),
        F.concat(F.lit("- **Status:** "), F.coalesce(status, F.lit("unknown"))),
        F.concat(F.lit("- **Extraction Time:** "), F.coalesce(seconds, F.lit(0)).cast("string"), F.lit("s")),
        F.lit(""),
        F.lit("## Core Insights"),
    )

    def field(f: str) -> Column:
        values = core(f)
        shown = F.when(F.coalesce(F.size(values), F.lit(0)) > 0, F.transform(values, lambda v: F.concat(F.lit("  - "), v))).otherwise(F.array(F.lit("  - Not found")))
        return F.concat(F.array(F.lit(f"### {V.FIELD_LABELS[f][0]}")), shown, F.array(F.concat(F.lit("  - Coverage: "), hundredths(coverage(f))), F.lit("")))

    fields = F.when(review, F.concat(*(field(f) for f in V.REVIEW_KEYS))).otherwise(F.concat(*(field(f) for f in V.RESEARCH_KEYS)))
    said = F.array().cast("array<string>")
    if error is not None:
        said = F.when(status == "error", F.array(F.lit("## Error"), F.concat(F.lit("- **Kind:** "), F.coalesce(error["kind"], F.lit("unknown"))), F.concat(F.lit("- **Detail:** "), F.coalesce(error["detail"], F.lit("N/A"))), F.concat(F.lit("- **Suggestion:** "), F.coalesce(error["suggestion"], F.lit("N/A"))), F.lit(""))).otherwise(said)
    return F.concat(F.regexp_replace(F.array_join(F.concat(top, fields, said), "\n"), r"\s+$", ""), F.lit("\n"))


def summary_markdown(rank: Column, metadata: Column, review: Column, core, status: Column) -> Column:
    """The entry of one result in a batch summary; a result without a type counts as research."""
    kind = F.when(review, F.lit("review")).otherwise(F.lit("research"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("## "), rank.cast("string"), F.lit(". "), _or(metadata["title"], "Unknown Title")),
        F.concat(F.lit("- **Status:** "), F.coalesce(status, F.lit("unknown"))),
        F.concat(F.lit("- **Paper Type:** "), kind),
        F.concat(F.lit("- **Journal:** "), _or(metadata["journal"], "Unknown")),
        F.concat(F.lit("- **Year:** "), _or(metadata["year"], "Unknown")),
        *(F.concat(F.lit(f"- **{V.FIELD_LABELS[f][0]}:** "), field_text(core(f))) for f in ("research_problem", "review_scope", "methodology")),
        F.lit(""),
    )


def summary_sheet(metadata: Column, review: Column, coverage, status: Column, seconds: Column) -> list[Column]:
    """The columns of a batch's sheet: metadata, type, the coverage of all seventeen fields, status and seconds."""
    kind = F.when(review, F.lit("review")).otherwise(F.lit("research"))
    return [
        F.coalesce(metadata["title"], F.lit("")).alias("Title"),
        _names(metadata["authors"], "; ").alias("Authors"),
        F.coalesce(metadata["journal"], F.lit("")).alias("Journal"),
        F.coalesce(metadata["year"].cast("string"), F.lit("")).alias("Year"),
        kind.alias("Paper_Type"),
        *(hundredths(coverage(f)).alias(name) for f, (_, name) in V.FIELD_LABELS.items()),
        F.coalesce(status, F.lit("")).alias("Status"),
        F.coalesce(seconds, F.lit(0)).alias("Time(s)"),
    ]


def result_sheet(metadata: Column, core, coverage, status: Column, seconds: Column, keys: tuple[str, ...] = V.RESEARCH_KEYS) -> list[Column]:
    """The columns of one kind of results' sheet: metadata, the fields' values, their coverage, status and seconds."""
    title = lambda f: f.replace("_", " ").title()
    kind = "review" if keys == V.REVIEW_KEYS else "research"
    return [
        F.coalesce(metadata["title"], F.lit("")).alias("Title"),
        _names(metadata["authors"], "; ").alias("Authors"),
        F.coalesce(metadata["journal"], F.lit("")).alias("Journal"),
        F.coalesce(metadata["year"].cast("string"), F.lit("")).alias("Year"),
        F.lit(kind).alias("Paper_Type"),
        *(F.when(F.coalesce(F.size(core(f)), F.lit(0)) > 0, F.array_join(core(f), " | ")).otherwise(F.lit("")).alias(title(f)) for f in keys),
        *(hundredths(coverage(f)).alias(V.FIELD_LABELS[f][1]) for f in keys),
        F.coalesce(status, F.lit("")).alias("Status"),
        F.coalesce(seconds, F.lit(0)).alias("Time(s)"),
    ]
