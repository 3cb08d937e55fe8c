"""Search hits: union of sources, ordered de-duplication, keyed upsert, report entries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text as T


def union_sources(sources: Sequence[DataFrame], order: str) -> DataFrame:
    """All sources in the given sequence, missing columns null; ``src_rank`` and ``pos`` keep the sequence."""
    out = None
    for k, df in enumerate(sources):
        part = df.withColumn("src_rank", F.lit(k)).withColumn("pos", F.col(order).cast("long"))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


#: Most hits that a source gives, whatever is asked for.
MOST_OF = {"wos": 10}


def chosen_sources(sources: Mapping[str, DataFrame], order: str, wanted: str = "all", limit: int | None = None, most_of: Mapping[str, int] = MOST_OF) -> DataFrame:
    """The union of all sources, or of the one wanted, the first ``limit`` hits of each; some give no more than their own limit."""
    if wanted != "all" and wanted not in sources:
        raise ValueError(f"no source {wanted}; there are {', '.join(sources)}")
    names = [n for n in sources if wanted in ("all", n)]
    most = {n: min(x for x in (limit, most_of.get(n)) if x is not None) for n in names if limit is not None or n in most_of}
    return union_sources([sources[n].orderBy(order).limit(most[n]) if n in most else sources[n] for n in names], order)


def dedupe_key() -> list[Column]:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [text("source"), text("url"), text("doi"), F.lower(T.strip(text("title")))]


def first_seen(df: DataFrame, order: str, key: Sequence[Column] | None = None) -> DataFrame:
    """The first row of each key; the result keeps ``order``, which must be unique, for a final sort.

    One aggregation with partial aggregates, so a key that holds a third of all rows costs its shuffle one row per task.
    """
    keys = [c.alias(f"_k{i}") for i, c in enumerate(key or dedupe_key())]
    keyed = df.select("*", *keys)
    firsts = keyed.groupBy(*(f"_k{i}" for i in range(len(keys)))).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.col(order)).alias("_x"))
    return firsts.select(*(F.col("_x").getField(c).alias(c) for c in df.columns))


def upsert(library: DataFrame, updates: DataFrame, key: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key at the position of its first: later rows replace earlier ones as a whole."""
    cols = [c for c in library.columns if c not in (*key, seq)]
    both = library.unionByName(updates.select(library.columns))
    last = both.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col(seq)).alias("_row"), F.min(seq).alias("position"), F.max(seq).alias("updated"))
    return last.select(*key, *(F.col(f"_row.{c}").alias(c) for c in cols), "position", "updated")


def authors_line(authors: Column, most: int = 3) -> Column:
    """The first names and ``et al.`` for more."""
    named = F.filter(authors, lambda a: a.isNotNull())
    return F.when(F.size(named) > most, F.concat(F.array_join(F.slice(named, 1, most), ", "), F.lit(" et al."))).otherwise(F.array_join(named, ", "))


def entry_markdown(rank: Column, title: Column, authors: Column, journal: Column, year: Column, abstract: Column, top: Column) -> Column:
    """One entry of a search report."""
    text = lambda c, d: F.coalesce(F.nullif(c, F.lit("")), F.lit(d))
    icon = F.when(F.coalesce(top, F.lit(False)), F.lit("* ")).otherwise(F.lit(""))
    cut = F.when(F.length(abstract) > 300, F.concat(F.substring(abstract, 1, 300), F.lit("..."))).otherwise(abstract)
    lines = [
        F.concat(F.lit("## "), rank.cast("string"), F.lit(". "), icon, text(title, "Untitled")),
        F.concat(F.lit("**Authors**: "), text(authors_line(authors), "Unknown")),
        F.concat(F.lit("**Journal**: "), text(journal, "Unknown"), F.lit(" ("), text(year, "n.d."), F.lit(")")),
        F.when(F.length(abstract) > 0, F.concat(F.lit("**Abstract**: "), cut)),
    ]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def best_of_works(df: DataFrame, order: str) -> DataFrame:
    """Beyond the keyed de-duplication: one row per DOI, or per title where there is none."""
    work = F.coalesce(F.nullif(F.lower(F.col("doi")), F.lit("")), F.nullif(F.lower(T.squeeze(F.col("title"))), F.lit("")))
    return first_seen(df.where(work.isNotNull()), order, [work])
