"""Outlines and decks: lines to sections, pagination, framing, warnings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V

# Lines that open a section, and bullets.
SECTION_LINE = r"^(?:\d+[.、．]\s*|#{1,3}\s+|[一二三四五六七八九十]+、)(\S.*)$"
BULLET = r"^\s*(?:[-*•·]|\(\d+\)|（\d+）)\s+"

# The keys of a deck's head, in two languages.
META_KEYS: Mapping[str, tuple[str, ...]] = {
    "title": ("title", "主题", "题目", "标题"),
    "author": ("author", "presenter", "作者", "汇报人", "姓名"),
    "affiliation": ("affiliation", "organization", "单位", "机构"),
    "advisor": ("advisor", "supervisor", "导师"),
    "date": ("date", "time", "日期", "时间"),
}


MOTIF_STEPS = tuple((words, label) for label, words in V.MOTIFS)


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line`` of every line, line ends of any kind."""
    return df.select(key, F.posexplode(F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")).alias("line_no", "line"))


def carried(df: DataFrame, key: str, order: str, heading: Column, name: str = "section") -> DataFrame:
    """Each row with the last heading at or before it; null before the first."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(heading, ignorenulls=True).over(w))


def section_title(line: Column) -> Column:
    """The title of a section's line, else null."""
    return F.nullif(T.strip(F.regexp_extract(line, SECTION_LINE, 1)), F.lit(""))


def bullet_text(line: Column) -> Column:
    """A bullet's text, else null."""
    return F.when(line.rlike(BULLET), T.strip(F.regexp_replace(line, BULLET, "")))


def chunks(items: DataFrame, key: Sequence[str], order: str, item: str, most: int = 5) -> DataFrame:
    """``key, chunk, items``: at most ``most`` items of a key together, in order."""
    w = Window.partitionBy(*key).orderBy(order)
    placed = items.withColumn("_pos", F.row_number().over(w) - 1).withColumn("chunk", F.floor(F.col("_pos") / most).cast("int"))
    packed = placed.groupBy(*key, "chunk").agg(F.array_sort(F.collect_list(F.struct("_pos", F.col(item).alias("x")))).alias("_a"))
    return packed.select(*key, "chunk", F.transform("_a", lambda a: a["x"]).alias("items"))


def outline_pages(df: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """Content pages of an outline: bullets under their section, ``most`` to a page, pages numbered, titles past the first suffixed."""
    ls = carried(lines(df, key, text), key, "line_no", section_title(F.col("line")))
    bullets = ls.withColumn("item", bullet_text(F.col("line"))).where("item is not null and section is not null")
    first = bullets.groupBy(key, "section").agg(F.min("line_no").alias("_at"))
    pages = chunks(bullets, [key, "section"], "line_no", "item", most).join(first, [key, "section"])
    w = Window.partitionBy(key).orderBy("_at", "section", "chunk")
    title = F.when(F.col("chunk") > 0, F.concat(F.col("section"), F.lit(" ("), (F.col("chunk") + 1).cast("string"), F.lit(")"))).otherwise(F.col("section"))
    return pages.select(key, F.row_number().over(w).alias("page"), title.alias("title"), "items")


def table_of_contents(pages: DataFrame, key: str, title: str, order: str) -> DataFrame:
    """``key, toc``: the different titles in order of first appearance, where there is more than one."""
    firsts = pages.groupBy(key, title).agg(F.min(order).alias("_at"))
    toc = firsts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(title).alias("t")))).alias("_a"))
    return toc.select(key, F.transform("_a", lambda a: a["t"]).alias("toc")).where(F.size("toc") > 1)


def framed(pages: DataFrame, key: str, order: str, title: str) -> DataFrame:
    """A cover before, and an ending after, the pages of each deck; ``slide_no`` numbers all."""
    decks = pages.select(key).distinct()
    body = pages.select(key, F.lit(1).alias("_part"), F.col(order).cast("long").alias("_at"), F.lit("content").alias("type"), F.col(title).alias("title"))
    cover = decks.select(key, F.lit(0).alias("_part"), F.lit(0).cast("long").alias("_at"), F.lit("cover").alias("type"), F.lit(None).cast("string").alias("title"))
    ending = decks.select(key, F.lit(2).alias("_part"), F.lit(0).cast("long").alias("_at"), F.lit("ending").alias("type"), F.lit(None).cast("string").alias("title"))
    w = Window.partitionBy(key).orderBy("_part", "_at")
    return cover.unionByName(body).unionByName(ending).select(key, F.row_number().over(w).alias("slide_no"), "type", "title")


def without_repeats(df: DataFrame, key: str, order: str, title: Column, header: Column) -> DataFrame:
    """Rows without a section that has been there and the row that follows it."""
    seen = Window.partitionBy(key, title).orderBy(order)
    row = Window.partitionBy(key).orderBy(order)
    marked = df.withColumn("_again", header & (F.row_number().over(seen) > 1))
    return marked.withColumn("_after", F.coalesce(F.lag("_again").over(row), F.lit(False)) & ~header).where(~F.col("_again") & ~F.col("_after")).drop("_again", "_after")


def meta(df: DataFrame, key: str, text: str, keys: Mapping[str, Sequence[str]] = META_KEYS, first_lines: int = 20) -> DataFrame:
    """``key`` and a column per head field: the value of the last of the first lines whose key names the field."""
    ls = lines(df, key, text).where((F.col("line_no") < first_lines) & F.col("line").rlike("^[^:：]{1,20}[:：]"))
    name = F.lower(T.strip(F.regexp_extract("line", "^([^:：]{1,20})[:：]", 1)))
    value = T.strip(F.regexp_extract("line", "^[^:：]{1,20}[:：](.*)$", 1))
    kind = T.ladder(name, [(words, field) for field, words in keys.items()], "")
    tagged = ls.select(key, "line_no", kind.alias("_kind"), value.alias("_value")).where("_kind <> ''")
    picked = tagged.groupBy(key).agg(*(F.max_by(F.when(F.col("_kind") == f, F.col("_value")), F.when(F.col("_kind") == f, F.col("line_no"))).alias(f) for f in keys))
    return df.select(key).distinct().join(picked, key, "left")


def last_of_each(pairs: Column) -> Column:
    """Of pairs ``struct(k, v)`` the last one of each key."""
    return T.bind(pairs, lambda all_: F.filter(all_, lambda p, i: ~F.exists(F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1))), lambda q: q["k"] == p["k"])))


def frontmatter(text: Column) -> Column:
    """``map<string,string>`` of the block between ``---`` lines at the beginning; the last value of a key counts."""
    block = F.regexp_extract(F.regexp_replace(text, r"\r\n?", "\n"), r"^---\n((?:[^\n]*\n)*?)---(?:\n|$)", 1)
    rows = F.filter(F.split(block, "\n"), lambda l: l.rlike("^[^:]+:"))
    pairs = F.transform(rows, lambda l: F.struct(F.lower(T.strip(F.regexp_extract(l, "^([^:]+):", 1))).alias("k"), T.strip(F.regexp_extract(l, "^[^:]+:(.*)$", 1)).alias("v")))
    return F.map_from_entries(last_of_each(pairs))


def with_inline(front: Column, inline: Column) -> Column:
    """A deck's head: the values of its inline lines, those of its block between ``---`` lines before them."""
    return F.map_concat(F.map_filter(inline, lambda k, _: ~F.map_contains_key(front, k)), front)


def inline_head(text: Column, keys: Mapping[str, Sequence[str]] = META_KEYS, first_lines: int = 20) -> Column:
    """``map`` of the fields that the first lines name by an exact key; the last line of a field counts."""
    pattern = "^([^:：]*)[:：]([^\\n]*)$"
    rows = F.transform(F.slice(F.split(text, T.LINE_END), 1, first_lines), T.bare)
    name = lambda l: F.lower(T.bare(F.regexp_extract(l, pattern, 1)))
    field = F.lit(None).cast("string")
    known = [(w, f) for f, words in keys.items() for w in words]

    def of(l: Column) -> Column:
        out = field
        for w, f in known:
            out = F.when(name(l) == w, F.lit(f)).otherwise(out)
        return out

    pairs = F.filter(F.transform(rows, lambda l: F.struct(of(l).alias("k"), T.bare(F.regexp_extract(l, pattern, 2)).alias("v"))), lambda p: p["k"].isNotNull())
    return F.map_from_entries(last_of_each(pairs))


def warnings(title: Column, author: Column, n_sections: Column) -> Column:
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    return F.array_compact(F.array(F.when(blank(title), F.lit("missing title")), F.when(blank(author), F.lit("missing author")), F.when(F.coalesce(n_sections, F.lit(0)) == 0, F.lit("missing sections"))))


def title_fit(title: Column, subtitle: Column | None = None) -> Column:
    weight = T.width_hundredths(F.coalesce(title, F.lit("")), V.WIDTHS)
    if subtitle is not None:
        weight = F.greatest(weight, (T.width_hundredths(F.coalesce(subtitle, F.lit("")), V.WIDTHS) * 6 / 10).cast("int"))
    out = F.lit("title-fit-normal")
    for least, label in reversed(V.TITLE_FITS):
        out = F.when(weight >= least, F.lit(label)).otherwise(out)
    return out


def motif(title: Column, body: Column, subtitle: Column | None = None) -> Column:
    """The motif that the title and subtitle call for, else the whole text, else the general one."""
    top = title if subtitle is None else F.concat_ws(" ", title, subtitle)
    in_title = T.ladder(F.lower(top), MOTIF_STEPS, "")
    return F.coalesce(F.nullif(in_title, F.lit("")), T.ladder(F.lower(F.concat_ws(" ", top, body)), MOTIF_STEPS, "motif-general"))


def density(n_bullets: Column) -> Column:
    return F.when(n_bullets.between(1, 3), F.lit("is-sparse")).when(n_bullets >= 5, F.lit("is-dense")).otherwise(F.lit("is-balanced"))


def proportional_section(page: Column, n_pages: Column, n_sections: Column) -> Column:
    """The section a page falls to when pages are spread evenly over sections."""
    return F.least(F.floor(page * n_sections / n_pages), n_sections - 1).cast("int")


def nav_window(sections: Column, current: Column, size: int = 5) -> Column:
    """``size`` sections around the current one (from 0), moved to stay inside the list."""
    start = F.greatest(F.lit(1), F.least(current - F.lit(size // 2) + 1, F.size(sections) - size + 1))
    return F.slice(sections, start, size)
