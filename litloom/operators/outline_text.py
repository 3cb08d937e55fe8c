"""Outlines as plain text: head, sections, typed pages and figures, and the ways back to text.

A section opens at a numbered line, ``Part N`` or ``第N部分``; lines with a colon are the head's and no content, wherever
they stand, unless they mark a figure. Everything is one projection over the array of a text's lines: no line is ever a
row, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V
from litloom.operators import pages as P

MAPPING = "meta map<string,string>, sections array<struct<title:string,items:array<string>,points:array<string>,events:array<struct<date:string,title:string,description:string>>>>"


def mapping_text(body: Column) -> Column:
    """The outline of a JSON object with ``meta`` and ``sections``; any other text stays as it is."""
    none = F.array().cast("array<string>")
    m = F.from_json(body, MAPPING)
    said = lambda c: F.coalesce(c, F.lit(""))
    head = F.transform(F.map_entries(F.map_filter(m["meta"], lambda _, v: F.length(v) > 0)), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    full = lambda a: F.when(F.size(a) > 0, a)

    def section(s: Column, i: Column) -> Column:
        title = F.coalesce(F.nullif(s["title"], F.lit("")), F.concat(F.lit("Section "), (i + 1).cast("string")))
        items = F.transform(F.coalesce(full(s["items"]), full(s["points"]), none), lambda x: F.concat(F.lit("- "), said(x)))
        events = F.transform(F.coalesce(s["events"], F.from_json(F.lit("[]"), "array<struct<date:string,title:string,description:string>>")), lambda e: F.concat(F.lit("- "), said(e["date"]), F.lit(" "), said(e["title"]), F.lit(": "), said(e["description"])))
        return F.concat(F.array(F.concat((i + 1).cast("string"), F.lit(". "), title)), items, events)

    lines = F.concat(F.coalesce(head, none), F.coalesce(F.flatten(F.transform(m["sections"], section)), none))
    is_json = F.startswith(T.bare(body), F.lit("{")) & (m["meta"].isNotNull() | m["sections"].isNotNull())
    return F.when(is_json, F.array_join(lines, "\n")).otherwise(body)


def text_lines(text: Column) -> Column:
    """Lines of a text without the white space around them, line ends of any kind."""
    return F.transform(F.split(T.bare(text), T.LINE_END), T.bare)


def is_figure(line: Column) -> Column:
    return line.rlike(V.OUTLINE_FIGURE)


def is_key_value(line: Column) -> Column:
    return F.contains(line, F.lit(":")) | F.contains(line, F.lit("："))


def is_header(line: Column) -> Column:
    return line.rlike(V.OUTLINE_HEADER)


def header_title(line: Column) -> Column:
    """The title of a line that opens a section: what follows its number, the whole line if nothing does."""
    numbered = T.bare(F.regexp_extract(line, r"^[0-9]+\.\s+([^\n]+)", 1))
    part = T.bare(F.regexp_extract(line, r"^[Pp][Aa][Rr][Tt]\s+[0-9]+\s*[:\-]?\s*([^\n]*)", 1))
    return F.when(numbered != "", numbered).when(part != "", part).otherwise(line)


def figure_mark(line: Column) -> Column:
    """``struct(label, path, position)`` of a line that marks a figure."""
    return F.struct(*(T.bare(F.regexp_extract(line, V.OUTLINE_FIGURE, k + 1)).alias(n) for k, n in enumerate(("label", "path", "position"))))


def head(lines: Column, keys: Sequence[tuple[str, Sequence[str]]] = V.OUTLINE_KEYS) -> Column:
    """``struct`` of the head's fields: the value of the last line whose key names a field; a colon comes before a wide one."""
    kind = lambda p: F.struct(T.ladder(p["k"], [(words, name) for name, words in keys], "").alias("kind"), p["v"].alias("v"))
    found = F.transform(F.transform(F.filter(lines, is_key_value), _pair), kind)

    def last(kinds: Column, name: str) -> Column:
        values = F.filter(kinds, lambda p: p["kind"] == name)
        return F.coalesce(F.get(values, F.size(values) - 1)["v"], F.lit(""))

    return T.bind(found, lambda kinds: F.struct(*(last(kinds, name).alias(name) for name, _ in keys)))


def _pair(line: Column) -> Column:
    """Key (in lower case) and value of a line, parted at its first colon, or wide colon if it has no other."""
    narrow, wide = F.split(line, ":", 2), F.split(line, "：", 2)
    parts = F.when(F.contains(line, F.lit(":")), narrow).otherwise(wide)
    return F.struct(F.lower(T.bare(F.element_at(parts, 1))).alias("k"), T.bare(F.element_at(parts, 2)).alias("v"))


def sections(lines: Column) -> Column:
    """``array<struct(title, content)>``: content lines under their header, in order; what stands before the first has no section."""
    kept = F.filter(lines, lambda l: (l != "") & (is_figure(l) | ~is_key_value(l)))

    def parted(kept: Column, at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(kept))
        return F.transform(at, lambda i, k: F.struct(header_title(F.get(kept, i)).alias("title"), F.slice(kept, i + 2, end(k) - i - 1).alias("content")))

    return T.bind(kept, lambda kept: T.bind(_places(kept, lambda l: ~is_figure(l) & is_header(l)), lambda at: parted(kept, at)))


def _places(lines: Column, wanted) -> Column:
    """The places, from 0, of lines of a kind."""
    return F.filter(F.transform(lines, lambda l, i: F.when(wanted(l), i)), lambda i: i.isNotNull())


def page(title: Column, content: Column) -> Column:
    """A section's page: its type, its items without bullets, its events if it is a timeline, its figures."""
    figures = F.transform(F.filter(content, is_figure), figure_mark)

    def of(plain: Column) -> Column:
        items = F.filter(plain, lambda l: l != "")
        return T.bind(P.page_type(title, plain), lambda kind: F.struct(kind.alias("page_type"), items.alias("items"), F.when(kind == "timeline", F.transform(items, P.timeline_event)).alias("events"), figures.alias("figures")))

    return T.bind(F.transform(F.filter(content, lambda l: ~is_figure(l)), lambda l: F.regexp_replace(l, V.OUTLINE_BULLET, "")), of)


def outlines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, head, sections, warnings``: one row per text; each section with its number, title and page."""
    read = df.select(key, text_lines(mapping_text(F.col(text))).alias("_lines")).select(key, head(F.col("_lines")).alias("head"), sections(F.col("_lines")).alias("_s"))
    paged = F.transform("_s", lambda s, k: F.struct((k + 1).cast("string").alias("part_num"), s["title"].alias("title"), page(s["title"], s["content"]).alias("page")))
    blank = lambda c: c == ""
    said = F.array_compact(F.array(F.when(blank(F.col("head.title")), F.lit("Missing title")), F.when(blank(F.col("head.author")), F.lit("Missing author")), F.when(F.size("_s") == 0, F.lit("No sections detected"))))
    return read.select(key, "head", paged.alias("sections"), said.alias("warnings"))


def page_texts(items: Column, points: Column, results: Column) -> Column:
    """A page's texts as one list: its items, or else its points and its results."""
    none = F.array().cast("array<string>")
    return F.when(items.isNotNull(), items).otherwise(F.concat(F.coalesce(points, none), F.coalesce(results, none)))


def page_warnings(pages: Column, known_paths: Column) -> Column:
    """What is odd about a deck's pages: hardly any, list pages without items, figures whose path isn't among the known ones."""
    few = F.when(F.size(pages) <= 2, F.array(F.concat(F.lit("only "), F.size(pages).cast("string"), F.lit(" pages")))).otherwise(F.array().cast("array<string>"))
    number = lambda k: (k + 1).cast("string")
    empty = F.filter(F.transform(pages, lambda p, k: F.when((p["page_type"] == "content_list") & (F.coalesce(F.size(p["items"]), F.lit(0)) < 1), F.concat(F.lit("page "), number(k), F.lit(" has no items")))), lambda x: x.isNotNull())
    lost = F.flatten(F.transform(pages, lambda p, k: F.transform(F.filter(p["figures"], lambda f: (f["path"] != "") & ~F.array_contains(known_paths, f["path"])), lambda f: F.concat(F.lit("page "), number(k), F.lit(" lacks "), f["path"]))))
    return F.concat(few, empty, lost)


def tagged_outline(outline: Column, paths: Column) -> Column:
    """The text form of a Markdown outline: its head, then each ``### N.`` section with its bullets and its figures' marks.

    ``paths`` maps labels of figures to their files; references to other figures vanish, and so do bullets still to be
    filled in.
    """
    took = lambda key: T.bare(F.regexp_extract(outline, f"{key}[：:]\\s*([^\\n]+)", 1))
    named = (("文章标题", "主题"), ("汇报人", "汇报人"), ("导师", "导师"), ("汇报时间", "时间"))
    top = F.array_compact(F.array(*(F.when(took(k) != "", F.concat(F.lit(f"{shown}："), took(k))) for k, shown in named), F.lit("")))
    header = r"^###\s*[0-9]+\.\s*([^\n]+)"
    reference = r"\[([图表Fig\.]+[0-9]*)[,，]页?[0-9]+\]"

    def flushed(lines: Column, at: Column, i: Column, k: Column) -> Column:
        content = F.slice(lines, i + 2, F.coalesce(F.get(at, k + 1), F.size(lines)) - i - 1)
        bullets = F.filter(F.transform(F.filter(content, lambda l: ~l.rlike(reference) & l.rlike(r"^-\s+([^\n]+)")), lambda l: T.bare(F.regexp_extract(l, r"^-\s+([^\n]+)", 1))), lambda x: (x != "") & ~F.contains(x, F.lit("（请填写）")))
        labels = F.filter(F.flatten(F.transform(content, lambda l: F.regexp_extract_all(l, F.lit(reference), F.lit(1)))), lambda x: F.array_contains(F.map_keys(paths), x))
        marks = F.transform(labels, lambda x: F.concat(F.lit("<!-- 图: "), x, F.lit(" | path="), F.element_at(paths, x), F.lit(" | position=right -->")))
        title = T.bare(F.regexp_extract(F.get(lines, i), header, 1))
        return F.concat(F.array(F.concat(F.lit("\n"), (k + 1).cast("string"), F.lit(". "), title)), F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), marks)

    body = T.bind(F.split(outline, "\n"), lambda lines: T.bind(_places(lines, lambda l: l.rlike(header)), lambda at: F.flatten(F.transform(at, lambda i, k: flushed(lines, at, i, k)))))
    return F.array_join(F.concat(top, body), "\n")


def tag_lines(sections_: Column) -> Column:
    """A list of sections (title, items) as one text whose lines bear tags, ``[SECi]`` and ``[SiIj]``, for a translator."""
    per = F.transform(sections_, lambda s, i: F.concat(F.array(F.concat(F.format_string("[SEC%d]", i), s["title"])), F.transform(s["items"], lambda x, j: F.concat(F.format_string("[S%dI%d]", i, j), x))))
    return F.array_join(F.flatten(per), "\n")


def untagged(sections_: Column, translated: Column) -> Column:
    """Sections with the texts that tagged lines give; a tag that is missing, empty or unknown changes nothing, the last of a tag counts."""

    def found(lines: Column, tag: Column, old: Column) -> Column:
        given = F.transform(F.filter(lines, lambda l: F.startswith(l, tag) & (F.length(l) > F.length(tag))), lambda l: T.bare(F.substring(l, F.length(tag) + 1, F.length(l))))
        return F.coalesce(F.element_at(F.concat(F.array(old), given), -1), old)

    def of(lines: Column) -> Column:
        return F.transform(sections_, lambda s, i: F.struct(found(lines, F.format_string("[SEC%d]", i), s["title"]).alias("title"), F.transform(s["items"], lambda x, j: found(lines, F.format_string("[S%dI%d]", i, j), x)).alias("items")))

    return T.bind(F.transform(F.split(translated, T.LINE_END), T.bare), of)


def blocks_outline(blocks: DataFrame, key: str, most: int = 12) -> DataFrame:
    """``key, outline``: the most important blocks as numbered sections, each with its first three sentences of more than 20 characters, cut at 160."""
    from litloom.operators.blocks import top_blocks

    pieces = F.filter(F.transform(F.split("content", rf"(?<=[.!?]){T.SPACE}+"), T.bare), lambda s: F.length(s) > 20)
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("Section "), F.col("rank").cast("string")))
    lines = F.concat(F.array(F.concat(F.col("rank").cast("string"), F.lit(". "), title)), F.transform(F.slice(pieces, 1, 3), lambda s: F.concat(F.lit("- "), F.substring(s, 1, 160))))
    top = top_blocks(blocks, key, most).select(key, F.struct("rank", lines.alias("l")).alias("x"))
    return top.groupBy(key).agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"])), "\n").alias("outline"))


def text_font(length: Column, width: Column, height: Column, base: int = 16, least: int = 10, most: int = 28) -> Column:
    """A font size for a text in a box, both in hundredths of an inch: larger where lines are to spare, smaller where they lack."""
    per_line = F.greatest(F.lit(1), F.floor(width * 10 / 155))
    room = F.greatest(F.lit(1), F.floor(height / 28))
    needed = F.greatest(F.lit(1), F.ceil(length / per_line))
    grown = F.least(F.floor(F.least(base * room / needed, F.lit(base * 1.3))), F.lit(most))
    return F.when(F.coalesce(length, F.lit(0)) == 0, base).when(needed <= room, grown).otherwise(F.greatest(F.floor(base * room / needed), F.lit(least))).cast("int")


# Heights of a list's item in hundredths of an inch by font size.
ITEM_HEIGHTS = ((15, 62), (14, 57), (13, 52), (12, 47), (11, 43), (10, 39))


def list_font(n_items: Column, height: Column) -> Column:
    """``struct(font, item_height)`` of a list in a height in hundredths of an inch: the largest font whose items fit; few items spread."""
    n = F.greatest(n_items, F.lit(1))
    ideal = height / n
    font, tall = F.lit(ITEM_HEIGHTS[0][0]), F.lit(ITEM_HEIGHTS[0][1])
    for size, h in reversed(ITEM_HEIGHTS):
        font, tall = F.when(ideal >= h, size).otherwise(font), F.when(ideal >= h, h).otherwise(tall)
    return F.struct(font.cast("int").alias("font"), F.when(n <= 4, F.round(F.least(ideal * 0.85, F.lit(85.0)), 4)).otherwise(tall.cast("double")).alias("item_height"))


def title_font(title: Column, width: Column, base: int = 22, least: int = 14, most: int = 28) -> Column:
    """A title's font size in a width in hundredths of an inch."""
    n, capacity = F.length(title), F.floor(width * 28 / 1000)
    return F.when(F.coalesce(n, F.lit(0)) == 0, base).when(n <= capacity, min(base + 2, most)).when(n * 2 <= capacity * 3, base).otherwise(max(least, base - 4)).cast("int")


def previews(df: DataFrame, key: str, text: str, most: int = 5) -> DataFrame:
    """``key, num, page_type, title, n_items``: texts parsed, paginated and previewed.

    A cover, then for each section its opening page and its content, at most ``most`` items to a page (timelines and
    figures are kept whole), then an ending.
    """
    read = outlines(df, key, text)
    row = lambda kind, title, n: F.struct(kind.alias("page_type"), title.alias("title"), n.cast("int").alias("n_items"))

    def pages(s: Column) -> Column:
        p = s["page"]
        n = F.size(p["items"])
        kind = F.when(F.size(p["figures"]) > 0, F.lit("content_with_fig")).otherwise(p["page_type"])
        whole = (p["page_type"] == "timeline") | (F.size(p["figures"]) > 0) | (n <= most)
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / most).cast("int"))), lambda k: row(kind, F.when(k > 0, F.concat(s["title"], F.lit(" ("), (k + 1).cast("string"), F.lit(")"))).otherwise(s["title"]), F.least(F.lit(most), n - k * most)))
        return F.concat(F.array(row(F.lit("section"), s["title"], F.lit(0))), F.when(whole, F.array(row(kind, s["title"], n))).otherwise(many))

    body = F.flatten(F.transform("sections", pages))
    framed = F.concat(F.array(row(F.lit("cover"), F.col("head.title"), F.lit(0))), body, F.array(row(F.lit("ending"), F.lit(""), F.lit(0))))
    return read.select(key, F.posexplode(framed).alias("_n", "_p")).select(key, (F.col("_n") + 1).alias("num"), "_p.*")
