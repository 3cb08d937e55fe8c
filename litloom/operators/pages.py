"""Typed pages of a presentation: classification, items, placeholders, fitting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V


def page_type(title: Column, lines: Column, timeline: Sequence[str] = V.TIMELINE, detail: Sequence[str] = V.DETAIL) -> Column:
    """``timeline`` by its words or a year in a line, else ``content_detail`` by its words, else ``content_list``."""
    joined = F.lower(F.concat_ws(" ", title, F.array_join(lines, " ")))
    dated = F.exists(lines, lambda l: l.rlike(r"(?<![A-Za-z0-9_])20\d{2}(?![A-Za-z0-9_])"))
    return F.when(T.contains_any(joined, timeline) | dated, F.lit("timeline")).when(T.contains_any(joined, detail), F.lit("content_detail")).otherwise(F.lit("content_list"))


def slide_type(title: Column, image: Column, layout: Column) -> Column:
    """A slide's type: its layout if that names one, else by image, title of an ending or of a summary."""
    low = F.lower(title)
    return F.when(layout.isin(*V.LAYOUTS), layout).when(F.length(image) > 0, F.lit("figure")).when(low.isin(*V.ENDINGS), F.lit("ending")).when(T.contains_any(low, V.SUMMARIES), F.lit("summary")).otherwise(F.lit("content"))


def timeline_event(line: Column) -> Column:
    """``struct(date, title, description)``: what stands before a colon or hyphen, and the rest; its first 20 characters as title."""
    date = F.regexp_extract(line, r"^(\S+)\s*[:\-]\s*(.+)", 1)
    rest = F.regexp_extract(line, r"^(\S+)\s*[:\-]\s*(.+)", 2)
    text = F.when(rest != "", rest).otherwise(line)
    return F.struct(date.alias("date"), F.substring(text, 1, 20).alias("title"), text.alias("description"))


def first_long_line(text: Column, least: int = 11) -> Column:
    """The first stripped line of some length: a paper's title, for want of better."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), T.bare), lambda l: F.length(l) >= least), F.lit(0))


def figure_caption(text: Column, number: Column) -> Column:
    """The 5 to 80 characters after the mention of a figure's number in a page; the pattern depends on the row."""
    pattern = F.concat(F.lit(r"(?i)(?:Figure|Fig\.?)\s*"), number.cast("string"), F.lit(r"[\.:]?\s*([^\n]{5,80})"))
    other = F.concat(F.lit(r"图\s*"), number.cast("string"), F.lit(r"[\.：]?\s*([^\n]{5,80})"))
    first = F.nullif(F.regexp_extract_all(text, pattern, F.lit(1)), F.array().cast("array<string>"))
    return T.strip(F.coalesce(F.get(first, F.lit(0)), F.get(F.regexp_extract_all(text, other, F.lit(1)), F.lit(0))))


def present_sections(text: Column, sections: Sequence[tuple[str, str]] = V.PRESENT) -> Column:
    """Labels of the sections whose words stand anywhere in a text, in order; empty if it has no structure."""
    return F.array_compact(F.array(*(F.when(text.rlike(f"(?i){T.word(p)}"), F.lit(label)) for label, p in sections)))


def outline_items(snippet: Column, most: int = 8, least: int = 20, chars: int = 120) -> Column:
    """Sentences fit for an outline: long enough, no references or captions, cut at ``chars``."""
    kept = F.filter(F.transform(F.split(snippet, rf"(?<=[.。!！?？]){T.SPACE}+"), T.bare), lambda s: (F.length(s) >= least) & ~s.rlike(r"^\[?\d+[\].,]") & ~s.rlike(r"(?i)^(Fig|Figure|Table|Scheme)\s*\d+"))
    return F.slice(F.transform(kept, lambda s: F.when(F.length(s) > chars, F.concat(F.substring(s, 1, chars), F.lit("..."))).otherwise(s)), 1, most)


def fitted_font(lengths: Column, height: float, width: float, largest: int = 22, smallest: int = 9) -> Column:
    """The largest font size at which texts of the given lengths fit a height, else the smallest.

    Heights are summed in whole hundred-thousandths of an inch, so that the order of summation can't matter.
    """
    room = int(round(height * 100_000))

    def needed(size: Column) -> Column:
        per_line = F.greatest(F.lit(1), F.floor(F.lit((width - 0.18) * 72) / (size * 0.58)))
        line = F.round(size / 72 * 1.28 * 100_000)
        return F.aggregate(lengths, F.lit(0).cast("double"), lambda s, n: s + line * F.greatest(F.lit(1), F.ceil(n / per_line)) + 6_000)

    sizes = F.sequence(F.lit(largest), F.lit(smallest + 1), F.lit(-1))
    return F.coalesce(F.get(F.filter(sizes, lambda f: needed(f) <= room), F.lit(0)), F.lit(smallest))


def with_placeholders(template: Column, values: dict[str, Column]) -> Column:
    for name, v in values.items():
        template = F.replace(template, F.lit(name), F.coalesce(v, F.lit("")))
    return template


def tagged_items(df: DataFrame, key: str, sections: str) -> DataFrame:
    """``key, tag, text`` of titles and items of an outline (``[SECi]``, ``[SiIj]``), to be joined back by tag."""
    secs = df.select(key, F.posexplode(sections).alias("i", "s"))
    titles = secs.select(key, F.format_string("[SEC%d]", "i").alias("tag"), F.col("s.title").alias("text"))
    items = secs.select(key, "i", F.posexplode("s.items").alias("j", "text")).select(key, F.format_string("[S%dI%d]", "i", "j").alias("tag"), "text")
    return titles.unionByName(items)


def preview(pages: DataFrame, key: str, order: str, title: str, items: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return pages.select(key, n.alias("num"), F.coalesce(F.col(title), F.lit("")).alias("title"), F.coalesce(F.size(items), F.lit(0)).alias("n_items"))


def searched(df: DataFrame, columns: Sequence[str], needle: str) -> DataFrame:
    """Rows one of whose columns (arrays included) holds the needle, whatever its case."""
    types = dict(df.dtypes)
    whole = F.concat_ws(" ", *(F.array_join(c, " ") if types[c].startswith("array") else F.col(c) for c in columns))
    return df.where(F.contains(F.lower(whole), F.lit(needle.lower())))


def known_and_rest(body: Column, known: Sequence[str]) -> tuple[Column, Column]:
    """A JSON object's known keys as a map, and all others as another, so that nothing is lost on the way back."""
    m = F.from_json(body, "map<string,string>")
    return F.map_filter(m, lambda k, _: k.isin(*known)), F.map_filter(m, lambda k, _: ~k.isin(*known))


# The syntax of slides in Markdown.
DIRECTIVE = r"(?i)^\s*(layout|type|title|subtitle|author|affiliation|date|theme)\s*:"
IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"
NOTES = r"(?:^|\n)[ \t]*:::notes[ \t]*\n([\s\S]*?)(?:\n[ \t]*:::[ \t]*(?=\n|$)|$)"
HEAD = r"^(#{1,6})\s+(.+)$"
POINT = r"^\s*(?:[-*•]|\d+[.)])\s+(.+)$"


def slides(df: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """Slides of a Markdown deck whose blocks are parted by ``---`` lines.

    Leading ``key: value`` lines are directives; the first heading is the title if no directive gives one; the last image
    counts; fenced notes are set apart; plain lines fill up the bullets to ``most``.
    """
    whole = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    cut = df.select(key, F.posexplode(F.split(whole, r"(?m)^---[ \t]*$\n?")).alias("slide_no", "_block"))
    ls = F.split(F.col("_block"), "\n")
    content = F.array_position(F.transform(ls, lambda l: (T.strip(l) != "") & ~l.rlike(DIRECTIVE)), True)
    ahead = F.when(content > 0, content.cast("int") - 1).otherwise(F.size(ls))
    said = F.filter(F.slice(ls, 1, ahead), lambda l: l.rlike(DIRECTIVE))
    pairs = F.transform(said, lambda l: F.struct(F.lower(T.strip(F.regexp_extract(l, "^([^:]+):", 1))).alias("k"), F.regexp_replace(T.strip(F.regexp_extract(l, "^[^:]+:(.*)$", 1)), "^[\"']+|[\"']+$", "").alias("v")))
    body = F.array_join(F.slice(ls, ahead + 1, F.greatest(F.size(ls), F.lit(1))), "\n")
    parts = cut.select(key, "slide_no", pairs.alias("_d"), body.alias("_body")).where((F.size("_d") > 0) | (T.strip(F.col("_body")) != ""))
    given = lambda name: F.filter("_d", lambda p: p["k"] == name)
    directive = lambda name: F.coalesce(F.get(given(name), F.size(given(name)) - 1)["v"], F.lit(""))
    rest = F.split(F.regexp_replace("_body", NOTES, "\n"), "\n")
    shown = parts.select(key, "slide_no", *(directive(n).alias(f"_{n}") for n in ("title", "subtitle", "layout", "type")), rest.alias("_rest"), F.array_join(F.regexp_extract_all("_body", F.lit(NOTES), F.lit(1)), "\n").alias("notes"))
    plain = shown.withColumn("_lines", F.filter("_rest", lambda l: ~l.rlike(IMAGE) & (T.strip(l) != "")))
    at = F.when(F.col("_title") == "", F.array_position(F.transform("_lines", lambda l: l.rlike(HEAD)), True)).otherwise(0)
    titled = plain.withColumn("_at", at).withColumn("title", F.when(F.col("_at") > 0, T.strip(F.regexp_extract(F.get("_lines", F.col("_at").cast("int") - 1), HEAD, 2))).otherwise(F.col("_title")))
    others = F.filter("_lines", lambda l, i: i + 1 != F.col("_at"))
    bullets = F.transform(F.filter(others, lambda l: l.rlike(POINT)), lambda l: T.strip(F.regexp_extract(l, POINT, 1)))
    paras = F.transform(F.filter(others, lambda l: ~l.rlike(POINT) & ~l.rlike(r"^\s*<!--")), T.strip)
    pics = F.transform(F.filter("_rest", lambda l: l.rlike(IMAGE)), lambda l: F.struct(T.strip(F.regexp_extract(l, IMAGE, 2)).alias("path"), T.strip(F.regexp_extract(l, IMAGE, 1)).alias("caption")))
    filled = titled.withColumn("_b", bullets).withColumn("_p", paras).withColumn("_pic", F.get(pics, F.size(pics) - 1))
    room = F.greatest(F.lit(0), F.lit(most) - F.size("_b"))
    image = F.col("_pic.path")
    kind = F.when(F.col("_type") != "", F.col("_type")).otherwise(slide_type(F.col("title"), F.coalesce(image, F.lit("")), F.col("_layout")))
    return filled.select(key, "slide_no", kind.alias("type"), "title", F.col("_subtitle").alias("subtitle"), F.concat("_b", F.slice("_p", F.lit(1), room)).alias("bullets"), image.alias("image"), F.coalesce(F.col("_pic.caption"), F.lit("")).alias("caption"), "notes", F.col("_layout").alias("layout"))


def image_refs(text: Column) -> Column:
    """``map`` of the labels of a text's images to their paths; the last path of a label counts."""
    named = F.zip_with(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(1)), F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2)), lambda k, v: F.struct(T.strip(k).alias("k"), T.strip(v).alias("v")))
    from litloom.operators.outline import last_of_each

    return F.map_from_entries(last_of_each(named))


def missing_figures(text: Column) -> Column:
    """References ``[图N,页P]`` to figures that no image of the text gives, as ``struct(label, page)``."""
    have = F.map_keys(image_refs(text))
    labels = F.regexp_extract_all(text, F.lit(r"\[([图表Fig.]+\d*)[,，]页?(\d+)\]"), F.lit(1))
    pages = F.regexp_extract_all(text, F.lit(r"\[([图表Fig.]+\d*)[,，]页?(\d+)\]"), F.lit(2))
    both = F.zip_with(labels, pages, lambda l, p: F.struct(l.alias("label"), p.cast("int").alias("page")))
    return T.bind(have, lambda known: F.filter(both, lambda r: ~F.array_contains(known, r["label"])))


def relative_path(path: Column, base: str) -> Column:
    """A path as seen from a folder it lies in; others are left as they are."""
    folder = base.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(folder)), F.substring(path, len(folder) + 1, F.length(path))).otherwise(path)
