"""Decks of papers: insights, metadata and figures laid out as Markdown, one string per paper.

The layout is data (a skeleton of slides with the fields each shows and what stands in for them); the Markdown is one
array expression per row, so a deck costs no shuffle beyond that of the figures, of which only the first few of a paper
are ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V
from litloom.operators import outline as O
from litloom.operators import pages as P

FIGURES = "array<struct<number:int,page:int,caption:string,image_path:string>>"
MADE_BY = "litloom"


def stated(values: Column) -> Column:
    """Values with single spaces, without empty ones and without the sentinel that means none."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), T.clean), lambda v: (v != "") & (F.lower(v) != "not found"))


def merged(*values: Column) -> Column:
    """The stated values of several fields, one after the other."""
    return F.concat(*(stated(v) for v in values))


def bullets(values: Column, fallback: str, most: int = 5, chars: int = 260) -> Column:
    """Bullet lines of the first values, shortened and emphasised; the fallback if there are none."""
    shown = T.bind(values, lambda all_: F.when(F.size(all_) > 0, F.slice(all_, 1, most)).otherwise(F.array(F.lit(fallback))))
    return F.transform(F.transform(shown, lambda v: T.shorten(v, chars)), lambda v: F.concat(F.lit("- "), T.emphasised(v, V.EMPHASIS)))


def first_figures(captions: DataFrame, key: str, number: str, page: str, caption: str, image: Column, tie: str, most: int = 6) -> DataFrame:
    """``key, figures``: the first figures of a paper by number; ranks are cut before anything is gathered."""
    w = Window.partitionBy(key).orderBy(number, tie)
    ranked = captions.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    row = F.struct("_r", F.struct(F.col(number).cast("int").alias("number"), F.col(page).cast("int").alias("page"), F.col(caption).alias("caption"), image.alias("image_path")).alias("f"))
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["f"]).alias("figures"))


def image_path(path: Column, base: str) -> Column:
    """A path as seen from the deck's folder, where it lies below it; with forward slashes."""
    slashed = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    folder = base.rstrip("/") + "/"
    return F.when(F.startswith(slashed, F.lit(folder)), F.substring(slashed, len(folder) + 1, F.length(slashed))).otherwise(slashed)


def _section(number: str, title: str) -> list[str]:
    return ["---", "layout: section", f"subtitle: {number}", "", f"# {title}", ""]


def _figure(f: Column, of: str, base: str) -> Column:
    n = F.coalesce(f["number"].cast("string"), F.lit(""))
    lines = [
        F.lit("---"),
        F.lit(""),
        F.concat(F.lit("# Figure "), n),
        F.lit(""),
        F.lit(f"- **Role**: Visual evidence extracted from the source {of}."),
        F.concat(F.lit("- **Page**: "), F.coalesce(f["page"].cast("string"), F.lit("Unknown")), F.lit(".")),
        F.concat(F.lit("- **Caption**: "), F.coalesce(F.nullif(T.shorten(T.clean(f["caption"]), 220), F.lit("")), F.lit("Caption unavailable."))),
        F.lit(""),
        F.concat(F.lit("![Figure "), n, F.lit("]("), image_path(f["image_path"], base), F.lit(")")),
        F.lit(""),
    ]
    return F.array(*lines)


def _lits(lines: Sequence[str]) -> Column:
    return F.array(*(F.lit(x) for x in lines))


def _slides(parts: Sequence[tuple], core) -> list[Column]:
    """Lines of a skeleton's parts: (number, title) opens a section, (title, fields, fallback) is a slide."""
    out = []
    for part in parts:
        if len(part) == 2:
            out.append(_lits(_section(*part)))
        else:
            title, fields, fallback, *most = part
            out += [_lits(["---", "", f"# {title}", ""]), bullets(merged(*(core(f) for f in fields)), fallback, *most), _lits([""])]
    return out


def deck_markdown(review: Column, metadata: Column, core, figures: Column, source: Column, *, theme: str, author: str, affiliation: str, date: str, base: str = "", made_by: str = MADE_BY) -> Column:
    """The deck of a paper as Markdown: the skeleton for reviews, or that for research papers.

    ``core(field)`` gives a field's array. A title that is missing is the stem of the source's name.
    """
    or_ = lambda c, d: F.coalesce(F.nullif(T.clean(c), F.lit("")), F.lit(d))
    name = F.element_at(F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/"), -1)
    title = F.coalesce(F.nullif(T.clean(metadata["title"]), F.lit("")), F.regexp_replace(name, r"(.)\.[^.]*$", "$1"))
    people = F.array_join(F.filter(F.transform(F.coalesce(metadata["authors"], F.array().cast("array<string>")), T.clean), lambda a: a != ""), ", ")
    kind = F.when(review, F.coalesce(F.get(stated(core("review_type")), F.lit(0)), F.lit("Review literature"))).otherwise(F.lit("research"))
    head = [
        _lits(["---"]),
        F.array(F.concat(F.lit("title: "), title)),
        _lits([f"author: {author}", f"affiliation: {affiliation}", f"date: {date}", f"theme: {theme}", "---", "", "# Paper Snapshot", ""]),
        F.array(
            F.concat(F.lit("- **Title**: "), title, F.lit(".")),
            F.concat(F.lit("- **Authors**: "), F.coalesce(F.nullif(people, F.lit("")), F.lit("Unknown")), F.lit(".")),
            F.concat(F.lit("- **Source**: "), or_(metadata["journal"], "Unknown"), F.lit(", "), or_(F.nullif(metadata["year"].cast("string"), F.lit("0")), "Unknown"), F.lit(".")),
            F.concat(F.lit("- **DOI**: "), or_(metadata["doi"], "N/A"), F.lit(".")),
            F.concat(F.lit("- **Paper Type**: "), kind, F.lit(".")),
        ),
        _lits([""]),
    ]
    no_lines = F.array().cast("array<string>")
    figures = F.coalesce(figures, F.array().cast(FIGURES))
    shown = lambda of: F.flatten(F.transform(figures, lambda f: _figure(f, of, base)))
    end = lambda said: F.array(F.concat(F.lit(f"- This deck was generated by **{made_by}** from `"), name, F.lit("`.")), F.lit(said), F.lit(V.DECK_CAUTION))
    research = [
        *_slides(V.RESEARCH_DECK, core),
        F.when(F.size(figures) > 0, F.concat(_lits(_section("03", "Key Figures")), shown("paper"))).otherwise(no_lines),
        *_slides(V.RESEARCH_DECK_END, core),
        _lits(["---", "", "# Take-Home Message", ""]),
        end("- The workflow integrates **paper insight extraction**, **figure extraction**, and **HTML slide rendering**."),
    ]
    tables = stated(core("key_tables_figures"))
    reviewed = [
        *_slides(V.REVIEW_DECK, core),
        F.when((F.size(tables) > 0) | (F.size(figures) > 0), _lits(_section("04", "Important Figures and Tables"))).otherwise(no_lines),
        F.when(F.size(tables) > 0, F.concat(_lits(["---", "", "# Key Tables and Figures", ""]), bullets(tables, ""), _lits([""]))).otherwise(no_lines),
        shown("review"),
        *_slides(V.REVIEW_DECK_END, core),
        _lits(["---", "", "# Take-Home Message", ""]),
        end("- The workflow detected review-literature structure and organized the deck around scope, taxonomy, evidence, controversy, and gaps."),
    ]
    body = F.when(review, F.array_join(F.concat(*head, *reviewed), "\n")).otherwise(F.array_join(F.concat(*head, *research), "\n"))
    return F.concat(T.bare(body), F.lit("\n"))


SLIDE = ("type", "title", "subtitle", "bullets", "image", "caption", "notes", "layout")
SLIDES = "slides array<struct<type:string,title:string,subtitle:string,bullets:array<string>,image:string,caption:string,notes:string,layout:string>>"
FRONT = r"^---\n(?:[^\n]*\n)*?---(?:\n|$)"


def deck_slides(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, slide_no`` and the fields of each slide of a deck in any of its forms.

    A text that begins with a brace is a deck's JSON; one with lines of three hyphens, or headings of its own, behind its
    front block is Markdown; any other is an outline, whose pages get a cover and an ending. Empty texts have no slides.
    """
    body = F.regexp_replace(T.bare(F.regexp_replace(F.col(text), r"\r\n?", "\n")), FRONT, "")
    read = df.select(key, body.alias("_t")).where("_t <> ''")
    is_json, is_markdown = F.startswith("_t", F.lit("{")), F.col("_t").rlike(r"(?m)^---[ \t]*$|^#{1,3}\s")
    json = read.where(is_json).select(key, F.posexplode(F.from_json("_t", SLIDES)["slides"]).alias("slide_no", "s")).select(key, "slide_no", *(F.col(f"s.{f}").alias(f) for f in SLIDE))
    markdown = P.slides(read.where(~is_json & is_markdown), key, "_t").select(key, "slide_no", *SLIDE)
    pages = O.outline_pages(read.where(~is_json & ~is_markdown), key, "_t")
    framed = O.framed(pages, key, "page", "title").join(pages.select(key, (F.col("page") + 1).alias("slide_no"), "items"), [key, "slide_no"], "left")
    none = F.lit(None).cast("string")
    ending = F.col("type") == "ending"
    plain = framed.select(key, (F.col("slide_no") - 1).alias("slide_no"), "type", F.when(ending, F.lit("Thank You")).otherwise(F.coalesce("title", F.lit(""))).alias("title"), F.when(ending, F.lit("Questions and discussion")).otherwise(F.lit("")).alias("subtitle"), F.coalesce("items", F.array().cast("array<string>")).alias("bullets"), none.alias("image"), none.alias("caption"), none.alias("notes"), none.alias("layout"))
    return json.unionByName(markdown).unionByName(plain)
