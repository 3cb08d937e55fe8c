"""Slides as HTML, by type, and whole decks as pages.

A slide is one expression over its columns. A deck's slides are gathered to one page per deck, which is as large as the
deck; a page's template is filled in a single pass, so that text which looks like a placeholder stays text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.operators import outline as O

TEMPLATE = '<!doctype html>\n<html lang="en">\n<head><meta charset="utf-8"><title>__TITLE__</title><meta name="author" content="__AUTHOR__">__STYLE_BLOCK__</head>\n<body data-slides="__SLIDE_COUNT__">\n<main>\n__SLIDES__\n</main>\n__SCRIPT_BLOCK__\n</body>\n</html>\n'
STYLE = "body{font-family:sans-serif;margin:0}.slide{min-height:100vh;padding:4rem;box-sizing:border-box}.text-highlight{font-weight:bold;color:#1b4f8f}.notes{display:none}\n"
SCRIPT = "document.addEventListener('keydown',e=>{const s=[...document.querySelectorAll('.slide')];const at=s.findIndex(x=>x.getBoundingClientRect().top>-9);const to=e.key==='ArrowRight'?at+1:e.key==='ArrowLeft'?at-1:at;if(s[to])s[to].scrollIntoView()});\n"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _esc(c: Column) -> Column:
    return T.html_escaped(_text(c))


def _or(c: Column, otherwise: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(otherwise))


def bullet_list(items: Column) -> Column:
    """An ordered list with marked-up items; '' for none, and a plain class for at most two."""
    plain = F.when(F.size(items) <= 2, F.lit(" bullet-list-plain")).otherwise(F.lit(""))
    shown = F.array_join(F.transform(items, lambda b: F.concat(F.lit("<li>"), T.inline_markup(_text(b)), F.lit("</li>"))), "")
    return F.when(F.size(items) < 1, F.lit("")).otherwise(F.concat(F.lit('<ol class="bullet-list'), plain, F.lit('">'), shown, F.lit("</ol>")))


def _header(label: str, title: Column) -> Column:
    return F.concat(F.lit(f'<div class="slide-header"><p>{label}</p><h2>'), title, F.lit("</h2></div>"))


def image_source(image: Column, prefix: str = "assets/") -> Column:
    """Where a page finds an image: addresses stay, files are those copied to the assets."""
    name = F.element_at(F.split(F.replace(image, F.lit("\\"), F.lit("/")), "/"), -1)
    return F.when(image.rlike("^(?:https?://|data:)"), image).otherwise(F.concat(F.lit(f"{prefix}figures/"), name))


def _meta(label: str, v: Column) -> Column:
    return F.when(F.length(v) > 0, F.concat(F.lit(f"<div><span>{label}</span><strong>"), _esc(v), F.lit("</strong></div>"))).otherwise(F.lit(""))


def _cover(s: Column, deck: Column, prefix: str) -> Column:
    about = F.concat(_meta("Presenter", deck["author"]), _meta("Affiliation", F.coalesce(F.nullif(_text(s["subtitle"]), F.lit("")), deck["affiliation"])), _meta("Date", deck["date"]))
    shown = F.when(about != "", F.concat(F.lit('<div class="cover-meta">'), about, F.lit("</div>"))).otherwise(F.lit(""))
    return F.concat(F.lit('<div class="cover-shell"><p class="eyebrow">Academic Presentation</p><h1>'), _esc(s["title"]), F.lit('</h1><p class="subtitle">'), _esc(s["subtitle"]), F.lit("</p>"), shown, F.lit("</div>"))


def _toc(s: Column, deck: Column, prefix: str) -> Column:
    number = lambda i: F.lpad((i + 1).cast("string"), F.greatest(F.lit(2), F.length((i + 1).cast("string"))), F.lit("0"))
    items = F.array_join(F.transform(_items(s), lambda b, i: F.concat(F.lit("<li><span>"), number(i), F.lit("</span>"), _esc(b), F.lit("</li>"))), "")
    return F.concat(_header("Outline", T.html_escaped(_or(s["title"], "Outline"))), F.lit('<ol class="toc-list">'), items, F.lit("</ol>"))


def _section(s: Column, deck: Column, prefix: str) -> Column:
    return F.concat(F.lit('<div class="section-shell"><p>'), _esc(s["subtitle"]), F.lit("</p><h2>"), _esc(s["title"]), F.lit("</h2></div>"))


def _figure(s: Column, deck: Column, prefix: str) -> Column:
    alt = F.coalesce(F.nullif(s["caption"], F.lit("")), s["title"])
    picture = F.concat(F.lit('<figure><img src="'), T.html_escaped(image_source(s["image"], prefix)), F.lit('" alt="'), _esc(alt), F.lit('"><figcaption>'), T.inline_markup(_text(s["caption"])), F.lit("</figcaption></figure>"))
    return F.concat(_header("Figure", T.inline_markup(_text(s["title"]))), F.lit('<div class="figure-grid"><div class="figure-copy">'), bullet_list(_items(s)), F.lit("</div>"), F.when(F.length(s["image"]) > 0, picture).otherwise(F.lit("")), F.lit("</div>"))


def _split(s: Column, deck: Column, prefix: str) -> Column:
    items = _items(s)
    half = F.greatest(F.lit(1), F.floor(F.size(items) / 2).cast("int"))
    return F.concat(_header("Comparison", _esc(s["title"])), F.lit('<div class="split-grid"><div>'), bullet_list(F.slice(items, F.lit(1), half)), F.lit("</div><div>"), bullet_list(F.slice(items, half + 1, F.greatest(F.size(items), F.lit(1)))), F.lit("</div></div>"))


def _summary(s: Column, deck: Column, prefix: str) -> Column:
    return F.concat(_header("Summary", T.inline_markup(_or(s["title"], "Summary"))), F.lit('<div class="summary-card">'), bullet_list(_items(s)), F.lit("</div>"))


def _ending(s: Column, deck: Column, prefix: str) -> Column:
    return F.concat(F.lit('<div class="ending-shell"><h2>'), T.html_escaped(_or(s["title"], "Thank You")), F.lit("</h2><p>"), T.html_escaped(_or(s["subtitle"], "Questions and discussion")), F.lit("</p></div>"))


def _content(s: Column, deck: Column, prefix: str) -> Column:
    return F.concat(_header("Key Points", T.inline_markup(_text(s["title"]))), F.lit('<div class="content-card">'), bullet_list(_items(s)), F.lit("</div>"))


def _items(s: Column) -> Column:
    return F.coalesce(s["bullets"], F.array().cast("array<string>"))


#: The registry of slide bodies by type; others may be added. A type that isn't here is shown as content.
BODIES: dict[str, Callable[[Column, Column, str], Column]] = {"cover": _cover, "toc": _toc, "section": _section, "figure": _figure, "split": _split, "summary": _summary, "ending": _ending}


def slide_html(s: Column, index: Column, deck: Column, prefix: str = "assets/", bodies: Mapping[str, Callable[[Column, Column, str], Column]] = BODIES) -> Column:
    """A slide ``struct(type, title, subtitle, bullets, image, caption, notes, layout)`` of a deck ``struct(author, affiliation, date)``."""
    n = F.size(_items(s))
    density = F.when((n > 0) & (n <= 3), F.lit("is-sparse")).when(n >= 5, F.lit("is-dense")).otherwise(F.lit("is-balanced"))
    title, subtitle = _text(s["title"]), _text(s["subtitle"])
    layout = F.when(F.length(s["layout"]) > 0, F.concat(F.lit(" layout-"), _esc(s["layout"]))).otherwise(F.lit(""))
    classes = F.concat(F.lit("slide slide-"), _esc(s["type"]), F.lit(" "), density, F.lit(" items-"), n.cast("string"), F.lit(" "), O.title_fit(title, subtitle), F.lit(" "), O.motif(title, F.array_join(_items(s), " "), subtitle), layout)
    body = _content(s, deck, prefix)
    for kind, of in bodies.items():
        body = F.when(s["type"] == kind, of(s, deck, prefix)).otherwise(body)
    notes = F.when(F.length(s["notes"]) > 0, F.concat(F.lit('<aside class="notes">'), _esc(s["notes"]), F.lit("</aside>"))).otherwise(F.lit(""))
    return F.concat(F.lit('<section class="'), classes, F.lit('" data-slide="'), index.cast("string"), F.lit('" data-type="'), _esc(s["type"]), F.lit('">\n'), body, F.lit("\n"), notes, F.lit("\n</section>"))


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with its ``__NAME__`` tokens replaced in one pass: the template is cut at its tokens before any value is put in."""
    import re

    parts = re.split("(" + "|".join(map(re.escape, values)) + ")", template)
    return F.concat(*(_text(values[p]) if p in values else F.lit(p) for p in parts if p))


def deck_pages(slides: DataFrame, key: str, order: str, deck: Column, embed: bool = False, template: str = TEMPLATE) -> DataFrame:
    """``key, index_html, deck_json``: one page per deck; ``deck`` is a struct (title, author, affiliation, date) equal in all its slides."""
    fields = ("type", "title", "subtitle", "bullets", "image", "caption", "notes", "layout")
    decks = slides.groupBy(key).agg(F.any_value(deck).alias("_deck"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), F.struct(*fields).alias("s")))).alias("_s"))
    html = F.array_join(F.transform("_s", lambda x, i: slide_html(x["s"], i + 1, F.col("_deck"))), "\n")
    style, script = (f"<style>\n{STYLE}\n</style>", f"<script>\n{SCRIPT}\n</script>") if embed else ('<link rel="stylesheet" href="assets/style.css">', '<script src="assets/deck.js"></script>')
    page = filled(template, {"__TITLE__": _esc(F.col("_deck.title")), "__AUTHOR__": _esc(F.col("_deck.author")), "__SLIDE_COUNT__": F.size("_s").cast("string"), "__STYLE_BLOCK__": F.lit(style), "__SLIDES__": html, "__SCRIPT_BLOCK__": F.lit(script)})
    json = F.to_json(F.struct("_deck.*", F.transform("_s", lambda x: x["s"]).alias("slides")))
    return decks.select(key, page.alias("index_html"), json.alias("deck_json"))
