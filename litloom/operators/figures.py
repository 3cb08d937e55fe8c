"""Captions, positioned words and boxes of figures.

Boxes are structs ``x0, y0, x1, y1`` of doubles, y growing downwards. What needs sequential state (growing boxes, anchors,
greedy claims) runs per page in Arrow batches; pages are small by nature. The rest is plain columns and windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import vocabulary as V


def caption_kind(text: Column, patterns: Sequence[tuple[str, str]] = V.CAPTIONS) -> Column:
    """``struct(number, type)`` of the first pattern that a line begins with; null if none does."""
    out = F.lit(None).cast("struct<number:int,type:string>")
    for pattern, kind in reversed(patterns):
        n = F.regexp_extract(text, pattern, 1)
        out = F.when(n != "", F.struct(n.cast("int").alias("number"), F.lit(kind).alias("type"))).otherwise(out)
    return out


def longest_per_key(df: DataFrame, key: Sequence[str], text: str, order: Sequence[str]) -> DataFrame:
    """The row with the longest text of each key; of equal lengths the first in ``order``.

    One aggregation with partial aggregates rather than a window, so a hot key never sits in one task.
    """
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct((-F.coalesce(F.length(text), F.lit(-1))).alias("_len"), *order))
    return df.groupBy(*key).agg(best.alias("_x")).select(*key, *(F.col(f"_x.{c}").alias(c) for c in rest))


def consecutive_labels(labels: Column, least: int = 2) -> Column:
    """The run ``a, b, c, …`` without a gap that labels begin with; empty if shorter than ``least``."""
    sorted_labels = F.array_sort(F.array_distinct(F.transform(labels, F.lower)))
    run = F.filter(sorted_labels, lambda x, i: x == F.char(F.lit(97) + i))
    whole = F.filter(run, lambda x, i: x == F.char(F.lit(97) + i))
    return F.when(F.size(whole) >= least, whole).otherwise(F.array().cast("array<string>"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(lit(high), c))


def refined(b: Column, page_width: float, page_height: float, margin: float = 5.0) -> Column:
    """A box grown by a margin within its page."""
    return F.struct(clamp(b["x0"] - margin, 0.0, page_width).alias("x0"), clamp(b["y0"] - margin, 0.0, page_height).alias("y0"), clamp(b["x1"] + margin, 0.0, page_width).alias("x1"), clamp(b["y1"] + margin, 0.0, page_height).alias("y1"))


def to_pixels(c: Column, dpi: int) -> Column:
    """Points to pixels, towards zero."""
    return (c * dpi / 72).cast("int")


def to_points(c: Column, dpi: int) -> Column:
    return c * 72 / dpi


def above_score(caption: Column, image: Column, page_width: float, page_height: float, slack: float = 5.0, confidence: Column | None = None, within: tuple[float, float] | None = None) -> Column:
    """How well a box fits a caption below it; null if it starts below the caption or lies outside the caption's column.

    Four tenths each for the part of the caption's width it spans and for nearness within three tenths of the page's
    height; the rest for the alignment of centres, shared with the box's own confidence where there is one.
    """
    span = F.greatest(F.lit(0.0), F.least(caption["x1"], image["x1"]) - F.greatest(caption["x0"], image["x0"]))
    overlap = F.when(width(caption) > 0, span / width(caption)).otherwise(0.0)
    near = F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), caption["y0"] - image["y1"]) / (page_height * 0.3))
    middle = (image["x0"] + image["x1"]) / 2
    aligned = F.greatest(F.lit(0.0), 1 - 2 * F.abs(middle - (caption["x0"] + caption["x1"]) / 2) / page_width)
    rest = 0.2 * aligned if confidence is None else 0.1 * aligned + 0.1 * confidence
    fits = image["y0"] <= caption["y0"] + slack
    if within is not None:
        fits = fits & middle.between(*within)
    return F.when(fits, F.round(0.4 * overlap + 0.4 * near + rest, 6))


def best_above(captions: DataFrame, images: DataFrame, page: Sequence[str], caption_id: str, image_id: str, page_width: float, page_height: float, least: float = 0.3, other: bool = False, slack: float = 5.0, confidence: str | None = None, column: tuple[float, float] | None = None) -> DataFrame:
    """Each caption with the image (or, with a confidence, the region) of its page that scores best, if above ``least``: an equi join on the page, then the top one.

    With ``column``, only boxes count whose middle lies in the caption's column.
    """
    both = captions.join(images, list(page))
    if other:
        both = both.where(F.col(caption_id) != F.col(image_id))
    score = above_score(F.col("caption_box"), F.col("image_box"), page_width, page_height, slack, F.col(confidence) if confidence else None, column)
    pairs = both.withColumn("score", score).where(F.col("score") > least)
    top = pairs.groupBy(*page, caption_id).agg(F.min_by(F.struct(image_id, "score"), F.struct((-F.col("score")).alias("a"), F.col(image_id).alias("b"))).alias("_x"))
    return top.select(*page, caption_id, f"_x.{image_id}", "_x.score")


def padded_union(images: DataFrame, page: Sequence[str], box: str, page_width: float, page_height: float, share: float = 0.05, pad: float = 15.0) -> DataFrame:
    """``page, x0, y0, x1, y1, n_boxes``: one box around a page's images, those of no size left out, padded and kept on the page."""
    b = F.col(box)
    some = images.where((width(b) > page_width * share) & (height(b) > page_height * share))
    u = group_box(some, page, box)
    return u.select(*page, F.greatest(F.lit(0.0), F.col("x0") - pad).alias("x0"), F.greatest(F.lit(0.0), F.col("y0") - pad).alias("y0"), F.least(F.lit(page_width), F.col("x1") + pad).alias("x1"), F.least(F.lit(page_height), F.col("y1") + pad).alias("y1"), "n_boxes")


def by_number(captions: DataFrame, number: str = "number", kind: str = "figure_type", *ties: str) -> DataFrame:
    """Captions by number, then type."""
    return captions.orderBy(number, kind, *ties)


def by_confidence(regions: DataFrame, confidence: str, *ties: str) -> DataFrame:
    """Regions by confidence, the surest first."""
    return regions.orderBy(F.col(confidence).desc(), *ties)


def large_unclaimed(images: DataFrame, claimed: DataFrame, key: Sequence[str], box: str, page_width: float, page_height: float, least: float = 0.02) -> DataFrame:
    """Images of at least a share of the page that no caption has claimed yet: a filter and an anti join."""
    return images.where(area(F.col(box)) >= least * page_width * page_height).join(claimed.select(*key), list(key), "left_anti")


def of_number(figures: DataFrame, key: Sequence[str], number: str, wanted: int, order: str) -> DataFrame:
    """The first figure of a number in each paper, without its picture."""
    rest = [c for c in figures.columns if c not in (*key, "image")]
    first = figures.where(F.col(number) == wanted).groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_x"))
    return first.select(*key, *(F.col(f"_x.{c}").alias(c) for c in rest))


def labels_of(*found: Column) -> Column:
    """The lower-cased labels that several patterns found, each once, sorted: a union of sets."""
    out = F.array().cast("array<string>")
    for c in found:
        out = F.array_union(out, F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower))
    return F.array_sort(out)


def best_per_letter(found: DataFrame, key: Sequence[str], letter: str, confidence: str, order: str, least: float = 35.0) -> DataFrame:
    """Of each letter the surest reading above the least confidence; of equal ones the first."""
    rest = [c for c in found.columns if c not in (*key, letter)]
    some = found.where(F.col(confidence) > least)
    top = some.groupBy(*key, letter).agg(F.min_by(F.struct(*rest), F.struct((-F.col(confidence)).alias("a"), F.col(order).alias("b"))).alias("_x"))
    return top.select(*key, letter, *(F.col(f"_x.{c}").alias(c) for c in rest))


def column_of(x: Column, bounds: Sequence[tuple[float, float]]) -> Column:
    """The first column that holds a position, else 0."""
    out = F.lit(0)
    for k, (a, b) in reversed(list(enumerate(bounds))):
        out = F.when((x >= a) & (x <= b), k).otherwise(out)
    return out


def first_cell(points: DataFrame, cells: DataFrame, page: Sequence[str], point_id: str, cell_id: str) -> DataFrame:
    """Each point with the first cell of its page that contains it."""
    inside = (F.col("x") >= F.col("cell.x0")) & (F.col("x") <= F.col("cell.x1")) & (F.col("y") >= F.col("cell.y0")) & (F.col("y") <= F.col("cell.y1"))
    return points.join(cells, list(page)).where(inside).groupBy(*page, point_id).agg(F.min(cell_id).alias(cell_id))


def group_box(df: DataFrame, key: Sequence[str], box: str) -> DataFrame:
    b = F.col(box)
    u = df.groupBy(*key).agg(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"), F.count(F.lit(1)).alias("n_boxes"))
    return u.withColumn("area", F.round((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 4))


def reading_order(df: DataFrame, key: Sequence[str], box: str, band: float) -> DataFrame:
    """Position of each box on its page, band by band, then left to right."""
    w = Window.partitionBy(*key).orderBy(F.floor(F.col(box)["y0"] / band), F.col(box)["x0"], *[c for c in df.columns if c not in (*key, box)])
    return df.withColumn("reading_pos", F.row_number().over(w))


def _per_page(df: DataFrame, page: Sequence[str], schema: str, of_page: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """Runs a function over the rows of each page.

    Pages are brought together by one shuffle and streamed in sorted order through Arrow batches, so that thousands of
    small pages cost no call each, and no more than one page is held at a time.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    cols = list(page)
    out_schema = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pages() -> Iterator[list[dict]]:
            at, rows = None, []
            for b in batches:
                for r in b.to_pylist():
                    here = tuple(r[c] for c in cols)
                    if here != at:
                        if rows:
                            yield rows
                        at, rows = here, []
                    rows.append(r)
            if rows:
                yield rows

        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], f.type) for k, f in enumerate(out_schema)], schema=out_schema)

        for rows in pages():
            place = tuple(rows[0][c] for c in cols)
            held += [(*place, *x) for x in of_page(rows)]
            if len(held) > 10_000:
                yield batch()
                held = []
        yield batch()

    return df.repartition(*cols).sortWithinPartitions(*cols).mapInArrow(run, schema)


def _names(df: DataFrame, *cols: str) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in cols)


def _union(boxes: Sequence[Sequence[float]]) -> tuple[float, float, float, float]:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def _box(r: dict) -> tuple[float, float, float, float]:
    return r["x0"], r["y0"], r["x1"], r["y1"]


def text_lines(words: DataFrame, page: Sequence[str], tolerance: float = 3.0) -> DataFrame:
    """Words to lines: a line takes words whose top lies within ``tolerance`` of its first word's, not of its last one's."""

    def of_page(rows: list[dict]) -> list[tuple]:
        found: list[list[dict]] = []
        for r in sorted(rows, key=lambda r: (r["y0"], r["x0"], r["text"])):
            if found and abs(r["y0"] - found[-1][0]["y0"]) <= tolerance:
                found[-1].append(r)
            else:
                found.append([r])
        return [(k, " ".join(w["text"] for w in sorted(l, key=lambda w: w["x0"])), *_union([_box(w) for w in l])) for k, l in enumerate(found)]

    return _per_page(words, page, f"{_names(words, *page)}, line_no int, text string, x0 double, y0 double, x1 double, y1 double", of_page)


def merged_boxes(boxes: DataFrame, page: Sequence[str], gap: float = 10.0) -> DataFrame:
    """Neighbouring boxes of a page merged: a box joins the first group whose growing box it comes within ``gap`` of."""

    def of_page(rows: list[dict]) -> list[tuple]:
        groups: list[tuple] = []
        for b in sorted((_box(r) for r in rows), key=lambda b: (b[1], b[0], b[3], b[2])):
            near = (k for k, g in enumerate(groups) if b[0] - g[2] <= gap and g[0] - b[2] <= gap and b[1] - g[3] <= gap and g[1] - b[3] <= gap)
            k = next(near, None)
            if k is None:
                groups.append((*b, 1))
            else:
                groups[k] = (*_union([groups[k], b]), groups[k][4] + 1)
        return [(k, *g) for k, g in enumerate(groups)]

    return _per_page(boxes, page, f"{_names(boxes, *page)}, group_no int, x0 double, y0 double, x1 double, y1 double, n_boxes int", of_page)


def continued_captions(lines: DataFrame, page: Sequence[str], follow: int = 4, gap: float = 15.0, wider: float = 1.5) -> DataFrame:
    """Caption lines with the lines that go on below them: at most ``follow``, up to the next caption, a gap or a much wider line."""

    def of_page(rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: r["line_no"])
        out = []
        for k, r in enumerate(rows):
            if not r["is_caption"]:
                continue
            text, box = r["text"], _box(r)
            for nxt in rows[k + 1 : k + 1 + follow]:
                if nxt["is_caption"] or nxt["y0"] - box[3] > gap or nxt["x1"] - nxt["x0"] > wider * (box[2] - box[0]):
                    break
                text, box = f"{text} {nxt['text']}", _union([box, _box(nxt)])
            out.append((r["line_no"], text, *box))
        return out

    return _per_page(lines, page, f"{_names(lines, *page)}, line_no int, text string, x0 double, y0 double, x1 double, y1 double", of_page)


def claimed_images(scored: DataFrame, page: Sequence[str], caption_id: str, image_id: str) -> DataFrame:
    """Captions in order each claim their best image that no earlier one of the page has taken."""

    def of_page(rows: list[dict]) -> list[tuple]:
        taken: set = set()
        out: dict = {}
        for r in sorted(rows, key=lambda r: (r[caption_id], -r["score"], r[image_id])):
            if r[caption_id] not in out and r[image_id] not in taken:
                taken.add(r[image_id])
                out[r[caption_id]] = (r[caption_id], r[image_id], r["score"])
        return list(out.values())

    return _per_page(scored, page, f"{_names(scored, *page, caption_id, image_id)}, score double", of_page)


def label_rows(labels: DataFrame, page: Sequence[str], share: float = 0.15, by: str = "mean") -> DataFrame:
    """Labels in reading order and the row each falls to.

    In reading order, rows begin at the first label that lies more than ``share`` of the image's height below the row's
    first one. With ``by="mean"`` the labels so ordered are clustered anew: one joins the row before it if it lies within
    ``share`` of that row's mean height.
    """

    def of_page(rows: list[dict]) -> list[tuple]:
        limit = share * rows[0]["height"]
        lines: list[list[dict]] = []
        for r in sorted(rows, key=lambda r: (r["y"], r["x"], r["label"])):
            if lines and r["y"] - lines[-1][0]["y"] <= limit:
                lines[-1].append(r)
            else:
                lines.append([r])
        ordered = [(k, r) for k, line in enumerate(lines) for r in sorted(line, key=lambda r: r["x"])]
        if by == "first":
            return [(r["label"], k) for k, r in ordered]
        out, heights, k = [], [], 0
        for _, r in ordered:
            if heights and abs(r["y"] - sum(heights) / len(heights)) > limit:
                heights, k = [], k + 1
            heights.append(r["y"])
            out.append((r["label"], k))
        return out

    return _per_page(labels, page, f"{_names(labels, *page)}, label string, row_no int", of_page)


def white_bands(share_of_white: Column, least: int, threshold: float = 0.98) -> Column:
    """Runs of white columns, at least ``least`` wide, as ``struct(start, end)``; one still open at the right edge is dropped."""
    state = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<start:int,end:int>>").alias("bands"), F.lit(0).alias("i"))

    def step(s: Column, v: Column) -> Column:
        white = v >= threshold
        closes = (~white) & (s["open"] >= 0) & (s["i"] - s["open"] >= least)
        band = F.array(F.struct(s["open"].alias("start"), s["i"].alias("end")))
        return F.struct(F.when(white & (s["open"] < 0), s["i"]).when(white, s["open"]).otherwise(F.lit(-1)).alias("open"), F.when(closes, F.concat(s["bands"], band)).otherwise(s["bands"]).alias("bands"), (s["i"] + 1).alias("i"))

    return F.aggregate(share_of_white, state, step, lambda s: s["bands"])


def region_score(area_share: Column, density: Column, has_color: Column, aspect: Column, y_share: Column) -> Column:
    """Likelihood that a region is a figure: .3 size (5 to 60 % of the page is best), .2 density, .25 colour, .15 shape, .1 place."""
    size = F.when(area_share < 0.05, area_share / 0.05).when(area_share > 0.6, F.greatest(F.lit(0.0), 1 - (area_share - 0.6) / 0.3)).otherwise(1.0)
    half = lambda good: F.when(good, 1.0).otherwise(0.5)
    return F.round(0.3 * size + 0.2 * F.least(F.lit(1.0), density / 0.5) + 0.25 * half(has_color) + 0.15 * half(aspect.between(0.3, 3.0)) + 0.1 * half((y_share > 0.05) & (y_share < 0.9)), 6)


def plausible_region(b: Column, page_width: float, page_height: float, least: float = 0.03, most: float = 0.85, margin: float = 0.02) -> Column:
    """Whether a region can be a figure: neither tiny nor the whole page, no strip, nothing small at the very edge."""
    share = area(b) / (page_width * page_height)
    aspect = width(b) / height(b)
    edge = (b["x0"] < page_width * margin) & (width(b) < page_width * 0.3) | (b["y0"] < page_height * margin) & (height(b) < page_height * 0.1)
    return share.between(least, most) & ~edge & F.coalesce(aspect.between(0.1, 6.0), F.lit(False))


def caption_anchored(c: Column, page_width: float, page_height: float) -> Column:
    """The box where a caption's figure should be: above it, as wide, widened for narrow captions; null without room."""
    bottom = c["y0"] - 3
    top = F.greatest(F.lit(10.0), bottom - page_height * 0.35)
    left, right = F.greatest(F.lit(20.0), c["x0"] - 10), F.least(F.lit(page_width - 20), c["x1"] + 10)
    narrow, middle = right - left < page_width * 0.3, (left + right) / 2
    x0 = F.when(narrow, F.greatest(F.lit(20.0), middle - page_width * 0.2)).otherwise(left)
    x1 = F.when(narrow, F.least(F.lit(page_width - 20), middle + page_width * 0.2)).otherwise(right)
    return F.when(top < bottom, F.struct(x0.alias("x0"), top.alias("y0"), x1.alias("x1"), bottom.alias("y1")))


def without_body_text(figure: Column, texts: Column, page_width: float) -> Column:
    """A figure's box cut back where wide text blocks cover more than three tenths of it, block by block."""

    def cut_by(f: Column, t: Column) -> Column:
        covered = F.least(f["y1"], t["y1"]) - F.greatest(f["y0"], t["y0"])
        hit = (t["x1"] - t["x0"] > page_width * 0.6) & (covered > 0) & (covered / (f["y1"] - f["y0"]) > 0.3)
        below = t["y0"] > (f["y0"] + f["y1"]) / 2
        y0 = F.when(hit & ~below, F.greatest(f["y0"], t["y1"] + 2)).otherwise(f["y0"])
        y1 = F.when(hit & below, F.least(f["y1"], t["y0"] - 2)).otherwise(f["y1"])
        return F.struct(f["x0"].alias("x0"), y0.alias("y0"), f["x1"].alias("x1"), y1.alias("y1"))

    got = F.aggregate(texts, figure, cut_by)
    return F.when((got["y1"] > got["y0"]) & (got["x1"] > got["x0"]), got)


def widest_gap(gaps: Column, page_width: float) -> Column:
    """The widest gap between columns whose centre lies in the middle three fifths of the page; the first of equal ones."""
    central = F.filter(gaps, lambda g: (g["center"] > page_width * 0.2) & (g["center"] < page_width * 0.8))
    most = F.array_max(F.transform(central, lambda g: g["width"]))
    return F.get(F.filter(central, lambda g: g["width"] == most), F.lit(0))


def factorisations(n: Column) -> Column:
    """All grids of ``n`` cells as ``struct(rows, cols)``, fewest rows first."""
    rows = F.filter(F.sequence(F.lit(1), n), lambda r: n % r == 0)
    return F.transform(rows, lambda r: F.struct(r.alias("rows"), (n / r).cast("int").alias("cols")))


def best_grid(scored: Column, least: float = 0.3) -> Column:
    """The first of the grids ``struct(rows, cols, score)`` with the best score, if it exceeds ``least``."""
    most = F.array_max(F.transform(scored, lambda g: g["score"]))
    return F.when(most > least, F.get(F.filter(scored, lambda g: g["score"] == most), F.lit(0)))


def midpoints(positions: Column, end: Column) -> Column:
    """Cuts between neighbours: 0, the whole midpoints, and the end."""
    inner = F.transform(F.slice(positions, 1, F.greatest(F.size(positions) - 1, F.lit(0))), lambda p, i: F.floor((p + F.get(positions, i + 1)) / 2).cast("int"))
    return F.concat(F.array(F.lit(0)), inner, F.array(end))


def zipped_labels(labels: Column, cells: Column) -> Column:
    """``map`` of labels to cells in order, where there are as many of both."""
    return F.when(F.size(labels) == F.size(cells), F.map_from_arrays(labels, cells))


def first_engine(candidates: DataFrame, key: Sequence[str], rank: str, box: str, smallest: float = 30.0) -> DataFrame:
    """Of each caption's candidates the one of the first engine whose box is large enough on both sides."""
    good = candidates.where((width(F.col(box)) >= smallest) & (height(F.col(box)) >= smallest))
    rest = [c for c in candidates.columns if c not in key]
    return good.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(rank, F.to_json(F.struct(*rest)))).alias("_x")).select(*key, *(F.col(f"_x.{c}").alias(c) for c in rest))
