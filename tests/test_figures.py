import pytest
from pyspark.sql import functions as F

from litloom.operators import figures as G

BOX = "struct<x0 double, y0 double, x1 double, y1 double>"


def test_caption_kinds(spark):
    rows = [("Fig. 3: x", (3, "figure")), ("FIGURE 2. y", (2, "figure")), ("图 4。z", (4, "figure")), ("Scheme 1 a", (1, "scheme")), ("Supplementary Fig. 7. b", (7, "supplementary")), ("Extended Data Figure 1: c", (1, "extended_data")), ("see Fig. 3", None), ("Chart 5.", (5, "chart"))]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(G.caption_kind(F.col("t")).alias("k")).collect()
    assert [tuple(r.k) if r.k else None for r in got] == [w for _, w in rows]


def test_longest_caption_first_on_ties(spark):
    d = spark.createDataFrame([("figure", 1, "abc", 1), ("figure", 1, "abd", 0), ("figure", 1, "ab", 2), ("scheme", 1, None, 3)], "type string, number int, text string, ord int")
    assert {(r.type, r.number): r.ord for r in G.longest_per_key(d, ["type", "number"], "text", ["ord"]).collect()} == {("figure", 1): 0, ("scheme", 1): 3}


@pytest.mark.parametrize("labels, want", [(["b", "A", "c"], ["a", "b", "c"]), (["a"], []), (["b", "c"], []), (["a", "b", "d"], ["a", "b"]), ([], [])])
def test_consecutive_labels(spark, labels, want):
    assert spark.createDataFrame([(labels,)], "l array<string>").select(G.consecutive_labels(F.col("l")).alias("r")).first().r == want


def test_lines_follow_the_anchor(spark):
    # each word is 2 below the last: a plain gap rule would make one line of all
    words = spark.createDataFrame([(1, f"w{k}", 10.0 * k, 2.0 * k, 10.0 * k + 5, 2.0 * k + 8) for k in range(5)] + [(2, "x", 0.0, 0.0, 1.0, 1.0)], "page int, text string, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.page, r.line_no, r.text) for r in G.text_lines(words, ["page"]).collect())
    assert got == [(1, 0, "w0 w1"), (1, 1, "w2 w3"), (1, 2, "w4"), (2, 0, "x")]
    assert G.text_lines(words.limit(0), ["page"]).collect() == []


def test_merged_boxes_grow(spark):
    b = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (1, 15.0, 0.0, 25.0, 10.0), (1, 30.0, 0.0, 40.0, 10.0), (1, 100.0, 100.0, 110.0, 110.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.x0, r.x1, r.n_boxes) for r in G.merged_boxes(b, ["page"]).collect()) == [(0.0, 40.0, 3), (100.0, 110.0, 1)]


def test_captions_go_on_below(spark):
    rows = [(1, 0, "Fig. 1. a", True, 0.0, 0.0, 100.0, 10.0), (1, 1, "b", False, 0.0, 12.0, 100.0, 20.0), (1, 2, "wide", False, 0.0, 22.0, 400.0, 30.0), (1, 3, "Fig. 2. c", True, 0.0, 60.0, 100.0, 70.0), (1, 4, "far", False, 0.0, 100.0, 90.0, 110.0)]
    d = spark.createDataFrame(rows, "page int, line_no int, text string, is_caption boolean, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.line_no, r.text) for r in G.continued_captions(d, ["page"]).collect()) == [(0, "Fig. 1. a b"), (3, "Fig. 2. c")]


def test_claims_are_not_shared(spark):
    d = spark.createDataFrame([(1, 1, 7, 0.9), (1, 2, 7, 0.95), (1, 2, 8, 0.4), (1, 3, 7, 0.9)], "page int, cap int, img int, score double")
    assert sorted((r.cap, r.img) for r in G.claimed_images(d, ["page"], "cap", "img").collect()) == [(1, 7), (2, 8)]


def test_best_above(spark):
    c = spark.createDataFrame([(1, 5, (0.0, 500.0, 100.0, 520.0))], f"page int, cap int, caption_box {BOX}")
    i = spark.createDataFrame([(1, 1, (0.0, 300.0, 100.0, 490.0)), (1, 2, (0.0, 0.0, 100.0, 50.0)), (1, 3, (0.0, 530.0, 100.0, 600.0))], f"page int, img int, image_box {BOX}")
    assert [(r.cap, r.img) for r in G.best_above(c, i, ["page"], "cap", "img", 612.0, 792.0).collect()] == [(5, 1)]


def test_bands_drop_the_open_edge(spark):
    v = [1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0]
    got = spark.createDataFrame([(v,)], "v array<double>").select(G.white_bands(F.col("v"), 2).alias("b")).first().b
    assert [(b.start, b.end) for b in got] == [(0, 2)]


def test_label_rows(spark):
    d = spark.createDataFrame([(1, "a", 0.0, 10.0, 100.0), (1, "b", 50.0, 20.0, 100.0), (1, "c", 0.0, 60.0, 100.0)], "page int, label string, x double, y double, height double")
    assert {r.label: r.row_no for r in G.label_rows(d, ["page"]).collect()} == {"a": 0, "b": 0, "c": 1}
    # The second label drifts within reach of the first row's mean, not of its first label.
    drift = spark.createDataFrame([(1, "a", 9.0, 0.0, 100.0), (1, "b", 0.0, 14.0, 100.0), (1, "c", 5.0, 20.0, 100.0)], "page int, label string, x double, y double, height double")
    assert {r.label: r.row_no for r in G.label_rows(drift, ["page"], by="first").collect()} == {"a": 0, "b": 0, "c": 1}
    assert {r.label: r.row_no for r in G.label_rows(drift, ["page"]).collect()} == {"a": 0, "b": 0, "c": 0}


def test_small_geometry(spark):
    d = spark.createDataFrame([((100.0, 500.0, 150.0, 520.0), [(0.0, 400.0, 600.0, 480.0)], [(100.0, 5.0), (300.0, 9.0), (310.0, 9.0)], 6, [10, 21, 40])], f"c {BOX}, t array<{BOX}>, g array<struct<center double, width double>>, n int, p array<int>")
    r = d.select(
        G.caption_anchored(F.col("c"), 612.0, 792.0).alias("a"),
        G.without_body_text(F.struct(F.lit(0.0).alias("x0"), F.lit(300.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(480.0).alias("y1")), F.col("t"), 612.0).alias("b"),
        G.widest_gap(F.col("g"), 612.0).alias("g"),
        G.factorisations(F.col("n")).alias("f"),
        G.midpoints(F.col("p"), F.lit(50)).alias("m"),
    ).first()
    assert (r.a.y1, round(r.a.y0, 1), round(r.a.x1 - r.a.x0, 1)) == (497.0, 219.8, 227.4)
    assert (r.b.y0, r.b.y1) == (300.0, 398.0) and r.g.center == 300.0
    assert [tuple(x) for x in r.f] == [(1, 6), (2, 3), (3, 2), (6, 1)] and r.m == [0, 15, 30, 50]


def test_grid_zip_and_engine(spark):
    d = spark.createDataFrame([([(1, 4, 0.5), (2, 2, 0.9), (4, 1, 0.9)], ["a", "b"], [1, 2])], "g array<struct<rows int, cols int, score double>>, l array<string>, c array<int>")
    r = d.select(G.best_grid(F.col("g")).alias("g"), G.zipped_labels(F.col("l"), F.col("c")).alias("z"), G.zipped_labels(F.col("l"), F.slice("c", 1, 1)).alias("n")).first()
    assert (r.g.rows, r.z, r.n) == (2, {"a": 1, "b": 2}, None)
    c = spark.createDataFrame([(1, 0, (0.0, 0.0, 10.0, 10.0)), (1, 1, (0.0, 0.0, 50.0, 50.0)), (1, 2, (0.0, 0.0, 90.0, 90.0)), (2, 0, (0.0, 0.0, 5.0, 5.0))], f"cap int, engine int, box {BOX}")
    assert [(r.cap, r.engine) for r in G.first_engine(c, ["cap"], "engine", "box").collect()] == [(1, 1)]


def test_regions_and_unions(spark):
    box = lambda *b: (float(b[0]), float(b[1]), float(b[2]), float(b[3]))
    c = spark.createDataFrame([(1, 1, box(100, 500, 300, 520)), (1, 2, box(100, 400, 300, 420))], f"page int, caption_id int, caption_box {BOX}")
    i = spark.createDataFrame([(1, 1, box(100, 300, 300, 490), 0.1), (1, 2, box(100, 300, 300, 490), 0.9), (1, 3, box(100, 501, 300, 700), 1.0)], f"page int, image_id int, image_box {BOX}, sure double")
    got = {r.caption_id: (r.image_id, r.score) for r in G.best_above(c, i, ["page"], "caption_id", "image_id", 612.0, 792.0, slack=0.0, confidence="sure").collect()}
    assert got[1] == (2, 0.973165) and got[2][0] == 2
    assert G.best_above(c, i, ["page"], "caption_id", "image_id", 612.0, 792.0, confidence="sure", column=(300.0, 600.0)).count() == 0
    b = spark.createDataFrame([(1, 1, box(5, 5, 100, 100)), (1, 2, box(200, 300, 605, 790)), (1, 3, box(0, 0, 20, 600)), (2, 4, box(0, 0, 9, 9))], f"page int, id int, bbox {BOX}")
    assert [tuple(r) for r in G.padded_union(b, ["page"], "bbox", 612.0, 792.0).collect()] == [(1, 0.0, 0.0, 612.0, 792.0, 2)]
    assert sorted(r.id for r in G.large_unclaimed(b, spark.createDataFrame([(2,)], "id int"), ["id"], "bbox", 612.0, 792.0).collect()) == [3]


def test_orders_and_letters(spark):
    f = spark.createDataFrame([(1, 2, "figure", b"x", 5), (1, 2, "scheme", b"y", 3), (1, 1, "figure", None, 9)], "rec int, number int, figure_type string, image binary, id int")
    assert [r.id for r in G.by_number(f).collect()] == [9, 5, 3] and [r.id for r in G.by_confidence(f, "id").collect()] == [9, 5, 3]
    r = G.of_number(f, ["rec"], "number", 2, "id").first()
    assert r.id == 3 and "image" not in r.asDict()
    l = spark.createDataFrame([("a", 40.0, 2), ("a", 40.0, 1), ("b", 35.0, 1), ("a", 36.0, 0)], "letter string, sure double, id int").withColumn("rec", F.lit(1))
    assert [(r.letter, r.id) for r in G.best_per_letter(l, ["rec"], "letter", "sure", "id").collect()] == [("a", 1)]
    assert spark.range(1).select(G.labels_of(F.array(F.lit("B"), F.lit("a")), F.lit(None).cast("array<string>"), F.array(F.lit("b")))).first()[0] == ["a", "b"]
