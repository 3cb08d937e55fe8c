import numpy as np
from pyspark.sql import functions as F

from litloom.operators import pixels as X


def images(spark, *arrays):
    rows = [(k, a.astype(np.uint8).tobytes(), a.shape[0], a.shape[1]) for k, a in enumerate(arrays)] + [(99, None, None, None), (98, b"xx", 3, 3)]
    return spark.createDataFrame(rows, "id int, content binary, height int, width int")


C = ("content", "height", "width")


def test_borders_and_crops(spark):
    a = np.full((40, 50, 3), 255)
    a[10:20, 5:30] = 0
    dot = np.full((100, 100, 3), 255)
    dot[50, 50] = 0
    got = {r.id: r.t for r in images(spark, a, np.full((9, 9, 3), 255), dot).select("id", X.trimmed(*C).alias("t")).collect()}
    assert (got[0].height, got[0].width) == (14, 29) and (got[1].height, got[1].width) == (9, 9) and (got[2].height, got[2].width) == (100, 100)
    assert (got[99].height, got[98].height, bytes(got[99].content)) == (0, 0, b"")
    box = lambda *b: X.cropped(*C, *map(F.lit, b))
    r = images(spark, a).where("id = 0").select(box(-5, 8, 10, 12).alias("a"), box(30, 5, 20, 9).alias("b"), box(45, 35, 99, 99).alias("c")).first()
    assert (r.a.height, r.a.width, r.b.height * r.b.width, r.c.height, r.c.width) == (4, 10, 0, 5, 5)
    assert set(r.a.content[:18]) == {255}


def test_colour_columns_and_grids(spark):
    grey, red = np.full((20, 20, 3), 90), np.full((20, 20, 3), 90)
    red[:2, :10] = (200, 20, 20)
    page = np.zeros((20, 20, 3))
    page[:, 8:13] = 255
    d = images(spark, grey, red, page)
    got = {r.id: r for r in d.select("id", X.has_colour(*map(F.col, C)).alias("c"), X.colour_share(*C, F.lit(30)).alias("s"), X.white_columns(*C).alias("w"), X.grid_score(*C, F.lit(1), F.lit(False)).alias("g"), X.grid_score(*C, F.lit(0), F.lit(True)).alias("z")).collect()}
    assert (got[0].c, got[1].c, got[1].s) == (False, True, 0.05) and got[99].s == 0.0 and not got[99].c
    assert got[2].w == [0.0] * 8 + [1.0] * 5 + [0.0] * 7 and got[99].w == [] and got[2].g == 0.5 and got[0].z == 0.5


def test_components_and_decisions(spark):
    d = spark.createDataFrame([(1, 10, 2, 5), (1, 10, 2, 5), (1, 4000, 90, 50), (2, 10, 2, 5)], "id int, area int, w int, h int").withColumns({"image_width": F.lit(200), "image_height": F.lit(400)})
    got = {r.id: r for r in X.component_statistics(d, ["id"]).collect()}
    assert (got[1].n, round(got[1].text_ratio, 3), round(got[1].variation, 3), got[1].elongated) == (3, 0.667, 1.403, True) and not got[2].elongated
    assert [r.area for r in X.content_blobs(d).collect()] == [4000]
    say = lambda *v: spark.range(1).select(X.is_figure(*(F.lit(x) for x in v))).first()[0]
    assert [say(0.04, 0.0, 0, 0.0, 0.0, False), say(0.0, 0.0, 0, 0.0, 0.0, False), say(0.0, 0.0, 9, 0.95, 4.0, False), say(0.0, 0.0, 9, 0.95, 0.1, False), say(0.0, 0.0, 9, 0.5, 0.1, False)] == [True, False, True, False, True]
    way = lambda a, b, n: spark.range(1).select(X.subfigure_way(*(F.array(*map(F.lit, range(k))) for k in (a, b, n)))).first()[0]
    assert [way(2, 0, 4), way(1, 4, 4), way(0, 3, 4), way(0, 0, 0)] == ["letters", "components", "grid", "labels"]
