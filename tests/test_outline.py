from pyspark.sql import functions as F

from litloom.operators import outline as O
from litloom.operators import pages as P

DECK = "Title: Sieves\nAuthor： Ada\n1. Background\n- one\n- two\n* three\n4 plain\n2. Results\n- r1\n"


def deck(spark, text=DECK):
    return spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")


def test_pages_toc_and_frame(spark):
    pages = O.outline_pages(deck(spark), "id", "text", most=2)
    assert [(r.page, r.title, r["items"]) for r in pages.orderBy("page").collect()] == [(1, "Background", ["one", "two"]), (2, "Background (2)", ["three"]), (3, "Results", ["r1"])]
    assert [tuple(r) for r in O.table_of_contents(pages.withColumn("title", F.regexp_replace("title", r" \(\d+\)$", "")), "id", "title", "page").collect()] == [(1, ["Background", "Results"])]
    assert [r.type for r in O.framed(pages, "id", "page", "title").orderBy("slide_no").collect()] == ["cover", "content", "content", "content", "ending"]


def test_meta_and_warnings(spark):
    m = {r.id: r for r in O.meta(deck(spark), "id", "text").collect()}
    assert (m[1].title, m[1].author, m[1].date) == ("Sieves", "Ada", None) and m[2].title is None and 3 in m
    w = spark.createDataFrame([(None, " ", 0), ("t", "a", 2)], "t string, a string, n int").select(O.warnings(F.col("t"), F.col("a"), F.col("n")).alias("w")).collect()
    assert [r.w for r in w] == [["missing title", "missing author", "missing sections"], []]


def test_frontmatter_last_key_wins(spark):
    got = spark.createDataFrame([("---\ntitle: A\nTheme: dark\ntitle: B\n---\nbody: x",), ("no front",), (None,)], "t string").select(O.frontmatter(F.col("t")).alias("m")).collect()
    assert got[0].m == {"title": "B", "theme": "dark"} and got[1].m == {} and not got[2].m


def test_repeated_sections_go_with_their_row(spark):
    d = spark.createDataFrame([(1, 0, "s", "A"), (1, 1, "c", "x"), (1, 2, "s", "A"), (1, 3, "c", "y"), (1, 4, "s", "B"), (1, 5, "c", "z")], "id int, pos int, kind string, title string")
    assert sorted(r.pos for r in O.without_repeats(d, "id", "pos", F.col("title"), F.col("kind") == "s").collect()) == [0, 1, 4, 5]


def test_small_columns(spark):
    d = spark.createDataFrame([(["a", "b", "c", "d", "e", "f", "g"], 6)], "s array<string>, n int")
    assert d.select(O.nav_window(F.col("s"), F.col("n"))).first()[0] == ["c", "d", "e", "f", "g"]
    assert d.select(O.nav_window(F.col("s"), F.lit(0))).first()[0] == ["a", "b", "c", "d", "e"]
    assert d.select(O.proportional_section(F.lit(9), F.lit(10), F.lit(3)), O.density(F.lit(6))).first()[:] == (2, "is-dense")


def test_pages(spark):
    d = spark.createDataFrame([("Plan", ["x"]), ("A", ["in 2024 it"]), ("Method", ["x"]), ("A", ["120245"])], "t string, l array<string>").select(P.page_type(F.col("t"), F.col("l")).alias("p"))
    assert [r.p for r in d.collect()] == ["timeline", "timeline", "content_detail", "content_list"]
    e = spark.createDataFrame([("2020: The start of all of it",), ("no date here",)], "l string").select(P.timeline_event(F.col("l")).alias("e")).collect()
    assert [tuple(r.e) for r in e] == [("2020", "The start of all of ", "The start of all of it"), ("", "no date here", "no date here")]
    f = spark.createDataFrame([([30] * 4,), ([3000] * 30,)], "n array<int>").select(P.fitted_font(F.col("n"), 2.0, 6.0).alias("f")).collect()
    assert [r.f for r in f] == [22, 9]
    t = spark.createDataFrame([(1, [("A", ["x", "y"]), ("B", [])])], "id int, s array<struct<title string, items array<string>>>")
    assert {r.tag: r.text for r in P.tagged_items(t, "id", "s").collect()} == {"[SEC0]": "A", "[SEC1]": "B", "[S0I0]": "x", "[S0I1]": "y"}
    c = spark.createDataFrame([("see Fig. 2: A long caption\nFig. 12. other one", 2), ("图 3. 一二三四五六", 3), ("none", 1)], "t string, n int").select(P.figure_caption(F.col("t"), F.col("n")).alias("c")).collect()
    assert [r.c for r in c] == ["A long caption", "一二三四五六", None]
    k, rest = P.known_and_rest(F.col("b"), ["title"])
    r = spark.createDataFrame([('{"title": "T", "x": "1"}',)], "b string").select(k.alias("k"), rest.alias("r")).first()
    assert (r.k, r.r) == ({"title": "T"}, {"x": "1"})


def test_markdown_slides(spark):
    deck = "layout: section\nsubtitle: '01'\n\n# Sieves\n- one\n2. two\nplain\n![Fig](a.png)\n![Last](b.png)\n:::notes\nsay this\nand that\n:::\n<!-- no -->\n---\n# Thanks\n---\n\n---\n# Conclusion of it\n## Sub\ntext"
    got = {r.slide_no: r for r in P.slides(spark.createDataFrame([(1, deck), (2, None)], "id int, t string"), "id", "t").collect()}
    a, b, c = got[0], got[1], got[3]
    assert (a.type, a.title, a.subtitle, a.bullets, a.image, a.caption, a.notes) == ("section", "Sieves", "01", ["one", "two", "plain"], "b.png", "Last", "say this\nand that")
    assert (b.type, b.title, b.bullets, b.image) == ("ending", "Thanks", [], None) and 2 not in got
    assert (c.type, c.title, c.bullets) == ("summary", "Conclusion of it", ["## Sub", "text"])


def test_figure_references(spark):
    t = "![图1](x.png) ![图1](y.png) [图1,页3] [图2，页4] [Fig.5,6]"
    r = spark.createDataFrame([(t,)], "t string").select(P.image_refs(F.col("t")).alias("i"), P.missing_figures(F.col("t")).alias("m"), P.relative_path(F.lit("/a/b/c.png"), "/a").alias("p")).first()
    assert r.i == {"图1": "y.png"} and [tuple(x) for x in r.m] == [("图2", 4), ("Fig.5", 6)] and r.p == "b/c.png"


def test_heads_of_decks(spark):
    t = "---\ntitle: A\n---\n"
    r = spark.createDataFrame([(t + "x",)], "t string").select(O.with_inline(O.frontmatter(F.col("t")), O.inline_head(F.lit("Title: B\n作者：Ada\nnote: x\nTITLE: C"))).alias("m")).first()
    assert r.m == {"title": "A", "author": "Ada"}
