import json

from pyspark.sql import functions as F

from litloom.operators import blocks as B
from litloom.operators import outline_text as X

TEXT = """Title: Sieves
Speaker： Ada
1. Background
- first
● second
note: dropped
<!-- fig: Fig 1 | path=C:\\x.png | position=left -->
Part 2: Plan
2024 - start of it all and more
later
第三部分
x
Title: Better
"""


def read(spark, *texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, t string")
    return {r.id: r for r in X.outlines(df, "id", "t").collect()}


def test_outline(spark):
    r = read(spark, TEXT, "", None, "no section: here\nplain", "  1. Only  ")
    a = r[0]
    assert (a.head.title, a.head.author, a.head.date) == ("Better", "Ada", "") and a.warnings == []
    assert [(s.part_num, s.title, s.page.page_type, s.page["items"]) for s in a.sections] == [
        ("1", "Background", "timeline", ["first", "second", "2024 - start of it all and more", "later"]),  # ``Part 2: Plan`` has a colon
        ("2", "第三部分", "content_list", ["x"]),
    ]
    assert [tuple(f) for f in a.sections[0].page.figures] == [("Fig 1", "C:\\x.png", "left")]
    assert r[1].sections == [] and r[1].warnings == ["Missing title", "Missing author", "No sections detected"]
    assert r[3].sections == [] and [s.title for s in r[4].sections] == ["Only"] and r[2].sections in (None, [])


def test_lines_with_a_colon_are_no_content_and_years_make_timelines(spark):
    s = read(spark, "1. Steps\n2024 - start of it all and more\nlater: never\n2030-end\nPart 2 Rest\nx")[0].sections
    assert s[0].page.page_type == "timeline" and [tuple(e) for e in s[0].page.events] == [("2024", "start of it all and ", "start of it all and more"), ("2030", "end", "end")]
    assert s[1].title == "Rest"


def test_mappings(spark):
    body = {"meta": {"title": "T", "author": ""}, "sections": [{"title": "A", "items": ["x", "y"]}, {"points": ["p"], "events": [{"date": "2020", "title": "t", "description": "d"}]}]}
    df = spark.createDataFrame([(json.dumps(body),), ("{broken",), ("plain",), (None,), ('{"x": 1}',)], "t string")
    got = [r[0] for r in df.select(X.mapping_text(F.col("t"))).collect()]
    assert got == ["title: T\n1. A\n- x\n- y\n2. Section 2\n- p\n- 2020 t: d", "{broken", "plain", None, '{"x": 1}']


def test_tagged_outline(spark):
    md = "文章标题：Sieves\n汇报人: Ada\n### 1. Intro\n- one\n- （请填写）\n见 [图1,页3] [图9,页1]\n- - two\n### 2. End\ntext"
    paths = F.create_map(F.lit("图1"), F.lit("a.png"))
    got = spark.createDataFrame([(md,)], "t string").select(X.tagged_outline(F.col("t"), paths)).first()[0]
    assert got == "主题：Sieves\n汇报人：Ada\n\n\n1. Intro\n- one\n- - two\n<!-- 图: 图1 | path=a.png | position=right -->\n\n2. End"


def test_tags_there_and_back(spark):
    df = spark.createDataFrame([([("A", ["x", "y"]), ("B", [])],)], "s array<struct<title:string,items:array<string>>>")
    r = df.select(X.tag_lines(F.col("s")).alias("t"), X.untagged(F.col("s"), F.lit("[SEC1] Z \n[S0I1]why\n[SEC7]no\n[S0I0]\nnoise")).alias("u")).first()
    assert r.t == "[SEC0]A\n[S0I0]x\n[S0I1]y\n[SEC1]B" and [tuple(s) for s in r.u] == [("A", ["x", "why"]), ("Z", [])]


def test_pages_and_previews(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "1. A\n" + "\n".join(f"- i{k}" for k in range(7)))], "id int, t string")
    rows = [(r.num, r.page_type, r.title, r.n_items) for r in X.previews(df, "id", "t", 5).where("id = 2").orderBy("num").collect()]
    assert rows == [(1, "cover", "", 0), (2, "section", "A", 0), (3, "content_list", "A", 5), (4, "content_list", "A (2)", 2), (5, "ending", "", 0)]
    d = spark.createDataFrame([(["a"], None, None), (None, ["p"], ["r"])], "i array<string>, p array<string>, r array<string>").select(X.page_texts(F.col("i"), F.col("p"), F.col("r"))).collect()
    assert [r[0] for r in d] == [["a"], ["p", "r"]]
    pages = spark.createDataFrame([([("content_list", [], [("x.png",)]), ("content_list", ["a"], [])],)], "p array<struct<page_type:string,items:array<string>,figures:array<struct<path:string>>>>")
    assert pages.select(X.page_warnings(F.col("p"), F.array(F.lit("y.png")))).first()[0] == ["only 2 pages", "page 1 has no items", "page 1 lacks x.png"]


def test_fonts(spark):
    df = spark.createDataFrame([(0, 500, 300), (20, 500, 300), (2000, 500, 300), (400, 500, 300)], "n int, w int, h int")
    assert [r[0] for r in df.select(X.text_font(F.col("n"), F.col("w"), F.col("h"))).collect()] == [16, 20, 10, 12]
    assert [tuple(spark.range(1).select(X.list_font(F.lit(n), F.lit(400)).alias("f")).first().f) for n in (2, 6, 8, 20)] == [(15, 85.0), (15, 62.0), (12, 47.0), (15, 62.0)]
    t = spark.createDataFrame([("",), ("x" * 10,), ("x" * 18,), ("x" * 40,)], "t string")
    assert [r[0] for r in t.select(X.title_font(F.col("t"), F.lit(500))).collect()] == [22, 24, 22, 18]


def test_outline_of_blocks(spark):
    text = "1.2 Theorem one\nIt holds for all the sieves we know of. Short one. And it also holds for all the others!\n\nplain"
    b = B.blocks(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    assert X.blocks_outline(b, "id").first().outline == "1. Theorem one\n- 1.2 Theorem one\nIt holds for all the sieves we know of.\n- And it also holds for all the others!\n2. plain"
    assert [r.type for r in B.of_type(b, "theorem").collect()] == ["theorem"]
