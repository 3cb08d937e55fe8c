from pyspark.sql import functions as F

from litloom.functions import vocabulary as V
from litloom.operators import decks as D
from litloom.operators import render as R
from litloom.operators import reports

META = "struct<title:string,authors:array<string>,journal:string,year:int,doi:string>"
KNOWN = {"theme": "academic-blue", "author": "Ada", "affiliation": "Lab", "date": "2024-01-01"}


def deck(spark, core, meta, review=False, figures=None):
    df = spark.createDataFrame([(core, meta, figures, "/data/sieve.v2.pdf")], f"core map<string,array<string>>, m {META}, f {D.FIGURES}, p string")
    return df.select(D.deck_markdown(F.lit(review), F.col("m"), lambda f: F.col("core")[f], F.col("f"), F.col("p"), base="/deck", **KNOWN).alias("d")).first().d


def test_research_deck(spark):
    core = {"key_results": ["A  result\nof 41", "not found", None, "x" * 300], "innovation": ["Not found"]}
    text = deck(spark, core, ("Deep sieves", ["Ada", " ", "Bo"], None, 2024, "10.1/x"), figures=[(2, 3, None, "/deck/f/2.png"), (5, None, "c" * 230, "C:\\x.png")])
    assert text.startswith("---\ntitle: Deep sieves\nauthor: Ada\naffiliation: Lab\ndate: 2024-01-01\ntheme: academic-blue\n---\n\n# Paper Snapshot\n\n- **Title**: Deep sieves.\n- **Authors**: Ada, Bo.\n- **Source**: Unknown, 2024.\n- **DOI**: 10.1/x.\n")
    assert "\n# Key Results\n\n- A **result** of 41\n- " + "x" * 259 + "...\n\n---" in text
    assert "- The extraction engine did not find explicit **innovation** statements.\n" in text
    assert "\nsubtitle: 03\n\n# Key Figures\n\n---\n\n# Figure 2\n" in text and "![Figure 2](f/2.png)" in text and "- **Page**: Unknown." in text and "](C:/x.png)" in text
    assert "- **Caption**: Caption unavailable." in text and "c" * 219 + "..." in text and "c" * 220 not in text
    assert "from `sieve.v2.pdf`.\n" in text and text.endswith(V.DECK_CAUTION + "\n")


def test_review_deck_and_missing_metadata(spark):
    core = {"review_type": ["Systematic review"], "taxonomy": ["t1"], "major_themes": ["m1", "m2"], "consensus_findings": [f"c{k}" for k in range(9)], "research_gaps": ["g"]}
    text = deck(spark, core, None, review=True)
    assert "title: sieve.v2\n" in text and "- **Paper Type**: Systematic review.\n" in text and "- **Authors**: Unknown.\n" in text
    assert "# Taxonomy and Themes\n\n- t1\n- m1\n- m2\n" in text and "Important Figures" not in text and "# Key Tables" not in text
    assert "# Bottom-Line Takeaways\n\n- c0\n- c1\n- c2\n- c3\n\n---" in text
    some = deck(spark, {"key_tables_figures": ["Table 1: x"]}, None, review=True)
    assert "# Important Figures and Tables\n\n---\n\n# Key Tables and Figures\n\n- Table 1: x\n" in some


def test_first_figures_of_a_hot_paper(spark):
    df = spark.range(3000).select(F.lit(1).alias("rec"), (F.col("id") % 50).cast("int").alias("number"), F.lit(1).alias("page"), F.lit("c").alias("caption"), "id")
    r = D.first_figures(df, "rec", "number", "page", "caption", F.col("id").cast("string"), "id").first()
    assert [(f.number, f.image_path) for f in r.figures] == [(0, str(50 * k)) for k in range(6)]
    assert D.first_figures(df.limit(0), "rec", "number", "page", "caption", F.col("id").cast("string"), "id").count() == 0


SLIDE = "type string, title string, subtitle string, bullets array<string>, image string, caption string, notes string, layout string"


def html(spark, *slide):
    df = spark.createDataFrame([slide], SLIDE)
    about = F.struct(F.lit("Ada & Bo").alias("author"), F.lit("Lab").alias("affiliation"), F.lit("").alias("date"))
    return df.select(R.slide_html(F.struct(*df.columns), F.lit(3), about).alias("h")).first().h


def test_slides_by_type(spark):
    a = html(spark, "content", "<b> and **x**", None, ["one", "==two=="], None, None, "say <this>", "wide")
    assert a.startswith('<section class="slide slide-content is-sparse items-2 title-fit-normal motif-general layout-wide" data-slide="3" data-type="content">')
    assert '<h2>&lt;b&gt; and <span class="text-highlight">x</span></h2>' in a and 'bullet-list-plain"><li>one</li><li><span class="text-highlight">two</span></li>' in a and '<aside class="notes">say &lt;this&gt;</aside>' in a
    assert "<div><span>Presenter</span><strong>Ada &amp; Bo</strong></div><div><span>Affiliation</span><strong>Lab</strong></div></div>" in html(spark, "cover", "T", "", None, None, None, None, None)
    assert "<li><span>01</span>a</li>" in html(spark, "toc", None, None, ["a"] * 11, None, None, None, None)
    split = html(spark, "split", "T", None, ["a", "b", "c"], None, None, None, None)
    assert '<div class="split-grid"><div><ol class="bullet-list bullet-list-plain"><li>a</li></ol></div><div><ol class="bullet-list bullet-list-plain"><li>b</li><li>c</li></ol></div></div>' in split
    figure = html(spark, "figure", "Drug", None, [], "a\\b/c.png", None, None, None)
    assert 'src="assets/figures/c.png" alt="Drug"' in figure and "motif-bio" in figure and "is-balanced items-0" in figure
    assert 'src="https://x/y.png"' in html(spark, "figure", "T", None, [], "https://x/y.png", "c", None, None)
    assert "<h2>Thank You</h2><p>Questions and discussion</p>" in html(spark, "ending", "", None, None, None, None, None, None)
    assert "<p>Key Points</p>" in html(spark, "other", "T", None, None, None, None, None, None)


def test_a_page_is_filled_in_one_pass(spark):
    rows = [(1, k, "content", t, "", ["x"], None, None, None, None) for k, t in ((1, "__SLIDES__"), (0, "__TITLE__"))]
    df = spark.createDataFrame(rows, f"deck int, at int, {SLIDE}")
    about = F.struct(*(F.lit(v).alias(k) for k, v in (("title", "__AUTHOR__ <x>"), ("author", "Ada"), ("affiliation", ""), ("date", ""))))
    r = R.deck_pages(df, "deck", "at", about).first()
    assert "<title>__AUTHOR__ &lt;x&gt;</title>" in r.index_html and 'data-slides="2"' in r.index_html and r.index_html.count("<section ") == 2
    assert r.index_html.index("<h2>__TITLE__</h2>") < r.index_html.index("<h2>__SLIDES__</h2>") and '"slides":[{"type":"content","title":"__TITLE__"' in r.deck_json
    assert "<style>" in R.deck_pages(df, "deck", "at", about, embed=True).first().index_html


def test_reports(spark):
    df = spark.createDataFrame([(("T", ["A", "B"], None, 2020, None), {"methodology": ["m1", "m2"]}, {"methodology": 8}, "error", None, ("pdf_corrupt", None, "retry"))], f"m {META}, c map<string,array<string>>, s map<string,int>, status string, secs int, e struct<kind:string,detail:string,suggestion:string>")
    r = df.select(
        reports.result_markdown(F.col("m"), F.lit(False), lambda f: F.col("c")[f], lambda f: F.col("s")[f], F.col("status"), F.col("secs"), F.col("e")).alias("a"),
        reports.summary_markdown(F.lit(1), F.col("m"), F.lit(False), lambda f: F.col("c")[f], F.col("status")).alias("b"),
        *reports.result_sheet(F.col("m"), lambda f: F.col("c")[f], lambda f: F.col("s")[f], F.col("status"), F.col("secs")),
    ).first()
    assert r.a.startswith("# Core Insights: T\n\n## Metadata\n- **Authors:** A, B\n- **Journal:** Unknown\n- **Year:** 2020\n- **DOI:** N/A\n- **Paper Type:** research\n- **Status:** error\n- **Extraction Time:** 0s\n")
    assert "### Methodology\n  - m1\n  - m2\n  - Coverage: 0.80\n" in r.a and "### Limitations\n  - Not found\n  - Coverage: 0.00\n" in r.a
    assert r.a.endswith("## Error\n- **Kind:** pdf_corrupt\n- **Detail:** N/A\n- **Suggestion:** retry\n")
    assert r.b == "## 1. T\n- **Status:** error\n- **Paper Type:** research\n- **Journal:** Unknown\n- **Year:** 2020\n- **Research Problem:** Not found\n- **Review Scope:** Not found\n- **Methodology:** m1 | m2\n"
    assert (r["Research Problem"], r.Methodology, r.Method_Coverage, r.Problem_Coverage) == ("", "m1 | m2", "0.80", "0.00")
    e = spark.createDataFrame([(2, "b"), (1, "a")], "n int, e string")
    rule = "-" * 40
    assert reports.search_report(e, "q", "n", "e").first().report == f"# Search Results: q\n\n\na\n\n{rule}\n\nb\n\n{rule}"
    assert "\n".join(x.value for x in reports.report_lines(e, "q", "n", "e").collect()) == f"# Search Results: q\n\n\na\n\n{rule}\n\nb\n\n{rule}"


def test_decks_in_any_form(spark):
    rows = [(1, '{"slides": [{"type": "toc", "bullets": ["a"]}, {"title": "B"}]}'), (2, "---\ntitle: x\n---\n# One\n- a\n---\n# Two"), (3, "1. Intro\n- a\n- b"), (4, " "), (5, None), (6, "{broken")]
    got = D.deck_slides(spark.createDataFrame(rows, "id int, t string"), "id", "t").orderBy("id", "slide_no").collect()
    assert [(r.id, r.type, r.title, r.bullets) for r in got] == [(1, "toc", None, ["a"]), (1, None, "B", None), (2, "content", "One", ["a"]), (2, "content", "Two", []), (3, "cover", "", []), (3, "content", "Intro", ["a", "b"]), (3, "ending", "Thank You", [])]
