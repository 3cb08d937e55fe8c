import pytest
from pyspark.sql import functions as F

from litloom.operators import blocks as B
from litloom.operators import insights as I

PAPER = """Deep sieves for filtration
by Ada Lovelace and Grace Hopper
Published in Journal of Sieves, 2024
doi: 10.1000/sieve.7.

Abstract
We propose a sieve that separates particles by size. It runs at room temperature and needs no pump at all in practice.

1. Introduction
Clogging is a long standing problem in filtration plants everywhere. Many groups have tried coarser meshes. Our aim is to remove that challenge at low cost.

2. Methods
We design a layered mesh from steel. The approach stacks three grids at angles. The model predicts flow through each grid.

3. Results
The result shows a throughput of 41 litres per hour. We measure no loss of purity. Tests achieve 98.5 percent recovery.

4. Discussion
Unlike older devices the mesh is reusable. A limitation is the cost of steel. The device has potential for small clinics.

5. Conclusion
The first layered sieve works well. Future work will address corrosion.
"""


@pytest.fixture(scope="module")
def paper(spark):
    return I.sections(spark.createDataFrame([(1, PAPER), (2, ""), (3, None)], "id long, text string"), "id", "text")


def test_sections(paper):
    r = paper.where("id = 1").first()
    at = {n: (PAPER.index(r[n]), PAPER.index(r[n]) + len(r[n])) for n in ("abstract", "introduction", "methodology", "results", "discussion", "conclusion")}
    assert at == {"abstract": (118, 247), "introduction": (247, 421), "methodology": (421, 556), "results": (556, 688), "discussion": (688, 825), "conclusion": (825, 913)}
    assert r.taxonomy is None
    assert paper.where("id > 1").select("abstract").distinct().collect()[0][0] is None


def test_research_fields_and_coverage(paper):
    found = I.research_insights(paper, "id")
    r = found.where("id = 1").first()
    assert r.research_problem == ["Introduction\nClogging is a long standing problem in filtration plants everywhere Our aim is to remove that challenge at low cost.."]
    assert r.methodology == ["Methods\nWe design a layered mesh from steel The approach stacks three grids at angles The model predicts flow through each grid.."]
    assert r.key_results == ["Results\nThe result shows a throughput of 41 litres per hour", "Tests achieve 98.5 percent recovery."]
    assert r.innovation == ["Discussion\nUnlike older devices the mesh is reusable", "Conclusion\nThe first layered sieve works well"]
    assert r.application == ["The device has potential for small clinics.."]
    assert r.limitations == ["A limitation is the cost of steel", "Future work will address corrosion"]
    wide = {x.id: x for x in I.research_coverage(paper, "id").collect()}
    assert [wide[1][c] for c in found.columns[1:]] == [10, 10, 10, 10, 8, 10]
    assert set(wide[2][1:]) == {0} and set(wide[3][1:]) == {0}


REVIEW = """Sieves: a systematic review
1. Introduction
This review gives an overview of the field of sieves and of their current status in plants.

2. Search strategy
We searched one database with fixed inclusion criteria and a screening of all titles found.

3. Taxonomy
Sieves are grouped into meshes and membranes, a classification that most authors share now.

4. Discussion
The evidence suggests a consensus that meshes clog first, though conflicting reports do exist.
Figure 1: Overview of the classification of sieves used in this text
5. Limitations
Risk of bias was high in most studies, and the sample size of many of them was rather small.

6. Future directions
The next step should be a common benchmark, and standards that all groups need to report by.
"""


def test_both_kinds_in_one_projection(spark):
    docs = spark.createDataFrame([(1, PAPER, "Deep sieves"), (2, REVIEW, None), (3, "", "A survey of sieves"), (4, None, None)], "id long, text string, title string")
    secs = I.sections(docs, "id", "text", "title")
    found = I.insights(secs, "id", I.paper_type(F.col("full_text"), F.col("title")) == "review", "title")
    r = {x.id: x for x in I.batch_summary(found, "id", "title").collect()}
    assert len(I.batch_summary(found, "id").columns) == 2 + 17
    assert r[1].paper_type == "research" and [r[1][c] for c in I.RESEARCH_FIELDS] == [10, 10, 10, 10, 8, 10] and not any(r[1][c] for c in I.REVIEW_FIELDS)
    assert r[2].paper_type == "review" and not any(r[2][c] for c in I.RESEARCH_FIELDS)
    assert r[2].review_type == 8 and r[2].key_tables_figures == 10 and r[2].evidence_quality == 10 and r[2].future_directions == 10
    assert r[3].paper_type == "review" and r[3].review_type == 5
    core = found.where("id = 2").first().core
    assert core.review_type == ["Systematic review"] and core.research_problem is None and core.key_tables_figures == ["Figure 1: Overview of the classification of sieves used in this text"]
    assert found.where("id = 4").first().paper_type == "research"
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString() and "Exchange" not in found._jdf.queryExecution().toString()


def test_metadata(spark):
    d = spark.createDataFrame([(PAPER,), ("we are doing it",)], "t string").select(I.byline_names(F.col("t")).alias("a"), I.journal_of(F.col("t")).alias("j"), I.year_of(F.col("t")).alias("y"), I.doi_of(F.col("t")).alias("d"), I.doi_of(F.col("t"), True).alias("s"), I.paper_type(F.col("t")).alias("p")).collect()
    assert tuple(d[0]) == (["Ada Lovelace", "Grace Hopper"], "Journal of Sieves", 2024, "10.1000/sieve.7.", "10.1000/sieve.7.", "research")
    assert tuple(d[1]) == ([], None, None, "ng", None, "research")


def test_review_ladders(spark):
    d = spark.createDataFrame([("A systematic review",), ("A survey. We propose, we develop",), ("meta analysis of PRISMA",), ("none",)], "t string").select(I.review_type(F.col("t")), I.paper_type(F.col("t"))).collect()
    assert [tuple(x) for x in d] == [("Systematic review", "review"), ("Survey review", "research"), ("Meta-analysis", "review"), ("Review type not explicit", "research")]


def test_blocks(spark):
    text = "1.2 Theorem one\nIt holds.\n\n  \n\nWe propose $x^2$ and more.\n\nplain " + "word " * 130
    got = B.blocks(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t").orderBy("pos").collect()
    assert [(r.type, r.title[:11], r.importance, r.n_formulas) for r in got] == [("theorem", "Theorem one", 90, 0), ("formula", "We propose ", 75, 1), ("other", "plain word ", 55, 0)]
    assert [r.rank for r in B.top_blocks(B.blocks(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t"), "id", 2).orderBy("rank").collect()] == [1, 2]


def test_error_kinds(spark):
    d = spark.createDataFrame([("File is ENCRYPTED",), ("unexpected EOF",), ("other",), ("MemoryError: page",), ("'utf-8' codec can't decode",)], "m string").select(I.error_kind(F.col("m"))).collect()
    assert [r[0] for r in d] == ["pdf_encrypted", "pdf_corrupt", "unknown", "pdf_too_large", "encoding"]
