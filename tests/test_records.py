import json

from pyspark.sql import functions as F

from litloom.operators import journals as J
from litloom.operators import library as L
from litloom.operators import search as S
from litloom.operators import validate

P = "ord long, source string, title string, url string, doi string"


def test_first_seen_keeps_the_first(spark):
    rows = [(0, "a", "A", "u", None), (1, "a", " a ", "u", ""), (2, "b", "A", "u", None), (3, "a", "B", "u", None), (4, None, None, None, None), (5, None, None, None, None)]
    assert sorted(r.ord for r in S.first_seen(spark.createDataFrame(rows, P), "ord").collect()) == [0, 2, 3, 4]
    assert S.first_seen(spark.createDataFrame([], P), "ord").collect() == []


def test_upsert_replaces_whole_rows_in_place(spark):
    lib = spark.createDataFrame([("k1", "old", "x", 0), ("k2", "b", None, 1)], "k string, abstract string, note string, seq long")
    new = spark.createDataFrame([("k1", "new", None, 2), ("k3", "c", "n", 3), ("k3", "d", "m", 4)], "k string, abstract string, note string, seq long")
    got = {r.k: (r.abstract, r.note, r.position) for r in S.upsert(lib, new, ["k"], "seq").collect()}
    assert got == {"k1": ("new", None, 0), "k2": ("b", None, 1), "k3": ("d", "m", 3)}


def test_metrics_join_in_three_tiers(spark):
    m = spark.createDataFrame([(1, "Nature", "9"), (2, "J. Phys. Chem. Lett.", "5"), (3, "J Phys Chem Lett", "4"), (4, "Annals of Sieves", "3")], "journal_id long, name string, impact_factor string")
    a = spark.createDataFrame([("Ann. Sieves", "Annals of Sieves")], "abbrev string, full_name string")
    p = spark.createDataFrame([(1, "Nature"), (2, "nature"), (3, "j phys chem lett"), (4, "ANN SIEVES"), (5, "Nature Communications"), (6, None), (7, "")], "hit_id long, journal string")
    got = {r.hit_id: (r.matched_by, r.metrics.journal_id if r.metrics else None) for r in J.with_metrics(p, m, a, F.col("journal")).collect()}
    assert got == {1: ("name", 1), 2: ("normalised", 1), 3: ("normalised", 2), 4: ("abbreviation", 4), 5: ("none", None), 6: ("none", None), 7: ("none", None)}


def test_overlay_replaces_rows(spark):
    base = spark.createDataFrame([("Nano", True), ("Nature", False)], "name string, is_top_journal boolean")
    over = spark.createDataFrame([("Nano", "Q1")], "name string, JCR string")
    got = {r.name: (r.jcr_partition, r.is_top_journal) for r in J.normalised_metrics(J.overlay(base, over)).collect()}
    assert got == {"Nano": ("Q1", False), "Nature": ("N/A", True)}


def test_ratio_is_of_matched_blocks(spark):
    d = spark.createDataFrame([("layered sieve for filtration", "layered sieves for filtration"), ("abc", "xyz"), (None, "x")], "a string, b string").select(L.ratio("a", "b").alias("r"), L.ratio_bound(F.col("a"), F.col("b")).alias("m")).collect()
    assert round(d[0].r, 8) == 0.98245614 and d[1].r == 0 and d[2].r is None and d[0].r <= d[0].m


def test_children_and_lines(spark):
    items = spark.createDataFrame([("a",), ("b",)], "key string")
    kids = spark.createDataFrame([("a", 1), ("a", 2)], "key string, n int")
    assert [r.key for r in L.has_children(items, kids, "key").collect()] == ["a"]
    assert [r.key for r in L.has_children(items, kids, "key", False).collect()] == ["b"]
    assert {r.key: r.pdf for r in L.flag_children(items, kids, "key", "pdf").collect()} == {"a": True, "b": False}
    d = spark.createDataFrame([(["Ada Lovelace", "", "X Y", "Z"], "2001-02", 'A/b: "c"?')], "n array<string>, d string, t string")
    assert tuple(d.select(L.creators_line(F.col("n")), L.leading_year(F.col("d")), L.attachment_name(F.col("t"))).first()) == ("Lovelace, ?, Y et al.", "2001", "A_b_ _c__.pdf")


def test_work_item(spark):
    body = json.dumps({"DOI": "10.1/x", "title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "issued": {"date-parts": [[2001, 2]]}, "container-title": ["J"], "ISSN": ["1"]})
    r = spark.createDataFrame([(body,)], "b string").select(L.work_item(F.col("b")).alias("i")).first().i
    assert (r.title, r.DOI, r.date, r.publicationTitle, [(c.firstName, c.lastName) for c in r.creators], r.volume) == ("T", "10.1/x", "2001-2", "J", [("A", "B"), ("", "C")], "")


def test_rules(spark):
    d = spark.createDataFrame([("Introduction\nMethodology  Challenges conclusion",), ("the reviewer\nmisunderstood",), (None,)], "t string")
    assert validate.validated(d, F.col("t"), "literature-review").first().passed
    r = validate.validated(d, F.col("t"), "rebuttal").where("t like '%misunderstood'").first()
    assert not r.passed and r.banned_phrases == ["reviewer misunderstood"]
    assert validate.validated(d, F.col("t"), "rebuttal").where("t is null").first().missing_required == ["Reviewer concern", "Response", "Revision plan"]


def test_report_entry(spark):
    d = spark.createDataFrame([(None, ["A", "B", "C", "D"], None, None, "x" * 301), ("T", [], "J", "2001", None)], "t string, a array<string>, j string, y string, b string")
    got = [r.e for r in d.select(S.entry_markdown(F.lit(1), F.col("t"), F.col("a"), F.col("j"), F.col("y"), F.col("b"), F.lit(True)).alias("e")).collect()]
    assert got[0] == "## 1. * Untitled\n**Authors**: A, B, C et al.\n**Journal**: Unknown (n.d.)\n**Abstract**: " + "x" * 300 + "..."
    assert got[1] == "## 1. * T\n**Authors**: Unknown\n**Journal**: J (2001)"


def test_summaries_as_items(spark):
    body = json.dumps({"title": "T", "fulljournalname": "J", "pubdate": "2001 Jan", "articleids": [{"idtype": "doi", "value": "a"}, {"idtype": "doi", "value": "b"}], "authors": [{"name": "Lovelace Ada King", "authtype": "Author"}, {"name": "Li", "authtype": "Author"}, {"name": "G", "authtype": "CollectiveName"}]})
    i = spark.createDataFrame([(body,), ("{}",)], "b string").select(L.summary_item(F.col("b")).alias("i")).collect()
    assert [(c.lastName, c.firstName) for c in i[0].i.creators] == [("Lovelace", "Ada King"), ("Li", "")] and (i[0].i.DOI, i[0].i.date, i[0].i.title) == ("b", "2001 Jan", "T")
    assert i[1].i.creators == [] and i[1].i.DOI == ""


def test_citations_against_the_library(spark):
    c = spark.createDataFrame([("A study of sieves, 2001", "A Study of Sieves"), ("Something else", "A study of sieves"), ("B", None), ("Gone from here", "Gone from here")], "citation string, resolved string")
    lib = spark.createDataFrame([("a study of sieves", 1), ("A STUDY OF SIEVES", 2), (None, 3)], "title string, pos int")
    got = {r.citation: (r.in_library, r._item.pos if r._item else None) for r in L.checked_citations(c, "citation", "resolved", lib, "title", "pos").collect()}
    assert got == {"A study of sieves, 2001": (True, 2), "Something else": (False, None), "B": (False, None), "Gone from here": (False, None)}
    assert L.checked_citations(c.limit(0), "citation", "resolved", lib, "title", "pos").count() == 0


def test_missing_dois(spark):
    rows = [("a", "Layered sieves for filtration", None, "journalArticle", "Layered Sieves for Filtration.", "10.1/a"), ("b", "Layered sieves", "", "journalArticle", "Something", "10.1/b"), ("c", "T", None, "note", "T", "10.1/c"), ("d", "T", "10.1/d", "book", "T", "x"), ("e", "T", None, "book", "T", None)]
    d = spark.createDataFrame(rows, "key string, title string, doi string, kind string, c_title string, c_doi string")
    assert [(r.key, r.found_doi) for r in L.completed_dois(d, "title", "doi", "kind", "c_title", "c_doi").collect()] == [("a", "10.1/a")]
    assert sorted(r.key for r in L.without_doi(d, "doi", "kind").collect()) == ["a", "b", "e"]


def test_library_surface(spark):
    d = spark.createDataFrame([("k1", "Sieves", ["Ada"], ["x", "y"], None), ("k2", None, ["Bo"], ["y", None], "f.pdf")], "key string, title string, creators array<string>, tags array<string>, file string")
    assert [r.key for r in L.found_items(d, "SIEVE", ["title", "creators"], "key").collect()] == ["k1"]
    assert json.loads(L.item_of(d, "key", "k2").first().item)["file"] == "f.pdf"
    assert sorted(r.tag for r in L.tags_of(d, "tags").collect()) == ["x", "y"]
    got = [tuple(r) for r in d.select(L.child_line(F.col("key"), F.lit("note"), F.col("title"), F.col("file")), L.collection_line(F.col("key"), F.col("title"), F.lit(None).cast("int")), L.item_line(F.col("key"), F.col("creators"), F.lit("2001-2"), F.col("title"), F.lit(None).cast("string"))).collect()]
    assert got == [("[k1] note: Sieves", "[k1] Sieves (0 items)", "[k1] Ada (2001) Sieves [?]"), ("[k2] note: f.pdf", "[k2] untitled (0 items)", "[k2] Bo (2001) untitled [?]")]


def test_chosen_sources(spark):
    a, w = spark.range(30).withColumnRenamed("id", "ord"), spark.range(30).withColumnRenamed("id", "ord")
    count = lambda *x: {r.src_rank: r["count"] for r in S.chosen_sources({"arxiv": a, "wos": w}, "ord", *x).groupBy("src_rank").count().collect()}
    assert count() == {0: 30, 1: 10} and count("arxiv") == {0: 30} and count("all", 5) == {0: 5, 1: 5}
    try:
        count("none")
    except ValueError:
        return
    raise AssertionError
