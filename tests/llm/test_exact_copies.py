import json

from pyspark.sql import functions as F

from litloom.llm import exact_copies as op

SCHEMA = "file_id long, body string, key string, kind int, n long"


def body(title="A study: of (β-phase) glass", authors=("Ann Ünal", "Bo Li"), journal="J. X", year=2001, doi="10.1/ab.c", **more):
    return json.dumps({"metadata": {"title": title, "authors": authors, "journal": journal, "year": year, "doi": doi}, **more})


def found(spark, rows):
    df = spark.createDataFrame([(i, b, "clash", 7, 7) for i, b in rows], SCHEMA)
    return {tuple(r) for r in op.copies(df, op.canonical_key(F.col("body")), "file_id").collect()}


def test_differences_of_form_only(spark):
    rows = [
        (5, body()),
        (2, body(title="a STUDY – of [β-phase] glass.", year="2001", doi="DOI: 10.1/AB.C")),
        (9, json.dumps({"status": "ok", "metadata": {"doi": "https://r.example/10.1/ab.c", "year": 2001, "journal": "j x", "title": "A  study of\tβ‑phase «glass»", "authors": ["ANN ÜNAL", "bo li"]}}, ensure_ascii=True, indent=1)),
        (1, body(authors=("Bo Li", "Ann Ünal"))),  # the order of authors counts
        (3, body(title="A study of β-phase glass, part II")),
    ]
    assert found(spark, rows) == {(2, 5), (2, 9)}


def test_nulls_and_broken_bodies_belong_to_no_set(spark):
    rows = [(1, None), (2, None), (3, "{not json"), (4, "{not json"), (5, "{}"), (6, "{}"), (7, body(title=None)), (8, body(title="")), (None, body())]
    assert found(spark, rows) == {(7, 8)}
    assert found(spark, []) == set()


def test_a_group_that_crosses_partitions(spark):
    rows = [(i, body(title="hot")) for i in range(400)] + [(1000 + i, body(title=f"single {i}")) for i in range(50)]
    got = found(spark, rows)
    assert got == {(0, i) for i in range(1, 400)}
    df = spark.createDataFrame(rows, "file_id long, body string")
    n = {r.first_id: r.n_copies for r in op.representatives(df, op.canonical_key(F.col("body")), "file_id").collect()}
    assert n[0] == 400 and sum(n.values()) == 450 and len(n) == 51


def test_representatives_count_every_row(spark):
    df = spark.createDataFrame([(k, f"k{k % 7}" if k else None) for k in range(100)], "id long, key string")
    got = {r.first_id: r.n_copies for r in op.representatives(df, F.col("key"), "id").collect()}
    assert sum(got.values()) == 99 and set(got) == {1, 2, 3, 4, 5, 6, 7}
