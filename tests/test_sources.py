import json

from pyspark.sql import functions as F

from litloom.operators import reports
from litloom.sources import files, sinks
from litloom.streaming import library as stream


def test_pubmed_row(spark):
    xml = """<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A  <i>b</i> c</ArticleTitle><Journal><ISOAbbreviation>J S</ISOAbbreviation><JournalIssue><PubDate><MedlineDate>2001 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal>
    <AuthorList><Author><LastName>Li</LastName><ForeName>Bo</ForeName></Author><Author><CollectiveName>The Group</CollectiveName></Author></AuthorList>
    <Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText Label="END">two</AbstractText></Abstract></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
    r = spark.createDataFrame([(xml,)], "x string").select(files.pubmed_rows(F.col("x")).alias("r")).first().r
    assert (r.title, r.authors, r.year, r.journal, r.doi, r.pmid, r.abstract) == ("A b c", ["Bo Li", "The Group"], "2001", "J S", "10.1/x", "7", "AIM: one END: two")


def test_atom_rows(spark):
    xml = '<feed xmlns="http://x"><entry><id>u1</id><published>2020-01-02</published><title>A\n b</title><summary>s</summary><author><name>X Y</name></author></entry></feed>'
    r = spark.createDataFrame([(xml,)], "x string").select(files.atom_rows(F.col("x")).alias("r")).first().r
    assert [(e.title, e.authors, e.year, e.url) for e in r] == [("A b", ["X Y"], "2020", "u1")]


def test_recorded_pages(spark, tmp_path):
    (tmp_path / "0.json").write_text(json.dumps([{"key": "a", "data": {"t": 1}}, {"key": "b"}]))
    (tmp_path / "2.json").write_text("broken")
    (tmp_path / "4.json").write_text(json.dumps([{"key": "c"}]))
    (tmp_path / "6.json").write_text(json.dumps([{"key": "d"}]))
    got = files.recorded(spark, str(tmp_path), size=2, total=5).collect()
    assert sorted((r.key, r.data) for r in got) == [("a", '{"t":1}'), ("b", "{}"), ("c", "{}")]


def test_problems_of_files(spark, tmp_path):
    for name, body in (("a.pdf", b"%PDF-1.4 /Type /Page "), ("b.pdf", b"%PDF-1.4 /Encrypt 5 0 R"), ("c.pdf", b"%PDF-1.4 /Count 0"), ("d.pdf", b"<html>")):
        (tmp_path / name).write_bytes(body)
    wanted = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",), ("d.pdf",), ("e.pdf",)], "name string")
    got = files.wanted_documents(wanted, "name", files.binary_documents(spark, str(tmp_path))).collect()
    assert {r.name: r.problem for r in got} == {"a.pdf": None, "b.pdf": "encrypted", "c.pdf": "corrupt", "d.pdf": "corrupt", "e.pdf": "missing"}


def test_folders_and_library(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    (tmp_path / "c.pdf").write_bytes(b"")
    assert {r.path[-5:]: r.problem for r in files.binary_documents(spark, str(tmp_path)).collect()} == {"a.pdf": None, "b.pdf": "corrupt"}  # the source skips empty files
    (tmp_path / "l.json").write_text(json.dumps({"papers": [{"title": "A"}], "last_updated": "x"}))
    assert [r.title for r in files.json_library(spark, str(tmp_path / "l.json"), "title string").collect()] == ["A"]
    assert files.json_library(spark, str(tmp_path / "none.json"), "title string").collect() == []
    (tmp_path / "cites.txt").write_text("one\n\n  two \n")
    assert [r.citation for r in files.citation_lines(spark, str(tmp_path / "cites.txt")).collect()] == ["one", "two"]


def test_sheets_and_decks(spark, tmp_path):
    out = str(tmp_path / "s")
    df = spark.createDataFrame([(1, 'A "b"', 9)], "id int, title string, tenths int")
    sinks.write_sheet(df, [F.col("title").alias("Title"), reports.hundredths(F.col("tenths")).alias("Problem_Coverage"), reports.hundredths(F.lit(None).cast("int")).alias("Results_Coverage")], out)
    r = spark.read.option("header", True).option("escape", '"').csv(out).first()
    assert tuple(r) == ('A "b"', "0.90", "0.00")
    sinks.write_json(df, out + "j")
    assert spark.read.json(out + "j").first().tenths == 9
    page = spark.createDataFrame([("<html>", "{}")], "index_html string, deck_json string").first()
    sinks.write_deck(page, str(tmp_path / "deck"))
    assert (tmp_path / "deck" / "index.html").read_text() == "<html>" and (tmp_path / "deck" / "assets" / "style.css").exists()


def test_stream_keeps_the_library(spark, tmp_path):
    src, lib = str(tmp_path / "in"), str(tmp_path / "lib")
    schema = "k string, v string, seq long"
    for rows in ([("a", "1", 0), ("b", "1", 1), ("c", "1", 1)], [("a", "2", 2)], [("d", "1", 0), ("b", "3", 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = stream.keep_library(spark.readStream.schema(schema).parquet(src), lib, ["k"], "seq", str(tmp_path / "cp"), buckets=4)
        q.awaitTermination()
    got = spark.read.parquet(lib)
    assert {r.k: r.v for r in got.collect()} == {"a": "2", "b": "3", "c": "1", "d": "1"} and got.count() == 4


def test_tumbling_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'a' t union all select timestamp'2024-01-01 00:50:00', 'a' union all select timestamp'2024-01-01 01:10:00', 'a'").coalesce(1).write.parquet(src)
    s = stream.tumbling_counts(spark.readStream.schema("ts timestamp, t string").parquet(src), "ts", ["t"], "1 hour", "1 hour")
    q = s.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("hours").collect()) == [1, 2]


def test_small_text_files_are_spread(spark, tmp_path):
    from litloom.sources.tables import spread, table

    spark.range(10).selectExpr("id as doc_id", "'x' as text").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    df = table(spark, str(tmp_path), "documents")
    cores = spark.sparkContext.defaultParallelism
    assert df.count() == 10 and (cores < 2 or df.rdd.getNumPartitions() == cores)
    many = spark.range(0, 100, 1, cores)
    assert spread(many) is many
