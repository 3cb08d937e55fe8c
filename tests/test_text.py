from pyspark.sql import Row
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V
from litloom.operators import outline as O


def one(spark, col, **values):
    return spark.createDataFrame([Row(**values)]).select(col.alias("x")).first().x


def test_shorten_may_end_longer(spark):
    assert one(spark, T.shorten(F.col("t"), 5), t="xxxxxxxxxx") == "xxxx..."
    assert one(spark, T.shorten(F.col("t"), 5), t="xxxxx") == "xxxxx"
    assert one(spark, T.shorten(F.col("t"), 5), t="ab  cd") == "ab..."


def test_sentences_and_keywords(spark):
    text = "We propose a sieve. It runs!  Our aim is dry?\nDone."
    assert one(spark, T.sentences(F.col("t")), t=text) == ["We propose a sieve", "It runs", "Our aim is dry", "Done."]
    assert one(spark, T.keyword_sentences(F.col("t"), V.RESEARCH["problem"]), t=text) == ["We propose a sieve", "Our aim is dry"]
    # keywords are substrings, on purpose
    assert one(spark, T.keyword_sentences(F.col("t"), ("use", "new")), t="Because of it. Renewed.") == ["Because of it", "Renewed."]


def test_first_distinct_keeps_order(spark):
    assert one(spark, T.first_distinct(F.col("a")), a=["B b", "a", "b B", "A", "c"]) == ["B b", "a", "c"]
    assert one(spark, T.compact_hits(F.col("t"), ("gap",), 2, least=5), t="A  gap\tis. a gap is. Gap two here. Gap three.") == ["A gap is", "Gap two here"]


def test_summary_drops_marks(spark):
    assert one(spark, T.summary(F.col("t"), 2), t="One two. Three! Four.") == "One two. Three."
    assert one(spark, T.summary(F.col("t"), 2), t="Only one.") == "Only one.."
    assert one(spark, T.summary(F.col("t"), 2), t="") is None


def test_emphasis_goes_by_list_order(spark):
    assert one(spark, T.emphasised(F.col("t"), V.EMPHASIS), t="A Method for a problem") == "A Method for a **problem**"
    assert one(spark, T.emphasised(F.col("t"), V.EMPHASIS), t="nothing") == "nothing"


def test_markup_is_escaped_first(spark):
    got = one(spark, T.inline_markup(F.col("t")), t="<script> & **x** ==y==")
    assert got == '&lt;script&gt; &amp; <span class="text-highlight">x</span> <span class="text-highlight">y</span>'


def test_names_and_keys(spark):
    assert one(spark, T.normalised_name(F.col("t")), t=" J. Phys. (Chem) Lett. ") == "j phys chem lett"
    assert one(spark, T.redacted_keys(F.col("t")), t="http://x?api_key=abc123&q=1") == "http://x?api_key=[REDACTED]&q=1"


def test_title_classes(spark):
    assert one(spark, T.width_hundredths(F.col("t"), V.WIDTHS), t="ab c中") == 55 * 3 + 35 + 100
    for n, want in ((10, "title-fit-normal"), (70, "title-fit-long"), (106, "title-fit-xlong"), (150, "title-fit-xxlong")):
        assert one(spark, O.title_fit(F.col("t")), t="x" * n) == want
    assert one(spark, O.motif(F.col("t"), F.col("b")), t="MRI of risk", b="") == "motif-bio"
    assert one(spark, O.motif(F.col("t"), F.col("b")), t="Energy", b="drug") == "motif-mechanism"
    assert one(spark, O.motif(F.col("t"), F.col("b")), t="x", b="y") == "motif-general"
