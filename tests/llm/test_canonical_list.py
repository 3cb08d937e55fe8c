from pyspark.sql import functions as F

from litloom.llm import canonical_list as op

LIST = [(1, "Annals of Acoustic Ecology", None), (2, "Annals of Acoustic Geology", "formerly Notes on Tidal Optics"), (3, "Tidal Optics Reviews", None), (4, "Zeitschrift für Tidal Optics", None), (5, "湿地化学学报", None), (6, None, None), (7, "Annals of Acoustic Ecology", "copy")]


def known(spark):
    return op.entries(spark.createDataFrame(LIST, "journal_id long, name string, notes string"), "journal_id", "name", "notes", spark.createDataFrame([("Ann. Acoust. Ecol.", "Annals of Acoustic Ecology"), (None, "x"), ("x", None)], "abbrev string, full_name string"))


def test_values(spark):
    e = known(spark)
    for value, want in {
        "annals  of ACOUSTIC ecology.": 1, "Ann. Acoust. Ecol. 118(55)": 1, "Annals of Acoustic Eco1ogy, Vol. 3": 1, "Acoustic Ecology, Annals of": 1, "The Aimals of the Acoustic Ecology": 1,
        "Ann Acoust Geol": 2, "Notes on Tidal Optics": 2, "Tidal Opt. Rev.": 3, "Z. Tidal Opt.": 4, "Zeitschrift fuer Tidal Optlcs": 4, "《湿地 化学学报》(2006)": 5,
        "Annals of Acoustic Optics": -1, "Tidal Optics Letters": -1, "QuickRead Server": -1, "Record of Tidal Optics": -1,
        None: None, "": None, " ": None, "N/A": None, "Unknown": None, "-": None, "n.a.": None, "not found": None,
    }.items():
        assert e.map(value) == want, value


def test_rows(spark):
    df = spark.createDataFrame([(1, "Tidal Optics Reviews", 0), (1, "Tidal Optics Reviews", 0), (2, None, 0), (3, "N/A", 0), (4, "x" * 20000, 0)], "rec_id long, j string, entry_id int")
    got = sorted(tuple(r) for r in op.mapped(df, "rec_id", F.col("j"), known(spark)).collect())
    assert got == [(1, 3), (1, 3), (4, -1)]
    assert op.mapped(df.limit(0), "rec_id", F.col("j"), known(spark)).collect() == []
    empty = op.entries(spark.createDataFrame([], "journal_id long, name string, notes string"), "journal_id", "name", "notes")
    assert {r.entry_id for r in op.mapped(df, "rec_id", F.col("j"), empty).collect()} == {-1}


def test_long_names_in_any_order():
    name = "Annals of Tidal Optics Plasma Ecology Glacier Archive Sediment Records"
    known = op.Entries([(5, name), (6, "Annals of Tidal Optics")])
    words = name.replace(" of", "").split()
    assert known.map(" ".join(words[3:] + words[:3])) == 5
    assert known.map(" ".join(reversed(words))) == 5
    assert known.map(" ".join(words[1:])) == -1


def test_tokens_by_trie_as_by_all_words():
    import random

    from litloom.llm.glyphs import distance

    rng = random.Random(5)
    words = ["".join(rng.choice("abno") for _ in range(rng.randint(4, 9))) for _ in range(300)]
    trie = op.Words((w, w) for w in words)
    for w in words[:60]:
        near, _ = trie.walk(w, 2)
        assert near == {x: d for x in words if (d := distance(w, x, 2)) <= 2}


def test_cheapest_assignment():
    import itertools
    import random

    rng = random.Random(6)
    for n in (1, 2, 3, 5):
        costs = [[rng.randint(0, 9) for _ in range(n)] for _ in range(n)]
        assert op.cheapest(costs) == min(sum(costs[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
