import itertools
import random

from pyspark.sql import functions as F

from litloom.llm import author_names as op
from litloom.llm.glyphs import distance

SCHEMA = "rec_id long, metadata struct<authors: array<string>, name: string>, author string"
SAME = [
    ["Jürgen Bentaisaiveirt", "Bentaisaiveirt, J.", "J Bentaisaiveirt", "bentaisaiveirt jürgen", "Jurgen Bentaisaiveirt", "Dr. Jürgen  Bentaisaiveirt*", "Jürgen Bentaisaivcirt", "BENTAISAIVEIRT, Jürgen"],
    ["Dorothy Brermoxiasirt", "Dolly Brermoxiasirt", "Brermoxiasirt D", "Dorotby Brermoxiasirt", "Dorothy Breroxiasirt"],
    ["Thomas Brermoxiasirt", "T. K. Brermoxiasirt", "Tom Brermoxiasirt, PhD"],
    ["Shustiathikram Coral Hydrology Consortium", "The Shustiathikram Coral Hydrology Consortium", "Shustiathikram CHC", "Consortium Shustiathikram Coral Hydrology", "Shustiathikram Cor. Hydr. Cons.", "on behalf of the Shustiathikram-Coral Hydrology Consortium (CHC)"],
    ["Zoë Kintouvegurm"],
]


def found(spark, lists):
    df = spark.createDataFrame([(i, (l, "x") if l != "null" else None, "clash") for i, l in enumerate(lists)], SCHEMA)
    got = [tuple(r) for r in op.pairs(op.authors(df, F.col("metadata.authors"))).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_spellings_of_one_author(spark):
    want = {tuple(sorted(p)) for g in SAME for p in itertools.combinations(g, 2)}
    lists = [[n] for g in SAME for n in g] + [["Jürgen Bentaisaiveirt"]] * 5 + [["Dorothy Brermoxiasirt"]] * 5
    assert found(spark, lists) == want


def test_nulls_and_empty(spark):
    assert found(spark, [None, [], [None], [""], ["  "], ["***"], "null", ["Zoë Kintouvegurm", "Zoë Kintouvegurm"]]) == set()
    assert found(spark, []) == set()


def test_many_spellings_are_paired_in_blocks(spark):
    names = ["Zoë" + " " * k + "Kintouvegurm" for k in range(1, 600)]
    got = found(spark, [[n] for n in names])
    assert len(got) == len(names) * (len(names) - 1) // 2


def test_trie_finds_all_within_one_edit():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(3, 7))) for _ in range(400)})
    trie = op.Trie()
    for w in words:
        trie.add(w, (1, w))
    for w in words[:150]:
        assert {x for _, x in trie.near(w)} == {x for x in words if distance(w, x, 1) <= 1}


def test_ambiguous_initials_join_nobody():
    got = op.persons([("richard", "", 5, 5), ("robert", "", 5, 5), ("", "r", 2, 0), ("", "k", 1, 0)])
    assert len({got["richard", ""], got["robert", ""], got["", "r"], got["", "k"]}) == 4


def test_names_that_differ_by_one_letter_stay_apart():
    got = op.persons([("ramesh", "", 3, 40), ("rajesh", "", 9, 60), ("rajfsh", "", 1, 1), ("bob", "", 1, 9), ("robert", "", 1, 9)])
    assert got["ramesh", ""] != got["rajesh", ""] == got["rajfsh", ""] and got["bob", ""] == got["robert", ""]


def test_orders_of_names_on_no_list(spark):
    people = [("Rajesh", "Kumar"), ("Olumide", "Okafor"), ("Priya", "Raghunathan"), ("Wei", "Zhang"), ("Emma", "Lindqvist"), ("Thabo", "Mokoena"), ("Sakura", "Fujimoto"), ("Bogdan", "Ionescu")]
    for g, f in people:
        forms = [f"{g} {f}", f"{f} {g}", f"{f}, {g}", f"{f}, {g[0]}.", f"{g[0]}. {f}", f"{g} X. {f}"]
        got = found(spark, [[n] for n in forms])
        assert len(got) == 15, (g, f, got)


def test_chains_of_any_length(spark):
    chain = ["aaaaaaaaaaaa"[: 12 - k] + "bbbbbbbbbbbb"[:k] for k in range(12)]
    df = spark.createDataFrame([(w, 2 ** k) for k, w in enumerate(chain)], "word string, n long")
    assert {r["root"] for r in op.linked(df).collect()} == {chain[-1]}


def test_shards_meet_all_within_one_edit():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("xyz") for _ in range(rng.randint(2, 9))) for _ in range(500)})
    for a in words[:200]:
        for b in words:
            if a != b and distance(a, b, 1) <= 1:
                assert op._pieces(a) & op._pieces(b), (a, b)
