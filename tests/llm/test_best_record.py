from litloom.llm import best_record as op
from litloom.llm.canonical_list import Entries

E = "rec_id long, origin string, metadata struct<title: string, authors: array<string>, journal: string, year: int, doi: string>, group_id string"
G = "group_id long, rec_id long"


def found(spark, groups, recs):
    e = spark.createDataFrame([(i, o, (None, a, j, y, d) if m else None, "clash") for i, o, m, a, j, y, d in recs], E)
    got = op.best(spark.createDataFrame(groups, G), e, Entries([(3, "Tidal Optics Reviews")])).collect()
    out = {}
    for r in got:
        assert r.field not in out.setdefault(r.group_id, {})
        out[r.group_id][r.field] = r.best_value
    return out


def test_fields(spark):
    recs = [
        (1, "publisher", True, ["Zoë Kintouvegurm", "Bo Trainexeojail", "KINTOUVEGURM, Zoe"], "N/A", 2014, " 10.99016/Sieve2014.00008357;"),
        (2, "publisher", True, None, "Tidal Optlcs Rev.", 2015, "10.99016/sieve2014.0000"),
        (3, "scan", True, ["Kintouvegurm Z"], "Tidal Optics Reviews", 2051, "10.99016/sieve2O14.000083S7"),
        (4, "preprint", True, ["Zoë Kintouvegurm", "B. Trainexeojail", "Cy Moxurtuclesk"], "QuickRead Server", 2014, "10.97001/openshelf.00008357"),
        (5, "repository", False, None, None, None, None),
        (6, "repository", False, None, None, None, None),
    ]
    groups = [(1, k) for k in (1, 2, 3, 4, 5)] + [(1, 1), (2, 6), (3, 99), (None, 1)]
    got = found(spark, groups, recs)
    assert got[1] == {"doi": "10.99016/sieve2014.00008357", "journal": "3", "year": "2015", "authors": "3"}
    empty = {"doi": None, "journal": "-1", "year": None, "authors": "0"}
    assert got[2] == empty and got[3] == empty and set(got) == {1, 2, 3}
    assert found(spark, [], recs) == {}


def test_a_hot_group(spark):
    recs = [(i, "publisher", True, ["Zoë Kintouvegurm"], "Tidal Optics Reviews", 2015, "10.99016/s2015.00000001") for i in range(3000)]
    assert found(spark, [(1, i) for i in range(3000)], recs)[1] == {"doi": "10.99016/s2015.00000001", "journal": "3", "year": "2015", "authors": "1"}


def authors(*lists):
    return op.count_authors([(op.author_tokens(names), "", w) for names, w in lists])


def test_author_lists_vote_by_column():
    full = ["Zoë Kintouvegurm", "Bo Trainexeojail", "Cy Moxurtuclesk"]
    assert authors((full, 12), ([full[0], "Xy Qqqqqqq", full[2]], 3)) == "3"  # misread beyond recognition
    assert authors((full, 12), ([full[0], "Dan Wolzerapint", *full[1:]], 3)) == "3"  # a stray name, outvoted
    assert authors((full[:1] + full[2:], 3), (full, 12)) == "3"  # lacking in the lighter list
    assert authors((full[:1], 12), (full, 1)) == "3"  # a cut list doesn't vote against what it lacks
    assert authors((full, 6), (full[::-1], 6)) == "3"


def test_more_than_six_spellings():
    name = "kintouvegurmas"
    spelt = [["Bo K" + "x" * k + name[1 + k :]] for k in range(9)]
    assert authors(*((s, 20 - k) for k, s in enumerate(spelt))) == "1"


def test_hot_groups_split_give_what_whole_ones_give(spark):
    import random

    rng = random.Random(4)
    full = ["Zoë Kintouvegurm", "Bo Trainexeojail", "Cy Moxurtuclesk", "Dan Wolzerapint"]
    recs = []
    for i in range(400):
        doi = list("10.99016/sieve2014.00008357")
        doi[rng.randint(10, 25)] = rng.choice("0123456789abcdef")
        names = [n if rng.random() < 0.8 else n.replace("o", "0") for n in full if rng.random() < 0.9]
        recs.append((i, rng.choice(("publisher", "scan")), True, names, "Tidal Optics Reviews", 2014 + (rng.random() < 0.2), "".join(doi)))
    groups = [(1 + i % 2, i) for i in range(400)] + [(3, 0)]
    e = spark.createDataFrame([(i, o, (None, a, j, y, d), "clash") for i, o, m, a, j, y, d in recs], E)
    g = spark.createDataFrame(groups, G)
    known = Entries([(3, "Tidal Optics Reviews")])
    rows = lambda hot: {(r.group_id, r.field): r.best_value for r in op.best(g, e, known, hot).collect()}
    whole, split = rows(5000), rows(20)
    assert whole == split | {k: v for k, v in whole.items() if k[1] == "doi" and k[0] < 3}
    assert all(split[k, "authors"] == "4" for k in (1, 2))
    assert sum(a != b for a, b in zip(split[1, "doi"], "10.99016/sieve2014.00008357")) <= 1


def test_years():
    assert [op.clean_year(y, 2024) for y in (None, 0, 1900, 1899, 2025, 2026, 9999)] == [None, None, None, 1899, 2025, None, None]
    assert op.clean_year(2051) == 2051
