from litloom.llm import keyless_match as op

P = "hit_id long, title string, authors array<string>, year string, rec_id long"
E = "rec_id long, metadata struct<title: string, authors: array<string>, journal: string, year: int, doi: string>, hit_id long"
BULK = ["granular tide shapes channel in rapid mesh networks", "coastal plume driven by optical foam and porous glass: a fine study", "towards stable reef: compact design and kernel limits", "active layer in mesh foam composites: part I", "active layer in mesh foam composites: part II"]


def sides(spark, hits, recs):
    p = spark.createDataFrame([(i, t, a, y, 0) for i, t, a, y in hits], P)
    e = spark.createDataFrame([(i, (t, a, None, y, None) if t != "error" else None, 0) for i, t, a, y in recs], E)
    return op.sides(p, e), e


def found(spark, hits, recs):
    (a, b), _ = sides(spark, hits, recs)
    return {(r.id, r.id_b): r.rule for r in op.cascade(a, b).collect()}


def test_rules(spark):
    filler = [(900 + k, t, [f"Ann Filler{k}name"], 1990) for k in range(12) for t in BULK]
    recs = filler[:] + [
        (1, "Granular tide shapes channel in rapid mesh networks", ["Zoë Kintouvegurm"], 2001),
        (2, "coastal plume driven by optical foam and porous glass", ["Bo Trainexeojail", "Cy Moxurtuclesk"], 2002),
        (3, "Unknown", ["Bo Trainexeojail", "Cy Moxurtuclesk"], 2011),
        (4, "active layer in mesh foam composites: part I", ["Zoë Kintouvegurm"], 2003),
        (5, None, None, None),
        (6, "error", None, None),
    ]
    hits = [
        (10, "<i>GRANULAR</i> channel tide shapes in rapid rnesh networks", ["Kintouvegurm, Z."], "2001"),
        (20, "Coastal plume driven by optical foam and porous glass: a fine study", ["Trainexeojail B"], "2002"),
        (30, "", ["Trainexeojail, B.", "Moxurtuclesk, C."], "2011"),
        (40, "Active layer in mesh foam composites: part II", ["Zoë Kintouvegurm"], "2004"),
        (50, None, None, None),
    ]
    got = {k: v for k, v in found(spark, hits, recs).items() if k[1] < 900}
    assert got == {(10, 1): 1, (20, 2): 3, (30, 3): 4}


def test_empty(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [(1, "a title of many words here", None, None)], []) == {}


def test_confidence_is_smoothed(spark):
    (_, b), e = sides(spark, [], [(1, "granular tide shapes channel networks", ["Zoë Kintouvegurm"], 2001), (2, "granular tide shapes channel networks", ["Zoë Kintouvegurm"], 2001), (3, "granular tide shapes channel networks", ["Zoë Kintouvegurm"], 2001)])
    groups = spark.createDataFrame([(7, 1), (7, 2)], "group_id long, rec_id long")
    got = {r.rule: r.confidence for r in op.confidences(b, groups).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5, 4: 0.5}  # two of four labelled pairs are right: (2 + 1) / (4 + 2)
