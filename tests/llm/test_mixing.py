import os

import pytest

from litloom.llm import byte_bpe, mixing as op

pytestmark = pytest.mark.skipif(not os.path.exists(byte_bpe.VOCABULARY), reason="no vocabulary file")
TARGETS = "mix_id string, source string, target_share double, max_repeats int"


def test_shares_caps_and_copies(spark):
    docs = [(i, f"text number {i} of the big source", "big") for i in range(300)] + [(1000 + i, f"small {i} words here", "small") for i in range(40)]
    docs += [(2000 + i, "text number 1 of the big source", "small") for i in range(20)]  # copies of one text
    docs += [(3000, None, "big"), (3001, "", "big"), (3002, "no source", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 as tokens", "'x' as digest")
    t = spark.createDataFrame([("m", "big", 0.6, 1), ("m", "small", 0.4, 3), ("m", "none", 0.0, 3), ("lost", "nowhere", 1.0, 2), ("m", "void", None, None)], TARGETS)
    texts = op.sized(d)
    assert texts.count() == 340
    mixed = op.mix(texts, t)
    rows = mixed.collect()
    assert rows and {r.mix_id for r in rows} == {"m"}
    caps = {"big": 1, "small": 3}
    assert all(0 < r.copies <= caps[r.source] for r in rows)
    assert len({(r.mix_id, r.doc_id) for r in rows}) == len(rows)
    report = {(r.mix_id, r.source): r for r in op.shares(texts, t, mixed).collect()}
    assert len(report) == 5 and report["lost", "nowhere"].actual_share == 0
    for s, share in (("big", 0.6), ("small", 0.4)):
        r = report["m", s]
        assert abs(r.actual_share - share) < 0.02 and abs(r.tokens_used - r.budget) <= 20
        assert r.tokens_used == sum(x.copies * x.tokens for x in rows if x.source == s)


def test_order_is_the_running_sum_by_hash(spark):
    d = spark.createDataFrame([(i, f"words {'and ' * (i % 7)} {i}", f"s{i % 2}") for i in range(200)], "doc_id long, text string, source string")
    got = op.ordered(op.sized(d)).collect()
    for s in ("s0", "s1"):
        upto = 0
        for r in sorted((r for r in got if r.source == s), key=lambda r: r.upto):
            upto += r.tokens
            assert r.upto == upto


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string, source string")
    t = spark.createDataFrame([], TARGETS)
    assert op.mix(op.sized(d), t).collect() == []
    assert op.shares(op.sized(d), t, op.mix(op.sized(d), t)).collect() == []
