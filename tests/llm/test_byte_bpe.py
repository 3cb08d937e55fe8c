import os
import random

import pytest

from litloom.llm import byte_bpe as op

pytestmark = pytest.mark.skipif(not os.path.exists(op.VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def both():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op.VOCABULARY)
    t.encode_special_tokens = True
    with open(op.VOCABULARY, "rb") as f:
        return op.ByteBPE(f.read()), lambda s: t.encode(s, add_special_tokens=False).ids


def test_equals_the_reference_merges(both):
    own, ref = both
    rng = random.Random(1)
    pool = [chr(c) for c in range(0, 0x180)] + list("etaoin shrdlu") * 8 + ["中", "ก", "ा", "🙂", " ", "\x85", "'s", "<|endoftext|>"]
    for _ in range(3000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        assert own.encode(s) == ref(s), repr(s)
    for piece in ("a", "ab", " ", "-", "\n", "中", "hello"):
        for n in (1, 2, 3, 50, 2001):
            assert own.encode(piece * n) == ref(piece * n)


def test_rows(spark, both):
    _, ref = both
    rows = [(1, "a text", "x"), (2, "", "x"), (3, None, "x"), (4, "  \n", "x"), (4, "twice", "x"), (5, "<|endoftext|>", "x"), (None, "no id", "x"), (6, "word " * 30000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in op.encode(df, "doc_id", "text").collect()), key=str)
    want = sorted(((i, ref(t) if t else []) for i, t, _ in rows), key=str)
    assert got == want
    assert op.encode(df.limit(0), "doc_id", "text").collect() == []
