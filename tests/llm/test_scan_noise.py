import pytest

from litloom.llm import scan_noise as op

CLEAN = "The large-scale pump measured the hydrocatalyst over seven weeks and the channel was dry.\nIt rose to 3.5 kPa in 2011 with a stable mixture, so the water carrier moved the sediment of Skulkiaxiwul.\n"
SCAN = """— 5 —
Annals of Acoustic Ecology

Abstract

The large-scale purnp measured the hydro-
catalyst over seven weeks and the large-
scale pump was dry. It rose to 3.5 kPa in 2O11
— 6 —
Skulkiaxiwul · The pump of stable
with a stable mix ture, so the chaimel of Skulkiaxiwul
moved the sedi­
ment of the water. It was ﬁne.
N
9762

— 7 —
"""


@pytest.fixture(scope="module")
def made(spark):
    sections = spark.createDataFrame([(k, CLEAN * 3, False, "x") for k in range(40)] + [(100, SCAN, True, "x"), (101, None, True, "x"), (102, " \n", True, "x"), (None, SCAN, True, "x"), (103, "", None, "x")], "sec_id long, full_text string, scanned boolean, noise string")
    captions = spark.createDataFrame([(1, "Fig. 1. pump of the hydroca- talyst over seven weeks.", 0), (2, "Fig. 2. the stable\nxiv\nmixture.", 0), (2, "Fig. 2. the stable\nxiv\nmixture.", 0), (3, None, 0)], "caption_id long, caption_text string, line_no int")
    journals = spark.createDataFrame([(1, "Annals of Acoustic Ecology"), (2, None)], "journal_id long, name string")
    texts = op.corpus(sections, captions)
    return texts, op.Corpus(texts, journals)


def test_lines_and_kinds(made):
    got = {tuple(r) for r in op.noise(*made).collect()}
    assert op.noise(*made).count() == len(got)
    sec = {(n, k) for p, i, n, k in got if p == "section"}
    assert {i for p, i, *_ in got if p == "section"} == {100}
    assert sec == {(0, "page_number"), (1, "header"), (5, "misread"), (5, "hyphen"), (7, "misread"), (8, "page_number"), (9, "header"), (10, "misread"), (11, "hyphen"), (12, "misread"), (16, "page_number")}
    assert {(i, n, k) for p, i, n, k in got if p == "caption"} == {(1, 0, "hyphen"), (2, 1, "page_number")}


def test_repaired_text(made):
    got = {(r.place, r.item_id): r.text for r in op.repair(*made).collect()}
    text = got["section", 100]
    assert "The large-scale pump measured the hydrocatalyst over seven weeks and the large-scale pump was dry. It rose to 3.5 kPa in 2011 with a stable mixture, so the channel of Skulkiaxiwul moved the sediment of the water. It was fine." in text
    assert "Acoustic" not in text and "— 6 —" not in text
    assert got["caption", 1] == "Fig. 1. pump of the hydrocatalyst over seven weeks." and got["caption", 2] == "Fig. 2. the stable mixture."
    assert got["section", 101] is None and got["section", 102] == " \n"


def test_empty_tables(spark):
    s = spark.createDataFrame([], "sec_id long, full_text string, scanned boolean")
    c = spark.createDataFrame([], "caption_id long, caption_text string")
    texts = op.corpus(s, c)
    known = op.Corpus(texts, spark.createDataFrame([], "name string"))
    assert op.noise(texts, known).collect() == [] and op.repair(texts, known).collect() == []


def test_roman_numbers():
    assert [op.roman(x) for x in ("i", "iv", "ix", "xiv", "xl", "iiii", "vx", "")] == [1, 4, 9, 14, 40, 0, 0, 0]


def test_repair_judges_words_by_the_corpus(spark):
    rows = [(k, CLEAN * 120, False, "x") for k in range(40)] + [(90, "The stahle was dry.\n", False, "x")]
    rows += [(91 + k, "The pump of Brenkotulmaz was dry.\n", True, "x") for k in range(3)] + [(100, "The stahle pump of Brenkotulnaz was dry.\n", True, "x")]
    texts = op.corpus(spark.createDataFrame(rows, "sec_id long, full_text string, scanned boolean, noise string"), spark.createDataFrame([], "caption_id long, caption_text string, line_no int"))
    known = op.Corpus(texts, spark.createDataFrame([], "journal_id long, name string"))
    assert op.Reader(*known.shared.value).word_at_fault("stahle") == ("stahle", "stable")
    assert op.Reader(*known.shared.value).word_at_fault("Brenkotulnaz") == ("brenkotulnaz", None)
    got = {r.item_id: r.text for r in op.repair(texts, known).collect()}
    assert got == {k: "The pump of Brenkotulmaz was dry." for k in (91, 92, 93)} | {100: "The stahle pump of Brenkotulmaz was dry."}


def _reader(context):
    counts = {w: (9, 90) for w in "the reef grew near warm water and cold stone".split()}
    return op.Reader(counts, context, set())


def _context(floor):
    import numpy as np

    ids = {w: k for k, w in enumerate("the reef grew near warm water".split())}
    v = np.ones((len(ids), 2), np.float32)
    return op.Context(ids, v, v, floor, floor + 1)


def test_the_context_decides_whether_a_rare_word_is_a_misreading():
    line = "the rccf grew near warm water"
    fits = [f for f in _reader(_context(1.0)).findings(line, False) if f[1] == "misread"]
    assert [(f[2], f[3]) for f in fits] == [("rccf", "reef")]
    assert not [f for f in _reader(_context(9.0)).findings(line, False) if f[1] == "misread"]
    assert [f for f in _reader(op.NO_CONTEXT).findings(line, False) if f[1] == "misread"]


def test_vectors_tell_what_usually_stands_together():
    texts = ["the warm reef grew near the cold stone and the warm water"] * 60 + ["red wine from old oak casks is poured into red cups"] * 60
    words = {w: 60 for t in texts for w in t.split()}
    c = op.skip_grams(texts, words, epochs=6)
    assert c.fit("reef", ["warm", "grew", "near"]) > c.fit("reef", ["wine", "oak", "casks"])
    assert c.floor <= c.usual and op.skip_grams([], {}) is op.NO_CONTEXT


def test_vectors_and_marks_come_from_every_text(spark):
    # 600 long born-digital texts, more than any bound there was; a word that only the last part of one of them has counts too.
    rows = [(k, "the warm reef grew near the cold stone and the warm water\n" * 4, False, "x") for k in range(600)]
    rows.append((600, "the cold stone and the warm water\n" * 900 + "red wine from old oak casks\n" * 40, False, "x"))
    texts = op.corpus(spark.createDataFrame(rows, "sec_id long, full_text string, scanned boolean, noise string").repartition(3), spark.createDataFrame([], "caption_id long, caption_text string"))
    frequent, context, _ = op.Corpus(texts, spark.createDataFrame([], "name string")).shared.value
    assert {"wine", "casks", "reef"} <= set(context.ids) == set(frequent)
    assert context.fit("wine", ["red", "from", "old"]) > context.usual - 1 > context.fit("wine", ["warm", "reef", "grew"])
    memory = op.skip_grams([r[1] for r in rows], {w: n for w, (_, n) in frequent.items()})
    assert (memory.floor, memory.usual) == pytest.approx((context.floor, context.usual), abs=2 / op.GRAIN)
    assert abs(memory.v - context.v).max() < 1e-3 and abs(memory.u - context.u).max() < 1e-3


def test_every_pair_in_the_window_of_a_text_is_counted():
    block = op._Block(op._Lowered())
    texts = ["a b c d e", "a b x’ ”", "", "e", "B A"]
    for k, t in enumerate(texts):
        block.add(t, k % 2 == 0)
    row = block.row()
    assert dict(zip(row["words"][0].as_py(), zip(row["clean"][0].as_py(), row["n"][0].as_py()))) == {"a": (2, 3), "b": (2, 3), "c": (1, 1), "d": (1, 1), "e": (1, 2), "x": (0, 1)}
    ids = {w: k for k, w in enumerate("abcde")}
    s, text = op.numbered(row["words"][0].as_py(), op.np.frombuffer(row["places"][0].as_py(), op.np.int32), ids)
    tally, held = op._Tally(), op.HELD
    try:
        op.HELD = 3
        for t in sorted(set(text)):
            tally.add(op.pairs(s[text == t], text[text == t], 5))
        got = tally.taken()
    finally:
        op.HELD = held
    found = {tuple("abcde"[x] for x in divmod(k, 5)): n for k, n in zip(got["key"].to_pylist(), got["n"].to_pylist())}
    assert found == {("a", "b"): 3, ("a", "c"): 1, ("a", "d"): 1, ("b", "c"): 1, ("b", "d"): 1, ("b", "e"): 1, ("c", "d"): 1, ("c", "e"): 1, ("d", "e"): 1}
    assert len(op.place_fits(s, text, op.np.ones((5, 2), "f4"), op.np.ones((5, 2), "f4"))) == 9


def test_row_groups_of_wide_rows_stay_small(spark):
    from pyspark.sql import functions as F

    from litloom.plans.lineage import cut

    wide = cut(spark.range(0, 40, 1, 1).select(F.expr("cast(array_join(transform(sequence(1, 20000), i -> sha2(concat(id, ' ', i), 256)), '') as binary)").alias("places")), op.WIDE)
    for file in wide.inputFiles():
        meta = pytest.importorskip("pyarrow.parquet").ParquetFile(file.removeprefix("file://")).metadata
        assert meta.num_row_groups > 1 and all(meta.row_group(k).total_byte_size < 40 << 20 for k in range(meta.num_row_groups))


def test_tokens_are_placed_where_they_were_found():
    for line in ("’the’ ’ a-b, 3.5 kPa a’b’ ''x ­ y¬", "a a aa a-a", "", "— 5 —"):
        assert op.placed(op.TOKEN.findall(line), line) == op.tokens(line)


class _Counting:
    """A pattern's ``findall`` that counts its calls."""

    def __init__(self, findall):
        self.found, self.calls = findall, 0

    def __call__(self, text):
        self.calls += 1
        return self.found(text)

    findall = __call__


def test_words_seen_before_are_not_read_again(monkeypatch):
    token, counted = _Counting(op.TOKEN.findall), _Counting(op.COUNTED)
    monkeypatch.setattr(op, "TOKEN", token)
    monkeypatch.setattr(op, "COUNTED", counted)
    line = "the reef grew near 12.5 warm rccf water,"
    reader = _reader(_context(1.0))
    got = [reader.findings("\n".join([line] * 5), False) for _ in range(100)]
    assert got[0] == [(k, "misread", "rccf", "reef") for k in range(5)] and got == got[:1] * 100
    low = op._Lowered()
    for _ in range(3):
        block = op._Block(low)
        for _ in range(100):
            block.add(line, True)
        row = block.row()
        assert dict(zip(row["words"][0].as_py(), row["n"][0].as_py())) == dict.fromkeys(["the", "reef", "grew", "near", "12", "5", "warm", "rccf", "water"], 100)
    assert token.calls <= len(line.split()) and counted.calls <= len(line.split())


def test_pieces_between_white_space_make_the_same_words_as_whole_texts(monkeypatch):
    import random

    monkeypatch.setattr(op, "PIECE", 4)
    r = random.Random(5)
    texts = ["".join(r.choice("ab’'--.,1 é́­¬‐漢\n\x1c　\xa0—") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    pieces, block = op._Pieces(lambda raw, low: False), op._Block(op._Lowered())
    for k, t in enumerate(texts):
        read = [pieces[p] for p in t.split()]
        assert [x for found, _, _ in read for x in found] == op.TOKEN.findall(t)
        block.add(t, k < 2000)
    words, clean, other = block.spelled()
    got = [[*map([*words, None].__getitem__, x)] for x in (clean, other)]
    assert got == [[w for t in part for w in [*(op.plain(x.strip("’'")) for x in op.COUNTED(t)), None]] for part in (texts[:2000], texts[2000:])]


def test_words_broken_inside_a_line_are_read_from_their_sign():
    import random

    whole = op.re.compile(r"([\p{L}’'-]+)([-¬­‐]) (\p{Ll}[\p{L}’']*)")
    r = random.Random(3)
    lines = ["".join(r.choice("ab-- ¬­‐'’A1") for _ in range(r.randint(0, 18))) for _ in range(30_000)] + ["a- b- c", "a- b-- c", "a- b- c- d"]
    assert sum(bool(whole.search(x)) for x in lines) > 500
    for line in lines:
        assert list(op.broken_inside(line)) == [(m.start(), m.end(), *m.groups()) for m in whole.finditer(line)]
