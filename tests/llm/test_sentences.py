import pyarrow.parquet as pq
import pytest

from litloom.llm import sentences as op

SF = "/root/testdata/sf0.1/sections.parquet"


@pytest.fixture(scope="module")
def model():
    rows = [r for r in pq.read_table(SF).to_pylist() if not r["scanned"] and (r["full_text"] or "").strip()]
    return op.Model([(r["lang"], r["full_text"]) for r in rows])


def units(model, text, lang="en"):
    at = model.starts(text, lang)
    return [text[a:b].strip() for a, b in zip(at, at[1:] + [len(text)])]


@pytest.mark.parametrize(
    "lang, parts",
    [
        ("en", ["Dr. Smith and Prof. Lee measured 3.5 mm.", "The label read “Do not stir.” before noon.", "pH was 7.", "Is it done?"]),
        ("en", ["As Fig. 3 shows, it rose (cf. Tab. 4), i.e. more.", "“Is it dry?” asked the operators.", "He wrote: “It is dry.”", "Then it ended."]),
        ("zh", ["他写道：“样品是多孔的。”", "标签写着“不要搅拌。”之后才测量涂层。", "涂层是否提高了涂层？"]),
        ("de", ["Am 3. Mai 2008 stieg die Messung.", "Die Wirkung beträgt ca. 3,46 mm, d. h. die Leitung ist klein."]),
        ("th", ["เราวัดความเค็มและตัวอย่างในทุกสถานี", "อุณหภูมิมีค่า 8.57 มม. ในทุกชั้นผิว"]),
    ],
)
def test_units(model, lang, parts):
    text = ("" if lang == "zh" else " ").join(parts)
    assert units(model, text, lang) == parts


def test_headings_blank_lines_and_wrapped_lines(model):
    text = "Abstract\nIt rose by 3.5 percent. Then\nit fell.\n\n1. Introduction\nOne more\nline"
    assert units(model, text) == ["Abstract", "It rose by 3.5 percent.", "Then\nit fell.", "1. Introduction", "One more\nline"]


def test_rows(spark, model):
    long_text = "It rose by 3 percent. " * 5000
    rows = [(1, "It rose. It fell.", "en", 0), (2, None, "en", 0), (3, "  \n ", "en", 0), (4, "", None, 0), (None, "Lost.", "en", 0), (5, "It rose. It fell.", None, 0), (6, long_text, "en", 0)]
    df = spark.createDataFrame(rows, "sec_id long, full_text string, lang string, start_char int")
    got = op.segment(df, "sec_id", "full_text", "lang", model).collect()
    by = {}
    for r in got:
        by.setdefault(r.sec_id, []).append(r.start_char)
    assert by[1] == [0, 9] and by[5] == [0, 9] and len(by[6]) == 5000 and set(by) == {1, 5, 6}
    assert op.segment(df.limit(0), "sec_id", "full_text", "lang").collect() == []


def test_held_out_boundaries():
    """Paragraphs of texts that the model hasn't seen, run together: the seams are boundaries that are known."""
    rows = [r for r in pq.read_table(SF).to_pylist() if not r["scanned"] and (r["full_text"] or "").strip() and r["lang"]]
    fitted = op.Model([(r["lang"], r["full_text"]) for r in rows if r["sec_id"] % 2])
    right = total = 0
    for r in rows:
        if r["sec_id"] % 2:
            continue
        paras = [p for p in r["full_text"].split("\n\n") if len(p) > 80 and p.strip()[-1] in ".!?。！？।؟"]
        gap = "" if r["lang"] in ("zh", "ja") else " "
        for a, b in zip(paras[::2], paras[1::2]):
            a, b = a.strip(), b.strip()
            if "\n" not in a + b:
                total += 1
                right += len(a) + len(gap) in fitted.starts(a + gap + b, r["lang"])
    assert total > 500 and right / total > 0.98, (right, total)


def test_the_fit_is_bounded_in_characters(spark):
    rows = [(k, "en", f"Reef {k} grew. It was warm.\n\nThe sea rose in {k}. Nobody saw.") for k in range(60)] + [(99, None, None), (100, "en", "  ")]
    df = spark.createDataFrame(rows, "sec_id long, lang string, full_text string")
    whole, few, none = (op.fit(df, "sec_id", "full_text", "lang", characters=n) for n in (10**9, 400, 1))
    assert (whole.weights != 0).sum() > (few.weights != 0).sum() > (none.weights != 0).sum() == 0
    assert op.segment(df, "sec_id", "full_text", "lang", whole).count() >= 120
    assert op.segment(df.limit(0), "sec_id", "full_text", "lang").count() == 0
