import pytest

from litloom.llm import personal_data as op


def found(text):
    return {(k, text[a:b]) for a, b, k in op.spans(text)}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to zoe73 (at) lumenbio.test or a.b+lab[at]corvid-obs[dot]example.", {("email", "zoe73 (at) lumenbio.test"), ("email", "a.b+lab[at]corvid-obs[dot]example")}),
        ("See M@X.EXAMPLE.The end. tools@51.119 and @handle are none.", {("email", "M@X.EXAMPLE")}),
        ("x.y at brack-archive dot example; it stood at rest.", {("email", "x.y at brack-archive dot example")}),
        ("Call +1 (223) 555-0121 ext. 76 before noon. Tel. 030/23125621.", {("phone", "+1 (223) 555-0121"), ("phone", "030/23125621")}),
        ("Grant 513-19-3796, catalogue no. 218 9261 14, 192.0.2.70.", set()),
        ("passport no. CR 98 36 29 D; social security number 936 75 7093; Ausweis-Nr. 9999-0061-9321-661X", {("id_number", "CR 98 36 29 D"), ("id_number", "936 75 7093"), ("id_number", "9999-0061-9321-661X")}),
        ("lives at Flat 4, 66 Wickerby Lane, Quillan. Room 938 of Building 79.", {("address", "Flat 4, 66 Wickerby Lane, Quillan")}),
        ("Kontakt: J. R. Foskaldeliart, Larkwellstraße 50a, 27573 Marrowgate", {("name", "J. R. Foskaldeliart"), ("address", "Larkwellstraße 50a, 27573 Marrowgate")}),
        ("Calle Fallowend 170, 23544 Marrowgate", {("address", "Calle Fallowend 170, 23544 Marrowgate")}),
        ("住址 北河区云溪路27号。", {("address", "北河区云溪路27号")}),
        ("感谢 José-Tomás Kintamigoulk 的帮助。", {("name", "José-Tomás Kintamigoulk")}),
        ("We thank Foskolkagroth, Zoë and Dr. Bob MOXARTESKEIR.", {("name", "Foskolkagroth, Zoë"), ("name", "Bob MOXARTESKEIR")}),
        ("The Ursula Leimeonduveirt Fellowship pays. Moxarteskeir et al. and the Seinoundesteiv model.", set()),
        ("Henry Drulourmugurm; K. Moxurtuclesk\n\nAbstract", {("name", "Henry Drulourmugurm"), ("name", "K. Moxurtuclesk")}),
    ],
)
def test_kinds(text, want):
    assert found(text) == want


GIVEN = "Rajesh Priya Olumide Wei Emma Mohammed Sakura Ngozi Lars Aoife Mateo Chiara Thabo Linh Bogdan Amara Noah Freya Diego Yuki".split()
FAMILY = "Kumar Li Okafor Ng Larsen Murphy Rossi Nguyen Petrov Lee Al-Sayed García Wójcik O'Brien MacDonald".split()
FRAMES = (
    "At noon {} opened the valve. The valve was old.",
    "The samples that {} had dried were weighed again.",
    "Two pumps failed, so {} and the crew stayed on shore.",
    "Contact {} about the pumps.",
    "{}; Quentin Moxarteskeir\n\nWe weighed the samples.",
    "We thank {} for help.",
)


def test_names_on_no_list():
    cases = [(f"{g} {f}", frame) for k, g in enumerate(GIVEN) for j, f in enumerate(FAMILY) if (k + j) % 3 == 0 for frame in FRAMES]
    hits = sum(("name", name) in found(frame.format(name)) for name, frame in cases)
    assert hits >= 0.98 * len(cases)
    turned = [f"{f}, {g}" for g, f in zip(GIVEN, FAMILY)]
    assert all(("name", t) in found(f"We thank {t} for help.") for t in turned)
    assert all(("name", f"J. {f}") in found(f"The valve that J. {f} opened.") for f in FAMILY)


def test_capitalised_words_that_are_no_names():
    known = op.Uses(frozenset(("selon", "marine", "biology", "membran")), frozenset(("rajesh",)))
    texts = ["Selon Kumar, la phase reste stable.", "Marine Biology\n\nText.", "Die Membran Kumar", "We used a Monte Carlo simulation.", "The Rajesh Kumar Fellowship pays.", "5 mg/L. Selon the rest.", "In New York it rained.", "Trial ID REG-6960-776 covers it.", "The<s> Gregory Zourmiamubreth Foundation paid."]
    assert [op.spans(t, known) for t in texts] == [[] for _ in texts]
    assert [t[a:b] for t in ["So did Kumar, Rajesh and others."] for a, b, _ in op.spans(t, known)] == ["Kumar, Rajesh"]


def test_initials_behind_a_cue_are_no_title():
    assert found("Corresponding author: M. N. Caluskeosiarm, tel. +1 217 555 0164.") == {("name", "M. N. Caluskeosiarm"), ("phone", "+1 217 555 0164")}
    assert found("Nous remercions M. Paul Caluskeosiarm.") == {("name", "Paul Caluskeosiarm")}


def test_numbers_of_any_exchange_and_all_that_a_cue_announces():
    numbers = [f"212-867-53{k:02d}" for k in range(40)]
    assert found("Tel: " + ", ".join(numbers)) == {("phone", n) for n in numbers}
    assert found("Ring " + " or ".join(f"0{30 + k} 123456{k % 10}" for k in range(3))) == {("phone", f"0{30 + k} 123456{k % 10}") for k in range(3)}
    assert found("He left 415-867-5309 as his number.") == {("phone", "415-867-5309")}
    assert found("Her SSN is 123-45-6789.") == {("id_number", "123-45-6789")}
    assert found("Lot 415-867-5309 of order 212.867.5309 is there.") == set()


def test_a_line_of_names_of_any_length():
    names = [f"{g} {f}" for g in GIVEN for f in FAMILY] * 4
    line = "; ".join(names)
    assert len(line) > 12_000 and len(op.spans(line)) == len(names)


def test_names_in_han_behind_a_cue():
    assert found("感谢王小明的帮助。") == {("name", "王小明")}
    assert found("連絡先：佐藤太郎、電話は後で。") == {("name", "佐藤太郎")}


def test_uses_come_from_the_whole_corpus(spark):
    rows = [(k, f"Selon Foskal{k} la phase reste stable. Le {w} de Will Foskal{k}; Will Kumar{k}.") for k, w in enumerate(["Membran"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = op.uses(df, "text")
    assert {"selon", "membran"} <= known.ordinary and "will" in known.given
    assert op.uses(df.limit(0), "text").ordinary == frozenset()


def test_redaction_keeps_the_rest():
    assert op.redacted("Mail a@b.example, then call +44 20 7946 0710 ext. 7.") == "Mail [EMAIL], then call [PHONE] ext. 7."
    assert op.redacted(None) is None and op.redacted("") == "" and op.redacted(" \n") == " \n"


def test_rows(spark):
    text = "a@b.example and a@b.example"
    rows = [(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (None, text, "x"), (4, "word " * 50000 + "c@d.example", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    assert {tuple(r) for r in op.find(df, "doc_id", "text").collect()} == {(1, "email", "a@b.example"), (4, "email", "c@d.example")}
    assert op.find(df, "doc_id", "text").count() == 2
    assert op.redact(df, "doc_id", "text").count() == 6
    assert op.find(df.limit(0), "doc_id", "text").count() == 0


def test_long_texts_take_linear_time():
    import time

    part = "Also Al Kumar went along. Tel: 212-867-5309, then mail a@b.example now; Rajesh Foskal and Priya Li saw it at 12 Long Lane, Quillan. "
    took = []
    for n in (200, 1600):
        began = time.perf_counter()
        assert len(op.spans(part * n)) >= 4 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 24 * took[0] + 1
