"""Personal information inside free text (problem 10).

Anchor expansion: one Aho-Corasick automaton finds anchors (at-signs and their spelled forms, plus signs and telephone
cues, cues of identity numbers, street words, name cues); a deterministic local parser then reads outward from each
anchor and validates what it finds, as many numbers as one cue announces. What has a form of its own needs no cue and is
swept for by pattern over the whole text: telephone numbers of a national or international form, researcher numbers,
initials with a family name, lines of nothing but names, and runs of capitalised words.

No list says what a name is. A run of capitalised words is a person's name if each of its words is used like a name in
the corpus (``Uses``): not in lower case, not behind an article as nouns are, not only where a sentence begins. The
words that make up at least one in ``SHARE`` of all words are counted over the whole corpus; of rarer ones the text
itself tells whether it has them in lower case. Names inside those of foundations, methods and awards are left out by
what follows and precedes them.

``find`` gives the different values of each document, ``redact`` the text with typed placeholders ([EMAIL], [PHONE],
[ID_NUMBER], [ADDRESS], [NAME]), where of overlapping findings the longer wins.

Defined results: null, empty and blank texts have no findings and are redacted to themselves; rows with a null id
are kept by ``redact`` and left out by ``find``; rows that repeat an id are read one by one and their values made
different per id. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import bisect
import functools
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.names import FULL_OF
from litloom.plans.lineage import cut

#: Words that hold at least one in so many of all are judged by the corpus: never more than that many.
SHARE = 50_000
KINDS = ("email", "phone", "id_number", "address", "name")

# The cues that announce each kind, in the languages of the corpus.
AT = ("@", "＠", "(at)", "[at]", "{at}", "<at>", " at ", "_at_")
PHONE_CUES = ("tel", "tél", "phone", "call ", "reached on", "reached at", "fax", "mobile", "mobil", "office)", "office:", "contact", "ring ", "whatsapp", "hotline", "电话", "電話", "手机", "手機", "传真")
ID_CUES = ("passport", "identity card", "identity number", "id card", "id no", "social security", "researcher number", "researcher id", "tax number", "tax id", "tax no", "taxpayer", "national id", "orcid", "ssn", "ausweis", "reisepass", "personalausweis", "steuernummer", "steuer-id", "sozialversicherung", "carte d'identité", "carte d’identité", "passeport", "sécurité sociale", "numéro fiscal", "documento", "dni", "nif", "pasaporte", "seguridad social", "身份证", "护照", "税号", "研究者番号", "旅券", "パスポート", "マイナンバー", "身分証")
STREETS = ("street", "st", "st.", "avenue", "ave", "ave.", "lane", "ln", "road", "rd", "rd.", "close", "court", "drive", "dr.", "way", "terrace", "place", "square", "boulevard", "blvd", "crescent", "row", "hill", "gardens", "park")
STREET_ANCHORS = tuple(f" {s}" for s in ("street", "st,", "st.", "avenue", "ave", "lane", "ln", "road", "rd", "close", "court", "drive", "way", "terrace", "place", "square", "boulevard", "blvd", "crescent"))
OTHER_ADDRESS = ("p.o. box", "po box", "p. o. box", "postfach", "straße ", "strasse ", "str. ", "weg ", "platz ", "allee ", "gasse ", "ring ", "rue ", "avenue d", "boulevard ", "place d", "chemin ", "calle ", "avda", "avenida ", "plaza ", "paseo ", "c/ ", "apartado", "号", "丁目", "番地")
NAME_CUES = ("author:", "author note:", "interviewee:", "contact ", "contact : ", "kontakt: ", "contacto: ", "interview ", "signed as ", "form of ", "addressed to ", "forwarded by ", "repaired by ", "participant (", "probandin ", "proband ", "patient ", "patiente ", "participante ", "we thank ", "thanks to ", "thank ", "remercions ", "agradecemos a ", "dank an ", "danken ", "frau ", "herrn ", "mr. ", "mrs. ", "ms. ", "dr. ", "prof. ", "monsieur ", "madame ", "señora ", "señor ", "通讯作者：", "感谢 ", "感谢", "协力者 ", "協力者 ", "連絡先：", "联系人：", "患者", "受访者：", "written by ", "by ")
INSTITUTIONS = ("foundation", "fellowship", "award", "prize", "medal", "institute", "lecture", "lectureship", "chair", "scholarship", "fund", "trust", "society", "center", "centre", "laboratory", "lab", "school", "hospital", "library", "university", "college", "museum", "grant", "method", "test", "model", "algorithm", "equation", "index", "criterion", "theorem", "effect", "procedure", "protocol", "estimator", "score", "scale", "transform", "filter", "kernel", "simulation", "analysis", "statistic", "statistics", "plot", "curve", "regression", "distribution", "correction", "chain", "sampling", "syndrome", "disease", "law", "constant", "process", "network", "architecture", "river", "lake", "island", "islands", "sea", "ocean", "bay", "valley", "city", "stiftung", "preis", "stipendium", "fondation", "bourse", "prix", "fundación", "premio", "beca", "基金", "奖", "財団", "賞")

INSTITUTION_WORDS = frozenset(INSTITUTIONS)

LOCAL = re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%'-]*[\w])?$")
DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\s+dot\s+|\s?[\[({]\.[\])}]\s?)"
DOMAIN = re.compile(rf"(?a:[A-Za-z0-9][A-Za-z0-9-]*)(?:{DOT}(?a:[A-Za-z0-9][A-Za-z0-9-]*))+")
DOT_SPLIT = re.compile(DOT)

PHONE = re.compile(
    r"(?<![\w./@-])(?:"
    r"(?:\+|00)\d{1,4}[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d{1,5}(?:[ .\-/]\d{2,10}){1,6}(?!\d)"
    r"|(?:\+|00)\d{8,14}"
    r"|\+\d{1,3} \(\d{2,4}\) \d{3,4}[ -]\d{3,5}"
    r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,5}"
    r"|\d{3}([ .-])\d{3}\1\d{4}"
    r"|0\d(?:[ .-]\d{2}){4}"
    r"|0\d{2,4}[/ -]\d{3,4}(?:[ -]?\d{3,5})"
    r"|1\d{10}|\d{3}-\d{4}|0\d{8,10}"
    r")(?![\w-])(?![.,/]\d)"
)
#: Shapes that are telephone numbers by themselves; the others need a cue before them.
SELF = re.compile(r"\+|00\d|\(\d{3}\)|[2-9]\d{2}([.-])[2-9]\d{2}\1\d{4}$|0\d{2,4}[ /]\d{6,8}$|020 ")
#: Where such a number may begin, and what makes another number of it.
OPEN_PHONE = re.compile(r"(?<![\w./@#-])(?:[2-9]\d{2}([.-])[2-9]\d{2}\1\d{4}|0\d{2,4}[ /]\d{6,8})(?![\w-])(?![.,/]\d)")
OTHER_NUMBER = re.compile(r"(?:grant|award|lot|batch|trial|catalogue|catalog|cat|accession|serial|order|invoice|ticket|ref|isbn|issn|doi|version|no|nr|nº|numbers?|id|编号|番号)[.:#]?\s*$|[\d.,]\s$", re.I)
#: What may stand between the numbers that one cue announces.
BETWEEN = re.compile(r"(?:\s*\([^()\d\n]{1,30}\))?\s*(?:[,;/、，]|(?:,\s*)?\b(?:and|or|und|oder|et|ou|y|o)\b|\s)\s*(?:[\p{L}.]{1,10}[:.]?\s+)?")
ID_SHAPES = re.compile(
    r"(?<![\w])(?:"
    r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]"
    r"|\d{17}[\dXx]"
    r"|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Z]"
    r"|\d{3}[- ]\d{2}[- ]\d{4}"
    r"|\d{6}-\d{4}"
    r"|\d{8}-?[A-Z]"
    r"|[A-Z]{1,3}-?\d{6,9}[A-Z]?"
    r"|[A-Z0-9]{2,4}(?:[- ]?[A-Z0-9]{2,5}){1,4}"
    r"|\d{7,15}"
    r")(?![\w])"
)
OPEN_ID = re.compile(r"(?<![\w-])\d{4}-\d{4}-\d{4}-\d{3}[\dX](?![\w-])")

U = r"\p{Lu}[\p{L}'’]*\p{L}(?:-\p{Lu}[\p{L}'’]*\p{L})*"
TOWN = rf"(?:{U}(?:[ -](?:on|upon|sur|an|am|der|de|la|le|in|by|under)[ -]{U})?(?: {U})?)"
POSTCODE = r"(?:\p{Lu}{1,2}\d{1,2}\p{Lu}? \d\p{Lu}{2}|(?:\p{Lu}{1,2}-)?\d{4,6}(?:-\d{4})?)"
TAIL = rf"(?:,\s{TOWN}(?:(?:,\s|\s){POSTCODE})?)"
ENGLISH = re.compile(rf"(?<![\w])(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room) \d+\p{{L}}?,\s)?\d{{1,5}}\p{{L}}?,?\s(?:{U}\s){{1,3}}?(?:Street|St\.?|Avenue|Ave\.?|Lane|Ln\.?|Road|Rd\.?|Close|Court|Drive|Way|Terrace|Place|Square|Boulevard|Blvd\.?|Crescent){TAIL}(?![\w])")
BOX = re.compile(rf"(?<![\w])(?:P\. ?O\. ?Box|PO Box|P\.O\.Box|Postfach|Apartado|B\.P\.) \d+{TAIL}?(?![\w])", re.I)
GERMAN = re.compile(rf"(?<![\w])(?:{U}[ -])*\p{{Lu}}[\p{{L}}-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ufer|damm|ring)\s\d+\s?\p{{L}}?,\s(?:{POSTCODE}\s)?{TOWN}(?![\w])")
FRENCH = re.compile(rf"(?<![\w])\d{{1,4}}(?:\s?(?:bis|ter|\p{{L}}))?,?\s(?:rue|avenue|boulevard|place|chemin|quai|allée|impasse)\s(?:(?:de|du|des|de la|de l'|d'|la|le|les)\s?)*{U}(?:[ -]{U})*,\s(?:{POSTCODE}\s)?{TOWN}(?![\w])", re.I)
SPANISH = re.compile(rf"(?<![\w])(?:Calle|Avda\.?|Avenida|Plaza|Paseo|C/)\s(?:(?:de|del|de la|la|el|los|las)\s)*{U}(?:\s{U})*,?\s\d{{1,4}}(?:\s?\p{{L}}(?!\w))?(?:,\s\d{{1,2}}\.?º(?:\s\p{{L}})?)?,\s(?:{POSTCODE}\s)?{TOWN}(?![\w])")
CHINESE = re.compile(r"(?:\p{Han}{2,6}省)?(?:\p{Han}{1,5}市)?(?:\p{Han}{1,5}[区县])?\p{Han}{1,6}(?:路|街|巷|大道|胡同|弄)\d+号(?:\d+(?:单元|栋|楼|幢))?(?:\d+(?:室|号))?")
JAPANESE = re.compile(r"(?:〒\d{3}-\d{4}\s?)?(?:\p{Han}{2,3}[都道府県])?\p{Han}{1,5}[市区町村]\p{Han}{1,6}\d+(?:丁目|-)\d+(?:番地?|-\d+)?(?:\d+号)?")
ADDRESSES = (ENGLISH, BOX, GERMAN, FRENCH, SPANISH, CHINESE, JAPANESE)

# Words of closed classes, and those that begin lines and places, in the languages of the corpus.
NOT_NAME = frozenset("""the this that these those neither both each either no some all any many most few several other another such a an i we he she it they you our their his her its my your
one two three four five six seven eight nine ten first second third as at by for from in into of off on onto out over to up with within without since until while when where what which who whom whose why how if because although though unless whereas after before during between among under above below about across against along around behind beyond despite except like near per than through toward towards unlike upon via versus
and or but nor so yet not also only even just then once now here there thus hence however therefore moreover furthermore nevertheless meanwhile still again today yesterday tomorrow recently finally together taken future studies is are was were be been being has have had do does did can could might must shall should would let
der die das den dem des ein eine einen einem einer eines und oder aber im am vom zum zur bei beim mit nach von vor seit laut gemäß durch für gegen ohne um aus auf über unter zwischen wegen trotz während wenn weil dass wie wir ich sie er es ihr unser jede jeder jedes kein keine nicht auch nur
le la les un une des du de et ou mais dans sur sous avec sans pour par selon chez entre depuis pendant nous vous ils elles il elle on ce cette ces son sa ses notre leur si comme que qui
el los las una unos unas y o pero en con sin para por según entre desde durante nosotros este esta estos estas su sus nuestro como si que quien
abstract introduction background methods method results discussion conclusion conclusions references appendix acknowledgements acknowledgments figure fig table section chapter supplementary keywords funding author authors reviewer editor dear corresponding contact university department institute street avenue road north south east west new san santa saint los monte great united
january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday dr prof professor mr mrs ms phd md frau herr herrn mme monsieur madame señor señora sr sra dra""".split())
ARTICLES = frozenset("the a an der die das den dem des ein eine einen einem einer eines im am vom zum zur le la les un une du au aux el los las una unos unas al del".split())
PARTICLE = r"(?:(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ten|ter|zu) ){1,3}"
HAN_FAMILIES = "王李张陈刘杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严"
KANJI_FAMILIES = "佐藤|鈴木|高橋|田中|伊藤|渡辺|山本|中村|小林|加藤|吉田|山田|佐々木|山口|松本|井上|木村|林|斎藤|清水|山崎|森|池田|橋本|阿部|石川|山下|中島|石井|小川|前田|岡田|長谷川|藤田|後藤|近藤|村上|遠藤|青木|坂本|斉藤|福田|太田|西村|藤井|金子|岡本|藤原|三浦|中野"
HAN_NAME = re.compile(rf"[{HAN_FAMILIES}]\p{{Han}}{{1,2}}(?=[，。、；：:,;（(\s]|的|老师|教授|博士|先生|女士|等|和|与|对|$)|(?:{KANJI_FAMILIES})\s?[\p{{Han}}\p{{Hiragana}}\p{{Katakana}}]{{1,3}}(?=[，。、；：:,;（(\s]|氏|さん|様|先生|教授|博士|に|の|と|$)")

#: A capitalised word (hyphens and inner capitals included), initials, and a single one without a point.
W = r"\p{Lu}[\p{L}'’]*\p{L}(?:-\p{Lu}[\p{L}'’]*\p{L})*(?![\p{L}])"
INITIALS = r"\p{Lu}\.(?:[ -]?\p{Lu}\.){0,2}"
MIDDLE = rf"(?:{INITIALS}|\p{{Lu}}(?![\p{{L}}.'’-]))"
RUN = re.compile(rf"(?<![\p{{L}}\p{{N}}.'’@/_-]){W}(?: (?:{MIDDLE}|(?:{PARTICLE})?{W}))+")
SHORT = re.compile(rf"(?<![\p{{L}}.'’\d/-])(?<!\d )(?:{INITIALS} ?(?:{PARTICLE})?{W})")
SEPARATE = r"\s*[;·|•]\s*|\s+(?:and|und|et|y|&)\s+"
ONE = rf"(?:{W}(?: {MIDDLE})?(?: (?:{PARTICLE})?{W}){{1,2}}|{INITIALS} ?(?:{PARTICLE})?{W}|(?:{PARTICLE})?{W}, {W}(?: {MIDDLE})?(?! ?{W})|{W},? {INITIALS})"
NAME = re.compile(ONE)
TURNED = re.compile(rf"(?<![\p{{L}}.'’-]){W}, {W}(?: {MIDDLE})?(?! ?(?:{MIDDLE} )?{W})")
CUED = re.compile(rf"\s?(?:(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.|Frau|Herrn?|Mme|M\.(?!\s?\p{{Lu}}\.)|Sr\.|Sra\.|Dra\.)\s)*({ONE})")
#: Cues that announce other things as well.
WEAK = frozenset(("by ", "contact ", "patient ", "interview ", "form of "))
ARTICLE = re.compile(r"(?:\b(?:[Tt]he|THE|[Dd]er|[Dd]ie|[Dd]as|[Ll]a|[Ll]e|[Ee]l|[Ll]os)\s)$")
FOLLOWED = re.compile(rf"(?:['’]s)?[\s-](?:\p{{L}}+[\s-])?(?:{'|'.join(INSTITUTIONS)})\b", re.I)
BEGUN = re.compile(r"(?:^|[.!?:。！？：\n•–—*>|]|\d[.)])[\s\"'“«(\[]*$")
WORDS = re.compile(r"\p{L}{2,}").findall
SPLIT = re.compile(rf"({SEPARATE})")
ENDED = re.compile(rf"$|{SEPARATE}")
NO_INITIALS = re.compile(r"U\.K|U\.S|P\.O|D\.C")
AFTER_NUMBER = re.compile(r"\d\s?$")
LISTED = re.compile(r":\s*$|\), $|, $")
FIRST_WORD = re.compile(r"\p{L}+").match
ID_LEAD = re.compile(r"[\p{L}'’-]*(?:[ -]?(?:(?:number is|number|nummer|num|no|nr|nº|n°|card|id|code)(?!\p{L})|号码|号|番号))?\.?(?:\s(?:number|no|nr|nº|n°|card|id)(?!\p{L})\.?)?(?:\s?[:：#(]|\s(?:is|was|lautet|est|es)(?!\p{L})|是|は)?\s?", re.I)


class Uses:
    """How the corpus uses words: ``ordinary`` ones are no names, ``given`` ones stand before a family name."""

    def __init__(self, ordinary: frozenset[str] = frozenset(), given: frozenset[str] = frozenset()):
        self.ordinary, self.given = ordinary, given

    def like_name(self, word: str, here: Container[str] = ()) -> bool:
        low = word.lower()
        return low not in NOT_NAME and (low in self.given or low not in self.ordinary and low not in INSTITUTION_WORDS and low not in here)


NO_USES = Uses()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens, low, cap, noun, first, given = (Counter() for _ in range(6))
        for t in b.column(0).to_pylist():
            if not t:
                continue
            tokens.update(t.split())
            for m in CAPITAL.finditer(t):
                w, a = m.group().lower(), m.start()
                cap[w] += 1
                if t[a - 1 : a] == " " and t[a - 2 : a - 1].isalpha():
                    before = t[max(0, a - 12) : a - 1].rsplit(None, 1)
                    if before and before[-1].lower() in ARTICLES:
                        noun[w] += 1
                    elif NEXT(t, m.end()):
                        given[w] += 1
                elif BEGUN.search(left := t[max(0, a - 16) : a]) and not ABBREVIATED.search(left):
                    first[w] += 1
                elif NEXT(t, m.end()):
                    given[w] += 1
        for w, n in tokens.items():
            if (x := w.strip(AROUND)).islower() and x.isalpha():
                low[x] += n
        words = list(low.keys() | cap.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in (low, cap, noun, first, given))], names=["word", "low", "cap", "noun", "first", "given"])


AROUND = ".,;:!?()[]{}\"'“”‘’«»„*_-–—"
CAPITAL = re.compile(r"(?<![\p{L}\p{N}@._'’-])\p{Lu}[\p{L}'’]*\p{L}")
NEXT = re.compile(rf"(?:-\p{{Lu}}\p{{L}}+)? (?:{MIDDLE} )?{W}").match
ABBREVIATED = re.compile(r"\b\p{L}\.\s?$|\b(?:Dr|Prof|Mrs?|Ms|Sra?|Dra)\.\s?$")


class Lower:
    """Holds the words that a text has in lower case, parts of addresses apart."""

    def __init__(self, text: str):
        self.text = text
        self.known: dict[object, bool] = {}

    def __contains__(self, word: object) -> bool:
        if word not in self.known:
            self.known[word] = self._has(word)
        return self.known[word]

    def _has(self, word: object) -> bool:
        t, n, at = self.text, len(word), self.text.find(word)
        while at >= 0:
            before, after = t[at - 1 : at] if at else "", t[at + n : at + n + 1]
            if not (before.isalnum() or before and before in "@._-" or after.isalpha() or after and after in "@_"):
                return True
            at = t.find(word, at + n)
        return False


def uses(df: DataFrame, text: str) -> Uses:
    """The uses of words, counted over all texts."""
    counts = cut(df.where(F.col(text).isNotNull()).select(F.col(text).alias("_t")).mapInArrow(_counted, "word string, low long, cap long, noun long, first long, given long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("low", "cap", "noun", "first", "given"))))
    total = counts.agg(F.sum(F.col("low") + F.col("cap"))).first()[0] or 0
    usual = counts.where(f"cap > 0 and (low + cap) * {SHARE} >= {total}")
    # A name stands rarely in lower case, not as often behind an article as a noun does (though a method may be named after it), and not only where sentences begin.
    rows = usual.select("word", F.expr("low > cap / 4 or noun > cap * 0.4 or first = cap and cap > 4").alias("ordinary"), F.expr("2 * given > cap - first - noun and given > 2").alias("given")).where("ordinary or given").collect()
    return Uses(frozenset(r["word"] for r in rows if r["ordinary"]), frozenset(r["word"] for r in rows if r["given"]))


@functools.cache
def automaton():
    """Anchors over the lower-cased text, each with the kinds of parser it starts."""
    import ahocorasick

    kinds: dict[str, set[str]] = {}
    for words, kind in ((AT, "email"), (("+", *(f"({d}" for d in range(10)), "00", "020 "), "phone"), (PHONE_CUES, "phone"), (ID_CUES, "id_number"), (STREET_ANCHORS, "address"), (OTHER_ADDRESS, "address"), (NAME_CUES, "cue")):
        for w in words:
            kinds.setdefault(w, set()).add(kind)
    a = ahocorasick.Automaton()
    for w, k in kinds.items():
        a.add_word(w, (len(w), tuple(sorted(k))))
    a.make_automaton()
    return a


def lower(text: str) -> str:
    """Lower case of the same length, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _email(text: str, a: int, b: int) -> tuple[int, int] | None:
    word = text[a:b].strip()
    left = text[max(0, a - 80) : a]
    spaced = left.rstrip(" ") if len(left) - len(left.rstrip(" ")) <= 1 else left
    m = LOCAL.search(spaced)
    at = b + (1 if text[b : b + 1] == " " else 0)
    d = DOMAIN.match(text, at, at + 200)
    if not m or not d:
        return None
    labels, seps = DOT_SPLIT.split(d.group()), DOT_SPLIT.findall(d.group())
    n = 1
    upper = labels[0].isupper()
    # A label of another case belongs to the next sentence.
    while n < len(labels) and (labels[n].isupper() == upper or labels[n].isdigit()) and (upper or labels[n].islower() or labels[n].isdigit()):
        n += 1
    while n > 1 and not (labels[n - 1].isalpha() and len(labels[n - 1]) > 1):
        n -= 1
    if n < 2 or word.isalpha() and word.lower() == "at" and not any("dot" in s.lower() for s in seps[: n - 1]):
        return None
    end, pos = at, at
    for k in range(n):
        pos += len(labels[k])
        end = pos
        pos += len(seps[k]) if k < len(seps) else 0
    start = max(0, a - 80) + m.start()
    return start, end


def _phones(text: str, at: int, end: int, stop: int, cue: str) -> Iterator[tuple[int, int]]:
    """The number that begins at an anchor, or those that a cue announces up to ``stop``, the next cue."""
    if cue[0] in "+(" or cue in ("00", "020 "):
        m = PHONE.match(text, at)
        if m and SELF.match(m.group()):
            yield m.span()
        return
    clause = CLAUSE.search(text, end, stop)
    stop = clause.start() if clause else stop
    last = None
    for m in PHONE.finditer(text, end, stop):
        between = text[last if last is not None else end : m.start()]
        near = BETWEEN.fullmatch(between) if last is not None else len(between) <= 14 or cue == "contact" and LISTED.search(between)
        if near or SELF.match(m.group()):
            last = m.end()
            yield m.span()


CLAUSE = re.compile(r"[\n;。；]")


def _id(text: str, end: int) -> tuple[int, int] | None:
    m = ID_LEAD.match(text, end, end + 60)
    at = m.end() if m else end
    got = ID_SHAPES.match(text, at)
    return got.span() if got and sum(c.isdigit() for c in got.group()) >= 5 else None


def _is_case(text: str, a: int, b: int) -> bool:
    """A person's own name, not that of a foundation, an award or a method."""
    return not (FOLLOWED.match(text, b) or ARTICLE.search(text, max(0, a - 6), a) and re.match(r"[ -]\p{L}", text[b : b + 2]))


def spans(text: str | None, known: Uses = NO_USES) -> list[tuple[int, int, str]]:
    """Findings of a text as (start, end, kind), without overlap, in order."""
    if not text or not text.strip():
        return []
    low = lower(text)
    found: list[tuple[int, int, str]] = []
    here = Lower(text)
    anchors = [(last - size + 1, last + 1, kind) for last, (size, kinds) in automaton().iter(low) for kind in kinds]
    cues = sorted(a for a, b, kind in anchors if kind == "phone" and low[a].isalpha())
    for a, b, kind in anchors:
        if kind == "email":
            if got := _email(text, a, b):
                found.append((*got, "email"))
        elif kind == "phone":
            nxt = bisect.bisect_left(cues, b)
            found += [(*x, "phone") for x in _phones(text, a, b, cues[nxt] if nxt < len(cues) else len(text), low[a:b])]
        elif kind == "id_number":
            if (got := _id(text, b)) is not None:
                found.append((*got, "id_number"))
        elif kind == "address":
            lo = max(0, a - 100)
            for p in ADDRESSES:
                for m in p.finditer(text, lo, min(len(text), b + 140)):
                    if m.start() < b and m.end() > a:
                        found.append((*m.span(), "address"))
        elif kind == "cue":
            if m := CUED.match(text, b):
                s, e = m.span(1)
                words = WORDS(text[s:e])
                sure = not any(w.lower() in NOT_NAME for w in words) and (low[a:b] not in WEAK or any(known.like_name(w, here) for w in words))
                if sure and _is_case(text, s, e):
                    found.append((s, e, "name"))
            elif m := HAN_NAME.match(text, b):
                found.append((*m.span(), "name"))
    for m in SHORT.finditer(text):
        if _initials_case(text, *m.span(), known, here):
            found.append((*m.span(), "name"))
    found += [(*m.span(), "id_number") for m in OPEN_ID.finditer(text)]
    found += [(*m.span(), "phone") for m in OPEN_PHONE.finditer(text) if not OTHER_NUMBER.search(text, max(0, m.start() - 20), m.start())]
    found += _bylines(text, known, here)
    found += _runs(text, known, here)
    return _best(found)


def _initials_case(text: str, a: int, b: int, known: Uses, here: Container[str]) -> bool:
    family = re.split(r"[. ]+", text[a:b])[-1]
    return known.like_name(family, here) and not NO_INITIALS.match(text, a) and not AFTER_NUMBER.search(text, max(0, a - 2), a) and _is_case(text, a, b)


PIECE = re.compile(rf"{INITIALS}|[\p{{L}}'’-]+")


def _runs(text: str, known: Uses, here: Container[str]) -> Iterator[tuple[int, int, str]]:
    """Names in running text: capitalised words side by side, each used like a name; and ``Family, Given`` of known given names."""
    for m in RUN.finditer(text):
        part: list[tuple[int, int]] = []
        full = 0
        for p in [*PIECE.finditer(m.group()), None]:
            w = p.group() if p else ""
            small = w[:1].islower()
            if p and (len(w) == 1 or w.endswith(".") or small or all(known.like_name(x, here) for x in w.split("-") if len(x) > 1)):
                if part or not (small or len(w) == 1 or w.endswith(".")):
                    part.append(p.span())
                    full += not small and len(w) > 1 and not w.endswith(".")
                continue
            a, b = (m.start() + part[0][0], m.start() + part[-1][1]) if part else (0, 0)
            if 1 < full < 4 and _sure_run(text, a, b, full, known):
                yield a, b, "name"
            part, full = [], 0
    for m in TURNED.finditer(text):
        family, _, given = m.group().partition(", ")
        first = FIRST_WORD(given).group().lower()
        if first in known.given and family.lower() not in known.given and all(known.like_name(x, here) for x in family.split("-")) and _is_case(text, *m.span()):
            yield (*m.span(), "name")


NUMBERED = re.compile(r"[-–/#]?\d|[-–/]\p{Lu}")


def _sure_run(text: str, a: int, b: int, full: int, known: Uses) -> bool:
    words = WORDS(text[a:b])
    # Letters of an identifier, and what has a number behind it.
    if NUMBERED.match(text, b) or any(w.isupper() for w in words[1:-1]) and not words[0].isupper():
        return False
    if any(len(w) > 1 and w.isupper() for w in words) and (words[0].isupper() or len(words[-1]) < 3) and words[0].lower() not in known.given:
        return False
    # Three words where a sentence begins: the first may be any word that the corpus hasn't shown yet.
    if full > 2 and words[0].lower() not in known.given and BEGUN.search(text, max(0, a - 6), a):
        return False
    return _is_case(text, a, b)


def _bylines(text: str, known: Uses, here: Container[str]) -> Iterator[tuple[int, int, str]]:
    """Lines that hold nothing but names."""
    pos = 0
    for line in text.split("\n"):
        s = line.strip()
        if len(s) > 5 and s[0].isupper() and (m := NAME.match(s)) and ENDED.match(s, m.end()):
            parts, at, ok = [], 0, True
            for part in SPLIT.split(s):
                if NAME.fullmatch(part):
                    words = WORDS(part)
                    if any(w.lower() in NOT_NAME for w in words):
                        ok = False
                        break
                    parts.append((at, at + len(part), all(known.like_name(w, here) or w.lower() in FULL_OF for w in words)))
                elif part.strip() and not SPLIT.fullmatch(part):
                    ok = False
                    break
                at += len(part)
            # A name that is a word as well (``Will``) stands beside names that are none.
            if ok and parts and 2 * sum(sure for *_, sure in parts) >= len(parts):
                base = pos + line.index(s)
                yield from ((base + x, base + y, "name") for x, y, sure in parts if sure or len(parts) > 1)
        pos += len(line) + 1


def _best(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The longest of overlapping findings; of equal ones the kind that stands first."""
    out: list[tuple[int, int, str]] = []
    for f in sorted(set(found), key=lambda f: (f[0] - f[1], f[0], KINDS.index(f[2]))):
        k = bisect.bisect_left(out, f)
        if (k == 0 or out[k - 1][1] <= f[0]) and (k == len(out) or out[k][0] >= f[1]):
            out.insert(k, f)
    return out


def redacted(text: str | None, known: Uses = NO_USES) -> str | None:
    if text is None:
        return None
    parts, at = [], 0
    for a, b, kind in spans(text, known):
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*parts, text[at:]])


def find(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``row_id, kind, found_value``: each different value of each document."""
    shared = df.sparkSession.sparkContext.broadcast(uses(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, kind, t[x:y]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x, y, kind in spans(t, shared.value)]
            rows = list(dict.fromkeys(rows))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=[row_id, "kind", "found_value"])

    some = df.where(F.col(row_id).isNotNull() & F.col(text).isNotNull())
    # Rows of one id rarely repeat; where they do, distinct() makes their values different again.
    return some.select(F.col(row_id).cast("long").alias(row_id), F.col(text).alias("_t")).mapInArrow(run, f"`{row_id}` long, kind string, found_value string").distinct()


def redact(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``row_id, text`` with typed placeholders; every row is kept."""
    shared = df.sparkSession.sparkContext.broadcast(uses(df, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([redacted(t, shared.value) for t in b.column(1).to_pylist()], pa.string())], names=[row_id, "text"])

    return df.select(F.col(row_id).cast("long").alias(row_id), F.col(text).alias("_t")).mapInArrow(run, f"`{row_id}` long, text string")
