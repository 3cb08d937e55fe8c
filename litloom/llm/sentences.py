"""Sentence boundaries across languages and scripts (problem 7).

Candidate boundaries are the ends of terminator runs with their closing quotes and brackets, and in Thai the spaces. Each is
classified by a maximum-entropy model over the neighbouring tokens, their case, length, digits and script. The model
is fitted on boundaries that are reliable by themselves: a candidate before a blank line or the end of a text is one;
a candidate followed by a lower-case word, or beside a token that is frequent there and yet never stands at the edge
of a paragraph (``Dr.``, ``Abb.``, ``3.`` before a month), is none, nor is a Thai space beside a figure or a unit of
measure. Blank lines and heading lines part units by definition and need no model.

The fit takes at most ``FIT_ROWS`` texts, those with the smallest hash of their id, and of these as many as make up at
most ``FIT_CHARACTERS``; it runs in one task, and only the fitted model comes to the driver. Every text is then segmented.

Defined results: null, empty and blank texts have no units; rows with a null id are left out; a text that occurs
twice gives its units for each id; a null language is guessed from the script and the commonest short words of
the fitted languages. Extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most texts that the model is fitted on.
FIT_ROWS = 4000
FIT_CHARACTERS = 12_000_000
DIMENSIONS = 1 << 18
#: A token that should have stood at a paragraph's edge this many times and never did can't end (or begin) a unit.
EXPECTED = 4.5

CLOSERS = "\"'”’»›）)］]」』】"
OPENERS = "\"'“‘«‹（([「『【„¿¡"
TERMINATORS = ".!?…。！？｡।॥؟۔;;"
NO_SPACE = r"぀-ヿ㐀-鿿가-힯"
WORD = re.compile(r"[^\W\d_]+(?:[.\-’'][^\W\d_]+)*|\d+(?:[.,:/]\d+)*", re.U)
RUN = re.compile(rf"[{re.escape(TERMINATORS)}]+(?:\s?[»›](?![\w«])|[{re.escape(CLOSERS)}“])*")
BLANK = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r\n[^\S\n]*\r\n\s*")
HEADING = re.compile(r"^\s*\d{1,2}(?:\.\d{1,2})*\.?[^\S\n]+\S")
THAI = re.compile(r"[฀-๿]")
THAI_UNIT = re.compile(r"^(?:[ก-ฺเ-๎]{1,4}\.(?:[ก-ฺเ-๎]{1,4}\.)?|[A-Za-zµμ°Ω%/0-9²³·\-]{1,6})$")
SPACE = re.compile(r"\s+")


def script(c: str) -> str:
    n = ord(c)
    if n < 0x250 or 0x1E00 <= n < 0x1F00:
        return "latin"
    for name, lo, hi in (("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF)):
        if lo <= n <= hi:
            return name
    return "other"


def token_class(w: str) -> str:
    if not w:
        return ""
    if w[0].isdigit():
        return "#" + ("." if not w.isdigit() else str(min(len(w), 5)))
    return w.lower() if len(w) < 18 else w[-12:].lower()


def case_of(w: str, after: str) -> str:
    if not w:
        return "none"
    if w[0].isdigit():
        return "digit"
    c = w[0]
    if c.islower():
        if any(x.isupper() for x in w):
            return "mixed"
        return "symbol" if len(w.split("-")[0]) == 1 and not c.isascii() and w[1:2] == "-" else "lower"
    return "upper" if c.isupper() or c.istitle() else "caseless"


class Candidate:
    __slots__ = ("at", "edge", "gap", "next", "next_raw", "prev", "features", "kind", "sure")


def is_heading(line: str, first: bool) -> bool:
    s = line.strip()
    if not s or s[-1] in TERMINATORS + CLOSERS + "“" or len(s) > 60:
        return False
    return bool(HEADING.match(s)) and len(s.split()) <= 6 or first and len(s.split()) <= 3


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Stretches that no unit crosses: (start, end, heading), in order, without surrounding white space."""
    at, first = 0, True
    for m in [*BLANK.finditer(text), None]:
        end = m.start() if m else len(text)
        start = at
        pos = at
        for line in text[at:end].split("\n"):
            stop = pos + len(line)
            if is_heading(line, first):
                if text[start:pos].strip():
                    yield *_trim(text, start, pos), False
                yield *_trim(text, pos, stop), True
                start = stop
            if line.strip():
                first = False
            pos = stop + 1
        if text[start:end].strip():
            yield *_trim(text, start, end), False
        at = m.end() if m else end


def _trim(text: str, a: int, b: int) -> tuple[int, int]:
    s = text[a:b]
    return a + len(s) - len(s.lstrip()), b - (len(s) - len(s.rstrip()))


def candidates(text: str, a: int, b: int, lang: str) -> list[Candidate]:
    """Candidate boundaries of one block; ``at`` is where the next unit would begin, ``edge`` marks the block's end."""
    out = []
    for m in RUN.finditer(text, a, b):
        run, end = m.group(), m.end()
        if "“" in run and "„" not in text[max(a, m.start() - 300) : m.start()]:
            end = m.start() + run.index("“")
            run = text[m.start() : end]
        mark = run[0]
        if mark in ";;" and not (m.start() and script(text[m.start() - 1]) == "greek"):
            continue
        rest = SPACE.match(text, end, b)
        at = rest.end() if rest else end
        edge = at >= b
        nxt = text[at : at + 40]
        raw = nxt.lstrip(OPENERS + " ")
        w = WORD.match(raw)
        following = w.group() if w else raw[:1]
        tight = re.match(rf"[{NO_SPACE}]", raw)
        if tight:
            following = raw[:2]
        if not edge and not rest:
            before = WORD.findall(text[max(a, m.start() - 30) : m.start()])
            last = before[-1] if before else ""
            if mark in ".…;":
                joined = following[:1].isupper() and len(last) > 2 and last[-1:].islower() or tight or following[:1].isdigit() and re.match(rf"\d+[{NO_SPACE}]", raw) and not last[-1:].isdigit()
                if not joined or text[m.start() - 1 : m.start()].isdigit() and not tight:
                    continue
            elif raw[:1] and not (tight or raw[0].isalnum() or nxt[0] in OPENERS):
                continue
        c = Candidate()
        c.at, c.edge = at, edge
        c.gap = "none" if not rest else "line" if "\n" in rest.group() else "space"
        left = text[max(a, m.start() - 40) : m.start()]
        words = WORD.findall(left)
        prev = words[-1] if words and left.rstrip()[-1:].isalnum() else ""
        if re.match(rf"[{NO_SPACE}]", left[-1:]):
            prev = left[-2:]
        c.prev = token_class(prev) + run.translate({ord(x): "”" for x in CLOSERS + "“"})[:3].strip()
        c.next = token_class(following) if not tight else following
        c.next_raw = following
        quoted = "q" if len(run) > 1 and run[-1] in CLOSERS + "“" else ""
        case = "edge" if edge else case_of(following, raw)
        opener = "o" if nxt[:1] in OPENERS else ""
        earlier = token_class(words[-2]) if len(words) > 1 else ""
        c.kind = case
        c.features = [f"l={lang}", f"m={mark}{quoted}{'+' if run[:2] in ('..', '……') else ''}", f"c={case}", f"mc={mark}{quoted}|{case}", f"o={opener}|{quoted}", f"p={c.prev}", f"lp={lang}|{c.prev}", f"n={c.next}", f"ln={lang}|{c.next}", f"pl={min(len(prev), 6)}|{prev[:1].isupper()}|{prev[:1].isdigit()}", f"pi={'.' in prev}", f"pc={c.prev}|{case}", f"e={earlier}|{token_class(prev)}", f"s={script(raw[:1]) if raw else ''}|{mark}"]
        out.append(c)
    return out


def thai_class(token: str) -> str:
    return "digit" if token[:1].isdigit() or token[-1:].isdigit() else "unit" if THAI_UNIT.match(token.rstrip(",;")) else "word"


def thai_candidates(text: str, a: int, b: int) -> list[Candidate]:
    """In Thai, the spaces of a block, beside Thai letters or the end of a sentence in another script; and the block's end."""
    out, words = [], [(m.start(), m.group()) for m in re.finditer(r"\S+", text[a:b])]
    for (_, left), (at, right) in zip(words, [*words[1:], (b - a, "")]):
        if right and not (THAI.search(left[-1:]) or THAI.search(right[:1]) or left[-1:] in ".!?"):
            continue
        c = Candidate()
        c.at, c.edge, c.gap = a + at, not right, "space"
        c.prev, c.next, c.next_raw = "", "", right
        beside = ("digit" if left[-1:].isdigit() else "unit" if THAI_UNIT.match(left) else "word", "digit" if right[:1].isdigit() else thai_class(right) if right else "none")
        c.kind = "thai" if set(beside) <= {"word", "none"} else "figure"
        c.features = ["l=th", "m=space", f"tl={beside[0]}", f"tr={beside[1]}", f"tt={beside[0]}|{beside[1]}"]
        out.append(c)
    return out


class Model:
    """Weights of the hashed features, and the tokens that never stand at a paragraph's edge."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        self.words = self._common_words(rows)
        seen: list[tuple[str, Candidate]] = []
        thai: list[Candidate] = []
        starts: Counter = Counter()
        for lang, text in rows:
            lang = lang or self.guess(text)
            for a, b, heading in blocks(text):
                if heading:
                    continue
                found = candidates(text, a, b, lang)
                if found or len(text[a:b]) > 80:
                    w = WORD.match(text[a:b].lstrip(OPENERS + " "))
                    raw = text[a:b].lstrip(OPENERS + " ")
                    starts[lang, raw[:2] if re.match(rf"[{NO_SPACE}]", raw) else token_class(w.group() if w else raw[:1])] += 1
                seen += [(lang, c) for c in found]
                if THAI.search(text, a, b):
                    thai += thai_candidates(text, a, b)
        prev_all, prev_edge, next_all = Counter(), Counter(), Counter()
        for lang, c in seen:
            prev_all[lang, c.prev] += 1
            if c.edge:
                prev_edge[lang, c.prev] += 1
            elif c.kind != "lower":
                next_all[lang, c.next] += 1
        n, e, s = Counter(), Counter(), Counter()
        for (lang, _), k in prev_all.items():
            n[lang] += k
        for (lang, _), k in prev_edge.items():
            e[lang] += k
        for (lang, _), k in starts.items():
            s[lang] += k
        self.never_ends = {k for k, x in prev_all.items() if k not in prev_edge and x * e[k[0]] / n[k[0]] >= EXPECTED}
        self.never_starts = {k for k, x in next_all.items() if k not in starts and x * s[k[0]] / max(1, n[k[0]] - e[k[0]]) >= EXPECTED}
        labelled = []
        for lang, c in seen:
            if (lang, c.prev) in self.never_ends or not c.edge and (lang, c.next) in self.never_starts:
                labelled.append((self.indices(lang, c), 0))
            elif c.edge:
                labelled.append((self.indices(lang, c, hide=True), 1))
            elif c.kind == "lower":
                labelled.append((self.indices(lang, c), 0))
            elif (lang, c.next) in starts and (lang, c.prev) in prev_edge and c.gap != "none":
                labelled.append((self.indices(lang, c), 1))
        labelled += [(np.array([_hash(f) for f in c.features[: 3 if c.edge else 5]], np.int64), int(c.edge)) for c in thai if c.edge or c.kind == "figure"]
        self.weights = np.zeros(DIMENSIONS, np.float32)
        self._fit(labelled)

    @staticmethod
    def _common_words(rows: list[tuple[str | None, str]]) -> dict[str, set[str]]:
        by: dict[str, Counter] = defaultdict(Counter)
        for lang, text in rows:
            if lang:
                by[lang].update(w.lower() for w in WORD.findall(text) if not w[0].isdigit() and len(w) < 5)
        return {k: {w for w, _ in c.most_common(30)} for k, c in by.items()}

    def guess(self, text: str) -> str:
        kinds = Counter(script(c) for c in text if c.isalpha())
        total = sum(kinds.values()) or 1
        for name, lang in (("thai", "th"), ("kana", "ja"), ("han", "zh"), ("devanagari", "hi"), ("arabic", "ar"), ("greek", "el")):
            if kinds[name] > total * 0.25:
                return lang
        words = Counter(w.lower() for w in WORD.findall(text) if len(w) < 5)
        latin = [k for k in sorted(self.words) if k in ("en", "de", "fr", "es")] or sorted(self.words)
        return max(latin, key=lambda k: sum(words[w] for w in self.words[k]), default="en")

    def indices(self, lang: str, c: Candidate, hide: bool = False) -> np.ndarray:
        fs = [*c.features, f"ne={(lang, c.prev) in self.never_ends}", f"ns={(lang, c.next) in self.never_starts}"]
        if hide:  # what follows a paragraph says nothing of a boundary within one
            fs = [f for f in fs if f[:2] not in ("c=", "mc", "o=", "n=", "ln", "pc", "s=", "ns")]
        return np.array([_hash(f) for f in fs], np.int64)

    def _fit(self, labelled: list[tuple[np.ndarray, int]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-5) -> None:
        """Logistic regression by AdaGrad over mini-batches, in a fixed order."""
        if not labelled:
            return
        order = np.random.default_rng(0)
        grads = np.full(DIMENSIONS, 1e-6, np.float32)
        y = np.array([l for _, l in labelled], np.float32)
        size = max(len(i) for i, _ in labelled)
        x = np.zeros((len(labelled), size), np.int64)
        for k, (i, _) in enumerate(labelled):
            x[k, : len(i)] = i
        real = x > 0
        for _ in range(epochs):
            for batch in np.array_split(order.permutation(len(y)), max(1, len(y) // 256)):
                w = self.weights[x[batch]] * real[batch]
                error = 1 / (1 + np.exp(-w.sum(1))) - y[batch]
                step = np.zeros(DIMENSIONS, np.float32)
                np.add.at(step, x[batch], error[:, None] * real[batch])
                hit = np.flatnonzero(step)
                g = step[hit] + decay * self.weights[hit]
                grads[hit] += g * g
                self.weights[hit] -= rate * g / np.sqrt(grads[hit])

    def language_at(self, text: str, at: int, lang: str) -> str:
        """The language of a candidate: that of the text, but for Latin letters within another script."""
        own = {"zh": "han", "ja": "kana", "th": "thai", "hi": "devanagari", "ar": "arabic", "el": "greek"}.get(lang)
        left = text[max(0, at - 100) : at]
        if own and re.search(r"[A-Za-z]{2,}\W*$", left):
            latin = re.findall(r"[A-Za-zÀ-ž]+(?:[^\w]+[A-Za-zÀ-ž]+)*", left)
            return self.guess(latin[-1]) if latin and len(latin[-1].split()) > 2 else lang
        return lang

    def accepts(self, lang: str, c: Candidate) -> bool:
        if (lang, c.prev) in self.never_ends or (lang, c.next) in self.never_starts:
            return False
        return float(self.weights[self.indices(lang, c)].sum()) > 0

    def starts(self, text: str | None, lang: str | None) -> list[int]:
        """The offset of each unit of a text."""
        if not text or not text.strip():
            return []
        lang = lang or self.guess(text)
        out = []
        for a, b, heading in blocks(text):
            out.append(a)
            if heading:
                continue
            found = {c.at for c in candidates(text, a, b, lang) if not c.edge and self.accepts(self.language_at(text, c.at, lang), c)}
            if lang == "th" or THAI.search(text, a, b):
                found |= {c.at for c in thai_candidates(text, a, b) if not c.edge and float(self.weights[[_hash(f) for f in c.features]].sum()) > 0}
            out += sorted(found)
        return out


@functools.lru_cache(1 << 18)
def _hash(s: str) -> int:
    """A stable FNV-1a hash into the weights, never 0."""
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h % (DIMENSIONS - 1) + 1


def fit(df: DataFrame, row_id: str, text: str, lang: str, rows: int = FIT_ROWS, characters: int = FIT_CHARACTERS) -> Model:
    """The model, fitted in one task on a sample bounded in texts and in characters."""
    some = df.where(F.col(text).isNotNull() & F.col(row_id).isNotNull()).select(F.xxhash64(row_id).alias("_h"), F.col(row_id).cast("long").alias("_i"), F.col(lang).alias("_l"), F.col(text).alias("_t"))
    sizes = some.select("_h", "_i", F.length("_t").alias("_n")).orderBy("_h", "_i", "_n").limit(rows).collect()
    upto = list(itertools.takewhile(lambda total: total <= characters, itertools.accumulate(r["_n"] for r in sizes)))
    last = sizes[len(upto) - 1] if upto else None
    few = some.where((F.col("_h") < last["_h"]) | (F.col("_h") == last["_h"]) & (F.col("_i") <= last["_i"])) if last else some.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)) if r[3].strip()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model([(l, t) for _, _, l, t in sorted(read, key=str)]))], pa.binary())], names=["model"])

    made = few.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else Model([])


def segment(df: DataFrame, row_id: str, text: str, lang: str, model: Model | None = None) -> DataFrame:
    """``row_id, start_char``: one row for each sentence unit of each text."""
    shared = df.sparkSession.sparkContext.broadcast(model or fit(df, row_id, text, lang))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            ids, at = [], []
            for i, t, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                got = m.starts(t, l)
                ids += [i] * len(got)
                at += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64())], names=[row_id, "start_char"])

    rows = df.where(F.col(row_id).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(row_id).cast("long").alias(row_id), F.col(text).alias("_t"), F.col(lang).alias("_l")).mapInArrow(run, f"`{row_id}` long, start_char long")
