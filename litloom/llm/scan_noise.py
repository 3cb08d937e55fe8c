"""Noise in text from scanned pages (problem 5).

1. All texts are counted once: each word with its occurrences in born-digital and in other texts. The frequent words,
   those that make up at least 1/50000 of all (so never more than 50000, whatever the data), go to the executors.
2. Skip-gram vectors of all frequent words are learned from all texts: every pair of frequent words within the window is
   counted, and the vectors are fitted to these counts (``Fit``); how well a word fits where it stands is the mean product
   of its vector with its neighbours' output vectors. What frequent words reach at all of their own places sets the marks:
   ``floor``, which all but one in a hundred reach, and ``usual``, which half of them reach.
3. Each scanned text is read line by line: page numbers (a decorated number, or a plain one that counts on from page to
   page), running heads (journal names, ``author · title``, capitals, or a line beside a page number that breaks the
   sentence and returns on other pages), words broken at line ends, and rare words within a plausible glyph edit of a
   frequent word. Of several such words the one that fits the context best is meant; if even that one doesn't reach the
   floor, none is, and the rare word stands. A word of two or three letters,
   where any edit makes another word, counts only if the one meant reaches the usual mark.
4. A suspicious word is dropped from the findings if the born-digital texts have it; one that has no frequent
   neighbour (a name, say) counts if it is a slip of a more frequent word, found by the trie join of all rare words.
   Frequent words that never stand beside another have no vector and go by the edit alone.
5. ``repair`` removes the furniture, joins broken words, puts the words meant and reflows the paragraphs.

Defined results: null, empty and blank texts have no noise and are repaired to themselves; rows with a null id are left
out of the findings; a repeated row repeats no finding; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import functools
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.author_names import forms, linked
from litloom.llm.canonical_list import words_of
from litloom.llm.glyphs import distance, folded
from litloom.plans.lineage import cut

SHARE = 50_000
LEAST = 3
OFTEN = 8
DIMENSIONS = 24
WINDOW = 3
#: Bounds of memory, not of what is read: words that a block of texts has before it is closed, different pairs that a task
#: holds before it hands them on, and cells of the matrix of words by words that are worked on at a time.
BLOCK = 250_000
HELD = 2_000_000
CELLS = 500_000
#: Bits of a number that hold how often a pair of words is; above these is the number of a word.
OFTENEST = 46
#: Characters that a piece between white space has at most if it is remembered.
PIECE = 40
#: MB of the row groups of tables with wide rows.
WIDE = 8
#: The marks are exact to this part of a unit.
GRAIN = 1000
# Signs of a word broken at the end of its line, ligatures, the forms of a page number, and the small words
# before which a hyphen is suspended.
BREAKS = "-¬­‐"
LIGATURES = re.compile("[ﬀﬁﬂﬃﬄﬅﬆ]")
PAGE = re.compile(r"^\s*(?P<a>[—–-]\s?|p\. ?|pp?\.|Page |page |\[|\(|· ?|S\. |Seite |)(?P<n>[0-9OolISB]{1,4}|[ivxlc]{1,8})(?P<b>\s?[—–-]|\]|\)| ?·| of [0-9OolISB]{1,4}|/[0-9OolISB]{1,4}|)\s*$")
#: No line that ``PAGE`` matches has more characters between its white space.
LONGEST_PAGE = 22
SUSPENDED = frozenset("and or to und oder bis et ou y o e and/or".split())
HEADING = re.compile(r"^\s*(?:[0-9lIO]{1,2}\.?\s+\p{Lu}\p{L}+(?:\s\p{L}+){0,3}|Abstract|Zusammenfassung|Résumé|Resumen|Summary)\s*$")
TOKEN = re.compile(r"[\p{L}\p{M}\d­¬’']+(?:[.,][\p{L}\d]+)*(?:[-‐][\p{L}\p{M}\d’']+)*")
VOLUME = re.compile(r"\s\d{1,4}\s\(\d{4}\)\s*$")
INLINE = re.compile(r"^\s*(\d{1,4})\s{2,}(\S.*?)\s*$|^\s*(\S.*?)\s{2,}(\d{1,4})\s*$")
TABLE = re.compile(r"^\s*[\dOolISB.,]+(?:\s{2,}[\dOolISB.,]+)+\s*$")
NUMBERLIKE = re.compile(r"^[\d.,:/%–-]*$")
MIXED = re.compile(r"(?=.*\d)(?=.*\p{L})")
PARTS = re.compile("[-'.]")
NO_WORD = re.compile(r"v\d+(?:\.\d+)*|\d+(?:st|nd|rd|th|s|er|e|o|a)|[a-z]\d{1,3}")
AND_OTHERS = re.compile(r"^\p{Lu}[\p{L}\d’'-]+ et al\.$")
AXIS = re.compile(r"\s*\p{L}\s*")
RUNS = re.compile(r"[\p{L}\d]+")
LOWER_WORD = re.compile(r"(?<!\S)\p{Lowercase}\S{3}")
NEXT_SENTENCE = re.compile(r"[.!?;] \p{Lu}")


ENDING = re.compile(r"(?r)([\p{L}\d’'-]+)[-¬­‐]$")
BEGINNING = re.compile(r"\s*([\p{L}\d’']+)")
BROKEN_INSIDE = re.compile(r"(?<=([\p{L}’'-]+))([-¬­‐]) (\p{Ll}[\p{L}’']*)")


def tokens(text: str) -> list[tuple[str, int]]:
    return [(m.group().strip("’'"), m.start()) for m in TOKEN.finditer(text)]


def placed(found: list[str], line: str) -> list[tuple[str, int]]:
    """``tokens`` of a line whose tokens were found already: no character that a token has lies between two of them."""
    out, at = [], 0
    for raw in found:
        at = line.index(raw, at)
        out.append((raw.strip("’'"), at))
        at += len(raw)
    return out


def broken_inside(line: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Where it begins and ends, first part, sign and second part of each word broken inside a line; no two overlap. The sign is looked for and the first part read backward from it, as signs are rarer than words."""
    done = 0
    for m in BROKEN_INSIDE.finditer(line):
        start, sign = max(m.start(1), done), m.start(2)
        if start < sign:
            done = m.end()
            yield start, done, line[start:sign], m.group(2), m.group(3)


def plain(word: str) -> str:
    return word.replace("’", "'").casefold()


class _Lowered(dict):
    """The plain forms of the counted words of each piece of a text between white space, remembered for the last of the short pieces."""

    def __missing__(self, piece: str) -> list[str]:
        low = [plain(raw.strip("’'")) for raw in COUNTED(piece)]
        if len(piece) <= PIECE:
            if len(self) >= 1 << 17:
                self.clear()
            self[piece] = low
        return low


class _Pieces(dict):
    """The tokens of each piece of a line between white space, which no token crosses, their plain forms, and which of them are doubtful; remembered for the last of the short pieces. ``sound`` has those of them without doubtful tokens."""

    def __init__(self, doubtful: Callable[[str, str], bool]):
        self.doubtful = doubtful
        self.sound: set[str] = set()

    def __missing__(self, piece: str) -> tuple[list[str], list[str], list[int]]:
        found = TOKEN.findall(piece)
        low = [plain(raw.strip("’'")) for raw in found]
        doubts = [t for t, w in enumerate(low) if self.doubtful(found[t].strip("’'"), w)]
        if len(piece) <= PIECE:
            if len(self) >= 1 << 16:
                self.clear()
                self.sound.clear()
            self[piece] = found, low, doubts
            if not doubts:
                self.sound.add(piece)
        return found, low, doubts


# -- 1 words ------------------------------------------------------------------------------------------------------------


COUNTED = re.compile(r"[\p{L}\p{M}\d’']+(?:-[\p{L}\p{M}\d’']+)*").findall


class _Block:
    """Some texts as places among their different pieces between white space, which no word crosses."""

    def __init__(self, low: dict[str, list[str]]):
        self.pieces, self.low = _Numbered(), low
        self.clean: list[int] = []
        self.other: list[int] = []
        self.size = 0

    def add(self, text: str, clean: bool) -> bool:
        """Whether the block is full."""
        to = self.clean if clean else self.other
        to.extend(map(self.pieces.__getitem__, text.split()))
        to.append(-1)
        self.size += len(text)
        return len(self.clean) + len(self.other) >= BLOCK or self.size >= 8 * BLOCK

    def spelled(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different words, and the born-digital and the other texts as places among them, with -1 behind each text."""
        words = _Numbered()
        flat, each = array("i"), array("i")
        for piece in self.pieces:
            found = self.low[piece]
            each.append(len(found))
            flat.extend(map(words.__getitem__, found))
        # Behind the last piece, which the ends of texts (-1) take, stands -1.
        flat.append(-1)
        each.append(1)
        flat, each = np.frombuffer(flat, np.int32), np.frombuffer(each, np.int32)
        first = np.cumsum(each) - each
        out = []
        for at in (self.clean, self.other):
            at = np.array(at, np.int32)
            n = each[at]
            out.append(flat[np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
        return list(words), *out

    def row(self) -> pa.RecordBatch:
        words, clean, other = self.spelled()
        in_clean, in_other = (np.bincount(x[x >= 0], minlength=len(words)) for x in (clean, other))
        cols = [words], [in_clean], [in_clean + in_other], [np.concatenate([clean, other]).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["words", "clean", "n", "places"])


class _Numbered(dict):
    """Numbers what it is asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = k = len(self)
        return k


def spelled(texts: DataFrame) -> DataFrame:
    """``words, clean, n, places`` of ``text, clean`` rows: blocks of whole texts with the occurrences of their words in born-digital texts and in all; ``places`` has the texts themselves, as int32 places in ``words`` with -1 behind each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = _Lowered()
        block = _Block(low)
        for b in batches:
            for t, clean in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t and block.add(t, bool(clean)):
                    yield block.row()
                    block = _Block(low)
        if block.pieces:
            yield block.row()

    return texts.select("text", "clean").mapInArrow(run, "words array<string>, clean array<long>, n array<long>, places binary")


def word_counts(blocks: DataFrame) -> DataFrame:
    """``word, clean, n`` of ``spelled`` texts: occurrences in born-digital texts and in all."""
    words = blocks.selectExpr("inline(arrays_zip(words, clean, n))").where("words <> ''")
    return words.groupBy(F.col("words").alias("word")).agg(F.sum("clean").alias("clean"), F.sum("n").alias("n"))


class Words:
    """The frequent words, and the way to them from a misread one."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        self.n = {w: n for w, (_, n) in counts.items()}
        # Each form of a word, whole and with one letter left out: two words within one edit share an entry.
        self.shortened: dict[str, list[str]] = {}
        usable = {w for w in counts if not any(ch.isdigit() for ch in w)}
        for w in usable:
            for form in set(forms(w)):
                for x in _lessened(form):
                    self.shortened.setdefault(x, []).append(w)
        # A misreading so common that it looks like a word: never in born-digital texts, a far commoner word beside it.
        for w, (clean, n) in counts.items():
            if not clean and w not in usable and MIXED.match(w):
                del self.n[w]
            elif not clean and len(w) > 1 and w in usable:
                best = max((counts[x][1] for x in self._within_one(w) if x != w and glyphic(w, x)), default=0)
                if best > OFTEN * n:
                    del self.n[w]
        self.glyphs: dict[str, list[str]] = {}
        for w in self.n:
            self.glyphs.setdefault(folded(w), []).append(w)
        self.near = functools.lru_cache(1 << 17)(self._near)

    def _within_one(self, word: str) -> set[str]:
        out = set()
        for form in set(forms(word)):
            for x in _lessened(form):
                for w in self.shortened.get(x, ()):
                    if w not in out and any(distance(form, f, 1) <= 1 for f in forms(w)):
                        out.add(w)
        return out

    def __contains__(self, word: str) -> bool:
        return word in self.n

    def known(self, word: str) -> bool:
        if word in self.n:
            return True
        if word.isalnum():
            return False
        parts = [x for x in PARTS.split(word) if x]
        return len(parts) > 1 and all(x in self.n or len(x) == 1 for x in parts)

    def _near(self, word: str) -> tuple[str, ...]:
        """Frequent words that this one may be a misreading of, the commonest first."""
        out: dict[str, int] = {}
        for w in self.glyphs.get(folded(word), ()):
            if w != word and len(w) > 1:
                out[w] = self.n[w]
        least = 4 if len(word) > 3 else 2
        for w in self._within_one(word):
            if w in self.n and w != word and len(w) >= least and (least > 2 or w.isalpha()):
                out[w] = self.n[w]
        return tuple(sorted(out, key=lambda w: (-out[w], w)))


def _lessened(form: str) -> set[str]:
    return {form, *(form[:k] + form[k + 1 :] for k in range(len(form)))}


def glyphic(a: str, b: str) -> bool:
    return folded(a) == folded(b) or len(a) > 3 and distance(a, b, 1) <= 1


# -- 2 vectors ----------------------------------------------------------------------------------------------------------


class Context:
    """Skip-gram vectors: how well a word fits among its neighbours, and what fits usually are."""

    def __init__(self, ids: dict[str, int], v: np.ndarray, u: np.ndarray, floor: float = 0.0, usual: float = 0.0):
        self.ids, self.v, self.u, self.floor, self.usual = ids, v, u, floor, usual

    def fit(self, word: str, around: list[str]) -> float | None:
        """None if the word or all its neighbours have no vector."""
        k = self.ids.get(word)
        near = [self.ids[x] for x in around if x in self.ids]
        return float(self.v[k] @ (np.add.reduce(self.u[near], 0) / np.float32(len(near)))) if k is not None and near else None


NO_CONTEXT = Context({}, np.zeros((0, DIMENSIONS), np.float32), np.zeros((0, DIMENSIONS), np.float32))


def numbered(words: list[str], places: np.ndarray, ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The frequent words of a block of texts in their order, and for each the number of its text."""
    s = np.array([*(ids.get(w, -1) for w in words), -2], np.int64)[places]
    text, keep = np.cumsum(s == -2), s >= 0
    return s[keep], text[keep]


def pairs(s: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """``smaller * size + larger`` for all two words within the window of each other."""
    out = [np.zeros(0, np.int64)]
    for k in range(1, WINDOW + 1):
        same = text[k:] == text[:-k]
        a, b = s[:-k][same], s[k:][same]
        out.append(np.minimum(a, b) * size + np.maximum(a, b))
    return np.concatenate(out)


class _Tally:
    """Counts keys; memory follows the different ones."""

    def __init__(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        if sum(map(len, self.waiting)) >= HELD:
            self.settle()

    def settle(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.waiting]), return_counts=True)
        self.waiting = []
        keys, n = np.concatenate([self.keys, new]), np.concatenate([self.n, n])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        at = np.flatnonzero(np.concatenate([np.ones(len(keys[:1]), bool), keys[1:] != keys[:-1]]))
        self.keys, self.n = keys[at], np.add.reduceat(n, at) if len(at) else n

    def taken(self) -> pa.RecordBatch:
        """What was counted so far; the tally is empty then."""
        self.settle()
        keys, n = self.keys, self.n
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])


class Fit:
    """Skip-gram with negative sampling as a task for each word: the counted pairs are its positive examples, weighted down where both words are frequent, and instead of drawn negatives their expectation is taken.

    With the vectors of one side fixed, the best vectors of the other are independent of each other, so that each row of
    the matrix of pairs is solved by itself, in any number of tasks, over all columns. ``prior`` pulls each vector to zero
    as so many examples would: what a word was seen with a few times says little for or against it.
    """

    def __init__(self, n: np.ndarray, negatives: int = 4, prior: float = 25.0):
        self.negatives, self.prior = negatives, prior
        self.kept = np.minimum(1.0, np.sqrt(2e-3 * max(1, n.sum()) / np.maximum(n, 1)))
        self.weight = np.zeros(len(n))

    def row(self, x: int, near: np.ndarray, n: np.ndarray) -> np.ndarray:
        return n * self.kept[near] * self.kept[x]

    def noise(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Of a word and of a word of the other side: the product is how often the two are a negative example."""
        p = self.weight**0.75
        p, w = p / p.sum(), self.weight / self.weight.sum()
        return (np.ones(len(p)), p) if side == 0 else (p / np.where(w > 0, w, 1), w)

    def solved(self, side: int, rows: list[tuple[int, np.ndarray, np.ndarray]], own: np.ndarray, other: np.ndarray, steps: int = 4) -> np.ndarray:
        """New vectors of the words of ``rows`` (word, its neighbours, how often): ``steps`` steps with a bound of the curvature, none of which makes the fit worse."""
        a, b = self.noise(side)
        u = other.astype(np.float32)
        kb = (self.negatives * b).astype(np.float32)
        shared = (u * kb[:, None]).T @ u
        out = [np.zeros((0, own.shape[1]), np.float32)]
        each = max(1, CELLS // len(own))
        for start in range(0, len(rows), each):
            part = rows[start : start + each]
            xs = [x for x, _, _ in part]
            q = np.zeros((len(part), len(own)), np.float32)
            bound = np.empty((len(part), own.shape[1], own.shape[1]), np.float32)
            for k, (x, near, n) in enumerate(part):
                q[k, near] = w = (self.row(x, near, n) / self.weight[x]).astype(np.float32)
                bound[k] = (u[near] * w[:, None]).T @ u[near]
            pull = (self.prior / self.weight[xs]).astype(np.float32)[:, None]
            ax = a[xs].astype(np.float32)[:, None]
            bound = 0.25 * (bound + ax[:, :, None] * shared) + pull[:, :, None] * np.eye(own.shape[1], dtype=np.float32)
            both = q + ax * kb
            v = own[xs].astype(np.float32)
            for _ in range(steps):
                g = v @ u.T
                np.negative(g, out=g)
                np.exp(g, out=g)
                g += 1
                np.divide(both, g, out=g)
                np.subtract(q, g, out=g)
                v = v + np.linalg.solve(bound, (g @ u - pull * v)[:, :, None])[:, :, 0]
            out.append(v)
        return np.concatenate(out)


def alternated(size: int, solved: Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], sweeps: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of both sides, each in turn solved (words, their vectors) against the other; the seed fixes where this begins."""
    sides = np.random.default_rng(0).standard_normal((2, size, DIMENSIONS)).astype(np.float32) / np.float32(DIMENSIONS**0.5)
    for side in [0, 1] * sweeps:
        xs, vectors = solved(side, sides[side], sides[1 - side])
        sides[side][xs] = vectors
    return sides[0], sides[1]


def place_fits(s: np.ndarray, text: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How well each word with a neighbour fits its place, in whole parts of ``GRAIN``."""
    total, near = np.zeros(len(s), np.float32), np.zeros(len(s), np.int32)
    vs, us = v[s], u[s]
    for k in range(1, WINDOW + 1):
        same = text[k:] == text[:-k]
        total[:-k] += np.einsum("nd,nd->n", vs[:-k], us[k:]) * same
        total[k:] += np.einsum("nd,nd->n", vs[k:], us[:-k]) * same
        near[:-k] += same
        near[k:] += same
    has = near > 0
    return np.floor(np.clip(total[has] / near[has], -100, 100) * GRAIN).astype(np.int64)


def mark(fits: np.ndarray, n: np.ndarray, share: float) -> float:
    """What ``share`` of all places don't exceed."""
    order = np.argsort(fits)
    return float(fits[order][np.searchsorted(np.cumsum(n[order]), share * n.sum())]) / GRAIN if len(fits) else 0.0


def skip_grams(texts: list[str], words: dict[str, int], epochs: int = 3) -> Context:
    """What ``Corpus`` learns over tables, for texts in memory: vectors of the frequent words that the texts have."""
    ids = {w: k for k, w in enumerate(sorted(words))}
    block = _Block(_Lowered())
    for t in texts:
        block.add(t, True)
    spelt, places, _ = block.spelled()
    s, text = numbered(spelt, places, ids)
    tally = _Tally()
    tally.add(pairs(s, text, max(1, len(ids))))
    tally.settle()
    if not len(tally.keys):
        return NO_CONTEXT
    near: dict[int, dict[int, int]] = {}
    for key, n in zip(tally.keys.tolist(), tally.n.tolist()):
        a, b = divmod(key, len(ids))
        near.setdefault(a, {})[b] = n * (1 + (a == b))
        near.setdefault(b, {})[a] = n * (1 + (a == b))
    rows = [(x, np.array(sorted(r)), np.array([r[y] for y in sorted(r)])) for x, r in sorted(near.items())]
    fit = Fit(np.bincount(s, minlength=len(ids)))
    for r in rows:
        fit.weight[r[0]] = fit.row(*r).sum()
    v, u = alternated(len(ids), lambda side, own, other: (np.array(sorted(near)), fit.solved(side, rows, own, other)), epochs)
    fits, n = np.unique(place_fits(s, text, v, u), return_counts=True)
    return Context({w: k for w, k in ids.items() if k in near}, v, u, mark(fits, n, 0.01), mark(fits, n, 0.5))


def _blocks(batches: Iterator[pa.RecordBatch], ids: dict[str, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        for words, places in zip(b.column(0), b.column(1)):
            yield numbered(words.as_py(), np.frombuffer(places.as_py(), np.int32), ids)


def _rows(b: pa.RecordBatch) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``x, near, n`` of a batch: each word, its neighbours and how often they are."""
    at, both = b.column(1).offsets.to_numpy(), b.column(1).values.to_numpy()
    near, n = both >> OFTENEST, both & ((1 << OFTENEST) - 1)
    return [(x, near[i:j], n[i:j]) for x, i, j in zip(b.column(0).to_pylist(), at[:-1], at[1:])]


def learned(blocks: DataFrame, counts: dict[str, int], sweeps: int = 3) -> Context:
    """Skip-gram vectors of the frequent words, and the marks, from every place of all ``spelled`` texts.

    Only what is as long as the list of frequent words comes to the driver: their vectors and weights.
    """
    sc = blocks.sparkSession.sparkContext
    ids = {w: k for k, w in enumerate(sorted(counts))}
    if not ids:
        return NO_CONTEXT
    size = len(ids)
    known = sc.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for s, text in _blocks(batches, known.value):
            tally.add(pairs(s, text, size))
            if len(tally.keys) >= HELD:
                yield tally.taken()
        yield tally.taken()

    texts = blocks.select("words", "places")
    counted = texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    # A neighbour and how often it is, in one number: these are sorted and kept without an object for each.
    both = counted.selectExpr(f"cast(key div {size} as int) as a", f"cast(key % {size} as int) as b", "n").selectExpr(f"inline(if(a = b, array(struct(a as x, shiftleft(cast(b as long), {OFTENEST}) + 2 * n as y)), array(struct(a as x, shiftleft(cast(b as long), {OFTENEST}) + n as y), struct(b as x, shiftleft(cast(a as long), {OFTENEST}) + n as y))))")
    rows = cut(both.groupBy("x").agg(F.sort_array(F.collect_list("y")).alias("near")), WIDE)
    fit = Fit(np.array([counts[w] for w in ids], np.int64))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [(x, float(fit.row(x, near, n).sum())) for x, near, n in _rows(b)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in of], pa.int32()), pa.array([w for _, w in of], pa.float64())], names=["x", "weight"])

    weights = {r["x"]: r["weight"] for r in rows.mapInArrow(weigh, "x int, weight double").collect()}
    if not weights:
        return NO_CONTEXT
    fit.weight[list(weights)] = list(weights.values())

    def solved(side: int, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = sc.broadcast((fit, own, other))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            f, mine, theirs = sent.value
            for b in batches:
                part = sorted(_rows(b), key=lambda r: r[0])
                xs = np.array([x for x, _, _ in part], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([xs.tobytes()], pa.binary()), pa.array([f.solved(side, part, mine, theirs).tobytes()], pa.binary())], names=["xs", "vectors"])

        got = rows.mapInArrow(run, "xs binary, vectors binary").collect()
        sent.unpersist()
        return np.concatenate([np.frombuffer(r["xs"], np.int32) for r in got]), np.concatenate([np.frombuffer(r["vectors"], np.float32) for r in got]).reshape(-1, own.shape[1])

    v, u = alternated(size, solved, sweeps)
    vectors = sc.broadcast((v, u))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for s, text in _blocks(batches, known.value):
            tally.add(place_fits(s, text, *vectors.value))
        yield tally.taken()

    got = texts.mapInArrow(measure, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
    fits, n = np.array([r["key"] for r in got], np.int64), np.array([r["n"] for r in got], np.int64)
    return Context({w: k for w, k in ids.items() if k in weights}, v, u, mark(fits, n, 0.01), mark(fits, n, 0.5))


def roman(s: str) -> int:
    """The value of a well-formed roman number, else 0."""
    if not re.fullmatch(r"(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", s) or not s:
        return 0
    value = [{"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}[c] for c in s]
    return sum(-v if k + 1 < len(value) and v < value[k + 1] else v for k, v in enumerate(value))


class Reader:
    """Reads the lines of a scanned text."""

    def __init__(self, counts: dict[str, tuple[int, int]], context: Context, journal_words: set[str]):
        self.words = Words(counts)
        self.context = context
        self.journal_words = journal_words
        self.journal_folded = {folded(w) for w in journal_words}
        self.word_at_fault = functools.lru_cache(1 << 17)(self._word_at_fault)
        # No frequent word, and at fault by itself or, if it is all letters, perhaps a part of a word with a gap in it.
        self.pieces = _Pieces(lambda raw, low: low not in self.words.n and (raw.isalpha() or self.word_at_fault(raw) is not None))

    # -- furniture

    def journal_like(self, line: str) -> bool:
        """Nothing but words of journal names, written as a name."""
        ws = RUNS.findall(VOLUME.sub("", line))
        letters = [w for w in ws if not w.isdigit()]
        if not 2 <= len(letters) <= 9 or line.rstrip()[-1:] in ".;,:":
            return False
        caps = sum(w[0].isupper() or w[0].isdigit() for w in letters if len(w) > 3)
        if caps < sum(len(w) > 3 for w in letters):
            return False
        known = sum(self._journal_word(w.lower()) for w in letters)
        return known >= len(letters) - (len(letters) > 3)

    @functools.lru_cache(1 << 14)
    def _journal_word(self, w: str) -> bool:
        w = words_of(w)[0] if words_of(w) else w
        return w in self.journal_words or folded(w) in self.journal_folded or len(w) > 5 and any(distance(w, j, 1) <= 1 for j in self.journal_words)

    def strong_head(self, line: str) -> bool:
        s = line.strip()
        # A longer word in lower case: no name, no capitals.
        if " · " not in s and not s.endswith("et al.") and LOWER_WORD.search(s):
            return False
        letters = [c for c in s if c.isalpha()]
        if len(letters) < 6 or HEADING.match(s):
            return False
        upper = sum(c.isupper() for c in letters)
        if upper >= 0.85 * len(letters) and len(s.split()) > 1 and not s.endswith("."):
            return True
        return " · " in s or bool(AND_OTHERS.match(s)) or bool(VOLUME.search(s)) and len(s.split()) < 12 and s[0].isupper() and self.journal_like(s) or self.journal_like(s)

    def furniture(self, lines: list[str], caption: bool) -> dict[int, str]:
        """Line numbers of heads and page numbers."""
        out: dict[int, str] = {}
        pages: list[tuple[int, tuple[str, str], int]] = []
        for k, line in enumerate(lines):
            if 0 < len(line.strip()) <= LONGEST_PAGE and (m := PAGE.match(line)):
                kind = (m["a"].strip(), m["b"].strip().split(" ")[0].split("/")[0])
                if any(c.isdigit() for c in m["n"]):
                    pages.append((k, kind, int(m["n"].translate(str.maketrans("OolISB", "001158")))))
                elif roman(m["n"]):
                    pages.append((k, (kind[0], f"{kind[1]}r"), roman(m["n"])))
        by: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for k, kind, n in pages:
            by.setdefault(kind, []).append((k, n))
        for kind, seq in by.items():
            for j, (k, n) in enumerate(seq):
                in_turn = any(abs(n - o) == abs(j - i) or 0 < abs(n - o) <= 3 and (n - o) * (k - at) > 0 for i, (at, o) in enumerate(seq) if i != j)
                axis = k > 0 and AXIS.fullmatch(lines[k - 1] or "")
                if axis or kind[0] == "(" and not caption and not in_turn and not self._head_beside(lines, k):
                    continue
                if kind == ("", "") and not in_turn and not caption and (len(lines[k].strip()) > 3 or len(by) > 1) and not self._head_beside(lines, k):
                    continue
                out[k] = "page_number"
        inline = []
        for k, line in enumerate(lines):
            s = line.strip()
            if k in out or not s:
                continue
            if (s[0].isdigit() or s[-1].isdigit()) and not TABLE.match(line) and (m := INLINE.match(line)) and not HEADING.match(line):
                rest = m.group(2) or m.group(3)
                if self.strong_head(rest) or len(rest.split()) > 2 and not rest.endswith(".") and rest[:1].isupper():
                    inline.append(k)
                    continue
            if self.strong_head(line):
                out[k] = "header"
        for k in inline:
            out[k] = "header"
        if not caption:
            self._weak_heads(lines, out)
        else:
            self._caption_heads(lines, out)
        return out

    def _head_beside(self, lines: list[str], k: int) -> bool:
        return any(0 <= j < len(lines) and lines[j].strip() and self.strong_head(lines[j]) for j in (k - 1, k + 1))

    def _weak_heads(self, lines: list[str], out: dict[int, str]) -> None:
        """Heads that look like sentences: the beginning of a title beside a page number."""
        first = next((k for k, x in enumerate(lines) if x.strip()), None)
        near = [j for k, kind in out.items() if kind == "page_number" for j in (k - 1, k + 1) if 0 <= j < len(lines) and j not in out and lines[j].strip()]
        if first is not None and first not in out:
            near.append(first)
        width = max((len(x) for x in lines), default=0)
        heads = [lines[k].strip() for k, kind in out.items() if kind == "header"]
        cands = list(dict.fromkeys(near))
        for _ in range(2):
            for j in cands:
                if j in out:
                    continue
                s = lines[j].strip()
                if HEADING.match(s) or TABLE.match(s) or len(s) < 8 or PAGE.match(s):
                    continue
                score = 0.0
                score += 3 * any(i != j and self._alike(s, lines[i].strip()) for i in cands) or 3 * any(self._alike(s, h) for h in heads)
                score += 1 if s[0].isupper() or s[0].isdigit() and s[1:2].isalpha() else -3
                score -= 2.5 if s[-1] in ".!?;”\"" or s[-1] in BREAKS else 0
                before = next((lines[i].strip() for i in range(j - 1, -1, -1) if i not in out), "")
                after = next((lines[i].strip() for i in range(j + 1, len(lines)) if i not in out and i != j), "")
                if before and before[-1:] not in ".!?:”\"":
                    score += 1.5  # the sentence before goes on elsewhere
                    score += 1 if after[:1].islower() else 0
                elif not before and after[:1].islower():
                    # A paragraph that begins here, unless the text before the gap goes on after it.
                    text = next((lines[i].strip() for i in range(j - 1, -1, -1) if i not in out and lines[i].strip()), "")
                    score += 1 if text and text[-1] not in ".!?:”\"" and not HEADING.match(text) else -1.5
                elif not before and not after:
                    score += 2
                elif not before or not after:
                    score += 1
                elif after[:1].isupper() or after[:1].isdigit():
                    score += 1
                score -= 0.5 if len(s) > 0.93 * width else 0
                score += 0.5 if j == first else 0
                score -= 1.5 if NEXT_SENTENCE.search(s) else 0
                if score >= 2:
                    out[j] = "header"
                    heads.append(s)

    def _caption_heads(self, lines: list[str], out: dict[int, str]) -> None:
        for k in range(1, len(lines)):
            s = lines[k].strip()
            before = lines[k - 1].strip()
            if k in out or len(s.split()) < 3 or not s[0].isupper() or s[-1] in ".;,:)" or (k - 1) in out:
                continue
            if before and before[-1] not in ".;:,)" and not self._name_start(s):
                out[k] = "header"
            elif k == len(lines) - 1 and before[-1:] == "." and not self._name_start(s):
                out[k] = "header"

    def _name_start(self, s: str) -> bool:
        w = plain(s.split()[0])
        return not self.words.known(w) and not self.words.near(w)

    @staticmethod
    def _alike(a: str, b: str) -> bool:
        if not a or not b or abs(len(a) - len(b)) > 4:
            return False
        return distance(folded(a.lower()), folded(b.lower()), 3) <= 3

    # -- words

    def joins(self, left: str, sign: str, right: str) -> bool:
        """Whether two parts at a line's end are one word that the line broke."""
        if not left or not right or not right[0].isalpha():
            return False
        a, b = plain(left), plain(right)
        if sign != "-" and sign != "‐":
            return True
        if b in SUSPENDED or right[0].isupper():
            return False
        whole, compound = self.words.n.get(a + b, 0), self.words.n.get(f"{a}-{b}", 0)
        if whole or compound:
            return whole >= compound
        tail = a.rsplit("-", 1)[-1] + b
        if "-" in a and self.words.n.get(tail, 0):
            return True
        return not (a in self.words and b in self.words and len(a) > 2 and len(b) > 2 and not self.words.near(a + b))

    def _word_at_fault(self, raw: str) -> tuple[str, str | None] | None:
        """None if the token is sound; else (word to look up in the corpus, the frequent word meant)."""
        if LIGATURES.search(raw):
            return "", None
        w = plain(raw)
        if "­" in w or "¬" in w:
            w = w.replace("­", "").replace("¬", "")
        if len(w) < 2 or self.words.known(w):
            return None
        if NUMBERLIKE.match(w):
            return None
        if MIXED.match(w):
            return self._mixed(raw, w)
        near = self.words.near(w)
        if near:
            return w, near[0]
        if "-" in w:
            for part in w.split("-"):
                if len(part) > 1 and part not in self.words and (n := self.words.near(part)):
                    return part, n[0]
            return None
        return (w, None) if len(w) > 4 else None

    def _mixed(self, raw: str, w: str) -> tuple[str, str | None] | None:
        """Letters and digits in one: a misread word or number, unless it is a name such as v33 or H2O."""
        if NO_WORD.fullmatch(w):
            return None
        digits = sum(c.isdigit() for c in w)
        letters = [c for c in w if c.isalpha()]
        if digits >= len(letters) and all(c in "oilsbzgq" for c in letters):
            return "", None
        if self.words.near(w):
            return "", self.words.near(w)[0]
        return ("", None) if len(letters) > 2 else None

    def meant(self, w: str, options: tuple[str, ...], around: list[str]) -> str | None:
        """Of the words that may be meant, the one that fits its neighbours best; None if that one doesn't fit either."""
        alike = folded(w)
        fits = {o: self.context.fit(o, around) for o in options}
        if all(f is None for f in fits.values()):
            return next((o for o in options if folded(o) == alike), options[0]) if len(w) > 3 or folded(options[0]) == alike else None
        # Look-alike glyphs alone are as likely as a step from the floor to what is usual.
        step = self.context.usual - self.context.floor
        best = max(options, key=lambda o: (self.context.floor if fits[o] is None else fits[o]) + (step if folded(o) == alike else 0.0))
        mark = self.context.floor if len(w) > 3 else self.context.usual
        if fits[best] is None:
            return best if folded(best) == alike or len(w) > 3 else None
        return best if fits[best] >= (self.context.floor if folded(best) == alike else mark) else None

    def findings(self, text: str | None, caption: bool) -> list[tuple[int, str, str | None, str | None]]:
        """(line number, noise, word to look up or None, word meant) of a text; ``misread`` may still be refuted by the corpus."""
        if not text or not text.strip():
            return []
        lines = text.split("\n")
        furniture = self.furniture(lines, caption)
        out: list[tuple[int, str, str | None, str | None]] = [(k, kind, None, None) for k, kind in furniture.items()]
        body = [k for k in range(len(lines)) if k not in furniture and lines[k].strip()]
        carry = None
        for place, k in enumerate(body):
            line = lines[k]
            pieces = line.split()
            broken = None
            s = line.rstrip()
            if s[-1] in BREAKS and len(s) > 1 and place + 1 < len(body) and (m := ENDING.search(s)):
                nxt = BEGINNING.match(lines[body[place + 1]])
                if nxt and self.joins(m.group(1), s[-1], nxt.group(1)):
                    broken = (m.group(1), nxt.group(1))
                    out.append((k, "hyphen", None, None))
            skip: set[int] = set()  # offsets of tokens that belong to a broken word
            for start, end, left, sign, right in broken_inside(line) if "- " in line or "¬ " in line or "­ " in line or "‐ " in line else ():
                if self.joins(left, sign, right):
                    out.append((k, "hyphen", None, None))
                    skip.update(range(start, end))
                    self._parts(out, k, k, left, right)
            if not self.pieces.sound.issuperset(pieces):
                self._misread(out, k, line, pieces, skip, broken, carry == k)
            carry = None
            if broken:
                carry = body[place + 1]
                self._parts(out, k, carry, *broken)
        return out

    def _misread(self, out: list, k: int, line: str, pieces: list[str], skip: set[int], broken: tuple[str, str] | None, first_done: bool) -> None:
        """The faulty words of a line; ``first_done``: its first one is the end of a broken word."""
        frequent = self.words.n
        found: list[str] = []
        low: list[str] = []
        unknown: list[int] = []
        for raws, lows, doubts in map(self.pieces.__getitem__, pieces):
            unknown += [len(low) + t for t in doubts]
            found += raws
            low += lows
        gaps = {j for t in unknown for j in (t - 1, t) if 0 <= j < len(low) - 1 and low[j] + low[j + 1] in frequent}
        toks = placed(found, line) if gaps or skip else []
        gone: set[int] = set()
        for t in unknown:
            if t in gone or skip and toks[t][1] in skip or t == 0 and first_done:
                continue
            if broken and t == len(low) - 1 and low[t].rstrip(BREAKS) == plain(broken[0]):
                continue
            if t in gaps and self._gap(toks[t][0], toks[t + 1][0], line, toks[t][1]):
                out.append((k, "misread", None, None))
                gone.add(t + 1)
                continue
            if t - 1 in gaps and t - 1 not in gone and self._gap(toks[t - 1][0], toks[t][0], line, toks[t - 1][1]):
                out.append((k, "misread", None, None))
                continue
            if fault := self.word_at_fault(found[t].strip("’'")):
                options = self.words.near(fault[0]) if fault[0] else ()
                around = low[max(0, t - WINDOW) : t] + low[t + 1 : t + 1 + WINDOW]
                word = self.meant(fault[0], options, around) if options else fault[1]
                if word is not None or not options:
                    out.append((k, "misread", fault[0] or None, word))

    def _parts(self, out: list, k: int, next_k: int, left: str, right: str) -> None:
        """A broken word may be misread too; the line of the faulty part is the one that differs."""
        fault = self.word_at_fault(left + right)
        if fault:
            head = fault[1][: len(left)] == plain(left) if fault[1] else not MIXED.match(left)
            out.append((next_k if head else k, "misread", fault[0] or None, fault[1]))

    def _gap(self, a: str, b: str, line: str, at: int) -> bool:
        """Two tokens, one of them no word, that make one word without the space between them."""
        if line[at + len(a) : at + len(a) + 1] != " " or line[at + len(a) + 1 : at + len(a) + 1 + len(b)] != b or not (a.isalpha() and b.isalpha()):
            return False
        x, y = plain(a), plain(b)
        return len(x) + len(y) > 3 and (x not in self.words or y not in self.words or len(x) == 1 and x not in ("a", "i", "y", "o", "à")) and x + y in self.words and b[0].islower()

    def repaired(self, text: str | None, caption: bool, refuted: set[str], roots: dict[str, str] | None = None) -> str | None:
        """Continuous paragraphs without furniture, broken words joined, misread ones as they were meant."""
        if not text or not text.strip():
            return text
        lines = text.split("\n")
        furniture = self.furniture(lines, caption)
        paras: list[list[str]] = [[]]
        for k, line in enumerate(lines):
            if k in furniture:
                continue
            s = line.strip()
            if not s:
                # A page break inside a paragraph is no end of it.
                if paras[-1]:
                    paras.append([])
                continue
            if HEADING.match(s) and paras[-1]:
                paras.append([])
            paras[-1].append(s)
            if HEADING.match(s):
                paras.append([])
        out = []
        for p in filter(None, paras):
            flow = p[0]
            for nxt in p[1:]:
                m = re.search(r"([\p{L}\d’'-]+)[-¬­‐]$", flow)
                n = re.match(r"([\p{L}\d’']+)", nxt)
                if m and n and self.joins(m.group(1), flow[-1], n.group(1)):
                    flow = flow[:-1] + nxt
                elif m and flow[-1] in "-‐":
                    flow += nxt if not (n and plain(n.group(1)) in SUSPENDED) else f" {nxt}"
                else:
                    flow += f" {nxt}"
            flow = re.sub(r"([\p{L}’'-]+)([-¬­‐]) (\p{Ll}[\p{L}’']*)", lambda m: m.group(1) + m.group(3) if self.joins(*m.groups()) else m.group(), flow)
            if out and out[-1][-1:].islower() and flow[:1].islower():
                out[-1] += f" {flow}"
            else:
                out.append(flow)
        return "\n\n".join(self._corrected(x, refuted, roots or {}) for x in out)

    def _corrected(self, text: str, refuted: set[str], roots: dict[str, str]) -> str:
        toks = tokens(text)
        parts, at = [], 0
        skip = False
        for t, (raw, start) in enumerate(toks):
            if skip:
                skip = False
                continue
            if t + 1 < len(toks) and self._gap(raw, toks[t + 1][0], text, start):
                parts += [text[at:start], raw + toks[t + 1][0]]
                at, skip = toks[t + 1][1] + len(toks[t + 1][0]), True
                continue
            fault = self.word_at_fault(raw)
            if fault and fault[0] not in refuted:
                good = None
                if LIGATURES.search(raw):
                    import unicodedata

                    good = unicodedata.normalize("NFKC", raw)
                elif fault[1]:
                    around = [plain(x) for x, _ in toks[max(0, t - WINDOW) : t] + toks[t + 1 : t + 1 + WINDOW]]
                    good = self.meant(fault[0], self.words.near(fault[0]), around) if fault[0] and self.words.near(fault[0]) else fault[1]
                    if good and fault[0] and fault[0] != plain(raw):
                        good = plain(raw).replace(fault[0], good)
                elif fault[0] in roots:
                    good = plain(raw).replace(fault[0], roots[fault[0]])
                elif MIXED.match(raw) and sum(c.isdigit() for c in raw) * 2 >= len(raw):
                    good = raw.translate(str.maketrans("OolISBZgq", "001158299"))
                if good:
                    parts += [text[at:start], good.upper() if raw.isupper() and len(raw) > 1 else good.capitalize() if raw[0].isupper() else good]
                    at = start + len(raw)
        return "".join([*parts, text[at:]])


# -- 3 to 5 over tables ---------------------------------------------------------------------------------------------------


def corpus(sections: DataFrame, captions: DataFrame) -> DataFrame:
    """``place, item_id, text, clean, scanned`` of both tables: whole texts of all rows."""
    s = sections.select(F.lit("section").alias("place"), F.col("sec_id").cast("long").alias("item_id"), F.col("full_text").alias("text"), (~F.coalesce("scanned", F.lit(False))).alias("clean"), F.coalesce("scanned", F.lit(False)).alias("scanned"))
    c = captions.select(F.lit("caption").alias("place"), F.col("caption_id").cast("long").alias("item_id"), F.col("caption_text").alias("text"), F.lit(False).alias("clean"), F.lit(True).alias("scanned"))
    return s.unionByName(c)


class Corpus:
    """Word counts of the whole corpus, and the reader that they make."""

    def __init__(self, texts: DataFrame, journals: DataFrame):
        spark = texts.sparkSession
        blocks = cut(spelled(texts), WIDE)
        self.counts = cut(word_counts(blocks))
        total = self.counts.agg(F.sum("n")).first()[0] or 0
        least = max(LEAST, -(-total // SHARE))
        frequent = {r["word"]: (r["clean"], r["n"]) for r in self.counts.where(F.col("n") >= least).collect()}
        names = journals.select("name").where("name is not null").limit(SHARE + 1).collect()
        if len(names) > SHARE:
            raise ValueError(f"the list has more than {SHARE} journals")
        words = {w for r in names for w in words_of(r["name"])}
        context = learned(blocks, {w: n for w, (_, n) in frequent.items()})
        self.shared = spark.sparkContext.broadcast((frequent, context, words))


def noise(texts: DataFrame, known: Corpus) -> DataFrame:
    """``place, item_id, line_no, noise``: one row for each line and kind of noise in it."""
    shared = known.shared

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(*shared.value)
        for b in batches:
            rows = dict.fromkeys((p, i, *f) for p, i, t in zip(*(c.to_pylist() for c in b.columns)) for f in r.findings(t, p == "caption"))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["place", "item_id", "line_no", "noise", "word", "meant"])

    found = cut(texts.where("scanned and text is not null and item_id is not null").select("place", "item_id", "text").mapInArrow(run, "place string, item_id long, line_no long, noise string, word string, meant string"))
    keys = ["place", "item_id", "line_no", "noise"]
    sure = found.where("word is null").select(*keys)
    doubt = found.where("word is not null")
    roots = slips(doubt.where("meant is null"), known).select("word", F.lit(True).alias("slip"))
    judged = doubt.join(sound(known).hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left").where("sound is null and (meant is not null or slip)")
    return sure.unionByName(judged.select(*keys)).distinct()


def sound(known: Corpus) -> DataFrame:
    """``word, sound``: the words of the born-digital texts."""
    return known.counts.where("clean > 0").select("word", F.lit(True).alias("sound"))


def slips(doubt: DataFrame, known: Corpus) -> DataFrame:
    """``word, root``: names, mostly; those that the born-digital texts lack are followed to the more frequent word they are a slip of."""
    words = known.counts.where("length(word) > 4")
    rare = doubt.select("word").distinct().join(sound(known).hint("merge"), "word", "left_anti").withColumn("asked", F.lit(True))
    asked = words.select("word", "n").join(rare.hint("merge"), "word", "left").select("word", "n", F.coalesce("asked", F.lit(False)).alias("asked"))
    found = linked(asked).where("word <> root").join(rare.select("word").hint("merge"), "word", "left_semi")
    return found.join(known.counts.select(F.col("word").alias("root"), F.col("n").alias("root_n")).hint("merge"), "root").join(known.counts.select("word", F.col("n").alias("own_n")).hint("merge"), "word").where("root_n >= 3 * own_n").select("word", "root")


class _Asked(set):
    """Holds every word, and keeps those that it was asked for."""

    def __contains__(self, word: object) -> bool:
        self.add(word)
        return True


def repair(texts: DataFrame, known: Corpus) -> DataFrame:
    """``place, item_id, text``: each scanned text as continuous paragraphs, its doubtful words judged as ``noise`` judges them."""
    shared = known.shared

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(*shared.value)
        for b in batches:
            rows = []
            for p, i, t in zip(*(c.to_pylist() for c in b.columns)):
                r.repaired(t, p == "caption", words := _Asked())
                rows += [(p, i, w) for w in sorted(set(words) - {""})]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["place", "item_id", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Reader(*shared.value)
        for b in batches:
            p, i, t, v = (c.to_pylist() for c in b.columns)
            out = []
            for place, text, judged in zip(p, t, v):
                roots = {x["word"]: x["root"] for x in judged or () if x["root"] is not None}
                out.append(r.repaired(text, place == "caption", {x["word"] for x in judged or ()} - set(roots), roots))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["place", "item_id", "text"])

    scans = texts.where("scanned").select("place", "item_id", "text")
    doubt = cut(scans.mapInArrow(ask, "place string, item_id long, word string"))
    verdicts = sound(known).select("word", F.lit(None).cast("string").alias("root")).unionByName(slips(doubt, known))
    # Verdicts are by word, so texts that share an id may share theirs.
    judged = doubt.join(verdicts.hint("merge"), "word").groupBy(F.col("place").alias("_p"), F.col("item_id").alias("_i")).agg(F.collect_set(F.struct("word", "root")).alias("judged"))
    whole = scans.join(judged.hint("merge"), (F.col("place") == F.col("_p")) & F.col("item_id").eqNullSafe(F.col("_i")), "left").select("place", "item_id", "text", "judged")
    return whole.mapInArrow(run, "place string, item_id long, text string")
