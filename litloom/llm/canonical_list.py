"""Mapping free-entered values to a canonical list (problem 2).

An Aho-Corasick automaton over the normalised names and aliases finds mentions inside a value; the longest
non-overlapping ones win, and a value is mapped if nothing but numbering and filler is left around one entry. What remains goes
to token-set similarity: each token is brought to the words of the list that it may stand for (itself, an
abbreviation, or the word within a bounded number of slips), and the entry whose words are all accounted for at the
least cost is taken; a tie between entries maps to none.

The list is a dimension: it is collected after its size is checked against ``MOST_ENTRIES``. Values are mapped where they lie, without a shuffle, and remembered per worker.

Defined results: null, empty, blank values and placeholders that mean "none" give no row; a value that is not in the
list gives -1; null names and aliases are ignored; of equal names the smallest id counts; repeated rows each give a row.
Extra columns are ignored. With an empty list every value gives -1; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.llm.glyphs import distance, folded
from litloom.llm.names import ascii_fold

MOST_ENTRIES = 200_000
MEMO = 300_000
# What people write for "no value", filler words, and shortened words that no prefix gives.
NONE = frozenset(("", "na", "n a", "none", "null", "nil", "nan", "unknown", "not found", "not available", "not given", "not known", "tbd", "tba", "missing", "no journal", "undefined", "unbekannt", "inconnu", "desconocido", "ohne angabe", "keine angabe", "k a", "s n", "sin datos", "未知", "无", "不明", "なし", "不详"))
FILLER = frozenset("the of in on and de for für fur du des der die das la le el y et und a an & der".split())
NUMBERING = frozenset("vol volume no nr issue pp pages part suppl supplement band jg heft bd tome num número numero art article issn year ed edition online print".split())
SHORTENED = {"jnl": "journal", "jrnl": "journal", "jour": "journal", "intl": "international", "intern": "international", "natl": "national", "qtly": "quarterly", "quart": "quarterly", "bull": "bulletin", "procs": "proceedings", "commun": "communications", "comm": "communications", "zeit": "zeitschrift", "zschr": "zeitschrift", "ztschr": "zeitschrift", "lett": "letters", "let": "letters", "rev": "reviews", "engng": "engineering", "mech": "mechanics"}
HAN = re.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
FORMERLY = re.compile(r"(?:formerly|previously|former name:?|formerly known as|early title:?|continues|früher|anciennement|antes|原名|旧称)[:：]?\s+(.+?)(?:\s*[;.(].*)?$", re.I)


def words_of(value: str) -> list[str]:
    v = ascii_fold(unicodedata.normalize("NFKC", value)).casefold() if not HAN.search(value) else unicodedata.normalize("NFKC", value).casefold()
    if HAN.search(v):
        return ["".join(c for c in v if c.isalpha())] if not re.search(r"[a-z]{2,}", v) else re.findall(r"[\p{L}]+|\d+", re.sub(r"(?<=\p{Han}) (?=\p{Han})", "", v))
    return re.findall(r"[\p{L}\d]+", v.replace("'", "").replace("’", ""))


class Words:
    """A trie of words, walked with the rows of an edit distance (neighbour swaps included)."""

    def __init__(self, pairs: Iterable[tuple[str, str]]):
        """``pairs``: (form, word)."""
        self.root: dict = {}
        for form, word in pairs:
            node = self.root
            for c in form:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(word)

    def walk(self, form: str, most: int) -> tuple[dict[str, int], list[dict]]:
        """Words within ``most`` edits, with their distance, and the nodes whose beginnings are within one edit."""
        n = len(form)
        near: dict[str, int] = {}
        begun = []
        first = list(range(n + 1))
        stack = [(node, c, first, None, "", 1) for c, node in self.root.items() if c]
        while stack:
            node, c, row, before, last, depth = stack.pop()
            new = [depth] + [0] * n
            for j in range(1, n + 1):
                d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (form[j - 1] != c))
                if before is not None and j > 1 and form[j - 1] == last and form[j - 2] == c:
                    d = min(d, before[j - 2] + 1)
                new[j] = d
            if new[n] <= most:
                for w in node.get("", ()):
                    near[w] = min(new[n], near.get(w, 99))
            if new[n] <= 1 and depth > 2:
                begun.append(node)
            if min(new) <= most:
                stack += [(child, x, new, row, c, depth + 1) for x, child in node.items() if x]
        return near, begun


def under(nodes: list[dict]) -> set[str]:
    """The words below nodes of a trie."""
    out: set[str] = set()
    stack = [child for node in nodes for c, child in node.items() if c]
    while stack:
        node = stack.pop()
        out.update(node.get("", ()))
        stack += [child for c, child in node.items() if c]
    return out


def cheapest(costs: list[list[float]]) -> float:
    """The least sum of one cost per row, each from another column (square, by shortest augmenting paths)."""
    n = len(costs)
    u, v, of = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        of[0], j, reach, seen, way = i, 0, [float("inf")] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        while of[j]:
            seen[j] = True
            row, step, nxt = of[j], float("inf"), 0
            for k in range(1, n + 1):
                if not seen[k]:
                    c = costs[row - 1][k - 1] - u[row] - v[k]
                    if c < reach[k]:
                        reach[k], way[k] = c, j
                    if reach[k] < step:
                        step, nxt = reach[k], k
            for k in range(n + 1):
                if seen[k]:
                    u[of[k]] += step
                    v[k] -= step
                else:
                    reach[k] -= step
            j = nxt
        while j:
            of[j] = of[way[j]]
            j = way[j]
    return -v[0]


class Entries:
    def __init__(self, names: list[tuple[int, str]]):
        """``names``: (id, name or alias), canonical names first."""
        import ahocorasick

        self.by_name: dict[str, int] = {}
        self.by_words: dict[tuple[str, ...], set[int]] = defaultdict(set)
        self.vocabulary: set[str] = set()
        self.holders: dict[str, set[int]] = defaultdict(set)
        self.lists: list[tuple[int, tuple[str, ...]]] = []
        self.automaton = ahocorasick.Automaton()
        seen = set()
        for i, name in names:
            ws = words_of(name)
            key = " ".join(ws)
            if not key or self.by_name.setdefault(key, i) != i:
                continue
            content = tuple(w for w in ws if w not in FILLER)
            if (i, content) in seen or not content:
                continue
            seen.add((i, content))
            self.by_words[tuple(sorted(content))].add(i)
            for w in content:
                self.vocabulary.add(w)
                self.holders[w].add(len(self.lists))
            self.lists.append((i, content))
        for key, i in self.by_name.items():
            self.automaton.add_word(f" {key} ", (i, len(key) + 2))
        if self.by_name:
            self.automaton.make_automaton()
        self.sorted = sorted(self.vocabulary)
        self.by_fold: dict[str, list[str]] = defaultdict(list)
        self.skeleton: dict[tuple[str, str], set[str]] = defaultdict(set)
        for w in self.vocabulary:
            self.by_fold[folded(w)].append(w)
            for c in w[2:4]:
                self.skeleton[w[0], c].add(w)
        self.plain_trie = Words((w, w) for w in self.sorted)
        self.fold_trie = Words((folded(w), w) for w in self.sorted)
        self.stands_for = functools.lru_cache(1 << 16)(self._stands_for)
        self.memo: dict[str, int | None] = {}

    def _stands_for(self, t: str) -> tuple[tuple[str, float], ...]:
        """Words of the list that a token may stand for, with their costs."""
        out: dict[str, float] = {}

        def take(w: str, cost: float) -> None:
            if w in self.vocabulary and cost < out.get(w, 9):
                out[w] = cost

        take(t, 0)
        if t in SHORTENED:
            take(SHORTENED[t], 0.1)
        f, n = folded(t), len(t)
        begins = set()
        for k in range(bisect.bisect_left(self.sorted, t), len(self.sorted)):
            if not (w := self.sorted[k]).startswith(t):
                break
            begins.add(w)
            take(w, 0.1 if n < len(w) else 0)
        alike = set(self.by_fold.get(f, ())) - begins
        for w in alike:
            take(w, 0.4)
        done = begins | alike

        def slip(w: str) -> bool:
            # One slip leaves the first letter, or puts it second, or the second first.
            fw = folded(w)
            return w not in done and (f[:1] in (fw[:1], fw[1:2]) or f[1:2] in (fw[:1], fw[1:2]))

        if n >= 3:
            most = 2 if n >= 8 else 1
            walks = [self.plain_trie.walk(t, most), self.fold_trie.walk(f, most)]
            if n >= 4:
                for near, _ in walks:
                    for w, d in near.items():
                        if slip(w):
                            take(w, float(d))
            # a slip inside an abbreviation
            for w in under([node for _, begun in walks for node in begun]):
                if n < len(w) and slip(w):
                    starts = folded(w).startswith(f)
                    if n >= 4 or starts:
                        take(w, 0.5 if starts else 1.2)
        elif n == 2:
            for w in self.skeleton.get((t[0], t[1]), ()):
                if slip(w):
                    take(w, 1.2)
        return tuple(sorted(out.items(), key=lambda x: (x[1], x[0])))

    def mentions(self, words: list[str]) -> int | None:
        """The entry mentioned in the words, if only numbering and filler stand around it."""
        text = f" {' '.join(words)} "
        hits = sorted(((end - size + 1, end + 1, i) for end, (i, size) in self.automaton.iter(text)), key=lambda h: (h[0] - h[1], h[0])) if self.by_name else []
        chosen: list[tuple[int, int, int]] = []
        for h in hits:
            if all(h[1] <= c[0] + 1 or h[0] >= c[1] - 1 for c in chosen):
                chosen.append(h)
        if not chosen or len({c[2] for c in chosen}) > 1:
            return None
        rest = text
        for a, b, _ in sorted(chosen, reverse=True):
            rest = rest[:a] + " " + rest[b:]
        return chosen[0][2] if all(self.noise(w) for w in rest.split()) else None

    @staticmethod
    def noise(w: str) -> bool:
        return w.isdigit() or w in NUMBERING or w in FILLER or sum(c.isdigit() for c in w) * 2 > len(w)

    def similar(self, words: list[str]) -> int | None:
        """The entry whose words are the value's words, each within its slips."""
        tokens = [w for w in words if not self.noise(w)]
        options = [self.stands_for(t) for t in tokens]
        if not tokens or not any(options):
            return None
        # A word that a stray slip made unreadable as filler may be dropped if it is short.
        best: dict[int, float] = {}
        for drop in self.droppable(tokens, options):
            kept = [o for k, o in enumerate(options) if k not in drop]
            if not kept or any(not o for o in kept):
                continue
            lists = None
            for o in kept:
                own = set().union(*(self.holders[w] for w, _ in o))
                lists = own if lists is None else lists & own
                if not lists:
                    break
            for n in lists or ():
                i, content = self.lists[n]
                if len(content) == len(kept) and (cost := self.assign(kept, content)) is not None:
                    cost += 0.3 * len(drop)
                    if cost < best.get(i, 99):
                        best[i] = cost
            if best:
                break
        if not best:
            return None
        ranked = sorted(best.items(), key=lambda x: (x[1], x[0]))
        if len(ranked) > 1 and ranked[1][1] - ranked[0][1] < 0.25:
            return None
        limit = 1.3 + 0.6 * len(tokens)
        return ranked[0][0] if ranked[0][1] <= limit else None

    @staticmethod
    def droppable(tokens: list[str], options: list) -> Iterator[set[int]]:
        yield set()
        loose = [k for k, t in enumerate(tokens) if len(t) <= 4 and any(distance(t, w, 1) <= 1 for w in ("of", "the", "and", "in", "on", "de", "for", "fur", "vol"))]
        for n in range(1, len(loose) + 1):
            yield from map(set, itertools.combinations(loose, n))

    @staticmethod
    def assign(options: list, content: tuple[str, ...]) -> float | None:
        """The least cost at which each token takes one word, order being a light preference."""
        costs = [dict(o) for o in options]
        if all(w in c for c, w in zip(costs, content)):
            return sum(c[w] for c, w in zip(costs, content))
        n = len(content)
        turned = [sum(costs[k][content[(k + by) % n]] for k in range(n)) for by in range(1, n) if all(content[(k + by) % n] in costs[k] for k in range(n))]
        free = cheapest([[c.get(w, 1e6) for w in content] for c in costs])
        best = min([x + 0.1 for x in turned] + [free + 0.6])
        return best if best < 1e5 else None

    def map(self, value: str | None) -> int | None:
        """The entry's id, -1 if the value is not in the list, None if it is no value."""
        if value is None:
            return None
        if value in self.memo:
            return self.memo[value]
        words = words_of(value.replace("_", " "))
        key = " ".join(words)
        if key in NONE:
            got = None
        elif key in self.by_name:
            got = self.by_name[key]
        else:
            got = self.mentions(words)
            if got is None:
                got = self.similar(words)
            if got is None:
                got = -1
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[value] = got
        return got


def entries(listed: DataFrame, row_id: str, name: str, notes: str | None = None, aliases: DataFrame | None = None, alias: str = "abbrev", stands_for: str = "full_name") -> Entries:
    """The list with its aliases: former names told in the notes, and abbreviations of full names."""
    rows = listed.select(F.col(row_id).cast("long"), name, *([notes] if notes else [])).where(F.col(row_id).isNotNull() & F.col(name).isNotNull()).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"the list has more than {MOST_ENTRIES} entries")
    names = sorted((r[0], r[1]) for r in rows)
    former = [(r[0], m.group(1).strip()) for r in rows if notes and r[2] and (m := FORMERLY.search(r[2]))]
    ids: dict[str, int] = {}
    for i, n in names:
        ids.setdefault(" ".join(words_of(n)), i)
    short = []
    if aliases is not None:
        found = aliases.select(alias, stands_for).where(F.col(alias).isNotNull() & F.col(stands_for).isNotNull()).limit(MOST_ENTRIES + 1).collect()
        if len(found) > MOST_ENTRIES:
            raise ValueError(f"there are more than {MOST_ENTRIES} aliases")
        short = [(ids[k], a) for a, full in found if (k := " ".join(words_of(full))) in ids]
    return Entries(names + sorted(former) + sorted(short))


def mapped(df: DataFrame, row_id: str, value: Column, known: Entries) -> DataFrame:
    """``row_id, entry_id`` for each row whose value is one."""
    shared = df.sparkSession.sparkContext.broadcast([(i, n) for n, i in known.by_name.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Entries(sorted(shared.value))
        for b in batches:
            got = [(i, m) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (m := own.map(v)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=[row_id, "entry_id"])

    return df.select(F.col(row_id).cast("long").alias(row_id), value.alias("_v")).where("_v is not null").mapInArrow(run, f"`{row_id}` long, entry_id long")
