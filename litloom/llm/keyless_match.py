"""Matching entities across sources without keys (problem 3).

A deterministic cascade of exact joins on weaker and weaker attribute combinations. Titles are reduced to their
content words, each slip brought back to the frequent word it comes from, so that case, punctuation, markup, swapped
and dropped small words no longer matter.

    1  all content words of the title, and an author in common
    2  all content words of a long title, authors missing on a side or misspelt, years at most one apart
    3  a title that is a cut form of the other (the same first four words in any order), or that differs in one word that is a slip
       (equal in the others: one key for each word left out; long titles, by halves); an author in common
    4  no usable title: the same two or more family names and the same year

Each rule only takes pairs of which at least one side is still unresolved: a pair whose hit and record both have a
match by a stronger rule isn't looked at again. Each rule's confidence is its precision on labelled pairs of records,
smoothed (``(right + 1) / (all + 2)``).

The frequent words are those that make up at least 1/20000 of all title words, hence at most 20000, whatever the
data; only they are sent to the executors. Joins are on keys of twice 64 bits, or on hashed keys whose words are compared afterwards; titles that hold no value have no key, and one hot
work is split by the adaptive skew join.

Defined results: null or placeholder titles and null authors take no part in the rules that need them; rows with a
null id are left out; repeated rows match like any other; extra columns are ignored; empty tables give no match.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.llm.author_names import TITLES, Trie, forms, is_body, usual_given
from litloom.llm.glyphs import distance, folded
from litloom.llm.names import ascii_fold
from litloom.plans.lineage import cut

SHARE = 20_000
LEAST = 8
OFTEN = 8
LABELLED = 20_000
# Words that titles gain and lose, and what people write for "no title".
SMALL = frozenset("a an the of and in on for to with by at from under into de la le der die das und et y".split())
NO_TITLE = frozenset(("", "unknown", "untitled", "na", "n a", "none", "null", "not found", "no title", "title"))
GREEK = str.maketrans({"α": " alpha ", "β": " beta ", "γ": " gamma ", "δ": " delta ", "Α": " alpha ", "Β": " beta ", "Γ": " gamma ", "Δ": " delta ", "µ": " mu ", "μ": " mu "})
MARKUP = re.compile(r"</?\p{L}+>|\\\p{L}+|&\p{L}+;")
CUT_END = re.compile(r"(?:\.\.\.|…)\W*$")


def title_words(title: str | None) -> tuple[list[str], bool]:
    """Content words in order, and whether the last was cut short."""
    if not title:
        return [], False
    t = MARKUP.sub(" ", title)
    ws = re.findall(r"[\p{L}\d]+", ascii_fold(t.translate(GREEK)).lower())
    if " ".join(ws) in NO_TITLE:
        return [], False
    return [w for w in ws if w not in SMALL], bool(CUT_END.search(title))


class Vocabulary:
    """Frequent words, and the way back to them from a slip."""

    def __init__(self, words: dict[str, int]):
        self.words = dict(words)
        self.tries = (Trie(), Trie())
        for w in SMALL:
            if len(w) > 2:
                self.words[w] = max(words.values(), default=1)
        for w, n in self.words.items():
            for trie, form in zip(self.tries, forms(w)):
                trie.add(form, (n, w))
        # A slip made often enough to look like a word of its own.
        for w, n in words.items():
            if len(w) > 2 and (near := max(best for trie, form in zip(self.tries, forms(w)) if (best := max(trie.near(form)))))[0] > OFTEN * n and near[1] != w:
                self.words.pop(w)
        self.right = functools.lru_cache(1 << 18)(self._right)

    def _right(self, word: str) -> tuple[str, bool]:
        """The word meant, and whether it is a frequent one."""
        if word in self.words:
            return word, True
        if len(word) < 3 or word.isdigit():
            return (word if word not in ("ll", "l", "1", "il") else "ii" if len(word) > 1 else "i"), len(word) < 3
        found = max((best for trie, form in zip(self.tries, forms(word)) if (best := max(trie.near(form), default=None))), default=None)
        return (found[1], True) if found else (word, False)


class Families:
    """Family names of author lists: of each name the longest word that is no given name of those known."""

    def __init__(self, given: list[str]):
        self.given = frozenset(given)
        self.word = functools.lru_cache(1 << 18)(self._word)

    def _word(self, word: str) -> str | None:
        w = ascii_fold(word).lower().replace("'", "").replace("’", "")
        return folded(w) if len(w) > 1 and w.split("-")[0] not in self.given and w not in TITLES and not is_body(w) else None

    def of(self, names: list[str | None] | None) -> list[str]:
        """Look-alike-folded, each once, in order."""
        out = set()
        for n in names or ():
            ws = [f for w in NAME_WORD(n or "") if (f := self.word(w))]
            if ws:
                out.add(max(ws, key=len))
        return sorted(w for w in out if len(w) > 1)


NAME_WORD = re.compile(r"[\p{L}\d'’]+(?:-[\p{L}\d'’]+)*").findall


def year_of(y) -> int | None:
    m = re.search(r"(?<!\d)(?:1[89]|20)\d\d(?!\d)", str(y)) if y is not None else None
    return int(m.group()) if m else None


def vocabulary(titles: DataFrame) -> dict[str, int]:
    """Words that hold at least one in ``SHARE`` of all words of the ``title`` column: never more than ``SHARE``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for t in b.column(0).to_pylist():
                c.update(title_words(t)[0])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    counted = cut(titles.select("title").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = counted.agg(F.sum("n")).first()[0] or 0
    return {r["word"]: r["n"] for r in counted.where(F.col("n") >= max(LEAST, -(-total // SHARE))).collect()}


SIDE = "id long, words array<string>, rare array<string>, n int, shortened boolean, families array<string>, year int"


def side(df: DataFrame, row_id: Column, title: Column, authors: Column, year: Column, words: dict[str, int], given: list[str]) -> DataFrame:
    """What the rules compare, with the keys of the whole title (``k_all``, ``k_too``) and of people and year (``k_people``, ``k_persons``)."""
    shared = df.sparkSession.sparkContext.broadcast((words, given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, known = Vocabulary(shared.value[0]), Families(shared.value[1])
        for b in batches:
            rows = []
            for i, t, a, y in zip(*(c.to_pylist() for c in b.columns)):
                ws, short = title_words(t)
                got = [x for w in ws if (x := v.right(w))[0] not in SMALL]
                rows.append((i, [w for w, _ in got], [w for w, ok in got if not ok], len(got), short, known.of(a), year_of(y)))
            types = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x) for k, x in enumerate(types)], names=["id", "words", "rare", "n", "shortened", "families", "year"])

    read = df.select(row_id.cast("long").alias("id"), title.alias("title"), authors.alias("authors"), year.cast("string").alias("year")).where("id is not null").mapInArrow(run, SIDE)
    whole = F.array_join(F.array_sort("words"), " ")
    people = lambda seed: F.when((F.size("families") > 1) & F.col("year").isNotNull(), F.xxhash64(F.lit(seed), F.array_join("families", " "), "year"))
    return read.select("*", F.when(F.col("n") > 1, F.xxhash64(whole)).alias("k_all"), F.when(F.col("n") > 1, F.xxhash64(F.lit("too"), whole)).alias("k_too"), people(1).alias("k_people"), people(2).alias("k_persons"))


SHARED = "arrays_overlap(a.families, b.families)"
NEAR_YEAR = "(a.year is null or b.year is null or abs(a.year - b.year) <= 1)"
KIN = "(size(a.families) = 0 or size(b.families) = 0 or exists(a.families, x -> exists(b.families, y -> levenshtein(x, y, 3) between 0 and 3)))"


def _whole_titles(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the same whole title, and whether rule 1 or 2 takes them."""
    rule = F.expr(f"case when {SHARED} then 1 when least(a.n, b.n) >= 4 and {NEAR_YEAR} and {KIN} then 2 end")
    part = lambda s, as_: s.where("k_all is not null").select("k_all", "k_too", F.struct("id", "n", "families", "year").alias(as_))
    return part(a, "a").join(part(b, "b"), ["k_all", "k_too"]).select("a.id", F.col("b.id").alias("id_b"), rule.alias("rule")).where("rule is not null")


def _still_open(found: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs of which at least one side has no match in ``done``."""
    seen = lambda c, flag: done.select(F.col(c), F.lit(True).alias(flag)).distinct().hint("merge")
    flagged = found.join(seen("id", "_a"), "id", "left").join(seen("id_b", "_b"), "id_b", "left")
    return flagged.where("_a is null or _b is null").drop("_a", "_b")


#: Titles of more words than this are keyed by their halves, the others by all words but one.
HALVES_FROM = 8
_ALL = "aggregate({}, 0L, (s, x) -> s ^ x)"
#: Two titles that differ in one word, the longer of m words, share a key: the other m - 1 words, or half of them in place.
#: A set of words is the exclusive or of their hashes, so their order doesn't matter and leaving one out is one operation.
KEYS = f"""concat(
  case when n > 3 then array({_ALL.format('slice(h, 1, 4)')} ^ 1) else array() end,
  case when n between 3 and {HALVES_FROM} then array(total) else array() end,
  case when n between 4 and {HALVES_FROM + 1} then transform(h, x -> total ^ x) else array() end,
  case when n > {HALVES_FROM} then flatten(transform(sequence(n, n + 1), m -> array({_ALL.format('slice(h, 1, (m - 1) div 2)')} ^ xxhash64('p', m), {_ALL.format('slice(h, 1 + n - (m div 2), m div 2)')} ^ xxhash64('s', m)))) else array() end,
  case when n = 3 then array(total ^ {{whole}}) when n > 3 then array({_ALL.format('slice(h, 1, 3)')} ^ {{begun}}) else array() end)"""


def _keyed(s: DataFrame, name: str, whole: int, begun: int) -> DataFrame:
    """``k`` and the id under a name, a row per key. A title of three words meets those that begin with it: one side's ``whole`` is the other's ``begun``."""
    h = s.where("n > 2").select("id", "n", F.expr("transform(words, w -> xxhash64(w))").alias("h"))
    return h.withColumn("total", F.expr(_ALL.format("h"))).select(F.explode(F.array_distinct(F.expr(KEYS.format(whole=whole, begun=begun)))).alias("k"), F.col("id").alias(name))


def _rule_3(a: DataFrame, b: DataFrame, done: DataFrame) -> DataFrame:
    # Candidates are found on keys alone; what is compared joins those that are still open.
    met = _keyed(a, "id", 2, 3).join(_keyed(b, "id_b", 3, 2), "k").select("id", "id_b").distinct()
    both = cut(_still_open(met.join(done.hint("merge"), ["id", "id_b"], "left_anti"), done))
    shown = F.struct("words", "rare", "n", "shortened", "families", "year")
    # The candidates grow with the data, so they are merged, never broadcast.
    both = both.hint("merge").join(a.select("id", shown.alias("a")), "id")
    both = both.hint("merge").join(b.select(F.col("id").alias("id_b"), shown.alias("b")), "id_b")
    d = both.select("id", "id_b", "a", "b", F.expr("array_except(a.words, b.words)").alias("x"), F.expr("array_except(b.words, a.words)").alias("y"))
    part = lambda p, q, side: f"(size({p}) = 0 and size({q}) > 0 and {side[0]}.n < {side[1]}.n and size({q}) <= 4 and size(array_except({side[0]}.words, slice({side[1]}.words, 1, {side[0]}.n + 1))) = 0 or {side[0]}.shortened and size({p}) = 1 and {side[0]}.n <= {side[1]}.n and exists({q}, w -> startswith(w, substring(get({p}, 0), 1, greatest(1, length(get({p}, 0)) - 1)))))"
    slip = "size(x) <= 1 and size(y) <= 1 and abs(a.n - b.n) <= 1 and (size(array_intersect(x, a.rare)) = 1 or size(array_intersect(y, b.rare)) = 1) and (size(x) = 0 or size(y) = 0 or levenshtein(get(x, 0), get(y, 0), 3) between 0 and 3)"
    ok = f"({part('x', 'y', 'ab')} or {part('y', 'x', 'ba')} or {slip}) and ({SHARED} or least(a.n, b.n) >= 5 and (size(a.families) = 0 or size(b.families) = 0)) and {NEAR_YEAR}"
    # ``part`` and ``ii`` tell one instalment from another: a cut title that lost them could be either.
    return d.where(ok).select("id", "id_b", F.lit(3).alias("rule")).distinct()


def _rule_4(a: DataFrame, b: DataFrame, done: DataFrame) -> DataFrame:
    part = lambda s, name, where: s.where(f"k_people is not null and {where}").select("k_people", "k_persons", F.col("id").alias(name))
    met = [part(a, "id", p).join(part(b, "id_b", q), ["k_people", "k_persons"]).select("id", "id_b") for p, q in (("n = 0", "true"), ("n > 0", "n = 0"))]
    return _still_open(met[0].unionByName(met[1]), done).select("id", "id_b", F.lit(4).alias("rule")).distinct()


def cascade(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, id_b, rule``: pairs of the two sides, each with the first rule that gives it."""
    whole = cut(_whole_titles(a, b))
    first = whole.where("rule = 1").distinct()
    done = cut(first.unionByName(_still_open(whole.where("rule = 2"), first).select("id", "id_b", "rule").distinct()))
    for rule in (_rule_3, _rule_4):
        done = cut(done.unionByName(rule(a, b, done)))
    return done.groupBy("id", "id_b").agg(F.min("rule").alias("rule"))


def sides(papers: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    m = F.col("metadata")
    words = vocabulary(papers.select("title").unionByName(records.select(m["title"].alias("title"))))
    given = usual_given(papers.select("authors").unionByName(records.select(m["authors"].alias("authors"))), F.col("authors"))
    hits = side(papers, F.col("hit_id"), F.col("title"), F.col("authors"), F.col("year"), words, given)
    recs = side(records, F.col("rec_id"), m["title"], m["authors"], m["year"], words, given)
    return cut(hits), cut(recs)


def confidences(records: DataFrame, groups: DataFrame) -> DataFrame:
    """``rule, confidence``: the smoothed precision of each rule on labelled records against all records.

    The labelled ones are the ``LABELLED`` records of groups with the smallest hash of their id.
    """
    g = groups.select(F.col("rec_id").cast("long").alias("id"), "group_id").distinct()
    sample = g.orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    some = records.join(sample, "id").drop("group_id")
    pairs = cascade(some, records).where("id <> id_b").join(g, "id").join(g.select(F.col("id").alias("id_b"), F.col("group_id").alias("_g")), "id_b", "left")
    right = F.sum(F.when(F.col("group_id") == F.col("_g"), 1).otherwise(0))
    rules = records.sparkSession.range(1, 5).select(F.col("id").cast("int").alias("rule"))
    seen = pairs.groupBy("rule").agg(right.alias("right"), F.count(F.lit(1)).alias("all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rules.join(seen, "rule", "left").select("rule", F.round((zero("right") + 1) / (zero("all") + 2), 6).alias("confidence"))
