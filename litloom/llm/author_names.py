"""Variant spellings of names typed by people (problem 1).

Different strings only are worked on. Each is read into words and initials; a comma, a middle initial or a lone full
word tells the family name. Where nothing does (``Kumar Rajesh``), the token orders are checked against the whole
corpus: how often each word, its slips included, stood in the place of a family name and of a given name elsewhere.
Collective authors are read into their naming word and the initials of the others.

Words are linked by a trie join: they are sharded by half of the word and its length (one slip can't touch both
halves), a shard's words form a trie, and each walks it with a Levenshtein automaton, so that its neighbours within one
edit, look-alike glyphs counting as none, are found without comparing pairs. A word links to its most frequent
neighbour, if that is more frequent by a factor that is greater for short words; links are followed to their ends,
however long the chain. Within a family, given names agree if one is a slip of the other (its neighbour, and many times
rarer in the whole corpus, as one slip often makes another name: ``Ramesh``, ``Rajesh``), if they are short forms of one
name, or one is the cut form of another; bare initials go to the one person they fit, and to nobody if they fit several.

Only the different (given name, initials) of one family meet in one task, never its records; the pairs of an author
with many spellings are made in blocks.

Defined results: null names, null lists and names without letters have no partner; strings that differ only in space
or marks are different strings; repeated rows count once; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import bisect
import functools
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.llm.glyphs import SINGLE, distance, folded
from litloom.llm.names import FULL_OF, ascii_fold
from litloom.plans.lineage import cut

#: Members of an author that one block of pairs takes, on average.
BLOCK = 256
#: How many times more frequent a neighbour must be for a word of at most that many letters to be its slip.
FAMILY_RATIO = ((4, 20), (6, 8), (99, 1))
GIVEN_RATIO = 8
#: The same where only look-alike glyphs differ.
ALIKE_RATIO = 3
#: Given names that hold at least one in so many of all are known to the other operators: never more than that many.
GIVEN_SHARE = 20_000
# What stands around names without being part of them, and the words of collective authors.
TITLES = frozenset("dr prof professor mr mrs ms phd md msc bsc dphil jr sr ii iii mme mlle herr frau sir dipl ing".split())
LEADING = re.compile(r"^(?:on behalf of|for|from|by)\s+(?:the\s+)?|^the\s+", re.I)
BODY = ("group", "network", "consortium", "consort", "laboratory", "lab", "institute", "inst", "collaboration", "collab", "centre", "center", "society", "team", "project", "initiative", "study", "working", "cons", "alliance", "committee", "association", "department", "program", "programme", "research", "council", "foundation", "university", "net", "grp", "soc", "labor", "institut")


@functools.lru_cache(1 << 16)
def is_body(word: str) -> bool:
    return word in BODY or any(len(b) > 5 and (len(word) > 3 and b.startswith(word) or abs(len(b) - len(word)) < 2 and distance(b, word, 1) <= 1) for b in BODY)


def shape(name: str) -> tuple[str, list[str], int, str]:
    """(kind, full words, which of them is the family name, initials) of a name as typed.

    The kind is ``p`` for a person and ``c`` for a collective author, whose one word is its naming word and whose other
    words' first letters stand as initials; it is '' if there is no full word. The family name is -1 if the string
    itself doesn't tell it.
    """
    s = LEADING.sub("", name.strip())
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]|[*†‡§¶]", " ", s)
    comma = s.find(",")
    plain = ascii_fold(s.replace("_", " "))
    words = re.findall(r"[\p{L}\d'’]+(?:-[\p{L}\d'’]+)*", plain)
    low = [w.lower().replace("'", "").replace("’", "") for w in words]
    parts = [x for w in low for x in w.split("-")]
    caps = [w for w in words if len(w) > 1 and w.isupper()]
    letters_end = 0 < len(caps) < len(words) - 1 and len(caps[-1]) < 6 and comma < 0 and caps[-1].lower() not in TITLES
    if letters_end or len(parts) > 2 and any(is_body(x) for x in parts if len(x) > 2):
        content = [x for x in parts if x not in ("the", "and", "of", "for", "und", "et")]
        naming = max(content, key=lambda x: (not is_body(x), len(x)))
        rest = list(content)
        rest.remove(naming)
        short = {x.lower() for w in words for x in w.split("-") if w.isupper() and len(x) < 5} if not s.isupper() else set()
        return "c", [naming], 0, "".join(sorted("".join(x if x in short else x[0] for x in rest)))
    full, initials, before_comma = [], [], set()
    seen_at, between = 0, False
    for w, l in zip(words, low):
        at = plain.find(w, seen_at)
        seen_at = at + len(w)
        if l in TITLES and not (len(words) == 2 and w.isupper() and len(w) == 2):
            continue
        letters = [c for c in w if c.isalpha()]
        typed_as_word = plain.isupper() and len(w) > 2 and bool(re.search("[AEIOUY]", w))
        if len(w) == 1 and letters or w.isupper() and not typed_as_word and (len(w) <= 3 or len(w) <= 5 and len(words) == 2 and not any(len(x) > 5 and x.isupper() for x in words)) or "-" in w and all(len(x) == 1 for x in w.split("-")):
            between = between or len(full) == 1
            initials += [c.lower() for c in letters]
        elif len(letters) > 1:
            if comma >= 0 and at < comma:
                before_comma.add(len(full))
            full.append(l)
    if not full:
        return "", [], -1, "".join(initials)
    if len(full) == 1:
        if len(initials) > 2 and any(len(w) > 2 and w.isupper() for w in words if w.lower() != full[0]):
            return "c", full, 0, "".join(sorted(initials))  # a collective author by its letters
        return "p", full, 0, "".join(initials)
    if before_comma and len(before_comma) < len(full):
        return "p", full, max(before_comma, key=lambda k: len(full[k])), "".join(initials)
    return "p", full, 1 if between and len(full) == 2 and comma < 0 else -1, "".join(initials)


class Given:
    """Words known to be given names, and their slips; ``read`` is ``parse``, remembered, as names repeat."""

    def __init__(self, words: Collection[str] = ()):
        self.words = frozenset(words)
        self.tries = (Trie(), Trie())
        for w in self.words:
            if len(w) > 3:
                for trie, form in zip(self.tries, forms(w)):
                    trie.add(form, (0, w))
        self.root = functools.lru_cache(1 << 16)(self._root)
        self.read = functools.lru_cache(1 << 17)(lambda name: parse(name, self))

    def _root(self, word: str) -> str | None:
        first = word.split("-")[0]
        if first in self.words:
            return first
        found = [best[1] for trie, form in zip(self.tries, forms(first)) if len(first) > 3 and (best := max(trie.near(form), default=None))]
        return max(found, default=None)

    def __contains__(self, word: str) -> bool:
        return self.root(word) is not None


def parse(name: str, given: Given) -> tuple[str, str, str]:
    """(kind and family or naming word, given name, initials), the order decided by the given names known."""
    kind, words, k, initials = shape(name)
    if not kind:
        return "", "", initials
    if k < 0:
        others = [j for j, w in enumerate(words) if w not in given]
        k = others[-1] if others else len(words) - 1
    return f"{kind}:{words[k]}", next((w for j, w in enumerate(words) if j != k), ""), initials


def forms(word: str) -> tuple[str, str]:
    """A word with single look-alike glyphs brought to one, and with pairs of them too; a mark such as ``p:`` stays."""
    mark = word[:2] if word[1:2] == ":" else ""
    return mark + word[len(mark) :].translate(SINGLE), mark + folded(word[len(mark) :])


def _pieces(word: str) -> set[str]:
    """Shards of both forms of a word: of two words within one edit, the longer of n letters, half the other n - 1 are equal."""
    out = set()
    for way, form in zip("<(", forms(word)):
        kind = form[:2] if form[1:2] == ":" else ""
        form = form[len(kind) :]
        for n in (len(form), len(form) + 1):
            k = (n - 1) // 2
            out |= {f"{way}{n}{kind}{form[:k]}", f"{'>' if way == '<' else ')'}{n}{kind}{form[len(form) - (n - 1 - k) :]}"}
    return out


class Trie:
    """Words of a shard; ``near`` walks it with the automaton of one edit."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, value) -> None:
        """Of equal words the greatest value stays."""
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = max(value, node.get("", value))

    def near(self, word: str) -> Iterator:
        """Values of words within one insertion, deletion, replacement or swap of neighbours."""
        n = len(word)
        stack = [(self.root, 0, False)]
        seen = set()
        while stack:
            node, at, used = stack.pop()
            if (key := (id(node), at, used)) in seen:
                continue
            seen.add(key)
            if "" in node and (n - at == 0 or not used and n - at == 1):
                yield node[""]
            if at < n and (nxt := node.get(word[at])) is not None:
                stack.append((nxt, at + 1, used))
            if used:
                continue
            if at < n:
                stack.append((node, at + 1, True))
                if at + 1 < n and (a := node.get(word[at + 1])) is not None and (b := a.get(word[at])) is not None:
                    stack.append((b, at + 2, True))
            for c, child in node.items():
                if c:
                    stack.append((child, at, True))
                    if at < n:
                        stack.append((child, at + 1, True))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """Runs of equal first columns of rows that arrive sorted by it."""
    key, rows = None, []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if r[0] != key:
                if rows:
                    yield key, rows
                key, rows = r[0], []
            rows.append(r)
    if rows:
        yield key, rows


def _join_shards(batches: Iterator[pa.RecordBatch], ratio: tuple[tuple[int, int], ...]) -> Iterator[pa.RecordBatch]:
    """For each word of each shard its most frequent neighbour, if that is more frequent than itself by the ratio."""
    words, to, freq = [], [], []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(to, pa.string()), pa.array(freq, pa.int64())], names=["word", "link", "n"])

    for shard, rows in _groups(batches):
        if len(rows) < 2 or not any(r[3] for r in rows):
            continue
        trie, back, pairs = Trie(), shard[0] in ">)", shard[0] in "()"
        shown = [(forms(w)[pairs][:: -1 if back else 1], n, w, asked) for _, w, n, asked in rows]
        alike: dict[str, tuple[int, str]] = {}
        for form, n, w, _ in shown:
            trie.add(form, (n, w))
            alike[form] = max((n, w), alike.get(form, (n, w)))
        for form, n, w, asked in shown:
            if not asked:
                continue
            times = next(r for most, r in ratio if len(w) - 2 * (w[1:2] == ":") <= most)
            best = max(trie.near(form))
            if not (best > (n, w) and best[0] >= times * n):
                best = alike[form]
            if best > (n, w) and best[0] >= min(times, ALIKE_RATIO) * n:
                words.append(w)
                to.append(best[1])
                freq.append(best[0])
        if len(words) > 20_000:
            yield out()
            words, to, freq = [], [], []
    yield out()


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(p, w, n, a) for w, n, a in zip(*(c.to_pylist() for c in b.columns)) for p in sorted(_pieces(w))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["shard", "word", "n", "asked"])


def followed(links: DataFrame) -> DataFrame:
    """``word, link`` with each link followed to its end: the pointers are doubled until none moves."""
    while True:
        further = links.select(F.col("word").alias("link"), F.col("link").alias("_next"))
        doubled = cut(links.join(further.hint("merge"), "link", "left").select("word", F.coalesce("_next", "link").alias("link"), F.col("_next").isNotNull().alias("moved")))
        links = doubled.select("word", "link")
        if doubled.where("moved").isEmpty():
            return links


def linked(words: DataFrame, ratio: tuple[tuple[int, int], ...] = ((99, 1),)) -> DataFrame:
    """``word, root``: words (with their frequencies ``n``) and the frequent word that each is a slip of, or itself.

    With a boolean column ``asked`` only those words are followed; the others are there to be found. ``ratio`` gives, up
    to a number of letters, how many times more frequent the neighbour must be.
    """
    asked = F.col("asked") if "asked" in words.columns else F.lit(True)
    shards = words.select("word", F.col("n").cast("long").alias("n"), asked.alias("asked")).mapInArrow(_sharded, "shard string, word string, n long, asked boolean")
    found = shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(lambda it: _join_shards(it, ratio), "word string, link string, n long")
    # The links grow with the data, so they are never to be broadcast.
    links = followed(cut(found.groupBy("word").agg(F.max(F.struct("n", "link")).alias("x")).select("word", "x.link")))
    return words.select("word").join(links.hint("merge"), "word", "left").select("word", F.coalesce("link", "word").alias("root"))


def _lessened(form: str) -> set[str]:
    """A form whole and with one letter left out: two within one edit share one of these."""
    return {form, *(form[:k] + form[k + 1 :] for k in range(len(form)))}


def _slips(anywhere: dict[str, int]) -> dict[str, str]:
    """Each given name of a family that is a slip of another of the family, to the most frequent such one."""
    ways: dict[str, list[str]] = defaultdict(list)
    for g in anywhere:
        if len(g) > 2:
            for x in set().union(*map(_lessened, forms(g))):
                ways[x].append(g)
    out = {}
    for g, n in anywhere.items():
        if len(g) < 3 or g in FULL_OF:
            continue
        near = {r for x in set().union(*map(_lessened, forms(g))) for r in ways[x] if anywhere[r] >= ALIKE_RATIO * n and r != g}
        fits = [r for r in near if folded(r) == folded(g) or anywhere[r] >= GIVEN_RATIO * n and min(distance(x, y, 1) for x, y in zip(forms(r), forms(g))) <= 1]
        if fits:
            out[g] = max(fits, key=lambda r: (anywhere[r], r))
    return out


def persons(keys: list[tuple[str, str, int, int]]) -> dict[tuple[str, str], str]:
    """The person of each (given name, initials, frequency, frequency of the given name anywhere) within one family, named by a given name or initials."""
    exact: Counter = Counter()
    anywhere: dict[str, int] = {}
    for g, _, n, everywhere in keys:
        if g:
            exact[g] += n
            anywhere[g] = everywhere
    slip = _slips(anywhere)

    def full(g: str) -> str:
        """The full name meant by a slip or a short form: of several, one that the family has."""
        while g in slip:
            g = slip[g]
        options = FULL_OF.get(g, ())
        return g if not options or g in options else max(options, key=lambda o: (exact[o], -options.index(o)))

    known = sorted({full(g) for g in exact})
    resolved: dict[str, str] = {}
    for g in known:
        # A cut form: the one longer name that begins with it, if that is much more frequent than the cut form is anywhere.
        at = bisect.bisect_right(known, g)
        begun = [x for x in known[at : at + 2] if len(g) > 2 and x.startswith(g)]
        resolved[g] = begun[0] if len(begun) == 1 and anywhere.get(begun[0], 1) >= GIVEN_RATIO * anywhere.get(g, 1) else g
    out: dict[tuple[str, str], str] = {}
    middle: dict[str, set[str]] = defaultdict(set)
    for g, i, *_ in keys:
        if g:
            p = out[g, i] = resolved[full(g)]
            if i:
                middle[p].add(i[-1:])
    by_letter: dict[str, list[str]] = defaultdict(list)
    for p in sorted(set(out.values())):
        by_letter[p[0]].append(p)
    for g, i, *_ in keys:
        if not g:
            fits = by_letter.get(i[:1], []) if i else []
            if len(fits) > 1 and len(i) > 1:
                fits = [p for p in fits if i[1] in middle[p]] or fits
            out[g, i] = fits[0] if len(fits) == 1 else f".{i[:1]}" if len(fits) == 0 else f".{i}?"
    return out


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for root, rows in _groups(batches):
        if root.startswith("c:"):
            got = {(g, i): f"={i}" for _, g, i, *_ in rows}
        else:
            got = persons([(g, i, n, e) for _, g, i, n, e in rows])
        yield pa.RecordBatch.from_arrays([pa.array([root] * len(got)), pa.array([k[0] for k in got]), pa.array([k[1] for k in got]), pa.array([f"{root}|{p}" for p in got.values()])], names=["root", "given", "initials", "author"])


def _batched(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _shaped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [shape(x) for x in b.column(0).to_pylist()]
        words = [[f"{g[0]}:{w}" for w in g[1]] for g in got]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string())), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.string())], names=["name", "n", "words", "family", "initials"])


def shaped(df: DataFrame, names: Column) -> DataFrame:
    """``name, n, words, family, initials``: each different string of the arrays with a full word, and what it tells by itself."""
    strings = df.select(F.explode(names).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return cut(strings.mapInArrow(_shaped, "name string, n long, words array<string>, family int, initials string").where("size(words) > 0"))


def _roles(tokens: DataFrame, word: str) -> DataFrame:
    """``word, f, g``: how many strings have the word in the place of a family name and of a given name; the order of a plain name counts a quarter."""
    sure, last = F.col("family") >= 0, F.col("at") == F.col("size") - 1
    f = F.when(sure, F.when(F.col("at") == F.col("family"), 4).otherwise(0)).when(last, 1).otherwise(0)
    g = F.when(sure, F.when(F.col("at") == F.col("family"), 0).otherwise(4)).when(F.col("at") == 0, 1).otherwise(0)
    return tokens.groupBy(word).agg(F.sum(f).alias("f"), F.sum(g).alias("g"))


def _tokens(shapes: DataFrame) -> DataFrame:
    return shapes.select("name", "n", "family", F.size("words").alias("size"), F.posexplode("words").alias("at", "word"))


def usual_given(df: DataFrame, names: Column) -> list[str]:
    """The words that stand as given names at least ``1 / GIVEN_SHARE`` of all times: never more than that many."""
    roles = cut(_roles(_tokens(shaped(df, names)).where("word like 'p:%'"), "word"))
    total = roles.agg(F.sum("g")).first()[0] or 0
    return [r["word"][2:] for r in roles.where((F.col("g") > 2 * F.col("f")) & (F.col("g") * GIVEN_SHARE >= total)).select("word").collect()]


def authors(df: DataFrame, names: Column) -> DataFrame:
    """``name, author``: each different string of the arrays and the author it denotes."""
    shapes = shaped(df, names)
    tokens = _tokens(shapes)
    roots = linked(tokens.groupBy("word").agg(F.sum("n").alias("n")), FAMILY_RATIO)
    rooted = cut(tokens.join(roots.hint("merge"), "word"))
    roles = _roles(rooted, "root")
    # Of the words of one string, the one that stands most clearly as a family name elsewhere; of equal ones the last.
    score = (F.col("f") + 1) / (F.col("g") + 1)
    chance = F.when(F.col("family") >= 0, (F.col("at") == F.col("family")).cast("double")).otherwise(score)
    read = rooted.join(roles.hint("merge"), "root").groupBy("name").agg(
        F.max_by(F.struct("root", "at"), F.struct(chance.alias("c"), F.col("at").alias("a"))).alias("k"),
        F.collect_list(F.struct("at", "word")).alias("all"),
    )
    given = F.array_min(F.filter("all", lambda x: x["at"] != F.col("k.at")))["word"]
    first = F.element_at(F.split(F.substring(F.coalesce(given, F.lit("")), 3, 1000), "-"), 1)
    split = cut(read.select("name", F.col("k.root").alias("root"), first.alias("word")).join(shapes.select("name", "n", "initials").hint("merge"), "name"))
    anywhere = split.groupBy("word").agg(F.sum("n").alias("anywhere"))
    told = split.join(anywhere.hint("merge"), "word").select("name", "n", "root", F.col("word").alias("given"), "initials", "anywhere")
    keys = told.groupBy("root", "given", "initials").agg(F.sum("n").alias("n"), F.max("anywhere").alias("anywhere"))
    people = keys.repartition("root").sortWithinPartitions("root").mapInArrow(lambda it: _batched(_resolve(it)), "root string, given string, initials string, author string")
    return told.join(people.hint("merge"), ["root", "given", "initials"]).select("name", "author")


def pairs(members: DataFrame) -> DataFrame:
    """``name_a, name_b`` for any two names of one author: its names fall into blocks of about ``BLOCK``, and each block meets all of them."""
    kept = cut(members)
    size = kept.groupBy("author").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / BLOCK)
    sized = kept.join(size.hint("merge"), "author").withColumn("_of", blocks)
    left = sized.select("author", F.pmod(F.xxhash64("name"), "_of").alias("_b"), F.col("name").alias("name_a"))
    right = sized.select("author", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_of") - 1)).alias("_b"), F.col("name").alias("name_b"))
    return left.join(right.hint("merge"), ["author", "_b"]).where("name_a < name_b").select("name_a", "name_b")
