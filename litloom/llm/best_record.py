"""Best representative of each duplicate group (problem 4).

Field by field, the group's values are brought to comparable tokens (characters of a DOI, authors of a list) and aligned
one after the other to the alignment so far, and vote per column with the weight of the record they come from. Of DOIs
the existing value closest to the consensus is emitted, of author lists the number of columns voted for. Journal and
year are single tokens: the one of the greatest weight is emitted.

Records of a group never meet as rows: their values are summed up per (group, field, value) with partial aggregation
first. A group of more than ``HOT`` records is split by the hash of its values: each part is aligned by itself, and the
parts' columns and consensuses are then aligned like values of their summed weight; the DOI closest to that consensus is
looked for among all values of the group by an aggregate.

What is particular to the data: preprints don't speak for the published DOI or journal; a publisher's record may be
an early view, whose year the final form exceeds by one; a cut list or DOI gives no vote against what it lacks; an author
who stands in a list twice counts once.

Defined results: every group has its four rows; where no record gives a value, ``doi`` and ``year`` are null,
``journal`` is -1 and ``authors`` 0; records without metadata don't vote; rows of ``groups`` without a record, with null
ids or repeated, change nothing else; equal values vote together and ties go to the smaller value. Extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.llm.author_names import Given, _batched, _groups, usual_given
from litloom.llm.canonical_list import Entries
from litloom.llm.glyphs import distance, folded
from litloom.llm.names import FULL_OF
from litloom.plans.lineage import cut, hinted

FIELDS = ("doi", "journal", "year", "authors")
# How far a record's origin is trusted.
TRUST = {"publisher": 6, "repository": 5, "scan": 3, "preprint": 1}
OTHER_TRUST = 2
#: A journal in the list says more than one that isn't; an early view a year before speaks for a later year.
LISTED, EARLY = 3, 0.8
# Years that stand for none, and the first century of print.
NO_YEAR = frozenset((0, 1, 1900, 9999))
FIRST_YEAR = 1450
#: Records of a group from which on it is split, in parts of that many.
HOT = 5000
DIGIT = str.maketrans("oilszbgq", "01152869")


def clean_doi(doi: str | None) -> str | None:
    """A DOI bare and in lower case, letters that stand for digits corrected where only digits can stand."""
    if not doi:
        return None
    s = re.sub(r"\s+", "", doi).lower()
    m = re.search(r"(?:1|l|i)(?:0|o)\.[0-9oilszbgq]{4,9}/.+", s)
    if not m:
        return None
    s = m.group().rstrip(".;,)]}>\"'")
    head, _, tail = s.partition("/")
    head = head.translate(DIGIT)
    parts = tail.split(".")
    if len(parts) > 1:
        if sum(c.isdigit() for c in parts[-1]) * 2 >= len(parts[-1]):
            parts[-1] = parts[-1].translate(DIGIT)
        # a year before the last point: four places of which the first is 1 or 2
        parts[-2] = re.sub(r"(?:[12lizs])[0-9oilszbgq]{3}$", lambda m: m.group().translate(DIGIT) if any(c.isdigit() for c in m.group()) else m.group(), parts[-2])
    return f"{head}/{'.'.join(parts)}"


def clean_year(year: int | None, seen: int | None = None) -> int | None:
    """A year that can be one of publication: at most one after that in which the record was made."""
    return year if year is not None and FIRST_YEAR <= year <= (seen + 1 if seen else 9999) and year not in NO_YEAR else None


def author_tokens(names: list[str | None] | None, given: Given = Given()) -> str | None:
    got = ["|".join(p) for n in names or () if n and (p := given.read(n))[0]]
    return "\x1e".join(got) or None


def votes(df: DataFrame, journals: Entries, given: list[str]) -> DataFrame:
    """``group_id, parts, field, value, origin, weight``: one row per value that a record of a group gives."""
    shared = df.sparkSession.sparkContext.broadcast(([(i, n) for n, i in journals.by_name.items()], given))
    names = ["group_id", "parts", "field", "value", "origin", "weight"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first_names = Entries(sorted(shared.value[0])), Given(shared.value[1])
        for b in batches:
            rows = []
            for g, parts, origin, doi, journal, year, seen, authors in zip(*(c.to_pylist() for c in b.columns)):
                w = TRUST.get(origin, OTHER_TRUST)
                kind = origin if origin in ("publisher", "preprint") else ""
                if (d := clean_doi(doi)) is not None:
                    rows.append((g, parts, "doi", d, kind, w))
                if (j := known.map(journal)) is not None:
                    rows.append((g, parts, "journal", str(j), kind, w))
                if (y := clean_year(year, seen)) is not None:
                    rows.append((g, parts, "year", str(y), kind, w))
                if (a := author_tokens(authors, first_names)) is not None:
                    rows.append((g, parts, "authors", a, "", w))
                rows.append((g, parts, "", None, "", 0))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return df.mapInArrow(run, "group_id long, parts long, field string, value string, origin string, weight long")


def align(profile: list[Counter], value: str, weight: int) -> list[Counter]:
    """The alignment of characters with one more value; '' in a column is a gap, which a cut end doesn't vote for."""
    most = [max((c for c in col if c), key=lambda c: (col[c], c), default="") for col in profile]
    n, m = len(most), len(value)
    cost = [[j for j in range(m + 1)]]
    for i in range(1, n + 1):
        row = [i]
        for j in range(1, m + 1):
            row.append(min(cost[i - 1][j - 1] + (most[i - 1] != value[j - 1]), cost[i - 1][j] + 1, row[j - 1] + 1))
        cost.append(row)
    # The end of the alignment is free: a value may be cut short.
    i, j = min(range(n + 1), key=lambda i: (cost[i][m] + 0.25 * (n - i), -i)), m
    before = max((sum(col.values()) for col in profile), default=0)
    out = [Counter(col) for col in profile[i:]][::-1]
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (most[i - 1] != value[j - 1]):
            col = Counter(profile[i - 1])
            col[value[j - 1]] += weight
            i, j = i - 1, j - 1
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            col = Counter(profile[i - 1])
            col[""] += weight
            i -= 1
        else:
            # Beyond the end of what was aligned so far, the others may merely be cut short.
            col = Counter({value[j - 1]: weight, "": before if i < n else 0})
            j -= 1
        out.append(col)
    return out[::-1]


def consensus(values: dict[str, int]) -> str:
    """The values aligned one after the other, the heaviest first, and the character that each column votes for."""
    order = sorted(values, key=lambda v: (-values[v], -len(v), v))
    profile: list[Counter] = [Counter({c: values[order[0]]}) for c in order[0]]
    for v in order[1:]:
        profile = align(profile, v, values[v])
    return "".join(max(col, key=lambda c: (col[c], c)) for col in profile)


def closest(values: dict[str, int]) -> str:
    """The existing value closest to the consensus of all."""
    if len(values) == 1:
        return next(iter(values))
    middle = consensus(values)
    return min(values, key=lambda v: (distance(v, middle, len(v) + len(middle)), -values[v], -len(v), v))


def dois(rows: list[tuple[str, str, int]]) -> Counter:
    """The weights of the DOIs that may speak for the published work."""
    published = [r for r in rows if r[1] != "preprint"]
    values: Counter = Counter()
    for v, _, w in published or rows:
        values[v] += w
    return values


def best_doi(rows: list[tuple[str, str, int]]) -> str | None:
    values = dois(rows)
    return closest(values) if values else None


def best_journal(rows: list[tuple[str, str, int]]) -> str:
    values: Counter = Counter()
    for v, origin, w in rows:
        if origin != "preprint":
            values[v] += w if v == "-1" else LISTED * w
    return max(values, key=lambda v: (values[v], -int(v))) if values else "-1"


def best_year(rows: list[tuple[str, str, int]]) -> str | None:
    own, early = Counter(), Counter()
    for v, origin, w in rows:
        own[int(v)] += w
        early[int(v)] += w if origin in ("publisher", "preprint") else 0
    if not own:
        return None
    return str(max(own, key=lambda y: (own[y] + EARLY * early[y - 1], y)))


def same_author(p: list[str], q: list[str]) -> bool:
    if p[0][:1] != q[0][:1]:
        return False
    a, b = p[0][2:], q[0][2:]
    if a != b and folded(a) != folded(b) and distance(a, b, 2) > 2 and distance(folded(a), folded(b), 2) > 2:
        return False
    if p[0][0] == "c":
        return not p[2] or not q[2] or p[2] == q[2] or Counter(p[2]) & Counter(q[2]) in (Counter(p[2]), Counter(q[2]))
    if p[1] and q[1]:
        g, h = (set(FULL_OF.get(x, ())) | {x} for x in (p[1], q[1]))
        return bool(g & h) or distance(p[1], q[1], 2) <= (2 if min(len(p[1]), len(q[1])) > 5 else 1) or folded(p[1]) == folded(q[1]) or any(x.startswith(q[1]) for x in g) or any(x.startswith(p[1]) for x in h)
    if p[1] or q[1]:
        full, short = (p, q) if p[1] else (q, p)
        if not short[2]:
            return True
        return short[2][0] in {x[0] for x in (full[1], *FULL_OF.get(full[1], ()))}
    return not p[2] or not q[2] or p[2][0] == q[2][0]


class Author:
    """A column of the aligned author lists: the spellings of one author."""

    def __init__(self, *spellings: list[str]):
        self.spellings = list(spellings)


def align_authors(columns: list[Author], known: dict[str, Author], names: list[str]) -> list[Author]:
    """The columns of the names of one more list, which are added to the alignment.

    Names are anchored at the column of their author, wherever it stands; the others take the free columns between the
    anchors around them, one after the other, as misreadings do; what then is left makes columns of its own.
    """
    anchors: list[Author | None] = []
    for t in names:
        if t not in known:
            p = t.split("|")
            if (c := next((c for c in columns if any(same_author(p, q) for q in c.spellings)), None)) is not None:
                known[t] = c
                c.spellings.append(p)
        anchors.append(known.get(t))
    place = {id(c): k for k, c in enumerate(columns)}
    used = {id(c) for c in anchors if c is not None}
    out: list[Author] = []
    last: Author | None = None
    for i, t in enumerate(names):
        c = anchors[i]
        if c is None and (p := t.split("|")) and (c := next((o for o in out if any(same_author(p, q) for q in o.spellings)), None)) is None:
            begin = place[id(last)] + 1 if last is not None else 0
            end = next((place[id(n)] for n in anchors[i + 1 :] if n is not None), len(columns))
            c = next((o for o in columns[begin:end] if id(o) not in used), None)
            if c is None:
                c = Author(p)
                columns.insert(begin, c)
                place = {id(o): k for k, o in enumerate(columns)}
                known[t] = c
            used.add(id(c))
        last = c
        if c not in out:
            out.append(c)
    return out


def author_votes(lists: list[tuple[list[str], list[int], list[int]]]) -> tuple[list[Author], list[int]]:
    """The columns of aligned lists of authors and their votes. Each list comes with its votes for each name, and its votes against a column that it lacks before that name: it may be cut short behind its last one."""
    columns: list[Author] = []
    known: dict[str, Author] = {}
    aligned = [(names, pro, con, align_authors(columns, known, names)) for names, pro, con in lists]
    place = {id(c): k for k, c in enumerate(columns)}
    vote = [0] * len(columns)
    for names, pro, con, mine in aligned:
        held: dict[int, tuple[int, int]] = {}
        for n, p, c in zip(names, pro, con):
            at = place[id(known.get(n) or next((o for o in mine if any(same_author(n.split("|"), q) for q in o.spellings)), mine[-1]))]
            held[at] = max(held.get(at, (0, 0)), (p, c))
        against, upto = 0, -1
        for at in sorted(held):
            for k in range(upto + 1, at):
                vote[k] -= held[at][1]
            vote[at] += held[at][0]
            upto = at
    return columns, vote


def weighted_lists(rows: list[tuple[str, str, int]]) -> list[tuple[list[str], list[int], list[int]]]:
    """Lists as ``author_votes`` takes them, the heaviest first; a part's columns carry their own votes."""
    out = []
    for v, votes_of, w in rows:
        names = v.split("\x1e")
        pro, con = ([int(x) for x in half.split(",")] for half in votes_of.split("/")) if votes_of else ([w] * len(names), [w] * len(names))
        out.append((names, list(pro), list(con), w))
    return [x[:3] for x in sorted(out, key=lambda x: (-x[3], -len(x[0]), x[0]))]


def count_authors(rows: list[tuple[str, str, int]]) -> str:
    """The columns of the aligned author lists that are voted for."""
    return str(sum(v >= 0 for v in author_votes(weighted_lists(rows))[1]))


def part_of_authors(rows: list[tuple[str, str, int]]) -> tuple[str, str, int]:
    """A part's columns as one list: its authors, the votes for each, the weight of the lists that reach it."""
    lists = weighted_lists(rows)
    columns, vote = author_votes(lists)
    weight = sum(w for *_, w in rows)
    return "\x1e".join("|".join(c.spellings[0]) for c in columns), f"{','.join(map(str, vote))}/{','.join(str(weight) for _ in columns)}", weight


CHOOSE = {"doi": best_doi, "journal": best_journal, "year": best_year, "authors": count_authors}


def _by_field(rows: list[tuple]) -> dict[str, list[tuple[str, str, int]]]:
    by: dict[str, list[tuple[str, str, int]]] = {f: [] for f in FIELDS}
    for *_, f, v, origin, w in rows:
        if f:
            by[f].append((v, origin, w))
    return by


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group, rows in _groups(batches):
        by = _by_field(rows)
        yield pa.RecordBatch.from_arrays([pa.array([group] * 4, pa.int64()), pa.array(FIELDS), pa.array([CHOOSE[f](by[f]) for f in FIELDS], pa.string())], names=["group_id", "field", "best_value"])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of a hot group: their aligned authors and the consensus of their DOIs; other values stay."""
    for key, rows in _groups(batches):
        by = _by_field(rows)
        out = [(f, *r) for f in ("journal", "year") for r in by[f]]
        if by["authors"]:
            out.append(("authors", *part_of_authors(by["authors"])))
        for preprint in (True, False):
            if values := dois([r for r in by["doi"] if (r[1] == "preprint") == preprint]):
                out.append(("doi", consensus(values), "preprint" if preprint else "", sum(values.values())))
        group = int(key.split(" ")[0])
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array([group] * len(out), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64())))], names=["group_id", "field", "value", "origin", "weight"])


SUMMED = "group_id long, field string, value string, origin string, weight long"
CHOSEN = "group_id long, field string, best_value string"


def _chosen(summed: DataFrame) -> DataFrame:
    return summed.repartition("group_id").sortWithinPartitions("group_id", "field", "value", "origin").mapInArrow(lambda it: _batched(_choose(it)), CHOSEN)


def _hot_chosen(summed: DataFrame) -> DataFrame:
    """Groups with too many values for one task, by parts."""
    key = F.concat_ws(" ", "group_id", F.pmod(F.xxhash64("value"), "parts"))
    parts = summed.where("field <> ''").select(key.alias("k"), "field", "value", "origin", "weight").repartition("k").sortWithinPartitions("k", "field", "value", "origin").mapInArrow(lambda it: _batched(_parts(it)), SUMMED)
    chosen = cut(_chosen(summed.select("group_id").distinct().selectExpr("group_id", "'' as field", "cast(null as string) as value", "'' as origin", "0L as weight").unionByName(parts)))
    middle = chosen.where("field = 'doi' and best_value is not null").select("group_id", F.col("best_value").alias("middle"))
    dois = summed.where("field = 'doi'").groupBy("group_id", "value").agg(F.sum(F.when(F.col("origin") != "preprint", F.col("weight"))).alias("pub"), F.sum("weight").alias("w")).join(middle.hint("merge"), "group_id")
    near = F.struct(F.col("pub").isNull().alias("a"), F.levenshtein("value", "middle").alias("b"), (-F.coalesce("pub", "w")).alias("c"), (-F.length("value")).alias("d"), F.col("value").alias("e"))
    best_dois = dois.groupBy("group_id").agg(F.min_by("value", near).alias("doi"))
    return chosen.join(best_dois, "group_id", "left").select("group_id", "field", F.when(F.col("field") == "doi", F.col("doi")).otherwise(F.col("best_value")).alias("best_value"))


def best(groups: DataFrame, records: DataFrame, journals: Entries, hot: int = HOT) -> DataFrame:
    """``group_id, field, best_value``: four rows for each group."""
    m = F.col("metadata")
    g = groups.select(F.col("group_id").cast("long").alias("group_id"), F.col("rec_id").cast("long").alias("_rec")).where("group_id is not null").distinct()
    large = cut(g.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot).select("group_id", F.ceil(F.col("_n") / hot).alias("_parts")))
    split = not large.isEmpty()
    sized = g.join(hinted(large), "group_id", "left").select("group_id", F.coalesce("_parts", F.lit(1)).alias("parts"), "_rec") if split else g.select("group_id", F.lit(1).cast("long").alias("parts"), "_rec")
    seen = F.year("extracted_at") if "extracted_at" in records.columns else F.lit(None).cast("int")
    r = records.select(F.col("rec_id").cast("long").alias("_rec"), "origin", m["doi"].alias("doi"), m["journal"].alias("journal"), m["year"].cast("int").alias("year"), seen.alias("seen"), m["authors"].alias("authors"))
    given = votes(sized.join(r, "_rec", "left").drop("_rec"), journals, usual_given(r, F.col("authors")))
    summed = given.groupBy("group_id", "parts", "field", "value", "origin").agg(F.sum("weight").alias("weight"))
    columns = ("group_id", "field", "value", "origin", "weight")
    if not split:
        return _chosen(summed.select(*columns))
    summed = cut(summed)
    return _chosen(summed.where("parts = 1").select(*columns)).unionByName(_hot_chosen(summed.where("parts > 1")))
