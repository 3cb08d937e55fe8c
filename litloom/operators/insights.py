"""Text to sections, sentences, classified insights and coverage scores.

Everything is one projection per document: insights, coverage and the batch summary are columns beside each other, and
nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V

SKIP = 100
NOT_FOUND = "Not found"


def heading_pattern(number: str, words: str) -> str:
    optional = f"(?:{number})?" if number else ""
    return rf"(?:^|\n)\s*{optional}(?:{words})"


def section(text: Column, name: str, headings: Mapping[str, tuple[str, str]] = V.HEADINGS, following: str = V.NEXT_HEADING) -> Column:
    """A section's text, from its heading to the next one looked for ``SKIP`` characters on; null without a heading.

    Offsets are counted in characters by splitting at the first match, since the engine's own match positions count
    UTF-16 units.
    """
    low = F.lower(text)
    parts = F.split(low, heading_pattern(*headings[name]), 2)
    start = F.length(F.element_at(parts, 1))
    rest = F.substring(low, start + SKIP + 1, F.length(low))
    tail = F.split(rest, heading_pattern(r"\d+\.?\s+", following), 2)
    end = F.when(F.size(tail) > 1, start + SKIP + F.length(F.element_at(tail, 1))).otherwise(F.length(text))
    return F.when(F.size(parts) > 1, F.substring(text, start + 1, end - start))


def sections(df: DataFrame, key: str, text: str, *keep: str) -> DataFrame:
    """``key`` and one column per section, with the columns to keep."""
    return df.select(key, *keep, F.col(text).alias("full_text"), *(section(F.col(text), n).alias(n) for n in V.HEADINGS))


#: Sections are renamed so before fields are selected beside them: some fields and sections share a name.
APART = "s_"


def _apart(secs: DataFrame) -> DataFrame:
    return secs.withColumnsRenamed({n: APART + n for n in ("full_text", *V.HEADINGS)})


def _together(*cols: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(F.col(APART + c), F.lit("")) for c in cols))


# The section whose presence adds to a field's coverage, and whether the field is a list.
RESEARCH_FIELDS = {
    "research_problem": ("introduction", False),
    "methodology": ("methodology", False),
    "key_results": ("results", True),
    "innovation": ("discussion", True),
    "application": ("conclusion", False),
    "limitations": ("discussion", True),
}
REVIEW_FIELDS = {
    "review_scope": ("introduction", True),
    "review_type": ("full_text", False),
    "taxonomy": ("taxonomy", True),
    "literature_selection": ("selection", True),
    "major_themes": ("discussion", True),
    "consensus_findings": ("results", True),
    "controversies": ("discussion", True),
    "evidence_quality": ("limitations", True),
    "research_gaps": ("future", True),
    "future_directions": ("future", True),
    "key_tables_figures": ("full_text", True),
}
TALK = ("discussion", "limitations", "future", "conclusion")
#: Of each field of a review: the sections it is looked for in, its keywords, the most sentences.
REVIEW_SCOPES = {
    "review_scope": (("abstract", "introduction"), "scope", 3),
    "taxonomy": (("taxonomy", "full_text"), "taxonomy", 5),
    "literature_selection": (("selection", "methodology"), "selection", 5),
    "major_themes": (("abstract", "introduction", "taxonomy", *TALK), "themes", 5),
    "consensus_findings": (("results", *TALK), "consensus", 4),
    "controversies": ((*TALK, "full_text"), "controversies", 4),
    "evidence_quality": (("limitations", "selection", *TALK), "evidence_quality", 4),
    "research_gaps": (TALK, "gaps", 5),
    "future_directions": (("future", "conclusion"), "future", 4),
}


def research_columns(words: Mapping[str, Sequence[str]] = V.RESEARCH) -> dict[str, Column]:
    """The six fields of a research paper over the columns of ``sections`` (set apart), each as an array (empty where nothing is found)."""
    hits = lambda scope, name: T.keyword_sentences(scope, words[name])
    scalar = lambda picked, n: F.array_compact(F.array(T.summary(F.array_join(picked, " "), n)))
    problem = hits(_together("introduction"), "problem")
    last_two = F.slice(problem, F.greatest(F.size(problem) - 1, F.lit(1)), 2)
    ends, turned = _together("discussion", "conclusion"), _together("conclusion", "discussion")
    return {
        "research_problem": scalar(last_two, 2),
        "methodology": scalar(F.slice(hits(_together("methodology"), "methodology"), 1, 3), 3),
        "key_results": F.filter(F.slice(hits(_together("results"), "results"), 1, 5), lambda s: s.rlike(r"\d")),
        "innovation": F.slice(hits(ends, "innovation"), 1, 3),
        "application": scalar(F.slice(hits(turned, "application"), 1, 2), 2),
        "limitations": F.slice(hits(ends, "limitations"), 1, 2),
    }


def review_columns(words: Mapping[str, Sequence[str]] = V.REVIEW) -> dict[str, Column]:
    """The eleven fields of a review over the columns of ``sections`` (set apart), each as an array."""
    found = {f: T.compact_hits(_together(*scope), words[w], n) for f, (scope, w, n) in REVIEW_SCOPES.items()}
    found |= {"review_type": F.array(review_type(F.col(f"{APART}full_text"))), "key_tables_figures": key_captions(F.col(f"{APART}full_text"))}
    return {f: found[f] for f in REVIEW_FIELDS}


def research_insights(secs: DataFrame, key: str, words: Mapping[str, Sequence[str]] = V.RESEARCH) -> DataFrame:
    return _apart(secs).select(key, *(c.alias(f) for f, c in research_columns(words).items()))


def review_insights(secs: DataFrame, key: str, words: Mapping[str, Sequence[str]] = V.REVIEW) -> DataFrame:
    return _apart(secs).select(key, *(c.alias(f) for f, c in review_columns(words).items()))


def insights(secs: DataFrame, key: str, review: Column, *keep: str) -> DataFrame:
    """``key``, kept columns, ``core`` and ``coverage``: of research papers their six fields, of reviews their eleven, with the coverage of each in tenths.

    One projection after another over the same row. The fields of the other kind are null; only one kind is computed.
    """
    has = {n: F.length(F.col(APART + n)) > 0 for n in ("full_text", *V.HEADINGS)}
    kinds = ((RESEARCH_FIELDS, research_columns(), ~F.col("_review")), (REVIEW_FIELDS, review_columns(), F.col("_review")))
    found = [F.when(of, F.struct(*(cols[f].alias(f) for f in fields))).alias(f"_c{k}") for k, (fields, cols, of) in enumerate(kinds)]
    flags = F.struct(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in has.items())).alias("_has")
    both = _apart(secs.withColumn("_review", review)).select(key, *keep, "_review", flags, *found)
    scores = [coverage_tenths(F.col(f"_c{k}")[f], F.col("_has")[n], many).alias(f) for k, (fields, _, _) in enumerate(kinds) for f, (n, many) in fields.items()]
    core = F.struct(*(F.col(f"_c{k}")[f].alias(f) for k, (fields, _, _) in enumerate(kinds) for f in fields))
    kind = F.when(F.col("_review"), F.lit("review")).otherwise(F.lit("research"))
    return both.select(key, *keep, kind.alias("paper_type"), core.alias("core"), F.struct(*scores).alias("coverage"))


def batch_summary(found: DataFrame, key: str, *keep: str) -> DataFrame:
    """One row per document: its type and the coverage of all seventeen fields in tenths, 0 for those of the other type."""
    return found.select(key, *keep, "paper_type", *(F.coalesce(F.col("coverage")[f], F.lit(0)).alias(f) for f in (*RESEARCH_FIELDS, *REVIEW_FIELDS)))


def key_captions(text: Column, terms: Sequence[str] = V.KEY_CAPTION_TERMS, most: int = 6) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(f"({V.KEY_CAPTION})"), 1), T.squeeze)
    return F.slice(F.filter(found, lambda c: T.contains_any(F.lower(c), terms)), 1, most)


def paper_type(text: Column, title: Column | None = None, signs: Sequence[str] = V.REVIEW_SIGNS, research: str = V.RESEARCH_SIGN, chars: int = 8000) -> Column:
    """``review`` if a sign of one stands in the title or the text's first characters, and as many as signs of research."""
    front = F.concat_ws("\n", F.coalesce(title, F.lit("")) if title is not None else F.lit(""), F.substring(text, 1, chars))
    low = F.lower(front)
    hits = sum((low.rlike(T.word(s)).cast("int") for s in signs), F.lit(0))
    return F.when((hits >= 1) & (hits >= F.regexp_count(low, F.lit(research))), F.lit("review")).otherwise(F.lit("research"))


def review_type(text: Column, chars: int = 12000) -> Column:
    return T.ladder(F.lower(F.substring(text, 1, chars)), V.REVIEW_TYPES, V.NO_REVIEW_TYPE)


def coverage_tenths(values: Column, section_found: Column, is_list: bool) -> Column:
    """Coverage of a field in tenths: 5 if found, 2 more for a list or more than 50 characters, 3 more with its section."""
    rich = F.lit(2) if is_list else F.when(F.length(F.element_at(values, 1)) > 50, 2).otherwise(0)
    return F.when(F.coalesce(F.size(values), F.lit(0)) < 1, 0).otherwise(F.least(F.lit(10), F.lit(5) + rich + F.when(section_found, 3).otherwise(0))).cast("int")


def research_coverage(secs: DataFrame, key: str) -> DataFrame:
    """``key`` and the coverage in tenths of each field of a research paper: columns beside the insights, without a join."""
    flags = [F.col(APART + n).isNotNull().alias(f"_has_{n}") for n in dict.fromkeys(n for n, _ in RESEARCH_FIELDS.values())]
    both = _apart(secs).select(key, *flags, *(c.alias(f) for f, c in research_columns().items()))
    return both.select(key, *(coverage_tenths(F.col(f), F.col(f"_has_{n}"), many).alias(f) for f, (n, many) in RESEARCH_FIELDS.items()))


def byline_names(text: Column, lines: int = 50, most: int = 3) -> Column:
    """``Xx Yy`` pairs of the first line, among the first ones, that speaks of authors."""
    first = F.get(F.filter(F.slice(F.split(text, "\n"), 1, lines), lambda s: T.contains_any(F.lower(s), ("author", "by ", "from "))), F.lit(0))
    return F.slice(F.coalesce(F.regexp_extract_all(first, F.lit("([A-Z][a-z]+ [A-Z][a-z]+)"), 1), F.array().cast("array<string>")), 1, most)


def journal_of(text: Column) -> Column:
    head = F.substring(text, 1, 1000)
    named = F.nullif(F.regexp_extract(head, r"(?:Published in|Journal:|In )\s*([A-Z][^,\n]+)", 1), F.lit(""))
    volume = F.nullif(F.regexp_extract(head, r"([A-Z][a-zA-Z\s&]+)\s*(?:Volume|Vol\.|Issue|No\.)", 1), F.lit(""))
    return F.coalesce(T.strip(named), T.strip(volume))


def year_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.substring(text, 1, 1000), r"\b(20\d{2})\b", 1), F.lit("")).cast("int")


def doi_of(text: Column, strict: bool = False) -> Column:
    """The first DOI; not strict: whatever follows the letters ``doi``, as loosely typed sources need."""
    head = F.substring(text, 1, 2000)
    pattern = r"(10\.\d{4,9}/[^\s\"<>]+)" if strict else r"(?:DOI|doi)[\s:]*([^\s\n]+)"
    return F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))


def error_kind(message: Column) -> Column:
    """The kind of an extraction error by its message; what memory or decoding raised is told by the exception's name."""
    return T.ladder(F.lower(message), ERROR_KINDS, "unknown")


# Signs of each kind of error, in order.
ERROR_KINDS = (
    (("memoryerror", "out of memory"), "pdf_too_large"),
    (("unicodedecodeerror", "codec can't decode"), "encoding"),
    (("no text", "text layer"), "no_text"),
    (("password", "encrypt"), "pdf_encrypted"),
    (("corrupt", "invalid", "eof"), "pdf_corrupt"),
)
