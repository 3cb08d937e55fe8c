"""Column helpers for text. All are JVM expressions; lists are arguments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


#: White space of all kinds, also such as the engine's ``\\s`` leaves out.
SPACE = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
#: Letters and digits as ``\\w`` should know them: the engines' word boundaries differ outside of ASCII.
LETTER = "[\\p{L}\\p{M}\\p{N}_]"


def bind(c: Column, of: Callable[[Column], Column]) -> Column:
    """``of(c)`` with ``c`` computed once per row: an expression that is used inside a lambda would be computed for each element anew."""
    return F.get(F.transform(F.array(c), of), F.lit(0))


def clean(c: Column) -> Column:
    """Runs of white space of any kind as one space, none at the ends; '' for null."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def bare(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def word(pattern: str) -> str:
    """A pattern that begins and ends at a word's edge, in classes that all engines read alike."""
    return f"(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])(?:{pattern})(?:[^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)"


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (SQL's ``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sentences(c: Column) -> Column:
    """Pieces between sentence ends; the end marks inside are dropped with the space after them."""
    return F.split(c, r"[.!?]\s+")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether any word stands in ``c`` as a substring."""
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def keyword_sentences(text: Column, words: Sequence[str]) -> Column:
    """Stripped sentences of a text that hold a keyword, whatever its case; each sentence is brought to lower case once."""
    both = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), F.lower(s).alias("l")))
    return F.transform(F.filter(both, lambda x: contains_any(x["l"], words)), lambda x: strip(x["s"]))


def first_distinct(items: Column, key_chars: int = 120) -> Column:
    """Items whose lower-cased beginning has not come before, in order."""
    key = lambda s: F.lower(F.substring(s, 1, key_chars))
    return bind(items, lambda all_: bind(F.transform(all_, key), lambda keys: F.filter(all_, lambda s, i: F.array_position(keys, key(s)) == i + 1)))


def compact_hits(text: Column, words: Sequence[str], limit: int, least: int = 30) -> Column:
    """Keyword sentences with single spaces, of some length, each once, the first ``limit``."""
    hits = F.transform(keyword_sentences(text, words), squeeze)
    return F.slice(first_distinct(F.filter(hits, lambda s: F.length(s) >= least)), 1, limit)


def summary(text: Column, n: int) -> Column:
    """The first ``n`` sentences joined by ``. `` and closed by a stop; null for an empty text."""
    return F.when(F.length(text) > 0, F.concat(F.array_join(F.slice(sentences(text), 1, n), ". "), F.lit(".")))


def shorten(c: Column, most: int) -> Column:
    """Unchanged up to ``most`` characters, else cut one short, without trailing space, plus three dots."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(F.substring(c, 1, most - 1), r"\s+$", ""), F.lit("...")))


def emphasised(c: Column, words: Sequence[str]) -> Column:
    """The first occurrence of the first listed word that occurs, between double stars."""
    out = c
    for w in reversed(words):
        at = F.locate(w, F.lower(c))
        out = F.when(at > 0, F.concat(F.substring(c, 1, at - 1), F.lit("**"), F.substring(c, at, F.lit(len(w))), F.lit("**"), F.substring(c, at + len(w), F.length(c)))).otherwise(out)
    return out


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def inline_markup(c: Column) -> Column:
    """Escaped text whose ``**x**`` and ``==x==`` became highlighted spans."""
    span = '<span class="text-highlight">$1</span>'
    return F.regexp_replace(F.regexp_replace(html_escaped(c), r"\*\*([^\n]+?)\*\*", span), r"==([^\n]+?)==", span)


def normalised_name(c: Column) -> Column:
    """Lower case, anything but ``a-z0-9`` as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))


def redacted_keys(c: Column, parameter: str = "api_key") -> Column:
    return F.regexp_replace(c, rf"({parameter}=)[^&\s]+", "$1[REDACTED]")


def width_hundredths(c: Column, widths: Sequence[int]) -> Column:
    """Width of a title in hundredths: of white space, of wide characters, of others."""
    space = F.length(c) - F.length(F.regexp_replace(c, r"\s", ""))
    wide = F.length(c) - F.length(F.regexp_replace(c, "[ᄀ-ᇿ⺀-꓏가-힯豈-﫿＀-￯]", ""))
    # The ideographic space is white space first.
    both = F.length(c) - F.length(F.regexp_replace(c, "　", ""))
    return ((space + both) * widths[0] + (wide - both) * widths[1] + (F.length(c) - space - wide) * widths[2]).cast("int")


def ladder(c: Column, steps: Sequence[tuple[Sequence[str], str]], otherwise: str) -> Column:
    """The label of the first step of which a word stands in ``c``."""
    out = F.lit(otherwise)
    for words, label in reversed(steps):
        out = F.when(contains_any(c, words), F.lit(label)).otherwise(out)
    return out
