"""What typing and scanning do to letters: glyphs that look alike, and a bounded edit distance."""

from __future__ import annotations

import functools
import re

# Groups of glyphs that scanned pages confuse. The first of a group stands for all.
LOOK_ALIKE = (
    ("m", "rn"),
    ("im", "nn"),
    ("w", "vv"),
    ("u", "ii", "v"),
    ("d", "cl"),
    ("i", "l", "1", "j", "!", "|"),
    ("o", "0"),
    ("s", "5"),
    ("g", "q", "9"),
    ("t", "f"),
    ("e", "c"),
    ("h", "b", "6"),
    ("z", "2"),
    ("a", "4"),
)
PAIRS = {x: g[0] for g in LOOK_ALIKE for x in g[1:] if len(x) > 1}
SINGLE = str.maketrans({x: g[0] for g in LOOK_ALIKE for x in g[1:] if len(x) == 1})
_PAIR = re.compile("|".join(PAIRS))


@functools.lru_cache(1 << 17)
def folded(word: str) -> str:
    """A lower-case word with all look-alike glyphs brought to one."""
    w = _PAIR.sub(lambda m: PAIRS[m.group()], word)
    return w.translate(SINGLE)


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap neighbours) between two strings, or ``most + 1`` if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    n = min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    i = 0
    n = min(len(a), len(b))
    while i < n and a[-1 - i] == b[-1 - i]:
        i += 1
    if i:
        a, b = a[:-i], b[:-i]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new[j] = d
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def close(a: str, b: str, most: int) -> bool:
    """Within ``most`` edits, a confusion of look-alike glyphs counting as none."""
    return distance(a, b, most) <= most or distance(folded(a), folded(b), most) <= most
