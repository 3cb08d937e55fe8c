"""Rules that a text must keep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.functions import text as T
from litloom.functions import vocabulary as V

Rules = Mapping[str, tuple[Sequence[str], Sequence[str]]]


def validated(df: DataFrame, text: Column, case: str, rules: Rules = V.RULES) -> DataFrame:
    """The rows with ``missing_required, banned_phrases, passed`` for a case's rules; null texts miss everything."""
    if case not in rules:
        raise ValueError(f"Unknown case: {case}")
    required, banned = rules[case]
    plain = F.lower(T.squeeze(F.coalesce(text, F.lit(""))))
    missing = F.filter(F.array(*map(F.lit, required)), lambda p: ~F.contains(plain, F.lower(p)))
    found = F.filter(F.array(*map(F.lit, banned)), lambda p: F.contains(plain, F.lower(p)))
    return df.withColumns({"missing_required": missing, "banned_phrases": found}).withColumn("passed", (F.size("missing_required") == 0) & (F.size("banned_phrases") == 0))
