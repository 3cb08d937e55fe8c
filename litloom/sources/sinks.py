"""Writers: library, insights, summaries, decks."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def write_library(df: DataFrame, path: str) -> None:
    df.withColumn("last_updated", F.current_timestamp()).write.mode("overwrite").json(path)


def write_sheet(df: DataFrame, columns: Sequence[Column], path: str) -> None:
    """A sheet with a header; see ``operators.reports`` for the columns of results and of batches."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_deck(page: Row, folder: str) -> None:
    """One deck's folder on the machine of the caller: ``index.html``, ``deck.json`` and the assets. Where there are many decks, write ``deck_pages`` as a table."""
    from litloom.operators.render import SCRIPT, STYLE

    base = Path(folder)
    (base / "assets" / "figures").mkdir(parents=True, exist_ok=True)
    for name, text in (("index.html", page["index_html"]), ("deck.json", page["deck_json"]), ("assets/style.css", STYLE), ("assets/deck.js", SCRIPT)):
        (base / name).write_text(text, encoding="utf-8")


def joined_values(c: Column) -> Column:
    return F.array_join(c, " | ")


def write_text(df: DataFrame, text: str, path: str) -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("sep", "\t").csv(path)
