"""Encoding of a corpus with a public byte-level BPE (problem 8).

The vocabulary's byte strings, read as Latin-1, form one Aho-Corasick automaton. A piece of text is encoded by
taking the longest token at each position and stepping back where two neighbouring tokens could not stand side by
side in the result of the merges; whether they can is found from the merge table and memoised. This gives the exact
merges in time linear in the piece. Pieces repeat heavily, so the ids of each piece are memoised per worker.

Defined results: null and empty texts give an empty list, a blank text is encoded as it stands, strings that look
like special tokens are ordinary text, unpaired surrogates are replaced as in UTF-8 with errors="replace". Rows are
kept as they are: equal ids and equal texts each give a row. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The split pattern published with this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces remembered by a worker before it starts afresh; bounds memory, not results.
MEMO = 400_000
#: Longer pieces hardly come again and aren't remembered.
MEMO_LENGTH = 64


def _byte_symbols() -> dict[str, str]:
    """The printable stand-in of each byte in the vocabulary file, mapped back to the byte as Latin-1."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(hidden)}


class ByteBPE:
    def __init__(self, source: bytes):
        import ahocorasick
        import regex

        model = json.loads(source)["model"]
        back = str.maketrans(_byte_symbols())
        self.bytes_of: dict[int, str] = {i: t.translate(back) for t, i in model["vocab"].items()}
        self.id_of = {t: i for i, t in self.bytes_of.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (self.id_of[x.translate(back)] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.id_of[self.bytes_of[a] + self.bytes_of[b]]
            if (a, b) not in self.merge:
                self.merge[a, b] = rank
            if whole not in self.halves:
                self.halves[whole], self.rank[whole] = (a, b), rank
        self.automaton = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.automaton.add_word(t, (i, len(t)))
        self.automaton.make_automaton()
        self.next_shorter = functools.cache(self._next_shorter)
        self.beside: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(PATTERN).findall
        self.memo: dict[str, list[int]] = {}

    def _next_shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        t = self.bytes_of[token]
        return next((i for n in range(len(t) - 1, 0, -1) if (i := self.id_of.get(t[:n])) is not None), None)

    def _can_stand_beside(self, left: int, right: int) -> bool:
        """Whether the merges, run over both tokens' bytes together, would leave exactly these two tokens.

        Undo the later of the two tokens' last merges step by step; a merge across the border that would have come
        before what is still undone proves that they can't.
        """
        never = len(self.merge)
        limit = never
        while True:
            across = self.merge.get((left, right))
            if across is not None and across < limit:
                return False
            l, r = self.rank.get(left, -1), self.rank.get(right, -1)
            if l < 0 and r < 0:
                return True
            # Of two equal merges the left one comes first, so the right one is undone first.
            if l > r:
                limit, left = l, self.halves[left][1]
            else:
                limit, right = r + 1, self.halves[right][0]

    def encode_piece(self, piece: str) -> list[int]:
        s = piece.encode("utf-8", "replace").decode("latin-1")
        n = len(s)
        if (i := self.id_of.get(s)) is not None and i in self.reachable:
            return [i]
        longest: list[tuple[int, int]] = [(0, 0)] * n
        for end, (i, size) in self.automaton.iter(s):
            at = end - size + 1
            if size > longest[at][1]:
                longest[at] = (i, size)
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token, sizes, beside = 0, longest[0][0], self.bytes_of, self.beside
        while at < n:
            end = at + len(sizes[token])
            fits = open_at[end]
            if fits and out:
                pair = (out[-1], token)
                fits = beside.get(pair)
                if fits is None:
                    fits = beside[pair] = self._can_stand_beside(*pair)
            if fits:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at][0]
            elif (shorter := self.next_shorter(token)) is not None:
                token = shorter
            else:
                open_at[at] = 0
                token = out.pop()
                at -= len(sizes[token])
        return out

    @functools.cached_property
    def reachable(self) -> set[int]:
        """Tokens that the merges do give for their own bytes: both halves can stand beside each other until joined."""
        ok = {i for i, t in self.bytes_of.items() if len(t) == 1}
        for whole, (a, b) in self.halves.items():  # in order of rank: halves come first
            if a in ok and b in ok:
                ok.add(whole)
        return ok

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for piece in self.pieces(text) if text else ():
            got = memo.get(piece)
            if got is None:
                if len(memo) >= MEMO:
                    memo.clear()
                    self.beside.clear()
                got = self.encode_piece(piece)
                if len(piece) <= MEMO_LENGTH:
                    memo[piece] = got
            out += got
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


_loaded: dict[int, ByteBPE] = {}


def tokenizer(source: Broadcast) -> ByteBPE:
    """The worker's own tokenizer, built once."""
    value = source.value
    key = hash(value)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteBPE(value)
    return _loaded[key]


def vocabulary(spark: SparkSession, path: str = VOCABULARY) -> Broadcast:
    """The vocabulary file (about 3 MB, fixed), sent to the executors, which need not have it."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, row_id: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``row_id, ids`` for each row. Only the two columns reach Python, in Arrow batches."""
    source = vocabulary(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(source)
        for b in batches:
            ids = [bpe.encode(t) for t in b.column(1).to_pylist()]
            offsets, flat = [0], []
            for x in ids:
                flat += x
                offsets.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[row_id, "ids"])

    return df.select(F.col(row_id).cast("long").alias(row_id), F.col(text).alias("_text")).mapInArrow(run, f"`{row_id}` long, ids array<int>")


def token_count(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of a text; 0 for null and empty ones."""
    import pandas as pd

    source = vocabulary(spark, path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        bpe = tokenizer(source)
        return pd.Series([bpe.count(t) for t in texts], dtype="int64")

    return count(text)
