"""Duplicates hidden by formatting differences (problem 6).

Records are brought to a canonical key on the JVM, range-partitioned and sorted by (key, id), and each sorted
partition is scanned once, comparing neighbouring full keys. Because the id is part of the range key, a group that
holds a third of all rows is spread over as many partitions as it needs; a run that crosses a partition edge is
closed with one summary row per edge, never by regrouping the rows themselves.

Null and odd cases: a body that is null, not JSON or without ``metadata`` has no key and is left out of every set;
a null field counts as an empty one; repeated ids keep their rows. Extra columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.plans.lineage import cut, shuffle_partitions

BODY = "metadata struct<title string, authors array<string>, journal string, year string, doi string>"
SEPARATOR = "\x1f"
RUNS = "first_id long, id long, pid int, key string, kind int"
COPY, OPEN_COPY, EDGE = 0, 1, 2


def plain(c: Column) -> Column:
    """Letters and digits only, case folded through upper case (so that ``ß`` and ``SS`` agree)."""
    return F.regexp_replace(F.lower(F.upper(c)), r"[^\p{L}\p{M}\p{N}\p{S}]+", "")


def bare_doi(c: Column) -> Column:
    """A DOI without label or resolver address: what stands from its first ``10.`` on."""
    return F.regexp_replace(F.lower(c), r"^.*?(10\.)", "$1")


def canonical_key(body: Column) -> Column:
    m = F.from_json(body, BODY)["metadata"]
    text = lambda c: F.coalesce(plain(c), F.lit(""))
    authors = F.array_join(F.transform(m["authors"], text), "\x1e")
    key = F.concat_ws(SEPARATOR, text(m["title"]), F.coalesce(authors, F.lit("")), text(m["journal"]), text(m["year"]), text(bare_doi(m["doi"])))
    return F.when(m.isNotNull(), key)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of copies, with the id their run begins with, from batches sorted by (key, id)."""
    pid = TaskContext.get().partitionId()
    schema = pa.schema([("first_id", pa.int64()), ("id", pa.int64()), ("pid", pa.int32()), ("key", pa.string()), ("kind", pa.int32())])

    def out(first: pa.Array, ids: pa.Array, keys: pa.Array, kind: int) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays([first.cast(pa.int64()), ids, pa.array([pid] * n, pa.int32()), keys, pa.array([kind] * n, pa.int32())], schema=schema)

    head = last = first = None
    for b in batches:
        keys, ids = b.column(0).cast(pa.string()), b.column(1)
        if not len(ids):
            continue
        if head is None:
            head, last, first = keys[0].as_py(), keys[0].as_py(), ids[0].as_py()
            yield out(pa.array([first]), pa.array([first]), pa.array([head], pa.string()), EDGE)
        before = pa.concat_arrays([pa.array([last], pa.string()), keys.slice(0, len(keys) - 1)])
        new = pc.not_equal(keys, before)
        starts = pc.indices_nonzero(new)
        run = pc.cumulative_sum(new.cast(pa.int64()))
        firsts = pa.concat_arrays([pa.array([first], pa.int64()), ids.take(starts)]).take(run)
        opened = pc.equal(keys, pa.scalar(head, pa.string()))
        for mask, kind in ((pc.and_(pc.invert(opened), pc.not_equal(firsts, ids)), COPY), (opened, OPEN_COPY)):
            if (got := ids.filter(mask)) is not None and len(got):
                yield out(firsts.filter(mask), got, pa.nulls(len(got), pa.string()), kind)
        last, first = keys[-1].as_py(), firsts[-1].as_py()
    if head is not None and last != head:
        yield out(pa.array([first]), pa.array([first]), pa.array([last], pa.string()), EDGE)


def keyed(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """``key, id`` of the rows that have both, written once: the range partition samples its input, and must not parse it twice."""
    return cut(df.select(key.alias("key"), F.col(row_id).cast("long").alias("id")).where("key is not null and id is not null"))


def copies(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """``first_id, id`` for each row whose key another row with a smaller id has, ids being unique.

    Rows whose key is null belong to no set.
    """
    return _copies(keyed(df, key, row_id))


def _copies(rows: DataFrame) -> DataFrame:
    runs = cut(rows.repartitionByRange(shuffle_partitions(rows), "key", "id").sortWithinPartitions("key", "id").mapInArrow(_scan, RUNS))
    # One or two rows per partition: their number follows the partitions, not the data.
    edges = runs.where(F.col("kind") == EDGE).select("pid", "key", "first_id")
    firsts = edges.groupBy("key").agg(F.min("first_id").alias("true_first"))
    heads = edges.groupBy("pid").agg(F.min("key").alias("key")).join(F.broadcast(firsts), "key").select("pid", "true_first")
    opened = runs.where(F.col("kind") == OPEN_COPY).join(F.broadcast(heads), "pid").select(F.col("true_first").alias("first_id"), "id").where("first_id <> id")
    # A run that reaches the end of a partition but not its start is whole on the left, so its own first id holds.
    return runs.where(F.col("kind") == COPY).select("first_id", "id").unionByName(opened)


def representatives(df: DataFrame, key: Column, row_id: str) -> DataFrame:
    """``first_id, n_copies``: one row for each set, single records included, with its exact size."""
    rows = keyed(df, key, row_id)
    found = cut(_copies(rows))
    more = found.groupBy("first_id").agg(F.count(F.lit(1)).alias("more"))
    firsts = rows.select(F.col("id").alias("first_id")).join(found.select(F.col("id").alias("first_id")).hint("merge"), "first_id", "left_anti")
    return firsts.join(more.hint("merge"), "first_id", "left").select("first_id", (F.coalesce("more", F.lit(0)) + 1).alias("n_copies"))
