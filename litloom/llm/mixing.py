"""Mixing sources to target weights (problem 9).

Each text gets a hash-random key; the texts are range-sorted by (source, key), so a source that holds a third of all
rows spans as many partitions as it needs. Token counts are summed within each partition, partition totals (one row
per partition and source) are summed before them, and each source is cut where its budget ends: it is used for whole
epochs first, then for the part of one epoch that brings it nearest to its budget.

The total of a mix is the largest for which no source needs more than ``max_repeats`` epochs. A named source without
texts can't bound it: it gets nothing and is reported with share 0, and the others keep their proportions.

Defined results: null, empty and token-less texts and those with a null source are never drawn; exact copies of a
text count as one text, that of the smallest id, whatever source the copies stand in, so that no text exceeds its
cap; a null or non-positive share or cap draws nothing; a mix whose sources are all empty has only report rows. Extra
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.llm.byte_bpe import VOCABULARY, tokenizer, vocabulary
from litloom.plans.lineage import cut, hinted, shuffle_partitions


def sized(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``source, doc_id, tokens``: one row per different text that has tokens."""
    source = vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(source)
        for b in batches:
            n = pa.array([bpe.count(t) for t in b.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n], names=["doc_id", "source", "digest", "tokens"])

    some = docs.where("text is not null and text <> '' and source is not null and doc_id is not null")
    cols = some.select(F.col("doc_id").cast("long"), "source", F.sha2("text", 256).alias("digest"), "text")
    counted = cols.mapInArrow(run, "doc_id long, source string, digest string, tokens long").where("tokens > 0")
    first = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "tokens")).alias("x"))
    return first.select("x.source", "x.doc_id", "x.tokens")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the sum of tokens up to each row within its partition and source."""
    pid = TaskContext.get().partitionId()
    last, carried = None, 0
    for b in batches:
        if not b.num_rows:
            continue
        source, tokens = b.column(0).cast(pa.string()), b.column(2)
        before = pa.concat_arrays([pa.array([last], pa.string()), source.slice(0, b.num_rows - 1)])
        new = pc.fill_null(pc.not_equal(source, before), True)
        base = carried if source[0].as_py() == last else 0
        total = pc.cumulative_sum(tokens)
        starts = pc.indices_nonzero(new)
        run = pc.cumulative_sum(new.cast(pa.int64()))
        offset = pa.concat_arrays([pa.array([-base], pa.int64()), pc.subtract(total.take(starts), tokens.take(starts))]).take(run)
        upto = pc.subtract(total, offset)
        last, carried = source[-1].as_py(), upto[-1].as_py()
        yield pa.RecordBatch.from_arrays([source, b.column(1), tokens, upto, pa.array([pid] * b.num_rows, pa.int32())], names=["source", "doc_id", "tokens", "upto", "pid"])


def ordered(texts: DataFrame, seed: int = 0) -> DataFrame:
    """``source, doc_id, tokens, upto``: texts in hash-random order with the sum of tokens of their source up to them."""
    keyed = texts.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id"))
    by = ["source", "_key", "doc_id"]
    runs = cut(keyed.repartitionByRange(shuffle_partitions(texts), *by).sortWithinPartitions(*by).select("source", "doc_id", "tokens").mapInArrow(_sums, "source string, doc_id long, tokens long, upto long, pid int"))
    part = runs.groupBy("source", "pid").agg(F.max("upto").alias("own"))
    # One row per partition and source, so the window's groups follow the partitions, not the rows.
    before = Window.partitionBy("source").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(part.select("source", "pid", F.sum("own").over(before).alias("base")))
    return runs.join(hinted(base), ["source", "pid"], "left").select("source", "doc_id", "tokens", (F.col("upto") + F.coalesce("base", F.lit(0))).alias("upto"))


def budgets(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with each source's tokens and budget in its mix."""
    have = texts.groupBy("source").agg(F.sum("tokens").alias("have"))
    t = targets.select("mix_id", "source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).join(have, "source", "left")
    usable = F.expr("have > 0 and target_share > 0 and max_repeats > 0")
    room = t.where(usable).groupBy("mix_id").agg(F.min(F.col("have") * F.col("max_repeats") / F.col("target_share")).alias("total"))
    b = t.join(room, "mix_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    budget = F.floor(F.col("total") * F.col("target_share") + F.lit(1e-6))
    return b.withColumn("budget", F.when(usable, F.least(budget, F.col("have") * F.col("max_repeats"))).otherwise(0).cast("long"))


def mix(texts: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """``mix_id, source, doc_id, copies, tokens``: how often each mix takes each text, and the text's size."""
    b = budgets(texts, targets).where("budget > 0")
    cuts = b.select("mix_id", "source", F.floor(F.col("budget") / F.col("have")).alias("_whole"), (F.col("budget") % F.col("have")).alias("_rest"))
    row = ordered(texts, seed).join(hinted(cut(cuts)), "source")
    partly = (2 * F.col("upto") - F.col("tokens") <= 2 * F.col("_rest")).cast("int")
    return row.select("mix_id", "source", "doc_id", (F.col("_whole") + partly).cast("int").alias("copies"), "tokens").where("copies > 0")


def shares(texts: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row per target: its budget and what was reached."""
    got = mixed.groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("copies") * F.col("tokens")).alias("used"), F.max("copies").alias("most_copies"))
    b = budgets(texts, targets).join(got, ["mix_id", "source"], "left")
    whole = got.groupBy("mix_id").agg(F.sum("used").alias("_all"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.round(zero("used") / F.col("_all"), 6)
    return b.join(whole, "mix_id", "left").select("mix_id", "source", "target_share", F.coalesce(share, F.lit(0.0)).alias("actual_share"), "budget", zero("used").cast("long").alias("tokens_used"), zero("texts").cast("long").alias("texts"), zero("most_copies").cast("int").alias("most_copies"), "max_repeats")
