"""A library kept up to date from a stream of hits: the batch upsert, batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from litloom.operators.search import upsert
from litloom.plans.lineage import cut


def latest_per_key(stream: DataFrame, key: Sequence[str], event_time: str, late: str) -> DataFrame:
    """The last row of each key by event time; rows later than the watermark are dropped with their state."""
    rest = [c for c in stream.columns if c not in key]
    w = stream.withWatermark(event_time, late)
    return w.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(event_time)).alias("row"))


def tumbling_counts(stream: DataFrame, event_time: str, by: Sequence[str], width: str, late: str) -> DataFrame:
    counted = stream.withWatermark(event_time, late).groupBy(F.window(event_time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")


BUCKET = "_bucket"


def keep_library(stream: DataFrame, folder: str, key: Sequence[str], seq: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Upserts each batch into a library folder parted by the keys' hash: only the parts that the batch touches are read and written anew, and no old versions are kept.

    A batch that is run again replaces its rows by themselves. ``seq`` becomes the batch's number, so later batches win.
    """
    from pyspark.errors import AnalysisException

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
        new = batch.withColumn(BUCKET, part)
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        try:
            old = spark.read.parquet(folder).where(F.col(BUCKET).isin(touched)).select(new.columns)
        except AnalysisException:
            old = new.limit(0)
        kept = upsert(old.withColumn(seq, F.lit(-1).cast("long")), new, [*key, BUCKET], seq).drop("position", "updated")
        # Written aside first: a table can't be overwritten while it is read.
        aside = cut(kept.withColumn(seq, F.lit(batch_id).cast("long")).select(new.columns))
        aside.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(folder)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
