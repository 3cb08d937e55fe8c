"""The tables of a folder, one Parquet file or folder each."""

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows hold texts, which cost far more to read than to move.
TEXTS = frozenset(("documents", "sections", "captions", "extract_results", "papers", "result_files"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give work to less than half of them; as it is otherwise, so large tables are never moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in TEXTS else df
