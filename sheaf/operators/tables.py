"""Stored tables that are inserted into or replaced by key: kept in folders by a hash of the key, of which an upsert rewrites those it touches.

A table keeps one row for each key. Beside its folders it keeps one of its own, which readers pass over, with the number of buckets, the key
and the dimension of its vectors; these are fixed by the first upsert. Folders that no new key falls into keep their files.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BUCKETS = 64


@dataclass(frozen=True)
class About:
    """What is fixed of a table."""

    key: str
    buckets: int
    dimension: int | None


def about(spark: SparkSession, path: str) -> About | None:
    """What is fixed of the table at path; None where there is no table."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_about")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    row = spark.read.schema("key string, buckets int, dimension int").parquet(f"{path.rstrip('/')}/_about").first()
    return About(row["key"], row["buckets"], row["dimension"])


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the table, with the folder's number in _bucket."""
    return spark.read.parquet(path)


def checked_dimension(new: DataFrame, vector: str, stored: int | None) -> int:
    """The dimension of the new vectors; raises if they differ from one another or from the stored one."""
    low, high = new.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if low != high or stored not in (None, low):
        raise ValueError(f"vectors of {low} to {high} dimensions for a table of {stored if stored is not None else 'one dimension'}")
    return low


def upsert(new: DataFrame, path: str, key: str, order: str | None = None, vector: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Inserts the new rows into the table at path, or replaces those with their keys; gives the numbers of the folders rewritten.

    Of new rows with one key the last by `order` (else by all columns) stays; rows without a key have none. `vector` names a column whose
    vectors must have the table's dimension. No rows are no change, not even a new table.
    """
    spark = new.sparkSession
    last = [F.desc(order)] if order else [F.desc(c) for c in new.columns if c != key]
    known = about(spark, path)
    if known is not None and known.key != key:
        raise ValueError(f"the table is kept by {known.key}, not by {key}")
    n = known.buckets if known else buckets
    coming = new.where(F.col(key).isNotNull()).withColumn("_bucket", bucket(key, n))
    touched = sorted(r["_bucket"] for r in coming.select("_bucket").distinct().collect())  # the table's number of buckets at most
    if not touched:
        return []
    # dealt once, by folder; in a task the new rows of a key come before the stored one
    first = lambda df: df.withColumn("_n", F.row_number().over(W.partitionBy("_bucket", key).orderBy(F.desc("_new"), *last))).where("_n = 1").drop("_n", "_new")
    both = coming.withColumn("_new", F.lit(True))
    dimension = checked_dimension(first(both), vector, known.dimension if known else None) if vector else None
    if known is None:
        spark.createDataFrame([(key, n, dimension)], "key string, buckets int, dimension int").coalesce(1).write.parquet(f"{path.rstrip('/')}/_about")
    else:
        staying = rows(spark, path).where(F.col("_bucket").isin(touched))
        both = staying.select(*coming.columns, F.lit(False).alias("_new")).unionByName(both)
    # folders are replaced when the job commits, after all tasks have read them
    first(both.repartition("_bucket")).sortWithinPartitions("_bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return touched
