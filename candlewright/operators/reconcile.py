"""Reconciling two tables by digests: equal parts are passed over without a join.

Each side is summed to a count and two order-free digests for every bucket of keys; the sums meet, not the rows. Rows of unequal buckets can then be
looked at one by one. Two different buckets pass for equal only if a sum and an exclusive or of 64-bit hashes agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def digested(rows: DataFrame, key: str, sound: Column, *columns: str, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n, total, mixed, sound: one row a bucket; sound if all its rows are."""
    h = F.xxhash64(key, *columns, *[F.col(c).isNull() for c in columns])
    each = rows.select(bucket(key, buckets).alias("bucket"), h.alias("h"), sound.alias("ok"))
    return each.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("total"), F.bit_xor("h").alias("mixed"), F.coalesce(F.bool_and("ok"), F.lit(False)).alias("sound"))


def unequal_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """bucket: those that differ, are on one side only, or not sound."""
    same = F.lit(True)
    for c in ("n", "total", "mixed"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    met = a.alias("a").join(b.alias("b"), F.col("a.bucket") == F.col("b.bucket"), "full_outer")
    sound = F.coalesce("a.sound", F.lit(False)) & F.coalesce("b.sound", F.lit(False))
    return met.where(~(same & sound)).select(F.coalesce("a.bucket", "b.bucket").alias("bucket"))


def in_buckets(rows: DataFrame, key: str, wanted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows whose key is in one of the buckets (there are ``buckets`` at most, so these are broadcast)."""
    few = F.broadcast(wanted.select(F.col("bucket").alias("__bucket")))
    return rows.withColumn("__of", bucket(key, buckets)).join(few, F.col("__of") == F.col("__bucket"), "left_semi").drop("__of")
