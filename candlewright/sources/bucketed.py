"""Datasets laid out by split and bucket of their key, so that two of them meet without a shuffle.

Raw and tokenised rows of one key are in files of one bucket number, sorted by key; a join of the two reads bucket by bucket, and only the split asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(rows: DataFrame, table: str, path: str, key: str, buckets: int, split: str = "split") -> None:
    """Stores rows as a table at ``path``. They are dealt by key first, as the buckets are, so each task writes one file a split."""
    dealt = rows.repartition(buckets, key)
    dealt.write.mode("errorifexists").format("parquet").option("path", path).partitionBy(split).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def attach(spark: SparkSession, table: str, path: str, key: str, buckets: int, split: str = "split") -> DataFrame:
    """The table stored at ``path``, named in a session that doesn't know it yet. key and buckets must be those that it was stored by."""
    schema = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema if f.name != split)
    spark.sql(f"CREATE TABLE {table} ({columns}, `{split}` string) USING parquet PARTITIONED BY (`{split}`) CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.recoverPartitions(table)
    return spark.table(table)


def paired(raw: DataFrame, mapped: DataFrame, key: str, wanted: str, split: str = "split") -> DataFrame:
    """Rows of both tables of one split, met by key within their buckets. Null keys meet nothing; the split's column is left out."""
    side = lambda t: t.where(F.col(split) == wanted).drop(split)
    return side(raw).join(side(mapped).hint("merge"), key)
