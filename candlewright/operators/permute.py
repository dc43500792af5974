"""A keyed bijection of row numbers: the place of each row in a seeded order, found by the row alone.

Numbers below n are laid out as a rectangle of about sqrt(n) by sqrt(n). A round moves a number along one side by a draw fixed by the seed, the round and its other
side, then the other way; each move can be undone, so all of them together are a bijection of the rectangle (a Feistel network with unequal
sides). A number that lands behind n moves on until it is below: the rectangle has less than a side's length more than n places.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.operators.dataset import draw

#: Moves in one pass over a number; passes at most. A pass ends behind n with a chance of 1 in a side's length, so none of 10^12 numbers is likely to need five.
MOVES = 8
PASSES = 33
#: Bases of files that are broadcast; beyond that they are joined by name.
FILES = 200_000


def sides(n: int) -> tuple[int, int]:
    a = isqrt(n - 1) + 1 if n > 0 else 1
    return a, max(1, -(-n // a))


def place(row: Column, n: int, seed: int) -> Column:
    """The place in [0, n) of a row number in [0, n); null for null. A number that isn't in range is an error."""
    a, b = sides(n)

    def move(x: Column, t: Column) -> Column:
        first = t % 2 == 0
        by = draw(F.when(first, F.lit(a)).otherwise(F.lit(b)), F.lit(str(seed)), t.cast("string"), F.when(first, x["r"]).otherwise(x["l"]).cast("string"))
        return F.struct(F.when(first, F.pmod(x["l"] + by, F.lit(a))).otherwise(x["l"]).cast("long").alias("l"), F.when(first, x["r"]).otherwise(F.pmod(x["r"] + by, F.lit(b))).cast("long").alias("r"))

    def moved(x: Column) -> Column:
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(MOVES - 1)), start, move, lambda s: s["l"] * b + s["r"])

    def settled(y: Column) -> Column:
        again = F.aggregate(F.sequence(F.lit(2), F.lit(PASSES)), y, lambda z, _: F.when(z < n, z).otherwise(moved(z)))
        return F.when(y < n, y).otherwise(again)

    row = row.cast("long")
    out = F.transform(F.array(moved(row)), settled)[0]
    known = F.when(out < n, out).otherwise(F.raise_error(F.lit("no place found: take another seed")).cast("long"))
    return F.when(row.between(0, n - 1), known).when(row.isNotNull(), F.raise_error(F.concat(F.lit("no row number: "), row.cast("string"))).cast("long"))


def dealt(rows: DataFrame, row: str, n: int, seed: int, epoch: int, shards: int) -> DataFrame:
    """Adds place, shard and offset of an epoch's order: a shard is a run of ceil(n / shards) places. ``row`` numbers the rows from 0 to n - 1."""
    size = max(1, -(-n // shards))
    at = rows.withColumn("place", place(F.col(row), n, seed * 1_000_003 + epoch))
    return at.withColumns({"shard": F.floor(F.col("place") / size).cast("long"), "offset": F.pmod("place", F.lit(size)).cast("long")})


def numbered_by(rows: DataFrame, part: str, index: Column) -> tuple[DataFrame, int]:
    """rows with __row, and their count. index: a row's number in its part, without gaps; parts in order of name. Only a count a part is put in order."""
    counts = rows.groupBy(part).agg(F.count("*").alias("__n"))
    base = counts.select(F.col(part).alias("__part"), F.coalesce(F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    held = counts.agg(F.count("*").alias("parts"), F.sum("__n").alias("n")).first()
    base = F.broadcast(base) if held["parts"] <= FILES else base
    out = rows.join(base, F.col(part).eqNullSafe(F.col("__part"))).withColumn("__row", F.col("__base") + index).drop("__part", "__base")
    return out, held["n"] or 0


def numbered_files(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The rows of stored Parquet with __row, numbered as they lie in the files in order of path, and their count. No row moves for it."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    out, n = numbered_by(rows, "__file", F.col("__index"))
    return out.drop("__file", "__index"), n


def write_epoch(rows: DataFrame, path: str, epoch: int, shards: int) -> None:
    """Rows of ``dealt`` as an epoch's shards, each in order of offset: one shuffle by shard, no total sort."""
    rows.repartition(shards, "shard").sortWithinPartitions("shard", "offset").write.mode("errorifexists").partitionBy("shard").parquet(f"{path}/epoch={epoch}")


def remaining(spark: SparkSession, path: str, epoch: int, shard: int = 0, offset: int = 0) -> DataFrame:
    """What is left of an epoch from (shard, offset) on: earlier shards are not listed for reading, earlier rows of the shard are skipped by the offsets' bounds."""
    rows = spark.read.parquet(f"{path}/epoch={epoch}").withColumn("shard", F.col("shard").cast("long"))
    return rows.where((F.col("shard") >= shard) & ((F.col("shard") > shard) | (F.col("offset") >= offset)))


def pull(spark: SparkSession, path: str, epoch: int, shard: int = 0, offset: int = 0, rank: int = 0, world: int = 1):
    """(shard, rows in order) of each shard that is left and is this rank's (shard % world = rank). To resume, give the shard and the offset after the last row used."""
    left = remaining(spark, path, epoch, shard, offset)
    for (s,) in left.select("shard").distinct().where(F.col("shard") % world == rank).orderBy("shard").collect():  # numbers of shards
        yield s, left.where(F.col("shard") == s).orderBy("offset")
