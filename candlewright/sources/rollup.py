"""A table of partial sums of scored records, kept up to date from the sealed log; reports read it in place of the log.

A row is a round's step, whether the gates were passed, trend and action, with sums that can be added: a report over any range of steps is a sum of a few
rows a step. Each step remembers which seals it was summed from. ``refresh`` compares these with the log's seals and sums again only steps that
differ: new ones, late ones and repeated ones alike. A step's rows are replaced together, so a refresh that runs twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.operators.reports import group_counts
from candlewright.sources import shards
from candlewright.sources.io import RECORDS, exists

SUMS = ["n", "n_r", "sum_r", "wins", "n_rr", "sum_rr"]
_SCHEMA = "passed boolean, trend string, action_type string, n long, n_r long, sum_r double, wins long, n_rr long, sum_rr double, seen long, round_id string, step long"


def partial_sums(records: DataFrame, passed: Column) -> DataFrame:
    """step, passed, trend, action_type, and sums. Every step that has a record has a row, whatever passed."""
    r = F.col("r_multiple")
    return records.groupBy("step", F.coalesce(passed, F.lit(False)).alias("passed"), "trend", "action_type").agg(
        F.count("*").alias("n"), F.count(r).alias("n_r"), F.coalesce(F.sum(r), F.lit(0.0)).alias("sum_r"), F.count_if(r > 0).alias("wins"),
        F.count("rr").alias("n_rr"), F.coalesce(F.sum(F.col("rr").cast("double")), F.lit(0.0)).alias("sum_rr"),
    )


def partials(spark: SparkSession, path: str, round_id: str, since: int | None = None) -> DataFrame:
    """The kept sums of a round, or of its steps after ``since``; other rounds and steps are not read."""
    rows = spark.read.schema(_SCHEMA).parquet(path) if exists(spark, path) else spark.createDataFrame([], _SCHEMA)
    rows = rows.where(F.col("round_id") == round_id)
    return rows if since is None else rows.where(F.col("step") > since)


def stale_steps(spark: SparkSession, log: str, path: str, round_id: str) -> DataFrame:
    """step, seen: steps of the log whose seals are not those that the table was summed from, with a digest of the seals that hold now."""
    now = shards.seals(spark, log, round_id).groupBy("step").agg(F.bit_xor(F.xxhash64("rank", "attempt")).alias("seen"))
    kept = partials(spark, path, round_id).groupBy("step").agg(F.max("seen").alias("was"))
    return now.join(kept, "step", "left").where(~F.col("seen").eqNullSafe(F.col("was"))).select("step", "seen")


def refresh(spark: SparkSession, log: str, path: str, round_id: str, passed: Column, schema: str = RECORDS) -> None:
    """Sums the steps of the log that are new or have changed, and replaces their rows. Only these steps' lines are read, and an error names those that are not whole. schema: the fields of a record, which ``passed`` is made of."""
    stale = stale_steps(spark, log, path, round_id)
    summed = partial_sums(shards.read_shards(spark, log, round_id, schema=schema, steps=stale), passed).join(stale, "step").withColumn("round_id", F.lit(round_id))
    rows = summed.select(*[f.split()[0] for f in _SCHEMA.split(", ")]).repartition("round_id", "step")  # a step's few rows in one file
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("round_id", "step").parquet(path)


def trend_action(sums: DataFrame) -> DataFrame:
    """As ``reports.trend_action`` of the records summed."""
    total = sums.where("passed and trend is not null and action_type is not null").groupBy("trend", "action_type").agg(*[F.sum(c).alias(c) for c in SUMS])
    share = F.col("n") / F.sum("n").over(Window.partitionBy("trend"))  # a row an action
    mean = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b)).alias
    return total.select("trend", "action_type", "n", mean("sum_r", "n_r")("avg_r"), mean("wins", "n_r")("win_rate"), mean("sum_rr", "n_rr")("avg_rr"), share.alias("share"))


def group_rollup(sums: DataFrame) -> DataFrame:
    """As ``reports.group_rollup`` of the records summed."""
    return group_counts(sums.where("passed"), F.sum("n"))


def counts(sums: DataFrame) -> DataFrame:
    """key, n: as ``reports.count_by`` action of the records summed."""
    return sums.where("passed and action_type is not null").groupBy(F.col("action_type").alias("key")).agg(F.sum("n").alias("n"))
