"""Logs of records by round, step and rank, in sealed shards.

A shard is what one rank has of one step. ``append_shards`` writes its lines to a folder of their own attempt, reads them back, and then seals them: a row
with the attempt, the count and two order-free digests of the lines as they stand. Readers take the last seal of each shard, so a shard that is written
twice counts once, the lines of a writer that died before its seal count nowhere, and lines that were changed, cut off or lost since are found by their
digests. Counts and digests are sums of each shard: the rows of a shard never meet in one place.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.sources.io import RECORDS, exists

SHARD = ["step", "rank"]
_SEALS = "step long, rank long, attempt string, n long, total decimal(38,0), mixed long, at long"


def _folder(path: str, kind: str, round_id: str) -> str:
    if not re.fullmatch(r"[\w.-]+", round_id):
        raise ValueError(f"not a name of a round: {round_id!r}")
    return f"{path}/{kind}/round_id={round_id}"


def _sums() -> list[Column]:
    h = F.xxhash64("value")
    return [F.count("*").alias("n"), F.sum(h.cast("decimal(20,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor(h).alias("mixed")]


def _text(spark: SparkSession, folder: str, *names: str) -> DataFrame:
    """value of every line below a folder, and the named parts of its path: numbers, but for attempts. Without a file there is no row."""
    raw = spark.read.text(folder)
    none = [c for c in names if c not in raw.columns]  # no file, no path
    kinds = {c: "string" if c == "attempt" else "long" for c in names}
    rows = raw.select("value", *[(F.lit(None) if c in none else F.col(c)).cast(k).alias(c) for c, k in kinds.items()])
    return rows.where(F.lit(False)) if none else rows


def _lines(spark: SparkSession, path: str, round_id: str) -> DataFrame:
    """value, attempt, step, rank of every line of a round, sealed or not."""
    return _text(spark, _folder(path, "lines", round_id), "attempt", *SHARD)


def append_shards(records: DataFrame, path: str, round_id: str) -> str:
    """Adds records (with step and rank, both not null) as one JSON object a line, and seals them; returns the attempt. A shard in the log already is replaced by the new one."""
    spark, attempt = records.sparkSession, f"a{uuid.uuid4().hex}"  # the letter keeps it a text
    fields = [F.col(f"`{c.replace('`', '``')}`") for c in records.columns if c not in SHARD]
    named = lambda c: F.coalesce(F.col(c).cast("long"), F.raise_error(F.lit(f"a record has no {c}")).cast("long")).alias(c)
    lines = records.select(F.to_json(F.struct(*fields)).alias("value"), *map(named, SHARD))
    folder = f"{_folder(path, 'lines', round_id)}/attempt={attempt}"
    lines.write.mode("errorifexists").partitionBy(*SHARD).text(folder)
    sealed = _text(spark, folder, *SHARD).groupBy(*SHARD).agg(*_sums()).withColumns({"attempt": F.lit(attempt), "at": F.lit(time.time_ns())})
    names = [f.split()[0] for f in _SEALS.split(", ")]
    sealed.select(*names).write.mode("append").parquet(_folder(path, "seals", round_id))  # one file a task at most; a job's files appear together
    return attempt


def seals(spark: SparkSession, path: str, round_id: str, after: int | None = None) -> DataFrame:
    """step, rank, attempt, n, total, mixed: the last seal of each shard, of steps after ``after`` if given."""
    folder = _folder(path, "seals", round_id)
    rows = spark.read.schema(_SEALS).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], _SEALS)
    rows = rows if after is None else rows.where(F.col("step") > after)
    last = rows.groupBy(*SHARD).agg(F.max_by(F.struct("attempt", "n", "total", "mixed"), F.struct("at", "attempt")).alias("last"))
    return last.select(*SHARD, "last.*")


def _of(rows: DataFrame, steps: DataFrame | None) -> DataFrame:
    return rows if steps is None else rows.join(steps.select("step").distinct(), "step", "left_semi")


def faults(spark: SparkSession, path: str, round_id: str, after: int | None = None, steps: DataFrame | None = None) -> DataFrame:
    """step, rank, fault of each shard (of steps after ``after``, or of the ``steps`` given) that can't be read whole: ``missing`` (no line is left), ``changed`` (count or digests differ), ``unsealed`` (lines, but no seal)."""
    last = _of(seals(spark, path, round_id, after), steps)
    if not exists(spark, _folder(path, "lines", round_id)):
        return last.select(*SHARD, F.lit("missing").alias("fault"))
    lines = _lines(spark, path, round_id)
    found = _of(lines if after is None else lines.where(F.col("step") > after), steps).groupBy("attempt", *SHARD).agg(*_sums())
    met = last.alias("s").join(found.alias("f"), ["attempt", *SHARD], "left")
    same = (F.col("s.n") == F.col("f.n")) & (F.col("s.total") == F.col("f.total")) & (F.col("s.mixed") == F.col("f.mixed"))
    fault = F.when(F.col("f.n").isNull(), "missing").when(~same, "changed")
    open_ = found.select(*SHARD).distinct().join(last, SHARD, "left_anti").select(*SHARD, F.lit("unsealed").alias("fault"))
    return met.select(*SHARD, fault.alias("fault")).where("fault is not null").unionByName(open_)


def sealed_records(spark: SparkSession, path: str, round_id: str, after: int | None = None, schema: str = RECORDS, steps: DataFrame | None = None) -> DataFrame:
    """Records of the last seals, with step and rank; of steps after ``after``, or of the ``steps`` (a table with step) given. Fields that a line lacks are null. Nothing is checked here."""
    last = _of(seals(spark, path, round_id, after), steps)
    if not exists(spark, _folder(path, "lines", round_id)):
        return spark.createDataFrame([], f"step long, rank long, {schema}")
    lines = _lines(spark, path, round_id)
    lines = lines if after is None else lines.where(F.col("step") > after)
    kept = lines.join(last.select("attempt", *SHARD), ["attempt", *SHARD], "left_semi")
    return kept.select(*SHARD, F.from_json("value", schema).alias("r")).select(*SHARD, "r.*")


def read_shards(spark: SparkSession, path: str, round_id: str, after: int | None = None, schema: str = RECORDS, steps: DataFrame | None = None) -> DataFrame:
    """``sealed_records``, after every shard of them has passed by its digests; else an error that names the first twenty faults and their number. An absent log has no records."""
    found = faults(spark, path, round_id, after, steps)
    first = found.orderBy(*SHARD).limit(20).collect()
    if first:
        shown = ", ".join(f"step {r.step} rank {r.rank} {r.fault}" for r in first)
        raise ValueError(f"{found.count()} shards of {round_id} can't be read whole: {shown}")
    return sealed_records(spark, path, round_id, after, schema, steps)
