"""Streams: bars from ticks, and the controller that follows scored records micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from candlewright.operators import control


def windowed_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of each symbol in tumbling windows; ticks that come later than ``late`` are left out. (An extension.)"""
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", width), "symbol")
        .agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("ticks"))
        .select("symbol", F.col("window.start").alias("ts"), "open", "high", "low", "close", "ticks")
    )


def bars_to_table(ticks: DataFrame, folder: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Runs the stream to its end and reads what it has written: the bars that the watermark has closed, appended once each; later ticks do not change them."""
    out = windowed_bars(ticks, width, late).writeStream.outputMode("append").format("parquet")
    query = out.option("path", f"{folder}/bars").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return ticks.sparkSession.read.schema("symbol string, ts timestamp, open double, high double, low double, close double, ticks long").parquet(f"{folder}/bars")


Report = Callable[[DataFrame, DataFrame], None]


def follow(
    records: DataFrame, state_path: str, start: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], advance: Callable[[DataFrame, DataFrame], DataFrame],
    out_path: str, checkpoint: str, report: Report | None = None, every: int = 0,
) -> StreamingQuery:
    """Scores each micro-batch with the state of the batch before, appends the rows, then writes the next state.

    state_path/batch=n holds the state after batch n-1, so a batch that runs again reads the same state and writes the same rows.
    report: after each ``every`` batches, called with the rows of these batches and the state; a period is a range of batches, nothing is cleared.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark: SparkSession = batch.sparkSession
        state = start if n == 0 else spark.read.parquet(f"{state_path}/batch={n}")
        score(batch, state).write.mode("overwrite").parquet(f"{out_path}/batch={n}")
        scored = spark.read.parquet(f"{out_path}/batch={n}")
        advance(scored, state).write.mode("overwrite").parquet(f"{state_path}/batch={n + 1}")
        if report and every and (n + 1) % every == 0:
            report(spark.read.parquet(*[f"{out_path}/batch={k}" for k in range(n + 1 - every, n + 1)]), spark.read.parquet(f"{state_path}/batch={n + 1}"))

    return records.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def controlled(settings: DataFrame, reward: Callable[[DataFrame], DataFrame], key: Column, counted: Column, group: Column) -> tuple[Callable, Callable]:
    """score and advance of ``follow`` for a round's buff controller: a micro-batch is one step.

    reward: makes reward of rows with buff. key: the buff's group of a row; group and counted: what the step's rates count, of scored rows.
    """

    def score(batch: DataFrame, state: DataFrame) -> DataFrame:
        return reward(control.with_buff(batch, key, state))

    def advance(scored: DataFrame, state: DataFrame) -> DataFrame:
        groups = settings.select("namespace", "grp")
        rows = scored.withColumns({"step": F.lit(0), "namespace": F.lit("action")}) if "namespace" not in scored.columns else scored.withColumn("step", F.lit(0))
        return control.advanced(state, control.step_rates(rows, group, groups, counted, ("namespace",)), settings)

    return score, advance
