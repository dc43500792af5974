"""Training rows from windows: prompts, futures, bin shifts, tasks, splits."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.operators.windows import chart_text
from candlewright.schema import BIN_MAX, INPUT_CANDLES, WINDOW

TASKS = ("zone", "action")
#: The build presets: variants of each window, samples of each chart, seed and stride.
PRESETS = {
    "train_prompts": {"augments": 5, "seed": 42, "stride": INPUT_CANDLES},
    "train_text": {"augments": 10, "samples": 10, "seed": 42, "stride": INPUT_CANDLES},
    "validation": {"augments": 0, "seed": 42, "stride": 1},
}


def draw(size: Column, *key: Column | str) -> Column:
    """A number in [0, size), fixed by the key; md5, so that any engine draws the same."""
    text = F.concat_ws("|", *[k if isinstance(k, Column) else F.lit(k) for k in key])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), size.cast("long"))


def shift(candles: Column, delta: Column) -> Column:
    return F.transform(candles, lambda c: F.struct(*[(c[k] + delta).alias(k) for k in "ohlc"]))


def augmented(windows: DataFrame, variants: int, seed: int, bounds: Column | None = None) -> DataFrame:
    """Each window (k = -1) and up to ``variants`` copies moved by a non-zero number of bins that keeps all ``bounds`` candles in range.

    A window with no room yields no copy; its k is used up all the same.
    """
    seen = F.col("candles") if bounds is None else bounds
    low, high = -F.array_min(F.transform(seen, lambda c: c["l"])), F.lit(BIN_MAX) - F.array_max(F.transform(seen, lambda c: c["h"]))
    choice = draw(F.greatest(high - low, F.lit(1)), F.col("window_id"), F.col("k").cast("string"), F.lit(str(seed))) + low
    delta = F.when(F.col("k") < 0, F.lit(0)).otherwise(F.when(choice >= 0, choice + 1).otherwise(choice))  # zero is left out
    out = windows.withColumn("k", F.explode(F.sequence(F.lit(-1), F.lit(variants - 1)))).withColumn("delta", delta.cast("int"))
    out = out.where((F.col("k") < 0) | (high - low > 0))
    return out.withColumn("candles", shift(F.col("candles"), F.col("delta"))).withColumn(
        "window_id", F.when(F.col("k") < 0, F.col("window_id")).otherwise(F.concat("window_id", F.lit("_aug"), F.col("k").cast("string")))
    )


def prompt_rows(windows: DataFrame, variants: int = 0, seed: int = 42) -> DataFrame:
    """prompt, future_bins, symbol, window_id. window_id counts the kept windows of a symbol."""
    whole = windows.where(F.size("candles") == WINDOW).withColumn("window_id", F.concat_ws("_", "symbol", F.col("window_no").cast("string")))
    out = augmented(whole, variants, seed) if variants else whole
    future = F.transform(F.slice("candles", INPUT_CANDLES + 1, WINDOW), lambda c: F.array(c["o"], c["h"], c["l"], c["c"]))
    return out.select(chart_text(F.slice("candles", 1, INPUT_CANDLES)).alias("prompt"), future.alias("future_bins"), "symbol", "window_id")


def chart_rows(windows: DataFrame, variants: int = 0, seed: int = 42) -> DataFrame:
    """symbol, window_id, candles (the input half) for the text builder; shifts are bounded by the input half alone."""
    whole = windows.where(F.size("candles") == WINDOW).withColumn("window_id", F.concat_ws("_", "symbol", F.col("window_no").cast("string")))
    whole = whole.withColumn("candles", F.slice("candles", 1, INPUT_CANDLES))
    return (augmented(whole, variants, seed) if variants else whole).select("symbol", "window_id", "candles")


def task_rows(rows: DataFrame, tasks: tuple[str, ...] = TASKS) -> DataFrame:
    """Each row once for each task, its id suffixed."""
    return rows.withColumn("task_id", F.explode(F.array(*map(F.lit, tasks)))).withColumn("window_id", F.concat_ws("_", "window_id", "task_id"))


def shuffled(rows: DataFrame, seed: int, *key: str) -> DataFrame:
    """A fixed random order by key."""
    return rows.orderBy(F.md5(F.concat_ws("|", *key, F.lit(str(seed)))), *key)


def split_by_time(windows: DataFrame, share: float = 0.2) -> DataFrame:
    """split: each symbol's last windows are val; a window whose candles reach into both is in neither (null)."""
    ends = windows.groupBy("symbol").agg((F.max("start_idx") + WINDOW).alias("end"))
    cut = F.floor(F.col("end") * (1 - share))
    split = F.when(F.col("start_idx") + WINDOW <= cut, "train").when(F.col("start_idx") >= cut, "val")
    return windows.join(ends, "symbol").withColumn("split", split).drop("end")


def round_seed(round_id: str) -> int:
    return int(hashlib.md5(round_id.encode()).hexdigest(), 16) % (1 << 31)


def round_seed_column(round_id: Column) -> Column:
    return F.conv(F.right(F.md5(round_id), F.lit(8)), 16, 10).cast("long") % (1 << 31)
