"""Strided candle windows and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.operators.bars import dequantise, haloed, quantise
from candlewright.schema import CANDLE, INPUT_CANDLES, WINDOW


#: Rows whose windows are cut from one array (more, if windows are long).
WINDOW_BLOCK = 1000


def _block_size(size: int) -> int:
    return max(WINDOW_BLOCK, 10 * size)


def _gathered(rows: DataFrame, size: int, stride: int) -> DataFrame:
    """symbol, __block, windows (start_idx, bars): the whole windows that start in a block and whose first bar has a usable atr, in order.

    Bars are gathered once, in blocks of row numbers that get the first bars of the block after them; windows are slices of a block's array.
    """
    block = _block_size(size)
    bar = F.struct(F.col("row_idx").cast("long").alias("i"), "open", "high", "low", "close", "atr")
    held = haloed(rows, ahead=size - 1, size=block).groupBy("symbol", "__block").agg(F.sort_array(F.collect_list(bar)).alias("bars"))
    low, top = F.col("bars")[0]["i"], F.element_at("bars", -1)["i"] - (size - 1)
    begin = F.ceil(F.col("__block") * block / stride) * stride
    end = F.least((F.col("__block") + 1) * block - 1, top)
    starts = F.when(end >= begin, F.sequence(begin, end, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    cut = F.transform(F.filter(starts, lambda s: s >= low), lambda s: F.struct(s.alias("start_idx"), F.slice("bars", (s - low + 1).cast("int"), size).alias("bars")))

    def usable(w: Column) -> Column:
        first, last = w["bars"][0], F.element_at(w["bars"], -1)
        return (F.size(w["bars"]) == size) & (first["i"] == w["start_idx"]) & (last["i"] == w["start_idx"] + size - 1) & (first["atr"] > 0) & ~F.isnan(first["atr"])

    return held.select("symbol", "__block", F.filter(cut, usable).alias("windows"))


def _ahead(counts: DataFrame) -> DataFrame:
    """symbol, __block, __ahead: the sum of n over the symbol's blocks before; counts: one row a block."""
    before = Window.partitionBy("symbol").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("symbol", "__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))


def window_starts(rows: DataFrame, size: int = WINDOW, stride: int = INPUT_CANDLES) -> DataFrame:
    """symbol, start_idx, anchor_open, anchor_atr of each whole window whose first bar has a usable atr; window_no counts those kept."""
    last = rows.groupBy("symbol").agg(F.max("row_idx").alias("__last"))
    first = rows.where((F.col("row_idx") % stride == 0) & (F.col("atr") > 0) & ~F.isnan("atr"))
    kept = haloed(first.join(last, "symbol").where(F.col("row_idx") + size - 1 <= F.col("__last")), size=_block_size(size) * stride).select("symbol", "__block", "row_idx", "open", "atr")
    ahead = _ahead(kept.groupBy("symbol", "__block").agg(F.count("*").alias("n")))
    inside = F.row_number().over(Window.partitionBy("symbol", "__block").orderBy("row_idx")) - 1
    numbered = kept.join(ahead, ["symbol", "__block"]).withColumn("window_no", F.col("__ahead") + inside)
    return numbered.select("symbol", F.col("row_idx").alias("start_idx"), F.col("open").alias("anchor_open"), F.col("atr").alias("anchor_atr"), "window_no")


def encoded_windows(rows: DataFrame, scale: DataFrame | Column, size: int = WINDOW, stride: int = INPUT_CANDLES) -> DataFrame:
    """symbol, window_no, start_idx, anchor_open, anchor_atr, scale, candles. One shuffle of the rows, by block.

    scale: one for all, or a table symbol, scale, which is joined by symbol (a symbol without a scale has no windows).
    """
    held = _gathered(rows, size, stride)
    ahead = _ahead(held.select("symbol", "__block", F.size("windows").alias("n")))
    held = held.join(ahead, ["symbol", "__block"])
    held = held.withColumn("scale", scale) if isinstance(scale, Column) else held.join(scale.select("symbol", "scale"), "symbol")
    kept = held.select("symbol", "scale", "__ahead", F.posexplode("windows").alias("nth", "w")).select(
        "symbol", (F.col("__ahead") + F.col("nth")).alias("window_no"), F.col("w.start_idx").alias("start_idx"), "scale", F.col("w.bars").alias("bars")
    )
    kept = kept.withColumns({"anchor_open": F.col("bars")[0]["open"], "anchor_atr": F.col("bars")[0]["atr"]})

    def bins(b: Column) -> Column:
        return F.struct(*[quantise(b[c], F.col("anchor_open"), F.col("anchor_atr"), F.col("scale")).alias(c[0]) for c in ("open", "high", "low", "close")])

    return kept.select("symbol", "window_no", "start_idx", "anchor_open", "anchor_atr", "scale", F.transform("bars", bins).cast(f"array<{CANDLE}>").alias("candles"))


def plain_text(candles: Column) -> Column:
    """The window's stored text, without brackets around the bins."""
    return F.concat_ws(" ", F.lit("<chart>"), F.flatten(F.transform(candles, lambda c: F.array(*[F.concat(F.lit(f"{p}_"), c[p.lower()].cast("string")) for p in "OHLC"]))), F.lit("</chart>"))


def chart_text(candles: Column) -> Column:
    """The chart as a prompt has it."""
    return F.concat_ws(" ", F.lit("<chart>"), F.flatten(F.transform(candles, lambda c: F.array(*[F.concat(F.lit(f"<{p}_"), c[p.lower()].cast("string"), F.lit(">")) for p in "OHLC"]))), F.lit("</chart>"))


def parse_window(text: Column) -> Column:
    """Candles of a window's text; an error where a candle lacks a field."""
    o, h, l, c = (F.regexp_extract_all(text, F.lit(f"{p}_([0-9]+)"), F.lit(1)) for p in "OHLC")
    whole = (F.size(o) == F.size(h)) & (F.size(h) == F.size(l)) & (F.size(l) == F.size(c))
    zipped = F.transform(F.arrays_zip(o.alias("o"), h.alias("h"), l.alias("l"), c.alias("c")), lambda x: F.struct(*[x[k].cast("int").alias(k) for k in "ohlc"]))
    return F.when(whole, zipped).otherwise(F.raise_error(F.lit("a window's O, H, L and C counts differ")).cast(f"array<{CANDLE}>"))


def decoded_prices(windows: DataFrame) -> DataFrame:
    """symbol, window_no, i and the prices that the bins stand for."""
    back = [dequantise(F.col(f"c.{k}"), F.col("anchor_open"), F.col("anchor_atr"), F.col("scale")).alias(n) for k, n in zip("ohlc", ("open", "high", "low", "close"), strict=True)]
    return windows.select("*", F.posexplode("candles").alias("i", "c")).select("symbol", "window_no", "i", *back)
