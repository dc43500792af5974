"""Bars: true range, average true range, trailing deviation, scale.

A series may be of any length: nothing here orders a whole symbol in one task. Bars are dealt out once, by symbol and block
(a week of timestamps, BLOCK positions of whole numbers, a file's split); each block works on its own rows, tells what it hands on in one row, and those
few rows are scanned in order of blocks. Trailing windows go by blocks of row numbers, which get the rows before them that they reach back to.
A null symbol is no series; its rows are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StructType, TimestampNTZType, TimestampType

#: Rows of a block, where rows are numbered.
BLOCK = 4096
#: Values are weighed against the start of a stretch; a stretch ends where weights have fallen by e to this power.
SCAN_FALL = 200.0

_KEY = ["symbol", "__block"]


def series_block(bars: DataFrame) -> Column:
    """The block of a bar, in the order of ts."""
    kind = bars.schema["ts"].dataType
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return F.date_trunc("week", "ts")
    if isinstance(kind, NumericType):
        return F.floor(F.col("ts") / BLOCK)
    return F.col("ts")[kind.names[0]] if isinstance(kind, StructType) else F.lit(0)


def in_blocks(bars: DataFrame) -> DataFrame:
    """The bars with their block, dealt out by it."""
    return bars if "__block" in bars.columns else bars.where("symbol IS NOT NULL").withColumn("__block", series_block(bars)).repartition(*_KEY)


def _inside() -> Window:
    return Window.partitionBy(*_KEY).orderBy("ts")


def _blocks() -> Window:
    """Over one row a block."""
    return Window.partitionBy("symbol").orderBy("__block")


def _ranged(bars: DataFrame) -> DataFrame:
    rows = in_blocks(bars)
    last = rows.groupBy(*_KEY).agg(F.max_by("close", "ts").alias("__close"))
    handed = last.select(*_KEY, F.lag("__close").over(_blocks()).alias("__handed"))
    before = F.when(F.row_number().over(_inside()) == 1, F.col("__handed")).otherwise(F.lag("close").over(_inside()))
    tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("__before")), F.abs(F.col("low") - F.col("__before")))
    met = rows.join(handed, _KEY).withColumn("__before", before)
    known = F.col("__before").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull()
    return met.withColumn("tr", F.when(known, tr)).drop("__before", "__handed")


def with_true_range(bars: DataFrame) -> DataFrame:
    """tr: null on a symbol's first bar (there is no close before it) and where a price it needs is null; greatest() alone would skip the null."""
    return _ranged(bars).select(*bars.columns, "tr")


def _decayed(rows: DataFrame, by: list[str], order: str, fall: str, add: str, total: str, name: str) -> DataFrame:
    """total: the sum of ``fall`` so far; name: the sum of ``add`` so far, each term weighed by e to minus the fall since.

    A term is weighed against the start of its stretch, which moves on each time weights have fallen by e**SCAN_FALL; what the stretch before has come to
    is carried over, and what is older weighs less than a double can show. All of it is running frames; nothing of a series is held.
    """
    s = Window.partitionBy(*by).orderBy(order)
    upto = s.rowsBetween(Window.unboundedPreceding, 0)
    at, start = F.col(total), F.col("__stretch") * SCAN_FALL
    rows = rows.withColumn(total, F.coalesce(F.sum(fall).over(upto), F.lit(0.0))).withColumn("__stretch", F.floor(at / SCAN_FALL))
    inside = Window.partitionBy(*by, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", F.exp(start - at) * F.coalesce(F.sum(F.col(add) * F.exp(at - start)).over(inside), F.lit(0.0)))
    rows = rows.withColumn("__last", F.lag(F.struct("__stretch", "__own", at.alias("at"))).over(s))
    before = F.last(F.when(F.col("__last.__stretch") != F.col("__stretch"), F.col("__last")), ignorenulls=True).over(upto)
    carried = F.coalesce(F.col("__before.__own") * F.exp(F.col("__before.at") - at), F.lit(0.0))
    return rows.withColumn("__before", before).withColumn(name, F.col("__own") + carried).drop("__stretch", "__own", "__last", "__before")


def _averaged(bars: DataFrame, value: str, period: int, name: str, whole: Column) -> DataFrame:
    """The bars in blocks with ``name``, and __ahead: how many rows of earlier blocks have it and are ``whole``.

    In a block the mean is a * first + b, where first is the mean at the block's first value; a and b need the block alone. A block
    hands on what it makes of the mean before it, which is of that form as well, so means at the ends of blocks are one more decayed sum.
    """
    decay = 1 - 2 / (period + 1)
    s = _inside()
    upto = s.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("__v")
    rows = in_blocks(bars).withColumn("__v", F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")))
    given = v.isNotNull()
    rows = rows.withColumn("__i", F.row_number().over(s)).withColumn("__seen", F.count(v).over(upto))
    since = F.col("__i") - F.last(F.when(given, F.col("__i")), ignorenulls=True).over(s.rowsBetween(Window.unboundedPreceding, -1))
    later = given & (F.col("__seen") > 1)

    def step(gap: Column) -> tuple[Column, Column]:
        """How weights fall at a value that comes ``gap`` rows after the one before, and the value's own weight."""
        if decay <= 0:
            return F.lit(SCAN_FALL * 4), F.lit(1.0)
        old = F.exp(gap * math.log(decay))
        return F.ln(old + (1 - decay)) - gap * math.log(decay), (1 - decay) / (old + (1 - decay))

    fall, weight = step(F.col("__gap"))
    rows = rows.withColumn("__gap", since).withColumns({"__fall": F.when(later, fall), "__add": F.when(later, v * weight)})
    rows = _decayed(rows, _KEY, "ts", "__fall", "__add", "__at", "__b")
    told = rows.groupBy(*_KEY).agg(
        F.count("*").alias("__n"), F.min(F.when(given, F.col("__i"))).alias("__first_i"), F.max(F.when(given, F.col("__i"))).alias("__last_i"),
        F.min_by(v, F.when(given, F.col("__i"))).alias("__first_v"), F.max_by("__at", "__i").alias("__at_end"), F.max_by("__b", "__i").alias("__b_end"),
        F.count_if(whole).alias("__all"), F.count_if(whole & (F.col("__seen") > 0)).alias("__since"),
    )
    before = _blocks().rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__n").over(before), F.lit(0))
    told = told.withColumn("__start", start).withColumn("__known", F.last(F.col("__start") + F.col("__last_i"), ignorenulls=True).over(before))
    fall, weight = step(F.col("__start") + F.col("__first_i") - F.col("__known"))
    has, first_ever = F.col("__first_i").isNotNull(), F.col("__known").isNull()
    told = told.withColumns({"__step": F.when(has & ~first_ever, fall), "__weight": F.when(first_ever, 1.0).otherwise(weight)})
    told = told.withColumns(
        {
            "__block_fall": F.when(has, F.col("__at_end") + F.coalesce("__step", F.lit(0.0))),
            "__block_add": F.when(has, F.exp(-F.col("__at_end")) * F.col("__weight") * F.col("__first_v") + F.col("__b_end")),
        }
    )
    told = _decayed(told, ["symbol"], "__block", "__block_fall", "__block_add", "__all_fall", "__mean")
    told = told.withColumn("__handed", F.when(~first_ever, F.lag("__mean").over(_blocks())))
    first = F.when(first_ever, F.col("__first_v")).otherwise(F.exp(-F.col("__step")) * F.col("__handed") + F.col("__weight") * F.col("__first_v"))
    kept = F.when(first_ever, F.col("__since")).otherwise(F.col("__all"))
    told = told.withColumns({"__first": first, "__kept": kept}).withColumn("__ahead", F.coalesce(F.sum("__kept").over(before), F.lit(0)))
    met = rows.join(told.select(*_KEY, "__handed", "__first", "__ahead"), _KEY)
    mean = F.when(F.col("__seen") > 0, F.exp(-F.col("__at")) * F.col("__first") + F.col("__b")).otherwise(F.col("__handed"))
    return met.withColumn(name, mean)


def with_ema(bars: DataFrame, value: str, period: int, name: str) -> DataFrame:
    """Exponential mean with span ``period``, seeded by the first value; a null or NaN leaves it, and older values weigh less by position all the same. Span 1 is the value itself."""
    return _averaged(bars, value, period, name, F.lit(True)).select(*bars.columns, name)


def preprocess(bars: DataFrame, period: int = 100) -> DataFrame:
    """Bars with atr and row_idx (dense from 0 in each symbol after rows with a null went: the first bar always goes)."""
    prices = ("open", "high", "low", "close")
    whole = F.lit(True)
    for p in prices:
        whole = whole & F.col(p).isNotNull() & ~F.isnan(p)
    rows = _averaged(_ranged(bars), "tr", period, "atr", whole).where(whole & F.col("atr").isNotNull())
    return rows.withColumn("row_idx", F.col("__ahead") + F.row_number().over(_inside()) - 1).select(*bars.columns, "atr", "row_idx")


def haloed(rows: DataFrame, behind: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """The rows with __block, the block of ``size`` row numbers; rows that the next block needs ``behind`` it, or the one before ``ahead`` of it, are there once more. Both are at most ``size``."""
    own, at = F.floor(F.col("row_idx") / size), F.pmod(F.col("row_idx"), F.lit(size))
    places = [own]
    if behind:
        places.append(F.when(at >= size - behind, own + 1))
    if ahead:
        places.append(F.when((at < ahead) & (own > 0), own - 1))
    return rows.withColumn("__block", F.explode(F.array_compact(F.array(*places))) if len(places) > 1 else own)


def with_deviation(rows: DataFrame, period: int = 100) -> DataFrame:
    """deviation: the farthest price of the last ``period`` rows from this row's open; ratio: in units of atr. Row 0 has none."""
    size = max(BLOCK, 4 * period)
    w = Window.partitionBy(*_KEY).orderBy("row_idx").rowsBetween(-(period - 1), 0)
    high, low = F.max(F.greatest("open", "high", "low", "close")).over(w), F.min(F.least("open", "high", "low", "close")).over(w)
    deviation = F.greatest(high - F.col("open"), F.col("open") - low)
    out = haloed(rows, behind=period - 1, size=size).withColumn("deviation", deviation).where((F.floor(F.col("row_idx") / size) == F.col("__block")) & (F.col("row_idx") >= 1))
    return out.withColumn("ratio", F.try_divide("deviation", "atr")).select(*rows.columns, "deviation", "ratio")


def scales(rows: DataFrame, period: int = 100, share: float = 0.999) -> DataFrame:
    """symbol, scale: the exact interpolated percentile of the deviation ratios."""
    return percentiles(with_deviation(rows, period), "symbol", "ratio", share, "scale")


#: Cells of a value's power of e in the first round, and of the cell found in the second: as many rows a group and round at most, and about as many different doubles are left.
_CELLS, _PARTS = 4096, 1 << 20


def percentiles(rows: DataFrame, by: str, value: str, share: float, name: str) -> DataFrame:
    """by, name: the exact percentile of each group, interpolated between neighbours, by selection in three rounds.

    Each round counts the values of a group by cell (first of the logarithm, then of the found cell's range, then the different values
    left), sums the counts in order and keeps the cells of the two neighbours. So a group is never sorted or gathered, and ties are one row. Nulls and
    NaN are no values; a group without a value has no row.
    """
    x = F.col("__x")
    values = rows.select(F.col(by).alias("__by"), F.col(value).cast("double").alias("__x")).where(x.isNotNull() & ~F.isnan(x))
    huge = F.lit(1 << 40)
    size = F.least(F.floor(F.ln(F.abs(x)) * _CELLS), huge) + huge
    cell = F.when(x == 0, F.lit(0)).when(x > 0, size + 1).otherwise(-size - 1)

    def found(counted: DataFrame, keys: list[str], cell_name: str) -> DataFrame:
        """The cells of the wanted ranks, each with its rank inside: keys, rank."""
        order = Window.partitionBy(*keys).orderBy(cell_name)
        below = F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counted.withColumn("__below", below)
        return placed.where((F.col("__rank") >= F.col("__below")) & (F.col("__rank") < F.col("__below") + F.col("__n"))).withColumn("__rank", F.col("__rank") - F.col("__below"))

    first = values.withColumn("__cell", cell).groupBy("__by", "__cell").agg(F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    at = (F.sum("__n").over(Window.partitionBy("__by")) - 1) * F.lit(float(share))
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("upper"), r.cast("long").alias("rank")) for k, r in enumerate((F.floor("__at"), F.ceil("__at")))]))
    asked = first.withColumn("__at", at).withColumn("__want", both).select("__by", "__cell", "__n", "__low", "__high", (F.col("__at") - F.floor("__at")).alias("__share"), F.col("__want.upper").alias("__upper"), F.col("__want.rank").alias("__rank"))
    asked = found(asked, ["__by", "__upper"], "__cell").select(F.col("__by").alias("__g"), "__upper", "__rank", "__share", "__low", "__high")

    same = F.col("__by").eqNullSafe(F.col("__g")) & (x >= F.col("__low")) & (x <= F.col("__high"))
    part = F.when(F.col("__high") > F.col("__low"), F.least(F.floor((x - F.col("__low")) / (F.col("__high") - F.col("__low")) * _PARTS), F.lit(_PARTS - 1))).otherwise(F.lit(0))
    keys = ["__by", "__upper", "__rank", "__share"]
    second = values.join(asked, same).withColumn("__part", part).groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    asked = found(second, ["__by", "__upper"], "__part").select(F.col("__by").alias("__g"), "__upper", "__rank", "__share", "__low", "__high")
    third = values.join(asked, same).groupBy(*keys, "__x").agg(F.count("*").alias("__n"))
    chosen = found(third, ["__by", "__upper"], "__x")
    low, high = (F.max(F.when(F.col("__upper") == k, x)) for k in (0, 1))
    ends = chosen.groupBy("__by").agg(low.alias("__low"), high.alias("__high"), F.max("__share").alias("__share"))
    between = F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(F.col("__low") * (1 - F.col("__share")) + F.col("__high") * F.col("__share"))
    return ends.select(F.col("__by").alias(by), between.alias(name))


def quantise(price: Column, anchor: Column, atr: Column, scale: Column, n_bins: int = 1024) -> Column:
    """Price to bin: clipped to one scale around the anchor, rounded half to even."""
    at = F.greatest(F.least((price - anchor) / (scale * atr), F.lit(1.0)), F.lit(-1.0))
    return F.rint((at + 1) / 2 * (n_bins - 1)).cast("int")


def dequantise(bin_: Column, anchor: Column, atr: Column, scale: Column, n_bins: int = 1024) -> Column:
    return (bin_ / F.lit(float(n_bins - 1)) * 2 - 1) * scale * atr + anchor
