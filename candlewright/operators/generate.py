"""Valid decisions over charts: tries of a sample are made one after the other in its own row until one is valid.

Draws come from md5 of (window, sample, try, purpose), so they need no order and any part can be made again alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.functions.text import completion, let
from candlewright.operators.dataset import draw
from candlewright.operators.forward import sl_valid
from candlewright.operators.language import assembled, parse_programs
from candlewright.operators.semantics import violations, with_semantics
from candlewright.operators.windows import chart_text
from candlewright.schema import BIN_MAX, LEAVES, RR_MAX, TOUCH_LOOKBACK

TRIES = 30
WIDTH, DISTANCE = (5, 20), (5, 10)
SAMPLE = (
    "struct<leaf:int,trend:string,current_price_bin:int,zone_direction:string,zone_lower:int,zone_upper:int,"
    "price_in_zone:boolean,good_price_action:boolean,action_type:string,sl:int,rr:int>"
)
_FIELDS = [x.split(":")[0] for x in SAMPLE[7:-1].split(",")]


def leaves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(LEAVES)], "leaf int, leaf_trend string, side string, zone_case string, leaf_action string")


def _leaf(n: Column) -> Column:
    names = ("trend", "side", "case", "action")
    return F.element_at(F.array(*[F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(names, leaf, strict=True)]) for leaf in LEAVES]), n + 1)


def zone(side: Column, case: Column, width: Column, price: Column, last: Column, offset: Column, pick: Column) -> Column:
    """struct<lower, upper>, null where the case has no room. offset: a draw in [0, width]; pick: a draw of a close, by remainder."""
    below = F.filter(F.transform(last, lambda c: c["c"]), lambda x: x < price)
    above = F.filter(F.transform(last, lambda c: c["c"]), lambda x: x > price)
    near = lambda xs: F.try_element_at(xs, (F.pmod(pick, F.greatest(F.size(xs), F.lit(1))) + 1).cast("int"))
    low, high = F.array_min(F.transform(last, lambda c: c["l"])), F.array_max(F.transform(last, lambda c: c["h"]))
    support = side == "support"
    edge = (
        F.when(case == "CONTAINS", F.when(support, price - offset + width).otherwise(price + offset - width))
        .when(case == "TOUCH", F.when(support, F.least(near(below) + offset, price - 1)).otherwise(F.greatest(near(above) - offset, price + 1)))
        .otherwise(F.when(support, F.least(low, price) - 1).otherwise(F.greatest(high, price) + 1))
    )
    possible = (case != "TOUCH") | F.when(support, F.size(below) > 0).otherwise(F.size(above) > 0)

    def placed(e: Column) -> Column:
        made = F.struct(F.when(support, e - width).otherwise(e).cast("int").alias("lower"), F.when(support, e).otherwise(e + width).cast("int").alias("upper"))
        return F.when(possible & e.isNotNull(), let(made, lambda z: F.when((z["lower"] >= 0) & (z["upper"] <= BIN_MAX), z)))

    return let(edge, placed)


def stop(action: Column, price: Column, lower: Column, upper: Column, order: Callable[[Column], Column], pick: Column) -> Column:
    """struct<sl, rr>: of the distances, in a drawn order, the first whose stop lies beyond the zone and leaves a target in range, then one of its multiples by draw.

    order: a draw for each distance; ties go by distance. Null where no distance fits.
    """
    buy = action == "BUY"

    def fitting(d: Column) -> Column:
        sl = F.when(buy, price - d).otherwise(price + d)
        beyond = F.when(buy, sl < lower).otherwise(sl > upper) & sl.between(0, BIN_MAX)
        target = lambda r: F.when(buy, price + d * r).otherwise(price - d * r)
        rrs = F.filter(F.sequence(F.lit(1), F.lit(RR_MAX)), lambda r: beyond & target(r).between(0, BIN_MAX))
        return F.struct(order(d).alias("at"), d.alias("d"), sl.cast("int").alias("sl"), rrs.alias("rrs"))

    tried = F.filter(F.transform(F.sequence(F.lit(DISTANCE[0]), F.lit(DISTANCE[1])), fitting), lambda x: F.size(x["rrs"]) > 0)

    def chosen(x: Column) -> Column:
        rr = F.element_at(x["rrs"], (F.pmod(pick, F.size(x["rrs"])) + 1).cast("int"))
        return F.when(x.isNotNull(), F.struct(x["sl"].alias("sl"), rr.cast("int").alias("rr")))

    return let(F.array_min(tried), chosen)


def _attempt(t: Column, price: Column, last: Column, seed: int) -> Column:
    """One try: a SAMPLE, null where it has no room or breaks a rule."""
    key = [F.col("window_id"), F.col("sample").cast("string"), t.cast("string"), F.lit(str(seed))]
    dice = lambda size, *purpose: draw(size if isinstance(size, Column) else F.lit(size), *key, *purpose)
    most = 1 << 20

    def with_leaf(d: Column) -> Column:
        leaf = d["leaf"]
        z = zone(leaf["side"], leaf["case"], d["width"], price, last, dice(d["width"] + 1, "offset"), dice(most, "close"))
        flat = leaf["side"].isNull()
        return let(F.when(~flat, z), lambda z: F.when(flat | z.isNotNull(), with_zone(d, leaf, z)))

    def with_zone(d: Column, leaf: Column, z: Column) -> Column:
        trade = leaf["action"].isin("BUY", "SELL")
        s = F.when(trade, stop(leaf["action"], price, z["lower"], z["upper"], lambda x: dice(most, "distance", x.cast("string")), dice(most, "rr")))
        return let(s, lambda s: F.when(~trade | s.isNotNull(), checked(d, leaf, z, trade, s)))

    def checked(d: Column, leaf: Column, z: Column, trade: Column, s: Column) -> Column:
        made = F.struct(
            d["no"].alias("leaf"), leaf["trend"].alias("trend"), price.alias("current_price_bin"), leaf["side"].alias("zone_direction"), z["lower"].alias("zone_lower"),
            z["upper"].alias("zone_upper"), F.coalesce(leaf["case"].isin("CONTAINS", "TOUCH"), F.lit(False)).alias("price_in_zone"), trade.alias("good_price_action"),
            leaf["action"].alias("action_type"), s["sl"].alias("sl"), s["rr"].alias("rr"),
        ).cast(SAMPLE)
        return let(made, lambda m: F.when(F.size(violations(field=lambda n: last if n == "candles" else m[n])) == 0, m))

    no = dice(len(LEAVES), "leaf").cast("int")
    width = (dice(WIDTH[1] - WIDTH[0] + 1, "width") + WIDTH[0]).cast("int")
    return let(no, lambda no: let(F.struct(no.alias("no"), _leaf(no).alias("leaf"), width.alias("width")), with_leaf))


def samples(charts: DataFrame, per_chart: int, seed: int, tries: int = TRIES) -> DataFrame:
    """charts: window_id, candles (the input half). Up to per_chart samples of each; a sample whose tries all fail is left out.

    A row is one sample: no try is a row, nothing is shuffled, and tries end with the first valid one.
    """
    grid = charts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(per_chart - 1))))
    grid = grid.withColumns({"__price": F.element_at("candles", -1)["c"], "__last": F.slice("candles", -TOUCH_LOOKBACK, TOUCH_LOOKBACK)})
    one = lambda done, t: F.when(done.isNotNull(), done).otherwise(_attempt(t, F.col("__price"), F.col("__last"), seed))
    made = grid.withColumn("s", F.aggregate(F.sequence(F.lit(0), F.lit(tries - 1)), F.lit(None).cast(SAMPLE), one)).where("s is not null")
    text = completion(*[F.col(c) for c in ("trend", "current_price_bin", "zone_direction", "zone_lower", "zone_upper", "price_in_zone", "good_price_action", "action_type", "sl", "rr")])
    return made.select("window_id", "sample", "candles", "s.*").withColumn("completion", text)


def verified(made: DataFrame) -> DataFrame:
    """window_id, sample, leaf, and what a reader of the text finds: well_formed, semantic_passed, sl_ok (null without a trade), same (all fields read back as drawn)."""
    drawn = made.select("window_id", "sample", "leaf", F.struct(*_FIELDS[1:]).alias("drawn"), assembled(chart_text(F.col("candles")), F.col("completion")).alias("text"))
    read = with_semantics(parse_programs(drawn))
    trade = F.col("action_type").isin("BUY", "SELL")
    ok = sl_valid(F.col("action_type"), F.col("current_price_bin"), F.col("sl"), F.col("zone_lower"), F.col("zone_upper"), *DISTANCE)
    same = F.forall(F.array(*[F.col(n).eqNullSafe(F.col(f"drawn.{n}")) for n in _FIELDS[1:]]), lambda x: x)
    return read.select("window_id", "sample", "leaf", "well_formed", "semantic_passed", F.when(trade, ok).alias("sl_ok"), same.alias("same"))
