"""Semantic rules of a decision, as columns over its parsed fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.schema import SEMANTIC_PENALTY, TOUCH_LOOKBACK


def touches(candles: Column, lower: Column, upper: Column, lookback: int = TOUCH_LOOKBACK) -> Column:
    """Does one of the last candles overlap the band?"""
    last = F.slice(candles, F.greatest(F.size(candles) - (lookback - 1), F.lit(1)), lookback)
    return F.exists(last, lambda c: (c["l"] <= upper) & (c["h"] >= lower))


def violations(min_width: int = 5, max_width: int = 20, field: Callable[[str], Column] = F.col) -> Column:
    """Rule names in order: guard alone where a needed part is missing, else trend_zone, side, width, price_in_zone, action. field: where a program's parts are found."""
    trend, price, action, candles = field("trend"), field("current_price_bin"), field("action_type"), field("candles")
    side, lo, hi = field("zone_direction"), field("zone_lower"), field("zone_upper")
    claimed = F.coalesce(field("price_in_zone"), F.lit(False))
    zone = side.isNotNull()
    guard = candles.isNull() | (F.size(candles) <= 0) | trend.isNull() | price.isNull() | action.isNull()
    trend_zone = ((trend == "UP") & ~F.coalesce(side == "support", F.lit(False))) | ((trend == "DOWN") & ~F.coalesce(side == "resistance", F.lit(False)))
    wrong_side = zone & F.when(side == "support", lo > price).otherwise(hi < price)
    width = zone & ~(hi - lo).between(min_width, max_width)
    inside = price.between(lo, hi) | touches(candles, lo, hi)
    in_zone = F.when(zone, inside != claimed).otherwise(claimed)
    # without a zone only RANGE with another action than HOLD breaks the rule; the other trends already broke the first
    wrong_action = (
        F.when(~zone, (trend == "RANGE") & (action != "HOLD"))
        .when(side == "support", F.when(claimed, ~action.isin("BUY", "CANCEL_BUY")).otherwise(action != "WAIT_BUY"))
        .otherwise(F.when(claimed, ~action.isin("SELL", "CANCEL_SELL")).otherwise(action != "WAIT_SELL"))
    )
    named = [("trend_zone", trend_zone), ("side", wrong_side), ("width", width), ("price_in_zone", in_zone), ("action", wrong_action)]
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in named]), lambda x: x.isNotNull())
    return F.when(guard, F.array(F.lit("guard"))).otherwise(found)


def with_semantics(programs: DataFrame, min_width: int = 5, max_width: int = 20) -> DataFrame:
    """violations, semantic_passed, semantic_score."""
    v = F.col("violations")
    score = F.when(F.array_contains(v, "guard"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.lit(SEMANTIC_PENALTY) * F.size(v)))
    return programs.withColumn("violations", violations(min_width, max_width)).withColumns({"semantic_passed": F.size(v) == 0, "semantic_score": score})
