"""Renderings of decisions, and a name for a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewright.schema import DIGITS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row, however often the body uses it (a column's own text would be repeated at each use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digits(n: Column) -> Column:
    """A number as four digits with blanks between; null for null."""
    return F.when(n.isNotNull(), F.array_join(F.split(F.lpad(n.cast("string"), DIGITS, "0"), ""), " "))


def completion(trend: Column, price: Column, side: Column, lower: Column, upper: Column, in_zone: Column, good: Column, action: Column, sl: Column, rr: Column) -> Column:
    """A decision's text: think block, then action block; parts without a value are left out."""
    zone = F.when(side.isNotNull(), F.concat_ws(" ", F.concat(F.lit("<zone_"), side, F.lit(">")), digits(lower), F.lit(":"), digits(upper), F.concat(F.lit("</zone_"), side, F.lit(">"))))
    stop = F.when(sl.isNotNull(), F.concat_ws(" ", F.lit("SL:"), digits(sl)))
    return F.concat_ws(
        " ", F.lit("<think>"), F.concat(F.lit("<trend>"), trend, F.lit("</trend>")), F.lit("<current_price>"), digits(price), F.lit("</current_price>"), zone,
        F.when(in_zone, F.lit("<price_in_zone>")), F.when(good, F.lit("<good_price_action>")), F.lit("</think>"), F.lit("<action>"), action, stop,
        F.when(rr.isNotNull(), F.concat(F.lit("<RR_"), rr.cast("string"), F.lit(">"))), F.lit("</action>"),
    )
