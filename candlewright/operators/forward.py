"""Outcomes of a decision on the candles that follow, in closed form: no loop and no Python over candles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewright.functions.text import let
from candlewright.schema import BIN_MAX, FUTURE_CANDLES

INFINITE = 1 << 30
BEST_CAP = 9.0


def _first(candles: Column, hit) -> Column:
    """0-based index of the first candle for which ``hit`` holds, INFINITE if there is none."""
    at = F.array_position(F.transform(candles, lambda c: hit(c)), True)
    return F.when(at > 0, at - 1).otherwise(F.lit(INFINITE))


def horizon(future: Column) -> Column:
    return F.slice(future, 1, FUTURE_CANDLES)


def sl_valid(action: Column, entry: Column, sl: Column, lower: Column, upper: Column, low: int = 5, high: int = 10) -> Column:
    near = F.abs(entry - sl).between(low, high)
    return F.when(action == "BUY", near & (sl < lower)).when(action == "SELL", near & (sl > upper)).otherwise(F.lit(False))


def target_bin(entry: Column, sl: Column, rr: Column, long: Column) -> Column:
    move = rr * F.abs(entry - sl)
    at = F.rint(F.when(long, entry + move).otherwise(entry - move)).cast("int")
    return F.when(at.between(0, BIN_MAX), at)


def _result(status: str, r: Column, at: Column | None = None) -> Column:
    at = F.lit(None) if at is None else at
    return F.struct(F.lit(status).alias("status"), r.cast("double").alias("r_multiple"), at.cast("int").alias("exit_index"))


def _stop(f: Column, sl: Column, long: Column) -> Column:
    return _first(f, lambda c: F.when(long, c["l"] <= sl).otherwise(c["h"] >= sl))


def _reach(entry: Column, c: Column, long: Column) -> Column:
    return F.when(long, c["h"] - entry).otherwise(entry - c["l"])


def _walk(entry: Column, sl: Column, future: Column, long: Column, body) -> Column:
    """body of a struct that is computed once: f (the candles), risk, stop, pre (candles before the stop's) and best (their farthest reach)."""

    def with_stop(x: Column) -> Column:
        pre = F.slice(x["f"], F.lit(1), F.least(x["stop"], F.size(x["f"])).cast("int"))
        return let(F.struct(x["f"].alias("f"), x["stop"].alias("stop"), pre.alias("pre")), with_pre)

    def with_pre(x: Column) -> Column:
        best = F.array_max(F.transform(x["pre"], lambda c: _reach(entry, c, long)))
        return let(F.struct(x["f"].alias("f"), x["stop"].alias("stop"), x["pre"].alias("pre"), best.alias("best"), F.abs(entry - sl).alias("risk")), body)

    return let(horizon(future), lambda f: let(F.struct(f.alias("f"), _stop(f, sl, long).alias("stop")), with_stop))


def binary_outcome(entry: Column, sl: Column, target: Column, future: Column, long: Column) -> Column:
    """struct<status, r_multiple, exit_index>: which of stop and target is met first; the stop, where one candle meets both."""

    def judge(x: Column) -> Column:
        stop, gain, risk = x["stop"], x["gain"], F.abs(entry - sl)
        return (
            F.when(risk == 0, _result("INVALID_SETUP", F.lit(0.0)))
            .when((stop < INFINITE) & (stop <= gain), _result("LOSS", F.lit(-1.0), stop))
            .when(gain < INFINITE, _result("WIN", F.try_divide(F.abs(target - entry), risk), gain))
            .otherwise(_result("TIMEOUT", F.lit(0.0)))
        )

    def met(f: Column) -> Column:
        gain = _first(f, lambda c: F.when(long, c["h"] >= target).otherwise(c["l"] <= target))
        return let(F.struct(_stop(f, sl, long).alias("stop"), gain.alias("gain")), judge)

    return let(horizon(future), met)


def scale_out(entry: Column, sl: Column, rr: Column, future: Column, long: Column) -> Column:
    """struct<status, r_multiple, exit_index>: rr equal parts leave at 1R..rrR, the stop stays, the rest is marked to the last close.

    With n parts filled before the stop they earn n(n+1)/(2 rr) R. All filled: WIN. A stop: LOSS, which can still have R >= 0.
    """

    def judge(x: Column) -> Column:
        n, risk = x["n"], x["risk"]
        earned = n * (n + 1) / (2.0 * rr)
        left = (rr - n) / rr.cast("double")
        last = F.coalesce(F.try_element_at(x["f"], F.lit(-1))["c"], entry)
        mark = F.try_divide(F.when(long, last - entry).otherwise(entry - last), risk)
        won = _first(x["pre"], lambda c: _reach(entry, c, long) >= rr * risk)
        bad = (risk == 0) | (rr < 1) | target_bin(entry, sl, rr, long).isNull()
        return (
            F.when(bad, _result("INVALID_SETUP", F.lit(0.0)))
            .when(n == rr, _result("WIN", earned, won))
            .when(x["stop"] < INFINITE, _result("LOSS", earned - left, x["stop"]))
            .otherwise(_result("TIMEOUT", earned + left * mark))
        )

    def filled(x: Column) -> Column:
        n = F.greatest(F.lit(0), F.least(rr, F.floor(F.try_divide(F.coalesce(x["best"], F.lit(-INFINITE)), x["risk"])))).cast("int")
        return let(F.struct(*[x[k].alias(k) for k in ("f", "stop", "pre", "risk")], n.alias("n")), judge)

    return _walk(entry, sl, future, long, filled)


def best_excursion(entry: Column, sl: Column, future: Column, long: Column, cap: float = BEST_CAP) -> Column:
    """The most that price went the right way before the stop's candle, in R, from 0 to cap."""

    def judge(x: Column) -> Column:
        r = F.coalesce(F.try_divide(x["best"], x["risk"]), F.lit(0.0))
        return F.when(x["risk"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(cap), F.greatest(F.lit(0.0), r)))

    return _walk(entry, sl, future, long, judge)


def zone_probe(direction: Column, lower: Column, upper: Column, future: Column) -> Column:
    """Best excursion from the zone's near edge with a stop one bin beyond its far edge."""
    long = direction == "support"
    edges = F.struct(F.when(long, upper).otherwise(lower).alias("entry"), F.when(long, lower - 1).otherwise(upper + 1).alias("sl"))
    return F.when(direction.isNotNull(), let(edges, lambda e: best_excursion(e["entry"], e["sl"], future, long)))


def outcome(future: Column, low: int = 5, high: int = 10) -> Column:
    """struct<valid, status, r_multiple, sl_valid> of a parsed decision; sl_valid is null where no stop was judged."""
    action, entry, sl, rr = F.col("action_type"), F.col("current_price_bin"), F.col("sl"), F.col("rr")
    zone = F.col("zone_direction").isNotNull()
    trade = action.isin("BUY", "SELL")

    def told(valid: Column, ran: Column | None = None, ok: Column | None = None) -> Column:
        none = F.lit(None)
        status, r = (none, none) if ran is None else (ran["status"], ran["r_multiple"])
        return F.struct(valid.alias("valid"), status.cast("string").alias("status"), r.cast("double").alias("r_multiple"), (none if ok is None else ok).cast("boolean").alias("sl_valid"))

    def traded(ran: Column) -> Column:
        ok = sl_valid(action, entry, sl, F.col("zone_lower"), F.col("zone_upper"), low, high)
        return F.when(ran["status"] == "INVALID_SETUP", told(F.lit(False), ok=ok)).otherwise(told(F.lit(True), ran, ok))

    return (
        F.when(action.isin("WAIT_BUY", "WAIT_SELL", "HOLD"), told(F.lit(True)))
        .when(trade & (entry.isNull() | sl.isNull() | rr.isNull() | ~zone), told(F.lit(False)))
        .when(trade, let(scale_out(entry, sl, rr, future, action == "BUY"), traded))
        .when(action.isin("CANCEL_BUY", "CANCEL_SELL"), told(zone))
        .otherwise(told(F.lit(False)))
    )
