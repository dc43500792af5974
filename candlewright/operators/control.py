"""Feedback controllers as folds: one pass over a group's ordered steps with aggregate(), no Python per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = "struct<ema:double,buff:double,prev_error:double>"
_TRACE = "array<struct<step:bigint,ema:double,buff:double,prev_error:double>>"


def clip(x: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.greatest(low, F.least(x, high))


def pd_step(state: Column, rate: Column, target: Column, low: Column, high: Column, alpha: Column, kp: Column, kd: Column, step_max: Column) -> Column:
    """The state after a step's rate: mean, error to the target, bounded move of the buff. A null rate (nothing counted) changes nothing."""
    ema = (1 - alpha) * rate + alpha * state["ema"]
    error = target - ema
    buff = clip(state["buff"] + clip(kp * error + kd * (error - state["prev_error"]), -step_max, step_max), low, high)
    return F.when(rate.isNull(), state.cast(_STATE)).otherwise(F.struct(ema.alias("ema"), buff.alias("buff"), error.alias("prev_error")).cast(_STATE))


def entropy_step(state: Column, reading: Column, floor: float, alpha: float, kp: float, kd: float, step_max: float, cap: float) -> Column:
    """One-sided: below the floor the bonus moves like a buff; at or above it the bonus goes down by at most step_max."""
    ema = (1 - alpha) * reading + alpha * state["ema"]
    error = F.greatest(F.lit(0.0), floor - ema)
    up = clip(state["buff"] + clip(kp * error + kd * (error - state["prev_error"]), -step_max, step_max), 0.0, cap)
    down = F.greatest(F.lit(0.0), state["buff"] - F.least(state["buff"], F.lit(step_max)))
    return F.when(reading.isNull(), state.cast(_STATE)).otherwise(F.struct(ema.alias("ema"), F.when(error > 0, up).otherwise(down).alias("buff"), error.alias("prev_error")).cast(_STATE))


def _fold(steps: DataFrame, by: list[str], start: Column, move) -> DataFrame:
    """by, step, ema, buff, prev_error after each step. One row per step and group is gathered: steps are optimiser steps."""
    listed = steps.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("step", "reading"))).alias("all"), start.alias("start"))

    def step(acc: Column, x: Column) -> Column:
        state = move(acc["s"], x["reading"])
        return F.struct(state.alias("s"), F.concat(acc["out"], F.array(F.struct(x["step"].cast("bigint").alias("step"), state["ema"].alias("ema"), state["buff"].alias("buff"), state["prev_error"].alias("prev_error")))).cast(_TRACE).alias("out"))

    first = F.struct(F.col("start").cast(_STATE).alias("s"), F.array().cast(_TRACE).alias("out"))
    return listed.select(*by, F.inline(F.aggregate("all", first, step, lambda acc: acc["out"])))


def pd_trace(rates: DataFrame, settings: DataFrame, by: list[str], alpha: float | None = None, kp: float | None = None, kd: float | None = None, step_max: float | None = None) -> DataFrame:
    """rates: by, step, reading. settings: by, target, low, high, init and the gains that are not given here (alpha, kp, kd, step_max); a small table.

    Groups that are never counted in a step have rate 0 there.
    """
    gains = {"alpha": alpha, "kp": kp, "kd": kd, "step_max": step_max}
    own = [k for k, v in gains.items() if v is None]
    met = rates.join(F.broadcast(settings), by)
    start = F.struct(F.first("target").alias("ema"), F.first("init").alias("buff"), F.lit(0.0).alias("prev_error"))
    fixed = ["target", "low", "high", *own]
    gain = [F.col(k) if v is None else F.lit(float(v)) for k, v in gains.items()]
    return _fold(met, [*by, *fixed], start, lambda s, r: pd_step(s, r, F.col("target"), F.col("low"), F.col("high"), *gain)).drop(*fixed)


def entropy_trace(readings: DataFrame, floor: float, alpha: float, kp: float, kd: float, step_max: float, cap: float) -> DataFrame:
    """readings: step, reading (a step's mean). The state starts at the floor without a bonus."""
    start = F.struct(F.lit(floor).alias("ema"), F.lit(0.0).alias("buff"), F.lit(0.0).alias("prev_error"))
    return _fold(readings.withColumn("one", F.lit(1)), ["one"], start, lambda s, r: entropy_step(s, r, floor, alpha, kp, kd, step_max, cap)).drop("one")


def step_rates(records: DataFrame, group: Column, groups: DataFrame, where: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """by, grp, step, reading: each group's share of a step's counted rows, null in a step without any. groups: by, grp; a handful.

    The records are read once: counts by key first, and from these a step's total and the rates of all its groups.
    """
    counted = records.groupBy(*by, "step", F.when(where, group).alias("grp")).agg(F.count("*").alias("n"))
    known = F.col("grp").isNotNull()
    steps = counted.groupBy(*by, "step").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("total"), F.map_from_entries(F.collect_list(F.when(known, F.struct("grp", "n")))).alias("counts")
    )
    small = F.broadcast(groups.select(*by, "grp"))
    grid = steps.join(small, list(by)) if by else steps.join(small, how="cross")  # steps by a handful of groups
    rate = F.coalesce(F.try_element_at("counts", F.col("grp")), F.lit(0)) / F.col("total")
    return grid.select(*by, "grp", "step", F.when(F.col("total") > 0, rate).alias("reading"))


STATE = "namespace string, grp string, ema double, buff double, prev_error double"


def seeded(settings: DataFrame) -> DataFrame:
    """STATE before the first step of a round: the mean at its target, the buff at its start, no error."""
    return settings.select("namespace", "grp", F.col("target").alias("ema"), F.col("init").alias("buff"), F.lit(0.0).alias("prev_error"))


def advanced(state: DataFrame, rates: DataFrame, settings: DataFrame) -> DataFrame:
    """STATE after one step. rates: namespace, grp, reading; a group without a row or with a null reading stays."""
    met = state.join(settings.drop("init"), ["namespace", "grp"]).join(rates.select("namespace", "grp", "reading"), ["namespace", "grp"], "left")
    after = pd_step(F.struct("ema", "buff", "prev_error"), F.col("reading"), *[F.col(k) for k in ("target", "low", "high", "alpha", "kp", "kd", "step_max")])
    return met.select("namespace", "grp", after.alias("s")).select("namespace", "grp", "s.ema", "s.buff", "s.prev_error")


def with_buff(rows: DataFrame, key: Column, state: DataFrame, name: str = "buff") -> DataFrame:
    """Rows with the buff of their key, 0 where the key is null or the state has none. state: grp, buff; one row a group, so it is broadcast."""
    few = F.broadcast(state.select(F.col("grp").alias("__grp"), F.col("buff").alias("__buff")))
    met = rows.withColumn("__key", key).join(few, F.col("__key") == F.col("__grp"), "left")
    return met.withColumn(name, F.coalesce("__buff", F.lit(0.0))).drop("__key", "__grp", "__buff")
