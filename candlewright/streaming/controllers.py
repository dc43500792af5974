"""A round's controllers as keyed state of one stream.

The key is the round. A record is counted under its step; a step closes when a record of a later one comes, or by a row that marks its end.
Then the round's buffs move by what the step has counted, namespace by namespace, the entropy bonus after them, and the step is the last one closed:
its counts go, and records of it that come later change nothing. State lives in the state store, so a query that was stopped goes on where it was,
and ``snapshot`` reads it there. A new round is a new key: it begins with the state given for it, else with its settings.

Records are counted by task before they are dealt out by round: what meets in a round's task is a row for each task, step and group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from candlewright.plans.ship import ship

RECORDS = "round_id string, step long, namespace string, grp string, reading double"
TRACE = "round_id string, step long, namespace string, grp string, reading double, ema double, buff double, prev_error double"
START = "round_id string, namespace string, grp string, ema double, buff double, prev_error double"
#: Namespaces beside those of the buffs: readings of rr's entropy, and rows that mark the end of their step.
ENTROPY, BOUNDARY = "entropy", "boundary"
_PARTIAL = "round_id string, step long, namespace string, grp string, n long, total double, given long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _clip(x: float, low: float, high: float) -> float:
    return max(low, min(high, x))


def moved(state: tuple[float, float, float], rate: float, target: float, low: float, high: float, alpha: float, kp: float, kd: float, step_max: float) -> tuple[float, float, float]:
    """(ema, buff, error) after a step's rate; ``operators.control.pd_step`` as numbers."""
    ema = (1 - alpha) * rate + alpha * state[0]
    error = target - ema
    return ema, _clip(state[1] + _clip(kp * error + kd * (error - state[2]), -step_max, step_max), low, high), error


def moved_bonus(state: tuple[float, float, float], reading: float, floor: float, alpha: float, kp: float, kd: float, step_max: float, cap: float) -> tuple[float, float, float]:
    """(ema, bonus, error) after a step's mean entropy; ``operators.control.entropy_step`` as numbers."""
    ema = (1 - alpha) * reading + alpha * state[0]
    error = max(0.0, floor - ema)
    if error > 0:
        return ema, _clip(state[1] + _clip(kp * error + kd * (error - state[2]), -step_max, step_max), 0.0, cap), error
    return ema, max(0.0, state[1] - step_max), error


class Rounds(StatefulProcessor):
    """settings: rows of plans.presets.SETTINGS; entropy: floor, alpha, kp, kd, step_max and cap, or None where a round has no such controller."""

    def __init__(self, settings: list[tuple], entropy: tuple[float, ...] | None):
        self.settings = {(s[0], s[1]): tuple(map(float, (*s[2:5], *s[6:]))) for s in settings}
        self.start = {(s[0], s[1]): (float(s[2]), float(s[5]), 0.0) for s in settings}
        self.entropy = entropy
        if entropy:
            self.start[ENTROPY, "rr"] = (entropy[0], 0.0, 0.0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("state", "namespace string, grp string", "ema double, buff double, prev_error double")
        self.counts = handle.getMapState("counts", "namespace string, grp string", "n long, total double, given long")
        self.steps = handle.getValueState("steps", "open long, closed long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802
        for r in initialState.fillna({"prev_error": 0.0}).itertuples(index=False):
            self.state.updateValue((r.namespace, r.grp), (float(r.ema), float(r.buff), float(r.prev_error)))

    def _closed(self, round_id: str, step: int, counts: dict, state: dict) -> Iterator[tuple]:
        for space in dict.fromkeys(s for s, _ in self.settings):
            total = sum(v[0] for (s, g), v in counts.items() if s == space and g is not None)
            for s, g in self.settings:
                if s == space:
                    rate = counts.get((s, g), (0,))[0] / total if total else None
                    if total:
                        state[s, g] = moved(state[s, g], rate, *self.settings[s, g])
                    yield round_id, step, s, g, rate, *state[s, g]
        if self.entropy:
            seen = [v for (s, _), v in counts.items() if s == ENTROPY]
            given = sum(v[2] for v in seen)
            mean = sum(v[1] for v in seen) / given if given else None
            if given:
                state[ENTROPY, "rr"] = moved_bonus(state[ENTROPY, "rr"], mean, *self.entropy)
            yield round_id, step, ENTROPY, "rr", mean, *state[ENTROPY, "rr"]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        state = self.start | {k: v for k, v in self.state.iterator()}
        counts = {k: v for k, v in self.counts.iterator()}
        open_, closed = self.steps.get() or (None, None)
        out: list[tuple] = []
        told = pd.concat(rows, ignore_index=True)
        for step, space, grp, n, total, given in told[["step", "namespace", "grp", "n", "total", "given"]].assign(last=told["namespace"] == BOUNDARY).sort_values(["step", "last"], kind="stable").drop(columns="last").itertuples(index=False, name=None):
            step, grp = int(step), None if pd.isna(grp) else grp
            if closed is not None and step <= closed:
                continue
            if open_ is not None and step > open_:
                out += self._closed(key[0], open_, counts, state)
                counts, closed = {}, open_
            open_ = step
            if space == BOUNDARY:
                out += self._closed(key[0], open_, counts, state)
                counts, closed, open_ = {}, open_, None
            else:
                was = counts.get((space, grp), (0, 0.0, 0))
                counts[space, grp] = (was[0] + int(n), was[1] + float(total), was[2] + int(given))
        self.steps.update((open_, closed))
        self.counts.clear()
        for k, v in counts.items():
            self.counts.updateValue(k, v)
        for k, v in state.items():
            self.state.updateValue(k, v)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in TRACE.split(", ")]).astype({"step": "int64", "reading": "float64"})

    def close(self) -> None:
        pass


def partial_counts(records: DataFrame) -> DataFrame:
    """RECORDS counted within each task's batches; a null grp isn't counted, but its step is seen."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            by = part.groupby(["round_id", "step", "namespace", "grp"], dropna=False)["reading"]
            told = by.agg(n="size", total="sum", given="count").reset_index()
            told["grp"] = told["grp"].astype(object).where(told["grp"].notna(), None)
            yield told.astype({"round_id": object, "namespace": object, "step": "int64", "n": "int64", "total": "float64", "given": "int64"})[[x.split()[0] for x in _PARTIAL.split(", ")]]

    names = [x.split()[0] for x in RECORDS.split(", ")]
    return records.select(*[F.col(n).cast(x.split()[1]) for n, x in zip(names, RECORDS.split(", "), strict=True)]).where("round_id IS NOT NULL AND step IS NOT NULL AND namespace IS NOT NULL").mapInPandas(step, _PARTIAL)


def traced(records: DataFrame, settings: list[tuple], entropy: tuple[float, ...] | None = None, start: DataFrame | None = None) -> DataFrame:
    """The stream of TRACE rows: every group's state after each closed step. start: START, a row for each group of the rounds that go on from elsewhere."""
    ship(records.sparkSession)
    first = None if start is None else start.selectExpr(*[f"CAST({x.split()[0]} AS {x.split()[1]}) AS {x.split()[0]}" for x in START.split(", ")]).groupBy("round_id")
    return partial_counts(records).groupBy("round_id").transformWithStateInPandas(Rounds(settings, entropy), TRACE, "Append", "None", first)


def run(records: DataFrame, settings: list[tuple], folder: str, entropy: tuple[float, ...] | None = None, start: DataFrame | None = None) -> StreamingQuery:
    """Follows what is there now and stops; called again, goes on. Rows go to ``folder``/trace, state to ``folder``/checkpoint. ``start`` counts when the state store is new."""
    conf, name = records.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, _ROCKS)  # the only one that holds several states for a key
    try:
        out = traced(records, settings, entropy, start).writeStream.outputMode("append").format("parquet")
        query = out.option("path", f"{folder}/trace").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        conf.set(name, before)
    return query


def trace(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(TRACE).parquet(f"{folder}/trace")


def snapshot(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """START as the state store has it after the last batch, or after ``batch``; it can start a round elsewhere."""
    read = spark.read.format("statestore").option("stateVarName", "state")
    read = read if batch is None else read.option("batchId", batch)
    rows = read.load(f"{folder}/checkpoint")
    return rows.selectExpr("key.round_id AS round_id", "user_map_key.namespace AS namespace", "user_map_key.grp AS grp", "user_map_value.ema AS ema", "user_map_value.buff AS buff", "user_map_value.prev_error AS prev_error")
