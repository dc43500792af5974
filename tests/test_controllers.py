"""Controllers as keyed state: equal to the batch folds; stopped, gone on with, restored, snapshot."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from candlewright.operators import control
from candlewright.plans import presets
from candlewright.streaming import controllers

E = presets.ROUND1_V2.entropy
ENTROPY = (E.floor, E.gain.alpha, E.gain.kp, E.gain.kd, E.gain.step_max, E.cap)


class Feed:
    """Files that a stream picks up in order."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0

    def add(self, rows):
        place = self.folder / f"p={self.n}"
        self.spark.createDataFrame(rows, controllers.RECORDS).repartition(2).write.parquet(str(place))
        for f in place.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + self.n * 100,) * 2)
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(controllers.RECORDS).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True).parquet(str(self.folder))


@pytest.fixture(scope="module")
def steps():
    rng = random.Random(6)
    settings = presets.settings(presets.ROUND1_V2)
    groups = {s: [g for n, g, *_ in settings if n == s] for s in {x[0] for x in settings}}
    out = []
    for k in range(8):
        rows = [("r", k, s, rng.choice([*gs, gs[0], None]), None) for s, gs in groups.items() for _ in range(rng.randint(0, 9) if k != 3 else 0)]
        rows += [("r", k, controllers.ENTROPY, None, rng.random() * E.floor * 1.5) for _ in range(rng.randint(0, 3))] + [("r", k, "action", None, None)]
        rng.shuffle(rows)
        out.append(rows)
    return settings, out


def batch_trace(spark, settings, rows):
    """What the folds over all steps give."""
    fixed = spark.createDataFrame(settings, presets.SETTINGS)
    records = spark.createDataFrame(rows, controllers.RECORDS)
    have = records.select("step").distinct()
    counted = control.step_rates(records.where(F.col("namespace") != controllers.ENTROPY), F.col("grp"), fixed, F.col("grp").isNotNull(), ("namespace",))
    grid = have.join(fixed.select("namespace", "grp"), how="cross").join(counted, ["namespace", "grp", "step"], "left")
    buffs = control.pd_trace(grid, fixed, ["namespace", "grp"])
    means = records.where(F.col("namespace") == controllers.ENTROPY).groupBy("step").agg(F.avg("reading").alias("reading"))
    bonus = control.entropy_trace(have.join(means, "step", "left"), *ENTROPY).select(F.lit("entropy").alias("namespace"), F.lit("rr").alias("grp"), "step", "ema", "buff", "prev_error")
    return {(r.namespace, r.grp, r.step): (r.ema, r.buff, r.prev_error) for r in buffs.unionByName(bonus).collect()}


def close(got, want):
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-12), k


def traced(spark, folder, round_id="r"):
    rows = controllers.trace(spark, folder).where(F.col("round_id") == round_id).collect()
    assert len(rows) == len({(r.namespace, r.grp, r.step) for r in rows})
    return {(r.namespace, r.grp, r.step): (r.ema, r.buff, r.prev_error) for r in rows}


def test_stop_go_on_and_restore(spark, tmp_path, steps):
    settings, rows = steps
    feed, folder = Feed(spark, tmp_path / "in"), str(tmp_path / "out")
    for part in rows[:4]:
        feed.add(part)
    controllers.run(feed.stream(), settings, folder, ENTROPY)
    want = batch_trace(spark, settings, [r for part in rows[:3] for r in part])
    close(traced(spark, folder), want)  # step 3 is open
    held = {(r.namespace, r.grp): (r.ema, r.buff, r.prev_error) for r in controllers.snapshot(spark, folder).collect()}
    close(held, {k[:2]: v for k, v in want.items() if k[2] == 2})

    for part in rows[4:]:
        feed.add(part)
    feed.add([("r", 7, controllers.BOUNDARY, None, None), ("r", 2, "action", "BUY", None), ("new", 0, "action", "BUY", None), ("new", 1, "action", "SELL", None)])
    controllers.run(feed.stream(), settings, folder, ENTROPY)  # the same folder: goes on
    want = batch_trace(spark, settings, [r for part in rows for r in part])
    close(traced(spark, folder), want)  # the late record of step 2 changed nothing
    fresh = traced(spark, folder, "new")
    close(fresh, batch_trace(spark, settings, [("new", 0, "action", "BUY", None)]))

    # a snapshot starts the round elsewhere: the same trace from there on
    early = controllers.snapshot(spark, folder, 1).where("round_id = 'r'")
    begun = {(r.namespace, r.grp): (r.ema, r.buff, r.prev_error) for r in early.collect()}
    closed = max(k[2] for k, v in want.items() if begun[k[:2]] == pytest.approx(v, abs=1e-12) and k[0] == "action" and k[1] == "BUY")
    other, there = Feed(spark, tmp_path / "in2"), str(tmp_path / "out2")
    for part in rows[closed + 1 :]:
        other.add(part)
    other.add([("r", 7, controllers.BOUNDARY, None, None)])
    controllers.run(other.stream(), settings, there, ENTROPY, early)
    close(traced(spark, there), {k: v for k, v in want.items() if k[2] > closed})


def test_partial_counts(spark):
    rows = [("r", 0, "action", "BUY", None)] * 5 + [("r", 0, "action", None, None)] * 2 + [("r", 1, "entropy", None, 0.5), ("r", 1, "entropy", None, 1.0), (None, 1, "action", "BUY", None)]
    got = controllers.partial_counts(spark.createDataFrame(rows, controllers.RECORDS).coalesce(1)).collect()
    assert sorted((r.step, r.namespace, str(r.grp), r.n, r.total, r.given) for r in got) == [(0, "action", "BUY", 5, 0.0, 0), (0, "action", "None", 2, 0.0, 0), (1, "entropy", "None", 2, 1.5, 2)]


def test_numbers_equal_columns(spark):
    rng = random.Random(1)
    rows = [tuple(rng.uniform(-1, 1) for _ in range(4)) for _ in range(50)]
    frame = spark.createDataFrame(rows, "ema double, buff double, prev_error double, r double")
    fixed = (0.3, -0.5, 0.5, 0.9, 0.2, 0.1, 0.05)
    s = F.struct("ema", "buff", "prev_error")
    out = frame.select("*", control.pd_step(s, F.col("r"), *map(F.lit, fixed)).alias("a"), control.entropy_step(s, F.col("r"), 0.4, 0.9, 0.2, 0.1, 0.05, 0.6).alias("b")).collect()
    for x in out:
        assert tuple(x.a) == pytest.approx(controllers.moved((x.ema, x.buff, x.prev_error), x.r, *fixed))
        if x.buff >= 0:
            assert tuple(x.b) == pytest.approx(controllers.moved_bonus((x.ema, x.buff, x.prev_error), x.r, 0.4, 0.9, 0.2, 0.1, 0.05, 0.6))
