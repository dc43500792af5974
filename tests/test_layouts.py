"""Sealed shards, incremental sums, the keyed order and bucketed tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from candlewright.operators import permute, reports
from candlewright.sources import bucketed, rollup, shards

SCHEMA = "passed boolean, trend string, action_type string, r_multiple double, rr int"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), f"step long, rank long, {SCHEMA}")


def row(step, rank, r=1.0, action="BUY", trend="UP", passed=True, rr=2):
    return step, rank, passed, trend, action, r, rr


def stood(frame):
    return sorted(map(repr, (tuple(r) for r in frame.collect())))


def test_shards(spark, tmp_path):
    log = str(tmp_path / "log")
    assert shards.read_shards(spark, log, "r1", schema=SCHEMA).count() == 0  # absent: no records
    first = records(spark, row(0, 0), row(0, 0), row(0, 1, None, None, None), row(1, 0, action='a"b\n\r c'))
    shards.append_shards(first, log, "r1")
    assert stood(shards.read_shards(spark, log, "r1", schema=SCHEMA)) == stood(first)
    shards.append_shards(first, log, "r1")  # the whole of it again counts once
    again = records(spark, row(0, 0, 5.0))
    shards.append_shards(again, log, "r1")  # one shard anew
    shards.append_shards(first, log, "other")
    shards.append_shards(records(spark), log, "r1")  # nothing
    want = stood(again.unionByName(first.where("not (step = 0 and rank = 0)")))
    assert stood(shards.read_shards(spark, log, "r1", schema=SCHEMA)) == want
    assert stood(shards.read_shards(spark, log, "r1", after=0, schema=SCHEMA)) == stood(first.where("step > 0"))
    with pytest.raises(Exception, match="no rank"):
        shards.append_shards(first.withColumn("rank", F.lit(None).cast("long")), log, "r1")
    with pytest.raises(ValueError, match="not a name"):
        shards.append_shards(first, log, "../r1")
    assert stood(shards.read_shards(spark, log, "r1", schema=SCHEMA)) == want


@pytest.mark.parametrize("harm, fault", [("cut", "changed"), ("more", "changed"), ("gone", "missing"), ("unsealed", "unsealed")])
def test_faults(spark, tmp_path, harm, fault):
    log = str(tmp_path / "log")
    shards.append_shards(records(spark, row(0, 0), row(0, 0, 7.0), row(1, 1)).coalesce(1), log, "r1")
    (file,) = (tmp_path / "log").glob("lines/round_id=r1/attempt=*/step=0/rank=0/*.txt")
    for check in file.parent.glob(".*.crc"):
        check.unlink()
    text = file.read_text()
    if harm == "cut":
        file.write_text(text[:-9])
    elif harm == "more":
        file.write_text(text + text)
    elif harm == "gone":
        file.unlink()
    else:
        (file.parents[2] / "step=0" / "rank=4").mkdir()
        (file.parents[2] / "step=0" / "rank=4" / "part-0.txt").write_text(text)
    rank = 4 if harm == "unsealed" else 0
    assert [tuple(r) for r in shards.faults(spark, log, "r1").collect()] == [(0, rank, fault)]
    with pytest.raises(ValueError, match=f"1 shards of r1 .*step 0 rank {rank} {fault}"):
        shards.read_shards(spark, log, "r1", schema=SCHEMA)
    assert shards.read_shards(spark, log, "r1", after=0, schema=SCHEMA).count() == 1  # other steps can be read


def test_rollup(spark, tmp_path):
    log, sums = str(tmp_path / "log"), str(tmp_path / "sums")
    passed = F.col("passed")

    def same(held, since=None):
        got = rollup.partials(spark, sums, "r1", since)
        held = held if since is None else held.where(F.col("step") > since)
        keys = ["trend", "action_type", "n", "avg_r", "win_rate", "avg_rr", "share"]
        assert stood(rollup.trend_action(got).select(keys)) == stood(reports.trend_action(held, passed).select(keys))
        assert stood(rollup.group_rollup(got)) == stood(reports.group_rollup(held, passed))
        assert stood(rollup.counts(got)) == stood(reports.count_by(held, F.col("action_type"), passed))

    one = records(spark, row(0, 0), row(0, 1, -1.0), row(2, 0, None, "HOLD", "RANGE", rr=None), row(2, 0, 3.0, "SELL", "DOWN"), row(2, 1, action="WAIT_BUY", passed=False))
    shards.append_shards(one, log, "r1")
    rollup.refresh(spark, log, sums, "r1", passed, SCHEMA)
    same(one)
    assert rollup.stale_steps(spark, log, sums, "r1").count() == 0
    files = sorted((tmp_path / "sums").rglob("*.parquet"))
    rollup.refresh(spark, log, sums, "r1", passed, SCHEMA)  # nothing to do: the same files stay
    assert sorted((tmp_path / "sums").rglob("*.parquet")) == files
    # a late step, and a shard of step 2 written again: nothing of rank 0 passes now
    shards.append_shards(records(spark, row(1, 0, 4.0, "CANCEL_BUY"), row(2, 0, passed=False)), log, "r1")
    assert {r.step for r in rollup.stale_steps(spark, log, sums, "r1").collect()} == {1, 2}
    rollup.refresh(spark, log, sums, "r1", passed, SCHEMA)
    two = one.where("step = 0 or rank = 1").unionByName(records(spark, row(1, 0, 4.0, "CANCEL_BUY"), row(2, 0, passed=False)))
    same(two)
    same(two, since=0)
    same(two, since=1)  # no row is left that passed
    kept = set(files) & set((tmp_path / "sums").rglob("*.parquet"))
    assert {f.parent.name for f in kept} == {"step=0"}
    assert rollup.partials(spark, sums, "r2").count() == 0
    # a step whose lines have been lost is not summed in silence; what was summed stays
    shards.append_shards(records(spark, row(3, 0)), log, "r1")
    for f in (tmp_path / "log").glob("lines/round_id=r1/attempt=*/step=3/rank=0/*.txt"):
        f.unlink()
    with pytest.raises(ValueError, match="step 3 rank 0 missing"):
        rollup.refresh(spark, log, sums, "r1", passed, SCHEMA)
    same(two)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 97, 1000, 4099])
def test_bijection(spark, n):
    orders = []
    for seed in (1, 2):
        got = [r.p for r in spark.range(n).select(permute.place(F.col("id"), n, seed).alias("p")).collect()]
        assert sorted(got) == list(range(n))
        orders.append(got)
    if n > 90:
        assert orders[0] != orders[1] and sum(a == b for a, b in enumerate(orders[0])) < 12  # about one stays where it was
        halves = sum(p < n // 2 for p in orders[0][: n // 2]) / (n // 2)
        assert abs(halves - 0.5) < 0.2


def test_bijection_range(spark):
    assert spark.sql("SELECT CAST(NULL AS LONG) AS id").select(permute.place(F.col("id"), 5, 1)).first()[0] is None
    for bad in (-1, 5):
        with pytest.raises(Exception, match="no row number"):
            spark.range(1).select(permute.place(F.lit(bad), 5, 1)).collect()


def test_epochs(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(1003).selectExpr("id", "concat('t', id) AS text").repartition(5).write.parquet(source)
    numbered, n = permute.numbered_files(spark, source)
    assert n == 1003 and sorted(r[0] for r in numbered.select("__row").collect()) == list(range(n))
    for epoch in (0, 1):
        permute.write_epoch(permute.dealt(numbered, "__row", n, 42, epoch, 7).drop("__row"), path, epoch, 7)
    whole = [(r.shard, r.offset, r.id) for s, rows in permute.pull(spark, path, 0) for r in rows.collect()]
    assert [x[:2] for x in whole] == [(p // 144, p % 144) for p in range(n)] and sorted(x[2] for x in whole) == list(range(n))
    other = [(r.shard, r.offset, r.id) for s, rows in permute.pull(spark, path, 1) for r in rows.collect()]
    assert sorted(x[2] for x in other) == list(range(n)) and [x[2] for x in other] != [x[2] for x in whole]
    # stopped after any row, the rest is what follows it
    for stop in (0, 1, 143, 144, 500, 1002):
        s, o, _ = whole[stop]
        assert [(r.shard, r.offset, r.id) for _, rows in permute.pull(spark, path, 0, s, o + 1) for r in rows.collect()] == whole[stop + 1 :]
    dealt = [(r.shard, r.offset, r.id) for k in range(3) for _, rows in permute.pull(spark, path, 0, rank=k, world=3) for r in rows.collect()]
    assert sorted(dealt) == whole
    assert "sort" not in permute.dealt(numbered, "__row", n, 42, 0, 7)._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0].lower()
    scan = permute.remaining(spark, path, 0, 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in scan and "(shard" in scan.split("PartitionFilters")[1]


def test_bucketed(spark, tmp_path):
    raw = spark.range(500).selectExpr("concat('w', id) AS window_id", "if(id % 4 = 0, 'val', 'train') AS split", "id AS x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    for name, rows in (("t_raw", raw), ("t_mapped", raw.selectExpr("window_id", "split", "x * 2 AS y"))):
        bucketed.save(rows, name, str(tmp_path / name), "window_id", 6)
    try:
        met = bucketed.paired(spark.table("t_raw"), spark.table("t_mapped"), "window_id", "val")
        assert met.count() == 125 and met.where("y <> x * 2").count() == 0
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("Bucketed: true") == 2 and plan.count("PartitionFilters: [isnotnull(split") == 2
        assert met.columns == ["window_id", "x", "y"]
        files = list((tmp_path / "t_raw").rglob("*.parquet"))
        assert len([f for f in files if f.parent.name == "split=val"]) == 6  # one file a bucket and split
        spark.sql("DROP TABLE t_raw")  # the files stay
        back = bucketed.attach(spark, "t_again", str(tmp_path / "t_raw"), "window_id", 6)
        again = bucketed.paired(back, spark.table("t_mapped"), "window_id", "val")
        assert again.count() == 125 and "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    finally:
        for t in ("t_raw", "t_mapped", "t_again"):
            spark.sql(f"DROP TABLE IF EXISTS {t}")
