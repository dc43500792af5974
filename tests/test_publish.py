"""Publishing what was checked, reconciling by digests, logs that can't be read."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from candlewright.operators import reconcile, tokens
from candlewright.sources import io, publish


def audit(rows):
    return rows.where("v < 0").select("k", F.lit("negative").alias("violation"))


def test_versions(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, folder)
    one = spark.range(10).selectExpr("id AS k", "id AS v")
    assert publish.publish(one, folder, audit) == 1
    # a plan that gives other rows each time it runs: what was audited is what is read
    shaky = spark.range(2000).select(F.col("id").alias("k"), (F.rand() * 1e6).cast("long").alias("v"))
    assert publish.publish(shaky, folder, audit) == 2
    assert sorted(publish.read_published(spark, folder).collect()) == sorted(publish.read_published(spark, folder, 2).collect())
    bad = spark.range(20).selectExpr("id AS k", "3 - id AS v")
    with pytest.raises(publish.AuditFailed) as failed:
        publish.publish(bad, folder, audit)
    assert failed.value.counts == {"negative": 16} and [r.k for r in failed.value.preview] == [4, 5, 6, 7, 8]
    assert publish.publish(one, folder, audit, dry_run=True) is None
    assert publish.read_published(spark, folder).count() == 2000 and set(publish.versions(spark, folder)) == {1, 2}
    assert publish.publish(one, folder, audit) == 3 and set(publish.versions(spark, folder)) == {2, 3}
    assert len(list((tmp_path / "set" / "data").iterdir())) == 2  # the oldest, the failed and the dry one are gone


@pytest.mark.parametrize("step", ["written", "committing"])
def test_a_writer_dies(spark, tmp_path, monkeypatch, step):
    folder = str(tmp_path / "set")
    publish.publish(spark.range(10).selectExpr("id AS k", "id AS v"), folder, audit)

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(publish, "previews" if step == "written" else "_commit", die)
    rows = spark.range(50).selectExpr("id AS k", "-id AS v" if step == "written" else "id AS v")
    with pytest.raises(KeyboardInterrupt):
        publish.publish(rows, folder, audit)
    assert publish.read_published(spark, folder).count() == 10


def test_two_writers_of_one_number(spark, tmp_path):
    folder = str(tmp_path / "set")
    publish.publish(spark.range(3).selectExpr("id AS k", "id AS v"), folder, audit)
    with pytest.raises(FileExistsError):
        publish._commit(spark, folder, 1, {"data": "data/other"})
    assert publish.read_published(spark, folder).count() == 3


def test_equal_tables_are_not_joined(spark):
    a = spark.range(1000).selectExpr("CAST(id AS STRING) AS k", "id AS v", "CASE WHEN id % 3 = 0 THEN id END AS w")
    one = reconcile.digested(a, "k", F.lit(True), "v", "w")
    assert reconcile.unequal_buckets(one, reconcile.digested(a.repartition(5), "k", F.lit(True), "v", "w")).count() == 0
    changed = a.withColumn("v", F.when(F.col("k") == "77", 0).otherwise(F.col("v")))
    odd = reconcile.unequal_buckets(one, reconcile.digested(changed, "k", F.lit(True), "v", "w"))
    assert odd.count() == 1 and reconcile.in_buckets(a, "k", odd).where("k = '77'").count() == 1 and reconcile.in_buckets(a, "k", odd).count() < 20
    assert reconcile.unequal_buckets(one, reconcile.digested(a.where("k <> '5'"), "k", F.lit(True), "v", "w")).count() == 1
    unsound = reconcile.digested(a, "k", F.col("k") != "9", "v", "w")
    assert reconcile.unequal_buckets(unsound, one).count() == 1
    assert reconcile.unequal_buckets(one, reconcile.digested(a.limit(0), "k", F.lit(True), "v", "w")).count() == one.count()


def test_violations_by_digest(spark):
    raw = spark.createDataFrame([(f"r{i}", "<chart> <O_1> </chart>", f"<action> {'HOLD' if i % 2 else 'BUY'} </action>" + (" strange" if i == 7 else "")) for i in range(60)], "id string, prompt string, completion string")
    ids, labels = tokens.labels(F.col("prompt"), tokens.encode(F.concat_ws(" ", "prompt", "completion")), 64)
    right = raw.select("id", ids.alias("input_ids"), labels.alias("labels"))
    assert [tuple(r) for r in tokens.violations(raw, right, "id", 64).collect()] == [("r7", "completion")]
    wrong = right.where("id <> 'r3'").withColumn("labels", F.when(F.col("id") == "r4", F.col("input_ids")).when(F.col("id") == "r5", F.slice("labels", 1, 3)).otherwise(F.col("labels")))
    more = wrong.unionByName(right.limit(1).withColumn("id", F.lit("x")))
    found = {r.id: r.violation for r in tokens.violations(raw, more, "id", 64).collect()}
    assert found == {"r3": "no_mapped", "r4": "completion", "r5": "length", "r7": "completion", "x": "no_raw"}
    assert len(tokens.previews(tokens.violations(raw, more, "id", 64), 1).collect()) == 4


def test_logs_that_cannot_be_read(spark, tmp_path):
    good = [{"trend": "UP", "rr": 3}, {"trend": "DOWN"}]
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text(json.dumps({"records": good[:1], "hold_buff": 1}))
    (tmp_path / "c.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "d.json").write_text("[]")
    path = lambda n: str(tmp_path / n)
    assert io.records_from_json(spark, path("*.json"), path("nothing.json")).count() == 3
    assert io.records_from_json(spark, path("nothing.json")).count() == 0
    for name, text in (("e.json", json.dumps(good)[:-4]), ("f.json", json.dumps({"records": 5})), ("g.json", ""), ("h.json", "what?")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception, match=name):
            io.records_from_json(spark, path("a.json"), path(name)).collect()
        (tmp_path / name).unlink()
