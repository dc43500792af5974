"""The mix: flight, reserve and landing against direct checks; texts back in their rows."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewright.llm import mixing
from candlewright.llm.runtime import repeated

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_flight_keeps_both_sums():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40, 600):
        for sizes in (rng.integers(0, 50, n), rng.integers(1, 20_000, n), np.full(n, 7)):
            prob = rng.random(n)
            out = mixing.flight(prob, sizes, rng.random(n))
            assert ((out > 0) & (out < 1)).sum() <= 2
            assert abs(out.sum() - prob.sum()) < 1e-6 and abs((out * sizes).sum() - (prob * sizes).sum()) < 1e-5 * max(1, sizes.max())


def test_reserve_spreads():
    rng = np.random.default_rng(4)
    size = np.concatenate([np.zeros(30), rng.integers(1, 30_000, 500)])
    held = mixing.reserve(np.full(len(size), 0.4), size)
    assert held.sum() == mixing.RESERVED and not held[:30].any()
    logs = np.sort(np.log(size[held]))
    assert logs[0] == np.log(size[size > 0].min()) and np.diff(logs).max() < 3 * np.diff(logs).mean()
    assert mixing.reserve(np.array([0.0, 1.0, 0.5]), np.array([5, 5, 5])).tolist() == [False, False, True]


def test_landing_is_the_nearest_of_all():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(1, 11))
        prob, size = rng.random(n), rng.integers(0, 300, n)
        owed, count = (prob * size).sum(), prob.sum()
        out = mixing.landing(prob, size)
        best = min((abs(sum(itertools.compress(size, bits)) - owed) for bits in itertools.product((0, 1), repeat=n)))
        assert set(out) <= {0.0, 1.0} and abs(abs((out * size).sum() - owed) - best) < 1e-6
        ties = [abs(sum(b) - count) for b in itertools.product((0, 1), repeat=n) if abs(abs(sum(itertools.compress(size, b)) - owed) - best) < 1e-6]
        assert abs(abs(out.sum() - count) - min(ties)) < 1e-9


def corpus(spark, per_source, longest, seed=1):
    rng = random.Random(seed)
    rows = [(i, "w " * int(longest ** rng.random()), "en", f"s{i // per_source:02d}", 0) for i in range(per_source * 9)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.mark.parametrize("per_source, longest", [(10, 3000), (200, 5000), (1500, 800)])
def test_targets_are_met(spark, per_source, longest):
    rows, frame = corpus(spark, per_source, longest)
    out = mixing.mix_sources(frame).collect()
    assert [tuple(r) for r in sorted(out)] == [tuple(r) for r in sorted(mixing.mix_sources(frame.repartition(5)).collect())]
    for source in {r.source for r in out}:
        mine = [r for r in out if r.source == source]
        target, took = mine[0].target, sum(r.times * r.size for r in mine)
        share = target / mine[0].source_size
        assert all(r.times in (int(share), int(share) + 1) and r.times <= 3 for r in mine)
        off = abs(took - target)
        if per_source == 10:  # the nearest of all subsets
            extra = [r.size for r in mine]
            sums = {0}
            for z in extra:
                sums |= {x + z for x in sums}
            base = int(share) * sum(extra)
            assert off <= min(abs(base + x - target) for x in sums) + 1e-3
        else:
            assert off <= 0.02 * target


def test_rows_take_what_was_drawn(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), "en", f"s{i % 4}", i) for i in range(400)]
    rows += [(None, f"{'w ' * 9}{k % 7}", "en", "s1", k) for k in range(90)] + [(7, rows[7][1], "en", "s3", -1)] * 20 + [(None, None, None, None, None)] * 3
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    for bound in (500_000, 0):
        monkeypatch.setattr(mixing, "BROADCAST_KEYS", bound)
        want = Counter()
        for r in mixing.mix_sources(frame).collect():
            want[r.doc_id, r.source, r.size] += r.times
        out = mixing.mixed_documents(frame).collect()
        assert Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out) == +want
        # rows that can be told apart are taken as evenly as the draws allow
        times = Counter((r.n_chars, r.text) for r in out if r.doc_id is None and r.source == "s1")
        assert max(times.values()) - min(times.get((k, f"{'w ' * 9}{k % 7}"), 0) for k in range(90)) <= 1
        assert {r.take for r in out} <= {1, 2, 3}


def test_one_key_repeated_many_times(spark):
    frame = spark.range(300_000).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one and the same text' AS text", "'en' AS lang", "'a' AS source", "1L AS n_chars")
    frame = frame.unionByName(spark.range(5).selectExpr("id AS doc_id", "'b b b' AS text", "'en' AS lang", "'b' AS source", "1L AS n_chars"))
    out = mixing.mixed_documents(frame).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in out}
    assert got["b"] == 15 and abs(got["a"] * 5 - (300_000 * 5 + 15 - 45)) <= 10


def test_repeated(spark):
    frame = spark.createDataFrame([(1, 1), (2, 9000), (3, 4096), (4, 4097)], "run int, n long")
    out = repeated(frame, "n", "copy").groupBy("run").agg(F.sum("copy").alias("total"), F.count("*").alias("rows")).collect()
    assert {r.run: (r.total, r.rows) for r in out} == {k: (n * (n + 1) // 2, n) for k, n in ((1, 1), (2, 9000), (3, 4096), (4, 4097))}
