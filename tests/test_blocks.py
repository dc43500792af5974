"""Series in blocks: means, deviations, windows and percentiles against plain restatements; no task holds a whole series."""

from __future__ import annotations

import datetime as dt
import math
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.operators import bars, windows
from candlewright.operators.bars import quantise


def hourly(rng, n, holes=0.0):
    """Rows (ts, open, high, low, close) with gaps in time and, at ``holes``, a null or NaN price."""
    at, price, out = dt.datetime(2020, 1, 1), 100.0, []
    for _ in range(n):
        at += dt.timedelta(hours=rng.choice([1, 1, 1, 2, 500 if rng.random() < 0.02 else 1]))
        step = rng.gauss(0, 1)
        row = [price, max(price, price + step) + rng.random(), min(price, price + step) - rng.random(), price + step]
        if rng.random() < holes:
            row[rng.randrange(4)] = rng.choice([None, float("nan")])
        out.append((at, *row))
        price += step
    return out


def plain_rows(series, period):
    d = pd.DataFrame(series, columns=["ts", "open", "high", "low", "close"]).astype({c: float for c in ("open", "high", "low", "close")})
    before = d.close.shift(1)
    tr = np.max(np.vstack([d.high - d.low, (d.high - before).abs(), (d.low - before).abs()]), axis=0)
    d["atr"] = pd.Series(tr).ewm(span=period, adjust=False).mean().values
    return d.dropna().reset_index(drop=True)


@pytest.mark.parametrize("period, holes", [(1, 0.0), (7, 0.0), (100, 0.0), (14, 0.1), (100, 0.3)])
def test_rows_and_deviation(spark, monkeypatch, period, holes):
    monkeypatch.setattr(bars, "BLOCK", 64)
    rng = random.Random(period)
    series = {s: hourly(rng, n, holes) for s, n in (("A", 700), ("B", 3), ("C", 1), ("D", 250))}
    frame = spark.createDataFrame([(s, *r, "kept") for s, rows in series.items() for r in rows], "symbol string, ts timestamp, open double, high double, low double, close double, row_no string").repartition(3)
    rows = bars.preprocess(frame, period).cache()
    wide = bars.with_deviation(rows, period).collect()
    assert rows.columns == [*frame.columns, "atr", "row_idx"]
    got = {s: sorted((r for r in rows.collect() if r.symbol == s), key=lambda r: r.row_idx) for s in series}
    for s, raw in series.items():
        want = plain_rows(raw, period)
        assert [r.row_idx for r in got[s]] == list(range(len(want)))
        assert np.allclose([r.atr for r in got[s]], want.atr, rtol=1e-9) and [r.open for r in got[s]] == want.open.tolist()
        prices = want[["open", "high", "low", "close"]].to_numpy()
        far = [np.abs(prices[max(0, i - period + 1) : i + 1] - prices[i, 0]).max() for i in range(1, len(want))]
        mine = sorted((r for r in wide if r.symbol == s), key=lambda r: r.row_idx)
        assert np.allclose([r.deviation for r in mine], far) and np.allclose([r.ratio for r in mine], [x / a for x, a in zip(far, want.atr[1:], strict=True)])


@pytest.mark.parametrize("size, stride, block", [(10, 1, 16), (10, 7, 16), (5, 5, 100), (10, 300, 16), (3, 1, 1000)])
def test_windows(spark, monkeypatch, size, stride, block):
    monkeypatch.setattr(windows, "_block_size", lambda size: max(block, size))
    rng = random.Random(size * stride)
    rows = [(s, i, 100.0 + i, 101.0 + i, 99.0, 100.0, rng.choice([1.0, 2.0, 0.0, float("nan"), 3.0])) for s, n in (("A", 333), ("B", size), ("C", size - 1), ("D", 64)) for i in range(n)]
    frame = spark.createDataFrame(rows, "symbol string, row_idx int, open double, high double, low double, close double, atr double").repartition(3)
    got = sorted((r.symbol, r.window_no, r.start_idx, r.anchor_open, r.anchor_atr, [c.h for c in r.candles]) for r in windows.encoded_windows(frame, F.lit(8.0), size, stride).collect())
    want, bins = [], {}
    for s in "ABCD":
        mine, no = [r for r in rows if r[0] == s], 0
        for a in range(0, len(mine) - size + 1, stride):
            if mine[a][6] > 0:
                at = [round(min(max((r[3] - mine[a][2]) / (8.0 * mine[a][6]), -1), 1) * 1e12) for r in mine[a : a + size]]
                bins[s, no] = at
                want.append((s, no, a, mine[a][2], mine[a][6]))
                no += 1
    assert [g[:5] for g in got] == want and all(len(g[5]) == size for g in got)
    high = frame.select(quantise(F.lit(101.0), F.lit(100.0), F.lit(1.0), F.lit(8.0)).alias("q")).first().q
    assert all(g[5][0] == high for g in got if g[4] == 1.0) and all(g[5] == sorted(g[5]) for g in got)
    starts = sorted((r.symbol, r.window_no, r.start_idx, r.anchor_open, r.anchor_atr) for r in windows.window_starts(frame, size, stride).collect())
    assert starts == want


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.999, 1.0])
def test_percentiles(spark, share):
    rng = random.Random(4)
    values = [rng.gauss(0, 1) for _ in range(500)] + [0.0] * 30 + [1.5] * 700 + [1e-300, -1e300, 1e300, -0.0] + [2.0 + k * 2**-51 for k in range(300)]
    rows = [("a", v) for v in values] + [("b", 3.0), ("b", 4.0), ("c", None), ("c", math.nan), (None, 7.0), ("d", 5.0), ("e", math.inf), ("e", 1.0)]
    got = {r.g: r.p for r in bars.percentiles(spark.createDataFrame(rows, "g string, x double").repartition(3), "g", "x", share, "p").collect()}
    assert set(got) == {"a", "b", None, "d", "e"} and got[None] == 7.0 and got["d"] == 5.0 and got["b"] == pytest.approx(3 + share)
    assert got["a"] == pytest.approx(np.percentile(values, share * 100), rel=1e-12)
    assert got["e"] == (1.0 if share == 0 else math.inf)


def test_no_window_over_a_whole_series(spark):
    """Windows by symbol alone run over one row a block; bars are ordered inside their block."""
    frame = spark.createDataFrame([("A", dt.datetime(2020, 1, 1), 1.0, 1.0, 1.0, 1.0)], "symbol string, ts timestamp, open double, high double, low double, close double")
    rows = bars.preprocess(frame)
    plan = windows.encoded_windows(rows, bars.scales(rows), stride=1)._jdf.queryExecution().optimizedPlan().toString()
    specs = set(re.findall(r"windowspecdefinition\(symbol#\d+, (\w+)#?\d*", plan))
    # by symbol and block, or over the blocks' rows by symbol (in order of __block) or stretch of blocks: never ts or row_idx next to the symbol
    assert "__block" in specs and specs <= {"__block", "__stretch"}, specs


def test_one_series_is_spread(spark):
    n = 20_000
    frame = spark.range(n).selectExpr("'A' AS symbol", "CAST(id AS INT) AS ts", "1.0D + id % 7 AS open", "9.0D AS high", "0.5D AS low", "2.0D AS close")
    rows = bars.preprocess(frame)
    spread = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in spread) == n - 1 and len(spread) > 1 or spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert rows.agg(F.max("row_idx")).first()[0] == n - 2
