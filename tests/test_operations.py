"""Files, states, streams, batches and the entry without the corpus operators."""

from __future__ import annotations

import datetime as dt
import json
import math
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from candlewright.operators import bars, control, dataset, generate, reports, reward, tokens, windows
from candlewright.plans import presets
from candlewright.sources import io
from candlewright.streaming import live

HERE = Path(__file__).resolve().parents[1]


def test_entry_without_corpus_operators(tmp_path):
    for name in ("candlewright", "__spark_entry__.py", "corpus_pipeline.py"):
        if (HERE / name).exists():
            (shutil.copytree if (HERE / name).is_dir() else shutil.copy)(HERE / name, tmp_path / name)
    shutil.rmtree(tmp_path / "candlewright" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 70 and set(o) <= set(q) and not any(k[:2] == 'op' and k[2].isdigit() for k in q) and 'pipeline' not in q"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr


def series(spark, n=400, symbol="X"):
    rows, price = [], 1900.0
    for i in range(n):
        step = math.sin(i * 1.7) * 1.5
        rows.append((symbol, i, price, price + abs(step) + 0.5, price - 0.7, price + step))
        price += step
    return spark.createDataFrame(rows, "symbol string, ts int, open double, high double, low double, close double")


def test_files_there_and_back(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    lines = [f"{i},{r.open},{r.high},{r.low},{r.close}" for i, r in enumerate(series(spark).orderBy("ts").collect())]
    (raw / "X_1H.csv").write_text("\n".join(["i,Open,High,Low,Close", *lines]))
    schema = "i int, Open double, High double, Low double, Close double"
    rows = bars.preprocess(io.bars_from_csv(spark, str(raw), "i", schema), 14)
    io.bars_to_csv(rows, str(tmp_path / "ready"), "ATR_14")
    back = io.bars_from_csv(spark, str(tmp_path / "ready" / "symbol=X_1H"), schema=io.RAW_BARS, atr="ATR_14")
    assert back.count() == rows.count() == 399 and back.agg(F.max("row_idx")).first()[0] == 398
    named = back.withColumn("symbol", F.lit("X_1H"))
    joined = named.join(rows.select("row_idx", F.col("atr").alias("atr0"), F.col("open").alias("open0")), "row_idx")
    assert joined.where("abs(atr - atr0) > 1e-9 or open <> open0").count() == 0
    io.encode_files(named, 8.0, str(tmp_path / "windows"), 100)
    text = spark.read.csv(str(tmp_path / "windows"), header=True)
    want = {r.start_idx: r.t for r in windows.encoded_windows(rows, F.lit(8.0)).select("start_idx", windows.plain_text(F.col("candles")).alias("t")).collect()}
    assert {r.start_idx if isinstance(r.start_idx, int) else int(r.start_idx): r.text for r in text.collect()} == want and len(want) == 6
    scale = spark.createDataFrame([("X_1H", 8.0)], "symbol string, scale double")
    assert windows.encoded_windows(rows, scale).count() == 6 and windows.encoded_windows(rows, scale.limit(0)).count() == 0


def test_preprocess_files(spark, tmp_path):
    (tmp_path / "A.csv").write_text("i,Open,High,Low,Close\n" + "\n".join(f"{i},{10 + i % 3},{12 + i % 5},{8 - i % 2},{11}" for i in range(60)))
    full = "i int, Open double, High double, Low double, Close double"
    raw = io.bars_from_csv(spark, str(tmp_path / "A.csv"), "i", full)
    assert raw.count() == 60
    for version in (1, 2):
        io.append_scales(bars.scales(bars.preprocess(raw, 10), 10), str(tmp_path / "log"), version)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r.version for r in log.collect()) == [1, 2] and all(r.shown == f"{r.scale:.2f}" for r in log.collect())


def test_state(spark, tmp_path):
    fixed = spark.createDataFrame(presets.settings(presets.ROUND2), presets.SETTINGS)
    start = control.seeded(fixed)
    rates = spark.createDataFrame([("action", g, r) for g, r in zip(presets.GROUPS, (0.1, 0.5, None, 0.2, 0.2), strict=True)], "namespace string, grp string, reading double")
    after = control.advanced(start, rates, fixed)
    state = {r.grp: r for r in after.collect()}
    assert len(state) == 5 and state["SELL"].ema == 0.24 and state["SELL"].buff == 0.15 and state["BUY"].ema == pytest.approx(0.24 * 0.9 + 0.05)
    path = str(tmp_path / "state")
    assert io.read_state(spark, path) is None
    io.write_state(after, path)
    assert sorted(io.read_state(spark, path).collect()) == sorted(after.select("namespace", "grp", "ema", "buff", "prev_error").collect())
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "part.json").write_text(json.dumps({"namespace": "action", "grp": "BUY", "ema": 0.3, "buff": 0.2}))
    assert io.read_state(spark, str(tmp_path / "old")).first().prev_error == 0.0
    for text in ("{not json", "", json.dumps({"grp": "BUY", "buff": 0.1})):
        (tmp_path / "old" / "part.json").write_text(text)
        assert io.read_state(spark, str(tmp_path / "old")) is None
    assert sorted(io.restored_or_seeded(spark, path, fixed).collect()) != sorted(start.collect())
    assert sorted(io.restored_or_seeded(spark, None, fixed).collect()) == sorted(start.collect())
    with pytest.warns(UserWarning, match="starts anew"):
        assert sorted(io.restored_or_seeded(spark, str(tmp_path / "old"), fixed).collect()) == sorted(start.collect())
    rows = spark.createDataFrame([("BUY",), (None,), ("other",)], "a string")
    assert sorted(r.buff for r in control.with_buff(rows, F.col("a"), start).collect()) == [0.0, 0.0, 0.15]
    assert io.first_existing(spark, None, str(tmp_path / "none"), path) == path and io.first_existing(spark, str(tmp_path / "none")) is None


def test_logs_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("UP", 1.0, k) for k in range(4)], "trend string, r_multiple double, step int")
    path = str(tmp_path / "log")
    io.append_records(rows, path, "round1")
    io.append_records(rows.limit(1), path, "round2")
    assert io.logged_records(spark, path, "round1").count() == 4 and io.logged_records(spark, path, "round1", after=1).count() == 2
    io.export_records(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    io.write_eval(rows, rows.limit(1), rows.limit(2), str(tmp_path / "eval"))
    assert [spark.read.json(str(tmp_path / "eval" / p)).count() for p in ("records", "rates", "summary")] == [4, 1, 2]
    assert io.publish_split(rows, str(tmp_path), "x", "val", dry_run=True) == "val_x" and not (tmp_path / "val_x").exists()
    io.publish_split(rows, str(tmp_path), "x", "val")
    with pytest.warns(UserWarning, match="is replaced"):
        io.publish_split(rows.limit(1), str(tmp_path), "x", "val")
    assert spark.read.parquet(str(tmp_path / "val_x")).count() == 1
    tokens.write_vocabulary(spark, str(tmp_path / "vocab"))
    assert sorted(tokens.read_vocabulary(spark, str(tmp_path / "vocab")).collect()) == sorted(tokens.vocabulary_frame(spark).collect())
    with pytest.warns(UserWarning, match="computed anew"):
        assert tokens.read_vocabulary(spark, str(tmp_path / "nothing")).count() == 4145
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tokens.read_vocabulary(spark, str(tmp_path / "nothing"), fallback=False)


def test_late_ticks_change_no_bar(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    (tmp_path / "in").mkdir()
    given = [[("a", at(1), 1.0), ("a", at(1, 30), 5.0), ("a", at(9), 2.0)], [("a", at(9, 10), 2.5)], [("a", at(1, 10), 99.0), ("a", at(9, 30), 3.0), ("a", at(20), 7.0)]]
    for k, ticks in enumerate(given):
        spark.createDataFrame(ticks, "symbol string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
        for f in (tmp_path / "in" / f"p={k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k * 100,) * 2)
    stream = spark.readStream.schema("symbol string, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = {r.ts.hour: (r.open, r.high, r.low, r.close, r.ticks) for r in live.bars_to_table(stream, str(tmp_path / "out")).collect()}
    assert out == {1: (1.0, 5.0, 1.0, 5.0, 2), 9: (2.0, 3.0, 2.0, 3.0, 3)}  # 99 came too late, the bar of 20 is still open


def test_controller_over_a_stream(spark, tmp_path):
    fixed = spark.createDataFrame(presets.settings(presets.ROUND2), presets.SETTINGS)
    steps = [["BUY", "BUY", "SELL"], ["HOLD", "WAIT_BUY"], ["BUY"]]
    schema = "k int, action_type string, passed boolean"

    def add(k):
        spark.createDataFrame([(k, a, True) for a in steps[k]] + [(k, "SELL", False)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
        for f in (tmp_path / "in" / f"p={k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k * 100,) * 2)

    group = reward.action_group(F.col("action_type"))
    score, advance = live.controlled(fixed, lambda rows: rows.withColumn("reward", F.col("buff") + 1), group, F.col("passed"), group)
    seen = []

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        live.follow(
            stream, str(tmp_path / "state"), control.seeded(fixed), score, advance, str(tmp_path / "out"), str(tmp_path / "checkpoint"),
            lambda rows, state: seen.append((rows.count(), state.count())), 2,
        ).awaitTermination()

    for k in (0, 1):
        add(k)
    run()
    add(2)
    run()  # goes on where it stopped
    want = {g: (presets.ROUND2.target(g), presets.ROUND2.init[g], 0.0) for g in presets.GROUPS}
    for k, names in enumerate(steps):
        out = spark.read.parquet(str(tmp_path / "out" / f"batch={k}")).collect()
        assert all(r.reward == pytest.approx(1 + want[presets.GROUP_OF_ACTION[r.action_type]][1]) for r in out)
        for g, (ema, buff, before) in want.items():
            target = presets.ROUND2.target(g)
            ema = 0.1 * sum(presets.GROUP_OF_ACTION[a] == g for a in names) / len(names) + 0.9 * ema
            move = 0.02 * (target - ema) + 0.01 * (target - ema - before)
            low, high = presets.ROUND2.ranges[g]
            want[g] = (ema, min(high, max(low, buff + min(0.0002, max(-0.0002, move)))), target - ema)
        state = {r.grp: (r.ema, r.buff, r.prev_error) for r in spark.read.parquet(str(tmp_path / "state" / f"batch={k + 1}")).collect()}
        assert all(state[g] == pytest.approx(want[g]) for g in want)
    assert seen == [(7, 5)]


def test_entropy_readings(spark):
    rows = [(0, "p", 1), (0, "p", 2), (0, "q", 3), (0, "r", 4), (0, "r", 4), (1, "p", 5), (0, "p", None)]
    out = reports.entropy_readings(spark.createDataFrame(rows, "step int, prompt string, rr int"), "rr", "prompt").collect()
    assert [(r.step, r.reading) for r in out] == [(0, pytest.approx(math.log(2) / 2))]


def test_samples(spark):
    candles = [(500, 504, 496, 500 + (i % 5) - 2) for i in range(50)]
    frame = spark.createDataFrame([("w", candles), ("edge", [(0, 2, 0, 0)] * 50)], "window_id string, candles array<struct<o:int,h:int,l:int,c:int>>")
    made = generate.samples(frame, 300, 7)
    read = generate.verified(made).collect()
    assert sum(r.window_id == "w" for r in read) == 300 and len(read) > 590 and all(r.well_formed and r.semantic_passed and r.same and r.sl_ok is not False for r in read)
    assert sorted(map(str, generate.samples(frame, 300, 7).collect())) == sorted(map(str, made.collect()))
    trades = made.where("window_id = 'w' and sl is not null").collect()
    gaps = Counter(abs(r.sl - r.current_price_bin) for r in trades)
    assert len(trades) > 40 and set(gaps) <= set(range(5, 11)) and {r.rr for r in trades} == set(range(1, 10))
    assert {r.leaf for r in made.where("window_id = 'w'").collect()} == set(range(21)) - {7, 8, 17, 18}  # no close lies above the price
    assert generate.samples(frame.limit(0), 3, 7).count() == 0 and generate.samples(frame, 5, 7, tries=1).count() <= 10


def test_stop_takes_distances_first(spark):
    # at price 100 with a zone from 95 the distances 6 to 10 fit; at price 985 target 1023 leaves one multiple of 10, more of the smaller ones
    frame = spark.range(3000).select(F.col("id"))
    drawn = generate.stop(F.lit("BUY"), F.lit(985), F.lit(980), F.lit(990), lambda d: dataset.draw(F.lit(1 << 20), F.col("id").cast("string"), d.cast("string")), dataset.draw(F.lit(1 << 20), F.col("id").cast("string"), "rr"))
    out = Counter(r.sl for r in frame.select(drawn.alias("s")).select("s.*").collect())
    assert set(out) == {985 - d for d in range(6, 11)} and max(out.values()) < 1.3 * min(out.values())


def test_batches(spark):
    rows = spark.createDataFrame([("s", i, f"<chart> <O_{i}> </chart>", "<think> BUY") for i in range(5)], "symbol string, i int, prompt string, completion string")
    cut = tokens.in_batches(rows, 2, "symbol", "i")
    assert sorted(Counter(r.batch for r in cut.collect()).values()) == [1, 2, 2]
    for pretrain, shown in ((True, 7), (False, 3)):
        out = tokens.collated(cut, "on_the_fly", pretrain, "batch").collect()
        assert all(len(r.input_ids) == len(r.labels) == len(r.attention_mask) == 7 and sum(x != -100 for x in r.labels) == shown for r in out)
    stored = spark.createDataFrame([("b", [1, 5, 2], [-100, 5, 2]), ("b", [1, 2], [-100, 2])], "batch string, input_ids array<int>, labels array<int>")
    assert sorted(r.labels for r in tokens.collated(stored, "pre_tokenized", False, "batch").collect()) == [[-100, 2, -100], [-100, 5, 2]]
    assert sorted(r.labels for r in tokens.collated(stored, "pre_tokenized", True, "batch").collect()) == [[1, 2, -100], [1, 5, 2]]
    with pytest.raises(ValueError, match="unknown mode"):
        tokens.collated(stored, "other", True, "batch")
    broken = tokens.prompt_violations(rows, rows.where("i < 3").select("i", tokens.prompt_ids(F.col("prompt"), 2)[0].alias("prompt_input_ids")), "i").collect()
    assert sorted((r.i, r.violation) for r in broken) == [(3, "no_mapped"), (4, "no_mapped")]
    assert tokens.seeded_sample(rows, 3, 1, "i").count() == 3 and tokens.seeded_sample(rows, 9, 1, "i").count() == 5


def test_reward_callable(spark):
    candle = "<O_500> <H_503> <L_497> <C_500>"
    prompt = "<chart> " + " ".join([candle] * 50) + " </chart>"
    good = "<think> <trend>RANGE</trend> <current_price> 0 5 0 0 </current_price> </think> <action> HOLD </action>"
    future = [[500, 503, 497, 500]] * 50
    score = reward.reward_function(spark, presets.ROUND1)
    assert score([prompt] * 3, [good, "what", good.replace("HOLD", "WAIT_BUY")], [future] * 3, symbol=["x"] * 3) == pytest.approx([4.5, 0.7, 1.8])
    buffs = spark.createDataFrame([("HOLD", 0.05), ("NO_ZONE", 0.2)], "grp string, buff double")
    assert reward.reward_function(spark, presets.ROUND1, buffs)([prompt], [good], [future]) == pytest.approx([4.55])
    two = reward.reward_function(spark, presets.ROUND1_V2, buffs, 0.1)
    assert two([prompt] * 2, [good] * 2, [future] * 2, ["zone", "action"]) == pytest.approx([4.7, 4.55])
