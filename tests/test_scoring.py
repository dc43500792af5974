"""Outcomes, bars, tokens, controllers and sources against restatements and golden numbers."""

from __future__ import annotations

import json
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from candlewright.operators import bars, control, dataset, forward, tokens, windows
from candlewright.plans import presets
from candlewright.sources import io

FLAT = (500, 505, 495, 500)
# entry, sl, rr, candles, long, status, R, exit
GOLDEN = [
    (500, 490, 5, [(500, 512, 498, 510), (510, 522, 505, 520), (520, 532, 515, 530), (530, 535, 489, 490)] + [FLAT] * 46, True, "LOSS", 6 / 5 - 2 / 5, 3),
    (500, 490, 5, [(500, 560, 495, 555)] + [FLAT] * 49, True, "WIN", 3.0, 0),
    (500, 490, 5, [(500, 505, 488, 490)] + [FLAT] * 49, True, "LOSS", -1.0, 0),
    (500, 490, 5, [(500, 525, 489, 505)] + [FLAT] * 49, True, "LOSS", -1.0, 0),
    (500, 490, 5, [(500, 512, 498, 510), (510, 522, 505, 520)] + [(515, 518, 512, 515)] * 48, True, "TIMEOUT", 3 / 5 + 3 / 5 * 1.5, None),
    (500, 490, 1, [(500, 512, 498, 505)] + [FLAT] * 49, True, "WIN", 1.0, 0),
    (500, 510, 3, [(500, 505, 478, 480)] + [FLAT] * 49, False, "TIMEOUT", 1.0, None),
    (500, 500, 3, [FLAT] * 50, True, "INVALID_SETUP", 0.0, None),
    (1020, 1010, 9, [FLAT] * 50, True, "INVALID_SETUP", 0.0, None),
    (500, 490, 2, [], True, "TIMEOUT", 0.0, None),
]
CANDLES = "array<struct<o:int,h:int,l:int,c:int>>"


def walk(entry, sl, rr, candles, long):
    """The trade, candle by candle."""
    risk = abs(entry - sl)
    far = entry + rr * risk * (1 if long else -1)
    if not risk or rr < 1 or not 0 <= far <= 1023:
        return "INVALID_SETUP", 0.0, None
    filled, earned, last = 0, 0.0, entry
    for i, (_, h, low, c) in enumerate(candles[:50]):
        if low <= sl if long else h >= sl:
            return "LOSS", earned - (rr - filled) / rr, i
        reach = h - entry if long else entry - low
        while filled < rr and reach >= (filled + 1) * risk:
            filled += 1
            earned += filled / rr
        if filled == rr:
            return "WIN", earned, i
        last = c
    return "TIMEOUT", earned + (rr - filled) / rr * ((last - entry) if long else (entry - last)) / risk, None


def test_scale_out(spark):
    rng = random.Random(5)
    rows = [g[:5] for g in GOLDEN]
    for _ in range(300):
        p, candles = 500, []
        for _ in range(rng.choice([0, 5, 50, 60])):
            p += rng.randint(-6, 6)
            candles.append((p, p + rng.randint(0, 6), p - rng.randint(0, 6), p + rng.randint(-2, 2)))
        long = rng.random() < 0.5
        rows.append((500, 500 + rng.randint(0, 12) * (-1 if long else 1), rng.randint(1, 9), candles, long))
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, entry int, sl int, rr int, f {CANDLES}, long boolean")
    e, s, f, long = (F.col(c) for c in ("entry", "sl", "f", "long"))
    out = frame.select("i", forward.scale_out(e, s, F.col("rr"), f, long).alias("x"), forward.best_excursion(e, s, f, long).alias("best")).orderBy("i").collect()
    for r, row in zip(out, rows, strict=True):
        want = walk(*row)
        assert (r.x.status, r.x.exit_index) == (want[0], want[2]) and r.x.r_multiple == pytest.approx(want[1]), row
        assert 0 <= r.best <= 9
    for r, g in zip(out, GOLDEN, strict=False):
        assert (r.x.status, r.x.exit_index) == (g[5], g[7]) and r.x.r_multiple == pytest.approx(g[6])


def test_binary_and_stop_rules(spark):
    base = [(505, 510, 498, 505)] * 48
    rows = [
        (500, 490, 520, [(505, 510, 498, 505), (505, 525, 500, 522), *base], "WIN", 2.0),
        (500, 490, 520, [(500, 505, 488, 490)] + [FLAT] * 49, "LOSS", -1.0),
        (500, 490, 520, [FLAT] * 50, "TIMEOUT", 0.0),
        (500, 490, 520, [(500, 525, 485, 505)] + [FLAT] * 49, "LOSS", -1.0),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, entry int, sl int, target int, f {CANDLES}, st string, r double")
    for r in frame.select("st", "r", forward.binary_outcome(F.col("entry"), F.col("sl"), F.col("target"), F.col("f"), F.lit(True)).alias("x")).collect():
        assert (r.x.status, r.x.r_multiple) == (r.st, r.r)
    stops = spark.createDataFrame([(497, 495, 505, False), (485, 495, 505, False), (492, 480, 490, False), (490, 495, 505, True)], "sl int, lo int, hi int, ok boolean")
    for r in stops.select("ok", forward.sl_valid(F.lit("BUY"), F.lit(500), F.col("sl"), F.col("lo"), F.col("hi")).alias("got")).collect():
        assert r.ok == r.got


@pytest.mark.parametrize("span", [1, 2, 3, 14, 100])
def test_ema_with_gaps(spark, span):
    rng = random.Random(8)
    values = [None, None] + [rng.choice([None, rng.random() * 10, rng.random() * 10]) for _ in range(400)] + [None] * 300 + [1.0, 0.0, None, 3.0] + [0.5] * 900
    frame = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("none", 0, None)], "symbol string, ts int, v double")
    got = [r.e for r in bars.with_ema(frame, "v", span, "e").where("symbol = 's'").orderBy("ts").collect()]
    want = pd.Series(values, dtype=float).ewm(span=span, adjust=False).mean().tolist()
    for a, b in zip(got, want, strict=True):
        assert (a is None and math.isnan(b)) or a == pytest.approx(b, rel=1e-9)
    assert bars.with_ema(frame, "v", span, "e").where("symbol = 'none'").first().e is None


def test_quantise_halves_go_to_even(spark):
    frame = spark.createDataFrame([(1.0 * k,) for k in range(-2, 3)], "p double")
    got = [r[0] for r in frame.select(bars.quantise(F.col("p"), F.lit(0.0), F.lit(1.0), F.lit(1.0), 2)).collect()]
    assert got == [0, 0, 0, 1, 1]
    text = spark.createDataFrame([("<chart> O_1 H_2 L_0 C_1 </chart>",)], "t string")
    assert text.select(windows.parse_window(F.col("t"))).first()[0][0].h == 2
    with pytest.raises(Exception, match="counts differ"):
        text.select(windows.parse_window(F.concat("t", F.lit(" O_4")))).collect()


def test_tokens_round_trip(spark):
    words = [t for _, t, i in tokens.vocabulary() if i > 3][::7]
    frame = spark.createDataFrame([(1, " ".join(words)), (2, "what is <O_1024> this"), (3, "")], "i int, t string")
    out = {r.i: r for r in frame.select("i", tokens.encode(F.col("t")).alias("ids"), tokens.decode(tokens.encode(F.col("t"))).alias("back")).collect()}
    assert out[1].back == " ".join(words) and out[2].ids == [1, 0, 0, 0, 0, 2] and out[3].ids == [1, 2]
    joined = {r.i: r.ids for r in tokens.encode_by_join(frame, "i", "t", tokens.vocabulary_frame(spark)).collect()}
    assert joined[1] == out[1].ids[1:-1]
    assert len(tokens.vocabulary()) == 4145 and dict((t, i) for _, t, i in tokens.vocabulary())["<RR_9>"] == 4144


def test_controller_fold(spark):
    rates = [0.5, None, 0.1, 0.9, 0.2]
    frame = spark.createDataFrame([("BUY", k, r) for k, r in enumerate(rates)], "grp string, step int, reading double")
    settings = spark.createDataFrame([("BUY", 0.28, 0.15, 0.35, 0.2)], "grp string, target double, low double, high double, init double")
    got = control.pd_trace(frame, settings, ["grp"], 0.9, 0.02, 0.01, 0.0005).orderBy("step").collect()
    ema, buff, before = 0.28, 0.2, 0.0
    for r, rate in zip(got, rates, strict=True):
        if rate is not None:
            ema = 0.1 * rate + 0.9 * ema
            error = 0.28 - ema
            buff = min(0.35, max(0.15, buff + min(0.0005, max(-0.0005, 0.02 * error + 0.01 * (error - before)))))
            before = error
        assert (r.ema, r.buff, r.prev_error) == pytest.approx((ema, buff, before))


def test_sources(spark, tmp_path):
    (tmp_path / "scale.txt").write_text("a: 1.00\n\nno colon\nb: 2.50\na: 3.25\n")
    assert {r.symbol: r.scale for r in io.scales_from_text(io.scale_log(spark, str(tmp_path / "scale.txt"))).collect()} == {"a": 3.25, "b": 2.5}
    (tmp_path / "r_rank0.json").write_text(json.dumps([{"trend": "UP", "rr": 3}]))
    (tmp_path / "r_rank1.json").write_text(json.dumps({"records": [{"trend": "DOWN", "r_multiple": 1.5}]}))
    assert sorted((r.trend, r.rr, r.r_multiple) for r in io.records_from_json(spark, str(tmp_path / "r_rank*.json")).collect()) == [("DOWN", None, 1.5), ("UP", 3, None)]
    for symbol in ("X_1H", "Y_1H"):
        (tmp_path / f"{symbol}.csv").write_text("Open,High,Low,Close\n1,2,0,1\n1,3,1,2\n")
    assert sorted(r.symbol for r in io.bars_from_csv(spark, str(tmp_path / "*.csv")).collect()) == ["X_1H"] * 2 + ["Y_1H"] * 2
    rows = spark.createDataFrame([("a", "b", "train", "s")], "prompt string, completion string, split string, symbol string")
    rows.select("prompt", "completion").write.parquet(str(tmp_path / "plain"))
    assert io.row_kind(spark, str(tmp_path / "plain")) == "text"
    io.write_split(rows, str(tmp_path / "split"))
    assert io.read_split(spark, str(tmp_path / "split"), "train").count() == 1 and io.read_split(spark, str(tmp_path / "split"), "val").count() == 0
    assert io.split_name("x.parquet", "val") == "val_x.parquet" and io.split_name("my_val.parquet", "val") == "my_val.parquet"
    assert io.publish_verified(rows, rows, str(tmp_path / "no")) == 1 and not (tmp_path / "no").exists()


def test_presets(tmp_path):
    path = str(tmp_path / "deep" / "r.json")
    for config in (presets.ROUND1, presets.ROUND2, presets.ROUND1_V2):
        presets.save(config, path)
        assert presets.load(type(config), path) == config
        flat = json.loads((tmp_path / "deep" / "r.json").read_text())
        assert all(not isinstance(v, (dict, list)) for v in flat.values())
    assert flat["action_wait_sell_target_ratio"] == 0.19 and flat["zone_no_zone_buff_max"] == 0.3
    presets.save(presets.ROUND1, path)
    flat = json.loads((tmp_path / "deep" / "r.json").read_text())
    assert flat["buff_step_max"] == 0.0005 and flat["wait_buff_min"] == 0.0 and flat["sl_max_dist_bins"] == 20

    def loaded(**changed):
        (tmp_path / "x.json").write_text(json.dumps({k: v for k, v in (flat | changed).items() if v != "gone"}))
        return presets.load(presets.RoundOne, str(tmp_path / "x.json"))

    assert loaded(buy_buff_init="gone", comment="more").init["BUY"] == 0.15
    assert loaded(round_id=7, buff_kp="0.5").gain.kp == 0.5
    with pytest.raises(ValueError, match="missing keys: sl_min_dist_bins, target_buy_ratio"):
        loaded(sl_min_dist_bins="gone", target_buy_ratio="gone")
    for wrong, said in [
        ({"target_buy_ratio": 0.9}, "targets sum"), ({"buy_buff_min": 0.5}, "BUY: 0.5 is above"), ({"hold_buff_init": 0.2}, "HOLD: init"), ({"ema_alpha": 1.0}, "alpha"), ({"buff_kd": -1}, "kd"),
        ({"rr_entropy_floor": -1}, "floor"), ({"rr_entropy_ema_alpha": 1}, "entropy: alpha"), ({"rr_entropy_bonus_cap": -1}, "cap"), ({"zone_score_scale": -1}, "zone_scale"), ({"trade_fee_bins": -1}, "fee_bins"),
        ({"sl_min_dist_bins": 0}, "least stop"), ({"pass_gate2_bonus": 3.1}, "BUY: the worst pass"), ({"pass_gate2_bonus": 2.3, "buy_buff_min": 2, "buy_buff_max": 2, "buy_buff_init": 2, "sell_buff_min": 2, "sell_buff_max": 2, "sell_buff_init": 2, "zone_score_scale": 0.2}, "CANCEL: the worst"),
    ]:
        with pytest.raises(ValueError, match=said):
            loaded(**wrong)
    assert presets.ROUND1.worst_pass("BUY") == pytest.approx(4.5 - 1 - 0.13 + 0.15) and presets.ROUND1.best_failure == pytest.approx(2.2)
    with pytest.raises(ValueError, match="targets sum to"):
        presets.RoundTwo(**{**presets.ROUND1_V2.__dict__, "targets": dict.fromkeys(presets.ACTION_GROUPS, 0.2)})
    with pytest.raises(ValueError, match="entry_weight"):
        presets.RoundTwo(**{**presets.ROUND1_V2.__dict__, "entry_weight": 3})
    assert presets.ROUND1.target("WAIT") == pytest.approx(0.19) and len(presets.settings(presets.ROUND1_V2)) == 9
    (tmp_path / "bad.json").write_text('{"round_id": "x"}')
    with pytest.raises(ValueError, match="missing keys"):
        presets.load(presets.RoundTwo, str(tmp_path / "bad.json"))
    with pytest.raises(FileNotFoundError):
        presets.load(presets.RoundOne, str(tmp_path / "none.json"))
    assert dataset.round_seed("round1") < 1 << 31


def test_shift_stays_in_range(spark):
    rows = [(f"w{i}", [(a, a + 3, a - 3, a + 1)] * 100) for i, a in enumerate((3, 500, 1019))]
    frame = spark.createDataFrame(rows, f"window_id string, candles {CANDLES}")
    out = dataset.augmented(frame, 20, 1).collect()
    assert all(0 <= c.l and c.h <= 1023 for r in out for c in r.candles[:1])
    assert all((r.delta == 0) == (r.k < 0) for r in out) and len(out) == 63
    assert len({r.window_id for r in out}) == 63
