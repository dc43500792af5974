"""The language: golden scores, fast and slow readings agree, semantic rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from candlewright.operators import language, semantics
from tests import plain_reader


def digits(n):
    return " ".join(f"{n:04d}")


def chart(closes):
    bars = [500] * (50 - len(closes)) + list(closes)
    return "<chart> " + " ".join(f"<O_{c}> <H_{c + 3}> <L_{c - 3}> <C_{c}>" for c in bars) + " </chart>"


def think(trend="UP", price=505, zone=("support", 500, 510), inside=True, good=True):
    z = f" <zone_{zone[0]}> {digits(zone[1])} : {digits(zone[2])} </zone_{zone[0]}>" if zone else ""
    return f"<think> <trend>{trend}</trend> <current_price> {digits(price)} </current_price>{z}{' <price_in_zone>' * inside}{' <good_price_action>' * good} </think>"


CHART = chart([505, 506, 507, 508, 505])
BUY = f"<action> BUY SL: {digits(495)} <RR_5> </action>"
CLEAN = f"{CHART} {think()} {BUY}"

# text, well-formed score, violations (None: not looked at)
CASES = {
    "buy": (CLEAN, 1.0, []),
    "cancel": (f"{CHART} {think(good=False)} <action> CANCEL_BUY </action>", 1.0, []),
    "hold": (f"{chart([500])} {think('RANGE', 500, None, False, False)} <action> HOLD </action>", 1.0, []),
    "no price": (CLEAN.replace(f"<current_price> {digits(505)} </current_price> ", ""), 0.70, None),
    "wrong price": (CLEAN.replace(digits(505), digits(504)), 0.70, None),
    "forbidden fields": (f"{CHART} {think()} <action> CANCEL_BUY SL: {digits(495)} <RR_5> </action>", 0.55, None),
    "no stop": (f"{CHART} {think()} <action> BUY </action>", 0.70, None),
    "rr 15": (CLEAN.replace("<RR_5>", "<RR_15>"), 0.55, None),
    "three digits": (CLEAN.replace("SL: 0 4 9 5", "SL: 4 9 5"), 0.70, None),
    "garbage": ("lorem ipsum dolor", 0.55, ["guard"]),
    "empty": ("", 0.55, ["guard"]),
    "null": (None, 0.55, ["guard"]),
    "no chart": (f"{think()} {BUY}", 0.85, ["guard"]),
    "ten candles": (CLEAN.replace(" <O_500> <H_503> <L_497> <C_500>" * 40, ""), 0.70, None),
    "no blanks": (CLEAN.replace(" ", ""), 1.0 - 0.15 * 3, None),
    "trend": (CLEAN.replace("zone_support", "zone_resistance"), 1.0, ["trend_zone", "action"]),
    "side": (f"{chart([505, 506, 507, 508, 480])} {think(price=480, inside=False, good=False)} <action> WAIT_BUY </action>", 1.0, ["side", "price_in_zone"]),
    "geometry": (f"{chart([300, 301, 302, 303, 300])} {think(price=300)} <action> BUY SL: {digits(290)} <RR_5> </action>", 1.0, ["side", "price_in_zone"]),
    "action": (f"{CHART} {think(good=False)} <action> WAIT_BUY </action>", 1.0, ["action"]),
    "range": (f"{chart([500])} {think('RANGE', 500, None, False, False)} <action> WAIT_BUY </action>", 1.0, ["action"]),
}


def test_golden_cases(spark):
    frame = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "name string, text string")
    out = {r.name: r for r in semantics.with_semantics(language.parse_programs(frame)).collect()}
    for name, (_, score, found) in CASES.items():
        assert out[name].wf_score == pytest.approx(score), name
        assert out[name].well_formed == (out[name].n_structural + out[name].n_value == 0)
        if found is not None:
            assert out[name].violations == found, name
            assert out[name].semantic_score == pytest.approx(0 if found == ["guard"] else 1 - 0.2 * len(found))


def test_fast_and_slow_agree(spark):
    rng = random.Random(3)
    texts = [v[0] for v in CASES.values()]
    for _ in range(150):
        words = CLEAN.split(" ")
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], [words[i], words[i]], ["<RR_3>"], ["<O_2000>"], ["7"], ["??"], ["BUYSL:"], [words[i] + "x"]])
        texts.append(rng.choice([" ", "", "\n"]).join(words) if rng.random() < 0.3 else " ".join(words))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in language.parse_clean(frame).where("clean").collect():
        slow = plain_reader.parse(texts[r.i])
        assert slow["n_structural"] + slow["n_value"] == 0, texts[r.i][-200:]
        for k in ("trend", "current_price_bin", "zone_direction", "zone_lower", "zone_upper", "price_in_zone", "good_price_action", "action_type", "sl", "rr"):
            assert slow[k] == r[k]
        assert slow["candles"] == [c.asDict() for c in r.candles]
    clean = {r.i for r in language.parse_clean(frame).where("clean").collect()}
    for i, t in enumerate(texts):
        got = plain_reader.parse(t or "")
        assert (got["n_structural"] + got["n_value"] == 0) == (i in clean), t


def test_intended_action(spark):
    frame = spark.createDataFrame([("x CANCEL_BUY BUY",), ("BUYSL:",), (None,), ("... HOLD",)], "c string")
    assert [r[0] for r in frame.select(language.intended_action(F.col("c"))).collect()] == ["CANCEL_BUY", None, None, "HOLD"]


def test_unknown_text_is_one_token():
    assert plain_reader.lex("foo bar<baz SL:")[0] == "???l$"


def test_unicode_space_and_digits(spark):
    wide = CLEAN.replace(" <think>", "\u00a0<think>").replace("</think> ", "</think>\u2003")
    digit = CLEAN.replace("<O_500>", "<O_\u0665\u0660\u0660>")
    frame = spark.createDataFrame([("wide", wide), ("digit", digit)], "name string, text string")
    for r in language.parse_programs(frame).collect():
        assert r.well_formed and r.candles[0].o == 500, r.name
    words = spark.createDataFrame([("\u00e9BUY",), ("BUY\u00a0",)], "c string")
    assert [r[0] for r in words.select(language.intended_action(F.col("c"))).collect()] == [None, "BUY"]


def test_kind_counts(spark):
    frame = spark.createDataFrame([("a", CLEAN), ("a", None), ("b", "what <O_1>SL:")], "name string, text string")
    got = {(r.name, r.kind): r.n for r in language.kind_counts(frame, "text", "name").collect()}
    assert got["a", "O"] == got["a", "C"] == 50 and got["b", "?"] == got["b", "O"] == got["b", "l"] == 1 and ("a", "?") not in got


def test_any_text_is_read_as_plainly(spark):
    """Random texts of tokens, broken tokens and noise: every field and count as the plain reader has them."""
    rng = random.Random(12)
    bits = [
        "<chart>", "</chart>", "<O_500>", "<H_9>", "<L_01023>", "<C_1024>", "<C_500>", "<O_99999999999999999999>", "<think>", "</think>", "<trend>UP</trend>", "<trend>SIDE</trend>", "<current_price>", "</current_price>",
        "<zone_support>", "</zone_support>", "<zone_resistance>", "</zone_resistance>", "<price_in_zone>", "<good_price_action>", "<action>", "</action>", "BUY", "SELL", "CANCEL_BUY", "HOLD", "SL:", "<RR_3>", "<RR_0>",
        "0", "5", "0 4 9 5", "1 0 2 4", "1023", ":", "?", "x", "_", "é", "½", "٥", "<O_١٠>", "$", "|", "[", "]{}()$", "<O_5", "\n", "\t", " ", "\x1d", "\x0b", "BUYx", "5BUY", "BUY5", "<", ">", "\\1", "${A}",
    ]
    whole = "<O_500> <H_503> <L_497> <C_500>"
    texts = ["", None, "$", "5BUY <action> 5 BUY</action>", "<action>5BUY", "<action>٣5BUY SL:5"]
    for _ in range(700):
        parts = rng.choices(bits, k=rng.randint(1, 25))
        texts.append(rng.choice([" ", "", " "]).join(parts))
    for _ in range(500):  # nearly whole programs
        words = CLEAN.replace(f"{whole} " * 30, "", 1).split(" ") if rng.random() < 0.5 else CLEAN.split(" ")
        for _ in range(rng.randint(1, 6)):
            i = rng.randrange(len(words))
            words[i : i + rng.randint(0, 2)] = rng.choices(bits, k=rng.randint(0, 2))
        texts.append(rng.choice([" ", " ", "", " "]).join(words))
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    rows = language.token_kinds(language.parse_programs(frame)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want, t = plain_reader.parse(texts[r.i] or ""), texts[r.i]
        assert r.kinds == plain_reader.lex(t or "")[0][:-1], repr(t)
        got = {k: r[k] for k in want}
        got["candles"] = None if r.candles is None else [c.asDict() for c in r.candles]
        want["trend"] = want["trend"] or None
        assert got == want, repr(t)


def test_no_python_in_the_reader(spark):
    frame = spark.createDataFrame([("x",)], "text string")
    for out in (language.parse_programs(frame), language.kind_counts(frame, "text")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
