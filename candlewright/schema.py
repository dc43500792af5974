"""Fixed values and types of candle windows and decisions."""

from __future__ import annotations

# Fixed values.
BIN_MIN, BIN_MAX, N_BINS, DIGITS = 0, 1023, 1024, 4
RR_MIN, RR_MAX = 1, 9
INPUT_CANDLES, FUTURE_CANDLES = 50, 50
WINDOW = INPUT_CANDLES + FUTURE_CANDLES
TOUCH_LOOKBACK = 5
TRENDS = ("UP", "DOWN", "RANGE")
ACTIONS = ("BUY", "SELL", "CANCEL_BUY", "CANCEL_SELL", "WAIT_BUY", "WAIT_SELL", "HOLD")
OUTCOME_ACTIONS = ("BUY", "SELL")
STRUCTURAL_PENALTY, VALUE_PENALTY, SEMANTIC_PENALTY = 0.15, 0.30, 0.2
LABEL_PAD, UNK, BOS, EOS, PAD = -100, 0, 1, 2, 3

#: (trend, zone side, zone case, action) that a valid decision may have.
LEAVES = [
    ("UP", "support", "CONTAINS", "BUY"),
    ("UP", "support", "CONTAINS", "CANCEL_BUY"),
    ("UP", "support", "TOUCH", "BUY"),
    ("UP", "support", "TOUCH", "CANCEL_BUY"),
    ("UP", "support", "NOTOUCH", "WAIT_BUY"),
    ("DOWN", "resistance", "CONTAINS", "SELL"),
    ("DOWN", "resistance", "CONTAINS", "CANCEL_SELL"),
    ("DOWN", "resistance", "TOUCH", "SELL"),
    ("DOWN", "resistance", "TOUCH", "CANCEL_SELL"),
    ("DOWN", "resistance", "NOTOUCH", "WAIT_SELL"),
    ("RANGE", "support", "CONTAINS", "BUY"),
    ("RANGE", "support", "CONTAINS", "CANCEL_BUY"),
    ("RANGE", "support", "TOUCH", "BUY"),
    ("RANGE", "support", "TOUCH", "CANCEL_BUY"),
    ("RANGE", "support", "NOTOUCH", "WAIT_BUY"),
    ("RANGE", "resistance", "CONTAINS", "SELL"),
    ("RANGE", "resistance", "CONTAINS", "CANCEL_SELL"),
    ("RANGE", "resistance", "TOUCH", "SELL"),
    ("RANGE", "resistance", "TOUCH", "CANCEL_SELL"),
    ("RANGE", "resistance", "NOTOUCH", "WAIT_SELL"),
    ("RANGE", None, None, "HOLD"),
]

BARS = "symbol string, ts timestamp, open double, high double, low double, close double"
CANDLE = "struct<o:int,h:int,l:int,c:int>"
PROGRAM = (
    f"candles array<{CANDLE}>, trend string, current_price_bin int, zone_direction string, zone_lower int, zone_upper int, "
    "price_in_zone boolean, good_price_action boolean, action_type string, sl int, rr int, n_structural int, n_value int"
)
