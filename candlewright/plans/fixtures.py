"""Inputs of the queries, built from the driver's tables by arithmetic alone so that SQL can build the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.functions.text import completion
from candlewright.operators.bars import preprocess
from candlewright.operators.generate import leaves
from candlewright.operators.windows import chart_text, encoded_windows
from candlewright.schema import BIN_MAX, INPUT_CANDLES, LEAVES, WINDOW
from candlewright.sources.io import bars_from_events

SCALE = 8.0


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_events(spark.read.parquet(f"{sf}/events.parquet"))


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return preprocess(bars(spark, sf))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return encoded_windows(rows(spark, sf), F.lit(SCALE))


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """One decision of each leaf for each window, some of them breaking a rule."""
    w = windows(spark, sf).select(
        "symbol", "window_no", F.concat_ws("_", "symbol", F.col("window_no").cast("string")).alias("window_id"),
        F.slice("candles", 1, INPUT_CANDLES).alias("candles"), F.slice("candles", INPUT_CANDLES + 1, WINDOW).alias("future"),
    )
    k = F.col("leaf")
    p, width = F.element_at("candles", -1)["c"], 5 + k % 16
    support = F.col("side") == "support"
    edge = F.when(support, p - 3 + k % 7).otherwise(p + 3 - k % 7)
    lower, upper = F.when(support, edge - width).otherwise(edge), F.when(support, edge).otherwise(edge + width)
    zone = F.col("side").isNotNull()
    buy, trade = F.col("leaf_action") == "BUY", F.col("leaf_action").isin("BUY", "SELL")
    out = w.join(F.broadcast(leaves(spark)), how="cross").select(  # 21 leaves
        "symbol", "window_no", "window_id", k.alias("k"), "candles", "future", F.col("leaf_trend").alias("trend"), p.alias("current_price_bin"), F.col("side").alias("zone_direction"),
        F.when(zone, lower).alias("zone_lower"), F.when(zone, upper).alias("zone_upper"), (zone & (k % 3 != 2)).alias("price_in_zone"), trade.alias("good_price_action"),
        F.col("leaf_action").alias("action_type"), F.when(buy, lower - 1 - k % 6).when(trade, upper + 1 + k % 6).alias("sl"), F.when(trade, 1 + k % 9).alias("rr"),
    )
    return out.where(F.coalesce(F.least("zone_lower", "sl"), F.lit(0)) >= 0).where(F.coalesce(F.greatest("zone_upper", "sl"), F.lit(0)) <= BIN_MAX)


def rollouts(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions as prompt and completion text; some spoilt by k."""
    d = decisions(spark, sf)
    text = completion(*[F.col(c) for c in ("trend", "current_price_bin", "zone_direction", "zone_lower", "zone_upper", "price_in_zone", "good_price_action", "action_type", "sl", "rr")])
    spoilt = (
        F.when(F.col("k") % 8 == 1, F.concat(text, F.lit(" BUY")))
        .when(F.col("k") % 8 == 3, F.regexp_replace(text, "</think>", ""))
        .when(F.col("k") % 8 == 5, F.concat(text, F.lit(" <RR_15>")))
        .when(F.col("k") % 8 == 6, F.lit("nothing to see BUYSL: <chart"))
        .when(F.col("k") % 8 == 7, F.regexp_replace(text, " : ", " "))
        .otherwise(text)
    )
    return d.select("symbol", "window_no", "window_id", "k", chart_text(F.col("candles")).alias("prompt"), text.alias("clean_completion"), spoilt.alias("completion"), "future")


# The same in SQL, as chains of common table expressions.
BARS = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY ALL)"""
RANGES = (
    BARS
    + """,
n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars),
t AS (SELECT *, CASE WHEN prev IS NOT NULL THEN greatest(high - low, abs(high - prev), abs(low - prev)) END AS tr FROM n)"""
)
ROWS = (
    RANGES
    + """,
e(symbol, i, atr) AS (SELECT symbol, i, tr FROM t WHERE i = 1 UNION ALL
  SELECT t.symbol, t.i, t.tr * (2::DOUBLE / 101) + e.atr * (1 - 2::DOUBLE / 101) FROM e JOIN t ON t.symbol = e.symbol AND t.i = e.i + 1),
pre AS (SELECT t.symbol, t.ts, t.open, t.high, t.low, t.close, e.atr, t.i - 1 AS row_idx FROM t JOIN e ON t.symbol = e.symbol AND t.i = e.i)"""
)


def quantised(scale: str, more: str = "") -> str:
    """starts and q, the windows' bins. scale: SQL of a row's scale; more: a join that it needs."""
    bins = ", ".join(f"round_even((greatest(least((p.{c} - s.anchor_open) / ({scale} * s.anchor_atr), 1), -1) + 1) / 2 * 1023, 0)::INT AS {c[0]}" for c in ("open", "high", "low", "close"))
    return f""",
starts AS (SELECT a.symbol, row_idx AS start_idx, open AS anchor_open, atr AS anchor_atr, row_number() OVER (PARTITION BY a.symbol ORDER BY row_idx) - 1 AS window_no
  FROM pre a JOIN (SELECT symbol, max(row_idx) AS last FROM pre GROUP BY symbol) b ON a.symbol = b.symbol WHERE row_idx % 50 = 0 AND atr > 0 AND row_idx + 100 <= last + 1),
q AS (SELECT s.symbol, s.window_no, s.start_idx, s.anchor_open, s.anchor_atr, p.row_idx - s.start_idx AS i, p.open AS open, p.high AS high, p.low AS low, p.close AS close,
  {bins} FROM starts s {more} JOIN pre p ON p.symbol = s.symbol AND p.row_idx BETWEEN s.start_idx AND s.start_idx + 99)"""


WINDOWS = ROWS + quantised(f"{SCALE}::DOUBLE")
_LEAVES = ", ".join("({}, {})".format(i, ", ".join("NULL" if x is None else f"'{x}'" for x in leaf)) for i, leaf in enumerate(LEAVES))
LEAF_TABLE = f"leaves AS (SELECT * FROM (VALUES {_LEAVES}) v(k, trend, side, zcase, action))"
DECISIONS = (
    WINDOWS
    + f""",
{LEAF_TABLE},
w AS (SELECT symbol, window_no, symbol || '_' || window_no AS window_id, max(c) FILTER (i = 49) AS p FROM q GROUP BY ALL),
d0 AS (SELECT w.symbol, w.window_no, w.window_id, k, w.p, trend, side, action, 5 + k % 16 AS width, CASE WHEN side = 'support' THEN p - 3 + k % 7 ELSE p + 3 - k % 7 END AS edge FROM w CROSS JOIN leaves),
d1 AS (SELECT *, CASE side WHEN 'support' THEN edge - width WHEN 'resistance' THEN edge END AS lo, CASE side WHEN 'support' THEN edge WHEN 'resistance' THEN edge + width END AS hi FROM d0),
d2 AS (SELECT *, CASE action WHEN 'BUY' THEN lo - 1 - k % 6 WHEN 'SELL' THEN hi + 1 + k % 6 END AS sl FROM d1),
d AS (SELECT symbol, window_no, window_id, k, p, trend, side, lo, hi, side IS NOT NULL AND k % 3 <> 2 AS piz, action IN ('BUY', 'SELL') AS good, action, sl,
    CASE WHEN action IN ('BUY', 'SELL') THEN 1 + k % 9 END AS rr FROM d2 WHERE coalesce(least(lo, sl), 0) >= 0 AND coalesce(greatest(hi, sl), 0) <= 1023)"""
)
SEMANTICS = (
    DECISIONS
    + """,
tch AS (SELECT d.window_id, d.k, coalesce(bool_or(q.l <= d.hi AND q.h >= d.lo), false) AS touch FROM d LEFT JOIN q ON q.symbol = d.symbol AND q.window_no = d.window_no AND q.i BETWEEN 45 AND 49 GROUP BY ALL),
v0 AS (SELECT d.*, touch, (trend = 'UP' AND side IS DISTINCT FROM 'support') OR (trend = 'DOWN' AND side IS DISTINCT FROM 'resistance') AS v1,
    side IS NOT NULL AND CASE WHEN side = 'support' THEN lo > p ELSE hi < p END AS v2, side IS NOT NULL AND hi - lo NOT BETWEEN 5 AND 20 AS v3,
    CASE WHEN side IS NULL THEN piz ELSE (p BETWEEN lo AND hi OR touch) <> piz END AS v4,
    CASE WHEN side IS NULL THEN trend = 'RANGE' AND action <> 'HOLD' WHEN side = 'support' THEN CASE WHEN piz THEN action NOT IN ('BUY', 'CANCEL_BUY') ELSE action <> 'WAIT_BUY' END
      ELSE CASE WHEN piz THEN action NOT IN ('SELL', 'CANCEL_SELL') ELSE action <> 'WAIT_SELL' END END AS v5 FROM d JOIN tch USING (window_id, k)),
sem AS (SELECT *, v1::INT + v2::INT + v3::INT + v4::INT + v5::INT AS nv, nv = 0 AS sem_ok, greatest(0, 1 - 0.2::DOUBLE * nv) AS sem_score FROM v0)"""
)


def outcomes(source: str, entry: str, sl: str, long: str, name: str) -> str:
    """Common table expressions that give stop, best (reach before the stop, null if none) and last close for rows of ``source``."""
    return f""",
{name}_s AS (SELECT x.window_id, x.k, min(q.i - 50) FILTER (CASE WHEN {long} THEN q.l <= {sl} ELSE q.h >= {sl} END) AS stop, max(q.c) FILTER (q.i = 99) AS last_c
  FROM {source} x JOIN q ON q.symbol = x.symbol AND q.window_no = x.window_no AND q.i >= 50 GROUP BY ALL),
{name} AS (SELECT x.window_id, x.k, any_value(stop) AS stop, any_value(last_c) AS last_c, max(CASE WHEN {long} THEN q.h - {entry} ELSE {entry} - q.l END) FILTER (q.i - 50 < coalesce(stop, 1 << 30)) AS best
  FROM {source} x JOIN {name}_s USING (window_id, k) JOIN q ON q.symbol = x.symbol AND q.window_no = x.window_no AND q.i >= 50 GROUP BY ALL)"""


OUTCOMES = (
    SEMANTICS
    + outcomes("sem", "x.p", "x.sl", "x.action = 'BUY'", "run")
    + outcomes("sem", "(CASE WHEN x.side = 'support' THEN x.hi ELSE x.lo END)", "(CASE WHEN x.side = 'support' THEN x.lo - 1 ELSE x.hi + 1 END)", "x.side = 'support'", "prb")
    + """,
o0 AS (SELECT sem.*, run.stop, run.best, run.last_c, prb.best AS pbest, abs(p - sl) AS risk, action = 'BUY' AS lng, CASE WHEN action = 'BUY' THEN p + rr * abs(p - sl) ELSE p - rr * abs(p - sl) END AS far,
    CASE WHEN side = 'support' THEN hi - lo + 1 WHEN side = 'resistance' THEN hi - lo + 1 END AS prisk FROM sem JOIN run USING (window_id, k) JOIN prb USING (window_id, k)),
o1 AS (SELECT *, CASE WHEN risk > 0 THEN greatest(0, least(rr, floor(coalesce(best, -(1 << 30)) / risk)))::INT END AS nf FROM o0),
o2 AS (SELECT o1.*, nf * (nf + 1) / (2.0::DOUBLE * rr) AS earned, (rr - nf) / rr::DOUBLE AS lft,
    (SELECT min(q.i - 50) FROM q WHERE q.symbol = o1.symbol AND q.window_no = o1.window_no AND q.i >= 50 AND CASE WHEN lng THEN q.h - p ELSE p - q.l END >= rr * risk) AS won FROM o1),
o3 AS (SELECT *, CASE WHEN sl IS NULL THEN NULL WHEN risk = 0 OR rr < 1 OR far NOT BETWEEN 0 AND 1023 THEN 'INVALID_SETUP' WHEN nf = rr THEN 'WIN' WHEN stop IS NOT NULL THEN 'LOSS' ELSE 'TIMEOUT' END AS st FROM o2),
o AS (SELECT *, CASE st WHEN 'INVALID_SETUP' THEN 0 WHEN 'WIN' THEN earned WHEN 'LOSS' THEN earned - lft WHEN 'TIMEOUT' THEN earned + lft * (CASE WHEN lng THEN last_c - p ELSE p - last_c END) / risk END::DOUBLE AS rm,
    CASE st WHEN 'WIN' THEN won WHEN 'LOSS' THEN stop END AS ex, CASE WHEN side IS NOT NULL THEN least(9, greatest(0, coalesce(pbest / prisk::DOUBLE, 0))) END::DOUBLE AS probe,
    CASE action WHEN 'BUY' THEN risk BETWEEN 5 AND 20 AND sl < lo WHEN 'SELL' THEN risk BETWEEN 5 AND 20 AND sl > hi ELSE false END AS slv FROM o3)"""
)
# What is wrong with a spoilt rollout: a trailing word, no end of the think block, an unknown word behind, no blocks at all, a zone without its colon
# (one structural error; eight digits where four belong, a value out of range unless the lower edge is 0, and no second number).
WELL_FORM = """(CASE k % 8 WHEN 1 THEN 0.85 WHEN 3 THEN 0.85 WHEN 5 THEN 0.85 WHEN 6 THEN 0.70
  WHEN 7 THEN CASE WHEN side IS NULL THEN 1 ELSE greatest(0, 0.85 - 0.3 * (2 + (lo * 10000 + hi > 1023)::INT)) END ELSE 1 END::DOUBLE)"""
