"""All queries of the window and scoring library, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.operators import bars as B
from candlewright.operators import control, dataset, forward, generate, language, permute, reports, reward, semantics, tokens
from candlewright.operators import windows as W
from candlewright.plans import fixtures as X
from candlewright.plans.presets import ACTION_GROUPS, GATE_PASSED, GROUPS, MODEL_SIZES, ROUND1, ROUND1_V2, ROUND2, SETTINGS, ZONE_GROUPS, settings
from candlewright.plans.shared import shared_dir
from candlewright.schema import EOS, LABEL_PAD
from candlewright.sources import bucketed, io, rollup, shards

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MAX_LENGTH = 240


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _r(c: Column | str) -> Column:
    return F.round(c, 6)


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _ts() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")


_SQL_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"


# --- bars and windows ---------------------------------------------------------------------------------------------


@_query(f"WITH {X.BARS} SELECT symbol, {_SQL_TS}, open, high, low, close FROM bars")
def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return X.bars(spark, sf).select("symbol", _ts(), "open", "high", "low", "close")


@_query(f"WITH {X.RANGES} SELECT symbol, {_SQL_TS}, round(tr, 6) AS tr FROM t")
def true_range(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_true_range(X.bars(spark, sf)).select("symbol", _ts(), _r("tr").alias("tr"))


@_query(f"WITH RECURSIVE {X.ROWS} SELECT symbol, row_idx::BIGINT AS row_idx, round(atr, 6) AS atr FROM pre")
def atr_ema(spark: SparkSession, sf: str) -> DataFrame:
    return X.rows(spark, sf).select("symbol", *_long("row_idx"), _r("atr").alias("atr"))


_DEVIATION = (
    X.ROWS
    + """,
dev AS (SELECT symbol, row_idx, atr, greatest(max(greatest(open, high, low, close)) OVER w - open, open - min(least(open, high, low, close)) OVER w) AS deviation
  FROM pre WINDOW w AS (PARTITION BY symbol ORDER BY row_idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))"""
)


@_query(f"WITH RECURSIVE {_DEVIATION} SELECT symbol, row_idx::BIGINT AS row_idx, round(deviation, 6) AS deviation, round(deviation / atr, 6) AS ratio FROM dev WHERE row_idx >= 1")
def window_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_deviation(X.rows(spark, sf)).select("symbol", *_long("row_idx"), _r("deviation").alias("deviation"), _r("ratio").alias("ratio"))


@_query(f"WITH RECURSIVE {_DEVIATION} SELECT symbol, round(quantile_cont(deviation / atr, 0.999), 6) AS scale FROM dev WHERE row_idx >= 1 GROUP BY symbol")
def scale_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return B.scales(X.rows(spark, sf)).select("symbol", _r("scale").alias("scale"))


@_query("SELECT event_type AS symbol, round(count(*) / 4.0, 2)::DOUBLE AS scale FROM events GROUP BY ALL")
def scale_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    counts = spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").count()
    line = lambda n, c: F.struct(F.lit(n).alias("place"), c.alias("line"))
    log = counts.select(
        F.inline(F.array(line(1, F.concat("event_type", F.lit(": 1.00"))), line(2, F.lit("no colon here")), line(3, F.concat(F.col("event_type"), F.lit(": "), F.format_string("%.2f", F.col("count") / 4)))))
    )
    return io.scales_from_text(log).where("symbol is not null")


@_query(f"WITH RECURSIVE {X.WINDOWS} SELECT symbol, window_no::BIGINT AS window_no, start_idx::BIGINT AS start_idx, round(anchor_open, 6) AS anchor_open, round(anchor_atr, 6) AS anchor_atr FROM starts")
def window_starts(spark: SparkSession, sf: str) -> DataFrame:
    return W.window_starts(X.rows(spark, sf)).select("symbol", *_long("window_no", "start_idx"), _r("anchor_open").alias("anchor_open"), _r("anchor_atr").alias("anchor_atr"))


@_query(f"WITH RECURSIVE {X.WINDOWS} SELECT symbol, window_no::BIGINT AS window_no, i::BIGINT AS i, o::BIGINT AS o, h::BIGINT AS h, l::BIGINT AS l, c::BIGINT AS c FROM q")
def quantized_candles(spark: SparkSession, sf: str) -> DataFrame:
    return X.windows(spark, sf).select("symbol", "window_no", F.posexplode("candles").alias("i", "x")).select("symbol", *_long("window_no", "i"), *[F.col(f"x.{k}").cast("long").alias(k) for k in "ohlc"])


_BY_SCALE = f"""{_DEVIATION},
sc AS (SELECT symbol, quantile_cont(deviation / atr, 0.999) AS scale FROM dev WHERE row_idx >= 1 GROUP BY symbol)""" + X.quantised("sc.scale", "JOIN sc ON sc.symbol = s.symbol")


@_query(f"WITH RECURSIVE {_BY_SCALE} SELECT symbol, window_no::BIGINT AS window_no, sum((i + 1) * (o + 2 * h + 3 * l + 4 * c))::BIGINT AS checksum FROM q GROUP BY ALL")
def quantized_by_scale(spark: SparkSession, sf: str) -> DataFrame:
    """Windows in bins of their own symbol's scale."""
    rows = X.rows(spark, sf)
    w = W.encoded_windows(rows, B.scales(rows)).select("symbol", *_long("window_no"), F.posexplode("candles").alias("i", "x"))
    return w.groupBy("symbol", "window_no").agg(F.sum((F.col("i") + 1) * (F.col("x.o") + 2 * F.col("x.h") + 3 * F.col("x.l") + 4 * F.col("x.c"))).alias("checksum"))


@_query(
    f"""WITH RECURSIVE {X.ROWS}, z AS (SELECT *, max(row_idx) OVER (PARTITION BY symbol) AS last FROM pre)
SELECT symbol, (row_number() OVER (PARTITION BY symbol ORDER BY row_idx) - 1)::BIGINT AS window_no, row_idx::BIGINT AS start_idx FROM z WHERE atr > 0 AND row_idx + 100 <= last + 1"""
)
def validation_windows(spark: SparkSession, sf: str) -> DataFrame:
    return W.window_starts(X.rows(spark, sf), stride=dataset.PRESETS["validation"]["stride"]).select("symbol", *_long("window_no", "start_idx"))


_BACK = f"((c / 1023.0::DOUBLE * 2 - 1) * {X.SCALE}::DOUBLE * anchor_atr + anchor_open)"


@_query(f"WITH RECURSIVE {X.WINDOWS} SELECT symbol, window_no::BIGINT AS window_no, round(max({_BACK}), 6) AS top, round(min({_BACK}), 6) AS bottom FROM q GROUP BY ALL")
def dequantized_range(spark: SparkSession, sf: str) -> DataFrame:
    return W.decoded_prices(X.windows(spark, sf)).groupBy("symbol", F.col("window_no").cast("long").alias("window_no")).agg(_r(F.max("close")).alias("top"), _r(F.min("close")).alias("bottom"))


_PLAIN = "'<chart> ' || string_agg('O_' || o || ' H_' || h || ' L_' || l || ' C_' || c, ' ' ORDER BY i) || ' </chart>'"
_CHART = "'<chart> ' || string_agg('<O_' || o || '> <H_' || h || '> <L_' || l || '> <C_' || c || '>', ' ' ORDER BY i) FILTER (i < 50) || ' </chart>'"


@_query(f"WITH RECURSIVE {X.WINDOWS} SELECT symbol, window_no::BIGINT AS window_no, {_PLAIN} AS text FROM q GROUP BY ALL")
def encoded_window_text(spark: SparkSession, sf: str) -> DataFrame:
    return X.windows(spark, sf).select("symbol", *_long("window_no"), W.plain_text(F.col("candles")).alias("text"))


@_query(f"WITH RECURSIVE {X.WINDOWS} SELECT symbol, window_no::BIGINT AS window_no, sum(i * (o + 2 * h + 3 * l + 4 * c))::BIGINT AS checksum, count(*) AS candles FROM q GROUP BY ALL")
def decoded_window(spark: SparkSession, sf: str) -> DataFrame:
    text = X.windows(spark, sf).select("symbol", "window_no", W.plain_text(F.col("candles")).alias("text"))
    parsed = text.select("symbol", "window_no", F.posexplode(W.parse_window(F.col("text"))).alias("i", "x"))
    weight = F.col("x.o") + 2 * F.col("x.h") + 3 * F.col("x.l") + 4 * F.col("x.c")
    return parsed.groupBy("symbol", F.col("window_no").cast("long").alias("window_no")).agg(F.sum(F.col("i") * weight).cast("long").alias("checksum"), F.count("*").alias("candles"))


# --- datasets -----------------------------------------------------------------------------------------------------

_FUTURE = "string_agg(o || ',' || h || ',' || l || ',' || c, ';' ORDER BY i) FILTER (i >= 50)"


def _bins_text(bins: str) -> Column:
    return F.array_join(F.transform(bins, lambda b: F.array_join(b.cast("array<string>"), ",")), ";")


@_query(f"WITH RECURSIVE {X.WINDOWS} SELECT symbol || '_' || window_no AS window_id, symbol, {_CHART} AS prompt, {_FUTURE} AS future FROM q GROUP BY symbol, window_no")
def grpo_rows(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.prompt_rows(X.windows(spark, sf)).select("window_id", "symbol", "prompt", _bins_text("future_bins").alias("future"))


_PROMPTS, _TEXTS = dataset.PRESETS["train_prompts"], dataset.PRESETS["train_text"]
_DRAW = "('0x' || substr(md5(concat_ws('|', window_id, k, '42')), 1, 8))::BIGINT % greatest(1023 - mx + mn, 1) - mn"


@_query(
    f"""WITH RECURSIVE {X.WINDOWS},
b AS (SELECT symbol, window_no, symbol || '_' || window_no AS window_id, min(l) AS mn, max(h) AS mx FROM q GROUP BY symbol, window_no),
g AS (SELECT b.*, k, CASE WHEN k < 0 THEN 0 ELSE {_DRAW} END AS ch FROM b CROSS JOIN (SELECT unnest(range(-1, {_PROMPTS['augments']})) AS k) WHERE k < 0 OR 1023 - mx + mn > 0)
SELECT CASE WHEN k < 0 THEN window_id ELSE window_id || '_aug' || k END AS window_id, (CASE WHEN k >= 0 AND ch >= 0 THEN ch + 1 ELSE ch END)::BIGINT AS delta FROM g"""
)
def augmented_windows(spark: SparkSession, sf: str) -> DataFrame:
    named = X.windows(spark, sf).withColumn("window_id", F.concat_ws("_", "symbol", F.col("window_no").cast("string")))
    return dataset.augmented(named, _PROMPTS["augments"], _PROMPTS["seed"]).select("window_id", F.col("delta").cast("long").alias("delta"))


@_query(f"WITH RECURSIVE {X.WINDOWS} SELECT symbol || '_' || window_no || '_' || task AS window_id, task AS task_id FROM (SELECT DISTINCT symbol, window_no FROM q) CROSS JOIN (SELECT unnest(['zone', 'action']) AS task)")
def task_expanded(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.task_rows(dataset.prompt_rows(X.windows(spark, sf))).select("window_id", "task_id")


@_query(
    f"""WITH RECURSIVE {X.WINDOWS}, z AS (SELECT symbol, floor((max(start_idx) + 100) * 0.8::DOUBLE) AS cut FROM starts GROUP BY symbol)
SELECT symbol, window_no::BIGINT AS window_no, CASE WHEN start_idx + 100 <= cut THEN 'train' WHEN start_idx >= cut THEN 'val' END AS split FROM starts JOIN z USING (symbol)"""
)
def split_by_time_block(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.split_by_time(X.windows(spark, sf)).select("symbol", *_long("window_no"), "split")


@_query(f"WITH {X.LEAF_TABLE} SELECT k::BIGINT AS leaf, trend, side, zcase AS zone_case, action FROM leaves")
def leaf_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return generate.leaves(spark).select(*_long("leaf"), F.col("leaf_trend").alias("trend"), "side", "zone_case", F.col("leaf_action").alias("action"))


@_query(f"WITH RECURSIVE {X.SEMANTICS} SELECT k::BIGINT AS leaf FROM leaves WHERE k NOT IN (SELECT k FROM sem WHERE sem_ok)")
def leaf_coverage_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Leaves of which the fixture has no valid decision."""
    seen = semantics.with_semantics(X.decisions(spark, sf)).where("semantic_passed").select(F.col("k").alias("leaf")).distinct()
    return generate.leaves(spark).join(seen, "leaf", "left_anti").select(*_long("leaf"))


@_query(
    f"""WITH RECURSIVE {X.WINDOWS},
b AS (SELECT symbol || '_' || window_no AS window_id, min(l) AS mn, max(h) AS mx FROM q WHERE i < 50 GROUP BY symbol, window_no),
g AS (SELECT CASE WHEN k < 0 THEN window_id ELSE window_id || '_aug' || k END AS window_id FROM b CROSS JOIN (SELECT unnest(range(-1, {_TEXTS["augments"]})) AS k) WHERE k < 0 OR 1023 - mx + mn > 0)
SELECT window_id, true AS some, true AS well_formed, true AS semantic_passed, true AS sl_ok, true AS same FROM g"""
)
def generated_samples_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Each variant of each chart has samples, no more than asked for, and each of them reads back as it was drawn and breaks no rule."""
    charts = dataset.chart_rows(X.windows(spark, sf), _TEXTS["augments"], _TEXTS["seed"])
    read = generate.verified(generate.samples(charts, _TEXTS["samples"], _TEXTS["seed"])).withColumn("sl_ok", F.coalesce("sl_ok", F.lit(True)))
    flags = [F.bool_and(c).alias(c) for c in ("well_formed", "semantic_passed", "sl_ok", "same")]
    return read.groupBy("window_id").agg(F.count("*").between(1, _TEXTS["samples"]).alias("some"), *flags)


@_query(
    f"""WITH RECURSIVE {X.WINDOWS}, z AS (SELECT DISTINCT symbol, symbol || '_' || window_no || '_' || task AS window_id, task AS task_id FROM q CROSS JOIN (SELECT unnest(['zone', 'action']) AS task))
SELECT window_id, task_id, (row_number() OVER (ORDER BY md5(window_id || '|' || 42), window_id) - 1)::BIGINT AS place FROM z ORDER BY place LIMIT 25"""
)
def shuffled_tasks_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the seeded shuffle of both tasks."""
    head = dataset.shuffled(dataset.task_rows(dataset.prompt_rows(X.windows(spark, sf))), 42, "window_id").limit(25)
    listed = head.agg(F.collect_list(F.struct("window_id", "task_id")).alias("all"))  # 25 rows
    return listed.select(F.posexplode("all").alias("place", "r")).select("r.*", *_long("place"))


_SHARDS, _EPOCH = 5, 1
_PLACES = f"""{X.WINDOWS},
z AS (SELECT symbol || '_' || window_no || '_' || task AS window_id, row_number() OVER (ORDER BY symbol, window_no, task = 'action') - 1 AS x FROM starts CROSS JOIN (SELECT unnest(['zone', 'action']) AS task)),
m AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / greatest(ceil(sqrt(count(*))), 1))::BIGINT AS b FROM z),
mv(window_id, t, l, r) AS (SELECT window_id, 0, x // b, x % b FROM z, m UNION ALL
  SELECT window_id, t + 1, CASE WHEN t % 2 = 0 THEN (l + ('0x' || substr(md5({42 * 1_000_003 + _EPOCH} || '|' || t % {permute.MOVES} || '|' || r), 1, 8))::BIGINT % a) % a ELSE l END,
    CASE WHEN t % 2 = 1 THEN (r + ('0x' || substr(md5({42 * 1_000_003 + _EPOCH} || '|' || t % {permute.MOVES} || '|' || l), 1, 8))::BIGINT % b) % b ELSE r END
  FROM mv, m WHERE t = 0 OR t % {permute.MOVES} > 0 OR l * b + r >= n),
pl AS (SELECT window_id, l * b + r AS place, ceil(n / {_SHARDS})::BIGINT AS size FROM mv, m WHERE t > 0 AND t % {permute.MOVES} = 0 AND l * b + r < n)
SELECT window_id, place::BIGINT AS place, (place // size)::BIGINT AS shard, (place % size)::BIGINT AS "offset" FROM pl"""


def _dealt(spark: SparkSession, sf: str) -> DataFrame:
    """Both tasks of every window in a seeded order. A row's number is its symbol's begin, twice its window's number and its task's."""
    tasks = F.explode(F.array(*map(F.lit, dataset.TASKS)))
    rows = _stored(W.window_starts(X.rows(spark, sf)).select("symbol", "window_no", tasks.alias("task_id")), "tasks")
    index = F.col("window_no") * len(dataset.TASKS) + F.when(F.col("task_id") == dataset.TASKS[0], 0).otherwise(1)
    numbered, n = permute.numbered_by(rows, "symbol", index)
    named = numbered.withColumn("window_id", F.concat_ws("_", "symbol", F.col("window_no").cast("string"), "task_id"))
    return permute.dealt(named, "__row", n, 42, _EPOCH, _SHARDS).select("window_id", "place", "shard", "offset")


@_query(f"WITH RECURSIVE {_PLACES}")
def shuffled_places(spark: SparkSession, sf: str) -> DataFrame:
    """Place, shard and offset of every task row, found by the row alone."""
    return _dealt(spark, sf)


@_query(f"WITH RECURSIVE {_PLACES} WHERE place // size > 1 OR (place // size = 1 AND place % size >= 3)")
def shuffled_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """An epoch written in shards and taken up again at the fourth row of its second."""
    path = f"{shared_dir(spark)}/epochs-{uuid4().hex}"
    permute.write_epoch(_dealt(spark, sf), path, _EPOCH, _SHARDS)
    return permute.remaining(spark, path, _EPOCH, 1, 3).select("window_id", "place", "shard", "offset")


@_query(f"WITH RECURSIVE {X.WINDOWS} SELECT DISTINCT symbol || '_' || window_no AS window_id FROM q ORDER BY 1 LIMIT 10")
def prompt_rows_head(spark: SparkSession, sf: str) -> DataFrame:
    return dataset.prompt_rows(X.windows(spark, sf)).select("window_id").orderBy("window_id").limit(10)


# --- language -----------------------------------------------------------------------------------------------------


def _digit_sql(c: str) -> str:
    return f"array_to_string(string_split(lpad(({c})::VARCHAR, 4, '0'), ''), ' ')"


_COMPLETION = f"""concat_ws(' ', '<think>', '<trend>' || trend || '</trend>', '<current_price>', {_digit_sql("p")}, '</current_price>',
  CASE WHEN side IS NOT NULL THEN '<zone_' || side || '> ' || {_digit_sql("lo")} || ' : ' || {_digit_sql("hi")} || ' </zone_' || side || '>' END,
  CASE WHEN piz THEN '<price_in_zone>' END, CASE WHEN good THEN '<good_price_action>' END, '</think>', '<action>', action,
  CASE WHEN sl IS NOT NULL THEN 'SL: ' || {_digit_sql("sl")} END, CASE WHEN rr IS NOT NULL THEN '<RR_' || rr || '>' END, '</action>')"""


@_query(f"WITH RECURSIVE {X.DECISIONS} SELECT window_id, k::BIGINT AS k, {_COMPLETION} AS completion FROM d")
def completion_text(spark: SparkSession, sf: str) -> DataFrame:
    return X.rollouts(spark, sf).select("window_id", *_long("k"), F.col("clean_completion").alias("completion"))


@_query(
    f"""WITH RECURSIVE {X.DECISIONS} SELECT window_id, k::BIGINT AS k, trend, p::BIGINT AS current_price_bin, side AS zone_direction, lo::BIGINT AS zone_lower, hi::BIGINT AS zone_upper,
piz AS price_in_zone, good AS good_price_action, action AS action_type, sl::BIGINT AS sl, rr::BIGINT AS rr, true AS clean FROM d"""
)
def parse_fast_fields(spark: SparkSession, sf: str) -> DataFrame:
    text = X.rollouts(spark, sf).withColumn("text", language.assembled(F.col("prompt"), F.col("clean_completion")))
    return language.parse_clean(text).select(
        "window_id", *_long("k", "current_price_bin", "zone_lower", "zone_upper", "sl", "rr"), "trend", "zone_direction", "price_in_zone", "good_price_action", "action_type", "clean"
    )


def _spoilt(spark: SparkSession, sf: str) -> DataFrame:
    text = X.rollouts(spark, sf).withColumn("text", language.assembled(F.col("prompt"), F.col("completion"))).select("window_id", "k", "completion", "text", "future")
    return language.parse_programs(text).withColumn("intended_action", language.intended_action(F.col("completion")))


@_query(f"WITH RECURSIVE {X.DECISIONS} SELECT window_id, k::BIGINT AS k, round({X.WELL_FORM}, 6) AS wf_score FROM d")
def wf_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _spoilt(spark, sf).select("window_id", *_long("k"), _r("wf_score").alias("wf_score"))


@_query(
    f"""WITH RECURSIVE {X.DECISIONS} SELECT action AS intended_action, count(*) AS n, count(*) FILTER ({X.WELL_FORM} = 1) AS well_formed, round(avg(({X.WELL_FORM} = 1)::INT), 6) AS rate
FROM d WHERE k % 8 <> 6 GROUP BY action"""
)
def intended_action_rate(spark: SparkSession, sf: str) -> DataFrame:
    return reports.intended_rates(_spoilt(spark, sf)).withColumn("rate", _r("rate"))


_KINDS = " ".join(f"WHEN regexp_full_match(w, '{p.replace(chr(92) + 'b', '')}') THEN '{k}'" for k, p in language.TOKENS)


@_query(
    f"""WITH RECURSIVE {X.DECISIONS}, pr AS (SELECT symbol, window_no, {_CHART} AS prompt FROM q GROUP BY symbol, window_no), c AS (SELECT *, {_COMPLETION} AS text FROM d),
r AS (SELECT symbol, prompt || ' ' || CASE k % 8 WHEN 1 THEN text || ' BUY' WHEN 3 THEN replace(text, '</think>', '') WHEN 5 THEN text || ' <RR_15>' WHEN 6 THEN 'nothing to see BUYSL: <chart'
  WHEN 7 THEN replace(text, ' : ', ' ') ELSE text END AS text FROM c JOIN pr USING (symbol, window_no)),
lw AS (SELECT symbol, unnest(string_split(text, ' ')) AS w FROM r)
SELECT symbol, CASE {_KINDS} ELSE '?' END AS kind, count(*) AS n FROM lw WHERE w <> '' GROUP BY ALL"""
)
def lex_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    text = X.rollouts(spark, sf).select("symbol", language.assembled(F.col("prompt"), F.col("completion")).alias("text"))
    return language.kind_counts(text, "text", "symbol")


_BINS = "[x::INT FOR x IN regexp_extract_all(t, '<[OHLC]_([0-9]+)>', 1)]"
_CANDLE_BINS = r"<O_([0-9]+)>\s*<H_([0-9]+)>\s*<L_([0-9]+)>\s*<C_([0-9]+)>"
_WHOLE = f"list_filter(regexp_extract_all(t, '{_CANDLE_BINS}'), lambda x: list_max([y::INT FOR y IN regexp_extract_all(x, '_([0-9]+)>', 1)]) <= 1023)"
_PRICE = r"regexp_replace(regexp_extract(t, '<current_price>([0-9 ]*)</current_price>', 1), ' ', '', 'g')"


@_query(
    f"""WITH RECURSIVE {X.DECISIONS}, pr AS (SELECT symbol, window_no, {_CHART} AS prompt FROM q GROUP BY symbol, window_no), whole_text AS (SELECT window_id, k, prompt || ' ' || {_COMPLETION} AS text FROM d JOIN pr USING (symbol, window_no)),
spoilt AS (SELECT window_id, k, CASE k % 6 WHEN 1 THEN regexp_replace(text, '<O_[0-9]+>', '<O_2000>') WHEN 2 THEN regexp_replace(text, '[0-9] </current_price>', CASE WHEN regexp_matches(text, '0 </current_price>') THEN '1' ELSE '0' END || ' </current_price>')
  WHEN 3 THEN regexp_replace(text, ' SL:( [0-9])+', '') WHEN 4 THEN replace(text, ' ', '') WHEN 5 THEN regexp_replace(text, '<chart>.*</chart>', '') ELSE text END AS t FROM whole_text),
seen AS (SELECT window_id, k, regexp_matches(t, '<chart>') AS charted, regexp_matches(t, '<action>\\s*(BUY|SELL)\\s') AND NOT regexp_matches(t, 'SL:') AS bare, regexp_matches(t, '(BUY|SELL)SL:') AS glued,
  len(list_filter({_BINS}, lambda x: x > 1023)) AS beyond, {_WHOLE} AS whole, {_PRICE} AS price FROM spoilt),
read AS (SELECT window_id, k, (NOT charted)::INT + bare::INT + 3 * glued::INT AS n_structural, CASE WHEN charted THEN beyond + (len(whole) <> 50)::INT + (price::INT <> regexp_extract(whole[-1], 'C_([0-9]+)', 1)::INT)::INT ELSE 0 END AS n_value, NOT charted OR glued AS guarded FROM seen)
SELECT window_id, k::BIGINT AS k, n_structural::BIGINT AS n_structural, n_value::BIGINT AS n_value, round(greatest(0, 1 - (0.15::DOUBLE * n_structural + 0.3::DOUBLE * n_value)), 6) AS wf_score, guarded FROM read"""
)
def spoilt_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a candle out of range, another price, a trade without a stop, no blanks or no chart; the SQL counts what it finds in them."""
    whole = language.assembled(F.col("prompt"), F.col("clean_completion"))
    k = F.col("k") % 6
    digit = F.when(F.col("whole").rlike("0 </current_price>"), "1").otherwise("0")
    text = (
        F.when(k == 1, F.concat(F.substring_index("whole", "<O_", 1), F.lit("<O_2000>"), F.regexp_extract("whole", r"^[^_]*_[0-9]+>([\s\S]*)$", 1)))
        .when(k == 2, F.regexp_replace(F.col("whole"), F.lit("[0-9] </current_price>"), F.concat(digit, F.lit(" </current_price>"))))
        .when(k == 3, F.regexp_replace("whole", " SL:( [0-9])+", ""))
        .when(k == 4, F.regexp_replace("whole", " ", ""))
        .when(k == 5, F.regexp_replace("whole", "<chart>.*</chart>", ""))
        .otherwise(F.col("whole"))
    )
    rows = _stored(X.rollouts(spark, sf).withColumn("whole", whole).select("window_id", "k", text.alias("text")), "spoilt")
    read = semantics.with_semantics(language.parse_programs(rows))
    return read.select("window_id", *_long("k", "n_structural", "n_value"), _r("wf_score").alias("wf_score"), F.array_contains("violations", "guard").alias("guarded"))


# --- semantics and outcomes ---------------------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {X.SEMANTICS} SELECT window_id, k::BIGINT AS k, concat_ws(',', CASE WHEN v1 THEN 'trend_zone' END, CASE WHEN v2 THEN 'side' END, CASE WHEN v3 THEN 'width' END, CASE WHEN v4 THEN 'price_in_zone' END, CASE WHEN v5 THEN 'action' END) AS violations FROM sem")
def semantic_violations(spark: SparkSession, sf: str) -> DataFrame:
    return semantics.with_semantics(X.decisions(spark, sf)).select("window_id", *_long("k"), F.array_join("violations", ",").alias("violations"))


@_query(f"WITH RECURSIVE {X.SEMANTICS} SELECT window_id, k::BIGINT AS k, sem_ok AS semantic_passed, round(sem_score, 6) AS semantic_score FROM sem")
def semantic_scores(spark: SparkSession, sf: str) -> DataFrame:
    return semantics.with_semantics(X.decisions(spark, sf)).select("window_id", *_long("k"), "semantic_passed", _r("semantic_score").alias("semantic_score"))


@_query(f"WITH RECURSIVE {X.SEMANTICS} SELECT window_id, k::BIGINT AS k, touch FROM sem WHERE side IS NOT NULL")
def zone_touch_last5(spark: SparkSession, sf: str) -> DataFrame:
    d = X.decisions(spark, sf).where("zone_direction is not null")
    return d.select("window_id", *_long("k"), semantics.touches(F.col("candles"), F.col("zone_lower"), F.col("zone_upper")).alias("touch"))


_TRADES = "sl IS NOT NULL"


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    return X.decisions(spark, sf).where("sl is not null").withColumn("long", F.col("action_type") == "BUY")


def _trade() -> tuple[Column, Column, Column, Column]:
    """entry, stop, future, is long"""
    return tuple(F.col(c) for c in ("current_price_bin", "sl", "future", "long"))


@_query(
    f"""WITH RECURSIVE {X.OUTCOMES}, h AS (SELECT *, (SELECT min(q.i - 50) FROM q WHERE q.symbol = o.symbol AND q.window_no = o.window_no AND q.i >= 50 AND CASE WHEN lng THEN q.h >= far ELSE q.l <= far END) AS tp FROM o WHERE {_TRADES})
SELECT window_id, k::BIGINT AS k, CASE WHEN risk = 0 THEN 'INVALID_SETUP' WHEN stop IS NOT NULL AND stop <= coalesce(tp, 1 << 30) THEN 'LOSS' WHEN tp IS NOT NULL THEN 'WIN' ELSE 'TIMEOUT' END AS status FROM h WHERE far BETWEEN 0 AND 1023"""
)
def first_hit_binary(spark: SparkSession, sf: str) -> DataFrame:
    e, sl, f, long = _trade()
    d = _trades(spark, sf).withColumn("target", forward.target_bin(e, sl, F.col("rr"), long)).where("target is not null")
    return d.select("window_id", *_long("k"), forward.binary_outcome(e, sl, F.col("target"), f, long)["status"].alias("status"))


@_query(f"WITH RECURSIVE {X.OUTCOMES} SELECT window_id, k::BIGINT AS k, st AS status, round(rm, 6) AS r_multiple, ex::BIGINT AS exit_index FROM o WHERE {_TRADES}")
def scaleout_outcome(spark: SparkSession, sf: str) -> DataFrame:
    e, sl, f, long = _trade()
    out = _trades(spark, sf).withColumn("x", forward.scale_out(e, sl, F.col("rr"), f, long))
    return out.select("window_id", *_long("k"), "x.status", _r("x.r_multiple").alias("r_multiple"), F.col("x.exit_index").cast("long").alias("exit_index"))


@_query(f"WITH RECURSIVE {X.OUTCOMES} SELECT window_id, k::BIGINT AS k, round(CASE WHEN risk = 0 THEN 0 ELSE least(9, greatest(0, coalesce(best / risk::DOUBLE, 0))) END::DOUBLE, 6) AS best_r FROM o WHERE {_TRADES}")
def max_favourable_r(spark: SparkSession, sf: str) -> DataFrame:
    e, sl, f, long = _trade()
    return _trades(spark, sf).select("window_id", *_long("k"), _r(forward.best_excursion(e, sl, f, long)).alias("best_r"))


@_query(f"WITH RECURSIVE {X.OUTCOMES} SELECT window_id, k::BIGINT AS k, round(probe, 6) AS probe FROM o")
def zone_probe(spark: SparkSession, sf: str) -> DataFrame:
    d = X.decisions(spark, sf)
    return d.select("window_id", *_long("k"), _r(forward.zone_probe(F.col("zone_direction"), F.col("zone_lower"), F.col("zone_upper"), F.col("future"))).alias("probe"))


@_query(f"WITH RECURSIVE {X.OUTCOMES} SELECT window_id, k::BIGINT AS k, slv AS sl_valid, (CASE WHEN far BETWEEN 0 AND 1023 THEN far END)::BIGINT AS target FROM o WHERE {_TRADES}")
def sl_validity_target(spark: SparkSession, sf: str) -> DataFrame:
    e, sl, _, long = _trade()
    d = _trades(spark, sf)
    ok = forward.sl_valid(F.col("action_type"), e, sl, F.col("zone_lower"), F.col("zone_upper"), 5, 20)
    return d.select("window_id", *_long("k"), ok.alias("sl_valid"), forward.target_bin(e, sl, F.col("rr"), long).cast("long").alias("target"))


# --- rewards and reports ------------------------------------------------------------------------------------------

_REWARD1 = (
    X.OUTCOMES
    + """,
g AS (SELECT *, CASE WHEN action IN ('BUY', 'SELL') THEN st <> 'INVALID_SETUP' WHEN action LIKE 'CANCEL%' THEN side IS NOT NULL ELSE true END AS valid,
  CASE WHEN action IN ('BUY', 'SELL') THEN slv END AS slok FROM o),
r1 AS (SELECT *, sem_ok AND valid AND coalesce(slok, true) AS passed,
  greatest(0, CASE WHEN sem_ok AND NOT valid THEN greatest(0, sem_score - 0.2::DOUBLE) ELSE sem_score END + CASE slok WHEN true THEN 0.2::DOUBLE WHEN false THEN -0.2::DOUBLE ELSE 0 END) AS judged FROM g),
r AS (SELECT *, CASE WHEN NOT passed THEN 1 + judged WHEN action IN ('BUY', 'SELL') THEN 4.5::DOUBLE + rm - 0.65::DOUBLE / risk + 0.05::DOUBLE ELSE 4.5::DOUBLE END AS reward FROM r1)"""
)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    d = semantics.with_semantics(X.decisions(spark, sf)).withColumns({"well_formed": F.lit(True), "wf_score": F.lit(1.0)})
    return reward.reward_one(d, ROUND1, rr_bonus=0.05)


@_query(f"WITH RECURSIVE {_REWARD1} SELECT window_id, k::BIGINT AS k, passed, round(reward, 6) AS reward FROM r")
def reward_v1(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("window_id", *_long("k"), "passed", _r("reward").alias("reward"))


_ZONED = replace(ROUND1, round_id="zoned", zone_scale=0.1)


def _parsed(spark: SparkSession, sf: str, config=ROUND1) -> DataFrame:
    """Spoilt rollouts, read and judged."""
    return semantics.with_semantics(_spoilt(spark, sf), *config.zone_width)


@_query(
    f"""WITH RECURSIVE {_REWARD1}, x AS (SELECT *, {X.WELL_FORM} AS wf FROM r) SELECT window_id, k::BIGINT AS k, wf = 1 AND passed AS passed,
round(CASE WHEN wf < 1 THEN wf WHEN NOT sem_ok THEN 1 + sem_score ELSE {GATE_PASSED} END, 6) AS gate,
round(CASE WHEN wf < 1 THEN wf WHEN NOT passed THEN 1 + judged ELSE 4.5::DOUBLE + coalesce(probe, 0) * 0.1::DOUBLE + CASE WHEN action IN ('BUY', 'SELL') THEN rm - 0.65::DOUBLE / risk ELSE 0 END END, 6) AS reward FROM x"""
)
def reward_v1_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Texts to rewards, with a zone score: rows that fail the first gate, the second, and none."""
    out = reward.reward_one(_parsed(spark, sf), _ZONED)
    return out.select("window_id", *_long("k"), "passed", _r(reward.gate_score()).alias("gate"), _r("reward").alias("reward"))


_MARGINS = ", ".join(f"('{g}', {ROUND1.ranges[g][0]!r}::DOUBLE)" for g in GROUPS)


@_query(
    f"""WITH r AS (SELECT n_name AS round_id, grp, low, 3 + n_nationkey / 10.0::DOUBLE AS bonus, n_regionkey / 10.0::DOUBLE AS zone_scale, 1 + n_nationkey % 5 AS sl_least FROM nation CROSS JOIN (VALUES {_MARGINS}) v(grp, low)),
m AS (SELECT *, bonus - CASE WHEN grp = 'HOLD' THEN 0 ELSE zone_scale END - CASE WHEN grp IN ('BUY', 'SELL') THEN 1 + 0.65::DOUBLE / sl_least ELSE 0 END + low AS worst FROM r)
SELECT round_id, grp, round(worst, 6) AS worst, worst > 2.2::DOUBLE AS holds FROM m"""
)
def round_config_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rounds as rows: does the least pass of each group beat the best failure?"""
    n = F.col("n_nationkey")
    lows = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(ROUND1.ranges[g][0]).alias("low")) for g in GROUPS])
    rounds = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.col("n_name").alias("round_id"), F.inline(lows), (3 + n / 10).alias("pass_bonus"), (F.col("n_regionkey") / 10).alias("zone_scale"),
        F.lit(ROUND1.sl_bonus).alias("sl_bonus"), F.lit(ROUND1.fee_bins).alias("fee_bins"), (1 + n % 5).alias("sl_least"),
    )
    return reward.pass_margins(rounds).select("round_id", "grp", _r("worst").alias("worst"), "holds")


_REWARD2 = (
    X.OUTCOMES.replace("hi - lo NOT BETWEEN 5 AND 20", "hi - lo NOT BETWEEN 10 AND 40")
    + """,
x0 AS (SELECT o.*, task, action IN ('BUY', 'SELL') AS trade, coalesce(slv, false) AS ok FROM o CROSS JOIN (SELECT unnest(['zone', 'action']) AS task)),
x AS (SELECT *, sem_ok AND task = 'action' AND (ok OR NOT trade) AS task_ok,
  CASE WHEN NOT sem_ok THEN 1 + sem_score WHEN task = 'zone' THEN 4.5::DOUBLE + coalesce(probe, 0) * 0.1::DOUBLE WHEN NOT trade THEN 4.5
  WHEN NOT ok THEN 1 + greatest(0, sem_score - 0.2::DOUBLE) ELSE 4.5::DOUBLE + 0.2::DOUBLE * least(9, greatest(0, coalesce(best / risk::DOUBLE, 0))) + rm - 0.65::DOUBLE / risk END::DOUBLE AS reward FROM x0)"""
)


def _tasks(spark: SparkSession, sf: str, buff: bool = False) -> DataFrame:
    """Decisions of both tasks, scored by round two; buff: with the buffs that a new round starts from, found by key."""
    d = semantics.with_semantics(X.decisions(spark, sf), *ROUND1_V2.zone_width).withColumns({"well_formed": F.lit(True), "wf_score": F.lit(1.0)})
    tasks = d.withColumn("task_id", F.explode(F.array(F.lit("zone"), F.lit("action"))))
    if buff:
        tasks = control.with_buff(tasks, reward.buff_key_two(), control.seeded(_settings(spark, ROUND1_V2)))
    return reward.reward_two(tasks, ROUND1_V2, F.col("buff") if buff else None)


@_query(f"WITH RECURSIVE {_REWARD2} SELECT window_id, k::BIGINT AS k, task AS task_id, round(reward, 6) AS reward FROM x")
def reward_v2(spark: SparkSession, sf: str) -> DataFrame:
    return _tasks(spark, sf).select("window_id", *_long("k"), "task_id", _r("reward").alias("reward"))


_SURPRISE = """y AS (SELECT *, {eligible} AS el FROM {rows}),
z AS (SELECT *, count(*) FILTER (el) OVER (PARTITION BY window_id) AS n, count(*) FILTER (el) OVER (PARTITION BY window_id, rr) AS c FROM y),
s AS (SELECT *, CASE WHEN el AND n >= 2 THEN -ln(c / n::DOUBLE) * 0.1::DOUBLE ELSE 0 END::DOUBLE AS bonus FROM z)"""


@_query(
    f"""WITH RECURSIVE {_REWARD2}, {_SURPRISE.format(rows="x", eligible="task = 'action' AND sem_ok AND rr IS NOT NULL")}
SELECT window_id, k::BIGINT AS k, task AS task_id, round(reward + CASE WHEN task_ok AND trade THEN 0.2::DOUBLE ELSE 0 END + bonus, 6) AS reward FROM s"""
)
def reward_v2_shaped(spark: SparkSession, sf: str) -> DataFrame:
    """A batch of round two: buffs by key, then shaping within each prompt, trades with a stop out of place included."""
    out = reward.shaped(_tasks(spark, sf, buff=True), "window_id", reward.eligible_two(), 0.1)
    return out.select("window_id", *_long("k"), "task_id", _r("reward").alias("reward"))


@_query(f"""WITH RECURSIVE {_REWARD1}, {_SURPRISE.format(rows="r", eligible="passed AND rr IS NOT NULL")} SELECT window_id, k::BIGINT AS k, round(reward + bonus, 6) AS reward FROM s""")
def reward_v1_shaped(spark: SparkSession, sf: str) -> DataFrame:
    out = reward.shaped(_scored(spark, sf), "window_id", F.col("passed"), 0.1)
    return out.select("window_id", *_long("k"), _r("reward").alias("reward"))


@_query(
    f"""WITH RECURSIVE {_REWARD2} SELECT trend, action AS action_type, count(*) AS n, round(avg(CASE WHEN trade THEN rm END), 6) AS avg_r, round(avg(CASE WHEN trade THEN (rm > 0)::INT END), 6) AS win_rate, round(avg(rr), 6) AS avg_rr,
round(count(*) / sum(count(*)) OVER (PARTITION BY trend), 6) AS share FROM x WHERE task_ok GROUP BY trend, action"""
)
def stats_v2(spark: SparkSession, sf: str) -> DataFrame:
    where = F.col("well_formed") & F.col("semantic_passed") & (F.col("task_id") == "action") & F.col("task_passed")
    return reports.trend_action(_tasks(spark, sf), where).select("trend", "action_type", "n", *[_r(c).alias(c) for c in ("avg_r", "win_rate", "avg_rr", "share")])


@_query(
    f"""WITH RECURSIVE {_REWARD2}, y AS (SELECT CASE WHEN side IS NULL THEN 'NO_ZONE' ELSE 'HAS_ZONE' END AS grp FROM x WHERE sem_ok AND task = 'zone')
SELECT g AS grp, count(y.grp) AS n, round(count(y.grp) / greatest(sum(count(y.grp)) OVER (), 1), 6) AS ratio FROM (SELECT unnest({list(ZONE_GROUPS)}) AS g) LEFT JOIN y ON y.grp = g GROUP BY g"""
)
def zone_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    gate = F.col("well_formed") & F.col("semantic_passed")
    return reports.task_counts(_tasks(spark, sf), "zone", reward.buff_key_two(), gate, ZONE_GROUPS).withColumn("ratio", _r("ratio"))


@_query(
    f"""WITH RECURSIVE {X.SEMANTICS.replace("hi - lo NOT BETWEEN 5 AND 20", "hi - lo NOT BETWEEN 10 AND 40")}, y AS (SELECT *, {X.WELL_FORM} = 1 AS wf FROM sem)
SELECT task AS task_id, count(*) AS n, round(avg(wf::INT), 6) AS well_formed, round(avg(CASE WHEN wf THEN sem_ok::INT END), 6) AS semantic FROM y CROSS JOIN (SELECT unnest(['zone', 'action']) AS task) GROUP BY task"""
)
def task_funnel(spark: SparkSession, sf: str) -> DataFrame:
    both = _parsed(spark, sf, ROUND1_V2).withColumn("task_id", F.explode(F.array(F.lit("zone"), F.lit("action"))))
    return reports.funnel(both).select("task_id", "n", _r("well_formed").alias("well_formed"), _r("semantic").alias("semantic"))


@_query(
    f"""WITH RECURSIVE {_REWARD1}, y AS (SELECT window_id, rr, count(*) AS c, sum(count(*)) OVER (PARTITION BY window_id) AS n FROM r WHERE passed AND rr IS NOT NULL GROUP BY window_id, rr)
SELECT window_id, round(-sum(c / n::DOUBLE * ln(c / n::DOUBLE)), 6) + 0 AS entropy, sum(c)::BIGINT AS n FROM y GROUP BY window_id"""
)
def rr_entropy_by_prompt(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.entropy(_scored(spark, sf).where("passed"), "rr", "window_id")
    return out.select("window_id", (_r("entropy") + 0).alias("entropy"), *_long("n"))


@_query(f"""WITH RECURSIVE {_REWARD1}, {_SURPRISE.format(rows="r", eligible="passed AND rr IS NOT NULL")} SELECT window_id, k::BIGINT AS k, round(bonus, 6) + 0 AS bonus FROM s""")
def rr_surprisal_bonus(spark: SparkSession, sf: str) -> DataFrame:
    out = reward.rr_entropy(_scored(spark, sf), "window_id", F.col("passed"), 0.1)
    return out.select("window_id", *_long("k"), (_r("bonus") + 0).alias("bonus"))


def _records(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).withColumns({"r_multiple": F.when(F.col("passed"), F.col("outcome.r_multiple")), "status": F.when(F.col("passed"), F.col("outcome.status")), "step": (F.col("k") % 7).cast("long")}).withColumn(
        "r_net", F.col("r_multiple") - F.lit(ROUND1.fee_bins) / F.abs(F.col("current_price_bin") - F.col("sl"))
    )


_RECORDS = _REWARD1 + ", rec AS (SELECT *, CASE WHEN passed AND sl IS NOT NULL THEN rm END AS rmul, CASE WHEN passed AND sl IS NOT NULL THEN st END AS status, CASE WHEN passed AND sl IS NOT NULL THEN rm - 0.65::DOUBLE / risk END AS rnet, k % 7 AS step FROM r)"


@_query(
    f"""WITH RECURSIVE {_RECORDS} SELECT trend, action AS action_type, count(*) AS n, round(avg(rmul), 6) AS avg_r, round(avg((rmul > 0)::INT), 6) AS win_rate, round(avg(rr), 6) AS avg_rr,
round(count(*) / sum(count(*)) OVER (PARTITION BY trend), 6) AS share FROM rec WHERE passed GROUP BY trend, action"""
)
def stats_trend_action(spark: SparkSession, sf: str) -> DataFrame:
    return reports.trend_action(_records(spark, sf), F.col("passed")).select("trend", "action_type", "n", *[_r(c).alias(c) for c in ("avg_r", "win_rate", "avg_rr", "share")])


@_query(f"WITH RECURSIVE {_RECORDS}, y AS (SELECT trend, action, rr, count(*) AS c FROM rec WHERE passed AND rr IS NOT NULL GROUP BY ALL) SELECT trend, action AS action_type, string_agg(rr || ':' || c, ',' ORDER BY rr) AS histogram FROM y GROUP BY trend, action")
def rr_histogram(spark: SparkSession, sf: str) -> DataFrame:
    out = reports.rr_histogram(_records(spark, sf), F.col("passed"))
    shown = F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("trend", "action_type", shown.alias("histogram"))


_GROUP = "CASE WHEN action LIKE 'CANCEL%' THEN 'CANCEL' WHEN action LIKE 'WAIT%' THEN 'WAIT' ELSE action END"


@_query(
    f"""WITH RECURSIVE {_RECORDS}, y AS (SELECT {_GROUP} AS grp, action AS action_type, count(*) AS n FROM rec WHERE passed GROUP BY ROLLUP (1, 2))
SELECT * FROM y UNION ALL SELECT g, NULL, 0 FROM (SELECT unnest({list(GROUPS)}) AS g) WHERE g NOT IN (SELECT grp FROM y WHERE grp IS NOT NULL)"""
)
def group_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return reports.group_rollup(_records(spark, sf), F.col("passed"))


_EVAL = _REWARD1 + f""",
ev AS (SELECT *, {X.WELL_FORM} = 1 AS wf, sem_ok AND valid AS judged_ok, action IN ('BUY', 'SELL') AS trade FROM r1)"""


def _evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return reports.eval_records(_parsed(spark, sf), forward.outcome(F.col("future"), *ROUND1.sl_distance), ROUND1.fee_bins)


@_query(
    f"""WITH RECURSIVE {_EVAL}, both_gates AS (SELECT * FROM ev WHERE wf AND judged_ok) SELECT trend, action AS action_type, count(*) AS n, round(avg(CASE WHEN trade THEN rm END), 6) AS gross_r, round(avg(CASE WHEN trade THEN rm - 0.65::DOUBLE / risk END), 6) AS net_r,
round(avg(CASE WHEN trade THEN (st = 'WIN')::INT END), 6) AS win, round(avg(CASE WHEN trade THEN (st = 'LOSS')::INT END), 6) AS loss, round(avg(CASE WHEN trade THEN (st = 'TIMEOUT')::INT END), 6) AS timeout
FROM both_gates GROUP BY GROUPING SETS ((trend, action), ())"""
)
def eval_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.eval_summary(_evaluated(spark, sf)).select("trend", "action_type", "n", *[_r(c).alias(c) for c in ("gross_r", "net_r", "win", "loss", "timeout")])


@_query(
    f"""WITH RECURSIVE {_EVAL} SELECT count(*) AS n, round(count(*) FILTER (wf) / greatest(count(*), 1), 6) AS well_form_rate, round(count(*) FILTER (wf AND judged_ok) / greatest(count(*) FILTER (wf), 1), 6) AS semantic_rate_given_well_formed,
round(count(*) FILTER (wf AND judged_ok) / greatest(count(*), 1), 6) AS semantic_rate FROM ev"""
)
def eval_rates(spark: SparkSession, sf: str) -> DataFrame:
    return reports.eval_rates(_evaluated(spark, sf)).select("n", *[_r(c).alias(c) for c in ("well_form_rate", "semantic_rate_given_well_formed", "semantic_rate")])


def _number(c: str, places: int) -> str:
    return f"coalesce(printf('%.{places}f', round(round({c}, 6), {places})), '-')"


@_query(
    f"""WITH RECURSIVE {_RECORDS}, y AS (SELECT trend, action, count(*) AS n, avg(rmul) AS r, avg((rmul > 0)::INT) * 100 AS w, avg(rr) AS q, count(*) / sum(count(*)) OVER (PARTITION BY trend) * 100 AS s FROM rec WHERE passed GROUP BY trend, action)
SELECT trend, action AS action_type, rpad(action, 12, ' ') || '  count=' || n || '  freq=' || {_number("s", 1)} || '%  avg_R=' || {_number("r", 2)} || '  win_rate=' || {_number("w", 0)} || '  avg_RR=' || {_number("q", 2)} AS line FROM y"""
)
def printed_report(spark: SparkSession, sf: str) -> DataFrame:
    return reports.report_lines(reports.trend_action(_records(spark, sf), F.col("passed")))


def _percent(c: str, places: int = 1) -> str:
    return f"{_number(f'({c}) * 100', places)} || '%'"


@_query(
    f"""WITH RECURSIVE {_EVAL}, rt AS (SELECT count(*) AS n, count(*) FILTER (wf) / greatest(count(*), 1) AS w, count(*) FILTER (wf AND judged_ok) / greatest(count(*) FILTER (wf), 1) AS sw, count(*) FILTER (wf AND judged_ok) / greatest(count(*), 1) AS sa FROM ev),
su AS (SELECT trend, action, count(*) AS n, avg(CASE WHEN trade THEN rm END) AS g, avg(CASE WHEN trade THEN rm - 0.65::DOUBLE / risk END) AS net, avg(CASE WHEN trade THEN (st = 'WIN')::INT END) AS win, avg(CASE WHEN trade THEN (st = 'TIMEOUT')::INT END) AS tout
  FROM ev WHERE wf AND judged_ok GROUP BY trend, action)
SELECT 'rates' AS section, NULL AS trend, 'n_samples' AS action_type, 'n_samples = ' || n AS line FROM rt UNION ALL
SELECT 'rates', NULL, 'well_form_rate', 'well_form_rate = ' || {_percent("w")} FROM rt UNION ALL
SELECT 'rates', NULL, 'semantic_pass_rate_given_well_formed', 'semantic_pass_rate_given_well_formed = ' || {_percent("sw")} FROM rt UNION ALL
SELECT 'rates', NULL, 'semantic_pass_rate_overall', 'semantic_pass_rate_overall = ' || {_percent("sa")} FROM rt UNION ALL
SELECT 'outcome', trend, action, rpad(action, 12, ' ') || '  count=' || n || '  avg_R_gross=' || {_number("g", 3)} || '  avg_R_net=' || {_number("net", 3)} || '  win_rate=' || {_percent("win", 0)} || '  timeout=' || {_percent("tout", 0)} FROM su"""
)
def printed_eval(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stored(_evaluated(spark, sf).select("well_formed", "semantic_passed", "trend", "action_type", "status", "r_multiple", "r_net"), "evaluated")
    return reports.eval_lines(reports.eval_rates(rows), reports.eval_summary(rows))


@_query(
    f"""WITH RECURSIVE {_REWARD2}, ok AS (SELECT * FROM x WHERE task_ok), rr AS (SELECT trend, action, string_agg(rr || ':' || c, ' ' ORDER BY rr) AS dist FROM (SELECT trend, action, rr, count(*) AS c FROM ok WHERE rr IS NOT NULL GROUP BY ALL) GROUP BY ALL),
st AS (SELECT trend, action, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY trend) AS s, avg(CASE WHEN trade THEN rm END) AS r, avg(CASE WHEN trade THEN (rm > 0)::INT END) AS w, avg(rr) AS q FROM ok GROUP BY trend, action),
gr AS (SELECT 'action' AS section, g, count(x.k) AS n FROM (SELECT unnest({list(ACTION_GROUPS)}) AS g) LEFT JOIN x ON x.action = g AND sem_ok AND task = 'action' GROUP BY g
  UNION ALL SELECT 'zone', g, count(x.k) FROM (SELECT unnest({list(ZONE_GROUPS)}) AS g) LEFT JOIN x ON (x.side IS NULL) = (g = 'NO_ZONE') AND sem_ok AND task = 'zone' GROUP BY g)
SELECT 'tasks' AS section, NULL AS trend, task AS name, rpad(task, 12, ' ') || '  n=' || count(*) || '  well_form_rate=100.0%  semantic_pass_rate=' || {_percent("avg(sem_ok::INT)")} AS line FROM x GROUP BY task UNION ALL
SELECT 'outcome', trend, action, rpad(action, 12, ' ') || '  count=' || n || '  freq=' || {_percent("s")} || '  avg_R=' || {_number("r", 2)} || '  win_rate=' || {_percent("w", 0)} || '  avg_RR=' || {_number("q", 2)} || coalesce('  rr_dist=[' || dist || ']', '') FROM st LEFT JOIN rr USING (trend, action) UNION ALL
SELECT section, NULL, g, rpad(g, 12, ' ') || '  count=' || n || '  ratio=' || {_percent("n / greatest(sum(n) OVER (PARTITION BY section), 1)")} FROM gr UNION ALL
SELECT 'intended', NULL, action, rpad(action, 12, ' ') || '  total=' || count(*) || '  well_formed=' || count(*) || '  rate=100.0%' FROM x GROUP BY action"""
)
def printed_round_two(spark: SparkSession, sf: str) -> DataFrame:
    """The second round's report; its decisions are all well-formed and mean what they say."""
    rows = _tasks(spark, sf).select("task_id", "trend", "action_type", F.col("action_type").alias("intended_action"), "well_formed", "semantic_passed", "task_passed", "r_multiple", "rr", reward.buff_key_two().alias("zone"))
    return reports.round_two_lines(_stored(rows, "tasks"), F.col("zone"))


@_query(
    f"""WITH RECURSIVE {X.OUTCOMES} SELECT window_id, k::BIGINT AS k, lo::BIGINT AS zone_lower, hi::BIGINT AS zone_upper, p::BIGINT AS price, sl::BIGINT AS sl, (CASE WHEN far BETWEEN 0 AND 1023 THEN far END)::BIGINT AS target,
i::BIGINT AS i, q.o::BIGINT AS o, q.h::BIGINT AS h, q.l::BIGINT AS l, q.c::BIGINT AS close, q.c >= q.o AS rising FROM o JOIN q USING (symbol, window_no) WHERE sem_ok AND i < 50"""
)
def plot_table(spark: SparkSession, sf: str) -> DataFrame:
    d = semantics.with_semantics(X.decisions(spark, sf)).withColumn("well_formed", F.lit(True))
    target = forward.target_bin(F.col("current_price_bin"), F.col("sl"), F.col("rr"), F.col("action_type") == "BUY")
    numbers = ("k", "zone_lower", "zone_upper", "price", "sl", "target", "i", "o", "h", "l", "close")
    return reports.plot_table(d, target).select("window_id", *_long(*numbers), "rising")


@_query(f"WITH RECURSIVE {_RECORDS} SELECT action AS key, count(*) AS n FROM rec WHERE passed AND step > 3 GROUP BY action")
def counts_since_step(spark: SparkSession, sf: str) -> DataFrame:
    return reports.count_by(_records(spark, sf), F.col("action_type"), F.col("passed"), since=3)


# --- controllers --------------------------------------------------------------------------------------------------


_LOGGED = "passed boolean, trend string, action_type string, r_multiple double, rr int"


def _shards(spark: SparkSession, sf: str) -> DataFrame:
    kept = _records(spark, sf).select("step", F.pmod(F.crc32(F.col("window_id").cast("binary")), F.lit(3)).alias("rank"), *[f.split()[0] for f in _LOGGED.split(", ")])
    return _stored(kept, "records")


def _logged(spark: SparkSession, sf: str) -> str:
    """A log of which step 1 was written twice, step 3 first by rank 0 alone and cut short, and the others once."""
    log, rows = f"{shared_dir(spark)}/log-{uuid4().hex}", _shards(spark, sf)
    shards.append_shards(rows.where("step < 3 or (step = 3 and rank = 0 and not passed)"), log, ROUND1.round_id)
    shards.append_shards(rows.where("step = 1 or step >= 3"), log, ROUND1.round_id)
    return log


def _rolled(spark: SparkSession, sf: str) -> str:
    """Sums brought up to date before and after late and repeated steps."""
    folder, rows = f"{shared_dir(spark)}/rollup-{uuid4().hex}", _shards(spark, sf)
    for part in ("step in (0, 1, 5) or (step = 3 and rank = 0 and not passed)", "step = 1 or step in (2, 3, 4, 6)"):
        shards.append_shards(rows.where(part), f"{folder}/log", ROUND1.round_id)
        rollup.refresh(spark, f"{folder}/log", f"{folder}/sums", ROUND1.round_id, F.col("passed"), _LOGGED)
    return f"{folder}/sums"


@_query(f"WITH RECURSIVE {_RECORDS} SELECT step::BIGINT AS step, action AS action_type, count(*) AS n, round(sum(rmul), 6) AS total_r, sum(rr)::BIGINT AS total_rr FROM rec GROUP BY ALL")
def shard_log(spark: SparkSession, sf: str) -> DataFrame:
    """What is read back, checked by digests, from a log with repeated shards."""
    rows = shards.read_shards(spark, _logged(spark, sf), ROUND1.round_id, schema=_LOGGED)
    return rows.groupBy("step", "action_type").agg(F.count("*").alias("n"), _r(F.sum("r_multiple")).alias("total_r"), F.sum("rr").alias("total_rr"))


@_query(_SQL["stats_trend_action"])
def rollup_trend_action(spark: SparkSession, sf: str) -> DataFrame:
    sums = rollup.partials(spark, _rolled(spark, sf), ROUND1.round_id)
    return rollup.trend_action(sums).select("trend", "action_type", "n", *[_r(c).alias(c) for c in ("avg_r", "win_rate", "avg_rr", "share")])


@_query(_SQL["group_rollup"])
def rollup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.group_rollup(rollup.partials(spark, _rolled(spark, sf), ROUND1.round_id))


@_query(_SQL["counts_since_step"])
def rollup_since_step(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.counts(rollup.partials(spark, _rolled(spark, sf), ROUND1.round_id, since=3))


def _settings(spark: SparkSession, config=ROUND2) -> DataFrame:
    return spark.createDataFrame(settings(config), SETTINGS)


_SETTINGS = ", ".join(f"('{g}', {ROUND2.target(g)!r}::DOUBLE, {ROUND2.ranges[g][0]!r}::DOUBLE, {ROUND2.ranges[g][1]!r}::DOUBLE, {ROUND2.init[g]!r}::DOUBLE)" for g in GROUPS)


@_query(
    f"""WITH RECURSIVE {_RECORDS}, cfg AS (SELECT * FROM (VALUES {_SETTINGS}) v(grp, target, low, high, init)),
tot AS (SELECT step, count(*) FILTER (passed) AS total FROM rec GROUP BY step),
mine AS (SELECT step, {_GROUP} AS grp, count(*) AS n FROM rec WHERE passed GROUP BY ALL),
rate AS (SELECT cfg.*, tot.step, CASE WHEN total > 0 THEN coalesce(n, 0) / total::DOUBLE END AS rate FROM cfg CROSS JOIN tot LEFT JOIN mine ON mine.step = tot.step AND mine.grp = cfg.grp),
c(grp, step, ema, buff, err) AS (SELECT grp, -1::BIGINT, target, init, 0::DOUBLE FROM cfg UNION ALL
  SELECT rate.grp, rate.step, coalesce(0.1::DOUBLE * rate + 0.9::DOUBLE * ema, ema),
    CASE WHEN rate IS NULL THEN buff ELSE greatest(low, least(high, buff + greatest(-0.0002::DOUBLE, least(0.0002::DOUBLE, 0.02::DOUBLE * (target - (0.1::DOUBLE * rate + 0.9::DOUBLE * ema)) + 0.01::DOUBLE * (target - (0.1::DOUBLE * rate + 0.9::DOUBLE * ema) - err))))) END,
    CASE WHEN rate IS NULL THEN err ELSE target - (0.1::DOUBLE * rate + 0.9::DOUBLE * ema) END FROM c JOIN rate ON rate.grp = c.grp AND rate.step = c.step + 1)
SELECT grp, step::BIGINT AS step, round(ema, 6) AS ema, round(buff, 6) AS buff FROM c WHERE step >= 0"""
)
def pd_controller_trace(spark: SparkSession, sf: str) -> DataFrame:
    fixed = _settings(spark).drop("namespace")
    rates = control.step_rates(_records(spark, sf), reward.action_group(F.col("action_type")), fixed, F.col("passed"))
    return control.pd_trace(rates, fixed, ["grp"]).select("grp", "step", _r("ema").alias("ema"), _r("buff").alias("buff"))


_SETTINGS2 = ", ".join(f"('{n}', '{g}', {', '.join(f'{v!r}::DOUBLE' for v in rest)})" for n, g, *rest in settings(ROUND1_V2))


@_query(
    f"""WITH RECURSIVE {_REWARD2}, cfg AS (SELECT * FROM (VALUES {_SETTINGS2}) v(namespace, grp, target, low, high, init, alpha, kp, kd, top)),
m AS (SELECT task AS namespace, k % 7 AS step, CASE WHEN task = 'action' THEN action WHEN side IS NULL THEN 'NO_ZONE' ELSE 'HAS_ZONE' END AS grp, sem_ok AND (task = 'zone' OR task_ok) AS counted FROM x),
tot AS (SELECT namespace, step, count(*) FILTER (counted) AS total FROM m GROUP BY ALL), mine AS (SELECT namespace, step, grp, count(*) AS n FROM m WHERE counted GROUP BY ALL),
rate AS (SELECT cfg.*, tot.step, CASE WHEN total > 0 THEN coalesce(n, 0) / total::DOUBLE END AS rate FROM cfg JOIN tot USING (namespace) LEFT JOIN mine ON mine.step = tot.step AND mine.grp = cfg.grp AND mine.namespace = cfg.namespace),
c(namespace, grp, step, ema, buff, err) AS (SELECT namespace, grp, -1::BIGINT, target, init, 0::DOUBLE FROM cfg UNION ALL
  SELECT r.namespace, r.grp, r.step, coalesce((1 - alpha) * rate + alpha * ema, ema),
    CASE WHEN rate IS NULL THEN buff ELSE greatest(low, least(high, buff + greatest(-top, least(top, kp * (target - ((1 - alpha) * rate + alpha * ema)) + kd * (target - ((1 - alpha) * rate + alpha * ema) - err))))) END,
    CASE WHEN rate IS NULL THEN err ELSE target - ((1 - alpha) * rate + alpha * ema) END FROM c JOIN rate r ON r.namespace = c.namespace AND r.grp = c.grp AND r.step = c.step + 1)
SELECT namespace, grp, step::BIGINT AS step, round(ema, 6) AS ema, round(buff, 6) AS buff FROM c WHERE step >= 0"""
)
def pd_controller_v2(spark: SparkSession, sf: str) -> DataFrame:
    """Two controllers, one for each task, each with its own groups and gains."""
    fixed = _settings(spark, ROUND1_V2)
    rows = _tasks(spark, sf).withColumns({"namespace": F.col("task_id"), "step": (F.col("k") % 7).cast("long")})
    counted = F.col("well_formed") & F.col("semantic_passed") & ((F.col("task_id") == "zone") | F.col("task_passed"))
    rates = control.step_rates(rows, reward.buff_key_two(), fixed, counted, ("namespace",))
    return control.pd_trace(rates, fixed, ["namespace", "grp"]).select("namespace", "grp", "step", _r("ema").alias("ema"), _r("buff").alias("buff"))


_BUFFS = " ".join(f"WHEN '{g}' THEN {ROUND2.init[g]!r}::DOUBLE" for g in GROUPS if g != "WAIT")


@_query(f"WITH RECURSIVE {X.DECISIONS} SELECT window_id, k::BIGINT AS k, CASE {_GROUP} {_BUFFS} ELSE 0 END AS buff FROM d")
def buff_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The buff of each decision's group, from a state that lacks one group."""
    state = control.seeded(_settings(spark)).where("grp <> 'WAIT'")
    return control.with_buff(X.decisions(spark, sf), reward.action_group(F.col("action_type")), state).select("window_id", *_long("k"), "buff")


_READINGS = f"""{_RECORDS}, y AS (SELECT step, window_id, rr, count(*) AS c, sum(count(*)) OVER (PARTITION BY step, window_id) AS n FROM rec WHERE passed AND rr IS NOT NULL GROUP BY step, window_id, rr),
pe AS (SELECT step, window_id, -sum(c / n::DOUBLE * ln(c / n::DOUBLE)) AS h FROM y WHERE n >= 2 GROUP BY step, window_id), rd AS (SELECT step, avg(h) AS h FROM pe GROUP BY step)"""


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    return reports.entropy_readings(_records(spark, sf).where("passed"), "rr", "window_id")


@_query(f"WITH RECURSIVE {_READINGS} SELECT step::BIGINT AS step, round(h, 6) + 0 AS reading FROM rd")
def entropy_readings(spark: SparkSession, sf: str) -> DataFrame:
    return _readings(spark, sf).select("step", (_r("reading") + 0).alias("reading"))


_EMA = "(0.1::DOUBLE * h + 0.9::DOUBLE * ema)"


@_query(
    f"""WITH RECURSIVE {_READINGS},
h AS (SELECT s.step, h FROM (SELECT unnest(range(0, 7)) AS step) s LEFT JOIN rd ON rd.step = s.step),
c(step, ema, bonus, err) AS (SELECT -1::BIGINT, 0.3::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
  SELECT h.step, coalesce({_EMA}, ema), CASE WHEN h IS NULL THEN bonus WHEN 0.3::DOUBLE - {_EMA} > 0
    THEN greatest(0, least(0.1::DOUBLE, bonus + greatest(-0.0005::DOUBLE, least(0.0005::DOUBLE, 0.02::DOUBLE * (0.3::DOUBLE - {_EMA}) + 0.01::DOUBLE * (0.3::DOUBLE - {_EMA} - err))))) ELSE greatest(0, bonus - least(bonus, 0.0005::DOUBLE)) END,
    CASE WHEN h IS NULL THEN err ELSE greatest(0, 0.3::DOUBLE - {_EMA}) END FROM c JOIN h ON h.step = c.step + 1)
SELECT step::BIGINT AS step, round(ema, 6) AS ema, round(bonus, 6) AS bonus FROM c WHERE step >= 0"""
)
def entropy_controller_trace(spark: SparkSession, sf: str) -> DataFrame:
    steps = spark.range(7).select(F.col("id").alias("step")).join(_readings(spark, sf), "step", "left")
    e = ROUND2.entropy
    out = control.entropy_trace(steps, e.floor, e.gain.alpha, e.gain.kp, e.gain.kd, e.gain.step_max, e.cap)
    return out.select("step", _r("ema").alias("ema"), _r("buff").alias("bonus"))


# --- tokens -------------------------------------------------------------------------------------------------------

_VOCAB = ", ".join("('{}', {}, {})".format(g, "'" + t.replace("'", "''") + "'", i) for g, t, i in tokens.vocabulary() if not g.startswith("candle_"))
_VOCAB_TABLE = f"""vocab AS (SELECT * FROM (VALUES {_VOCAB}) v(grp, token, id) UNION ALL
  SELECT 'candle_' || p, '<' || p || '_' || v || '>', 10 + 1024 * n + v FROM (SELECT unnest(['O', 'H', 'L', 'C']) AS p, unnest(range(4)) AS n) CROSS JOIN (SELECT unnest(range(1024)) AS v))"""


@_query(f"WITH {_VOCAB_TABLE} SELECT grp, token, id::BIGINT AS id FROM vocab")
def vocab_table(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.vocabulary_frame(spark).select("grp", "token", *_long("id"))


@_query(f"WITH {_VOCAB_TABLE} SELECT grp, count(*) AS n FROM vocab GROUP BY grp")
def vocab_groups(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.vocabulary_frame(spark).groupBy("grp").agg(F.count("*").alias("n"))


_TEXT = f"""{X.DECISIONS}, {_VOCAB_TABLE},
pr AS (SELECT symbol, window_no, {_CHART} AS prompt FROM q GROUP BY symbol, window_no),
ro AS (SELECT window_id, k, prompt, CASE WHEN k % 4 = 1 THEN {_COMPLETION} || ' what' ELSE {_COMPLETION} END AS completion FROM d JOIN pr USING (symbol, window_no)),
wd AS (SELECT window_id, k, unnest(string_split(prompt || ' ' || completion, ' ')) AS token, generate_subscripts(string_split(prompt || ' ' || completion, ' '), 1) AS pos, len(string_split(prompt, ' ')) AS np FROM ro),
tk AS (SELECT window_id, k, pos, np, coalesce(id, 0) AS id, wd.token FROM wd LEFT JOIN vocab USING (token))"""


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    r = X.rollouts(spark, sf)
    done = F.when(F.col("k") % 4 == 1, F.concat("clean_completion", F.lit(" what"))).otherwise(F.col("clean_completion"))
    return r.select("window_id", "k", "prompt", done.alias("completion"))


def _joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), " ")


@_query(f"WITH RECURSIVE {_TEXT} SELECT window_id, k::BIGINT AS k, '1 ' || string_agg(id::VARCHAR, ' ' ORDER BY pos) || ' 2' AS ids FROM tk GROUP BY window_id, k")
def encoded_ids(spark: SparkSession, sf: str) -> DataFrame:
    r = _texts(spark, sf).withColumn("ids", tokens.encode(language.assembled(F.col("prompt"), F.col("completion"))))
    return r.select("window_id", *_long("k"), _joined("ids").alias("ids"))


@_query(f"WITH RECURSIVE {_TEXT} SELECT window_id, k::BIGINT AS k, string_agg(token, ' ' ORDER BY pos) FILTER (id > 3) AS text FROM tk GROUP BY window_id, k")
def decoded_text(spark: SparkSession, sf: str) -> DataFrame:
    r = _texts(spark, sf).withColumn("ids", tokens.encode(language.assembled(F.col("prompt"), F.col("completion"))))
    return r.select("window_id", *_long("k"), tokens.decode(F.col("ids")).alias("text"))


_CUT = f"least(count(*) + 2, {MAX_LENGTH})"


def _stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, for what is looked at from several sides."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@_query(
    f"""WITH RECURSIVE {_TEXT}, lb AS (SELECT window_id, k, any_value(np) AS np, count(*) AS n, list(id ORDER BY pos) AS ids FROM tk GROUP BY window_id, k),
f AS (SELECT window_id, k, np, list_concat(list_concat([1], ids), [2])[1:{MAX_LENGTH}] AS ids FROM lb)
SELECT window_id, k::BIGINT AS k, len(ids)::BIGINT AS n, least(np + 1, len(ids))::BIGINT AS masked, list_sum(ids[least(np + 1, len(ids)) + 1:])::BIGINT AS shown FROM f"""
)
def label_masks(spark: SparkSession, sf: str) -> DataFrame:
    rows = _texts(spark, sf)
    ids, labels = tokens.labels(F.col("prompt"), tokens.encode(language.assembled(F.col("prompt"), F.col("completion"))), MAX_LENGTH)
    kept = rows.select("window_id", "k", F.size(ids).cast("long").alias("n"), labels.alias("labels"))
    shown = F.filter("labels", lambda x: x != -100)
    total = F.when(F.size(shown) > 0, F.aggregate(shown, F.lit(0).cast("long"), lambda a, x: a + x))
    return kept.select("window_id", *_long("k"), "n", F.size(F.filter("labels", lambda x: x == -100)).cast("long").alias("masked"), total.alias("shown"))


@_query(f"WITH RECURSIVE {_TEXT}, z AS (SELECT window_id, k, {_CUT} AS n FROM tk GROUP BY window_id, k) SELECT CASE WHEN k % 2 = 0 THEN 'train' ELSE 'val' END AS split, count(*) AS n, min(n)::BIGINT AS min_len, max(n)::BIGINT AS max_len, round(avg(n), 6) AS avg_len, count(*) FILTER (n >= {MAX_LENGTH}) AS truncated FROM z GROUP BY 1")
def length_profile(spark: SparkSession, sf: str) -> DataFrame:
    r = _texts(spark, sf).withColumns({"len": F.size(F.slice(tokens.encode(language.assembled(F.col("prompt"), F.col("completion"))), 1, MAX_LENGTH)), "split": F.when(F.col("k") % 2 == 0, "train").otherwise("val")})
    return tokens.length_profile(r, F.col("len"), MAX_LENGTH).select("split", "n", *_long("min_len", "max_len"), _r("avg_len").alias("avg_len"), "truncated")


@_query(f"WITH RECURSIVE {_TEXT}, z AS (SELECT window_id, k, {_CUT} AS n FROM tk GROUP BY window_id, k), m AS (SELECT *, (ceil(max(n) OVER (PARTITION BY window_id) / 8.0) * 8)::BIGINT AS w FROM z) SELECT window_id, k::BIGINT AS k, w AS width, (w - n)::BIGINT AS pads FROM m")
def padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    r = _texts(spark, sf)
    ids, labels = tokens.labels(F.col("prompt"), tokens.encode(language.assembled(F.col("prompt"), F.col("completion"))), MAX_LENGTH)
    out = tokens.padded(r.select("window_id", "k", ids.alias("input_ids"), labels.alias("labels")), "window_id", 8)
    return out.select("window_id", *_long("k"), F.size("input_ids").cast("long").alias("width"), F.size(F.filter("attention_mask", lambda x: x == 0)).cast("long").alias("pads"))


@_query(f"WITH RECURSIVE {_TEXT} SELECT window_id || '/' || k AS row_id, CASE WHEN action = 'HOLD' THEN 'no_mapped' ELSE 'completion' END AS violation FROM ro JOIN d USING (window_id, k) WHERE action = 'HOLD' OR k % 4 = 1")
def verify_violations(spark: SparkSession, sf: str) -> DataFrame:
    """A stored set that has lost its HOLD rows, and texts with a word that no vocabulary has."""
    r = _texts(spark, sf).withColumn("row_id", F.concat(F.col("window_id"), F.lit("/"), F.col("k").cast("string")))
    ids, labels = tokens.labels(F.col("prompt"), tokens.encode(language.assembled(F.col("prompt"), F.col("completion"))), 512)
    r = _stored(r.select("row_id", "prompt", "completion", ids.alias("input_ids"), labels.alias("labels")), "rows")
    mapped = r.where(~F.contains("completion", F.lit(" HOLD "))).select("row_id", "input_ids", "labels")
    return tokens.violations(r.select("row_id", "prompt", "completion"), mapped, "row_id", 512)


@_query(
    f"""WITH RECURSIVE {_TEXT}, lb AS (SELECT window_id, k, any_value(np) AS np, count(*) + 2 AS n FROM tk GROUP BY window_id, k)
SELECT window_id || '/' || k AS row_id, np::BIGINT AS words, n::BIGINT AS ids FROM lb WHERE k % 2 = 1"""
)
def bucketed_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw and tokenised rows of the val split, stored by bucket and met within the buckets."""
    split = F.when(F.col("k") % 2 == 0, "train").otherwise("val").alias("split")
    rows = _texts(spark, sf).select(F.concat("window_id", F.lit("/"), F.col("k").cast("string")).alias("row_id"), split, "prompt", "completion")
    name = f"pairs_{uuid4().hex}"
    bucketed.save(rows, f"{name}_raw", f"{shared_dir(spark)}/{name}/raw", "row_id", 8)
    raw = spark.table(f"{name}_raw")
    ids = tokens.encode(language.assembled(F.col("prompt"), F.col("completion")))
    bucketed.save(raw.select("row_id", "split", ids.alias("input_ids")), f"{name}_mapped", f"{shared_dir(spark)}/{name}/mapped", "row_id", 8)
    met = bucketed.paired(raw, spark.table(f"{name}_mapped"), "row_id", "val")
    return met.select("row_id", F.size(F.split("prompt", " ")).cast("long").alias("words"), F.size("input_ids").cast("long").alias("ids"))


_PROMPT = f"""{X.WINDOWS}, {_VOCAB_TABLE}, pr AS (SELECT symbol, symbol || '_' || window_no AS window_id, window_no, {_CHART} AS prompt FROM q GROUP BY symbol, window_no),
pw AS (SELECT symbol, window_no, window_id, id, pos FROM (SELECT symbol, window_no, window_id, unnest(string_split(prompt, ' ')) AS token, generate_subscripts(string_split(prompt, ' '), 1) AS pos FROM pr) JOIN vocab USING (token))"""
_SHORT = 200


@_query(f"WITH RECURSIVE {_PROMPT} SELECT window_id, least(count(*), {_SHORT})::BIGINT AS prompt_length, sum(id * pos) FILTER (pos <= {_SHORT})::BIGINT AS checksum, count(*) > {_SHORT} AS cut FROM pw GROUP BY window_id")
def prompt_tokens(spark: SparkSession, sf: str) -> DataFrame:
    ids, length, cut = tokens.prompt_ids(F.col("prompt"), _SHORT)
    rows = dataset.prompt_rows(X.windows(spark, sf)).select("window_id", ids.alias("ids"), length.cast("long").alias("prompt_length"), cut.alias("cut"))
    total = F.aggregate(F.transform("ids", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("window_id", "prompt_length", total.alias("checksum"), "cut")


@_query(f"WITH RECURSIVE {_PROMPT} SELECT window_id, CASE WHEN symbol = 'view' THEN 'no_mapped' ELSE 'prompt' END AS violation FROM pr WHERE symbol = 'view' OR window_no = 0")
def verify_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A stored set that lacks a symbol, and whose first windows begin with another token."""
    rows = _stored(dataset.prompt_rows(X.windows(spark, sf)), "prompts")
    ids = tokens.prompt_ids(F.col("prompt"), _SHORT)[0]
    wrong = F.when(F.endswith("window_id", F.lit("_0")), F.concat(F.array(F.lit(EOS + 2)), F.slice(ids, 3, _SHORT))).otherwise(ids)
    return tokens.prompt_violations(rows, rows.where("symbol <> 'view'").select("window_id", wrong.alias("prompt_input_ids")), "window_id")


@_query(
    f"""WITH RECURSIVE {_TEXT}, z AS (SELECT window_id, k, any_value(symbol) AS symbol, any_value(np) AS np, least(count(*) + 2, {MAX_LENGTH})::BIGINT AS n FROM tk JOIN d USING (window_id, k) GROUP BY window_id, k),
b AS (SELECT *, symbol || '/' || ((row_number() OVER (PARTITION BY symbol ORDER BY window_id, k) - 1) // 8) AS batch FROM z),
m AS (SELECT *, (ceil(max(n) OVER (PARTITION BY batch) / 8.0) * 8)::BIGINT AS width FROM b)
SELECT mode, batch, window_id, k::BIGINT AS k, width, (width - n)::BIGINT AS pads, CASE mode WHEN 'on_the_fly' THEN greatest(n - np - 1, 0) ELSE n END::BIGINT AS trained FROM m CROSS JOIN (SELECT unnest(['on_the_fly', 'pre_tokenized']) AS mode)"""
)
def collated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of eight: prompt and completion encoded and masked on the way, and stored ids whose masks are passed over."""
    raw = tokens.in_batches(_texts(spark, sf).withColumn("symbol", F.regexp_extract("window_id", "^(.*)_[0-9]+$", 1)), 8, "symbol", "window_id", "k").drop("symbol")
    ids, masked = tokens.labels(F.col("prompt"), tokens.encode(language.assembled(F.col("prompt"), F.col("completion"))), MAX_LENGTH)
    stored = raw.select("batch", "window_id", "k", ids.alias("input_ids"), masked.alias("labels"))
    both = [
        tokens.collated(raw, "on_the_fly", False, "batch", MAX_LENGTH, 8).withColumn("mode", F.lit("on_the_fly")),
        tokens.collated(stored, "pre_tokenized", True, "batch", multiple=8).withColumn("mode", F.lit("pre_tokenized")),
    ]
    out = both[0].unionByName(both[1])
    pads, trained = F.filter("attention_mask", lambda x: x == 0), F.filter("labels", lambda x: x != LABEL_PAD)
    return out.select("mode", "batch", "window_id", *_long("k"), *[F.size(c).cast("long").alias(n) for c, n in ((F.col("input_ids"), "width"), (pads, "pads"), (trained, "trained"))])


@_query(
    f"""WITH RECURSIVE {_TEXT}, z AS (SELECT window_id, k, any_value(np) AS np, count(*) + 2 AS n FROM tk GROUP BY window_id, k)
SELECT cut::BIGINT AS max_length, count(*) FILTER (np + 1 >= least(n, cut)) AS masked, count(*) AS n FROM z CROSS JOIN (SELECT unnest([203, {MAX_LENGTH}]) AS cut) GROUP BY cut"""
)
def fully_masked_count(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a cut leaves without a label, at a length that leaves room for the prompt alone and at the usual one."""
    rows = _texts(spark, sf)
    full = tokens.encode(language.assembled(F.col("prompt"), F.col("completion")))
    told = [F.struct(F.lit(n).cast("long").alias("max_length"), tokens.fully_masked(tokens.labels(F.col("prompt"), full, n)[1]).alias("bare")) for n in (203, MAX_LENGTH)]
    return rows.select(F.inline(F.array(*told))).groupBy("max_length").agg(F.count_if("bare").alias("masked"), F.count("*").alias("n"))


@_query(f"WITH RECURSIVE {X.DECISIONS} SELECT window_id, k::BIGINT AS k FROM d ORDER BY md5(concat_ws('|', window_id, k, '0')), window_id, k LIMIT 20")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.seeded_sample(X.decisions(spark, sf).select("window_id", *_long("k")), 20, 0, "window_id", "k")


# --- small tables and streams -------------------------------------------------------------------------------------

_SIZES = ", ".join(f"('{n}', {h}, {la}, {a}, {kv}, {ff})" for n, h, la, a, kv, ff in MODEL_SIZES)


@_query(f"SELECT name, (layers * (2 * h * h + 2 * h * kv * (h // a) + 3 * h * ff + 2 * h) + h * 4145 + h)::BIGINT AS params FROM (VALUES {_SIZES}) v(name, h, layers, a, kv, ff)")
def model_param_count(spark: SparkSession, sf: str) -> DataFrame:
    t = spark.createDataFrame(MODEL_SIZES, "name string, h long, layers long, a long, kv long, ff long")
    h, kv = F.col("h"), F.expr("kv * (h div a)")
    return t.select("name", (F.col("layers") * (2 * h * h + 2 * h * kv + 3 * h * F.col("ff") + 2 * h) + h * 4145 + h).alias("params"))


@_query("SELECT n_name, (('0x' || right(md5(n_name), 8))::BIGINT % 2147483648)::BIGINT AS seed FROM nation")
def round_seed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_name", dataset.round_seed_column(F.col("n_name")).alias("seed"))


@_query(f"WITH {X.BARS}, m AS (SELECT max(ts) - INTERVAL 2 HOUR AS closed FROM events) SELECT symbol, {_SQL_TS}, open, high, low, close FROM bars, m WHERE ts + INTERVAL 1 HOUR <= closed")
def stream_bars_windowed(spark: SparkSession, sf: str) -> DataFrame:
    """The same bars from a stream of ticks, run to its end: those that its watermark has closed."""
    import uuid

    from candlewright.streaming.live import bars_to_table

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    ticks = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)
    ticks = ticks.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return bars_to_table(ticks, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}").select("symbol", _ts(), "open", "high", "low", "close")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
