"""Rewards of scored decisions, both rounds, and shaping within a prompt's group.

Inputs are parsed programs with semantics (violations, semantic_passed, semantic_score), well_formed, wf_score and
the future candles. Buffs are a small keyed table of the step before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.operators.forward import best_excursion, outcome, scale_out, sl_valid, zone_probe
from candlewright.plans.presets import GATE_PASSED, GROUP_OF_ACTION, WELL_FORMED, RoundOne, RoundTwo
from candlewright.schema import CANDLE, SEMANTIC_PENALTY


def future_candles(bins: Column) -> Column:
    """array<array<int>> to candles."""
    return F.transform(bins, lambda b: F.struct(*[F.element_at(b, i).alias(k) for i, k in enumerate("ohlc", 1)])).cast(f"array<{CANDLE}>")


def action_group(action: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in GROUP_OF_ACTION.items() for x in kv]), action)


def _fee(fee_bins: float) -> Column:
    risk = F.abs(F.col("current_price_bin") - F.col("sl"))
    return F.when(risk > 0, F.lit(fee_bins) / risk).otherwise(0.0)


def reward_one(rows: DataFrame, config: RoundOne, rr_bonus: float = 0.0, buff: Column | None = None) -> DataFrame:
    """outcome (struct), passed, zone_score, outcome_score, reward. buff: of the action's group, 0 where there is none."""
    buff = F.coalesce(buff, F.lit(0.0)) if buff is not None else F.lit(0.0)
    trade = F.coalesce(F.col("action_type").isin("BUY", "SELL"), F.lit(False))
    out = rows.withColumn("outcome", outcome(F.col("future"), *config.sl_distance))
    valid, ok = F.col("outcome.valid"), F.col("outcome.sl_valid")
    base = F.when(F.col("semantic_passed") & ~valid, F.greatest(F.lit(0.0), F.col("semantic_score") - SEMANTIC_PENALTY)).otherwise(F.col("semantic_score"))
    judged = F.greatest(F.lit(0.0), base + F.when(ok, config.sl_bonus).when(~ok, -config.sl_penalty).otherwise(0.0))
    passed = F.col("well_formed") & F.col("semantic_passed") & valid & F.coalesce(ok, F.lit(True))
    zone = F.coalesce(zone_probe(F.col("zone_direction"), F.col("zone_lower"), F.col("zone_upper"), F.col("future")), F.lit(0.0)) * config.zone_scale
    made = F.when(trade & F.col("outcome.r_multiple").isNotNull(), F.col("outcome.r_multiple") - _fee(config.fee_bins) + buff).otherwise(0.0)
    out = out.withColumns({"passed": F.coalesce(passed, F.lit(False)), "zone_score": zone, "outcome_score": made, "__judged": judged})
    final = config.pass_bonus + F.col("zone_score") + F.col("outcome_score") + F.when(trade, F.lit(rr_bonus)).otherwise(buff)
    reward = F.when(~F.col("well_formed"), F.col("wf_score")).when(~F.col("passed"), WELL_FORMED + F.col("__judged")).otherwise(final)
    return out.withColumn("reward", reward).drop("__judged")


def reward_two(rows: DataFrame, config: RoundTwo, buff: Column | None = None) -> DataFrame:
    """Rows with task_id zone or action: task_passed, zone_quality, entry_quality, outcome_score, r_multiple, sl_ok, reward."""
    buff = F.coalesce(buff, F.lit(0.0)) if buff is not None else F.lit(0.0)
    entry, sl, rr, f = F.col("current_price_bin"), F.col("sl"), F.col("rr"), F.col("future")
    action, zone = F.col("action_type"), F.col("zone_direction").isNotNull()
    trade, long = action.isin("BUY", "SELL"), action == "BUY"
    whole = zone & sl.isNotNull() & rr.isNotNull()
    ok = F.when(trade, whole & F.coalesce(sl_valid(action, entry, sl, F.col("zone_lower"), F.col("zone_upper"), *config.sl_distance), F.lit(False)))
    gate = F.col("well_formed") & F.col("semantic_passed")
    on_zone = F.col("task_id") == "zone"
    quality = F.coalesce(zone_probe(F.col("zone_direction"), F.col("zone_lower"), F.col("zone_upper"), f), F.lit(0.0)) * config.zone_scale
    act = gate & ~on_zone
    ran = scale_out(entry, sl, rr, f, long)
    out = rows.withColumn("sl_ok", F.when(act, ok)).withColumns(
        {
            "task_passed": F.when(act, F.coalesce(F.col("sl_ok"), F.lit(True))),
            "zone_quality": F.when(gate & on_zone, quality),
            "entry_quality": F.when(act & F.coalesce(F.col("sl_ok"), ~trade), F.when(trade, best_excursion(entry, sl, f, long) * config.entry_weight).otherwise(0.0)),
            "r_multiple": F.when(act & F.col("sl_ok"), ran["r_multiple"]),
        }
    )
    made = F.when(F.col("r_multiple").isNotNull(), F.col("r_multiple") - _fee(config.fee_bins)).when(F.col("entry_quality").isNotNull(), F.lit(0.0))
    out = out.withColumn("outcome_score", made)
    folded = WELL_FORMED + F.greatest(F.lit(0.0), F.col("semantic_score") - SEMANTIC_PENALTY)
    reward = (
        F.when(~F.col("well_formed"), F.col("wf_score"))
        .when(~F.col("semantic_passed"), WELL_FORMED + F.col("semantic_score"))
        .when(on_zone, config.pass_bonus + F.col("zone_quality") + buff)
        .when(~F.col("task_passed"), folded)
        .otherwise(config.pass_bonus + F.col("entry_quality") + F.col("outcome_score") + buff)
    )
    return out.withColumn("reward", reward)


def gate_score() -> Column:
    """The common gate's own score: below it fails, GATE_PASSED where it is passed."""
    return F.when(~F.col("well_formed"), F.col("wf_score")).when(~F.col("semantic_passed"), WELL_FORMED + F.col("semantic_score")).otherwise(F.lit(GATE_PASSED))


def rr_entropy(rows: DataFrame, group: str, eligible: Column, strength: Column | float = 0.0) -> DataFrame:
    """entropy (nats) of rr over a group's eligible rows and each such row's bonus, strength * -ln of its rr's share. Groups under two rows have none.

    Two sums by key instead of a scan of each group; no self-join.
    """
    ok = F.coalesce(eligible & F.col("rr").isNotNull(), F.lit(False))
    n = F.count(F.when(ok, 1)).over(Window.partitionBy(group))
    same = F.count(F.when(ok, 1)).over(Window.partitionBy(group, "rr"))
    given = strength if isinstance(strength, Column) else F.lit(float(strength))
    out = rows.withColumns({"__p": F.when(ok & (n >= 2), same / n), "__n": n})
    entropy = F.sum(-F.ln("__p") / F.col("__n")).over(Window.partitionBy(group))
    return out.withColumns({"entropy": entropy, "bonus": F.coalesce(-F.ln("__p") * given, F.lit(0.0))}).drop("__p", "__n")


def shaped(rows: DataFrame, group: str, eligible: Column, strength: Column | float) -> DataFrame:
    """Rows with entropy, bonus, and the reward with the bonus added.

    Round one's eligible rows are passed trades; round two's are rows of the action task whose gate is passed, with an rr, stops out of place included.
    """
    return rr_entropy(rows, group, eligible, strength).withColumn("reward", F.col("reward") + F.col("bonus"))


def pass_margins(rounds: DataFrame) -> DataFrame:
    """Of each round and group: the least reward of a pass (worst), the greatest of a failure, and whether the pass wins. One row a round and group:
    pass_bonus, zone_scale, sl_bonus, fee_bins, sl_least (the least stop distance), grp, low (the least buff)."""
    zone = F.when(F.col("grp") == "HOLD", 0.0).otherwise(-F.col("zone_scale"))
    trade = F.when(F.col("grp").isin("BUY", "SELL"), -1 - F.col("fee_bins") / F.col("sl_least")).otherwise(0.0)
    out = rounds.withColumns({"worst": F.col("pass_bonus") + zone + trade + F.col("low"), "best_failure": GATE_PASSED + F.col("sl_bonus")})
    return out.withColumn("holds", F.col("worst") > F.col("best_failure"))


def eligible_two() -> Column:
    """Round two's rows for shaping: the action task, past both gates of the text."""
    return (F.col("task_id") == "action") & F.col("well_formed") & F.col("semantic_passed")


def buff_key_two() -> Column:
    """The buff that a row of round two may have: by action in the action task, by zone in the other."""
    return F.when(F.col("task_id") == "zone", F.when(F.col("zone_direction").isNotNull(), "HAS_ZONE").otherwise("NO_ZONE")).otherwise(F.col("action_type"))


def reward_function(spark, config, buffs: DataFrame | None = None, strength: float = 0.0):
    """A callable for trainers: (prompts, completions, future_bins, task_id=None, **others) -> rewards, in order. The batch becomes a DataFrame of its own."""
    from candlewright.operators import control, language
    from candlewright.operators.semantics import with_semantics

    def score(prompts, completions, future_bins, task_id=None, **_) -> list[float]:
        tasks = task_id if task_id is not None else [None] * len(prompts)
        data = [(i, p, c, [list(map(int, b)) for b in f], t) for i, (p, c, f, t) in enumerate(zip(prompts, completions, future_bins, tasks, strict=True))]
        batch = spark.createDataFrame(data, "i long, prompt string, completion string, bins array<array<int>>, task_id string")
        rows = batch.withColumns({"future": future_candles(F.col("bins")), "text": language.assembled(F.col("prompt"), F.col("completion"))})
        rows = with_semantics(language.parse_programs(rows), *config.zone_width)
        two = isinstance(config, RoundTwo)
        buff = None
        if buffs is not None:
            rows, buff = control.with_buff(rows, buff_key_two() if two else action_group(F.col("action_type")), buffs, "__b"), F.col("__b")
        scored = reward_two(rows, config, buff) if two else reward_one(rows, config, buff=buff)
        out = shaped(scored, "prompt", eligible_two() if two else F.col("passed"), strength)
        return [r.reward for r in out.select("i", "reward").orderBy("i").collect()]

    return score
