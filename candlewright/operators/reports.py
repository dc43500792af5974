"""Grouped reports over scored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewright.operators.reward import action_group
from candlewright.plans.presets import ACTION_GROUPS, GROUPS, ZONE_GROUPS


def trend_action(records: DataFrame, where: Column) -> DataFrame:
    """Count, share within the trend, mean R, win rate (R > 0) and mean rr of each trend and action."""
    kept = records.where(where & F.col("trend").isNotNull() & F.col("action_type").isNotNull())
    r = F.col("r_multiple")
    out = kept.groupBy("trend", "action_type").agg(
        F.count("*").alias("n"), F.avg(r).alias("avg_r"), F.avg(F.when(r.isNotNull(), (r > 0).cast("double"))).alias("win_rate"), F.avg("rr").alias("avg_rr")
    )
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("trend")))


def rr_histogram(records: DataFrame, where: Column) -> DataFrame:
    """trend, action_type, histogram (map rr -> count, in order)."""
    counted = records.where(where & F.col("rr").isNotNull()).groupBy("trend", "action_type", "rr").count()
    return counted.groupBy("trend", "action_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rr", "count")))).alias("histogram"))


def group_rollup(records: DataFrame, where: Column) -> DataFrame:
    """Counts of actions, their groups and all; every group is listed, with 0 where it has none."""
    return group_counts(records.where(where), F.count("*"))


def group_counts(rows: DataFrame, n: Column) -> DataFrame:
    """grp, action_type, n of actions, groups and all. The rows are read once; their counts are laid beside the list of groups."""
    spark = rows.sparkSession
    counted = rows.withColumn("grp", action_group(F.col("action_type"))).where("grp is not null").groupBy("grp", "action_type").agg(n.alias("n"))
    groups = spark.createDataFrame([(g, None, 0) for g in GROUPS], "grp string, action_type string, n long")
    summed = counted.unionByName(groups).rollup("grp", "action_type").agg(F.grouping_id().alias("level"), F.sum("n").alias("n"))
    # the list's own rows (an action of none) fall out; with no row at all there is no total either, as in SQL's rollup of no rows
    total = F.col("level") == 3
    return summed.where((F.col("level") == 1) | (F.col("action_type").isNotNull() & (F.col("level") == 0)) | (total & (F.col("n") > 0))).select("grp", "action_type", "n")


def intended_rates(records: DataFrame) -> DataFrame:
    """Of the completions that name an action: how many are well-formed."""
    return records.where("intended_action is not null").groupBy("intended_action").agg(
        F.count("*").alias("n"), F.count_if("well_formed").alias("well_formed"), F.avg(F.col("well_formed").cast("double")).alias("rate")
    )


def count_by(records: DataFrame, key: Column, where: Column, since: int | None = None) -> DataFrame:
    """Counts of a key, over all records or those of steps after ``since``; null keys are left out."""
    kept = records.where(where) if since is None else records.where(where & (F.col("step") > since))
    return kept.withColumn("key", key).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))


def funnel(records: DataFrame) -> DataFrame:
    """Of each task: rows, share well-formed, share of those past the semantic gate."""
    wf = F.col("well_formed")
    return records.groupBy("task_id").agg(
        F.count("*").alias("n"), F.avg(wf.cast("double")).alias("well_formed"), F.avg(F.when(wf, F.coalesce("semantic_passed", F.lit(False)).cast("double"))).alias("semantic")
    )


def task_counts(records: DataFrame, task: str, key: Column, where: Column, groups: tuple[str, ...]) -> DataFrame:
    """grp, n, ratio of a task's counted rows for every group, 0 where it has none. key: an action, or whether there is a zone by name."""
    spark = records.sparkSession
    counted = records.where((F.col("task_id") == task) & where).groupBy(key.alias("grp")).agg(F.count("*").alias("n")).where("grp is not null")
    listed = spark.createDataFrame([(g,) for g in groups], "grp string").join(counted, "grp", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return listed.withColumn("ratio", F.coalesce(F.try_divide("n", F.sum("n").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)))  # one row a group


def eval_records(parsed: DataFrame, outcome: Column, fee_bins: float) -> DataFrame:
    """Parsed and judged programs as evaluation rows. Past both gates means well-formed, no rule broken and an outcome that stands; the stop's distance is not asked.

    semantic_passed is null where the text is not well-formed; status and r_multiple are null unless all gates are passed; r_net is after the fee.
    """
    wf = F.col("well_formed")
    out = parsed.withColumn("__outcome", outcome).withColumn("semantic_passed", F.when(wf, F.col("semantic_passed") & F.col("__outcome.valid")))
    kept, risk = F.col("semantic_passed"), F.abs(F.col("current_price_bin") - F.col("sl"))
    fee = F.when(F.col("action_type").isin("BUY", "SELL") & (risk > 0), F.lit(fee_bins) / risk).otherwise(0.0)
    out = out.withColumns({"status": F.when(kept, F.col("__outcome.status")), "r_multiple": F.when(kept, F.col("__outcome.r_multiple"))})
    return out.withColumn("r_net", F.col("r_multiple") - fee).drop("__outcome")


def eval_rates(records: DataFrame) -> DataFrame:
    """One row: rows, share well-formed, share of these past the semantic gate, the same share of all."""
    n, wf, ok = F.count("*"), F.count_if("well_formed"), F.count_if(F.coalesce(F.col("well_formed") & F.col("semantic_passed"), F.lit(False)))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return records.agg(n.alias("n"), share(wf, n).alias("well_form_rate"), share(ok, wf).alias("semantic_rate_given_well_formed"), share(ok, n).alias("semantic_rate"))


def eval_summary(records: DataFrame) -> DataFrame:
    """Of rows past both gates, each trend and action, and all (both null): count, gross and net mean R, share of each status among rows with one."""
    kept = records.where("well_formed and semantic_passed and trend is not null and action_type is not null")
    has = F.col("status").isNotNull()
    share = lambda s: F.avg(F.when(has, (F.col("status") == s).cast("double"))).alias(s.lower())
    return (
        kept.groupingSets([("trend", "action_type"), ()], "trend", "action_type")
        .agg(
            F.grouping_id().alias("level"), F.count("*").alias("n"), F.avg("r_multiple").alias("gross_r"), F.avg("r_net").alias("net_r"),
            share("WIN"), share("LOSS"), share("TIMEOUT"),
        )
    )


def _shown(c: str, places: int, k: int = 1) -> Column:
    return F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.format_string(f"%.{places}f", F.round(F.round(F.col(c) * k, 6), places)))


def _line(name: Column | str, **parts: Column) -> Column:
    """``name`` in twelve places, then the parts, each as name=value."""
    return F.concat_ws("  ", F.rpad(name, 12, " "), *[F.concat(F.lit(f"{k}="), v) for k, v in parts.items()])


def _percent(c: str, places: int = 1) -> Column:
    return F.concat(_shown(c, places, 100), F.lit("%"))


def _count(c: str = "n") -> Column:
    return F.col(c).cast("string")


def report_lines(stats: DataFrame) -> DataFrame:
    """trend, line: the printed report of trend_action's rows, a line an action, in order of trend and action; a dash stands for what there is not."""
    line = _line("action_type", count=_count(), freq=_percent("share"), avg_R=_shown("avg_r", 2), win_rate=_shown("win_rate", 0, 100), avg_RR=_shown("avg_rr", 2))
    return stats.orderBy("trend", "action_type").select("trend", "action_type", line.alias("line"))


def eval_lines(rates: DataFrame, summary: DataFrame) -> DataFrame:
    """section, trend, action_type, line: the printed evaluation. rates: of eval_rates, a line a rate; summary: of eval_summary, a line a trend and action."""
    rate = lambda name, value: F.struct(F.lit(name).alias("action_type"), F.concat(F.lit(f"{name} = "), value).alias("line"))
    listed = F.array(
        rate("n_samples", _count()), rate("well_form_rate", _percent("well_form_rate")), rate("semantic_pass_rate_given_well_formed", _percent("semantic_rate_given_well_formed")),
        rate("semantic_pass_rate_overall", _percent("semantic_rate")),
    )
    head = rates.select(F.lit("rates").alias("section"), F.lit(None).cast("string").alias("trend"), F.inline(listed))
    line = _line("action_type", count=_count(), avg_R_gross=_shown("gross_r", 3), avg_R_net=_shown("net_r", 3), win_rate=_percent("win", 0), timeout=_percent("timeout", 0))
    return head.unionByName(summary.where("trend is not null").select(F.lit("outcome").alias("section"), "trend", "action_type", line.alias("line")))


def round_two_lines(records: DataFrame, zone: Column) -> DataFrame:
    """section, trend, name, line: the printed report of a second round, in five sections: tasks (with the shares past each gate), outcome (trend and action of
    the action task, past all gates, with how often each rr was chosen), action and zone (groups past the gates, all listed), intended (of completions that
    name an action, those well-formed). zone: the zone group of a row. Records are read once a section: give a stored table.
    """
    gate = F.col("well_formed") & F.col("semantic_passed")
    none = F.lit(None).cast("string").alias("trend")
    part = lambda rows, section, name, line, trend=none: rows.select(F.lit(section).alias("section"), trend, F.col(name).alias("name"), line.alias("line"))
    passed = gate & (F.col("task_id") == "action") & F.col("task_passed")
    dist = F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), " ")
    detail = trend_action(records, passed).join(rr_histogram(records, passed), ["trend", "action_type"], "left")  # a row a trend and action
    line = _line("action_type", count=_count(), freq=_percent("share"), avg_R=_shown("avg_r", 2), win_rate=_percent("win_rate", 0), avg_RR=_shown("avg_rr", 2))
    line = F.concat_ws("  ", line, F.when(F.size("histogram") > 0, F.concat(F.lit("rr_dist=["), dist, F.lit("]"))))
    groups = _line("grp", count=_count(), ratio=_percent("ratio"))
    out = part(funnel(records), "tasks", "task_id", _line("task_id", n=_count(), well_form_rate=_percent("well_formed"), semantic_pass_rate=_percent("semantic")))
    for more in (
        part(detail, "outcome", "action_type", line, F.col("trend")),
        part(task_counts(records, "action", F.col("action_type"), gate, ACTION_GROUPS), "action", "grp", groups),
        part(task_counts(records, "zone", zone, gate, ZONE_GROUPS), "zone", "grp", groups),
        part(intended_rates(records), "intended", "intended_action", _line("intended_action", total=_count(), well_formed=_count("well_formed"), rate=_percent("rate"))),
    ):
        out = out.unionByName(more)
    return out


def plot_table(programs: DataFrame, target: Column) -> DataFrame:
    """What a chart of a valid decision draws, a row a candle: window_id, i, its prices, rising, and the levels (zone, price, stop, target) on every row; rows of others are left out."""
    trade = F.col("action_type").isin("BUY", "SELL")
    levels = [F.col("zone_lower"), F.col("zone_upper"), F.col("current_price_bin").alias("price"), F.when(trade, F.col("sl")).alias("sl"), F.when(trade, target).alias("target")]
    kept = programs.where("well_formed and semantic_passed")
    rows = kept.select(*[c for c in ("window_id", "k") if c in kept.columns], *levels, F.posexplode("candles").alias("i", "c"))
    return rows.select("*", F.col("c.o").alias("o"), F.col("c.h").alias("h"), F.col("c.l").alias("l"), F.col("c.c").alias("close"), (F.col("c.c") >= F.col("c.o")).alias("rising")).drop("c")


def entropy(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Shannon entropy (nats) of a value within each group."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__c"))
    p = F.col("__c") / F.sum("__c").over(Window.partitionBy(*by))
    return counted.withColumn("__p", p).groupBy(*by).agg((-F.sum(F.col("__p") * F.ln("__p"))).alias("entropy"), F.sum("__c").alias("n"))


def entropy_readings(rows: DataFrame, value: str, prompt: str, step: str = "step", least: int = 2) -> DataFrame:
    """step, reading: the mean over a step's prompts of the entropy of their values. Prompts with fewer than ``least`` values give no reading."""
    each = entropy(rows, value, step, prompt).where(F.col("n") >= least)
    return each.groupBy(step).agg(F.avg("entropy").alias("reading"))
