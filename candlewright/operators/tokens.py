"""The closed vocabulary, encoding, label masks, padding and their checks."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.operators.reconcile import digested, in_buckets, unequal_buckets
from candlewright.schema import ACTIONS, BIN_MAX, BOS, EOS, LABEL_PAD, PAD, RR_MAX, RR_MIN, TRENDS, UNK


def vocabulary() -> list[tuple[str, str, int]]:
    """(group, token, id): specials, then the groups in their fixed order."""
    groups = [
        ("special", ["<unk>", "<bos>", "<eos>", "<pad>"]),
        ("structural_tags", [f"<{s}{t}>" for t in ("chart", "think", "action") for s in ("", "/")]),
        *((f"candle_{p}", [f"<{p}_{v}>" for v in range(BIN_MAX + 1)]) for p in "OHLC"),
        ("trend", [f"<trend>{t}</trend>" for t in TRENDS]),
        ("digit_field_tags", [f"<{s}{t}>" for t in ("current_price", "zone_support", "zone_resistance") for s in ("", "/")] + ["SL:"]),
        ("digit", [str(d) for d in range(10)]),
        ("colon", [":"]),
        ("flags", ["<price_in_zone>", "<good_price_action>"]),
        ("action_type", list(ACTIONS)),
        ("rr", [f"<RR_{v}>" for v in range(RR_MIN, RR_MAX + 1)]),
    ]
    names = [(g, t) for g, ts in groups for t in ts]
    if len({t for _, t in names}) != len(names):
        raise ValueError("a token is in the vocabulary twice")
    return [(g, t, i) for i, (g, t) in enumerate(names)]


def vocabulary_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(vocabulary(), "grp string, token string, id int")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def token_id(word: Column) -> Column:
    """Id of one word by arithmetic on its shape and a small literal map, unknown words UNK: no table to join or ship."""
    parts = F.regexp_extract(word, r"^<([OHLC])_(0|[1-9][0-9]{0,3})>$", 2).try_cast("int")
    prefix = F.regexp_extract(word, r"^<([OHLC])_", 1)
    offset = F.when(prefix == "O", 10).when(prefix == "H", 1034).when(prefix == "L", 2058).otherwise(3082)
    few = F.create_map(*[F.lit(x) for g, t, i in vocabulary() if not g.startswith("candle_") for x in (t, i)])
    return F.when(parts.between(0, BIN_MAX), parts + offset).otherwise(F.coalesce(F.try_element_at(few, word), F.lit(UNK)))


def encode(text: Column, mode: str = "full") -> Column:
    """Ids of the words between blanks. mode: full (<bos> .. <eos>), bos (generation) or plain."""
    ids = F.transform(_words(text), token_id)
    ends = {"full": ([BOS], [EOS]), "bos": ([BOS], []), "plain": ([], [])}[mode]
    return F.concat(*[F.array(*map(F.lit, e)) for e in ends[:1] if e], ids, *[F.array(*map(F.lit, e)) for e in ends[1:] if e])


def encode_by_join(frame: DataFrame, key: str, text: str, vocab: DataFrame) -> DataFrame:
    """key, ids: the same by a join with a vocabulary table, for vocabularies that have no rule."""
    words = frame.select(key, F.posexplode(_words(F.col(text))).alias("pos", "token"))
    met = words.join(F.broadcast(vocab.select("token", "id")), "token", "left").withColumn("id", F.coalesce("id", F.lit(UNK)))
    return met.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))


def decode(ids: Column) -> Column:
    """Words of ids without the specials, joined by blanks."""
    names = F.array(*[F.lit(t) for g, t, _ in vocabulary() if not g.startswith("candle_")])  # ids 0-9 and 4106 on
    word = lambda x: F.when(
        x.between(10, 4105), F.concat(F.lit("<"), F.substring(F.lit("OHLC"), (F.floor((x - 10) / 1024) + 1).cast("int"), F.lit(1)), F.lit("_"), ((x - 10) % 1024).cast("string"), F.lit(">"))
    ).otherwise(F.try_element_at(names, F.when(x < 10, x + 1).otherwise(x - 4095)))
    return F.array_join(F.transform(F.filter(ids, lambda x: x > PAD), word), " ")


def labels(prompt: Column, full_ids: Column, max_length: int) -> tuple[Column, Column]:
    """input_ids cut to max_length, and labels with the prompt (and <bos>) masked; the cut comes first."""
    ids = F.slice(full_ids, 1, max_length)
    masked = F.least(F.size(_words(prompt)) + 1, F.size(ids))
    return ids, F.concat(F.array_repeat(F.lit(LABEL_PAD), masked), F.slice(ids, masked + 1, F.greatest(F.size(ids), F.lit(1))))


def fully_masked(label_ids: Column) -> Column:
    return (F.size(label_ids) > 0) & F.forall(label_ids, lambda x: x == LABEL_PAD)


def length_profile(rows: DataFrame, length: Column, max_length: int, by: str = "split") -> DataFrame:
    """Lengths of each split; truncated counts those that reach max_length."""
    return rows.groupBy(by).agg(
        F.count("*").alias("n"), F.min(length).alias("min_len"), F.max(length).alias("max_len"), F.avg(length).alias("avg_len"),
        F.count_if(length >= max_length).alias("truncated"),
    )


def broken_rule(max_length: int) -> Column:
    """The rule that a row of completion, input_ids and labels breaks, or null: a side missing, lengths, mask not a prefix, completion not restored."""
    shown = F.size(F.filter("labels", lambda x: x != LABEL_PAD))
    tail = F.slice("labels", F.size("labels") - shown + 1, F.greatest(shown, F.lit(1)))
    back = decode(F.filter(F.col("labels"), lambda x: x != LABEL_PAD))
    done = F.concat_ws(" ", _words(F.col("completion")))
    cut = F.size("input_ids") >= max_length
    return (
        F.when(F.col("completion").isNull(), "no_raw")
        .when(F.col("labels").isNull(), "no_mapped")
        .when(F.size("labels") != F.size("input_ids"), "length")
        .when((shown > 0) & ~F.forall(tail, lambda x: x != LABEL_PAD), "mask")
        .when((back != done) & ~(cut & F.startswith(done, back)), "completion")
    )


def violations(raw: DataFrame, mapped: DataFrame, key: str, max_length: int) -> DataFrame:
    """Rows of tokenised data that break a rule, over all rows. raw: key, prompt, completion; mapped: key, input_ids, labels.

    What the texts should have become is digested by bucket of keys on one side, what is stored on the other; only buckets that differ, or hold a
    text that breaks a rule even when encoded right, are joined row by row.
    """
    ids, masked = labels(F.col("prompt"), encode(F.concat_ws(" ", "prompt", "completion")), max_length)
    wanted = raw.select(key, "completion", ids.alias("input_ids"), masked.alias("labels")).withColumn("sound", broken_rule(max_length).isNull())
    odd = unequal_buckets(digested(wanted, key, F.col("sound"), "input_ids", "labels"), digested(mapped, key, F.lit(True), "input_ids", "labels"))
    met = in_buckets(raw.select(key, "completion"), key, odd).join(in_buckets(mapped.select(key, "input_ids", "labels"), key, odd), key, "full_outer")
    return met.select(key, broken_rule(max_length).alias("violation")).where("violation is not null")


def previews(found: DataFrame, each: int = 5, by: str = "violation") -> DataFrame:
    """The first ``each`` rows of every rule, in order of the other columns."""
    order = [c for c in found.columns if c != by]
    return found.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__n") <= each).drop("__n")


def padded(rows: DataFrame, batch: str, multiple: int = 1) -> DataFrame:
    """input_ids, attention_mask and labels filled up on the right to the longest of the batch (to a multiple)."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy(batch))
    width = (F.ceil(longest / multiple) * multiple).cast("int")
    more = width - F.size("input_ids")
    return rows.withColumn("__m", more).select(
        *[c for c in rows.columns if c not in ("input_ids", "labels")],
        F.concat("input_ids", F.array_repeat(F.lit(PAD), F.col("__m"))).alias("input_ids"),
        F.concat(F.transform("input_ids", lambda x: F.lit(1)), F.array_repeat(F.lit(0), F.col("__m"))).alias("attention_mask"),
        F.concat("labels", F.array_repeat(F.lit(LABEL_PAD), F.col("__m"))).alias("labels"),
    )


def prompt_ids(prompt: Column, max_length: int) -> tuple[Column, Column, Column]:
    """prompt_input_ids (no ends, cut to max_length), prompt_length, and whether it was cut."""
    ids = encode(prompt, "plain")
    return F.slice(ids, 1, max_length), F.least(F.size(ids), F.lit(max_length)), F.size(ids) > max_length


def prompt_violations(raw: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """Tokenised prompts that break a rule, over all rows: missing on a side, or neither the prompt nor a start of it. raw: key, prompt; mapped: key, prompt_input_ids.

    By digests of buckets first, as ``violations``; a stored prompt is held against as many ids of its text as it has.
    """
    back, text = decode(F.col("prompt_input_ids")), F.concat_ws(" ", _words(F.col("prompt")))
    rule = F.when(F.col("prompt").isNull(), "no_raw").when(F.col("prompt_input_ids").isNull(), "no_mapped").when(~F.startswith(text, back), "prompt")
    longest = mapped.agg(F.max(F.size("prompt_input_ids")).alias("__longest"))  # one row
    wanted = raw.select(key, "prompt").join(F.broadcast(longest), how="cross").withColumn("prompt_input_ids", F.slice(encode(F.col("prompt"), "plain"), F.lit(1), F.coalesce("__longest", F.lit(0))))
    wanted = wanted.withColumn("sound", rule.isNull())
    odd = unequal_buckets(digested(wanted, key, F.col("sound"), "prompt_input_ids"), digested(mapped, key, F.lit(True), "prompt_input_ids"))
    met = in_buckets(raw.select(key, "prompt"), key, odd).join(in_buckets(mapped.select(key, "prompt_input_ids"), key, odd), key, "full_outer")
    return met.select(key, rule.alias("violation")).where("violation is not null")


def collated(rows: DataFrame, mode: str, pretrain: bool, batch: str, max_length: int | None = 512, multiple: int = 1) -> DataFrame:
    """Padded batches of training rows. mode on_the_fly: prompt and completion, encoded here; pre_tokenized: input_ids and labels as stored.

    pretrain: the labels are the ids, stored labels are passed over; else the prompt is masked.
    """
    if mode == "on_the_fly":
        full = encode(F.concat_ws(" ", "prompt", "completion"))
        ids, masked = labels(F.col("prompt"), full, max_length or 1 << 30)
        rows = rows.withColumns({"input_ids": ids, "labels": masked}).drop("prompt", "completion")
    elif mode != "pre_tokenized":
        raise ValueError(f"unknown mode: {mode}")
    return padded(rows.withColumn("labels", F.col("input_ids")) if pretrain else rows, batch, multiple)


def in_batches(rows: DataFrame, size: int, by: str, *order: str) -> DataFrame:
    """batch (by/number): rows in order, ``size`` to a batch, numbered within each value of ``by``; a batch spans no two of them."""
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return rows.withColumn("batch", F.concat_ws("/", F.col(by).cast("string"), F.floor(n / size).cast("string")))


def seeded_sample(rows: DataFrame, size: int, seed: int, *key: str) -> DataFrame:
    """``size`` rows without replacement, drawn by md5 of key and seed: the same rows on every run, in any engine."""
    return rows.orderBy(F.md5(F.concat_ws("|", *key, F.lit(str(seed)))), *key).limit(size)


def write_vocabulary(spark: SparkSession, path: str) -> None:
    vocabulary_frame(spark).coalesce(1).write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str, fallback: bool = True) -> DataFrame:
    """grp, token, id as stored; where nothing can be read, the computed vocabulary with a warning, or the error."""
    from pyspark.errors import PySparkException

    try:
        return spark.read.parquet(path).select("grp", "token", F.col("id").cast("int").alias("id"))
    except PySparkException as error:
        if not fallback:
            raise
        warnings.warn(f"no vocabulary at {path} ({type(error).__name__}): computed anew", stacklevel=2)
        return vocabulary_frame(spark)
