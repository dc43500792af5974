"""Importance resampling towards a target set, over hashed n-grams read from a position table.

Words of each text are exploded with their positions; ``lead`` over a text's positions puts the following words
beside each word, so that one row of the position table holds the buckets of the runs of 1, 2 and 3 words that start
there. Buckets are counted in both sets, each bucket's gain is the log ratio of its shares (add-one), and a document's
weight is the sum of its features' gains. Documents are drawn by weight plus Gumbel noise from a hash of doc_id.

Texts are dealt out whole by row number before they are exploded, so the rows of a text are never shuffled apart; the
position table is written once and read for both counts and sums. Gains are broadcast: their number is ``buckets``.

Defined results: a null or empty text has no features (weight 0) and can't be drawn; a repeated row is a row of its
own; a null doc_id is hashed as an empty string and comes last among ties; rows that tie on score and doc_id are
ranked in any order; an empty target gives every bucket its gain against no counts; other columns are left out; an empty table
gives an empty result. Rows are numbered where they stand: ``documents`` is to be a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.llm.runtime import Scratch, running

BUCKETS = 10_000
ORDERS = 3
SCALE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def position_table(table: DataFrame, id_column: str, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, b1..bN: a row for each word, the buckets of the runs that start there (null where the text ends before). A text without words has one row of nulls."""
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_column}`").cast("long").alias("doc_id"), "text")
    words = rows.repartition("row").select("row", "doc_id", F.posexplode_outer(words_of(F.col("text"))).alias("pos", "word"))
    along = Window.partitionBy("row").orderBy("pos")
    beside = words.select("row", "doc_id", "word", *[F.lead("word", n).over(along).alias(f"next{n}") for n in range(1, orders)])
    runs = [F.concat_ws(" ", "word", *[f"next{k}" for k in range(1, n)]) for n in range(1, orders + 1)]
    last = ["word", *[f"next{n}" for n in range(1, orders)]]
    hashed = [F.when(F.col(last[n]).isNotNull(), F.crc32(runs[n].cast("binary")) % buckets).cast("int").alias(f"b{n + 1}") for n in range(orders)]
    return beside.select("row", "doc_id", *hashed)


def bucket_counts(positions: DataFrame, orders: int = ORDERS) -> DataFrame:
    """bucket, n: how many features of the table fall into each bucket."""
    each = positions.select(F.explode(F.array(*[f"b{n + 1}" for n in range(orders)])).alias("bucket"))
    return each.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int = BUCKETS, scale: int = SCALE) -> DataFrame:
    """bucket, gain for every bucket, of two tables of counts."""
    spark = documents.sparkSession
    s, t = documents.select(F.col("bucket").alias("of_s"), F.col("n").alias("s")), target.select(F.col("bucket").alias("of_t"), F.col("n").alias("t"))
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, F.col("bucket") == F.col("of_s"), "left").join(t, F.col("bucket") == F.col("of_t"), "left")
    both = both.select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"))
    total = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = ((F.col("t") + 1.0) * F.lit(total[0] + buckets)) / ((F.col("s") + 1.0) * F.lit(total[1] + buckets)) if total[1] is not None else F.lit(1.0)
    return both.select("bucket", F.floor(F.log(ratio) * F.lit(float(scale))).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int, scale: int = SCALE) -> Column:
    """Gumbel noise, in whole thousandths, from the first 32 bits of sha256(``seed:doc_id``)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / F.lit(4294967296.0))) * F.lit(-float(scale))).cast("long")


def importance_scores(documents: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (from 1 for the drawn, else null) of each row of ``documents``.

    Drawn are floor(percent * N / 100) of the N rows with ``least_words`` words or more: the highest scores, ties to the smaller doc_id.
    """
    scratch = Scratch(documents.sparkSession)
    positions = scratch.table(position_table(documents, "doc_id", orders, buckets), "positions")
    goal = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gains = scratch.table(bucket_gains(bucket_counts(positions, orders), bucket_counts(position_table(goal, "doc_id", orders, buckets), orders), buckets), "gains")
    met = positions
    for n in range(1, orders + 1):
        met = met.join(F.broadcast(gains.select(F.col("bucket").alias(f"of{n}"), F.col("gain").alias(f"g{n}"))), F.col(f"b{n}") == F.col(f"of{n}"), "left")
    every = range(1, orders + 1)
    gain = sum((F.coalesce(F.col(f"g{n}"), F.lit(0)) for n in every), F.lit(0))
    found = sum((F.col(f"b{n}").isNotNull().cast("long") for n in every), F.lit(0))
    weighed = met.groupBy("row", "doc_id").agg(F.count("b1").alias("n_words"), F.sum(found).alias("n_features"), F.sum(gain).alias("weight"))
    scored = scratch.table(
        weighed.select("row", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).cast("long").alias("open")),
        "scored",
    )
    scratch.drop(positions)
    drawn = percent * (scored.agg(F.sum("open")).first()[0] or 0) // 100
    order = [F.col("open").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    placed = running(scored, order, "open", "before", scratch)
    rank = F.when((F.col("open") == 1) & (F.col("before") < drawn), F.col("before") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = importance_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return scores.select("doc_id", "n_features", "weight", "score", "rank")
