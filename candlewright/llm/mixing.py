"""Mixing sources to target weights by the cube method.

Sources, by code point with null last, weigh 1, 2, 3 in turn and share the corpus's words; a target stops at
CAP times its source's words and the excess is shared again by weight. A document of a source with target
share f is taken floor(f) times for certain and once more with probability f - floor(f). Those extra takes are
drawn by the cube method, balancing words and documents: while three documents of a block have fractional
probabilities, they move along the null space of the two constraints until one reaches 0 or 1.

Blocks of at most about BLOCK documents run side by side. Each keeps RESERVED documents of geometrically spread
sizes out of the flight, and the flight leaves two at most; these meet in the blocks of the next round. The rounds end with
one block for each source. Its documents still open, RESERVED + 2 at most, are the landing problem: of all ways to round them
the one nearest to the words still owed is taken, of those of equal distance the one nearest in documents. Block, order and
draws follow from hashes of the row, so reruns agree.

Defined results: a null text has size 0; a null source is one source, the last; repeated rows are units of
their own, told apart by a copy number; null ids are allowed; other columns are left out; an empty table gives
an empty result; sources without words have target 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.runtime import Scratch, fresh, own, quoted, repeated, running, small

WEIGHTS = (1, 2, 3)
CAP = 3.0
BLOCK = 512
RESERVED = 16
#: A block of BLOCK documents leaves less than this share of them.
_LEFT = 16
_EPS = 1e-9
#: Up to so many keys and counts (16 bytes each) are broadcast.
BROADCAST_KEYS = 500_000


def text_size(text: Column) -> Column:
    """Words: runs of characters that are not white space (space, tab to carriage return)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size, docs, target. One row per source; ranked by a range sort, shared out by rounds of one-row sums."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    ranked = (
        totals.orderBy(F.col("source").asc_nulls_last())
        .rdd.zipWithIndex()
        .map(lambda x: (x[0][0], x[0][1], x[0][2], float(weights[x[1] % len(weights)])))
    )
    out = spark.createDataFrame(ranked, "source string, source_size long, docs long, weight double")
    out = Scratch(spark).table(out, "sources").withColumn("most", F.col("source_size") * F.lit(cap))
    level = 0.0
    while True:  # the level rises until no target passes its cap
        full = F.col("weight") * F.lit(level) >= F.col("most")
        s = out.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("most"))).alias("held"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        if not s["all"] or not s["open"]:
            break
        new = (s["all"] - (s["held"] or 0.0)) / s["open"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return out.select("source", "source_size", "docs", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def flight(prob: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Moves probabilities to 0 or 1, keeping their sum and the sum of size * probability, until two at most are left."""
    prob = prob.astype(float).tolist()
    size, draw = size.astype(float).tolist(), draw.tolist()
    active: list[int] = []
    for at in range(len(prob)):
        if not _EPS < prob[at] < 1 - _EPS:
            continue
        active.append(at)
        while len(active) >= 2:
            a, b = active[0], active[1]
            if size[a] == size[b]:
                step = ((a, 1.0), (b, -1.0))
            elif len(active) == 3:
                c = active[2]
                step = ((a, size[b] - size[c]), (b, size[c] - size[a]), (c, size[a] - size[b]))
            else:
                break
            up = min((1 - prob[i]) / u if u > 0 else prob[i] / -u for i, u in step if u)
            down = min(prob[i] / u if u > 0 else (1 - prob[i]) / -u for i, u in step if u)
            move = up if draw[at] * (up + down) < down else -down
            for i, u in step:
                prob[i] = min(1.0, max(0.0, prob[i] + move * u))
            active = [i for i in active if _EPS < prob[i] < 1 - _EPS]
    return np.array([round(p) if not _EPS < p < 1 - _EPS else p for p in prob])


def reserve(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which units stay out of the flight: of the open ones that have words RESERVED at most, of sizes as evenly spread on a logarithmic scale as there are."""
    out = np.zeros(len(prob), dtype=bool)
    able = np.flatnonzero((prob > _EPS) & (prob < 1 - _EPS) & (size > 0))
    if len(able) <= RESERVED:
        out[able] = True
        return out
    able = able[np.argsort(size[able], kind="stable")]
    log = np.log(size[able])
    free = np.ones(len(able), dtype=bool)
    for goal in np.linspace(log[0], log[-1], RESERVED):
        at = int(np.argmin(np.where(free, np.abs(log - goal), np.inf)))
        free[at] = False
    out[able[~free]] = True
    return out


def landing(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rounds the open units (RESERVED + 2 at most) to the choice nearest in words, then in documents, then the first in a fixed order."""
    left = np.flatnonzero((prob > 0) & (prob < 1))
    owed, count = float((prob * size)[left].sum()), float(prob[left].sum())
    words, taken = np.zeros(1), np.zeros(1)
    for i in left:
        words, taken = np.concatenate([words, words + size[i]]), np.concatenate([taken, taken + 1])
    off = np.abs(words - owed)
    near = np.flatnonzero(off <= off.min() + 1e-6)
    choice = int(near[np.argmin(np.abs(taken[near] - count))])
    out = prob.copy()
    out[left] = choice >> np.arange(len(left)) & 1
    return out


_UNIT = "source string, doc_id long, size long, copy long, prob double, tag long"


def _mover(last: bool):
    def move(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tag", "doc_id", "size", "copy"], kind="stable")
        size = part["size"].to_numpy(float)
        prob = part["prob"].to_numpy(float).copy()
        flies = ~reserve(prob, size)
        prob[flies] = flight(prob[flies], size[flies], (part["tag"].to_numpy()[flies] % 1_000_003) / 1_000_003)
        part["prob"] = landing(prob, size) if last else prob
        return part[[x.split()[0] for x in _UNIT.split(", ")]]

    return move


def cube_sample(units: DataFrame, counts: DataFrame, scratch: Scratch) -> DataFrame:
    """units: source, doc_id, size, copy, prob. Returns them with prob 0 or 1."""
    rounds = counts.agg(F.max("docs")).first()[0] or 0
    level, done, todo, n = 0, None, units.withColumn("tag", F.xxhash64("doc_id", "source", "size", "copy")), rounds
    while True:
        last = n <= BLOCK

        # as many blocks as keep each near BLOCK; the small sources of a round have one
        share = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(BLOCK * _LEFT**level)))
        blocks = todo.join(counts.select(F.col("source").alias("s"), share.cast("long").alias("blocks")), F.col("source").eqNullSafe(F.col("s")))
        moved = (
            blocks.withColumn("block", F.pmod(F.xxhash64("tag", F.lit(level)), "blocks"))
            .groupBy("source", "block")
            .applyInPandas(_mover(last), _UNIT)
        )
        moved = scratch.table(moved, f"round{level}")
        fixed = moved.where("prob = 0 or prob = 1")
        done = fixed if done is None else done.unionByName(fixed)
        if last:
            return done
        todo, level, n = moved.where("prob > 0 and prob < 1"), level + 1, -(-n // _LEFT)


def mix_sources(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, copy, times (how often it is taken), source_size and target of each row of ``documents``."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    rows = documents.select(F.col("doc_id").cast("long"), "source", text_size(F.col("text")).alias("size")).groupBy("doc_id", "source", "size").count()
    sized = scratch.table(repeated(rows, "count", "copy").drop("count"), "sizes")
    targets = scratch.table(source_targets(sized, weights, cap), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    counts = targets.select("source", "docs", "source_size", "target", share.alias("share"))
    units = sized.join(
        counts.select(F.col("source").alias("s"), F.least("share", F.lit(cap)).alias("share")), F.col("source").eqNullSafe(F.col("s"))
    ).select("source", "doc_id", "size", "copy", (F.col("share") - F.floor("share")).alias("prob"))
    drawn = cube_sample(units, counts, scratch)
    return drawn.join(counts.withColumnRenamed("source", "s").drop("docs"), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "source", "size", "copy", (F.floor(F.least("share", F.lit(cap))) + F.col("prob")).cast("long").alias("times"), "source_size", "target"
    )


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The mix itself: each row of ``documents`` as often as it is taken (not at all for 0), with ``take`` numbering its repeats.

    A row finds its count by a hash of doc_id, source and size, so texts stay where they are while there are at most BROADCAST_KEYS
    of these. Rows that share all three, or only the hash, are interchangeable or told apart by the three: these alone are range-sorted,
    in the order of their texts' hashes, and numbered. Where a column is called ``take`` already, the number's column has an underscore more.
    """
    h, i, s, z, mark, one, place, first, base, more, times, take = fresh(documents.columns, "of", "of_id", "of_source", "of_size", "mark", "one", "place", "first", "base", "more", "times", "take")
    scratch = Scratch(documents.sparkSession)
    taken = mix_sources(documents).groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("size").alias(z)).agg(
        F.min("times").alias(base), (F.sum("times") - F.min("times") * F.count("*")).alias(more), F.count("*").alias("rows")
    )
    taken = scratch.table(taken.withColumn(h, F.xxhash64(i, s, z)), "taken")
    known = scratch.table(taken.groupBy(h).agg(F.when(F.sum("rows") == 1, F.max(F.col(base) + F.col(more))).alias(times)), "known")

    keys = {i: F.col("doc_id").cast("long"), s: F.col("source"), z: text_size(F.col("text"))}
    keyed = documents.withColumn(h, F.xxhash64(*keys.values()))
    counted = keyed.join(small(known, BROADCAST_KEYS), h).where(F.col(times) > 0).select(*own(documents), times)
    shared = known.where(F.col(times).isNull()).select(h)
    if not shared.isEmpty():
        rows = keyed.join(small(shared, BROADCAST_KEYS), h, "left_semi").drop(h).withColumns(keys | {mark: F.xxhash64("text"), one: F.lit(1).cast("long")})
        placed = running(rows, [i, s, z, mark], one, place, scratch)
        begin = placed.groupBy(i, s, z).agg(F.min(place).alias(first))
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in (i, s, z)]
        told = begin.alias("x").join(taken.alias("y"), same[0] & same[1] & same[2]).select(*[f"y.{k}" for k in (i, s, z, base, more)], first)
        told = small(scratch.table(told, "told"), BROADCAST_KEYS)
        met = placed.alias("x").join(told.alias("y"), same[0] & same[1] & same[2])
        again = F.col(base) + (F.col(place) - F.col(first) < F.col(more)).cast("long")
        counted = counted.unionByName(met.withColumn(times, again).where(F.col(times) > 0).select(*[F.col(f"x.{quoted(c)}") for c in documents.columns], times))
    return repeated(counted, times, take).drop(times)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))
