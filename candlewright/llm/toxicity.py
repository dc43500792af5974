"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The model is fitted on a bounded sample (SAMPLE rows, by hash of doc_id) of the labelled rows that are not held
out, in three parts: one for the lexicon (words and word beginnings that toxic documents have far more often), one
for the trees, one for the calibration. Features of a whole text: densities of the fitted and of a fixed lexicon,
closeness of a lexicon word to a second-person word, capitals, punctuation, and words with digits or signs for
letters. Labels, language, source and ids are never features.

Trees and calibration are Spark ML's; every text is scored by the same plan, with no driver step.

Defined results: null and empty texts have all features 0 and are scored; a null doc_id is not held out and not
learned from; the greatest label of a repeated doc_id counts, null labels do not; where the sample has no two classes in the parts to
fit, every score is the share of toxic labels in it; repeated rows get a row each; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from candlewright.llm.runtime import Scratch, batches, column, quoted

#: Labelled rows that the model is fitted on, at most, and the tenths of them for the lexicon, the trees and the calibration.
SAMPLE, PARTS = 16_000, (5, 3, 2)
FOLDS = 5
#: The model's own parameters: entries of the fitted lexicon at most, by likelihood ratio, and what an entry needs: documents, log-odds, likelihood ratio.
ENTRIES, LEAST_DOCS, LEAST_ODDS, LEAST_RATIO = 3000, 4, 1.5, 15.0
#: Features 6 to 8 are of the heaviest words of the whole text: how often one word counts there, and how many are added up.
REPEATS, STRONGEST = 3, 8
TREES, DEPTH = 20, 3
_STEMS = (4, 5)

# Plain insults, and second-person words of the languages served.
INSULTS = frozenset("idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb fool imbecile garbage filth vermin jerk creep ugly hate".split())
SECOND_PERSON = frozenset("you your yours u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())

_WORD = re.compile(r"[^\W_](?:[\w@$*]*[^\W_])?")
_PLAIN = str.maketrans("013457@$", "oieastas")
_FEATURES = 14
_ASCII_CAPITALS = bytes(range(0x41, 0x5B))
_ASCII_LETTERS = _ASCII_CAPITALS + bytes(range(0x61, 0x7B))
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
#: Words of at most this length are remembered from text to text, so many at a time.
_KEPT_LENGTH, _KEPT = 40, 200_000


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % folds == 0, F.lit(False))


def _names(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in _STEMS if len(word) > n)]


class Features:
    """The features of texts, for one lexicon. What is known of a word (its weight, is it a fixed insult, has it odd signs) is kept for the next text."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.known = lexicon, {}

    def word(self, w: str) -> tuple[float, bool, bool]:
        odd = not w.isalpha()
        plain = w.translate(_PLAIN).replace("*", "") if odd else w
        best = max((self.lexicon.get(x, 0.0) for x in _names(w)), default=0.0)
        fixed = plain in INSULTS
        out = (max(best, 1.0) if fixed else best), fixed, odd
        if len(w) <= _KEPT_LENGTH:
            if len(self.known) >= _KEPT:
                self.known.clear()
            self.known[w] = out
        return out

    def of(self, text: str) -> list[float]:
        out = [0.0] * _FEATURES
        words = _WORD.findall(text.lower()) if text else []
        n = len(words)
        if not n:
            return out
        weight: dict[str, float] = {}
        hits = fixed = odd = 0
        weighed, strong, known, word = 0.0, [], self.known, self.word
        for w, times in Counter(words).items():
            best, insult, strange = known.get(w) or word(w)
            if strange:
                odd += times
            if best:
                weight[w] = best
                hits += times
                fixed += times * insult
                weighed += times * best
                strong += [best] * min(times, REPEATS)
        strong.sort(reverse=True)
        letters, capitals = _letters(text)
        out[0] = log1p(n)
        out[1] = hits / n
        out[2] = fixed / n
        out[3] = log1p(hits)
        out[4] = log1p(fixed)
        out[5] = weighed / n
        out[6] = strong[0] if strong else 0.0
        out[7] = strong[1] if len(strong) > 1 else 0.0
        out[8] = sum(strong[:STRONGEST])
        out[9] = _nearness(words, weight) if weight else 0.0
        out[10] = capitals / (letters or 1)
        out[11] = (text.count("!") + text.count("?")) / n
        out[12] = sum(map(text.count, ".,;:")) / n
        out[13] = odd / n
        return out


def _nearness(words: list[str], weight: dict[str, float]) -> float:
    """1 / (1 + the least distance, in words, of a lexicon word to a second-person word); 0 without such a pair."""
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    if not you:
        return 0.0
    spots, bad = np.array(you), np.array([i for i, w in enumerate(words) if w in weight])
    at = np.searchsorted(spots, bad)
    before, after = spots[np.maximum(at - 1, 0)], spots[np.minimum(at, len(spots) - 1)]
    return 1 / (1 + int(np.minimum(abs(bad - before), abs(after - bad)).min()))


def _letters(text: str) -> tuple[int, int]:
    """Letters and capitals of a text: those of ASCII by deletion, others one by one."""
    plain = text.encode("ascii", "ignore")
    letters, capitals = len(plain) - len(plain.translate(None, _ASCII_LETTERS)), len(plain) - len(plain.translate(None, _ASCII_CAPITALS))
    if len(plain) < len(text):
        rest = "".join(_NOT_ASCII.findall(text))
        letters, capitals = letters + sum(map(str.isalpha, rest)), capitals + sum(map(str.isupper, rest))
    return letters, capitals


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    return Features(lexicon).of(text)


def _featured(frame: DataFrame, lexicon) -> DataFrame:
    """The frame's columns but text, and features."""
    keep = [f for f in frame.schema.fields if f.name != "text"]
    names = [f.name for f in keep]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(lexicon.value)
        for batch in parts:
            rows = [known.of(t.as_py() or "") for t in column(batch, "text")]
            flat = pa.array(np.array(rows, dtype=np.float64).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * _FEATURES), flat)
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in names), lists], [*names, "raw"])

    return batches(frame, step, StructType([*keep, StructField("raw", ArrayType(DoubleType()))]))


def fit_lexicon(rows: DataFrame) -> dict[str, float]:
    """Log-odds of words and word beginnings (marked ~) that toxic documents have more often; rows: text, toxic."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            count: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(column(batch, "text").to_pylist(), column(batch, "toxic").to_pylist(), strict=True):
                count[toxic].update({x for w in set(_WORD.findall((text or "").lower())) for x in _names(w)})
            names = list(count[0].keys() | count[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([count[1][x] for x in names], pa.int64()), pa.array([count[0][x] for x in names], pa.int64())],
                ["name", "bad", "good"],
            )

    total = rows.agg(F.sum("toxic"), F.count("*")).first()
    bad, good = total[0] or 0, (total[1] or 0) - (total[0] or 0)
    if not bad or not good:
        return {}
    a, b = F.col("bad"), F.col("good")
    odds = F.log((a + 0.5) / (bad + 1)) - F.log((b + 0.5) / (good + 1))
    expect = (a + b) * bad / (bad + good)
    ratio = 2 * (a * F.log(a / expect) + F.when(b > 0, b * F.log(b / ((a + b) - expect))).otherwise(0.0))
    found = (
        batches(rows.select("text", "toxic"), step, "name string, bad long, good long")
        .groupBy("name")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .where(a >= LEAST_DOCS)
        .withColumn("odds", odds)
        .where((F.col("odds") >= LEAST_ODDS) & (ratio >= LEAST_RATIO))
        .orderBy(ratio.desc(), "name")
        .limit(ENTRIES)
        .collect()
    )
    return {r["name"]: r["odds"] for r in found}


def toxicity_scores(documents: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, carry: tuple[str, ...] = (), sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row, then the ``carry`` columns. labelled: the texts to learn from, if not ``documents``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    spark = documents.sparkSession
    scratch = Scratch(spark)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("id"))
        .agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
        .orderBy(F.xxhash64("id"))
        .limit(sample)
    )
    texts = (labelled if labelled is not None else documents).select(F.col("doc_id").cast("long").alias("id"), "text")
    tenth = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(10))
    part = F.when(tenth < PARTS[0], 0).when(tenth < PARTS[0] + PARTS[1], 1).otherwise(2)
    # at most ``sample`` ids and labels are broadcast
    rows = scratch.table(texts.join(F.broadcast(known), "id").select("id", "toxic", part.alias("part"), "text"), "labelled")
    lexicon = spark.sparkContext.broadcast(fit_lexicon(rows.where("part = 0")))
    ready = scratch.table(_featured(rows.select("toxic", "part", "text").where("part > 0"), lexicon).coalesce(2), "features")
    classes = {(r["part"], r["toxic"]) for r in ready.select("part", "toxic").distinct().collect()}
    vector = array_to_vector("raw").alias("features")

    everything = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(quoted(c)).alias(f"__c_{i}") for i, c in enumerate(carry)], F.col("text"))
    scored = _featured(everything, lexicon)
    extra = [f"__c_{i}" for i in range(len(carry))]
    if {(1, 0), (1, 1)} <= classes:
        learn = ready.where("part = 1").select(F.col("toxic").cast("double").alias("label"), vector)
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=3).fit(learn)
        margin = vector_to_array("probability")[1]
        scored = trees.transform(scored.select("doc_id", *extra, vector)).select("doc_id", *extra, margin.alias("raw_score"))
        if {(2, 0), (2, 1)} <= classes:
            tune = trees.transform(ready.where("part = 2").select(F.col("toxic").cast("double").alias("label"), vector)).select("label", margin.alias("raw_score"))
            steps = IsotonicRegression(featuresCol="raw_score", labelCol="label", predictionCol="score").fit(tune)
            scored = steps.transform(scored)
        else:
            scored = scored.withColumn("score", F.col("raw_score"))
    else:
        share = rows.agg(F.avg("toxic")).first()[0] or 0.0
        scored = scored.withColumn("score", F.lit(float(share)))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *extra)


def acceptable_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are."""
    names = documents.columns
    out = toxicity_scores(documents, labels, carry=tuple(names)).where("predicted = 0")
    return out.select(*[F.col(f"__c_{i}").alias(c) for i, c in enumerate(names)])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
