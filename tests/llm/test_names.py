"""Every stage of the pipeline under column names that need quoting, and the survivors of near duplicates by key."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from candlewright.llm import jaccard
from candlewright.llm.runtime import Scratch

ODD = ["a.b", "back`tick", "sp ace", "struct", "row", "rows", "c0", "of"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    words = lambda n: " ".join(f"v{rng.randrange(900)}" for _ in range(n))
    item, base = words(14), words(60)
    rows = [(i, words(40), f"s{i % 3}", 0) for i in range(40)] + [(50, base, "s0", 0), (51, base + " tail", "s0", 0), (50, base, "s0", 0), (52, words(5) + " " + item, "s1", 0)]
    rows += [(53, words(9) + " password=abcdef123", "s1", 0), (None, None, None, None), (None, words(30), "s2", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("lang", F.lit("en"))
    for k, name in enumerate(ODD):
        docs = docs.withColumn(name, F.struct(F.lit(k).alias("x y"), F.lit("v").alias("p.q")) if name == "struct" else F.lit(k))
    folder = Scratch(spark).path("odd")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 2)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, stage):
    folder, docs = odd
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, folder)
    rows = Scratch(spark).table(out, "out").collect()
    assert rows and [c for c in out.columns if c != "take"] == docs.columns
    for r in rows:
        assert [r[c] for c in ODD if c != "struct"] == [k for k, c in enumerate(ODD) if c != "struct"]
        assert r["struct"]["x y"] == 3 and r["struct"]["p.q"] == "v"


@pytest.mark.parametrize("bound", [500_000, 0])
def test_survivors(spark, odd, monkeypatch, bound):
    monkeypatch.setattr(jaccard, "BROADCAST_GONE", bound)
    out = jaccard.near_duplicate_survivors(odd[1]).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted([*map(str, range(40)), "50", "52", "53", "None", "None"])
