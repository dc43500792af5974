"""The pipeline, stage by stage, against brute force on a small table; the odd rows of documents; the toxicity model."""

from __future__ import annotations

import random
import re
import zlib

import corpus_pipeline
import pytest
from candlewright.llm import toxicity
from candlewright.llm.runtime import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, extra=()):
    ws = [f"{rng.choice('bcdfgklmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.randint(0, 99)}" for _ in range(n)]
    for w in extra:
        ws.insert(rng.randrange(len(ws) + 1), w)
    return " ".join(ws)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        rows.append((i, sentence(rng, rng.randint(20, 60), rng.choices(["idiot", "scum", "zorgish", "zorgle"], k=4) if toxic else ()), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    base = sentence(rng, 60)
    rows += [(700 + k, base + f" tail{k}", "en", "s1", 0) for k in range(4)] + [(699, base, "en", "s1", 0), (699, base, "en", "s1", 0)]
    item = sentence(rng, 14)
    rows += [(800, sentence(rng, 10) + " " + item, "en", "s2", 0), (801, "clean password=abcdef123 words here", "en", "s2", 30)]
    rows += [(802, None, None, None, None), (803, "", "en", "s0", 0), (None, "lonely row without number", "en", "s0", 1)]
    folder = Scratch(spark).path("corpus")
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, labels, item


def shingles(text, size=5):
    ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(ws[a : a + size]) for a in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set())


def test_stages(spark, corpus):
    folder, rows, labels, item = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.columns == names
    bad = {i for i, _, t in labels if t}
    left = [r.doc_id for r in kept.collect()]
    assert len(set(left) & bad) <= 3 and len(left) >= len(rows) - len(bad) - 3

    once = Scratch(spark).table(kept, "kept")
    single = corpus_pipeline.drop_near_duplicates(spark, once, folder)
    assert single.columns == names
    got = sorted(map(str, (r.doc_id for r in single.collect())))
    low = [i for i in left if i is None or not 700 <= i < 800]
    low.remove(699)
    assert got == sorted(map(str, low))
    a, b = shingles(rows[600][1]), shingles(rows[601][1])
    assert len(a & b) >= 0.8 * len(a | b)

    twice = Scratch(spark).table(single, "single")
    pure = corpus_pipeline.drop_contaminated(spark, twice, folder)
    assert pure.columns == names
    assert sorted(str(r.doc_id) for r in pure.collect()) == [x for x in got if x != "800"]
    safe = corpus_pipeline.mask_secrets(spark, pure, folder)
    assert safe.columns == names and safe.count() == len(got) - 1
    masked = safe.where("doc_id = 801").first()
    assert masked.text == "clean [SECRET] words here" and masked.n_chars == len(masked.text)

    mixed = corpus_pipeline.mix(spark, Scratch(spark).table(safe, "safe"), folder).collect()
    size, took = {}, {}
    for r in safe.collect():
        size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
    for r in mixed:
        took[r.source] = took.get(r.source, 0) + len((r.text or "").split())
    total = sum(size.values())
    for k, s in enumerate(["s0", "s1", "s2"]):
        assert abs(took[s] - total * (k + 1) / 6) < 130
    assert {r.take for r in mixed} <= {1, 2, 3}


def test_near_duplicates_by_text_under_one_id(spark):
    rng = random.Random(5)
    base, other, clean, hot = (sentence(rng, 60) for _ in range(4))
    rows = [(1, base), (5, base + " tail"), (5, clean), (5, hot), (5, hot), (5, hot + " end"), (2, other), (2, other + " tail"), (9, other), (5, " "), (5, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(i for i, _ in got) == [1, 2, 5, 5, 5, 5]  # base; other; clean, hot and the two rows without words
    assert (1, base) in got and (5, clean) in got and got.count((5, " ")) == 2
    assert len({(5, hot), (5, hot + " end")} & set(got)) == len({(2, other), (2, other + " tail")} & set(got)) == 1


def test_near_duplicates_of_rows_without_id(spark):
    rng = random.Random(6)
    base, other, alone = (sentence(rng, 60) for _ in range(3))
    rows = [(0, base), (None, base), (None, base + " tail"), (None, other), (None, other), (None, other + " tail"), (None, alone), (None, None), (None, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert len(got) == 5 and {(0, base), (None, alone), (None, None), (None, " ")} < set(got)
    assert len({(None, other), (None, other + " tail")} & set(got)) == 1


def test_run_and_empty(spark, corpus):
    folder = corpus[0]
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 300 and out.where("text like '%password%'").count() == 0
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_toxicity_held_out(spark, corpus):
    folder, rows, labels, _ = corpus
    out = toxicity.toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert len(out) == len(rows)
    truth = {i: t for i, _, t in labels}
    for r in out:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    fold = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in fold) >= 0.95 * len(fold)


def test_every_lexicon_word_counts_for_nearness():
    assert toxicity.features("stupid plan said he you idiot", {})[9] == 0.5
    assert toxicity.features("you said the stupid fool plan", {})[9] == 0.25
    rng = random.Random(3)
    for _ in range(50):
        words = rng.choices(["you", "idiot", "dumb", "plan", "said"], k=30)
        gaps = [abs(a - b) for a, x in enumerate(words) for b, y in enumerate(words) if x in ("idiot", "dumb") and y == "you"]
        assert toxicity.features(" ".join(words), {})[9] == (1 / (1 + min(gaps)) if gaps else 0)


def test_toxicity_without_labels(spark, corpus):
    docs = spark.read.parquet(f"{corpus[0]}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(1, None, None), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_scores(docs, one).count() == docs.count()
