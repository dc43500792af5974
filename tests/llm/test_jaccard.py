"""Jaccard components against all pairs."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from candlewright.llm import jaccard
from candlewright.llm.runtime import Scratch

DOCS = "doc_id long, text string, node long, n long, tokens string"


def plain(rows, size, percent):
    sets = []
    for _, t in rows:
        ws = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(ws[a : a + size]) for a in range(len(ws) - size + 1)} or ({tuple(ws)} if ws else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low.setdefault(find(k), []).extend([] if i is None else [i])
    return sorted(repr((i, len(sets[k]), min(low[find(k)]) if sets[k] and low[find(k)] else i)) for k, (i, _) in enumerate(rows))


def corpus(seed, n, base):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    bases = [rng.choices(vocab, k=rng.randint(1, 120)) for _ in range(base)]
    common = rng.choices(vocab, k=8)
    rows = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            ws[rng.randrange(len(ws))] = rng.choice([*vocab, f"u{i}"])
        if rng.random() < 0.3:
            ws += common
        if rng.random() < 0.2:
            ws += rng.choices(vocab, k=rng.randint(1, 8))
        text = " ".join(ws)
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two"), (None, rows[0][1]), (None, "only null here"), rows[1], (3, rows[2][1]), (906, "a " * 2000), (907, "a " * 2500)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "base", "size", "percent", "dense", "chunk"), [(1, 250, 40, 3, 90, 24, 1024), (2, 250, 3, 3, 90, 8, 16), (3, 200, 10, 5, 80, 4, 8), (4, 200, 60, 1, 60, 24, 1024)])
def test_against_all_pairs(spark, monkeypatch, seed, n, base, size, percent, dense, chunk):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus(seed, n, base)
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS).repartition(3)
    got = sorted(repr(tuple(r)) for r in jaccard.jaccard_components(frame, size, percent).collect())
    assert got == plain(rows, size, percent)


def test_shuffled_ids_and_empty(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rows = corpus(5, 60, 10)
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)
    assert sorted(repr(tuple(r)) for r in jaccard.jaccard_components(frame, 3, 90).collect()) == plain(rows, 3, 90)
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0


@pytest.mark.parametrize("most", [500_000, 0])
def test_each_row_meets_its_own_class(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", most)
    met, find = [], jaccard.chosen_texts

    def counted(documents, chosen):
        met.append((find(documents, chosen).count(), chosen.count()))
        return find(documents, chosen)

    monkeypatch.setattr(jaccard, "chosen_texts", counted)
    rows = [(None if i % 3 else 7, text) for i, (_, text) in enumerate(corpus(6, 150, 10))]  # one null and one repeated key
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)
    assert sorted(repr(tuple(r)) for r in jaccard.jaccard_components(frame, 3, 90).collect()) == plain(rows, 3, 90)
    assert met[0][1] > 50 and met[0][1] <= met[0][0] <= len(rows)


def test_forest_connects_what_links_connect():
    import numpy as np

    link = np.zeros((6, 6), dtype=bool)
    for a, b in [(0, 1), (1, 2), (0, 2), (4, 5)]:
        link[a, b] = link[b, a] = True
    assert len(jaccard.forest(link)) == 3


def test_only_rows_that_may_meet_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    frame = spark.createDataFrame([(None if i == 8 else i, f"text {i}") for i in range(2000)], "doc_id long, text string")
    marked = frame.selectExpr("doc_id", "xxhash64(text) AS mark", "doc_id AS node", "text")
    ids = marked.where("coalesce(doc_id, 8) % 40 = 8").drop("text")
    left, _ = jaccard._to_meet(marked, ids, ["doc_id", "mark"])
    assert ids.count() <= left.count() < 60 and ids.exceptAll(left.drop("text")).isEmpty()
    chosen = ids.selectExpr("coalesce(node, -1) AS node", "struct(doc_id IS NULL AS no_id, doc_id, mark) AS rep")
    met = jaccard.chosen_texts(frame, chosen).collect()
    assert sorted((r.node, r.text) for r in met) == sorted((-1 if i == 8 else i, f"text {i}") for i in range(8, 2000, 40))


def test_drop_frees_shuffle_files(spark):
    def files():
        held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f.getName() for f in (held.apply(i) for i in range(held.size())) if f.getName().endswith(".data")}

    scratch, before = Scratch(spark), files()
    table = scratch.table(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "sums")
    made = files() - before
    assert made and table.count() == 100
    scratch.drop(table)
    end = time.time() + 20
    while made & files() and time.time() < end:
        time.sleep(0.2)
    assert not made & files()


def test_chance_makes_no_blocks_and_keeps_no_whole_sets(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "DENSE", 8)
    made, write = [], Scratch.table

    def counted(self, df, name):
        out = write(self, df, name)
        made.append((name, out.columns, out.count()))
        return out

    monkeypatch.setattr(Scratch, "table", counted)
    rng = random.Random(7)
    rows = [(i, " ".join(map(str, [*rng.sample(range(1000, 3000), 30), *rng.sample(range(120), 10)]))) for i in range(200)]
    rows += [(1000 + i, rows[i][1] + f" u{i}") for i in range(5)]
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)
    assert sorted(repr(tuple(r)) for r in jaccard.jaccard_components(frame, 1, 90).collect()) == plain(rows, 1, 90)
    assert max(n for name, _, n in made if name == "chosen") > 100  # all but a few share most words with some other
    assert sum(n for name, _, n in made if name == "blocks") < 100
    assert sum(n for _, columns, n in made if "tokens" in columns) < 100


@pytest.mark.parametrize(("seed", "dense"), [(8, 3), (9, 6)])
def test_pairs_with_rare_and_dense_tokens_are_found(spark, monkeypatch, seed, dense):
    monkeypatch.setattr(jaccard, "DENSE", dense)
    rng = random.Random(seed)
    rows = []
    for i in range(60):  # near copies in groups of 2 to 4, which share some words with all others
        words = [*rng.sample(range(1000, 1600), rng.randint(2, 40)), *rng.sample(range(40), rng.randint(2, 20))]
        for j in range(rng.randint(1, 4)):
            gone = set(rng.sample(range(len(words)), min(j, len(words) - 1)))
            rows.append((10 * i + j, " ".join(str(w) for k, w in enumerate(words) if k not in gone)))
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)
    assert sorted(repr(tuple(r)) for r in jaccard.jaccard_components(frame, 1, 80).collect()) == plain(rows, 1, 80)
