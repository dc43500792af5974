"""Importance resampling against a plain restatement, odd rows included; running sums."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from candlewright.llm import importance
from candlewright.llm.runtime import Scratch, running

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = _WORD.findall((text or "").translate(_AZ))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain(rows, goal, percent=5):
    s, t, out = Counter(), Counter(), []
    for x in goal:
        t.update(features(x)[1])
    for _, x in rows:
        s.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    for i, x in rows:
        n, f = features(x)
        weight = sum(math.floor(1000 * math.log((t[k] + 1) * (S + 10_000) / ((s[k] + 1) * (T + 10_000)))) for k in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return out


def test_scores_and_draw(spark):
    rng = random.Random(5)
    words = ["Alpha", "beta", "ΓΑΜΜΑ", "İx", "d3", "e-f", "日本", "g", "h\x7fi"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 19, 20, 60])))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "..."), (403, " ,one two"), (404, "a " * 30_000), (None, "alpha beta " * 15), (None, None), (5, rows[5][1]), (405, "x\x00y")]
    goal = ["alpha d3 g " * 20, None, "", "beta beta"]
    frame = spark.createDataFrame([(i, x, "w", 1) for i, x in rows], "doc_id long, text string, word string, row int").repartition(3)
    got = importance.importance_scores(frame, spark.createDataFrame([(x,) for x in goal], "text string"), percent=30)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(([*r] for r in got.collect()), key=key) == sorted(plain(rows, goal, 30), key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.importance_scores(none, none).count() == 0
    one = spark.createDataFrame([(1, "word " * 25)], "doc_id long, text string")
    assert [[*r] for r in importance.importance_scores(one, none).collect()] == plain([(1, "word " * 25)], [])


def test_running_sums_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(50), i, rng.randrange(5)) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k int, i int, part long").repartition(7)
    got = {r.i: r.before for r in running(frame, ["k", "i"], "part", "before", Scratch(spark)).collect()}
    at = 0
    for _, i, n in sorted(rows):
        assert got[i] == at
        at += n
    assert running(frame.limit(0), ["k"], "part", "before", Scratch(spark)).count() == 0
