"""Decontamination against every window of every item."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from candlewright.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, span=10):
    out = []
    for i, t in docs:
        ws = words(t)
        hit, names = set(), set()
        for name, text in items:
            iw = words(text)
            n = min(span, len(iw))
            windows = {tuple(iw[a : a + n]) for a in range(len(iw) - n + 1)} if n else set()
            for a in range(len(ws) - n + 1):
                if tuple(ws[a : a + n]) in windows:
                    hit.update(range(a, a + n))
                    names.add("null" if name is None else str(name))
        out.append(repr((i, len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit))))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)] + ["É", "ß", "W1", "日本", "z" * 90]
    text = lambda n: "".join(w + rng.choice([" ", ", ", "\n", "-"]) for w in rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([3, 5, 9, 10, 11, 14, 30]))) for i in range(12)] + [(None, text(12)), (3, text(12)), (50, ""), (51, None), (52, "!!"), (53, "a " * 40)]
    docs = []
    for i in range(80):
        t = text(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            ws = words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(ws) - 1))
            t += " ".join(ws[a : a + rng.randint(1, 20)]) + ". " + text(rng.randint(0, 5))
        docs.append((i, t))
    docs += [(90, None), (91, ""), (None, docs[0][1]), (1, docs[2][1]), docs[3], docs[3], (92, "a " * 3000)]
    frame = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], "doc_id long, text string, item string, name string, n_words long").repartition(3)
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id long")
    got = decontaminate.decontaminate(frame, bench).collect()
    assert sorted(repr(tuple(r)) for r in got) == plain(docs, items)
    kept = decontaminate.clean_documents(frame, bench)
    assert kept.columns == frame.columns
    assert kept.count() == sum(not eval(x)[5] for x in plain(docs, items))


def test_empty_tables(spark):
    frame = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(frame.limit(0), bench).count() == 0
    assert [r.contaminated for r in decontaminate.decontaminate(frame, bench.limit(0)).collect()] == [False]
    assert [r.n_hit for r in decontaminate.decontaminate(frame, bench).collect()] == [3]
