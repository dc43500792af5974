"""Substring dedup against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from candlewright.llm import substrings

DOCS = "doc_id long, text string, id long, spans string"


def plain(rows, size):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    first = {}
    for i, ws in sorted(words, key=lambda x: key(x[0])):
        for a in range(len(ws) - size + 1):
            w, here = tuple(ws[a : a + size]), (key(i), a)
            first[w] = min(first.get(w, here), here)
    out = []
    for i, ws in words:
        gone = set()
        for a in range(len(ws) - size + 1):
            if first[tuple(ws[a : a + size])] != (key(i), a):
                gone.update(range(a, a + size))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日本語の長い単語", "x" * 100]
    passages = [rng.choices(vocab, k=rng.randint(5, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        ws = []
        for _ in range(rng.randint(0, 5)):
            ws += rng.choice(passages) if rng.random() < 0.5 else rng.choices(vocab, k=rng.randint(1, 30))
        rows.append((i, "".join(w + rng.choice([" ", "\n", "  ", "\t"]) for w in ws)))
    rows += [(500, None), (501, ""), (502, "a " * 300), (503, "b c " * 200), (None, rows[3][1]), (None, rows[4][1]), rows[5], rows[5], (6, rows[7][1]), (504, "\0 " * 30), (505, "x " + "q " * 9 + "y z"), (506, "p " * 9), (507, "k " + "m n " * 5 + "l")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "group"), [(1, 24 << 20), (2, 10), (3, 24 << 20)])
def test_against_all_windows(spark, monkeypatch, seed, group):
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)
    if group == 10:
        monkeypatch.setattr(substrings, "CHUNK_BYTES", 600)
    rows = corpus(seed, 120)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(3)
    got = sorted(repr(tuple(r)) for r in substrings.dedup_substrings(frame, 8, 3).collect())
    assert got == plain(rows, 8)


def test_default_size_and_empty(spark):
    rows = corpus(4, 60)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)
    assert sorted(repr(tuple(r)) for r in substrings.dedup_substrings(frame).collect()) == plain(rows, 20)
    assert substrings.dedup_substrings(frame.limit(0)).count() == 0
    kept = substrings.dedup_substrings(frame, texts=True).where("n_removed = 0 and doc_id = 502").collect()
    assert not kept
