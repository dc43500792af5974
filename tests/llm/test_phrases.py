"""Collocations against a plain restatement; the automaton against all runs of words."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from candlewright.llm import phrases
from candlewright.llm.runtime import handed

_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces_of(text):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(_AZ))]


def plain(rows, least, longest, reported):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces_of(text):
            n[lang] += len(ws)
            for size in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1))
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, _, left, right = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:reported], 1)]
    return sorted(out)


ROWS = [
    ("en", None), ("en", ""), (None, "lone words here " * 12), ("und", "lone words, here. " * 3), ("x y", "odd name odd name " * 8), ("", "empty name " * 11),
    ("en", "New York City is new york. " * 15), ("en", "NEW\tYork  city\x0bnew york!" * 9), ("fr", "à la carte fine à la carte; " * 14), ("fr", "\x00a \x00a b\x7f \x85c " * 10), ("en", "a " * 5000),
]


@pytest.mark.parametrize("longest, bits, chunk", [(3, 1 << 16, 1_500_000), (3, 1 << 27, 7), (2, 1 << 16, 50), (4, 1 << 20, 13), (5, 1 << 15, 1_500_000)])
def test_collocations(spark, monkeypatch, longest, bits, chunk):
    monkeypatch.setattr(phrases, "CHUNK", chunk)
    rng = random.Random(longest)
    words = ["Red", "red", "fox", "den", "of", "the", "éa", "日", "x."]
    small = ROWS if chunk > 1000 else [(a, b if b is None else b[:400]) for a, b in ROWS]
    rows = small + [(rng.choice(["en", "fr", None]), " ".join(rng.choices(words, weights=range(1, 10), k=rng.randint(0, 40)))) for _ in range(150)]
    frame = spark.createDataFrame([(i, t, lang, "z", 3) for i, (lang, t) in enumerate(rows)], "doc_id int, text string, lang string, phrase string, n int").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(frame, 5, longest, 40, bits=bits).collect())
    assert got == plain(rows, 5, longest, 40)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_automaton_edges():
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abc,", k=30)) for _ in range(20)]
    shard = phrases.Shard(pa.array(texts, pa.large_string()))
    built = phrases.Automaton(shard, 0, len(shard), 3)
    want = Counter(tuple(ws[i : i + d]) for t in texts for ws in pieces_of(t) for d in (1, 2, 3) for i in range(len(ws) - d + 1))
    runs = [dict(enumerate([()]))]
    for d in (1, 2, 3):
        names, counts = built.phrases(shard.names, d)
        runs.append({i: tuple(p.split(" ")) for i, p in enumerate(names.to_pylist())})
        assert {runs[d][i]: c for i, c in enumerate(counts)} == {p: c for p, c in want.items() if len(p) == d}
        for i, p in runs[d].items():
            assert runs[d - 1][built.head[d][i]] == p[:-1] and runs[d - 1][built.link[d][i]] == p[1:]
    assert np.array_equal(built.count[0], [len(shard)])


def test_large_counts_stay_exact(spark):
    big = 3_000_000_000
    row = spark.sql(f"SELECT CAST(1000000 * CAST({big} AS DECIMAL(38,0)) * {big} AS DECIMAL(38,0)) div CAST(CAST({big + 1} AS DECIMAL(38,0)) * {big + 2} AS DECIMAL(38,0)) AS s").first()
    assert row.s == 1_000_000 * big * big // ((big + 1) * (big + 2))


def test_only_runs_inside_open_ones_are_built():
    shard = phrases.Shard(pa.array(["a b c d e f g h"], pa.large_string()))
    open_ = np.zeros(8, dtype=bool)
    open_[2] = True
    built = phrases.Automaton(shard, 0, 8, 3, open_)
    assert [built.phrases(shard.names, d)[0].to_pylist() for d in (2, 3)] == [["c d", "d e"], ["c d e"]]
    assert built.head[3].tolist() == [0] and built.link[3].tolist() == [1]


def test_a_shard_is_held_in_few_bytes():
    rng = random.Random(3)
    shard = phrases.Shard(pa.array([" ".join(rng.choices("abcdefgh", k=1000)) for _ in range(20)], pa.large_string()), hashed=False)
    built = phrases.Automaton(shard, 0, len(shard), 3)
    held = [shard.word, shard.piece, *(x for level in (1, 2, 3) for x in (built.head[level], built.link[level], built.last[level], built.count[level]))]
    assert shard.hashes is None and {x.itemsize for x in held} == {4}
    whole, counts = built.phrases(shard.names, 3)
    parts = list(built.some_phrases(shard.names, 3, 7))
    assert max(len(x) for x, _ in parts) == 7  # spelt out a few at a time
    assert [p for x, _ in parts for p in x.to_pylist()] == whole.to_pylist() and np.array_equal(np.concatenate([n for _, n in parts]), counts)


def test_shards_stay_within_their_bytes(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 10_000)
    rng = random.Random(4)
    texts = [f"{i} " + "word " * rng.choice([1, 10, 300, 1500]) for i in range(200)] + ["long " * 5000]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], ["lang", "text"])
    shards = [t.to_pylist() for _, t in phrases._shards(batch.slice(a, 50) for a in range(0, len(texts), 50))]
    assert [t for shard in shards for t in shard] == texts
    assert all(sum(map(len, shard)) <= 10_000 or len(shard) == 1 for shard in shards)


def test_python_is_handed_few_rows_at_once(spark):
    def sizes(parts):
        for batch in parts:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with handed(spark, 100):
        assert max(r.n for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").collect()) == 100
    assert spark.conf.get(name) == before
