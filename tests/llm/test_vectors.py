"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from candlewright.llm import vectors


def plain(rows, cosine):
    good = [e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e in rows]
    near = [[] for _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], dtype=np.float64) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    near[a].append(b)
                    near[b].append(a)
    out = []
    for a, (i, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        ids = [rows[b][0] for b in seen if rows[b][0] is not None]
        low = min(ids) if ids else None
        out.append(repr((i, len(near[a]), low, i is not None and i == low)))
    return sorted(out)


@pytest.mark.parametrize(("seed", "dim", "chunk"), [(1, 64, 8192), (2, 16, 20), (3, 3, 8192)])
def test_against_all_pairs(spark, monkeypatch, seed, dim, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, dim))
    rows = []
    for i in range(220):
        v = base[rng.integers(40)] + rng.normal(size=dim) * rng.choice([0, 0.1, 0.3, 0.5])
        rows.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 100])]))
    rows += [(300, None), (301, [0.0] * dim), (302, [float("nan")] + [1.0] * (dim - 1)), (303, [float("inf")] + [1.0] * (dim - 1)), (304, []), (305, [None] + [1.0] * (dim - 1)), (306, [1.0, 1.0]), (307, [1.0, 1.0]), (None, rows[0][1]), rows[1]]
    frame = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, label int, node int")
    got = sorted(repr(tuple(r)) for r in vectors.near_duplicates(frame).collect())
    assert got == plain(rows, 0.95)


def test_empty(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(frame).count() == 0
