"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors have cosine >= t exactly if their squared distance is at most 2 - 2t. After a fixed random rotation
the coordinates are split into BLOCKS low-dimensional blocks, each with a share of that budget in proportion to
its dimensions; a pair within the whole budget is within the budget of some block. Each block is range-joined on
a grid over its first coordinates: a vector stands in its own cell and probes the neighbouring cells within the
block's radius. Rows of this join hold the block's coordinates alone, in single precision, and its products find the
pairs within the block's budget and a margin for rounding. Pairs are verified exactly, in double precision, and count
in the first block that holds them, so the union of the blocks has each pair once.

A cell of many vectors is dealt in chunks, chunk by chunk. Few pairs (THIN for each vector that has one) are verified by key.
Where vectors lie so close that a chunk has more, those that have any are sent whole, once, and the task returns each
vector's number of links and a spanning forest, never all pairs. Equal vectors are one node with a number of copies.

Defined results: vectors that are null, empty, zero or hold null or non-finite components have no link and are
their own component; vectors of different lengths never link; a repeated row is one more vector; a null vec_id
takes its component's least id, or null; other columns (labels too) are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.components import components
from candlewright.llm.runtime import Scratch, small

BLOCKS, CHUNK, THIN = 4, 16384, 1
#: Rows of a matrix product and verified pairs at once; rounding allowed for in double and in single precision.
_STRIP, _SLAB, _SLACK, _SINGLE = 512, 50_000, 1e-9, 1e-5
#: Cells and rows up to which they are broadcast (40 and 36 bytes each).
BROADCAST_ROWS = 200_000


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(5).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def bounds(dim: int) -> list[tuple[int, int]]:
    parts = np.array_split(np.arange(dim), min(BLOCKS, dim))
    return [(int(p[0]), int(p[-1]) + 1) for p in parts]


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated."""
    vectors = vectors.astype(np.float64)
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / scale
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.ascontiguousarray(vectors @ rotation(vectors.shape[1]).T)


def _turn(parts):
    """Each node's rotated unit vector, once and for all, so that all tasks see the same bits."""
    for part in parts:
        for dim, some in part.groupby("dim", sort=True):
            x = rotated(np.stack(some["embedding"].to_numpy()))
            yield pd.DataFrame({"node": some["node"].to_numpy(), "copies": some["copies"].to_numpy(), "dim": np.int32(dim), "turned": [r.tobytes() for r in x]})


def _matrix(turned: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(turned), dtype=np.float64).reshape(-1, dim)


def budgets(dim: int, cosine: float) -> np.ndarray:
    return np.array([(2 - 2 * cosine) * (b - a) / dim for a, b in bounds(dim)]) * (1 + _SLACK) + _SLACK


def _place(cosine: float, grid: int):
    """Rows (block, cell, home, part) of each vector: its own cell, and the smaller-numbered cells within the block's radius. part: its coordinates in the block."""

    def work(parts):
        for part in parts:
            for dim, some in part.groupby("dim", sort=True):
                x = _matrix(some["turned"], dim)
                node = some["node"].to_numpy()
                for block, ((low, high), budget) in enumerate(zip(bounds(dim), budgets(dim, cosine), strict=True)):
                    g = min(grid, high - low)
                    radius = math.sqrt(budget)
                    width = 2 * radius * (1 + 1e-6)
                    at = np.floor(x[:, low : low + g] / width)
                    side = np.where(x[:, low : low + g] - at * width <= radius * (1 + 1e-7), -1, 1)
                    at = at.astype(np.int64) + 4096
                    own = sum(at[:, d] << (13 * d) for d in range(g))
                    coords = np.array([r.tobytes() for r in np.ascontiguousarray(x[:, low:high], dtype=np.float32)], dtype=object)
                    for bits in range(1 << g):
                        cell = sum((at[:, d] + (side[:, d] if bits >> d & 1 else 0)) << (13 * d) for d in range(g))
                        take = np.ones(len(x), dtype=bool) if not bits else cell < own
                        yield pd.DataFrame({"dim": np.int32(dim), "block": np.int32(block), "cell": cell[take], "home": not bits, "node": node[take], "part": coords[take]})

    return work


def _squares(x: np.ndarray, first: bool) -> np.ndarray:
    """Rows (or columns) whose product is the squared distance: |a|^2 + |b|^2 - 2ab."""
    square, one = (x * x).sum(axis=1, keepdims=True), np.ones((len(x), 1), dtype=x.dtype)
    out = np.hstack([-2 * x, square, one] if first else [x, one, square]).astype(np.float32)
    return np.ascontiguousarray(out if first else out.T)


def _sides(key: tuple, part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    i, j = int(key[3]), int(key[4])
    part = part.sort_values("node", kind="stable")
    left = part[part["chunk"] == i]
    return (left, left, True) if i == j else (left, part[part["chunk"] == j], False)


def _near(a: np.ndarray, b: np.ndarray, home_a: np.ndarray, home_b: np.ndarray, same: bool, most: float):
    """Strips of pairs (rows, columns) within the budget, each pair once, at least one of the two at home."""
    wide_a, wide_b = _squares(a, first=True), _squares(b, first=False)
    most = np.float32(most + _SINGLE)
    for s in range(0, len(a), _STRIP):
        skip = s if same else 0  # pairs of one chunk: each once
        p, q = np.nonzero(wide_a[s : s + _STRIP] @ wide_b[:, skip:] <= most)
        p, q = p + s, q + skip
        keep = home_a[p] | home_b[q]
        if same:
            keep &= p < q
        yield p[keep], q[keep]


_FOUND = "u long, v long, dim int, block int, cell long, i int, j int"


def _candidates(cosine: float):
    """Pairs (u, v) of a chunk pair within the block's budget; where they are more than THIN for each row that has one, these rows (v null)."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(key[0]), int(key[1])
        left, right, same = _sides(key, part)
        low, high = bounds(dim)[block]
        a, b = (np.frombuffer(b"".join(f["part"]), dtype=np.float32).reshape(-1, high - low) for f in (left, right))
        on_a, on_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        rows, cols, n = [], [], 0
        for p, q in _near(a, b, left["home"].to_numpy(), right["home"].to_numpy(), same, budgets(dim, cosine)[block]):
            n += len(p)
            on_a[p], on_b[q] = True, True
            if n <= THIN * len(part):
                rows.append(p)
                cols.append(q)
        id_a, id_b = left["node"].to_numpy(), right["node"].to_numpy()
        some = np.unique(np.concatenate([id_a[on_a], id_b[on_b]]))
        if n > THIN * len(some):
            u = some
            v = pd.array([None] * len(u), dtype="Int64")
        else:
            at = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (rows, cols))
            u, v = (i[x] for i, x in zip((id_a, id_b), at, strict=True))
            v = pd.array(v, dtype="Int64")
        types = {"dim": np.int32, "block": np.int32, "cell": np.int64, "i": np.int32, "j": np.int32}
        return pd.DataFrame({"u": u, "v": v} | {k: np.full(len(u), x, dtype=t) for (k, t), x in zip(types.items(), key, strict=True)})

    return work


def _linked(a: np.ndarray, b: np.ndarray, block: np.ndarray | int, cosine: float) -> np.ndarray:
    """Of pairs of rows: do they link, and is this block the first that holds them?"""
    dim = a.shape[1]
    gap = (a - b) ** 2
    within = np.stack([gap[:, x:y].sum(axis=1) <= limit for (x, y), limit in zip(bounds(dim), budgets(dim, cosine), strict=True)])
    return ((a * b).sum(axis=1) >= cosine) & within.any(axis=0) & (within.argmax(axis=0) == block)


def _check(cosine: float):
    """Candidates with both vectors to links: u, v, and the copies of each."""

    def work(parts):
        for part in parts:
            for dim, some in part.groupby("dim", sort=True):
                ok = _linked(_matrix(some["a"], dim), _matrix(some["b"], dim), some["block"].to_numpy(), cosine)
                yield some.loc[ok, ["u", "v", "copies_u", "copies_v"]]

    return work


def _crowd(cosine: float):
    """Of a chunk pair with whole vectors: u, n (links of u, v null), and u, v of a spanning forest (n 0)."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dim, block = int(key[0]), int(key[1])
        left, right, same = _sides(key, part)
        a, b = _matrix(left["turned"], dim), _matrix(right["turned"], dim)
        low, high = bounds(dim)[block]
        ids = part["node"].to_numpy()
        ids = np.unique(ids)
        at_a, at_b = np.searchsorted(ids, left["node"].to_numpy()), np.searchsorted(ids, right["node"].to_numpy())
        copies_a, copies_b = left["copies"].to_numpy(), right["copies"].to_numpy()
        links, group, tree = np.zeros(len(ids)), np.arange(len(ids)), []
        parts = [np.ascontiguousarray(x[:, low:high], dtype=np.float32) for x in (a, b)]
        for p, q in _near(*parts, left["home"].to_numpy(), right["home"].to_numpy(), same, budgets(dim, cosine)[block]):
            for t in range(0, len(p), _SLAB):
                u, v = p[t : t + _SLAB], q[t : t + _SLAB]
                ok = _linked(a[u], b[v], block, cosine)
                u, v = u[ok], v[ok]
                links += np.bincount(at_a[u], weights=copies_b[v], minlength=len(ids)) + np.bincount(at_b[v], weights=copies_a[u], minlength=len(ids))
                u, v = at_a[u], at_b[v]
                while True:  # joins a pair of groups at a time, so a pair is kept only where it joins two
                    apart = np.flatnonzero(group[u] != group[v])
                    if not len(apart):
                        break
                    x, y = np.minimum(group[u[apart]], group[v[apart]]), np.maximum(group[u[apart]], group[v[apart]])
                    high_of, first = np.unique(y, return_index=True)
                    tree += zip(u[apart[first]].tolist(), v[apart[first]].tolist(), strict=True)
                    to = np.arange(len(ids))
                    to[high_of] = x[first]
                    while True:  # to the least group of a chain
                        down = to[to]
                        if (down == to).all():
                            break
                        to = down
                    group = to[group]
        other = ids[[t[1] for t in tree]].tolist() if tree else []
        some = links > 0
        return pd.DataFrame(
            {
                "u": np.concatenate([ids[some], ids[[t[0] for t in tree]] if tree else ids[:0]]),
                "v": pd.array([None] * int(some.sum()) + other, dtype="Int64"),
                "n": np.concatenate([np.rint(links[some]).astype(np.int64), np.zeros(len(tree), dtype=np.int64)]),
            }
        )

    return work


_KEYS = ["dim", "block", "cell", "i", "j"]


def _nodes(embeddings: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """vec_id, node (null for vectors that link with nothing), embedding of each row; node, rep, copies, embedding of each distinct vector."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = e.isNotNull() & finite & F.exists(e, lambda x: x != 0)
    for seed in range(64):
        node = F.when(good, F.xxhash64(e.cast("array<double>"), F.lit(seed)))
        rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), node.alias("node"), e.cast("array<double>").alias("embedding"))
        kept = rows.where("node is not null").groupBy("node")
        nodes = kept.agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min("embedding").alias("embedding"), F.max("embedding").alias("other"))
        nodes = scratch.table(nodes, "nodes")
        if nodes.where("embedding <> other").isEmpty():
            break
        scratch.drop(nodes)  # two vectors have one hash: another hash
    return rows, nodes.drop("other")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows, nodes = _nodes(embeddings, scratch)
    n = nodes.count()
    grid = min(4, 1 + max(0, int(math.log10(max(n, 1) / 1e5)) + (n > 1e5)))
    vectors = nodes.select("node", "copies", F.size("embedding").alias("dim"), "embedding")
    vectors = scratch.table(vectors.mapInPandas(_turn, "node long, copies long, dim int, turned binary"), "vectors")
    spots = vectors.select("node", "dim", "turned").mapInPandas(_place(cosine, grid), "dim int, block int, cell long, home boolean, node long, part binary")
    spots = scratch.table(spots, "spots")
    crowded = spots.groupBy("dim", "block", "cell").agg(F.count("*").alias("held")).where(f"held > {CHUNK}")
    chunks = F.coalesce(F.ceil(F.col("held") / CHUNK), F.lit(1)).cast("int")
    dealt = (
        spots.join(small(crowded, BROADCAST_ROWS), ["dim", "block", "cell"], "left")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select("dim", "block", "cell", F.least("chunk", "k").alias("i"), F.greatest("chunk", "k").alias("j"), "chunk", "home", "node", "part")
    )
    near = scratch.table(dealt.groupBy(*_KEYS).applyInPandas(_candidates(cosine), _FOUND), "near")
    a, b = (vectors.select(F.col("node").alias(x), F.col("copies").alias(f"copies_{x}"), F.col("turned").alias(y)) for x, y in (("u", "a"), ("v", "b")))
    thin = near.where("v is not null").select("u", "v", "dim", "block").join(a, "u").join(b, "v")
    thin = scratch.table(thin.mapInPandas(_check(cosine), "u long, v long, copies_u long, copies_v long"), "thin")
    thick = near.where("v is null").withColumnRenamed("u", "node").drop("v")
    if thick.isEmpty():
        crowd = spark.createDataFrame([], "u long, v long, n long")
    else:
        met = dealt.drop("part").join(thick, [*_KEYS, "node"]).join(vectors.drop("dim"), "node")
        crowd = scratch.table(met.groupBy(*_KEYS).applyInPandas(_crowd(cosine), "u long, v long, n long"), "crowd")
    counted = thin.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.col("copies_v").alias("n")), F.struct(F.col("v").alias("node"), F.col("copies_u").alias("n")))))
    linked = counted.unionByName(crowd.where("v is null").select(F.col("u").alias("node"), "n")).groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(thin.select("u", "v").unionByName(crowd.where("v is not null").select("u", "v")), scratch)
    scratch.drop(spots, near)
    groups = nodes.select("node", "rep", "copies").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = groups.groupBy("component").agg(F.min("rep").alias("component_id"))
    told = groups.join(names, "component").join(linked, "node", "left").select(
        "node", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links")
    )
    return (
        rows.drop("embedding")
        .join(told, "node", "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op5_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs of one table; for whole tables of a check's size only.
ORACLE_SQL = """
WITH RECURSIVE g AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
c(node, seen) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT c.node, l.v FROM c JOIN l ON c.seen = l.u),
d AS (SELECT u, count(*) AS n FROM l GROUP BY u),
m AS (SELECT node, min(seen) AS component_id FROM c GROUP BY node)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN m ON e.vec_id = m.node LEFT JOIN d ON d.u = e.vec_id
"""
