"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set holds 63-bit hashes of its word shingles; texts with one set are one class, and classes are joined.

1. Each class gives its lowest-hashed tokens, W(n), a third more than a prefix. That is a prefix for
   W(n) - p(n) + 1 matches, so a class that shares fewer given tokens with all others together than the least
   partner would require has no partner and drops out. Partners all stay, so the same is asked once more of those
   that stayed, among themselves.
2. The rest order their sets by hash, with tokens common in the corpus last, and write the longest prefix. Whole sets
   are made again from the texts for the few classes that get as far as being verified. The 1-prefix has
   n - ceil(J n) + 1 tokens. Its candidate cost is estimated by the other holders of its tokens: for each doubling
   (up to LONGEST) the prefix grows by one token and one more shared token is required. A pair needs as many shared
   prefix tokens as the smaller of the two requirements.
3. A prefix token with DENSE holders is dense. The others make pairs, counted by pair; pairs that share too few, or
   whose shared count and remaining tokens cannot add up to the threshold, are dropped. Many dense tokens are shared by
   chance. A pair that shares dense tokens alone shares as many as one of the two requires; a holder that has too few for
   that with any holder of a token leaves it, and where pairs are counted what it has left counts as shared. A dense token
   has a pivot, the holder with the most dense tokens, and each holder makes one pair with it. What sizes and shapes do not rule out
   is verified on the whole sets. Then the holders of dense tokens meet by pivot, in blocks of CHUNK by CHUNK, but for
   those linked with the pivot among themselves. A block compares prefixes and shapes; the few pairs left are verified
   by key, and a block with many gets the whole sets of their members, once, and returns a spanning forest, never all pairs.
4. Components of the links are found by key (components.py).

Defined results: null, empty or blank texts have no set: n_shingles 0, linked with nothing, component_id is the
row's own doc_id; a null doc_id takes the least non-null doc_id of its component, or null; repeated rows come
back each; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm import textscan as ts
from candlewright.llm.components import components
from candlewright.llm.runtime import Scratch, batches, column, fresh, likely, own, slices, small

DENSE, CHUNK, LONGEST = 24, 2048, 6
#: Rounds in which holders leave dense tokens; each is exact.
LEAVE = 2
#: Pairs for each row that has one that a block may leave to be verified by key; a block with more verifies them itself. Bytes of whole sets on a block's side.
THIN, BLOCK_BYTES = 1, 16_000_000
#: Classes up to which their sizes and prefix lengths are broadcast (40 bytes each).
BROADCAST_SIZED = 200_000
#: A token is common if COMMON_LEAST rows gave it, and one row in COMMON; there can be no more of these than COMMON times the
#: tokens that a row gives (8 bytes each are broadcast).
COMMON, COMMON_LEAST = 20_000, 50
#: Class ids up to which they are broadcast to the second reading of the texts (24 bytes each with doc_id and mark, 8 alone); beyond, rows that may be theirs are shuffled.
BROADCAST_IDS = 500_000
#: Keys of rows that go up to which they are broadcast (17 bytes each).
BROADCAST_GONE = 500_000
#: Has a text a word, as shingles are cut?
_WORD = r"[^\x20\x09-\x0D]"
#: Buckets in which a set's tokens are counted: two sets share at most the sum of the smaller counts.
SHAPE = 256
#: Columns of a matrix product at once.
_SLAB = 1024
#: A bucket's count from here on is not known exactly; such sets pass.
_MOST = 32_000


def row_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted set of each text (63-bit hashes)."""
    words = ts.split(texts, ts.SPACE, lower=True)
    h = ts.word_hashes(words)
    grams = ts.window_hashes(h, size) >> np.uint64(1)
    for r, n in enumerate(words.per_row.tolist()):
        a = int(words.first[r])
        if n >= size:
            yield np.unique(grams[a : a + n - size + 1])
        elif n:
            yield ts.mix(ts.window_hashes(h[a : a + n], n) + np.uint64(n)) >> np.uint64(1)
        else:
            yield np.empty(0, dtype=np.uint64)


def prefix_size(n: int, percent: int) -> int:
    return n + (-percent * n // 100) + 1


def window_size(n: int, percent: int) -> int:
    p = prefix_size(n, percent)
    return min(n, p + p // 3 + 6)


def _matches(n: Column, percent: int) -> tuple[Column, Column]:
    """W(n), and the matches that the window of the smallest partner of a set of n requires."""

    def sizes(k: Column) -> tuple[Column, Column]:
        p = k - F.ceil(F.lit(percent) * k / 100) + 1
        return p, F.least(k, p + F.floor(p / 3) + 6)

    least = F.ceil(F.lit(percent) * n / 100)
    p, w = sizes(least)
    return sizes(n)[1], w - p + 1


def _needed(a: Column, b: Column, percent: int) -> Column:
    return F.ceil(F.lit(percent) * (a + b) / F.lit(100 + percent))


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ts.signed(flat.astype(np.uint64))))


def _set_key(tokens: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed) - (1 << 63)


def first_reading(documents: DataFrame, size: int, percent: int, seed: int = 0) -> DataFrame:
    """doc_id, mark (hash of the text), node (hash of the set, null if empty), check (another hash of it), n, low (the lowest tokens)."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            node, check, n, low = [], [], [], []
            texts = column(batch, "text")
            for a, b in slices(texts):
                for tokens in row_sets(texts.slice(a, b - a), size):
                    k = len(tokens)
                    n.append(k)
                    node.append(_set_key(tokens, seed) if k else None)
                    check.append(_set_key(tokens, ~seed & 0xFFFF) if k else None)
                    low.append(tokens[: window_size(k, percent)])
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "mark"), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(n, pa.int64()), _lists(low)],
                ["doc_id", "mark", "node", "check", "n", "low"],
            )

    asked = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    return batches(asked, step, "doc_id long, mark long, node long, check long, n long, low array<long>")


def chosen_texts(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, text of the row (or rows, where they repeat) that stands for each chosen class: found by doc_id and text, so that a row meets one class at most."""
    ids = chosen.select("rep.doc_id", "rep.mark", "node")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    texts, ids = _to_meet(texts, ids, ["doc_id", "mark"])
    same = (F.col("t.mark") == F.col("i.mark")) & F.col("t.doc_id").eqNullSafe(F.col("i.doc_id"))
    return texts.alias("t").join(ids.alias("i"), same).select("node", "text")


def _to_meet(table: DataFrame, ids: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by the names: ids are broadcast while they are few; else only rows that may be theirs are left to shuffle."""
    if ids.count() <= BROADCAST_IDS:
        return table, F.broadcast(ids)
    return likely(table, ids, names), ids


def _chosen_sets(documents: DataFrame, chosen: DataFrame, size: int, common: np.ndarray, seed: int, made: Callable[[list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """What ``made`` makes of the nodes and ordered sets (common tokens last) of the chosen classes, from the text of one document each (from one in each task, where rows repeat)."""
    last = documents.sparkSession.sparkContext.broadcast(common)
    names = [field.split()[0] for field in schema.split(", ")]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, told = last.value, set()
        for batch in parts:
            texts, wanted = column(batch, "text"), column(batch, "node").to_pylist()
            node, lists = [], []
            for a, b in slices(texts):
                for i, tokens in enumerate(row_sets(texts.slice(a, b - a), size), a):
                    if wanted[i] in told or not len(tokens) or _set_key(tokens, seed) != wanted[i]:
                        continue  # a repeated row, or another text of the same hash
                    told.add(wanted[i])
                    if len(order):
                        at = np.minimum(np.searchsorted(order, tokens), len(order) - 1)
                        tokens = np.sort(np.where(order[at] == tokens, tokens | np.uint64(1 << 63), tokens))
                    node.append(wanted[i])
                    lists.append(tokens)
            sizes = pa.array([len(tokens) for tokens in lists], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), sizes, *made(lists)], names)

    return batches(chosen_texts(documents, chosen), step, schema)


def second_reading(documents: DataFrame, chosen: DataFrame, size: int, percent: int, common: np.ndarray, seed: int = 0) -> DataFrame:
    """node, n, shape (token counts by bucket), heads (the longest prefix) of the chosen classes."""
    longest = LONGEST

    def made(lists: list[np.ndarray]) -> list[pa.Array]:
        shapes = [np.minimum(np.bincount(tokens & np.uint64(SHAPE - 1), minlength=SHAPE), _MOST).astype(np.int16) for tokens in lists]
        return [pa.array(shapes, pa.list_(pa.int16())), _lists([tokens[: prefix_size(len(tokens), percent) + longest] for tokens in lists])]

    return _chosen_sets(documents, chosen, size, common, seed, made, "node long, n long, shape array<smallint>, heads array<long>")


def whole_sets(documents: DataFrame, chosen: DataFrame, size: int, common: np.ndarray, seed: int = 0) -> DataFrame:
    """node, n, tokens (ordered) of the chosen classes."""
    return _chosen_sets(documents, chosen, size, common, seed, lambda lists: [_lists(lists)], "node long, n long, tokens array<long>")


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix."""
    out, new = [], np.ones(len(link), dtype=bool)
    for root in range(len(link)):
        if not new[root]:
            continue
        new[root] = False
        edge = [root]
        while edge:
            at = edge.pop()
            for nxt in np.flatnonzero(link[at] & new).tolist():
                new[nxt] = False
                out.append((at, nxt))
                edge.append(nxt)
    return out


def _product(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each two sets, by matrix products over slabs of tokens."""
    same = rows is cols
    flat = np.concatenate(rows if same else rows + cols)
    names, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    kept = np.cumsum(times > 1) - 1  # a token of one set adds nothing (but to the diagonal, which nobody reads)
    kept[times < 2] = -1
    place = kept[place]
    owner = np.repeat(np.arange(len(rows) + (0 if same else len(cols))), [len(x) for x in (rows if same else rows + cols)])
    owner, place = owner[place >= 0], place[place >= 0]
    by = np.argsort(place, kind="stable")
    owner, place = owner[by], place[by]
    out = np.zeros((len(rows), len(cols)), dtype=np.float32)
    held = int(kept.max(initial=-1)) + 1
    for low in range(0, held, _SLAB):
        a, b = np.searchsorted(place, [low, low + _SLAB])
        m = np.zeros((len(rows) + (0 if same else len(cols)), min(_SLAB, held - low)), dtype=np.float32)
        m[owner[a:b], place[a:b] - low] = 1
        out += m[: len(rows)] @ (m if same else m[len(rows) :]).T
    return out


def _numbers(frame: pd.DataFrame, name: str) -> list[np.ndarray]:
    return [np.asarray(x, dtype=np.int64).view(np.uint64) for x in frame[name]]


def _sides(key: tuple, part: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """Rows and columns of a block, in a fixed order, and whether they are the same."""
    kind, i, j = key[1], key[2], key[3]
    part = part.sort_values("node", kind="stable")
    if kind:
        return part[part["core"]], part[~part["core"]], False
    left = part[part["chunk"] == i]
    return (left, left, True) if i == j else (left, part[part["chunk"] == j], False)


def _open_pairs(left: pd.DataFrame, right: pd.DataFrame, same: bool, percent: int) -> np.ndarray:
    """Pairs that are not connected through their pivot, each once, whose sizes allow a link."""
    n_a, n_b = left["n"].to_numpy()[:, None], right["n"].to_numpy()
    ask = (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)) & (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy())
    return ask & np.tri(len(left), k=-1, dtype=bool) if same else ask


def _narrow(left: pd.DataFrame, right: pd.DataFrame, same: bool, ask: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Only the rows and columns that still have a pair to ask about."""
    at_a, at_b = np.flatnonzero(ask.any(axis=1)), np.flatnonzero(ask.any(axis=0))
    if same:  # one list, so that tokens of a single set are seen to add nothing
        at_a = at_b = np.union1d(at_a, at_b)
    left = left.iloc[at_a]
    return left, left if same else right.iloc[at_b], ask[np.ix_(at_a, at_b)]


def _products(left: pd.DataFrame, right: pd.DataFrame, same: bool, name: str) -> np.ndarray:
    rows = _numbers(left, name)
    return _product(rows, rows if same else _numbers(right, name))


def _open_block(percent: int):
    """Pairs of a block that prefixes and shapes don't rule out; of a block with more than THIN for each row that has one, these rows (v null)."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        pivot = np.uint64(np.int64(key[0]).view(np.uint64))
        left, right, same = _sides(key, part)
        ask = _open_pairs(left, right, same, percent)

        def before(frame: pd.DataFrame) -> list[np.ndarray]:
            return [d[d < pivot] for d in _numbers(frame, "pivots")]

        if ask.any():
            left, right, ask = _narrow(left, right, same, ask)
            rows = before(left)
            ask &= _product(rows, rows if same else before(right)) == 0  # the pair's first common pivot asks
        if ask.any():
            left, right, ask = _narrow(left, right, same, ask)
            shared = _products(left, right, same, "heads")
            n_a, n_b, x_a, x_b = left["n"].to_numpy(), right["n"].to_numpy(), left["x"].to_numpy(), right["x"].to_numpy()
            ask &= shared >= np.minimum(left["need"].to_numpy()[:, None], right["need"].to_numpy())
            edge_a, edge_b = (np.array([h[-1] for h in _numbers(f, "heads")], dtype=np.uint64) for f in (left, right))
            rest = np.where(edge_a[:, None] <= edge_b, (n_a - x_a)[:, None], n_b - x_b)
            least = -(-percent * (n_a[:, None] + n_b) // (100 + percent))
            ask &= shared + rest >= least
            shape_a, shape_b = (np.stack([np.asarray(x, dtype=np.int16) for x in f["shape"]]) for f in (left, right))
            for a in np.flatnonzero(ask.any(axis=1)):
                at = np.flatnonzero(ask[a])
                most = np.minimum(shape_a[a], shape_b[at]).sum(axis=1, dtype=np.int64)
                ask[a, at] = (most >= least[a, at]) | (shape_a[a].max() >= _MOST)
        u, v = np.nonzero(ask)
        id_a, id_b = left["node"].to_numpy(), right["node"].to_numpy()
        names = np.unique(np.concatenate([id_a[u], id_b[v]]))
        if len(u) > THIN * len(names):
            out = {"u": names, "v": pd.array([None] * len(names), dtype="Int64")}
        else:
            out = {"u": id_a[u], "v": pd.array(id_b[v], dtype="Int64")}
        size = len(out["u"])
        return pd.DataFrame(out | {"pivot": np.full(size, key[0], dtype=np.int64)} | {k: np.full(size, key[1 + i], dtype=np.int32) for i, k in enumerate(("kind", "i", "j"))})

    return work


def _thick_block(percent: int):
    """A spanning forest of the links in a block, from whole sets."""

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        left, right, same = _sides(key, part)
        ask = _open_pairs(left, right, same, percent)
        n_a, n_b = left["n"].to_numpy()[:, None], right["n"].to_numpy()
        link = ask & (_products(left, right, same, "tokens") >= -(-percent * (n_a + n_b) // (100 + percent)))
        id_a, id_b = left["node"].to_numpy(), right["node"].to_numpy()
        if same:
            ids, whole = id_a, link | link.T
        else:
            ids, whole = np.concatenate([id_a, id_b]), np.zeros((len(id_a) + len(id_b),) * 2, dtype=bool)
            whole[: len(id_a), len(id_a) :] = link
            whole |= whole.T
        edges = [(ids[a], ids[b]) for a, b in forest(whole)]
        return pd.DataFrame({"u": pd.Series([e[0] for e in edges], dtype="int64"), "v": pd.Series([e[1] for e in edges], dtype="int64")})

    return work


def _among(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the nodes in ids."""
    table, ids = _to_meet(table, ids, ["node"])
    return table.join(ids, "node", "left_semi")


def _plausible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and token counts by bucket allow a link."""
    ids = pairs.select("node").unionByName(pairs.select(F.col("node2").alias("node"))).distinct()
    shapes = _among(sets.select("node", "n", "shape"), ids)
    both = F.aggregate(F.zip_with("a.shape", "b.shape", lambda a, b: F.least(a, b)), F.lit(0), lambda x, y: x + y.cast("int"))
    n, n2 = F.col("a.n"), F.col("b.n")
    fit = (100 * F.least(n, n2) >= percent * F.greatest(n, n2)) & ((both >= _needed(n, n2, percent)) | (F.array_max("a.shape") >= _MOST))
    met = pairs.join(shapes.alias("a"), pairs.node == F.col("a.node")).join(shapes.alias("b"), (pairs.node2 == F.col("b.node")) & fit)
    return met.select(pairs.node, "node2")


def _linked(pairs: DataFrame, whole: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """u, v of the pairs that link, from their whole sets, which are gone afterwards."""
    sets = scratch.table(whole(pairs.select("node").unionByName(pairs.select(F.col("node2").alias("node"))).distinct()), "tokens")
    met = pairs.join(sets.alias("a"), pairs.node == F.col("a.node")).join(sets.alias("b"), pairs.node2 == F.col("b.node"))
    met = met.where(F.size(F.array_intersect("a.tokens", "b.tokens")) >= _needed(F.col("a.n"), F.col("b.n"), percent))
    out = scratch.table(met.select(pairs.node.alias("u"), F.col("node2").alias("v")), "sure")
    scratch.drop(sets)
    return out


def _staying(dense: DataFrame) -> DataFrame:
    """token, node: the holders that stay with their dense tokens. dense: token, node, need.

    A pair that shares no other prefix tokens shares as many dense ones as the smaller of its needs, so one of the two holds as many
    as it needs itself. A token without such a holder is left by all, and by those that hold fewer than the least need of these.
    """
    for _ in range(LEAVE):
        held = dense.join(dense.groupBy("node").agg(F.count("*").alias("held")), "node")
        least = held.where("held >= need").groupBy("token").agg(F.min("need").alias("least"))
        dense = held.join(least, "token").where("held >= least").select("token", "node", "need")
    return dense.select("token", "node")


def _rare_pairs(few: DataFrame, percent: int) -> DataFrame:
    """node, node2 of the pairs that share as many of few's tokens as a link of them would require, at least, if they meet by no dense token.

    few: token, node, n, x, need, edge, held (dense tokens of the node), gone (those that it has left). Pairs that don't meet share no
    more dense tokens than either holds, and each of these was left by one of the two.
    """
    a, b = few.alias("a"), few.alias("b")
    n, n2 = F.col("a.n"), F.col("b.n")
    flip = F.lit(-(1 << 63)).cast("long")
    below = F.col("a.edge").bitwiseXOR(flip) <= F.col("b.edge").bitwiseXOR(flip)  # in unsigned order
    rest = F.when(below, n - F.col("a.x")).otherwise(n2 - F.col("b.x"))
    dense = F.least("a.held", "b.held", F.col("a.gone") + F.col("b.gone"))
    asked = F.greatest(F.least("a.need", "b.need"), _needed(n, n2, percent) - rest) - dense
    once = (F.col("a.token") == F.col("b.token")) & (F.col("a.node") < F.col("b.node")) & (100 * F.least(n, n2) >= percent * F.greatest(n, n2))
    met = a.join(b, once).select(F.col("a.node").alias("node"), F.col("b.node").alias("node2"), asked.cast("int").alias("asked"))
    return met.groupBy("node", "node2", "asked").agg(F.count("*").alias("c")).where("c >= asked").select("node", "node2")


def _blocks(groups: DataFrame, links: DataFrame, sized: DataFrame) -> DataFrame:
    """pivot, kind, i, j, chunk, core, comp, node: the blocks in which the members of each group meet.

    Members linked with the pivot (the core) are connected already, so they meet only the rest, and the rest meets all.
    """
    ends = F.array(F.struct(F.col("u").alias("pivot"), F.col("v").alias("node")), F.struct(F.col("v").alias("pivot"), F.col("u").alias("node")))
    hubs = links.select(F.inline(ends)).distinct().withColumn("linked", F.lit(True))
    tagged = groups.join(hubs, ["pivot", "node"], "left").withColumn("core", (F.col("pivot") == F.col("node")) | F.col("linked").isNotNull()).drop("linked")
    tagged = tagged.withColumn("comp", F.when(F.col("core"), F.col("pivot")).otherwise(F.col("node"))).join(small(sized.select("node", "n"), BROADCAST_SIZED), "node")

    def chunks(of: Column) -> Column:
        n = F.when(of, F.col("n"))
        return F.greatest(F.lit(1), F.ceil(F.count(n) / CHUNK), F.ceil(8 * F.sum(n) / BLOCK_BYTES)).cast("int")

    core = F.col("core")
    dealt = tagged.groupBy("pivot").agg(chunks(core).alias("cores"), chunks(~core).alias("rests"), F.count(F.when(~core, 1)).alias("open")).where("open > 0")

    def block(kind: int, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    chunk = F.col("chunk")
    of_core = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: block(1, chunk, r))
    of_rest = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("cores") - 1), lambda c: block(1, c, chunk)),
        F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda r: block(0, F.least(chunk, r), F.greatest(chunk, r))),
    )
    return (
        tagged.join(small(dealt, BROADCAST_SIZED), "pivot")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.when(core, F.col("cores")).otherwise(F.col("rests"))).cast("int"))
        .withColumn("block", F.explode(F.when(core, of_core).otherwise(of_rest)))
        .select("pivot", "block.*", "chunk", "core", "comp", "node")
    )


def linked_components(sets: DataFrame, whole: Callable[[DataFrame], DataFrame], percent: int, scratch: Scratch) -> DataFrame:
    """node, component of each class that has a link. sets: node, n, shape, heads; whole gives node, n, tokens of the nodes in a table."""
    n = F.col("n")
    head = (n - F.ceil(F.lit(percent) * n / 100) + 1).cast("int")
    spots = sets.select("node", head.alias("head"), F.posexplode("heads").alias("pos", "token"))
    held = spots.groupBy("token").agg(F.count("*").alias("holders")).where("holders > 1")
    spots = scratch.table(spots.join(held, "token"), "spots")
    cost = spots.where("pos < head").groupBy("node").agg(F.sum(F.col("holders") - 1).alias("cost"))
    extra = F.least(F.lit(LONGEST), F.floor(F.log2(F.coalesce("cost", F.lit(0)) + 1))).cast("int")
    sized = (
        sets.select("node", "n", head.alias("head"), "heads")
        .join(cost, "node")  # a class whose prefix nobody shares has no partner
        .withColumn("x", F.least(n.cast("int"), F.col("head") + extra))
        # a set with no more tokens to add asks for as many as it could add
        .select("node", "n", "x", (F.col("x") - F.col("head") + 1).alias("need"), F.element_at("heads", F.col("x")).alias("edge"))
    )
    sized = scratch.table(sized, "sized")
    held = spots
    spots = spots.join(small(sized, BROADCAST_SIZED), "node").where("pos < x")
    dense = scratch.table(spots.where(f"holders >= {DENSE}").select("token", "node", "need"), "dense")
    stay = scratch.table(_staying(dense), "stay")
    groups = scratch.table(_pivot_groups(stay), "groups")
    had = dense.groupBy("node").agg(F.count("*").alias("held")).join(stay.groupBy("node").agg(F.count("*").alias("stays")), "node", "left")
    had = scratch.table(had.select("node", "held", (F.col("held") - F.coalesce("stays", F.lit(0))).alias("gone")), "had")
    star = groups.where("pivot <> node").select(F.least("pivot", "node").alias("node"), F.greatest("pivot", "node").alias("node2")).distinct()
    few = spots.where(f"holders < {DENSE}").select("token", "node", "n", "x", "need", "edge").join(small(had, BROADCAST_SIZED), "node", "left").fillna(0, ["held", "gone"])
    asked = scratch.table(_rare_pairs(few, percent).unionByName(star).distinct(), "asked")
    scratch.drop(held, dense, stay, had)
    pairs = scratch.table(_plausible(asked, sets, percent), "pairs")
    links = _linked(pairs, whole, percent, scratch)
    scratch.drop(asked, pairs)

    blocks = scratch.table(_blocks(groups, links, sized), "blocks")
    if blocks.isEmpty():
        return scratch.table(components(links, scratch), "found")
    pivots = groups.groupBy("node").agg(F.sort_array(F.collect_list("pivot")).alias("pivots"))  # no more than a prefix has tokens
    heads = sets.select("node", "shape", "heads").join(sized.drop("edge"), "node").withColumn("heads", F.slice("heads", F.lit(1), F.col("x")))
    left = blocks.join(_among(heads, blocks.select("node").distinct()), "node").join(pivots, "node")
    left = scratch.table(left.groupBy("pivot", "kind", "i", "j").applyInPandas(_open_block(percent), "u long, v long, pivot long, kind int, i int, j int"), "left")
    thin = scratch.table(left.where("v is not null").select(F.least("u", "v").alias("node"), F.greatest("u", "v").alias("node2")).distinct(), "asked")
    more = _linked(thin, whole, percent, scratch)
    thick = left.where("v is null").select(F.col("u").alias("node"), "pivot", "kind", "i", "j")
    if not thick.isEmpty():
        met = blocks.join(thick, ["node", "pivot", "kind", "i", "j"], "left_semi").join(whole(thick.select("node").distinct()), "node")
        more = more.unionByName(met.groupBy("pivot", "kind", "i", "j").applyInPandas(_thick_block(percent), "u long, v long"))
    out = scratch.table(components(links.unionByName(more), scratch), "found")
    scratch.drop(sized, groups, blocks, left, thin, links)
    return out


def _pivot_groups(many: DataFrame) -> DataFrame:
    """pivot, node: the holders of dense tokens by the tokens' pivots. A token's pivot is the holder with the most dense tokens, so that
    near copies, which share most of theirs, have few pivots; two classes with a dense token in common have a pivot in common."""
    weight = many.groupBy("node").agg(F.count("*").alias("weight"))
    pivots = many.join(weight, "node").groupBy("token").agg(F.max(F.struct("weight", "node")).alias("best"))
    return many.join(pivots.select("token", F.col("best.node").alias("pivot")), "token").select("pivot", "node").distinct()


def _given(read: DataFrame) -> DataFrame:
    """token, a and b (least and greatest class that gave it), given (rows that gave it)."""
    given = read.where("node is not null").select("node", F.explode("low").alias("token"))
    return given.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("given"))


def _groups(documents: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, n, node of each row; node, component of each class; component, rep (its row of the least doc_id, then mark; null ids last)."""
    scratch = Scratch(documents.sparkSession)
    rep = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    for seed in range(64):
        read = scratch.table(first_reading(documents, size, percent, seed), "first")
        classes = read.where("node is not null").groupBy("node").agg(F.min(rep).alias("rep"), F.first("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
        classes = scratch.table(classes, "classes")
        if classes.where("low <> high").isEmpty():
            break
        scratch.drop(read, classes)  # two sets have one hash: other hashes
    rows = read.count()
    given = _given(read)
    alone, often = F.col("a") == F.col("b"), F.col("given") >= max(COMMON_LEAST, rows // COMMON)
    told = scratch.table(
        given.where(alone | often)
        .select(F.when(alone, 0).otherwise(1).alias("kind"), F.when(alone, F.col("a")).otherwise(F.col("token")).alias("name"))
        .groupBy("kind", "name")
        .agg(F.count("*").alias("alone")),
        "told",
    )
    common = np.sort(told.where("kind = 1").select("name").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))
    given_size, least = _matches(F.col("n"), percent)
    first_alone = told.where("kind = 0").select(F.col("name").alias("node"), "alone")
    stayed = classes.join(first_alone, "node", "left").where(given_size - F.coalesce("alone", F.lit(0)) >= least).select("node", "n", "rep")
    stayed = scratch.table(stayed, "stayed")
    scratch.drop(told)
    again = _given(_among(read, stayed.select("node"))).where(alone).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("alone"))
    chosen = stayed.join(again, "node", "left").where(given_size - F.coalesce("alone", F.lit(0)) >= least).select("node", "rep")
    chosen = scratch.table(chosen, "chosen")
    slim = scratch.table(read.select("doc_id", "n", "node"), "rows")
    scratch.drop(read, stayed)
    sets = scratch.table(second_reading(documents, chosen, size, percent, common, seed), "sets")
    repeats = sets.count() > sets.select("node").distinct().count()
    if repeats:
        sets = scratch.table(sets.dropDuplicates(["node"]), "sets")

    def whole(ids: DataFrame) -> DataFrame:
        asked = scratch.table(chosen.join(small(ids, BROADCAST_IDS), "node", "left_semi"), "verified")
        out = whole_sets(documents, asked, size, common, seed)
        return out.dropDuplicates(["node"]) if repeats else out

    found = linked_components(sets, whole, percent, scratch)
    scratch.drop(sets, chosen)
    groups = classes.select("node", "rep").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return slim, groups.select("node", "component"), groups.groupBy("component").agg(F.min("rep").alias("rep"))


def jaccard_keepers(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, mark (xxhash64 of the text) of the one row that stands for each component; rows without a set are in none."""
    return _groups(documents, size, percent)[2].select("rep.doc_id", "rep.mark")


def near_duplicate_survivors(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` that stay, all columns as they are: one of each component (see ``jaccard_keepers``), and every row without words.

    A row is known by doc_id and text hash. Keys that are no component's go, by an anti-join with these keys alone; texts stay where they
    are while there are at most BROADCAST_GONE of them. Of rows that share a kept key the least stays (any one, where columns have no order);
    only such rows are shuffled.
    """
    scratch = Scratch(documents.sparkSession)
    none, id_, mark, row, rows = fresh(documents.columns, "no_id", "known_id", "mark", "row", "rows")
    known = F.col("doc_id").cast("long")

    def key(text_mark: Column) -> dict[str, Column]:
        return {none: known.isNull(), id_: F.coalesce(known, F.lit(0)), mark: text_mark}

    names = [none, id_, mark]
    words = F.coalesce(F.col("text").rlike(_WORD), F.lit(False))
    judged = documents.where(words).withColumns(key(F.xxhash64("text")))
    kept = jaccard_keepers(documents, size, percent).select(*[c.alias(k) for k, c in key(F.col("mark")).items()]).withColumn(row, F.lit(True))
    keys = judged.groupBy(*names).agg(F.count("*").alias(rows)).join(kept, names, "left")
    odd = scratch.table(keys.where(F.col(row).isNull() | (F.col(rows) > 1)), "odd")
    single = judged.join(small(odd.select(*names), BROADCAST_GONE), names, "left_anti").select(*own(documents))
    many = judged.join(small(odd.where(row).select(*names), BROADCAST_GONE), names, "left_semi")
    orderable = "map<" not in documents.schema.simpleString()  # maps and variants have no order
    whole = F.struct(*own(documents))
    first = many.groupBy(*names).agg(F.min(whole).alias(row)) if orderable else many.dropDuplicates(names).select(whole.alias(row))
    return single.unionByName(first.select(f"{row}.*")).unionByName(documents.where(~words))


def jaccard_components(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row; texts link when 100 * shared >= percent * union of their shingles."""
    slim, groups, names = _groups(documents, size, percent)
    named = groups.join(names, "component").select("node", F.col("rep.doc_id").alias("component_id"))
    return slim.join(named, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 90)
