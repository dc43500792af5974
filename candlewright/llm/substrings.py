"""Substring dedup by super-k-mers.

A window is SIZE consecutive words; its minimiser is the least of its GRAM-word hashes. Consecutive windows of
a text that share their minimiser travel as one packed string to the minimiser's bucket. Minimisers alone are
counted first: strings whose minimiser is found nowhere else hold no repeated window and stay at home. A bitmap of
the repeated minimisers (BITS_PER_KEY bits each, MOST_BITS in all) tells the strings apart; a full one lets strings
travel that need not, and loses none. A bucket's rows are sorted by minimiser, document and place; equal windows have equal minimisers, so the first of a window in that
order is its first in the corpus and every other one is marked. Window hashes only find candidates: the words
are compared. Marked word ranges go back to their documents, which drop the words and digest the rest.

Hot passages: grams found in a good part of a bounded sample of documents (SAMPLE) order last, so a window uses
them only if it has no other and the windows around a shared passage scatter; the sample steers order alone,
never results. Strings that repeat within a batch are settled there and travel once. A minimiser of more than HOT_RUNS
strings (and one in HOT_PART of all) sends its windows one by one, to buckets by the window's own hash, so that no bucket
gets them all. One bucket key's rows are read as a stream; beyond GROUP_BYTES only their distinct windows are held.

Documents without a marked word are digested where they are read; only those with some meet their marks by key, while
the keys of these are few enough to be broadcast (BROADCAST_KEYS).

Defined results: null or empty texts have no words; a null doc_id orders last; rows that share a doc_id are one
document for what counts as earlier, but each is judged by its own text; other columns are left out; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm import textscan as ts
from candlewright.llm.runtime import Scratch, batches, bitmap, column, has, slices

SIZE, GRAM = 20, 6
#: Bits of the bitmap for each repeated minimiser, and at most (64 MB).
BITS_PER_KEY, MOST_BITS = 16, 1 << 29
#: Documents sampled for the order of grams, and the share of them that makes a gram hot.
SAMPLE, HOT_SHARE = 2000, 0.005
#: Packed bytes worked on at once in a bucket, and those of one minimiser after which windows are held one by one.
CHUNK_BYTES, GROUP_BYTES = 2 << 20, 24 << 20
HOT_RUNS, HOT_PART = 20_000, 100_000
#: Documents with marks up to which their keys are broadcast (16 bytes each).
BROADCAST_KEYS = 200_000
LAST_ID = (1 << 63) - 1

_PACKED = "key long, id long, tag long, place long, packed binary"
_MARK = "id long, tag long, span long"


def _keyed(documents: DataFrame) -> DataFrame:
    """id (null last) and tag (a hash of the text and of whether the id is null) name a row's document and text."""
    id_ = F.col("doc_id").cast("long")
    return documents.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(LAST_ID)).alias("id"), F.xxhash64("text", id_.isNull()).alias("tag"), "text")


def hot_grams(documents: DataFrame, gram: int, sample: int = SAMPLE, share: float = HOT_SHARE) -> np.ndarray:
    """Hashes of grams in at least that share of a sample of documents; sorted, at most (grams of the sample) / (share * sample)."""
    rows = documents.count()
    keep = max(1, rows // sample)
    some = documents.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(keep)) == 0).limit(2 * sample).select("text")

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts = column(batch, "text")
            for a, b in slices(texts):
                words = ts.split(texts.slice(a, b - a))
                g = ts.window_hashes(ts.word_hashes(words), gram)
                ok = ts.whole(words, gram)
                row, g = words.row[: len(g)][ok], g[ok]
                order = np.lexsort((g, row))
                row, g = row[order], g[order]
                new = np.ones(len(g), dtype=bool)
                new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(ts.signed(g[new]))], ["gram"])

    least = max(4, round(share * min(rows, sample)))
    found = batches(some, step, "gram long").groupBy("gram").count().where(F.col("count") >= least).select("gram").collect()
    return np.sort(np.array([r.gram for r in found], dtype=np.int64).view(np.uint64))


def super_kmers(words: ts.Words, size: int, gram: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, row, first window and end window of each run of windows of a text that share their minimiser, and: may it hold a window twice?"""
    g = ts.window_hashes(ts.word_hashes(words), gram)
    value = g >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        value[hot[at] == g] |= np.uint64(1 << 63)
    least = ts.sliding_min(value, size - gram + 1)
    ok, row = ts.whole(words, size), words.row[: len(least)]
    cut = np.ones(len(least), dtype=bool)
    cut[1:] = (least[1:] != least[:-1]) | (row[1:] != row[:-1]) | (ok[1:] != ok[:-1])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(least))
    begin, end = begin[ok[begin]], end[ok[begin]]
    near = np.zeros(len(value) + 1, dtype=np.int32)  # of a gram: is it found again within a window's length?
    for d in range(1, min(size, len(value))):
        near[1:-d] |= value[:-d] == value[d:]
    near = np.cumsum(near)
    width = size - gram + 1
    twice = (end - begin > width) | ((end - begin > 1) & (near[np.minimum(end + width - 1, len(value))] > near[begin]))
    return least[begin], row[begin], begin, end, twice


def repeated_keys(keyed: DataFrame, size: int, gram: int, hot) -> DataFrame:
    """key, n of the minimisers of more than one run, or of a run long enough to hold one window twice (which counts as two)."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            texts, found = column(batch, "text"), []
            for a, b in slices(texts):
                words = ts.split(texts.slice(a, b - a))
                if len(words) >= size:
                    key, _, _, _, twice = super_kmers(words, size, gram, hot.value)
                    found += [key, key[twice]]
            if found:
                key, times = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ts.signed(key)), pa.array(times.astype(np.int64))], ["key", "n"])

    return batches(keyed.select("text"), step, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _window_by_window(keys: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray, split: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs, with those of a hot key cut into single windows whose key is made of the old one and the window's hash."""
    at = np.minimum(np.searchsorted(split, keys), len(split) - 1)
    is_hot = split[at] == keys
    if not is_hot.any():
        return keys, row, begin, end
    n = (end - begin)[is_hot]
    window = np.repeat(begin[is_hot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    new = ts.mix(np.repeat(keys[is_hot], n) ^ hashes[window])
    rest = ~is_hot
    return np.concatenate([keys[rest], new]), np.concatenate([row[rest], np.repeat(row[is_hot], n)]), np.concatenate([begin[rest], window]), np.concatenate([end[rest], window + 1])


def pack_windows(keyed: DataFrame, size: int, gram: int, hot, passed, bits: int, split) -> DataFrame:
    """Super-k-mers whose key passes (packed set) and the ranges that are settled within a batch (packed null, key = the range). split: hot keys, sorted."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ids, tags, texts = column(batch, "id").to_numpy(), column(batch, "tag").to_numpy(), column(batch, "text")
            first: dict[bytes, tuple[int, int, int, int]] = {}
            settled: list[tuple[int, int, int]] = []
            apart: list[tuple[bytes, tuple[int, int, int, int]]] = []
            for a, b in slices(texts):
                words = ts.split(texts.slice(a, b - a))
                if len(words) < size:
                    continue
                keys, row, begin, end, _ = super_kmers(words, size, gram, hot.value)
                go = has(passed.value, keys, bits)
                keys, row, begin, end = keys[go], row[go], begin[go], end[go]
                if not len(keys):
                    continue
                if len(split.value):
                    keys, row, begin, end = _window_by_window(keys, row, begin, end, split.value, ts.window_hashes(ts.word_hashes(words), size))
                where = begin - words.first[row]
                for key, low, high, i, t, p, n in zip(
                    ts.signed(keys).tolist(), words.start[begin].tolist(), words.end[end + size - 2].tolist(),
                    ids[a + row].tolist(), tags[a + row].tolist(), where.tolist(), (end - begin).tolist(), strict=True,
                ):
                    text = words.data[low:high]
                    new = (i, p, t, key)
                    old = first.setdefault(text, new)
                    if old is new or old[:3] == new[:3]:
                        continue
                    if old[:2] == new[:2]:
                        apart.append((text, new))  # another text under this doc_id
                        continue
                    if new < old:
                        first[text], old, new = new, new, old
                    # new is the later one: all its windows are known to repeat
                    settled.append((new[0], new[2], new[1] << 32 | new[1] + n + size - 1))
            packed = [*first, *(x for x, _ in apart)]
            kept = [*first.values(), *(x for _, x in apart)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([v[3] for v in kept] + [s[2] for s in settled], pa.int64()),
                    pa.array([v[0] for v in kept] + [s[0] for s in settled], pa.int64()),
                    pa.array([v[2] for v in kept] + [s[1] for s in settled], pa.int64()),
                    pa.array([v[1] for v in kept] + [0] * len(settled), pa.int64()),
                    pa.array(packed + [None] * len(settled), pa.binary()),
                ],
                ["key", "id", "tag", "place", "packed"],
            )

    return batches(keyed.select("id", "tag", "text"), step, _PACKED)


def _runs(row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last indices of stretches with one row and consecutive ``at``."""
    cut = np.ones(len(row), dtype=bool)
    cut[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(cut)
    return begin, np.append(begin[1:], len(row)) - 1


def repeats(packed: pa.Array, ids: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows in order of minimiser, document and place: row, first and last window of each stretch that starts earlier elsewhere."""
    words = ts.split(packed)
    h = ts.window_hashes(ts.word_hashes(words), size)
    ok = ts.whole(words, size)
    at = np.flatnonzero(ok)
    h, row = h[ok], words.row[: len(ok)][ok]
    inner = at - words.first[row]
    order = np.argsort(h, kind="stable")
    sorted_h = h[order]
    head = np.ones(len(h), dtype=bool)
    head[1:] = sorted_h[1:] != sorted_h[:-1]
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
    source = np.empty(len(h), dtype=np.int64)
    source[order] = lead
    place = places[row] + inner
    again = (source != np.arange(len(h))) & ((ids[row] != ids[row[source]]) | (place != place[source]))
    dup = np.flatnonzero(again)
    if not len(dup):
        return dup, dup, dup
    cut = np.ones(len(dup), dtype=bool)
    src = source[dup]
    cut[1:] = (dup[1:] != dup[:-1] + 1) | (row[dup[1:]] != row[dup[:-1]]) | (src[1:] != src[:-1] + 1) | (row[src[1:]] != row[src[:-1]])
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(dup)) - 1
    good = np.ones(len(dup), dtype=bool)
    data = words.data

    def text(window: int, last: int) -> bytes:
        return data[words.start[at[window]] : words.end[at[last] + size - 1]]

    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        x, y = text(dup[a], dup[b]), text(src[a], src[b])
        if x != y and x.split() != y.split():
            for i in range(a, b + 1):  # two window texts with one hash: look for the same words among all of that hash
                mine = text(dup[i], dup[i]).split()
                same = [j for j in np.flatnonzero(h == h[dup[i]]).tolist() if text(j, j).split() == mine]
                good[i] = (ids[row[same[0]]], place[same[0]]) != (ids[row[dup[i]]], place[dup[i]])
    dup = dup[good]
    begin, end = _runs(row[dup], inner[dup])
    return row[dup][begin], inner[dup][begin], inner[dup][end]


def _marks(rows: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, places: np.ndarray, tags: np.ndarray, size: int) -> pa.RecordBatch:
    start = places[rows] + low
    span = start << 32 | places[rows] + high + size
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(tags[rows]), pa.array(span)], ["id", "tag", "span"])


def mark_repeats_step(size: int):
    """A step from sorted super-k-mers to word ranges (start << 32 | end) of windows that start earlier elsewhere."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        seen: dict[bytes, tuple[int, int]] = {}  # first places of windows, by their words
        seen_key = None

        def settle(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            ids, tags, places = (column(table, c).to_numpy() for c in ("id", "tag", "place"))
            yield _marks(*repeats(column(table, "packed"), ids, places, size), ids, places, tags, size)

        def stream(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """One very frequent minimiser: windows one by one, against those seen."""
            out: list[tuple[int, int, int]] = []
            for i, tag, at, text in zip(*(column(table, c).to_pylist() for c in ("id", "tag", "place", "packed")), strict=True):
                ws = text.split()
                for j in range(len(ws) - size + 1):
                    here = (i, at + j)
                    if seen.setdefault(b" ".join(ws[j : j + size]), here) != here:
                        out.append((i, tag, (at + j) << 32 | at + j + size))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "tag", "span"])

        def joined() -> pa.RecordBatch:
            return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

        size_held = 0
        for batch in parts:
            if not batch.num_rows:
                continue
            held.append(batch)
            size_held += batch.nbytes
            if size_held < CHUNK_BYTES:
                continue
            table = joined()
            keys = column(table, "key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # rows of the last key may go on
            if seen_key is not None:
                mine = int(np.searchsorted(keys, seen_key, side="right"))
                if mine:
                    yield from stream(table.slice(0, mine))
                if mine < table.num_rows:
                    seen.clear()
                    seen_key = None
                table, cut, keys = table.slice(mine), max(0, cut - mine), keys[mine:]
            if cut:
                yield from settle(table.slice(0, cut))
                table = table.slice(cut)
            if table.nbytes > GROUP_BYTES:
                seen_key = int(keys[-1])
                yield from stream(table)
                table = table.slice(0, 0)
            held = [table] if table.num_rows else []
            size_held = table.nbytes
        if held:
            table = joined()
            if seen_key is not None:
                keys = column(table, "key").to_numpy()
                mine = int(np.searchsorted(keys, seen_key, side="right"))
                yield from stream(table.slice(0, mine))
                table = table.slice(mine)
            if table.num_rows:
                yield from settle(table)

    return step


def dedup_substrings(documents: DataFrame, size: int = SIZE, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row; with ``texts`` also kept (the kept words joined by one space)."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    hot = spark.sparkContext.broadcast(hot_grams(documents, gram))
    keyed = _keyed(documents)
    repeated = scratch.table(repeated_keys(keyed, size, gram, hot), "repeated")
    held = repeated.agg(F.count("*"), F.sum("n")).first()
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(20, (BITS_PER_KEY * held[0]).bit_length()))
    passed = spark.sparkContext.broadcast(bitmap(repeated, "key", bits))
    # there are fewer of these than HOT_PART
    crowded = repeated.where(F.col("n") > max(HOT_RUNS, (held[1] or 0) // HOT_PART)).select("key").toArrow().column(0).to_numpy()
    split = spark.sparkContext.broadcast(np.sort(crowded.astype(np.int64).view(np.uint64)))
    packed = pack_windows(keyed, size, gram, hot, passed, bits, split)
    # both kinds of row in one pass: settled ranges need no order, they are dealt by document
    dealt = packed.repartition(F.when(F.col("packed").isNull(), F.xxhash64("id", "tag")).otherwise(F.col("key")))
    both = _both(dealt.sortWithinPartitions(F.col("packed").isNull(), "key", "id", "place"), size)
    marks = scratch.table(both.groupBy("id", "tag").agg(F.collect_list("span").alias("spans")), "marks")  # no more than a text has windows
    scratch.drop(repeated)
    if marks.count() <= BROADCAST_KEYS:
        keys = F.broadcast(marks.select("id", "tag"))
        unmarked = keyed.join(keys, ["id", "tag"], "left_anti").select("doc_id", "text", F.lit(None).cast("array<long>").alias("spans"))
        marked = keyed.join(keys, ["id", "tag"], "left_semi").join(marks, ["id", "tag"]).select("doc_id", "text", "spans")
        joined = unmarked.unionByName(marked)
    else:
        joined = keyed.join(marks, ["id", "tag"], "left").select("doc_id", "text", "spans")

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, spans in zip(column(batch, "text"), column(batch, "spans").to_pylist(), strict=True):
                words = (text.as_py() or "").encode().split()
                total, removed = len(words), 0
                if spans:
                    kept, at = [], 0
                    for s in sorted(spans):
                        low, high = s >> 32, s & 0xFFFFFFFF
                        if low > at:
                            kept += words[at:low]
                        at = max(at, high)
                    words = kept + words[at:]
                    removed = total - len(words)
                rest = b" ".join(words)
                n_words.append(total)
                n_removed.append(removed)
                digests.append(hashlib.sha256(rest).hexdigest())
                if texts:
                    kept_texts.append(rest.decode())
            out = [column(batch, "doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept_texts, pa.string())] * texts, names + ["kept"] * texts)

    return batches(joined, step, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


def _both(rows: DataFrame, size: int) -> DataFrame:
    """Marks of a bucket: its super-k-mers come first, then the ranges settled in batches, which pass through."""
    inner = mark_repeats_step(size)

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled: list[pa.RecordBatch] = []

        def strings() -> Iterator[pa.RecordBatch]:
            for batch in parts:
                packed = column(batch, "packed")
                n = batch.num_rows - packed.null_count
                if n:
                    yield batch.slice(0, n)
                if n < batch.num_rows:
                    settled.append(batch.slice(n))
                    return

        def ranges() -> Iterator[pa.RecordBatch]:
            yield from settled
            yield from parts

        yield from inner(strings())
        for batch in ranges():
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in ("id", "tag", "key")], ["id", "tag", "span"])

    return batches(rows, step, _MARK)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
