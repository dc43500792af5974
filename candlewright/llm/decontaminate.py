"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of a benchmark item (an item of fewer words is one window). The fingerprints
of a text are the least of each SPAN - GRAM + 1 consecutive GRAM-word hashes, so two texts that share SPAN words
in a row share a fingerprint. Documents keep the fingerprints that a bitmap of the benchmark's lets through (of
fixed size; it may pass strangers, never lose one), join the benchmark's fingerprints, and each matched document
and item is extended: every window of the item is looked for in the whole document and compared word by word.
Items shorter than SPAN are matched by the hash of the whole item at every place.

Documents without a match are read once and shuffled nowhere: their keys are told apart from those that match, of which
alone the texts are read again. A matched document carries item numbers, to be looked up in a benchmark of ITEM_BYTES
at most; a larger one sends texts, ITEMS to a row, and the rows' findings are put together by document.

Defined results: null texts have no words; a null item id is listed as ``null``; rows that share a doc_id are
judged each by its own text; an item id that repeats is one item with the windows of all its rows; other columns
are left out; empty tables give an empty result or clean documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.llm import textscan as ts
from candlewright.llm.runtime import Scratch, batches, bitmap, column, fresh, has, slices, small

SPAN, GRAM = 10, 5
#: Bits of the bitmap (2 MB).
BITMAP_BITS = 1 << 24
#: Rows of the benchmark's fingerprint table up to which it is broadcast (24 bytes each), and matched documents (16 bytes, their findings 150).
BROADCAST_PRINTS, BROADCAST_KEYS = 1_000_000, 200_000
#: Bytes of item texts up to which they are broadcast whole; items to a row beyond.
ITEM_BYTES, ITEMS = 32_000_000, 64
LAST_ID = (1 << 63) - 1


def _row_spans(words: ts.Words) -> Iterator[tuple[int, int]]:
    yield from zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)


def winnow(grams: np.ndarray, span: int, gram: int) -> np.ndarray:
    return np.unique(ts.sliding_min(grams, span - gram + 1))


def item_prints(benchmark: DataFrame, span: int, gram: int) -> DataFrame:
    """item (hash of id and text), size (words of an item shorter than span, else 0), print."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            words = ts.split(column(batch, "text"), ts.ALNUM, lower=True)
            h = ts.word_hashes(words)
            items, sizes, prints = [], [], []
            for (a, b), item in zip(_row_spans(words), column(batch, "item").to_pylist(), strict=True):
                n = b - a
                if not n:
                    continue
                found = winnow(ts.window_hashes(h[a:b], gram), span, gram) if n >= span else ts.window_hashes(h[a:b], n)
                items += [item] * len(found)
                sizes += [0 if n >= span else n] * len(found)
                prints.append(found)
            flat = np.concatenate(prints) if prints else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(sizes, pa.int32()), pa.array(ts.signed(flat))], ["item", "size", "print"])

    return batches(benchmark.select("item", "text"), step, "item long, size int, print long").distinct()


def _key() -> dict[str, Column]:
    """What tells a row's document and text: id (null last), and a hash of the text that also tells a null id from the greatest."""
    id_ = F.col("doc_id").cast("long")
    return {"id": F.coalesce(id_, F.lit(LAST_ID)), "tag": F.xxhash64("text", id_.isNull())}


def document_prints(documents: DataFrame, passed, sizes: list[int], span: int, gram: int) -> DataFrame:
    """doc_id, id, tag, n_words of each row, and size and print of its fingerprints that the bitmap passes, as lists."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = passed.value
        for batch in parts:
            texts = column(batch, "text")
            n_words, sizes_of, prints_of, ends = [], [], [], [np.zeros(1, dtype=np.int64)]
            for a, b in slices(texts):
                words = ts.split(texts.slice(a, b - a), ts.ALNUM, lower=True)
                n_words.append(words.per_row)
                h = ts.word_hashes(words)
                rows, kinds, prints = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.uint64)]
                if len(words) >= span:
                    least = ts.sliding_min(ts.window_hashes(h, gram), span - gram + 1)
                    ok = ts.whole(words, span) & has(bits, least, BITMAP_BITS)
                    ok[1:] &= (least[1:] != least[:-1]) | (words.row[1 : len(least)] != words.row[: len(least) - 1]) | ~ok[:-1]
                    rows.append(words.row[: len(least)][ok])
                    kinds.append(np.zeros(int(ok.sum()), dtype=np.int32))
                    prints.append(least[ok])
                for n in sizes:
                    if len(words) >= n:
                        g = ts.window_hashes(h, n)
                        ok = ts.whole(words, n) & has(bits, g, BITMAP_BITS)
                        rows.append(words.row[: len(g)][ok])
                        kinds.append(np.full(int(ok.sum()), n, dtype=np.int32))
                        prints.append(g[ok])
                row = np.concatenate(rows)
                by = np.argsort(row, kind="stable")
                sizes_of.append(np.concatenate(kinds)[by])
                prints_of.append(np.concatenate(prints)[by])
                ends.append(ends[-1][-1] + np.cumsum(np.bincount(row, minlength=b - a)))
            offsets = pa.array(np.concatenate(ends).astype(np.int32))
            flat = [np.concatenate(x) if x else np.empty(0, dtype=t) for x, t in ((n_words, np.int64), (sizes_of, np.int32), (prints_of, np.uint64))]
            yield pa.RecordBatch.from_arrays(
                [
                    *(column(batch, c) for c in ("doc_id", "id", "tag")), pa.array(flat[0]),
                    pa.ListArray.from_arrays(offsets, pa.array(flat[1])), pa.ListArray.from_arrays(offsets, pa.array(ts.signed(flat[2]))),
                ],
                ["doc_id", "id", "tag", "n_words", "sizes", "prints"],
            )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(k) for k, c in _key().items()], "text")
    return batches(rows, step, "doc_id long, id long, tag long, n_words long, sizes array<int>, prints array<long>")


def hit_words(words: list[bytes], hashes: np.ndarray, item_words: list[bytes], item_hashes: np.ndarray, span: int) -> np.ndarray:
    """First words of the places in a document where a window of the item stands."""
    n = min(span, len(item_words))
    if not n or len(words) < n:
        return np.empty(0, dtype=np.int64)
    here, there = ts.window_hashes(hashes, n), ts.window_hashes(item_hashes, n)
    at = np.flatnonzero(np.isin(here, there))
    windows = {tuple(item_words[j : j + n]) for j in range(len(item_words) - n + 1)} if len(at) else set()
    return np.array([i for i in at.tolist() if tuple(words[i : i + n]) in windows], dtype=np.int64)


def _item(name: str, text: str) -> tuple[str, list[bytes], np.ndarray]:
    words = ts.split(pa.array([text], pa.string()), ts.ALNUM, lower=True)
    return name, [words.data[s:e] for s, e in zip(words.start.tolist(), words.end.tolist(), strict=True)], ts.word_hashes(words)


def extended(rows: DataFrame, shared, span: int) -> DataFrame:
    """id, tag, names and spans (start << 32 | end of stretches of hit words) of each row that holds a window of one of its items.

    rows: id, tag, text, items (numbers into shared, or structs of name and text where shared is null).
    """

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in parts:
            texts, wanted, out = column(batch, "text"), column(batch, "items").to_pylist(), []
            ids, tags = column(batch, "id").to_pylist(), column(batch, "tag").to_pylist()
            for a, b in slices(texts):
                words = ts.split(texts.slice(a, b - a), ts.ALNUM, lower=True)
                h = ts.word_hashes(words)
                for r, (low, high) in enumerate(_row_spans(words), a):
                    mine = [words.data[s:e] for s, e in zip(words.start[low:high].tolist(), words.end[low:high].tolist(), strict=True)]
                    mark, names = np.zeros(high - low + 1, dtype=np.int64), set()
                    for item in wanted[r]:
                        if shared is None:
                            name, item_words, item_hashes = _item(item["name"], item["text"])
                        else:
                            if item not in known:
                                known[item] = _item(*shared.value[item])
                            name, item_words, item_hashes = known[item]
                        at = hit_words(mine, h[low:high], item_words, item_hashes, span)
                        if len(at):
                            names.add(name)
                            np.add.at(mark, at, 1)
                            np.add.at(mark, at + min(span, len(item_words)), -1)
                    if names:
                        edge = np.diff(np.concatenate([[0], np.cumsum(mark[:-1]) > 0, [0]]).astype(np.int8))
                        out.append((ids[r], tags[r], sorted(names), (np.flatnonzero(edge == 1) << 32 | np.flatnonzero(edge == -1)).tolist()))
            columns = list(zip(*out, strict=True)) or [()] * 4
            types = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["id", "tag", "names", "spans"])

    return batches(rows.select("id", "tag", "text", "items"), step, "id long, tag long, names array<string>, spans array<long>")


def _findings(documents: DataFrame, benchmark: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, id, tag, n_words of each row; id, tag, n_hit, n_items, items_sha256 of the documents that hold a window."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    items = scratch.table(items.distinct().withColumn("item", F.xxhash64("name", "text")), "items")
    prints = scratch.table(item_prints(items, span, gram), "prints")
    sizes = sorted(r.size for r in prints.where("size > 0").select("size").distinct().collect())  # under span at most
    passed = spark.sparkContext.broadcast(bitmap(prints, "print", BITMAP_BITS))
    read = scratch.table(document_prints(documents, passed, sizes, span, gram), "read")
    given = read.where(F.size("prints") > 0).select("id", "tag", F.inline(F.arrays_zip(F.col("sizes").alias("size"), F.col("prints").alias("print"))))
    pairs = scratch.table(given.join(small(prints, BROADCAST_PRINTS), ["size", "print"]).select("id", "tag", "item").distinct(), "pairs")
    keys = small(scratch.table(pairs.select("id", "tag").distinct(), "keys"), BROADCAST_KEYS)
    texts = documents.select("doc_id", "text").withColumns(_key()).join(keys, ["id", "tag"], "left_semi").select("id", "tag", "text")
    weight = items.agg(F.sum(F.octet_length("text")), F.count("*"), F.countDistinct("item")).first()
    if (weight[0] or 0) <= ITEM_BYTES and weight[1] == weight[2]:
        shared = spark.sparkContext.broadcast({r.item: (r.name, r.text) for r in items.collect()})
        wanted = pairs.groupBy("id", "tag").agg(F.collect_list("item").alias("items"))  # 8 bytes an item
        wanted = small(scratch.table(wanted, "wanted"), BROADCAST_KEYS // 10)
    else:
        shared = None
        place = F.row_number().over(Window.partitionBy("id", "tag").orderBy("item")) - 1
        dealt = pairs.withColumn("part", F.floor(place / ITEMS))
        wanted = dealt.join(items, "item").groupBy("id", "tag", "part").agg(F.collect_list(F.struct("name", "text")).alias("items"))
    once = texts.dropDuplicates(["id", "tag"])  # repeated rows have one finding
    found = scratch.table(extended(once.join(wanted, ["id", "tag"]), shared, span), "extended")
    whole = found.groupBy("id", "tag").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))

    def more(acc: Column, span_: Column) -> Column:
        low, high = F.shiftright(span_, 32), span_.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.struct(F.greatest(acc["end"], high).alias("end"), (acc["n"] + F.greatest(F.lit(0), high - F.greatest(low, acc["end"]))).alias("n"))

    nought = F.lit(0).cast("long")
    hit = F.aggregate("spans", F.struct(nought.alias("end"), nought.alias("n")), more, lambda acc: acc["n"])
    digest = F.sha2(F.array_join("names", ","), 256)
    told = whole.select("id", "tag", hit.alias("n_hit"), F.size("names").cast("long").alias("n_items"), digest.alias("items_sha256"))
    return read.drop("sizes", "prints"), scratch.table(told, "findings")


def decontaminate(documents: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    read, found = _findings(documents, benchmark, span, gram)
    none = F.lit(0).cast("long")
    return read.join(small(found, BROADCAST_KEYS), ["id", "tag"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, all columns as they are."""
    found = _findings(documents, benchmark, SPAN, GRAM)[1]
    names = fresh(documents.columns, "id", "tag")
    keyed = documents.withColumns(dict(zip(names, _key().values(), strict=True)))
    gone = small(found.select(*[F.col(k).alias(n) for k, n in zip(("id", "tag"), names, strict=True)]), BROADCAST_KEYS)
    return keyed.join(gone, names, "left_anti").drop(*names)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
