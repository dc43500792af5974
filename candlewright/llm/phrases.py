"""Phrase collocations from suffix automata, one for each shard of texts.

A shard's automaton holds every run of at most ``depth`` words of its pieces. It is built in arrays, level by level: a state
of level d is a run of d words; ``count`` is the size of its endpos set, ``link`` its suffix link (the run without its first word,
a state of the level below) and ``head`` the state it was reached from (the run without its last word). Runs of words are
known by dense numbers of (head, word), so states are exact, not hashed. Each level is emitted with its counts, and counts are
summed by (language, phrase) over all shards. Level 0, the root, counts all words.

Levels 1 and 2 are counted at once. A level above is counted only for runs whose head and link are both frequent, which loses
none that is frequent itself; frequent runs of the level below are asked through a bitmap of fixed size, whose chance hits cost
a sum each and no result. Subsumption follows the same two edges: a longer candidate tells its count to its link and to its head,
and from there down to two words.

Defined results: a null text is empty; a null language is ``und``; a repeated row counts again; texts of any length are worked
in runs of at most CHUNK words; ids and other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewright.llm.runtime import Scratch, batches, bitmap, column, handed, has, slices, small
from candlewright.llm.textscan import signed, split, whole, window_hashes, word_hashes

LEAST = 10
LONGEST = 3
REPORTED = 2000
#: Words whose runs are told apart at once, and bytes of text that one automaton is built from.
CHUNK = 500_000
SHARD_BYTES = 4_000_000
#: Phrases that are spelt out at once, and rows that Python is handed at once.
NAMED, HANDED = 100_000, 1000
#: Bits of the map of frequent runs for each of them, and at most (16 MB).
BITS_PER_RUN, BITS = 16, 1 << 27
#: More languages than this are joined, not broadcast.
LANGUAGES = 100_000

_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_NO_WORD, _BREAK = _table(_BREAKS + _BLANKS), _table(_BREAKS)


class Shard:
    """Words of some texts, numbered, with the piece of each."""

    def __init__(self, texts: pa.Array, hashed: bool = True):
        words = split(texts, _NO_WORD, lower=True)
        self.hashes = word_hashes(words) if hashed else None
        breaks = np.flatnonzero(_BREAK[np.frombuffer(words.data, dtype=np.uint8)])
        self.piece = (np.searchsorted(breaks, words.start) + words.row).astype(np.int32)  # a piece ends at a break or with its text
        ends = np.append(words.start, words.end[-1:]).astype(np.int64)
        with_blanks = pa.Array.from_buffers(pa.large_string(), len(words), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.data)])
        coded = pc.ascii_rtrim(with_blanks, characters=(_BREAKS + _BLANKS).decode()).dictionary_encode()
        self.names, self.word = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)

    def __len__(self) -> int:
        return len(self.word)


class Automaton:
    """States of the runs of at most ``depth`` words that start at words ``low`` to ``high`` of a shard.

    ``last[d]``, ``head[d]``, ``link[d]`` and ``count[d]`` describe the states of level d: their last word, the state of level d - 1
    without it, the state of level d - 1 without the first word, and how often they occur. The link of a run that ends the range is looked up in the range's
    lookahead, so states may have count 0. ``open_`` says which places may begin a run of the last level; below it, only runs inside these are built.
    """

    def __init__(self, shard: Shard, low: int, high: int, depth: int, open_: np.ndarray | None = None):
        stop = min(len(shard), high + depth - 1)
        word, piece, own = shard.word[low:stop], shard.piece[low:stop], high - low
        self.head, self.link, self.last, self.count = [None], [None], [None], [np.array([own])]
        state = np.zeros(len(word), dtype=np.int32)
        for d in range(1, depth + 1):
            n = len(word) - d + 1
            if n <= 0:
                break
            runs = piece[:n] == piece[d - 1 :]
            if open_ is not None:  # places in runs whose head and link may be frequent
                runs &= _reached(open_[low:stop], depth - d)[:n]
            at = np.flatnonzero(runs & (state[:n] >= 0))
            keys = state[at].astype(np.int64)
            keys *= len(shard.names)
            keys += word[at + d - 1]
            keys, first, found = np.unique(keys, return_index=True, return_inverse=True)
            self.head.append((keys // len(shard.names)).astype(np.int32))
            self.last.append((keys % len(shard.names)).astype(np.int32))
            self.link.append(state[at[first] + 1] if d > 1 else np.zeros(len(keys), dtype=np.int32))
            self.count.append(np.bincount(found[at < own], minlength=len(keys)).astype(np.int32))
            state = np.full(len(word), -1, dtype=np.int32)
            state[at] = found

    def phrases(self, names: pa.Array, d: int) -> tuple[pa.Array, np.ndarray]:
        """The runs of level d that occur, and their counts."""
        some = list(self.some_phrases(names, d, max(1, len(self.count[d]) if d < len(self.count) else 0)))
        return some[0] if some else (pa.array([], pa.large_string()), np.empty(0, dtype=np.int64))

    def some_phrases(self, names: pa.Array, d: int, size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """The runs of level d that occur, and their counts, ``size`` at a time."""
        states = np.flatnonzero(self.count[d]) if 0 < d < len(self.count) else []
        if d == 0:
            yield pa.array([""], pa.large_string()), self.count[0]
        for a in range(0, len(states), size):
            yield self._named(names, d, states[a : a + size]), self.count[d][states[a : a + size]]

    def _named(self, names: pa.Array, d: int, at: np.ndarray) -> pa.Array:
        parts = []
        for level in range(d, 0, -1):
            parts.append(names.take(pa.array(self.last[level][at])))
            at = self.head[level][at]
        return pc.binary_join_element_wise(*reversed(parts), pa.scalar(" ", pa.large_string())) if d > 1 else parts[0]


def _reached(open_: np.ndarray, ahead: int) -> np.ndarray:
    """Places at most ``ahead`` after an open one."""
    out = open_.copy()
    for k in range(1, min(ahead + 1, len(open_))):
        out[k:] |= open_[:-k]
    return out


def _shards(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """(language, texts): texts of one language, SHARD_BYTES of them together at most (one longer text alone)."""
    held: list[pa.RecordBatch] = []

    def groups() -> Iterator[tuple[str, pa.Array]]:
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        for lang in table.column("lang").unique().to_pylist():
            texts = table.column("text").filter(pc.equal(table.column("lang"), lang))
            yield lang, pa.concat_arrays([x.cast(pa.large_string()) for x in texts.chunks])

    size = 0
    for batch in parts:
        for a, b in slices(column(batch, "text"), SHARD_BYTES // 16):
            more = batch.slice(a, b - a)
            if held and size + more.nbytes > SHARD_BYTES:
                yield from groups()
                size = 0
            held.append(more)
            size += more.nbytes
    if held:
        yield from groups()


def _language(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def run_counts(documents: DataFrame, levels: tuple[int, ...], frequent: bytes | None = None, bits: int = BITS) -> DataFrame:
    """lang, phrase, n of the runs of the given lengths; above two words only those whose head and link may be ``frequent``."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    depth = max(levels)

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _shards(parts):
            shard = Shard(texts, shared.value is not None)
            open_ = None
            if shared.value is not None and len(shard):
                known = has(shared.value, _in(lang, window_hashes(shard.hashes, depth - 1)), bits)
                open_ = np.zeros(len(shard), dtype=bool)
                open_[: max(len(known) - 1, 0)] = known[:-1] & known[1:]
                shard.hashes = None
            for low in range(0, len(shard), CHUNK):
                built = Automaton(shard, low, min(low + CHUNK, len(shard)), depth, open_)
                for d in levels:
                    for some, counts in built.some_phrases(shard.names, d, NAMED):
                        yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(some)), some.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "n"])
            pa.default_memory_pool().release_unused()  # else the allocator keeps what the largest shard took

    each = batches(_language(documents), step, "lang string, phrase string, n long")
    return each.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _in(lang: str, hashes: np.ndarray) -> np.ndarray:
    return hashes ^ word_hashes(split(pa.array(["x" + lang.replace(" ", "_")])))[:1]


def _mapped(frequent: DataFrame, length: int, bits: int) -> bytes:
    """The bitmap of the frequent phrases of one length."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            words = split(column(batch, "phrase"), _NO_WORD)
            runs = window_hashes(word_hashes(words), length)[whole(words, length)]
            langs = column(batch, "lang").dictionary_encode()
            keys = np.array([_in(x, np.zeros(1, dtype=np.uint64))[0] for x in langs.dictionary.to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(signed(runs ^ keys[langs.indices.to_numpy()]))], ["h"])

    return bitmap(batches(frequent.select("lang", "phrase"), step, "h long"), "h", bits)


def _words(phrase: str = "phrase"):
    return F.split(phrase, " ")


def frequent_phrases(documents: DataFrame, least: int, longest: int, scratch: Scratch, bits: int = BITS) -> DataFrame:
    """lang, phrase, words, n: each run of 1 to ``longest`` words that occurs ``least`` times or more, and the root (no words) of each language."""
    with handed(documents.sparkSession, HANDED):
        out = scratch.table(run_counts(documents, (0, 1, 2)[: longest + 1]).where((F.col("n") >= least) | (F.col("phrase") == "")), "runs")
    level = out
    for d in range(3, longest + 1):
        below = level.where(F.size(_words()) == d - 1)
        used = 1 << min(bits.bit_length() - 1, max(20, (BITS_PER_RUN * below.count()).bit_length()))
        known = _mapped(below, d - 1, used)
        with handed(documents.sparkSession, HANDED):
            level = scratch.table(run_counts(documents, (d,), known, used).where(F.col("n") >= least), "runs")
        out = out.unionByName(level)
    return out.select("lang", "phrase", F.when(F.col("phrase") == "", 0).otherwise(F.size(_words())).alias("words"), "n")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, reported: int = REPORTED, cover: int = 50, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``reported`` phrases of 2 to ``longest`` words.

    The score is floor(1000000 * a * a / (l * r)) at its lowest cut, in whole decimals (exact up to counts of 10**15). A phrase that lies in a longer one with at
    least ``cover`` percent of its count is left out.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    runs = scratch.table(frequent_phrases(documents, least, longest, scratch, bits), "frequent")
    found = runs.where("words >= 2").select("lang", "phrase", "words", F.col("n").alias("a"))

    # each longer candidate tells its count down its head and link edges
    inner = F.flatten(
        F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(_words(), at, size), " ")))
    )
    told = found.where("words >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    most = told.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover)).drop("longer")

    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(_words(), F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(_words(), F.col("k") + 1, F.col("words")), " ").alias("right")
    )
    part = lambda side, count: runs.select("lang", F.col("phrase").alias(side), F.col("n").alias(count))
    counted = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    whole_ = lambda c, p=19: F.col(c).cast(f"decimal({p},0)")
    score = F.expr("CAST(1000000 AS DECIMAL(7,0))").cast("decimal(38,0)") * (whole_("a") * whole_("a")).cast("decimal(38,0)")
    scored = counted.select("lang", "phrase", "a", "k", "l", "r", score.cast("decimal(38,0)").alias("up"), (whole_("l") * whole_("r")).cast("decimal(38,0)").alias("down")).select(
        "lang", "phrase", "a", F.struct(F.expr("up div down").cast("long").alias("score"), "k", "l", "r").alias("cut")
    )
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    ahead = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    first = lowest.withColumn("ahead", ahead).where(F.col("ahead") <= reported).withColumn("rank", rank).where(F.col("rank") <= reported)
    totals = small(runs.where("words = 0").select("lang", F.col("n")), LANGUAGES)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d) WHERE len(ws) > 0),
g AS (SELECT lang, w, array_to_string(ws[i:i + w - 1], ' ') AS phrase FROM (SELECT lang, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM p CROSS JOIN (SELECT unnest([1, 2, 3]) AS w) WHERE len(ws) >= w)),
f AS (SELECT lang, w, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, w, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE w > 1 AND f >= 10),
x AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM c WHERE w = 3) GROUP BY ALL),
k AS (SELECT c.lang, c.phrase, a, w, ws FROM c LEFT JOIN x ON c.lang = x.lang AND c.phrase = x.phrase WHERE longer IS NULL OR 100 * longer < 50 * a),
u AS (SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS lft, array_to_string(ws[k + 1:w], ' ') AS rgt FROM (SELECT *, unnest(range(1, w)) AS k FROM k)),
s AS (SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r, (1000000::HUGEINT * u.a * u.a // (x.f::HUGEINT * y.f))::BIGINT AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.lft JOIN f y ON y.lang = u.lang AND y.phrase = u.rgt),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM s) WHERE nth = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n ON o.lang = n.lang WHERE rank <= 2000
"""
