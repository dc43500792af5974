"""Packing documents into sequences of fixed length along a space-filling curve.

Each document's token ids, with the end id behind them, are made once and stored. Its vector is the hashed bag of its
ids (log counts, unit length); a fixed random matrix projects it to DIMS numbers, which, scaled by their mean and spread
over the corpus, give the cell whose place on a Hilbert curve orders the documents. They are range-sorted by that place,
running sums of their lengths place each in one stream of tokens, and the stream is cut every ``length`` tokens: neighbours
on the curve share sequences, a document is cut only where a sequence ends, and only the last sequence is padded.

Only (place on the curve, row, length) is sorted. Where each document begins goes back to the stored ids by row: broadcast
up to BROADCAST_ROWS documents (16 bytes each), by a shuffle of the ids beyond.

Ids are the library's: texts of characters that both engines were shown to class alike go through tiktoken with the ranks
of the same file (``same_ranks`` proves that its merges are its ids in order), all others, and texts with an added token's
string, through the library itself.

Defined results: a null text is empty and gives the end id alone; a repeated row is packed again; null ids stay null; documents
of one vector lie side by side; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.runtime import Scratch, batches, column, running
from candlewright.llm.token_counts import _byte_letters, _load

LENGTH = 1024
END_ID = 0
DIMS = 4
BITS = 12
#: Size of the hashed bag of ids.
HASHED = 1024
BROADCAST_ROWS = 400_000

#: The cut of byte-level vocabularies of this kind (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are put to both engines before the job: ASCII, Latin, Greek, Cyrillic, kana, CJK, Hangul syllables.
ASKED = ((0x01, 0x250), (0x370, 0x530), (0x2010, 0x2040), (0x3041, 0x30FF), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))


def same_ranks(path: str) -> dict[bytes, int] | None:
    """The ranks of a plain byte-level BPE whose i-th merge makes the i-th id after the bytes; None for any other file."""
    import json

    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not spec.get("normalizer")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    if not plain or model.get("type") != "BPE" or any(model.get(k) for k in odd):
        return None
    vocab, back = model["vocab"], {v: k for k, v in _byte_letters().items()}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if len(vocab) != 256 + len(pairs) + sum(t["content"] in vocab for t in spec.get("added_tokens", [])) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(back[c] for c in token): i for token, i in vocab.items() if token not in added}


@lru_cache(maxsize=2)
def _fast(path: str):
    """tiktoken over the file's ranks, or None."""
    ranks = same_ranks(path)
    if ranks is None:
        return None
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def alike_characters(path: str) -> str:
    """Of the ASKED characters, those that both engines join to letters, digits, marks and blanks alike."""
    fast, slow, out = _fast(path), _load(path), []
    for low, high in ASKED:
        chars = [chr(c) for c in range(low, high)]
        shown = [f"a{c}a {c}{c} 1{c}1 .{c}. {c} '{c}" for c in chars]
        ids = slow.encode_batch(shown, add_special_tokens=False)
        out += [c for c, s, e in zip(chars, shown, ids, strict=True) if fast.encode_ordinary(s) == e.ids]
    return "".join(out)


class Ids:
    """One worker's tokenizer."""

    def __init__(self, path: str, alike: str):
        self.slow = _load(path)
        self.fast = _fast(path) if alike else None
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.alien = re.compile(f"[^{''.join(map(re.escape, alike))}]") if alike else None

    def of(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.added) and (text.isascii() and "\0" not in text or not self.alien.search(text)):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # its pattern engine gives up (panics) on very long runs; the library doesn't
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def _spread(ids: np.ndarray) -> np.ndarray:
    """The bag's slot of each id."""
    return (ids.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(32 - HASHED.bit_length() + 1)


def projection(dims: int = DIMS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, dims)).astype(np.float32)


def project(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    bag = np.log1p(np.bincount(_spread(ids), minlength=HASHED)).astype(np.float32)
    size = float(np.sqrt(bag @ bag))
    return (bag / size) @ matrix if size else np.zeros(matrix.shape[1], dtype=np.float32)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of cells (integers under 2**bits in each column)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):  # undo the turns of the levels above
        low = (1 << b) - 1
        for d in range(dims):
            turned = (x[d] >> b & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[d] ^= swap
    for d in range(1, dims):  # Gray code over the dimensions
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = place << 1 | (x[d] >> b & 1)
    return place


def token_table(documents: DataFrame, path: str, dims: int = DIMS, end_id: int = END_ID) -> DataFrame:
    """row, doc_id, n (ids, with the end id), ids (little-endian unsigned, 2 bytes each if the vocabulary allows, else 4) and x0.. (the projected vector) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(alike_characters(path) if same_ranks(path) else "")
    width = "<u2" if _load(path).get_vocab_size() <= 1 << 16 else "<u4"
    names = [f"x{d}" for d in range(dims)]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = None, projection(dims)
        for batch in parts:
            ids = ids or Ids(path, shared.value)
            stored, counts, places = [], [], np.zeros((batch.num_rows, dims))
            for i, text in enumerate(column(batch, "text")):
                found = ids.of(text.as_py() or "")
                places[i] = project(found, matrix)
                stored.append(np.append(found, np.uint32(end_id)).astype(width).tobytes())
                counts.append(len(found) + 1)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "row"), column(batch, "doc_id"), pa.array(counts, pa.int64()), pa.array(stored, pa.binary()), *[pa.array(places[:, d]) for d in range(dims)]],
                ["row", "doc_id", "n", "ids", *names],
            )

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return batches(rows, step, f"row long, doc_id long, n long, ids binary, {', '.join(f'{x} double' for x in names)}")


def curve_places(table: DataFrame, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """row, n, place: each document's place on the Hilbert curve through its projected vector, scaled by the corpus's mean and spread."""
    names = [f"x{d}" for d in range(dims)]
    found = table.agg(*[f(x).alias(f"{k}_{x}") for x in names for k, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    mean = np.array([found[f"mean_{x}"] or 0.0 for x in names])
    sd = np.array([found[f"sd_{x}"] or 1.0 for x in names])

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            x = np.column_stack([column(batch, c).to_numpy(zero_copy_only=False) for c in names])
            share = 1 / (1 + np.exp(-1.702 * (x - mean) / sd))  # close to the normal distribution function: cells hold like shares
            cells = np.minimum((share * (1 << bits)).astype(np.int64), (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([column(batch, "row"), column(batch, "n"), pa.array(hilbert(cells, bits))], ["row", "n", "place"])

    return batches(table.select("row", "n", *names), step, "row long, n long, place long")


def pack_documents(documents: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    scratch = Scratch(documents.sparkSession)
    table = scratch.table(token_table(documents, path, DIMS, end_id), "ids")
    begins = running(curve_places(table), ["place", "row"], "n", "begin", scratch).select(F.col("row").alias("of_row"), "begin")
    if begins.count() <= BROADCAST_ROWS:
        begins = F.broadcast(begins)
    width = "<u2" if _load(path).get_vocab_size() <= 1 << 16 else "<u4"
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            begin, n = (column(batch, c).to_numpy() for c in ("begin", "n"))
            first = begin // length
            pieces = (begin + n - 1) // length - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = first[row] + nth
            low = np.maximum(begin[row], sequence * length)
            high = np.minimum(begin[row] + n[row], (sequence + 1) * length)
            start, wide = low - begin[row], []
            whole = [np.frombuffer(x.as_buffer(), dtype=width).astype("<u4") for x in column(batch, "ids")]
            for r, a, b in zip(row, start, high - begin[row], strict=True):
                wide.append(whole[r][a:b].tobytes())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(pa.array(row)), *map(pa.array, (start, high - low)), pa.array(wide, pa.binary()), *map(pa.array, (n[row], sequence, low - sequence * length))], names
            )

    placed = table.select("row", "doc_id", "n", "ids").join(begins, F.col("row") == F.col("of_row")).select("doc_id", "n", "ids", "begin")
    return batches(placed, step, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
