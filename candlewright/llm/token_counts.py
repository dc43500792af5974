"""Token counts by a whole-token shortcut.

Before the job, each vocabulary string that ends a word is encoded once; those that come back as one
token form the shortcut (at most one entry per vocabulary entry, a few MB, broadcast). A text is cut into
pre-tokens, those in the shortcut count one, and only the rest are merged, by the library's own model, each
distinct one once in a batch.

The cutting is done here with a pattern only for texts whose every character was shown, again by asking
the library, to be cased, composed and classed as the pattern has it. Other texts, and texts that hold a
special token's string, go to the library whole, so every count is the library's. A tokenizer of another kind has
no shortcut: each text goes to its library whole (tokenizers for .json, sentencepiece for .model).

Defined results: a null text counts as empty (0 bytes, 0 tokens); a repeated row gives a row each; null ids
stay null; other columns are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from candlewright.llm.runtime import batches, column

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Characters put to the library before the job: ASCII, Latin, Greek, Cyrillic, kana, CJK, Hangul syllables.
PROBED = ((0x00, 0x250), (0x370, 0x483), (0x48A, 0x530), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
#: A merged pre-token longer than this is not kept for later batches.
_KEPT_LENGTH, _KEPT = 40, 200_000


def _load(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


class _Pieces:
    """A sentencepiece model, asked as a tokenizer is."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.model.encode(text))


def supported(path: str) -> bool:
    """Is this a lower-casing BPE with word ends, cut as the pattern below cuts?"""
    import json

    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    return kinds == ["NFC", "Replace", "Lowercase"] and (spec.get("model") or {}).get("end_of_word_suffix") == "</w>"


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (after normalisation) that alone encode as one token."""
    tok = _load(path)
    back = {v: k for k, v in _byte_letters().items()}
    asked = []
    for entry in tok.get_vocab(with_added_tokens=False):
        if entry.endswith("</w>"):
            try:
                asked.append(bytes(back[c] for c in entry[:-4]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    found = tok.encode_batch(asked, add_special_tokens=False)
    return frozenset(s for s, e in zip(asked, found, strict=True) if s and len(e.ids) == 1 and tok.normalizer.normalize_str(s) == s)


@lru_cache(maxsize=1)
def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def plain_characters(path: str) -> dict[str, str]:
    """Of the PROBED characters, the class (L, N, S or O) of each that the library lower-cases as str.lower does and keeps apart."""
    tok = _load(path)
    out = {}
    for low, high in PROBED:
        for c in map(chr, range(low, high)):
            lower = tok.normalizer.normalize_str(c)
            if c.isspace() or lower == " ":
                if lower == " " and c in " \t\n\r\x0b\x0c":
                    out[c] = "S"
                continue
            if lower != c.lower() or len(lower) != 1 or lower in "'":
                if c != "'":
                    continue
            pieces = [a for a, _ in tok.pre_tokenizer.pre_tokenize_str(f"a{lower}a")]
            twice = [a for a, _ in tok.pre_tokenizer.pre_tokenize_str(f"{lower}{lower}")]
            if len(pieces) == 1:
                out[c] = "L"
            elif len(pieces) == 3 and len(twice) == 2:
                out[c] = "N"
            elif len(pieces) == 3 and len(twice) == 1:
                out[c] = "O"
    return out


class Counts:
    """One worker's counter."""

    def __init__(self, path: str, whole: frozenset[str], plain: dict[str, str]):
        self.whole, self.fits = whole, bool(plain)
        self.tok = _load(path) if path.endswith(".json") else _Pieces(path)
        if not self.fits:
            return
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        of = {k: "".join(re.escape(c) for c in sorted({c.lower() for c, v in plain.items() if v == k})) for k in "LNO"}
        self.alien = re.compile(f"[^{''.join(re.escape(c) for c in sorted(plain))}]")
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
        self.wide = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{of['L']}]+|[{of['N']}]|[{of['O']}]+")
        self.plain_ascii = all(chr(c) in plain for c in range(0x20, 0x7F))
        letters = _byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        self.kept: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        n = self.kept.get(piece)
        if n is None:
            n = len(self.tok.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
            if len(piece) <= _KEPT_LENGTH:
                if len(self.kept) >= _KEPT:
                    self.kept.clear()
                self.kept[piece] = n
        return n

    def of(self, text: str) -> int:
        if isinstance(self.tok, _Pieces):
            return self.tok.count(text)
        if not self.fits or self.alien.search(text) or any(s in text for s in self.special):
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        lower = text.lower()
        pieces = (self.ascii if lower.isascii() and self.plain_ascii else self.wide).findall(lower)
        whole, merged, total = self.whole, self.merged, 0
        for piece, times in Counter(pieces).items():
            total += times if piece in whole else times * merged(piece)
        return total


def count_tokens(documents: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row of ``documents``."""
    spark = documents.sparkSession
    fits = supported(path)
    shared = spark.sparkContext.broadcast((whole_tokens(path), plain_characters(path)) if fits else (frozenset(), {}))

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in parts:
            counts = counts or Counts(path, *shared.value)
            size, tokens = [], []
            for text in column(batch, "text"):
                text = text.as_py() or ""
                size.append(len(text.encode()))
                tokens.append(counts.of(text))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array(size, pa.int64()),
                    pa.array(tokens, pa.int64()),
                    pa.array([n > limit for n in tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    from pyspark.sql import functions as F

    return batches(documents.select(F.col("doc_id").cast("long"), "text"), step, SCHEMA)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
