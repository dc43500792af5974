"""Secret scan: keyword prefilter, anchored patterns near hits, embedded checksums.

An Aho-Corasick automaton over the ASCII-lowered text finds keywords in one pass, and a pattern is tried
only where its keyword begins, in order, past the last match of its kind: what a scan of the whole text with
that pattern would give. Runs of hexadecimal digits have no keyword; a run of HEX_LENGTH digits covers four
probes in a row of every sixth character, so a search for four hits in the probed bytes finds each place to
look at. Kinds with a checksum inside (tokens that end in a base-62 CRC-32) count only if it holds, and a web
token only if its header decodes to JSON with an algorithm.

Defined results: a null text is empty; positions are code points, end exclusive; a repeated row gives a row
each; null ids stay null; other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewright.llm.runtime import batches, column

#: Kinds in the order that settles spans with the same start; the first three are the contract's base.
KINDS = ("assign", "access", "hex", "hosting", "registry", "webtoken", "private_key")
BASE = KINDS[:3]
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_HOSTING = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_REGISTRY = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_WEBTOKEN = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]{8,}")
_PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )?PRIVATE KEY-----")
#: keyword (lower case) -> kind
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "hosting", "gho_": "hosting", "ghu_": "hosting", "ghs_": "hosting", "ghr_": "hosting",
    "npm_": "registry", "eyj": "webtoken", "-----begin ": "private_key",
}
_PATTERNS = {
    "assign": _ASSIGN, "access": _ACCESS, "hosting": _HOSTING, "registry": _REGISTRY, "webtoken": _WEBTOKEN, "private_key": _PRIVATE_KEY,
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_PROBE = HEX_LENGTH // 4
_IS_HEX = bytes(0x31 if chr(b) in "0123456789abcdef" else 0x30 for b in range(256))


def base62(n: int, width: int = 6) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out.rjust(width, "0")


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[2]) >= ASSIGN_LENGTH
    if kind == "access":
        return m.end() - m.start() >= ACCESS_LENGTH
    if kind in ("hosting", "registry"):
        return base62(zlib.crc32(m[1].encode())) == m[2]
    if kind == "webtoken":
        try:
            head = json.loads(base64.urlsafe_b64decode(m[1] + "=" * (-len(m[1]) % 4)))
        except (ValueError, binascii.Error):
            return False
        return isinstance(head, dict) and "alg" in head
    return True


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def scan(text: str, auto) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    view = text.encode("latin-1", "replace")  # a byte for each character
    found: list[tuple[int, int, str]] = []
    past = dict.fromkeys(_PATTERNS, 0)
    hits = [(end + 1 - n, kind) for end, (kind, n) in auto.iter(view.lower().decode("latin-1"))]
    hits.sort()
    for at, kind in hits:
        if at >= past[kind] and (m := _PATTERNS[kind].match(text, at)):
            past[kind] = m.end()
            if _holds(kind, m):
                found.append((at, m.end(), kind))
    probes = view[::_PROBE].translate(_IS_HEX)
    at, last = probes.find(b"1111"), 0
    while at >= 0:
        here = at * _PROBE
        if here >= last and text[here : here + 1] in "0123456789abcdef":
            start = here
            while start > last and text[start - 1] in "0123456789abcdef":
                start -= 1
            last = _HEX.match(text, start).end()
            if last - start >= HEX_LENGTH:
                found.append((start, last, "hex"))
            at = probes.find(b"1111", max(at + 1, last // _PROBE))
        else:
            at = probes.find(b"1111", at + 1)
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans and all spans, for each row of ``documents``."""

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in parts:
            counts, digests, spans = {k: [] for k in BASE}, [], []
            for text in column(batch, "text"):
                found = scan(text.as_py() or "", auto)
                for k in BASE:
                    counts[k].append(sum(s[2] == k for s in found))
                said = [f"{k}:{a}:{b}" for a, b, k in found]
                base = ",".join(x for x, s in zip(said, found, strict=True) if s[2] in BASE)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(",".join(said))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests), pa.array(spans)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return batches(documents.select(F.col("doc_id").cast("long"), "text"), step, SCHEMA)


def mask(text: str, found: list[tuple[int, int, str]], by: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced."""
    out, at, end = [], 0, -1
    for a, b, _ in found:
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            at = end
        out += [text[at:a], by]
        end = b
    return "".join(out) + text[max(end, 0) :] if found else text


def redact_secrets(documents: DataFrame) -> DataFrame:
    """``documents`` with secrets masked in text, and n_chars (where there is one) to match; no row is lost."""
    schema = documents.schema
    keep = documents.columns

    def step(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton()
        for batch in parts:
            texts = [t.as_py() for t in column(batch, "text")]
            clean = [t if t is None else mask(t, scan(t, auto)) for t in texts]
            out = {c: column(batch, c) for c in keep}
            out["text"] = pa.array(clean, pa.string())
            if "n_chars" in out:
                kind = out["n_chars"].type
                sizes = [old if new is text or new is None else len(new) for old, new, text in zip(out["n_chars"].to_pylist(), clean, texts, strict=True)]
                out["n_chars"] = pa.array(sizes, kind)
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return batches(documents, step, schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
