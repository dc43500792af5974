"""Words and word windows of many texts at once, as arrays.

Words are runs of bytes outside a separator set that is all ASCII, so working on UTF-8 bytes gives
the same words as working on characters. A 64-bit hash stands for a word or a window; equal texts
always have equal hashes, so hashes never lose a match, and callers confirm matches where a chance
collision could add one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

WHITE = b" \t\n\x0b\x0c\r"
_LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
LOWER_AZ = bytes.maketrans(*_LOWER)

#: Longer words are hashed one by one.
_LONG = 64
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def separators(keep: str) -> np.ndarray:
    """A 256-entry table, true for separator bytes. keep: 'space' (words are non-white) or 'alnum' (digits, letters, non-ASCII)."""
    table = np.zeros(256, dtype=bool)
    if keep == "space":
        table[list(WHITE)] = True
    else:
        table[:0x80] = True
        table[0x30:0x3A] = False
        table[0x61:0x7B] = False
    return table


SPACE, ALNUM = separators("space"), separators("alnum")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= _M2
    x ^= x >> np.uint64(27)
    x *= _M3
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive texts: byte ranges in ``data``, the row of each, and where each row's words begin."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # len = rows + 1

    def __len__(self) -> int:
        return len(self.start)

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.first)

    def place(self) -> np.ndarray:
        """Each word's number in its own text, from 0."""
        return np.arange(len(self.start), dtype=np.int64) - self.first[self.row]


def split(texts: pa.Array, sep: np.ndarray = SPACE, lower: bool = False) -> Words:
    """Words of each text; a null has none."""
    texts = texts.cast(pa.large_binary())
    rows = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + rows + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    body = texts.buffers()[2]
    data = body.slice(low, high - low).to_pybytes() if body is not None and high > low else b""
    offsets = offsets - low
    if texts.null_count:  # a null's bytes, if it has any, are not text
        valid = texts.is_valid().to_numpy(zero_copy_only=False)
        kept = [data[a:b] if ok else b"" for a, b, ok in zip(offsets[:-1], offsets[1:], valid, strict=True)]
        data, offsets = b"".join(kept), np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)
    if lower:
        data = data.translate(LOWER_AZ)
    raw = np.frombuffer(data, dtype=np.uint8)
    word = ~sep[raw]
    before = np.empty(len(raw), dtype=bool)
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = word[:-1], word[1:]
        inner = offsets[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        before[inner] = False
        after[inner - 1] = False
    start = np.flatnonzero(word & ~before)
    end = np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(start, offsets, side="left").astype(np.int64)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(first))
    return Words(data, start, end, row, first)


def word_hashes(words: Words) -> np.ndarray:
    n = words.end - words.start
    out = mix(n.astype(np.uint64) * _M1)
    if not len(n):
        return out
    padded = np.frombuffer(words.data + b"\0" * 8, dtype=np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(padded) - 7,), strides=(1,))
    todo = np.arange(len(n))
    for at in range(0, _LONG, 8):
        if at:
            todo = todo[n[todo] > at]
        if not len(todo):
            break
        part = eight[words.start[todo] + at] & _MASKS[np.minimum(n[todo] - at, 8)]
        out[todo] = mix(out[todo] * _M1 ^ part)
    for i in np.flatnonzero(n > _LONG):
        out[i] = np.uint64(xxhash.xxh3_64_intdigest(words.data[words.start[i] : words.end[i]]))
    return out


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive entries; runs across texts are the caller's to leave out."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(count, dtype=np.uint64)
    factor = 1
    for i in range(size):
        factor = factor * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        total += hashes[i : i + count] * np.uint64(factor)
    return mix(total)


def whole(words: Words, size: int) -> np.ndarray:
    """For each run of ``size`` words: does it lie in one text?"""
    count = len(words) - size + 1
    return words.row[:count] == words.row[size - 1 :] if count > 0 else np.empty(0, dtype=bool)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the [start, end) ranges."""
    steps = np.zeros(size + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
