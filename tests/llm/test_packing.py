"""Packing: the curve, ids as the library gives them, whole and gapless sequences."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from candlewright.llm import packing


def test_curve_visits_every_cell_by_single_steps():
    for dims, bits in ((1, 5), (2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        place = packing.hilbert(cells, bits)
        assert sorted(place) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_ids_are_the_librarys(path):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    tok = Tokenizer.from_file(path)
    ids = packing.Ids(path, packing.alike_characters(path))
    parts = ["word", " Word", "'s", "'ll", "12", "  ", "\n", "\t", "é", "é", "ʼ", "日本", "Ж", "𝒳", "👍🏽", "\0", "\xa0", " ", "<|endoftext|>", "…", "_", "-", "½", "ⅷ", "٣"]
    texts = ["", " ", "a" * 50_000, " " * 20_000, "\n" * 5_000 + "x"] + ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(3000)]
    for text, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.of(text).tolist() == e.ids, text[:80]


def test_other_files_go_to_the_library(path):
    import public_tokenizers

    assert packing.same_ranks(path) and packing.same_ranks(public_tokenizers.path("word_bpe_49k.json")) is None


@pytest.mark.parametrize("bound", [packing.BROADCAST_ROWS, 0])
def test_pieces(spark, path, bound, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BROADCAST_ROWS", bound)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["ab", "Cd", "é", "日", "eighty", "."], k=rng.randint(0, 400)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "long " * 9_000), (None, "same"), (None, "same"), (7, rows[7][1])] + [(600 + i, "copy of one text") for i in range(50)]
    frame = spark.createDataFrame([(i, t, 1, "y") for i, t in rows], "doc_id long, text string, n int, begin string").repartition(3)
    pieces = packing.pack_documents(frame, path, 64).collect()
    tok = Tokenizer.from_file(path)
    want = sorted((str(i), tuple([*tok.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in rows)
    sequences, found = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        assert p.length * 4 == len(p.ids) and 0 < p.length <= 64
        found[p.sequence_id * 64 + p.offset - p.start].append(p)
    for s, of in sequences.items():
        at = 0
        for p in sorted(of, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or s == max(sequences)
    got = []
    for of in found.values():  # the pieces of a document lie in one run of the stream
        of.sort(key=lambda p: p.start)
        ids = np.frombuffer(b"".join(p.ids for p in of), dtype="<u4").tolist()
        assert [p.start for p in of] == np.cumsum([0, *[p.length for p in of]])[:-1].tolist() and {p.doc_tokens for p in of} == {len(ids)}
        got.append((str(of[0].doc_id), tuple(ids)))
    assert sorted(got) == want
    copies = {p.sequence_id for p in pieces if p.doc_id is not None and p.doc_id >= 600}
    assert max(copies) - min(copies) <= len(copies), "equal documents lie side by side"
    assert packing.pack_documents(frame.limit(0), path).count() == 0


def test_digest_of_the_query(spark, path):
    one = packing.pack_documents(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path)
    from pyspark.sql import functions as F

    r = one.select("ids", F.crc32("ids").alias("crc")).first()
    assert r.crc == zlib.crc32(bytes(r.ids))
