"""Odd rows, clashing columns, long texts and the ways taken beyond size bounds."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from candlewright.llm import decontaminate, jaccard, mixing, runtime, secrets, substrings, token_counts, toxicity, urls, vectors, warc
from pyspark.sql import functions as F
from tests.llm import test_decontaminate, test_substrings, test_vectors

CLASH = ["id", "tag", "node", "n", "text_", "mark", "no_id", "known_id", "of_id", "of_source", "of_size", "base", "more", "times", "take", "take_", "s", "i", "z", "__id", "__tag", "__c_0", "score"]


def clashing(spark, rows):
    """doc_id, text, lang, source, n_chars and one column of each name that an operator might use."""
    frame = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def test_stages_keep_clashing_columns(spark):
    rng = random.Random(2)
    words = lambda n: " ".join(f"v{rng.randrange(400)}" for _ in range(n))
    item = words(14)
    rows = [(i, words(30), f"s{i % 2}") for i in range(20)] + [(30, words(5) + " " + item, "s0"), (None, words(20), None), (31, words(9) + " password=abcdef123", "s1"), (32, None, "s0"), (33, words(30_000), "s1")]
    docs = clashing(spark, rows)
    bench = spark.createDataFrame([(1, item, "x")], "item_id long, text string, id string")
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(r[0]) for r in rows if r[0] != 30)
    single = corpus_pipeline.drop_near_duplicates(spark, docs.unionByName(docs), "")
    out = single.collect()
    assert single.columns == docs.columns and len(out) == len(rows) + 1 and all(r[c] == f"own {c}" for r in out for c in CLASH)  # the row without text stays twice
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "take__"] and all(r[c] == f"own {c}" for r in mixed.collect() for c in CLASH)
    safe = secrets.redact_secrets(docs)
    assert safe.columns == docs.columns and safe.where("text like '%abcdef123%'").count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.acceptable_documents(docs, none).columns == docs.columns


def test_survivor_is_the_least_row(spark):
    rows = [(7, "one and the same text of more than five words", lang) for lang in ("fr", "de", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert [r.lang for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == ["de"]
    assert [r.lang for r in corpus_pipeline.drop_near_duplicates(spark, docs.withColumn("m", F.create_map(F.lit("a"), F.lit(1))), "").select("lang").distinct().collect()] != []


@pytest.mark.parametrize(("item_bytes", "keys"), [(0, 200_000), (32_000_000, 0)])
def test_decontamination_beyond_bounds(spark, monkeypatch, item_bytes, keys):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", item_bytes)
    monkeypatch.setattr(decontaminate, "ITEMS", 2)
    monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", keys)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choices(["a", "b", "c", "D"], k=n))
    items = [(i, text(rng.choice([4, 10, 12, 25]))) for i in range(9)]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(None, items[0][1]), (5, items[1][1]), (5, items[1][1]), ((1 << 63) - 1, items[0][1] + " x")]
    docs.append((90, text(40_000)))
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, id int, tag int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(repr(tuple(r)) for r in decontaminate.decontaminate(frame, bench).collect()) == test_decontaminate.plain(docs, items)


def test_toxicity_features_against_a_plain_count():
    lexicon = {"zork": 2.5, "blar~": 1.5, "zorki": 0.5}
    rng = random.Random(4)
    vocab = ["zork", "Zork", "blarney", "blarx", "you", "tu", "idiot", "1d10t", "sc*m", "plain", "ÄRGER", "日本", "x_y", "B2B", "!", "?!", ",", ".;:", "it's", "a@b", "zorkish"]
    known = toxicity.Features(lexicon)
    for _ in range(200):
        text = rng.choice([" ", "  ", "\n"]).join(rng.choices(vocab, k=rng.randint(0, 25)))
        words = re.findall(r"[^\W_](?:[\w@$*]*[^\W_])?", text.lower())
        got = known.of(text)
        assert got == toxicity.features(text, lexicon)
        if not words:
            assert got == [0.0] * 14
            continue

        def weight(w):
            plain = w if w.isalpha() else w.translate(str.maketrans("013457@$", "oieastas")).replace("*", "")
            found = [lexicon.get(x, 0) for x in (w, w[:4] + "~" if len(w) > 4 else w, w[:5] + "~" if len(w) > 5 else w)]
            return max([*found, 1.0 if plain in toxicity.INSULTS else 0.0])

        heavy = [w for w in words if weight(w)]
        gaps = [abs(a - b) for a, x in enumerate(words) if weight(x) for b, y in enumerate(words) if y in toxicity.SECOND_PERSON]
        letters = [c for c in text if c.isalpha()]
        assert got[1] == pytest.approx(len(heavy) / len(words)) and got[5] == pytest.approx(sum(map(weight, words)) / len(words))
        assert got[9] == pytest.approx(1 / (1 + min(gaps)) if gaps else 0) and got[6] == max(map(weight, words), default=0)
        assert got[10] == pytest.approx(sum(c.isupper() for c in text) / max(1, len(letters))) and got[13] == pytest.approx(sum(not w.isalpha() for w in words) / len(words))


def test_toxicity_ties_and_repeats(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} " * (i + 1), "x") for i in range(30)] + [(3, "zork " * 50_000, "x"), (3, None, "x"), (None, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(3, 0), (3, 1), (4, None)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == 33 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    flat = toxicity.toxicity_scores(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).collect()
    assert {(r.score, r.predicted) for r in flat} == {(0.5, 1)}  # one of two labels is toxic: a tie counts as toxic


def test_secrets_odd_rows(spark):
    long = "x " * 400_000 + "AKIA" + "A" * 20
    rows = [(1, long, "s"), (1, long, "s"), (None, "token: abcdef1", "s"), (2, None, "s"), (3, "", "s")]
    out = secrets.find_secrets(clashing(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex) for r in out) == [("1", 0, 1, 0), ("1", 0, 1, 0), ("2", 0, 0, 0), ("3", 0, 0, 0), ("None", 1, 0, 0)]
    assert secrets.find_secrets(clashing(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize(("thin", "chunk", "dims"), [(0, 16384, (32,)), (0, 15, (32, 2)), (4, 9, (1, 2, 3))])
def test_vectors_in_crowds_and_short(spark, monkeypatch, thin, chunk, dims):
    monkeypatch.setattr(vectors, "THIN", thin)
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    monkeypatch.setattr(vectors, "_SLAB", 37)
    rng = np.random.default_rng(7)
    rows = []
    for dim in dims:
        base = rng.normal(size=(12, dim))
        for _ in range(70):
            v = base[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0, 0.02, 0.1, 0.3])
            rows.append((len(rows) if rng.random() < 0.9 else None, [float(np.float32(x)) for x in v]))
    rows += [(None, rows[0][1]), (1000, rows[0][1]), (1001, [0.0] * dims[0])]
    frame = spark.createDataFrame([(i, e, 1, 2) for i, e in rows], "vec_id long, embedding array<float>, cell int, part int").repartition(3)
    assert sorted(repr(tuple(r)) for r in vectors.near_duplicates(frame).collect()) == test_vectors.plain(rows, 0.95)


@pytest.mark.parametrize(("runs", "keys"), [(1, 500_000), (20_000, 0), (3, 0)])
def test_substrings_with_hot_minimisers(spark, monkeypatch, runs, keys):
    monkeypatch.setattr(substrings, "HOT_RUNS", runs)
    monkeypatch.setattr(substrings, "HOT_PART", 1 << 60)
    monkeypatch.setattr(substrings, "BROADCAST_KEYS", keys)
    rows = test_substrings.corpus(7, 60)
    rows += [(None, rows[0][1] + " tail"), ((1 << 63) - 1, rows[1][1]), (600, " ".join(f"w{i % 997}" for i in range(30_000)))]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows if i != (1 << 63) - 1], "doc_id long, text string, tag int, spans string").repartition(3)
    assert sorted(repr(tuple(r)) for r in substrings.dedup_substrings(frame, 8, 3).collect()) == test_substrings.plain([r for r in rows if r[0] != (1 << 63) - 1], 8)


def test_url_ties_and_length(spark):
    rules = spark.createDataFrame([("a.org", "/x", "allow"), ("a.org", "/x", "block"), ("org", "/xyz1", "block"), ("b.org", "/x", "allow"), (None, "/", "block")], urls.RULES_SCHEMA)
    path = "/x" + "y" * 200_000
    pages = spark.createDataFrame([(1, "h://a.org" + path, 9), (2, "h://a.org/xyz1", 9), (3, "h://" + "s." * 500 + "b.org/x", 9)], "page_id long, url string, rule int")
    out = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(pages, rules).collect()}
    # rules of one length: the longer host wins; one rule given both ways blocks
    assert out == {1: ("a.org/x", "block"), 2: ("org/xyz1", "block"), 3: ("b.org/x", "allow")}


def test_warc_odd_rows(spark, monkeypatch):
    long = "y" * 2_000_000
    rows = [(None, "u", long, 1), (None, "v", long, 2), (4, "w", long + "z", 3), (5, "w", long + "z", 3), (5, "w", long + "z", 3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    for most in (200_000, 0):
        monkeypatch.setattr(warc, "BROADCAST_FIRSTS", most)
        folder = runtime.Scratch(spark).path("archives")
        index = runtime.Scratch(spark).table(warc.write_archives(frame, folder), "index")
        got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_records(index, folder).collect())
        assert got == [("4", "response", None, 2_000_001), ("5", "revisit", 4, 2_000_001), ("5", "revisit", 4, 2_000_001), ("None", "response", None, 2_000_000), ("None", "response", None, 2_000_000)]
    assert warc.write_archives(frame.limit(0), folder).count() == 0


def test_token_counts_of_other_tokenizers(spark):
    P = pytest.importorskip("public_tokenizers")
    texts = ["", None, "The cat's 12 hats!", "日本 é\u00a0x", "a" * 3000]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(2, texts[2], 1), (None, "x", 1)], "doc_id long, text string, n_tokens int")
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = P.path(name)
        if name.endswith(".json"):
            tok = token_counts._load(path)
            count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)  # noqa: E731, B023
        else:
            model = token_counts._Pieces(path)
            count = model.count
        got = token_counts.count_tokens(frame, path, 5).collect()
        assert len(got) == 7 and all(r.n_tokens == count("x" if r.doc_id is None else texts[r.doc_id] or "") and r.over_limit == (r.n_tokens > 5) for r in got), name
    assert token_counts.count_tokens(frame.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_sets_of_one_hash_are_told_apart(spark, monkeypatch):
    real = jaccard._set_key
    monkeypatch.setattr(jaccard, "_set_key", lambda tokens, seed=0: 5 if seed == 0 else real(tokens, seed))
    frame = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "A B C D")], "doc_id long, text string").coalesce(1)
    try:
        out = sorted(tuple(r) for r in jaccard.jaccard_components(frame, 3, 90).collect())
    except Exception as error:  # workers import the module themselves, so the patch may not reach them
        pytest.skip(str(error)[:80])
    assert out == [(1, 2, 1), (2, 2, 2), (3, 2, 1)]


def test_helpers():
    assert runtime.fresh(["a", "A_", "b"], "a", "c", "a") == ["a__", "c", "a___"]
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 9_000_000, "y", "z" * 9_000_000, "q"])], ["text"])
    parts = list(runtime._cut(batch))
    assert sum(p.num_rows for p in parts) == 4 and len(parts) == 2 and all(p.nbytes < 2 * runtime.BATCH_BYTES for p in parts)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
