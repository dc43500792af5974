"""Secrets, token counts, URL filter, WARC and mixing against plain restatements, odd rows included."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from candlewright.llm import mixing, secrets, token_counts, urls, warc
from candlewright.llm.runtime import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows], DOCS)


def plain_secrets(text):
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [x[2] for x in sorted(out)]


def test_secrets_match_whole_scan(spark):
    rng = random.Random(4)
    parts = ["password", "Token", "api_key", "APIKEY", "ſecret", "secret", "=", ":", " ", '"', "'", "abcdef0", "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef", "deadbeef", "é", "日", "x", "\n", "passwd"]
    texts = ["", None, "password=secret=token=abcdef1"] + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(400)]
    got = {r.doc_id: r for r in secrets.find_secrets(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        base = plain_secrets(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest(), t
        assert [s for s in got[i].spans.split(",") if s.split(":")[0] in secrets.BASE] == base
        assert got[i].n_hex == sum(s.startswith("hex") for s in base)


def test_checksummed_kinds():
    auto, body = secrets.automaton(), "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + secrets.base62(zlib.crc32(body.encode()))
    assert [k for _, _, k in secrets.scan(f"x {good} y", auto)] == ["hosting"]
    assert not secrets.scan(f"x ghp_{body}000000 y", auto)
    assert secrets.mask(f"x {good} y", secrets.scan(f"x {good} y", auto)) == "x [SECRET] y"


def test_redaction_keeps_rows(spark):
    frame = docs(spark, [(1, "password=abcdef12 ok", "a"), (2, None, None), (3, "", "a")])
    out = {r.doc_id: r for r in secrets.redact_secrets(frame).collect()}
    assert out[1].text == "[SECRET] ok" and out[1].n_chars == 11 and out[2].text is None and out[3].text == "" and out[1].extra == "x"
    assert secrets.redact_secrets(frame.limit(0)).count() == 0


def test_token_counts_are_the_librarys(spark):
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    tok = token_counts._load(path)
    rng = random.Random(9)
    parts = ["the", "The", "don't", "I'LL", "é", "e\u0301", "ß", "İ", "Σας", "日本", "한", "123", "½", "²", "  ", "\u00a0", "\x1f", "\x85", "\u200b", "!!", "'", "''s", "<|endoftext|>", "<|", "😀", "\t", "ſ", "ǆ", "naïve", "x" * 300]
    texts = ["", None, "a" * 50_000] + ["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randint(1, 30))) for _ in range(500)]
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), path, 40).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 40), t


def test_url_filter(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    given = ["http://A.Example.ORG/es/x?y", "https://example.org/en/12", "http://example.org", "http://xexample.org/es/", None, "no scheme", "x://y.com/de/#z", "x://com/fr/", "", "a\nb://q.org/", "x://a..org/p", "http://org/es/", "x://example.org:8/es/"]
    frame = spark.createDataFrame([(i, u, "h") for i, u in enumerate(given)] + [(0, given[0], "h"), (None, given[1], None)], "page_id long, url string, host string")

    def plain(u):
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            m = re.match(r"([^/?#]*)([^?#]*)", rest)
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"

    for table in (urls.rules_frame(spark), urls.rules_frame(spark).repartition(3)):
        got = urls.filter_urls(frame, table).collect()
        assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == sorted(repr((r.page_id, *plain(r.url))) for r in frame.collect())
    assert urls.filter_urls(frame, urls.rules_frame(spark).limit(0)).where("verdict = 'allow' and rule is null").count() == 15
    assert urls.filter_urls(frame.limit(0), urls.rules_frame(spark)).count() == 0


def test_url_filter_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 0)
    frame = spark.createDataFrame([(1, "x://a.org/es/")], "page_id long, url string")
    assert urls.filter_urls(frame, urls.rules_frame(spark)).collect()[0].verdict == "allow"


def test_warc_round_trip(spark):
    long = "<p>é" + "x" * 200
    rows = [(5, "u", long), (3, "v\r\nw", long), (9, None, long), (1, "t", "short"), (2, "t", "short"), (7, "n", None), (None, "o", long), (3, "v", long), (8, "z", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    folder = Scratch(spark).path("archives")
    index = Scratch(spark).table(warc.write_archives(frame, folder), "index")
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        html = [h or "" for p, _, h in rows if p == r.page_id][0]
        assert r.payload_digest == hashlib.sha256(html.encode()).hexdigest() and r.payload_bytes == len(html.encode())
        revisit = html == long and r.page_id != 3
        assert (r.record_type, r.refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == html.encode()
    one = warc.read_records(index.where("page_id = 1"), folder).collect()
    assert [r.page_id for r in one] == [1]
    assert warc.read_records(index.where("false"), folder).count() == 0


def test_ranges_coalesce():
    assert [(a, b) for a, b, _ in warc._ranges([(0, 10), (10, 5), (15 + warc.GAP + 1, 4)])] == [(0, 15), (15 + warc.GAP + 1, 15 + warc.GAP + 5)]


def test_mix_targets_and_takes(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randint(0, 60))), rng.choice(["b", "a", None, "c", "tiny"]) if i % 3 else "a") for i in range(3000)]
    rows += [(1, "same same", "a")] * 5 + [(None, None, None), (None, "\u00a0 x", "tiny")]
    frame = docs(spark, rows)
    out = mixing.mix_sources(frame).collect()
    assert len(out) == len(rows)
    assert sorted((r.doc_id or -1, r.times) for r in out) == sorted((r.doc_id or -1, r.times) for r in mixing.mix_sources(frame.repartition(7)).collect())
    size, total = {}, 0
    for _, t, s in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        size[s], total = size.get(s, 0) + n, total + n
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    open_, target = set(names), {}
    while True:
        left = total - sum(3 * size[s] for s in names if s not in open_)
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            break
        open_ -= over
    target = {s: share[s] if s in open_ else 3 * size[s] for s in names}
    for s in names:
        mine = [r for r in out if r.source == s]
        assert mine[0].source_size == size[s] and abs(mine[0].target - target[s]) < 1e-6 * total
        assert all(0 <= r.times <= 3 for r in mine)
        assert abs(sum(r.times * r.size for r in mine) - target[s]) <= 60
        assert abs(sum(r.times for r in mine) - len(mine) * target[s] / size[s]) <= 3
    assert mixing.mix_sources(frame.limit(0)).count() == 0
