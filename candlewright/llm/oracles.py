"""DuckDB SQL for the corpus operators that SQL can express plainly (whole tables; quadratic or worse, for small scales)."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str, lower: bool) -> str:
    text = f"coalesce({text}, '')"
    return f"regexp_extract_all({f"translate({text}, '{_UPPER}', '{_LOWER}')" if lower else text}, '{pattern}')"


_SPACE, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words("text", _ALNUM, True)} AS ws FROM documents),
b AS (SELECT item_id, {_words("text", _ALNUM, True)} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS t FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
k AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_words("text", _SPACE, False)} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS n FROM w) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM r),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d),
s AS (SELECT x.doc_id, count(*) FILTER (g.k IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY x.k) FILTER (g.k IS NULL) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.k = g.k GROUP BY x.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", _SPACE, True)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(3, len(ws)) - 1], ' ') AS t FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, l.v FROM reach JOIN l ON reach.seen = l.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT node, min(seen) AS component_id FROM reach GROUP BY node) m ON d.doc_id = m.node
"""
