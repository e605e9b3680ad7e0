"""DuckDB SQL for queries that SQL can express: plain definitions by joins, without the operators' methods."""

from __future__ import annotations

from corvid.llm import license_scan, quality

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT k, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT k, i, n, item FROM dw JOIN bw USING (n, g)),
p AS (SELECT k, count(*) AS c FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS pos FROM h) GROUP BY k),
t AS (SELECT k, count(*) AS c, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(p.c, 0)::BIGINT AS n_hit, coalesce(t.c, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, p.c IS NOT NULL AS contaminated
FROM d LEFT JOIN p ON d.k = p.k LEFT JOIN t ON d.k = t.k
"""

LINE_DEDUP = f"""
WITH x AS (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
y AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS k, doc_id, line_no, regexp_extract_all(line, {_WORD}) AS w FROM x WHERE regexp_matches(line, {_WORD})),
n AS (SELECT k, list_distinct(w) AS u, len(list_distinct(w)) AS n FROM y),
t AS (SELECT k, n, unnest(u) AS g FROM n),
p AS (SELECT a.k AS ka, b.k AS kb, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.k < b.k AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80 GROUP BY ALL),
r AS (SELECT DISTINCT kb AS k FROM p JOIN n na ON na.k = ka JOIN n nb ON nb.k = kb WHERE c * 100 >= 80 * (na.n + nb.n - c)),
g AS (SELECT doc_id, count(*) AS total, count(r.k) AS gone, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (r.k IS NOT NULL) AS removed FROM y LEFT JOIN r ON y.k = r.k GROUP BY doc_id)
SELECT d.doc_id, coalesce(total, 0)::BIGINT AS n_lines, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""

NEAR_DUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
t AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE c * 100 >= 85 * (na.n + nb.n - c)),
r(doc_id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.x = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(x) AS component_id, min(x) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM h),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
k AS (SELECT u.doc_id, count(c.pos) AS gone, string_agg(word, ' ' ORDER BY u.pos) FILTER (c.pos IS NULL) AS kept FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.pos = c.pos GROUP BY u.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": DECONTAMINATE,
        "op3_line_dedup": LINE_DEDUP,
        "op5_near_dup": NEAR_DUP,
        "op6_license_scan": license_scan.ORACLE,
        "op8_quality": quality.ORACLE,
        "op9_substring_dedup": SUBSTRING_DEDUP,
    }
