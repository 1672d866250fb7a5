"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

RULE_LEDGER = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM documents),
 g AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 7]) AS n FROM g) WHERE n > 1),
 c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range(8)) AS j) GROUP BY doc_id),
 m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
   coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines, len(regexp_extract_all(x, '[A-Z]')) AS n_upper, len(regexp_extract_all(x, '[A-Za-z]')) AS n_letters, len(regexp_extract_all(x, '!')) AS n_bangs
   FROM w LEFT JOIN c USING (doc_id)),
 f AS (SELECT *, (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 25 * n_words)::INT + 8 * (100 * n_upper > 50 * n_letters)::INT
   + 16 * (100 * n_bangs > 25 * n_words)::INT + 32 * (100 * n_dup_lines > 50 * n_lines)::INT + 64 * (word_chars > 40 * n_words)::INT AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f
"""

RULE_ABLATION = f"""
SELECT rule, count(*) FILTER (WHERE failures & bit <> 0) AS fails, count(*) FILTER (WHERE failures = bit) AS only_by_it FROM ({RULE_LEDGER}),
 (VALUES ('short', 1), ('repeats', 2), ('symbols', 4), ('capitals', 8), ('bangs', 16), ('dup_lines', 32), ('long_words', 64)) r(rule, bit) GROUP BY rule
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(g, ' ') AS g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS g FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
 reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(reach.b) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
"""

MINHASH = f"SELECT *, doc_id = component_id AS kept FROM ({NGRAM_JOIN.replace('100 * k >= 90', '100 * k >= 85')})"

SUBSTRING_DEDUP = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
 g AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
 r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g) WHERE first < doc_id),
 c AS (SELECT DISTINCT doc_id, i + j AS k FROM r, (SELECT unnest(range(50)) AS j)),
 k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
 o AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.k) AS kept, count(*) AS n FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.k = k.k WHERE c.k IS NULL GROUP BY k.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN o USING (doc_id)
"""


def _lloyd(rounds: int = 10) -> str:
    steps = [
        """WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
 e AS MATERIALIZED (SELECT r, unnest(v) AS x, unnest(range(64)) AS p FROM kept),
 s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS k, v FROM kept WHERE vec_id IS NOT NULL QUALIFY k < 8),
 c0 AS MATERIALIZED (SELECT k, unnest(v) AS x, unnest(range(64)) AS p FROM s)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS MATERIALIZED (SELECT r, k, d FROM (SELECT r, k, sum((e.x - c.x) * (e.x - c.x))::HUGEINT AS d FROM e JOIN c{n} c USING (p) GROUP BY r, k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)""")
        if n < rounds:
            steps.append(f"""m{n} AS (SELECT k, p, sum(x)::HUGEINT AS t, count(*) AS n FROM d{n} JOIN e USING (r) GROUP BY k, p),
 c{n + 1} AS MATERIALIZED (SELECT c.k, c.p, coalesce((t - ((t % n) + n) % n) // n, c.x)::BIGINT AS x FROM c{n} c LEFT JOIN m{n} m ON m.k = c.k AND m.p = c.p)""")
    return ",\n ".join(steps) + f"""
SELECT vec_id, d.k::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY d.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
 FROM d{rounds} d JOIN kept USING (r) JOIN (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY p)) AS h FROM c{rounds} GROUP BY k) USING (k)"""


LLOYD = _lloyd()
