"""The SQL, for DuckDB, that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from lumenark.llm import chat, quality, queries

_RULES = tuple(quality.CUTOFFS)
_GRID = ", ".join(f"('{r}', {i}, {c})" for r, cs in quality.CUTOFFS.items() for i, c in enumerate(cs))
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
wi AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
win AS (SELECT wi.doc_id, wi.i, w[wi.i:wi.i + 4] AS g FROM wi JOIN d USING (doc_id)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 5) t(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, d.stratum, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines FROM d JOIN l USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
s AS (SELECT doc_id, stratum, base_failed, unnest([
        {{'rule': 'symbols', 'x': CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END}},
        {{'rule': 'dup_lines', 'x': CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END}},
        {{'rule': 'repeats', 'x': CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END}},
        {{'rule': 'word_length', 'x': CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END}}]) AS r FROM b),
good AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
grid(rule, i, cutoff) AS (VALUES {_GRID}),
t AS (SELECT s.stratum, grid.rule, grid.i, grid.cutoff, count(*) FILTER (good.good) AS n, count(*) FILTER (good.good AND s.r.x > grid.cutoff) AS k,
        count(*) FILTER (NOT good.good AND s.r.x > grid.cutoff) AS caught
      FROM s JOIN good USING (doc_id) JOIN grid ON grid.rule = s.r.rule WHERE NOT s.base_failed GROUP BY ALL),
p AS (SELECT t.*, (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({quality.RISK / len(_RULES)}) + (n - j) * ln(1 - {quality.RISK / len(_RULES)}))) FROM range(0, k + 1) q(j)) AS p
      FROM t),
ok AS (SELECT *, min(CASE WHEN k <= n * {quality.RISK / len(_RULES)} AND p * (SELECT count(DISTINCT stratum) FROM t) <= {quality.DELTA / len(_RULES)} THEN 1 ELSE 0 END) OVER (PARTITION BY stratum, rule ORDER BY i) AS ok FROM p),
best AS (SELECT stratum, rule, arg_max(cutoff, (caught - k * {quality.COST}) * 100000 + cutoff) AS cutoff FROM ok WHERE ok = 1 AND caught > k * {quality.COST} GROUP BY ALL),
over AS (SELECT DISTINCT s.doc_id FROM s JOIN best ON best.stratum = s.stratum AND best.rule = s.r.rule WHERE s.r.x > best.cutoff)
SELECT b.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND over.doc_id IS NULL AS kept
FROM b LEFT JOIN over ON over.doc_id = b.doc_id
"""

CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{queries.CONFLICT}'), (-1, 1, 'assistant', '{queries.CONFLICT}')),
r AS (SELECT *, CASE WHEN contains(text, '{chat.START}') OR contains(text, '{chat.END}') OR regexp_matches(text, '<\\\\+\\|')
                     THEN regexp_replace(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g') ELSE text END AS body FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role) + length(body) + {len(chat.START) + len(chat.END) + 2})::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
c(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.doc_id, e.b FROM c JOIN e ON e.a = c.reached)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reached)::BIGINT AS component_id, doc_id = min(reached) AS kept FROM c LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

REPEATS = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, w[i:i + 19] AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i) WHERE len(w) >= 20),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
x AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(0, 20) t(k)),
g AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM x GROUP BY doc_id),
k AS (SELECT w.doc_id, string_agg(u.word, ' ' ORDER BY u.i) AS kept FROM w, LATERAL (SELECT unnest(w.w) AS word, unnest(range(1, len(w.w) + 1)) AS i) u LEFT JOIN x ON x.doc_id = w.doc_id AND x.i = u.i WHERE x.i IS NULL GROUP BY w.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SQL = {"op2_quality_rules": QUALITY, "op3_chat_formatting": CHAT, "op8_minhash_near_dedup": NEAR, "op9_substring_dedup": REPEATS}
