"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .chat import CLOSE, HARD, OPEN
from .quality import RULES, STOP_WORDS

WORD_SPLIT = r"[\x20\x09-\x0D]+"


def quality() -> str:
    """Words, windows and lines by lists; a window counts where its text is found twice."""
    stop = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    metric = {
        "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "stop_words": f"len(list_distinct(list_filter(w, lambda x: x IN ({stop}))))",
        "dup_line_share": "n_dup_lines / n_lines", "bullet_line_share": "len(list_filter(lines, lambda x: regexp_matches(ltrim(x, ' '), '^[-*•] '))) / n_lines",
        "ellipsis_line_share": "len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) / n_lines",
        "exclaimed_word_share": "(length(t) - length(replace(t, '!!', ''))) / 2 / n_words", "pipe_word_share": "(length(t) - length(replace(t, '|', ''))) / n_words",
        "letter_share": r"length(regexp_replace(t, '\P{L}+', '', 'g')) / word_chars",
    }
    bad = []
    for rule in RULES:
        value = f"coalesce({metric[rule.metric]}, 0)"
        bad += [f"{value} < {rule.low}"] if rule.low is not None else []
        bad += [f"{value} > {rule.high}"] if rule.high is not None else []
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{WORD_SPLIT}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
m AS (
  SELECT doc_id, t, w, lines, len(lines) AS n_lines, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ({" OR ".join(bad)}) AS kept
FROM m"""


def chat() -> str:
    rows = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in HARD)
    extra = lambda c: rf"len(regexp_extract_all({c}, '<\\*\|'))"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES {rows}) AS v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(CLOSE) + 2} + length(role) + length(text) + {extra("role")} + {extra("text")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


HTML = r"""
WITH b AS (
  SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1), '</?(?:p|h1|br)>')) AS raw, generate_subscripts(regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1), '</?(?:p|h1|br)>'), 1) AS k
  FROM pages),
t AS (
  SELECT page_id, url, k, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(raw, '<[^>]+>', '', 'g'), '&nbsp;?', chr(160), 'g'), '&#x27;', chr(39)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\s\x{A0}]+', ' ', 'g')) AS block FROM b),
j AS (SELECT page_id, string_agg(block, chr(10) ORDER BY k) FILTER (block <> '') AS text FROM t GROUP BY page_id)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM pages LEFT JOIN j USING (page_id)"""

WARC = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, sha1(h) AS s FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 5 * (k // 4) + 1, 5))::BIGINT >> (15 - 5 * (k % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM d"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{WORD_SPLIT}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS win FROM p),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN k USING (doc_id)"""


#: Components by the smallest document that can be reached.
MINHASH = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_SPLIT}'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, min(doc_id) OVER (PARTITION BY md5(string_agg(s, chr(10) ORDER BY s))) AS class_id FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(node, reached) AS (SELECT DISTINCT a, a FROM e UNION SELECT node, b FROM r JOIN e ON e.a = reached),
c AS (SELECT node, min(reached) AS component FROM r GROUP BY node),
f AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(class_id, doc_id) AS class_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept, class_id FROM f"""


def all_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality(), "op5_chat": chat(), "op6_html": HTML, "op7_warc": WARC, "op9_substrings": SUBSTRINGS, "op10_minhash": MINHASH}
