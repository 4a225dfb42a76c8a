"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from webframe.llm.quality_rules import SLACK

_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
g AS (SELECT payload, max(page_id) AS top, count(*) AS n FROM p WHERE octet_length(payload) >= 1000 GROUP BY payload)
SELECT p.page_id, octet_length(p.payload) AS payload_bytes, sha1(p.payload) AS payload_digest,
  CASE WHEN g.n > 1 AND p.page_id <> g.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.n > 1 AND p.page_id <> g.top THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.payload = g.payload
"""

_EXACT = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""

#: The quality rules up to their verdict: counts, rates, sketches, fences.
_COUNTS = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS text, lang, source FROM documents),
words AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
win AS (SELECT r, i, word AS a, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM each WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win WHERE c IS NOT NULL) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
c AS (SELECT d.doc_id, d.lang, d.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN words USING (r) JOIN lines USING (r) LEFT JOIN cover USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(n_symbols * 10000 // nullif(word_chars, 0), 0) AS symbol_rate,
    coalesce(n_dup_lines * 10000 // nullif(n_lines, 0), 0) AS line_rate,
    coalesce(n_repeat_words * 10000 // nullif(n_words, 0), 0) AS repeat_rate,
    coalesce(n_bangs * 10000 // nullif(n_words, 0), 0) AS bang_rate,
    coalesce(word_chars * 100 // nullif(n_words, 0), 0) AS length_rate FROM c),
flat AS (UNPIVOT (SELECT lang, source, symbol_rate, line_rate, repeat_rate, bang_rate, length_rate FROM j)
  ON symbol_rate, line_rate, repeat_rate, bang_rate, length_rate INTO NAME rate VALUE v),
b AS (SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket FROM flat),
slack(rate, margin) AS (VALUES {slack}),
"""

_QUALITY = _COUNTS + """
own AS (SELECT lang, source, rate, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3, count(*) AS n FROM b GROUP BY ALL),
whole AS (SELECT rate, quantile_disc(bucket, 0.25) AS q1, quantile_disc(bucket, 0.75) AS q3 FROM b GROUP BY rate),
fence AS (SELECT own.lang, own.source, rate, CAST(CASE WHEN n >= 100 THEN own.q3 + greatest(3 * (own.q3 - own.q1), margin)
    ELSE whole.q3 + greatest(3 * (whole.q3 - whole.q1), margin) END AS BIGINT) AS fence
  FROM own JOIN whole USING (rate) JOIN slack USING (rate)),
f AS (SELECT lang, source, max(fence) FILTER (rate = 'symbol_rate') AS symbols, max(fence) FILTER (rate = 'line_rate') AS lines,
    max(fence) FILTER (rate = 'repeat_rate') AS repeats, max(fence) FILTER (rate = 'bang_rate') AS bangs,
    max(fence) FILTER (rate = 'length_rate') AS lengths FROM fence GROUP BY ALL),
quality AS (SELECT j.*, NOT base_failed AND symbol_rate <= symbols AND line_rate <= lines AND repeat_rate <= repeats
    AND bang_rate <= bangs AND length_rate <= lengths AS kept
  FROM j JOIN f ON j.lang IS NOT DISTINCT FROM f.lang AND j.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM quality
"""

_SEARCH = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest({terms}) AS term FROM documents),
tf AS (SELECT r, doc_id, term, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY r) AS BIGINT) AS n FROM d GROUP BY r, doc_id, term),
whole AS (SELECT count(DISTINCT r) AS n_docs, CAST(sum(tf) AS BIGINT) AS n_terms FROM tf),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY term, n_docs),
q AS (SELECT item, item_id, term, count(*) AS times FROM
  (SELECT row_number() OVER () AS item, item_id, unnest({terms}) AS term FROM benchmark) GROUP BY item, item_id, term),
s AS (SELECT item, item_id, r, doc_id, CAST(sum(times * w *
    ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), whole GROUP BY item, item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""".replace(
    "{terms}",
    r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')",
)

ORACLE = {
    "op1_warc": _WARC,
    "op8_quality_rules": _QUALITY.replace("{slack}", ", ".join(f"('{k}', {v})" for k, v in SLACK.items())),
    "op9_exact_dedup": _EXACT,
    "op11_ranked_search": _SEARCH,
}
