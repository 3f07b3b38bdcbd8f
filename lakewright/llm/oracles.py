"""DuckDB's SQL for the queries of this subpackage that SQL can express, written apart from the operators' own expressions."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, LOSS_PERCENT, MARKS_PER_100, MENU, MIN_WORDS, REPEAT_PERCENT

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array({{}}, '{_SPACE}'), lambda x: x <> '')"
_ANY = "(?:" + "|".join(MENU) + ")"

# Each 5-word window of a document by its place; the words of those found twice.
OP2 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
     lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
     worded AS (SELECT doc_id, l, lower(l) AS low, {_WORDS.format("l")} AS lw FROM lines),
     judged AS (
       SELECT doc_id, l, len(lw) AS n, len(lw) > 0 AND (
                regexp_matches(low, '{"|".join(BOILERPLATE)}')
                OR len(lw) <= 12 AND regexp_matches(low, '^[\\s|>»·-]*{_ANY}(?:[\\s|>»·,-]+{_ANY})*[\\s|>»·.-]*$')
                OR 5 * len(regexp_extract_all(l, '[|»›·•]')) >= len(lw) AND len(regexp_extract_all(l, '[|»›·•]')) >= 2
                OR len(lw) >= 3 AND 100 * len(regexp_extract_all(l, '[#*$%&|<>]+|[!?]{{2,}}|[~^=_]{{3,}}')) >= {MARKS_PER_100} * len(lw)
                OR len(lw) >= 5 AND l = upper(l) AND l <> low
                OR len(lw) >= 8 AND 5 * len(list_distinct(lw)) < len(lw)) AS failed
       FROM worded),
     by_doc AS (SELECT doc_id, sum(CASE WHEN failed THEN n ELSE 0 END) AS lost, count(*) FILTER (WHERE failed) AS failed_lines,
                       count(*) FILTER (WHERE n > 0) - count(DISTINCT CASE WHEN n > 0 THEN l END) AS dup FROM judged GROUP BY doc_id),
     windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
     twice AS (SELECT doc_id, v FROM windows GROUP BY doc_id, v HAVING count(*) > 1),
     covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM windows JOIN twice USING (doc_id, v), (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
     counted AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
                        CAST(lost AS BIGINT) AS lost_words, CAST(failed_lines AS INTEGER) AS failed_lines FROM d JOIN by_doc USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * lost_words <= {LOSS_PERCENT} * n_words AS kept, lost_words, failed_lines
FROM counted
"""

# Archives are written in the order of nothing in particular, so SQL can say what the records must be.
OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     f AS (SELECT payload_digest, min(page_id) AS smallest FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, CAST(p.payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN f.smallest < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.smallest < p.page_id THEN f.smallest END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""

# What is left after all three batches: the first document of each text, without its repeated lines.
WORD_ROLLUP = f"""
WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
     one AS (SELECT t, min(doc_id) AS doc_id FROM d GROUP BY t),
     revised AS (SELECT d.source, d.lang, (SELECT coalesce(sum(len({_WORDS.format("l")})), 0) FROM (SELECT unnest(list_distinct(string_split(d.t, chr(10)))) AS l)) AS n FROM d JOIN one USING (t, doc_id))
SELECT source, lang, 'words/1' AS tokenizer, count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens FROM revised GROUP BY source, lang
"""

# The contract's patterns of the base kinds, in their order.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_DOUBLED = "CAST(substr(reverse(digits), CAST(i + 1 AS BIGINT), 1) AS INTEGER) * (1 + i % 2)"
PII_BASE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     found AS ({" UNION ALL ".join(f"SELECT doc_id, {o} AS o, '{k}' AS kind, unnest(regexp_extract_all(t, '{p}')) AS v, generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS k, regexp_split_to_array(t, '{p}') AS g FROM d" for o, (k, p) in enumerate(_BASE.items()))}),
     placed AS (SELECT doc_id, o, kind, v, {_DIGITS} AS digits, sum(length(g[k]) + length(v)) OVER (PARTITION BY doc_id, o ORDER BY k) AS stop FROM found),
     valid AS (SELECT doc_id, o, kind, CAST(stop - length(v) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE CASE kind
         WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(x, '0'), '') AS INTEGER), 0) <= 255))
         WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(digits)), lambda i: ({_DOUBLED}) // 10 + ({_DOUBLED}) % 10)) % 10 = 0
         WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
     listed AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS s, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _BASE)} FROM valid GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in _BASE)}, sha256(coalesce(s, '')) AS base_sha256 FROM d LEFT JOIN listed USING (doc_id)
"""
