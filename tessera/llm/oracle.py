"""SQL that gives the rows of those operators that SQL can express."""

_WORD = r"[^\x20\x09-\x0D]+"

REPEATED_PHRASES = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(counts.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN counts USING (doc_id)
"""

QUALITY_RULES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT doc_id, k FROM windows GROUP BY doc_id, k HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM windows SEMI JOIN again USING (doc_id, k)) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_chars, length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower_chars
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM d) d LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 100 * n_dup_lines > 40 * n_lines OR upper_chars > lower_chars OR word_chars > 15 * n_words OR word_chars < 2 * n_words) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
"""

#: All alignments that share four words in a row: 13 words with 2 changed always do.
DECONTAMINATION = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) >= 8),
d AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM dw),
i AS (SELECT item_id, n, unnest(range(1, n + 1)) AS q, unnest(w) AS x FROM iw),
d4 AS (SELECT doc_id, p, array_to_string(w[p:p + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS p FROM dw WHERE len(w) >= 4)),
i4 AS (SELECT item_id, q, array_to_string(w[q:q + 3], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, n - 2)) AS q FROM iw)),
aligned AS (SELECT DISTINCT doc_id, item_id, p - q AS shift FROM d4 JOIN i4 USING (k)),
pairs AS (SELECT a.doc_id, a.item_id, a.shift, i.n, i.q, CAST(d.x = i.x AS INTEGER) AS same FROM aligned a JOIN i USING (item_id) JOIN d ON d.doc_id = a.doc_id AND d.p = i.q + a.shift),
sums AS (SELECT doc_id, item_id, n, sum(same) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS s, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS c FROM pairs),
sw AS (SELECT item_id, w FROM (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) BETWEEN 1 AND 7),
short AS (SELECT doc_id, list(DISTINCT item_id ORDER BY item_id) AS short_ids FROM dw JOIN sw ON contains(' ' || array_to_string(dw.w, ' ') || ' ', ' ' || array_to_string(sw.w, ' ') || ' ') GROUP BY doc_id),
links AS (SELECT doc_id, item_id, max(s) AS matched FROM sums WHERE c = least(13, n) AND s >= CASE WHEN n >= 13 THEN 11 ELSE n END GROUP BY doc_id, item_id),
found AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids, CAST(max(matched) AS BIGINT) AS matched FROM links GROUP BY doc_id)
SELECT documents.doc_id, matched IS NOT NULL AS contaminated, CAST(coalesce(len(item_ids), 0) AS BIGINT) AS n_items, coalesce(item_ids, []) AS item_ids, matched,
  coalesce(short_ids, []) AS short_item_ids
FROM documents LEFT JOIN found USING (doc_id) LEFT JOIN short USING (doc_id)
"""
