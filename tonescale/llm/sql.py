"""DuckDB SQL for the queries of this package that SQL can express."""

from tonescale.llm import licenses

QUALITY = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
    FROM documents),
wins AS (
    SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
    FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM cut WHERE len(w) > 8)),
twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
          FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
again AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM twice GROUP BY doc_id),
m AS (
    SELECT cut.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
           (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
           len(regexp_extract_all(array_to_string(w, ''), '[0-9]'))::BIGINT AS n_digits
    FROM cut LEFT JOIN again USING (doc_id)),
b AS (
    SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
             + CASE WHEN 2 * n_dup_lines > n_lines THEN 4 ELSE 0 END + CASE WHEN n_symbols > n_words THEN 8 ELSE 0 END
             + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words) THEN 16 ELSE 0 END
             + CASE WHEN 2 * n_digits > word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits
    FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits
FROM b
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, list_filter(string_split_regex(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS win, least(13, len(w)) AS n
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS listed FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_NEAREST = """SELECT vec_id, part, x, unnest(min({{'d': (x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 + (x[4] - y[4]) ** 2, 'e': entry}}))
       FROM p JOIN {0} USING (part) GROUP BY vec_id, part, x"""

_MEANS = """SELECT {1}.part, {1}.entry, CASE WHEN n IS NULL THEN y ELSE [floor(s1 / n)::BIGINT, floor(s2 / n)::BIGINT, floor(s3 / n)::BIGINT, floor(s4 / n)::BIGINT] END AS y
       FROM {1} LEFT JOIN (SELECT part, e AS entry, count(*) AS n, sum(x[1]) AS s1, sum(x[2]) AS s2, sum(x[3]) AS s3, sum(x[4]) AS s4
                           FROM {0} GROUP BY part, e) USING (part, entry)"""

#: For vectors of 64 components with ids of their own.
VECTOR_CODES = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, k AS part, v[4 * k + 1:4 * k + 4] AS x FROM v, range(16) t(k)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v ORDER BY vec_id LIMIT 64),
b0 AS (SELECT part, entry, x AS y FROM p JOIN first USING (vec_id)),
a0 AS MATERIALIZED ({_NEAREST.format("b0")}),
b1 AS ({_MEANS.format("a0", "b0")}),
a1 AS MATERIALIZED ({_NEAREST.format("b1")}),
b2 AS ({_MEANS.format("a1", "b1")}),
a2 AS MATERIALIZED ({_NEAREST.format("b2")}),
books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2),
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM codes JOIN v USING (vec_id), books
"""

ORACLES: dict[str, str] = {"op6_decontamination": DECONTAMINATION, "op7_quality": QUALITY, "op9_licenses": licenses.oracle_sql(), "op11_vector_codes": VECTOR_CODES}
