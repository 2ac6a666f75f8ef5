"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

# 52 bits of an MD5 as a number in [0, 1), the same draw as in mixing.uniform.
_U = "CAST(CAST('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || {j}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"

MIXING = (
    "WITH RECURSIVE have AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), {exponent}) AS weight FROM documents GROUP BY source),"
    " rates AS (SELECT source, weight / sum(weight) OVER () * sum(n) OVER () / n AS rate FROM have),"
    " means AS (SELECT source, rate, CAST(floor(rate / {part}) AS INTEGER) AS whole FROM rates),"
    " steps(mean, k, p, c) AS (SELECT mean, 0, exp(-mean), exp(-mean) FROM (SELECT DISTINCT rate - whole * {part} AS mean FROM means UNION SELECT {part})"
    "   UNION ALL SELECT mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k < {steps}),"
    " draws AS (SELECT doc_id, d.source, j, CASE WHEN j = 0 THEN rate - whole * {part} ELSE {part} END AS mean, "
    + _U.replace("{j}", "j")
    + " AS u FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source, unnest(range(0, whole + 1)) x(j)),"
    " counts AS (SELECT doc_id, source, CAST(sum(k) AS BIGINT) AS n FROM (SELECT doc_id, d.source, j, (SELECT count(*) FROM steps s WHERE s.mean = d.mean AND s.c <= d.u) AS k"
    "   FROM draws d) GROUP BY doc_id, source)"
    " SELECT doc_id, source, copy FROM counts, unnest(range(1, n + 1)) y(copy)"
)

_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    " '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

LEAKS = (
    f"WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),"
    " win AS (SELECT DISTINCT item_id, w[i:least(i + 9, len(w))] AS run FROM item, unnest(range(1, greatest(1, len(w) - 9) + 1)) x(i) WHERE len(w) > 0),"
    f" doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),"
    " lens AS (SELECT DISTINCT len(run) AS n FROM win),"
    " spot AS (SELECT doc_id, i, n, w[i:i + n - 1] AS run FROM doc, lens, unnest(range(1, len(w) - n + 2)) x(i)),"
    " hit AS (SELECT doc_id, i, n, item_id FROM spot JOIN win USING (run)),"
    " words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) y(p) GROUP BY doc_id),"
    " items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS names FROM hit GROUP BY doc_id)"
    " SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,"
    " sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"
)

# CRC-32 of the decimal digits of conv_id, bit by bit.
_CRC = (
    "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b:"
    " list_reduce([CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)) , CAST(4294967295 AS BIGINT)), 4294967295)"
)

PREFIX_TRIE = (
    "WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS s"
    " FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),"
    f" lead AS (SELECT conv_id, s, {_CRC} % 6 AS h FROM own),"
    " conv AS (SELECT l.conv_id, list_concat(coalesce(d.s, [])[1:h], l.s[h + 1:]) AS s FROM lead l LEFT JOIN own d ON d.conv_id = l.conv_id - l.conv_id % 100),"
    " pre AS (SELECT conv_id, d, s[1:d] AS p, len(s) AS n FROM conv, unnest(range(0, len(s) + 1)) x(d)),"
    " node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs,"
    "   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM pre GROUP BY d, p),"
    " kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2),"
    " full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(p[d].text) END AS saved"
    "   FROM node LEFT JOIN kids USING (d, p)),"
    " below AS (SELECT u AS d, p[1:u] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens"
    "   FROM full_node, unnest(range(0, d + 1)) x(u) GROUP BY 1, 2)"
    " SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,"
    " CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256"
    " FROM full_node n JOIN below b ON n.d = b.d AND n.p = b.p LEFT JOIN full_node up ON n.d = up.d + 1 AND up.p = n.p[1:n.d - 1]"
)
