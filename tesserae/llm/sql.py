"""DuckDB equivalents of the subpackage's queries, where SQL can express them on whole tables."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op1_chat_snapshots": """
WITH t AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), u AS (
  SELECT conv_id, turn, list({'r': role, 'x': text} ORDER BY role, text) AS l FROM t GROUP BY conv_id, turn
), c AS (
  SELECT conv_id, list({'t': turn, 'l': l} ORDER BY turn) AS l, sum(len(l))::BIGINT AS n_turns FROM u GROUP BY conv_id
), kept AS (
  SELECT conv_id, n_turns FROM c WHERE NOT EXISTS (
    SELECT 1 FROM c AS d WHERE d.l[1] = c.l[1]
      AND ((len(d.l) > len(c.l) AND d.l[1:len(c.l)] = c.l) OR (d.l = c.l AND d.conv_id < c.conv_id)))
)
SELECT conv_id, turn, n_turns, concat('<|im_start|>', role, chr(10), text, '<|im_end|>', chr(10)) AS rendered
FROM t JOIN kept USING (conv_id)
""",
    "op2_host_rules": f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), g AS (
  SELECT r, i, w[i:i+2] AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)
), twice AS (
  SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), covered AS (
  SELECT r, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), m AS (
  SELECT w.r, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM w LEFT JOIN lines ON lines.r = w.r LEFT JOIN covered ON covered.r = w.r
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS failed FROM f GROUP BY source
), p AS (
  SELECT count(*) AS k, sum(n) AS total, sum(failed) / sum(n) AS m, sum(failed * failed / n) AS ff, sum((n * n)::DOUBLE) AS nn FROM h
), e AS (
  SELECT m, total, CASE WHEN m > 0 AND m < 1 AND total - nn / total - (k - 1) > 1e-9
    THEN ((ff - m * m * total) / (m * (1 - m)) - (k - 1)) / (total - nn / total - (k - 1)) END AS r FROM p
), s AS (
  SELECT m, greatest(CASE WHEN r > 1 / (total + 1) THEN 1 / r - 1 ELSE total::DOUBLE END, 0) AS k FROM e
), bad AS (
  SELECT source, (failed + m * k) / (n + k) > 0.5 AS bad FROM h, s
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
""",
    "op5_warc_round_trip": """
SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, b32 AS payload_digest,
  CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM (
  SELECT page_id, html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS lead, sha1(coalesce(html, '')) AS hex,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (('0x' || substr(sha1(coalesce(html, '')) || '00', ((i * 5) // 8) * 2 + 1, 4))::INT >> (11 - (i * 5) % 8) & 31) + 1, 1)), '') AS b32
  FROM pages
)
""",
    "op11_filter_audit": f"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents
), m AS (
  SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask FROM w
), g AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m
  LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) USING (doc_id) GROUP BY ALL
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT concat(a.c, b.c, c.c, d.c, e.c) AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS bit,
    list_sum([1 << (ascii(x) - 65) FOR x IN string_split(filter_order[1:step - 1], '') IF x <> '']) AS gone
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), r AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (coalesce(gone, 0) | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(gone, 0) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(gone, 0) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(gone, 0) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & coalesce(gone, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, s GROUP BY ALL
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
""",
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, x: list_reduce(range(0, 8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, x)), 4294967295), 4294967295) % 6 AS h FROM t
), k AS (
  SELECT h.conv_id, h, coalesce(least(h, n), 0) AS n_head, base FROM h LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY ALL) USING (base)
), r AS (
  SELECT conv_id, n_head + pos - h AS d, role, text FROM t JOIN k USING (conv_id) WHERE pos > h
  UNION ALL SELECT k.conv_id, pos AS d, role, text FROM k JOIN t ON t.conv_id = base WHERE pos <= n_head
), l AS (
  SELECT conv_id, coalesce(list({'r': role, 'x': text} ORDER BY d) FILTER (d IS NOT NULL), []) AS l FROM h LEFT JOIN r USING (conv_id) GROUP BY conv_id
), p AS (
  SELECT conv_id, d, l[1:d] AS s, d = len(l) AS ends FROM l, LATERAL (SELECT unnest(range(0, len(l) + 1)) AS d)
), n AS (
  SELECT d, s, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ids FROM p GROUP BY d, s
), e AS (
  SELECT n.*, up.conv_id AS up FROM n LEFT JOIN n AS up ON up.d = n.d - 1 AND up.s = n.s[1:n.d - 1]
), c AS (
  SELECT n.d, n.s, count(e.d) AS n_children FROM n LEFT JOIN e ON e.d = n.d + 1 AND e.s[1:n.d] = n.s GROUP BY ALL
), x AS (
  SELECT a.d, a.s, sum((b.n_convs - 1) * coalesce(length(b.s[b.d].x), 0)) AS saved, count(*) FILTER (c.n_children = 0) AS n_leaves
  FROM n AS a JOIN n AS b ON b.d >= a.d AND b.s[1:a.d] = a.s JOIN c ON c.d = b.d AND c.s = b.s GROUP BY ALL
)
SELECT e.conv_id, e.d::BIGINT AS depth, up AS parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM e JOIN c ON c.d = e.d AND c.s = e.s JOIN x ON x.d = e.d AND x.s = e.s
""",
}
