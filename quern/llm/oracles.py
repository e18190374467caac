"""SQL that the driver holds the training-data queries against, where SQL can express them on whole tables.

op1: the tables hold no canonical links or refreshes, so rules decide alone; tests plant links. The other
operators are held against brute force in tests.
"""

from __future__ import annotations

from quern.llm.quality_rules import STOP_WORDS

_SPACE = "[ \\t\\n\\x0B\\f\\r]"
_W = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"
_STOPS = ", ".join("'" + w + "'" for w in sorted(set(STOP_WORDS)))

OP1 = """
WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
  rules(kind, rule_host, prefix) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
  best AS (SELECT page_id, arg_max(rule_host || prefix, length(rule_host || prefix)) AS rule, arg_max(kind, length(rule_host || prefix)) AS kind
    FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, prefix) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(kind, 'allow') AS verdict FROM parts LEFT JOIN best USING (page_id)
"""

OP6 = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_W} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM documents),
  windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)),
  twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
  repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
  c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stops,
      len(list_filter(l, lambda x: regexp_matches(x, '^{_SPACE}*[-*•]{_SPACE}'))) AS n_bullets, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…){_SPACE}*$'))) AS n_ellipses
    FROM t LEFT JOIN repeated r USING (doc_id)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_repeat_words / n_words <= 0.2 AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1 AND n_dup_lines / n_lines <= 0.5
    AND n_bullets / n_lines <= 0.9 AND n_ellipses / n_lines <= 0.3 AND n_stops / n_words >= 0.05 AS kept
FROM b
"""

_TOKENS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP10 = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
  items AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0),
  wins AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
  sizes AS (SELECT DISTINCT n FROM wins),
  places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
  met AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN wins USING (n, win)),
  hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM met) GROUP BY doc_id),
  found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP11 = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
  occ AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS all_c FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
  size AS (SELECT lang, count(*) AS v, sum(all_c) AS all_n FROM kept GROUP BY lang),
  counts AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
  groups AS (SELECT DISTINCT lang, source FROM d),
  own AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL),
  shares AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c, 0) + 5)) // (coalesce(n, 0) + 5 * v)::HUGEINT AS p,
      1 + (1000000000::HUGEINT * (all_c + 5)) // (all_n + 5 * v)::HUGEINT AS q
    FROM groups g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source),
  far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 50
"""

ORACLES = {"op1_redirect_filter": OP1, "op6_quality_rules": OP6, "op10_decontaminate": OP10, "op11_source_divergence": OP11}
