"""DuckDB SQL that gives the same rows as the registered queries."""

from __future__ import annotations

from markloom.llm.quality import STOP_WORDS, THRESHOLDS

_SPACE = r"[\x20\x09-\x0D]+"
_WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rules() -> str:
    """CASE expressions of the threshold table, as a comma-joined list of broken rules."""
    parts = []
    for r in THRESHOLDS:
        bad = [f"{r.metric} < {r.low!r}"] * (r.low is not None) + [f"{r.metric} > {r.high!r}"] * (r.high is not None)
        parts.append(f"CASE WHEN n_words >= {r.min_words} AND ({' OR '.join(bad)}) THEN '{r.name}' END")
    return f"concat_ws(',', {', '.join(parts)})"


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))

OP1 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         [l FOR l IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS ls
  FROM documents
), win AS (
  SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, unnest(range(i, i + 5)) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM twice GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         len(ls) AS n_lines,
         len([x FOR x IN w IF lower(x) IN ({_STOPS})]) AS n_stop_words
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rules()} = '' AS kept, {_rules()} AS broken
FROM r
"""

OP10 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""

OP3 = rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later
), words AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.p) AS body, count(*) AS n
  FROM words ANTI JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP6 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), least AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN least ON least.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

#: The quotations that the query writes by rule, the hash-free join of their units to those of earlier messages, and the reply order by paths.
_UNITS = r"""
SELECT conv_id, turn, no, level, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS unit, true AS whole FROM {0}
UNION SELECT conv_id, turn, no, level, unit, false FROM (
  WITH b AS (SELECT conv_id, turn, no, level, trim(regexp_replace(lower(unnest(list_concat(string_split_regex(text, '\n\s*\n'), string_split(text, chr(10))))), '\s+', ' ', 'g')) AS block FROM {0})
  SELECT conv_id, turn, no, level, block AS unit FROM b
  UNION SELECT conv_id, turn, no, level, trim(unnest(string_split(regexp_replace(block, '([.!?…]["'')\]”’]?) +', '\1' || chr(1), 'g'), chr(1)))) FROM b)
"""

OP2 = rf"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS own_text, coalesce(text, '') AS text FROM conversations
), q AS (
  SELECT m.conv_id, m.turn, m.turn - p.turn AS no, CASE m.turn % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 - (m.turn - p.turn) ELSE 3 END AS level, p.text
  FROM m JOIN m p ON p.conv_id = m.conv_id AND ((m.turn % 4 = 1 AND p.turn = m.turn - 1) OR (m.turn % 4 = 2 AND p.turn IN (m.turn - 1, m.turn - 2)) OR (m.turn % 4 = 3 AND p.turn = m.turn - 2))
), o AS (
  SELECT conv_id, turn, 0 AS no, 0 AS level, own_text AS text FROM m
), keys AS (
  SELECT conv_id, turn, no, level, unit FROM ({_UNITS.format("q")}) WHERE length(unit) >= CASE WHEN whole THEN 1 ELSE 12 END
), origins AS (
  SELECT conv_id, unit, min(turn) AS origin FROM ({_UNITS.format("o")}) WHERE length(unit) > 0 GROUP BY conv_id, unit
), met AS (
  SELECT keys.*, origin FROM keys JOIN origins USING (conv_id, unit) WHERE origin < turn
), links AS (
  SELECT conv_id, turn, arg_max(origin, -level * 1000000 + origin) AS parent_turn, count(DISTINCT no) AS n_linked FROM met GROUP BY conv_id, turn
), tree(conv_id, turn, parent_turn, n_linked, root_turn, path) AS (
  SELECT m.conv_id, m.turn, -1::BIGINT, 0::BIGINT, m.turn, [m.turn] FROM (SELECT DISTINCT conv_id, turn FROM m) m ANTI JOIN links USING (conv_id, turn)
  UNION ALL SELECT links.conv_id, links.turn, links.parent_turn, links.n_linked, tree.root_turn, list_append(tree.path, links.turn)
  FROM links JOIN tree ON tree.conv_id = links.conv_id AND tree.turn = links.parent_turn
), n AS (
  SELECT conv_id, turn, count(*) AS n_quotes FROM q GROUP BY conv_id, turn
)
SELECT m.conv_id, row_number() OVER (PARTITION BY m.conv_id ORDER BY root_turn, path, role, own_text) - 1 AS position, m.turn, role, own_text, coalesce(n_quotes, 0)::BIGINT AS n_quotes, n_linked::BIGINT AS n_linked,
       parent_turn::BIGINT AS parent_turn, root_turn, '<|' || role || '|>' || chr(10) || own_text || chr(10) || '<|end|>' AS formatted
FROM m JOIN tree USING (conv_id, turn) LEFT JOIN n USING (conv_id, turn)
"""

def _notices() -> str:
    from markloom.llm.licenses import TEMPLATES

    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({quoted(name)}, {quoted(text)})" for name, text in TEMPLATES if "<" not in text)


#: Notices that are there word by word have no differences, so they can be found by their text; of several in a line,
#: as 'All rights reserved.' in a longer one, the longest counts. Changed notices are left to the tests.
OP9 = rf"""
WITH t(name, notice) AS (
  VALUES {_notices()}
), l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents
), f AS (
  SELECT doc_id, k, arg_max(name, length(notice)) AS name FROM l JOIN t ON contains(line, notice) GROUP BY doc_id, k
), g AS (
  SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, string_agg(k::VARCHAR, ',' ORDER BY k) AS lines FROM f GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_notices, coalesce(licenses, '') AS licenses, coalesce(lines, '') AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_exact
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""

SQL: dict[str, str] = {
    "op2_quotation_links": OP2,
    "op9_license_scan": OP9,
    "op1_quality_rules": OP1,
    "op3_substring_dedup": OP3,
    "op6_minhash_near_dedup": OP6,
    "op10_exact_dedup": OP10,
}
