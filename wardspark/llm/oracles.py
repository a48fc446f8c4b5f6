"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from wardspark.llm.licences import LEAST, TEMPLATES
from wardspark.llm.quality_rules import BASE, RULES

GAP = r"\x20\x09-\x0D"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _any(rules: list[str]) -> str:
    return " OR ".join(f"({RULES[r]})" for r in rules)


QUALITY_RULES = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^{GAP}]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
                lambda x: regexp_matches(x, '[^{GAP}]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, [words[i], words[i + 1], words[i + 2]] AS g
  FROM w, unnest(range(1, len(words) - 1)) u(i)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN p ON p.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  ({_any(BASE)}) AS base_failed, NOT ({_any(list(RULES))}) AS kept
FROM m
"""

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
w AS (
  SELECT DISTINCT item_id, words[s:s + 9] AS g
  FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) u(s) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT len(g) AS n FROM w),
places AS (
  SELECT doc_id, s, n, words[s:s + n - 1] AS g
  FROM d, sizes, unnest(range(1, len(words) - n + 2)) u(s) WHERE len(words) >= n),
hits AS (SELECT doc_id, s, n, item_id FROM places JOIN w USING (g)),
hit_words AS (
  SELECT doc_id, count(DISTINCT s + k) AS n_hit
  FROM hits, unnest(range(0, n)) u(k) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_TEMPLATES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in row))
                       for row in TEMPLATES.items())


def _bigrams(words: str) -> str:
    return (f"list_distinct(list_transform(list_zip({words}[:-2], {words}[2:]), "
            f"lambda x: x[1] || ' ' || x[2]))")


LICENCES = rf"""
WITH t AS (
  SELECT template, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS words
  FROM (VALUES {_TEMPLATES}) v(template, text)),
tb AS (SELECT template, len({_bigrams('words')}) AS n_t, unnest({_bigrams('words')}) AS g FROM t),
l AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS lines
      FROM documents),
u AS (
  SELECT doc_id, generate_subscripts(lines, 1) - 1 AS unit, unnest(lines) AS part FROM l
  UNION ALL SELECT doc_id, -1, t FROM l WHERE len(lines) > 1),
uw AS (SELECT doc_id, unit, regexp_extract_all(lower(part), '[\p{{L}}\p{{N}}]+') AS words FROM u),
ul AS (SELECT doc_id, unit, {_bigrams('words')} AS b FROM uw),
ub AS (SELECT doc_id, unit, len(b) AS n_u, unnest(b) AS g FROM ul),
s AS (
  SELECT doc_id, unit, template, 2 * count(*) / (n_u + n_t) AS score
  FROM ub JOIN tb USING (g) GROUP BY doc_id, unit, template, n_u, n_t
  HAVING 2 * count(*) / (n_u + n_t) >= {LEAST}),
best AS (
  SELECT doc_id, template, unit, score,
    row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template, unit) AS k FROM s),
named AS (SELECT doc_id, string_agg(template, ',' ORDER BY template) AS licences
          FROM (SELECT DISTINCT doc_id, template FROM s) GROUP BY doc_id)
SELECT doc_id, template AS licence, unit, round(coalesce(score, 0), 6) AS score,
  coalesce(licences, '') AS licences
FROM l LEFT JOIN (FROM best WHERE k = 1) USING (doc_id) LEFT JOIN named USING (doc_id)
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS body,
    length(replace(regexp_replace(role, '([<\[\\])', '\1\\', 'g'), chr(10), '[n')) AS head FROM c),
a AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learned,
    sum(8 + head + 1 + body + 8)::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
  formatted_chars FROM a
"""

# CRC-32 of ASCII strings: a table of 256 values, then one look-up a byte.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs
  FROM range(256) r(i))"""


def _crc(text: str) -> str:
    """``crcs`` of the table must be a column beside it."""
    return (f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), "
            "lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)")


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})"


def _climb(name: str, start: str, group: str) -> str:
    """Nodes by level, and ``name_sides`` with the siblings of each."""
    return f"""{name} AS (
  {start}
  UNION ALL
  SELECT lvl + 1, {group}, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), NULL
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {name}) WHERE n > 1
  GROUP BY lvl, {group}, pos // 3),
{name}_sides AS (
  SELECT a.lvl, a.{group}, a.pos,
    coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.lvl = b.lvl AND a.{group} IS NOT DISTINCT FROM b.{group} AND a.pos // 3 = b.pos // 3
  WHERE a.lvl < (SELECT max(c.lvl) FROM {name} c WHERE c.{group} IS NOT DISTINCT FROM a.{group})
  GROUP BY a.lvl, a.{group}, a.pos)"""


MANIFEST = f"""
WITH RECURSIVE {CRC_TABLE},
docs AS (SELECT *, {_leaf('text')} AS leaf,
  CASE WHEN {_crc("coalesce(doc_id::VARCHAR, '')")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")}
    ELSE {_leaf('text')} END AS shown FROM documents, crc_table),
leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
{_climb('tree', "SELECT 0 AS lvl, source, pos, leaf AS d, NULL AS x FROM leaves", 'source')},
subroots AS (SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM tree t
  WHERE lvl = (SELECT max(lvl) FROM tree m WHERE m.source IS NOT DISTINCT FROM t.source)),
{_climb('whole', "SELECT 0 AS lvl, 0 AS grp, place AS pos, subroot AS d, NULL AS x FROM subroots", 'grp')},
root AS (SELECT d AS root FROM whole WHERE lvl = (SELECT max(lvl) FROM whole)),
own AS (SELECT doc_id, leaf, shown, subroot, place, l.source, l.pos, (
    SELECT list(t.l || '|' || t.r ORDER BY t.lvl) FROM tree_sides t
    WHERE t.source IS NOT DISTINCT FROM l.source AND t.pos = l.pos // (3 ** t.lvl)::BIGINT) AS inner_sides
  FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source),
outer_sides AS (SELECT place, list(w.l || '|' || w.r ORDER BY w.lvl) AS sides
  FROM subroots JOIN whole_sides w ON w.pos = place // (3 ** w.lvl)::BIGINT GROUP BY place),
proofs AS (SELECT own.*, list_concat(coalesce(inner_sides, []), coalesce(sides, [])) AS sides
  FROM own LEFT JOIN outer_sides USING (place)),
folded AS (SELECT *, sha256(replace(array_to_string(sides, ''), '|', '')) AS proof_sha256,
  list_reduce(list_prepend(shown, sides), lambda node, side:
    sha256(split_part(side, '|', 1) || node || split_part(side, '|', 2))) AS folded_root FROM proofs)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded, root
"""


def _moves() -> str:
    """(state, letters put in, rows put in, edit, initial asked for, state after, role given): states are last initials."""
    after = {"": {"u": "user", "s": None}, "s": {"u": "user"}, "u": {"a": "assistant"}, "a": {"u": "user"}}
    rows = []
    for state in after:
        at, added = state, []
        for n in range(3):
            if n:
                added.append("assistant" if at == "u" else "user")
                at = added[-1][0]
            put = "[" + ", ".join(f"'{r}:'" for r in added) + "]::VARCHAR[]"
            rows.append(f"('{state}', {n}, {put}, 'D', NULL, '{at}', NULL)")
            for new, role in after[at].items():
                rows.append(f"('{state}', {n}, {put}, 'K', '{new}', '{new}', NULL)")
                if role:
                    rows.append(f"('{state}', {n}, {put}, 'R', NULL, '{new}', '{role}')")
    return ", ".join(rows)


CONVERSATION_REPAIR = rf"""
WITH RECURSIVE {CRC_TABLE},
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations, crc_table),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN fate = 0 THEN [] WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM hurt),
judged AS (SELECT *, CASE WHEN role = '' THEN ' ' ELSE left(role, 1) END AS initial,
  regexp_replace(text, '[{GAP}]+$', '') AS bare,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed),
turns AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN again THEN 2 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 3
    ELSE 0 END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged),
moves(state, n, put, edit, asked, after, given) AS (VALUES {_moves()}),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '' AS state, 0 AS cost, '' AS audit, []::VARCHAR[] AS done FROM conversations
  UNION ALL
  SELECT conv_id, i, after, cost, audit, done FROM (
    SELECT w.conv_id, t.i, m.after,
      w.cost + 3 * m.n + CASE m.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END
        + CASE WHEN t.fault = 3 AND m.edit <> 'D' THEN 3 ELSE 0 END AS cost,
      w.audit || repeat('I', m.n) || m.edit AS audit,
      list_concat(w.done, m.put, CASE m.edit WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text]
        ELSE [m.given || ':' || t.text] END) AS done
    FROM ways w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1
    JOIN moves m ON m.state = w.state AND (m.edit = 'D' OR t.fault NOT IN (1, 2))
      AND (m.edit <> 'K' OR m.asked = t.initial))
  QUALIFY row_number() OVER (PARTITION BY conv_id, after ORDER BY cost, audit) = 1),
ended AS (
  SELECT w.conv_id, cost + 3 * e.n AS cost, audit || repeat('I', e.n) AS audit, list_concat(done, e.put) AS done
  FROM ways w JOIN (VALUES ('', 0, []::VARCHAR[]), ('a', 0, []::VARCHAR[]), ('u', 1, ['assistant:']),
    ('s', 2, ['user:', 'assistant:'])) e(state, n, put) USING (state)
  WHERE w.i = (SELECT count(*) FROM turns t WHERE t.conv_id IS NOT DISTINCT FROM w.conv_id)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY cost + 3 * e.n, audit || repeat('I', e.n)) = 1),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, e.cost::BIGINT AS cost, e.audit,
  sha256(array_to_string(done, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES = {
    "op3_decontamination": DECONTAMINATION,
    "op6_quality_rules": QUALITY_RULES,
    "op8_licence_scan": LICENCES,
    "op9_chat_format": CHAT,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op13_manifest": MANIFEST,
}
