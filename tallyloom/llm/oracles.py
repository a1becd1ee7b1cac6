"""The queries that SQL can express, for DuckDB on the same tables."""

from __future__ import annotations

from tallyloom.llm import ann, chat, infill, lm, quality

SPACE = r"[\x20\x09-\x0D]"

_stop = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


def _rule(rule: quality.Rule) -> str:
    unit = f"* {rule.per}" if rule.per else ""
    outside = [f"{rule.measure} < {rule.least} {unit}"] if rule.least is not None else []
    outside += [f"{rule.measure} > {rule.most} {unit}"] if rule.most is not None else []
    return f"CASE WHEN ({' OR '.join(outside)}) AND n_words >= {rule.from_words} THEN '{rule.name}' END"


QUALITY = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT place) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w) AS n_words, len(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars,
    len(t) - len(regexp_replace(t, '{quality.SYMBOLS}', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({_stop}))) AS n_stop_words
  FROM d LEFT JOIN covered USING (doc_id)),
f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    concat_ws(',', {", ".join(map(_rule, quality.RULES))}) AS failed_rules
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND failed_rules = '' AS kept, n_lines, n_stop_words, failed_rules FROM f
"""

_marks = " ".join(f"WHEN '{role}' THEN {len(chat.HEADS[i]) + len(chat.TAILS[i])}"
                  for i, role in enumerate(chat.MARKS))
_other = len(chat.HEADS[-1]) + len(chat.MIDDLES[-1]) + len(chat.TAILS[-1])

CHAT = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)({chat.CONTROL})', '\1\\\2\3', 'g') AS shown,
    regexp_replace(role, '([<\[])(\\*)({chat.CONTROL})', '\1\\\2\3', 'g') AS shown_role FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(len(shown) + CASE role {_marks} ELSE {_other} + len(shown_role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

LM = rf"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{SPACE}+'), lambda x: x <> '') AS words FROM documents),
t AS (SELECT doc_id, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] ELSE '' END AS before
  FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM d)),
b AS (SELECT doc_id, before, w, count(*) AS times FROM t GROUP BY ALL),
o AS (SELECT doc_id, w, sum(times) AS own FROM b GROUP BY ALL),
u AS (SELECT w, sum(times) AS n FROM b GROUP BY w),
c AS (SELECT w AS before, n FROM u UNION ALL SELECT '', sum(times) FROM b WHERE before = ''),
g AS (SELECT before, w, sum(times) AS n FROM b GROUP BY ALL),
s AS (
  SELECT doc_id, times, g.n - times AS elsewhere, u.n - own AS alone, c.n AS context,
    (SELECT sum(n) FROM u) AS tokens
  FROM b JOIN g USING (before, w) JOIN u USING (w) JOIN o USING (doc_id, w) JOIN c ON c.before = b.before),
r AS (
  SELECT doc_id, sum(times) FILTER (elsewhere > 0) AS n_seen,
    sum(times * ln(CASE WHEN elsewhere > 0 THEN elsewhere / context
      WHEN alone > 0 THEN {lm.BACKOFF}::DOUBLE * alone / tokens ELSE {lm.BACKOFF ** 2}::DOUBLE / tokens END)) AS total
  FROM s GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_seen, 0)::BIGINT AS n_seen,
  round(total / len(words), 9) AS score, round(exp(-total / len(words)), 3) AS perplexity
FROM d LEFT JOIN r USING (doc_id)
"""

_h = [f"('0x' || substr(h, {8 * i + 1}, 8))::UBIGINT::BIGINT" for i in range(4)]

INFILL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
    sha256('{infill.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (
  SELECT *, least({_h[0]} % (len(w) + 1), {_h[1]} % (len(w) + 1)) AS a,
    greatest({_h[0]} % (len(w) + 1), {_h[1]} % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR {_h[2]} % 100 >= {100 - infill.PLAIN} THEN 'plain'
      WHEN {_h[3]} % 100 < {infill.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT doc_id, t, len(w) AS n, form, array_to_string(w[1:a], '') AS prefix,
    array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN len(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN len(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLES = {"op13_fill_in_middle": INFILL, "op3_chat_format": CHAT, "op5_nearest_vectors": ann.SQL, "op7_lm_scoring": LM, "op9_quality_rules": QUALITY}
