"""SQL twins of the corpus queries that SQL can express."""

from __future__ import annotations

import re

from landmatch.llm import chat, licenses, lloyd, phrases, quality


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_STOPS = _quoted([*quality.STOP_WORDS, *(w.capitalize() for w in quality.STOP_WORDS)])
_TEMPLATES = ", ".join(f"({k}, '{name}', {size}, '{gram}', {times})" for k, name, size, gram, times in licenses.template_bigrams(licenses.TEMPLATES))

QUALITY = rf"""WITH w AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM w, unnest(range(1, len(words) - 1)) u(i)),
two AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM two) GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
  len(list_filter(words, lambda x: list_contains([{_STOPS}], x))) AS n_stop_words FROM w LEFT JOIN covered USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.1
  AND n_stop_words / n_words >= 0.02 AND CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines <= 0.5 ELSE true END AS kept FROM j"""

LICENCES = f"""WITH k(template, license, t_size, gram, t_times) AS (VALUES {_TEMPLATES}),
u AS (SELECT doc_id, -1 AS line, text AS unit FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, -1 - i, p[i] FROM (SELECT doc_id, string_split_regex(text, '\n[ \t]*\n') AS p FROM documents WHERE text IS NOT NULL), unnest(range(1, len(p) + 1)) r(i) WHERE len(p) > 1 AND contains(p[i], chr(10))
  UNION ALL SELECT doc_id, i - 1, s[i] FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) r(i)),
w AS (SELECT doc_id, line, list_filter(regexp_split_to_array(lower(unit), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM u),
g AS (SELECT doc_id, line, greatest(len(w) - 1, 1) AS n, CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END AS gs FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, line, n, gram, count(*) AS times FROM (SELECT doc_id, line, n, unnest(gs) AS gram FROM g) GROUP BY ALL),
d AS (SELECT doc_id, line, license, template, 2 * CAST(sum(least(times, t_times)) AS DOUBLE) / (n + t_size) AS dice FROM c JOIN k USING (gram) GROUP BY doc_id, line, license, template, n, t_size),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, license) AS r FROM d WHERE dice >= 0.8) WHERE r = 1),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, line) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM best)
SELECT o.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, license, CAST(line AS INTEGER) AS line, dice FROM (SELECT DISTINCT doc_id FROM documents) o LEFT JOIN top ON o.doc_id = top.doc_id AND p = 1"""


def _chat(t: chat.Template) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    escape = lambda c: f"regexp_replace({c}, {quoted(f'({t.opens})({t.escape}*)({t.rests})')}, '\\1{t.escape}\\2\\3', 'g')"
    marks = " ".join(f"WHEN role = {quoted(r)} THEN {len(m.before) + len(m.after)} + length({escape('text')})" for r, m in t.roles.items())
    others = f"{len(t.other.before) + len(t.named) + len(t.other.after)} + length({escape('role')}) + length({escape('text')})"
    trained = _quoted(r for r, m in t.roles.items() if m.loss)
    legal = " ".join([f"WHEN k = 0 THEN role IN ({_quoted(t.follows[chat.START])})", *(f"WHEN prev = {quoted(r)} THEN role IN ({_quoted(then)})" for r, then in t.follows.items() if r != chat.START)])
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
n AS (SELECT *, row_number() OVER w - 1 AS k, lag(role) OVER w AS prev FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, CASE {legal} ELSE true END AS ok, CASE {marks} ELSE {others} END AS chars, role IN ({trained}) AS trained FROM n),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said, coalesce(string_agg(text, '' ORDER BY k) FILTER (trained), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars,
  min(k) FILTER (NOT ok) AS bad, arg_max(role, k) AS last FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, CAST(bad AS BIGINT) AS first_bad_turn,
  bad IS NULL AND last IN ({_quoted(t.ends)}) AS complete FROM g"""


CHAT = _chat(chat.INSTRUCT)


def _lloyd(k: int, rounds: int, dimensions: int, scale: int, seed: str) -> str:
    steps = [f"""v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS q FROM embeddings
  WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), q) - 1 AS c, q FROM v ORDER BY sha256('{seed}:' || vec_id), q LIMIT {k})"]
    for n in range(rounds + 1):
        steps.append(f"""d{n} AS (SELECT rid, v.q, c, list_sum(list_transform(range(1, {dimensions + 1}), lambda i: (v.q[i] - c{n}.q[i]) * (v.q[i] - c{n}.q[i]))) AS d FROM v, c{n})""")
        steps.append(f"a{n} AS (SELECT rid, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d, any_value(q) AS q FROM d{n} GROUP BY rid)")
        if n < rounds:
            steps.append(f"""s{n} AS (SELECT c, i, sum(x) AS total, count(*) AS n FROM (SELECT c, unnest(q) AS x, unnest(range({dimensions})) AS i FROM a{n}) GROUP BY c, i),
m{n} AS (SELECT c, list(total // n - CASE WHEN total % n < 0 THEN 1 ELSE 0 END ORDER BY i) AS q FROM s{n} GROUP BY c),
c{n + 1} AS (SELECT c, coalesce(m{n}.q, c{n}.q) AS q FROM c{n} LEFT JOIN m{n} USING (c))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (c)"""


LLOYD = _lloyd(lloyd.K, lloyd.ROUNDS, lloyd.DIMENSIONS, lloyd.SCALE, lloyd.SEED)

COLLOCATIONS = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents),
e AS (SELECT pid, lang, unnest(w) AS w1, unnest(range(len(w))) AS i FROM (SELECT row_number() OVER () AS pid, lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p)),
w AS (SELECT lang, w1, w1 || ' ' || lead(w1) OVER o AS w2, w1 || ' ' || lead(w1) OVER o || ' ' || lead(w1, 2) OVER o AS w3 FROM e WINDOW o AS (PARTITION BY pid ORDER BY i)),
g AS (SELECT lang, 1 AS size, w1 AS phrase, count(*) AS n FROM w GROUP BY ALL UNION ALL SELECT lang, 2, w2, count(*) FROM w WHERE w2 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 3, w3, count(*) FROM w WHERE w3 IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS x FROM g WHERE size > 1 AND n >= {phrases.LEAST}),
f AS (SELECT lang || chr(0) || phrase AS key, n FROM g),
k AS (SELECT c.*, k, lang || chr(0) || array_to_string(x[1 : k], ' ') AS lp, lang || chr(0) || array_to_string(x[k + 1 :], ' ') AS rp FROM c, unnest(range(1, size)) u(k)),
s AS (SELECT k.lang, k.phrase, a, k.k, lg.n AS l, rg.n AS r, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(lg.n AS HUGEINT) * rg.n) AS BIGINT) AS score
  FROM k JOIN f lg ON k.lp = lg.key JOIN f rg ON k.rp = rg.key),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(x[1 : 2], ' '), array_to_string(x[2 : 3], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY lang, phrase),
z AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {phrases.SHARE} * a)
SELECT lang, rank, phrase, a, l, r, t.n AS n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z) JOIN t USING (lang) WHERE rank <= {phrases.TOP}"""
