"""DuckDB SQL for the corpus queries that SQL can express. Tables: documents, conversations."""

from __future__ import annotations

from . import quality_rules as q
from .chat_format import _SPEAKERS, BEGIN, CONTROL, END, LIST_LAYOUTS, MIDDLE

_WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '{_WORD}')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _escaped(x: str) -> str:
    """The same escape as the operator's: the mark doubled, then put after the first character of each control string."""
    out = f"replace(coalesce({x}, ''), '\\', '\\\\')"
    for k in sorted(CONTROL, key=len, reverse=True):
        out = f"replace({out}, {_text(k)}, {_text(k[0] + chr(92) + k[1:])})"
    return out


_IN_ORDER = "ORDER BY turn NULLS FIRST, role, text"
_DEAL = lambda n: f"((coalesce(conv_id, 0) % {n} + {n}) % {n})"

OP4 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS t(conv_id, turn, role, text)),
g AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {_IN_ORDER})) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {_IN_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(BEGIN) + len(MIDDLE) + len(END) + 1} + length({_escaped('role')}) + length({_escaped('text')})) AS BIGINT) AS formatted_chars,
  list(role {_IN_ORDER}) = ['user', 'assistant'] AND bool_and(text <> '') AS pair, bool_or(role IN ({', '.join(map(_text, _SPEAKERS))})) AS renamed
FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  CASE WHEN pair AND {_DEAL(2)} = 0 THEN 'prompt and response' WHEN pair THEN 'instruction without input' WHEN {_DEAL(LIST_LAYOUTS)} = 1 THEN 'turns' WHEN {_DEAL(LIST_LAYOUTS)} = 2 THEN 'authored parts'
    WHEN {_DEAL(LIST_LAYOUTS)} = 3 AND NOT renamed THEN 'shared conversation' WHEN {_DEAL(LIST_LAYOUTS)} = 4 AND NOT renamed THEN 'chat messages' ELSE 'messages' END AS layout
FROM g
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS node, doc_id AS other FROM d UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(other) AS component_id FROM r GROUP BY node) m USING (doc_id)
"""


def _op7() -> str:
    rates = ", ".join(f"CASE WHEN {b} > 0 THEN {a} * 10000 // {b} ELSE 0 END AS {m}" for m, (a, b, _) in q.METRICS.items())
    cells = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM m WHERE NOT base_failed" for m in q.METRICS)
    floors = "CASE metric " + " ".join(f"WHEN '{m}' THEN {f}" for m, (_, _, f) in q.METRICS.items()) + " END"
    fine = " AND ".join(f"{m} <= coalesce((SELECT lim FROM k WHERE k.metric = '{m}' AND k.lang IS NOT DISTINCT FROM m.lang AND k.source IS NOT DISTINCT FROM m.source), 0)" for m in q.METRICS)
    limit = f"greatest(q75 + {q.SPREAD} * (q75 - q25), {floors})"
    ranks = lambda keys: f"""SELECT {keys}metric, max(n) AS n, min(b) FILTER (up * 100 >= n * 25) AS q25, min(b) FILTER (up * 100 >= n * 75) AS q75 FROM
      (SELECT {keys}metric, b, sum(c) OVER (PARTITION BY {keys}metric ORDER BY b) AS up, sum(c) OVER (PARTITION BY {keys}metric) AS n FROM
        (SELECT {keys}metric, b, count(*) AS c FROM b GROUP BY ALL)) GROUP BY ALL"""
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM g WHERE c > 1) GROUP BY doc_id),
x AS (SELECT doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '{q.SYMBOLS}')) AS n_symbols,
  len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM l LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM x),
b AS (SELECT lang, source, metric, (v >> greatest(0, length(bin(v)) - 7)) << greatest(0, length(bin(v)) - 7) AS b FROM ({cells})),
own AS ({ranks('lang, source, ')}), whole AS ({ranks('')}),
k AS (SELECT o.lang, o.source, metric, CASE WHEN o.n >= {q.MIN_GROUP} THEN o.lim ELSE h.lim END AS lim FROM (SELECT *, {limit} AS lim FROM own) o JOIN (SELECT metric, {limit} AS lim FROM whole) h USING (metric))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {fine} AS kept FROM m
"""


OP7 = _op7()

# a source's rate goes from f0 to f1 over training; the time by which the share u of its words is used solves a quadratic
_USE = lambda e: f"greatest(0, least(size, floor(target) - begins - {e} * source_size))"
_SHARE = lambda e: f"least(1.0::DOUBLE, (begins + {e} * source_size + {_USE(e)} / 2.0::DOUBLE) / greatest(1.0::DOUBLE, target)) * ((f1 + f0) / 2.0::DOUBLE)"
_POSITION = lambda e: (
    f"CASE WHEN {_USE(e)} > 0 THEN round(least(1.0::DOUBLE, 2 * {_SHARE(e)} / (f0 + sqrt(greatest(0.0::DOUBLE, f0 * f0 + 2 * (f1 - f0) * {_SHARE(e)})))), 9) END"
)

OP8 = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM d GROUP BY source),
f AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][rk % 3 + 1] AS wt, CAST(2 * source_size AS DOUBLE) AS cap FROM s),
l AS (SELECT *, cap / wt AS full_at, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE - (sum(cap) OVER (ORDER BY cap / wt, rk) - cap)) / sum(wt) OVER (ORDER BY cap / wt, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM f),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(lev, full_at) FROM l WHERE lev <= full_at) * wt, cap)) AS target,
  [2.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE][rk % 3 + 1] AS f0, [1.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][rk % 3 + 1] AS f1 FROM l),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - size AS begins FROM d)
SELECT doc_id, size, source_size, target, CAST({_USE(0)} + {_USE(1)} AS BIGINT) AS taken, {_POSITION(0)} AS position, {_POSITION(1)} AS position_2
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT doc_id, i, unnest(range(20)) AS o FROM g WHERE k > 1)),
k AS (SELECT u.doc_id, string_agg(u.x, ' ' ORDER BY u.i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d) u ANTI JOIN c USING (doc_id, i) GROUP BY u.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
