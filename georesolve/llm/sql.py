"""SQL of the training-data queries that SQL can express, for an independent engine."""

from __future__ import annotations

OP9_SQL = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""


# A path is its cost in eight digits and its audit, so that the least string is the cheapest, then ASCII-least one.
def _more(path: str, cost: str | int, letter: str, allowed: str = "true") -> str:
    return f"CASE WHEN {allowed} THEN lpad(CAST(CAST(substr({path}, 1, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({path}, 9) || '{letter}' END"


_START, _NONE = "'00000000'", "CAST(NULL AS VARCHAR)"
_USER = [f"{p}" for p in ("q0", "q1", "q3")]
_CUT = "CASE WHEN fault = 't' THEN 3 ELSE 0 END"
_FIT = "fault NOT IN ('b', 'd')"

OP11_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), coded AS (
  SELECT *, xor(list_reduce(range(8 * length(k)), lambda c, i:
    xor((CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(k, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE c END) >> 1,
        3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(k, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE c END) & 1)),
    4294967295), 4294967295) % 20 AS code FROM keyed
), hurt AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded WHERE code <> 0
), said AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS time FROM hurt
), d AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS i,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN time > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault FROM said
), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {_START} AS q0, {_NONE} AS q1, {_more(_START, 3, "I")} AS q2, {_more(_more(_START, 3, "I"), 3, "I")} AS q3
  FROM (SELECT DISTINCT conv_id FROM d)
  UNION ALL
  SELECT conv_id, i, q0, q1, q2, least(q3, {_more("q2", 3, "I")}) FROM (
    SELECT conv_id, i, q0, q1, least(q2, {", ".join(_more(q, 3, "I") for q in _USER)}) AS q2, q3 FROM (
      SELECT walk.conv_id, d.i, {_more("q0", 4, "D")} AS q0,
             least({_more("q1", 4, "D")}, {_more("q0", _CUT, "K", f"{_FIT} AND substr(role, 1, 1) = 's'")}) AS q1,
             least({_more("q2", 4, "D")}, {", ".join(_more(q, _CUT, "K", f"{_FIT} AND substr(role, 1, 1) = 'u'") for q in _USER)},
                   {", ".join(_more(q, f"3 + {_CUT}", "R", _FIT) for q in _USER)}) AS q2,
             least({_more("q3", 4, "D")}, {_more("q2", _CUT, "K", f"{_FIT} AND substr(role, 1, 1) = 'a'")}, {_more("q2", f"3 + {_CUT}", "R", _FIT)}) AS q3
      FROM walk JOIN d ON d.conv_id IS NOT DISTINCT FROM walk.conv_id AND d.i = walk.i + 1))
), best AS (
  SELECT conv_id, CAST(substr(p, 1, 8) AS BIGINT) AS cost, substr(p, 9) AS audit
  FROM (SELECT conv_id, least(arg_max(q0, i), arg_max(q3, i)) AS p FROM walk GROUP BY conv_id)
), letters AS (
  SELECT conv_id, j, substr(audit, j, 1) AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS j FROM best)
), placed AS (
  SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS i FROM letters
), lines AS (
  SELECT p.conv_id, p.j, p.edit, CASE WHEN p.edit = 'I' THEN '' ELSE d.text END AS text, CASE WHEN p.edit = 'K' THEN d.role END AS role
  FROM placed p LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM p.conv_id AND d.i = p.i WHERE p.edit <> 'D'
), turned AS (
  SELECT *, sum(CASE WHEN role LIKE 's%' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS o FROM lines
), digest AS (
  SELECT conv_id, sha256(string_agg(coalesce(role, CASE WHEN o % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j)) AS sha FROM turned GROUP BY conv_id
), pairs AS (
  SELECT conv_id, turn, fault, substr(lag(role) OVER w, 1, 1) || substr(role, 1, 1) AS pair, lag(role) OVER w IS NOT NULL AS second
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (second AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN digest g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
"""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [("assign", _ASSIGN, 2, 8), ("access", "(AKIA[A-Z0-9]+)", 1, 16), ("hex", "([0-9a-f]+)", 1, 32)]
# Offsets of matches follow from the lengths of what lies between them.
_FOUND = "\n  UNION ALL ".join(
    f"""SELECT rid, {i} AS o, '{kind}' AS kind, regexp_split_to_array(text, '{p}') AS gap, regexp_extract_all(text, '{p}', 0) AS hit, regexp_extract_all(text, '{p}', {g}) AS own, {least} AS least FROM t"""
    for i, (kind, p, g, least) in enumerate(_KINDS)
)

OP12_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({_FOUND}),
each AS (SELECT rid, o, kind, least, unnest(hit) AS hit, unnest(own) AS own, unnest(gap[1:len(hit)]) AS gap, generate_subscripts(hit, 1) AS n FROM found WHERE len(hit) > 0),
placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY rid, o ORDER BY n) AS stop FROM each),
kept AS (SELECT rid, o, kind, stop - length(hit) AS start, stop FROM placed WHERE length(own) >= least),
lists AS (
  SELECT rid, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, o) AS spans FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN lists USING (rid)
"""
