"""DuckDB SQL for the digest queries that SQL can express."""

from __future__ import annotations

from .queries import TARGETS

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
gram AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT k FROM gram),
probe AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, size WHERE len(w) >= k)),
hit AS (SELECT p.doc_id, p.i, p.k, g.item FROM probe p JOIN gram g ON p.k = g.k AND p.g = g.g),
word AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP6 = """
WITH raw AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
plain AS (SELECT doc_id, pos, line, trim(regexp_replace(line, '[\\t\\x0B\\f\\r ]+', ' ', 'g')) AS p FROM raw),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) AS r FROM plain WHERE p <> ''),
uniq AS (SELECT p, min(r) AS r, string_split(p, ' ') AS w FROM ranked GROUP BY p),
long AS (SELECT r, p, w, len(w) AS n FROM uniq WHERE len(w) >= 5),
variant AS (
  SELECT r, n, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v
  FROM (SELECT r, w, n, unnest(range(1, n + 1)) AS i FROM long)),
replaced AS (SELECT r FROM (SELECT r, min(r) OVER (PARTITION BY v, i, n) AS e FROM variant) WHERE e < r),
edit AS (SELECT a.r AS a, b.r AS b FROM variant a JOIN long b ON a.v = b.p AND a.n = b.n + 1),
gone AS (SELECT r FROM replaced UNION SELECT a FROM edit WHERE b < a UNION SELECT b FROM edit WHERE a < b),
stay AS (SELECT u.r FROM uniq u LEFT JOIN gone g ON u.r = g.r WHERE g.r IS NULL),
marked AS (
  SELECT p.doc_id, p.pos, p.line, p.p = '' OR s.r IS NOT NULL AS kept
  FROM plain p LEFT JOIN ranked k USING (doc_id, pos) LEFT JOIN stay s ON k.r = s.r),
out AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT kept) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE kept), '') AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN out USING (doc_id)
"""

_BLANK = "[^\\x20\\x09-\\x0D]+"
OP3 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM later)),
word AS (SELECT doc_id, j, w[j] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM w)),
kept AS (SELECT a.doc_id, string_agg(a.x, ' ' ORDER BY a.j) AS t FROM word a LEFT JOIN gone b ON a.doc_id = b.doc_id AND a.j = b.j WHERE b.j IS NULL GROUP BY a.doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BLANK}') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
ee AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT x AS doc_id, x AS root FROM ee UNION SELECT ee.y, r.root FROM r JOIN ee ON ee.x = r.doc_id),
k AS (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.root, w.doc_id) AS component_id, coalesce(k.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""

# exact search; the operator's windows hold whole tables of this size
OP7 = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_sum([(a[1] - a[2]) * (a[1] - a[2]) for a in [[q.e[i], c.e[i]] for i in range(1, len(q.e) + 1)]])) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# calls and results as ``queries.with_calls`` tells them
OP5 = """
WITH RECURSIVE m AS (
  SELECT conv_id AS c, turn AS t, coalesce(role, '') AS role, coalesce(text, '') AS x, coalesce(role = 'assistant' AND turn % 4 = 1, false) AS calling, coalesce(role = 'user' AND turn % 4 = 2, false) AS answering
  FROM conversations),
call AS (
  SELECT c, t, 0 AS pos, CASE WHEN c % 5 = 2 THEN 's' ELSE 's' || t END AS id, CASE WHEN c % 11 = 4 THEN 'find' ELSE 'search' END AS name, ['c' || t] AS needs,
    '{"q":' || CAST(to_json(x) AS VARCHAR) || ',"top":' || t % 5 || '}' AS args,
    CASE WHEN c % 11 = 4 THEN ['unknown tool'] WHEN t % 5 NOT IN (1, 2, 3) THEN ['not in enum top'] ELSE [] END AS problems
  FROM m WHERE calling
  UNION ALL
  SELECT c, t, 1, 'c' || t, 'count', CASE WHEN c % 7 = 3 THEN [CASE WHEN c % 5 = 2 THEN 's' ELSE 's' || t END] WHEN t // 4 % 4 <> 0 THEN [CASE WHEN c % 5 = 2 THEN 's' ELSE 's' || (t - 4) END] ELSE [] END,
    '{"n":' || length(x) || CASE WHEN c % 3 = 1 THEN '' ELSE ',"unit":"char"' END || '}', CASE WHEN c % 3 = 1 THEN ['missing unit'] ELSE [] END
  FROM m WHERE calling),
result AS (SELECT c, t, CASE WHEN c % 6 = 5 THEN 'lost' WHEN c % 5 = 2 THEN 's' ELSE 's' || (t - 1) END AS id, CAST(to_json(x) AS VARCHAR) AS content FROM m WHERE answering),
edge AS (SELECT DISTINCT e.c, e.id, e.need FROM (SELECT c, id, unnest(needs) AS need FROM call) e JOIN call k ON k.c = e.c AND k.id = e.need),
reach AS (SELECT c, id, need FROM edge UNION SELECT r.c, r.id, e.need FROM reach r JOIN edge e ON e.c = r.c AND e.id = r.need),
circle AS (SELECT DISTINCT r.c, r.id FROM reach r JOIN reach s ON s.c = r.c AND s.id = r.need AND s.need = r.need),
depth AS (
  SELECT DISTINCT c, id, 0 AS d FROM call
  UNION SELECT e.c, e.id, d + 1 FROM depth p JOIN edge e ON e.c = p.c AND e.need = p.id WHERE NOT EXISTS (SELECT 1 FROM circle k WHERE k.c = e.c AND k.id = e.id)),
level AS (SELECT c, id, CAST(max(d) AS INTEGER) AS level FROM depth d WHERE NOT EXISTS (SELECT 1 FROM circle k WHERE k.c = d.c AND k.id = d.id) GROUP BY c, id),
owner AS (SELECT c, id, min((t, pos)) AS own FROM call GROUP BY c, id),
answer AS (SELECT c, id, min((t, content)) AS own FROM result GROUP BY c, id),
told AS (
  SELECT c, t, 0 AS level, 0 AS pos, 'message' AS kind, NULL AS id, 'ok' AS status, CAST(json_object('content', x, 'role', role) AS VARCHAR) AS json FROM m WHERE NOT calling AND NOT answering
  UNION ALL
  SELECT k.c, k.t, coalesce(l.level, 2147483647), k.pos, 'call', k.id,
    CASE WHEN (k.t, k.pos) <> o.own THEN 'repeated id' WHEN l.level IS NULL THEN 'circular' WHEN len(k.problems) > 0 THEN 'invalid' WHEN a.own IS NULL THEN 'no result' ELSE 'ok' END,
    '{"arguments":' || k.args || ',"id":"' || k.id || '","name":"' || k.name || '","problems":' || CAST(to_json(k.problems) AS VARCHAR) || ',"role":"assistant","type":"tool_call"}'
  FROM call k JOIN owner o ON o.c = k.c AND o.id = k.id LEFT JOIN level l ON l.c = k.c AND l.id = k.id LEFT JOIN answer a ON a.c = k.c AND a.id = k.id
  UNION ALL
  SELECT r.c, coalesce(o.own[1], r.t), CASE WHEN o.own IS NULL THEN 0 ELSE coalesce(l.level, 2147483647) END, coalesce(o.own[2], 0), 'result', r.id,
    CASE WHEN o.own IS NULL THEN 'no call' WHEN (r.t, r.content) <> a.own THEN 'repeated' ELSE 'ok' END, '{"content":' || r.content || ',"id":"' || r.id || '","role":"tool"}'
  FROM result r JOIN answer a ON a.c = r.c AND a.id = r.id LEFT JOIN owner o ON o.c = r.c AND o.id = r.id LEFT JOIN level l ON l.c = r.c AND l.id = r.id)
SELECT c AS conv_id, t AS turn, CAST(level AS INTEGER) AS level, CAST(pos AS INTEGER) AS pos, kind, CAST(id AS VARCHAR) AS call_id, status, json FROM told
"""

# the schedule slot by slot; the weights are those of ``queries.TARGETS``
OP1 = """
WITH RECURSIVE w AS (SELECT * FROM (VALUES {weights}) AS w(source, w)),
placed AS (
  SELECT doc_id, source, n_chars, row_number() OVER (PARTITION BY source ORDER BY r, doc_id) - 1 AS pos
  FROM (SELECT *, substr(md5(concat_ws(chr(31), '0', d, d, s, n)), 1, 12) AS r
    FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), chr(0)) AS d, coalesce(source, chr(0)) AS s, coalesce(CAST(n_chars AS VARCHAR), chr(0)) AS n FROM documents))),
src AS (
  SELECT row_number() OVER (ORDER BY CASE WHEN p.source IS NULL THEN 'n' ELSE 's' || p.source END) AS i, p.source, (count(*) + 15) // 16 AS blocks, coalesce(any_value(w.w), 0) AS w
  FROM placed p LEFT JOIN w USING (source) GROUP BY p.source),
start AS (SELECT list(blocks ORDER BY i) AS left_, list(w ORDER BY i) AS w, list(0 ORDER BY i) AS used, CAST(len(list(i)) AS BIGINT) AS n FROM src),
turn AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS t, left_, used, w, n, CAST(NULL AS BIGINT) AS pick, CAST(NULL AS BIGINT) AS released, CAST(NULL AS BIGINT) AS due, CAST(0 AS BIGINT) AS whole, true AS fresh, [CAST(0 AS BIGINT)] AS share, CAST(0 AS BIGINT) AS q
  FROM start
  UNION ALL
  SELECT slot, t + 1, [CASE WHEN i = pick THEN left_[i] - 1 ELSE left_[i] END for i in range(1, n + 1)], [CASE WHEN i = pick THEN used[i] + 1 ELSE used[i] END for i in range(1, n + 1)],
    w, n, pick, used[pick] * q // share[pick], ((used[pick] + 1) * q + share[pick] - 1) // share[pick], whole,
    t + 1 >= whole AND len([1 for i in range(1, n + 1) if share[i] > 0 AND left_[i] - CASE WHEN i = pick THEN 1 ELSE 0 END = 0]) > 0, share, q
  FROM (
    SELECT *, list_sort([{{'d': ((used[i] + 1) * q + share[i] - 1) // greatest(share[i], 1), 'i': i}} for i in range(1, n + 1) if share[i] > 0 AND used[i] * q // greatest(share[i], 1) <= t])[1].i AS pick
    FROM (
      SELECT *, CASE WHEN fresh THEN list_min([left_[i] // greatest(share[i], 1) for i in range(1, n + 1) if share[i] > 0]) * q ELSE whole0 END AS whole
      FROM (
        SELECT *, list_sum(share) AS q
        FROM (
          SELECT slot + 1 AS slot, CASE WHEN fresh THEN 0 ELSE t END AS t, left_, CASE WHEN fresh THEN [0 for i in range(1, n + 1)] ELSE used END AS used, w, n, whole AS whole0, fresh,
            CASE WHEN NOT fresh THEN share WHEN list_sum([CASE WHEN left_[i] > 0 THEN w[i] ELSE 0 END for i in range(1, n + 1)]) > 0 THEN [CASE WHEN left_[i] > 0 THEN w[i] ELSE 0 END for i in range(1, n + 1)]
              ELSE [CASE WHEN left_[i] > 0 THEN 1 ELSE 0 END for i in range(1, n + 1)] END AS share
          FROM turn WHERE list_sum(left_) > 0))))),
slots AS (SELECT slot, pick, released, due, row_number() OVER (PARTITION BY pick ORDER BY slot) AS block FROM turn WHERE slot >= 0)
SELECT p.doc_id, p.source, p.n_chars, p.pos // 16 + 1 AS mix_block, s.released AS mix_release, s.due AS mix_deadline, s.slot AS mix_slot, s.slot * 16 + p.pos % 16 AS mix_position
FROM placed p JOIN src ON p.source IS NOT DISTINCT FROM src.source JOIN slots s ON s.pick = src.i AND s.block = p.pos // 16 + 1
"""

def oracle_sql() -> dict[str, str]:
    weights = ", ".join(f"('{k}', {w})" for k, w in TARGETS.items())
    return {"op1_mixing": OP1.format(weights=weights), "op2_decontaminate": OP2, "op3_substring_dedup": OP3, "op5_chat": OP5, "op6_line_dedup": OP6, "op7_neighbours": OP7, "op9_near_dedup": OP9}
