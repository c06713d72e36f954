"""DuckDB SQL for the layout queries that SQL can express."""

from __future__ import annotations

from .. import config as C
from .queries import SAMPLES

_LADDER = ", ".join(f"({k}, CAST({s} AS DOUBLE))" for k, s in enumerate(C.FONT_LADDER))
_SIZES = "[" + ", ".join(f"CAST({s} AS DOUBLE)" for s in C.FONT_LADDER) + "]"

LINES = f"""WITH RECURSIVE raw_lines AS (
SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (
SELECT r.doc_id AS page, CAST(r.pos AS BIGINT) AS pos, r.line AS text, CAST(length(r.line) AS INTEGER) AS n,
  CAST((r.doc_id*7 + r.pos*13) % 40 * 20 AS DOUBLE) AS x0,
  CAST(r.pos*30 + (r.doc_id + r.pos) % 3 * 5 AS DOUBLE) AS y0,
  CAST((r.doc_id*7 + r.pos*13) % 40 * 20 + least(length(r.line), 60)*8 AS DOUBLE) AS x1,
  CAST(r.pos*30 + (r.doc_id + r.pos) % 3 * 5 + 20 + (r.doc_id*3 + r.pos) % 5 * 4 AS DOUBLE) AS y1,
  CAST((r.doc_id + r.pos*7) % 21 AS DOUBLE) / CAST(20 AS DOUBLE) AS score,
  ladder.pt AS font_pt,
  ladder.pt + CAST(r.pos % 7 - 3 AS DOUBLE) * CAST(0.3 AS DOUBLE) AS est_pt,
  (r.doc_id + r.pos) % 4 = 0 AS bold,
  CAST((r.doc_id*11 + r.pos*5) % 20 AS DOUBLE) / CAST(100 AS DOUBLE) AS stroke_rel,
  CASE WHEN r.pos % 3 = 0 THEN NULL ELSE CAST((r.doc_id*13 + r.pos*7) % 60 - 20 AS DOUBLE) / CAST(100 AS DOUBLE) END AS bold_r,
  CAST((r.doc_id*3 + r.pos) % 4 * 40 AS INT) AS text_r,
  CAST((r.doc_id*5 + r.pos) % 4 * 20 AS INT) AS bg_r,
  CASE (r.doc_id*17 + r.pos*11) % 23 WHEN 5 THEN 20.0::DOUBLE WHEN 9 THEN -18.0::DOUBLE ELSE 0.0::DOUBLE END AS angle,
  CASE WHEN (r.doc_id*17 + r.pos*11) % 23 NOT IN (5, 9) AND (r.doc_id*3 + r.pos*7) % 29 = 4 THEN 16.0::DOUBLE ELSE 0.0::DOUBLE END AS arc,
  (r.doc_id + r.pos*5) % 31 = 6 AS vertical
FROM raw_lines r JOIN (VALUES {_LADDER}) AS ladder(idx, pt) ON ladder.idx = (r.doc_id*5 + r.pos*3) % 19
WHERE length(trim(replace(replace(r.line, chr(9), ' '), chr(13), ' '))) > 0)
"""
_COLUMNS = """, cols AS (
SELECT * REPLACE (x0 / 10 AS x0, x0 / 10 + (x1 - x0) AS x1, fp AS font_pt, fp + (pos % 7 - 3) * CAST(0.25 AS DOUBLE) AS est_pt)
FROM (SELECT *, CASE WHEN font_pt < 20 THEN 14.0::DOUBLE WHEN pos % 2 = 0 THEN 24.0::DOUBLE ELSE 28.0::DOUBLE END AS fp FROM lines))
"""
_CC = """, ee AS (SELECT page, i, j FROM e UNION SELECT page, j, i FROM e),
cc AS (SELECT page, i AS pos, i AS c FROM ee UNION SELECT ee.page, ee.j, cc.c FROM cc JOIN ee ON ee.page = cc.page AND ee.i = cc.pos),
label AS (SELECT page, pos, min(c) AS cc FROM cc GROUP BY page, pos)
"""
_W, _H = "({0}.x1 - {0}.x0)", "({0}.y1 - {0}.y0)"
_XO, _YO = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_MINW, _MINH = "least(a.x1 - a.x0, b.x1 - b.x0)", "least(a.y1 - a.y0, b.y1 - b.y0)"
_MAXH = "greatest(a.y1 - a.y0, b.y1 - b.y0)"
_PAIR = "FROM {t} a JOIN {t} b ON a.page = b.page AND a.pos < b.pos"
_BOTH = "FROM {t} a JOIN {t} b ON a.page = b.page AND a.pos <> b.pos"
_OVER = f"{_XO} > 0 AND {_YO} > 0 AND {_XO} * {_YO} > 0.3 * greatest(1.0, least({_W.format('a')} * {_H.format('a')}, {_W.format('b')} * {_H.format('b')}))"
_CJK = f"[{C.CJK_CLASS}]"
_FLAT = "a.angle = 0 AND a.arc = 0 AND b.angle = 0 AND b.arc = 0"
_ACC = "[à-öø-ÿ]"


def _bold_weak(t: str) -> str:
    return f"({t}.bold AND ((coalesce({t}.bold_r < 0.22, false) AND {t}.font_pt >= 16) OR ({t}.bold_r IS NULL AND {t}.stroke_rel = 0 AND {t}.font_pt >= 24)))"


def _snap(x: str) -> str:
    return f"list_sort([{{'d': abs(s - ({x})), 's': s}} for s in {_SIZES}])[1].s"


def _ceiled(x: str, limit: str) -> str:
    fit = f"list_max([s for s in {_SIZES} if s <= {limit}])"
    return f"CASE WHEN {_snap(x)} > {limit} THEN coalesce({fit}, {_snap(x)}) ELSE {_snap(x)} END"


def _em(x: str = "text") -> str:
    wide = f"length(regexp_replace({x}, '[^\\x{{2E80}}-\\x{{10FFFF}}]', '', 'g'))"
    space = f"length(regexp_replace({x}, '[^ ]', '', 'g'))"
    return f"({wide} * 1.0::DOUBLE + {space} * 0.33::DOUBLE + (length({x}) - {wide} - {space}) * 0.52::DOUBLE)"


def _ink(x: str = "text") -> str:
    return (
        f"(0.52::DOUBLE + CASE WHEN regexp_matches({x}, '[\\p{{Lu}}\\p{{Nd}}bdfhklt/()\\[\\]{{}}|!?''\"$]') THEN 0.22::DOUBLE ELSE 0 END"
        f" + CASE WHEN regexp_matches({x}, '[gjpqy()\\[\\]{{}}|/$;,]') THEN 0.20::DOUBLE ELSE 0 END)"
    )


def _pangu(cjk: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(text, '([{cjk}])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([{cjk}])', '\\1 \\2', 'g'), ' {{2,}}', ' ', 'g')"


def _degree(mark: str) -> str:
    return f"CASE WHEN ends_with(text, '{mark}') AND length(text) >= 2 AND NOT regexp_matches(text, '\\p{{Nd}}.$') THEN rtrim(left(text, length(text) - 1)) || '。' ELSE text END"


def _bullet(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '^[·‧・∙]') THEN regexp_replace({x}, '^[·‧・∙]\\s?', '• ') ELSE regexp_replace({x}, '^•([^ ])', '• \\1') END"


_EM_TOL = f"CASE WHEN {_em()} <= 8 THEN 1.12::DOUBLE WHEN {_em()} >= 12 THEN 1.03::DOUBLE ELSE 1.12::DOUBLE - ({_em()} - 8) * (0.09::DOUBLE / 4) END"
_SAMPLES = "(VALUES " + ", ".join(f"({k}, '{s}')" for k, s in enumerate(SAMPLES)) + ") AS t(k, text)"
_FOLD = f"translate(text, '{C.FOLD_FROM}', '{C.FOLD_TO}')"
_VOTE = """, v AS (
SELECT *, stroke_rel > 0 AND font_pt < 24 AS votes,
  count(*) FILTER (WHERE stroke_rel > 0 AND font_pt < 24) OVER w AS c, count(*) FILTER (WHERE stroke_rel > 0 AND font_pt < 24 AND bold) OVER w AS cb
FROM lines WINDOW w AS (PARTITION BY page, font_pt)),
voted AS (
SELECT *, CASE WHEN NOT votes OR c < 3 THEN 'none' WHEN cb * 3 >= c * 2 THEN 'promote' WHEN cb * 5 <= c THEN 'demote' WHEN c <= 4 AND cb = 1 THEN 'lone' ELSE 'none' END AS vote FROM v),
done AS (
SELECT page, pos, font_pt, vote, bold AS was, CASE
  WHEN vote = 'promote' AND NOT bold THEN CASE WHEN bold_r IS NOT NULL AND font_pt >= 16 THEN bold_r >= -0.05 ELSE stroke_rel >= 0.115 END
  WHEN vote = 'demote' AND bold THEN NOT CASE WHEN bold_r IS NOT NULL AND font_pt >= 16 THEN bold_r < 0.22 WHEN bold_r IS NOT NULL AND bold_r >= 0.28 THEN false ELSE stroke_rel <= 0.15 END
  WHEN vote = 'lone' AND bold AND bold_r IS NOT NULL AND font_pt >= 16 AND bold_r < 0.22 THEN false
  ELSE bold END AS bold FROM voted)
"""
_WRAP = f"""{_COLUMNS}, e AS (
SELECT DISTINCT a.page, a.pos AS i, b.pos AS j {_BOTH.format(t='cols')}
WHERE {_FLAT} AND a.est_pt > 0 AND b.est_pt > 0 AND a.y0 <= b.y0 AND b.y0 - a.y1 > -0.6 * {_MINH} AND b.y0 - a.y1 < 0.45 * {_MINH} AND {_XO} >= 0.4 * {_MINW}
  AND (a.bold = b.bold OR CASE WHEN a.bold THEN {_bold_weak('a')} ELSE {_bold_weak('b')} END)
  AND abs(a.bg_r - b.bg_r) <= 25 AND abs(a.text_r - b.text_r) <= 45 AND abs(a.est_pt - b.est_pt) <= 0.14 * greatest(a.est_pt, b.est_pt))
{_CC}, g AS (SELECT l.*, coalesce(label.cc, l.pos) AS cc FROM cols l LEFT JOIN label USING (page, pos)),
b AS (SELECT *, count(*) OVER w AS m, count(*) FILTER (WHERE bold) OVER w AS mb FROM g WINDOW w AS (PARTITION BY page, cc)),
s AS (SELECT * REPLACE (CASE WHEN mb > 0 AND mb * 2 < m AND bold AND coalesce(bold_r < 0.22, false) AND font_pt >= 16 THEN false ELSE bold END AS bold) FROM b),
z AS (SELECT page, cc, font_pt, count(*) AS c, list_position({_SIZES}, font_pt) AS step FROM s GROUP BY page, cc, font_pt),
t AS (
SELECT page, cc, count(*) AS kinds, min(step) AS lo, max(step) AS hi, count(*) FILTER (WHERE c = top) AS leaders, min(font_pt) FILTER (WHERE c = top) AS leader
FROM (SELECT *, max(c) OVER (PARTITION BY page, cc) AS top FROM z) GROUP BY page, cc),
md AS (SELECT page, cc, median(est_pt) AS med FROM s GROUP BY page, cc),
goal AS (SELECT page, cc, CASE WHEN leaders = 1 THEN leader ELSE {_snap('med')} END AS t FROM t JOIN md USING (page, cc) WHERE kinds > 1 AND hi - lo <= kinds - 1)
SELECT s.page, s.pos, s.cc, coalesce(goal.t, s.font_pt) AS font_pt, s.bold FROM s LEFT JOIN goal USING (page, cc)
"""
_CHIP = f"""{_COLUMNS}, e AS (
SELECT a.page, a.pos AS i, b.pos AS j {_PAIR.format(t='cols')}
WHERE {_FLAT} AND -{_YO} <= 0.6 * {_MINH} AND {_XO} >= 0.5 * {_MINW} AND abs(a.text_r - b.text_r) <= 25 AND abs(a.bg_r - b.bg_r) <= 40)
{_CC}, g AS (SELECT l.page, l.pos, l.bg_r, coalesce(label.cc, l.pos) AS cc FROM cols l LEFT JOIN label USING (page, pos))
SELECT page, pos, cc, CASE WHEN count(*) OVER w > 1 THEN CAST(trunc(median(bg_r) OVER w) AS INTEGER) ELSE bg_r END AS bg_r FROM g WINDOW w AS (PARTITION BY page, cc)
"""
_BANDS = """, band AS (
SELECT page, pos, 'below' AS band, x0 - 0.2 * (y1 - y0) AS x0, x1 + 0.2 * (y1 - y0) AS x1, y1 - 0.1 * (y1 - y0) AS y0, y1 + 1.1 * (y1 - y0) AS y1 FROM lines WHERE n <= 60 AND y1 - y0 <= 90
UNION ALL
SELECT page, pos, 'above', x0 - 0.2 * (y1 - y0), x1 + 0.2 * (y1 - y0), y0 - 1.1 * (y1 - y0), y0 + 0.1 * (y1 - y0) FROM lines WHERE n <= 60 AND y1 - y0 <= 90)
"""
_MATCH = """, words AS (SELECT page, score, unnest([w for w in regexp_extract_all(lower(text), '[a-z]+') if length(w) BETWEEN 2 AND 4]) AS w FROM lines),
known AS (SELECT page, w AS token, count(*) AS cnt FROM words WHERE score >= 0.8 GROUP BY page, w),
cand AS (SELECT DISTINCT page, w AS cand FROM words c WHERE score < 0.8 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.page = c.page AND k.token = c.w)),
hit AS (
SELECT c.page, c.cand, k.token, k.cnt FROM cand c JOIN known k ON c.page = k.page AND length(c.cand) = length(k.token)
WHERE len([i for i in range(1, length(c.cand) + 1) if substr(c.cand, i, 1) <> substr(k.token, i, 1)]) = 1),
best AS (SELECT *, max(cnt) OVER (PARTITION BY page, cand) AS top FROM hit)
SELECT page, cand, min(token) AS fixed FROM best WHERE cnt = top GROUP BY page, cand HAVING count(*) = 1
"""
_RUNS = """WITH v AS (SELECT vec_id, len(embedding) AS n, [x > 0 for x in embedding] AS f FROM embeddings),
p AS (SELECT vec_id, i, f[i] AS f FROM (SELECT vec_id, f, unnest(range(1, n + 1)) AS i FROM v)),
q AS (SELECT vec_id, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS g FROM p WHERE f),
r AS (SELECT vec_id, g, count(*) AS c FROM q GROUP BY vec_id, g)
SELECT v.vec_id, CAST(coalesce(max(r.c), 0) AS BIGINT) AS longest, count(r.c) AS n_runs FROM v LEFT JOIN r USING (vec_id) GROUP BY v.vec_id
"""
_ROLES = """WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'user' ELSE role END AS role FROM conversations),
m AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS fresh FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
g AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM m)
SELECT conv_id, run, min(role) AS role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM g GROUP BY conv_id, run
"""
_GAPS = """WITH b AS (SELECT user_id, epoch_us(ts) AS us, count(*) AS n FROM events GROUP BY 1, 2),
j AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us) > 3600000000 THEN 1 ELSE 0 END AS jump FROM b),
g AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS BIGINT) AS grp FROM j)
SELECT user_id, grp, min(us) AS first_us, max(us) AS last_us, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY user_id, grp
"""
_TITLES = f""", big AS (SELECT * REPLACE (font_pt + 20 AS font_pt), length(regexp_replace(text, '[^à-öø-ÿ]', '', 'g')) AS c FROM lines),
e AS (
SELECT a.page, a.pos AS i, b.pos AS j {_PAIR.format(t='big')}
WHERE {_FLAT} AND a.font_pt >= 28 AND b.font_pt >= 28 AND a.bold = b.bold AND {_YO} >= 0.6 * {_MINH} AND abs(a.text_r - b.text_r) <= 45
  AND CASE WHEN a.x0 <= b.x0 THEN b.x0 - a.x1 ELSE a.x0 - b.x1 END <= 0.8 * {_MINH})
{_CC}, g AS (SELECT l.*, coalesce(label.cc, l.pos) AS cc FROM big l LEFT JOIN label USING (page, pos)),
m AS (
SELECT page, cc, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(score) AS score, arg_max(font_pt, (c, x1 - x0, -x0, -pos)) AS font_pt,
  list_reduce(list({{'x0': x0, 'text': text, 'x1': x1}} ORDER BY x0, pos), lambda s, p: {{'x0': s.x0, 'text': s.text || CASE WHEN p.text <> '' AND s.text <> '' AND p.x0 < s.x1
    AND translate(left(p.text, 1), '{C.FOLD_FROM}', '{C.FOLD_TO}') = translate(right(s.text, 1), '{C.FOLD_FROM}', '{C.FOLD_TO}') THEN substr(p.text, 2) ELSE p.text END, 'x1': greatest(s.x1, p.x1)}}).text AS text
FROM g GROUP BY page, cc)
SELECT page, cc, n, CASE WHEN n > 1 THEN regexp_replace({_pangu(C.CJK_CLASS)}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') ELSE text END AS text, x0, y0, x1, y1, score, font_pt FROM m
"""
_COLOURS = """, l AS (SELECT page, list([{'n': 1, 'r': CASE WHEN pos % 6 <> 5 THEN text_r END}] ORDER BY pos) AS l FROM lines GROUP BY page),
r AS (
SELECT page, list_reduce(l, lambda s, x: CASE WHEN x[1].r IS NULL OR s[-1].r IS NULL OR abs(x[1].r - s[-1].r) <= 45
  THEN list_concat(s[:-2], [{'n': s[-1].n + 1, 'r': coalesce(s[-1].r, x[1].r)}]) ELSE list_concat(s, x) END) AS r FROM l),
o AS (
SELECT page, list_reduce([[x] for x in r], lambda s, x: CASE WHEN len(s) > 1 AND s[-1].n = 1 AND coalesce(abs(s[-2].r - x[1].r) <= 45, false)
  THEN list_concat(s[:-3], [{'n': s[-2].n + 1 + x[1].n, 'r': s[-2].r}]) ELSE list_concat(s, x) END) AS o FROM r),
c AS (SELECT page, o, [x.r for x in o if x.r IS NOT NULL] AS real FROM o WHERE len(o) > 1)
SELECT page, CAST(i - 1 AS INTEGER) AS k, CAST(o[i].n AS INTEGER) AS n, CAST(coalesce(o[i].r, real[1]) AS INTEGER) AS r
FROM (SELECT *, unnest(range(1, len(o) + 1)) AS i FROM c WHERE len(real) > 0 AND list_max(real) - list_min(real) >= 60)
"""
_MEANS = """, l AS (SELECT page, list([{'start': k, 'n': 1, 'sum': CAST(n AS DOUBLE)}] ORDER BY pos) AS l FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY pos) - 1 AS k FROM lines) GROUP BY page),
s AS (
SELECT page, list_reduce(l, lambda s, x: CASE WHEN abs(x[1].sum - s[-1].sum / s[-1].n) <= 26
  THEN list_concat(s[:-2], [{'start': s[-1].start, 'n': s[-1].n + 1, 'sum': s[-1].sum + x[1].sum}]) ELSE list_concat(s, x) END) AS s FROM l)
SELECT page, CAST(i - 1 AS INTEGER) AS k, CAST(s[i].start AS INTEGER) AS start, CAST(s[i].n AS INTEGER) AS n, round(s[i].sum / s[i].n, 6) AS mean FROM (SELECT page, s, unnest(range(1, len(s) + 1)) AS i FROM s)
"""
_PIECES = """, t AS (SELECT page, pos, text AS t, length(text) AS n, string_split(text, '') AS ch FROM lines),
c AS (SELECT page, pos, t, n, list_filter(range(1, n + 1), lambda i: ch[i] <> ' ') AS solid FROM t),
cut AS (
SELECT page, pos, t, greatest(0, n - 3) AS tail, list_sort(list_distinct([0, CASE WHEN len(solid) > 1 THEN solid[len(solid) // 2 + 1] - 1 ELSE 0 END, greatest(0, n - 3), n])) AS cuts FROM c)
SELECT page, pos, CAST(k - 1 AS INTEGER) AS k, substr(t, cuts[k] + 1, cuts[k + 1] - cuts[k]) AS text, cuts[k] >= tail AS raised FROM (SELECT *, unnest(range(1, len(cuts))) AS k FROM cut)
"""
_DEBUG = """
SELECT page, '{"page":' || page || ',"lines":[' || string_agg('{"pos":' || pos || ',"text":' || CAST(to_json(text) AS VARCHAR) || ',"bbox":[' || x0 || ',' || y0 || ',' || x1 || ',' || y1 || '],"score":' || score
  || ',"font_pt":' || font_pt || ',"bold":' || bold || ',"stroke_rel":' || round(stroke_rel, 4) || ',"est_pt":' || round(est_pt, 2) || ',"bold_r":' || coalesce(CAST(round(bold_r, 4) AS VARCHAR), 'null')
  || ',"text_rgb":[' || text_r || ',0,0],"bg_rgb":[' || bg_r || ',0,0]}', ',' ORDER BY pos) || ']}' AS json FROM lines GROUP BY page
"""
_FLOOD = f"""{_COLUMNS}, f AS (
SELECT * REPLACE (CASE WHEN pos % 3 = 0 THEN 9.0::DOUBLE ELSE font_pt END AS font_pt), replace(text, ' ', '') AS bare, length(regexp_replace(replace(text, ' ', ''), '[^{C.CJK_CLASS}]', '', 'g')) AS cjk FROM cols),
w AS (
SELECT *, font_pt <= 9 OR (font_pt <= 20 AND length(bare) <= 2 AND cjk = 0) AS frail,
  CASE WHEN font_pt <= 9 THEN NOT (cjk = length(bare) AND length(bare) BETWEEN 2 AND 4 AND score >= 0.85) AND score < 0.94 ELSE (font_pt <= 14 AND score < 0.72) OR (cjk = 0 AND length(bare) <= 3 AND score < 0.75) END AS bad
FROM f),
box AS (SELECT l.page, l.pos, l.angle, l.text, (l.x0 + l.x1) / 2 AS cx, (l.y0 + l.y1) / 2 AS cy, l.x1 - l.x0 AS bw, l.y1 - l.y0 AS bh FROM lines l WHERE abs(l.angle) >= 15 AND NOT regexp_matches(l.text, '{_CJK}')),
decor AS (
SELECT a.page, a.pos AS i, b.pos AS j {_PAIR.format(t='box')} WHERE abs((b.cx - a.cx) * cos(radians(a.angle)) + (b.cy - a.cy) * sin(radians(a.angle))) < (a.bw + b.bw) / 2
  AND abs((b.cy - a.cy) * cos(radians(a.angle)) - (b.cx - a.cx) * sin(radians(a.angle))) < (a.bh + b.bh) / 2),
seed AS (SELECT page, pos FROM w WHERE bad UNION SELECT page, i FROM decor UNION SELECT page, j FROM decor),
by_near AS (
SELECT a.page, a.pos, list(b.pos) AS near, list(b.pos) FILTER (WHERE NOT b.frail) AS strong {_BOTH.format(t='w')}
WHERE a.frail AND b.x0 < a.x1 + 2 * (a.y1 - a.y0) AND b.x1 > a.x0 - 2 * (a.y1 - a.y0) AND b.y0 < a.y1 + 2 * (a.y1 - a.y0) AND b.y1 > a.y0 - 2 * (a.y1 - a.y0) GROUP BY a.page, a.pos),
by_mate AS (
SELECT a.page, a.pos, list(b.pos) AS mates {_BOTH.format(t='w')}
WHERE a.font_pt <= 14 AND a.font_pt = b.font_pt AND abs((a.y1 - a.y0) - (b.y1 - b.y0)) <= 0.3 * {_MAXH} AND {_XO} >= 0.6 * {_MINW} AND -{_YO} <= 0.8 * {_MAXH} GROUP BY a.page, a.pos),
facts AS (
SELECT page, list({{'pos': pos, 'near': coalesce(near, []), 'strong': coalesce(strong, []), 'mates': coalesce(mates, [])}}) AS facts FROM w LEFT JOIN by_near USING (page, pos) LEFT JOIN by_mate USING (page, pos) GROUP BY page),
flood AS (
SELECT page, 0 AS round, list(pos) AS gone FROM seed GROUP BY page
UNION ALL
SELECT page, round + 1, list_concat(gone, more) FROM (
  SELECT s.page, s.round, s.gone, [f.pos for f in facts if NOT list_contains(s.gone, f.pos)
    AND ((len(list_intersect(f.near, s.gone)) > 0 AND len(list_intersect(f.strong, s.gone)) = len(f.strong)) OR len(list_intersect(f.mates, s.gone)) > 0)] AS more
  FROM flood s JOIN facts USING (page)) WHERE len(more) > 0),
last AS (SELECT page, arg_max(gone, round) AS gone FROM flood GROUP BY page)
SELECT w.page, w.pos, coalesce(list_contains(last.gone, w.pos), false) AS dropped FROM w LEFT JOIN last USING (page)
"""


_CORRECT = """, raw AS (SELECT page, pos, score, [w for w in regexp_extract_all(lower(text), '[a-z]+') if length(w) BETWEEN 2 AND 4] AS ws FROM lines),
words AS (SELECT page, pos, score, CAST(k - 1 AS INTEGER) AS k, ws[k] AS w FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS k FROM raw)),
known AS (SELECT page, w AS token, count(*) AS cnt FROM words WHERE score >= 0.8 GROUP BY page, w),
cand AS (SELECT DISTINCT page, w AS cand FROM words c WHERE score < 0.8 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.page = c.page AND k.token = c.w)),
hit AS (
SELECT c.page, c.cand, k.token, k.cnt FROM cand c JOIN known k ON c.page = k.page AND length(c.cand) = length(k.token)
WHERE len([i for i in range(1, length(c.cand) + 1) if substr(c.cand, i, 1) <> substr(k.token, i, 1)]) = 1),
best AS (SELECT *, max(cnt) OVER (PARTITION BY page, cand) AS top FROM hit),
fixed AS (SELECT page, cand, min(token) AS fixed FROM best WHERE cnt = top GROUP BY page, cand HAVING count(*) = 1)
SELECT w.page, w.pos, w.k, CASE WHEN w.score < 0.8 THEN coalesce(f.fixed, w.w) ELSE w.w END AS text FROM words w LEFT JOIN fixed f ON w.page = f.page AND w.w = f.cand
"""


def _sizes() -> str:
    k = "(960.0::DOUBLE / 1728.0::DOUBLE)"
    points = lambda h, ratio: f"(greatest({h} - 6.0::DOUBLE, {h} * 0.6::DOUBLE) * {k} / {ratio})"
    ratio = f"CASE WHEN NOT regexp_matches(text, '[\\x{{2E80}}-\\x{{10FFFF}}]') THEN {_ink()} ELSE 0.875::DOUBLE END"
    return f""", a AS (
SELECT * EXCLUDE (est_pt, font_pt, bold, stroke_rel), y1 - y0 - pos % 5 AS tall, CASE WHEN pos % 13 <> 7 THEN (x1 - x0 - pos % 7) * {k} END AS ink, CASE WHEN pos % 3 = 1 THEN CAST('inf' AS DOUBLE) WHEN pos % 3 = 2 THEN pos % 50 * 2.0::DOUBLE END AS room,
  CASE WHEN pos % 11 <> 3 THEN ((page * 5 + pos) % 9) / 2.0::DOUBLE END AS stroke, x1 - x0 AS wide FROM lines),
b AS (SELECT *, CASE WHEN vertical THEN {points('(20.0::DOUBLE + pos % 9)', '0.875::DOUBLE')} ELSE {points('(tall - page % 3)', f'({ratio})')} END AS pt FROM a),
c AS (SELECT *, CASE WHEN pos % 17 = 2 THEN CASE WHEN pt >= 28 THEN n / 3.0::DOUBLE ELSE n / 2.0::DOUBLE END ELSE {_em()} END AS e FROM b),
d AS (SELECT * REPLACE (CASE WHEN NOT vertical AND e > 0 THEN e END AS e) FROM c),
f AS (
SELECT *, CASE WHEN arc = 0 AND ink IS NOT NULL AND room IS NOT NULL AND NOT isinf(room) THEN ((wide + room) * {k} - 3) / e END AS clamp_pt, CASE WHEN angle = 0 AND arc = 0 THEN (960 - x0 * {k} - 3) / e END AS max_fit_pt,
  CASE WHEN arc <> 0 THEN wide * {k} / e * 0.85::DOUBLE WHEN ink IS NOT NULL AND room IS NULL THEN ink / e * CASE WHEN e <= 8 THEN 1.12::DOUBLE WHEN e >= 12 THEN 1.03::DOUBLE ELSE 1.12::DOUBLE - (e - 8) * (0.09::DOUBLE / 4) END END AS soft FROM d),
g AS (SELECT *, nullif(least(clamp_pt, soft, max_fit_pt), 0) AS lim FROM f),
h AS (SELECT *, least(pt, lim) AS est_pt FROM g),
s1 AS (SELECT *, CASE WHEN lim IS NULL THEN {_snap('est_pt')} ELSE {_ceiled('est_pt', 'lim')} END AS z, {_snap('est_pt')} AS best FROM h),
s2 AS (SELECT * REPLACE (CASE WHEN best > z AND z < best * 0.9::DOUBLE AND best <= soft * 1.03::DOUBLE AND (best - soft) * e <= 3 AND coalesce(best <= max_fit_pt, true) THEN best ELSE z END AS z) FROM s1),
s3 AS (SELECT *, list_max([s for s in {_SIZES} if s < z]) AS less FROM s2),
s4 AS (
SELECT *, CASE WHEN angle = 0 AND arc = 0 AND NOT vertical AND e >= 10 AND z * e > ink * CASE WHEN z >= 28 THEN 1.07::DOUBLE ELSE 1.13::DOUBLE END AND less * e >= ink * 0.9::DOUBLE THEN less ELSE z END AS pts,
  coalesce(stroke / greatest(1.0, tall), 0) AS rel FROM s3),
s5 AS (SELECT *, CASE WHEN pts >= 14 THEN bold_r END AS r FROM s4)
SELECT page, pos, round(est_pt, 6) AS est_pt, round(clamp_pt, 6) AS clamp_pt, round(max_fit_pt, 6) AS max_fit_pt, round(rel, 6) AS stroke_rel, pts AS font_pt, r AS bold_r,
  CASE WHEN vertical THEN pts >= 24 ELSE pts >= 24 OR CASE WHEN r IS NOT NULL AND pts >= 16 AND NOT (text_r > 15 AND text_r < bg_r) THEN r >= 0.13 ELSE rel >= 0.13::DOUBLE END END AS bold FROM s5
"""


def _shapes() -> str:
    ex = lambda x: f"CAST(round_even(({x}) * {C.SLIDE_EMU} / 1728.0::DOUBLE, 0) AS BIGINT)"
    ey = lambda x: f"CAST(round_even(({x}) * 6858000 / 972.0::DOUBLE, 0) AS BIGINT)"
    return f""", b AS (
SELECT page, pos, x0, y0, x1, y1, y1 - y0 AS h, pos % 9 = 8 AS turned, CASE WHEN pos % 5 <> 4 THEN bg_r END AS fill, CAST(round_even(font_pt * 0.2::DOUBLE * 12700, 0) AS BIGINT) AS nudge,
  CASE WHEN pos % 11 = 3 THEN y0 - greatest(8.0, (y1 - y0) * 0.12) WHEN y1 - 4 > 0 THEN y0 + 4 - greatest(4.0, (y1 - y0 - 8) * 0.08) ELSE y0 - 3 END AS c0,
  CASE WHEN pos % 11 = 3 THEN y1 + greatest(8.0, (y1 - y0) * 0.12) WHEN y1 - 4 > 0 THEN y1 - 4 + greatest(4.0, (y1 - y0 - 8) * 0.08) ELSE y1 + 3 END AS c1 FROM lines),
d AS (
SELECT page, CAST(pos AS INTEGER) AS block, turned, fill, nudge, {ex('x0 - 3')} AS l, {ex('x1 + 3')} AS r, {ey('c0')} AS cov0, {ey('c1')} AS cov1, {ey('y0 + 4')} - nudge AS txt,
  {ex('x1 - x0 + 6')} AS tw, {ey('h + 6')} AS th, {ex('(x0 + x1) / 2')} AS mx, {ey('(y0 + y1) / 2')} AS my FROM b),
p AS (SELECT *, NOT turned AND fill IS NOT NULL AND txt < cov0 AS own, CASE WHEN turned THEN my - th // 2 - nudge WHEN NOT turned AND fill IS NOT NULL AND txt < cov0 THEN txt ELSE least(txt, cov0) END AS top FROM d)
SELECT page, block, CAST(0 AS INTEGER) AS z, 'cover' AS kind, 'Text ' || block || ' bg' AS name, greatest(0, l) AS left, greatest(0, cov0) AS top, r - l AS width, cov1 - cov0 AS height, 0.0::DOUBLE AS rotation, fill AS fill_r, CAST(0 AS BIGINT) AS margin_top FROM p WHERE own
UNION ALL
SELECT page, block, CAST(CASE WHEN own THEN 1 ELSE 0 END AS INTEGER), 'text', 'Text ' || block, greatest(0, CASE WHEN turned THEN mx - tw // 2 ELSE l END), greatest(0, top), CASE WHEN turned THEN tw ELSE r - l END,
  CASE WHEN turned THEN th + nudge ELSE cov1 - top END, CASE WHEN turned THEN 12.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN NOT own THEN fill END, CASE WHEN own OR turned THEN 0 ELSE greatest(0, txt - top) END FROM p
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    over = lambda sql: LINES + sql
    q["scan_lines"] = over("SELECT * FROM lines")
    q["page_select"] = over(
        "SELECT CAST(ord AS INTEGER) AS ord, CAST(s.page_no AS BIGINT) AS page_no, coalesce(c.n, 0) AS n_lines FROM (VALUES (1,0),(2,1),(3,2),(4,3),(5,4),(6,7),(7,11),(8,11)) AS s(ord, page_no) "
        "LEFT JOIN (SELECT page, count(*) AS n FROM lines GROUP BY page) c ON c.page = s.page_no"
    )
    q["min_score_filter"] = over("SELECT page, pos, score, text FROM lines WHERE score >= 0.5")
    q["watermark_split"] = over(
        "SELECT page, pos, x0 - (y1 - y0) * 1.8 AS x0, y0 - (y1 - y0) * 0.3 AS y0, x1 + (y1 - y0) * 0.3 AS x1, y1 + (y1 - y0) * 0.3 AS y1 FROM lines "
        "WHERE ends_with(replace(text, ' ', ''), 'n.') AND y0 > 300.0::DOUBLE * 0.85 AND x1 > 800.0::DOUBLE * 0.65"
    )
    bare = "replace(text, ' ', '')"
    cjk = f"length(regexp_replace({bare}, '[^{C.CJK_CLASS}]', '', 'g'))"
    q["illegible_filter"] = over(
        f"SELECT page, pos, CASE WHEN font_pt <= 9 THEN NOT ({cjk} = length({bare}) AND length({bare}) BETWEEN 2 AND 4 AND score >= 0.85) AND score < 0.94 "
        f"ELSE (font_pt <= 14 AND score < 0.72) OR ({cjk} = 0 AND length({bare}) <= 3 AND score < 0.75) END AS illegible, "
        f"font_pt <= 9 OR (font_pt <= 20 AND length({bare}) <= 2 AND NOT regexp_matches({bare}, '{_CJK}')) AS weak FROM lines"
    )
    q["decorative_icon_anti"] = over(
        "SELECT page, pos, text, font_pt FROM lines a WHERE NOT contains(text, ',') AND font_pt >= 28 AND NOT EXISTS "
        "(SELECT 1 FROM lines b WHERE a.page = b.page AND a.pos <> b.pos AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.3 * greatest(1.0, a.y1 - a.y0))"
    )
    q["markup_strike"] = over("SELECT page, pos FROM lines WHERE pos % 5 = 0 OR (contains(text, '==') AND contains(text, '×'))")
    q["axis_label"] = over(f", t AS (SELECT page, pos, text, angle, arc, vertical, x0, x0 + (x1 - x0) / 40 AS x1, y1 - y0 AS h FROM lines) SELECT page, pos, x0, x1 FROM t WHERE angle = 0 AND arc = 0 AND NOT vertical AND h > 2.5 * (x1 - x0) AND regexp_matches(text, '{_ACC}')")
    q["small_line_report"] = over("SELECT page, count(*) FILTER (WHERE font_pt <= 14.0 OR score < 0.8) AS n_small, count(*) AS n_lines FROM lines GROUP BY page HAVING n_small > 0")
    latin = lambda x: f"NOT regexp_matches({x}, '[\\x{{2E80}}-\\x{{10FFFF}}]')"
    conf = "text"
    for wrong, right in C.CONFUSIONS:
        conf = f"replace({conf}, '{wrong}', '{right}')"
    q["text_chain_samples"] = (
        f"SELECT CAST(k AS INTEGER) AS k, text, {_pangu(C.CJK_CLASS)} AS pangu, {_degree('°')} AS degree, {conf} AS confusions, {_bullet('text')} AS bullet, {_FOLD} AS folded, {latin('text')} AS latin, "
        f"round({_em()}, 6) AS em, round({_ink()}, 6) AS ink, CAST(length(regexp_replace(text, '[^{C.CJK_CLASS}]', '', 'g')) AS INTEGER) AS cjk, "
        f"trim(regexp_replace(text, '[^\\x20-\\x7E\\x{{2E80}}-\\x{{9FFF}}\\x{{3000}}-\\x{{30FF}}\\x{{FF00}}-\\x{{FFEF}}]', '', 'g')) AS drawn, regexp_matches(text, '\\[\\^?\\d+\\]$') AS raised FROM {_SAMPLES}"
    )
    q["pangu_spacing"] = over(f"SELECT page, pos, {_pangu('à-öø-ÿ')} AS spaced FROM lines")
    q["trailing_degree"] = over(f"SELECT page, pos, {_degree('.')} AS text FROM lines")
    q["bullet_normalize"] = over(f", t AS (SELECT page, pos, CASE pos % 3 WHEN 0 THEN '·' WHEN 1 THEN '•' ELSE '' END || text AS x FROM lines) SELECT page, pos, {_bullet('x')} AS text FROM t")
    q["text_measures"] = over(
        f"SELECT page, pos, round({_em()}, 6) AS em, round({_ink()}, 6) AS ink, round({_EM_TOL}, 6) AS tolerance, {latin('text')} AS latin, CASE WHEN font_pt >= 28 THEN 'Arial Narrow' ELSE 'Arial' END AS face FROM lines"
    )
    q["page_vocab"] = over(
        ", r AS (SELECT page, unnest(regexp_extract_all(text, '[a-z]+')) AS run FROM lines WHERE score >= 0.8), "
        "g AS (SELECT page, run, k, unnest(range(1, length(run) - k + 2)) AS i FROM r, (VALUES (2), (3), (4)) AS s(k) WHERE length(run) >= k) "
        "SELECT page, substr(run, i, k) AS token, count(*) AS cnt FROM g GROUP BY 1, 2"
    )
    q["vocab_match"] = over(_MATCH)
    q["snap_font_size"] = f"SELECT l_quantity, count(*) AS n, {_snap('l_quantity * 1.3::DOUBLE')} AS snapped FROM lineitem GROUP BY l_quantity"
    q["snap_with_ceiling"] = over(f"SELECT page, pos, {_snap('est_pt')} AS free, {_ceiled('est_pt', '(font_pt - 2.0)')} AS tight, {_ceiled('est_pt', '((font_pt - 2.0) * 1.1::DOUBLE)')} AS loose FROM lines")
    q["px_to_emu"] = over("SELECT page, pos, " + ", ".join(f"CAST(round_even({c} * 12192000 / 1728.0::DOUBLE, 0) AS BIGINT) AS {c}_emu" for c in ("x0", "y0", "x1", "y1")) + " FROM lines")
    pair = "SELECT a.page, a.pos AS i, b.pos AS j "
    q["overlap_pairs"] = over(f"{pair}{_PAIR.format(t='lines')} WHERE {_OVER}")
    q["near_pairs"] = over(f"{pair}{_BOTH.format(t='lines')} WHERE b.x0 < a.x1 + 2 * (a.y1 - a.y0) AND b.x1 > a.x0 - 2 * (a.y1 - a.y0) AND b.y0 < a.y1 + 2 * (a.y1 - a.y0) AND b.y1 > a.y0 - 2 * (a.y1 - a.y0)")
    q["twin_pairs"] = over(f"{_COLUMNS} {pair}{_PAIR.format(t='cols')} WHERE a.font_pt = b.font_pt AND abs((a.y1 - a.y0) - (b.y1 - b.y0)) <= 0.3 * {_MAXH} AND {_XO} >= 0.6 * {_MINW} AND -{_YO} <= 0.8 * {_MAXH}")
    turn = "cos(radians(a.angle))", "sin(radians(a.angle))"
    q["rotated_pairs"] = over(
        ", t AS (SELECT page, pos, text, CAST(pos % 3 * 20 AS DOUBLE) AS angle, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, x1 - x0 AS w, y1 - y0 + 40 AS h FROM lines) "
        f"{pair}{_PAIR.format(t='t')} WHERE a.angle >= 15 AND b.angle >= 15 AND NOT regexp_matches(a.text, '{_CJK}') AND NOT regexp_matches(b.text, '{_CJK}') "
        f"AND abs((b.cx - a.cx) * {turn[0]} + (b.cy - a.cy) * {turn[1]}) < (a.w + b.w) / 2 AND abs((b.cy - a.cy) * {turn[0]} - (b.cx - a.cx) * {turn[1]}) < (a.h + b.h) / 2"
    )
    q["right_neighbor"] = over(f"SELECT a.page, a.pos, arg_min(b.pos, (b.x0, b.pos)) AS nb, min(b.x0) AS nb_x0 {_BOTH.format(t='lines')} WHERE b.x0 > a.x1 AND {_YO} >= 0.5 * {_MINH} GROUP BY a.page, a.pos")
    h = "greatest(1.0, a.y1 - a.y0)"
    q["nearest_above_below"] = over(
        f"SELECT a.page, a.pos, arg_min(b.pos, (-b.y1, b.pos)) FILTER (WHERE b.y1 <= a.y0 + 0.3 * {h}) AS above, "
        f"arg_min(b.pos, (b.y0, b.pos)) FILTER (WHERE NOT b.y1 <= a.y0 + 0.3 * {h} AND b.y0 >= a.y1 - 0.3 * {h}) AS below "
        f"FROM (SELECT * FROM lines WHERE pos % 4 = 2) a LEFT JOIN (SELECT * FROM lines WHERE pos % 4 <> 2) b ON a.page = b.page AND {_XO} >= 0.3 * greatest(1.0, a.x1 - a.x0) GROUP BY a.page, a.pos"
    )
    q["arc_propagate"] = over(
        ", t AS (SELECT * REPLACE (y1 + 60 AS y1, CASE WHEN pos % 5 = 0 THEN 16.0::DOUBLE ELSE 0 END AS arc) FROM lines) "
        f"SELECT a.page, a.pos, arg_min(b.arc * pow((a.x1 - a.x0) / (b.x1 - b.x0), 2), b.pos) AS arc {_BOTH.format(t='t')} WHERE a.arc = 0 AND b.arc <> 0 AND a.y1 - a.y0 >= 80 AND {_XO} > 0.6 * {_MINW} AND {_YO} > 0 GROUP BY a.page, a.pos"
    )
    q["sibling_band_anti"] = over(f"{_BANDS} SELECT page, pos, band, y0, y1 FROM band a WHERE y0 >= 0 AND y1 <= 3000 AND NOT EXISTS (SELECT 1 FROM lines b WHERE a.page = b.page AND {_OVER})")
    q["code_block_siblings"] = over(
        f"{_COLUMNS.replace('x0 / 10', 'x0 / 40')} SELECT a.page, a.pos, arg_min(b.font_pt, b.pos) AS font_pt {_BOTH.format(t='cols')} WHERE a.angle = 0 AND a.arc = 0 AND regexp_matches(a.text, '[qz]') AND NOT regexp_matches(a.text, '{_ACC}') AND {latin('a.text')} AND regexp_matches(b.text, '{_ACC}') AND b.font_pt < a.font_pt "
        f"AND abs(a.x0 - b.x0) <= 0.5 * {_MINH} AND -{_YO} <= 0.6 * {_MINH} AND abs(a.bg_r - b.bg_r) <= 25 AND abs(a.text_r - b.text_r) <= 45 GROUP BY a.page, a.pos"
    )
    q["wrap_groups"] = over(_WRAP)
    q["chip_median_bg"] = over(_CHIP)
    q["bold_cohort_vote"] = over(_VOTE + "SELECT page, pos, font_pt, vote, bold FROM done")
    q["page_bold_summary"] = over(_VOTE + "SELECT page, count(*) AS n_lines, count(*) FILTER (WHERE was) AS n_bold, count(*) FILTER (WHERE bold AND NOT was) AS promoted, count(*) FILTER (WHERE was AND NOT bold) AS demoted FROM done GROUP BY page")
    q["reeval_clamped_bold"] = over(
        "SELECT page, pos, CASE WHEN bold AND font_pt < 24 THEN CASE WHEN bold_r IS NOT NULL AND font_pt >= 16 AND NOT (text_r > 15 AND text_r < bg_r) THEN bold_r >= 0.13 ELSE stroke_rel > 0 AND stroke_rel >= 0.13 END ELSE bold END AS bold FROM lines"
    )
    q["detect_align"] = over(
        ", v AS (SELECT page, font_pt, count(*) AS n, round(var_pop(x0), 6) AS l, round(var_pop((x0 + x1) / 2), 6) AS c, round(var_pop(x1), 6) AS r FROM lines GROUP BY page, font_pt) "
        "SELECT page, font_pt, n, CASE WHEN n < 2 OR (l <= c AND l <= r) THEN 'left' WHEN c <= r THEN 'center' ELSE 'right' END AS align FROM v"
    )
    q["reading_order"] = over("SELECT page, pos, CAST(row_number() OVER (PARTITION BY page ORDER BY y0, x0, pos) AS INTEGER) AS ord FROM lines")
    q["x_order"] = over("SELECT page, pos, CAST(row_number() OVER (PARTITION BY page ORDER BY x0, pos) AS INTEGER) AS ord FROM lines")
    emu = lambda c, of, size: f"CAST(round_even({c} * {size} / {of}::DOUBLE, 0) AS BIGINT)"
    ex, ey = (lambda c: emu(c, "1728.0", C.SLIDE_EMU)), (lambda c: emu(c, "972.0", 6858000))
    marks = q["watermark_split"].removeprefix(LINES)
    q["wipe_rows"] = over(f", m AS ({marks}) SELECT page, pos AS i, greatest(0, {ex('x0')}) AS left, greatest(0, {ey('y0')}) AS top, {ex('x1')} - {ex('x0')} AS width, {ey('y1')} - {ey('y0')} AS height FROM m")
    q["arc_cover_strips"] = over(
        ", a AS (SELECT page, pos AS block, x0, x1, y0 + 10 AS ym, y1 + 10 AS ye, y1 - y0 AS g FROM lines), "
        "s AS (SELECT *, (k + 0.5::DOUBLE) / 12 * 2 - 1 AS t, (x1 - x0) / 2 AS half FROM a, (SELECT unnest(range(0, 12)) AS k)), "
        "b AS (SELECT *, (ye - ym) * 2 * t / half AS slope FROM s) "
        "SELECT page, block, CAST(k AS INTEGER) AS k, round((x0 + x1) / 2 + half * t, 6) AS cx, round(ym + (ye - ym) * t * t, 6) AS cy, round(half * 2 / 12 * sqrt(slope * slope + 1), 6) AS w, "
        "round(g * 1.5, 6) AS h, round(degrees(atan(slope)), 6) AS rotation FROM b"
    )
    q["row_title_merge"] = over(_TITLES)
    q["color_runs"], q["mean_segments"], q["split_text_runs"], q["debug_json"], q["junk_flood"], q["shape_rows"] = map(over, (_COLOURS, _MEANS, _PIECES, _DEBUG, _FLOOD, _shapes()))
    q["vocab_correct"], q["style_sizes"] = over(_CORRECT), over(_sizes())
    q["longest_run"], q["role_runs"], q["gap_split"] = _RUNS, _ROLES, _GAPS
    q["prefix_cuts"] = over(
        ", c AS (SELECT page, pos, n, sum(n) OVER (PARTITION BY page ORDER BY pos ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER (PARTITION BY page) AS total FROM lines) "
        "SELECT page, pos, CAST(least(before * 4 // total, 3) AS BIGINT) AS part FROM c"
    )
    q["quantized_mode"] = (
        "WITH x AS (SELECT vec_id, CAST(floor((CAST(unnest(embedding) AS DOUBLE) + 1) * 8) AS BIGINT) AS level FROM embeddings), c AS (SELECT vec_id, level, count(*) AS c FROM x GROUP BY 1, 2) "
        "SELECT vec_id, arg_min(level, (-c, level)) AS level, max(c) AS c FROM c GROUP BY vec_id"
    )
    return q
