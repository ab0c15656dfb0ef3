"""SQL twins of the page-wise layout steps: folds over each page's list of boxes.

A page is a list ``b`` of structs (i, n, x0, y0, x1, y1) from top to bottom, i from 1.
Every fold is a ``list_reduce`` whose first argument is the state.
"""

from __future__ import annotations

from pagewright.derive import COS, SIN
from pagewright.queries.texts import sep_sql

D = "::DOUBLE"
NO_INTS, NO_LISTS = "[]::BIGINT[]", "[]::BIGINT[][]"


def boxes_sql(source: str, number: str = "block_no") -> str:
    """upright(doc_id, page, n, text, score, x0, y0, x1, y1): boxes of a table with corners px..sy, turned back by the median angle of their page."""
    sides = "sqrt((qx-px)*(qx-px)+(qy-py)*(qy-py)) AS w, sqrt((rx-qx)*(rx-qx)+(ry-qy)*(ry-qy)) AS h"
    angle = "CASE WHEN w < h THEN atan2(ry-qy, rx-qx) ELSE atan2(qy-py, qx-px) END"
    folded = "CASE WHEN g < -pi()/2 + radians(3) THEN g + pi() WHEN g >= pi()/2 + radians(3) THEN g - pi() ELSE g END"
    back = ", ".join(f"CASE WHEN abs(r) <= radians(3) THEN {n}x ELSE cos(-r)*{n}x - sin(-r)*{n}y END AS {n}u, CASE WHEN abs(r) <= radians(3) THEN {n}y ELSE sin(-r)*{n}x + cos(-r)*{n}y END AS {n}v" for n in "pqrs")
    return f"""turning AS (SELECT *, median(a) OVER (PARTITION BY doc_id, page) AS r FROM (SELECT *, {folded} AS a FROM (SELECT *, {angle} AS g FROM (SELECT *, {sides} FROM {source} WHERE text <> '')))),
upright AS MATERIALIZED (SELECT doc_id, page, {number} AS n, text, score, l - CASE WHEN moved THEN ml ELSE 0 END AS x0, t - CASE WHEN moved THEN mt ELSE 0 END AS y0, z - CASE WHEN moved THEN ml ELSE 0 END AS x1, o - CASE WHEN moved THEN mt ELSE 0 END AS y1 FROM (
SELECT *, abs(r) > radians(3) AND (ml < 0 OR mt < 0) AS moved FROM (SELECT *, min(l) OVER (PARTITION BY doc_id, page) AS ml, min(t) OVER (PARTITION BY doc_id, page) AS mt FROM (
SELECT *, least(pu, qu, ru, su) AS l, least(pv, qv, rv, sv) AS t, greatest(pu, qu, ru, su) AS z, greatest(pv, qv, rv, sv) AS o FROM (SELECT *, {back} FROM turning))))),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, n) AS i FROM upright),
sheets AS MATERIALIZED (SELECT doc_id, page, list({{'i': i, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY i) AS b, list({{'i': i, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} ORDER BY x0, y0, i) AS o FROM placed GROUP BY doc_id, page)"""


def _fits(a: str, c: str, x: str) -> str:
    """Whether box ``c`` stands on the line that box ``x`` opened and whose right edge is ``a``."""
    h, other = f"({x}.y1 - {x}.y0)", f"({c}.y1 - {c}.y0)"
    return f"{c}.x0 >= {a} - {h} AND {c}.y0 >= {x}.y0 - {h} * 0.5{D} AND {c}.y1 <= {x}.y1 + {h} * 0.5{D} AND abs({h} - {other}) <= least({h}, {other}) * 0.5{D}"


_LINE = f"list_reduce(o, lambda a, c: CASE WHEN NOT list_contains(s.t, c.i) AND NOT list_contains(a.m, c.i) AND {_fits('a.e', 'c', 'x')} THEN {{'e': c.x1, 'm': list_append(a.m, c.i)}} ELSE a END, {{'e': x.x1, 'm': [x.i]}}).m"
#: found(doc_id, page, b, l): lines as lists of i by the top of their first box.
LINES = f"""found AS MATERIALIZED (SELECT doc_id, page, b, list_transform(list_sort(list_transform(l, lambda m, k: {{'y': b[m[1]].y0, 'k': k, 'm': m}})), lambda v: v.m) AS l FROM (
SELECT doc_id, page, b, list_reduce(o, lambda s, x: CASE WHEN list_contains(s.t, x.i) THEN s ELSE list_transform([{_LINE}], lambda m: {{'t': list_concat(s.t, m), 'l': list_append(s.l, m)}})[1] END, {{'t': {NO_INTS}, 'l': {NO_LISTS}}}).l AS l FROM sheets)),
lined AS MATERIALIZED (SELECT doc_id, page, line, m, k, m[k] AS i, row_number() OVER (PARTITION BY doc_id, page ORDER BY line, k) - 1 AS seq FROM (SELECT doc_id, page, line - 1 AS line, l[line] AS m FROM found, range(1, len(l) + 1) r(line)), range(1, len(m) + 1) q(k)),
laid AS MATERIALIZED (SELECT doc_id, page, n, seq, line, x0, y0, x1, y1, text, score FROM lined JOIN placed USING (doc_id, page, i)),
seps AS MATERIALIZED (SELECT *, CASE WHEN nt IS NULL THEN chr(10) WHEN nx - x1 > (y1 + ny - y0 - nx) * 0.5{D} * 1.5{D} THEN ' ' ELSE {sep_sql('text', 'nt')} END AS sep FROM (
SELECT *, lead(x0) OVER w AS nx, lead(y1) OVER w AS ny, lead(text) OVER w AS nt FROM laid WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY seq)))"""


def paragraphs_sql(boxes: str, order: str) -> str:
    """Paragraphs (lists of places in ``boxes``) of the places ``order``, which come from top to bottom."""
    box = lambda i: f"{boxes}[{i}]"
    x = box("i")
    same = f"len(s.m) > 0 AND abs(s.l - {x}.x0) <= s.h * 1.2{D} AND abs(s.r - {x}.x1) <= s.h * 1.2{D} AND (s.s IS NULL OR {x}.y0 - s.b < s.s + s.h * 0.5{D})"
    grown = f"{{'out': s.out, 'm': list_append(s.m, i), 'l': (s.l + {x}.x0) / 2, 'r': (s.r + {x}.x1) / 2, 'h': (s.h + ({x}.y1 - {x}.y0)) / 2, 's': CASE WHEN s.s IS NULL THEN {x}.y0 - s.b ELSE (s.s + ({x}.y0 - s.b)) / 2 END, 'b': {x}.y1}}"
    closed = "CASE WHEN len(s.m) > 0 THEN list_append(s.out, {'m': s.m, 's': s.s}) ELSE s.out END"
    fresh = f"{{'out': {closed}, 'm': [i], 'l': {x}.x0, 'r': {x}.x1, 'h': {x}.y1 - {x}.y0, 's': NULL{D}, 'b': {x}.y1}}"
    start = f"{{'out': []::STRUCT(m BIGINT[], s DOUBLE)[], 'm': {NO_INTS}, 'l': 0{D}, 'r': 0{D}, 'h': 0{D}, 's': NULL{D}, 'b': 0{D}}}"
    bodies = f"list_transform([list_reduce({order}, lambda s, i: CASE WHEN {same} THEN {grown} ELSE {fresh} END, {start})], lambda s: {closed})[1]"
    # A single line i of paragraph k, the last line of the one above it and the first of the one below.
    i, last, first = box("f[k].m[1]"), box("f[k - 1].m[-1]"), box("f[k + 1].m[1]")
    h, g = f"({last}.y1 - {last}.y0)", f"({first}.y1 - {first}.y0)"
    up = f"k > 1 AND abs({last}.x0 - {i}.x0) <= {h} * 1.2{D} AND {i}.x1 <= {last}.x1 + {h} * 1.2{D} AND NOT (f[k - 1].s IS NOT NULL AND {i}.y0 - {last}.y1 > f[k - 1].s + {h} * 0.5{D})"
    reaches = f"CASE WHEN len(f[k + 1].m) > 1 THEN abs({first}.x1 - {i}.x1) <= {g} * 1.2{D} ELSE {first}.x1 - {g} * 1.2{D} < {i}.x1 END"
    down = f"k < len(f) AND {first}.x0 - {g} * 1.2{D} <= {i}.x0 AND {i}.x0 <= {first}.x0 + {g} * (1 + 1.2{D}) AND {reaches} AND NOT (f[k + 1].s IS NOT NULL AND {first}.y0 - {i}.y1 > f[k + 1].s + {g} * 0.5{D})"
    nearer = f"{i}.y0 - {last}.y1 < {first}.y0 - {i}.y1"
    upward = "list_concat(list_append(f[1:k - 2], {'m': list_append(f[k - 1].m, f[k].m[1]), 's': f[k - 1].s}), f[k + 1:])"
    downward = "list_concat(list_append(f[1:k - 1], {'m': list_prepend(f[k].m[1], f[k + 1].m), 's': f[k + 1].s}), f[k + 2:])"
    step = f"CASE WHEN len(f[k].m) > 1 THEN f WHEN coalesce({up}, false) AND (NOT coalesce({down}, false) OR {nearer}) THEN {upward} WHEN coalesce({down}, false) THEN {downward} ELSE f END"
    merged = f"list_transform([{bodies}], lambda f0: list_reduce(list_reverse(range(1, len(f0) + 1)), lambda f, k: {step}, f0))[1]"
    return f"list_transform({merged}, lambda p: p.m)"


#: hulls(doc_id, page, l, e): envelopes of lines; paras(doc_id, page, line, para).
SINGLE_PARA = f"""hulls AS MATERIALIZED (SELECT doc_id, page, l, list_transform(l, lambda m: list_transform([list_min(list_transform(m, lambda i: b[i].y0))], lambda t: {{'x0': b[m[1]].x0, 'y0': t, 'x1': CASE WHEN len(m) > 1 THEN greatest(t, b[m[-1]].x1) ELSE b[m[-1]].x1 END, 'y1': CASE WHEN len(m) > 1 THEN greatest(t, b[m[-1]].y1) ELSE b[m[-1]].y1 END}})[1]) AS e FROM found),
ranked AS MATERIALIZED (SELECT doc_id, page, e, list_transform(list_sort(list_transform(range(1, len(e) + 1), lambda i: {{'y': e[i].y0, 'i': i}})), lambda v: v.i) AS o FROM hulls),
parted AS MATERIALIZED (SELECT doc_id, page, {paragraphs_sql('e', 'o')} AS p FROM ranked),
paras AS MATERIALIZED (SELECT doc_id, page, p[q][k] - 1 AS line, q - 1 AS para FROM parted, range(1, len(p) + 1) r(q), range(1, len(p[q]) + 1) v(k))"""

_ROWS = f"list_reduce(b, lambda s, x: CASE WHEN x.y0 > s.f THEN {{'r': list_append(s.r, [x.i]), 'f': x.y1}} ELSE {{'r': list_append(s.r[1:len(s.r) - 1], list_append(s.r[-1], x.i)), 'f': s.f}} END, {{'r': {NO_LISTS}, 'f': '-infinity'{D}}}).r"
_SPAN = "STRUCT(l DOUBLE, r DOUBLE)"
_FREE = f"list_transform([list_reduce(m, lambda s, i: {{'out': CASE WHEN b[i].x0 > s.e THEN list_append(s.out, {{'l': s.e, 'r': b[i].x0}}) ELSE s.out END, 'e': greatest(s.e, b[i].x1)}}, {{'out': []::{_SPAN}[], 'e': lm}})], lambda s: list_append(s.out, {{'l': s.e, 'r': rm}}))[1]"
_SHARED = "flatten(list_transform(range(1, len(s.held) + 1), lambda i: list_transform(list_filter(range(1, len(gaps[k]) + 1), lambda j: greatest(s.held[i].l, gaps[k][j].l) <= least(s.held[i].r, gaps[k][j].r)), lambda j: {'i': i, 'j': j, 'l': greatest(s.held[i].l, gaps[k][j].l), 'r': least(s.held[i].r, gaps[k][j].r), 'f': s.held[i].f})))"
_CLOSED = "list_concat(s.closed, list_transform(list_filter(range(1, len(s.held) + 1), lambda i: NOT list_contains(list_transform(h, lambda v: v.i), i)), lambda i: {'l': s.held[i].l, 'r': s.held[i].r, 'f': s.held[i].f, 'z': k - 1}))"
_HELD = "list_concat(list_transform(h, lambda v: {'l': v.l, 'r': v.r, 'f': v.f}), list_transform(list_filter(range(1, len(gaps[k]) + 1), lambda j: NOT list_contains(list_transform(h, lambda v: v.j), j)), lambda j: {'l': gaps[k][j].l, 'r': gaps[k][j].r, 'f': k}))"
_CUT = "STRUCT(l DOUBLE, r DOUBLE, f BIGINT, z BIGINT)"
_GUTTERS = f"list_transform([list_reduce(range(1, len(gaps) + 1), lambda s, k: list_transform([{_SHARED}], lambda h: {{'closed': {_CLOSED}, 'held': {_HELD}}})[1], {{'closed': []::{_CUT}[], 'held': []::STRUCT(l DOUBLE, r DOUBLE, f BIGINT)[]}})], lambda s: list_concat(s.closed, list_transform(s.held, lambda v: {{'l': v.l, 'r': v.r, 'f': v.f, 'z': len(gaps)}})))[1]"
_REGION = "STRUCT(l DOUBLE, r DOUBLE, t BIGINT, b BIGINT, m BIGINT[])"
_GOES_ON = "list_contains(list_transform(cut[k], lambda c: c.r), g.l) AND list_contains(list_transform(cut[k], lambda c: c.l), g.r) AND len(list_filter(cut[k], lambda c: (c.l > g.l AND c.l < g.r) OR (c.r > g.l AND c.r < g.r))) = 0"
#: Which interval of row k a box belongs to: the first whose right gutter begins at or after its left edge.
_AT = "len(list_filter(cut[k][2:], lambda c: c.l < b[i].x0 + 0.0001::DOUBLE))"
_ADDED = f"list_reduce(rows[k], lambda a, i: list_transform([{_AT}], lambda w: list_transform([{{'l': cut[k][w + 1].r, 'r': cut[k][w + 2].l}}], lambda y: CASE WHEN len(list_filter(a, lambda g: g.l = y.l AND g.r = y.r)) > 0 THEN list_transform(a, lambda g: CASE WHEN g.l = y.l AND g.r = y.r THEN {{'l': g.l, 'r': g.r, 't': g.t, 'b': g.b, 'm': list_append(g.m, i)}} ELSE g END) ELSE list_append(a, {{'l': y.l, 'r': y.r, 't': k, 'b': k, 'm': [i]}}) END)[1])[1], list_transform(list_filter(s.growing, lambda g: {_GOES_ON}), lambda g: {{'l': g.l, 'r': g.r, 't': g.t, 'b': k, 'm': g.m}}))"
_REGIONS = f"list_transform([list_reduce(range(1, len(rows) + 1), lambda s, k: {{'done': list_concat(s.done, list_filter(s.growing, lambda g: NOT ({_GOES_ON}))), 'growing': {_ADDED}}}, {{'done': []::{_REGION}[], 'growing': []::{_REGION}[]}})], lambda s: list_concat(s.done, s.growing))[1]"
_ABOVE = "list_filter(range(0, len(d) + 1), lambda c: CASE WHEN c = 0 THEN 0 < d[n].t AND edge[1] - 1 <= d[n].r - 2 AND d[n].r - 2 <= edge[2] + 1 + 0.0001::DOUBLE ELSE d[c].b < d[n].t AND d[c].l <= d[n].r - 2 AND d[n].r - 2 <= d[c].r + 0.0001::DOUBLE END)"
_PARENT = f"list_reverse(list_sort(list_transform({_ABOVE}, lambda c: {{'b': CASE WHEN c = 0 THEN 0 ELSE d[c].b END, 'r': CASE WHEN c = 0 THEN edge[2] + 1 ELSE d[c].r END, 'n': -c}})))[1].n"
_PATHS = "list_reduce(range(1, len(d) + 1), lambda p, n: list_append(p, list_append(CASE WHEN above[n] = 0 THEN []::STRUCT(l DOUBLE, n BIGINT)[] ELSE p[-above[n]] END, {'l': d[n].l, 'n': n})), []::STRUCT(l DOUBLE, n BIGINT)[][])"
#: ordered(doc_id, page, b, d): regions in reading order with their boxes from top to bottom; laid_out: a row a box.
REGIONS = f"""rowed AS MATERIALIZED (SELECT doc_id, page, b, list_min(list_transform(b, lambda x: x.x0)) - 1 AS lm, list_max(list_transform(b, lambda x: x.x1)) + 1 AS rm, list_transform({_ROWS}, lambda m: list_transform(list_sort(list_transform(m, lambda i: {{'x0': b[i].x0, 'x1': b[i].x1, 'i': i}})), lambda v: v.i)) AS rows FROM sheets),
gapped AS MATERIALIZED (SELECT *, list_transform(rows, lambda m: {_FREE}) AS gaps FROM rowed),
guttered AS MATERIALIZED (SELECT doc_id, page, b, rows, list_transform(list_sort(list_transform({_GUTTERS}, lambda c, k: {{'l': c.l, 'k': k, 'r': c.r, 'f': c.f, 'z': c.z}})), lambda v: {{'l': v.l, 'r': v.r, 'f': v.f, 'z': v.z}}) AS cuts FROM gapped),
on_rows AS MATERIALIZED (SELECT doc_id, page, b, rows, [cuts[1].l, cuts[-1].r] AS edge, list_transform(range(1, len(rows) + 1), lambda k: list_filter(cuts, lambda c: c.f <= k AND k <= c.z)) AS cut FROM guttered),
regioned AS MATERIALIZED (SELECT doc_id, page, b, edge, {_REGIONS} AS d FROM on_rows),
climbed AS MATERIALIZED (SELECT *, list_transform(range(1, len(d) + 1), lambda n: {_PARENT}) AS above FROM regioned),
ordered AS MATERIALIZED (SELECT doc_id, page, b, list_transform(list_sort(list_transform({_PATHS}, lambda p, n: {{'p': p, 'n': n}})), lambda v: list_transform(list_sort(list_transform(d[v.n].m, lambda i, k: {{'y': b[i].y0, 'k': k, 'i': i}})), lambda w: w.i)) AS d FROM climbed),
laid AS MATERIALIZED (SELECT doc_id, page, n, seq, region, x0, y0, x1, y1, text, score FROM (SELECT doc_id, page, q - 1 AS region, d[q][k] AS i, row_number() OVER (PARTITION BY doc_id, page ORDER BY q, k) - 1 AS seq FROM ordered, range(1, len(d) + 1) r(q), range(1, len(d[q]) + 1) v(k)) JOIN placed USING (doc_id, page, i))"""
#: paras(doc_id, page, n, para): paragraphs of all regions, counted over the page.
MULTI_PARA = f"""split AS MATERIALIZED (SELECT doc_id, page, b, q, d[q] AS o FROM ordered, range(1, len(d) + 1) r(q)),
parted AS MATERIALIZED (SELECT doc_id, page, q, {paragraphs_sql('b', 'o')} AS p FROM split),
paras AS MATERIALIZED (SELECT doc_id, page, n, (start + v - 1)::INTEGER AS para FROM (SELECT doc_id, page, p, v, start, p[v][k] AS i FROM (SELECT doc_id, page, p, coalesce(sum(len(p)) OVER (PARTITION BY doc_id, page ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM parted), range(1, len(p) + 1) r(v), range(1, len(p[v]) + 1) w(k)) JOIN placed USING (doc_id, page, i))"""


def _select(region: str, line: str, para: str, sep: str, source: str) -> str:
    return f"SELECT doc_id, page, n AS block_no, seq::INTEGER AS seq, {region}::INTEGER AS region, {line}::INTEGER AS line, {para}::INTEGER AS para, {sep} AS sep FROM {source}"


def _corners(source: str) -> str:
    """``source`` with the corners of its boxes, turned where doc_id is a multiple of 5."""
    sides = (("p", "x0", "y0"), ("q", "x1", "y0"), ("r", "x1", "y1"), ("s", "x0", "y1"))
    return "SELECT *, " + ", ".join(f"CASE WHEN doc_id % 5 = 0 THEN {x} * {COS!r}{D} - {y} * {SIN!r}{D} ELSE {x} END AS {n}x, CASE WHEN doc_id % 5 = 0 THEN {x} * {SIN!r}{D} + {y} * {COS!r}{D} ELSE {y} END AS {n}y" for n, x, y in sides) + f" FROM ({source})"


def _straight(source: str) -> str:
    """``source`` with the corners of its boxes."""
    return f"SELECT *, x0 AS px, y0 AS py, x1 AS qx, y0 AS qy, x1 AS rx, y1 AS ry, x0 AS sx, y1 AS sy FROM ({source})"


_APART = f"apart AS ({_corners('SELECT * REPLACE (x0 + CASE WHEN chunk_no = 0 THEN 2 ELSE 0 END AS x0, x1 + CASE WHEN chunk_no = 0 THEN 2 ELSE 0 END AS x1) FROM blocks')})"
_NEXT = f"CASE WHEN nt IS NULL THEN chr(10) ELSE {sep_sql('text', 'nt')} END"
_SINGLE, _MULTI = (f", {_APART}, {boxes_sql('apart')}, {steps}" for steps in (LINES, REGIONS))
SQL = {
    "single_line": f"{_SINGLE} {_select('0', 'line', 'line', 'sep', 'seps')}",
    "single_none": f"{_SINGLE} {_select('0', 'line', 'line', f'CASE WHEN pt IS NULL OR sep <> chr(10) THEN sep ELSE {sep_sql("text", "pt")} END', '(SELECT *, lead(text) OVER (PARTITION BY doc_id, page ORDER BY seq) AS pt FROM seps)')}",
    "single_para": f"""{_SINGLE}, {SINGLE_PARA}, last_of AS (SELECT *, lead(first_text) OVER (PARTITION BY doc_id, page, para, ends ORDER BY top, line) AS following FROM (SELECT s.*, para, min(y0) OVER l AS top, first_value(text) OVER (PARTITION BY s.doc_id, s.page, s.line ORDER BY seq) AS first_text, seq = max(seq) OVER l AS ends FROM seps s JOIN paras p ON p.doc_id = s.doc_id AND p.page = s.page AND p.line = s.line WINDOW l AS (PARTITION BY s.doc_id, s.page, s.line)))
{_select('0', 'line', 'para', f'CASE WHEN NOT ends THEN sep WHEN following IS NULL THEN chr(10) ELSE {sep_sql("text", "following")} END', 'last_of')}""",
    "multi_line": f"{_MULTI} {_select('region', '0', 'seq', 'chr(10)', 'laid')}",
    "multi_none": f"{_MULTI} {_select('region', '0', 'seq', _NEXT, '(SELECT *, lead(text) OVER (PARTITION BY doc_id, page ORDER BY seq) AS nt FROM laid)')}",
    "multi_para": f"{_MULTI}, {MULTI_PARA} {_select('region', '0', 'para', _NEXT, '(SELECT l.*, para, lead(text) OVER (PARTITION BY l.doc_id, l.page, para ORDER BY y0, seq) AS nt FROM laid l JOIN paras p ON p.doc_id = l.doc_id AND p.page = l.page AND p.n = l.n)')}",
}
_CODE = f"""coded AS MATERIALIZED (SELECT doc_id, page, line, list_reduce(c[2:], lambda s, x: list_transform([(s.h + x.y1 - x.y0) / 2], lambda h: {{'x0': least(s.x0, x.x0), 'y0': least(s.y0, x.y0), 'x1': greatest(s.x1, x.x1), 'y1': greatest(s.y1, x.y1), 'h': h, 't': s.t || repeat('  ', CASE WHEN x.x0 > s.x1 THEN round_even((x.x0 - s.x1) / h, 0)::BIGINT ELSE 0 END) || x.t}})[1], c[1]) AS m FROM (
SELECT doc_id, page, line, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'h': y1 - y0, 't': text}} ORDER BY seq) AS c FROM laid GROUP BY doc_id, page, line))"""
SQL["single_code"] = f""", straight AS ({_straight('FROM blocks')}), {boxes_sql('straight')}, {LINES}, {_CODE} SELECT doc_id, page, line::INTEGER AS line, repeat('  ', greatest(level, 0)) || t AS text, level, chr(10) AS sep FROM (
SELECT *, least(ceil((z - a) / h), ceil((x + h / 2 - a) / h))::INTEGER - 1 AS level FROM (SELECT doc_id, page, line, m.t AS t, m.x0 AS x, avg(m.y1 - m.y0) OVER w AS h, min(m.x0) OVER w AS a, max(m.x0) OVER w AS z FROM coded WINDOW w AS (PARTITION BY doc_id, page)))"""
SQL["regions"] = f"{_MULTI} SELECT doc_id, page, region::INTEGER AS region, count(*) AS n, round(min(x0), 3) AS x0, round(min(y0), 3) AS y0, round(max(x1), 3) AS x1, round(max(y1), 3) AS y1, min(seq)::INTEGER AS first FROM laid GROUP BY doc_id, page, region"
SQL["paragraph_merge"] = f"{_MULTI}, {MULTI_PARA} SELECT doc_id, page, region::INTEGER AS region, para, count(*) AS n_lines FROM laid l JOIN paras p USING (doc_id, page, n) GROUP BY doc_id, page, region, para"

_SPUN = f"spun AS ({_straight('SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_id, frag_no) AS block_no FROM fragments')})"
SQL["line_groups"] = f", {_SPUN}, {boxes_sql('spun')}, {LINES} SELECT doc_id, page, n AS block_no, seq::INTEGER AS seq, line::INTEGER AS line, sep FROM seps"

#: The same folds over pages of many kinds.
VARIED = {name: SQL[name].replace(_APART, f"apart AS ({_straight('FROM varied')})") for name in ("multi_para", "single_para", "single_none", "regions", "paragraph_merge")}
