"""DuckDB statements for the network queries, written from the definitions and without the grid."""

from __future__ import annotations

from ..functions import dims
from .fixtures import ctes

rad = lambda x: f"(({x}) * pi() / 180.0)"


def hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin({rad(f'({c}) - ({a})')} / 2), 2) + cos({rad(a)}) * cos({rad(c)}) * pow(sin({rad(f'({d}) - ({b})')} / 2), 2))"
    return f"(12742000.0 * atan2(sqrt({h}), sqrt(1.0 - {h})))"


def bear(a: str, b: str, c: str, d: str) -> str:
    x = rad(f"({d}) - ({b})")
    return f"(atan2(sin({x}) * cos({rad(c)}), cos({rad(a)}) * sin({rad(c)}) - sin({rad(a)}) * cos({rad(c)}) * cos({x})) * 180.0 / pi())"


def proj_t(p: str, q: str, a: str, b: str, c: str, d: str) -> str:
    k = f"cos({rad(p)})"
    dx, dy, px, py = f"(({d} - {b}) * {k})", f"({c} - {a})", f"(({q} - {b}) * {k})", f"({p} - {a})"
    s = f"({dx} * {dx} + {dy} * {dy})"
    return f"(CASE WHEN {s} < 1e-12 THEN 0.0 ELSE greatest(0.0, least(1.0, ({px} * {dx} + {py} * {dy}) / {s})) END)"


def seg_d(p: str, q: str, a: str, b: str, c: str, d: str) -> str:
    t = proj_t(p, q, a, b, c, d)
    return hav(p, q, f"{a} + {t} * ({c} - {a})", f"{b} + {t} * ({d} - {b})")


def fixed(x: str, digits: int) -> str:
    bits = {4: 49, 1: 59}[digits]
    n = f"((CAST((abs({x}) - floor(abs({x}))) * {1 << bits} AS BIGINT) * {10**digits} + {1 << (bits - 1)}) >> {bits})"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs({x})) AS BIGINT) + {n} // {10**digits} AS VARCHAR) || '.' || lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0'))"


def key(lat: str, lng: str) -> str:
    return f"({fixed(lat, 4)} || ',' || {fixed(lng, 4)})"


def half_up(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def crosses(a: str, b: str, c: str, d: str, e: str, f: str, g: str, h: str) -> str:
    k = f"cos({rad(f'({a} + {c} + {e} + {g}) / 4')})"
    side = lambda oa, ob, pa, pb, qa, qb: f"(({pb} - {ob}) * {k} * ({qa} - {oa}) - ({pa} - {oa}) * ({qb} - {ob}) * {k})"
    return f"({side(e, f, g, h, a, b)} * {side(e, f, g, h, c, d)} < 0 AND {side(a, b, c, d, e, f)} * {side(a, b, c, d, g, h)} < 0)"


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def case(x: str, values: dict, other: str) -> str:
    return f"(CASE {x} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {other} END)"


OD = ("start_lat", "start_lng", "end_lat", "end_lng")
TIER = case("ct", {ct: t for t, cts in dims.TIERS.items() for ct in cts}, "NULL")
COST = f"greatest(distance * {case('ct', dims.WEIGHTS, '3.0')}, {case('ct', dims.MIN_COSTS, '0.0')})"
MAJOR = in_list(dims.MAJOR_ROADS)

#: Derived tables, each with the fixtures and tables that it is made from.
DERIVED = {
    "o_seg": (["fx_vertices"], """
        SELECT sid, part, k, lat1, lng1, lat2, lng2 FROM (
          SELECT sid, part, seq AS k, lag(lat) OVER w AS lat1, lag(lng) OVER w AS lng1, lat AS lat2, lng AS lng2
          FROM fx_vertices WINDOW w AS (PARTITION BY sid, part ORDER BY seq)) WHERE lat1 IS NOT NULL"""),
    "o_net": (["fx_vertices", "fx_lines", "o_seg"], f"""
        SELECT *, least(a_key, b_key) || '|' || greatest(a_key, b_key) AS key FROM (
          SELECT l.sid, l.part, a_lat, a_lng, b_lat, b_lng, {key('a_lat', 'a_lng')} AS a_key, {key('b_lat', 'b_lng')} AS b_key, distance, upper(ct_raw) AS ct, name
          FROM (SELECT sid, part, arg_min(lat, seq) AS a_lat, arg_min(lng, seq) AS a_lng, arg_max(lat, seq) AS b_lat, arg_max(lng, seq) AS b_lng FROM fx_vertices GROUP BY sid, part) l
          JOIN (SELECT sid, part, sum({hav('lat1', 'lng1', 'lat2', 'lng2')}) AS distance FROM o_seg GROUP BY sid, part) d ON l.sid = d.sid AND l.part = d.part
          JOIN fx_lines f ON f.sid = l.sid)"""),
    "o_edge": (["o_net"], """
        SELECT sid, part, 0 AS dir, a_key AS src, b_key AS dst, key, ct, name, distance FROM o_net WHERE a_key <> b_key
        UNION ALL SELECT sid, part, 1, b_key, a_key, key, ct, name, distance FROM o_net WHERE a_key <> b_key"""),
    "o_node": (["o_net"], """
        SELECT *, CAST(floor(lat * 1000) AS BIGINT) AS cy, CAST(floor(lng * 1000) AS BIGINT) AS cx FROM (
          SELECT node_key, arg_min(lat, ord) AS lat, arg_min(lng, ord) AS lng FROM (
            SELECT a_key AS node_key, a_lat AS lat, a_lng AS lng, sid * 4 + part * 2 AS ord FROM o_net
            UNION ALL SELECT b_key, b_lat, b_lng, sid * 4 + part * 2 + 1 FROM o_net) GROUP BY node_key)"""),
    "o_road": (["fx_road_vertices"], f"""
        SELECT road, k, highway, CASE WHEN highway IN {MAJOR} THEN 2 ELSE 1 END AS rank, lat1, lng1, lat2, lng2 FROM (
          SELECT road, seq AS k, highway, lag(lat) OVER w AS lat1, lag(lng) OVER w AS lng1, lat AS lat2, lng AS lng2
          FROM fx_road_vertices WINDOW w AS (PARTITION BY road ORDER BY seq)) WHERE lat1 IS NOT NULL"""),
    "o_gap": (["o_node", "o_net"], f"""
        SELECT * FROM (
          SELECT a.node_key || '|' || b.node_key AS key, a.node_key AS a_key, b.node_key AS b_key, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS distance, a.lat AS lat1, a.lng AS lng1, b.lat AS lat2, b.lng AS lng2
          FROM o_node a JOIN o_node b ON a.node_key < b.node_key AND b.cy BETWEEN a.cy - 3 AND a.cy + 3 AND b.cx BETWEEN a.cx - 3 AND a.cx + 3)
        WHERE distance <= 250 AND key NOT IN (SELECT key FROM o_net WHERE a_key <> b_key)"""),
    "o_gap_ct": (["o_gap", "o_road"], f"""
        SELECT g.*, CASE rank WHEN 2 THEN '_GAP_MAJOR' WHEN 1 THEN '_GAP_BUSY' ELSE '_GAP' END AS ct FROM o_gap g LEFT JOIN (
          SELECT key AS k, max(rank) AS rank FROM o_gap g JOIN o_road r ON {crosses('g.lat1', 'g.lng1', 'g.lat2', 'g.lng2', 'r.lat1', 'r.lng1', 'r.lat2', 'r.lng2')} GROUP BY key) w ON g.key = w.k"""),
    "o_ask": (["fx_points", "fx_od"], """
        SELECT pid, lat, lng FROM fx_points
        UNION ALL SELECT -1 - od_id * 2, start_lat, start_lng FROM fx_od UNION ALL SELECT -2 - od_id * 2, end_lat, end_lng FROM fx_od"""),
    "o_snap": (["o_ask", "o_node", "o_road"], f"""
        SELECT pid, CASE WHEN safe_d <= greatest(2 * d, d + 200) THEN safe_key ELSE any_key END AS node_key, CASE WHEN safe_d <= greatest(2 * d, d + 200) THEN safe_d ELSE d END AS distance,
               coalesce(safe_d <= greatest(2 * d, d + 200), false) AS safe
        FROM (
          SELECT pid, max(CASE WHEN n = 1 THEN node_key END) AS any_key, min(d) AS d, max(CASE WHEN ok AND s = 1 THEN node_key END) AS safe_key, min(CASE WHEN ok THEN d END) AS safe_d FROM (
            SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, cy, cx, node_key) AS n, row_number() OVER (PARTITION BY pid, ok ORDER BY d, cy, cx, node_key) AS s FROM (
              SELECT x.*, NOT EXISTS (SELECT 1 FROM o_road r WHERE r.rank = 2 AND {crosses('x.plat', 'x.plng', 'x.lat', 'x.lng', 'r.lat1', 'r.lng1', 'r.lat2', 'r.lng2')}) AS ok FROM (
                SELECT pid, p.lat AS plat, p.lng AS plng, n.node_key, n.lat, n.lng, n.cy, n.cx, {hav('p.lat', 'p.lng', 'n.lat', 'n.lng')} AS d
                FROM o_ask p JOIN o_node n ON n.cy BETWEEN CAST(floor(p.lat * 1000) AS BIGINT) - 5 AND CAST(floor(p.lat * 1000) AS BIGINT) + 5 AND n.cx BETWEEN CAST(floor(p.lng * 1000) AS BIGINT) - 5 AND CAST(floor(p.lng * 1000) AS BIGINT) + 5
              ) x WHERE d <= 500))
          GROUP BY pid)"""),
    "o_pref": (["fx_prefs", "o_net"], "SELECT n.key AS edge_key, p.type, p.insert_seq, p.group_id FROM fx_prefs p JOIN o_net n ON n.sid = p.sid AND n.part = 0"),
    "o_pref_seg": (["fx_prefs", "o_seg"], "SELECT p.type, s.* FROM fx_prefs p JOIN o_seg s ON s.sid = p.sid"),
    "o_override": (["o_pref"], """
        SELECT key, arg_max(type, insert_seq) AS type FROM (
          SELECT edge_key AS key, type, insert_seq FROM o_pref
          UNION ALL SELECT g.edge_key, p.type, p.insert_seq FROM o_pref p JOIN o_pref g ON g.group_id = p.group_id) GROUP BY key"""),
    "o_near_edge": (["fx_route_vertices", "o_seg", "o_net"], f"""
        SELECT route_id, idx, tier, d FROM (SELECT *, row_number() OVER (PARTITION BY route_id, idx ORDER BY d, sid, part) AS n FROM (
          SELECT v.route_id, v.idx, s.sid, s.part, e.tier, {seg_d('v.lat', 'v.lng', 's.lat1', 's.lng1', 's.lat2', 's.lng2')} AS d
          FROM fx_route_vertices v JOIN o_seg s ON s.lat1 BETWEEN v.lat - 0.005 AND v.lat + 0.005 AND s.lng1 BETWEEN v.lng - 0.005 AND v.lng + 0.005
          JOIN (SELECT sid, part, {TIER} AS tier FROM o_net WHERE a_key <> b_key) e ON e.sid = s.sid AND e.part = s.part WHERE e.tier IS NOT NULL) WHERE d < 50) WHERE n = 1"""),
    "o_near_road": (["fx_route_vertices", "o_road"], f"""
        SELECT route_id, idx, max(rank) AS rank FROM fx_route_vertices v JOIN o_road s ON {seg_d('v.lat', 'v.lng', 's.lat1', 's.lng1', 's.lat2', 's.lng2')} <= 50 GROUP BY route_id, idx"""),
    "o_near_pref": (["fx_route_vertices", "o_pref_seg"], f"""
        SELECT route_id, idx, bool_or(type = 'nogo') AS near_nogo, bool_or(type = 'preferred') AS near_preferred
        FROM fx_route_vertices v JOIN o_pref_seg s ON {seg_d('v.lat', 'v.lng', 's.lat1', 's.lng1', 's.lat2', 's.lng2')} < 50 GROUP BY route_id, idx"""),
    "o_tiered": (["fx_route_vertices"], """
        SELECT route_id, idx, lat, lng, CASE CAST(floor(((route_id + idx) % 13) / 4.0) AS INTEGER) WHEN 0 THEN 'none' WHEN 1 THEN 'good' WHEN 2 THEN 'lane' ELSE 'avoid' END AS tier FROM fx_route_vertices"""),
    "o_run": (["o_tiered"], """
        SELECT *, CAST(sum(change) OVER (PARTITION BY route_id ORDER BY idx) AS BIGINT) AS run FROM (
          SELECT *, CASE WHEN lag(tier) OVER (PARTITION BY route_id ORDER BY idx) IS DISTINCT FROM tier THEN 1 ELSE 0 END AS change FROM o_tiered)"""),
    "o_step": (["o_net", "fx_vertices"], """
        SELECT CAST(floor(n.sid / 40.0) AS BIGINT) AS route_id, n.sid AS pos, n.name, n.distance, v.a, v.b, v.last1, v.last2, v.first2, v.n FROM o_net n JOIN (
          SELECT sid, count(*) AS n, arg_min(lat, seq) AS a, arg_min(lng, seq) AS b, [arg_max(lat, seq), arg_max(lng, seq)] AS last1,
                 [max(CASE WHEN r = 2 THEN lat END), max(CASE WHEN r = 2 THEN lng END)] AS last2, [max(CASE WHEN seq = 1 THEN lat END), max(CASE WHEN seq = 1 THEN lng END)] AS first2
          FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY seq DESC) AS r FROM fx_vertices WHERE part = 0) GROUP BY sid) v ON v.sid = n.sid
        WHERE n.part = 0 AND n.a_key <> n.b_key"""),
    "o_guided": (["o_step", "fx_vertices"], f"""
        SELECT route_id, sum(coalesce({hav('lat0', 'lng0', 'lat', 'lng')}, 0)) AS distance, count(*) AS points FROM (
          SELECT route_id, lat, lng, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM (
            SELECT s.route_id, s.pos, v.seq, v.lat, v.lng, min(s.pos) OVER (PARTITION BY s.route_id) AS first_pos FROM o_step s JOIN fx_vertices v ON v.sid = s.pos AND v.part = 0)
          WHERE seq > 0 OR pos = first_pos WINDOW w AS (PARTITION BY route_id ORDER BY pos, seq)) GROUP BY route_id"""),
    "o_measured": (["fx_route_vertices"], f"""
        SELECT *, coalesce(sum(length) OVER (PARTITION BY route_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before FROM (
          SELECT *, {hav('lat1', 'lng1', 'lat2', 'lng2')} AS length FROM (
            SELECT route_id, idx AS seg, lat AS lat1, lng AS lng1, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM fx_route_vertices WINDOW w AS (PARTITION BY route_id ORDER BY idx)) WHERE lat2 IS NOT NULL)"""),
    "o_match": (["fx_fixes", "o_measured"], f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY off_m, seg) AS n FROM (
          SELECT f.event_id, f.rider_id, f.ts, f.route_id, f.heading, s.seg, {seg_d('f.lat', 'f.lng', 's.lat1', 's.lng1', 's.lat2', 's.lng2')} AS off_m,
                 s.before + {proj_t('f.lat', 'f.lng', 's.lat1', 's.lng1', 's.lat2', 's.lng2')} * s.length AS along_m
          FROM fx_fixes f JOIN o_measured s ON s.route_id = f.route_id)) WHERE n = 1"""),
    "o_inst": (["o_measured"], "SELECT route_id, before AS distance, 'Turn ' || CAST(seg AS VARCHAR) AS text, row_number() OVER (PARTITION BY route_id ORDER BY seg) - 1 AS i FROM o_measured WHERE seg % 4 = 0"),
    "o_asof": (["o_match", "o_inst"], """
        SELECT m.event_id, coalesce(min(CASE WHEN i.i > 0 AND NOT m.along_m >= i.distance - 10 THEN i.i END), count(*)) - 1 AS idx FROM o_match m JOIN o_inst i ON i.route_id = m.route_id GROUP BY m.event_id"""),
    "o_reply": (["fx_route_vertices", "o_measured"], """
        SELECT r.route_id, a, b, c, d, total, CAST(CASE CAST(floor(r.route_id / 100.0) AS INTEGER) % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN 12.0 ELSE r.route_id + 0.5 END AS DOUBLE) AS len
        FROM (SELECT route_id, arg_min(lat, idx) AS a, arg_min(lng, idx) AS b, arg_max(lat, idx) AS c, arg_max(lng, idx) AS d FROM fx_route_vertices GROUP BY route_id) r
        JOIN (SELECT route_id, sum(length) AS total FROM o_measured GROUP BY route_id) m ON m.route_id = r.route_id"""),
}


def sql(select: str, *needs: str, recursive: str = "") -> str:
    """A statement over derived tables: their common table expressions in order, then the select."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        if name in DERIVED:
            for n in DERIVED[name][0]:
                add(n)
        order.append(name)

    for n in needs:
        add(n)
    fixtures = [n for n in order if n not in DERIVED]
    parts = [ctes(*fixtures)] if fixtures else []
    parts += [f"{n} AS ({DERIVED[n][1]})" for n in order if n in DERIVED]
    if recursive:
        parts.append(recursive)
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(parts) + "\n" if parts else "") + select


def r3(x: str, name: str, digits: int = 3) -> str:
    return f"round({x}, {digits}) AS {name}"


LABEL = case("ct_raw", dims.LABELS, "coalesce(nullif(ct_raw, ''), 'Unknown')")
OVER = case("upper(ct_raw)", {ct: t for t, cts in dims.OVERLAY_TIERS.items() for ct in cts}, "'caution'")
ICON = "CASE WHEN upper(direction) LIKE '%LEFT%' OR upper(direction) = 'TL' THEN 'turn-left' WHEN upper(direction) LIKE '%RIGHT%' OR upper(direction) = 'TR' THEN 'turn-right' WHEN upper(direction) LIKE '%STRAIGHT%' OR upper(direction) = 'C' THEN 'straight' WHEN upper(direction) LIKE '%U-TURN%' OR upper(direction) = 'TU' THEN 'u-turn' ELSE 'continue' END"
TURN = "CASE WHEN abs(turn) < 30 THEN 'Continue' WHEN turn >= 30 AND turn < 150 THEN 'Turn right' WHEN turn <= -30 AND turn > -150 THEN 'Turn left' ELSE 'Make a U-turn' END"
SAVED_X = "distance * CASE cached_code WHEN 0 THEN 0.001 WHEN 1 THEN 0.01 ELSE 1.0 END"
ADDRESS = "CASE WHEN nullif(housenumber, '') IS NOT NULL AND nullif(street, '') IS NOT NULL THEN housenumber || ' ' || street ELSE nullif(street, '') END"
NAMED = "(nullif(name, '') IS NOT NULL AND name IS DISTINCT FROM street AND name IS DISTINCT FROM housenumber)"


VOICE = f"CASE WHEN to_turn < 30 THEN 'a few yards' WHEN {half_up('to_turn * 3.281')} <= 200 THEN CAST({half_up(half_up('to_turn * 3.281') + ' / 10.0')} * 10 AS VARCHAR) || ' feet' WHEN {half_up('to_turn / 160.934')} <= 1 THEN 'a tenth of a mile' ELSE CAST({half_up('to_turn / 160.934')} AS VARCHAR) || ' tenths of a mile' END"


def fold_along(name: str, metres: int) -> str:
    """Vertices in order with the length since the last one taken: taken where it reaches so many metres, and at the end."""
    full = f"f.run + m.length >= {metres} OR f.idx = 22"
    return f"""{name}(route_id, idx, since, run, taken, was, metres) AS (
      SELECT route_id, CAST(0 AS INTEGER), CAST(0 AS INTEGER), CAST(0 AS DOUBLE), true, CAST(NULL AS INTEGER), CAST(NULL AS DOUBLE) FROM fx_route_vertices WHERE idx = 0
      UNION ALL SELECT f.route_id, f.idx + 1, CASE WHEN {full} THEN f.idx + 1 ELSE f.since END, CASE WHEN {full} THEN 0.0 ELSE f.run + m.length END, {full}, f.since, f.run + m.length
      FROM {name} f JOIN o_measured m ON m.route_id = f.route_id AND m.seg = f.idx)"""


#: Pieces between the vertices taken, those between two nodes.
PIECES = f""",
            o_piece AS (SELECT route_id, since, idx, metres, least(a, b) || '|' || greatest(a, b) AS key FROM (
              SELECT c.route_id, c.was AS since, c.idx, c.metres, {key('v.lat', 'v.lng')} AS a, {key('w.lat', 'w.lng')} AS b FROM o_cut c
              JOIN fx_route_vertices v ON v.route_id = c.route_id AND v.idx = c.was JOIN fx_route_vertices w ON w.route_id = c.route_id AND w.idx = c.idx WHERE c.taken AND c.idx > 0) WHERE a <> b)"""


#: Directed edges with cost, and of parallel ones the cheapest.
BEST = f"""o_edge_cost AS (SELECT *, {COST} AS cost FROM (
              SELECT src, dst, key, ct, name, distance, sid, part, dir FROM o_edge
              UNION ALL SELECT a_key, b_key, key, ct, '', distance, NULL, NULL, 0 FROM o_gap_ct UNION ALL SELECT b_key, a_key, key, ct, '', distance, NULL, NULL, 1 FROM o_gap_ct)),
            o_best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY cost, key, ct, distance, name, sid, part) AS best FROM {{table}}) WHERE best = 1)"""

#: Least costs from each start to all nodes.
SEARCH = f""",
            o_goal AS (SELECT od_id, a.node_key AS a, z.node_key AS z, a.distance AS a_m, z.distance AS z_m FROM fx_od JOIN o_snap a ON a.pid = -1 - od_id * 2 JOIN o_snap z ON z.pid = -2 - od_id * 2 WHERE {hav(*OD)} <= 20000 AND a.node_key <> z.node_key),
            d(src, node, cost) USING KEY (src, node) AS (
              SELECT od_id, a, CAST(0 AS DOUBLE) FROM o_goal
              UNION SELECT d.src, e.dst, min(d.cost + e.cost) FROM d JOIN o_best e ON e.src = d.node LEFT JOIN recurring.d r ON r.src = d.src AND r.node = e.dst GROUP BY 1, 2 HAVING min(d.cost + e.cost) < coalesce(min(r.cost), 1e308))"""

#: Paths walked back from their ends, their vertices with roads in place of gaps, totals, and what is said.
GUIDED_PARTS = f""",
            o_back(od, src, dst, hop) AS (
              SELECT g.od_id, CAST(NULL AS VARCHAR), g.z, CAST(0 AS BIGINT) FROM o_goal g JOIN d ON d.src = g.od_id AND d.node = g.z
              UNION ALL SELECT b.od, e.src, e.dst, b.hop + 1 FROM (SELECT od, coalesce(src, dst) AS node, hop FROM o_back) b JOIN o_best e ON e.dst = b.node
                JOIN d p ON p.src = b.od AND p.node = e.src JOIN d q ON q.src = b.od AND q.node = e.dst WHERE p.cost + e.cost = q.cost),
            o_way AS (SELECT b.od, row_number() OVER (PARTITION BY b.od ORDER BY hop DESC) AS pos, e.* FROM o_back b JOIN o_best e ON e.src = b.src AND e.dst = b.dst),
            o_pt AS (
              SELECT od, pos, CASE WHEN w.dir = 0 THEN v.seq ELSE -v.seq END AS k, v.lat, v.lng FROM o_way w JOIN fx_vertices v ON v.sid = w.sid AND v.part = w.part
              UNION ALL SELECT od, pos, 0, lat, lng FROM o_way w JOIN o_node n ON n.node_key = w.src WHERE w.sid IS NULL
              UNION ALL SELECT od, pos, 2, lat, lng FROM o_way w JOIN o_node n ON n.node_key = w.dst WHERE w.sid IS NULL
              UNION ALL SELECT od, pos, 1, (a.lat + z.lat) / 2 + 0.0001, (a.lng + z.lng) / 2 FROM o_way w JOIN o_node a ON a.node_key = w.src JOIN o_node z ON z.node_key = w.dst WHERE w.ct IN ('_GAP_BUSY', '_GAP_MAJOR')),
            o_line AS (SELECT od, pos, k, lat, lng, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM (SELECT *, row_number() OVER (PARTITION BY od, pos ORDER BY k) AS r FROM o_pt) WHERE r > 1 OR pos = 1 WINDOW w AS (PARTITION BY od ORDER BY pos, k)),
            o_core AS (SELECT od, sum({hav('lat0', 'lng0', 'lat', 'lng')}) AS metres, count(lat0) AS points, sum(lat) FILTER (lat0 IS NOT NULL) AS lats, sum(lng) FILTER (lat0 IS NOT NULL) AS lngs FROM o_line GROUP BY od),
            o_turn AS (SELECT w.od, w.pos, w.name, lag(w.name) OVER w AS was_name, first2, lag(last1) OVER w AS was, lag(last2) OVER w AS was2 FROM o_way w JOIN (
              SELECT od, pos, max(CASE WHEN r = 2 THEN [lat, lng] END) AS first2, max(CASE WHEN q = 1 THEN [lat, lng] END) AS last1, max(CASE WHEN q = 2 THEN [lat, lng] END) AS last2
              FROM (SELECT *, row_number() OVER (PARTITION BY od, pos ORDER BY k) AS r, row_number() OVER (PARTITION BY od, pos ORDER BY k DESC) AS q FROM o_pt) GROUP BY od, pos) p ON p.od = w.od AND p.pos = w.pos WINDOW w AS (PARTITION BY w.od ORDER BY w.pos)),
            o_told AS (SELECT od, string_agg(CASE WHEN name <> '' THEN said || ' onto ' || name ELSE said END, '; ' ORDER BY pos) AS said, count(*) AS turns FROM (
              SELECT *, {TURN} AS said FROM (SELECT *, CASE WHEN raw > 180 THEN raw - 360 WHEN raw < -180 THEN raw + 360 ELSE raw END AS turn FROM (
                SELECT *, {bear('was[1]', 'was[2]', 'first2[1]', 'first2[2]')} - {bear('was2[1]', 'was2[2]', 'was[1]', 'was[2]')} AS raw FROM o_turn WHERE pos > 1 AND (name = '' OR name <> was_name)))) GROUP BY od),
            o_leg AS (SELECT od_id, which, a, b, (a + e) / 2 + 0.0001 AS m, (b + f) / 2 AS n, e, f FROM (
              SELECT g.od_id, 'first' AS which, o.start_lat AS a, o.start_lng AS b, n.lat AS e, n.lng AS f FROM o_goal g JOIN fx_od o ON o.od_id = g.od_id JOIN o_node n ON n.node_key = g.a WHERE a_m > 100 AND g.od_id % 3 <> 0
              UNION ALL SELECT g.od_id, 'last', n.lat, n.lng, o.end_lat, o.end_lng FROM o_goal g JOIN fx_od o ON o.od_id = g.od_id JOIN o_node n ON n.node_key = g.z WHERE z_m > 100 AND g.od_id % 2 = 1
              UNION ALL SELECT od_id, 'direct', start_lat, start_lng, end_lat, end_lng FROM fx_od WHERE od_id NOT IN (SELECT od FROM o_core))),
            o_legs AS (SELECT *, {hav('a', 'b', 'm', 'n')} + {hav('m', 'n', 'e', 'f')} AS metres FROM o_leg)"""

GUIDED = f"""
            SELECT od_id, 'router' AS route_source, round(metres, 3) AS metres, CAST({half_up('metres / 4.2')} AS DOUBLE) AS time, CAST(12.5 AS DOUBLE) AS ascend, CAST(3 AS DOUBLE) AS descend, 3 AS points, 3 AS elevations,
                   round(a + m + e, 6) AS lat_sum, round(b + n + f, 6) AS lng_sum, true AS has_elevation, 'Start your ride; Follow the route; Arrive at destination' AS said, round(metres, 3) AS said_m, 3 AS turns FROM o_legs WHERE which = 'direct'
            UNION ALL SELECT c.od, 'network', round(total, 3), CAST({half_up('total / 4.2')} AS DOUBLE), 12.5 * legs, 3.0 * legs, c.n, c.n, round(lats + CASE WHEN x.od_id IS NULL THEN start_lat ELSE x.a + x.m + x.e END + CASE WHEN y.od_id IS NULL THEN 0 ELSE y.m + y.e END, 6),
                   round(lngs + CASE WHEN x.od_id IS NULL THEN start_lng ELSE x.b + x.n + x.f END + CASE WHEN y.od_id IS NULL THEN 0 ELSE y.n + y.f END, 6), false,
                   concat_ws('; ', CASE WHEN x.od_id IS NOT NULL THEN 'Start your ride; Follow the route' WHEN first_name <> '' THEN 'Start on ' || first_name ELSE 'Start your ride' END, t.said, CASE WHEN y.od_id IS NOT NULL THEN 'Follow the route' END, 'Arrive at destination'),
                   round(total, 3), CASE WHEN x.od_id IS NOT NULL THEN 2 ELSE 1 END + coalesce(t.turns, 0) + CASE WHEN y.od_id IS NOT NULL THEN 2 ELSE 1 END
            FROM (SELECT c.*, o.start_lat, o.start_lng, (SELECT name FROM o_way w WHERE w.od = c.od AND w.pos = 1) AS first_name, c.metres + coalesce(x.metres, 0) + coalesce(y.metres, 0) AS total,
                    CASE WHEN x.od_id IS NULL THEN 0 ELSE 1 END + CASE WHEN y.od_id IS NULL THEN 0 ELSE 1 END AS legs, c.points + CASE WHEN x.od_id IS NULL THEN 1 ELSE 3 END + CASE WHEN y.od_id IS NULL THEN 0 ELSE 2 END AS n
                  FROM o_core c JOIN fx_od o ON o.od_id = c.od LEFT JOIN o_legs x ON x.od_id = c.od AND x.which = 'first' LEFT JOIN o_legs y ON y.od_id = c.od AND y.which = 'last') c
            LEFT JOIN o_legs x ON x.od_id = c.od AND x.which = 'first' LEFT JOIN o_legs y ON y.od_id = c.od AND y.which = 'last' LEFT JOIN o_told t ON t.od = c.od"""


#: Replay of drawn lines (route r is stored as number 2r): nodes with their maker, what is asked for in order, and what is new; the lines' single preferences ask for edges that are there.
REPLAY = fold_along("o_cut", 200) + PIECES + f""",
            o_taken AS (SELECT v.route_id, v.idx, v.lat, v.lng, {key('v.lat', 'v.lng')} AS node_key FROM o_cut c JOIN fx_route_vertices v ON v.route_id = c.route_id AND v.idx = c.idx WHERE c.taken),
            o_node_d AS (SELECT node_key, lat, lng, cy, cx, -1 AS made FROM o_node
              UNION ALL SELECT node_key, lat, lng, CAST(floor(lat * 1000) AS BIGINT), CAST(floor(lng * 1000) AS BIGINT), made FROM (SELECT node_key, arg_min(lat, route_id * 100 + idx) AS lat, arg_min(lng, route_id * 100 + idx) AS lng FROM o_taken WHERE node_key NOT IN (SELECT node_key FROM o_node) GROUP BY node_key)
                JOIN (SELECT node_key AS k, min(route_id) AS made FROM o_taken GROUP BY node_key) ON k = node_key),
            o_asked AS (
              SELECT key, route_id AS seq, 0 AS phase, since AS step, '_PREF' AS ct, metres AS distance FROM o_piece
              UNION ALL SELECT least(a, b) || '|' || greatest(a, b), seq, 1, step, '_GAP', distance FROM (
                SELECT e.route_id AS seq, CASE WHEN e.idx = 0 THEN 0 ELSE 1 END AS step, e.node_key AS a, n.node_key AS b, {hav('e.lat', 'e.lng', 'n.lat', 'n.lng')} AS distance FROM o_taken e JOIN o_node_d n
                ON n.made <= e.route_id AND n.node_key <> e.node_key AND n.cy BETWEEN CAST(floor(e.lat * 1000) AS BIGINT) - 3 AND CAST(floor(e.lat * 1000) AS BIGINT) + 3 AND n.cx BETWEEN CAST(floor(e.lng * 1000) AS BIGINT) - 3 AND CAST(floor(e.lng * 1000) AS BIGINT) + 3
                WHERE e.idx IN (0, 23)) WHERE distance <= 250),
            o_added AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq, phase, step) AS n FROM o_asked) WHERE n = 1 AND key NOT IN (SELECT key FROM o_net WHERE a_key <> b_key UNION ALL SELECT key FROM o_gap))"""

#: The network with the new edges under the drawn preferences.
OVER_DRAWN = f""",
            o_over_d AS (SELECT key, arg_max(type, seq) AS type FROM (SELECT key, CASE WHEN route_id % 300 = 107 THEN 'nogo' ELSE 'preferred' END AS type, route_id * 2 AS seq FROM o_piece UNION ALL SELECT edge_key, type, insert_seq * 2 + 1 FROM o_pref WHERE group_id IS NULL) GROUP BY key),
            o_every_cost AS (SELECT * FROM o_edge_cost UNION ALL SELECT *, {COST} AS cost FROM (
              SELECT split_part(key, '|', 1) AS src, split_part(key, '|', 2) AS dst, key, ct, '' AS name, distance, NULL, NULL, 0 FROM o_added UNION ALL SELECT split_part(key, '|', 2), split_part(key, '|', 1), key, ct, '', distance, NULL, NULL, 1 FROM o_added)),
            o_snap_d AS ({DERIVED['o_snap'][1].replace('o_node', 'o_node_d')})"""
OVERRIDDEN = "(SELECT e.* REPLACE (CASE WHEN o.type = 'preferred' THEN 0.5 * distance ELSE cost END AS cost) FROM {edges} e LEFT JOIN {over} o ON o.key = e.key WHERE o.type IS NULL OR o.type <> 'nogo')"


def oracle_sql() -> dict[str, str]:
    d_raw = bear("was[1]", "was[2]", "c1", "c2") + " - " + bear("a1", "a2", "was[1]", "was[2]")
    out = {
        "haversine_pairs": sql(f"SELECT od_id, {r3(hav(*OD), 'metres')} FROM fx_od", "fx_od"),
        "bearing_pairs": sql(f"SELECT od_id, {r3(bear(*OD), 'degrees', 6)} FROM fx_od", "fx_od"),
        "seg_project": sql(
            f"SELECT sid, {r3(seg_d('p', 'q', 'a', 'b', 'e', 'f'), 'metres')}, {r3(proj_t('p', 'q', 'a', 'b', 'e', 'f'), 't', 6)}, "
            f"{r3('a + ' + proj_t('p', 'q', 'a', 'b', 'e', 'f') + ' * (e - a)', 'lat', 7)}, {r3('b + ' + proj_t('p', 'q', 'a', 'b', 'e', 'f') + ' * (f - b)', 'lng', 7)} FROM ("
            "SELECT v.sid, max(CASE WHEN seq = 1 THEN lat END) AS p, max(CASE WHEN seq = 1 THEN lng END) AS q, max(CASE WHEN seq = 0 THEN lat END) AS a, max(CASE WHEN seq = 0 THEN lng END) AS b, "
            "max(CAST(lat2 AS DOUBLE) / 100000.0) AS e, max(CAST(lng2 AS DOUBLE) / 100000.0) AS f FROM fx_vertices v JOIN fx_lines l ON l.sid = v.sid WHERE part = 0 GROUP BY v.sid)", "fx_vertices", "fx_lines"),
        "polyline_length": sql(f"SELECT sid, part, {r3('distance', 'metres')} FROM o_net", "o_net"),
        "node_keys": sql(f"SELECT sid, part, seq, {key('lat', 'lng')} AS node_key FROM fx_vertices", "fx_vertices"),
        "canonical_edges": sql("SELECT sid, part, key FROM o_net", "o_net"),
        "grid_cells": sql(
            "SELECT sid, part, k, cell_lat, cell_lng FROM (SELECT sid, part, k, unnest(generate_series(CAST(floor(least(lat1, lat2) * 1000) AS BIGINT), CAST(floor(greatest(lat1, lat2) * 1000) AS BIGINT))) AS cell_lat, lng1, lng2 FROM o_seg) x, "
            "LATERAL (SELECT unnest(generate_series(CAST(floor(least(lng1, lng2) * 1000) AS BIGINT), CAST(floor(greatest(lng1, lng2) * 1000) AS BIGINT))) AS cell_lng) y", "o_seg"),
        "quantise_5dp": sql("SELECT sid, part, seq, floor(lat * CAST(1.0001 AS DOUBLE) * 100000 + 0.5) / 100000 AS lat, floor(lng * CAST(1.0001 AS DOUBLE) * 100000 + 0.5) / 100000 AS lng FROM fx_vertices", "fx_vertices"),
        "nodes_first_writer": sql("SELECT node_key, lat, lng FROM o_node", "o_node"),
        "edges_bidirectional": sql(f"SELECT sid, part, src, dst, ct, {r3('distance', 'metres')} FROM o_edge", "o_edge"),
        "edge_costs": sql(f"SELECT sid, part, dir, {r3(COST, 'cost')} FROM o_edge", "o_edge"),
        "edge_cost_overrides": sql(f"SELECT sid, part, dir, round(CASE WHEN o.type = 'preferred' THEN 0.5 * distance ELSE {COST} END, 3) AS cost FROM o_edge e LEFT JOIN o_override o ON o.key = e.key WHERE o.type IS NULL OR o.type <> 'nogo'", "o_edge", "o_override"),
        "tier_lengths": sql(f"SELECT tier, count(*) AS n, {r3('sum(distance)', 'metres')} FROM (SELECT {TIER} AS tier, distance FROM o_net) WHERE tier IS NOT NULL GROUP BY tier", "o_net"),
        "overlay_attributes": sql(
            f"SELECT sid, coalesce(nullif(name, ''), 'Unnamed') AS name, {LABEL} AS label, upper(substr(tier, 1, 1)) || substr(tier, 2) AS tier, {case('tier', {k: v[0] for k, v in dims.OVERLAY_STYLES.items()}, 'NULL')} AS colour, "
            f"{case('tier', {k: str(v[1]) for k, v in dims.OVERLAY_STYLES.items()}, 'NULL')} AS weight, {case('tier', {k: v[3] or '' for k, v in dims.OVERLAY_STYLES.items()}, 'NULL')} AS dash FROM (SELECT *, {OVER} AS tier FROM fx_lines)", "fx_lines"),
        "road_segments": sql("SELECT road, k, highway, CASE rank WHEN 2 THEN 'major' ELSE 'secondary' END AS severity, lat1, lng1, lat2, lng2 FROM o_road", "o_road"),
        "gap_pairs": sql(f"SELECT a_key, b_key, {r3('distance', 'metres')} FROM o_gap", "o_gap"),
        "gap_severity": sql("SELECT key, ct FROM o_gap_ct", "o_gap_ct"),
        "snap_nearest_safe": sql(f"SELECT pid, node_key, {r3('distance', 'metres')}, safe FROM o_snap WHERE pid >= 0", "o_snap"),
        "nearest_edge_50m": sql(f"SELECT route_id, idx, tier, {r3('d', 'metres')} FROM o_near_edge", "o_near_edge"),
        "near_busy_road": sql("SELECT route_id, idx, CASE rank WHEN 2 THEN 'major' ELSE 'secondary' END AS severity FROM o_near_road", "o_near_road"),
        "pref_semijoin": sql("SELECT * FROM o_near_pref", "o_near_pref"),
        "classify_vertices": sql(
            "SELECT v.route_id, v.idx, CASE WHEN near_nogo THEN 'avoid' WHEN near_preferred THEN 'good' WHEN e.tier IS NOT NULL THEN e.tier WHEN rank = 2 THEN 'avoid' WHEN rank = 1 THEN 'caution' ELSE 'none' END AS tier "
            "FROM fx_route_vertices v LEFT JOIN o_near_pref p ON p.route_id = v.route_id AND p.idx = v.idx LEFT JOIN o_near_edge e ON e.route_id = v.route_id AND e.idx = v.idx LEFT JOIN o_near_road r ON r.route_id = v.route_id AND r.idx = v.idx",
            "fx_route_vertices", "o_near_pref", "o_near_edge", "o_near_road"),
        "tier_runs": sql("SELECT route_id, run, tier, start_idx, points FROM (SELECT *, n + CASE WHEN lead(run) OVER (PARTITION BY route_id ORDER BY run) IS NOT NULL THEN 1 ELSE 0 END AS points FROM (SELECT route_id, run, tier, min(idx) AS start_idx, count(*) AS n FROM o_run GROUP BY ALL)) WHERE points >= 2", "o_run"),
        "tier_distribution": sql("SELECT route_id, tier, n, round(pct, 6) AS pct, repeat('#', CAST(floor(round(pct, 6) / 2 + 0.5) AS INTEGER)) AS bar FROM (SELECT route_id, tier, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY route_id) AS pct FROM o_tiered GROUP BY route_id, tier)", "o_tiered"),
        "grey_segments": sql(f"SELECT route_id, start_idx, end_idx, round(metres, 3) AS metres FROM (SELECT route_id, run, min(idx) AS start_idx, max(idx) AS end_idx, sum(ahead) AS metres FROM (SELECT *, coalesce({hav('lat', 'lng', 'lat1', 'lng1')}, 0) AS ahead FROM (SELECT *, lead(lat) OVER w AS lat1, lead(lng) OVER w AS lng1 FROM o_run WINDOW w AS (PARTITION BY route_id ORDER BY idx))) WHERE tier = 'none' GROUP BY route_id, run) WHERE metres > 20", "o_run"),
        "meridian_crossings": sql("SELECT route_id, idx, CASE WHEN lng > -122.68 THEN 'eastbound' ELSE 'westbound' END AS direction FROM (SELECT *, lag(lng) OVER (PARTITION BY route_id ORDER BY idx) AS was FROM fx_route_vertices) WHERE (was < -122.68 AND lng > -122.68) OR (was > -122.68 AND lng < -122.68)", "fx_route_vertices"),
        "pref_unique": sql("SELECT preference, edge_key, type, insert_seq FROM (SELECT *, row_number() OVER (PARTITION BY preference ORDER BY insert_seq, edge_key) AS n FROM (SELECT *, coalesce(nullif(group_id, ''), edge_key) AS preference FROM o_pref)) WHERE n = 1", "o_pref"),
        "pref_overrides_lww": sql("SELECT key, type FROM o_override", "o_override"),
        "pref_cascade_delete": sql("SELECT edge_key, type, insert_seq FROM o_pref WHERE edge_key NOT IN (SELECT edge_key FROM o_pref WHERE insert_seq % 3 = 0 UNION SELECT g.edge_key FROM o_pref p JOIN o_pref g ON g.group_id = p.group_id WHERE p.edge_key IN (SELECT edge_key FROM o_pref WHERE insert_seq % 3 = 0))", "o_pref"),
        "pref_group_explode": sql("SELECT group_id, min(type) OVER (PARTITION BY group_id) AS type, row_number() OVER (PARTITION BY group_id ORDER BY insert_seq, edge_key) - 1 AS pos, edge_key FROM o_pref WHERE group_id IS NOT NULL", "o_pref"),
        "keyed_store_changes": sql("SELECT * FROM (SELECT id, name, distance FROM fx_saved WHERE id NOT IN (SELECT CAST(CAST(id AS BIGINT) * 2 AS VARCHAR) FROM fx_saved WHERE CAST(id AS BIGINT) % 3 = 0) UNION ALL SELECT CAST(CAST(id AS BIGINT) * 2 AS VARCHAR), 'New ' || name, distance FROM fx_saved WHERE CAST(id AS BIGINT) % 3 = 0) WHERE id NOT IN (SELECT id FROM fx_saved WHERE CAST(id AS BIGINT) % 7 = 0)", "fx_saved"),
        "keyed_store_lookup": sql("SELECT id, name, distance FROM fx_saved WHERE CAST(id AS BIGINT) IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)", "fx_saved"),
        "savable_routes": sql("SELECT id, name, fresh_code AS points, distance AS route FROM fx_saved WHERE fresh_code >= 2 AND cached_code <> 0 AND CAST(id AS BIGINT) % 5 <> 0", "fx_saved"),
        "search_near_bias": sql(
            f"""SELECT query_id, 1 AS tier, place_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY away, place_id) AS rank FROM (
              SELECT q.place_id AS query_id, p.place_id, round({hav('p.lat', 'p.lng', 'q.lat + 0.001', 'q.lng')}) AS away
              FROM fx_places q JOIN fx_places p ON starts_with(lower(p.city), lower(q.city)) AND p.lat BETWEEN q.lat - 0.008 AND q.lat + 0.008 AND p.lng BETWEEN q.lng - 0.012 AND q.lng + 0.012)) WHERE rank <= 5""", "fx_places"),
        "reverse_address": sql("""SELECT place_id, CASE WHEN place_id % 11 <> 0 AND street <> '' AND housenumber <> '' THEN housenumber || ' ' || street WHEN place_id % 11 <> 0 AND street <> '' THEN street WHEN name <> '' THEN name
            WHEN place_id % 8 = 0 OR place_id % 16 = 1 THEN NULL ELSE district END AS label FROM fx_places""", "fx_places"),
        "corridors_passed": sql(
            f"""SELECT e.route_id, corridor, max(CASE WHEN {hav('v.lat', 'v.lng', 'lat0 + (lat1 - lat0) * corridor / 10.0', 'lng0 + (lng1 - lng0) * corridor / 10.0')} < 60 THEN 1 ELSE 0 END) = 1 AS passed
            FROM (SELECT route_id, arg_min(lat, idx) AS lat0, arg_min(lng, idx) AS lng0, arg_max(lat, idx) AS lat1, arg_max(lng, idx) AS lng1 FROM fx_route_vertices GROUP BY route_id) e
            CROSS JOIN (SELECT CAST(range AS INTEGER) AS corridor FROM range(11)) JOIN fx_route_vertices v ON v.route_id = e.route_id GROUP BY e.route_id, corridor""", "fx_route_vertices"),
        "route_checks": sql(
            f"""SELECT route_id, round(metres, 3) AS metres, metres > 8500 AND metres < 9000 AS in_bounds, top > from_lat + 0.009 AS goes_back, west < -122.6952 AS crosses_west FROM (
              SELECT route_id, sum(coalesce({hav('lat', 'lng', 'lat1', 'lng1')}, 0)) AS metres, arg_min(lat, idx) AS from_lat, max(lat) AS top, min(lng) AS west FROM (
                SELECT rider_id AS route_id, event_id AS idx, lat, lng, lead(lat) OVER w AS lat1, lead(lng) OVER w AS lng1 FROM fx_fixes WINDOW w AS (PARTITION BY rider_id ORDER BY event_id)) GROUP BY route_id)""", "fx_fixes"),
        "path_edge_checks": sql(
            "SELECT od AS od_id, count(*) AS edges, count(*) > 5 AS enough, count(*) FILTER (name <> '') * 2 > count(*) AS mostly_named FROM o_way GROUP BY od",
            "o_edge", "o_gap_ct", "o_snap", "fx_od", "fx_vertices", "o_node", recursive=BEST.format(table="o_edge_cost") + SEARCH + GUIDED_PARTS.partition("o_pt AS")[0].rstrip().removesuffix(",")),
        "saved_routes_latest": sql(f"SELECT id, name, created_at, {fixed('(distance / 1609.34)', 1)} || ' mi' AS miles FROM fx_saved WHERE created_at IS NOT NULL", "fx_saved"),
        "route_cache_fallback": sql("SELECT id, CASE WHEN fresh_code <> 0 THEN distance + 1 WHEN cached_code <> 0 THEN distance END AS distance, CASE WHEN fresh_code <> 0 THEN 'fresh' WHEN cached_code <> 0 THEN 'cached' ELSE 'unavailable' END AS status FROM fx_saved", "fx_saved"),
        "store_upsert_delete": sql("SELECT * FROM (SELECT id, name FROM fx_saved WHERE id NOT IN (SELECT CAST(CAST(id AS BIGINT) * 2 AS VARCHAR) FROM fx_saved WHERE CAST(id AS BIGINT) % 3 = 0) UNION ALL SELECT CAST(CAST(id AS BIGINT) * 2 AS VARCHAR), 'New ' || name FROM fx_saved WHERE CAST(id AS BIGINT) % 3 = 0) WHERE id NOT IN (SELECT id FROM fx_saved WHERE CAST(id AS BIGINT) % 7 = 0)", "fx_saved"),
        "instructions_from_edges": sql(
            f"""SELECT route_id, row_number() OVER (PARTITION BY route_id ORDER BY n, k) - 1 AS idx, text, round(distance, 3) AS metres, round(step, 3) AS step_m, icon FROM (
              SELECT route_id, n, 0 AS k, CASE WHEN n = 1 THEN CASE WHEN name <> '' THEN 'Start on ' || name ELSE 'Start your ride' END WHEN name <> '' THEN said || ' onto ' || name ELSE said END AS text,
                     CASE WHEN n = 1 THEN 0.0 ELSE before END AS distance, CASE WHEN n = 1 THEN 0.0 ELSE was_m END AS step,
                     CASE WHEN n = 1 THEN 'start' WHEN said LIKE '%right%' THEN 'turn-right' WHEN said LIKE '%left%' THEN 'turn-left' WHEN said LIKE '%U-turn%' THEN 'u-turn' ELSE 'continue' END AS icon
              FROM (SELECT *, {TURN} AS said FROM (SELECT *, CASE WHEN raw > 180 THEN raw - 360 WHEN raw < -180 THEN raw + 360 ELSE raw END AS turn FROM (SELECT *, {d_raw} AS raw FROM o_turns))) WHERE n = 1 OR name = '' OR name <> was_name
              UNION ALL SELECT route_id, n, 1, 'Arrive at destination', before + distance, 0.0, 'arrive' FROM o_turns WHERE n = many)""",
            "o_step", recursive="""o_turns AS (SELECT route_id, name, distance, row_number() OVER w AS n, count(*) OVER (PARTITION BY route_id) AS many, coalesce(sum(distance) OVER (PARTITION BY route_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
              lag(name) OVER w AS was_name, lag(distance) OVER w AS was_m, lag(last1) OVER w AS was, lag(last2[1]) OVER w AS a1, lag(last2[2]) OVER w AS a2, first2[1] AS c1, first2[2] AS c2 FROM o_step WINDOW w AS (PARTITION BY route_id ORDER BY pos))"""),
        "instructions_from_messages": sql(
            f"""SELECT reply, pos, CASE WHEN message = '' THEN 'Start' ELSE message END AS text, run AS distance, step AS step_distance, CASE WHEN pos = 1 THEN 'start' ELSE {ICON} END AS icon, CAST(lat AS DOUBLE) / 1e6 AS lat, CAST(lon AS DOUBLE) / 1e6 AS lng FROM o_msg WHERE pos = 1 OR message <> ''
            UNION ALL SELECT reply, max(pos) + 1, 'Arrive at destination', max(run), 0.0, 'arrive', arg_max(CAST(lat AS DOUBLE) / 1e6, pos), arg_max(CAST(lon AS DOUBLE) / 1e6, pos) FROM o_msg GROUP BY reply""",
            "fx_messages", recursive="o_msg AS (SELECT *, CAST(sum(step) OVER (PARTITION BY reply ORDER BY pos) AS DOUBLE) AS run FROM (SELECT *, CAST(replace(distance, 'm', '') AS DOUBLE) AS step FROM fx_messages))"),
        "basic_instructions": sql(
            "SELECT route_id, 0 AS idx, 'Start your ride' AS text, CAST(0 AS DOUBLE) AS distance, CAST(0 AS DOUBLE) AS step_distance, 'start' AS icon, a AS lat, b AS lng FROM o_reply "
            "UNION ALL SELECT route_id, 1, 'Follow the route', coalesce(len, 0.0), coalesce(len, 0.0), 'continue', c, d FROM o_reply UNION ALL SELECT route_id, 2, 'Arrive at destination', coalesce(len, 0.0), CAST(0 AS DOUBLE), 'arrive', c, d FROM o_reply", "o_reply"),
        "reply_properties": sql(f"SELECT route_id, round(dist, 3) AS metres, CASE WHEN route_id % 200 = 7 THEN CAST({half_up('dist / 4.2')} AS DOUBLE) ELSE 321.5 END AS time, CAST(CASE WHEN route_id % 300 = 7 THEN 0.0 ELSE 25.0 END AS DOUBLE) AS ascend FROM (SELECT route_id, coalesce(nullif(len, 0.0), total) AS dist FROM o_reply)", "o_reply"),
        "guided_routes": sql("SELECT route_id, round(distance, 3) AS metres, points FROM o_guided", "o_guided"),
        "stitch_routes": sql(
            "SELECT route_id, round(CASE WHEN route_id % 3 = 0 THEN route_id % 7 * 10.0 ELSE 0 END + distance + CASE WHEN route_id % 2 = 0 THEN route_id % 5 * 10.0 ELSE 0 END, 3) AS metres, "
            "CAST(CASE WHEN route_id % 3 = 0 THEN 1.5 ELSE 0 END + CASE WHEN route_id % 2 = 0 THEN 1.5 ELSE 0 END AS DOUBLE) AS ascend, CAST(CASE WHEN route_id % 3 = 0 THEN 0.5 ELSE 0 END + CASE WHEN route_id % 2 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS descend, "
            "CASE WHEN route_id % 3 = 0 THEN 4 ELSE 1 END + points - 1 + CASE WHEN route_id % 2 = 0 THEN 3 ELSE 0 END AS points FROM o_guided", "o_guided"),
        "route_summary": sql(f"SELECT id AS route_id, {fixed('(distance / 1609.34)', 1)} || ' mi' AS miles, CAST({half_up('distance / 4 / 60')} AS VARCHAR) || ' min' AS minutes, CASE WHEN fresh_code = 0 THEN CAST({half_up('distance / 100 * 3.281')} AS VARCHAR) || ' ft' END AS climb FROM fx_saved", "fx_saved"),
        "format_distances": sql(
            f"""SELECT id, CASE WHEN x < 160 THEN CAST({half_up('x')} AS VARCHAR) || ' m' ELSE {fixed('mi', 1)} || ' mi' END AS a,
                CASE WHEN x < 15 THEN 'Now' WHEN feet <= 500 THEN CAST({half_up('feet / 10.0')} * 10 AS VARCHAR) || ' ft' WHEN mi < 0.15 THEN CAST({half_up('feet / 50.0')} * 50 AS VARCHAR) || ' ft' ELSE {fixed('mi', 1)} || ' mi' END AS b,
                CASE WHEN x < 60 THEN '<1 min' WHEN mins < 60 THEN CAST(mins AS VARCHAR) || ' min' ELSE CAST(mins // 60 AS VARCHAR) || 'h ' || CAST(mins % 60 AS VARCHAR) || 'm' END AS t,
                CASE WHEN x < 30 THEN 'a few yards' WHEN feet <= 200 THEN CAST({half_up('feet / 10.0')} * 10 AS VARCHAR) || ' feet' WHEN tenths <= 1 THEN 'a tenth of a mile' ELSE CAST(tenths AS VARCHAR) || ' tenths of a mile' END AS v
            FROM (SELECT *, x / 1609.34 AS mi, {half_up('x * 3.281')} AS feet, {half_up('x / 60')} AS mins, {half_up('x / 160.934')} AS tenths FROM (SELECT id, CAST({SAVED_X} AS DOUBLE) AS x FROM fx_saved))""", "fx_saved"),
        "elevation_profile": sql("SELECT route_id, idx, round(CAST(row_number() OVER (PARTITION BY route_id ORDER BY idx) - 1 AS DOUBLE) / (count(*) OVER (PARTITION BY route_id) - 1), 9) AS x, round((ele - min(ele) OVER (PARTITION BY route_id)) / coalesce(nullif(max(ele) OVER (PARTITION BY route_id) - min(ele) OVER (PARTITION BY route_id), 0), 1), 9) AS y FROM fx_route_vertices", "fx_route_vertices"),
        "nav_match": sql(f"SELECT event_id, {r3('off_m', 'off_m')}, {r3('along_m', 'along_m')} FROM o_match", "o_match"),
        "nav_instruction_asof": sql("SELECT event_id, idx FROM o_asof", "o_asof"),
        "nav_updates_batch": sql(
            """SELECT m.event_id, CASE WHEN isnan(heading) THEN NULL ELSE heading END AS heading, a.idx, round(coalesce(greatest(0.0, x.distance - along_m), 0.0), 3) AS to_turn_m, round(greatest(0.0, t.total - along_m), 3) AS remaining_m, off_m > 50 AS off_route,
               bool_or(greatest(0.0, t.total - along_m) < 30) OVER (PARTITION BY rider_id ORDER BY ts, m.event_id) AS arrived
            FROM o_match m JOIN o_asof a ON a.event_id = m.event_id LEFT JOIN o_inst x ON x.route_id = m.route_id AND x.i = a.idx + 1 JOIN (SELECT route_id, sum(length) AS total FROM o_measured GROUP BY route_id) t ON t.route_id = m.route_id""", "o_match", "o_asof", "o_inst", "o_measured"),
        "off_route_banner": sql(
            """SELECT rider_id, event_id, ms AS shown_ms, hides AS hidden_ms FROM o_off f WHERE NOT EXISTS (SELECT 1 FROM o_off p WHERE p.rider_id = f.rider_id AND p.i < f.i AND coalesce(p.hides, 9e18) > f.ms)""",
            "o_match", recursive="""o_fix AS (SELECT rider_id, event_id, off_m > 50 AS off, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY rider_id ORDER BY epoch_us(ts) // 1000, event_id) AS i FROM o_match),
            o_hide AS (SELECT a.rider_id, a.i, a.ms + 2000 AS at FROM o_fix a LEFT JOIN o_fix b ON b.rider_id = a.rider_id AND b.i = a.i + 1 WHERE NOT a.off AND (b.ms IS NULL OR b.ms >= a.ms + 2000)),
            o_off AS (SELECT f.*, (SELECT min(h.at) FROM o_hide h WHERE h.rider_id = f.rider_id AND h.i > f.i) AS hides FROM o_fix f WHERE off)"""),
        "search_cascade": sql(
            """SELECT query_id, tier, place_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place_id) AS rank FROM (
              SELECT *, min(tier) OVER (PARTITION BY query_id) AS best FROM (
                SELECT q.query_id, p.place_id, CASE WHEN p.place_id % 2 = 1 THEN 3 WHEN p.lat BETWEEN q.lat - 0.008 AND q.lat + 0.008 AND p.lng BETWEEN q.lng - 0.012 AND q.lng + 0.012 THEN 1 ELSE 2 END AS tier
                FROM (SELECT place_id AS query_id, substr(city, 1, 2 + CAST(place_id % 4 AS INTEGER)) AS text, lat, lng FROM fx_places WHERE place_id % 3 = 1) q JOIN fx_places p ON length(q.text) >= 3 AND lower(p.city) LIKE replace(lower(q.text), '_', '!_') || '%' ESCAPE '!')) WHERE tier = best) WHERE rank <= 5""", "fx_places"),
        "place_labels": sql(f"SELECT place_id, CASE WHEN {NAMED} THEN name ELSE coalesce({ADDRESS}, nullif(name, ''), 'Unknown location') END AS label, concat_ws(', ', CASE WHEN {NAMED} THEN {ADDRESS} END, coalesce(nullif(suburb, ''), nullif(district, '')), nullif(city, ''), nullif(state, '')) AS detail FROM fx_places", "fx_places"),
        "bias_bbox": sql("SELECT od_id AS view_id, round(x0 - greatest((0.25 - (x1 - x0)) / 2, 0), 9) AS min_lng, round(y0 - greatest((0.25 - (y1 - y0)) / 2, 0), 9) AS min_lat, round(x1 + greatest((0.25 - (x1 - x0)) / 2, 0), 9) AS max_lng, round(y1 + greatest((0.25 - (y1 - y0)) / 2, 0), 9) AS max_lat FROM (SELECT od_id, least(start_lng, end_lng) AS x0, least(start_lat, end_lat) AS y0, greatest(start_lng, end_lng) AS x1, greatest(start_lat, end_lat) AS y1 FROM fx_od)", "fx_od"),
        "nearest_place": sql(
            f"""SELECT pid, place_id, round(d, 3) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d, place_id) AS n FROM (SELECT p.pid, q.place_id, {hav('p.lat', 'p.lng', 'q.lat', 'q.lng')} AS d FROM fx_points p JOIN fx_places q ON
            abs(floor(floor(p.lat * 1000) / 30) - floor(floor(q.lat * 1000) / 30)) <= 1 AND abs(floor(floor(p.lng * 1000) / 30) - floor(floor(q.lng * 1000) / 30)) <= 1)) WHERE n = 1""", "fx_points", "fx_places"),
        "split_labels": sql(
            "SELECT place_id, coalesce(nullif(name, ''), parts[1]) AS label, trim(array_to_string(parts[2:4], ',')) AS detail, CASE WHEN place_id % 9 <> 0 THEN CAST(place_id AS DOUBLE) END AS lat, CAST(place_id AS DOUBLE) AS lng FROM ("
            "SELECT place_id, CASE WHEN place_id % 2 = 0 THEN name END AS name, string_split(concat_ws(', ', street, district, city, state, 'x'), ',') AS parts FROM fx_places)", "fx_places"),
        "debounced_queries": "SELECT session, seq, query FROM (SELECT user_id % 50 AS session, event_id AS seq, event_type AS query, ts, lead(ts) OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS after FROM events) WHERE after IS NULL OR epoch_us(after) - epoch_us(ts) >= 60000000",
        "latest_request_wins": "SELECT user_id % 50 AS session, max(event_id) AS request_id, arg_max(event_type, event_id) AS reply FROM events GROUP BY 1",
        "adjacency_degree": sql("SELECT src, count(*) AS degree, count(DISTINCT dst) AS neighbours, round(sum(distance), 3) AS metres FROM o_edge GROUP BY src", "o_edge"),
        "edge_cell_index": sql(
            "SELECT sid, part, count(*) AS cells FROM (SELECT DISTINCT sid, part, cell_lat, cell_lng FROM (SELECT s.sid, s.part, unnest(generate_series(CAST(floor(least(lat1, lat2) * 1000) AS BIGINT), CAST(floor(greatest(lat1, lat2) * 1000) AS BIGINT))) AS cell_lat, lng1, lng2 FROM o_seg s JOIN o_net n ON n.sid = s.sid AND n.part = s.part WHERE a_key <> b_key) x, "
            "LATERAL (SELECT unnest(generate_series(CAST(floor(least(lng1, lng2) * 1000) AS BIGINT), CAST(floor(greatest(lng1, lng2) * 1000) AS BIGINT))) AS cell_lng) y) GROUP BY sid, part", "o_seg", "o_net"),
        "road_extract": sql(f"SELECT road, seq, highway FROM fx_road_vertices WHERE highway IN {in_list(dims.ROAD_CLASSES)} AND road IN (SELECT road FROM fx_road_vertices WHERE lat BETWEEN 45.455 AND 45.465 AND lng BETWEEN -122.69 AND -122.66)", "fx_road_vertices"),
        "paged_scan": sql("SELECT v.sid, CAST(floor(v.sid / 1000.0) AS BIGINT) AS page, any_value(ct_raw) AS ct, count(DISTINCT part) AS parts, count(*) AS points, round(sum(lat), 6) AS lat_sum FROM fx_vertices v JOIN fx_lines l ON l.sid = v.sid WHERE v.sid < 6000 GROUP BY v.sid", "fx_vertices", "fx_lines"),
        "collection_document": sql("SELECT v.sid, CASE WHEN max(part) > 0 THEN 'MultiLineString' ELSE 'LineString' END AS type, any_value(ct_raw) AS ct, any_value(name) AS name, count(*) AS points, round(sum(lng), 6) AS lng_sum FROM fx_vertices v JOIN fx_lines l ON l.sid = v.sid GROUP BY v.sid", "fx_vertices", "fx_lines"),
        "escaped_labels": sql(f"SELECT place_id, replace(replace(replace(concat_ws(' <&> ', name, street), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS label, {fixed('lat', 4)} || ', ' || {fixed('lng', 4)} AS point FROM fx_places", "fx_places"),
        "preference_count": sql("SELECT count(DISTINCT coalesce(nullif(group_id, ''), edge_key)) AS preferences FROM o_pref", "o_pref"),
        "preference_lines": sql("SELECT type, CAST(count(*) AS INTEGER) AS points, round(sum(lat), 4) AS lat_sum FROM fx_prefs p JOIN o_net n ON n.sid = p.sid AND n.part = 0 JOIN fx_vertices v ON v.sid = p.sid AND v.part = 0 GROUP BY type", "fx_prefs", "fx_vertices", "o_net"),
        "adjacency_lists": sql("SELECT src, string_agg(dst || ' ' || ct, '; ' ORDER BY sid, part, dir) AS edges FROM o_edge GROUP BY src", "o_edge"),
        "first_features": sql("SELECT city, min(place_id) AS place_id FROM fx_places GROUP BY city", "fx_places"),
        "grey_samples": sql(f"SELECT route_id, start_idx, i AS sample, CASE i WHEN 0 THEN start_idx WHEN 1 THEN (start_idx + end_idx) // 2 ELSE end_idx END AS idx FROM (SELECT route_id, min(idx) AS start_idx, max(idx) AS end_idx, sum(ahead) AS metres FROM (SELECT *, coalesce({hav('lat', 'lng', 'lat1', 'lng1')}, 0) AS ahead FROM (SELECT *, lead(lat) OVER w AS lat1, lead(lng) OVER w AS lng1 FROM o_run WINDOW w AS (PARTITION BY route_id ORDER BY idx))) WHERE tier = 'none' GROUP BY route_id, run) CROSS JOIN (VALUES (0), (1), (2)) t(i) WHERE metres > 20", "o_run"),
        "stale_replies": sql("SELECT pid FROM fx_points WHERE pid % 5 < 3", "fx_points"),
        "home_suggestions": "SELECT event_id FROM events WHERE event_id % 2 = 0 AND event_id % 6 IN (0, 1)",
        "injection_keys": sql("SELECT line_id, string_agg(key, '; ' ORDER BY begun) AS keys FROM (SELECT route_id AS line_id, key, min(since) AS begun FROM o_piece GROUP BY route_id, key) GROUP BY line_id", "fx_route_vertices", "o_measured", recursive=fold_along("o_cut", 200) + PIECES),
        "ensured_nodes": sql(
            f"""SELECT node_key, round(lat, 5) AS lat, round(lng, 5) AS lng FROM o_node UNION ALL SELECT node_key, round(arg_min(lat, route_id * 100 + idx), 5), round(arg_min(lng, route_id * 100 + idx), 5)
            FROM (SELECT *, {key('lat', 'lng')} AS node_key FROM fx_route_vertices) WHERE node_key NOT IN (SELECT node_key FROM o_node) GROUP BY node_key""", "o_node", "fx_route_vertices"),
        "reversals": sql(
            f"""SELECT route_id, idx, round(CASE WHEN d > 180 THEN 360 - d ELSE d END, 6) AS turn FROM (SELECT route_id, idx, abs(next_b - b) AS d FROM (SELECT *, lead(b) OVER (PARTITION BY route_id ORDER BY idx) AS next_b FROM (
              SELECT route_id, idx, {bear('lat0', 'lng0', 'lat', 'lng')} AS b FROM (SELECT v.route_id, v.idx, v.lat, v.lng, lag(v.lat) OVER w AS lat0, lag(v.lng) OVER w AS lng0
                FROM o_sample s JOIN fx_route_vertices v ON v.route_id = s.route_id AND v.idx = s.idx WHERE s.taken WINDOW w AS (PARTITION BY v.route_id ORDER BY v.idx)))))
            WHERE CASE WHEN d > 180 THEN 360 - d ELSE d END > 120""",
            "fx_route_vertices", "o_measured", recursive=fold_along("o_sample", 100)),
        "polyline_pieces": sql(
            f"SELECT route_id AS line_id, since AS from_idx, idx AS to_idx, round(metres, 3) AS metres, key FROM o_piece", "fx_route_vertices", "o_measured", recursive=fold_along("o_cut", 200) + PIECES),
        "preference_injection": sql(
            f"""SELECT key, '_PREF' AS ct, round(metres, 3) AS metres FROM o_new
            UNION ALL SELECT key, '_GAP', round(max(distance), 3) FROM (SELECT least(a.node_key, b.node_key) || '|' || greatest(a.node_key, b.node_key) AS key, {hav('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS distance
              FROM o_every a JOIN o_every b ON a.drawn AND a.node_key <> b.node_key AND b.cy BETWEEN a.cy - 3 AND a.cy + 3 AND b.cx BETWEEN a.cx - 3 AND a.cx + 3)
            WHERE distance <= 250 AND key NOT IN (SELECT key FROM o_net WHERE a_key <> b_key UNION ALL SELECT key FROM o_new) GROUP BY key""",
            "fx_route_vertices", "o_measured", "o_net", "o_node", recursive=fold_along("o_cut", 200) + PIECES + f""",
            o_new AS (SELECT key, metres FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY since, idx, metres) AS n FROM o_piece WHERE key NOT IN (SELECT key FROM o_net WHERE a_key <> b_key)) WHERE n = 1),
            o_ends AS (SELECT node_key, arg_min(lat, ord) AS lat, arg_min(lng, ord) AS lng FROM (SELECT {key('lat', 'lng')} AS node_key, lat, lng, route_id * 2 + CASE WHEN idx = 0 THEN 0 ELSE 1 END AS ord FROM fx_route_vertices WHERE idx IN (0, 23)) GROUP BY node_key),
            o_every AS (SELECT node_key, lat, lng, cy, cx, node_key IN (SELECT node_key FROM o_ends) AS drawn FROM o_node
              UNION ALL SELECT node_key, lat, lng, CAST(floor(lat * 1000) AS BIGINT), CAST(floor(lng * 1000) AS BIGINT), true FROM o_ends WHERE node_key NOT IN (SELECT node_key FROM o_node))"""),
        "waypoint_fold": sql(
            "SELECT session, n, round(coalesce(list_sum(s), 0.0), 6) AS lat_sum FROM (SELECT session, CAST(len(s) AS INTEGER) AS n, s, row_number() OVER (PARTITION BY session ORDER BY i DESC) AS last FROM o_fold) WHERE last = 1",
            recursive="""o_op AS (SELECT user_id % 50 AS session, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i, ['add', 'add', 'add', 'move', 'undo', 'clear'][CAST(1 + event_id % 17 % 6 AS INTEGER)] AS op, event_id % 3 AS idx, event_id / 1000.0 AS lat FROM events),
            o_fold(session, i, s) AS (SELECT DISTINCT session, CAST(0 AS BIGINT), CAST([] AS DOUBLE[]) FROM o_op
              UNION ALL SELECT f.session, o.i, CASE o.op WHEN 'add' THEN list_append(f.s, o.lat) WHEN 'move' THEN list_transform(f.s, lambda x, j: CASE WHEN j = o.idx + 1 THEN o.lat ELSE x END) WHEN 'undo' THEN list_slice(f.s, 1, len(f.s) - 1) WHEN 'clear' THEN [] ELSE f.s END
              FROM o_fold f JOIN o_op o ON o.session = f.session AND o.i = f.i + 1)"""),
        "nav_announcements": sql(
            "SELECT rider_id, event_id, idx, arrived, off_route, said FROM o_live WHERE i > 0", "o_match", "o_asof", "o_inst", "o_measured",
            recursive=f"""o_fix AS (SELECT m.rider_id, m.event_id, CAST(a.idx AS INTEGER) AS idx, off_m > 50 AS off_route, greatest(0.0, t.total - along_m) AS remaining, coalesce(greatest(0.0, x.distance - along_m), 0.0) AS to_turn, x.text AS next_text, epoch_us(m.ts) // 1000 AS ms,
                row_number() OVER (PARTITION BY m.rider_id ORDER BY m.ts, m.event_id) AS i
              FROM o_match m JOIN o_asof a ON a.event_id = m.event_id LEFT JOIN o_inst x ON x.route_id = m.route_id AND x.i = a.idx + 1 JOIN (SELECT route_id, sum(length) AS total FROM o_measured GROUP BY route_id) t ON t.route_id = m.route_id),
            o_live(rider_id, i, event_id, idx, arrived, off_route, said, last_idx, last_ms) AS (
              SELECT DISTINCT rider_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS INTEGER), false, false, CAST(NULL AS VARCHAR), CAST(-1 AS INTEGER), CAST(0 AS BIGINT) FROM o_fix
              UNION ALL SELECT rider_id, i, event_id, idx, was OR comes, off_route, CASE WHEN comes THEN 'You have arrived at your destination.' WHEN speaks THEN 'In ' || {VOICE} || ', ' || next_text WHEN reminds THEN next_text END,
                CASE WHEN speaks THEN idx ELSE last_idx END, CASE WHEN speaks OR reminds THEN ms ELSE last_ms END
              FROM (SELECT *, open AND idx <> last_idx AND to_turn <= 80 AS speaks, open AND idx = last_idx AND to_turn <= 20 AND ms - last_ms > 8000 AS reminds FROM (
                SELECT f.*, l.last_idx, l.last_ms, l.arrived AS was, NOT l.arrived AND f.remaining < 30 AS comes, NOT l.arrived AND f.remaining >= 30 AND f.next_text IS NOT NULL AS open FROM o_live l JOIN o_fix f ON f.rider_id = l.rider_id AND f.i = l.i + 1)))"""),
        "shortest_path_cost": sql(
            "SELECT od_id, round(cost, 3) AS cost FROM d JOIN o_goal g ON g.od_id = d.src AND g.z = d.node", "o_edge", "o_gap_ct", "o_snap", "fx_od",
            recursive=BEST.format(table="o_edge_cost") + SEARCH),
        "shortest_path_overrides": sql(
            "SELECT od_id, round(cost, 3) AS cost FROM d JOIN o_goal g ON g.od_id = d.src AND g.z = d.node", "o_edge", "o_gap_ct", "o_snap", "fx_od", "o_override",
            recursive=BEST.format(table=OVERRIDDEN.format(edges="o_edge_cost", over="o_override")) + SEARCH),
        "preference_replay": sql("SELECT key, ct, round(distance, 3) AS metres, seq * 2 AS insert_seq FROM o_added", "fx_route_vertices", "o_measured", "o_node", "o_net", "o_gap", recursive=REPLAY),
        "path_over_drawn": sql(
            "SELECT g.od_id, round(d.cost, 3) AS cost, coalesce(w.drawn, 0) AS drawn, round(coalesce(w.metres, 0.0), 3) AS drawn_m FROM d JOIN o_goal g ON g.od_id = d.src AND g.z = d.node LEFT JOIN (SELECT od, count(*) AS drawn, sum(distance) AS metres FROM o_way WHERE ct = '_PREF' GROUP BY od) w ON w.od = g.od_id",
            "fx_route_vertices", "o_measured", "o_node", "o_net", "o_gap", "o_edge", "o_gap_ct", "o_ask", "o_road", "fx_od", "o_pref",
            recursive=REPLAY + ", " + BEST.partition("o_best AS")[0].rstrip().removesuffix(",") + OVER_DRAWN + ", o_best AS" + BEST.partition("o_best AS")[2].format(table=OVERRIDDEN.format(edges="o_every_cost", over="o_over_d")) + SEARCH.replace("o_snap", "o_snap_d") + GUIDED_PARTS.partition("o_pt AS")[0].rstrip().removesuffix(",")),
        "guided_route_full": sql(GUIDED, "o_edge", "o_gap_ct", "o_snap", "fx_od", "fx_vertices", "o_node", recursive=BEST.format(table="o_edge_cost") + SEARCH + GUIDED_PARTS),
    }
    direct = f"{hav('start_lat', 'start_lng', '(start_lat + end_lat) / 2 + 0.0002', '(start_lng + end_lng) / 2')} + {hav('(start_lat + end_lat) / 2 + 0.0002', '(start_lng + end_lng) / 2', 'end_lat', 'end_lng')}"
    out["routes_by_profile"] = (
        f"SELECT od_id, 'safest' AS profile, route_source, metres, ascend, points, turns FROM ({out['guided_route_full']}) WHERE floor(od_id / 100) % 3 <> 1 UNION ALL SELECT od_id, 'balanced', 'router', round(metres, 3), CAST(4 AS DOUBLE), 3, 3 FROM ("
        + sql(f"SELECT od_id, {direct} AS metres FROM fx_od WHERE floor(od_id / 100) % 3 = 1 AND floor(od_id / 100) % 9 <> 4", "fx_od") + ")"
    )
    out["waypoint_routes"] = sql(
        f"""SELECT r.id AS request_id, CASE WHEN n < 2 THEN 'rejected' WHEN floor(r.id / 100) % 11 = 3 THEN 'unanswered' ELSE 'answered' END AS status, CASE WHEN n < 2 OR floor(r.id / 100) % 11 = 3 THEN 0 ELSE n END AS points,
        CASE WHEN n < 2 OR floor(r.id / 100) % 11 = 3 THEN NULL WHEN r.id % 3 = 0 AND r.id > 0 THEN CAST(r.id AS DOUBLE) ELSE round((SELECT sum(length) FROM o_measured m WHERE m.route_id = r.id + 7 AND m.seg < n - 1), 3) END AS metres
        FROM (SELECT route_id - 7 AS id, CAST((route_id - 7) / 100 % 5 AS BIGINT) AS n FROM fx_route_vertices WHERE idx = 0) r""", "fx_route_vertices", "o_measured")
    leg = "(SELECT sum(111320 * sqrt(pow(t.lat - f.lat, 2) + pow((t.lng - f.lng) * cos(radians(f.lat)), 2))) FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i, k) AS r FROM o_line) f JOIN (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i, k) AS r FROM o_line) t ON t.session = f.session AND t.r = f.r + 1 WHERE f.session = x.session)"
    out["drawing_with_undo"] = sql(
        f"SELECT session, CAST(len(s) AS INTEGER) AS n, CAST(coalesce((SELECT count(*) FROM o_line l WHERE l.session = x.session), 0) AS INTEGER) AS points, round(coalesce({leg}, 0.0), 3) AS metres, round(coalesce((SELECT sum((45.4 + (k % 5) * 0.01) * 100 - 122.6 - (k % 3) * 0.01) FROM (SELECT unnest(s) AS k)), 0.0), 6) AS at_sum FROM o_last x",
        recursive="""o_op AS (SELECT user_id % 50 AS session, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_id % 7 = 5 THEN 'undo' ELSE 'add' END AS op, event_id % 15 AS k FROM events),
            o_fold(session, i, s) AS (SELECT DISTINCT session, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM o_op
              UNION ALL SELECT f.session, o.i, CASE WHEN o.op = 'add' AND (len(f.s) = 0 OR (f.s[-1] * 7 + o.k) % 4 <> 0) THEN list_append(f.s, o.k) WHEN o.op = 'undo' THEN list_slice(f.s, 1, len(f.s) - 1) WHEN o.op = 'clear' THEN [] ELSE f.s END
              FROM o_fold f JOIN o_op o ON o.session = f.session AND o.i = f.i + 1),
            o_last AS (SELECT session, s FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY i DESC) AS last FROM o_fold) WHERE last = 1),
            o_leg AS (SELECT session, i, s[i] AS a, s[i + 1] AS z FROM (SELECT session, s, unnest(generate_series(1, len(s) - 1)) AS i FROM o_last) WHERE (s[i] + s[i + 1]) % 5 <> 0),
            o_line AS (SELECT l.session, l.i, k, CASE k WHEN 0 THEN 45.4 + (a % 5) * 0.01 WHEN 1 THEN 45.4 + (a % 5) * 0.01 + 0.001 ELSE 45.4 + (z % 5) * 0.01 END::DOUBLE AS lat, CASE k WHEN 0 THEN -122.6 - (a % 3) * 0.01 ELSE -122.6 - (z % 3) * 0.01 END::DOUBLE AS lng
              FROM o_leg l JOIN (SELECT session, min(i) AS first FROM o_leg GROUP BY session) m ON m.session = l.session CROSS JOIN (VALUES (0), (1), (2)) t(k) WHERE k > 0 OR l.i = first)""")
    out["road_extract_pushed"] = out["road_extract"]
    shown = f"CASE WHEN metres > 0 THEN CASE WHEN step_m < 160 THEN CAST({half_up('step_m')} AS VARCHAR) || ' m' ELSE {fixed('(step_m / 1609.34)', 1)} || ' mi' END ELSE '' END"
    inner = out["instructions_from_edges"].replace("round(distance, 3) AS metres, round(step, 3) AS step_m", "distance AS metres, step AS step_m")
    out["directions_listed"] = f"SELECT route_id, idx, text, {shown} AS shown FROM ({inner})"
    return out
