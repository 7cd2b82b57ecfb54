"""DuckDB SQL that gives the rows of the registered queries, built up from common table expressions."""

from __future__ import annotations

_SPANS = "spans AS (SELECT user_id % 50 AS key, event_id AS id, event_id * 7919 % 20011 - 500 AS start, event_id * 7919 % 20011 - 500 + CAST(floor(abs(coalesce(value, 0))) AS BIGINT) % 97 AS \"end\" FROM events)"
_REGIONS = "regions AS (SELECT o_custkey % 50 AS key, o_orderkey AS id, o_orderkey * 104729 % 20011 - 500 AS start, o_orderkey * 104729 % 20011 - 500 + o_orderkey % 41 AS \"end\" FROM orders)"
_LEVELS = ", ".join(f"{i}/51.0" for i in range(52))


def floor_div(x: str, n: int) -> str:
    return f"CAST(floor(({x}) / {n}.0) AS BIGINT)"


def _island(source: str, keys: str, name: str, start: str = "start", end: str = '"end"', rest: str = "") -> list[str]:
    return [
        f"{name}_seen AS (SELECT *, max({end}) OVER (PARTITION BY {keys} ORDER BY {start}, {end}{rest} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {source})",
        f"{name} AS (SELECT * EXCLUDE (seen), CAST(sum(CASE WHEN seen IS NULL OR {start} >= seen THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY {start}, {end}{rest} ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS island FROM {name}_seen)",
    ]


def _union_self(source: str, keys: str, name: str) -> list[str]:
    return [*_island(source, keys, f"{name}_i"), f"{name} AS (SELECT {keys}, min(start) AS start, max(\"end\") AS \"end\" FROM {name}_i GROUP BY {keys}, island)"]


def _span(source: str, keys: str, position: str, gap: int, name: str, out: str) -> list[str]:
    on = " AND ".join(f"h.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    pick = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    own = " AND ".join(f"b.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    return [
        f"{name}_p AS (SELECT DISTINCT {keys}, {position} AS p FROM {source})",
        f"{name}_n AS (SELECT *, min(p) OVER (PARTITION BY {keys} ORDER BY p RANGE BETWEEN {gap + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {name}_p)",
        f"{name}_h AS (SELECT {keys}, min(p) AS p FROM {name}_p GROUP BY {keys} UNION ALL SELECT {pick}, n.nxt AS p FROM {name}_h h JOIN {name}_n n ON {on} AND h.p = n.p WHERE n.nxt IS NOT NULL)",
        f"{name}_s AS (SELECT {pick}, n.p, max(h.p) OVER (PARTITION BY {pick} ORDER BY n.p) AS {out} FROM {name}_n n LEFT JOIN {name}_h h ON {on} AND h.p = n.p)",
        f"{name} AS (SELECT b.*, s.{out} FROM {source} b JOIN {name}_s s ON {own} AND b.{position} = s.p)",
    ]


_SIDE, _CLUSTER = "graph, direction", "graph, direction, fan_cluster"
_W = f"PARTITION BY {_CLUSTER} ORDER BY lc_idx"

#: From contacts to final stripes, in order; each expression may use those before it.
_CALL: list[str] = [
    "raw AS (SELECT 'chr' || CAST(1 + l_orderkey % 22 AS VARCHAR) AS graph, (l_partkey * 7919 + l_linenumber * 131) % 4001 * 2500 AS p, (l_suppkey * 104729 + l_orderkey * 17) % 4001 * 2500 AS q, CAST(1000 + (l_linenumber % 3) * 2000 AS BIGINT) AS w, CAST(l_quantity AS BIGINT) AS petcount FROM lineitem)",
    "contacts AS (SELECT graph, least(p, q) AS sa, least(p, q) + w AS ea, greatest(p, q) AS sb, greatest(p, q) + w AS eb, petcount FROM raw)",
    "prep AS (SELECT graph, sa // 5000 * 5000 + 1 AS sa, ((ea - 2) // 5000 + 1) * 5000 + 1 AS ea, sb // 5000 * 5000 + 1 AS sb, ((eb - 2) // 5000 + 1) * 5000 + 1 AS eb, CAST(petcount AS DOUBLE) AS petcount FROM contacts)",
    "anchors AS (SELECT graph, sa AS s, ea AS e FROM prep UNION SELECT graph, sb, eb FROM prep)",
    "wide AS (SELECT *, least(s + 1, e) AS start, greatest(e - 1, least(s + 1, e)) AS \"end\" FROM anchors)",
    *_island("wide", "graph", "placed"),
    "nodes AS (SELECT graph, island AS node_id, min(s) AS start, max(e) AS \"end\", max(e - s + 1) AS max_length, count(*) AS n_anchors, (min(s) + max(e)) // 2 AS midpoint FROM placed GROUP BY graph, island)",
    "edges AS (SELECT c.graph, a.island AS node_id_A, b.island AS node_id_B, count(*) AS n_contacts, sum(petcount) AS total_petcount, min(petcount) AS min_petcount, max(petcount) AS max_petcount, min(abs(sa - sb + ea - eb) // 2) AS min_length, max(abs(sa - sb + ea - eb) // 2) AS max_length FROM prep c JOIN placed a ON a.graph = c.graph AND a.s = c.sa AND a.e = c.ea JOIN placed b ON b.graph = c.graph AND b.s = c.sb AND b.e = c.eb WHERE a.island <> b.island GROUP BY c.graph, a.island, b.island)",
    "pairs AS (SELECT graph, least(node_id_A, node_id_B) AS low, greatest(node_id_A, node_id_B) AS high, count(*) AS times, first(node_id_A ORDER BY node_id_A) AS na, first(node_id_B ORDER BY node_id_A) AS nb, first(n_contacts ORDER BY node_id_A) AS n_contacts, first(total_petcount ORDER BY node_id_A) AS weight FROM edges GROUP BY ALL)",
    "ends AS (SELECT graph, low AS anchor, high AS leaf, times, na, nb, n_contacts, weight FROM pairs UNION ALL SELECT graph, high, low, times, na, nb, n_contacts, weight FROM pairs)",
    "blades AS (SELECT e.*, a.start AS anchor_start, a.\"end\" AS anchor_end, l.start AS leaf_start, l.\"end\" AS leaf_end, CASE WHEN l.start < a.start THEN 'L' ELSE 'R' END AS direction, CASE WHEN l.start < a.start THEN -l.\"end\" ELSE l.start END AS position FROM ends e JOIN nodes a ON a.graph = e.graph AND a.node_id = e.anchor JOIN nodes l ON l.graph = e.graph AND l.node_id = e.leaf)",
    *_span("blades", _SIDE, "anchor_start", 15000, "fanned", "fan_cluster"),
    *_span("fanned", _CLUSTER, "position", 15000, "clustered", "loop_cluster"),
    f"lc0 AS (SELECT {_CLUSTER}, loop_cluster, min(anchor_start) AS anchor_start, max(anchor_end) AS anchor_end, min(leaf_start) AS leafs_start, max(leaf_end) AS leafs_end, CAST(sum(times) AS BIGINT) AS n_edges, sum(weight * times) AS weight, CAST(sum(n_contacts * times) AS BIGINT) AS loop_count, first(na ORDER BY position, anchor_start, leaf) AS first_a, first(nb ORDER BY position, anchor_start, leaf) AS first_b FROM clustered GROUP BY {_CLUSTER}, loop_cluster)",
    f"lc1 AS (SELECT *, row_number() OVER (PARTITION BY {_CLUSTER} ORDER BY loop_cluster) - 1 AS lc_idx FROM lc0)",
    f"sid AS (SELECT {_CLUSTER}, row_number() OVER (ORDER BY CAST(substr(graph, 4) AS INTEGER), graph, direction = 'L', fan_cluster) - 1 AS stripe_id FROM (SELECT DISTINCT {_CLUSTER} FROM lc1))",
    f"lc AS (SELECT l.*, s.stripe_id FROM lc1 l JOIN sid s ON l.graph = s.graph AND l.direction = s.direction AND l.fan_cluster = s.fan_cluster)",
    f"lg0 AS (SELECT *, min(anchor_start) OVER (PARTITION BY {_CLUSTER}) AS first_start, max(anchor_end) OVER (PARTITION BY {_CLUSTER}) AS last_end FROM lc)",
    f"lg1 AS (SELECT *, CASE WHEN direction = 'R' THEN leafs_end - first_start ELSE last_end - leafs_start END AS length, CASE WHEN direction = 'R' THEN leafs_start - coalesce(lag(leafs_end) OVER ({_W}), first_start) ELSE coalesce(lag(leafs_start) OVER ({_W}), last_end) - leafs_end END AS gap_size, CAST(leafs_end - leafs_start AS DOUBLE) / (anchor_end - anchor_start) AS orientation_score FROM lg0)",
    "lg AS (SELECT *, greatest(0.0, -log10(CAST(greatest(gap_size, 1000) AS DOUBLE) / greatest(length, 1000))) AS raw_gap_score FROM lg1)",
    f"quantiles AS (SELECT unnest(quantile_cont(raw_gap_score, [{_LEVELS}])) AS q, unnest([{_LEVELS}]) AS level FROM lg)",
    "knots AS (SELECT round(q, 12) AS q, min(level) AS level FROM quantiles GROUP BY round(q, 12))",
    "scores0 AS (SELECT v.raw_gap_score, max(CASE WHEN k.q <= v.r THEN k.q END) AS x0, min(CASE WHEN k.q > v.r THEN k.q END) AS x1, any_value(v.r) AS r FROM (SELECT DISTINCT raw_gap_score, round(raw_gap_score, 12) AS r FROM lg) v, knots k GROUP BY v.raw_gap_score)",
    "scores AS (SELECT s.raw_gap_score, CASE WHEN x0 IS NULL THEN (SELECT min(level) FROM knots) WHEN x1 IS NULL THEN (SELECT max(level) FROM knots) ELSE k0.level + (k1.level - k0.level) / (x1 - x0) * (r - x0) END AS gap_score FROM scores0 s LEFT JOIN knots k0 ON k0.q = x0 LEFT JOIN knots k1 ON k1.q = x1)",
    "gs AS (SELECT l.*, s.gap_score FROM lg l JOIN scores s ON l.raw_gap_score = s.raw_gap_score)",
    f"rs AS (SELECT *, min(gap_score) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS worst_gap_score, pow(avg(pow(gap_score, 2)) OVER ({_W} ROWS UNBOUNDED PRECEDING), 0.5) AS stripe_score, greatest(gap_score, coalesce(lead(gap_score) OVER ({_W}), gap_score)) AS l_score, least(gap_score, coalesce(lead(gap_score) OVER ({_W}), gap_score)) AS low_score FROM gs)",
    f"holds AS (SELECT c.graph, CASE WHEN c.direction = 'R' THEN 'L' ELSE 'R' END AS direction, c.na, c.nb, max({{'f': c.fan_cluster, 'i': l.lc_idx}}) AS o FROM clustered c JOIN lc l ON l.graph = c.graph AND l.direction = c.direction AND l.fan_cluster = c.fan_cluster AND l.loop_cluster = c.loop_cluster GROUP BY c.graph, c.direction, c.na, c.nb)",
    "links AS (SELECT l.graph, l.direction, l.fan_cluster, l.lc_idx, h.o.f AS other_cluster, h.o.i AS other_idx FROM lc l JOIN holds h ON h.graph = l.graph AND h.direction = l.direction AND h.na = l.first_a AND h.nb = l.first_b)",
    "ws AS (SELECT r.*, CASE WHEN r.direction = 'R' THEN 0.0 ELSE coalesce(o.low_score, 0.0) END AS w_score FROM rs r LEFT JOIN links k ON k.graph = r.graph AND k.direction = r.direction AND k.fan_cluster = r.fan_cluster AND k.lc_idx = r.lc_idx LEFT JOIN rs o ON o.graph = k.graph AND o.direction <> k.direction AND o.fan_cluster = k.other_cluster AND o.lc_idx = k.other_idx)",
    f"cs AS (SELECT *, last_value(l_score) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) / greatest(last_value(w_score) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0.01) AS cross_score FROM ws)",
]


def _summary(source: str, name: str, order: str = "lc_idx") -> list[str]:
    """Stripes of loop clusters: extents, counts, scores. Distinct fans and leafs come from the blades."""
    return [
        f"{name}_n AS (SELECT s.graph, s.direction, s.stripe_id, count(DISTINCT c.anchor) AS n_fans, count(DISTINCT c.leaf) AS n_leafs FROM {source} s JOIN clustered c ON c.graph = s.graph AND c.direction = s.direction AND c.fan_cluster = s.fan_cluster AND c.loop_cluster = s.loop_cluster GROUP BY s.graph, s.direction, s.stripe_id)",
        f"{name}_e AS (SELECT graph, direction, stripe_id, min(anchor_start) AS anchor_start, max(anchor_end) AS anchor_end, CASE WHEN direction = 'R' THEN min(anchor_start) ELSE min(leafs_start) END AS start, CASE WHEN direction = 'R' THEN max(leafs_end) ELSE max(anchor_end) END AS \"end\", count(*) AS n_loop_clusters, CAST(sum(n_edges) AS BIGINT) AS n_edges, arg_max(stripe_score, {order}) AS stripe_score, arg_max(worst_gap_score, {order}) AS last_gap_score, avg(cross_score) AS mean_cross_score, max(orientation_score) AS best_orientation FROM {source} GROUP BY graph, direction, stripe_id)",
        f"{name} AS (SELECT e.*, e.\"end\" - e.start AS length, e.anchor_end - e.anchor_start AS width, n.n_fans, n.n_leafs FROM {name}_e e JOIN {name}_n n ON n.graph = e.graph AND n.direction = e.direction AND n.stripe_id = e.stripe_id)",
    ]


def _filter(source: str) -> str:
    return f"SELECT * FROM {source} WHERE length >= 20000 AND n_loop_clusters >= 2 AND n_leafs >= 2 AND n_edges >= 2 AND last_gap_score >= 0 AND stripe_score >= 0 AND mean_cross_score >= 0 AND best_orientation >= 0.5"


_RESULT = 'SELECT graph AS chromosome, direction, stripe_id, anchor_start, anchor_end, width, start, "end", length, n_fans, n_loop_clusters, n_leafs, n_edges, round(stripe_score, 6) AS stripe_score, round(mean_cross_score, 6) AS mean_cross_score FROM '

_FINAL = [
    *_summary("cs", "raw_stripes"),
    f"passed AS ({_filter('raw_stripes')})",
    "ordered AS (SELECT *, row_number() OVER (PARTITION BY graph, direction ORDER BY stripe_id) AS n FROM passed)",
    "fold AS (SELECT graph, direction, n, stripe_id, stripe_id AS run_id, anchor_start AS a0, anchor_end AS a1, start AS s, \"end\" AS e FROM ordered WHERE n = 1 UNION ALL SELECT o.graph, o.direction, o.n, o.stripe_id, CASE WHEN j THEN f.run_id ELSE o.stripe_id END, CASE WHEN j THEN least(f.a0, o.anchor_start) ELSE o.anchor_start END, CASE WHEN j THEN greatest(f.a1, o.anchor_end) ELSE o.anchor_end END, CASE WHEN NOT j THEN o.start WHEN o.direction = 'R' THEN least(f.a0, o.anchor_start) ELSE least(f.s, o.start) END, CASE WHEN NOT j THEN o.\"end\" WHEN o.direction = 'R' THEN greatest(f.e, o.\"end\") ELSE greatest(f.a1, o.anchor_end) END FROM (SELECT f.*, o.n AS m, f.a1 - o.anchor_start <= 0 AND o.anchor_end - f.a0 <= 80000 AND abs(o.length - (f.e - f.s)) <= 200000 AS j FROM fold f JOIN ordered o ON o.graph = f.graph AND o.direction = f.direction AND o.n = f.n + 1) f JOIN ordered o ON o.graph = f.graph AND o.direction = f.direction AND o.n = f.m)",
    "last_runs AS (SELECT graph, direction, max(run_id) AS run_id, row_number() OVER (PARTITION BY direction ORDER BY CAST(substr(graph, 4) AS INTEGER) DESC, graph DESC) AS back FROM fold GROUP BY graph, direction)",
    "runs AS (SELECT f.* FROM fold f JOIN last_runs l ON l.graph = f.graph AND l.direction = f.direction WHERE NOT (f.run_id = l.run_id AND l.back > 1))",
    "merged AS (SELECT c.* EXCLUDE (stripe_id, lc_idx), r.run_id AS stripe_id, row_number() OVER (PARTITION BY c.graph, c.direction, r.run_id ORDER BY CASE WHEN c.direction = 'R' THEN c.leafs_start ELSE -c.leafs_start END, c.stripe_id, c.lc_idx) - 1 AS lc_idx FROM cs c JOIN runs r ON r.graph = c.graph AND r.direction = c.direction AND r.stripe_id = c.stripe_id)",
    *_summary("merged", "final_stripes"),
]


def _call(select: str, extra: list[str] | None = None) -> str:
    return "WITH RECURSIVE " + ",\n".join([*_CALL, *(extra or [])]) + "\n" + select


def _spans(select: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_SPANS, _REGIONS, *ctes]) + "\n" + select


_OFF = 'greatest(b.start - a."end", a.start - b."end")'
_PAIR = 'FROM spans a JOIN regions b ON a.key = b.key'
_SAME = 'FROM spans a JOIN regions b ON a.id = b.id'
_MEET = 'a.start < b."end" AND b.start < a."end"'
_SETS = "sets AS (SELECT *, id % 3 AS dataset FROM spans)"
_TRIM_STOP = "direction = 'L' AND length >= 20000 AND (length > 4000000 OR worst_gap_score < 0.3)"

_COUNTS = [
    _SETS,
    f"met AS (SELECT a.dataset AS dataset_A, b.dataset AS dataset_B, a.key, a.id AS id_A, b.id AS id_B FROM sets a JOIN sets b ON a.key = b.key AND {_MEET})",
    "sizes AS (SELECT dataset, count(DISTINCT id) AS n FROM sets GROUP BY dataset)",
    "counted AS (SELECT m.dataset_A, m.dataset_B, count(DISTINCT id_A) AS m_A, count(DISTINCT id_B) AS m_B FROM met m GROUP BY m.dataset_A, m.dataset_B)",
    "counts AS (SELECT c.*, a.n AS n_A, b.n AS n_B, c.m_A / a.n AS p_A, c.m_B / b.n AS p_B FROM counted c JOIN sizes a ON a.dataset = c.dataset_A JOIN sizes b ON b.dataset = c.dataset_B)",
]
_VIEW = "x0 <= 4000000 AND x1 >= 1000000 AND y0 <= 4000000 AND y1 >= 1000000"

ORACLES: dict[str, str] = {
    "interval_bin": _spans(f'SELECT id, {floor_div("start - 1", 100)} AS bin_start, {floor_div("greatest(start, \"end\" - 1) - 1", 100)} + 1 AS bin_end, {floor_div("start - 1", 100)} * 100 + 1 AS start, ({floor_div("greatest(start, \"end\" - 1) - 1", 100)} + 1) * 100 + 1 AS "end" FROM spans'),
    "interval_expand": _spans('SELECT id, least(start + 20, "end") AS start, greatest("end" - 5, least(start + 20, "end")) AS "end", start + 7 AS shifted_start, "end" + 7 AS shifted_end FROM spans'),
    "interval_clip": _spans('SELECT id, least(greatest(start, 0), 10000) AS start, least(greatest("end", 0), 10000) AS "end" FROM spans'),
    "interval_split_at": _spans('SELECT id, least(start, 5000) AS left_start, least(5000, "end") AS left_end, greatest(start, 5000) AS right_start, greatest(5000, "end") AS right_end, least("end" - 10, start) AS tail_left_start, least("end" - 10, "end") AS tail_left_end, greatest("end" - 10, start) AS tail_right_start, "end" AS tail_right_end FROM spans'),
    "interval_split_ratio": _spans('SELECT id, least(start, start + CAST(round_even(("end" - start) * 0.5, 0) AS BIGINT)) AS left_start, least(start + CAST(round_even(("end" - start) * 0.5, 0) AS BIGINT), "end") AS left_end, greatest(start + CAST(round_even(("end" - start) * 0.5, 0) AS BIGINT), start) AS right_start, "end" AS right_end FROM spans'),
    "interval_measures": _spans(f'SELECT id, "end" - start AS length, {floor_div("start + \"end\"", 2)} AS center, "end" = start AS empty, "end" >= start AS valid FROM spans'),
    "interval_and_or_sup_gap": _spans(f'SELECT a.id AS id, greatest(a.start, b.start) AS and_start, greatest(greatest(a.start, b.start), least(a."end", b."end")) AS and_end, least(a.start, b.start) AS sup_start, greatest(a."end", b."end") AS sup_end, least(a."end", b."end") AS gap_start, greatest(least(a."end", b."end"), greatest(a.start, b.start)) AS gap_end, least(a.start, b.start) AS or_left_start, CASE WHEN {_OFF} <= 0 THEN greatest(a."end", b."end") ELSE least(a."end", b."end") END AS or_left_end, CASE WHEN {_OFF} <= 0 THEN greatest(a."end", b."end") ELSE greatest(a.start, b.start) END AS or_right_start, greatest(a."end", b."end") AS or_right_end {_SAME}'),
    "interval_offset_distance_overlap": _spans(f'SELECT a.id AS id, {_OFF} AS "offset", greatest({_OFF}, 0) AS distance, least(a."end" - a.start, b."end" - b.start, -least({_OFF}, 0)) AS overlap, greatest(b.start - a."end", a.start - b.start) AS point_offset {_SAME}'),
    "interval_predicates": _spans(f'''SELECT a.id AS id, c AS contains, c OR b.start = b."end" AS superset, d AS contained, d OR a.start = a."end" AS subset, least(a."end" - a.start, b."end" - b.start, -least({_OFF}, 0)) > 0 AS intersects, {_OFF} > 0 AS separated, a.start = b.start AND a."end" = b."end" AS equal, a.start <> b.start OR a."end" <> b."end" AS differs, a.start <= b.start AND (b.start < a."end" OR a.start = a."end") AS contains_point
FROM (SELECT a, b, a.start <= b.start AND (b.start < a."end" OR a.start = a."end") AND (a.start < b."end" OR b.start = b."end") AND b."end" <= a."end" AS c, b.start <= a.start AND (a.start < b."end" OR b.start = b."end") AND (b.start < a."end" OR a.start = a."end") AND a."end" <= b."end" AS d {_SAME})'''),
    "interval_format_parse": _spans("SELECT id, 'chr' || key || ':' || start || '..' || \"end\" AS label, 'chr' || key AS chromosome, start, \"end\", '#' || id || ' [' || printf('%08d', start) || ']' AS formatted FROM spans"),
    "interval_islands": _spans("SELECT key, id, start, \"end\", island FROM i", *_island("spans", "key", "i", rest=", id")),
    "interval_union_self": _spans("SELECT * FROM u", *_union_self("spans", "key", "u")),
    "interval_union_other": _spans("SELECT * FROM u", 'both_sets AS (SELECT key, start, "end" FROM spans UNION ALL SELECT key, start, "end" FROM regions)', *_union_self("both_sets", "key", "u")),
    "interval_intersect_self": _spans(f'SELECT key, {floor_div("start", 50)} AS part, max(start) AS start, min("end") AS "end" FROM spans GROUP BY ALL HAVING max(start) <= min("end")'),
    "interval_intersect_other": _spans(f'SELECT a.key, greatest(a.start, b.start) AS start, least(a."end", b."end") AS "end" FROM u a JOIN v b ON a.key = b.key AND {_MEET}', *_union_self("spans", "key", "u"), *_union_self("regions", "key", "v")),
    "interval_disjoint": _spans("SELECT key, part, max(island) + 1 = count(*) AS disjoint FROM i GROUP BY key, part", f'parts AS (SELECT *, {floor_div("start", 200)} AS part FROM spans)', *_island("parts", "key, part", "i")),
    "interval_hull": _spans('SELECT key, count(*) AS n, min(start) AS start, max("end") AS "end" FROM spans GROUP BY key'),
    "interval_concat": _spans("SELECT 'spans' AS part, key, id, start, \"end\" FROM spans UNION ALL SELECT 'regions', key, id, start, \"end\" FROM regions"),
    "interval_head_tail": _spans("SELECT * FROM (SELECT 'head' AS part, start, \"end\" FROM spans ORDER BY start, \"end\" LIMIT 20) UNION ALL SELECT * FROM (SELECT 'tail', start, \"end\" FROM spans ORDER BY start DESC, \"end\" DESC LIMIT 20)"),
    "range_join": _spans(f'SELECT a.key AS key_A, a.id AS id_A, a.start AS start_A, a."end" AS end_A, b.key AS key_B, b.id AS id_B, b.start AS start_B, b."end" AS end_B, -{_OFF} AS overlap {_PAIR} WHERE {_MEET}'),
    "range_join_tolerance": _spans(f'SELECT a.key AS key_A, a.id AS id_A, a.start AS start_A, a."end" AS end_A, b.key AS key_B, b.id AS id_B, b.start AS start_B, b."end" AS end_B, -{_OFF} AS overlap {_PAIR} WHERE a.start - 3 < b."end" + 2 AND b.start - 2 < a."end" + 3'),
    "overlap_counts": _spans("SELECT dataset_A, dataset_B, m_A, m_B, n_A, n_B, round(p_A, 6) AS p_A, round(p_B, 6) AS p_B FROM counts", *_COUNTS),
    "overlap_counts_two": _spans(f'''SELECT m.part_A, m.part_B, m_A, m_B, a.n AS n_A, b.n AS n_B, round(m_A / a.n, 6) AS p_A, round(m_B / b.n, 6) AS p_B
FROM (SELECT a.id % 3 AS part_A, b.id % 2 AS part_B, count(DISTINCT a.id) AS m_A, count(DISTINCT b.id) AS m_B {_PAIR} WHERE {_MEET} GROUP BY a.id % 3, b.id % 2) m
JOIN (SELECT id % 3 AS part, count(DISTINCT id) AS n FROM spans GROUP BY id % 3) a ON a.part = m.part_A JOIN (SELECT id % 2 AS part, count(DISTINCT id) AS n FROM regions GROUP BY id % 2) b ON b.part = m.part_B'''),
    "overlap_mapping_pivot": _spans('SELECT dataset_A, coalesce(max(m_A) FILTER (dataset_B = 0), 0) AS "0", coalesce(max(m_A) FILTER (dataset_B = 1), 0) AS "1", coalesce(max(m_A) FILTER (dataset_B = 2), 0) AS "2" FROM counts GROUP BY dataset_A', *_COUNTS),
    "overlap_mapping_percentages": _spans("SELECT dataset_A, dataset_B, CAST(round(p_A * 100) AS BIGINT) AS percent, CAST(CASE WHEN dataset_A = dataset_B THEN n_A ELSE CAST(round(p_A * 100) AS BIGINT) END AS VARCHAR) AS label FROM counts", *_COUNTS),
    "domain_compare": _spans(f'''SELECT dataset_A, dataset_B, m_A, m_B, a.n AS n_A, b.n AS n_B, round(m_A / a.n, 6) AS p_A, round(m_B / b.n, 6) AS p_B
FROM (SELECT a.dataset AS dataset_A, b.dataset AS dataset_B, count(DISTINCT (a.key, a.start)) AS m_A, count(DISTINCT (b.key, b.start)) AS m_B FROM u a JOIN u b ON a.key = b.key AND {_MEET} GROUP BY a.dataset, b.dataset)
JOIN (SELECT dataset, count(*) AS n FROM u GROUP BY dataset) a ON a.dataset = dataset_A JOIN (SELECT dataset, count(*) AS n FROM u GROUP BY dataset) b ON b.dataset = dataset_B''', _SETS, *_union_self("sets", "dataset, key", "u")),
    "label_collapse": _spans("SELECT CAST(dataset_A AS VARCHAR) || '/x' AS dataset_label_A, CAST(dataset_B AS VARCHAR) || '/x' AS dataset_label_B, m_A FROM counts", *_COUNTS),
    "chrom_natural_order": _call("SELECT graph, CAST(substr(graph, 4) AS INTEGER) AS chrom_index, row_number() OVER (ORDER BY CAST(substr(graph, 4) AS INTEGER)) AS place, count(*) AS n FROM contacts GROUP BY graph"),
    "chrom_filters": _call("SELECT graph AS chromosome_A, sa AS start_A, ea AS end_A, graph AS chromosome_B, sb AS start_B, eb AS end_B, petcount FROM contacts WHERE graph IN ('chr1', 'chr2', 'chr10') AND petcount >= 25"),
    "bedpe_prepare": _call("SELECT graph AS chromosome_A, sa AS start_A, ea AS end_A, graph AS chromosome_B, sb AS start_B, eb AS end_B, petcount FROM prep"),
    "anchors_distinct": _call('SELECT graph, s AS start, e AS "end", (s + e) // 2 AS midpoint, e - s + 1 AS length, row_number() OVER (PARTITION BY graph ORDER BY s, e) - 1 AS anchor_id FROM anchors'),
    "nodes": _call("SELECT * FROM nodes"),
    "nodes_one_each": _call('SELECT graph, row_number() OVER (PARTITION BY graph ORDER BY s, e) - 1 AS node_id, s AS start, e AS "end" FROM anchors'),
    "edges": _call("SELECT * FROM edges"),
    "edges_holistic_agg": _call("SELECT c.graph, a.island AS node_id_A, b.island AS node_id_B, count(*) AS n_contacts, max(petcount) AS max_petcount, round(quantile_cont(petcount, 0.5), 6) AS median_petcount, round(quantile_cont(petcount, 0.75), 6) AS q3_petcount, round(quantile_cont(CAST(abs(sa - sb + ea - eb) // 2 AS DOUBLE), 0.5), 6) AS median_length, round(avg(petcount), 6) AS mean_petcount FROM prep c JOIN placed a ON a.graph = c.graph AND a.s = c.sa AND a.e = c.ea JOIN placed b ON b.graph = c.graph AND b.s = c.sb AND b.e = c.eb WHERE a.island <> b.island GROUP BY ALL"),
    "edges_user_agg": _call("SELECT c.graph, a.island AS node_id_A, b.island AS node_id_B, count(*) AS n_contacts, round(avg(petcount), 6) AS mean_petcount FROM prep c JOIN placed a ON a.graph = c.graph AND a.s = c.sa AND a.e = c.ea JOIN placed b ON b.graph = c.graph AND b.s = c.sb AND b.e = c.eb WHERE a.island <> b.island GROUP BY ALL"),
    "strand_edges": _call("SELECT graph, node_id AS node_id_A, node_id_B, length FROM (SELECT graph, node_id, lead(node_id) OVER w AS node_id_B, lead(midpoint) OVER w - midpoint AS length FROM nodes WINDOW w AS (PARTITION BY graph ORDER BY node_id)) WHERE node_id_B IS NOT NULL"),
    "fans": _call("SELECT graph, direction, anchor, min(anchor_start) AS anchor_start, max(anchor_end) AS anchor_end, min(leaf_start) AS leafs_start, max(leaf_end) AS leafs_end, CAST(sum(times) AS BIGINT) AS size FROM blades GROUP BY graph, direction, anchor HAVING sum(times) BETWEEN 2 AND 50"),
    "fan_span_clusters": _call("SELECT DISTINCT graph, direction, anchor_start, fan_cluster FROM fanned"),
    "fan_sort_order": _call(f"""SELECT graph, direction, CASE WHEN min(anchor_start) = max(anchor_start) THEN 'Constant' ELSE 'Ascending' END AS "order" FROM blades GROUP BY graph, direction
UNION ALL SELECT graph, direction, CASE WHEN low = 0 AND high = 0 THEN 'Constant' WHEN low >= 0 THEN 'Ascending' WHEN high <= 0 THEN 'Descending' ELSE 'Unsorted' END FROM (SELECT graph, direction, coalesce(min(step), 0) AS low, coalesce(max(step), 0) AS high FROM (
SELECT CAST(key AS VARCHAR) AS graph, CAST({floor_div("id", 200)} AS VARCHAR) AS direction, start - lag(start) OVER (PARTITION BY key, {floor_div("id", 200)} ORDER BY id) AS step FROM spans) GROUP BY graph, direction)""", [_SPANS]),
    "loop_clusters": _call("SELECT graph, direction, fan_cluster, loop_cluster, lc_idx, stripe_id, anchor_start, anchor_end, leafs_start, leafs_end, n_edges, weight, loop_count FROM lc"),
    "orthogonal_links": _call("SELECT * FROM links"),
    "lc_lengths_gaps": _call("SELECT stripe_id, lc_idx, length, gap_size, round(orientation_score, 6) AS orientation_score, round(raw_gap_score, 6) AS raw_gap_score FROM lg"),
    "gap_quantile_knots": _call("SELECT round(q, 6) AS q, round(level, 6) AS level FROM knots"),
    "gap_scores": _call("SELECT stripe_id, lc_idx, round(gap_score, 6) AS gap_score FROM gs"),
    "stripe_scores": _call("SELECT stripe_id, lc_idx, round(worst_gap_score, 6) AS worst_gap_score, round(stripe_score, 6) AS stripe_score, round(l_score, 6) AS l_score FROM rs"),
    "cross_scores": _call("SELECT stripe_id, lc_idx, round(w_score, 6) AS w_score, round(cross_score, 6) AS cross_score FROM cs"),
    "stripes_raw": _call(_RESULT + "raw_stripes", _summary("cs", "raw_stripes")),
    "stripes_trimmed": _call(_RESULT + "trimmed_stripes", [f"cuts AS (SELECT *, min(CASE WHEN {_TRIM_STOP} THEN lc_idx END) OVER (PARTITION BY {_CLUSTER}) AS cut FROM cs)", "trimmed AS (SELECT * FROM cuts WHERE cut IS NULL OR lc_idx < cut)", *_summary("trimmed", "trimmed_stripes")]),
    "stripes_filtered": _call(_RESULT + f"({_filter('raw_stripes')})", _summary("cs", "raw_stripes")),
    "stripes_merge_runs": _call("SELECT graph, direction, stripe_id, run_id FROM runs", _FINAL),
    "stripes_final": _call(_RESULT + "final_stripes", _FINAL),
    "feature_describe": _call("SELECT feature, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, " + ", ".join(f"round(quantile_cont(v, {q / 100}), 6) AS p{q}" for q in (1, 5, 25, 50, 75, 95, 99)) + ", max(v) AS max FROM (SELECT 'length' AS feature, CAST(length AS DOUBLE) AS v FROM lg UNION ALL SELECT 'gap_size', CAST(gap_size AS DOUBLE) FROM lg UNION ALL SELECT 'loop_count', CAST(loop_count AS DOUBLE) FROM lg) GROUP BY feature"),
    "stripe_histogram": _call("SELECT direction, CAST(least(greatest(floor((length - 0.0) / 200000.0), 0), 49) AS INTEGER) AS bin, count(*) AS n FROM lg GROUP BY ALL"),
    "stripe_counts": _call("SELECT graph AS chromosome, direction, count(*) AS n FROM raw_stripes GROUP BY ALL", _summary("cs", "raw_stripes")),
    "viewer_export": _call("SELECT substr(graph, 4) AS chr, anchor_start - 10 - CASE WHEN direction = 'R' THEN 1 ELSE 0 END AS pos1, anchor_end + 10 AS pos2, substr(graph, 4) AS chr2, start - CASE WHEN direction = 'R' THEN 25 ELSE 10 END AS pos3, \"end\" + CASE WHEN direction = 'R' THEN 10 ELSE 25 END AS pos4, '#009900' AS color, stripe_id, direction FROM raw_stripes", _summary("cs", "raw_stripes")),
    "bed_domains": _call("SELECT graph AS chr, start - CASE WHEN direction = 'R' THEN 25 ELSE 10 END AS start, \"end\" + CASE WHEN direction = 'R' THEN 10 ELSE 25 END AS \"end\" FROM raw_stripes", _summary("cs", "raw_stripes")),
    "view_rectangles": _call(f"""SELECT stripe_id, side, x0 AS start_x, x1 AS end_x, y0 AS start_y, y1 AS end_y, round((x0 - 1000000) / 5000.0, 6) AS x_bin, round((y0 - 1000000) / 5000.0, 6) AS y_bin, round((x1 - x0) / 5000.0, 6) AS width_bins, round((y1 - y0) / 5000.0, 6) AS height_bins FROM (
SELECT stripe_id, side, CASE WHEN swap THEN start ELSE anchor_start END AS x0, CASE WHEN swap THEN "end" ELSE anchor_end END AS x1, CASE WHEN swap THEN anchor_start ELSE start END AS y0, CASE WHEN swap THEN anchor_end ELSE "end" END AS y1
FROM (SELECT *, CASE WHEN side = 'upper' THEN below ELSE NOT below END AS swap FROM (SELECT *, abs(start - anchor_end) < abs("end" - anchor_start) AS below, unnest(['upper', 'lower']) AS side FROM raw_stripes WHERE graph = 'chr1'))) WHERE {_VIEW}""", _summary("cs", "raw_stripes")),
    "view_points": _call("""SELECT side, x, y, round((x - 1000000) / 5000.0, 6) AS x_bin, round((y - 1000000) / 5000.0, 6) AS y_bin FROM (
SELECT side, CASE WHEN swap THEN cy ELSE cx END AS x, CASE WHEN swap THEN cx ELSE cy END AS y FROM (SELECT *, CASE WHEN side = 'upper' THEN cy > cx ELSE cy < cx END AS swap FROM (SELECT (sa + ea) // 2 AS cx, (sb + eb) // 2 AS cy, unnest(['upper', 'lower']) AS side FROM contacts WHERE graph = 'chr1')))
WHERE x BETWEEN 1000000 AND 4000000 AND y BETWEEN 1000000 AND 4000000"""),
    "view_loop_clusters": _call(f"""SELECT stripe_id, lc_idx, x0 AS start_x, x1 AS end_x, y0 AS start_y, y1 AS end_y, round(score, 6) AS score FROM (
SELECT c.stripe_id, lc_idx, stripe_score AS score, CASE WHEN direction = 'L' THEN lo_x ELSE least(lo_x, pos) END AS x0, CASE WHEN direction = 'L' THEN hi_x ELSE greatest(hi_x, pos) END AS x1, CASE WHEN direction = 'R' THEN lo_y ELSE least(lo_y, pos) END AS y0, CASE WHEN direction = 'R' THEN hi_y ELSE greatest(hi_y, pos) END AS y1
FROM (SELECT *, least(anchor_start, leafs_start) AS lo_x, CASE WHEN anchor_start <= leafs_start THEN anchor_end ELSE leafs_end END AS hi_x, greatest(leafs_start, anchor_start) AS lo_y, CASE WHEN anchor_start <= leafs_start THEN leafs_end ELSE anchor_end END AS hi_y FROM cs) c
JOIN (SELECT stripe_id, (anchor_start + anchor_end) // 2 AS pos FROM raw_stripes WHERE graph = 'chr1' AND anchor_start <= 4000000 AND anchor_end >= 1000000) p ON p.stripe_id = c.stripe_id) WHERE {_VIEW}""", _summary("cs", "raw_stripes")),
    "view_gap_segments": _call("""SELECT stripe_id, lc_idx, CASE WHEN direction = 'R' THEN prev ELSE pos END AS x0, CASE WHEN direction = 'R' THEN pos ELSE prev END AS y0, CASE WHEN direction = 'R' THEN leafs_start ELSE pos END AS x1, CASE WHEN direction = 'R' THEN pos ELSE leafs_end END AS y1 FROM (
SELECT c.*, p.pos, coalesce(lag(CASE WHEN direction = 'R' THEN leafs_end ELSE leafs_start END) OVER (PARTITION BY c.stripe_id ORDER BY lc_idx), p.pos) AS prev FROM cs c
JOIN (SELECT stripe_id, (anchor_start + anchor_end) // 2 AS pos FROM raw_stripes WHERE graph = 'chr1' AND anchor_start <= 4000000 AND anchor_end >= 1000000) p ON p.stripe_id = c.stripe_id)""", _summary("cs", "raw_stripes")),
    "view_matrix": _call("SELECT CAST(floor(((sa + ea) // 2 - 0) / 50000.0) AS BIGINT) AS x_bin, CAST(floor(((sb + eb) // 2 - 0) / 50000.0) AS BIGINT) AS y_bin, CAST(sum(petcount) AS BIGINT) AS value FROM contacts WHERE graph = 'chr1' AND (sa + ea) // 2 BETWEEN 0 AND 5000000 AND (sb + eb) // 2 BETWEEN 0 AND 5000000 GROUP BY ALL"),
    "threeway_merge": "SELECT c.c_custkey, c.c_nationkey, n.n_nationkey, n.n_regionkey AS n_regionkey, n.n_name, s.s_suppkey, s.s_nationkey, s.s_acctbal FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN supplier s ON s.s_nationkey = n.n_nationkey",
    "group_matching": "SELECT coalesce(a.key, b.key) AS key, coalesce(a.n, 0) AS n_A, coalesce(b.n, 0) AS n_B FROM (SELECT o_custkey % 997 AS key, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id % 1009 AS key, count(*) AS n FROM events GROUP BY 1) b ON a.key = b.key",
    "catalog_align": "SELECT coalesce(s.k, p.k) AS k, coalesce(s.path, '') AS supplier, coalesce(p.path, '') AS part FROM (SELECT s_suppkey AS k, 'supplier/' || s_suppkey AS path FROM supplier) s FULL JOIN (SELECT p_partkey * 3 AS k, 'part/' || p_partkey AS path FROM part) p ON s.k = p.k",
    "interval_drop_empty": _spans('SELECT * FROM spans WHERE start <> "end"'),
    "interval_sort": _spans('SELECT *, row_number() OVER (ORDER BY key, start, "end", id) - 1 AS place FROM spans'),
    "interval_sort_descending": _spans('SELECT key, id, lag(id) OVER (PARTITION BY key ORDER BY start DESC, "end" DESC, id) AS after FROM spans'),
    "interval_subset": _spans("SELECT s.*, v.place, 'numbers' AS how FROM spans s JOIN (VALUES (5, 0), (3, 1), (3, 2), (77, 3), (1000000000000, 4), (9, 5)) v(row, place) ON s.id = v.row UNION ALL SELECT *, NULL, 'mask' FROM spans WHERE key < 7"),
    "interval_records": _spans("SELECT 'chr' || key AS chromosome, CAST(id AS VARCHAR) AS name, start, \"end\" FROM spans WHERE id % 5 > 0"),
    "interval_accessors": _spans('SELECT key, count(start) AS n, min(start) AS first_start, max("end") AS last_end, count(DISTINCT id) AS ids FROM spans GROUP BY key'),
    "interval_global_islands": _spans(
        "SELECT i.key, id, island + before AS island, n - 1 - island + before AS from_end FROM i JOIN (SELECT key, n, coalesce(sum(n) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT key, max(island) + 1 AS n FROM i GROUP BY key)) b ON b.key = i.key",
        *_island("spans", "key", "i", rest=", id"),
    ),
    "interval_merge_sorted": _spans('SELECT *, row_number() OVER (ORDER BY key, start, "end", side) - 1 AS place FROM (SELECT key, start, "end", 0 AS side FROM spans UNION ALL SELECT key, start, "end", 1 FROM regions)'),
    "unsorted_points": _spans(f'SELECT part, min(CASE WHEN start < before THEN id END) AS "at" FROM (SELECT *, {floor_div("id", 100)} AS part, lag(start) OVER (PARTITION BY {floor_div("id", 100)} ORDER BY id) AS before FROM spans) GROUP BY part'),
    "unsorted_ranges": _spans(f'SELECT part, min(CASE WHEN (block < b) OR (block = b AND "end" < e) THEN id END) AS "at" FROM (SELECT *, lag(block) OVER w AS b, lag("end") OVER w AS e FROM (SELECT *, {floor_div("id", 50)} AS part, {floor_div("start", 5000)} AS block FROM spans) WINDOW w AS (PARTITION BY part ORDER BY id)) GROUP BY part'),
    "overlap_counts_threshold": _spans(
        f"SELECT dataset_A, dataset_B, m_A, m_B, a.n AS n_A, b.n AS n_B, round(m_A / a.n, 6) AS p_A, round(m_B / b.n, 6) AS p_B FROM (SELECT a.dataset AS dataset_A, b.dataset AS dataset_B, count(DISTINCT a.id) AS m_A, count(DISTINCT b.id) AS m_B FROM sets a JOIN sets b ON a.key = b.key AND {_OFF} <= -40 GROUP BY ALL) JOIN sizes a ON a.dataset = dataset_A JOIN sizes b ON b.dataset = dataset_B",
        _SETS, _COUNTS[2],
    ),
    "overlap_counts_absent": _spans(
        f"SELECT a.dataset AS dataset_A, b.dataset AS dataset_B, coalesce(m_A, 0) AS m_A, coalesce(m_B, 0) AS m_B, a.n AS n_A, b.n AS n_B, round(coalesce(m_A, 0) / a.n, 6) AS p_A, round(coalesce(m_B, 0) / b.n, 6) AS p_B FROM sizes a CROSS JOIN sizes b LEFT JOIN (SELECT a.dataset AS da, b.dataset AS db, count(DISTINCT a.id) AS m_A, count(DISTINCT b.id) AS m_B FROM sets a JOIN sets b ON a.key = b.key AND {_MEET} GROUP BY ALL) ON a.dataset = da AND b.dataset = db",
        f"sets AS (SELECT *, {floor_div('start', 2000)} AS dataset FROM spans)", _COUNTS[2],
    ),
    "join_by_indices": _spans('SELECT a.key AS key_A, a.id AS row_id_A, a.start AS start_A, a."end" AS end_A, b.key AS key_B, b.id AS row_id_B, b.start AS start_B, b."end" AS end_B FROM spans a JOIN regions b ON b.id = a.id * 3 + 1'),
    "group_positions": _spans("SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM spans"),
    "nodes_sorted": _call("SELECT graph, node_id, max_length, row_number() OVER (ORDER BY max_length, graph, node_id) - 1 AS place FROM nodes"),
    "edges_with_strands": _call("SELECT graph, node_id_A, node_id_B, n_contacts, total_petcount, true AS is_contact, false AS is_strand, total_petcount AS weight, 0 AS length FROM edges UNION ALL SELECT graph, node_id, nxt, 0, 0.0, false, true, 2.0, length FROM (SELECT graph, node_id, lead(node_id) OVER w AS nxt, lead(midpoint) OVER w - midpoint AS length FROM nodes WINDOW w AS (PARTITION BY graph ORDER BY node_id)) WHERE nxt IS NOT NULL"),
    "graph_hooks": _call("SELECT n.graph, nodes + 1 AS nodes, 0 AS first, 0 AS least, edges + 1 AS edges, CAST(contacts AS BIGINT) AS contacts, -1 AS low FROM (SELECT graph, count(*) AS nodes FROM nodes GROUP BY graph) n JOIN (SELECT graph, count(*) AS edges, sum(n_contacts) AS contacts FROM edges GROUP BY graph) e ON e.graph = n.graph"),
    "stripe_histograms": _call(
        "SELECT feature, bin, round(least + bin * width, 6) AS low, round(least + (bin + 1) * width, 6) AS high, count(*) AS n FROM (SELECT f.feature, least, (most - least) / 50 AS width, CAST(CASE WHEN most > least THEN least(floor((v - least) / ((most - least) / 50)), 49) ELSE 0 END AS INTEGER) AS bin FROM f JOIN (SELECT feature, min(v) AS least, max(v) AS most FROM f GROUP BY feature) m ON m.feature = f.feature) GROUP BY ALL",
        ["f AS (SELECT 'length' AS feature, CAST(length AS DOUBLE) AS v FROM lg UNION ALL SELECT 'loop_count', CAST(loop_count AS DOUBLE) FROM lg)"],
    ),
    "stripes_of_datasets": _call("SELECT dataset, graph AS chromosome, direction, count(*) AS n, min(anchor_start) AS first, CAST(sum(width) AS BIGINT) AS width FROM (SELECT 'raw' AS dataset, graph, direction, anchor_start, width FROM raw_stripes UNION ALL SELECT 'final', graph, direction, anchor_start, width FROM final_stripes) GROUP BY ALL", _FINAL),
    "stripes_compare": _call(
        f"SELECT dataset_A, dataset_B, m_A, m_B, a.n AS n_A, b.n AS n_B, round(m_A / a.n, 6) AS p_A, round(m_B / b.n, 6) AS p_B FROM (SELECT a.dataset AS dataset_A, b.dataset AS dataset_B, count(DISTINCT a.id) AS m_A, count(DISTINCT b.id) AS m_B FROM sets a JOIN sets b ON a.graph = b.graph AND a.direction = b.direction AND {_OFF} <= 0 GROUP BY ALL) JOIN sizes a ON a.dataset = dataset_A JOIN sizes b ON b.dataset = dataset_B",
        [*_FINAL, "sets AS (SELECT 'raw' AS dataset, graph, direction, stripe_id AS id, anchor_start AS start, anchor_end AS \"end\" FROM raw_stripes UNION ALL SELECT 'final', graph, direction, stripe_id, anchor_start, anchor_end FROM final_stripes)", _COUNTS[2]],
    ),
    "view_regions": _call(f"""SELECT stripe_id, x0 AS start_x, x1 AS end_x, y0 AS start_y, y1 AS end_y FROM (
SELECT stripe_id, CASE WHEN below THEN anchor_start ELSE start END AS x0, CASE WHEN below THEN anchor_end ELSE "end" END AS x1, CASE WHEN below THEN start ELSE anchor_start END AS y0, CASE WHEN below THEN "end" ELSE anchor_end END AS y1
FROM (SELECT *, abs(start - anchor_end) < abs("end" - anchor_start) AS below FROM raw_stripes WHERE graph = 'chr1')) WHERE {_VIEW}""", _summary("cs", "raw_stripes")),
    "view_rectangles_padded": _call(f"""SELECT stripe_id, x0 AS start_x, x1 AS end_x, y0 AS start_y, y1 AS end_y FROM (
SELECT stripe_id, anchor_start - 2500 AS x0, anchor_end + 2500 AS x1, start - CASE WHEN direction = 'L' THEN 7000 ELSE 0 END AS y0, "end" + CASE WHEN direction = 'L' THEN 0 ELSE 7000 END AS y1 FROM raw_stripes WHERE graph = 'chr1') WHERE {_VIEW}""", _summary("cs", "raw_stripes")),
    "view_labels": _call("""SELECT c.stripe_id, CASE WHEN direction = 'R' THEN high ELSE low END AS x, pos AS y, printf('%d(%.2f|%.2f|%.2f|%.1f)', c.stripe_id, s, g, k, o) AS label FROM (
SELECT stripe_id, direction, arg_max(stripe_score, lc_idx) AS s, avg(worst_gap_score) AS g, avg(cross_score) AS k, max(orientation_score) AS o, min(leafs_start) AS low, max(leafs_end) AS high FROM cs GROUP BY stripe_id, direction) c
JOIN (SELECT stripe_id, (anchor_start + anchor_end) // 2 AS pos FROM raw_stripes) p ON p.stripe_id = c.stripe_id""", _summary("cs", "raw_stripes")),
    "view_colour_limit": _call("SELECT round(greatest(quantile_cont(value, 0.95), 1.0), 6) AS \"limit\" FROM (SELECT CAST(sum(petcount) AS DOUBLE) AS value FROM contacts WHERE graph = 'chr1' AND (sa + ea) // 2 BETWEEN 0 AND 5000000 AND (sb + eb) // 2 BETWEEN 0 AND 5000000 GROUP BY floor(((sa + ea) // 2) / 50000.0), floor(((sb + eb) // 2) / 50000.0))"),
}
