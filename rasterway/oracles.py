"""DuckDB SQL with the same results as the registered queries."""

from __future__ import annotations

from rasterway.plans.lookups import BASE_LINE_COSTS, ISO_LOOKUP, ISO_MULTIPLIERS, LAND_USE_CLASSES, NEW_SUBSTATION_COSTS, POWER_CLASSES, TRANSFORMER_COSTS, UPGRADE_SUBSTATION_COSTS
from rasterway.plans.scenario import POLARITY_SCALE


def _cells(n: int = 32) -> str:
    return f"""cells AS (
  SELECT (l_orderkey % {n})::INTEGER AS "row", (l_partkey % {n})::INTEGER AS col, (sum(l_quantity) % 97 + 1)::FLOAT AS c1, (count(*) % 7 + 1)::FLOAT AS c2, (sum(l_quantity) % 13)::FLOAT AS slope,
         ([11, 21, 24, 41, 81, 90])[(sum(l_quantity) % 6)::INTEGER + 1] AS nlcd, ((l_orderkey % {n}) % 4 + 1)::INTEGER AS iso, (sum(l_quantity) % 10 = 0)::INTEGER::FLOAT AS barrier, ((count(*) % 3) / 2.0)::FLOAT AS fric,
         (sum(l_quantity) % 5 + 1)::FLOAT AS inv, (sum(l_quantity) % 4)::FLOAT AS zone
  FROM lineitem GROUP BY l_orderkey % {n}, l_partkey % {n})"""


_C = "WITH " + _cells()
_CR = "WITH RECURSIVE " + _cells(8)
#: All cells of the 32 by 32 grid.
_ALL = "allcells AS (SELECT a.range::INTEGER AS \"row\", b.range::INTEGER AS col FROM range(32) a, range(32) b)"
_EXT = "ext AS (SELECT *, NOT slope > 3 AS wet, (slope > 3 AND slope < 6) AS landfall, (slope > 3 AND slope < 6) != (slope > 3) AS dry FROM cells)"
_LU = {name: codes for name, codes in LAND_USE_CLASSES.items()}


def _case(pairs, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


def _dry(spec: dict) -> str:
    lu = _case([(f"nlcd IN ({', '.join(map(str, _LU[n]))})", f"{v}::DOUBLE") for n, v in reversed(list((spec.get("land_use") or {}).items()))], "1.0::DOUBLE") if spec.get("land_use") else "1.0::DOUBLE"
    s = spec["slope"]
    return f"({lu}) * (CASE WHEN slope >= {s['mtn_slope']} THEN {s['mtn_mult']}::DOUBLE WHEN slope >= {s['hill_slope']} THEN {s['hill_mult']}::DOUBLE ELSE 1.0::DOUBLE END)"


_DEFAULT = {"land_use": {"forest": 1.25}, "slope": {"hill_mult": 1.5, "hill_slope": 2, "mtn_mult": 3, "mtn_slope": 8}}
_DRY = "CASE WHEN nlcd = 11 THEN 10.0::DOUBLE ELSE " + _case([(f"iso = {ISO_LOOKUP[m['iso']]}", _dry(m)) for m in ISO_MULTIPLIERS], "{default}") + " END"


def _line_cost(power: int) -> str:
    return _case([(f"iso = {ISO_LOOKUP[n]}", f"({c[str(power)]}::DOUBLE / 1609.344::DOUBLE * 90.0::DOUBLE)") for n, c in BASE_LINE_COSTS.items()], "0.0")


_OFF = "off AS (SELECT a.range - 1 AS di, b.range - 1 AS dj FROM range(3) a, range(3) b WHERE NOT (a.range = 1 AND b.range = 1))"
_HALF = "CASE WHEN di <> 0 AND dj <> 0 THEN 0.7071067811865476::FLOAT ELSE 0.5::FLOAT END"


def _plain_edges(n: int, column: str = "c1", where: str = "true") -> str:
    return f"""{_OFF}, edges AS (
  SELECT a."row" * {n} + a.col AS src, b."row" * {n} + b.col AS dst, trunc(({_HALF} * (a.{column} + b.{column})) * 10000::FLOAT)::BIGINT AS w
  FROM cells a, off, cells b WHERE b."row" = a."row" + di AND b.col = a.col + dj AND {where})"""


def _distance(starts: str, edges: str = "edges", name: str = "t") -> str:
    """Least distances from (id, n) rows."""
    return f"""{name}(id, n, d) USING KEY (id, n) AS (
  {starts}
  UNION
  SELECT id, dst, min(d) FROM (SELECT {name}.id AS id, e.dst AS dst, {name}.d + e.w AS d FROM {name} JOIN {edges} e ON e.src = {name}.n) q
  WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} r WHERE r.id = q.id AND r.n = q.dst AND r.d <= q.d) GROUP BY id, dst)"""


_STEPS = """steps AS (
  SELECT user_id AS route_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INTEGER AS step, (event_id % 32)::INTEGER AS "row", ((event_id * 7 + user_id) % 32)::INTEGER AS col, (length(event_type) % 2)::INTEGER AS "option" FROM events)"""
_MEASURED = _STEPS + """, measured AS (
  SELECT *, coalesce(sqrt(("row" - lag("row") OVER w) ** 2 + (col - lag(col) OVER w) ** 2), 0) / 2 + coalesce(sqrt(("row" - lead("row") OVER w) ** 2 + (col - lead(col) OVER w) ** 2), 0) / 2 AS len
  FROM steps WINDOW w AS (PARTITION BY route_id ORDER BY step))"""
_ROUTES = """routes AS (SELECT o_orderkey AS route_id, (o_orderkey % 32)::INTEGER AS start_row, (o_custkey % 32)::INTEGER AS start_col, ((o_orderkey + 7) % 8)::INTEGER AS end_row, (o_custkey % 5)::INTEGER AS end_col, o_orderpriority AS voltage, o_orderstatus AS polarity, o_totalprice AS price FROM orders)"""
_POINTS = "points AS (SELECT c_custkey AS id, (c_custkey * 37 % 2880)::DOUBLE AS x, (c_custkey * 53 % 2880)::DOUBLE AS y FROM customer)"
_REGIONS = "regions AS (SELECT r_regionkey AS rid, r_regionkey % 3 * 900.0 AS x0, r_regionkey % 2 * 1500.0 AS y0, r_regionkey % 3 * 900.0 + 600 AS x1, r_regionkey % 2 * 1500.0 + 800 AS y1 FROM region)"
_GAP = "sqrt(greatest(x0 - x, 0, x - x1)::DOUBLE ** 2 + greatest(y0 - y, 0, y - y1)::DOUBLE ** 2)"
_LENGTHS = "lens AS (SELECT o_orderkey, o_totalprice AS cost, (o_orderkey % 2000) / 100.0::DOUBLE AS length_km FROM orders)"
_STEPM = "CASE WHEN length_km < 3 * 1.609344::DOUBLE THEN 1.5::DOUBLE WHEN length_km <= 10 * 1.609344::DOUBLE THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END"
_ZONES = "zones AS (SELECT n_nationkey AS id, n_nationkey % 5 * 500.0::DOUBLE + 33 AS x0, floor(n_nationkey / 5) * 600.0::DOUBLE - 107 AS y0 FROM nation)"
#: Cells of each box, touched by more than an edge or by centre, and the share inside.
_TOUCHED = _ZONES + """, hits AS (SELECT z.id, c.*, greatest(0, least(c.col * 90 + 90, x0 + 700) - greatest(c.col * 90, x0)) * greatest(0, least(2880 - c."row" * 90, y0 + 410) - greatest(2790 - c."row" * 90, y0)) AS part
  FROM zones z JOIN cells c ON c.col * 90 < x0 + 700 AND c.col * 90 + 90 > x0 AND 2790 - c."row" * 90 < y0 + 410 AND 2880 - c."row" * 90 > y0)"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["grid_coordinates"] = _C + ' SELECT "row", col, (col + 0.5) * 90.0::DOUBLE AS x, 2880.0::DOUBLE + ("row" + 0.5) * -90.0::DOUBLE AS y FROM cells'
    q["grid_of_point"] = 'SELECT c_custkey, floor((c_custkey * 53 % 2880 - 2880) / -90.0)::INTEGER AS "row", floor((c_custkey * 37 % 2880) / 90.0)::INTEGER AS col FROM customer'
    q["grid_resampled"] = _C + """, t AS (SELECT a.range::INTEGER AS "row", b.range::INTEGER AS col, floor(((2880 + (a.range + 0.5) * -144) - 2880) / -90.0)::INTEGER AS r, floor((b.range + 0.5) * 144 / 90.0)::INTEGER AS c FROM range(20) a, range(20) b)
      SELECT t."row", t.col, coalesce(c1, 0)::FLOAT AS c1, coalesce(nlcd, 0)::INTEGER AS nlcd FROM t LEFT JOIN cells ON cells."row" = t.r AND cells.col = t.c"""
    q["grid_from_long"] = _C + ' SELECT "row", col, c1, c2 FROM cells'
    q["grid_tiles"] = _C + ' SELECT ("row" // 10)::BIGINT AS i, (col // 10)::BIGINT AS j, count(*) AS cells, max(c1) AS largest FROM cells GROUP BY 1, 2'
    q["store_layer"] = _C + f""", {_ALL} SELECT a."row", a.col, (a.col + 0.5) * 90.0::DOUBLE AS x, 2880.0::DOUBLE + (a."row" + 0.5) * -90.0::DOUBLE AS y, c1, (c1 * 2)::FLOAT AS c2 FROM allcells a LEFT JOIN cells USING ("row", col)"""
    q["store_window"] = _C + ' SELECT a.range::INTEGER AS "row", b.range::INTEGER AS col, c1 FROM range(-2, 6) a CROSS JOIN range(28, 35) b LEFT JOIN cells ON cells."row" = a.range AND cells.col = b.range'
    q["store_resampled"] = "WITH " + _cells(16) + f""", {_ALL} SELECT a."row", a.col, coalesce(c1, 0)::FLOAT AS c1, coalesce(nlcd, 0)::INTEGER AS nlcd FROM allcells a LEFT JOIN cells c ON c."row" = a."row" // 2 AND c.col = a.col // 2"""
    q["store_layers_deleted"] = "SELECT * FROM (VALUES ('c1', 'float'), ('nlcd', 'int')) t(layer, kind)"
    q["features_read"] = """WITH s AS (SELECT s_suppkey::INTEGER AS id, (s_suppkey % 90)::DOUBLE AS x, s_suppkey % 3 AS k FROM supplier)
      SELECT id, (['Polygon', 'MultiPolygon', 'MultiLineString'])[k + 1] AS type, (CASE k WHEN 1 THEN 3 ELSE 2 END)::INTEGER AS n_parts, CASE k WHEN 0 THEN 800.0::DOUBLE WHEN 1 THEN 825.0::DOUBLE END AS area,
        57.5 >= x AND 57.5 < x + 30 AND NOT (57.5 >= x + 10 AND 57.5 < x + 20) AS holds, round(x + 5, 6) AS gap FROM s"""
    q["points_read"] = f"WITH {_POINTS} SELECT id, x, y FROM points"
    boxed = """hit AS (SELECT a."row", a.col, max((x0 IS NOT NULL)::INTEGER) AS land, max((x0 IS NOT NULL AND NOT (a.col * 90 >= x0 AND a.col * 90 + 90 <= x0 + 700 AND 2790 - a."row" * 90 >= y0 AND 2880 - a."row" * 90 <= y0 + 410))::INTEGER) AS coast
      FROM allcells a LEFT JOIN zones z ON a.col * 90 < x0 + 700 AND a.col * 90 + 90 > x0 AND 2790 - a."row" * 90 < y0 + 410 AND 2880 - a."row" * 90 > y0 GROUP BY 1, 2)"""
    q["layer_file"] = f"""{_C}, {_ALL}, {_ZONES}, {_REGIONS}, {boxed}, m AS (SELECT h.*, land = 0 AS wet, coast = 1 AS landfall, land <> coast AS dry, EXISTS (SELECT 1 FROM regions r WHERE h.col * 90 < x1 AND h.col * 90 + 90 > x0 AND 2790 - h."row" * 90 < y1 AND 2880 - h."row" * 90 > y0) AS park FROM hit h),
      j AS (SELECT m."row" AS "row", m.col AS col, wet, dry, landfall, park, c1, c2, fric, iso, nlcd, slope FROM m LEFT JOIN cells c ON c."row" = m."row" AND c.col = m.col)
      SELECT "row", col, CASE WHEN c1 IS NOT NULL THEN CASE WHEN dry THEN c1 ELSE 0 END + CASE WHEN landfall THEN 3 ELSE 0 END + CASE WHEN park THEN 5 ELSE 0 END END::FLOAT AS land, CASE WHEN c1 IS NOT NULL THEN CASE WHEN wet OR landfall THEN c2 ELSE 0 END END::FLOAT AS sea,
        CASE WHEN c1 IS NOT NULL THEN fric + CASE WHEN wet OR landfall THEN c2 ELSE 0 END * 1e6::DOUBLE END::FLOAT AS merged, CASE WHEN c1 IS NOT NULL THEN ({_DRY.format(default='1.0')}) END::FLOAT AS dry_multipliers, wet::INTEGER AS wet_mask, dry::INTEGER AS dry_mask, landfall::INTEGER AS landfall_mask FROM j"""
    q["store_append"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders"
    q["routes_collected"] = f"WITH {_ROUTES} SELECT route_id, start_row, start_col, end_row, end_col FROM routes"
    q["layer_bins"] = _C + ' SELECT "row", col, ((CASE WHEN c1 < 20 THEN 1 ELSE 0 END) + (CASE WHEN c1 >= 10 AND c1 < 50 THEN 5 ELSE 0 END) + (CASE WHEN c1 >= 50 THEN 9 ELSE 0 END))::FLOAT AS v FROM cells'
    q["layer_map"] = _C + ' SELECT "row", col, (CASE nlcd WHEN 11 THEN 3 WHEN 24 THEN 7.5 WHEN 90 THEN 1 ELSE 0 END)::FLOAT AS v FROM cells'
    ext = {"all": "true", "wet": "wet", "wet+": "wet OR landfall", "landfall": "landfall", "dry+": "dry OR landfall", "dry": "dry"}
    q["layer_extents"] = _C + f", {_EXT} SELECT \"row\", col, " + ", ".join(f"(CASE WHEN {c} THEN 2 + c1 ELSE 0 END)::FLOAT AS e_{n.replace('+', 'p')}" for n, c in ext.items()) + " FROM ext"
    q["layer_fill"] = _C + ' SELECT "row", col, (CASE WHEN zone IN (1, 2) THEN -5 ELSE c1 END)::FLOAT AS v FROM cells'
    q["layer_forced_inclusion"] = _C + f', {_EXT} SELECT "row", col, (CASE WHEN barrier > 0 THEN 0 ELSE c1 + CASE WHEN wet THEN 1 ELSE 0 END END)::FLOAT AS v FROM ext'
    q["layer_cost_per_mile"] = _C + ' SELECT "row", col, (1609.344::DOUBLE * c1::DOUBLE / 1609.344::DOUBLE * 2.0::DOUBLE)::FLOAT AS v FROM cells'
    q["layer_masks"] = _C + f", {_EXT} SELECT \"row\", col, " + ", ".join(f'({c})::INTEGER AS "{n.replace("+", "_plus")}"' for n, c in ext.items()) + " FROM ext"
    q["layer_stored_masks"] = _C + """, ext AS (SELECT *, c2 % 2 = 1 AS wet, zone = 1 AS dry, barrier = 1 AS landfall FROM cells) SELECT "row", col, """ + ", ".join(f'({c})::INTEGER AS "{n.replace("+", "_plus")}"' for n, c in ext.items()) + " FROM ext"
    q["dry_multipliers"] = _C + f", moved AS (SELECT * REPLACE ((iso + col % 2)::INTEGER AS iso) FROM cells) SELECT \"row\", col, ({_DRY.format(default=_dry(_DEFAULT))})::FLOAT AS m FROM moved"
    q["dry_tie_line_costs"] = _C + ' SELECT "row", col, ' + ", ".join(f"round((CASE WHEN barrier = 0 THEN ({_line_cost(p)})::FLOAT * ({_DRY.format(default='1.0')})::FLOAT ELSE 0 END)::FLOAT::DOUBLE, 0) AS \"tie_line_costs_{p}MW\"" for p in POWER_CLASSES.values()) + " FROM cells"
    q["friction_and_barriers"] = _C + ' SELECT "row", col, (fric + barrier * 1e6::DOUBLE)::FLOAT AS v FROM cells'

    q["scenario_surface"] = _C + """
      SELECT "row", col, 0 AS "option", CASE WHEN c1 * 0.5::FLOAT * c2 + slope > 0 THEN ((c1 * 0.5::FLOAT * c2 + slope) * (1::FLOAT + fric * 2::FLOAT))::FLOAT END AS cost, (inv * (1::FLOAT + fric * 2::FLOAT))::FLOAT AS inv,
             (CASE WHEN slope < 4 THEN 1.5 ELSE 1 END)::FLOAT AS driver, false AS hard, greatest(CASE WHEN zone >= 3 THEN 2 ELSE 0 END, CASE WHEN nlcd = 24 THEN 1 ELSE 0 END)::INTEGER AS soft_rank FROM cells
      UNION ALL
      SELECT "row", col, 1, ((c1 * 4::FLOAT + c2) * c2)::FLOAT, (inv * 2::FLOAT * c2)::FLOAT, (CASE WHEN slope < 2 THEN 0.5 WHEN slope < 4 THEN NULL ELSE 2 END)::FLOAT, barrier > 0, 0 FROM cells"""
    q["scenario_final_layers"] = _C + """ SELECT "row", col, (CASE WHEN (c1 * c2 * 0.5::FLOAT + slope) * (1::FLOAT + fric * 2::FLOAT) <= 0 THEN -1 ELSE (c1 * c2 * 0.5::FLOAT + slope) * (1::FLOAT + fric * 2::FLOAT) END)::FLOAT AS overhead,
      (CASE WHEN NOT barrier > 0 THEN (c1 * 4::FLOAT + c2) * c2 END)::FLOAT AS underground FROM cells"""
    q["scenario_report_costs"] = _C + """ SELECT "row", col, 'overhead' AS option_name, (c1 * c2 * 0.5::FLOAT + slope)::FLOAT AS cost, inv AS li_cost FROM cells
      UNION ALL SELECT "row", col, 'underground', (c2 * 3::FLOAT * c2)::FLOAT, (inv * 2::FLOAT * 3::FLOAT * c2)::FLOAT FROM cells"""
    q["scenario_soft_invalid_costs"] = _C + ' SELECT "row", col, (CASE WHEN slope <= 0 THEN 1e10 ELSE slope END)::FLOAT::DOUBLE AS cost FROM cells'
    q["scenario_for_voltage"] = _C + f""" SELECT "row", col, 0 AS "option", (c1 * 2::FLOAT + slope * {4000 * POLARITY_SCALE}::FLOAT)::FLOAT AS cost FROM cells
      UNION ALL SELECT "row", col, 1, CASE WHEN c2 * 0.5::FLOAT * fric + c2 * 3::FLOAT * inv > 0 THEN (c2 * 0.5::FLOAT * fric + c2 * 3::FLOAT * inv)::FLOAT END FROM cells"""
    v = "CASE WHEN zone NOT IN (1, 2) THEN c1 END"
    q["where_predicates"] = _C + ' SELECT "row", col, ' + ", ".join(f"coalesce({v} {op} 40, {'true' if n == 'ne' else 'false'}) AS {n}" for n, op in zip(("gt", "ge", "lt", "le", "eq", "ne"), (">", ">=", "<", "<=", "=", "<>"))) + " FROM cells"

    q["neighbour_cells"] = _C + f', {_OFF} SELECT "row", col, ("row" + di)::INTEGER AS n_row, (col + dj)::INTEGER AS n_col, (di <> 0 AND dj <> 0) AS corner FROM cells, off WHERE "row" + di BETWEEN 0 AND 31 AND col + dj BETWEEN 0 AND 31'
    two = "surf AS (SELECT \"row\", col, 0 AS o, c1 AS c, inv AS i, false AS hard FROM cells UNION ALL SELECT \"row\", col, 1, (c1 * 0.25::FLOAT)::FLOAT, c2, zone = 3 FROM cells)"
    q["routing_edges"] = "WITH " + _cells(16) + f""", {two}, {_OFF} SELECT a."row", a.col, a.o AS "option", b."row" AS n_row, b.col AS n_col, b.o AS n_option,
      trunc(({_HALF} * (a.c + b.c) + b.i) * 10000::FLOAT)::BIGINT + CASE WHEN a.o = b.o THEN 0 ELSE 125000 END AS w
      FROM surf a, off, surf b WHERE b."row" = a."row" + di AND b.col = a.col + dj AND NOT a.hard AND NOT b.hard"""
    q["least_distances"] = f"{_CR}, {_plain_edges(8)}, {_distance('SELECT id, n, 0::BIGINT FROM (VALUES (0, 0), (1, 43)) s(id, n)')} SELECT id, n::BIGINT AS node, d FROM t"
    q["meeting_cost"] = f"{_CR}, {_plain_edges(8)}, {_distance('SELECT 0, 0, 0::BIGINT')} SELECT 0 AS id, d AS total FROM t WHERE n = 63"
    starts = "SELECT id, n, 0::BIGINT FROM (VALUES (0, 0), (1, 190), (2, 992), (3, 231)) s(id, n)"
    q["shortest_paths"] = f"""WITH RECURSIVE {_cells(32)}, {_plain_edges(32)}, {_distance(starts)}, ends AS (SELECT * FROM (VALUES (0, 0, 0, 0, 1023), (0, 0, 0, 0, 520), (0, 1, 5, 30, 1023), (0, 1, 5, 30, 520), (1, 2, 31, 0, 31), (2, 3, 7, 7, 231), (2, 3, 7, 7, 297)) e(route_id, id, start_row, start_col, n))
      SELECT route_id, start_row, start_col, min(d) AS cost_units FROM ends JOIN t USING (id, n) GROUP BY ALL"""
    q["shortest_paths_by_tiles"] = f"""WITH RECURSIVE {_cells(32)}, {_plain_edges(32)}, {_distance('SELECT id, n, 0::BIGINT FROM (VALUES (0, 0), (1, 992)) s(id, n)')}
      SELECT id AS route_id, d AS cost_units, d AS along FROM t WHERE (id = 0 AND n = 1023) OR (id = 1 AND n = 31)"""
    q["shortest_paths_both_ends"] = f"""WITH RECURSIVE {_cells(32)}, {_plain_edges(32)}, {_distance('SELECT id, n, 0::BIGINT FROM (VALUES (0, 0), (1, 992)) s(id, n)')}
      SELECT id AS route_id, (n // 32)::INTEGER AS end_row, (n % 32)::INTEGER AS end_col, d AS cost_units FROM t WHERE (id = 0 AND n = 1023) OR (id = 1 AND n = 31)"""
    q["option_paths"] = f"""WITH RECURSIVE {_cells(16)}, {two}, {_OFF}, edges AS (
      SELECT (a."row" * 16 + a.col) * 2 + a.o AS src, (b."row" * 16 + b.col) * 2 + b.o AS dst, trunc(({_HALF} * (a.c + b.c) + b.i) * 10000::FLOAT)::BIGINT + CASE WHEN a.o = b.o THEN 0 ELSE 125000 END AS w
      FROM surf a, off, surf b WHERE b."row" = a."row" + di AND b.col = a.col + dj AND NOT a.hard AND NOT b.hard), {_distance('SELECT id, n, 0::BIGINT FROM (VALUES (0, 0), (1, 31)) s(id, n)')}
      SELECT id AS route_id, d AS cost_units FROM t WHERE (id = 0 AND n = 511) OR (id = 1 AND n = 480)"""
    wall = "(CASE WHEN {a}.\"row\" = 8 THEN CASE WHEN {a}.col = 3 THEN 1 ELSE 2 END WHEN {a}.\"row\" = 4 THEN 1 ELSE 0 END)"
    # Importance 3 (wall 1) falls first, then importance 5.
    tries = [f"NOT ({wall.format(a='a')} >= 1 OR {wall.format(a='b')} >= 1)", f"NOT ({wall.format(a='a')} >= 2 OR {wall.format(a='b')} >= 2)", "true"]
    soft_starts = "SELECT id, n, 0::BIGINT FROM (VALUES (0, 0), (1, 85), (2, 144), (3, 17)) s(id, n)"
    parts = ", ".join(_plain_edges(16, "c2", t).removeprefix(_OFF + ", ").replace("edges AS", f"edges{k} AS") + ", " + _distance(soft_starts, f"edges{k}", f"t{k}") for k, t in enumerate(tries))
    q["soft_barrier_paths"] = f"""WITH RECURSIVE {_cells(16)}, {_OFF}, {parts}, ends AS (SELECT * FROM (VALUES (0, 102), (1, 255), (2, 255), (3, 41)) e(id, n)), found AS (
      {" UNION ALL ".join(f"SELECT id, d, {k} AS k FROM ends JOIN t{k} USING (id, n)" for k in range(3))})
      SELECT id AS route_id, arg_min(d, k) AS cost_units, min(k)::INTEGER AS dropped FROM found GROUP BY id"""

    q["route_travel_lengths"] = f"WITH {_MEASURED} SELECT route_id, step, round(len, 9) AS len FROM measured"
    q["route_option_costs"] = f"""{_C}, {_MEASURED} SELECT route_id, CASE "option" WHEN 0 THEN 'even' ELSE 'odd' END AS option_name,
      round(sum(CASE "option" WHEN 0 THEN c1 * c2 * len ELSE c2 * 2 * len END) + sum(CASE "option" WHEN 0 THEN inv ELSE 0 END), 4) AS cost, round(sum(len) * 90 / 1000, 6) AS length_km FROM measured JOIN cells USING ("row", col) GROUP BY 1, 2"""
    q["route_transition_costs"] = f"""WITH {_STEPS}, s AS (SELECT route_id, "option" AS o, lag("option") OVER (PARTITION BY route_id ORDER BY step) AS p FROM steps) SELECT route_id, sum(CASE WHEN p IS NOT NULL AND p <> o THEN 4.5 ELSE 0 END)::DOUBLE AS total_transition_costs FROM s GROUP BY 1"""
    q["route_layer_totals"] = f"""{_C}, {_MEASURED} SELECT route_id, round(sum(slope * len)::FLOAT::DOUBLE, 1) AS cost, round((sum(CASE WHEN slope > 0 THEN len ELSE 0 END) * 90 / 1000)::FLOAT::DOUBLE, 2) AS length_km, sum(slope)::FLOAT::DOUBLE AS inv_cost FROM measured JOIN cells USING ("row", col) GROUP BY 1"""
    q["route_layer_aggregates"] = f"""{_C}, {_STEPS} SELECT route_id, """ + ", ".join(f"round({f}::FLOAT::DOUBLE, 2) AS {n}" for n, f in (("mean", "avg(c1)"), ("min", "min(c1)"), ("max", "max(c1)"), ("sum", "sum(c1)"), ("std", "stddev_pop(c1)"))) + ' FROM steps JOIN cells USING ("row", col) GROUP BY 1'
    q["route_sampled_layers"] = f'{_C}, {_STEPS} SELECT s.*, c1, nlcd FROM steps s LEFT JOIN cells USING ("row", col)'
    q["route_report"] = f"""{_C}, {_MEASURED}, firsts AS (SELECT route_id, arg_min("row", step) AS start_row, arg_min(col, step) AS start_col, arg_min("option", step) AS start_option FROM steps GROUP BY 1),
      along AS (SELECT route_id, sum(CASE "option" WHEN 0 THEN c1 * c2 * len + inv ELSE 0 END) AS e, sum(CASE "option" WHEN 1 THEN c2 * 2 * len ELSE 0 END) AS o, sum(len) AS l, sum(CASE "option" WHEN 1 THEN len ELSE 0 END) AS ol, sum(CASE "option" WHEN 0 THEN inv ELSE 0 END) AS i FROM measured JOIN cells USING ("row", col) GROUP BY 1),
      turns AS (SELECT route_id, sum(CASE WHEN p <> o THEN 4.5 ELSE 0 END)::DOUBLE AS t FROM (SELECT route_id, "option" AS o, lag("option") OVER (PARTITION BY route_id ORDER BY step) AS p FROM steps) GROUP BY 1)
      SELECT route_id, start_row, start_col, start_option, round(e + o + t, 4) AS cost, round(e, 4) AS even_cost, round(o, 4) AS odd_cost, round(l * 90 / 1000, 6) AS length_km, round(ol * 90 / 1000, 6) AS odd_length_km, i::FLOAT::DOUBLE AS inv_even_cost, t AS total_transition_costs,
        2880.0::DOUBLE + (start_row + 0.5) * -90.0::DOUBLE AS poi_lat, (start_col + 0.5) * 90.0::DOUBLE AS poi_lon, CASE WHEN route_id % 2 = 0 THEN '["wall"]' END AS dropped_barrier_layers, c_mktsegment FROM firsts JOIN along USING (route_id) JOIN turns USING (route_id) LEFT JOIN customer ON c_custkey = route_id"""
    q["route_companion"] = f"""{_C}, {_MEASURED} SELECT route_id, CASE "option" WHEN 0 THEN 'even' ELSE 'odd' END AS routing_option, round(sum(len) * 90 / 1000, 6) AS length_km, (CASE "option" WHEN 0 THEN sum(inv) END)::FLOAT::DOUBLE AS inv_layer_cost FROM measured JOIN cells USING ("row", col) GROUP BY route_id, "option" """
    q["route_segments"] = f"""WITH {_STEPS}, a AS (SELECT *, coalesce(("option" <> lag("option") OVER w)::INTEGER, 0) AS new, lead("option") OVER w AS o2, lead("row") OVER w AS r2, lead(col) OVER w AS c2 FROM steps WINDOW w AS (PARTITION BY route_id ORDER BY step)),
      b AS (SELECT *, sum(new) OVER (PARTITION BY route_id ORDER BY step)::BIGINT AS segment FROM a)
      SELECT route_id, segment, "option", step::DOUBLE AS "at", "row"::DOUBLE AS "row", col::DOUBLE AS col FROM b
      UNION ALL SELECT route_id, segment, "option", step + 0.5::DOUBLE, ("row" + r2) / 2, (col + c2) / 2 FROM b WHERE o2 <> "option"
      UNION ALL SELECT route_id, segment + 1, o2, step + 0.5::DOUBLE, ("row" + r2) / 2, (col + c2) / 2 FROM b WHERE o2 <> "option" """
    q["route_files"] = f"""WITH g AS ({q["route_segments"]}), {_STEPS}, p AS (SELECT route_id, count(*) AS n, string_agg(((col + 0.5) * 90.0::DOUBLE)::VARCHAR || ' ' || (2880.0::DOUBLE + ("row" + 0.5) * -90.0::DOUBLE)::VARCHAR, ', ' ORDER BY step) AS t FROM steps GROUP BY 1),
      d AS (SELECT *, "row" - lag("row") OVER w AS ri, lead("row") OVER w - "row" AS ro, col - lag(col) OVER w AS ci, lead(col) OVER w - col AS co FROM g WINDOW w AS (PARTITION BY route_id, segment ORDER BY "at")),
      l AS (SELECT route_id, segment, "option", count(*) AS n, string_agg(((col + 0.5) * 90.0::DOUBLE)::VARCHAR || ' ' || (2880.0::DOUBLE + ("row" + 0.5) * -90.0::DOUBLE)::VARCHAR, ', ' ORDER BY "at") AS t FROM d WHERE NOT coalesce(ri * co = ci * ro AND ri * ro + ci * co > 0, false) GROUP BY 1, 2, 3)
      SELECT route_id, -1 AS "option", CASE WHEN n > 1 THEN 'LINESTRING (' ELSE 'POINT (' END || t || ')' AS wkt FROM p
      UNION ALL SELECT route_id, "option", CASE WHEN max(n) > 1 THEN 'MULTILINESTRING (' || string_agg('(' || t || ')', ', ' ORDER BY segment) || ')' ELSE 'POINT (' || any_value(t) || ')' END FROM l GROUP BY 1, 2"""
    unit = f"""{_STEPS}, u AS (SELECT route_id, step, (sum((("row" // 5) % 3 <> 1)::INTEGER) OVER w)::INTEGER AS "row", (sum((("row" // 5) % 3 <> 2)::INTEGER) OVER w)::INTEGER AS col, "option" FROM steps WINDOW w AS (PARTITION BY route_id ORDER BY step))"""
    q["route_turns"] = f"""WITH {unit} SELECT route_id, step, "row", col, "option" FROM u
      WINDOW w AS (PARTITION BY route_id ORDER BY step) QUALIFY NOT coalesce("row" - lag("row") OVER w = lead("row") OVER w - "row" AND col - lag(col) OVER w = lead(col) OVER w - col, false)"""
    q["route_wkt"] = f"""WITH {_STEPS}, p AS (SELECT route_id, count(*) AS n, string_agg(((col + 0.5) * 90.0::DOUBLE)::VARCHAR || ' ' || (2880.0::DOUBLE + ("row" + 0.5) * -90.0::DOUBLE)::VARCHAR, ', ' ORDER BY step) AS t FROM steps GROUP BY 1)
      SELECT route_id, CASE WHEN n > 1 THEN 'LINESTRING (' ELSE 'POINT (' END || t || ')' AS wkt FROM p"""

    places = """p AS (SELECT c_custkey, floor((c_custkey * 17 % 4000 - 500 - 2880) / -90.0)::INTEGER AS start_row, floor((c_custkey * 31 % 4000) / 90.0)::INTEGER AS start_col, floor((c_custkey * 11 % 3000 - 2880) / -90.0)::INTEGER AS end_row, floor((c_custkey * 13 % 3000) / 90.0)::INTEGER AS end_col FROM customer)"""
    q["route_points_on_grid"] = f"WITH {places} SELECT * FROM p WHERE start_row BETWEEN 0 AND 31 AND start_col BETWEEN 0 AND 31 AND end_row BETWEEN 0 AND 31 AND end_col BETWEEN 0 AND 31"
    q["route_supply_points"] = """WITH n AS (SELECT (max(c_custkey) // 52 + 10) // 10 * 6 AS points FROM customer), p AS (SELECT unnest(range(points)) AS k FROM n), c AS (SELECT c_custkey // 520 AS i, c_custkey % 52 // 10 AS j, count(*) AS customers FROM customer GROUP BY ALL)
      SELECT k::BIGINT AS sc_point_gid, (k // 6)::INTEGER AS sc_row_ind, (k % 6)::INTEGER AS sc_col_ind, (k // 6 * 10 + 5)::INTEGER AS start_row, (k % 6 * 10 + 5)::INTEGER AS start_col,
      90.0::DOUBLE + (k // 6 * 10 + 5.5) * -2.0::DOUBLE AS latitude, 10.0::DOUBLE + (k % 6 * 10 + 5.5) * 2.0::DOUBLE AS longitude, coalesce(customers, 0)::BIGINT AS customers FROM p LEFT JOIN c ON i = k // 6 AND j = k % 6"""
    q["route_valid_nodes"] = f"""{_C}, {_ROUTES} SELECT route_id, start_row AS "row", start_col AS col, (route_id % 2)::INTEGER AS "option" FROM routes JOIN cells ON "row" = start_row AND col = start_col WHERE CASE WHEN route_id % 2 = 0 THEN c1 * 0.5 * c2 + slope > 0 ELSE (c1 * 4 + c2) * c2 > 0 END"""
    q["route_remaining"] = f"WITH {_ROUTES}, done AS (SELECT * FROM routes WHERE route_id % 3 = 0 OR start_row < 4) SELECT route_id, start_row, start_col, voltage FROM routes r WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.start_row = r.start_row AND d.start_col = r.start_col AND d.voltage = r.voltage)"
    q["route_definitions"] = f"""WITH {_ROUTES}, n AS (SELECT count(DISTINCT (end_row, end_col)) > count(DISTINCT (start_row, start_col)) AS rev FROM routes), turned AS (SELECT CASE WHEN rev THEN end_row ELSE start_row END AS sr, CASE WHEN rev THEN end_col ELSE start_col END AS sc, CASE WHEN rev THEN start_row ELSE end_row END AS end_row, CASE WHEN rev THEN start_col ELSE end_col END AS end_col, rev FROM routes, n)
      SELECT (row_number() OVER (ORDER BY end_row, end_col) - 1)::INTEGER AS route_id, end_row, end_col, count(DISTINCT (sr, sc))::INTEGER AS n_starts, bool_or(rev) AS reversed FROM turned GROUP BY end_row, end_col"""
    q["route_combinations"] = f"WITH {_ROUTES} SELECT DISTINCT voltage AS voltage_a, voltage AS voltage_b, 'unknown' AS polarity_a, 'unknown' AS polarity_b FROM routes"
    q["route_voltage_product"] = "SELECT n_nationkey, v AS voltage, 'unknown' AS polarity FROM nation, (VALUES (138), (230), (500)) t(v)"
    q["route_subset"] = f"WITH {_ROUTES} SELECT route_id, start_row, start_col FROM routes QUALIFY (row_number() OVER (ORDER BY start_row, start_col, route_id) - 1) // (((SELECT count(*) FROM routes) + 3) // 4) = 1"
    q["route_numbers"] = f"WITH {_ROUTES} SELECT route_id, start_row, row_number() OVER (ORDER BY start_row, route_id) + 99 AS rid FROM routes"
    q["route_feature_pairs"] = "SELECT a.n_nationkey AS start_n_nationkey, a.n_regionkey AS start_n_regionkey, b.n_nationkey AS end_n_nationkey, b.n_regionkey AS end_n_regionkey FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey"
    q["nearest_region"] = f"WITH {_POINTS}, {_REGIONS}, d AS (SELECT id, rid, {_GAP} AS d FROM points, regions) SELECT id, rid, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, rid) = 1"
    q["within_region"] = f"WITH {_POINTS}, {_REGIONS} SELECT id, rid FROM points, regions WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1"
    q["within_radius"] = f"""WITH {_POINTS}, f AS (SELECT s_suppkey AS feature, (s_suppkey * 97 % 2880)::DOUBLE AS fx, (s_suppkey * 61 % 2880)::DOUBLE AS fy FROM supplier), d AS (SELECT id, feature, sqrt((x - fx) ** 2 + (y - fy) ** 2) AS d FROM points, f),
      r AS (SELECT id, CASE WHEN min(d) <= 60 THEN 60.0::DOUBLE ELSE 60.0::DOUBLE * (1 + 0.05::DOUBLE * ceil((min(d) / 60 - 1) / 0.05::DOUBLE - 1e-9)) END AS r FROM d GROUP BY id)
      SELECT id, feature, round(d, 6) AS distance, round(r, 6) AS radius FROM d JOIN r USING (id) WHERE d <= r + CASE WHEN r > 60 THEN 1e-9 ELSE 0 END"""
    q["route_resumed"] = f"""WITH {_ROUTES}, last AS (SELECT start_row, start_col, arg_max(price, route_id) AS price FROM routes WHERE route_id % 2 = 0 GROUP BY 1, 2) SELECT r.route_id, r.start_row, r.start_col, l.price FROM routes r LEFT JOIN last l USING (start_row, start_col)"""
    q["tidy_features"] = "SELECT s_suppkey AS trans_gid, 'c' || s_nationkey AS category FROM supplier WHERE s_nationkey % 3 <> 0"
    q["points_with_features"] = "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"

    q["length_multiplier_step"] = f"WITH {_LENGTHS} SELECT o_orderkey, cost * ({_STEPM}) AS cost, length_km, {_STEPM} AS length_mult, cost AS raw_cost FROM lens"
    linear = "CASE WHEN length_km <= 16.09344 THEN (1 - 1.5::DOUBLE) / (16.09344::DOUBLE - 2.414016::DOUBLE) * (length_km - 16.09344::DOUBLE) + 1 ELSE 1.0::DOUBLE END"
    q["length_multiplier_linear"] = f"WITH {_LENGTHS} SELECT o_orderkey, round(cost * ({linear}), 4) AS cost, length_km, round({linear}, 9) AS length_mult, cost AS raw_cost FROM lens"
    floor = "CASE WHEN length_km < 5.7 AND length_km > 0 THEN 5.7::DOUBLE / length_km ELSE 1 END"
    q["length_floor"] = f"WITH {_LENGTHS} SELECT o_orderkey, cost * ({floor}) AS cost, greatest(length_km, 5.7::DOUBLE) AS length_km FROM lens"
    q["finalized_routes"] = f"WITH {_LENGTHS} SELECT o_orderkey, round(cost * ({_STEPM}) * ({floor}) / 7, 3) AS cost, greatest(length_km, 5.7::DOUBLE) AS length_km, {_STEPM} AS length_mult, cost AS raw_cost FROM lens"
    q["routes_with_features"] = f"""WITH {_ROUTES}, own AS (SELECT (s_suppkey % 8)::INTEGER AS end_row, (s_suppkey % 3)::INTEGER AS end_col, max(s_suppkey) AS trans_gid FROM supplier GROUP BY 1, 2) SELECT trans_gid, end_row, end_col, route_id, price, s_nationkey AS price_trans FROM routes LEFT JOIN own USING (end_row, end_col) LEFT JOIN supplier ON s_suppkey = trans_gid"""
    q["route_end_features"] = f"""WITH {_ROUTES}, {_ALL}, own AS (SELECT a."row" AS end_row, a.col AS end_col, max(n_nationkey) AS trans_gid FROM allcells a JOIN nation ON n_nationkey * 37 + 11 > a.col * 90 AND n_nationkey * 37 + 11 < a.col * 90 + 90 AND 2300 < 2880 - a."row" * 90 AND n_nationkey * 20 + 2300 > 2790 - a."row" * 90 GROUP BY 1, 2)
      SELECT trans_gid, end_row, end_col, route_id, n_name AS line FROM routes LEFT JOIN own USING (end_row, end_col) LEFT JOIN nation ON n_nationkey = trans_gid"""
    q["dissolved_features"] = "SELECT s_nationkey AS gid, 'line ' || min(s_suppkey % 3) AS category, 'GEOMETRYCOLLECTION (' || string_agg('POINT (' || s_suppkey % 60 || ' 0)', ', ' ORDER BY 'POINT (' || s_suppkey % 60 || ' 0)') || ')' AS wkt FROM supplier GROUP BY 1"

    ok = "slope <> 12"
    q["zonal_basic"] = f"""{_C}, {_TOUCHED}, a AS (SELECT id, count(*) FILTER ({ok}) AS "count", min(slope) FILTER ({ok})::DOUBLE AS "min", max(slope) FILTER ({ok})::DOUBLE AS "max", round(avg(slope) FILTER ({ok}), 9) AS mean, sum(slope) FILTER ({ok}) AS "sum", round(stddev_pop(slope) FILTER ({ok}), 9) AS std, median(slope) FILTER ({ok})::DOUBLE AS median, count(DISTINCT slope) FILTER ({ok}) AS "unique", (max(slope) FILTER ({ok}) - min(slope) FILTER ({ok}))::DOUBLE AS "range", count(*) FILTER (slope = 12)::DOUBLE AS nodata FROM hits GROUP BY id)
      SELECT z.id, coalesce("count", 0) AS "count", "min", "max", mean, "sum", std, median, coalesce("unique", 0) AS "unique", "range", coalesce(nodata, 0) AS nodata FROM zones z LEFT JOIN a USING (id)"""
    q["zonal_centre_rule"] = f"""{_C}, {_ZONES}, a AS (SELECT z.id, count(*) AS n, sum(c2)::DOUBLE AS s FROM zones z JOIN cells c ON (c.col + 0.5) * 90 >= x0 AND (c.col + 0.5) * 90 < x0 + 700 AND 2880 - (c."row" + 0.5) * 90 >= y0 AND 2880 - (c."row" + 0.5) * 90 < y0 + 410 GROUP BY 1) SELECT z.id, coalesce(n, 0) AS c2_count, s AS c2_sum FROM zones z LEFT JOIN a USING (id)"""
    q["zonal_percentiles"] = f"{_C}, {_TOUCHED} SELECT z.id, round(quantile_cont(c1::DOUBLE, 0.105), 6) AS p10, round(quantile_cont(c1::DOUBLE, 0.9), 6) AS p90 FROM zones z LEFT JOIN hits USING (id) GROUP BY z.id"
    named = """n AS (SELECT id, slope::DOUBLE AS v, CASE slope WHEN 0 THEN 'flat' WHEN 5 THEN 'mid' WHEN 6 THEN 'mid' ELSE slope::DOUBLE::VARCHAR END AS k, count(*) AS n FROM hits GROUP BY 1, 2, 3), m AS (SELECT id, k, arg_max(n, v) AS n, min(v) AS v FROM n GROUP BY 1, 2)"""
    q["zonal_majority"] = f"{_C}, {_TOUCHED}, {named}, a AS (SELECT id, arg_min(k, (-n, v)) AS majority, arg_min(k, (n, v)) AS minority FROM m GROUP BY 1) SELECT z.id, majority, minority FROM zones z LEFT JOIN a USING (id)"
    q["zonal_pixel_count"] = f"{_C}, {_TOUCHED} SELECT z.id, " + ", ".join(f"nullif(count(*) FILTER (zone = {i}), 0) AS pixel_count_{n}" for i, n in enumerate(("zero", "one", "two", "three"))) + " FROM zones z LEFT JOIN hits USING (id) GROUP BY z.id"
    q["zonal_fractional"] = f"""{_C}, {_TOUCHED} SELECT z.id, round(sum(zone * part), 5) AS value_multiplied_by_fractional_area, round(sum(part) FILTER (zone = 1) / 8100, 5) AS fractional_pixel_count_one, round(sum(part) FILTER (zone = 2) / 8100, 5) AS fractional_pixel_count_two, round(sum(part) FILTER (zone = 3), 5) AS fractional_area_three FROM zones z LEFT JOIN hits USING (id) GROUP BY z.id"""
    q["zonal_zone_func"] = f'{_C}, {_TOUCHED} SELECT z.id, sum(c2 * 2 + 1)::DOUBLE AS "sum" FROM zones z LEFT JOIN hits USING (id) GROUP BY z.id'
    q["zonal_user_stats"] = f"""{_C}, {_TOUCHED} SELECT z.id, (max(c2) - min(c2))::DOUBLE AS spread, arg_max(c2, "row" * 32 + col)::DOUBLE AS "last" FROM zones z LEFT JOIN hits USING (id) GROUP BY z.id"""
    q["rasterized_boxes"] = f"""WITH {_ALL}, {_ZONES}, b AS (SELECT c."row", c.col, arg_max(id * 1.5::DOUBLE, id) AS v FROM zones z JOIN allcells c ON c.col * 90 < x0 + 700 AND c.col * 90 + 90 > x0 AND 2790 - c."row" * 90 < y0 + 410 AND 2880 - c."row" * 90 > y0 GROUP BY 1, 2) SELECT a."row", a.col, coalesce(v, 0)::DOUBLE AS value FROM allcells a LEFT JOIN b USING ("row", col)"""
    q["buffered_line_cells"] = f"""WITH {_ALL}, l AS (SELECT n_nationkey AS id, n_nationkey * 80.0::DOUBLE + 100 AS x, n_nationkey * 60.0::DOUBLE + 700 AS y1, CASE n_nationkey WHEN 3 THEN 250 WHEN 7 THEN 100 ELSE CASE WHEN n_nationkey < 10 THEN 150 WHEN n_nationkey < 20 THEN 210 END END AS h FROM nation)
      SELECT id, "row", col FROM l JOIN allcells ON abs((col + 0.5) * 90 - x) <= h AND 2880 - ("row" + 0.5) * 90 BETWEEN 300 AND y1"""

    near = q["buffered_line_cells"].removeprefix("WITH ").replace("SELECT id, \"row\", col FROM l", ", near AS (SELECT id, \"row\", col FROM l", 1) + ")"
    q["route_characterized"] = f"""{_C}, {near}, a AS (SELECT id, count(*) AS n, sum(c2)::DOUBLE AS s, max(c2)::DOUBLE AS m FROM near JOIN cells USING ("row", col) GROUP BY 1)
      SELECT n_nationkey AS id, coalesce(n, 0) AS "count", s AS "sum", m AS "max" FROM nation LEFT JOIN a ON a.id = n_nationkey"""
    q["substation_voltages"] = "SELECT l_orderkey AS gid, min(p_size * 3) AS min_volts, max(p_size * 3) AS max_volts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING max(p_size * 3) >= 69"
    q["substations_of_category"] = "SELECT l_orderkey + 1000000000 AS trans_gid, 'Substation' AS category, min(p_size * 3) AS min_volts, max(p_size * 3) AS max_volts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING max(p_size * 3) >= 69"
    q["substations_of_connections"] = "SELECT DISTINCT o_custkey % 40 AS poi_gid, (o_custkey % 40 * 1.5 + CASE WHEN o_custkey % 40 = 5 AND o_custkey % 3 = 0 THEN 0.25 ELSE 0 END)::DOUBLE AS poi_lat, 7.0::DOUBLE AS poi_lon FROM orders WHERE o_custkey % 40 <> 3"
    q["nodes_with_regions"] = f"WITH {_POINTS}, {_REGIONS}, d AS (SELECT id, x, y, rid, {_GAP} AS d FROM points, regions) SELECT id, x, y, rid FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, rid) = 1"
    q["region_centroids"] = f"WITH {_REGIONS} SELECT rid, round(((x0 + x1) / 2)::DOUBLE, 6) AS cx, round(((y0 + y1) / 2)::DOUBLE, 6) AS cy FROM regions"
    q["poi_lines"] = "SELECT s_name AS name, 'XX' AS state, s_nationkey::DOUBLE AS voltage, 'Substation' AS category, (s_suppkey + 50)::DOUBLE AS x1 FROM supplier UNION ALL SELECT 'fake', '', 0, 'TransLine', 100000"
    tie = ", ".join(f"({t}, {v}, {c}::DOUBLE)" for t, costs in TRANSFORMER_COSTS.items() for v, c in costs.items())
    q["transformer_costs"] = f"""WITH t(tie_voltage, v, c) AS (VALUES {tie}), p AS (SELECT p_partkey, p_size * 12 AS feature_voltage, ([69, 138, 500])[p_partkey % 3 + 1] AS tie_voltage FROM part)
      SELECT p_partkey, feature_voltage, tie_voltage, coalesce(arg_min(c, v) FILTER (v >= feature_voltage), arg_max(c, v)) AS transformer_cost FROM p JOIN t USING (tie_voltage) GROUP BY 1, 2, 3"""
    sub = ", ".join(f"({ISO_LOOKUP[n]}, {v}, {c}::DOUBLE, {NEW_SUBSTATION_COSTS[n][v]}::DOUBLE)" for n, costs in UPGRADE_SUBSTATION_COSTS.items() for v, c in costs.items())
    q["substation_costs"] = f"""WITH t(region, voltage, upgrade_cost, new_cost) AS (VALUES {sub}) SELECT region, voltage, n_nationkey, upgrade_cost, new_cost FROM (SELECT n_nationkey, n_regionkey + 1 AS region, CASE WHEN n_nationkey % 2 = 0 THEN 138 ELSE 500 END AS voltage FROM nation) JOIN t USING (region, voltage)"""
    return q
