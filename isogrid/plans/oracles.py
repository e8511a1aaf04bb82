"""DuckDB SQL for the registered queries of the grid operators, written independently of the DataFrame forms."""

from __future__ import annotations

from . import fixtures as fx

#: Added before rounding, on both sides.
OFF_HALVES = 3.7e-8

_PERIODS = ", ".join(f"('{n}', {a or 'NULL'}, {b or 'NULL'})" for n, a, b in fx.EVERY)
_R, _C = 6378137.0, "(2*pi()*6378137.0)"


def p_value(r2: str, n: str) -> str:
    """Two-sided p of a slope by the finite series of Student's distribution for whole degrees of freedom."""
    df, co, th = f"({n} - 2)", f"sqrt(greatest(0.0, 1 - {r2}))", f"asin(least(1.0, sqrt({r2})))"
    odd = f"list_sum(list_transform(range(0, ({df} - 3)//2 + 1), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda q: 2.0*q/(2*q + 1))), 1.0) * pow({co}, 2*k + 1)))"
    even = f"list_sum(list_transform(range(0, ({df} - 2)//2 + 1), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda q: (2.0*q - 1)/(2*q))), 1.0) * pow({co}, 2*k)))"
    return f"greatest(0.0, 1 - CASE WHEN {df} = 1 THEN 2*{th}/pi() WHEN {df} % 2 = 1 THEN 2/pi()*({th} + sqrt({r2})*{odd}) ELSE sqrt({r2})*{even} END)"


BASE = f"""WITH raw AS ({fx.RAW.format(lineitem='lineitem')}),
obs AS (SELECT i, j, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, ts, strftime(ts, '%Y-%m') AS label, year, month, (month % 12)//3 AS ess_idx, year + (month - 1)/12.0 AS x, CASE WHEN abs(sst - 273.15) <= 100 THEN sst - 273.15 END AS sst FROM raw),
cells AS (SELECT i, j, lat, lon, count(sst) = 0 AS is_land FROM obs GROUP BY ALL),
pts0 AS ({fx.POINTS.format(customer='customer')}),
pts AS (SELECT point_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM pts0),
per(period, y0, y1) AS (VALUES {_PERIODS}),
cal AS (SELECT *, 'monthly' AS season_type, month - 1 AS season_idx FROM obs UNION ALL SELECT *, 'ess', ess_idx FROM obs),
st0 AS (SELECT c.i, c.j, season_type, season_idx, period, CAST(count(sst) AS BIGINT) AS n, avg(sst) AS mean, var_pop(sst) AS variance, regr_slope(sst, x) AS sl, regr_r2(sst, x) AS rr
  FROM cal c JOIN per ON (y0 IS NULL OR year >= y0) AND (y1 IS NULL OR year <= y1) GROUP BY ALL),
st1 AS (SELECT *, CASE WHEN n >= 5 THEN CASE WHEN variance = 0 THEN 0.0 ELSE sl*10 END END AS trend, CASE WHEN n >= 5 THEN CASE WHEN variance = 0 THEN 0.0 ELSE rr END END AS r2 FROM st0),
st AS (SELECT *, CASE WHEN n >= 5 THEN {p_value('r2', 'n')} END AS p FROM st1),
sqy AS (SELECT i, j, period, 'monthly' AS season_type, month - 1 AS season_idx, year, sst AS y FROM obs JOIN per ON (y0 IS NULL OR year >= y0) AND (y1 IS NULL OR year <= y1)
  UNION ALL SELECT i, j, period, 'ess', ess_idx, year, avg(sst) FROM obs JOIN per ON (y0 IS NULL OR year >= y0) AND (y1 IS NULL OR year <= y1) GROUP BY ALL),
sq AS (SELECT a.*, pow(a.y - m.my, 2) AS sq FROM sqy a JOIN (SELECT i, j, period, season_type, season_idx, avg(y) AS my FROM sqy GROUP BY ALL) m USING (i, j, period, season_type, season_idx)),
v0 AS (SELECT i, j, season_type, season_idx, period, CAST(count(sq) AS BIGINT) AS n, var_pop(sq) AS variance, regr_slope(sq, CAST(year AS DOUBLE)) AS sl, regr_r2(sq, CAST(year AS DOUBLE)) AS rr FROM sq GROUP BY ALL),
v1 AS (SELECT *, CASE WHEN n >= 5 THEN CASE WHEN variance = 0 THEN 0.0 ELSE sl*10 END END AS trend, CASE WHEN n >= 5 THEN CASE WHEN variance = 0 THEN 0.0 ELSE rr END END AS r2 FROM v0),
vt AS (SELECT *, CASE WHEN n >= 5 THEN {p_value('r2', 'n')} END AS p FROM v1),
prod AS (SELECT 's1' AS section, season_type, season_idx, period, i, j, mean AS value FROM st UNION ALL SELECT 's2', season_type, season_idx, period, i, j, CASE WHEN p < 0.05 THEN trend END FROM st
  UNION ALL SELECT 's2_raw', season_type, season_idx, period, i, j, trend FROM st UNION ALL SELECT 's3', season_type, season_idx, period, i, j, r2 FROM st UNION ALL SELECT 's4', season_type, season_idx, period, i, j, variance FROM st
  UNION ALL SELECT 's5', season_type, season_idx, period, i, j, CASE WHEN p < 0.05 THEN trend END FROM vt UNION ALL SELECT 's5_raw', season_type, season_idx, period, i, j, trend FROM vt),
base AS (SELECT period, season_idx + 1 AS month, i, j, mean AS clim FROM st WHERE season_type = 'monthly' AND period IN ('p1', 'p2')),
anom AS (SELECT b.period, o.i, o.j, o.label, o.year, o.month, o.ess_idx, o.sst, b.clim, o.sst - b.clim AS value FROM obs o JOIN base b USING (i, j, month)),
near AS (SELECT p.point_id, p.lat, p.lon, (SELECT arg_min(i, abs(lat - p.lat)*1000 + i/1000.0) FROM (SELECT DISTINCT i, lat FROM obs) a) AS i, (SELECT arg_min(j, abs(lon - p.lon)*1000 + j/1000.0) FROM (SELECT DISTINCT j, lon FROM obs) a) AS j FROM pts p)
"""

_PCTS = (5, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 99, 100)
_TICKS = ", ".join(f"({p})" for p in _PCTS)
TICKS = f""", pc(pct) AS (VALUES {_TICKS}),
tv AS (SELECT section, quantile_cont(value, [{', '.join(str(p / 100) for p in _PCTS)}]) AS q FROM prod WHERE season_type = 'monthly' AND period = 'all' AND value IS NOT NULL GROUP BY section),
ticks AS (SELECT section, pct, q[list_position([{', '.join(map(str, _PCTS))}], pct)] AS value FROM tv, pc)"""
_SYM = "('s2', 's2_raw', 's5', 's5_raw')"
RANGES = f""", rg0 AS (SELECT section, season_idx, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b, quantile_cont(abs(value), 0.99) AS s FROM prod WHERE season_type = 'monthly' AND period = 'all' GROUP BY ALL),
rg1 AS (SELECT section, season_idx, coalesce(CASE WHEN section IN {_SYM} THEN -s ELSE a END, 0) AS vmin, coalesce(CASE WHEN section IN {_SYM} THEN s ELSE b END, 1) AS hi FROM rg0),
rg AS (SELECT section, season_idx, vmin, CASE WHEN vmin = hi THEN vmin + 1 ELSE hi END AS vmax FROM rg1)"""
FIELD = """, fld AS (SELECT c.i, c.j, c.lat, c.lon, c.is_land, p.value FROM cells c LEFT JOIN (SELECT * FROM prod WHERE section = '{section}' AND season_type = 'monthly' AND season_idx = 0 AND period = 'all') p USING (i, j))"""
_X0, _Y0, _Y1 = f"(radians(117.0)*{_R})", f"(ln(tan(pi()/4 + radians(26.0)/2))*{_R})", f"(ln(tan(pi()/4 + radians(72.0)/2))*{_R})"
_X1 = f"({_X0} + 129.0/360.0*{_C})"
PIXELS = f""", px0 AS (SELECT CAST(t AS BIGINT) AS target_id, CAST(t % {fx.WIDTH} AS INT) AS px, CAST(t // {fx.WIDTH} AS INT) AS py FROM range({fx.WIDTH * fx.HEIGHT}) r(t)),
px AS (SELECT *, {_X0} + ({_X1} - {_X0})*(px/{fx.WIDTH - 1}.0) AS x, {_Y1} - ({_Y1} - {_Y0})*(py/{fx.HEIGHT - 1}.0) AS y FROM px0),
tg AS (SELECT *, degrees(atan(sinh(y/{_R}))) AS lat, (degrees(x/{_R}) % 360 + 360) % 360 AS lon FROM px)"""
_CORNERS = "(VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(a, b)"
BILINEAR = f""", t1 AS (SELECT *, (lat - 72.0)/-8.0 AS fi, (lon - 117.0)/16.0 AS fj FROM {{targets}}),
t2 AS (SELECT *, CAST(least(floor(fi), 4) AS INT) AS i0, CAST(least(floor(fj), 6) AS INT) AS j0 FROM t1 WHERE fi BETWEEN 0 AND 5 AND fj BETWEEN 0 AND 7),
t3 AS (SELECT target_id, CASE WHEN count(f.value) = 4 THEN sum(abs(1 - a - (fi - i0))*abs(1 - b - (fj - j0))*f.value) END AS value FROM t2 CROSS JOIN {_CORNERS} LEFT JOIN fld f ON f.i = i0 + a AND f.j = j0 + b GROUP BY target_id),
bil AS (SELECT t1.target_id, t3.value FROM t1 LEFT JOIN t3 USING (target_id))"""
_SQUARES = f""", s0 AS ({fx.SQUARES.format(customer='customer')}), sqr AS (SELECT feature_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(r AS DOUBLE) AS r, hole, multi FROM s0),
rings AS (SELECT feature_id, 0 AS poly_id, 0 AS ring_id, x, y, r FROM sqr UNION ALL SELECT feature_id, 0, 1, x, y, r/2 FROM sqr WHERE hole UNION ALL SELECT feature_id, 1, 0, x, y, r/4 FROM sqr WHERE multi),
verts AS (SELECT feature_id, poly_id, ring_id, ring_id > 0 AS is_hole, seq, x + a*r AS lon, y + b*r AS lat FROM rings CROSS JOIN (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1), (4, -1, -1)) c(seq, a, b)),
bb AS (SELECT feature_id, poly_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM verts GROUP BY ALL),
halves AS (SELECT feature_id, poly_id, half FROM bb JOIN (VALUES ('west', 116.5, 25.5, 180.5, 72.5), ('east', -180.5, 25.5, -114.5, 72.5)) h(half, w, s, e, n) ON x0 <= e AND x1 >= w AND y0 <= n AND y1 >= s),
pv AS (SELECT half, v.*, (radians(lon)*{_R} + CASE WHEN half = 'east' THEN {_C} ELSE 0 END - {_X0})/({_X1} - {_X0})*{{width}} AS x, ({_Y1} - ln(tan(pi()/4 + radians(lat)/2))*{_R})/({_Y1} - {_Y0})*{{height}} AS y FROM verts v JOIN halves USING (feature_id, poly_id)),
box AS (SELECT half, feature_id, poly_id, ring_id, is_hole, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_ FROM pv GROUP BY ALL),
inr AS (SELECT half, feature_id, poly_id, is_hole, ax, bx, unnest(range(greatest(0, CAST(ceil(ay - 0.5) AS BIGINT)), least({{height}}, CAST(ceil(by_ - 0.5) AS BIGINT)))) AS py FROM box),
inb AS (SELECT half, feature_id, poly_id, is_hole, CAST(py AS INT) AS py, CAST(unnest(range(greatest(0, CAST(ceil(ax - 0.5) AS BIGINT)), least({{width}}, CAST(ceil(bx - 0.5) AS BIGINT)))) AS INT) AS px FROM inr),
land AS (SELECT DISTINCT px, py FROM inb a WHERE NOT is_hole AND NOT EXISTS (SELECT 1 FROM inb b WHERE b.is_hole AND b.half = a.half AND b.feature_id = a.feature_id AND b.poly_id = a.poly_id AND b.px = a.px AND b.py = a.py))"""


def squares(width: int, height: int) -> str:
    """The polygons, and their land in a picture of that size; squares with level sides hold ranges of rows and columns."""
    return _SQUARES.format(width=width, height=height)


SQUARES = squares(fx.WIDTH, fx.HEIGHT)


#: The same tables over the grid that grows with the given ones.
FINE_BASE = BASE.replace(fx.RAW.format(lineitem="lineitem"), fx.FINE.format(orders="orders", each="unnest(range(84))", width=fx.FINE_WIDTH_SQL.format(orders="orders")))
FINE_WIDTH = "(SELECT ceil(sqrt(max(o_orderkey) + 1)) FROM orders)"


def sql(body: str, *doubles: str, more: str = "", base: str = BASE) -> str:
    """A query over the shared tables with its double columns rounded to 6 (and no negative zero)."""
    body = f"SELECT * FROM ({body})" if not doubles else f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE) + {OFF_HALVES:.10f}, 6) + 0.0 AS {c}' for c in doubles)}) FROM ({body})"
    return f"{base}{more} {body}"
