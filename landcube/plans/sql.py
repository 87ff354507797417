"""DuckDB SQL for the registered queries, with the same column names and rows."""

from __future__ import annotations

CUBE = """
g AS (SELECT CAST(ceil(sqrt(max(p_partkey) + 1)) AS BIGINT) AS w, max(p_partkey) + 1 AS npx FROM part),
s AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS yr, l_partkey AS px, count(*) AS n,
  CAST(sum(CAST(floor(l_quantity + 0.5) AS BIGINT)) AS BIGINT) AS q, CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS e,
  CAST(sum(CAST(floor(l_tax * 100 + 0.5) AS BIGINT)) AS BIGINT) AS t, CAST(sum(CAST(floor(l_discount * 100 + 0.5) AS BIGINT)) AS BIGINT) AS d,
  bool_or(l_linenumber IN (2, 4, 5, 6, 7)) AS valid, CAST(sum(l_suppkey) AS BIGINT) AS k FROM lineitem GROUP BY 1, 2),
cube0 AS (SELECT yr, px, px // w AS r, px % w AS c, n, q / n AS nir, e / (200000 * n) AS red, 6 * t / n AS green, 5 * d / n AS swir, valid,
  CAST(k % 60 AS INTEGER) AS ade, CAST(k % 6 AS INTEGER) AS cls FROM s, g),
cube AS (SELECT *, CASE WHEN nir + red > 0.001 THEN (nir - red) / (nir + red) ELSE 0 END AS ndvi,
  CASE WHEN swir + nir > 0.001 THEN (swir - nir) / (swir + nir) ELSE 0 END AS ndbi,
  CASE WHEN green + nir > 0.001 THEN (green - nir) / (green + nir) ELSE 0 END AS ndwi FROM cube0)"""

_SIDE = ", ".join(
    f"coalesce(median({x}) FILTER (WHERE valid AND yr IN ({y})), median({x}) FILTER (WHERE valid), 0) AS {x}_{side}"
    for side, y in (("before", "1996, 1997"), ("after", "2000, 2001"))
    for x in ("ndvi", "ndbi", "ndwi")
)
COMP = f"""{CUBE},
comp AS (SELECT px, {_SIDE}, coalesce(bool_or(valid AND yr IN (1996, 1997)), false) AS valid_before,
  coalesce(bool_or(valid AND yr IN (2000, 2001)), false) AS valid_after,
  CASE WHEN count(*) FILTER (WHERE valid) >= 2 THEN regr_slope(ndvi, CAST(yr AS DOUBLE)) FILTER (WHERE valid) ELSE 0 END AS ndvi_slope,
  CASE WHEN count(*) FILTER (WHERE valid) >= 2 THEN regr_slope(ndbi, CAST(yr AS DOUBLE)) FILTER (WHERE valid) ELSE 0 END AS ndbi_slope
  FROM cube GROUP BY px),
pri AS (SELECT *, ndvi_after - ndvi_before AS d_ndvi, ndbi_after - ndbi_before AS d_ndbi,
  1 / (1 + exp(-(10 * (0.5 * abs(ndvi_after - ndvi_before) + 0.35 * abs(ndbi_after - ndbi_before) + 0.15 * abs(ndwi_after - ndwi_before) - 0.1)))) AS period_prior,
  ndvi_slope < -0.02 AS falling, ndbi_slope > 0.015 AS rising FROM comp),
trd AS (SELECT *, CASE WHEN rising THEN 2 WHEN falling THEN 1 ELSE 0 END AS trend FROM pri)"""
FILL = f"""{CUBE},
med AS (SELECT px, {", ".join(f"median({x}) FILTER (WHERE valid) AS m_{x}" for x in ("ndvi", "ndbi", "ndwi"))} FROM cube GROUP BY px),
fill AS (SELECT yr, px, {", ".join(f"CASE WHEN valid THEN {x} ELSE m_{x} END AS {x}_filled" for x in ("ndvi", "ndbi", "ndwi"))} FROM cube JOIN med USING (px)),
tp AS (SELECT px, 1 / (1 + exp(-(14 * (({" + ".join(f"abs(arg_max(coalesce({x}_filled, 0), yr) - arg_min(coalesce({x}_filled, 0), yr))" for x in ("ndvi", "ndbi", "ndwi"))}) / 3 - 0.08)))) AS prior FROM fill GROUP BY px)"""
# what the rules say of a pixel: the model's 0.5 and both priors fused, then two tiers by the fused score
TIERS = f"""{COMP}{FILL.removeprefix(CUBE)},
fus AS (SELECT trd.*, greatest(0, least(1, 0.55::DOUBLE * greatest(0, least(1, 0.2::DOUBLE * 0.5::DOUBLE + 0.8::DOUBLE * prior))
  + 0.45::DOUBLE * period_prior)) AS prob FROM trd JOIN tp USING (px)),
tiers AS (SELECT *, CASE WHEN NOT (valid_before AND valid_after) THEN 0
    WHEN prob > 0.7 AND ndbi_after > 0.15 AND d_ndbi > 0.05 AND ndvi_after < 0.25 AND ndwi_after < 0.25 THEN 1
    WHEN prob > 0.55 AND ndbi_after > 0.1 AND d_ndbi > 0.12 AND d_ndvi < -0.1 AND ndvi_after < 0.25 AND ndwi_after < 0.25 THEN 2 ELSE 0 END AS tier FROM fus)"""
_STREAM = "CASE ade WHEN 3 THEN 1 WHEN 9 THEN 2 WHEN 13 THEN 2 WHEN 11 THEN 3 WHEN 17 THEN 5 ELSE 0 END"
PAIRS = f"""{CUBE},
two AS (SELECT px, r, c, max(cls) FILTER (WHERE yr = 1996) AS b, max(cls) FILTER (WHERE yr = 2001) AS a,
  max({_STREAM}) FILTER (WHERE yr = 1996) AS sb, max({_STREAM}) FILTER (WHERE yr = 2001) AS sa FROM cube GROUP BY 1, 2, 3),
pairs AS (SELECT *, (r // 16) * 1000 + c // 16 AS tile FROM two WHERE b IS NOT NULL AND a IS NOT NULL),
rule(change_type, name, color, f, t) AS (VALUES ('deforestation', 'Deforestation', '255,0,0', [2], [1, 4, 5]),
  ('construction', 'New Construction', '0,0,255', [2, 4], [1]), ('new_roads', 'New Roads', '255,255,0', [2, 4], [5]),
  ('water_loss', 'Water Bodies Drying', '128,0,128', [3], [1, 2, 4]), ('vegetation_gain', 'Vegetation Increase', '0,255,0', [4], [2])),
hit AS (SELECT px, tile, change_type FROM pairs JOIN rule ON list_contains(f, b) AND list_contains(t, a)),
stats AS (SELECT change_type, count(*) AS pixels, round(count(*) * 100.0::DOUBLE * 0.0001::DOUBLE, 6) AS area_hectares FROM hit GROUP BY 1)"""
MASK = f"""{CUBE}, grid AS (SELECT w, npx, (npx + w - 1) // w AS h FROM g), mask AS (SELECT r, c FROM cube WHERE yr = 2001 AND cls = 1)"""


def _dilate(source: str, name: str, rows: str, columns: str) -> str:
    return f"{name} AS (SELECT DISTINCT r - i AS r, c - j AS c FROM {source}, (SELECT unnest(range({rows})) AS i), (SELECT unnest(range({columns})) AS j), grid WHERE r - i >= 0 AND c - j >= 0 AND c - j < w AND (r - i) * w + c - j < npx)"


def _erode(source: str, name: str, rows: str, columns: str) -> str:
    return f"""{name} AS (SELECT y AS r, x AS c FROM (SELECT p.y, p.x, count(*) AS n, count(m.r) AS k FROM
  (SELECT px // w AS y, px % w AS x FROM (SELECT unnest(range(npx)) AS px, w FROM grid)) p, (SELECT unnest(range({rows})) AS i), (SELECT unnest(range({columns})) AS j), grid
  LEFT JOIN {source} m ON m.r = y + i AND m.c = x + j WHERE y + i >= 0 AND x + j >= 0 AND x + j < w AND (y + i) * w + x + j < npx GROUP BY 1, 2) WHERE n = k)"""


def _q(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n}" for n in names)


_GROUND = "(13.173 - 12.734) * 111000.0 * (77.88 - 77.37) * 111000.0 * cos(radians((13.173 + 12.734) / 2))".replace("13.173", "13.173::DOUBLE").replace("77.88", "77.88::DOUBLE")
_SUMMARY = f"""SELECT count(*) AS total_pixels, count(*) FILTER (WHERE class = 3) AS construction_pixels, count(*) FILTER (WHERE falling) AS deforestation_trend_pixels,
  count(*) FILTER (WHERE rising) AS urban_trend_pixels, count(*) FILTER (WHERE class <> 0 OR trend <> 0) AS changed_pixels FROM cls"""
_WHOLE = f"""SELECT *, round(changed_pixels / greatest(1, total_pixels) * 100, 2) AS change_percent,
  least(round(changed_pixels * ({_GROUND} / greatest(1, total_pixels)) / 10000, 2), round({_GROUND} / 10000, 2)) AS change_hectares, round({_GROUND} / 10000, 2) AS total_hectares FROM ({_SUMMARY})"""
_U8 = "CAST(greatest(0, least(255, floor((round(ndvi, 9) + 1) * 127.5 + 0.5))) AS INTEGER)"


def _colour(x: str, gain: int, offset: int) -> str:
    v = f"floor(greatest(0, least(255, (round({x}, 9) + 1) / 2 * {gain} + {offset})))"
    return f"CAST(CASE WHEN valid THEN {v} ELSE floor({v} * 0.3::DOUBLE) END AS INTEGER)"


def _boxes(key: str, source: str) -> str:
    k = f"CAST({key} % 50 AS DOUBLE)"
    return f"box AS (SELECT {key}, {k} * 5 - 60 AS west, {k} * 3 - 40 AS south, {k} * 5 - 60 + ({key} % 4) * 0.5::DOUBLE AS east, {k} * 3 - 40 + 1.25::DOUBLE AS north FROM {source})"


_BOX, _NATIONS = _boxes("c_custkey", "customer"), _boxes("n_nationkey", "nation")
_P = "prod AS (SELECT o_orderkey AS id, o_custkey % 100 AS aoi, CAST(year(o_orderdate) AS INTEGER) AS yr, o_orderdate AS start, CASE WHEN o_orderstatus <> 'P' THEN (CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) % 10001) / 100 END AS cloud FROM orders)"
_CACHE = """ev AS (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS key FROM events),
entry AS (SELECT key, event_id AS id, ts AS created FROM ev WHERE event_type = 'purchase'), req AS (SELECT event_id, key FROM ev WHERE event_type = 'view')"""


def _live(days: int) -> str:
    return f"live AS (SELECT * FROM entry WHERE created + INTERVAL {days} DAY > TIMESTAMP '2024-01-25' QUALIFY row_number() OVER (PARTITION BY key ORDER BY created DESC, id DESC) = 1)"


def _blur(source: str, name: str) -> str:
    """v of every pixel that the 5 x 5 binomial kernel, mirrored at the edges, gives more than 0."""
    return f"""{name} AS (SELECT y AS r, x AS c, sum(ki * kj) / 256 AS v FROM (SELECT y, x, h, w, i, j, [1, 4, 6, 4, 1][i + 3] AS ki, [1, 4, 6, 4, 1][j + 3] AS kj,
  CASE WHEN y + i < 0 THEN -(y + i) WHEN y + i >= h THEN 2 * (h - 1) - (y + i) ELSE y + i END AS sr,
  CASE WHEN x + j < 0 THEN -(x + j) WHEN x + j >= w THEN 2 * (w - 1) - (x + j) ELSE x + j END AS sc
  FROM (SELECT unnest(range(h * w)) // w AS y, unnest(range(h * w)) % w AS x, h, w FROM grid), (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)) k
JOIN {source} s ON s.r = sr AND s.c = sc GROUP BY 1, 2)"""


def _regions(source: str, name: str, steps: int = 8) -> str:
    """(r, c, region) of connected pixels: a region's smallest pixel reaches all of it. Only pixels without a smaller neighbour begin."""
    near = "abs(a.r - b.r) + abs(a.c - b.c) = 1" if steps == 4 else "true"
    return f"""{name}_p AS (SELECT r, c, r * w + c AS px FROM {source}, g),
{name}_n AS (SELECT a.px, b.px AS other FROM (SELECT r, c, px, r + i AS rr, c + j AS cc FROM {name}_p, (SELECT unnest(range(-1, 2)) AS i), (SELECT unnest(range(-1, 2)) AS j)) a
  JOIN {name}_p b ON b.r = rr AND b.c = cc WHERE a.px <> b.px AND {near}),
{name}_s(px, root) AS (SELECT px, px FROM {name}_p WHERE px NOT IN (SELECT px FROM {name}_n WHERE other < px)
  UNION SELECT n.other, s.root FROM {name}_s s JOIN {name}_n n USING (px) WHERE n.other > s.root),
{name} AS (SELECT r, c, min(root) AS region FROM {name}_p JOIN {name}_s USING (px) GROUP BY 1, 2)"""


def _closed(source: str, name: str, reach: str) -> str:
    return _dilate(source, f"{name}_d", reach, reach) + ", " + _erode(f"{name}_d", name, reach, reach)


_GRID = "grid AS (SELECT w, npx, (npx + w - 1) // w AS h FROM g)"


def _soft(source: str, name: str) -> str:
    """Closed 5 x 5, blurred, cut at 0.4."""
    return f"{_closed(source, name + '_c', '-2, 3')}, {_blur(name + '_c', name + '_b')}, {name} AS (SELECT {name}_b.r, {name}_b.c FROM {name}_b, g WHERE v > 0.4::DOUBLE AND r * w + c < npx)"


# the pixel classes after smoothing: regions of more than 50 pixels
CLASSES = f"""{TIERS}, {_GRID}, cand AS (SELECT px // w AS r, px % w AS c FROM tiers, g WHERE tier > 0), {_soft("cand", "soft")}, {_regions("soft", "reg")},
big AS (SELECT r * w + c AS px FROM reg, g WHERE region IN (SELECT region FROM reg GROUP BY 1 HAVING count(*) > 50)),
cls AS (SELECT tiers.*, CASE WHEN big.px IS NULL THEN 0 ELSE 3 END AS class FROM tiers LEFT JOIN big USING (px))"""
# a closed mask with the holes filled: background that is not 4-connected to pixel (0, 0)
_HOLES = """bg AS (SELECT y AS r, x AS c FROM (SELECT unnest(range(h * w)) // w AS y, unnest(range(h * w)) % w AS x FROM grid) WHERE (y, x) NOT IN (SELECT (r, c) FROM {0})), """
_THIN = ", ".join([
    _erode("mask", "e1", "0, 1", "-1, 1"), _dilate("e1", "o1", "0, 1", "-1, 1"), _erode("mask", "e2", "-1, 1", "0, 1"), _dilate("e2", "o2", "-1, 1", "0, 1"),
    "al AS (SELECT r, c FROM o1 UNION SELECT r, c FROM o2)", _dilate("al", "d3", "-1, 2", "-1, 2"), _erode("d3", "e3", "-1, 2", "-1, 2"),
])
_SRULE = {"deforestation": "sb = 2 AND sa <> 2", "construction": "sb <> 1 AND sa = 1", "water_loss": "sb = 3 AND sa <> 3", "urbanization": "sb = 0 AND sa IN (1, 4)"}
_SSUM = ", ".join(f"round(count(*) FILTER (WHERE {v}) * 100.0::DOUBLE / 10000, 6) AS {k}_hectares" for k, v in _SRULE.items())
_TYPES = (("deforestation", "b = 2 AND a IN (1, 4, 5)", "255,0,0"), ("construction", "b IN (2, 4) AND a = 1", "0,0,255"), ("new_roads", "b IN (2, 4) AND a = 5", "255,255,0"), ("water_loss", "b = 3 AND a IN (1, 2, 4)", "128,0,128"), ("vegetation_gain", "b = 4 AND a = 2", "0,255,0"))

# a fixed linear model over years and indices, of which missing years are zeros
_MODEL = " + ".join(f"0.25::DOUBLE * (yr - 1998) * {w}::DOUBLE * {x}" for x, w in (("ndvi", -0.5), ("ndbi", 0.35), ("ndwi", 0.15)))

# a request for 1998 and 1999, of which the years 1996 to 2000 are read
_REQUEST = CLASSES.replace("FROM lineitem GROUP BY 1, 2)", "FROM lineitem WHERE year(l_shipdate) BETWEEN 1996 AND 2000 GROUP BY 1, 2)").replace("yr IN (1996, 1997)", "yr IN (1997, 1998)").replace("yr IN (2000, 2001)", "yr IN (1999, 2000)").replace("count(*) > 50", "count(*) > 20")
_AFFINE = """t AS (SELECT y, x, (y + 0.5::DOUBLE) * (2::DOUBLE / 3) + 0.25::DOUBLE - 0.5::DOUBLE AS fy, (x + 0.5::DOUBLE) * (2::DOUBLE / 3) - 1::DOUBLE / 3 - 0.5::DOUBLE AS fx, h, w
  FROM (SELECT unnest(range(h * 3 // 2)) AS y, h, w FROM grid), (SELECT unnest(range(w * 3 // 2)) AS x FROM grid)),
p AS (SELECT y, x, CAST(greatest(0, least(h - 1, floor(fy) + i)) AS BIGINT) AS r, CAST(greatest(0, least(w - 1, floor(fx) + j)) AS BIGINT) AS c,
  CASE WHEN i = 0 THEN 1 - (fy - floor(fy)) ELSE fy - floor(fy) END * CASE WHEN j = 0 THEN 1 - (fx - floor(fx)) ELSE fx - floor(fx) END AS wt FROM t, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j))"""

SQL: dict[str, str] = {
    "region_outlines": _q(f"""{MASK}, {_regions("mask", "lab")}, open AS (SELECT a.r, a.c, 4 - count(b.r) AS sides FROM lab a LEFT JOIN lab b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 AND b.r BETWEEN a.r - 1 AND a.r + 1 GROUP BY 1, 2)""",
        """SELECT region, CAST(count(*) AS DOUBLE) AS area, CAST(sum(sides) AS BIGINT) AS perimeter, min(c) AS west, min(r) AS north, max(c) + 1 AS east, max(r) + 1 AS south
  FROM lab JOIN open USING (r, c) GROUP BY 1 HAVING count(*) > 3""", True),
    "pixel_mosaic": _q(f"""{_P}, s AS (SELECT aoi, yr, l_partkey % 256 AS px, l_linenumber IN (2, 4, 5, 6, 7) AS valid, coalesce(cloud, 100) AS cl, start, id, l_linenumber AS line FROM lineitem JOIN prod ON id = l_orderkey WHERE coalesce(cloud, 100) <= 95)""",
        """SELECT aoi, yr, px, valid, CASE WHEN valid THEN id ELSE -1 END AS id, CASE WHEN valid THEN line ELSE -1 END AS line FROM s
  QUALIFY row_number() OVER (PARTITION BY aoi, yr, px ORDER BY valid DESC, cl, start DESC, id, line) = 1"""),
    "request_summary": _q(_REQUEST, _WHOLE, True),
    "comparable_transitions": _q(f"""{PAIRS}, shape AS (SELECT r // 3 AS tr, c // 3 AS tc, yr, max(r) - min(r) AS h, max(c) - min(c) AS v FROM cube WHERE yr IN (1996, 2001) GROUP BY 1, 2, 3),
alike AS (SELECT a.tr, a.tc FROM shape a JOIN shape b USING (tr, tc, h, v) WHERE a.yr = 1996 AND b.yr = 2001)""",
        "SELECT px, change_type FROM pairs JOIN rule ON list_contains(f, b) AND list_contains(t, a) JOIN alike ON tr = r // 3 AND tc = c // 3"),
    "resample_affine": _q(f"{MASK}, {_AFFINE}", """SELECT y AS r, x AS c, round(sum(wt * nir) / sum(wt), 6) + 0.0::DOUBLE AS nir FROM p JOIN (SELECT r, c, nir FROM cube WHERE yr = 2001) m USING (r, c) GROUP BY 1, 2 HAVING sum(wt) > 1e-9"""),
    "stored_years": _q(CUBE, """SELECT CAST(yr AS INTEGER) AS year, count(*) AS pixels FROM cube WHERE yr IN (1996, 2000) GROUP BY 1
UNION ALL SELECT DISTINCT CAST(yr AS INTEGER), CAST(-1 AS BIGINT) FROM cube WHERE yr NOT IN (1996, 1997, 1999, 2000)"""),
    "stored_tiles": _q(CUBE, """SELECT CAST(yr AS INTEGER) AS scene, CAST(r // 16 AS INTEGER) AS tile_row, CAST(c // 16 AS INTEGER) AS tile_col, max(r) - min(r) + 1 AS rows, max(c) - min(c) + 1 AS columns,
  CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c FROM cube WHERE yr IN (1996, 2001) GROUP BY 1, 2, 3"""),
    "stored_results": _q(PAIRS, "SELECT change_type, pixels, area_hectares, CAST(s AS BIGINT) AS sum_px FROM stats JOIN (SELECT change_type, sum(px) AS s FROM hit GROUP BY 1) USING (change_type)"),
    "cache_kept": _q(_CACHE, "SELECT id, key FROM entry WHERE created + INTERVAL 3 DAY > TIMESTAMP '2024-01-25'"),
    "cache_stream": _q(f"""{_CACHE}, vw AS (SELECT event_id, ts, key FROM ev WHERE event_type = 'view'),
newest AS (SELECT key, created, max(id) AS id FROM entry GROUP BY 1, 2)""", """SELECT CASE WHEN entry IS NULL THEN 'miss' ELSE 'hit' END AS kind, key, id, "at", coalesce(entry, -1) AS entry FROM
  (SELECT v.key, v.event_id AS id, strftime(v.ts, '%Y-%m-%d %H:%M:%S.%f') AS "at", CASE WHEN n.created + INTERVAL 3 DAY > v.ts THEN n.id END AS entry FROM vw v ASOF LEFT JOIN newest n ON n.key = v.key AND n.created <= v.ts)
UNION ALL SELECT 'expired', key, id, strftime(created + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S.%f'), id FROM entry WHERE created + INTERVAL 3 DAY <= TIMESTAMP '2024-02-01'"""),
    "model_scores": _q(f"""{TIERS}, mp AS (SELECT px, 1 / (1 + exp(-(sum({_MODEL}) - 0.1::DOUBLE))) AS model_prob FROM cube GROUP BY px)""",
        """SELECT px, round(model_prob, 6) + 0.0::DOUBLE AS model_prob, round(greatest(0, least(1, 0.55::DOUBLE * greatest(0, least(1, 0.2::DOUBLE * model_prob + 0.8::DOUBLE * prior))
  + 0.45::DOUBLE * period_prior)), 6) + 0.0::DOUBLE AS prob FROM trd JOIN tp USING (px) JOIN mp USING (px)"""),
    "block_cells": _q(f"""{CUBE}, place AS (SELECT px // w AS r, px % w AS c, px // w // 32 AS tr, px % w // 32 AS tc FROM (SELECT unnest(range(npx)) AS px, w FROM g)),
two AS (SELECT * FROM cube WHERE yr IN (1996, 2001)), made AS (SELECT DISTINCT r // 32 AS tr, c // 32 AS tc FROM two)""",
        """SELECT CAST(y.yr AS INTEGER) AS yr, place.r, place.c, round(coalesce(nir, 0), 6) AS nir, round(coalesce(swir, 0), 6) AS swir
  FROM place JOIN made USING (tr, tc) CROSS JOIN (VALUES (1996), (2001)) y(yr) LEFT JOIN two ON two.yr = y.yr AND two.r = place.r AND two.c = place.c"""),
    "spectral_indices": _q(CUBE, f"SELECT yr, px, {_r('ndvi', 'ndbi', 'ndwi')}, valid FROM cube"),
    "index_quantize_roundtrip": _q(CUBE, f"SELECT yr, px, {_U8} AS u8, round({_U8} / 127.5::DOUBLE - 1, 6) AS ndvi_back FROM cube"),
    "cloud_percent_by_year": _q(CUBE, "SELECT yr, round(100 * (1 - count(*) FILTER (WHERE valid) / count(*)), 4) AS cloud_percent FROM cube GROUP BY yr"),
    "temporal_median_fill": _q(FILL, f"SELECT yr, px, {_r('ndvi_filled', 'ndbi_filled', 'ndwi_filled')} FROM fill"),
    "period_years": _q("""ys AS (SELECT DISTINCT CAST(year(l_shipdate) AS INTEGER) AS yr FROM lineitem),
asked(k, b, a) AS (VALUES (1, 1997, 2000), (2, 1980, 1993), (3, 1996, 2030), (4, 1985, 1990), (5, 2010, 2020)),
lists AS (SELECT k, b, a, (SELECT list(yr ORDER BY yr) FROM ys) AS y FROM asked),
cut AS (SELECT k, y, list_filter(y, lambda x: x <= b) AS o, list_filter(y, lambda x: x >= a) AS n, list_filter(y, lambda x: x >= b AND x < a) AS ob, list_filter(y, lambda x: x > b AND x <= a) AS nb FROM lists)""", """
SELECT k AS "case", 'before' AS side, unnest(CASE WHEN len(o) > 0 THEN o[-2:] WHEN len(ob) > 0 THEN ob[1:2] ELSE y[1:1] END) AS yr FROM cut
UNION ALL SELECT k, 'after', unnest(CASE WHEN len(n) > 0 THEN n[1:2] WHEN len(nb) > 0 THEN nb[-2:] ELSE y[-1:] END) FROM cut"""),
    "period_composite": _q(COMP, f"SELECT px, {_r(*[f'{x}_{s}' for s in ('before', 'after') for x in ('ndvi', 'ndbi', 'ndwi')])}, valid_before, valid_after FROM comp"),
    "change_prior": _q(COMP, f"SELECT px, {_r('period_prior')} FROM pri"),
    "temporal_prior": _q(FILL, f"SELECT px, {_r('prior')} FROM tp"),
    "change_score_fusion": _q(TIERS, "SELECT px, round(prob, 6) AS prob, round(greatest(0, least(1, (prob - 0.45) / 0.45::DOUBLE)) * 230, 4) AS alpha FROM tiers"),
    "construction_candidates": _q(TIERS, "SELECT px, tier, 3 AS class FROM tiers WHERE tier > 0"),
    "construction_regions": _q(CLASSES, "SELECT px, class, trend FROM cls WHERE class = 3", True),
    "trend_map": _q(COMP, f"SELECT px, {_r('ndvi_slope', 'ndbi_slope')}, trend FROM trd"),
    "trend_summary": _q(COMP, """SELECT count(*) FILTER (WHERE falling) AS falling, count(*) FILTER (WHERE rising) AS rising,
  count(*) FILTER (WHERE trend = 1) AS shown_falling, count(*) FILTER (WHERE trend = 2) AS shown_rising FROM trd"""),
    "change_summary": _q(CLASSES, _WHOLE, True),
    "change_response": _q(CLASSES, f"""SELECT change_percent > 1 AS change_detected, round(change_hectares / 100, 4) AS area_km2,
  CASE WHEN change_percent > 2 THEN 'High' ELSE 'Medium' END AS confidence FROM ({_WHOLE})""", True),
    "yearly_frames": _q(CUBE, f"""SELECT yr, round(coalesce(avg(ndvi) FILTER (WHERE valid), avg(ndvi)), 4) AS ndvi_mean, round(coalesce(avg(ndbi) FILTER (WHERE valid), avg(ndbi)), 4) AS ndbi_mean,
  round(count(*) FILTER (WHERE ndvi > 0.3 AND ndwi < 0.2 AND valid) / greatest(1, count(*) FILTER (WHERE valid)) * 100, 1) AS vegetation_pct,
  round(count(*) FILTER (WHERE ndbi > 0.05 AND ndvi < 0.25 AND ndwi < 0.2 AND valid) / greatest(1, count(*) FILTER (WHERE valid)) * 100, 1) AS urban_pct,
  round(100 * (1 - count(*) FILTER (WHERE valid) / count(*)), 1) AS cloud_pct,
  round(least(count(*) FILTER (WHERE valid AND 0.6 * abs(ndvi - v0) + 0.4 * abs(ndbi - b0) > 0.12) * ({_GROUND} / (SELECT npx FROM g)) / 10000, round({_GROUND} / 10000, 2)), 2) AS change_area_ha
FROM (SELECT *, first_value(ndvi) OVER p AS v0, first_value(ndbi) OVER p AS b0 FROM cube WINDOW p AS (PARTITION BY px ORDER BY yr)) GROUP BY yr"""),
    "frame_colours": _q(CUBE, f"SELECT yr, px, {_colour('ndbi', 200, 30)} AS red8, {_colour('ndvi', 220, 20)} AS green8, {_colour('ndwi', 180, 30)} AS blue8 FROM cube"),
    "image_quality": _q(CUBE, f"SELECT yr, round(stddev_pop(v), 4) AS std, round(avg(v), 4) AS mean, stddev_pop(v) >= 1 AS is_valid, CASE WHEN stddev_pop(v) >= 45 THEN 'Good' WHEN stddev_pop(v) >= 20 THEN 'Acceptable' ELSE 'Poor' END AS quality FROM (SELECT yr, {_U8} AS v FROM cube) GROUP BY yr"),
    "percentile_normalize": _q(CUBE, """SELECT yr, px, round(CASE WHEN hi > lo THEN greatest(0, least(1, (dn - lo) / (hi - lo))) ELSE 0 END, 6) AS stretched
FROM (SELECT yr, px, floor(nir * 1000) AS dn FROM cube) JOIN (SELECT yr, quantile_cont(floor(nir * 1000), 0.02) AS lo, quantile_cont(floor(nir * 1000), 0.98) AS hi FROM cube GROUP BY yr) USING (yr)"""),
    "classmap_remap_batch": _q(CUBE, """SELECT yr, px, CASE WHEN ade IN (6, 11, 52) THEN 5 WHEN ade IN (13, 28, 46) THEN 4 WHEN ade IN (21, 26, 27) THEN 3
  WHEN ade IN (4, 5, 9, 17, 18) THEN 2 WHEN ade IN (1, 2, 3, 4, 25, 48) THEN 1 ELSE 0 END AS cover FROM cube"""),
    "classmap_remap_stream": _q(CUBE, f"SELECT yr, px, {_STREAM} AS cover FROM cube"),
    "tile_class_histogram": _q(CUBE, "SELECT yr, CAST(r // 16 AS INTEGER) AS tile_row, CAST(c // 16 AS INTEGER) AS tile_col, cls, count(*) AS pixels FROM cube GROUP BY ALL"),
    "transition_pixels": _q(PAIRS, "SELECT px, change_type FROM hit"),
    "transition_stats": _q(PAIRS, """SELECT change_type, count(*) AS pixels, round(count(*) * 100.0::DOUBLE, 6) AS area_sqm, round(count(*) * 100.0::DOUBLE * 0.0001::DOUBLE, 6) AS area_hectares,
  round(count(*) * 100.0::DOUBLE * 0.000247105::DOUBLE, 6) AS area_acres, round(count(*) * 100.0::DOUBLE * 0.000001::DOUBLE, 6) AS area_sqkm FROM hit GROUP BY 1"""),
    "transition_rollup": _q(PAIRS, "SELECT coalesce(change_type, 'all') AS change_type, coalesce(tile, -1) AS tile, pixels FROM (SELECT change_type, tile, count(*) AS pixels FROM hit GROUP BY ROLLUP (change_type, tile))"),
    "transition_colours": _q(PAIRS, f"""SELECT px, CASE {" ".join(f"WHEN {w} THEN '{c}'" for _, w, c in reversed(_TYPES))} ELSE '' END AS overlay,
  CASE WHEN b = a THEN '128,128,128' WHEN b = 3 AND a <> 3 THEN '255,255,0' WHEN b <> 1 AND a = 1 THEN '0,0,255' WHEN b = 2 AND a <> 2 THEN '255,0,0' ELSE '' END AS stream FROM pairs"""),
    "stream_rule_stats": _q(PAIRS, f"SELECT tile, {_SSUM} FROM pairs GROUP BY tile"),
    "merge_statistics": _q(PAIRS, "SELECT change_type, count(*) AS pixels, round(count(*) * 100.0::DOUBLE * 0.0001::DOUBLE, 6) AS area_hectares FROM hit GROUP BY 1"),
    "report_with_defaults": _q(PAIRS, """SELECT change_type, name, color, pixels, area_hectares FROM stats JOIN rule USING (change_type) WHERE area_hectares > 0
UNION ALL SELECT change_type || '_new', change_type || '_new', '128,128,128', pixels, area_hectares FROM stats WHERE area_hectares > 0"""),
    "change_class_dimension": _q(PAIRS, "SELECT change_type, cls, pixels FROM (SELECT change_type, CAST(unnest(f) AS INTEGER) AS cls FROM rule) JOIN (SELECT cls, count(*) AS pixels FROM cube GROUP BY cls) USING (cls)"),
    "tile_grid": _q(_BOX, """SELECT c_custkey, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(west + j * ((east - west) / 4), 6) AS tile_west, round(south + i * ((north - south) / 4), 6) AS tile_south,
  round(west + (j + 1) * ((east - west) / 4), 6) AS tile_east, round(south + (i + 1) * ((north - south) / 4), 6) AS tile_north FROM box, range(4) a(i), range(4) b(j)"""),
    "tile_assign": _q(MASK, """SELECT CAST(y AS INTEGER) AS tile_row, CAST(x AS INTEGER) AS tile_col, count(*) AS pixels, CAST(sum(px) AS BIGINT) AS sum_px FROM cube, grid,
  (SELECT unnest(range(1000)) AS y), (SELECT unnest(range(1000)) AS x) WHERE yr = 2001 AND y * 6 + 8 <= h AND x * 6 + 8 <= w AND r >= y * 6 AND r < y * 6 + 8 AND c >= x * 6 AND c < x * 6 + 8 GROUP BY 1, 2"""),
    "tile_overlap": _q(_BOX, """SELECT c_custkey, round(CASE WHEN (east - west) * (north - south) > 0 THEN 100 * greatest(0, least(east, east + 0.3::DOUBLE) - greatest(west, west + 0.3::DOUBLE)) *
  greatest(0, least(north, north + 0.3::DOUBLE) - greatest(south, south + 0.3::DOUBLE)) / ((east - west) * (north - south)) ELSE 0 END, 6) AS overlap_pct FROM box"""),
    "bbox_keys": _q(_BOX, """SELECT c_custkey, north > south AND east > west AND south BETWEEN -90 AND 90 AND north BETWEEN -90 AND 90 AND west BETWEEN -180 AND 180 AND east BETWEEN -180 AND 180 AS valid_box,
  md5(printf('%.6f_%.6f_%.6f_%.6f', west, south, east, north) || '_2024-01-01_512') AS box_key,
  printf('POLYGON((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))', west, south, east, south, east, north, west, north, west, south) AS wkt,
  round((north - south) * 111000.0::DOUBLE * (east - west) * 111000.0::DOUBLE * cos(radians((north + south) / 2)) / 10000, 4) + 0.0::DOUBLE AS ground_ha FROM box"""),
    "mask_dilate": _q(MASK + ", " + _dilate("mask", "o", "-1, 2", "-1, 2"), "SELECT r, c FROM o"),
    "mask_close": _q(MASK + ", " + _dilate("mask", "o", "-1, 2", "-1, 2") + ", " + _erode("o", "e", "-1, 2", "-1, 2"), "SELECT r, c FROM e"),
    "mask_border": _q(MASK + ", " + _dilate("mask", "o", "-2, 2", "-2, 2"), "SELECT r, c FROM o EXCEPT SELECT r, c FROM mask"),
    "mask_blur": _q(MASK + ", " + _blur("mask", "b"), "SELECT r, c, v FROM b"),
    "mask_smooth": _q(MASK + ", " + _soft("mask", "soft"), "SELECT r, c FROM soft"),
    "thin_lines": _q(f"{MASK}, {_THIN}", "SELECT r, c FROM e3"),
    "regions": _q(MASK + ", " + _regions("mask", "lab"), "SELECT r, c, region FROM lab", True),
    "regions_filtered": _q(MASK + ", " + _regions("mask", "lab"), "SELECT r, c, region FROM lab WHERE region IN (SELECT region FROM lab GROUP BY 1 HAVING count(*) > 3)", True),
    "holes_filled": _q(f"{MASK}, {_HOLES.format('mask')}{_regions('bg', 'out', 4)}", """SELECT r, c FROM mask
UNION ALL SELECT r, c FROM out WHERE region NOT IN (SELECT region FROM out WHERE r = 0 AND c = 0)""", True),
    "solid_regions": _q(f"""{MASK}, {_closed("mask", "cl", "-1, 2")}, {_HOLES.format("cl")}{_regions("bg", "out", 4)},
whole AS (SELECT r, c FROM cl UNION ALL SELECT o.r, o.c FROM out o, g WHERE region NOT IN (SELECT region FROM out WHERE r = 0 AND c = 0) AND o.r * w + o.c < npx), {_regions("whole", "lab")}""",
        "SELECT r, c, region FROM lab WHERE region IN (SELECT region FROM lab GROUP BY 1 HAVING count(*) >= 8)", True),
    "resample_bilinear": _q(MASK, """SELECT y AS r, x AS c, round(sum(wy * wx * nir) / sum(wy * wx), 9) AS nir FROM
  (SELECT y, x, a.sr, b.sc, a.wy, b.wx FROM (SELECT y, unnest([greatest(0, least(h - 1, (y + 1) // 2 - 1)), greatest(0, least(h - 1, (y + 1) // 2))]) AS sr, unnest(CASE WHEN y % 2 = 0 THEN [0.25::DOUBLE, 0.75] ELSE [0.75::DOUBLE, 0.25] END) AS wy FROM (SELECT unnest(range(2 * h)) AS y, h FROM grid)) a,
   (SELECT x, unnest([greatest(0, least(w - 1, (x + 1) // 2 - 1)), greatest(0, least(w - 1, (x + 1) // 2))]) AS sc, unnest(CASE WHEN x % 2 = 0 THEN [0.25::DOUBLE, 0.75] ELSE [0.75::DOUBLE, 0.25] END) AS wx FROM (SELECT unnest(range(2 * w)) AS x, w FROM grid)) b)
JOIN (SELECT r, c, nir FROM cube WHERE yr = 2001) p ON p.r = sr AND p.c = sc GROUP BY 1, 2"""),
    "shrink_area": _q(CUBE, "SELECT r // 2 AS r, c // 2 AS c, round(avg(nir), 6) AS nir FROM cube WHERE yr = 2001 GROUP BY 1, 2"),
    "best_product": _q(_P, "SELECT aoi, yr, id, cloud FROM prod QUALIFY row_number() OVER (PARTITION BY aoi, yr ORDER BY coalesce(cloud, 100), start DESC, id) = 1"),
    "catalogue_search": _q(_P, "SELECT aoi, id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY start, id) AS k FROM prod WHERE cloud < 20 AND start > TIMESTAMP '1997-06-01' AND start < TIMESTAMP '1997-07-31') WHERE k <= 10"),
    "catalogue_areas": _q(_P + ", " + _NATIONS, """SELECT n_nationkey AS aoi, id FROM (SELECT id, cloud, start, CAST((aoi % 25) * 5 - 61 AS DOUBLE) AS w, CAST((aoi % 25) * 3 - 41 AS DOUBLE) AS s FROM prod) p
JOIN box ON w < east AND w + 2 > west AND s < north AND s + 2 > south AND east > west WHERE cloud < 30 AND start > TIMESTAMP '1997-05-02' AND start < TIMESTAMP '1997-08-30'"""),
    "total_area": _q(PAIRS, "SELECT (SELECT round(sum(area_hectares), 6) FROM stats WHERE area_hectares > 0) AS type_hectares, (SELECT count(DISTINCT px) FROM hit) / 100 AS changed_hectares"),
    "history_topk": "SELECT user_id, event_id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 20",
    "latest_status": "SELECT user_id, event_type AS status, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "cache_hits": _q(_CACHE + ", " + _live(3), "SELECT event_id, key, id AS entry FROM req JOIN live USING (key)"),
    "cache_misses": _q(_CACHE + ", " + _live(1), "SELECT event_id, key FROM req WHERE key NOT IN (SELECT key FROM live)"),
    "cache_expired": _q(_CACHE, "SELECT id, key FROM entry WHERE created + INTERVAL 3 DAY <= TIMESTAMP '2024-01-25'"),
    "areas_with_results": "SELECT c_custkey AS o_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS has_results FROM customer",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2",
    "streaming_tiles": _q(PAIRS, f"SELECT tile % 7 AS city, {_SSUM}, count(*) AS pixels_processed, count(DISTINCT tile) AS tiles_processed FROM pairs WHERE (tile // 1000 + tile % 1000) % 5 <> 0 GROUP BY 1"),
    "streaming_bad_tiles": _q(PAIRS, "SELECT DISTINCT tile % 7 AS city, tile, 'pair_0_' || (tile // 1000) || '_' || (tile % 1000) || '.npy' AS name, true AS has_error FROM pairs WHERE (tile // 1000 + tile % 1000) % 5 = 0"),
    "streaming_totals": _q(PAIRS, f"SELECT tile % 7 AS city, {_SSUM}, count(*) AS pixels_processed, count(DISTINCT tile) AS tiles_processed FROM pairs GROUP BY 1"),
    "road_regions": _q(", ".join([MASK, _THIN, _regions("e3", "lab")]), "SELECT r, c, region FROM lab WHERE region IN (SELECT region FROM lab GROUP BY 1 HAVING count(*) >= 6)", True),
    "real_tiles": _q(CUBE, f"SELECT yr, stddev_pop({_U8}) > 15 AS is_real_tile FROM cube GROUP BY yr"),
    "true_colour": _q(CUBE, "SELECT yr, px, concat_ws(',', " + ", ".join(f"CAST(floor(greatest(0, least(255, round({x}, 9) * 255))) AS INTEGER)" for x in ("red", "green", "swir")) + ") AS rgb FROM cube"),
    "category_areas": _q(CUBE, "SELECT yr, cls, round(count(*) * 100.0::DOUBLE / 10000, 6) AS hectares FROM cube GROUP BY 1, 2"),
    "comparable_tiles": _q(CUBE, """SELECT tr AS tile_row, tc AS tile_col, b.h AS "rows", b.w AS "columns" FROM
  (SELECT yr, CAST(r // 8 AS INTEGER) AS tr, CAST(c // 8 AS INTEGER) AS tc, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM cube WHERE yr = 1996 GROUP BY 1, 2, 3) b JOIN
  (SELECT yr, CAST(r // 8 AS INTEGER) AS tr, CAST(c // 8 AS INTEGER) AS tc, max(r) - min(r) + 1 AS h, max(c) - min(c) + 1 AS w FROM cube WHERE yr = 2001 GROUP BY 1, 2, 3) a USING (tr, tc, h, w)"""),
    "city_report": """WITH city(k, name) AS (VALUES ('bangalore', 'Bangalore'), ('delhi', 'Delhi'), ('mumbai', 'Mumbai'), ('hyderabad', 'Hyderabad')),
c AS (SELECT ['bangalore', 'Delhi', 'mumbai', 'HYDERABAD', 'pune'][c_custkey % 5 + 1] AS city, count(*) AS n FROM customer GROUP BY 1)
SELECT city, coalesce(name, city) AS name, CASE WHEN name IS NULL THEN 'Unknown' ELSE 'India' END AS country, n FROM c LEFT JOIN city ON lower(city) = k""",
    "history_json": """SELECT user_id, 'completed' AS status, CAST(to_json({'event_id': event_id, 'event_type': event_type}) AS VARCHAR) AS result_json
FROM events WHERE event_type = 'purchase'""",
    "year_sources": _q(_P, "SELECT aoi, yr, id, cloud FROM prod WHERE cloud <= 95 QUALIFY row_number() OVER (PARTITION BY aoi, yr ORDER BY cloud, start DESC, id) = 1"),
}

#: The same rows by another way.
SQL["trend_from_state"] = SQL["trend_map"]
