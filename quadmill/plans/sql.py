"""DuckDB SQL of the raster queries, on the driver's tables."""

from __future__ import annotations

_PX = """px AS (
  SELECT 4 AS z, CAST(l_orderkey % 256 AS INT) AS gx, CAST(l_partkey % 256 AS INT) AS gy, CAST(sum(CAST(l_quantity AS BIGINT)) % 256 AS INT) AS r,
    CAST(max(l_suppkey) % 256 AS INT) AS g, CAST(min(l_linenumber) AS INT) AS b, CAST(1 + count(*) % 255 AS INT) AS a
  FROM lineitem GROUP BY ALL)"""
_FEW = _PX + ", few AS (SELECT z, gx, gy, r % 3 AS r, g % 2 AS g, 0 AS b, 255 AS a FROM px)"
_V = "(a::BIGINT * 16777216 + b * 65536 + g * 256 + r)"
_PATHS = """p AS (
  SELECT o_orderkey AS id, o_custkey % 64 AS x, o_orderkey % 64 AS y, o_orderkey % 30 AS k FROM orders), paths AS (
  SELECT id, '/tiles/' || CASE WHEN k = 20 THEN '0' ELSE '6' END || '/' || CASE WHEN k = 10 THEN x::VARCHAR ELSE x || '/' || y END || CASE WHEN k = 0 THEN 'png' ELSE '.png' END AS osm,
    '/tiles/TileExport_' || CASE WHEN k = 20 THEN '0' ELSE '6' END || '_' || CASE WHEN k = 10 THEN x::VARCHAR ELSE x || '_' || y END || CASE WHEN k = 0 THEN 'png' ELSE '.png' END AS zxy,
    '/tiles/griddata_' || CASE WHEN k = 10 THEN x::VARCHAR ELSE x || '_' || y END || '_' || CASE WHEN k = 20 THEN '0' ELSE '6' END || CASE WHEN k = 0 THEN 'png' ELSE '.png' END AS xyz
  FROM p)"""
_TILES = "tiles AS (SELECT DISTINCT 6 AS z, CAST(o_custkey % 64 AS INT) AS x, CAST(o_orderkey % 64 AS INT) AS y FROM orders)"


def _pair(u: str, v: str) -> str:
    return f"CASE WHEN {u} IS NOT NULL AND {v} IS NOT NULL THEN ({u} + {v}) // 2 ELSE coalesce({u}, {v}) END"


def _half(source: str) -> str:
    corner = lambda c, x, y: f"max(CASE WHEN gx % 2 = {x} AND gy % 2 = {y} THEN {c} END)"
    channels = ", ".join(f"CAST({_pair(f'({_pair(corner(c, 0, 0), corner(c, 1, 0))})', f'({_pair(corner(c, 0, 1), corner(c, 1, 1))})')} AS INT) AS {c}" for c in "rgba")
    return f"SELECT z - 1 AS z, gx // 2 AS gx, gy // 2 AS gy, {channels} FROM {source} GROUP BY z, gx // 2, gy // 2"


_LEVELS = f"{_PX}, l3 AS ({_half('px')}), l2 AS ({_half('l3')}), l1 AS ({_half('l2')}), l0 AS ({_half('l1')})"
_STATS = f"""SELECT z, gx // 16 AS x, gy // 16 AS y, count(*) AS n, count(DISTINCT {_V}) + CASE WHEN count(*) = 256 THEN 0 ELSE 1 END AS n_colors,
  count(*) = 256 AND min(a) = 255 AS is_opaque, bool_and(r = g AND r = b) AS is_gray"""
#: A dense raster of six colours with clamped neighbours in regions of 8.
_NEAR = f"""{_FEW}, grid AS (SELECT CAST(i % 256 AS INT) AS gx, CAST(i // 256 AS INT) AS gy FROM range(65536) t(i)),
d AS (SELECT grid.gx, grid.gy, coalesce({_V}, 0) AS v FROM grid LEFT JOIN few ON grid.gx = few.gx AND grid.gy = few.gy),
n1 AS (SELECT *, coalesce(lag(v) OVER r, v) AS w, coalesce(lead(v) OVER r, v) AS e FROM d WINDOW r AS (PARTITION BY gy, gx // 8 ORDER BY gx)),
n AS (SELECT gx, gy, v, w, e, coalesce(lag(v) OVER c, v) AS n, coalesce(lead(v) OVER c, v) AS s, coalesce(lag(w) OVER c, w) AS nw, coalesce(lag(e) OVER c, e) AS ne,
  coalesce(lead(w) OVER c, w) AS sw, coalesce(lead(e) OVER c, e) AS se FROM n1 WINDOW c AS (PARTITION BY gx, gy // 8 ORDER BY gy))"""
_OUT = "SELECT 5 AS z, gx * 2 + q % 2 AS gx, gy * 2 + q // 2 AS gy, CAST(o & 255 AS INT) AS r, CAST(o >> 8 & 255 AS INT) AS g, CAST(o >> 16 & 255 AS INT) AS b, CAST(o >> 24 AS INT) AS a FROM four WHERE o >= 16777216"
_CAST = "CAST(gx AS INT) AS gx, CAST(gy AS INT) AS gy"


def _four(q: list[str]) -> str:
    return "four AS (" + " UNION ALL ".join(f"SELECT gx, gy, {i} AS q, {x} AS o FROM n" for i, x in enumerate(q)) + ")"


def _epx(x: str, y: str) -> str:
    return f"CASE WHEN n <> s AND w <> e AND {x} = {y} THEN {x} ELSE v END"


def _corner(side: str, corner: str, end: str) -> str:
    return f"CASE WHEN {side} = {corner} AND {corner} = {end} THEN {corner} ELSE v END"


def _parse(column: str, order: str) -> str:
    pattern = r"/(\d+)/(\d+)/(\d+)\.[^./]*$" if column in ("osm", "path") else r"/[^_/]*_(\d+)_(\d+)_(\d+)\.[^./]*$"
    at = {c: f"TRY_CAST(regexp_extract({column}, '{pattern}', {order.index(c) + 1}) AS INT)" for c in "xyz"}
    return f"SELECT {at['x']} AS x, {at['y']} AS y, {at['z']} AS z, {column} AS path FROM paths WHERE {at['z']} >= 1 AND {at['x']} IS NOT NULL AND {at['y']} IS NOT NULL"


def _lerp(c: int) -> str:
    ch = lambda k: f"(coalesce({k}, 0) >> {8 * c} & 255)"
    top = f"({ch('v00')} * (128 - wx) + {ch('v10')} * wx) * (128 - wy)"
    low = f"({ch('v01')} * (128 - wx) + {ch('v11')} * wx) * wy"
    return f"CAST(({top} + {low}) >> 14 AS INT) AS {'rgba'[c]}"


ORACLES = {
    "half_average_nodata": f"WITH {_PX} {_half('px')}",
    "pyramid_levels": f"WITH {_LEVELS} SELECT z, count(*) AS px, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in "rgba") + " FROM (SELECT * FROM px UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l0) GROUP BY z",
    "alpha_mask_half": f"WITH {_PX} SELECT DISTINCT 3 AS z, gx // 2 AS gx, gy // 2 AS gy FROM px",
    "lanczos_mask_rule": f"WITH {_PX} SELECT gx, gy, CASE WHEN r % 3 = 0 THEN 0 WHEN a % 4 = 0 THEN 16777216 ELSE (a % 4)::BIGINT * 16777216 + b * 65536 + g * 256 + r END AS v FROM px",
    "data_count_tile": f"WITH {_PX} SELECT 4 AS z, gx // 16 AS x, gy // 16 AS y, count(*) AS data_px FROM px GROUP BY ALL",
    "data_count_roi": f"WITH {_PX} SELECT 4 AS z, gx // 16 AS x, gy // 16 AS y, count(*) AS data_px FROM px WHERE gx % 16 BETWEEN 2 AND 9 AND gy % 16 BETWEEN 3 AND 12 GROUP BY ALL",
    "any_data_tile": f"WITH {_PX} SELECT 4 AS z, CAST(i % 128 AS INT) AS x, CAST(i // 128 AS INT) AS y, n IS NOT NULL AS any_data FROM range(16384) t(i) LEFT JOIN (SELECT gx // 2 AS x, gy // 2 AS y, count(*) AS n FROM px GROUP BY ALL) d ON d.x = i % 128 AND d.y = i // 128",
    "any_data_box": f"WITH {_PX} SELECT 4 AS z, CAST(i % 16 AS INT) AS x, CAST(i // 16 AS INT) AS y, n IS NOT NULL AS any_data FROM range(256) t(i) LEFT JOIN (SELECT gx // 16 AS x, gy // 16 AS y, count(*) AS n FROM px WHERE gx % 16 BETWEEN 4 AND 6 AND gy % 16 = 7 GROUP BY ALL) d ON d.x = i % 16 AND d.y = i // 16",
    "roi_nonempty": f"WITH {_PX} SELECT DISTINCT 5 AS z, gx // 8 AS x, gy // 8 AS y FROM px",
    "palette_size": f"WITH {_PX}, s AS ({_STATS} FROM px GROUP BY ALL) SELECT z, x, y, CAST(n_colors AS BIGINT) AS n_colors FROM s",
    "palette_order": f"""WITH {_FEW}, q AS (SELECT z, gx // 16 AS x, gy // 16 AS y, (gy % 16) * 16 + gx % 16 AS i, CASE WHEN r = 1 THEN 100 ELSE 255 END AS a, r, g, b FROM few),
c AS (SELECT z, x, y, {_V} AS v, min(a) AS a, min(i) AS first_px FROM q GROUP BY z, x, y, {_V})
SELECT z, x, y, CAST(row_number() OVER (PARTITION BY z, x, y ORDER BY a = 255, first_px) - 1 AS INT) AS place, v, CAST(first_px AS INT) AS first_px FROM c""",
    "png_color_type": f"""WITH {_FEW}, both_px AS (SELECT * FROM few UNION ALL SELECT 5, gx, gy, r, g, b, a FROM px), s AS ({_STATS} FROM both_px GROUP BY z, gx // 16, gy // 16),
d AS (SELECT *, CASE WHEN n_colors <= 2 THEN 1 WHEN n_colors <= 4 THEN 2 WHEN n_colors <= 16 THEN 4 ELSE 8 END AS depth FROM s)
SELECT z, x, y, CASE WHEN n_colors > 256 THEN CASE WHEN is_opaque THEN 2 ELSE 6 END WHEN depth = 8 AND is_opaque AND is_gray THEN 0 ELSE 3 END AS color_type, depth AS bit_depth FROM d""",
    "opaque_gray_flags": f"WITH {_FEW}, q AS (SELECT z, gx, gy, r, r AS g, CASE WHEN gx < 128 THEN r ELSE 0 END AS b, a FROM few), s AS ({_STATS} FROM q GROUP BY ALL) SELECT z, x, y, is_opaque, is_gray FROM s",
    "channel_pack_unpack": f"WITH {_PX} SELECT gx, gy, {_V} AS v, r, g, b, a FROM px",
    "pixel_distance": f"""WITH {_PX} SELECT p.gx, p.gy, abs(p.r - q.r) + abs(p.g - q.g) + abs(p.b - q.b) + abs(p.a - q.a) AS distance,
  greatest(abs(p.r - q.r), abs(p.g - q.g), abs(p.b - q.b), abs(p.a - q.a)) <= 16 AS similar FROM px p JOIN px q ON q.gx = p.gx + 1 AND q.gy = p.gy""",
    "blend_levels": f"WITH {_PX} SELECT p.gx, p.gy, "
    + ", ".join("CAST(" + " + ".join(f"((p.{c} * {m} + q.{c} * {n}) >> {s})::BIGINT * {1 << 8 * i}" for i, c in enumerate("rgba")) + f" AS BIGINT) AS b{m}{n}" for m, n, s in ((1, 3, 2), (3, 1, 2), (1, 1, 1)))
    + " FROM px p JOIN px q ON q.gx = p.gx + 1 AND q.gy = p.gy",
    "nn_enlarge": f"WITH {_PX} SELECT 6 AS z, CAST(gx * 4 + i AS INT) AS gx, CAST(gy * 4 + j AS INT) AS gy, r, g, b, a FROM px, range(4) s(i), range(4) t(j)",
    "nn_bitmask": f"WITH {_PX}, e AS (SELECT gx * 2 + i AS gx, gy * 2 + j AS gy, r FROM px, range(2) s(i), range(2) t(j) WHERE r % 2 = 0) SELECT CAST(gy AS INT) AS gy, count(*) AS px, CAST(sum(gx) AS BIGINT) AS sum_gx, CAST(sum(r) AS BIGINT) AS sum_r FROM e GROUP BY gy",
    "epx_enlarge": f"WITH {_NEAR}, {_four([_epx('w', 'n'), _epx('e', 'n'), _epx('w', 's'), _epx('e', 's')])} {_OUT}",
    "eagle_enlarge": f"WITH {_NEAR}, {_four([_corner('w', 'nw', 'n'), _corner('e', 'ne', 'n'), _corner('w', 'sw', 's'), _corner('e', 'se', 's')])} {_OUT}",
    "bilinear_enlarge": f"""WITH {_PX}, v AS (SELECT gx, gy, {_V} AS v FROM px), rois AS (SELECT DISTINCT gx // 8 AS rx, gy // 8 AS ry FROM v),
w AS (SELECT CAST(i AS INT) AS i, (i * 30583) >> 16 AS low, (i * 30583) >> 9 & 127 AS weight, least(((i * 30583) >> 16) + 1, 7) AS high FROM range(16) t(i)),
c AS (SELECT rx, ry, a.i AS px, b.i AS py, a.weight AS wx, b.weight AS wy, rx * 8 + a.low AS x0, rx * 8 + a.high AS x1, ry * 8 + b.low AS y0, ry * 8 + b.high AS y1 FROM rois, w a, w b)
SELECT 4 AS z, rx, ry, c.px, c.py, {", ".join(map(_lerp, range(4)))} FROM (
  SELECT c.*, p.v AS v00, q.v AS v10, s.v AS v01, t.v AS v11 FROM c LEFT JOIN v p ON p.gx = x0 AND p.gy = y0 LEFT JOIN v q ON q.gx = x1 AND q.gy = y0
  LEFT JOIN v s ON s.gx = x0 AND s.gy = y1 LEFT JOIN v t ON t.gx = x1 AND t.gy = y1) c""".replace("30583", str((7 << 16) // 15)),
    "edge_extend": f"""WITH {_PX}, wide AS (SELECT * FROM px UNION ALL SELECT p.z, CAST(p.gx + i AS INT), p.gy, p.r, p.g, p.b, p.a FROM px p, range(1, 5) t(i) WHERE p.gx % 16 = 11 AND NOT EXISTS (SELECT 1 FROM px o WHERE o.gx = p.gx + i AND o.gy = p.gy))
SELECT * FROM wide UNION ALL SELECT p.z, p.gx, CAST(p.gy + i AS INT), p.r, p.g, p.b, p.a FROM wide p, range(1, 4) t(i) WHERE p.gy % 16 = 12 AND NOT EXISTS (SELECT 1 FROM wide o WHERE o.gx = p.gx AND o.gy = p.gy + i)""",
    "nodata_fill_mean": f"""WITH {_PX}, q AS (SELECT * FROM px),
near AS (SELECT p.gx + dx AS x, p.gy + dy AS y, p.* FROM q p, range(-2, 3) s(dx), range(-2, 3) t(dy) WHERE p.gx + dx >= 0 AND p.gy + dy >= 0 AND (p.gx + dx) // 16 = p.gx // 16 AND (p.gy + dy) // 16 = p.gy // 16),
m AS (SELECT x, y, {", ".join(f"(2 * sum({c}) + count(*)) // (2 * count(*)) AS {c}" for c in "rgba")}, arg_max(gx, gy * 256 + gx) AS lx, arg_max(gy, gy * 256 + gx) AS ly FROM near GROUP BY x, y)
SELECT z, gx, gy, r, g, b, a FROM q UNION ALL
SELECT 4, CAST(h.x AS INT), CAST(h.y AS INT), CAST(m.r AS INT), CAST(m.g AS INT), CAST(m.b AS INT), CAST(m.a AS INT) FROM m h JOIN m ON m.x = h.lx AND m.y = h.ly WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.gx = h.x AND q.gy = h.y)""",
    "tile_catalog_parse": f"WITH {_PATHS} {_parse('osm', 'zxy')}",
    "tile_parse_legacy": f"WITH {_PATHS} {_parse('zxy', 'zxy')} UNION ALL {_parse('xyz', 'xyz')}",
    "tile_path_format_all": f"WITH {_TILES} SELECT z, x, y, '/out/' || z || '/' || x || '/' || y || '.png' AS osm, '/out/' || z || '/TileExport_' || z || '_' || x || '_' || y || '.png' AS zxy, '/out/' || z || '/griddata_' || x || '_' || y || '_' || z || '.png' AS xyz FROM tiles",
    "tile_parse_lenient": "WITH t AS (SELECT DISTINCT o_custkey || '@' || (o_orderkey % 10) || 'x' AS text FROM orders) SELECT text, CAST(list_sum(list_transform(range(len(text)), lambda i: coalesce(TRY_CAST(substr(text, i + 1, 1) AS BIGINT), 0) * CAST(pow(10, len(text) - 1 - i) AS BIGINT))) % 4294967296 AS BIGINT) AS number FROM t",
    "path_parts": f"""WITH {_PATHS}, s AS (SELECT id, osm, string_split(osm, '/') AS parts FROM paths)
SELECT id, {", ".join(f"CAST(CASE WHEN len(parts) > {n + 1} THEN len(array_to_string(parts[1:len(parts) - {n + 1}], '/')) ELSE 0 END AS INT) AS slash{n}" for n in (0, 2, 9))},
  regexp_replace(osm, '/[^/]*$', '') AS folder, regexp_extract(osm, '\\.([^./]*)$', 1) AS extension, regexp_replace(osm, '/[^/]*$', '') || '/a.png' AS joined FROM s""",
    "tile_counts": f"WITH {_TILES} SELECT count(*) AS tiles, count(DISTINCT (x // 2) * 1000 + y // 2) AS parents FROM tiles",
    "quad_clusters": f"WITH {_TILES} SELECT 5 AS pz, x // 2 AS px, y // 2 AS py, CAST((y // 2) * 32 + x // 2 AS BIGINT) AS parent_key, count(*) AS members, string_agg(CAST(y * 64 + x AS VARCHAR), ',' ORDER BY y * 64 + x) AS member_keys FROM tiles GROUP BY x // 2, y // 2",
    "children_expand": f"WITH {_TILES} SELECT z, x, y, 8 AS child_z, CAST(x * 4 + i AS INT) AS child_x, CAST(y * 4 + j AS INT) AS child_y FROM tiles, range(4) s(i), range(4) t(j)",
    "roi_for_children": f"WITH {_TILES} SELECT 8 AS child_z, CAST(x * 4 + i AS INT) AS child_x, CAST(y * 4 + j AS INT) AS child_y, CAST(i * 64 AS INT) AS roi_x, CAST(j * 64 AS INT) AS roi_y, 64 AS roi_size FROM tiles, range(4) s(i), range(4) t(j)",
    "quadrant_offset": f"WITH {_TILES} SELECT z, x, y, x % 2 * 128 AS off_x, y % 2 * 128 AS off_y FROM tiles",
    "kernel_padding": f"""WITH {_TILES}, k(method, extent) AS (VALUES ('lanczos3', 3), ('lanczos5', 5), ('bilinear', 2), ('nearest', 1), ('epx', 3), ('eagle', 3), ('average', 2), ('xbr', 5)),
e AS (SELECT method, extent, extent // 2 + extent % 2 AS reach FROM k), s AS (SELECT DISTINCT x % 2 * 128 AS roi_x FROM tiles)
SELECT method, extent, reach, roi_x, 128 + reach AS roi_w, 256 + 2 * reach AS dest_w, least(128 + reach, 256 - roi_x) AS copy_w FROM e, s""",
    "dir_sort": f"""WITH {_PATHS}, q AS (SELECT regexp_extract(osm, '^/tiles/([^/]*)/(.*)$', 1) AS folder, regexp_extract(osm, '^/tiles/([^/]*)/(.*)$', 2) AS rest FROM paths),
n AS (SELECT DISTINCT folder, string_split(rest, '/')[1] AS name, contains(rest, '/') AS is_dir FROM q)
SELECT folder, CAST(row_number() OVER (PARTITION BY folder ORDER BY is_dir DESC, name) - 1 AS INT) AS place, name, is_dir FROM n""",
    "tile_latest": f"WITH {_PATHS.replace('paths AS (', 'every AS (')}, paths AS (SELECT regexp_replace(osm, '\\.png$', '.' || id) AS path FROM every), f AS ({_parse('path', 'zxy')}) SELECT z, x, y, max(path) AS path FROM f GROUP BY z, x, y",
}
#: The tile form gives the pixel form's results.
ORACLES["tile_half_average"] = ORACLES["half_average_nodata"]
ORACLES["tile_epx"] = ORACLES["epx_enlarge"]
ORACLES["tile_eagle"] = ORACLES["eagle_enlarge"]
ORACLES["tile_statistics"] = f"WITH {_PX}, s AS ({_STATS} FROM px GROUP BY ALL) SELECT z, x, y, CAST(n AS BIGINT) AS data_px, CAST(n_colors AS BIGINT) AS n_colors FROM s"
ORACLES["tile_png_round_trip"] = f"WITH {_PX} SELECT * FROM px"
ORACLES["tile_pyramid"] = ORACLES["pyramid_levels"].replace("SELECT * FROM px UNION ALL SELECT * FROM l3", "SELECT * FROM l3")
#: Boxes of 4 reach one pixel before their own and two behind it, so a pixel counts in boxes of places two before it to one behind it.
ORACLES["nodata_fill_mean_even"] = f"""WITH {_PX}, o AS (SELECT i AS dx, j AS dy FROM range(-1, 3) s(i), range(-1, 3) t(j)),
near AS (SELECT p.gx AS x, p.gy AS y, q.r, q.g, q.b, q.a FROM px p, o JOIN px q ON q.gx = p.gx + dx AND q.gy = p.gy + dy WHERE q.gx // 16 = p.gx // 16 AND q.gy // 16 = p.gy // 16),
m AS (SELECT x, y, {", ".join(f"(2 * sum({c}) + count(*)) // (2 * count(*)) AS {c}" for c in "rgba")} FROM near GROUP BY x, y),
h AS (SELECT p.gx + dx AS x, p.gy + dy AS y, arg_max(p.gx, p.gy * 256 + p.gx) AS lx, arg_max(p.gy, p.gy * 256 + p.gx) AS ly FROM px p, o
  WHERE p.gx + dx >= 0 AND p.gy + dy >= 0 AND (p.gx + dx) // 16 = p.gx // 16 AND (p.gy + dy) // 16 = p.gy // 16 GROUP BY 1, 2)
SELECT z, gx, gy, r, g, b, a FROM px UNION ALL
SELECT 4, CAST(h.x AS INT), CAST(h.y AS INT), CAST(m.r AS INT), CAST(m.g AS INT), CAST(m.b AS INT), CAST(m.a AS INT) FROM h JOIN m ON m.x = h.lx AND m.y = h.ly WHERE NOT EXISTS (SELECT 1 FROM px WHERE px.gx = h.x AND px.gy = h.y)"""
