"""Queries of basin descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowfeat.operators import basin as B
from flowfeat.plans._base import query
from flowfeat.sources.bindings import CAT, CELLS, cat, cells, table

SH = lambda c, of="true": f"round(count(*) FILTER (({c}) AND {of}) / nullif(count(*) FILTER ({of}), 0)::DOUBLE, 6)"


@query("i4_elevation_stats", f"WITH {CELLS} SELECT basin, round(min(elevation), 4) AS min, round(avg(elevation), 4) AS mean, round(quantile_cont(elevation, 0.5), 6) AS median, round(quantile_cont(slope, 0.5), 4) AS slope_median, round(max(elevation), 4) AS max, round(stddev_pop(elevation), 4) AS std, " + ", ".join(f"{SH(f'elevation >= {t}')} AS above_{t}" for t in (1500, 2000, 2500)) + ", round(quantile_cont(slope, 0.9), 4) AS slope_p90, " + ", ".join(f"{SH(f'slope >= {t}')} AS slope_{t}" for t in (10, 20, 30)) + f", {SH('aspect >= 315 OR aspect < 45')} AS north, {SH('aspect >= 45 AND aspect < 135')} AS east, {SH('aspect >= 135 AND aspect < 225')} AS south, {SH('aspect >= 225 AND aspect < 315')} AS west FROM cells GROUP BY 1")
def i4(spark, d):
    return B.elevation_stats(cells(spark, d), "basin")


@query("i5_class_fractions", f"WITH {CELLS} SELECT basin, {SH('valid')} AS valid_fraction, " + ", ".join(f"{SH(f'code = {c}', 'valid')} AS class_{c}" for c in range(10)) + " FROM cells GROUP BY 1")
def i5(spark, d):
    return B.class_fractions(cells(spark, d), "basin", "code", list(range(10)), "valid")


@query("i6_lithology", f"WITH {CELLS}, c AS (SELECT basin, code, count(*) AS n FROM cells GROUP BY 1, 2), s AS (SELECT basin, sum(n) FILTER (code IN (0, 1)) / sum(n)::DOUBLE AS carbonate, sum(n) FILTER (code IN (2, 3, 4)) / sum(n)::DOUBLE AS clastic FROM c GROUP BY 1), d AS (SELECT basin, code AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY n DESC, code) AS k FROM c) WHERE k = 1) SELECT basin, round(coalesce(carbonate, 0), 6) AS carbonate, round(coalesce(clastic, 0), 6) AS clastic, dominant, CASE WHEN carbonate >= 0.3 THEN 1.0 WHEN carbonate >= 0.1 THEN 0.5 ELSE 0.0 END::DOUBLE AS karst_step FROM s JOIN d USING (basin)")
def i6(spark, d):
    return B.lithology(cells(spark, d), "basin", "code", {"carbonate": [0, 1], "clastic": [2, 3, 4]}, "carbonate")


SOIL = {"subsoil_clay": "clay / 200", "subsoil_sand": "sand / 300", "coarse_fragments": "slope / 60", "soil_depth": "CASE WHEN code = 3 THEN -1 WHEN code < 9 THEN slope * 9 END", "bedrock_depth": "elevation / 3 - 100", "water_capacity": "CASE WHEN code > 1 THEN clay * 3 END", "log_ksat": "CASE WHEN code = 5 THEN -40 ELSE slope / 20 - 1 END"}


@query("i7_soil_stats", f"WITH {CELLS}, s AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in SOIL.items())} FROM cells) SELECT basin, " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(quantile_cont({c}, 0.5), 4) AS {c}_median, round(quantile_cont({c}, 0.9), 4) AS {c}_p90" for c in ("clay", "sand"))
       + f", {SH('clay >= 35')} AS clayey, {SH('sand >= 60 AND clay < 20')} AS sandy, round(avg(greatest(0, least(1, clay / 50 - sand / 100 + 0.5))), 6) AS runoff_index, round(avg(subsoil_clay), 6) AS subsoil_clay, round(avg(subsoil_sand), 6) AS subsoil_sand, round(avg(coarse_fragments), 6) AS coarse_fragments, round(avg(soil_depth) FILTER (soil_depth >= 0), 6) AS soil_depth_mean, {SH('soil_depth <= 100', 'soil_depth >= 0')} AS shallow, round(avg(bedrock_depth) FILTER (bedrock_depth >= 0), 6) AS bedrock_depth, round(avg(water_capacity) FILTER (water_capacity >= 0), 6) AS water_capacity, round(avg(pow(10, log_ksat)) FILTER (log_ksat > -30), 6) AS conductivity FROM s GROUP BY 1")
def i7(spark, d):
    return B.soil_stats(cells(spark, d).withColumns({k: F.expr(v).cast("double") for k, v in SOIL.items()}), "basin")


MONTHLY = f"w AS (SELECT l_suppkey AS basin, month(l_shipdate) AS month, sum(l_quantity) AS precipitation, avg(l_discount) * 400 - 20 - l_suppkey % 30 / 2.0 + month(l_shipdate) AS temp FROM lineitem GROUP BY 1, 2, l_suppkey), m AS (SELECT *, temp - 4 AS tmin, temp + 6 AS tmax, radians(basin % 120 - 60) AS lat, {B.MIDDLE_DAYS}[month] AS day, {B.MONTH_DAYS}[month] AS days FROM w), s AS (SELECT *, 0.409 * sin(2 * pi() / 365 * day - 1.39) AS decl, 1 + 0.033 * cos(2 * pi() / 365 * day) AS dist FROM m), a AS (SELECT *, acos(greatest(-1, least(1, -tan(lat) * tan(decl)))) AS ws FROM s), e AS (SELECT *, CASE WHEN temp <= -20 THEN 0 ELSE greatest(0, 0.0023 * 24 * 60 / pi() * 0.0820 * 0.408 * dist * (ws * sin(lat) * sin(decl) + cos(lat) * cos(decl) * sin(ws)) * (temp + 17.8) * sqrt(10)) * days END AS pet, precipitation * greatest(0, least(1, (2 - temp) / 4)) AS snow FROM a)"


@query("i8_climate_summary", f"WITH {MONTHLY} SELECT basin, round(sum(precipitation), 3) AS annual, round(stddev_pop(precipitation) / avg(precipitation), 6) AS seasonality, round(avg(temp), 3) AS mean_temp, round(avg(temp) FILTER (CASE WHEN lat >= 0 THEN month IN (12, 1, 2) ELSE month IN (6, 7, 8) END), 3) AS winter_temp, round(max(temp) - min(temp), 3) AS continentality, round(1 / (1 + max(temp) - min(temp)), 6) AS oceanicity, round(sum(pet), 3) AS pet, CASE WHEN sum(pet) > 0 THEN round(sum(precipitation) / sum(pet), 6) END AS aridity, round(sum(snow) / sum(precipitation), 6) AS snow_share FROM e GROUP BY 1")
def i8(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("basin"), F.month("l_shipdate").alias("month")).agg(F.sum("l_quantity").alias("precipitation"), F.avg("l_discount").alias("x"))
    m = m.withColumn("temp", F.col("x") * 400 - 20 - F.col("basin") % 30 / 2.0 + F.col("month"))
    return B.climate_summary(m.withColumns({"tmin": F.col("temp") - 4, "tmax": F.col("temp") + 6}), "basin", F.col("basin") % 120 - 60)


@query("i9_built_share", f"WITH {CELLS} SELECT basin, round(avg(greatest(0, least(1, (sand - 20) / 60))), 6) AS built_share FROM cells GROUP BY 1")
def i9(spark, d):
    return B.built_share(cells(spark, d), "basin", F.col("sand") - 20, 60.0)


@query("i10_upstream_rollup", """WITH f AS (SELECT l_suppkey AS basin, l_partkey AS id, ['lake', 'reservoir', 'barrier', 'glacier'][l_partkey % 4 + 1] AS kind, l_quantity AS area, l_extendedprice AS storage, year(l_shipdate) AS year, l_orderkey * 10 + l_linenumber AS distance FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY basin, id ORDER BY distance) AS k FROM f)
  SELECT basin, count(*) FILTER (kind = 'lake') AS n_lake, count(*) FILTER (kind = 'reservoir') AS n_reservoir, count(*) FILTER (kind = 'barrier') AS n_barrier, count(*) FILTER (kind = 'glacier') AS n_glacier, round(coalesce(sum(area) FILTER (kind = 'lake'), 0), 4) AS area_lake, round(coalesce(sum(area) FILTER (kind = 'glacier'), 0), 4) AS area_glacier, round(sum(storage) FILTER (kind = 'reservoir'), 4) AS storage, max(storage) FILTER (kind = 'reservoir') AS max_storage, max(year)::INT AS newest, min(distance) AS nearest FROM o WHERE k = 1 GROUP BY 1""")
def i10(spark, d):
    k = F.col("l_partkey")
    f = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("basin"), k.alias("id"), F.element_at(F.lit(["lake", "reservoir", "barrier", "glacier"]), (k % 4 + 1).cast("int")).alias("kind"), F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("storage"), F.year("l_shipdate").alias("year"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("distance"))
    # of equal distances any row is the same id's: line numbers may repeat
    f = f.groupBy("basin", "id", "distance").agg(F.max(F.struct("kind", "area", "storage", "year")).alias("x")).select("basin", "id", "distance", "x.*")
    return B.upstream_rollup(f, "basin", "id")


TAGS = [
    {"waterway": "dam"}, {"waterway": "weir", "operator": "EDF Nord"}, {"water": "reservoir"}, {"landuse": "reservoir", "name": "Lac"}, {"waterway": "canal"}, {"waterway": "pressurised"}, {"man_made": "pipeline", "usage": "headrace"}, {"man_made": "pipeline", "usage": "gas"},
    {"power": "plant", "plant:source": "Hydro", "operator": "edf"}, {"power": "plant", "generator:source": "solar"}, {"highway": "path"}, {}, {"power": "plant", "plant:source": "wind", "generator:source": "hydro"},
]
#: What each of the features above is, told by hand: kind counted (none: nothing), and whether the operator runs it.
TAG_KINDS = ["dams", "weirs", "reservoirs", "reservoirs", "canals", "penstocks", "penstocks", "", "plants", "", "", "", ""]
KINDS = ["dams", "weirs", "reservoirs", "canals", "penstocks", "plants"]


@query("i11_tag_rollup", "WITH t AS (SELECT user_id * 3 + event_id % 3 AS basin, (props::JSON ->> 'k')::INT % 13 AS k FROM events WHERE event_id % 3 < 3), c AS (SELECT basin, " + ", ".join(f"count(*) FILTER (k IN ({', '.join(str(i) for i, x in enumerate(TAG_KINDS) if x == n)})) AS {n}" for n in KINDS) + ", count(*) FILTER (k IN (1, 8)) AS operated FROM t GROUP BY 1), l AS (SELECT *, " + " + ".join(KINDS) + " > 0 AS present, dams + weirs > 0 AND penstocks + plants > 0 AS likely_scheme FROM c) SELECT *, CASE WHEN likely_scheme OR plants > 0 AND operated > 0 THEN 'high' WHEN present THEN 'medium' ELSE 'none' END AS confidence FROM l".replace(" WHERE event_id % 3 < 3", ""))
def i11(spark, d):
    maps = F.array(*[F.create_map(*[F.lit(x) for kv in t.items() for x in kv]) if t else F.create_map().cast("map<string,string>") for t in TAGS])
    t = table(spark, d, "events").select((F.col("user_id") * 3 + F.col("event_id") % 3).alias("basin"), F.element_at(maps, F.get_json_object("props", "$.k").cast("int") % 13 + 1).alias("tags"))
    return B.tag_rollup(t, "basin")


WORKS = {"dor_percent": "CASE WHEN p_partkey % 4 > 0 THEN p_size * 3.0 END", "reservoir_fraction": "(p_partkey % 9) / 20.0", "gdw_storage": "CASE WHEN p_partkey % 5 > 1 THEN p_retailprice * 7 END", "lake_storage": "p_size * 1.5", "gdw_distance": "CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 37 + 0.5 END", "lake_distance": "CASE WHEN p_partkey % 7 > 2 THEN p_size + 0.25 END", "gdw_plants": "p_partkey % 2", "gdw_barriers": "p_partkey % 3", "gdw_reservoirs": "CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 4 END", "lake_dams": "p_size % 4", "lake_reservoirs": "0", "osm_plants": "p_size % 2", "osm_dams": "p_size % 3", "osm_reservoirs": "p_partkey % 2", "osm_weirs": "p_size % 2", "osm_canals": "p_partkey % 6 // 5", "osm_penstocks": "p_partkey % 11 // 4", "stream_km": "CASE WHEN p_partkey % 4 > 1 THEN p_size * 2.0 END", "area_km2": "p_partkey % 10"}


@query("i12_severity", "WITH p AS (SELECT p_partkey AS id, " + ", ".join(f"({v if 'CASE' in v else v})::DOUBLE AS {k}" for k, v in WORKS.items()) + """ FROM (SELECT *, p_partkey % 10 AS x FROM part) WHERE true), z AS (SELECT id, CASE WHEN dor_percent IS NULL THEN 0 ELSE least(1, dor_percent / 100) END AS degree, reservoir_fraction, coalesce(gdw_storage, 0) AS gs, lake_storage AS ls, least(gdw_distance, lake_distance) AS near, gdw_plants + osm_plants AS hydro, gdw_barriers + osm_dams AS barrier, coalesce(gdw_reservoirs, 0) + lake_reservoirs + osm_reservoirs AS reservoir, osm_weirs + osm_canals + osm_penstocks AS diversion, greatest(gdw_barriers, lake_dams, osm_dams) AS works, osm_canals, osm_penstocks, coalesce(stream_km, 0) AS stream_km, area_km2 FROM p),
  s AS (SELECT *, least(1, 0.35 * degree + 0.25 * least(1, ln(1 + greatest(gs, ls)) / ln(10001)) + 0.2 * least(1, (works + reservoir + diversion) / 8) + 0.2 * CASE WHEN near IS NULL THEN 0 ELSE 1 - least(1, near / 20) END) AS sev, greatest(hydro, barrier, reservoir, diversion) AS top FROM z)
  SELECT id, round(near, 6) AS nearest_km, round(nullif(greatest(degree, reservoir_fraction), 0), 6) AS regulated_fraction, CASE WHEN top = 0 THEN 'none' WHEN (hydro = top)::INT + (barrier = top)::INT + (reservoir = top)::INT + (diversion = top)::INT > 1 THEN 'mixed' WHEN hydro = top THEN 'hydropower' WHEN barrier = top THEN 'barrier' WHEN reservoir = top THEN 'reservoir' ELSE 'diversion' END AS dominant,
    osm_canals > 0 OR osm_penstocks > 1 AS transfer_likely, CASE WHEN stream_km > 0 THEN round(diversion / stream_km, 6) WHEN area_km2 > 0 THEN round(diversion / area_km2, 6) END AS intake_density, greatest(hydro + osm_penstocks - 1, 0)::BIGINT AS cascade, round(nullif(sev, 0), 6) AS severity FROM s""".replace("(SELECT *, p_partkey % 10 AS x FROM part) WHERE true", "part"))
def i12(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[F.expr(v.replace("//", "div")).cast("double").alias(k) for k, v in WORKS.items()])
    return B.regulation_severity(p).drop(*WORKS)


KARST = {"carbonate": "CASE WHEN p_partkey % 5 > 1 THEN p_partkey % 11 / 103e-1 END", "karst": "CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 / 2e0 END", "infiltration": "sqrt(p_size % 7) / 3", "shallow": "CASE WHEN p_size > 4 THEN sqrt(p_size % 5) / 21e-1 END", "depressions": "p_partkey % 23", "area": "p_size % 6", "drainage": "sqrt(p_partkey % 17)", "frequency": "sqrt(p_partkey % 13)"}


@query("i13_karst", "WITH k AS (SELECT p_partkey AS id, " + ", ".join(f"({v})::DOUBLE AS {k}" for k, v in KARST.items()) + """ FROM part), r AS (SELECT *, greatest(coalesce(carbonate, 0), coalesce(karst, 0)) AS rock FROM k), s AS (SELECT *, CASE WHEN area > 0 THEN depressions / area * greatest(rock, 0.1) END AS holes, frequency * rock AS springs_ FROM r),
  l AS (SELECT *, least(1, 0.45 * rock + 0.2 * infiltration + 0.2 * coalesce(shallow, 0) + 0.15 * least(1, coalesce(holes, 0))) AS linked, carbonate IS NOT NULL OR karst IS NOT NULL AS known FROM s)
  SELECT id, CASE WHEN known THEN round(holes, 6) END AS sinkholes, CASE WHEN known THEN round(springs_, 6) END AS springs, CASE WHEN known THEN round(linked * (1 - least(1, drainage / 3)), 6) END AS losing, CASE WHEN known THEN round(linked * least(1, springs_ / 1.5), 6) END AS resurgence, CASE WHEN known THEN round(linked, 6) END AS connectivity FROM l""")
def i13(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), *[F.expr(v).cast("double").alias(k) for k, v in KARST.items()])
    return p.select("id", B.karst_proxies(*[F.col(k) for k in KARST]).alias("k")).select("id", "k.*")


RASTER = "raster AS (SELECT l_orderkey // 1000 AS basin, l_orderkey AS row, l_linenumber AS col, round(avg(l_extendedprice) / 20, 4) AS elevation, max(l_suppkey) AS code FROM lineitem GROUP BY 1, 2, 3)"


def raster(spark, d):
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").groupBy(F.expr("l_orderkey div 1000").alias("basin"), k.alias("row"), F.col("l_linenumber").alias("col")).agg(F.round(F.avg("l_extendedprice") / 20, 4).alias("elevation"), F.max("l_suppkey").alias("code"))


NEAR = "n AS (SELECT a.basin, a.row, a.col, a.elevation AS z, b.row - a.row AS dr, b.col - a.col AS dc, b.elevation AS nz FROM raster a JOIN raster b ON a.basin = b.basin AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND (a.row <> b.row OR a.col <> b.col))"


GRADIENT = "CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN ({a} - {b}) / 60 WHEN {a} IS NOT NULL THEN ({a} - z) / 30 WHEN {b} IS NOT NULL THEN (z - {b}) / 30 END"


@query("i14_neighbourhood", f"""WITH {RASTER}, {NEAR}, p AS (SELECT r.basin, r.row, r.col, any_value(r.elevation) AS z, count(nz) AS k, avg(abs(nz - r.elevation)) AS rug, min(nz - r.elevation) AS low, max(nz) FILTER (dr = 0 AND dc = 1) AS e, max(nz) FILTER (dr = 0 AND dc = -1) AS w, max(nz) FILTER (dr = 1 AND dc = 0) AS s, max(nz) FILTER (dr = -1 AND dc = 0) AS nn FROM raster r LEFT JOIN n ON n.basin = r.basin AND n.row = r.row AND n.col = r.col GROUP BY 1, 2, 3),
  g AS (SELECT *, {GRADIENT.format(a='e', b='w')} AS gx, {GRADIENT.format(a='s', b='nn')} AS gy FROM p), a AS (SELECT *, CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN (degrees(atan2(gx, -gy)) + 360) % 360 END AS a FROM g)
  SELECT basin, round(avg(rug), 4) AS ruggedness, round(avg(degrees(atan(sqrt(gx * gx + gy * gy)))), 4) AS slope, {SH('a >= 315 OR a < 45', 'a IS NOT NULL')} AS north, {SH('a >= 45 AND a < 135', 'a IS NOT NULL')} AS east, {SH('a >= 135 AND a < 225', 'a IS NOT NULL')} AS south, {SH('a >= 225 AND a < 315', 'a IS NOT NULL')} AS west, round(avg((e + w + s + nn - 4 * z) / 900), 6) AS curvature, count(*) FILTER (k = 8 AND low >= 2) AS depressions FROM a GROUP BY 1""")
def i14(spark, d):
    return B.neighbourhood_stats(raster(spark, d), "basin")


def slope_sql(c, place, line):
    w = f"OVER (PARTITION BY basin, {line} ORDER BY {place})"
    before, after = f"lag({place}) {w} = {place} - 1", f"lead({place}) {w} = {place} + 1"
    return f"CASE WHEN {before} AND {after} THEN (lead({c}) {w} - lag({c}) {w}) / 60 WHEN {after} THEN (lead({c}) {w} - {c}) / 30 WHEN {before} THEN ({c} - lag({c}) {w}) / 30 END"


@query("i14_curvatures", f"WITH {RASTER}, a AS (SELECT *, {slope_sql('elevation', 'col', 'row')} AS p, {slope_sql('elevation', 'row', 'col')} AS q FROM raster), b AS (SELECT *, {slope_sql('p', 'col', 'row')} AS r, {slope_sql('p', 'row', 'col')} AS s, {slope_sql('q', 'row', 'col')} AS t, p * p + q * q AS g FROM a) SELECT basin, round(avg((q * q * r - 2 * p * q * s + p * p * t) / (g * sqrt(1 + g))) FILTER (g > 1e-12), 6) AS plan_curvature, round(avg((p * p * r + 2 * p * q * s + q * q * t) / (g * pow(1 + g, 1.5))) FILTER (g > 1e-12), 6) AS profile_curvature FROM b GROUP BY 1")
def i14b(spark, d):
    return B.curvatures(raster(spark, d), "basin")


@query("i15_patches", f"""WITH RECURSIVE {RASTER}, c AS (SELECT basin, row, col, row * 100 + col AS id FROM raster WHERE code % 3 = 0), e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.basin = b.basin AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND a.id <> b.id),
  r AS (SELECT id, id AS z FROM c UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.z), p AS (SELECT id, min(z) AS patch FROM r GROUP BY 1), g AS (SELECT basin, patch, count(*) AS n FROM p JOIN c USING (id) GROUP BY 1, 2 HAVING count(*) >= 2)
  SELECT basin, count(*) AS patches, round(max(n) / sum(n)::DOUBLE, 6) AS largest_share FROM g GROUP BY 1""")
def i15(spark, d):
    return B.patches(raster(spark, d), "basin", F.col("code") % 3 == 0, 2)


@query("i16_stream_network", f"""WITH RECURSIVE {RASTER}, c AS (SELECT *, row * 100 + col AS id, code % 4 = 0 AS stream FROM raster), n AS (SELECT a.id, b.id AS down, b.elevation AS z, row_number() OVER (PARTITION BY a.id ORDER BY b.elevation, b.row, b.col) AS k FROM c a JOIN c b ON a.basin = b.basin AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND b.elevation < a.elevation),
  l AS (SELECT c.*, down FROM c LEFT JOIN n ON n.id = c.id AND k = 1), i AS (SELECT s.id, count(u.id) AS inflow FROM l s LEFT JOIN l u ON u.down = s.id AND u.stream WHERE s.stream GROUP BY 1),
  t AS (SELECT basin, count(*) AS stream_cells, count(*) FILTER (inflow = 0) AS sources, count(*) FILTER (inflow >= 2) AS junctions, count(*) FILTER (inflow <> 1) AS links FROM i JOIN l USING (id) GROUP BY 1),
  f AS (SELECT id, id AS at FROM l UNION ALL SELECT f.id, l.down FROM f JOIN l ON l.id = f.at WHERE NOT l.stream AND l.down IS NOT NULL), h AS (SELECT l.basin, greatest(0, l.elevation - b.elevation) AS hand FROM f JOIN l ON l.id = f.id JOIN l b ON b.id = f.at WHERE b.stream)
  SELECT t.*, round(a.m, 4) AS hand_mean, a.n AS drained_cells FROM t LEFT JOIN (SELECT basin, avg(hand) AS m, count(*) AS n FROM h GROUP BY 1) a USING (basin)""")
def i16(spark, d):
    return B.stream_network(B.downstream_links(raster(spark, d), "basin"), "basin", F.col("code") % 4 == 0)


DOWN = """c AS (SELECT *, row * 100 + col AS id FROM raster), n AS (SELECT a.id, b.id AS down, b.row - a.row AS dr, b.col - a.col AS dc, row_number() OVER (PARTITION BY a.id ORDER BY b.elevation, b.row, b.col) AS k FROM c a JOIN c b ON a.basin = b.basin AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 AND b.elevation < a.elevation),
  l AS (SELECT c.*, down, sqrt(dr * dr + dc * dc) AS step FROM c LEFT JOIN n ON n.id = c.id AND k = 1)"""
#: Strahler orders up to 5 of stream cells (basin, id, down): downstream of a junction of two cells of at least order k all are over k.
ORDERS = "o1 AS (SELECT id FROM st), " + ", ".join(f"o{k} AS (SELECT down AS id FROM (SELECT st.down FROM st JOIN o{k - 1} USING (id) WHERE st.down IN (SELECT id FROM st) GROUP BY 1 HAVING count(*) >= 2) UNION SELECT st.down FROM o{k} JOIN st USING (id) WHERE st.down IN (SELECT id FROM st))" for k in range(2, 6))
ORDER_OF = "CASE " + " ".join(f"WHEN id IN (SELECT id FROM o{k}) THEN {k}" for k in range(5, 1, -1)) + " ELSE 1 END"


@query("i16_strahler", f"WITH RECURSIVE {RASTER}, {DOWN}, st AS (SELECT * FROM l WHERE code % 4 <> 0), {ORDERS} SELECT basin, max({ORDER_OF})::INT AS strahler FROM st GROUP BY 1")
def i16b(spark, d):
    return B.strahler(B.downstream_links(raster(spark, d), "basin"), "basin", F.col("code") % 4 != 0)


UPSTREAM = "CASE WHEN code % 3 > 0 THEN (code % 60) / (1e2 + basin % 5 * 3e2) END"


@query("i16_network_metrics", f"""WITH RECURSIVE {RASTER}, {DOWN}, u AS (SELECT *, {UPSTREAM} AS up FROM l), b AS (SELECT basin, count(*) * 9e-4 AS km2, CASE WHEN max(up) >= 0.1 THEN 0.1 WHEN max(up) >= 0.05 THEN 0.05 WHEN max(up) >= 0.02 THEN 0.02 ELSE 0 END::DOUBLE AS threshold FROM u GROUP BY 1),
  st AS (SELECT u.*, threshold, km2 FROM u JOIN b USING (basin) WHERE up >= threshold), {ORDERS}, i AS (SELECT s.basin, s.id, s.step * 30 AS m, d.id IS NOT NULL AS flows, {ORDER_OF.replace('id IN', 's.id IN')} AS ord, (SELECT count(*) FROM st x WHERE x.down = s.id) AS inflow FROM st s LEFT JOIN st d ON d.id = s.down),
  p AS (SELECT basin, count(*) AS stream_cells, count(*) FILTER (flows) AS links, count(*) FILTER (CASE WHEN flows THEN inflow <> 1 ELSE inflow = 0 END) AS segments, count(*) FILTER (inflow >= 2) AS junctions, max(ord)::INT AS strahler, count(*) FILTER (inflow = 0) AS sources, sum(m) FILTER (flows) AS m, sum(m) FILTER (flows AND ord = 1) AS m1 FROM i GROUP BY 1)
  SELECT basin, threshold, coalesce(stream_cells, 0) AS stream_cells, coalesce(links, 0) AS links, coalesce(segments, 0) AS segments, coalesce(junctions, 0) AS junctions, strahler, round(sources / km2, 6) AS frequency, round(m / 1000 / km2, 6) AS density, CASE WHEN m > 0 THEN round(coalesce(m1, 0) / m, 6) END AS first_order_share, round(m / 1000, 6) AS length_km FROM b LEFT JOIN p USING (basin)""")
def i16c(spark, d):
    return B.network_metrics(B.downstream_links(raster(spark, d), "basin"), "basin", F.expr(UPSTREAM), 30.0, 9e-4)


TWI = "ln(greatest(greatest(area, 1e-6) * 1e6 / 30 / greatest(tan(radians(greatest(0.1, least(89, slope)))), 1e-6), 1e-6))"


@query("i17_topographic", f"WITH {CELLS}, h AS (SELECT *, clay * 3 + 1 AS area, CASE WHEN code <> 4 THEN elevation % 40 END AS hand, code = 2 AS stream FROM cells), w AS (SELECT *, {TWI} AS twi FROM h), t AS (SELECT basin, greatest(5, least(30, quantile_cont(hand, 0.2))) AS floor FROM h GROUP BY 1) SELECT basin, round((avg(elevation) - min(elevation)) / (max(elevation) - min(elevation)), 6) AS hypsometric, round(avg(twi), 6) AS twi_mean, round(quantile_cont(twi, 0.9), 6) AS twi_p90, round(avg(hand), 3) AS hand_mean, round(quantile_cont(hand, 0.5), 3) AS hand_median, round(quantile_cont(hand, 0.9), 3) AS hand_p90, CASE WHEN count(*) FILTER (hand <= floor) > 0 THEN round(greatest(0, 1 - count(*) FILTER (hand <= floor) / count(*)::DOUBLE), 6) END AS valley_confinement, CASE WHEN count(*) FILTER (hand <= floor) > 0 THEN round(count(*) FILTER (stream) / count(*) FILTER (hand <= floor)::DOUBLE, 6) END AS channel_confinement, " + ", ".join(f"round(quantile_cont(area, {p / 100}), 6) AS flow_p{p}" for p in (50, 90, 99)) + ", round(avg(sand / 100 - 1), 6) AS plan_curvature FROM w JOIN t USING (basin) GROUP BY 1")
def i17(spark, d):
    code = F.col("code")
    return B.topographic_indices(cells(spark, d), "basin", F.col("clay") * 3 + 1, F.when(code != 4, F.col("elevation") % 40), code == 2, 30.0, {"plan_curvature": F.col("sand") / 100 - 1})


@query("i20_response_times", f"WITH {CELLS}, p AS (SELECT basin, elevation, row * 1.5::DOUBLE AS path FROM cells), a AS (SELECT basin, max(path) AS l, arg_max(elevation, struct_pack(p := path, e := elevation)) AS top, min(elevation) AS low, max(elevation) AS high, count(*) * 0.0009::DOUBLE AS area FROM p GROUP BY 1), s AS (SELECT *, greatest(top - low, 0) / l AS s FROM a) SELECT basin, l AS longest_path, round(100 * s, 6) AS slope_percent, CASE WHEN s > 0 THEN round(0.01947 * pow(l, 0.77) * pow(s, -0.385), 6) END AS kirpich, CASE WHEN high > low THEN round((4 * sqrt(area) + 1.5 * l / 1000) / (0.8 * sqrt(high - low)) * 60, 6) END AS giandotti, round((high - low) / 1000 / sqrt(area), 6) AS melton, round((high - low) / l, 6) AS relief_ratio FROM s")
def i20(spark, d):
    return B.response_times(cells(spark, d).withColumn("path", F.col("row") * 1.5), "basin")


VERDICTS = ["good_proxy", "off_channel", "uncertain", "possible_proxy", "unknown"]


@query("i20_quality_score", f"SELECT p_partkey AS id, round(greatest(0, least(1, 1 - 0.7 * (p_size % 7) / 10.0 - least(p_partkey % 300 / 200.0 * 0.25, 0.25) - CASE WHEN p_size > 20 THEN 0.15 WHEN p_size > 10 THEN 0.08 ELSE 0 END - CASE {VERDICTS}[p_partkey % 5 + 1] WHEN 'off_channel' THEN 0.5 WHEN 'uncertain' THEN 0.2 WHEN 'possible_proxy' THEN 0.1 ELSE 0 END)), 6) AS score FROM part")
def i20b(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("id"), B.quality_score(s % 7 / 10, k % 300, s, F.element_at(F.lit(VERDICTS), (k % 5 + 1).cast("int"))).alias("score"))


def boxes(spark, d):
    s = F.col("size") / 100.0
    return cat(spark, d).select("id", (F.col("lon") - s).alias("west"), (F.col("lat") - s / 2).alias("south"), (F.col("lon") + s).alias("east"), (F.col("lat") + s / 2).alias("north"), (F.col("price") / 10).alias("area"))


@query("i2_box_morphology", f"WITH {CAT}, b AS (SELECT id, lon - size / 100.0::DOUBLE AS west, lat - size / 200.0::DOUBLE AS south, lon + size / 100.0::DOUBLE AS east, lat + size / 200.0::DOUBLE AS north, price / 10 AS area FROM cat), m AS (SELECT *, (east - west) * 111.32 * cos(radians((south + north) / 2)) AS w, (north - south) * 111.32 AS h FROM b) SELECT id, round(w, 6) AS width_km, round(h, 6) AS height_km, round(sqrt(w * w + h * h), 6) AS diagonal_km, round(2 * (w + h), 6) AS perimeter_km, round(2 * (w + h) / (2 * sqrt(pi() * area)), 6) AS compactness, round(4 * pi() * area / pow(2 * (w + h), 2), 6) AS circularity, round(2 * sqrt(area / pi()) / sqrt(w * w + h * h), 6) AS elongation, round(area / (w * w + h * h), 6) AS form_factor FROM m")
def i2(spark, d):
    return B.box_morphology(boxes(spark, d), F.col("area")).select("id", "width_km", "height_km", "diagonal_km", "perimeter_km", "compactness", "circularity", "elongation", "form_factor")


def ringed(spark, d):
    c = lambda x, y: F.array(F.col(x), F.col(y))
    return boxes(spark, d).select("id", "west", "south", "east", "north", F.array(c("west", "south"), c("east", "south"), c("east", "north"), c("west", "north")).alias("ring"))


@query("i1_weighted_cells", f"""WITH {CAT}, b AS (SELECT id, lon - size / 100.0::DOUBLE AS w, lat - size / 200.0::DOUBLE AS s, lon + size / 100.0::DOUBLE AS e, lat + size / 200.0::DOUBLE AS n FROM cat),
  x AS (SELECT *, unnest(generate_series(floor(w / 0.25 - 0.5)::BIGINT, ceil(e / 0.25 + 0.5)::BIGINT)) AS ix FROM b), y AS (SELECT *, unnest(generate_series(floor(s / 0.25 - 0.5)::BIGINT, ceil(n / 0.25 + 0.5)::BIGINT)) AS iy FROM x),
  a AS (SELECT id, ix, iy, greatest(0, least(e, (ix + 0.5) * 0.25) - greatest(w, (ix - 0.5) * 0.25)) * greatest(0, least(n, (iy + 0.5) * 0.25) - greatest(s, (iy - 0.5) * 0.25)) AS area FROM y), c AS (SELECT * FROM a WHERE area > 1e-12),
  v AS (SELECT *, area / sum(area) OVER (PARTITION BY id) AS v FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, ix, iy) AS k FROM v), t AS (SELECT * FROM k WHERE (v >= 0.005 AND k <= 64) OR k = 1)
  SELECT id, ix, iy, round(v / sum(v) OVER (PARTITION BY id), 6) AS weight FROM t""")
def i1(spark, d):
    return B.weighted_cells(ringed(spark, d), "id", "ring", 0.25)


@query("c17_overlay", f"WITH {CAT}, b AS (SELECT id, lon - size / 100.0::DOUBLE AS w, lat - size / 200.0::DOUBLE AS s, lon + size / 100.0::DOUBLE AS e, lat + size / 200.0::DOUBLE AS n FROM cat) , f AS (SELECT id, w - 9 AS w, s - 5 AS s, e + 9 AS e, n + 5 AS n FROM b) SELECT a.id AS bid, b.id AS fid, round((least(a.e, b.e) - greatest(a.w, b.w)) * (least(a.n, b.n) - greatest(a.s, b.s)), 9) AS area FROM b a, f b WHERE a.id % 2 = 0 AND b.id % 2 = 1 AND least(a.e, b.e) > greatest(a.w, b.w) AND least(a.n, b.n) > greatest(a.s, b.s)")
def c17(spark, d):
    r = ringed(spark, d)
    f = r.filter("id % 2 = 1").select(F.col("id").alias("fid"), (F.col("west") - 9).alias("x0"), (F.col("south") - 5).alias("y0"), (F.col("east") + 9).alias("x1"), (F.col("north") + 5).alias("y1"))
    return B.overlay_features(r.filter("id % 2 = 0").select(F.col("id").alias("bid"), "ring"), f, 4.0, 9)


#: Boxes that make up shapes: (west, south, east, north) in shares of a box's sides, and whether the box is added or taken away.
BASIN_SHAPE = [((0.0, 0.0, 1.0, 1.0), 1), ((0.4718281, 0.5314159, 1.0, 1.0), -1), ((0.1123581, 0.1301357, 0.3724681, 0.2902468), -1)]
FEATURE_SHAPE = [((0.0, 0.0, 0.3123457, 1.0), 1), ((0.4712345, 0.2309753, 1.0, 0.7108642), 1), ((0.5913579, 0.3724689, 0.8353971, 0.5346813), -1)]


def shaped(spark, d, basin: bool):
    """Basins as an L with a hole, turned the other way round; features as two polygons, the second with a hole."""
    r = ringed(spark, d).filter(F.col("id") % 2 == (0 if basin else 1))
    wide, high = (16.271828, 9.141593) if basin else (9.732051, 5.414214)
    r = r.withColumns({"west": F.col("west") - wide, "east": F.col("east") + wide, "south": F.col("south") - high, "north": F.col("north") + high})
    p = lambda x, y: F.array(F.col("west") + (F.col("east") - F.col("west")) * x, F.col("south") + (F.col("north") - F.col("south")) * y)
    ring = lambda *ps: F.array(*[p(x, y) for x, y in ps])
    box = lambda w, s, e, n: ring((w, s), (e, s), (e, n), (w, n), (w, s))
    if basin:
        shape = F.array(F.array(ring((0, 0), (0, 1), (BASIN_SHAPE[1][0][0], 1), BASIN_SHAPE[1][0][:2], (1, BASIN_SHAPE[1][0][1]), (1, 0)), box(*BASIN_SHAPE[2][0])))
    else:
        shape = F.array(F.array(box(*FEATURE_SHAPE[0][0])), F.array(box(*FEATURE_SHAPE[1][0]), box(*FEATURE_SHAPE[2][0])))
    return r.select(F.col("id").alias("bid" if basin else "fid"), shape.alias("polygons"))


def boxes_sql(shape, wide, high, odd):
    return " UNION ALL ".join(f"SELECT id, w0 + (e0 - w0) * {w}::DOUBLE AS w, s0 + (n0 - s0) * {s}::DOUBLE AS s, w0 + (e0 - w0) * {e}::DOUBLE AS e, s0 + (n0 - s0) * {n}::DOUBLE AS n, {k} AS k FROM (SELECT id, lon - size / 1e2 - {wide}::DOUBLE AS w0, lat - size / 2e2 - {high}::DOUBLE AS s0, lon + size / 1e2 + {wide}::DOUBLE AS e0, lat + size / 2e2 + {high}::DOUBLE AS n0 FROM cat WHERE id % 2 = {odd})" for (w, s, e, n), k in shape)


@query("c17_polygon_overlay", f"WITH {CAT}, b AS ({boxes_sql(BASIN_SHAPE, 16.271828, 9.141593, 0)}), f AS ({boxes_sql(FEATURE_SHAPE, 9.732051, 5.414214, 1)}), a AS (SELECT b.id AS bid, f.id AS fid, sum(b.k * f.k * greatest(0, least(b.e, f.e) - greatest(b.w, f.w)) * greatest(0, least(b.n, f.n) - greatest(b.s, f.s))) AS area FROM b, f WHERE b.w < f.e AND f.w < b.e AND b.s < f.n AND f.s < b.n GROUP BY 1, 2) SELECT bid, fid, round(area, 5) AS area FROM a WHERE area > 1e-6")
def c17b(spark, d):
    return B.overlay_polygons(shaped(spark, d, True), shaped(spark, d, False), 4.0, 1e-6, 5)


@query("i19_flatten_results", "SELECT o_custkey AS site, CASE WHEN count(*) > 0 THEN max(o_totalprice) END AS area, arg_max(o_orderstatus, struct_pack(p := o_totalprice, s := o_orderstatus)) AS verdict, CASE WHEN o_custkey % 2 = 0 THEN 'first_candidate' END AS reason FROM orders GROUP BY o_custkey")
def i19(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("site")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_totalprice").alias("area"), F.col("o_orderstatus").alias("verdict"))), asc=False).alias("candidates"))
    return B.flatten_results(o.withColumn("chosen", F.when(F.col("site") % 2 == 1, 0)), "site")


SHAPES = f"""{CAT}, b AS (SELECT id, lon - size / 100.0::DOUBLE AS w, lat - size / 200.0::DOUBLE AS s, lon + size / 100.0::DOUBLE AS e, lat + size / 200.0::DOUBLE AS n, CASE WHEN id % 7 > 0 THEN price / 10 END AS a FROM cat),
  c AS (SELECT *, abs(radians(e - w) * 6371.0088 * cos(radians((s + n) / 2))) AS bw, abs(radians(n - s) * 6371.0088) AS bh, CASE WHEN id % 3 > 0 THEN 2 * abs(radians(e - w) * 6371.0088 * cos(radians((3 * s + 2 * n) / 5))) + 2 * abs(radians(n - s) * 6371.0088) ELSE 0 END AS p FROM b), m AS (SELECT *, greatest(bw, bh) AS l FROM c),
  shapes AS (SELECT id, a, p > 0 AS has_geometry, CASE WHEN p > 0 THEN round(p, 6) END AS perimeter_km, CASE WHEN p > 0 AND a > 0 THEN round(p / (2 * sqrt(pi() * a)), 6) END AS compactness, CASE WHEN p > 0 AND a > 0 THEN round(4 * pi() * a / (p * p), 6) END AS circularity, round(bw, 6) AS bbox_width_km, round(bh, 6) AS bbox_height_km, round(sqrt(bw * bw + bh * bh), 6) AS bbox_diagonal_km, round(bw * bh, 6) AS bbox_area_km2,
    CASE WHEN bw * bh > 0 THEN round(a / (bw * bh), 6) END AS area_to_bbox, CASE WHEN a IS NOT NULL AND l > 0 THEN round(l, 6) END AS length_proxy_km, CASE WHEN l > 0 THEN round(a / l, 6) END AS width_proxy_km, CASE WHEN l > 0 AND a > 0 THEN round(l / (a / l), 6) END AS elongation, CASE WHEN l > 0 THEN round(a / (l * l), 6) END AS form_factor, CASE WHEN l > 0 AND a > 0 THEN round(l * l / a, 6) END AS shape_factor, CASE WHEN p > 0 THEN 4 END AS vertex_count FROM m)"""


def shapes(spark, d):
    c = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(c("west", "south"), c("east", "south"), c("east", "north"), c("west", "north"), c("west", "south"))
    rows = boxes(spark, d).withColumn("area", F.when(F.col("id") % 7 > 0, F.col("area")))
    return B.shape_morphology(rows, F.col("area"), F.when(F.col("id") % 3 > 0, F.array(ring))).drop("west", "south", "east", "north")


# where a box shrinks to a line at a pole, its area and what is divided by it are noise
@query("i2_shape_morphology", f"WITH {SHAPES} SELECT * EXCLUDE (a) REPLACE (CASE WHEN bbox_width_km > 0.001 THEN area_to_bbox END AS area_to_bbox) FROM shapes")
def i2b(spark, d):
    return shapes(spark, d).drop("area").withColumn("area_to_bbox", F.when(F.col("bbox_width_km") > 0.001, F.col("area_to_bbox")))


@query("i3_response_proxies", f"WITH {SHAPES}, r AS (SELECT *, CASE WHEN id % 11 > 0 THEN (id % 900)::DOUBLE END AS r FROM shapes) SELECT id, r AS relief_m, round(r / nullif(length_proxy_km, 0), 6) AS relief_per_length, round(r / nullif(bbox_diagonal_km, 0), 6) AS relief_per_diagonal, round(r / (length_proxy_km * 1000) * 100, 6) AS slope_percent, round(r / (bbox_diagonal_km * 1000) * 100, 6) AS slope_diagonal_percent, CASE WHEN a > 0 THEN round(r / a, 6) END AS relief_per_area, CASE WHEN r > 0 THEN round(0.01947 * pow(length_proxy_km * 1000, 0.77) * pow(r / (length_proxy_km * 1000), -0.385), 6) END AS kirpich_minutes, CASE WHEN a > 0 THEN round(circularity * (r / (length_proxy_km * 1000)) / sqrt(a), 8) END AS flashiness, round(elongation * (r / (length_proxy_km * 1000)), 8) AS shape_relief FROM r")
def i3(spark, d):
    k = F.col("id")
    out = B.response_proxies(shapes(spark, d), F.when(k % 11 > 0, k % 900), F.col("area"))
    return out.select("id", "relief_m", "relief_per_length", "relief_per_diagonal", "slope_percent", "slope_diagonal_percent", "relief_per_area", "kirpich_minutes", "flashiness", "shape_relief")


@query("i3_relief_of_cells", f"WITH {CELLS}, a AS (SELECT basin, max(elevation) - min(elevation) AS relief, count(*) * 0.0009::DOUBLE AS area FROM cells GROUP BY 1) SELECT basin, round(relief / 1000 / sqrt(area), 6) AS relief_ratio, round(0.01947 * pow(1000 * sqrt(2 * area), 0.77) * pow(greatest(relief / (1000 * sqrt(2 * area)), 1e-4), -0.385), 4) AS kirpich FROM a")
def i3b(spark, d):
    a = cells(spark, d).groupBy("basin").agg((F.max("elevation") - F.min("elevation")).alias("relief"), (F.count("*") * F.lit(0.0009)).alias("area"))
    length = 1000 * F.sqrt(2 * F.col("area"))
    return a.select("basin", F.round(F.col("relief") / 1000 / F.sqrt("area"), 6).alias("relief_ratio"), F.round(0.01947 * F.pow(length, F.lit(0.77)) * F.pow(F.greatest(F.col("relief") / length, F.lit(1e-4)), F.lit(-0.385)), 4).alias("kirpich"))

