"""Formulas against values worked out by hand or by plain loops, where SQL would only repeat the operator."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from flowfeat.functions import text
from flowfeat.operators import basin, catalog, evaluate


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize(
    "said, want",
    [("v3a2III", (3, 2, 3)), (" V 4 / A 2 / X ", (4, 2, 10)), ("V4/A2/ix", (4, 2, 9)), ("a2", (None,) * 3), ("see v3 there", (None,) * 3), ("v3a2III and more", (None,) * 3), ("v9a2IIX", (9, 2, None)), ("v12a7 vi", (12, 7, 6)), (None, (None,) * 3), ("", (None,) * 3), ("v99999999999a1I", (None, 1, 1))],
)
def test_cotation_wants_the_whole_form(spark, said, want):
    assert tuple(one(spark, c=text.parse_cotation(F.lit(said).cast("string")))["c"]) == want


@pytest.mark.parametrize(
    "said, level, raw",
    [
        ('Wasserstand: "Sehr hoch"', "Crazy", "Sehr hoch"),
        ('nice tour, low water. WASSERSTAND:   " dc+ " and more', "High", "dc+"),
        ("Water level: dry; all fine", "Dry", "dry"),
        ("water  level:\tDC-, cold", "Low", "DC-"),
        ('Waterlevel: "DC" ', "Normal", "DC"),
        ("Water level: niedrig - mittel.", "Low", "niedrig - mittel"),
        ("Water level: unheard of", None, "unheard of"),
        ("Water level: ???", None, "???"),
        ("low water, crue", None, None),
        ("Water level: high flood", "Crazy", "high flood"),
        ("Water level: très sèc", "Dry", "très sèc"),
        (None, None, None),
        ("", None, None),
    ],
)
def test_only_a_quoted_level_counts(spark, said, level, raw):
    assert tuple(one(spark, c=text.infer_level_from_text(F.lit(said).cast("string")))["c"]) == (level, raw)


def test_relevance_ladder(spark):
    rows = [("alto rio", "alto rio nord", "alto rio nord es", "alto rio", 800), ("rio", "rio alto", "rio alto es", "rio alto", 750), ("alto rio sur", "x", "x", "alto rio", 700), ("el alto rio", "x", "x", "alto rio", 650), ("rio grande alto", "x", "x", "alto rio", 600), ("rio grande", "x", "x", "grande", 650), ("x", "alto rio", "y", "alto", 550), ("x", "el alto", "y", "alto", 500), ("x", "rio del alto", "y", "alto rio", 450), ("x", "y", "in the alto rio", "alto rio", 300), ("x", "y", "rio then alto", "alto rio", 200), ("x", "y", "z", " ", 0)]
    for name, full, any_text, query, score in rows:
        assert one(spark, s=catalog.relevance(F.lit(name), F.lit(full), F.lit(any_text), query))["s"] == score, (name, query)
    items = spark.createDataFrame([(1, 200, 3.0, 5, "b"), (2, 200, None, 9, "a"), (3, 300, None, 0, "c"), (4, 200, 3.0, 5, "A"), (5, 200, 3.0, 7, "z")], "id int, score int, interest double, votes int, name string")
    best = [r["id"] for r in catalog.by_relevance(items, "score", "interest", "votes", "name", "id").collect()]
    assert best == [3, 5, 1, 4, 2]
    assert [r["id"] for r in catalog.by_relevance(items, "score", "interest", "votes", "name", "id", ascending=True).collect()] == best[::-1]
    assert [r["id"] for r in catalog.by_relevance(items, "score", "interest", "votes", "name", "id", 2).collect()] == best[:2]


SWEEP = "threshold double, precision_high double, recall_high double, f1_high double, balanced_accuracy double"


def test_policies_pick_even_where_no_threshold_meets_the_floor(spark):
    low = spark.createDataFrame([(0.1, 0.1, 0.3, 0.15, 0.4), (0.2, 0.2, 0.2, 0.2, 0.4), (0.3, 0.2, 0.25, 0.2, 0.3)], SWEEP)
    got = {p: evaluate.pick_threshold(low, p).first() for p in ("balanced", "prudent", "safety_first")}
    assert {p: (r["threshold"], r["met_floor"]) for p, r in got.items()} == {"balanced": (0.2, True), "prudent": (0.3, False), "safety_first": (0.1, False)}
    met = spark.createDataFrame([(0.1, 0.24, 0.9, 0.4, 0.6), (0.2, 0.25, 0.5, 0.3, 0.6), (0.3, 0.5, 0.4, 0.4, 0.6), (0.4, 0.9, 0.39, 0.4, 0.7)], SWEEP)
    assert evaluate.pick_threshold(met, "prudent").first()["threshold"] == 0.3
    assert evaluate.pick_threshold(met, "safety_first").first()["threshold"] == 0.2
    ties = spark.createDataFrame([(0.1, 0.5, 0.4, 0.4, 0.6), (0.2, 0.5, 0.45, 0.4, 0.6), (0.3, 0.5, 0.45, 0.4, 0.6)], SWEEP)
    assert evaluate.pick_threshold(ties).first()["threshold"] == 0.2
    by = met.withColumn("k", F.lit("a")).union(low.withColumn("k", F.lit("b")))
    assert {r["k"]: r["threshold"] for r in evaluate.pick_threshold(by, "prudent", ["k"]).collect()} == {"a": 0.3, "b": 0.3}
    pairs = spark.createDataFrame([(0.5, 2.2, 0.5, 0.5, 0.5, 0.5), (1.4, 2.5, 0.5, 0.5, 0.5, 0.5), (1.6, 2.3, 0.5, 0.5, 0.5, 0.5), (2.0, 4.0, 0.5, 0.5, 0.5, 0.5)], "low double, high double, precision_high double, recall_high double, f1_high double, balanced_accuracy double")
    pick = {p: evaluate.pick_pair(pairs, p).first() for p in ("balanced", "prudent", "safety_first")}
    assert {p: (r["low"], r["high"]) for p, r in pick.items()} == {"balanced": (1.4, 2.5), "prudent": (2.0, 4.0), "safety_first": (0.5, 2.2)}


def test_rare_class_and_gap(spark):
    pred = spark.createDataFrame([(i, "g", 5, 5 - i * 0.5, i < 3) for i in range(30)] + [(99, "g", 2, 9.0, True)], "id int, grp string, rank int, score double, ok boolean")
    error = F.col("score") - F.col("rank")
    assert tuple(evaluate.rare_class_report(pred, F.col("rank") == 5, F.col("ok"), error, "grp").first()) == ("g", 30, 27, 26)
    assert [r["id"] for r in evaluate.rare_class_worst(pred, F.col("rank") == 5, error, "id").collect()] == list(range(29, 9, -1))
    runs = spark.createDataFrame([("full", "temporal", 0.6), ("full", "cold", 0.42), ("few", "cold", 0.9)], "run string, split string, f1_high double")
    gap = evaluate.split_gap(runs, F.col("run") == "full", F.col("split") == "temporal", F.col("split") == "cold")
    assert tuple(gap.first()) == (0.6, 0.42, 0.18)
    assert evaluate.split_gap(runs, F.col("run") == "few", F.col("split") == "temporal", F.col("split") == "cold").count() == 0


def test_climate_by_a_plain_loop(spark):
    temp = [-25.0, -3.0, -1.0, 1.0, 5.0, 12.0, 18.0, 17.0, 11.0, 3.0, 0.0, -2.0]
    rain = [10.0 * (m + 1) for m in range(12)]
    rows = [("n", m + 1, rain[m], temp[m], temp[m] - 4, temp[m] + 6) for m in range(12)]
    got = basin.climate_summary(spark.createDataFrame(rows, "basin string, month int, precipitation double, temp double, tmin double, tmax double"), "basin", F.lit(45.0)).first()
    pet = snow = 0.0
    for m, (mid, days) in enumerate(zip([15, 45, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349], [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])):
        angle = 2 * math.pi / 365 * mid
        tilt, dist, phi = 0.409 * math.sin(angle - 1.39), 1 + 0.033 * math.cos(angle), math.radians(45)
        sunset = math.acos(-math.tan(phi) * math.tan(tilt))
        ra = 24 * 60 / math.pi * 0.082 * dist * (sunset * math.sin(phi) * math.sin(tilt) + math.cos(phi) * math.cos(tilt) * math.sin(sunset)) * 0.408
        pet += 0 if temp[m] <= -20 else max(0, 0.0023 * ra * (temp[m] + 17.8) * math.sqrt(10)) * days
        snow += rain[m] * min(1, max(0, (2 - temp[m]) / 4))
    want = {"annual": 780.0, "seasonality": statistics.pstdev(rain) / 65, "mean_temp": 3.0, "winter_temp": -10.0, "continentality": 43.0, "oceanicity": 1 / 44, "pet": pet, "aridity": 780 / pet, "snow_share": snow / 780}
    assert {k: got[k] for k in want} == pytest.approx(want, abs=6e-4)
    assert basin.climate_summary(spark.createDataFrame(rows, "basin string, month int, precipitation double, temp double, tmin double, tmax double"), "basin", F.lit(-45.0)).first()["winter_temp"] == pytest.approx((12 + 18 + 17) / 3, abs=1e-3)


def test_schemes_need_a_dam_or_weir_and_a_penstock_or_plant(spark):
    t = lambda b, **k: (b, {x.replace("_source", ":source"): v for x, v in k.items()})
    rows = [t("intake", man_made="intake"), t("dam", waterway="dam"), t("scheme", waterway="weir"), t("scheme", man_made="pipeline", usage="headrace"), t("plant", power="plant", plant_source="HYDRO", operator="EDF Hydro"), t("other", power="plant", plant_source="hydro"), t("canal", waterway="canal"), t("canal", landuse="reservoir"), t("pipe", man_made="pipeline", usage="gas")]
    got = {r["basin"]: r for r in basin.tag_rollup(spark.createDataFrame([*rows, ("none", None)], "basin string, tags map<string,string>"), "basin").collect()}
    assert {b: (r["likely_scheme"], r["confidence"]) for b, r in got.items()} == {"intake": (False, "none"), "dam": (False, "medium"), "scheme": (True, "high"), "plant": (False, "high"), "other": (False, "medium"), "canal": (False, "medium"), "pipe": (False, "none"), "none": (False, "none")}
    assert (got["canal"]["canals"], got["canal"]["reservoirs"], got["plant"]["operated"]) == (1, 1, 1)


WORKS = ["dor_percent", "reservoir_fraction", "gdw_storage", "lake_storage", "gdw_distance", "lake_distance", "gdw_plants", "gdw_barriers", "gdw_reservoirs", "lake_dams", "lake_reservoirs", "osm_plants", "osm_dams", "osm_reservoirs", "osm_weirs", "osm_canals", "osm_penstocks", "stream_km", "area_km2"]


@pytest.mark.parametrize(
    "known, want",
    [
        ({}, (None, None, "none", False, None, 0, None)),
        ({"dor_percent": 50.0, "gdw_storage": 100.0, "gdw_barriers": 2.0, "gdw_distance": 5.0, "area_km2": 10.0}, (5.0, 0.5, "barrier", False, 0.0, 0, round(0.175 + 0.25 * math.log(101) / math.log(10_001) + 0.05 + 0.15, 6))),
        ({"osm_weirs": 2.0, "gdw_plants": 2.0, "stream_km": 4.0}, (None, None, "mixed", False, 0.5, 1, 0.05)),
        ({"osm_penstocks": 2.0, "osm_plants": 1.0, "area_km2": 4.0, "lake_distance": 30.0}, (30.0, None, "diversion", True, 0.5, 2, 0.05)),
        ({"lake_reservoirs": 9.0, "dor_percent": 400.0, "lake_storage": 1e9, "lake_distance": 0.0, "osm_dams": 3.0}, (0.0, 1.0, "reservoir", False, None, 0, 1.0)),
    ],
)
def test_severity(spark, known, want):
    row = spark.createDataFrame([tuple(known.get(w) for w in WORKS)], ", ".join(f"{w} double" for w in WORKS))
    r = basin.regulation_severity(row).first()
    assert tuple(r[c] for c in ("nearest_km", "regulated_fraction", "dominant", "transfer_likely", "intake_density", "cascade", "severity")) == want


def test_karst(spark):
    lit = lambda *v: [F.lit(x).cast("double") for x in v]
    got = one(spark, k=basin.karst_proxies(*lit(0.5, 0.4, 0.25, 0.5, 3, 6, 1.5, 0.6)))["k"]
    linked = 0.45 * 0.5 + 0.2 * 0.25 + 0.2 * 0.5 + 0.15 * 0.25
    assert tuple(got) == pytest.approx((0.25, 0.3, linked * 0.5, linked * 0.2, linked), abs=1e-6)
    assert tuple(one(spark, k=basin.karst_proxies(*lit(None, None, 1, 1, 3, 6, 1, 1)))["k"]) == (None,) * 5
    assert one(spark, k=basin.karst_proxies(*lit(1, None, 1, 1, 99, 0, 9, 9)))["k"]["sinkholes"] is None


def test_quality_steps(spark):
    lit = F.lit
    score = lambda *a: one(spark, q=basin.quality_score(*map(lit, a)))["q"]
    assert score(0.0, 0.0, 5.0, "good_proxy") == 1.0
    assert score(0.0, 0.0, 25.0, "ok") == 0.85
    assert score(0.0, 0.0, 20.0, "unknown") == 0.92
    assert score(0.5, 100.0, 30.0, "off_channel") == 0.0
    assert score(0.1, 400.0, 10.0, "uncertain") == pytest.approx(1 - 0.07 - 0.25 - 0.2)
    assert score(0.0, 0.0, 1.0, "possible_proxy") == 0.9


def test_topographic_indices_of_one_basin(spark):
    cells = spark.createDataFrame([("b", float(e), 10.0, float(h) if h is not None else None, float(a), s) for e, h, a, s in ((100, 0, 9, True), (110, 2, 1, False), (140, 40, 2, False), (200, 90, 3, False), (150, None, 4, False))], "basin string, elevation double, slope double, h double, a double, s boolean")
    r = basin.topographic_indices(cells, "basin", F.col("a"), F.col("h"), F.col("s"), 30.0).first()
    twi = sorted(math.log(a * 1e6 / 30 / math.tan(math.radians(10))) for a in (9, 1, 2, 3, 4))
    assert r["hypsometric"] == 0.4 and r["twi_mean"] == pytest.approx(sum(twi) / 5, abs=1e-6) and r["twi_p90"] == pytest.approx(twi[3] + 0.6 * (twi[4] - twi[3]), abs=1e-6)
    assert (r["hand_mean"], r["hand_median"], r["hand_p90"]) == (33.0, 21.0, 75.0)
    assert (r["valley_confinement"], r["channel_confinement"]) == (0.6, 0.5)  # the 20th percentile is 1.2, so the floor reaches up to 5
    assert (r["flow_p50"], r["flow_p90"], r["flow_p99"]) == (3.0, 7.0, 8.8)


def test_response_times_of_one_basin(spark):
    cells = spark.createDataFrame([("b", 500.0, 0.0), ("b", 900.0, 2000.0), ("b", 1000.0, 1500.0), ("flat", 5.0, 100.0)], "basin string, elevation double, path double")
    got = {r["basin"]: r for r in basin.response_times(cells, "basin").collect()}
    area = 3 * 0.0009
    assert got["b"]["slope_percent"] == 20.0 and got["b"]["kirpich"] == pytest.approx(0.01947 * 2000**0.77 * 0.2**-0.385, abs=1e-6)
    assert got["b"]["giandotti"] == pytest.approx((4 * math.sqrt(area) + 3) / (0.8 * math.sqrt(500)) * 60, abs=1e-6)
    assert got["flat"]["kirpich"] is None and got["flat"]["giandotti"] is None


def test_network_of_a_small_tree(spark):
    # two sources meet, a third joins below; a lone cell; thresholds .1, then .05 and nothing where no area reaches them
    down = {(0, 0): (1, 1), (0, 2): (1, 1), (1, 1): (2, 1), (2, 0): (3, 1), (2, 1): (3, 1), (3, 1): None, (7, 7): None, (9, 9): (8, 8)}
    rows = [("t", r, c, d, 0.0 if (r, c) == (9, 9) else 0.1) for (r, c), d in down.items()] + [("half", 0, 0, (0, 1), 0.06), ("half", 0, 1, None, 0.06), ("none", 0, 0, None, 0.001), ("null", 0, 0, None, None)]
    links = spark.createDataFrame(rows, "basin string, row int, col int, down struct<row:int,col:int>, up double")
    got = {r["basin"]: r for r in basin.network_metrics(links, "basin", F.col("up"), 30.0, 0.5).collect()}
    t = got["t"]
    slant, straight = 30 * math.sqrt(2), 30.0
    assert (t["threshold"], t["stream_cells"], t["links"], t["segments"], t["junctions"], t["strahler"]) == (0.1, 7, 5, 5, 2, 2)
    total = 3 * slant + 2 * straight  # (0,0), (0,2), (2,0) go aslant, (1,1), (2,1) straight on
    assert t["length_km"] == pytest.approx(total / 1000, abs=1e-6) and t["first_order_share"] == pytest.approx(3 * slant / total, abs=1e-6)
    assert t["frequency"] == 4 / 4.0 and t["density"] == pytest.approx(total / 1000 / 4, abs=1e-6)
    assert got["half"]["threshold"] == 0.05 and (got["half"]["stream_cells"], got["half"]["segments"]) == (2, 1)
    assert got["none"]["threshold"] == 0.0 and (got["none"]["stream_cells"], got["none"]["segments"], got["none"]["length_km"]) == (1, 1, None)
    assert tuple(got["null"])[1:] == (0.0, 0, 0, 0, 0, None, None, None, None, None)


def clipped(rings_a, rings_b):
    """Common area of two polygons given as rings in even-odd sense: exact between all x at which an edge ends or two edges cross."""
    edges = lambda rings: [(p, q) if p[0] < q[0] else (q, p) for r in rings for p, q in zip(r, [*r[1:], r[0]]) if p[0] != q[0]]
    at = lambda e, x: e[0][1] + (e[1][1] - e[0][1]) * (x - e[0][0]) / (e[1][0] - e[0][0])
    ea, eb = edges(rings_a), edges(rings_b)
    xs = {p[0] for e in ea + eb for p in e}
    for e in ea:
        for f in eb:
            l, r = max(e[0][0], f[0][0]), min(e[1][0], f[1][0])
            if l < r and (at(e, l) - at(f, l)) * (at(e, r) - at(f, r)) < 0:
                d0, d1 = at(e, l) - at(f, l), at(e, r) - at(f, r)
                xs.add(l + (r - l) * d0 / (d0 - d1))
    total, xs = 0.0, sorted(xs)
    for l, r in zip(xs, xs[1:]):
        m = (l + r) / 2
        spans = [sorted(at(e, m) for e in es if e[0][0] < m < e[1][0]) for es in (ea, eb)]
        total += (r - l) * sum(max(0.0, min(a2, b2) - max(a1, b1)) for a1, a2 in zip(spans[0][::2], spans[0][1::2]) for b1, b2 in zip(spans[1][::2], spans[1][1::2]))
    return total


def test_overlay_of_concave_polygons_with_holes(spark):
    import random

    rng = random.Random(12)


    def polygon(cx, cy):
        outer = [[cx + s * math.cos(t), cy + s * math.sin(t)] for k in range(11) for t, s in [(2 * math.pi * k / 11, rng.uniform(1.5, 4))]]
        hole = [[cx + 0.6 * math.cos(t), cy + 0.5 * math.sin(t)] for t in (5, 4, 3, 1.5, 0.2)]
        return [outer if rng.random() < 0.5 else outer[::-1], hole if rng.random() < 0.5 else hole[::-1]]

    shapes = [[[polygon(rng.uniform(-6, 6), rng.uniform(-6, 6)) for _ in range(1)] for _ in range(12)] for _ in range(2)]
    kind = "id int, polygons array<array<array<array<double>>>>"
    b, f = (spark.createDataFrame([(i, s) for i, s in enumerate(side)] + [(99, None), (98, []), (97, [[[[0.0, 0.0], [1.0, 1.0]]]])], kind).withColumnRenamed("id", n) for side, n in zip(shapes, ("bid", "fid")))
    got = {(r["bid"], r["fid"]): r["area"] for r in basin.overlay_polygons(b, f, 1.7).collect()}
    want = {(i, j): a for i, x in enumerate(shapes[0]) for j, y in enumerate(shapes[1]) if (a := clipped(x[0], y[0])) > 1e-9}
    assert set(got) == set(want) and len(want) > 40
    assert got == pytest.approx(want, abs=1e-9)


RULES = "array<struct<status:string,action:string,summary:string,remark:string,details:string>>"


@pytest.mark.parametrize(
    "rules, regulated, practical, interest, votes, want",
    [
        ([("Actif", "INTERDIT", None, None, None)], True, "v3", 3.0, 5, True),
        ([("abrogé", "interdit", None, None, None)], True, "v3", 3.0, 5, False),
        ([(None, "conseil", "Canyon", "interdit", "")], True, "v3", 3.0, 5, True),
        ([("indéfini", None, None, None, "La pratique du canyoning est interdite.")], True, "v3", 3.0, 5, True),
        ([("actif", "interdit partiel", None, None, None)], True, "v3", 3.0, 5, False),
        ([], True, " \n", None, None, True),
        ([], True, " \n", 2.0, 0, False),
        ([], True, " \n", -1.0, 0, True),
        ([], True, None, None, 1, False),
        (None, None, None, None, 0, False),
    ],
)
def test_forbidden(spark, rules, regulated, practical, interest, votes, want):
    row = spark.createDataFrame([(rules, regulated, practical, interest, votes)], f"rules {RULES}, regulated boolean, practical string, interest double, votes int")
    assert row.select(catalog.infer_forbidden(F.col("rules"), F.col("regulated"), [F.col("practical")], F.col("interest"), F.col("votes"))).first()[0] is want


def test_comment_with_exclusions(spark):
    c = lambda t: tuple(one(spark, c=text.comment_category(F.lit(t), ["eau", "debit"], ["parking", "route"]))["c"])
    assert c("Route barrée, travaux; beaucoup d'eau") == ("mixed", ["eau"], ["route"], ["road closed", "works"])
    assert c("Sans rapport avec le débit") == ("hydrology", ["debit"], [], ["explicit unrelated flow"])
    assert c("Accès interdit") == ("ambiguous", [], [], ["access closed", "forbidden"])
    assert c(" ! ") == ("empty", [], [], [])


def test_neighbourhood_of_a_plane_and_a_pit(spark):
    plane = [("plane", r, c, 100.0 + 30 * c) for r in range(3) for c in range(4)]  # rises to the east: every cell has a slope of 45 degrees
    pit = [("pit", r, c, 5.0 if (r, c) == (1, 1) else 7.0) for r in range(3) for c in range(3)]
    got = {r["b"]: r for r in basin.neighbourhood_stats(spark.createDataFrame([*plane, *pit, ("lone", 0, 0, 1.0), ("gap", 0, 0, 1.0), ("gap", 5, 1, 9.0)], "b string, row int, col int, elevation double"), "b").collect()}
    p = got["plane"]
    assert (p["slope"], p["north"], p["east"], p["south"], p["west"], p["curvature"], p["depressions"]) == (45.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0)
    assert got["pit"]["depressions"] == 1 and got["pit"]["curvature"] == pytest.approx(8 / 900, abs=1e-6)
    corner, side, middle = 2 / 3, 2 / 5, 2.0
    assert got["pit"]["ruggedness"] == pytest.approx((4 * corner / 1 * 1 + 4 * side + middle) / 9, abs=1e-4)
    assert got["lone"]["ruggedness"] is None and got["lone"]["slope"] is None and got["gap"]["ruggedness"] is None
