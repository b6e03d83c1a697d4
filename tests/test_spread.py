"""Hot keys: ranks, blocked windows, quantiles by group and capped merging on one key with all rows."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from flowfeat.operators import history, merge, profile, series, spread


def test_ranks_of_one_hot_key_come_from_several_tasks(spark):
    df = spark.range(5000).selectExpr("case when id % 50 = 0 then null else 'hot' end as k", "pmod(xxhash64(id), 700) as t", "id").repartition(7)
    got = spread.ranked(df, ["k"], ["t", "id"], parts=9).cache()
    for k in ("hot", None):
        rows = sorted([r for r in got.collect() if r["k"] == k], key=lambda r: (r["t"], r["id"]))
        assert [r["rank"] for r in rows] == list(range(len(rows)))
    placed = df.repartitionByRange(9, "k", "t", "id").filter("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert placed >= 8  # the hot key lies in nearly all parts
    assert spread.ranked(df.limit(0), ["k"], ["t"]).count() == 0
    whole = spread.ranked(df.drop("k"), [], ["id"], parts=5)
    assert whole.filter("rank <> id").count() == 0


def wet(spark, n=900):
    rng = random.Random(4)
    rows = [("hot", date(2000, 1, 1) + timedelta(days=2 * i), None if rng.random() < 0.1 else round(rng.uniform(-3, 12), 2)) for i in range(n)]
    rows += [(k, date(2001, 1, 1) + timedelta(days=i), float(i % 13)) for k in ("a", None) for i in range(20)]
    return spark.createDataFrame(rows, "target string, date date, v double").repartition(6)


def same(a, b):
    rows = lambda d: sorted(map(str, (tuple(r) for r in d.select(sorted(d.columns)).collect())))
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


@pytest.mark.parametrize("block", [31, 200])
def test_windows_over_blocks_are_those_over_whole_keys(spark, block):
    s = wet(spark)
    cut = {"most": 100, "block": block}
    rows, part = spread.in_blocks(s, ["target"], ["date"], 29, **cut)
    assert part == ["target", "__block"] and rows.filter("target = 'hot'").select("__block").distinct().count() >= 900 // block
    same(series.trailing_features(s, ["target"], "date", {"v": [2, 30]}, {"v": [7]}, **cut), series.trailing_features(s, ["target"], "date", {"v": [2, 30]}, {"v": [7]}))
    same(series.last_reach(s, ["target"], "date", "v", [5, 11], **cut), series.last_reach(s, ["target"], "date", "v", [5, 11]))
    same(series.decayed_sums(s, ["target"], "date", "v", {"api": 0.85}, 30, **cut), series.decayed_sums(s, ["target"], "date", "v", {"api": 0.85}, 30))
    same(series.availability(s, ["target"], "date", "v", **cut), series.availability(s, ["target"], "date", "v"))
    with pytest.raises(ValueError):
        spread.in_blocks(s, ["target"], ["date"], 40, block=40)
    assert series.trailing_features(s.limit(0), ["target"], "date", {"v": [3]}, **cut).count() == 0


def plain_quantile(xs, p):
    xs = sorted(xs)
    at = (len(xs) - 1) * p
    a, b = xs[math.floor(at)], xs[min(math.floor(at) + 1, len(xs) - 1)]
    return a + (at - math.floor(at)) * (b - a)


@pytest.mark.parametrize("listed, bins", [(4096, 256), (3, 4), (1, 2)])
def test_quantiles_of_groups_are_exact(spark, listed, bins):
    rng = random.Random(6)
    rows = [("hot", rng.choice([rng.gauss(0, 1e6), rng.random(), 7.0])) for _ in range(3000)] + [("few", x) for x in (3.0, 1.0, None, float("nan"))] + [("none", None), (None, 2.0), (None, 4.0), ("same", 5.0), ("same", 5.0), ("signs", -1e308), ("signs", 1e308)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.0, 0.2, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in spread.grouped_quantiles(df, ["g"], {"x": F.col("x"), "twice": F.col("x") / 2}, probs, bins, listed).collect()}
    assert set(got) == {"hot", "few", "none", None, "same", "signs"} and got["none"]["x"] is None
    for g in ("hot", "few", None, "same"):
        xs = [x for k, x in rows if k == g and x is not None and x == x]
        assert got[g]["x"] == pytest.approx([plain_quantile(xs, p) for p in probs], rel=1e-12)
        assert got[g]["twice"] == pytest.approx([plain_quantile(xs, p) / 2 for p in probs], rel=1e-12)
    whole = spread.grouped_quantiles(df.filter("g = 'few'"), [], {"x": F.col("x")}, [0.5], bins, listed).collect()
    assert [r["x"] for r in whole] == [[2.0]]


def test_sketched_quantiles_keep_their_error(spark):
    df = spark.range(40_000).selectExpr("id % 2 as g", "double(pmod(xxhash64(id), 100003)) as x")
    for r in profile.sketched_quantiles(df, "x", ["g"]).collect():
        xs = sorted(v["x"] for v in df.filter(F.col("g") == r["g"]).collect())
        for p in profile.QUANTILES:
            q = r[f"p{int(p * 100):02d}"]
            below, upto = sum(x < q for x in xs) / len(xs), sum(x <= q for x in xs) / len(xs)
            assert below - 0.005 <= p <= upto + 0.005


def test_one_day_and_one_stratum_hold_all_rows(spark):
    day = spark.range(2000).selectExpr("id as observation_id", "date'2020-02-02' as date", "id % 7 as site", "2020 as year", "cast(null as string) as level").repartition(8)
    got = {r["observation_id"]: r["split"] for r in history.temporal_split(day, 0.2, 0.1).collect()}
    assert [got[i] for i in range(2000)] == ["train"] * 1400 + ["calibration"] * 200 + ["test"] * 400
    held = history.stratified_holdout(day, (F.pmod(F.xxhash64("observation_id"), F.lit(10**6)) / 10**6))
    rows = held.collect()
    assert 0 < len(rows) <= 40 and len({r["observation_id"] for r in rows}) == len(rows)
    assert "WindowGroupLimit" in held._jdf.queryExecution().toString()


def test_batches_run_on_over_years(spark):
    windows = spark.createDataFrame([(i, date(2019, 12, 1) + timedelta(days=7 * i)) for i in range(20)] + [(99, date(2019, 1, 1))], "id int, start date")
    done = spark.createDataFrame([(0,), (1,)], "id int")
    got = sorted((r["batch"], r["id"]) for r in merge.pending_windows(windows, done, "id", "start", 5).collect())
    assert got == sorted((k // 5, i) for k, i in enumerate([99, *range(2, 20)]))
    assert sorted(r["id"] for r in merge.pending_windows(windows, done, "id", "start", 5, limit=4).collect()) == [2, 3, 4, 99]


def plain_capped(ws, gap, span):
    out = []
    for s, e, i in sorted(ws):
        if out and s <= out[-1][1] + timedelta(days=gap) and (max(out[-1][1], e) - out[-1][0]).days <= span:
            out[-1] = (out[-1][0], max(out[-1][1], e), [*out[-1][2], i])
        else:
            out.append((s, e, [i]))
    return out


def test_capped_merging_is_the_plain_fold(spark):
    rng = random.Random(9)
    rows = []
    for k in range(120):
        for i in range(rng.randint(0, 25)):
            s = date(2020, 1, 1) + timedelta(days=rng.randint(0, rng.choice([10, 60, 300])))
            rows.append((None if k == 0 else k, k * 100 + i, s, s + timedelta(days=rng.choice([0, 1, rng.randint(0, 12), rng.randint(0, 40)]))))
    df = spark.createDataFrame(rows + [(1, 5000, None, date(2020, 1, 1)), (1, 5001, date(2020, 1, 1), None)], "k int, id int, start date, end date")
    for gap, span in ((0, 10), (3, 20), (15, 30), (1, 0)):
        got = sorted((str(r["k"]), r["start"], r["end"], r["ids"]) for r in series.merge_windows_capped(df, ["k"], gap, span, "id").collect())
        want = sorted((str(k), *w) for k in {r[0] for r in rows} for w in plain_capped([(s, e, i) for kk, i, s, e in rows if kk == k], gap, span))
        assert got == want


def test_a_chain_of_many_windows(spark):
    chain = spark.range(100_000).selectExpr("1 as k", "id", "date_add(date'1800-01-01', cast(id as int)) as start", "date_add(date'1800-01-01', cast(id + 3 as int)) as end")
    got = series.merge_windows_capped(chain, ["k"], 2, 9, "id").collect()
    assert len(got) == -(-100_000 // 7) and all(len(r["ids"]) == 7 for r in sorted(got, key=lambda r: r["start"])[:-1])


def test_conflicts_of_entries_are_those_of_all_pairs(spark):
    from flowfeat.operators.catalog import entry_conflicts

    rng = random.Random(8)
    parent = {s: {c: rng.randrange(c) if c else None for c in range(60)} for s in range(4)}
    rows = [(s, s * 1000 + i, rng.randrange(60), None if rng.random() < 0.1 else rng.uniform(1, 30), None if rng.random() < 0.1 else rng.uniform(0, 300)) for s in range(4) for i in range(40)]
    want = set()
    for s, i, c, a, h in rows:
        way = [c]
        while parent[s][way[-1]] is not None:
            way.append(parent[s][way[-1]])
        for t, j, d, b, g in rows:
            if s == t and i != j and a is not None and b is not None and d in way:
                want |= {(s, i, j, "area_order")} if a > 1.05 * b else set()
                want |= {(s, i, j, "elevation_order")} if h is not None and g is not None and h < g - 10 else set()
                want |= {(s, i, j, "same_cell")} if c == d and i < j else set()
    e = spark.createDataFrame(rows, "site int, id int, cell int, area double, elevation double")
    links = spark.createDataFrame([(s, c, p) for s, x in parent.items() for c, p in x.items()], "site int, cell int, to int")
    got = [tuple(r) for r in entry_conflicts(e, links, "site", "id", "cell", "area", "elevation").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert entry_conflicts(e.limit(0), links, "site", "id", "cell", "area", "elevation").count() == 0


def test_a_site_with_many_entries(spark):
    from flowfeat.operators.catalog import entry_conflicts

    n = 100_000  # one river of cells; areas grow downstream but for one entry
    e = spark.range(n).selectExpr("1 as site", "id", "id as cell", "case when id = 70 then 2.0 * id else double(1000 + (99999 - id)) end as area", "double(id) as elevation").withColumn("area", F.when(F.col("id") == 99_990, 1021.0).otherwise(F.col("area")))
    links = spark.range(n).selectExpr("1 as site", "id as cell", "case when id > 0 then id - 1 end as to")
    got = sorted((r["a"], r["b"], r["conflict"]) for r in entry_conflicts(e, links, "site", "id", "cell", "area", "elevation").collect())
    area = {i: 140.0 if i == 70 else 1021.0 if i == 99_990 else 1000.0 + 99_999 - i for i in range(n)}
    small = [(i, 70, "area_order") for i in range(71, n) if area[i] > 1.05 * 140]
    assert got == sorted(small + [(99_990, j, "area_order") for j in range(71, 99_990) if 1021.0 > 1.05 * area[j]])


def test_a_box_that_meets_another_by_next_to_nothing_has_area(spark):
    import math

    from flowfeat.operators.basin import overlay_features

    b = spark.createDataFrame([(1, [[0.0, 10.0], [4.0, 10.0], [4.0, 20.0], [0.0, 20.0]])], "bid long, ring array<array<double>>")
    f = spark.createDataFrame([(2, 1.0, -80.0, 3.0, math.nextafter(10.0, 11.0)), (3, 1.0, -80.0, 3.0, 10.0), (4, -9.0, 12.0, 1.0, 15.0)], "fid long, x0 double, y0 double, x1 double, y1 double")
    got = {r["fid"]: r["area"] for r in overlay_features(b, f, 4.0).collect()}
    assert set(got) == {2, 4} and 0 < got[2] < 1e-14 and got[4] == 3.0


def test_few_rows_that_make_many_are_dealt_over_tasks(spark):
    from flowfeat.operators.basin import overlay_features, weighted_cells
    from flowfeat.operators.catalog import near_pairs

    p = spark.range(200).coalesce(1).select("id", (F.col("id") * 37 % 160 - 80.0).alias("lat"), (F.col("id") * 53 % 340 - 170.0).alias("lon"))
    corner = lambda x, y: F.array(F.col("lon") + x, F.col("lat") + y)
    rings = p.select("id", F.array(corner(0, 0), corner(3, 0), corner(3, 2), corner(0, 2)).alias("ring"))
    boxes = p.select(F.col("id").alias("fid"), F.col("lon").alias("x0"), F.col("lat").alias("y0"), (F.col("lon") + 2).alias("x1"), (F.col("lat") + 2).alias("y1"))
    for out in (near_pairs(p, p, 900.0, "id"), weighted_cells(rings, "id", "ring", 0.5), overlay_features(rings.withColumnRenamed("id", "bid"), boxes, 4.0)):
        assert out.select(F.spark_partition_id().alias("t")).distinct().count() > 1


def test_many_lines_are_told_apart_by_sorting(spark):
    import time

    from flowfeat.functions.text import unique_non_blank

    lines = [f"Line  {i}" for i in range(8_000)] + ["b", "A", " a ", "", None, "B"] + [f"line {i}" for i in range(8_000)]
    df = spark.createDataFrame([(lines,), ([],), (None,), (["", None],)], "items array<string>")
    start = time.time()
    got = [r["u"] for r in df.select(unique_non_blank(F.col("items")).alias("u")).collect()]
    assert got == [[f"Line {i}" for i in range(8_000)] + ["b", "A"], [], None, []]
    assert time.time() - start < 30  # a search in all lines for each takes minutes


def test_forests_read_their_rows_once(spark):
    from flowfeat.operators.evaluate import fit_and_score

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    rows = spark.range(300).select((F.col("id") % 7).cast("double").alias("x"), F.element_at(F.array(*map(F.lit, ("LOW", "MEDIUM", "HIGH"))), (F.col("id") % 3 + 1).cast("int")).alias("bucket"))
    rows = rows.mapInPandas(counted, rows.schema)
    assert fit_and_score(rows, rows.limit(10), {"weather": ["x"], "physical": ["x"]}, "bucket", ["weather_only", "physical_only"], 2, 2).count() == 2
    assert 300 <= read.value <= 600


def test_a_cell_with_many_entries_is_paired_in_blocks(spark, monkeypatch):
    from flowfeat.operators import catalog

    monkeypatch.setattr(catalog, "PAIRED", 5)
    e = spark.range(60).coalesce(1).select(F.lit(1).alias("site"), F.col("id"), (F.col("id") % 2).alias("cell"), (F.col("id") * 7 % 50 + 50.0).alias("area"), (F.col("id") * 11 % 60 + 0.0).alias("elevation"))
    links = spark.createDataFrame([(1, 1, 0), (1, 0, None)], "site int, cell long, to long")
    out = catalog.entry_conflicts(e, links, "site", "id", "cell", "area", "elevation")
    v = [(r["id"], r["cell"], r["area"], r["elevation"]) for r in e.collect()]
    want = [(a[0], b[0], k) for a in v for b in v if a[0] != b[0] and a[1] >= b[1] for k, ok in (("area_order", a[2] > 1.05 * b[2]), ("elevation_order", a[3] < b[3] - 10), ("same_cell", a[1] == b[1] and a[0] < b[0])) if ok]
    assert sorted((r["a"], r["b"], r["conflict"]) for r in out.collect()) == sorted(want)
    assert out.filter("conflict = 'same_cell'").select(F.spark_partition_id().alias("t")).distinct().count() > 1


def test_the_way_down_takes_one_shuffle(spark):
    import random as rnd

    from flowfeat.operators.basin import downstream_links
    from flowfeat.sources.shared import cut

    rng = rnd.Random(5)
    cells = {(b, r, c): rng.choice([None, *range(8)]) for b in (1, 2) for r in range(9) for c in range(9) if rng.random() < 0.7}
    df = cut(spark.createDataFrame([(*k, None if z is None else float(z), k[1]) for k, z in cells.items()], "basin long, row long, col int, elevation double, code long"), "cells")
    out = downstream_links(df, "basin")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert out.columns == ["basin", "row", "col", "elevation", "code", "down"]
    for x in out.collect():
        near = [(cells[k], k[1], k[2]) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (k := (x["basin"], x["row"] + dr, x["col"] + dc)) in cells and cells[k] is not None]
        lower = [n for n in near if x["elevation"] is not None and n[0] < x["elevation"]]
        assert (x["down"] and tuple(x["down"])) == (min(lower)[1:] if lower else None) and x["code"] == x["row"]


def test_heights_on_a_tie_are_rounded_as_binary_numbers(spark, duck):
    from flowfeat.operators.basin import topographic_indices

    xs = [x for i in range(40) for x in [math.nextafter(19.2645 + i / 1000, 0)] if x * 1000 % 1 == 0.5]
    assert xs
    df = spark.createDataFrame([(i, 100.0, 5.0, x) for i, x in enumerate(xs)], "basin int, elevation double, slope double, hand double")
    got = {r["basin"]: r["hand_median"] for r in topographic_indices(df, "basin", F.lit(1.0), F.col("hand"), F.lit(True), 30.0).collect()}
    assert got == {i: duck.sql(f"SELECT round({x!r}::DOUBLE, 3)").fetchall()[0][0] for i, x in enumerate(xs)}


def test_pairs_of_polygons_are_made_once_and_not_shuffled(spark, monkeypatch):
    from flowfeat.operators import basin, spread

    rng = random.Random(21)

    def polygon(x, y):
        return [[[x + s * math.cos(t), y + s * math.sin(t)] for k in range(9) for t, s in [(2 * math.pi * k / 9, rng.uniform(1, 3))]], [[x, y], [x + 0.4, y + 0.1], [x + 0.2, y + 0.5]]]

    kind = "array<array<array<array<double>>>>"
    shapes = [[[polygon(rng.uniform(-9, 9), rng.uniform(-9, 9))] for _ in range(15)] for _ in range(2)]
    shapes[1][3] = [[[[x, y] for x, y in ((-4.0, -4.0), (4.0, -4.0), (4.0, 4.0), (-4.0, 4.0))]]]  # another number of edges
    b, f = (spark.createDataFrame([(i * 100 + k, s) for i, s in enumerate(side) for k in range(4)] + [(9999, None)], f"{n} long, polygons {kind}") for side, n in zip(shapes, ("bid", "fid")))
    rows = lambda out=None: {(r["bid"], r["fid"]): r["area"] for r in (out or basin.overlay_polygons(b, f, 1.5)).collect()}
    out = basin.overlay_polygons(b, f, 1.5)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()  # sums of pairs would be shuffled
    whole = rows(out)
    assert len(whole) > 400 and all(whole[i // 100 * 100, j // 100 * 100] == a for (i, j), a in whole.items())
    monkeypatch.setattr(spread, "ALIKE", 2)
    monkeypatch.setattr(spread, "PAIRED", 5)
    monkeypatch.setattr(basin, "TOLD", 3)
    assert rows() == pytest.approx(whole, abs=1e-9)
    monkeypatch.setattr(basin, "POINTS", 8)  # the square alone meets whole
    assert rows() == pytest.approx(whole, abs=1e-9)
    assert basin.overlay_polygons(b.limit(0), f, 1.5).count() == 0


def test_the_area_of_the_same_boxes_is_worked_out_once(spark, monkeypatch):
    from flowfeat.operators import basin, spread

    rng = random.Random(13)
    boxes = [(x, y, x + rng.choice([0.0, 2.0, 7.5]), y + rng.uniform(1, 6)) for _ in range(25) for x, y in [(rng.uniform(-30, 30), rng.uniform(-20, 20))]]
    b = [(i * 100 + k, [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]) for i, (x0, y0, x1, y1) in enumerate(boxes) for k in range(6)] + [(9001, [[0.0, 0.0], [8.0, 0.0], [0.0, 8.0]]), (9002, None)]
    f = [(i * 100 + k, x0 - 3, y0 - 1, x1 + 4, y1 + 3) for i, (x0, y0, x1, y1) in enumerate(boxes) for k in range(6)] + [(9003, 1.0, 1.0, 3.0, 3.0), (9004, None, 1.0, 2.0, 2.0)]
    common = lambda p, q: max(0.0, min(p[2], q[2]) - max(p[0], q[0])) * max(0.0, min(p[3], q[3]) - max(p[1], q[1]))
    want = {(p, x[0]): a for p, r in b[:-2] for x in f[:-1] if (a := common((*r[0], *r[2]), x[1:])) > 0}
    bs, fs = spark.createDataFrame(b, "bid long, ring array<array<double>>"), spark.createDataFrame(f, "fid long, x0 double, y0 double, x1 double, y1 double")
    for alike, paired in ((256, 16_384), (2, 20)):
        monkeypatch.setattr(spread, "ALIKE", alike)
        monkeypatch.setattr(spread, "PAIRED", paired)
        lines = basin.overlay_features(bs, fs, 4.0).collect()
        got = {(r["bid"], r["fid"]): r["area"] for r in lines}
        assert len(got) == len(lines) and {k: v for k, v in got.items() if k[0] != 9001} == pytest.approx(want, rel=1e-12)
        assert got[9001, 9003] == pytest.approx(4.0)
    monkeypatch.undo()
    worked = spark.sparkContext.accumulator(0)
    only = basin.expanded

    def counted(pairs, *names):
        worked.add(pairs.count())
        return only(pairs, *names)

    monkeypatch.setattr(basin, "expanded", counted)
    basin.overlay_features(bs.filter("bid < 9000"), fs.filter("fid < 9000"), 4.0)
    assert 0 < worked.value * 36 <= len(want) + 36


def test_points_of_one_place_are_paired_once_and_in_many_tasks(spark, monkeypatch):
    from flowfeat.operators import catalog, spread

    rng = random.Random(17)
    at = [(rng.uniform(86, 90), rng.uniform(-180, 180)) for _ in range(20)] + [(rng.uniform(-30, 30), rng.uniform(-15, 15)) for _ in range(20)]
    rows = [(i * 100 + k, *p) for i, p in enumerate(at) for k in range(5)] + [(9001, None, 3.0), (9002, 4.0, None)]
    p = spark.createDataFrame(rows, "id long, lat double, lon double")

    def km(a, b):
        y, v = math.radians(a[0]), math.radians(b[0])
        return 12742.0 * math.asin(math.sqrt(min(1.0, math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2)))

    want = {(a[0], b[0]): round(d, 4) for a in rows[:-2] for b in rows[:-2] if (d := km(a[1:], b[1:])) <= 400.0}
    lists, only = [], catalog.expanded

    def kept(pairs, *names):
        lists.append(pairs)
        return only(pairs, *names)

    monkeypatch.setattr(catalog, "expanded", kept)
    for alike, paired in ((256, 4_096), (2, 10)):
        monkeypatch.setattr(spread, "ALIKE", alike)
        monkeypatch.setattr(spread, "PAIRED", paired)
        out = catalog.near_pairs(p, p, 400.0, "id", 4)
        got = {(r["a"], r["b"]): r["km"] for r in out.collect()}
        assert out.count() == len(got) and got == pytest.approx(want, abs=1e-4 + 1e-9)
    assert lists[0].count() * 25 == len(want)
    assert out.filter("a < 2000").select(F.spark_partition_id().alias("t")).distinct().count() > 1  # around the pole there is one cell
