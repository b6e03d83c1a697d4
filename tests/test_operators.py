"""Operators on small literal tables: order of events, ties, nulls, and what they must not see."""

import datetime as dt
import os

import numpy as np
import pytest

from pyspark.sql import functions as F

from flowfeat.functions import dates, levels, text
from flowfeat.operators import basin as B
from flowfeat.operators import catalog as C
from flowfeat.operators import history as H
from flowfeat.operators import merge as M
from flowfeat.operators import series as S

D = dt.date


def obs(spark, rows):
    return spark.createDataFrame([(i, s, 1, 1, D(2024, 1, d), b, {"LOW": 1, "MEDIUM": 2, "HIGH": 3}.get(b)) for i, s, d, b in rows], "observation_id long, site long, grp long, sup long, date date, bucket string, rank int")


def test_priors_start_at_a_third_and_ignore_peers(spark):
    o = obs(spark, [(1, 1, 1, "HIGH"), (2, 1, 1, "HIGH"), (3, 1, 2, "LOW")])
    got = {r["observation_id"]: r for r in H.causal_priors(o).collect()}
    assert got[1]["site_high"] == got[2]["site_high"] == 0 and abs(got[1]["site_p_high"] - 1 / 3) < 1e-9
    assert got[3]["site_high"] == 2 and got[3]["global_p_high"] == 1.0


def test_priors_do_not_leak(spark):
    rows = [(i, i % 3, 1 + i % 9, ["LOW", "MEDIUM", "HIGH", None][i % 4]) for i in range(40)]
    full = {r["observation_id"]: tuple(r) for r in H.causal_priors(obs(spark, rows)).collect()}
    for day in (3, 7):
        early = [r for r in rows if r[2] < day] + [next(r for r in rows if r[2] == day)]
        cut = {r["observation_id"]: tuple(r) for r in H.causal_priors(obs(spark, early)).collect()}
        assert cut[early[-1][0]] == full[early[-1][0]]


def test_partition_count_does_not_matter(spark):
    rows = obs(spark, [(i, i % 5, 1 + i % 20, ["LOW", "HIGH"][i % 2]) for i in range(100)])
    a = sorted(map(tuple, H.recent_history(rows).collect()), key=str)
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert sorted(map(tuple, H.recent_history(rows).collect()), key=str) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_asof_is_strict_and_bounded(spark):
    left = spark.createDataFrame([(1, D(2024, 5, 1)), (1, D(2024, 5, 2)), (1, D(2026, 1, 1)), (2, D(2024, 5, 1))], "k long, t date")
    right = spark.createDataFrame([(1, D(2024, 5, 1), 7), (1, D(2023, 12, 31), 5)], "k long, t date, v int")
    got = {(r["k"], r["t"]): r["v"] for r in S.asof_join(left, right, ["k"], "t", "t", 366, ["v"]).collect()}
    assert got == {(1, D(2024, 5, 1)): 5, (1, D(2024, 5, 2)): 7, (1, D(2026, 1, 1)): None, (2, D(2024, 5, 1)): None}


def test_windows_merge_up_to_the_span(spark):
    w = spark.createDataFrame([(1, i, D(2024, 1, 1) + dt.timedelta(10 * i), D(2024, 1, 8) + dt.timedelta(10 * i)) for i in range(6)], "k long, i long, start date, end date")
    assert [r["ids"] for r in S.merge_windows(w, ["k"], 5, "i").collect()] == [list(range(6))]
    got = sorted(r["ids"] for r in S.merge_windows_capped(w, ["k"], 5, 30, "i").collect())
    assert got == [[0, 1, 2], [3, 4, 5]]


def test_ragged_payload(spark):
    p = spark.createDataFrame([(1, ["a", "b"], [1.0])], "k long, t array<string>, v array<double>")
    assert sorted(map(tuple, S.flatten_series(p, "t", ["v"], ["k"]).collect())) == [(1, "a", 1.0), (1, "b", None)]


def test_grid_keeps_weights_of_null_values(spark):
    g = spark.createDataFrame([(1, 0.5, 10.0), (1, 0.5, None)], "b long, weight double, v double")
    r = S.grid_aggregate(g, ["b"], "v").first()
    assert (r["v"], r["n_cells"], r["n_available"]) == (5.0, 2, 1)


def test_dates_in_all_forms(spark):
    forms = ["2024-03-05", "5 mars 2024", "Mardi 5 Mars 24", "05/03/2024", "5-3-24", "5/3", "5 mars 2024", "1er août 2023", "31/02/2024", "garbage", None]
    df = spark.createDataFrame([(f,) for f in forms], "f string").select(dates.parse_date_multi(F.col("f"), 2024).alias("d"))
    assert [r["d"] for r in df.collect()] == [D(2024, 3, 5)] * 7 + [D(2023, 8, 1), None, None, None]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  Été à  l'ÉCHELLE! ", ["a", " A", "b ", "", None])], "t string, l array<string>")
    r = df.select(text.normalize_text(F.col("t")).alias("n"), text.unique_non_blank(F.col("l")).alias("u"), text.parse_cotation(F.lit("v3a2III")).alias("c")).first()
    assert r["n"] == "ete a l echelle" and r["u"] == ["a", "b"] and tuple(r["c"]) == (3, 2, 3)


@pytest.mark.parametrize(
    "comment, selected, signals, target",
    [
        (None, None, [], None),
        ("", 2.0, [], None),
        ("pas GD", None, [], None),
        ("je ne mets pas DC, mais PD", None, [], None),  # 24 characters before a mention are looked at
        ("pas de gd", None, ["GD"], 3.0),
        ("PD-", None, ["PD-"], 0.82),
        ("TGD+++", None, ["TGD++"], 4.38),
        ("DC+-", None, ["DC+-"], 2.0),
        ("dc / gd", None, ["DC/GD"], 2.5),
        ("dc / gd", 2.8, ["DC/GD"], 2.8),
        ("dc / gd", 3.5, ["DC/GD"], 2.5),
        ("xdc dcx", None, [], None),
        ("débit correct signifie", None, [], None),
        ("Débit correct", None, ["debit_correct"], 2.0),
        ("bon gros débit", None, ["gros_debit", "correct_plus_context"], round((3.0 * 0.75 + 2.45 * 0.6) / 1.35, 6)),
        ("DC et DC encore", None, ["DC"], 2.0),
        ("à sec, impraticable", None, ["sec", "impraticable"], round((0 * 0.86 + 4.5 * 0.76) / 1.62, 6)),
    ],
)
def test_text_target_signal(spark, comment, selected, signals, target):
    df = spark.createDataFrame([(comment, selected)], "t string, s double")
    r = df.select(text.text_target_signal(F.col("t"), F.col("s")).alias("x")).first()["x"]
    assert [m["signal"] for m in r["matches"]] == signals and r["target"] == target
    assert (r["best"]["signal"] if r["best"] else None) == (signals[0] if signals else None)


def test_best_signal_is_the_nearest(spark):
    df = spark.createDataFrame([(s,) for s in (1.0, 3.0, None)], "s double").select(text.text_target_signal(F.lit("PD puis GD"), F.col("s")).alias("x"))
    assert [r["x"]["best"]["signal"] for r in df.collect()] == ["PD", "GD", "PD"]


def test_folding(spark):
    t = "Šumava ŽÁR Ő ½ ﬂ １２ e\u0301té Œuvre"
    r = spark.createDataFrame([(t,)], "t string").select(text.normalize_text(F.col("t")).alias("a"), text.normalize_text_unicode(F.col("t")).alias("b")).first()
    assert r["a"] == "sumava zar o 12 ete uvre" and r["b"] == "sumava zar o 1 2 fl 12 ete uvre"


def test_null_fails_an_active_range(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "v double")
    assert [r[0] for r in df.select(levels.range_match(F.col("v"), 1, None)).collect()] == [False, True]
    assert [r[0] for r in df.select(levels.range_match(F.col("v"), None, None)).collect()] == [True, True]


def test_nulls_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0), (3, 1.0)], "i int, v double")
    assert [r["i"] for r in C.sorted_nulls_last(df, [("v", True)], 3).collect()] == [3, 2, 1]
    assert [r["i"] for r in C.sorted_nulls_last(df, [("v", False)], 3).collect()] == [2, 3, 1]


def test_near_pairs_match_brute_force(spark):
    rows = [(i, (i * 37 % 140) - 70 + 0.3, (i * 53 % 300) - 150.0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double")
    got = {(r["a"], r["b"]) for r in C.near_pairs(df, df, 800.0, "id").collect()}
    b = df.select(F.col("id").alias("j"), F.col("lat").alias("y"), F.col("lon").alias("x"))
    from flowfeat.functions.geo import haversine

    want = {(r["id"], r["j"]) for r in df.crossJoin(b).filter(haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) <= 800).collect()}
    assert got == want


def test_dedup_and_upsert(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (None, "c", 5), (None, "d", 4)], "k int, v string, o int")
    assert sorted(r["v"] for r in M.dedup_first(df, ["k"], ["o"]).collect()) == ["b", "d"]
    new = spark.createDataFrame([(1, "z", 0), (7, "y", 0)], "k int, v string, o int")
    assert sorted(r["v"] for r in M.upsert(df.filter("k IS NOT NULL").limit(1), new, ["k"]).collect()) == ["y", "z"]


def test_patches_and_streams(spark):
    grid = ["##.#", "#..#", "...#"]
    cells = spark.createDataFrame([(1, r, c, float(10 * (3 - r) + c), ch == "#") for r, row in enumerate(grid) for c, ch in enumerate(row)], "b long, row long, col long, elevation double, on boolean")
    r = B.patches(cells, "b", F.col("on"), 2).first()
    assert (r["patches"], r["largest_share"]) == (2, 0.5)
    s = B.stream_network(B.downstream_links(cells, "b"), "b", F.col("col") == 0).first()
    assert (s["stream_cells"], s["sources"], s["junctions"]) == (3, 1, 0) and s["drained_cells"] == 12


def test_strahler_orders(spark):
    # two sources meet, their stream meets a third source (order stays 2), then an equal second-order stream (order 3)
    to = {1: 3, 2: 3, 3: 5, 4: 5, 5: 9, 6: 8, 7: 8, 8: 9, 9: 10, 10: None}
    down = "struct<row:long,col:long>"
    rows = [(1, k, 0, (v, 0) if v else None) for k, v in to.items()] + [(2, 1, 0, (2, 0)), (2, 2, 0, None)]
    links = spark.createDataFrame(rows, f"b long, row long, col long, down {down}")
    assert dict(map(tuple, B.strahler(links, "b", F.lit(True)).collect())) == {1: 3, 2: 1}


def plain_clip(ring: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> float:
    """Area of a polygon ring inside a box: the ring is cut at each side of the box in turn."""
    p = ring
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        if not len(p):
            return 0.0
        q = np.roll(p, -1, axis=0)
        a, b = keep * (p[:, axis] - bound), keep * (q[:, axis] - bound)
        cross = (a >= 0) != (b >= 0)
        t = np.where(cross, a / np.where(cross, a - b, 1), 0)[:, None]
        points = np.stack([np.where((a >= 0)[:, None], p, np.nan), np.where(cross[:, None], p + t * (q - p), np.nan)], axis=1).reshape(-1, 2)
        p = points[~np.isnan(points[:, 0])]
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def test_clip_area(spark):
    """Areas of triangles, stars and other rings inside boxes, against cutting the ring at each side in turn."""
    rng = np.random.default_rng(3)
    rows = [([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]], *box) for box in ((0, 0, 2, 2), (5, 5, 6, 6), (-1, -1, 9, 9))]
    for k in range(40):
        turn = np.sort(rng.uniform(0, 2 * np.pi, 4 + k % 7))
        far = rng.uniform(0.3, 2.0, len(turn))[:, None]
        ring = (np.stack((np.cos(turn), np.sin(turn)), 1) * far).tolist()[:: 1 if k % 2 else -1]
        x, y = rng.uniform(-2, 1, 2)
        rows.append((ring, x, y, x + rng.uniform(0.1, 3), y + rng.uniform(0.1, 3)))
    rows = [(r, *map(float, box)) for r, *box in rows]
    df = spark.createDataFrame(rows, "ring array<array<double>>, x0 double, y0 double, x1 double, y1 double")
    got = [r["a"] for r in df.select(B.clipped_area("ring", "x0", "y0", "x1", "y1").alias("a")).collect()]
    assert got[:3] == [4.0, 0.0, 8.0]
    assert all(abs(g - plain_clip(np.array(r), *box)) < 1e-9 for g, (r, *box) in zip(got, rows))


def test_weighted_cells_of_a_triangle(spark):
    df = spark.createDataFrame([(1, [[0.0, 0.0], [1.0, 0.0], [0.0, 1.0]])], "id int, ring array<array<double>>")
    got = {(r["ix"], r["iy"]): r["weight"] for r in B.weighted_cells(df, "id", "ring", 1.0).collect()}
    assert got == {(0, 0): 0.5, (1, 0): 0.25, (0, 1): 0.25}



def test_first_sync_seeds_silently(spark, tmp_path):
    from flowfeat.streaming import activity as A

    schema = "user_id long, event_id long, ts timestamp"
    at = lambda h: dt.datetime(2024, 1, 1, h)
    batches = [[(1, 10, at(1)), (1, 11, at(1))], [(1, 11, at(2)), (1, 12, at(3)), (2, 20, at(3))], [(2, 21, at(4)), (1, 12, at(5))]]
    src = f"{tmp_path}/src"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        for n in os.listdir(src):
            if n.endswith(".parquet") and not n.startswith("batch"):
                os.rename(f"{src}/{n}", f"{src}/batch{k}.parquet")
                os.utime(f"{src}/batch{k}.parquet", (1000 + k, 1000 + k))
    s = A.new_items(A.read_events(spark, src, spark.createDataFrame([], schema).schema), "user_id", "event_id")
    before = spark.conf.get(A.STATE_STORE)
    spark.conf.set(A.STATE_STORE, A.ROCKS)
    s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(A.STATE_STORE, before)
    assert sorted(r["marker"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["12", "21"]


def test_streams_hold_all_events(spark):
    from flowfeat.plans.streams import replayed, run

    days = ["2023-06-01", "2024-01-03", None, "2024-02-01", "2025-09-09"]
    e = spark.createDataFrame([(i, days[i % 5]) for i in range(50)], "event_id long, ts string").withColumn("ts", F.to_timestamp_ntz("ts"))
    got = run(spark, replayed(spark, e, per_file=7), "all-events").select("event_id", F.input_file_name().alias("f")).collect()
    assert sorted(r["event_id"] for r in got) == list(range(50))
    assert run(spark, replayed(spark, e.limit(0)), "no-events").count() == 0


def test_new_items_fold_batches():
    import pandas as pd

    from flowfeat.streaming.activity import NewItems

    class Held:
        def __init__(self, *rows):
            self.rows = list(rows)

        exists = lambda self: bool(self.rows)
        get = lambda self: self.rows[0] if self.one else iter(self.rows)

        def put(self, rows):
            self.rows = list(rows)

        def update(self, row):
            self.rows = [row]

    def batches():
        for k in range(40):
            assert k < 2 or got, "nothing came out before all batches were read"
            yield pd.DataFrame({"marker": [f"m{k}", f"m{k + 1}"], "ts": pd.to_datetime(["2024-01-01", "2024-01-02"]) + pd.Timedelta(days=k)})

    step, got = NewItems(), []
    step.seen, step.seeded = Held(("m1",)), Held((0,))
    step.seen.one, step.seeded.one = False, True
    for out in step.handleInputRows(("u",), batches(), None):
        got += out["marker"].tolist()
    assert sorted(got) == sorted(f"m{k}" for k in range(41) if k != 1)
    assert step.seen.rows[-1] == ("m40",) and len(step.seen.rows) <= 50


def test_near_pairs_at_the_date_line_and_the_poles(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    lat = np.concatenate((rng.uniform(-90, 90, 300), rng.uniform(84, 90, 60), rng.uniform(-90, -84, 60), rng.uniform(-40, 40, 80), [90, -90]))
    lon = np.concatenate((rng.uniform(-180, 180, 420), np.tile([179.5, -179.5], 40) + rng.uniform(-0.5, 0.5, 80), [0, 180]))
    rows = [(i, float(y), float(x)) for i, (y, x) in enumerate(zip(lat, lon))]
    p = spark.createDataFrame(rows, "id long, lat double, lon double")
    y, x = np.radians(lat), np.radians(lon)
    h = np.sin((y[:, None] - y) / 2) ** 2 + np.cos(y)[:, None] * np.cos(y) * np.sin((x[:, None] - x) / 2) ** 2
    far = 12742.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))
    for km in (400.0, 3000.0):
        got = [(r["a"], r["b"]) for r in C.near_pairs(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), km, "id").collect()]
        assert sorted(got) == [(i, j) for i, j in np.argwhere(far <= km).tolist() if i % 2 == 0 and j % 2 == 1]
    edge = 12742.0 * np.arcsin(np.sqrt(np.sin(np.radians(lat - 10) / 2) ** 2 + np.cos(y) * np.cos(np.radians(10)) * np.sin(np.radians(lon - 179) / 2) ** 2))
    assert sorted(r["id"] for r in C.nearby(p, 10.0, 179.0, 900.0).collect()) == np.flatnonzero(edge <= 900).tolist()


def test_exact_quantiles(spark):
    """Ranks found by narrowing equal numpy's, for ties, wide ranges, one value, nulls and no value."""
    from flowfeat.operators import profile as P

    rng = np.random.default_rng(5)
    data = {"a": rng.normal(size=500), "b": rng.integers(0, 4, 500).astype(float), "c": np.where(rng.random(500) < 0.5, rng.random(500) * 1e-9, 1e300), "d": np.full(500, 7.0), "e": np.where(rng.random(500) < 0.3, np.nan, rng.exponential(size=500)), "f": np.full(500, np.nan)}
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in row) for i, row in enumerate(zip(*data.values()))], ", ".join(f"{k} double" for k in data))
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = P.exact_quantiles(df, list(data), probs, bins=16)
    for k, v in data.items():
        v = v[~np.isnan(v)]
        want = np.quantile(v, probs).tolist() if len(v) else [None] * len(probs)
        assert all(g == w or abs(g - w) <= 1e-12 * max(abs(w), 1e-9) for g, w in zip(got[k], want)), k


def test_cutpoint_search(spark):
    """The search over counts walks as one over the rows: every step's choice is the best of its grid."""
    from flowfeat.operators import evaluate as E

    rng = np.random.default_rng(7)
    actual = rng.integers(0, 6, 400)
    score = np.clip(actual * 0.8 + 0.3 + rng.normal(0, 0.5, 400), 0, 5)
    found = E.search_cutpoints(spark.createDataFrame(list(zip(score.tolist(), actual.tolist())), "s double, a int"), "s", "a")

    def value(c):
        e = np.abs(np.searchsorted(c, score, "right") - actual)
        return -(e.mean() or 99.0), (e == 0).mean(), -((e >= 2).mean() or 1.0), -sum(abs(x - i - 0.5) for i, x in enumerate(c)) * 0.001

    assert all(b - a >= 0.25 - 1e-9 for a, b in zip(found, found[1:])) and value(found) > value([0.5, 1.5, 2.5, 3.5, 4.5])
    for i, (lo, hi) in enumerate(((5, 31), (20, 46), (40, 66), (56, 86), (70, 101))):
        for x in range(lo, hi):
            c = [*found[:i], round(x / 20, 2), *found[i + 1 :]]
            if all(a + 0.25 <= b for a, b in zip(c, c[1:])):
                assert value(c)[:2] <= value(found)[:2] or np.allclose(value(c)[:2], value(found)[:2])


def test_curvatures_of_a_surface(spark):
    """On a whole grid the same as numpy's gradients of gradients."""
    y, x = np.mgrid[0:7, 0:9].astype(float)
    z = 3 * np.sin(x / 2) * 20 + y * y * 4 + x * y
    df = spark.createDataFrame([(1, int(i), int(j), float(z[i, j])) for i in range(7) for j in range(9)], "basin int, row int, col int, elevation double")
    q, p = np.gradient(z, 30.0, 30.0)
    r, s, t = np.gradient(p, 30.0, axis=1), np.gradient(p, 30.0, axis=0), np.gradient(q, 30.0, axis=0)
    g = p * p + q * q
    g[g <= 1e-12] = np.nan
    plan, profile = (q * q * r - 2 * p * q * s + p * p * t) / (g * np.sqrt(1 + g)), (p * p * r + 2 * p * q * s + q * q * t) / (g * (1 + g) ** 1.5)
    got = B.curvatures(df, "basin").first()
    assert abs(got["plan_curvature"] - np.nanmean(plan)) < 1e-6 and abs(got["profile_curvature"] - np.nanmean(profile)) < 1e-6


def worded_rows(rng, n, vocabulary, most, first):
    rows = [(first + i, None if i % 9 == 0 else int(rng.integers(3)), [f"w{int(k)}" for k in np.unique((vocabulary * rng.random(int(rng.integers(0, most))) ** 2).astype(int))]) for i in range(n)]
    return rows + [(first + 1000 + i, d, w) for i, d, w in ((i, *rows[i % n][1:]) for i in range(0, n, 7))]  # some again


def plain_matches(left, right, least=0.45, margin=0.05, bonus=0.25):
    out = []
    for i, d, w in left:
        found = sorted((-(2.0 * len(both) / (len(w) + len(v)) + (bonus if d is not None and d == e else 0)), j) for j, e, v in right if (both := set(w) & set(v)))
        if found and -found[0][0] >= least and (len(found) == 1 or found[1][0] - found[0][0] >= margin):
            out.append((i, found[0][1], round(-found[0][0], 6)))
    return sorted(out)


def test_token_matches_are_those_of_all_pairs(spark, monkeypatch):
    """With copies on both sides, rows without words, ties, and departments that are null, which are no department."""
    monkeypatch.setattr(C, "BLOCK_ROWS", 16, raising=False)
    rng = np.random.default_rng(5)
    left, right = worded_rows(rng, 120, 60, 9, 0), worded_rows(rng, 90, 60, 9, 5000)
    schema = "id long, dep int, t array<string>"
    got = C.match_by_tokens(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "id", "t", "dep").collect()
    assert sorted((r["id"], r["match"], r["score"]) for r in got) == plain_matches(left, right) and len(got) > 20


def shuffled(spark):
    """Records written by the shuffles of each stage so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    no = sc._jvm.java.util.ArrayList()
    found = sc._jsc.sc().statusStore().stageList(no, False, False, sc._gateway.new_array(sc._jvm.double, 0), no)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}


def test_token_matches_shuffle_rows_not_pairs(spark):
    """Rows that all share common words are a few rows written for each word of a row, however many pairs meet."""
    rng = np.random.default_rng(6)
    rows = [[(first + i, i % 7, [f"w{k}" for k in rng.permutation(40)[:20].tolist()]) for i in range(400)] for first in (0, 1000)]
    schema = "id long, dep int, t array<string>"
    before = shuffled(spark)
    C.match_by_tokens(*[spark.createDataFrame(r, schema) for r in rows], "id", "t", "dep").collect()
    written = [n for stage, n in shuffled(spark).items() if stage not in before]
    assert 800 <= sum(written) < 800 * 20


def test_cells_in_small_steps(monkeypatch):
    """Tiles, chunks and lists of any size give the same best two of each row."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    words = [np.unique((50 * rng.random(12) ** 2).astype(np.int32)) for _ in range(130)]
    rows = pa.table({"__side": [i % 2 for i in range(130)], "__rep": [f"{i * 37 % 131:03}" for i in range(130)], "__dep": [None if i % 5 == 0 else i % 3 for i in range(130)], "__n": [len(w) + i % 3 for i, w in enumerate(words)], "__o": words})
    seen = []
    for often, chunk, tile, meetings in ((1.0, 256, 8192, 4_000_000), (0.0, 7, 11, 1), (0.05, 13, 5, 40)):
        for name, value in zip(("OFTEN", "CHUNK", "TILE", "MEETINGS"), (often, chunk, tile, meetings)):
            monkeypatch.setattr(C, name, value)
        seen.append(sorted(zip(*C.best_overlaps(rows, 0.4, 0.25).to_pydict().values())))
    want = []
    for i in range(0, 130, 2):
        a, n, d = set(words[i].tolist()), *(rows.column(c)[i].as_py() for c in ("__n", "__dep"))
        each = [(-(2.0 * len(a & set(words[j].tolist())) / (n + rows.column("__n")[j].as_py()) + (0.25 if d is not None and d == rows.column("__dep")[j].as_py() else 0)), rows.column("__rep")[j].as_py()) for j in range(1, 130, 2) if a & set(words[j].tolist())]
        want += [(rows.column("__rep")[i].as_py(), r, -s) for s, r in sorted(each)[:2] if -s >= 0.4]
    assert seen[0] == seen[1] == seen[2] == sorted(want) and len(want) > 50
