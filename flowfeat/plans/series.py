"""Queries over daily and hourly series."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowfeat.operators import series as S
from flowfeat.plans._base import query
from flowfeat.sources.bindings import GRID, OBS, WX, ev, grid, obs, table, wx


def payload(spark, d):
    return wx(spark, d).groupBy("target").agg(F.array_sort(F.collect_list(F.struct("date", "precipitation", "rain"))).alias("a")).select("target", F.col("a.date").alias("time"), F.col("a.precipitation").alias("precipitation"), F.slice("a.rain", 1, 100).alias("rain"))


@query("a3_flatten_daily", f"WITH {WX} SELECT target, date AS time, precipitation, CASE WHEN row_number() OVER (PARTITION BY target ORDER BY date) <= 100 THEN rain END AS rain FROM wx")
def a3(spark, d):
    return S.flatten_series(payload(spark, d), "time", ["precipitation", "rain"], ["target"])


@query("a4_flatten_hourly", "SELECT user_id, ts AS time_local, value FROM events")
def a4(spark, d):
    arrays = ev(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a")).select("user_id", F.col("a.ts").alias("time_local"), F.col("a.value").alias("value"))
    return S.flatten_series(arrays, "time_local", ["value"], ["user_id"])


@query("c4_asof_join", f"WITH {OBS}, {WX}, o AS (SELECT observation_id, site % 100 AS target, date FROM obs) SELECT o.observation_id, o.target, o.date, CASE WHEN o.date - wx.date <= 366 THEN wx.date END AS asof_date, CASE WHEN o.date - wx.date <= 366 THEN precipitation END AS precipitation FROM o ASOF LEFT JOIN wx ON o.target = wx.target AND o.date > wx.date")
def c4(spark, d):
    o = obs(spark, d).select("observation_id", (F.col("site") % 100).alias("target"), "date")
    out = S.asof_join(o, wx(spark, d), ["target"], "date", "date", 366, ["precipitation"])
    return out.withColumn("asof_date", F.to_date("asof_date"))


@query("c5_interval_join", f"WITH {OBS}, {WX}, w AS (SELECT observation_id, site % 100 AS target, date - 20 AS a, date AS b FROM obs) SELECT observation_id, count(*) AS n, round(sum(precipitation), 4) AS total FROM w JOIN wx ON w.target = wx.target AND wx.date BETWEEN a AND b GROUP BY 1")
def c5(spark, d):
    w = obs(spark, d).select("observation_id", (F.col("site") % 100).alias("target"), F.date_sub("date", 20).alias("start"), F.col("date").alias("end"))
    return S.series_in_window(wx(spark, d), w, ["target"]).groupBy("observation_id").agg(F.count("*").alias("n"), F.round(F.sum("precipitation"), 4).alias("total"))


HOURS = "WITH e AS (SELECT *, epoch_us(ts) AS u FROM events) SELECT event_id, " + ", ".join(f"round(sum(value) OVER (PARTITION BY user_id ORDER BY u RANGE BETWEEN {h * 3600000000 - 1} PRECEDING AND CURRENT ROW), 4) AS sum_{h}h, count(*) OVER (PARTITION BY user_id ORDER BY u RANGE BETWEEN {h * 3600000000 - 1} PRECEDING AND CURRENT ROW) AS n_{h}h" for h in (6, 24, 72)) + " FROM e"


def week_sql(h):
    near = f"list_filter(wk, lambda x: x.u > u - {h * 3600000000})"
    return f"CASE WHEN len({near}) > 0 THEN list_max(list_transform(range(1, len({near}) + 1), lambda i: list_sum(list_transform(list_slice({near}, greatest(1, i - {h} + 1), i), lambda y: y.v)))) ELSE 0 END"


@query("c6_hourly_sums", HOURS)
def c6h(spark, d):
    return S.hourly_sums(ev(spark, d), ["user_id"], "ts", "value", [6, 24, 72]).select("event_id", *[f"{a}_{h}h" for h in (6, 24, 72) for a in ("sum", "n")])


@query("e6_hourly_features", "WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS u, CASE WHEN event_id % 9 > 0 THEN (event_id * 37 % 160) / 7.0::DOUBLE ELSE 0 END AS v FROM events), f AS (SELECT *, " + ", ".join(f"sum(v) OVER (PARTITION BY user_id ORDER BY u RANGE BETWEEN {h * 3600000000 - 1} PRECEDING AND CURRENT ROW) AS s_{h}" for h in (6, 12, 24, 48, 72, 168))
       + ", " + ", ".join(f"max(CASE WHEN v >= {t} THEN u END) OVER (PARTITION BY user_id ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l_{t}" for t in (1, 5, 10)) + ", list_sort(list(struct_pack(u := u, v := v)) OVER (PARTITION BY user_id ORDER BY u RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW)) AS wk FROM e) SELECT event_id, "
       + ", ".join(f"round(s_{h}, 3) AS sum_{h}h" for h in (6, 12, 24, 48, 72, 168)) + ", " + ", ".join(f"(u - l_{t}) // 3600000000 AS hours_since_{t}" for t in (1, 5, 10)) + ", " + ", ".join(f"round({week_sql(h)}, 3) AS best_{h}h" for h in (1, 3, 6, 12))
       + ", round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(wk, lambda y: y.v)), lambda a, y: a * 0.85 + y), 3) AS api FROM f")
def e6(spark, d):
    rows = ev(spark, d).select("event_id", "user_id", "ts", F.when(F.col("event_id") % 9 > 0, F.col("event_id") * 37 % 160 / 7.0).alias("v"))
    return S.hourly_features(rows, ["user_id"], "ts", "v").drop("user_id", "ts", "v")


@query("c6_trailing_interval", "SELECT a.event_id, count(*) AS n, round(sum(b.value), 4) AS total FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts - INTERVAL 12 HOUR AND b.ts <= a.ts GROUP BY 1")
def c6(spark, d):
    return S.hourly_sums(ev(spark, d), ["user_id"], "ts", "value", [12]).select("event_id", F.col("n_12h").alias("n"), F.col("sum_12h").alias("total"))


def sums(c, ns):
    return ", ".join(f"round(sum(coalesce({c}, 0)) OVER (PARTITION BY target ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 4) AS {c}_sum_{n}" for n in ns)


E1_DAYS = [2, 3, 5, 7, 10, 14, 21, 30]


@query("e1_trailing_sums", f"WITH {WX} SELECT target, date, {sums('precipitation', E1_DAYS)} FROM wx")
def e1(spark, d):
    return S.trailing_features(wx(spark, d), ["target"], "date", {"precipitation": E1_DAYS}).select("target", "date", *[f"precipitation_sum_{n}" for n in E1_DAYS])


def frame(n):
    return f"OVER (PARTITION BY target ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("e2_trailing_stats", f"WITH {WX} SELECT target, date, coalesce(max(temp) {frame(7)}, 0) AS temp_max_7, (sum(CASE WHEN temp >= 0.1 THEN 1 ELSE 0 END) {frame(7)})::BIGINT AS temp_wet_7, round(avg(temp) {frame(7)}, 4) AS temp_mean_7, round(sum(greatest(temp, 0)) {frame(7)}, 4) AS temp_positive_7 FROM wx")
def e2(spark, d):
    return S.trailing_features(wx(spark, d), ["target"], "date", {}, {"temp": [7]}).select("target", "date", "temp_max_7", "temp_wet_7", "temp_mean_7", "temp_positive_7")


@query("e3_days_since", f"WITH {OBS}, {WX}, r AS (SELECT target, date, " + ", ".join(f"max(CASE WHEN precipitation >= {t} THEN date END) OVER (PARTITION BY target ORDER BY date ROWS UNBOUNDED PRECEDING) AS r{t}" for t in (20, 50, 90)) + "), o AS (SELECT observation_id, site % 100 AS target, date FROM obs) SELECT observation_id, (o.date - 1 - r20)::INT AS since_20, (o.date - 1 - r50)::INT AS since_50, (o.date - 1 - r90)::INT AS since_90 FROM o ASOF LEFT JOIN r ON o.target = r.target AND o.date > r.date".replace("), o AS", " FROM wx), o AS"))
def e3(spark, d):
    reach = S.last_reach(wx(spark, d), ["target"], "date", "precipitation", [20, 50, 90])
    o = obs(spark, d).select("observation_id", (F.col("site") % 100).alias("target"), "date")
    out = S.asof_join(o, reach, ["target"], "date", "date", 100_000, ["reach_20", "reach_50", "reach_90"])
    return out.select("observation_id", *[F.datediff(F.date_sub("date", 1), f"reach_{t}").alias(f"since_{t}") for t in (20, 50, 90)])


DECAYS = (0.7, 0.85, 0.93)


@query("e4_decayed_sums", f"WITH {WX} SELECT target, date, " + ", ".join(f"round(list_reduce(list_prepend(0.0::DOUBLE, list(precipitation) {frame(30)}), lambda a, x: a * {k} + x) + 1e-7, 4) AS api_{int(k * 100)}" for k in DECAYS) + " FROM wx")
def e4(spark, d):
    names = {f"api_{int(k * 100)}": k for k in DECAYS}
    return S.decayed_sums(wx(spark, d), ["target"], "date", "precipitation", names, 30).select("target", "date", *[F.round(F.col(n) + 1e-7, 4).alias(n) for n in names])


@query("c7_d1_grid_aggregate", f"WITH {GRID}, {WX}, j AS (SELECT basin, date, weight, CASE WHEN cell % 7 = 0 THEN NULL ELSE precipitation END AS p FROM grid JOIN wx ON cell = target), a AS (SELECT basin, date, list_sort(list(p) FILTER (p IS NOT NULL)) AS l, sum(p * weight) / sum(weight) AS p, max(p) AS m, count(*) AS n_cells, count(p) AS n_available, sum(weight) AS w FROM j GROUP BY 1, 2) SELECT basin, date, round(p, 6) AS precipitation, m AS max_cell_precipitation, l[round_even((n_available - 1) * 0.9, 0)::INT + 1] AS p90_cell_precipitation, n_cells, n_available, round(w, 6) AS available_weight FROM a")
def d1(spark, d):
    rows = wx(spark, d).withColumn("precipitation", F.when(F.col("target") % 7 != 0, F.col("precipitation"))).select("target", "date", "precipitation")
    return S.grid_aggregate(S.grid_daily(grid(spark, d), rows), ["basin", "date"], "precipitation")


@query("e7_availability", f"WITH {GRID}, {WX}, a AS (SELECT basin AS target, date, sum(weight) AS w FROM grid JOIN wx ON cell = target GROUP BY 1, 2) SELECT target AS basin, date, round(lag(w) OVER (PARTITION BY target ORDER BY date), 6) AS prev, round(avg(w) {frame(30)}, 6) AS mean_30, round(min(w) {frame(30)}, 6) AS min_30 FROM a")
def e7(spark, d):
    a = S.grid_daily(grid(spark, d), wx(spark, d).select("target", "date")).groupBy("basin", "date").agg(F.sum("weight").alias("w"))
    return S.availability(a, ["basin"], "date", "w").select("basin", "date", "prev", "mean_30", "min_30")


@query("e16_observation_windows", f"WITH {OBS} SELECT observation_id, date - 30 AS start, date AS \"end\", 'win_' || substr(sha1(observation_id || '|' || CAST(date - 30 AS VARCHAR) || '|' || CAST(date AS VARCHAR)), 1, 16) AS window_id FROM obs")
def e16(spark, d):
    return S.observation_windows(obs(spark, d), 30).select("observation_id", "start", "end", "window_id")


WINDOWS = f"WITH {OBS}, w AS (SELECT site, observation_id, date - 30 AS a, date AS b FROM obs)"


def windows(spark, d):
    return S.observation_windows(obs(spark, d), 30).select("site", "observation_id", "start", "end")


@query("e17_merge_windows", WINDOWS + """, f AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY site ORDER BY a, b, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 15 THEN 0 ELSE 1 END AS new FROM w),
  i AS (SELECT *, sum(new) OVER (PARTITION BY site ORDER BY a, b, observation_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
  SELECT site, min(a) AS start, max(b) AS "end", count(*) AS n, array_to_string(list_sort(list(observation_id)), ',') AS ids FROM i GROUP BY site, k""")
def e17(spark, d):
    return S.merge_windows(windows(spark, d), ["site"], 15, "observation_id").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("e18_merge_windows_capped", WINDOWS.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY a, b, observation_id) AS k FROM w),
  f AS (SELECT site, k, observation_id, a AS s, b AS e, 1 AS g FROM n WHERE k = 1 UNION ALL SELECT n.site, n.k, n.observation_id, CASE WHEN n.a <= f.e + 20 AND greatest(f.e, n.b) - f.s <= 100 THEN f.s ELSE n.a END, CASE WHEN n.a <= f.e + 20 AND greatest(f.e, n.b) - f.s <= 100 THEN greatest(f.e, n.b) ELSE n.b END,
    CASE WHEN n.a <= f.e + 20 AND greatest(f.e, n.b) - f.s <= 100 THEN f.g ELSE f.g + 1 END FROM f JOIN n ON n.site = f.site AND n.k = f.k + 1)
  SELECT site, min(s) AS start, max(e) AS "end", string_agg(observation_id, ',' ORDER BY k) AS ids FROM f GROUP BY site, g""")
def e18(spark, d):
    return S.merge_windows_capped(windows(spark, d), ["site"], 20, 100, "observation_id").withColumn("ids", F.array_join("ids", ","))


@query("e19_annual_windows", WINDOWS + " SELECT site, year(b)::INT AS year, min(a) AS start, max(b) AS \"end\", array_to_string(list_sort(list(observation_id)), ',') AS ids FROM w GROUP BY 1, 2")
def e19(spark, d):
    return S.annual_windows(windows(spark, d), ["site"], "observation_id").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("e20_history_windows", f"WITH {OBS} SELECT site, min(date) - 365 AS start, DATE '2001-12-31' AS \"end\", count(*) AS n FROM obs GROUP BY 1")
def e20(spark, d):
    return S.history_windows(obs(spark, d), ["site"], "date", "2001-12-31")


@query("e21_monthly_windows", WINDOWS + ", m AS (SELECT site, observation_id, unnest(range(date_trunc('month', a)::TIMESTAMP, date_trunc('month', least(b, DATE '2000-06-30'))::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 MONTH))::DATE AS month FROM w WHERE a <= least(b, DATE '2000-06-30')) SELECT site, month, array_to_string(list_sort(list(DISTINCT observation_id)), ',') AS ids FROM m GROUP BY 1, 2")
def e21(spark, d):
    return S.monthly_windows(windows(spark, d), ["site"], "observation_id", "2000-06-30").withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("c3_window_membership", WINDOWS + " SELECT observation_id AS id, site, year(b)::INT AS year FROM w")
def c3(spark, d):
    return S.within_window_ids(S.annual_windows(windows(spark, d), ["site"], "observation_id")).select("id", "site", "year")


NOW = "TIMESTAMP '2024-01-16 12:00:00'"


@query("d29_rain_summary", f"""WITH r AS (SELECT *, ts <= {NOW} AS past, row_number() OVER (PARTITION BY user_id, ts <= {NOW} ORDER BY ts DESC) AS back, row_number() OVER (PARTITION BY user_id, ts <= {NOW} ORDER BY ts) AS forth FROM events)
  SELECT user_id, """ + ", ".join(f"round(sum(value) FILTER (past AND back <= {n}), 4) AS last_{n}" for n in (24, 48, 72)) + ", " + ", ".join(f"round(sum(value) FILTER (NOT past AND forth <= {n}), 4) AS next_{n}" for n in (24, 48)) + ", max(value) FILTER (past AND back <= 72) AS max_72, max((props::JSON ->> 'k')::DOUBLE) FILTER (NOT past AND forth <= 24) AS chance_24 FROM r GROUP BY 1")
def d29(spark, d):
    return S.rain_summary(ev(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("double")), ["user_id"], "ts", "value", "k", "2024-01-16 12:00:00")


@query("a10_pending_windows", WINDOWS + ", p AS (SELECT * FROM w WHERE observation_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) SELECT observation_id, a AS start, b AS \"end\", ((row_number() OVER (ORDER BY a, observation_id)) - 1) // 50 AS batch FROM p")
def a10(spark, d):
    from flowfeat.operators.merge import pending_windows

    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("observation_id"))
    return pending_windows(windows(spark, d), done, "observation_id", "start", 50).select("observation_id", "start", "end", "batch")
