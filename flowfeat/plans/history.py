"""Queries about what was known before, consensus, snapshots and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowfeat.functions import levels, text
from flowfeat.operators import history as H
from flowfeat.plans._base import query
from flowfeat.sources.bindings import OBS, obs, table

BEFORE = "OVER (PARTITION BY {key} ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)"


def counts(prefix, key):
    return ", ".join(f"count(*) FILTER (bucket = '{c}') {BEFORE.format(key=key)} AS {prefix}_{c.lower()}" for c in H.CLASSES)


def priors(prefix, parent, s):
    n = f"({prefix}_low + {prefix}_medium + {prefix}_high)"
    if not parent:
        return ", ".join(f"CASE WHEN {n} > 0 THEN {prefix}_{c} / {n}::DOUBLE ELSE 1 / 3.0::DOUBLE END AS {prefix}_p_{c}" for c in ("low", "medium", "high"))
    return ", ".join(f"({prefix}_{c} + {s} * {parent}_p_{c}) / ({n} + {s})::DOUBLE AS {prefix}_p_{c}" for c in ("low", "medium", "high"))


def chain(period, strengths):
    p = f", {period}" if period else ""
    out = f", c AS (SELECT *, {counts('global', period or '1')}, {counts('supergroup', 'sup' + p)}, {counts('grouped', 'grp' + p)}, {counts('own', 'site' + p)} FROM obs{'2' if period else ''})"
    steps = [("global", None, 0), ("supergroup", "global", strengths[0]), ("grouped", "supergroup", strengths[1]), ("own", "grouped", strengths[2])]
    last = "c"
    for prefix, parent, s in steps:
        out += f", p_{prefix} AS (SELECT *, {priors(prefix, parent, s)} FROM {last})"
        last = f"p_{prefix}"
    return out


PICK = ", ".join(f"{a}_{c} AS {b}_{c}, round({a}_p_{c}, 6) AS {b}_p_{c}" for a, b in (("global", "global"), ("supergroup", "supergroup"), ("grouped", "group"), ("own", "site")) for c in ("low", "medium", "high"))


@query("e8_causal_priors", f"WITH {OBS}{chain(None, (30, 20, 10))} SELECT observation_id, {PICK} FROM p_own")
def e8(spark, d):
    out = H.causal_priors(obs(spark, d))
    return out.select("observation_id", *[F.round(f"{n}_{p}{c}", 6).alias(f"{n}_{p}{c}") if p else F.col(f"{n}_{c}") for n in ("global", "supergroup", "group", "site") for c in ("low", "medium", "high") for p in ("", "p_")])


@query("e9_causal_signals", f"WITH {OBS}, c AS (SELECT *, count(*) {BEFORE.format(key='site')} AS rows_before, count(*) FILTER (status = 'P') {BEFORE.format(key='site')} AS partial_before, count(*) FILTER (price > 300000) {BEFORE.format(key='site')} AS large_before FROM obs) SELECT observation_id, rows_before, partial_before, large_before, CASE WHEN rows_before > 0 THEN round(partial_before / rows_before::DOUBLE, 6) ELSE 0 END AS partial_ratio, partial_before >= 2 AS partial_flag, CASE WHEN rows_before > 0 THEN round(large_before / rows_before::DOUBLE, 6) ELSE 0 END AS large_ratio, large_before >= 2 AS large_flag FROM c")
def e9(spark, d):
    out = H.causal_signals(obs(spark, d), "site", "date", {"partial": F.col("status") == "P", "large": F.col("price") > 300000})
    return out.select("observation_id", "rows_before", *[f"{n}_{k}" for n in ("partial", "large") for k in ("before", "ratio", "flag")])


SEASON = "CASE WHEN month(date) IN (12, 1, 2) THEN 'DJF' WHEN month(date) <= 5 THEN 'MAM' WHEN month(date) <= 8 THEN 'JJA' ELSE 'SON' END"


@query("e10_seasonal_priors", f"WITH {OBS}, obs2 AS (SELECT *, {SEASON} AS season FROM obs){chain('season', (20, 15, 8))}, r AS (SELECT *, sum(rank) {BEFORE.format(key='site, season')} AS rs, count(rank) {BEFORE.format(key='site, season')} AS rn FROM p_own) SELECT observation_id, {PICK}, CASE WHEN rn > 0 THEN round(rs / rn::DOUBLE, 6) END AS mean_rank FROM r")
def e10(spark, d):
    out = H.seasonal_priors(obs(spark, d).withColumn("season", levels.season(F.col("date"))), "season")
    return out.select("observation_id", "mean_rank", *[F.round(f"{n}_{p}{c}", 6).alias(f"{n}_{p}{c}") if p else F.col(f"{n}_{c}") for n in ("global", "supergroup", "group", "site") for c in ("low", "medium", "high") for p in ("", "p_")])


def recent(n):
    w = f"OVER (PARTITION BY site ORDER BY date RANGE BETWEEN INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)"
    return f"count(bucket) {w} AS n_{n}, count(*) FILTER (bucket = 'HIGH') {w} AS h_{n}, sum(rank) {w} AS r_{n}"


RECENT = ", ".join(recent(n) for n in (30, 90, 365))
RECENT_OUT = ", ".join(f"n_{n}, CASE WHEN n_{n} > 0 THEN round(h_{n} / n_{n}::DOUBLE, 6) ELSE 0 END AS high_{n}" for n in (30, 90, 365)) + ", CASE WHEN n_365 > 0 THEN round(r_365 / n_365::DOUBLE, 6) END AS mean_rank_365"
RECENT_COLS = [f"{k}_{n}" for n in (30, 90, 365) for k in ("n", "high")] + ["mean_rank_365"]


@query("e11_recent_history", f"WITH {OBS}, c AS (SELECT *, {RECENT} FROM obs) SELECT observation_id, {RECENT_OUT} FROM c")
def e11(spark, d):
    return H.recent_history(obs(spark, d)).select("observation_id", *RECENT_COLS)


LAST = f"max(CASE WHEN rank IS NOT NULL THEN struct_pack(d := date, i := observation_id, r := rank) END) {BEFORE.format(key='site')}"


@query("e12_last_observation", f"WITH {OBS}, l AS (SELECT site, date, max(struct_pack(i := observation_id, r := rank)) AS m FROM obs WHERE rank IS NOT NULL GROUP BY 1, 2) SELECT o.observation_id, (o.date - l.date)::INT AS days_since, l.m.r AS last_rank FROM obs o ASOF LEFT JOIN l ON o.site = l.site AND o.date > l.date")
def e12(spark, d):
    return H.last_observation(obs(spark, d)).select("observation_id", "days_since", "last_rank")


@query("e22_serving_features", f"""WITH {OBS}, q AS (SELECT DISTINCT site, date + 7 AS date FROM obs WHERE bucket IS NULL), a AS (SELECT site, date, bucket, rank, false AS asked FROM obs UNION ALL SELECT site, date, NULL, NULL, true FROM q), c AS (SELECT *, {RECENT} FROM a),
  l AS (SELECT site, date, max(struct_pack(i := observation_id, r := rank)) AS m FROM obs WHERE rank IS NOT NULL GROUP BY 1, 2)
  SELECT c.site, c.date, {RECENT_OUT}, (c.date - l.date)::INT AS days_since, l.m.r AS last_rank FROM c ASOF LEFT JOIN l ON c.site = l.site AND c.date > l.date WHERE asked""")
def e22(spark, d):
    o = obs(spark, d)
    return H.serving_features(o, o.filter("bucket IS NULL").select("site", F.date_add("date", 7).alias("date"))).select("site", "date", *RECENT_COLS, "days_since", "last_rank")


@query("e13_recent_snapshot", f"WITH {OBS} SELECT site, " + ", ".join(f"count(*) FILTER (bucket IS NOT NULL AND date BETWEEN DATE '2000-06-30' - {n} AND DATE '2000-06-30') AS n_{n}, count(*) FILTER (bucket = 'HIGH' AND date BETWEEN DATE '2000-06-30' - {n} AND DATE '2000-06-30') AS high_{n}" for n in (30, 90, 365)) + " FROM obs GROUP BY 1")
def e13(spark, d):
    return H.recent_snapshot(obs(spark, d), "2000-06-30")


def snap(own, base, s):
    return ", ".join(f"({own}.{c} + {s} * {base}.p_{c}) / ({own}.low + {own}.medium + {own}.high + {s})::DOUBLE AS p_{c}" for c in ("low", "medium", "high"))


N3 = ", ".join(f"count(*) FILTER (bucket = '{c}') AS {c.lower()}" for c in H.CLASSES)


SIGNALS = "count(*) AS rows, count(*) FILTER (status = 'P') AS partial_n, count(*) FILTER (price > 300000) AS large_n"


@query("d8_prior_snapshot", f"""WITH {OBS}, g AS (SELECT {N3}, {SIGNALS} FROM obs), gp AS (SELECT *, low / (low + medium + high)::DOUBLE AS p_low, medium / (low + medium + high)::DOUBLE AS p_medium, high / (low + medium + high)::DOUBLE AS p_high FROM g),
  s AS (SELECT sup, {N3}, {SIGNALS} FROM obs GROUP BY 1), sp AS (SELECT s.*, {snap('s', 'gp', 30)} FROM s, gp),
  m AS (SELECT grp, sup, {N3}, {SIGNALS} FROM obs GROUP BY 1, 2), mp AS (SELECT m.*, {snap('m', 'sp', 20)} FROM m JOIN sp USING (sup)),
  c AS (SELECT site, min(grp) AS grp, {N3}, {SIGNALS} FROM obs GROUP BY 1), cp AS (SELECT c.*, {snap('c', 'mp', 10)} FROM c JOIN mp USING (grp)),
  u AS (SELECT 'global' AS level, NULL::BIGINT AS key, * FROM gp UNION ALL BY NAME SELECT 'supergroup' AS level, sup AS key, * EXCLUDE (sup) FROM sp UNION ALL BY NAME SELECT 'group' AS level, grp AS key, * EXCLUDE (grp, sup) FROM mp UNION ALL BY NAME SELECT 'site' AS level, site AS key, * EXCLUDE (site, grp) FROM cp)
  SELECT level, key, low, medium, high, rows, partial_n, large_n, round(p_low, 6) AS p_low, round(p_medium, 6) AS p_medium, round(p_high, 6) AS p_high, round(partial_n / rows::DOUBLE, 6) AS partial_ratio, round(large_n / rows::DOUBLE, 6) AS large_ratio,
    CASE WHEN level = 'site' THEN partial_n >= 2 END AS partial_flag, CASE WHEN level = 'site' THEN large_n >= 2 END AS large_flag, CASE WHEN level = 'site' THEN partial_n >= 2 OR large_n >= 2 END AS atypical FROM u""")
def d8(spark, d):
    out = H.prior_snapshot(obs(spark, d), {"partial": F.col("status") == "P", "large": F.col("price") > 300000})
    return out.withColumns({f"p_{c}": F.round(f"p_{c}", 6) for c in ("low", "medium", "high")})


def periods_sql(period, names):
    base = lambda own, b, s: ", ".join(f"({own}.{c} + {s} * {b}.p_{c}) / ({own}.low + {own}.medium + {own}.high + {s})::DOUBLE AS p_{c}" for c in ("low", "medium", "high"))
    fill = "coalesce(low, 0) AS low, coalesce(medium, 0) AS medium, coalesce(high, 0) AS high"
    of = lambda k, more="": f"(SELECT {k}, p, {N3}{more} FROM l GROUP BY 1, 2)"
    return f"""WITH {OBS}, t AS (SELECT unnest({names}) AS p), l AS (SELECT *, {period} AS p FROM obs WHERE bucket IS NOT NULL AND rank IS NOT NULL),
  ctx AS (SELECT site, arg_min(grp, struct_pack(d := date, i := observation_id)) AS grp, arg_min(sup, struct_pack(d := date, i := observation_id)) AS sup FROM obs GROUP BY 1),
  g0 AS (SELECT t.p, {fill} FROM t LEFT JOIN (SELECT p, {N3} FROM l GROUP BY 1) x USING (p)), g AS (SELECT *, {", ".join(f"CASE WHEN low + medium + high > 0 THEN {c} / (low + medium + high)::DOUBLE ELSE 1 / 3.0::DOUBLE END AS p_{c}" for c in ("low", "medium", "high"))} FROM g0),
  s0 AS (SELECT e.sup, t.p, {fill} FROM (SELECT DISTINCT sup FROM obs) e CROSS JOIN t LEFT JOIN {of('sup')} x ON x.sup = e.sup AND x.p = t.p), s AS (SELECT a.*, {base('a', 'g', 20)} FROM s0 a JOIN g USING (p)),
  m0 AS (SELECT e.grp, e.sup, t.p, {fill} FROM (SELECT grp, arg_min(sup, site) AS sup FROM ctx GROUP BY 1) e CROSS JOIN t LEFT JOIN {of('grp')} x ON x.grp = e.grp AND x.p = t.p), m AS (SELECT a.*, {base('a', 's', 15)} FROM m0 a JOIN s ON s.sup = a.sup AND s.p = a.p),
  c0 AS (SELECT e.site, e.grp, t.p, {fill}, r FROM ctx e CROSS JOIN t LEFT JOIN {of('site', ', avg(rank) AS r')} x ON x.site = e.site AND x.p = t.p), c AS (SELECT a.*, {base('a', 'm', 8)} FROM c0 a JOIN m ON m.grp = a.grp AND m.p = a.p),
  u AS (SELECT 'global' AS level, NULL::BIGINT AS key, p, low, medium, high, p_low, p_medium, p_high, NULL::DOUBLE AS r FROM g UNION ALL SELECT 'supergroup', sup, p, low, medium, high, p_low, p_medium, p_high, NULL FROM s UNION ALL SELECT 'group', grp, p, low, medium, high, p_low, p_medium, p_high, NULL FROM m UNION ALL SELECT 'site', site, p, low, medium, high, p_low, p_medium, p_high, r FROM c)
  SELECT level, key, p AS period, low, medium, high, round(p_low, 6) AS p_low, round(p_medium, 6) AS p_medium, round(p_high, 6) AS p_high, round(r, 6) AS mean_rank FROM u"""


ROUNDED = {f"p_{c}": F.round for c in ("low", "medium", "high")}


@query("d9_temporal_snapshot", periods_sql("month(date)::INT", "range(1, 13)::INT[]"))
def d9(spark, d):
    return H.temporal_snapshot(obs(spark, d), F.month("date"), list(range(1, 13))).withColumns({k: f(k, 6) for k, f in ROUNDED.items()})


@query("d9_season_snapshot", periods_sql(SEASON, "['DJF', 'MAM', 'JJA', 'SON']"))
def d9b(spark, d):
    return H.temporal_snapshot(obs(spark, d), levels.season(F.col("date")), ["DJF", "MAM", "JJA", "SON"]).withColumns({k: f(k, 6) for k, f in ROUNDED.items()})


def reference_sql(level, key):
    inside = lambda n: f"bucket IS NOT NULL AND rank IS NOT NULL AND date >= ref - {n}"
    sums = ", ".join(f"count(*) FILTER ({inside(n)}) AS n_{n}, CASE WHEN count(*) FILTER ({inside(n)}) > 0 THEN round(count(*) FILTER ({inside(n)} AND bucket = 'HIGH') / count(*) FILTER ({inside(n)})::DOUBLE, 6) ELSE 0 END AS high_{n}" for n in (30, 90, 365))
    site = level == "site"
    more = (f"round(avg(rank) FILTER ({inside(365)}), 6)", "max(date) FILTER (bucket IS NOT NULL AND rank IS NOT NULL)", "arg_max(rank, struct_pack(d := date, i := -observation_id)) FILTER (bucket IS NOT NULL AND rank IS NOT NULL)") if site else ("NULL::DOUBLE", "NULL::DATE", "NULL::INT")
    return f"SELECT '{level}' AS level, {key}::BIGINT AS key, {sums}, {more[0]} AS mean_rank_365, {more[1]} AS last_date, {more[2]} AS last_rank FROM obs, r GROUP BY {key}"


@query("d9_reference_snapshot", f"WITH {OBS}, r AS (SELECT max(date) AS ref FROM obs WHERE bucket IS NOT NULL AND rank IS NOT NULL) " + " UNION ALL ".join(reference_sql(*x) for x in (("supergroup", "sup"), ("group", "grp"), ("site", "site"))))
def d9c(spark, d):
    return H.reference_snapshot(obs(spark, d))


MOMENTS = """moments AS (SELECT event_id AS observation_id, user_id AS site, user_id % 25 AS grp, user_id % 5 AS sup, ts AS date, ['LOW', 'MEDIUM', 'HIGH', 'HIGH', NULL][event_id % 5 + 1] AS bucket, [1, 2, 3, 4, NULL][event_id % 5 + 1]::INT AS rank FROM events)"""


def moments(spark, d):
    k = F.col("event_id") % 5
    return table(spark, d, "events").select(
        F.col("event_id").alias("observation_id"), F.col("user_id").alias("site"), (F.col("user_id") % 25).alias("grp"), (F.col("user_id") % 5).alias("sup"), F.col("ts").alias("date"),
        F.when(k == 0, "LOW").when(k == 1, "MEDIUM").when(k < 4, "HIGH").alias("bucket"), F.when(k < 4, k + 1).cast("int").alias("rank"),
    )


def intraday_chain():
    out = chain(None, (30, 20, 10)).replace("FROM obs)", "FROM moments)")
    return out.replace("INTERVAL 1 DAY PRECEDING", "INTERVAL 1 MICROSECOND PRECEDING")


@query("e8_intraday_priors", f"WITH {MOMENTS}{intraday_chain()} SELECT observation_id, {PICK} FROM p_own")
def e8i(spark, d):
    out = H.causal_priors(moments(spark, d))
    return out.select("observation_id", *[F.round(f"{n}_{p}{c}", 6).alias(f"{n}_{p}{c}") if p else F.col(f"{n}_{c}") for n in ("global", "supergroup", "group", "site") for c in ("low", "medium", "high") for p in ("", "p_")])


INTRADAY = ", ".join(f"(SELECT count(bucket) FROM moments b WHERE b.site = a.site AND b.date < a.date AND b.date >= date_trunc('day', a.date) - INTERVAL {n} DAY) AS n_{n}, (SELECT count(*) FROM moments b WHERE b.site = a.site AND bucket = 'HIGH' AND b.date < a.date AND b.date >= date_trunc('day', a.date) - INTERVAL {n} DAY) AS h_{n}, (SELECT sum(rank) FROM moments b WHERE b.site = a.site AND b.date < a.date AND b.date >= date_trunc('day', a.date) - INTERVAL {n} DAY) AS r_{n}" for n in (7, 365))


@query("e11_intraday_history", f"WITH {MOMENTS}, c AS (SELECT a.observation_id, {INTRADAY} FROM moments a) SELECT observation_id, n_7, CASE WHEN n_7 > 0 THEN round(h_7 / n_7::DOUBLE, 6) ELSE 0 END AS high_7, n_365, CASE WHEN n_365 > 0 THEN round(h_365 / n_365::DOUBLE, 6) ELSE 0 END AS high_365, CASE WHEN n_365 > 0 THEN round(r_365 / n_365::DOUBLE, 6) END AS mean_rank_365 FROM c")
def e11i(spark, d):
    return H.recent_history(moments(spark, d), days=(7, 365)).select("observation_id", "n_7", "high_7", "n_365", "high_365", "mean_rank_365")


@query("e12_intraday_last", f"WITH {MOMENTS}, l AS (SELECT site, date, max(struct_pack(i := observation_id, r := rank)) AS m FROM moments WHERE rank IS NOT NULL GROUP BY 1, 2) SELECT o.observation_id, (o.date::DATE - l.date::DATE)::INT AS days_since, l.m.r AS last_rank FROM moments o ASOF LEFT JOIN l ON o.site = l.site AND o.date > l.date")
def e12i(spark, d):
    return H.last_observation(moments(spark, d)).select("observation_id", "days_since", "last_rank")


@query("c13_layered_lookup", f"WITH {OBS}, s AS (SELECT sup, round(avg(price), 4) AS v FROM obs GROUP BY 1), g AS (SELECT grp, round(avg(price), 4) AS v FROM obs WHERE grp % 2 = 0 GROUP BY 1), c AS (SELECT site, round(avg(price), 4) AS v FROM obs WHERE site % 10 = 3 GROUP BY 1) SELECT observation_id, coalesce(c.v, g.v, s.v, 0) AS v, CASE WHEN c.v IS NOT NULL THEN 'canyon' WHEN g.v IS NOT NULL THEN 'massif' WHEN s.v IS NOT NULL THEN 'region' ELSE 'defaults' END AS source FROM obs LEFT JOIN s USING (sup) LEFT JOIN g USING (grp) LEFT JOIN c USING (site)")
def c13(spark, d):
    o = obs(spark, d)
    mean = lambda k, f: o.filter(f).groupBy(k).agg(F.round(F.avg("price"), 4).alias("v"))
    return H.resolve_lookup(o, [("region", mean("sup", "true"), "sup"), ("massif", mean("grp", "grp % 2 = 0"), "grp"), ("canyon", mean("site", "site % 10 = 3"), "site")], "v", 0.0).select("observation_id", "v", "source")


@query("c12_contradictions", f"WITH {OBS}, l AS (SELECT * FROM obs WHERE bucket IS NOT NULL) SELECT a.site, count(*) AS pairs, count(*) FILTER ((a.bucket = 'LOW' AND b.bucket = 'HIGH') OR (a.bucket = 'HIGH' AND b.bucket = 'LOW')) AS contradictory, round(count(*) FILTER ((a.bucket = 'LOW' AND b.bucket = 'HIGH') OR (a.bucket = 'HIGH' AND b.bucket = 'LOW')) / count(*)::DOUBLE, 6) AS fraction FROM l a JOIN l b ON a.site = b.site AND a.observation_id < b.observation_id AND abs(a.date - b.date) <= 30 GROUP BY 1")
def c12(spark, d):
    return H.near_term_contradictions(obs(spark, d), 30)


def votes(spark, d):
    o = obs(spark, d).withColumns({"quality": F.col("observation_id") % 20 / 10.0, "agreement": F.when(F.col("observation_id") % 3 == 0, "conflict").when(F.col("observation_id") % 3 == 1, "agree").otherwise("none"), "month": F.trunc("date", "month")})
    return H.consensus(o, ["grp", "month"])


VOTES = f"""WITH {OBS}, r AS (SELECT *, date_trunc('month', date)::DATE AS month, greatest(0.1, least(1.5, observation_id % 20 / 10.0::DOUBLE)) * CASE observation_id % 3 WHEN 0 THEN 0.35 WHEN 1 THEN 1.1 ELSE 1.0 END::DOUBLE AS w FROM obs WHERE bucket IS NOT NULL),
  a AS (SELECT grp, month, count(*) AS n, sum(w) AS weight, {', '.join(f"count(*) FILTER (bucket = '{c}') AS n_{c.lower()}, coalesce(sum(w) FILTER (bucket = '{c}'), 0) AS w_{c.lower()}" for c in H.CLASSES)}, sum(w * rank) AS wr, sum(w * rank * rank) AS wr2, count(*) FILTER (observation_id % 3 = 0) AS text_conflicts, min(observation_id) AS representative FROM r GROUP BY 1, 2),
  p AS (SELECT *, w_low / weight AS pl, w_medium / weight AS pm, w_high / weight AS ph, greatest(w_low, w_medium, w_high) / weight AS best FROM a),
  v AS (SELECT grp, month, n, round(weight, 6) AS weight, n_low, n_medium, n_high, round(pl, 6) AS p_low, round(pm, 6) AS p_medium, round(ph, 6) AS p_high, round(wr / weight, 6) AS soft_rank, round(greatest(0, wr2 / weight - (wr / weight) * (wr / weight)), 6) AS rank_variance,
         round((CASE WHEN pl > 0 THEN -pl * ln(pl) ELSE 0 END + CASE WHEN pm > 0 THEN -pm * ln(pm) ELSE 0 END + CASE WHEN ph > 0 THEN -ph * ln(ph) ELSE 0 END) / ln(3), 6) AS entropy, round(best, 6) AS confidence,
         (pl >= best - 1e-9)::INT + (pm >= best - 1e-9)::INT + (ph >= best - 1e-9)::INT > 1 AS tie, n_low > 0 AND n_high > 0 AS low_high, text_conflicts, CASE WHEN ph >= best - 1e-9 THEN 'HIGH' WHEN pm >= best - 1e-9 THEN 'MEDIUM' ELSE 'LOW' END AS top, representative FROM p)"""


@query("d2_consensus", VOTES + " SELECT * FROM v")
def d2(spark, d):
    return votes(spark, d)


@query("d3_gate", VOTES + " SELECT grp, month, CASE WHEN tie THEN 'tie' WHEN low_high THEN 'low_high_conflict' WHEN confidence < 0.5 THEN 'low_confidence' END AS reason FROM v")
def d3(spark, d):
    return H.gate(votes(spark, d)).select("grp", "month", "reason")


@query("d6_balanced_weights", VOTES + ", w AS (SELECT grp, month, confidence * (1 - 0.35 * entropy) * (1 - 0.5 * low_high::INT) * (1 + 0.08 * least(ln(1.0 + n), 2.0)) / sqrt(count(*) OVER (PARTITION BY grp)) AS raw FROM v) SELECT grp, month, round(raw / avg(raw) OVER (), 6) AS sample_weight FROM w")
def d6(spark, d):
    return H.balanced_weights(votes(spark, d), "grp").select("grp", "month", "sample_weight")


@query("d7_class_balanced", f"WITH {OBS}, l AS (SELECT * FROM obs WHERE bucket IS NOT NULL), n AS (SELECT bucket, count(*) AS n FROM l GROUP BY 1) SELECT observation_id, round((SELECT sum(n) FROM n) / ((SELECT count(*) FROM n) * n)::DOUBLE, 9) AS class_weight FROM l JOIN n USING (bucket)")
def d7(spark, d):
    return H.class_balanced(obs(spark, d), "bucket").select("observation_id", F.round("class_weight", 9).alias("class_weight"))


@query("d4_representative", f"WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date, observation_id) AS k FROM obs) SELECT site, date, observation_id, level, price FROM n WHERE k = 1")
def d4(spark, d):
    from flowfeat.operators.merge import dedup_first

    return dedup_first(obs(spark, d), ["site"], ["date", "observation_id"]).select("site", "date", "observation_id", "level", "price")


@query("d5_concat_comments", "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS md5 FROM conversations WHERE trim(text) <> '' GROUP BY 1")
def d5(spark, d):
    from flowfeat.sources.bindings import table

    c = table(spark, d, "conversations").filter(F.trim("text") != "")
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")).alias("md5"))


@query("k1_temporal_split", f"WITH {OBS}, r AS (SELECT observation_id, row_number() OVER (ORDER BY date, observation_id) - 1 AS k, count(*) OVER () AS n FROM obs) SELECT observation_id, CASE WHEN k >= n - floor(n * 0.2::DOUBLE) THEN 'test' WHEN k >= n - floor(n * 0.2::DOUBLE) - floor(n * 0.1::DOUBLE) THEN 'calibration' ELSE 'train' END AS split FROM r")
def k1(spark, d):
    return H.temporal_split(obs(spark, d), 0.2, 0.1).select("observation_id", "split")


UNIT = "('0x' || substr(sha1('{seed}:' || {key}), 1, 12))::BIGINT::DOUBLE / 281474976710655"


@query("k2_cold_site_split", f"WITH {OBS}, s AS (SELECT site, count(*) AS n, {UNIT.format(seed='7', key='site')} AS u FROM obs GROUP BY 1), b AS (SELECT site, coalesce(sum(n) OVER (ORDER BY u, site ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM s) SELECT observation_id, CASE WHEN b < t * 0.2::DOUBLE THEN 'test' WHEN b < t * (0.2::DOUBLE + 0.1::DOUBLE) THEN 'calibration' ELSE 'train' END AS split FROM obs JOIN b USING (site)")
def k2(spark, d):
    return H.cold_entity_split(obs(spark, d), text.stable_unit("7", F.col("site")), 0.2, 0.1).select("observation_id", "split")


@query("k3_stratified_holdout", f"WITH {OBS}, t AS (SELECT observation_id, site, year(date) AS year, level, {UNIT.format(seed='3', key='observation_id')} AS u FROM obs), s AS (SELECT *, row_number() OVER (PARTITION BY year, level ORDER BY u) AS k, least(40, greatest(2, round(count(*) OVER (PARTITION BY year, level) * 0.1))) AS target FROM t), c AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY u) AS j FROM s WHERE k <= target) SELECT observation_id FROM c WHERE j <= 8")
def k3(spark, d):
    days = obs(spark, d).withColumn("year", F.year("date"))
    return H.stratified_holdout(days, text.stable_unit("3", F.col("observation_id"))).select("observation_id")


@query("k4_history_dropout", f"WITH {OBS} SELECT observation_id, CASE WHEN {UNIT.format(seed='9', key='observation_id')} < 0.25 THEN 0 ELSE price END AS price FROM obs")
def k4(spark, d):
    return H.history_dropout(obs(spark, d), text.stable_unit("9", F.col("observation_id")), 0.25, ["price"]).select("observation_id", "price")
