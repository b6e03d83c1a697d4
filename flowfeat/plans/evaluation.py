"""Queries of metrics, sweeps and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowfeat.functions import levels
from flowfeat.operators import evaluate as E
from flowfeat.operators import profile as P
from flowfeat.plans._base import query
from flowfeat.sources.bindings import CELLS, OBS, PRED, cells, ev, obs, pred, table, wx

CUT = "CASE WHEN score >= 3.2 THEN 'HIGH' WHEN score < 1.4 THEN 'LOW' ELSE 'MEDIUM' END"


def guessed(spark, d):
    return pred(spark, d).withColumn("guess", levels.bucket_from_score(F.col("score"), 1.4, 3.2))


def sql_metrics(source: str, by: str = "") -> str:
    """Metrics of rows (a, p, n) by the given columns."""
    g = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    n = ", ".join(f"coalesce(sum(n) FILTER (a = '{a}' AND p = '{p}'), 0)::DOUBLE AS {a[0]}{p[0]}" for a in E.CLASSES for p in E.CLASSES)
    rat = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END"
    pr = ", ".join(f"{rat(c + c, f'(L{c} + M{c} + H{c})')} AS p{c}, {rat(c + c, f'({c}L + {c}M + {c}H)')} AS r{c}, {c}L + {c}M + {c}H AS n{c}" for c in "LMH")
    f1 = ", ".join(f"{rat(f'2 * p{c} * r{c}', f'(p{c} + r{c})')} AS f{c}" for c in "LMH")
    out = ", ".join(f"round(p{c[0]}, 6) AS precision_{c.lower()}, round(r{c[0]}, 6) AS recall_{c.lower()}, round(f{c[0]}, 6) AS f1_{c.lower()}" for c in E.CLASSES)
    total = "(nL + nM + nH)"
    return f""", m1 AS (SELECT {g}{n} FROM {source}{group}), m2 AS (SELECT *, {pr} FROM m1), m3 AS (SELECT *, {f1} FROM m2),
  met AS (SELECT {g}{out}, {total}::BIGINT AS n, round({rat('LL + MM + HH', total)}, 6) AS accuracy, round({rat('rL + rM + rH', '((nL > 0)::INT + (nM > 0)::INT + (nH > 0)::INT)')}, 6) AS balanced_accuracy, round((fL + fM + fH) / 3, 6) AS macro_f1, round({rat('fL * nL + fM * nM + fH * nH', total)}, 6) AS weighted_f1 FROM m3)"""


@query("k6_metrics", f"WITH {PRED}, s AS (SELECT bucket AS a, {CUT} AS p, 1 AS n FROM pred)" + sql_metrics("s") + " SELECT * FROM met")
def k6(spark, d):
    return E.metrics(E.confusion(guessed(spark, d), "bucket", "guess"))


@query("k10_segment_metrics", f"WITH {PRED}, s AS (SELECT grp, bucket AS a, {CUT} AS p, 1 AS n FROM pred)" + sql_metrics("s", "grp") + " SELECT * FROM met WHERE n >= 20")
def k10(spark, d):
    return E.segment_metrics(guessed(spark, d), "bucket", "guess", ["grp"])


@query("k7_ordinal_errors", f"WITH {PRED} SELECT sup, count(*) AS n, round(avg(abs(score - rank)), 6) AS mae, round(sqrt(avg((score - rank) * (score - rank))), 6) AS rmse, round(avg(score - rank), 6) AS bias, round(avg((abs(score - rank) >= 2)::INT), 6) AS severe_share FROM pred GROUP BY 1")
def k7(spark, d):
    return E.ordinal_errors(pred(spark, d), "rank", "score", ["sup"])


@query("k8_calibration_bins", f"WITH {PRED}, g AS (SELECT least(floor(p_high * 0.8 * 10), 9)::INT AS bin, count(*) AS n, avg(p_high * 0.8) AS mp, avg((bucket = 'HIGH')::INT) AS s FROM pred GROUP BY 1) SELECT b.bin::INT AS bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_p, round(s, 6) AS share FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN g USING (bin)")
def k8(spark, d):
    return E.calibration_bins(pred(spark, d).withColumn("p", F.col("p_high") * 0.8), "p", F.col("bucket") == "HIGH")


@query("k9_calibration_summary", f"WITH {PRED}, y AS (SELECT p_high AS p, (bucket = 'HIGH')::INT::DOUBLE AS y, greatest(1e-6, least(1 - 1e-6, p_high)) AS q, least(floor(p_high * 10), 9) AS b FROM pred), g AS (SELECT b, count(*) AS n, sum(p) AS sp, sum(y) AS sy, sum((p - y) * (p - y)) AS sb, sum(-(y * ln(q) + (1 - y) * ln(1 - q))) AS sl FROM y GROUP BY 1) SELECT round(sum(abs(sp - sy)) / sum(n), 6) AS ece, round(sum(sb) / sum(n), 6) AS brier, round(sum(sl) / sum(n), 6) AS log_loss FROM g")
def k9(spark, d):
    return E.calibration_summary(pred(spark, d), "p_high", F.col("bucket") == "HIGH")


SWEEP = [round(0.05 + 0.01 * i, 2) for i in range(86)]
SWEPT = f"WITH {PRED}, t AS (SELECT unnest({SWEEP})::DOUBLE AS threshold), s AS (SELECT threshold, {{by}}bucket AS a, CASE WHEN p_high >= threshold THEN 'HIGH' WHEN score < 1.4 THEN 'LOW' ELSE 'MEDIUM' END AS p, 1 AS n FROM pred, t)"


def swept(spark, d, by=()):
    rows = pred(spark, d).withColumns({"other": F.when(F.col("score") < 1.4, "LOW").otherwise("MEDIUM"), "month": F.month("date")})
    return E.high_sweep(rows, "p_high", "bucket", "other", SWEEP, list(by))


@query("k11_threshold_sweep", SWEPT.format(by="") + sql_metrics("s", "threshold") + " SELECT * FROM met")
def k11(spark, d):
    return swept(spark, d)


SHOWN = "precision_high, recall_high, f1_high, balanced_accuracy"
ORDERS = {
    "balanced": ("true", "f1_high DESC, balanced_accuracy DESC, precision_high DESC, recall_high DESC"),
    "prudent": ("recall_high >= 0.4", "recall_high >= 0.4 DESC, precision_high DESC, recall_high DESC, balanced_accuracy DESC"),
    "safety_first": ("precision_high >= 0.25", "precision_high >= 0.25 DESC, recall_high DESC, f1_high DESC, balanced_accuracy DESC"),
}


@query("k11_pick_threshold", SWEPT.format(by="") + sql_metrics("s", "threshold") + " " + " UNION ALL ".join(f"(SELECT '{k}' AS policy, threshold, {SHOWN}, {met} AS met_floor FROM met ORDER BY {order}, threshold LIMIT 1)" for k, (met, order) in ORDERS.items()))
def k11b(spark, d):
    sweep = swept(spark, d)
    return E.pick_threshold(sweep).union(E.pick_threshold(sweep, "prudent")).union(E.pick_threshold(sweep, "safety_first"))


@query("k14_segment_thresholds", SWEPT.format(by="month(date)::INT AS month, ") + sql_metrics("s", "threshold, month") + " " + " UNION ALL ".join(f"(SELECT month, '{k}' AS policy, threshold, {SHOWN}, {met} AS met_floor FROM met QUALIFY row_number() OVER (PARTITION BY month ORDER BY {order}, threshold) = 1)" for k, (met, order) in ORDERS.items() if k != "prudent"))
def k14(spark, d):
    sweep = swept(spark, d, ["month"])
    return E.pick_threshold(sweep, "balanced", ["month"]).union(E.pick_threshold(sweep, "safety_first", ["month"]))


PAIR_TIES = {"balanced": "round(abs(low - 1.5), 9)", "prudent": "high DESC", "safety_first": "high"}


@query("k12_pick_pair", f"WITH {PRED}, l AS (SELECT unnest({E.ORDINAL_LOWS})::DOUBLE AS low), h AS (SELECT unnest({E.ORDINAL_HIGHS})::DOUBLE AS high), s AS (SELECT low, high, bucket AS a, CASE WHEN score >= high THEN 'HIGH' WHEN score < low THEN 'LOW' ELSE 'MEDIUM' END AS p, 1 AS n FROM pred, l, h WHERE low < high)" + sql_metrics("s", "low, high") + " " + " UNION ALL ".join(f"(SELECT '{k}' AS policy, low, high, {SHOWN} FROM met ORDER BY {order}, {PAIR_TIES[k]}, low, high LIMIT 1)" for k, (_, order) in ORDERS.items()))
def k12b(spark, d):
    sweep = E.two_threshold_sweep(pred(spark, d), "score", "bucket", E.ORDINAL_LOWS, E.ORDINAL_HIGHS)
    return E.pick_pair(sweep).union(E.pick_pair(sweep, "prudent")).union(E.pick_pair(sweep, "safety_first"))


LOWS, HIGHS = [0.5, 1.0, 1.5, 2.0], [2.0, 2.5, 3.0, 3.5]


@query("k12_two_thresholds", f"WITH {PRED}, s AS (SELECT low, high, bucket AS a, CASE WHEN score >= high THEN 'HIGH' WHEN score < low THEN 'LOW' ELSE 'MEDIUM' END AS p, 1 AS n FROM pred, (SELECT unnest({LOWS})::DOUBLE AS low) l, (SELECT unnest({HIGHS})::DOUBLE AS high) h WHERE low < high)" + sql_metrics("s", "low, high") + " SELECT * FROM met")
def k12(spark, d):
    return E.two_threshold_sweep(pred(spark, d), "score", "bucket", LOWS, HIGHS)


CANDIDATES = [[a, a + g, a + 2 * g, a + 3 * g, a + 4 * g] for a in (0.3, 0.6, 0.9) for g in (0.2, 0.7, 0.9)]
VALID = [c for c in CANDIDATES if all(b - a >= 0.25 for a, b in zip(c, c[1:]))]


@query("k13_cutpoints", f"WITH {PRED}, c AS (SELECT unnest(range({len(VALID)}))::INT AS candidate, unnest({VALID})::DOUBLE[] AS cuts), s AS (SELECT candidate, cuts, abs(len(list_filter(cuts, lambda x: x <= score)) - rank) AS e FROM pred, c), g AS (SELECT candidate, round(list_sum([abs(cuts[i] - (i - 0.5)) for i in range(1, len(cuts) + 1)]) * 0.001, 6) AS drift, round(avg(e), 6) AS mae, round(avg((e = 0)::INT), 6) AS accuracy, round(avg((e >= 2)::INT), 6) AS severe_share FROM s GROUP BY 1, 2) SELECT *, row_number() OVER (ORDER BY coalesce(nullif(mae, 0), 99), accuracy DESC, coalesce(nullif(severe_share, 0), 1), drift, candidate)::INT AS rank FROM g")
def k13(spark, d):
    return E.cutpoint_candidates(pred(spark, d), "score", "rank", CANDIDATES)


@query("k13_search")
def k13s(spark, d):
    found = E.search_cutpoints(pred(spark, d), "score", "rank")
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(found)], "cutpoint int, at double")


@query("k15_ensemble", f"WITH {PRED}, m AS (SELECT observation_id, score, p_high, 1.0 AS w FROM pred UNION ALL SELECT observation_id, 5 - score, p_high * p_high, 0.5 FROM pred WHERE grp % 2 = 0) SELECT observation_id, count(*) AS models, round(sum(score * w) / sum(w), 6) AS score, round(sum(p_high * w) / sum(w), 6) AS p_high FROM m GROUP BY 1")
def k15(spark, d):
    a = pred(spark, d).select("observation_id", "score", "p_high", "grp", F.lit(1.0).alias("w"))
    b = a.filter("grp % 2 = 0").withColumns({"score": 5 - F.col("score"), "p_high": F.col("p_high") * F.col("p_high"), "w": F.lit(0.5)})
    return E.ensemble(a.union(b), "observation_id", "w", ["score", "p_high"])


STDS = [0.1, 0.2, 0.3, 0.4]


@query("k16_uncertainty", f"WITH {PRED}, s AS (SELECT sqrt(p_high * (1 - p_high)) AS std, {CUT} <> bucket AS wrong, abs(score - rank) AS e FROM pred) SELECT threshold, count(*) FILTER (std >= threshold) AS n, round(count(*) FILTER (std >= threshold) / count(*)::DOUBLE, 6) AS share, round(coalesce(avg(e) FILTER (std >= threshold), 0), 6) AS mean_error, round(coalesce(avg(wrong::INT) FILTER (std >= threshold), 0), 6) AS error_rate FROM s, (SELECT unnest({STDS})::DOUBLE AS threshold) t GROUP BY 1")
def k16(spark, d):
    rows = guessed(spark, d).withColumn("std", F.sqrt(F.col("p_high") * (1 - F.col("p_high"))))
    return E.uncertainty_buckets(rows, "std", F.col("guess") != F.col("bucket"), F.abs(F.col("score") - F.col("rank")), STDS)


@query("k17_rare_class", f"WITH {PRED} SELECT grp, count(*) AS n, count(*) FILTER ({CUT} <> 'HIGH') AS missed, count(*) FILTER (abs(score - rank) >= 2) AS severe FROM pred WHERE rank = 4 GROUP BY 1")
def k17(spark, d):
    return E.rare_class_report(guessed(spark, d), F.col("rank") == 4, F.col("guess") == "HIGH", F.col("score") - F.col("rank"), "grp")


@query("k17_worst", f"WITH {PRED} SELECT observation_id, round(score - rank, 6) AS error FROM pred WHERE rank = 4 ORDER BY score - rank, observation_id LIMIT 20")
def k17b(spark, d):
    return E.rare_class_worst(pred(spark, d), F.col("rank") == 4, F.col("score") - F.col("rank"), "observation_id").select("observation_id", F.round("error", 6).alias("error"))


PAST = f"WITH {OBS}, c AS (SELECT bucket, count(*) OVER (PARTITION BY site ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS n FROM obs)"


def past(spark, d):
    from flowfeat.operators.history import counts_before

    return counts_before(obs(spark, d), ["site"], "date", {"n_before": F.lit(1)})


@query("k18_history_profile", PAST + ", h AS (SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 5 THEN '1_5' WHEN n <= 20 THEN '6_20' ELSE '20_plus' END AS history, bucket FROM c) SELECT history, bucket, count(*) AS n, round(sum(count(*)) OVER (PARTITION BY history) / (SELECT count(*) FROM h), 6)::DOUBLE AS fraction FROM h GROUP BY 1, 2")
def k18(spark, d):
    return E.history_profile(past(spark, d), "n_before", "bucket")


@query("k18_history_quantiles", PAST + " SELECT " + ", ".join(f"round(quantile_cont(n, {q}), 6) AS p{int(q * 100):02d}" for q in P.QUANTILES) + " FROM c")
def k18b(spark, d):
    return P.quantiles(past(spark, d), "n_before")


@query("k5_feature_vector", f"WITH {OBS} SELECT observation_id, array_to_string([coalesce(rank, -9999)::INT, coalesce(nullif(sup, 2), 7)::INT], ',') AS v FROM obs")
def k5(spark, d):
    o = obs(spark, d).withColumn("s", F.nullif(F.col("sup"), F.lit(2)))
    return o.select("observation_id", F.array_join(E.feature_vector(["rank", "s"], defaults={"s": 7.0}).cast("array<int>").cast("array<string>"), ",").alias("v"))


@query("k21_run_comparison", f"WITH {PRED}, s AS (SELECT grp AS run, sup AS split, bucket AS a, {CUT} AS p, 1 AS n FROM pred)" + sql_metrics("s", "run, split") + ", r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY f1_high DESC, balanced_accuracy DESC, recall_high DESC, precision_high DESC, run DESC) AS k FROM met) SELECT split, f1_high, balanced_accuracy, recall_high, precision_high, run FROM r WHERE k = 1")
def k21(spark, d):
    rows = guessed(spark, d).withColumnsRenamed({"grp": "run", "sup": "split"})
    return E.run_comparison(E.metrics(E.confusion(rows, "bucket", "guess", ["run", "split"]), ["run", "split"]))


@query("k21_split_gap", f"WITH {PRED}, s AS (SELECT grp AS run, sup AS split, bucket AS a, {CUT} AS p, 1 AS n FROM pred)" + sql_metrics("s", "run, split") + ", g AS (SELECT max(f1_high) FILTER (split = 0) AS first, max(f1_high) FILTER (split = 1) AS second FROM met WHERE run % 2 = 0) SELECT *, round(first - second, 6) AS gap FROM g WHERE first IS NOT NULL AND second IS NOT NULL")
def k21b(spark, d):
    rows = guessed(spark, d).withColumnsRenamed({"grp": "run", "sup": "split"})
    return E.split_gap(E.metrics(E.confusion(rows, "bucket", "guess", ["run", "split"]), ["run", "split"]), F.col("run") % 2 == 0, F.col("split") == 0, F.col("split") == 1)


@query("k19_fit_and_score")
def k19(spark, d):
    from flowfeat.operators.history import recent_history, temporal_split

    rows = temporal_split(recent_history(obs(spark, d)), 0.2, 0.0).filter("bucket IS NOT NULL")
    rows = rows.withColumn("month", F.month("date"))
    families = {"site_history": ["n_365", "high_365", "mean_rank_365"], "history": ["grp"], "weather": ["month"], "physical": ["price"]}
    return E.fit_and_score(rows.filter("split = 'train'"), rows.filter("split = 'test'"), families, "bucket", list(E.VARIANTS))


@query("k20_batch_scoring")
def k20(spark, d):
    from flowfeat.operators.history import recent_history, temporal_split

    rows = temporal_split(recent_history(obs(spark, d)), 0.2, 0.0).filter("bucket IS NOT NULL").withColumn("month", F.month("date"))
    cols = ["n_365", "high_365", "mean_rank_365", "month", "price"]
    return E.score_with_overlay(rows.filter("split = 'train'"), rows.filter("split = 'test'"), cols, "bucket", 0.35).select("observation_id", "bucket", "p_low", "p_medium", "p_high", "base", "predicted")


@query("k20_ordinal_scoring")
def k20b(spark, d):
    from flowfeat.operators.history import recent_history, temporal_split

    rows = temporal_split(recent_history(obs(spark, d)), 0.2, 0.2).withColumn("month", F.month("date"))
    cols = ["n_365", "high_365", "mean_rank_365", "month", "price"]
    model, low, high = E.fit_ordinal(rows.filter("split = 'train'"), rows.filter("split = 'calibration'"), cols, "rank", "bucket", trees=5)
    return E.score_ordinal(model, rows.filter("split = 'test'"), cols, low, high).select("observation_id", "bucket", F.round("score", 4).alias("score"), "predicted")


# profiles

COVER = ["rank", "bucket", "price", "level", "grp", "status"]


@query("d10_coverage", f"WITH {OBS}, l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM obs" for c in COVER) + ") SELECT feature, count(v) AS present, count(*) - count(v) AS missing, count(*) FILTER (v IS NOT NULL AND try_cast(v AS DOUBLE) IS NULL) AS invalid, count(DISTINCT v) AS n_distinct, count(v) = 0 AS all_missing, (count(*) - count(v)) / count(*)::DOUBLE >= 0.95 AS mostly_missing, count(v) > 0 AND count(DISTINCT v) = 1 AS is_constant FROM l GROUP BY 1")
def d10(spark, d):
    return P.coverage(obs(spark, d), COVER)


@query("d11_select_informative", f"WITH {OBS} SELECT observation_id, rank FROM obs")
def d11(spark, d):
    o = obs(spark, d).select("observation_id", "rank", F.lit(1).alias("same"), F.lit(None).cast("double").alias("empty"))
    return P.select_informative(o, P.coverage(o, ["rank", "same", "empty"]))


@query("d12_family_coverage", f"WITH {OBS} SELECT 'label' AS family, 2 AS features, round(avg((rank IS NULL)::INT), 6) AS missing_fraction FROM obs UNION ALL SELECT 'other', 4, 0")
def d12(spark, d):
    return P.family_coverage(P.coverage(obs(spark, d), COVER), F.when(F.col("feature").isin("rank", "bucket"), "label").otherwise("other"))


@query("d13_quantiles", f"WITH {OBS} SELECT sup, " + ", ".join(f"round(quantile_cont(price, {q}), 6) AS p{int(q * 100):02d}" for q in P.QUANTILES) + " FROM obs GROUP BY 1")
def d13(spark, d):
    return P.quantiles(obs(spark, d), "price", ["sup"])


@query("d14_gini", f"WITH {OBS}, c AS (SELECT count(*) AS x FROM obs GROUP BY site), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM c) SELECT count(*) AS keys, round(2 * sum(i * x) / (count(*) * sum(x))::DOUBLE - (count(*) + 1) / count(*)::DOUBLE, 6) AS gini FROM r")
def d14(spark, d):
    return P.gini(obs(spark, d), "site")


@query("d15_frequency", f"WITH {OBS} SELECT site, count(*) AS n, round(count(*) / (SELECT count(*) FROM obs)::DOUBLE, 6) AS share FROM obs GROUP BY 1 ORDER BY n DESC, site LIMIT 25")
def d15(spark, d):
    return P.frequency(obs(spark, d), "site", 25)


@query("d16_label_crosstab", f"WITH {OBS} SELECT year(date)::INT AS year, month(date)::INT AS month, bucket AS label, (4 * grouping(year(date)::INT) + 2 * grouping(month(date)::INT) + grouping(bucket))::BIGINT AS g, count(*) AS n FROM obs GROUP BY CUBE (year(date)::INT, month(date)::INT, bucket)")
def d16(spark, d):
    return P.label_crosstab(obs(spark, d), "date", "bucket")


@query("d17_same_day_conflicts", f"WITH {OBS}, g AS (SELECT count(*) AS n, count(DISTINCT bucket) AS k FROM obs WHERE bucket IS NOT NULL GROUP BY grp, date) SELECT count(*) AS groups, count(*) FILTER (k > 1) AS conflicting, sum(CASE WHEN k > 1 THEN n ELSE 0 END)::BIGINT AS rows_involved FROM g")
def d17(spark, d):
    return P.same_day_conflicts(obs(spark, d), ["grp", "date"], "bucket")


@query("d18_label_profile", f"WITH {OBS} SELECT grp, count(*) AS n, round(avg((bucket = 'LOW')::INT), 6) AS share_low, round(avg((bucket = 'MEDIUM')::INT), 6) AS share_medium, round(avg((bucket = 'HIGH')::INT), 6) AS share_high FROM obs WHERE bucket IS NOT NULL GROUP BY 1 HAVING count(*) >= 400 ORDER BY n DESC, grp LIMIT 15")
def d18(spark, d):
    return P.label_profile(obs(spark, d), "grp", "bucket", E.CLASSES, 400, 15)


@query("d19_flag_profile", f"WITH {OBS} SELECT 'high' AS flag, count(*) FILTER (bucket = 'HIGH') AS n, round(count(*) FILTER (bucket = 'HIGH') / count(*)::DOUBLE, 6) AS share FROM obs UNION ALL SELECT 'large', count(*) FILTER (price > 300000), round(count(*) FILTER (price > 300000) / count(*)::DOUBLE, 6) FROM obs")
def d19(spark, d):
    return P.flag_profile(obs(spark, d), {"high": F.col("bucket") == "HIGH", "large": F.col("price") > 300000})


def numeric_sql(c):
    return f"""SELECT '{c}' AS feature, count({c}) AS n, {', '.join(f'round(quantile_cont({c}, {q}), 6) AS "{n}"' for q, n in ((0.0, 'min'), (0.01, 'p01'), (0.1, 'p10'), (0.5, 'median'), (0.9, 'p90'), (0.99, 'p99'), (1.0, 'max')))}, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, round(avg(({c} = 0)::INT), 6) AS zero_fraction, round(avg(({c} < 0)::INT), 6) AS negative_fraction,
  (SELECT count(*) FROM cells, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM cells) f WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS outliers FROM cells"""


@query("d20_numeric_profile", f"WITH {CELLS} " + " UNION ALL ".join(map(numeric_sql, ("elevation", "slope", "clay"))))
def d20(spark, d):
    return P.numeric_profile(cells(spark, d), ["elevation", "slope", "clay"])


@query("d21_categorical_profile", "WITH l AS (SELECT 'o_orderpriority' AS feature, o_orderpriority AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR FROM orders), c AS (SELECT feature, v, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT feature, v AS value, n, row_number() OVER (PARTITION BY feature ORDER BY n DESC, v)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 20")
def d21(spark, d):
    return P.categorical_profile(table(spark, d, "orders"), ["o_orderpriority", "o_custkey"])


CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1 :]]


@query("d22_correlations", "WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, count(*) AS n FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in PAIRS) + ") SELECT a, b, round(r, 6) AS r, n FROM p WHERE abs(r) >= 0.003 AND n >= 100")
def d22(spark, d):
    return P.strong_correlations(table(spark, d, "lineitem"), CORR, 0.003, 100)


@query("d23_signal_summary", """WITH r AS (SELECT *, doc_id % 3 AS level, CASE WHEN n_chars % 4 < 2 THEN 'exact' ELSE 'close' END AS agreement, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS k FROM documents),
  l AS (SELECT lang, source, string_agg(level || ':' || n, ' ' ORDER BY level) AS levels FROM (SELECT lang, source, level, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1, 2), g AS (SELECT lang, source, string_agg(agreement || ':' || n, ' ' ORDER BY agreement) AS agreements FROM (SELECT lang, source, agreement, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1, 2),
  s AS (SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_rank, round(avg(n_chars - 100), 6) AS mean_delta, md5(string_agg(text, '|' ORDER BY doc_id) FILTER (k <= 3)) AS examples FROM r GROUP BY 1, 2)
  SELECT s.*, levels, agreements FROM s JOIN l ON s.lang IS NOT DISTINCT FROM l.lang AND s.source IS NOT DISTINCT FROM l.source JOIN g ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source""")
def d23(spark, d):
    rows = table(spark, d, "documents").withColumns({"level": F.col("doc_id") % 3, "agreement": F.when(F.col("n_chars") % 4 < 2, "exact").otherwise("close")})
    out = P.signal_summary(rows, ["lang", "source"], "n_chars", F.col("n_chars") - 100, "text", "doc_id", {"levels": "level", "agreements": "agreement"})
    told = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x["key"], F.lit(":"), x["value"].cast("string"))), " ").alias(c)
    return out.select("lang", "source", "n", "mean_rank", "mean_delta", F.md5(F.array_join("examples", "|")).alias("examples"), told("levels"), told("agreements"))


@query("d24_stage_profile", "WITH s AS (SELECT event_type AS status, 'k' AS stage, (props::JSON ->> 'k')::DOUBLE AS seconds FROM events UNION ALL SELECT event_type, 'value', value FROM events) SELECT stage, count(*) AS n, round(sum(seconds), 4) AS total, round(avg(seconds), 6) AS mean, max(seconds) AS max, count(*) FILTER (status = 'error') AS errors FROM s GROUP BY 1")
def d24(spark, d):
    e = ev(spark, d).select("event_type", F.create_map(F.lit("k"), F.get_json_object("props", "$.k").cast("double"), F.lit("value"), F.col("value")).alias("m"))
    return P.stage_profile(e, "m", "event_type")


@query("d25_user_rollup", """WITH a AS (SELECT CASE WHEN event_id % 2 = 0 THEN ' User É' || user_id ELSE 'user é' || user_id || ' ' END AS name, ts, 'e' || event_id AS url FROM events), b AS (SELECT 'USER É' || o_custkey AS name, o_orderdate::TIMESTAMP AS ts, 'o' || o_orderkey AS url FROM orders),
  n AS (SELECT lower(trim(name)) AS u, trim(name) AS spelling, ts, url, 'a' AS k FROM a UNION ALL SELECT lower(trim(name)), trim(name), ts, url, 'b' FROM b)
  SELECT u, arg_min(spelling, struct_pack(t := ts, u := url)) AS spelling, count(*) FILTER (k = 'a') AS n_a, count(*) FILTER (k = 'b') AS n_b, max(ts) AS last_at, max(struct_pack(t := ts, u := url)).u AS last_url, CASE WHEN min(k) <> max(k) THEN 'both' ELSE min(k) END AS sources FROM n GROUP BY 1""")
def d25(spark, d):
    k = F.col("event_id")
    a = ev(spark, d).select(F.when(k % 2 == 0, F.concat(F.lit(" User É"), "user_id")).otherwise(F.concat(F.lit("user é"), "user_id", F.lit(" "))).alias("name"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("e"), "event_id").alias("url"))
    b = table(spark, d, "orders").select(F.concat(F.lit("USER É"), "o_custkey").alias("name"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.concat(F.lit("o"), "o_orderkey").alias("url"))
    return P.user_rollup(a, b, "name").withColumnRenamed("key", "u")


@query("b14_validation", f"WITH {CELLS}, k AS (SELECT *, row * 10 + col AS id FROM cells), i AS (SELECT 'slope_range' AS issue, id FROM k WHERE NOT slope < 25 UNION ALL SELECT 'elevation_floor', id FROM k WHERE NOT elevation >= 100), r AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY id) AS j FROM i) SELECT issue, count(*) AS n, string_agg(id, ',' ORDER BY id) FILTER (j <= 3) AS examples FROM r GROUP BY 1")
def b14(spark, d):
    rows = cells(spark, d).withColumn("id", F.col("row") * 10 + F.col("col"))
    out = P.validate_rows(rows, {"slope_range": F.col("slope") < 25, "elevation_floor": F.col("elevation") >= 100, "code_range": F.col("code").between(0, 9)}, "id")
    return out.withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


@query("b15_warnings", f"WITH {CELLS} SELECT row, col, array_to_string(list_filter([CASE WHEN clay > 50 THEN 'clay' END, CASE WHEN slope > 20 THEN 'steep' END, CASE WHEN NOT valid THEN 'void' END], lambda x: x IS NOT NULL), ',') AS warnings FROM cells")
def b15(spark, d):
    w = P.warnings({"void": ~F.col("valid"), "steep": F.col("slope") > 20, "clay": F.col("clay") > 50})
    return cells(spark, d).select("row", "col", F.array_join(w, ",").alias("warnings"))


@query("d28_grouping_counts", "SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def d28(spark, d):
    return P.grouping_counts(table(spark, d, "documents"), ["lang", "source"])


@query("h22_ratios_and_entropy", f"""WITH {OBS}, w AS (SELECT l_suppkey AS target, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS precipitation FROM lineitem GROUP BY 1, 2), y AS (SELECT target, year(date) AS year, sum(precipitation) AS annual, count(*) AS n FROM w GROUP BY 1, 2),
  f AS (SELECT w.target, w.date, precipitation AS p, annual AS a, n, precipitation / annual AS s FROM w JOIN y ON w.target = y.target AND year(w.date) = y.year WHERE annual > 0)
  SELECT target, date, round(p / (a / 52.1775), 6) AS week_ratio, round(p / (a / 12), 6) AS month_ratio, round(p * a, 6) AS product, round(a / (a + 1000), 6) AS confidence, round(n / (n + 20.0), 6) AS history_confidence, round(s - 1.0::DOUBLE / n, 6) AS lift,
         round((CASE WHEN s > 0 THEN -s * ln(s) ELSE 0 END + CASE WHEN s < 1 THEN -(1 - s) * ln(1 - s) ELSE 0 END) / ln(2), 6) AS entropy FROM f""")
def h22b(spark, d):
    w = wx(spark, d).select("target", "date", "precipitation", F.year("date").alias("year"))
    y = w.groupBy("target", "year").agg(F.sum("precipitation").alias("annual"), F.count("*").alias("n"))
    p, a, n = F.col("precipitation"), F.col("annual"), F.col("n")
    return w.join(y, ["target", "year"]).filter("annual > 0").select(
        "target", "date", levels.safe_ratio(p, a / 52.1775).alias("week_ratio"), levels.safe_ratio(p, a / 12).alias("month_ratio"), levels.safe_product(p, a).alias("product"), levels.confidence(a, 1000.0).alias("confidence"),
        levels.confidence(n, 20.0).alias("history_confidence"), F.round(p / a - F.lit(1.0) / n, 6).alias("lift"), levels.entropy([p / a, 1 - p / a]).alias("entropy"),
    )


SEEDS = {"mean_annual_precip": (31, 1500), "precip_7d": (7, 90), "precip_30d": (11, 300), "api_93": (13, 200), "max_precip_7d": (17, 60), "rain_7d": (19, 80), "snowfall_14d": (23, 40), "degree_days_14d": (29, 100), "runoff_potential": (37, 10), "flashiness": (41, 5), "basin_area": (43, 4), "upstream_area": (47, 500),
         "fraction_above_1500m": (53, 2), "site_count": (59, 9), "group_count": (61, 99), "supergroup_count": (67, 999), "global_p_high": (71, 3), "supergroup_p_high": (73, 4), "group_p_high": (79, 5), "group_p_low": (83, 6), "site_p_high": (89, 7), "site_p_medium": (97, 3), "site_p_low": (101, 8)}


def seeded_sql(k):
    return ", ".join(f"CASE WHEN {k} % {a} > 0 THEN ({k} * {a} % {b}) / 8.0::DOUBLE END AS {n}" for n, (a, b) in SEEDS.items())


E14_SQL = {
    "precip_7d_weekly_climatology_ratio": "CASE WHEN abs(mean_annual_precip / 52.1775) >= 1e-9 THEN precip_7d / (mean_annual_precip / 52.1775) END", "precip_30d_monthly_climatology_ratio": "CASE WHEN abs(mean_annual_precip / 12) >= 1e-9 THEN precip_30d / (mean_annual_precip / 12) END",
    "api_93_monthly_climatology_ratio": "CASE WHEN abs(mean_annual_precip / 12) >= 1e-9 THEN api_93 / (mean_annual_precip / 12) END", "runoff_precip_7d_signal": "precip_7d * runoff_potential", "runoff_precip_30d_signal": "precip_30d * runoff_potential", "flash_flood_7d_signal": "max_precip_7d * flashiness",
    "basin_precip_volume_30d_proxy": "precip_30d * coalesce(nullif(basin_area, 0), upstream_area)", "rain_on_snow_7d_signal": "rain_7d * snowfall_14d", "snowmelt_degree_day_14d_signal": "degree_days_14d * snowfall_14d", "high_elevation_snowmelt_signal": "degree_days_14d * snowfall_14d * fraction_above_1500m",
    "site_history_confidence": "CASE WHEN site_count > 0 THEN site_count / (site_count + 10) ELSE 0 END", "group_history_confidence": "CASE WHEN group_count > 0 THEN group_count / (group_count + 20) ELSE 0 END", "supergroup_history_confidence": "CASE WHEN supergroup_count > 0 THEN supergroup_count / (supergroup_count + 30) ELSE 0 END",
    "site_high_prior_lift": "site_p_high - group_p_high", "site_low_prior_lift": "site_p_low - group_p_low", "group_high_prior_lift": "group_p_high - supergroup_p_high", "supergroup_high_prior_lift": "supergroup_p_high - coalesce(global_p_high, 0)",
    "site_prior_entropy": "CASE WHEN t > 0 THEN (CASE WHEN site_p_low > 0 THEN -site_p_low / t * ln(site_p_low / t) ELSE 0 END + CASE WHEN site_p_medium > 0 THEN -site_p_medium / t * ln(site_p_medium / t) ELSE 0 END + CASE WHEN site_p_high > 0 THEN -site_p_high / t * ln(site_p_high / t) ELSE 0 END) / ln(3) END", "high_low_prior_spread": "site_p_high - site_p_low",
}


@query("e14_derived_features", f"WITH s AS (SELECT o_orderkey, {seeded_sql('o_orderkey')} FROM orders), t AS (SELECT *, coalesce(site_p_low, 0) + coalesce(site_p_medium, 0) + coalesce(site_p_high, 0) AS t FROM s) SELECT o_orderkey, {', '.join(f'round({v}, 6) AS {k}' for k, v in E14_SQL.items())} FROM t")
def e14(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", *[F.when(k % a > 0, (k * a % b) / 8.0).alias(n) for n, (a, b) in SEEDS.items()])
    return rows.select("o_orderkey", *[c.alias(n) for n, c in levels.derived_features(F.col).items()])
