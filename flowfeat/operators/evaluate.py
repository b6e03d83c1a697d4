"""Metrics, calibration, threshold sweeps and model fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowfeat.sources.shared import cut

CLASSES = ["LOW", "MEDIUM", "HIGH"]


def feature_vector(cols: list[str], missing: float = -9999.0, defaults: dict[str, float] | None = None) -> Column:
    """K5: values in order, missing ones as the sentinel or the feature's own default."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit((defaults or {}).get(c, missing))) for c in cols])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(pred: DataFrame, actual: str, predicted: str, by: list[str] = []) -> DataFrame:
    """One row per segment with the nine counts n_<actual>_<predicted>."""
    cells = [F.sum(((F.col(actual) == a) & (F.col(predicted) == p)).cast("long")).alias(f"n_{a.lower()}_{p.lower()}") for a in CLASSES for p in CLASSES]
    return pred.groupBy(*by).agg(*cells)


def metrics(counts: DataFrame, by: list[str] = []) -> DataFrame:
    """K6: accuracy, balanced accuracy, macro and weighted F1, precision, recall and F1 per class from confusion counts; empty ratios are 0."""
    n = lambda a, p: F.col(f"n_{a.lower()}_{p.lower()}")
    total = sum((n(a, p) for a in CLASSES for p in CLASSES), F.lit(0))
    out, recalls, f1s, weighted, present = {}, [], [], F.lit(0.0), []
    for c in CLASSES:
        row, col = sum((n(c, p) for p in CLASSES), F.lit(0)), sum((n(a, c) for a in CLASSES), F.lit(0))
        precision, recall = _ratio(n(c, c), col), _ratio(n(c, c), row)
        f1 = _ratio(2 * precision * recall, precision + recall)
        out |= {f"precision_{c.lower()}": F.round(precision, 6), f"recall_{c.lower()}": F.round(recall, 6), f"f1_{c.lower()}": F.round(f1, 6)}
        recalls.append(recall)
        f1s.append(f1)
        present.append((row > 0).cast("int"))
        weighted = weighted + f1 * row
    k = sum(present, F.lit(0))
    out |= {"n": total, "accuracy": F.round(_ratio(sum((n(c, c) for c in CLASSES), F.lit(0)), total), 6), "balanced_accuracy": F.round(_ratio(sum(recalls, F.lit(0.0)), k), 6), "macro_f1": F.round(sum(f1s, F.lit(0.0)) / 3, 6), "weighted_f1": F.round(_ratio(weighted, total), 6)}
    return counts.select(*by, *[v.alias(k) for k, v in out.items()])


def ordinal_errors(pred: DataFrame, actual: str, score: str, by: list[str] = []) -> DataFrame:
    """K7: mean absolute, root mean squared and mean signed error of the score, and the share of errors of two levels or more."""
    e = F.col(score) - F.col(actual)
    return pred.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(e), 6).alias("bias"), F.round(F.avg((F.abs(e) >= 2).cast("int")), 6).alias("severe_share"))


def calibration_bins(pred: DataFrame, p: str, hit: Column, bins: int = 10) -> DataFrame:
    """K8: per bin of the probability (the last one closed, empty ones kept) count, mean probability and share of hits."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    got = pred.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(hit.cast("int")).alias("share"))
    every = pred.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(got, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean_p", 6).alias("mean_p"), F.round("share", 6).alias("share"))


def calibration_summary(pred: DataFrame, p: str, hit: Column, bins: int = 10) -> DataFrame:
    """K8, K9: expected calibration error, Brier score and log-loss (probabilities kept 1e-6 off 0 and 1)."""
    y = hit.cast("double")
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(p)))
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = pred.groupBy(at).agg(F.count("*").alias("n"), F.sum(p).alias("sp"), F.sum(y).alias("sy"), F.sum((F.col(p) - y) * (F.col(p) - y)).alias("sb"), F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("sl"))
    return per.agg(F.round(F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("sb") / F.sum("n"), 6).alias("brier"), F.round(F.sum("sl") / F.sum("n"), 6).alias("log_loss"))


def history_bucket(n: Column) -> Column:
    """K10, K18."""
    return F.when(n == 0, "0").when(n <= 5, "1_5").when(n <= 20, "6_20").otherwise("20_plus")


def segment_metrics(pred: DataFrame, actual: str, predicted: str, by: list[str], least: int = 20) -> DataFrame:
    """Metrics per segment of at least ``least`` rows."""
    return metrics(confusion(pred, actual, predicted, by), by).filter(F.col("n") >= least)


def high_sweep(pred: DataFrame, p_high: str, actual: str, other: str, thresholds: list[float], by: list[str] = []) -> DataFrame:
    """Metrics of "HIGH from the threshold on, else ``other``" at every threshold.

    Rows are counted once by (number of thresholds passed, actual, other); cumulative sums of that small table give every
    candidate's confusion counts, so the data is read once, not once per threshold.
    """
    passed = F.size(F.filter(F.lit(sorted(thresholds)), lambda t: t <= F.col(p_high)))
    cells = pred.groupBy(*by, passed.alias("k"), F.col(actual).alias("a"), F.col(other).alias("o")).agg(F.count("*").alias("n"))
    at = F.posexplode(F.lit(sorted(thresholds))).alias("i", "threshold")
    each = cells.select(*by, "k", "a", "o", "n", at).withColumn("p", F.when(F.col("k") > F.col("i"), "HIGH").otherwise(F.col("o")))
    counts = each.groupBy(*by, "threshold").agg(*[F.sum(F.when((F.col("a") == a) & (F.col("p") == p), F.col("n")).otherwise(0)).alias(f"n_{a.lower()}_{p.lower()}") for a in CLASSES for p in CLASSES])
    return metrics(counts, [*by, "threshold"])


# Floors that a policy asks for.
RECALL_FLOOR, PRECISION_FLOOR = 0.4, 0.25


def _policy(policy: str, tied: list[Column]) -> list[Column]:
    """What a policy ranks candidates by, best first. A candidate that misses the floor ranks below those that meet it, but may still be picked."""
    precision, recall, f1, balanced = map(F.col, ("precision_high", "recall_high", "f1_high", "balanced_accuracy"))
    return {"balanced": [f1, balanced, precision, recall], "prudent": [(recall >= RECALL_FLOOR).cast("int"), precision, recall, balanced], "safety_first": [(precision >= PRECISION_FLOOR).cast("int"), recall, f1, balanced]}[policy] + tied


def pick_threshold(sweep: DataFrame, policy: str = "balanced", by: list[str] = []) -> DataFrame:
    """The best threshold of each segment. balanced: F1 of HIGH, balanced accuracy, precision, recall; prudent: precision, recall, balanced accuracy, first of
    all where recall is ``RECALL_FLOOR``; safety_first: recall, F1, balanced accuracy, first of all where precision is ``PRECISION_FLOOR``. Of equal ones the
    lowest. A segment always has one, even if none meets the floor: ``met_floor`` tells."""
    shown = ["precision_high", "recall_high", "f1_high", "balanced_accuracy"]
    best = sweep.groupBy(*by).agg(F.max_by(F.struct("threshold", *shown), F.struct(*_policy(policy, [-F.col("threshold")]))).alias("__b"))
    met = {"balanced": F.lit(True), "prudent": F.col("__b.recall_high") >= RECALL_FLOOR, "safety_first": F.col("__b.precision_high") >= PRECISION_FLOOR}[policy]
    return best.select(*by, F.lit(policy).alias("policy"), "__b.*", met.alias("met_floor"))


# The grid of an ordinal score's two thresholds.
ORDINAL_LOWS = [round(x / 10, 2) for x in range(5, 26)]
ORDINAL_HIGHS = [round(x / 10, 2) for x in range(22, 51)]


def pick_pair(sweep: DataFrame, policy: str = "balanced", by: list[str] = []) -> DataFrame:
    """The best pair (low, high) by the policies of ``pick_threshold``; ties go to the low threshold nearest to 1.5 (balanced), the higher (prudent) or the
    lower high one (safety_first), then to the first in order of (low, high)."""
    tied = {"balanced": -F.round(F.abs(F.col("low") - 1.5), 9), "prudent": F.col("high"), "safety_first": -F.col("high")}[policy]
    shown = ["precision_high", "recall_high", "f1_high", "balanced_accuracy"]
    best = sweep.groupBy(*by).agg(F.max_by(F.struct("low", "high", *shown), F.struct(*_policy(policy, [tied, -F.col("low"), -F.col("high")]))).alias("__b"))
    return best.select(*by, F.lit(policy).alias("policy"), "__b.*")


def two_threshold_sweep(pred: DataFrame, score: str, actual: str, lows: list[float], highs: list[float]) -> DataFrame:
    """Metrics of bucket_from_score for every low < high, from counts of the score between all thresholds."""
    cuts = sorted({*lows, *highs})
    cells = pred.groupBy(F.size(F.filter(F.lit(cuts), lambda t: t <= F.col(score))).alias("k"), F.col(actual).alias("a")).agg(F.count("*").alias("n"))
    pairs = [(lo, hi, cuts.index(lo), cuts.index(hi)) for lo in lows for hi in highs if lo < hi]
    listed = "[" + ",".join(f'{{"low":{lo},"high":{hi},"i":{i},"j":{j}}}' for lo, hi, i, j in pairs) + "]"
    grid = F.explode(F.from_json(F.lit(listed), "array<struct<low:double,high:double,i:int,j:int>>")).alias("g")
    each = cells.select("k", "a", "n", grid).withColumn("p", F.when(F.col("k") > F.col("g.j"), "HIGH").when(F.col("k") <= F.col("g.i"), "LOW").otherwise("MEDIUM"))
    counts = each.groupBy(F.col("g.low").alias("low"), F.col("g.high").alias("high")).agg(*[F.sum(F.when((F.col("a") == a) & (F.col("p") == p), F.col("n")).otherwise(0)).alias(f"n_{a.lower()}_{p.lower()}") for a in CLASSES for p in CLASSES])
    return metrics(counts, ["low", "high"])


def cutpoint_candidates(pred: DataFrame, score: str, actual: str, candidates: list[list[float]], gap: float = 0.25) -> DataFrame:
    """Candidate cutpoint vectors with their error, best first by (-MAE, accuracy, -severe share, -drift from .5, 1.5, ...); vectors with a gap under ``gap``
    are left out. As in the reference an error or severe share of exactly 0 counts as none told and comes last.

    Scores are counted between all cutpoints of all candidates; one round of a search is one job.
    """
    ok = [c for c in candidates if all(b - a >= gap for a, b in zip(c, c[1:]))]
    cuts = sorted({x for c in ok for x in c})
    cells = pred.groupBy(F.size(F.filter(F.lit(cuts), lambda t: t <= F.col(score))).alias("k"), F.col(actual).alias("a")).agg(F.count("*").alias("n"))
    options = F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.lit([cuts.index(x) for x in c]).alias("at"), F.lit(_drift(c)).alias("drift")) for i, c in enumerate(ok)])).alias("g")
    each = cells.select("k", "a", "n", options).withColumn("p", F.size(F.filter("g.at", lambda j: j < F.col("k"))))
    e = F.abs(F.col("p") - F.col("a"))
    out = each.groupBy(F.col("g.id").alias("candidate"), F.round("g.drift", 6).alias("drift")).agg(F.round(F.sum(e * F.col("n")) / F.sum("n"), 6).alias("mae"), F.round(F.sum(F.when(e == 0, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"), F.round(F.sum(F.when(e >= 2, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("severe_share"))
    told = lambda c, none: F.when(F.col(c) == 0, none).otherwise(F.col(c))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(told("mae", 99.0), F.desc("accuracy"), told("severe_share", 1.0), "drift", "candidate")))  # one row per candidate


def _drift(cutpoints: list[float]) -> float:
    return sum(abs(x - (i + 0.5)) for i, x in enumerate(cutpoints)) * 0.001


def search_cutpoints(pred: DataFrame, score: str, actual: str, gap: float = 0.25, rounds: int = 8) -> list[float]:
    """Five cutpoints by coordinate ascent from .5, 1.5, ... over grids of a twentieth, by the order of ``cutpoint_candidates``, for ``rounds`` rounds or until none changes.

    Scores are counted once between all grid values: a table of a hundred rows for each rank, which all steps of the search read.
    """
    grids = [[round(x / 20, 2) for x in range(a, b)] for a, b in ((5, 31), (20, 46), (40, 66), (56, 86), (70, 101))]
    cuts = sorted({x for g in grids for x in g} | {0.5, 1.5, 2.5, 3.5, 4.5})
    rows = pred.groupBy(F.size(F.filter(F.lit(cuts), lambda t: t <= F.col(score))).alias("k"), F.col(actual).alias("a")).agg(F.count("*").alias("n")).collect()
    total = sum(r["n"] for r in rows) or 1

    def value(c: list[float]) -> tuple[float, ...]:
        at = [cuts.index(x) for x in c]
        off = [(abs(sum(j < r["k"] for j in at) - r["a"]), r["n"]) for r in rows]
        mae, hit, severe = sum(e * n for e, n in off) / total, sum(n for e, n in off if e == 0) / total, sum(n for e, n in off if e >= 2) / total
        return -(mae or 99.0), hit, -(severe or 1.0), -_drift(c)

    now = [0.5, 1.5, 2.5, 3.5, 4.5]
    for _ in range(rounds):
        before = list(now)
        for i, grid in enumerate(grids):
            others = [[*now[:i], x, *now[i + 1 :]] for x in grid]
            now = max([now, *[c for c in others if all(a + gap <= b for a, b in zip(c, c[1:]))]], key=value)
        if now == before:
            break
    return now


def ensemble(predictions: DataFrame, ident: str, weight: str, cols: list[str]) -> DataFrame:
    """Weighted means over models of an id's scores."""
    return predictions.groupBy(ident).agg(F.count("*").alias("models"), *[F.round(F.sum(F.col(c) * F.col(weight)) / F.sum(weight), 6).alias(c) for c in cols])


def uncertainty_buckets(pred: DataFrame, std: str, wrong: Column, error: Column, thresholds: list[float]) -> DataFrame:
    """Per threshold the share of rows with at least that deviation, their mean error and error rate."""
    k = F.size(F.filter(F.lit(sorted(thresholds)), lambda t: t <= F.col(std)))
    per = pred.groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.sum(wrong.cast("int")).alias("w"), F.sum(error).alias("e"))
    total = per.agg(F.sum("n").alias("t"))
    each = per.select("k", "n", "w", "e", F.posexplode(F.lit(sorted(thresholds))).alias("i", "threshold")).withColumn("__in", F.col("k") > F.col("i"))
    part = lambda c: F.sum(F.when(F.col("__in"), F.col(c)).otherwise(0))
    out = each.groupBy("threshold").agg(part("n").alias("n"), part("w").alias("w"), part("e").alias("e")).crossJoin(F.broadcast(total))  # total is one row
    return out.select("threshold", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), F.round(_ratio(F.col("e"), F.col("n")), 6).alias("mean_error"), F.round(_ratio(F.col("w"), F.col("n")), 6).alias("error_rate"))


def rare_class_report(pred: DataFrame, actual: Column, predicted_ok: Column, error: Column, group: str) -> DataFrame:
    """Rows of a rare class per group, how many were missed, and errors of two levels or more."""
    return pred.filter(actual).groupBy(group).agg(F.count("*").alias("n"), F.sum((~predicted_ok).cast("long")).alias("missed"), F.sum((F.abs(error) >= 2).cast("long")).alias("severe"))


def rare_class_worst(pred: DataFrame, actual: Column, error: Column, ident: str, k: int = 20) -> DataFrame:
    """The k rows of a rare class whose level is most underrated, by (error, id)."""
    return pred.filter(actual).withColumn("error", error).orderBy("error", ident).limit(k)


def history_profile(rows: DataFrame, count: str, label: str) -> DataFrame:
    """Per bucket of rows' history counts (null is 0) and class (null: not labelled) the rows, and the bucket's share of all rows."""
    at = history_bucket(F.coalesce(F.col(count), F.lit(0)))
    per = rows.groupBy(at.alias("history"), label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over a row for each bucket and class
    return per.withColumn("fraction", F.round(F.sum("n").over(Window.partitionBy("history")) / F.sum("n").over(whole), 6))


def run_comparison(runs: DataFrame) -> DataFrame:
    """Per split mode the best run by (F1 of HIGH, balanced accuracy, recall, precision, name)."""
    rank = F.struct("f1_high", "balanced_accuracy", "recall_high", "precision_high", "run")
    return runs.groupBy("split").agg(F.max(rank).alias("b")).select("split", "b.*")


def split_gap(runs: DataFrame, run: Column, first: Column, second: Column, value: str = "f1_high") -> DataFrame:
    """One run's value under two split modes and the first less the second, as of a temporal and a cold-site split; no row unless both are there, a null value being 0."""
    at = lambda mode: F.max(F.when(mode, F.coalesce(F.col(value), F.lit(0.0))))
    out = runs.filter(run).agg(at(first).alias("first"), at(second).alias("second")).filter("first IS NOT NULL AND second IS NOT NULL")
    return out.withColumn("gap", F.round(F.col("first") - F.col("second"), 6))


#: Families of features that an ablation keeps.
VARIANTS = {
    "full": ["site_history", "history", "weather", "physical"],
    "no_site_history": ["history", "weather", "physical"],
    "no_lookup_history": ["site_history", "weather", "physical"],
    "history_only": ["site_history", "history"],
    "weather_only": ["weather"],
    "physical_only": ["physical"],
    "physical_weather_no_history": ["physical", "weather"],
}


def class_index(label: str) -> Column:
    """Null for labels that are none of the classes: such rows are neither learnt from nor counted."""
    return F.when(F.col(label) == "LOW", 0.0).when(F.col(label) == "MEDIUM", 1.0).when(F.col(label) == "HIGH", 2.0)


def fit_and_score(train: DataFrame, test: DataFrame, families: dict[str, list[str]], label: str, variants: list[str], trees: int = 10, depth: int = 5):
    """A random forest per ablation variant, fitted and scored by Spark ML; rows (variant, accuracy, importance of each family)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    index = class_index(label)
    needed = list(dict.fromkeys([label, *[c for v in variants for f in VARIANTS[v] for c in families.get(f, [])]]))
    train, test = (cut(df.filter(index.isNotNull()).select(*needed), "forest-rows") for df in (train, test))  # every variant reads them several times
    out = None
    for v in variants:
        cols = [c for f in VARIANTS[v] for c in families.get(f, [])]
        put = VectorAssembler(inputCols=cols, outputCol="features")
        fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(-9999.0)) for c in cols}
        ready = lambda df: put.transform(df.withColumns(fill).withColumn("y", index))  # noqa: E731, B023
        model = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=1).fit(ready(train))
        weights = {c: float(w) for c, w in zip(cols, model.featureImportances.toArray())}
        by = F.create_map(*[F.lit(x) for f in VARIANTS[v] for x in (f, sum(weights[c] for c in families.get(f, [])))])
        scored = model.transform(ready(test)).agg(F.count("*").alias("n"), F.round(F.avg((F.col("prediction") == F.col("y")).cast("int")), 6).alias("accuracy")).select(F.lit(v).alias("variant"), "n", "accuracy", by.alias("importance"))
        out = scored if out is None else out.unionByName(scored)
    return out


def score_with_overlay(train: DataFrame, test: DataFrame, cols: list[str], label: str, threshold: float, trees: int = 10, depth: int = 5) -> DataFrame:
    """Test rows with p_low, p_medium, p_high of a forest fitted on train, the likeliest class, and HIGH where p_high passes the threshold."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from flowfeat.functions.levels import apply_overlay, argmax_label

    put = VectorAssembler(inputCols=cols, outputCol="__features")
    fill = {c: F.coalesce(F.col(c).cast("double"), F.lit(-9999.0)) for c in cols}
    index = class_index(label)
    train = train.filter(index.isNotNull())
    model = RandomForestClassifier(labelCol="__y", featuresCol="__features", numTrees=trees, maxDepth=depth, seed=1).fit(put.transform(train.withColumns(fill).withColumn("__y", index)))
    out = model.transform(put.transform(test.withColumns(fill))).withColumn("__p", vector_to_array("probability"))
    p = [F.col("__p")[i] for i in range(3)]
    base = argmax_label(p)
    return out.select(*test.columns, *[F.round(x, 6).alias(f"p_{c.lower()}") for x, c in zip(p, CLASSES)], base.alias("base"), apply_overlay(base, p[2], threshold).alias("predicted"))


def fit_ordinal(train: DataFrame, calibration: DataFrame, cols: list[str], rank: str, label: str, weight: str | None = None, policy: str = "balanced", trees: int = 20, depth: int = 4, rate: float = 0.1):
    """(model, low, high) of boosted regression trees on ranks, which may be soft ones and are kept in [0, 5], with row weights; the score's two thresholds are
    picked by a policy on the calibration rows. Rows without a rank, and calibration rows whose label is no class, are left out; missing features are -9999."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    fit = train.filter(F.col(rank).isNotNull()).withColumn("__y", F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.col(rank).cast("double"))))
    boost = GBTRegressor(labelCol="__y", featuresCol="__x", predictionCol="score", maxIter=trees, maxDepth=depth, stepSize=rate, seed=1)
    model = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="__x"), boost if weight is None else boost.setWeightCol(weight)]).fit(_filled(fit, cols))
    told = score_ordinal(model, calibration.filter(class_index(label).isNotNull()), cols)
    best = pick_pair(two_threshold_sweep(told, "score", label, ORDINAL_LOWS, ORDINAL_HIGHS), policy).first()  # one row
    return model, best["low"], best["high"]


def _filled(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with the columns as numbers for a model: booleans are 0 and 1, missing or non-finite values -9999."""
    x = {c: F.col(c).cast("double") for c in cols}
    return df.withColumns({c: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), -9999.0).otherwise(v) for c, v in x.items()})


def score_ordinal(model, rows: DataFrame, cols: list[str], low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows with ``score`` and, given both thresholds, the predicted class; all columns of rows stay as they are."""
    from flowfeat.functions.levels import bucket_from_score

    shown = [c for c in rows.columns if c != "score"]
    kept = rows.withColumn("__row", F.struct(*[F.col(f"`{c}`") for c in shown]))
    out = model.transform(_filled(kept, cols)).select("__row.*", "score")
    return out if low is None else out.withColumn("predicted", bucket_from_score(F.col("score"), low, high))


def permutation_importance(model, rows: DataFrame, cols: list[str], rank: str, seed: str = "1") -> DataFrame:
    """(feature, ``mae``, ``added``): mean absolute error with a column's values dealt to other rows, and how much that adds; the row without a feature is the plain error.

    A column is dealt anew by joining rows of neighbouring hash places, one column after the other, so no table is sorted in one task.
    """
    from flowfeat.operators.spread import ranked

    known = rows.filter(F.col(rank).isNotNull())
    error = lambda df: df.agg(F.avg(F.abs(F.col("score") - F.col(rank).cast("double"))).alias("mae"))
    base = ranked(known.withColumn("__u", F.xxhash64(F.lit(seed), *[F.col(c) for c in known.columns])), [], ["__u"], "__place")
    n = base.agg(F.count("*").alias("__n"))  # one row
    base = base.crossJoin(F.broadcast(n))
    out = error(score_ordinal(model, known, cols)).select(F.lit(None).cast("string").alias("feature"), "mae")
    for k, c in enumerate(cols):
        other = base.select(((F.col("__place") + F.lit(7919 * (k + 1))) % F.col("__n")).alias("__to"), F.col(c).alias("__other"))
        dealt = base.join(other, F.col("__place") == F.col("__to")).withColumn(c, F.col("__other")).drop("__to", "__other", "__place", "__u", "__n")
        out = out.union(error(score_ordinal(model, dealt, cols)).select(F.lit(c), "mae"))
    plain = F.max(F.when(F.col("feature").isNull(), F.col("mae"))).over(Window.partitionBy())  # a row for each feature
    return out.withColumn("added", F.when(F.col("feature").isNotNull(), F.col("mae") - plain))
