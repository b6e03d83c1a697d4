"""Fitted models on separable rows: what they must get right whatever the trees."""

import random

import pytest
from pyspark.sql import functions as F

from flowfeat.operators import evaluate as E

LABELS = {0: "LOW", 1: "LOW", 2: "MEDIUM", 3: "HIGH", 4: "HIGH"}


def rows(spark, n=600, seed=5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        r = rng.randrange(5)
        out.append((i, r * 10.0 + rng.uniform(-3, 3), rng.uniform(0, 100), None if rng.random() < 0.2 else rng.random(), r, LABELS[r] if rng.random() < 0.95 else None, 1.0))
    return spark.createDataFrame(out, "id int, told double, noise double, gaps double, rank int, label string, w double")


@pytest.fixture(scope="module")
def fitted(spark):
    train, calibration, test = rows(spark, seed=1), rows(spark, 300, seed=2), rows(spark, 300, seed=3)
    model, low, high = E.fit_ordinal(train, calibration, ["told", "noise", "gaps"], "rank", "label", "w", trees=10)
    return model, low, high, test


def test_ordinal_model_tells_separable_classes(fitted):
    model, low, high, test = fitted
    assert 1.0 < low <= 2.0 < high <= 3.0
    got = E.score_ordinal(model, test, ["told", "noise", "gaps"], low, high)
    assert got.columns == [*test.columns, "score", "predicted"] and got.count() == 300
    assert got.filter("gaps = -9999").count() == 0  # columns come out as they were
    right = got.filter("label IS NOT NULL").agg(F.avg((F.col("label") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.95  # of equal pairs the lowest high threshold is taken, so a few of class MEDIUM pass it
    assert got.agg(F.avg(F.abs(F.col("score") - F.col("rank")))).first()[0] < 0.25


def test_importance_by_permutation(fitted):
    model, _, _, test = fitted
    got = {r["feature"]: r for r in E.permutation_importance(model, test, ["told", "noise", "gaps"], "rank").collect()}
    assert got["told"]["added"] > 0.8 and abs(got["noise"]["added"]) < 0.05 and abs(got["gaps"]["added"]) < 0.05
    assert got[None]["added"] is None and got["told"]["mae"] == pytest.approx(got[None]["mae"] + got["told"]["added"])


def test_row_weights_count(spark):
    twice = spark.createDataFrame([(float(i % 2), 0.0 if i < 8 else 4.0, "LOW", 9.0 if i < 8 else 1.0) for i in range(16)], "x double, rank double, label string, w double")
    model, *_ = E.fit_ordinal(twice, twice, ["x"], "rank", "label", "w", trees=3, rate=1.0)
    assert [round(r["score"], 6) for r in E.score_ordinal(model, twice, ["x"]).collect()] == [0.4] * 16


def test_forest_variants_and_overlay(spark):
    train, test = rows(spark, seed=1), rows(spark, 300, seed=3)
    families = {"weather": ["told"], "physical": ["noise", "gaps"]}
    got = {r["variant"]: r for r in E.fit_and_score(train, test, families, "label", ["full", "weather_only", "physical_only"]).collect()}
    labelled = test.filter("label IS NOT NULL").count()
    assert all(r["n"] == labelled for r in got.values())
    assert got["full"]["accuracy"] > 0.95 and got["weather_only"]["accuracy"] > 0.95 and got["physical_only"]["accuracy"] < 0.7
    assert got["full"]["importance"]["weather"] > 0.8
    scored = E.score_with_overlay(train, test, ["told", "noise"], "label", 0.35).collect()
    assert len(scored) == 300
    for r in scored:
        assert r["p_low"] + r["p_medium"] + r["p_high"] == pytest.approx(1, abs=1e-5)
        assert r["predicted"] == ("HIGH" if r["p_high"] >= 0.35 else r["base"])
    assert sum(r["predicted"] == r["label"] for r in scored if r["label"]) > 0.95 * labelled
