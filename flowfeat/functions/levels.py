"""Levels, buckets, probabilities and bounded numbers."""

from __future__ import annotations

from collections.abc import Callable

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LevelScale:
    """Ordinal levels with ranks, and the buckets that they fall in."""

    ranks: dict[str, int] = field(default_factory=lambda: {"SEC": 0, "FILET": 1, "CORRECT": 2, "GROS": 3, "TRES_GROS": 4, "CRUE": 5})
    buckets: dict[str, str] = field(default_factory=lambda: {"SEC": "LOW", "FILET": "LOW", "CORRECT": "MEDIUM", "GROS": "HIGH", "TRES_GROS": "HIGH", "CRUE": "HIGH"})


CLASSES = ["LOW", "MEDIUM", "HIGH"]


def _look_up(c: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), c)


def level_rank(c: Column, scale: LevelScale = LevelScale()) -> Column:
    """B1: rank of a level, null for unknown ones."""
    return F.when(c.isNotNull(), _look_up(c, scale.ranks))


def level_bucket(c: Column, scale: LevelScale = LevelScale()) -> Column:
    """B1: LOW, MEDIUM or HIGH, null for unknown levels."""
    return F.when(c.isNotNull(), _look_up(c, scale.buckets))


def bucket_from_score(s: Column, low: float, high: float) -> Column:
    """B2: from ``high`` on HIGH, under ``low`` LOW, else MEDIUM."""
    return F.when(s >= high, "HIGH").when(s < low, "LOW").when(s.isNotNull(), "MEDIUM")


def level_from_cutpoints(s: Column, cuts: list[float], levels: int = 6) -> Column:
    """The number of cutpoints at or under the score; cutpoints that don't rise give the rounded, clamped score instead."""
    if sorted(cuts) == list(cuts) and len(cuts) == levels - 1:
        return F.when(s.isNotNull(), F.size(F.filter(F.lit(cuts), lambda x: x <= s)))
    return F.greatest(F.lit(0), F.least(F.lit(levels - 1), F.bround(s).cast("int")))


def sanitize_unit(c: Column) -> Column:
    """[-0.01, 0) is 0 and (1, 1.01] is 1; anything else outside [0, 1] and non-finite values are null."""
    return F.when(F.isnan(c) | (c < -0.01) | (c > 1.01), None).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))


def descriptor_flags(status: Column, kind: Column, kinds: list[str]) -> list[Column]:
    """Whether the status is ok, and one flag per kind."""
    ok = F.coalesce(status == "ok", F.lit(False))
    return [ok.alias("is_ok"), *[F.coalesce(kind == k, F.lit(False)).cast("int").alias(f"is_{k.lower()}") for k in kinds]]


def range_match(c: Column, low: float | None, high: float | None) -> Column:
    """True without bounds; with one, null is false and bounds count as inside."""
    if low is None and high is None:
        return F.lit(True)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return F.coalesce(ok, F.lit(False))


def apply_overlay(bucket: Column, p_high: Column, threshold: float) -> Column:
    """Only promotes to HIGH."""
    return F.when(p_high >= threshold, "HIGH").otherwise(bucket)


def fold_probs(p: list[Column]) -> list[Column]:
    """Six levels folded to LOW, MEDIUM and HIGH."""
    return [p[0] + p[1], p[2], p[3] + p[4] + p[5]]


def expected_rank(p: list[Column]) -> Column:
    """Sum of rank times probability."""
    return sum((F.lit(float(i)) * x for i, x in enumerate(p)), F.lit(0.0))


def rank_std(p: list[Column]) -> Column:
    """Standard deviation of the rank."""
    e = expected_rank(p)
    return F.sqrt(sum((x * (F.lit(float(i)) - e) * (F.lit(float(i)) - e) for i, x in enumerate(p)), F.lit(0.0)))


def argmax_label(p: list[Column], labels: list[str] = CLASSES) -> Column:
    """Label of the largest probability, the first of equal ones."""
    best = F.greatest(*p)
    out = F.lit(labels[-1])
    for x, label in list(zip(p, labels))[-2::-1]:
        out = F.when(x == best, label).otherwise(out)
    return out


def threshold_high(p: list[Column], threshold: float) -> Column:
    """HIGH from the threshold on, else the likelier of LOW and MEDIUM."""
    return F.when(p[2] >= threshold, "HIGH").otherwise(F.when(p[0] >= p[1], "LOW").otherwise("MEDIUM"))


def numeric_value(c: Column) -> Column:
    """Number coercion: text that is no number and non-finite values are null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def safe_ratio(a: Column, b: Column, places: int = 6) -> Column:
    """Null where the denominator is under 1e-9 in size."""
    return F.when(F.abs(b) >= 1e-9, F.round(a / b, places))


def safe_product(a: Column, b: Column, places: int = 6) -> Column:
    """H22."""
    return F.round(a * b, places)


def confidence(n: Column, strength: float) -> Column:
    """N / (n + strength)."""
    return F.round(n / (n + F.lit(strength)), 6)


def entropy(p: list[Column]) -> Column:
    """Entropy of probabilities over its largest value, in [0, 1]."""
    import math

    return F.round(sum((F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in p), F.lit(0.0)) / math.log(len(p)), 6)


def history_confidence(n: Column, strength: float) -> Column:
    """N / (n + strength), 0 for no count."""
    return F.when(n > 0, F.round(n / (n + F.lit(strength)), 6)).otherwise(0.0)


def prior_entropy(p: list[Column]) -> Column:
    """Entropy of the positive ones of k shares, scaled to sum to 1, over ln k; null if none is positive."""
    import math

    some = F.filter(F.array(*p), lambda x: x > 0)
    total = F.aggregate(some, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.round(F.aggregate(some, F.lit(0.0), lambda a, x: a - x / total * F.log(x / total)) / math.log(len(p)), 6))


def derived_features(c: Callable[[str], Column]) -> dict[str, Column]:
    """The 19 derived columns of an observation. ``c`` gives the input columns by name; values that are not finite count as null."""

    def v(name: str) -> Column:
        x = c(name).cast("double")
        return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)

    week, month = v("mean_annual_precip") / 52.1775, v("mean_annual_precip") / 12
    area = F.coalesce(F.when(v("basin_area") != 0, v("basin_area")), v("upstream_area"))
    snow = v("snowfall_14d")
    lift = lambda a, b: F.round(v(a) - v(b), 6)
    return {
        "precip_7d_weekly_climatology_ratio": safe_ratio(v("precip_7d"), week),
        "precip_30d_monthly_climatology_ratio": safe_ratio(v("precip_30d"), month),
        "api_93_monthly_climatology_ratio": safe_ratio(v("api_93"), month),
        "runoff_precip_7d_signal": safe_product(v("precip_7d"), v("runoff_potential")),
        "runoff_precip_30d_signal": safe_product(v("precip_30d"), v("runoff_potential")),
        "flash_flood_7d_signal": safe_product(v("max_precip_7d"), v("flashiness")),
        "basin_precip_volume_30d_proxy": safe_product(v("precip_30d"), area),
        "rain_on_snow_7d_signal": safe_product(v("rain_7d"), snow),
        "snowmelt_degree_day_14d_signal": safe_product(v("degree_days_14d"), snow),
        "high_elevation_snowmelt_signal": safe_product(v("degree_days_14d") * snow, v("fraction_above_1500m")),
        "site_history_confidence": history_confidence(v("site_count"), 10.0),
        "group_history_confidence": history_confidence(v("group_count"), 20.0),
        "supergroup_history_confidence": history_confidence(v("supergroup_count"), 30.0),
        "site_high_prior_lift": lift("site_p_high", "group_p_high"),
        "site_low_prior_lift": lift("site_p_low", "group_p_low"),
        "group_high_prior_lift": lift("group_p_high", "supergroup_p_high"),
        "supergroup_high_prior_lift": F.round(v("supergroup_p_high") - F.coalesce(v("global_p_high"), F.lit(0.0)), 6),
        "site_prior_entropy": prior_entropy([v("site_p_low"), v("site_p_medium"), v("site_p_high")]),
        "high_low_prior_spread": lift("site_p_high", "site_p_low"),
    }


def season(d: Column) -> Column:
    """DJF, MAM, JJA or SON."""
    m = F.month(d)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").when(m.isNotNull(), "SON")


def cyclic_month(d: Column) -> list[Column]:
    """Sine and cosine of the month's place in the year."""
    a = F.lit(2 * 3.141592653589793) * (F.month(d) - 1) / 12
    return [(F.round(F.sin(a), 6) + 0.0).alias("month_sin"), (F.round(F.cos(a), 6) + 0.0).alias("month_cos")]
