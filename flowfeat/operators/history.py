"""What was known strictly before: causal counts, priors and recent history, and their snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowfeat.operators.spread import ranked

CLASSES = ["LOW", "MEDIUM", "HIGH"]


def day(c: str) -> Column:
    return F.unix_date(F.to_date(c))


def timed(obs: DataFrame, time: str) -> bool:
    """Whether a time has an hour: rows of one day then see those before them on that day."""
    return isinstance(obs.schema[time].dataType, (T.TimestampType, T.TimestampNTZType))


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def counts_before(obs: DataFrame, key: list[str], time: str, flags: dict[str, Column]) -> DataFrame:
    """obs with sums of the flags over rows of the same key strictly before the row's time; rows of the same time don't see each other.

    Rows are first summed by (key, time), then by (key, day), so the window over all days runs over one row per key and day: at the global
    level over one row per distinct day, and a hot key costs its distinct days, not its rows. Times with an hour add what the key
    has before them on their own day, in a window for each key and day.
    """
    null_safe = lambda df, other, p: [df[k].eqNullSafe(other[f"{p}{k}"]) for k in key]
    per = obs.groupBy(*key, time).agg(*[F.sum(c.cast("long")).alias(n) for n, c in flags.items()]).withColumn("__d", day(time))
    w = (Window.partitionBy(*key) if key else Window.partitionBy()).orderBy("__d").rangeBetween(Window.unboundedPreceding, -1)
    sums = lambda over: [F.coalesce(F.sum(n).over(over), F.lit(0)).alias(n) for n in flags]
    if timed(obs, time):
        inner = Window.partitionBy(*key, "__d").orderBy(micros(time)).rangeBetween(Window.unboundedPreceding, -1)
        days = per.groupBy(*key, "__d").agg(*[F.sum(n).alias(n) for n in flags])
        days = days.select(*[F.col(k).alias(f"__w{k}") for k in key], F.col("__d").alias("__wd"), *[c.alias(f"__w{n}") for n, c in zip(flags, sums(w))])
        here = per.select(*key, "__d", time, *sums(inner))
        per_time = here.join(days, reduce(lambda x, y: x & y, [*null_safe(here, days, "__w"), here["__d"] == days["__wd"]]))
        before = per_time.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(time).alias("__t"), *[(F.col(n) + F.col(f"__w{n}")).alias(n) for n in flags])
    else:
        before = per.select(*[F.col(k).alias(f"__{k}") for k in key], F.col(time).alias("__t"), *sums(w))
    return obs.join(before, reduce(lambda x, y: x & y, [*null_safe(obs, before, "__"), obs[time] == before["__t"]]), "left").drop("__t", *[f"__{k}" for k in key])


def class_flags(bucket: str, prefix: str) -> dict[str, Column]:
    return {f"{prefix}_{c.lower()}": F.coalesce(F.col(bucket) == c, F.lit(False)) for c in CLASSES}


def smoothed(prefix: str, parent: str | None, strength: float) -> dict[str, Column]:
    """p = (n_class + strength * parent's p) / (n + strength); the topmost level is plain shares, a third each if empty."""
    n = F.col(f"{prefix}_low") + F.col(f"{prefix}_medium") + F.col(f"{prefix}_high")
    out = {}
    for c in map(str.lower, CLASSES):
        own = F.col(f"{prefix}_{c}")
        out[f"{prefix}_p_{c}"] = F.when(n > 0, own / n).otherwise(F.lit(1.0 / 3)) if parent is None else (own + strength * F.col(f"{parent}_p_{c}")) / (n + strength)
    return out


def causal_priors(obs: DataFrame, time: str = "date", bucket: str = "bucket", levels: tuple[tuple[str, str, float], ...] = (("supergroup", "sup", 30.0), ("group", "grp", 20.0), ("site", "site", 10.0))) -> DataFrame:
    """Class counts and smoothed shares before each row, global and per level, each smoothed towards the level above."""
    out = counts_before(obs, [], time, class_flags(bucket, "global")).withColumns(smoothed("global", None, 0))
    parent = "global"
    for name, key, strength in levels:
        out = counts_before(out, [key], time, class_flags(bucket, name)).withColumns(smoothed(name, parent, strength))
        parent = name
    return out


def causal_signals(obs: DataFrame, key: str, time: str, signals: dict[str, Column]) -> DataFrame:
    """How often each signal was seen before at the key, its share of earlier rows, and whether twice or more."""
    out = counts_before(obs, [key], time, {"rows_before": F.lit(1)} | {f"{n}_before": c for n, c in signals.items()})
    more = {}
    for n in signals:
        more[f"{n}_ratio"] = F.when(F.col("rows_before") > 0, F.round(F.col(f"{n}_before") / F.col("rows_before"), 6)).otherwise(0.0)
        more[f"{n}_flag"] = F.col(f"{n}_before") >= 2
    return out.withColumns(more)


def seasonal_priors(obs: DataFrame, period: str, time: str = "date", bucket: str = "bucket") -> DataFrame:
    """As E8 within the same month or season (a column of obs), strengths 20, 15 and 8, and the mean rank at the site."""
    out = counts_before(obs, [period], time, class_flags(bucket, "global")).withColumns(smoothed("global", None, 0))
    parent = "global"
    for name, key, strength in (("supergroup", "sup", 20.0), ("group", "grp", 15.0), ("site", "site", 8.0)):
        flags = class_flags(bucket, name) | ({"rank_sum": F.coalesce(F.col("rank"), F.lit(0)), "rank_n": F.col("rank").isNotNull()} if name == "site" else {})
        out = counts_before(out, [key, period], time, flags).withColumns(smoothed(name, parent, strength))
        parent = name
    return out.withColumn("mean_rank", F.when(F.col("rank_n") > 0, F.round(F.col("rank_sum") / F.col("rank_n"), 6)))


def recent_history(obs: DataFrame, key: str = "site", time: str = "date", days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """Over labelled rows from N days before the row's day up to the row's time: count, share of HIGH (0 if none), and the mean rank of a year.

    Sums by day go into a window of days; times with an hour add the rows before them on their own day.
    """
    per = obs.filter("bucket IS NOT NULL").groupBy(key, time).agg(F.count("*").alias("n"), F.sum((F.col("bucket") == "HIGH").cast("long")).alias("h"), F.sum("rank").alias("r"))
    slots = obs.select(key, time).distinct().join(per, [key, time], "left").withColumn("__d", day(time))
    whole = slots.groupBy(key, "__d").agg(*[F.sum(x).alias(x) for x in "nhr"])
    over = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    window = {d: Window.partitionBy(key).orderBy("__d").rangeBetween(-d, -1) for d in days}
    whole = whole.select(key, "__d", *[over(x, window[d]).alias(f"__{x}{d}") for d in days for x in "nhr"])
    inner = Window.partitionBy(key, "__d").orderBy(micros(time)).rangeBetween(Window.unboundedPreceding, -1)
    slots = slots.select(key, time, "__d", *[(over(x, inner) if timed(obs, time) else F.lit(0)).alias(f"__{x}") for x in "nhr"])
    cols = []
    for d in days:
        n, h, r = (F.col(f"__{x}{d}") + F.col(f"__{x}") for x in "nhr")
        cols += [n.alias(f"n_{d}"), F.when(n > 0, F.round(h / n, 6)).otherwise(0.0).alias(f"high_{d}")]
        if d == 365:
            cols.append(F.when(n > 0, F.round(r / n, 6)).alias("mean_rank_365"))
    return obs.join(slots.join(whole, [key, "__d"]).select(key, time, *cols), [key, time], "left")


def last_observation(obs: DataFrame, key: str = "site", time: str = "date", ident: str = "observation_id") -> DataFrame:
    """Days since and rank of the last labelled row before; of one time the one with the largest id."""
    per = obs.groupBy(key, time).agg(F.max(F.when(F.col("rank").isNotNull(), F.struct(time, ident, "rank"))).alias("__last")).withColumn("__d", day(time))
    w = Window.partitionBy(key).orderBy("__d").rangeBetween(Window.unboundedPreceding, -1)
    before = per.groupBy(key, "__d").agg(F.max("__last").alias("__last")).select(key, "__d", F.max("__last").over(w).alias("__b"))
    inner = Window.partitionBy(key, "__d").orderBy(micros(time)).rangeBetween(Window.unboundedPreceding, -1)
    here = per.select(key, "__d", time, (F.max("__last").over(inner) if timed(obs, time) else F.lit(None).cast(per.schema["__last"].dataType)).alias("__h"))
    known = here.join(before, [key, "__d"]).select(key, time, F.coalesce("__h", "__b").alias("__b"))
    return obs.join(known, [key, time], "left").withColumns({"days_since": F.datediff(F.col(time), F.col(f"__b.{time}")), "last_rank": F.col("__b.rank")}).drop("__b")


def serving_features(obs: DataFrame, requests: DataFrame, key: str = "site", time: str = "date") -> DataFrame:
    """Recent history and last observation at requested (key, time) pairs: requests join the observations as unlabelled rows."""
    asked = requests.select(key, time).distinct().withColumn("__asked", F.lit(True))
    both = obs.select(key, time, "observation_id", "bucket", "rank").withColumn("__asked", F.lit(False)).unionByName(asked, allowMissingColumns=True)
    return last_observation(recent_history(both, key, time), key, time).filter("__asked").drop("__asked", "observation_id", "bucket", "rank")


def recent_snapshot(obs: DataFrame, reference: str, key: str = "site", time: str = "date", days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """Counts and share of HIGH from ``reference - N`` to the reference date, both included."""
    ref = F.to_date(F.lit(reference))
    cols = []
    for d in days:
        inside = F.col(time).between(F.date_sub(ref, d), ref) & F.col("bucket").isNotNull()
        cols += [F.sum(inside.cast("long")).alias(f"n_{d}"), F.sum((inside & (F.col("bucket") == "HIGH")).cast("long")).alias(f"high_{d}")]
    return obs.groupBy(key).agg(*cols)


LOW = [c.lower() for c in CLASSES]


def class_counts() -> list[Column]:
    return [F.sum(F.coalesce((F.col("bucket") == c), F.lit(False)).cast("long")).alias(c.lower()) for c in CLASSES]


def shares(own: str, base: str, strength: float) -> list[Column]:
    """Columns p_low, p_medium, p_high from counts and the shares of the level above."""
    total = sum((F.col(f"{own}{x}") for x in LOW), F.lit(0)) + strength
    return [((F.col(f"{own}{c}") + strength * F.col(f"{base}{c}")) / total).alias(f"p_{c}") for c in LOW]


def site_context(obs: DataFrame) -> DataFrame:
    """A site's group and supergroup: those of its first row by (date, id)."""
    return obs.groupBy("site").agg(F.min_by(F.struct("grp", "sup"), F.struct("date", "observation_id")).alias("__c")).select("site", "__c.grp", "__c.sup")


def prior_snapshot(obs: DataFrame, signals: dict[str, Column] | None = None) -> DataFrame:
    """Final counts and smoothed shares by level in one table (level, key): global, supergroup (30), group (20), site (10).

    Signals are counted over all rows, labelled or not: ``<signal>_n`` and ``<signal>_ratio``, and at sites ``<signal>_flag`` from two on
    and ``atypical``, if any flag is set. A site's group and supergroup are those of its first row.
    """
    signals = signals or {}
    seen = [F.count("*").alias("rows"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(f"{n}_n") for n, c in signals.items()]]
    n, kept = [*class_counts(), *seen], [*LOW, "rows", *[f"{x}_n" for x in signals]]

    def put(df: DataFrame, level: str, key: str | None, p: list[Column]) -> DataFrame:
        site = level == "site"
        flags = [(F.col(f"{x}_n") >= 2 if site else F.lit(None).cast("boolean")).alias(f"{x}_flag") for x in signals]
        any_flag = reduce(lambda x, y: x | y, [F.col(f"{x}_n") >= 2 for x in signals], F.lit(False)) if site else F.lit(None).cast("boolean")
        ratio = [F.round(F.col(f"{x}_n") / F.col("rows"), 6).alias(f"{x}_ratio") for x in signals]
        return df.select(F.lit(level).alias("level"), F.col(key).cast("long").alias("key") if key else F.lit(None).cast("long").alias("key"), *kept, *p, *ratio, *flags, *([any_flag.alias("atypical")] if signals else []))

    base = lambda df, key: df.select(F.col("key").alias(key), *[F.col(f"p_{c}").alias(f"b_{c}") for c in LOW])
    t = sum((F.col(c) for c in LOW), F.lit(0))
    glob = put(obs.agg(*n), "global", None, [F.when(t > 0, F.col(c) / t).otherwise(1.0 / 3).alias(f"p_{c}") for c in LOW])
    sup = put(obs.groupBy("sup").agg(*n).crossJoin(F.broadcast(base(glob, "__none").drop("__none"))), "supergroup", "sup", shares("", "b_", 30.0))  # one row
    grp = put(obs.groupBy("grp", "sup").agg(*n).join(base(sup, "sup"), "sup"), "group", "grp", shares("", "b_", 20.0))
    own = put(obs.groupBy("site").agg(*n).join(site_context(obs), "site").join(base(grp, "grp"), "grp"), "site", "site", shares("", "b_", 10.0))
    return glob.unionByName(sup).unionByName(grp).unionByName(own)


def temporal_snapshot(obs: DataFrame, period: Column, periods: list) -> DataFrame:
    """(level, key, period): class counts over labelled rows, shares smoothed towards the level above in the same period (supergroup 20, group
    15, site 8), and at sites the mean rank. Every entity has all ``periods``; a group's supergroup is that of its smallest site."""
    rows = obs.filter("bucket IS NOT NULL AND rank IS NOT NULL").withColumn("period", period)
    every = F.explode(F.array(*map(F.lit, periods))).alias("period")
    context = site_context(obs)

    def dense(key: str, entities: DataFrame, *more: Column) -> DataFrame:
        n = rows.groupBy(F.col(key).alias("__k"), "period").agg(*class_counts(), *more)
        out = entities.select("*", every)
        out = out.join(n.withColumnRenamed("period", "__p"), (F.col(key) == F.col("__k")) & (F.col("period") == F.col("__p")), "left").drop("__k", "__p")
        return out.fillna(0, LOW)

    def rest(df: DataFrame, level: str, key: str | None) -> DataFrame:
        mean = F.when(sum((F.col(c) for c in LOW), F.lit(0)) > 0, F.round(F.col("__rank"), 6)) if level == "site" else F.lit(None).cast("double")
        return df.select(F.lit(level).alias("level"), F.col(key).cast("long").alias("key") if key else F.lit(None).cast("long").alias("key"), "period", *LOW, *[f"p_{c}" for c in LOW], mean.alias("mean_rank"))

    t = sum((F.col(c) for c in LOW), F.lit(0))
    n = rows.groupBy(F.col("period").alias("__p")).agg(*class_counts())
    glob = obs.sparkSession.range(1).select(every).join(n, F.col("period") == F.col("__p"), "left").drop("__p").fillna(0, LOW).select("period", *LOW, *[F.when(t > 0, F.col(c) / t).otherwise(1.0 / 3).alias(f"p_{c}") for c in LOW])
    up = lambda df, key: df.select(*([key] if key else []), "period", *[F.col(f"p_{c}").alias(f"b_{c}") for c in LOW])
    sup = dense("sup", obs.select("sup").distinct()).join(up(glob, None), "period")
    sup = sup.select("sup", "period", *LOW, *shares("", "b_", 20.0))
    parent = context.groupBy("grp").agg(F.min_by("sup", "site").alias("sup"))
    grp = dense("grp", parent).join(up(sup, "sup"), ["sup", "period"])
    grp = grp.select("grp", "period", *LOW, *shares("", "b_", 15.0))
    own = dense("site", context, F.avg("rank").alias("__rank")).join(up(grp, "grp"), ["grp", "period"])
    own = own.select("site", "period", *LOW, *shares("", "b_", 8.0), "__rank")
    return rest(glob, "global", None).unionByName(rest(sup, "supergroup", "sup")).unionByName(rest(grp, "group", "grp")).unionByName(rest(own, "site", "site"))


def reference_snapshot(obs: DataFrame, days: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """(level, key) at the latest labelled date: counts and shares of HIGH of the last N days, that date included, and at sites the mean rank
    of a year, and date and rank of the last labelled row (of one day the one with the smallest id)."""
    ok = F.col("bucket").isNotNull() & F.col("rank").isNotNull()
    ref = obs.filter(ok).agg(F.max("date").alias("__ref"))
    rows = obs.crossJoin(F.broadcast(ref))  # one row
    cols = []
    for d in days:
        inside = ok & (F.col("date") >= F.date_sub("__ref", d))
        n = F.sum(inside.cast("long"))
        cols += [n.alias(f"n_{d}"), F.when(n > 0, F.round(F.sum((inside & (F.col("bucket") == "HIGH")).cast("long")) / n, 6)).otherwise(0.0).alias(f"high_{d}")]
    year = ok & (F.col("date") >= F.date_sub("__ref", max(days)))
    last = F.max(F.when(ok, F.struct("date", (-F.col("observation_id")).alias("i"), "rank")))
    out = None
    for level, key in (("supergroup", "sup"), ("group", "grp"), ("site", "site")):
        site = level == "site"
        per = rows.groupBy(F.col(key).cast("long").alias("key")).agg(*cols, F.round(F.avg(F.when(year, F.col("rank"))), 6).alias("r"), last.alias("l"))
        told = per.select(F.lit(level).alias("level"), "key", *[f"{x}_{d}" for d in days for x in ("n", "high")], *[(c if site else F.lit(None).cast(k)).alias(x) for c, k, x in ((F.col("r"), "double", f"mean_rank_{max(days)}"), (F.col("l.date"), "date", "last_date"), (F.col("l.rank"), "int", "last_rank"))])
        out = told if out is None else out.unionByName(told)
    return out


def resolve_lookup(rows: DataFrame, layers: list[tuple[str, DataFrame, str]], value: str, default: float) -> DataFrame:
    """The value of the most specific layer that has the row's key; ``source`` names it. layers: (name, table of (key, value), key column), most general first."""
    out, found = rows, []
    for name, lookup, key in layers:
        out = out.join(lookup.select(F.col(key).alias(f"__{name}_k"), F.col(value).alias(f"__{name}")), F.col(key) == F.col(f"__{name}_k"), "left").drop(f"__{name}_k")
        found.append(name)
    value_col, source = F.lit(default), F.lit("defaults")
    for name in found:
        value_col, source = F.coalesce(F.col(f"__{name}"), value_col), F.when(F.col(f"__{name}").isNotNull(), name).otherwise(source)
    return out.withColumns({value: value_col, "source": source}).drop(*[f"__{n}" for n in found])


def near_term_contradictions(obs: DataFrame, days: int = 3, key: str = "site", time: str = "date") -> DataFrame:
    """Per key the pairs of rows at most ``days`` apart, and how many of them are one LOW and one HIGH.

    Pairs are counted from the counts by day: none is made.
    """
    per = obs.filter("bucket IS NOT NULL").groupBy(key, time).agg(F.count("*").alias("n"), *[F.sum((F.col("bucket") == c).cast("long")).alias(c.lower()) for c in CLASSES])
    w = Window.partitionBy(key).orderBy(day(time)).rangeBetween(-days, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = per.select(key, (F.col("n") * (F.col("n") - 1) / 2 + F.col("n") * before("n")).alias("pairs"), (F.col("low") * F.col("high") + F.col("low") * before("high") + F.col("high") * before("low")).alias("against"))
    return rows.groupBy(key).agg(F.sum("pairs").cast("long").alias("pairs"), F.sum("against").cast("long").alias("contradictory")).filter("pairs > 0").withColumn("fraction", F.round(F.col("contradictory") / F.col("pairs"), 6))


def consensus(obs: DataFrame, keys: list[str] = ["site", "date"]) -> DataFrame:
    """Weighted votes per site and day. obs: bucket, rank, ``quality`` and ``agreement`` (conflict, agree or other).

    weight = quality kept in [0.1, 1.5], times .35 for a conflict or 1.1 for agreement.
    """
    q = F.greatest(F.lit(0.1), F.least(F.lit(1.5), F.col("quality")))
    w = q * F.when(F.col("agreement") == "conflict", 0.35).when(F.col("agreement") == "agree", 1.1).otherwise(1.0)
    rows = obs.filter("bucket IS NOT NULL").withColumn("w", w)
    agg = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("w").alias("weight"), *[F.sum((F.col("bucket") == c).cast("long")).alias(f"n_{c.lower()}") for c in CLASSES], *[F.sum(F.when(F.col("bucket") == c, F.col("w")).otherwise(0.0)).alias(f"w_{c.lower()}") for c in CLASSES],
        F.sum(F.col("w") * F.col("rank")).alias("wr"), F.sum(F.col("w") * F.col("rank") * F.col("rank")).alias("wr2"), F.sum((F.col("agreement") == "conflict").cast("long")).alias("text_conflicts"), F.min("observation_id").alias("representative"),
    )
    p = [F.col(f"w_{c.lower()}") / F.col("weight") for c in CLASSES]
    best = F.greatest(*p)
    ties = sum(((x >= best - 1e-9).cast("int") for x in p), F.lit(0))
    mean = F.col("wr") / F.col("weight")
    ent = sum((F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in p), F.lit(0.0)) / F.log(F.lit(3.0))
    return agg.select(
        *keys, "n", F.round("weight", 6).alias("weight"), *[f"n_{c.lower()}" for c in CLASSES], *[F.round(x, 6).alias(f"p_{c.lower()}") for x, c in zip(p, CLASSES)], F.round(mean, 6).alias("soft_rank"),
        F.round(F.greatest(F.lit(0.0), F.col("wr2") / F.col("weight") - mean * mean), 6).alias("rank_variance"), F.round(ent, 6).alias("entropy"), F.round(best, 6).alias("confidence"), (ties > 1).alias("tie"),
        ((F.col("n_low") > 0) & (F.col("n_high") > 0)).alias("low_high"), "text_conflicts", F.when(p[2] >= best - 1e-9, "HIGH").when(p[1] >= best - 1e-9, "MEDIUM").otherwise("LOW").alias("top"), "representative",
    )


def gate(votes: DataFrame, least: float = 0.5) -> DataFrame:
    """D3: ``reason`` a day is left out for: tie, then LOW against HIGH, then low confidence; null keeps it."""
    return votes.withColumn("reason", F.when(F.col("tie"), "tie").when(F.col("low_high"), "low_high_conflict").when(F.col("confidence") < least, "low_confidence"))


def balanced_weights(votes: DataFrame, site: str = "site") -> DataFrame:
    """Confidence and agreement over the square root of the site's count, scaled to mean 1."""
    per = votes.groupBy(site).agg(F.count("*").alias("__sites"))
    raw = F.col("confidence") * (1 - 0.35 * F.col("entropy")) * (1 - 0.5 * F.col("low_high").cast("double")) * (1 + 0.08 * F.least(F.log(1.0 + F.col("n")), F.lit(2.0))) / F.sqrt("__sites")
    rows = votes.join(per, site).withColumn("__raw", raw)
    mean = rows.agg(F.avg("__raw").alias("__mean"))  # one row
    return rows.crossJoin(F.broadcast(mean)).withColumn("sample_weight", F.round(F.col("__raw") / F.col("__mean"), 6)).drop("__sites", "__raw", "__mean")


def class_balanced(df: DataFrame, label: str) -> DataFrame:
    """Total / (classes * rows of the class) per row."""
    per = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("__n"))
    total = per.agg(F.sum("__n").alias("__t"), F.count("*").alias("__k"))  # one row
    weights = per.crossJoin(F.broadcast(total)).select(label, (F.col("__t") / (F.col("__k") * F.col("__n"))).alias("class_weight"))
    return df.join(weights, label)


def temporal_split(obs: DataFrame, test: float, calibration: float, time: str = "date", ident: str = "observation_id") -> DataFrame:
    """K1: by (time, id): the last share is test, the one before it calibration, the rest train. Ranks come from sampled ranges: a day with all rows is spread over all tasks."""
    rows = ranked(obs, [], [time, ident], "__rank")
    total = rows.agg(F.count("*").alias("__total"))  # one row
    n_test, n_cal = F.floor(F.col("__total") * test), F.floor(F.col("__total") * calibration)
    split = F.when(F.col("__rank") >= F.col("__total") - n_test, "test").when(F.col("__rank") >= F.col("__total") - n_test - n_cal, "calibration").otherwise("train")
    return rows.crossJoin(F.broadcast(total)).withColumn("split", split).drop("__total", "__rank")


def cold_entity_split(obs: DataFrame, unit: Column, test: float, calibration: float, site: str = "site") -> DataFrame:
    """K2: whole sites, in the order of ``unit`` (a hash of the site), to test until its share of rows is reached, then to calibration, then train.

    The running count goes over sites in 4,096 hash ranges first, then within each range.
    """
    per = obs.groupBy(site).agg(F.count("*").alias("__n")).withColumn("__u", unit).withColumn("__r", F.floor(F.col("__u") * 4096))
    ranges = per.groupBy("__r").agg(F.sum("__n").alias("__m"))
    w = Window.partitionBy().orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # over 4,096 rows at most
    base = ranges.select("__r", F.coalesce(F.sum("__m").over(w), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__r").orderBy("__u", site).rowsBetween(Window.unboundedPreceding, -1)
    total = per.agg(F.sum("__n").alias("__total"))
    ranked = per.join(base, "__r").crossJoin(F.broadcast(total)).withColumn("__before", F.col("__base") + F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    split = F.when(F.col("__before") < F.col("__total") * test, "test").when(F.col("__before") < F.col("__total") * (test + calibration), "calibration").otherwise("train")
    return obs.join(ranked.select(site, split.alias("split")), site)


def stratified_holdout(days: DataFrame, unit: Column, share: float = 0.1, least: int = 2, most: int = 40, per_site: int = 8, site: str = "site", strata: list[str] = ["year", "level"]) -> DataFrame:
    """K3: per stratum the first max(least, round(share * n)) rows, at most ``most``, in hash order, then at most ``per_site`` of a site.

    No stratum has more than ``most`` rows taken, so each task passes on its first ``most`` of a stratum only: ranks are cut off before the shuffle.
    """
    sizes = days.groupBy(*[F.col(c).alias(f"__s{c}") for c in strata]).agg(F.least(F.lit(most), F.greatest(F.lit(least), F.round(F.count("*") * share).cast("int"))).alias("__target"))
    first = days.withColumn("__u", unit).withColumn("__n", F.row_number().over(Window.partitionBy(*strata).orderBy("__u"))).filter(F.col("__n") <= most)
    taken = first.join(sizes, [first[c].eqNullSafe(sizes[f"__s{c}"]) for c in strata]).filter("__n <= __target").drop(*[f"__s{c}" for c in strata])
    return taken.withColumn("__s", F.row_number().over(Window.partitionBy(site).orderBy("__u"))).filter(F.col("__s") <= per_site).drop("__u", "__n", "__target", "__s")


def history_dropout(df: DataFrame, unit: Column, rate: float, cols: list[str]) -> DataFrame:
    """K4: zeroes history columns of the rows whose hash is under the rate."""
    drop = unit < rate
    return df.withColumns({c: F.when(drop, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c in cols})
