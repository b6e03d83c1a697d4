"""Daily and hourly series: flattening, trailing windows, as-of and interval joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowfeat.operators.spread import BLOCK, MOST, in_blocks, owned
from flowfeat.sources.shared import cut, drop


def flatten_series(df: DataFrame, time_col: str, value_cols: list[str], keep: list[str]) -> DataFrame:
    """A3, A4: parallel arrays to rows; shorter arrays are padded with null, rows past the end of the times are dropped."""
    zipped = F.arrays_zip(F.col(time_col), *[F.col(c) for c in value_cols])
    return df.select(*keep, F.explode(zipped).alias("__z")).select(*keep, F.col(f"__z.{time_col}").alias(time_col), *[F.col(f"__z.{c}").alias(c) for c in value_cols]).filter(F.col(time_col).isNotNull())


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, max_age_days: int, values: list[str], bucket: str = "quarter") -> DataFrame:
    """C4: each left row with the values of the last right row of its key strictly before it, null if older than ``max_age_days``.

    Both sides meet in one union, no pair of rows is ever made. A key with very many rows is split by time: rows
    are ordered within a key's bucket, and the last right row of earlier buckets comes from a table with one row a bucket.
    """
    packed = F.struct(F.col(right_time).alias("t"), *[F.col(v).alias(v) for v in values])
    cut = lambda c: F.date_trunc(bucket, F.col(c))
    r = right.filter(F.col(right_time).isNotNull()).select(*on, F.col(right_time).cast("timestamp").alias("__t"), cut(right_time).alias("__b"), F.lit(1).alias("__side"), packed.alias("__r"))
    l = left.select(*on, F.col(left_time).cast("timestamp").alias("__t"), cut(left_time).alias("__b"), F.lit(0).alias("__side"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    both = l.unionByName(r.withColumn("__l", F.lit(None).cast(l.schema["__l"].dataType)))
    inside = Window.partitionBy(*on, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__near", F.last("__r", ignorenulls=True).over(inside)).filter("__side = 0")
    ends = both.groupBy(*on, "__b").agg(F.max(F.when(F.col("__side") == 1, F.col("__r"))).alias("__end"))
    before = Window.partitionBy(*on).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*on, "__b", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    out = found.join(carried, [*on, "__b"], "left").withColumn("__got", F.coalesce("__near", "__carry"))
    fresh = F.datediff(F.col("__t"), F.col("__got.t")) <= max_age_days
    return out.select("__l.*", F.when(fresh, F.col("__got.t")).alias(f"asof_{right_time}"), *[F.when(fresh, F.col(f"__got.{v}")).alias(v) for v in values])


def series_in_window(series: DataFrame, windows: DataFrame, on: list[str], day: str = "date", start: str = "start", end: str = "end") -> DataFrame:
    """Rows of a series inside each window of its key, both ends included; whole months of both sides are matched first."""
    months = F.explode(F.sequence(F.trunc(start, "month"), F.trunc(end, "month"), F.expr("interval 1 month")))
    w = windows.filter(F.col(start) <= F.col(end)).withColumn("__m", months)
    return series.withColumn("__m", F.trunc(day, "month")).join(w, [*on, "__m"]).filter(F.col(day).between(F.col(start), F.col(end))).drop("__m")


def trailing_rows(key: list[str], order: str, n: int):
    """The last n rows of a key up to the present one. Rows, not days: a series with gaps reaches further back."""
    return Window.partitionBy(*key).orderBy(order).rowsBetween(-(n - 1), 0)


def trailing_features(series: DataFrame, key: list[str], order: str, sums: dict[str, list[int]], windows: dict[str, list[int]] | None = None, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """For each value column sums over the last n rows (null as 0), and for ``windows`` also largest value, wet rows (>= 0.1), mean without nulls and positive sum.

    A key with over ``most`` rows is cut into blocks, each of which is lent the last rows of the one before.
    """
    longest = max(n for ns in [*sums.values(), *(windows or {}).values()] for n in ns)
    rows, part = in_blocks(series, key, [order], longest - 1, most, block)
    out = {}
    for c, ns in sums.items():
        for n in ns:
            out[f"{c}_sum_{n}"] = F.round(F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(trailing_rows(part, order, n)), 4)
    for c, ns in (windows or {}).items():
        for n in ns:
            w = trailing_rows(part, order, n)
            out[f"{c}_max_{n}"] = F.coalesce(F.max(c).over(w), F.lit(0.0))
            out[f"{c}_wet_{n}"] = F.sum(F.when(F.col(c) >= 0.1, 1).otherwise(0)).over(w)
            out[f"{c}_mean_{n}"] = F.round(F.avg(c).over(w), 4)
            out[f"{c}_positive_{n}"] = F.round(F.sum(F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(0.0))).over(w), 4)
    return owned(rows.withColumns(out))


def last_reach(series: DataFrame, key: list[str], order: str, value: str, thresholds: list[float], most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Per row the last day on which the value reached each threshold, up to that row. Of a hot key, a block is handed the last reach of all blocks before it."""
    names = [f"reach_{int(t)}" for t in thresholds]
    reach = {n: F.when(F.col(value) >= t, F.col(order)) for n, t in zip(names, thresholds)}
    rows, part = in_blocks(series, key, [order], 0, most, block)
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({n: F.max(c).over(w) for n, c in reach.items()})
    if part == key:
        return owned(out)
    ends = rows.groupBy(*part).agg(*[F.max(c).alias(n) for n, c in reach.items()])
    before = Window.partitionBy(*key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    carried = ends.select(*[F.col(k).alias(f"__c{k}") for k in part], *[F.max(n).over(before).alias(f"__c{n}") for n in names])
    both = out.join(carried, [out[k].eqNullSafe(carried[f"__c{k}"]) for k in part], "left")
    return owned(both.withColumns({n: F.coalesce(n, f"__c{n}") for n in names}).drop(*[f"__c{c}" for c in [*part, *names]]))


def decayed_sums(series: DataFrame, key: list[str], order: str, value: str, decays: dict[str, float], n: int, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """For each of ``decays`` acc = acc * decay + value over the last n rows, oldest first, null as 0. A hot key's blocks are lent n - 1 rows."""
    rows, part = in_blocks(series, key, [order], n - 1, most, block)
    rows = rows.withColumn("__list", F.collect_list(F.coalesce(F.col(value), F.lit(0.0))).over(trailing_rows(part, order, n)))
    fold = lambda k: F.aggregate("__list", F.lit(0.0), lambda acc, x: acc * k + x)
    return owned(rows.withColumns({name: fold(k) for name, k in decays.items()}).drop("__list"))


def availability(series: DataFrame, key: list[str], order: str, value: str, n: int = 30, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """The value of the row before, and mean and least value of the last n rows, nulls skipped."""
    rows, part = in_blocks(series, key, [order], max(n - 1, 1), most, block)
    w = trailing_rows(part, order, n)
    return owned(rows.withColumns({"prev": F.round(F.lag(value).over(Window.partitionBy(*part).orderBy(order)), 6), f"mean_{n}": F.round(F.avg(value).over(w), 6), f"min_{n}": F.round(F.min(value).over(w), 6)}))


HOUR = 3_600_000_000


def hourly_sums(events: DataFrame, key: list[str], ts: str, value: str, hours: list[int]) -> DataFrame:
    """C6, J9 in batch: sums and counts over the half-open hours (t - h, t] up to each row's time."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    out = {}
    for h in hours:
        w = Window.partitionBy(*key).orderBy(at).rangeBetween(-(h * HOUR - 1), 0)
        out[f"sum_{h}h"] = F.round(F.sum(value).over(w), 4)
        out[f"n_{h}h"] = F.count("*").over(w)
    return events.withColumns(out)


def _best_sum(h: int) -> Column:
    """The largest sum of up to h rows in a line among those of ``__week`` within h hours of ``__at``."""
    near = F.filter("__week", lambda x: x["__at"] > F.col("__at") - h * HOUR)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y["__v"])
    sums = F.transform(near, lambda x, i: total(F.slice(near, F.greatest(F.lit(1), i - h + 2), F.least(i + 1, F.lit(h)))))
    return F.round(F.greatest(F.lit(0.0), F.array_max(sums)), 3)


def hourly_features(events: DataFrame, key: list[str], ts: str, value: str, hours: tuple[int, ...] = (6, 12, 24, 48, 72, 168), best: tuple[int, ...] = (1, 3, 6, 12), over: tuple[float, ...] = (1.0, 5.0, 10.0), decay: float = 0.85) -> DataFrame:
    """At each row's time t, nulls counting as 0: ``sum_<h>h`` over (t - h, t]; ``best_<h>h``, the largest sum of up to h rows in a line within (t - h, t],
    at least 0; ``hours_since_<v>``, whole hours since the last row up to t with at least v; ``api``, a sum over the last 168 h in which each row
    multiplies what was before by ``decay``. Rows of one time are taken in order of value.

    The only lists held are a row's own 168 hours.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = lambda h: Window.partitionBy(*key).orderBy(at).rangeBetween(-(h * HOUR - 1), 0)
    v = F.coalesce(F.col(value), F.lit(0.0))
    rows = events.withColumns({"__at": at, "__v": v})
    out = {f"sum_{h}h": F.round(F.sum("__v").over(w(h)), 3) for h in hours}
    last = Window.partitionBy(*key).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    for t in over:
        out[f"hours_since_{t:g}"] = F.floor((F.col("__at") - F.max(F.when(F.col("__v") >= t, F.col("__at"))).over(last)) / HOUR).cast("long")
    out["__week"] = F.array_sort(F.collect_list(F.struct("__at", "__v")).over(w(168)))
    rows = rows.withColumns(out)
    more = {f"best_{h}h": _best_sum(h) for h in best}
    more["api"] = F.round(F.aggregate("__week", F.lit(0.0), lambda a, x: a * decay + x["__v"]), 3)
    return rows.withColumns(more).drop("__at", "__v", "__week")


def grid_daily(grid: DataFrame, rows: DataFrame, cell: str = "cell", basin: str = "basin") -> DataFrame:
    """A basin's cells with their daily rows."""
    return grid.join(rows.withColumnRenamed("target", cell), cell)


def grid_aggregate(df: DataFrame, keys: list[str], value: str, weight: str = "weight") -> DataFrame:
    """Weighted value over the rows that there are (weights over their sum; a null value adds nothing and weights are not shared anew), largest value, nearest-rank 90th percentile, counts and available weight."""
    ordered = F.array_sort(F.collect_list(value))
    p90 = F.element_at(ordered, (F.bround((F.count(value) - 1) * 0.9) + 1).cast("int"))
    return df.groupBy(*keys).agg(
        F.round(F.sum(F.col(value) * F.col(weight)) / F.sum(weight), 6).alias(value),
        F.max(value).alias(f"max_cell_{value}"),
        F.when(F.count(value) > 0, p90).alias(f"p90_cell_{value}"),
        F.count("*").alias("n_cells"),
        F.count(value).alias("n_available"),
        F.round(F.sum(weight), 6).alias("available_weight"),
    )


def observation_windows(obs: DataFrame, days: int, day: str = "date", ident: str = "observation_id") -> DataFrame:
    """The look-back window [day - days, day] of each observation with a stable id."""
    out = obs.withColumns({"start": F.date_sub(day, days), "end": F.col(day)})
    return out.withColumn("window_id", F.concat(F.lit("win_"), F.substring(F.sha1(F.concat_ws("|", F.col(ident).cast("string"), F.col("start").cast("string"), F.col("end").cast("string"))), 1, 16)))


def merge_windows(windows: DataFrame, key: list[str], max_gap: int, ids: str, start: str = "start", end: str = "end") -> DataFrame:
    """Windows of a key that start at most ``max_gap`` days after the latest end so far become one; ids are collected."""
    order = Window.partitionBy(*key).orderBy(start, end, ids)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = windows.withColumn("__new", F.when(reach.isNull() | (F.col(start) > F.date_add(reach, max_gap)), 1).otherwise(0))
    island = flagged.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), F.array_sort(F.collect_set(ids)).alias("ids")).drop("__island")


def merge_windows_capped(windows: DataFrame, key: list[str], max_gap: int, max_span: int, ids: str, start: str = "start", end: str = "end") -> DataFrame:
    """Windows in order of (start, end, id) are merged as in E17, but one that would make the merged window longer than ``max_span`` days starts a new one.

    Where a merged window that starts on a day ends depends on that day alone: all windows of a day that fit the span join (those too long for any span stand
    alone, and what follows them starts anew), and so do those of later days until a day lies beyond the gap or has a window that
    doesn't fit. So each day of a key gets the day of the next start, from the days within the span after it; the days that are starts are found by
    doubling jumps; and a window belongs to the last start before it. A key costs its days, not its windows; nothing is folded in one list. Windows
    with a null start or end are left out.
    """
    own = [f"__k{i}" for i in range(len(key))]
    w = windows.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*[F.col(k).alias(o) for k, o in zip(key, own)], F.unix_date(start).alias("__d"), F.unix_date(end).alias("__e"), F.col(ids).alias("__i"))
    long = F.col("__e") - F.col("__d") > max_span
    days = w.groupBy(*own, "__d").agg(F.max("__e").alias("__most"), F.max(F.when(~long, F.col("__e"))).alias("__fit"), F.max(long).alias("__long"))
    after = Window.partitionBy(*own).orderBy("__d")
    back = Window.partitionBy(*own).orderBy(-F.col("__d")).rangeBetween(Window.unboundedPreceding, -max_span - 1)  # from the latest day on, so that the frame only grows
    days = days.withColumns({"__first": F.lag("__d").over(after).isNull(), "__next": F.lead("__d").over(after), "__span": F.collect_list(F.struct(F.col("__d").alias("d"), F.col("__most").alias("m"))).over(after.rangeBetween(1, max_span)), "__past": F.last("__d").over(back)})
    last = F.col("__d") + max_span
    seek = F.aggregate(
        F.array_sort("__span"),
        F.struct(F.coalesce("__fit", "__most").alias("r"), F.lit(None).cast("int").alias("d"), F.lit(False).alias("gap")),
        lambda a, x: F.when(a["d"].isNotNull(), a).otherwise(F.when((x["d"] > a["r"] + max_gap) | (x["m"] > last), F.struct(a["r"].alias("r"), x["d"].alias("d"), (x["d"] > a["r"] + max_gap).alias("gap"))).otherwise(F.struct(F.greatest(a["r"], x["m"]).alias("r"), a["d"].alias("d"), a["gap"].alias("gap")))),
    )
    found = days.withColumn("__s", F.when(F.col("__long"), F.struct(F.col("__fit").alias("r"), F.col("__next").alias("d"), F.lit(True).alias("gap"))).otherwise(seek))
    # a day beyond the span has no window that could join; ``joins``: windows of the next start's day that end by then still belong to this one
    jump = F.coalesce("__s.d", "__past")
    joins = F.when(F.col("__s.d").isNotNull() & ~F.col("__s.gap"), last)
    days = cut(found.select(*own, "__d", "__first", jump.alias("__to"), joins.alias("__joins")), "days")
    starts = days.select(*own, "__d", F.col("__to").alias("__jump"), F.col("__first").alias("__start"))
    starts = cut(starts, "starts")
    while not starts.filter("__start AND __jump IS NOT NULL").isEmpty():
        ahead = starts.select(*[F.col(o).alias(f"__a{o}") for o in own], F.col("__d").alias("__ad"), F.col("__jump").alias("__far"))
        hit = starts.filter("__start AND __jump IS NOT NULL").select(*[F.col(o).alias(f"__h{o}") for o in own], F.col("__jump").alias("__hd")).distinct()
        on = lambda p, at: reduce(Column.__and__, [F.col(at) == F.col(f"__{p}d"), *[F.col(o).eqNullSafe(F.col(f"__{p}{o}")) for o in own]])
        new = starts.join(ahead, on("a", "__jump"), "left").join(hit, on("h", "__d"), "left").select(*own, "__d", F.col("__far").alias("__jump"), (F.col("__start") | F.col("__hd").isNotNull()).alias("__start"))
        new = cut(new, "starts")
        drop(starts)
        starts = new
    # who was the start before, and up to which end do a start day's windows still belong to it
    joined = days.join(starts.select(*[F.col(o).alias(f"__s{o}") for o in own], F.col("__d").alias("__sd"), "__start"), reduce(Column.__and__, [*[F.col(o).eqNullSafe(F.col(f"__s{o}")) for o in own], F.col("__d") == F.col("__sd")]))
    upto = Window.partitionBy(*own).orderBy("__d")
    marked = F.last(F.when(F.col("__start"), F.struct(F.col("__d").alias("d"), F.col("__joins").alias("j"))), ignorenulls=True)
    told = joined.select(*[F.col(o).alias(f"__t{o}") for o in own], F.col("__d").alias("__td"), "__start", marked.over(upto.rowsBetween(Window.unboundedPreceding, -1)).alias("__was"))
    at = w.join(told, reduce(Column.__and__, [*[F.col(o).eqNullSafe(F.col(f"__t{o}")) for o in own], F.col("__d") == F.col("__td")]))
    of = F.when(~F.col("__start") | (F.col("__e") <= F.col("__was.j")), F.col("__was.d")).otherwise(F.col("__d"))
    alone = F.when(long, F.struct("__e", "__i"))
    merged = at.groupBy(*own, of.alias("__of"), alone.alias("__alone")).agg(F.min("__d").alias("__a"), F.max("__e").alias("__b"), F.array_sort(F.collect_list(F.struct("__d", "__e", "__i"))).alias("__all"))
    return merged.select(*[F.col(o).alias(k) for k, o in zip(key, own)], F.date_from_unix_date("__a").alias(start), F.date_from_unix_date("__b").alias(end), F.transform("__all", lambda x: x["__i"]).alias("ids"))


def annual_windows(windows: DataFrame, key: list[str], ids: str, start: str = "start", end: str = "end") -> DataFrame:
    """One window per key and year of the end."""
    return windows.groupBy(*key, F.year(end).alias("year")).agg(F.min(start).alias(start), F.max(end).alias(end), F.array_sort(F.collect_set(ids)).alias("ids"))


def history_windows(obs: DataFrame, key: list[str], day: str, end: str, back: int = 365) -> DataFrame:
    """One window per key, from ``back`` days before its first observation to a fixed end."""
    return obs.groupBy(*key).agg(F.date_sub(F.min(day), back).alias("start"), F.to_date(F.lit(end)).alias("end"), F.count("*").alias("n"))


def monthly_windows(windows: DataFrame, key: list[str], ids: str, last: str, start: str = "start", end: str = "end") -> DataFrame:
    """Windows as calendar months up to ``last``, each month of a key once with its ids."""
    stop = F.least(F.col(end), F.to_date(F.lit(last)))
    m = windows.filter(F.col(start) <= stop).select(*key, F.col(ids), F.explode(F.sequence(F.trunc(start, "month"), F.trunc(stop, "month"), F.expr("interval 1 month"))).alias("month"))
    return m.groupBy(*key, "month").agg(F.array_sort(F.collect_set(ids)).alias("ids"))


def rain_summary(series: DataFrame, key: list[str], ts: str, value: str, chance: str, now: str) -> DataFrame:
    """Sums of the last 24, 48, 72 rows up to now and of the first 24, 48 after it, the largest of the last 72, and the highest chance of the next 24."""
    past = F.col(ts) <= F.to_timestamp(F.lit(now))
    # one order for both sides: rows before now count back from it, rows after it count on
    ranked = series.withColumn("__past", past).withColumn("__n", F.when(past, F.row_number().over(Window.partitionBy(*key, "__past").orderBy(F.desc(ts)))).otherwise(F.row_number().over(Window.partitionBy(*key, "__past").orderBy(ts))))
    part = lambda side, n, c=value: F.when((F.col("__past") == side) & (F.col("__n") <= n), F.col(c))
    return ranked.groupBy(*key).agg(*[F.round(F.sum(part(True, n)), 4).alias(f"last_{n}") for n in (24, 48, 72)], *[F.round(F.sum(part(False, n)), 4).alias(f"next_{n}") for n in (24, 48)], F.max(part(True, 72)).alias("max_72"), F.max(part(False, 24, chance)).alias("chance_24"))


def within_window_ids(windows: DataFrame, ids: str = "ids", start: str = "start") -> DataFrame:
    """Each id with its window; of several the one that starts last."""
    return windows.select(F.explode(ids).alias("id"), *windows.columns).groupBy("id").agg(F.max_by(F.struct(*[c for c in windows.columns if c != ids]), F.col(start)).alias("w")).select("id", "w.*")


