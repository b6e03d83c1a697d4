"""Coverage, distributions and audits of columns."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowfeat.operators.spread import grouped_quantiles


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, v) of all named columns as text."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cols])).alias("x")).select("x.feature", "x.v")


def coverage(df: DataFrame, cols: list[str], mostly: float = 0.95) -> DataFrame:
    """Per column present, missing and non-numeric values, distinct ones, and whether all or most are missing or all the same.

    Values are counted by (column, value) first, so distinct counts need no set in one task.
    """
    per = _long(df, cols).groupBy("feature", "v").agg(F.count("*").alias("n"))
    d = F.col("v").try_cast("double")
    bad = F.col("v").isNotNull() & (d.isNull() | F.isnan(d))
    out = per.groupBy("feature").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("present"), F.sum(F.when(bad, F.col("n")).otherwise(0)).alias("invalid"), F.count("v").alias("n_distinct"))
    gone = F.col("rows") - F.col("present")
    return out.select("feature", "present", gone.alias("missing"), "invalid", "n_distinct", (F.col("present") == 0).alias("all_missing"), (gone / F.col("rows") >= mostly).alias("mostly_missing"), ((F.col("present") > 0) & (F.col("n_distinct") == 1)).alias("is_constant"))


def select_informative(df: DataFrame, report: DataFrame) -> DataFrame:
    """Without the columns that the report finds all missing or constant. The report has one row per column."""
    drop = [r["feature"] for r in report.filter("all_missing OR is_constant").select("feature").collect()]
    return df.drop(*drop)


def family_coverage(report: DataFrame, family: Column) -> DataFrame:
    """Mean share of missing values per feature family."""
    return report.groupBy(family.alias("family")).agg(F.count("*").alias("features"), F.round(F.avg(F.col("missing") / (F.col("missing") + F.col("present"))), 6).alias("missing_fraction"))


QUANTILES = [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def quantiles(df: DataFrame, c: str, by: list[str] = []) -> DataFrame:
    """Quantiles with linear interpolation, per group by narrowed intervals: no task holds a group's values."""
    p = grouped_quantiles(df, by, {"__q": F.col(c)}, QUANTILES)
    return p.select(*by, *[F.round(F.get("__q", i), 6).alias(f"p{int(q * 100):02d}") for i, q in enumerate(QUANTILES)])


def sketched_quantiles(df: DataFrame, c: str, by: list[str] = [], k: int = 800) -> DataFrame:
    """D13 from mergeable KLL sketches: one pass, and a row of some kilobytes for each group. A quantile's rank is off by no more than about 1.65 / k of
    the group's rows at .99 confidence (.2 % at k = 800); values are rows' own, not interpolated. Nulls and NaN are left out."""
    x = F.col(c).cast("double")
    s = df.groupBy(*by).agg(F.kll_sketch_agg_double(F.when(~F.isnan(x), x), k).alias("__s"))
    return s.select(*by, *[F.kll_sketch_get_quantile_double("__s", F.lit(q).cast("double")).alias(f"p{int(q * 100):02d}") for q in QUANTILES])


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], bins: int = 1_024) -> dict[str, list[float | None]]:
    """Quantiles of whole columns with linear interpolation, nulls and NaN left out.

    The interval that holds each rank is cut into ``bins`` and the rank's bin becomes the next interval, from its least to its largest value, until
    that is one value. A round is one pass that returns a row for each bin, so no task and no driver ever holds a column's distinct values.
    """
    x = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    ends = df.agg(*[f(x[c]).alias(f"{n}_{c}") for c in cols for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    place = {(c, r): [ends[f"lo_{c}"], ends[f"hi_{c}"], 0] for c in cols for p in probs if ends[f"n_{c}"] for r in {int(p * (ends[f"n_{c}"] - 1)), min(int(p * (ends[f"n_{c}"] - 1)) + 1, ends[f"n_{c}"] - 1)}}
    while wide := sorted({(c, lo, hi) for (c, _), (lo, hi, _) in place.items() if lo < hi}):
        cut_up = lambda c, lo, hi: F.least(F.lit(bins - 1), F.floor((x[c] / 2 - lo / 2) / (hi / 2 - lo / 2) * bins).cast("int"))
        marks = [F.when(x[c].between(lo, hi), F.struct(F.lit(j).alias("j"), cut_up(c, lo, hi).alias("b"), x[c].alias("x"))) for j, (c, lo, hi) in enumerate(wide)]
        rows = df.select(F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.j", "m.b").agg(F.count("*").alias("n"), F.min("m.x").alias("lo"), F.max("m.x").alias("hi")).collect()
        found = {k: sorted((r["b"], r["n"], r["lo"], r["hi"]) for r in rows if r["j"] == j) for j, k in enumerate(wide)}
        for (c, rank), at in place.items():
            for _, n, lo, hi in found.get((c, at[0], at[1]), []) if at[0] < at[1] else []:
                if at[2] + n > rank:
                    at[:2] = lo, hi
                    break
                at[2] += n
    out = {}
    for c in cols:
        n, value = ends[f"n_{c}"], lambda r, c=c: place[c, r][0]
        out[c] = [value(int(p * (n - 1))) + (p * (n - 1) - int(p * (n - 1))) * (value(min(int(p * (n - 1)) + 1, n - 1)) - value(int(p * (n - 1)))) if n else None for p in probs]
    return out


def gini(df: DataFrame, key: str) -> DataFrame:
    """Gini coefficient of rows per key, 2 * sum(i * x) / (n * sum(x)) - (n + 1) / n over ascending counts.

    Keys are first counted by their count: the ordered sums run over distinct counts only.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("x")).groupBy("x").agg(F.count("*").alias("m"))
    w = Window.partitionBy().orderBy("x").rowsBetween(Window.unboundedPreceding, -1)  # over distinct counts
    r = sizes.withColumn("b", F.coalesce(F.sum("m").over(w), F.lit(0)))
    # keys of one count take the places b + 1 .. b + m
    ix = F.col("x") * (F.col("m") * F.col("b") + F.col("m") * (F.col("m") + 1) / 2)
    t = r.agg(F.sum(ix).alias("ix"), F.sum("m").alias("n"), F.sum(F.col("m") * F.col("x")).alias("s"))
    return t.select(F.col("n").alias("keys"), F.round(2 * F.col("ix") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"), 6).alias("gini"))


def frequency(df: DataFrame, c: str, k: int) -> DataFrame:
    """The k most frequent values with their share of all rows."""
    per = df.groupBy(c).agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("t"))
    return per.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), c).limit(k).select(c, "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


def label_crosstab(df: DataFrame, time: str, label: str) -> DataFrame:
    """Counts by year, month and label, each alone and together, with a grand total."""
    y = df.select(F.year(time).alias("year"), F.month(time).alias("month"), F.col(label).alias("label"))
    return y.cube("year", "month", "label").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))


def same_day_conflicts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups of a key with several labels, and the rows in them."""
    per = df.filter(F.col(label).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(label).alias("k"))
    return per.agg(F.count("*").alias("groups"), F.sum((F.col("k") > 1).cast("long")).alias("conflicting"), F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).alias("rows_involved"))


def label_profile(df: DataFrame, key: str, label: str, classes: list[str], least: int, top: int) -> DataFrame:
    """Shares of labels for keys with at least ``least`` rows, the ``top`` largest."""
    per = df.filter(F.col(label).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), *[F.round(F.avg((F.col(label) == c).cast("int")), 6).alias(f"share_{c.lower()}") for c in classes])
    return per.filter(F.col("n") >= least).orderBy(F.desc("n"), key).limit(top)


def flag_profile(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How many rows have each flag, and their share."""
    one = df.agg(F.count("*").alias("t"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(n) for n, c in flags.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("flag"), F.col(n).alias("n"), F.round(F.col(n) / F.col("t"), 6).alias("share")) for n in flags])).alias("x")).select("x.*")


def numeric_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Range, quantiles, mean, population deviation, shares of zeros and negatives, and Tukey outliers (1.5 times the quartiles' distance, from 4 values on).

    All columns share each pass over the rows: one for the moments, a few for the quantiles, one for the outliers.
    """
    probs = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    of = lambda c: [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"), F.avg((F.col(c) == 0).cast("int")).alias(f"zero_{c}"), F.avg((F.col(c) < 0).cast("int")).alias(f"negative_{c}")]
    got, q = df.agg(*[x for c in cols for x in of(c)]).first(), exact_quantiles(df, cols, probs)
    fences = {c: (v[3] - 1.5 * (v[5] - v[3]), v[5] + 1.5 * (v[5] - v[3])) for c, v in q.items() if v[0] is not None}
    outside = df.agg(F.count("*").alias("rows"), *[F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("long")).alias(c) for c, (lo, hi) in fences.items()]).first()
    rows = [(c, got[f"n_{c}"], *[q[c][i] for i in (0, 1, 2, 4, 6, 7, 8)], *[got[f"{k}_{c}"] for k in ("mean", "std", "zero", "negative")], outside[c] if got[f"n_{c}"] >= 4 else 0) for c in cols]
    names = ["min", "p01", "p10", "median", "p90", "p99", "max", "mean", "std", "zero_fraction", "negative_fraction"]
    out = df.sparkSession.createDataFrame(rows, "feature string, n long, " + ", ".join(f"`{k}` double" for k in names) + ", outliers long")
    return out.withColumns({k: F.round(k, 6) for k in names})


def categorical_profile(df: DataFrame, cols: list[str], top: int = 20) -> DataFrame:
    """Per column the ``top`` most frequent values."""
    per = _long(df, cols).filter("v IS NOT NULL").groupBy("feature", "v").agg(F.count("*").alias("n"))
    ranked = per.withColumn("rank", F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("n"), "v")))
    return ranked.filter(F.col("rank") <= top).select("feature", F.col("v").alias("value"), "n", "rank")


def strong_correlations(df: DataFrame, cols: list[str], least: float, shared: int) -> DataFrame:
    """Pearson over rows where both are present, for pairs with enough of them; one pass over the data."""
    pairs = list(combinations(cols, 2))
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))).alias("r"), F.sum(both(a, b).cast("long")).alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    rows = one.select(F.explode(F.array(*[F.col(f"p{i}") for i in range(len(pairs))])).alias("x")).select("x.*")
    return rows.filter((F.abs("r") >= least) & (F.col("n") >= shared)).withColumn("r", F.round("r", 6))


def signal_summary(df: DataFrame, keys: list[str], rank: str, delta: Column, text: str, ident: str, counts: dict[str, str]) -> DataFrame:
    """Count, mean rank, mean difference, maps of counts by the values of other columns, and the three examples with the smallest ids, per key.

    Examples are chosen by id alone, so texts are joined to three ids a key and a hot key's texts never meet in one task.
    """
    from functools import reduce

    same = lambda a, b: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"__{k}"]) for k in keys])
    named = lambda g: g.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in g.columns if c not in keys])
    first = df.select(*keys, ident).withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(ident))).filter(F.col("__k") <= 3)
    few = first.join(df.select(F.col(ident).alias("__i"), F.col(text).alias("__t")), F.col(ident) == F.col("__i")).groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct(ident, "__t"))), 1, 3).alias("__few"))
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(rank), 6).alias("mean_rank"), F.round(F.avg(delta), 6).alias("mean_delta"))
    parts = [few.select(*keys, F.transform("__few", lambda x: x["__t"]).alias("examples"))]
    parts += [df.groupBy(*keys, F.col(c).cast("string").alias("__v")).agg(F.count("*").alias("__n")).filter(F.col("__v").isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__v", "__n"))).alias(name)) for name, c in counts.items()]
    for p in map(named, parts):
        out = out.join(p, same(out, p), "left").drop(*[f"__{k}" for k in keys])
    return out


def stage_profile(runs: DataFrame, stages: str, status: str) -> DataFrame:
    """Per stage of a map of seconds the count, total, mean and largest, and failed runs."""
    return runs.select(F.explode(stages).alias("stage", "seconds"), status).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 4).alias("total"), F.round(F.avg("seconds"), 6).alias("mean"), F.max("seconds").alias("max"), F.sum((F.col(status) == "error").cast("long")).alias("errors"))


def user_rollup(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Activity of a user in two sources (name, ts, url): ``key`` (the name trimmed, in lower case), its first spelling, counts, latest time and its
    url, and which sources know the user. Of one time the smallest url is first and the largest last."""
    of = lambda df: df.select(F.lower(F.trim(name)).alias("key"), F.trim(name).alias("spelling"), "ts", "url")
    part = lambda df, n: of(df).groupBy("key").agg(F.count("*").alias(f"n_{n}"), F.min(F.struct("ts", "url", "spelling")).alias(f"f_{n}"), F.max(F.struct("ts", "url")).alias(f"l_{n}"))
    both = part(a, "a").join(part(b, "b"), "key", "full")
    first, last = F.least("f_a", "f_b"), F.greatest("l_a", "l_b")
    label = F.when(F.col("n_a").isNotNull() & F.col("n_b").isNotNull(), "both").when(F.col("n_a").isNotNull(), "a").otherwise("b")
    return both.select("key", first["spelling"].alias("spelling"), F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), last["ts"].alias("last_at"), last["url"].alias("last_url"), label.alias("sources"))


def validate_rows(df: DataFrame, rules: dict[str, Column], ident: str, examples: int = 3) -> DataFrame:
    """Per rule the rows that break it, with the smallest ids as examples. A null outcome doesn't break a rule."""
    broken = F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in rules.items()]))
    rows = df.select(ident, F.explode(broken).alias("issue"))
    per = rows.groupBy("issue").agg(F.count("*").alias("n"))
    few = rows.withColumn("__k", F.row_number().over(Window.partitionBy("issue").orderBy(ident))).filter(F.col("__k") <= examples).groupBy("issue").agg(F.array_sort(F.collect_list(ident)).alias("examples"))
    return per.join(few, "issue")


def warnings(rules: dict[str, Column]) -> Column:
    """Sorted names of the warnings that hold for a row."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))


def grouping_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension alone, in one pass."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in dims])).alias("x")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))
