"""Dedup, upsert, merge and incremental filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowfeat.operators.spread import ranked


def pending_windows(windows: DataFrame, done: DataFrame, ident: str, start: str, batch: int, limit: int | None = None) -> DataFrame:
    """Windows not yet done, in batches of ``batch`` by (start, id) that run on over all of them; with ``limit`` the first ones only. Ids without a window of theirs done count as pending, null ids too."""
    left = windows.join(done.select(ident).distinct(), ident, "left_anti")
    rows = ranked(left, [], [start, ident], "__rank")
    rows = rows if limit is None else rows.filter(F.col("__rank") < limit)
    return rows.withColumn("batch", F.floor(F.col("__rank") / batch).cast("long")).drop("__rank")


def latest_run(runs: DataFrame, key: list[str], generated: str, ties: list[str]) -> DataFrame:
    """The run with the largest (date, ties); a missing date counts as the smallest."""
    rank = F.struct(F.coalesce(F.col(generated).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")), *ties)
    return runs.groupBy(*key).agg(F.max_by(F.struct(*[c for c in runs.columns if c not in key]), rank).alias("__r")).select(*key, "__r.*")


def needs_recompute(results: DataFrame, overrides: DataFrame, ident: str) -> DataFrame:
    """Ids whose result is missing, failed, or made for another point than the override's (``point``)."""
    both = results.join(overrides.select(ident, F.col("point").alias("__want")), ident, "full")
    again = F.col("status").isNull() | (F.col("status") == "error") | ~F.col("point").eqNullSafe(F.coalesce("__want", "point"))
    return both.select(ident, F.when(again, True).otherwise(False).alias("recompute"))


def join_with_skips(left: DataFrame, right: DataFrame, on: list[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """Matched rows, and unmatched ones of the left with a reason."""
    return left.join(right, on), left.join(right.select(*on).distinct(), on, "left_anti").withColumn("reason", F.lit(reason))


def dedup_first(df: DataFrame, key: list[str | Column], order: list[str]) -> DataFrame:
    """Of the rows of a key the first in the given order; a null in the key is a value of its own."""
    cols = [F.col(k) if isinstance(k, str) else k for k in key]
    kept = df.groupBy(*[c.alias(f"__k{i}") for i, c in enumerate(cols)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("__r"))
    return kept.select("__r.*")


def union_dedup(first: DataFrame, second: DataFrame, key: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of both, those of the first source before those of the second; and what was left out."""
    both = first.withColumn("__source", F.lit(0)).unionByName(second.withColumn("__source", F.lit(1)), allowMissingColumns=True)
    ranked = both.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("__source", *order)))
    return ranked.filter("__n = 1").drop("__n", "__source"), ranked.filter("__n > 1").drop("__n", "__source")


def upsert(base: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of the same key and are added otherwise."""
    return base.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def merge_keep_state(old: DataFrame, new: DataFrame, key: str, values: list[str], flags: list[str], largest: list[str], local: list[str]) -> DataFrame:
    """New values where there are any, flags set in either, the larger of ``largest``, and the old row's ``local`` columns."""
    o, n = old.alias("o"), new.alias("n")
    c = lambda side, x: F.col(f"{side}.{x}")
    return o.join(n, c("o", key) == c("n", key), "full").select(
        F.coalesce(c("n", key), c("o", key)).alias(key),
        *[F.coalesce(c("n", v), c("o", v)).alias(v) for v in values],
        *[(F.coalesce(c("n", v), F.lit(False)) | F.coalesce(c("o", v), F.lit(False))).alias(v) for v in flags],
        *[F.greatest(c("n", v), c("o", v)).alias(v) for v in largest],
        *[F.coalesce(c("o", v), F.lit(False)).alias(v) for v in local],
    )


def fill_missing(base: DataFrame, extra: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Only null or empty values are replaced; ``changed`` lists the columns that were."""
    b, e = base.alias("b"), extra.alias("e")
    joined = b.join(e, F.col(f"b.{key}") == F.col(f"e.{key}"), "left")
    empty = lambda c: F.nullif(F.col(f"b.{c}").cast("string"), F.lit("")).isNull()
    filled = [F.when(empty(c), F.coalesce(F.col(f"e.{c}"), F.col(f"b.{c}"))).otherwise(F.col(f"b.{c}")).alias(c) for c in cols]
    changed = F.array_compact(F.array(*[F.when(empty(c) & F.col(f"e.{c}").isNotNull(), F.lit(c)) for c in cols]))
    rest = [F.col(f"b.{c}") for c in base.columns if c not in cols]
    return joined.select(*rest, *filled, changed.alias("changed"))


def add_absent(points: DataFrame, extra: DataFrame, key: str, kind: str) -> DataFrame:
    """Points and those extra ones whose kind the key has none of; ``change`` names what was added. Of one kind the extra point that comes first in the order of its columns is added."""
    rest = [c for c in extra.columns if c not in (key, kind)]
    new = extra.join(points.select(key, kind).distinct(), [key, kind], "left_anti").groupBy(key, kind).agg(F.min(F.struct(*rest)).alias("__p")).select(key, kind, *[F.col(f"__p.{c}") for c in rest])
    return points.withColumn("change", F.lit(None).cast("string")).unionByName(new.withColumn("change", F.concat(F.lit("point:"), F.col(kind))))


def overlay_merge(base: DataFrame, app: DataFrame, overlay: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Base and app rows; the overlay's values replace theirs; ``error`` names id collisions and overlays of unknown rows."""
    rows = base.withColumn("__s", F.lit("base")).unionByName(app.withColumn("__s", F.lit("app")))
    twice = rows.groupBy(key).agg(F.count("*").alias("__n"), F.first(F.struct(*cols)).alias("__r"))
    o = overlay.select(F.col(key).alias("__o"), *[F.col(c).alias(f"__{c}") for c in cols])
    out = twice.join(o, F.col(key) == F.col("__o"), "full")
    error = F.when(F.col(key).isNull(), "unknown target").when(F.col("__n") > 1, "id collision")
    return out.select(F.coalesce(key, "__o").alias(key), *[F.coalesce(F.col(f"__{c}"), F.col(f"__r.{c}")).alias(c) for c in cols], error.alias("error"))


def pick_by_priority(candidates: DataFrame, site: str, priority: str, resolved: str) -> DataFrame:
    """Per site the first resolved candidate by priority, else the first one; ``unresolved`` marks the latter."""
    rest = [c for c in candidates.columns if c != site]
    best = candidates.groupBy(site).agg(F.min_by(F.struct(*rest), F.struct(~F.col(resolved), F.col(priority))).alias("__r"))
    return best.select(site, "__r.*").withColumn("unresolved", ~F.col(resolved))


def verify_counts(tables: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """Actual against expected counts; what is missing in either is a mismatch."""
    out = None
    for name in sorted(set(tables) | set(expected)):
        t = tables.get(name)
        n = expected.get(name)
        row = (t.agg(F.count("*").alias("actual")) if t is not None else next(iter(tables.values())).sparkSession.range(1).select(F.lit(None).cast("long").alias("actual"))).select(F.lit(name).alias("table"), "actual", F.lit(n).cast("long").alias("expected"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("actual").eqNullSafe(F.col("expected")))
