"""Operator 12, quality rules: robust multivariate outliers of text statistics, DataFrame functions only.

Per language and source the minimum covariance determinant is estimated: the half of the vectors whose covariance has the least determinant, found by
concentration steps from a robust and from a plain start. Vectors are rejected by their Mahalanobis distance from that half's centre.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowfeat.llm._spark import cut, drop, table

SPACE, NOT_SPACE = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
MIN_WORDS, REPEATED_PERCENT = 50, 50
HALF, STEPS, MIN_ROWS, TAIL = 0.5, 6, 100, 1e-8
GRID = 100  # steps of a transformed statistic to a unit: sums of whole numbers don't depend on the order of rows
BINS = 64  # bins of a distance to a power of two
FLOORS = (0.05, 0.5, 0.5, 1.0)  # least deviations of the transformed statistics


def text_statistics(text: Column) -> dict[str, Column]:
    """Counts of a whole text, null being empty: words, code points in them, symbols, lines equal to an earlier one, words in repeated windows of three."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(NOT_SPACE))
    bound = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  (value is computed once, whatever f does with it)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": bound(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(_repeat_words(w, bound))),
    }


def _repeat_words(words: Column, bound) -> Column:
    """Words in windows of three that occur twice or more. Windows are told apart by 64 bits of hash and, where any hash repeats, by their words."""
    last = F.size(words) - 3
    key = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.transform(F.sequence(F.lit(0), last), key)

    def covered(h: Column) -> Column:
        # whole windows beside their places, in order: equal neighbours are repeats
        at = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
        same = lambda x, y: x.isNotNull() & y.isNotNull() & (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        marked = bound(at, lambda s: F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k + 1)) | F.coalesce(same(x, F.get(s, k - 1)), F.lit(False))), lambda x: x["i"]))
        return bound(marked, lambda m: F.size(F.array_distinct(F.flatten(F.array(m, F.transform(m, lambda i: i + 1), F.transform(m, lambda i: i + 2))))).cast("long"))

    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def transformed(n_words: Column, word_chars: Column, n_symbols: Column, n_dup_lines: Column, n_repeat_words: Column) -> list[Column]:
    """Logarithms of the mean word length, and of symbols per thousand characters, lines and repeated words per hundred words, each and one."""
    words, chars = F.greatest(n_words, F.lit(1)), F.greatest(word_chars, F.lit(1))
    return [F.log(chars / words), F.log1p(1000 * n_symbols / chars), F.log1p(100 * n_dup_lines / words), F.log1p(100 * n_repeat_words / words)]


def chi_square(share: float, p: int) -> float:
    """The value below which a chi-square of p degrees of freedom falls with the given chance."""

    def below(x: float) -> float:
        term = total = 1 / math.gamma(p / 2 + 1)
        for k in range(1, 500):
            term *= x / 2 / (p / 2 + k)
            total += term
        return total * math.exp(-x / 2 + p / 2 * math.log(x / 2))

    lo, hi = 1e-9, 200.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < share else (lo, mid)
    return lo


def pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i + 1)]


def factor(p: int) -> dict[tuple[int, int], Column]:
    """Names of the lower triangle's columns in the estimates."""
    return {(i, j): F.col(f"__l{i}{j}") for i, j in pairs(p)}


def estimates(sums: DataFrame, p: int, floors: tuple[float, ...], scale: float | Column, n: str = "n", keys: tuple[str, ...] = ("__group", "__start")) -> DataFrame:
    """(keys, n, means __m, Cholesky factor __l of the covariance with ``floors`` squared added to its diagonal, its ``logdet``) from sums of rows and of products."""
    out = sums.select(*keys, F.col(n).alias("n"), *[(F.col(f"s{i}") / F.col(n)).alias(f"__m{i}") for i in range(p)], *[f"q{i}{j}" for i, j in pairs(p)])
    cov = {(i, j): (F.col(f"q{i}{j}") / F.col("n") - F.col(f"__m{i}") * F.col(f"__m{j}")) * scale for i, j in pairs(p)}
    out = out.select(*keys, "n", *[f"__m{i}" for i in range(p)], *[(cov[i, j] + (F.lit((floors[i] * GRID) ** 2) if i == j else 0.0)).alias(f"__c{i}{j}") for i, j in pairs(p)])
    for j in range(p):  # column by column, each named before the next one uses it
        low = factor(p)
        known = lambda i, j=j, low=low: reduce(Column.__sub__, [low[i, k] * low[j, k] for k in range(j)], F.col(f"__c{i}{j}"))
        out = out.withColumn(f"__l{j}{j}", F.sqrt(F.greatest(known(j), F.lit(1e-9))))
        out = out.withColumns({f"__l{i}{j}": known(i) / F.col(f"__l{j}{j}") for i in range(j + 1, p)})
    logdet = 2 * reduce(Column.__add__, [F.log(F.col(f"__l{i}{i}")) for i in range(p)])
    return out.withColumn("logdet", logdet).drop(*[f"__c{i}{j}" for i, j in pairs(p)])


def distance(p: int) -> Column:
    """The squared Mahalanobis distance of the row's x0, x1, ... from the estimate beside it, by forward substitution."""
    low, z = factor(p), []
    for i in range(p):
        z.append(reduce(Column.__sub__, [low[i, k] * z[k] for k in range(i)], F.col(f"x{i}") - F.col(f"__m{i}")) / low[i, i])
    return reduce(Column.__add__, [v * v for v in z])


def _sums(p: int) -> list[Column]:
    x = [F.col(f"x{i}") for i in range(p)]
    return [F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in pairs(p)]]


def _add(p: int) -> list[Column]:
    return [F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(p)], *[f"q{i}{j}" for i, j in pairs(p)]]]


def medians(rows: DataFrame, p: int, of: list[Column]) -> DataFrame:
    """(__group, d0, d1, ...): lower medians of whole numbers for each group, from counts of their values."""
    long = rows.select("__group", F.posexplode(F.array(*[c.cast("long") for c in of])).alias("k", "v"))
    counts = long.groupBy("__group", "k", "v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("__group", "k")
    ranked = counts.withColumns({"below": F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), "all": F.sum("c").over(w)})
    middle = ranked.filter((2 * F.coalesce("below", F.lit(0)) < F.col("all")) & (2 * (F.coalesce("below", F.lit(0)) + F.col("c")) >= F.col("all")))
    return middle.groupBy("__group").agg(*[F.max(F.when(F.col("k") == i, F.col("v"))).alias(f"d{i}") for i in range(p)])


def covariance_determinants(rows: DataFrame, p: int, floors: tuple[float, ...], half: float = HALF, steps: int = STEPS) -> DataFrame:
    """(__group, means, factor) of the minimum covariance determinant of rows (__group, x0, x1, ...; whole numbers), and its reweighted estimate in the end.

    Starts: medians with median deviations, and mean with covariance. A concentration step takes the ``half`` of a group's rows nearest to the last
    estimate; distances fall into bins, sums of each bin are added up, so one job of small rows does a step for all groups and starts. All of the bin that
    completes the half come in, so ties don't depend on the order of rows. The start of lesser determinant is taken.
    """
    middle = medians(rows, p, [F.col(f"x{i}") for i in range(p)])
    apart = rows.join(middle, "__group").select("__group", *[F.abs(F.col(f"x{i}") - F.col(f"d{i}")).alias(f"x{i}") for i in range(p)])
    spread = medians(apart, p, [F.col(f"x{i}") for i in range(p)]).select("__group", *[F.col(f"d{i}").alias(f"e{i}") for i in range(p)])
    robust = middle.join(spread, "__group").select(
        "__group", F.lit(0).alias("__start"), *[F.col(f"d{i}").cast("double").alias(f"__m{i}") for i in range(p)], *[(F.sqrt((1.4826 * F.col(f"e{i}")) ** 2 + (floors[i] * GRID) ** 2) if i == j else F.lit(0.0)).alias(f"__l{i}{j}") for i, j in pairs(p)]
    )
    plain = estimates(rows.groupBy("__group").agg(*_sums(p)).withColumn("__start", F.lit(1)), p, floors, 1.0)
    at = robust.unionByName(plain.select(robust.columns))
    at = cut(at, "mcd")
    few = [f"__m{i}" for i in range(p)] + [f"__l{i}{j}" for i, j in pairs(p)]
    for step in range(steps):
        bin_ = F.floor(F.log2(F.greatest(distance(p), F.lit(1e-6))) * BINS).cast("int")
        binned = rows.join(at.select("__group", "__start", *few), "__group").groupBy("__group", "__start", bin_.alias("bin")).agg(*_sums(p))
        w = Window.partitionBy("__group", "__start")
        nearest = binned.withColumns({"below": F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "all": F.sum("n").over(w)})
        new = cut(estimates(nearest.filter(F.col("below") < F.ceil(half * F.col("all"))).groupBy("__group", "__start").agg(*_add(p)), p, floors, 1.0), "mcd")
        drop(at)
        at = new
    best = at.groupBy("__group").agg(F.min_by(F.struct("__start", *few), F.struct("logdet", "__start")).alias("b")).select("__group", "b.*")
    # the half's covariance is too small by a known share; within .975 of the right one, rows count once more
    consistent = half / _share_below(chi_square(half, p), p + 2)
    near = rows.join(best, "__group").filter(distance(p) <= chi_square(0.975, p) * consistent)
    again = near.groupBy("__group").agg(*_sums(p)).withColumn("__start", F.lit(0))
    return estimates(again, p, floors, 0.975 / _share_below(chi_square(0.975, p), p + 2)).select("__group", *few)


def _share_below(x: float, p: int) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, p) < x else (lo, mid)
    return lo


def outlier_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"), min_rows: int = MIN_ROWS, half: float = HALF, steps: int = STEPS, tail: float = TAIL, floors: tuple[float, ...] = FLOORS
) -> DataFrame:
    """(id, counts of ``text_statistics``, ``base_failed``, ``distance``, ``kept``) of every row of docs.

    ``base_failed``: under ``MIN_WORDS`` words, or over ``REPEATED_PERCENT`` of 100 words in repeated windows. Of the others those are kept whose squared
    distance from their group's estimate is at most the chi-square value of ``tail``; ``floors`` are least deviations, so that a statistic
    that hardly varies in a group rejects nothing for a small step.

    Groups are language and source, null being a value of its own. Sources of under ``min_rows`` rows are taken together for each
    language, and languages that have fewer even then all together; where that leaves too few, no vector is rejected and the distance is null. Null and
    empty texts have no words and fail. Repeated rows stand for themselves each. An empty table gives an empty table; further columns play no part.

    Texts are read once and never shuffled; what follows is on rows of a few numbers. Every estimate comes from sums that add up per group, so a
    group with a third of all rows is summed in all tasks; estimates are small tables that Spark joins as it sees fit. The number of jobs is fixed by ``steps``.
    """
    counts = text_statistics(F.col(text_col))
    names, p = list(counts), len(floors)
    group = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in group_cols[:1]]), F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in group_cols])
    stats = docs.select(F.col(id_col).alias("__id"), group[0].alias("__wide"), group[1].alias("__group"), *[c.alias(n) for n, c in counts.items()])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    x = transformed(*[F.col(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
    stats = cut(stats.withColumn("base_failed", failed).withColumns({f"x{i}": F.round(c * GRID).cast("long") for i, c in enumerate(x)}), "statistics")
    good = stats.filter(~F.col("base_failed"))
    sizes = good.groupBy("__wide", "__group").agg(F.count("*").alias("c"))
    small = F.sum(F.when(F.col("c") < min_rows, F.col("c")).otherwise(0)).over(Window.partitionBy("__wide"))
    named = sizes.withColumn("pool", small).select("__group", F.when(F.col("c") >= min_rows, F.col("__group")).when(F.col("pool") >= min_rows, F.concat(F.lit("lang"), F.col("__wide"))).otherwise("rest").alias("__of"))
    named = cut(named, "groups")
    vectors = cut(good.join(named, "__group").select(F.col("__of").alias("__group"), *[f"x{i}" for i in range(p)]), "vectors")
    enough = vectors.groupBy("__group").agg(F.count("*").alias("c")).filter(F.col("c") >= min_rows).select("__group")
    fitted = covariance_determinants(vectors.join(enough, "__group", "left_semi"), p, floors, half, steps)
    fitted = cut(fitted.withColumnRenamed("__group", "__of"), "fitted")
    drop(vectors)
    far = F.when(~F.col("base_failed"), distance(p))
    judged = stats.join(named, "__group", "left").join(fitted, "__of", "left").withColumn("distance", far)
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi_square(1 - tail, p), F.lit(True))
    return judged.select(F.col("__id").alias(id_col), *names, "base_failed", "distance", kept.alias("kept"))


def op12_outlier_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outlier_rules(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("distance", 3).alias("distance"))
