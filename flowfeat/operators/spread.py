"""Keys that hold more rows than one task should: exact ranks by sampled ranges, windows over blocks of ranks, and quantiles by narrowed intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowfeat.sources.shared import cut, drop

MOST = 1_000_000  # rows of a key that one window takes; a key with more is cut into blocks
BLOCK = 100_000
LISTED = 4_096  # values that an interval may hold to be sorted in one list
ALIKE = 256  # ids that one row lists of those with the same key
PAIRED = 4_096  # ids that a block of a cell holds, about, on either side


def dealt(df: DataFrame, *cols: str) -> DataFrame:
    """df by hashes of ``cols`` in as many tasks as a shuffle has, for steps that make many rows of few: by its bytes such a table would be one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def alike(df: DataFrame, key: list[str], ident: str, most: int | None = None) -> DataFrame:
    """(key, ids): rows with the same key as one row that lists their ids in order, so that what hangs on the key alone is worked out once for all; rows with a null
    in the key are left out. A key of over ``most`` rows is told apart into several by a hash of the ids, so no list is long and no task has all of them."""
    most = most or ALIKE
    rows = df.select(*key, F.col(ident).alias("__id")).dropna(subset=key)
    if is_hot(rows, key, most):
        many = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.ceil(F.count("*") / most).alias("__lists")).filter("__lists > 1")
        rows = rows.join(many, null_safe(rows, many, [(k, f"__{k}") for k in key]), "left")
        rows = rows.select(*key, "__id", F.coalesce(F.pmod(F.xxhash64("__id"), F.col("__lists")), F.lit(0)).alias("__list"))
    else:
        rows = rows.withColumn("__list", F.lit(0).cast("long"))
    by = [*key, "__list"]
    return cut(dealt(rows, *by).groupBy(*by).agg(F.array_sort(F.collect_list("__id")).alias("ids")).drop("__list"), "alike")


def paired(left: DataFrame, right: DataFrame, cell: list[str], times: int = 1) -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, keys): rows of ``alike`` with columns ``cell``, dealt for a join over ``keys`` in which each left row meets each right row of its cell once.

    A cell with over ``PAIRED`` ids on a side (some ``times`` as many, where rows are large) is cut into blocks by hashes, and every left block meets every right one in a part of its own: a cell's pairs are made in many tasks,
    and a task holds a few blocks. Rows are copied once for each block of the other side of their cell; those whose cell has none go.
    """
    blocks = lambda df, n: df.groupBy(*cell).agg(F.ceil(F.sum(F.size("ids")) / (times * PAIRED)).alias(n))
    n = cut(blocks(left, "__nl").join(blocks(right, "__nr"), cell), "blocks")
    own = lambda n: F.pmod(F.xxhash64(F.get("ids", 0)), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    keys = [*cell, "__l", "__r"]
    sides = left.join(n, cell).withColumn("__l", own("__nl")).withColumn("__r", each("__nr")), right.join(n, cell).withColumn("__l", each("__nl")).withColumn("__r", own("__nr"))
    return *[dealt(df.drop("__nl", "__nr"), *keys) for df in sides], keys


def expanded(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """(a, b, value) of each id of ``ids`` with each of ``other``."""
    return pairs.select(F.explode("ids").alias(a), "other", value).select(a, F.explode("other").alias(b), value)


def rounded(value: Column, digits: int | None) -> Column:
    """A value rounded as a binary number, as the SQL does, not as its shortest decimal; as it is for no digits."""
    return value if digits is None else F.round(value * 10**digits) / 10**digits


def null_safe(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(Column.__and__, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def ranked(df: DataFrame, key: list[str], order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """df with each row's place from 0 on among its key's rows by ``order``; no key (an empty list: no table) is ever in one task.

    Rows are dealt by sampled ranges of (key, order) and numbered where they lie; a small table of (key, part) holds how many rows of the key lie in earlier
    parts. The numbered rows are written, so that a lost task can't number them anew. ``order`` should tell rows of a key apart; rows that it doesn't stand in any order.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*key, *order]
    placed = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__at", 33)), "placed")
    own = [f"__k{i}" for i in range(len(key))]
    first = placed.groupBy(*[F.col(k).alias(o) for k, o in zip(key, own)], F.col("__part").alias("__p")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    w = (Window.partitionBy(*own) if key else Window.partitionBy()).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each part
    first = first.withColumn("__shift", F.coalesce(F.sum("__n").over(w), F.lit(0)) - F.col("__first"))
    return placed.join(first, null_safe(placed, first, [("__part", "__p"), *zip(key, own)])).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__part", "__p", "__first", "__n", "__shift", *own)


def is_hot(df: DataFrame, key: list[str], most: int) -> bool:
    """Whether any key holds over ``most`` rows: a count that is summed before the shuffle."""
    return not df.groupBy(*key).agg(F.count("*").alias("__n")).filter(F.col("__n") > most).limit(1).isEmpty()


def in_blocks(df: DataFrame, key: list[str], order: list[str], halo: int, most: int = MOST, block: int = BLOCK) -> tuple[DataFrame, list[str]]:
    """(rows, window key): rows for windows that reach back ``halo`` rows of their key, the key being cut into blocks if any holds over ``most`` rows.

    A block also has the ``halo`` rows before it, where ``__own`` is false: those are dropped once the window is computed. So a hot key's rows are
    spread over as many tasks as it has blocks.
    """
    if halo >= block:
        raise ValueError("a block must hold more rows than a window reaches back")
    if not is_hot(df, key, most):
        return df.withColumn("__own", F.lit(True)), key
    rows = ranked(df, key, order, "__rank")
    b = F.floor(F.col("__rank") / block)
    also = F.when(F.col("__rank") % block >= block - halo, F.struct((b + 1).alias("block"), F.lit(False).alias("own")))
    dealt = rows.withColumn("__b", F.explode(F.array_compact(F.array(F.struct(b.alias("block"), F.lit(True).alias("own")), also))))
    return dealt.withColumns({"__block": F.col("__b.block"), "__own": F.col("__b.own")}).drop("__b", "__rank"), [*key, "__block"]


def owned(df: DataFrame) -> DataFrame:
    """Without the rows that ``in_blocks`` lent to a later block."""
    return df.filter("__own").drop("__own", "__block")


def grouped_quantiles(df: DataFrame, by: list[str], cols: dict[str, Column], probs: list[float], bins: int = 256, listed: int = LISTED) -> DataFrame:
    """(by, one array of the quantiles ``probs`` for each of ``cols``), with linear interpolation, nulls and NaN left out; a null array for a group without values.

    Each wanted rank is a row of a small table with the interval of values that holds it. An interval of over ``listed`` values is cut into ``bins``, which are
    counted, and the rank's bin with its least and largest value is the next interval; the others are sorted in a list. So no task ever holds a
    group's values, and the driver holds none.
    """
    names = list(cols)
    value = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    group = F.struct(*[F.col(b).alias(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))
    rows = df.select(group.alias("g"), F.explode(F.array_compact(F.array(*[F.when(value(c).isNotNull(), F.struct(F.lit(i).alias("c"), value(c).alias("x"))) for i, c in enumerate(cols.values())]))).alias("v")).select("g", "v.c", "v.x")
    ends = rows.groupBy("g", "c").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    low = lambda p: F.floor((F.col("n") - 1) * F.lit(p))
    spots = F.explode(F.array_distinct(F.array(*[x for p in probs for x in (low(p), F.least(low(p) + 1, F.col("n") - 1))])))
    place = cut(ends.select("g", "c", F.col("n").alias("all"), spots.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside")), "ranks")
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > listed)

    def within(spans: DataFrame) -> DataFrame:
        s = spans.select(F.col("g").alias("sg"), F.col("c").alias("sc"), "lo", "hi").distinct()
        return rows.join(s, (F.col("g") == F.col("sg")) & (F.col("c") == F.col("sc")) & F.col("x").between(F.col("lo"), F.col("hi"))).drop("sg", "sc")

    while not place.filter(wide).isEmpty():
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins).cast("int"))
        counts = within(place.filter(wide)).groupBy("g", "c", "lo", "hi", at.alias("bin")).agg(F.count("*").alias("m"), F.min("x").alias("least"), F.max("x").alias("most"))
        w = Window.partitionBy("g", "c", "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each bin
        counts = counts.withColumn("below", F.coalesce(F.sum("m").over(w), F.lit(0)))
        old = place.filter(wide)
        narrowed = old.join(counts, ["g", "c", "lo", "hi"]).filter((F.col("before") + F.col("below") <= F.col("rank")) & (F.col("before") + F.col("below") + F.col("m") > F.col("rank")))
        new = cut(narrowed.select("g", "c", "all", "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("before") + F.col("below")).alias("before"), F.col("m").alias("inside")).union(place.filter(~wide)), "ranks")
        drop(place)
        place = new
    lists = within(place.filter("lo < hi")).groupBy("g", "c", "lo", "hi").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    found = place.join(lists, ["g", "c", "lo", "hi"], "left").select("g", "c", "all", "rank", F.coalesce(F.get("xs", (F.col("rank") - F.col("before")).cast("int")), F.col("lo")).alias("x"))
    per = found.groupBy("g", "c").agg(F.max("all").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))

    def quantile(p: float) -> Column:
        exact = (F.col("n") - 1) * F.lit(p)
        low = F.floor(exact)
        a, b = F.element_at("at", low), F.element_at("at", F.least(low + 1, F.col("n") - 1))
        return a + (exact - low) * (b - a)

    arrays = per.select("g", "c", F.array(*[quantile(p) for p in probs]).alias("q")).groupBy("g").agg(*[F.max(F.when(F.col("c") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])
    groups = df.select(group.alias("g")).distinct() if by else None
    full = groups.join(arrays, "g", "left") if by else arrays
    return full.select(*[F.col("g")[b].alias(b) for b in by], *names)
