"""Operator 13, filter interaction audit: what each filter removes in every order, from additive counts of failure masks.

Duplicates are found behind a counting-Bloom prepass. Tasks count the cells of text hashes, their sketches are merged, and a text one of whose cells was
hit once only is certainly unique: it takes no part in the shuffle of whole texts that finds the least id of each repeated one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._spark import cut, drop, table
from flowfeat.llm._text import mix, release

SPACE = r"[\x20\x09-\x0D]+"
DUPLICATE = "E"
CELLS, PROBES, SHARD = 8, 3, 1 << 22  # cells of the sketch per row, cells of a text, and cells of a shard of the sketch
BROADCAST = 32 << 20  # bytes of a merged sketch that go to every worker; larger ones are tested shard by shard
FLUSH = 1 << 20  # texts that a task holds before its sketch is written


def cells(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each hash, its ``PROBES`` cells there, one row for each hash)"""
    x = mix(h.view(np.uint64))
    shard = (x % np.uint64(shards)).astype(np.int64)
    at = np.stack([(mix(x ^ np.uint64(0x9E3779B97F4A7C15 >> k)) % np.uint64(SHARD)).astype(np.int64) for k in range(PROBES)], 1)
    return shard, at


def sketches(rows: DataFrame, shards: int) -> DataFrame:
    """(shard, hit): one row for each shard of the merged sketch, with a bit for each cell that rows hit twice or more.

    A task counts the cells of its rows, up to two, and sends those that it hit as numbers: no more than ``PROBES`` of them a row and no more than the
    sketch has cells, whatever the number of copies. The shards are then added up, each in one task of fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def partial() -> Iterator[pa.RecordBatch]:
            shard, at = cells(np.concatenate(held), shards)
            cell, n = np.unique(shard[:, None] * SHARD + at, return_counts=True)
            for k in np.unique(cell // SHARD).tolist():
                mine = cell // SHARD == k
                parts = [(cell[mine & few] % SHARD).astype("<u4").tobytes() for few in (n == 1, n > 1)]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *[pa.array([x], pa.binary()) for x in parts]], names=["shard", "once", "more"])
            held.clear()

        for b in batches:
            held.append(b.column("h").to_numpy())
            if sum(map(len, held)) >= FLUSH:
                yield from partial()
        if held:
            yield from partial()
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(SHARD, np.uint8)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(total > 1, bitorder="little").tobytes()], pa.binary())], names=["shard", "hit"])

        for b in batches:
            for k, once, more in zip(b.column("shard").to_pylist(), b.column("once").to_pylist(), b.column("more").to_pylist()):
                if k != now:
                    if now is not None:
                        yield done()
                    now, total = k, np.zeros(SHARD, np.uint8)
                x = np.frombuffer(once, "<u4")
                total[x] = np.minimum(total[x] + 1, 2)
                total[np.frombuffer(more, "<u4")] = 2
        if now is not None:
            yield done()
        release()

    return rows.select("h").mapInArrow(count, "shard long, once binary, more binary").repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "shard long, hit binary")


def tested(h: np.ndarray, shards: int, hit: dict[int, np.ndarray]) -> np.ndarray:
    """True for hashes all of whose cells were hit twice or more: of texts that may repeat."""
    shard, at = cells(h, shards)
    out = np.zeros(len(h), bool)
    for k in np.unique(shard).tolist():
        mine = np.flatnonzero(shard == k)
        bits = hit.get(k)
        out[mine] = False if bits is None else ((bits[at[mine] >> 3] >> (at[mine] & 7).astype(np.uint8)) & 1).all(1)
    return out


def possible_repeats(rows: DataFrame, n: int, broadcast: int = BROADCAST) -> tuple[DataFrame, Column | None]:
    """(distinct hashes ``h`` of texts that may repeat or null, test of a column of hashes or null): one of the two.

    The sketch has ``CELLS`` cells a row. Up to ``broadcast`` bytes it goes to every worker and texts are tested where they lie. Beyond, hashes
    meet the shard that they belong to, once for each task that holds them.
    """
    spark = rows.sparkSession
    shards = max(1, -(-n * CELLS // SHARD))
    merged = cut(sketches(rows, shards), "sketch")
    if shards * SHARD // 8 <= broadcast:
        held = spark.sparkContext.broadcast({r["shard"]: r["hit"] for r in merged.toLocalIterator()})
        drop(merged)

        @F.pandas_udf("boolean")
        def maybe(h: pd.Series) -> pd.Series:
            return pd.Series(tested(h.to_numpy(), shards, {k: np.frombuffer(x, np.uint8) for k, x in held.value.items()}))

        return None, maybe

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.unique(b.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(cells(h, shards)[0]), pa.array(h)], names=["shard", "h"])

    def test(key, mine: pd.DataFrame, sketch: pd.DataFrame) -> pd.DataFrame:
        h = mine["h"].drop_duplicates().to_numpy()
        return pd.DataFrame({"h": h[tested(h, shards, {key[0]: np.frombuffer(sketch["hit"].iloc[0], np.uint8)})] if len(sketch) and len(h) else np.zeros(0, np.int64)})

    by_shard = rows.select("h").mapInArrow(distinct, "shard long, h long").dropDuplicates(["shard", "h"])
    return by_shard.groupBy("shard").cogroup(merged.groupBy("shard")).applyInPandas(test, "h long"), None


def filter_flags(docs: DataFrame, filters: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", duplicate: str = DUPLICATE, keep: dict[str, Column] | None = None, broadcast: int = BROADCAST) -> DataFrame:
    """(id, the columns of ``keep``, ``mask``) of every row of docs: bit k of the mask is set if the row fails the k-th filter of ``filters``.

    Filters are conditions that hold for rows that fail; a null one is no failure. ``duplicate``, the last bit, fails a row whose text is that of a smaller id,
    removed or not; a null text is an empty one. Rows that share id and text don't fail by each other; a row with a null id neither fails as a duplicate nor
    makes another one fail. Any columns may stand in docs. An empty table gives an empty table.

    Texts are read twice. The first pass writes hash, mask and id of every row; the sketch of the hashes then clears certainly unique texts. The second pass
    sends texts that may repeat, and no others, to their group, each once for each task; the group is the whole text, so hashes decide nothing about equality.
    """
    keep = keep or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = reduce(Column.__add__, [F.when(F.coalesce(bad, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)) for k, bad in enumerate(filters.values())], F.lit(0))
    kept = [v.alias(f"__keep{i}") for i, v in enumerate(keep.values())]
    rows = cut(docs.select(F.col(id_col).alias("__id"), *kept, mask.alias("__mask"), F.xxhash64(text).alias("h")), "flags")
    hashes, maybe = possible_repeats(rows, rows.count(), broadcast)
    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id"), text.alias("__text"), F.xxhash64(text).alias("h"))
    if maybe is None:
        hashes = cut(hashes, "possible")
        again = texts.join(hashes, "h", "left_semi")
        of_text = rows.join(hashes.withColumn("__maybe", F.lit(True)), "h", "left").withColumn("__maybe", F.coalesce("__maybe", F.lit(False)))
    else:
        again = texts.filter(maybe("h"))
        of_text = rows.withColumn("__maybe", maybe("h"))
    firsts = again.groupBy("__text").agg(F.min("__id").alias("__id"), F.first("h").alias("h")).select("__id", "h", F.lit(True).alias("__first"))
    unique = of_text.filter(~F.col("__maybe") | F.col("__id").isNull()).withColumn("__first", F.lit(True))
    repeated = of_text.filter(F.col("__maybe") & F.col("__id").isNotNull()).join(firsts, ["__id", "h"], "left")
    out = unique.unionByName(repeated)
    bit = F.when(F.col("__first").isNull(), F.lit(1 << len(filters))).otherwise(F.lit(0))
    return out.select(F.col("__id").alias(id_col), *[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], (F.col("__mask") + bit).alias("mask"))


def mask_counts(flags: DataFrame, by: list[str], measures: dict[str, Column], n_filters: int) -> DataFrame:
    """(by, one array of 2 ** n_filters counts for each measure): how many rows of each mask hold the measure's condition. Counts add up, so copies and hot parts are summed before the shuffle."""
    counts = flags.groupBy(*by, "mask").agg(*[F.count(F.when(c, 1)).alias(m) for m, c in measures.items()])
    at = lambda m: F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(m))), F.lit(0)).cast("long") for k in range(1 << n_filters)]).alias(m)
    return counts.groupBy(*by).agg(*[at(m) for m in measures])


def interaction(counts: DataFrame, by: list[str], letters: str) -> DataFrame:
    """Rows for each part, order of the filters and step: what the step keeps and removes, from arrays ``n``, ``good`` and ``toxic`` of counts by mask.

    A row that fails several filters is removed by the first of them, so a mask with s of them is removed by each in a 1/s of all orders; ``shapley``
    adds that up over all orders. The orders are k! (at most 8 filters).
    """
    k = len(letters)
    if k > 8:
        raise ValueError("at most 8 filters: all their orders are listed")
    places = {c: i for i, c in enumerate(letters)}
    steps = [(order, i, sum(1 << places[c] for c in order[:i]), 1 << places[order[i]]) for order in map("".join, permutations(letters)) for i in range(k)]
    step = "struct<filter_order:string,step:int,before:int,bit:int>"
    listed = F.from_json(F.lit("[" + ",".join(f'{{"filter_order":"{o}","step":{i + 1},"before":{b},"bit":{x}}}' for o, i, b, x in steps) + "]"), f"array<{step}>")
    every = counts.withColumn("s", F.explode(listed)).select(*by, "n", "good", "toxic", "s.*")
    masks = F.sequence(F.lit(0), F.lit((1 << k) - 1))

    def total(of: str, holds) -> Column:
        return F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a + F.when(holds(m), F.get(of, m)).otherwise(F.lit(0)))

    bit, before = F.col("bit"), F.col("before")
    first = lambda m: (m.bitwiseAND(bit) > 0) & (m.bitwiseAND(before) == 0)
    share = F.aggregate(masks, F.lit(0).cast("long"), lambda a, m: a + F.when(m.bitwiseAND(bit) > 0, F.get("n", m) * (F.lit(factorial(k)) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).otherwise(F.lit(0)))
    return every.select(
        *by,
        "filter_order",
        "step",
        total("n", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"),
        total("n", first).alias("removed"),
        total("n", lambda m: (m.bitwiseAND(bit) > 0) & (m.bitwiseAND(before) > 0)).alias("redundant"),
        F.get("n", bit).alias("unique_fails"),
        total("good", first).alias("good_lost"),
        total("toxic", first).alias("toxic_lost"),
        share.alias("shapley"),
    )


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D: few words, few distinct words, many capitals, symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = text_filters(F.col("text"))
    flags = filter_flags(table(spark, sf_dir, "documents"), filters, keep={"part": F.coalesce(F.col("lang"), F.lit(""))})
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    labelled = flags.join(labels, "doc_id", "left")
    letters = "".join(filters) + DUPLICATE
    counts = mask_counts(labelled, ["part"], {"n": F.lit(True), "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1}, len(letters))
    return interaction(counts, ["part"], letters)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), f AS (
  SELECT d.doc_id, part, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
         doc_id > min(doc_id) OVER (PARTITION BY text) AS E, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l USING (doc_id)
), x AS (
  SELECT doc_id, part, good, toxic, ['A', 'B', 'C', 'D', 'E'] AS l, [A, B, C, D, E] AS bad, A::INT + B::INT + C::INT + D::INT + E::INT AS n_bad FROM f
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), s AS (
  SELECT filter_order, step, filter_order[step] AS c FROM o, range(1, 6) t(step)
), r AS (
  SELECT x.*, o.filter_order, list_min(list_transform(list_filter(range(1, 6), lambda i: bad[i]), lambda i: strpos(o.filter_order, l[i]))) AS gone_at FROM x, o
), g AS (
  SELECT part, s.filter_order, s.step, s.c, count(*) FILTER (gone_at IS NULL OR gone_at > s.step) AS kept, count(*) FILTER (gone_at = s.step) AS removed,
         count(*) FILTER (gone_at < s.step AND bad[list_position(l, s.c)]) AS redundant, count(*) FILTER (n_bad = 1 AND bad[list_position(l, s.c)]) AS unique_fails,
         count(*) FILTER (gone_at = s.step AND good) AS good_lost, count(*) FILTER (gone_at = s.step AND toxic) AS toxic_lost
  FROM r JOIN s USING (filter_order) GROUP BY part, s.filter_order, s.step, s.c
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, c)::BIGINT AS shapley FROM g
"""
