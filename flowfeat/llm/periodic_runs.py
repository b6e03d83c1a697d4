"""Operator 11, periodic run detection: descending-LCP Kruskal over the suffixes of each text's words.

The suffixes of a text that share their first l words are a class. Edges between neighbours in suffix order are taken by falling common prefix; an edge
unites two classes, each an ordered set of positions. Two positions i < i + q that become neighbours in the united class at a common prefix l >= q start a
repetition of smallest period q that ends at i + q + l: were a smaller period there, a position between them would have been in the class before.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._spark import table
from flowfeat.llm._text import release

SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_EXPONENT = 6, 4
WORDS = 200_000  # words handled at once; a longer text is handled alone
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffix_ranks(codes: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Ranks of the suffixes by their first 1, 2, 4, ... words, in word order within each text and apart between texts.

    A rank is the place of the first suffix with the same words among all in order, so classes of every length stand together. Doubling goes on
    for suffixes that share as many words as were compared with another one, until none is left.
    """
    n = len(codes)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    end = off[1:][text]
    order = np.argsort(text * (int(codes.max(initial=0)) + 1) + codes, kind="stable")
    key = (text * (int(codes.max(initial=0)) + 1) + codes)[order]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    levels, k = [rank], 1
    active = np.arange(n)
    while True:
        size = np.bincount(rank, minlength=n)
        active = active[size[rank[active]] > 1]
        if not len(active):
            return levels
        after = np.where(active + k < end[active], rank[np.minimum(active + k, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = rank[active]
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        base = np.repeat(first, np.diff(np.append(first, len(active))))
        head = np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))
        rank = rank.copy()
        rank[active] = group + head - base
        k *= 2
        levels.append(rank)


def common_prefixes(i: np.ndarray, j: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """Words that the suffixes at i and at j of one text share, by the levels of their ranks."""
    n, got = len(end), np.zeros(len(i), np.int64)
    for b in range(len(levels) - 1, -1, -1):
        a, c = i + got, j + got
        ok = (a < end[i]) & (c < end[i])
        a, c = np.minimum(a, n - 1), np.minimum(c, n - 1)
        got += np.where(ok & (levels[b][a] == levels[b][c]), 1 << b, 0)
    return got


def seeds(i: np.ndarray, j: np.ndarray, shared: np.ndarray, exponent: int) -> list[tuple[int, int, int]]:
    """(i, j, l) of positions that become neighbours in a class at l >= (exponent - 1) * (j - i), from edges (i, j, l) of a forest."""
    places, node = np.unique(np.concatenate((i, j)), return_inverse=True)
    parent = list(range(len(places)))
    members: list[list[int] | None] = [[p] for p in places.tolist()]
    a, b = node[: len(i)].tolist(), node[len(i) :].tolist()
    out: list[tuple[int, int, int]] = []
    times, shared_of = exponent - 1, shared.tolist()
    for t in np.argsort(-shared, kind="stable").tolist():
        x, y, l = a[t], b[t], shared_of[t]  # noqa: E741
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        big, small = members[x], members[y]
        if len(big) < len(small):
            x, y, big, small = y, x, small, big
        parent[y] = x
        members[y] = None
        if len(small) * 8 < len(big):
            for p in small:
                insort(big, p)
        else:
            big += small
            big.sort()
        new = set(small) if len(small) > 1 else small
        for p in small:
            k = bisect_left(big, p)
            if k and (q := big[k - 1]) not in new and (p - q) * times <= l:
                out.append((q, p, l))
            if k + 1 < len(big) and (q := big[k + 1]) not in new and (q - p) * times <= l:
                out.append((p, q, l))
    return out


def runs_of(codes: np.ndarray, off: np.ndarray, min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(text, start, length, period) of all runs of texts given as word numbers, by text, start and period: one row each."""
    none = np.zeros((0, 4), np.int64)
    if not len(codes):
        return none
    least = max(exponent - 1, min(max(min_words - q, (exponent - 1) * q) for q in range(1, min_words + 1)))  # words that two suffixes of a run share
    levels = suffix_ranks(codes, off)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    end = off[1:][text]
    coarse = levels[min(least.bit_length() - 1, len(levels) - 1)]
    some = np.flatnonzero(np.bincount(coarse, minlength=len(codes))[coarse] > 1)
    order = some[np.argsort(levels[-1][some], kind="stable")]
    i, j = order[:-1], order[1:]
    same = coarse[i] == coarse[j]
    i, j = i[same], j[same]
    shared = common_prefixes(i, j, levels, end)
    deep = shared >= least
    found = np.array(seeds(i[deep], j[deep], shared[deep], exponent), np.int64).reshape(-1, 3)
    if not len(found):
        return none
    start, period = found[:, 0], found[:, 1] - found[:, 0]
    length = period + found[:, 2]
    first = start == off[:-1][text[start]]
    before = np.maximum(start - 1, 0)
    ok = (length >= np.maximum(min_words, exponent * period)) & (first | (codes[before] != codes[before + period]))
    start, period, length = start[ok], period[ok], length[ok]
    of = text[start]
    out = np.stack([of, start - off[of], length, period], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, exponent: int = MIN_EXPONENT) -> DataFrame:
    """(id, ``runs``, ``collapsed``) of every row: the periodic runs of the words of its whole text, by start and period, and the text without repetitions.

    Words are what stands between ASCII white space, compared by their bytes. A run is a stretch of words with smallest period q of at least ``min_words``
    words and ``exponent`` periods that no neighbouring word extends. ``collapsed`` has the words that no run holds after its first q words, joined by one space.

    No shuffle: each row is worked on where it lies, in groups of about ``WORDS`` words; a longer text takes its task some 200 bytes a word. A null or empty
    text has no words and no run, and comes out empty; repeated rows give repeated rows; null ids and other columns play no part. An empty table gives an empty table.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[list[bytes]] = []
            at = n = 0
            for k, t in enumerate(b.column("text")):
                x = t.as_buffer()
                held.append(x.to_pybytes().split() if x is not None else [])
                n += len(held[-1])
                if n >= WORDS or k == b.num_rows - 1:
                    yield collapse(b.column("id").slice(at, len(held)), held)
                    held, at, n = [], k + 1, 0
        release()

    def collapse(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        known: defaultdict[bytes, int] = defaultdict(count().__next__)
        off = np.concatenate(([0], np.cumsum([len(w) for w in texts]))).astype(np.int64)
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.int64, int(off[-1]))
        runs = runs_of(codes, off, min_words, exponent)
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, off[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
        np.add.at(change, off[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
        keep = np.cumsum(change[:-1]) == 0
        cuts = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
        out = [b" ".join([w for w, k in zip(t, keep[off[i] : off[i + 1]].tolist()) if k] if cuts[i] < cuts[i + 1] else t) for i, t in enumerate(texts)]
        parts = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"])
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts), pa.array(out, pa.binary())], names=["id", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(find, f"id {kind}, runs {RUNS}, collapsed binary").select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def folded(id_col: Column, text: Column) -> Column:
    """Texts of every tenth id by CRC with their words made periodic from a place on; others as they are."""
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)

    def fold(words: Column) -> Column:  # as a lambda's variable the words are split once, not for each word
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        again = F.transform(F.sequence(F.lit(0).cast("long"), n - a - 1), lambda k: F.get(words, (a + F.pmod(k, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), again), " ")).otherwise("")

    split = F.filter(F.split(text, SPACE), lambda w: w != "")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), F.get(F.transform(F.array(split), fold), 0)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", folded(F.col("doc_id"), F.col("text")).alias("text"))
    # the greatest length comes first, then the smallest start, then the smallest period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    found = periodic_runs(docs).select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
