"""Operator 1, n-gram Jaccard join: a MinHash LSH forest for candidates, then exact verification of word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._graph import by_cell, cell_starts, into_cells, roots
from flowfeat.llm._spark import cut, drop, table
from flowfeat.operators.graph import components
from flowfeat.llm._text import mix, shingles, slices

SIZE, SIMILARITY, TREES, LONGEST, SHORTEST, RECALL, QUERIES, BLOCK, LEAST = 5, 0.8, 16, 8, 3, 0.9995, 500, 200_000, 100
# BLOCK: shingles of a block; a text counts as LEAST at least, so a cell has 2 * BLOCK / LEAST rows at most.


def prefix_length(similarity: float, trees: int, recall: float, met: np.ndarray) -> int:
    """Matched prefixes start at full length and are shortened until the target recall is met.

    Two texts share a prefix of k MinHash values in one tree with probability similarity ** k, and in one tree of several
    with 1 - (1 - similarity ** k) ** trees; that must reach the target for pairs at the threshold, and so must the share that is
    measured: ``met[k]`` pairs of a set of queries with all rows share k values at most, in the tree where they share most.
    """
    for k in range(LONGEST, SHORTEST, -1):
        if 1 - (1 - similarity**k) ** trees >= recall and met[k:].sum() >= recall * met.sum():
            return k
    return SHORTEST


def forest(hashes: np.ndarray, off: np.ndarray, trees: int) -> np.ndarray:
    """(texts, trees, 2) numbers: the ``LONGEST`` MinHash values of each tree, 16 bits each from the highest on, so that texts in one node of the tree's trie stand together when sorted."""
    rng = np.random.default_rng(20_240_101)
    factors = rng.integers(1, 1 << 63, (trees, LONGEST, 2), dtype=np.uint64)
    some = np.flatnonzero(np.diff(off))
    out = np.zeros((len(off) - 1, trees, 2), np.uint64)
    for t in range(trees) if len(some) else ():
        for d in range(LONGEST):
            a, b = factors[t, d]
            low = np.minimum.reduceat((hashes * (a | np.uint64(1)) + b) >> np.uint64(32), off[some])
            out[some, t, d // 4] |= (mix(low) >> np.uint64(48)) << np.uint64(48 - 16 * (d % 4))
    return out.view(np.int64)


def node(hi: Column, lo: Column, depth: int) -> Column:
    """The number of the trie's node at a depth: the bits of its first values."""
    if depth <= 4:
        return hi.bitwiseAND(F.lit(-1 << 16 * (4 - depth)))
    return F.xxhash64(hi, lo.bitwiseAND(F.lit(-1 << 16 * (8 - depth))))


def shared_values(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pair of signatures (pairs, trees, 2) the most first values that one tree shares, and the share of all values that are equal."""
    same = (a[..., None] >> np.arange(48, -1, -16)) & 0xFFFF == (b[..., None] >> np.arange(48, -1, -16)) & 0xFFFF
    same = same.reshape(len(a), a.shape[1], -1)
    return np.cumprod(same, axis=2).sum(2).max(1, initial=0), same.mean((1, 2))


def measured(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, similarity: float) -> np.ndarray:
    """Counts of pairs of queries and rows whose values agree as those of a link do, by the most first values that one tree shares; ``SHORTEST`` at least."""
    pairs = []
    for t in range(rows.shape[1]):
        head = lambda x: x[:, t, 0].view(np.uint64) >> np.uint64(64 - 16 * SHORTEST)  # noqa: E731, B023
        q = head(np.ascontiguousarray(queries))
        order = np.argsort(q, kind="stable")
        mine = head(np.ascontiguousarray(rows))
        lo, hi = np.searchsorted(q[order], mine, "left"), np.searchsorted(q[order], mine, "right")
        at = np.repeat(np.arange(len(mine)), hi - lo)
        pairs.append(at * len(q) + order[np.repeat(lo - np.cumsum(hi - lo) + hi - lo, hi - lo) + np.arange(len(at))])
    pair = np.unique(np.concatenate(pairs))
    total = np.zeros(LONGEST + 1, np.int64)
    for i in range(0, len(pair), 20_000):
        a, b = pair[i : i + 20_000] // len(queries), pair[i : i + 20_000] % len(queries)
        depth, equal = shared_values(rows[a], queries[b])
        total += np.bincount(depth[(equal >= similarity) & (ids[a] != query_ids[b])], minlength=LONGEST + 1)
    return total


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, trees: int) -> DataFrame:
    """(id, cls, n, sig): ``cls`` is 128 bits of the shingle set, so copies share it; it is null for a text without words. sig: ``forest``, two numbers a tree."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names = b.column("text").to_pylist(), b.column("id")
            for i, j in slices(texts):
                h, off = shingles(texts[i:j], size)
                n = np.diff(off)
                total = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(seed)), dtype=np.uint64))) for seed in (3, 5)]
                cls = np.stack([x[off[1:]] - x[off[:-1]] for x in total], axis=1).astype("<u8").tobytes()
                sig = forest(h, off, trees)
                yield pa.RecordBatch.from_arrays(
                    [names.slice(i, j - i), pa.array([cls[16 * k : 16 * k + 16] if m else None for k, m in enumerate(n)], pa.binary()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * 2 * trees, pa.int32()), pa.array(sig.ravel()))],
                    names=["id", "cls", "n", "sig"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL").mapInArrow(sign, "id long, cls binary, n long, sig array<long>")


def depth_met(classes: DataFrame, trees: int, similarity: float, recall: float, queries: int = QUERIES) -> int:
    """The prefix length for these rows: recall is measured for at most ``queries`` classes, those of least hash, against all classes, by signatures alone."""
    drawn = classes.orderBy(F.xxhash64("id"), "id").select("id", "sig").limit(queries).toArrow()
    if not drawn.num_rows:
        return prefix_length(similarity, trees, recall, np.zeros(LONGEST + 1, np.int64))
    unpack = lambda c: c.flatten().to_numpy().reshape(-1, trees, 2)
    held = classes.sparkSession.sparkContext.broadcast((unpack(drawn.column("sig").combine_chunks()), drawn.column("id").to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LONGEST + 1, np.int64)
        for b in batches:
            if b.num_rows:
                total += measured(unpack(b.column("sig")), b.column("id").to_numpy(), *held.value, similarity)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LONGEST + 1), pa.int32()), pa.array(total)], names=["depth", "n"])

    met = np.zeros(LONGEST + 1, np.int64)
    for r in classes.select("id", "sig").mapInArrow(count, "depth int, n long").groupBy("depth").agg(F.sum("n").alias("n")).collect():
        met[r["depth"]] = r["n"]
    held.destroy()
    return prefix_length(similarity, trees, recall, met)


def verify(rows: pa.Table, size: int, similarity: float) -> pa.Table:
    """Links inside whole cells: per row with links (id, links counted with copies, least id reached here).

    A pair counts in the first tree in which it meets, so over all trees it counts once. Shared shingles of all rows of a
    cell come from products of 0/1 matrices over the shingles that two rows or more hold.
    """
    ids, mult, tree = (rows.column(c).to_numpy() for c in ("id", "mult", "tree"))
    side, near, far = (rows.column(c).to_numpy() for c in ("side", "near", "far"))
    keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    texts = rows.column("text").to_pylist()
    starts = np.append(cell_starts(rows, CELL), len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if j - i < 2:
            continue
        h, off = shingles(texts[i:j], size)
        a, b = _links(h, off, similarity)
        if not len(a):
            continue
        ok = ids[i + a] != ids[i + b]
        if near[i] != far[i]:
            ok &= side[i + a] != side[i + b]
        a, b = a[ok], b[ok]
        for t in range(int(tree[i])):  # pairs that meet in an earlier tree count there
            ok = keys[i + a, t] != keys[i + b, t]
            a, b = a[ok], b[ok]
        n = np.zeros(j - i, np.int64)
        np.add.at(n, a, mult[i + b])
        np.add.at(n, b, mult[i + a])
        some = np.flatnonzero(n)
        root = roots(j - i, a, b, ids[i:j])
        out.append((ids[i + some], n[some], ids[i + root[some]]))
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"id": cols[0], "n": cols[1], "root": cols[2]})


def _links(h: np.ndarray, off: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs a < b whose shingle sets have at least this Jaccard similarity."""
    m = len(off) - 1
    size = np.diff(off)
    row = np.repeat(np.arange(m), size)
    words, col, held = np.unique(h, return_inverse=True, return_counts=True)
    keep = held[col] > 1
    row, col = row[keep], (np.cumsum(held > 1) - 1)[col[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    shared = np.zeros((m, m), np.float32)
    width = max(256, min(8192, (1 << 22) // m))
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (c, c + width))
        block = np.zeros((m, width), np.float32)
        block[row[i:j], col[i:j] - c] = 1
        shared += block @ block.T
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for r in range(0, m, 256):  # a few rows at a time: memory stays near the one matrix
        both = shared[r : r + 256].astype(np.float64)
        # |A and B| >= similarity * |A or B|, in exact arithmetic up to one rounding
        hit = both >= similarity * (size[r : r + 256, None] + size[None] - both) - 1e-9
        hit &= np.arange(m)[None] > np.arange(r, r + len(both))[:, None]
        a, b = np.nonzero(hit)
        found.append((a + r, b))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


CELL = ["tree", "key", "near", "far"]


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per id of docs: ``class_id`` (least id that links reach) and ``n_links`` (other documents linked directly).

    A link joins documents whose sets of ``size``-word shingles have a Jaccard similarity of at least ``similarity``. Words
    are runs of letters and digits in lower case; a text of fewer words is one shingle; a null text or one without
    words links with nothing. Ids are integers; rows with a null id are left out, rows that repeat an id and text
    count once, and texts that share an id count as linked. Copies are compared once: documents with the same
    shingles form a class that stands for all of them.

    Candidates share a prefix node in one tree of the forest. Prefixes are shortened from ``LONGEST`` values until the target recall is met,
    by formula for pairs at the threshold and as measured by ``depth_met`` for these rows. Nodes whose members all meet in an earlier tree are
    left out. A node with much text is split into cells of its pairs of blocks, so neither a task nor the number of
    rows follows the square of a group; cells return a count and a root per row, never pairs.
    """
    signed = cut(signatures(docs, id_col, text_col, size, trees).dropDuplicates(["id", "cls"]), "signed")
    classes = cut(signed.filter("n > 0").groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    depth = depth_met(classes, trees, similarity, recall)
    classes = classes.withColumn("keys", F.array(*[node(F.col("sig")[2 * t], F.col("sig")[2 * t + 1], depth) for t in range(trees)])).drop("sig")
    placed = classes.select("id", "n", F.posexplode("keys").alias("tree", "key"))
    shared = cut(placed.groupBy("tree", "key").agg(F.count("*").alias("c"), F.sum(F.greatest("n", F.lit(LEAST))).alias("w")).filter("c > 1").select("tree", "key", "w"), "nodes")
    places = cut(placed.join(shared, ["tree", "key"]).select("tree", "key", "w", "id"), "places")
    drop(shared)
    met = cut(places.join(classes.select("id", "mult", "keys"), "id"), "met")  # all keys of a row only once it meets another
    drop(places)
    same = [F.when((F.lit(i) < F.col("tree")) & (F.min(F.col("keys")[i]) == F.max(F.col("keys")[i])), True) for i in range(trees)]
    fresh = met.groupBy("tree", "key").agg(F.coalesce(*same, F.lit(False)).alias("again")).filter("NOT again").select("tree", "key")
    cells = cut(into_cells(met.join(fresh, ["tree", "key"]), ["tree", "key"], "w", block), "cells")
    drop(met)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    full = cells.join(texts, "id")
    links = cut(by_cell(full, CELL, lambda rows: verify(rows, size, similarity), "id long, n long, root long"), "links")
    drop(cells)
    own = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = classes.select("cls", F.col("id").alias("rep"), "mult").join(links.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n")), "rep", "left").join(own.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linked = linked.select("cls", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("class_id"))
    every = signed.select("id", "cls").join(linked, "cls", "left")
    return every.groupBy(F.col("id").alias(id_col)).agg(F.min(F.coalesce("class_id", "id")).alias("class_id"), F.max(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"))
