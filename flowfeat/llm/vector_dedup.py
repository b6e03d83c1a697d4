"""Operator 4, embedding near-dedup: an inverted multi-index over vector halves, visited cell by cell, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowfeat.llm._graph import by_cell, cell_starts, into_cells, roots
from flowfeat.llm._spark import cut, drop, table
from flowfeat.operators.graph import components

COSINE, SAMPLE, RECALL, BLOCK = 0.93, 20_000, 0.999, 1_500
CODES_PER_ROOT = 1.6  # codes of a half for each fourth root of the number of vectors: cells grow with its square root
#: Made links and rows of the sample whose real links set the traversal's depth, its margin, and steps of the squared reach in counts.
PLANTED, PROBE, MARGIN, BINS = 20_000, 1_000, 1.25, 4_096


def codebook(x: np.ndarray, codes: int, rounds: int = 12) -> np.ndarray:
    """Centres of the rows of x by Lloyd's rounds, started at rows far from each other."""
    rng = np.random.default_rng(7)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    centres = x[rng.integers(len(x))][None]
    far = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < min(codes, len(x)) and far.max() > 1e-12:
        centres = np.concatenate((centres, x[far.argmax()][None]))
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(1))
    for _ in range(rounds):
        at = nearest(x, centres).argmin(1)
        for k in range(len(centres)):
            if (at == k).any():
                centres[k] = x[at == k].mean(0)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None], 0)


def bounds(u: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Per half the squared distance that a vector of each code must have at least from each row.

    A vector whose nearest centre is c lies beyond the plane between c and the row's own nearest centre, so half the
    difference of squared distances over the distance of the centres bounds its distance from below.
    """
    out = []
    for half, book in zip(halves(u), books):
        d = nearest(half, book)
        own = d.argmin(1)
        gap = np.sqrt(nearest(book, book))
        out.append(np.maximum((d - d[np.arange(len(d)), own][:, None]) / np.maximum(2 * gap[own], 1e-12), 0) ** 2)
    return out


def link_bounds(u: np.ndarray, labels: np.ndarray, ids: np.ndarray, probe: tuple[np.ndarray, np.ndarray, np.ndarray], books: tuple[np.ndarray, np.ndarray], cosine: float) -> np.ndarray:
    """Counts, by step of the squared reach, of the bounds at which the probe's unit vectors (vectors, labels, ids) would visit the cells of rows u that they link with; no row links with itself."""
    p, p_labels, p_ids = probe
    first, second = bounds(p, books)
    own = homes(u, books)
    total = np.zeros(BINS, np.int64)
    for i in range(0, len(u), 512):
        a, b = np.nonzero((p @ u[i : i + 512].T >= cosine) & (p_labels[:, None] == labels[None, i : i + 512]) & (p_ids[:, None] != ids[None, i : i + 512]))
        far = first[a, own[0][i + b]] + second[a, own[1][i + b]]
        total += np.bincount(np.minimum(far / (2 - 2 * cosine) * BINS, BINS - 1).astype(np.int64), minlength=BINS)
    return total


def planted_bounds(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cosine: float) -> np.ndarray:
    """The bounds at which sample vectors would visit the cells of partners made for them, just at the threshold and in any direction."""
    rng = np.random.default_rng(13)
    out = []
    for i in range(0, PLANTED, 2_000):
        u = x[rng.integers(len(x), size=2_000)]
        side = rng.standard_normal(u.shape)
        side -= (side * u).sum(1)[:, None] * u
        norm = np.sqrt((side * side).sum(1))[:, None]
        v = cosine * u + np.sqrt(1 - cosine**2) * np.divide(side, norm, out=np.zeros_like(side), where=norm > 1e-9)
        first, second = bounds(u, books)
        a, b = homes(v, books)
        at = np.arange(len(u))
        out.append(first[at, a] + second[at, b])
    return np.concatenate(out)


def depth(planted: np.ndarray, counts: np.ndarray, cosine: float, recall: float) -> float:
    """How far the traversal goes: the bound under which the cells of ``recall`` of the made links and of the real ones lie, and a quarter more.

    It is never more than the squared reach, which finds every pair, as the bounds are exact; a recall of 1 asks for that.
    """
    reach, n = 2 - 2 * cosine, int(counts.sum())
    if recall >= 1:
        return reach + 1e-9
    real = (int(np.searchsorted(np.cumsum(counts), recall * n)) + 1) / BINS * reach if n else 0.0
    made = float(np.quantile(planted, recall)) if len(planted) else reach
    return min(reach, MARGIN * max(made, real)) + 1e-9


def halves(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return u[:, : u.shape[1] // 2], u[:, u.shape[1] // 2 :]


def homes(u: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the cell in which each vector lives."""
    a, b = (nearest(h, k).argmin(1) for h, k in zip(halves(u), books))
    return a, b


def traversal(u: np.ndarray, books: tuple[np.ndarray, np.ndarray], limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells that each unit vector visits: (row, first code, second code), for each row the nearest first, up to the limit.

    Both halves' codes are put in order of their bounds, and pairs are taken while the sum of their bounds is within the limit.
    """
    first, second = bounds(u, books)
    rows, a, b, far = [], [], [], []
    order1, order2 = np.argsort(first, axis=1), np.argsort(second, axis=1)
    s1, s2 = np.take_along_axis(first, order1, 1), np.take_along_axis(second, order2, 1)
    for i in range(s1.shape[1]):
        r, j = np.nonzero(s1[:, i][:, None] + s2 <= limit)
        if not len(r):
            break
        rows.append(r)
        a.append(order1[r, i])
        b.append(order2[r, j])
        far.append(s1[r, i] + s2[r, j])
    r, a, b, far = (np.concatenate(x) for x in (rows, a, b, far))
    order = np.lexsort((far, r))
    return r[order], a[order], b[order]


def _units(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # squares of very large or small components stay in range
    return v / np.sqrt((v * v).sum(1))[:, None]


def unit_rows(v: pa.Array, size: int | None = None) -> np.ndarray:
    """Unit vectors of a list column. With a size, their first components only, or zeros behind shorter ones."""
    n = v.value_lengths().to_numpy()
    flat, stop = v.flatten().to_numpy().astype(np.float64), np.cumsum(n)
    if size is None or (n == size).all():
        return _units(flat.reshape(len(n), -1)) if len(n) else np.zeros((0, size or 0))
    out = np.zeros((len(n), size))
    for k in np.unique(n).tolist():
        at = np.flatnonzero(n == k)
        out[at, : min(k, size)] = _units(flat[(stop[at] - k)[:, None] + np.arange(k)])[:, :size]
    return out


def verify(rows: pa.Table, cosine: float) -> pa.Table:
    """Links in whole cells, told at both ends: per vector with links (id, links counted with copies, least id it reaches here).

    A pair of one cell is seen from both sides there; one of two cells only where the vector of the lower cell visits the other.
    """
    ids, mult, home, side, near, far = (rows.column(c).to_numpy() for c in ("id", "mult", "home", "side", "near", "far"))
    vectors = rows.column("v").combine_chunks()
    starts = np.append(cell_starts(rows, CELL), len(ids))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
        live = i + np.flatnonzero(home[i:j])
        if j - i < 2 or not len(live):
            continue
        u = unit_rows(vectors.slice(i, j - i))
        hit = u @ u[live - i].T >= cosine
        hit &= ids[i:j][:, None] != ids[live][None]
        if near[i] != far[i]:
            hit &= side[i:j][:, None] != side[live][None]
        a, b = np.nonzero(hit)
        if len(a):
            n = hit @ mult[live]
            guest = np.flatnonzero(~home[i:j])
            n[live - i] += mult[i + guest] @ hit[guest]
            some = np.flatnonzero(n)
            out.append((ids[i + some], n[some], ids[i + roots(j - i, a, live[b] - i, ids[i:j])[some]]))
    cols = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({"id": cols[0], "n": cols[1], "root": cols[2]})


CELL = ["label", "size", "a", "b", "near", "far"]


def vector_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, codes: int | None = None, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Per id: ``n_links``, ``component_id`` and ``kept``; vectors of equal, non-null labels and equal length link at ``cosine`` or more.

    Cosines are computed in double precision. Vectors that are null, empty, zero, or hold
    null or non-finite components link with nothing, and so do those with a null label. Equal vectors of a label are compared
    once. Labels are integers, or anything else that Spark can hash to 64 bits. Ids are integers; rows with a null id are left out, and of rows
    that repeat an id the vector of least hash counts.

    The index: each half of the unit vectors has its own codebook, fitted on at most ``sample`` vectors of least hash,
    and a cell is a pair of codes under a label and length; for vectors of other lengths than most, the codes are those of as many components.
    Each vector lives in one cell and visits the nearest of those that follow it, up to the depth at which ``recall`` of links at the
    threshold in any direction, and of the links of ``PROBE`` sampled rows with all rows, are found; ``recall=1`` visits all that can hold a link. Every
    visited vector is compared exactly, and a pair is met once or not at all, so both its ends count it. Crowded cells are split into pairs of blocks.
    """
    element, label_type = vectors.schema[vector_col].dataType.elementType, vectors.schema[label_col].dataType
    v = F.col(vector_col) if isinstance(element, (T.FloatType, T.DoubleType)) else F.col(vector_col).cast("array<double>")
    label = F.col(label_col).cast("long") if isinstance(label_type, T.IntegralType) else F.xxhash64(label_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.col(vector_col).isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: F.abs(x) > 0) & F.col(label_col).isNotNull()
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(whole, label).alias("label"), F.when(whole, v).alias("v"))
    rows = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("label", "v").alias("h"), "label", "v")).alias("x"))
    rows = cut(rows.select("id", "x.label", "x.v", "x.h"), "vectors")
    live = rows.filter("v IS NOT NULL").withColumn("size", F.size("v"))
    # equal vectors of a label become one row: by value, not by hash alone
    groups = cut(live.groupBy("label", "size", "h", "v").agg(F.min("id").alias("id"), F.count("*").alias("mult")), "distinct-vectors")
    sizes = groups.groupBy("size").agg(F.count("*").alias("c"))
    n = sizes.agg(F.sum("c")).first()[0] or 0
    top = sizes.orderBy(F.desc("c"), "size").first()
    size = top["size"] if top else 1
    share = min(1.0, 1.2 * sample / max(top["c"] if top else 1, 1) + 1e-9)
    most = int(-(1 << 63) + share * ((1 << 64) - 1025))
    drawn = groups.filter((F.col("h") <= F.lit(most)) & (F.col("size") == size)).select("h", "label", "v", "id").toArrow().sort_by([("h", "ascending"), ("id", "ascending")]).slice(0, sample)
    x = unit_rows(drawn.column("v").combine_chunks(), size)
    codes = codes or max(2, int(np.ceil(CODES_PER_ROOT * n**0.25)))
    books = tuple(codebook(h, codes) for h in halves(x))
    probe = (x[:PROBE], drawn.column("label").to_numpy()[:PROBE], drawn.column("id").to_numpy()[:PROBE])

    def links_of_probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for b in batches:
            if b.num_rows:
                total += link_bounds(unit_rows(b.column("v"), size), b.column("label").to_numpy(), b.column("id").to_numpy(), held.value, books, cosine)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bin", "n"])

    counts = np.zeros(BINS, np.int64)
    if len(x) and recall < 1:
        held = vectors.sparkSession.sparkContext.broadcast(probe)
        for r in groups.filter(F.col("size") == size).select("id", "label", "v").mapInArrow(links_of_probe, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
            counts[r["bin"]] = r["n"]
        held.destroy()
    limit = depth(planted_bounds(x, books, cosine) if len(x) and recall < 1 else np.zeros(0), counts, cosine, recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2_000):
                b = batch.slice(i, 2_000)
                u = unit_rows(b.column("v"), size)
                own = homes(u, books)
                r, first, second = traversal(u, books, limit)
                cell, here = first * codes + second, (own[0] * codes + own[1])[r]
                ahead = cell >= here  # of two cells only the lower one's vectors visit the other
                r, first, second, home = r[ahead], first[ahead], second[ahead], (cell == here)[ahead]
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(r)) for c in ("id", "label", "size", "mult")] + [pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(home)], names=["id", "label", "size", "mult", "a", "b", "home"])

    visits = cut(groups.select("id", "label", "size", "mult", "v").mapInArrow(visit, "id long, label long, size int, mult long, a int, b int, home boolean"), "visits")
    place = CELL[:4]
    crowd = visits.groupBy(place).agg(F.count("*").alias("w"), F.sum(F.col("home").cast("int")).alias("homes")).filter("w > 1 AND homes > 0").select(*place, "w")
    crowd = cut(crowd, "crowd")
    cells = into_cells(visits.join(crowd, place), place, "w", block)
    full = cells.join(groups.select("id", "v"), "id")
    links = cut(by_cell(full, CELL, lambda t: verify(t, cosine), "id long, n long, root long"), "links")
    drop(visits)
    drop(crowd)
    own = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = groups.select("label", "h", "v", F.col("id").alias("rep"), "mult").join(links.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n")), "rep", "left").join(own.select(F.col("node").alias("rep"), "component"), "rep", "left")
    per = per.select("label", "h", "v", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(per, ["label", "h", "v"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup(table(spark, sf_dir, "embeddings"))
