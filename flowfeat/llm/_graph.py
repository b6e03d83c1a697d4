"""Cells of bounded size and connected components, for operators that link rows of one table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowfeat.llm._text import release



def into_cells(rows: DataFrame, bucket: list[str], weight: str, block: int) -> DataFrame:
    """rows, with ``blocks`` of their bucket known from ``weight`` (the bucket's total), dealt into cells of at most two blocks.

    A bucket of several blocks becomes the cells of its pairs of blocks: a row of block s goes to the cells (s, j), so any two
    rows of a bucket meet in one cell exactly if pairs of one block are taken in its own cell alone. Adds ``side``
    (the row's block), ``near`` and ``far`` (the cell's blocks).
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col(weight) / F.lit(block)).cast("int"))
    salted = rows.withColumn("__blocks", blocks).withColumn("side", F.pmod(F.xxhash64("id", F.lit(11)), F.col("__blocks")).cast("int"))
    dealt = salted.withColumn("__j", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return dealt.withColumns({"near": F.least("side", "__j"), "far": F.greatest("side", "__j")}).drop("__j", "__blocks")


def by_cell(rows: DataFrame, cell: list[str], work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work applied to tables of whole cells: rows are shuffled and sorted by cell, and the last cell of a batch waits for the next one."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            here = pa.Table.from_batches(waiting).combine_chunks()
            starts = cell_starts(here, cell)
            if starts[-1] > 0:
                yield from work(here.slice(0, int(starts[-1]))).to_batches()
                waiting = here.slice(int(starts[-1])).combine_chunks().to_batches()
        if waiting:
            yield from work(pa.Table.from_batches(waiting)).to_batches()
        release()

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(task, schema)


def cell_starts(rows: pa.Table, cell: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in cell:
        v = rows.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def roots(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n rows the row of least rank that links a[i] - b[i] reach."""
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    label, a, b = np.arange(n), place[a], place[b]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return order[label[place]]
        label = new
