"""Operator 8, best-fit packing with lower bounds that certify the number of sequences."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._spark import cut, drop, table
from flowfeat.llm._text import flat, runs, slices, span_hashes
from flowfeat.llm.token_counts import kinds, vocabulary

LENGTH, END, GROUP, SHARES, KNOWN = 2048, 0, 4_000, 12, 500_000

# token ids


class Encoder:
    """Token ids of many texts: each distinct word of a batch is merged once.

    A byte-level BPE tokenizer never merges across the words of its splitter, so the ids of a text are those of its
    words in turn. Words are found for the whole batch with numpy and told apart by 64 bits of hash and their length; up to
    ``KNOWN`` words stay known between batches. Words go through tiktoken, which merges by the same ranks as the
    tokenizers library but much quicker; texts with a zero character or an added token's
    string go to that library whole.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        ids, merges, self.added = vocabulary(path)
        order = [ids[a + b] for a, b in sorted(merges, key=merges.get)]
        if order != sorted(order):
            raise ValueError("ids of merged tokens must rise in the order of merges")
        self.merger = tiktoken.Encoding("words", pat_str=r"[^\x00]+|\x00", mergeable_ranks={k: v for k, v in ids.items() if k.decode("utf-8", "replace") not in self.added}, special_tokens={})
        self.stop = ids[b"\0"]
        self.forget()

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def forget(self) -> None:
        self.hashes, self.starts, self.sizes, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def split(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the splitter's words: runs of one kind, a blank before a word joining it, white space giving up its last character to what follows, and contractions."""
        n = len(points)
        kind = kinds()[points]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        new = edge[:-1].copy()
        new[1:] |= kind[1:] != kind[:-1]
        space = kind == 2
        # the last character of white space before another word stands alone, or joins the word if it is a blank
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
        new[last] = True
        new[last[points[last] == 32] + 1] = False
        # contractions: an apostrophe that begins a word, with the letters after it
        quote = np.flatnonzero((points == 39) & new[:n])
        if len(quote):
            at = lambda k: np.where(quote + k < n, points[np.minimum(quote + k, n - 1)], 0)
            inside = lambda k: (quote + k < n) & ~edge[np.minimum(quote + k, n)]
            one = np.isin(at(1), [ord(c) for c in "stmd"]) & inside(1)
            two = (((at(1) == 114) | (at(1) == 118)) & (at(2) == 101) | (at(1) == 108) & (at(2) == 108)) & inside(1) & inside(2)
            for size, here in ((2, quote[one]), (3, quote[two & ~one])):
                new[here + 1] = False
                after = here[here + size < n]
                new[after + size] = True
        starts = np.flatnonzero(new)
        return starts, np.append(starts[1:], n)

    def learn(self, words: list[str]) -> list[np.ndarray]:
        """Ids of distinct words, which go through in one text with zero characters between."""
        out: list[np.ndarray] = []
        for k in range(0, len(words), 50_000):
            ids = np.array(self.merger.encode_ordinary("\0".join(words[k : k + 50_000])), np.int32)
            stops = np.flatnonzero(ids == self.stop)
            out += [x[1:] if n else x for n, x in enumerate(np.split(ids, stops))]
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts."""
        texts = [t or "" for t in texts]
        odd = {i for i, t in enumerate(texts) if "\0" in t or any(a in t for a in self.added)}
        points, off = flat([("" if i in odd else t) for i, t in enumerate(texts)])
        whole = "".join(t for i, t in enumerate(texts) if i not in odd)
        if len(points):
            s, e = self.split(points, off)
            keys, first, back = np.unique(span_hashes(points, s, e), return_index=True, return_inverse=True)
            at = np.searchsorted(self.hashes, keys)
            known = np.append(self.hashes, 0)[at] == keys if len(self.hashes) else np.zeros(len(keys), bool)
            new = np.flatnonzero(~known)
            got = self.learn([whole[a:b] for a, b in zip(s[first[new]].tolist(), e[first[new]].tolist())])
            start, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            start[known], size[known] = self.starts[at[known]], self.sizes[at[known]]
            size[new] = [len(x) for x in got]
            start[new] = len(self.pool) + np.concatenate(([0], np.cumsum(size[new])))[:-1]
            self.pool = np.concatenate((self.pool, *got))
            if len(self.hashes) + len(new) > KNOWN:
                pool = self.pool
                self.forget()
            else:
                pool = self.pool
                order = np.argsort(both := np.concatenate((self.hashes, keys[new])))
                self.hashes, self.starts, self.sizes = both[order], np.concatenate((self.starts, start[new]))[order], np.concatenate((self.sizes, size[new]))[order]
            size, start = size[back], start[back]
            total = np.concatenate(([0], np.cumsum(size)))
            ids = pool[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
            cuts = total[np.searchsorted(s, off)]
        else:
            ids, cuts = np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        if odd:
            parts = [np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32) if i in odd else ids[cuts[i] : cuts[i + 1]] for i in range(len(texts))]
            ids, cuts = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, cuts


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``length`` ids: id, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``input_ids``.

    A document is its ids and then ``end``, so a null or empty text is one piece of one id. Longer ones are cut into
    full pieces after a first one that may be shorter. Repeated rows give repeated pieces. No shuffle.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        for b in batches:
            texts, names = b.column("text").to_pylist(), b.column("id")
            for i, j in slices(texts):
                ids, off = tool.encode(texts[i:j])
                sizes = np.diff(off) + 1
                full = np.empty(len(ids) + len(sizes), "<u4")
                stops = off[1:] + np.arange(len(sizes))
                keep = np.ones(len(full), bool)
                keep[stops] = False
                full[keep], full[stops] = ids, end
                n = -(-sizes // length)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                short = sizes - (n - 1) * length
                start = np.where(piece == 0, 0, short[doc] + (piece - 1) * length)
                size = np.where(piece == 0, short[doc], length)
                base = (np.cumsum(sizes) - sizes)[doc] + start
                data = memoryview(full.view(np.uint8))
                crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(base.tolist(), size.tolist())]
                cols = [names.slice(i, j - i).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "piece", "start", "length", "ids_crc32", *["input_ids"] * keep_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(cut_up, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", input_ids array<int>" * keep_ids)


# packing


def lower_bound(sizes: np.ndarray, room: int, times: np.ndarray | None = None) -> int:
    """The largest of the bounds that dual feasible functions give for the number of bins of sizes, each there ``times`` times.

    For each threshold k <= room / 2: sizes over room - k count as a whole bin, those under k as nothing, others as they are.
    With k = 0 this is the total over the room; sums over sizes that are sorted make all k quick. A second family, for k from 1 to
    ``SHARES``, rounds sizes down to the k + 1 shares of the room that they pass, of which a bin has k: it tells how many sizes over
    a third, a fourth and so on meet in a bin.
    """
    if not len(sizes):
        return 0
    order = np.argsort(sizes, kind="stable")
    s, n = sizes[order], np.ones(len(sizes), np.int64) if times is None else times[order]
    number, total = (np.concatenate(([0], np.cumsum(x))) for x in (n, s * n))
    k = np.unique(np.concatenate(([0], s[s <= room // 2])))
    low, high = np.searchsorted(s, k, "left"), np.searchsorted(s, room - k, "right")
    best = int(np.max((number[-1] - number[high]) + -(-(total[high] - total[np.minimum(low, high)]) // room)))
    for k in range(1, SHARES + 1):
        value = np.where((k + 1) * s % room == 0, k * s, (k + 1) * s // room * room)
        best = max(best, -(-int((value * n).sum()) // (k * room)))
    return best


def best_fit(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each size. Bins of the same free room are interchangeable, so a bit set of rooms finds the fullest that fits."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[list[int]] = [[] for _ in range(room + 1)]
    some, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fit = some >> n
        if fit:
            left = n + (fit & -fit).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some &= ~(1 << left)
        else:
            b, left, count = count, room, count + 1
        bins[i], offsets[i] = b, room - left
        if left > n:
            free[left - n].append(b)
            some |= 1 << (left - n)
    return bins, offsets


def _packer(r: int, names: list[str], length: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one group in round r; ``__open`` marks items of bins with room in a group that its bound doesn't certify."""

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["length"].to_numpy()
        bins, at = best_fit(sizes, length)
        gap = int(bins.max()) + 1 > lower_bound(sizes, length)
        out = rows[names].copy()
        out["sequence_id"] = bins + (r << 56) + (rows["__part"].to_numpy().astype(np.int64) << 24)
        out["offset"] = at
        out["__open"] = gap & (np.bincount(bins, sizes)[bins] < length)
        return out

    return packed


def pack(items: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """items (``length`` from 1 to the room, any other columns) with ``sequence_id`` and ``offset``, which replace own columns of these names.

    Items are dealt by hash into partitions of about ``group`` and each is packed best-fit decreasing. Dual feasible
    functions bound each partition's number of bins from below: where the bound is met, the packing is certified and
    done. Of a partition with a gap the bins that are full stay; the items of the others are dealt anew, together
    with those of other partitions with gaps, into fewer partitions, until none is left, one partition holds all, or a round
    needs no fewer bins than the one before, which then stands. ``certificate`` tells what remains of the gap.

    Every item is numbered where it is written first, and dealt by that number: repeated rows, and rows with null ids, are items of their own
    and spread evenly, so no group is larger than a few times ``group``. Each round is written to the shared folder. An empty table gives an
    empty table.
    """
    fields = [f for f in items.schema if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in fields]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    todo = cut(items.select(*[F.col(f"`{c}`") for c in names], F.monotonically_increasing_id().alias("__row")), "items")
    n, bins, before, done, r = todo.count(), None, None, [], 0
    while True:
        parts = max(1, -(-n // group))
        dealt = todo.withColumn("__part", F.pmod(F.xxhash64("__row", F.lit(r)), F.lit(parts)).cast("int"))
        got = cut(dealt.groupBy("__part").applyInPandas(_packer(r, [*names, "__row"], length), f"{kind}, __row long, sequence_id long, offset long, __open boolean"), f"packed-{r}")
        if not r:
            drop(todo)
        first = (F.col("offset") == 0).cast("long")
        now = got.agg(F.sum(first).alias("bins"), F.sum(F.col("__open").cast("long")).alias("n"), F.sum(F.when(F.col("__open"), first)).alias("open_bins")).first()
        if before is not None and now["bins"] >= bins:
            done.append(before)  # nothing gained
            break
        done.append(got.filter("NOT __open"))
        if not now["n"]:
            break
        if parts == 1:
            done.append(got.filter("__open"))
            break
        before, bins, n, r = got.filter("__open"), now["open_bins"], now["n"], r + 1
        todo = before.drop("sequence_id", "offset", "__open")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.drop("__row", "__open")


def certificate(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row: ``n_items``, ``n_sequences``, ``lower_bound`` (no packing of these lengths has fewer sequences) and ``gap``."""
    sizes = packed.groupBy("length").agg(F.count("*").alias("n"), F.sum((F.col("offset") == 0).cast("long")).alias("first")).collect()  # a row for each length
    bins, least = sum(r["first"] for r in sizes), lower_bound(np.array([r["length"] for r in sizes], np.int64), length, np.array([r["n"] for r in sizes], np.int64))
    return packed.sparkSession.createDataFrame([(sum(r["n"] for r in sizes), bins, least, bins - least)], "n_items long, n_sequences long, lower_bound long, gap long")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
