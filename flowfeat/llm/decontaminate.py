"""Operator 6, benchmark decontamination: latent semantic retrieval of passages, then common subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from flowfeat.llm._spark import cut, drop, table
from flowfeat.llm._text import mix, release, slices, span_hashes, words

COLUMNS, RANK, OVERSAMPLED = 1 << 15, 96, 3  # columns of the TF-IDF matrix at most, axes at least, and rows of the random sketch per axis
BLOCK, STEP, LEAST_WORDS = 16, 8, 8  # a passage is two blocks of words; a benchmark item's own passages start every STEP words; shorter items than LEAST_WORDS are found word for word only
#: (least words of an item, words of a document's passages, words between their starts): any item under 32 words fills two thirds of a passage or more.
CLASSES = ((2 * BLOCK, 2 * BLOCK, BLOCK), (16, 24, 8), (LEAST_WORDS, 12, 4))
RECALL, TRIALS, REPLACED, CONTEXT = 0.99, 4, 0.25, 200_000
ITEM_CHARS, ITEMS_PER_RANK = 5_000_000, 1_000
GROUP, ROWS, LISTED = 100_000, 64, 2_000_000  # words handled at once, rows of the sketch in one record, and list entries looked at at once
COSINE, OVERLAP, COPY, PARAPHRASE, ANSWER = 0.6, 0.4, 0.75, 0.5, 0.75


def passages(off: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of passages of each text, first word, end) of passages of ``size`` words every ``step`` words of each text; a shorter text is one passage."""
    count = np.diff(off)
    n = np.where(count > 0, np.maximum(1, -(-(count - size) // step) + 1), 0)
    text = np.repeat(np.arange(len(count)), n)
    start = off[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * step
    return n, start, np.minimum(start + size, off[1:][text])


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-12)[:, None]


def subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by one bit row per word of b."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        if m := where.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def to_codes(h: np.ndarray, vocabulary: np.ndarray, maybe: np.ndarray) -> np.ndarray:
    """Places of words in the vocabulary, from 1 on; 0 for words that are not in it. ``maybe`` is true at the low bits of the vocabulary."""
    out = np.zeros(len(h), np.int64)
    some = np.flatnonzero(maybe[(h & np.uint64(len(maybe) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(vocabulary, h[some]), max(len(vocabulary) - 1, 0))
    ok = vocabulary[at] == h[some] if len(vocabulary) else np.zeros(0, bool)
    out[some[ok]] = at[ok] + 1
    return out


def low_bits(vocabulary: np.ndarray) -> np.ndarray:
    maybe = np.zeros(1 << 20, bool)
    maybe[(vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    return maybe


def coded(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """(id, seed, codes, n): the words of every whole text as places in the vocabulary, two or four bytes each, written once for the passes to come."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    wide = code_type(len(vocabulary))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = low_bits(held.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, j in slices(texts):
                h, off = words(texts[i:j])
                data = to_codes(h, held.value, maybe).astype(wide).tobytes()
                off = off * np.dtype(wide).itemsize
                codes = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("seed").slice(i, j - i), codes, pa.array(np.diff(off) // np.dtype(wide).itemsize, pa.int64())], names=["id", "seed", "codes", "n"])

    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col).alias("seed"), F.col(text_col).alias("text"))
    out = cut(src.mapInArrow(code, f"id {docs.schema[id_col].dataType.simpleString()}, seed long, codes binary, n long"), "word-codes")
    held.destroy()
    return out


def code_type(n_terms: int) -> str:
    return "<u2" if n_terms < (1 << 16) - 1 else "<u4"


def unpacked(codes: pa.Array, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the words, offsets of texts among them)"""
    parts, wide = codes.to_pylist(), code_type(n_terms)
    return np.frombuffer(b"".join(parts), wide).astype(np.int64), np.cumsum([0, *[len(x) // np.dtype(wide).itemsize for x in parts]])


def groups(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that together hold about ``most`` words."""
    at = np.cumsum(n) // most
    cuts = np.flatnonzero(np.diff(at, prepend=-1))
    yield from zip(cuts.tolist(), [*cuts[1:].tolist(), len(n)])


def add_sketch(sketch: np.ndarray, codes: np.ndarray, off: np.ndarray, seed: np.ndarray, size: int, step: int) -> None:
    """Adds every passage's term counts, with a random sign, to one random row of the sketch: this is S A for a sparse random S."""
    n, start, end = passages(off, size, step)
    text = np.repeat(np.arange(len(n)), n)
    h = mix(mix(seed.view(np.uint64)[text]) + (start - off[:-1][text]).astype(np.uint64))
    length = end - start
    row = np.repeat((h % np.uint64(len(sketch))).astype(np.int64) * sketch.shape[1], length)
    sign = np.repeat(((h >> np.uint64(40)) & np.uint64(1)).astype(np.int32) * 2 - 1, length)
    code = codes[np.repeat(start - np.cumsum(length) + length, length) + np.arange(len(row))]
    some = code > 0
    np.add.at(sketch.reshape(-1), row[some] + (code[some] - 1) % sketch.shape[1], sign[some])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, the sum of the parts k of all tasks)"""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b.column("k").to_pylist(), b.column("part")):
            x = np.frombuffer(x.as_buffer(), np.int64 if k < 0 else np.int32)
            total[k] = total[k] + x if k in total else x.copy()
    for k, x in total.items():
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["k", "part"])


class Statistics(NamedTuple):
    """Of all documents: their number, those that hold each term, each term's occurrences (other words: at 0), and the sketch of their passages' counts."""

    documents: int
    holding: np.ndarray
    occurrences: np.ndarray
    sketch: np.ndarray


def statistics(rows: DataFrame, n_terms: int, height: int) -> Statistics:
    """One pass over all coded documents; what a task returns has a fixed size, and is added up by part before the driver gets it."""
    columns = max(1, min(n_terms, COLUMNS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(2 * n_terms + 3, np.int64)
        holding, occurrences = totals[1 : n_terms + 2], totals[n_terms + 2 :]
        sketch = np.zeros((height, columns), np.int32)
        for r in batches:
            totals[0] += r.num_rows
            for i, j in groups(r.column("n").to_numpy(), GROUP):
                codes, off = unpacked(r.column("codes").slice(i, j - i), n_terms)
                occurrences += np.bincount(codes, minlength=n_terms + 1)
                cell = np.unique((np.repeat(np.arange(j - i), np.diff(off)) * (n_terms + 1) + codes)[codes > 0])
                holding += np.bincount(cell % (n_terms + 1), minlength=n_terms + 1)
                add_sketch(sketch, codes, off, r.column("seed").to_numpy()[i:j], 2 * BLOCK, 2 * BLOCK)
        parts = [(-1, totals), *((k // ROWS, sketch[k : k + ROWS]) for k in range(0, height, ROWS))]
        for k, x in parts:
            if x.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["k", "part"])
        release()

    sc = rows.sparkSession.sparkContext
    totals, sketch = np.zeros(2 * n_terms + 3, np.int64), np.zeros((height, columns), np.int32)
    for r in rows.coalesce(2 * sc.defaultParallelism).mapInArrow(count, "k int, part binary").repartition(min(-(-height // ROWS) + 1, sc.defaultParallelism), "k").mapInArrow(summed, "k int, part binary").toLocalIterator():
        if r["k"] < 0:
            totals[:] = np.frombuffer(r["part"], np.int64)
        else:
            sketch[r["k"] * ROWS : (r["k"] + 1) * ROWS] = np.frombuffer(r["part"], np.int32).reshape(-1, columns)
    return Statistics(int(totals[0]), totals[1 : n_terms + 2], totals[n_terms + 2 :], sketch)


def latent_terms(item_sketch: np.ndarray, sketch: np.ndarray, weight: float, idf: np.ndarray, rank: int) -> np.ndarray:
    """Term vectors, one row per column of the sketches: the leading right singular vectors of the sketched TF-IDF passages of items and
    documents, times idf. ``weight`` is what a document's passage counts against an item's."""
    b = np.concatenate((item_sketch, np.sqrt(weight) * sketch)).astype(np.float32) * idf.astype(np.float32)
    values, turn = np.linalg.eigh((b @ b.T).astype(np.float64))
    keep = values[::-1][:rank] > 1e-6 * max(values[-1], 1e-12)
    turn = (turn[:, ::-1][:, :rank] / np.sqrt(np.maximum(values[::-1][:rank], 1e-12)))[:, keep]
    return ((b.T @ turn.astype(np.float32)) * idf[:, None]).astype(np.float32)


class Class(NamedTuple):
    """Items of like lengths: words and steps of the documents' passages, cosine limit, items; for each item the offsets of its passages among
    ``vectors`` and ``mass``, and the least of its masses; the items that hold a term (those of code c are items[first[c]:first[c + 1]] in ``holders``)
    where it weighs enough for them, and the weights of terms that are too light for some item."""

    size: int
    step: int
    limit: float
    items: np.ndarray
    own: np.ndarray
    vectors: np.ndarray
    mass: np.ndarray
    least: np.ndarray
    first: np.ndarray
    holders: np.ndarray
    common: np.ndarray


class Probes(NamedTuple):
    """Benchmark items made ready, one for all that share words and answer: their ids, codes of words and answers; weights and vectors of the codes; their (item, code) pairs as sorted numbers; classes of lengths; and what finds items word for word."""

    ids: list[list]
    words: list[list[int]]
    answers: list[list[int]]
    idf: np.ndarray
    terms: np.ndarray
    held: np.ndarray
    classes: list[Class]
    anchors: list[tuple[int, np.ndarray, np.ndarray]]
    whole: np.ndarray
    same: list[list[int]]


def passage_vectors(codes: np.ndarray, start: np.ndarray, end: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Unit latent vectors of passages; terms has a row for each column, and a code beyond the columns shares one."""
    length = end - start
    word = codes[np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())]
    rows = terms[(word - 1) % len(terms)] * (word > 0)[:, None].astype(np.float32)
    return unit(np.add.reduceat(rows, np.cumsum(length) - length, axis=0)).astype(np.float32) if len(start) else np.zeros((0, terms.shape[1]), np.float32)


def answer(text: str) -> str:
    """The last sentence that has a letter or digit."""
    return [p for p in re.split(r"[.?!\n]+", text) if any(map(str.isalnum, p))][-1]


def probes(ids: list, texts: list[str], vocabulary: np.ndarray, known: Statistics, rank: int) -> Probes:
    h, off = words(texts)
    alike: dict[tuple[bytes, bytes], list[int]] = {}
    for i in np.flatnonzero(np.diff(off) > 0).tolist():
        alike.setdefault((h[off[i] : off[i + 1]].tobytes(), words([answer(texts[i])])[0].tobytes()), []).append(i)
    ids, texts = [[ids[i] for i in x] for x in alike.values()], [texts[x[0]] for x in alike.values()]
    h, off = words(texts)
    maybe = low_bits(vocabulary)
    codes = to_codes(h, vocabulary, maybe)
    n, n_terms, columns = np.diff(off), len(vocabulary), known.sketch.shape[1]
    idf = np.log((1 + known.documents) / (1 + known.holding)) + 1e-3
    idf[0] = 0
    column_idf = np.bincount(np.arange(n_terms) % columns, idf[1:], minlength=columns) / np.maximum(np.bincount(np.arange(n_terms) % columns, minlength=columns), 1)
    own_sketch = np.zeros_like(known.sketch)
    add_sketch(own_sketch, codes, off, np.arange(len(texts)), 2 * BLOCK, STEP)
    terms = latent_terms(own_sketch, known.sketch, len(codes) / max(int(known.occurrences.sum()), 1), column_idf, rank)
    count, start, end = passages(off, 2 * BLOCK, STEP)
    first = np.cumsum(count) - count
    total = np.concatenate(([0.0], np.cumsum(idf[codes])))
    mass, vectors = total[end] - total[start], passage_vectors(codes, start, end, terms)
    pairs = np.unique(np.repeat(np.arange(len(texts)), n) * (n_terms + 1) + codes)
    share = known.occurrences / max(int(known.occurrences.sum()), 1)
    context = np.random.default_rng(11).choice(n_terms + 1, CONTEXT, p=share / share.sum()) if share.any() else np.zeros(CONTEXT, np.int64)
    parts = lambda x, o: [x[i:j] for i, j in zip(o[:-1], o[1:])]
    lists, classes, most = parts(codes, off), [], np.inf
    for least, size, step in CLASSES:
        items = np.flatnonzero((n >= least) & (n < most))
        most = least
        if not len(items):
            continue
        at = np.repeat(first[items] - np.cumsum(count[items]) + count[items], count[items]) + np.arange(count[items].sum())
        own = np.concatenate(([0], np.cumsum(count[items])))
        limit = cosine_limit([lists[i] for i in items], own, vectors[at], size, step, terms, context)
        mine = pairs[np.isin(pairs // (n_terms + 1), items)]
        holder, code = np.searchsorted(items, mine // (n_terms + 1)), mine % (n_terms + 1)
        lowest = np.minimum.reduceat(mass[at], own[:-1])
        light = OVERLAP * lowest / size  # a passage whose every word weighs less than this can't reach the item
        rare = idf[code] >= light[holder] * (1 - 1e-9)
        order = np.argsort(code[rare], kind="stable")
        lists_first = np.concatenate(([0], np.cumsum(np.bincount(code[rare], minlength=n_terms + 1))))
        classes.append(Class(size, step, limit, items, own, vectors[at], mass[at], lowest, lists_first, holder[rare][order], np.where(idf < light.max(), idf, 0.0)))
    a, a_off = words([answer(t) for t in texts])
    whole = span_hashes(codes, off[:-1], off[1:])
    short = np.minimum(n, LEAST_WORDS)
    firsts = span_hashes(codes, off[:-1], off[:-1] + short)
    anchors = [(k, np.unique(firsts[short == k]), np.unique(n[short == k])) for k in np.unique(short).tolist()]
    whole, at = np.unique(whole, return_inverse=True)
    same: list[list[int]] = [[] for _ in whole]
    for i, k in enumerate(at.tolist()):
        same[k].append(i)
    return Probes(ids, [x.tolist() for x in lists], [x.tolist() for x in parts(to_codes(a, vocabulary, maybe), a_off)], idf, terms, pairs, classes, anchors, whole, same)


def cosine_limit(lists: list[np.ndarray], own: np.ndarray, vectors: np.ndarray, size: int, step: int, terms: np.ndarray, context: np.ndarray) -> float:
    """COSINE, or less where the passages of documents would not reach it for RECALL of the items.

    Every item is put ``TRIALS`` times among words drawn as often as all documents hold them, with ``REPLACED`` of its words replaced by such words.
    """
    rng, best = np.random.default_rng(11), []
    for k, mine in enumerate(lists):
        for _ in range(TRIALS):
            length = len(mine) + 2 * size
            text = context[(rng.integers(len(context)) + np.arange(length)) % len(context)]
            lead = size + int(rng.integers(step))
            text[lead : lead + len(mine)] = np.where(rng.permutation(len(mine)) < REPLACED * len(mine) - 1e-9, context[rng.integers(len(context), size=len(mine))], mine)
            _, start, end = passages(np.array([0, length]), size, step)
            best.append(float((passage_vectors(text, start, end, terms) @ vectors[own[k] : own[k + 1]].T).max()))
    return min(COSINE, float(np.quantile(best, 1 - RECALL)))


def verbatim(codes: np.ndarray, off: np.ndarray, p: Probes) -> dict[tuple[int, int], tuple]:
    """{(text, item): (1, first word, end, "copy")} of the items that stand in the texts word for word, of any length.

    Places where an item's first words stand are found first; there the hash of as many words as any item has is looked up.
    """
    left = np.repeat(off[1:], np.diff(off)) - np.arange(len(codes))
    places, lengths = [], []
    for k, firsts, sizes in p.anchors:
        start = np.flatnonzero((left >= k) & (codes > 0))
        start = start[codes[start + k - 1] > 0]
        x = span_hashes(codes, start, start + k)
        maybe = np.zeros(1 << 16, bool)
        maybe[(firsts & np.uint64(0xFFFF)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(x & np.uint64(0xFFFF)).astype(np.int64)])
        start = start[some[np.isin(x[some], firsts)]]
        places.append(np.repeat(start, len(sizes)))
        lengths.append(np.tile(sizes, len(start)))
    place, size = np.concatenate(places), np.concatenate(lengths)
    fits = size <= left[place]
    place, size = place[fits], size[fits]
    if not len(place):
        return {}
    x = span_hashes(codes, place, place + size)
    at = np.minimum(np.searchsorted(p.whole, x), len(p.whole) - 1)
    hit = p.whole[at] == x
    place, size, at = place[hit], size[hit], at[hit]
    order = np.argsort(place, kind="stable")
    place, size, at = place[order], size[order], at[order]
    text = np.searchsorted(off, place, "right") - 1
    _, one = np.unique(text * len(p.whole) + at, return_index=True)
    return {(t, k): (1.0, s - int(off[t]), s + n - int(off[t]), "copy") for s, n, t, w in zip(place[one].tolist(), size[one].tolist(), text[one].tolist(), at[one].tolist()) for k in p.same[w]}


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, member) of all members of the ranges first[i], first[i] + 1, ... of count[i] members."""
    at = np.repeat(np.arange(len(count)), count)
    return at, first[at] + np.arange(len(at)) - (np.cumsum(count) - count)[at]


def candidates(codes: np.ndarray, off: np.ndarray, c: Class, p: Probes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, item) of every passage whose latent vector has the class's cosine with one of the item's passages, and whose words in the item
    carry ``OVERLAP`` of that passage's weight.

    The second condition goes first, by a bound that no such passage falls short of, however many items share its words. A passage none of
    whose words weighs ``OVERLAP`` of the item's least passage, divided by the words of a passage, can't reach the item; so each item is listed under
    its heavier words only. Their weights are added up over these lists, and all light words of the passage are added as if the item held them. So vectors are
    made for few passages only. Passages are taken in groups whose lists have about ``LISTED`` entries.
    """
    n, start, end = passages(off, c.size, c.step)
    first = np.cumsum(n) - n
    here = np.flatnonzero(c.first[codes + 1] > c.first[codes])
    text = np.searchsorted(off, here, "right") - 1
    word = here - off[text]
    low = np.maximum(0, (word - c.size) // c.step + 1)
    at, passage = spread(first[text] + low, np.minimum(word // c.step, n[text] - 1) - low + 1)
    order = np.argsort(passage, kind="stable")
    passage, code = passage[order], codes[here[at[order]]]
    listed = c.first[code + 1] - c.first[code]
    total = np.cumsum(listed)
    light = np.concatenate(([0.0], np.cumsum(c.common[codes])))
    found, i = [], 0
    while i < len(passage):
        j = int(np.searchsorted(total, (total[i - 1] if i else 0) + LISTED, "right"))
        j = int(np.searchsorted(passage, passage[min(max(i, j - 1), len(passage) - 1)], "right"))  # whole passages, one at least
        found += reached(codes, start, end, light, passage[i:j], code[i:j], listed[i:j], c, p)
        i = j
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def reached(codes: np.ndarray, start: np.ndarray, end: np.ndarray, light: np.ndarray, passage: np.ndarray, code: np.ndarray, listed: np.ndarray, c: Class, p: Probes) -> list[tuple]:
    """``candidates`` among passages given by their heavier words."""
    at, place = spread(c.first[code], listed)
    key = passage[at] * len(c.items) + c.holders[place]
    order = np.argsort(key)
    key = key[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(cuts):
        return []
    total = np.add.reduceat(p.idf[code[at[order]]], cuts)
    passage, item = key[cuts] // len(c.items), key[cuts] % len(c.items)
    ok = total + (light[end] - light[start])[passage] >= OVERLAP * c.least[item] - 1e-6
    passage, item = passage[ok], item[ok]
    found = []
    for i in range(0, len(passage), 4096):
        s, e, k = start[passage[i : i + 4096]], end[passage[i : i + 4096]], item[i : i + 4096]
        at, place = spread(s, e - s)
        pair = c.items[k][at] * len(p.idf) + codes[place]
        has = p.held[np.minimum(np.searchsorted(p.held, pair), len(p.held) - 1)] == pair
        weight = np.bincount(at, np.where(has, p.idf[codes[place]], 0.0), minlength=len(s))
        some = np.flatnonzero(weight >= OVERLAP * c.least[k])
        if not len(some):
            continue
        at, place = spread(c.own[k[some]], c.own[k[some] + 1] - c.own[k[some]])
        v = passage_vectors(codes, s[some], e[some], p.terms)
        hit = (weight[some[at]] >= OVERLAP * c.mass[place]) & (np.einsum("ij,ij->i", v[at], c.vectors[place]) >= c.limit)
        some = some[np.bincount(at, hit, minlength=len(some)) > 0]
        found.append((s[some], e[some], c.items[k[some]]))
    return found


def search(codes: np.ndarray, off: np.ndarray, p: Probes) -> list[tuple]:
    """(text, item, share of the item's words found in order, first word, end, kind) of every leak in whole texts."""
    if not len(codes) or not len(p.ids):
        return []
    found = verbatim(codes, off, p)
    for c in p.classes:
        start, end, owner = candidates(codes, off, c, p)
        text = np.searchsorted(off, start, "right") - 1
        for s, e, t, k in zip(start.tolist(), end.tolist(), text.tolist(), owner.tolist()):
            item, before = p.words[k], found.get((t, k), (0.0,))[0]
            if before == 1:
                continue
            lo, hi = max(int(off[t]), s - len(item)), min(int(off[t + 1]), e + len(item))
            region = codes[lo:hi].tolist()
            share = subsequence(item, region) / len(item)
            if share < PARAPHRASE or share <= before:
                continue
            if share >= COPY or subsequence(p.answers[k], region) >= ANSWER * len(p.answers[k]):
                found[t, k] = (share, lo - int(off[t]), hi - int(off[t]), "copy" if share >= COPY else "paraphrase")
    return [(t, k, *v) for (t, k), v in found.items()]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = RANK, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(id, item, ``share``, ``first_word``, ``end_word``, ``kind``) of every benchmark item found in a document.

    Items that stand in a document word for word are found by hashes, whatever their length. For others, a passage (of 32 words,
    and for items under 32 or 16 words of 24 or 12) is a candidate if its latent vector has a cosine of ``COSINE`` with one of
    an item's passages, or less if items with a quarter of their words replaced don't reach that, and the words that it shares
    with the item carry ``OVERLAP`` of that passage's weight. Around it the longest common subsequence of words is found:
    ``COPY`` of the item's words is a copy; from ``PARAPHRASE`` on the item's last sentence, its answer, must be there by
    ``ANSWER`` too. Words are compared in lower case without punctuation.

    The latent space is a randomised SVD of the TF-IDF passages of all documents and all items: every passage is added to a random
    row of a sketch, the sketches of all tasks are added up, and the axes are those of the sum. Its terms are the benchmark's words, since
    others have no share in any product with an item; frequencies count all documents. The rank grows with the root of the number of items.

    Items with fewer than ``LEAST_WORDS`` words match word for word only. Items without words, null texts and null item ids match
    nothing; so do documents without words.
    Repeated rows of docs give repeated rows; items that share a text each match. The benchmark is taken in blocks of about
    ``item_chars`` characters, each with its own terms and axes, so what is broadcast has a fixed size; no text is shuffled.
    """
    items = cut(benchmark.filter(F.col(item_text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).distinct(), "items")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // item_chars))
    kind, item_kind = docs.schema[id_col].dataType, items.schema["item"].dataType
    out = None
    for k in range(blocks):
        chosen = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").collect()  # about item_chars characters
        texts = [r["text"] for r in chosen]
        vocabulary = np.unique(words(texts)[0])
        rows = coded(docs, id_col, text_col, vocabulary)
        axes = max(rank, int(np.ceil(rank * np.sqrt(len(chosen) / ITEMS_PER_RANK))))
        known = statistics(rows, len(vocabulary), OVERSAMPLED * axes)
        held = docs.sparkSession.sparkContext.broadcast(probes([r["item"] for r in chosen], texts, vocabulary, known, axes))
        n_terms = len(vocabulary)

        def find(batches: Iterator[pa.RecordBatch], held=held, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            p = held.value
            for b in batches:
                hits = []
                for i, j in groups(b.column("n").to_numpy(), GROUP):
                    hits += [(i + t, *rest) for t, *rest in search(*unpacked(b.column("codes").slice(i, j - i), n_terms), p)]
                at, item, share, lo, hi, how = zip(*((t, one, *rest) for t, k, *rest in hits for one in p.ids[k])) if hits else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").take(pa.array(at, pa.int64())), pa.array(item, to_arrow_type(item_kind)), pa.array(share, pa.float64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(how, pa.string())],
                    names=[id_col, item_col, "share", "first_word", "end_word", "kind"],
                )
            release()

        found = rows.select("id", "codes", "n").mapInArrow(find, f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, share double, first_word long, end_word long, kind string")
        part = cut(found, "leaks")
        drop(rows)
        held.destroy()
        out = part if out is None else out.union(part)
    release()
    return out


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
