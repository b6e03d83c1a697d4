"""Operator 10, language ID: prediction by partial matching with byte context trees, one per language."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowfeat.llm._spark import table
from flowfeat.llm._text import release, slices

ORDER, SAMPLE, MIN_COUNT, ROWS = 3, 600, 2, 2_048
UNKNOWN = "und"


class Trees(NamedTuple):
    """Frozen statistics. Bytes are first mapped to classes (``classes``: those seen in training, the rest share class 0).

    ``steps[k][state, class]`` is the context of the last k + 1 classes, where state is the context of k classes before;
    contexts seen too rarely fall back to the next shorter one, so the order varies. ``bits[context, class, language]``
    is the exact code length of a class after a context, escapes included.
    """

    languages: list[str]
    classes: np.ndarray
    steps: list[np.ndarray]
    bits: np.ndarray


def grams(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n from 1 to order + 1 the distinct n-grams that lie within one text, each packed in a number, and their counts."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    inside = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    out, packed = [], np.zeros(len(data), np.int64)
    for n in range(order + 1):
        packed = data if n == 0 else (np.concatenate((np.zeros(1, np.int64), packed[:-1])) << 8) + data
        out.append(np.unique(packed[inside >= n], return_counts=True))
    return out


def build(counts: dict[str, list[tuple[np.ndarray, np.ndarray]]], order: int = ORDER, min_count: int = MIN_COUNT) -> Trees:
    """Context trees of each language from the counts of its 1-grams to (order + 1)-grams.

    Escape (method C): after a context with n symbols of d kinds an unseen one costs d / (n + d), and then what the
    shorter context without its seen symbols gives; the last resort is uniform. Rows of contexts are made ``ROWS`` at a time.
    """
    names = sorted(counts)
    seen = np.zeros(256, bool)
    for of in counts.values():
        seen[of[0][0]] = True
    classes = np.where(seen, np.cumsum(seen), 0).astype(np.int64)
    base = int(seen.sum()) + 1

    def in_classes(g: np.ndarray, n: int) -> np.ndarray:
        return sum((classes[g >> (8 * k) & 255] * base**k for k in range(n)), np.zeros(len(g), np.int64))

    coded = {x: [(in_classes(g, n + 1), c) for n, (g, c) in enumerate(counts[x])] for x in names}
    # contexts of each length that are seen often enough, each with its longer ones below it
    contexts = [np.zeros(1, np.int64)]
    for n in range(1, order + 1):
        keys, back = np.unique(np.concatenate([coded[x][n - 1][0] for x in names]), return_inverse=True)
        keys = keys[np.bincount(back, np.concatenate([coded[x][n - 1][1] for x in names]), minlength=len(keys)) >= min_count]
        contexts.append(keys[np.isin(keys % base ** (n - 1), contexts[-1])] if n > 1 else keys)
    number = np.cumsum([0, *map(len, contexts)])
    bits = np.zeros((number[-1], base, len(names)), np.float32)
    for j, name in enumerate(names):
        shorter = np.full((1, base), 1.0 / base)
        for n in range(order + 1):
            keys, (g, c) = contexts[n], coded[name][n]
            order_ = np.argsort(g)
            g, c = g[order_], c[order_]
            up = np.searchsorted(contexts[n - 1], keys % base ** (n - 1)) if n else np.zeros(1, np.int64)
            here = np.zeros((len(keys), base)) if n < order else None
            for i in range(0, len(keys), ROWS):
                some, p = keys[i : i + ROWS], shorter[up[i : i + ROWS]]
                lo, hi = np.searchsorted(g, (some[0] * base, (some[-1] + 1) * base))
                at = np.minimum(np.searchsorted(some, g[lo:hi] // base), len(some) - 1)
                ok = some[at] == g[lo:hi] // base
                count = np.zeros((len(some), base))
                count[at[ok], g[lo:hi][ok] % base] = c[lo:hi][ok]
                total, kinds = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
                rest = np.where(count > 0, 0, p)
                left = rest.sum(1, keepdims=True)
                escape = np.where(left > 0, kinds / np.maximum(total + kinds, 1), 0)
                q = np.where(count > 0, count / np.maximum(total + np.where(left > 0, kinds, 0), 1), escape * rest / np.maximum(left, 1e-300))
                q = np.where(total > 0, q, p)
                bits[number[n] + i : number[n] + i + len(some), :, j] = -np.log2(np.maximum(q, 1e-30))
                if here is not None:
                    here[i : i + len(some)] = q
            shorter = here
    # steps[k]: from the context of the k bytes nearest and the byte before them to the longest kept context
    steps = []
    for k in range(order):
        to = np.repeat(np.arange(number[k], number[k + 1])[:, None], base, axis=1)
        at = np.searchsorted(contexts[k], contexts[k + 1] % base**k)
        to[at, contexts[k + 1] // base**k] = number[k + 1] + np.arange(len(contexts[k + 1]))
        steps.append(to.astype(np.int32))
    return Trees(names, classes, steps, bits)


def train(texts: dict[str, list[bytes]], order: int = ORDER, min_count: int = MIN_COUNT) -> Trees:
    """Context trees from texts at hand."""
    return build({k: grams(v, order) for k, v in texts.items()}, order, min_count)


def code_lengths(trees: Trees, texts: list[bytes]) -> np.ndarray:
    """Bits of each text under each language."""
    out = np.zeros((len(texts), len(trees.languages)))
    sizes = np.array([len(t) for t in texts])
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    data = trees.classes[np.frombuffer(b"".join(texts), np.uint8)]
    start = np.concatenate(([0], np.cumsum(sizes[some])))[:-1]
    inside = np.arange(len(data)) - np.repeat(start, sizes[some])
    state = np.zeros(len(data), np.int64)
    low = 0
    for k, step in enumerate(trees.steps):
        deep = np.flatnonzero((state >= low) & (inside > k)) if k else np.flatnonzero(inside > 0)  # those whose context of k bytes was kept whole
        state[deep] = step[state[deep] - low, data[deep - k - 1]]
        low += len(step)
    per = trees.bits.reshape(-1, len(trees.languages))[state * trees.bits.shape[1] + data]
    out[some] = np.add.reduceat(per, start, axis=0, dtype=np.float64)
    return out


def predict(trees: Trees, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language of least code length, or ``und`` for a text that is null or has no letter, and its posterior share."""
    data = [(t or "").encode("utf-8", "replace") for t in texts]
    bits = code_lengths(trees, data)
    best = bits.argmin(1)
    score = 1 / np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0)).sum(1)
    found = [t is not None and any(map(str.isalpha, t)) for t in texts]
    return [trees.languages[b] if f else UNKNOWN for b, f in zip(best, found)], np.where(found, score, 0.0)


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = SAMPLE) -> DataFrame:
    """(lang, text) of about ``per_language`` whole texts of each language for training, of any length.

    A row is drawn if the hash of its id and text is below the share asked for, so rows that repeat an id and text are drawn
    together and count once.
    """
    hashed = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), text_col).alias("h"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row for each language
    bound = {r["lang"]: -(1 << 63) + min((1 << 64) - 1, (1 << 64) * per_language // max(r["n"], 1)) for r in sizes}
    if not bound:
        return hashed.select("lang", "text")
    below = F.element_at(F.create_map(*[F.lit(x) for k, v in bound.items() for x in (k, v)]), F.col("lang"))
    return hashed.filter(F.col("h") <= below).groupBy("lang", "h").agg(F.first("text").alias("text")).select("lang", "text")


def counted(texts: DataFrame, order: int = ORDER) -> dict[str, list[tuple[np.ndarray, np.ndarray]]]:
    """n-gram counts of each language's texts, counted in tasks and added up by Spark; no text reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, data = b.column("lang").to_pylist(), [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]
            for lang in sorted(set(langs)):
                for n, (g, c) in enumerate(grams([t for k, t in zip(langs, data) if k == lang], order)):
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(np.full(len(g), n, np.int32)), pa.array(g), pa.array(c.astype(np.int64))], names=["lang", "n", "gram", "c"])
        release()

    got = texts.mapInArrow(count, "lang string, n int, gram long, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")).toArrow()
    lang, n, gram, c = got.column("lang").combine_chunks().dictionary_encode(), *(got.column(k).to_numpy() for k in ("n", "gram", "c"))
    at = lang.indices.to_numpy()
    return {x: [(gram[some], c[some]) for k in range(order + 1) for some in [(at == i) & (n == k)]] for i, x in enumerate(lang.dictionary.to_pylist())}


def language_id(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every column of docs (but an own ``lang_pred`` or ``score``) and ``lang_pred`` and ``score`` of the whole text.

    Rows are scored where they lie, without a shuffle; the trees are broadcast, their size is bounded by the bounded
    sample that they come from. Null texts and texts without a letter are ``und`` with score 0. Equal code lengths go
    to the first language by name. Repeated rows give repeated rows.
    """
    own = [f for f in docs.schema if f.name not in ("lang_pred", "score")]
    held = docs.sparkSession.sparkContext.broadcast(trees)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.names.index(text_col)).to_pylist()
            names, scores = [], []
            for i, j in slices(texts, 500_000):
                n, s = predict(held.value, texts[i:j])
                names += n
                scores.append(s)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*b.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return docs.select(*[F.col(f"`{f.name}`") for f in own]).mapInArrow(judge, f"{schema}, lang_pred string, score double")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE) -> Trees:
    """Trees from about ``per_language`` texts of each language, of the documents whose crc32(id as text) mod 4 is not 2."""
    drawn = sample(docs.filter(F.crc32(F.col(id_col).cast("string")) % 4 != 2), id_col, text_col, lang_col, per_language)
    trees = build(counted(drawn) or {UNKNOWN: grams([b" "], ORDER)})
    release()
    return trees


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out"), "lang_pred", "score")
