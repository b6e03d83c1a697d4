"""Operator 9, token counts: a byte-level BPE tokenizer compiled to a deterministic transducer that counts tokens."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from flowfeat.llm._spark import table
from flowfeat.llm._text import flat, slices

LIMIT, CHUNK, MAX_CELLS, FEW, WEIGHT_BITS = 512, 128, 1 << 25, 64, 8
#: Modes of the splitter: after a break; in a run of letters, digits or other signs; in white space with its last character kept back; after an apostrophe, and after the first letter of 're, 've, 'll.
START, LETTERS, DIGITS, SIGNS, SPACE, QUOTE, QUOTE_2 = range(7)
KINDS = {LETTERS: 0, DIGITS: 1, SIGNS: 3}
SECOND = {b"r": b"e", b"v": b"e", b"l": b"l"}
SPECIAL = 1024  # the symbol that stands for an added token; others are 256 * kind of the character + byte


@cache
def kinds() -> np.ndarray:
    """0 letter, 1 digit, 2 white space, 3 other, of every code point."""
    every = "".join(map(chr, (i if not 0xD800 <= i < 0xE000 else 0 for i in range(0x110000))))
    out = np.full(0x110000, 3, np.uint8)
    for k, pattern in enumerate((r"\p{L}+", r"\p{N}+", r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = k
    # the library knows the letters of its own edition of Unicode: those it parts from a letter are other signs there
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    for k, lead in ((0, "a"), (1, "1")):
        points = np.flatnonzero(out == k)
        spans = np.array([at for _, at in split("\n".join(lead + chr(p) for p in points))])
        known = np.zeros(len(points), bool)
        known[spans[spans[:, 1] - spans[:, 0] == 2, 0] // 3] = True
        out[points[~known]] = 3
    return out


def vocabulary(path: str) -> tuple[dict[bytes, int], dict[tuple[bytes, bytes], int], list[str]]:
    """(token ids, merge ranks, added tokens) of a tokenizers file with byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the format writes other bytes as characters from 256 on
    byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)}
    raw = lambda s: bytes(byte[c] for c in s)
    pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
    return {raw(k): v for k, v in spec["model"]["vocab"].items()}, {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}, [x["content"] for x in spec["added_tokens"]]


def merged(word: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """The tokens of one word: the adjacent pair of lowest rank is joined until none can be."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 60))
        if (parts[best], parts[best + 1]) not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """A deterministic transducer over UTF-8 bytes: cell[state, symbol] holds the next state and the change of the token count.

    States are made as texts need them. Inside a word a state holds, for each place from which a vocabulary entry
    could still grow, the bytes since, the last token before that place and the count there against the count
    here. That decides all that follows, because tokens a, b stand side by side in a result exactly if merging a + b
    gives a, b; so the last token of each prefix is the one that fits its own place. Tokens that fit the same ``FEW`` tokens
    at most that can follow are held as one. A word's count can fall as it grows:
    weights may be negative. When the table passes ``max_cells`` it starts anew from the states in use, so memory stays
    bounded on any text.
    """

    EMPTY = ((0, -1, 0),)

    def __init__(self, path: str, max_cells: int = MAX_CELLS):
        tokens, ranks, self.added = vocabulary(path)
        # a token's place in order of making: single bytes, then the results of merges
        made = [bytes([i]) for i in range(256)] + [a + b for a, b in sorted(ranks, key=ranks.get)]
        number = {t: i for i, t in enumerate(made)}
        self.pairs = {(number[a], number[b]): number[a + b] for a, b in ranks}
        self.parts = [(-1, -1)] * 256 + [(number[a], number[b]) for a, b in sorted(ranks, key=ranks.get)]
        self.child: dict[int, int] = {}  # 256 * place in the tree of tokens + byte
        self.ends = [-1]  # the token that ends at a place
        self.inner = [True]  # whether longer tokens go on from it
        for t, n in number.items():
            at = 0
            for byte in t:
                self.inner[at] = True
                if (to := self.child.get(at << 8 | byte)) is None:
                    to = self.child[at << 8 | byte] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                at = to
            self.ends[at] = n
        self.beyond: dict[int, list[int]] = {}  # tokens that go on from a place, where they are few
        above = [0] * len(self.ends)
        for key, to in self.child.items():
            above[to] = key >> 8
        for to in range(1, len(above)):
            at = above[to]
            while self.ends[to] >= 0 and at:
                self.beyond.setdefault(at, []).append(self.ends[to])
                at = above[at]
        self.beyond = {k: v for k, v in self.beyond.items() if len(v) <= FEW}
        self.seen: dict[int, int] = {}
        self.same: dict[tuple, int] = {}
        self.fits: dict[int, bool] = {}
        self.fed = lru_cache(1 << 16)(self._fed)
        self.max_cells, self.column, self.symbols, self.held = max_cells, np.full(SPECIAL + 1, -1, np.int32), [], []
        self.bits, self.kind = WEIGHT_BITS, np.int32  # a cell holds the next state, and the change of the count in its low bits
        self.reset()

    # words

    def beside(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay two when their bytes are merged.

        The merges across the border are tried from the last made inwards: one that was made before the parts around it would have come first.
        """
        pairs, parts, limit = self.pairs, self.parts, 1 << 60
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                limit, a = (a, parts[a][1]) if parts[a][1] >= 0 else (-1, -1)
            elif parts[b][0] >= 0:
                limit, b = b + 1, parts[b][0]
            elif parts[a][1] >= 0:
                limit, a = a, parts[a][1]
            else:
                return True
            if limit < 0:
                return True

    def alike(self, at: int, last: int) -> int:
        """The first token met that fits the same tokens from here on; -1 if all fit, as at a word's start, -2 if none."""
        fits = tuple(self.beside(last, t) for t in self.beyond[at])
        return -1 if all(fits) else -2 if not any(fits) else self.same.setdefault((at, fits), last)

    def _fed(self, places: tuple, byte: int) -> tuple[tuple, int]:
        """The places after one more byte, and the change of the count. A place: (where its bytes lead in the tree of tokens, token before, count)."""
        token, change, live = -1, 0, []
        for at, last, c in places:
            if (to := self.child.get(at << 8 | byte)) is None:
                continue
            if token < 0 and (t := self.ends[to]) >= 0:
                if last < 0:
                    token, change = t, c + 1
                else:
                    if (ok := self.fits.get(key := last << 20 | t)) is None:
                        ok = self.fits[key] = self.beside(last, t)
                    if ok:
                        token, change = t, c + 1
            if self.inner[to]:
                if last >= 0 and to in self.beyond:
                    if (as_ := self.seen.get(key := to << 20 | last)) is None:
                        as_ = self.seen[key] = self.alike(to, last)
                    if as_ < -1:
                        continue
                    last = as_
                live.append((to, last, c))
        return (*((to, last, c - change) for to, last, c in live), (0, token, 0)), change

    def push(self, places: tuple, data: bytes) -> tuple[tuple, int]:
        total = 0
        for b in data:
            places, change = self.fed(places, b)
            total += change
        return places, total

    def size(self, data: bytes) -> int:
        return self.push(self.EMPTY, data)[1]

    # splitting

    def begin(self, kind: int, c: bytes, blank: bytes = b"") -> tuple[tuple, int]:
        """A word that starts with byte c, after a blank that belongs to it."""
        if kind == 2:
            return (SPACE, self.EMPTY, c), 0
        if c == b"'" and not blank:
            return (QUOTE, self.EMPTY, c), 0
        places, n = self.push(self.EMPTY, blank + c)
        return ({0: LETTERS, 1: DIGITS, 3: SIGNS}[kind], places, b""), n

    def step(self, state: tuple, kind: int, c: bytes) -> tuple[tuple, int]:
        mode, places, held = state
        if mode in KINDS:
            if kind != KINDS[mode]:
                return self.begin(kind, c)
            places, n = self.push(places, c)
            return (mode, places, b""), n
        if mode == START:
            return self.begin(kind, c)
        if mode == SPACE:
            if kind == 2 and 0x80 <= c[0] < 0xC0:
                return (SPACE, places, held + c), 0
            if kind == 2:  # white space before white space stays in the run
                places, n = self.push(places, held)
                return (SPACE, places, c), n
            if held == b" ":
                return self.begin(kind, c, b" ")
            after, n = self.begin(kind, c)
            return after, n + self.size(held)  # alone, as a run of one
        if mode == QUOTE:
            if c in (b"s", b"t", b"m", b"d"):
                return (START, self.EMPTY, b""), self.size(held + c)
            if c in SECOND:
                return (QUOTE_2, self.EMPTY, held + c), 0
            places, n = self.push(self.EMPTY, held)
            after, m = self.step((SIGNS, places, b""), kind, c)
            return after, n + m
        if c == SECOND[held[1:]]:
            return (START, self.EMPTY, b""), self.size(held + c)
        middle, n = self.begin(0, held[1:])
        after, m = self.step(middle, kind, c)
        return after, self.size(held[:1]) + n + m

    def finish(self, state: tuple) -> int:
        mode, places, held = state
        return self.size(held[:1]) + self.size(held[1:]) if mode == QUOTE_2 else self.push(places, held)[1]

    # tables

    def reset(self) -> None:
        """Empty tables but for START, as 0, and the states that arrays in ``held`` name; those arrays get the new numbers."""
        old = getattr(self, "states", [])
        self.states, self.number = [], {}
        if len(self.fits) > 1 << 20:
            self.fits.clear()
            self.seen.clear()  # self.same stays: what it names must not change while states live
        self.cell = np.full((1024, max(64, len(self.symbols) + 16)), -1, self.kind)
        self.last = np.zeros(1024, np.int64)
        self.id((START, self.EMPTY, b""))
        used = np.unique(np.concatenate([np.zeros(1, np.int64), *self.held]))
        new = np.array([self.id(old[i]) if i else 0 for i in used])
        for a in self.held:
            a[:] = new[np.searchsorted(used, a)]

    def id(self, state: tuple) -> int:
        if (n := self.number.get(state)) is None:
            n = self.number[state] = len(self.states)
            self.states.append(state)
            if n >= len(self.cell):
                self.cell = np.concatenate((self.cell, np.full_like(self.cell, -1)))
                self.last = np.concatenate((self.last, np.zeros_like(self.last)))
            self.last[n] = self.finish(state) if state[2] else 0
        return n

    def columns(self, symbols: np.ndarray) -> np.ndarray:
        for x in np.flatnonzero((np.bincount(symbols, minlength=SPECIAL + 1) > 0) & (self.column < 0)):
            self.column[x] = len(self.symbols)
            self.symbols.append(int(x))
        if (more := len(self.symbols) - self.cell.shape[1]) > 0:
            self.cell = np.concatenate((self.cell, np.full((len(self.cell), more + 32), -1, self.kind)), axis=1)
        return self.column[symbols]

    def compile(self, state: int, column: int) -> None:
        x = self.symbols[column]
        after, n = ((START, self.EMPTY, b""), self.finish(self.states[state]) + 1) if x == SPECIAL else self.step(self.states[state], x >> 8, bytes([x & 255]))
        while not -(1 << self.bits - 1) <= n < 1 << self.bits - 1:
            self.widen()
        to = self.id(after)  # may move the tables
        self.cell[state, column] = (to << self.bits) + n + (1 << self.bits - 1)

    def widen(self) -> None:
        """Twice the bits for changes of the count, in wider cells."""
        known, old, self.bits, self.kind = self.cell >= 0, self.bits, 2 * self.bits, np.int64
        cell = self.cell.astype(np.int64)
        self.cell = np.where(known, (cell >> old << self.bits) + (cell & (1 << old) - 1) - (1 << old - 1) + (1 << self.bits - 1), -1)

    def run(self, columns: np.ndarray, start: np.ndarray, length: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and count of many stretches, all of them one symbol further at a time."""
        order = np.argsort(-length, kind="stable")
        start, shrinking, state, count = start[order], -length[order], entry[order], np.zeros(len(order), np.int64)
        self.held.append(state)
        for t in range(-int(shrinking[0]) if len(order) else 0):
            n = int(np.searchsorted(shrinking, -t))  # stretches longer than t
            x = columns[start[:n] + t]
            got = self.cell[state[:n], x]
            while got.min() < 0:
                if self.cell.size > self.max_cells and len(self.states) > 2 * len(order) + 1024:
                    self.reset()
                miss = self.cell[state[:n], x] < 0
                for s in np.unique(state[:n][miss] * 4096 + x[miss]).tolist():
                    self.compile(s >> 12, s & 4095)
                got = self.cell[state[:n], x]
            state[:n] = got >> self.bits
            count[:n] += (got & (1 << self.bits) - 1) - (1 << self.bits - 1)
        self.held = [a for a in self.held if a is not state]
        back = np.argsort(order)
        return state[back], count[back]

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and the offsets of each."""
        points, off = flat(texts)
        wide = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(wide)))
        symbols = np.frombuffer("".join(texts).encode("utf-8"), np.uint8) + np.repeat(kinds()[points], wide).astype(np.int32) * 256
        off = at[off]
        gone = np.zeros(len(symbols), bool)
        for i, t in enumerate(texts):
            for a in self.added:
                k = t.find(a)
                while k >= 0:
                    b = off[i] + len(t[:k].encode())
                    symbols[b] = SPECIAL
                    gone[b + 1 : b + len(a.encode())] = True
                    k = t.find(a, k + len(a))
        return symbols[~gone], off - np.concatenate(([0], np.cumsum(gone)))[off]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text, by a prefix scan over the maps of its chunks.

        A chunk maps its entry state to (exit state, count). Where white space follows another character the state is
        the same whatever came before, so behind its first such place a chunk's map is constant; all these parts run at once.
        Maps of chunks without such a place are tabled for the states that can come in: the true one where it is known, else START and
        what the chunk before gives, until nothing new comes in. For any text that is soon, as a state forgets what is some tokens
        behind, or repeats itself with the text. The tables are then composed in pairs, so that after k rounds each spans
        2 ** k chunks. Last run the parts before the first such place, which what comes before has now been told.
        """
        if not texts:
            return np.zeros(0, np.int64)
        symbols, off = self.encoded([t or "" for t in texts])
        columns = self.columns(symbols)
        space = (symbols >> 8 == 2) & (symbols & 0xC0 != 0x80)
        sync = np.flatnonzero(space[1:] & (symbols[:-1] >> 8 != 2)) + 1
        chunks = np.maximum(1, -(-np.diff(off) // CHUNK))
        first = np.concatenate(([0], np.cumsum(chunks)))
        text = np.repeat(np.arange(len(texts)), chunks)
        begin = off[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * CHUNK
        end = np.minimum(begin + CHUNK, off[1:][text])
        at = np.searchsorted(sync, begin + 1)
        has = at < np.searchsorted(sync, end)
        middle = np.where(has, np.append(sync, 0)[at], end)
        head = np.zeros(len(begin), bool)
        head[first[:-1]] = True
        exit_, total = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        self.held = [exit_]
        tails = np.flatnonzero(has)
        ends, total[tails] = self.run(columns, middle[tails], end[tails] - middle[tails], np.zeros(len(tails), np.int64))
        exit_[tails] = ends
        self.open_chunks(columns, begin, end, has, head, exit_, total)
        entry = np.where(head[tails], 0, exit_[tails - 1])
        ends, n = self.run(columns, begin[tails], middle[tails] - begin[tails], entry)
        total[tails] += n + self.last[ends]  # with what white space ends at the constant part's start
        self.held = []
        return np.add.reduceat(total, first[:-1]) + self.last[exit_[first[1:] - 1]]

    def open_chunks(self, columns: np.ndarray, begin: np.ndarray, end: np.ndarray, has: np.ndarray, head: np.ndarray, exit_: np.ndarray, total: np.ndarray) -> None:
        """Sets the exit of each stretch of chunks without a constant part, at its last chunk, and its count, at its first."""
        opened = np.flatnonzero(~has)
        if not len(opened):
            return
        inner = ~has & ~head & np.concatenate(([False], ~has[:-1]))  # those that follow another one
        key = lambda c, state: c << 32 | state
        chunk, entry = opened, np.where(head[opened] | inner[opened], 0, exit_[opened - 1])
        of, came, left, count = (np.zeros(0, np.int64) for _ in range(4))
        while len(chunk):  # rows of the tables: chunk, entry, exit, count
            self.held = [exit_, came, left, entry]
            to, n = self.run(columns, begin[chunk], end[chunk] - begin[chunk], entry)
            of, came, left, count = (np.concatenate(x) for x in ((of, chunk), (came, entry), (left, to), (count, n)))
            goes = chunk + 1 < len(begin)
            goes[goes] = inner[chunk[goes] + 1]
            new = np.setdiff1d(key(chunk[goes] + 1, to[goes]), key(of, came))
            chunk, entry = new >> 32, new & 0xFFFFFFFF
        self.held = [exit_]
        known = key(of, came)
        order = np.argsort(known)
        goes = of + 1 < len(begin)
        goes[goes] = inner[of[goes] + 1]
        then = np.arange(len(of))
        then[goes] = order[np.searchsorted(known[order], key(of[goes] + 1, left[goes]))]
        span = np.where(goes, count, 0)
        while (then[then] != then).any():
            span, then = span + span[then], then[then]
        starts = opened[~inner[opened]]
        row = order[np.searchsorted(known[order], key(starts, np.where(head[starts], 0, exit_[starts - 1])))]
        total[starts] = span[row] + count[then[row]]
        exit_[of[then[row]]] = left[then[row]]


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row of docs: the id, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit``.

    ``path`` names a tokenizers file with byte-level BPE, present on every executor; counts equal the library's for
    whole texts without added begin or end tokens, an added token's string inside a text counting as that token.
    Null and empty texts have no bytes and no tokens. Repeated rows give repeated rows. No shuffle: each task holds one
    Arrow batch and one bounded table, which its worker keeps for later tasks.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            n = [machine.counts(texts[i:j]) for i, j in slices(texts)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = src.mapInArrow(count, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
