"""Operators 11 to 13 against plain versions, and with nulls, empty tables, repeated rows, very long texts, ties and clashing columns."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, h long, mask string, id long, runs int, kept string, distance string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, la, so, 7, "m", -i if i is not None else None, 3, "k", "d") for i, t, la, so in rows], DOCS)


# 11: periodic runs


def brute_runs(x, min_words=6, exponent=4):
    out = []
    for q in range(1, len(x) // exponent + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(x) and x[i] == x[i + q]:
                i += 1
            n = i - s + q
            if n >= max(min_words, exponent * q) and not any(all(x[k] == x[k + p] for k in range(s, s + n - p)) for p in range(1, q)):
                out.append((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (9, 3)])
def test_runs_of_random_words(least, exponent):
    from flowfeat.llm.periodic_runs import runs_of

    rng = np.random.default_rng(3)
    for _ in range(150):
        texts = []
        for _ in range(rng.integers(1, 5)):
            t = rng.integers(rng.integers(1, 4), size=rng.integers(0, 60)).tolist()
            if len(t) > 4:
                a, p = int(rng.integers(len(t))), int(rng.integers(1, 9))
                t = t[:a] + [t[a + (i - a) % min(p, len(t) - a)] for i in range(a, len(t))] + rng.integers(3, size=rng.integers(0, 5)).tolist()
            texts.append(t)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        got = runs_of(np.array(sum(texts, []), np.int64), off, least, exponent)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t, least, exponent)]


def test_runs_of_long_and_odd_texts(spark):
    from flowfeat.llm.periodic_runs import periodic_runs

    long = " ".join(["tick"] * 250_000) + " " + " ".join(f"w{i % 50_000}" for i in range(220_000))
    texts = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "A a A a A a A a x", "é\x0bé\x1cé é é é é é", "a a a a a a b a a a a a a", long, "a b c " * 5 + "a b"]
    got = {r["doc_id"]: r for r in periodic_runs(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        if t is long:
            assert [tuple(r) for r in got[i]["runs"]] == [(0, 250_000, 1), (250_000, 220_000, 50_000)]
            assert got[i]["collapsed"].split() == ["tick"] + [f"w{k}" for k in range(50_000)]
            continue
        w = [x.decode() for x in (t or "").encode().split()]
        assert [tuple(r) for r in got[i]["runs"]] == brute_runs(w), t
        assert got[i]["collapsed"] == collapsed(w, brute_runs(w))
    twice = docs(spark, [(1, "a a a a a a", "en", "s")] * 2 + [(None, "b b b b b b", None, None)])
    assert sorted(r["collapsed"] for r in periodic_runs(twice).collect()) == ["a", "a", "b"]
    assert periodic_runs(twice.limit(0)).count() == 0


def test_op11_is_the_plain_version(spark):
    from flowfeat.llm.periodic_runs import op11_periodic_runs

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: tuple(r)[1:] for r in op11_periodic_runs(spark, f"{DATA}/sf0.001").collect()}
    for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect():
        w = [x.decode() for x in (r["text"] or "").encode().split()]
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute_runs(w)
        s, m, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        assert got[r["doc_id"]] == (len(runs), s, m, q, 1000 * m // q if runs else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapsed(w, runs)))
    assert any(v[0] > 1 for v in got.values()) and any(v[0] == 0 for v in got.values())


# 12: outliers


def plain_statistics(text):
    t = text or ""
    w = [x.decode() for x in t.encode().split()]
    grams = list(zip(w, w[1:], w[2:]))
    times = collections.Counter(grams)
    cover = {j for k, g in enumerate(grams) if times[g] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover)


def plain_mcd(x, floors, half, steps, bins, grid):
    """Centre and covariance: the same start, steps and bins in plain loops over one group."""
    from flowfeat.llm.outlier_rules import _share_below, chi_square

    p, ridge = x.shape[1], np.diag((np.array(floors) * grid) ** 2)
    low = lambda v: np.sort(v)[math.ceil(len(v) / 2) - 1]
    far = lambda m, c: np.einsum("ij,ij->i", x - m, np.linalg.solve(c, (x - m).T).T)
    moments = lambda y, scale: (y.mean(0), ((y.T @ y) / len(y) - np.outer(y.mean(0), y.mean(0))) * scale + ridge)
    m = np.array([low(x[:, i]) for i in range(p)], float)
    e = np.array([low(np.abs(x[:, i] - m[i])) for i in range(p)], float)
    best = None
    for m, c in ((m, np.diag((1.4826 * e) ** 2) + ridge), moments(x, 1.0)):
        for _ in range(steps):
            b = np.floor(np.log2(np.maximum(far(m, c), 1e-6)) * bins)
            m, c = moments(x[b <= np.sort(b)[math.ceil(half * len(x)) - 1]], 1.0)
        if best is None or np.linalg.slogdet(c)[1] < best[0] - 1e-12:
            best = (np.linalg.slogdet(c)[1], m, c)
    near = far(*best[1:]) <= chi_square(0.975, p) * half / _share_below(chi_square(half, p), p + 2)
    m, c = moments(x[near], 0.975 / _share_below(chi_square(0.975, p), p + 2))
    return far(m, c)


def test_outliers_are_those_of_plain_loops(spark):
    from flowfeat.llm.outlier_rules import BINS, FLOORS, GRID, HALF, MIN_ROWS, STEPS, TAIL, chi_square, op12_outlier_rules

    rows = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()
    got = {r["doc_id"]: r for r in op12_outlier_rules(spark, f"{DATA}/sf0.01").collect()}
    assert len(got) == len(rows)
    stats = {r["doc_id"]: plain_statistics(r["text"]) for r in rows}
    failed = {k: s[0] < 50 or 100 * s[4] > 50 * s[0] for k, s in stats.items()}
    size = collections.Counter((r["lang"], r["source"]) for r in rows if not failed[r["doc_id"]])
    pool = collections.Counter(r["lang"] for r in rows if not failed[r["doc_id"]] and size[r["lang"], r["source"]] < MIN_ROWS)
    groups = collections.defaultdict(list)
    for r in rows:
        if not failed[r["doc_id"]]:
            own = size[r["lang"], r["source"]] >= MIN_ROWS
            groups[(r["lang"], r["source"]) if own else r["lang"] if pool[r["lang"]] >= MIN_ROWS else None].append(r["doc_id"])
    rnd = lambda v: math.floor(v * GRID + 0.5)
    n_out = 0
    for ids in groups.values():
        x = np.array([[rnd(math.log(c / n)), rnd(math.log1p(1000 * s / c)), rnd(math.log1p(100 * d / n)), rnd(math.log1p(100 * w / n))] for n, c, s, d, w in (stats[k] for k in ids)], float)
        far = plain_mcd(x, FLOORS, HALF, STEPS, BINS, GRID) if len(ids) >= MIN_ROWS else np.zeros(len(ids))
        for k, d in zip(ids, far):
            assert got[k]["kept"] == (d <= chi_square(1 - TAIL, 4)), k
            assert got[k]["distance"] is None if len(ids) < MIN_ROWS else abs(got[k]["distance"] - d) < 0.01 + 0.01 * d
            n_out += not got[k]["kept"]
    assert n_out > 20
    for k, s in stats.items():
        assert tuple(got[k])[1:6] == s and got[k]["base_failed"] == failed[k] and not (failed[k] and got[k]["kept"])


def test_labels_of_quality_agree_with_outliers(spark):
    from flowfeat.llm.outlier_rules import op12_outlier_rules

    got = op12_outlier_rules(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id").filter("not base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)


def test_outliers_of_odd_tables(spark):
    from flowfeat.llm.outlier_rules import chi_square, outlier_rules

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(3, 8)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(130)]
    junk = [" ".join(word() + "$$$" for _ in range(60)) for _ in range(20)]
    rows = [(i, t, None, "hot") for i, t in enumerate(clean + junk)] + [(1000, None, None, "hot"), (1001, "", "en", None), (1002, clean[0], "xx", "rare"), (1003, junk[0], "xx", "rare"), (0, clean[0], None, "hot"), (None, clean[1], None, "hot"), (1004, "w " * 100_000, "en", "s")]
    got = [r.asDict() for r in outlier_rules(docs(spark, rows)).collect()]
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["kept"] for i in range(130)) and not any(by[i]["kept"] for i in range(130, 150))
    assert by[1000]["base_failed"] and by[1001]["base_failed"] and by[1004]["base_failed"] and by[1004]["n_repeat_words"] == 100_000
    assert by[1002]["kept"] and by[1003]["kept"] and by[1003]["distance"] is None  # two rows tell nothing
    assert outlier_rules(docs(spark, rows).limit(0)).count() == 0
    assert abs(chi_square(0.95, 4) - 9.487729) < 1e-5 and abs(chi_square(0.5, 2) - 1.386294) < 1e-5


def test_native_on_the_main_path(spark):
    from flowfeat.llm.outlier_rules import op12_outlier_rules

    plan = op12_outlier_rules(spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 13: filter audit


def brute_audit(rows, good, toxic):
    flags = []
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, la, _ in rows:
        t = t or ""
        w = t.encode().split()
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        flags.append((la or "", {k for k, v in bad.items() if v}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in flags}:
        mine = [f[1:] for f in flags if f[0] == part]
        share = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            gone = []
            for k, c in enumerate(order):
                hit = [x for x in left if c in x[0]]
                left = [x for x in left if c not in x[0]]
                out[part, order, k + 1] = [len(left), len(hit), sum(c in x[0] for x in gone), sum(x[0] == {c} for x in mine), sum(x[1] for x in hit), sum(x[2] for x in hit)]
                gone += hit
                share[c] += len(hit)
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, c in enumerate(order):
                out[part, order, k + 1].append(share[c])
    return out


@pytest.mark.parametrize("broadcast", [1 << 25, 0])
def test_audit_of_odd_rows_is_the_plain_one(spark, broadcast):
    from flowfeat.llm import filter_audit as a

    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{rng.integers(400)}" for _ in range(rng.integers(60, 140))) for _ in range(40)]
    rows = [(int(i), t, str(rng.choice(["en", "fr"])), "s") for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 7], None if i % 3 else "en", "s") for i in range(60)]  # copies
    rows += [(200, None, "fr", "s"), (201, "", "fr", "s"), (202, "AB CD", "de", "s"), (203, "x # y", "de", "s"), (0, texts[0], "en", "s"), (None, texts[1], "en", "s"), (None, None, None, None), (300, "W " * 90_000, "en", "s")]
    d = docs(spark, rows)
    filters = a.text_filters(F.col("text"))
    flags = a.filter_flags(d, filters, keep={"part": F.coalesce(F.col("lang"), F.lit(""))}, broadcast=broadcast)
    assert flags.count() == len(rows)
    good, toxic = {1, 101, 202}, {5, 105, 203}
    n, g, t = F.lit(True), F.col("doc_id").isin(list(good)), F.col("doc_id").isin(list(toxic))
    got = a.interaction(a.mask_counts(flags, ["part"], {"n": n, "good": g, "toxic": t}, 5), ["part"], "ABCDE").collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(tuple(r)[3:]) for r in got} == brute_audit(rows, good, toxic)
    assert a.filter_flags(d.limit(0), filters, broadcast=broadcast).count() == 0


def test_sketch_clears_unique_texts_only(spark):
    from flowfeat.llm.filter_audit import possible_repeats

    rows = spark.range(60_000).selectExpr("xxhash64(case when id < 50000 then id else id % 500 end) as h")
    twice = {r["h"] for r in rows.groupBy("h").count().filter("count > 1").collect()}
    by_shard, _ = possible_repeats(rows, 60_000, broadcast=0)
    _, maybe = possible_repeats(rows, 60_000)
    shuffled = {r["h"] for r in by_shard.collect()}
    assert shuffled == {r["h"] for r in rows.filter(maybe("h")).collect()}
    assert twice <= shuffled and len(shuffled) < len(twice) + 50_000 * 0.05


# 6: items that share words


def all_pairs(D, codes, off, p):
    out = set()
    for c in p.classes:
        _, start, end = D.passages(off, c.size, c.step)
        v = D.passage_vectors(codes, start, end, p.terms)
        for k, i in enumerate(c.items.tolist()):
            own, words_of = slice(c.own[k], c.own[k + 1]), np.zeros(len(p.idf), bool)
            words_of[p.words[i]] = True
            weight = np.array([p.idf[x[words_of[x]]].sum() for x in (codes[a:b] for a, b in zip(start, end))])
            hit = ((v @ c.vectors[own].T >= c.limit) & (weight[:, None] >= D.OVERLAP * c.mass[own][None, :])).any(1)
            out |= {(c.size, int(s), i) for s in start[hit]}
    return out


@pytest.mark.parametrize("kind", ["templates", "copies", "apart"])
def test_candidates_do_not_depend_on_the_number_of_items_that_share_words(spark, kind):
    from flowfeat.llm import decontaminate as D

    rng = np.random.default_rng(11)
    vocab = [f"v{i}" for i in range(3000)]
    zipf = np.minimum(rng.zipf(1.3, 20_000) - 1, 2999)
    prose = lambda n: " ".join(vocab[k] for k in rng.choice(zipf, n))
    frame = prose(26).split()
    if kind == "templates":
        bench = [" ".join([*frame[:9], f"slot{i}", *frame[9:18], f"fill{i % 31}", *frame[18:]]) for i in range(1000)]
    else:
        bench = [prose(int(rng.integers(9, 60))) for _ in range(40)] * (50 if kind == "copies" else 1)
    texts = [prose(200) for _ in range(20)]
    for t in bench[:: len(bench) // 20]:
        w = t.split()
        for k in rng.choice(len(w), len(w) // 5, replace=False):
            w[k] = f"other{k}"
        texts.append(prose(50) + " " + " ".join(w) + " " + prose(40))
    vocabulary = np.unique(D.words(bench)[0])
    known = D.statistics(D.coded(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)]), "doc_id", "text", vocabulary), len(vocabulary), 288)
    p = D.probes(list(range(len(bench))), bench, vocabulary, known, 96)
    assert sum(map(len, p.ids)) == len(bench) and len(p.ids) == (40 if kind == "copies" else len(bench))
    h, off = D.words(texts)
    codes = D.to_codes(h, vocabulary, D.low_bits(vocabulary))
    want = all_pairs(D, codes, off, p)
    for listed in (D.LISTED, 50):
        D.LISTED, before = listed, D.LISTED
        try:
            assert {(c.size, int(s), i) for c in p.classes for s, _, i in zip(*D.candidates(codes, off, c, p))} == want
        finally:
            D.LISTED = before
    assert len(want) >= 20


@pytest.mark.parametrize("copies", [1, 4, 5, 8, 20, 50])
def test_changed_items_are_found_under_all_their_ids(spark, copies):
    from flowfeat.llm.decontaminate import contamination

    rng = np.random.default_rng(2)
    bench = [(i, " ".join(f"x{rng.integers(900)}" for _ in range(40)) + ". Done now it is") for i in range(40)]
    w = bench[7][1].split()
    for k in rng.choice(38, 9, replace=False):
        w[k] = f"changed{k}"
    text = " ".join(f"y{rng.integers(900)}" for _ in range(300)) + " " + " ".join(w)
    again = bench + [(1000 + k, bench[7][1]) for k in range(copies - 1)]
    others = [(10 + i, " ".join(f"{'xy'[rng.integers(2)]}{rng.integers(900)}" for _ in range(80)), "en", "s") for i in range(100)]
    got = contamination(docs(spark, [(1, text, "en", "s"), (2, "nothing " * 50, "en", "s"), *others]), spark.createDataFrame(again, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == sorted([(1, 7), *((1, 1000 + k) for k in range(copies - 1))])
