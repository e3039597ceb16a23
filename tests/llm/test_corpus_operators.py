"""Operators over whole tables, each against a brute-force version."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from stipule.llm import common, minhash, mixing, neighbours, packing, repeats, sketch, suffixes
from stipule.llm.components import components

# Near-duplicates -------------------------------------------------------------


def plain_components(rows, width, percent=80):
    """Links of all pairs on sets of strings, joined by their least id."""
    sets = {}
    for i, text in rows:
        w = tuple((text or "").encode().lower().split())
        sets[i] = {w[k : k + width] for k in range(len(w) - width + 1)} if len(w) >= width else {w} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_copies(seed=0, groups=6, size=9):
    """Originals, and copies with some words changed: hubs whose copies are not linked to each other."""
    rng, rows = random.Random(seed), []
    for g in range(groups):
        words = [f"w{rng.randrange(500)}" for _ in range(60 + 20 * g)]
        rows.append(" ".join(words))
        for _ in range(size):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper())
    rng.shuffle(rows)
    return [*enumerate(rows), (1000, ""), (1001, "a b"), (1002, "A  b"), (1003, "a b c")]


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, width, monkeypatch):
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows, width)
    get = lambda: {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=width).collect()}
    assert get() == want and len({c for _, c, _ in want.values()}) < len(rows) - 10
    if width == 4:
        monkeypatch.setattr(minhash, "BLOCK", 2)  # buckets in many blocks
        monkeypatch.setattr(common, "SPREAD", 3)  # keys in many shares
        assert get() == want


def test_one_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "SPREAD", 100)
    base = " ".join(f"w{k}" for k in range(120))
    texts = F.when(F.col("id") % 7 == 0, F.lit(base)).otherwise(F.concat(F.lit(base + " v"), F.col("id").cast("string")))
    df = spark.range(20_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 9, texts).otherwise(F.concat_ws(" ", *[F.concat(F.lit(f"{k}u"), F.col("id").cast("string")) for k in range(9)])).alias("text"))
    got = minhash.near_duplicates(df).groupBy("component_id").count().collect()
    assert {r["count"] for r in got if r.component_id == 0} == {18_000} and len(got) == 2_001


def test_near_duplicates_of_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width=4).collect()}
    assert got == plain_components(rows, 4)


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 13
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (got[6].component_id, got[6].kept, got[10].component_id) == (1, False, 5) and got[7].kept and got[2].kept and got[2].n_shingles == 0
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    kept = minhash.deduplicated(odd)
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert kept.columns == odd.columns and ids == [-1, -1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicated(empty).count() == 0


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for n in (30, 400, 5000):
        base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.5, 0.8, 0.95):
            keep = int(len(base) * 2 * share / (1 + share))
            other = np.unique(np.concatenate([base[rng.permutation(len(base))[:keep]], rng.integers(0, 2**64, len(base) - keep, dtype=np.uint64)]))
            true = len(np.intersect1d(base, other)) / len(np.union1d(base, other))
            a, b = (sketch.registers(x)[None, :] for x in (base, other))
            na, nb = np.array([float(len(base))]), np.array([float(len(other))])
            assert abs(sketch.estimated(a, b, na, nb)[0] - true) < sketch.slack(na, nb, true)[0] + 0.02
            assert minhash.linked(base, other, 80) == (true >= 0.8)
    assert sketch.expected_matches(np.array([5000.0]), np.array([5000.0]))[0] < 0.002


def test_registers_hold_zeros_and_mantissa():
    shingles = np.unique(np.random.default_rng(3).integers(0, 2**64, 3000, dtype=np.uint64))
    got = sketch.registers(shingles)
    best = {}
    for h in shingles:
        bucket = (int(h) >> 32) * sketch.REGISTERS >> 32
        value = int(sketch.mixed(np.array([h ^ sketch.MIX[1]]))[0])
        best[bucket] = min(value, best.get(bucket, value))
    for bucket, value in best.items():
        bits = f"{value:064b}"[:52]
        zeros = len(bits) - len(bits.lstrip("0"))
        assert got[bucket] >> 10 == zeros and got[bucket] & 1023 == int((bits[zeros + 1 :] + "0" * 10)[:10], 2)


def test_components(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    monkeypatch.setattr(common, "SPREAD", 4)
    got = {r.v: r.c for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# Repeated passages ----------------------------------------------------------


def plain_removals(rows):
    """Every 50-byte string of every text, in order of id."""
    first, out = {}, {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        hit = bytearray(len(data))
        for p in range(len(data) - 49):
            if first.setdefault(data[p : p + 50], i) < i:
                hit[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, h in zip(data, hit, strict=True) if not h)
        out[i] = (len(data), sum(hit), len([x for x in bytes(hit).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed=0):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = [(i, text(rng.randrange(0, 80)) + "".join(rng.choice(shared) + text(rng.randrange(0, 30)) for _ in range(rng.randrange(0, 4)))) for i in range(40)]
    return [*rows, (50, "a" * 500), (51, "a" * 300), (52, "b" * 49), (53, "b" * 49), (54, rows[3][1]), (55, None), (56, shared[4] * 3)]


@pytest.mark.parametrize(("heavy", "kinds"), [(500, 500), (3, 500), (3, 3), (1, 1)])
def test_repeats(spark, heavy, kinds, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    monkeypatch.setattr(repeats, "KINDS", kinds)
    monkeypatch.setattr(repeats, "CHUNK_ROWS", 40)
    monkeypatch.setattr(common, "SPREAD", 500 if heavy == 500 else 2)
    rows = passages()
    got = {r.doc_id: tuple(r)[1:] for r in repeats.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_removals(rows)
    assert got == want and sum(w[1] for w in want.values()) > 2000


def test_repeats_of_documents(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in repeats.repeats(docs).collect()} == plain_removals(rows)


def test_repeats_of_odd_rows(odd, empty):
    rows = repeats.repeats(odd).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 13 and got[10].n_removed == got[10].n_bytes and got[10].n_spans == 1 and got[6].n_removed == got[6].n_bytes and got[5].n_removed == got[7].n_removed == 0
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None) and got[2].kept_sha256 == hashlib.sha256(b"").hexdigest() and repeats.repeats(empty).count() == 0


def test_suffix_order_and_factors():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(120)) + "the same fifty bytes are found in several of these texts here" for _ in range(6)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    start = np.concatenate([np.arange(len(t) - 49) + sum(len(x) for x in texts[:k]) for k, t in enumerate(texts)])
    owner = np.concatenate([np.full(len(t) - 49, k) for k, t in enumerate(texts)])
    words = suffixes.window_words(data, start)
    windows = [bytes(data[s : s + 50]) for s in start]
    order = suffixes.suffix_order(words, owner)
    assert [(windows[i], owner[i]) for i in order] == sorted(zip(windows, owner, strict=True))
    prefix = suffixes.common_prefix(words, order)
    for k in range(1, len(order)):
        a, b = windows[order[k - 1]], windows[order[k]]
        assert prefix[k] == next((n for n in range(50) if a[n] != b[n]), 50)
    least = {}
    for w, o in zip(windows, owner, strict=True):
        least[w] = min(o, least.get(w, o))
    assert suffixes.repeated(words, owner).tolist() == [least[w] < o for w, o in zip(windows, owner, strict=True)]
    values = np.array([rng.randrange(9) for _ in range(300)])
    assert suffixes.previous_smaller(values).tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(300)]


def test_runs_cover_windows_and_depend_on_them_alone():
    rng = random.Random(6)
    text = bytes(rng.randrange(97, 101) for _ in range(3000))
    found = suffixes.runs(text)
    assert found.start[0] == 0 and found.end[-1] == len(text) - 49 and (found.start[1:] == found.end[:-1]).all()
    anchor = np.repeat(found.anchor, found.end - found.start)
    for p in (0, 17, 999, 2950):
        assert suffixes.runs(text[p : p + 50]).anchor[0] == anchor[p]
    assert len(suffixes.runs(text[:49]).start) == 0 and suffixes.merged([(5, 9), (1, 3), (3, 4), (8, 12)]) == [(1, 4), (5, 12)]


# Nearest neighbours ------------------------------------------------------------


def vector_rows(n=900, wide=24, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, wide)) * rng.uniform(0.5, 2, (n, 1))
    x[::9] = x[4]  # a very common vector
    return x.astype(np.float32)


@pytest.mark.parametrize("chunk", [16_384, 5])
def test_neighbours(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 64)
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "AT_ONCE", 40)
    if chunk == 5:
        monkeypatch.setattr(neighbours, "MAX_CELLS", 2)  # so cells are searched in parts
    x = vector_rows()
    df = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in enumerate(x)], "vec_id long, embedding array<float>, id string")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    wide, hits = x.astype(float), 0
    for q in range(0, len(x), 20):
        score = wide @ wide[q]
        best = [i for i in np.lexsort((np.arange(len(x)), -score)) if i != q][:20]
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(abs(s - score[i]) < 1e-9 for i, s in got[q])
        hits += len({i for i, _ in got[q]} & set(best))
    assert hits / (20 * len(got)) >= 0.95 and got.keys() == set(range(0, 900, 20))


def test_neighbours_of_repeated_rows(spark):
    x = vector_rows(100)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    get = lambda r: sorted(tuple(t) for t in neighbours.nearest(spark.createDataFrame(r, "vec_id long, embedding array<float>").repartition(7), F.col("id") % 20 == 0).collect())
    want = get(rows)
    assert get([*rows, rows[0], rows[0], rows[33], rows[40]]) == want and len(want) == 100
    # Of different vectors of one id, one counts, wherever the rows are.
    other = [*rows, (0, x[50].tolist()), (7, x[60].tolist())]
    assert get(other) == get(other[::-1]) and len(get(other)) == 100


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, []), (7, [1.0, 1.0, 1.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (40, [float("inf"), 0.0]), (60, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in neighbours.nearest(df, F.col("id") % 20 == 0).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, 2.0), (0, 3, 60, 0.0), (20, 1, 1, 4.0), (20, 2, 0, 2.0), (20, 3, 60, 0.0), (60, 1, 0, 0.0), (60, 2, 1, 0.0), (60, 3, 20, 0.0)]
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_kd_trees_and_quantiles():
    points = np.random.default_rng(8).normal(size=(500, 4))
    nodes, n = neighbours.kd_tree(points, 40)
    leaf = neighbours.leaf_of(nodes, points)
    assert n == leaf.max() + 1 and np.bincount(leaf).max() <= 40 and neighbours.leaf_of([], points).max() == 0
    assert neighbours.kd_tree(np.ones((50, 3)), 10) == ([], 1)
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.507) < 0.01 and abs(neighbours.chi_square_quantile(0.5, 2) - 1.386) < 0.01


# Mixing ------------------------------------------------------------------------


def plain_share(budget, wanted):
    """Whole-number water filling by tiny steps, for comparison."""
    given = [0.0] * len(wanted)
    for _ in range(20_000):
        live = [k for k, (w, c) in enumerate(wanted) if w > 0 and given[k] < c - 1e-9]
        total = sum(wanted[k][0] for k in live)
        if not live:
            break
        for k in live:
            given[k] = min(wanted[k][1], given[k] + budget / 20_000 * wanted[k][0] / total)
    return given


def test_shares():
    from fractions import Fraction as Fr

    for wanted in ([(1, 10), (1, 100), (2, 100)], [(1, 5), (5, 5), (1, 5)], [(0, 9), (3, 2), (1, 100)]):
        got = mixing.share_out(Fr(60), [(Fr(w), Fr(c)) for w, c in wanted])
        assert all(abs(float(g) - p) < 0.5 for g, p in zip(got, plain_share(60, wanted), strict=True))
        assert sum(got) == min(60, sum(c for w, c in wanted if w))


def test_shortages_go_to_siblings_first():
    supply = {("a", "en", "x"): 10, ("a", "en", "y"): 1000, ("b", "en", "z"): 1000}
    got = {x.path: x.budget for x in mixing.budgets(supply, 600, {}, max_epochs=1)}
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 290, ("b", "en", "z"): 300}
    got = {x.path: x.budget for x in mixing.budgets({**supply, ("a", "en", "y"): 50}, 600, {}, max_epochs=1)}
    assert got == {("a", "en", "x"): 10, ("a", "en", "y"): 50, ("b", "en", "z"): 540} and mixing.budgets({}, 5, {}) == []


def test_what_weighs_nothing_gets_nothing_and_others_get_its_share():
    supply = {("a", "en", "x"): 1000, ("a", "en", "y"): 100, ("b", "en", "z"): 1000}
    got = {x.path: x.budget for x in mixing.budgets(supply, 600, {("a", "en", "x"): 0}, max_epochs=1)}
    assert got == {("a", "en", "x"): 0, ("a", "en", "y"): 100, ("b", "en", "z"): 500}
    got = {x.path: x.budget for x in mixing.budgets(supply, 600, {("a",): 0}, max_epochs=1)}
    assert got == {("a", "en", "x"): 0, ("a", "en", "y"): 0, ("b", "en", "z"): 600}


def test_mixture_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mixed(docs, share=0.9)
    got = Counter((r.domain, r.lang, r.source, r.id, r.epoch) for r in out.select("domain", "lang", "source", F.col("row.doc_id").alias("id"), "epoch").collect())
    assert max(got.values()) == 1
    told = docs.select("doc_id", mixing.domain_of().alias("d"), "lang", "source", mixing.words().alias("n"), *[F.xxhash64(F.lit(mixing.SEED), F.lit(e), "doc_id").alias(f"h{e}") for e in range(3)]).collect()
    leaves = defaultdict(list)
    for r in told:
        leaves[r.d, r.lang, r.source].append(r)
    supply = {k: sum(r.n for r in v) for k, v in leaves.items()}
    want, budget = set(), {x.path: x.budget for x in mixing.budgets(supply, int(0.9 * sum(supply.values())), mixing.WEIGHTS)}
    for k, rows in leaves.items():
        full, rest = divmod(budget[k], supply[k])
        want |= {(*k, r.doc_id, e) for r in rows for e in range(full)}
        run = 0
        for r in sorted(rows, key=lambda r: (r[f"h{full}"] % 2**64 >> 40, r[f"h{full}"], r.doc_id)):
            run += r.n
            if run > rest or not rest:
                break
            want.add((*k, r.doc_id, full))
    assert set(got) == want and {e for *_, e in want} == {0, 1}


def test_mixture_of_odd_rows(odd, empty):
    out = mixing.mixed(odd)
    assert out.select("row.*").columns == odd.columns and 0 < out.count() <= 26 and out.where("lang is null or source is null").count() == 0
    assert mixing.mixed(empty).count() == 0 and mixing.mixed(odd.where("doc_id in (2, 3)")).count() == 0


# Packing -----------------------------------------------------------------------


def test_bucket_lengths_are_optimal():
    rng = random.Random(9)
    for _ in range(25):
        counts = {n: rng.randrange(1, 20) for n in rng.sample(range(1, 40), rng.randrange(1, 9))}
        padding = lambda tops: sum(c * (min(t for t in tops if t >= n) - n) for n, c in counts.items())
        for k in (1, 2, 3):
            best = min(padding((*some, max(counts))) for size in range(k) for some in itertools.combinations(sorted(counts), size))
            got = packing.bucket_lengths(counts, k)
            assert len(got) <= k and got == sorted(got) and padding(got) == best
    assert packing.bucket_lengths({}) == [] and packing.bucket_lengths({0: 4}) == []


def check_packing(rows, texts, max_len, budget):
    length = {i: len((t or "").encode().split()) for i, t in texts}
    seen = defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
    assert {i: sum(r.n_tokens for r in v) for i, v in seen.items()} == length
    full = defaultdict(list)
    for r in rows:
        assert (r.bucket is None) == (r.n_tokens == 0) and r.n_tokens <= max_len
        if r.bucket is not None:
            assert r.n_tokens <= r.bucket_len
            full[r.bucket, r.batch].append(r)
    last = {b: max(n for x, n in full if x == b) for b, _ in full}
    for (b, n), held in full.items():
        size = max(1, budget // held[0].bucket_len)
        assert sorted(r.slot for r in held) == list(range(len(held))) and (len(held) == size or n == last[b] and len(held) < size)


def test_packing_of_documents(docs):
    rows = packing.packed(docs, max_len=200, buckets=4, token_budget=900).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 200, 900)
    assert len({r.bucket_len for r in rows if r.bucket is not None}) == 4


def test_packing_of_equal_rows(spark):
    rows = [(None, "a b c")] * 200 + [(7, "d e")] * 50 + [(7, "f g h")] * 3 + [(k, "one two three four") for k in range(10, 60)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), buckets=2, token_budget=12).collect()
    places = [(r.bucket, r.batch, r.slot) for r in got]
    assert len(got) == len(rows) and len(set(places)) == len(places) and Counter((r.doc_id, r.n_tokens) for r in got) == Counter((i, len(t.split())) for i, t in rows)


def test_packing_of_odd_rows(odd, empty):
    rows = packing.packed(odd.where("doc_id is null or doc_id <> 7"), max_len=1000).collect()
    assert len([r for r in rows if r.doc_id == 5]) == 41 and len([r for r in rows if r.bucket is None]) == 4 and packing.packed(empty).count() == 0
    assert packing.packed(odd).where("doc_id = 7").count() == 2
