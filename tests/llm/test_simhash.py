import random
import time
from itertools import combinations

import numpy as np
import pytest
import xxhash

from meshlark.llm import common, simhash

M64 = (1 << 64) - 1


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(pairs):
    """pairs: (id, fingerprint); smallest id reachable, by comparing all with all."""
    root = list(range(len(pairs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(pairs)), 2):
        if (pairs[a][1] ^ pairs[b][1]).bit_count() <= 3:
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(pairs):
        least.setdefault(find(k), []).append(i)
    return [min((i for i in least[find(k)] if i is not None), default=None) for k in range(len(pairs))]


def test_sets_of_positions():
    assert len(simhash.BLOCKS) == 14
    for gone in combinations(range(8), 3):
        assert sum(not set(gone) & set(b) for b in simhash.BLOCKS) >= 1


def test_fingerprints():
    r = random.Random(1)
    texts = ["", " \n", "one", "one two", "A B C", "É À x", "a b c d", "x y z " * 30_000] + [" ".join(r.choice(["a", "Bc", "déf", "g"]) for _ in range(r.randint(1, 40))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("heavy", [1, 4, 32])
def test_components_against_all_pairs(spark, heavy, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    r = random.Random(heavy)
    fps = []
    for _ in range(12):
        f = r.getrandbits(64)
        for _ in range(r.randint(1, 25)):
            fps.append(f)
            for _ in range(r.randint(0, 3)):
                f ^= 1 << r.randrange(64)
    fps += [r.getrandbits(64) for _ in range(30)] + [0, 0, 1, 7, M64]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    distinct = sorted(set(fps))
    df = spark.createDataFrame([(signed(f),) for f in distinct], "fp long")
    folder = common.shared_folder(spark)
    links = simhash.links(df, folder)
    got = {frozenset((a & M64, b & M64)) for a, b in links.collect()}
    assert got == {frozenset(p) for p in combinations(distinct, 2) if (p[0] ^ p[1]).bit_count() <= 3}
    roots = {n & M64: x for n, x in simhash.components(links, folder).collect()}
    want = brute_components([(signed(f), f) for f in distinct])
    assert all(roots.get(f, signed(f)) == w for f, w in zip(distinct, want))


signed = lambda f: f - (1 << 64) if f >> 63 else f


@pytest.mark.parametrize("dense", [1, 8, 64])
def test_dense_lists_keep_components(spark, dense, monkeypatch):
    monkeypatch.setattr(simhash, "HEAVY", 4)
    monkeypatch.setattr(simhash, "DENSE", dense)
    r = random.Random(dense)
    head = r.getrandbits(64)
    fps = {head ^ (r.getrandbits(10) << 3) for _ in range(150)} | {head ^ sum(1 << r.randrange(64) for _ in range(4)) & M64 for _ in range(60)} | {head ^ (r.getrandbits(24) << 40) for _ in range(300)}
    distinct = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in distinct], "fp long")
    folder = common.shared_folder(spark)
    edges = simhash.links(df, folder)
    assert edges.count() < len(list(combinations(distinct, 2))) / 4
    roots = {n & M64: x for n, x in simhash.components(edges, folder).collect()}
    want = brute_components([(signed(f), f) for f in distinct])
    assert [roots.get(f, signed(f)) for f in distinct] == want


def test_parts_of_codes():
    r = np.random.default_rng(5)
    for n, bits in ((1, 24), (2, 24), (300, 9), (300, 24), (2300, 14), (2400, 24), (4000, 14), (6000, 13)):
        codes = np.unique(r.integers(0, 1 << bits, n))
        got = simhash.parts(codes)
        label = np.arange(len(codes))  # spreads the least position along links, one row of all pairs at a time
        near = [np.flatnonzero(np.bitwise_count(codes ^ c) <= 3) for c in codes]
        while True:
            new = np.array([label[x].min() for x in near])
            if (new == label).all():
                break
            label = new
        assert got.tolist() == label.tolist()


def test_a_cluster_of_20_000_in_one_list(spark):
    r = random.Random(9)
    fps = set()
    while len(fps) < 20_000:
        fps.add(0x123456789A000000 | sum(1 << r.randrange(24) for _ in range(r.choice([2, 4, 6]))) & 0xFFFFFF)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    folder = common.shared_folder(spark)
    began = time.time()
    edges = simhash.links(df, folder)
    n = edges.count()
    assert n < 60 * len(fps) and time.time() - began < 120  # all pairs would be 200 million
    roots = {a: b for a, b in simhash.components(edges, folder).collect()}
    codes = np.array(sorted(fps))
    label = simhash.parts(codes & 0xFFFFFF)
    assert [roots.get(f, f) for f in codes.tolist()] == codes[label].tolist()


def test_each_step_drops_pairs(spark):
    """Candidates of lists by four bytes that share no fifth byte go in the tally, those of more than 3 bits in the check."""
    r = random.Random(2)
    fps = set()
    for _ in range(40):
        f = r.getrandbits(64)
        fps |= {f, f ^ 1 << r.randrange(64), f ^ (r.getrandbits(32) << 32), f ^ (r.getrandbits(24) << 40)}
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    met = simhash.candidates(simhash._postings(df, simhash.BLOCKS))
    kept = simhash.tallied(met, simhash.BLOCKS)
    linked = simhash.verified(kept)
    near = [p for p in combinations(fps, 2) if (p[0] ^ p[1]).bit_count() <= 3]
    assert met.count() > kept.count() > linked.count() == len(near)


def test_table(spark):
    r = random.Random(3)
    base = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(50)) for _ in range(400))
    rows = [(k, base.replace("alpha1", f"v{k}", 1)) for k in range(40)] + [(k, " ".join(str(r.random()) for _ in range(30))) for k in range(40, 60)] + [(70, None), (71, ""), (72, " \t"), (None, base), (None, "alone here now"), (7, base)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = sorted(map(tuple, simhash.fingerprint_components(df).collect()), key=str)
    fps = [(i, brute_fingerprint(t or "")) for i, t in rows]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps))]
    assert got == sorted(want, key=str)
    assert simhash.fingerprint_components(df.limit(0)).count() == 0
    kept = sorted((x["doc_id"] for x in simhash.deduplicated(df).collect() if x["doc_id"] is not None))
    assert kept == sorted({i for i, _, c in want if i is not None and i == c})
