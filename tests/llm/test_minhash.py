"""MinHash near-dedup against brute force over all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from rewardforge.llm import minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(texts):
    """[(n_shingles, component)] by place in the list."""
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def families(seed):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "one", "One", "one two three", "one two three four", "one two three four five"]
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 300]))]
        for _ in range(rng.randrange(1, 14)):
            words = list(base)
            for _ in range(rng.randrange(0, max(2, len(words) // 16))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(words))
    out += ["a b c d e f g", "A B  C D E F G"]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    texts = families(seed)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, node string, n string").repartition(3)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(df).collect()}
    want = brute(texts)
    assert len({c for _, c in want}) < len(texts) - 20
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)


def test_a_large_family_takes_several_rounds(spark, monkeypatch):
    """Copies far from the first one, in blocks smaller than the family."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "NEAREST", 1)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(40):  # a chain: neighbours link, ends share little
        words = list(base)
        words[: 4 * i] = [f"v{j}" for j in range(4 * i)]
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert [(got[i]) for i in range(40)] == [c for _, c in brute(texts)]


def test_odd_rows(spark, odd, none):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == 15 and minhash.near_duplicates(none).collect() == []
    empty = [r for r in rows if r["n_shingles"] == 0]
    assert len(empty) == 4 and all(r["kept"] and r["component_id"] == r["doc_id"] for r in empty)
    alpha = [r for r in rows if r["n_shingles"] == 3 and r["component_id"] == 1]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in alpha) == [(False, 1), (False, 2), (True, 0)]
    assert sum(r["kept"] for r in alpha) == 1
    twice = [r for r in rows if r["doc_id"] == 9]
    assert len(twice) == 2 and sum(r["kept"] for r in twice) <= 1
    assert next(r["n_shingles"] for r in rows if r["doc_id"] == 11) == 1


def test_signatures_within_the_bound_share_a_key(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        a = rng.integers(0, 1 << 16, minhash.SYMBOLS, dtype=np.uint16)
        b = a.copy()
        b[rng.choice(minhash.SYMBOLS, minhash.MAX_ERRORS, replace=False)] ^= np.uint16(1)
        rows += [(2 * i, a.astype(">u2").tobytes()), (2 * i + 1, b.astype(">u2").tobytes())]
    keys = minhash.chunk_keys(spark.createDataFrame(rows, "node long, signature binary"))
    nodes = {}
    for r in keys.collect():
        nodes.setdefault(r["key"], set()).add(r["node"])
    met = {n for group in nodes.values() if len(group) > 1 for n in group}
    assert len(met) == 120 and all(len({n // 2 for n in group}) == 1 for group in nodes.values())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(7)
    unlike = []
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        a, b = np.sort(pool[:54]), np.sort(pool[6:])  # 48 of 60: similarity 0.8
        sa, sb = minhash._signatures([a, b])
        unlike.append((sa != sb).sum())
    assert abs(np.mean(unlike) / minhash.SYMBOLS - 0.2) < 0.02


def test_hot_family_and_repeated_texts(spark):
    base = [f"w{i}" for i in range(150)]
    rng = random.Random(3)
    texts = [" ".join(base)] * 60
    for i in range(60):
        words = list(base)
        words[rng.randrange(150)] = f"x{i}"
        texts.append(" ".join(words))
    texts += [f"single text number {i} with its own words {i * 7} {i * 11}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(texts))] == [c for _, c in brute(texts)]


def test_bitmaps_rule_out_no_link():
    rng = np.random.default_rng(9)
    for n in (1, 5, 40, 130, 2000, 20000):
        pool = np.sort(rng.integers(0, 1 << 63, n + max(1, n // 3), dtype=np.uint64))
        sets = [np.unique(rng.choice(pool, n, replace=False)) for _ in range(12)] + [pool, pool[: n // 2 + 1]]
        maps = minhash._by_size(pa.array([minhash.bitmap(s) for s in sets], pa.binary()))
        n_of = np.array([len(s) for s in sets])
        i, j, unlike = minhash._possible(maps, maps, n_of, n_of, 80, 100)
        near = set(zip(i.tolist(), j.tolist()))
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                assert (a, b) in near or 100 * both < 80 * (len(x) + len(y) - both)
        assert n > minhash.MAP_BITS // minhash.MAP_LOAD or all(u <= (len(sets[a]) + len(sets[b])) / 9 for a, b, u in zip(i, j, unlike))
