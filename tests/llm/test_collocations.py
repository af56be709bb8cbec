"""Collocations against a brute-force count, with and without hashed symbols."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rewardforge.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(docs, least, top=2000, most=5):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                part = (lang, words[i : i + k])
                inside[part] = max(inside[part], a)
    out = []
    for lang in n:
        rows = []
        for (of, words), a in found.items():
            if of == lang and inside[of, words] < a:
                cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed, n=150):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(12)], [f"r{i}é" for i in range(200)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(60)):
            words += rng.choice([["New", "york", "CITY", "hall"], ["in", "order", "to"], [rng.choice(common)], [rng.choice(rare)]])
        out.append((rng.choice(["de", "en", None]), rng.choice([" ", "\t", "  "]).join(w + rng.choice(["", "", "", ".", " ,", "\n"]) for w in words)))
    return out


def same(df, want):
    assert sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect()) == want


@pytest.mark.parametrize("heads", [{}, {"head_words": 6, "head_phrases": 5}, {"head_words": 0, "head_phrases": 0}])
def test_equals_brute_force(spark, heads):
    docs = texts(1)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(4)
    want = brute(docs, 8)
    assert {len(r[2].split(" ")) for r in want} >= {2, 3, 4}
    same(collocations.collocations(df, min_count=8, **heads), want)


def test_top_and_ties(spark):
    docs = [("x", "a b. c d. a b. c d. e f"), ("x", "a b. c d")]
    df = spark.createDataFrame(docs, "lang string, text string")
    same(collocations.collocations(df, min_count=2, top=1), brute(docs, 2, 1))


def test_odd_rows(spark, odd, none):
    docs = [(r["lang"], r["text"]) for r in odd.collect()]
    same(collocations.collocations(odd, min_count=2), brute(docs, 2))
    assert collocations.collocations(none).collect() == []
    assert collocations.collocations(odd, min_count=10**6).collect() == []


def test_scores_beyond_64_bits(spark):
    docs = [("x", "p q " * 30000)] * 3
    df = spark.createDataFrame([(*d, *"1234") for d in docs], "lang string, text string, n string, f string, a string, sym string")
    same(collocations.collocations(df, min_count=100), brute(docs, 100))


def test_dense_tiles_equal_sparse_lists():
    rng = np.random.default_rng(3)
    a, b = (np.where(rng.random(200_000) < 0.1, -1, rng.zipf(1.3, 200_000) % 5000) for _ in range(2))
    counter = collocations._Counter()
    frames = [*counter.add(a, b)]
    assert counter.dense
    frames += counter.close()
    got = Counter()
    for frame in frames:
        for x, y, c in frame.itertuples(index=False):
            got[x, y] += c
    assert got == Counter((x, y) for x, y in zip(a.tolist(), b.tolist()) if x >= 0 and y >= 0)


def test_words_of_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 10)
    text = "Aa bb\tcc.dd! ee\n\nff gg hh ii jj kk ll mm; nn"
    words = [w for part in collocations.word_lists(text) for w in part]
    assert words == [w.encode() for w in re.findall("[^ ]+", re.sub(r"[.!;\n]", " \n ", text.lower().replace("\t", " ")))]
