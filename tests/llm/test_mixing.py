"""The mix against a plain version of it: targets by water-filling are tested elsewhere, here they are given."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rewardforge.llm import mixing

BLOCK, SHARDS = 16, 5


def test_draw_meets_totals_and_varies():
    slots = np.array([700, 0, 50, 3, 1])
    counts = mixing.draw_counts(slots, 8, 7)
    assert counts.sum(axis=0).tolist() == slots.tolist() and set(counts.sum(axis=1)) <= {94, 95}
    assert (counts == mixing.draw_counts(slots, 8, 7)).all() and (counts != mixing.draw_counts(slots, 8, 8)).any()
    assert len(set(counts[:, 2])) > 1  # a draw, not an even deal
    assert mixing.draw_counts(np.array([0, 0]), 3, 1).sum() == 0


def plain_mix(rows, targets, hashes, seed=7):
    """(shard, slot) -> list of (doc, word) by walking every source slot by slot."""
    streams = {}
    for doc_id, text, source in rows:
        streams.setdefault(source, []).extend((doc_id, k) for k in range(len(text.split())))
    orders = {}
    for source in sorted(targets, key=lambda s: "n" if s is None else "s" + s):
        words = streams[source]
        if not words:
            continue
        blocks = [words[i : i + BLOCK] for i in range(0, len(words), BLOCK)]
        left, epoch, out = round(targets[source]), 0, []
        while left:
            at = mixing.permuted(np.arange(len(blocks)), len(blocks), (hashes[source] ^ seed) % (1 << 63) + epoch)
            for b in sorted(range(len(blocks)), key=lambda i: at[i]):
                take = blocks[b][:left]
                left -= len(take)
                if take:
                    out.append(take)
            epoch += 1
        orders[source] = out
    counts = mixing.draw_counts(np.array([len(o) for o in orders.values()]), SHARDS, seed)
    mix, used = {}, Counter()
    for shard in range(SHARDS):
        row = [b for (s, o), n in zip(orders.items(), counts[shard]) for b in o[used[s] : used[s] + n]]
        used.update({s: n for s, n in zip(orders, counts[shard])})
        for place, b in zip(mixing.permuted(np.arange(len(row)), len(row), seed + shard), row):
            mix[shard, int(place)] = b
    return mix


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(11)
    names = ["a", "b", "c", "d", None]
    rows = []
    for i in range(120):
        words = [f"w{i}_{k}" for k in range(rng.choice([0, 1, 3, 20, 90]))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(words), rng.choices(names, [1, 2, 9, 30, 3])[0]))
    rows.append((120, " ".join(f"w120_{k}" for k in range(3000)), "d"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    per_doc = {r["doc_id"]: r for r in mixing.mix_documents(docs, block=BLOCK, shards=SHARDS).collect()}
    segments = mixing.mix_segments(docs, block=BLOCK, shards=SHARDS).collect()
    keys = spark.createDataFrame([("n" if s is None else "s" + s,) for s in names], "key string").selectExpr("key", "xxhash64(key) AS h").collect()
    hashes = {None if r["key"] == "n" else r["key"][1:]: r["h"] for r in keys}
    return rows, per_doc, segments, hashes


def test_mix_equals_plain_mix(mixed):
    rows, per_doc, segments, hashes = mixed
    targets = {s: next(per_doc[i]["target"] for i, _, t in rows if t == s) for _, _, s in rows}
    want = plain_mix(rows, targets, hashes)
    got = {}
    for r in sorted(segments, key=lambda r: (r["shard"], r["slot"], r["at"])):
        words = r["text"].split()
        assert len(words) == r["n_words"]
        got.setdefault((r["shard"], r["slot"]), []).extend((int(a), int(b)) for a, b in (re.fullmatch(r"w(\d+)_(\d+)", w).groups() for w in words))
    assert got == want
    taken = Counter(doc for b in want.values() for doc, _ in b)
    holding = Counter(doc for b in want.values() for doc in {d for d, _ in b})
    for i, text, _ in rows:
        r = per_doc[i]
        first = min((at for at, b in want.items() if any(d == i for d, _ in b)), default=(None, None))
        assert (r["taken"], r["n_slots"], (r["first_shard"], r["first_slot"])) == (taken[i], holding[i], first)
        assert r["taken"] <= 3 * len(text.split())


def test_slots_are_gapless_and_shards_even(mixed):
    _, _, segments, _ = mixed
    slots = {}
    for r in segments:
        slots.setdefault(r["shard"], set()).add(r["slot"])
    assert sorted(slots) == list(range(SHARDS))
    assert all(s == set(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_odd_rows(odd, none):
    assert mixing.mix_segments(none).count() == 0
    whole = mixing.mix_documents(odd).agg({"taken": "sum"}).first()[0]
    assert mixing.mix_segments(odd).agg({"n_words": "sum"}).first()[0] == whole
