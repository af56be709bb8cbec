"""Tree analytics against a direct Python walk of the same logged tables."""

import math
from collections import defaultdict

import pytest

from rewardforge.operators import tree as TR
from rewardforge.sources import fixtures as FX


@pytest.fixture(scope="module")
def tree(spark, sf):
    nodes = FX.tree_node(spark, sf)
    roll = FX.rollout(spark, sf)
    paths = TR.node_paths(nodes)
    parent = {r.node_id: r.parent_id for r in nodes.collect()}
    bits = {r.node_id: r.bit for r in nodes.collect()}
    rolls = sorted((r.iter, r.leaf_id, r.reward) for r in roll.collect())
    return nodes, roll, paths, parent, bits, rolls


def path_of(parent, n):
    out = []
    while n is not None:
        out.append(n)
        n = parent[n]
    return out[::-1]


def test_paths(tree):
    _, _, paths, parent, _, _ = tree
    got = defaultdict(list)
    for r in paths.ancestors.collect():
        got[r.node_id].append((r.ancestor_depth, r.ancestor_id))
    for n in parent:
        assert [a for _, a in sorted(got[n])] == path_of(parent, n)


def test_backup_and_weights_match_step_rule(tree):
    nodes, roll, paths, parent, bits, rolls = tree
    visits, total = defaultdict(int), defaultdict(float)
    weight = defaultdict(lambda: 1.0)
    for _it, leaf, reward in rolls:
        p = path_of(parent, leaf)
        for n in p:
            visits[n] += 1
            total[n] += reward
        for n in p[1:]:
            if reward > 0:
                weight[n] *= 1.1 if bits[n] == "1" else 0.95
            else:
                weight[n] *= 0.8 if bits[n] == "0" else 0.98
            weight[n] = max(weight[n], 0.1)
    st = {r.node_id: r for r in TR.backup_rewards(nodes, paths, roll).collect()}
    root = [n for n, p in parent.items() if p is None][0]
    assert st[root].visits == len(rolls)
    for n in parent:
        assert st[n].visits == visits[n]
        assert math.isclose(st[n].total_reward, total[n], rel_tol=1e-9, abs_tol=1e-9)
    w = {r.node_id: r.weight for r in TR.node_weights(nodes, paths, roll).collect()}
    for n in parent:
        assert math.isclose(w[n], weight[n], rel_tol=1e-8), (n, w[n], weight[n])
        assert w[n] >= 0.1


def test_best_path_walk(tree):
    nodes, roll, paths, parent, _, _ = tree
    st = {r.node_id: r.visits for r in TR.backup_rewards(nodes, paths, roll).collect()}
    kids = defaultdict(list)
    for n, p in parent.items():
        if p is not None:
            kids[p].append(n)
    cur = [n for n, p in parent.items() if p is None][0]
    walk = []
    while kids[cur]:
        cur = max(sorted(kids[cur]), key=lambda c: st[c])
        walk.append(cur)
    got = [r.node_id for r in sorted(TR.best_path(nodes, paths, TR.backup_rewards(nodes, paths, roll)).collect(), key=lambda r: r.depth)]
    assert got == walk


def test_teacher_weights_match_sequential_filter(spark, sf, tree):
    nodes, roll, _paths, _parent, _bits, rolls = tree
    model_of = {r.node_id: r.model for r in nodes.collect()}
    teachers = sorted(set(model_of.values()))
    n = len(teachers)
    a, eps = TR.TEACHER_ALPHA, TR.TEACHER_EPSILON
    score = {t: 1.0 / n for t in teachers}
    uses = defaultdict(int)
    for _it, leaf, reward in rolls:  # rollout order
        t = model_of[leaf]
        score[t] = (1 - a) * score[t] + a * reward
        uses[t] += 1
    z = sum(math.exp(s) for s in score.values())
    expect = {t: (1 - eps) * math.exp(score[t]) / z + eps / n for t in teachers}
    from pyspark.sql import functions as F

    u = roll.join(nodes.select(F.col("node_id").alias("leaf_id"), "model"), "leaf_id").select("model", "iter", "reward")
    got = {r.model: r for r in TR.teacher_weights(u, nodes.select("model").distinct()).collect()}
    assert set(got) == set(teachers)
    for t in teachers:
        assert got[t].n_uses == uses[t]
        assert math.isclose(got[t].score, score[t], abs_tol=2e-6)
        assert math.isclose(got[t].p, expect[t], abs_tol=2e-6)
    assert math.isclose(sum(r.p for r in got.values()), 1.0, abs_tol=1e-4)


def test_forest_paths_by_doubling(spark):
    rows = [(0, None, "q0", "1"), (100, None, "q1", "0")]
    rows += [(i, i - 1, f"t{i}", str(i % 2)) for i in range(1, 38)]  # a chain under 0
    rows += [(100 + i, 100, f"u{i}", "1") for i in range(1, 4)] + [(900, 901, "lost", "1")]  # a star; a node without a parent row
    out = TR.node_paths(spark.createDataFrame(rows, "node_id long, parent_id long, token string, bit string"))
    info = {r.node_id: r for r in out.nodes.collect()}
    assert 900 not in info and len(info) == 42
    assert info[37].depth == 37 and info[37].query == "q0" and info[37].binary_code == "".join(str(i % 2) for i in range(1, 38))
    assert info[3].context == "q0 t1 t2 t3" and (info[102].query, info[102].context) == ("q1", "q1 u2")
    anc = {(r.node_id, r.ancestor_depth): (r.ancestor_id, r.ancestor_bit) for r in out.ancestors.collect()}
    assert len(anc) == sum(r.depth + 1 for r in info.values())
    assert anc[(37, 0)] == (0, None) and anc[(37, 20)] == (20, "0") and anc[(103, 1)] == (103, "1")


def test_cycle_apart_from_the_root_raises(spark):
    rows = [(0, None, "q", "1"), (1, 2, "a", "1"), (2, 3, "b", "1"), (3, 1, "c", "1")]
    with pytest.raises(ValueError, match="cycle"):
        TR.node_paths(spark.createDataFrame(rows, "node_id long, parent_id long, token string, bit string"))


def test_uniform_start(spark, tree):
    nodes, roll, paths, parent, bits, rolls = tree
    kids = defaultdict(int)
    for p in parent.values():
        kids[p] += 1
    weight = {n: 1.0 if p is None else 1.0 / kids[p] for n, p in parent.items()}
    for _it, leaf, reward in rolls:
        for n in path_of(parent, leaf)[1:]:
            factor = (1.1 if bits[n] == "1" else 0.95) if reward > 0 else (0.8 if bits[n] == "0" else 0.98)
            weight[n] = max(weight[n] * factor, 0.1)
    got = {r.node_id: r.weight for r in TR.node_weights(nodes, paths, roll, init="uniform").collect()}
    assert all(math.isclose(got[n], weight[n], rel_tol=1e-8) for n in parent)


def test_weights_do_not_depend_on_the_blocks(spark, monkeypatch):
    """A node's rollouts are folded block by block; before, a block was always 2^20 rows of one sort."""
    nodes = spark.createDataFrame([(0, None, "q", "0"), (1, 0, "a", "1"), (2, 0, "b", "0"), (3, 1, "c", "0")], "node_id long, parent_id long, token string, bit string")
    rolls = [(i, (3, 2, 1, 3)[i % 4], None if i % 11 == 5 else (-1.0 if (i // 9) % 2 else 0.5)) for i in range(120)]
    paths = TR.node_paths(nodes)
    rollouts = spark.createDataFrame(rolls, "iter long, leaf_id long, reward double")
    want, bits, up = {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}, {1: "1", 2: "0", 3: "0"}, {1: 0, 2: 0, 3: 1}
    for _, leaf, reward in rolls:
        while leaf and reward is not None:
            kind = ("pos_" if reward > 0 else "neg_") + ("right" if bits[leaf] == "1" else "wrong")
            want[leaf] = max(TR.WEIGHT_FLOOR, want[leaf] * TR.WEIGHT_FACTORS[kind])
            leaf = up[leaf]
    for size in (7, 1 << 18):
        monkeypatch.setattr(TR, "BLOCK_ROWS", size)
        got = {r["node_id"]: r["weight"] for r in TR.node_weights(nodes, paths, rollouts).collect()}
        assert got == pytest.approx(want, rel=1e-9)
