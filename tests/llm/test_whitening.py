"""Embedding whitening against exact integers and a dense eigensolver."""

import math

import numpy as np

from rewardforge.llm import whitening

SF = "/root/testdata/sf0.01"


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, vec string, n string, component string")


def rows_of(vectors, first=0):
    return [(first + i, None if v is None else [None if c is None else float(c) for c in v], "x", "y", "z") for i, v in enumerate(vectors)]


def test_equals_dense_eigenvectors_and_exact_deviations(spark):
    raw = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    out = whitening.whiten(raw.repartition(5)).toPandas().sort_values(["vec_id", "component"])
    own = raw.toPandas().sort_values("vec_id")
    x = np.floor(np.stack(own["embedding"]).astype(float) * 64) + 1_000_000
    n = len(x)
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (x - x.mean(axis=0)) @ axes[:, :32] / np.sqrt(values[:32])
    got = out["whitened"].to_numpy().reshape(n, 32)
    assert np.abs(got - want * np.sign((want * got).sum(axis=0))).max() < 1e-9
    assert np.allclose(out["explained"][:32], values[:32] / values.sum(), rtol=1e-9)
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9
    exact = [sum((n * int(c) - int(s)) ** 2 for c, s in zip(r, x.sum(axis=0))) for r in x]
    assert out["deviation"].to_numpy().reshape(n, 32)[:, 0].tolist() == exact and set(out["n"]) == {n}


def test_odd_vectors(spark):
    good = [[1.5, 0.0, -2.0], [0.25, 1.0, 3.0], [-1.0, 2.0, 0.5], [4.0, -3.0, 1.0]]
    bad = [None, [], [1.0, None, 2.0], [math.nan, 1.0, 1.0], [1.0, math.inf, 1.0], [1.0, 2.0], [1e30, 0.0, 0.0]]
    rows = [*rows_of(good), *rows_of(bad, 10), (None, good[0], "x", "y", "z"), (0, good[0], "x", "y", "z")]
    out = whitening.whiten(table(spark, rows).repartition(3)).collect()
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"]) for r in out) == sorted((i, c) for i in (-1, 0, 0, 1, 2, 3) for c in (1, 2, 3))
    assert {r["n"] for r in out} == {6} and out[0]["identity_error"] < 1e-9
    alike = {r["whitened"] for r in out if r["vec_id"] in (0, None) and r["component"] == 1}
    assert len(alike) == 1


def test_tables_without_variance_give_no_rows(spark):
    for rows in ([], rows_of([None, []]), rows_of([[1.0, 2.0]]), rows_of([[1.0, 2.0]] * 5)):
        assert whitening.whiten(table(spark, rows)).collect() == []
    line = whitening.whiten(table(spark, rows_of([[float(i), 2.0 * i, 0.0] for i in range(6)]))).collect()
    assert {r["component"] for r in line} == {1} and abs(line[0]["explained"] - 1) < 1e-12


def test_sums_beyond_a_long_stay_exact(spark):
    out = whitening.whiten(table(spark, rows_of([[2.0**50, 1.0], [-(2.0**50), 2.0], [0.0, 5.0]]))).collect()
    assert {r["deviation"] for r in out if r["vec_id"] < 2} == {None}
    assert {r["deviation"] for r in out if r["vec_id"] == 2} == {(3 * 5 * 64 - 8 * 64) ** 2}
    product = whitening._product(np.array([[1 << 40, 3], [5, 1 << 41]]))
    assert product.tolist() == [[(1 << 80) + 25, (3 << 40) + (5 << 41)], [(3 << 40) + (5 << 41), 9 + (1 << 82)]]
