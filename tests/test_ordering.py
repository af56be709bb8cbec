"""Order-dependent primitives against brute force."""

import random

import pandas as pd
import pytest

from rewardforge.operators.ordering import blocked_prefix, ordered_index


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(7)
    # group "hot" holds most rows, as a skewed key would
    rows = [(("hot" if rnd.random() < 0.7 else f"g{rnd.randint(0, 4)}"), i, rnd.randint(-5, 5)) for i in range(3000)]
    rnd.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k long, v long")


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_ordered_index_equals_row_number(spark, data, parts):
    rows, df = data
    got = {(r.g, r.k): r.idx for r in ordered_index(df, ["k"], ["g"], "idx", num_partitions=parts).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "k", "v"]).sort_values(["g", "k"])
    pdf["idx"] = pdf.groupby("g").cumcount()
    assert got == {(g, k): i for g, k, i in zip(pdf.g, pdf.k, pdf.idx)}


@pytest.mark.parametrize("inclusive", [True, False])
def test_blocked_prefix_equals_cumulative(spark, data, inclusive):
    rows, df = data
    out = blocked_prefix(df, ["k"], ["g"], {"s": ("v", "sum"), "m": ("v", "max")}, inclusive=inclusive, block_rows=17)
    got = {(r.g, r.k): (r.s, r.m) for r in out.collect()}
    pdf = pd.DataFrame(rows, columns=["g", "k", "v"]).sort_values(["g", "k"])
    s = pdf.groupby("g").v.cumsum()
    m = pdf.groupby("g").v.cummax()
    if not inclusive:
        s = s - pdf.v
        m = pdf.groupby("g").v.transform(lambda x: x.cummax().shift(1))
    for (g, k), si, mi in zip(zip(pdf.g, pdf.k), s, m):
        gs, gm = got[(g, k)]
        first = pdf[(pdf.g == g)].k.min() == k
        if not inclusive and first:
            assert gs is None and gm is None
        else:
            assert gs == si and gm == mi
