"""Reward formulas and preference-pair properties."""

import math

from pyspark.sql import functions as F

from rewardforge.operators import pairs as D
from rewardforge.operators import rewards as R
from rewardforge.plans.queries import queries


def test_reward_formulas(spark):
    df = spark.createDataFrame(
        [(5.0, "one two three", True), (None, "x", True), (float("nan"), "x", False), (0.0, " ".join(["w"] * 80), True)],
        "ppl double, t string, right boolean",
    )
    rows = df.select(
        R.reward_log(F.col("ppl"), F.col("t"), F.col("right")).alias("a4"),
        R.reward_linear(F.col("ppl"), F.col("t"), F.col("right")).alias("a5"),
    ).collect()
    exp_a4 = min(1.0, max(0.0, 1 / (1 + math.log1p(5.0)) + 0.03 + 0.1))
    exp_a5 = min(1.0, max(0.0, 1 / (1 + 5.0 / 100) + 3 / 50 + 0.1))
    assert abs(rows[0].a4 - exp_a4) < 1e-6 and abs(rows[0].a5 - exp_a5) < 1e-6
    assert rows[1].a4 == 0.1 and rows[2].a4 == 0.1 and rows[1].a5 == 0.1  # error fallback
    assert rows[3].a4 == 1.0  # clipped


def test_relative_and_vs_gold(spark):
    df = spark.createDataFrame([(10.0, 5.0, 1.0), (5.0, 10.0, 0.0), (None, 1.0, 0.0)], "b double, t double, h double")
    r = df.select(R.reward_relative(F.col("b"), F.col("t"), F.col("h")).alias("r"), R.reward_vs_gold(F.col("b"), F.col("t")).alias("g")).collect()
    assert abs(r[0].r - 0.6) < 1e-6 and r[1].r == 0.0 and r[2].r == 0.1
    assert abs(r[1].g - (-1.0)) < 1e-6  # not clipped


def test_pairs_ranked_properties(spark, sf):
    p = queries()["pairs_ranked"](spark, sf)
    assert p.where(F.col("chosen_reward") < F.col("rejected_reward")).count() == 0
    rewards = {(r.chosen_reward, r.rejected_reward) for r in p.select("chosen_reward", "rejected_reward").distinct().collect()}
    assert rewards <= {(1.0, 0.0), (1.0, 1.0), (0.0, 0.0), (0.0, 1.0)} - {(0.0, 1.0)}


def test_tie_rules(spark):
    df = spark.createDataFrame(
        [(1, 0, 0.5, "aa", True), (1, 1, 0.9, "b", True), (1, 2, 0.9, "cccc", True), (1, 3, 0.1, "dd", True),
         (2, 0, 0.3, "x", True), (2, 1, 0.3, "y", False)],
        "g long, i int, r double, t string, ok boolean",
    )
    bw = {x.g: x for x in D.pairs_best_worst(df, "g", "i", "r").collect()}
    assert (bw[1].chosen_idx, bw[1].rejected_idx) == (1, 3) and 2 not in bw
    bl = {x.g: x for x in D.pairs_by_length(df, "g", "i", "t", "ok").collect()}
    assert (bl[1].chosen_idx, bl[1].rejected_idx) == (1, 2) and 2 not in bl
    sc = {x.g: x for x in D.shortest_correct(df, "g", "i", "t", "ok").collect()}
    assert sc[1].i == 1 and sc[2].i == 0


def test_group_advantage_sums_to_zero(spark, sf):
    a = queries()["group_advantage"](spark, sf)
    worst = a.groupBy("qa_id").agg(F.abs(F.sum("advantage")).alias("s")).agg(F.max("s")).first()[0]
    assert worst < 1e-6


def test_difficulty_buckets_balanced(spark, sf):
    d = queries()["difficulty_balance"](spark, sf)
    counts = [r["count"] for r in d.groupBy("bucket").count().collect()]
    assert len(set(counts)) <= 1
