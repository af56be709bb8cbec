"""Metric-log operators on the published run (golden case) and small logs."""

from pyspark.sql import functions as F

from rewardforge.operators import evalstats as E

from golden_report import RECOMMENDATION, ROWS, SUMMARY


def golden(spark):
    return spark.createDataFrame(ROWS, "reward_type string, step long, loss double, accuracy double, perplexity double")


def test_golden_summary_and_winner(spark):
    log = golden(spark)
    s = {r.reward_type: r for r in E.run_summary(log).collect()}
    assert s["hard"].n_records == 38 and s["perplexity"].n_records == 19
    w = E.winner_pair(E.run_summary(log)).first()
    for k, v in SUMMARY.items():
        assert abs(w[k] - v) < 1e-12, k
    assert w.winner_final == "hard" and w.winner_best == "hard"
    assert w.recommendation == RECOMMENDATION


def test_running_best_matches_loop(spark):
    log = golden(spark)
    rb = {(r.reward_type, r.step): r for r in E.running_best(log).collect()}
    best = {"hard": 0.0, "perplexity": 0.0}
    for rt, step, _l, acc, _p in sorted(ROWS, key=lambda r: (r[0], r[1])):
        r = rb[(rt, step)]
        assert r.best_before == best[rt]
        assert r.new_best == (acc > best[rt])
        best[rt] = max(best[rt], acc)
    assert best == {"hard": 0.35, "perplexity": 0.25}


def test_eval_gate(spark):
    log = spark.createDataFrame([("h", 100, 0.5, 2.0), ("h", 200, 0.6, 2.1), ("h", 250, 0.7, 2.2)], "reward_type string, step long, accuracy double, perplexity double")
    g = {r.step: r for r in E.eval_gate(log, 200).collect()}
    assert not g[100].evaluated and g[100].accuracy == 0.0 and g[100].perplexity is None
    assert g[200].evaluated and g[250].evaluated  # last step is always evaluated


def test_hist_density_integrates_to_one(spark):
    vals = golden(spark).select("reward_type", F.col("accuracy").alias("v"))
    h = E.hist_density(vals, ["reward_type"], "v")
    tot = h.join(
        vals.groupBy("reward_type").agg(((F.max("v") - F.min("v")) / 10).alias("w")), "reward_type"
    ).groupBy("reward_type").agg(F.sum(F.col("density") * F.col("w")).alias("area")).collect()
    for r in tot:
        assert abs(r.area - 1.0) < 1e-9
    assert h.count() == 20


def test_eval_accuracy_first_n(spark):
    df = spark.createDataFrame(
        [("m", i, 0, 1.0, 1.0 if i % 2 == 0 else 0.0, None, "test") for i in range(10)],
        "model string, qa_id long, sample_idx int, correct_answer double, pred_marker double, pred_cascade double, split string",
    )
    acc = {r.strategy: r for r in E.eval_accuracy(df, eval_size=4).collect()}
    assert acc["marker"].n_eval == 4 and acc["marker"].accuracy == 0.5
    assert acc["cascade"].accuracy == 0.0


def test_eval_gate_modulo_only(spark):
    log = spark.createDataFrame([("h", 100, 0.5, 2.0), ("h", 200, 0.6, 2.1), ("h", 250, 0.7, 2.2)], "reward_type string, step long, accuracy double, perplexity double")
    assert sorted(r.step for r in E.eval_gate(log, 100, modulo_only=True).collect()) == [100, 200]


def test_eval_accuracy_empty_group_reports_zero(spark):
    df = spark.createDataFrame(
        [("a", 1, 0, 1.0, 1.0, 1.0, "test"), ("b", 2, 0, 1.0, 1.0, 1.0, "train")],
        "model string, qa_id long, sample_idx int, correct_answer double, pred_marker double, pred_cascade double, split string",
    )
    acc = {(r.model, r.strategy): r for r in E.eval_accuracy(df).collect()}
    assert acc[("a", "marker")].accuracy == 1.0
    assert acc[("b", "marker")].accuracy == 0.0 and acc[("b", "marker")].n_eval == 0
