"""Inputs beyond the fixtures: long texts, deep trees, extreme margins, odd names."""

import math

import pytest
from pyspark.sql import functions as F

from rewardforge.functions import registry as REG
from rewardforge.functions import text as T
from rewardforge.operators import evalstats as E
from rewardforge.operators import ngram as NG
from rewardforge.operators import pairs as D
from rewardforge.operators import tree as TR
from rewardforge.sources import qa as S


def test_perplexity_scores_whole_texts_and_hot_tokens(spark):
    texts = [(1, "a b " * 1500), (2, "a"), (3, ""), (4, "a a a c")]
    df = spark.createDataFrame(texts, "id long, t string")
    model = NG.fit_bigram(df, "t")
    out = {r["id"]: r for r in NG.score_perplexity(model, df, ["id"], F.col("t")).collect()}
    assert {i: r["n_pred"] for i, r in out.items()} == {1: 2999, 2: 0, 3: 0, 4: 3} and out[2]["ppl"] is None
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = {r["id"]: r for r in NG.score_perplexity(model, df, ["id"], F.col("t")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert again == out
    logged = spark.createDataFrame([(1, p, -1.0) for p in range(1, 3001)], "s long, pos int, lp double")
    assert NG.perplexity_from_logprobs(logged, "s", "pos", {"p": "lp"}).first()["n_pred"] == 2999


def test_deep_tree_and_cycle(spark):
    chain = [(i, None if i == 0 else i - 1, f"t{i}", "0") for i in range(6)]
    schema = "node_id long, parent_id long, token string, bit string"
    paths = TR.node_paths(spark.createDataFrame(chain, schema))
    assert paths.ancestors.where("node_id = 5").count() == 6
    with pytest.raises(ValueError):
        TR.node_paths(spark.createDataFrame([*chain, (1, 4, "again", "1")], schema))


def test_float_text_is_python_str(spark):
    values = [0.0005, 0.0001, 0.00001234, 12345678.5, 1e16, 1.5e22, 123.0, -2.5e-7, 1e15, 9999999.0, 0.0, 7.25, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = {r["x"]: r["t"] for r in df.select("x", T.float_text(F.col("x")).alias("t")).collect()}
    assert got == {v: str(v) for v in values}


def test_losses_stay_finite(spark):
    rows = [(1, "chosen", -8900.0, 0.0, 0.0), (1, "rejected", 0.0, 0.0, -1e-18), (2, "chosen", 0.0, 0.0, -1.0), (2, "rejected", 0.0, 0.0, -1.0)]
    seq = spark.createDataFrame(rows, "p long, side string, logp double, logp_ref double, mean_logp double")
    audit = D.preference_loss_audit(seq, "p", beta=1.0)
    got = {r["p"]: r for r in audit.collect()}
    assert got[1]["dpo_loss"] == 8900.0 and math.isfinite(got[1]["or_loss"])
    assert D.preference_loss_summary(audit).first()["mean_dpo_loss"] == pytest.approx((8900 + math.log(2)) / 2, abs=1e-6)


def test_unknown_evaluator_names_keep_their_rows(spark):
    REG.register_python("always_one", lambda p, r, g: 1.0)
    rows = [("hard", "x #### 3"), (None, "x"), ("nobody", "x"), ("always_one", "x")]
    df = spark.createDataFrame([(n, "q", r, 3.0) for n, r in rows], "n string, p string, r string, g double")
    got = {r["n"]: r["reward"] for r in REG.evaluate(df, "n", "p", "r", "g").collect()}
    assert got == {"hard": 1.0, None: 0.0, "nobody": 0.0, "always_one": 1.0}


def test_unlisted_names_lose_ties(spark):
    df = spark.createDataFrame([("g", "model_9", 1.0), ("g", "model_0", 1.0)], "g string, m string, s double")
    assert E.argmax_priority(df, ["g"], "m", "s", ["model_0", "model_1"]).first()["winner"] == "model_0"


def test_equal_rewards_have_no_advantage(spark):
    df = spark.createDataFrame([(1, 0.7)] * 3 + [(2, 0.1), (2, 0.4)], "g long, r double")
    got = {(r["g"], r["r"]): r["advantage"] for r in D.group_advantage(df, "g", "r").collect()}
    assert got[(1, 0.7)] == 0.0 and got[(2, 0.4)] == pytest.approx(1.0, abs=1e-6)


def test_balance_without_one_bucket(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, False)], "q long, right boolean")
    rows = D.difficulty_balance(df, "q", "right").collect()
    assert {r["bucket"] for r in rows} == {"hard", "easy"} and {r["n_buckets"] for r in rows} == {2}


def test_sample_and_chunks_are_whole(spark):
    qa = spark.range(50).select(F.col("id").alias("qa_id"), F.lit("train").alias("split"))
    assert S.qa_sample(qa, 7).count() == 7 and S.qa_sample(qa, 80).count() == 50
    rows = spark.createDataFrame([(i, "x" * 900) for i in range(25)], "k long, chosen string")
    epochs = spark.createDataFrame([(0, 1.0), (2, 1.0), (1, 0.0)], "epoch long, reward double")
    out = S.chunk_examples(S.chunk_assign(rows, ["k"], 20), epochs, ["k"]).collect()
    assert len(out) == 20 and {(len(r["input"]), r["n_epochs"]) for r in out} == {(900, 2)}
    assert S.chunk_examples(S.chunk_assign(rows, ["k"], 20), epochs, ["k"], head=10, input_chars=500).count() == 10


def test_pair_queries_compile(spark, sf):
    """No fallback to interpreted plans."""
    import __spark_entry__ as entry

    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        for key in ("pairs_ranked", "pairs_fixed"):
            assert entry.queries()[key](spark, sf).count() > 0
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_null_groups_and_per_key_values(spark):
    from rewardforge.operators.keyed import per_key
    from rewardforge.operators.ordering import blocked_prefix, ordered_index

    df = spark.createDataFrame([(None, 1, 1.0), (None, 2, 5.0), ("a", 1, 2.0), ("b", 1, 3.0)], "g string, k int, v double")
    got = {(r.g, r.k): r.idx for r in ordered_index(df, ["k"], ["g"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 1): 0, ("b", 1): 0}
    run = {(r.g, r.k): r.s for r in blocked_prefix(df, ["k"], ["g"], {"s": ("v", "sum")}, block_rows=1).collect()}
    assert run[(None, 2)] == 6.0 and run[("b", 1)] == 3.0
    top = df.where("g is null or g = 'a'").groupBy("g").agg(F.max("v").alias("m"))
    assert {(r.g, r.k): r.m for r in df.withColumn("m", per_key(top, ["g"], "m")).collect()} == {
        (None, 1): 5.0, (None, 2): 5.0, ("a", 1): 2.0, ("b", 1): None
    }
    assert df.withColumn("m", per_key(top.limit(0), ["g"], "m")).where("m is not null").count() == 0


def test_python_evaluator_fails_row_by_row(spark):
    def picky(prompts, responses, golds):
        if (responses == "bad").any():
            raise RuntimeError("bad row")
        return golds * 2

    REG.register_python("picky", picky, fallback=-1.0)
    try:
        rows = [("picky", "p", "bad" if i == 5 else "ok", float(i)) for i in range(9)]
        df = spark.createDataFrame(rows, "e string, p string, r string, g double").coalesce(1)
        got = {r.g: r.reward for r in REG.evaluate(df, "e", "p", "r", "g").collect()}
        assert got == {float(i): -1.0 if i == 5 else 2.0 * i for i in range(9)}
    finally:
        REG._REGISTRY.pop("picky")
        REG._PYTHON.discard("picky")
