"""What one task holds, and what is shuffled, where texts meet their answers."""

from pyspark.sql import functions as F

from rewardforge.operators import evalstats as E
from rewardforge.operators import pairs as D
from rewardforge.plans import queries as Q
from rewardforge.sources import fixtures as FX
from rewardforge.sources import qa as S
from rewardforge.streaming import streams as ST


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_sort_holds_the_texts_of_responses(spark, sf):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = plan(E.response_gold_join(FX.response(spark, sf), FX.qa(spark, sf)))
        samples = spark.createDataFrame([(1, "p", 1.0, "a", "b")], "qa_id long, prompt string, correct_answer double, chosen string, rejected string")
        score = D.sides_scorer(lambda sides: sides.select("qa_id", "side", F.lit(1.0).alias("reward")), "qa_id")
        sides = plan(score(samples))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in joined + sides and "ShuffledHashJoin" in joined and "ShuffledHashJoin" in sides


def test_the_texts_have_as_many_partitions_as_the_session_says(spark, sf):
    """Before, the few bytes of the rows they are built of put them all into one."""
    response = FX.response(spark, sf).where("length(response) > 0")
    assert response.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_streamed_responses_are_read_before_the_join(spark, sf, monkeypatch):
    landed, tables = [], []
    monkeypatch.setattr(Q, "_write_source", lambda *a, **k: landed.append(a))
    hard = ST.stream_hard_reward
    monkeypatch.setattr(ST, "stream_hard_reward", lambda s, src, gold, sink, ck, n: tables.append((s.read.parquet(src), n)) or hard(s, src, gold, sink, ck, n))
    out = Q.queries()["stream_hard_reward"](spark, sf)
    assert not landed  # no range shuffle of the texts into a fixed number of files
    (source, per_batch), want = tables[0], Q.queries()["hard_reward"](spark, sf)
    assert per_batch == int(spark.conf.get("spark.sql.shuffle.partitions")) // 2 and len(source.inputFiles()) > 1
    columns = ["qa_id", "sample_idx", "hard_marker"]
    assert out.count() == want.count() and out.select(columns).exceptAll(want.select(columns)).isEmpty()


def test_carried_columns_are_not_joined(spark):
    rows = spark.createDataFrame([(f"id{i}", i / 2) for i in range(25)], "k string, v double").repartition(3)
    joined, carried = S.batch_assign(rows, "k", 2, 4), S.batch_assign(rows, "k", 2, 4, carry=["v"])
    columns = ["epoch", "idx", "batch_id", "v"]
    assert carried.columns == ["v", "epoch", "idx", "batch_id"] and carried.count() == 50
    assert carried.select(columns).exceptAll(joined.select(columns)).isEmpty()
    numbers = spark.range(25).select(F.col("id").alias("k"))
    hexed = numbers.withColumn("e", F.lit(0)).select("k", S.T.seeded_hash_key(F.col("e"), F.col("k")).alias("h")).orderBy("h").collect()
    got = S.batch_assign(numbers, "k", 1, 4).orderBy("idx").collect()
    assert [r["k"] for r in got] == [r["k"] for r in hexed]
