"""Seeded sampling and batching: same seed -> same rows, under any partitioning."""

from pyspark.sql import functions as F

from rewardforge.sources import fixtures as FX
from rewardforge.sources import qa as S


def test_qa_sample_is_stable_and_sized(spark, sf):
    qa = FX.qa(spark, sf)
    n_train = qa.where(F.col("split") == "train").count()
    a = {r.qa_id for r in S.qa_sample(qa, 100, "train").collect()}
    b = {r.qa_id for r in S.qa_sample(qa.repartition(5), 100, "train").collect()}
    assert a == b and len(a) == 100
    assert S.qa_sample(qa, n_train + 10, "train").count() == n_train


def test_batches_cover_each_epoch_once(spark, sf):
    qa = FX.qa(spark, sf).select("qa_id")
    n = qa.count()
    b = S.batch_assign(qa, F.col("qa_id"), epochs=2, batch_size=4)
    per = b.groupBy("epoch").agg(F.count("*").alias("c"), F.countDistinct("qa_id").alias("d"), F.max("batch_id").alias("mb")).collect()
    for r in per:
        assert r.c == n and r.d == n and r.mb == (n - 1) // 4
    sizes = b.groupBy("epoch", "batch_id").count().where("count > 4").count()
    assert sizes == 0
