"""Each stream equals its batch form; restart from the checkpoint with a late file."""

import uuid

from pyspark.sql import functions as F

from rewardforge.session import scratch_path
from rewardforge.streaming import streams as ST


def dirs(spark):
    base = scratch_path(spark, f"test-stream-{uuid.uuid4().hex[:8]}")
    return f"{base}/src", f"{base}/sink", f"{base}/ck"


def log_rows(spark, rows):
    return spark.createDataFrame(rows, ST.LOG_SCHEMA)


def test_running_best_restart_with_late_record(spark):
    src, sink, ck = dirs(spark)
    log_rows(spark, [("hard", 100, 0.0, 0.2, 2.0, True), ("hard", 200, 0.0, 0.1, 2.0, True), ("perplexity", 100, 0.0, 0.3, 2.0, True)]).write.mode("append").parquet(src)
    r1 = {r.reward_type: r for r in ST.stream_running_best(spark, src, sink, ck).collect()}
    assert r1["hard"].latest_step == 200 and r1["hard"].latest_accuracy == 0.1 and r1["hard"].best_accuracy == 0.2
    # a late record (lower step) raises the best but not the latest
    log_rows(spark, [("hard", 150, 0.0, 0.9, 2.0, True)]).write.mode("append").parquet(src)
    r2 = {r.reward_type: r for r in ST.stream_running_best(spark, src, sink, ck).collect()}
    assert r2["hard"].latest_step == 200 and r2["hard"].latest_accuracy == 0.1 and r2["hard"].best_accuracy == 0.9
    assert r2["hard"].n_records == 3 and r2["perplexity"].best_accuracy == 0.3


def test_reward_window_drops_late_file(spark):
    src, sink, ck = dirs(spark)
    ev = spark.createDataFrame(
        [(i, f"2024-01-01 {h:02d}:{m:02d}:00", float(i)) for i, (h, m) in enumerate([(0, 5), (0, 50), (1, 10), (2, 30), (3, 40)])],
        "event_id long, ts string, reward double",
    ).withColumn("ts", F.to_timestamp("ts"))
    ev.write.mode("append").parquet(src)
    first = {r.window_start: r for r in ST.stream_reward_window(spark, src, sink, ck).collect()}
    # every window that has rows; closed when its end <= max event time - 10 min: hours 0, 1, 2
    h0 = min(first)
    assert {(w - h0) // 3600: r.closed for w, r in first.items()} == {0: True, 1: True, 2: True, 3: False}
    assert first[h0].n == 2 and first[h0].mean_reward == 0.5
    late = spark.createDataFrame(
        [(99, "2024-01-01 00:20:00", 100.0), (98, "2024-01-01 03:45:00", 8.0), (100, "2024-01-01 05:00:00", 1.0)], "event_id long, ts string, reward double"
    )
    late.withColumn("ts", F.to_timestamp("ts")).write.mode("append").parquet(src)
    second = {(r.window_start - h0) // 3600: r for r in ST.stream_reward_window(spark, src, sink, ck).collect()}
    assert second[0].n == 2  # the late row behind the watermark was dropped
    assert second[3].n == 2 and second[3].mean_reward == 6.0 and second[3].closed  # the open window took its row, then closed
    assert set(second) == {0, 1, 2, 3, 5} and not second[5].closed


def test_upsert_log_compacts(spark):
    src, sink, ck = dirs(spark)
    for k in range(5):  # one file, so one micro-batch, each
        rows = [("hard", 100 * (k + 1), 0.0, 0.1 * k, 2.0, True)] + ([("perplexity", 100, 0.0, 0.5, 2.0, True)] if k == 0 else [])
        log_rows(spark, rows).coalesce(1).write.mode("append").parquet(src)
        got = {r.reward_type: r for r in ST.stream_running_best(spark, src, sink, ck, files_per_trigger=1, compact_every=2).collect()}
        assert got["hard"].latest_step == 100 * (k + 1) and got["hard"].n_records == k + 1
        assert got["perplexity"].best_accuracy == 0.5  # unchanged since the first micro-batch
    assert spark.read.parquet(f"{sink}/state/3").count() == 2
    # of the log only the micro-batches after the newest snapshot are read
    assert ST._upserts(spark, sink, ["reward_type"], 5, 2).count() == 2


def test_stream_hard_reward_restart_equals_batch(spark):
    from rewardforge.functions import text as T

    src, sink, ck = dirs(spark)
    gold = spark.createDataFrame([(1, 10.0), (2, 2.5)], "qa_id long, correct_answer double")
    rows = [(1, 0, "m", "so #### 10"), (1, 1, "m", "I think 9"), (2, 0, "m", "2.5 it is"), (2, 1, "m", "none")]
    spark.createDataFrame(rows[:2], ST.RESPONSE_SCHEMA).write.mode("append").parquet(src)
    first = ST.stream_hard_reward(spark, src, gold, sink, ck)
    assert first.count() == 2
    spark.createDataFrame(rows[2:], ST.RESPONSE_SCHEMA).write.mode("append").parquet(src)
    second = ST.stream_hard_reward(spark, src, gold, sink, ck)  # restart from the checkpoint
    got = sorted((r.qa_id, r.sample_idx, r.hard_marker) for r in second.collect())
    batch = spark.createDataFrame(rows, ST.RESPONSE_SCHEMA).join(gold, "qa_id").select(
        "qa_id", "sample_idx", T.hard_reward(T.extract_marker("response"), F.col("correct_answer")).alias("h")
    )
    assert got == sorted((r.qa_id, r.sample_idx, r.h) for r in batch.collect())
    assert got == [(1, 0, 1.0), (1, 1, 0.0), (2, 0, 1.0), (2, 1, 0.0)]
