"""Written outputs: report document and folders, scalar log partitions, preference export."""

import os

from pyspark.sql import functions as F

from rewardforge.operators import evalstats as E
from rewardforge.operators import pairs as D
from rewardforge.sources import sinks as SK
from rewardforge.session import scratch_path

from golden_report import RECOMMENDATION, ROWS


def _local(path: str) -> str:
    return path[len("file:"):] if path.startswith("file:") else path


def test_report_document_and_metric_folders(spark):
    log = spark.createDataFrame(ROWS, "reward_type string, step long, loss double, accuracy double, perplexity double").withColumn(
        "evaluated", F.lit(True)
    )
    summ = E.run_summary(log)
    path = SK.write_report(E.winner_pair(summ), summ, log, {"eval_every": 100, "eval_size": 20})
    summary, metrics = SK.read_report(spark, path)
    doc = summary.first()
    assert doc.winner_final == "hard" and doc.winner_best == "hard"
    assert doc.recommendation == RECOMMENDATION
    assert doc.configuration["eval_size"] == "20"
    assert sorted(r.reward_type for r in doc.runs) == ["hard", "perplexity"]
    assert metrics.count() == len(ROWS)
    parts = sorted(d for d in os.listdir(_local(f"{path}/metrics")) if d.startswith("reward_type="))
    assert parts == ["reward_type=hard", "reward_type=perplexity"]
    # records come back whole and per run in step order within each file
    got = sorted((r.reward_type, r.step, r.accuracy) for r in metrics.collect())
    assert got == sorted((r[0], r[1], r[3]) for r in ROWS)


def test_scalar_log_partitions(spark):
    log = spark.createDataFrame(
        [("hard", 100, 0.5, 0.2, 2.0, True), ("hard", 150, 0.0, 0.0, None, False), ("perplexity", 100, 0.4, 0.3, None, True)],
        "reward_type string, step long, loss double, accuracy double, perplexity double, evaluated boolean",
    )
    path = scratch_path(spark, "test-scalars")
    out = SK.scalar_log(log, path)
    tags = sorted((r.tag, r.step, r.value) for r in out.collect())
    assert tags == [
        ("hard/accuracy", 100, 0.2), ("hard/loss", 100, 0.5), ("hard/perplexity", 100, 2.0),
        ("perplexity/accuracy", 100, 0.3), ("perplexity/loss", 100, 0.4),
    ]
    dirs = sorted(d for d in os.listdir(_local(path)) if d.startswith("tag="))
    assert len(dirs) == 5


def test_preference_export_round_trip(spark):
    df = spark.createDataFrame(
        [(1, "p", "c", "r", 1.0, 0.0)], "qa_id long, prompt string, chosen string, rejected string, chosen_reward double, rejected_reward double"
    )
    nested = D.nest(df, "qa_id")
    back = SK.preference_export(nested)
    assert back.schema == SK.PREFERENCE_SCHEMA
    r = back.first()
    assert r.prompt[0].role == "user" and r.chosen[0].role == "assistant" and r.chosen[0].content == "c"
