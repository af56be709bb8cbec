"""Structured Streaming forms of the push-style steps.

Sources are parquet folders read with a declared schema; sinks are parquet
folders written by ``foreachBatch`` with the batch id in the path, so a
replayed micro-batch overwrites its own output (idempotent, exactly-once with
the checkpoint). Every checkpoint and sink lives in the shared folder.
``files_per_trigger`` bounds a micro-batch (a backlog is read in several); it
drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..session import materialize

COMPACT_EVERY = 16  # micro-batches between snapshots of an upsert log

LOG_SCHEMA = ST.StructType(
    [
        ST.StructField("reward_type", ST.StringType()),
        ST.StructField("step", ST.LongType()),
        ST.StructField("loss", ST.DoubleType()),
        ST.StructField("accuracy", ST.DoubleType()),
        ST.StructField("perplexity", ST.DoubleType()),
        ST.StructField("evaluated", ST.BooleanType()),
    ]
)

REWARD_EVENT_SCHEMA = ST.StructType(
    [ST.StructField("event_id", ST.LongType()), ST.StructField("ts", ST.TimestampType()), ST.StructField("reward", ST.DoubleType())]
)

RESPONSE_SCHEMA = ST.StructType(
    [
        ST.StructField("qa_id", ST.LongType()),
        ST.StructField("sample_idx", ST.IntegerType()),
        ST.StructField("model", ST.StringType()),
        ST.StructField("response", ST.StringType()),
    ]
)


def run_available(query_start: Callable[[], object]) -> None:
    """Start a query with ``trigger(availableNow=True)`` and wait for it to finish."""
    q = query_start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _source(spark: SparkSession, schema: ST.StructType, path: str, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    cols = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct("batch_id", *cols), "batch_id").alias("r")).select(*keys, "r.*")


def _upserts(spark: SparkSession, path: str, keys: list[str], last: int, every: int) -> DataFrame:
    """State after micro-batch ``last``: the newest snapshot before it and the batches since."""
    snap = last // every * every - 1
    rows = spark.read.parquet(f"{path}/log").where((F.col("batch_id") > snap) & (F.col("batch_id") <= last))
    if snap >= 0:
        rows = rows.unionByName(spark.read.parquet(f"{path}/state/{snap}"))
    return _latest(rows, keys)


def _upsert_sink(path: str, keys: list[str], every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """Append each micro-batch's changed rows; every so many batches write the whole state."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")
        if (batch_id + 1) % every == 0:
            _upserts(batch.sparkSession, path, keys, batch_id, every).write.mode("overwrite").parquet(f"{path}/state/{batch_id}")

    return write


def latest_by_key(spark: SparkSession, path: str, keys: list[str], every: int = COMPACT_EVERY) -> DataFrame:
    """Resolve an upsert log: the row of the latest micro-batch per key."""
    last = spark.read.parquet(f"{path}/log").agg(F.max("batch_id")).first()[0]
    if last is None:  # only empty micro-batches so far
        return spark.read.parquet(f"{path}/log").drop("batch_id")
    return _upserts(spark, path, keys, last + 1, every).drop("batch_id")  # + 1: a snapshot made after ``last`` counts


def stream_running_best(
    spark: SparkSession, source: str, sink: str, checkpoint: str, files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY
) -> DataFrame:
    """ST1: per reward type the latest step, its accuracy, and the best accuracy so far.

    A late record (lower step) can raise the best but not change the latest.
    Update mode; the foreachBatch sink upserts by reward type.
    """
    logs = _source(spark, LOG_SCHEMA, source, files_per_trigger)
    agg = logs.groupBy("reward_type").agg(
        F.max("step").alias("latest_step"),
        F.max_by("accuracy", "step").alias("latest_accuracy"),
        F.greatest(F.lit(0.0), F.max(F.when(F.col("evaluated"), F.col("accuracy")))).alias("best_accuracy"),
        F.count(F.lit(1)).alias("n_records"),
    )
    keys = ["reward_type"]
    run_available(
        lambda: agg.writeStream.outputMode("update").foreachBatch(_upsert_sink(sink, keys, compact_every)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    return latest_by_key(spark, sink, keys, compact_every)


def stream_reward_window(
    spark: SparkSession, source: str, sink: str, checkpoint: str, window: str = "1 hour", watermark: str = "10 minutes",
    files_per_trigger: int | None = None, compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """ST2: mean reward per tumbling event-time window; rows behind the watermark are dropped.

    Update mode: every window that has rows is in the result, and ``closed``
    says whether the watermark has passed its end, so that it cannot change any
    more. The mean is an exact decimal sum over the count, so it does not
    depend on batch order.
    """
    ev = _source(spark, REWARD_EVENT_SCHEMA, source, files_per_trigger)
    agg = (
        ev.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("reward").cast("decimal(38,12)")).alias("s"), F.max("ts").alias("last_ts"))
        .select(
            F.unix_timestamp(F.col("w.start")).alias("window_start"), F.unix_timestamp(F.col("w.end")).alias("window_end"),
            "n", (F.col("s").cast("double") / F.col("n")).alias("mean_reward"), F.unix_micros("last_ts").alias("last_us"),
        )
    )
    keys = ["window_start"]
    run_available(
        lambda: agg.writeStream.outputMode("update").foreachBatch(_upsert_sink(sink, keys, compact_every)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    out = latest_by_key(spark, sink, keys, compact_every)
    mark = out.agg(F.unix_micros(F.timestamp_micros(F.max("last_us")) - F.expr(f"interval {watermark}"))).scalar()
    return out.withColumn("closed", F.col("window_end") * 1000000 <= mark).drop("last_us")


def stream_hard_reward(
    spark: SparkSession, source: str, gold: DataFrame, sink: str, checkpoint: str, files_per_trigger: int | None = None
) -> DataFrame:
    """ST3: responses stream in, join the static gold table, get the marker reader's
    hard reward, and are appended to a parquet sink (stream-static inner join).
    The gold table is written once per run, not derived anew per micro-batch;
    the answer is read before the join, so no text is shuffled or sorted."""
    gold = materialize(gold, "stream-gold")
    resp = _source(spark, RESPONSE_SCHEMA, source, files_per_trigger)
    read = resp.select("qa_id", "sample_idx", "model", T.extract_marker("response").alias("pred_marker"))
    scored = read.join(gold, "qa_id").select("qa_id", "sample_idx", "model", "correct_answer", "pred_marker").withColumn("hard_marker", T.hard_reward(F.col("pred_marker"), F.col("correct_answer")))
    run_available(
        lambda: scored.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    return spark.read.parquet(sink)


def stream_metric_hook(
    spark: SparkSession, source: str, sink: str, checkpoint: str, hook: Callable[[DataFrame], DataFrame], files_per_trigger: int | None = None
) -> DataFrame:
    """a callback per micro-batch of log records; its output rows are appended
    per batch id (a replayed batch overwrites its own folder)."""

    def each(batch: DataFrame, batch_id: int) -> None:
        hook(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    logs = _source(spark, LOG_SCHEMA, source, files_per_trigger)
    run_available(
        lambda: logs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    return spark.read.parquet(sink).drop("batch_id")
