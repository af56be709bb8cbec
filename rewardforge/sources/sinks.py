"""Sinks that persist preference rows, reports and scalar logs, and read them back.

Paths default to a folder next to the shared checkpoint data, so that a
written table survives the loss of an executor (never a machine-local folder).
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..operators.keyed import with_per_key
from ..session import scratch_path

MESSAGES = ST.ArrayType(ST.StructType([ST.StructField("role", ST.StringType()), ST.StructField("content", ST.StringType())]))

PREFERENCE_SCHEMA = ST.StructType(
    [
        ST.StructField("qa_id", ST.LongType()),
        ST.StructField("prompt", MESSAGES),
        ST.StructField("chosen", MESSAGES),
        ST.StructField("rejected", MESSAGES),
        ST.StructField("chosen_reward", ST.DoubleType()),
        ST.StructField("rejected_reward", ST.DoubleType()),
    ]
)

METRIC_SCHEMA = ST.StructType(
    [
        ST.StructField("step", ST.LongType()),
        ST.StructField("loss", ST.DoubleType()),
        ST.StructField("accuracy", ST.DoubleType()),
        ST.StructField("perplexity", ST.DoubleType()),
        ST.StructField("evaluated", ST.BooleanType()),
        ST.StructField("reward_type", ST.StringType()),
    ]
)

RUN_SCHEMA = ST.StructType(
    [
        ST.StructField("reward_type", ST.StringType()),
        ST.StructField("n_records", ST.LongType()),
        ST.StructField("final_accuracy", ST.DoubleType()),
        ST.StructField("best_accuracy", ST.DoubleType()),
        ST.StructField("last_step", ST.LongType()),
    ]
)

SUMMARY_SCHEMA = ST.StructType(
    [
        ST.StructField("date", ST.StringType()),
        ST.StructField("dataset", ST.StringType()),
        ST.StructField("configuration", ST.MapType(ST.StringType(), ST.StringType())),
        ST.StructField("final_accuracy_hard", ST.DoubleType()),
        ST.StructField("final_accuracy_perplexity", ST.DoubleType()),
        ST.StructField("best_accuracy_hard", ST.DoubleType()),
        ST.StructField("best_accuracy_perplexity", ST.DoubleType()),
        ST.StructField("winner_final", ST.StringType()),
        ST.StructField("winner_best", ST.StringType()),
        ST.StructField("improvement", ST.DoubleType()),
        ST.StructField("recommendation", ST.StringType()),
        ST.StructField("runs", ST.ArrayType(RUN_SCHEMA)),
    ]
)

SCALAR_SCHEMA = ST.StructType(
    [ST.StructField("step", ST.LongType()), ST.StructField("value", ST.DoubleType()), ST.StructField("tag", ST.StringType())]
)


def _fresh(spark: SparkSession, name: str, path: str | None) -> str:
    return path or scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def preference_export(pairs: DataFrame, path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Write preference rows and read them back unchanged with the declared schema."""
    spark = pairs.sparkSession
    out = _fresh(spark, "preference", path)
    pairs.select(*[f.name for f in PREFERENCE_SCHEMA.fields]).write.mode("overwrite").format(fmt).save(out)
    return spark.read.schema(PREFERENCE_SCHEMA).format(fmt).load(out)


def write_report(summary: DataFrame, runs: DataFrame, metrics: DataFrame, config: dict, path: str | None = None, dataset: str = "qa") -> str:
    """The report as JSON: one summary document (winners, accuracies, one entry
    per run) and the metric records as JSON lines per run in step order.

    The metric arrays of the reference's single document become a folder per
    reward type, so no task or row has to hold a whole run.
    """
    spark = summary.sparkSession
    out = _fresh(spark, "report", path)
    conf = F.create_map(*[x for k, v in config.items() for x in (F.lit(k), F.lit(str(v)))])
    run_arr = runs.agg(F.array_sort(F.collect_list(F.struct(*[F.col(f.name) for f in RUN_SCHEMA.fields]))).alias("runs"))
    doc = summary.withColumn("runs", run_arr.scalar())
    doc = doc.select(
        F.lit(_dt.datetime.now().isoformat()).alias("date"), F.lit(dataset).alias("dataset"), conf.alias("configuration"),
        *[F.col(f.name) for f in SUMMARY_SCHEMA.fields[3:]],
    )
    doc.coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    (
        metrics.select(*[F.col(f.name) for f in METRIC_SCHEMA.fields])
        .repartitionByRange("reward_type", "step")  # a hot run spreads over many files
        .sortWithinPartitions("reward_type", "step")
        .write.mode("overwrite")
        .partitionBy("reward_type")
        .json(f"{out}/metrics")
    )
    return out


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Read a report back: (summary row, metric rows with their run's entry)."""
    summary = spark.read.schema(SUMMARY_SCHEMA).json(f"{path}/summary")
    metrics = spark.read.schema(METRIC_SCHEMA).json(f"{path}/metrics")
    runs = summary.select(F.explode("runs").alias("r")).select("r.*")
    return summary, with_per_key(metrics, runs.select("reward_type", "final_accuracy", "best_accuracy"), ["reward_type"])


def scalar_log(gated: DataFrame, path: str | None = None) -> DataFrame:
    """Long (tag, step, value) rows for evaluated records: accuracy, perplexity
    (not null) and loss; written as parquet partitioned by tag and read back."""
    spark = gated.sparkSession
    long = (
        gated.where(F.col("evaluated"))
        .unpivot(["reward_type", "step"], ["accuracy", "perplexity", "loss"], "metric", "value")
        .where(F.col("value").isNotNull())
        .select(F.col("step").cast("bigint"), F.col("value"), F.concat_ws("/", "reward_type", "metric").alias("tag"))
    )
    out = _fresh(spark, "scalars", path)
    long.write.mode("overwrite").partitionBy("tag").parquet(out)
    return spark.read.schema(SCALAR_SCHEMA).parquet(out)
