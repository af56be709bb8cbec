"""Portable fixture views over the driver tables (FIXTURES.md section B).

Each view is written with the DataFrame API and yields the same rows as the
SQL text in FIXTURES.md. Ordered numbering (``row_number`` in the SQL) goes
through ``ordered_index`` so that a hot partition key (a reward type, a heavy
user) is split across tasks instead of landing in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keyed import with_per_key
from ..operators.ordering import ordered_index
from .tables import read_table


def _nl() -> F.Column:
    return F.lit("\n")


def _s(c) -> F.Column:
    return c.cast("string")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question/answer rows: qa_id, split, question, answer (free text ending in a marker)."""
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity")
    # A few bytes a row here become several texts in the same stage: partitions must not
    # be merged by the bytes that were shuffled, so their number is given.
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    g = li.repartition(n_parts, "l_orderkey").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.count(F.lit(1)).cast("bigint").alias("n")
    )
    k, q, n = F.col("l_orderkey"), F.col("q"), F.col("n")
    rem = _s(q - n)
    tail = (
        F.when(k % 11 == 0, F.lit(""))
        .when(k % 7 == 0, F.concat(_nl(), F.lit("Half a unit is lost: "), rem, F.lit(".5"), _nl(), F.lit("#### "), rem, F.lit(".5")))
        .when(k % 13 == 0, F.concat(_nl(), F.lit("#### 1,"), _s(q - n + 100)))
        .when(k % 17 == 0, F.concat(_nl(), F.lit("#### -"), rem))
        .otherwise(F.concat(_nl(), F.lit("#### "), rem))
    )
    return g.select(
        k.alias("qa_id"),
        F.when(k % 5 == 0, "test").otherwise("train").alias("split"),
        F.concat(
            F.lit("  Order "), _s(k), F.lit(" ships "), _s(q), F.lit(" units in "), _s(n),
            F.lit(" lines. How many units remain after one per line is returned?  "),
        ).alias("question"),
        F.concat(
            F.lit("There are "), _s(q), F.lit(" units."), _nl(), F.lit("So "), _s(q), F.lit(" - "), _s(n),
            F.lit(" = <<"), _s(q), F.lit("-"), _s(n), F.lit("="), rem, F.lit(">>"), rem, F.lit(" remain."), tail,
        ).alias("answer"),
    )


def response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four logged responses per question: qa_id, sample_idx, model, prompt, response."""
    base = qa(spark, sf_dir).withColumn("sample_idx", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    qid, s, ans = F.col("qa_id"), F.col("sample_idx"), F.col("answer")
    case = (qid * 31 + s * 17) % 5
    text = (
        F.when(case == 0, ans)
        .when(case == 1, F.concat(F.lit("I think the answer is "), _s(qid % 97), F.lit(".")))
        .when(case == 2, F.lit("I cannot tell."))
        .when(case == 3, F.concat(ans, _nl(), F.lit("Check again."), _nl(), F.lit("#### "), _s(s)))
        .otherwise(F.concat(F.lit("x = 3 so y = 4"), _nl(), ans, F.lit("  "), _nl()))
    )
    return base.select(
        qid, s.cast("int").alias("sample_idx"), F.concat(F.lit("model_"), _s(s % 3)).alias("model"),
        F.col("question").alias("prompt"), text.alias("response"),
    )


def token_logprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged per-token log-probabilities: sample_id, pos (1-based), logp_train, logp_base."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    ev = ordered_index(ev, ["ts", "event_id"], ["user_id"], "idx")
    return ev.select(
        F.col("user_id").alias("sample_id"),
        (F.col("idx") + 1).alias("pos"),
        (-(1 + (F.col("event_id") * 7919 % 128) / 32.0)).cast("double").alias("logp_train"),
        (-(1 + (F.col("event_id") * 104729 % 128) / 32.0)).cast("double").alias("logp_base"),
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trainer log records: reward_type, step, loss, accuracy, perplexity (nullable), ts."""
    ev = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value").withColumn(
        "reward_type", F.when(F.col("user_id") % 2 == 0, "hard").otherwise("perplexity")
    )
    ev = ordered_index(ev, ["ts", "event_id"], ["reward_type"], "idx")
    counts = ev.groupBy("reward_type").agg(F.count(F.lit(1)).alias("mx"))
    b = with_per_key(ev, counts, ["reward_type"]).withColumn("step", F.col("idx") + 1)
    return b.select(
        "reward_type",
        (F.col("step") * 100).alias("step"),
        F.when(F.col("step") == F.col("mx"), F.col("value") / 100.0).otherwise(F.lit(0.0)).cast("double").alias("loss"),
        ((F.col("event_id") * 7919 % 21) / 20.0).cast("double").alias("accuracy"),
        F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.lit(2.0) + F.col("value") / 1000.0).cast("double").alias("perplexity"),
        "ts",
    )


def chat_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turn with the assistant turn that answers it: conv_id, turn, prompt, response."""
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")
    )
    return u.join(a, ["conv_id", "turn"])


def conversations_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversation turns (the baseline corpus and multi-turn chats)."""
    return read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge shift per document in {-1, 0, 1}."""
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return lab.select("doc_id", (F.col("quality") - F.col("toxic")).alias("shift"))


def tree_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged search-tree nodes: node_id, parent_id (null at the root), token, bit, model."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size", "p_brand")
    pk = F.col("p_partkey")
    return part.select(
        pk.alias("node_id"),
        F.when(pk == 0, F.lit(None)).otherwise(F.floor((pk - 1) / 6.0).cast("bigint")).alias("parent_id"),
        F.col("p_name").alias("token"),
        F.when(F.col("p_size") % 3 == 0, "0").otherwise("1").alias("bit"),
        F.col("p_brand").alias("model"),
    )


FOREST_ROOTS = 8


def forest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same nodes as ``FOREST_ROOTS`` trees (our fixture for tables of many trees)."""
    nodes = tree_node(spark, sf_dir)
    up = F.floor((F.col("node_id") - FOREST_ROOTS) / 6.0).cast("bigint")
    return nodes.withColumn("parent_id", F.when(F.col("node_id") >= FOREST_ROOTS, up))


def tree_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answer of the question a node would be the root of: node_id, gold, gold_text (our fixture for T6)."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_size")
    return part.select(
        F.col("p_partkey").alias("node_id"), F.col("p_size").cast("double").alias("gold"),
        F.concat(F.lit("#### "), _s(F.col("p_size").cast("bigint"))).alias("gold_text"),
    )


def rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged rollouts: iter, leaf_id, reward."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    n_part = read_table(spark, sf_dir, "part", "p_partkey").agg(F.count(F.lit(1))).scalar()
    return orders.select(
        F.col("o_orderkey").alias("iter"),
        (F.col("o_custkey") % n_part).alias("leaf_id"),
        (F.col("o_totalprice") / 100000.0 - 2.0).alias("reward"),
    )


def preference_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw preference rows from conversations (our fixture for S2-S4).

    For each user turn: chosen = the assistant answer that follows, rejected =
    the assistant answer of the next exchange. Even conversations store a side
    as a one-message list, odd ones as plain text; a missing side is null.
    """
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn")
    a = conv.where(F.col("role") == "assistant")
    c = a.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("_c"))
    r = a.select("conv_id", (F.col("turn") - 3).alias("turn"), F.col("text").alias("_r"))
    j = u.join(c, ["conv_id", "turn"], "left").join(r, ["conv_id", "turn"], "left")
    even = F.col("conv_id") % 2 == 0

    def msgs(t: str) -> F.Column:
        return F.when(even & F.col(t).isNotNull(), F.array(F.struct(F.lit("assistant").alias("role"), F.col(t).alias("content"))))

    return j.select(
        "conv_id", "turn",
        msgs("_c").alias("chosen_messages"), F.when(~even, F.col("_c")).alias("chosen_text"),
        msgs("_r").alias("rejected_messages"), F.when(~even, F.col("_r")).alias("rejected_text"),
    )


def node_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge output per tree node (our fixture for the terminal check): '1' = complete."""
    part = read_table(spark, sf_dir, "part", "p_partkey", "p_size")
    return part.select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") > 40, "1").otherwise("0").alias("output"))
