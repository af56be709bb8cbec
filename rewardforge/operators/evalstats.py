"""Evaluation statistics, metric-log windows and report tables.

Averages that feed comparisons are computed as exact decimal sums divided by
counts (``exact_avg``): a double sum depends on the order rows arrive in, so
two runs with different partitioning could disagree in the last bit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .keyed import with_per_key
from .ordering import blocked_prefix

# --- Fixed values that must equal the reference's ---
EVAL_EVERY = 100
EVAL_SIZE = 20
HIST_BINS = 10
# --- end of fixed values ---

EXACT = "decimal(38,12)"


def exact_sum(c: str | Column) -> Column:
    """Order-independent sum of doubles that hold at most 12 decimals."""
    return F.sum(T.col(c).cast(EXACT)).cast("double")


def exact_avg(c: str | Column) -> Column:
    x = T.col(c)
    return exact_sum(x) / F.count(x)


def response_gold_join(responses: DataFrame, qa: DataFrame, keep_split: bool = True) -> DataFrame:
    """Pair responses with the gold answer of their question by key (never by position).

    Both sides grow with the data, so this is a shuffle join on qa_id. The gold
    side (one narrow row per question) is hashed: a sort would hold every text
    of a task's responses.
    """
    cols = ["qa_id", T.gold_first("answer").alias("correct_answer")]
    if keep_split:
        cols.append("split")
    gold = qa.select(*cols).where(F.col("correct_answer").isNotNull())
    return responses.join(gold.hint("shuffle_hash"), "qa_id")


def scored_responses(responses: DataFrame, qa: DataFrame, include_prompt: bool = False) -> DataFrame:
    """J2 + P3 + P4 + P5: both readers and their hard rewards per response.

    ``include_prompt`` reads the answer out of prompt and response, as the
    reference does for decoded text (note Q13).
    """
    j = response_gold_join(responses, qa)
    text = T.scored_text("prompt", "response") if include_prompt else F.col("response")
    p = j.withColumn("pred_marker", T.extract_marker(text)).withColumn("pred_cascade", T.extract_cascade(text))
    gold = F.col("correct_answer")
    return (
        p.withColumn("hard_marker", T.hard_reward(F.col("pred_marker"), gold))
        .withColumn("hard_cascade", T.hard_reward(F.col("pred_cascade"), gold))
        .withColumn("hard_exact", T.hard_reward(F.col("pred_marker"), gold, exact=True))
    )


def first_n_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str], n: int) -> DataFrame:
    """First n rows per group in order.

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before the
    shuffle, so a hot group sends at most n rows per map task.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def eval_accuracy(
    scored: DataFrame,
    group_cols: Sequence[str] = ("model",),
    order_cols: Sequence[str] = ("qa_id", "sample_idx"),
    eval_size: int | None = None,
    split: str | None = "test",
    perplexity_col: str | None = None,
) -> DataFrame:
    """Accuracy per (group, strategy) over the first ``eval_size`` rows in order.

    ``eval_size=None`` evaluates every row. Right = a prediction within 1e-4.
    Mean perplexity is 0.0 when there is none.
    """
    df = scored if split is None else scored.where(F.col("split") == split)
    long = df.unpivot(
        [*group_cols, *order_cols, "correct_answer", *([perplexity_col] if perplexity_col else [])],
        ["pred_marker", "pred_cascade"], "strategy", "pred",
    ).withColumn("strategy", F.regexp_replace("strategy", "^pred_", ""))
    if eval_size is not None:
        long = first_n_per_group(long, [*group_cols, "strategy"], order_cols, eval_size)
    right = T.is_right(F.col("pred"), F.col("correct_answer")).cast("bigint")
    aggs = [
        F.count(F.lit(1)).alias("n_eval"),
        F.sum(right).alias("n_right"),
        (F.sum(right) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("accuracy"),
    ]
    if perplexity_col:
        aggs.append(F.coalesce(F.avg(perplexity_col), F.lit(0.0)).alias("mean_perplexity"))
    agg = long.groupBy(*group_cols, "strategy").agg(*aggs)
    # A group with nothing to evaluate reports 0.0, as the reference does for an
    # empty validation set: every (group, strategy) of the input gets a row.
    groups = scored.select(*group_cols).distinct().withColumn(
        "strategy", F.explode(F.array(F.lit("marker"), F.lit("cascade")))
    )
    out = groups.join(agg, [*group_cols, "strategy"], "left")
    fill = {"n_eval": F.lit(0).cast("bigint"), "n_right": F.lit(0).cast("bigint"), "accuracy": F.lit(0.0), "mean_perplexity": F.lit(0.0)}
    return out.select(*group_cols, "strategy", *[F.coalesce(F.col(c), fill[c]).alias(c) for c in agg.columns if c in fill])


# ---------------- metric logs (W1, W2, A9-A15, U1) ----------------
EVAL_EVERY_FULL = 200


def eval_gate(
    log: DataFrame, eval_every: int = EVAL_EVERY, run_cols: Sequence[str] = ("reward_type",), modulo_only: bool = False
) -> DataFrame:
    """A record is evaluated if step % eval_every == 0 or step >= the run's last step;
    otherwise accuracy is 0.0 and perplexity null.

    ``modulo_only=True`` is the other script's rule: only step % eval_every == 0
    counts, and the other records are dropped.
    The last step per run is one aggregate, looked up per row, not a window over
    the whole run.
    """
    if modulo_only:
        return log.where(F.col("step") % eval_every == 0).withColumn("evaluated", F.lit(True))
    last = log.groupBy(*run_cols).agg(F.max("step").alias("_max_step"))
    j = with_per_key(log, last, list(run_cols))
    ev = (F.col("step") % eval_every == 0) | (F.col("step") >= F.col("_max_step"))
    return (
        j.withColumn("evaluated", ev)
        .withColumn("accuracy", F.when(ev, F.col("accuracy")).otherwise(F.lit(0.0)))
        .withColumn("perplexity", F.when(ev, F.col("perplexity")))
        .drop("_max_step")
    )


def running_best(log: DataFrame, run_cols: Sequence[str] = ("reward_type",)) -> DataFrame:
    """Best accuracy before each record (from 0.0) and the strict new-best flag.

    A run can hold a third of all records, so the running maximum is a blocked
    prefix scan over range partitions rather than one window per run.
    """
    pre = blocked_prefix(log, ["step"], list(run_cols), {"_best": ("accuracy", "max")}, inclusive=False)
    before = F.greatest(F.lit(0.0), F.coalesce(F.col("_best"), F.lit(0.0)))
    return (
        pre.withColumn("best_before", before)
        .withColumn("new_best", F.col("accuracy") > F.col("best_before"))
        .withColumn("best_after", F.greatest(F.col("best_before"), F.col("accuracy")))
        .drop("_best")
    )


def batch_mean_reward(batched: DataFrame, reward_col: str, every: int = 1) -> DataFrame:
    """Mean reward per (epoch, batch); ``every`` keeps one batch in so many (filter first)."""
    kept = batched.where(F.col("batch_id") % every == 0)
    return kept.groupBy("epoch", "batch_id").agg(
        F.count(F.lit(1)).alias("n"), exact_avg(reward_col).alias("mean_reward")
    )


def run_summary(log: DataFrame, run_col: str = "reward_type") -> DataFrame:
    """A10: records, final accuracy (last record), best accuracy (from 0.0), last step;
    plus the accuracy of the last evaluated record (note Q6)."""
    has_eval = "evaluated" in log.columns
    aggs = [
        F.count(F.lit(1)).alias("n_records"),
        F.max_by("accuracy", "step").alias("final_accuracy"),
        F.greatest(F.lit(0.0), F.max("accuracy")).alias("best_accuracy"),
        F.max("step").alias("last_step"),
    ]
    if has_eval:
        aggs.append(F.max_by(F.when(F.col("evaluated"), F.col("accuracy")), F.when(F.col("evaluated"), F.col("step"))).alias("final_evaluated_accuracy"))
    return log.groupBy(run_col).agg(*aggs)


REC_PERPLEXITY = "Perplexity rewards show smoother optimization."
REC_HARD = "Hard rewards converge faster to verifiable answers."


def winner_pair(summary: DataFrame, run_col: str = "reward_type") -> DataFrame:
    """Final and best winners (perplexity only if strictly greater), delta in
    points, and the recommendation text."""

    def pick(rt: str, c: str) -> Column:
        return F.coalesce(F.max(F.when(F.col(run_col) == rt, F.col(c))), F.lit(0.0)).alias(f"{c}_{rt}")

    w = summary.agg(
        pick("hard", "final_accuracy"), pick("perplexity", "final_accuracy"),
        pick("hard", "best_accuracy"), pick("perplexity", "best_accuracy"),
    )
    hf, pf = F.col("final_accuracy_hard"), F.col("final_accuracy_perplexity")
    hb, pb = F.col("best_accuracy_hard"), F.col("best_accuracy_perplexity")
    best_label = F.when(pb > hb, "perplexity-based").otherwise("hard")
    rec = F.concat(
        F.lit("Use "), best_label, F.lit(" reward: achieved best accuracy of "),
        F.format_string("%.3f", F.greatest(hb, pb)), F.lit(". "),
        F.when(pb > hb, F.lit(REC_PERPLEXITY)).otherwise(F.lit(REC_HARD)),
    )
    return w.select(
        "*",
        F.when(pf > hf, "perplexity").otherwise("hard").alias("winner_final"),
        F.when(pb > hb, "perplexity").otherwise("hard").alias("winner_best"),
        (F.abs(pf - hf) * 100).alias("improvement"),
        rec.alias("recommendation"),
    )


def argmax_priority(df: DataFrame, group_cols: Sequence[str], name_col: str, score_col: str, priority: Sequence[str]) -> DataFrame:
    """Highest score per group; ties go to the earlier name in ``priority``, unlisted names come last."""
    listed = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(name_col))
    rank = F.when(listed > 0, listed).otherwise(F.lit(len(priority) + 1))
    best = df.groupBy(*group_cols).agg(F.max(F.struct(F.col(score_col).alias("s"), (-rank).alias("p"), F.col(name_col).alias("n"))).alias("b"))
    return best.select(*group_cols, F.col("b.n").alias("winner"), F.col("b.s").alias(score_col))


def hist_density(values: DataFrame, group_cols: Sequence[str], value_col: str, bins: int = HIST_BINS) -> DataFrame:
    """Equal-width bins from min to max (last bin closed; min = max -> +-0.5),
    density = count / (n * width), empty bins included."""
    g = list(group_cols)
    st = values.groupBy(*g).agg(F.min(value_col).alias("_mn"), F.max(value_col).alias("_mx"), F.count(value_col).alias("n"))
    same = F.col("_mn") == F.col("_mx")
    st = st.select(
        *g, "n",
        F.when(same, F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(same, F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"),
    ).withColumn("width", (F.col("hi") - F.col("lo")) / float(bins))
    kept = values.where(F.col(value_col).isNotNull()).select(*g, F.col(value_col).alias("_value"))
    b = with_per_key(kept, st.select(*g, "lo", "width"), g).select(
        *g, F.least(F.lit(bins - 1), F.floor((F.col("_value") - F.col("lo")) / F.col("width")).cast("int")).alias("bin")
    )
    counts = b.groupBy(*g, "bin").agg(F.count(F.lit(1)).alias("count"))
    grid = st.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, [*g, "bin"], "left").withColumn("count", F.coalesce(F.col("count"), F.lit(0)))
    return out.select(
        *g, "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_lo"), "count",
        (F.col("count") / (F.col("n") * F.col("width"))).alias("density"),
    )


def series_by_step(log: DataFrame, runs: Sequence[str] = ("hard", "perplexity")) -> DataFrame:
    """Chart table per step > 0 with accuracy, loss, perplexity of each run in one row."""
    pos = log.where(F.col("step") > 0)
    aggs = []
    for rt in runs:
        for c, short in (("accuracy", "acc"), ("loss", "loss"), ("perplexity", "ppl")):
            aggs.append(F.max(F.when(F.col("reward_type") == rt, F.col(c))).alias(f"{short}_{rt}"))
    return pos.groupBy("step").agg(*aggs)


def metrics_union(*logs: DataFrame) -> DataFrame:
    """Stack the logs of several runs (by column name)."""
    out = logs[0]
    for lg in logs[1:]:
        out = out.unionByName(lg)
    return out
