"""Preference-pair building.

Pairs are built by aggregations and expressions per prompt: ``max``/``min``
over structs picks best and worst in one partial aggregation (a hot prompt
costs one row per map task, not a sort of the group).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut_lineage
from .ordering import ordered_index

# --- Fixed values that must equal the reference's ---
ADV_EPS = 1e-8
DPO_BETA = 0.1
# --- end of fixed values ---

# Difficulty cut points (ours; the notes name the buckets only).
DIFFICULTY_CUTS = (1.0 / 3.0, 2.0 / 3.0)


def _msgs(role: str, c: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), c.alias("content")))


def nest(df: DataFrame, id_col: str) -> DataFrame:
    """Preference rows in chat form (P8) with the two rewards."""
    return df.select(
        id_col,
        _msgs("user", F.col("prompt")).alias("prompt"),
        _msgs("assistant", F.col("chosen")).alias("chosen"),
        _msgs("assistant", F.col("rejected")).alias("rejected"),
        "chosen_reward",
        "rejected_reward",
    )


def hard_side_scorer(samples: DataFrame) -> DataFrame:
    """Hard evaluator with the marker reader for both sides (expressions only)."""
    gold = F.col("correct_answer")
    return samples.withColumn("cr", T.hard_reward(T.extract_marker("chosen"), gold)).withColumn(
        "rr", T.hard_reward(T.extract_marker("rejected"), gold)
    )


def sides_scorer(score_texts: Callable[[DataFrame], DataFrame], id_col: str) -> Callable[[DataFrame], DataFrame]:
    """Wrap a costly text scorer: explode to (id, side, text), score each distinct
    side once (a rejected text equal to the chosen one is not scored again),
    and join the two rewards back."""

    def run(samples: DataFrame) -> DataFrame:
        sides = samples.select(
            id_col, "prompt", "correct_answer",
            F.explode(
                F.when(
                    F.col("chosen") == F.col("rejected"),
                    F.array(F.struct(F.lit("c").alias("side"), F.col("chosen").alias("text"))),
                ).otherwise(
                    F.array(
                        F.struct(F.lit("c").alias("side"), F.col("chosen").alias("text")),
                        F.struct(F.lit("r").alias("side"), F.col("rejected").alias("text")),
                    )
                )
            ).alias("s"),
        ).select(id_col, "prompt", "correct_answer", "s.side", "s.text")
        scored = score_texts(sides)  # id, side, reward
        wide = scored.groupBy(id_col).agg(
            F.max(F.when(F.col("side") == "c", F.col("reward"))).alias("cr"),
            F.max(F.when(F.col("side") == "r", F.col("reward"))).alias("_rr"),
        )
        out = samples.join(wide.hint("shuffle_hash"), id_col)  # a sort would hold the texts
        return out.withColumn("rr", F.coalesce(F.col("_rr"), F.col("cr"))).drop("_rr")

    return run


def pairs_ranked(samples: DataFrame, scorer: Callable[[DataFrame], DataFrame], id_col: str = "qa_id") -> DataFrame:
    """Score both texts; if chosen <= rejected (ties too) swap texts and rewards."""
    s = scorer(samples)
    swap = F.col("cr") <= F.col("rr")
    flat = s.select(
        id_col, "prompt",
        F.when(swap, F.col("rejected")).otherwise(F.col("chosen")).alias("chosen"),
        F.when(swap, F.col("chosen")).otherwise(F.col("rejected")).alias("rejected"),
        F.when(swap, F.col("rr")).otherwise(F.col("cr")).alias("chosen_reward"),
        F.when(swap, F.col("cr")).otherwise(F.col("rr")).alias("rejected_reward"),
    )
    return nest(flat, id_col)


def pairs_fixed(samples: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None, id_col: str = "qa_id") -> DataFrame:
    """No swap; hard gives 1.0 / 0.0, else the scorer's rewards per side."""
    if scorer is None:
        s = samples.withColumn("cr", F.lit(1.0)).withColumn("rr", F.lit(0.0))
    else:
        s = scorer(samples)
    flat = s.select(id_col, "prompt", "chosen", "rejected", F.col("cr").alias("chosen_reward"), F.col("rr").alias("rejected_reward"))
    return nest(flat, id_col)


def flatten_pairs(nested: DataFrame, id_col: str = "qa_id") -> DataFrame:
    return nested.select(
        id_col,
        *[F.col(c)[0]["content"].alias(c) for c in ("prompt", "chosen", "rejected")],  # one message each
        "chosen_reward",
        "rejected_reward",
    )


def shortest_correct(responses: DataFrame, group_col: str, idx_col: str, text_col: str, right_col: str, mode: str = "shortest") -> DataFrame:
    """D3: per prompt the shortest right response (tie: lowest index); mode 'all' keeps every right one."""
    right = responses.where(F.col(right_col))
    if mode == "all":
        return right.select(group_col, idx_col, F.length(text_col).alias("length"))
    best = right.groupBy(group_col).agg(F.min(F.struct(F.length(text_col).alias("length"), F.col(idx_col).alias("idx"))).alias("_best"))
    return best.select(group_col, F.col("_best.idx").alias(idx_col), F.col("_best.length").alias("length"))


def pairs_by_length(responses: DataFrame, group_col: str, idx_col: str, text_col: str, right_col: str) -> DataFrame:
    """Among right responses shortest = chosen, longest = rejected (ties: lowest index);
    prompts with fewer than two right responses or equal lengths are skipped."""
    right = responses.where(F.col(right_col)).withColumn("_len", F.length(text_col))
    g = right.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_right"),
        F.min(F.struct(F.col("_len").alias("l"), F.col(idx_col).alias("i"))).alias("_short"),
        F.max(F.struct(F.col("_len").alias("l"), (-F.col(idx_col)).alias("ni"))).alias("_long"),
    )
    g = g.where((F.col("n_right") >= 2) & (F.col("_short.l") != F.col("_long.l")))
    return g.select(
        group_col, F.col("_short.i").alias("chosen_idx"), (-F.col("_long.ni")).alias("rejected_idx"),
        F.col("_short.l").alias("chosen_len"), F.col("_long.l").alias("rejected_len"),
    )


def group_advantage(scored: DataFrame, group_col: str, reward_col: str) -> DataFrame:
    """(r - mean) / (std_pop + 1e-8) per prompt group; 0 when std = 0.

    Mean and deviation come from one aggregation per group joined back; equal
    rewards have deviation 0 exactly. The rows are written once before both
    reads, so nothing is scored twice and a hot group's rows are a join side
    that Spark can split: project to ids and reward first.
    """
    r = F.col(reward_col)
    scored = cut_lineage(scored)
    std = F.when(F.min(r) == F.max(r), F.lit(0.0)).otherwise(F.stddev_pop(r))
    g = cut_lineage(scored.groupBy(group_col).agg((F.sum(r) / F.count(r)).alias("_mean"), std.alias("_std")))
    out = scored.join(g, group_col)
    adv = F.when(F.col("_std") == 0, F.lit(0.0)).otherwise((r - F.col("_mean")) / (F.col("_std") + F.lit(ADV_EPS)))
    return out.withColumn("advantage", adv).withColumnRenamed("_mean", "group_mean").withColumnRenamed("_std", "group_std")


def reward_gap(pairs: DataFrame) -> DataFrame:
    """gap = chosen - rejected reward; weight = gap / mean gap (one scalar aggregate)."""
    gap = F.col("chosen_reward") - F.col("rejected_reward")
    # the mean and the rows both read the pairs: materialize them once
    p = cut_lineage(pairs.withColumn("gap", gap))
    mean_gap = p.select(F.sum(F.col("gap").cast("decimal(38,12)")).cast("double") / F.count("gap")).scalar()
    return p.withColumn("weight", F.when(mean_gap != 0, F.col("gap") / mean_gap))


def pairs_best_worst(scored: DataFrame, group_col: str, idx_col: str, reward_col: str) -> DataFrame:
    """best = chosen, worst = rejected (ties: lowest index); skip equal rewards."""
    r, i = F.col(reward_col), F.col(idx_col)
    g = scored.groupBy(group_col).agg(
        F.max(F.struct(r.alias("r"), (-i).alias("ni"))).alias("_best"),
        F.min(F.struct(r.alias("r"), i.alias("i"))).alias("_worst"),
    )
    g = g.where(F.col("_best.r") != F.col("_worst.r"))
    return g.select(
        group_col, (-F.col("_best.ni")).alias("chosen_idx"), F.col("_worst.i").alias("rejected_idx"),
        F.col("_best.r").alias("chosen_reward"), F.col("_worst.r").alias("rejected_reward"),
    )


def difficulty_balance(scored: DataFrame, group_col: str, right_col: str, seed_key: Column | None = None) -> DataFrame:
    """difficulty = share of right responses; buckets hard/moderate/easy; keep the
    same number of prompts per bucket (the count of the smallest bucket that has
    any), by seeded hash. ``n_buckets`` says how many of the three have prompts.

    Position inside a bucket uses ``ordered_index`` (range partitions), since one
    bucket can hold a third or more of all prompts.
    """
    d = scored.groupBy(group_col).agg(F.avg(F.col(right_col).cast("double")).alias("difficulty"))
    lo, hi = DIFFICULTY_CUTS
    bucket = F.when(F.col("difficulty") < lo, "hard").when(F.col("difficulty") < hi, "moderate").otherwise("easy")
    d = d.withColumn("bucket", bucket).withColumn("_h", seed_key if seed_key is not None else T.seeded_hash_key(F.col(group_col)))
    d = cut_lineage(d)  # one row per prompt, read three times below
    counts = d.groupBy("bucket").count()
    keep = counts.agg(F.min("count")).scalar()
    n_buckets = counts.agg(F.count(F.lit(1))).scalar()
    idx = ordered_index(d, ["_h", group_col], ["bucket"], "_i")
    return idx.where(F.col("_i") < keep).drop("_i", "_h").withColumn("n_buckets", n_buckets)


def preference_loss_audit(seq: DataFrame, pair_col: str, beta: float = DPO_BETA, digits: int = 6) -> DataFrame:
    """DPO sigmoid loss and margin, ORPO odds-ratio term, from logged log-probs.

    ``seq`` holds one row per (pair, side) with side in {chosen, rejected} and
    sums/means of policy and reference log-probs: logp, logp_ref, mean_logp.
    """
    wide = seq.groupBy(pair_col).agg(
        *[
            F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}")
            for s in ("chosen", "rejected")
            for c in ("logp", "logp_ref", "mean_logp")
        ]
    ).where(F.col("chosen_logp").isNotNull() & F.col("rejected_logp").isNotNull())
    margin = (F.col("chosen_logp") - F.col("chosen_logp_ref")) - (F.col("rejected_logp") - F.col("rejected_logp_ref"))

    def softplus_neg(x: Column) -> Column:  # -ln(sigmoid(x)) = ln(1 + e^-x)
        return F.greatest(-x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))

    def log_odds(m: Column) -> Column:  # ln(p / (1 - p)) with p = e^m; p = 1 as the limit
        m = F.least(m, F.lit(-1e-300))
        return m - F.log(-F.expm1(m))

    lo = log_odds(F.col("chosen_mean_logp")) - log_odds(F.col("rejected_mean_logp"))
    return wide.select(
        pair_col,
        margin.alias("margin"),
        F.round(softplus_neg(F.lit(beta) * margin), digits).alias("dpo_loss"),
        F.round(softplus_neg(lo), digits).alias("or_loss"),
    )


def preference_loss_summary(audit: DataFrame) -> DataFrame:
    """D7 summary: pairs, mean DPO loss, mean odds-ratio loss, share of pairs with margin > 0."""
    return audit.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        (F.sum(F.col("dpo_loss").cast("decimal(38,12)")).cast("double") / F.count("dpo_loss")).alias("mean_dpo_loss"),
        (F.sum(F.col("or_loss").cast("decimal(38,12)")).cast("double") / F.count("or_loss")).alias("mean_or_loss"),
        (F.sum((F.col("margin") > 0).cast("int")) / F.count(F.lit(1))).alias("share_positive_margin"),
    )
