"""Search-tree analytics over logged nodes and rollouts.

The search loop itself is not run; its arithmetic over logged tables is:
paths by pointer doubling, reward backup by pre-aggregating rollouts per leaf before the path join (the root is
on every path), weights by a closed form over prefix counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.mathx import round_sig
from ..session import materialize
from .ordering import ordered_index

# --- Fixed values that must equal the reference's ---
UCB_C = 1.414
LENGTH_PENALTY = 0.1
DIRECTION_RIGHT, DIRECTION_WRONG = 1.0, -0.5
WEIGHT_START = 1.0
WEIGHT_FLOOR = 0.1
# factors: reward > 0 -> right x1.1, wrong x0.95; reward <= 0 -> wrong x0.8, right x0.98
WEIGHT_FACTORS = {"pos_right": 1.1, "pos_wrong": 0.95, "neg_wrong": 0.8, "neg_right": 0.98}
# --- end of fixed values ---

# Teacher-weight parameters (ours; the notes give the rule, not the numbers).
TEACHER_ALPHA = 0.1
TEACHER_EPSILON = 0.05

BLOCK_ROWS = 1 << 18  # of a node's rollouts, folded at once

LN = {k: math.log(v) for k, v in WEIGHT_FACTORS.items()}
LN_FLOOR = math.log(WEIGHT_FLOOR)


@dataclass
class Paths:
    """T2 result: one row per node, and one row of ids per (node, ancestor)."""

    nodes: DataFrame  # node_id, query (the root's token), root columns, depth, context, binary_code
    ancestors: DataFrame  # node_id, ancestor_id, ancestor_depth, depth, ancestor_bit (null at the root)


def node_paths(nodes: DataFrame, root_cols: Sequence[str] = ()) -> Paths:
    """Path, context and bit string of every node that hangs on a root.

    Context of the root is its token; a child's is the parent's context + " " +
    token. The bit string of the root is empty; a child appends its bit.
    There may be many roots; a node whose parent is missing has no path. Every
    node points up its path and holds the stretch from there to itself; each
    round joins the stretch its target holds, so stretches double and the
    rounds are log2 of the depth. Each round's rows are written once. A cycle
    raises an error. Of ``root_cols`` every node gets its root's value.
    """
    top = F.col("parent_id").isNull()
    state = materialize(
        nodes.select(
            "node_id", F.col("parent_id").alias("up"), F.array("node_id").alias("path"),
            F.when(top, F.struct(F.col("token").alias("query"), *root_cols)).alias("root"),
            F.col("token").alias("context"), F.when(top, F.lit("")).otherwise(F.col("bit")).alias("binary_code"),
        ),
        "tree-paths",
    )
    done, rest = state.where("up is null"), state.where("up is not null")
    while True:
        target = done.unionByName(rest).select(F.col("node_id").alias("up"), *[F.col(c).alias(f"_{c}") for c in ("up", "root", "path", "context", "binary_code")])
        state = materialize(
            rest.join(target, "up").select(
                "node_id", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"), F.col("_root").alias("root"),
                F.concat(F.col("_context"), F.lit(" "), F.col("context")).alias("context"), F.concat("_binary_code", "binary_code").alias("binary_code"),
                F.array_contains("_path", F.col("node_id")).alias("cycle"),
            ),
            "tree-paths",
        )
        left, cycle = state.agg(F.count("up"), F.max("cycle")).first()
        if cycle:
            raise ValueError("the tree has a cycle")
        state = state.drop("cycle")
        done, rest = done.unionByName(state.where("up is null")), state.where("up is not null")
        if not left:
            break
    info = done.select("node_id", "root.*", (F.size("path") - 1).alias("depth"), "context", "binary_code")
    steps = done.select("node_id", (F.size("path") - 1).alias("depth"), "binary_code", F.posexplode("path").alias("ancestor_depth", "ancestor_id"))
    bit = F.when(F.col("ancestor_depth") > 0, F.substring("binary_code", F.col("ancestor_depth"), F.lit(1)))
    return Paths(info, steps.select("node_id", "ancestor_id", "ancestor_depth", "depth", bit.alias("ancestor_bit")))


def expand_nodes(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """Candidates (parent_id, token, bit, model, seq) -> children of each parent.

    Same token under one parent: the last insert (highest seq) wins, at the
    place of the first (lowest seq). ``parents`` holds node_id, context,
    binary_code.
    """
    g = candidates.groupBy("parent_id", "token").agg(
        F.min("seq").alias("place"),
        F.max_by(F.struct("seq", "bit", "model"), "seq").alias("w"),
    )
    p = parents.select(F.col("node_id").alias("parent_id"), F.col("context").alias("_pc"), F.col("binary_code").alias("_pb"))
    return g.join(p, "parent_id").select(
        "parent_id", "token", "place", F.col("w.seq").alias("winner_seq"), F.col("w.bit").alias("bit"), F.col("w.model").alias("model"),
        F.concat(F.col("_pc"), F.lit(" "), F.col("token")).alias("context"), F.concat(F.col("_pb"), F.col("w.bit")).alias("binary_code"),
    )


def candidate_union(nodes: DataFrame) -> DataFrame:
    """Each teacher's right tokens, then its wrong tokens, under one node."""
    base = nodes.where(F.col("parent_id").isNotNull()).select("parent_id", "model", "bit", "token", "node_id")
    right = base.where(F.col("bit") == "1").withColumn("dir_rank", F.lit(0))
    wrong = base.where(F.col("bit") == "0").withColumn("dir_rank", F.lit(1))
    return right.unionByName(wrong)


def token_set(nodes: DataFrame) -> DataFrame:
    """Distinct generated tokens per (node, direction, model)."""
    return (
        nodes.where(F.col("parent_id").isNotNull())
        .select("parent_id", F.when(F.col("bit") == "1", "right").otherwise("wrong").alias("direction"), "model", "token")
        .dropDuplicates()
    )


def backup_rewards(nodes: DataFrame, paths: Paths, rollouts: DataFrame) -> DataFrame:
    """Each rollout adds one visit and its reward to every node on its path.

    Rollouts are pre-aggregated per leaf (count, exact decimal sum) before the
    join to the ancestor table, so the root's group sees one row per leaf.
    """
    per_leaf = rollouts.groupBy(F.col("leaf_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("reward").cast("decimal(38,12)")).alias("s")
    )
    up = per_leaf.join(paths.ancestors.select("node_id", "ancestor_id"), "node_id").groupBy("ancestor_id").agg(
        F.sum("n").alias("visits"), F.sum("s").alias("s")
    )
    out = nodes.select("node_id").join(up.withColumnRenamed("ancestor_id", "node_id"), "node_id", "left")
    total = F.coalesce(F.col("s").cast("double"), F.lit(0.0))
    visits = F.coalesce(F.col("visits"), F.lit(0)).cast("bigint")
    return out.select(
        "node_id", visits.alias("visits"), total.alias("total_reward"),
        F.when(visits > 0, total / visits).otherwise(F.lit(0.0)).alias("avg_reward"),
    )


def parent_join(nodes: DataFrame, stats: DataFrame) -> DataFrame:
    """Each child with its parent's visits (self join on parent_id = node_id)."""
    child = nodes.select("node_id", "parent_id").where(F.col("parent_id").isNotNull()).join(stats, "node_id")
    parent = stats.select(F.col("node_id").alias("parent_id"), F.col("visits").alias("parent_visits"))
    return child.join(parent, "parent_id")


def node_weights(nodes: DataFrame, paths: Paths, rollouts: DataFrame, digits: int = 10, init: str = "one") -> DataFrame:
    """Weight after all rollouts, in rollout order, without a sequential fold.

    Per step the weight is multiplied by a factor and floored at 0.1. With
    S_t the running sum of ln(factor): weight = exp(S_T + max(0, max_t(ln 0.1 - S_t))).
    S_t is built from running counts of the four factor kinds, which are exact
    in any association order. An ancestor's bit is read off the path. A node
    starts at 1; with ``init="uniform"`` at 1 / its number of siblings (itself
    included; note Q12), which stands in the formula as ln(start) for the 0.
    """
    if init == "uniform":
        kids = nodes.where(F.col("parent_id").isNotNull()).groupBy("parent_id").agg((F.lit(1.0) / F.count(F.lit(1))).alias("start"))
        starts = nodes.select("node_id", "parent_id").join(kids, "parent_id", "left").select("node_id", F.coalesce("start", F.lit(WEIGHT_START)).alias("start"))
    elif init == "one":
        starts = nodes.select("node_id", F.lit(WEIGHT_START).alias("start"))
    else:
        raise ValueError(init)
    on_path = (
        rollouts.select(F.col("leaf_id").alias("node_id"), "iter", (F.col("reward") > 0).alias("pos"))
        .join(paths.ancestors.where(F.col("ancestor_depth") > 0), "node_id")
        .select(F.col("ancestor_id").alias("nid"), "iter", "pos", (F.col("ancestor_bit") == "1").alias("right"))
    )
    pos, right = F.col("pos"), F.col("right")
    kinds = {
        "pos_right": pos & right, "pos_wrong": pos & ~right, "neg_wrong": ~pos & ~right, "neg_right": ~pos & right,
    }

    def log_sum(prefix: str, missing: Column | None = None) -> Column:
        counts = {k: F.col(f"{prefix}_{k}") if missing is None else F.coalesce(f"{prefix}_{k}", missing) for k in kinds}
        return sum((c * F.lit(LN[k]) for k, c in counts.items()), F.lit(0.0))

    # Blocks of a node's rows are folded each on its own; only their totals meet. The number
    # of partitions is given: merged by their bytes, a task's rows would grow with the input.
    indexed = ordered_index(on_path, ["iter"], ["nid"], "i").select("nid", F.floor(F.col("i") / F.lit(BLOCK_ROWS)).alias("blk"), "i", "pos", "right")
    rows = indexed.repartition(int(indexed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "nid", "blk")
    run = Window.partitionBy("nid", "blk").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", *[F.sum(cond.cast("int")).over(run).alias(f"c_{k}") for k, cond in kinds.items()])
    blocks = rows.groupBy("nid", "blk").agg(
        F.max(F.lit(LN_FLOOR) - log_sum("c")).alias("m"), *[F.sum(cond.cast("int")).alias(f"t_{k}") for k, cond in kinds.items()]
    )
    before = Window.partitionBy("nid").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("*", *[F.sum(f"t_{k}").over(before).alias(f"b_{k}") for k in kinds])
    agg = blocks.groupBy("nid").agg(
        F.max(F.col("m") - log_sum("b", F.lit(0))).alias("m"), *[F.sum(f"t_{k}").alias(f"t_{k}") for k in kinds]
    )
    s_total = log_sum("t")
    w = starts.join(agg.select(F.col("nid").alias("node_id"), "m", s_total.alias("s_total")), "node_id", "left")
    # ln(1) is 0, also where the engines' logarithms differ in the last bit
    ln_start = F.when(F.col("start") == 1.0, F.lit(0.0)).otherwise(F.log("start"))
    grown = round_sig(F.exp(F.col("s_total") + F.greatest(ln_start, F.col("m"))), digits)
    return w.select("node_id", F.coalesce(grown, round_sig(F.col("start"), digits)).alias("weight"))


def ucb_score(joined: DataFrame, c: float = UCB_C, digits: int = 10) -> DataFrame:
    """T4: +inf if unvisited, else (avg + c sqrt(ln(parent visits) / visits)) * weight."""
    v = F.col("visits")
    score = (F.col("avg_reward") + F.lit(c) * F.sqrt(F.log(F.col("parent_visits")) / v)) * F.col("weight")
    return joined.withColumn("ucb", F.when(v == 0, F.lit(float("inf"))).otherwise(round_sig(score, digits)))


def text_cosine(pairs: DataFrame, key_cols: list[str], a: str | Column, b: str | Column) -> DataFrame:
    """Cosine of white-space token-count vectors of two texts (0 if one is empty).

    Both texts' tokens are sorted together inside the row, and one pass adds up
    the dot product and both squared norms: an occurrence more raises a squared
    count by 2c + 1 and the product by the other side's count. Integer sums, no
    shuffle, linear after the sort.
    """
    sides = F.concat(
        F.transform(F.coalesce(T.tokens(T.col(a)), F.array()), lambda t: F.struct(t.alias("t"), F.lit(True).alias("a"))),
        F.transform(F.coalesce(T.tokens(T.col(b)), F.array()), lambda t: F.struct(t.alias("t"), F.lit(False).alias("a"))),
    )
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("t"), *[zero.alias(c) for c in ("ca", "cb", "dot", "na", "nb")])

    def add(acc: Column, x: Column) -> Column:
        again = acc["t"] == x["t"]
        ca, cb = F.when(again, acc["ca"]).otherwise(zero), F.when(again, acc["cb"]).otherwise(zero)
        one_a, one_b = F.when(x["a"], F.lit(1)).otherwise(0), F.when(x["a"], F.lit(0)).otherwise(1)
        return F.struct(
            x["t"].alias("t"), (ca + one_a).alias("ca"), (cb + one_b).alias("cb"),
            (acc["dot"] + F.when(x["a"], cb).otherwise(ca)).alias("dot"),
            (acc["na"] + one_a * (ca * 2 + 1)).alias("na"), (acc["nb"] + one_b * (cb * 2 + 1)).alias("nb"),
        )

    sums = pairs.select(*key_cols, F.aggregate(F.sort_array(sides), start, add).alias("s")).select(*key_cols, "s.dot", "s.na", "s.nb")
    cos = F.when(F.col("na") * F.col("nb") == 0, F.lit(0.0)).otherwise(F.col("dot") / (F.sqrt("na") * F.sqrt("nb")))
    return sums.select(*key_cols, cos.alias("cosine"))


def top_child(scored: DataFrame, score_col: str) -> DataFrame:
    """Per parent the child with the highest score; ties go to the first inserted."""
    best = scored.groupBy("parent_id").agg(F.max(F.struct(F.col(score_col).alias("s"), (-F.col("node_id")).alias("ni"))).alias("b"))
    return best.select("parent_id", (-F.col("b.ni")).alias("node_id"), F.col("b.s").alias(score_col))


def best_path(nodes: DataFrame, paths: Paths, stats: DataFrame) -> DataFrame:
    """From each root follow the most visited child (tie: first inserted) to a leaf.

    ``answer`` is the text so far: the root's context plus the tokens down to the node.

    A node is on the path when every non-root node on its own path is the best
    child of its parent: ``bool_and`` over the ancestor table.
    """
    kids = nodes.select("node_id", "parent_id").where(F.col("parent_id").isNotNull()).join(stats.select("node_id", "visits"), "node_id")
    best = top_child(kids, "visits").select("node_id", F.lit(True).alias("is_best"))
    anc = paths.ancestors.where(F.col("ancestor_depth") > 0).join(best.withColumnRenamed("node_id", "ancestor_id"), "ancestor_id", "left")
    on = anc.groupBy("node_id").agg(F.bool_and(F.coalesce(F.col("is_best"), F.lit(False))).alias("on_path"))
    info = paths.nodes.join(on.where("on_path"), "node_id").join(nodes.select("node_id", "token"), "node_id")
    return info.select("node_id", "depth", "token", F.col("context").alias("answer"))


def path_reward(info: DataFrame, ppl_reward: DataFrame, terminal: DataFrame) -> DataFrame:
    """Ppl reward - 0.1 * path length (root counts) + sum over non-root path nodes
    (1 if its bit is 1 else -0.5) + hard reward when terminal.

    ``info``: node_id, depth, binary_code. ``ppl_reward``: node_id, ppl_reward.
    ``terminal``: node_id, terminal_reward (0 for nodes not judged complete).
    """
    ones = F.length("binary_code") - F.length(F.replace(F.col("binary_code"), F.lit("1"), F.lit("")))
    zeros = F.length("binary_code") - ones
    j = info.join(ppl_reward, "node_id", "left").join(terminal, "node_id", "left")
    j = j.select(
        "node_id",
        (F.col("depth") + 1).alias("path_len"),
        (ones * DIRECTION_RIGHT + zeros * DIRECTION_WRONG).alias("direction_reward"),
        F.coalesce("ppl_reward", F.lit(0.0)).alias("ppl_reward"),
        F.coalesce("terminal_reward", F.lit(0.0)).alias("terminal_reward"),
    )
    total = F.col("ppl_reward") + (-LENGTH_PENALTY) * F.col("path_len") + F.col("direction_reward") + F.col("terminal_reward")
    return j.withColumn("path_reward", F.round(total, 6))


def seeded_pick(df: DataFrame, group_col: str, id_col: str, *salt: Column) -> DataFrame:
    """One seeded-random member per group: min of md5(seed:salt:group:id)."""
    h = T.seeded_hash_key(*salt, F.col(group_col), F.col(id_col))
    return df.groupBy(group_col).agg(F.min(F.struct(h.alias("h"), F.col(id_col).alias("i"))).alias("m")).select(
        group_col, F.col("m.i").alias(id_col)
    )


def teacher_weights(uses: DataFrame, teachers: DataFrame, alpha: float = TEACHER_ALPHA, eps: float = TEACHER_EPSILON, digits: int = 6) -> DataFrame:
    """Smoothed reward per teacher and its sampling probability.

    score_n = (1-a)^n / N + a * sum_i (1-a)^(n-i) r_i over uses i = 1..n in order
    (a low-pass filter started at 1/N); p = (1 - eps) softmax(score) + eps / N.
    Positions come from ``ordered_index``, counted from a teacher's last use, so
    each term is known without the count and sums are partial (a teacher may hold
    most of the uses). The softmax takes one scalar sum.
    """
    n_teachers = teachers.agg(F.count(F.lit(1))).scalar()
    idx = ordered_index(uses.withColumn("_back", -F.col("iter")), ["_back"], ["model"], "i")
    s = idx.groupBy("model").agg(
        F.sum(F.pow(F.lit(1.0 - alpha), F.col("i")) * F.col("reward")).alias("acc"), F.count(F.lit(1)).alias("n")
    )
    all_t = teachers.join(s, "model", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    score = F.pow(F.lit(1.0 - alpha), F.col("n")) / n_teachers + F.lit(alpha) * F.coalesce("acc", F.lit(0.0))
    all_t = all_t.withColumn("score", F.round(score, 12))
    z = all_t.agg(F.sum(F.exp("score"))).scalar()
    p = F.lit(1.0 - eps) * F.exp("score") / z + F.lit(eps) / n_teachers
    return all_t.select("model", F.col("n").alias("n_uses"), F.round("score", digits).alias("score"), F.round(p, digits).alias("p"))
