"""Order-dependent numbering and prefix scans without a one-partition window.

A window that is partitioned only by a coarse key (a reward type, a split, a
bucket) sends every row of that key to one task. These helpers split each
group across range partitions instead:

* ``ordered_index`` gives the 0-based position of each row in its group
  under a total order: range partitioning on (group, order), positions inside
  each partition from ``monotonically_increasing_id``, and per-partition
  offsets from a small (partitions x groups) table.
* ``blocked_prefix`` computes running sums / maxima in that order: blocks of
  at most ``block_rows`` rows are scanned by an ordinary window, and a carry
  per block comes from a prefix over the block totals.

The order columns must form a unique key inside each group, so that a retried
task reproduces the same positions. Project to the columns you need first:
the range-partitioned rows are checkpointed as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_PID, _MID, _M0, _N, _OFF = "_rf_pid", "_rf_mid", "_rf_m0", "_rf_n", "_rf_off"


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where null equals null: a null group is a group."""
    renamed = right.select([F.col(c).alias(f"_rf_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_rf_r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_rf_r_{k}" for k in keys])


def ordered_index(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    group_cols: Sequence[str] = (),
    idx_col: str = "idx",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``idx_col``: 0-based rank of each row within ``group_cols`` by ``order_cols``."""
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_cols(group_cols), *_cols(order_cols)]
    ranged = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_PID, F.spark_partition_id())
        .withColumn(_MID, F.monotonically_increasing_id())
    )
    # Range bounds come from a sample; pin them (and the positions) once in the
    # shared checkpoint folder so both uses below read the same assignment.
    ranged = cut_lineage(ranged)
    stats = ranged.groupBy(_PID, *group_cols).agg(F.min(_MID).alias(_M0), F.count(F.lit(1)).alias(_N))
    before = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn(_OFF, F.coalesce(F.sum(_N).over(before), F.lit(0)))
    out = join_null_safe(ranged, stats.drop(_N), [_PID, *group_cols])
    return out.withColumn(idx_col, F.col(_OFF) + F.col(_MID) - F.col(_M0)).drop(_PID, _MID, _M0, _OFF)


def blocked_prefix(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    group_cols: Sequence[str],
    values: dict[str, tuple[str | Column, str]],
    inclusive: bool = True,
    block_rows: int = 1 << 20,
    idx_col: str | None = None,
) -> DataFrame:
    """Running aggregates in order within each group.

    ``values`` maps an output column to (input column, op) with op ``sum`` or
    ``max``. ``inclusive=False`` leaves the current row out (null when nothing
    precedes it). Adds the order index as ``idx_col`` when given.
    """
    idx = idx_col or "_rf_idx"
    indexed = ordered_index(df, order_cols, group_cols, idx)
    blk = "_rf_blk"
    indexed = indexed.withColumn(blk, F.floor(F.col(idx) / F.lit(block_rows)))
    for name, (src, _op) in values.items():
        indexed = indexed.withColumn(f"_rf_v_{name}", F.col(src) if isinstance(src, str) else src)

    agg = {"sum": F.sum, "max": F.max}
    frame_end = Window.currentRow if inclusive else -1
    local_w = Window.partitionBy(*group_cols, blk).orderBy(idx).rowsBetween(Window.unboundedPreceding, frame_end)
    for name, (_src, op) in values.items():
        indexed = indexed.withColumn(f"_rf_l_{name}", agg[op](f"_rf_v_{name}").over(local_w))

    totals = indexed.groupBy(*group_cols, blk).agg(
        *[agg[op](f"_rf_v_{name}").alias(f"_rf_t_{name}") for name, (_src, op) in values.items()]
    )
    carry_w = Window.partitionBy(*group_cols).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    for name, (_src, op) in values.items():
        totals = totals.withColumn(f"_rf_c_{name}", agg[op](f"_rf_t_{name}").over(carry_w))
    totals = totals.select(*group_cols, blk, *[f"_rf_c_{name}" for name in values])

    out = join_null_safe(indexed, totals, [*group_cols, blk])
    for name, (_src, op) in values.items():
        local, carry = F.col(f"_rf_l_{name}"), F.col(f"_rf_c_{name}")
        if op == "sum":
            combined = F.when(local.isNull() & carry.isNull(), F.lit(None)).otherwise(
                F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
            )
        else:
            combined = F.greatest(carry, local)
        out = out.withColumn(name, combined)
    drop = [blk] + [f"_rf_{k}_{n}" for n in values for k in ("v", "l", "c")]
    if idx_col is None:
        drop.append(idx)
    return out.drop(*drop)
