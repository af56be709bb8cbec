"""QA and preference scans: seeded sampling, chunking, batching."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.ordering import join_null_safe, ordered_index
from ..session import materialize

# --- Fixed values that must equal the reference's ---
CHUNK_SIZE = 1000
CHUNK_OUTPUT_TEXT = "This is a good response."
CHUNK_GATE = 0.5
# --- end of fixed values ---

SAMPLE_DIGITS = 4  # hex digits of a histogram of hashes
SAMPLE_CUT = 1 << 16  # hashes of a bin that are cut by sorting


def qa_sample(qa: DataFrame, n: int | None, split: str | None = "train", id_col: str = "qa_id", seed: int = T.SEED) -> DataFrame:
    """Rows of one split; all if ``n`` is None, else ``min(n, count)`` rows by a seeded hash order.

    The last hash that is kept is found first, from hashes alone, so the rows
    themselves pass one filter and are neither sorted nor written. Ids are
    unique; rows that share one are kept or left out together.
    """
    df = qa if split is None else qa.where(F.col("split") == split)
    if n is None:
        return df
    key = T.seeded_hash_key(F.col(id_col), seed=seed)
    last = _last_kept(df.select(key.alias("h")), n)
    return df if last is None else df.where(key <= last)


def _last_kept(hashes: DataFrame, n: int) -> str | None:
    """The n-th smallest hash (hex text, column h); None if there are no more than n.

    A histogram of the first SAMPLE_DIGITS digits says which bin holds it and how
    many rows come before; that bin is refined until it is small, then cut exactly.
    """
    if n <= 0:
        return ""  # below every hash
    prefix, left = "", n
    while True:
        digits = F.substring("h", len(prefix) + 1, SAMPLE_DIGITS)
        bins = sorted((r["d"], r["n"]) for r in hashes.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        if not prefix and sum(size for _, size in bins) <= n:
            return None
        for d, size in bins:  # at most 16 ** SAMPLE_DIGITS
            if left <= size:
                break
            left -= size
        prefix += d
        hashes = hashes.where(F.startswith(F.col("h"), F.lit(prefix)))
        if size <= SAMPLE_CUT or len(prefix) >= 32:
            return hashes.orderBy("h").limit(left).agg(F.max("h")).first()[0]


def preference_scan(raw: DataFrame) -> DataFrame:
    """Keep rows with both sides; a side is a message list (first content) or a string."""
    # try_element_at: an empty message list gives null instead of an ANSI index error
    chosen = F.coalesce(F.try_element_at("chosen_messages", F.lit(1))["content"], F.col("chosen_text"))
    rejected = F.coalesce(F.try_element_at("rejected_messages", F.lit(1))["content"], F.col("rejected_text"))
    keep = (F.col("chosen_messages").isNotNull() | F.col("chosen_text").isNotNull()) & (
        F.col("rejected_messages").isNotNull() | F.col("rejected_text").isNotNull()
    )
    return raw.where(keep).select(*[c for c in raw.columns if not c.startswith(("chosen_", "rejected_"))],
                                  chosen.alias("chosen"), rejected.alias("rejected"))


def chunk_assign(df: DataFrame, order_cols: list[str], chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """S3: global position in order, ``chunk_id = floor(idx / chunk_size)`` (last chunk may be short).

    Only the order columns (a unique key) are sorted and checkpointed; the other
    columns join their position and are not written.
    """
    idx = ordered_index(df.select(*order_cols), order_cols, [], "idx")
    idx = idx.withColumn("chunk_id", F.floor(F.col("idx") / F.lit(chunk_size)))
    return idx if set(df.columns) == set(order_cols) else join_null_safe(df, idx, order_cols)


def chunk_examples(
    chunks: DataFrame, epochs: DataFrame, order_cols: list[str], text_col: str = "chosen", head: int | None = None, input_chars: int | None = None
) -> DataFrame:
    """The rows of each chunk as (input, output), with ``n_epochs``: how many
    epochs train on them. Epoch e trains on chunk ``e % n_chunks`` when its
    reward > 0.5; chunks that no epoch trains on are left out.

    ``epochs`` holds (epoch, reward). One row per example, not per (epoch,
    example). Whole chunks and texts unless ``head`` rows or ``input_chars``
    characters are asked for.
    """
    text = F.col(text_col) if input_chars is None else F.substring(F.col(text_col), 1, input_chars)
    start = F.min("idx").over(Window.partitionBy("chunk_id"))  # a chunk is of bounded size
    rows = chunks.withColumn("row_in_chunk", (F.col("idx") - start + 1).cast("int"))
    rows = rows if head is None else rows.where(F.col("row_in_chunk") <= head)
    rows = rows.select("chunk_id", "row_in_chunk", *order_cols, text.alias("input"), F.lit(CHUNK_OUTPUT_TEXT).alias("output"))
    n_chunks = chunks.agg(F.max("chunk_id") + 1).scalar()
    gated = epochs.where(F.col("reward") > CHUNK_GATE).withColumn("chunk_id", F.pmod(F.col("epoch"), n_chunks))
    return rows.join(gated.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_epochs")), "chunk_id")


def batch_assign(
    df: DataFrame, id_col: str | Column, epochs: int, batch_size: int, seed: int = T.SEED, carry: Sequence[str] = ()
) -> DataFrame:
    """Per epoch a fresh seeded shuffle, then batches of ``batch_size`` (last may be short).

    Only the ids (unique) are shuffled and checkpointed; other columns join them.
    With ``carry`` (narrow columns) there is no join: the result has these
    columns and each row's epoch, idx and batch_id.
    """
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    ids = df.select(key.alias("_id"), *carry)
    if carry:  # written once: the range bounds read the rows too
        ids = materialize(ids, "batch-rows")
    e = ids.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("_h", F.unhex(T.seeded_hash_key(F.col("epoch"), F.col("_id"), seed=seed)))  # sorts like its hex text
    if dict(ids.dtypes)["_id"] != "string":
        e = e.withColumn("_text", F.col("_id").cast("string"))
    idx = ordered_index(e, ["_h", "_text" if "_text" in e.columns else "_id"], ["epoch"], "idx")
    idx = idx.withColumn("batch_id", F.floor(F.col("idx") / F.lit(batch_size))).drop("_h", "_text")
    if carry:
        return idx.drop("_id")
    if isinstance(id_col, str) and df.columns == [id_col]:
        return idx.withColumnRenamed("_id", id_col)
    return join_null_safe(df.withColumn("_id", key), idx, ["_id"]).drop("_id")
