"""Exact dedup: two-pass Bloom filtering, then an exact join of what may repeat."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import SPACE, by_value, documents

by_value(__name__)

FILTER_BYTES = 32 << 20  # most bytes of one round's filter; a task that builds it holds two such
CELLS_PER_ROW = 16
PROBES = 4
SEGMENT = 1 << 16  # cells per segment of a filter


def _cells(digest: np.ndarray, cells: int) -> np.ndarray:
    """PROBES cells per digest: double hashing of its two 64-bit words."""
    a, b = digest[:, 0], digest[:, 1] | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((a[:, None] + steps * b[:, None]) % np.uint64(cells)).astype(np.int64)


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:16] for d in column), dtype="<u8").reshape(-1, 2)


def _set_bits(packed: np.ndarray, at: np.ndarray) -> None:
    """Set the bits at sorted distinct places ``at``."""
    if len(at):
        byte = at >> 3
        first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
        packed[byte[first]] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), first)


def _two_bits(cells: int):
    """One task's filter: per cell, a bit whether it was hit once and one whether twice."""

    def run(batches):
        once, twice = (np.zeros(-(-cells // 8), dtype=np.uint8) for _ in range(2))
        for pdf in batches:
            if len(pdf):
                at = np.sort(_cells(_words(pdf["digest"]), cells), axis=1)
                own = np.c_[np.ones(len(at), dtype=bool), at[:, 1:] != at[:, :-1]]  # a row hits a cell once
                hit, n = np.unique(at[own], return_counts=True)
                known = (once[hit >> 3] >> (7 - (hit & 7)).astype(np.uint8)) & 1
                _set_bits(twice, hit[(n > 1) | (known == 1)])
                _set_bits(once, hit)
        step = SEGMENT // 8
        for low in range(0, len(once), step):
            part = once[low : low + step]
            if part.any():
                bits = np.r_[part, twice[low : low + step]]
                yield pd.DataFrame({"segment": [low // step], "bits": [zlib.compress(bits.tobytes(), 1)]})

    return run


def _merge(key: tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A segment's filters of all tasks -> the cells hit twice over all of them."""
    once = twice = None
    for pdf in batches:
        for packed in pdf["bits"]:
            first, second = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(2, -1)
            twice = second.copy() if once is None else twice | second | (once & first)
            once = first.copy() if once is None else once | first
    yield pd.DataFrame({"segment": [key[0]], "bits": [zlib.compress(twice.tobytes(), 1)]})


def repeat_filter(hashes: DataFrame, cells: int) -> np.ndarray:
    """First pass: the cells that two rows hit, one bit each (``cells`` / 8 bytes travel)."""
    made = hashes.select("digest").mapInPandas(_two_bits(cells), "segment long, bits binary")
    merged = made.groupBy("segment").applyInPandas(_merge, "segment long, bits binary")
    out = np.zeros(-(-cells // 8), dtype=np.uint8)
    for row in merged.toLocalIterator():
        bits = np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
        at = row["segment"] * (SEGMENT // 8)
        out[at : at + len(bits)] = bits
    return out


def _possible(bits, cells: int):
    def run(digest: pd.Series) -> pd.Series:
        packed = np.frombuffer(bits.value, dtype=np.uint8)
        at = _cells(_words(digest), cells)
        return pd.Series(((packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool).all(axis=1))

    return run


def flag_possible_repeats(hashes: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Add ``maybe``: false only where no other row has the digest.

    The filter grows with the rows up to ``filter_bytes``; beyond that the
    digests are split by their own bits into as many rounds as are needed, each
    with a filter of its own, so what a task holds stays bounded.
    """
    spark: SparkSession = hashes.sparkSession
    rows = hashes.count()
    rounds = max(1, -(-rows * CELLS_PER_ROW // (filter_bytes * 8)))
    cells = max(1024, -(-rows * CELLS_PER_ROW // rounds))
    turn = F.pmod(F.conv(F.hex(F.expr("substring(digest, 17, 7)")), 16, 10).cast("long"), F.lit(rounds))
    flagged = None
    for r in range(rounds):
        own = hashes if rounds == 1 else hashes.where(turn == r)
        bits = spark.sparkContext.broadcast(repeat_filter(own, cells).tobytes())

        part = own.withColumn("maybe", F.pandas_udf(_possible(bits, cells), "boolean")("digest"))
        flagged = part if flagged is None else flagged.unionByName(part)
    return flagged


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one
    space; null counts as empty. The row with the smallest id stays; a null id
    comes after all others, and of rows with one id the first in the input
    stays, so exactly one row of a group is kept. Rows whose digest the filter
    has seen once pass through without a shuffle; the others join their group's
    count on the digest. An empty table gives no rows; other columns are not
    read.
    """
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    hashes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("rid"),
    )
    hashes = flag_possible_repeats(cut_lineage(hashes), filter_bytes)
    hashes = hashes.withColumn("place", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid"))
    alone = hashes.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    again = hashes.where("maybe")
    # written, so that a hot digest is a join key that Spark can split
    groups = cut_lineage(again.groupBy("digest").agg(F.min("place").alias("best"), F.count(F.lit(1)).alias("group_size")))
    matched = again.join(groups, "digest").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("place") == F.col("best")).alias("kept"), "digest"
    )
    return alone.unionByName(matched).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op3_exact_dedup(spark, sf_dir):
    return exact_groups(documents(spark, sf_dir, "doc_id", "text"))


ORACLE = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from t window g as (partition by text_sha256)
"""
