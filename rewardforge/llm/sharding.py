"""Contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, running_totals

SHARDS = 16


def assign_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes plus 1), text_crc32, shard, slot.

    Rows are put in id order (null ids first; equal ids by their place in the
    input) and cut where the running size passes each multiple of total /
    shards, so every shard is a contiguous range of ids and its bytes differ
    from the target by less than the largest document. ``slot`` counts the rows
    of a shard from 0. A null text has size 1 and the crc of the empty string.
    With fewer rows than shards some shards stay empty; an empty table gives no
    rows. Other columns of ``docs`` are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    body = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    placed = running_totals(sizes, [], ["doc_id"], "size")
    total = placed.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1  # one number
    share = placed.withColumn("shard", F.expr(f"cast(cast(before as decimal(20,0)) * {shards} div {total} as int)"))
    first = share.groupBy("shard").agg(F.min("idx").alias("_first"))
    return share.join(first, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("idx") - F.col("_first")).cast("long").alias("slot")
    )


def op9_sharding(spark, sf_dir):
    return as_contract(assign_shards(documents(spark, sf_dir, "doc_id", "text")))


def as_contract(shards: DataFrame) -> DataFrame:
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )



# The CRC-32 table comes from its rule: eight halvings of a byte, each odd value xor the polynomial.
ORACLE = """
with recursive bits(b, k, c) as (
  select range, 0, range from range(256)
  union all select b, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from bits where k < 8
), crc as (select list(c order by b) as t from bits where k = 8),
d as (select doc_id, encode(coalesce(text, '')) as body from documents),
t as (select doc_id, octet_length(body) + 1 as size,
  xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(body), '..'), lambda x: ('0x' || x)::bigint)),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) as text_crc32 from d, crc),
p as (select *, sum(size) over (order by doc_id) - size as before, sum(size) over () as total from t)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, (before * 16 // total)::int as shard,
  row_number() over (partition by before * 16 // total order by doc_id) - 1 as slot, null::int as grown_shard
from p
"""
