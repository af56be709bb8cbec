"""SimHash near-dedup: fingerprints, a binary-trie self-join, connected classes."""

from __future__ import annotations

import math
from itertools import combinations
from typing import Any

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import by_value, documents, free_name, numbered

by_value(__name__)

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
LEAF_BITS = 14  # a subtrie handed to one task has about 2^14 leaves
NODE_LEAVES = 1 << 16  # beyond so many leaves a node's pairs are joined deeper down
DEEPER = 8
LAST_DEPTH = 56
FRONTIER = 1 << 18  # node pairs that a task holds at once
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_VOTES = 1 << 15  # shingles whose bits are counted at once


def fingerprint(text: str | None, k: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of one whole text; 0 when it has no words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    body = b" ".join(words)
    n = max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][:n].tolist()
    stops = ends[min(k, len(words)) - 1 :].tolist()
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(body[a:b], SEED) for a, b in zip(starts, stops)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for low in range(0, n, _VOTES):
        part = hashes[low : low + _VOTES].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n, bitorder="little").tobytes(), "little")


def fingerprint_udf(k: int = SHINGLE_WORDS):
    def run(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, k) for t in text], dtype=np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")


def trie_pairs(a: np.ndarray, b: np.ndarray | None, depth: int, errors: int, max_bits: int):
    """Index pairs (i, j) of sorted distinct uint64 leaves within ``max_bits``.

    ``a`` and ``b`` hold the leaves under two nodes of the binary trie at
    ``depth`` whose prefixes differ in ``errors`` bits; without ``b``, pairs
    i < j under one node. Node pairs go down together, a whole frontier at a
    time: children pair up, each unlike step costs one bit, and pairs over
    budget are pruned. A frontier over FRONTIER pairs is split and its parts
    are walked one after the other, so memory stays bounded.
    """
    same = b is None
    other = a if same else b
    if not len(a) or not len(other):
        return
    work = [(depth, np.array([[0, len(a), 0, len(other), errors]], dtype=np.int64))]
    while work:
        at, nodes = work.pop()
        if len(nodes) > FRONTIER:
            work += [(at, part) for part in np.array_split(nodes, 2)]
            continue
        single = (nodes[:, 1] - nodes[:, 0] == 1) & (nodes[:, 3] - nodes[:, 2] == 1)
        i, j = nodes[single, 0], nodes[single, 2]
        if len(i):
            near = np.bitwise_count(a[i] ^ other[j]) <= max_bits
            if same:
                near &= i < j
            if near.any():
                yield i[near], j[near]
        nodes = nodes[~single]
        if not len(nodes):
            continue
        bit = np.uint64(63 - at)

        def middle(leaves, low, high):
            head = leaves[low] >> bit >> np.uint64(1) << np.uint64(1) | np.uint64(1)
            return np.clip(np.searchsorted(leaves, head << bit), low, high)

        alow, ahigh, blow, bhigh, err = nodes.T
        amid, bmid = middle(a, alow, ahigh), middle(other, blow, bhigh)
        zero_one = np.c_[alow, amid, bmid, bhigh, err + 1]
        one_zero = np.c_[amid, ahigh, blow, bmid, err + 1]
        if same:  # a node with itself: its unlike children pair up once
            one_zero = one_zero[alow != blow]
        below = np.concatenate([np.c_[alow, amid, blow, bmid, err], np.c_[amid, ahigh, bmid, bhigh, err], zero_one, one_zero])
        live = (below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2]) & (below[:, 4] <= max_bits)
        if same:
            live &= (below[:, 0] != below[:, 2]) | (below[:, 1] - below[:, 0] > 1)
        if live.any():
            work.append((at + 1, below[live]))


def _join_subtries(depth: int, max_bits: int):
    """All leaves under a pair of trie nodes -> links that connect what they connect."""

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = key
        leaves = np.sort(pdf["fp"].to_numpy().view(np.uint64))
        heads = (leaves >> np.uint64(64 - depth)).astype(np.int64)
        a, b = leaves[heads == low], None if low == high else leaves[heads == high]
        other = a if b is None else b
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        links = []
        for i, j in trie_pairs(a, b, depth, (low ^ high).bit_count(), max_bits):
            for x, y in zip(a[i].view(np.int64).tolist(), other[j].view(np.int64).tolist()):
                rx, ry = root(x), root(y)
                if rx != ry:  # links inside a class that is already connected add nothing
                    parent[rx] = ry
                    links.append((x, y))
        return pd.DataFrame(links, columns=["x", "y"], dtype=np.int64)

    return run


def _deal(fps: DataFrame, depth: int, max_bits: int) -> DataFrame:
    """Each fingerprint under every pair (low, high) of nodes at ``depth`` that holds
    its node and differs in at most ``max_bits`` bits."""
    masks = [sum(1 << b for b in bits) for r in range(max_bits + 1) for bits in combinations(range(depth), r)]
    mask = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    mate = F.col("head").bitwiseXOR(F.col("mask"))
    dealt = fps.select("fp", F.shiftrightunsigned("fp", 64 - depth).alias("head"), mask.alias("mask"))
    return dealt.select("fp", F.least("head", mate).alias("low"), F.greatest("head", mate).alias("high"))


def _below(dealt: DataFrame, heavy: DataFrame, levels: int) -> DataFrame:
    """Add ``hot``: whether one node of the pair lies ``levels`` below (0: is) a heavy one."""
    for side in ("low", "high"):
        own = heavy.select(F.col("head").alias(side + "_up"), F.lit(True).alias(side + "_hot"))
        dealt = dealt.withColumn(side + "_up", F.shiftright(side, levels)).join(own, side + "_up", "left")
    hot = F.coalesce("low_hot", F.lit(False)) | F.coalesce("high_hot", F.lit(False))
    return dealt.select("fp", "low", "high", hot.alias("hot"))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, node_leaves: int = NODE_LEAVES) -> DataFrame:
    """Links (x, y) between distinct fingerprints of ``fps`` (column fp) that
    connect exactly the pairs within ``max_bits`` bits.

    The trie is cut first at a depth that follows the number of fingerprints.
    Node pairs there whose prefixes differ in at most ``max_bits`` bits are the
    tasks; each fingerprint goes to the pairs of its node. A pair with a node of
    more than ``node_leaves`` leaves (a large family of near copies) is not
    joined there: its leaves go on to the node pairs ``DEEPER`` levels below,
    and so on, so a task has at most 2 * ``node_leaves`` leaves. Under a node at
    depth 56 there are at most 256, the least ``node_leaves`` can be.
    """
    if node_leaves < 256:
        raise ValueError("node_leaves must be 256 or more")
    depth = min(24, max(6, math.ceil(math.log2(max(1, fps.count()))) - LEAF_BITS))
    links = above = None
    while True:
        nodes = fps.groupBy(F.shiftrightunsigned("fp", 64 - depth).alias("head")).count()
        heavy = cut_lineage(nodes.where(F.col("count") > node_leaves).select("head"))
        dealt = _deal(fps, depth, max_bits)
        if above is not None:  # the other pairs are joined already
            dealt = _below(dealt, *above).where("hot").drop("hot")
        last = heavy.isEmpty()
        dealt = dealt if last else _below(dealt, heavy, 0)
        now = dealt if last else dealt.where("not hot")
        found = now.select("fp", "low", "high").groupBy("low", "high").applyInPandas(_join_subtries(depth, max_bits), "x long, y long")
        links = found if links is None else links.unionByName(found)
        if last:
            return links
        fps = cut_lineage(dealt.where("hot").select("fp").distinct())
        levels = min(LAST_DEPTH - depth, DEEPER)
        above, depth = (heavy, levels), depth + levels


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links``: root is the smallest node reachable.

    Alternating star contraction: every node sends its larger neighbours, then
    its smaller ones, to the smallest it sees, until the links are the same set
    as before. Rounds grow with the logarithm of the longest chain; each is
    checkpointed. What a node joins is written, so that the links of a big
    star's centre can be split.
    """
    links = cut_lineage(links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").distinct())
    while True:
        both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        least = cut_lineage(least.select(F.col("x").alias("u"), F.least("x", "m").alias("m")))
        # large star: (u, v) with v > u becomes (v, m(u))
        large = cut_lineage(links.join(least, F.col("y") == F.col("u")).select("x", F.col("m").alias("y")).where("x <> y").distinct())
        # a link's larger end also learns its own smallest neighbour
        own = cut_lineage(large.groupBy("x").agg(F.min("y").alias("m")))
        small = large.join(own, "x").select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("l"))
        before, links = links, cut_lineage(small.select("l.x", "l.y").where("x <> y").distinct())
        if links.count() == before.count() and links.join(before, ["x", "y"], "left_anti").isEmpty():
            break
    roots = links.groupBy("x").agg(F.min("y").alias("root")).withColumnRenamed("x", "node")
    return roots.unionByName(links.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, fp (signed 64 bits), component_id, kept, rid.

    Fingerprints of ``k``-word shingles link at ``max_bits`` or fewer unlike
    bits; ``component_id`` is the smallest id reachable over links. Texts
    without words (null, empty) have fingerprint 0, linked like any other.
    Equal fingerprints are one trie leaf, so copies are never paired. A null id
    comes after all others (component_id is null only where all are). ``kept``
    marks one row per component: the smallest id, of equal ids the first in the
    input; ``rid`` is the row's place in the input. Repeated rows keep their
    rows; an empty table gives no rows; other columns are not read.
    """
    return _near_duplicates(docs, F.monotonically_increasing_id(), k, max_bits, id_col, text_col)


def _near_duplicates(docs: DataFrame, rid: Column, k: int, max_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    place = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), rid.alias("rid"))
    marked = cut_lineage(docs.select(place.alias("place"), fingerprint_udf(k)(F.col(text_col)).alias("fp")))
    leaves = cut_lineage(marked.groupBy("fp").agg(F.min("place").alias("least")))
    roots = connected(near_links(leaves.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    leaves = leaves.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = cut_lineage(leaves.groupBy("root").agg(F.min("least").alias("first")))
    by_fp = cut_lineage(leaves.join(classes, "root").select("fp", "first"))
    return marked.join(by_fp, "fp").select(
        "place.doc_id", "fp", F.col("first.doc_id").alias("component_id"), (F.col("place") == F.col("first")).alias("kept"), "place.rid"
    )


def keep_first(docs: DataFrame, k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The one row of each component that ``kept`` marks, with all columns of ``docs``, whatever their names."""
    rid = free_name(docs, "_rid")
    rows = numbered(docs, rid)
    kept = _near_duplicates(rows, F.col(rid), k, max_bits).where("kept").select(F.col("rid").alias(rid))
    return rows.join(kept, rid, "left_semi").drop(rid)


def fp_hex(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op4_simhash(spark, sf_dir):
    out = near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")
