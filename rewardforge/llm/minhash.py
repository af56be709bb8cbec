"""MinHash near-dedup: b-bit signatures, a multi-index Hamming join, links confirmed on full sets.

A signature has CHUNKS chunks of CHUNK_SYMBOLS symbols. If two signatures
differ in at most 2 * CHUNKS - 1 symbols, some chunk differs in at most one, so
they share one of the keys that leave one symbol of a chunk out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, materialize
from .common import by_value, documents
from .simhash import connected

by_value(__name__)

SHINGLE_WORDS = 4
SIMILARITY = (80, 100)  # intersection : union of linked sets, at least
CHUNKS, CHUNK_SYMBOLS = 16, 5
SYMBOLS = CHUNKS * CHUNK_SYMBOLS
SYMBOL_BYTES = 2  # b = 16 bits
MAX_ERRORS = 2 * CHUNKS - 1  # every pair of signatures up to here shares a key
BLOCK = 2048  # nodes that are compared with as many others at once
HOME_STEPS = 1  # small families join the one their smallest node belongs to
NEAREST = 2  # candidates of a node that are read first
MAP_LOAD, MAP_BITS = 4, 1 << 15  # bits per shingle of a set's bitmap, at most bits of a bitmap
SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BATCH = 1 << 19  # shingles that are hashed at once
_KNOWN = 1 << 19  # words whose hash a task keeps
_FOLD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_draw = np.random.default_rng(SEED)
_XOR = _draw.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64)
_TIMES = _draw.integers(0, 1 << 64, SYMBOLS, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    w = np.array([hashes[x] for x in words], dtype=np.uint64)
    own = min(k, len(w))
    out = np.full(len(w) - own + 1, own, dtype=np.uint64)
    for i in range(own):
        out = _mixed(out ^ w[i : len(w) - own + 1 + i]) * _FOLD[i % len(_FOLD)]
    return np.unique(out)


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of symbols per (non-empty) set: the low bits of the least permuted hash."""
    all_ = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), SYMBOLS), dtype=">u2")
    room = np.empty_like(all_)
    for i in range(SYMBOLS):
        np.bitwise_xor(all_, _XOR[i], out=room)
        np.multiply(room, _TIMES[i], out=room)
        out[:, i] = (np.minimum.reduceat(room, starts) >> np.uint64(16)).astype(np.uint16)
    return out


def bitmap(members: np.ndarray) -> bytes:
    """One bit per shingle, by the low bits of its hash; a power of two of bits that follows the set."""
    bits = min(MAP_BITS, max(64, 1 << (MAP_LOAD * len(members) - 1).bit_length()))
    out = np.zeros(bits, dtype=np.uint8)
    out[(members & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).tobytes()


def sketch_udf(k: int):
    """(n, members, signature, map) of a text: size of its set, 128-bit hash of the set, symbols, bitmap."""

    def run(text: pd.Series) -> pd.DataFrame:
        hashes = _Hashes()
        sizes, members, signatures, maps = [], [], [], []
        waiting: list[np.ndarray] = []

        def flush():
            live = [s for s in waiting if len(s)]
            rows = iter(_signatures(live)) if live else iter(())
            for s in waiting:
                sizes.append(len(s))
                members.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(next(rows).tobytes() if len(s) else None)
                maps.append(bitmap(s) if len(s) else None)
            waiting.clear()

        held = 0
        for t in text:
            waiting.append(shingle_set(t, k, hashes))
            held += len(waiting[-1])
            if held >= _BATCH:
                flush()
                held = 0
        flush()
        return pd.DataFrame({"n": np.array(sizes, dtype=np.int64), "members": members, "signature": signatures, "map": maps})

    return F.pandas_udf(run, "n long, members binary, signature binary, map binary")


def _folded(words: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many bits (rows of bytes): the halves together."""
    half = words.shape[1] // 2
    return words[:, :half] | words[:, half:]


def _by_size(maps: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bytes of a bitmap -> (places, bitmaps as rows)."""
    ends, held = np.frombuffer(maps.buffers()[1], dtype=np.int32)[maps.offset :][: len(maps) + 1], np.frombuffer(maps.buffers()[2], dtype=np.uint8)
    lengths = np.diff(ends)
    out = {}
    for n in set(lengths.tolist()):
        at = np.flatnonzero(lengths == n)
        out[n] = at, held[ends[at][:, None] + np.arange(n)]
    return out


def _possible(x: dict, y: dict, nx: np.ndarray, ny: np.ndarray, part: int, whole: int):
    """(i, j, unlike bits) of the pairs of nodes that may link, by sizes and bitmaps.

    A bit that only one of two bitmaps has stands for a shingle that only one of
    the sets has, so no pair that links is left out. Sets that may link have
    bitmaps of one size or of neighbouring sizes.
    """
    found = []
    for n, (i, a) in x.items():
        for m in (n // 2, n, n * 2):
            if m in y and len(i) and len(y[m][0]):
                j, b = y[m]
                p, q = (np.ascontiguousarray(_folded(t) if of > to else t).view("<u8") for t, of, to in ((a, n, m), (b, m, n)))
                for row, own in zip(i.tolist(), p):
                    unlike = np.bitwise_count(own ^ q).sum(axis=1)
                    both, least, most = nx[row] + ny[j], np.minimum(nx[row], ny[j]), np.maximum(nx[row], ny[j])
                    near = np.flatnonzero((unlike * (whole + part) <= (whole - part) * both) & (least * whole >= most * part))
                    if len(near):
                        found.append((np.full(len(near), row), j[near], unlike[near]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3


def _among(maps: dict, kept: np.ndarray) -> dict:
    return {n: (at[own], rows[own]) for n, (at, rows) in maps.items() if (own := kept[at]).any()}


def _compare(part: int, whole: int, nearest: int):
    """Two blocks of nodes -> pairs of nodes of different classes to read.

    Of a node's candidates in other classes, the ``nearest`` ones.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, node, root, n = (table[c].to_numpy() for c in ("block", "node", "root", "n"))
        maps = _by_size(table["map"].combine_chunks())
        p, q = (k.as_py() for k in key)
        roots, times = np.unique(root, return_counts=True)
        main = root == roots[times.argmax()]  # nodes of the commonest class are not compared with each other
        found = []
        for x, y in ((main, ~main), (~main, ~main if p == q else ~main | main)):
            found.append(_possible(_among(maps, x & (block == p)), _among(maps, y & (block == q)), n, n, part, whole))
        i, j, unlike = (np.concatenate(c) for c in zip(*found))
        if p == q:  # a pair has one order, the same in every round
            turn = node[i] > node[j]
            i, j = np.where(turn, j, i), np.where(turn, i, j)
        live = (root[i] != root[j]) & (node[i] != node[j])
        i, j, unlike = i[live], j[live], unlike[live]
        order = np.lexsort((node[i], unlike, node[j]))
        i, j = i[order], j[order]
        once = np.r_[True, (node[i][1:] != node[i][:-1]) | (node[j][1:] != node[j][:-1])][: len(i)]
        i, j = i[once], j[once]
        start = np.r_[True, node[j][1:] != node[j][:-1]][: len(i)]
        at = np.arange(len(i))
        place = at - np.maximum.accumulate(np.where(start, at, 0)) if len(i) else at
        i, j = i[place < nearest], j[place < nearest]
        return pa.table({"x": node[i], "y": node[j], "rx": root[i], "ry": root[j]})

    return run


def _alike(k: int, part: int, whole: int):
    """Do the full sets of two texts link?"""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        hashes = _Hashes()
        kept: dict[str, np.ndarray] = {}

        def set_of(text: str) -> np.ndarray:
            if text not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[text] = shingle_set(text, k, hashes)
            return kept[text]

        out = []
        for s, t in zip(a, b):
            x, y = set_of(s), shingle_set(t, k, hashes)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(whole * both >= part * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    return F.pandas_udf(run, "boolean")


def chunk_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): for every chunk and each of its symbols, the chunk without that symbol."""
    at, out = F.floor(F.col("turn") / CHUNK_SYMBOLS).cast("int"), F.col("turn") % CHUNK_SYMBOLS
    start = at * (CHUNK_SYMBOLS * SYMBOL_BYTES) + 1
    skip = start + out * SYMBOL_BYTES
    turns = nodes.select("node", "signature", F.explode(F.sequence(F.lit(0), F.lit(SYMBOLS - 1))).alias("turn"))
    before = F.substring("signature", start, out * SYMBOL_BYTES)
    after = F.substring("signature", skip + SYMBOL_BYTES, (CHUNK_SYMBOLS - 1 - out) * SYMBOL_BYTES)
    return turns.select(F.xxhash64("turn", F.concat(before, after)).alias("key"), "node")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, similarity: tuple[int, int]) -> DataFrame:
    """Those ``pairs`` (x, y of nodes, rx, ry of their classes) whose full sets link, as
    links between classes. ``pairs`` are written, so a hot node's can be split."""
    ends = [texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in "xy"]
    linked = pairs.join(ends[0], "x").join(ends[1], "y").where(_alike(k, *similarity)("tx", "ty"))
    return cut_lineage(linked.select(F.col("rx").alias("x"), F.col("ry").alias("y")).distinct())


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) once the classes that ``links`` join are one."""
    to = cut_lineage(connected(links).select(F.col("node").alias("root"), F.col("root").alias("to")))
    return cut_lineage(roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")))


def _blocks(held: DataFrame) -> DataFrame:
    """(node, block): nodes dealt into blocks of about BLOCK.

    From a node one goes to the smallest node of its keys, and HOME_STEPS times
    on from there; the nodes that come to the same one are a family. A
    class that most of a family belongs to has blocks of its own, which are
    never compared with each other; the rest of the family has others.
    """
    home = materialize(held.groupBy("node", "root").agg(F.min("least").alias("home")), "homes")
    for _ in range(HOME_STEPS):
        home = home.join(home.select(F.col("node").alias("home"), F.col("home").alias("next")), "home")
        home = materialize(home.select("node", "root", F.col("next").alias("home")), "homes")
    classes = home.groupBy("home", "root").agg(F.count(F.lit(1)).alias("n"))
    main = materialize(classes.groupBy("home").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")), "homes")
    of_main = (F.col("root") == F.col("top.root")) & (2 * F.col("top.n") > F.col("all"))
    family = home.join(main, "home").select("node", of_main.alias("main"), F.when(of_main, F.col("root")).otherwise(F.col("home")).alias("family"))
    family = materialize(family, "homes")
    sizes = materialize(family.groupBy("family", "main").agg(F.count(F.lit(1)).alias("n")), "homes")
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK))
    return family.join(sizes, ["family", "main"]).select("node", F.xxhash64("family", "main", salt).alias("block"))


def _block_pairs(held: DataFrame, blocks: DataFrame) -> DataFrame:
    """(p, q): pairs of blocks, and each block with itself, that share a key."""
    seen = materialize(held.join(blocks, "node").select("key", "block").distinct(), "blocks")
    mate = seen.select("key", F.col("block").alias("q"))
    pairs = seen.select("key", F.col("block").alias("p")).join(mate, "key").where("p <= q")
    return materialize(pairs.select("p", "q").distinct(), "blocks")


def _open(held: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (key, node, least, root) of keys that hold several classes."""
    named = materialize(held.join(roots, "node"), "members")
    split = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    return materialize(named.join(materialize(split, "keys"), "key"), "members")


def _classes(nodes: DataFrame, texts_of, k: int, similarity: tuple[int, int]) -> DataFrame:
    """(node, root): the smallest node that each node reaches over links.

    Every pair that shares a key is decided, but none whose ends are already
    known to be connected. First each node meets the smallest node of its keys.
    Then the nodes of keys that still hold several classes are compared block
    by block on their bitmaps, and what may link is read: of each node the
    nearest NEAREST candidates per pair of blocks, then, where classes are still
    apart, all.
    """
    keys = chunk_keys(nodes)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1")
    held = materialize(keys.join(materialize(shared, "keys"), "key"), "members")
    roots = nodes.select("node", F.col("node").alias("root"))
    if held.isEmpty():
        return roots
    texts = texts_of(held.select("node").distinct())
    first = held.where("node <> least").groupBy(F.col("node").alias("y")).agg(F.min("least").alias("x"))
    first = cut_lineage(first.select("x", "y", F.col("x").alias("rx"), F.col("y").alias("ry")))
    roots = _merged(roots, _linked(first, texts, k, similarity))
    held = _open(held, roots)
    blocks = materialize(_blocks(held), "blocks")
    pairs = _block_pairs(held, blocks)
    rows = materialize(nodes.select("node", "n", "map").join(blocks, "node"), "rows")
    for nearest in (NEAREST, 1 << 62):  # the second time, all that are still apart
        own = materialize(rows.join(roots, "node"), "rows")
        apart = pairs
        for c in "pq":  # blocks of one and the same class need no comparison
            apart = apart.join(own.groupBy(F.col("block").alias(c)).agg(F.min("root").alias(f"low{c}"), F.max("root").alias(f"high{c}")), c)
        apart = materialize(apart.where(F.least("lowp", "lowq") < F.greatest("highp", "highq")).select("p", "q"), "apart")
        left = apart.join(own, apart["p"] == own["block"])
        right = apart.where("p <> q").join(own, apart["q"] == own["block"])
        dealt = left.unionByName(right).groupBy("p", "q")
        near = dealt.applyInArrow(_compare(*similarity, nearest), "x long, y long, rx long, ry long")
        roots = _merged(roots, _linked(cut_lineage(near), texts, k, similarity))
    return roots


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct ``k``-word shingles (fewer words: all of
    them as one). Texts link when the intersection of their sets is at least
    ``similarity`` of the union; components go over links, and
    ``component_id`` is the smallest id reachable. Texts without words (null,
    empty, blanks) have an empty set and link with nothing. A pair is decided
    on its full sets if its signatures share a key (and a bitmap of the sets
    does not rule the link out): surely when they differ in at most MAX_ERRORS
    of SYMBOLS, and of pairs at exactly 80 % all but some 5 in 10^10. Sets are
    compared by 64-bit shingle hashes. Equal sets are one node, so copies are never paired. A null
    id comes after all others; ``kept`` marks one row per component (smallest
    id, of equal ids the first in the input), and every row without words.
    Very long texts are hashed whole; repeated rows stay; an empty table gives
    no rows; other columns are not read.
    """
    text = F.col(text_col)
    own_id, digest = F.col(id_col).alias("doc_id"), F.md5(text.cast("binary")).alias("digest")
    place = F.struct(F.col(id_col).isNull().alias("no_id"), own_id, F.monotonically_increasing_id().alias("rid")).alias("place")
    marked = docs.select(place, digest, sketch_udf(k)(text).alias("sketch"))
    marked = cut_lineage(marked.select("place", "digest", "sketch.n", "sketch.members", "sketch.signature", "sketch.map"))
    nodes = marked.where("n > 0").groupBy("members").agg(F.min(F.struct("place", "digest", "n", "signature", "map")).alias("f"))
    nodes = cut_lineage(nodes.select(F.monotonically_increasing_id().alias("node"), "members", "f.place", "f.digest", "f.n", "f.signature", "f.map"))

    def texts_of(wanted: DataFrame) -> DataFrame:
        """One text of each wanted node, found again by id and digest."""
        which = materialize(nodes.select("node", "digest", F.col("place.doc_id").alias("id")).join(wanted, "node"), "wanted")
        rows = docs.select(own_id, text.alias("text"), digest)
        found = rows.join(which, (rows["digest"] == which["digest"]) & rows["doc_id"].eqNullSafe(which["id"]))
        return materialize(found.select("node", "text").dropDuplicates(["node"]), "texts")

    named = nodes.select("members", "node", "place").join(_classes(nodes, texts_of, k, similarity), "node")
    classes = named.groupBy("root").agg(F.min("place").alias("first"))
    classes = cut_lineage(named.join(cut_lineage(classes), "root").select("members", "first"))
    out = marked.where("n > 0").join(classes, "members").select("place", "n", "first")
    out = out.unionByName(marked.where("n = 0").select("place", "n", F.col("place").alias("first")))
    return out.select("place.doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), (F.col("place") == F.col("first")).alias("kept"))


def op12_minhash(spark, sf_dir):
    out = near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
sets as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else [array_to_string(ws[i : i + 3], ' ') for i in range(1, len(ws) - 2)] end) as s from w),
one as (select s, min(doc_id) as node from (select doc_id, list_sort(s) as s from sets where len(s) > 0) group by s),
e as (select node, len(s) as n, unnest(s) as shingle from one),
shared as (select x.node as x, y.node as y, x.n as nx, y.n as ny, count(*) as i from e as x join e as y on x.shingle = y.shingle and x.node < y.node
  group by all),
link as (select x, y from shared where 100 * i >= 80 * (nx + ny - i)),
edge as (select x, y from link union all select y, x from link),
reach(node, spot) as (select node, node from one union select r.node, edge.y from reach as r join edge on edge.x = r.spot),
comp as (select node, min(spot) as root from reach group by node)
select doc_id, len(sets.s) as n_shingles, coalesce(root, doc_id) as component_id, doc_id = coalesce(root, doc_id) as kept
from sets left join one on list_sort(sets.s) = one.s left join comp on comp.node = one.node
"""
