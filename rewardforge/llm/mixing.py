"""Mixing sources to target weights with fixed-length token blocks.

Per source, the words of its documents (in id order) form one stream, cut into
blocks of ``block`` words. Every output shard draws how many of its slots each
source fills, a multinomial by what the sources still owe to their targets; a
keyed pseudorandom permutation of a source's block indexes says which block a
slot takes, and slots join blocks by (source, index). The mix is the blocks in
(shard, slot) order (``mix_segments``).
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORD, by_value, documents, free_name, named, numbered, running_totals, word_count

by_value(__name__)

BLOCK_WORDS = 256
SHARDS = 64
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
CHUNK = 1 << 16  # slots or blocks that one generated row stands for
_ROUNDS = 4


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source (``source``, ``key``, ``size``): its size and target words.

    Sources in code-point order (null last) take the weights in turn. Targets
    share the words of all sources by weight; none exceeds ``max_epochs`` times
    its source, and what is cut off goes to the others by weight. The fixed
    point is target = min(cap, level * weight): with sources sorted by cap per
    weight, the level comes from running sums. One row per source throughout.
    """
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    per_turn = F.array(*[F.lit(float(w)) for w in weights])
    sizes = sizes.withColumn("weight", F.get(per_turn, (F.row_number().over(in_order) - 1) % len(weights)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    everything = Window.partitionBy(F.lit(1))
    sizes = (
        sizes.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    )
    return sizes.select("key", "source", "source_size", F.least("cap", F.col("final") * F.col("weight")).alias("target"))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed bijection of [0, n): Feistel rounds over the next power of four,
    walked until the value falls inside."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for r in range(_ROUNDS):
            key = np.uint64((seed + 0x9E3779B97F4A7C15 * (r + 1)) % (1 << 64))
            left, right = right, left ^ (_mixed(right ^ key) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def draw_counts(slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source (column) in each shard (row).

    Shards are near equal in slots. Each draws a multinomial over the sources by
    the slots they have left; what a source has not left is drawn again, so the
    columns sum to ``slots``.
    """
    left = slots.astype(np.int64)
    out = np.zeros((shards, len(left)), dtype=np.int64)
    for shard in range(shards):
        rng = np.random.default_rng([seed, shard])
        open_slots = int(left.sum()) // (shards - shard)
        while open_slots:
            got = np.minimum(rng.multinomial(open_slots, left / left.sum()), left)
            out[shard] += got
            left = left - got
            open_slots -= int(got.sum())
    return out


def _passes(row, block: int, seed: int) -> tuple[int, int, int, int, int, int]:
    """Of a source: its blocks, words of the last one, whole passes, words of the
    cut pass, slots in all, and the key of its permutations."""
    size, target = int(row.source_size), int(round(row.target))
    own = (int(row.seed) ^ seed) % (1 << 63)
    n = -(-size // block)
    last = size - (n - 1) * block
    epochs, rest = divmod(target, size)
    cut = -(-rest // block)
    if cut > permuted(np.array([n - 1]), n, own + epochs)[0]:  # the short block is among them
        cut = -(-(rest + block - last) // block)
    return n, last, epochs, rest, epochs * n + cut, own


def _shard_draw(block: int, shards: int, seed: int):
    """Rows of all sources, in one task -> the same rows with their place in every shard."""

    def run(batches):
        pdf = pd.concat(list(batches) or [pd.DataFrame()], ignore_index=True)
        if len(pdf):
            pdf = pdf.sort_values("key", ignore_index=True)
            slots = np.array([_passes(row, block, seed)[4] for row in pdf.itertuples(index=False)])
            counts = draw_counts(slots, shards, seed)
            pdf["counts"] = list(counts.T)
            pdf["bases"] = list((counts.cumsum(axis=1) - counts).T)
            pdf["lengths"] = [counts.sum(axis=1)] * len(pdf)
            yield pdf

    return run


def _block_slots(block: int, seed: int):
    """Rows of blocks -> rows of the slots that take them."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                n, last, epochs, rest, _, own = _passes(row, block, seed)
                counts, bases, lengths = (np.asarray(x, dtype=np.int64) for x in (row.counts, row.bases, row.lengths))
                ends = counts.cumsum()
                blocks = np.arange(row.chunk * CHUNK, min(n, (row.chunk + 1) * CHUNK), dtype=np.int64)
                length = np.where(blocks == n - 1, last, block)
                for epoch in range(epochs + (rest > 0)):
                    key = own + epoch
                    place = permuted(blocks, n, key)
                    words = length
                    if epoch == epochs:
                        short = permuted(np.array([n - 1]), n, key)[0]
                        start = place * block - np.where(place > short, block - last, 0)
                        words = np.clip(rest - start, 0, length)
                    used = words > 0
                    nth = (epoch * n + place)[used]
                    shard = np.searchsorted(ends, nth, side="right")
                    slot = nth - (ends - counts)[shard] + bases[shard]  # sources one after the other
                    for s in np.unique(shard):  # and then mixed within the shard
                        here = shard == s
                        slot[here] = permuted(slot[here], int(lengths[s]), seed + int(s))
                    yield pd.DataFrame({"key": row.key, "block": blocks[used], "shard": shard, "slot": slot, "words": words[used]})

    return run


def mix_slots(targets: DataFrame, block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mix as slots: shard, slot (gapless from 0 in its shard), key (source), block index, words taken.

    A source passes through its blocks in permuted order, once per epoch, until
    its target is met to the word: its last slot takes only the head of its
    block. Which slots of which shard a source's blocks go to is drawn shard by
    shard (``draw_counts``) in one task that holds sources x shards counts.
    Draws and permutations are keyed by the source's name and ``seed``, so
    reruns agree.
    """
    spark = targets.sparkSession
    n_chunks = F.ceil(F.ceil(F.col("source_size") / block) / CHUNK)
    sources = targets.where("source_size > 0").select("key", "source_size", "target", F.xxhash64("key").alias("seed"))
    drawn = sources.coalesce(1).mapInPandas(
        _shard_draw(block, shards, seed),
        "key string, source_size long, target double, seed long, counts array<long>, bases array<long>, lengths array<long>",
    )
    chunks = drawn.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)))
    return chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "chunk").mapInPandas(
        _block_slots(block, seed), "key string, block long, shard int, slot long, words long"
    )


def _pieces(docs: DataFrame, rid: Column, weights, max_epochs, block, shards, id_col, text_col, source_col) -> tuple[DataFrame, DataFrame]:
    """(pieces of documents by block with ``takes``, targets by source).

    ``takes``: for each slot that takes words of this piece, how many (``n``,
    from its first word on), the shard and the slot; largest first. ``low`` is
    the piece's place in its block.
    """
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        rid.alias("rid"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("s"), source_col), F.lit("n")).alias("key"),
        word_count(F.col(text_col)).alias("size"),
    )
    placed = running_totals(cut_lineage(sized), ["key"], ["doc_id"], "size")  # words are counted once
    targets = source_targets(placed, weights, max_epochs)
    slots = mix_slots(targets, block, shards)
    takes = slots.groupBy("key", "block").agg(F.collect_list(F.struct("words", "shard", "slot")).alias("slots"))  # one per epoch at most
    first = F.floor(F.col("before") / block)
    last = F.greatest(first, F.floor((F.col("before") + F.col("size") - 1) / block))
    pieces = (
        placed.withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("low", F.greatest(F.col("before") - F.col("block") * block, F.lit(0)))
        .withColumn("high", F.least(F.col("before") + F.col("size") - F.col("block") * block, F.lit(block)))
        .join(takes, ["key", "block"], "left")
    )
    none = F.array().cast("array<struct<words:bigint,shard:int,slot:bigint>>")
    taken = F.transform(
        F.coalesce("slots", none),
        lambda s: F.struct((F.least(s["words"], F.col("high")) - F.col("low")).alias("n"), s["shard"].alias("shard"), s["slot"].alias("slot")),
    )
    pieces = pieces.select(
        "rid", "doc_id", "source", "key", "size", "low",
        (F.col("block") * block + F.col("low") - F.col("before")).alias("from_word"),
        F.sort_array(F.filter(taken, lambda s: s["n"] > 0), asc=False).alias("takes"),
    )
    return pieces, targets


def mix_documents(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    block: int = BLOCK_WORDS,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, taken,
    n_slots, first_shard, first_slot.

    ``size`` is the number of white-space words (null text: 0), ``taken`` how
    many words of the document the mix takes, repeats counted; it never exceeds
    ``max_epochs`` times the size. ``n_slots`` slots of the mix hold words of the
    document, the first of them at (``first_shard``, ``first_slot``), null where
    none does. The taken words of a source are its target, rounded. A null
    source is a source of its own. A source of empty texts has target 0; an
    empty table gives no rows. Repeated rows are documents of their own, also
    under one id. A long text is a row per block it lies in. Other columns are
    not read.
    """
    pieces, targets = _pieces(docs, F.monotonically_increasing_id(), weights, max_epochs, block, shards, id_col, text_col, source_col)
    taken = F.aggregate("takes", F.lit(0).cast("long"), lambda acc, s: acc + s["n"])
    places = F.transform("takes", lambda s: F.struct(s["shard"].alias("shard"), s["slot"].alias("slot")))
    per_doc = pieces.groupBy("rid", "doc_id", "source", "key", "size").agg(
        F.sum(taken).alias("taken"), F.sum(F.size("takes")).alias("n_slots"), F.min(F.array_min(places)).alias("at")
    )
    return per_doc.join(targets.drop("source"), "key").select(
        "doc_id", "size", "source", "source_size", "target", "taken", "n_slots",
        F.col("at.shard").alias("first_shard"), F.col("at.slot").alias("first_slot"),
    )


def _segments(batches):
    """Rows of a text and its cuts -> a row per slot that takes words of it."""
    for pdf in batches:
        for text, source, doc_id, cuts in zip(pdf["text"], pdf["source"], pdf["doc_id"], pdf["cuts"]):
            words = [m.span() for m in re.finditer(WORD, text)]
            rows = [
                (t["shard"], t["slot"], c["low"], source, doc_id, t["n"], text[words[c["from_word"]][0] : words[c["from_word"] + t["n"] - 1][1]])
                for c in cuts
                for t in c["takes"]
            ]
            for i in range(0, len(rows), 4096):
                yield pd.DataFrame(rows[i : i + 4096], columns=["shard", "slot", "at", "source", "doc_id", "n_words", "text"])


def mix_segments(
    docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS, shards: int = SHARDS
) -> DataFrame:
    """The mix itself: shard, slot, at, source, doc_id, n_words, text.

    A slot holds one block of one source; a block is the stretches of documents
    that lie in it, told apart by ``at``, their first word's place in the block.
    The mix in its order is the rows sorted by (shard, slot, at). ``text`` keeps
    the white space between its words. Texts without a word are not in the mix;
    an empty table gives no rows; columns beside doc_id, text and source are not
    read. An id must be a whole number or null.
    """
    rows = numbered(docs.select("doc_id", "text", "source"), "rid")
    pieces, _ = _pieces(rows, F.col("rid"), weights, max_epochs, block, shards, "doc_id", "text", "source")
    cuts = pieces.where(F.size("takes") > 0).groupBy("rid").agg(F.collect_list(F.struct("low", "from_word", "takes")).alias("cuts"))
    joined = rows.join(cuts, "rid").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "source", "cuts")
    out = joined.mapInPandas(_segments, "shard int, slot long, at long, source string, doc_id string, n_words long, text string")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def _texts(columns: list[str]):
    """Rows with ``cuts`` -> the same rows with the words that the mix takes."""

    def taken(text: str, size: int, cuts) -> str:
        out, words = [], None
        for copy in range(max(len(c["takes"]) for c in cuts)):
            runs: list[list[int]] = []
            for c in cuts:
                if copy < len(c["takes"]):
                    start, end = c["from_word"], c["from_word"] + c["takes"][copy]["n"]
                    if runs and runs[-1][1] == start:
                        runs[-1][1] = end
                    else:
                        runs.append([start, end])
            if runs == [[0, size]]:
                out.append(text)
                continue
            if words is None:
                words = [m.span() for m in re.finditer(WORD, text)]
            out += [text[words[a][0] : words[b - 1][1]] for a, b in runs]
        return "\n".join(out)

    def run(batches):
        for pdf in batches:
            texts = [taken(t, n, sorted(c, key=lambda x: x["from_word"])) for t, n, c in zip(pdf["text"], pdf["size"], pdf["cuts"])]
            pdf = pdf.assign(text=texts)
            if "n_chars" in columns:
                pdf["n_chars"] = [len(t) for t in texts]
            yield pdf[columns]

    return run


def mixed_texts(
    docs: DataFrame, weights: tuple = WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS, shards: int = SHARDS
) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``.

    ``text`` holds the words that the mix takes of a document, one line per
    stretch and repeats one after the other; a copy that is taken whole stays
    as it was, white space included. ``n_chars`` (if there) follows the new
    text. Documents of which the mix takes no word are left out. All other columns
    stay as they are, whatever their names.
    """
    rid, size, cut = (free_name(docs, c) for c in ("_rid", "_size", "_cuts"))
    rows = numbered(docs, rid)
    pieces, _ = _pieces(rows, F.col(rid), weights, max_epochs, block, shards, "doc_id", "text", "source")
    cuts = (
        pieces.where(F.size("takes") > 0)
        .groupBy("rid", "size")  # as many pieces as the document has blocks
        .agg(F.collect_list(F.struct("from_word", "takes")).alias("cuts"))
        .select(F.col("rid").alias(rid), F.col("size").alias(size), F.col("cuts").alias(cut))
    )
    joined = rows.join(cuts, rid)
    names = [f"c{i}" for i in range(len(docs.columns))]
    known = {"text": "text", "n_chars": "n_chars"}
    inner = [known.get(c, n) for c, n in zip(docs.columns, names)]
    plain = joined.select(*[named(c).alias(n) for c, n in zip(docs.columns, inner)], F.col(size).alias("size"), F.col(cut).alias("cuts"))
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(inner, docs.schema))
    return plain.mapInPandas(_texts(inner), schema).toDF(*docs.columns)


def op5_mixing(spark, sf_dir):
    out = mix_documents(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "n_slots", "first_shard", "first_slot")
