"""Phrase collocation mining: frequency-ranked symbols, tiled pair counts, level by level.

Level 1 ranks words by frequency. Each further level counts neighbouring pairs
of the level below: a frequent pair of words is ranked and becomes a symbol of
level 2, two overlapping ones make a phrase of three words, and so on. A pair
of ranks is a cell of a square; a task counts the busy tiles of that square in
dense arrays and the others as sorted (cell, count) lists.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import by_value, documents

by_value(__name__)

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
HEAD_WORDS = 1 << 18  # words that every task knows by rank
HEAD_PHRASES = 1 << 19  # phrases of a level that every task knows by rank
LONGEST_HEAD = 256  # bytes of a word that is known by rank
RANK_BITS = 20
TILE_BITS = 10
DENSE_TILES = 8  # dense arrays that a task holds
CHUNK = 1 << 20  # symbols that are counted at once
HELD = 1 << 22  # counts of sparse cells that a task holds
SLICE = 1 << 20  # bytes of a text that are split at once

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_END = b"\n"
BREAK = -1  # a symbol that no frequent phrase holds
_PAIRS = "a long, b long, c long"


def word_lists(text: str | None):
    """Words of a text as byte strings, with a line feed as a word between pieces."""
    body = (text or "").encode("utf-8", "replace").translate(_PLAIN)
    low = 0
    while low < len(body):
        high = body.find(_END, low + SLICE)  # cut between pieces only
        high = len(body) if high < 0 else high
        yield [w for w in body[low:high].replace(_END, b" \n ").split(b" ") if w]
        low = high


def _language(lang) -> str:
    return lang if isinstance(lang, str) else "und"


def _count_words(batches):
    """A task's word counts per language; flushed when they grow."""
    held: dict[str, dict[bytes, int]] = {}
    size = 0

    def flush():
        for lang, counts in held.items():
            counts.pop(_END, None)
            words = list(counts)
            for low in range(0, len(words), CHUNK):
                part = words[low : low + CHUNK]
                yield pd.DataFrame({"lang": lang, "word": [w.decode("utf-8", "replace") for w in part], "c": [counts[w] for w in part]})

    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"]):
            counts = held.setdefault(_language(lang), {})
            before = len(counts)
            for words in word_lists(text):
                for w in words:
                    counts[w] = counts.get(w, 0) + 1
            size += len(counts) - before
            if size > CHUNK:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _tail_of_pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols below BREAK for pairs that have no rank: 63 hashed bits."""
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + b.astype(np.uint64)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(31))) | np.uint64(1 << 63)
    return np.minimum(x.view(np.int64), BREAK - 1)


def _tail_of_word(lang: str, word: bytes) -> int:
    return min((xxhash.xxh64_intdigest(lang.encode() + b"\n" + word, 42) | 1 << 63) - (1 << 64), BREAK - 1)


def paired(a: np.ndarray, b: np.ndarray, table: tuple[np.ndarray, np.ndarray, bool]) -> np.ndarray:
    """The next level's symbols of pairs (a, b).

    ``table``: sorted cells of the ranked pairs, their ranks, and whether these
    are all frequent pairs. Other pairs break; if there are frequent ones
    beyond the table, they get a hashed symbol.
    """
    cells, ranks, complete = table
    found = np.full(len(a), BREAK, dtype=np.int64)
    ranked = np.flatnonzero((a >= 0) & (b >= 0))
    if len(cells) and len(ranked):
        cell = a[ranked] << RANK_BITS | b[ranked]
        at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
        hit = cells[at] == cell
        found[ranked[hit]] = ranks[at[hit]]
    if not complete:
        rest = np.flatnonzero((found == BREAK) & (a != BREAK) & (b != BREAK))
        found[rest] = _tail_of_pair(a[rest], b[rest])
    return found


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cells and their counts, equal cells added."""
    cells, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(cells, kind="stable")
    cells, counts = cells[order], counts[order]
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    return cells[first], np.add.reduceat(counts, first)


class _Counter:
    """Counts pairs of symbols: busy tiles of ranks dense, other ranks as sorted
    cells, pairs without ranks as sorted rows."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.sparse: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray):
        live = (a != BREAK) & (b != BREAK)
        a, b = a[live], b[live]
        ranked = (a >= 0) & (b >= 0)
        if not ranked.all():
            yield from _plain_pairs(a[~ranked], b[~ranked])
            a, b = a[ranked], b[ranked]
        if not len(a):
            return
        side = RANK_BITS - TILE_BITS
        tile = (a >> TILE_BITS) << side | (b >> TILE_BITS)
        busy = np.bincount(tile, minlength=1)
        for t in np.argsort(-busy)[:DENSE_TILES].tolist():
            if busy[t] << 4 >= 1 << 2 * TILE_BITS and len(self.dense) < DENSE_TILES:
                self.dense.setdefault(t, np.zeros(1 << 2 * TILE_BITS, dtype=np.int64))
        cell = a << RANK_BITS | b
        rest = np.ones(len(a), dtype=bool)
        low = (1 << TILE_BITS) - 1
        for t, counts in self.dense.items():
            if t < len(busy) and busy[t]:
                own = tile == t
                counts += np.bincount((a[own] & low) << TILE_BITS | (b[own] & low), minlength=len(counts))
                rest &= ~own
        if rest.any():
            self.sparse.append(np.unique(cell[rest], return_counts=True))
            self.held += len(self.sparse[-1][0])
        if self.held > HELD:
            self.sparse = [_merged(self.sparse)]
            self.held = len(self.sparse[0][0])
            if self.held > HELD // 2:
                yield from self._sent()

    def _sent(self):
        if self.sparse:
            cells, counts = _merged(self.sparse)
            yield from _frames(cells >> RANK_BITS, cells & ((1 << RANK_BITS) - 1), counts)
        self.sparse, self.held = [], 0

    def close(self):
        yield from self._sent()
        side = RANK_BITS - TILE_BITS
        for t, counts in self.dense.items():
            at = np.flatnonzero(counts)
            a = (t >> side << TILE_BITS) + (at >> TILE_BITS)
            yield from _frames(a, ((t & ((1 << side) - 1)) << TILE_BITS) + (at & ((1 << TILE_BITS) - 1)), counts[at])


def _frames(a: np.ndarray, b: np.ndarray, counts: np.ndarray):
    for low in range(0, len(a), CHUNK):
        own = slice(low, low + CHUNK)
        yield pd.DataFrame({"a": a[own], "b": b[own], "c": counts[own]})


def _plain_pairs(a: np.ndarray, b: np.ndarray):
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    yield from _frames(a[first], b[first], np.diff(np.r_[first, len(a)]))


def _count_pairs(vocabulary, complete: bool, tables: list):
    """Texts -> counts of neighbouring symbols of the level that ``tables`` lead to."""

    def run(batches):
        known, levels = vocabulary.value, [(*t.value, whole) for t, whole in tables]
        counter = _Counter()
        held: list[int] = []

        def count():
            s = np.array(held, dtype=np.int64)
            for level in levels:
                s = paired(s[:-1], s[1:], level)
            return counter.add(s[:-1], s[1:])

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                lang = _language(lang)
                rank = known.get(lang, {}).get
                for words in word_lists(text):
                    if complete:
                        held += [rank(w, BREAK) for w in words]
                    else:
                        held += [BREAK if w == _END else s if (s := rank(w)) is not None else _tail_of_word(lang, w) for w in words]
                held.append(BREAK)
                if len(held) >= CHUNK:
                    yield from count()
                    held = []
        if held:
            yield from count()
        yield from counter.close()

    return run


def _head(counts: DataFrame, most: int, keep: Column) -> tuple[DataFrame, bool]:
    """(the at most ``most`` rows of highest ``f``, whether these are all).

    The bound comes from a histogram of the logarithm of ``f`` (some hundred
    bins), so nothing is sorted.
    """
    bin_ = F.floor(F.log2("f") * 16)
    bins = {r["bin"]: (r["n"], r["kept"]) for r in counts.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(keep, 1)).alias("kept")).collect()}
    lowest, total = math.inf, 0
    for b in sorted(bins, reverse=True):
        if total + bins[b][1] > most:
            break
        lowest, total = b, total + bins[b][1]
    complete = total == sum(n for n, _ in bins.values())
    return counts.where(keep & (bin_ >= lowest) if bins and lowest < math.inf else F.lit(False)), complete


def _word_symbols(ranks):
    def run(lang: pd.Series, word: pd.Series) -> pd.Series:
        known = ranks.value
        out = []
        for of, w in zip(lang, word):
            w = w.encode("utf-8", "replace")
            s = known.get(of, {}).get(w)
            out.append(_tail_of_word(of, w) if s is None else s)
        return pd.Series(out, dtype="int64")

    return F.pandas_udf(run, "long")


def _pair_symbols(table, complete: bool):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(paired(a.to_numpy(), b.to_numpy(), (*table.value, complete)))

    return F.pandas_udf(run, "long")


def phrase_counts(
    docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, head_words: int = HEAD_WORDS, head_phrases: int = HEAD_PHRASES
) -> tuple[DataFrame, list[DataFrame]]:
    """(all words with their count ``f``, frequent phrases by number of words).

    ``docs`` has lang and text. The list holds, from one word up, written tables
    of lang, phrase, last (its last word), a, b (symbols of the two overlapping
    phrases it consists of), f and sym. Every task knows at most ``head_words``
    words and ``head_phrases`` phrases of a level by rank (2 and 8 bytes a row
    and the words themselves travel); beyond that, words and phrases go by a
    63-bit hash and are counted as sorted rows, so all are counted.
    """
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    words = docs.mapInPandas(_count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("f"))
    words = materialize(words, "words")
    frequent = words.where(F.col("f") >= min_count)
    head, complete = _head(frequent, head_words, F.octet_length("word") <= LONGEST_HEAD)
    known: dict[str, dict[bytes, int]] = {}
    ordered = sorted(head.collect(), key=lambda r: (-r["f"], r["lang"], r["word"]))  # at most head_words
    for rank, r in enumerate(ordered):
        known.setdefault(r["lang"], {})[r["word"].encode("utf-8", "replace")] = rank
    vocabulary = spark.sparkContext.broadcast(known)
    none = F.lit(None).cast("long")
    level = frequent.select("lang", F.col("word").alias("phrase"), F.col("word").alias("last"), none.alias("a"), none.alias("b"), "f", _word_symbols(vocabulary)("lang", "word").alias("sym"))
    levels, tables = [materialize(level, "phrases")], []
    for _ in range(2, max_words + 1):
        pairs = docs.mapInPandas(_count_pairs(vocabulary, complete, list(tables)), _PAIRS).groupBy("a", "b").agg(F.sum("c").alias("f"))
        pairs = materialize(pairs.where(F.col("f") >= min_count), "pairs")
        head, whole = _head(pairs, head_phrases, (F.col("a") >= 0) & (F.col("b") >= 0))
        own = head.toPandas()  # at most head_phrases
        own = own.sort_values(["f", "a", "b"], ascending=[False, True, True], ignore_index=True)
        cells = own["a"].to_numpy(dtype=np.int64) << RANK_BITS | own["b"].to_numpy(dtype=np.int64)
        order = np.argsort(cells)
        table = spark.sparkContext.broadcast((cells[order], order.astype(np.int64)))
        left = levels[-1].select(F.col("sym").alias("a"), "lang", F.col("phrase").alias("head"))
        right = levels[-1].select(F.col("sym").alias("b"), F.col("last").alias("last"))
        named = pairs.join(left, "a").join(right, "b")
        named = named.select("lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "b", "f", _pair_symbols(table, whole)("a", "b").alias("sym"))
        levels.append(materialize(named, "phrases"))
        tables.append((table, whole))
        if levels[-1].isEmpty():
            break
    return words, levels


def collocations(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int = TOP,
    lang_col: str = "lang",
    text_col: str = "text",
    head_words: int = HEAD_WORDS,
    head_phrases: int = HEAD_PHRASES,
) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (null counts as empty) are lower-cased in A-Z and cut into pieces and
    words; phrases of 2 to ``max_words`` words stay inside a piece. ``a`` counts
    a phrase, ``n`` all words of its language (null: ``und``). Of the cuts into
    two parts with counts l and r, the one with the lowest floor(1000*a*n/(l*r))
    scores, of equal ones the first. A phrase goes if a longer frequent one
    that holds it is as frequent. Order: score, a, then the phrase's bytes.
    Arithmetic is in whole decimals. Empty and very long texts, texts of blanks
    and repeated rows count as they are; an empty table, or one without
    frequent phrases, gives no rows. Ids and other columns are not read.
    """
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    words, levels = phrase_counts(docs, min_count, max_words, head_words, head_phrases)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    counts = reduce(DataFrame.unionByName, [x.select("lang", "phrase", "f") for x in levels])

    kept = []
    for level, longer in zip(levels[1:], [*levels[2:], None]):
        if longer is not None:  # a phrase that is part of a longer one starts or ends one with a word more
            inside = longer.select(F.explode(F.array("a", "b")).alias("sym"), "f").groupBy("sym").agg(F.max("f").alias("within"))
            level = level.join(inside, "sym", "left").where(F.coalesce(F.col("within") < F.col("f"), F.lit(True)))
        kept.append(level.select("lang", "phrase", F.col("f").alias("a")))
    if not kept:
        kept = [levels[0].select("lang", "phrase", F.col("f").alias("a")).limit(0)]
    parts = F.split("phrase", " ")
    cuts = reduce(DataFrame.unionByName, kept).withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)))
    cuts = cuts.withColumn("left", F.array_join(F.slice(parts, 1, F.col("k")), " "))
    cuts = cuts.withColumn("right", F.array_join(F.slice(parts, F.col("k") + 1, F.size(parts)), " "))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    whole = {c: F.col(c).cast("decimal(18,0)") for c in "anlr"}
    over, under = whole["a"] * whole["n"] * F.lit(1000).cast("decimal(4,0)"), whole["l"] * whole["r"]
    cuts = cuts.withColumn("over", over.cast("decimal(38,0)")).withColumn("under", under.cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    best = best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir, "lang", "text"))


ORACLE = r"""
with p as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p),
g as (select lang, k, unnest([array_to_string(ws[i : i + k - 1], ' ') for i in range(1, len(ws) - k + 2)]) as phrase
  from w cross join (select unnest(range(1, 6)) as k) where len(ws) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k as size, phrase, f as a from f where k > 1 and f >= 100),
kept as (select * from c where not exists (
  select 1 from c as longer where longer.lang = c.lang and longer.size > c.size and 100 * longer.a >= 100 * c.a
    and contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' '))),
cut as (select lang, phrase, a, string_split(phrase, ' ') as ws, unnest(range(1, size)) as k from kept),
s as (select cut.lang, cut.phrase, cut.a, cut.k, x.f as l, y.f as r, n.n,
    cast(1000 * cast(cut.a as hugeint) * n.n // (cast(x.f as hugeint) * y.f) as bigint) as score
  from cut join f as x on x.lang = cut.lang and x.phrase = array_to_string(cut.ws[1 : cut.k], ' ')
  join f as y on y.lang = cut.lang and y.phrase = array_to_string(cut.ws[cut.k + 1 :], ' ')
  join n on n.lang = cut.lang),
best as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score
from best qualify rank <= 2000
"""
