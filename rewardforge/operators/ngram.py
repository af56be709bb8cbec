"""Bigram language model fit and perplexity scoring at corpus scale (A1-A3).

Stands in for a neural forward pass. Fitting counts bigrams with map-side
partial aggregation. The log-probability of a pair is ln(c(v,w) + k) minus
ln(c(v) + k (V + 1)), so a text's sum splits into one term per distinct pair
and one per distinct context, and both go through one lookup on one key. A
context's key ends with a blank, a pair's never does.

The terms of the grams that are frequent in the texts (a bounded number, found
from a sample of them) are summed where the text is read, in Arrow batches; each
distinct gram of a text that is not among them is a row of the lookup's join.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from ..session import materialize

# --- Fixed values that must equal the reference's ---
MAX_LENGTH = 2048
# --- end of fixed values ---

LONG_TEXT = 1024  # pairs of a text from which it is counted inside its row
HEAD = 1 << 16  # frequent grams whose terms every task holds
SAMPLE = 128  # one key in so many says which grams are frequent
PART_BYTES = 1 << 22  # text that a task takes apart at once

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have the package


def token_bigrams(toks: Column) -> Column:
    """array<struct<prev, tok>> of adjacent tokens; empty for fewer than two tokens."""
    n = F.greatest(F.size(toks) - 1, F.lit(0))
    return F.zip_with(F.slice(toks, 1, n), F.slice(toks, 2, n), lambda a, b: F.struct(a.alias("prev"), b.alias("tok")))


@dataclass
class BigramModel:
    pairs: DataFrame  # prev, tok, c_pair
    contexts: DataFrame  # prev, c_ctx
    vocab: DataFrame  # one row, one column: v
    lookup: DataFrame  # gram ("prev tok" or "prev "), c


def fit_bigram(corpus: DataFrame, text_col: str) -> BigramModel:
    """A2: c(v, w), c(v) = sum over w of c(v, w), and the vocabulary size.

    The texts are tokenized once: a text's first token follows the empty token,
    so the counts hold every token of the vocabulary.
    """
    # Tokens in their own projection: the bigram builder reads the array three
    # times, and CollapseProject keeps a costly expression from being inlined.
    tk = corpus.select(T.tokens(text_col).alias("_tok"))
    before = F.slice(F.concat(F.array(F.lit("")), F.col("_tok")), 1, F.coalesce(F.size("_tok"), F.lit(0)))
    grams = F.zip_with(before, "_tok", lambda a, b: F.struct(a.alias("prev"), b.alias("tok")))
    bg = tk.where(F.col("_tok").isNotNull()).select(F.explode(grams).alias("b")).select("b.prev", "b.tok")
    # written once: contexts, vocabulary and lookup read it
    counts = materialize(bg.groupBy("prev", "tok").agg(F.count(F.lit(1)).alias("c_pair")), "bigram-pairs")
    pairs = counts.where(F.col("prev") != "")
    contexts = pairs.groupBy("prev").agg(F.sum("c_pair").alias("c_ctx"))
    lookup = pairs.select(F.concat_ws(" ", "prev", "tok").alias("gram"), F.col("c_pair").alias("c")).unionByName(
        contexts.select(F.concat("prev", F.lit(" ")).alias("gram"), F.col("c_ctx").alias("c"))
    )
    # Written, so that Spark knows its size when a scoring is planned: it broadcasts a
    # table under its threshold without shuffling the texts' grams, and beyond it
    # takes a sort-merge join whose hot keys can be split.
    return BigramModel(pairs, contexts, counts.agg(F.count_distinct("tok").alias("v")), materialize(lookup, "bigram-lookup"))


def _gram_counts(tk: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep, gram, n): occurrences of pairs and of contexts in a text (column ``_tok``).

    Texts of more than LONG_TEXT pairs are counted inside the row (sorted, then
    run lengths), so a token that fills a long text is one row; shorter ones
    send their pairs as they are. A text without a pair gives one row with n = 0.
    """
    last = F.greatest(F.size("_tok") - 1, F.lit(0))
    # steps of their own, so that no array is built twice
    tk = tk.select(*keep, F.slice("_tok", 1, last).alias("prev"), F.slice("_tok", 2, last).alias("tok"))
    tk = tk.withColumn("_s", F.when(F.size("prev") > LONG_TEXT, F.sort_array(F.arrays_zip("prev", "tok"))))
    first = lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))
    tk = tk.withColumn("_start", F.when(F.col("_s").isNotNull(), F.filter(F.sequence(F.lit(0), F.size("_s") - 1), first)))
    ends = F.concat(F.slice("_start", 2, F.size("_start") - 1), F.array(F.size("_s")))
    run = lambda a, b: F.struct(F.get("_s", a)["prev"].alias("prev"), F.get("_s", a)["tok"].alias("tok"), (b - a).alias("n"))
    plain = F.arrays_zip("prev", "tok", F.array_repeat(F.lit(1), F.size("prev"))).cast("array<struct<prev:string,tok:string,n:int>>")
    grams = F.when(F.col("_start").isNotNull(), F.zip_with("_start", ends, run)).otherwise(plain)
    j = tk.select(*keep, F.explode_outer(grams).alias("g")).select(*keep, "g.prev", "g.tok", F.coalesce("g.n", F.lit(0)).alias("n"))
    # the ids stand in for the key, so that texts without a pair do not share one
    no_key = F.concat(F.lit("\0"), F.concat_ws(",", *[F.col(c).cast("string") for c in keep]), F.lit("\0"))
    both = F.when(F.col("n") == 0, F.array(no_key)).otherwise(F.array(F.concat("prev", F.lit(" ")), F.concat("prev", F.lit(" "), "tok")))
    return j.select(*keep, "n", F.explode(both).alias("gram"))


def score_perplexities(
    models: dict[str, BigramModel],
    df: DataFrame,
    id_cols: Sequence[str],
    text: Column,
    k: float = 1.0,
    max_length: int | None = None,
    digits: int = 6,
) -> DataFrame:
    """A3 (+A1 rule) for several models in one pass: exp(-mean logp) over predicted
    tokens from the second on (up to ``max_length`` if given); null if there are none.

    The texts are tokenized and counted once. The models' counts are merged into
    one table, so the counts take one lookup however many models there are; each
    model adds one sum to the same aggregation. Output: id columns (the first is
    the key that the sample goes by; what else a caller needs per text may be
    among them), ``n_pred`` and ``ppl_<name>`` per
    model, rounded to ``digits`` (sums of logarithms differ in the last bits
    between engines and row orders).
    """
    texts = df.select(*id_cols, text.alias("_text"))
    merged = _merged({n: m.lookup for n, m in models.items()})
    vocab = {n: m.vocab.first()[0] for n, m in models.items()}
    head = df.sparkSession.sparkContext.broadcast(_head(texts, id_cols[0], merged, vocab, k, max_length))
    rest = ST.ArrayType(ST.StructType([ST.StructField("gram", ST.StringType()), ST.StructField("n", ST.LongType())]))
    sums = [ST.StructField("_n", ST.LongType()), *[ST.StructField(f"_s_{n}", ST.DoubleType()) for n in models], ST.StructField("_rest", rest)]
    found = texts.mapInArrow(_head_sums(head, len(models), max_length), ST.StructType([*texts.schema.fields[:-1], *sums]))
    rows = found.select("*", F.posexplode_outer("_rest").alias("_pos", "_g")).drop("_rest")
    # the ids stand in for the key, so that texts without another gram do not share one
    no_key = F.concat(F.lit("\0"), F.concat_ws(",", *[F.col(c).cast("string") for c in id_cols]), F.lit("\0"))
    rows = rows.withColumn("gram", F.coalesce("_g.gram", no_key)).withColumn("n", F.coalesce("_g.n", F.lit(0))).drop("_g")
    j = rows.join(merged, "gram", "left")
    n, context, first = F.col("n"), F.endswith(F.col("gram"), F.lit(" ")), F.coalesce("_pos", F.lit(0)) == 0
    n_pred = F.sum(F.when(first, F.col("_n")).otherwise(F.lit(0)))
    aggs = [n_pred.alias("n_pred")]
    for name in models:
        c = F.coalesce(F.col(f"c_{name}"), F.lit(0))
        term = F.when(context, -n * F.log(c + F.lit(k) * F.lit(vocab[name] + 1))).otherwise(n * F.log(c + F.lit(k)))
        own = F.when(first, F.col(f"_s_{name}")).otherwise(F.lit(0.0))
        mean = F.when(n_pred > 0, F.sum(own + F.when(n > 0, F.coalesce(term, F.lit(0.0))).otherwise(F.lit(0.0))) / n_pred)
        aggs.append(F.round(F.exp(-mean), digits).alias(f"ppl_{name}"))
    return j.groupBy(*id_cols).agg(*aggs)


@dataclass
class _Head:
    """Terms of the frequent grams, a row per model in ``contexts`` and ``pairs``."""

    tokens: dict[str, int]  # a number per token of these grams
    is_context: np.ndarray  # by token: whether it is a frequent context
    contexts: np.ndarray  # by token: -ln(c + k (V + 1))
    keys: np.ndarray  # sorted: previous token * number of tokens + token
    pairs: np.ndarray  # by place of the key: ln(c + k)


def _head(texts: DataFrame, key: str, merged: DataFrame, vocab: dict[str, int], k: float, max_length: int | None) -> _Head:
    """The grams that occur most in the texts of one key in SAMPLE, at most HEAD.

    The sample says only which grams these are: their counts are the lookup's,
    0 for one that it does not hold, and all other grams are looked up too.
    """
    some = texts.where(F.pmod(F.xxhash64(key), F.lit(SAMPLE)) == 0)
    toks = T.tokens("_text") if max_length is None else F.slice(T.tokens("_text"), 1, max_length)
    grams = _gram_counts(some.select(F.coalesce(toks, F.array().cast("array<string>")).alias("_tok")), []).where("n > 0")
    top = grams.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "gram").limit(HEAD)
    rows = top.select("gram").join(merged, "gram", "left").collect()
    split = [r["gram"].split(" ") for r in rows]
    tokens = {t: i for i, t in enumerate(dict.fromkeys(t for g in split for t in g if t))}
    counts = np.array([[r[f"c_{n}"] or 0 for r in rows] for n in vocab], dtype=np.float64).reshape(len(vocab), len(rows))
    unseen = np.array([[k * (v + 1)] for v in vocab.values()])

    def log(x: np.ndarray) -> np.ndarray:  # as in the join: no logarithm, no term
        return np.log(x, out=np.zeros_like(x), where=x > 0)

    one = [i for i, g in enumerate(split) if not g[1]]
    two = [i for i, g in enumerate(split) if g[1]]
    at = np.array([tokens[split[i][0]] for i in one], dtype=np.int64)
    is_context, contexts = np.zeros(len(tokens), dtype=bool), np.zeros((len(vocab), len(tokens)))
    is_context[at], contexts[:, at] = True, -log(counts[:, one] + unseen)
    keys = np.array([tokens[split[i][0]] * len(tokens) + tokens[split[i][1]] for i in two], dtype=np.int64)
    order = np.argsort(keys)
    return _Head(tokens, is_context, contexts, keys[order], log(counts[:, two] + k)[:, order])


def _head_sums(head, n_models: int, max_length: int | None):
    """Per text (last column): ids, number of pairs, sum of the head's terms per model, the other grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype=np.int64) // PART_BYTES)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if low < high:
                    yield part(batch.slice(low, high - low))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        h, rows = head.value, batch.num_rows
        text = pc.fill_null(batch.column(batch.num_columns - 1), "")
        lists = pc.ascii_split_whitespace(text)
        full = pc.not_equal(pc.list_flatten(lists), "")
        tokens = pc.list_flatten(lists).filter(full).dictionary_encode()
        owner = pc.list_parent_indices(lists).filter(full).to_numpy().astype(np.int64)
        code, words = tokens.indices.to_numpy().astype(np.int64), tokens.dictionary
        if max_length is not None:
            kept = np.arange(len(owner)) - np.searchsorted(owner, owner) < max_length
            owner, code = owner[kept], code[kept]
        pair = owner[1:] == owner[:-1]
        at, a, b = owner[1:][pair], code[:-1][pair], code[1:][pair]
        number = np.array([h.tokens.get(w, -1) for w in words.to_pylist()], dtype=np.int64)
        prev, tok = number[a], number[b]
        near = prev >= 0
        near[near] = h.is_context[prev[near]]
        both = (prev >= 0) & (tok >= 0)
        key = prev * len(h.tokens) + tok
        place = np.searchsorted(h.keys, key)
        both &= place < len(h.keys)
        both[both] = h.keys[place[both]] == key[both]
        sums = [
            np.bincount(at[near], h.contexts[m][prev[near]], rows) + np.bincount(at[both], h.pairs[m][place[both]], rows)
            for m in range(n_models)
        ]
        # each other gram of a text once; a context's second word has the number 0
        at_, a_, b_ = np.r_[at[~near], at[~both]], np.r_[a[~near], a[~both]], np.r_[0 * a[~near], b[~both] + 1]
        order = np.lexsort((b_, a_, at_))
        at_, a_, b_ = at_[order], a_[order], b_[order]
        new = np.flatnonzero(np.r_[True, (np.diff(at_) != 0) | (np.diff(a_) != 0) | (np.diff(b_) != 0)][: len(at_)])
        times = np.diff(np.r_[new, len(at_)])
        second = pa.concat_arrays([pa.array([""], words.type), words])
        gram = pc.binary_join_element_wise(words.take(pa.array(a_[new])), second.take(pa.array(b_[new])), " ")
        ends = np.cumsum(np.bincount(at_[new], minlength=rows))
        rest = pa.ListArray.from_arrays(
            pa.array(np.r_[0, ends], pa.int32()), pa.StructArray.from_arrays([gram, pa.array(times, pa.int64())], ["gram", "n"])
        )
        names = [*batch.schema.names[:-1], "_n", *[f"_s_{m}" for m in range(n_models)], "_rest"]
        pairs = pa.array(np.bincount(at, minlength=rows), pa.int64())
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pairs, *[pa.array(s, pa.float64()) for s in sums], rest], names)

    return run


def _merged(tables: dict[str, DataFrame]) -> DataFrame:
    """The models' lookups as one: a column ``c_<name>`` per model (null where it has no such key)."""
    named = [t.withColumnRenamed("c", f"c_{n}") for n, t in tables.items()]
    if len(named) == 1:
        return named[0]
    stacked = named[0]
    for t in named[1:]:
        stacked = stacked.unionByName(t, allowMissingColumns=True)
    return materialize(stacked.groupBy("gram").agg(*[F.max(f"c_{n}").alias(f"c_{n}") for n in tables]), "bigram-lookup")


def score_perplexity(
    model: BigramModel,
    df: DataFrame,
    id_cols: Sequence[str],
    text: Column,
    k: float = 1.0,
    max_length: int | None = None,
    digits: int = 6,
) -> DataFrame:
    """A3 for one model: id columns, ``n_pred``, ``ppl``."""
    out = score_perplexities({"m": model}, df, id_cols, text, k, max_length, digits)
    return out.withColumnRenamed("ppl_m", "ppl")


def perplexity_from_logprobs(
    token_logprob: DataFrame, id_col: str, pos_col: str, logp_cols: dict[str, str], max_length: int | None = None, digits: int = 6
) -> DataFrame:
    """A1: perplexity per sample from logged token log-probs (several models in one
    aggregation, ``logp_cols`` maps output name -> log-prob column); token 1
    has no prediction, so positions from 2 on count (up to ``max_length`` if given)."""
    kept = token_logprob.where(F.col(pos_col) >= 2)
    if max_length is not None:
        kept = kept.where(F.col(pos_col) <= max_length)
    return kept.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_pred"),
        *[F.round(F.exp(-F.avg(c)), digits).alias(name) for name, c in logp_cols.items()],
    )
