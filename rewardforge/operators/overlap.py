"""N-gram overlap of two texts (ROUGE-N), counted inside the row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .ngram import token_bigrams


def grams(text: Column, n: int) -> Column:
    """White-space n-grams (n = 1 or 2) of a text as strings."""
    toks = T.tokens(text)
    if n == 1:
        return toks
    if n == 2:
        return F.transform(token_bigrams(toks), lambda b: F.concat(b["prev"], F.lit(" "), b["tok"]))
    raise ValueError("n must be 1 or 2")


def rouge_n(pairs: DataFrame, key_cols: list[str], reference: str, candidate: str, ns: Sequence[int] = (1, 2)) -> DataFrame:
    """Clipped n-gram matches, precision (over the candidate), recall (over the
    reference) and F1 per pair and n; 0 where a side has no n-grams.

    The grams of both sides are sorted together inside the row, and one pass
    counts the matches: a gram more on one side matches while that side's count
    does not pass the other's. No shuffle, linear after the sort.
    """
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("g"), *[zero.alias(c) for c in ("ref", "cand", "match")])

    def add(acc: Column, x: Column) -> Column:
        again = acc["g"] == x["g"]
        ref, cand = F.when(again, acc["ref"]).otherwise(zero), F.when(again, acc["cand"]).otherwise(zero)
        met = F.when(x["ref"], ref < cand).otherwise(cand < ref)
        return F.struct(
            x["g"].alias("g"), (ref + F.when(x["ref"], F.lit(1)).otherwise(0)).alias("ref"),
            (cand + F.when(x["ref"], F.lit(0)).otherwise(1)).alias("cand"), (acc["match"] + F.when(met, F.lit(1)).otherwise(0)).alias("match"),
        )

    sides = pairs.select(*key_cols, *[F.coalesce(grams(F.col(c), n), F.array().cast("array<string>")).alias(f"_{side}{n}") for n in ns for side, c in (("r", reference), ("c", candidate))])

    def sums(n: int) -> Column:
        ref, cand = F.col(f"_r{n}"), F.col(f"_c{n}")
        both = F.concat(
            F.transform(ref, lambda g: F.struct(g.alias("g"), F.lit(True).alias("ref"))),
            F.transform(cand, lambda g: F.struct(g.alias("g"), F.lit(False).alias("ref"))),
        )
        met = F.aggregate(F.sort_array(both), start, add, lambda acc: acc["match"])
        return F.struct(F.lit(n).alias("n"), met.alias("match"), F.size(ref).cast("long").alias("tot_ref"), F.size(cand).cast("long").alias("tot_cand"))

    keys = [*key_cols, "n"]
    j = sides.select(*key_cols, F.explode(F.array(*[sums(n) for n in ns])).alias("s")).select(*key_cols, "s.*")
    m = F.col("match")
    prec = F.when(F.col("tot_cand") > 0, m / F.col("tot_cand")).otherwise(F.lit(0.0))
    rec = F.when(F.col("tot_ref") > 0, m / F.col("tot_ref")).otherwise(F.lit(0.0))
    j = j.select(*keys, m.alias("match"), prec.alias("precision"), rec.alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return j.withColumn("f1", F.when(p + r > 0, (F.lit(2.0) * p * r) / (p + r)).otherwise(F.lit(0.0)))
