"""Continuous rewards from perplexity (A4-A7) and the evaluator registry inputs.

All rewards are column expressions over a perplexity column; a missing or
NaN perplexity is the reference's error path (fallback 0.1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

# --- Fixed values that must equal the reference's ---
ERROR_FALLBACK = 0.1
CORRECT_BONUS = 0.1
REL_EPS = 1e-8
# --- end of fixed values ---


def clean(ppl: Column) -> Column:
    """NaN -> null, so that the fallback applies (``greatest`` ranks NaN highest)."""
    return F.when(F.isnan(ppl), F.lit(None)).otherwise(ppl)


def clip01(x: Column) -> Column:
    """np.clip to [0, 1]; null stays null (``least``/``greatest`` would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def bonus(right: Column) -> Column:
    return F.when(right, F.lit(CORRECT_BONUS)).otherwise(F.lit(0.0))


def _words(text: Column, words: Column | None) -> Column:
    """Words of a text, unless the caller has counted them."""
    return T.word_count(text) if words is None else words


def reward_log(ppl: Column, text: Column, right: Column, digits: int = 6, words: Column | None = None) -> Column:
    """A4: clip(1/(1+ln(1+ppl)) + min(0.3, words/100) + 0.1 if right, 0, 1); error 0.1."""
    p = clean(ppl)
    r = F.lit(1.0) / (F.lit(1.0) + F.log1p(p)) + F.least(F.lit(0.3), _words(text, words) / 100.0) + bonus(right)
    return F.round(F.coalesce(clip01(r), F.lit(ERROR_FALLBACK)), digits)


def reward_linear(ppl: Column, text: Column, right: Column, digits: int = 6, words: Column | None = None) -> Column:
    """A5: clip(1/(1+ppl/100) + min(0.2, words/50) + 0.1 if right, 0, 1); error 0.1."""
    p = clean(ppl)
    r = F.lit(1.0) / (F.lit(1.0) + p / 100.0) + F.least(F.lit(0.2), _words(text, words) / 50.0) + bonus(right)
    return F.round(F.coalesce(clip01(r), F.lit(ERROR_FALLBACK)), digits)


def reward_relative(base_ppl: Column, train_ppl: Column, hard: Column | None = None, digits: int = 6) -> Column:
    """(base - train)/(base + 1e-8) (+0.1 when the hard reward > 0.5), clipped; error 0.1."""
    b, t = clean(base_ppl), clean(train_ppl)
    r = (b - t) / (b + F.lit(REL_EPS))
    if hard is not None:
        r = r + F.when(hard > 0.5, F.lit(CORRECT_BONUS)).otherwise(F.lit(0.0))
    return F.round(F.coalesce(clip01(r), F.lit(ERROR_FALLBACK)), digits)


def reward_vs_gold(gold_ppl: Column, resp_ppl: Column, digits: int = 6) -> Column:
    """(ppl(question, gold) - ppl(question, response)) / (ppl(gold) + 1e-8), not clipped."""
    return F.round((gold_ppl - resp_ppl) / (gold_ppl + F.lit(REL_EPS)), digits)
