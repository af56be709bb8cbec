"""Evaluator registry (F1) and batched column maps (F2).

Built-in evaluators are Column builders, so they run inside whole-stage
codegen. User evaluators written in Python are wrapped in an Arrow
``pandas_udf``: one call per batch, not per row, with the reference's
fallback value when the function fails on a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from . import text as T

# --- Fixed values that must equal the reference's ---
HARD_FALLBACK = 0.0
PERPLEXITY_FALLBACK = 0.1
# --- end of fixed values ---

ColumnEvaluator = Callable[[Column, Column, Column], Column]  # (prompt, response, correct_answer) -> reward
PythonEvaluator = Callable[[pd.Series, pd.Series, pd.Series], pd.Series]


def _hard_marker(prompt: Column, resp: Column, gold: Column) -> Column:
    return T.hard_reward(T.extract_marker(resp), gold)


def _hard_cascade(prompt: Column, resp: Column, gold: Column) -> Column:
    return T.hard_reward(T.extract_cascade(resp), gold)


def _hard_exact(prompt: Column, resp: Column, gold: Column) -> Column:
    return T.hard_reward(T.extract_marker(resp), gold, exact=True)


_REGISTRY: dict[str, ColumnEvaluator] = {
    "hard": _hard_marker,
    "hard_cascade": _hard_cascade,
    "hard_exact": _hard_exact,
}
_PYTHON: set[str] = set()  # evaluators over the Series of a batch
_SCORES: dict[str, PythonEvaluator] = {}  # and what they run


def register(name: str, fn: ColumnEvaluator) -> None:
    """Add a Column-level evaluator under ``name``."""
    _REGISTRY[name] = fn


def register_python(name: str, fn: Callable[[pd.Series, pd.Series, pd.Series], pd.Series | float], fallback: float = HARD_FALLBACK) -> None:
    """Add a Python evaluator ``fn(prompts, responses, correct_answers) -> rewards``
    over the Series of a batch (an Arrow pandas UDF).

    A batch that fails is halved until only the failing rows are left; these get
    ``fallback`` (the reference catches every error and returns a constant).
    """

    def score(p: pd.Series, r: pd.Series, g: pd.Series) -> pd.Series:
        try:
            return pd.Series(fn(p, r, g), index=p.index, dtype="float64")
        except Exception:  # noqa: BLE001 - the reference's catch-all
            if len(p) <= 1:
                return pd.Series(fallback, index=p.index, dtype="float64")
            half = len(p) // 2
            return pd.concat([score(p[:half], r[:half], g[:half]), score(p[half:], r[half:], g[half:])])

    own = _SCORES[name] = lambda p, r, g: score(p, r, g).fillna(fallback)
    _REGISTRY[name] = lambda prompt, resp, gold: _dispatch({name: own})(F.lit(name), prompt, resp, gold)
    _PYTHON.add(name)


def _dispatch(evaluators: dict[str, PythonEvaluator]):
    """One Arrow UDF for several Python evaluators: the rows of a batch go to the one they name."""

    @F.pandas_udf(ST.DoubleType())
    def udf(name: pd.Series, p: pd.Series, r: pd.Series, g: pd.Series) -> pd.Series:
        out = pd.Series(float("nan"), index=name.index, dtype="float64")
        for n, score in evaluators.items():
            own = name == n
            if own.any():
                out[own] = score(p[own], r[own], g[own])
        return out

    return udf


def names() -> list[str]:
    return sorted(_REGISTRY)


def evaluate(df: DataFrame, name_col: str, prompt: str, response: str, gold: str, out: str = "reward") -> DataFrame:
    """Score each row with the evaluator named in ``name_col``.

    Column evaluators share one CASE expression. The Python ones share one Arrow
    UDF that hands each row of a batch to the evaluator it names, so the input
    is read once however many there are; rows that name none travel without
    their texts (Spark evaluates a UDF inside a CASE branch for every row).
    """
    from ..session import ship_package

    ship_package(df.sparkSession)
    p, r, g = F.col(prompt), F.col(response), F.col(gold)
    expr = None
    for n, fn in _REGISTRY.items():
        if n in _PYTHON:
            continue
        branch = fn(p, r, g)
        expr = F.when(F.col(name_col) == n, branch) if expr is None else expr.when(F.col(name_col) == n, branch)
    fallback = F.lit(HARD_FALLBACK)
    plain = expr.otherwise(fallback) if expr is not None else fallback
    if not _PYTHON:
        return df.withColumn(out, plain)
    python = F.coalesce(F.col(name_col).isin(sorted(_PYTHON)), F.lit(False))
    sent = [F.when(python, c) for c in (F.col(name_col), p, r, g)]
    return df.withColumn(out, F.when(python, _dispatch({n: _SCORES[n] for n in _PYTHON})(*sent)).otherwise(plain))


def batched_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: ST.StructType | str) -> DataFrame:
    """a batch function over columns (``mapInPandas``); input columns not in the
    output schema are dropped, like ``map(batched=True, remove_columns=...)``."""

    from ..session import ship_package

    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)
