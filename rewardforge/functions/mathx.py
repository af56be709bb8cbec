"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Powers of ten 1e-30 .. 1e308 as parsed literals (a rule-built table): both
# Spark and SQL engines parse decimal literals exactly rounded, while
# pow(10, k) differs in the last bit between math libraries.
POW10_MIN, POW10_MAX = -30, 308


def pow10_literals() -> list[float]:
    return [float(f"1e{k}") for k in range(POW10_MIN, POW10_MAX + 1)]


def round_sig(x: Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits (for values that can be astronomically
    large, where rounding to decimal places keeps engine-specific last bits)."""
    k = F.floor(F.log10(F.abs(x)))
    table = F.array(*[F.lit(v) for v in pow10_literals()])
    scale = F.element_at(table, (F.greatest(F.least(k, F.lit(POW10_MAX)), F.lit(POW10_MIN)) - POW10_MIN + 1).cast("int"))
    return F.when(x == 0, x).when(x.isNull() | F.isnan(x), x).otherwise(F.round(x / scale, digits - 1) * scale)
