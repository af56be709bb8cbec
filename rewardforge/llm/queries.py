"""The registered queries of this package, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    collocations,
    decontaminate,
    exact_dedup,
    language,
    line_dedup,
    minhash,
    mixing,
    quality,
    sharding,
    simhash,
    substring_dedup,
    url_filter,
    whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_simhash": simhash.op4_simhash,
    "op5_mixing": mixing.op5_mixing,
    "op6_language": language.op6_language,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_sharding": sharding.op9_sharding,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_whitening": whitening.op11_whitening,
    "op12_minhash": minhash.op12_minhash,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op8_url_filter": url_filter.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_minhash": minhash.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
