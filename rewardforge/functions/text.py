"""Column builders for reading answers out of text (all JVM-side expressions).

Regular expressions run on the JVM (java.util.regex): ``\\s`` and ``\\d`` are
ASCII classes there, while the reference's Python ``re`` is Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values that must equal the reference's (patterns and templates) ---
GOLD_MARKER_PATTERN = r"####\s*(-?\d+(?:\.\d+)?)"
NUMBER_PATTERN = r"(-?\d+(?:\.\d+)?)"
CASCADE_PATTERNS = (
    r"(?:the answer is|answer:|equals?|=)\s*(-?\d+(?:\.\d+)?)",
    r"(-?\d+(?:\.\d+)?)\s*$",
    r"=\s*(-?\d+(?:\.\d+)?)",
)
STRIP_PATTERN = r"^\s+|\s+$"
CHOSEN_TEMPLATE_PREFIX = "Let's think step by step.\n"
CHOSEN_VARIANT_PREFIX = "Let's solve this step by step.\n\n"
SEED = 3407
TOLERANCE = 1e-4
# --- end of fixed values ---


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: str | Column) -> Column:
    """Python ``str.strip()`` on ASCII white space (``trim`` strips blanks only)."""
    return F.regexp_replace(col(c), STRIP_PATTERN, "")


def first_number(c: str | Column, pattern: str, case_insensitive: bool = False) -> Column:
    """Group 1 of the first match as a double; null when there is none."""
    p = ("(?i)" + pattern) if case_insensitive else pattern
    return F.nullif(F.regexp_extract(col(c), p, 1), F.lit("")).try_cast("double")


def last_number(c: str | Column, pattern: str) -> Column:
    """Group 1 of the last match as a double; null when there is none."""
    return F.try_element_at(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(1)), F.lit(-1)).try_cast("double")


# Option of ours (note Q4): numbers with thousands separators after the marker.
GOLD_MARKER_THOUSANDS_PATTERN = r"####\s*(-?\d{1,3}(?:,\d{3})+(?:\.\d+)?|-?\d+(?:\.\d+)?)"


def gold_first(c: str | Column, thousands: bool = False) -> Column:
    """Number after the first ``####``; ``thousands=True`` reads ``1,234`` as 1234
    (the reference's pattern stops at the comma and reads 1.0)."""
    if not thousands:
        return first_number(c, GOLD_MARKER_PATTERN)
    raw = F.nullif(F.regexp_extract(col(c), GOLD_MARKER_THOUSANDS_PATTERN, 1), F.lit(""))
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


def gold_last(c: str | Column) -> Column:
    return last_number(c, GOLD_MARKER_PATTERN)


def gold_or_zero(c: str | Column) -> Column:
    return F.coalesce(gold_first(c), F.lit(0.0))


def extract_marker(c: str | Column) -> Column:
    """Strategy "marker": last ``####`` number, else the last number, else null."""
    return F.coalesce(last_number(c, GOLD_MARKER_PATTERN), last_number(c, NUMBER_PATTERN))


def extract_cascade(c: str | Column) -> Column:
    """Strategy "cascade": first match of each pattern in turn, else the last number."""
    steps = [first_number(c, p, case_insensitive=True) for p in CASCADE_PATTERNS]
    return F.coalesce(*steps, last_number(c, NUMBER_PATTERN))


def is_right(pred: Column, gold: Column, exact: bool = False) -> Column:
    """True when a prediction exists and matches the gold answer (null counts as wrong)."""
    hit = (pred == gold) if exact else (F.abs(pred - gold) < F.lit(TOLERANCE))
    return F.coalesce(hit, F.lit(False))


def hard_reward(pred: Column, gold: Column, exact: bool = False) -> Column:
    return F.when(is_right(pred, gold, exact), F.lit(1.0)).otherwise(F.lit(0.0))


def word_count(c: str | Column) -> Column:
    """``len(text.split())``: non-empty white-space separated parts (0 for a null text)."""
    return F.coalesce(F.size(tokens(c)), F.lit(0))


def tokens(c: str | Column) -> Column:
    """White-space tokens of a text (the tokenizer of the n-gram and overlap jobs)."""
    return F.array_remove(F.split(col(c), r"\s+"), "")


def float_text(x: Column) -> Column:
    """Python ``str(float)``: plain digits for 1e-4 <= |x| < 1e16, else an
    exponent of at least two digits with its sign (Spark writes ``1.0E7``)."""
    s = x.cast("string")
    plain = F.regexp_replace(s.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    head = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(s, r"E-?([0-9]+)$", 1)
    power = F.when(F.length(power) < 2, F.concat(F.lit("0"), power)).otherwise(power)
    sign = F.when(s.contains("E-"), F.lit("-")).otherwise(F.lit("+"))
    size = F.abs(x)
    return (
        F.when(F.isnan(x), F.lit("nan"))
        .when(size == float("inf"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~s.contains("E"), s)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(head, F.lit("e"), sign, power))
    )


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """``text.replace(old, new, 1)``; ``regexp_replace`` would replace all matches."""
    pos = F.call_function("instr", text, old)
    head = F.call_function("substr", text, F.lit(1), pos - 1)
    tail = F.call_function("substr", text, pos + F.length(old))
    return F.when(pos > 0, F.concat(head, new, tail)).otherwise(text)


def scored_text(prompt: str | Column, response: str | Column, style: str = "space") -> Column:
    """Text a perplexity is computed on: ``prompt + " " + response`` (style
    "space") or ``Question: {p}\nAnswer: {r}`` (style "qa")."""
    if style == "space":
        return F.concat(col(prompt), F.lit(" "), col(response))
    if style == "qa":
        return F.concat(F.lit("Question: "), col(prompt), F.lit("\nAnswer: "), col(response))
    raise ValueError(style)


def utc_instant(df, c: str) -> Column:
    """Event time as an instant: a stored wall-clock value (TIMESTAMP_NTZ) is read
    as UTC whatever the session time zone is (``withWatermark`` needs TIMESTAMP)."""
    from pyspark.sql.types import TimestampNTZType

    if isinstance(df.schema[c].dataType, TimestampNTZType):
        tz = df.sparkSession.conf.get("spark.sql.session.timeZone")
        return F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(c)).cast("timestamp")
    return F.col(c).cast("timestamp")


def seeded_hash_int(*parts: Column, seed: int = SEED) -> Column:
    """Non-negative integer from the first 8 hex digits of md5(seed:part:...)."""
    key = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def seeded_hash_key(*parts: Column, seed: int = SEED) -> Column:
    """md5 hex of (seed:part:...), a reproducible sort key for seeded shuffles."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
