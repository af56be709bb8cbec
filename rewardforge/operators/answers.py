"""Column pipelines over question/answer and response tables.

Every function maps DataFrame -> DataFrame with built-in expressions only, so
the whole pipeline stays inside one whole-stage-codegen span per stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# --- Fixed values that must equal the reference's (chat and SFT templates) ---
SFT_TEMPLATE = "<bos><start_of_turn>user\n{q}<end_of_turn>\n<start_of_turn>model\n{a}<end_of_turn><eos>"
EVAL_TEMPLATE = "<bos><start_of_turn>user\n{q}<end_of_turn>\n<start_of_turn>model\n"
EXCLUDE_SENTENCE = "You must also ensure that the generated token is not from this array: "
REJECT_OFFSET_LOW, REJECT_OFFSET_HIGH, REJECT_SAME_SHIFT = -10, 9, 3
# --- end of fixed values ---


def normalize_text(qa: DataFrame) -> DataFrame:
    """Strip leading/trailing white space of question and answer."""
    return qa.withColumn("question", T.strip_ws("question")).withColumn("answer", T.strip_ws("answer"))


def gold_answer(qa: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Gold number in three modes: first marker, last marker, first or 0.0."""
    a = F.col(answer_col)
    return qa.withColumn("gold_first", T.gold_first(a)).withColumn("gold_last", T.gold_last(a)).withColumn(
        "gold_or_zero", T.gold_or_zero(a)
    )


def template(fmt: str, **cols: Column) -> Column:
    """Fill a ``{name}`` template with columns (a concat, no Python per row)."""
    parts: list[Column] = []
    rest = fmt
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(cols[rest[i + 1 : j]])
        rest = rest[j + 1 :]
    return F.concat(*parts)


def reject_offset(id_col: Column) -> Column:
    """Seeded offset in [-10, 9] per row, the stand-in for ``randint(-10, 10)``."""
    span = REJECT_OFFSET_HIGH - REJECT_OFFSET_LOW + 1
    return F.pmod(T.seeded_hash_int(id_col), F.lit(span)) + F.lit(REJECT_OFFSET_LOW)


def build_samples(qa: DataFrame, id_col: str = "qa_id", mode: str = "first") -> DataFrame:
    """P6 + P7: prompt, chosen, rejected, correct_answer from raw QA rows.

    Rows without a gold marker are dropped. ``mode="first"`` (the reference)
    replaces the first occurrence of the gold number's text (``str(float)``)
    by the text of a wrong number; ``unchanged`` flags rows where that text
    does not occur (note Q1). ``mode="final"`` rewrites the number after the
    last ``####`` marker instead, so the final answer is always corrupted.
    """
    q, a = T.strip_ws("question"), T.strip_ws("answer")
    df = qa.select(F.col(id_col), q.alias("prompt"), a.alias("_ans"))
    df = df.withColumn("correct_answer", T.gold_first("_ans")).where(F.col("correct_answer").isNotNull())
    gold = F.col("correct_answer")
    wrong = gold + reject_offset(F.col(id_col))
    wrong = F.when(wrong == gold, gold + F.lit(float(REJECT_SAME_SHIFT))).otherwise(wrong)
    df = df.withColumn("wrong_answer", wrong)
    if mode == "first":
        rejected_ans = T.replace_first(F.col("_ans"), T.float_text(gold), T.float_text(F.col("wrong_answer")))
    elif mode == "final":
        rejected_ans = F.regexp_replace(
            F.col("_ans"), r"(?s)(####\s*)-?\d+(?:\.\d+)?(?!.*####)", F.concat(F.lit("$1"), T.float_text(F.col("wrong_answer")))
        )
    else:
        raise ValueError(mode)
    df = df.withColumn("chosen", template(T.CHOSEN_TEMPLATE_PREFIX + "{q}\n{a}", q=F.col("prompt"), a=F.col("_ans")))
    df = df.withColumn("rejected", template(T.CHOSEN_TEMPLATE_PREFIX + "{q}\n{a}", q=F.col("prompt"), a=rejected_ans))
    df = df.withColumn("chosen_variant", template(T.CHOSEN_VARIANT_PREFIX + "{a}", a=F.col("_ans")))
    df = df.withColumn("unchanged", F.col("rejected") == F.col("chosen"))
    return df.drop("_ans")


def chat_messages(samples: DataFrame) -> DataFrame:
    """Texts to one-message chat arrays (user prompt, assistant answers)."""

    def msg(role: str, c: str) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), F.col(c).alias("content")))

    return samples.select(
        "*", msg("user", "prompt").alias("prompt_messages"),
        msg("assistant", "chosen").alias("chosen_messages"), msg("assistant", "rejected").alias("rejected_messages"),
    )


def chat_template(qa: DataFrame) -> DataFrame:
    """SFT training text over stripped fields; eval prompt over the raw question."""
    sft = template(SFT_TEMPLATE, q=T.strip_ws("question"), a=T.strip_ws("answer"))
    ev = template(EVAL_TEMPLATE, q=F.col("question"))
    return qa.withColumn("sft_text", sft).withColumn("eval_prompt", ev)


def chat_template_turns(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """P9, many turns: one chat text per conversation from ordered turns.

    The turn list of one conversation is gathered into one row; its size is
    that conversation's length (a natural bound), not the table's.
    """
    piece = F.struct(
        F.col("turn"),
        F.concat(
            F.lit("<start_of_turn>"), F.when(F.col("role") == "user", "user").otherwise("model"), F.lit("\n"),
            F.col("text"), F.lit("<end_of_turn>\n"),
        ).alias("piece"),
    )
    g = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    text = F.concat(F.lit("<bos>"), F.array_join(F.transform("_p", lambda p: p["piece"]), ""), F.lit("<eos>"))
    return g.select(conv_col, F.size("_p").alias("n_turns"), text.alias("chat_text"))


def rl_prompts(samples: DataFrame, id_col: str = "qa_id") -> DataFrame:
    """P10: keep (query, correct_answer)."""
    return samples.select(id_col, F.col("prompt").alias("query"), "correct_answer")


def prompt_fill(
    requests: DataFrame, template_text: str, query_col: str, context_col: str, taken_col: str | None = None
) -> DataFrame:
    """Fill the two placeholders; append the exclusion sentence when tokens were taken.

    ``taken_col`` is an array of tokens already produced for the same request
    (sorted here, as the reference's set order is arbitrary).
    """
    filled = F.replace(
        F.replace(F.lit(template_text), F.lit("[Insert your query here]"), F.col(query_col)),
        F.lit("[Insert your context here]"), F.col(context_col),
    )
    if taken_col is None:
        return requests.withColumn("prompt_text", filled)
    taken = F.array_sort(F.col(taken_col))
    listing = F.concat(
        F.lit("["), F.array_join(F.transform(taken, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]")
    )
    return requests.withColumn(
        "prompt_text",
        F.when(F.size(taken) > 0, F.concat(filled, F.lit(EXCLUDE_SENTENCE), listing)).otherwise(filled),
    )


def length_bonus(df: DataFrame, text_col: str = "response") -> DataFrame:
    """Words and the two capped bonuses."""
    words = T.word_count(text_col)
    return (
        df.withColumn("words", words)
        .withColumn("bonus_log", F.least(F.lit(0.3), F.col("words") / 100.0))
        .withColumn("bonus_linear", F.least(F.lit(0.2), F.col("words") / 50.0))
    )


def completion_filter(texts: DataFrame, judge_out: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Judged complete when the judge output is exactly '1'; sentence-end pre-filter."""
    ends = F.col(text_col).rlike(r"[.!?]\s*$")
    j = judge_out.select(key, F.col("output"))
    out = texts.join(j, key, "left")
    return out.select(
        key, ends.alias("ends_sentence"), F.coalesce(F.col("output") == "1", F.lit(False)).alias("judged_done"),
        (ends & F.coalesce(F.col("output") == "1", F.lit(False))).alias("is_complete"),
    )


def pad_batches(batched: DataFrame, batch_cols: list[str], array_cols: list[str], pad) -> DataFrame:
    """Right-pad each token array to the longest of its batch.

    The batch maximum is a window over the batch, which is of bounded size: one
    shuffle brings a batch together, and nothing is joined back.
    """
    batch = Window.partitionBy(*batch_cols)
    out = batched.withColumns({f"_max_{c}": F.max(F.size(c)).over(batch) for c in array_cols})
    for c in array_cols:
        m = F.col(f"_max_{c}")
        out = out.withColumn(
            f"{c}_padded", F.concat(F.col(c), F.array_repeat(F.lit(pad), m - F.size(c)))
        ).withColumn(f"{c}_pad", m - F.size(c))
    return out.drop(*[f"_max_{c}" for c in array_cols])


def truncate_tokens(df: DataFrame, tokens_col: str, max_length: int = 2048) -> DataFrame:
    """Keep the first ``max_length`` tokens."""
    return df.withColumn(f"{tokens_col}_kept", F.slice(F.col(tokens_col), 1, max_length))
