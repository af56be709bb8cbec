"""Hand cases from the edge rows every text test must hold (FIXTURES A)."""

import pytest
from pyspark.sql import functions as F

from rewardforge.functions import text as T
from rewardforge.operators import answers as P

TRACE = (
    "A box holds 6 rows of 4 cups, so 6*4 = <<6*4=24>>24 cups.\n"
    "Of these, 24/8 = <<24/8=3>>3 cups are cracked.\n"
    "That leaves 24-3 = <<24-3=21>>21 cups, packed in 7 bags of <<21/7=3>>3.\n#### 7"
)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_marker_vs_cascade_on_calculator_trace(spark):
    assert one(spark, T.extract_marker, TRACE) == 7.0
    assert one(spark, T.extract_cascade, TRACE) == 24.0


@pytest.mark.parametrize(
    "text, first, last",
    [
        ("no marker here 12", None, None),
        ("a\n#### 3\nb\n#### 4", 3.0, 4.0),
        ("#### 2.5", 2.5, 2.5),
        ("#### -7", -7.0, -7.0),
        ("#### 1,234", 1.0, 1.0),
    ],
)
def test_gold_modes(spark, text, first, last):
    assert one(spark, T.gold_first, text) == first
    assert one(spark, T.gold_last, text) == last
    assert one(spark, T.gold_or_zero, text) == (first if first is not None else 0.0)


@pytest.mark.parametrize("text", ["I cannot tell.", "", "   "])
def test_no_number_is_null(spark, text):
    assert one(spark, T.extract_marker, text) is None
    assert one(spark, T.extract_cascade, text) is None


def test_cascade_order(spark):
    assert one(spark, T.extract_cascade, "so the answer is 42 and later 7") == 42.0
    assert one(spark, T.extract_cascade, "values 3 and then 9  \n") == 9.0
    assert one(spark, T.extract_cascade, "x 3 y 9 z") == 9.0


def test_strip_and_words(spark):
    assert one(spark, T.strip_ws, " \n\t a b \n ") == "a b"
    assert one(spark, T.word_count, "  a\tb\nc  ") == 3
    assert one(spark, T.word_count, "") == 0


def test_hard_reward_tolerance_and_null(spark):
    df = spark.createDataFrame([(10.00001, 10.0), (10.1, 10.0), (None, 10.0)], "p double, g double")
    got = [r[0] for r in df.select(T.hard_reward(F.col("p"), F.col("g"))).collect()]
    assert got == [1.0, 0.0, 0.0]
    exact = [r[0] for r in df.select(T.hard_reward(F.col("p"), F.col("g"), exact=True)).collect()]
    assert exact == [0.0, 0.0, 0.0]


def test_float_text_matches_python(spark):
    vals = [37.0, 37.5, -3.0, 0.5, 12345678.0, 1e15]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(T.float_text(F.col("x"))).collect()]
    assert got == [str(v) for v in vals]


def test_samples_corruption_rule(spark):
    qa = spark.createDataFrame(
        [
            (1, "  Q one?  ", "so 37 apples\n#### 37"),
            (2, "Q two?", "half 2.5 then 2.5\n#### 2.5"),
            (3, "Q three?", "no marker"),
        ],
        "qa_id long, question string, answer string",
    )
    rows = {r.qa_id: r for r in P.build_samples(qa).collect()}
    assert set(rows) == {1, 2}  # no gold marker: dropped
    r1, r2 = rows[1], rows[2]
    assert r1.prompt == "Q one?"
    assert r1.chosen == "Let's think step by step.\nQ one?\nso 37 apples\n#### 37"
    assert r1.unchanged and r1.rejected == r1.chosen  # '37.0' does not occur in the text
    assert -10 <= r1.wrong_answer - 37.0 <= 9 and r1.wrong_answer != 37.0
    # first occurrence only is replaced
    assert r2.rejected.count(str(r2.wrong_answer)) == 1 and r2.rejected.count("2.5") == 2
    assert not r2.unchanged


def test_chat_template(spark):
    qa = spark.createDataFrame([(1, " Q ", " A ")], "qa_id long, question string, answer string")
    r = P.chat_template(qa).first()
    assert r.sft_text == "<bos><start_of_turn>user\nQ<end_of_turn>\n<start_of_turn>model\nA<end_of_turn><eos>"
    assert r.eval_prompt == "<bos><start_of_turn>user\n Q <end_of_turn>\n<start_of_turn>model\n"


def test_prompt_fill(spark):
    df = spark.createDataFrame([("q1", "ctx", ["b", "a"]), ("q2", "c2", [])], "q string, c string, taken array<string>")
    out = P.prompt_fill(df, "Q=[Insert your query here] C=[Insert your context here]. ", "q", "c", "taken").collect()
    assert out[0].prompt_text == "Q=q1 C=ctx. " + P.EXCLUDE_SENTENCE + "['a', 'b']"
    assert out[1].prompt_text == "Q=q2 C=c2. "


def test_pad_batches(spark):
    df = spark.createDataFrame([(0, 1, ["a"]), (0, 2, ["a", "b", "c"]), (1, 3, ["x"])], "batch_id int, id int, t array<string>")
    out = {r.id: r for r in P.pad_batches(df, ["batch_id"], ["t"], "<pad>").collect()}
    assert out[1].t_padded == ["a", "<pad>", "<pad>"] and out[1].t_pad == 2
    assert out[2].t_padded == ["a", "b", "c"] and out[3].t_padded == ["x"]


def test_options_final_mode_and_thousands(spark):
    qa = spark.createDataFrame([(1, "Q?", "37 then 37\n#### 37")], "qa_id long, question string, answer string")
    r = P.build_samples(qa, mode="final").first()
    assert not r.unchanged
    assert r.rejected.endswith("#### " + str(r.wrong_answer)) and "37 then 37" in r.rejected
    assert one(spark, lambda c: T.gold_first(c, thousands=True), "#### 1,234") == 1234.0
    assert one(spark, lambda c: T.gold_first(c, thousands=True), "#### 12.5") == 12.5


def test_scored_text_styles(spark):
    df = spark.createDataFrame([("p", "r")], "p string, r string")
    row = df.select(T.scored_text("p", "r").alias("a"), T.scored_text("p", "r", "qa").alias("b")).first()
    assert row.a == "p r" and row.b == "Question: p\nAnswer: r"
