"""Scoring in batches: frequent grams are summed in the task, every other one is looked up."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardforge.operators import ngram as NG
from test_weak_plans import TEXTS, score


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([*TEXTS.items(), (9, None), (10, "\t\x0ba\n\n b\x0c\r c "), (11, "é x é x y")], "id long, t string").repartition(3)


def want():
    all_texts = {**TEXTS, 10: "a b c", 11: "é x é x y".replace(" ", "_")}
    return score(all_texts)


@pytest.mark.parametrize(("head", "sample", "size"), [(0, 1, 1 << 22), (1, 1, 1 << 22), (3, 1, 50), (1 << 16, 1, 1 << 22), (1 << 16, 1 << 40, 1)])
def test_scores_do_not_depend_on_the_head(spark, texts, monkeypatch, head, sample, size):
    for name, value in (("HEAD", head), ("SAMPLE", sample), ("PART_BYTES", size)):
        monkeypatch.setattr(NG, name, value)
    got = {r["id"]: r for r in NG.score_perplexity(NG.fit_bigram(texts, "t"), texts, ["id"], F.col("t")).collect()}
    assert len(got) == len(TEXTS) + 3 and got[9]["ppl"] is None and got[9]["n_pred"] == 0
    assert all(got[i]["ppl"] == pytest.approx(p, rel=1e-9) if p else got[i]["ppl"] is None for i, p in want().items())


def test_rows_that_leave_the_scan_do_not_grow_with_the_tokens(spark, monkeypatch):
    """Before, every token of a short text was two rows of the lookup's join."""
    monkeypatch.setattr(NG, "SAMPLE", 1)
    texts = spark.createDataFrame([(i, "the cat sat on the mat " * 9 + f"u{i}") for i in range(40)], "id long, t string")
    seen, join = [], type(texts).join

    def counted(self, other, *a, **k):
        if "_pos" in self.columns:
            seen.append(self.count())
        return join(self, other, *a, **k)

    model = NG.fit_bigram(texts, "t")
    monkeypatch.setattr(type(texts), "join", counted)
    out = NG.score_perplexity(model, texts, ["id"], F.col("t"))
    assert seen == [40]  # "mat u<i>" alone is no frequent gram
    assert out.where("n_pred = 54 and ppl is not null").count() == 40


def test_truncated_texts(spark, texts, monkeypatch):
    monkeypatch.setattr(NG, "SAMPLE", 1)
    model = NG.fit_bigram(texts, "t")
    short = texts.select("id", F.array_join(F.slice(NG.T.tokens("t"), 1, 3), " ").alias("t"))
    a = NG.score_perplexity(model, texts, ["id"], F.col("t"), max_length=3).collect()
    b = NG.score_perplexity(model, short, ["id"], F.col("t")).collect()
    assert {r["id"]: (r["n_pred"], r["ppl"]) for r in a} == {r["id"]: (r["n_pred"], r["ppl"]) for r in b}
    assert np.max([r["n_pred"] for r in a]) == 2
