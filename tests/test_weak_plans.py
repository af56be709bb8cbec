"""Plans and hot keys of scoring, sampling, text pairs, lookups and evaluators."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rewardforge.functions import registry as REG
from rewardforge.operators import answers as P
from rewardforge.operators import evalstats as E
from rewardforge.operators import ngram as NG
from rewardforge.operators import pairs as D
from rewardforge.operators import tree as TR
from rewardforge.operators.keyed import with_per_key
from rewardforge.operators.overlap import rouge_n
from rewardforge.sources import qa as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def score(texts, k=1.0):
    grams, context, vocabulary = Counter(), Counter(), set()
    for t in texts.values():
        w = t.split()
        vocabulary.update(w)
        grams.update(zip(w, w[1:]))
        context.update(w[:-1])
    out = {}
    for i, t in texts.items():
        w = t.split()
        lp = [math.log((grams[p] + k) / (context[p[0]] + k * (len(vocabulary) + 1))) for p in zip(w, w[1:])]
        out[i] = round(math.exp(-sum(lp) / len(lp)), 6) if lp else None
    return out


TEXTS = {1: "a b " * 1500, 2: "a", 3: "", 4: "a a a c", 5: "the " * 1024 + "end", 6: "the x the y the z", 7: " lead and  trail ", 8: "the " * 1026}


def test_scores_are_alike_with_and_without_broadcast(spark, request):
    df = spark.createDataFrame(list(TEXTS.items()), "id long, t string").repartition(3)
    want = score(TEXTS)
    model = NG.fit_bigram(df, "t")
    for fixture in (None, "no_broadcast"):
        if fixture:
            request.getfixturevalue(fixture)
        scored = NG.score_perplexity(model, df, ["id"], F.col("t"))
        lookups = plan(scored).count("SortMergeJoin")
        got = {r["id"]: r for r in scored.collect()}
        assert {i: r["n_pred"] for i, r in got.items()} == {i: max(0, len(t.split()) - 1) for i, t in TEXTS.items()}
        assert all(got[i]["ppl"] == pytest.approx(want[i], rel=1e-9) if want[i] else got[i]["ppl"] is None for i in TEXTS)
    assert lookups == 1  # pairs and contexts take one lookup


def test_long_texts_are_counted_in_their_row(spark):
    df = spark.createDataFrame([(1, "the " * 100_000)], "id long, t string").select("id", F.split(F.trim("t"), " ").alias("_tok"))
    rows = NG._gram_counts(df, ["id"]).collect()
    assert {(r["gram"], r["n"]) for r in rows} == {("the ", 99_999), ("the the", 99_999)} and len(rows) == 2


def test_two_models_share_the_lookup(spark, no_broadcast):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b")], "id long, t string")
    other = spark.createDataFrame([("b c b",)], "t string")
    both = NG.score_perplexities({"x": NG.fit_bigram(df, "t"), "y": NG.fit_bigram(other, "t")}, df, ["id"], F.col("t"))
    assert plan(both).count("SortMergeJoin") == 1
    alone = {r["id"]: r["ppl"] for r in NG.score_perplexity(NG.fit_bigram(other, "t"), df, ["id"], F.col("t")).collect()}
    assert {r["id"]: r["ppl_y"] for r in both.collect()} == alone


def test_sample_filters_rows_and_sorts_none(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE_DIGITS", 1)
    monkeypatch.setattr(S, "SAMPLE_CUT", 3)
    qa = spark.range(500).select(F.col("id").alias("qa_id"), F.lit("train").alias("split"), F.repeat(F.lit("x"), F.lit(100)).alias("question"))
    for n in (0, 1, 7, 250, 499, 500, 501):
        out = S.qa_sample(qa, n)
        assert out.count() == min(n, 500) and "Sort" not in plan(out) and "Exchange" not in plan(out)
    first = qa.withColumn("h", S.T.seeded_hash_key(F.col("qa_id"))).orderBy("h").limit(20).select("qa_id").collect()
    assert {r.qa_id for r in S.qa_sample(qa, 20).collect()} == {r.qa_id for r in first}


def test_chunks_and_batches_checkpoint_ids_only(spark, monkeypatch):
    from rewardforge.operators import ordering

    seen, cut = [], ordering.cut_lineage
    monkeypatch.setattr(ordering, "cut_lineage", lambda df: seen.append(df.columns) or cut(df))
    rows = spark.createDataFrame([(i, "x" * 900) for i in range(25)] + [(None, "y")], "k long, chosen string").repartition(4)
    got = sorted((r.idx, r.k, r.chunk_id, r.chosen[0]) for r in S.chunk_assign(rows, ["k"], 10).where("k is not null").collect())
    assert got == [(i + 1, i, (i + 1) // 10, "x") for i in range(25)]
    assert S.chunk_assign(rows, ["k"], 10).where("k is null and idx = 0 and chosen = 'y'").count() == 1
    assert S.batch_assign(rows, "k", epochs=2, batch_size=4).where("chosen is not null").count() == 52
    assert seen and all("chosen" not in columns for columns in seen)


PAIRS = [(1, "a a b", "a b b b c"), (2, "", "x"), (3, None, "x"), (4, "same text", "same text"), (5, " x\ty ", "z")]


def cosine(a, b):
    x, y = Counter((a or "").split()), Counter((b or "").split())
    dot, na, nb = sum(x[t] * y[t] for t in x), sum(v * v for v in x.values()), sum(v * v for v in y.values())
    return dot / (math.sqrt(na) * math.sqrt(nb)) if na * nb else 0.0


def overlap(a, b, n):
    x, y = ((a or "").split(), (b or "").split())
    x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (x, y))
    return sum((x & y).values()), sum(x.values()), sum(y.values())


def test_text_pairs_need_no_shuffle(spark):
    df = spark.createDataFrame(PAIRS, "id long, p string, q string")
    cos, rouge = TR.text_cosine(df, ["id"], "p", "q"), rouge_n(df, ["id"], "p", "q")
    assert "Exchange" not in plan(cos) and "Exchange" not in plan(rouge)
    assert {r["id"]: r["cosine"] for r in cos.collect()} == pytest.approx({i: cosine(a, b) for i, a, b in PAIRS})
    got = {(r["id"], r["n"]): r for r in rouge.collect()}
    for i, a, b in PAIRS:
        for n in (1, 2):
            match, ref, cand = overlap(a, b, n)
            r = got[i, n]
            assert r["match"] == match and r["recall"] == (match / ref if ref else 0.0) and r["precision"] == (match / cand if cand else 0.0)


def test_text_pairs_of_100000_tokens(spark):
    a, b = (" ".join(f"t{i * k % 997}" for i in range(100_000)) for k in (3, 7))
    df = spark.createDataFrame([(1, a, b)], "id long, p string, q string")
    assert TR.text_cosine(df, ["id"], "p", "q").first()["cosine"] == pytest.approx(cosine(a, b))
    assert [r["match"] for r in rouge_n(df, ["id"], "p", "q").orderBy("n").collect()] == [overlap(a, b, n)[0] for n in (1, 2)]


def test_many_runs_and_repeated_keys(spark):
    log = spark.range(300_000).select(
        F.when(F.col("id") < 100_000, F.lit(-1)).otherwise(F.col("id") % 100_000).alias("run"), (F.col("id") + 1).alias("step"),
        F.lit(0.5).alias("accuracy"), F.lit(2.0).alias("perplexity"),
    )
    last = E.eval_gate(log, 10**9, ["run"]).where("evaluated").count()
    assert last == 100_001  # the last record of each run, the hot one included
    assert E.hist_density(log, ["run"], "step").where("bin = 9").count() == 100_001
    table = spark.createDataFrame([("a", 1), ("a", 1), (None, 2)], "k string, v int")
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    assert sorted(map(str, (r["v"] for r in with_per_key(rows, table, ["k"]).collect()))) == ["1", "2", "None"]


def test_python_evaluators_share_one_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame([(f"py{i % 3}" if i % 4 else "hard", "p", "#### 1", float(i)) for i in range(40)], "e string, p string, r string, g double").write.parquet(path)
    try:
        for k in range(3):
            REG.register_python(f"py{k}", lambda p, r, g, k=k: g * 0 + k)
        out = REG.evaluate(spark.read.parquet(path), "e", "p", "r", "g")
        assert plan(out).count("FileScan") == 1 and plan(out).count("ArrowEvalPython") == 1
        assert all(r["reward"] == (float(r["e"][2:]) if r["e"] != "hard" else float(r["g"] == 1.0)) for r in out.collect())
    finally:
        for k in range(3):
            REG._REGISTRY.pop(f"py{k}")
            REG._PYTHON.discard(f"py{k}")


def test_advantage_scores_once_and_splits_a_hot_prompt(spark):
    rows = spark.createDataFrame([(i if i < 20 else 99, i, float(i % 5)) for i in range(200)], "q long, s long, r double")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(r):
        calls.add(1)
        return r

    out = D.group_advantage(rows.withColumn("r", seen("r")), "q", "r").collect()
    assert calls.value == 200 and abs(sum(r["advantage"] for r in out if r["q"] == 99)) < 1e-9


def test_padding_takes_one_shuffle(spark):
    df = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "b", "c"]), (2, 2, [])], "b long, i long, t array<string>")
    out = P.pad_batches(df, ["b"], ["t"], "<pad>")
    assert plan(out).count("Exchange hashpartitioning") == 1
    assert {r["i"]: r["t_padded"] for r in out.collect()} == {0: ["a", "<pad>", "<pad>"], 1: ["a", "b", "c"], 2: []}
