"""Registered queries: one callable (spark, sf_dir) -> DataFrame per SURVEY 2 key.

Each query reads the driver tables (through the fixture views) in full.
Column names equal those of the oracle SQL in ``oracle_queries``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers as P
from ..operators import evalstats as E
from ..operators import ngram as NG
from ..operators import pairs as D
from ..operators import rewards as R
from ..operators import tree as TR
from ..sources import fixtures as FX
from ..sources import qa as S
from ..sources import sinks as SK

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(key: str):
    def deco(fn: Query) -> Query:
        REGISTRY[key] = fn
        return fn

    return deco


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return E.scored_responses(FX.response(spark, sf), FX.qa(spark, sf))


# ---------------- 2.2 text and math scalar work ----------------
@query("normalize_text")
def q_normalize_text(spark, sf):
    return P.normalize_text(FX.qa(spark, sf))


@query("gold_answer")
def q_gold_answer(spark, sf):
    return P.gold_answer(FX.qa(spark, sf)).select("qa_id", "gold_first", "gold_last", "gold_or_zero")


@query("extract_marker")
def q_extract_marker(spark, sf):
    r = FX.response(spark, sf)
    return r.select("qa_id", "sample_idx", T.extract_marker("response").alias("pred_marker"))


@query("extract_cascade")
def q_extract_cascade(spark, sf):
    r = FX.response(spark, sf)
    return r.select("qa_id", "sample_idx", T.extract_cascade("response").alias("pred_cascade"))


@query("hard_reward")
def q_hard_reward(spark, sf):
    return _scored(spark, sf).select(
        "qa_id", "sample_idx", "model", "correct_answer", "hard_marker", "hard_cascade", "hard_exact"
    )


@query("response_gold_join")
def q_response_gold_join(spark, sf):
    j = E.response_gold_join(FX.response(spark, sf), FX.qa(spark, sf))
    return j.select("qa_id", "sample_idx", "model", "split", "correct_answer")


# ---------------- 2.5 aggregations ----------------
@query("eval_accuracy")
def q_eval_accuracy(spark, sf):
    return E.eval_accuracy(_scored(spark, sf))


@query("eval_accuracy_ppl")
def q_eval_accuracy_ppl(spark, sf):
    ppl = _resp_ppl(spark, sf, _current_model(spark, sf)).select("qa_id", "sample_idx", "ppl")
    acc = E.eval_accuracy(_scored(spark, sf).join(ppl, ["qa_id", "sample_idx"]), perplexity_col="ppl")
    return acc.withColumn("mean_perplexity", F.round("mean_perplexity", 6))


@query("hard_reward_prompt")
def q_hard_reward_prompt(spark, sf):
    return E.scored_responses(FX.response(spark, sf), FX.qa(spark, sf), include_prompt=True).select(
        "qa_id", "sample_idx", "pred_marker", "pred_cascade", "hard_marker", "hard_cascade"
    )


# ---------------- shared building blocks ----------------
def _samples(spark, sf):
    return P.build_samples(FX.qa(spark, sf))


def _current_model(spark, sf):
    """Bigram model of the current training slice: answers of the train split."""
    return NG.fit_bigram(FX.qa(spark, sf).where(F.col("split") == "train"), "answer")


def _base_model(spark, sf):
    """Frozen baseline bigram model: all conversation turns."""
    return NG.fit_bigram(FX.conversations_text(spark, sf), "text")


def _resp_text():
    return F.concat(F.col("prompt"), F.lit(" "), F.col("response"))


def _resp_ppl(spark, sf, model):
    return NG.score_perplexity(model, FX.response(spark, sf), ["qa_id", "sample_idx"], _resp_text())


def _rewarded(spark, sf):
    """Scored responses with the log reward (A4, marker reader) of each."""
    j = _scored_ppl(spark, sf, "hard_marker")
    return j.withColumn("reward", R.reward_log(F.col("ppl"), F.lit(None), F.col("hard_marker") > 0.5, words=F.col("words")))


def _scored_ppl(spark, sf, hard):
    """Perplexity, words and one hard reward per response: texts are read once, only numbers leave the scoring."""
    sc = _scored(spark, sf).withColumn("words", T.word_count("response"))
    return NG.score_perplexity(_current_model(spark, sf), sc, ["qa_id", "sample_idx", "words", hard], _resp_text())


def _side_scorer_log(spark, sf):
    model = _current_model(spark, sf)

    def score(sides):
        right = T.is_right(T.extract_marker("text"), F.col("correct_answer"))
        sides = sides.withColumn("words", T.word_count("text")).withColumn("right", right)
        ppl = NG.score_perplexity(model, sides, ["qa_id", "side", "words", "right"], F.concat(F.col("prompt"), F.lit(" "), F.col("text")))
        return ppl.select("qa_id", "side", R.reward_log(F.col("ppl"), F.lit(None), F.col("right"), words=F.col("words")).alias("reward"))

    return D.sides_scorer(score, "qa_id")


def _side_scorer_relative(spark, sf):
    base, cur = _base_model(spark, sf), _current_model(spark, sf)

    def score(sides):
        sides = sides.withColumn("hard", T.hard_reward(T.extract_marker("text"), F.col("correct_answer")))
        j = _both_ppl(base, cur, sides, ["qa_id", "side", "hard"], T.scored_text("prompt", "text", "qa"))
        return j.select("qa_id", "side", R.reward_relative(F.col("base_ppl"), F.col("train_ppl"), F.col("hard")).alias("reward"))

    return D.sides_scorer(score, "qa_id")


def _both_ppl(base, cur, df, ids, text):
    """J1 in one pass: baseline and training perplexity of the same texts."""
    both = NG.score_perplexities({"base": base, "train": cur}, df, ids, text)
    return both.select(*ids, F.col("ppl_base").alias("base_ppl"), F.col("ppl_train").alias("train_ppl"))


# ---------------- 2.1 scans, sources, sinks ----------------
@query("qa_sample")
def q_qa_sample(spark, sf):
    return S.qa_sample(FX.qa(spark, sf), 1000, "train").select("qa_id", "question", "answer")


@query("preference_scan")
def q_preference_scan(spark, sf):
    return S.preference_scan(FX.preference_raw(spark, sf))


@query("chunk_assign")
def q_chunk_assign(spark, sf):
    return S.chunk_assign(S.preference_scan(FX.preference_raw(spark, sf)), ["conv_id", "turn"]).select(
        "conv_id", "turn", "idx", "chunk_id"
    )


@query("chunk_examples")
def q_chunk_examples(spark, sf):
    chunks = S.chunk_assign(S.preference_scan(FX.preference_raw(spark, sf)), ["conv_id", "turn"])
    epochs = _scored(spark, sf).groupBy(F.col("qa_id").alias("epoch")).agg(F.max("hard_marker").alias("reward"))
    ex = S.chunk_examples(chunks, epochs, ["conv_id", "turn"])
    return ex.select("chunk_id", "row_in_chunk", "conv_id", "turn", "input", "output", "n_epochs")


@query("preference_export")
def q_preference_export(spark, sf):
    pairs = D.pairs_ranked(_samples(spark, sf), D.hard_side_scorer)
    return D.flatten_pairs(SK.preference_export(pairs))


@query("batch_assign")
def q_batch_assign(spark, sf):
    prompts = P.rl_prompts(_samples(spark, sf)).select("qa_id")
    return S.batch_assign(prompts, "qa_id", epochs=3, batch_size=4).select("epoch", "qa_id", "idx", "batch_id")


# ---------------- 2.2 (continued) ----------------
@query("chosen_text")
def q_chosen_text(spark, sf):
    return _samples(spark, sf).select("qa_id", "prompt", "chosen", "chosen_variant", "correct_answer")


@query("rejected_text")
def q_rejected_text(spark, sf):
    return _samples(spark, sf).select("qa_id", "correct_answer", "wrong_answer", "rejected", "unchanged")


@query("rejected_text_final")
def q_rejected_text_final(spark, sf):
    return P.build_samples(FX.qa(spark, sf), mode="final").select("qa_id", "correct_answer", "wrong_answer", "rejected", "unchanged")


@query("chat_messages")
def q_chat_messages(spark, sf):
    m = P.chat_messages(_samples(spark, sf))
    return m.select(
        "qa_id",
        *[F.try_element_at(f"{s}_messages", F.lit(1))[f].alias(f"{s}_{f}") for s in ("prompt", "chosen", "rejected") for f in ("role", "content")],
    )


@query("chat_template")
def q_chat_template(spark, sf):
    return P.chat_template(FX.qa(spark, sf)).select("qa_id", "sft_text", "eval_prompt")


@query("chat_template_conv")
def q_chat_template_conv(spark, sf):
    return P.chat_template_turns(FX.conversations_text(spark, sf))


@query("rl_prompts")
def q_rl_prompts(spark, sf):
    return P.rl_prompts(_samples(spark, sf))


@query("length_bonus")
def q_length_bonus(spark, sf):
    return P.length_bonus(FX.response(spark, sf)).select("qa_id", "sample_idx", "words", "bonus_log", "bonus_linear")


@query("completion_filter")
def q_completion_filter(spark, sf):
    docs = FX.read_table(spark, sf, "documents", "doc_id", "text")
    out = FX.read_table(spark, sf, "labels", "doc_id", "quality").select("doc_id", F.col("quality").cast("string").alias("output"))
    return P.completion_filter(docs, out, "doc_id")


@query("pad_batches")
def q_pad_batches(spark, sf):
    samples = _samples(spark, sf)
    texts = samples.select("qa_id", F.col("prompt").alias("query"), "chosen")  # P10 with the text to pad
    b = S.batch_assign(texts, "qa_id", epochs=1, batch_size=4)
    b = b.withColumn("q_tok", T.tokens("query")).withColumn("r_tok", T.tokens("chosen"))
    p = P.pad_batches(b, ["epoch", "batch_id"], ["q_tok", "r_tok"], "<pad>")
    return p.select(
        "epoch", "batch_id", "qa_id", F.col("q_tok_pad").alias("query_pad"), F.col("r_tok_pad").alias("response_pad"),
        F.array_join("q_tok_padded", " ").alias("query_padded"), F.array_join("r_tok_padded", " ").alias("response_padded"),
    )


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    docs = FX.read_table(spark, sf, "documents", "doc_id", "text").withColumn("tok", T.tokens("text"))
    t = P.truncate_tokens(docs, "tok", NG.MAX_LENGTH)
    return t.select("doc_id", F.size("tok").alias("n_tokens"), F.size("tok_kept").alias("n_kept"), F.array_join("tok_kept", " ").alias("kept_text"))


# ---------------- 2.3 perplexity and continuous rewards ----------------
@query("perplexity_logged")
def q_perplexity_logged(spark, sf):
    tl = FX.token_logprob(spark, sf)
    return NG.perplexity_from_logprobs(tl, "sample_id", "pos", {"ppl_train": "logp_train", "ppl_base": "logp_base"})


@query("ngram_train")
def q_ngram_train(spark, sf):
    m = _current_model(spark, sf)
    return m.pairs.join(m.contexts, "prev").withColumn("vocab", m.vocab.scalar())


@query("ngram_perplexity")
def q_ngram_perplexity(spark, sf):
    return _resp_ppl(spark, sf, _current_model(spark, sf))


@query("reward_log")
def q_reward_log(spark, sf):
    return _rewarded(spark, sf).select("qa_id", "sample_idx", "ppl", F.col("reward").alias("reward_log"))


@query("reward_linear")
def q_reward_linear(spark, sf):
    j = _scored_ppl(spark, sf, "hard_cascade")
    r = R.reward_linear(F.col("ppl"), F.lit(None), F.col("hard_cascade") > 0.5, words=F.col("words"))
    return j.select("qa_id", "sample_idx", "ppl", r.alias("reward_linear"))


def _relative(spark, sf):
    return _both_ppl(_base_model(spark, sf), _current_model(spark, sf), FX.response(spark, sf), ["qa_id", "sample_idx"], T.scored_text("prompt", "response", "qa"))


@query("baseline_join")
def q_baseline_join(spark, sf):
    return _relative(spark, sf)


@query("reward_relative")
def q_reward_relative(spark, sf):
    ids, text = ["qa_id", "sample_idx", "hard_marker"], T.scored_text("prompt", "response", "qa")
    j = _both_ppl(_base_model(spark, sf), _current_model(spark, sf), _scored(spark, sf), ids, text)
    r = R.reward_relative(F.col("base_ppl"), F.col("train_ppl"), F.col("hard_marker"))
    return j.select("qa_id", "sample_idx", "base_ppl", "train_ppl", r.alias("reward_relative"))


@query("reward_relative_plain")
def q_reward_relative_plain(spark, sf):
    r = R.reward_relative(F.col("base_ppl"), F.col("train_ppl"))
    return _relative(spark, sf).select("qa_id", "sample_idx", "base_ppl", "train_ppl", r.alias("reward_relative"))


@query("reward_vs_gold")
def q_reward_vs_gold(spark, sf):
    model = _current_model(spark, sf)
    gold = NG.score_perplexity(model, FX.qa(spark, sf), ["qa_id"], F.concat(F.col("question"), F.lit(" "), F.col("answer")))
    resp = _resp_ppl(spark, sf, model)
    j = resp.select("qa_id", "sample_idx", F.col("ppl").alias("resp_ppl")).join(gold.select("qa_id", F.col("ppl").alias("gold_ppl")), "qa_id")
    return j.withColumn("reward_vs_gold", R.reward_vs_gold(F.col("gold_ppl"), F.col("resp_ppl")))


# ---------------- 2.6 preference pairs ----------------
@query("pairs_ranked")
def q_pairs_ranked(spark, sf):
    return D.flatten_pairs(D.pairs_ranked(_samples(spark, sf), D.hard_side_scorer))


@query("pairs_ranked_ppl")
def q_pairs_ranked_ppl(spark, sf):
    return D.flatten_pairs(D.pairs_ranked(_samples(spark, sf), _side_scorer_log(spark, sf)))


@query("pairs_fixed")
def q_pairs_fixed(spark, sf):
    return D.flatten_pairs(D.pairs_fixed(_samples(spark, sf)))


@query("pairs_fixed_ppl")
def q_pairs_fixed_ppl(spark, sf):
    return D.flatten_pairs(D.pairs_fixed(_samples(spark, sf), _side_scorer_relative(spark, sf)))


def _right(spark, sf):
    return _scored(spark, sf).withColumn("right", F.col("hard_marker") > 0.5)


@query("shortest_correct")
def q_shortest_correct(spark, sf):
    return D.shortest_correct(_right(spark, sf), "qa_id", "sample_idx", "response", "right")


@query("all_correct")
def q_all_correct(spark, sf):
    return D.shortest_correct(_right(spark, sf), "qa_id", "sample_idx", "response", "right", mode="all")


@query("pairs_by_length")
def q_pairs_by_length(spark, sf):
    return D.pairs_by_length(_right(spark, sf), "qa_id", "sample_idx", "response", "right")


@query("group_advantage")
def q_group_advantage(spark, sf):
    a = D.group_advantage(_scored(spark, sf).select("qa_id", "sample_idx", "hard_marker"), "qa_id", "hard_marker")
    return a.select("qa_id", "sample_idx", F.col("hard_marker").alias("reward"), F.round("advantage", 9).alias("advantage"))


@query("pairs_best_worst")
def q_pairs_best_worst(spark, sf):
    return D.pairs_best_worst(_rewarded(spark, sf), "qa_id", "sample_idx", "reward")


@query("reward_gap")
def q_reward_gap(spark, sf):
    pairs = D.pairs_best_worst(_rewarded(spark, sf), "qa_id", "sample_idx", "reward")
    return D.reward_gap(pairs).select("qa_id", "gap", "weight")


@query("difficulty_balance")
def q_difficulty_balance(spark, sf):
    return D.difficulty_balance(_right(spark, sf), "qa_id", "right")


def _seq_logprobs(spark, sf):
    tl = FX.token_logprob(spark, sf).where(F.col("pos") >= 2)
    seq = tl.groupBy("sample_id").agg(
        F.sum("logp_train").alias("logp"), F.sum("logp_base").alias("logp_ref"), F.avg("logp_train").alias("mean_logp")
    )
    return seq.select(
        F.floor(F.col("sample_id") / 2).alias("pair_id"),
        F.when(F.col("sample_id") % 2 == 0, "chosen").otherwise("rejected").alias("side"),
        "logp", "logp_ref", "mean_logp",
    )


@query("preference_loss_audit")
def q_preference_loss_audit(spark, sf):
    return D.preference_loss_audit(_seq_logprobs(spark, sf), "pair_id")


@query("preference_loss_summary")
def q_preference_loss_summary(spark, sf):
    return D.preference_loss_summary(D.preference_loss_audit(_seq_logprobs(spark, sf), "pair_id"))


# ---------------- 2.5 / 2.7 metric logs ----------------
def _gated(spark, sf):
    return E.eval_gate(FX.metric_log(spark, sf), E.EVAL_EVERY_FULL)


@query("eval_gate")
def q_eval_gate(spark, sf):
    return _gated(spark, sf).select("reward_type", "step", "evaluated", "loss", "accuracy", "perplexity")


@query("running_best")
def q_running_best(spark, sf):
    return E.running_best(_gated(spark, sf)).select("reward_type", "step", "accuracy", "best_before", "best_after", "new_best")


@query("run_summary")
def q_run_summary(spark, sf):
    return E.run_summary(_gated(spark, sf))


@query("winner_pair")
def q_winner_pair(spark, sf):
    return E.winner_pair(E.run_summary(_gated(spark, sf)))


@query("winner_three")
def q_winner_three(spark, sf):
    acc = E.eval_accuracy(_scored(spark, sf))
    return E.argmax_priority(acc, ["strategy"], "model", "accuracy", ["model_0", "model_1", "model_2"])


@query("batch_mean_reward")
def q_batch_mean_reward(spark, sf):
    sc = _scored(spark, sf).select("qa_id", "sample_idx", "hard_marker")
    b = S.batch_assign(sc, F.concat_ws(":", "qa_id", "sample_idx"), epochs=3, batch_size=4, carry=["hard_marker"])
    return E.batch_mean_reward(b, "hard_marker")


@query("hist_density")
def q_hist_density(spark, sf):
    g = _gated(spark, sf)
    vals = g.select("reward_type", F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")).unionByName(
        g.where(F.col("perplexity").isNotNull() & (F.col("perplexity") != 0)).select(
            "reward_type", F.lit("perplexity").alias("metric"), F.col("perplexity").alias("value")
        )
    )
    return E.hist_density(vals, ["reward_type", "metric"], "value")


@query("series_by_step")
def q_series_by_step(spark, sf):
    return E.series_by_step(_gated(spark, sf))


@query("metrics_union")
def q_metrics_union(spark, sf):
    g = _gated(spark, sf).select("reward_type", "step", "loss", "accuracy", "perplexity")
    return E.metrics_union(g.where(F.col("reward_type") == "hard"), g.where(F.col("reward_type") == "perplexity"))


@query("first_n_per_group")
def q_first_n_per_group(spark, sf):
    r = FX.response(spark, sf)
    return E.first_n_per_group(r, ["model"], ["qa_id", "sample_idx"], E.EVAL_SIZE).select("model", "qa_id", "sample_idx", "rn")


@query("report_json")
def q_report_json(spark, sf):
    g = _gated(spark, sf)
    summ = E.run_summary(g)
    path = SK.write_report(E.winner_pair(summ), summ, g, {"eval_every": E.EVAL_EVERY_FULL, "eval_size": E.EVAL_SIZE})
    _, metrics = SK.read_report(spark, path)
    return metrics.select("reward_type", "step", "loss", "accuracy", "perplexity", "final_accuracy", "best_accuracy")


@query("report_summary")
def q_report_summary(spark, sf):
    g = _gated(spark, sf)
    summ = E.run_summary(g)
    path = SK.write_report(E.winner_pair(summ), summ, g, {"eval_every": E.EVAL_EVERY_FULL, "eval_size": E.EVAL_SIZE})
    doc, _ = SK.read_report(spark, path)
    return doc.select(
        "dataset", "winner_final", "winner_best", "improvement", "recommendation", F.size("runs").alias("n_runs"),
        *[c for c in doc.columns if c.startswith(("final_accuracy_", "best_accuracy_"))],
    )


@query("scalar_log")
def q_scalar_log(spark, sf):
    return SK.scalar_log(_gated(spark, sf))


# ---------------- 2.8 search-tree analytics ----------------
NODE_PROMPT_TEMPLATE = "Question: [Insert your query here]\nSo far: [Insert your context here]\nNext token:"


def _tree(spark, sf):
    nodes = FX.tree_node(spark, sf)
    return nodes, TR.node_paths(nodes)


def _stats(spark, sf, nodes, paths):
    from ..session import cut_lineage

    # one row per node, read by the parent join on both sides
    return cut_lineage(TR.backup_rewards(nodes, paths, FX.rollout(spark, sf)))


def _ucb(spark, sf, nodes, paths):
    stats = _stats(spark, sf, nodes, paths)
    w = TR.node_weights(nodes, paths, FX.rollout(spark, sf))
    return TR.ucb_score(TR.parent_join(nodes, stats).join(w, "node_id"))


def _combined(spark, sf):
    nodes, paths = _tree(spark, sf)
    u = _ucb(spark, sf, nodes, paths)
    pairs = nodes.where(F.col("parent_id").isNotNull()).select("node_id", "parent_id", "token").join(
        nodes.select(F.col("node_id").alias("parent_id"), F.col("token").alias("primary_token")), "parent_id"
    )
    cos = TR.text_cosine(pairs, ["node_id"], "primary_token", "token")
    j = u.join(cos, "node_id")
    inf = F.col("ucb") == float("inf")
    comb = F.when(inf, F.lit(float("inf"))).otherwise(F.col("ucb") + F.col("cosine") * F.col("weight"))
    return j.withColumn("combined", comb)


@query("node_paths")
def q_node_paths(spark, sf):
    _, paths = _tree(spark, sf)
    return paths.ancestors.select("node_id", "ancestor_id", "ancestor_depth", "depth")


@query("expand_nodes")
def q_expand_nodes(spark, sf):
    nodes, paths = _tree(spark, sf)
    # insertion order: teachers in order, each one's right tokens before its wrong ones
    order = F.struct("model", "dir_rank", "node_id").alias("seq")
    cand = TR.candidate_union(nodes).select("parent_id", "token", "bit", "model", order)
    out = TR.expand_nodes(cand, paths.nodes)
    return out.withColumn("place", F.col("place.node_id")).withColumn("winner_seq", F.col("winner_seq.node_id"))


@query("candidate_union")
def q_candidate_union(spark, sf):
    return TR.candidate_union(FX.tree_node(spark, sf))


@query("token_set")
def q_token_set(spark, sf):
    return TR.token_set(FX.tree_node(spark, sf))


def _prompt_fill(nodes):
    info = TR.node_paths(nodes).nodes
    req = nodes.where(F.col("parent_id").isNotNull()).groupBy("parent_id", "model", "bit").agg(F.collect_set("token").alias("taken"))
    req = req.join(info.select(F.col("node_id").alias("parent_id"), "query", "context"), "parent_id")
    return P.prompt_fill(req, NODE_PROMPT_TEMPLATE, "query", "context", "taken").select("parent_id", "model", "bit", "prompt_text")


@query("prompt_fill")
def q_prompt_fill(spark, sf):
    return _prompt_fill(FX.tree_node(spark, sf))


@query("prompt_fill_forest")
def q_prompt_fill_forest(spark, sf):
    return _prompt_fill(FX.forest_node(spark, sf))


@query("backup_rewards")
def q_backup_rewards(spark, sf):
    nodes, paths = _tree(spark, sf)
    return _stats(spark, sf, nodes, paths)


@query("parent_join")
def q_parent_join(spark, sf):
    nodes, paths = _tree(spark, sf)
    return TR.parent_join(nodes, _stats(spark, sf, nodes, paths)).select("node_id", "parent_id", "visits", "parent_visits")


@query("node_weights")
def q_node_weights(spark, sf):
    nodes, paths = _tree(spark, sf)
    return TR.node_weights(nodes, paths, FX.rollout(spark, sf))


@query("node_weights_uniform")
def q_node_weights_uniform(spark, sf):
    nodes, paths = _tree(spark, sf)
    return TR.node_weights(nodes, paths, FX.rollout(spark, sf), init="uniform")


@query("ucb_score")
def q_ucb_score(spark, sf):
    nodes, paths = _tree(spark, sf)
    return _ucb(spark, sf, nodes, paths).select("node_id", "parent_id", "visits", "ucb")


@query("combined_score")
def q_combined_score(spark, sf):
    return _combined(spark, sf).select("node_id", "parent_id", "ucb", "cosine", "combined")


@query("top_child")
def q_top_child(spark, sf):
    return TR.top_child(_combined(spark, sf), "combined")


@query("best_path")
def q_best_path(spark, sf):
    nodes, paths = _tree(spark, sf)
    return TR.best_path(nodes, paths, _stats(spark, sf, nodes, paths))


@query("best_path_forest")
def q_best_path_forest(spark, sf):
    nodes = FX.forest_node(spark, sf)
    paths = TR.node_paths(nodes)
    return TR.best_path(nodes, paths, _stats(spark, sf, nodes, paths))


def _path_reward(spark, sf, nodes):
    model = NG.fit_bigram(nodes, "token")
    nodes = nodes.join(FX.tree_gold(spark, sf), "node_id")
    # the baseline of a tree: its query with the gold answer
    roots = nodes.where(F.col("parent_id").isNull())
    base = NG.score_perplexity(model, roots, ["node_id"], F.concat(F.col("token"), F.lit(" "), F.col("gold_text")))
    nodes = nodes.join(base.select("node_id", F.col("ppl").alias("base_ppl")), "node_id", "left")
    info = TR.node_paths(nodes, ["gold", "base_ppl"]).nodes
    ppl = NG.score_perplexity(model, info, ["node_id", "base_ppl"], F.concat(F.col("query"), F.lit(" "), F.col("context")))
    pr = ppl.select("node_id", R.reward_vs_gold(F.col("base_ppl"), F.col("ppl")).alias("ppl_reward"))
    judged = FX.node_judge(spark, sf).where(F.col("output") == "1").join(info, "node_id")
    term = judged.select("node_id", T.hard_reward(T.extract_marker("context"), F.col("gold")).alias("terminal_reward"))
    return TR.path_reward(info, pr, term)


@query("path_reward")
def q_path_reward(spark, sf):
    return _path_reward(spark, sf, FX.tree_node(spark, sf))


@query("path_reward_forest")
def q_path_reward_forest(spark, sf):
    return _path_reward(spark, sf, FX.forest_node(spark, sf))


@query("seeded_pick")
def q_seeded_pick(spark, sf):
    kids = FX.tree_node(spark, sf).where(F.col("parent_id").isNotNull())
    return TR.seeded_pick(kids, "parent_id", "node_id")


@query("teacher_weights")
def q_teacher_weights(spark, sf):
    nodes = FX.tree_node(spark, sf)
    uses = FX.rollout(spark, sf).join(nodes.select(F.col("node_id").alias("leaf_id"), "model"), "leaf_id").select("model", "iter", "reward")
    return TR.teacher_weights(uses, nodes.select("model").distinct())


# ---------------- 2.4 joins over text pairs ----------------
@query("token_cosine")
def q_token_cosine(spark, sf):
    return TR.text_cosine(FX.chat_pair(spark, sf), ["conv_id", "turn"], "prompt", "response")


@query("reward_shift")
def q_reward_shift(spark, sf):
    docs = FX.read_table(spark, sf, "documents", "doc_id", "text")
    r = docs.select("doc_id", F.least(F.lit(0.3), T.word_count("text") / 100.0).alias("reward"))
    j = r.join(FX.judge(spark, sf), "doc_id", "left")
    return j.select("doc_id", "reward", "shift", (F.col("reward") + F.coalesce(F.col("shift"), F.lit(0))).alias("shifted_reward"))


@query("rouge_overlap")
def q_rouge_overlap(spark, sf):
    from ..operators.overlap import rouge_n

    return rouge_n(FX.chat_pair(spark, sf), ["conv_id", "turn"], "prompt", "response", (1, 2))


# ---------------- 2.9 streaming, 2.10 UDF surface ----------------
STREAM_FILES, STREAM_SLICES = 4, 2  # files per micro-batch; slices of event time


def _stream_dirs(spark, name):
    from ..session import scratch_path
    import uuid

    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    return f"{base}/source", f"{base}/sink", f"{base}/checkpoint"


def _write_source(df, path, order_col, files=8):
    """Land a table as several parquet files in order (the stream's input)."""
    df.repartitionByRange(files, order_col).write.mode("overwrite").parquet(path)


@query("stream_running_best")
def q_stream_running_best(spark, sf):
    from ..streaming import streams as ST

    src, sink, ck = _stream_dirs(spark, "best")
    _write_source(_gated(spark, sf).select(*[f.name for f in ST.LOG_SCHEMA.fields]), src, "step")
    return ST.stream_running_best(spark, src, sink, ck, STREAM_FILES)


@query("stream_reward_window")
def q_stream_reward_window(spark, sf):
    from ..streaming import streams as ST

    src, sink, ck = _stream_dirs(spark, "window")
    ev = FX.read_table(spark, sf, "events", "event_id", "ts", "value")
    ev = ev.select("event_id", T.utc_instant(ev, "ts").alias("ts"), F.col("value").alias("reward"))
    # Land the events a slice of time after the other and run the stream on each
    # (a restart from its checkpoint): files of one slice have no order among them.
    us = F.unix_micros("ts")
    lo, hi = ev.agg(F.min(us), F.max(us)).first()
    width = (hi - lo) // STREAM_SLICES + 1 if lo is not None else 1
    slice_no = F.coalesce(F.floor((us - F.lit(lo or 0)) / F.lit(width)), F.lit(0))
    for k in range(STREAM_SLICES):
        ev.where(slice_no == k).write.mode("append").parquet(src)
        out = ST.stream_reward_window(spark, src, sink, ck)
    return out


@query("stream_hard_reward")
def q_stream_hard_reward(spark, sf):
    from ..streaming import streams as ST

    src, sink, ck = _stream_dirs(spark, "hard")
    # As many files as the table has partitions, in two micro-batches; their order is free.
    FX.response(spark, sf).select(*[f.name for f in ST.RESPONSE_SCHEMA.fields]).write.mode("overwrite").parquet(src)
    per_batch = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2)
    qa = FX.qa(spark, sf)
    gold = qa.select("qa_id", T.gold_first("answer").alias("correct_answer")).where(F.col("correct_answer").isNotNull())
    return ST.stream_hard_reward(spark, src, gold, sink, ck, per_batch)


@query("metric_hook")
def q_metric_hook(spark, sf):
    from ..streaming import streams as ST

    src, sink, ck = _stream_dirs(spark, "hook")
    _write_source(_gated(spark, sf).select(*[f.name for f in ST.LOG_SCHEMA.fields]), src, "step")

    def hook(batch):
        return (
            batch.where(F.col("evaluated"))
            .unpivot(["reward_type", "step"], ["accuracy", "perplexity", "loss"], "metric", "value")
            .where(F.col("value").isNotNull())
            .select(F.concat_ws("/", "reward_type", "metric").alias("tag"), "step", "value")
        )

    return ST.stream_metric_hook(spark, src, sink, ck, hook, STREAM_FILES)


def _any_number_matches(prompt, response, gold):
    """A user evaluator over a batch: 1.0 if any number in the response equals the gold."""
    numbers = response.str.extractall(T.NUMBER_PATTERN)[0].astype("float64")
    off = (numbers - gold.loc[numbers.index.get_level_values(0)].to_numpy()).abs()
    return (off < T.TOLERANCE).groupby(level=0).any().reindex(response.index, fill_value=False).astype("float64")


@query("evaluator_registry")
def q_evaluator_registry(spark, sf):
    from ..functions import registry as REG

    REG.register_python("any_number", _any_number_matches, REG.HARD_FALLBACK)
    j = E.response_gold_join(FX.response(spark, sf), FX.qa(spark, sf))
    j = j.withColumn(
        "evaluator",
        F.when(F.col("model") == "model_0", "hard").when(F.col("model") == "model_1", "hard_cascade").otherwise("any_number"),
    )
    return REG.evaluate(j, "evaluator", "prompt", "response", "correct_answer").select("qa_id", "sample_idx", "evaluator", "reward")


def _sft_batch(pdf):
    import re

    import pandas as pd

    q, a = (pdf[c].str.replace(re.compile(T.STRIP_PATTERN, re.ASCII), "", regex=True) for c in ("question", "answer"))
    head, rest = P.SFT_TEMPLATE.split("{q}")
    middle, tail = rest.split("{a}")
    return pd.DataFrame({"qa_id": pdf["qa_id"], "text": head + q + middle + a + tail})


@query("batched_map")
def q_batched_map(spark, sf):
    from ..functions import registry as REG

    return REG.batched_map(FX.qa(spark, sf), _sft_batch, "qa_id long, text string")


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
