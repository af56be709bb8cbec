"""Oracle SQL (DuckDB) per registered query key; see ``oracle`` for helpers."""

from __future__ import annotations

from .oracle import (  # noqa: I001
    SCORED,
    SCORED_H,
    cascade,
    gold_first,
    gold_last,
    marker,
    right,
    strip,
    with_fixtures,
)

ORACLE: dict[str, str] = {}


def sql(key: str, text: str) -> None:
    ORACLE[key] = text


# ---------------- 2.2 ----------------
sql("normalize_text", with_fixtures(["qa"], f"select qa_id, split, {strip('question')} as question, {strip('answer')} as answer from qa"))

sql("gold_answer", with_fixtures(["qa"], f"""select qa_id, {gold_first('answer')} as gold_first, {gold_last('answer')} as gold_last,
  coalesce({gold_first('answer')}, 0.0) as gold_or_zero from qa"""))

sql("extract_marker", with_fixtures(["response"], f"select qa_id, sample_idx, {marker('response')} as pred_marker from response"))

sql("extract_cascade", with_fixtures(["response"], f"select qa_id, sample_idx, {cascade('response')} as pred_cascade from response"))

sql("hard_reward", with_fixtures(["response"], """select qa_id, sample_idx, model, correct_answer, hard_marker, hard_cascade, hard_exact
from scored_h""", [SCORED, SCORED_H]))

sql("response_gold_join", with_fixtures(["response"], "select qa_id, sample_idx, model, split, correct_answer from scored", [SCORED]))

# ---------------- 2.5 ----------------
sql("eval_accuracy", with_fixtures(["response"], f"""select g.model, g.strategy, coalesce(a.n_eval, 0) as n_eval,
  coalesce(a.n_right, 0) as n_right, coalesce(a.accuracy, 0.0) as accuracy
from (select distinct model, unnest(['marker', 'cascade']) as strategy from scored) g
left join (select model, strategy, count(*) as n_eval,
  cast(sum(case when {right('pred', 'correct_answer')} then 1 else 0 end) as bigint) as n_right,
  sum(case when {right('pred', 'correct_answer')} then 1 else 0 end) / greatest(1, count(*)) as accuracy
from (select model, 'marker' as strategy, pred_marker as pred, correct_answer from scored where split = 'test'
      union all
      select model, 'cascade', pred_cascade, correct_answer from scored where split = 'test') l
group by model, strategy) a on g.model = a.model and g.strategy = a.strategy""", [SCORED]))


# ---------------- shared CTEs ----------------
from .oracle import exact_avg, exact_sum, hard, md5_int, toks, words  # noqa: E402

SAMPLES = (
    "samples",
    f"""select qa_id, prompt, correct_answer, wrong_answer,
  'Let''s think step by step.' || chr(10) || prompt || chr(10) || ans as chosen,
  'Let''s think step by step.' || chr(10) || prompt || chr(10) ||
    (case when instr(ans, g) > 0 then substr(ans, 1, instr(ans, g) - 1) || w || substr(ans, instr(ans, g) + length(g)) else ans end) as rejected,
  'Let''s solve this step by step.' || chr(10) || chr(10) || ans as chosen_variant
from (select *, cast(correct_answer as varchar) as g, cast(wrong_answer as varchar) as w
      from (select qa_id, prompt, ans, correct_answer,
              case when correct_answer + off = correct_answer then correct_answer + 3.0 else correct_answer + off end as wrong_answer
            from (select qa_id, {strip('question')} as prompt, {strip('answer')} as ans, {gold_first(strip('answer'))} as correct_answer,
                    ({md5_int("'3407:' || cast(qa_id as varchar)")} % 20) - 10 as off
                  from qa) a
            where correct_answer is not null) b) c""",
)


def bigram_ctes(prefix: str, source: str, id_cols: str, text_expr: str) -> list[tuple[str, str]]:
    """Token lists and adjacent-token pairs of texts."""
    return [
        (f"{prefix}_t", f"select {id_cols}, {toks(text_expr)} as t from {source}"),
        (f"{prefix}_bg", f"select {id_cols}, unnest(t[1:len(t) - 1]) as prev, unnest(t[2:len(t)]) as tok from {prefix}_t where len(t) > 1"),
    ]


def model_ctes(name: str, source: str, text_col: str) -> list[tuple[str, str]]:
    return bigram_ctes(name, f"(select row_number() over () as rid, {text_col} as txt from {source})", "rid", "txt") + [
        (f"{name}_pairs", f"select prev, tok, count(*) as c_pair from {name}_bg group by prev, tok"),
        (f"{name}_ctx", f"select prev, cast(sum(c_pair) as bigint) as c_ctx from {name}_pairs group by prev"),
        (f"{name}_v", f"select count(distinct tok) as v from (select unnest(t) as tok from {name}_t) x"),
    ]


def score_ctes(name: str, model: str, source: str, id_cols: str, text_expr: str) -> list[tuple[str, str]]:
    ids = ", ".join(f"s.{c.strip()}" for c in id_cols.split(","))
    on = " and ".join(f"s.{c.strip()} = g.{c.strip()}" for c in id_cols.split(","))
    return bigram_ctes(name, source, id_cols, text_expr) + [
        (f"{name}_lp", f"""select g.*, ln((coalesce(p.c_pair, 0)::double + 1.0) / (coalesce(c.c_ctx, 0)::double + 1.0 * ((select v from {model}_v) + 1))) as lp
from {name}_bg g left join {model}_pairs p on g.prev = p.prev and g.tok = p.tok left join {model}_ctx c on g.prev = c.prev"""),
        (name, f"""select {ids}, count(g.lp) as n_pred, round(exp(-avg(g.lp)), 6) as ppl
from {source} s left join {name}_lp g on {on} group by {ids}"""),
    ]


CUR = model_ctes("cur", "qa where split = 'train'", "answer")
BASE = model_ctes("base", "conversations", "text")
RESP_PPL = score_ctes("rppl", "cur", "response", "qa_id, sample_idx", "prompt || ' ' || response")
QA_RESPONSE = "'Question: ' || prompt || chr(10) || 'Answer: ' || response"
QA_SIDE = "'Question: ' || prompt || chr(10) || 'Answer: ' || text"
RESP_PPL_QA = score_ctes("rppl", "cur", "response", "qa_id, sample_idx", QA_RESPONSE)
RESP_PPL_BASE = score_ctes("bppl", "base", "response", "qa_id, sample_idx", QA_RESPONSE)


def clip(x: str) -> str:
    return f"round(case when ({x}) is null then 0.1 else least(1.0, greatest(0.0, {x})) end, 6)"


def reward_log_sql(ppl: str, text: str, right_expr: str) -> str:
    return clip(f"1.0 / (1.0 + ln(1 + {ppl})) + least(0.3, {words(text)} / 100.0::double) + (case when {right_expr} then 0.1 else 0.0 end)")


def reward_linear_sql(ppl: str, text: str, right_expr: str) -> str:
    return clip(f"1.0 / (1.0 + {ppl} / 100.0) + least(0.2, {words(text)} / 50.0::double) + (case when {right_expr} then 0.1 else 0.0 end)")


def reward_rel_sql(base: str, train: str, hard_expr: str) -> str:
    return clip(f"({base} - {train}) / ({base} + 1e-8) + (case when {hard_expr} > 0.5 then 0.1 else 0.0 end)")


REWARDED = (
    "rewarded",
    f"""select h.*, p.ppl, {reward_log_sql('p.ppl', 'h.response', 'h.hard_marker > 0.5')} as reward
from scored_h h join rppl p on h.qa_id = p.qa_id and h.sample_idx = p.sample_idx""",
)

PREF_RAW = (
    "preference_raw",
    """select u.conv_id, u.turn,
  case when u.conv_id % 2 = 0 and c.text is not null then [{'role': 'assistant', 'content': c.text}] end as chosen_messages,
  case when u.conv_id % 2 <> 0 then c.text end as chosen_text,
  case when u.conv_id % 2 = 0 and r.text is not null then [{'role': 'assistant', 'content': r.text}] end as rejected_messages,
  case when u.conv_id % 2 <> 0 then r.text end as rejected_text
from conversations u
  left join conversations c on c.conv_id = u.conv_id and c.turn = u.turn + 1 and c.role = 'assistant'
  left join conversations r on r.conv_id = u.conv_id and r.turn = u.turn + 3 and r.role = 'assistant'
where u.role = 'user'""",
)
PREF_SCAN = (
    "pref",
    """select conv_id, turn, coalesce(chosen_messages[1].content, chosen_text) as chosen,
  coalesce(rejected_messages[1].content, rejected_text) as rejected
from preference_raw
where (chosen_messages is not null or chosen_text is not null) and (rejected_messages is not null or rejected_text is not null)""",
)
CHUNKS = ("chunks", "select *, row_number() over (order by conv_id, turn) - 1 as idx, (row_number() over (order by conv_id, turn) - 1) // 1000 as chunk_id from pref")

GATED = (
    "gated",
    """select m.reward_type, m.step, m.loss,
  (m.step % 200 = 0 or m.step >= x.mx) as evaluated,
  case when (m.step % 200 = 0 or m.step >= x.mx) then m.accuracy else 0.0 end as accuracy,
  case when (m.step % 200 = 0 or m.step >= x.mx) then m.perplexity end as perplexity
from metric_log m join (select reward_type, max(step) as mx from metric_log group by reward_type) x on m.reward_type = x.reward_type""",
)
SUMMARY = (
    "summary",
    """select reward_type, count(*) as n_records, arg_max(accuracy, step) as final_accuracy,
  greatest(0.0, max(accuracy)) as best_accuracy, max(step) as last_step,
  arg_max(accuracy, step) filter (where evaluated) as final_evaluated_accuracy
from gated group by reward_type""",
)


def batches_sql(source: str, id_expr: str, epochs: int, size: int) -> str:
    return f"""select e.epoch, s.*,
  row_number() over (partition by e.epoch order by md5('3407:' || cast(e.epoch as varchar) || ':' || {id_expr}), {id_expr}) - 1 as idx,
  (row_number() over (partition by e.epoch order by md5('3407:' || cast(e.epoch as varchar) || ':' || {id_expr}), {id_expr}) - 1) // {size} as batch_id
from {source} s cross join (select unnest(range({epochs})) as epoch) e"""


# ---------------- 2.1 ----------------
sql("qa_sample", with_fixtures(["qa"], "select qa_id, question, answer from qa where split = 'train' order by md5('3407:' || cast(qa_id as varchar)), qa_id limit 1000"))
sql("preference_scan", with_fixtures([], "select * from pref", [PREF_RAW, PREF_SCAN]))
sql("chunk_assign", with_fixtures([], "select conv_id, turn, idx, chunk_id from chunks", [PREF_RAW, PREF_SCAN, CHUNKS]))
sql("chunk_examples", with_fixtures(["response"], """select h.chunk_id, h.row_in_chunk, h.conv_id, h.turn, h.input, h.output, e.n_epochs
from (select epoch % (select max(chunk_id) + 1 from chunks) as chunk_id, count(*) as n_epochs
      from (select qa_id as epoch, max(hard_marker) as reward from scored_h group by qa_id) r where reward > 0.5 group by 1) e
join (select chunk_id, row_number() over (partition by chunk_id order by idx) as row_in_chunk, conv_id, turn,
        chosen as input, 'This is a good response.' as output from chunks) h on e.chunk_id = h.chunk_id""", [SCORED, SCORED_H, PREF_RAW, PREF_SCAN, CHUNKS]))

PAIRS_HARD = (
    "pairs_hard",
    f"""select qa_id, prompt,
  case when cr <= rr then rejected else chosen end as chosen,
  case when cr <= rr then chosen else rejected end as rejected,
  case when cr <= rr then rr else cr end as chosen_reward,
  case when cr <= rr then cr else rr end as rejected_reward
from (select *, {hard(marker('chosen'), 'correct_answer')} as cr, {hard(marker('rejected'), 'correct_answer')} as rr from samples) s""",
)
sql("preference_export", with_fixtures(["qa"], "select * from pairs_hard", [SAMPLES, PAIRS_HARD]))
sql("batch_assign", with_fixtures(["qa"], "select epoch, qa_id, idx, batch_id from b",
                                  [SAMPLES, ("b", batches_sql("(select qa_id from samples)", "cast(s.qa_id as varchar)", 3, 4))]))

# ---------------- 2.2 ----------------
sql("chosen_text", with_fixtures(["qa"], "select qa_id, prompt, chosen, chosen_variant, correct_answer from samples", [SAMPLES]))
sql("rejected_text", with_fixtures(["qa"], "select qa_id, correct_answer, wrong_answer, rejected, rejected = chosen as unchanged from samples", [SAMPLES]))
sql("chat_messages", with_fixtures(["qa"], """select qa_id, 'user' as prompt_role, prompt as prompt_content, 'assistant' as chosen_role,
  chosen as chosen_content, 'assistant' as rejected_role, rejected as rejected_content from samples""", [SAMPLES]))
sql("chat_template", with_fixtures(["qa"], f"""select qa_id,
  '<bos><start_of_turn>user' || chr(10) || {strip('question')} || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || {strip('answer')} || '<end_of_turn><eos>' as sft_text,
  '<bos><start_of_turn>user' || chr(10) || question || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) as eval_prompt
from qa"""))
sql("chat_template_conv", """select conv_id, count(*) as n_turns,
  '<bos>' || string_agg('<start_of_turn>' || (case when role = 'user' then 'user' else 'model' end) || chr(10) || text || '<end_of_turn>' || chr(10), '' order by turn) || '<eos>' as chat_text
from conversations group by conv_id""")
sql("rl_prompts", with_fixtures(["qa"], "select qa_id, prompt as query, correct_answer from samples", [SAMPLES]))
sql("length_bonus", with_fixtures(["response"], f"""select qa_id, sample_idx, {words('response')} as words,
  least(0.3, {words('response')} / 100.0::double) as bonus_log, least(0.2, {words('response')} / 50.0::double) as bonus_linear from response"""))
sql("completion_filter", r"""select d.doc_id, regexp_matches(d.text, '[.!?]\s*$') as ends_sentence,
  coalesce(cast(l.quality as varchar) = '1', false) as judged_done,
  regexp_matches(d.text, '[.!?]\s*$') and coalesce(cast(l.quality as varchar) = '1', false) as is_complete
from documents d left join labels l on d.doc_id = l.doc_id""")
sql("pad_batches", with_fixtures(["qa"], f"""select epoch, batch_id, qa_id, mq - len(qt) as query_pad, mr - len(rt) as response_pad,
  array_to_string(list_resize(qt, mq, '<pad>'), ' ') as query_padded, array_to_string(list_resize(rt, mr, '<pad>'), ' ') as response_padded
from (select *, max(len(qt)) over (partition by epoch, batch_id) as mq, max(len(rt)) over (partition by epoch, batch_id) as mr
      from (select b.epoch, b.batch_id, b.qa_id, {toks('s.prompt')} as qt, {toks('s.chosen')} as rt
            from b join samples s on b.qa_id = s.qa_id) x) y""",
    [SAMPLES, ("b", batches_sql("(select qa_id from samples)", "cast(s.qa_id as varchar)", 1, 4))]))
sql("truncate_tokens", f"""select doc_id, len(t) as n_tokens, len(t[1:2048]) as n_kept, array_to_string(t[1:2048], ' ') as kept_text
from (select doc_id, {toks('text')} as t from documents) d""")

# ---------------- 2.3 ----------------
sql("perplexity_logged", with_fixtures(["token_logprob"], """select sample_id, count(*) as n_pred,
  round(exp(-avg(logp_train)), 6) as ppl_train, round(exp(-avg(logp_base)), 6) as ppl_base
from token_logprob where pos >= 2 group by sample_id"""))
sql("ngram_train", with_fixtures(["qa"], """select p.prev, p.tok, p.c_pair, c.c_ctx, (select v from cur_v) as vocab
from cur_pairs p join cur_ctx c on p.prev = c.prev""", CUR))
sql("ngram_perplexity", with_fixtures(["response"], "select * from rppl", CUR + RESP_PPL))
sql("reward_log", with_fixtures(["response"], "select qa_id, sample_idx, ppl, reward as reward_log from rewarded",
                                [SCORED, SCORED_H] + CUR + RESP_PPL + [REWARDED]))
sql("reward_linear", with_fixtures(["response"], f"""select h.qa_id, h.sample_idx, p.ppl,
  {reward_linear_sql('p.ppl', 'h.response', 'h.hard_cascade > 0.5')} as reward_linear
from scored_h h join rppl p on h.qa_id = p.qa_id and h.sample_idx = p.sample_idx""", [SCORED, SCORED_H] + CUR + RESP_PPL))
sql("baseline_join", with_fixtures(["response"], """select b.qa_id, b.sample_idx, b.ppl as base_ppl, c.ppl as train_ppl
from bppl b join rppl c on b.qa_id = c.qa_id and b.sample_idx = c.sample_idx""", CUR + BASE + RESP_PPL_QA + RESP_PPL_BASE))
sql("reward_relative", with_fixtures(["response"], f"""select b.qa_id, b.sample_idx, b.ppl as base_ppl, c.ppl as train_ppl,
  {reward_rel_sql('b.ppl', 'c.ppl', 'h.hard_marker')} as reward_relative
from bppl b join rppl c on b.qa_id = c.qa_id and b.sample_idx = c.sample_idx
  join scored_h h on h.qa_id = b.qa_id and h.sample_idx = b.sample_idx""", [SCORED, SCORED_H] + CUR + BASE + RESP_PPL_QA + RESP_PPL_BASE))
sql("reward_vs_gold", with_fixtures(["response"], """select r.qa_id, r.sample_idx, r.ppl as resp_ppl, g.ppl as gold_ppl,
  round((g.ppl - r.ppl) / (g.ppl + 1e-8), 6) as reward_vs_gold
from rppl r join gppl g on r.qa_id = g.qa_id""", CUR + RESP_PPL + score_ctes("gppl", "cur", "qa", "qa_id", "question || ' ' || answer")))

# ---------------- 2.6 ----------------
sql("pairs_ranked", with_fixtures(["qa"], "select * from pairs_hard", [SAMPLES, PAIRS_HARD]))
SIDE_TEXTS = ("sides", "select qa_id, 'c' as side, prompt, correct_answer, chosen as text from samples union all select qa_id, 'r', prompt, correct_answer, rejected from samples")
SIDE_PPL = score_ctes("sppl", "cur", "sides", "qa_id, side", "prompt || ' ' || text")
SIDE_PPL_QA = score_ctes("sppl", "cur", "sides", "qa_id, side", QA_SIDE)
SIDE_PPL_BASE = score_ctes("sbppl", "base", "sides", "qa_id, side", QA_SIDE)
sql("pairs_ranked_ppl", with_fixtures(["qa"], f"""select qa_id, prompt,
  case when cr <= rr then rejected else chosen end as chosen, case when cr <= rr then chosen else rejected end as rejected,
  case when cr <= rr then rr else cr end as chosen_reward, case when cr <= rr then cr else rr end as rejected_reward
from (select s.*, c.reward as cr, r.reward as rr from samples s
      join sr c on c.qa_id = s.qa_id and c.side = 'c' join sr r on r.qa_id = s.qa_id and r.side = 'r') x""",
    [SAMPLES, SIDE_TEXTS] + CUR + SIDE_PPL + [("sr", f"""select t.qa_id, t.side,
  {reward_log_sql('p.ppl', 't.text', right(marker('t.text'), 't.correct_answer'))} as reward
from sides t join sppl p on t.qa_id = p.qa_id and t.side = p.side""")]))
sql("pairs_fixed", with_fixtures(["qa"], "select qa_id, prompt, chosen, rejected, 1.0::double as chosen_reward, 0.0::double as rejected_reward from samples", [SAMPLES]))
sql("pairs_fixed_ppl", with_fixtures(["qa"], """select s.qa_id, s.prompt, s.chosen, s.rejected, c.reward as chosen_reward, r.reward as rejected_reward
from samples s join sr c on c.qa_id = s.qa_id and c.side = 'c' join sr r on r.qa_id = s.qa_id and r.side = 'r'""",
    [SAMPLES, SIDE_TEXTS] + CUR + BASE + SIDE_PPL_QA + SIDE_PPL_BASE + [("sr", f"""select t.qa_id, t.side,
  {reward_rel_sql('b.ppl', 'p.ppl', hard(marker('t.text'), 't.correct_answer'))} as reward
from sides t join sppl p on t.qa_id = p.qa_id and t.side = p.side join sbppl b on t.qa_id = b.qa_id and t.side = b.side""")]))
sql("shortest_correct", with_fixtures(["response"], """select qa_id, sample_idx, length from (
  select qa_id, sample_idx, length(response) as length,
    row_number() over (partition by qa_id order by length(response), sample_idx) as rn
  from scored_h where hard_marker > 0.5) x where rn = 1""", [SCORED, SCORED_H]))
sql("pairs_by_length", with_fixtures(["response"], """select s.qa_id, s.sample_idx as chosen_idx, g.sample_idx as rejected_idx, s.l as chosen_len, g.l as rejected_len
from (select qa_id, sample_idx, length(response) as l, count(*) over (partition by qa_id) as n,
        row_number() over (partition by qa_id order by length(response), sample_idx) as rn from scored_h where hard_marker > 0.5) s
join (select qa_id, sample_idx, length(response) as l,
        row_number() over (partition by qa_id order by length(response) desc, sample_idx) as rn from scored_h where hard_marker > 0.5) g
  on s.qa_id = g.qa_id and s.rn = 1 and g.rn = 1
where s.n >= 2 and s.l <> g.l""", [SCORED, SCORED_H]))
sql("group_advantage", with_fixtures(["response"], """select h.qa_id, h.sample_idx, h.hard_marker as reward,
  round(case when g.sd = 0 then 0.0 else (h.hard_marker - g.mean) / (g.sd + 1e-8) end, 9) as advantage
from scored_h h join (select qa_id, avg(hard_marker) as mean, stddev_pop(hard_marker) as sd
  from scored_h group by qa_id) g on h.qa_id = g.qa_id""", [SCORED, SCORED_H]))
BEST_WORST = (
    "bw",
    """select b.qa_id, b.sample_idx as chosen_idx, w.sample_idx as rejected_idx, b.reward as chosen_reward, w.reward as rejected_reward
from (select qa_id, sample_idx, reward, row_number() over (partition by qa_id order by reward desc, sample_idx) as rn from rewarded) b
join (select qa_id, sample_idx, reward, row_number() over (partition by qa_id order by reward, sample_idx) as rn from rewarded) w
  on b.qa_id = w.qa_id and b.rn = 1 and w.rn = 1
where b.reward <> w.reward""",
)
sql("pairs_best_worst", with_fixtures(["response"], "select * from bw", [SCORED, SCORED_H] + CUR + RESP_PPL + [REWARDED, BEST_WORST]))
sql("reward_gap", with_fixtures(["response"], f"""select qa_id, chosen_reward - rejected_reward as gap,
  case when (select {exact_avg('chosen_reward - rejected_reward')} from bw) <> 0
       then (chosen_reward - rejected_reward) / (select {exact_avg('chosen_reward - rejected_reward')} from bw) end as weight
from bw""", [SCORED, SCORED_H] + CUR + RESP_PPL + [REWARDED, BEST_WORST]))
sql("difficulty_balance", with_fixtures(["response"], """select qa_id, difficulty, bucket, (select count(distinct bucket) from d) as n_buckets from (
  select *, row_number() over (partition by bucket order by md5('3407:' || cast(qa_id as varchar)), qa_id) - 1 as i from d) x
where i < (select min(n) from (select bucket, count(*) as n from d group by bucket) c)""",
    [SCORED, SCORED_H, ("d", """select qa_id, difficulty,
  case when difficulty < 0.3333333333333333 then 'hard' when difficulty < 0.6666666666666666 then 'moderate' else 'easy' end as bucket
from (select qa_id, avg(case when hard_marker > 0.5 then 1.0 else 0.0 end) as difficulty from scored_h group by qa_id) a""")]))
sql("preference_loss_audit", with_fixtures(["token_logprob"], """select c.pair_id, margin,
  round(greatest(-0.1 * margin, 0.0) + ln(1.0 + exp(-abs(0.1 * margin))), 6) as dpo_loss,
  round(greatest(-lo, 0.0) + ln(1.0 + exp(-abs(lo))), 6) as or_loss
from (select *, (c.logp - c.logp_ref) as cm from seq c where side = 'chosen') c
join (select * from seq where side = 'rejected') r on c.pair_id = r.pair_id,
lateral (select (c.logp - c.logp_ref) - (r.logp - r.logp_ref) as margin,
  (c.mean_logp - ln(1.0 - exp(c.mean_logp))) - (r.mean_logp - ln(1.0 - exp(r.mean_logp))) as lo) m""",
    [("seq", """select sample_id // 2 as pair_id, case when sample_id % 2 = 0 then 'chosen' else 'rejected' end as side,
  sum(logp_train) as logp, sum(logp_base) as logp_ref, avg(logp_train) as mean_logp
from token_logprob where pos >= 2 group by sample_id""")]))

# ---------------- 2.5 / 2.7 metric logs ----------------
sql("eval_gate", with_fixtures(["metric_log"], "select reward_type, step, evaluated, loss, accuracy, perplexity from gated", [GATED]))
sql("running_best", with_fixtures(["metric_log"], """select reward_type, step, accuracy, best_before, greatest(best_before, accuracy) as best_after,
  accuracy > best_before as new_best
from (select *, greatest(0.0, coalesce(max(accuracy) over (partition by reward_type order by step rows between unbounded preceding and 1 preceding), 0.0)) as best_before
      from gated) x""", [GATED]))
sql("run_summary", with_fixtures(["metric_log"], "select * from summary", [GATED, SUMMARY]))
WINNER = (
    "winner",
    """select fh as final_accuracy_hard, fp as final_accuracy_perplexity, bh as best_accuracy_hard, bp as best_accuracy_perplexity,
  case when fp > fh then 'perplexity' else 'hard' end as winner_final,
  case when bp > bh then 'perplexity' else 'hard' end as winner_best,
  abs(fp - fh) * 100 as improvement,
  'Use ' || (case when bp > bh then 'perplexity-based' else 'hard' end) || ' reward: achieved best accuracy of ' || printf('%.3f', greatest(bh, bp)) || '. ' ||
    (case when bp > bh then 'Perplexity rewards show smoother optimization.' else 'Hard rewards converge faster to verifiable answers.' end) as recommendation
from (select coalesce(max(case when reward_type = 'hard' then final_accuracy end), 0.0) as fh,
             coalesce(max(case when reward_type = 'perplexity' then final_accuracy end), 0.0) as fp,
             coalesce(max(case when reward_type = 'hard' then best_accuracy end), 0.0) as bh,
             coalesce(max(case when reward_type = 'perplexity' then best_accuracy end), 0.0) as bp from summary) s""",
)
sql("winner_pair", with_fixtures(["metric_log"], "select * from winner", [GATED, SUMMARY, WINNER]))
sql("winner_three", with_fixtures(["response"], f"""select strategy, model as winner, accuracy from (
  select *, row_number() over (partition by strategy order by accuracy desc, model) as rn from (
    select model, strategy, sum(case when {right('pred', 'correct_answer')} then 1 else 0 end) / greatest(1, count(*)) as accuracy
    from (select model, 'marker' as strategy, pred_marker as pred, correct_answer from scored where split = 'test'
          union all select model, 'cascade', pred_cascade, correct_answer from scored where split = 'test') l
    group by model, strategy) a) b where rn = 1""", [SCORED]))
sql("batch_mean_reward", with_fixtures(["response"], f"""select epoch, batch_id, count(*) as n, {exact_avg('hard_marker')} as mean_reward
from b group by epoch, batch_id""",
    [SCORED, SCORED_H, ("b", batches_sql("scored_h", "(cast(s.qa_id as varchar) || ':' || cast(s.sample_idx as varchar))", 3, 4))]))
sql("hist_density", with_fixtures(["metric_log"], """select st.reward_type, st.metric, g.bin, st.lo + g.bin * st.width as bin_lo,
  coalesce(c.cnt, 0) as count, coalesce(c.cnt, 0) / (st.n * st.width) as density
from st cross join (select unnest(range(10)) as bin) g
left join (select v.reward_type, v.metric, least(9, cast(floor((v.value - st.lo) / st.width) as integer)) as bin, count(*) as cnt
           from vals v join st on v.reward_type = st.reward_type and v.metric = st.metric group by all) c
  on c.reward_type = st.reward_type and c.metric = st.metric and c.bin = g.bin""",
    [GATED, ("vals", """select reward_type, 'accuracy' as metric, accuracy as value from gated
  union all select reward_type, 'perplexity', perplexity from gated where perplexity is not null and perplexity <> 0"""),
     ("st", """select reward_type, metric, n, lo, hi, (hi - lo) / 10.0 as width from (
  select reward_type, metric, count(value) as n,
    case when min(value) = max(value) then min(value) - 0.5 else min(value) end as lo,
    case when min(value) = max(value) then max(value) + 0.5 else max(value) end as hi
  from vals group by reward_type, metric) a""")]))
sql("series_by_step", with_fixtures(["metric_log"], """select step,
  max(case when reward_type = 'hard' then accuracy end) as acc_hard, max(case when reward_type = 'hard' then loss end) as loss_hard,
  max(case when reward_type = 'hard' then perplexity end) as ppl_hard,
  max(case when reward_type = 'perplexity' then accuracy end) as acc_perplexity, max(case when reward_type = 'perplexity' then loss end) as loss_perplexity,
  max(case when reward_type = 'perplexity' then perplexity end) as ppl_perplexity
from gated where step > 0 group by step""", [GATED]))
sql("metrics_union", with_fixtures(["metric_log"], """select reward_type, step, loss, accuracy, perplexity from gated where reward_type = 'hard'
union all select reward_type, step, loss, accuracy, perplexity from gated where reward_type = 'perplexity'""", [GATED]))
sql("first_n_per_group", with_fixtures(["response"], """select model, qa_id, sample_idx, rn from (
  select model, qa_id, sample_idx, row_number() over (partition by model order by qa_id, sample_idx) as rn from response) x where rn <= 20"""))
sql("report_json", with_fixtures(["metric_log"], """select g.reward_type, g.step, g.loss, g.accuracy, g.perplexity, s.final_accuracy, s.best_accuracy
from gated g join summary s on g.reward_type = s.reward_type""", [GATED, SUMMARY]))
sql("scalar_log", with_fixtures(["metric_log"], """select reward_type || '/accuracy' as tag, step, accuracy as value from gated where evaluated
union all select reward_type || '/perplexity', step, perplexity from gated where evaluated and perplexity is not null
union all select reward_type || '/loss', step, loss from gated where evaluated""", [GATED]))


# ---------------- 2.8 tree ----------------

import math  # noqa: E402

# --- Fixed values that must equal the reference's: factors for a right and a wrong
# bit after a positive reward, then for a wrong and a right bit after any other; the floor ---
LN = {"pos_right": math.log(1.1), "pos_wrong": math.log(0.95), "neg_wrong": math.log(0.8), "neg_right": math.log(0.98)}
LN_FLOOR = math.log(0.1)
# --- end of fixed values ---


def dbl(x: float) -> str:
    return f"{x!r}::double"


def round_sig(x: str, digits: int = 10) -> str:
    from ..functions.mathx import POW10_MAX, POW10_MIN, pow10_literals

    table = "(cast([" + ", ".join(f"1e{k}" for k in range(POW10_MIN, POW10_MAX + 1)) + "] as double[]))"
    assert len(pow10_literals()) == POW10_MAX - POW10_MIN + 1
    scale = f"{table}[cast(greatest(least(floor(log10(abs({x}))), {POW10_MAX}), {POW10_MIN}) as integer) - ({POW10_MIN}) + 1]"
    return f"(case when {x} = 0 or {x} is null or isnan({x}) then {x} else round({x} / {scale}, {digits - 1}) * {scale} end)"


PATHS = [
    ("p0", """select node_id, 0 as depth, [node_id] as path, token as context, '' as binary_code, token as query from tree_node where parent_id is null
  union all
  select t.node_id, p0.depth + 1, list_append(p0.path, t.node_id), p0.context || ' ' || t.token, p0.binary_code || t.bit, p0.query
  from tree_node t join p0 on t.parent_id = p0.node_id"""),
    ("paths", "select node_id, depth, context, binary_code, unnest(path) as ancestor_id, generate_subscripts(path, 1) - 1 as ancestor_depth from p0"),
    ("ninfo", "select node_id, depth, context, binary_code, query, path[1] as root_id from p0"),
]
FOREST = [("tree_node", "select * from forest_node")]
STATS = [
    ("per_leaf", "select leaf_id as node_id, count(*) as n, sum(cast(reward as decimal(38,12))) as s from rollout group by leaf_id"),
    ("up", "select a.ancestor_id as node_id, sum(l.n) as visits, sum(l.s) as s from per_leaf l join paths a on l.node_id = a.node_id group by a.ancestor_id"),
    ("stats", """select t.node_id, cast(coalesce(up.visits, 0) as bigint) as visits, coalesce(cast(up.s as double), 0.0) as total_reward,
  case when coalesce(up.visits, 0) > 0 then coalesce(cast(up.s as double), 0.0) / up.visits else 0.0 end as avg_reward
from tree_node t left join up on t.node_id = up.node_id"""),
    ("pj", """select c.node_id, c.parent_id, s.visits, s.avg_reward, p.visits as parent_visits
from tree_node c join stats s on c.node_id = s.node_id join stats p on p.node_id = c.parent_id"""),
]
_K = list(LN)
_ST = "(" * len(_K) + "0.0::double" + "".join(f" + c{i} * {dbl(LN[k])})" for i, k in enumerate(_K))
_TOT = "(" * len(_K) + "0.0::double" + "".join(f" + t{i} * {dbl(LN[k])})" for i, k in enumerate(_K))
WEIGHTS = [
    ("onpath", """select a.ancestor_id as nid, r.iter, r.reward, t.bit from rollout r join paths a on r.leaf_id = a.node_id
  join tree_node t on t.node_id = a.ancestor_id where a.ancestor_depth > 0"""),
    ("kinds", """select nid, iter, cast(reward > 0 and bit = '1' as integer) as k0, cast(reward > 0 and bit <> '1' as integer) as k1,
  cast(not (reward > 0) and bit <> '1' as integer) as k2, cast(not (reward > 0) and bit = '1' as integer) as k3 from onpath"""),
    ("cum", """select nid, k0, k1, k2, k3,
  sum(k0) over w as c0, sum(k1) over w as c1, sum(k2) over w as c2, sum(k3) over w as c3
from kinds window w as (partition by nid order by iter rows between unbounded preceding and current row)"""),
    ("wagg", f"""select nid, max({dbl(LN_FLOOR)} - {_ST}) as m, sum(k0) as t0, sum(k1) as t1, sum(k2) as t2, sum(k3) as t3 from cum group by nid"""),
    ("weights", f"""select t.node_id, coalesce({round_sig(f"exp({_TOT} + greatest(0.0, w.m))")}, 1.0) as weight
from tree_node t left join wagg w on t.node_id = w.nid"""),
]
UCB = ("ucb", f"""select pj.*, w.weight,
  case when pj.visits = 0 then 'inf'::double
       else {round_sig("((pj.avg_reward + 1.414::double * sqrt(ln(pj.parent_visits) / pj.visits)) * w.weight)")} end as ucb
from pj join weights w on pj.node_id = w.node_id""")


def cosine_ctes(name: str, source: str, keys: list[str], a: str, b: str) -> list[tuple[str, str]]:
    k = ", ".join(keys)
    on = lambda x, y: " and ".join(f"{x}.{c} = {y}.{c}" for c in keys)
    return [
        (f"{name}_a", f"select {k}, tok, count(*) as c1 from (select {k}, unnest({toks(a)}) as tok from {source}) x group by all"),
        (f"{name}_b", f"select {k}, tok, count(*) as c2 from (select {k}, unnest({toks(b)}) as tok from {source}) x group by all"),
        (f"{name}_dot", f"select {', '.join('a.' + c for c in keys)}, sum(a.c1 * b.c2) as dot from {name}_a a join {name}_b b on {on('a', 'b')} and a.tok = b.tok group by all"),
        (f"{name}_n1", f"select {k}, sum(c1 * c1) as n1 from {name}_a group by all"),
        (f"{name}_n2", f"select {k}, sum(c2 * c2) as n2 from {name}_b group by all"),
        (name, f"""select {', '.join('s.' + c for c in keys)},
  case when n1.n1 is null or n2.n2 is null then 0.0 else coalesce(d.dot, 0) / (sqrt(n1.n1) * sqrt(n2.n2)) end as cosine
from {source} s left join {name}_n1 n1 on {on('s', 'n1')} left join {name}_n2 n2 on {on('s', 'n2')} left join {name}_dot d on {on('s', 'd')}"""),
    ]


COMBINED = cosine_ctes("ncos", "(select c.node_id, c.token, p.token as primary_token from tree_node c join tree_node p on c.parent_id = p.node_id)",
                       ["node_id"], "primary_token", "token") + [
    ("combined", """select u.node_id, u.parent_id, u.ucb, c.cosine,
  case when u.ucb = 'inf'::double then 'inf'::double else u.ucb + c.cosine * u.weight end as combined
from ucb u join ncos c on u.node_id = c.node_id"""),
]
TREE_ALL = PATHS + STATS + WEIGHTS + [UCB]

sql("node_paths", with_fixtures(["tree_node"], "select node_id, ancestor_id, ancestor_depth, depth from paths", PATHS, recursive=True))
sql("expand_nodes", with_fixtures(["tree_node"], """select g.parent_id, g.token, g.place, g.winner_seq, t.bit, t.model,
  i.context || ' ' || g.token as context, i.binary_code || t.bit as binary_code
from (select parent_id, token, max(case when first = 1 then node_id end) as place, max(case when last = 1 then node_id end) as winner_seq
      from (select *, row_number() over (partition by parent_id, token order by model, dir_rank, node_id) as first,
              row_number() over (partition by parent_id, token order by model desc, dir_rank desc, node_id desc) as last
            from (select *, case when bit = '1' then 0 else 1 end as dir_rank from tree_node where parent_id is not null) a) b
      group by parent_id, token) g
join tree_node t on t.node_id = g.winner_seq join ninfo i on i.node_id = g.parent_id""", PATHS, recursive=True))
sql("candidate_union", with_fixtures(["tree_node"], """select parent_id, model, bit, token, node_id, 0 as dir_rank from tree_node where parent_id is not null and bit = '1'
union all select parent_id, model, bit, token, node_id, 1 from tree_node where parent_id is not null and bit = '0'"""))
sql("token_set", with_fixtures(["tree_node"], """select distinct parent_id, case when bit = '1' then 'right' else 'wrong' end as direction, model, token
from tree_node where parent_id is not null"""))
PROMPT_FILL = """select r.parent_id, r.model, r.bit,
  replace(replace('Question: [Insert your query here]' || chr(10) || 'So far: [Insert your context here]' || chr(10) || 'Next token:',
                  '[Insert your query here]', i.query), '[Insert your context here]', i.context)
  || case when len(r.taken) > 0 then 'You must also ensure that the generated token is not from this array: ['
       || array_to_string(list_transform(r.taken, lambda t: '''' || t || ''''), ', ') || ']' else '' end as prompt_text
from (select parent_id, model, bit, list_sort(array_agg(distinct token)) as taken from tree_node where parent_id is not null group by all) r
join ninfo i on i.node_id = r.parent_id"""
sql("prompt_fill", with_fixtures(["tree_node"], PROMPT_FILL, PATHS, recursive=True))
sql("prompt_fill_forest", with_fixtures(["forest_node"], PROMPT_FILL, FOREST + PATHS, recursive=True))
sql("backup_rewards", with_fixtures(["tree_node", "rollout"], "select node_id, visits, total_reward, avg_reward from stats", PATHS + STATS, recursive=True))
sql("parent_join", with_fixtures(["tree_node", "rollout"], "select node_id, parent_id, visits, parent_visits from pj", PATHS + STATS, recursive=True))
sql("node_weights", with_fixtures(["tree_node", "rollout"], "select node_id, weight from weights", PATHS + WEIGHTS, recursive=True))
sql("ucb_score", with_fixtures(["tree_node", "rollout"], "select node_id, parent_id, visits, ucb from ucb", TREE_ALL, recursive=True))
sql("combined_score", with_fixtures(["tree_node", "rollout"], "select * from combined", TREE_ALL + COMBINED, recursive=True))
sql("top_child", with_fixtures(["tree_node", "rollout"], """select parent_id, node_id, combined from (
  select *, row_number() over (partition by parent_id order by combined desc, node_id) as rn from combined) x where rn = 1""",
    TREE_ALL + COMBINED, recursive=True))
BEST_PATH = """select i.node_id, i.depth, t.token, i.context as answer from ninfo i join tree_node t on i.node_id = t.node_id
join (select a.node_id from paths a left join best b on a.ancestor_id = b.node_id where a.ancestor_depth > 0
      group by a.node_id having bool_and(coalesce(b.is_best, false))) o on o.node_id = i.node_id"""
BEST = ("best", """select node_id, true as is_best from (
  select c.node_id, row_number() over (partition by c.parent_id order by s.visits desc, c.node_id) as rn
  from tree_node c join stats s on c.node_id = s.node_id where c.parent_id is not null) x where rn = 1""")
sql("best_path", with_fixtures(["tree_node", "rollout"], BEST_PATH, PATHS + STATS + [BEST], recursive=True))
sql("best_path_forest", with_fixtures(["forest_node", "rollout"], BEST_PATH, FOREST + PATHS + STATS + [BEST], recursive=True))
_ONES = "(length(i.binary_code) - length(replace(i.binary_code, '1', '')))"
PATH_REWARD = f"""select node_id, path_len, direction_reward, ppl_reward, terminal_reward,
  round(ppl_reward + (-0.1)::double * path_len + direction_reward + terminal_reward, 6) as path_reward
from (select i.node_id, i.depth + 1 as path_len,
    {_ONES} * 1.0::double + (length(i.binary_code) - {_ONES}) * (-0.5)::double as direction_reward,
    coalesce(round((g.ppl - p.ppl) / (g.ppl + 1e-8), 6), 0.0) as ppl_reward,
    case when j.p_size > 40 then {hard(marker('i.context'), 'cast(r.p_size as double)')} else 0.0::double end as terminal_reward
  from ninfo i left join nppl p on i.node_id = p.node_id left join gppl g on i.root_id = g.node_id
  join part r on r.p_partkey = i.root_id join part j on j.p_partkey = i.node_id) x"""
PATH_SCORES = [
    ("ntext", "select node_id, query || ' ' || context as scored from ninfo"),
    ("gtext", "select t.node_id, t.token || ' #### ' || cast(p.p_size as bigint) as scored from tree_node t join part p on p.p_partkey = t.node_id where t.parent_id is null"),
] + model_ctes("tctx", "tree_node", "token") + score_ctes("nppl", "tctx", "ntext", "node_id", "scored") + score_ctes("gppl", "tctx", "gtext", "node_id", "scored")
sql("path_reward", with_fixtures(["tree_node"], PATH_REWARD, PATHS + PATH_SCORES, recursive=True))
sql("path_reward_forest", with_fixtures(["forest_node"], PATH_REWARD, FOREST + PATHS + PATH_SCORES, recursive=True))
sql("seeded_pick", with_fixtures(["tree_node"], """select parent_id, node_id from (
  select parent_id, node_id, row_number() over (partition by parent_id order by md5('3407:' || cast(parent_id as varchar) || ':' || cast(node_id as varchar))) as rn
  from tree_node where parent_id is not null) x where rn = 1"""))
sql("teacher_weights", with_fixtures(["tree_node", "rollout"], """select model, n_uses, round(score, 6) as score,
  round(0.95::double * exp(score) / (select sum(exp(score)) from sc) + 0.05::double / (select count(*) from teachers), 6) as p
from sc""", [
    ("teachers", "select distinct model from tree_node"),
    ("uses", """select t.model, r.iter, r.reward, row_number() over (partition by t.model order by r.iter) - 1 as i,
  count(*) over (partition by t.model) as n from rollout r join tree_node t on r.leaf_id = t.node_id"""),
    ("acc", "select model, sum(pow(0.9::double, n - 1 - i) * reward) as acc, min(n) as n from uses group by model"),
    ("sc", """select t.model, coalesce(a.n, 0) as n_uses,
  round(pow(0.9::double, coalesce(a.n, 0)) / (select count(*) from teachers) + 0.1::double * coalesce(a.acc, 0.0), 12) as score
from teachers t left join acc a on t.model = a.model"""),
]))

# ---------------- 2.4 text-pair joins ----------------
sql("token_cosine", with_fixtures(["chat_pair"], "select conv_id, turn, cosine from tc",
                                  cosine_ctes("tc", "chat_pair", ["conv_id", "turn"], "prompt", "response")))
sql("reward_shift", f"""select d.doc_id, least(0.3, {words('d.text')} / 100.0::double) as reward, j.shift,
  least(0.3, {words('d.text')} / 100.0::double) + coalesce(j.shift, 0) as shifted_reward
from documents d left join (select doc_id, quality - toxic as shift from labels) j on d.doc_id = j.doc_id""")


def gram_rows(side: str, col: str) -> str:
    return f"""select conv_id, turn, 1 as n, g from (select conv_id, turn, unnest({toks(col)}) as g from chat_pair) u
union all
select conv_id, turn, 2, prev || ' ' || tok from {side}_bg"""


sql("rouge_overlap", with_fixtures(["chat_pair"], """select b.conv_id, b.turn, b.n, cast(coalesce(m.match, 0) as bigint) as match,
  case when coalesce(c.tot, 0) > 0 then coalesce(m.match, 0) / c.tot else 0.0 end as precision,
  case when coalesce(r.tot, 0) > 0 then coalesce(m.match, 0) / r.tot else 0.0 end as recall,
  case when (case when coalesce(c.tot, 0) > 0 then coalesce(m.match, 0) / c.tot else 0.0 end)
          + (case when coalesce(r.tot, 0) > 0 then coalesce(m.match, 0) / r.tot else 0.0 end) > 0
       then (2.0::double * (case when coalesce(c.tot, 0) > 0 then coalesce(m.match, 0) / c.tot else 0.0 end)
             * (case when coalesce(r.tot, 0) > 0 then coalesce(m.match, 0) / r.tot else 0.0 end))
            / ((case when coalesce(c.tot, 0) > 0 then coalesce(m.match, 0) / c.tot else 0.0 end)
               + (case when coalesce(r.tot, 0) > 0 then coalesce(m.match, 0) / r.tot else 0.0 end))
       else 0.0 end as f1
from (select conv_id, turn, unnest([1, 2]) as n from chat_pair) b
left join (select r.conv_id, r.turn, r.n, sum(least(r.c, c.c)) as match from rc r join cc c
           on r.conv_id = c.conv_id and r.turn = c.turn and r.n = c.n and r.g = c.g group by all) m
  on b.conv_id = m.conv_id and b.turn = m.turn and b.n = m.n
left join (select conv_id, turn, n, sum(c) as tot from rc group by all) r on b.conv_id = r.conv_id and b.turn = r.turn and b.n = r.n
left join (select conv_id, turn, n, sum(c) as tot from cc group by all) c on b.conv_id = c.conv_id and b.turn = c.turn and b.n = c.n""",
    bigram_ctes("rr", "chat_pair", "conv_id, turn", "prompt") + bigram_ctes("cr", "chat_pair", "conv_id, turn", "response") + [
        ("rg", gram_rows("rr", "prompt")), ("cg", gram_rows("cr", "response")),
        ("rc", "select conv_id, turn, n, g, count(*) as c from rg group by all"),
        ("cc", "select conv_id, turn, n, g, count(*) as c from cg group by all"),
    ]))


# ---------------- 2.9 / 2.10 ----------------
from .oracle import NUMBER_PATTERN  # noqa: E402

sql("stream_running_best", with_fixtures(["metric_log"], """select reward_type, max(step) as latest_step, arg_max(accuracy, step) as latest_accuracy,
  greatest(0.0, max(case when evaluated then accuracy end)) as best_accuracy, count(*) as n_records
from gated group by reward_type""", [GATED]))
sql("stream_reward_window", """select ws as window_start, ws + 3600 as window_end, count(*) as n,
  cast(sum(cast(value as decimal(38,12))) as double) / count(*) as mean_reward,
  (ws + 3600) * 1000000 <= (select epoch_us(max(ts)) from events) - 600 * 1000000 as closed
from (select *, cast(floor(epoch(ts) / 3600) as bigint) * 3600 as ws from events) e
group by ws""")
sql("stream_hard_reward", with_fixtures(["response"], "select qa_id, sample_idx, model, correct_answer, pred_marker, hard_marker from scored_h",
                                        [SCORED, SCORED_H]))
sql("metric_hook", ORACLE["scalar_log"])

# ---------------- options of 2.2-2.8 ----------------
sql("eval_accuracy_ppl", with_fixtures(["response"], f"""select g.model, g.strategy, coalesce(a.n_eval, 0) as n_eval, coalesce(a.n_right, 0) as n_right,
  coalesce(a.accuracy, 0.0) as accuracy, round(coalesce(a.mean_perplexity, 0.0), 6) as mean_perplexity
from (select distinct model, unnest(['marker', 'cascade']) as strategy from scored) g
left join (select model, strategy, count(*) as n_eval, cast(sum({right('pred', 'correct_answer')}::int) as bigint) as n_right,
    avg({right('pred', 'correct_answer')}::int) as accuracy, avg(ppl) as mean_perplexity
  from (select s.model, unnest(['marker', 'cascade']) as strategy, unnest([pred_marker, pred_cascade]) as pred, s.correct_answer, p.ppl
        from scored s join rppl p on s.qa_id = p.qa_id and s.sample_idx = p.sample_idx where s.split = 'test') l
  group by model, strategy) a on g.model = a.model and g.strategy = a.strategy""", [SCORED] + CUR + RESP_PPL))
_WITH_PROMPT = "prompt || ' ' || response"
sql("hard_reward_prompt", with_fixtures(["response"], f"""select qa_id, sample_idx, pm as pred_marker, pc as pred_cascade,
  {hard('pm', 'correct_answer')} as hard_marker, {hard('pc', 'correct_answer')} as hard_cascade
from (select *, {marker(_WITH_PROMPT)} as pm, {cascade(_WITH_PROMPT)} as pc from scored) x""", [SCORED]))
sql("rejected_text_final", with_fixtures(["qa"], """select qa_id, correct_answer, wrong_answer, rejected, rejected = chosen as unchanged
from (select qa_id, correct_answer, wrong_answer, chosen, left(chosen, cut) || regexp_replace(substr(chosen, cut + 1),
        '^(####[ \\s]*)-?\\d+(?:\\.\\d+)?', '\\1' || cast(wrong_answer as varchar)) as rejected
      from (select *, length(chosen) - instr(reverse(chosen), '####') - 3 as cut from samples) a) b""", [SAMPLES]))
sql("reward_relative_plain", with_fixtures(["response"], f"""select b.qa_id, b.sample_idx, b.ppl as base_ppl, c.ppl as train_ppl,
  {clip("(b.ppl - c.ppl) / (b.ppl + 1e-8)")} as reward_relative
from bppl b join rppl c on b.qa_id = c.qa_id and b.sample_idx = c.sample_idx""", CUR + BASE + RESP_PPL_QA + RESP_PPL_BASE))
sql("all_correct", with_fixtures(["response"], "select qa_id, sample_idx, length(response) as length from scored_h where hard_marker > 0.5", [SCORED, SCORED_H]))
sql("report_summary", f"""select 'qa' as dataset, (select count(distinct reward_type) from ({ORACLE['run_summary']}) r) as n_runs, w.winner_final, w.winner_best,
  w.improvement, w.recommendation, w.final_accuracy_hard, w.final_accuracy_perplexity, w.best_accuracy_hard, w.best_accuracy_perplexity
from ({ORACLE['winner_pair']}) w""")
_START = ("starts", """select t.node_id, coalesce(1.0 / k.n, 1.0) as start from tree_node t
left join (select parent_id, count(*)::double as n from tree_node where parent_id is not null group by parent_id) k on t.parent_id = k.parent_id""")
sql("node_weights_uniform", with_fixtures(["tree_node", "rollout"], f"""select s.node_id, coalesce({round_sig(f"exp({_TOT} + greatest(ln(s.start), w.m))")}, {round_sig('s.start')}) as weight
from starts s left join wagg w on s.node_id = w.nid""", PATHS + WEIGHTS + [_START], recursive=True))
sql("evaluator_registry", with_fixtures(["response"], f"""select qa_id, sample_idx,
  case model when 'model_0' then 'hard' when 'model_1' then 'hard_cascade' else 'any_number' end as evaluator,
  case model when 'model_0' then {hard('pred_marker', 'correct_answer')}
             when 'model_1' then {hard('pred_cascade', 'correct_answer')}
             else (case when len(list_filter(regexp_extract_all(response, '{NUMBER_PATTERN}', 1),
                                             lambda x: abs(cast(x as double) - correct_answer) < 1e-4)) > 0 then 1.0::double else 0.0::double end) end as reward
from scored""", [SCORED]))
sql("batched_map", with_fixtures(["qa"], f"""select qa_id,
  '<bos><start_of_turn>user' || chr(10) || {strip('question')} || '<end_of_turn>' || chr(10) || '<start_of_turn>model' || chr(10) || {strip('answer')} || '<end_of_turn><eos>' as text
from qa"""))

sql("preference_loss_summary", f"""select count(*) as n_pairs, {exact_sum('dpo_loss')} / count(dpo_loss) as mean_dpo_loss,
  {exact_sum('or_loss')} / count(or_loss) as mean_or_loss, sum(case when margin > 0 then 1 else 0 end) / count(*) as share_positive_margin
from ({ORACLE['preference_loss_audit']}) a""")
