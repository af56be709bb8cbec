"""DuckDB SQL for every registered query (the correctness oracle).

The fixture views of FIXTURES.md are inlined as CTEs, since the checker
registers only the raw tables. Snippet helpers below write the same
expressions as ``rewardforge.functions.text`` in SQL.
"""

from __future__ import annotations

# --- Fixed values that must equal the reference's, stated here anew so that the
# oracle does not take them from the code it checks ---
GOLD_MARKER_PATTERN = r"####\s*(-?\d+(?:\.\d+)?)"
NUMBER_PATTERN = r"(-?\d+(?:\.\d+)?)"
CASCADE_PATTERNS = (
    r"(?:the answer is|answer:|equals?|=)\s*(-?\d+(?:\.\d+)?)",
    r"(-?\d+(?:\.\d+)?)\s*$",
    r"=\s*(-?\d+(?:\.\d+)?)",
)
# --- end of fixed values ---

FIXTURE_SQL: dict[str, str] = {
    "qa": r"""select l_orderkey as qa_id,
  case when l_orderkey % 5 = 0 then 'test' else 'train' end as split,
  concat('  Order ', cast(l_orderkey as string), ' ships ', cast(q as string), ' units in ', cast(n as string), ' lines. How many units remain after one per line is returned?  ') as question,
  concat('There are ', cast(q as string), ' units.', chr(10), 'So ', cast(q as string), ' - ', cast(n as string), ' = <<', cast(q as string), '-', cast(n as string), '=', cast(q-n as string), '>>', cast(q-n as string), ' remain.',
    case when l_orderkey % 11 = 0 then ''
         when l_orderkey % 7 = 0 then concat(chr(10), 'Half a unit is lost: ', cast(q-n as string), '.5', chr(10), '#### ', cast(q-n as string), '.5')
         when l_orderkey % 13 = 0 then concat(chr(10), '#### 1,', cast(q-n+100 as string))
         when l_orderkey % 17 = 0 then concat(chr(10), '#### -', cast(q-n as string))
         else concat(chr(10), '#### ', cast(q-n as string)) end) as answer
from (select l_orderkey, cast(sum(l_quantity) as bigint) as q, cast(count(*) as bigint) as n from lineitem group by l_orderkey) g""",
    "response": r"""select qa_id, s as sample_idx, concat('model_', cast(s % 3 as string)) as model, question as prompt,
  case (qa_id * 31 + s * 17) % 5
    when 0 then answer
    when 1 then concat('I think the answer is ', cast(qa_id % 97 as string), '.')
    when 2 then 'I cannot tell.'
    when 3 then concat(answer, chr(10), 'Check again.', chr(10), '#### ', cast(s as string))
    else concat('x = 3 so y = 4', chr(10), answer, '  ', chr(10)) end as response
from qa cross join (select 0 as s union all select 1 union all select 2 union all select 3) k""",
    "token_logprob": r"""select user_id as sample_id,
  row_number() over (partition by user_id order by ts, event_id) as pos,
  cast(-(1 + (event_id * 7919 % 128) / 32.0) as double) as logp_train,
  cast(-(1 + (event_id * 104729 % 128) / 32.0) as double) as logp_base
from events""",
    "metric_log": r"""select reward_type, step * 100 as step,
  cast(case when step = mx then value / 100.0 else 0.0 end as double) as loss,
  cast((event_id * 7919 % 21) / 20.0 as double) as accuracy,
  cast(case when event_id % 10 = 0 then null else 2.0 + value / 1000.0 end as double) as perplexity,
  ts
from (select event_id, ts, value, reward_type,
        row_number() over (partition by reward_type order by ts, event_id) as step,
        count(*) over (partition by reward_type) as mx
      from (select *, case when user_id % 2 = 0 then 'hard' else 'perplexity' end as reward_type from events) a) b""",
    "chat_pair": r"""select u.conv_id, u.turn, u.text as prompt, a.text as response
from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'""",
    "judge": r"""select doc_id, quality - toxic as shift from labels""",
    "tree_node": r"""select p_partkey as node_id,
  case when p_partkey = 0 then null else cast(floor((p_partkey - 1) / 6.0) as bigint) end as parent_id,
  p_name as token, case when p_size % 3 = 0 then '0' else '1' end as bit, p_brand as model
from part""",
    "forest_node": r"""select p_partkey as node_id,
  case when p_partkey >= 8 then cast(floor((p_partkey - 8) / 6.0) as bigint) end as parent_id,
  p_name as token, case when p_size % 3 = 0 then '0' else '1' end as bit, p_brand as model
from part""",
    "rollout": r"""select o_orderkey as iter, o_custkey % (select count(*) from part) as leaf_id,
  o_totalprice / 100000.0 - 2.0 as reward
from orders""",
}

_DEPS = {"response": ["qa"]}


def with_fixtures(names: list[str], body: str, extra: list[tuple[str, str]] = (), recursive: bool = False) -> str:
    """``with <fixtures>, <extra ctes> <body>``; fixture dependencies first."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    # a table read more than once is computed once (the recursive one always is)
    ctes = [f"{n} as {'' if n == 'p0' else 'materialized '}(\n{s}\n)" for n, s in [(n, FIXTURE_SQL[n]) for n in order] + list(extra)]
    return ("with recursive " if recursive else "with ") + ",\n".join(ctes) + "\n" + body


# ---- expression snippets (same semantics as functions.text) ----
def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def first_num(x: str, pat: str, ci: bool = False) -> str:
    p = ("(?i)" + pat) if ci else pat
    return f"try_cast(nullif(regexp_extract({x}, '{p}', 1), '') as double)"


def last_num(x: str, pat: str) -> str:
    return f"try_cast(regexp_extract_all({x}, '{pat}', 1)[-1] as double)"


def gold_first(x: str) -> str:
    return first_num(x, GOLD_MARKER_PATTERN)


def gold_last(x: str) -> str:
    return last_num(x, GOLD_MARKER_PATTERN)


def marker(x: str) -> str:
    return f"coalesce({last_num(x, GOLD_MARKER_PATTERN)}, {last_num(x, NUMBER_PATTERN)})"


def cascade(x: str) -> str:
    steps = [first_num(x, p, ci=True) for p in CASCADE_PATTERNS]
    return "coalesce(" + ", ".join(steps + [last_num(x, NUMBER_PATTERN)]) + ")"


def right(pred: str, gold: str) -> str:
    return f"coalesce(abs({pred} - {gold}) < 1e-4, false)"


def hard(pred: str, gold: str) -> str:
    return f"(case when {right(pred, gold)} then 1.0::double else 0.0::double end)"


def words(x: str) -> str:
    return rf"coalesce(len(list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')), 0)"


def toks(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda t: t <> '')"


def exact_sum(x: str) -> str:
    return f"cast(sum(cast({x} as decimal(38,12))) as double)"


def exact_avg(x: str) -> str:
    return f"({exact_sum(x)} / count({x}))"


def md5_int(key: str) -> str:
    return f"cast(('0x' || substr(md5({key}), 1, 8)) as bigint)"


SCORED = (
    "scored",
    f"""select r.qa_id, r.sample_idx, r.model, r.prompt, r.response, g.split, g.correct_answer,
  {marker('r.response')} as pred_marker, {cascade('r.response')} as pred_cascade
from response r join (select qa_id, split, {gold_first('answer')} as correct_answer from qa) g
  on r.qa_id = g.qa_id
where g.correct_answer is not null""",
)

SCORED_H = (
    "scored_h",
    f"""select *, {hard('pred_marker', 'correct_answer')} as hard_marker,
  {hard('pred_cascade', 'correct_answer')} as hard_cascade,
  (case when coalesce(pred_marker = correct_answer, false) then 1.0::double else 0.0::double end) as hard_exact
from scored""",
)


def oracle_sql() -> dict[str, str]:
    from .oracle_queries import ORACLE

    return dict(ORACLE)
