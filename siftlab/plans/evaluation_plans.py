"""Queries over judged rollouts derived from events, labels and conversations."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftlab.functions import answers as A, fixed as K, scoring as S
from siftlab.functions.ids import split_experiment_id
from siftlab.functions.text import let
from siftlab.operators import evaluation as E
from siftlab.operators.ordinals import best_per_group
from siftlab.plans.common import SQL_RUNS, pick, run_rows, sql_list, sql_pick, text
from siftlab.plans.registry import query

_FAIL = " or ".join(f"contains(lower(reasoning), '{m}')" for m in K.OUTPUT_FAILURE_MARKERS)
_WITH = f"with {SQL_RUNS}, judged as (select *, ({_FAIL}) as failed from runs where stage = 'judged')"


def _round(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(
    "src8_run_table_scan",
    f"""with {SQL_RUNS} select id, dataset_index, reward, reasoning from runs
    where exp_id = 'click_epoch_1' and stage = 'judged'""",
)
def src8(t):
    from siftlab.sources.runs import run_scan

    return run_scan(run_rows(t), "click_epoch_1", "judged").select("id", "dataset_index", "reward", "reasoning")


@query(
    "agg12_reward_by_task",
    f"""{_WITH} select t.task_type, count(j.id) as n_rollouts, round(avg(reward), 6) as avg_reward,
      round(1 - avg(reward), 6) as normalized_error, count_if(failed)::bigint as output_failures,
      coalesce(sum(tool_calls), 0)::bigint as tool_calls, round(sum(time_cost), 4) as time_cost
    from (select unnest({sql_list(K.TASKS)}) as task_type) t left join judged j using (task_type) group by 1""",
)
def agg12_by_task(t):
    out = E.reward_by_task(run_rows(t))
    return _round(_round(out, "avg_reward", "normalized_error"), "time_cost", digits=4)


@query(
    "agg12_reward_summary",
    f"""{_WITH}, pt as (select task_type, avg(reward) as m from judged group by 1)
    select count(*) as n_judged, round(avg(reward), 6) as avg_reward, round((select avg(m) from pt), 6) as macro_task_reward,
      round((select min(m) from pt), 6) as min_task_reward, (select count(*) from pt) as tasks_present,
      count_if(failed)::bigint as output_failures, round(count_if(failed) / count(*), 6) as output_failure_rate,
      sum(tool_calls)::bigint as tool_calls, round(sum(time_cost), 3) as time_cost,
      round(1 - avg(reward), 6) as normalized_error from judged""",
)
def agg12_summary(t):
    out = E.reward_summary(run_rows(t))
    out = _round(out, "avg_reward", "macro_task_reward", "min_task_reward", "output_failure_rate", "normalized_error")
    return _round(out, "time_cost", digits=3)


_STATES = f"""{_WITH}, st as (select dataset_index, count(*) as n, avg(reward) as m,
    case when max(abs(reward - 1)) <= TOL then 'all_correct' when max(abs(reward)) <= TOL then 'all_wrong'
      else 'partial_reward' end as state from (select (dataset_index * 1000 + k) as dataset_index, reward from judged) group by 1)
  select count(*) as n_questions, count_if(state = 'all_correct')::bigint as all_correct,
    count_if(state = 'all_wrong')::bigint as all_wrong, count_if(state = 'partial_reward')::bigint as partial_reward,
    round(count_if(state = 'partial_reward') / count(*), 6) as partial_group_rate,
    (coalesce(sum(case when state = 'partial_reward' then n end), 0) + 2 * count_if(state = 'partial_reward'))::bigint
      as estimated_update_calls from st"""


def _fine_questions(t):
    """Smaller groups, so that all three states occur: one question per (user, k)."""
    return run_rows(t).withColumn("dataset_index", F.col("dataset_index") * 1000 + F.col("k"))


@query("agg13_group_outcomes", _STATES.replace("TOL", "1e-12"))
def agg13(t):
    return _round(E.group_outcomes(_fine_questions(t)), "partial_group_rate")


@query("agg13_group_outcomes_exact", _STATES.replace("TOL", "0"))
def agg13_exact(t):
    return _round(E.group_outcomes(_fine_questions(t), tolerance=0.0), "partial_group_rate")


@query(
    "agg14_experiment_summary",
    f"""with {SQL_RUNS} select exp_id, count(*) as n_judged, round(avg(reward), 6) as avg_reward, min(reward) as min_reward,
      max(reward) as max_reward, count_if(reward > 0)::bigint as n_gt0, count_if(reward >= 0.5)::bigint as n_ge_05,
      count_if(reward >= 0.8)::bigint as n_ge_08, count_if(reasoning <> '')::bigint as n_parse_error,
      round(count_if(reasoning <> '') / count(*), 6) as parse_error_rate, round(count_if(reward > 0) / count(*), 6) as pass_rate
    from runs where stage = 'judged' group by exp_id""",
)
def agg14(t):
    return _round(E.experiment_summary(run_rows(t)), "avg_reward", "parse_error_rate", "pass_rate")


@query(
    "agg15_mean_and_pass",
    f"""{_WITH}, q as (select dataset_index, count(*) as n, sum(reward) as s, max(reward) as b, sum(tool_calls) as c
      from judged group by 1) select max(n) as k, round(sum(s) / sum(n), 6) as mean_at_k, round(avg(b), 6) as pass_at_k,
      round(sum(c) / sum(n), 6) as avg_tool_call from q""",
)
def agg15(t):
    return _round(E.mean_and_pass(run_rows(t)), "mean_at_k", "pass_at_k", "avg_tool_call")


_PASS = f"""with {SQL_RUNS}, v as (select LEVEL dataset_index * 1000 + k as q, id, correct,
    row_number() over (partition by LEVEL dataset_index * 1000 + k order by id) as rn from runs where judged_response <> 'invalid'),
  g as (select LEVEL q, count(*) as a, max(correct::int) as s, max(case when rn <= 2 then correct::int else 0 end) as e
    from v group by LEVEL q)
  select LEVEL round_even(sum(e) / count(*) * 100, 2) as pass_at_k, count(*) as total_problems, sum(s)::bigint as solved_problems,
    (count(*) - sum(s))::bigint as unsolved_problems, sum(a)::bigint as total_attempts from g GROUPING"""


@query("agg16_pass_at_k", _PASS.replace("LEVEL", "").replace("GROUPING", ""))
def agg16(t):
    return E.pass_at_k(_fine_questions(t), 2)


@query("agg16_pass_at_k_by_level", _PASS.replace("LEVEL", "level,").replace("GROUPING", "group by level"))
def agg16_level(t):
    return E.pass_at_k(_fine_questions(t), 2, by_level=True)


@query(
    "agg17_accuracy",
    f"""with {SQL_RUNS}, f as (select level, correct, judged_response = 'invalid' as inv from runs)
    select level::varchar as level, count_if(correct and not inv)::bigint as correct,
      count_if(not correct and not inv)::bigint as wrong, count_if(inv)::bigint as unknown, count(*) as total,
      round_even(count_if(correct and not inv) / count_if(not inv) * 100, 4) as accuracy from f group by level
    union all select 'ALL', count_if(correct)::bigint, (count(*) - count_if(correct) - count_if(inv))::bigint,
      count_if(inv)::bigint, count(*), round_even(count_if(correct) / count(*) * 100, 2) from f""",
)
def agg17(t):
    return E.accuracy(run_rows(t))


@query(
    "agg18_calibration_error",
    f"""with {SQL_RUNS}, b as (select case when judged_response <> 'invalid' then least(floor(confidence / 20), 4) end as bin,
      count(*) as n, count_if(correct) as r, sum(confidence) as c from runs group by 1)
    select sum(n)::bigint as total, round(sum(case when bin is not null then n * abs(r / n - c / n / 100) end) / sum(n) * 100, 6)
      as calibration_error from b""",
)
def agg18(t):
    return _round(E.calibration_error(run_rows(t)), "calibration_error")


@query(
    "flt7_learnable_groups",
    f"""{_WITH}, f as (select id, dataset_index * 1000 + k as q, reward from judged),
      m as (select q from f group by q having avg(reward) > 0 and avg(reward) < 1)
    select id, q as dataset_index, reward from f where q in (select q from m)""",
)
def flt7(t):
    return E.learnable_rows(_fine_questions(t)).select("id", "dataset_index", "reward")


_MSG = "with m as (select conv_id, role, turn, case when contains(text, ' de ') then 1 else 0 end as de, case when contains(text, ' the ') then 1 else 0 end as the from conversations)"


def _messages(t):
    tools = F.array_compact(
        F.array(
            F.when(F.col("text").contains(" de "), F.lit("search")),
            F.when(F.col("text").contains(" the "), F.lit("fetch")),
        )
    )
    return t.conversations.select(
        F.col("conv_id").alias("trajectory_id"), "turn", "role", F.col("text").alias("content"), tools.alias("tools")
    )


@query(
    "agg26_tool_usage",
    f"""{_MSG}, p as (select conv_id, count(*) as n, count_if(role = 'assistant') as a, sum(de + the) as c from m group by 1)
    select count(*) as trajectories, sum(n)::bigint as turns, sum(a)::bigint as assistant_turns, sum(c)::bigint as tool_calls,
      round(sum(c) / count(*), 6) as calls_per_trajectory, round(sum(c) / sum(a), 6) as calls_per_assistant_turn from p""",
)
def agg26(t):
    return _round(E.tool_usage(_messages(t)), "calls_per_trajectory", "calls_per_assistant_turn")


@query(
    "agg26_tool_shares",
    f"""{_MSG} select 'search' as tool, sum(de)::bigint as calls, round(sum(de) / sum(de + the), 6) as share from m
    union all select 'fetch', sum(the)::bigint, round(sum(the) / sum(de + the), 6) from m""",
)
def agg26_shares(t):
    return _round(E.tool_shares(_messages(t)), "share")


# Model responses derived from lineitem: truth is the quantity, the response varies by line.
def _responses(t):
    li = t.wide("lineitem")
    q = F.col("l_quantity")
    kind = F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(8))
    value = F.when(F.col("l_linenumber") <= 5, text(q)).otherwise(text(q + 1))
    body = (
        F.when(kind == 0, F.concat(F.lit('{"v": '), value, F.lit("}")))
        .when(kind == 1, F.concat(F.lit('{"v": "'), value, F.lit(' mV"}')))
        .when(kind == 2, F.concat(F.lit('{"v": '), value, F.lit(', "x": 1}')))
        .when(kind == 3, F.lit('{"w": 1}'))
        .when(kind == 4, F.concat(F.lit('{"v": "'), value, F.lit(' furlong"}')))
        .when(kind == 5, F.lit("no idea"))
        .when(kind == 6, F.concat(F.lit('{"v": "'), text(q / 1000), F.lit(' V"}')))
        .otherwise(F.concat(F.lit('{"v": "'), value, F.lit('"}')))
    )
    return li.select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("id"),
        pick(K.TASKS, "l_orderkey").alias("task_type"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("<think>x</think><answer>"), body, F.lit("</answer>")))
        .otherwise(body)
        .alias("response"),
        q.alias("truth"),
        kind.alias("kind"),
        F.col("l_linenumber").alias("line"),
    )


SQL_RESP = f"""resp as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id,
  {sql_pick(K.TASKS, 'l_orderkey')} as task_type, (l_partkey + l_suppkey) % 8 as kind, l_quantity as truth,
  case when l_linenumber <= 5 then l_quantity else l_quantity + 1 end as v from lineitem)"""


@query(
    "nrm25_prediction_coercion",
    f"""with {SQL_RESP} select kind, count(*) as n,
      count(case when kind in (0, 1, 2, 7) then v when kind = 6 then truth end) as n_parsed,
      round(sum(case when kind in (0, 1, 2, 7) then v when kind = 6 then round(truth, 3) end), 3) as total from resp group by kind""",
)
def nrm25(t):
    from siftlab.functions.units import coerce_prediction

    r = _responses(t)
    answer = A.answer_map(A.direct_answer_object("response"))
    parsed = coerce_prediction(F.try_element_at(answer, F.lit("v")), F.lit("mV"))
    out = r.select("kind", F.round(parsed, 3).alias("p"))
    return out.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.count("p").alias("n_parsed"), F.round(F.sum("p"), 3).alias("total")
    )


@query(
    "agg32_reward_scoring",
    f"""with {SQL_RESP}, s as (select task_type, case when kind in (0, 1, 7) then exp(-abs(v - truth) / truth)
        when kind = 6 then 1.0::double else 0.0::double end as reward from resp)
    select task_type, count(*) as n, round(avg(reward), 6) as avg_reward, count_if(reward = 0)::bigint as n_zero,
      count_if(round(reward, 9) = 1)::bigint as n_full from s group by 1""",
)
def agg32(t):
    from siftlab.functions.units import coerce_prediction

    r = _responses(t)
    unit = F.lit("mV")
    raw = A.answer_map(A.direct_answer_object("response"))
    predicted = F.transform_values(
        F.coalesce(raw, F.create_map().cast("map<string,string>")), lambda k, v: coerce_prediction(v, unit)
    )
    truth = F.create_map(F.lit("v"), F.col("truth"))
    units = F.create_map(F.lit("v"), F.lit("mV"))
    reward = S.metric_reward(truth, predicted, units)
    out = r.select("task_type", reward.alias("reward"))
    return out.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("reward"), 6).alias("avg_reward"),
        F.count_if(F.col("reward") == 0).alias("n_zero"),
        F.count_if(F.round("reward", 9) == 1).alias("n_full"),
    )


@query(
    "agg27_compliance_funnel",
    f"""with {SQL_RESP}, s as (select task_type, case kind when 5 then 'pred_answer_missing' when 2 then 'extra_keys'
        when 3 then 'extra_keys' when 4 then 'non_numeric_unrepaired' when 0 then 'strict_numbers_only_ok'
        when 7 then 'repaired_numbers_ok' else 'repaired_numbers_ok' end as stage from resp)
    select task_type, stage, count(*) as n from s group by all union all select 'ALL', stage, count(*) from s group by all""",
)
def agg27(t):
    from siftlab.functions.units import coerce_prediction

    r = _responses(t)

    def judged(obj: Column, got: Column) -> Column:
        keys = A.key_difference(F.create_map(F.lit("v"), F.lit("1")), got)
        # A JSON number keeps its bare spelling in the raw text; a JSON string is quoted there.
        numeric = obj.rlike(r'"v"\s*:\s*[-0-9.]')
        repaired = coerce_prediction(F.try_element_at(got, F.lit("v")), F.lit("mV")).isNotNull()
        return let(
            lambda k: E.compliance_stage(
                F.lit(True), obj.isNotNull(), F.lit(False), F.lit(True), F.lit(True),
                F.size(k["extra"]) > 0, F.size(k["missing"]) > 0, numeric, repaired,
            ),
            keys,
        )

    # The answer is looked for and parsed once per row; every check reads the bound values.
    stage = let(lambda obj: let(lambda got: judged(obj, got), A.answer_map(obj)), A.direct_answer_object("response"))
    return E.funnel(r.select("task_type", stage.alias("stage")), "task_type", "stage")


@query(
    "agg28_run_audit",
    f"""with {SQL_RUNS}, r as (select dataset_index::varchar as sample_id, task_type, reward,
        case when k = 0 then 'other' else 'main' end as dataset, reasoning not like 'Failed%' as parsed, k % 13 <> 0 as trajectory_ok
      from runs where stage = 'judged'),
    s as (select sample_id, count(*) as n, min(task_type) as task_type, count_if(dataset <> 'main') as f,
      count_if(not parsed) as u, count_if(not trajectory_ok) as nt from r group by 1),
    tk as (select task_type, count(*) as q, sum(n) as n from s group by 1)
    select sum(n)::bigint as rollouts, sum(f)::bigint as "foreign", sum(u)::bigint as unparsed, sum(nt)::bigint as no_trajectory,
      0::bigint as bad_reward, count_if(n <> 60)::bigint as wrong_groups,
      (select count_if(q <> 8 or n <> 480) from tk)::bigint as wrong_tasks, (select count(*) from tk) as tasks,
      (select count(*) from (select c_custkey::varchar as s from customer) c full join s on c.s = s.sample_id
        where c.s is null or s.sample_id is null) as id_mismatches,
      'row_count,foreign_dataset,sample_ids,group_size,unparsed_answers,trajectories,task_counts' as failures, 'fail' as status
    from s""",
)
def agg28(t):
    runs = run_rows(t).where("stage = 'judged'").select(
        text("dataset_index").alias("sample_id"),
        "task_type",
        "reward",
        F.when(F.col("k") == 0, "other").otherwise("main").alias("dataset"),
        (~F.col("reasoning").startswith("Failed")).alias("parsed"),
        (F.pmod("k", F.lit(13)) != 0).alias("trajectory_ok"),
    )
    expected = t.customer.select(text("c_custkey").alias("sample_id"))
    return E.run_audit(runs, expected, dataset="main", group_size=60, per_task=8, rows=1)


@query(
    "agg37_match_judging",
    r"""with m as (select o_orderkey % 6 as kind, o_custkey as c, o_orderkey % 3 = 0 as same, o_orderpriority as p from orders)
    select kind, count(*) as n, count_if(case kind when 0 then same when 1 then same when 2 then same when 3 then true
      when 4 then false else same end)::bigint as n_correct from m group by kind""",
)
def agg37(t):
    kind = F.pmod("o_orderkey", F.lit(6))
    same = F.pmod("o_orderkey", F.lit(3)) == 0
    c, p = text("o_custkey"), F.col("o_orderpriority")
    truth = (
        F.when(kind <= 2, c)
        .when(kind == 3, F.concat(c, F.lit(", Ab ; 3")))
        .when(kind == 4, F.concat(c, F.lit(",b")))
        .otherwise(p)
    )
    response = (
        F.when(kind == 0, F.when(same, F.concat(F.lit("$"), c, F.lit(".0"))).otherwise(F.lit("none")))
        .when(kind == 1, F.when(same, F.concat(c, F.lit("%"))).otherwise(F.concat(c, F.lit("1"))))
        .when(kind == 2, F.when(same, c).otherwise(F.lit("")))
        .when(kind == 3, F.concat(c, F.lit(".00;ab, $3")))
        .when(kind == 4, c)
        .otherwise(F.when(same, F.concat(F.lit(" "), F.lower(p), F.lit("!"))).otherwise(F.lit("other")))
    )
    out = t.orders.select(kind.alias("kind"), A.answers_match(response, truth).alias("ok"))
    return out.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct"))


@query(
    "agg38_judge_text",
    r"""select o_orderkey as id, o_orderpriority as answer, 'because of ' || o_orderstatus as reasoning,
      o_orderkey % 2 = 0 as correct, (o_custkey % 101)::int as confidence from orders""",
)
def agg38(t):
    verdict = F.concat(
        F.lit("**extracted_final_answer:** "), F.col("o_orderpriority"), F.lit("\nreasoning: because of "), F.col("o_orderstatus"),
        F.lit("\n\n**correct**: "), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, "yes").otherwise("no"),
        F.lit("\nconfidence: "), text(F.pmod("o_custkey", F.lit(101))), F.lit("%"),
    )
    v = A.judge_verdict(verdict)
    return t.orders.select(F.col("o_orderkey").alias("id"), v["answer"].alias("answer"), v["reasoning"].alias("reasoning"), v["correct"].alias("correct"), v["confidence"].alias("confidence"))


@query(
    "nrm31_experiment_id_split",
    f"""with {SQL_RUNS} select exp_id, regexp_extract(exp_id, '^(.*)_epoch_', 1) as experiment,
      regexp_extract(exp_id, '_epoch_(.*)$', 1)::int as epoch, count(*) as n from runs group by 1""",
)
def nrm31(t):
    s = split_experiment_id("exp_id")
    return run_rows(t).groupBy("exp_id").agg(F.count(F.lit(1)).alias("n")).select(
        "exp_id", s["experiment"].alias("experiment"), s["epoch"].alias("epoch"), "n"
    )


@query(
    "win8_latest_row_per_key",
    """select user_id as experiment, max(event_id) as step, arg_max(event_type, (ts, event_id)) as event_type,
      arg_max(value, (ts, event_id)) as value from events group by 1 having true""".replace(
        "max(event_id) as step", "arg_max(event_id, (ts, event_id)) as step"
    ),
)
def win8(t):
    latest = best_per_group(t.events, "user_id", [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")])
    return latest.select(F.col("user_id").alias("experiment"), F.col("event_id").alias("step"), "event_type", "value")


@query(
    "top10_ordered_listing",
    f"""with {SQL_RUNS} select id, reward, reasoning from runs where exp_id = 'view_epoch_0' and stage = 'judged'
    order by reward desc, id limit 50""",
)
def top10(t):
    from siftlab.sources.runs import ordered_listing

    return ordered_listing(run_rows(t), "view_epoch_0", "judged", order="reward_desc", limit=50).select("id", "reward", "reasoning")


@query(
    "top7_best_configuration",
    f"""with {SQL_RUNS}, j as (select *, reasoning <> '' as f from runs where stage = 'judged'),
    pt as (select exp_id, task_type, avg(reward) as m from j group by all),
    c as (select exp_id, round(avg(m), 9) as macro, count(*) as tasks, min(m) as worst from pt group by 1),
    d as (select exp_id, count_if(f) / count(*) as fail, count(*) as calls from j group by 1)
    select exp_id, round(macro, 6) as macro, tasks, calls from c join d using (exp_id) where tasks = 19
    order by macro desc, worst desc, fail, calls, exp_id limit 1""",
)
def top7(t):
    from siftlab.operators.ranking import best_configuration

    j = run_rows(t).where("stage = 'judged'")
    per_task = j.groupBy("exp_id", "task_type").agg(
        F.avg("reward").alias("m"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("reasoning") != "").alias("f")
    )
    reports = per_task.groupBy("exp_id").agg(
        F.round(F.avg("m"), 9).alias("macro"),
        F.count(F.lit(1)).alias("tasks"),
        F.min("m").alias("worst"),
        (F.sum("f") / F.sum("n")).alias("fail"),
        F.sum("n").alias("calls"),
    )
    best = best_configuration(
        reports, [F.col("macro").desc(), F.col("worst").desc(), F.col("fail"), F.col("calls"), F.col("exp_id")]
    )
    return best.select("exp_id", F.round("macro", 6).alias("macro"), "tasks", "calls")


@query(
    "udf1_pluggable_scorer",
    """select o_orderstatus as source, count(*) as n, round(avg(case o_orderstatus when 'F' then 1.0
        when 'O' then exp(-abs(o_totalprice - 200000) / 200000) else 0.5 end), 6) as avg_reward from orders group by 1""",
)
def udf1(t):
    from siftlab.operators.plugins import ScorerRegistry

    scorers = ScorerRegistry(default=lambda df: F.lit(0.5))
    scorers.register("F", lambda df: F.lit(1.0))
    scorers.register("O", lambda df: S.decay_score(S.relative_error(F.col("o_totalprice"), F.lit(200000.0))))
    out = scorers.score(t.orders, "o_orderstatus", "reward")
    return out.groupBy(F.col("o_orderstatus").alias("source")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("reward"), 6).alias("avg_reward")
    )


@query(
    "udf2_processor_registry",
    """select 'accuracy' as metric, source, round(avg(quality), 6) as value from documents join labels using (doc_id)
      where source < 'src2' group by source
    union all select 'length', source, round(avg(n_chars), 4) from documents join labels using (doc_id)
      where source >= 'src2' group by source""",
)
def udf2(t):
    from siftlab.operators.plugins import ProcessorRegistry

    graded = t.documents.join(t.labels, "doc_id")
    registry = ProcessorRegistry()
    registry.register(
        "accuracy", F.col("source") < "src2",
        lambda df: df.groupBy("source").agg(F.round(F.avg("quality"), 6).alias("value")),
    )
    registry.register(
        "length", F.lit(True), lambda df: df.groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("value"))
    )
    return registry.run(graded)
