"""Queries on the closed loop: predictions from orders, feedback from lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.functions import fixed as K, scoring as S
from siftlab.operators import feedback as FB
from siftlab.plans.common import pick, sql_pick, text
from siftlab.plans.registry import query

# Feedback row: one per lineitem. Recommendation = order; blank for some, unknown for others.
_SQL_PAIR = f"""fb as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as row_id, l_suppkey as round_id, l_linenumber as line,
    case when l_returnflag = 'N' and l_linestatus = 'F' and l_tax = 0 then 'UNKNOWN' else {sql_pick(K.TASKS, 'l_orderkey')} end as task_type,
    case when l_discount = 0.1 then ' ' when l_discount = 0.09 then 'rec-x' else 'rec-' || l_orderkey end as rec,
    case when l_quantity < 4 then null else l_extendedprice end as actual from lineitem),
  rk as (select 'rec-' || o_orderkey as rec, {sql_pick(K.TASKS, 'o_orderkey')} as task_type, case when o_orderstatus = 'P' then null else o_totalprice / 4 end as predicted,
    o_orderpriority as components from orders),
  pr as (select fb.*, rk.predicted, rk.components, case when fb.task_type = 'UNKNOWN' then 'unknown_task' when trim(fb.rec) = '' then 'missing_recommendation_id'
      when rk.rec is null then 'recommendation_not_found' when actual is null then 'actual_parse_failed'
      when predicted is null then 'prediction_parse_failed' else 'scored' end as stage
    from fb left join rk on fb.rec = rk.rec),
  er as (select *, abs(predicted - actual) as abs_error, abs(predicted - actual) / abs(actual) as rel_error, exp(-abs(predicted - actual) / abs(actual)) as score
    from pr where stage = 'scored')"""


def _inputs(t):
    li = t.lineitem
    unknown = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F") & (F.col("l_tax") == 0)
    rec = (
        F.when(F.col("l_discount") == 0.1, " ")
        .when(F.col("l_discount") == 0.09, "rec-x")
        .otherwise(F.concat(F.lit("rec-"), text("l_orderkey")))
    )
    rows = li.select(
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("row_id"),
        F.col("l_suppkey").alias("round_id"),
        F.col("l_linenumber").alias("line"),
        F.when(unknown, "UNKNOWN").otherwise(pick(K.TASKS, "l_orderkey")).alias("task_type"),
        rec.alias("recommendation_id"),
        F.when(F.col("l_quantity") >= 4, F.col("l_extendedprice")).alias("actual"),
        F.lit("mV").alias("unit"),
    )
    rec_id = F.concat(F.lit("rec-"), text("o_orderkey"))
    recommendations = t.orders.select(rec_id.alias("recommendation_id"), F.col("o_orderpriority").alias("components"))
    ranked = t.orders.select(
        rec_id.alias("recommendation_id"),
        pick(K.TASKS, "o_orderkey").alias("task_type"),
        F.lit(0).alias("pos"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 4).alias("predicted"),
    )
    return rows, recommendations, ranked


def _errors(t):
    return FB.with_errors(FB.scored_pairs(*_inputs(t)))


@query(
    "jon7_prediction_actual_stages",
    f"""with {_SQL_PAIR} select count(*) as rows_total, count_if(stage = 'unknown_task')::bigint as rows_unknown_task,
      count_if(stage = 'missing_recommendation_id')::bigint as rows_missing_recommendation_id,
      count_if(stage = 'recommendation_not_found')::bigint as rows_recommendation_not_found, 0::bigint as rows_prediction_missing,
      count_if(stage = 'actual_parse_failed')::bigint as rows_actual_parse_failed,
      count_if(stage = 'prediction_parse_failed')::bigint as rows_prediction_parse_failed, count_if(stage = 'scored')::bigint as rows_scored from pr""",
)
def jon7(t):
    return FB.stage_counts(FB.pair_predictions(*_inputs(t)))


@query(
    "agg29_error_metrics",
    f"with {_SQL_PAIR} select row_id, round(abs_error, 4) as abs_error, round(rel_error, 6) as rel_error, round(score, 6) as score from er",
)
def agg29(t):
    e = _errors(t)
    return e.select("row_id", F.round("abs_error", 4).alias("abs_error"), F.round("rel_error", 6).alias("rel_error"), F.round("score", 6).alias("score"))


@query(
    "agg33_feedback_reward",
    f"""with {_SQL_PAIR} select task_type, count(*) as n, count_if(rel_error <= 0.02)::bigint as n_full,
      round(avg(case when rel_error <= 0.02 then 1.0 else greatest(0.05, least(0.95, score)) end), 6) as reward from er group by 1""",
)
def agg33(t):
    e = _errors(t).withColumn("reward", S.feedback_reward("rel_error"))
    return e.groupBy("task_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("rel_error") <= 0.02).alias("n_full"), F.round(F.avg("reward"), 6).alias("reward")
    )


_SQL_COMBINE = """m as (select l_orderkey as job, l_linenumber as csv_row, case when l_orderkey % 2 = 0 then 'CO2RR' else 'HER' end as task_type,
    case when l_returnflag = 'A' then 'faradaic_efficiency' else 'partial_current_density' end as metric_key,
    l_partkey * 100 + l_suppkey % 100 as pos, l_tax * 10 as rel_error from lineitem),
  g as (select job, csv_row, count(*) as n, count_if(metric_key = 'faradaic_efficiency') as a, count_if(metric_key = 'partial_current_density') as b,
    min(pos) as pos, avg(rel_error) as rel from m where task_type = 'CO2RR' group by all),
  c as (select job, csv_row, 'CO2RR' as task_type, 'co2rr_combined' as metric_key, pos, rel as rel_error from g where n = 2 and a = 1 and b = 1
    union all select m.* from m left join g on m.job = g.job and m.csv_row = g.csv_row and m.task_type = 'CO2RR'
      where not coalesce(g.n = 2 and g.a = 1 and g.b = 1, false))"""


def _metric_rows(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("job"),
        F.col("l_linenumber").alias("csv_row"),
        F.when(F.pmod("l_orderkey", F.lit(2)) == 0, "CO2RR").otherwise("HER").alias("task_type"),
        F.when(F.col("l_returnflag") == "A", "faradaic_efficiency").otherwise("partial_current_density").alias("metric_key"),
        (F.col("l_partkey") * 100 + F.pmod("l_suppkey", F.lit(100))).alias("pos"),
        (F.col("l_tax") * 10).alias("rel_error"),
        F.exp(-(F.col("l_tax") * 10)).alias("score"),
    )


@query(
    "agg30_weighted_combination",
    f"with {_SQL_COMBINE} select job, csv_row, task_type, metric_key, pos, round(rel_error, 6) as rel_error, round(exp(-rel_error), 6) as score from c",
)
def agg30(t):
    out = FB.combine_metrics(_metric_rows(t), ["job", "csv_row"], "pos")
    return out.withColumn("rel_error", F.round("rel_error", 6)).withColumn("score", F.round("score", 6))


_SQL_ROUNDS = f"""{_SQL_PAIR}, ig as (select distinct s_suppkey as round_id, (s_nationkey % 7) + 1 as line from supplier),
  rc as (select er.*, ig.line is not null as ignored from er left join ig on er.round_id = ig.round_id and er.line = ig.line)"""


def _round_records(t):
    ignored = t.supplier.select(
        F.col("s_suppkey").alias("round_id"), (F.pmod("s_nationkey", F.lit(7)) + 1).cast("int").alias("line")
    )
    return FB.apply_ignore_list(_errors(t), ignored, ["round_id", "line"])


@query(
    "agg31_round_means",
    f"""with {_SQL_ROUNDS} select round_id, count_if(not ignored)::bigint as num_records, count(*) as num_records_total,
      count_if(ignored)::bigint as num_records_ignored, round(avg(case when not ignored then score end), 6) as mean_score,
      round(avg(case when not ignored then rel_error end), 4) as mean_rel_error,
      case when count(distinct components) = 1 then max(components) else 'mixed(' || count(distinct components) || ')' end as components
    from rc group by round_id""",
)
def agg31(t):
    out = FB.round_means(_round_records(t), "round_id")
    return out.withColumn("mean_score", F.round("mean_score", 6)).withColumn("mean_rel_error", F.round("mean_rel_error", 4))


@query(
    "agg31_overall_means",
    f"""with {_SQL_ROUNDS} select count(distinct round_id) as total_rounds, count_if(not ignored)::bigint as total_records,
      count_if(ignored)::bigint as total_records_ignored, round(avg(case when not ignored then score end), 6) as mean_score,
      round(avg(case when not ignored then rel_error end), 4) as mean_rel_error from rc""",
)
def agg31_overall(t):
    out = FB.overall_means(_round_records(t).withColumnRenamed("round_id", "round_index"))
    return out.withColumn("mean_score", F.round("mean_score", 6)).withColumn("mean_rel_error", F.round("mean_rel_error", 4))


@query(
    "flt8_ignore_list",
    """with cur as (select s_suppkey as job, (s_nationkey % 5)::bigint as line from supplier), ad as (select s_suppkey as job, 3::bigint as line from supplier where s_acctbal > 0),
      rm as (select s_suppkey as job, 1::bigint as line from supplier where s_nationkey % 2 = 0)
    select job, line from (select * from cur union select * from ad) u where line >= 1 and not exists (select 1 from rm where rm.job = u.job and rm.line = u.line)""",
)
def flt8(t):
    s = t.supplier
    current = s.select(F.col("s_suppkey").alias("job"), F.pmod("s_nationkey", F.lit(5)).cast("bigint").alias("line"))
    add = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("job"), F.lit(3).cast("bigint").alias("line"))
    remove = s.where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("job"), F.lit(1).cast("bigint").alias("line"))
    return FB.update_ignore_list(current, add, remove, ["job", "line"])


@query(
    "flt9_round_eligibility",
    """with j as (select o_orderkey as job_id, case when o_orderpriority = '1-URGENT' then 'experience_update' else 'rank' end as job_type,
        case when o_orderstatus = 'F' then 'completed' else 'running' end as status, case when o_custkey % 9 = 0 then 'x' end as deleted_at,
        case when o_custkey % 2 = 0 then 'CSV' else 'json' end as fmt, o_orderdate as finished_at from orders),
      n as (select * from j where job_type = 'experience_update' and deleted_at is null and status = 'completed' and lower(fmt) = 'csv'
        order by finished_at desc, job_id desc limit 50)
    select job_id, row_number() over (order by finished_at, job_id) as round_index from n""",
)
def flt9(t):
    jobs = t.orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "experience_update").otherwise("rank").alias("job_type"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"),
        F.when(F.pmod("o_custkey", F.lit(9)) == 0, "x").alias("deleted_at"),
        F.when(F.pmod("o_custkey", F.lit(2)) == 0, "CSV").otherwise("json").alias("upload_format"),
        F.col("o_orderdate").alias("finished_at"),
    )
    return FB.eligible_rounds(jobs, 50).select("job_id", "round_index")


@query(
    "top9_record_cap",
    f"""with {_SQL_PAIR} select row_id, round_id, round(score, 6) as score from er order by round_id, line, row_id limit 1000""",
)
def top9(t):
    order = ["round_id", "line", "row_id"]
    page = FB.cap_records(FB.with_errors(FB.first_scored_pairs(*_inputs(t), order, 1000)), order, 1000)
    return page.select("row_id", "round_id", F.round("score", 6).alias("score"))


@query(
    "jon8_feedback_trace_join",
    f"""with {_SQL_PAIR}, tr as (select o_custkey as cust, 'rec-' || (o_orderkey // 2 * 2) as rec, arg_max(o_orderkey, (o_orderdate, -o_orderkey)) as trace from orders group by all),
      lt as (select 'rec-' || (o_orderkey // 2 * 2) as rec, arg_min(o_orderkey, (-epoch_ms(o_orderdate), o_orderkey)) as trace from orders group by 1)
    select er.row_id, er.rec as recommendation_id, lt.trace, lt.trace is not null as has_trace from er left join lt using (rec)""",
)
def jon8(t):
    traces = t.orders.select(
        F.concat(F.lit("rec-"), text(F.floor(F.col("o_orderkey") / 2) * 2)).alias("recommendation_id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("mtime"),
        F.col("o_orderkey").alias("trace"),
    )
    latest = FB.latest_traces(traces, ["recommendation_id"], "mtime", "trace")
    out = FB.feedback_examples(_errors(t), latest, ["recommendation_id"])
    return out.select("row_id", "recommendation_id", "trace", "has_trace")


@query(
    "win10_candidate_winner",
    """with c as (select l_orderkey as q, 'p' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as pid, l_returnflag = 'A' as f1, l_linestatus = 'F' as f2, l_quantity > 10 as f3,
        l_quantity > 20 as f4, l_tax > 0.02 as f5, l_tax > 0.04 as f6, l_discount > 0.05 as f7, l_linenumber % 3 as ev, l_suppkey % 4 as cf from lineitem)
    select q, arg_min(pid, (not f1, not f2, not f3, not f4, not f5, not f6, not f7, -ev, -cf, pid)) as proposal_id from c group by q""",
)
def win10(t):
    from siftlab.operators.ranking import candidate_winner

    c = t.lineitem.select(
        F.col("l_orderkey").alias("q"),
        F.concat_ws("-", F.concat(F.lit("p"), text("l_linenumber")), text("l_partkey"), text("l_suppkey")).alias("proposal_id"),
        (F.col("l_returnflag") == "A").alias("composition_ok"),
        (F.col("l_linestatus") == "F").alias("task_ok"),
        (F.col("l_quantity") > 10).alias("product_ok"),
        (F.col("l_quantity") > 20).alias("metric_gradable"),
        (F.col("l_tax") > 0.02).alias("metric_present"),
        (F.col("l_tax") > 0.04).alias("metrics_complete"),
        (F.col("l_discount") > 0.05).alias("single_point"),
        F.pmod("l_linenumber", F.lit(3)).alias("evidence_count"),
        F.pmod("l_suppkey", F.lit(4)).alias("confidence_rank"),
    )
    return candidate_winner(c, "q").select("q", "proposal_id")


@query(
    "win11_focus_row",
    """with c as (select l_orderkey as q, l_linenumber as ln, l_partkey as pid, l_linestatus = 'F' as surv, l_suppkey * 100000 + l_partkey * 10 + l_linenumber as pos,
        case when l_orderkey % 3 = 0 then (l_orderkey % 2000) end as w from lineitem)
    select q, arg_min(pid, (case when pid = w then 0 when surv then 1 else 2 end, pos)) as proposal_id from c group by q""",
)
def win11(t):
    from siftlab.operators.ranking import focus_row

    c = t.lineitem.select(
        F.col("l_orderkey").alias("q"),
        F.col("l_partkey").alias("proposal_id"),
        F.when(F.col("l_linestatus") == "F", "surviving").otherwise("defeated").alias("status"),
        (F.col("l_suppkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(F.pmod("l_orderkey", F.lit(3)) == 0, F.pmod("l_orderkey", F.lit(2000))).alias("winner_id"),
    )
    return focus_row(c, "q").select("q", "proposal_id")


_RANK_SQL = """i as (select l_orderkey as q, l_suppkey * 100000 + l_partkey * 10 + l_linenumber as pos, l_linenumber as ln,
    (['Outstanding', 'Good', 'Fair', 'Poor', 'Terrible', ''])[1 + l_partkey % 6] as grade, case when l_tax > 0.01 then l_quantity end as mv,
    case when l_discount > 0.08 then 'failed' else '' end as err from lineitem),
  g as (select *, case lower(grade) when 'outstanding' then 4 when 'good' then 3 when 'fair' then 2 when 'poor' then 1 when 'terrible' then 0 else -1 end as raw from i)"""


def _rank_items(t):
    return t.lineitem.select(
        F.col("l_orderkey").alias("q"),
        (F.col("l_suppkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"),
        pick((*K.GRADES, ""), "l_partkey").alias("grade"),
        F.when(F.col("l_tax") > 0.01, F.col("l_quantity")).alias("metric_value"),
        F.when(F.col("l_discount") > 0.08, "failed").otherwise("").alias("error"),
    )


@query(
    "top5_rank_by_grade",
    f"""with {_RANK_SQL} select q, pos, (row_number() over (partition by q order by case when err <> '' then -1 else raw end desc,
      case when err <> '' then 0 else (mv is not null)::int end desc, pos))::int as rank, case when raw >= 0 then raw / 4 end as normalized_score from g""",
)
def top5(t):
    from siftlab.operators.ranking import rank_tasks

    return rank_tasks(_rank_items(t), ["q"]).select("q", "pos", "rank", "normalized_score")


@query(
    "top5_top_k_with_fill",
    f"""with {_RANK_SQL}, r as (select q, pos, row_number() over (partition by q order by case when mv is not null and raw >= 0 then 0 else 1 end,
      raw desc, (mv is not null)::int desc, pos) as rank from g where err = '') select q, pos, rank::int as rank from r where rank <= 2""",
)
def top5_fill(t):
    from siftlab.operators.ranking import top_tasks

    return top_tasks(_rank_items(t), ["q"], 2).select("q", "pos", "rank")


@query(
    "top6_quota_mix",
    """with g as (select l_orderkey as q, l_partkey as k, min(l_extendedprice) as s from lineitem where l_returnflag = 'A' group by all),
      c as (select l_orderkey as q, l_partkey as k, min(l_extendedprice) as s from lineitem where l_linestatus = 'F' group by all),
      gr as (select q, k, row_number() over (partition by q order by s, k) as r from g), cr as (select q, k, row_number() over (partition by q order by s, k) as r from c),
      t as (select q, k, case when r <= 1 then 0 else 2 end as tier, r from gr union all select q, k, case when r <= 2 then 1 else 3 end, r from cr),
      b as (select q, k, min((tier, r)) as best from t group by all),
      f as (select q, k, row_number() over (partition by q order by best, k) as rank from b) select q, k, rank::int as rank from f where rank <= 3""",
)
def top6(t):
    from siftlab.operators.ordinals import top_per_group
    from siftlab.operators.ranking import quota_mix

    def ranked(frame):
        best = frame.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("k")).agg(F.min("l_extendedprice").alias("s"))
        return top_per_group(best, "q", ["s", "k"], 5)

    guides, cases = ranked(t.lineitem.where("l_returnflag = 'A'")), ranked(t.lineitem.where("l_linestatus = 'F'"))
    return quota_mix([(guides, 1), (cases, 2)], ["q"], "k", 3).select("q", "k", "rank")
