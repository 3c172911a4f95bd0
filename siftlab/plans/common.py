"""Input frames derived from the given tables, and the same derivations as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.functions import fixed as K
from siftlab.plans.registry import Tables


def sql_list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def pick(values, index) -> Column:
    """Element ``index`` modulo the length; spreads rows over labels."""
    col = F.col(index) if isinstance(index, str) else index
    labels = F.array(*[F.lit(v) for v in values])
    return F.element_at(labels, (F.pmod(col.cast("bigint"), F.lit(len(values))) + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    return f"({sql_list(values)})[1 + ({index})::bigint % {len(values)}]"


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


SQL_TASK_OF_ORDER = sql_pick(K.TASKS, "l_orderkey")


def observations(t: Tables) -> DataFrame:
    """Lineitem as observations: order = document, line = material, flag = context, status = label."""
    li = t.lineitem
    return li.select(
        pick(K.TASKS, "l_orderkey").alias("task_type"),
        F.concat(F.lit("10.1000/"), text("l_orderkey")).alias("doi"),
        F.concat(F.lit("m"), text("l_linenumber")).alias("material_identity"),
        F.col("l_returnflag").alias("context_key"),
        F.col("l_linestatus").alias("label_key"),
        F.when(F.col("l_quantity") > 20, "direct")
        .when(F.col("l_quantity") > 10, "recoverable")
        .otherwise("manual_review")
        .alias("status"),
        (F.col("l_discount") <= 0.05).alias("ready"),
        F.concat(F.lit("part_"), text("l_partkey")).alias("source_file"),
        F.col("l_suppkey").alias("row_number"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("extraction_index"),
        F.col("l_quantity").cast("bigint").alias("material_index"),
    )


SQL_OBS = f"""obs as (
  select {SQL_TASK_OF_ORDER} as task_type, '10.1000/' || l_orderkey as doi, 'm' || l_linenumber as material_identity,
    l_returnflag as context_key, l_linestatus as label_key,
    case when l_quantity > 20 then 'direct' when l_quantity > 10 then 'recoverable' else 'manual_review' end as status,
    case when l_quantity > 20 then 2 when l_quantity > 10 then 1 else 0 end as srank,
    l_discount <= 0.05 as ready, 'part_' || l_partkey as source_file, l_suppkey as row_number,
    round(l_extendedprice * 100)::bigint as extraction_index, l_quantity::bigint as material_index
  from lineitem)"""

SQL_CTX = """grp as (
  select task_type, doi, material_identity, context_key, label_key, count(*) as n, max(srank) as best_rank,
    max(ready::int) as any_ready from obs group by all),
ctx as (
  select task_type, doi, material_identity, context_key, count(*) as n_labels, sum(n) as n_rows,
    count_if(n > 1) as dup_groups, sum(n - 1) as dup_removed, max(best_rank) as best_rank, max(any_ready) as any_ready
  from grp group by all)"""


def run_rows(t: Tables) -> DataFrame:
    """Events as judged rollouts: user = question, type and k = experiment, value = reward."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    scaled = F.least(F.lit(1.0), F.floor(F.col("value") / 10) / 8)
    reward = F.when(F.col("value") < 5, 0.0).otherwise(scaled)
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("dataset_index"),
        F.concat("event_type", F.lit("_epoch_"), text(F.pmod(k, F.lit(3)))).alias("exp_id"),
        F.when(F.pmod(k, F.lit(10)) == 9, "rollout").otherwise("judged").alias("stage"),
        pick(K.TASKS, "user_id").alias("task_type"),
        F.pmod("user_id", F.lit(5)).cast("bigint").alias("level"),
        reward.alias("reward"),
        (reward >= 0.5).alias("correct"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Failed to parse predicted answer object: k="), text(k)))
        .when(F.pmod(k, F.lit(7)) == 0, "Missing keys: ['a']")
        .otherwise("")
        .alias("reasoning"),
        F.when(F.pmod(k, F.lit(11)) == 0, "invalid").otherwise("ok").alias("judged_response"),
        k.alias("confidence"),
        (F.col("value") / 100).alias("time_cost"),
        F.pmod(k, F.lit(4)).alias("tool_calls"),
        "ts",
        k.alias("k"),
    )


SQL_RUNS = f"""base as (select *, json_extract_string(props, '$.k')::bigint as k from events),
runs as (
  select event_id as id, user_id as dataset_index, event_type || '_epoch_' || (k % 3) as exp_id,
    case when k % 10 = 9 then 'rollout' else 'judged' end as stage, {sql_pick(K.TASKS, 'user_id')} as task_type,
    (user_id % 5)::bigint as level,
    case when value < 5 then 0.0::double else least(1.0::double, floor(value / 10) / 8) end as reward,
    case when value < 5 then 0.0::double else least(1.0::double, floor(value / 10) / 8) end >= 0.5 as correct,
    case when event_type = 'error' then 'Failed to parse predicted answer object: k=' || k
         when k % 7 = 0 then 'Missing keys: [''a'']' else '' end as reasoning,
    case when k % 11 = 0 then 'invalid' else 'ok' end as judged_response, k as confidence,
    value / 100 as time_cost, k % 4 as tool_calls, ts, k
  from base)"""
