"""Queries that run incremental jobs over the given tables; sinks lie in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.operators import chunking as C
from siftlab.plans.common import text
from siftlab.plans.registry import query
from siftlab.session import scratch_path
from siftlab.streaming import jobs as J


def _stream(t, table: str):
    return J.table_stream(t.spark, f"{t.folder}/{table}.parquet", getattr(t, table).schema)


@query(
    "inc1_stage_progress",
    """with s as (select user_id * 100 + json_extract_string(props, '$.k')::bigint as row_id, case event_type when 'purchase' then 'judged' when 'click' then 'rollout' else 'init' end as stage, event_id from events)
    select row_id, arg_max(stage, (case stage when 'judged' then 2 when 'rollout' then 1 else 0 end, event_id)) as stage,
      arg_max(event_id, (case stage when 'judged' then 2 when 'rollout' then 1 else 0 end, event_id)) as event_id from s group by 1""",
)
def inc1(t):
    spark = t.spark
    k = F.get_json_object("props", "$.k").cast("bigint")
    stage = F.when(F.col("event_type") == "purchase", "judged").when(F.col("event_type") == "click", "rollout").otherwise("init")
    updates = _stream(t, "events").select((F.col("user_id") * 100 + k).alias("row_id"), stage.alias("stage"), "event_id")
    sink, check = scratch_path(spark, "stages"), scratch_path(spark, "check")
    J.run_available(updates, sink, check, lambda batch, _: J.current_stage(batch, "row_id", "event_id"))
    return J.current_stage(J.read_sink(spark, sink, updates.schema), "row_id", "event_id")


@query(
    "inc1_pending_rows",
    """with s as (select user_id * 100 + json_extract_string(props, '$.k')::bigint as row_id, case event_type when 'purchase' then 2 when 'click' then 1 else 0 end as r from events)
    select row_id, 'rollout' as stage from s group by 1 having max(r) = 1""",
)
def inc1_pending(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    stage = F.when(F.col("event_type") == "purchase", "judged").when(F.col("event_type") == "click", "rollout").otherwise("init")
    log = t.events.select((F.col("user_id") * 100 + k).alias("row_id"), stage.alias("stage"), "event_id")
    return J.pending(log, "row_id", "event_id", "judged").select("row_id", "stage")


@query(
    "inc2_incremental_index",
    """select sha256(text) as id, min(doc_id) as doc_id from documents group by 1""",
)
def inc2(t):
    spark = t.spark
    sink, check = scratch_path(spark, "index"), scratch_path(spark, "check")
    incoming = _stream(t, "documents").select(F.sha2("text", 256).alias("id"), "doc_id", "text")
    schema = "id string, doc_id bigint, text string, embedding array<double>"

    def embed(fresh):
        return fresh.select("id", "doc_id", "text", C.hash_embedding("text", 16).alias("embedding"))

    J.append_missing(incoming, sink, check, "id", "doc_id", embed, schema)
    return J.read_sink(spark, sink, schema).where("embedding IS NOT NULL").select("id", "doc_id")


@query(
    "inc3_feedback_rounds",
    """select date_diff('day', date '2024-01-01', ts::date)::int as round_index, count(*) as n, round(avg(value), 6) as mean_value, count_if(event_type = 'error')::bigint as n_errors
    from events group by 1""",
)
def inc3(t):
    spark = t.spark
    sink, check = scratch_path(spark, "rounds"), scratch_path(spark, "check")
    rows = _stream(t, "events").select(
        F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("round_index"), "event_id", "value", "event_type"
    )
    J.run_available(rows, sink, check, lambda batch, _: batch)
    stored = J.read_sink(spark, sink, rows.schema)
    return stored.groupBy("round_index").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.count_if(F.col("event_type") == "error").alias("n_errors")
    )


@query(
    "inc4_cached_results",
    """with c as (select md5(event_type || '|' || user_id) as key, event_id, ts, value from events where ts > timestamp '2024-01-30 00:00:00' - interval 10 day)
    select key, arg_max(event_id, (ts, -event_id)) as event_id, arg_max(value, (ts, -event_id)) as value from c group by 1""",
)
def inc4(t):
    cache = t.events.select(J.cache_key(F.col("event_type"), text("user_id")).alias("key"), "event_id", "ts", "value")
    live = J.reusable_results(cache, ["key"], "ts", F.lit("2024-01-30 00:00:00").cast("timestamp_ntz").cast("timestamp"), 10 * 86400, "event_id")
    return live.select("key", "event_id", "value")


@query(
    "inc4_first_results_stream",
    """select distinct event_type, user_id from events""",
)
def inc4_stream(t):
    spark = t.spark
    sink, check = scratch_path(spark, "first"), scratch_path(spark, "check")
    events = _stream(t, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    firsts = J.first_results(events, ["event_type", "user_id"], "ts", "60 days")
    J.run_available(firsts, sink, check, lambda batch, _: batch)
    return J.read_sink(spark, sink, firsts.schema).select("event_type", "user_id")


@query(
    "inc5_experiment_snapshots",
    """with s as (select event_type as experiment, user_id % 7 as step, event_id as note_id from events)
    select experiment, step, note_id from s where step = (select max(o.step) from s as o where o.experiment = s.experiment)""",
)
def inc5(t):
    snapshots = t.events.select(F.col("event_type").alias("experiment"), F.pmod("user_id", F.lit(7)).alias("step"), F.col("event_id").alias("note_id"))
    path = scratch_path(t.spark, "snapshots")
    J.write_snapshots(snapshots, path)
    # The first step is uploaded again, unchanged; only its folders are rewritten.
    J.write_snapshots(snapshots.where("step = 0"), path)
    stored = J.read_snapshots(t.spark, path, snapshots.schema)
    return J.latest_snapshot(stored).select("experiment", "step", "note_id")
