"""Queries on scans and sinks. File layouts are derived from the tables as frames of raw lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.functions import fixed as K
from siftlab.operators import quality as Q
from siftlab.plans.common import SQL_RUNS, pick, run_rows, sql_list, sql_pick, text
from siftlab.plans.registry import query
from siftlab.sources import jsonl, responses as RS, sinks, tables as TB, truth as TR

_FILES = tuple(K.FILE_TASKS)


def _raw_lines(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    line = (
        F.when(F.pmod(k, F.lit(10)) == 0, "  ")
        .when(F.pmod(k, F.lit(11)) == 0, '{"k": ')
        .when(F.pmod(k, F.lit(13)) == 0, "[1, 2]")
        .otherwise(F.concat(F.lit(" "), F.col("props")))
    )
    return t.wide("events").select(pick(_FILES, "user_id").alias("file_name"), line.alias("line"))


_LINE_SQL = f"""ln as (select ({sql_list(K.FILE_TASKS.values())})[1 + user_id % 19] as task_type, json_extract_string(props, '$.k')::bigint as k from events),
  kd as (select *, case when k % 10 = 0 then 'blank' when k % 11 = 0 then 'corrupt' when k % 13 = 0 then 'other' else 'object' end as kind from ln)"""


@query("src1_jsonl_line_report", f"with {_LINE_SQL} select task_type, kind, count(*) as n from kd group by all")
def src1_report(t):
    return jsonl.line_report(_raw_lines(t))


@query(
    "src1_jsonl_tagged_records",
    f"""with {_LINE_SQL} select task_type, count_if(kind = 'object')::bigint as n, sum(case when kind = 'object' then k end)::bigint as total,
      count_if(kind = 'corrupt')::bigint as n_corrupt from kd where kind in ('object', 'corrupt') group by all""",
)
def src1(t):
    records = jsonl.tagged_records(_raw_lines(t), "k bigint", strict=False)
    return records.groupBy("task_type").agg(
        F.count_if(~F.col("corrupt")).alias("n"), F.sum(F.when(~F.col("corrupt"), F.col("record.k"))).alias("total"),
        F.count_if(F.col("corrupt")).alias("n_corrupt"),
    )


_PROPS = tuple(K.PROPERTY_METRIC_KEYS)


def _truth_frames(t):
    o = t.orders
    metric = F.create_map(
        pick(("overpotential", "faradaic_efficiency"), "o_custkey"),
        F.concat(F.when(F.col("o_orderstatus") == "P", ">= ").otherwise(""), text(F.pmod("o_custkey", F.lit(500))), F.lit(" mV")),
    )
    samples = o.select(
        F.struct(
            pick(("her", " OER ", "", "HOR"), "o_orderkey").alias("reaction_type"),
            F.when(F.pmod("o_orderkey", F.lit(5)) == 0, " ").otherwise(F.concat(F.lit("https://doi.org/10.1/"), text("o_orderkey"))).alias("doc_id"),
            metric.alias("metrics_gt"),
            F.array(F.lit("Pt")).alias("metals"),
            F.when(F.col("o_orderstatus") == "F", "CO").alias("product"),
            F.create_map().cast("map<string,string>").alias("units"),
            text("o_orderkey").alias("id"),
        ).alias("meta")
    )
    li = t.wide("lineitem")
    q = text(F.col("l_quantity").cast("int"))
    rows = li.select(
        pick((*_PROPS, "other"), "l_partkey").alias("_schema"),
        F.concat(F.lit("10.2/"), text("l_orderkey")).alias("doi"),
        F.col("l_linenumber").alias("row_number"),
        F.array(F.lit("Fe")).alias("metals"),
        F.when(F.col("l_quantity") > 5, F.concat(q, F.lit(" K"))).alias("neel_temperature"),
        F.concat(F.lit("~"), q, F.lit(" S/m")).alias("conductivity"),
        F.concat(q, F.lit(" emu/g")).alias("saturation_magnetization"),
        F.concat(q, F.lit(" %")).alias("photothermal_conversion_efficiency"),
        F.when(F.col("l_tax") > 0.02, F.concat(q, F.lit(" W"))).otherwise("n/a").alias("thermal_conductivity"),
    )
    return samples, rows


_TRUTH_SQL = f"""s as (select upper(trim((['her', ' OER ', '', 'HOR'])[1 + o_orderkey % 4])) as task_type, case when o_orderkey % 5 = 0 then '' else '10.1/' || o_orderkey end as doi,
    null::bigint as row_number, (['overpotential', 'faradaic_efficiency'])[1 + o_custkey % 2] as metric_key, (case when o_orderstatus = 'P' then '>= ' else '' end) || (o_custkey % 500) || ' mV' as v from orders),
  p as (select {sql_pick((*_PROPS, 'other'), 'l_partkey')} as task_type, '10.2/' || l_orderkey as doi, l_linenumber::bigint as row_number, l_quantity::int as q, l_quantity, l_tax from lineitem),
  pm as (select task_type, doi, row_number, case task_type when 'antiferromagnetism' then 'neel_temperature' when 'conductivity' then 'conductivity'
      when 'thermal_conductivity' then 'thermal_conductivity' when 'photothermal_conversion_efficiency' then 'photothermal_conversion_efficiency'
      when 'ferrimagnetism' then 'saturation_magnetization' when 'ferromagnetism' then 'saturation_magnetization' end as metric_key,
    case task_type when 'antiferromagnetism' then case when l_quantity > 5 then q || ' K' end when 'conductivity' then '~' || q || ' S/m'
      when 'thermal_conductivity' then case when l_tax > 0.02 then q || ' W' else 'n/a' end when 'photothermal_conversion_efficiency' then q || ' %'
      when 'ferrimagnetism' then q || ' emu/g' when 'ferromagnetism' then q || ' emu/g' end as v from p),
  tt as (select * from s where task_type <> '' and doi <> '' union all select * from pm where v is not null)"""


@query(
    "src2_truth_table_two_layouts",
    f"with {_TRUTH_SQL} select task_type, doi, coalesce(row_number, -1) as row_number, metric_key, v as value, count(*) as n from tt group by all",
)
def src2(t):
    targets = TR.truth_targets(*_truth_frames(t))
    long = targets.select("task_type", "doi", F.coalesce("row_number", F.lit(-1)).alias("row_number"), F.explode("metrics").alias("metric_key", "value"))
    return long.groupBy(*long.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agg9_truth_parse_statistics",
    f"""with {_TRUTH_SQL}, c as (select task_type, metric_key, v, v <> 'n/a' as parsed, regexp_extract(v, '^(>=|~)', 1) as comparator,
        coalesce(nullif(case when v = 'n/a' then '' else regexp_extract(v, '[0-9]+ (.*)$', 1) end, ''), '<missing>') as unit from tt),
      k as (select *, case when task_type in ({sql_list(_PROPS)[1:-1]}) then case when lower(unit) in ('k', 's/m', 'emu/g', '%') then 'canonical' else 'noncanonical_or_missing' end else 'declared' end as contract from c)
    select task_type, metric_key, contract, unit, count(*) as n_values, count_if(parsed)::bigint as n_parseable,
      count_if(parsed and comparator <> '')::bigint as n_with_comparator from k group by all""",
)
def agg9(t):
    return Q.truth_parse_statistics(TR.truth_values(TR.truth_targets(*_truth_frames(t))))


@query(
    "src3_csv_header_resolution",
    """select o_orderpriority as reaction_type, o_orderstatus as product, o_totalprice as value, 'mV' as unit, o_custkey as id from orders""",
)
def src3(t):
    raw = t.orders.select(
        F.col("o_orderpriority").alias(" 反应类型 "), F.col("o_orderstatus").alias("主要产物 (CO2RR)"), F.col("o_totalprice").alias("数值"),
        F.lit("mV").alias("UNIT"), F.col("o_custkey").alias("编号"), F.lit("x").alias("unrelated"),
    )
    return TB.canonical_columns(raw, required=("reaction_type", "value")).select("reaction_type", "product", "value", "unit", "id")


@query(
    "src5_document_identification",
    """with f as (select doc_id, case doc_id % 4 when 0 then '/data/HER/d' || doc_id || '.md' when 1 then '/data/x/oer_' || doc_id || '.md' when 2 then '/data/orr/' || doc_id || '.md' else '/data/x/' || doc_id || '.md' end as path,
        case when doc_id % 3 = 0 then '10.1234/abc.' || doc_id end as doi from documents),
      b as (select *, doc_id::varchar as base, lower(regexp_replace(path, '\\.md$', '')) as slug from f)
    select doc_id, case doc_id % 4 when 0 then 'HER' when 1 then 'OER' when 2 then 'ORR' else 'unknown' end as reaction_type,
      coalesce(doi, 'no-doi:' || regexp_extract(slug, '([^/]*)$', 1) || '_' || substr(sha256(trim(slug, '_')), 1, 16)) as resolved from b""",
)
def src5(t):
    i, d = F.pmod("doc_id", F.lit(4)), text("doc_id")
    path = (
        F.when(i == 0, F.concat(F.lit("/data/HER/d"), d))
        .when(i == 1, F.concat(F.lit("/data/x/oer_"), d))
        .when(i == 2, F.concat(F.lit("/data/orr/"), d))
        .otherwise(F.concat(F.lit("/data/x/"), d))
    )
    head = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat(F.lit("DOI: 10.1234/ABC."), d, F.lit(".\n"))).otherwise("")
    files = t.wide("documents").select(F.concat(path, F.lit(".md")).alias("path"), F.concat(head, F.col("text")).alias("text"))
    out = TB.identify_documents(files)
    return out.select(F.regexp_extract("path", r"(\d+)\.md$", 1).cast("bigint").alias("doc_id"), "reaction_type", F.col("doc_id").alias("resolved"))


@query(
    "src6_wide_sheet_to_long",
    """with s as (select o_orderkey as id, o_custkey % 400 + 1 as a, o_custkey % 90 + 5 as b, o_orderstatus as st from orders where o_orderkey % 50 <> 0)
    select id || '_OER' as id, 'OER' as reaction_type, 'Ni' as metals, least(a, b)::double as value, 'mV' as unit from s where st <> 'P'
    union all select id || '_HER', 'HER', 'Ni', round(least(a / 1000, b / 1000) * 1000, 6)::double, 'mV' from s
    union all select id || '_UOR', 'UOR', 'Ni', a / 1000, 'V' from s where st = 'F'""",
)
def src6(t):
    a, b = F.pmod("o_custkey", F.lit(400)) + 1, F.pmod("o_custkey", F.lit(90)) + 5
    sheet = t.orders.select(
        F.when(F.pmod("o_orderkey", F.lit(50)) == 0, " ").otherwise(text("o_orderkey")).alias("id"),
        F.lit("Ni").alias("metals"),
        F.when(F.col("o_orderstatus") == "P", "N/A").otherwise(F.concat(text(a), F.lit("mV, "), text(b))).alias("OER eta10"),
        F.concat(text(a / 1000), F.lit("V，"), text(b / 1000)).alias("η10 (her)"),
        F.when(F.col("o_orderstatus") == "F", F.concat(text(a), F.lit(" mV").substr(2, 2))).otherwise("无").alias("UOR"),
        F.lit("9").alias("remark"),
    )
    return TB.wide_to_long(sheet, "id", "metals").withColumn("value", F.round("value", 6))


@query(
    "src7_metadata_pivot",
    """with m as (select doc_id, case lang when 'en' then 'her' when 'fr' then 'Photocatalytic H2O2 production' when 'de' then 'nonsense' else 'ORR' end as task,
        case when doc_id % 6 = 0 then null else '10.5/' || source end as doi from documents)
    select distinct case task when 'her' then 'HER' when 'ORR' then 'ORR' else 'photocatalytic_h2o2' end as task_type, lower(doi) as doi from m where doi is not null and task <> 'nonsense'""",
)
def src7(t):
    task = (
        F.when(F.col("lang") == "en", "her")
        .when(F.col("lang") == "fr", "Photocatalytic H2O2 production")
        .when(F.col("lang") == "de", "nonsense")
        .otherwise("ORR")
    )
    doc = F.when(F.pmod("doc_id", F.lit(6)) != 0, F.concat(F.lit("doi: 10.5/"), F.upper("source"), F.lit(".")))
    entries = F.array(
        F.struct(F.lit("reaction_type").alias("key"), task.alias("string_value")),
        F.struct(F.lit("doc_id").alias("key"), doc.alias("string_value")),
        F.struct(F.lit("total_chunks").alias("key"), F.lit("3").alias("string_value")),
    )
    eav = t.documents.select(F.col("doc_id").alias("id"), F.explode(entries).alias("e")).select("id", "e.*")
    return TB.metadata_pairs(eav)


def _trace_json(t):
    o, c = text("o_orderkey"), F.pmod("o_custkey", F.lit(3))

    def proposal(n: int):
        claim = F.concat(F.lit("Reaction Type: "), pick(K.REACTION_TASKS, "o_custkey"), F.lit(f"; claim {n}"))
        return F.struct(
            F.lit("propose").alias("type"), F.lit(f"p{n}").alias("proposal_id"), F.lit(f"agent{n}").alias("agent_name"), claim.alias("claim"),
            F.lit(None).cast("int").alias("round"), F.lit(None).cast("string").alias("target_proposal_id"),
            F.lit(None).cast("string").alias("critique"), F.lit(None).cast("boolean").alias("valid"),
        )

    review = F.struct(
        F.lit("review").alias("type"), F.lit(None).cast("string").alias("proposal_id"), F.lit(None).cast("string").alias("agent_name"),
        F.lit(None).cast("string").alias("claim"), F.lit(2).alias("round"), F.lit("p1").alias("target_proposal_id"),
        F.concat(F.lit("weak "), o).alias("critique"), (c == 0).alias("valid"),
    )
    survivors = F.when(c == 0, F.array(F.struct(F.lit("p0").alias("proposal_id")))).otherwise(
        F.array(F.struct(F.lit("p1").alias("proposal_id")))
    )
    gone = F.when(c == 2, F.array(F.struct(F.lit("p0").alias("proposal_id")))).otherwise(
        F.array().cast("array<struct<proposal_id:string>>")
    )
    result = F.struct(
        F.array(proposal(0), review, proposal(1)).alias("debate_history"), survivors.alias("surviving_proposals"), gone.alias("withdrawn_proposals")
    )
    top = F.struct(
        F.when(F.col("o_orderstatus") == "F", o).alias("debate_id"), F.concat(F.lit("exp-"), o).alias("experiment_id"), result.alias("result")
    )
    return RS.parse_traces(t.wide("orders").select(F.to_json(top).alias("j")), "j")


_TRACE_SQL = f"""tr as (select case when o_orderstatus = 'F' then o_orderkey::varchar else 'exp-' || o_orderkey end as debate_id, {sql_pick(K.REACTION_TASKS, 'o_custkey')} as reaction_type,
    o_custkey % 3 as c, o_orderkey from orders),
  pp as (select debate_id, reaction_type, 'p0' as proposal_id, 0 as pos, case c when 0 then 'surviving' when 2 then 'withdrawn' else 'unknown' end as status, c, o_orderkey from tr
    union all select debate_id, reaction_type, 'p1', 2, case when c = 0 then 'unknown' else 'surviving' end, c, o_orderkey from tr)"""


@query("src9_trace_proposals", f"with {_TRACE_SQL} select debate_id, reaction_type, proposal_id, pos, status from pp")
def src9(t):
    return RS.proposals(_trace_json(t)).select("debate_id", "reaction_type", "proposal_id", "pos", "status")


@query(
    "src9_trace_critiques",
    f"with {_TRACE_SQL} select debate_id, 2 as round, 'p1' as target_proposal_id, 'weak ' || o_orderkey as critique, c = 0 as valid from tr",
)
def src9_critiques(t):
    return RS.critiques(_trace_json(t)).select("debate_id", "round", "target_proposal_id", "critique", "valid")


@query(
    "nrm37_debate_reward_rows",
    f"""with {_TRACE_SQL} select debate_id, proposal_id, case when status = 'surviving' then 1.0::double else 0.0 end as reward,
      case when proposal_id = 'p1' and c = 0 then '- [issue]: weak ' || o_orderkey else '[No critique provided]' end as reasoning from pp where status <> 'withdrawn'""",
)
def nrm37(t):
    return RS.reward_rows(_trace_json(t)).select("debate_id", "proposal_id", "reward", "reasoning")


_BATCH_SQL = """b as (select l_partkey * 10 + l_linenumber as key, l_orderkey, l_quantity::int as q, (l_partkey + l_linenumber) % 9 as k from lineitem),
  r as (select b.*, o_orderkey is not null as known, o_orderstatus = 'P' as nodoi,
    case k when 0 then 'batch_json_decode_error' when 1 then 'batch_http_error' when 2 then 'model_returned_INVALID' when 3 then 'no_json_object_found'
      when 4 then 'missing_or_invalid_metals' when 5 then 'property_type_mismatch' when 6 then 'missing_or_invalid_metric'
      else case when o_orderkey is null or o_orderstatus = 'P' then 'missing_doi' else 'kept' end end as outcome
    from b left join orders on o_orderkey = b.l_orderkey * 2)"""


def _batch(t):
    k = F.pmod(F.col("l_partkey") + F.col("l_linenumber"), F.lit(9))
    q = text(F.col("l_quantity").cast("int"))

    def answer(metals, prop, metric):
        return F.concat(
            F.lit('Here: {"metals": ["'), F.lit(metals), F.lit('", "Fe2O3"], "property_type": "'), F.lit(prop),
            F.lit('", "conductivity": "'), q, F.lit(metric), F.lit('"}'),
        )

    content = (
        F.when(k == 2, "INVALID")
        .when(k == 3, "sorry")
        .when(k == 4, answer("water", "Conductivity", " S/m"))
        .when(k == 5, answer("Fe", "magnetism", " S/m"))
        .when(k == 6, answer("Fe", "Conductivity", " furlongs"))
        .otherwise(answer("Fe", "conductivity", " mS cm^-1"))
    )
    body = F.to_json(
        F.struct(
            text(F.col("l_orderkey") * 2).alias("custom_id"),
            F.struct(
                F.when(k == 1, 500).otherwise(200).alias("status_code"),
                F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")).alias("body"),
            ).alias("response"),
        )
    )
    lines = t.wide("lineitem").select(F.when(k == 0, '{"custom_id": ').otherwise(body).alias("line"))
    requests = t.orders.select(
        text("o_orderkey").alias("custom_id"), F.col("o_orderkey").alias("row_number"),
        F.when(F.col("o_orderstatus") == "P", "  ").otherwise(F.concat(F.lit("10.7/"), text("o_orderkey"))).alias("doi"),
    )
    return RS.classify_responses(lines, requests, "conductivity")


@query("src10_batch_response_outcomes", f"with {_BATCH_SQL} select outcome, count(*) as n from r group by outcome")
def src10(t):
    return RS.outcome_counts(_batch(t))


@query(
    "src10_kept_responses",
    f"""with {_BATCH_SQL} select l_orderkey * 2 as row_number, '10.7/' || (l_orderkey * 2) as doi, 'Fe' as metals, q || ' mS cm-1' as metric, count(*) as n
    from r where outcome = 'kept' group by all""",
)
def src10_kept(t):
    kept = RS.kept_responses(_batch(t)).withColumn("metals", F.array_join("metals", ","))
    return kept.groupBy("row_number", "doi", "metals", "metric").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src10_dead_letters",
    f"""with {_BATCH_SQL} select outcome as reason, count(*) as n, count(distinct case when outcome <> 'batch_json_decode_error' and known then l_orderkey * 2 end) as n_rows
    from r where outcome <> 'kept' group by all""",
)
def src10_dead(t):
    return RS.dead_letters(_batch(t)).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row_number").alias("n_rows")
    )


@query(
    "src11_dataset_load",
    """select lang as dataset, row_number() over (partition by lang order by doc_id) - 1 as index, doc_id, 'Q ' || source || chr(10) || chr(10) || 'about ' || lang as question, 'a' as answer
    from documents""",
)
def src11(t):
    rows = t.documents.select(
        "doc_id", "lang", F.concat(F.lit("Q "), F.col("source")).alias("instruction"), F.concat(F.lit("about "), F.col("lang")).alias("input"), F.lit("a").alias("output")
    )
    return TB.dataset_rows(rows, F.col("lang"), "doc_id", layout="instruction").select("dataset", "index", "doc_id", "question", "answer")


@query(
    "snk1_count_checked_lines",
    """select o_orderpriority as grp, count(*) as expected, count(*) as written, true as matches from orders group by 1""",
)
def snk1(t):
    lines = t.orders.select(F.col("o_orderpriority").alias("grp"), sinks.sorted_json(t.orders).alias("value"))
    expected = t.orders.groupBy(F.col("o_orderpriority").alias("grp")).agg(F.count(F.lit(1)).alias("expected"))
    return sinks.count_check(lines, expected, "grp")


@query(
    "snk1_sorted_json_rows",
    """select c_custkey as id, '{"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}' as line from customer""",
)
def snk1_json(t):
    rows = t.customer.select("c_name", "c_nationkey", "c_mktsegment")
    return t.customer.select(F.col("c_custkey").alias("id"), sinks.sorted_json(rows).alias("line"))


@query(
    "snk2_manifest_and_fingerprint",
    """select o_orderpriority as grp, count(*) as n, sum(('0x' || substr(md5(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus), 1, 15))::hugeint)::varchar as fingerprint
    from orders group by 1""",
)
def snk2(t):
    out = sinks.manifest(t.orders, "o_orderpriority", ["o_orderkey", "o_custkey", "o_orderstatus"])
    return out.withColumnRenamed("o_orderpriority", "grp")


@query(
    "snk2_manifest_json",
    """with c as (select o_orderstatus as g, count(*) as n from orders group by 1)
    select '{"counts":{' || string_agg('"' || g || '":' || n, ',' order by g) || '},"seed":42,"total":' || sum(n) || '}' as manifest from c""",
)
def snk2_json(t):
    return sinks.manifest_json(t.orders, "o_orderstatus", ["o_orderkey"], 42)


@query(
    "snk3_count_bounded_parts",
    """with r as (select o_orderkey, ((row_number() over (order by o_orderkey) - 1) // 700 + 1)::int as part from orders)
    select part, count(*) as n, min(o_orderkey) as first_id, max(o_orderkey) as last_id from r group by 1""",
)
def snk3(t):
    parts = sinks.bounded_parts(t.orders.select("o_orderkey"), "o_orderkey", 700)
    return parts.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"), F.max("o_orderkey").alias("last_id")
    )


@query(
    "snk5_experiment_dump_and_clear",
    f"""with {SQL_RUNS} select 'dump' as part, count(*) as n, min(id) as first_id from runs where exp_id = 'view_epoch_1'
    union all select 'rest', count(*), min(id) from runs where exp_id <> 'view_epoch_1'""",
)
def snk5(t):
    from siftlab.sources.runs import clear_experiment, run_scan

    runs = run_rows(t)
    dump = run_scan(runs, "view_epoch_1", None).agg(F.lit("dump").alias("part"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    rest = clear_experiment(runs, "view_epoch_1").agg(F.lit("rest").alias("part"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))
    return dump.unionByName(rest)


@query(
    "udf4_table_valued_expansions",
    f"""with {_TRACE_SQL} select 'proposal' as kind, count(*) as n from pp union all select 'critique', count(*) from tr
    union all select 'value', 2 * (select count(*) from orders)""",
)
def udf4(t):
    traces = _trace_json(t)
    values = t.orders.select(F.explode(F.split(F.concat_ws(",", text("o_custkey"), F.col("o_orderstatus")), ",")).alias("v"))
    frames = {"proposal": RS.proposals(traces), "critique": RS.critiques(traces), "value": values}
    parts = [f.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n")) for kind, f in frames.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
