"""Queries on filters, quality grades and note tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.functions import cards as CA, fixed as K, names
from siftlab.operators import notes as NT, records as RC
from siftlab.plans.common import pick, sql_list, sql_pick, text
from siftlab.plans.registry import query

_GEN = ("Catalyst", " the  sample ", "prepared materials", "Pt/C", "N/A", "Unknown ", "Nanoparticles", "synthesized catalyst X", "")


@query(
    "flt2_generic_names",
    f"""with n as (select {sql_pick(_GEN, 'l_partkey')} as name, l_partkey % 9 as k from lineitem)
    select name, k not in (3, 7) as generic, count(*) as n from n group by all""",
)
def flt2(t):
    rows = t.wide("lineitem").select(pick(_GEN, "l_partkey").alias("name"))
    return rows.withColumn("generic", names.is_generic_name("name")).groupBy("name", "generic").agg(F.count(F.lit(1)).alias("n"))


_VAGUE = ("sample 3", "series of oxides", "rare-earth metal oxides", "Fe-based catalysts", "Co3-xO4", "Pt/C", "catalysts containing Ni", "(iv)", "La1-xSrxMnO3")
_VAGUE_OUT = (
    "anonymous_sample_code", "collective_or_variable_scope", "unspecified_constituent", "group_level_descriptor", "variable_composition_range", "", "group_level_descriptor",
    "anonymous_sample_code", "variable_composition_range",
)


@query(
    "flt3_vague_name_flags",
    f"""with n as (select l_partkey % 9 as k, l_tax > 0.04 as e from lineitem)
    select ({sql_list(_VAGUE)})[1 + k] as name, e as has_scope, case when k in (4, 8) and not e then '' else ({sql_list(_VAGUE_OUT)})[1 + k] end as flags, count(*) as n from n group by all""",
)
def flt3(t):
    has = F.col("l_tax") > 0.04
    rows = t.wide("lineitem").select(pick(_VAGUE, "l_partkey").alias("name"), has.alias("has_scope"), F.when(has, "over a composition range").otherwise("one sample").alias("ev"))
    out = rows.withColumn("flags", F.array_join(names.vague_name_reasons("name", "ev"), ","))
    return out.groupBy("name", "has_scope", "flags").agg(F.count(F.lit(1)).alias("n"))


_FIVE = ("photocatalytic_h2o2", "furfural_hydrogenation", "thermoelectric", "antibacterial", "HER")


@query(
    "flt4_extraction_quality_grade",
    f"""with r as (select {sql_pick(_FIVE, 'l_partkey')} as t, l_suppkey % 4 as k from lineitem)
    select t as task_type, k, case t when 'HER' then 'unusable' when 'thermoelectric' then case k when 0 then 'unusable' when 1 then 'recoverable' when 2 then 'recoverable' else 'direct' end
        when 'antibacterial' then case k when 0 then 'unusable' when 1 then 'recoverable' when 2 then 'recoverable' else 'direct' end
        else case k when 0 then 'unusable' when 1 then 'recoverable' else 'direct' end end as grade, count(*) as n from r group by all""",
)
def flt4(t):
    k = F.pmod("l_suppkey", F.lit(4))
    rows = t.wide("lineitem").select(
        pick(_FIVE, "l_partkey").alias("task_type"),
        k.alias("k"),
        F.when(k == 0, "high").when(k == 1, "12.5").otherwise("~12.5 %").alias("v"),
        F.when(k == 0, "n/a").otherwise("1.2").alias("merit"),
        F.when(k == 1, "hot").when(k == 2, "300").when(k == 3, "300 K").alias("temperature"),
        F.when(k == 1, "complete").when(k == 2, "99.9 %").when(k == 3, "99").alias("threshold"),
        F.when(k == 1, "8 ug/mL").when(k == 3, "> 4 ppm").alias("concentration"),
    )
    fields = {"efficiency": "v", "yield": "v", "merit": "merit", "temperature": "temperature", "threshold": "threshold", "concentration": "concentration"}
    out = rows.withColumn("grade", RC.metric_grade("task_type", fields)["grade"])
    return out.groupBy("task_type", "k", "grade").agg(F.count(F.lit(1)).alias("n"))


_COND = ("10 mA cm-2", "0.01 A/cm2", "20 mA·cm−2", "", "room temperature", "~10 mA cm^-2")
_COND_OUT = ("ok", "ok", "mismatch", "unknown", "unknown", "ok")


@query(
    "flt5_condition_gate",
    f"""with r as (select {sql_pick(_COND, 'l_partkey')} as c, ({sql_list(_COND_OUT)})[1 + l_partkey % 6] as st, (['overpotential_10mAcm-2', 'mass_activity'])[1 + l_suppkey % 2] as m from lineitem)
    select m as metric, c as condition, st as condition_status, count(*) as n from r where not (m like '%10mAcm-2' and st <> 'ok') group by all""",
)
def flt5(t):
    rows = t.wide("lineitem").select(pick(_COND, "l_partkey").alias("condition"), pick(("overpotential_10mAcm-2", "mass_activity"), "l_suppkey").alias("metric"))
    out = RC.condition_gate(rows, "metric", "condition", require_ok=True)
    return out.groupBy("metric", "condition", "condition_status").agg(F.count(F.lit(1)).alias("n"))


_GUIDE = (
    "Strict JSON: return JSON only", "Overpotential: Pt lowers it", "Method: compare two sources first", "RT=HER; use Pt", "HER notes and OER", "tool specific compliance: call twice",
    "short", "json dict with keys",
)


@query(
    "flt10_guideline_classes",
    f"""with g as (select l_partkey % 8 as k from lineitem) select ({sql_list(_GUIDE)})[1 + k] as guideline,
      (['format', 'chemistry', 'method', 'chemistry', 'chemistry', 'format', 'chemistry', 'format'])[1 + k] as class, count(*) as n from g group by all""",
)
def flt10(t):
    rows = t.wide("lineitem").select(pick(_GUIDE, "l_partkey").alias("guideline"))
    return rows.withColumn("class", NT.guideline_class("guideline")).groupBy("guideline", "class").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt10_guideline_pruning",
    f"""with g as (select l_partkey % 8 as k from lineitem) select ({sql_list(_GUIDE)})[1 + k] as guideline, count(*) as n from g where k in (1, 2) group by all""",
)
def flt10_prune(t):
    rows = t.lineitem.select(pick(_GUIDE, "l_partkey").alias("guideline"))
    return NT.prune_guidelines(rows, "guideline", reaction="HER", min_length=10).groupBy("guideline").agg(F.count(F.lit(1)).alias("n"))


@query(
    "flt11_required_field_validation",
    """select case o_custkey % 5 when 0 then 'missing_question' when 1 then 'answer_not_a_json_object' when 2 then 'answer_not_a_json_object' when 3 then 'missing_source' end as violation, count(*) as n from orders group by 1""",
)
def flt11(t):
    k = F.pmod("o_custkey", F.lit(5))
    rows = t.orders.select(
        F.when(k == 3, "").otherwise("s").alias("source"),
        F.when(k != 0, "q").alias("question"),
        F.when(k == 1, "{}").when(k == 2, "[1]").otherwise(F.concat(F.lit('{"v": '), text("o_custkey"), F.lit("}"))).alias("answer"),
    )
    return RC.validate_samples(rows).groupBy("violation").agg(F.count(F.lit(1)).alias("n"))


def _notes(t):
    p = F.col("p_partkey")
    return t.part.select(
        p.alias("id"),
        pick(("material_card", "guideline", "case"), "p_partkey").alias("kind"),
        F.when(F.pmod(p, F.lit(7)) == 0, K.FAMILY_GLOBAL).when(F.pmod(p, F.lit(7)) == 1, K.FAMILY_REACTION).alias("task_family"),
        F.when(F.pmod(p, F.lit(4)) != 3, pick(K.TASKS, "p_size")).alias("task_type"),
    )


@query(
    "flt12_task_scoped_notes",
    f"""with n as (select p_partkey as id, (['material_card', 'guideline', 'case'])[1 + p_partkey % 3] as kind, case p_partkey % 7 when 0 then 'global' when 1 then 'reaction' end as fam,
        case when p_partkey % 4 <> 3 then {sql_pick(K.TASKS, 'p_size')} end as task, p_size % 19 < 9 as rx from part),
      f as (select *, coalesce(fam, case when task is null then '' when rx then 'reaction' else 'material_property' end) as own from n)
    select id, kind, case when own <> 'global' and task is not null then task = 'HER' end as task_exact from f
    where own = 'global' or (own = 'reaction' and not (kind = 'material_card' and task is not null and task <> 'HER'))""",
)
def flt12(t):
    return NT.filter_by_task(_notes(t), task="HER").select("id", "kind", "task_exact")


@query(
    "flt13_acidic_medium_exclusion",
    """select doc_id from documents where doc_id % 6 not in (0, 1, 2) and not regexp_matches(text, '(?i)\\bacidic\\b|\\bH2SO4\\b|\\bHClO4\\b|\\bsulfuric\\s+acid\\b|\\bperchloric\\s+acid\\b')""",
)
def flt13(t):
    k = F.pmod("doc_id", F.lit(6))
    body = F.concat_ws(" ", "text", F.when(k == 0, "in 0.5 M h2so4.").when(k == 1, "under Acidic conditions").when(k == 2, "在酸性条件").otherwise("acetic acid is formed"))
    rows = t.documents.select("doc_id", body.alias("abstract"))
    return rows.where(~RC.mentions_acid("abstract")).select("doc_id")


@query(
    "flt14_request_candidates",
    """select case when page_id % 4 = 0 then 'skipped_empty_abstract' when page_id % 5 = 0 then 'skipped_missing_doi' end as skip_reason,
      case when page_id % 5 <> 0 then '10.1/' || page_id when page_id % 3 = 0 then 'Title ' || page_id else 'pages#' || page_id end as row_key from pages""",
)
def flt14(t):
    p = F.col("page_id")
    rows = t.pages.select(
        p.alias("row_number"),
        F.when(F.pmod(p, F.lit(4)) == 0, "<p> &nbsp; </p>").otherwise(F.col("html")).alias("abstract"),
        F.when(F.pmod(p, F.lit(5)) == 0, " ").otherwise(F.concat(F.lit("10.1/"), text(p))).alias("doi"),
        F.when(F.pmod(p, F.lit(3)) == 0, F.concat(F.lit("Title "), text(p))).alias("title"),
    )
    return RC.request_candidates(rows, "pages").select("skip_reason", "row_key")


@query(
    "agg35_note_coverage_by_task",
    f"""with c as (select {sql_pick(K.TASKS[:15], 'p_partkey')} as t from part), n as (select t, count(*) as n from c group by 1)
    select k.task_type, coalesce(n.n, 0) as cards, n.n is null as missing from (select unnest({sql_list(K.TASKS)}) as task_type) k left join n on n.t = k.task_type""",
)
def agg35(t):
    card = F.concat(F.lit("MaterialCard | TASK="), pick(K.TASKS[:15], "p_partkey"), F.lit("; MATERIAL="), F.col("p_name"))
    return NT.coverage_by_task(t.part.select(card.alias("card")), "card")


@query(
    "agg36_store_statistics",
    f"""select 'reaction_type' as dimension, case when p_partkey % 4 = 0 then 'unknown' else {sql_pick(K.TASKS, 'p_partkey')} end as value, count(*) as n from part group by all
    union all select 'task_family', case when p_size % 2 = 0 then 'reaction' else 'unknown' end, count(*) from part group by all""",
)
def agg36(t):
    rows = t.part.select(
        F.when(F.pmod("p_partkey", F.lit(4)) == 0, "").otherwise(pick(K.TASKS, "p_partkey")).alias("reaction_type"),
        F.when(F.pmod("p_size", F.lit(2)) == 0, "reaction").alias("task_family"),
    )
    return NT.store_statistics(rows)


@query(
    "vec6_search_text_assembly",
    """select p_partkey, 'kind: card' || chr(10) || case when p_size % 2 = 0 then '' else 'task_type: ' || p_type || chr(10) end || 'title: ' || p_name as blob from part""",
)
def vec6(t):
    rows = t.part.select("p_partkey", F.lit("card").alias("kind"), F.when(F.pmod("p_size", F.lit(2)) == 1, F.col("p_type")).otherwise(" ").alias("task"), F.col("p_name").alias("title"))
    return rows.select("p_partkey", CA.search_text([("kind", "kind"), ("task_type", "task"), ("title", "title")]).alias("blob"))


_OPS_SQL = """nt as (select s_suppkey::varchar as note_id, 'note  ' || s_name as content from supplier),
  ops as (select c_custkey as pos, case c_custkey % 5 when 0 then 'add' when 1 then 'UPDATE' when 2 then 'DELETE' when 3 then 'UPDATE' else 'NONE' end as op,
    case when c_custkey % 5 = 0 then null when c_custkey % 5 = 2 then (c_custkey % 300)::varchar else (c_custkey % 160)::varchar end as note_id,
    case c_custkey % 5 when 0 then 'note Supplier#00000000' || (c_custkey % 10) when 1 then 'update ' || c_mktsegment || ' ' || (c_custkey % 160) else 'MaterialCard | TASK=' || c_mktsegment end as content from customer),
  de as (select distinct note_id from ops where op = 'DELETE'),
  up as (select o.*, nt.note_id is not null as known, o.content like 'MaterialCard |%' as card from ops o left join nt using (note_id) where op = 'UPDATE' and o.note_id not in (select note_id from de)),
  best as (select note_id, arg_min(content, (-len(content), content)) as new, bool_or(known) as known, min(pos) as pos from up where not card group by 1),
  kept as (select nt.note_id, coalesce(b.new, nt.content) as content from nt left join best b on b.note_id = nt.note_id and b.known where nt.note_id not in (select note_id from de)),
  adds as (select content, min((tier, pos)) as o from (select content, 0 as tier, pos from ops where op = 'add' union all select content, 1, pos from up where card union all select new, 1, pos from best where not known) group by 1),
  seen as (select regexp_replace(content, ' +', ' ', 'g') as content from nt union select regexp_replace(content, ' +', ' ', 'g') from kept),
  fresh as (select content, row_number() over (order by o, content) - 1 as k from adds where content not in (select content from seen))"""


@query(
    "set6_operation_merge",
    f"""with {_OPS_SQL} select note_id, content from kept union all select (k + 1 + (select max(note_id::bigint) from nt))::varchar, content from fresh""",
)
def set6(t):
    notes = t.supplier.select(text("s_suppkey").alias("note_id"), F.concat(F.lit("note  "), F.col("s_name")).alias("content"))
    k = F.pmod("c_custkey", F.lit(5))
    ops = t.customer.select(
        F.col("c_custkey").alias("pos"),
        F.when(k == 0, "add").when(k.isin(1, 3), "UPDATE ").when(k == 2, "DELETE").otherwise("NONE").alias("operation"),
        F.when(k == 0, None).when(k == 2, text(F.pmod("c_custkey", F.lit(300)))).otherwise(text(F.pmod("c_custkey", F.lit(160)))).alias("note_id"),
        F.when(k == 0, F.concat(F.lit(" note  Supplier#00000000"), text(F.pmod("c_custkey", F.lit(10)))))
        .when(k == 1, F.concat(F.lit("update "), F.col("c_mktsegment"), F.lit(" "), text(F.pmod("c_custkey", F.lit(160)))))
        .otherwise(F.concat(F.lit("MaterialCard | TASK="), F.col("c_mktsegment")))
        .alias("content"),
    )
    return NT.merge_operations(notes, ops)


@query(
    "udf5_property_registry",
    f"""with r(task_type, metric, unit) as (values {', '.join(f"('{k}', '{m}', '{u}')" for k, (m, u) in K.TASK_METRICS.items())}),
      o as (select {sql_pick(K.TASKS, 'o_orderkey')} as task_type from orders)
    select task_type, metric, unit, count(*) as n from o join r using (task_type) group by all""",
)
def udf5(t):
    from siftlab.functions.tasks import metric_of_task, unit_of_task

    rows = t.orders.select(pick(K.TASKS, "o_orderkey").alias("task_type"))
    out = rows.select("task_type", metric_of_task("task_type").alias("metric"), unit_of_task("task_type").alias("unit"))
    return out.groupBy("task_type", "metric", "unit").agg(F.count(F.lit(1)).alias("n"))
