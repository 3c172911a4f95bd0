"""Queries on bindings, lookups, bands, patches and set similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.functions import fixed as K
from siftlab.functions.ids import citation_id
from siftlab.operators import binding as B, joins as J
from siftlab.plans.common import pick, sql_list, sql_pick, text
from siftlab.plans.registry import query

_NAMES = ("Pt-Fe/C", "Pt Fe", "PtFe/CN", "Cu2O", "ZnO", "catalyst", "Fe", "Co(OH)2")
_ASKED = ("PtFe", "pt-fe/c", "Cu2O film", "Zn", "", "Ni", "sample", "co(oh)2")
_SYMBOLS = ("Pt", "Fe", "Cu", "Zn", "Ni", "Co", "Ru")


def _records(t):
    return t.orders.select(
        F.lit("HER").alias("task_type"),
        F.concat(F.lit("10.1/"), text(F.pmod("o_orderkey", F.lit(3000)))).alias("doi"),
        F.pmod("o_custkey", F.lit(60)).alias("row_number"),
        F.col("o_orderkey").alias("record_id"),
    )


def _truth(t):
    return t.lineitem.select(
        F.lit("HER").alias("task_type"),
        F.concat(F.lit("10.1/"), text(F.pmod("l_orderkey", F.lit(4000)))).alias("doi"),
        F.when(F.col("l_linenumber") > 2, F.pmod("l_suppkey", F.lit(60))).alias("row_number"),
        F.col("l_returnflag").alias("context"),
        F.col("l_linestatus").alias("label"),
    )


_SQL_TRUTH = """rec as (select '10.1/' || (o_orderkey % 3000) as doi, o_custkey % 60 as row_number, o_orderkey as record_id from orders),
tr as (select '10.1/' || (l_orderkey % 4000) as doi, case when l_linenumber > 2 then l_suppkey % 60 end as row_number,
  l_returnflag as context, l_linestatus as label from lineitem),
rr as (select doi, row_number, sum(n) as n, sum(l) as u, max(l) > 1 as c from (select doi, row_number, context, count(*) as n,
  count(distinct label) as l from tr where row_number is not null group by all) group by all),
dd as (select doi, sum(n) as n, sum(l) as u, max(l) > 1 as c from (select doi, context, count(*) as n,
  count(distinct label) as l from tr group by all) group by all),
j as (select rec.*, case when rr.n is not null then 'task_doi_row' when dd.n is not null then 'task_doi' else 'none' end as join_mode,
  coalesce(rr.n, dd.n, 0)::bigint as n_targets, coalesce(rr.u, dd.u, 0)::bigint as n_unique, coalesce(rr.c, dd.c, false) as has_conflict
  from rec left join rr using (doi, row_number) left join dd on rec.doi = dd.doi)"""


@query(
    "jon1_truth_join_with_precedence",
    f"with {_SQL_TRUTH} select record_id, doi, join_mode, n_targets, n_unique, has_conflict from j",
)
def jon1(t):
    out = B.truth_join(_records(t), _truth(t))
    return out.select("record_id", "doi", "join_mode", "n_targets", "n_unique", "has_conflict")


@query(
    "jon1_unambiguous_targets",
    f"""with {_SQL_TRUTH}, d as (select distinct doi, row_number, context, label from tr), e as (select distinct doi, context, label from tr)
    select record_id, join_mode, context, label from j join d using (doi, row_number) where not has_conflict and join_mode = 'task_doi_row'
    union all select record_id, join_mode, context, label from j join e using (doi) where not has_conflict and join_mode = 'task_doi'""",
)
def jon1_targets(t):
    return B.unambiguous_targets(_records(t), _truth(t)).select("record_id", "join_mode", "context", "label")


@query(
    "agg5_audit_counters",
    f"""with {_SQL_TRUTH} select coalesce(m, 'ALL') as task_type, count(*) as source_records, count_if(join_mode = 'task_doi_row')::bigint as join_task_doi_row,
      count_if(join_mode = 'task_doi')::bigint as join_task_doi, count_if(join_mode = 'none')::bigint as records_without_truth,
      count_if(has_conflict)::bigint as records_with_conflict, sum(n_targets)::bigint as truth_rows_matched,
      sum(n_targets - n_unique)::bigint as duplicate_truth_rows
    from (select *, {sql_pick(K.TASKS, 'record_id')} as m from j) group by rollup(m)""",
)
def agg5(t):
    out = B.truth_join(_records(t), _truth(t)).withColumn("task_type", pick(K.TASKS, "record_id"))
    mode = F.col("join_mode")
    return out.rollup("task_type").agg(
        F.count(F.lit(1)).alias("source_records"),
        F.count_if(mode == "task_doi_row").alias("join_task_doi_row"),
        F.count_if(mode == "task_doi").alias("join_task_doi"),
        F.count_if(mode == "none").alias("records_without_truth"),
        F.count_if("has_conflict").alias("records_with_conflict"),
        F.sum("n_targets").alias("truth_rows_matched"),
        F.sum(F.col("n_targets") - F.col("n_unique")).alias("duplicate_truth_rows"),
    ).withColumn("task_type", F.coalesce("task_type", F.lit("ALL")))


@query(
    "jon2_binding_by_elements",
    f"""with m as (select l_orderkey % 5000 as doi, l_orderkey * 100 + l_linenumber as material_index,
        list_sort(list_distinct([{sql_pick(_SYMBOLS, 'l_partkey')}, {sql_pick(_SYMBOLS, 'l_suppkey')}, {sql_pick(_SYMBOLS, 'l_linenumber')}])) as els from lineitem),
      ms as (select doi, els, count(*) as n, min(material_index) as material_index from m group by all),
      tg as (select o_orderkey as target_id, o_orderkey % 5000 as doi,
        list_sort(list_distinct([{sql_pick(_SYMBOLS, 'o_custkey')}, {sql_pick(_SYMBOLS, 'o_orderkey')}])) as els from orders),
      ex as (select target_id, max(ms.material_index) as mi from tg join ms on tg.doi = ms.doi and tg.els = ms.els where n = 1 group by 1),
      sb as (select target_id, sum(n) as n, min(ms.material_index) as mi from tg join ms on tg.doi = ms.doi and list_has_all(ms.els, tg.els) group by 1)
    select tg.target_id, coalesce(ex.mi, case when sb.n = 1 then sb.mi end) as material_index,
      case when ex.mi is not null then 'unique_exact_element_match' when sb.n = 1 then 'unique_element_subset_match' end as binding_mode
    from tg left join ex using (target_id) left join sb using (target_id)""",
)
def jon2(t):
    doc = F.pmod("l_orderkey", F.lit(5000))
    materials = t.lineitem.select(
        doc.alias("doi"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("material_index"),
        F.array(pick(_SYMBOLS, "l_partkey"), pick(_SYMBOLS, "l_suppkey"), pick(_SYMBOLS, "l_linenumber")).alias("elements"),
    )
    targets = t.orders.select(
        F.pmod("o_orderkey", F.lit(5000)).alias("doi"),
        F.col("o_orderkey").alias("target_id"),
        F.array(pick(_SYMBOLS, "o_custkey"), pick(_SYMBOLS, "o_orderkey")).alias("elements"),
    )
    return B.bind_by_elements(targets, materials).select("target_id", "material_index", "binding_mode")


_KEY = "regexp_replace(lower({}), '[^0-9a-z]+', '', 'g')"


@query(
    "jon3_binding_by_name",
    f"""with m as (select l_orderkey as doi, l_linenumber::bigint * 1000000 + l_partkey as mi, {sql_pick(_NAMES, 'l_partkey')} as nm from lineitem),
      mk as (select *, {_KEY.format('nm')} as k, lower(nm) = 'catalyst' as gen from m),
      pd as (select doi, count(*) as n, min(mi) as mi, max(gen) as gen from mk group by 1),
      x as (select o_orderkey as doi, {sql_pick(_ASKED, 'o_custkey')} as nm, 'the ' || {sql_pick(_NAMES, 'o_orderkey')} || ' was used' as ev from orders),
      xk as (select *, {_KEY.format('nm')} as k, {_KEY.format('ev')} as ek from x),
      j as (select xk.doi, xk.nm, any_value(pd.n) as pn, any_value(pd.mi) as pmi, any_value(pd.gen) as pgen,
        count_if(mk.k = xk.k and xk.k <> '') as en, min(case when mk.k = xk.k then mk.mi end) as ei, max(case when mk.k = xk.k then mk.gen end) as eg,
        count_if(xk.k <> '' and mk.k <> '' and (contains(mk.k, xk.k) or contains(xk.k, mk.k))) as sn,
        min(case when contains(mk.k, xk.k) or contains(xk.k, mk.k) then mk.mi end) as si, max(case when contains(mk.k, xk.k) or contains(xk.k, mk.k) then mk.gen end) as sg,
        count_if(mk.k <> '' and contains(xk.ek, mk.k)) as vn, min(case when contains(xk.ek, mk.k) then mk.mi end) as vi, max(case when contains(xk.ek, mk.k) then mk.gen end) as vg
        from xk left join mk on xk.doi = mk.doi left join pd on xk.doi = pd.doi group by xk.doi, xk.nm)
    select doi, case when nm <> '' then case when en = 1 and not eg then 'direct' when sn = 1 and not sg then 'recoverable' when pn = 1 and not pgen then 'recoverable' else 'manual_review' end
        else case when pn = 1 and not pgen then 'direct' when pn is null then 'manual_review' when vn = 1 and not vg then 'recoverable' else 'manual_review' end end as status,
      case when nm <> '' then case when en = 1 and not eg then ei when sn = 1 and not sg then si when pn = 1 and not pgen then pmi end
        else case when pn = 1 and not pgen then pmi when pn is null then null when vn = 1 and not vg then vi end end as material_index,
      case when nm <> '' then case when en = 1 and not eg then '' when sn = 1 and not sg then 'material_name_requires_normalized_substring_match'
          when pn = 1 and not pgen then 'explicit_material_name_mismatch_but_record_is_singleton' else 'explicit_material_name_not_uniquely_matched' end
        else case when pn = 1 and not pgen then '' when pn is null then 'missing_material_object' when vn = 1 and not vg then 'material_bound_by_unique_evidence_mention'
          else 'multiple_materials_without_material_name' end end as reason from j""",
)
def jon3(t):
    materials = t.wide("lineitem").select(
        F.col("l_orderkey").alias("doi"),
        (F.col("l_linenumber").cast("bigint") * 1000000 + F.col("l_partkey")).alias("material_index"),
        pick(_NAMES, "l_partkey").alias("name"),
    )
    extractions = t.wide("orders").select(
        F.col("o_orderkey").alias("doi"),
        F.col("o_orderkey").alias("extraction_id"),
        pick(_ASKED, "o_custkey").alias("name"),
        F.concat(F.lit("the "), pick(_NAMES, "o_orderkey"), F.lit(" was used")).alias("evidence"),
    )
    return B.bind_by_name(extractions, materials).select("doi", "status", "material_index", "reason")


@query(
    "jon4_maskable_documents",
    """select d.doc_id, d.source, exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) as maskable from documents d""",
)
def jon4(t):
    records = t.documents.select(
        "doc_id", "source", F.lit("HER").alias("task_type"), text("doc_id").alias("doi")
    )
    index = t.labels.where("quality = 1").select(F.lit("HER").alias("task_type"), text("doc_id").alias("doi"))
    return B.maskable(records, index).select("doc_id", "source", "maskable")


@query(
    "jon9_doc_id_resolution",
    """select o_orderkey as id, coalesce(nullif(trim(case when p_size > 10 then p_name else ' ' end), ''),
        nullif(trim(case when o_orderstatus = 'F' then 'own-' || o_orderkey end), ''), o_orderpriority) as doc_id
    from orders left join part on o_custkey = p_partkey""",
)
def jon9(t):
    mapping = t.part.select(
        F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" ").alias("doc_id")
    )
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("k"),
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("own-"), text("o_orderkey"))).alias("own"),
        "o_orderpriority",
    )
    return J.resolve_doc_id(rows, mapping, ["k"], ["own", "o_orderpriority"]).select("id", "doc_id")


@query(
    "src4_selective_lookup",
    """with w as (select distinct l_partkey * 2 as id from lineitem where l_quantity > 48)
    select w.id, case when p_name like '%ring%' then null else p_name end as doi from w left join part on p_partkey = w.id""",
)
def src4(t):
    wanted = t.lineitem.where("l_quantity > 48").select((F.col("l_partkey") * 2).alias("id"))
    table = t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_name").contains("ring"), " ").otherwise(F.col("p_name")).alias("doi")
    )
    return J.selective_lookup(table, wanted, "id", "doi")


@query(
    "jon11_set_similarity",
    """with a as (select distinct list_sort(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)])) as s from part where p_size <= 25),
      b as (select distinct list_sort(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type)])) as s from part where p_size > 25)
    select array_to_string(a.s, ',') as left_set, array_to_string(b.s, ',') as right_set,
      round(len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) as similarity
    from a, b where len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) >= 0.4""",
)
def jon11(t):
    parts = t.part.select(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))).alias("components"), "p_size")
    pairs = J.similar_sets(parts.where("p_size <= 25"), parts.where("p_size > 25"), 0.4)
    return pairs.withColumn("similarity", F.round("similarity", 6))


def _bands_sql() -> str:
    rows = []
    for sign, table in ((-1, K.LOWER_IS_BETTER), (1, K.HIGHER_IS_BETTER)):
        rows += [f"('{task}', {sign}, {list(b)})" for task, b in table.items()]
    return ", ".join(rows)


@query(
    "jon12_grade_bands",
    f"""with b(task, sg, th) as (values {_bands_sql()}), v as (select {sql_pick(K.TASKS, 'o_orderkey')} as task_type, (o_custkey % 480)::double as value from orders),
      g as (select v.*, case when sg * value >= sg * th[1] then 4 when sg * value >= sg * th[2] then 3 when sg * value >= sg * th[3] then 2
        when sg * value >= sg * th[4] then 1 else 0 end as r from v join b on v.task_type = b.task
        union all select v.*, case when (case when value between 0 and 1 then value * 100 else value end) >= 95 then 4 when value >= 90 then 3
          when value >= 80 then 2 when value >= 75 then 1 else 0 end from v where task_type = 'CO2RR')
    select task_type, value, r as grade_rank, ({sql_list(tuple(reversed(K.GRADES)))})[r + 1] as grade, count(*) as n from g group by all""",
)
def jon12(t):
    v = t.orders.select(pick(K.TASKS, "o_orderkey").alias("task_type"), F.pmod("o_custkey", F.lit(480)).cast("double").alias("value"))
    graded = J.grade_values(v, "task_type", "value")
    return graded.groupBy("task_type", "value", "grade_rank", "grade").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jon13_keyed_upsert",
    """with cur as (select c_custkey as id, c_name as name, c_mktsegment as seg from customer),
      cu as (select s_suppkey * 20 as id, s_name as name, case when s_acctbal > 0 then 'curated' end as seg from supplier)
    select coalesce(cur.id, cu.id) as id, coalesce(cu.name, cur.name) as name, coalesce(cu.seg, cur.seg) as seg,
      case when cur.id is not null and cu.id is not null then 'updated' when cu.id is not null then 'created' else 'kept' end as _change
    from cur full join cu on cur.id = cu.id""",
)
def jon13(t):
    current = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    curated = t.supplier.select(
        (F.col("s_suppkey") * 20).alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") > 0, "curated").alias("seg"),
    )
    return J.upsert(current, curated, "id", ["name", "seg"])


@query(
    "jon14_positional_patch",
    """with r as (select l_returnflag as f, l_orderkey * 10 + l_linenumber as i, min(l_quantity)::varchar as fe, '' as u from lineitem group by all),
      p as (select case when o_orderstatus = 'F' then 'A' when o_orderstatus = 'O' then 'R' else 'zz' end as f, o_orderkey * 10 + 1 as i,
        case when o_custkey % 5 = 0 then ' ' else o_custkey::varchar end as fe, case when o_custkey % 2 = 0 then 'pct' else '' end as u from orders)
    select r.f, r.i, case when p.i is not null then p.fe else r.fe end as fe,
      case when p.i is not null then coalesce(nullif(trim(p.u), ''), '%') else r.u end as u, p.i is not null as _patched
    from r left join p on r.f = p.f and r.i = p.i and trim(p.fe) <> ''""",
)
def jon14(t):
    rows = t.lineitem.groupBy(
        F.col("l_returnflag").alias("f"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i")
    ).agg(text(F.min("l_quantity")).alias("fe"), F.lit("").alias("u"))
    patch = t.orders.select(
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "R").otherwise("zz").alias("f"),
        (F.col("o_orderkey") * 10 + 1).alias("i"),
        F.when(F.pmod("o_custkey", F.lit(5)) == 0, " ").otherwise(text("o_custkey")).alias("fe"),
        F.when(F.pmod("o_custkey", F.lit(2)) == 0, "pct").otherwise("").alias("u"),
        F.col("o_orderkey").alias("line"),
    )
    return J.positional_patch(rows, patch, "f", "i", {"fe": F.lit(""), "u": F.lit("%")}).select("f", "i", "fe", "u", "_patched")


@query(
    "jon16_resume_anti_join",
    "select doc_id, source, lang from documents where doc_id not in (select doc_id from labels)",
)
def jon16(t):
    return J.resume(t.documents.select("doc_id", "source", "lang"), t.labels, "doc_id")


@query(
    "jon17_cited_evidence",
    """with c as (select o_orderkey as id, o_custkey as c from orders),
      l as (select distinct l_orderkey as id, l_linenumber as n from lineitem)
    select id, (case when c % 7 = 0 then 0 else 3 end)::bigint as n_cited,
      (case when c % 7 = 0 then 0 else (case when c % 4 = 0 then 1 else 0 end) + (case when exists (select 1 from l where l.id = c.id and l.n = 1) then 1 else 0 end)
        + (case when exists (select 1 from l where l.id = c.id and l.n = 5) then 1 else 0 end) end)::bigint as n_valid,
      c % 7 = 0 or c % 4 = 0 or exists (select 1 from l where l.id = c.id and l.n in (1, 5)) as valid from c""",
)
def jon17(t):
    doc = F.concat(F.lit("10.1000/X"), text("o_orderkey"))
    wrapped = citation_id(F.lit("c"), F.concat(F.lit("**"), doc, F.lit("**")), F.lit(1))
    trailing = F.concat(citation_id(F.lit("c"), doc, F.lit(5)), F.lit(")."))
    third = F.when(F.pmod("o_custkey", F.lit(4)) == 0, F.lit("llm")).otherwise(F.lit("see page 4"))
    cited = F.when(F.pmod("o_custkey", F.lit(7)) == 0, F.array().cast("array<string>")).otherwise(F.array(wrapped, trailing, third))
    claims = t.wide("orders").select(F.col("o_orderkey").alias("id"), cited.alias("cited"))
    got = t.wide("lineitem").select(
        F.col("l_orderkey").alias("id"),
        citation_id(F.lit("c"), F.concat(F.lit("10.1000/x"), text("l_orderkey")), F.col("l_linenumber")).alias("source_id"),
    )
    return J.verify_citations(claims, got, "id").select("id", "n_cited", "n_valid", "valid")


@query(
    "jon18_chunk_lookup",
    """with ch as (select 'doc-' || l_orderkey as doc_id, l_linenumber as chunk_index, l_returnflag as task, max(l_quantity) as q from lineitem group by all),
      w as (select 'doc-' || o_orderkey as doc_id, (o_custkey % 7) + 1 as chunk_index, case when o_orderstatus = 'F' then 'A' end as task from orders where o_orderstatus <> 'P')
    select w.doc_id, w.chunk_index::bigint as chunk_index, ch.task as chunk_task, q from w join ch using (doc_id, chunk_index) where w.task is null or w.task = ch.task""",
)
def jon18(t):
    chunks = t.lineitem.groupBy(
        F.concat(F.lit("doc-"), text("l_orderkey")).alias("doc_id"),
        F.col("l_linenumber").cast("bigint").alias("chunk_index"),
        F.col("l_returnflag").alias("task_type"),
    ).agg(F.max("l_quantity").alias("q"))
    collection = F.when(F.col("o_orderstatus") == "P", "other").otherwise("main")
    wanted = t.orders.select(
        citation_id(collection, F.concat(F.lit("DOC-"), text("o_orderkey")), F.pmod("o_custkey", F.lit(7)) + 1).alias("citation"),
        F.when(F.col("o_orderstatus") == "F", "A").alias("task_type"),
    )
    return J.chunk_lookup(chunks, wanted, "main").select("doc_id", "chunk_index", "chunk_task", "q")


@query(
    "jon10_title_lookup",
    """with i as (select p_brand as scope, p_name as key, min('10.9/' || p_partkey) as doi from part group by all),
      t as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_extendedprice as id, p_brand as scope, p_name,
        l_quantity as q from lineitem join part on l_partkey = p_partkey),
      v as (select id, scope, 0 as r, case when q > 25 then 'unknown ' || p_name else p_name end as key from t
        union all select id, scope, 1, p_name from t where q > 40)
    select t.id, (select arg_min(i.doi, v.r) from v join i using (scope, key) where v.id = t.id) as doi from t""".replace(
        "select t.id, (select arg_min(i.doi, v.r) from v join i using (scope, key) where v.id = t.id) as doi from t",
        "select t.id, h.doi from t left join (select v.id, arg_min(i.doi, v.r) as doi from v join i using (scope, key) group by 1) h on h.id = t.id",
    ),
)
def jon10(t):
    from siftlab.functions.documents import title_key, title_variants

    parts = t.part
    index = parts.select(
        F.col("p_brand").alias("scope"), title_key(F.concat(F.lit("**"), F.initcap("p_name"), F.lit("**"))).alias("key"),
        F.concat(F.lit("10.9/"), text("p_partkey")).alias("doi"),
    )
    joined = t.wide("lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    q = F.col("l_quantity")
    title = (
        F.when(q > 40, F.concat(F.col("p_name"), F.lit(": a study")))
        .when(q > 25, F.concat(F.lit("unknown "), F.col("p_name")))
        .otherwise(F.concat(F.lit("<b>"), F.upper("p_name"), F.lit("</b>")))
    )
    titles = joined.select(
        F.concat_ws("-", *[text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]).alias("id"),
        F.col("p_brand").alias("scope"),
        F.transform(title_variants(title), title_key).alias("keys"),
    )
    return J.title_lookup(titles, index, "id")
