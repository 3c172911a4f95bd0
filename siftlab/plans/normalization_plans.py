"""Queries on normalisation and extraction. Messy text is built from table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.functions import cards as CA, chemistry as CH, claims as CL, documents as D, fixed as K, ids, names, numbers as N
from siftlab.functions import answers as A, tasks as TK, text as TX, units as U
from siftlab.operators import notes as NT, records as RC
from siftlab.plans.common import pick, sql_list, sql_pick, text
from siftlab.plans.registry import query

_Q = "l_quantity::int"


def _key(*cols):
    return F.concat_ws("-", *[text(c) for c in cols])


_LI_ID = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"


def _li_id():
    return _key("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id")


@query(
    "nrm1_doi_canonicalisation",
    """with d as (select doc_id, doc_id % 7 as k, '10.' || (1000 + doc_id) || '/abc.' || source as c from documents)
    select doc_id, case k when 4 then c || '?x=1' when 5 then c || ')' when 6 then '[' || c || ']' else c end as joined,
      case k when 6 then c || ']' else c end as document, case k when 0 then 'https://doi.org/' || c when 1 then 'doi: ' || c when 4 then c || '?x=1' else c end as source from d""".replace(
        "case k when 6 then c || ']' else c end as document", "c as document"
    ),
)
def nrm1(t):
    k = F.pmod("doc_id", F.lit(7))
    c = F.concat(F.lit("10."), text(F.col("doc_id") + 1000), F.lit("/ABC."), F.col("source"))
    raw = (
        F.when(k == 0, F.concat(F.lit("https://doi.org/"), c))
        .when(k == 1, F.concat(F.lit("DOI: "), c))
        .when(k == 2, F.concat(F.lit(" **"), c, F.lit("** ")))
        .when(k == 3, F.concat(F.lit("`"), c, F.lit("`.,")))
        .when(k == 4, F.concat(c, F.lit("?x=1")))
        .when(k == 5, F.concat(c, F.lit(")")))
        .otherwise(F.concat(F.lit("["), c, F.lit("]")))
    )
    # The backtick case keeps its closing mark in the join profile, which strips marks before dots.
    raw = F.when(k == 3, F.concat(c, F.lit(".,;"))).otherwise(raw)
    rows = t.wide("documents").select("doc_id", raw.alias("raw"))
    return rows.select(
        "doc_id",
        ids.canonical_doi("raw", "join").alias("joined"),
        ids.canonical_doi("raw", "document").alias("document"),
        ids.canonical_doi("raw", "source").alias("source"),
    )


@query(
    "nrm2_entity_name_key",
    """select p_partkey, coalesce(nullif(case p_size % 4 when 0 then '' else regexp_replace(p_name, '[^0-9a-z]', '', 'g') || p_partkey || 'α' end, ''), '<missing-material-' || p_partkey || '>') as key from part""",
)
def nrm2(t):
    name = F.when(F.pmod("p_size", F.lit(4)) == 0, " -/ ").otherwise(
        F.concat(F.upper("p_name"), F.lit(" ‐("), text("p_partkey"), F.lit(")·Α"))
    )
    return t.wide("part").select("p_partkey", names.identity_key(name, F.col("p_partkey")).alias("key"))


@query(
    "nrm2_folded_entity_names",
    """select p_partkey, regexp_replace(lower(p_name), '[^0-9a-z]', '', 'g') || 'fi' || p_partkey || 'ss' as key from part""",
)
def nrm2_folded(t):
    # The name in full-width letters, a ligature, circled or superscript digits, accents as marks in both orders.
    plain = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    wide = F.translate("p_name", plain, "".join(chr(ord(ch) + 0xFEE0) for ch in plain))
    digits = F.when(F.col("p_size") % 2 == 0, F.translate(text("p_partkey"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")).otherwise(
        F.translate(text("p_partkey"), "0123456789", "⓪①②③④⑤⑥⑦⑧⑨")
    )
    marks = F.when(F.col("p_size") % 3 == 0, "e\u0323\u0302").otherwise("e\u0302\u0323")
    name = F.concat(wide, F.lit(" ﬁ-"), digits, F.lit("ß"), marks, F.lit("가"))
    return t.wide("part").select("p_partkey", names.name_key(name).alias("key"))


_VAL_SQL = f"""v as (select {_LI_ID} as id, l_partkey % 8 as k, {sql_pick(K.TASKS, 'l_orderkey')} as task_type, {_Q} as q, l_quantity, l_linenumber from lineitem)"""
_COMP = ("", ">=", "<", "~", "≈", "≤ ", "", ">")


def _value_text():
    k = F.pmod("l_partkey", F.lit(8))
    q = text(F.col("l_quantity").cast("int"))
    unit = pick(("K", "S/m", "mA cm-2", "%", "emu / g", "W m-1 K-1", ""), "l_suppkey")
    body = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.concat(pick(_COMP, "l_partkey"), q, F.lit(".50 "), unit))
    return F.concat(F.lit(" "), body), k


@query(
    "nrm3_number_and_comparator",
    f"""with v as (select {_LI_ID} as id, case when l_linenumber = 7 then null else {_Q} + 0.5 end::double as value,
      case when l_linenumber = 7 then null else trim(({sql_list(_COMP)})[1 + l_partkey % 8]) end as comparator from lineitem) select * from v""",
)
def nrm3(t):
    body, _ = _value_text()
    s = t.wide("lineitem").select(_li_id(), N.numeric_struct(body).alias("s"))
    return s.select("id", "s.value", "s.comparator")


@query(
    "nrm4_unit_contract",
    f"""with v as (select {sql_pick(K.TASKS, 'l_orderkey')} as task, case when l_linenumber = 7 then '' else (['K', 'S/m', 'mA cm-2', '%', 'emu / g', 'W m-1 K-1', ''])[1 + l_suppkey % 7] end as unit from lineitem),
      c as (select *, lower(replace(unit, ' ', '')) as u from v)
    select task as task_type, unit, case when task = 'HOR' then case when u = 'macm-2' then 'canonical' else 'noncanonical_or_relative' end
      when task in ({sql_list(K.TRUTH_UNITS)[1:-1]}) then case when (task = 'antiferromagnetism' and u = 'k') or (task = 'conductivity' and u = 's/m')
        or (task in ('ferrimagnetism', 'ferromagnetism') and u = 'emu/g') or (task = 'photothermal_conversion_efficiency' and u = '%')
        or (task = 'thermal_conductivity' and u = 'wm-1k-1') then 'canonical' else 'noncanonical_or_missing' end
      when u <> '' then 'declared' else 'missing' end as contract, count(*) as n from c group by all""",
)
def nrm4(t):
    body, _ = _value_text()
    metric = F.when(F.col("task_type") == "HOR", "exchange_current_density").otherwise("m")
    rows = t.wide("lineitem").select(pick(K.TASKS, "l_orderkey").alias("task_type"), body.alias("v"))
    out = rows.select("task_type", N.unit_suffix("v").alias("unit"), N.truth_unit_contract("task_type", metric, "v").alias("contract"))
    return out.groupBy("task_type", "unit", "contract").agg(F.count(F.lit(1)).alias("n"))


_RAWKEYS = ("overpotential", "potential", "Faradaic_efficiency", "half_wave_potential", "overpotential–10", "mass_activity")


@query(
    "nrm5_metric_key_canonicalisation",
    f"""with k as (select {sql_pick(_RAWKEYS, 'l_partkey')} as key, {sql_pick(K.REACTION_TASKS, 'l_suppkey')} as r from lineitem)
    select key, r as reaction, case when r = 'O5H' and key = 'Faradaic_efficiency' then 'faradaic_efficiency' when r = 'UOR' and key in ('overpotential', 'potential') then 'potential_10mAcm-2'
      when r in ('HER', 'OER', 'HZOR') and key = 'overpotential' then 'overpotential_10mAcm-2' else replace(key, '–', '-') end as canonical, count(*) as n from k group by all""",
)
def nrm5(t):
    rows = t.lineitem.select(pick(_RAWKEYS, "l_partkey").alias("key"), pick(K.REACTION_TASKS, "l_suppkey").alias("reaction"))
    out = rows.withColumn("canonical", U.metric_key("key", "reaction"))
    return out.groupBy("key", "reaction", "canonical").agg(F.count(F.lit(1)).alias("n"))


_UNITS6 = (" mV", " V", "%", " A cm-2", " mA cm^-2", " furlong", "", " mA mg-1")
_KEYS6 = ("overpotential_10mAcm-2", "half_wave_potential", "exchange_current_density", "partial_current_density", "mass_activity", "faradaic_efficiency")


@query(
    "nrm6_metric_unit_normalisation",
    f"""with v as (select {_Q} as q, {sql_pick(_UNITS6, 'l_partkey')} as u, {sql_pick(_KEYS6, 'l_suppkey')} as k from lineitem),
      c as (select q, u, k, case when u = '%' then q / 100 when contains(k, 'overpotential') then case when u = ' V' then q * 1000 else q end
          when contains(k, 'potential') then case when u = ' mV' then q / 1000 else q end
          when k = 'partial_current_density' and u = '' then q when k in ('exchange_current_density', 'partial_current_density') then case when u = ' A cm-2' then q * 1000 when u = ' mA cm^-2' then q end
          when k = 'mass_activity' and u in (' mA cm^-2', ' mA mg-1') then q / 1000 else q end as number,
        case when u = '%' then 'fraction_0_to_1' when contains(k, 'overpotential') then 'mV' when contains(k, 'potential') then 'V'
          when k in ('exchange_current_density', 'partial_current_density') then 'mA cm-2' when k = 'mass_activity' and u = ' mA mg-1' then 'A mg-1' when k = 'mass_activity' and u = ' mA cm^-2' then 'A cm^-2'
          else nullif(trim(u), '') end as unit from v)
    select q, u, k, round(number, 6)::double as number, case when number is not null then unit end as unit, count(*) as n from c group by all""",
)
def nrm6(t):
    rows = t.wide("lineitem").select(
        F.col("l_quantity").cast("int").alias("q"), pick(_UNITS6, "l_partkey").alias("u"), pick(_KEYS6, "l_suppkey").alias("k")
    )
    out = rows.withColumn("m", U.normalize_metric(F.concat(text("q"), F.col("u")), "k"))
    flat = out.select("q", "u", "k", F.col("m.number").cast("double").alias("number"), F.col("m.unit").alias("unit"))
    return flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("n"))


_REACT7 = ("her", "UOR", "CO2-RR", "magic", "O5H")


def _raw_records(t):
    q = text(F.col("l_quantity").cast("int"))
    none = F.lit(None).cast("string")
    metrics = F.map_from_arrays(
        F.array(*[F.lit(k) for k in ("pos", "overpotential", "potential", "Faradaic_efficiency", "note")]),
        F.array(
            F.lit("1"),
            F.when(F.col("l_tax") > 0.03, F.concat(q, F.lit(" mV"))).otherwise(none),
            F.when(F.col("l_discount") > 0.05, F.concat(q, F.lit(" V"))).otherwise(F.lit("none given")),
            F.concat(q, F.lit("%")),
            none,
        ),
    )
    return t.wide("lineitem").select(
        _li_id(),
        F.col("l_returnflag").alias("source"),
        pick(_REACT7, "l_partkey").alias("reaction_type"),
        F.when(F.col("l_linenumber") == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("pt"), F.lit("NI"), F.lit("pt"))).alias("metals"),
        F.when(F.col("l_suppkey") > 50, "x").alias("material_name"),
        metrics.alias("metrics"),
    )


_REC_SQL = f"""r as (select {_LI_ID} as id, l_returnflag as source, (['HER', 'UOR', 'CO2RR', null, 'O5H'])[1 + l_partkey % 5] as rt, l_linenumber = 1 and l_suppkey <= 50 as nameless,
    l_tax > 0.03 as ov, l_discount > 0.05 as po, {_Q} as q from lineitem),
  m as (select *, rt is null as unk, case rt when 'HER' then ov when 'UOR' then ov or po when 'CO2RR' then false when 'O5H' then true else false end as has from r)"""


@query(
    "nrm7_record_cleaning",
    f"""with {_REC_SQL} select id, coalesce(rt, 'magic') as reaction_type, case when unk then 'unknown_reaction_type' when nameless then 'missing_material_identity' when not has then 'no_metrics_after_cleaning' end as drop_reason,
      case when unk or nameless or not has then null when rt = 'HER' then q || ' mV' when rt = 'UOR' then case when po then q || ' V' else replace((q / 1000)::varchar, '.0', '.0') || ' V' end
        else null end as shown from m""".replace("replace((q / 1000)::varchar, '.0', '.0')", "(q / 1000)::varchar"),
)
def nrm7(t):
    c = RC.clean_records(_raw_records(t))
    shown = F.when(
        F.col("drop_reason").isNull() & F.col("reaction_type").isin("HER", "UOR"), F.try_element_at(F.map_values("metrics_gt"), F.lit(1))
    )
    return c.select("id", "reaction_type", "drop_reason", shown.alias("shown"))


@query(
    "nrm7_drop_accounting",
    f"""with {_REC_SQL}, rec as (select source, 'record' as kind, case when unk then 'unknown_reaction_type' when nameless then 'missing_material_identity' when not has then 'no_metrics_after_cleaning' else 'kept' end as reason from m),
      met as (select source, 'metric' as kind, unnest((case when rt in ('HER', 'UOR') then (case when not ov then ['null_value'] else [] end) || (case when rt = 'HER' then ['metric_not_in_scope'] when not po then ['unparseable_value'] when ov and po then ['duplicate_metric_prefer_potential'] else [] end) || ['metric_not_in_scope']
          when rt = 'O5H' then (case when not ov then ['null_value'] else ['metric_not_in_scope'] end) || ['metric_not_in_scope']
          else (case when not ov then ['null_value'] else ['metric_not_in_scope'] end) || ['metric_not_in_scope', 'metric_not_in_scope'] end) || ['null_value']) as reason from m where not unk and not nameless)
    select source, kind, reason, count(*) as n from (select * from rec union all select * from met) group by all""",
)
def nrm7_counts(t):
    return RC.drop_accounting(RC.clean_records(_raw_records(t)))


@query(
    "nrm8_product_truth",
    """with o as (select o_orderkey as id, o_custkey % 90 + 1 as a, o_orderkey % 90 + 1 as b, o_custkey % 4 as k from orders),
      p as (select *, a >= b as first, case when a >= b then (case when k = 3 then 'H2' else 'CO' end) else 'HCOOH' end as prod, greatest(a, b) as fe from o)
    select id, prod as product, round(fe / 100, 6)::double as fe, case when k = 0 and prod = 'CO' then 'reported_partial' else 'computed_total_times_fe' end as partial_source,
      round(case when k = 0 and prod = 'CO' then -12.5 else 200 * fe / 100 end, 6)::double as partial, case when prod = 'H2' then 'co2rr_unwanted_truth_product' end as drop_reason from p""",
)
def nrm8(t):
    a, b, k = F.pmod("o_custkey", F.lit(90)) + 1, F.pmod("o_orderkey", F.lit(90)) + 1, F.pmod("o_custkey", F.lit(4))
    item = lambda kind, product, value: F.struct(F.lit(kind).alias("type"), F.lit(product).alias("product"), value.alias("value"))
    current = F.when(
        k == 0,
        F.array(item("partial", "co", F.lit("~-12.5 mA·cm−2")), item("partial", "CO", F.lit("2 mA/cm2")), item("total", "", F.lit("0.2 A cm-2"))),
    ).otherwise(F.array(item("total", "other", F.lit("200 mA cm^-2")), item("total", "", F.lit("broken"))))
    rows = t.wide("orders").select(
        F.col("o_orderkey").alias("id"),
        F.array(F.when(k == 3, "H2").otherwise(" carbon  monoxide"), F.lit("formate"), F.lit("CH4")).alias("product"),
        F.array(F.concat(text(a), F.lit(" %")), F.concat(F.lit("≈"), text(b), F.lit("%")), F.lit("trace")).alias("faradaic_efficiency"),
        current.alias("current_density"),
    )
    out = RC.product_truth(rows)
    return out.select(
        "id", "product", F.col("faradaic_efficiency").cast("double").alias("fe"), "partial_source",
        F.round(F.col("partial_current_density").cast("double"), 6).alias("partial"), "drop_reason",
    )


_UNITS9 = ("", " %", " mS/cm", " S m-1", " W m-1 K-1", " A m2/kg", " K", " μg/mL", " S/cm")


def _property_sql(expr: str) -> str:
    return f"""with v as (select {_Q} as q, {sql_pick(_UNITS9, 'l_partkey')} as u, {sql_pick(K.MATERIAL_TASKS, 'l_suppkey')} as p from lineitem),
      c as (select q, u, p, {expr} as value from v) select q, u, p, round(value, 6)::double as value, count(*) as n from c group by all"""


@query(
    "nrm9_property_value_normalisation",
    _property_sql(
        """case when p in ('photothermal_conversion_efficiency', 'photocatalytic_h2o2', 'furfural_hydrogenation') then case when u <> ' %' and q <= 1 then q * 100 else q end
          when p = 'conductivity' then case u when ' mS/cm' then q * 0.1 when ' S m-1' then q when ' S/cm' then q * 100 end
          when p = 'thermal_conductivity' then case when u = ' W m-1 K-1' then q end when p in ('ferromagnetism', 'ferrimagnetism') then case when u = ' A m2/kg' then q end
          when p = 'antiferromagnetism' then case when u in (' K', ' W m-1 K-1') then q end when p = 'antibacterial' then case when u = ' μg/mL' then q end
          when p = 'thermoelectric' then case when u = '' then q end end"""
    ),
)
def nrm9(t):
    rows = t.wide("lineitem").select(
        F.col("l_quantity").cast("int").alias("q"), pick(_UNITS9, "l_partkey").alias("u"), pick(K.MATERIAL_TASKS, "l_suppkey").alias("p")
    )
    out = rows.withColumn("value", F.round(U.property_value("p", F.concat(text("q"), F.col("u"))), 6))
    return out.groupBy("q", "u", "p", "value").agg(F.count(F.lit(1)).alias("n"))


_UNITS10 = ("", " %", " percent", " mS / cm", " S m^−1", " W/(m K)", " emu g-1", " Kelvin", " K at 3 T")


@query(
    "nrm10_strict_extraction_validation",
    f"""with v as (select {_Q} as q, {sql_pick(_UNITS10, 'l_partkey')} as u, {sql_pick(tuple(K.EXTRACTION_SCHEMAS), 'l_suppkey')} as p from lineitem)
    select q, u, p, case p when 'photothermal_conversion_efficiency' then case when u in ('', ' %', ' percent') then q || '.25 %' end
      when 'conductivity' then case u when ' mS / cm' then q || '.25 mS/cm' when ' S m^−1' then q || '.25 S m-1' end
      when 'thermal_conductivity' then case when u = ' W/(m K)' then q || '.25 W m-1 K-1' end
      when 'antiferromagnetism' then case when u in ('', ' Kelvin') then q || '.25 K' end
      else case when u in ('', ' emu g-1') then q || '.25 emu/g' end end as value, count(*) as n from v group by all""",
)
def nrm10(t):
    rows = t.wide("lineitem").select(
        F.col("l_quantity").cast("int").alias("q"), pick(_UNITS10, "l_partkey").alias("u"), pick(tuple(K.EXTRACTION_SCHEMAS), "l_suppkey").alias("p")
    )
    out = rows.withColumn("value", U.strict_property_text("p", F.concat(text("q"), F.lit(".250"), F.col("u"))))
    return out.groupBy("q", "u", "p", "value").agg(F.count(F.lit(1)).alias("n"))


_ALIASES = tuple(K.TASK_ALIASES) + K.TASKS + ("no such task",)
_ALIAS_OUT = tuple(K.TASK_ALIASES.values()) + K.TASKS + ("?",)


@query(
    "nrm11_task_alias_canonicalisation",
    f"""with a as (select l_partkey % {len(_ALIASES)} as i, l_linenumber % 3 as d from lineitem)
    select i, d, nullif(({sql_list(_ALIAS_OUT)})[1 + i], '?') as task, count(*) as n from a group by all""",
)
def nrm11(t):
    raw = pick(_ALIASES, "l_partkey")
    d = F.pmod("l_linenumber", F.lit(3))
    shown = F.when(d == 0, raw).when(d == 1, F.concat(F.lit("  "), F.initcap(F.replace(raw, F.lit(" "), F.lit("_"))), F.lit(" "))).otherwise(
        F.upper(F.replace(raw, F.lit(" "), F.lit("  ")))
    )
    rows = t.wide("lineitem").select(F.pmod("l_partkey", F.lit(len(_ALIASES))).alias("i"), d.cast("int").alias("d"), TK.canonical_task(shown).alias("task"))
    return rows.groupBy("i", "d", "task").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nrm12_composition_parsing",
    """select p_partkey, case p_size % 3 when 0 then 'Co,Ni' when 1 then 'Cu,Pt' else 'Co,Fe,Ni' end as metals,
      case p_size % 3 when 0 then 'Co=' || p_size::double || ',Ni=23.0' when 1 then '' else 'Co=' || (p_size + 0.5)::double end as shares from part""",
)
def nrm12(t):
    s = F.pmod("p_size", F.lit(3))
    raw = (
        F.when(s == 0, F.concat(F.lit("co("), text("p_size"), F.lit("%), Ni(23%)")))
        .when(s == 1, F.lit("pt + CU;pt"))
        .otherwise(F.concat(F.lit("CoNi 7%/Fe；Co("), text("p_size"), F.lit(".5 %)")))
    )
    c = t.part.select("p_partkey", CH.parse_composition(raw).alias("c"))
    shares = F.array_join(
        F.transform(F.array_sort(F.filter(F.map_entries("c.percent"), lambda e: e["key"] != "")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","
    )
    return c.select("p_partkey", F.array_join("c.metals", ",").alias("metals"), shares.alias("shares"))


@query(
    "nrm13_exact_sum_percentages",
    """with w as (select o_orderkey as id, [o_custkey % 7, o_orderkey % 5, o_custkey % 3] as w from orders),
      s as (select id, unnest(case when list_sum(w) > 0 then w else [1, 1, 1] end) as w, unnest([0, 1, 2]) as pos, case when list_sum(w) > 0 then list_sum(w) else 3 end as t from w),
      f as (select id, pos, floor(w / t * 10000) as lo, w / t * 10000 - floor(w / t * 10000) as fr from s),
      r as (select *, 10000 - sum(lo) over (partition by id) as rest, row_number() over (partition by id order by fr desc, pos) as rk from f)
    select id, pos::int as pos, ((lo + case when rk <= rest then 1 else 0 end) / 100)::double as share from r""",
)
def nrm13(t):
    w = F.array(F.pmod("o_custkey", F.lit(7)), F.pmod("o_orderkey", F.lit(5)), F.pmod("o_custkey", F.lit(3)))
    shares = t.orders.select(F.col("o_orderkey").alias("id"), CH.exact_percentages(w).alias("s"))
    return shares.select("id", F.posexplode("s").alias("pos", "share"))


@query(
    "nrm14_element_inference",
    """select p_partkey, case p_size % 4 when 0 then 'C,Cu,Fe,N,Pt,W' when 1 then 'C,Ni' when 2 then 'C,Ag,Zn' else 'C' end as elements from part""".replace(
        "'C,Ag,Zn'", "'Ag,C,Zn'"
    ),
)
def nrm14(t):
    s = F.pmod("p_size", F.lit(4))
    name = F.when(s == 0, "Pt–Fe/MWNT on copper").when(s == 1, "NiO nanosheet").when(s == 2, "silver-zinc alloy; leading").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", F.array_join(CH.elements_of(name, F.array(F.lit(" C "), F.lit("Xx"))), ",").alias("elements"))


@query(
    "nrm15_value_unit_stitching",
    """select o_orderkey as id, case o_custkey % 4 when 0 then o_custkey || ' mV' when 1 then o_custkey || '%' when 2 then o_custkey || ' V' else o_custkey || '' end as stitched from orders""",
)
def nrm15(t):
    k, v = F.pmod("o_custkey", F.lit(4)), text("o_custkey")
    value = F.when(k == 2, F.concat(v, F.lit(" V"))).otherwise(F.concat(F.lit(" "), v))
    unit = F.when(k == 0, " mV ").when(k == 1, "％").when(k == 2, "mV").otherwise("")
    return t.orders.select(F.col("o_orderkey").alias("id"), N.stitch_value_unit(value, unit).alias("stitched"))


_LABELS = ("", "η10", "E1/2", "j_0", "Mass activity", "FE", "j-partial", "Potential", "whatever")


@query(
    "nrm16_metric_inference",
    f"""with v as (select {sql_pick(_LABELS, 'l_partkey')} as label, {sql_pick(K.REACTION_TASKS, 'l_suppkey')} as r from lineitem),
      o as (select *, case r when 'ORR' then 'half_wave_potential' when 'HOR' then 'exchange_current_density' when 'UOR' then 'potential_10mAcm-2' when 'EOR' then 'mass_activity'
        when 'O5H' then 'faradaic_efficiency' when 'CO2RR' then null else 'overpotential_10mAcm-2' end as only_one from v)
    select label, r as reaction, case label when '' then case when r = 'CO2RR' then 'partial_current_density' else only_one end when 'E1/2' then 'half_wave_potential'
      when 'j_0' then 'exchange_current_density' when 'Mass activity' then 'mass_activity' when 'FE' then 'faradaic_efficiency' when 'j-partial' then 'partial_current_density' else only_one end as metric, count(*) as n from o group by all""",
)
def nrm16(t):
    rows = t.lineitem.select(pick(_LABELS, "l_partkey").alias("label"), pick(K.REACTION_TASKS, "l_suppkey").alias("reaction"))
    out = rows.withColumn("metric", RC.infer_metric("reaction", "label"))
    return out.groupBy("label", "reaction", "metric").agg(F.count(F.lit(1)).alias("n"))


def _material_json():
    return F.to_json(
        F.struct(
            F.when(F.pmod("p_size", F.lit(3)) == 0, "0").otherwise(text("p_size")).alias("material_serial_no"),
            F.concat(F.lit(" "), F.col("p_name")).alias("material_name"),
            F.when(F.pmod("p_partkey", F.lit(2)) == 0, " ").otherwise(F.col("p_type")).alias("major_category"),
            F.array(F.col("p_brand"), F.lit(" "), F.lit(None).cast("string")).alias("components"),
            F.struct(F.lit("").alias("a")).alias("feed_ratio"),
            F.lit("Pt、Ni, ").alias("elements"),
            F.lit("x").alias("not_a_field"),
        )
    )


@query(
    "nrm17_sparse_material_cleaning",
    """select p_partkey, '{"components":"[\\"' || p_brand || '\\"]","elements":"[\\"Pt\\",\\"Ni\\"]",' || case when p_partkey % 2 = 0 then '' else '"major_category":"' || p_type || '",' end
      || '"material_name":"' || p_name || '"' || case when p_size % 3 = 0 then '' else ',"material_serial_no":"' || p_size || '"' end || '}' as material from part""",
)
def nrm17(t):
    return t.part.select("p_partkey", RC.clean_material(_material_json()).alias("material"))


@query(
    "nrm18_template_text",
    """select p_partkey, '材料是' || p_name || '。' || case when p_partkey % 2 = 0 then '' else '材料类别是' || p_type || '。' end || '材料组分包括：' || p_brand || '。含有元素：Pt、Ni。' as description from part""",
)
def nrm18(t):
    return t.part.select("p_partkey", RC.material_text(RC.clean_material(_material_json())).alias("description"))


@query(
    "nrm19_stable_sample_id",
    f"""select {_LI_ID} as id, 'mp19_' || substr(sha256('{{"context_key":"' || l_returnflag || '","doi":"10.1/' || l_orderkey || '","label_key":"' || l_linestatus || '","material_identity":"m' || l_linenumber || '","task_type":"' || {sql_pick(K.TASKS, 'l_orderkey')} || '"}}'), 1, 20) as sample_id from lineitem""",
)
def nrm19(t):
    sid = ids.sample_id(
        pick(K.TASKS, "l_orderkey"), F.concat(F.lit("10.1/"), text("l_orderkey")), F.concat(F.lit("m"), text("l_linenumber")),
        F.col("l_returnflag"), F.col("l_linestatus"),
    )
    return t.lineitem.select(_li_id(), sid.alias("sample_id"))


@query(
    "nrm20_html_cleaning",
    r"""with u as (select page_id, html || ' café é α 5µm — é' as h from pages),
      e as (select page_id, replace(replace(replace(replace(replace(h, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '&amp', '&') as h from u),
      c as (select page_id, trim(regexp_replace(regexp_replace(h, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as body from e)
    select page_id, len(body)::int as n_chars, md5(body) as digest from c""",
)
def nrm20(t):
    # Named, numeric and hexadecimal references stand behind every page.
    body = D.clean_markup(F.concat("html", F.lit(" caf&eacute; &#233; &#x3b1; 5&micro;m &mdash; &#xE9;")))
    rows = t.pages.select("page_id", body.alias("body"))
    return rows.select("page_id", F.length("body").alias("n_chars"), F.md5("body").alias("digest"))


_REFS = ("", "\n## References\n[1] A, B, 2019.", "\nAcknowledgements\nthanks", "\n[1] A, B\n\n2. C, D\n3) E, F 2020, x", "\n[1] A\n[2] B")


@query(
    "nrm21_reference_removal",
    r"""with d as (select doc_id, doc_id % 5 as k, text as body from documents),
      b as (select doc_id, k, case k when 0 then body when 1 then body when 2 then body when 3 then body else body || chr(10) || '[1] A' || chr(10) || '[2] B' end as kept from d)
    select doc_id, k, md5(case when k = 3 then rtrim(kept, chr(10) || ' ') when k = 1 then kept || chr(10) when k = 2 then regexp_replace(kept || chr(10), '##?\s*$', '') else kept end) as digest from b""",
)
def nrm21(t):
    k = F.pmod("doc_id", F.lit(5))
    rows = t.wide("documents").select("doc_id", k.alias("k"), F.concat("text", pick(_REFS, "doc_id")).alias("text"))
    out = rows.select("doc_id", "k", F.when(F.col("text").isNotNull(), D.drop_references("text")).alias("kept"))
    # The heading cases leave the line break before the heading, unless hash marks end the line above it.
    return out.select("doc_id", "k", F.md5("kept").alias("digest"))


@query(
    "nrm22_document_id_extraction",
    """select doc_id, case doc_id % 6 when 0 then '10.1234/a.' || doc_id when 1 then '10.1234/b' || doc_id when 2 then '10.55555/(c)' || doc_id when 3 then null when 4 then '10.1234/far' || doc_id else null end as doi
    from documents""",
)
def nrm22(t):
    k, d = F.pmod("doc_id", F.lit(6)), text("doc_id")
    head = (
        F.when(k == 0, F.concat(F.lit("See [paper](https://doi.org/10.1234/A."), d, F.lit(").\n")))
        .when(k == 1, F.concat(F.lit("**DOI**: 10.1234/B"), d, F.lit("**.\n")))
        .when(k == 2, F.concat(F.lit("x 10.55555/(C)"), d, F.lit(";\n")))
        .otherwise("")
    )
    tail = (
        F.when(k == 4, F.concat(F.lit("\nhttp://dx.doi.org/10.1234/FAR"), d))
        .when(k == 5, F.concat(F.lit("\nReferences\nhttps://doi.org/10.1234/ref"), d))
        .otherwise("")
    )
    rows = t.wide("documents").select("doc_id", F.concat(head, F.col("text"), tail).alias("text"))
    return rows.select("doc_id", D.document_doi("text").alias("doi"))


@query(
    "nrm23_title_candidates",
    """select doc_id, case doc_id % 4 when 0 then 'Study of ' || source || ': part ' || lang when 1 then 'On ' || source when 2 then 'A bold enough title ' || source else 'Named ' || lang end as title,
      case doc_id % 4 when 0 then 'study of ' || source when 1 then 'on ' || source when 2 then 'a bold enough title ' || source else 'named ' || lang end as last_variant
    from documents""",
)
def nrm23(t):
    k = F.pmod("doc_id", F.lit(4))
    src, lang = F.col("source"), F.col("lang")
    head = (
        F.when(k == 0, F.concat(F.lit("# FULL PAPER\n## 1 | Intro\n# Study of "), src, F.lit(": part "), lang))
        .when(k == 1, F.concat(F.lit("ABSTRACT\n### *On "), src, F.lit("*\n")))
        .when(k == 2, F.concat(F.lit("**Short**\n**A bold enough title "), src, F.lit("**")))
        .otherwise(F.concat(F.lit("# Abstract\nTitle： `Named` "), lang))
    )
    rows = t.wide("documents").select("doc_id", D.title_candidates(F.concat(head, F.lit("\n"), F.col("text"))).alias("c"))
    first = F.try_element_at("c", F.lit(1))
    return rows.select("doc_id", first.alias("title"), D.title_key(F.try_element_at(D.title_variants(first), F.lit(-1))).alias("last_variant"))


@query(
    "nrm24_answer_object_extraction",
    """select conv_id, turn, case (conv_id + turn) % 5 when 0 then '{"v":' || turn || '}' when 1 then '{"v":' || turn || '}' when 2 then '{"v": ' || turn || '}' when 3 then '{"w": 1}' end as answer
    from conversations""",
)
def nrm24(t):
    k, v = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)), text("turn")
    body = F.col("text")
    quoted = F.translate(body, '"\\\n\t\r', "'")
    reply = (
        F.when(k == 0, F.concat(body, F.lit(' <answer> {"v":'), v, F.lit("} </answer>")))
        .when(k == 1, F.concat(F.lit(' {"think": "'), quoted, F.lit('", "answer": {"v":'), v, F.lit("}}")))
        .when(k == 2, F.concat(body, F.lit(' {bad {"v": '), v, F.lit("} {}")))
        .when(k == 3, F.concat(F.lit("<answer>none</answer>"), body, F.lit('{"w": 1}')))
        .otherwise(body)
    )
    rows = t.conversations.select("conv_id", "turn", reply.alias("reply"))
    return A.with_answer_object(rows, "reply").select("conv_id", "turn", "answer")


_CLAIM_TASKS = ("HER", "OER", "ORR", "UOR", "CO2RR", "conductivity", "antibacterial")


_CLAIM_VALUE = """case k when 0 then q * 10 when 1 then 5000 when 2 then ('0.' || (q + 10) || '5')::double when 3 then (1000 + q) / 1000 when 4 then case when q <= 1 then q * 100 else q end when 5 then q * 0.1 else q end"""


@query(
    "nrm26_claim_metric_extraction",
    f"""with c as (select {_LI_ID} as id, l_partkey % 7 as k, {_Q} as q from lineitem)
    select id, (['HER', 'OER', 'ORR', 'UOR', 'CO2RR', 'conductivity', 'antibacterial'])[1 + k] as task_type, round({_CLAIM_VALUE}, 6)::double as value,
      (['mV', 'mV', 'V', 'V', '%', 'S/m', 'ppm'])[1 + k] as unit, case when k = 4 then 'HCOOH' end as product from c""",
)
def nrm26(t):
    q = F.col("l_quantity").cast("int")
    line = pick(range(7), "l_partkey")
    body = (
        F.when(line == 0, F.concat(text(q * 10), F.lit(" ± 5 mV at 10 mA cm-2; 900 mV at 100 mA")))
        .when(line == 1, F.concat(F.lit("5 V; 0."), text(q + 10), F.lit(" V @ 10 mA")))
        .when(line == 2, F.concat(F.lit("onset 0.99 V, E1/2 = 0."), text(q + 10), F.lit("5 V")))
        .when(line == 3, F.concat(text(q + 1000), F.lit(" mV vs RHE")))
        .when(line == 4, F.concat(F.lit("FE(formate)="), text(q), F.lit("%; j = 2 mA cm−2")))
        .when(line == 5, F.concat(text(q), F.lit(" mS/cm conductivity")))
        .otherwise(F.concat(F.lit("MIC="), text(q), F.lit(" ug/mL")))
    )
    claim = F.concat(
        F.lit("Task Type: x\nPerformance Metrics: 1 V\nPerformance Metrics (final): "), body, F.lit("\nEvidence: llm")
    )
    rows = t.wide("lineitem").select(_li_id(), pick(_CLAIM_TASKS, "l_partkey").alias("task_type"), claim.alias("claim"))
    out = rows.withColumn("m", CL.claim_metric("task_type", CL.metric_line("claim")))
    product = F.when(F.col("task_type") == "CO2RR", CL.claim_product("claim", CL.metric_line("claim")))
    return out.select("id", "task_type", F.round("m.value", 6).alias("value"), F.col("m.unit").alias("unit"), product.alias("product"))


@query(
    "nrm27_range_to_single_point",
    f"""with c as (select l_partkey % 4 as k, {sql_pick(('HER', 'ORR', 'conductivity'), 'l_suppkey')} as t, {_Q} as a, l_linenumber as b from lineitem)
    select k, t as task_type, a, b, case k when 0 then case t when 'HER' then (a + b)::varchar when 'ORR' then a::varchar else case when b % 2 = 0 then (a + b // 2)::varchar else case when (a + b // 2) % 2 = 0 then (a + b // 2)::varchar else (a + b // 2 + 1)::varchar end end end || ' mV'
      when 1 then case t when 'HER' then a + b when 'ORR' then a - b else a end || ' mV' when 2 then 'at ' || case t when 'HER' then a || '.5' when 'ORR' then a || '.0' else a || '.2' end || ' V' else a || ' mV' end as shown, count(*) as n from c group by all""",
)
def nrm27(t):
    k, a, b = F.pmod("l_partkey", F.lit(4)), F.col("l_quantity").cast("int"), F.col("l_linenumber")
    metric = (
        F.when(k == 0, F.concat(text(a), F.lit(" to "), text(a + b), F.lit(" mV")))
        .when(k == 1, F.concat(text(a), F.lit(" +/- "), text(b), F.lit(" mV")))
        .when(k == 2, F.concat(F.lit("at "), text(a), F.lit(".0–"), text(a), F.lit(".5 V")))
        .otherwise(F.concat(text(a), F.lit(" mV")))
    )
    rows = t.wide("lineitem").select(k.alias("k"), pick(("HER", "ORR", "conductivity"), "l_suppkey").alias("task_type"), a.alias("a"), b.alias("b"), metric.alias("m"))
    out = rows.withColumn("shown", CL.single_point("m", "task_type"))
    return out.groupBy("k", "task_type", "a", "b", "shown").agg(F.count(F.lit(1)).alias("n"))


def _card():
    kind = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "CaseCard").otherwise("materialcard")
    return F.concat(
        F.lit(" "), kind, F.lit(" | task="), pick(K.TASKS, "p_partkey"), F.lit("; MATERIAL="), F.col("p_name"), F.lit(" ; ELEMENTS=Pt, "),
        F.col("p_brand"), F.lit("；; ANCHOR=a=b; FOO=x; CONTEXT= ; novalue; MATERIAL="), F.upper("p_name"),
    )


@query(
    "nrm28_card_parsing",
    f"""select p_partkey, case when p_partkey % 3 = 0 then 'case' else 'material_card' end as kind, {sql_pick(K.TASKS, 'p_partkey')} as task_type,
      case when p_partkey % 19 < 9 then 'reaction' else 'material_property' end as task_family, upper(p_name) as material_name, 'Pt,' || p_brand as components, 'a=b' as anchor, '' as context from part""",
)
def nrm28(t):
    c = t.part.select("p_partkey", CA.parse_card(_card()).alias("c"))
    return c.select(
        "p_partkey", "c.kind", "c.task_type", "c.task_family", "c.material_name", F.array_join("c.components", ",").alias("components"),
        "c.anchor", F.coalesce("c.context", F.lit("")).alias("context"),
    )


@query(
    "nrm29_guideline_blocks",
    r"""with d as (select doc_id, unnest([0, 1]) as pos from documents)
    select d.doc_id, 'G' || case when pos = 0 then doc_id % 50 else 7 end as id, md5(case when pos = 0 then 'First ' || source || ' goes on' else trim(regexp_replace('Then ' || replace(text, '[', '('), '\s+', ' ', 'g')) end) as digest
    from d join documents using (doc_id)""",
)
def nrm29(t):
    body = F.concat(
        F.lit("intro\n[G"), text(F.pmod("doc_id", F.lit(50))), F.lit("]. First "), F.col("source"), F.lit("\n   goes on\n\n [7]. Then "),
        F.replace("text", F.lit("["), F.lit("(")),
    )
    blocks = t.documents.select("doc_id", F.explode(CA.guideline_blocks(body)).alias("b"))
    return blocks.select("doc_id", F.col("b.id").alias("id"), F.md5("b.text").alias("digest"))


@query(
    "nrm30_note_task_inference",
    """select o_orderkey as id, case o_custkey % 5 when 0 then 'reaction' when 1 then 'material_property' when 2 then 'reaction' when 3 then 'global' end as family,
      case o_custkey % 5 when 0 then 'HZOR' when 1 then 'conductivity' when 2 then 'ORR' end as task from orders""",
)
def nrm30(t):
    k = F.pmod("o_custkey", F.lit(5))
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(k == 0, "hydrazine oxidation").alias("task_type"),
        F.lit(None).cast("string").alias("property_type"),
        F.when(k == 0, "OER").alias("reaction_type"),
        F.lit(None).cast("string").alias("application"),
        F.when(k == 1, "high Thermal Conductivity films for ORR").when(k == 2, "use ORR(acid) data").when(k == 3, "keep strict JSON").otherwise("none").alias("blob"),
        F.lit("guideline").alias("kind"),
    )
    s = TK.infer_note_task({c: c for c in ("task_type", "property_type", "reaction_type", "application")}, F.col("blob"), F.col("kind"))
    return rows.select("id", s.alias("s")).select("id", "s.family", "s.task")


@query(
    "nrm32_citation_ids",
    """select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as id, 'rag:chroma/c' || l_suppkey || '/doi:10.1000/x' || l_partkey || '#chunk:' || l_linenumber as citation, l_linenumber::bigint as chunk from lineitem""",
)
def nrm32(t):
    doc = F.concat(F.lit("**10.1000/X"), text("l_partkey"), F.lit("`**"))
    raw = F.concat(F.lit(' "'), ids.citation_id(F.concat(F.lit("c"), text("l_suppkey")), doc, F.col("l_linenumber")), F.lit(').,'))
    rows = t.wide("lineitem").select(_li_id(), ids.normalize_citation(raw).alias("citation"))
    return rows.select("id", "citation", ids.parse_citation("citation")["chunk"].alias("chunk"))


@query(
    "nrm33_legacy_backfill",
    """select o_orderkey as id, case when o_orderstatus = 'F' then case when o_custkey % 2 = 0 then 'own' else o_custkey::varchar end else '' end as pcd,
      case when o_orderstatus = 'F' then 'mA' else '' end as pcd_unit, case when o_orderstatus = 'F' then '%' else '' end as fe_unit, o_orderstatus = 'F' and o_custkey % 3 <> 0 as missing_efficiency from orders""",
)
def nrm33(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "co2rr ").otherwise("HER").alias("reaction_type"),
        text("o_custkey").alias("value"),
        F.lit("mA").alias("unit"),
        F.when(F.pmod("o_custkey", F.lit(3)) == 0, "50").otherwise(" ").alias("faradaic_efficiency"),
        F.lit(None).cast("string").alias("faradaic_efficiency_unit"),
        F.when((F.col("o_orderstatus") == "F") & (F.pmod("o_custkey", F.lit(2)) == 0), "own").alias("partial_current_density"),
        F.lit(None).cast("string").alias("partial_current_density_unit"),
    )
    out = RC.backfill_feedback(rows)
    return out.select(
        "id", F.col("partial_current_density").alias("pcd"), F.col("partial_current_density_unit").alias("pcd_unit"),
        F.col("faradaic_efficiency_unit").alias("fe_unit"), "missing_efficiency",
    )


@query(
    "nrm34_binary_atomic_split",
    """with o as (select o_orderkey as id, o_custkey as c, o_custkey % 3 as k from orders)
    select id, 'co2rr_top_product' as task, '{"faradaic_efficiency":"0.5","product":"CO"}' as answer from o where k < 2
    union all select id, 'co2rr_partial_current_density', '{"partial_current_density":"' || c || ' mA cm-2"}' from o where k = 1
    union all select id, 'metrics', '{"overpotential_10mAcm-2":"' || c || ' mV"}' from o where k = 2""",
)
def nrm34(t):
    k, c = F.pmod("o_custkey", F.lit(3)), text("o_custkey")
    fe = F.create_map(F.lit("faradaic_efficiency"), F.lit("0.5"))
    full = F.create_map(F.lit("partial_current_density"), F.concat(c, F.lit(" mA cm-2")), F.lit("faradaic_efficiency"), F.lit("0.5"))
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(k < 2, "CO2RR").otherwise("HER").alias("reaction_type"),
        F.lit("CO").alias("product"),
        F.when(k == 0, fe).when(k == 1, full).otherwise(F.create_map(F.lit("overpotential_10mAcm-2"), F.concat(c, F.lit(" mV")))).alias("metrics_gt"),
    )
    return RC.split_tasks(rows).select("id", "task", "answer")


def _label_rows(t):
    q = text(F.col("l_quantity").cast("int"))
    entry = lambda raw, unit: F.struct(raw.alias("raw"), unit.alias("unit"))
    metrics = F.map_from_arrays(
        F.array(F.lit("exchange_current_density"), F.lit("m")),
        F.array(
            entry(F.concat(F.when(F.col("l_tax") > 0.04, ">=").otherwise("~"), q), F.when(F.col("l_linestatus") == "F", "mA cm−2").otherwise("mA mg-1")),
            entry(F.concat(F.when(F.col("l_discount") > 0.05, "< ").otherwise(""), q, F.lit(".5 %")), F.lit("%")),
        ),
    )
    return t.wide("lineitem").select(_li_id(), pick(("HOR", "HER"), "l_orderkey").alias("task_type"), metrics.alias("metrics"))


_LABEL_SQL = f"""l as (select {_LI_ID} as id, (['HOR', 'HER'])[1 + l_orderkey % 2] as task_type, {_Q} as q, l_tax > 0.04 as b1, l_linestatus = 'F' as area, l_discount > 0.05 as b2 from lineitem),
  p as (select *, case when b1 then 'one_sided_bound_requires_interval_verify' when task_type = 'HOR' and not area then 'noncanonical_or_relative_exchange_current_density' end as r1,
    case when b2 then 'one_sided_bound_requires_interval_verify' end as r2 from l)"""


@query(
    "nrm35_point_labels",
    f"""with {_LABEL_SQL} select id, case when r1 is null then q end::double as j0, case when r2 is null then q + 0.5 end::double as m, r1 as j0_deferred, r2 as m_deferred from p""",
)
def nrm35(t):
    p = _label_rows(t).withColumn("p", RC.point_labels("task_type", "metrics"))
    at = lambda c, k: F.try_element_at(F.col(c), F.lit(k))
    return p.select(
        "id", at("p.values", "exchange_current_density").alias("j0"), at("p.values", "m").alias("m"),
        at("p.deferred", "exchange_current_density").alias("j0_deferred"), at("p.deferred", "m").alias("m_deferred"),
    )


@query(
    "agg10_dataset_manifest",
    f"""with {_LABEL_SQL} select coalesce(task_type, 'ALL') as task_type, count(*) as canonical_records, count_if(r1 is null or r2 is null)::bigint as point_samples, (2 * count(*))::bigint as metric_values,
      (count_if(r1 is null) + count_if(r2 is null))::bigint as point_values, (count_if(b1) + count_if(b2))::bigint as bounded_deferred,
      count_if(r1 like 'non%')::bigint as semantic_deferred from p group by rollup(task_type)""",
)
def agg10(t):
    return RC.dataset_manifest(_label_rows(t))


_CTX_TASKS = ("photocatalytic_h2o2", "thermoelectric", "antibacterial", "furfural_hydrogenation", "HER")


@query(
    "nrm36_context_key",
    f"""with c as (select {sql_pick(_CTX_TASKS, 'l_partkey')} as t, {_Q} as q, l_tax > 0.04 as has from lineitem)
    select t as task_type, q, has, case t when 'photocatalytic_h2o2' then '{{"metric":"apparent_quantum_efficiency","wavelengths":' || case when has then '["' || least(q || ' nm', '420 nm') || '"' || case when q = 420 then '' else ',"' || greatest(q || ' nm', '420 nm') || '"' end || ']' else '["unspecified"]' end || '}}'
      when 'thermoelectric' then case when has then '{{"metric":"figure_of_merit","temperature":"' || q || '","temperature_unit":"K"}}' else '{{"metric":"figure_of_merit","temperature":"unspecified","temperature_unit":"unspecified"}}' end
      when 'antibacterial' then '{{"metric":"antibacterial","organisms":' || case when has then '["e. coli","s. aureus"]' else '["unspecified"]' end || '}}'
      when 'furfural_hydrogenation' then '{{"conditions":' || case when has then '["' || least(q || ' bar', '3 h') || '","' || greatest(q || ' bar', '3 h') || '"]' else '["unspecified"]' end || ',"metric":"furfuryl_alcohol_yield"}}' else '{{"metric":"HER"}}' end as context, count(*) as n from c
    group by all""",
)
def nrm36(t):
    q = text(F.col("l_quantity").cast("int"))
    has = F.col("l_tax") > 0.04
    evidence = F.when(has, F.concat(F.lit("S. aureus, E. coli; 420 nm, "), q, F.lit(" nm; 3 h at "), q, F.lit(" BAR; 420  nm".replace("420  nm", "x")))).otherwise("nothing")
    rows = t.wide("lineitem").select(
        pick(_CTX_TASKS, "l_partkey").alias("task_type"), F.col("l_quantity").cast("int").alias("q"), has.alias("has"), evidence.alias("evidence"),
        F.when(has, F.concat(q, F.lit(" K"))).alias("temperature"),
    )
    out = rows.withColumn("context", RC.context_key("task_type", {"evidence": "evidence", "temperature": "temperature"}))
    return out.groupBy("task_type", "q", "has", "context").agg(F.count(F.lit(1)).alias("n"))


@query(
    "nrm38_last_conclusion",
    """select o_orderkey as id, case o_custkey % 3 when 0 then '{"v":' || o_custkey || '}' when 1 then '{"a":1,"b":' || o_custkey || '}' end as payload from orders""",
)
def nrm38(t):
    k, v = F.pmod("o_custkey", F.lit(3)), text("o_custkey")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    last = F.when(k == 0, F.concat(F.lit('conclude({"conclusion": "{\\"v\\":'), v, F.lit('}"})'))).when(
        k == 1, F.concat(F.lit('conclude( {"a":1,"b":'), v, F.lit("} )"))
    ).otherwise("conclude")
    messages = F.array(message("assistant", F.lit("conclude()")), message("assistant", last), message("tool", F.lit('conclude({"z":1})')))
    return t.orders.select(F.col("o_orderkey").alias("id"), A.last_conclusion(messages).alias("payload"))
