"""Queries on distributions of lineitem, orders and document values."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlab.operators import distributions as D
from siftlab.plans.registry import query

_LI = "with v as (select l_returnflag as metric, l_linestatus as unit, l_extendedprice as value from lineitem)"
_BY = ["metric", "unit"]


def _values(t):
    return t.lineitem.select(
        F.col("l_returnflag").alias("metric"), F.col("l_linestatus").alias("unit"), F.col("l_extendedprice").alias("value")
    )


def _rounded(df, cols, digits):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(
    "agg19_distribution_statistics",
    f"""{_LI} select metric, unit, count(*) as n, min(value) as min, round(quantile_cont(value, 0.05), 4) as p05,
      round(quantile_cont(value, 0.25), 4) as p25, round(quantile_cont(value, 0.5), 4) as median, round(avg(value), 4) as mean,
      round(quantile_cont(value, 0.75), 4) as p75, round(quantile_cont(value, 0.95), 4) as p95, max(value) as max,
      round(coalesce(stddev_samp(value), 0), 4) as stdev from v group by all""",
)
def agg19(t):
    out = D.basic_stats(_values(t), _BY, "value")
    return _rounded(out, ["p05", "p25", "median", "mean", "p75", "p95", "stdev"], 4)


@query(
    "agg19_document_lengths",
    """select lang as metric, source as unit, count(*) as n, min(n_chars::double) as min, round(quantile_cont(n_chars::double, 0.05), 4) as p05,
      round(quantile_cont(n_chars::double, 0.25), 4) as p25, round(quantile_cont(n_chars::double, 0.5), 4) as median,
      round(avg(n_chars), 4) as mean, round(quantile_cont(n_chars::double, 0.75), 4) as p75,
      round(quantile_cont(n_chars::double, 0.95), 4) as p95, max(n_chars::double) as max,
      round(coalesce(stddev_samp(n_chars), 0), 4) as stdev from documents group by all""",
)
def agg19_docs(t):
    docs = t.documents.select(
        F.col("lang").alias("metric"), F.col("source").alias("unit"), F.col("n_chars").cast("double").alias("value")
    )
    return _rounded(D.basic_stats(docs, _BY, "value"), ["p05", "p25", "median", "mean", "p75", "p95", "stdev"], 4)


_SHAPE = f"""{_LI}, s as (select metric, unit, count(*)::double as n, min(value) as lo, max(value) as hi,
    quantile_cont(value, 0.75) - quantile_cont(value, 0.25) as iqr, stddev_samp(value) as sd from v group by all),
  sh as (select *, greatest(5, least(50, ceil((hi - lo) / (2 * iqr / pow(n, 1.0::double / 3)))))::int as bins from s),
  f as (select *, (hi - lo) / bins as width from sh)"""


@query(
    "agg20_histogram",
    f"""{_SHAPE}, c as (select metric, unit, case when value <= lo then 0 when value >= hi then bins - 1
        else least(floor((value - lo) / width), bins - 1) end::int as bin, count(*) as n from v join f using (metric, unit) group by all),
      e as (select metric, unit, lo, width, unnest(range(0, bins))::int as bin from f)
    select metric, unit, bin, round(lo + bin * width, 3) as edge, coalesce(n, 0) as count from e left join c using (metric, unit, bin)""",
)
def agg20(t):
    return _rounded(D.histogram(_values(t), _BY, "value"), ["edge"], 3)


@query(
    "agg20_fixed_fraction_bins",
    """with v as (select l_returnflag as metric, l_discount as value from lineitem),
      c as (select metric, case when value <= 0 then 0 when value >= 1 then 19 else least(floor(value / 0.05), 19) end::int as bin,
        count(*) as n from v group by all),
      e as (select distinct metric, unnest(range(0, 20))::int as bin from v)
    select metric, bin, round(bin * 0.05, 6)::double as edge, coalesce(n, 0) as count from e left join c using (metric, bin)""",
)
def agg20_fixed(t):
    v = t.lineitem.select(F.col("l_returnflag").alias("metric"), F.col("l_discount").alias("value"))
    shape = v.select("metric").distinct().select(
        "metric", F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(20).alias("bins"), F.lit(0.05).alias("width")
    )
    return _rounded(D.histogram(v, ["metric"], "value", shape), ["edge"], 6)


@query(
    "agg21_density_curve",
    f"""{_SHAPE}, g as (select metric, unit, lo, hi, width, 1.06 * sd * pow(n, -0.2::double) as h, unnest(range(0, 240)) as point from f),
      d as (select metric, unit, value, count(*) as c from v group by all)
    select metric, unit, point::int as point, round(max(lo + point * ((hi - lo) / 239)), 3) as x,
      round(sum(c * exp(-0.5 * pow((lo + point * ((hi - lo) / 239) - value) / h, 2))) * max(width / (h * sqrt(2 * pi()))), 4) as y
    from g join d using (metric, unit) group by metric, unit, point""",
)
def agg21(t):
    return _rounded(_rounded(D.density_curve(_values(t), _BY, "value"), ["x"], 3), ["y"], 4)


@query(
    "agg21_binned_density",
    f"""{_SHAPE}, g as (select metric, unit, lo, hi, width, 1.06 * sd * pow(n, -0.2::double) as h, (hi - lo) / 956 as d from f),
      placed as (select metric, unit, (value - lo) / d as pos, count(*) as c from v join g using (metric, unit) group by all),
      shares as (select metric, unit, floor(pos)::int as cell, c * (1 - (pos - floor(pos))) as w from placed
        union all select metric, unit, floor(pos)::int + 1, c * (pos - floor(pos)) from placed),
      sums as (select metric, unit, cell, sum(w) as w from shares group by all),
      marks as (select *, unnest(range(0, 240)) as point from g)
    select metric, unit, point::int as point, round(max(lo + point * (d * 4)), 3) as x,
      round(sum(w * exp(-0.5 * pow((point * 4 - cell) * d / h, 2))) * max(width / (h * sqrt(2 * pi()))), 4) as y
    from marks join sums using (metric, unit) group by metric, unit, point""",
)
def agg21_binned(t):
    return _rounded(_rounded(D.binned_density_curve(_values(t), _BY, "value"), ["x"], 3), ["y"], 4)


@query(
    "agg22_out_of_range_sanity",
    """select l_returnflag as metric, count_if(l_tax * 13 between 0 and 1)::bigint as n_in_range,
      count_if(not (l_tax * 13 between 0 and 1))::bigint as n_out_of_range,
      round(avg(case when l_tax * 13 between 0 and 1 then l_tax * 13 end), 6) as mean_in_range from lineitem group by 1""",
)
def agg22(t):
    v = t.lineitem.select(F.col("l_returnflag").alias("metric"), (F.col("l_tax") * 13).alias("value"))
    return _rounded(D.fraction_sanity(v, ["metric"], "value"), ["mean_in_range"], 6)


@query(
    "agg22_modal_unit",
    """with c as (select o_orderstatus as metric, o_orderpriority as unit, count(*) as n from orders group by all)
    select metric, arg_min(unit, (-n, unit)) as unit, max(n) as n from c group by metric""",
)
def agg22_modal(t):
    o = t.orders.select(F.col("o_orderstatus").alias("metric"), F.col("o_orderpriority").alias("unit"))
    return D.modal_label(o, ["metric"], "unit")


@query(
    "agg23_extremes",
    """select o_orderpriority as metric, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as min_id, min(o_totalprice) as min_value,
      arg_min(o_orderkey, (-o_totalprice, o_orderkey)) as max_id, max(o_totalprice) as max_value from orders group by 1""",
)
def agg23(t):
    o = t.orders.select(F.col("o_orderpriority").alias("metric"), "o_orderkey", F.col("o_totalprice").alias("value"))
    out = D.extremes(o, ["metric"], "value", "o_orderkey", ["o_orderkey"])
    return out.select(
        "metric",
        F.col("at_min.o_orderkey").alias("min_id"),
        F.col("at_min.value").alias("min_value"),
        F.col("at_max.o_orderkey").alias("max_id"),
        F.col("at_max.value").alias("max_value"),
    )


@query(
    "agg23_unparsed_examples",
    """with v as (select o_orderkey as id, o_orderpriority as metric, case when o_orderstatus = 'P' then 'n/a' else o_totalprice::varchar end as raw
      from orders), r as (select *, row_number() over (partition by metric order by id) as rank from v where try_cast(raw as double) is null)
    select metric, id, raw, rank::int as rank from r where rank <= 10""",
)
def agg23_unparsed(t):
    raw = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.col("o_totalprice").cast("string"))
    v = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("metric"), raw.alias("raw"))
    return D.unparsed_examples(v.withColumn("_p", F.col("raw").try_cast("double")), ["metric"], "_p", "id").drop("_p")


@query(
    "agg24_key_set_distribution",
    """with k as (select (case when l_linenumber % 2 = 0 then ['b'] else [] end) || (case when l_quantity > 25 then ['a'] else [] end)
        || (case when l_returnflag = 'A' then ['c'] else [] end) as ks from lineitem)
    select array_to_string(list_sort(ks), '+') as keys, len(ks)::int as k, count(*) as count from k group by all""",
)
def agg24(t):
    entries = F.array_compact(
        F.array(
            F.when(F.pmod("l_linenumber", F.lit(2)) == 0, F.struct(F.lit("b").alias("k"), F.lit("1").alias("v"))),
            F.when(F.col("l_quantity") > 25, F.struct(F.lit("a").alias("k"), F.lit("1").alias("v"))),
            F.when(F.col("l_returnflag") == "A", F.struct(F.lit("c").alias("k"), F.lit("1").alias("v"))),
        )
    )
    return D.key_sets(t.lineitem.select(F.map_from_entries(entries).alias("metrics")), "metrics")


@query(
    "agg25_top_categories",
    """with c as (select p_type as metric, p_name as category, count(*) as n from part group by all),
      r as (select *, row_number() over (partition by metric order by n desc, category) as rn from c)
    select metric, case when rn <= 12 then category else 'OTHER' end as category, sum(n)::bigint as n from r group by all""",
)
def agg25(t):
    p = t.part.select(F.col("p_type").alias("metric"), F.col("p_name").alias("category"))
    return D.top_categories(p, ["metric"], "category", 12)
